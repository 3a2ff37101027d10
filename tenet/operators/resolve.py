"""Contested facts under a source policy, and numeric fusion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenet.functions.keys import group_key
from tenet.functions.values import DURATIONS
from tenet.operators.belief import current, supported


@dataclass(frozen=True)
class Entry:
    """What the policy says of a source and all below it; None where it says nothing."""

    source: str
    precedence: float | None = None
    reliability: float | None = None


# Precedence of the root and of the built-in sources.
BUILT_IN = (Entry("", 2, 1.0), Entry("cli", 4), Entry("agent", 3), Entry("action", 3), Entry("rule", 1))


def read_policy(claims: DataFrame) -> list[Entry]:
    """Built-ins, overridden by current positive claims `source[/p] HAS precedence: n` and `HAS reliability: r`.

    A declaration contested by several sources is settled by the built-ins. Declarations are few by nature; they are collected."""
    declared = claims.where(F.col("subject").rlike("^source(/|$)") & (F.col("verb") == "HAS") & F.col("attribute").isin("precedence", "reliability"))
    best = winners(declared, list(BUILT_IN)).where(~F.col("negated"))
    found: dict[str, dict[str, float]] = {}
    for r in best.select("subject", "attribute", "value_num", "value_unit").collect():
        source, n = r["subject"].partition("/")[2], r["value_num"]
        if r["attribute"] == "precedence" and n is not None and r["value_unit"] is None:
            found.setdefault(source, {})["precedence"] = n
        elif r["attribute"] == "reliability" and n is not None:
            share = n / 100 if r["value_unit"] == "%" else n if r["value_unit"] is None else -1
            if 0 <= share <= 1:
                found.setdefault(source, {})["reliability"] = share
    base = {e.source: {"precedence": e.precedence, "reliability": e.reliability} for e in BUILT_IN}
    return [Entry(s, **(base.get(s, {}) | found.get(s, {}))) for s in {**base, **found}]


def of_source(source: Column, policy: list[Entry], what: str) -> Column:
    """The policy's value for a source path by its longest known prefix; entries are literals of the plan, no join."""
    out = F.lit(next((getattr(e, what) for e in policy if e.source == "" and getattr(e, what) is not None), 2.0 if what == "precedence" else 1.0)).cast("double")
    for e in sorted((e for e in policy if e.source and getattr(e, what) is not None), key=lambda e: (len(e.source), e.source)):
        out = F.when((source == e.source) | source.startswith(e.source + "/"), F.lit(float(getattr(e, what)))).otherwise(out)
    return out


def grouped(rows: DataFrame, representatives: DataFrame | None = None) -> DataFrame:
    """rows with their group; by representatives (name, rep), both ends of a relation stand under one name of theirs."""
    if representatives is None:
        return rows.withColumn("group", group_key())
    out = rows
    for end in ("subject", "object"):
        out = out.join(representatives.select(F.col("name").alias(end), F.col("rep").alias(f"__{end}")), end, "left")
    named = [F.coalesce(f"__{end}", end) for end in ("subject", "object")]
    return out.withColumn("group", group_key(*named)).select(*rows.columns, "group")


def ranked(claims: DataFrame, policy: list[Entry], representatives: DataFrame | None = None) -> DataFrame:
    """Current candidates (conf > 0) with their group, class, reliability, weight and rank in the group."""
    rows = grouped(current(claims).where(F.col("conf") > 0), representatives)
    sources = F.transform(F.filter("contexts", lambda c: c.startswith("src:")), lambda c: F.substring(c, F.lit(5), F.length(c)))
    rows = rows.withColumn("class", F.coalesce(F.array_max(F.transform(sources, lambda s: of_source(s, policy, "precedence"))), of_source(F.lit(""), policy, "precedence")))
    rows = rows.withColumn("reliability", F.coalesce(F.array_min(F.transform(sources, lambda s: of_source(s, policy, "reliability"))), F.lit(1.0)))
    rows = rows.withColumn("weight", F.col("conf") * F.col("reliability"))
    order = Window.partitionBy("group").orderBy(F.desc("class"), F.desc("weight"), F.desc("tx"))
    return rows.withColumn("rank", F.row_number().over(order))


def winners(claims: DataFrame, policy: list[Entry], representatives: DataFrame | None = None) -> DataFrame:
    """The winning row of each group, as it stands.

    A maximum by (class, weight, tx), aggregated before the shuffle: no group is sorted."""
    rows = ranked_columns(claims, policy, representatives)
    names = claims.columns
    best = rows.groupBy("group").agg(F.max_by(F.struct(*names), F.struct("class", "weight", "tx")).alias("r"))
    return best.select(*[F.col(f"r.{c}").alias(c) for c in names])


def ranked_columns(claims: DataFrame, policy: list[Entry], representatives: DataFrame | None = None) -> DataFrame:
    return ranked(claims, policy, representatives).drop("rank")  # the window goes with the column that needs it


def contested(claims: DataFrame, policy: list[Entry], representatives: DataFrame | None = None) -> DataFrame:
    """Groups with more than one candidate, the winner first."""
    rows = ranked(claims, policy, representatives)
    return rows.withColumn("candidates", F.count("*").over(Window.partitionBy("group"))).where("candidates > 1")


def estimate_columns(rows: DataFrame) -> DataFrame:
    """mean and sigma of numeric rows with a delta, in the value's unit; durations convert between their units."""
    factor = F.lit(1.0)
    for unit, ms in DURATIONS.items():
        for other, ms2 in DURATIONS.items():
            factor = F.when((F.col("delta_unit") == unit) & (F.col("value_unit") == other), F.lit(ms / ms2)).otherwise(factor)
    s = F.col("delta_num") * factor / F.col("sigma_level")
    return rows.where(F.col("value_num").isNotNull() & s.isNotNull()).withColumn("mean", F.col("value_num")).withColumn("sigma", s)


def scale(unit: Column) -> Column:
    """What a duration's unit is in the shortest one; 1 for others."""
    out = F.lit(1.0)
    for name, ms in DURATIONS.items():
        out = F.when(unit == name, F.lit(ms)).otherwise(out)
    return out


def fuse(estimates: DataFrame, by: list[str]) -> DataFrame:
    """Precision-weighted means: weight conf / sigma^2; rows of no confidence are left out. Durations are told in the unit of the earliest row
    (by tx; without that column, in the longest of their units), other mixed units raise, and so does a sigma that is not positive and finite."""
    sound = (F.col("sigma") > 0) & ~F.isnan("sigma") & (F.col("sigma") < float("inf"))
    sigma = F.when(sound, F.col("sigma") * scale(F.col("value_unit"))).otherwise(F.raise_error(F.lit("a sigma is positive and finite")).cast("double"))
    rows = estimates.where(F.col("conf") > 0).withColumn("s", sigma).withColumn("w", F.col("conf") / (F.col("s") * F.col("s")))
    rows = rows.withColumn("dimension", F.when(F.col("value_unit").isin(*DURATIONS), "duration").otherwise(F.coalesce("value_unit", F.lit(""))))
    first = F.min_by("value_unit", "tx") if "tx" in estimates.columns else F.max_by("value_unit", scale(F.col("value_unit")))
    unit = F.when(F.min("dimension") != F.max("dimension"), F.raise_error(F.lit("estimates of one quantity have different units"))).otherwise(first)
    out = rows.groupBy(*by).agg(F.sum(F.col("w") * F.col("mean") * scale(F.col("value_unit"))).alias("wx"), F.sum("w").alias("p"), F.count("*").alias("n"), unit.alias("unit"))
    one = scale(F.col("unit"))
    return out.select(*by, (F.col("wx") / F.col("p") / one).alias("mean"), (1 / F.sqrt("p") / one).alias("sigma"), (F.col("p") * one * one).alias("precision"), "unit", "n")


def fuse_one(rows: DataFrame, representatives: DataFrame | None = None) -> DataFrame:
    """The posterior of selected claims, which must all be of one quantity: the same subject (by representatives), verb, attribute and
    contexts but for sources. No estimate, no row; those of several quantities raise."""
    told = grouped(estimate_columns(rows).where(F.col("conf") > 0), representatives)
    several = F.when(F.min("group") != F.max("group"), F.raise_error(F.concat(F.lit("several quantities: "), F.min("group"), F.lit(" / "), F.max("group")))).otherwise(F.min("group"))
    quantity = told.agg(several.alias("quantity")).where("quantity is not null")
    return fuse(told.withColumnRenamed("group", "quantity"), ["quantity"]).join(quantity, "quantity")


def noisy_and(confs: Column, rule_conf: float = 1.0) -> Column:
    return F.aggregate(confs, F.lit(float(rule_conf)), lambda a, x: a * x)


def normalised(rows: DataFrame, group: list[str], weight: str = "conf") -> DataFrame:
    """Shares of hypotheses within their group, and the gap of each to the best."""
    w = Window.partitionBy(*group)
    return rows.withColumn("share", F.col(weight) / F.sum(weight).over(w)).withColumn("gap", F.max(weight).over(w) - F.col(weight))


def average_confidence(claims: DataFrame) -> DataFrame:
    return supported(current(claims)).agg(F.avg("conf").alias("average"))


__all__ = ["BUILT_IN", "Entry", "contested", "estimate_columns", "fuse", "fuse_one", "grouped", "noisy_and", "normalised", "ranked", "read_policy", "winners"]
