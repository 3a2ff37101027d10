"""Belief states: the latest row of each claim key, now and as of a transaction time, and the plain reads over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ranks of sensitivity labels. Unlabelled rows are internal, unknown labels restricted.
SENSITIVITY = {"public": 0, "internal": 1, "confidential": 2, "restricted": 3}


def as_of(claims: DataFrame, bound: str | None, inclusive: bool = True) -> DataFrame:
    """Rows known at a transaction id; a filter on tx, below any aggregation."""
    if bound is None:
        return claims
    return claims.where(F.col("tx") <= bound if inclusive else F.col("tx") < bound)


def current(claims: DataFrame, bound: str | None = None, inclusive: bool = True) -> DataFrame:
    """The row of largest tx of every claim key, retracted and negated ones included.

    Maxima are aggregated before the one shuffle, so a key with very many rows sends one row a task."""
    names = claims.columns
    row = F.struct(*[F.col(c) for c in names if c != "claim_key"])
    best = as_of(claims, bound, inclusive).groupBy("claim_key").agg(F.max_by(row, "tx").alias("r"))
    return best.select(*[F.col("claim_key") if c == "claim_key" else F.col(f"r.{c}").alias(c) for c in names])


def supported(claims: DataFrame) -> DataFrame:
    """Neither retracted nor negated."""
    return claims.where((F.col("conf") > 0) & ~F.col("negated"))


def believed(claims: DataFrame, *columns: str, bound: str | None = None, inclusive: bool = True) -> DataFrame:
    """These columns of the current supported rows: nothing else of a row is aggregated and shuffled."""
    narrow = claims.select("claim_key", "tx", "conf", "negated", *[c for c in columns if c != "tx"])
    return supported(current(narrow, bound, inclusive)).select(*columns)


def at_least(claims: DataFrame, conf: float) -> DataFrame:
    return current(claims).where(F.col("conf") >= conf)


def history(claims: DataFrame, key: str) -> DataFrame:
    return claims.where(F.col("claim_key") == key).orderBy("tx")


def latest(claims: DataFrame, key: str) -> DataFrame:
    return claims.where(F.col("claim_key") == key).orderBy(F.desc("tx")).limit(1)


def about(claims: DataFrame, entity: str) -> DataFrame:
    """All rows that name the entity as subject or object, the newest first."""
    return claims.where((F.col("subject") == entity) | (F.col("object") == entity)).orderBy(F.desc("tx"))


def forward(claims: DataFrame, entity: str, everything: bool = False) -> DataFrame:
    rows = current(claims.where((F.col("subject") == entity) & F.col("object").isNotNull()))
    return rows if everything else supported(rows)


def reverse(claims: DataFrame, entity: str, inverses: dict[str, str] | None = None, everything: bool = False) -> DataFrame:
    """Relations into the entity, with the name that they have in the other direction."""
    rows = current(claims.where(F.col("object") == entity))
    rows = rows if everything else supported(rows)
    named = F.create_map(*[F.lit(x) for kv in (inverses or {"": ""}).items() for x in kv])
    return rows.withColumn("inverse", F.coalesce(F.try_element_at(named, F.col("verb")), F.col("verb")))


def by_tag(claims: DataFrame, key: str, value: str | None = None) -> DataFrame:
    """Rows with the tag of this value; without one, with the flat tag."""
    same = (lambda t: (t["key"] == key) & t["value"].isNull()) if value is None else (lambda t: (t["key"] == key) & (t["value"] == value))
    return claims.where(F.exists("tags", same))


def any_tag(claims: DataFrame, key: str) -> DataFrame:
    return claims.where(F.exists("tags", lambda t: t["key"] == key))


def by_context(claims: DataFrame, context: str) -> DataFrame:
    return claims.where(F.array_contains("contexts", context))


def provenance(contexts: Column, actor: str | None = None, run: str | None = None) -> Column:
    """(dimension, value) pairs: sources and their kinds as contexts tell them, and the caller's actor and run."""
    def item(dimension: str, value: Column) -> Column:
        return F.struct(F.lit(dimension).alias("dimension"), value.alias("value"))

    sources = F.transform(F.filter(contexts, lambda c: c.startswith("src:")), lambda c: F.substring(c, F.lit(5), F.length(c)))
    actors = F.filter(sources, lambda s: s.isin("cli") | s.rlike("^(agent|action)(/|$)"))
    runs = F.filter(sources, lambda s: s.rlike("^(rule|run)/"))
    scopes = F.transform(F.filter(contexts, lambda c: c.startswith("scope:")), lambda c: F.substring(c, F.lit(7), F.length(c)))
    parts = [F.transform(actors, lambda s: item("actor", s)), F.transform(sources, lambda s: item("source", s)), F.transform(runs, lambda s: item("run", s)), F.transform(scopes, lambda s: item("domain", s))]
    if actor:
        parts.append(F.array(item("actor", F.lit(actor))))
    if run:
        parts.append(F.array(item("run", F.lit(run))))
    return F.array_distinct(F.concat(*parts))


def by_provenance(claims: DataFrame, dimension: str, value: str) -> DataFrame:
    return claims.where(F.exists(provenance(F.col("contexts")), lambda p: (p["dimension"] == dimension) & (p["value"] == value)))


def topic_members(claims: DataFrame, topic: str) -> DataFrame:
    return forward(claims.where(F.col("verb") == "CONTAINS"), topic).select(F.col("object").alias("member"))


def topics_of(claims: DataFrame, entity: str) -> DataFrame:
    return believed(claims.where((F.col("verb") == "CONTAINS") & (F.col("object") == entity)), "subject").select(F.col("subject").alias("topic"))


def topics(claims: DataFrame) -> DataFrame:
    """Topics with their numbers of members."""
    held = believed(claims.where((F.col("verb") == "CONTAINS") & F.col("object").isNotNull()), "subject")
    return held.groupBy(F.col("subject").alias("topic")).agg(F.count("*").alias("members"))


def citations(claims: DataFrame) -> DataFrame:
    """For every entity of current relations: how many it names, and how many name it. One pass, one shuffle."""
    held = believed(claims.where(F.col("object").isNotNull()), "subject", "object")
    ends = held.select(F.explode(F.array(F.struct(F.col("subject").alias("entity"), F.lit(1).alias("out")), F.struct(F.col("object").alias("entity"), F.lit(0).alias("out")))).alias("e"))
    return ends.groupBy("e.entity").agg(F.sum("e.out").alias("cites"), F.sum(1 - F.col("e.out")).alias("cited_by"))


def degree_top(claims: DataFrame, n: int = 15) -> DataFrame:
    """The entities named most often."""
    return citations(claims).select("entity", (F.col("cites") + F.col("cited_by")).alias("degree")).orderBy(F.desc("degree"), "entity").limit(n)


def edges_of(claims: DataFrame, edges: DataFrame, ids: Sequence[str] | None = None) -> DataFrame:
    """(parent_id, role) with the child's row."""
    e = edges if ids is None else edges.where(F.col("parent_id").isin(*ids))
    return e.join(claims, e["child_id"] == claims["id"]).drop("child_id")


def sensitivity() -> Column:
    """The rank of a row's label: the highest of its labels, internal without any."""
    labels = F.transform(F.filter("tags", lambda t: t["key"] == "sensitivity"), lambda t: rank(t["value"]))
    return F.coalesce(F.array_max(labels), F.lit(SENSITIVITY["internal"]))


def rank(label: Column) -> Column:
    out = F.lit(SENSITIVITY["restricted"])
    for k, v in SENSITIVITY.items():
        out = F.when(label == k, F.lit(v)).otherwise(out)
    return out


def visible(claims: DataFrame, ceiling: str) -> DataFrame:
    return claims.where(sensitivity() <= SENSITIVITY[ceiling])


def scoped(claims: DataFrame, edges: DataFrame, ceiling: str) -> tuple[DataFrame, DataFrame]:
    """What a reader of a ceiling sees: rows, and edges of which both ends are seen."""
    rows = visible(claims, ceiling)
    ids = rows.select("id")
    seen = edges.join(ids, edges["parent_id"] == ids["id"], "left_semi").join(ids, F.col("child_id") == ids["id"], "left_semi")
    return rows, seen


def newest(claims: DataFrame, n: int) -> DataFrame:
    return claims.orderBy(F.desc("tx")).limit(n)


def page(rows: DataFrame, after: str | None = None, snapshot: str | None = None, limit: int = 100) -> DataFrame:
    """A page by key: rows after the last tx seen, within the snapshot that the first page fixed."""
    if not 1 <= limit <= 1000:
        raise ValueError("a page has 1 to 1000 rows")
    rows = rows if snapshot is None else rows.where(F.col("tx") <= snapshot)
    rows = rows if after is None else rows.where(F.col("tx") > after)
    return rows.orderBy("tx").limit(limit)


def snapshot(claims: DataFrame) -> str | None:
    return claims.agg(F.max("tx")).first()[0]


def capped(rows: DataFrame, n: int, *order: Column | str) -> tuple[DataFrame, int]:
    """A section of at most n rows, and how many there are in all."""
    return rows.orderBy(*order).limit(n), rows.count()


def ranked_in(rows: DataFrame, group: Sequence[str], *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
