"""Derivations that explain and maintain themselves: support edges, and delete-and-rederive over them.

A conclusion that is appended gets an edge BECAUSE to each row that it was concluded from, conclusions of the same run included, and an edge
VIA to its rule's declaration. Later changes start at what changed: rows that lost their place (later rows of their keys came) take with
them what rests on them, along the edges; of that, what still follows is derived again, with the bindings of its own row, and what
new rows add is joined premise by premise. Rows that no change reaches are neither concluded anew nor compared.

A conclusion that stays but now rests on other rows keeps its row, and gets further edges. Edges may so name too many reasons,
never too few: a reason that goes costs another derivation, and no conclusion its place.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenet.operators.belief import current
from tenet.operators.closure import written
from tenet.operators.registry import Registry
from tenet.operators.rules import PASSES, SAME, Rule, concluded, constrained, evaluate, evaluate_changed, seen_as_claims
from tenet.plans.pattern import is_variable
from tenet.plans.query import joined, rewritten
from tenet.schema import conform

BECAUSE, VIA = "BECAUSE", "VIA"


@dataclass(frozen=True)
class Maintained:
    """append: conclusions that are new or of another confidence, with `because`. again: conclusions that stand as they did, with what they
    rest on now. retract: rows of lost conclusions, of confidence 0. touched: how many conclusions were put in question. Not
    complete: the passes ended before the fixpoint, and nothing is retracted."""

    append: DataFrame
    again: DataFrame
    retract: DataFrame
    touched: int
    complete: bool
    passes: int


def of_rule(rule: Rule | None = None) -> Column:
    """Was a row concluded (by this rule)?"""
    return F.array_contains("contexts", rule.source) if rule else F.exists("contexts", lambda c: c.startswith("src:rule/"))


def superseded(claims: DataFrame, since: str) -> DataFrame:
    """(id): rows up to `since` of keys that have later rows."""
    keys = claims.where(F.col("tx") > since).select("claim_key").distinct()
    return claims.where(F.col("tx") <= since).join(keys, "claim_key", "left_semi").select("id")


def resting_on(spark: SparkSession, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id): rows that rest on these, at any number of steps: a frontier over edges, which leaves what it has seen."""
    step = edges.where(F.col("role") == BECAUSE).select(F.col("child_id").alias("id"), F.col("parent_id").alias("next"))
    frontier = written(spark, ids.select("id").distinct(), "resting")
    seen = frontier.limit(0)
    while True:
        found = frontier.join(step, "id").select(F.col("next").alias("id")).distinct().join(seen, "id", "left_anti")
        frontier = written(spark, found, "resting")
        if frontier.limit(1).count() == 0:
            return seen
        seen = seen.union(frontier)


def bindings(rows: DataFrame, rule: Rule) -> DataFrame | None:
    """What a rule's conclusions bind its variables to; None if the conclusion has none. Rows of other shapes bind nothing."""
    c = rewritten(rule.conclusion, Registry())
    value = F.coalesce("value_text", F.col("value_num").cast("string"))
    slots, fit, found = [(c.subject, F.col("subject")), (c.obj, F.col("object")), (c.value, value)], F.col("verb") == c.verb, {}
    for slot, column in slots:
        if slot and is_variable(slot):
            fit = fit & column.eqNullSafe(found[slot]) if slot in found else fit & column.isNotNull()
            found.setdefault(slot, column)
    if not found:
        return None
    return rows.where(of_rule(rule) & fit).select(*[x.alias(s[1:]) for s, x in found.items()])


def rederived(spark: SparkSession, seen: DataFrame, lost: DataFrame, rule: Rule) -> DataFrame:
    """The rule's conclusions among the keys of lost rows, found from their own bindings."""
    start = bindings(lost, rule)
    rows = constrained(joined(spark, seen, list(rule.premises), start=start), rule.constraints)
    return concluded(rows, rule).join(lost.select("claim_key").distinct(), "claim_key", "left_semi")


def strongest(rows: DataFrame) -> DataFrame:
    """A row a key, of equal confidences that of the least reasons."""
    best = Window.partitionBy("claim_key").orderBy(F.col("conf").desc(), F.to_json("because"))
    return rows.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")


def maintain(spark: SparkSession, claims: DataFrame, edges: DataFrame, rules: list[Rule], since: str | None, passes: int = PASSES) -> Maintained:
    """What rows after `since` change in the conclusions (None: all rows are new, and nothing was concluded yet)."""
    held = written(spark, current(claims.where(of_rule())).where("conf > 0"), "held")
    base = claims.where(~of_rule())
    if since is None:
        lost, fresh = held, current(base).where("conf > 0")
    else:
        put = superseded(claims, since)
        moved = {r[0] for r in claims.where(F.col("tx") > since).select("verb").distinct().collect()}
        for rule in rules:  # paths are no reasons that edges name: where a hop may have changed, all that the rule concluded is in question
            if any(p.transitive and rewritten(p, Registry()).verb in moved for p in rule.premises):
                put = put.unionByName(held.where(of_rule(rule)).select("id"))
        gone = resting_on(spark, edges, put).unionByName(put)
        lost = written(spark, held.join(gone, "id", "left_semi"), "lost")
        fresh = current(base.join(base.where(F.col("tx") > since).select("claim_key").distinct(), "claim_key", "left_semi")).where(F.col("tx") > since)
    # Without a mark all is in question, and nothing stays.
    stays = None if since is None else written(spark, held.join(lost.select("id"), "id", "left_anti"), "stays")
    touched = lost.count()
    base, fresh = written(spark, current(base).where("conf > 0"), "base"), written(spark, fresh, "fresh")
    verbs = {r[0] for r in fresh.select("verb").distinct().collect()}
    found, changed, n, complete = None, fresh, 0, False
    while n < passes:
        n += 1
        # Keys of conclusions hold their rule, so no row of base has one of theirs.
        seen, standing = base, stays if stays is None or found is None else stays.join(found.select("claim_key"), "claim_key", "left_anti")
        if standing is not None:
            seen = seen.unionByName(conform(standing))
        if found is not None:
            seen = seen.unionByName(seen_as_claims(found))
        new = None
        for rule in rules:
            each = [evaluate(spark, seen, rule) if since is None and n == 1 else evaluate_changed(spark, seen, changed, verbs, rule)]
            if n == 1 and touched and since is not None:
                each.append(rederived(spark, seen, lost, rule))
            for rows in each:
                if rows is not None:
                    new = rows if new is None else new.unionByName(rows)
        if new is None:
            complete = True
            break
        better = strongest(new)
        if held_now := [x.select("claim_key", F.col("conf").alias("was")) for x in (standing, found) if x is not None]:  # what is stronger than it was, or not known yet
            better = better.join(reduce(DataFrame.unionByName, held_now), "claim_key", "left").where(F.col("was").isNull() | (F.col("conf") > F.col("was") + SAME)).drop("was")
        step = written(spark, better, "maintained")
        if step.limit(1).count() == 0:
            complete = True
            break
        found = step if found is None else written(spark, found.join(step.select("claim_key"), "claim_key", "left_anti").unionByName(step), "maintained")
        changed, verbs = seen_as_claims(step), {r.conclusion.verb for r in rules}
    if found is None:
        found = concluded_none(spark, rules[0], claims) if rules else held.limit(0).withColumn("because", F.array().cast("array<string>"))
    was = held.select("claim_key", F.col("conf").alias("was"))
    both = found.join(was, "claim_key", "left")
    same = F.col("was").isNotNull() & (F.abs(F.col("conf") - F.col("was")) <= SAME)
    append, again = both.where(~same).drop("was"), both.where(same).drop("was")
    retract = lost.join(found.select("claim_key"), "claim_key", "left_anti").withColumn("conf", F.lit(0.0))
    return Maintained(append, again, retract if complete else retract.limit(0), touched, complete, n)


def concluded_none(spark: SparkSession, rule: Rule, claims: DataFrame) -> DataFrame:
    """No conclusions, with their columns."""
    names = [*dict.fromkeys(v for p in rule.premises for v in p.variables)]
    rows = spark.createDataFrame([], ", ".join([*[f"`{v}` string" for v in names], "ids array<string>", "confs array<double>"]))
    return concluded(rows, rule).limit(0)


def support_edges(found: Maintained, appended: DataFrame, held: DataFrame, declared: DataFrame) -> DataFrame:
    """Edges of a run. appended: its conclusions with their ids; held: current rule rows before it; declared: (subject, id) of rules. A
    reason that is itself a conclusion is named by the row that has its key now."""
    ids = appended.select("claim_key", "id").unionByName(held.join(appended.select("claim_key"), "claim_key", "left_anti").select("claim_key", "id"))
    stand = ids.select(F.concat(F.lit("f"), F.sha2("claim_key", 256)).alias("stand_in"), F.col("id").alias("real"))
    rows = found.append.unionByName(found.again).join(ids, "claim_key")
    reasons = rows.select(F.col("id").alias("parent_id"), F.explode(F.array_distinct("because")).alias("stand_in")).join(stand, "stand_in", "left")
    because = reasons.select("parent_id", F.lit(BECAUSE).alias("role"), F.coalesce("real", "stand_in").alias("child_id"))
    named = rows.select(F.col("id").alias("parent_id"), F.regexp_replace(F.filter("contexts", lambda c: c.startswith("src:rule/"))[0], "^src:", "").alias("subject"))
    via = named.join(declared, "subject").select("parent_id", F.lit(VIA).alias("role"), F.col("id").alias("child_id"))
    return because.unionByName(via).distinct()
