"""Shapes and health: expectations, instances, violations, staleness, disagreements, coverage, the gate.

The gate counts anew only what a change touches: the names in its rows and, if it declares expectations or kinds of types, the
instances of those types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenet.functions.keys import is_entity, other_contexts, uuid7_ms
from tenet.operators import closure as graph
from tenet.operators.belief import believed, current
from tenet.operators.registry import Registry
from tenet.staging import staged

DAY = 86_400_000


def tag_value(key: str) -> Column:
    return F.get(F.filter("tags", lambda t: t["key"] == key), F.lit(0))["value"]


def expectations(claims: DataFrame) -> DataFrame:
    """type, property, kind (relation for a verb, else attribute), cardinality and unit, of current positive EXPECTS rows."""
    rows = believed(claims.where(F.col("verb") == "EXPECTS"), "subject", "object", "attribute", "tags")
    what = F.coalesce("object", "attribute")
    return rows.select(F.col("subject").alias("type"), what.alias("property"), F.when(what.rlike("^[A-Z][A-Z-]*$"), "relation").otherwise("attribute").alias("kind"), tag_value("cardinality").alias("cardinality"), tag_value("unit").alias("unit"))


#: Up to so many names that a change touches are read ahead, so that scans leave out all other entities' rows; more are joined.
MOST_TOUCHED = 1_000
Among = DataFrame | list[str]
#: Expectations are declared by people; up to so many are read ahead, so only facts that they name are read at all.
MOST_EXPECTATIONS = 10_000
EXPECTATION = "type string, property string, kind string, cardinality string, unit string"


def relevant(claims: DataFrame, expected: list, registry: Registry) -> DataFrame:
    """The claims that any expectation is about. Verb and attribute are parts of the claim key, so this goes below `current`."""
    attributes = sorted({e["property"] for e in expected if e["kind"] == "attribute"})
    verbs = {registry.stored(e["property"]) for e in expected if e["kind"] == "relation"}
    verbs |= {registry.primary(v) for v in verbs if registry.primary(v)}
    return claims.where(((F.col("verb") == "HAS") & F.col("attribute").isin(attributes)) | (F.col("verb").isin(sorted(verbs)) & F.col("object").isNotNull()))


def naming(claims: DataFrame, among: Among | None, *ends: str) -> DataFrame:
    """The claims that have one of the names at one of these ends. Ends are parts of the claim key, so this goes below `current`."""
    if among is None:
        return claims
    if isinstance(among, list):
        return claims.where(reduce(lambda a, b: a | b, [F.col(e).isin(among) for e in ends]))
    out, left = [], claims
    for e in ends:
        names = among.select(F.col("name").alias(e))
        out.append(left.join(names, e, "left_semi").select(*claims.columns))
        left = left.join(names, e, "left_anti")
    return reduce(DataFrame.unionByName, out)


def instances(spark: SparkSession, claims: DataFrame, among: Among | None = None) -> DataFrame:
    """(entity, type, via): positive IS into a type or one of its EXTENDS+ descendants; `via` is the type named. among: of these entities."""
    kinds = naming(claims.where((F.col("verb") == "IS") & F.col("object").isNotNull()), among, "subject")
    named = believed(kinds, "subject", "object").where(is_entity(F.col("object")))
    direct = named.select(F.col("subject").alias("entity"), F.col("object").alias("via"))
    up = graph.closure(spark, graph.edges_of_verb(claims, "EXTENDS")).select(F.col("src").alias("via"), F.col("dst").alias("type"))
    return direct.withColumn("type", F.col("via")).select("entity", "type", "via").union(direct.join(up, "via").select("entity", "type", "via")).distinct()


def violations(claims: DataFrame, expected: DataFrame, held: DataFrame, registry: Registry | None = None) -> DataFrame:
    """(entity, type, property, problem, observed, units): what instances lack, have too often, or have in another unit.

    An expectation of an inverse verb counts the primary relations into the entity; one of a renamed verb those of its stored name."""
    r = registry or Registry()
    facts = believed(claims, "subject", "verb", "attribute", "object", "value_unit")
    none = F.lit(None).cast("string").alias("value_unit")
    attribute = F.struct(F.col("subject").alias("entity"), F.col("attribute").alias("property"), F.lit("attribute").alias("kind"), "value_unit")
    forth = F.struct(F.col("subject").alias("entity"), F.col("verb").alias("property"), F.lit("relation").alias("kind"), none)
    names = F.create_map(*[F.lit(x) for inverse, primary in r.inverses.items() for x in (primary, inverse)])
    inverse = F.try_element_at(names, F.col("verb"))
    back = F.struct(F.col("object").alias("entity"), inverse.alias("property"), F.lit("relation").alias("kind"), none)
    has, related = F.col("attribute").isNotNull() & (F.col("verb") == "HAS"), F.col("object").isNotNull()
    ends = F.array(F.when(has, attribute), F.when(related, forth), F.when(related & inverse.isNotNull(), back))
    counted = facts.select(F.explode(F.array_compact(ends)).alias("f")).select("f.*").groupBy("entity", "property", "kind")
    counted = counted.agg(F.count("*").alias("n"), F.collect_set(F.coalesce("value_unit", F.lit(""))).alias("units"))
    pairs = held.select("entity", "type").join(expected.withColumn("stored", r.column(F.col("property"))), "type")
    seen = pairs.join(counted.withColumnRenamed("property", "stored"), ["entity", "stored", "kind"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    wrong = F.when(F.col("n") == 0, "missing").when((F.col("cardinality") == "one") & (F.col("n") > 1), "too many")
    wrong = wrong.when(F.col("unit").isNotNull() & F.exists("units", lambda u: u != F.col("unit")), "unit")
    units = F.array_sort(F.filter(F.coalesce("units", F.array().cast("array<string>")), lambda u: u != ""))
    return seen.withColumn("problem", wrong).where("problem is not null").select("entity", "type", "property", "problem", F.col("n").cast("long").alias("observed"), units.alias("units"))


def check(spark: SparkSession, claims: DataFrame, registry: Registry | None = None, among: Among | None = None) -> DataFrame:
    """All violations, or those of some entities. The expectations are read first, and facts that none of them names are filtered at the
    scan."""
    expected, facts = expectations(claims), naming(claims, among, "subject", "object")
    read, held, r = expected.limit(MOST_EXPECTATIONS + 1).collect(), instances(spark, claims, among), registry or Registry()
    if len(read) > MOST_EXPECTATIONS:
        return violations(facts, expected, held, r)
    return violations(relevant(facts, read, r), spark.createDataFrame(read, EXPECTATION), held, r)


def touched(spark: SparkSession, after: DataFrame, change: DataFrame) -> Among | None:
    """The names whose violations may grow by a change, `after` it; None if all may, as verbs are declared anew."""
    of_types = F.col("verb").isin("EXPECTS", "EXTENDS")
    verbs, types = change.agg(F.max(F.col("verb").isin("REVERSE", "RENAMED-TO")), F.max(of_types)).first()
    if verbs:
        return None
    names = change.select(F.explode(F.array("subject", "object")).alias("name")).where("name is not null")
    if types:
        declared = change.where(of_types).select(F.col("subject").alias("type")).distinct()
        names = names.union(instances(spark, after).join(declared, "type", "left_semi").select("entity"))
    names = staged(spark, names.distinct(), "touched")
    few = names.limit(MOST_TOUCHED + 1).collect()
    return names if len(few) > MOST_TOUCHED else sorted(r["name"] for r in few)


def added(spark: SparkSession, claims: DataFrame, change: DataFrame, was: Registry | None = None, now: Registry | None = None) -> DataFrame:
    """The violations that a change (rows later than all claims) would add, by the registries before and after it: what two whole checks
    differ in, counted for the entities that it touches. The change is read several times: stage it, if it is costly."""
    after = claims.unionByName(change)
    among = touched(spark, after, change)
    return new_violations(check(spark, claims, was, among), check(spark, after, now or was, among))


def new_violations(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a change would add: the gate rejects it if this has rows."""
    keys = ["entity", "type", "property", "problem"]
    return after.join(before.select(*keys).distinct(), keys, "left_anti")


def stale(claims: DataFrame, now_ms: int, days: int = 90) -> DataFrame:
    return current(claims).where(F.lit(now_ms) - uuid7_ms(F.col("tx")) > days * DAY)


def review(claims: DataFrame, low: float = 0.3, high: float = 0.7) -> DataFrame:
    return current(claims).where((F.col("conf") >= low) & (F.col("conf") <= high))


def coverage(claims: DataFrame) -> DataFrame:
    """rows, facts, current, retracted, negated, entities, typed, low and average confidence (of current rows with conf > 0)."""
    now = current(claims)
    typed = (F.col("verb") == "IS") & ~F.col("negated") & (F.col("conf") > 0)
    held = now.agg(
        F.count("*").alias("facts"),
        F.count_if((F.col("conf") > 0) & ~F.col("negated")).alias("current"),
        F.count_if(F.col("conf") == 0).alias("retracted"),
        F.count_if(F.col("negated") & (F.col("conf") > 0)).alias("negated"),
        F.count_if((F.col("conf") > 0) & (F.col("conf") < 0.3)).alias("low"),
        F.avg(F.when(F.col("conf") > 0, F.col("conf"))).alias("average_conf"),
        F.count_distinct(F.when(typed, F.col("subject"))).alias("typed"),
    )
    ends = now.select(F.explode(F.array("subject", "object")).alias("e")).where("e is not null").where(is_entity(F.col("e")))
    return held.crossJoin(claims.agg(F.count("*").alias("rows"))).crossJoin(ends.agg(F.count_distinct("e").alias("entities")))  # one row each


def disagreements(claims: DataFrame, representatives: DataFrame) -> DataFrame:
    """Pairs of current rows under different names of one thing that say different values or polarities."""
    rows = current(claims).where(F.col("conf") > 0)
    rows = rows.join(representatives.select(F.col("name").alias("subject"), "rep"), "subject")
    what = F.when(F.col("attribute").isNotNull(), F.concat(F.lit("a:"), F.col("attribute"))).otherwise(F.concat(F.lit("r:"), F.coalesce("object", F.lit(""))))
    value = F.concat_ws("|", "value_text", F.col("value_num").cast("string"), "value_unit")
    rows = rows.select("rep", "verb", what.alias("what"), F.array_join(F.array_sort(other_contexts(F.col("contexts"))), "\x1f").alias("ctx"), F.col("subject").alias("name"), "negated", value.alias("value"))
    a, b = rows.alias("a"), rows.alias("b")
    keys = ["rep", "verb", "what", "ctx"]
    out = a.join(b.select(*keys, F.col("b.name").alias("name_b"), F.col("b.negated").alias("negated_b"), F.col("b.value").alias("value_b")), keys)
    differ = (F.col("negated") != F.col("negated_b")) | (F.col("what").startswith("a:") & (F.col("value") != F.col("value_b")))
    return out.where((F.col("name") < F.col("name_b")) & differ).select("rep", "verb", "what", "name", "name_b", "value", "value_b")


