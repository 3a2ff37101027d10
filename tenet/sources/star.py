"""Claim views of the star-schema and event tables: what the queries of the catalogue run on.

`events`: a belief series for each (user, event type, source): values over time, with confidences (0 retracts), polarity,
source, scope and time contexts, and tags. `star`: relations and numeric attributes of the star schema. `estimates`: uncertain
prices of parts by supplier. Each is a lazy DataFrame of source columns alone, so filters and column pruning reach the scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenet.functions.keys import uuid7
from tenet.schema import conform, tag

#: Transaction time of the star's rows: kind by kind, after this.
EPOCH = 1_700_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts: str) -> Column:
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def some(*pairs: tuple[Column, Column]) -> Column:
    """An array of the elements whose conditions hold."""
    return F.array_compact(F.array(*[F.when(cond, c) for cond, c in pairs]))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    u, n = F.col("user_id"), F.col("event_id")
    source = F.when(u % 4 == 0, "src:cli").when(u % 4 == 1, "src:agent/a1").when(u % 4 == 2, "src:rule/r1").otherwise(F.concat(F.lit("src:sensor/"), F.col("event_type")))
    second = F.when(n % 3 == 0, F.lit("src:audit")).otherwise(source)
    quarter = F.concat(F.lit("time:2024-Q"), (F.col("event_id") % 4 + 1).cast("string"))
    always = F.lit(True)
    contexts = some((always, F.when(u % 8 == 3, second).otherwise(source)), (u % 5 == 0, F.lit("scope:eu")), (u % 6 == 1, quarter), (u % 6 == 2, F.lit("time:2023..2025")))
    tags = some((u % 7 == 0, tag("sensitivity", "restricted")), (u % 7 == 1, tag("sensitivity", "public")), (n % 10 == 0, tag("flag")), (n % 10 == 5, tag("flag", "late")))
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("double")
    rows = e.select(
        uuid7(millis("ts"), n).alias("tx"),
        F.concat(F.lit("user/"), u.cast("string")).alias("subject"),
        F.lit("HAS").alias("verb"),
        (n % 11 == 0).alias("negated"),
        F.col("event_type").alias("attribute"),
        F.col("value").alias("value_num"),
        F.when(F.col("event_type") == "purchase", "USD").alias("value_unit"),
        (k / 100).alias("conf"),
        F.when(n % 2 == 0, F.col("value")).alias("traj_from"),
        F.when(n % 2 == 0, F.col("value") + u).alias("traj_to"),
        contexts.alias("contexts"),
        tags.alias("tags"),
    )
    return conform(rows)


def relation(kind: int, low: Column, subject: Column, verb: str, obj: Column) -> list[Column]:
    return [uuid7(F.lit(EPOCH + kind), low).alias("tx"), subject.alias("subject"), F.lit(verb).alias("verb"), obj.alias("object"), F.lit(None).cast("string").alias("attribute"), F.lit(None).cast("double").alias("value_num")]


def metric(kind: int, low: Column, subject: Column, attribute: str, num: Column) -> list[Column]:
    return [uuid7(F.lit(EPOCH + kind), low).alias("tx"), subject.alias("subject"), F.lit("HAS").alias("verb"), F.lit(None).cast("string").alias("object"), F.lit(attribute).alias("attribute"), num.alias("value_num")]


def name(prefix: str, c: str) -> Column:
    return F.concat(F.lit(prefix + "/"), F.regexp_replace(F.trim(F.col(c).cast("string")), r"\s+", "-"))


def star(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {x: table(spark, sf_dir, x) for x in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    nation = t["nation"].join(F.broadcast(t["region"]), F.col("n_regionkey") == F.col("r_regionkey"))  # 5 regions, fixed
    placed = lambda kind, df, key, at: df.join(F.broadcast(t["nation"]), F.col(at) == F.col("n_nationkey")).select(*relation(kind, F.col(key), name("nation", "n_name"), "CONTAINS", name("customer" if kind == 2 else "supplier", key)))  # noqa: E731  25 nations, fixed
    supplies = t["lineitem"].select("l_suppkey", "l_partkey").distinct()
    parts = [
        nation.select(*relation(1, F.col("n_nationkey"), name("region", "r_name"), "CONTAINS", name("nation", "n_name"))),
        placed(2, t["customer"], "c_custkey", "c_nationkey"),
        placed(3, t["supplier"], "s_suppkey", "s_nationkey"),
        t["orders"].select(*relation(4, F.col("o_orderkey"), name("customer", "o_custkey"), "PLACES", name("order", "o_orderkey"))),
        supplies.select(*relation(5, F.col("l_suppkey") * 10_000_000 + F.col("l_partkey"), name("supplier", "l_suppkey"), "SUPPLIES", name("part", "l_partkey"))),
        t["customer"].select(*metric(6, F.col("c_custkey"), name("customer", "c_custkey"), "account-balance", F.col("c_acctbal"))),
        t["part"].select(*metric(7, F.col("p_partkey"), name("part", "p_partkey"), "retail-price", F.col("p_retailprice"))),
        t["orders"].select(*metric(8, F.col("o_orderkey"), name("order", "o_orderkey"), "total-price", F.col("o_totalprice"))),
        # A tree with a cycle at its top: customer k reports to k/2, and customer 1 to 3.
        t["customer"].select(*relation(9, F.col("c_custkey"), name("customer", "c_custkey"), "REPORTS-TO", F.concat(F.lit("customer/"), F.when(F.col("c_custkey") == 1, F.lit(3)).otherwise(F.floor(F.col("c_custkey") / 2)).cast("string")))).where("subject <> 'customer/0'"),
        # Names of one thing: supplier k is also vendor k, and vendor k for odd k also vendor k + 1.
        t["supplier"].select(*relation(10, F.col("s_suppkey"), name("supplier", "s_suppkey"), "ALIAS", name("vendor", "s_suppkey"))),
        t["supplier"].where("s_suppkey % 2 = 1 and s_suppkey % 3 = 1").select(*relation(11, F.col("s_suppkey"), name("vendor", "s_suppkey"), "ALIAS", F.concat(F.lit("vendor/"), (F.col("s_suppkey") + 1).cast("string")))),
        t["customer"].select(*relation(12, F.col("c_custkey"), name("customer", "c_custkey"), "IS", name("segment", "c_mktsegment"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return conform(out)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of parts and suppliers that stand in one line, as items that go together."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return conform(li.select(*relation(14, F.col("l_partkey") * 10_000_000 + F.col("l_suppkey"), name("item", "l_partkey"), "GOES-WITH", name("item", "l_suppkey"))))


def estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit prices by supplier, with a delta of two sigmas; one row for each line item that has a discount."""
    li = table(spark, sf_dir, "lineitem").where("l_discount > 0")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    rows = li.select(
        uuid7(F.lit(EPOCH + 20), F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tx"),
        name("part", "l_partkey").alias("subject"),
        F.lit("HAS").alias("verb"),
        F.lit("unit-price").alias("attribute"),
        price.alias("value_num"),
        F.lit("USD").alias("value_unit"),
        (price * F.col("l_discount")).alias("delta_num"),
        (1 - F.col("l_tax")).alias("conf"),
        F.array(name("src:supplier", "l_suppkey")).alias("contexts"),
    )
    return conform(rows)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage of the event rows: each is BECAUSE of the user's event before it, by number."""
    e = table(spark, sf_dir, "events")
    own = e.select(uuid7(millis("ts"), F.col("event_id")).alias("id"), "event_id")
    before = own.select(F.col("id").alias("child_id"), (F.col("event_id") * 2 + 1).alias("event_id"))
    return own.select(F.col("id").alias("parent_id"), "event_id").join(before, "event_id").select("parent_id", F.lit("BECAUSE").alias("role"), "child_id")
