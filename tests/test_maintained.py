"""Kept tables against what they stand for, computed anew."""

import random

import pytest
from pyspark.sql import functions as F

from tenet.functions.keys import tx_bound
from tenet.operators import belief
from tenet.operators.maintained import Beliefs, Conflict, Log, Views
from tenet.schema import CLAIM, EDGE, conform, tag


def some_rows(spark, seed, n=60):
    rnd = random.Random(seed)
    rows = [(tx_bound(seed * 1000 + i), f"s{rnd.randrange(9)}", "HAS", "x", str(i), rnd.choice([1.0, 0.5, 0.0]), rnd.choice(["public", "internal", "confidential", "restricted", None])) for i in range(n)]
    df = spark.createDataFrame(rows, "tx string, subject string, verb string, attribute string, value_text string, conf double, label string")
    return conform(df.withColumn("tags", F.when(F.col("label").isNotNull(), F.array(tag("sensitivity", F.col("label"))))).drop("label"))


def told(df):
    return sorted((tuple(map(str, r)) for r in df.collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_beliefs_under_late_and_repeated_rows(spark, tmp_path):
    table = Beliefs(spark, f"file://{tmp_path}/b", 4)
    assert table.revision() is None and table.current().count() == 0
    batches = [some_rows(spark, s) for s in (5, 3, 9, 5)]  # 3 comes late, 5 again
    everything = spark.createDataFrame([], CLAIM)
    for n, batch in enumerate(batches):
        everything = everything.unionByName(batch)
        assert table.append(batch) == n
        assert told(table.current()) == told(belief.current(everything).distinct())
    assert told(table.current(0)) == told(belief.current(batches[0]))
    assert table.named(1) == table.named(0)  # nothing that came late won
    for text in (plan(table.current()),):
        assert "Exchange" not in text and "Sort" not in text
    key = table.current().first()["claim_key"]
    assert "PartitionFilters: [isnotnull(bucket" in plan(table.of(key)) and table.of(key).count() == 1
    table.forget(1)
    assert told(table.current()) == told(belief.current(everything).distinct())
    with pytest.raises(Exception):
        table.current(0).count()


def test_null_keys_and_clashing_names(spark, tmp_path):
    table = Beliefs(spark, f"file://{tmp_path}/b", 4)
    rows = some_rows(spark, 1, 3).withColumn("claim_key", F.lit(None).cast("string")).withColumn("bucket", F.lit("mine")).withColumn("part", F.lit(1)).withColumn("was", F.lit(1))
    table.append(rows)
    table.append(rows)
    assert [r["tx"] for r in table.current().collect()] == [tx_bound(1002)] and table.current().columns == CLAIM.names


def test_writers_do_not_lose_each_other(spark, tmp_path):
    table, other = (Beliefs(spark, f"file://{tmp_path}/b", 4) for _ in range(2))
    a, b = some_rows(spark, 1), some_rows(spark, 2)
    table.append(a)

    class Slow(Beliefs):
        def change(self, make):
            def late(entry, made):
                out = make(entry, made)
                if not between:
                    between.append(other.append(b))  # comes first
                return out

            return super().change(late)

    between = []
    assert Slow(spark, table.path, 4).append(some_rows(spark, 3)) == 2 and between == [1]
    assert told(table.current()) == told(belief.current(a.unionByName(b).unionByName(some_rows(spark, 3))))
    with pytest.raises(Conflict):
        Log(spark, table.path).publish(2, {})


def test_views_are_the_scoped_projections(spark, tmp_path):
    rnd, table = random.Random(7), Views(spark, f"file://{tmp_path}/v")
    assert all(df.count() == 0 for df in table.view("restricted"))
    batches = [some_rows(spark, s, 25) for s in (2, 1, 3)]
    ids = [r["id"] for b in batches for r in b.select("id").collect()]
    rows, edges = spark.createDataFrame([], CLAIM), spark.createDataFrame([], EDGE)
    for n, batch in enumerate(batches):
        new = spark.createDataFrame([(rnd.choice(ids), "BECAUSE", rnd.choice([*ids, "nowhere", None])) for _ in range(40)], EDGE)  # many before their ends
        rows, edges = rows.unionByName(batch), edges.unionByName(new).distinct()
        assert table.append(batch.unionByName(batch.limit(3)), new.unionByName(edges.limit(5))) == n
        for ceiling in belief.SENSITIVITY:
            got, want = table.view(ceiling), belief.scoped(rows, edges, ceiling)
            assert told(got[0]) == told(want[0]) and told(got[1]) == told(want[1]), (n, ceiling)
    seen = table.view("internal")
    before = told(seen[0]), told(seen[1])
    assert all("Exchange" not in plan(df) and "rank#" in plan(df).split("PartitionFilters")[1][:60] for df in seen)
    assert table.compact() == 3
    table.forget(1)
    seen = table.view("internal")
    assert (told(seen[0]), told(seen[1])) == before and len(table.named()["rows"]) == 1
