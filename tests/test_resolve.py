"""Fusion across units and quantities, and resolution through aliases of either end."""

import pytest
from pyspark.sql import functions as F

from tenet.operators import resolve
from tenet.store import Store


def told(spark, lines):
    store, doc = Store.empty(spark, clock=lambda: 1).ingest(lines)
    assert not doc.problems, doc.problems
    return store.claims


def test_durations_fuse_in_the_first_unit(spark):
    rows = resolve.estimate_columns(told(spark, "api HAS latency: 100ms +/- 20ms @src:a\napi HAS latency: 0.2s +/- 20ms @src:b\napi HAS latency: 9s +/- 1s @src:c @ 0%"))
    out = resolve.fuse(rows, ["subject"]).first()
    assert out["unit"] == "ms" and out["n"] == 2 and abs(out["mean"] - 150) < 1e-9 and abs(out["sigma"] - 10 / 2**0.5) < 1e-9 and abs(out["precision"] - 0.02) < 1e-12
    back = resolve.fuse(rows.drop("tx"), ["subject"]).first()
    assert back["unit"] == "s" and abs(back["mean"] - 0.15) < 1e-12 and abs(back["precision"] - 20_000) < 1e-6


@pytest.mark.parametrize("lines", ["a HAS x: 1 USD +/- 1 USD @src:a\na HAS x: 1 EUR +/- 1 EUR @src:b", "a HAS x: 1ms +/- 1ms @src:a\na HAS x: 1 +/- 1 @src:b"])
def test_other_units_raise(spark, lines):
    with pytest.raises(Exception, match="different units"):
        resolve.fuse(resolve.estimate_columns(told(spark, lines)), ["subject"]).collect()


def test_sigma_is_positive(spark):
    rows = spark.createDataFrame([("q", 1.0, 0.0, "u", 1.0)], "q string, mean double, sigma double, value_unit string, conf double")
    with pytest.raises(Exception, match="positive and finite"):
        resolve.fuse(rows, ["q"]).collect()
    assert resolve.fuse(rows.withColumn("conf", F.lit(0.0)), ["q"]).count() == 0


def test_one_quantity(spark):
    claims = told(spark, "api HAS latency: 10ms +/- 2ms @src:a\ngate HAS latency: 20ms +/- 2ms @src:b\nweb HAS latency: 5ms +/- 1ms\nweb HAS size: 5 +/- 1\nweb IS site")
    reps = spark.createDataFrame([("api", "api"), ("gate", "api")], "name string, rep string")
    two = claims.where("subject in ('api', 'gate')")
    out = resolve.fuse_one(two, reps).first()
    assert out["mean"] == 15 and out["n"] == 2
    for rows, r in ((two, None), (claims.where("subject = 'web'"), reps)):
        with pytest.raises(Exception, match="several quantities"):
            resolve.fuse_one(rows, r).collect()
    assert resolve.fuse_one(claims.where("verb = 'IS'")).count() == 0
    assert resolve.fuse_one(claims.where("attribute = 'size'")).first()["unit"] is None


def test_aliases_of_both_ends_compete(spark):
    claims = told(spark, "web USES db @src:cli\nsite USES database @src:agent/a\nsite USES cache\nweb HAS owner: db\nsite HAS owner: database @src:cli")
    reps = spark.createDataFrame([("web", "site"), ("site", "site"), ("db", "database"), ("database", "database")], "name string, rep string")
    best = {(r["subject"], r["verb"], r["object"] or r["value_text"]) for r in resolve.ranked(claims, list(resolve.BUILT_IN), reps).where("rank = 1").collect()}
    assert best == {("web", "USES", "db"), ("site", "USES", "cache"), ("site", "HAS", "database")}
    assert resolve.ranked(claims, list(resolve.BUILT_IN)).where("rank = 1").count() == 5
