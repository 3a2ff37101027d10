"""Queries against their SQL over tables that the given ones, being small, do not hold."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tenet import catalogue, catalogue_more  # noqa: F401  the second adds to the first


@pytest.fixture
def tables(spark, sf, tmp_path):
    """A folder of the given tables, with some of them put in place of theirs."""

    def put(**own):
        for f in os.listdir(sf):
            if f.endswith(".parquet") and f.split(".")[0] not in own:
                os.symlink(f"{sf}/{f}", f"{tmp_path}/{f}")
        for name, rows in own.items():
            rows.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return put


def same(spark, at, name):
    """The query's rows, which are those of its SQL."""
    con = duckdb.connect()
    for f in os.listdir(at):
        if f.endswith(".parquet"):
            files = f"{at}/{f}/*.parquet" if os.path.isdir(f"{at}/{f}") else f"{at}/{f}"
            con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{files}')")
    found = con.execute(catalogue.SQL[name])
    columns = [c[0] for c in found.description]
    want = sorted(map(str, found.fetchall()))
    got = sorted(str(tuple(r)) for r in catalogue.QUERIES[name](spark, at).select(*columns).collect())
    assert want and got == want
    return got


def test_disagreements_of_halves(spark, sf, tables):
    """Twice a balance may lie half way between two whole numbers."""
    rows = spark.read.parquet(f"{sf}/supplier.parquet").withColumn("s_acctbal", F.col("s_suppkey") + 0.25)
    same(spark, tables(supplier=rows), "disagreements")


def test_ids_whose_time_reads_like_a_version(spark, sf, tables):
    """Milliseconds that end in hexadecimal 7000 and 8000: only the version's and the variant's places are spoilt."""
    at = F.when(F.col("event_id") % 2 == 0, 0x018CC3EA7000).otherwise(0x018CC3EA8000)
    rows = spark.read.parquet(f"{sf}/events.parquet").where("event_id < 48").withColumn("ts", F.timestamp_millis(at).cast("timestamp_ntz"))
    assert len(same(spark, tables(events=rows), "tx_validity")) == 48


def test_a_stream_of_many_batches(spark, sf, tables):
    """More batches than versions that are kept."""
    same(spark, tables(events=spark.read.parquet(f"{sf}/events.parquet").repartition(4)), "stream_current")


def test_chains_longer_than_the_default_passes(spark, sf, tables):
    """Customers of numbers over 2^21 are more hops below the top than a derivation has passes by default."""
    rows = spark.read.parquet(f"{sf}/customer.parquet").where("c_custkey = 5")
    same(spark, tables(customer=rows.withColumn("c_custkey", F.explode(F.transform(F.sequence(F.lit(0), F.lit(22)), lambda k: F.call_function("shiftright", F.lit(5_000_000).cast("long"), k.cast("int")))))), "rule_fixpoint")


def test_a_derivation_keeps_each_conclusion_once(spark, monkeypatch):
    """Passes add parts; what is on disk is what was concluded, not a copy of it for each pass. Conclusions that grow stronger stay one."""
    from tenet.operators import rules
    from tenet.staging import owned
    from tenet.store import Store

    two = [rules.parse_rule("?a NEXT ?b => ?a AHEAD ?b"), rules.parse_rule("?a AHEAD ?b, ?b NEXT ?c => ?a AHEAD ?c")]
    store, _ = Store.empty(spark).ingest("\n".join(f"n{i} NEXT n{i + 1}" for i in range(6)) + "\nn0 NEXT n2 @ 50%\nn1 NEXT n3 @ 50%")
    with owned([]) as paths:
        got = rules.derive(spark, store.claims, two)
    kept = sum(spark.read.parquet(p).count() for p in paths if "/derived-" in p)
    assert got.complete and got.rows.count() == 8 + 15 == kept  # a claim is of one rule: the first's hops, the second's longer ways
    assert {r["conf"] for r in got.rows.where(F.array_contains("contexts", two[1].source)).collect()} == {1.0}
