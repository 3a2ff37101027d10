"""The gate that counts what a change touches, against two whole checks; and what was told by fixed examples."""

import random

import pytest
from pyspark.sql import functions as F

from tenet.operators import scenario, shape, suggest
from tenet.operators.report import render
from tenet.functions.keys import tx_bound
from tenet.sources.text import annotated_table
from tenet.store import Store

BASE = """
service EXPECTS owner
service EXPECTS USES #cardinality:one
site EXPECTS PART-OF
web-service EXTENDS service
"""


def keys(df):
    return sorted((r["entity"], r["type"], r["property"], r["problem"]) for r in df.collect())


def lines(rnd, n):
    names = [f"n{i}" for i in range(12)]
    one = lambda: rnd.choice(names)
    kinds = [lambda: f"{one()} IS {rnd.choice(['service', 'web-service', 'site'])}", lambda: f"{one()} HAS owner: team{rnd.randrange(3)}", lambda: f"{one()} USES {one()}", lambda: f"{one()} CONTAINS {one()}"]
    return [f"{rnd.choice(kinds)()}{rnd.choice(['', '', ' @ 0%'])}" for _ in range(n)]


@pytest.mark.parametrize("seed,more", [(1, ""), (2, "site EXTENDS service"), (3, "site EXPECTS owner #cardinality:one"), (4, "OWNS REVERSE OWNED-BY\nservice EXPECTS OWNED-BY")])
@pytest.mark.parametrize("most", [1000, 0])
def test_touched_equals_whole(spark, monkeypatch, seed, more, most):
    monkeypatch.setattr(shape, "MOST_TOUCHED", most)
    rnd = random.Random(seed)
    before, _ = Store.empty(spark).ingest(BASE + "\n".join(lines(rnd, 30)))
    text = more + "\n" + "\n".join(lines(rnd, 4))
    after, doc = before.ingest(text)
    assert not doc.problems
    whole = shape.new_violations(shape.check(spark, before.claims, before.registry()), shape.check(spark, after.claims, after.registry()))
    want = keys(whole)
    same, found = before.gated(text)
    assert (found is None and same is not before) if not want else (same is before and keys(found) == want)


def test_few_touched_names_reach_the_scan(spark, tmp_path):
    store, _ = Store.empty(spark).ingest(BASE + "a IS service\nb IS service\nb HAS owner: team")
    store.claims.write.parquet(f"file://{tmp_path}/claims")
    claims = spark.read.schema(store.claims.schema).parquet(f"file://{tmp_path}/claims")
    change = store.claims.where("subject = 'b' and attribute is not null").withColumn("conf", F.lit(0.0)).withColumn("tx", F.lit("f"))
    assert shape.touched(spark, claims.unionByName(change), change) == ["b"]
    length = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    facts, kinds = (df._jdf.queryExecution().executedPlan().toString() for df in (shape.naming(claims, ["a", "b"], "subject", "object"), shape.instances(spark, claims, ["b"])))
    spark.conf.set("spark.sql.maxMetadataStringLength", length)
    assert "Or(In(subject, [a,b]),In(object, [a,b]))" in facts.split("PushedFilters")[1], facts
    assert "EqualTo(subject,b)" in kinds or "In(subject, [b])" in kinds, kinds
    assert keys(shape.added(spark, claims, change)) == [("b", "service", "owner", "missing")]
    assert keys(shape.added(spark, claims, change.limit(0))) == []


def test_gate_by_texts(spark):
    store, _ = Store.empty(spark).ingest("service EXPECTS owner\nsite EXPECTS USES #cardinality:one\nlegacy IS service\nweb IS site\nweb USES disk")
    same, found = store.gated("api IS service\nweb USES tape")
    assert same is store and keys(found) == [("api", "service", "owner", "missing"), ("web", "site", "USES", "too many")]
    after, none = same.gated("api IS service\napi HAS owner: team")
    assert none is None and after.claims.count() == 7


def test_suggestions_of_a_text(spark):
    text = """
acme USES disk
acme USES tape
acme HAS site: "acme.example" @src:cli
acme-corp USES tape
kubernetes IS tool
kubernetes USES disk
kubernettes IS thing
north HAS code: `zz-top-9`
zeta HAS code: `zz-top-9`
zeta IS thing
data-base IS store
database IS store2
database IS store3
alpha IS thing2
alphas IS thing3
alpha ALIAS alphas @ 0%
beta-one LINKS beta-ones
auth IS thing4
auth/middleware IS thing5
v1 IS thing6
v2 IS thing7
"""
    store, doc = Store.empty(spark).ingest(text)
    assert not doc.problems
    out = suggest.suggestions(spark, store.claims, 0.75)
    got = {r["entity"]: (r["canonical"], round(r["score"], 6), r["confidence"]) for r in out.collect()}
    mine = ("acme-corp", "kubernettes", "north", "data-base", "alphas", "alpha", "beta-one", "beta-ones", "v1", "v2", "auth", "auth/middleware")
    assert {k: v for k, v in got.items() if k in mine} == {"acme-corp": ("acme", 0.8, 0.4), "kubernettes": ("kubernetes", 0.909091, 0.45), "north": ("zeta", 0.8, 0.4), "data-base": ("database", 1.0, 0.5)}


def test_artifacts_of_tables(spark):
    none = spark.createDataFrame([], "kind string, digest string, body string")
    new = spark.createDataFrame([("run", "d1", "x"), ("run", "d1", "x"), ("run", "d2", None)], none.schema)
    a = scenario.record_all(none, new)
    assert a.count() == 2 and scenario.record_all(a, new).count() == 2 and scenario.record_all(a, none).count() == 2
    with pytest.raises(ValueError):
        scenario.record_all(a, spark.createDataFrame([("run", "d1", "y")], none.schema))
    with pytest.raises(ValueError):
        scenario.record_all(none, spark.createDataFrame([("run", "d3", "y"), ("run", "d3", "z")], none.schema))


def test_annotated_tables(spark):
    t = [tx_bound(i) for i in range(1, 5)]
    docs = [("p", f";@ {t[0]}\na IS b\n;@ {t[1]}\n  BECAUSE c IS d"), ("q", f";@ {t[0]}\na IS b\n;@ {t[2]}\ne HAS x: 5ms"), ("r", None), ("s", "")]
    store, problems = Store.empty(spark).synced_table(spark.createDataFrame(docs, "path string, text string"))
    assert problems.count() == 0 and sorted(r["id"] for r in store.claims.collect()) == t[:3]
    assert [tuple(r) for r in store.edges.collect()] == [(t[0], "BECAUSE", t[1])]
    one, none = Store.empty(spark).synced("\n".join(x[1] for x in docs[:2]))
    assert not none and sorted(map(str, one.claims.collect())) == sorted(map(str, store.claims.collect()))
    for bad, want in (((f";@ {t[0]}\na IS c",), ["told twice"]), ((f";@ {t[3]}\nx IS y\n;@ {t[3]}\nx IS z",), ["told twice"]), (("a IS b",), ["without an annotation"]), ((";@ no\na IS b",), ["time-ordered", "without an annotation"])):
        same, problems = store.synced_table(spark.createDataFrame([*docs, *[(f"bad{i}", b) for i, b in enumerate(bad)]], "path string, text string"))
        assert same is store and sorted(w for w in want for r in problems.collect() if w in r["problem"]) == sorted(want) and problems.count() == len(want)
    rows, edges, problems = annotated_table(spark, spark.createDataFrame([], "path string, text string"))
    assert rows.count() == edges.count() == problems.count() == 0


def test_splices_tell_where_they_end(spark):
    store, _ = Store.empty(spark).ingest("a USES b\na USES c\na USES d")
    assert render("{{a USES ?x}}", store.query, 2) == "b, c (the first 2)" and render("{{a USES ?x}}", store.query, 3) == "b, c, d"


def test_suggestions_as_claims_and_judgement(spark):
    found = spark.createDataFrame([("b1", "b", 0.8, "value", 0.4)], "entity string, canonical string, score double, signal string, confidence double")
    store = Store.empty(spark).add(suggest.as_claims(found))
    r = store.claims.first()
    assert (r["subject"], r["verb"], r["object"], r["conf"], r["contexts"], r["tags"][0]["key"], r["comment"]) == ("b1", "ALIAS", "b", 0.4, ["src:suggest/alias"], "suggested", "by value")
    text = suggest.judge_text(found.collect(), lambda n: [f"about {n}"])
    assert text.splitlines()[1:] == ["1. b1 / b (value, 0.80)", "   about b1", "   about b"]
    assert suggest.judged("I think [3] but no: [1, 2, 2, 7, true, 0]", 3) == [0, 1] and suggest.judged("none [oops", 3) == []
