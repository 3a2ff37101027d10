"""Text with edges goes out and comes back."""

from tenet.operators import export
from tenet.store import Store

TEXT = """api USES jwt @ 90%
  WHEN env IS production
  UNLESS env IS testing
  BECAUSE audit SAYS fine @src:cli
    VIA tool
jwt IS standard
  BECAUSE audit SAYS fine @src:cli
disk HAS load: 5
  WHEN cpu > 900
db USES disk
  disk HAS size: 5 GB
"""


def text_of(store, **how):
    return "\n".join(r["line"] for r in store.text(**how).orderBy("path").collect())


def graph(store):
    keys = {r["id"]: r["claim_key"] for r in store.claims.collect()}
    return sorted((keys[e["parent_id"]], e["role"], keys[e["child_id"]]) for e in store.edges.distinct().collect())


def facts(store):
    return sorted((r["claim_key"], r["conf"], str(r["value_text"]), r["value_num"]) for r in store.current().collect())


def test_round_trip(spark):
    store, doc = Store.empty(spark).ingest(TEXT)
    assert not doc.problems and store.edges.count() == 7
    again, doc = Store.empty(spark).ingest(text_of(store))
    assert not doc.problems and facts(again) == facts(store) and graph(again) == graph(store)
    synced, problems = Store.empty(spark).synced(text_of(store, current=False, with_tx=True))
    assert not problems and sorted(map(tuple, synced.edges.collect())) == sorted(map(tuple, store.edges.distinct().collect()))
    assert sorted(r["id"] for r in synced.claims.collect()) == sorted(r["id"] for r in store.claims.collect())


def test_edges_follow_the_current_rows(spark):
    store, _ = Store.empty(spark).ingest("api USES jwt @ 90%\n  WHEN env IS production")
    store, _ = store.ingest("api USES jwt @ 70%")
    assert text_of(store).splitlines() == ["api USES jwt @ 70%", "  WHEN env IS production"]


def test_shared_rows_and_cycles(spark):
    edges = spark.createDataFrame([("a", "BECAUSE", "s"), ("b", "BECAUSE", "s"), ("s", "VIA", "t"), ("x", "BECAUSE", "y"), ("y", "BECAUSE", "z"), ("z", "BECAUSE", "x")], "parent string, role string, child string")
    told = spark.createDataFrame([(c,) for c in "abstxyz"], "id string")
    got = [(r["id"], r["role"], r["depth"]) for r in export.forest(spark, told, edges).orderBy("path").collect()]
    assert got == [("a", None, 0), ("s", "BECAUSE", 1), ("t", "VIA", 2), ("b", None, 0), ("s", "BECAUSE", 1), ("x", None, 0), ("y", "BECAUSE", 1), ("z", "BECAUSE", 2), ("x", "BECAUSE", 3)]
    assert export.forest(spark, told.limit(0), edges.limit(0)).count() == 0


def test_secret_ends_are_left_out(spark):
    store, _ = Store.empty(spark).ingest("api USES jwt\n  BECAUSE key IS leaked #sensitivity:restricted\n  WHEN env IS production")
    assert text_of(store).splitlines() == ["api USES jwt", "  WHEN env IS production"]
