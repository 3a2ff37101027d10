"""Automations that settle, and streams in which each row is an event once."""

import pytest
from pyspark.sql import functions as F

from tenet.extensions import Hooks
from tenet.functions.keys import tx_bound
from tenet.operators import automate, rules
from tenet.operators.belief import current
from tenet.plans.pattern import PatternError
from tenet.schema import CLAIM
from tenet.store import Store
from tenet.streaming import feed

TWO = {"watch": "?s HAS load: ?l, ?l > 90 => action/page, hook/told", "escalate": '?s HAS state: paged, ?s IS critical => action/wake'}
ACTIONS = {"page": "?s => ?s HAS state: paged", "wake": "?s, ?s OWNED-BY ?o => ?s NEEDS ?o"}


def declared(spark, automations=TWO, actions=ACTIONS):
    store = Store.empty(spark, clock=lambda: 1000)
    store = store.add(automate.declare(spark, store.claims, automations))
    return store.add(automate.declare(spark, store.claims, actions, automate.ACTION))


def said(store, *verbs):
    rows = current(store.claims).where("conf > 0").collect()
    return sorted((r["subject"], r["attribute"] or r["verb"], r["value_text"] or r["object"]) for r in rows if r["verb"] in verbs or r["attribute"] == "state")


def test_cascade_comes_to_rest(spark):
    store = declared(spark)
    store, _ = store.ingest("db HAS load: 95\nweb HAS load: 50\ncache HAS load: 99\ndb IS critical\nops OWNS db")
    seen = []
    hooks = Hooks().on("told", lambda args, rows: seen.append(sorted(r["s"] for r in rows.collect())))
    out = automate.settle(store, hooks, derive=False, check=False)
    assert out.ok and out.fired == {"watch": 2, "escalate": 1} and seen == [["cache", "db"]]
    assert said(out.store, "NEEDS") == [("cache", "state", "paged"), ("db", "NEEDS", "ops"), ("db", "state", "paged")]
    again = automate.settle(out.store, hooks, derive=False, check=False)
    assert again.fired == {"watch": 0, "escalate": 0} and again.passes == 1 and len(seen) == 1


def test_arming_marks_and_own_echo(spark):
    store, _ = Store.empty(spark, clock=lambda: 1000).ingest("db HAS load: 95")
    store = store.add(automate.declare(spark, store.claims, {"echo": "?s HAS load: ?l => action/copy"}))
    assert automate.settle(store, derive=False, check=False).fired == {"echo": 0}  # from before its declaration
    copy = {"copy": rules.parse_action("copy", "?s => ?s HAS load: 1")}
    store, _ = store.ingest("web HAS load: 7")
    out = automate.settle(store, derive=False, check=False, actions=copy)
    assert out.fired == {"echo": 1} and out.passes == 2  # its own action's row is no event to it
    mark = rules.armed(out.store.claims, "automation/echo")
    assert mark is not None and mark > rules.declarations(out.store.claims, "automation").first()["tx"]
    assert rules.armed(out.store.claims, "automation/none") is None
    row = rules.fired(spark, "automation/echo", mark).first()
    assert (row["subject"], row["attribute"], row["value_text"]) == ("automation/echo", rules.MARK, mark)


def test_late_rows_by_ledger(spark, tmp_path):
    store = declared(spark, {"watch": "?s HAS load: ?l => hook/told"}, {})
    seen = []
    hooks = Hooks().on("told", lambda args, rows: seen.append(sorted(r["s"] for r in rows.collect())))
    ledger = automate.TableLedger(spark, f"{tmp_path}/ledger")
    late, _ = store.ingest("late HAS load: 1")
    first, _ = replace_clock(store, 9_000_000).ingest("a HAS load: 1\nb HAS load: 2")
    out = automate.settle(first, hooks, ledger=ledger, derive=False)
    assert seen == [["a", "b"]]
    merged = out.store.merge(late)
    out = automate.settle(merged, hooks, ledger=ledger, derive=False)
    assert seen == [["a", "b"], ["late"]]
    assert automate.settle(out.store, hooks, ledger=ledger, derive=False).fired == {"watch": 0}


def replace_clock(store, ms):
    from dataclasses import replace

    return replace(store, clock=lambda: ms)


def test_steps_that_fail_are_told(spark):
    store = declared(spark, {"a": "?s HAS load: _ => action/none", "b": "?s HAS load: _ => action/page, hook/bad, \"is ?s well?\"", "c": "?s HAS load: _ => action/wake"})
    bad = rules.attribute_rows(spark, [("automation/bad", "automation", "`no arrow`")])
    store, _ = store.add(bad).ingest("db HAS load: 1\nweb HAS load: 1\nops OWNS db")

    def fails(args, rows):
        raise RuntimeError("down")

    out = automate.settle(store, Hooks().on("bad", fails), lambda prompt: f'{prompt.split()[1]} IS well', derive=False, check=False)
    by = {(o.automation, o.step): o for o in out.outcomes}
    assert not out.ok and len(out.problems) == 1 and out.problems[0].startswith("automation/bad")
    assert by[("a", "action/none")].refused == 2 and by[("b", "hook/bad")].detail == "down"
    assert by[("b", "is ?s well?")].appended == 2 and by[("c", "action/wake")].refused == 1  # web has no owner
    assert {(r["subject"], r["object"]) for r in current(out.store.claims).where("verb = 'IS' and object = 'well'").collect()} == {("db", "well"), ("web", "well")}


def test_paths_as_triggers(spark):
    store = declared(spark, {"reach": "?a USES+ ?b, ?b IS risky => hook/told"}, {})
    store, _ = store.ingest("x IS fine\nc IS risky\nb USES c")
    seen = []
    hooks = Hooks().on("told", lambda args, rows: seen.append(sorted(r["a"] for r in rows.collect())))
    out = automate.settle(store, hooks, derive=False)
    out = automate.settle(out.store.ingest("a USES b")[0], hooks, derive=False)
    assert seen == [["b"], ["a"]]


def test_grammar():
    for text in ("a IS b", "?s IS b => page it", "?s IS b => action/x => hook/y", "=> hook/x"):
        with pytest.raises(PatternError):
            automate.parse_automation("x", text)
    a = automate.parse_automation("x", '?s HAS load: ?l, ?l > 3 => "say a, b => c", hook/y'.replace(" => c", ""))
    assert [s.kind for s in a.steps] == ["prompt", "hook"] and a.own == ("src:automation/x",)


def test_stream_fires_each_row_once(spark, tmp_path):
    """One file a batch, two of them late and one delivered twice."""
    path, seen = f"{tmp_path}/claims", []
    store, _ = Store.empty(spark, clock=lambda: 1_000_000).ingest("\n".join(f"e{i} USES jwt" for i in range(6)))
    rows = store.claims.select(*CLAIM.names).collect()
    act = lambda df, n: seen.append(sorted(r["x"] for r in df.collect()))
    for k, part in enumerate(([2, 3], [4], [0], [4, 5], [1])):
        spark.createDataFrame([rows[i] for i in part], CLAIM).coalesce(1).write.parquet(f"{path}/{k}")
        feed.on_events(feed.appended(spark, f"{path}/*", 1), f"{path}/*", ["?x USES jwt"], act, f"{tmp_path}/check", tx_bound(0), f"{tmp_path}/ledger").awaitTermination()
    assert sorted(x for batch in seen for x in batch) == [f"e{i}" for i in range(6)] and seen[0] == ["e2", "e3"]


def test_actions_tell_what_they_did(spark):
    store, _ = Store.empty(spark).ingest("api HAS tier: gold\napi HAS state: live @src:action/promote")
    action = rules.parse_action("promote", "?who, ?who HAS tier: ?t => ?who HAS level: ?t, ?who HAS state: live")
    seen = []
    hooks = Hooks().on("promote", lambda args, rows: seen.append(rows.count()))
    same, did = store.act(action, {"who": "api"}, hooks, dry=True)
    assert same is store and (did.appended, did.updated, did.unchanged) == (1, 0, 1) and not seen
    store, did = store.act(action, {"who": "api"}, hooks)
    assert seen == [1] and store.current().where(F.col("attribute") == "level").count() == 1
    store, did = store.act(action, {"who": "api"}, hooks)
    assert (did.appended, did.updated, did.unchanged) == (0, 0, 2) and seen == [1]
