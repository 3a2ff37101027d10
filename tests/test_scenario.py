"""Scenario inputs are exact, bound to a snapshot, and overlays are not stored."""

from fractions import Fraction

import pytest

from tenet.operators.scenario import Input, bind, record
from tenet.store import Store


def test_bind(spark):
    s, _ = Store.empty(spark, clock=lambda: 1).ingest("a HAS cost: 0.1\nb HAS cost: 0.2\nc HAS wait: 1500ms\nd HAS users: 900M")
    inputs = [Input("total", "?x HAS cost: _", "sum"), Input("wait", "c HAS wait: _", unit="s"), Input("users", "d HAS users: _"), Input("none", "z HAS cost: _", default="7")]
    got = bind(spark, s.claims, inputs)
    assert got.values == {"total": Fraction(3, 10), "wait": Fraction(3, 2), "users": Fraction(900_000_000), "none": Fraction(7)}
    later, _ = s.ingest("a HAS cost: 5")
    assert bind(spark, later.claims, inputs, at=got.snapshot).digest == got.digest
    over = spark.createDataFrame([("a", "HAS", "cost", "3", 3.0)], "subject string, verb string, attribute string, value_text string, value_num double")
    assert bind(spark, s.claims, inputs, overlay=over).values["total"] == Fraction(16, 5)
    with pytest.raises(ValueError):
        bind(spark, s.claims, [Input("x", "?x HAS cost: _")])
    empty = spark.createDataFrame([], "kind string, digest string, body string")
    one = record(empty, "bound", got.digest, "x")
    assert record(one, "bound", got.digest, "x").count() == 1
    with pytest.raises(ValueError):
        record(one, "bound", got.digest, "y")
