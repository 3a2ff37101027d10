"""Scenarios: inputs bound from claims at a snapshot, with overlays and policies, in exact rationals; immutable artifacts.

Inputs are few and collected; what they are bound from is filtered and reduced to distinct exact values before that.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenet.functions.values import DURATIONS
from tenet.operators.belief import as_of, snapshot
from tenet.plans.query import Options, query
from tenet.schema import conform

POLICIES = ("one", "all", "min", "max", "sum")
#: Values of one input at most; more is no scenario input.
MOST = 10_000


@dataclass(frozen=True)
class Input:
    """name: a pattern whose rows' values are bound by a policy, in a unit; a default where there are none."""

    name: str
    pattern: str
    policy: str = "one"
    unit: str | None = None
    default: str | None = None


@dataclass(frozen=True)
class Bound:
    snapshot: str | None
    values: dict[str, Fraction | list[Fraction]]
    rows: dict[str, list[str]]
    digest: str


def exact(text: str) -> Fraction:
    """A decimal as it is written; it never passes through a double."""
    return Fraction(text)


def converted(value: Fraction, unit: str | None, to: str | None) -> Fraction:
    if unit == to or to is None:
        return value
    if unit in DURATIONS and to in DURATIONS:
        return value * Fraction(DURATIONS[unit]) / Fraction(DURATIONS[to])
    raise ValueError(f"{unit} does not convert to {to}")


def bind(spark: SparkSession, claims: DataFrame, inputs: Sequence[Input], at: str | None = None, overlay: DataFrame | None = None) -> Bound:
    """Values of all inputs at one snapshot. Overlay rows count as later than all others; nothing is stored."""
    bound = at or snapshot(claims)
    seen = as_of(claims, bound)
    if overlay is not None:
        seen = seen.unionByName(conform(overlay.withColumn("tx", F.concat(F.lit("f"), F.sha2(F.to_json(F.struct(*overlay.columns)), 256)))))
    values: dict[str, Fraction | list[Fraction]] = {}
    rows: dict[str, list[str]] = {}
    for i in inputs:
        if i.policy not in POLICIES:
            raise ValueError(f"no policy {i.policy}")
        text = F.coalesce(F.regexp_extract("row_value_text", r"^~?(-?\d+(?:\.\d+)?)", 1), F.lit(""))
        found = query(spark, seen, i.pattern, Options()).select("row_id", F.when(text != "", text).otherwise(F.col("row_value_num").cast("string")).alias("v"), "row_value_num", "row_value_unit").orderBy("row_id").limit(MOST + 1).collect()
        if len(found) > MOST:
            raise ValueError(f"{i.name} has more than {MOST} values")
        got = [converted(as_written(r["v"], r["row_value_num"]), r["row_value_unit"], i.unit) for r in found]
        rows[i.name] = [r["row_id"] for r in found]
        if not got:
            if i.default is None:
                raise ValueError(f"{i.name} has no value")
            got = [exact(i.default)]
        if i.policy == "one" and len(set(got)) > 1:
            raise ValueError(f"{i.name} has {len(got)} values")
        values[i.name] = {"one": lambda g: g[0], "all": list, "min": min, "max": max, "sum": sum}[i.policy](got)
    said = json.dumps([bound, {k: [str(x) for x in v] if isinstance(v, list) else str(v) for k, v in sorted(values.items())}])
    return Bound(bound, values, rows, hashlib.sha256(said.encode()).hexdigest())


def as_written(text: str, num: float) -> Fraction:
    """The exact written decimal where it is the number itself; a multiplier (900M) makes it the number's own value."""
    written = exact(text)
    return written if float(written) == num else Fraction(num)


def record(artifacts: DataFrame, kind: str, digest: str, body: str) -> DataFrame:
    """artifacts (kind, digest, body) with one more; the same one again changes nothing, another body under its digest raises."""
    same = artifacts.where((F.col("kind") == kind) & (F.col("digest") == digest)).select("body").limit(1).collect()
    if same and same[0][0] != body:
        raise ValueError(f"{kind} {digest} is recorded with another body")
    return artifacts if same else artifacts.unionByName(artifacts.sparkSession.createDataFrame([(kind, digest, body)], "kind string, digest string, body string"))


def record_all(artifacts: DataFrame, new: DataFrame) -> DataFrame:
    """As `record`, for a table of new artifacts: those recorded already are left out; another body under a digest, among the new ones
    or against the recorded, raises."""
    keys, new = ["kind", "digest"], new.select("kind", "digest", "body").distinct()
    both = artifacts.select("kind", "digest", "body").unionByName(new)
    clash = both.groupBy(*keys).agg(F.min("body").alias("a"), F.max("body").alias("b")).where("a <> b").limit(1).collect()
    if clash:
        raise ValueError(f"{clash[0]['kind']} {clash[0]['digest']} is recorded with another body")
    return artifacts.unionByName(new.join(artifacts.select(*keys), keys, "left_anti").select(*artifacts.columns))
