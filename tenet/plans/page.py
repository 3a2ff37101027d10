"""Paged reads of a pattern: each page is a range of transaction ids below one frozen snapshot.

A cursor says which query, options and limit it belongs to, the snapshot that the first page fixed, and the last id that was seen.
Rows appended between two pages are later than the snapshot, so they never shift one. Pages read by key, not by offset: what
lies before a page is pruned at the scan.
"""

from __future__ import annotations

import hashlib
import json
from base64 import urlsafe_b64decode, urlsafe_b64encode
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tenet.operators.belief import as_of, snapshot
from tenet.plans.pattern import PatternError, parse
from tenet.plans.query import Options, bound_of, query

DEFAULT, MOST = 100, 1000


@dataclass(frozen=True)
class Page:
    """rows in order of tx; next is the cursor of the page after it, None on the last one."""

    snapshot: str | None
    rows: list[Row]
    next: str | None


def fingerprint(text: str, options: Options, limit: int) -> str:
    """What a cursor is bound to: the query, everything that changes its rows, and the page's size."""
    plain = asdict(replace(options, limit=None, offset=0, ordered=False))
    return hashlib.sha256(json.dumps([text, limit, plain], sort_keys=True, default=str).encode()).hexdigest()[:16]


def cursor(print_: str, frozen: str, after: str) -> str:
    return urlsafe_b64encode(json.dumps([1, print_, frozen, after]).encode()).decode()


def opened(text: str, expected: str) -> tuple[str, str]:
    """(snapshot, last id seen) of a cursor, if it belongs to this query."""
    try:
        version, print_, frozen, after = json.loads(urlsafe_b64decode(text.encode()))
    except ValueError as e:
        raise PatternError("not a cursor") from e
    if version != 1 or print_ != expected:
        raise PatternError("the cursor belongs to another query, or to other options")
    return frozen, after


def page_rows(spark: SparkSession, claims: DataFrame, text: str, options: Options, frozen: str, after: str | None, limit: int) -> DataFrame:
    """At most limit + 1 rows after an id, in order, of what was known at the snapshot."""
    rows = query(spark, as_of(claims, frozen), text, replace(options, as_of=None, limit=None, offset=0, ordered=False))
    rows = rows if after is None else rows.where(F.col("row_tx") > after)
    return rows.orderBy("row_tx").limit(limit + 1)


def page(spark: SparkSession, claims: DataFrame, text: str, options: Options | None = None, limit: int = DEFAULT, after: str | None = None) -> Page:
    """One page; `after` is the cursor of the page before it."""
    o = options or Options()
    if not 1 <= limit <= MOST:
        raise PatternError(f"a page has 1 to {MOST} rows")
    if o.bindings_only or parse(text).transitive:
        raise PatternError("pages are of rows: of no closures, and not of bindings alone")
    expected = fingerprint(text, o, limit)
    if after is None:
        frozen, last = snapshot(as_of(claims, bound_of(o.as_of), False)), None
    else:
        frozen, last = opened(after, expected)
    if frozen is None:
        return Page(None, [], None)
    found = page_rows(spark, claims, text, o, frozen, last, limit).collect()  # limit + 1 rows
    more = len(found) > limit
    return Page(frozen, found[:limit], cursor(expected, frozen, found[limit - 1]["row_tx"]) if more else None)
