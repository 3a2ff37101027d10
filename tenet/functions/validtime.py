"""Valid time: periods, ranges, instants in UTC milliseconds, and time contexts as columns."""

from __future__ import annotations

import re
from datetime import UTC, date, datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY = 86_400_000
RANGE = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def ms(d: date) -> int:
    return (d - date(1970, 1, 1)).days * DAY


def month(year: int, m: int) -> int:
    return ms(date(year + (m - 1) // 12, (m - 1) % 12 + 1, 1))


def period(text: str) -> tuple[int, int] | None:
    """[start, end) of a year, quarter, half, month, ISO week or day; None for other text."""
    m = re.fullmatch(r"(\d{4})(?:-(?:(\d{2})(?:-(\d{2}))?|Q([1-4])|H([12])|W(\d{2})))?", text.strip(), re.ASCII)
    if not m or int(m[1]) < 1:
        return None
    y = int(m[1])
    try:
        if m[3]:
            start = ms(date(y, int(m[2]), int(m[3])))
            return start, start + DAY
        if m[2]:
            return (month(y, int(m[2])), month(y, int(m[2]) + 1)) if 1 <= int(m[2]) <= 12 else None
        if m[4]:
            return month(y, 3 * int(m[4]) - 2), month(y, 3 * int(m[4]) + 1)
        if m[5]:
            return month(y, 6 * int(m[5]) - 5), month(y, 6 * int(m[5]) + 1)
        if m[6]:
            start = ms(date.fromisocalendar(y, int(m[6]), 1))
            return start, start + 7 * DAY
        return month(y, 1), month(y, 13)
    except ValueError:
        return None


OPEN = (-(2**62), 2**62)


def span_of(text: str) -> tuple[int, int] | None:
    """A period, or A..B, ..B, A..; the right side may leave out what it shares with the left."""
    if ".." not in text:
        return period(text)
    left, _, right = text.partition("..")
    if left and right and not re.match(r"\d{4}", right):
        parts, own = left.split("-"), right.split("-")
        right = "-".join([*parts[: len(parts) - len(own)], *own])
    a, b = (period(left) if left else (OPEN[0], OPEN[0])), (period(right) if right else (OPEN[1], OPEN[1]))
    if not a or not b or not (left or right) or b[1] <= a[0]:
        return None
    return a[0], b[1]


def instant(text: str) -> int:
    """The start of a period, or a timestamp; without an offset it is in UTC."""
    if found := period(text):
        return found[0]
    t = datetime.fromisoformat(text.replace("Z", "+00:00"))
    t = t if t.tzinfo else t.replace(tzinfo=UTC)
    return (t - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(milliseconds=1)


@F.arrow_udf(RANGE)
def _spans(contexts: pa.Array) -> pa.Array:
    """The valid-time spans of lists of contexts. Distinct contexts are few, so each is parsed once a batch."""
    seen: dict[str, tuple[int, int] | None] = {}
    out = []
    for held in contexts.to_pylist():
        spans = []
        for c in held or ():
            if c.startswith("time:"):
                if c not in seen:
                    seen[c] = span_of(c[5:])
                if seen[c]:
                    spans.append({"start": seen[c][0], "end": seen[c][1]})
        out.append(spans)
    return pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))


def spans(contexts: Column) -> Column:
    return _spans(contexts)


def year_quarter_span(context: Column) -> Column:
    """The span of time:YYYY, time:YYYY-Qn and time:YYYY..YYYY in column expressions, null for other forms: no Python for these."""
    t = F.substring(context, 6, 32)
    first, last = F.substring(t, 1, 4).try_cast("int"), F.when(t.contains(".."), F.right(t, F.lit(4)).try_cast("int"))
    q = F.when(t.rlike(r"^\d{4}-Q[1-4]$"), F.right(t, F.lit(1)).cast("int"))

    def at(y: Column, m: Column) -> Column:
        return F.unix_date(F.make_date(y, m, F.lit(1))).cast("long") * DAY

    start = F.when(q.isNotNull(), at(first, 3 * q - 2)).otherwise(at(first, F.lit(1)))
    end = F.when(q == 4, at(first + 1, F.lit(1))).when(q.isNotNull(), at(first, 3 * q + 1)).otherwise(at(F.coalesce(last, first) + 1, F.lit(1)))
    ok = context.rlike(r"^time:\d{4}(?:-Q[1-4]|\.\.\d{4})?$")
    return F.when(ok, F.struct(start.alias("start"), end.alias("end")))


def plain_spans(contexts: Column) -> Column:
    """As `spans`, where all time contexts have the forms of `year_quarter_span`."""
    return F.filter(F.transform(contexts, year_quarter_span), lambda s: s.isNotNull())


def applies(spans_: Column, at: int) -> Column:
    """Timeless claims always apply; others where any of their spans covers the instant."""
    return (F.size(spans_) == 0) | F.exists(spans_, lambda s: (s["start"] <= at) & (F.lit(at) < s["end"]))


def interpolated(spans_: Column, start: Column, end: Column, at: int) -> Column:
    """A trajectory's value at an instant, linear over its only closed span, clamped to its ends; null without one."""
    closed = F.filter(spans_, lambda s: (s["start"] > OPEN[0]) & (s["end"] < OPEN[1]))
    s = F.get(closed, F.lit(0))
    part = (F.lit(float(at)) - s["start"]) / (s["end"] - s["start"])
    return F.when(F.size(closed) == 1, start + (end - start) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), part)))
