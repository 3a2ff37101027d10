"""Claim values: numbers with units, trajectories, dates, confidences, tags, spans. Columns, and twins in Python for parsers."""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal
from urllib.parse import quote, unquote

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenet.functions.validtime import period

# Glued multipliers, and the forms of numbers, trajectories and dates.
MULTIPLIERS = {"T": 1e12, "B": 1e9, "M": 1e6, "K": 1e3}
NUMBER = r"^(-?\d+(?:\.\d+)?)([A-Za-z%]*)$"
UNIT = r"^[A-Za-z%$][A-Za-z0-9%$]*(?:/[A-Za-z0-9%$]+)*$"
DAY = r"(?:0[13578]|1[02])-(?:0[1-9]|[12]\d|3[01])|(?:0[469]|11)-(?:0[1-9]|[12]\d|30)|02-(?:0[1-9]|[12]\d)"
DATE = rf"^\d{{4}}-(?:{DAY}|0[1-9]|1[0-2]|Q[1-4]|H[12]|W(?:0[1-9]|[1-4]\d|5[0-3]))$"
DURATIONS = {"ms": 1.0, "s": 1000.0, "min": 60_000.0, "h": 3_600_000.0}


@dataclass(frozen=True)
class Value:
    kind: str
    text: str
    num: float | None = None
    unit: str | None = None
    approx: bool = False
    start: float | None = None
    end: float | None = None


def number(text: str) -> tuple[float, str | None] | None:
    head, _, spaced = text.strip().partition(" ")
    m = re.match(NUMBER, head, re.ASCII)
    if not m or (spaced and not re.match(UNIT, spaced.strip())):
        return None
    n, glued = float(m[1]), m[2]
    if glued in MULTIPLIERS:
        return n * MULTIPLIERS[glued], spaced.strip() or None
    if glued and spaced:
        return None
    return n, glued or spaced.strip() or None


def is_date(text: str) -> bool:
    """A day, week, month, quarter or half that the calendar has; a year alone is a number."""
    return re.match(DATE, text) is not None and period(text) is not None


def date_column(c: Column) -> Column:
    """`is_date` of a column: leap days and weeks are what the form can't tell."""
    leap = F.try_to_date(c, "yyyy-MM-dd").isNotNull() | (F.length(c) != 10)
    year = F.substring(c, 1, 4)
    # The 28th of December lies in a year's last week.
    last = F.weekofyear(F.try_to_date(F.concat(year, F.lit("-12-28")), "yyyy-MM-dd"))
    week = ~c.contains("W") | (F.substring(c, 7, 2).try_cast("int") <= last)
    return c.rlike(DATE) & (year > "0000") & leap & week


def parse_value(text: str) -> Value:
    """trajectory, number, date, text, code or atom, in this order of trial."""
    t = text.strip()
    if len(t) >= 2 and t[0] == t[-1] and t[0] in "\"`":
        return Value("text" if t[0] == '"' else "code", t)
    approx, body = t.startswith("~"), t.removeprefix("~").strip()
    if "->" in body:
        a, b = (x.strip() for x in body.split("->", 1))
        end = number(b)
        start = number(a) or (number(f"{a} {end[1]}") if end and end[1] else None)
        if start and end and (start[1] is None or start[1] == end[1]):
            return Value("trajectory", t, None, end[1], approx, start[0], end[0])
    if is_date(body) and not approx:
        return Value("date", t)
    if found := number(body):
        return Value("number", t, found[0], found[1], approx)
    return Value("atom", t)


def value_columns(text: Column) -> dict[str, Column]:
    """value_num, value_unit and value_approx of a column of single numbers; null where the text is none."""
    body = F.trim(F.regexp_replace(text, "^~", ""))
    head, spaced = F.substring_index(body, " ", 1), F.trim(F.regexp_extract(body, r"^\S+\s+(.*)$", 1))
    digits, glued = F.regexp_extract(head, NUMBER, 1), F.regexp_extract(head, NUMBER, 2)
    times = F.lit(1.0)
    for k, m in MULTIPLIERS.items():
        times = F.when(glued == k, F.lit(m)).otherwise(times)
    isolated = glued.isin(*MULTIPLIERS)
    ok = (digits != "") & ~((~isolated) & (glued != "") & (spaced != "")) & ((spaced == "") | spaced.rlike(UNIT))
    unit = F.when(isolated | (glued == ""), F.nullif(spaced, F.lit(""))).otherwise(glued)
    return {"value_num": F.when(ok, digits.try_cast("double") * times), "value_unit": F.when(ok, unit), "value_approx": F.coalesce(text.startswith("~"), F.lit(False))}


def format_number(x: float) -> str:
    """Plain decimal, never an exponent."""
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    return format(Decimal(repr(x)), "f")


def format_at(x: float, unit: str | None) -> str:
    """Four significant digits, large ones with their multiplier; a glued unit stays glued."""
    for letter, m in MULTIPLIERS.items():
        if abs(x) >= m and unit is not None and (len(unit) == 0 or unit[0].isupper()):
            return f"{significant(x / m)}{letter} {unit}".strip()
    return significant(x) + (unit or "")


def significant(x: float, digits: int = 4) -> str:
    return format_number(float(f"{x:.{digits}g}"))


def format_at_column(num: Column, text: Column, unit: Column) -> Column:
    """As `format_at`, of a column of numbers in the style of the trajectories that they come from: with multipliers if these have
    them, and the unit glued if theirs is."""
    multiplied, glued = text.rlike(r"\d[TBMK](\s|$)"), text.rlike(r"\d(?![TBMK](\s|$))[A-Za-z%]")
    scaled, letter = num, F.lit("")
    for k, m in sorted(MULTIPLIERS.items(), key=lambda x: x[1]):
        large = multiplied & (F.abs(num) >= m)
        scaled, letter = F.when(large, num / m).otherwise(scaled), F.when(large, k).otherwise(letter)
    rounded = F.format_string("%.3e", scaled).try_cast("double")  # four significant digits
    digits = F.regexp_replace(F.format_string("%.12f", rounded), r"\.?0+$", "")
    tail = F.when(unit.isNull() | (unit == ""), "").when(glued, unit).otherwise(F.concat(F.lit(" "), unit))
    return F.when(num.isNotNull(), F.concat(digits, letter, tail))


def parse_confidence(text: str) -> float | None:
    m = re.fullmatch(r"\s*(-?\d+(?:\.\d+)?)\s*%\s*", text)
    return min(1.0, max(0.0, float(m[1]) / 100)) if m else None


def round_confidence(x: float) -> float:
    """As a confidence comes back from its text of two decimals."""
    return float((Decimal(repr(x)) * 100).quantize(Decimal("0.01"), ROUND_HALF_UP) / 100)


def rounded_confidence(c: Column) -> Column:
    return F.round(c * 100, 2) / 100


def sigma(delta: Column, level: Column) -> Column:
    """The standard deviation of a delta given at a level of sigmas; null where it isn't positive."""
    s = delta / level
    return F.when(s > 0, s)


def interval(mean: Column, delta: Column) -> Column:
    """[low, high] around a mean."""
    return F.array(mean - delta, mean + delta)


def segments(c: Column) -> Column:
    """The scope segments of an entity."""
    return F.split(c, "/")


def entity_problems(c: Column) -> Column:
    """Which conventions of entity names a name breaks; none is an error."""
    parts = segments(c)
    found = F.array(F.when(F.size(parts) > 3, "more than 3 scope segments"), F.when(F.exists(parts, lambda x: x == ""), "empty scope segment"), F.when(c.rlike(r"\s"), "white space"))
    return F.when(c == "", F.array(F.lit("empty name"))).otherwise(F.array_compact(found))


def entity(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"\s+", "-")


def parse_tag(text: str) -> tuple[str, str | None]:
    key, colon, value = text.partition(":")
    return key, value if colon else None


def split_tag(c: Column) -> Column:
    parts = F.split(c, ":", 2)
    return F.struct(parts[0].alias("key"), F.when(F.size(parts) > 1, parts[1]).alias("value"))


def digest12(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 12)


def span(source: str, start: int, end: int) -> str:
    return f"src:{quote(source, safe="!'()*-._~/")}#L{start}-L{end}"


def parse_span(context: str) -> tuple[str, int, int] | None:
    m = re.fullmatch(r"src:(.+)#L(\d+)-L(\d+)", context)
    return (unquote(m[1]), int(m[2]), int(m[3])) if m and 1 <= int(m[2]) <= int(m[3]) and span(unquote(m[1]), int(m[2]), int(m[3])) == context else None


def sources(contexts: Column) -> Column:
    """(source, start, end, href) of the source contexts that are well formed, in order; lines are null where they name none, and href
    where the source is no web address."""
    def one(c: Column) -> Column:
        path = F.regexp_extract(c, r"^src:([^#]+)", 1)
        first, last = F.regexp_extract(c, r"#L([1-9]\d*)", 1), F.regexp_extract(c, r"-L([1-9]\d*)$", 1)
        name = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
        start = F.when(first != "", first.cast("int"))
        end = F.when(last != "", last.cast("int")).otherwise(start)
        web = name.rlike("(?i)^https?://") & ~name.contains("#")
        tail = F.when(start.isNull(), "").otherwise(F.concat(F.lit("#L"), start, F.lit("-L"), end))
        return F.struct(name.alias("source"), start.alias("start"), end.alias("end"), F.when(web, F.concat(F.replace(name, F.lit(" "), F.lit("%20")), tail)).alias("href"))

    formed = F.filter(contexts, lambda c: c.rlike(r"^src:[^#]+(?:#L[1-9]\d*(?:-L[1-9]\d*)?)?$"))
    return F.filter(F.transform(formed, one), lambda r: r["start"].isNull() | (r["start"] <= r["end"]))
