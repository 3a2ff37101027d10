"""Presentation of results on the driver: reports from templates, typed clients, lineage trees, query expectations."""

from __future__ import annotations

import hashlib
import keyword
import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from tenet.operators.closure import lineage
from tenet.operators.shape import expectations

#: Rows of a query block, by default.
ROWS = 50


def render(template: str, ask: Callable[[str], DataFrame], rows: int = ROWS) -> str:
    """Replace ```query blocks by tables, and {{pattern}} by the first variable's values: at most `rows` of each, and where there are more
    they say so."""

    def table(m: re.Match) -> str:
        df = ask(m[1])
        names = [c for c in df.columns if not c.startswith("row_")]
        found = df.select(*names).distinct().orderBy(*names).limit(rows + 1).collect()
        lines = ["| " + " | ".join(names) + " |", "|" + "-|" * len(names), *["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in found[:rows]]]
        return "\n".join([*lines, *([f"(the first {rows})"] if len(found) > rows else [])])

    def splice(m: re.Match) -> str:
        df = ask(m[1])
        found = df.select(df.columns[0]).distinct().orderBy(df.columns[0]).limit(rows + 1).collect()
        return ", ".join(str(r[0]) for r in found[:rows]) + (f" (the first {rows})" if len(found) > rows else "")

    out = re.sub(r"```query\n(.*?)```", table, template, flags=re.S)
    return re.sub(r"\{\{(.+?)\}\}", splice, out)


def client(claims: DataFrame) -> tuple[str, str]:
    """(source, sha256) of a Python module with a dataclass for each type that has expectations; the same for the same claims."""
    by_type: dict[str, list] = {}
    for r in expectations(claims).orderBy("type", "property").collect():
        by_type.setdefault(r["type"], []).append(r)
    lines = ["from dataclasses import dataclass", ""]
    for kind, props in sorted(by_type.items()):
        lines += ["", "@dataclass", f"class {camel(kind)}:", "    name: str"]
        for p in props:
            t = "str" if p["kind"] == "relation" or not p["unit"] else "float"
            lines.append(f"    {snake(p['property'])}: {t if p['cardinality'] == 'one' else f'list[{t}]'}")
    source = "\n".join(lines) + "\n"
    return source, hashlib.sha256(source.encode()).hexdigest()


def camel(s: str) -> str:
    out = "".join(p[:1].upper() + p[1:] for p in re.split(r"[^A-Za-z0-9]+", s))
    return out if out[:1].isalpha() else "T" + out


def snake(s: str) -> str:
    out = re.sub(r"[^a-z0-9]+", "_", s.lower()).strip("_")
    return f"{out}_" if keyword.iskeyword(out) or not out[:1].isalpha() else out


def lineage_tree(spark: SparkSession, claims: DataFrame, edges: DataFrame, root: str, depth: int = 16, up: bool = False) -> dict:
    """A nested tree of what a row rests on; rows seen on the way are marked, and the depth cap says where it cut."""
    reach = lineage(spark, edges, [root], depth + 1, up).select("id").distinct()
    a, b = ("child_id", "parent_id") if up else ("parent_id", "child_id")
    near: dict[str, list] = {}
    for r in edges.join(reach, edges[a] == reach["id"], "left_semi").select(a, "role", b).orderBy("role", b).collect():
        near.setdefault(r[a], []).append((r["role"], r[b]))

    def node(i: str, seen: tuple[str, ...]) -> dict:
        if i in seen:
            return {"id": i, "repeated": True}
        if len(seen) >= depth:
            return {"id": i, "truncated": bool(near.get(i))}
        return {"id": i, "children": [{"role": role, **node(c, (*seen, i))} for role, c in near.get(i, ())]}

    return node(root, ())


def parse_expectations(text: str) -> list[tuple[str, list[dict[str, str]] | None]]:
    """Query expectations: an unindented pattern, WHERE lines, then indented `?var = value` lines (one solution each, several
    separated by commas), `none`, or nothing (at least one solution: None)."""
    out: list[tuple[str, list | None]] = []
    for line in text.splitlines():
        if not line.strip() or line.strip().startswith(";"):
            continue
        if line[0].isspace() and out:
            query, found = out[-1]
            if line.strip() == "none":
                out[-1] = (query, [])
            else:
                pairs = dict(tuple(x.strip() for x in p.split("=", 1)) for p in line.split(","))
                out[-1] = (query, [*(found or []), {k.lstrip("?"): v for k, v in pairs.items()}])
        elif line.startswith("WHERE") and out:
            out[-1] = (out[-1][0] + "\n" + line, out[-1][1])
        else:
            out.append((line, None))
    return out


def failures(expected: Iterable[tuple[str, list[dict[str, str]] | None]], ask: Callable[[str], DataFrame]) -> list[str]:
    """What a store answers differently."""
    out = []
    for text, want in expected:
        df = ask(text)
        names = [c for c in df.columns if not c.startswith("row_")]
        got = {tuple(sorted(r.asDict().items())) for r in df.select(*names).distinct().collect()}
        if want is None:
            out += [] if got else [f"{text}: no solution"]
        elif got != {tuple(sorted(w.items())) for w in want}:
            out.append(f"{text}: {sorted(got)}")
    return out
