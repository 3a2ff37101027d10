"""From a pattern and options to a DataFrame: every rewrite is made before the plan exists, the rest is Catalyst's.

Results have one column for each variable, then (unless bindings_only) the row's columns under `row_`, and `at_num` where a
valid-time instant interpolates a trajectory.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenet.functions import validtime
from tenet.functions.keys import UUID7, tx_bound
from tenet.functions.values import DATE, format_at_column, number, parse_confidence
from tenet.operators import closure as graph
from tenet.operators.belief import as_of, current, supported
from tenet.operators.registry import Registry
from tenet.operators.resolve import Entry, winners
from tenet.plans.pattern import Filter, Pattern, PatternError, is_free, is_variable, parse


@dataclass(frozen=True)
class Options:
    """all: every row, not the current ones. as_of: a transaction instant (text, milliseconds or an id), up to and with it. at: a
    valid-time instant. resolve: only winners, under a policy. aliases: names match through alias components. ordered: by tx, and
    transitive pairs by their ends; limit and offset read a part of that order. support: transitive solutions with the ids of the
    edge rows on any path between their ends. driver_edges: closures of at most so many edges are walked on the driver."""

    all: bool = False
    as_of: str | int | None = None
    at: str | None = None
    resolve: bool = False
    policy: tuple[Entry, ...] = ()
    aliases: bool = False
    bindings_only: bool = False
    plain_times: bool = False
    ordered: bool = False
    limit: int | None = None
    offset: int = 0
    support: bool = False
    driver_edges: int = graph.DRIVER_EDGES
    registry: Registry = field(default_factory=Registry)


OPS = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def bound_of(as_of_: str | int | None) -> str | None:
    """The id up to which rows are known: that of the first millisecond after the instant or period."""
    if as_of_ is None:
        return None
    if isinstance(as_of_, int):
        return tx_bound(as_of_ + 1)
    if re.fullmatch(UUID7, as_of_):
        return as_of_ + "!"  # the least text after the id
    period = validtime.period(as_of_)
    return tx_bound(period[1] if period else validtime.instant(as_of_) + 1)


def query(spark: SparkSession, claims: DataFrame, text: str | Pattern, options: Options | None = None) -> DataFrame:
    o = options or Options()
    if o.resolve and o.all:
        raise PatternError("resolve reads current beliefs; it excludes all")
    p = rewritten(parse(text) if isinstance(text, str) else text, o.registry)
    if p.transitive:
        if o.at is not None:
            raise PatternError("a transitive pattern has no valid time")
        return transitive(spark, claims, p, o)
    rows = universe(claims, p, o).where(matches(p))
    reps = graph.representatives(spark, as_of(claims, bound_of(o.as_of), False)) if o.aliases else None
    rows = ends(rows, p, reps)
    rows = filtered(rows, p)
    if o.at is not None:
        instant = validtime.instant(o.at)
        spans = validtime.plain_spans(F.col("contexts")) if o.plain_times else validtime.spans(F.col("contexts"))
        rows = rows.withColumn("__spans", spans).where(validtime.applies(F.col("__spans"), instant))
        rows = rows.withColumn("at_num", validtime.interpolated(F.col("__spans"), F.col("traj_from"), F.col("traj_to"), instant)).drop("__spans")
    return part(bound_columns(rows, p, o, claims.columns), o, ["row_tx"])


def part(rows: DataFrame, o: Options, order: list[str]) -> DataFrame:
    """The rows in order, or the part of them that limit and offset name."""
    if not (o.ordered or o.limit is not None or o.offset):
        return rows
    if missing := [c for c in order if c not in rows.columns]:
        raise PatternError(f"an order needs {missing}; it excludes bindings_only")
    rows = rows.orderBy(*order)
    rows = rows.offset(o.offset) if o.offset else rows
    return rows if o.limit is None else rows.limit(o.limit)


def rewritten(p: Pattern, registry: Registry) -> Pattern:
    """Renamed verbs to the stored spelling; an inverse verb to its primary one, with the ends swapped."""
    if is_free(p.verb):
        return p
    verb = registry.stored(p.verb)
    if primary := registry.primary(verb):
        if p.attribute is not None:
            raise PatternError(f"{p.verb} is an inverse verb: it has no attributes")
        return replace(p, verb=primary, subject=p.obj or "_", obj=p.subject)
    return replace(p, verb=verb)


def universe(claims: DataFrame, p: Pattern, o: Options) -> DataFrame:
    """The rows that a pattern may match. What a claim key fixes (subject, verb, attribute, polarity of the payload) is
    filtered before the latest rows are found; nothing else may be."""
    rows = as_of(claims, bound_of(o.as_of), False)
    if not is_free(p.verb):
        rows = rows.where(F.col("verb") == p.verb)
    if p.attribute is not None:
        rows = rows.where(F.col("attribute") == p.attribute)
    if o.all:
        return rows
    if o.resolve:
        return winners(rows, list(o.policy))
    if not is_free(p.subject) and not o.aliases:
        rows = rows.where(F.col("subject") == p.subject)
    return current(rows.where(F.col("negated") == p.negated))


def matches(p: Pattern) -> Column:
    c = F.col("negated") == p.negated
    if not is_free(p.verb):
        c &= F.col("verb") == p.verb
    if p.attribute is not None:
        c &= F.col("attribute") == p.attribute
        if not is_free(p.value):
            c &= exact(p.value)
        else:
            c &= F.col("value_text").isNotNull() | F.col("value_num").isNotNull()
    elif p.obj is not None:
        if is_free(p.obj):
            c &= F.col("object").isNotNull()
        elif is_value(p.obj):
            c &= (F.col("object") == p.obj) | (F.col("object").isNull() & (F.col("value_text") == p.obj))
    for ctx in p.contexts:
        c &= F.array_contains("contexts", ctx)
    for k, v in p.tags:
        c &= tagged(k, v)
    return c


def is_value(term: str) -> bool:
    """A number or a date: as an object it also names rows that have it as their value."""
    return number(term) is not None or re.match(DATE, term) is not None


def tagged(key: str, value: str | None) -> Column:
    """A flat tag for no value, else the tag with exactly this one."""
    return F.exists("tags", lambda t: (t["key"] == key) & (t["value"].isNull() if value is None else t["value"] == value))


def exact(value: str) -> Column:
    """A number in any spelling, of exactly this unit (or none); other values as text."""
    if found := number(value.removeprefix("~")):
        n, unit = found
        return (F.col("value_num") == n) & F.col("value_unit").eqNullSafe(F.lit(unit).cast("string")) & (F.col("value_approx") == value.startswith("~"))
    return F.col("value_text") == value


def ends(rows: DataFrame, p: Pattern, reps: DataFrame | None) -> DataFrame:
    """Fixed and repeated ends; under aliases by representatives, so equality stays an equality."""
    slots = [("subject", p.subject)] + ([("object", p.obj)] if p.obj is not None and not is_value(p.obj) else [])
    for column, slot in slots:
        if not is_free(slot) and reps is None:
            rows = rows.where(F.col(column) == slot)
    if reps is not None:
        for column, slot in slots:
            r = reps.select(F.col("name").alias(f"__{column}"), F.col("rep").alias(f"__rep_{column}"))
            rows = rows.join(r, rows[column] == r[f"__{column}"], "left").drop(f"__{column}")
            rows = rows.withColumn(f"__rep_{column}", F.coalesce(f"__rep_{column}", column))
            if not is_free(slot):
                me = reps.where(F.col("name") == slot).select("rep").limit(1).collect()
                rows = rows.where(F.col(f"__rep_{column}") == (me[0][0] if me else slot))
    if p.obj is not None and is_variable(p.subject) and p.subject == p.obj:
        a, b = ("subject", "object") if reps is None else ("__rep_subject", "__rep_object")
        rows = rows.where(F.col(a) == F.col(b))
    return rows


def filtered(rows: DataFrame, p: Pattern) -> DataFrame:
    if not any(f.what == "conf" for f in p.filters):
        rows = rows.where(F.col("conf") > 0)
    for f in p.filters:
        rows = rows.where(condition(f))
    return rows


def condition(f: Filter) -> Column:
    op = OPS[f.op]
    if f.what == "conf":
        share = parse_confidence(f.operand)
        return op(F.col("conf"), F.lit(float(f.operand) if share is None else share))
    if f.what == "value":
        found = number(f.operand)
        if not found:
            raise PatternError(f"not a number: {f.operand}")
        n, unit = found
        same = op(F.col("value_num"), F.lit(n))
        return same if unit is None else same & (F.col("value_unit") == unit)
    if f.what == "tag":
        k, _, v = f.operand.lstrip("#").partition(":")
        return F.exists("tags", lambda t: (t["key"] == k) & (t["value"] == v)) if v else F.exists("tags", lambda t: t["key"] == k)
    if f.what == "context":
        return F.array_contains("contexts", f.operand.lstrip("@"))
    return tx_condition(f)


def tx_condition(f: Filter) -> Column:
    """A period, or a second, as [low, high) over ids."""
    period = validtime.period(f.operand)
    start = period[0] if period else validtime.instant(f.operand)
    low, high, tx = tx_bound(start), tx_bound(period[1] if period else start + 1000), F.col("tx")
    return {"=": (tx >= low) & (tx < high), "!=": (tx < low) | (tx >= high), "<": tx < low, "<=": tx < high, ">": tx >= high, ">=": tx >= low}[f.op]


def bound_columns(rows: DataFrame, p: Pattern, o: Options, columns: list[str]) -> DataFrame:
    value = F.coalesce("value_text", F.col("value_num").cast("string"))
    if o.at is not None:  # an interpolated value stands for the trajectory
        value = F.coalesce(format_at_column(F.col("at_num"), F.col("value_text"), F.col("value_unit")), value)
    places = [(p.subject, F.col("subject")), (p.verb, F.col("verb")), (p.obj, F.col("object")), (p.value, value)]
    out, seen = [], set()
    for slot, c in places:
        if slot and is_variable(slot) and slot not in seen:
            seen.add(slot)
            out.append(c.alias(slot[1:]))
    if not o.bindings_only:
        out += [F.col(c).alias(f"row_{c}") for c in columns]
    if o.at is not None:
        out.append(F.col("at_num"))
    return rows.select(*out) if out else rows.select(F.col("tx").alias("row_tx"))


def transitive(spark: SparkSession, claims: DataFrame, p: Pattern, o: Options) -> DataFrame:
    """src and dst under the variables' names. A fixed end seeds the walk; closures read current beliefs even under `all`. Under aliases
    the walk is among representatives, and its ends are told by the names that edges have there."""
    seen = as_of(claims, bound_of(o.as_of), False)
    stored = edges = graph.edges_of_verb(seen, p.verb)
    src, dst, reps = p.subject, p.obj, None
    if o.aliases:
        reps = graph.representatives(spark, seen, driver_edges=o.driver_edges)
        edges = graph.through_aliases(spark, edges, reps)
        stand = lambda s: s if is_free(s) else next((r[0] for r in reps.where(F.col("name") == s).select("rep").limit(1).collect()), s)
        src, dst = stand(src), stand(dst)
    if not is_free(src):
        pairs = graph.closure(spark, edges, [src], driver_edges=o.driver_edges)
    elif not is_free(dst):
        pairs = graph.closure(spark, edges, [dst], backwards=True, driver_edges=o.driver_edges)
    else:
        pairs = graph.closure(spark, edges, driver_edges=o.driver_edges)
    reached = pairs
    if not is_free(src) and not is_free(dst):
        pairs = pairs.where(F.col("dst") == dst)
    if is_variable(p.subject) and p.subject == p.obj:
        pairs = pairs.where("src = dst")
    out = []
    if is_variable(p.subject):
        out.append(F.col("src").alias(p.subject[1:]))
    if is_variable(p.obj) and p.obj != p.subject:
        out.append(F.col("dst").alias(p.obj[1:]))
    if o.support:
        if reps is not None:
            raise PatternError("support of closures is of the names as they stand: it excludes aliases")
        rows = supported(current(seen.where((F.col("verb") == p.verb) & F.col("object").isNotNull())))
        ids = rows.select(F.col("subject").alias("edge_src"), F.col("object").alias("edge_dst"), "id")
        near = graph.written(spark, graph.within(edges, reached), "support")  # a path's edges join nodes that the walk has reached
        found = graph.support(graph.closure(spark, near, driver_edges=o.driver_edges), near, pairs).join(ids, ["edge_src", "edge_dst"])
        pairs = found.groupBy("src", "dst").agg(F.array_sort(F.collect_set("id")).alias("support"))
        return part(pairs.select(*out, "support") if out else pairs, o, [n[1:] for n in dict.fromkeys((p.subject, p.obj)) if is_variable(n)])
    if reps is not None and out:
        names = pairs.select("src", "dst")
        pairs = graph.expanded(names, stored, reps)
    found = pairs.select(*out).distinct() if out else pairs
    return part(found, o, found.columns)


def joined(spark: SparkSession, claims: DataFrame, premises: list[str | Pattern], options: Options | None = None, each: dict[int, DataFrame] | None = None, only: dict[int, Column] | None = None, among: dict[int, DataFrame] | None = None, start: DataFrame | None = None) -> DataFrame:
    """Bindings of several patterns at once: each a DataFrame, joined on the variables they share. The rows' ids and
    confidences are carried as arrays, in the order in which premises join; transitive premises add no confidence, and ids of their
    edges under `support` alone. `each` gives some premises claims of their own, `only` a condition on the rows (row_ columns) that they
    match, `among` the ids (row_id) of the only rows that they may. `start` has bindings to begin with: premises join them in the order in which they share variables."""
    o = replace(options or Options(), bindings_only=False)
    out, left = start, list(enumerate(premises))
    if start is not None:
        out = start.distinct().withColumns({"ids": F.array().cast("array<string>"), "confs": F.array().cast("array<double>")})
    while left:
        near = [k for k in left if out is None or set(parsed(k[1]).variables) & set(out.columns)]
        if not near:
            raise PatternError("premises share no variable: their product is not a join")
        i, text = near[0] if start is not None else left[0]
        left.remove((i, text))
        p = parsed(text)
        rows = query(spark, (each or {}).get(i, claims), p, o)
        if only and i in only:
            rows = rows.where(only[i])
        if among and i in among and not p.transitive:
            rows = rows.join(among[i].select("row_id"), "row_id", "left_semi")
        if p.transitive:
            ids = F.col("support") if o.support else F.array().cast("array<string>")
            rows = rows.select(*p.variables, ids.alias("ids"), F.array().cast("array<double>").alias("confs"))
        else:
            rows = rows.select(*p.variables, F.array("row_id").alias("ids"), F.array("row_conf").alias("confs"))
        if out is None:
            out = rows
            continue
        shared = [v for v in p.variables if v in out.columns]
        right = rows.withColumnsRenamed({"ids": "__ids", "confs": "__confs"})
        if not shared:
            raise PatternError("premises share no variable: their product is not a join")
        out = out.join(right, shared)
        out = out.withColumns({"ids": F.concat("ids", "__ids"), "confs": F.concat("confs", "__confs")}).drop("__ids", "__confs")
    return out


def parsed(p: str | Pattern) -> Pattern:
    return parse(p) if isinstance(p, str) else p
