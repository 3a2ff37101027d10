"""The engine's operators as queries over the driver's tables, each with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenet.functions import keys, validtime
from tenet.operators import belief, closure, resolve, rules, shape
from tenet.operators.registry import Registry
from tenet.operators.resolve import Entry
from tenet.plans.query import Options, joined, query
from tenet.schema import conform
from tenet.sources import star

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The event claims and the star claims in SQL.
EVENTS = """
ev as (
  select *, case user_id % 4 when 0 then 'src:cli' when 1 then 'src:agent/a1' when 2 then 'src:rule/r1' else 'src:sensor/' || event_type end as s1 from events),
c as (
  select printf('%s-%s-7000-8000-%s', substr(printf('%012x', epoch_us(ts) // 1000), 1, 8), substr(printf('%012x', epoch_us(ts) // 1000), 9, 4), printf('%012x', event_id)) as tx,
    'user/' || user_id as subject, 'HAS' as verb, event_id % 11 = 0 as negated, event_type as attribute, value as value_num,
    case when event_type = 'purchase' then 'USD' end as value_unit, regexp_extract(props, '([0-9]+)', 1)::double / 100 as conf,
    case when event_id % 2 = 0 then value end as traj_from, case when event_id % 2 = 0 then value + user_id end as traj_to,
    list_filter([case when user_id % 8 = 3 and event_id % 3 = 0 then 'src:audit' else s1 end, case when user_id % 5 = 0 then 'scope:eu' end,
      case when user_id % 6 = 1 then 'time:2024-Q' || (event_id % 4 + 1) end, case when user_id % 6 = 2 then 'time:2023..2025' end], lambda x: x is not null) as contexts,
    event_id % 10 = 0 as flat_flag, event_id % 10 = 5 as late_flag,
    case user_id % 7 when 0 then 3 when 1 then 0 else 1 end as sensitivity, user_id, event_id, s1
  from ev),
k as (
  select *, printf('["e:%s","HAS",%d,"a:%s",["%s"]]', subject, negated::int, attribute, array_to_string(list_sort(contexts), '","')) as claim_key,
    subject || '|' || attribute || '|' || array_to_string(list_sort(list_filter(contexts, lambda x: x[1:4] <> 'src:')), ',') as grp from c),
cur as (select * from k qualify row_number() over (partition by claim_key order by tx desc) = 1)
"""
CONTAINS = """
rel as (
  select 'region/' || replace(trim(r_name), ' ', '-') as subject, 'CONTAINS' as verb, 'nation/' || replace(trim(n_name), ' ', '-') as object from nation join region on n_regionkey = r_regionkey
  union all select 'nation/' || replace(trim(n_name), ' ', '-'), 'CONTAINS', 'customer/' || c_custkey from customer join nation on c_nationkey = n_nationkey
  union all select 'nation/' || replace(trim(n_name), ' ', '-'), 'CONTAINS', 'supplier/' || s_suppkey from supplier join nation on s_nationkey = n_nationkey
  union all select 'customer/' || o_custkey, 'PLACES', 'order/' || o_orderkey from orders
  union all select distinct 'supplier/' || l_suppkey, 'SUPPLIES', 'part/' || l_partkey from lineitem
  union all select 'customer/' || c_custkey, 'REPORTS-TO', 'customer/' || case when c_custkey = 1 then 3 else c_custkey // 2 end from customer where c_custkey > 0
  union all select 'supplier/' || s_suppkey, 'ALIAS', 'vendor/' || s_suppkey from supplier
  union all select 'vendor/' || s_suppkey, 'ALIAS', 'vendor/' || (s_suppkey + 1) from supplier where s_suppkey % 2 = 1 and s_suppkey % 3 = 1
  union all select 'customer/' || c_custkey, 'IS', 'segment/' || replace(trim(c_mktsegment), ' ', '-') from customer)
"""
POLICY = (*resolve.BUILT_IN, Entry("sensor", 2, 0.5), Entry("sensor/click", 3, 0.8), Entry("audit", 5, 0.9))
CLASS = """case when s like 'cli%' then 4 when s like 'agent%' then 3 when s like 'rule%' then 1 when s = 'sensor/click' then 3 when s like 'sensor%' then 2 when s like 'audit%' then 5 else 2 end"""
RELIABLE = """case when s = 'sensor/click' then 0.8 when s like 'sensor%' then 0.5 when s like 'audit%' then 0.9 else 1.0 end"""
REPORTS = "select subject as src, object as dst from rel where verb = 'REPORTS-TO'"
REACH = f"e as ({REPORTS}), reach(src, dst) as (select src, dst from e union select r.src, e.dst from reach r join e on r.dst = e.src)"
ALIASES = "ae as (select subject a, object b from rel where verb = 'ALIAS' union select object, subject from rel where verb = 'ALIAS'), ar(a, b) as (select a, b from ae union select r.a, e.b from ar r join ae e on r.b = e.a), reps as (select a as name, least(a, min(b)) as rep from ar group by a)"


def add(sql: str | None = None, name: str | None = None):
    def put(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return put


def events(sql: str) -> str:
    return f"with {EVENTS} {sql}"


def relations(sql: str, more: str = "") -> str:
    return f"with recursive {CONTAINS}{', ' + more if more else ''} {sql}"


BASIC = ("tx", "subject", "attribute", "value_num", "conf")
B = ", ".join(BASIC)


# --- belief states ---


@add(events(f"select {B}, claim_key from cur"))
def current_beliefs(spark, sf):
    return belief.current(star.events(spark, sf)).select(*BASIC, "claim_key")


@add(events(f"select {B} from cur where conf >= 0.5"))
def current_min_conf(spark, sf):
    return belief.at_least(star.events(spark, sf), 0.5).select(*BASIC)


@add(events("select tx, value_num, conf from k where claim_key = '[\"e:user/4\",\"HAS\",0,\"a:click\",[\"src:cli\"]]'"))
def belief_history(spark, sf):
    return belief.history(star.events(spark, sf), '["e:user/4","HAS",0,"a:click",["src:cli"]]').select("tx", "value_num", "conf")


@add(events("select tx, value_num, conf from cur where claim_key = '[\"e:user/4\",\"HAS\",0,\"a:click\",[\"src:cli\"]]'"))
def belief_latest(spark, sf):
    return belief.latest(star.events(spark, sf), '["e:user/4","HAS",0,"a:click",["src:cli"]]').select("tx", "value_num", "conf")


HALF = "(select min(epoch_us(ts) // 1000) + (max(epoch_us(ts) // 1000) - min(epoch_us(ts) // 1000)) // 2 from events)"
BOUND = f"(select printf('%s-%s-7000-8000-000000000000', substr(printf('%012x', {HALF}), 1, 8), substr(printf('%012x', {HALF}), 9, 4)))"


def half(spark: SparkSession, sf: str) -> str:
    e = star.table(spark, sf, "events").agg(F.min(star.millis("ts")), F.max(star.millis("ts"))).first()
    return keys.tx_bound(e[0] + (e[1] - e[0]) // 2)


@add(events(f"select {B} from k where tx < {BOUND} qualify row_number() over (partition by claim_key order by tx desc) = 1"))
def as_of_current(spark, sf):
    return belief.current(star.events(spark, sf), half(spark, sf), False).select(*BASIC)


@add(events(f"select {B} from k where tx < {BOUND}"))
def as_of_all(spark, sf):
    return belief.as_of(star.events(spark, sf), half(spark, sf), False).select(*BASIC)


@add(events("select tx, substr(claim_key, 1, 9) as head, epoch_ms(make_timestamp(0)) + ('0x' || replace(substr(tx, 1, 13), '-', ''))::bigint as ms from k"))
def tx_decoding(spark, sf):
    c = star.events(spark, sf)
    return c.select("tx", F.substring("claim_key", 1, 9).alias("head"), keys.uuid7_ms(F.col("tx")).alias("ms"))


# --- the pattern language ---


def ask(text: str, options: Options | None = None, keep: tuple[str, ...] = ("row_tx",), source=star.events):
    def run(spark, sf):
        q = query(spark, source(spark, sf), text, options)
        names = [c for c in q.columns if not c.startswith("row_")]
        return q.select(*names, *[F.col(c).alias(c.removeprefix("row_")) for c in keep])

    return run


def pattern(name: str, text: str, sql: str, options: Options | None = None, keep: tuple[str, ...] = ("row_tx",), source=star.events) -> None:
    add(sql, name)(ask(text, options, keep, source))


POS = "not negated and conf > 0"
num = "row_value_num"
pattern("point_pattern", "user/7 HAS click: ?v", events(f"select tx, value_num from cur where subject = 'user/7' and attribute = 'click' and {POS}"), Options(), ("row_tx", num))
QUERIES["point_pattern"] = lambda spark, sf: ask("user/7 HAS click: ?v", None, ("row_tx", num))(spark, sf).drop("v")
pattern("var_bind", "?u HAS click: _", events(f"select subject as u, tx from cur where attribute = 'click' and {POS}"))
pattern("wildcard", "_ HAS error: _", events(f"select tx, conf from cur where attribute = 'error' and {POS}"), None, ("row_tx", "row_conf"))
pattern("negated_pattern", "?u HAS NOT click: _", events("select subject as u, tx from cur where attribute = 'click' and negated and conf > 0"))
pattern("conf_filter", "?u HAS view: _\nWHERE conf >= 90%", events("select subject as u, tx, conf from cur where attribute = 'view' and not negated and conf >= 0.9"), None, ("row_tx", "row_conf"))
pattern("value_filter_unit", "?u HAS purchase: _\nWHERE value > 50 USD", events(f"select subject as u, tx, value_num from cur where attribute = 'purchase' and {POS} and value_num > 50 and value_unit = 'USD'"), None, ("row_tx", num))
pattern("retracted_hidden", "?u HAS signup: _", events(f"select subject as u, tx from cur where attribute = 'signup' and {POS}"))
pattern("retracted_explicit", "?u HAS click: _\nWHERE conf <= 5%", events("select subject as u, tx, conf from cur where attribute = 'click' and not negated and conf <= 0.05"), None, ("row_tx", "row_conf"))
pattern("tag_flat", "?u HAS click: _ #flag", events(f"select subject as u, tx from cur where attribute = 'click' and {POS} and flat_flag"))
pattern("tag_any", "?u HAS click: _\nWHERE tag = flag", events(f"select subject as u, tx from cur where attribute = 'click' and {POS} and (flat_flag or late_flag)"))
pattern("tag_scoped", "?u HAS view: _ #flag:late", events(f"select subject as u, tx from cur where attribute = 'view' and {POS} and late_flag"))
pattern("context_filter", "?u HAS click: _ @scope:eu", events(f"select subject as u, tx from cur where attribute = 'click' and {POS} and user_id % 5 = 0"))
pattern("context_where", "?u HAS view: _\nWHERE context = src:audit", events(f"select subject as u, tx from cur where attribute = 'view' and {POS} and list_contains(contexts, 'src:audit')"))
pattern("all_rows", "user/9 HAS click: _", events("select tx, conf from k where subject = 'user/9' and attribute = 'click' and not negated and conf > 0"), Options(all=True), ("row_tx", "row_conf"))
pattern("relation_pattern", "?r CONTAINS ?n", relations("select subject as r, object as n from rel where verb = 'CONTAINS'"), None, (), star.star)
pattern("inverse_pattern", "?n PART-OF region/ASIA", relations("select object as n from rel where verb = 'CONTAINS' and subject = 'region/ASIA'"), None, (), star.star)
pattern("renamed_verb", "customer/7 ORDERS ?o", relations("select object as o from rel where verb = 'PLACES' and subject = 'customer/7'"), Options(registry=Registry().rename("PLACES", "ORDERS")), (), star.star)
pattern("verb_variable", "customer/3 ?verb ?x", relations("select verb, object as x from rel where subject = 'customer/3'"), None, (), star.star)
pattern("repeated_variable", "?x GOES-WITH ?x", "select distinct 'item/' || l_partkey as x from lineitem where l_partkey = l_suppkey", None, (), star.items)
pattern("object_constant", "?c IS segment/BUILDING", relations("select subject as c from rel where verb = 'IS' and object = 'segment/BUILDING'"), None, (), star.star)
pattern("exact_numeric", "?o HAS total-price: ?v\nWHERE value > 400000", "select 'order/' || o_orderkey as o, o_totalprice as value_num from orders where o_totalprice > 400000", None, (num,), star.star)
QUERIES["exact_numeric"] = lambda spark, sf: ask("?o HAS total-price: ?v\nWHERE value > 400000", None, (num,), star.star)(spark, sf).drop("v")


@add("select 'part/' || p_partkey as p from part where p_retailprice = (select min(p_retailprice) from part)")
def exact_value(spark, sf):
    least = star.table(spark, sf, "part").agg(F.min("p_retailprice")).first()[0]
    return query(spark, star.star(spark, sf), f"?p HAS retail-price: {least!r}", Options(bindings_only=True))


DAY_SQL = "(select strftime(min(ts) + (max(ts) - min(ts)) / 2, '%Y-%m-%d') from events)"


def tx_filter(op: str) -> Query:
    """Of a day, or for equality of its month."""
    def run(spark, sf):
        form = "yyyy-MM" if op == "=" else "yyyy-MM-dd"
        day = star.table(spark, sf, "events").select(F.date_format(F.expr("min(ts) + (max(ts) - min(ts)) / 2"), form)).first()[0]
        return ask(f"?u HAS click: _\nWHERE tx {op} {day}")(spark, sf)

    return run


MONTH = f"date_trunc('month', {DAY_SQL}::timestamp)"
for _name, _op, _sql in (("tx_filter_eq", "=", f"ms >= epoch_ms({MONTH}) and ms < epoch_ms({MONTH} + interval 1 month)"), ("tx_filter_ne", "!=", "(ms < d or ms >= d + 86400000)"), ("tx_filter_lt", "<", "ms < d"), ("tx_filter_le", "<=", "ms < d + 86400000"), ("tx_filter_gt", ">", "ms >= d + 86400000"), ("tx_filter_ge", ">=", "ms >= d")):
    add(events(f", m as (select *, ('0x' || replace(substr(tx, 1, 13), '-', ''))::bigint as ms, epoch_ms(({DAY_SQL})::timestamp) as d from cur where attribute = 'click' and {POS}) select subject as u, tx from m where {_sql}"), _name)(tx_filter(_op))


# --- plain reads ---


@add(relations("select verb, object from rel where subject = 'customer/5'"))
def forward(spark, sf):
    return belief.forward(star.star(spark, sf), "customer/5").select("verb", "object")


@add(relations("select subject, case verb when 'CONTAINS' then 'PART-OF' else verb end as inverse from rel where object = 'customer/5'"))
def reverse_named(spark, sf):
    return belief.reverse(star.star(spark, sf), "customer/5", {"CONTAINS": "PART-OF"}).select("subject", "inverse")


@add(relations("select subject, verb, object from rel where subject = 'nation/NATION_3' or object = 'nation/NATION_3'"))
def claims_about(spark, sf):
    return belief.about(star.star(spark, sf), "nation/NATION_3").select("subject", "verb", "object")


@add(relations("select subject as topic, count(*) as members from rel where verb = 'CONTAINS' group by 1"))
def topics(spark, sf):
    return belief.topics(star.star(spark, sf))


@add(relations("select object as member from rel where verb = 'CONTAINS' and subject = 'nation/NATION_3'"))
def topic_members(spark, sf):
    return belief.topic_members(star.star(spark, sf), "nation/NATION_3")


@add(relations("select subject as topic from rel where verb = 'CONTAINS' and object = 'supplier/1'"))
def topics_of(spark, sf):
    return belief.topics_of(star.star(spark, sf), "supplier/1")


@add(relations("select e as entity, sum(o)::bigint as cites, sum(1 - o)::bigint as cited_by from (select subject as e, 1 as o from rel union all select object, 0 from rel) group by 1"))
def citations(spark, sf):
    return belief.citations(star.star(spark, sf))


@add(relations("select e as entity, count(*) as degree from (select subject as e from rel union all select object from rel) group by 1 order by 2 desc, 1 limit 15"))
def degree_top(spark, sf):
    return belief.degree_top(star.star(spark, sf))


@add(events("select tx, subject from k where late_flag"))
def by_tag(spark, sf):
    return belief.by_tag(star.events(spark, sf), "flag", "late").select("tx", "subject")


@add(events("select tx, subject from k where list_contains(contexts, 'scope:eu')"))
def by_context(spark, sf):
    return belief.by_context(star.events(spark, sf), "scope:eu").select("tx", "subject")


@add(events("select tx, subject from k where list_contains(contexts, 'src:agent/a1')"))
def provenance_filter(spark, sf):
    return belief.by_provenance(star.events(spark, sf), "actor", "agent/a1").select("tx", "subject")


@add(events("select sensitivity, count(*) as n from cur where sensitivity <= 1 group by 1"))
def sensitivity_scope(spark, sf):
    rows = belief.visible(belief.current(star.events(spark, sf)), "internal")
    return rows.groupBy(belief.sensitivity().alias("sensitivity")).agg(F.count("*").alias("n"))


LINEAGE = "le as (select p.tx as parent_id, q.tx as child_id from c p join c q on p.event_id = q.event_id * 2 + 1)"


@add(events(f", {LINEAGE}, v as (select tx from c where sensitivity <= 1) select parent_id, child_id from le where parent_id in (select tx from v) and child_id in (select tx from v)"))
def scoped_edges(spark, sf):
    return belief.scoped(star.events(spark, sf), star.edges(spark, sf), "internal")[1].select("parent_id", "child_id")


@add(events(f", {LINEAGE} select parent_id, subject, attribute from le join c on child_id = tx"))
def edges_of(spark, sf):
    return belief.edges_of(star.events(spark, sf), star.edges(spark, sf)).select("parent_id", "subject", "attribute")


@add(f"with recursive {EVENTS}, {LINEAGE}, top as (select tx from c where event_id = (select max(event_id) from events)), ln(id, depth) as (select tx, 0 from top union all select child_id, depth + 1 from ln join le on parent_id = id where depth < 7) select id, depth::int as depth, depth = 7 and id in (select parent_id from le) as truncated from ln")
def lineage_depth(spark, sf):
    last = star.events(spark, sf).orderBy(F.desc(F.substring("tx", -12, 12))).limit(1).first()["tx"]
    return closure.lineage(spark, star.edges(spark, sf), [last], depth=7).select("id", "depth", "truncated")


@add(events(f"select {B} from k order by tx desc limit 25"))
def newest_n(spark, sf):
    return belief.newest(star.events(spark, sf), 25).select(*BASIC)


@add(events(f"select {B} from cur where tx <= (select max(tx) from k) and tx > {BOUND} order by tx limit 100"))
def page_keyset(spark, sf):
    c = star.events(spark, sf)
    return belief.page(belief.current(c), half(spark, sf), belief.snapshot(c)).select(*BASIC)


# --- closures ---


@add(relations("select dst from reach where src = 'customer/77'", REACH))
def closure_seeded(spark, sf):
    return query(spark, star.star(spark, sf), "customer/77 REPORTS-TO+ ?dst")


@add(relations("select dst from reach where src = 'customer/77'", REACH))
def closure_seeded_on_spark(spark, sf):
    """The same, hop by hop as Spark jobs."""
    return query(spark, star.star(spark, sf), "customer/77 REPORTS-TO+ ?dst", Options(driver_edges=0))


@add(relations("select src from reach where dst = 'customer/5'", REACH))
def closure_reverse(spark, sf):
    return query(spark, star.star(spark, sf), "?src REPORTS-TO+ customer/5")


@add(relations("select src, dst from reach", REACH))
def closure_all_pairs(spark, sf):
    return query(spark, star.star(spark, sf), "?src REPORTS-TO+ ?dst")


@add(relations("select src, dst from reach", REACH))
def closure_all_pairs_on_spark(spark, sf):
    """The same, by doubling paths as Spark jobs."""
    return query(spark, star.star(spark, sf), "?src REPORTS-TO+ ?dst", Options(driver_edges=0))


@add(relations("select src as x from reach where src = dst", REACH))
def closure_cycle(spark, sf):
    return query(spark, star.star(spark, sf), "?x REPORTS-TO+ ?x")


@add(relations("select distinct p.src, p.dst, e.src as edge_src, e.dst as edge_dst from reach p, e where p.src = 'customer/77' and (e.src = p.src or exists (select 1 from reach a where a.src = p.src and a.dst = e.src)) and (e.dst = p.dst or exists (select 1 from reach b where b.src = e.dst and b.dst = p.dst))", REACH))
def closure_support(spark, sf):
    edges = closure.edges_of_verb(star.star(spark, sf), "REPORTS-TO")
    pairs = closure.closure(spark, edges, ["customer/77"])
    return closure.support(closure.closure(spark, edges), edges, pairs)


@add(relations("select name, rep from reps", ALIASES))
def alias_closure(spark, sf):
    return closure.representatives(spark, star.star(spark, sf))


@add(relations("select name, rep from reps", ALIASES))
def alias_closure_on_spark(spark, sf):
    """The same, by labels that spread as Spark jobs."""
    return closure.representatives(spark, star.star(spark, sf), driver_edges=0)


@add(relations("select object as p from rel where verb = 'SUPPLIES' and subject in (select name from reps where rep = (select rep from reps where name = 'vendor/2'))", ALIASES))
def alias_pattern(spark, sf):
    return query(spark, star.star(spark, sf), "vendor/2 SUPPLIES ?p", Options(aliases=True, bindings_only=True))


# --- valid time ---

SPANS = """
t as (select *, list_filter(list_transform(contexts, lambda x: case
    when x = 'time:2023..2025' then {'s': epoch_ms(timestamp '2023-01-01'), 'e': epoch_ms(timestamp '2026-01-01')}
    when x like 'time:%' then {'s': epoch_ms(make_timestamp(2024, (3 * right(x, 1)::int - 2)::bigint, 1, 0, 0, 0)), 'e': epoch_ms(make_timestamp(2024, (3 * right(x, 1)::int - 2)::bigint, 1, 0, 0, 0) + interval 3 months)} end), lambda z: z is not null) as spans,
  epoch_ms(timestamp '2024-05-15') as inst from cur)
"""
AT = "(len(spans) = 0 or (spans[1].s <= inst and inst < spans[1].e))"
pattern("valid_time_at", "?u HAS view: _", events(f", {SPANS} select subject as u, tx from t where attribute = 'view' and {POS} and {AT}"), Options(at="2024-05-15", plain_times=True))
QUERIES["valid_time_at"] = lambda spark, sf: ask("?u HAS view: _", Options(at="2024-05-15"))(spark, sf).drop("at_num")
add(events(f", {SPANS} select tx, round(case when len(spans) = 1 then traj_from + (traj_to - traj_from) * greatest(0, least(1, (inst - spans[1].s) / (spans[1].e - spans[1].s))) end, 6) as at_num from t where attribute = 'view' and {POS} and {AT}"), "interpolate_at")(lambda spark, sf: ask("_ HAS view: _", Options(at="2024-05-15", plain_times=True))(spark, sf).select("tx", F.round("at_num", 6).alias("at_num")))
add(f"with {EVENTS.replace('from k qualify', f'from k where tx < {BOUND} qualify')}, {SPANS} select subject as u, tx from t where attribute = 'view' and {POS} and {AT}", "bitemporal")(
    lambda spark, sf: query(spark, belief.as_of(star.events(spark, sf), half(spark, sf), False), "?u HAS view: _", Options(at="2024-05-15", plain_times=True)).select("u", F.col("row_tx").alias("tx"))
)


# --- contested facts and numbers ---

RANKED = f"""
w as (select *, case when not list_contains(contexts, 'src:audit') then substr(s1, 5) else 'audit' end as s from cur where conf > 0),
r as (select *, {CLASS} as class, conf * {RELIABLE} as weight from w),
q as (select *, row_number() over (partition by grp order by class desc, weight desc, tx desc) as rank, count(*) over (partition by grp) as candidates from r)
"""


@add(events(f", {RANKED} select tx, subject, attribute, conf from q where rank = 1"))
def resolved_winners(spark, sf):
    return resolve.winners(star.events(spark, sf), list(POLICY)).select("tx", "subject", "attribute", "conf")


@add(events(f", {RANKED} select tx, rank::int as rank, candidates from q where candidates > 1"))
def contested(spark, sf):
    return resolve.contested(star.events(spark, sf), list(POLICY)).select("tx", "rank", "candidates")


@add(events(f", {RANKED} select tx, class::double as class, round(weight, 9) as weight from q"))
def reliability_weighted(spark, sf):
    return resolve.ranked(star.events(spark, sf), list(POLICY)).select("tx", "class", F.round("weight", 9).alias("weight"))


@add(events(f", {RANKED} select subject as u, tx from q where rank = 1 and attribute = 'click' and not negated"))
def resolved_pattern(spark, sf):
    return ask("?u HAS click: _", Options(resolve=True, policy=POLICY))(spark, sf)


EST = "est as (select 'part/' || l_partkey as subject, l_extendedprice / l_quantity as x, l_extendedprice / l_quantity * l_discount / 2 as s, 1 - l_tax as conf from lineitem where l_discount > 0)"


@add(f"with {EST} select subject, round(sum(conf / (s * s) * x) / sum(conf / (s * s)), 4) as mean, round(1 / sqrt(sum(conf / (s * s))), 6) as sigma, count(*) as n from est where conf > 0 and s > 0 group by 1")
def fuse_estimates(spark, sf):
    out = resolve.fuse(resolve.estimate_columns(star.estimates(spark, sf)), ["subject"])
    return out.select("subject", F.round("mean", 4).alias("mean"), F.round("sigma", 6).alias("sigma"), "n")


@add(events(f", a as (select * from cur where attribute = 'view' and {POS}), b as (select * from cur where attribute = 'click' and {POS}) select a.tx as x, b.tx as y, round(0.9::double * a.conf * b.conf, 9) as conf from a join b using (subject)"))
def noisy_and(spark, sf):
    rows = joined(spark, star.events(spark, sf), ["?u HAS view: _", "?u HAS click: _"])
    return rows.select(F.col("ids")[0].alias("x"), F.col("ids")[1].alias("y"), F.round(resolve.noisy_and(F.col("confs"), 0.9), 9).alias("conf"))


@add(events("select tx, round(conf / sum(conf) over (partition by subject), 9) as share, round(max(conf) over (partition by subject) - conf, 9) as gap from cur where conf > 0"))
def normalise_hypotheses(spark, sf):
    rows = resolve.normalised(belief.current(star.events(spark, sf)).where("conf > 0"), ["subject"])
    return rows.select("tx", F.round("share", 9).alias("share"), F.round("gap", 9).alias("gap"))


# --- rules ---


def conclusion(text: str, source=star.star) -> Query:
    def run(spark, sf):
        out = rules.evaluate(spark, source(spark, sf), rules.parse_rule(text))
        return out.select("subject", "verb", "object", "conf", F.size("because").alias("reasons"))

    return run


add(relations("select distinct a.subject, 'SERVES' as verb, b.object, 1.0::double as conf, 2 as reasons from rel a join rel b on a.object = b.subject where a.verb = 'CONTAINS' and b.verb = 'SUPPLIES'"), "rule_two_hop")(conclusion("?n CONTAINS ?s, ?s SUPPLIES ?p => ?n SERVES ?p"))
add("select 'customer/' || c_custkey as subject, 'NEEDS' as verb, 'review' as object, 1.0::double as conf, 1 as reasons from customer where c_acctbal < 0", "rule_constraint")(conclusion("?c HAS account-balance: ?b, ?b < 0 => ?c NEEDS review"))


@add(events(f", a as (select subject, conf from cur where attribute = 'click' and {POS}), b as (select subject, conf from cur where attribute = 'error' and {POS}) select subject, max(round(a.conf * b.conf * 100, 2) / 100) as conf from a join b using (subject) group by 1 having max(round(a.conf * b.conf * 100, 2) / 100) >= 0.05"))
def rule_strongest(spark, sf):
    """Of all derivations of a conclusion the strongest counts; weak ones conclude nothing."""
    rule = rules.parse_rule("?u HAS click: _, ?u HAS error: _ => ?u NEEDS care")
    return rules.evaluate(spark, star.events(spark, sf), rule).select("subject", "conf")


@add(relations("select src as subject, dst as object from reach", REACH))
def rule_fixpoint(spark, sf):
    base = star.star(spark, sf).where("verb = 'REPORTS-TO'")
    two = [rules.parse_rule("?a REPORTS-TO ?b => ?a ABOVE-IS ?b"), rules.parse_rule("?a ABOVE-IS ?b, ?b REPORTS-TO ?c => ?a ABOVE-IS ?c")]
    found = rules.derive(spark, base, two, 64)  # a hop a pass: chains halve their customer's number at each
    if not found.complete:
        raise AssertionError(found.note)
    return found.rows.select("subject", "object").distinct()


@add(relations("select 'customer/' || i as subject, 'region/FAR' as object from range(1, 6) t(i)"))
def rule_retract(spark, sf):
    """Rule rows without support: nothing derives that customers 1 to 5 are in region FAR."""
    rule = rules.parse_rule("?c IS ?s, ?s IS segment => ?c IN ?s")
    base = star.star(spark, sf)
    gone = base.where("verb = 'IS'").where(F.regexp_extract("subject", "([0-9]+)", 1).try_cast("int").between(1, 5))
    old = gone.withColumns({"verb": F.lit("IN"), "object": F.lit("region/FAR"), "contexts": F.array(F.lit(rule.source)), "claim_key": F.concat(F.lit("old/"), "subject")})
    return rules.changes(spark, base.unionByName(conform(old)), [rule])[1].select("subject", "object")


@add("select 'nation/' || replace(trim(n_name), ' ', '-') as n, 'part/' || l_partkey as p from (select distinct l_suppkey, l_partkey from lineitem) join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey")
def multi_pattern_join(spark, sf):
    return joined(spark, star.star(spark, sf), ["?n CONTAINS ?s", "?s SUPPLIES ?p"]).select("n", "p")


@add(events(f", a as (select subject, tx from cur where attribute = 'click' and {POS}), b as (select subject, tx from cur where attribute = 'error' and {POS}) select a.subject as u, a.tx as x, b.tx as y from a join b using (subject) where a.tx > {BOUND} or b.tx > {BOUND}"))
def trigger_events(spark, sf):
    out = rules.triggered(spark, star.events(spark, sf), ["?u HAS click: _", "?u HAS error: _"], half(spark, sf))
    return out.select("u", F.col("ids")[0].alias("x"), F.col("ids")[1].alias("y"))


# --- shapes ---


def declared(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(subject, verb, object, tag key, tag value) as claims."""
    df = spark.createDataFrame(rows, "subject string, verb string, object string, key string, value string")
    tags = F.when(F.col("key").isNotNull(), F.array(F.struct("key", "value")))
    tx = F.concat(F.lit("00000000-0000-7000-8000-"), F.substring(F.sha2(F.concat("subject", "verb", "object"), 256), 1, 12))
    return conform(df.select(tx.alias("tx"), "subject", "verb", "object", tags.alias("tags")))


def shaped(spark: SparkSession, sf: str) -> DataFrame:
    """The star's claims with expectations: segments are customers' types under `party`; parties place exactly one order, have a balance in
    EUR, are a part of something and are contained in two ways. Balances have no unit."""
    segments = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    rows = [(f"segment/{s}", "EXTENDS", "party", None, None) for s in segments]
    rows += [("party", "EXPECTS", "PLACES", "cardinality", "one"), ("party", "EXPECTS", "account-balance", "unit", "EUR"), ("party", "EXPECTS", "PART-OF", None, None), ("party", "EXPECTS", "IS-IN", None, None)]
    return star.star(spark, sf).unionByName(declared(spark, rows))


PLACED = "select c_custkey, count(o_custkey) as n from customer left join orders on c_custkey = o_custkey group by 1"
WRONG = f"""
select 'customer/' || c_custkey as entity, 'party' as type, 'PLACES' as property, case when n = 0 then 'missing' else 'too many' end as problem, n as observed, '' as units from ({PLACED}) where n <> 1
union all select 'customer/' || c_custkey, 'party', 'account-balance', 'unit', 1, '' from customer
union all select 'customer/' || c_custkey, 'party', 'IS-IN', 'missing', 0, '' from customer
"""


@add(WRONG)
def shape_violations(spark, sf):
    """Of cardinality, unit and presence; PART-OF, an inverse verb, is satisfied by the nations' CONTAINS."""
    return shape.check(spark, shaped(spark, sf)).withColumn("units", F.array_join("units", ","))


@add(relations("select subject as entity, object as type from rel where verb = 'IS' union select subject, 'party' from rel where verb = 'IS'"))
def shape_instances(spark, sf):
    return shape.instances(spark, shaped(spark, sf)).select("entity", "type")


@add(f"select entity, property, problem from ({WRONG}) where property = 'PLACES' and regexp_extract(entity, '([0-9]+)', 1)::bigint % 2 = 0")
def new_violations(spark, sf):
    after = shape.check(spark, shaped(spark, sf)).where("property = 'PLACES'")
    before = after.where(F.regexp_extract("entity", "([0-9]+)", 1).try_cast("long") % 2 == 1)
    return shape.new_violations(before, after).select("entity", "property", "problem")


@add(events(f"select tx from cur where tx < {BOUND}"))
def stale(spark, sf):
    ms = int(half(spark, sf).replace("-", "")[:12], 16)
    return shape.stale(star.events(spark, sf), ms + 90 * shape.DAY, 90).select("tx")


@add(events("select tx, conf from cur where conf between 0.3 and 0.7"))
def review(spark, sf):
    return shape.review(star.events(spark, sf)).select("tx", "conf")


@add(events("select (select count(*) from k) as rows, count(*) as facts, count_if(conf > 0 and not negated)::bigint as current, count_if(conf = 0)::bigint as retracted, count_if(negated and conf > 0)::bigint as negated, count_if(conf > 0 and conf < 0.3)::bigint as low, round(avg(case when conf > 0 then conf end), 9) as average_conf, count(distinct subject) as entities from cur"))
def coverage(spark, sf):
    return shape.coverage(star.events(spark, sf)).withColumn("average_conf", F.round("average_conf", 9)).drop("typed")


#: Where the digits of an id's version and of its variant stand.
VERSION, VARIANT = 15, 20


@add(events("select tx, event_id % 3 <> 0 as ok from k"))
def tx_validity(spark, sf):
    """Every third id is spoilt: in its version, its variant, its length, or its letters."""
    c = star.events(spark, sf)
    n = F.conv(F.substring("tx", -12, 12), 16, 10).cast("long")
    put = lambda digit, at: F.overlay("tx", F.lit(digit), at)  # noqa: E731  by place: the digits of the time may read like the version's
    spoilt = F.when(n % 12 == 0, put("4", VERSION)).when(n % 12 == 3, put("7", VARIANT)).when(n % 12 == 6, F.upper(put("a", VARIANT))).when(n % 12 == 9, F.concat("tx", F.lit("0"))).otherwise(F.col("tx"))
    return c.select("tx", keys.is_uuid7(spoilt).alias("ok"))


@add(events(f", {SPANS} select tx, len(spans) as n, spans[1].s as first, spans[1].e as last from t"))
def valid_spans(spark, sf):
    """The general parser of time contexts."""
    c = belief.current(star.events(spark, sf)).withColumn("spans", validtime.spans(F.col("contexts")))
    first = F.get("spans", F.lit(0))
    return c.select("tx", F.size("spans").cast("long").alias("n"), first["start"].alias("first"), first["end"].alias("last"))


# --- movement: search, sync, connect, score, pages ---


@add("select doc_id from documents where (' ' || trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ') like '% rights reserved %'")
def search_phrase(spark, sf):
    from tenet.operators.sync import has_phrase

    return star.table(spark, sf, "documents").where(has_phrase(F.col("text"), "Rights reserved")).select("doc_id")


@add(events("select tx, subject, attribute, value_num, conf from k"))
def sync_union(spark, sf):
    """Two overlapping parts of a store, merged, are the store."""
    from tenet.operators.sync import merged

    c, n = star.events(spark, sf), F.conv(F.substring("tx", -12, 12), 16, 10).cast("long")
    return merged(c.where(n % 3 != 0), c.where(n % 2 == 0).unionByName(c.where(n % 3 == 0))).select("tx", "subject", "attribute", "value_num", "conf")


TEMPLATE = "customer/?c_custkey HAS balance: ?c_acctbal\ncustomer/?c_custkey LIVES-IN nation/?c_nationkey"


@add("select 'customer/' || c_custkey as subject, 'HAS' as verb, 'balance' as attribute, null as object, c_acctbal as value_num from customer union all select 'customer/' || c_custkey, 'LIVES-IN', null, 'nation/' || c_nationkey, null from customer")
def connect_map(spark, sf):
    from tenet.operators.connect import mapped, parse_template

    out = mapped(star.table(spark, sf, "customer"), parse_template(TEMPLATE), "crm", ["c_custkey"])
    return out.select("subject", "verb", "attribute", "object", "value_num")


@add("select 'append' as what, 'customer/' || c_custkey as subject, 'nation/0' as object, 1.0::double as conf from customer where c_custkey % 10 = 0 union all select 'retract', 'customer/' || c_custkey, 'nation/' || c_nationkey, 0.0 from customer where c_custkey % 10 = 0 and c_nationkey <> 0")
def connect_diff(spark, sf):
    """Every tenth customer moves to nation 0: its record is mapped anew, and where it moved its former nation is retracted."""
    from tenet.operators.connect import incremental, mapped, parse_template

    old = star.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    new = old.withColumn("c_nationkey", F.when(F.col("c_custkey") % 10 == 0, F.lit(0)).otherwise(F.col("c_nationkey")))
    line = parse_template("customer/?c_custkey LIVES-IN nation/?c_nationkey")
    before, after = mapped(old, line, "crm", ["c_custkey"]), mapped(new, line, "crm", ["c_custkey"])
    held = conform(before.withColumn("tx", F.col("record"))).withColumn("record", F.col("tx"))
    known = before.select("record", "digest").where(F.col("record").cast("long") % 10 != 0)
    append, retract = incremental(held, after, known)
    names = ["subject", "object", "conf"]
    return append.select(F.lit("append").alias("what"), *names).union(retract.select(F.lit("retract").alias("what"), *names))


@add("select 'customer/' || c_custkey as c, c_acctbal as value_num from customer where c_acctbal > 9000")
def federated(spark, sf):
    from tenet.operators.connect import federated as run
    from tenet.operators.connect import parse_template

    empty = star.star(spark, sf).where("verb = 'PLACES'").limit(0)
    records = star.table(spark, sf, "customer")
    return run(spark, empty, records, parse_template(TEMPLATE), "crm", ["c_custkey"], "?c HAS balance: _\nWHERE value > 9000").select("c", F.col("row_value_num").alias("value_num"))


@add(events("select hit, produced, golden, round(hit / produced, 9) as precision, round(hit / golden, 9) as recall, round(2 * (hit / produced) * (hit / golden) / (hit / produced + hit / golden), 9) as f1 from (select count_if(value_num < 100 and event_id % 5 <> 0 and event_id % 7 <> 0)::bigint as hit, count_if(event_id % 5 <> 0)::bigint as produced, count_if(event_id % 7 <> 0)::bigint as golden from cur)"))
def eval_prf(spark, sf):
    """Current beliefs but for some against golden ones but for others, in which values of 100 and more differ."""
    from tenet.operators.sync import score

    c, n = belief.current(star.events(spark, sf)), F.conv(F.substring("tx", -12, 12), 16, 10).cast("long")
    golden = c.where(n % 7 != 0).withColumn("value_num", F.when(F.col("value_num") < 100, F.col("value_num")).otherwise(F.col("value_num") + 1))
    out = score(c.where(n % 5 != 0), golden)
    return out.select("hit", "produced", "golden", *[F.round(x, 9).alias(x) for x in ("precision", "recall", "f1")])


@add()
def html_text(spark, sf):
    from tenet.sources.html import page

    return star.table(spark, sf, "pages").select("page_id", page(F.col("html")).alias("p")).select("page_id", "p.title", "p.text")


@add(relations("select subject as path, subject, verb, object from rel where verb = 'CONTAINS'"))
def text_ingest(spark, sf):
    """Documents read as claim text: their lines that are claims (lenient; most lines are none)."""
    from tenet.sources.text import parse_table

    lines = star.star(spark, sf).where("verb = 'CONTAINS'").select(F.concat_ws(" ", "subject", "verb", "object").alias("line"), F.col("subject").alias("path"))
    docs = lines.groupBy("path").agg(F.concat_ws("\n", F.array_sort(F.collect_list("line"))).alias("text"))
    return parse_table(docs).select("path", "subject", "verb", "object")


LINE = """subject || ' HAS ' || case when negated then 'NOT ' else '' end || attribute || ': ' || value_num || coalesce(' ' || value_unit, '')
  || ' ' || array_to_string(list_transform(contexts, lambda x: '@' || x), ' ') || case when label is not null then ' #sensitivity:' || label else '' end
  || case when flat_flag then ' #flag' when late_flag then ' #flag:late' else '' end || case when conf < 1 then ' @ ' || (conf * 100)::int || '%' else '' end"""


@add(events(f", l as (select *, case sensitivity when 3 then 'restricted' when 0 then 'public' end as label from cur where sensitivity <= 1) select tx, {LINE} as line from l"))
def export_text(spark, sf):
    """Canonical lines of what a reader of internal rows sees: values, contexts, tags, confidence."""
    from tenet.store import emitted

    return belief.visible(belief.current(star.events(spark, sf)), "internal").select("tx", emitted().alias("line"))


@add(events("select subject, attribute, claim_key from k"))
def json_records(spark, sf):
    """Through JSON records and back."""
    from tenet.store import from_records, records

    return from_records(records(star.events(spark, sf))).select("subject", "attribute", "claim_key")
