"""More of the engine's operators as queries with SQL: scalar functions, sources and sinks, policies, shapes, rule lifecycle, streams.

Importing this adds them to the catalogue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenet.catalogue import ALIASES, BOUND, POLICY, POS, RANKED, REPORTS, SPANS, add, ask, declared, events, half, relations, shaped
from tenet.functions import keys, values
from tenet.operators import automate, belief, closure, index, maintained, report, resolve, rules, scenario, shape, suggest, sync
from tenet.operators.registry import fold
from tenet.plans.page import page
from tenet.plans.query import Options, query
from tenet.schema import CLAIM, EDGE, conform
from tenet.sources import records, star, text
from tenet.staging import new_path, staged, tabled
from tenet.store import Store
from tenet.streaming import feed

def num():
    """The number of an event, from its id."""
    return F.conv(F.substring("tx", -12, 12), 16, 10).cast("long")


def users(spark: SparkSession, sf: str) -> DataFrame:
    return star.table(spark, sf, "events")


# --- query options ---


@add(events(f"select subject as u, tx from cur where attribute = 'click' and {POS} order by tx limit 10 offset 6"))
def ordered_part(spark, sf):
    """A part of the solutions in order of tx: the rows show that the order holds."""
    return ask("?u HAS click: _", Options(ordered=True, limit=10, offset=6))(spark, sf)


@add(events(f"select subject as u, tx, row_number() over (order by tx) as place from cur where attribute = 'click' and {POS} order by tx limit 8 offset 16"))
def page_cursor(spark, sf):
    """The third page of eight, reached by two cursors, with rows that came in between left out."""
    c = star.events(spark, sf)
    later = c.limit(1).withColumns({"tx": F.lit(keys.tx_bound(4_000_000_000_000)), "subject": F.lit("user/late"), "claim_key": F.lit("late")}).withColumn("id", F.col("tx"))
    first = page(spark, c, "?u HAS click: _", limit=8)
    second = page(spark, c.unionByName(later), "?u HAS click: _", limit=8, after=first.next)
    third = page(spark, c.unionByName(later), "?u HAS click: _", limit=8, after=second.next)
    return spark.createDataFrame([(r["u"], r["row_tx"], 17 + i) for i, r in enumerate(third.rows)], "u string, tx string, place long")


@add("select 'order/' || o_orderkey as o from orders where o_orderdate = (select min(o_orderdate) from orders)")
def date_object(spark, sf):
    """A date in the object's place also names rows that have it as their value."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    o = star.table(spark, sf, "orders")
    rows = o.select(keys.uuid7(F.lit(star.EPOCH), F.col("o_orderkey")).alias("tx"), star.name("order", "o_orderkey").alias("subject"), F.lit("DATED").alias("verb"), day.alias("value_text"))
    least = o.agg(F.min(day)).first()[0]
    return query(spark, conform(rows), f"?o DATED {least}", Options(bindings_only=True))


@add(events(f", {SPANS}, x as (select tx, traj_from + (traj_to - traj_from) * greatest(0, least(1, (inst - spans[1].s) / (spans[1].e - spans[1].s))) as v from t where attribute = 'view' and {POS} and len(spans) = 1 and spans[1].s <= inst and inst < spans[1].e and traj_from is not null) select tx, round(v, (3 - floor(log10(v)))::int) as v from x where v >= 1"))
def interpolated_text(spark, sf):
    """A value variable takes the interpolated value, in four significant digits."""
    c = star.events(spark, sf)
    c = c.withColumn("value_text", F.when(F.col("traj_from").isNotNull(), F.concat(F.col("traj_from").cast("string"), F.lit(" -> "), F.col("traj_to").cast("string"))))
    q = query(spark, c, "_ HAS view: ?v", Options(at="2024-05-15", plain_times=True)).where("at_num >= 1")
    return q.select(F.col("row_tx").alias("tx"), F.col("v").cast("double").alias("v"))


@add(events(f"select u as u, tx from (select subject as u, tx, value_num, conf from cur where attribute = 'click' and {POS})"))
def match_records(spark, sf):
    """Solutions as versioned records, and back."""
    from tenet.store import match_record

    q = query(spark, star.events(spark, sf), "?u HAS click: _")
    r = q.select(match_record(q.columns).alias("record"))
    got = F.from_json("record", "format string, bindings map<string,string>, claim struct<tx:string>")
    return r.select(got.alias("r")).where("r.format = 'tenet.match/1'").select(F.col("r.bindings")["u"].alias("u"), "r.claim.tx")


LAST = "customer/9"
SUPPORT = """
e as (select tx, subject as src, object as dst from (select printf('%s-%s-7000-8000-%s', substr(printf('%012x', 1700000000009), 1, 8), substr(printf('%012x', 1700000000009), 9, 4), printf('%012x', c_custkey)) as tx,
  'customer/' || c_custkey as subject, 'customer/' || case when c_custkey = 1 then 3 else c_custkey // 2 end as object from customer where c_custkey > 0)),
reach(src, dst) as (select src, dst from e union select r.src, e.dst from reach r join e on r.dst = e.src)"""


@add(f"with recursive {SUPPORT} select p.dst, array_to_string(list_sort(list(distinct e.tx)), ',') as support from reach p, e where p.src = '{LAST}' and (e.src = p.src or exists (select 1 from reach a where a.src = p.src and a.dst = e.src)) and (e.dst = p.dst or exists (select 1 from reach b where b.src = e.dst and b.dst = p.dst)) group by 1")
def closure_with_support(spark, sf):
    """Each pair with the ids of the edge rows on any path between its ends."""
    q = query(spark, star.star(spark, sf).where("verb = 'REPORTS-TO'"), f"{LAST} REPORTS-TO+ ?dst", Options(support=True))
    return q.select("dst", F.array_join("support", ",").alias("support"))


PRECEDES = "pe as (select 'vendor/' || s_suppkey as src, 'supplier/' || (s_suppkey + 1) as dst from supplier where s_suppkey % 5 <> 4)"


@add(relations("select distinct d.dst as x from pr join pd d on pr.dst = d.rep where pr.src = (select rep from reps where name = 'supplier/0')", f"{ALIASES}, {PRECEDES}, pm as (select distinct coalesce(a.rep, src) as src, coalesce(b.rep, dst) as dst from pe left join reps a on src = a.name left join reps b on dst = b.name), pr(src, dst) as (select src, dst from pm union select r.src, m.dst from pr r join pm m on r.dst = m.src), pd as (select distinct dst, coalesce(b.rep, dst) as rep from pe left join reps b on dst = b.name)"))
def alias_closure_hop(spark, sf):
    """Hops that cross aliases; ends are told by the names that are stored."""
    s = star.table(spark, sf, "supplier").where("s_suppkey % 5 <> 4")
    more = s.select(*star.relation(15, F.col("s_suppkey"), star.name("vendor", "s_suppkey"), "PRECEDES", F.concat(F.lit("supplier/"), (F.col("s_suppkey") + 1).cast("string"))))
    return query(spark, star.star(spark, sf).where("verb = 'ALIAS'").unionByName(conform(more)), "supplier/0 PRECEDES+ ?x", Options(aliases=True))


@add(relations("select name from reps where rep = (select rep from reps where name = 'vendor/2') ", ALIASES))
def aliases_of(spark, sf):
    return closure.aliases_of(closure.representatives(spark, star.star(spark, sf)), "vendor/2")


@add(events(f"select tx, subject, (select count(*) from cur where attribute = 'error' and {POS}) as total from cur where attribute = 'error' and {POS} order by tx desc limit 10"))
def capped_section(spark, sf):
    c = belief.supported(belief.current(star.events(spark, sf).where("attribute = 'error'")))
    rows, total = belief.capped(c.select("tx", "subject"), 10, F.desc("tx"))
    return rows.withColumn("total", F.lit(total).cast("long"))


# --- scalar functions ---


@add("select event_id, case when event_id % 3 = 0 then chr((event_id % 31 + 1)::int) when event_id % 3 = 1 then '\"' else '\\' end as odd, '[\"e:a' || case when event_id % 3 = 1 then '\\\"' when event_id % 3 = 2 then '\\\\' else case event_id % 31 + 1 when 8 then '\\b' when 9 then '\\t' when 10 then '\\n' when 12 then '\\f' when 13 then '\\r' else printf('\\u%04x', event_id % 31 + 1) end end || '\",\"HAS\",0,\"a:x\",[]]' as claim_key from events")
def claim_key_escapes(spark, sf):
    """Control characters, quotes and backslashes in claim keys, as JSON writes them."""
    e = users(spark, sf)
    odd = F.when(F.col("event_id") % 3 == 0, F.chr(F.col("event_id") % 31 + 1)).when(F.col("event_id") % 3 == 1, F.lit('"')).otherwise(F.lit("\\"))
    rows = e.select("event_id", odd.alias("odd"), F.concat(F.lit("a"), odd).alias("subject"), F.lit("HAS").alias("verb"), F.lit(False).alias("negated"), F.lit(None).cast("string").alias("object"), F.lit("x").alias("attribute"), F.lit("1").alias("value_text"), F.lit(1.0).alias("value_num"), F.array().cast("array<string>").alias("contexts"))
    return rows.select("event_id", "odd", keys.claim_key().alias("claim_key"))


@add(events("select tx, grp as part from k"))
def group_keys(spark, sf):
    """The contested group of a row: without polarity and without sources."""
    part = F.split(keys.group_key(), "\x1f")
    rest = F.replace(part[3], F.lit("\x1e"), F.lit(","))
    return star.events(spark, sf).select("tx", F.concat_ws("|", part[0], F.substring(part[2], 3, 99), rest).alias("part"))


@add("select p_partkey, replace(trim(p_name || '  ' || p_brand), '  ', ' ') as text, replace(p_name, ' ', '-') || '-' || p_brand as entity, len(string_split(p_name || '/' || p_brand || '/' || p_type || case when p_partkey % 2 = 0 then '/x' else '' end, '/')) as segments, case when p_partkey % 2 = 0 then 'more than 3 scope segments,white space' else 'white space' end as problems from part")
def entity_names(spark, sf):
    p = star.table(spark, sf, "part")
    loose = F.concat(F.lit(" "), "p_name", F.lit("  "), "p_brand", F.lit(" "))
    scoped = F.concat_ws("/", "p_name", "p_brand", "p_type", F.when(F.col("p_partkey") % 2 == 0, "x"))
    text_ = F.replace(F.trim(loose), F.lit("  "), F.lit(" "))
    return p.select("p_partkey", text_.alias("text"), values.entity(loose).alias("entity"), F.size(values.segments(scoped)).cast("long").alias("segments"), F.array_join(values.entity_problems(scoped), ",").alias("problems"))


SAMPLES = "[event_type, value || '', value || 'ms', value || ' USD/yr', strftime(ts, '%Y-%m-%d'), strftime(ts, '%Y-Q') || quarter(ts), '~' || value, '900M']"


@add(f"with s as (select event_id, unnest({SAMPLES}) as t, unnest(range(8)) as i from events) select event_id, i, i = 0 as unit, i in (4, 5) as date from s")
def unit_and_date_tests(spark, sf):
    v = F.col("value").cast("string")
    quarter = F.concat(F.date_format("ts", "yyyy"), F.lit("-Q"), F.quarter("ts"))
    found = F.array("event_type", v, F.concat(v, F.lit("ms")), F.concat(v, F.lit(" USD/yr")), F.date_format("ts", "yyyy-MM-dd"), quarter, F.concat(F.lit("~"), v), F.lit("900M"))
    e = users(spark, sf).select("event_id", F.posexplode(found).alias("i", "t"))
    return e.select("event_id", F.col("i").cast("long").alias("i"), F.col("t").rlike(values.UNIT).alias("unit"), values.date_column(F.col("t")).alias("date"))


@add("with s as (select event_id, event_id % 4 as k, value as v from events) select event_id, case k when 0 then v when 1 then v when 2 then (event_id % 1000) * 1e6 else v end as num, case k when 1 then 'ms' when 2 then 'USD' end as unit, k = 3 as approx from s")
def value_parsing(spark, sf):
    """Numbers with glued and spaced units, multipliers, and the mark of approximation."""
    v, k = F.col("value").cast("decimal(18,2)").cast("string"), F.col("event_id") % 4
    text_ = F.when(k == 0, v).when(k == 1, F.concat(v, F.lit("ms"))).when(k == 2, F.concat((F.col("event_id") % 1000).cast("string"), F.lit("M USD"))).otherwise(F.concat(F.lit("~"), v))
    c = values.value_columns(text_)
    return users(spark, sf).select("event_id", c["value_num"].alias("num"), c["value_unit"].alias("unit"), c["value_approx"].alias("approx"))


@add("select event_id, round(value / 7 * 100, 2) / 100 as conf, case when value > 0 then value / (1 + event_id % 3) end as sigma, value - 1.5 as low, value + 1.5 as high, substr(sha256(event_type || event_id), 1, 12) as digest from events")
def numbers_and_digests(spark, sf):
    e, v = users(spark, sf), F.col("value")
    around = values.interval(v, F.lit(1.5))
    return e.select("event_id", values.rounded_confidence(v / 7).alias("conf"), values.sigma(v, 1 + F.col("event_id") % 3).alias("sigma"), around[0].alias("low"), around[1].alias("high"), values.digest12(F.concat("event_type", F.col("event_id").cast("string"))).alias("digest"))


@add("select event_id, unnest(['flag', 'a:b', 'a:b:' || event_type, ':x']) as tag, unnest(['flag', 'a', 'a', '']) as key, unnest([null, 'b', 'b:' || event_type, 'x']) as value from events")
def tag_parsing(spark, sf):
    tags = F.array(F.lit("flag"), F.lit("a:b"), F.concat(F.lit("a:b:"), "event_type"), F.lit(":x"))
    rows = users(spark, sf).select("event_id", F.explode(tags).alias("tag"))
    return rows.select("event_id", "tag", values.split_tag(F.col("tag")).alias("t")).select("event_id", "tag", "t.key", "t.value")


@add("select event_id, case when event_id % 2 = 0 then 'http://x.example/a b' else 'notes/' || event_type end as source, case when event_id % 3 > 0 then (event_id % 9 + 1)::int end as start, case event_id % 3 when 1 then (event_id % 9 + 1)::int when 2 then (event_id % 9 + 4)::int end as \"end\", case when event_id % 2 = 0 then 'http://x.example/a%20b' || case event_id % 3 when 1 then '#L' || (event_id % 9 + 1) || '-L' || (event_id % 9 + 1) when 2 then '#L' || (event_id % 9 + 1) || '-L' || (event_id % 9 + 4) else '' end end as href from events")
def source_spans(spark, sf):
    """Sources with and without lines, web addresses as links; malformed ones are left out."""
    n = F.col("event_id")
    path = F.when(n % 2 == 0, "http:%2F%2Fx.example%2Fa%20b").otherwise(F.concat(F.lit("notes%2F"), "event_type"))
    lines = F.when(n % 3 == 1, F.concat(F.lit("#L"), n % 9 + 1)).when(n % 3 == 2, F.concat(F.lit("#L"), n % 9 + 1, F.lit("-L"), n % 9 + 4)).otherwise("")
    contexts = F.array(F.lit("scope:eu"), F.concat(F.lit("src:"), path, lines), F.lit("src:x#L9-L3"), F.lit("src:y#Lx"))
    return users(spark, sf).select("event_id", F.explode(values.sources(contexts)).alias("s")).select("event_id", "s.*")


# --- search ---

PLAIN = "(' ' || regexp_replace(lower(strip_accents(text)), '[^\\p{L}\\p{N}]+', ' ', 'g') || ' ')"


@add(f"select doc_id from documents where {PLAIN} like '% etre %'")
def search_folded(spark, sf):
    """Marks on letters make no difference, in the text or in the phrase."""
    return star.table(spark, sf, "documents").where(sync.has_phrase(F.col("text"), "Être", True)).select("doc_id")


@add(f"select doc_id from documents where ({PLAIN} like '% the %' and {PLAIN} like '% idi%') or ({PLAIN} like '% rights reserved %' and not {PLAIN} like '% und %')")
def search_raw(spark, sf):
    """A boolean search with a beginning, a phrase, and what must not stand."""
    return star.table(spark, sf, "documents").where(sync.matching(F.col("text"), 'the AND idi* OR ("rights reserved" NOT und)')).select("doc_id")


# --- sources and sinks ---


def claim_texts(spark: SparkSession, sf: str) -> DataFrame:
    """A document for each order: its claim with all kinds of metadata, a condition, a reason, a continuation and a nested claim."""
    o = star.table(spark, sf, "orders")
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    price = F.format_string("%.2f", F.col("o_totalprice"))
    lines = [
        F.concat(F.lit("order/"), k, F.lit(" HAS price: "), price, F.lit(" USD +/- 5 (3 sigma) @scope:eu #rush #kind:"), "o_orderstatus", F.lit(" @ 75% ! ; seen")),
        F.concat(F.lit("  WHEN load > "), k, F.lit("ms")),
        F.lit("  BECAUSE audit"),
        F.concat(F.lit("  PLACED-BY customer/"), c),
        F.lit("; a comment"),
        F.concat(F.lit("order/"), k, F.lit(" PART-OF customer/"), c),
        F.concat(F.lit('x IS "two words"')),
    ]
    return o.select(k.alias("path"), F.concat_ws("\n", *lines).alias("text"))


@add("""
select o_orderkey::varchar as path, 1 as line, 'order/' || o_orderkey as subject, 'HAS' as verb, null as object, 'price' as attribute, round(o_totalprice, 2) as value_num, 'USD' as value_unit, 0.75::double as conf, 'scope:eu' as contexts, 'rush=,kind=' || o_orderstatus as tags, 5.0::double as delta_num, 3.0::double as sigma_level, true as importance, 'seen' as comment from orders
union all select o_orderkey::varchar, 2, 'load', 'EXCEEDS', null, null, o_orderkey::double, 'ms', 1.0, '', '', null, 2.0, false, null from orders
union all select o_orderkey::varchar, 3, 'audit', 'EXISTS', null, null, null, null, 1.0, '', '', null, 2.0, false, null from orders
union all select o_orderkey::varchar, 4, 'order/' || o_orderkey, 'PLACED-BY', 'customer/' || o_custkey, null, null, null, 1.0, '', '', null, 2.0, false, null from orders
union all select o_orderkey::varchar, 6, 'customer/' || o_custkey, 'CONTAINS', 'order/' || o_orderkey, null, null, null, 1.0, '', '', null, 2.0, false, null from orders
union all select o_orderkey::varchar, 7, 'x', 'IS', '"two words"', null, null, null, 1.0, '', '', null, 2.0, false, null from orders
""")
def text_claims(spark, sf):
    """Claim text with metadata, qualifiers, a continuation, an inverse verb and a comment, parsed strictly."""
    c = text.parse_table(claim_texts(spark, sf), strict=True)
    tags = F.array_join(F.transform("tags", lambda t: F.concat(t["key"], F.lit("="), F.coalesce(t["value"], F.lit("")))), ",")
    return c.select("path", "line", "subject", "verb", "object", "attribute", "value_num", "value_unit", "conf", F.array_join("contexts", ",").alias("contexts"), tags.alias("tags"), "delta_num", "sigma_level", "importance", "comment")


@add("select o_orderkey::varchar as path, unnest([1, 1]) as parent, unnest(['WHEN', 'BECAUSE']) as role, unnest([2, 3]) as child from orders")
def text_edges(spark, sf):
    """The edges of qualifiers: from the claim above to the claim that they hold."""
    return text.edges_table(claim_texts(spark, sf))


@add("select * from (values ('PART-OF', 'CONTAINS'), ('USED-BY', 'USES'), ('CAUSED-BY', 'CAUSE'), ('REQUIRED-BY', 'REQUIRES'), ('PRODUCED-BY', 'PRODUCES'), ('OWNED-BY', 'OWNS'), ('FOLLOWS', 'PRECEDES'), ('SUPPORTED-BY', 'SUPPORTS'), ('LIKED-BY', 'LIKES'), ('EMPLOYS', 'USES')) t(verb, stored)")
def registry_fold(spark, sf):
    """Declarations replayed in order of tx: the first wins, conflicts, cycles and children of conditions change nothing."""
    rows = [("LIKES", "REVERSE", "LIKED-BY"), ("LIKES", "REVERSE", "OTHER"), ("USES", "RENAMED-TO", "EMPLOYS"), ("EMPLOYS", "RENAMED-TO", "USES"), ("HATES", "REVERSE", "HATED-BY")]
    df = spark.createDataFrame([(keys.tx_bound(i), *r) for i, r in enumerate(rows)], "tx string, subject string, verb string, object string")
    edges = spark.createDataFrame([("p", "WHEN", keys.tx_bound(4))], "parent_id string, role string, child_id string")
    r = fold(star.star(spark, sf).where("verb in ('REVERSE', 'RENAMED-TO')").unionByName(conform(df)), edges)
    return spark.createDataFrame([*r.inverses.items(), *r.renames.items()], "verb string, stored string")


@add("select c_custkey::varchar as c_custkey, c_name, c_acctbal::varchar as c_acctbal from customer")
def csv_scan(spark, sf):
    """Through CSV and back, by Spark's reader."""
    at = new_path(spark, "csv")
    c = star.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal").withColumns({x: F.col(x).cast("string") for x in ("c_custkey", "c_acctbal")})
    c.write.csv(at, header=True)
    return records.read_csv(spark, at)


@add("select s_name as name, 'two\nlines \"' || s_suppkey || '\"' as note, 3::int as lines from supplier")
def tsv_spans(spark, sf):
    """Whole files with the lines of each record: quoted line breaks and quotes, a blank line, a short row."""
    at = new_path(spark, "tsv")
    rows = star.table(spark, sf, "supplier").select(F.format_string('%s\t"two\nlines ""%d"""', F.col("s_name"), F.col("s_suppkey")).alias("value"))
    rows.select(F.concat(F.lit("name\tnote\n\n"), "value", F.lit("\nshort")).alias("value")).repartition(F.col("value")).write.text(at, lineSep="\x00")
    got = records.read_csv(spark, at, "\t", spans=True).where("path is not null")
    found = got.select("start", "end", F.explode(F.array("fields")).alias("f")).select("start", "end", F.replace(F.col("f")["name"], F.lit("\x00"), F.lit("")).alias("name"), F.replace(F.col("f")["note"], F.lit("\x00"), F.lit("")).alias("note"))
    return found.where("name like 'Supplier%'").select("name", "note", (F.col("end") - F.col("start") + 2).cast("int").alias("lines"))


@add("select n_name, n_nationkey, n_regionkey from nation")
def json_scan(spark, sf):
    """An array at a dot path of one JSON document."""
    at = new_path(spark, "json")
    n = star.table(spark, sf, "nation")  # 25 rows
    doc = n.agg(F.to_json(F.struct(F.struct(F.sort_array(F.collect_list(F.struct(*n.columns))).alias("records")).alias("data"))).alias("value"))
    doc.write.text(at)
    return records.read_json(spark, at, "data.records").select("n_name", "n_nationkey", "n_regionkey")


@add("select o_orderkey, o_custkey, o_totalprice from orders")
def jsonl_scan(spark, sf):
    at = new_path(spark, "jsonl")
    star.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice").write.json(at)
    return records.read_jsonl(spark, at, "o_orderkey long, o_custkey long, o_totalprice double")


@add("select s_name as path, (row_number() over (order by s_name) - 1) // 7 as batch from supplier")
def file_batches(spark, sf):
    """A listing in batches of at most seven."""
    return records.batches(star.table(spark, sf, "supplier").select(F.col("s_name").alias("path")), 7).select("path", "batch")


@add(events("select tx, subject, claim_key from k"))
def snapshot_restored(spark, sf):
    """Saved, verified, restored elsewhere, and loaded."""
    store = Store(spark, star.events(spark, sf), star.edges(spark, sf))
    at, to = new_path(spark, "store"), new_path(spark, "restored")
    m = store.save(at)
    again = Store.restore(spark, at, m["version"], to, m["sha256"])
    return Store.load(spark, to, again["version"]).claims.select("tx", "subject", "claim_key")


@add(events("select tx, subject from k"))
def store_append(spark, sf):
    """Two batches that overlap: rows that are here already are left out."""
    c = star.events(spark, sf)
    return Store.empty(spark).append(c.where(num() % 3 != 0)).append(c.where(num() % 2 == 0)).append(c.where(num() % 3 == 0)).claims.select("tx", "subject")


@add(events(", le as (select p.tx as parent_id, q.tx as child_id from c p join c q on p.event_id = q.event_id * 2 + 1) select parent_id, child_id from le"))
def edges_append(spark, sf):
    """Edges told twice count once."""
    e = star.edges(spark, sf)
    return Store.empty(spark).append_edges(e).append_edges(e).edges.select("parent_id", "child_id")


@add("select 'nation/' || n_name as subject, 'IN' as verb, 'region/' || replace(r_name, ' ', '-') as object, 0.9::double as conf, 'src:atlas' as contexts from nation join region on n_regionkey = r_regionkey union all select 'kept', 'IS', 'thing', 1.0, ''")
def transaction_rollback(spark, sf):
    """A text is ingested with its source; what a failed savepoint added is gone, what came before and after it stays."""
    n = star.table(spark, sf, "nation").join(star.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 rows
    lines = [f"nation/{r['n_name']} IN region/{'-'.join(r['r_name'].split())} @ 90%" for r in n.collect()]
    with Store.empty(spark).transaction() as t:
        t.ingest("\n".join(lines), source="atlas")
        try:
            with t.savepoint():
                t.ingest("gone IS thing")
                t.ingest("no claim at all", strict=True)
        except ValueError:
            t.ingest("kept IS thing")
    return t.store.claims.select("subject", "verb", "object", "conf", F.array_join("contexts", ",").alias("contexts"))


@add(events("select tx, subject, attribute, value_num from cur"))
def sync_annotated(spark, sf):
    """Annotated text of all current rows, exported and synced twice into an empty store: rows keep their ids. A line and its id are a document."""
    c = belief.current(star.events(spark, sf))
    store = Store(spark, c, spark.createDataFrame([], EDGE))
    docs = staged(spark, store.export(ceiling="restricted", with_tx=True).select(F.col("tx").alias("path"), F.col("line").alias("text")), "annotated")
    once, problems = Store.empty(spark).synced_table(docs)
    if (found := problems.first()) is not None:
        raise AssertionError(found)
    return once.synced_table(docs)[0].claims.select("tx", "subject", "attribute", "value_num")


@add("select 'class ' || upper(substr(t, 1, 1)) || substr(t, 2) || ':' as line from (values ('party'), ('site')) v(t) union all select unnest(['    name: str', '    account_balance: float', '    places: list[str]', '    name: str', '    owner: list[str]'])")
def client_module(spark, sf):
    """The classes of a generated client, and their fields."""
    rows = [("party", "EXPECTS", "PLACES", None, None), ("party", "EXPECTS", "account-balance", "cardinality", "one"), ("site", "EXPECTS", "owner", None, None)]
    df = declared(spark, rows)
    more = df.withColumn("tags", F.when(F.col("object") == "account-balance", F.concat("tags", F.array(F.struct(F.lit("unit").alias("key"), F.lit("EUR").alias("value"))))).otherwise(F.col("tags")))
    source, _ = report.client(star.star(spark, sf).unionByName(more))
    return spark.createDataFrame([(x,) for x in source.splitlines() if x.startswith(("class", "    "))], "line string")


@add(relations("select '| ' || object || ' |' as line from rel where verb = 'CONTAINS' and subject = 'region/ASIA' union all select '| n |' union all select '|-|' union all select 'Nations: ' || (select string_agg(object, ', ' order by object) from rel where verb = 'CONTAINS' and subject = 'region/ASIA')"))
def report_rendered(spark, sf):
    """A report with a query block and a splice."""
    c = staged(spark, star.star(spark, sf).where("verb = 'CONTAINS' and subject like 'region/%'"), "report")
    out = report.render("Nations: {{region/ASIA CONTAINS ?n}}\n```query\nregion/ASIA CONTAINS ?n\n```", lambda q: query(spark, c, q, Options(bindings_only=True)))
    return spark.createDataFrame([(x,) for x in out.splitlines() if x], "line string")


# --- policies, fusion, scenarios ---


@add(events(f", {RANKED} select tx, subject, attribute, conf from q where rank = 1"))
def policy_read(spark, sf):
    """The policy of `resolved_winners`, read from claims: numbers, shares in per cent, and what is ignored."""
    rows = [("source/sensor", "precedence", 2.0, None), ("source/sensor", "reliability", 50.0, "%"), ("source/sensor/click", "precedence", 3.0, None), ("source/sensor/click", "reliability", 0.8, None), ("source/audit", "precedence", 5.0, None), ("source/audit", "reliability", 0.9, None), ("source/cli", "precedence", 9.0, "x"), ("source/agent", "reliability", 7.0, None)]
    df = spark.createDataFrame([(keys.tx_bound(i), s, a, n, u) for i, (s, a, n, u) in enumerate(rows)], "tx string, subject string, attribute string, value_num double, value_unit string").withColumns({"verb": F.lit("HAS"), "contexts": F.array(F.lit("src:cli"))})
    c = star.events(spark, sf)
    return resolve.winners(c, resolve.read_policy(c.unionByName(conform(df)))).select("tx", "subject", "attribute", "conf")


PAIRS = "('user/' || (user_id - user_id % 2))"


@add(events(f", {RANKED}, p as (select *, row_number() over (partition by {PAIRS}, attribute, array_to_string(list_sort(list_filter(contexts, lambda x: x[1:4] <> 'src:')), ',') order by class desc, weight desc, tx desc) as place from q) select tx, place::int as rank from p where place = 1"))
def resolved_with_aliases(spark, sf):
    """Users of two neighbouring numbers are one: their facts compete."""
    c = star.events(spark, sf)
    u = users(spark, sf).select("user_id").distinct()
    reps = u.select(F.concat(F.lit("user/"), "user_id").alias("name"), F.concat(F.lit("user/"), F.col("user_id") - F.col("user_id") % 2).alias("rep"))
    return resolve.ranked(c, list(POLICY), reps).where("rank = 1").select("tx", "rank")


@add("select 'low' as name, min(c_acctbal::decimal(18,2))::varchar as value from customer where c_acctbal > 9900 union all select 'high', max(c_acctbal::decimal(18,2))::varchar from customer where c_acctbal > 9900 union all select 'total', sum(c_acctbal::decimal(18,2))::varchar from customer where c_acctbal > 9900 union all select 'rate', '0.10'")
def scenario_bound(spark, sf):
    """Inputs bound from claims in exact decimals, and a default."""
    c = star.star(spark, sf).where("attribute = 'account-balance'")
    what = "?c HAS account-balance: _\nWHERE value > 9900"
    inputs = [scenario.Input(n, what, p) for n, p in (("low", "min"), ("high", "max"), ("total", "sum"))]
    found = scenario.bind(spark, c, [*inputs, scenario.Input("rate", "?c HAS rate: _", default="0.1")])
    return spark.createDataFrame([(k, f"{v.numerator * 100 // v.denominator // 100 if v >= 0 else -(-v.numerator // v.denominator)}.{v.numerator * 100 // v.denominator % 100:02d}") for k, v in found.values.items()], "name string, value string")


TIMED = "t as (select subject, tx, conf, value_num as x, 1 + event_id % 5 as s, case when event_id % 2 = 0 then 'ms' else 's' end as unit, case when event_id % 2 = 0 then 1 else 1000 end as f from c where conf > 0 and value_num is not null)"


@add(events(f", {TIMED}, p as (select subject, sum(conf / (s * f * s * f) * x * f) as wx, sum(conf / (s * f * s * f)) as w, arg_min(unit, tx) as unit, arg_min(f, tx) as f, count(*) as n from t group by 1) select subject, round(wx / w / f, 6) as mean, round(1 / sqrt(w) / f, 6) as sigma, unit, n from p"))
def fuse_durations(spark, sf):
    """Durations in milliseconds and in seconds, fused in the unit of the first that came."""
    even = num() % 2 == 0
    rows = star.events(spark, sf).withColumns({"delta_num": 2.0 * (1 + num() % 5), "sigma_level": F.lit(2.0), "value_unit": F.when(even, "ms").otherwise("s")})
    out = resolve.fuse(resolve.estimate_columns(rows.withColumn("delta_unit", F.col("value_unit"))), ["subject"])
    return out.select("subject", F.round("mean", 6).alias("mean"), F.round("sigma", 6).alias("sigma"), "unit", "n")


PROFILE = "concat_ws('|', o_custkey, o_orderstatus, trim(o_orderpriority))"


@add(f"select distinct 'profile' as kind, sha256({PROFILE}) as digest, {PROFILE} as body from orders")
def artifact_records(spark, sf):
    """Profiles of all orders by their digests: the same artifact again changes nothing, another body under its digest is refused."""
    body = F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderstatus", F.trim("o_orderpriority"))
    new = star.table(spark, sf, "orders").select(F.lit("profile").alias("kind"), F.sha2(body, 256).alias("digest"), body.alias("body"))
    a = staged(spark, scenario.record_all(spark.createDataFrame([], new.schema), new), "artifacts")
    try:
        scenario.record_all(a, new.withColumn("body", F.concat("body", F.lit("!"))))
    except ValueError:
        return scenario.record_all(a, new)
    raise AssertionError("another body was taken")


# --- shapes ---


@add("select * from (values ('party', 'PLACES', 'relation', 'one', null), ('party', 'account-balance', 'attribute', null, 'EUR'), ('party', 'PART-OF', 'relation', null, null), ('party', 'IS-IN', 'relation', null, null)) t(type, property, kind, cardinality, unit)")
def expectations(spark, sf):
    return shape.expectations(shaped(spark, sf))


@add(relations("select a.rep, x.subject as name, y.subject as name_b, x.v as value, y.v as value_b from (select 'supplier/' || s_suppkey as subject, (s_acctbal * 2)::bigint as v from supplier) x join reps a on x.subject = a.name join (select 'vendor/' || s_suppkey as subject, (s_acctbal * 2)::bigint + s_suppkey % 2 as v from supplier) y on true join reps b on y.subject = b.name and a.rep = b.rep where x.v <> y.v union all select a.rep, x.subject, y.subject, x.v, y.v from (select 'vendor/' || s_suppkey as subject, (s_acctbal * 2)::bigint + s_suppkey % 2 as v from supplier) x join reps a on x.subject = a.name join (select 'vendor/' || s_suppkey as subject, (s_acctbal * 2)::bigint + s_suppkey % 2 as v from supplier) y on x.subject < y.subject join reps b on y.subject = b.name and a.rep = b.rep where x.v <> y.v union all select a.rep, x.subject, y.subject, x.v, y.v from (select 'supplier/' || s_suppkey as subject, (s_acctbal * 2)::bigint as v from supplier) x join reps a on x.subject = a.name join (select 'supplier/' || s_suppkey as subject, (s_acctbal * 2)::bigint as v from supplier) y on x.subject < y.subject join reps b on y.subject = b.name and a.rep = b.rep where x.v <> y.v", ALIASES))
def disagreements(spark, sf):
    """Names of one thing that say different balances."""
    s = star.table(spark, sf, "supplier")

    def told(kind: int, prefix: str, num) -> DataFrame:
        return s.select(*star.metric(kind, F.col("s_suppkey"), star.name(prefix, "s_suppkey"), "balance", num.cast("double")))

    twice = F.rint(F.col("s_acctbal") * 2).cast("long")  # halves to even, as SQL casts
    rows = told(16, "supplier", twice).unionByName(told(17, "vendor", twice + F.col("s_suppkey") % 2))
    c = star.star(spark, sf).where("verb = 'ALIAS'").unionByName(conform(rows))
    value = lambda c: F.regexp_replace(c, r"\|.*", "").cast("double").cast("long")
    out = shape.disagreements(c, closure.representatives(spark, c))
    return out.select("rep", "name", "name_b", value(F.col("value")).alias("value"), value(F.col("value_b")).alias("value_b"))


@add("select 'customer/' || c_custkey as entity, 'account-balance' as property, 'missing' as problem from customer where c_acctbal < 0 union all select 'supplier/' || s_suppkey, p, 'missing' from supplier, (values ('PLACES'), ('account-balance'), ('IS-IN')) v(p)")
def gate_rejects(spark, sf):
    """A change is refused, with those violations alone that are new: balances below zero are withdrawn, and suppliers become parties. What it
    does not touch is not counted again. A change of others' balances is taken."""
    store = Store(spark, shaped(spark, sf), spark.createDataFrame([], EDGE))
    balances = star.star(spark, sf).where("attribute = 'account-balance'")
    gone = balances.where("value_num < 0").withColumn("conf", F.lit(0.0))
    parties = star.table(spark, sf, "supplier").select(star.name("supplier", "s_suppkey").alias("subject"), F.lit("IS").alias("verb"), F.lit("party").alias("object"))
    same, found = store.gated_rows(gone.unionByName(conform(parties), allowMissingColumns=True))
    after, none = store.gated_rows(balances.where("value_num >= 0").withColumn("value_num", F.col("value_num") + 1))
    if same is not store or none is not None or after is store:
        raise AssertionError("the gate let pass what it must not, or not what it must")
    return found.select("entity", "property", "problem")


# --- alias discovery ---

NAMES = """
nm as (select 'customer/' || lower(c_mktsegment) || '-' || substr(md5(c_custkey::varchar), 1, 6) as name from customer
  union select 'client/' || replace(lower(c_mktsegment), 'n', 'm') || '-' || substr(md5(c_custkey::varchar), 1, 6) from customer where c_custkey % 3 = 0
  union select upper(substr(md5(c_custkey::varchar), 1, 6)) || '/' || lower(c_mktsegment) from customer where c_custkey % 5 = 0
  union select 'supplier-' || substr(md5('s' || s_suppkey), 1, 8) || 'unit' from supplier
  union select 'supplier_' || substr(md5('s' || s_suppkey), 1, 8) || 'units' from supplier),
d as (select name, regexp_replace(lower(name), '[-_./]+', '', 'g') as norm, list_distinct(list_filter(regexp_split_to_array(lower(name), '[-_./]+'), lambda x: x <> '')) as tokens from nm),
pr as (select a.name as a, b.name as b, a.norm as na, b.norm as nb, a.tokens as ta, b.tokens as tb, len(list_intersect(a.tokens, b.tokens)) as common, least(len(a.norm), len(b.norm)) as short, greatest(len(a.norm), len(b.norm)) as long from d a join d b on a.name < b.name
  where substr(a.norm, 1, 1) = substr(b.norm, 1, 1) or (least(len(a.norm), len(b.norm)) >= 5 and right(a.norm, 4) = right(b.norm, 4)) or list_has_any(a.tokens, b.tokens)),
sg as (select *, regexp_replace(na, '[0-9]+', '', 'g') = regexp_replace(nb, '[0-9]+', '', 'g') as digits, list_filter(ta, lambda x: not list_contains(tb, x)) as la, list_filter(tb, lambda x: not list_contains(ta, x)) as lb from pr),
sc as (select a, b, greatest(
    case when na = nb then 1.0 else 0 end,
    case when na <> nb and common = least(len(ta), len(tb)) and len(ta) = len(tb) then 0.9 else 0 end,
    case when na <> nb and common = least(len(ta), len(tb)) and len(ta) <> len(tb) and short >= 3 then 0.7 else 0 end,
    case when na <> nb and not digits and short >= 4 and (starts_with(na, nb) or starts_with(nb, na)) then short / long else 0 end,
    case when na <> nb and not digits and short >= 5 and 1 - levenshtein(na, nb) / long >= 0.75 and (len(la) = 0 or len(lb) = 0
      or case when len(la) <= len(lb) then len(list_filter(la, lambda x: len(list_filter(lb, lambda y: 1 - levenshtein(x, y) / greatest(len(x), len(y)) >= 0.75)) > 0)) = len(la)
         else len(list_filter(lb, lambda x: len(list_filter(la, lambda y: 1 - levenshtein(x, y) / greatest(len(x), len(y)) >= 0.75)) > 0)) = len(lb) end) then 1 - levenshtein(na, nb) / long else 0 end)::double as score from sg)
"""


def named(spark: SparkSession, sf: str) -> DataFrame:
    """Names of customers and suppliers as several hands may have written them."""
    c, s = star.table(spark, sf, "customer"), star.table(spark, sf, "supplier")
    segment, code = F.lower("c_mktsegment"), F.substring(F.md5(F.col("c_custkey").cast("string").cast("binary")), 1, 6)
    unit = F.substring(F.md5(F.concat(F.lit("s"), "s_suppkey").cast("binary")), 1, 8)
    out = c.select(F.concat(F.lit("customer/"), segment, F.lit("-"), code).alias("name"))
    out = out.union(c.where("c_custkey % 3 = 0").select(F.concat(F.lit("client/"), F.replace(segment, F.lit("n"), F.lit("m")), F.lit("-"), code)))
    out = out.union(c.where("c_custkey % 5 = 0").select(F.concat(F.upper(code), F.lit("/"), segment)))
    return out.union(s.select(F.concat(F.lit("supplier-"), unit, F.lit("unit")))).union(s.select(F.concat(F.lit("supplier_"), unit, F.lit("units")))).distinct()


@add(f"with {NAMES} select a, b, round(score, 9) as score from sc where score >= 0.7")
def alias_suggest(spark, sf):
    """All pairs that spelling suggests, against all pairs compared in SQL."""
    return suggest.suggest(named(spark, sf)).select("a", "b", F.round("score", 9).alias("score"))


CODES = "select c_custkey as k, c_nationkey as n, c_acctbal as bal, c_mktsegment as seg, substr(md5('a' || c_custkey), 1, 16) as a, substr(md5('b' || c_custkey), 1, 16) as b from customer"


@add(f"with codes as ({CODES}), s as (select b as entity, a as canonical, 0.8 + 0.1 * (1 + (k % 3 <> 0)::int) as score from codes where bal > 0 and k % 7 not in (1, 2)) select entity, canonical, round(score::double, 9) as score, least(0.5, round(score * 50) / 100)::double as confidence from s")
def alias_suggestions(spark, sf):
    """Over current beliefs, of customers under two names that nothing in their spelling joins: those with one line (a value that two names
    have) are suggested, the stronger the more neighbours they share. Decided and related pairs are left out."""
    code = lambda prefix, c: F.substring(F.md5(F.concat(F.lit(prefix), F.col(c).cast("string")).cast("binary")), 1, 16)
    c = star.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"), code("a", "c_custkey").alias("a"), code("b", "c_custkey").alias("b"), code("n", "c_nationkey").alias("nation"), code("s", "c_mktsegment").alias("segment"))
    rest = F.col("k") % 7
    line = F.concat(F.lit("line-"), F.col("k").cast("string"))

    def row(subject: str, verb: str, obj=None, attribute: str | None = None, value=None, conf: float = 1.0):
        text = F.lit(None).cast("string")
        return F.struct(F.col(subject).alias("subject"), F.lit(verb).alias("verb"), (text if obj is None else F.col(obj)).alias("object"), F.lit(attribute).cast("string").alias("attribute"), (text if value is None else value).alias("value_text"), F.lit(conf).alias("conf"))

    some = star.some(
        *[(F.lit(True), row(x, "HAS", attribute="phone", value=F.when((F.col("bal") > 0) | (F.lit(x) == "a"), line).otherwise(F.concat(line, F.lit("-b"))))) for x in "ab"],
        *[(F.lit(True), row(x, "LIES-IN", "nation")) for x in "ab"],
        (F.lit(True), row("a", "SERVES", "segment")),
        ((F.col("k") % 3 != 0), row("b", "SERVES", "segment")),
        (F.lit(True), row("a", "HAS", attribute="note", value=F.concat(F.lit("note "), line))),
        (F.lit(True), row("a", "HAS", attribute="mark", value=F.concat(F.lit("mark "), line))),
        (rest == 1, row("a", "ALIAS", "b", conf=0.0)),
        (rest == 2, row("b", "KNOWS", "a")),
    )
    rows = c.select("k", F.posexplode(some).alias("i", "r")).select(keys.uuid7(F.lit(star.EPOCH + 30), F.col("k") * 20 + F.col("i")).alias("tx"), "r.*")
    out = suggest.suggestions(spark, staged(spark, conform(rows), "codes"), 0.75)
    return out.select("entity", "canonical", F.round("score", 9).alias("score"), "confidence")


# --- rules, triggers, actions ---

TWO_RULES = ["?a REPORTS-TO ?b => ?a KNOWS ?b", "?a KNOWS ?b, ?b KNOWS ?c => ?a MET ?c"]


@add(f"select 'rule/' || substr(sha256(t), 1, 12) as subject, t as text, i = 2 as due from (values (1, '{TWO_RULES[0]}'), (2, '{TWO_RULES[1]}')) v(i, t)")
def rule_lifecycle(spark, sf):
    """Three rules are declared, two of them twice, and one is retracted; a mark keeps the first from being due until rows come that
    its premise may match."""
    store = Store.empty(spark).add(star.star(spark, sf).where("verb = 'REPORTS-TO'"))
    rows, three = rules.declare(spark, store.claims, [*TWO_RULES, "?a IS ?b => ?a WAS ?b"])
    store = store.add(rows)
    again, _ = rules.declare(spark, store.claims, TWO_RULES)
    store = store.add(rules.retracted(store.claims, three[2].name[:6]))
    store = store.add(rules.mark_rows(spark, three[:1], store.claims.agg(F.max("tx")).first()[0]))
    held, problems = rules.listed(store.claims)
    due = {r.subject for r in rules.due(store.claims, held, rules.marks(store.claims))}
    if problems or again.count():
        raise AssertionError("a declared rule is no rule, or was declared again")
    return spark.createDataFrame([(r.subject, r.text, r.subject in due) for r in held], "subject string, text string, due boolean")


KNOWS = f"e as ({{}}), two as (select a.src, b.src as mid, b.dst from e a join e b on a.dst = b.src)"


def supported_store(spark: SparkSession, sf: str) -> Store:
    """Who reports to whom, with a rule of one hop and a rule on top of it, derived with their support."""
    store = Store.empty(spark).append(star.star(spark, sf).where("verb = 'REPORTS-TO'"))
    store = Store(spark, tabled(spark, store.claims, "reports"), store.edges)
    store = store.add(rules.declare(spark, store.claims, ["?a REPORTS-TO ?b => ?a KNOWS ?b", "?a KNOWS ?b, ?b REPORTS-TO ?c => ?a MET ?c"])[0])
    store, found = store.derive()
    if not found.complete:
        raise AssertionError(found)
    return store


def said_of(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(F.col("id").alias(name), F.concat_ws(" ", "subject", "verb", "object").alias(f"{name}_line"))


@add(relations("select 'BECAUSE' as role, src || ' KNOWS ' || dst as conclusion, src || ' REPORTS-TO ' || dst as reason from e union all select 'BECAUSE', src || ' MET ' || dst, src || ' KNOWS ' || mid from two union all select 'BECAUSE', src || ' MET ' || dst, mid || ' REPORTS-TO ' || dst from two union all select 'VIA', src || ' KNOWS ' || dst, 'first' from e union all select distinct 'VIA', src || ' MET ' || dst, 'second' from two", KNOWS.format(REPORTS)))
def support_edges(spark, sf):
    """What each conclusion rests on, conclusions of the same run included, and its rule."""
    store = supported_store(spark, sf)
    first = rules.parse_rule("?a REPORTS-TO ?b => ?a KNOWS ?b").subject
    e = store.edges.join(said_of(store.claims, "parent_id"), "parent_id").join(said_of(store.claims, "child_id"), "child_id")
    rule = F.when(F.col("child_id_line").startswith(first), "first").otherwise("second")
    return e.select("role", F.col("parent_id_line").alias("conclusion"), F.when(F.col("role") == "VIA", rule).otherwise(F.col("child_id_line")).alias("reason"))


KEPT = REPORTS + " and (try_cast(split_part(subject, '/', 2) as int) % 10 <> 7)"


@add(relations("select src as subject, 'KNOWS' as verb, dst as object from e union select src, 'MET', dst from two", KNOWS.format(KEPT)))
def support_maintained(spark, sf):
    """A tenth of the reports are withdrawn: only what rests on them is put in question, and what still follows stays."""
    store = supported_store(spark, sf)
    gone = store.claims.where("verb = 'REPORTS-TO'").where(F.substring_index("subject", "/", -1).cast("int") % 10 == 7)
    before = belief.current(store.claims).where("verb in ('KNOWS', 'MET') and conf > 0").count()
    store, found = store.add(gone.withColumn("conf", F.lit(0.0))).derive()
    if not found.complete or not 0 < found.touched < before / 2:
        raise AssertionError(f"{found.touched} of {before} were put in question")
    return belief.current(store.claims).where("verb in ('KNOWS', 'MET') and conf > 0").select("subject", "verb", "object")


@add(events(f", a as (select *, (event_id % 4 = 0) as infra from cur where attribute = 'click' and {POS}), b as (select * from cur where attribute = 'error' and {POS}) select a.subject as u, a.tx as x, b.tx as y from a join b using (subject) where (a.tx > {BOUND} and not a.infra) or b.tx > {BOUND}"))
def automation_events(spark, sf):
    """Rows of the engine's own bookkeeping are no events: every fourth click is one, and fires nothing by itself."""
    c = star.events(spark, sf)
    own = (F.col("attribute") == "click") & (num() % 4 == 0)
    c = c.withColumn("contexts", F.when(own, F.array_append("contexts", F.lit("src:automate"))).otherwise(F.col("contexts")))
    out = rules.triggered(spark, c, ["?u HAS click: _", "?u HAS error: _"], half(spark, sf))
    return out.select("u", F.col("ids")[0].alias("x"), F.col("ids")[1].alias("y"))


@add("select 'customer/' || c_custkey as subject, 'level' as attribute, trim(c_mktsegment) as value_text, 'src:action/promote' as contexts from customer where c_acctbal > 0 and c_custkey % 2 = 0")
def action_effects(spark, sf):
    """An action for many calls at once, as joins of its preconditions with them: customers without a positive balance have no binding; what
    is so already is not appended again."""
    c = star.table(spark, sf, "customer")
    key = star.name("customer", "c_custkey")
    tiers = c.select(keys.uuid7(F.lit(1), F.col("c_custkey")).alias("tx"), key.alias("subject"), F.lit("HAS").alias("verb"), F.lit("tier").alias("attribute"), F.trim("c_mktsegment").alias("value_text"))
    good = c.where("c_acctbal > 0").select(keys.uuid7(F.lit(2), F.col("c_custkey")).alias("tx"), key.alias("subject"), F.lit("IS").alias("verb"), F.lit("solvent").alias("object"))
    done = c.where("c_custkey % 2 = 1").select(keys.uuid7(F.lit(3), F.col("c_custkey")).alias("tx"), key.alias("subject"), F.lit("HAS").alias("verb"), F.lit("level").alias("attribute"), F.trim("c_mktsegment").alias("value_text"), F.array(F.lit("src:action/promote")).alias("contexts"))
    claims = conform(tiers).unionByName(conform(good)).unionByName(conform(done))
    action = rules.parse_action("promote", "?who, ?who IS solvent, ?who HAS tier: ?t => ?who HAS level: ?t")
    rows, refused = automate.effects(spark, claims, action, c.select(key.alias("call"), key.alias("who")))
    if refused.where("why not like 'no binding%'").limit(1).count():
        raise AssertionError("a call has more than one binding")
    new = rules.reply_rows(claims, rows.drop("call"), "src:action/promote")
    return new.select("subject", "attribute", "value_text", F.array_join("contexts", ",").alias("contexts"))


def automated(spark: SparkSession, sf: str, automations: dict[str, str], actions: dict[str, str]) -> Store:
    """The events' claims, with automations and actions declared before all of them."""
    store = Store.empty(spark, clock=lambda: 1000)
    for texts, attribute in ((automations, automate.AUTOMATION), (actions, automate.ACTION)):
        store = store.add(automate.declare(spark, store.claims, texts, attribute))
    return store.append(star.events(spark, sf), minted=True)


CASCADE = "two as (select distinct a.subject from (select subject from cur where attribute = 'click' and not negated and conf > 0) a join (select subject from cur where attribute = 'error' and not negated and conf > 0) b using (subject)), rich as (select distinct subject from cur where attribute = 'purchase' and not negated and conf > 0)"


@add(events(f", {CASCADE} select subject, 'flagged' as what, 1 as round from two union all select subject, 'call', 2 from two join rich using (subject)"))
def automation_cascade(spark, sf):
    """Two rounds: users who click and err are flagged; flagged users who bought are to be called. A third pass finds nothing more."""
    store = automated(spark, sf, {"flag": "?u HAS click: _, ?u HAS error: _ => action/flag", "call": "?u HAS mark: flagged, ?u HAS purchase: _ => action/call"}, {"flag": "?u => ?u HAS mark: flagged", "call": "?u => ?u NEEDS call"})
    out = automate.settle(store, derive=False, check=False)
    if not out.ok or out.notes or min(out.fired.values()) == 0:
        raise AssertionError(f"it did not settle: {out.outcomes} {out.notes}")
    rows = belief.current(out.store.claims.where("attribute = 'mark' or verb = 'NEEDS'")).where("conf > 0")
    flagged = F.col("attribute") == "mark"
    return rows.select("subject", F.when(F.coalesce(flagged, F.lit(False)), "flagged").otherwise("call").alias("what"), F.when(F.coalesce(flagged, F.lit(False)), 1).otherwise(2).alias("round"))


@add(events("select subject, attribute, round(case when event_id % 2 = 0 then conf else 0.11 end, 9) as conf from cur where event_id % 2 = 1 and abs(conf - 0.11) >= 1e-9"))
def agent_reply(spark, sf):
    """A reply that tells all current beliefs again, half of them otherwise: only these are appended."""
    c = belief.current(star.events(spark, sf)).withColumn("contexts", F.array_union("contexts", F.array(F.lit("src:automation/x"))))
    held = conform(c.drop("claim_key"))
    reply = held.withColumn("conf", F.when(num() % 2 == 0, F.col("conf")).otherwise(F.lit(0.11))).withColumn("contexts", F.array_remove("contexts", "src:automation/x"))
    return rules.reply_rows(held, reply, "src:automation/x").select("subject", "attribute", F.round("conf", 9).alias("conf"))


# --- text with edges ---


@add("""
with c as (select c_custkey as k, 'customer/' || c_custkey as s, trim(c_mktsegment) as seg from customer),
l as (
  select k, 0 as part, s || ' NEEDS care' as line from c where k % 5 = 0
  union all select k, 1, '  WHEN ' || s || ' IS awake' from c where k % 5 = 0
  union all select k, 2, '  BECAUSE ' || s || ' HAS tier: ' || seg from c where k % 5 = 0
  union all select k, 0, s || ' HAS tier: ' || seg from c where k % 5 <> 0)
select line, row_number() over (order by k, part) as place from (select line, part, k + case when k % 5 = 0 then 1000000000 else 0 end as k from l)
""")
def export_edges(spark, sf):
    """Lines below what they qualify. The reason was told again later, so its edge goes to the newer row; a second edge to it is one."""
    c = star.table(spark, sf, "customer")
    s = star.name("customer", "c_custkey")
    five = c.where("c_custkey % 5 = 0")
    at = lambda ms: keys.uuid7(F.lit(ms), F.col("c_custkey")).alias("tx")
    tier = lambda rows, ms: conform(rows.select(at(ms), s.alias("subject"), F.lit("HAS").alias("verb"), F.lit("tier").alias("attribute"), F.trim("c_mktsegment").alias("value_text")))
    head = conform(five.select(at(3), s.alias("subject"), F.lit("NEEDS").alias("verb"), F.lit("care").alias("object")))
    when = conform(five.select(at(4), s.alias("subject"), F.lit("IS").alias("verb"), F.lit("awake").alias("object")))
    claims = tier(c, 1).unionByName(head).unionByName(when).unionByName(tier(five, 5))
    edge = lambda role, ms: five.select(at(3).alias("parent_id"), F.lit(role).alias("role"), at(ms).alias("child_id"))
    edges = edge("WHEN", 4).union(edge("BECAUSE", 1)).union(edge("BECAUSE", 5))
    lines = Store(spark, claims, edges).text()
    return lines.select("line", F.row_number().over(Window.orderBy("path")).cast("long").alias("place"))


# --- connect ---


@add("select 'customer/' || c_custkey as subject, 'LIVES-IN' as verb, 'nation/' || c_nationkey as object, null as attribute, null as value_num from customer where c_nationkey % 2 = 0 union all select 'customer/' || c_custkey, 'HAS', null, 'balance', c_acctbal from customer")
def connect_nested(spark, sf):
    """Fields by dot paths; a line whose field is missing is left out."""
    from tenet.operators.connect import mapped, parse_template

    c = star.table(spark, sf, "customer")
    r = c.select("c_custkey", F.struct(F.when(F.col("c_nationkey") % 2 == 0, F.col("c_nationkey")).alias("nation"), F.struct(F.col("c_acctbal").alias("now")).alias("balance")).alias("at"))
    out = mapped(r, parse_template("customer/?c_custkey LIVES-IN nation/?at.nation\ncustomer/?c_custkey HAS balance: ?at.balance.now"), "crm", ["c_custkey"])
    return out.select("subject", "verb", "object", "attribute", "value_num")


@add("select 'missing' as what, 'customer/' || c_custkey as c from customer where c_custkey % 3 = 0 and c_custkey % 5 <> 0 union all select 'unexpected', 'customer/' || c_custkey from customer where c_custkey % 5 = 0 and c_custkey % 3 <> 0")
def solutions_compare(spark, sf):
    """What a query should find and does not, and the other way round."""
    c = star.table(spark, sf, "customer").select(star.name("customer", "c_custkey").alias("c"), "c_custkey")
    missing, unexpected = sync.compare(c.where("c_custkey % 3 <> 0").select("c"), c.where("c_custkey % 5 <> 0").select("c"))
    return missing.select(F.lit("missing").alias("what"), "c").union(unexpected.select(F.lit("unexpected").alias("what"), "c"))


# --- search ---


def indexed(spark: SparkSession, sf: str) -> index.Index:
    """Customers' names and segments, and parts' names as comments, in an index that two refreshes made."""
    c, p = star.table(spark, sf, "customer"), star.table(spark, sf, "part")
    customers = conform(c.select(keys.uuid7(F.lit(1), F.col("c_custkey")).alias("tx"), star.name("customer", "c_custkey").alias("subject"), F.lit("IN").alias("verb"), F.lower("c_mktsegment").alias("value_text")))
    parts = conform(p.select(keys.uuid7(F.lit(2), F.col("p_partkey")).alias("tx"), star.name("part", "p_partkey").alias("subject"), F.lit("IS").alias("verb"), F.col("p_name").alias("comment")))
    return index.Index(spark, new_path(spark, "index")).refresh(customers).refresh(customers.unionByName(parts))


SEGMENT_WORDS = "list_filter(regexp_split_to_array(lower(c_mktsegment), '[^a-z0-9]+'), lambda w: w <> '')"


@add(f"select 'customer/' || c_custkey as subject from customer where (list_contains({SEGMENT_WORDS}, 'building') or len(list_filter({SEGMENT_WORDS}, lambda w: starts_with(w, 'auto'))) > 0) and c_custkey % 10 <> 0 and c_custkey <> 7 and c_custkey > 0")
def search_index(spark, sf):
    """A boolean search by postings: segments by a word or a beginning, without customer 7; ids that end in 0 are left to the caller."""
    hits = indexed(spark, sf).search("(building OR auto*) NOT \"customer 7\"")
    key = F.conv(F.substring("id", -12, 12), 16, 10).cast("long")
    return hits.where(key % 10 != 0).select(F.concat(F.lit("customer/"), key).alias("subject"))


# --- streams, run to their end over tables ---


def fed(spark: SparkSession, sf: str) -> str:
    """The events as a folder to which three batches were appended, the newest first: later batches hold older rows."""
    at = new_path(spark, "feed")
    c = star.events(spark, sf)
    for k in range(3):
        c.where(num() % 3 == 2 - k).select(*CLAIM.names).write.mode("append").parquet(f"{at}/{k}")
    return at


@add(events("select tx, claim_key, conf from cur"))
def stream_current(spark, sf):
    """Current beliefs kept by a stream: a row that comes late does not displace a newer one."""
    at, to, mark = fed(spark, sf), new_path(spark, "kept"), new_path(spark, "marks")
    feed.keep_current(feed.appended(spark, f"{at}/*", 2), to, mark).awaitTermination()
    return feed.kept(spark, to, feed.newest(spark, to)).select("tx", "claim_key", "conf")


@add(events(f", a as (select subject, tx from cur where attribute = 'click' and {POS}), b as (select subject, tx from cur where attribute = 'error' and {POS}) select a.subject as u, a.tx as x, b.tx as y from a join b using (subject) where a.tx > {BOUND} or b.tx > {BOUND}"))
def stream_triggers(spark, sf):
    """Solutions that cite new rows, once for each batch, after the batch is noted."""
    at, out = new_path(spark, "feed"), new_path(spark, "fired")
    star.events(spark, sf).select(*CLAIM.names).write.parquet(f"{at}/0")

    def act(found: DataFrame, number: int) -> None:
        found.select("u", F.col("ids")[0].alias("x"), F.col("ids")[1].alias("y")).write.mode("append").parquet(out)

    for _ in range(2):  # the second run has nothing new
        feed.on_events(feed.appended(spark, f"{at}/*"), f"{at}/*", ["?u HAS click: _", "?u HAS error: _"], act, f"{at}-check", half(spark, sf), f"{at}-marks").awaitTermination()
    return spark.read.parquet(out)


@add(events(f"select subject as u, tx as x, 1::bigint as times from cur where attribute = 'click' and {POS}"))
def stream_late_events(spark, sf):
    """One file a batch, the newest rows first and one file delivered twice: each row is an event once, in the batch that brings it."""
    at, out, c = new_path(spark, "feed"), new_path(spark, "fired"), belief.current(star.events(spark, sf)).select(*CLAIM.names)
    c = staged(spark, c, "current")
    for k, part in enumerate((2, 1, 2, 0)):
        c.where(num() % 3 == part).coalesce(1).write.parquet(f"{at}/{k}")

    def act(found: DataFrame, number: int) -> None:
        found.select("u", F.col("ids")[0].alias("x")).write.mode("append").parquet(out)

    feed.on_events(feed.appended(spark, f"{at}/*", 1), f"{at}/*", ["?u HAS click: _"], act, f"{at}-check", keys.tx_bound(0), f"{at}-ledger").awaitTermination()
    return spark.read.parquet(out).groupBy("u", "x").agg(F.count("*").alias("times"))


@add("select date_trunc('hour', ts) as start, event_type as verb, count(*) as rows from events group by 1, 2")
def stream_windows(spark, sf):
    """Rows by the hour of their transaction, as a stream with a watermark would count them."""
    c = star.events(spark, sf).withColumn("verb", F.col("attribute"))
    return feed.windowed(c).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "verb", "rows")


# --- kept tables ---


def halves(spark: SparkSession, sf: str) -> list[DataFrame]:
    """The events, the later half first."""
    c, bound = star.events(spark, sf), half(spark, sf)
    return [c.where(F.col("tx") >= bound), c.where(F.col("tx") < bound)]


@add(events("select tx, subject, attribute, value_num, conf, claim_key from cur"))
def maintained_current(spark, sf):
    """Current beliefs kept by appends, the older half of which comes late, and then all of it once more: read without a shuffle."""
    table = maintained.Beliefs(spark, new_path(spark, "beliefs"))
    for batch in (*halves(spark, sf), star.events(spark, sf)):
        table.append(batch)
    return table.current().select("tx", "subject", "attribute", "value_num", "conf", "claim_key")


SEEN = "le as (select a.tx as parent_id, b.tx as child_id, greatest(a.sensitivity, b.sensitivity) as rank from c a join c b on a.event_id = b.event_id * 2 + 1)"


@add(events(f", {SEEN}, ceilings(ceiling, most) as (values ('public', 0), ('internal', 1), ('restricted', 3)) select ceiling, parent_id, child_id from le join ceilings on rank <= most union all select ceiling, tx, null from c join ceilings on sensitivity <= most"))
def scoped_views(spark, sf):
    """What three ceilings see, rows and edges, from one table: all edges come with the later half, many before the rows of their ends."""
    table, (late, early) = maintained.Views(spark, new_path(spark, "views")), halves(spark, sf)
    table.append(late, star.edges(spark, sf))
    table.append(early)
    out = None
    for ceiling in ("public", "internal", "restricted"):
        rows, edges = table.view(ceiling)
        seen = edges.select(F.lit(ceiling).alias("ceiling"), "parent_id", "child_id").unionByName(rows.select(F.lit(ceiling).alias("ceiling"), F.col("id").alias("parent_id"), F.lit(None).cast("string").alias("child_id")))
        out = seen if out is None else out.unionByName(seen)
    return out
