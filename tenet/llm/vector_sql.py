"""SQL of the operators whose rounds SQL can spell out one after the other, and of repeated bytes."""

from __future__ import annotations


def kept_components(scale: int) -> str:
    """Table `x`: integer components of whole vectors."""
    return f"""
with e as (select vec_id, label, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as pos, len(embedding) as n from embeddings),
odd as (select distinct vec_id from e where x is null or not isfinite(x)),
x as materialized (select vec_id, label, pos, n, floor({scale} * x::double)::bigint as v from e where vec_id not in (select vec_id from odd))"""


def codes_sql(parts: int = 16, width: int = 64, entries: int = 64, rounds: int = 2) -> str:
    size = width // parts
    out = kept_components(256) + f""",
c as materialized (select vec_id, label, pos // {size} as part, pos % {size} as place, v from x),
b0 as materialized (
  select part, entry, place, v as c
  from c join (select vec_id, row_number() over (order by vec_id) - 1 as entry from (select distinct vec_id from c)) using (vec_id) where entry < {entries})"""
    for r in range(rounds + 1):
        out += f""",
d{r} as (select vec_id, part, entry, sum((v - c) * (v - c))::bigint as d from c join b{r} using (part, place) group by all),
a{r} as materialized (select vec_id, part, (min((d, entry)))[1] as d, (min((d, entry)))[2] as entry from d{r} group by all)"""
        if r < rounds:
            out += f""",
m{r} as (select part, entry, place, floor(sum(v)::double / count(*))::bigint as c from c join a{r} using (vec_id, part) group by all),
b{r + 1} as materialized (select part, entry, place, coalesce(m{r}.c, b{r}.c) as c from b{r} left join m{r} using (part, entry, place))"""
    return out + f""",
f as (select vec_id, string_agg(printf('%02x', entry), '' order by part) as code, sum(d)::bigint as error from a{rounds} group by vec_id)
select f.vec_id, code, error, label, (sum(error) over (partition by label))::bigint as label_error,
       (select sha256(string_agg(c::varchar, ',' order by part, entry, place)) from b{rounds}) as codebooks_sha256
from f join (select distinct vec_id, label from c) using (vec_id)
"""


def clusters_sql(width: int = 64, clusters: int = 8, rounds: int = 10) -> str:
    out = kept_components(1024) + f""",
c as materialized (select vec_id, pos, v from x where n = {width}),
b0 as materialized (
  select cluster, pos, v as c
  from c join (select vec_id, row_number() over (order by sha256('3:' || vec_id)) - 1 as cluster from (select distinct vec_id from c)) using (vec_id) where cluster < {clusters})"""
    for r in range(rounds + 1):
        out += f""",
d{r} as (select vec_id, cluster, sum((v - c) * (v - c))::bigint as d from c join b{r} using (pos) group by all),
a{r} as materialized (select vec_id, (min((d, cluster)))[1] as distance, (min((d, cluster)))[2] as cluster from d{r} group by all)"""
        if r < rounds:
            out += f""",
m{r} as (select cluster, pos, floor(sum(v)::double / count(*))::bigint as c from c join a{r} using (vec_id) group by all),
b{r + 1} as materialized (select cluster, pos, coalesce(m{r}.c, b{r}.c) as c from b{r} left join m{r} using (cluster, pos))"""
    return out + f""",
h as (select cluster, sha256(string_agg(c::varchar, ',' order by pos)) as centroid_sha256 from b{rounds} group by cluster)
select vec_id, cluster::int as cluster, distance, (sum(distance) over (partition by cluster))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia, centroid_sha256
from a{rounds} join h using (cluster)
"""


#: Starts in a document of a smaller id, joined into runs; what lies between runs is kept.
REPEATED = """
with d as materialized (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents),
w as materialized (select r, doc_id, p, substr(h, 2 * p + 1, 100) as s from (select r, doc_id, h, unnest(range(n - 49)) as p from d where n >= 50)),
f as (select s, min(doc_id) as low from w group by s),
g as (select r, p, lag(p) over (partition by r order by p) as q from w join f using (s) where low < doc_id),
k as (select r, p, sum((q is null or p - q > 50)::int) over (partition by r order by p) as run from g),
u as (select r, run, min(p) as first, max(p) + 50 as stop from k group by r, run),
b as (select u.r, run, first, stop, coalesce(lag(stop) over (partition by u.r order by run), 0) as before, h from u join d using (r)),
t as (select r, sum(stop - first)::bigint as n_removed, count(*) as n_spans, string_agg(substr(h, 2 * before + 1, 2 * (first - before)), '' order by run) as head, max(stop) as stop from b group by r)
select doc_id, n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
       sha256(unhex(coalesce(head || substr(h, 2 * stop + 1), h))) as kept_sha256
from d left join t using (r)
"""
