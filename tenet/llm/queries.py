"""The corpus operators as queries over the documents table; for those that SQL can express, SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenet.llm import clusters, codes, gif, licenses, mixing, packing, pii, quality, sharding, simhash, suffixes, tokenshards, toxicity, vector_sql
from tenet.llm.common import documents, table

#: The rows of SHARDS have equal weights.
SHARDS = 16


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = tokenshards.write_shards(spark, documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))
    return tokenshards.read_back(spark, keys).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir), [1.0] * SHARDS)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(spark, documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))


def op4_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.media_digests(spark, documents(spark, sf_dir))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark, documents(spark, sf_dir))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(spark, docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), toxicity.score_documents(spark, docs, model).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(spark, documents(spark, sf_dir), ["doc_id"])


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark, documents(spark, sf_dir))


def op11_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_bytes(spark, documents(spark, sf_dir))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(spark, table(spark, sf_dir, "embeddings"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(spark, table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_shards, op2_rendezvous_shards, op3_quality_rules, op4_gif_media, op5_simhash_dedup, op6_best_fit_packing, op7_toxicity, op8_source_mix, op9_personal_data, op10_license_scan, op11_repeated_bytes, op12_vector_codes, op13_centroid_clusters, pipeline)}

OP8 = """
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
         md5('mix:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) as key
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as weight, source_size * 2.0::double as most from s),
l as (
  select *, most / weight as ratio,
         (sum(source_size) over () * 1.5::double - coalesce(sum(most) over (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
           / sum(weight) over (order by most / weight, source nulls last rows between current row and unbounded following) as level
  from w),
o as (select min(struct_pack(ratio := ratio, level := level)) as at from l where level * weight < most),
t as (
  select source, source_size,
         case when o.at is null or ratio < o.at.ratio then most else least(o.at.level * weight, most) end as target
  from l cross join o),
g as (select source, key, any_value(size) as size, count(*) as copies from d group by source, key),
p as (
  select g.source, g.key, g.size, g.copies, t.source_size, t.target, floor(t.target)::bigint as budget, floor(t.target)::bigint // greatest(t.source_size, 1) as whole,
         coalesce(sum(g.size * g.copies) over (partition by g.source order by g.key rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from g join t on g.source is not distinct from t.source)
select d.doc_id, d.size, p.source_size, p.target, (p.whole * p.size + greatest(0, least(p.budget - p.whole * p.source_size - p.before, p.size * p.copies)) // p.copies)::bigint as taken
from d join p on d.source is not distinct from p.source and d.key = p.key
"""

SQL: dict[str, str] = {"op8_source_mix": OP8, "op11_repeated_bytes": vector_sql.REPEATED, "op12_vector_codes": vector_sql.codes_sql(), "op13_centroid_clusters": vector_sql.clusters_sql()}
