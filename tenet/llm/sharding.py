"""Sharding by weighted rendezvous hashing.

Every shard scores a record's key; the highest score has the record. A score is -weight / ln(u), where u in (0, 1) comes from
a 64-bit hash of key and shard number, so a shard gets records in proportion to its weight, the place of a record depends on
nothing but its key and the shards, and a further shard takes rows only into itself.

Slots number a shard's rows from 0 without gaps. Equal rows are counted together first, and dealt out again at the end in runs of
at most RUN. Runs are put in small buckets of each shard; prefix sums inside a bucket and over the counts of the buckets before
it give each run its first slot, so neither a shard's rows nor those of one key meet in one task.

Cases: a null key is hashed like any other value, so its rows share a shard (they spread over buckets by checksum). Null text
has size 1 and the checksum of nothing. Repeated rows are numbered apart; which is which makes no difference. An empty table gives
an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenet.llm.common import text_or_empty

#: Buckets of a shard: each holds 1/4096 of its runs of rows.
BUCKETS = 4096
#: Equal rows in a run, at most.
RUN = 1 << 14


def score(key: Column, shard: int, weight: float) -> Column:
    """The shard's score of a key: u is (the hash's upper 53 bits + 1/2) / 2^53."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / float(1 << 53)
    return F.lit(-float(weight)) / F.ln(u)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of highest score (of equal scores, the lowest number)."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("shards need positive weights")
    scores = [score(key, i, w) for i, w in enumerate(weights)]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    out = F.lit(len(scores) - 1)
    for i in range(len(scores) - 2, -1, -1):
        out = F.when(scores[i] == best, F.lit(i)).otherwise(out)
    return out.cast("int")


def shard_documents(docs: DataFrame, weights: Sequence[float], added_weight: float = 1.0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard: the shard that the record has once one more is added."""
    text = text_or_empty(text_column)
    key = F.col("doc_id")
    rows = docs.select(F.col(id_column).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("shard", rendezvous(key, weights))
    # Only the new shard can win over the old winner.
    new, at = score(key, len(weights), added_weight), F.col("shard")
    old = F.lit(None).cast("double")
    for i, w in enumerate(weights):
        old = F.when(at == i, score(key, i, w)).otherwise(old)
    rows = rows.withColumn("grown_shard", F.when(new > old, F.lit(len(weights))).otherwise(at).cast("int"))
    alike = rows.groupBy("doc_id", "size", "text_crc32", "shard", "grown_shard").agg(F.count("*").alias("copies"))
    runs = alike.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(RUN).cast("long"))))
    runs = runs.withColumn("n", F.least(F.lit(RUN).cast("long"), F.col("copies") - F.col("first")))
    runs = runs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "first"), F.lit(BUCKETS)).cast("int"))
    counts = runs.groupBy("shard", "bucket").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size", "first").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("start", F.coalesce(F.sum("n").over(within), F.lit(0))).join(offsets, ["shard", "bucket"])
    each = runs.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    slot = (F.col("offset") + F.col("start") + F.col("i")).cast("long").alias("slot")
    return each.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot, "grown_shard")
