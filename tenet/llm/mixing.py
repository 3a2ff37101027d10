"""Mixing sources to target weights, in DataFrame operations alone.

Documents get hash-random keys; inside each source they are ordered by key. A source's budget is cut exactly: every document is
taken budget / source size times in full, and those at the head of the order once more, the last of them in part. Where the
head ends is one key a source. It is found by distributed prefix sums: sizes are summed by ranges of the key's leading bits,
prefix sums over a source's ranges tell the one where its budget ends, and prefix sums over that range's keys alone tell the
key. Documents are then taken or cut where they lie: no text is shuffled, and none is sorted.

Targets: sources in code point order, null last, have the weights 3, 1, 2, repeating, of share x all sizes. A target stops at
cap x its source's size, and the excess goes to the others by weight until none is above. That level is found in closed form:
sources sorted by cap / weight are full from the front, and the rest share what remains.

Sizes and keys are found in one reading of the texts and staged, narrow; all sums read that. `mix_rows` reads the texts once more, to
take them. The tables of ranges and cuts have one row a source. They are broadcast while there are at most MOST_SOURCES of them,
counted first; beyond that they are joined by source.

Cases: null text has size 0, like an empty one; a source of nothing but such texts has target 0. Null is a source of its own.
Keys are hashes of doc_id and text, so rows are ordered alike in every run. Rows equal in both are counted together, and where a
cut falls on them they share what remains evenly, each the same; so a source's taken words fall short of its budget by fewer
than there are such rows. An empty table gives an empty result. Other columns are ignored by `mix_plan`, and carried by
`mix_rows`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenet.llm.common import WORD, staged

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2.0
#: Hexadecimal digits of the key that make a range: 4096 ranges a source, whose sums one task puts in order.
RANGE_DIGITS = 3
#: Cuts of at most so many sources are broadcast.
MOST_SOURCES = 10_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """For a table (source, source_size): its target. One row a source meets in a task, never one a document."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.select("source", "source_size", weight.cast("double").alias("weight"), (F.col("source_size") * F.lit(cap)).alias("most"))
    full = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before, after = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    t = t.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") < F.col("most"))
    # Once a source is below its cap, so are all after it, at the same level.
    at = F.min(F.when(F.col("open"), F.struct((F.col("most") / F.col("weight")).alias("ratio"), F.col("level").alias("level")))).over(everything)
    target = F.when(at.isNull() | ((F.col("most") / F.col("weight")) < at["ratio"]), F.col("most")).otherwise(F.least(at["level"] * F.col("weight"), F.col("most")))
    return t.select("source", "source_size", target.alias("target"))


def keyed(docs: DataFrame, doc_id: str, text: str, source: str, seed: str) -> DataFrame:
    """docs with source_, size_ and key_ for its own columns of these names."""
    mixed = F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    return docs.select("*", F.col(source).alias("source_"), n_words(F.col(text)).alias("size_"), F.md5(mixed.cast("binary")).alias("key_"))


def few(rows: DataFrame) -> DataFrame:
    """A staged table of a row a source, broadcast if that is safe."""
    return F.broadcast(rows) if rows.count() <= MOST_SOURCES else rows


def cuts(rows: DataFrame, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """For each source of rows (source_, size_, key_): source_size, target, whole (times that every document is taken), cut (the key
    where the rest of the budget ends, null where it ends nowhere) and here (words that each row of that key gives)."""
    same = lambda a, b: F.col(f"{a}.source_").eqNullSafe(F.col(f"{b}.source_"))
    part = F.substring("key_", 1, RANGE_DIGITS)
    spark = rows.sparkSession
    ranges = staged(spark, rows.groupBy("source_", part.alias("range")).agg(F.sum("size_").alias("n")), "ranges")
    sizes = ranges.groupBy(F.col("source_").alias("source")).agg(F.sum("n").alias("source_size"))
    whole = F.floor(F.floor("target") / F.greatest("source_size", F.lit(1)))
    targets = source_targets(sizes, weights, share, cap).withColumnRenamed("source", "source_").withColumn("whole", whole)
    targets = targets.withColumn("rest", F.floor("target") - F.col("whole") * F.col("source_size"))
    before = Window.partitionBy("source_").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    last = ranges.alias("r").join(targets.alias("t"), same("r", "t")).where("rest >= start and rest < start + n")
    last = few(staged(spark, last.select("r.source_", "range", "start", "rest"), "last"))
    # One range a source: its keys, those of equal rows once.
    inside = rows.select("source_", "size_", "key_", part.alias("range")).alias("d").join(last.alias("r"), same("d", "r") & (F.col("d.range") == F.col("r.range")))
    inside = inside.groupBy("d.source_", "key_", "size_", "start", "rest").agg(F.count("*").alias("copies"))
    within = Window.partitionBy("source_").orderBy("key_").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("left", F.col("rest") - F.col("start") - F.coalesce(F.sum(F.col("size_") * F.col("copies")).over(within), F.lit(0)))
    ends = inside.where("left >= 0 and left < size_ * copies").select("source_", F.col("key_").alias("cut"), F.floor(F.col("left") / F.col("copies")).alias("here"))
    return targets.alias("t").join(ends.alias("e"), same("t", "e"), "left").select("t.source_", "source_size", "target", "whole", "rest", "cut", "here")


def taken(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows with source_size, target and taken_."""
    table = few(staged(rows.sparkSession, table, "cuts"))
    out = rows.alias("d").join(table.alias("t"), F.col("d.source_").eqNullSafe(F.col("t.source_")))
    # Where the budget ends at no key, what is left of it is zero or all of the source's size.
    more = F.when(F.col("cut").isNull(), F.when(F.col("rest") >= F.col("source_size"), F.col("size_")).otherwise(0))
    more = more.when(F.col("key_") < F.col("cut"), F.col("size_")).when(F.col("key_") == F.col("cut"), F.col("here")).otherwise(0)
    return out.select("d.*", "source_size", "target", (F.col("whole") * F.col("size_") + more).cast("long").alias("taken_"))


def mix_plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, taken: how many words of each document the mix takes, repeats counted."""
    rows = keyed(docs.select("doc_id", "source", "text"), "doc_id", "text", "source", seed).select("doc_id", "source_", "size_", "key_")
    rows = staged(docs.sparkSession, rows, "sizes")
    table = cuts(rows, weights, share, cap)
    return taken(rows, table).select("doc_id", F.col("source_").alias("source"), F.col("size_").alias("size"), "source_size", "target", F.col("taken_").alias("taken"))


def mix_rows(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = "mix") -> DataFrame:
    """The mix itself: each document once for every time it is taken in full, and once more cut after the words that remain.

    A document of no words stays once where its source is taken at all, for it costs nothing."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = keyed(docs.toDF(*names.values()), names["doc_id"], names["text"], names["source"], seed)
    size, text = F.col("size_"), F.col(names["text"])
    narrow = staged(docs.sparkSession, rows.select("source_", "size_", "key_"), "sizes")
    rows = taken(rows, cuts(narrow, weights, share, cap))
    times = F.when(size == 0, F.lit(1)).otherwise(F.ceil(F.col("taken_") / F.greatest(size, F.lit(1))).cast("int"))
    rows = rows.withColumn("times", times).where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    here = F.least(size, F.col("taken_") - (F.col("copy") - 1) * size)
    words = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"))
    cut = F.when(here >= size, text).otherwise(F.array_join(F.slice(words, F.lit(1), F.greatest(here, F.lit(1)).cast("int")), ""))
    return rows.withColumn(names["text"], cut).select(*names.values()).toDF(*docs.columns)
