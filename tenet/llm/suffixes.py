"""Removal of repeated byte strings across documents, by distributed prefix doubling.

A byte goes if some string of `threshold` bytes that covers it also starts in a document of a smaller id. Of equal texts only one row is searched.

A rank tells strings of one length apart, and sorts them. Positions that no other document shares are out before they are sorted:
* Each string of `threshold` bytes contains a sampled position, its anchor: that of its short string of least hash (the first of equal
  ones), modulo the number of places that an anchor of `anchor_size` bytes can have in it. So equal strings have equal anchors at the same place, and
  where an anchor is longer than that number, fewer places are sampled than by the least of the anchors themselves. Neighbouring starts with one anchor
  make a block, a text of less than two thresholds. Only blocks stay whose anchor's bytes occur in several documents: tasks deal the anchors' hashes
  over ranges, packed, each once from a group of texts, and the places of those that meet again, or stand in several texts of a group, go back to
  the groups, whose blocks are kept in bytes.
* Equal blocks are one, with the smallest id among its documents: all other documents lose all of it. A block whose anchor occurs in no
  other block needs no more. The others are cut into parts of up to PART starts, by the distance from their anchor; equal parts
  are one again, and a part whose core, the bytes that all its strings share, is in no other part needs no more.
* For the rest Spark sorts the strings of `first` bytes at each position, numbers them in order, and drops those that stand in one
  place only. Ranks of length h and of the position h further on make pairs, whose order is the rank of length 2h, and so on to
  `threshold`: there each class of equal strings has its smallest id, and parts get back the starts of which another part has a smaller one.

Sorts are of distinct strings or pairs, with minima aggregated before they are shuffled, and ranks are joined back by keys that Spark
may split; so a passage of very many documents meets in no single task. Each step is staged in the shared folder, and what nothing
reads any more is deleted. Hashes only choose anchors: what goes is decided by equal bytes (equal texts by sha256).

Cases: null texts are empty. A null id is neither smaller nor larger than any: such rows lose nothing and take nothing. Rows of equal ids
take nothing from each other. Repeated rows get the same result. Texts shorter than the threshold stay. Texts of any length are read whole, a
stretch at a time. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenet.llm.common import Sieve, arrow_sized, delete, numbered, rows_without, stage, staged, text_or_empty

#: Bytes of an anchor, in words of 8: of thresholds from twice as many on, and of others. The longer it is, the fewer strings share it by
#: chance, as ever more do where there are more documents, and the more blocks there are.
ANCHOR, SHORT = 28, 16
#: Bytes of a short string: few of them stand twice in a string of the threshold.
LEAST = 5
#: Bytes of text for a range of the anchors' hashes: some 1.1 million of them. A group has about so many blocks at most.
RANGE, HELD = 1 << 24, 1 << 21
#: Starts of a part: their distances from the anchor have one quotient by it.
PART = 9
#: Bytes that are looked at together, few enough for a processor's cache; a place in a stretch has 20 bits.
STRETCH = 1 << 16
#: Blocks are compared a slice of the anchors at a time, which takes so much less space: equal strings have equal anchors.
SLICES = 2
BLOCK = ["start", "n", "lead", "name"]
PLACE = np.uint64((1 << 20) - 1)
#: The bit of a block's place in its group that tells whether several documents there have its name, and the other bits.
SEVERAL, FIRST = np.uint32(31), np.uint32((1 << 31) - 1)
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD)]


def anchor_size(threshold: int) -> int:
    return ANCHOR if threshold >= ANCHOR + SHORT else SHORT


def short_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the `size` bytes, 8 at most, from each place on."""
    words = np.ndarray((len(data) - size + 1,), "<u8", data.tobytes() + bytes(8 - size), 0, (1,)) << np.uint64(64 - 8 * size)
    h = (words ^ ODD[1]) * ODD[0]
    h ^= h >> np.uint64(31)
    h *= ODD[2]
    h ^= h >> np.uint64(29)
    return h * ODD[0]


def hashes(data: np.ndarray, size: int, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the `size` bytes from each of the places on."""
    words = np.ndarray((len(data) - 7,), "<u8", data.tobytes(), 0, (1,))
    h = words[at] * ODD[0]
    for k in [*range(8, size - 8, 8), size - 8][: (size - 1) // 8]:  # the last word may overlap the one before it
        h ^= (words[at + k] + ODD[1]) * ODD[2]
        h ^= h >> np.uint64(31)
        h *= ODD[0]
    h ^= h >> np.uint64(31)
    h *= ODD[1]
    h ^= h >> np.uint64(29)
    return h


def least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` keys in a row."""
    size = 1
    out = keys
    while 2 * size <= width:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def blocks(data: np.ndarray, ends: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For documents that end at `ends` in data, of each block: document, first start, number of starts, the anchor's distance from the
    first, and its hash. A document's blocks follow each other without a gap."""
    starts = np.concatenate([[0], ends[:-1]])
    size = anchor_size(threshold)
    width = threshold - size + 1
    edges = np.concatenate([starts, ends - threshold + 1])
    edges.sort()
    for begin in range(0, max(0, len(data) - threshold + 1), STRETCH):
        piece = data[begin : begin + STRETCH + threshold - 1]
        short = short_hashes(piece, LEAST)
        keys = (short & ~PLACE) | np.arange(len(short), dtype=np.uint64)
        low = (least(keys, threshold - LEAST + 1) & PLACE).astype(np.int64)
        # Anchors change where the least short string does, where its distance passes a multiple of the width, and where documents begin or end.
        first = np.ones(len(low), bool)
        np.not_equal(low[1:], low[:-1], out=first[1:])
        runs = np.flatnonzero(first)
        stops = np.concatenate([runs[1:], [len(low)]])
        for k in range(1, (threshold - LEAST) // width + 1):
            passed = low[runs] - k * width + 1
            first[passed[(passed > runs) & (passed < stops)]] = True
        first[edges[np.searchsorted(edges, begin) : np.searchsorted(edges, begin + len(low))] - begin] = True
        new = np.flatnonzero(first)
        anchor = new + (low[new] - new) % width
        doc = np.searchsorted(ends, begin + new, side="right")
        inside = begin + new + threshold <= ends[doc]
        own = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])])
        new, anchor, doc, inside = new[own], anchor[own], doc[own], inside[own]
        count = np.diff(np.concatenate([new, [len(low)]]))
        new, anchor, doc, count = new[inside], anchor[inside], doc[inside], count[inside]
        yield doc, begin + new - starts[doc], count, anchor - new, (hashes(piece, size, anchor) * ODD[2]).view(np.int64)


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a batch's texts, and where each ends."""
    parts = texts.to_pylist()
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])


@contextmanager
def little_space(spark: SparkSession):
    """Within it, shuffle files go as soon as their query has ended, tables are written small, and joins whose every measured partition is
    small take hash tables in place of sorts."""
    wanted = {
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
        "parquet.compression.codec.zstd.level": "1",
        "parquet.enable.dictionary#content": "false",  # mostly distinct, as names are
        "parquet.enable.dictionary#name": "false",
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "32m",
    }
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def group_of(found: list[tuple[np.ndarray, ...]], wide: type) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Of blocks in order: their names, each once and in order, with the place of its first block and, in the highest bit, whether several
    documents have it; and the documents, their first starts and numbers of blocks, all blocks' n and lead, and places of later blocks of a name
    with those of its first."""
    doc, start, n, lead, name = map(np.concatenate, zip(*found, strict=True))
    order = np.argsort(name.view(np.uint64)).astype(np.uint32)
    ordered = name.view(np.uint64)[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    at = np.flatnonzero(new)
    first, last = np.minimum.reduceat(order, at), np.maximum.reduceat(order, at)
    several = doc[first] != doc[last]  # documents ascend
    own = np.repeat(first, np.diff(np.concatenate([at, [len(order)]])))
    later = np.stack([order[order != own], own[order != own]])
    runs = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    return (ordered[at], first | (several.astype(np.uint32) << SEVERAL)), (doc[runs], start[runs], np.diff(np.concatenate([runs, [len(doc)]])), np.stack([n, lead]).astype(wide), later)


def sliced(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary value for the values between each two ends."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def dealt(rows: DataFrame, threshold: int, ranges: int) -> DataFrame:
    """For each group of texts a row that has its blocks (range -1), and one for each range that has names of them."""
    bounds = np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)
    wide = np.uint8 if threshold < 256 else np.int32

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            found, size = [], 0
            for each in blocks(*joined(batch.column("text")), threshold):
                found.append(each)
                size += len(each[0])
                if size >= HELD:  # a name of one long text may count twice, which later steps see
                    yield packed(batch, found, number)
                    found, size, number = [], 0, number + 1
            if size:
                yield packed(batch, found, number)
                number += 1

    def packed(batch: pa.RecordBatch, found: list[tuple[np.ndarray, ...]], number: int) -> pa.RecordBatch:
        (names, places), (doc, start, count, shape, later) = group_of(found, wide)
        ends = np.concatenate([[0], np.searchsorted(names, bounds), [len(names)]])
        full = pa.array(np.flatnonzero(np.diff(ends)).astype(np.int32))
        own = pa.array(doc)
        docs = pa.StructArray.from_arrays([batch.column("file").take(own), batch.column("at").take(own), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))], ["file", "at", "start", "count"])
        none = pa.nulls(len(full), pa.binary())
        columns = {
            "group": pa.array(np.full(len(full) + 1, number)),
            "range": pa.concat_arrays([pa.array([-1], pa.int32()), full]),
            "names": pa.concat_arrays([pa.nulls(1, pa.binary()), sliced(names, ends).take(full)]),
            "places": pa.concat_arrays([pa.nulls(1, pa.binary()), sliced(places, ends).take(full)]),
            "docs": pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs), pa.nulls(len(full), pa.list_(docs.type))]),
            "shape": pa.concat_arrays([pa.array([shape.tobytes()]), none]),
            "later": pa.concat_arrays([pa.array([later.tobytes()]), none]),
        }
        return pa.RecordBatch.from_pydict(columns)

    return rows.select("file", "at", "text").mapInArrow(groups, "group long, range int, names binary, places binary, docs array<struct<file: long, at: long, start: int, count: int>>, shape binary, later binary")


def shared(groups: DataFrame, ranges: int) -> DataFrame:
    """group, names and places of the first blocks of names that stand in several documents."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            for k, *row in zip(*(batch.column(c).to_pylist() for c in ("range", "group", "names", "places")), strict=True):
                if k != at and held:
                    yield answered(held)
                    held = []
                held.append(row)
                at = k
        if held:
            yield answered(held)

    def answered(held: list[list]) -> pa.RecordBatch:
        group, names, places = zip(*held, strict=True)
        sizes = [len(x) // 8 for x in names]
        names, places = np.frombuffer(b"".join(names), np.uint64), np.frombuffer(b"".join(places), np.uint32)
        ordered = np.sort(names)
        known = np.unique(np.concatenate([ordered[1:][ordered[1:] == ordered[:-1]], names[places >> SEVERAL > 0]]))
        hit = known[np.minimum(np.searchsorted(known, names), len(known) - 1)] == names if len(known) else np.zeros(len(names), bool)
        ends = np.concatenate([[0], np.cumsum(hit)])[np.cumsum([0, *sizes])]
        full = pa.array(np.flatnonzero(np.diff(ends)))
        return pa.RecordBatch.from_arrays([pa.array(group).take(full), sliced(names[hit], ends).take(full), sliced(places[hit] & FIRST, ends).take(full)], ["group", "names", "places"])

    names = groups.where("range >= 0").select("range", "group", "names", "places")
    # By number, not by its hash: else several ranges may meet in one task, and more of them the more there are.
    return names.repartitionById(ranges, "range").sortWithinPartitions("range").mapInArrow(met, "group long, names binary, places binary")


def shared_names(rows: DataFrame, threshold: int, ranges: int) -> DataFrame:
    """The anchors' hashes that stand in more than one row."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(batch.column("names").to_pylist()), np.int64))], ["name"])

    own = rows.select(F.lit(0).cast("long").alias("file"), F.lit(0).cast("long").alias("at"), "text")
    return shared(dealt(own, threshold, ranges), ranges).select("names").mapInArrow(unpacked, "name long").distinct()


def listed(groups: DataFrame, answers: DataFrame, threshold: int) -> DataFrame:
    """file and at of texts with the list `found` of their blocks of shared anchors; a very long text has several."""
    wide = np.uint8 if threshold < 256 else np.int32

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, shape, later, met in zip(*(batch.column(c) for c in ("docs", "shape", "later", "met")), strict=True):
                yield of_group(docs.values, np.frombuffer(shape.as_py(), wide).reshape(2, -1).astype(np.int32), np.frombuffer(later.as_py(), np.uint32).reshape(2, -1), met.values)

    def of_group(docs: pa.StructArray, shape: np.ndarray, later: np.ndarray, met: pa.StructArray) -> pa.RecordBatch:
        n, lead = shape
        name, hit = np.zeros(len(n), np.int64), np.zeros(len(n), bool)
        places = np.frombuffer(b"".join(met.field("places").to_pylist()), np.uint32)
        name[places], hit[places] = np.frombuffer(b"".join(met.field("names").to_pylist()), np.int64), True
        name[later[0]], hit[later[0]] = name[later[1]], hit[later[1]]
        first, count = (docs.field(c).to_numpy() for c in ("start", "count"))
        ends = np.cumsum(count)
        before = np.concatenate([[0], np.cumsum(n)])
        start = (before[:-1] + np.repeat(first - before[ends - count], count)).astype(np.int32)
        found = np.flatnonzero(hit)
        blocks = pa.StructArray.from_arrays([pa.array(x[found]) for x in (start, n, lead, name)], BLOCK)
        ends = np.concatenate([[0], np.cumsum(hit)[ends - 1]]).astype(np.int32)
        full = pa.array(np.flatnonzero(np.diff(ends)))
        return pa.RecordBatch.from_arrays([docs.field("file").take(full), docs.field("at").take(full), pa.ListArray.from_arrays(pa.array(ends), blocks).take(full)], ["file", "at", "found"])

    met = answers.groupBy("group").agg(F.collect_list(F.struct("names", "places")).alias("met"))
    own = groups.where("range < 0").select("group", "docs", "shape", "later")
    return own.join(met, "group").select("docs", "shape", "later", "met").mapInArrow(lists, "file long, at long, found array<struct<start: int, n: int, lead: int, name: long>>")


def cut(rows: DataFrame, threshold: int) -> DataFrame:
    """file, at, id, start, n, lead, name and content of each block in the list `found` of rows."""

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("found")
            flat, sizes = found.flatten(), np.diff(found.offsets.to_numpy())
            start, n = flat.field("start").to_numpy(), flat.field("n").to_numpy()
            doc = np.repeat(np.arange(batch.num_rows), sizes)
            for i in range(0, len(doc), 50_000):
                part = slice(i, i + 50_000)
                texts, first = {}, doc[part]
                for d in np.unique(first):
                    texts[d] = batch.column("text")[int(d)].as_py()
                content = [texts[d][s : s + k + threshold - 1] for d, s, k in zip(first.tolist(), start[part].tolist(), n[part].tolist(), strict=True)]
                own = pa.array(first)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(own) for c in ("file", "at", "id")], *[flat.field(c).slice(i, len(content)) for c in BLOCK], pa.array(content, pa.binary())], ["file", "at", "id", *BLOCK, "content"])

    return rows.mapInArrow(contents, f"file long, at long, id {rows.schema['id'].dataType.simpleString()}, start int, n int, lead int, name long, content binary")


def with_lists(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """rows joined with the lists of those that have one; few others are shuffled."""
    return Sieve(lists.select("file", "at")).marked(rows).where("may").drop("may").join(lists, ["file", "at"])


def ranked(keys: DataFrame, by: list[str]) -> DataFrame:
    """Distinct keys with `rank`: equal for equal keys alone, and in their order."""
    return keys.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id())


def lengths(first: int, threshold: int) -> list[int]:
    """The lengths whose ranks are made one after the other."""
    out = [min(first, threshold)]
    while out[-1] < threshold:
        out.append(min(2 * out[-1], threshold))
    return out


def needed(ladder: list[int]) -> list[int]:
    """How far from a start the strings of the first length stand that its string of the last length is made of."""
    out = [0]
    for shorter, longer in reversed(list(zip(ladder, ladder[1:], strict=False))):
        out = sorted({*out, *[o + longer - shorter for o in out]})
    return out


def shared_starts(spark: SparkSession, texts: DataFrame, first: int, threshold: int) -> DataFrame:
    """Prefix doubling over short texts (c, low, content) of at most PART starts: c and place for each start of `threshold` bytes that also
    stands in a text of smaller low."""
    ladder = lengths(first, threshold)
    starts = F.length("content") - threshold  # the last of them
    every = F.array_distinct(F.concat(*[F.sequence(F.lit(o), starts + o) for o in needed(ladder)]))
    place = texts.select("c", "low", F.explode(every).alias("place"), "content").select("c", "low", "place", F.expr(f"substring(content, place + 1, {first})").alias("key"))
    by, at_before = ["key"], []
    for turn, length in enumerate(ladder):
        if length == threshold:
            classes = place.groupBy(*by).agg(F.min("low").alias("earlier"), F.max("low").alias("latest")).where("earlier < latest").drop("latest")
            out = staged(spark, place.join(classes, by).where("earlier < low").select("c", "place"), "starts")
            delete(spark, *at_before)
            return out
        several = place.groupBy(*by).agg(F.count("*").alias("times")).where("times > 1")
        at_ranks, ranks = stage(spark, ranked(several, by).drop("times"), "ranks")
        at_places, place = stage(spark, place.join(ranks, by).select("c", "low", "place", "rank"), "places")
        delete(spark, at_ranks, *at_before)
        further = ladder[turn + 1] - length
        # Each start of the next length gets the rank at its place and that further on.
        most = PART - 1 + max(needed(ladder[turn + 1 :]))
        nothing = F.lit(None).cast("long")
        near = place.where(F.col("place") <= most).select("c", "low", "place", F.col("rank").alias("near"), nothing.alias("far"))
        far = place.where(F.col("place") >= further).select("c", "low", F.col("place") - further, nothing, "rank")
        pair = near.union(far).groupBy("c", "low", "place").agg(F.max("near").alias("near"), F.max("far").alias("far")).where("near is not null and far is not null")
        at_pairs, place = stage(spark, pair, "pairs")
        delete(spark, at_places)
        at_before, by = [at_pairs], ["near", "far"]  # read twice
    raise AssertionError


def parts(classes: DataFrame, threshold: int) -> DataFrame:
    """c, low, first and last start, core's hash and content of each part of blocks (c, low, n, lead, content)."""
    width = min(PART, threshold - 1)
    away = F.col("lead") - F.col("number") * width
    rows = classes.withColumn("number", F.explode(F.expr(f"sequence((lead - n + 1) div {width}, lead div {width})").cast("array<int>")))
    rows = rows.select("c", "low", "content", away.alias("away"), F.greatest(F.lit(0), away - (width - 1)).alias("first"), F.least(F.col("n") - 1, away).alias("last"))
    return rows.select("c", "low", "first", "last", F.expr(f"xxhash64(substring(content, away + 1, {threshold - width + 1}))").alias("core"), F.expr(f"substring(content, first + 1, last - first + {threshold})").alias("content"))


def earlier_starts(spark: SparkSession, classes: DataFrame, first: int, threshold: int) -> DataFrame:
    """c, first and last of the starts in blocks (c, low, n, lead, content) that also stand in a block of smaller low."""
    key = F.unhex(F.md5("content")).alias("key")
    at_parts, part = stage(spark, parts(classes, threshold), "parts")
    one = part.groupBy("content").agg(F.min("core").alias("core"), F.min("low").alias("least"), F.max("low").alias("most"))  # equal parts have equal cores
    at_one, one = stage(spark, one.select("*", F.monotonically_increasing_id().alias("p")), "parts")
    several = one.groupBy("core").agg(F.min("least").alias("a"), F.max("least").alias("b")).where("a < b").select("core")
    at_texts, texts = stage(spark, one.join(several, "core", "left_semi").select(F.col("p").alias("c"), F.col("least").alias("low"), "content"), "parts")
    found = shared_starts(spark, texts, first, threshold).groupBy(F.col("c").alias("p")).agg(F.collect_list("place").alias("places"))
    known = one.select(key, "least", "most", "p").join(found, "p", "left").where("most > least or places is not null")
    placed = part.select("c", "low", "first", "last", key).join(known.select("key", "least", "places"), "key").where("low > least or places is not null")
    each = placed.select("c", "first", "last", F.explode(F.when(F.col("low") > F.col("least"), F.array(F.lit(None).cast("int"))).otherwise(F.col("places"))).alias("place"))  # null: all of them
    out = staged(spark, each.select("c", F.expr("first + coalesce(place, 0)").alias("first"), F.expr("coalesce(first + place, last)").alias("last")), "earlier")
    delete(spark, at_parts, at_one, at_texts)
    return out


def kept_bytes(rows: DataFrame, threshold: int) -> DataFrame:
    """digest, n_removed, n_spans and kept_sha256 for rows with the list `gone` of blocks: their starts, and the first and last of the starts
    in them that go."""

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for digest, text, gone in zip(batch.column("digest").to_pylist(), batch.column("text"), batch.column("gone"), strict=True):
                raw = text.as_py()
                ends = np.zeros(len(raw) + 1, np.int64)
                spans = gone.values.field("spans")
                start = np.repeat(gone.values.field("start").to_numpy(), spans.value_lengths().to_numpy())
                spans = spans.flatten()
                np.add.at(ends, start + spans.field("first").to_numpy(), 1)
                np.add.at(ends, start + spans.field("last").to_numpy() + threshold, -1)
                covered = np.cumsum(ends[:-1]) > 0
                runs = int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum())
                kept = np.frombuffer(raw, np.uint8)[~covered].tobytes()
                out.append((digest, int(covered.sum()), runs, sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], ["digest", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(removed, "digest string, n_removed long, n_spans long, kept_sha256 string")


def repeated_bytes(spark: SparkSession, docs: DataFrame, threshold: int = 50, first: int = 25, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept_sha256 of each row."""
    if threshold < SHORT or not 0 < first <= threshold:
        raise ValueError(f"the threshold is {SHORT} bytes at least, the first length no longer")
    arrow_sized(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    with little_space(spark):
        return _repeated(spark, docs, threshold, first, id_column, text_column)


def _repeated(spark: SparkSession, docs: DataFrame, threshold: int, first: int, id_column: str, text_column: str) -> DataFrame:
    rows, names = numbered(spark, docs)
    text = text_or_empty(names[text_column])
    rows = rows.select("file", "at", F.col(names[id_column]).alias("id"), text.cast("binary").alias("text"))
    named = staged(spark, rows.select("file", "at", "id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("digest")), "texts")
    searched = F.col("id").isNotNull() & (F.col("n_bytes") >= threshold)
    heads = staged(spark, named.where(searched).groupBy("digest").agg(F.min(F.struct("id", "file", "at")).alias("head")), "heads")
    out = named.join(heads.select("digest", F.col("head.id").alias("head")), "digest", "left")
    copies = named.join(heads.where("head is not null"), "digest", "left").where("head is null or id is null or file != head.file or at != head.at")
    own = rows_without(rows, staged(spark, copies.select("file", "at"), "copies"))

    ranges = max(1, (named.agg(F.sum("n_bytes")).first()[0] or 0) // RANGE)
    at_groups, groups = stage(spark, dealt(own, threshold, ranges), "groups")
    at_lists, lists = stage(spark, listed(groups, shared(groups, ranges), threshold), "lists")
    delete(spark, at_groups)
    at_blocks, block = stage(spark, cut(with_lists(own, lists), threshold), "blocks")
    delete(spark, at_lists)

    one = block.groupBy("content").agg(F.min("id").alias("low"), F.max("id").alias("high"), *[F.min(c).alias(c) for c in ("name", "n", "lead")])  # equal blocks have equal anchors
    at_classes, one = stage(spark, one.select("*", F.monotonically_increasing_id().alias("c")), "classes")
    earlier = None
    for k in range(SLICES):
        mine = one.where(F.pmod(F.xxhash64("name"), F.lit(SLICES)) == k)
        split = mine.groupBy("name").agg(F.min("low").alias("a"), F.max("low").alias("b")).where("a < b").select("name")
        found = earlier_starts(spark, mine.join(split, "name", "left_semi").select("c", "low", "n", "lead", "content"), first, threshold)
        earlier = found if earlier is None else earlier.union(found)

    key = F.unhex(F.md5("content")).alias("key")
    found = earlier.groupBy("c").agg(F.collect_list(F.struct("first", "last")).alias("found"))
    known = one.select(key, "low", "high", "c").join(found, "c", "left").where("high > low or found is not null")
    placed = block.select("file", "at", "id", "start", "n", key).join(known.select("key", "low", "found"), "key").where("id > low or found is not null")
    whole = F.array(F.struct(F.lit(0).alias("first"), (F.col("n") - 1).alias("last")))
    spans = placed.select("file", "at", F.struct("start", F.when(F.col("id") > F.col("low"), whole).otherwise(F.col("found")).alias("spans")).alias("block"))
    gone = staged(spark, spans.groupBy("file", "at").agg(F.collect_list("block").alias("gone")), "gone")
    delete(spark, at_blocks, at_classes)
    cutout = staged(spark, kept_bytes(with_lists(rows, gone).select(F.sha2("text", 256).alias("digest"), "text", "gone"), threshold), "cutout")

    out = out.join(cutout, "digest", "left")
    copied, changed = F.col("id") > F.col("head"), F.col("id").isNotNull() & F.col("n_removed").isNotNull()
    return out.select(
        F.col("id").alias(id_column),
        "n_bytes",
        F.when(copied, F.col("n_bytes")).when(changed, F.col("n_removed")).otherwise(0).alias("n_removed"),
        F.when(copied, F.lit(1)).when(changed, F.col("n_spans")).otherwise(0).cast("long").alias("n_spans"),
        F.when(copied, F.lit(sha256(b"").hexdigest())).when(changed, F.col("kept_sha256")).otherwise(F.col("digest")).alias("kept_sha256"),
    )
