"""Best-fit packing of token sequences with a swap-based local search.

Documents are encoded, ended with an id, and cut only where longer than a sequence: into full pieces and one shorter first
piece. Full pieces are sequences as they are. The others are dealt by row into groups of bounded size; each is packed
best-fit, longest first, and then improved. The search takes underfull bins as donors, the emptiest first. Of a donor's
documents, alone or by twos, and of every other underfull bin's, alone, by twos or none, it makes the exchange that raises the sum
of squared fills most: one for one, two for one, one for two, or a move. It goes on until the number of bins meets the bound of
the total length, or no exchange of any two bins raises the sum; each raises a bounded sum of integers, so the search ends.

A group has its total's bound to itself, so its last bin may be underfull: with about GROUP pieces a group, one sequence in about
a thousand at the lengths of web documents.

Cases: null text is empty and takes its end id alone. A document of exactly a sequence's length isn't cut. Repeated rows are
packed each; ties go by order of row, which changes no count. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenet.llm.common import arrow_sized, release, spark_type, staged
from tenet.llm.wordcache import encoder

ROOM = 2048
#: Pieces a group, on average.
GROUP = 8192
#: Texts that are encoded together: their words stand in memory as strings, many times the texts' size.
TEXTS = 256
PIECES = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))


def cuts(n: int, room: int = ROOM) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: the first takes what is over."""
    if n <= room:
        return [(0, n)]
    first = n % room or room
    return [(0, first), *((s, room) for s in range(first, n, room))]


def pieces(path: str, end_id: int, room: int = ROOM):
    """A function of a text column: each document's pieces, with checksums of their ids."""

    @F.arrow_udf(spark_type(PIECES))
    def cut(texts: pa.Array) -> pa.Array:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        release()  # what other tasks have left
        enc = encoder(path, "<u4")
        end, out = np.array([end_id], "<u4").tobytes(), []
        for i in range(0, len(texts), TEXTS):
            for ids in enc.encode([t or "" for t in texts.slice(i, TEXTS).to_pylist()]):
                ids += end
                out.append([{"piece": k, "start": s, "length": n, "ids_crc32": zlib.crc32(ids[4 * s : 4 * (s + n)])} for k, (s, n) in enumerate(cuts(len(ids) // 4, room))])
        release()
        return pa.array(out, PIECES)

    return cut


class Bins:
    """Bins of a fixed room; those with room left are found by how much they have."""

    def __init__(self, room: int):
        self.room, self.left, self.held = room, [], []
        self.by_left: list[set[int]] = [set() for _ in range(room + 1)]
        self.mask = 0  # bit r: some bin has r left

    def _out(self, b: int) -> None:
        r = self.left[b]
        self.by_left[r].discard(b)
        if not self.by_left[r]:
            self.mask &= ~(1 << r)

    def _in(self, b: int) -> None:
        r = self.left[b]
        self.by_left[r].add(b)
        self.mask |= 1 << r

    def put(self, b: int, item: int, size: int) -> None:
        self._out(b)
        self.left[b] -= size
        self.held[b].append(item)
        self._in(b)

    def take(self, b: int, item: int, size: int) -> None:
        self._out(b)
        self.left[b] += size
        self.held[b].remove(item)
        self._in(b)

    def new(self) -> int:
        self.left.append(self.room)
        self.held.append([])
        self._in(len(self.left) - 1)
        return len(self.left) - 1

    def tightest(self, size: int) -> int | None:
        """A bin with the least room that is still enough."""
        mask = self.mask >> size
        return next(iter(self.by_left[size + (mask & -mask).bit_length() - 1])) if mask else None


def pack(sizes: list[int], room: int = ROOM) -> list[list[int]]:
    """Bins of item numbers: best fit, longest first, then the local search."""
    bins = Bins(room)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = bins.tightest(sizes[i])
        bins.put(bins.new() if b is None else b, i, sizes[i])
    improve(bins, sizes)
    return [h for h in bins.held if h]


def improve(bins: Bins, sizes: list[int]) -> None:
    """Exchange documents between underfull bins while that raises the sum of squared fills, until bins are empty."""
    least = -(-sum(sizes) // bins.room)
    used = sum(1 for h in bins.held if h)
    if used <= least:
        return
    market = Market(bins, sizes)
    changed = True
    while changed:
        changed = False
        for donor in sorted((b for b, h in enumerate(bins.held) if h and bins.left[b]), key=lambda b: -bins.left[b]):
            while bins.held[donor] and market.exchange(donor):
                changed = True
            if not bins.held[donor]:
                used -= 1
                if used <= least:
                    return


def offers(sizes: list[int], held: list[int]) -> list[tuple[int, int, int]]:
    """(total, document, document or -1) of a bin's documents alone and by twos; those of the same lengths once."""
    by_size: dict[int, list[int]] = {}
    for i in held:
        by_size.setdefault(sizes[i], []).append(i)
    lengths = sorted(by_size)
    out = [(x, by_size[x][0], -1) for x in lengths]
    for k, x in enumerate(lengths):
        if len(by_size[x]) > 1:
            out.append((2 * x, by_size[x][0], by_size[x][1]))
        out += [(x + y, by_size[x][0], by_size[y][0]) for y in lengths[k + 1 :]]
    return out


class Market:
    """What all underfull bins offer in exchange, as arrays: totals, bins, documents. A bin that changes offers anew."""

    def __init__(self, bins: Bins, sizes: list[int]):
        self.bins, self.sizes = bins, sizes
        self.version = np.zeros(len(bins.left), np.int64)
        self.parts: list[np.ndarray] = []
        self.rows = np.zeros((0, 5), np.int64)  # total, bin, document, document or -1, version
        for b in range(len(bins.left)):
            self.put(b)
        self.gather()

    def put(self, b: int) -> None:
        """The bin's offers, and that of nothing; none of empty and of full bins."""
        if self.bins.held[b] and self.bins.left[b]:
            found = [(0, -1, -1), *offers(self.sizes, self.bins.held[b])]
            self.parts.append(np.array([(t, b, i, j, self.version[b]) for t, i, j in found], np.int64))

    def gather(self) -> None:
        rows = np.concatenate([self.rows, *self.parts])
        self.rows, self.parts = rows[rows[:, 4] == self.version[rows[:, 1]]], []

    def exchange(self, donor: int) -> bool:
        """The best exchange of the donor with another bin, if any raises the sum of squared fills."""
        bins, room = self.bins, self.bins.room
        if self.parts:
            self.gather()
        left = np.array(bins.left)[self.rows[:, 1]]
        other = self.rows[:, 1] != donor
        own = room - bins.left[donor]
        best = (0, -1, None)
        for total, i, j in offers(self.sizes, bins.held[donor]):
            moved = total - self.rows[:, 0]
            raises = np.where((moved > 0) & (moved <= left) & other, moved * (room - left + moved - own), 0)
            k = int(raises.argmax()) if len(raises) else 0
            if len(raises) and raises[k] > best[0]:
                best = (int(raises[k]), k, (i, j))
        if best[2] is None:
            return False
        _, b, x, y, _ = self.rows[best[1]].tolist()
        goes = [(donor, b, i) for i in best[2] if i >= 0] + [(b, donor, i) for i in (x, y) if i >= 0]
        for source, _, i in goes:
            bins.take(source, i, self.sizes[i])
        for _, target, i in goes:
            bins.put(target, i, self.sizes[i])
        for changed in (donor, b):
            self.version[changed] += 1
            self.put(changed)
        return True


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 0, room: int = ROOM) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    arrow_sized(spark)
    cut = pieces(tokenizer_path, end_id, room)
    # The outer form: for the plain one the optimizer infers a filter on the pieces, for which every text would be encoded twice.
    rows = docs.select("doc_id", cut("text").alias("p")).select("doc_id", F.explode_outer("p").alias("p")).select("doc_id", "p.*")
    rows = staged(spark, rows.withColumn("row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-rows.where(F.col("length") < room).count() // GROUP))
    short = rows.where(F.col("length") < room).withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("row", ignore_index=True)
        sizes = part["length"].tolist()
        seq, off = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for b, held in enumerate(pack(sizes, room)):
            at = 0
            for i in held:
                seq[i], off[i], at = b, at, at + sizes[i]
        part["sequence_id"], part["offset"] = part["group"] * (1 << 32) + seq, off
        return part[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    # Numbers below zero are for the full pieces.
    full = rows.where(F.col("length") == room).select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.union(short.groupBy("group").applyInPandas(solve, schema))


def sequences(packed: DataFrame) -> DataFrame:
    """A row for each sequence: its length and number of pieces."""
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.count("*").alias("pieces"))


__all__ = ["Bins", "Market", "cuts", "improve", "offers", "pack", "pack_documents", "pieces", "sequences"]
