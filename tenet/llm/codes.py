"""Vector code compression: product codes whose codebooks are fitted by Lloyd's rounds, pruned as by Elkan.

A vector is cut into equal parts; each part position has a codebook, and a vector's code is the number of the nearest entry of each.
Beside its code each row keeps, for each part, an upper bound of the distance to its own entry and a lower bound of the distance to every
entry. When entries move, bounds are shifted by how far. An entry is left out only if its lower bound, or half its distance
from the part's own entry, is strictly above the upper bound: it is farther then by the triangle inequality. The others get an exact integer
distance, ties among which go to the lower number. Upper bounds are rounded up, lower ones down to one byte each in steps of their
part's largest 255th, so a row's bounds take about as much space as four such vectors; they are floats, and decide nothing alone.

Each round reads the rows that the last one has staged, with their bounds, and stages them anew; the driver holds the codebooks, of a
fixed size, and gets the exact sums of each entry's parts.

Cases: vectors that are null, or hold null or non-finite components, go; components past the range of `vectors` are taken at its ends. All
others should have one length that the parts divide: the length is that of the smallest id's vector, vectors of other lengths go, and a length that the
parts don't divide raises. Null ids stand after all others. Repeated rows count each; an id that repeats gives one entry, of its
smallest vector. Fewer ids than entries: as many entries as ids. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenet.llm.common import arrow_sized, staged
from tenet.llm.vectors import digest, matrix, pack, packed, totals, whole

#: More than what roots and products of doubles can err by, as a share.
SLACK = 1e-9


class Bounds:
    """A part position's codes and bounds for some rows: `code` (n), `upper` (n), `lower` (n x entries)."""

    def __init__(self, code: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        self.code, self.upper, self.lower = code, upper, lower

    @classmethod
    def first(cls, parts: np.ndarray, entries: np.ndarray) -> Bounds:
        """Every distance taken."""
        d = ((parts[:, None, :] - entries[None, :, :]) ** 2).sum(2)
        code, roots = d.argmin(1), np.sqrt(d.astype(np.float64))  # the first of equal minima
        return cls(code, roots[np.arange(len(d)), code] * (1 + SLACK), roots * (1 - SLACK))

    def shifted(self, movement: np.ndarray) -> Bounds:
        """For entries that have moved by at most so much."""
        return Bounds(self.code, (self.upper + movement[self.code]) * (1 + SLACK), np.maximum(0, self.lower - movement[None, :]) * (1 - SLACK))

    def assigned(self, parts: np.ndarray, entries: np.ndarray, halves: np.ndarray) -> tuple[Bounds, int]:
        """The codes among these entries, of whose mutual distances `halves` holds halves, and how many distances were taken."""
        every = np.arange(len(parts))
        code, upper, lower = self.code.copy(), self.upper.copy(), self.lower.copy()

        def left(rows: np.ndarray) -> np.ndarray:
            out = (lower[rows] <= upper[rows, None]) & (halves[code[rows]] <= upper[rows, None])
            out[np.arange(len(rows)), code[rows]] = False
            return out

        rows = np.flatnonzero(left(every).any(1))
        own = ((parts[rows] - entries[code[rows]]) ** 2).sum(1)
        upper[rows] = np.sqrt(own.astype(np.float64)) * (1 + SLACK)
        lower[rows, code[rows]] = np.sqrt(own.astype(np.float64)) * (1 - SLACK)
        open_ = left(rows)
        i, j = np.nonzero(open_)
        d = ((parts[rows[i]] - entries[j]) ** 2).sum(1)
        lower[rows[i], j] = np.sqrt(d.astype(np.float64)) * (1 - SLACK)
        found = np.full(open_.shape, np.iinfo(np.int64).max)
        found[np.arange(len(rows)), code[rows]] = own
        found[i, j] = d
        code[rows] = found.argmin(1)
        upper[rows] = np.sqrt(found[np.arange(len(rows)), code[rows]].astype(np.float64)) * (1 + SLACK)
        return Bounds(code, upper, lower), len(rows) + len(d)


def stored(each: list[Bounds]) -> list[pa.Array]:
    """Bounds of all part positions as columns code, upper, step, lower."""
    code = np.stack([b.code for b in each], 1).astype(np.uint8)
    upper = np.nextafter(np.stack([b.upper for b in each], 1).astype(np.float32), np.float32(np.inf))
    lower = np.stack([b.lower for b in each], 1)  # n x parts x entries
    step = np.maximum(lower.max(2) / 255, 1e-30).astype(np.float32)
    held = np.clip(np.floor(lower / step[:, :, None].astype(np.float64)), 0, 255).astype(np.uint8)
    return [pack(code), pack(upper), pack(step), pack(held.reshape(len(held), -1))]


def restored(batch: pa.RecordBatch, parts: int, entries: int) -> list[Bounds]:
    code, upper, step = packed(batch, "code", np.uint8, parts), packed(batch, "upper", np.float32, parts), packed(batch, "step", np.float32, parts)
    lower = packed(batch, "lower", np.uint8, parts * entries).reshape(-1, parts, entries) * step[:, :, None].astype(np.float64)
    return [Bounds(code[:, m].astype(np.int64), upper[:, m].astype(np.float64), lower[:, m] * (1 - SLACK)) for m in range(parts)]


def half_distances(entries: np.ndarray) -> np.ndarray:
    """Halves of the distances of entries, rounded down."""
    d = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(2)
    return np.sqrt(d.astype(np.float64)) * (0.5 * (1 - SLACK))


def compress(spark: SparkSession, table: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """id, code (two hex digits a part), error (squared distances summed over parts), label, label_error (summed over equal
    labels) and codebooks_sha256."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits, so codebooks have 1 to 256 entries")
    arrow_sized(spark)
    rows = staged(spark, whole(table, vector_column, scale, {id_column: "id", label_column: "label"}), "vectors")
    start = rows.groupBy("id").agg(F.min("v").alias("v")).orderBy(F.col("id").asc_nulls_last()).limit(entries).collect()
    width = len(start[0]["v"]) if start else parts
    if width == 0 or width % parts:
        raise ValueError(f"vectors of {width} components can't be cut into {parts} equal parts")
    rows = rows.where(F.size("v") == width)
    if any(len(r["v"]) != width for r in start):
        start = rows.groupBy("id").agg(F.min("v").alias("v")).orderBy(F.col("id").asc_nulls_last()).limit(entries).collect()
    size, n = width // parts, len(start)
    #: parts x entries x components of a part
    books = np.array([r["v"] for r in start], np.int64).reshape(n, parts, size).transpose(1, 0, 2)
    kept = T.StructType([rows.schema["id"], rows.schema["label"], rows.schema["v"]])
    with_bounds = T.StructType([*kept.fields, *[T.StructField(c, T.BinaryType()) for c in ("code", "upper", "step", "lower")]])

    def cut(batch: pa.RecordBatch) -> np.ndarray:
        return matrix(batch, width).reshape(-1, parts, size)

    def begun(books: np.ndarray):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = cut(batch)
                columns = stored([Bounds.first(x[:, m], books[m]) for m in range(parts)])
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], with_bounds.names)

        return each

    def moved(x: np.ndarray, batch: pa.RecordBatch, before: np.ndarray, books: np.ndarray) -> list[Bounds]:
        movement = np.sqrt(((books - before) ** 2).sum(2).astype(np.float64)) * (1 + SLACK)
        old = restored(batch, parts, n)
        return [old[m].shifted(movement[m]).assigned(x[:, m], books[m], half_distances(books[m]))[0] for m in range(parts)]

    def again(before: np.ndarray, books: np.ndarray):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = stored(moved(cut(batch), batch, before, books))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept.names], *columns], with_bounds.names)

        return each

    def members(batch: pa.RecordBatch):
        x, code = cut(batch), packed(batch, "code", np.uint8, parts)
        for m in range(parts):
            yield code[:, m].astype(np.int64) + m * n, x[:, m]

    def last(before: np.ndarray, books: np.ndarray):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = cut(batch)
                found = moved(x, batch, before, books)
                code = np.stack([b.code for b in found], 1)
                error = sum(((x[:, m] - books[m][code[:, m]]) ** 2).sum(1) for m in range(parts))
                hexes = [r.tobytes().hex() for r in code.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(hexes, pa.string()), pa.array(error, pa.int64())], ["id", "label", "code", "error"])

        return each

    before = books
    state = staged(spark, rows.mapInArrow(begun(books), with_bounds), "codes")
    for turn in range(rounds):
        if turn:
            state = staged(spark, state.mapInArrow(again(before, books), with_bounds), "codes")
        before, books = books, books.copy()
        for g, (count, *sums) in totals(state, parts * n, size, members).items():
            books[g // n, g % n] = [s // count for s in sums]
    coded = T.StructType([rows.schema["id"], rows.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    out = staged(spark, state.mapInArrow(last(before, books), coded), "codes")
    by_label = out.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(20,0)")).cast("long").alias("label_error"))
    out = out.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(id_column), "code", "error", "label", "label_error", F.lit(digest(books.ravel())).alias("codebooks_sha256"))
