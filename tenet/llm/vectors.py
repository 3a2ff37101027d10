"""What the operators on vectors share: whole vectors as integers, exact means of groups, Arrow columns as numpy arrays.

Integers are floor(scale * x) of components, held within +-LARGEST, so that a squared distance of up to 512 components is a long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Integers beyond it are taken for it (of either sign); components up to 65536 at a scale of 1024 lie within.
LARGEST = 1 << 26


def whole(rows: DataFrame, vector: str, scale: int, keep: dict[str, str]) -> DataFrame:
    """The columns of `keep` under their new names, and `v`, the integers: rows whose vector is null, or holds null, an infinity or
    a NaN, go."""
    x = F.col(vector)
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    near = lambda c: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(c.cast("double") * scale))).cast("int")
    return rows.where(x.isNotNull() & ~odd).select(*[F.col(c).alias(n) for c, n in keep.items()], F.transform(x, near).alias("v"))


def matrix(batch: pa.RecordBatch, width: int, column: str = "v") -> np.ndarray:
    """An Arrow column of lists of one length as rows of 64-bit integers."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, width)


def packed(batch: pa.RecordBatch, column: str, dtype, width: int) -> np.ndarray:
    """An Arrow column of byte strings of one length as rows of numbers."""
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), dtype).reshape(batch.num_rows, width)


def pack(rows: np.ndarray) -> pa.Array:
    """Rows of numbers as byte strings, for `packed`."""
    raw, width = np.ascontiguousarray(rows).tobytes(), rows.shape[1] * rows.itemsize
    return pa.array([raw[i * width : (i + 1) * width] for i in range(len(rows))], pa.binary())


def totals(rows: DataFrame, groups: int, width: int, members: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]]) -> dict[int, list[int]]:
    """For each group that has rows: their number, then the exact sum of each of the `width` components.

    `members` gives, for a batch, pairs of group numbers and vectors. Each task sends one row a group and component, whatever the
    number of its rows; sums are decimals, so none overflows. The driver gets groups * width numbers."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((groups, width + 1), np.int64)
        for batch in batches:
            for group, vectors in members(batch):
                np.add.at(sums[:, 0], group, 1)
                np.add.at(sums[:, 1:], group, vectors)
        full = np.flatnonzero(sums[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(full, width + 1)), pa.array(np.tile(np.arange(width + 1), len(full))), pa.array(sums[full].ravel())], ["g", "place", "total"])

    parts = rows.mapInArrow(added, "g long, place long, total long")
    found: dict[int, list[int]] = {}
    for r in parts.groupBy("g", "place").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total")).collect():
        found.setdefault(r["g"], [0] * (width + 1))[r["place"]] = int(r["total"])
    return found


def digest(numbers) -> str:
    """Lowercase hex sha256 of integers as decimals, joined by commas."""
    from hashlib import sha256

    return sha256(",".join(str(int(n)) for n in numbers).encode()).hexdigest()
