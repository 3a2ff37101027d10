"""What the corpus operators share: reading tables, rows' identities, Arrow batch sizes, narrow filters for wide rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenet.staging import delete, new_path, owned, stage, staged

#: ASCII white space of the contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: A word of the contracts, for the JVM's and DuckDB's regular expressions alike.
WORD = r"[^\x20\x09-\x0D]+"

#: Arrow batches go to Python in at most so many rows and bytes, so a batch of very long texts stays small.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


#: What a Python worker keeps between tasks and can do without: functions that drop it.
KEPT: list = []


def release() -> None:
    """Give memory that is free in this worker back to the system: Arrow's, and that of the C library, where it can."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def forget() -> None:
    """Give back what other operators' tasks have left in this worker, and memory that is free."""
    for drop in KEPT:
        drop()
    release()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_sized(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the Arrow batches of this session by rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def unused(df: DataFrame, name: str) -> str:
    """A column name that df has not, near the given one."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def numbered(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns c0, c1, … and, as `file` and `at`, longs that tell its rows apart and stay the same in every scan; and
    where each of its own columns is now. A table that is read as it stands has them in its files; others are staged first."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation"
    try:
        if plain:
            rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
            return rows, names
    except AnalysisException:  # a format without row numbers
        pass
    rows = docs.toDF(*names.values()).select("*", F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))
    return staged(spark, rows, "rows"), names


#: Bits of a `Sieve`: it is broadcast as at most a 64th as many rows of 16 bytes.
SIEVE_BITS = 1 << 24


class Sieve:
    """A filter of fixed size for the ids (file, at) of a table: it lets all of them pass, and few others while they are few.

    It goes ahead of a join that would shuffle whole texts, so only rows that may join are shuffled. Its size has a bound
    whatever the number of ids; where they are very many it lets most rows pass, and the join does the work alone."""

    def __init__(self, ids: DataFrame, bits: int = SIEVE_BITS):
        self.bits = bits
        words = ids.select(*self._place())
        self.words = words.groupBy("word").agg(F.bit_or("bit").alias("mask"))  # bits / 64 rows at most

    def _place(self) -> tuple[Column, Column]:
        """The word and the bit of an id."""
        place = F.pmod(F.xxhash64("file", "at"), F.lit(self.bits).cast("long"))
        return F.shiftright(place, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int")).alias("bit")

    def marked(self, rows: DataFrame) -> DataFrame:
        """rows with `may`: can its id be among the ids?"""
        out = rows.select("*", *self._place()).join(F.broadcast(self.words), "word", "left")
        return out.withColumn("may", F.coalesce(F.col("mask").bitwiseAND(F.col("bit")) != 0, F.lit(False))).drop("word", "bit", "mask")


def rows_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose (file, at) is among the ids."""
    return Sieve(ids).marked(rows).where("may").drop("may").join(ids.select("file", "at"), ["file", "at"], "left_semi")


def rows_without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose (file, at) is not among the ids: most pass without a shuffle."""
    marked = Sieve(ids).marked(rows)
    rest = marked.where("may").drop("may").join(ids.select("file", "at"), ["file", "at"], "left_anti")
    return marked.where("not may").drop("may").unionByName(rest)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def spark_type(kind):
    """Spark's type for an Arrow type, without a session."""
    from pyspark.sql.pandas.types import from_arrow_type

    return from_arrow_type(kind)


def struct_array(rows: list[tuple], kind):
    """An Arrow array of structs from tuples."""
    import pyarrow as pa

    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kind)], fields=list(kind))


__all__ = ["Sieve", "arrow_sized", "delete", "documents", "forget", "new_path", "numbered", "owned", "release", "rows_of", "rows_without", "stage", "staged", "struct_array", "table", "text_or_empty", "unused"]
