"""Streams over an append-only claims folder: current beliefs kept up to date, and triggers over new rows.

A late row with an old tx never displaces a newer one: states compare tx, not arrival.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tenet.operators.belief import current
from tenet.operators.automate import Engine
from tenet.operators.rules import events_since, triggered
from tenet.schema import CLAIM
from tenet.staging import delete


def appended(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """New rows of a claims folder, as a stream."""
    reader = spark.readStream.schema(CLAIM)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def latest(stream: DataFrame) -> DataFrame:
    """The running current belief of every key, by aggregation in the state store: one row a key, no expiry of identity."""
    names = [c for c in stream.columns if c != "claim_key"]
    best = stream.groupBy("claim_key").agg(F.max_by(F.struct(*names), "tx").alias("r"))
    return best.select(*[F.col(f"r.{c}").alias(c) for c in names], "claim_key")


def keep_current(stream: DataFrame, target: str, checkpoint: str, buckets: int = 16, keep: int = 2, every: str | None = None) -> StreamingQuery:
    """Fold batches into tables of current beliefs under `target`: version n is batch n folded into version n - 1, so a batch that is run
    again writes the same table. Keys are dealt over buckets; only buckets that a batch touches are written anew, and a version
    names the folder of each bucket. The last `keep` versions stay. every: a trigger interval, else what there is now, once."""

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("claim_key"), F.lit(buckets)).cast("int").alias("bucket")
        rows = batch.select("*", bucket)
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # `buckets` numbers at most
        before = parts(spark, target, number - 1)
        held = [before[b] for b in touched if b in before]
        both = rows.drop("bucket")
        for path in held:
            both = both.unionByName(spark.read.schema(CLAIM).parquet(path).select(*batch.columns))
        at = f"{target}/batch={number}"
        current(both).select("*", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/rows")
        now = before | {b: f"{at}/rows/bucket={b}" for b in touched}
        listing = spark.createDataFrame(sorted(now.items()), "bucket int, path string")
        listing.coalesce(1).write.mode("overwrite").parquet(f"{at}/parts")
        forget(spark, target, number - keep, number)

    writer = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def parts(spark: SparkSession, target: str, number: int) -> dict[int, str]:
    """The folder of each bucket of a version; none before the first."""
    if number < 0:
        return {}
    return {r["bucket"]: r["path"] for r in spark.read.schema("bucket int, path string").parquet(f"{target}/batch={number}/parts").collect()}


def kept(spark: SparkSession, target: str, number: int) -> DataFrame:
    """The current beliefs of a version."""
    paths = list(parts(spark, target, number).values())
    return spark.read.schema(CLAIM).parquet(*paths) if paths else spark.createDataFrame([], CLAIM)


def newest(spark: SparkSession, target: str) -> int:
    """The number of the newest version; -1 before the first. Earlier ones may be forgotten, so they are listed, not counted up."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/batch=*/parts/_SUCCESS")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return max((int(f.getPath().getParent().getParent().getName().removeprefix("batch=")) for f in found or ()), default=-1)


def forget(spark: SparkSession, target: str, number: int, newest: int) -> None:
    """Delete a version's listing, and those of its buckets that no later version names."""
    if number < 0 or not exists(spark, f"{target}/batch={number}/parts"):
        return
    named = {p for n in range(number + 1, newest + 1) for p in parts(spark, target, n).values()}
    gone = [p for p in parts(spark, target, number).values() if p not in named]
    delete(spark, *gone, f"{target}/batch={number}/parts")


def on_events(stream: DataFrame, history: str, premises: list[str], act: Callable[[DataFrame, int], None], checkpoint: str, mark: str, ledger: str, every: str | None = None) -> StreamingQuery:
    """Call act(solutions, batch number) with the solutions that cite event rows of the batch, if there are any.

    At most once a row: the rows that a batch brings for the first time are written down under `ledger` before act is called, and are
    events of no later batch; a batch that is written down is never acted on again, not even if act failed half way. So a row that
    comes late, of an id below others, is an event of its own batch, and makes none of the others one again; a row that is delivered twice
    is an event once. Only events join the history, premise by premise; ids are in order of time, so of the ledger only files
    that may have the batch's are read."""

    def fire(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at = f"{ledger}/batch={number}"
        if exists(spark, f"{at}/_SUCCESS"):
            return
        ids = events_since(batch, mark).select(F.col("id").alias("row_id")).distinct()
        low, high = ids.agg(F.min("row_id"), F.max("row_id")).first()
        if low is None:
            return
        if exists(spark, ledger):
            before = spark.read.schema("row_id string, batch int").parquet(ledger)
            ids = ids.join(before.where((F.col("batch") != number) & F.col("row_id").between(low, high)).select("row_id"), "row_id", "left_anti")
        ids.repartitionByRange("row_id").sortWithinPartitions("row_id").write.mode("overwrite").parquet(at)
        events = spark.read.schema("row_id string").parquet(at)
        solutions = triggered(spark, spark.read.schema(CLAIM).parquet(history), premises, mark, among=events)
        if solutions.limit(1).count():
            act(solutions, number)

    writer = stream.writeStream.foreachBatch(fire).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def settling(stream: DataFrame, engine: Callable[[DataFrame], Engine], checkpoint: str, ledger: str, every: str | None = None) -> StreamingQuery:
    """Settle the automations of a store at each batch: `engine` gets the batch's rows and gives an engine over the store that has them. A batch
    is noted before it settles, and never settles again."""

    def fire(batch: DataFrame, number: int) -> None:
        if noted(batch.sparkSession, f"{ledger}/batch={number}"):
            engine(batch).settle()

    writer = stream.writeStream.foreachBatch(fire).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def noted(spark: SparkSession, path: str) -> bool:
    """Make a folder, if it is not there: has this call made it?"""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(at):
        return False
    fs.mkdirs(at)
    return True


def windowed(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Numbers of rows by time of transaction and verb."""
    from tenet.functions.keys import uuid7_ms

    at = F.timestamp_millis(uuid7_ms(F.col("tx")))
    return stream.withColumn("at", at).withWatermark("at", late).groupBy(F.window("at", width), "verb").agg(F.count("*").alias("rows"))
