"""Tables in the folder that driver and executors share: they cut lineage, survive lost executors, and are computed once.

The folder is spark.checkpoint.dir; a temporary one only where that is unset, in local mode. Each application has a folder of its
own below it, which goes when the application ends. Callers that want space back sooner collect what is staged on their
behalf (`owned`) and delete it once nothing reads it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Where the paths of staged tables are noted, if a caller asks.
_OWNER: ContextVar[list[str] | None] = ContextVar("owner", default=None)


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tenet-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path that nothing else has, below the application's folder."""
    home = f"{shared_dir(spark)}/tenet/{spark.sparkContext.applicationId}"
    fs, at = _opened(spark, home)
    if not fs.exists(at):
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    return f"{home}/{name}-{uuid.uuid4().hex}"


def stage(spark: SparkSession, df: DataFrame, name: str) -> tuple[str, DataFrame]:
    """The path of a new table of df's rows, and the table."""
    path = new_path(spark, name)
    df.write.parquet(path)
    owner = _OWNER.get()
    if owner is not None:
        owner.append(path)
    return path, spark.read.schema(df.schema).parquet(path)


def staged(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    return stage(spark, df, name)[1]


#: What the plan of a table may hold that is cheap to read again, and from how many scans.
PLAIN, MOST_SCANS = {"Project", "Filter", "Union", "SubqueryAlias", "LogicalRelation", "LogicalRDD", "LocalRelation"}, 12


def tabled(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df as it is, if it is a few scans put together; else a table of its rows. For what many jobs read: else each of them would hold, plan and
    run all that df was made by."""
    todo, scans = [df._jdf.queryExecution().analyzed()], 0
    while todo:
        node = todo.pop()
        below = node.children()
        scans += below.isEmpty()
        if node.nodeName() not in PLAIN or scans > MOST_SCANS:
            return staged(spark, df, name)
        todo += [below.apply(i) for i in range(below.size())]
    return df


@contextmanager
def owned(paths: list[str]) -> Iterator[list[str]]:
    """Within it, the paths of tables that are staged in this thread are added to the list."""
    token = _OWNER.set(paths)
    try:
        yield paths
    finally:
        _OWNER.reset(token)


def delete(spark: SparkSession, *paths: str) -> None:
    """For tables that nothing reads any more."""
    owner = _OWNER.get()
    for path in paths:
        fs, at = _opened(spark, path)
        fs.delete(at, True)
        if owner is not None and path in owner:
            owner.remove(path)


def _opened(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at
