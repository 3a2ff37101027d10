"""What callers may bring: policies of walks, judges and agents, hooks, storage."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession


class WalkPolicy(Protocol):
    """How a reconstruction goes on: see `tenet.operators.reconstruct`."""

    def select(self, frontier: dict[str, float], visited: list[tuple[str, float]]) -> str | None:
        """The entity to read next, of the frontier; None ends the walk."""

    def score(self, parent: float, conf: float, verb: str) -> float:
        """What a neighbour is worth."""

    def done(self, visited: list[tuple[str, float]]) -> bool:
        """Is what was visited enough?"""


#: An agent or a judge: it gets a prompt and returns its reply.
Agent = Callable[[str], str]


@dataclass
class Hooks:
    """Callables by name, run after a change has passed: each gets the arguments and the rows. What one raises is kept in `problems`."""

    named: dict[str, list[Callable[[dict[str, str], DataFrame], None]]] = field(default_factory=dict)
    problems: list[tuple[str, Exception]] = field(default_factory=list)

    def on(self, name: str, hook: Callable[[dict[str, str], DataFrame], None]) -> Hooks:
        self.named.setdefault(name, []).append(hook)
        return self

    def run(self, name: str, arguments: dict[str, str], rows: DataFrame) -> int:
        for hook in self.named.get(name, ()):
            try:
                hook(arguments, rows)
            except Exception as e:  # a hook is outside: it undoes nothing
                self.problems.append((name, e))
        return len(self.named.get(name, ()))


class Storage(Protocol):
    """Where a store's tables are kept."""

    def write(self, df: DataFrame, name: str) -> None: ...

    def read(self, spark: SparkSession, name: str) -> DataFrame: ...

    def publish(self, spark: SparkSession, manifest: str) -> None:
        """Make what was written visible, at once."""

    def manifest(self, spark: SparkSession) -> str | None: ...


@dataclass(frozen=True)
class ParquetStorage:
    """Tables as Parquet below a path; a version is visible once its manifest has its name."""

    path: str
    sorted_by: tuple[str, ...] = ("claim_key", "tx")

    def write(self, df: DataFrame, name: str) -> None:
        keys = [c for c in self.sorted_by if c in df.columns]
        (df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df).write.parquet(f"{self.path}/{name}")

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{name}")

    def publish(self, spark: SparkSession, manifest: str) -> None:
        spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{self.path}/manifest.new")
        Path = spark._jvm.org.apache.hadoop.fs.Path
        fs = Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.rename(Path(f"{self.path}/manifest.new"), Path(f"{self.path}/manifest")):
            raise OSError(f"{self.path}/manifest cannot be published")

    def manifest(self, spark: SparkSession) -> str | None:
        Path = spark._jvm.org.apache.hadoop.fs.Path
        fs = Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        return spark.read.text(f"{self.path}/manifest").first()[0] if fs.exists(Path(f"{self.path}/manifest")) else None
