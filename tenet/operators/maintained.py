"""Tables that appends keep up to date, so that reads neither shuffle nor sort: current beliefs, and what the readers of each ceiling see.

A table is a folder of parts and a log. An append writes parts that nothing names yet, then a log entry that names all parts of the new
revision; entries are put there whole or not at all, by one writer each: who comes second makes its parts anew on top of the first
one's. A revision that is kept never changes, so what reads it goes on while others append. An empty table has no revision, and reads as
no rows. Rows are conformed first: other columns are not kept. A null claim key is a key like any other; an edge with a null end never
has both of its ends, and is seen by nobody.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenet.operators.belief import SENSITIVITY, current, sensitivity
from tenet.schema import CLAIM, EDGE, conform
from tenet.staging import delete

#: How often a writer begins again when others came first.
TRIES = 20


class Conflict(RuntimeError):
    """Another writer published this revision."""


@dataclass(frozen=True)
class Log:
    """Entries 0, 1, ... of a table below `path`, each a JSON object."""

    spark: SparkSession
    path: str

    def _at(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def numbers(self) -> list[int]:
        fs, at = self._at("")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit()) if fs.exists(at) else []

    def entry(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/log/{number:012d}", wholetext=True).first()[0])

    def publish(self, number: int, entry: dict) -> None:
        """Put the entry there, whole, if there is none of this number: Conflict if there is."""
        jvm = self.spark._jvm
        fs, at = self._at(f"{number:012d}")
        _, new = self._at(f".{uuid.uuid4().hex}")
        out = fs.create(new, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(new, at, options)
        except Exception as e:
            fs.delete(new, False)
            if fs.exists(at):
                raise Conflict(f"{self.path}: revision {number} is published") from e
            raise


@dataclass(frozen=True)
class Table:
    """What the kept tables share. Parts are folders `<kind>/part=<token>`, and a revision names those of each kind."""

    spark: SparkSession
    path: str

    @property
    def log(self) -> Log:
        return Log(self.spark, self.path)

    def revision(self) -> int | None:
        """The last one."""
        numbers = self.log.numbers()
        return numbers[-1] if numbers else None

    def named(self, revision: int | None = None) -> dict:
        revision = self.revision() if revision is None else revision
        return {} if revision is None else self.log.entry(revision)

    def write(self, df: DataFrame, kind: str, *by: str) -> str:
        at = f"{self.path}/{kind}/part={uuid.uuid4().hex}"
        (df.write.partitionBy(*by) if by else df.write).parquet(at)
        return at

    def read(self, kind: str, paths: list[str], fields: list[T.StructField]) -> DataFrame:
        schema = T.StructType([*fields, T.StructField("part", T.StringType())])
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*paths)

    def change(self, make: Callable[[dict, list[str]], dict]) -> int:
        """Publish what `make` makes of the last revision's entry (it notes the parts that it writes): the new revision."""
        for _ in range(TRIES):
            last, made = self.revision(), []
            entry = make(self.named(last), made)
            number = 0 if last is None else last + 1
            try:
                self.log.publish(number, entry)
                return number
            except Conflict:
                delete(self.spark, *made)
        raise Conflict(f"{self.path}: others came first {TRIES} times")

    def forget(self, keep: int = 2) -> None:
        """Delete all but the last `keep` revisions, and the parts that only those name. For times when nothing reads them."""
        numbers = self.log.numbers()
        old, kept = numbers[:-keep], numbers[-keep:]
        held = {p for n in kept for p in parts_of(self.log.entry(n))}
        gone = {p for n in old for p in parts_of(self.log.entry(n))} - held
        delete(self.spark, *sorted(gone), *[f"{self.path}/log/{n:012d}" for n in old])


def parts_of(entry: dict) -> set[str]:
    """All paths that an entry names."""
    out: set[str] = set()
    for paths in entry.values():
        out |= set(paths.values() if isinstance(paths, dict) else paths)
    return out


@dataclass(frozen=True)
class Beliefs(Table):
    """The row of largest tx of every claim key. Keys are dealt over buckets; an append writes the buckets anew that it changes.

    The number of buckets is the table's for good: have so many that one is some hundred megabytes."""

    buckets: int = 16

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _kept(self, entry: dict, only: list[int] | None = None) -> DataFrame:
        held = {int(b): p for b, p in entry.get("beliefs", {}).items()}
        return self.read("beliefs", [p for b, p in sorted(held.items()) if only is None or b in only], [*CLAIM.fields, T.StructField("bucket", T.IntegerType())])

    def append(self, rows: DataFrame) -> int:
        """Rows in any order: one that comes late displaces none of a later tx, one that comes twice changes nothing."""

        def fold(entry: dict, made: list[str]) -> dict:
            new = current(conform(rows)).withColumn("bucket", self.bucket(F.col("claim_key")))
            was = self._kept(entry).select("claim_key", "bucket", F.col("tx").alias("was"))
            same = [new["bucket"] == was["bucket"], new["claim_key"].eqNullSafe(was["claim_key"])]
            won = self.write(new.join(was, same, "left").where("was is null or tx > was").select(*[new[c] for c in new.columns]), "won", "bucket")
            try:
                won_rows = self.spark.read.schema(T.StructType([*CLAIM.fields, T.StructField("bucket", T.IntegerType())])).parquet(won)
                changed = [r[0] for r in won_rows.select("bucket").distinct().collect()]  # `buckets` numbers at most
                if not changed:
                    return entry
                old = self._kept(entry, changed)
                gone = won_rows.select("bucket", "claim_key")
                left = old.join(gone, [old["bucket"] == gone["bucket"], old["claim_key"].eqNullSafe(gone["claim_key"])], "left_anti")
                at = self.write(left.drop("part").unionByName(won_rows), "beliefs", "bucket")
                made.append(at)
                return {"beliefs": entry.get("beliefs", {}) | {str(b): f"{at}/bucket={b}" for b in changed}}
            finally:
                delete(self.spark, won)

        return self.change(fold)

    def current(self, revision: int | None = None) -> DataFrame:
        """All of them: a scan."""
        return self._kept(self.named(revision)).select(*CLAIM.names)

    def of(self, key: str, revision: int | None = None) -> DataFrame:
        """The belief of a key: a scan of its bucket."""
        return self._kept(self.named(revision)).where((F.col("bucket") == self.bucket(F.lit(key))) & (F.col("claim_key") == key)).select(*CLAIM.names)


@dataclass(frozen=True)
class Views(Table):
    """What the readers of each ceiling see: rows by the rank of their label, edges by the higher rank of their ends. An edge waits until the
    rows of both ends are here. One table serves all ceilings, each of which reads only the folders of its ranks."""

    def _rows(self, entry: dict) -> DataFrame:
        return self.read("rows", entry.get("rows", []), [*CLAIM.fields, T.StructField("rank", T.IntegerType())])

    def _edges(self, entry: dict) -> DataFrame:
        return self.read("edges", entry.get("edges", []), [*EDGE.fields, T.StructField("rank", T.IntegerType())])

    def append(self, rows: DataFrame, edges: DataFrame | None = None, minted: bool = False) -> int:
        """Rows and edges; those that are here are left out. minted: none of them is, which spares the joins that look."""

        def fold(entry: dict, made: list[str]) -> dict:
            new = conform(rows)
            if not minted:
                new = new.dropDuplicates(["id"]).join(self._rows(entry).select("id"), "id", "left_anti").select(*CLAIM.names)
            at = self.write(new.withColumn("rank", sensitivity().cast("int")), "rows", "rank")
            made.append(at)
            after = entry | {"rows": [*entry.get("rows", []), at]}
            wait = self.read("waiting", entry.get("waiting", []), EDGE.fields).select(*EDGE.names)
            if edges is not None:
                fresh = edges.select(*EDGE.names)
                fresh = fresh if minted else fresh.join(self._edges(entry), EDGE.names, "left_anti")
                wait = wait.unionByName(fresh)
            ranks = self._rows(after).select("id", "rank")
            for end in ("parent", "child"):
                wait = wait.join(ranks.withColumnsRenamed({"id": f"{end}_id", "rank": end}), f"{end}_id", "left")
            told = self.write(wait.select(*EDGE.names, F.when(F.col("parent").isNotNull() & F.col("child").isNotNull(), F.greatest("parent", "child")).alias("rank")).distinct(), "told")
            try:
                all_ = self.spark.read.schema(T.StructType([*EDGE.fields, T.StructField("rank", T.IntegerType())])).parquet(told)
                seen = self.write(all_.where("rank is not null"), "edges", "rank")
                waiting = self.write(all_.where("rank is null").drop("rank"), "waiting")
                made += [seen, waiting]
            finally:
                delete(self.spark, told)
            return after | {"edges": [*entry.get("edges", []), seen], "waiting": [waiting]}

        return self.change(fold)

    def view(self, ceiling: str, revision: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(rows, edges) that the ceiling lets through."""
        entry, most = self.named(revision), SENSITIVITY[ceiling]
        return self._rows(entry).where(F.col("rank") <= most).select(*CLAIM.names), self._edges(entry).where(F.col("rank") <= most).select(*EDGE.names)

    def compact(self) -> int:
        """The same as one part of each kind: for tables of many small appends."""

        def fold(entry: dict, made: list[str]) -> dict:
            if not entry:
                return entry
            made += [self.write(self._rows(entry).drop("part"), "rows", "rank"), self.write(self._edges(entry).drop("part"), "edges", "rank")]
            return entry | {"rows": made[:1], "edges": made[1:]}

        return self.change(fold)
