"""A store: claims and edges as immutable tables, with versioned snapshots. Changes make a new value; `save` writes it.

A transaction is a candidate store: what fails in it leaves the store that it began with."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenet.extensions import Hooks, ParquetStorage, Storage
from tenet.functions import keys
from tenet.functions.keys import tx_bound, uuid7_ms
from tenet.operators import belief, export, rules, shape, support, sync
from tenet.operators.registry import Registry, fold
from tenet.plans.query import Options, query
from tenet.schema import CLAIM, EDGE, conform
from tenet.sources import text as claim_text
from tenet.staging import staged, tabled


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    claims: DataFrame
    edges: DataFrame
    clock: Callable[[], int] = field(default=lambda: int(time.time() * 1000))

    @classmethod
    def empty(cls, spark: SparkSession, **more) -> Store:
        return cls(spark, spark.createDataFrame([], CLAIM), spark.createDataFrame([], EDGE), **more)

    def registry(self, as_of: str | None = None) -> Registry:
        return fold(self.claims, self.edges, as_of)

    def next_ms(self) -> int:
        """Later than every row, and than the clock if that is ahead."""
        last = self.claims.agg(F.max("tx")).first()[0]
        return max(self.clock(), int(last.replace("-", "")[:12], 16) + 1 if last else 0)

    def append(self, rows: DataFrame, edges: DataFrame | None = None, minted: bool = False) -> Store:
        """Rows that have ids; those with ids already here are left out. minted: the ids are later than all here, so none of them is."""
        new = conform(rows)
        claims = self.claims.unionByName(new) if minted else sync.merged(self.claims, new)
        return replace(self, claims=claims, edges=self.edges if edges is None else self.edges.unionByName(edges) if minted else sync.merged_edges(self.edges, edges))

    def add(self, rows: DataFrame) -> Store:
        """Rows without ids, which get new ones in any order: later than all here, and by a number in it."""
        plain = rows.drop("id", "tx")
        numbered = plain.withColumn("tx", keys.uuid7(F.lit(self.next_ms()), F.monotonically_increasing_id()))
        return self.append(staged(self.spark, conform(numbered), "added"), minted=True)

    def append_edges(self, edges: DataFrame) -> Store:
        """Edges between rows; those that are here already count once."""
        return replace(self, edges=sync.merged_edges(self.edges, edges))

    def ingest(self, text: str, source: str | None = None, strict: bool = False) -> tuple[Store, claim_text.Document]:
        """Parse and append a text; strict leaves the store as it was if any line has a problem (it raises)."""
        rows, edges, doc = claim_text.claims_of(self.spark, text, self.next_ms(), source, strict, self.registry())
        return self.append(rows, edges, minted=True), doc

    def gated(self, text: str, source: str | None = None, strict: bool = False) -> tuple[Store, DataFrame | None]:
        """As `ingest`, unless that adds a violation of the expectations that hold after it: then the store as it is, and those."""
        rows, edges, _ = claim_text.claims_of(self.spark, text, self.next_ms(), source, strict, self.registry())
        after = self.append(rows, edges, minted=True)
        return self._passed(after, rows)

    def gated_rows(self, rows: DataFrame) -> tuple[Store, DataFrame | None]:
        """As `gated`, for a table of rows without ids."""
        plain = rows.drop("id", "tx").withColumn("tx", keys.uuid7(F.lit(self.next_ms()), F.monotonically_increasing_id()))
        new = staged(self.spark, conform(plain), "added")
        return self._passed(self.append(new, minted=True), new)

    def _passed(self, after: Store, new: DataFrame) -> tuple[Store, DataFrame | None]:
        found = staged(self.spark, shape.added(self.spark, self.claims, new, self.registry(), after.registry()), "violations")
        return (self, found) if found.limit(1).count() else (after, None)

    def derive(self, passes: int = rules.PASSES) -> tuple[Store, support.Maintained]:
        """The declared rules' conclusions as rows, with edges to what they rest on. From what came after the rules' marks alone, if all
        have one; marks follow unless the passes ended too soon."""
        claims, told = tabled(self.spark, self.claims, "claims"), tabled(self.spark, self.edges, "edges")
        now = replace(self, claims=claims, edges=told)
        declared, _ = rules.listed(claims)
        marked = rules.marks(claims)
        since = min(marked[r.subject] for r in declared) if declared and all(r.subject in marked for r in declared) else None
        found = support.maintain(self.spark, claims, told, declared, since, passes)
        held = belief.current(claims.where(support.of_rule())).where("conf > 0")
        rows = conform(found.append.drop("id", "tx")).unionByName(conform(found.retract))
        rows = rows.drop("id", "tx").withColumn("tx", keys.uuid7(F.lit(now.next_ms()), F.monotonically_increasing_id()))
        rows = staged(self.spark, conform(rows), "concluded")
        declarations = rules.declarations(claims).groupBy("subject").agg(F.max("id").alias("id"))
        edges = staged(self.spark, support.support_edges(found, rows.where("conf > 0"), held, declarations), "support")
        store = now.append(rows, edges, minted=True)
        if found.complete and declared:
            store = store.add(rules.mark_rows(self.spark, declared, store.claims.agg(F.max("tx")).first()[0]))
        return store, found

    def act(self, action: rules.Action, arguments: dict[str, str], hooks: Hooks | None = None, dry: bool = False) -> tuple[Store, Acted]:
        """Run a governed action, and tell what it did. Hooks of its name run once the rows are in the store, and not if there are none, nor dry:
        then the store stays as it was."""
        new = staged(self.spark, rules.governed(self.spark, self.claims, action, arguments), "effects")
        effects = conform(rules.act(self.spark, self.claims, action, arguments)).count()
        held = belief.current(self.claims).where("conf > 0").select("claim_key")
        n, updated = new.count(), new.join(held, "claim_key", "left_semi").count()
        said = Acted(n - updated, updated, effects - n)
        if dry or not n:
            return self, said
        store = self.add(new)
        if hooks is not None:
            hooks.run(action.name, arguments, new)
        return store, said

    def synced_table(self, docs: DataFrame) -> tuple[Store, DataFrame]:
        """As `synced`, for a table (path, text) of annotated documents, which executors parse; (path, line, problem) of all."""
        rows, edges, problems = claim_text.annotated_table(self.spark, docs, self.registry())
        return (self if problems.limit(1).count() else self.append(rows, edges)), problems

    def synced(self, text: str) -> tuple[Store, list[tuple[int, str]]]:
        """Rows of an annotated text (each claim line after a line `;@ id`) by their own ids: those here are left out. With any problem
        nothing is taken, and the problems (line, what) are told."""
        rows, edges, problems = claim_text.annotated(self.spark, text, self.registry())
        return (self, problems) if problems else (self.append(rows, edges), [])

    @contextmanager
    def transaction(self) -> Iterator[Transaction]:
        """Changes to a candidate, whose `store` is what was made of it; an exception takes it back to what it was, and goes on."""
        t = Transaction(self)
        with t.savepoint():
            yield t

    def query(self, text: str, **options) -> DataFrame:
        return query(self.spark, self.claims, text, Options(registry=self.registry(), **options))

    def merge(self, other: Store) -> Store:
        return replace(self, claims=sync.merged(self.claims, other.claims), edges=sync.merged_edges(self.edges, other.edges))

    def current(self, as_of: str | None = None) -> DataFrame:
        return belief.current(self.claims, as_of)

    def export(self, current: bool = True, ceiling: str = "internal", with_tx: bool = False) -> DataFrame:
        """(tx, line): canonical text of the rows that the ceiling lets through, resolved first; with_tx: each after a line with its id."""
        rows = belief.visible(self.current() if current else self.claims, ceiling)
        line = F.concat(F.lit(";@ "), F.col("tx"), F.lit("\n"), emitted()) if with_tx else emitted()
        return rows.select("tx", line.alias("line"))

    def text(self, current: bool = True, ceiling: str = "internal", with_tx: bool = False) -> DataFrame:
        """(path, line): as `export`, with edges: nested lines follow their parents in order of path."""
        told = staged(self.spark, belief.visible(self.current() if current else self.claims, ceiling), "told")
        return export.lines(self.spark, told, export.remapped(told, self.claims, self.edges), with_tx)

    # --- snapshots ---

    def save(self, path: str, storage: Callable[[str], Storage] = ParquetStorage) -> dict:
        """A new version under path: tables sorted for pruning, then a manifest, whose presence is the commit."""
        version = f"v{self.next_ms():015d}"
        at = storage(f"{path}/{version}")
        at.write(self.claims, "claims")
        at.write(self.edges, "edges")
        manifest = {"version": version, **digests(self.spark, f"{path}/{version}")}
        at.publish(self.spark, json.dumps(manifest))
        return manifest

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: str, verify: bool = True, storage: Callable[[str], Storage] = ParquetStorage) -> Store:
        if verify:
            verified(spark, path, version, storage=storage)
        at = storage(f"{path}/{version}")
        return cls(spark, conform(at.read(spark, "claims")), at.read(spark, "edges").select(*EDGE.names))

    @classmethod
    def restore(cls, spark: SparkSession, path: str, version: str, target: str, sha256: str | None = None) -> dict:
        """A verified copy of a version under target, which becomes visible at once or not at all; its manifest."""
        verified(spark, path, version, sha256)
        return cls.load(spark, path, version, verify=False).save(target)


@dataclass(frozen=True)
class Acted:
    """What an action did: rows of keys that nothing said, rows that change what was said, and effects that were so already."""

    appended: int
    updated: int
    unchanged: int


class Transaction:
    """A store that changes in place while its transaction lasts; savepoints nest."""

    def __init__(self, store: Store) -> None:
        self.store = store

    @contextmanager
    def savepoint(self) -> Iterator[Transaction]:
        before = self.store
        try:
            yield self
        except BaseException:
            self.store = before
            raise

    def ingest(self, text: str, source: str | None = None, strict: bool = False) -> claim_text.Document:
        self.store, doc = self.store.ingest(text, source, strict)
        return doc

    def append(self, rows: DataFrame, edges: DataFrame | None = None) -> None:
        self.store = self.store.append(rows, edges)


def digests(spark: SparkSession, path: str) -> dict:
    """Of a snapshot's tables: rows, the latest id, and the SHA-256 of their files' names and SHA-256 in order. Files are read whole, by
    executors, one at a time; their digests alone come to the driver."""
    out, said = {}, hashlib.sha256()
    for name in ("claims", "edges"):
        df = spark.read.parquet(f"{path}/{name}")
        last = F.max("tx") if "tx" in df.columns else F.lit(None).cast("string")
        r = df.agg(F.count("*"), last).first()
        out |= {f"{name}_rows": r[0]} | ({"last": r[1]} if "tx" in df.columns else {})
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{path}/{name}")
        for f in files.select(F.regexp_extract("path", "[^/]*$", 0).alias("file"), F.sha2("content", 256).alias("sha")).orderBy("file").toLocalIterator():
            said.update(f"{name}/{f['file']} {f['sha']}\n".encode())
    return out | {"sha256": said.hexdigest()}


def verified(spark: SparkSession, path: str, version: str, sha256: str | None = None, storage: Callable[[str], Storage] = ParquetStorage) -> dict:
    """The manifest of a version whose files are what it says, and what the caller expects."""
    said = storage(f"{path}/{version}").manifest(spark)
    if said is None:
        raise ValueError(f"{path}/{version} was never published")
    manifest, found = json.loads(said), digests(spark, f"{path}/{version}")
    if found != {k: manifest[k] for k in found} or (sha256 is not None and found["sha256"] != sha256.lower()):
        raise ValueError(f"{path}/{version} is not what its manifest says, or not what is expected: {found}")
    return manifest


def emitted():
    """A claim's canonical line, as a column."""
    value = F.coalesce("value_text", F.concat_ws(" ", F.col("value_num").cast("string"), "value_unit"))
    payload = F.when(F.col("attribute").isNotNull(), F.concat(F.col("attribute"), F.lit(": "), value)).when(F.col("object").isNotNull(), F.col("object")).when(value != "", value)
    delta = F.when(F.col("delta_num").isNotNull(), F.concat(F.lit("+/- "), F.col("delta_num").cast("string"), F.coalesce("delta_unit", F.lit(""))))
    tags = F.array_join(F.transform("tags", lambda t: F.concat(F.lit("#"), t["key"], F.when(t["value"].isNotNull(), F.concat(F.lit(":"), t["value"])).otherwise(F.lit("")))), " ")
    ctx = F.array_join(F.transform("contexts", lambda c: F.concat(F.lit("@"), c)), " ")
    conf = F.when(F.col("conf") < 1, F.concat(F.lit("@ "), F.regexp_replace(F.format_number(F.col("conf") * 100, 2), r"\.?0+$", ""), F.lit("%")))
    parts = [F.col("subject"), F.col("verb"), F.when(F.col("negated"), "NOT"), payload, delta, F.nullif(ctx, F.lit("")), F.nullif(tags, F.lit("")), conf, F.when(F.col("importance"), "!"), F.when(F.col("comment").isNotNull(), F.concat(F.lit("; "), "comment"))]
    return F.concat_ws(" ", *parts)


def records(claims: DataFrame) -> DataFrame:
    """(id, record): versioned JSON of every row."""
    return claims.select("id", F.to_json(F.struct(F.lit("tenet.claim/1").alias("format"), *claims.columns)).alias("record"))


def match_record(columns: list[str]):
    """A solution of a query as versioned JSON: its bindings, and the claim that it matched."""
    bound = [c for c in columns if not c.startswith("row_") and c not in ("at_num", "support")]
    bindings = F.map_from_arrays(F.array(*[F.lit(c) for c in bound]), F.array(*[F.col(c) for c in bound]))
    claim = F.struct(*[F.col(c).alias(c.removeprefix("row_")) for c in columns if c.startswith("row_")])
    return F.to_json(F.struct(F.lit("tenet.match/1").alias("format"), bindings.alias("bindings"), claim.alias("claim")))


def from_records(rows: DataFrame) -> DataFrame:
    """Back from JSON; a record whose key is not its content's raises."""
    from pyspark.sql import types as T

    from tenet.functions.keys import claim_key

    parsed = rows.select(F.from_json("record", T.StructType([T.StructField("format", T.StringType()), *CLAIM.fields])).alias("r")).select("r.*")
    ok = (F.col("format") == "tenet.claim/1") & (F.col("claim_key") == claim_key())
    return parsed.withColumn("id", F.when(ok, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("not a claim record: "), "id")))).drop("format")


__all__ = ["Store", "Transaction", "digests", "emitted", "from_records", "records", "tx_bound", "uuid7_ms", "verified"]
