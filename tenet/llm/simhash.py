"""SimHash near-duplicates: fingerprints of word shingles, linked at few differing bits through BK-trees.

Equal fingerprints are one node. The 64 bits are cut into six blocks; two fingerprints that differ in at most three bits agree
on at least three whole blocks, so each of the twenty ways to choose three blocks gives a key of about 32 bits, and every
link lies inside a bucket of equal keys. A bucket with two or more fingerprints is a shard with its own BK-tree: children hang
on their parent by integer Hamming distance, and a search follows only the edges within the radius.

How a tree meets its queries depends on its shard's size. A shard of at most TREE fingerprints is searched by the task that
builds its tree. Larger shards' trees, of about PART fingerprints each, are built by tasks, packed into bytes and broadcast, one
slice of at most SLICE fingerprints after another; the shard's fingerprints are searched where they lie, so a dense group is
never dealt over pairs of its parts. Only dense groups have such shards, and no more than a slice is on the driver at once.
All fingerprints' trees are never broadcast together: they are as large as the fingerprints, which have no bound. From a task come
only the links that join two groups in it (fewer than its fingerprints), whatever the number of pairs.

Cases: null texts count as empty; texts of no words have the fingerprint zero and link like any other; texts of fewer words than
a shingle are hashed whole. Rows with a null doc_id take part, and count for the smallest doc_id only where a group has no other.
Repeated rows share their fingerprint. An empty table gives an empty result. `keep_one` carries all columns, whatever their
names; of rows that tie on the smallest doc_id it keeps one by a hash of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from xxhash import xxh64_intdigest

from tenet.llm.common import arrow_sized, forget, new_path, numbered, rows_without, staged
from tenet.llm.graph import components

SHINGLE, SEED, RADIUS = 3, 42, 3
#: First bits of the six blocks, from the lowest.
CUTS = (0, 11, 22, 33, 44, 54, 64)
BLOCKS = 6
#: A shard of more fingerprints has its trees broadcast, each of about PART, at most about SLICE at once (13 bytes each).
TREE, PART, SLICE = 512, 4096, 1 << 18
#: Rows of one fingerprint are joined in so many parts.
SALTS = 1024
CHUNK = 1 << 16


def hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Unsigned 64-bit hashes of all shingles in order, repeats included; of a text of fewer words, of all its words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII blanks only
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    stops = (ends[-n:] - 1).tolist()
    return np.fromiter(map(xxh64_intdigest, [joined[s:e] for s, e in zip(starts, stops, strict=True)], repeat(SEED)), np.uint64, n)


def majority(h: np.ndarray) -> int:
    """The bits that over half of the hashes have, as an unsigned number; zero of none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), CHUNK):
        ones += np.unpackbits(h[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64 bits."""
    return majority(hashes(text, shingle))


@F.arrow_udf(T.LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    """The fingerprints' bits as signed longs."""
    forget()
    return pa.array(np.array([fingerprint(t) for t in texts.to_pylist()], np.uint64).view(np.int64))


class BKTree:
    """Integers by Hamming distance: a node is (value, children by distance)."""

    def __init__(self, values: list[int] | None = None) -> None:
        self.root: tuple[int, dict] | None = None
        for v in values or ():
            self.add(v)

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node = self.root
        while d := (node[0] ^ value).bit_count():
            child = node[1].get(d)
            if child is None:
                node[1][d] = (value, {})
                return
            node = child

    def within(self, value: int, radius: int) -> Iterator[int]:
        todo = [self.root] if self.root else []
        while todo:
            node, children = todo.pop()
            d = (node ^ value).bit_count()
            if d <= radius:
                yield node
            for edge, child in children.items():
                if d - radius <= edge <= d + radius:
                    todo.append(child)

    def packed(self) -> bytes:
        """The nodes, parents before children: values (8 bytes), sizes of subtrees (4), and edges to the parent (1)."""
        values: list[int] = []
        sizes: list[int] = []
        edges: list[int] = []
        todo: list[tuple[int, tuple[int, dict] | int]] = [(0, self.root)] if self.root else []
        while todo:
            edge, node = todo.pop()
            if isinstance(node, int):  # the subtree of that place is complete
                sizes[node] = len(values) - node
                continue
            todo.append((0, len(values)))
            values.append(node[0])
            sizes.append(1)
            edges.append(edge)
            todo.extend(node[1].items())
        return np.array(values, "<u8").tobytes() + np.array(sizes, "<u4").tobytes() + np.array(edges, "<u1").tobytes()


class PackedTree:
    """Searches in a packed tree."""

    def __init__(self, raw: bytes) -> None:
        n = len(raw) // 13
        self.values = np.frombuffer(raw, "<u8", n).tolist()
        self.sizes = np.frombuffer(raw, "<u4", n, 8 * n).tolist()
        self.edges = raw[12 * n :]

    def within(self, value: int, radius: int) -> Iterator[int]:
        values, sizes, edges = self.values, self.sizes, self.edges
        todo = [0] if values else []
        while todo:
            i = todo.pop()
            d = (values[i] ^ value).bit_count()
            if d <= radius:
                yield values[i]
            child, end = i + 1, i + sizes[i]
            while child < end:
                if d - radius <= edges[child] <= d + radius:
                    todo.append(child)
                child += sizes[child]


class Groups:
    """Union-find over integers."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.setdefault(x, x)) != x:
            self.up[x] = x = self.up[y]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[x] = y
        return x != y


def forest(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that join the groups of near values."""
    tree, groups, links = BKTree(), Groups(), []
    for v in values:
        links += [(v, w) for w in tree.within(v, radius) if groups.join(v, w)]
        tree.add(v)
    return links


EDGES = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
_U = (1 << 64) - 1


def _edges(links: list[tuple[int, int]]) -> pa.RecordBatch:
    x = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], schema=to_arrow_schema(EDGES))


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (t, key, fp), sorted: each run of equal t and key is a shard of at most about TREE fingerprints."""
    held = np.zeros((0, 3), np.int64)

    def solve(rows: np.ndarray) -> list[tuple[int, int]]:
        links: list[tuple[int, int]] = []
        bounds = np.concatenate([[0], np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1, [len(rows)]])
        for i in np.flatnonzero(np.diff(bounds) > 1).tolist():
            links += forest([v & _U for v in rows[bounds[i] : bounds[i + 1], 2].tolist()])
        return links

    for batch in batches:
        rows = np.concatenate([held, np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)])])
        if not len(rows):
            continue
        last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))  # the last shard may go on in the next batch
        whole = int(last[-1]) + 1 if len(last) else 0
        held = rows[whole:]
        yield _edges(solve(rows[:whole]))
    yield _edges(solve(held) if len(held) else [])


def block(fp, k: int):
    """The k-th block of bits of a column."""
    return F.shiftrightunsigned(fp, CUTS[k]).bitwiseAND(F.lit((1 << (CUTS[k + 1] - CUTS[k])) - 1))


def near_links(spark: SparkSession, distinct: DataFrame, tree: int = TREE, part: int = PART, slice_: int = SLICE) -> DataFrame:
    """From distinct fingerprints (fp): edges (a, b) whose components are those of all links."""
    arrow_sized(spark, 10_000)
    fp = F.col("fp")
    keys = []
    for t, (x, y, z) in enumerate(combinations(range(BLOCKS), 3)):
        key = F.shiftleft(F.shiftleft(block(fp, x), 11).bitwiseOR(block(fp, y)), 11).bitwiseOR(block(fp, z))
        keys.append(F.struct(F.lit(t).alias("t"), key.alias("key")))
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.t", "k.key", "fp")
    large = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > tree)
    large = staged(spark, large.select("t", "key", "n", F.ceil(F.col("n") / part).cast("int").alias("parts")), "large")
    small = rows.join(large.select("t", "key"), ["t", "key"], "left_anti")
    edges = small.repartition("t", "key").sortWithinPartitions("t", "key", "fp").mapInArrow(linked, EDGES)
    total = large.agg(F.sum("n")).first()[0]
    return edges.unionByName(large_links(spark, rows, large, -(-total // slice_), slice_)) if total else edges


def large_links(spark: SparkSession, rows: DataFrame, large: DataFrame, homes: int, slice_: int = SLICE) -> DataFrame:
    """Links inside the large shards: their trees are broadcast slice by slice, and their fingerprints searched where they lie."""
    home = F.pmod(F.xxhash64("t", "key"), F.lit(homes)).cast("int").alias("home")
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part")
    at, trees_at, out = (new_path(spark, n) for n in ("large-rows", "trees", "tree-links"))
    rows.join(large, ["t", "key"]).select(home, "t", "key", mine, "fp").write.partitionBy("home").parquet(at)
    spread = spark.read.schema("t int, key long, part int, fp long, home int").parquet(at)

    def grown(part: pd.DataFrame) -> pd.DataFrame:
        packed = BKTree([v & _U for v in part["fp"].tolist()]).packed()
        return pd.DataFrame([(int(part["t"].iloc[0]), int(part["key"].iloc[0]), packed, int(part["home"].iloc[0]))], columns=["t", "key", "tree", "home"])

    spread.groupBy("home", "t", "key", "part").applyInPandas(grown, "t int, key long, tree binary, home int").write.partitionBy("home").parquet(trees_at)
    trees = spark.read.schema("t int, key long, tree binary, home int").parquet(trees_at)

    def search(home: int, held: dict[tuple[int, int], list[bytes]]) -> None:
        shared = spark.sparkContext.broadcast(held)

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            opened: dict[tuple[int, int], tuple[list[PackedTree], Groups]] = {}
            for batch in batches:
                links: list[tuple[int, int]] = []
                for t, key, fp in zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True):
                    if (t, key) not in shared.value:
                        continue
                    if (t, key) not in opened:
                        opened[t, key] = [PackedTree(x) for x in shared.value[t, key]], Groups()
                    forest_, groups = opened[t, key]
                    v = fp & _U
                    links += [(v, w) for x in forest_ for w in x.within(v, RADIUS) if groups.join(v, w)]
                yield _edges(links)

        spread.where(F.col("home") == home).select("t", "key", "fp").mapInArrow(probe, EDGES).write.mode("append").parquet(out)
        shared.destroy()

    for home_ in range(homes):
        held: dict[tuple[int, int], list[bytes]] = {}
        n = 0
        for r in trees.where(F.col("home") == home_).toLocalIterator():
            held.setdefault((r["t"], r["key"]), []).append(bytes(r["tree"]))
            n += len(r["tree"]) // 13
            if n >= slice_:
                search(home_, held)
                held, n = {}, 0
        if held:
            search(home_, held)
    return spark.read.schema(EDGES).parquet(out)


def rooted(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """From nodes (fp, …): the nodes with their component's root, a fingerprint of it."""
    roots = components(spark, near_links(spark, nodes.select("fp")))
    return nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, a row for each document.

    A fingerprint of very many rows is joined in SALTS parts: rows are dealt by their place in the staged table."""
    arrow_sized(spark)
    prints = staged(spark, docs.select("doc_id", fingerprints("text").alias("fp")), "prints")
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index")
    prints = prints.select("doc_id", "fp", F.pmod(place, F.lit(SALTS)).alias("salt"))
    parts = staged(spark, prints.groupBy("fp", "salt").agg(F.min("doc_id").alias("low")), "parts")
    nodes = staged(spark, parts.groupBy("fp").agg(F.min("low").alias("low")), "fingerprints")
    found = staged(spark, rooted(spark, nodes), "rooted")
    least = found.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = found.join(least, "root").select("fp", "component_id")
    each = parts.select("fp", "salt").join(classes, "fp")
    return prints.join(each, ["fp", "salt"]).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs without all but one row of each component: that of the smallest doc_id.

    Rows that go are found by their places alone; most others pass without a shuffle of their texts."""
    arrow_sized(spark)
    rows, names = numbered(spark, docs)
    doc_id = F.col(names["doc_id"])
    order = F.struct(doc_id.isNull().alias("none"), doc_id.alias("doc_id"), F.xxhash64(names["text"]).alias("h"), "file", "at")
    prints = staged(spark, rows.select(fingerprints(names["text"]).alias("fp"), order.alias("order")), "prints")
    nodes = staged(spark, prints.groupBy("fp").agg(F.min("order").alias("first")), "fingerprints")
    kept = staged(spark, rooted(spark, nodes).groupBy("root").agg(F.min("first").alias("first")).select("first.file", "first.at"), "kept")
    gone = staged(spark, rows_without(prints.select("order.file", "order.at"), kept), "gone")
    return rows_without(rows, gone).drop("file", "at").toDF(*docs.columns)
