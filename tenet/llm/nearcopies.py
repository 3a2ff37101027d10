"""SimHash near-duplicates at a similarity: texts whose sets of 5-word shingles have a Jaccard similarity of LEAST or more.

Two sets of similarity 0.8 differ in 9.7 of 64 SimHash bits on average (deviation 2.9), so trees are searched within WIDE bits,
six deviations above that, and every pair so found is compared by its sets, exactly: no link is below LEAST. No choice of bit blocks
holds pairs that differ so widely in one shard, and a BK-tree over all fingerprints prunes almost nothing at such a radius. So
shards are keyed by minima of the shingles' hashes: BANDS keys of ROWS minima each, of which two sets of similarity s share one
with probability 1 - (1 - s^4)^24, all but 3 in a million at 0.8, and fewer are missed above. Each shard has its BK-tree.

Texts of equal sets are one node. Keys are used in ROUNDS, few first: what a round links is one component, and shards whose
nodes are all of one component need no search later. Shards of the same nodes are one. A shard over TREE nodes or SET_WORDS
shingles is dealt over parts, and each pair of parts is a task of its own, so no shard is too large for a task. From a task come
only the links that join two groups in it. Whole texts are shuffled only for nodes that share a key with another.

Cases: words are as in `simhash` (ASCII case and blanks). Null texts count as empty; texts of no words are copies of each other;
texts of one to four words are a single shingle. Of the rows of a component the one of the smallest doc_id stays, a null doc_id
only where there is no other; ties go by a hash of the text, then by place. All columns are carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from xxhash import xxh64_intdigest

from tenet.llm.common import arrow_sized, forget, numbered, rows_of, rows_without, spark_type, staged, struct_array
from tenet.llm.graph import components
from tenet.llm.simhash import SEED, BKTree, Groups, hashes, majority

SHINGLE, LEAST, WIDE = 5, 0.8, 28
BANDS, ROWS = 24, 4
#: Numbers of the keys of each round.
ROUNDS = ((0, 1), (1, 4), (4, BANDS))
#: A part of a shard holds at most about so many nodes, and so many shingles.
TREE, SET_WORDS = 2048, 1 << 19
CHUNK = 1 << 12
#: Odd factors: the minima of a set's hashes times each are its signature.
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
SKETCH = pa.struct([("digest", pa.int64()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])
NODE = pa.struct([("fp", pa.int64()), ("shingles", pa.binary())])
EDGES = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct hashes of the text's shingles, in order of size."""
    return np.unique(hashes(text, SHINGLE))


def bands(values: np.ndarray) -> list[int]:
    """A set's keys; none of an empty set."""
    if not len(values):
        return []
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(values), CHUNK):
        least = np.minimum(least, (values[i : i + CHUNK, None] * FACTORS).min(axis=0))
    raw, size = least.tobytes(), 8 * ROWS
    return np.array([xxh64_intdigest(raw[b * size : (b + 1) * size], b) for b in range(BANDS)], np.uint64).view(np.int64).tolist()


def similar(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    """Is the Jaccard similarity of two ordered sets at least so much?"""
    if len(a) < len(b):
        a, b = b, a
    if len(b) < least * len(a):
        return False
    both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return both >= least * (len(a) + len(b) - both)


def signed(value: int) -> int:
    return int(np.uint64(value).view(np.int64))


@F.arrow_udf(spark_type(SKETCH))
def sketches(texts: pa.Array) -> pa.Array:
    """Each text's digest of its set, the set's size, and its keys."""
    forget()
    out = []
    for t in texts.to_pylist():
        s = shingle_set(t)
        out.append((signed(xxh64_intdigest(s.tobytes(), SEED)), len(s), bands(s)))
    return struct_array(out, SKETCH)


@F.arrow_udf(spark_type(NODE))
def signatures(texts: pa.Array) -> pa.Array:
    """Each text's SimHash over its distinct shingles, and its set."""
    out = []
    for t in texts.to_pylist():
        s = shingle_set(t)
        out.append((signed(majority(s)), s.tobytes()))
    return struct_array(out, NODE)


def forest(nodes: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int]]:
    """Links that join the groups of similar nodes (number, SimHash, set): a BK-tree gives those within WIDE bits, sets decide."""
    tree, groups, links = BKTree(), Groups(), []
    held: dict[int, list[tuple[int, np.ndarray]]] = {}
    for v, fp, s in nodes:
        for near in tree.within(fp, WIDE):
            for w, other in held[near]:
                if groups.find(v) != groups.find(w) and similar(s, other):
                    groups.join(v, w)
                    links.append((v, w))
        tree.add(fp)
        held.setdefault(fp, []).append((v, s))
    return links


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, key, i, j, node, fp, shingles), sorted by the first four: each run of equal ones is a task."""
    schema = to_arrow_schema(EDGES)
    held: list[tuple[int, int, np.ndarray]] = []
    last = None

    def out(links: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in range(2)], schema=schema)

    for batch in batches:
        links: list[tuple[int, int]] = []
        for *task, node, fp, raw in zip(*[batch.column(c).to_pylist() for c in range(7)], strict=True):
            if task != last:
                links += forest(held)
                held, last = [], task
            held.append((node, fp & ((1 << 64) - 1), np.frombuffer(raw, np.uint64)))
        yield out(links)
    yield out(forest(held))


def shards(keyed: DataFrame, tree: int = TREE) -> DataFrame:
    """From (node, root, n, k, key): (k, key, parts) of the keys whose nodes are of several components, those of the same nodes once."""
    members = [F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]
    parts = F.greatest(F.ceil(F.count("*") / tree), F.ceil(F.sum("n") / SET_WORDS)).cast("int").alias("parts")
    found = keyed.groupBy("k", "key").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high"), parts, *members)
    return found.where("low < high").groupBy("size", "x", "y").agg(F.min(F.struct("k", "key", "parts")).alias("b")).select("b.*")


def links(keyed: DataFrame, found: DataFrame, nodes: DataFrame) -> DataFrame:
    """From (node, k, key), the shards (k, key, parts) and (node, fp, shingles): edges (a, b) whose components are those of all links
    inside the shards."""
    mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: (i != F.col("mine")) | (F.col("parts") == 1))
    tasks = keyed.select("node", "k", "key").join(found, ["k", "key"]).withColumn("mine", mine).withColumn("other", F.explode(others))
    tasks = tasks.select("k", "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node")
    tasks = tasks.join(nodes, "node").select("k", "key", "i", "j", "node", "fp", "shingles")
    return tasks.repartition("k", "key", "i", "j").sortWithinPartitions("k", "key", "i", "j", "node").mapInArrow(linked, EDGES)


def keep_one(spark: SparkSession, docs: DataFrame, tree: int = TREE) -> DataFrame:
    """docs without all but one row of each component."""
    arrow_sized(spark)
    rows, names = numbered(spark, docs)
    doc_id, text = F.col(names["doc_id"]), names["text"]
    order = F.struct(doc_id.isNull().alias("none"), doc_id.alias("doc_id"), F.xxhash64(text).alias("h"), "file", "at")
    sketched = staged(spark, rows.select(order.alias("order"), sketches(text).alias("s")).select("order", "s.*"), "sketches")
    nodes = sketched.groupBy("digest", "n").agg(F.min("order").alias("first"), F.first("bands").alias("bands"))
    nodes = staged(spark, nodes.select(F.monotonically_increasing_id().alias("node"), "first", "n", "bands"), "nodes")

    def keyed(low: int, high: int, roots: DataFrame | None) -> DataFrame:
        """(node, root, n, k, key) of some keys; a node that nothing has joined yet is its own root."""
        out = nodes.select("node", "n", F.posexplode(F.slice("bands", low + 1, high - low)).alias("k", "key")).withColumn("k", F.col("k") + low)
        return out.withColumn("root", F.col("node")) if roots is None else out.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    # Sets are made for the nodes that share any key with another.
    wanted = keyed(0, BANDS, None)
    wanted = wanted.join(staged(spark, shards(wanted), "all-shards").select("k", "key"), ["k", "key"], "left_semi").select("node").distinct()
    wanted = staged(spark, nodes.join(wanted, "node", "left_semi").select("node", "first.file", "first.at"), "wanted")
    found = rows_of(rows.select(F.col(text).alias("text"), "file", "at"), wanted).join(wanted, ["file", "at"])
    sets = staged(spark, found.select("node", signatures("text").alias("s")).select("node", "s.*"), "sets")

    roots, edges = None, None
    for low, high in ROUNDS:
        now = keyed(low, high, roots)
        new = staged(spark, links(now, shards(now, tree), sets), "links")
        edges = new if edges is None else edges.unionByName(new)
        roots = staged(spark, components(spark, edges), "roots")
    grouped = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root"))
    kept = staged(spark, grouped.agg(F.min("first").alias("first")).select("first.file", "first.at"), "kept")
    gone = staged(spark, rows_without(sketched.select("order.file", "order.at"), kept), "gone")
    return rows_without(rows, gone).drop("file", "at").toDF(*docs.columns)


__all__ = ["forest", "keep_one", "links", "shards", "shingle_set", "similar"]
