"""Graph recursion over current claims: alias components, transitive verbs, support edges, lineage.

A graph of at most DRIVER_EDGES edges (counted first) is walked on the driver, as far as its pairs stay within MOST_PAIRS; larger
ones, and those with more pairs, are Spark jobs: label propagation with jumps, doubling of paths, frontiers from seeds.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenet.functions.keys import is_entity
from tenet.operators.belief import believed
from tenet.staging import new_path
from tenet.staging import staged as written

PAIR = T.StructType([T.StructField("src", T.StringType()), T.StructField("dst", T.StringType())])
#: A graph of at most so many edges is walked on the driver, for at most so many pairs.
DRIVER_EDGES, MOST_PAIRS = 20_000, 200_000
#: Steps of doubling: enough for chains of 2^30 hops.
MOST_STEPS = 30


def edges_of_verb(claims: DataFrame, verb: str, bound: str | None = None) -> DataFrame:
    """(src, dst) of current supported relations between entities."""
    rows = believed(claims.where((F.col("verb") == verb) & F.col("object").isNotNull()), "subject", "object", bound=bound)
    rows = rows.where(is_entity(F.col("subject")) & is_entity(F.col("object")))
    return rows.select(F.col("subject").alias("src"), F.col("object").alias("dst")).distinct()


def alias_edges(claims: DataFrame, verb: str = "ALIAS") -> DataFrame:
    e = edges_of_verb(claims, verb)
    return e.union(e.select("dst", "src")).where("src <> dst").distinct()


def representatives(spark: SparkSession, claims: DataFrame, verb: str = "ALIAS", driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(name, rep) for every name with an alias: rep is the least name that aliases connect it with.

    Labels spread along edges and jump to their label's label, so rounds are logarithmic in a chain's length; only minima are
    shuffled."""
    edges = written(spark, alias_edges(claims, verb), "alias")
    if (n := edges.count()) <= driver_edges:
        return components_on_driver(spark, [tuple(r) for r in edges.collect()] if n else [])
    labels = written(spark, edges.groupBy(F.col("src").alias("name")).agg(F.least(F.min("src"), F.min("dst")).alias("rep")), "labels")
    for _ in range(64):
        near = edges.join(labels, edges["dst"] == labels["name"]).groupBy(F.col("src").alias("name")).agg(F.min("rep").alias("near"))
        stepped = labels.join(near, "name", "left").select("name", "rep", F.least("rep", "near").alias("new"))
        jump = stepped.select(F.col("name").alias("new"), F.col("new").alias("far"))
        after = written(spark, stepped.join(jump, "new", "left").select("name", "rep", F.least("new", "far").alias("new")), "labels")
        changed = after.where("new < rep").limit(1).count()
        labels = after.select("name", F.col("new").alias("rep"))
        if not changed:
            return labels
    raise RuntimeError("alias components did not settle")


def components_on_driver(spark: SparkSession, edges: list[tuple[str, str]]) -> DataFrame:
    up: dict[str, str] = {}

    def find(x: str) -> str:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return spark.createDataFrame([(x, find(x)) for x in list(up)], "name string, rep string")


def aliases_of(reps: DataFrame, name: str) -> DataFrame:
    """The name itself first, then its aliases in order."""
    mine = reps.where(F.col("name") == name).select(F.col("rep"))
    found = reps.join(F.broadcast(mine.limit(1)), "rep", "left_semi").select("name").union(reps.sparkSession.createDataFrame([(name,)], "name string")).distinct()
    return found.orderBy((F.col("name") != name), "name")


def closure(spark: SparkSession, edges: DataFrame, seeds: Iterable[str] | None = None, backwards: bool = False, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(src, dst) pairs of one or more hops; with seeds, those from them (or, backwards, into them). Cycles end.

    On Spark, all pairs by doubling: after k steps all paths of up to 2^k hops. From seeds, a frontier that joins the edges, and
    leaves what it has seen."""
    edges = written(spark, edges.select("src", "dst").distinct(), "edges")
    if backwards:
        edges = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = None
    if edges.count() <= driver_edges:
        found = walk(edges.collect(), None if seeds is None else list(seeds))
    if found is not None:
        pairs = spark.createDataFrame(found, PAIR)
    elif seeds is not None:
        pairs = from_seeds(spark, edges, list(seeds))
    else:
        pairs = doubled(spark, edges)
    return pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if backwards else pairs


def walk(edges: list, seeds: list[str] | None, most: int = MOST_PAIRS) -> list[tuple[str, str]] | None:
    """The pairs, or None once there are more than `most`."""
    next_: dict[str, list[str]] = {}
    for a, b in edges:
        next_.setdefault(a, []).append(b)
    out: list[tuple[str, str]] = []
    for s in next_ if seeds is None else seeds:
        seen: set[str] = set()
        todo = list(next_.get(s, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                if len(out) + len(seen) > most:
                    return None
                todo += next_.get(x, ())
        out += [(s, x) for x in seen]
    return out


def doubled(spark: SparkSession, edges: DataFrame) -> DataFrame:
    pairs, before = edges, edges.count()
    for _ in range(MOST_STEPS):
        longer = pairs.join(pairs.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst"))
        pairs = written(spark, pairs.union(longer).distinct(), "pairs")
        now = pairs.count()
        if now == before:
            break
        before = now
    return pairs


def from_seeds(spark: SparkSession, edges: DataFrame, seeds: list[str]) -> DataFrame:
    """A hop a job: each adds its new pairs to one folder, so what was found before is never written again."""
    at = new_path(spark, "reached")
    step = edges.select(F.col("src").alias("dst"), F.col("dst").alias("far"))
    frontier = spark.createDataFrame([(s, s) for s in dict.fromkeys(seeds)], PAIR)
    seen = spark.createDataFrame([], PAIR)
    hop = 0
    while True:
        new = frontier.join(step, "dst").select("src", F.col("far").alias("dst")).distinct().join(seen, ["src", "dst"], "left_anti")
        new.write.parquet(f"{at}/hop={hop}")
        frontier = spark.read.schema(PAIR).parquet(f"{at}/hop={hop}")
        seen = spark.read.schema(PAIR).parquet(f"{at}/hop=*")
        if frontier.limit(1).count() == 0:
            return seen
        hop += 1


def support(closed: DataFrame, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst, edge_src, edge_dst): the edges on some path between the ends of each pair."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("src")).distinct()
    reach = closed.select("src", "dst").union(nodes.select("src", F.col("src").alias("dst"))).distinct()
    out = pairs.select("src", "dst").join(reach.select("src", F.col("dst").alias("edge_src")), "src")
    out = out.join(edges.select(F.col("src").alias("edge_src"), F.col("dst").alias("edge_dst")), "edge_src")
    back = reach.select(F.col("src").alias("edge_dst"), "dst")
    return out.join(back, ["edge_dst", "dst"], "left_semi").select("src", "dst", "edge_src", "edge_dst").distinct()


def within(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The edges of which both ends are ends of pairs."""
    nodes = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    for end in ("src", "dst"):
        edges = edges.join(nodes, edges[end] == nodes["node"], "left_semi")
    return edges


def through_aliases(spark: SparkSession, edges: DataFrame, reps: DataFrame) -> DataFrame:
    """Edges between representatives: hops that cross aliases are hops of one node."""
    r = reps.select("name", "rep")
    out = edges.join(r, edges["src"] == r["name"], "left").select(F.coalesce("rep", "src").alias("src"), "dst")
    return out.join(r, out["dst"] == r["name"], "left").select("src", F.coalesce("rep", "dst").alias("dst")).distinct()


def stored_names(edges: DataFrame, reps: DataFrame, end: str) -> DataFrame:
    """(rep, name): the names that edges have at that end, by their representative."""
    names = edges.select(F.col(end).alias("name")).distinct()
    return names.join(reps.select("name", "rep"), "name", "left").select(F.coalesce("rep", "name").alias("rep"), "name")


def expanded(pairs: DataFrame, edges: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs of representatives as pairs of the names that are stored: sources as edges begin, destinations as they end."""
    src, dst = stored_names(edges, reps, "src"), stored_names(edges, reps, "dst")
    out = pairs.join(src.withColumnsRenamed({"rep": "src", "name": "from"}), "src")
    return out.join(dst.withColumnsRenamed({"rep": "dst", "name": "to"}), "dst").select(F.col("from").alias("src"), F.col("to").alias("dst")).distinct()


def lineage(spark: SparkSession, edges: DataFrame, ids: Iterable[str], depth: int = 16, up: bool = False) -> DataFrame:
    """(root, id, depth, truncated): what the roots rest on (or, up, what rests on them), each at its least depth, to a depth. A row is
    truncated if it is as deep as that and has more below it."""
    a, b = ("child_id", "parent_id") if up else ("parent_id", "child_id")
    step = edges.select(F.col(a).alias("id"), F.col(b).alias("next")).distinct()
    schema = "root string, id string, depth int"
    frontier = spark.createDataFrame([(i, i, 0) for i in ids], schema)
    seen = frontier
    for d in range(1, depth + 1):
        new = frontier.join(step, "id").select("root", F.col("next").alias("id"), F.lit(d).alias("depth")).distinct()
        new = new.join(seen, ["root", "id"], "left_anti").select("root", "id", "depth")
        frontier = written(spark, new, "lineage")
        if frontier.limit(1).count() == 0:
            break
        seen = seen.union(frontier)
    more = seen.where(F.col("depth") == depth).join(step.select("id"), "id", "left_semi").select("root", "id", F.lit(True).alias("truncated"))
    return seen.join(more, ["root", "id"], "left").select("root", "id", "depth", F.coalesce("truncated", F.lit(False)).alias("truncated"))
