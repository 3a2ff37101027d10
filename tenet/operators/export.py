"""Claims and their edges as text: a forest of lines, nested lines below what they qualify, without a driver.

Text is a tree and edges are a graph. Each row has its own nested lines once: where it stands least deep, of equal depths at the least
path. Elsewhere it is a line alone, told again for the sake of that one edge. Paths are ids from the root down, so their order is
that of the text. Rows that only a cycle holds begin at the least id among neighbours, and the cycle ends where it comes back.

Edges of rows that are told no longer, for others of their keys came, go to these. Edges of which an end is not told are left out, and so are those
from a row to itself; of equal ones one is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenet.operators.closure import written

#: Order of nested lines: by role, then by id.
ROLES = ("WHEN", "VIA", "BECAUSE", "QUALIFIES")
#: Between the ids of a path: below all their characters.
STEP = "\x01"


def remapped(told: DataFrame, claims: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between told rows, each end at the told row of its key, if it isn't told itself."""
    keys = claims.select("id", "claim_key").join(told.groupBy("claim_key").agg(F.max("id").alias("now")), "claim_key")
    ends = keys.join(told.select("id", F.lit(True).alias("itself")), "id", "left").select("id", F.when(F.col("itself"), F.col("id")).otherwise(F.col("now")).alias("at"))
    out = edges.join(ends.select(F.col("id").alias("parent_id"), F.col("at").alias("parent")), "parent_id").join(ends.select(F.col("id").alias("child_id"), F.col("at").alias("child")), "child_id")
    return out.where("parent != child").select("parent", "role", "child").distinct()


def step(path: Column, role: Column, child: Column) -> Column:
    order = F.coalesce(F.array_position(F.array(*[F.lit(r) for r in ROLES]), role), F.lit(0)).cast("string")
    return F.concat(path, F.lit(STEP), order, child)


def forest(spark: SparkSession, told: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, role, depth, path) of every line, from rows (id) and edges (parent, role, child) between them: a job or two a level."""
    edges = written(spark, edges, "edges")
    ids = told.select("id").distinct()
    frontier = ids.join(edges.select(F.col("child").alias("id")).distinct(), "id", "left_anti").select("id", F.lit(None).cast("string").alias("role"), F.lit(0).alias("depth"), F.col("id").alias("path"))
    out = placed = None
    while True:
        frontier = written(spark, frontier, "lines")
        while frontier.limit(1).count():
            out = frontier if out is None else out.unionByName(frontier)
            # Where a row stands least deep, at its least path there, it has its nested lines.
            first = frontier.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("path"))).where("n = 1").drop("n")
            first = first if placed is None else first.join(placed, "id", "left_anti")
            first = written(spark, first, "placed")
            placed = first.select("id") if placed is None else placed.unionByName(first.select("id"))
            below = first.select(F.col("id").alias("parent"), "depth", "path").join(edges, "parent")
            frontier = written(spark, below.select(F.col("child").alias("id"), "role", (F.col("depth") + 1).alias("depth"), step(F.col("path"), F.col("role"), F.col("child")).alias("path")), "lines")
        rest = ids if placed is None else ids.join(placed, "id", "left_anti")
        rest = written(spark, rest, "rest")
        if rest.limit(1).count() == 0:
            break
        inside = edges.join(rest.select(F.col("id").alias("child")), "child", "left_semi").join(rest.select(F.col("id").alias("parent")), "parent", "left_semi")
        later = inside.where("parent < child").select(F.col("child").alias("id")).distinct()
        frontier = rest.join(later, "id", "left_anti").select("id", F.lit(None).cast("string").alias("role"), F.lit(0).alias("depth"), F.col("id").alias("path"))
    return frontier.limit(0) if out is None else out


def lines(spark: SparkSession, told: DataFrame, edges: DataFrame, with_tx: bool = False) -> DataFrame:
    """(path, line): the text's lines; in order of path they are the text. with_tx: each after a line with its id."""
    from tenet.store import emitted

    placed = forest(spark, told, edges)
    # A denied condition is told by the word that denies it.
    denied = (F.col("role") == "WHEN") & F.col("negated")
    said = told.withColumn("__negated", F.col("negated")).select("*", emitted().alias("said")).withColumn("negated", F.lit(False))
    said = said.select("id", F.col("__negated").alias("negated"), "said", emitted().alias("plain"))
    rows = placed.join(said, "id")
    body = F.when(denied, F.concat(F.lit("UNLESS "), "plain")).when(F.col("role").isNull() | (F.col("role") == "QUALIFIES"), F.col("said")).otherwise(F.concat("role", F.lit(" "), "said"))
    indent = F.repeat(F.lit("  "), F.col("depth"))
    line = F.concat(indent, body)
    if with_tx:
        line = F.concat(indent, F.lit(";@ "), "id", F.lit("\n"), line)
    return rows.select("path", line.alias("line"))
