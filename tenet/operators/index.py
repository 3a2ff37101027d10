"""A search index: postings of tokens with their places, so that searches join lists of postings and scan no texts.

A posting says that a token (marks folded) stands in a row's column at a place. Postings lie in BUCKETS folders by a hash of the token's
first two letters, so that words and beginnings read one folder each, sorted by token inside. A refresh adds the postings of rows after the
last one's mark as a new part; parts are tables of their own, and `merged` writes them together.

A phrase is found by counting: its words' postings, each set back by its place in the phrase, meet where it begins. All atoms of a search
are counted in one pass, which leaves a set of bits for each row; the search is a condition on them. Phrases don't run across columns.

Cases: rows without texts have no postings. Beginnings of one letter read all folders. A search without words finds nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenet.operators.sync import BETWEEN, SEARCHED, Atom, fold, folded, judged, parse_search, words_of
from tenet.streaming.feed import exists

BUCKETS = 64
POSTING = "token string, id string, tx string, part int, place int, refresh string, bucket int"


def bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(token, 1, 2)), F.lit(BUCKETS)).cast("int")


def postings(claims: DataFrame) -> DataFrame:
    """(token, id, tx, part, place) of all texts; part: the column's number."""
    texts = F.array(*[F.coalesce(F.col(c), F.lit("")) for c in SEARCHED])
    parts = claims.select("id", "tx", F.posexplode(texts).alias("part", "text")).where("text != ''")
    tokens = F.array_remove(F.split(folded(F.col("text")), BETWEEN), "")
    return parts.select("id", "tx", "part", F.posexplode(tokens).alias("place", "token")).select("token", "id", "tx", "part", "place")


@dataclass(frozen=True)
class Index:
    """Postings below a path, in a folder a refresh."""

    spark: SparkSession
    path: str

    def read(self) -> DataFrame:
        return self.spark.read.schema(POSTING).parquet(f"{self.path}/postings") if exists(self.spark, f"{self.path}/postings") else self.spark.createDataFrame([], POSTING)

    def mark(self) -> str | None:
        """The latest row that is indexed."""
        if not exists(self.spark, f"{self.path}/marks"):
            return None
        return self.spark.read.schema("mark string").parquet(f"{self.path}/marks").agg(F.max("mark")).first()[0]

    def refresh(self, claims: DataFrame) -> Index:
        """With the rows after the mark. Rows that come late with older ids are added by `add`."""
        mark = self.mark()
        return self.add(claims if mark is None else claims.where(F.col("tx") > mark))

    def add(self, claims: DataFrame) -> Index:
        last = claims.agg(F.max("tx")).first()[0]
        if last is not None:
            self._write(postings(claims), last)
            self.spark.createDataFrame([(last,)], "mark string").coalesce(1).write.mode("append").parquet(f"{self.path}/marks")
        return self

    def _write(self, rows: DataFrame, name: str) -> None:
        # A hot token's postings are dealt over several files: nothing but a search needs them together.
        rows = rows.withColumn("bucket", bucket(F.col("token")))
        rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{self.path}/postings/refresh={name}")

    def search(self, expression: str) -> DataFrame:
        """(id, tx) of the rows that a boolean search finds."""
        return found(self.read(), expression)

    def phrase(self, text: str) -> DataFrame:
        """(id, tx) of the rows that have the phrase in one of their texts."""
        return counted(self.read(), Atom(tuple(words_of(fold(text))), False))


def atoms(tree) -> list[Atom]:
    return [tree] if isinstance(tree, Atom) else [a for t in tree[1:] for a in atoms(t)]


def stands(word: str, beginning: bool) -> Column:
    """Which postings may be a word of an atom's."""
    token = F.col("token")
    own = (token >= word) & token.startswith(word) if beginning else token == word
    if beginning and len(word) < 2:
        return own
    return own & (F.col("bucket") == bucket(F.lit(word)))


def found(index: DataFrame, expression: str) -> DataFrame:
    """(id, tx) by one pass over the postings of all words of the search."""
    tree = parse_search(expression)
    every = list(dict.fromkeys(a for a in atoms(tree) if a.words))
    if not every:
        return index.select("id", "tx").limit(0)
    if len(every) > 63:
        raise ValueError("a search has at most 63 words and phrases")
    uses = [(n, k, len(a.words), stands(w, a.open and k == len(a.words) - 1)) for n, a in enumerate(every) for k, w in enumerate(a.words)]
    rows = index.where(reduce(lambda a, b: a | b, [u[3] for u in uses]))
    hit = F.array_compact(F.array(*[F.when(u[3], F.struct(F.lit(u[0]).alias("atom"), F.lit(u[1]).alias("k"), F.lit(u[2]).alias("size"))) for u in uses]))
    rows = rows.select("id", "tx", "part", "place", F.explode(hit).alias("h"))
    begun = rows.groupBy("id", "tx", "part", F.col("h.atom").alias("atom"), (F.col("place") - F.col("h.k")).alias("start"), F.col("h.size").alias("size")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h.k"))).alias("words"))
    begun = begun.where(F.bit_count("words") == F.col("size"))
    flags = begun.groupBy("id", "tx").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("atom"))).alias("flags"))
    has = lambda a: F.col("flags").bitwiseAND(F.lit(1 << every.index(a))) != 0 if a.words else F.lit(False)
    return flags.where(judged(tree, has)).select("id", "tx")


def counted(index: DataFrame, atom: Atom) -> DataFrame:
    """(id, tx) of one phrase."""
    if not atom.words:
        return index.select("id", "tx").limit(0)
    return found(index, '"' + " ".join(atom.words) + '"')


def merged(index: Index, path: str) -> Index:
    """The same postings in one part, at another path."""
    out = Index(index.spark, path)
    last = index.mark()
    if last is not None:
        out._write(index.read().drop("bucket", "refresh"), last)
        out.spark.createDataFrame([(last,)], "mark string").coalesce(1).write.parquet(f"{path}/marks")
    return out
