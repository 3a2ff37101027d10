"""Union of stores by row identity, phrase and boolean search, and scoring against a golden set."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEARCHED = ("subject", "verb", "object", "attribute", "value_text", "comment", "raw_line")


def merged(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """All rows of both, those with the same id once (ours): merging again changes nothing. Rows keep their own tx."""
    return ours.unionByName(theirs.dropDuplicates(["id"]).join(ours.select("id"), "id", "left_anti").select(*ours.columns))


def merged_edges(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    return ours.unionByName(theirs).distinct()


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


#: Latin letters with marks, and the letters alone; by canonical decomposition.
MARKED = [c for c in map(chr, range(0xC0, 0x1F00)) if len(unicodedata.normalize("NFD", c)) > 1 and unicodedata.name(c, "").startswith("LATIN")]
PLAIN = [unicodedata.normalize("NFD", c)[0] for c in MARKED]
#: Marks that stand after their letter, and what no token holds.
MARKS, BETWEEN = r"\p{Mn}+", r"[^\p{L}\p{N}\p{M}]+"


def folded(c: Column) -> Column:
    """Lower case, without marks on letters."""
    return F.lower(F.translate(F.regexp_replace(c, MARKS, ""), "".join(MARKED), "".join(PLAIN)))


def fold(text: str) -> str:
    bare = "".join(c for c in text if unicodedata.category(c) != "Mn")
    return bare.translate({ord(a): b for a, b in zip(MARKED, PLAIN, strict=True)}).lower()


def words_of(text: str) -> list[str]:
    """The tokens of a text on the driver: runs of letters, digits and marks."""
    return "".join(c if unicodedata.category(c)[0] in "LNM" else " " for c in text).split()


def spaced(c: Column, fold_marks: bool = False) -> Column:
    """The tokens of a text with one blank around each."""
    text = F.coalesce(c, F.lit(""))
    return F.concat(F.lit(" "), F.regexp_replace(folded(text) if fold_marks else F.lower(text), BETWEEN, " "), F.lit(" "))


def has_phrase(c: Column, phrase: str, fold_marks: bool = False) -> Column:
    """Do the phrase's tokens stand in the text one after another?"""
    words = words_of(fold(phrase) if fold_marks else phrase.lower())
    return spaced(c, fold_marks).contains(f" {' '.join(words)} ") if words else F.lit(False)


@dataclass(frozen=True)
class Atom:
    """Words that stand one after another; open: the last one is a beginning."""

    words: tuple[str, ...]
    open: bool


def parse_search(expression: str) -> tuple:
    """A boolean search as a tree of Atoms and ("and" | "or" | "without", left, right): words, "phrases", beginnings (word*), AND
    (also by standing side by side), OR, NOT and brackets, marks folded.

    NOT takes what follows it from what stands before it; AND binds closer than OR, NOT closer than AND."""
    tokens = re.findall(r'"[^"]*"\*?|[()]|[^\s()"]+', expression)
    at = 0

    def atom():
        nonlocal at
        if at >= len(tokens) or tokens[at] in (")", "AND", "OR", "NOT"):
            raise ValueError(f"a search term is missing: {expression}")
        token = tokens[at]
        at += 1
        if token == "(":
            inner = either()
            if at >= len(tokens) or tokens[at] != ")":
                raise ValueError(f"a bracket is open: {expression}")
            at += 1
            return inner
        return Atom(tuple(words_of(fold(token))), token.endswith("*"))

    def chain(part, goes_on, name):
        nonlocal at
        out = part()
        while at < len(tokens) and goes_on(tokens[at]):
            at += tokens[at] in ("AND", "OR", "NOT")
            out = (name, out, part())
        return out

    def without():
        return chain(atom, lambda t: t == "NOT", "without")

    def both():
        return chain(without, lambda t: t not in ("OR", ")", "NOT"), "and")

    def either():
        return chain(both, lambda t: t == "OR", "or")

    found = either()
    if at < len(tokens):
        raise ValueError(f"a bracket closes nothing: {expression}")
    return found


def judged(tree, atom) -> Column:
    """The tree as a condition, given that of an Atom."""
    if isinstance(tree, Atom):
        return atom(tree)
    name, a, b = tree
    left, right = judged(a, atom), judged(b, atom)
    return left | right if name == "or" else left & (~right if name == "without" else right)


def matching(c: Column, expression: str) -> Column:
    """Does a text match a boolean search?"""
    text = spaced(c, True)
    return judged(parse_search(expression), lambda a: text.contains(f" {' '.join(a.words)}" + ("" if a.open else " ")) if a.words else F.lit(False))


def search(claims: DataFrame, phrase: str, limit: int = 20, raw: bool = False) -> DataFrame:
    """The newest rows with the phrase in any of their texts, marks folded; raw takes a boolean search over all texts together."""
    if raw:
        found = matching(F.concat_ws(" | ", *SEARCHED), phrase)
    else:
        found = has_phrase(F.col(SEARCHED[0]), phrase, True)
        for c in SEARCHED[1:]:
            found |= has_phrase(F.col(c), phrase, True)
    return claims.where(found).orderBy(F.desc("tx")).limit(limit)


def agreement(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    return F.abs(a - b) <= tolerance * F.greatest(F.abs(b), F.lit(1e-300))


def score(produced: DataFrame, golden: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """precision, recall and f1 over facts (claim_key, value_num, value_text), the last of a key counting on both sides."""
    def last(df: DataFrame) -> DataFrame:
        return df.groupBy("claim_key").agg(F.max_by(F.struct("value_num", "value_text"), "tx").alias("v"))

    p, g = last(produced), last(golden).withColumnRenamed("v", "w")
    both = p.join(g, "claim_key", "full")
    same = F.when(F.col("w.value_num").isNotNull() & F.col("v.value_num").isNotNull(), agreement(F.col("v.value_num"), F.col("w.value_num"), tolerance)).otherwise(F.col("v.value_text").eqNullSafe(F.col("w.value_text")) & F.col("v").isNotNull() & F.col("w").isNotNull())
    out = both.agg(F.count_if(F.coalesce(same, F.lit(False))).alias("hit"), F.count("v").alias("produced"), F.count("w").alias("golden"))
    precision, recall = F.col("hit") / F.col("produced"), F.col("hit") / F.col("golden")
    return out.select("hit", "produced", "golden", precision.alias("precision"), recall.alias("recall"), (2 * precision * recall / (precision + recall)).alias("f1"))


def compare(found: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(missing, unexpected) solutions of a query."""
    columns = expected.columns
    return expected.select(*columns).exceptAll(found.select(*columns)), found.select(*columns).exceptAll(expected.select(*columns))
