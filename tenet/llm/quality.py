"""Quality rules by weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a document. Most rules look for one defect and abstain where they find
none, since the absence of one defect is no sign that there is no other. Expectation-maximisation over the counts of vote
patterns estimates, without labels, how often each rule votes which way on good and on bad documents, and the share of good
ones; the posterior probability of good replaces "all rules must pass". There are at most 3^rules patterns whatever the input,
so only their counts are gathered, and the posteriors go back as a table of that size.

Cases: null and empty texts have no words: base_failed, not kept. Repeated rows and ties are judged alike, each by its own
text. On an empty table EM has nothing to fit and the result is empty. `keep_good` carries all columns, whatever their names;
`judge` carries those that it is told to, and a name of its own among them stands twice in its result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenet.llm.common import BLANKS, arrow_sized, forget, spark_type, staged, struct_array

SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
TYPE = pa.struct([*[(c, pa.int64()) for c in STATS], ("pattern", pa.int32())])
#: Windows of words that count as repeated when a text has them twice.
WINDOW = 5
RULES = ("length", "symbols", "clean words", "duplicate lines", "repetition", "distinct words", "word length", "sentences")
#: Distinct words are counted in stretches of so many words, so their share does not fall with the length of a text.
STRETCH = 100
#: A word of letters with at most one mark after it.
CLEAN = re.compile(r"(?<!\S)[\"'(]?[^\W\d_]+[.,;:!?)\"']?(?!\S)")


def stats(text: str | None) -> tuple[int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split on exactly the ASCII blanks
    chars = len(text) - sum(map(text.count, BLANKS))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), n_repeated(words)


def n_repeated(words: list[bytes]) -> int:
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    windows = list(zip(*[words[i:] for i in range(WINDOW)], strict=False))
    if len(set(windows)) == n:
        return 0
    seen = Counter(windows)
    total, end = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + WINDOW - max(i, end)
            end = i + WINDOW
    return total


def distinct_share(text: str) -> float:
    """Distinct words of each stretch, over all words."""
    words = text.split()
    return sum(len(set(words[i : i + STRETCH])) for i in range(0, len(words), STRETCH)) / max(1, len(words))


def votes(text: str | None, s: Sequence[int]) -> list[int]:
    """One of -1, 0, 1 for each of RULES."""
    n, chars, symbols, dup, repeat = s
    if not n:
        return [-1, 0, 0, 0, 0, 0, 0, 0]
    lines = text.count("\n") + 1
    ends = text.count(". ") + text.count(".\n") + text.endswith(".") + text.count("! ") + text.count("? ")
    clean = len(CLEAN.findall(text)) / n
    distinct = distinct_share(text) if n >= 20 else 1.0
    mean = chars / n
    return [
        -1 if n < 10 else 0,
        -1 if symbols > 0.1 * n else 0,
        -1 if clean < 0.65 else 1 if clean > 0.95 else 0,
        -1 if dup >= 3 and dup > 0.3 * lines else 0,
        -1 if repeat > 0.2 * n else 0,
        -1 if distinct < 0.2 else 0,
        -1 if mean > 12 or mean < 2 else 0,
        -1 if n >= 40 and ends * 80 < n else 1 if ends * 25 >= n else 0,
    ]


def encode(vote: Sequence[int]) -> int:
    return sum((v + 1) * 3**i for i, v in enumerate(vote))


def decode(pattern: int, rules: int = len(RULES)) -> list[int]:
    return [pattern // 3**i % 3 - 1 for i in range(rules)]


@F.arrow_udf(spark_type(TYPE))
def judged(texts: pa.Array) -> pa.Array:
    forget()
    rows = []
    for t in texts.to_pylist():
        s = stats(t)
        rows.append((*s, encode(votes(t, s))))
    return struct_array(rows, TYPE)


#: Prior shares of the votes bad, none, good on good and on bad documents, and of good documents; the prior counts as
#: PRIOR_WEIGHT of the documents, so rules keep their direction and no class takes the place of the other.
PRIOR = {1: (0.01, 0.39, 0.60), -1: (0.40, 0.40, 0.20)}
PRIOR_GOOD, PRIOR_WEIGHT = 0.8, 0.1


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, rules: int = len(RULES)) -> tuple[np.ndarray, dict]:
    """EM of the two-class model with a rule's three outcomes: the posterior of good for each pattern, and what was estimated."""
    v = np.array([decode(p, rules) for p in patterns], int).reshape(-1, rules)
    total, post, good = counts.sum(), np.zeros(len(v)), PRIOR_GOOD
    shares = {y: np.tile(np.array(PRIOR[y])[:, None], (1, rules)) for y in PRIOR}  # outcome x rule
    at = np.arange(rules)
    for _ in range(rounds):
        a = math.log(good) + np.log(shares[1][v + 1, at]).sum(axis=1)
        b = math.log(1 - good) + np.log(shares[-1][v + 1, at]).sum(axis=1)
        new = 1 / (1 + np.exp(np.clip(b - a, -700, 700)))
        weight = PRIOR_WEIGHT * total + 1
        for y, w in ((1, counts * new), (-1, counts * (1 - new))):
            cast = np.stack([w @ (v == k) for k in (-1, 0, 1)]) + weight * np.array(PRIOR[y])[:, None]
            shares[y] = cast / cast.sum(axis=0)
        good = float((counts @ new + weight * PRIOR_GOOD) / (total + weight))
        done = not len(new) or np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
    return post, {"good": good, "on_good": shares[1], "on_bad": shares[-1]}


def judge(spark: SparkSession, docs: DataFrame, carry: Sequence[str] = ("doc_id",), threshold: float = 0.5, text_column: str = "text") -> DataFrame:
    """The carried columns, the statistics, `quality` (posterior of good), base_failed and kept.

    The statistics are staged once, since EM needs their patterns' counts before any verdict."""
    arrow_sized(spark)
    carried = [F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]
    rows = staged(spark, docs.select(*carried, judged(F.col(text_column)).alias("s")), "quality")
    found = rows.groupBy("s.pattern").count().collect()  # 3^8 rows at most
    patterns, counts = np.array([r[0] for r in found], int), np.array([r[1] for r in found], float)
    post, _ = fit(patterns, counts)
    table = spark.createDataFrame([(int(p), float(q)) for p, q in zip(patterns, post, strict=True)], "pattern int, quality double")
    s = {c: F.col(f"s.{c}") for c in STATS}
    failed = (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])
    out = rows.join(F.broadcast(table), F.col("s.pattern") == F.col("pattern"), "left")
    names = [F.col(f"c{i}").alias(c) for i, c in enumerate(carry)]
    return out.select(*names, *[s[c].alias(c) for c in STATS], "quality", failed.alias("base_failed"), (~failed & (F.coalesce("quality", F.lit(0.0)) >= threshold)).alias("kept"))


def keep_good(spark: SparkSession, docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents kept, with their own columns only, whatever they are called."""
    arrow_sized(spark)
    names = [f"c{i}" for i in range(len(docs.columns))]
    out = judge(spark, docs.toDF(*names), names, threshold, names[docs.columns.index("text")])
    return out.where("kept").select(*names).toDF(*docs.columns)
