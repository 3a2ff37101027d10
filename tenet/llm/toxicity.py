"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult, threat, target, announcement ("will", "I"), negation, reported speech, end of a clause, other.
Five transducers rewrite the symbols of a clause one after another:

* negation: an insult or a threat within three words after a negation is denied;
* reported speech: what follows it in the clause is quoted;
* insults: one within four words after a target is aimed, and a target within four words after one that is not aims it, too;
* threats: likewise, and one within three words after an announcement is announced;

and composed they are one machine, run over whole clauses. So "you are an idiot" and "idiot, you" are both an aimed insult, "I
will kill you" is an announced, aimed threat, and "kill" alone a bare one. A match counts its word's lexical weight times the
factor of what the machine made of it. A document's score is a logistic function of its matches' sum and of its length.

Insults are learned: words and word beginnings that toxic training documents have far more often than others, with log odds as
lexical weights. The factors are learned, too, by likelihood within FACTORS' bounds and drawn to its middle values, so that kinds
which the sample hardly shows keep their order. Cue words are fixed values. The fit reads a bounded sample of labelled rows, and
its texts stay in executors: counts of terms and sums of kinds come to the driver. Scoring covers every whole text. Labels are learned only from rows whose
crc32(doc_id as text) mod 4 is not 2.

Cases: null and empty texts, and those without words, get the score of a text without matches. Equal texts have equal scores.
With no labelled rows at all, or none of one class, the lexicon is empty and every score is the base rate (0 without rows).
Repeated rows are scored each. Labels are joined by doc_id; several rows of one doc_id in labels take the largest label, several
texts of one doc_id count as the least of them. Very long texts are read once, a clause at a time.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenet.llm.common import arrow_sized, staged

#: At most so many labelled rows, the first by hash of doc_id, fit the lexicon and the weights.
SAMPLE_ROWS = 6000
#: A term counts if so many toxic sample rows have it, at so many times the rate of other rows; so many of each sort at most.
LEAST_ROWS, LEAST_RATIO, MOST_TERMS = 5, 4.0, 20_000
#: Beginnings of words, in characters, that are terms beside whole words.
STEMS = (4, 5, 6, 7, 8)
THRESHOLD = 0.3
#: Words that a negation, a target and an announcement reach over.
DENIES, AIMS, ANNOUNCES = 3, 4, 3

# Cue words of the grammar, by language.
THREATS = "kill hurt destroy burn shoot stab beat hang töten umbringen verbrennen schlagen tuer frapper brûler détruire matar golpear quemar destruir".split()
TARGETS = "you your yours he she they him her them du dich dir ihr euch sie tu toi vous te ton votre usted ustedes tú ti vosotros".split()
ANNOUNCEMENTS = "i we will shall gonna going ich wir werde werden je nous vais allons yo voy vamos".split()
NEGATIONS = "not no never nobody neither nor isn't aren't don't nicht kein keine nie niemals ne pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says wrote writes claimed quoted reported according sagte schrieb behauptete laut dit écrit affirme selon dijo escribió afirmó según".split()

WORDS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;\n]")
OTHER, INSULT, THREAT, TARGET, ANNOUNCEMENT, NEGATION, REPORT, END = "o i t g a n r e".split()
SYMBOLS = (OTHER, INSULT, THREAT, TARGET, ANNOUNCEMENT, NEGATION, REPORT, END)
#: What the machine makes of insults (i) and threats (t): denied, quoted, aimed, announced, both. After a target, + says that it aims
#: the last insult, - the last threat, * both.
DENIED = {INSULT: "di", THREAT: "dt"}
QUOTED = {INSULT: "qi", THREAT: "qt"}
KINDS = ("i", "I", "t", "T", "ta", "Ta", "di", "dt", "qi", "qt")
AIMED = {"i": "I", "t": "T", "ta": "Ta"}


@dataclass
class Transducer:
    """Deterministic: arcs[state][symbol] = (output, next state); a symbol without an arc is copied and moves as `default` says."""

    arcs: list[dict[str, tuple[str, int]]]
    default: list[int]

    def step(self, state: int, symbol: str) -> tuple[str, int]:
        return self.arcs[state].get(symbol, (symbol, self.default[state]))


def window(cue: str, rewrite: dict[str, str], reach: int) -> Transducer:
    """After the cue, symbols within `reach` words are rewritten; the end of a clause ends that."""
    arcs: list[dict[str, tuple[str, int]]] = [{cue: (cue, reach)}]
    for left in range(1, reach + 1):
        arcs.append({cue: (cue, reach), END: (END, 0)} | {a: (b, left - 1) for a, b in rewrite.items()})
    return Transducer(arcs, [0, *range(reach)])


def clause_wide(cue: str, rewrite: dict[str, str]) -> Transducer:
    """After the cue, symbols are rewritten to the end of the clause."""
    return Transducer([{cue: (cue, 1)}, {cue: (cue, 1), END: (END, 0)} | {a: (b, 1) for a, b in rewrite.items()}], [0, 1])


def targeted(rewrite: dict[str, str], cues: dict[str, str], reach: int) -> Transducer:
    """Aims a match at targets on both sides. rewrite: bare matches and what they are after a target; cues: targets, and what they are
    where they aim the last bare match."""
    # States: words left of a target's reach, and of a bare match's.
    number = {(0, 0): 0}
    todo, arcs, default = [(0, 0)], [], []

    def state(near: int, bare: int) -> int:
        if (near, bare) not in number:
            number[near, bare] = len(todo)
            todo.append((near, bare))
        return number[near, bare]

    while len(arcs) < len(todo):
        near, bare = todo[len(arcs)]
        row = {END: (END, state(0, 0))}
        for cue, aims in cues.items():
            row[cue] = (aims if bare else cue, state(reach, 0))
        for a, b in rewrite.items():
            row[a] = (b, state(near - 1, max(0, bare - 1))) if near else (a, state(0, reach))
        arcs.append(row)
        default.append(state(max(0, near - 1), max(0, bare - 1)))
    return Transducer(arcs, default)


def compose(first: Transducer, second: Transducer, alphabet: Iterable[str]) -> Transducer:
    """The machine that feeds the first's output to the second, over the states that can be reached."""
    symbols, number, todo, arcs, default = list(alphabet), {(0, 0): 0}, [(0, 0)], [], []
    while len(arcs) < len(todo):
        a, b = todo[len(arcs)]
        row = {}
        for s in [*symbols, "\0"]:
            mid, a2 = first.step(a, s)
            out, b2 = second.step(b, mid)
            if (a2, b2) not in number:
                number[a2, b2] = len(todo)
                todo.append((a2, b2))
            row[s] = (out, number[a2, b2])
        default.append(row.pop("\0")[1])
        arcs.append(row)
    return Transducer(arcs, default)


def grammar() -> Transducer:
    machine = window(NEGATION, DENIED, DENIES)
    announced = window(ANNOUNCEMENT, {THREAT: "ta"}, ANNOUNCES)
    insults = targeted({INSULT: "I"}, {TARGET: "g+"}, AIMS)
    threats = targeted({THREAT: "T", "ta": "Ta"}, {TARGET: "g-", "g+": "g*"}, AIMS)
    for part in (clause_wide(REPORT, QUOTED), announced, insults, threats):
        machine = compose(machine, part, SYMBOLS)
    return machine


THREAT_WEIGHT = 2.0
#: Least, likeliest and largest factor of each kind; that of a bare insult is the unit.
FACTORS = {"i": (1.0, 1.0, 1.0), "I": (1.0, 1.5, 4.0), "t": (0.0, 0.1, 0.5), "T": (0.5, 0.7, 1.0), "ta": (0.5, 0.5, 1.0), "Ta": (1.0, 1.5, 4.0), "di": (0.0, 0.3, 1.0), "dt": (0.0, 0.05, 0.1), "qi": (0.0, 0.3, 1.0), "qt": (0.0, 0.05, 0.1)}
#: Steps that the search for factors tries, its rounds, and the weight of a factor's distance (in doublings) from its likeliest value.
STEPS, ROUNDS, PULL = (0.5, 0.7, 1.4, 2.0), 2, 1.0
CUES = dict.fromkeys(ANNOUNCEMENTS, ANNOUNCEMENT) | dict.fromkeys(THREATS, THREAT) | dict.fromkeys(TARGETS, TARGET) | dict.fromkeys(NEGATIONS, NEGATION) | dict.fromkeys(REPORTS, REPORT) | dict.fromkeys(".!?;\n", END)
ENDS = frozenset(".!?;\n")
THREAT_SET = frozenset(THREATS)
@dataclass
class Model:
    """Lexical weights of whole words and of word beginnings, the kinds' factors, and the logistic weights (first the intercept)."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    factors: list[float] = field(default_factory=lambda: [FACTORS[k][1] for k in KINDS])
    beta: list[float] = field(default_factory=lambda: [-700.0])
    machine: Transducer = field(default_factory=grammar)

    def __post_init__(self) -> None:
        self.openers = {s[: STEMS[0]] for s in self.stems}

    def weight(self, word: str) -> float:
        """The largest lexical weight of the word or one of its beginnings; 0 if it has none."""
        w, stems = self.words.get(word, 0.0), self.stems
        if word[: STEMS[0]] in self.openers:
            for n in STEMS:
                w = max(w, stems.get(word[:n], 0.0))
        return w

    def kinds(self, tokens: list[str], strong: dict[int, float], start: int = 0, end: int | None = None) -> dict[str, float]:
        """Sums of lexical weights by what the machine makes of a clause's insults (at the places of strong) and threats."""
        state, out, step = 0, {}, self.machine.step
        last = {INSULT: ("", 0.0), THREAT: ("", 0.0)}  # the bare match that a later target may aim
        for i in range(start, len(tokens) if end is None else end):
            symbol = INSULT if i in strong else CUES.get(tokens[i], OTHER)
            made, state = step(state, symbol)
            if symbol in last:
                w = strong.get(i, THREAT_WEIGHT)
                out[made] = out.get(made, 0.0) + w
                if made in AIMED:
                    last[symbol] = (made, w)
            elif symbol == TARGET and len(made) == 2:
                for of in {"+": INSULT, "-": THREAT, "*": INSULT + THREAT}[made[1]]:
                    kind, w = last[of]
                    out[kind] -= w
                    out[AIMED[kind]] = out.get(AIMED[kind], 0.0) + w
        return out

    def sums(self, text: str | None) -> tuple[list[float], int]:
        """Lexical weights of all matches by kind, in the order of KINDS, and the number of tokens."""
        tokens = WORDS.findall((text or "").lower())
        words, openers = self.words, self.openers
        strong = {i: w for i, t in enumerate(tokens) if (t in words or t[:4] in openers) and (w := self.weight(t)) > 0}
        threats = [i for i, t in enumerate(tokens) if t in THREAT_SET] if THREAT_SET.intersection(tokens) else []
        sums, done = dict.fromkeys(KINDS, 0.0), -1
        for i in sorted({*strong, *threats}):
            if i <= done:
                continue
            start, done = i, i
            while start > 0 and tokens[start - 1] not in ENDS:
                start -= 1
            while done + 1 < len(tokens) and tokens[done + 1] not in ENDS:
                done += 1
            for k, w in self.kinds(tokens, strong, start, done + 1).items():
                sums[k] += w
        return [sums[k] for k in KINDS], len(tokens)

    def score(self, text: str | None) -> float:
        if len(self.beta) == 1:
            return logistic(self.beta[0])
        sums, n = self.sums(text)
        return logistic(float(features(np.array([sums]), np.array([n]), np.array(self.factors))[0] @ np.array(self.beta)))


def features(sums: np.ndarray, n: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """For each document: 1, log of its matches' sum, of that a thousand words, of its words, and the first and third together."""
    total, n = np.maximum(0.0, sums) @ factors, np.maximum(20, n)
    x, size = np.log1p(total), np.log(n)
    return np.column_stack([np.ones(len(n)), x, np.log1p(1000 * total / n), size, x * size])


def logistic(x: float) -> float:
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))


def terms(text: str | None) -> list[str]:
    """The distinct words of a text, after w, and their distinct beginnings, after s."""
    words = {w for w in WORDS.findall((text or "").lower()) if w not in ENDS}
    return [*("w" + w for w in words), *{"s" + w[:n] for w in words for n in STEMS if len(w) > n}]


@F.arrow_udf(T.ArrayType(T.StringType()))
def term_lists(texts: pa.Array) -> pa.Array:
    return pa.array([terms(t) for t in texts.to_pylist()], pa.list_(pa.string()))


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Newton's method with a small ridge on all but the intercept: the weights, and the penalised log likelihood."""
    beta, pen = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    pen[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pen, x.T @ (y - p) - pen @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ beta, -35, 35))), 1e-15, 1 - 1e-15)
    return beta, float(y @ np.log(p) + (1 - y) @ np.log1p(-p) - beta @ pen @ beta / 2)


def learned_factors(sums: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Factors of the kinds and logistic weights: one factor after another is stepped within its bounds while likelihood grows."""
    low, mid, high = np.array([FACTORS[k] for k in KINDS]).T

    def worth(f: np.ndarray) -> float:
        return logistic_fit(features(sums, n, f), y)[1] - PULL * float((np.log2(f / mid) ** 2).sum())

    factors, best = mid.copy(), worth(mid)
    seen = [k for k in range(len(KINDS)) if low[k] < high[k] and sums[:, k].any()]
    for _ in range(ROUNDS):
        for k in seen:
            for step in STEPS:
                tried = factors.copy()
                tried[k] = np.clip(tried[k] * step, max(low[k], mid[k] / 64), high[k])
                if (w := worth(tried)) > best + 1e-9:
                    factors, best = tried, w
    return factors, logistic_fit(features(sums, n, factors), y)[0]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Learn from the first `rows` labelled training rows by hash of doc_id; null texts teach nothing."""
    arrow_sized(spark)
    seen = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = seen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")  # `rows` rows at most
    # A row for each doc_id, however often it repeats.
    sample = sample.groupBy("doc_id").agg(F.min("text").alias("text"), (F.max("toxic") > 0).cast("int").alias("y"))
    sample = staged(spark, sample, "toxicity-sample")
    n = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if not n.get(0) or not n.get(1):
        return Model(beta=[700.0 if n.get(1) else -700.0])
    counts = sample.select("y", F.explode(term_lists("text")).alias("term")).groupBy("term").agg(F.sum("y").alias("toxic"), F.count("*").alias("all"))
    ratio = ((F.col("toxic") + 0.5) / n[1]) / ((F.col("all") - F.col("toxic") + 0.5) / n[0])
    strong = counts.where(F.col("toxic") >= LEAST_ROWS).select("term", F.log(ratio).alias("w")).where(F.col("w") >= math.log(LEAST_RATIO))
    lexicon = [{r["term"][1:]: r["w"] for r in strong.where(F.col("term").startswith(k)).orderBy(F.desc("w"), "term").limit(MOST_TERMS).collect()} for k in "ws"]
    model = Model(words=lexicon[0], stems=lexicon[1])
    shared = spark.sparkContext.broadcast(model)  # MOST_TERMS words and beginnings each

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def measured(texts: pa.Array) -> pa.Array:
        found = map(shared.value.sums, texts.to_pylist())
        return pa.array([[*sums, float(n)] for sums, n in found], pa.list_(pa.float64()))

    found = sample.select("doc_id", "y", measured("text").alias("x")).orderBy("doc_id").collect()  # `rows` rows of a few numbers
    x = np.array([r["x"] for r in found])
    factors, beta = learned_factors(x[:, :-1], x[:, -1], np.array([r["y"] for r in found], float))
    model.factors, model.beta = factors.tolist(), beta.tolist()
    return model


def score_documents(spark: SparkSession, docs: DataFrame, model: Model, column: str = "text") -> Column:
    """The score of every whole text, as a column."""
    arrow_sized(spark)
    shared = spark.sparkContext.broadcast(model)  # MOST_TERMS words and beginnings each

    @F.arrow_udf(T.DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        m = shared.value
        return pa.array([m.score(t) for t in texts.to_pylist()], pa.float64())

    return scored(F.col(column))


def crc_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2
