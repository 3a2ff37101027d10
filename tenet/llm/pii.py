"""Personal data by weak supervision over candidate spans.

Base spans (email, ip, card, phone) come from four fixed patterns, leftmost and non-overlapping in each kind, and always stay.
Beside them, generators propose further candidates. Labelers of three sorts vote on each, personal, not, or abstain:
patterns (valid form), gazetteers (known prefixes, codes and issuers), and contexts (cue words before it, what touches it).
Expectation-maximisation over the counts of vote patterns estimates the labelers' reliabilities; its posteriors are the soft
labels that train the final classifier, a logistic model of kind, votes and length. Candidates that it takes for personal are
added where they overlap no base span.

A text is read once: its base spans and its candidates with their vote patterns are staged, and the patterns' counts (of a
bounded number of patterns) are all that is gathered.

Cases: null and empty texts have no spans. Numbers of any length are compared as they are written, and no pattern's time grows
faster than the text. Offsets are code points. Repeated rows are judged alike. Without any candidate
nothing is fitted, and the base spans are the result. Empty tables give empty results. `redact` carries all columns whatever
their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenet.llm.common import arrow_sized, forget, spark_type, staged, struct_array

KINDS = ("email", "ip", "card", "phone")
#: What the method adds.
ADDED = ("secret", "iban", "ssn", "national_phone")

# The base patterns, email and ip in parts. Emails are found from their @ and addresses from whole chains of
# numbers, so a long run of letters or digits is read once, not from each of its places.
LOCAL = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])) + "._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Generators of further candidates.
GENERATORS = {
    "secret": re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+", re.ASCII),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", re.ASCII),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", re.ASCII),
    "national_phone": re.compile(r"(?<![0-9+])(?<!\+1 )\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9-])", re.ASCII),
}

# Gazetteers and cue words.
SECRET_PREFIXES = ("sk-", "pk-", "ghp_", "gho_", "xox", "AKIA", "ASIA", "glpat-", "AIza", "ya29", "hf_", "npm_")
IBAN_COUNTRIES = frozenset("AD AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM".split())
CUES = {
    "secret": re.compile(r"(?i)(?:token|secret|password|passwd|pwd|api[_ -]?key|access[_ -]?key|auth|bearer|credential|private[_ -]?key)\W{0,6}$"),
    "iban": re.compile(r"(?i)(?:iban|account|konto|compte|cuenta|bank)\W{0,6}$"),
    "ssn": re.compile(r"(?i)(?:ssn|social security|social)(?:\W{0,4}(?:no|number|nr))?\W{0,6}$"),
    "national_phone": re.compile(r"(?i)(?:phone|tel|call|mobile|fax|telefon|téléphone|teléfono)\W{0,6}$"),
}
DECOYS = re.compile(r"(?i)(?:version|isbn|issn|order|commit|sha|sha1|sha256|md5|hash|digest|checksum|uuid|build|revision|page|figure|item|invoice)\W{0,6}$")
CONTEXT = 32
LABELERS = 5
DIGITS = re.compile("[0-9]")

TYPE = pa.struct([("n_email", pa.int64()), ("n_ip", pa.int64()), ("n_card", pa.int64()), ("n_phone", pa.int64()), ("base", pa.string()), ("base_sha256", pa.string()), ("candidates", pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("pattern", pa.int32())])))])

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[Span]:
    """What [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+ finds, in one pass over the text."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append(("email", start, found.end()))
        done = found.end() if found else at + 1
        at = text.find("@", done)
    return out


def small(part: str) -> bool:
    """Is a number of any length at most 255?"""
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def addresses(text: str) -> list[Span]:
    """What [0-9]+(\\.[0-9]+){3} finds, less those with a part over 255: a chain's numbers, four by four."""
    out = []
    for m in CHAIN.finditer(text):
        parts = m.group().split(".") if m.group().count(".") >= 3 else []
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            end = at + sum(map(len, parts[i : i + 4])) + 3
            if all(map(small, parts[i : i + 4])):
                out.append(("ip", at, end))
            at = end + 1
    return out


def base_spans(text: str) -> list[Span]:
    """By kind, then start."""
    out = emails(text) if "@" in text else []
    if "." in text:
        out += addresses(text)
    for m in CARD.finditer(text):
        d = digits_of(m.group()) if 13 <= m.end() - m.start() <= 37 else ""  # 19 digits, 18 marks between them
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return out


def joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def valid(kind: str, found: str) -> int:
    """The pattern labeler: the kind's strict form."""
    if kind == "secret":
        body = found.rpartition("_")[2] if found[:6].count("_") else found
        n = sum(c.isdigit() for c in body)
        return 1 if 4 <= n < len(body) else -1 if n < 2 or n == len(body) else 0
    if kind == "iban":
        s = found.replace(" ", "")
        s = s[4:] + s[:4]
        return 1 if int("".join(str(int(c, 36)) for c in s)) % 97 == 1 else -1
    if kind == "ssn":
        return -1 if found[:3] in ("000", "666") or found[0] == "9" or found[4:6] == "00" or found[7:] == "0000" else 1
    return 1 if found[1] not in "01" else -1


def entropy(s: str) -> float:
    n = len(s)
    return -sum(k / n * math.log2(k / n) for k in map(s.count, set(s)))


def vote(kind: str, text: str, start: int, end: int) -> list[int]:
    """Of the five labelers: valid form, gazetteer, cue before it, decoy or touching text, make-up of its characters."""
    found, before = text[start:end], text[max(0, start - CONTEXT) : start]
    if kind == "secret":
        known = 1 if found.startswith(SECRET_PREFIXES) else 0
    elif kind == "iban":
        known = 1 if found[:2] in IBAN_COUNTRIES else -1
    else:
        known = 0
    cue = 1 if CUES[kind].search(before) else 0
    touching = text[start - 1 : start] in ("/", "=", "&", "?", "#", "-") and start > 0 or text[end : end + 1] in ("/", "&", "=")
    decoy = -1 if DECOYS.search(before) or touching else 0
    if kind == "secret":
        h = entropy(found)
        make = 1 if h >= 3 else -1 if h < 2.5 else 0
    else:
        make = -1 if len(set(digits_of(found))) <= 2 else 0
    return [valid(kind, found), known, cue, decoy, make]


def candidates(text: str) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, vote pattern) of the generators' spans."""
    out = []
    for k, (kind, pattern) in enumerate(GENERATORS.items()):
        for m in pattern.finditer(text):
            if kind == "secret" and not DIGITS.search(m.group()):
                continue
            out.append((k, m.start(), m.end(), encode(k, vote(kind, text, *m.span()), m.end() - m.start())))
    return out


def encode(kind: int, votes: list[int], length: int) -> int:
    code = min(3, length.bit_length() // 2)
    for v in votes:
        code = code * 3 + v + 1
    return code * len(GENERATORS) + kind


def decode(pattern: int) -> tuple[int, list[int], int]:
    code, kind = divmod(pattern, len(GENERATORS))
    votes = []
    for _ in range(LABELERS):
        code, v = divmod(code, 3)
        votes.append(v - 1)
    return kind, votes[::-1], code


def found_in(text: str | None) -> tuple:
    text = text or ""
    spans: list[Span] = []
    more: list[tuple[int, int, int, int]] = []
    if DIGITS.search(text):  # every kind has a digit, but for emails
        spans, more = base_spans(text), candidates(text)
    elif "@" in text:
        spans = base_spans(text)
    n = [sum(1 for s in spans if s[0] == k) for k in KINDS]
    base = joined(spans)
    return (*n, base, hashlib.sha256(base.encode()).hexdigest(), [{"kind": a, "start": b, "end": c, "pattern": d} for a, b, c, d in more])


@F.arrow_udf(spark_type(TYPE))
def extracted(texts: pa.Array) -> pa.Array:
    forget()
    return struct_array([found_in(t) for t in texts.to_pylist()], TYPE)


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """EM with a labeler's accuracy alike in both classes: posteriors of personal, accuracies, and the share of personal."""
    right, share, post = np.full(votes.shape[1], 0.8), 0.5, np.zeros(len(votes))
    for _ in range(rounds):
        odds = votes @ np.log(right / (1 - right)) + math.log(share / (1 - share))
        new = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        p = new[:, None]
        hit = (counts[:, None] * (p * (votes == 1) + (1 - p) * (votes == -1))).sum(axis=0)
        cast = (counts[:, None] * (votes != 0)).sum(axis=0)
        right = np.clip((hit + 8) / (cast + 10), 0.55, 0.99)
        share = float(np.clip((counts @ new + 2) / (counts.sum() + 4), 0.02, 0.98))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post, right, share


def train(counts: dict[int, int]) -> dict[int, float]:
    """For each vote pattern: the final classifier's probability that its spans are personal."""
    if not counts:
        return {}
    patterns = sorted(counts)
    kinds, votes, lengths = zip(*map(decode, patterns), strict=True)
    v, n = np.array(votes, float), np.array([counts[p] for p in patterns], float)
    post, _, _ = reliabilities(v, n)
    x = np.column_stack([np.ones(len(v)), v == 1, v == -1, *[np.array(kinds) == k for k in range(len(GENERATORS))], *[np.array(lengths) == k for k in range(4)]]).astype(float)
    weight = np.log1p(n)  # so that one frequent pattern doesn't decide alone
    rows = np.concatenate([x, x]), np.concatenate([np.ones(len(x)), np.zeros(len(x))]), np.concatenate([weight * post, weight * (1 - post)])
    beta = weighted_fit(*rows)
    return dict(zip(patterns, (1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))).tolist(), strict=True))


def weighted_fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.1, rounds: int = 100) -> np.ndarray:
    beta, pen = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + pen, x.T @ (w * (y - p)) - pen @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def with_added(base: str, found: list[dict], takes: dict[int, float], threshold: float = 0.5) -> str:
    """The base spans, then the added ones that overlap none of them nor each other, joined."""
    if not found:
        return base
    starts, ends = [], []  # disjoint stretches that are taken
    for a, b in sorted((int(a), int(b)) for a, b in (x.split(":")[1:] for x in base.split(",") if x)):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    out = []
    for c in sorted(found, key=lambda c: (c["kind"], c["start"])):
        if takes.get(c["pattern"], 0.0) >= threshold:
            i = bisect_left(starts, c["end"])
            if not i or ends[i - 1] <= c["start"]:
                starts.insert(i, c["start"])
                ends.insert(i, c["end"])
                out.append((ADDED[c["kind"]], c["start"], c["end"]))
    return ",".join(x for x in (base, joined(out)) if x)


def redacted(text: str | None, spans: str) -> str | None:
    """The text with each span replaced by its kind in angle brackets; of overlapping ones the union is replaced, once."""
    if not text or not spans:
        return text
    found = sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in spans.split(",")))
    parts, at, end = [], 0, -1
    for s, e, k in found:
        if s >= end or end < 0:
            parts += [text[at:s], f"<{k.upper()}>"]
        end = max(end, e)
        at = end
    return "".join([*parts, text[at:]])


def find(spark: SparkSession, docs: DataFrame, carry: list[str], text_column: str = "text", threshold: float = 0.5, with_text: bool = False) -> DataFrame:
    """The carried columns, n_email, n_ip, n_card, n_phone, base_sha256 and spans; with_text adds the redacted text as last column."""
    arrow_sized(spark)
    held = [F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]
    own = [F.col(text_column).alias("own_text")] if with_text else []
    rows = staged(spark, docs.select(*held, *own, extracted(text_column).alias("f")).select(*[f"c{i}" for i in range(len(carry))], *(["own_text"] if own else []), "f.*"), "pii")
    counts = {r[0]: r[1] for r in rows.select(F.explode("candidates.pattern").alias("p")).groupBy("p").count().collect()}  # 3^5 x 4 x 4 at most
    takes = spark.sparkContext.broadcast(train(counts))

    @F.arrow_udf(T.StringType())
    def spans(base: pa.Array, found: pa.Array) -> pa.Array:
        return pa.array([with_added(b, c, takes.value, threshold) for b, c in zip(base.to_pylist(), found.to_pylist(), strict=True)], pa.string())

    @F.arrow_udf(T.StringType())
    def clean(texts: pa.Array, base: pa.Array, found: pa.Array) -> pa.Array:
        each = zip(texts.to_pylist(), base.to_pylist(), found.to_pylist(), strict=True)
        return pa.array([redacted(t, with_added(b, c, takes.value, threshold)) for t, b, c in each], pa.string())

    names = [F.col(f"c{i}").alias(c) for i, c in enumerate(carry)]
    last = [clean("own_text", "base", "candidates").alias("redacted_text")] if with_text else []
    return rows.select(*names, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans("base", "candidates").alias("spans"), *last)


def redact(spark: SparkSession, docs: DataFrame, text_column: str = "text") -> DataFrame:
    """docs with personal data replaced by its kind in the text column."""
    names = [f"d{i}" for i in range(len(docs.columns))]
    at = names[docs.columns.index(text_column)]
    rest = [n for n in names if n != at]
    out = find(spark, docs.toDF(*names), rest, at, with_text=True)
    return out.select(*[F.col("redacted_text").alias(n) if n == at else F.col(n) for n in names]).toDF(*docs.columns)


__all__ = ["base_spans", "candidates", "find", "redact", "redacted", "reliabilities", "train", "with_added"]
