"""Repeated bytes, vector codes and centroid clusters against brute force, and on awkward tables."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenet.llm import clusters, codes, queries, suffixes

NAN, INF = float("nan"), float("inf")
EXTRA = "id v norms code upper step lower file at digest head name content low c rank place key gone".split()


def clashing(df):
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in EXTRA])


# --- repeated bytes ---


def brute_repeats(rows, size):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - size + 1) if i is not None else ():
            first[b[p : p + size]] = min(i, first.get(b[p : p + size], i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1) if i is not None else ():
            if first[b[p : p + size]] < i:
                gone[p : p + size] = b"\1" * size
        runs = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def got_repeats(spark, rows, **how):
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    return sorted((tuple(r) for r in suffixes.repeated_bytes(spark, df, **how).collect()), key=str)


def passages(seed, n):
    """Texts made of shared and own stretches, some of few letters, so that repeats overlap and begin anywhere."""
    rng = random.Random(seed)
    shared = ["".join(rng.choice("ab é" if i % 3 else "abcdefgh ") for _ in range(rng.randrange(30, 200))) for i in range(6)]
    rows = []
    for i in range(n):
        parts = [rng.choice(shared)[rng.randrange(20) :][: rng.randrange(10, 200)] if rng.random() < 0.6 else "".join(rng.choice("stuvw xyz") for _ in range(rng.randrange(90))) for _ in range(rng.randrange(5))]
        rows.append((rng.randrange(n), "".join(parts)))
    return rows


@pytest.mark.parametrize("how", [{}, {"threshold": 24, "first": 5}, {"threshold": 20, "first": 20}])
def test_repeats_equal_brute_force(spark, how):
    rows = passages(1, 40)
    rows += [rows[3], (rows[3][0] + 1, rows[3][1]), (None, rows[3][1]), (7, None), (8, ""), (9, "x" * 300), (10, "x" * 170), (11, "y" * 49), (12, "y" * 49), (13, "z" * 50), (14, "z" * 50)]
    want = brute_repeats(rows, how.get("threshold", 50))
    assert sum(r[2] for r in want) > 500
    assert got_repeats(spark, rows, **how) == want


def test_repeats_in_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "STRETCH", 100)  # blocks as stretches cut them, here and in the workers' own way
    data = np.frombuffer(b"".join(t.encode() for _, t in passages(2, 30)), np.uint8)
    ends = np.array([len(data) // 3, len(data) // 3 + 20, len(data)])
    starts = [(d, s + k) for doc, start, n, *_ in suffixes.blocks(data, ends, 50) for d, s, m in zip(doc, start, n, strict=True) for k in range(m)]
    lengths = np.diff([0, *ends])
    assert sorted(starts) == [(d, s) for d in range(3) for s in range(lengths[d] - 49)]
    passage = " ".join(f"word{i * i}" for i in range(90_000))
    rows = [(1, passage), (2, "own start " + passage[500_000:] + " own end"), (3, passage)]
    got = {r[0]: r for r in got_repeats(spark, rows)}
    assert got[1][2] == 0 and got[3][2] == len(passage)
    assert got[2][2:4] == (len(passage) - 500_000 + (passage[499_999] == " "), 1)  # a blank before the rest stands in both


def test_chance_repeats_share_no_block():
    """Texts with stretches of 20 bytes in common, and none of 24, have no anchor in common."""
    rng = random.Random(5)
    common = ["".join(rng.choice("abcdefgh") for _ in range(20)) for _ in range(40)]
    names = []
    for own in ("stuv", "wxyz"):
        text = "".join(x + "".join(rng.choice(own) for _ in range(9)) for x in rng.sample(common, 40)).encode()
        names.append({h for *_, hs in suffixes.blocks(np.frombuffer(text, np.uint8), np.array([len(text)]), 50) for h in hs.tolist()})
    assert all(names) and not names[0] & names[1]


def test_anchors_are_few_and_cover():
    """At 50 bytes fewer than one place in 15 is sampled, and each start's 50 bytes hold their anchor."""
    data = np.random.default_rng(3).integers(97, 123, 200_000).astype(np.uint8)
    found = list(suffixes.blocks(data, np.array([len(data)]), 50))
    count, lead = (np.concatenate([f[k] for f in found]) for k in (2, 3))
    assert count.sum() == len(data) - 49 and len(count) < len(data) / 15
    assert (lead >= count - 1).all() and (lead + suffixes.anchor_size(50) <= 50).all()


@pytest.mark.parametrize("held", [8, 1 << 21])
def test_shared_names(spark, monkeypatch, held):
    """Those that stand in more than one row, from whatever number of batches and ranges."""
    monkeypatch.setattr(suffixes, "HELD", held)
    rng = np.random.default_rng(5)
    common = [bytes(rng.integers(97, 123, 300).astype(np.uint8)) for _ in range(20)]
    texts = [bytes(rng.integers(97, 123, 200).astype(np.uint8)) + common[i % 20] for i in range(60)]
    per = [{h for *_, hs in suffixes.blocks(np.frombuffer(t, np.uint8), np.array([len(t)]), 50) for h in hs.tolist()} for t in texts]
    times = Counter(h for names in per for h in names)
    rows = spark.createDataFrame([(bytearray(t),) for t in texts], "text binary").repartition(7)
    for ranges in (1, 5):
        got = [r[0] for r in suffixes.shared_names(rows, 50, ranges).collect()]
        assert len(got) == len(set(got)) and set(got) == {h for h, n in times.items() if n > 1}


def test_only_anchors_are_hashed(monkeypatch):
    """The long hash is made at sampled places, one in 15, not at all of them."""
    made, own = [], suffixes.hashes
    monkeypatch.setattr(suffixes, "hashes", lambda *how: made.append(own(*how)) or made[-1])
    data = np.random.default_rng(4).integers(97, 123, 100_000).astype(np.uint8)
    count = sum(len(f[0]) for f in suffixes.blocks(data, np.array([40_000, 40_020, len(data)]), 50))
    assert count <= sum(map(len, made)) < len(data) / 15


@pytest.mark.parametrize(("held", "threshold"), [(1 << 21, 50), (40, 50), (1 << 21, 300)])
def test_lists_of_shared_blocks(spark, monkeypatch, held, threshold):
    """Each text gets its blocks of shared anchors, and tasks deal out a row a group and range, not one a block."""
    monkeypatch.setattr(suffixes, "HELD", held)
    monkeypatch.setattr(suffixes, "STRETCH", 512)
    rng = np.random.default_rng(6)
    common = [bytes(rng.integers(97, 123, 700).astype(np.uint8)) for _ in range(5)]
    texts = [bytes(rng.integers(97, 123, 200 + 100 * i).astype(np.uint8)) + common[i % 5] * (1 + i % 2) + bytes(i % 7) for i in range(20)] + [b"", b"short"]
    if held == 40:  # more than two stretches, each with a group of its own
        texts.append(bytes(rng.integers(97, 123, 150_000).astype(np.uint8)) + common[0])
    blocks = {}
    for i, t in enumerate(texts):
        data = np.frombuffer(t, np.uint8)
        blocks[i] = [tuple(int(f[k][j]) for k in range(1, 5)) for f in suffixes.blocks(data, np.array([len(t)]), threshold) for j in range(len(f[0]))]
    times = Counter(name for own in blocks.values() for name in {b[-1] for b in own})
    monkeypatch.setattr(suffixes, "STRETCH", 1 << 16)
    assert sum(map(len, blocks.values())) > 300 and max(map(len, blocks.values())) > 2

    def starts(found):
        """Each start with its anchor's place and name, however blocks are cut."""
        return sorted((s + k, s + lead, name) for s, n, lead, name in found for k in range(n))

    rows = spark.createDataFrame([(7, i, bytearray(t)) for i, t in enumerate(texts)], "file long, at long, text binary").repartition(3)
    for ranges in (1, 4):
        groups = suffixes.dealt(rows, threshold, ranges).persist()
        per = Counter(r[0] for r in groups.select("group").collect())
        assert max(per.values()) <= ranges + 1 and (len(per) <= 3) == (held > 40)
        answers = suffixes.shared(groups, ranges)
        got = {}
        for r in suffixes.listed(groups, answers, threshold).collect():
            assert r.file == 7
            got.setdefault(r["at"], []).extend(tuple(b) for b in r.found)
        groups.unpersist()
        for i, own in blocks.items():
            want, have = starts(b for b in own if times[b[-1]] > 1), starts(got.get(i, []))
            assert set(have) >= set(want) and (held == 40 or have == want)
            assert set(have) <= set(starts(own))


def test_ranges_are_spread_one_a_task(spark):
    names = np.arange(4, dtype=np.uint64)
    groups = spark.createDataFrame([(g, r, bytearray((names + 4 * r).tobytes()), bytearray(np.arange(4, dtype=np.uint32).tobytes())) for g in range(2) for r in range(40)], "group long, range int, names binary, places binary")
    from pyspark import TaskContext

    def task(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * b.num_rows, pa.int32()), pa.array([len(x) // 8 for x in b.column("names").to_pylist()])], ["task", "n"])

    per = Counter()
    for r in suffixes.shared(groups, 40).mapInArrow(task, "task int, n long").collect():
        per[r.task] += r.n
    assert len(per) == 40 and set(per.values()) == {8}


def test_repeats_of_very_many(spark):
    line = "a line that stands in very many documents, and in each of them at another place"
    rows = [(i, f"{i * 7919} own words {i} " * (i % 3) + line + f" {i * 104729} the end of {i}" * (i % 4)) for i in range(2000)]
    assert got_repeats(spark, rows) == brute_repeats(rows, 50)


def test_repeats_query_and_empty(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.op11_repeated_bytes(spark, sf).collect()), key=str)
    assert got == brute_repeats(rows, 50) and sum(r[2] for r in got)
    assert got_repeats(spark, []) == []
    with pytest.raises(ValueError, match="threshold"):
        suffixes.repeated_bytes(spark, spark.createDataFrame(rows[:1], "doc_id long, text string"), threshold=8)


# --- vectors ---


def integers(rows, scale):
    return [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def distance(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def lloyd(vectors, centres, rounds):
    """Assignments (number, distance) and centres after the rounds, in Python's integers."""
    for turn in range(rounds + 1):
        found = [min((distance(v, c), j) for j, c in enumerate(centres)) for v in vectors]
        if turn == rounds:
            return found, centres
        centres = [[sum(x) // len(own) for x in zip(*own, strict=True)] if (own := [v for v, (_, j) in zip(vectors, found, strict=True) if j == k]) else c for k, c in enumerate(centres)]


def brute_codes(rows, parts, entries, rounds, scale=256):
    kept = integers(rows, scale)
    ids = {}
    for i, v, _ in kept:
        ids[i] = min(v, ids.get(i, v))
    first = sorted(ids.items(), key=lambda x: (x[0] is None, x[0] or 0))[:entries]
    size = len(first[0][1]) // parts
    by_part = [lloyd([v[m * size : (m + 1) * size] for _, v, _ in kept], [v[m * size : (m + 1) * size] for _, v in first], rounds) for m in range(parts)]
    digest = hashlib.sha256(",".join(str(x) for _, centres in by_part for c in centres for x in c).encode()).hexdigest()
    out = [(i, "".join(f"{found[k][1]:02x}" for found, _ in by_part), sum(found[k][0] for found, _ in by_part), label) for k, (i, _, label) in enumerate(kept)]
    sums = {}
    for _, _, e, label in out:
        sums[label] = sums.get(label, 0) + e
    return sorted([(i, c, e, label, sums[label], digest) for i, c, e, label in out], key=str)


def vectors(seed, n, width, coarse):
    """Vectors of which many components are equal, so that distances tie."""
    rng = random.Random(seed)
    return [(i, [rng.randrange(-4, 5) / coarse if rng.random() < 0.7 else rng.gauss(0, 1) for _ in range(width)], rng.choice([None, 1, 2])) for i in range(n)]


def odd_vectors(width):
    return [(900, None, 1), (901, [NAN] * width, 1), (902, [*[0.0] * (width - 1), INF], 1), (903, [*[0.0] * (width - 1), None], None), (904, [*[0.0] * (width - 1), -INF], 2), (905, [0.0] * width, None), (906, [-0.0] * width, 3)]


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(4, 8, 2), (4, 8, 0), (2, 64, 4), (8, 3, 3)])
def test_codes_equal_brute_force(spark, parts, entries, rounds):
    rows = vectors(3, 150, 16, 4) + odd_vectors(16) + vectors(3, 2, 16, 4)  # the last two repeat ids and vectors
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    got = codes.compress(spark, df, parts, entries, rounds)
    assert sorted((tuple(r) for r in got.select("vec_id", "code", "error", "label", "label_error", "codebooks_sha256").collect()), key=str) == brute_codes(rows, parts, entries, rounds)


def test_bounds_prune_and_hold():
    rng = np.random.default_rng(5)
    parts, entries = rng.integers(-50, 50, (400, 4)), rng.integers(-50, 50, (32, 4))
    bounds, taken = codes.Bounds.first(parts, entries), 0
    for _ in range(6):
        after = entries + rng.integers(-1, 2, entries.shape)
        movement = np.sqrt(((after - entries) ** 2).sum(1)) * (1 + codes.SLACK)
        columns = codes.stored([bounds])
        import pyarrow as pa

        bounds = codes.restored(pa.RecordBatch.from_arrays(columns, ["code", "upper", "step", "lower"]), 1, 32)[0]
        bounds, n = bounds.shifted(movement).assigned(parts, after, codes.half_distances(after))
        taken, entries = taken + n, after
        d = ((parts[:, None, :] - entries[None]) ** 2).sum(2)
        assert (bounds.code == d.argmin(1)).all()
        assert (bounds.upper >= np.sqrt(d.min(1))).all() and (bounds.lower <= np.sqrt(d) + 1e-12).all()
    assert taken < 0.5 * 6 * d.size


def test_codes_awkward(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert codes.compress(spark, none).count() == 0
    other = spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [1.0], 1), (None, [3.0, 4.0], None), (3, [], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(str(r["vec_id"]) for r in codes.compress(spark, other, parts=2, entries=4).collect()) == ["1", "None"]
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress(spark, other, parts=3)
    large = spark.createDataFrame([(1, [1e30, -1e30], 1), (2, [0.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    assert [r["error"] for r in codes.compress(spark, large, parts=2).orderBy("vec_id").collect()] == [0, 0]


def brute_clusters(rows, clusters_, rounds, scale=1024):
    kept = [r for r in integers(rows, scale) if len(r[1]) == 64]
    start = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v, _ in kept)[:clusters_]
    found, centres = lloyd([v for _, v, _ in kept], [v for _, v in start], rounds)
    inertia = {k: sum(d for d, j in found if j == k) for k in range(clusters_)}
    return sorted([(i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for (i, _, _), (d, j) in zip(kept, found, strict=True)], key=str)


@pytest.mark.parametrize(("clusters_", "rounds"), [(8, 10), (3, 0), (40, 2)])
def test_clusters_equal_brute_force(spark, clusters_, rounds):
    rows = vectors(4, 120, 64, 2) + odd_vectors(64) + [(950, [1.0] * 63, 1), (951, [], 1), (None, [0.5] * 64, None), (3, vectors(4, 4, 64, 2)[3][1], 1)]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert sorted((tuple(r) for r in clusters.cluster(spark, df, clusters_, rounds).collect()), key=str) == brute_clusters(rows, clusters_, rounds)


def test_screen_prunes_and_holds():
    rng = np.random.default_rng(6)
    centres = (rng.normal(0, 1, (12, 20)) * rng.uniform(1, 60, (12, 1)) * 10).astype(np.int64)
    v = centres[rng.integers(0, 12, 500)] + rng.integers(-30, 30, (500, 20))
    norms, d = clusters.block_norms(v).astype(np.float32), ((v[:, None, :] - centres[None]) ** 2).sum(2)
    assert (clusters.lower_bounds(v, norms, centres) <= d).all()
    at, best, taken = clusters.nearest(v, norms, centres)
    assert (at == d.argmin(1)).all() and (best == d.min(1)).all() and taken < 0.6 * d.size
    at, best, _ = clusters.nearest(np.zeros((3, 20), np.int64), np.zeros((3, 3), np.float32), np.zeros((5, 20), np.int64))
    assert at.tolist() == [0, 0, 0] and best.tolist() == [0, 0, 0]


def test_clusters_awkward(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert clusters.cluster(spark, none).count() == 0
    two = spark.createDataFrame([(1, [1.0] * 64, 1), (2, [2.0] * 64, 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(r["distance"] for r in clusters.cluster(spark, two).collect()) == [0, 0]
    big = spark.createDataFrame([(1, [1e300] * 64, 1), (2, [-1e300] * 64, 1)], "vec_id long, embedding array<double>, label int")
    assert {r["distance"] for r in clusters.cluster(spark, big).collect()} == {0}


def test_vector_queries(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = queries.op12_vector_codes(spark, sf).select("vec_id", "code", "error", "label", "label_error", "codebooks_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_codes(rows, 16, 64, 2)
    assert sorted((tuple(r) for r in queries.op13_centroid_clusters(spark, sf).collect()), key=str) == brute_clusters(rows, 8, 10)
