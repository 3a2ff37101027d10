"""The pipeline's stages on a small table and on awkward ones."""

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from tenet.llm import nearcopies, pii, simhash


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert out.columns == docs.columns
            kept.append(out.count())
        docs = out
    assert kept[0] > kept[1] >= 100 and kept[2] == kept[1]
    clean = spark.read.parquet(f"{tmp_path}/2")
    assert not any(pii.base_spans(r["text"]) for r in clean.collect())
    prints = [simhash.fingerprint(r["text"]) for r in spark.read.parquet(f"{tmp_path}/1").collect()]
    assert all((a ^ b).bit_count() > 3 for i, a in enumerate(prints) for b in prints[:i])
    mixed = spark.read.parquet(f"{tmp_path}/3")
    words = lambda df: df.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert abs(words(mixed) - 1.5 * words(clean)) <= 30
    assert docs.agg(F.sum("length")).first()[0] > 0


def test_clashing_names(spark, sf, tmp_path):
    """Columns of names that stages use inside, nulls, repeats: every stage carries them."""
    from test_operators import AWKWARD, CLASHING, SCHEMA, clashing, own_columns_stay

    docs = clashing(spark.createDataFrame(AWKWARD, SCHEMA))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.count() > 0 and (k == 4 or (own_columns_stay(docs) and set(CLASHING) <= set(docs.columns)))


def test_two_runs_at_once(spark, sf):
    """Runs share nothing: what one stages is not another's to delete."""
    a, b = corpus_pipeline.run(spark, sf), corpus_pipeline.run(spark, sf)
    assert a.count() == b.count() > 0


def test_empty(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.count() == 0


def brute_near_copies(rows):
    """Smallest doc_id of each component of texts with 5-word Jaccard similarity of 0.8 or more; the pairs of different texts."""
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    held, up, pairs = [(i, shingles(t)) for i, t in sorted(rows)], {i: i for i, _ in rows}, []

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, a) in enumerate(held):
        for j, b in held[:n]:
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                pairs.append((i, j))
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {root(i) for i, _ in rows}, pairs


def altered(i):
    """Chains of edits, each of which changes up to five shingles of the 60: most differ from the base in more than 3 bits."""
    base = [f"w{i // 6}x{k}" for k in range(64)]
    for e in range(i % 6):
        base[7 + 11 * e] = f"edit{e}"
    return " ".join(base)


def test_near_copies_by_jaccard(spark):
    rows = [(i, altered(i)) for i in range(240)]
    want, pairs = brute_near_copies(rows)
    prints = {i: simhash.fingerprint(t) for i, t in rows}
    assert sum((prints[i] ^ prints[j]).bit_count() > 3 for i, j in pairs) > 100
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == want


def test_near_copies_of_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 2000")
    want, _ = brute_near_copies([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()} == want


def test_near_copies_in_parts(spark):
    """A shard that is dealt over parts has the links of one task."""
    rows = [(i, altered(i % 6)) for i in range(40)]
    keyed = spark.createDataFrame([(i, i, 60, 0, 7) for i, _ in rows], "node long, root long, n long, k int, key long")
    sets = spark.createDataFrame(rows, "node long, text string").select("node", nearcopies.signatures("text").alias("s")).select("node", "s.*")
    found = nearcopies.shards(keyed, tree=7)
    assert found.first()["parts"] == 6
    joined = nearcopies.Groups()
    for r in nearcopies.links(keyed, found, sets).collect():
        joined.join(r["a"], r["b"])
    assert len({joined.find(i) for i, _ in rows}) == 1


def test_near_copies_within_wide():
    """Pairs of similarity 0.8 or more lie within the trees' radius."""
    import random

    rng, far = random.Random(3), 0
    for _ in range(3000):
        n = rng.choice([4, 5, 9, 20, 60, 400])
        a = [rng.getrandbits(64) for _ in range(n)]
        b = list(a)
        for k in rng.sample(range(n), n // 9):
            b[k] = rng.getrandbits(64)
        b = b if n // 9 else [*b, rng.getrandbits(64)]
        if len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b)):
            x, y = (simhash.majority(np.array(s, np.uint64)) for s in (a, b))
            far = max(far, (x ^ y).bit_count())
    assert 12 < far <= nearcopies.WIDE


def test_near_copies_awkward(spark):
    rows = [(None, "one two three"), (4, "one two three"), (3, None), (2, " "), (5, "One  TWO three"), (6, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in nearcopies.keep_one(spark, docs).collect()) == [2, 4, 6]


def test_packing_holds_few_words(monkeypatch):
    """A batch of Arrow is encoded a few texts at a time, with the ids of the whole."""
    import pyarrow as pa

    from tenet.llm import packing
    from tenet.llm.queries import tokenizer
    from tenet.llm.wordcache import Encoder

    seen, encode = [], Encoder.encode
    monkeypatch.setattr(Encoder, "encode", lambda self, texts: seen.append(len(texts)) or encode(self, texts))
    path = tokenizer("byte_bpe_50k.json")
    texts = [None if i % 97 == 0 else f"text {i} of words, " * (i % 7) for i in range(1000)]
    found = packing.pieces(path, 0).func(pa.array(texts))
    assert sum(seen) == 1000 and max(seen) <= 256
    assert [p[0]["length"] for p in found.to_pylist()] == [len(ids) // 4 + 1 for ids in Encoder(path).whole([t or "" for t in texts])]


def test_free_memory_goes_back():
    """What a worker has freed is the system's again, though something above it is still held."""
    import ctypes
    import re

    import pytest

    from tenet.llm.common import forget

    if not hasattr(ctypes.CDLL(None), "malloc_trim"):
        pytest.skip("no glibc")
    now = lambda: int(re.search(r"VmRSS:\s+(\d+)", open("/proc/self/status").read())[1]) / 1024  # noqa: E731, SIM115
    blocks = [b"x" * 60_000 for _ in range(4000)]
    last, full = blocks[::100], now()
    del blocks
    forget()
    assert len(last) == 40 and full - now() > 150
