"""Each operator against brute force, and on awkward tables: nulls, empties, very long texts, ties, repeats, no rows, clashes."""

import hashlib
import random
import re
import sys
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenet.llm import gif, graph, licenses, mixing, mphf, packing, pii, quality, queries, sharding, simhash, tokenshards, toxicity
from tenet.llm.wordcache import Encoder

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("row", T.StringType()), T.StructField("size", T.IntegerType()), T.StructField("fp", T.StringType())])
#: Names that operators use inside, added to every awkward table.
CLASHING = "file at word bit mask may c0 c1 text_ source_ size_ key_ taken_ taken times copy whole rest cut here root node first order digest n bands s shard slot copies bucket start i media frames quality pattern kept redacted_text own_text base spans candidates target source_size __mix_size __mix_taken __mix_times __mix_copy".split()
LONG = " ".join(f"word{i} of a long text." for i in range(4000))
AWKWARD = [
    (1, None, "en", "a", None, "x", 1, None),
    (2, "", "en", "a", 0, "x", 1, None),
    (3, "one two three four five six seven eight nine ten eleven twelve", None, None, 9, "x", 1, "f"),
    (3, "one two three four five six seven eight nine ten eleven twelve", None, None, 9, "x", 1, "f"),
    (3, "a different text of the same number, with more than ten words in it", "en", "b", 9, "x", 1, "f"),
    (None, "no number but words enough to be taken for a document, eleven of them", "en", "b", 9, "x", 1, "f"),
    (4, LONG, "en", "a", 9, None, None, None),
    (5, "ONE two three four five six seven eight nine ten eleven twelve", "en", "c", 9, "x", 1, "f"),
    (6, " \n\t ", "en", "c", 3, "x", 1, "f"),
    (7, "mail me: jo.do@mail.example.com or +1 (555) 555-0100, 10.0.0.1, 4111 1111 1111 1111 today please now", "en", "c", 9, "x", 1, "f"),
    (8, "Released under the MIT License.\nzwölf Boxkämpfer jagen Viktor 日本語 \x01 quer", "de", "é", 9, "x", 1, "f"),
]


def clashing(df):
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def docs(spark):
    return clashing(spark.createDataFrame(AWKWARD, SCHEMA))


@pytest.fixture(scope="module")
def none(spark):
    return clashing(spark.createDataFrame([], SCHEMA))


def own_columns_stay(df):
    """Does every row still have its own values under the clashing names?"""
    return all(r[c] == f"own {c}" for r in df.select(*CLASHING).collect() for c in CLASHING)


def texts(spark, sf, n=60):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(n).collect()]


# --- tokens and shards of ids ---


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(spark, sf, name):
    enc = Encoder(queries.tokenizer(name), cache_units=500)
    rows = [t for _, t in texts(spark, sf, 200)]
    odd = ["", " ", "\n", "a\n\nb", "a\n\n", "a \n b", "a  b\tc", " a", "a ", "\n\n\nx", "x\n y", "don't  go\n'll", "<|endoftext|> x", "a\x1cb", "x\n", "12 345 a1b", "ΑΣ ΟΔΟΣ", "İstanbul Straße", "it's we'LL", "日本 語", "á e", "́x y", "ﬁ K Å", "a\x00b \x01c", "²Ⅷ x"]
    for _ in range(2):
        assert enc.encode([*rows, *odd]) == enc.whole([*rows, *odd])


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library_on_random_texts(name):
    """Texts of few characters, white space of all sorts above all, so that every short run of it comes up between all sorts of words."""
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(queries.tokenizer(name)), random.Random(12)
    marks = ["\n", "\n\n", "\n\n ", "\n ", " ", " ", " ", "  ", "\t", "\r\n", "a", "b", "word", "Words", "12", ".", ",", "'s", "é", "日", "-", "\x02", "<", "x\u0301"]
    rows = ["".join(rng.choice(marks[: rng.choice([5, 7, 24])] + ["a", "in"]) for _ in range(rng.randrange(1, 14))) for _ in range(9_000)]
    lines = ["def f(x):", "    return x", "- a list", "  - below it", "", "Plain words of a paragraph.", " indented", "1. first", "\tx"]
    rows += ["\n".join(rng.choice(lines) for _ in range(rng.randrange(2, 12))) for _ in range(1_000)]
    enc, got = Encoder(queries.tokenizer(name), cache_units=3000), []
    for i in range(0, len(rows), 97):
        got += enc.encode(rows[i : i + 97])
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch_fast(rows, add_special_tokens=False)]
    assert [r for r, g, w in zip(rows, got, want, strict=True) if g != w] == []


def test_encoder_encodes_stems_once():
    enc, sent = Encoder(queries.tokenizer("word_bpe_49k.json")), []
    way = enc.apart
    enc.apart = lambda units: sent.extend(units) or way(units)
    texts = ["Große WORD, word's", "word. Word,' (große) GROSSE... İx, ", "don't word!! ÉTÉ, été"]
    want = [np.array(e.ids, "<u4").tobytes() for e in enc.library.encode_batch_fast(texts, add_special_tokens=False)]
    assert enc.encode(texts) == want and enc.encode(texts) == want
    assert sent.count("word") == sent.count("große") == sent.count("été") == sent.count(",") == 1 and "WORD," not in sent


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_added_tokens(name):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer(name))  # its defaults, as the contract has them
    rows = ["end <|endoftext|> x", "a<|endoftext|>b", "<|ENDOFTEXT|> y", "<|startoftext|> z <|endoftext|>", "a < b", "<|endof text|>", "<|endoftext|>\n\n  x", "x <", "end"]
    enc = Encoder(queries.tokenizer(name))
    for _ in range(2):
        assert enc.encode(rows) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in rows]
    ids = [np.frombuffer(x, "<u4").tolist() for x in enc.encode(rows[:1])][0]
    assert any(i in ids for i, t in library.get_added_tokens_decoder().items() if t.content == "<|endoftext|>")


def test_perfect_hash():
    rng = random.Random(1)
    keys = np.array(sorted({rng.getrandbits(64) for _ in range(20_000)}), np.uint64)
    h = mphf.PerfectHash.build(keys)
    assert sorted(h.slots(keys)) == list(range(len(keys)))
    again, _ = mphf.PerfectHash.from_bytes(h.to_bytes())
    assert (again.slots(keys) == h.slots(keys)).all()
    assert len(mphf.PerfectHash.build(keys[:0]).slots(keys[:3])) == 3


def expected_ids(rows, end=1):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))  # its defaults, as the contract has them
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4") for x in rows]


def test_token_shards(spark, sf):
    rows = texts(spark, sf, 1000)
    got = {r["doc_id"]: r for r in queries.op1_token_shards(spark, sf).collect()}
    start = 0
    for (i, _), ids in zip(rows, expected_ids([t for _, t in rows]), strict=True):
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_shards_awkward(spark, docs, none):
    keys = tokenshards.write_shards(spark, docs, queries.tokenizer("word_bpe_49k.json"))
    out = tokenshards.read_back(spark, keys).orderBy("start").collect()
    assert len(out) == len(AWKWARD) and out[0]["doc_id"] is None
    assert [r["start"] for r in out] == list(np.cumsum([0] + [r["n_tokens"] for r in out])[:-1])
    assert next(r for r in out if r["doc_id"] == 1)["n_tokens"] == 1
    ids = tokenshards.lookup(keys, [5, 99])
    assert list(ids) == [5] and (ids[5] == expected_ids([AWKWARD[7][1]])[0]).all()
    assert tokenshards.lookup(keys, []) == {}
    empty = tokenshards.write_shards(spark, none, queries.tokenizer("word_bpe_49k.json"))
    assert tokenshards.read_back(spark, empty).count() == 0


def test_token_shards_of_added_tokens(spark):
    rows = [(i, t) for i, t in enumerate(["end <|endoftext|> x", "a<|endoftext|>b", "plain", "<|startoftext|>", "< | endoftext | >"])]
    keys = tokenshards.write_shards(spark, spark.createDataFrame(rows, "doc_id long, text string"), queries.tokenizer("word_bpe_49k.json"))
    got = {r["doc_id"]: r["ids_crc32"] for r in tokenshards.read_back(spark, keys).collect()}
    assert got == {i: zlib.crc32(x.tobytes()) for (i, _), x in zip(rows, expected_ids([t for _, t in rows]), strict=True)}


def test_lookup_reads_little(spark, sf, monkeypatch):
    """Keyed reads find every document, absent ones not, and read no whole index."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    keys = tokenshards.write_shards(spark, docs, queries.tokenizer("word_bpe_49k.json"))
    rows = dict(texts(spark, sf, 1000))
    wanted = sorted(rows)[::9]
    monkeypatch.setattr(tokenshards, "Shard", None)
    got = tokenshards.lookup(keys, [*wanted, 10**9])
    assert sorted(got) == wanted
    for i, ids in zip(wanted, expected_ids([rows[i] for i in wanted]), strict=True):
        assert (got[i] == ids).all()
    reader = tokenshards.Reader(keys.where(F.col("doc_id") == wanted[0]).first()["shard"])
    reads, whole = [], reader.index
    reader.index = type("Counted", (), {"read_at": lambda _, n, at: reads.append(n) or whole.read_at(n, at)})()
    assert reader.ids(wanted[0]) is not None and reader.ids(-5) is None
    assert len(reads) < 40 and max(reads) == 8


# --- sharding ---


def test_rendezvous(spark, sf):
    rows = sharding.shard_documents(spark.read.parquet(f"{sf}/documents.parquet"), [1.0] * 16).collect()

    def u(d, s):
        h = xxhash.xxh64_intdigest(int(s).to_bytes(4, "little"), xxhash.xxh64_intdigest(int(d).to_bytes(8, "little"), 42))
        return ((h >> 11) + 0.5) / 2**53

    for r in rows:
        scores = [-1 / np.log(u(r["doc_id"], s)) for s in range(17)]
        assert r["shard"] == int(np.argmax(scores[:16])) and r["grown_shard"] == int(np.argmax(scores))
        assert r["grown_shard"] in (r["shard"], 16)
    for s in range(16):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_rendezvous_weights_and_awkward(spark, docs, none):
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    n = {r["shard"]: r["count"] for r in sharding.shard_documents(many, [1.0, 3.0]).groupBy("shard").count().collect()}
    assert 2.7 < n[1] / n[0] < 3.3
    out = sharding.shard_documents(docs, [1.0] * 4).collect()
    assert len(out) == len(AWKWARD) and len({(r["shard"], r["slot"]) for r in out}) == len(out)
    assert {(r["size"], r["text_crc32"]) for r in out if r["doc_id"] in (1, 2)} == {(1, 0)}
    assert sharding.shard_documents(none, [1.0]).count() == 0
    same = spark.range(50_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("x").alias("text"))  # one row, very often
    slots = sharding.shard_documents(same, [1.0] * 4).agg(F.count_distinct("slot"), F.min("slot"), F.max("slot"), F.count_distinct("shard")).first()
    assert tuple(slots) == (50_000, 0, 49_999, 1)


# --- quality ---


def brute_stats(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(hit)


def test_quality_stats(spark, sf):
    for _, t in [*texts(spark, sf), (0, "a b c d e a b c d e\nx\nx\n\n\n"), (0, "a " * 30), (0, None), (0, "\xa0 \x1c")]:
        assert quality.stats(t) == brute_stats(t)


def test_quality_query(spark, sf):
    rows = queries.op3_quality_rules(spark, sf).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    judged = [(labels[r["doc_id"]], r["kept"]) for r in rows if r["doc_id"] in labels and not r["base_failed"]]
    assert sum(bool(q) == k for q, k in judged) >= 0.95 * len(judged)


def brute_em(rows, rules, rounds=200):
    """EM over single documents (votes), with the prior's counts, in plain loops: posteriors of good by pattern."""
    good, weight = quality.PRIOR_GOOD, quality.PRIOR_WEIGHT * len(rows) + 1
    shares = {y: [dict(zip((-1, 0, 1), quality.PRIOR[y], strict=True)) for _ in range(rules)] for y in (1, -1)}
    post = {}
    for _ in range(rounds):
        new = {}
        for v in rows:
            a, b = good, 1 - good
            for r, x in enumerate(v):
                a, b = a * shares[1][r][x], b * shares[-1][r][x]
            new[v] = a / (a + b)
        for y in (1, -1):
            for r in range(rules):
                cast = {k: weight * p for k, p in zip((-1, 0, 1), quality.PRIOR[y], strict=True)}
                for v in rows:
                    cast[v[r]] += new[v] if y == 1 else 1 - new[v]
                shares[y][r] = {k: c / sum(cast.values()) for k, c in cast.items()}
        good = (sum(new[v] for v in rows) + weight * quality.PRIOR_GOOD) / (len(rows) + weight)
        if post and max(abs(new[v] - post[v]) for v in new) < 1e-9:
            return new
        post = new
    return post


def brute_votes(t):
    """The eight rules as they are told, from the brute statistics."""
    n, chars, symbols, dup, repeat = brute_stats(t)
    if not n:
        return (-1, *[0] * 7)
    w = t.split()
    clean = sum(bool(re.fullmatch(r"[\"'(]?[^\W\d_]+[.,;:!?)\"']?", x)) for x in w) / n
    distinct = sum(len(set(w[i : i + 100])) for i in range(0, len(w), 100)) / len(w) if n >= 20 else 1
    ends = sum(t.count(x) for x in (". ", ".\n", "! ", "? ")) + t.endswith(".")
    bad = [n < 10, symbols > 0.1 * n, clean < 0.65, dup >= 3 and dup > 0.3 * (t.count("\n") + 1), repeat > 0.2 * n, distinct < 0.2, chars / n > 12 or chars / n < 2, n >= 40 and ends * 80 < n]
    good = {2: clean > 0.95, 7: ends * 25 >= n}
    return tuple(-1 if b else int(good.get(i, False)) for i, b in enumerate(bad))


def test_quality_verdicts_equal_brute_force(spark, sf):
    rows = texts(spark, sf, 1000)
    votes = {i: brute_votes(t) for i, t in rows}
    post = brute_em([votes[i] for i, _ in rows], len(quality.RULES))
    for r in queries.op3_quality_rules(spark, sf).collect():
        q = post[votes[r["doc_id"]]]
        assert abs(r["quality"] - q) < 2e-6 and r["kept"] == (not r["base_failed"] and q >= 0.5)


def test_distinct_words_of_long_texts():
    """The rule's verdict does not depend on how long a text is."""
    rng = random.Random(2)
    for n in (60, 999, 1000, 1001, 20_000):
        poor, rich = " ".join(rng.choices(["buy", "now", "cheap"], k=n)), " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
        assert quality.votes(poor, quality.stats(poor))[5] == -1 and quality.votes(rich, quality.stats(rich))[5] == 0


def test_quality_em_is_invariant():
    p = np.array([quality.encode(v) for v in ([0, 0, 1, 0, 0, 0, 0, 1], [0, -1, -1, 0, 0, 0, 0, 0])])
    post, _ = quality.fit(p, np.array([90.0, 10.0]))
    assert post[0] > 0.9 and post[1] < 0.1
    assert len(quality.fit(p[:0], np.zeros(0))[0]) == 0


def test_quality_awkward(spark, docs, none):
    kept = quality.keep_good(spark, docs)
    assert kept.columns == docs.columns and kept.count() >= 5 and own_columns_stay(kept)
    assert quality.keep_good(spark, none).count() == 0 and quality.judge(spark, none).count() == 0


# --- GIF ---


def plain_lzw(data, bits, defer=False):
    """A textbook encoder, which fills its table before it clears, or never clears."""
    clear, acc, n = 1 << bits, 0, 0

    def emit(code, width):
        nonlocal acc, n
        acc |= code << n
        n += width

    table, free, width, cur = {bytes([i]): i for i in range(clear)}, clear + 2, bits + 1, b""
    emit(clear, width)
    for b in data:
        if cur + bytes([b]) in table:
            cur += bytes([b])
            continue
        emit(table[cur], width)
        if free < 4096:
            table[cur + bytes([b])] = free
            width += free == 1 << width and width < 12
            free += 1
        elif not defer:
            emit(clear, width)
            table, free, width = {bytes([i]): i for i in range(clear)}, clear + 2, bits + 1
        cur = bytes([b])
    emit(table[cur], width)
    emit(clear + 1, width + (free == 1 << width and width < 12))
    return acc.to_bytes(-(-n // 8), "little")


@pytest.mark.parametrize("bits", [2, 4, 8])
def test_lzw(bits):
    rng = random.Random(bits)
    for k in (1, 5, 300, 9000):
        data = bytes(rng.choices(range(1 << bits), weights=[1 / (i + 1) ** 2 for i in range(1 << bits)], k=k))
        assert bytes(gif.unlzw(plain_lzw(data, bits), bits, k)) == data
        if bits == 8:
            assert gif.lzw(data) == plain_lzw(data, bits)


@pytest.mark.parametrize("bits", [2, 4, 8])
def test_lzw_deferred_clear(bits):
    rng = random.Random(bits)
    data = bytes(rng.choices(range(1 << bits), k=120_000))
    code = plain_lzw(data, bits, defer=True)
    assert len(code) * 8 > 12 * 2 * gif.CUT
    assert bytes(gif.unlzw(code, bits, len(data))) == data
    with pytest.raises(ValueError):
        gif.unlzw(code[: len(code) // 2], bits, len(data))


def animated():
    """Two 2 x 2 frames: red and green; then blue over one pixel, with a transparent one, after disposal to background."""
    palette = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9])
    out = b"GIF89a" + bytes([2, 0, 2, 0, 0x81, 0, 0]) + palette

    def frame(idx, flags, delay, left, w, h):
        code = plain_lzw(bytes(idx), 2)
        return b"\x21\xf9\x04" + bytes([flags, delay, 0, 3, 0]) + b"\x2c" + bytes([left, 0, 0, 0, w, 0, h, 0, 0, 2, len(code)]) + code + b"\0"

    return out + frame([0, 1, 1, 0], 2 << 2, 5, 0, 2, 2) + frame([2, 3], 1, 7, 1, 1, 2) + b"\x3b"


def test_lzw_looks_once_a_sample():
    """A dictionary is asked once for each sample but the first, and for nothing else; a full one ends its run."""
    data = bytes(random.Random(3).choices(range(256), [9] * 20 + [1] * 236, k=20_000))
    calls = [0]

    def count(frame, event, function):
        calls[0] += event == "c_call" and getattr(function, "__name__", "") in ("get", "setdefault", "__setitem__")
        looks[0] += event == "c_call" and getattr(function, "__name__", "") == "setdefault"

    looks = [0]
    sys.setprofile(count)
    try:
        found = gif.runs(data)
    finally:
        sys.setprofile(None)
    assert calls == looks == [len(data) - 1] and len(found) > 1
    strings = [[bytes([i]) for i in range(256)] + [b"", b""] for _ in found]
    parts = [gif._expand(codes, table, b"") for codes, table in zip(found, strings, strict=True)]
    assert b"".join(x for out, _ in parts for x in out) == data and all(out[-1] == last for out, last in parts)


def test_gif_frames():
    a, b = gif.decode(animated())
    assert (a.delay, b.delay) == (5, 7)
    assert a.rgba[0, 0].tolist() == [255, 0, 0, 255] and a.rgba[0, 1].tolist() == [0, 255, 0, 255]
    assert b.rgba[0, 0].tolist() == [0, 0, 0, 0]  # disposed of
    assert b.rgba[0, 1].tolist() == [0, 0, 255, 255] and b.rgba[1, 1].tolist() == [0, 0, 0, 0]  # transparent: what was disposed of
    with pytest.raises(ValueError):
        gif.decode(b"not a gif at all")


def test_gif_store(spark, docs, none):
    rng = random.Random(6)
    long = bytes(range(256)) * 200 + bytes(rng.choices(b"etaoin shrdlu", k=64 * 2000))
    raw = gif.store(long)
    shown = gif.decode(raw)
    assert gif.samples(raw) == long == b"".join(f.samples.tobytes() for f in shown) and len(shown) == -(-len(long) // (64 * 256))
    assert [f.disposal for f in shown[:4]] == [1, 2, 3, 1] and len({f.delay for f in shown}) == 2  # the last frame is less high
    assert len(gif.store(b"the cat and the hat " * 640)) < 5000  # dictionary codes
    assert (shown[0].rgba[:, :, 3] == 255).all() and shown[0].rgba.reshape(-1, 4)[0xE3].tolist() == [255, 0, 255, 255]
    # In the second frame the sample 0 shows the first one, which stays (disposal 1).
    held = gif.decode(gif.store(bytes([7]) * 64 * 256 + bytes(64)))
    assert (held[1].rgba == held[0].rgba).all()
    # The third shows through to nothing where the second has been disposed of to the background.
    three = gif.decode(gif.store(bytes([7]) * 64 * 512 + bytes([9]) * 64))
    assert three[2].rgba[0, 0, 3] == 255 and (three[2].rgba[1:] == 0).all()
    rows = gif.media_digests(spark, docs).collect()
    for r in rows:
        t = next(x[1] for x in AWKWARD if len((x[1] or "").encode()) == r["n_bytes"] and x[0] == r["doc_id"])
        payload = (t or "").encode().ljust(r["payload_bytes"], b"\0")
        assert r["payload_bytes"] % 64 == 0 and r["payload_bytes"] > 0
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_sha256"] == hashlib.sha256(gif.store(payload)).hexdigest() and r["media_bytes"] == len(gif.store(payload))
        assert r["frames"] == -(-len(payload) // 16384) and r["delay"] > 0 and sum(r["histogram"]) > 0
    stored = gif.store_texts(spark, docs)  # docs has media and frames of its own
    frames = gif.decode_media(spark, stored, column="media_").select("frames_", "media", "frames").collect()
    assert all(f["media"] == "own media" and f["frames"] == "own frames" for f in frames)
    assert all(sum(x["histogram"]) > 0 and x["width"] == 64 for f in frames for x in f["frames_"]) and max(len(f["frames_"]) for f in frames) > 1
    broken = spark.createDataFrame([(b"GIF89a",), (None,)], "media binary")
    assert [r["frames"] for r in gif.decode_media(spark, broken).collect()] == [None, None]
    assert gif.media_digests(spark, none).count() == 0


# --- near duplicates ---


def brute_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    up = list(range(len(fps)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(fps)):
        r = find(i)
        least[r] = min(x for x in (least.get(r), ids[i]) if x is not None)
    return [least[find(i)] for i in range(len(fps))]


def test_simhash_query(spark, sf):
    rows = texts(spark, sf, 1000)
    fps = [brute_fingerprint(t) for _, t in rows]
    want = brute_components([i for i, _ in rows], fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op5_simhash_dedup(spark, sf).collect()}
    assert got == {i: (f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, want, strict=True)}


def test_links_of_dense_groups(spark):
    rng = random.Random(3)
    fps = {0, 2**64 - 1}
    for _ in range(30):
        seed = rng.getrandbits(64)
        for _ in range(40):
            fps.add(seed ^ sum(1 << rng.randrange(64) for _ in range(rng.choice([1, 2, 3, 5]))))
            fps.add(seed)
    fps = [f & (2**64 - 1) for f in fps]
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    rows = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = brute_components(signed, fps)
    # Trees in tasks alone; then large shards' trees broadcast, in one slice and in several.
    for tree, part, slice_ in ((10**6, 64, 10**6), (8, 10, 10**6), (8, 10, 25)):
        edges = simhash.near_links(spark, rows, tree, part, slice_)
        roots = {r["node"]: r["root"] for r in graph.components(spark, edges).collect()}
        assert [roots.get(f, f) for f in signed] == want


def test_bk_tree():
    rng = random.Random(5)
    values = [rng.getrandbits(12) for _ in range(300)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    packed = simhash.PackedTree(tree.packed())
    for q in [*values[:50], 10**6]:
        want = sorted({v for v in values if (v ^ q).bit_count() <= 3})
        assert sorted(tree.within(q, 3)) == want == sorted(packed.within(q, 3))
    assert not list(simhash.PackedTree(simhash.BKTree().packed()).within(1, 64))


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 100), (300, 300)] + [(500, i) for i in range(501, 540)]
    got = {r[0]: r[1] for r in graph.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and got[200] == 100 and {got[i] for i in range(500, 540)} == {500}
    assert graph.components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_dedup_awkward(spark, docs, none):
    rows = simhash.near_duplicates(spark, docs).collect()
    assert len(rows) == len(AWKWARD)
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2, 6)} == {1} and {r["fingerprint"] for r in rows if r["doc_id"] == 1} == {"0" * 16}
    kept = simhash.keep_one(spark, docs)
    assert kept.columns == docs.columns and own_columns_stay(kept)
    assert kept.count() == len({simhash.fingerprint(r[1]) for r in AWKWARD})
    assert simhash.keep_one(spark, none).count() == 0 and simhash.near_duplicates(spark, none).count() == 0


# --- packing ---


def test_pack():
    rng = random.Random(7)
    sizes = [rng.randint(1, 2047) for _ in range(3000)]
    bins = packing.pack(sizes)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 2048 for b in bins)
    assert len(bins) <= 1.01 * -(-sum(sizes) // 2048) + 1


def filled(sizes, groups, room):
    bins = packing.Bins(room)
    for group in groups:
        b = bins.new()
        for i in group:
            bins.put(b, i, sizes[i])
    return bins


def n_used(bins):
    return sum(1 for h in bins.held if h)


def test_local_search_empties_a_bin():
    sizes = [6, 4, 5, 5, 3, 3, 4]  # best in three bins of ten
    bins = filled(sizes, ([0, 4], [2, 5], [1, 6], [3]), 10)
    packing.improve(bins, sizes)
    assert n_used(bins) == 3 and all(sum(sizes[i] for i in h) <= 10 for h in bins.held)


def test_local_search_two_for_one():
    sizes = [4, 4, 2, 7, 3, 7, 3]  # of the first bin, two of 4 go for 7 and 7 for … : three bins of ten hold all
    bins = filled(sizes, ([0, 1], [3, 2], [4, 6], [5]), 10)
    packing.improve(bins, sizes)
    assert n_used(bins) == 3


def best_fit(sizes, room=packing.ROOM):
    bins = packing.Bins(room)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = bins.tightest(sizes[i])
        bins.put(bins.new() if b is None else b, i, sizes[i])
    return bins


@pytest.mark.parametrize(("low", "high", "n"), [(600, 820, 1500), (500, 900, 1500), (300, 560, 1500)])
def test_local_search_beats_best_fit(low, high, n):
    """On a narrow band of lengths best fit leaves bins underfull; the search empties many, until no exchange raises squared fills."""
    rng = random.Random(low)
    sizes = [rng.randint(low, high) for _ in range(n)]
    bins = best_fit(sizes)
    before, fills = n_used(bins), sum((bins.room - x) ** 2 for x in bins.left)
    packing.improve(bins, sizes)
    assert n_used(bins) < before and sum((bins.room - x) ** 2 for x in bins.left) > fills
    assert sorted(i for h in bins.held for i in h) == list(range(n)) and all(sum(sizes[i] for i in h) == bins.room - x for h, x in zip(bins.held, bins.left, strict=True))
    fill = [bins.room - x for x in bins.left]
    under = [b for b, h in enumerate(bins.held) if h and bins.left[b]]
    if n_used(bins) > -(-sum(sizes) // bins.room):  # no one-for-one exchange and no move is left
        for a in under:
            for b in under:
                for x in bins.held[a]:
                    for y in [None, *bins.held[b]]:
                        moved = sizes[x] - (sizes[y] if y is not None else 0)
                        assert a == b or not 0 < moved <= bins.left[b] or fill[b] + moved <= fill[a]


def test_packing_query(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))  # its defaults, as the contract has them
    rows = queries.op6_best_fit_packing(spark, sf).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for i, text in texts(spark, sf, 1000):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for k, p in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            assert (p["piece"], p["start"]) == (k, at) and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            assert p["length"] == 2048 or k == 0
            at += p["length"]
        assert at == len(ids) and (len(ids) > 2048) == (len(by_doc[i]) > 1)
    for s in by_seq.values():
        at = 0
        for p in sorted(s, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
    assert len(by_seq) <= 1.02 * -(-sum(r["length"] for r in rows) // 2048) + 1


def test_packing_awkward(spark, docs, none):
    out = packing.pack_documents(spark, docs, queries.tokenizer("byte_bpe_50k.json"))
    assert {r["length"] for r in out.where("doc_id = 1").collect()} == {1} and out.where("doc_id = 3").count() == 3
    assert packing.pack_documents(spark, none, queries.tokenizer("byte_bpe_50k.json")).count() == 0


# --- toxicity ---


LEXICON = toxicity.Model(words={"idiot": 4.0, "fool": 3.0}, beta=[-3.0, 1.0, 0.0, 0.0, 0.0])


def brute_kinds(tokens, model=LEXICON):
    """The grammar as it is told, by looking around each match of one clause."""
    symbols = ["i" if model.weight(t) else toxicity.CUES.get(t, "o") for t in tokens]

    def near(i, what, reach):
        return any(symbols[j] == what for j in range(max(0, i - reach), i))

    kind = {}
    for i, s in enumerate(symbols):
        if s in "it":
            if near(i, "n", toxicity.DENIES):
                kind[i] = "d" + s
            elif "r" in symbols[:i]:
                kind[i] = "q" + s
            else:
                aimed = near(i, "g", toxicity.AIMS)
                kind[i] = (s.upper() if aimed else s) + ("a" if s == "t" and near(i, "a", toxicity.ANNOUNCES) else "")
    for j, s in enumerate(symbols):
        if s == "g":
            for of in "it":  # the last bare match within reach, with no target since
                back = [i for i in range(max(0, j - toxicity.AIMS), j) if kind.get(i, "") in (of, of + "a")]
                if back and "g" not in symbols[back[-1] : j]:
                    kind[back[-1]] = kind[back[-1]].replace(of, of.upper())
    out = {}
    for i, k in kind.items():
        out[k] = out.get(k, 0.0) + (model.weight(tokens[i]) or toxicity.THREAT_WEIGHT)
    return out


def test_grammar_equals_brute_force():
    rng = random.Random(4)
    words = ["idiot", "fool", "kill", "hurt", "you", "he", "will", "not", "said", "table", "the", "of"]
    for _ in range(20_000):
        tokens = rng.choices(words, weights=[4, 2, 4, 2, 4, 2, 3, 2, 1, 6, 6, 6], k=rng.randrange(1, 16))
        strong = {i: LEXICON.weight(t) for i, t in enumerate(tokens) if LEXICON.weight(t)}
        got = {k: w for k, w in LEXICON.kinds(tokens, strong).items() if w}
        assert got == brute_kinds(tokens), tokens


def test_grammar_order():
    s = LEXICON.score
    assert s("you are an idiot") == s("idiot, you are") > s("an idiot") > s("not an idiot") > s("a table")
    assert s("he said that she is an idiot") < s("you are an idiot") and s("said: an idiot") < s("an idiot")
    assert s("I will kill you") > s("kill you") > s("kill") and s("we will not kill you") < s("kill you")
    assert s("idiot. you") == s("idiot. of") and s(None) == s("") == s("12 34")


def test_factors_are_learned():
    """Quoted insults that are never toxic get a lower factor than the likeliest one."""
    rng = np.random.default_rng(1)
    n, k = 400, len(toxicity.KINDS)
    sums, y = np.zeros((n, k)), np.zeros(n)
    for i in range(n):
        if i % 4 == 0:
            sums[i, 0], y[i] = rng.uniform(2, 6), 1
        elif i % 4 == 1:
            sums[i, toxicity.KINDS.index("qi")] = rng.uniform(6, 30)
    factors, beta = toxicity.learned_factors(sums, np.full(n, 100), y)
    assert factors[toxicity.KINDS.index("qi")] < toxicity.FACTORS["qi"][1] and factors[0] == 1.0 and beta[1] > 0


def brute_lexicon(rows):
    """Terms with their log odds, from whole texts in plain counts."""
    n = [sum(y == k for _, y in rows) for k in (0, 1)]
    counts = {}
    for t, y in rows:
        words = {w for w in toxicity.WORDS.findall(t.lower()) if w not in ".!?;\n"}
        for x in {"w" + w for w in words} | {"s" + w[:k] for w in words for k in toxicity.STEMS if len(w) > k}:
            counts.setdefault(x, [0, 0])[y] += 1
    found = {x: np.log((c[1] + 0.5) / n[1] / ((c[0] + 0.5) / n[0])) for x, c in counts.items() if c[1] >= toxicity.LEAST_ROWS}
    return {x: w for x, w in found.items() if w >= np.log(toxicity.LEAST_RATIO)}


def test_toxicity_fit_equals_brute_force(spark, sf):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(spark, docs, labels)
    by_id = dict(texts(spark, sf, 10_000))
    rows = [(by_id[r["doc_id"]], r["toxic"]) for r in labels.collect() if r["doc_id"] in by_id and not toxicity.crc_held_out(r["doc_id"]) and r["toxic"] is not None]
    want = brute_lexicon(rows)
    got = {"w" + w: x for w, x in model.words.items()} | {"s" + w: x for w, x in model.stems.items()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    for r in queries.op7_toxicity(spark, sf).collect():
        assert abs(r["score"] - model.score(by_id[r["doc_id"]])) < 1e-9 and r["predicted"] == (r["score"] >= 0.3)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op7_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    assert all(0 <= r["score"] <= 1 and r["held_out"] == toxicity.crc_held_out(r["doc_id"]) for r in rows)
    hit = sum(1 for r in rows if r["predicted"] and labels[r["doc_id"]])
    assert hit / sum(r["predicted"] for r in rows) > 0.7 and hit / sum(labels[r["doc_id"]] for r in rows) > 0.7


def test_toxicity_awkward(spark, docs, none):
    for labels in ([], [(1, 0)], [(1, 1), (3, 0), (4, 0), (None, 1)]):
        model = toxicity.fit(spark, docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        out = docs.select(toxicity.score_documents(spark, docs, model).alias("s")).collect()
        assert len(out) == len(AWKWARD) and all(0 <= r["s"] <= 1 for r in out)


# --- mixing ---


def brute_targets(sizes, share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        if not open_:
            return fixed
        left = total - sum(fixed.values())
        want = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if want[s] >= cap * sizes[s]]
        if not over:
            return fixed | want
        fixed |= {s: cap * sizes[s] for s in over}


def test_mix_query(spark, sf):
    rows = queries.op8_source_mix(spark, sf).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sizes, taken = {}, {}
    for r in rows:
        s = docs[r["doc_id"]]["source"]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r["doc_id"]]["text"])) and 0 <= r["taken"] <= 2 * r["size"]
        sizes[s], taken[s] = sizes.get(s, 0) + r["size"], taken.get(s, 0) + r["taken"]
    want = brute_targets(sizes)
    for r in rows:
        s = docs[r["doc_id"]]["source"]
        assert abs(r["target"] - want[s]) < 1e-6 and r["source_size"] == sizes[s] and taken[s] == int(r["target"])
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op8_source_mix(spark, sf).collect()))


def test_mix_awkward(spark, docs, none):
    plan = mixing.mix_plan(docs).collect()
    assert len(plan) == len(AWKWARD)
    out = mixing.mix_rows(docs)
    assert out.columns == docs.columns and own_columns_stay(out)
    words = sum(len((r["text"] or "").split()) for r in out.collect())
    assert words == sum(r["taken"] for r in plan)
    assert mixing.mix_plan(none).count() == 0 and mixing.mix_rows(none).count() == 0


def test_mix_of_equal_rows(spark, monkeypatch):
    """Where the cut falls on equal rows, they share what remains; the same through a join that is no broadcast."""
    rows = [(1, "a b c d e f g", "x")] * 5 + [(2, "a b", "y")] * 40 + [(None, "q r s", "z")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(map(tuple, mixing.mix_plan(docs).select("doc_id", "source", "target", "taken").collect()), key=str)
    for source, n in (("x", 5), ("y", 40), ("z", 30)):
        mine = [(target, taken) for _, s, target, taken in got if s == source]
        assert len(set(mine)) == 1 and 0 <= mine[0][0] - n * mine[0][1] < n + 1
    monkeypatch.setattr(mixing, "MOST_SOURCES", 0)
    assert sorted(map(tuple, mixing.mix_plan(docs).select("doc_id", "source", "target", "taken").collect()), key=str) == got
    mixed = mixing.mix_rows(docs)
    assert sum(len(r["text"].split()) for r in mixed.collect()) == sum(r[3] for r in got)


# --- personal data ---


def brute_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        total = sum(int(c) if i % 2 == 0 else sum(divmod(int(c) * 2, 10)) for i, c in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans(spark, sf):
    for _, t in [*texts(spark, sf, 1000), (0, "a@b.c.d, x@y 1.2.3.4.5.6.7.8 300.1.1.1 4111-1111 1111 1111 +49 30 1234567"), (0, "é 4111111111111111é +1 (2"), (0, "1234567890123 0000.1.1.1"), (0, "see " + "0" * 5000 + "1.2.3.4 and " + "9" * 5000 + ".1.1.1"), (0, "a@b@c.d e.f@g.h@i.j @k.l m@n"), (0, "1.2.3.4.5.6.7.8.9 1..2.3.4.5")]:
        assert pii.base_spans(t) == brute_spans(t)


def test_base_spans_of_random_texts():
    rng = random.Random(8)
    for _ in range(20_000):
        t = "".join(rng.choices("a1@.-_ +(é2", weights=[4, 6, 2, 4, 2, 1, 2, 1, 1, 1, 3], k=rng.randrange(1, 40)))
        assert pii.base_spans(t) == brute_spans(t)


SECRET = re.compile(r"(?<![A-Za-z0-9])(?:[A-Za-z]{2,6}[-_])?(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{20,}+", re.ASCII)


def test_secrets_equal_plain_pattern():
    """Candidates are those of one pattern that says all at once."""
    rng = random.Random(9)
    for _ in range(20_000):
        t = "".join(rng.choices("aB1-_ .é", weights=[9, 9, 3, 2, 2, 0.4, 0.2, 0.2], k=rng.randrange(15, 70)))
        assert [(s, e) for k, s, e, _ in pii.candidates(t) if k == 0] == [m.span() for m in SECRET.finditer(t)]


def test_time_grows_with_the_text():
    import time

    def took(unit, n):
        began = time.process_time()
        pii.found_in(unit * n)
        return time.process_time() - began

    for unit in ("a", "1", "1.", "-_", "a@", "+1 ", "1 ", "+", "a.", "A1", "0.0.0.0 ", "4111 1111 1111 1111 "):
        pii.found_in(unit * 1000)
        assert took(unit + "", 200_000 // len(unit)) < 12 * max(0.05, took(unit, 40_000 // len(unit)))
    pii.found_in("a" * 200_000 + "@" + "b" * 200_000)


def brute_added(base, found, takes):
    held, out = [tuple(map(int, x.split(":")[1:])) for x in base.split(",") if x], []
    for c in sorted(found, key=lambda c: (c["kind"], c["start"])):
        if takes.get(c["pattern"], 0) >= 0.5 and all(c["end"] <= s or e <= c["start"] for s, e in held):
            held.append((c["start"], c["end"]))
            out.append(f"{pii.ADDED[c['kind']]}:{c['start']}:{c['end']}")
    return ",".join(x for x in (base, *out) if x)


def test_added_spans_equal_brute_force(spark, sf):
    rng = random.Random(10)
    for _ in range(3000):
        spans = sorted((s, s + rng.randrange(1, 9)) for s in rng.choices(range(60), k=rng.randrange(6)))
        base = ",".join(f"ip:{s}:{e}" for s, e in spans)
        found = [{"kind": rng.randrange(4), "start": s, "end": s + rng.randrange(1, 12), "pattern": rng.randrange(3)} for s in rng.choices(range(60), k=rng.randrange(8))]
        assert pii.with_added(base, found, {0: 0.9, 1: 0.2}) == brute_added(base, found, {0: 0.9, 1: 0.2})
    # The whole query: patterns counted, EM and classifier on them, spans added, text by text.
    rows, counts = texts(spark, sf, 1000), {}
    found = {i: pii.found_in(t) for i, t in rows}
    for f in found.values():
        for c in f[6]:
            counts[c["pattern"]] = counts.get(c["pattern"], 0) + 1
    takes = pii.train(counts)
    for r in queries.op9_personal_data(spark, sf).collect():
        assert r["spans"] == brute_added(found[r["doc_id"]][4], found[r["doc_id"]][6], takes)


def test_reliabilities_equal_brute_force():
    """EM vote by vote, in plain loops."""
    import math

    votes, counts = [(1, 1, 0), (-1, 0, -1), (1, -1, 0), (0, 0, 1)], [40, 30, 7, 5]
    right, share, post = [0.8] * 3, 0.5, [0.0] * 4
    for _ in range(200):
        new = []
        for v in votes:
            odds = math.log(share / (1 - share)) + sum(x * math.log(r / (1 - r)) for x, r in zip(v, right, strict=True))
            new.append(1 / (1 + math.exp(-odds)))
        for k in range(3):
            hit = sum(n * (p if v[k] == 1 else 1 - p) for v, n, p in zip(votes, counts, new, strict=True) if v[k])
            cast = sum(n for v, n in zip(votes, counts, strict=True) if v[k])
            right[k] = min(0.99, max(0.55, (hit + 8) / (cast + 10)))
        share = min(0.98, max(0.02, (sum(n * p for n, p in zip(counts, new, strict=True)) + 2) / (sum(counts) + 4)))
        if max(abs(a - b) for a, b in zip(new, post, strict=True)) < 1e-9:
            break
        post = new
    got, acc, part = pii.reliabilities(np.array(votes, float), np.array(counts, float))
    assert np.allclose(got, new, atol=1e-6) and np.allclose(acc, right, atol=1e-6) and abs(part - share) < 1e-6


def test_personal_data_query(spark, sf):
    by_id = dict(texts(spark, sf, 1000))
    secrets = 0
    for r in queries.op9_personal_data(spark, sf).collect():
        base = pii.joined(brute_spans(by_id[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and r["spans"].startswith(base)
        secrets += r["spans"].count("secret:")
    assert secrets == sum(t.count('token = "') for t in by_id.values())


def test_reliabilities_separate():
    votes = np.array([[1, 1, 1], [-1, -1, -1], [1, 1, -1], [0, 0, 0]], float)
    post, right, _ = pii.reliabilities(votes, np.array([50.0, 50.0, 5.0, 1.0]))
    assert post[0] > 0.9 > 0.1 > post[1] and (right > 0.55).all()
    assert pii.train({}) == {}


def test_redact_awkward(spark, docs, none):
    out = pii.redact(spark, docs)
    assert out.columns == docs.columns and out.count() == len(AWKWARD) and own_columns_stay(out)
    t = out.where("doc_id = 7").first()["text"]
    assert t.startswith("mail me: <EMAIL> or <PHONE>, <IP>, <CARD> today")
    assert out.where("text is null").count() == 1 and pii.redact(spark, none).count() == 0


def test_long_secrets_are_candidates():
    rng = random.Random(3)
    for n in (20, 128, 129, 5000):
        token = "ya29." + "".join(rng.choices("abcXYZ0189", k=n - 1)) + "7"
        text = f"token: {token} end"
        assert [(s, e) for k, s, e, _ in pii.candidates(text) if k == 0] == [(12, 12 + n)]
    dashed = "a1b2-c3d4_" * 40
    assert [(s, e) for k, s, e, _ in pii.candidates(dashed) if k == 0] == [(0, 400)]


# --- licences ---


def brute_licences(rows):
    import regex

    def words(t):
        return [w for w in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if w]

    def grams(w):
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    templates = {k: grams(words(v)) for k, v in licenses.TEMPLATES.items()}
    out = set()
    for i, t in rows:
        mine = grams(words(t))
        out |= {(i, k, round(len(g & mine) / len(g), 6)) for k, g in templates.items() if len(g & mine) >= 0.8 * len(g)}
    return out


def test_licence_query(spark):
    sf = "/root/testdata/sf0.01"
    got = {(r["doc_id"], r["template"], round(r["containment"], 6)) for r in queries.op10_license_scan(spark, sf).collect()}
    want = brute_licences([tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])
    assert want and got == want


def test_licences_near_copies(spark):
    rng, rows = random.Random(9), []
    for i in range(120):
        name = rng.choice([k for k in licenses.TEMPLATES if "short" not in k])
        w = licenses.TEMPLATES[name].split()
        if i % 2:
            w[rng.randrange(len(w))] = "altered"
        noise = [f"noise{rng.randrange(10**6)}" for _ in range(rng.randrange(200))]
        rows.append((i, " ".join([*noise, *w, *noise[:7]])))
    got = {(r["doc_id"], r["template"]) for r in licenses.scan(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {(i, k) for i, k, _ in brute_licences(rows)}
    assert len(want) > 60 and got <= want and len(got) >= 0.98 * len(want)


def test_licences_short_in_mid_text(spark):
    rng, rows = random.Random(4), []
    templates = licenses.TEMPLATES | {f"of {n} words": " ".join(f"notice{n}x{k}" for k in range(n)) for n in range(5, 17)}
    for name, text in templates.items():
        w = text.split()
        if len(w) > 16:
            continue
        for before in range(8):
            for change in (None, 0, -1):
                own = [*w]
                if change is not None:
                    own[change] = "altered"
                rows.append((len(rows), name, " ".join([*[f"n{rng.randrange(10**9)}" for _ in range(before)], *own, *[f"n{rng.randrange(10**9)}" for _ in range(20)]]), change))
    docs = spark.createDataFrame([(i, t) for i, _, t, _ in rows], "doc_id long, text string")
    got = {(r["doc_id"], r["template"]) for r in licenses.scan(spark, docs, templates).collect()}

    def n_shingles(name):
        return len([w for w in re.split(r"[^a-z0-9]+", templates[name].lower()) if w]) - licenses.SHINGLE + 1

    # An altered word at an end costs one shingle; from fifteen words on, altered notices are found by chance.
    sure = {(i, k) for i, k, _, change in rows if n_shingles(k) > 0 and (change is None or 5 <= n_shingles(k) <= 10)}
    assert len(sure) > 150 and not sure - got


def test_licences_awkward(spark, docs, none):
    assert [r["template"] for r in licenses.scan(spark, docs).collect()] == ["MIT short"]
    assert licenses.scan(spark, none).count() == 0


def test_licences_plan_is_native(spark, docs):
    plan = licenses.scan(spark, docs)._jdf.queryExecution().executedPlan().toString()
    plan += mixing.mix_plan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


def test_digests_of_many_edges_do_not_overflow(spark):
    """Hashes of one sign, whose sum is more than a long holds; sets that differ in an edge differ."""
    edges = spark.range(40_000).select(F.col("id").alias("a"), (-F.col("id")).alias("b")).where(F.xxhash64("a", "b") > 0)
    first = graph.digest(edges)
    assert first == graph.digest(edges.repartition(3)) and first != graph.digest(edges.where("a <> 39999 and a <> 39998 and a <> 39997 and a <> 39996"))
