"""Token-id output: shard files of raw ids with a minimal perfect hash index, and keyed reads from them.

`write_shards` range-partitions documents by doc_id, so shard by shard and inside each the documents ascend; a task encodes
its documents and streams their ids into one payload file. Beside it lies the index file: a minimal perfect hash of the
document keys and, by slot, a stored 32-bit fingerprint, the offset and the length. `lookup` finds a key's ids with a constant
number of small reads: the table of keys, sorted by doc_id, tells its shard, and of that shard's index a few words are read.

Files (little-endian): `<name>.ids` holds nothing but ids, of 2 bytes where the vocabulary allows it, else 4. `<name>.idx`:
magic `TSHARD01`, id width, number of documents, then the perfect hash, then by slot fingerprints (u4), offsets and lengths
in ids (i8 each).

Names are new for each attempt, and only the attempts that Spark commits are listed in the table of keys, written beside;
a lost executor's half-written files are never read.

Cases: null text is encoded as empty (the end id alone). The key of a document is its doc_id and, among rows of the same
doc_id in a shard, its ordinal, so ties and repeated rows keep one entry each; a null doc_id sorts first. An empty table gives
no shards. Other columns are neither read nor clashing: only the id and text columns are used, and outputs are named here.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tenet.llm.common import arrow_sized, new_path, text_or_empty
from tenet.llm.mphf import PerfectHash, fingerprint, mix, slot_by_reads
from tenet.llm.wordcache import encoder

MAGIC = b"TSHARD01"
NULL_KEY = np.int64(-(2**63))
KEYS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ordinal", T.LongType()), T.StructField("shard", T.StringType()), T.StructField("n_tokens", T.LongType())])
READ = T.StructType([*KEYS.fields, T.StructField("shard_start", T.LongType()), T.StructField("ids_crc32", T.LongType())])
#: Payloads are read in blocks of so many bytes; so many blocks and indexes are held.
BLOCK, HELD = 4 << 20, 4


def key_hash(doc_ids: np.ndarray, ordinals: np.ndarray) -> np.ndarray:
    """64 bits of a document key (doc_id, ordinal). mix is a bijection, so the keys with ordinal 0 never collide."""
    x = mix(doc_ids.view(np.uint64) if doc_ids.dtype == np.int64 else doc_ids.astype(np.uint64), 1)
    again = ordinals > 0
    return np.where(again, mix(x ^ mix(ordinals.astype(np.uint64), 3), 2), x)


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    fs, at = pyarrow.fs.FileSystem.from_uri(path)
    return fs, at


def write_shards(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 1, folder: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode, write the shards into folder (default: a new one in the shared folder), and return the table of keys.

    The table has doc_id, ordinal, shard (the files' path without ending) and n_tokens; written as Parquet, its files are the commit."""
    arrow_sized(spark)
    folder = folder or new_path(spark, "token-shards")
    path = tokenizer_path

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc = encoder(path, "<u2" if vocabulary(path) <= 1 << 16 else "<u4")
        end = np.array([end_id], enc.dtype).tobytes()
        fs, at = opened(folder)
        fs.create_dir(at, recursive=True)
        name, out, ids, lengths = f"{folder}/{uuid.uuid4().hex}", None, [], []
        for batch in batches:
            if out is None:
                out = fs.open_output_stream(opened(name)[1] + ".ids")
            got = enc.encode(batch.column(1).to_pylist())
            for x in got:
                out.write(x + end)
            ids.append(batch.column(0))
            lengths.append(np.array([len(x) // enc.dtype.itemsize + 1 for x in got], np.int64))
        if out is None:
            return
        out.close()
        doc_ids, n = pa.chunked_array(ids), np.concatenate(lengths)
        keys = doc_ids.fill_null(int(NULL_KEY)).to_numpy().astype(np.int64)
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        ordinals = np.arange(len(keys)) - np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
        hashes = key_hash(keys, ordinals)
        index = PerfectHash.build(hashes)
        slots, starts = index.slots(hashes), np.cumsum(n) - n
        by_slot = np.argsort(slots)
        with fs.open_output_stream(opened(name)[1] + ".idx") as f:
            f.write(MAGIC + np.array([enc.dtype.itemsize, len(keys)], "<i8").tobytes() + index.to_bytes())
            f.write(fingerprint(hashes)[by_slot].astype("<u4").tobytes() + starts[by_slot].astype("<i8").tobytes() + n[by_slot].astype("<i8").tobytes())
        for i in range(0, len(keys), 10_000):
            part = slice(i, i + 10_000)
            yield pa.RecordBatch.from_arrays([doc_ids.slice(i, 10_000).combine_chunks() if doc_ids.num_chunks else doc_ids, pa.array(ordinals[part]), pa.array([name] * len(keys[part]), pa.string()), pa.array(n[part])], schema=to_arrow_schema(KEYS))

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"))
    spread = F.xxhash64("text")  # divides the rows of one doc_id, should it have very many
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), spread).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), spread)
    ordered.mapInArrow(write, KEYS).write.parquet(f"{folder}/keys")
    return spark.read.schema(KEYS).parquet(f"{folder}/keys")


@lru_cache(maxsize=8)
def vocabulary(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


class Shard:
    """Keyed reads from one shard's two files."""

    def __init__(self, name: str):
        fs, at = opened(name)
        raw = fs.open_input_stream(at + ".idx").read()
        if raw[:8] != MAGIC:
            raise ValueError(f"{name}.idx is no index of a token shard")
        width, n = np.frombuffer(raw, "<i8", 2, 8)
        self.index, used = PerfectHash.from_bytes(raw[24:])
        at_, self.dtype = 24 + used, np.dtype(f"<u{width}")
        self.prints = np.frombuffer(raw, "<u4", n, at_)
        self.starts = np.frombuffer(raw, "<i8", n, at_ + 4 * n)
        self.lengths = np.frombuffer(raw, "<i8", n, at_ + 12 * n)
        self.payload = fs.open_input_file(at + ".ids")
        self.blocks: OrderedDict[int, bytes] = OrderedDict()

    def find(self, doc_ids: np.ndarray, ordinals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths, in ids; -1 where the shard has no such key."""
        hashes = key_hash(doc_ids, ordinals)
        slots = self.index.slots(hashes)
        if not len(self.prints):
            return np.full(len(hashes), -1), np.full(len(hashes), -1)
        safe = np.maximum(slots, 0)
        known = (slots >= 0) & (self.prints[safe] == fingerprint(hashes))
        return np.where(known, self.starts[safe], -1), np.where(known, self.lengths[safe], -1)

    def _block(self, k: int) -> bytes:
        if k not in self.blocks:
            self.blocks[k] = self.payload.read_at(BLOCK, k * BLOCK)
            while len(self.blocks) > HELD:
                self.blocks.popitem(last=False)
        return self.blocks[k]

    def ids(self, start: int, length: int) -> np.ndarray:
        at, n, parts = int(start) * self.dtype.itemsize, int(length) * self.dtype.itemsize, []
        while n:
            k, off = divmod(at, BLOCK)
            x = self._block(k)[off : off + n]
            if not x:
                raise EOFError("a token shard's payload is shorter than its index says")
            parts.append(x)
            at, n = at + len(x), n - len(x)
        return np.frombuffer(b"".join(parts), self.dtype)


class Reader:
    """One key's ids by a constant number of small reads; of the index, only its sizes are held."""

    def __init__(self, name: str):
        fs, at = opened(name)
        self.index, self.payload = fs.open_input_file(at + ".idx"), fs.open_input_file(at + ".ids")
        head = self.index.read_at(40, 0)
        if head[:8] != MAGIC:
            raise ValueError(f"{name}.idx is no index of a token shard")
        width, self.n, levels, self.words = np.frombuffer(head, "<i8", 4, 8).tolist()
        self.dtype = np.dtype(f"<u{width}")
        self.sizes = np.frombuffer(self.index.read_at(8 * levels, 40), "<i8")
        self.at = 40 + 8 * levels

    def _number(self, at: int, kind: str) -> int:
        return int(np.frombuffer(self.index.read_at(int(kind[-1]), at), kind)[0])

    def ids(self, doc_id: int | None, ordinal: int = 0) -> np.ndarray | None:
        key = key_hash(np.array([NULL_KEY if doc_id is None else doc_id], np.int64), np.array([ordinal]))
        slot = slot_by_reads(key[0], self.sizes, lambda i, word: self._number(self.at + 8 * i + (0 if word else 8 * self.words), "<u8" if word else "<i8"))
        table = self.at + 16 * self.words
        if slot < 0 or self._number(table + 4 * slot, "<u4") != int(fingerprint(key)[0]):
            return None
        start, n = (self._number(table + (4 + 8 * k) * self.n + 8 * slot, "<i8") for k in (0, 1))
        raw = self.payload.read_at(n * self.dtype.itemsize, start * self.dtype.itemsize)
        return np.frombuffer(raw, self.dtype)

    def close(self) -> None:
        self.index.close()
        self.payload.close()


def read_shards(spark: SparkSession, keys: DataFrame) -> DataFrame:
    """For each row of the table of keys (or a part of it): its place and the checksum of its ids, found by key in the files."""
    arrow_sized(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[str, Shard] = OrderedDict()
        for batch in batches:
            names = np.array(batch.column(2).to_pylist(), dtype=object)
            doc_ids = batch.column(0).fill_null(int(NULL_KEY)).to_numpy(zero_copy_only=False).astype(np.int64)
            ordinals = batch.column(1).to_numpy(zero_copy_only=False)
            starts, lengths, crcs = (np.zeros(len(names), np.int64) for _ in range(3))
            for name in dict.fromkeys(names):
                if name not in held:
                    held[name] = Shard(name)
                    while len(held) > HELD:
                        held.popitem(last=False)
                which = np.flatnonzero(names == name)
                starts[which], lengths[which] = held[name].find(doc_ids[which], ordinals[which])
                for i in which:
                    if lengths[i] < 0:
                        raise KeyError(f"document {doc_ids[i]} is not in {name}")
                    crcs[i] = zlib.crc32(held[name].ids(starts[i], lengths[i]).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(lengths), pa.array(starts), pa.array(crcs)], schema=to_arrow_schema(READ))

    return keys.mapInArrow(read, READ)


def shard_starts(keys: DataFrame) -> DataFrame:
    """For each shard, the ids of all shards before it. One row a shard: their number, not that of documents, meets in one task."""
    from pyspark.sql import Window

    totals = keys.groupBy("shard").agg(F.sum("n_tokens").alias("n"), F.min(F.coalesce("doc_id", F.lit(int(NULL_KEY)))).alias("low"), F.max(F.coalesce("doc_id", F.lit(int(NULL_KEY)))).alias("high"))
    before = Window.orderBy("low", "high", "shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def read_back(spark: SparkSession, keys: DataFrame) -> DataFrame:
    """All documents of the table of keys, with global starts, as the files have them."""
    got = read_shards(spark, keys).join(shard_starts(keys), "shard")
    return got.select("doc_id", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32", "ordinal", "shard")


def lookup(keys: DataFrame, doc_ids: list[int]) -> dict[int, np.ndarray]:
    """Ids of some documents by key (their first rows), for training loaders and tests.

    Row groups of the sorted table of keys are pruned by doc_id; one shard after another is opened."""
    places = keys.where(F.col("doc_id").isin(doc_ids) & (F.col("ordinal") == 0)).groupBy("doc_id").agg(F.min("shard").alias("shard")).collect()
    by_shard: dict[str, list[int]] = {}
    for r in places:
        by_shard.setdefault(r["shard"], []).append(r["doc_id"])
    found = {}
    for name, wanted in by_shard.items():
        reader = Reader(name)
        for d in wanted:
            if (ids := reader.ids(d)) is not None:
                found[d] = ids
        reader.close()
    return found


__all__ = ["Reader", "Shard", "lookup", "read_back", "read_shards", "shard_starts", "write_shards"]
