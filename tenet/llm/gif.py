"""GIF: decoding of LZW code streams, palettes, disposal and transparency into timed frames with colour histograms, and
lossless storage of bytes as 8-bit samples of GIF images.

`decode` follows GIF89a: global and local palettes, interlacing, graphic control (delay, disposal 0-3, transparent index), and
the canvas that frames are put on. `store` writes bytes as samples of an animation of frames 64 wide and up to 256 high, each
an LZW stream of its own with dictionary codes of 9 to 12 bits and a clear code where the table is full. The palette spreads a
sample's bits over red, green and blue; a frame's delay follows its height; disposal goes through the three rules in turn, and
every second frame has a transparent colour. Samples are read back before palettes, so none of this loses a byte.

LZW decoding: between two clear codes, the width of each code follows from its position alone, so a whole run is cut out at
once, and a run that goes on with a full table in further cuts.

Cases: null text is stored as empty. Empty payloads are padded to 64 bytes. A payload over a frame takes several. Equal texts give
equal values in every column. Broken files raise ValueError from `decode`; `decode_media` gives null frames for them and for
null. Repeated rows and empty tables need nothing special; other columns are carried by name, and a column of the name that is
to be added is kept: the new one gets underscores at its end.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenet.llm.common import arrow_sized, spark_type, struct_array, unused

#: Samples of a row, and rows of a frame at most.
WIDTH, MOST_ROWS = 64, 256
CLEAR, END = 256, 257
#: Codes that decoding cuts out at once. Longer runs go on with a full table, at 12 bits.
CUT = 4096


@dataclass
class Frame:
    """A composited frame: rgba is height x width x 4; delay in hundredths of a second; samples are the image's own, before palettes."""

    delay: int
    disposal: int
    rgba: np.ndarray
    samples: np.ndarray


# --- LZW ---


def unlzw(data: bytes, min_bits: int, n_out: int) -> np.ndarray:
    """The samples of an LZW code stream."""
    clear = 1 << min_bits
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    words = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16  # at each byte, the next three
    strings = singles(clear)
    parts, n, at, first, last = [], 0, 0, 0, b""
    table = strings[:]
    while n < n_out:
        codes, offsets = _cut(words, len(data) * 8, at, min_bits, first)
        stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
        k = int(stop[0]) if len(stop) else len(codes)
        got, last = _expand(codes[:k].tolist(), table, last)
        parts.append(b"".join(got))
        n += len(parts[-1])
        if k == len(codes) or codes[k] == clear + 1:
            if k < CUT:
                break
            at, first = int(offsets[k]), first + CUT
        else:
            at, first, last, table = int(offsets[k + 1]), 0, b"", strings[:]
    if n < n_out:
        raise ValueError(f"a code stream ends after {n} of {n_out} samples")
    return np.frombuffer(b"".join(parts)[:n_out], np.uint8)


@lru_cache
def singles(clear: int) -> list[bytes]:
    """A table's first strings, to be copied: the samples', then nothing for two codes."""
    return [bytes([i]) for i in range(clear)] + [b"", b""]


@lru_cache(maxsize=64)
def widths(first: int, n: int, min_bits: int) -> np.ndarray:
    """Bits of n codes of which the first has that number since a clear code."""
    # When code i is read (from 0), entries up to clear + 1 + max(i - 1, 0) exist.
    entries = (1 << min_bits) + 2 + np.maximum(np.arange(first, first + n) - 1, 0)
    return np.minimum(np.maximum(min_bits + 1, np.floor(np.log2(entries)).astype(np.int64) + 1), 12)


def _cut(words: np.ndarray, n_bits: int, at: int, min_bits: int, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The next CUT codes as if no clear code followed: values, and where each begins (one more)."""
    wide = widths(min(first, 4096), CUT, min_bits)[: max(0, n_bits - at) // (min_bits + 1) + 1]
    offsets = at + np.concatenate([[0], np.cumsum(wide)])
    usable = int(np.searchsorted(offsets, n_bits, side="right")) - 1
    wide, offsets = wide[:usable], offsets[: usable + 1]
    return words[offsets[:-1] >> 3] >> (offsets[:-1] & 7) & ((1 << wide) - 1), offsets


def _expand(codes: list[int], table: list[bytes], last: bytes) -> tuple[list[bytes], bytes]:
    """The strings of codes, and the last one. The table gets an entry for each code after a run's first, until it is full."""
    add, size = table.append, len(table)
    first = 0 if last else 1
    for c in codes[:first]:
        if c >= size:
            raise ValueError(f"code {c} is not in the table")
        last = table[c]
    for c in codes[first : first + 4096 - size]:
        if c < size:
            entry = table[c]
        elif c == size:  # the entry that this code makes
            entry = last + last[:1]
        else:
            raise ValueError(f"code {c} is not in the table")
        add(last + entry[:1])
        size += 1
        last = entry
    out = [table[c] for c in codes]
    return out, out[-1] if out else last


def runs(data: bytes) -> list[list[int]]:
    """The dictionary codes of 8-bit samples, a list for each run between clear codes: a run ends when the table is full."""
    # Codes are held times 256, so that a code and the next sample make a key by addition. One look finds a key or adds it.
    out, codes, free, full = [], [], (CLEAR + 2) << 8, 4096 << 8
    known, cur = {}.setdefault, data[0] << 8
    for c in data[1:]:
        code = known(cur + c, free)
        if code != free:
            cur = code
            continue
        codes.append(cur >> 8)
        cur = c << 8
        if free < full:
            free += 256
        else:
            out.append(codes)
            codes, known, free = [], {}.setdefault, (CLEAR + 2) << 8
    codes.append(cur >> 8)
    return [*out, codes]


def lzw(data: bytes) -> bytes:
    """The code stream of 8-bit samples."""
    values, wide = [np.array([CLEAR])], [widths(0, 1, 8)]
    found = runs(data)
    for i, codes in enumerate(found, 1):
        values.append(np.array([*codes, END if i == len(found) else CLEAR]))
        wide.append(widths(0, CUT, 8)[: len(codes) + 1])  # a run has fewer
    v, w = np.concatenate(values).astype(np.int64), np.concatenate(wide)
    end = np.cumsum(w)
    at = end - w
    v <<= at & 7
    size = (int(end[-1]) + 7) // 8
    # Codes share no bit, so what they put into a byte adds up.
    return sum(np.bincount((at >> 3) + k, v >> 8 * k & 255, size + 2) for k in range(3))[:size].astype(np.uint8).tobytes()


# --- files ---

#: Red, green and blue of each sample: its highest three bits, the next three, the lowest two.
PALETTE = bytes(x for v in range(256) for x in ((v >> 5) * 255 // 7, (v >> 2 & 7) * 255 // 7, (v & 3) * 255 // 3))


def store(payload: bytes) -> bytes:
    """A GIF whose frames' samples, in order, are the payload (of a multiple of 64 bytes)."""
    if not payload or len(payload) % WIDTH:
        raise ValueError("a payload has a positive multiple of 64 bytes")
    most = WIDTH * MOST_ROWS
    parts = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(len(payload), most) // WIDTH, 0xF7, 0, 0), PALETTE]
    for k, i in enumerate(range(0, len(payload), most)):
        frame = payload[i : i + most]
        rows = len(frame) // WIDTH
        disposal, transparent = 1 + k % 3, k % 2
        control = struct.pack("<BHBB", disposal << 2 | transparent, 2 + rows // 8, 0, 0)
        parts += [b"\x21\xf9\x04", control, b"\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, rows, 0), b"\x08", _blocks(lzw(frame))]
    return b"".join([*parts, b"\x3b"])


def _blocks(code: bytes) -> bytes:
    """Data sub-blocks of 255 bytes, and the empty one."""
    full, rest = divmod(len(code), 255)
    out = np.full((full, 256), 255, np.uint8)
    out[:, 1:] = np.frombuffer(code, np.uint8, full * 255).reshape(full, 255)
    return out.tobytes() + (bytes([rest]) + code[full * 255 :] if rest else b"") + b"\0"


def _unblocked(raw: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(raw):
            raise ValueError("data blocks run over the end")
        n = raw[at]
        if n == 255:  # as many full blocks at once as there are
            run = np.frombuffer(raw, np.uint8, offset=at)
            run = run[: len(run) // 256 * 256].reshape(-1, 256)
            other = np.flatnonzero(run[:, 0] != 255)
            k = int(other[0]) if len(other) else len(run)
            if k:
                parts.append(run[:k, 1:].tobytes())
                at += 256 * k
                continue
        parts.append(raw[at + 1 : at + 1 + n])
        at += 1 + n
        if not n:
            return b"".join(parts), at


def images(raw: bytes):
    """(left, top, palette or None, transparent index or None, delay, disposal, samples as height x width) of each image, after
    (width, height, background index, global palette)."""
    if raw[:6] not in (b"GIF87a", b"GIF89a") or len(raw) < 13:
        raise ValueError("not a GIF file")
    width, height, flags, background, _ = struct.unpack("<HHBBB", raw[6:13])
    at, table = 13, None
    if flags & 0x80:
        n = 3 << (flags & 7) + 1
        table, at = np.frombuffer(raw[at : at + n], np.uint8).reshape(-1, 3), at + n
    yield width, height, background, table
    transparent, delay, disposal = None, 0, 0
    while at < len(raw):
        kind = raw[at]
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = raw[at + 1]
            body, at = _unblocked(raw, at + 2)
            if label == 0xF9 and len(body) >= 4:
                f, delay, t = struct.unpack("<BHB", body[:4])
                transparent, disposal = (t if f & 1 else None), f >> 2 & 7
        elif kind == 0x2C:
            left, top, w, h, f = struct.unpack("<HHHHB", raw[at + 1 : at + 10])
            at, local = at + 10, None
            if f & 0x80:
                n = 3 << (f & 7) + 1
                local, at = np.frombuffer(raw[at : at + n], np.uint8).reshape(-1, 3), at + n
            bits = raw[at]
            if not 2 <= bits <= 8:
                raise ValueError(f"a code size of {bits}")
            code, at = _unblocked(raw, at + 1)
            got = unlzw(code, bits, w * h).reshape(h, w)
            if f & 0x40:
                order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
                rows = np.empty_like(got)
                rows[order] = got
                got = rows
            yield left, top, local, transparent, delay, disposal, got
            transparent, delay, disposal = None, 0, 0
        else:
            raise ValueError(f"block {kind:#x} is unknown")


def decode(raw: bytes) -> list[Frame]:
    """The frames as they are shown, each with its delay."""
    parts = images(raw)
    width, height, _, table = next(parts)
    canvas, frames = np.zeros((height, width, 4), np.uint8), []
    for left, top, local, transparent, delay, disposal, idx in parts:
        palette = local if local is not None else table
        if palette is None:
            raise ValueError("an image without a palette")
        wide = np.zeros((256, 4), np.uint8)
        wide[: len(palette), :3], wide[: len(palette), 3] = palette, 255
        before = canvas.copy() if disposal == 3 else None
        h, w = min(idx.shape[0], max(0, height - top)), min(idx.shape[1], max(0, width - left))
        part, at = idx[:h, :w], (slice(top, top + h), slice(left, left + w))
        new = wide[part]
        if transparent is not None:
            hole = part == transparent
            new[hole] = canvas[at][hole]
        canvas[at] = new
        frames.append(Frame(delay, disposal, canvas.copy(), idx))
        if disposal == 2:
            canvas[at] = 0
        elif disposal == 3:
            canvas = before
    return frames


def samples(raw: bytes) -> bytes:
    """The samples of all images, before palettes, in order."""
    parts = images(raw)
    next(parts)
    return b"".join(x[-1].tobytes() for x in parts)


def histogram(frames: list[Frame], bins: int = 4) -> np.ndarray:
    """Counts of visible pixels by colour, `bins` levels a channel, over all frames."""
    total = np.zeros(bins**3, np.int64)
    for f in frames:
        p = f.rgba.reshape(-1, 4)
        p = p[p[:, 3] > 0]
        level = (p[:, :3].astype(np.uint16) * bins) >> 8
        total += np.bincount(level[:, 0] * (bins * bins) + level[:, 1] * bins + level[:, 2], minlength=bins**3)
    return total


def features(frames: list[Frame], counts: np.ndarray) -> str:
    """frames, total delay, and the colours that occur with their counts, as text."""
    return f"frames={len(frames)};delay={sum(f.delay for f in frames)};rgb4=" + ",".join(f"{i}:{counts[i]}" for i in np.flatnonzero(counts))


# --- DataFrames ---

FRAMES = pa.list_(pa.struct([("index", pa.int32()), ("delay", pa.int32()), ("disposal", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("histogram", pa.list_(pa.int64()))]))
DIGEST = pa.struct([("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("frames", pa.int32()), ("delay", pa.int32()), ("histogram", pa.list_(pa.int64()))])


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(WIDTH, -(-len(raw) // WIDTH) * WIDTH)
    return len(raw), raw.ljust(n, b"\0")


@F.arrow_udf(T.BinaryType())
def stored(texts: pa.Array) -> pa.Array:
    """The text column's payloads as GIF files."""
    return pa.array([store(padded(t)[1]) for t in texts.to_pylist()], pa.binary())


@F.arrow_udf(spark_type(FRAMES))
def decoded(media: pa.Array) -> pa.Array:
    """Timed frames with colour histograms of a column of GIF files; null where a file is broken or null."""
    out = []
    for raw in media.to_pylist():
        try:
            got = None if raw is None else decode(raw)
        except (ValueError, IndexError, struct.error):
            got = None
        out.append(None if got is None else [{"index": i, "delay": f.delay, "disposal": f.disposal, "width": f.rgba.shape[1], "height": f.rgba.shape[0], "histogram": histogram([f]).tolist()} for i, f in enumerate(got)])
    return pa.array(out, FRAMES)


def digest(text: str | None) -> tuple:
    n, payload = padded(text)
    media = store(payload)
    shown = decode(media)
    back = b"".join(f.samples.tobytes() for f in shown)
    counts = histogram(shown)
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), features(shown, counts), len(shown), sum(f.delay for f in shown), counts.tolist()


@F.arrow_udf(spark_type(DIGEST))
def digests(texts: pa.Array) -> pa.Array:
    """Store each text, read the stored bytes back, and describe both; the files themselves aren't kept."""
    return struct_array([digest(t) for t in texts.to_pylist()], DIGEST)


def store_texts(spark: SparkSession, docs: DataFrame, into: str = "media") -> DataFrame:
    """docs with a column of GIF files that hold the texts."""
    arrow_sized(spark)
    return docs.withColumn(unused(docs, into), stored(F.col("text")))


def decode_media(spark: SparkSession, media: DataFrame, column: str = "media", into: str = "frames") -> DataFrame:
    arrow_sized(spark)
    return media.withColumn(unused(media, into), decoded(F.col(column)))


def media_digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    arrow_sized(spark)
    return docs.select("doc_id", digests(F.col("text")).alias("d")).select("doc_id", "d.*")
