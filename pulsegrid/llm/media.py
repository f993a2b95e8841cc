"""Media columns: telephony audio kept as WAV bytes, decoded to PCM with numpy and resampled.

mu-law and A-law samples expand by lookup tables. ADPCM blocks are independent, so one step decodes the next
sample of every block of a batch at once. The stored form is a complete WAV file in a binary column.

Defined results: null media, and bytes that are no such WAV file, decode to a null payload, null PCM and a null feature; a
payload that isn't whole ADPCM blocks is padded with zeros. A null or empty text is a payload of zeros. Each row is
coded by itself: repeated rows alike, also those without a doc_id, and an empty table gives none. Steps take some 500 KB of media or one
row, so a very long text costs memory in proportion to itself alone. Columns of the input named as an output are replaced.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import CHUNK_CHARS, chunks, only, shared_dir, slices

#: Format tags of WAV files (fixed values).
MULAW, ALAW, IMA_ADPCM = 7, 6, 17
RATE = 8000
#: Bytes of an ADPCM block: 4 of header, then two samples a byte.
BLOCK = 64
#: Fixed values of IMA ADPCM: the step sizes, and how far a code moves along them.
STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
    7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]
MOVES = [-1, -1, -1, -1, 2, 4, 6, 8]


@lru_cache(1)
def mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((code & 0x0F) << 3) + 0x84) << ((code & 0x70) >> 4)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


@lru_cache(1)
def alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = (code & 0x70) >> 4, (code & 0x0F) << 4
    size = np.where(exponent == 0, mantissa + 8, (mantissa + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


@lru_cache(1)
def adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """For every (step index, code): the change of the sample, and 16 times the next step index."""
    step, code = np.array(STEPS)[:, None], np.arange(16)[None, :]
    change = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
    change = np.where(code & 8, -change, change)
    after = np.clip(np.arange(89)[:, None] + np.array(MOVES)[code & 7], 0, 88)
    return change.ravel().astype(np.int32), (16 * after).ravel().astype(np.int32)


def adpcm_blocks(data: np.ndarray) -> np.ndarray:
    """Samples (blocks, 1 + 2 * (BLOCK - 4)) of whole blocks; the loop runs over samples, not blocks."""
    blocks = data.reshape(-1, BLOCK)
    change, after = adpcm_tables()
    sample = np.ascontiguousarray(blocks[:, :2]).view("<i2").ravel().astype(np.int32)
    place = 16 * np.minimum(blocks[:, 2].astype(np.int32), 88)
    body = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * (BLOCK - 4), len(blocks)), np.int16)
    out[0] = sample
    for i, column in enumerate(body):
        for k, code in enumerate((column & 15, column >> 4)):
            key = place + code
            sample = np.clip(sample + change[key], -32768, 32767)
            place = after[key]
            out[1 + 2 * i + k] = sample
    return out.T


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """PCM at another rate by linear interpolation, rounded to 16 bits."""
    if rate == to or not len(pcm):
        return pcm
    if to == 2 * rate:
        out = np.empty(2 * len(pcm), np.int16)
        out[::2] = pcm
        out[1:-1:2] = (pcm[:-1].astype(np.int32) + pcm[1:]) >> 1
        out[-1] = pcm[-1]
        return out
    at = np.arange(len(pcm) * to // rate) * (rate / to)
    return np.rint(np.interp(at, np.arange(len(pcm)), pcm)).astype(np.int16)


def wav(payload: bytes, tag: int = MULAW, rate: int = RATE) -> bytes:
    """A one-channel WAV file that holds the payload as it is."""
    if tag == IMA_ADPCM:
        payload += bytes(-len(payload) % BLOCK)
        form = struct.pack("<HHIIHHHH", tag, 1, rate, rate * BLOCK // (2 * BLOCK - 7), BLOCK, 4, 2, 2 * BLOCK - 7)
        count = len(payload) // BLOCK * (2 * BLOCK - 7)
    else:
        form = struct.pack("<HHIIHHH", tag, 1, rate, rate, 1, 8, 0)
        count = len(payload)
    parts = [(b"fmt ", form), (b"fact", struct.pack("<I", count)), (b"data", payload)]
    body = b"".join(k + struct.pack("<I", len(v)) + v + bytes(len(v) % 2) for k, v in parts)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def parse_wav(media: bytes) -> tuple[int, int, bytes] | None:
    """(format tag, rate, payload) of a WAV file, whatever other parts it has. None if it isn't one, has no samples or a
    format or rate unknown here; a payload that is cut off is what there is of it."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, tag, rate = 12, 0, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt " and at + 16 <= len(media):
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
        if name == b"data":
            return (tag, rate, media[at + 8 : at + 8 + size]) if tag in (MULAW, ALAW, IMA_ADPCM) and rate > 0 else None
        at += 8 + size + size % 2
    return None


def decoded(tag: int, payload: bytes) -> np.ndarray:
    data = np.frombuffer(payload, np.uint8)
    if tag == IMA_ADPCM:
        return adpcm_blocks(np.append(data, np.zeros(-len(data) % BLOCK, np.uint8))).ravel()
    return (mulaw_table() if tag == MULAW else alaw_table())[data]


def text_payload(text: str | None, unit: int = 64) -> tuple[int, bytes]:
    """Bytes of a text, with zeros up to a positive multiple of unit; and how many bytes the text had."""
    data = (text or "").encode()
    return len(data), data + bytes(unit - len(data) if len(data) < unit else -len(data) % unit)


def tag_of(payload: bytes) -> int:
    """The format by a checksum of the payload, so equal payloads are stored alike: mu-law and A-law, and one of 32 as
    ADPCM, whose PCM takes several times the room."""
    k = zlib.crc32(payload) % 32
    return IMA_ADPCM if k == 0 else ALAW if k < 12 else MULAW


def encode_media(df: DataFrame, text: str = "text", tag: int | None = None, rate: int = RATE) -> DataFrame:
    """(doc_id, n_bytes, media): each text's bytes as the samples of a WAV file, of the format tag or else that of tag_of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, text):
            rows = [text_payload(t) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([n for n, _ in rows], pa.int64()), pa.array([wav(p, tag or tag_of(p), rate) for _, p in rows], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return only(df, "doc_id", text).mapInArrow(run, "doc_id long, n_bytes long, media binary")


#: What a compact form has: its flags, samples, and values of the palette.
HEAD = struct.Struct("<BIH")
PALETTE, ODD = 1, 2


def compact(pcm: np.ndarray) -> bytes:
    """16-bit PCM without loss in less room: samples at even places, as numbers of a palette where they have 256 values at most,
    and what those at odd places differ from the middle of their neighbours, left out where nothing does."""
    even, odd = pcm[::2], pcm[1::2]
    differ = odd - middles(even)[: len(odd)]
    used = np.unique(even) if len(even) < 4096 else np.flatnonzero(np.bincount(even.view(np.uint16), minlength=1 << 16)).astype(np.uint16).view(np.int16)
    flags = (PALETTE if len(used) <= 256 else 0) | (ODD if differ.any() else 0)
    body = even.astype("<i2").view(np.uint8).reshape(-1, 2).T.tobytes()  # low bytes, then high ones
    if flags & PALETTE:
        place = np.zeros(1 << 16, np.uint8)
        place[used.view(np.uint16)] = np.arange(len(used))
        body = used.astype("<i2").tobytes() + place[even.view(np.uint16)].tobytes()
    return HEAD.pack(flags, len(pcm), len(used) if flags & PALETTE else 0) + body + (differ.astype("<i2").tobytes() if flags & ODD else b"")


def middles(even: np.ndarray) -> np.ndarray:
    """The middle of each sample and the next; the last one itself."""
    wide = even.astype(np.int32)
    return ((wide + np.append(wide[1:], wide[-1:])) >> 1).astype(np.int16)


def expanded(data: bytes) -> np.ndarray:
    """The PCM of a compact form."""
    flags, n, values = HEAD.unpack_from(data)
    at, size = HEAD.size, -(-n // 2)
    if flags & PALETTE:
        used = np.frombuffer(data, "<i2", values, at)
        even = used[np.frombuffer(data, np.uint8, size, at + 2 * values)]
        at += 2 * values + size
    else:
        even = np.ascontiguousarray(np.frombuffer(data, np.uint8, 2 * size, at).reshape(2, -1).T).view("<i2").ravel()
        at += 2 * size
    out = np.empty(n, np.int16)
    out[::2] = even
    out[1::2] = middles(even)[: n // 2] + (np.frombuffer(data, "<i2", n // 2, at) if flags & ODD else np.int16(0))
    return out


def decode_media(df: DataFrame, to: int = 16000, media: str = "media", packed: bool = False) -> DataFrame:
    """df with payload (the stored samples), format (the WAV file's tag), pcm (16-bit, little-endian, resampled to a rate; in its
    compact form if packed)."""
    added = [T.StructField("payload", T.BinaryType()), T.StructField("format", T.IntegerType()), T.StructField("pcm", T.BinaryType())]
    kept = [f for f in df.schema.fields if f.name not in {a.name for a in added}]
    schema = T.StructType([*kept, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, media):
            files = [None if m is None else parse_wav(m) for m in part.column(media).to_pylist()]
            form = compact if packed else lambda x: x.astype("<i2").tobytes()
            pcm = [f and form(resample(decoded(f[0], f[2]), f[1], to).astype(np.int16)) for f in files]
            columns = [pa.array([f and f[2] for f in files], pa.binary()), pa.array([f and f[0] for f in files], pa.int32()), pa.array(pcm, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *columns], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def stored(df: DataFrame, name: str = "media") -> DataFrame:
    """df with its media or PCM, written to the shared folder, well compressed, and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "9").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_features(df: DataFrame, pcm: str = "pcm", packed: bool = False) -> DataFrame:
    """df with feature instead of pcm: peak, root mean square and sign changes of the stored PCM, and its checksum. packed: the
    column has its compact form."""
    kept = [f for f in df.schema.fields if f.name not in (pcm, "feature")]
    schema = T.StructType([*kept, T.StructField("feature", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, pcm, CHUNK_CHARS if packed else 4 * CHUNK_CHARS):
            stored = part.column(pcm).to_pylist()
            made = feature_strings([x and expanded(x).astype("<i2").tobytes() for x in stored] if packed else stored)
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(made, pa.string())], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def feature_strings(pcm: list[bytes | None]) -> list[str | None]:
    out: list[str | None] = [None if p is None else "" for p in pcm]
    there = [i for i, p in enumerate(pcm) if p]
    if not there:
        return out
    samples = np.frombuffer(b"".join([pcm[i] for i in there]), "<i2")
    sizes = np.array([len(pcm[i]) // 2 for i in there], np.int64)
    starts = np.cumsum(sizes) - sizes
    wide, negative = samples.astype(np.int64), samples < 0
    change = np.append(False, negative[1:] != negative[:-1])
    change[starts] = False
    peak = np.maximum.reduceat(np.abs(wide), starts).tolist()
    rms = np.rint(np.sqrt(np.add.reduceat(wide * wide, starts) / sizes)).astype(np.int64).tolist()
    crossings = np.add.reduceat(change.astype(np.int64), starts).tolist()
    for k, i in enumerate(there):
        out[i] = f"peak={peak[k]};rms={rms[k]};zc={crossings[k]};pcm={zlib.crc32(pcm[i]):08x}"
    return out
