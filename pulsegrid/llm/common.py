"""Small helpers of the training-data operators: tables, shared scratch space, batches of texts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one step of a vectorised kernel takes at once; bounds a task's memory.
CHUNK_CHARS = 500_000
#: Bytes of an Arrow batch that goes to a Python worker, or one row.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))  # long rows count by their bytes
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own; on a
    cluster executors would each write to their own disk, so it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.split("[")[0] == "local":
            raise RuntimeError(f"set spark.checkpoint.dir to a shared folder: the master is {master}")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def only(df: DataFrame, *needed: str) -> DataFrame:
    """The needed columns alone, so that further columns of any name can't clash with an operator's own."""
    return df.select(*[df[c] for c in needed])


def shuffled(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: never broadcast. Spark takes an exploded or compressed table for far smaller than it
    is, and would gather it in the driver."""
    return side.hint("merge")


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of record batches with their texts (null: empty), each of about limit bytes or one row. text names a
    column, or a field of the struct column "row". Only one slice's texts are Python objects at a time."""
    for batch in batches:
        column = batch.column(text) if text in batch.schema.names else batch.column("row").field(text)
        total = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            before = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, before + limit, side="right")))
            yield batch.slice(begin, end - begin), [t or "" for t in column.slice(begin, end - begin).to_pylist()]
            begin = end
    released()


#: A number for each byte, and which bytes are white space (ASCII).
_BYTES = np.random.default_rng(7).integers(0, 2**64, 256, np.uint64)
_WHITE = np.isin(np.arange(256), [0x20, *range(9, 14)])
_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse, as 64-bit integers."""
    both = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        own = np.full(n, base, np.uint64)
        own[:1] = 1
        both.append(np.multiply.accumulate(own))
    return both[0], both[1]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts, words of each text); words are cut at ASCII white space, A-Z lower-cased. A hash is a
    polynomial in the word's bytes, made for all words at once."""
    own = [t.encode().lower() for t in texts]
    data = np.frombuffer(b" ".join([b"", *own, b""]), np.uint8)
    bounds = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) if own else np.zeros(0, np.int64)
    edge = np.diff(_WHITE[data].view(np.int8))
    starts, ends = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    sizes = np.diff(np.searchsorted(starts, bounds), prepend=0)
    up, down = _powers(1 << max(20, len(data).bit_length()))
    total = np.append(np.uint64(0), np.cumsum(_BYTES[data] * up[: len(data)]))
    value = (total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    value = (value ^ value >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
    return value ^ value >> np.uint64(29), sizes


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    """malloc_trim of the C library, where it has one (glibc)."""
    return getattr(ctypes.CDLL(None), "malloc_trim", int)


def released() -> None:
    """Give a worker's free memory back before the next stage's workers need it: Arrow's, the tables of word_hashes, which are quickly
    made again, and what freed arrays leave in the C library. Spark keeps idle workers and takes them in turn, so all that a worker
    keeps counts as often as there are workers."""
    _powers.cache_clear()
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of record batches, each with about limit bytes in a binary or list column, or one row."""
    for batch in batches:
        own = batch.column(column)
        size = pc.list_value_length(own) if pa.types.is_list(own.type) else pc.binary_length(own)
        total = np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end
    released()


#: Bits of a filter over ids; its size is fixed, and a join checks what passes.
FILTER_BITS = 1 << 24


def filter_place(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))


def id_filter(ids: DataFrame, column: str = "doc_id") -> np.ndarray:
    """A bitmap of the ids' hashes as 64-bit integers: FILTER_BITS / 64 of them at most, whatever the input."""
    words = ids.select(filter_place(column).alias("h")).groupBy(F.expr("h div 64").alias("w"))
    rows = words.agg(F.bit_or(F.expr("shiftleft(1L, int(h % 64))")).alias("bits")).toPandas()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[rows["w"]] = rows["bits"]
    return bits


def compressed_texts(docs: DataFrame, ids: DataFrame, *further: str) -> DataFrame:
    """(doc_id, z) and further columns of docs: texts of the documents that ids names, and of a few others, each
    compressed. The bitmap spares the shuffle of a following join most of the other texts."""
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(ids))
    names = ["doc_id", *further, "z"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(3)
        for batch, texts in chunks(batches):
            h = batch.column("place_in_filter").to_numpy()
            hit = np.flatnonzero(shared.value[h >> 6] >> (h & 63) & 1)
            kept = [batch.column(c).take(pa.array(hit)) for c in names[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([packer.compress(texts[i].encode()) for i in hit], pa.binary())], names=names)

    rows = docs.filter("doc_id IS NOT NULL").select("doc_id", *further, "text", filter_place("doc_id").alias("place_in_filter"))
    schema = T.StructType([*rows.select("doc_id", *further).schema.fields, T.StructField("z", T.BinaryType())])
    return rows.mapInArrow(run, schema)
