"""Token ids in compressed binary files: canonical length-limited Huffman codes from global counts.

A file set is a folder with a code table (id, length) and blocks in ascending document order. A block holds the
ids of one document as a bit string of its own, with a bit offset at every STRIDE ids. Decoding is driven
by one table of 2 ** LIMIT entries: all strides of a batch advance together, one id a step.

Global starts come from the totals of the file's ordered parts, one row a part, never from a single task.

Defined results: a null text is an empty one and has the end id alone; rows that share a doc_id, or have none (these
come first), are all kept, in the order of a hash of their ids, and equal rows tie. An empty table gives files without rows.
Further columns are not looked at. A very long text is one block; its ids and codes are in one task, a few times its size.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, only, shared_dir, slices, written

LIMIT, STRIDE = 18, 256
#: White space apart from the space and the line feed.
RARE_WHITE = [chr(c) for c in range(0x3001) if chr(c).isspace() and c not in (0x0A, 0x20)]
_RARE = re.compile("[" + "".join(RARE_WHITE) + "]")
_RARE_ASCII = "".join(c for c in RARE_WHITE if c.isascii()).encode()
#: Bytes of text that one step encodes; larger than other operators', as equal words are then looked up once.
STEP_BYTES = 8_000_000


# ---------------------------------------------------------------- ids by the tokenizers library
class Cached:
    """Ids of texts by the tokenizers library. A piece of the library's pattern never runs across a space that
    stands between two other characters, so a text is cut at each such space, and each part is encoded once."""

    #: Parts kept at most, so a worker's memory is bounded: those that come first, as frequent ones do. The cache is emptied where it
    #: doesn't fit the texts any more, and half of a step's parts are missing.
    CACHE = 600_000
    #: Bytes of the longest part that is kept; longer ones hardly come again.
    LONG = 14

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)  # byte-level: a character is a byte
        for token, i in vocabulary.items():
            self.width[i] = len(token)
        self.kind = "<u2" if len(self.width) <= 1 << 16 else "<u4"
        self.after: dict[str, bytes] = {}  # ids of a part that a space stands before

    def encode(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, pa.Array]:
        """The number of ids of each text, and the ids as little-endian unsigned integers of self.kind."""
        split = [self._words(t) for t in texts]
        plain = np.array([isinstance(own, str) for own in split])
        lists = [pa.array([own for own in split if isinstance(own, str)], pa.string()), pa.array([own for own in split if not isinstance(own, str)], pa.list_(pa.string()))]
        lists = pa.concat_arrays([pc.split_pattern(lists[0], " "), lists[1]])
        order = np.argsort(np.argsort(~plain, kind="stable"), kind="stable")  # the place of each text in lists
        ends = lists.offsets.to_numpy()
        parts = lists.flatten().dictionary_encode()
        number, words = parts.indices.to_numpy().astype(np.int64), parts.dictionary
        behind = np.ones(len(number), bool)
        behind[ends[:-1]] = False
        used = np.zeros(len(words), bool)
        used[number[behind]] = True
        at = np.flatnonzero(used)
        found = self._after(words.to_numpy(zero_copy_only=False)[at].tolist(), pc.binary_length(words).to_numpy()[at], plain.all())
        firsts = parts.take(pa.array(ends[:-1])).dictionary_decode().to_pylist() if len(ends) > 1 else []
        found += [self._ids(e.ids) for e in self.tokenizer.encode_batch_fast(firsts, add_special_tokens=False)]
        found.append(b"" if end is None else np.array([end], self.kind).tobytes())
        place = np.cumsum(used) - 1  # of each word in found
        number = place[number] if len(place) else number
        number[ends[:-1]] = len(at) + np.arange(len(texts))
        number = np.insert(number, ends[1:], len(found) - 1)
        ends = ends + np.arange(len(ends))
        width = np.dtype(self.kind).itemsize
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // width
        starts = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(found), self.kind)
        own = sizes[number]
        total = np.append(0, np.cumsum(own))
        ids = flat[np.repeat(starts[number] - total[:-1], own) + np.arange(total[-1])]
        bounds = total[ends]
        lists = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((bounds * width).astype(np.int32)), pa.py_buffer(ids)])
        return np.diff(bounds)[order], lists.take(pa.array(order))

    def _ids(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _words(self, text: str) -> str | list[str]:
        """The text itself where it can be cut at every space; else its parts, without the space before each but the first."""
        if any(s in text for s in self.special):
            return [text]
        rare = len(data := text.encode()) != len(data.translate(None, _RARE_ASCII)) if text.isascii() else _RARE.search(text)
        if not (rare or "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] in (" ", "\n")):
            return text
        words = text.split(" ")
        out = [[words[0]]]
        for w, last in zip(words[1:], words):  # no cut beside white space
            if w and last and not w[0].isspace() and not last[-1].isspace():
                out.append([w])
            else:
                out[-1].append(w)
        return [" ".join(own) for own in out]

    def _after(self, words: list[str], sizes: np.ndarray, plain: bool) -> list[bytes]:
        """Ids of each part of so many bytes with a space before it; plain: no part ends with white space."""
        found = list(map(self.after.get, words))
        missing = [i for i, f in enumerate(found) if f is None]
        if len(self.after) > self.CACHE // 2 and len(missing) > len(words) // 2:
            self.after.clear()
        odd = [] if plain else [i for i in missing if not words[i] or words[i][-1].isspace()]
        if odd:
            out = set(odd)
            missing = [i for i in missing if i not in out]
            for i, e in zip(odd, self.tokenizer.encode_batch_fast([" " + words[i] for i in odd], add_special_tokens=False)):
                found[i] = self._ids(e.ids)
        groups = [missing[k : k + 500] for k in range(0, len(missing), 500)]
        texts = [" " + " ".join([words[i] for i in own]) for own in groups]
        width, new = np.dtype(self.kind).itemsize, []
        for own, coded in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            # several hundred parts are one text, cut again at the bytes where they end
            ids = np.array(coded.ids, self.kind)
            cuts = (width * (np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(sizes[own] + 1)) + 1)).tolist()
            raw, begin = ids.tobytes(), 0
            for i, stop in zip(own, cuts):
                found[i] = raw[begin:stop]
                begin = stop
            new += own
        short = np.array(new, np.int64)[sizes[new] <= self.LONG][: self.CACHE - len(self.after)]
        self.after.update((words[i], found[i]) for i in short.tolist())
        return found


@lru_cache(1)
def cached(path: str) -> Cached:
    return Cached(path)


def tokenize(docs: DataFrame, path: str, end: int | None = None, text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids as unsigned 16-bit integers where the vocabulary allows, else 32-bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, many, size = cached(path), [], [], 0

        def coded() -> pa.RecordBatch:
            sizes, ids = own.encode(many, end)
            return pa.RecordBatch.from_arrays([pa.concat_arrays(held), pa.array(sizes), ids], names=["doc_id", "n_tokens", "ids"])

        for batch, texts in chunks(batches, text):
            held.append(batch.column("doc_id"))
            many += texts
            size += sum(map(len, texts))
            if size > STEP_BYTES:
                yield coded()
                held, many, size = [], [], 0
        if held:
            yield coded()

    return only(docs, "doc_id", text).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def id_counts(tokens: DataFrame, kind: str, size: int) -> DataFrame:
    """(id, n) over all documents; a row an id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for part in slices(batches, "ids"):
            counts += np.bincount(np.frombuffer(b"".join(part.column("ids").to_pylist()), kind), minlength=size)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- codes
def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of no more than limit bits, by merging packages; zero for no count."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of more than {limit} bits")
    order = used[np.lexsort((used, counts[used]))]
    weight = counts[order].astype(np.float64)
    level, leaf = weight, [np.ones(len(weight), bool)]
    for _ in range(limit - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weight, packages])
        by = np.argsort(both, kind="stable")
        level = both[by]
        leaf.append(by < len(weight))
    take, found = 2 * len(weight) - 2, np.zeros(len(weight), np.int64)
    for own in reversed(leaf):
        leaves = int(own[:take].sum())
        found[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[order] = found
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: shorter codes first, then smaller ids."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.flatnonzero(lengths)
    order = order[np.lexsort((order, lengths[order]))]
    code, last = 0, 0
    sizes = lengths[order].tolist()
    out = []
    for n in sizes:
        code <<= n - last
        out.append(code)
        code, last = code + 1, n
    codes[order] = out
    return codes


def decode_table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """For every value of the next limit bits: the id, and how many bits it takes."""
    codes = canonical(lengths)
    order = np.flatnonzero(lengths)
    order = order[np.argsort(codes[order] << (np.uint64(limit) - lengths[order].astype(np.uint64)), kind="stable")]
    spans = 1 << (limit - lengths[order].astype(np.int64))
    ids, sizes = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.uint8)
    ids[: spans.sum()] = np.repeat(order, spans)
    sizes[: spans.sum()] = np.repeat(lengths[order], spans)
    return ids, sizes


def encode_blocks(blocks: list[np.ndarray], lengths: np.ndarray, codes: np.ndarray) -> list[tuple[int, bytes, bytes]]:
    """(bits, bit offset of every stride as 32-bit integers, payload) of each block; all blocks at once."""
    sizes = np.array([len(b) for b in blocks], np.int64)
    ids = np.concatenate(blocks).astype(np.int64)
    width = lengths[ids].astype(np.int64)
    total = np.append(0, np.cumsum(width))
    ends = np.cumsum(sizes)
    bits = total[ends] - total[ends - sizes]
    words = (bits + 63) // 64
    base = (np.cumsum(words) - words) * 64
    at = total[:-1] + np.repeat(base - total[ends - sizes], sizes)
    shift = 64 - (at & 63) - width
    code, word = codes[ids], at >> 6
    high = np.where(shift >= 0, code << np.maximum(shift, 0).astype(np.uint64), code >> np.maximum(-shift, 0).astype(np.uint64))
    out = np.zeros(int(words.sum()), np.uint64)
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, np.int64)
    if len(first):
        out[word[first]] = np.add.reduceat(high, first)
        over = np.flatnonzero(shift < 0)  # one code at most crosses into a word
        out[word[over] + 1] += code[over] << (64 + shift[over]).astype(np.uint64)
    raw = out.astype(">u8").tobytes()
    found = []
    for a, n, b, w, bit in zip((ends - sizes).tolist(), sizes.tolist(), base.tolist(), words.tolist(), bits.tolist()):
        offsets = (at[a : a + n : STRIDE] - b).astype("<u4").tobytes()
        found.append((bit, offsets, raw[b // 8 : b // 8 + (bit + 7) // 8]))
    return found


def decode_blocks(rows: list[tuple[int, bytes, bytes]], table: tuple[np.ndarray, np.ndarray], limit: int = LIMIT) -> list[np.ndarray]:
    """ids of blocks (n_ids, offsets, payload); every stride of every block is a lane."""
    of_bits, bits_of = table
    sizes = np.array([n for n, _, _ in rows], np.int64)
    lanes = -(-sizes // STRIDE)
    begins = np.cumsum([0, *(len(p) for _, _, p in rows)])[:-1]
    data = np.frombuffer(b"".join([p for _, _, p in rows]) + bytes(8), np.uint8)
    at = np.frombuffer(b"".join([o for _, o, _ in rows]), "<u4").astype(np.int64) + np.repeat(begins * 8, lanes)
    lane_of = np.repeat(np.arange(len(rows)), lanes)
    within = np.arange(len(at)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    left = np.minimum(STRIDE, sizes[lane_of] - within * STRIDE)
    order = np.argsort(-left, kind="stable")
    at, left_sorted = at[order], left[order]
    out = np.empty((STRIDE, len(at)), np.uint32)
    alive = np.searchsorted(-left_sorted, -np.arange(1, STRIDE + 1), side="right")
    wide = data.astype(np.uint32)
    four = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]
    for j in range(STRIDE):
        n = int(alive[j])
        if not n:
            break
        here = at[:n]
        value = (four[here >> 3] << (here & 7).astype(np.uint32)) >> np.uint32(32 - limit)
        out[j, :n] = of_bits[value]
        here += bits_of[value]
    whole = np.empty_like(out)
    whole[:, order] = out
    flat, start = whole.T.ravel(), np.cumsum(lanes) - lanes
    return [flat[a * STRIDE : a * STRIDE + n] for a, n in zip(start.tolist(), sizes.tolist())]


# ---------------------------------------------------------------- files
FILE_SCHEMA = "part int, doc_id long, local_start long, n_ids long, n_bits long, offsets binary, payload binary"


def write_tokens(tokens: DataFrame, lengths: np.ndarray, kind: str, folder: str) -> None:
    """Write a block a document, in ascending doc_id order from file to file, below folder, and the code table beside
    them. Files are ranges of (doc_id, a hash of the ids, the row's number), so that one doc_id on very many
    rows, or on none, spreads over files as well. tokens is a table that is read, not made anew."""
    spark = tokens.sparkSession
    shared = spark.sparkContext.broadcast((lengths, canonical(lengths)))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, codes = shared.value
        place, before = TaskContext.get().partitionId(), 0
        for part in slices(batches, "ids"):
            ids = [np.frombuffer(x, kind) for x in part.column("ids").to_pylist()]
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            rows = list(zip(*encode_blocks(ids, sizes, codes)))
            start = before + np.cumsum(n) - n
            before += int(n.sum())
            columns = [pa.array(np.full(len(ids), place, np.int32)), part.column("doc_id"), pa.array(start), pa.array(n), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in FILE_SCHEMA.split(", ")])

    order = ["doc_id", "h", "row"]
    keyed = tokens.select("doc_id", "ids", F.xxhash64("ids").alias("h"), F.monotonically_increasing_id().alias("row"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered.select("doc_id", "ids").mapInArrow(code, FILE_SCHEMA).write.option("compression", "none").parquet(f"{folder}/blocks")
    at = np.flatnonzero(lengths)
    spark.createDataFrame(list(zip(at.tolist(), lengths[at].tolist())), "id int, length int").coalesce(1).write.parquet(f"{folder}/codes")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_ids, ids): ids as unsigned 32-bit integers, start counted over all documents."""
    codes = spark.read.parquet(f"{folder}/codes").toPandas()  # a row an id of the vocabulary
    lengths = np.zeros(int(codes["id"].max()) + 1 if len(codes) else 1, np.uint8)
    lengths[codes["id"]] = codes["length"]
    shared = spark.sparkContext.broadcast(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(shared.value)
        for part in slices(batches, "payload"):
            rows = list(zip(*(part.column(c).to_pylist() for c in ("n_ids", "offsets", "payload"))))
            ids = [x.astype("<u4").tobytes() for x in decode_blocks(rows, table)]
            kept = ["part", "doc_id", "local_start", "n_ids"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(ids, pa.binary())], names=[*kept, "ids"])

    blocks = spark.read.schema(FILE_SCHEMA).parquet(f"{folder}/blocks")
    before, rows = 0, []
    for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():  # a row a part
        rows.append((r["part"], before))
        before += r["n"]
    bases = spark.createDataFrame(rows, "part int, base long")  # a row a file, at most the session's shuffle partitions
    found = blocks.mapInArrow(run, "part int, doc_id long, local_start long, n_ids long, ids binary")
    return found.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_ids", "ids")


def store(docs: DataFrame, path: str, end: int | None = None, folder: str | None = None) -> str:
    """Encode docs and write them in the file format; gives the folder."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    size, kind = max(len(cached(path).width), (end or 0) + 1), cached(path).kind
    tokens = written(tokenize(docs, path, end), "ids")
    counts = np.zeros(size, np.int64)
    rows = id_counts(tokens, kind, size).toPandas()  # a row an id of the vocabulary
    counts[rows["id"]] = rows["n"]
    write_tokens(tokens, code_lengths(counts), kind, folder)
    return folder
