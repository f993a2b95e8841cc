"""Byte-level BPE over whole texts: boundaries by transition scans, cached pair merging, exact decoding.

Pre-tokenisation has no regex. Each code point becomes a symbol (its class and a look-ahead of two code
points); each symbol is a function from automaton state to state. These functions form a small monoid, so
the state before every position is a prefix product, found by a blocked associative scan. A table of state
and symbol then tells where a piece begins. Pieces go through a cache; those not in it are merged together,
round by round, by rank.

Decoding copies the bytes of all ids of a batch at once; by the retained offsets it gives where each piece ends in them.

Defined results: a null text is an empty one; an empty text has no ids and decodes to no bytes. Rows are coded one by one:
repeated rows alike, with or without a doc_id, and an empty table gives none. Of pairs of equal rank the leftmost merges first.
A very long text is coded in one step, in time n log n and memory some fifty times its size. Columns of the input named as an
output column are replaced.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, released, slices

# ---------------------------------------------------------------- classes, symbols, automaton
LETTER, NUMBER, OTHER, BLANK, WHITE, END = range(6)
#: Symbols: a letter, number or other; a space that joins what follows (3); white space inside a run; a last
#: white-space character that stands alone; an apostrophe before one or two letters of a suffix; a text's end.
S_LETTER, S_NUMBER, S_OTHER, S_TO_LETTER, S_TO_NUMBER, S_TO_OTHER, S_WHITE, S_ALONE, S_SUFFIX1, S_SUFFIX2, S_END = range(11)
FREE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_WHITE, LEFT1, LEFT2 = range(7)
#: The white space of the pattern, and the suffixes after an apostrophe.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SUFFIX1, SUFFIX2 = "stmd", ("re", "ve", "ll")


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The state after a symbol, and whether a piece begins with it."""
    if symbol == S_LETTER:
        if state in (LEFT1, LEFT2):
            return (FREE if state == LEFT1 else LEFT1), False
        return IN_LETTERS, state != IN_LETTERS
    if symbol in (S_NUMBER, S_OTHER):
        to = IN_NUMBERS if symbol == S_NUMBER else IN_OTHERS
        return to, state != to
    if symbol in (S_TO_LETTER, S_TO_NUMBER, S_TO_OTHER):
        return (IN_LETTERS, IN_NUMBERS, IN_OTHERS)[symbol - S_TO_LETTER], True
    if symbol == S_WHITE:
        return IN_WHITE, state != IN_WHITE
    if symbol in (S_SUFFIX1, S_SUFFIX2):
        return (IN_OTHERS, False) if state == IN_OTHERS else ((LEFT1 if symbol == S_SUFFIX1 else LEFT2), True)
    return FREE, True


@lru_cache(1)
def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For symbols: their elements of the monoid. Then its product table, the state that each element leads
    to from FREE, and the table of (state, symbol) that begin a piece."""
    functions = [tuple(_step(q, s)[0] for q in range(7)) for s in range(11)]
    elements = list(dict.fromkeys([tuple(range(7)), *functions]))
    index = {f: i for i, f in enumerate(elements)}
    for f in elements:
        for g in functions:
            h = tuple(g[q] for q in f)
            if h not in index:
                index[h] = len(elements)
                elements.append(h)
    product = np.array([[index[tuple(g[q] for q in f)] for g in elements] for f in elements], np.uint8)
    begins = np.array([[_step(q, s)[1] for s in range(11)] for q in range(7)])
    return np.array([index[f] for f in functions], np.uint8), product, np.array([f[FREE] for f in elements], np.uint8), begins


@lru_cache(1)
def _classes() -> np.ndarray:
    kinds = np.full(0x110001, OTHER, np.uint8)
    category = unicodedata.category
    for c in range(0x110000):
        k = category(chr(c))[0]
        if k == "L":
            kinds[c] = LETTER
        elif k == "N":
            kinds[c] = NUMBER
    kinds[WHITE_SPACE] = WHITE
    kinds[0x20], kinds[0x110000] = BLANK, END
    return kinds


def scan(elements: np.ndarray, product: np.ndarray, block: int = 64) -> np.ndarray:
    """Inclusive prefix products, all blocks at once; the blocks' totals are scanned the same way."""
    n, k = len(elements), len(product)
    flat = product.ravel()
    if n <= block:
        out = elements.copy()
        for i in range(1, n):
            out[i] = product[out[i - 1], out[i]]
        return out
    rows = -(-n // block)
    grid = np.zeros(rows * block, np.uint8)  # element 0 is the identity
    grid[:n] = elements
    grid = np.ascontiguousarray(grid.reshape(rows, block).T)
    for j in range(1, block):
        grid[j] = flat[grid[j - 1].astype(np.uint16) * k + grid[j]]
    before = np.zeros(rows, np.uint8)
    before[1:] = scan(grid[-1], product, block)[:-1]
    return flat[before.astype(np.uint16) * k + grid].T.ravel()[:n]


def symbols(points: np.ndarray) -> np.ndarray:
    """The symbol of every code point; a text ends with the code point 0x110000."""
    kind = _classes()[points]
    after = np.append(kind[1:], END)
    found = kind.copy()
    blank, white = kind == BLANK, kind == WHITE
    word = after <= OTHER
    found[blank & word] = S_TO_LETTER + after[blank & word]
    found[white & word] = S_ALONE
    found[(blank | white) & ~word] = S_WHITE
    found[kind == END] = S_END
    at = np.flatnonzero(points == ord("'"))
    if len(at):
        next1 = points[np.minimum(at + 1, len(points) - 1)]
        next2 = points[np.minimum(at + 2, len(points) - 1)]
        found[at[np.isin(next1, [ord(c) for c in SUFFIX1])]] = S_SUFFIX1
        for a, b in SUFFIX2:
            found[at[(next1 == ord(a)) & (next2 == ord(b))]] = S_SUFFIX2
    return found


def piece_bounds(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The texts' UTF-8 together, the byte at which each piece begins (and the end), and pieces per text."""
    text = "".join(texts)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ends = np.cumsum(lengths)
    points = np.insert(points, ends, 0x110000)
    found = symbols(points)
    of_symbol, product, lead, begins = _automaton()
    state = np.empty(len(found), np.uint8)
    state[:1] = FREE
    state[1:] = lead[scan(of_symbol[found], product)[:-1]]
    first = begins.ravel()[state * np.uint8(11) + found]
    stop = ends + np.arange(len(texts))
    first[stop] = False
    width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    width[stop] = 0
    at = np.cumsum(width) - width
    counts = np.add.reduceat(np.append(first, False).astype(np.int64), np.append(0, stop + 1)[:-1]) if len(texts) else np.zeros(0, np.int64)
    return text.encode(), np.append(at[first], width.sum()), counts


# ---------------------------------------------------------------- ranks and merging
class Ranks:
    """The vocabulary of a rank file, and the rank of every pair of its tokens that joins to a token."""

    #: Pieces kept in the cache; it is emptied at this size, so a worker's memory is bounded.
    CACHE = 100_000
    #: Longer pieces are merged one by one with a heap, in time n log n.
    LONG = 256

    def __init__(self, path: str):
        ranks = {}
        with open(path, "rb") as file:
            for line in file:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        sizes = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
        self.bytes_of = np.frombuffer(b"".join(self.tokens), np.uint8), np.cumsum(sizes) - sizes, sizes
        self.cache: dict[bytes, bytes] = {}

    def ids(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian 32-bit integers."""
        get = self.cache.get
        found = [get(p) for p in pieces]
        if None in found:
            missing = list({p for p, f in zip(pieces, found) if f is None})
            if len(self.cache) + len(missing) > self.CACHE:
                self.cache.clear()
                missing = list(set(pieces))
            self.cache.update(zip(missing, self._merged(missing)))
            found = [get(p) for p in pieces]
        return found

    def _merged(self, pieces: list[bytes]) -> list[bytes]:
        """All pieces at once: each round joins, in every piece, the pair of lowest rank wherever it stands."""
        out: list[bytes] = [b""] * len(pieces)
        short = []
        for i, p in enumerate(pieces):
            if len(p) > self.LONG:
                out[i] = self._merged_long(p)
            else:
                short.append(i)
        done_id, done_of = [], []
        joined = b"".join([pieces[i] for i in short])
        ids = self.of_byte[np.frombuffer(joined, np.uint8)]
        of = np.repeat(np.array(short, np.int64), [len(pieces[i]) for i in short])
        none = np.int64(1 << 40)
        while len(ids):
            rank = np.full(len(ids), none)
            key = ids[:-1] << 32 | ids[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank[:-1] = np.where((self.keys[at] == key) & (of[1:] == of[:-1]), self.values[at], none)
            start = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            least = np.minimum.reduceat(rank, start)
            size = np.diff(np.append(start, len(ids)))
            over = np.repeat(least == none, size)
            done_id.append(ids[over])
            done_of.append(of[over])
            hit = np.flatnonzero((rank == np.repeat(least, size)) & ~over)
            if len(hit):  # of overlapping places, as in "aaa", every second one counts
                run = np.append(True, np.diff(hit) > 1)
                place = np.arange(len(hit))
                hit = hit[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0]
            ids[hit] = rank[hit]
            stay = ~over
            stay[hit + 1] = False
            ids, of = ids[stay], of[stay]
        if done_id:
            of, ids = np.concatenate(done_of), np.concatenate(done_id)
            order = np.argsort(of, kind="stable")
            of, ids = of[order], ids[order].astype("<u4")
            raw = ids.tobytes()
            start = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else []
            for a, b, i in zip(start, np.append(start, len(of))[1:], of[start].tolist() if len(of) else []):
                out[i] = raw[4 * a : 4 * b]
        return out

    def _rank(self, a: int, b: int) -> int | None:
        key = a << 32 | b
        at = int(self.keys.searchsorted(key))
        return int(self.values[at]) if at < len(self.keys) and self.keys[at] == key else None

    def _merged_long(self, piece: bytes) -> bytes:
        ids = self.of_byte[np.frombuffer(piece, np.uint8)].tolist()
        n, rank_of = len(ids), self._rank
        right, left, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank_of(ids[i], ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], right[i] = rank, False, right[j]
            if right[i] >= 0:
                left[right[i]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (r := rank_of(ids[x], ids[y])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return np.array([x for x, a in zip(ids, alive) if a], "<u4").tobytes()


@lru_cache(4)
def ranks(path: str) -> Ranks:
    return Ranks(path)


def encode_texts(texts: list[str], vocabulary: Ranks) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its ids and, for each of its pieces, the number of ids up to the piece's end."""
    data, at, counts = piece_bounds(texts)
    bounds = at.tolist()
    found = vocabulary.ids([data[a:b] for a, b in zip(bounds, bounds[1:])])
    begin = 0
    for n in counts.tolist():
        own = found[begin : begin + n]
        begin += n
        yield np.frombuffer(b"".join(own), "<u4"), np.cumsum(np.fromiter(map(len, own), np.int64, n)) // 4


def decode_ids(ids: np.ndarray, vocabulary: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids one after the other, and the byte at which each id ends."""
    flat, starts, sizes = vocabulary.bytes_of
    size = sizes[ids]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts[ids] - (ends - size), size) + np.arange(total)], ends


def decode_rows(rows: list[tuple[np.ndarray, np.ndarray]], vocabulary: Ranks) -> tuple[pa.Array, pa.Array]:
    """For (ids, piece ends) of each text: its bytes, and the byte at which each of its pieces ends, by the offsets retained."""
    sizes = np.cumsum([0, *(len(ids) for ids, _ in rows)])
    data, ends = decode_ids(np.concatenate([ids for ids, _ in rows]).astype(np.int64), vocabulary)
    ends = np.append(0, ends)
    bounds = ends[sizes]
    decoded = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])
    counts = np.cumsum([0, *(len(e) for _, e in rows)])
    own = np.concatenate([e.astype(np.int64) for _, e in rows])
    shift = np.diff(counts)
    spans = ends[own + np.repeat(sizes[:-1], shift)] - np.repeat(bounds[:-1], shift)
    return decoded, pa.ListArray.from_arrays(pa.array(counts.astype(np.int32)), pa.array(spans.astype(np.int32)))


# ---------------------------------------------------------------- DataFrame operators
def encode(df: DataFrame, path: str, text: str = "text", offsets: bool = True, decoded: bool = False) -> DataFrame:
    """df with ids (array of int), n_tokens and, with offsets, piece_ends: ids up to the end of each piece. With decoded,
    the ids are decoded again in the same pass, to the columns of decode, and text goes."""
    added = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType())}
    added |= {"piece_ends": T.ArrayType(T.IntegerType())} if offsets else {}
    added |= {"decoded": T.BinaryType(), "piece_bytes": T.ArrayType(T.IntegerType())} if decoded else {}
    kept = [f for f in df.schema.fields if f.name not in added and not (decoded and f.name == text)]
    schema = T.StructType([*kept, *(T.StructField(k, v) for k, v in added.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = ranks(path)
        for batch, texts in chunks(batches, text):
            rows = list(encode_texts(texts, vocabulary))
            columns = [batch.column(f.name) for f in kept]
            columns.append(pa.array([len(r) for r, _ in rows], pa.int64()))
            for k in range(1 + offsets):
                flat = np.concatenate([r[k] for r in rows]).astype(np.int32)
                ends = np.cumsum([0, *(len(r[k]) for r in rows)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
            if decoded:
                columns += decode_rows(rows, vocabulary)
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])
        vocabulary.cache.clear()
        released()

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", ends: str = "piece_ends", out: str = "decoded") -> DataFrame:
    """df with the bytes that its ids stand for, and piece_bytes: where each piece ends in them. Null ids give no bytes."""
    kept = [f for f in df.schema.fields if f.name not in (out, "piece_bytes")]
    schema = T.StructType([*kept, T.StructField(out, T.BinaryType()), T.StructField("piece_bytes", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = ranks(path)
        for batch in slices(batches, ids):
            rows = [tuple(np.array([] if x is None else x, np.int64) for x in r) for r in zip(batch.column(ids).to_numpy(zero_copy_only=False), batch.column(ends).to_numpy(zero_copy_only=False))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *decode_rows(rows, vocabulary)], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def digests(df: DataFrame) -> DataFrame:
    """doc_id, n_tokens, the two digests of encoded and decoded documents, and the number of their pieces."""
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    pieces = F.size("piece_bytes").cast("long").alias("n_pieces")
    return df.select("doc_id", "n_tokens", F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), pieces)
