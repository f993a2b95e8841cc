"""Periodic runs of words: every maximal stretch in which words repeat with a period, and texts with the repeats cut.

Dictionary of basic factors: the factors of each power-of-two length get a number, made from the numbers of their two
halves. Where a factor's next occurrence begins no farther than its length on, that distance is the smallest period of
both together, and each further word with the same distance goes on with the same arithmetic progression; so a stretch of
equal distances d is one maximal run of period d, and extends by d and the factor's length beyond the stretch. Distances
above half the length are taken at this length, shorter ones were at the half, so no run is found twice.

A factor with no like within a quarter of its text has no part in a run of four periods, nor has any longer factor with
it as a half; places of such factors leave the work for good, so that common prose is done after a few lengths.

Defined results: a null or empty text has no words and no runs, and its digests are those of the empty string. A row
without a doc_id is never rewritten. Rows that share a doc_id are each taken by themselves, as are texts of any length.
Only doc_id and text are looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import from_arrow_schema

from .common import chunks

#: A run has so many words, and so many periods, at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4


def grouped(key: np.ndarray, at: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places whose key's next or last place is within their reach, in order, numbers of their keys, and the distance to
    the next place (0: none within reach). at ascends."""
    order = np.argsort(key, kind="stable")
    number, gap = np.empty(len(key), np.int64), np.zeros(len(key), np.int64)
    same = key[order[1:]] == key[order[:-1]]
    number[order] = np.concatenate([[0], np.cumsum(~same)])
    far = at[order[1:]] - at[order[:-1]]
    near = same & (far <= reach[at[order[:-1]]])
    gap[order[:-1][near]] = far[near]
    kept = np.zeros(len(key), bool)
    kept[order[1:][near]] = kept[order[:-1][near]] = True
    return at[kept], number[kept], gap[kept]


def runs(words: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs in an array of word numbers; between texts stands a number of its own. reach
    is the longest period that fits the text of each place."""
    found = [np.empty((0, 3), np.int64)]
    size, key, at = 1, words.astype(np.int64), np.arange(len(words))
    while len(at) > 1:
        at, number, gap = grouped(key, at, reach)
        near = np.flatnonzero((gap > size // 2) & (gap <= size))
        if len(near):
            breaks = np.flatnonzero((np.diff(at[near]) != 1) | (np.diff(gap[near]) != 0)) + 1
            first, last = near[np.concatenate([[0], breaks])], near[np.concatenate([breaks - 1, [len(near) - 1]])]
            period = gap[first]
            length = at[last] - at[first] + period + size
            long = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
            found.append(np.stack([at[first], length, period], axis=1)[long])
        there = np.searchsorted(at, at + size)
        there[there == len(at)] = 0
        both = at[there] == at + size
        key = number[both] * (int(number.max(initial=0)) + 1) + number[there[both]]
        at, size = at[both], 2 * size
    rows = np.concatenate(found)
    return rows[np.lexsort([rows[:, 2], rows[:, 0]])]


def words_of(text: str, doc_id: int | None, rewrite: bool) -> list[bytes]:
    """The words of a text; with rewrite, those of one document in ten repeat with a period from some word on."""
    words = text.encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if rewrite and n and doc_id is not None and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        cycle = words[a : a + p]
        words[a:] = (cycle * -(-(n - a) // p))[: n - a]
    return words


def runs_of_texts(texts: list[list[bytes]]) -> list[np.ndarray]:
    """The runs of each list of words."""
    number: dict[bytes, int] = {}
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes + 1)
    ids = np.empty(int(ends[-1]) if len(texts) else 0, np.int64)
    begins = ends - sizes - 1
    for begin, n, words in zip(begins, sizes, texts):
        ids[begin : begin + n] = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    ids[ends - 1] = len(number) + np.arange(len(texts))
    found = runs(ids, np.repeat(sizes // LEAST_PERIODS, sizes + 1))
    cut = np.searchsorted(found[:, 0], np.append(begins, len(ids)))
    return [found[a:b] - [begin, 0, 0] for a, b, begin in zip(cut, cut[1:], begins)]


def kept_words(words: list[bytes], found: np.ndarray) -> list[bytes]:
    """The words that stand in no run after its first period."""
    if not len(found):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def strongest(found: np.ndarray) -> list[int] | None:
    """The run of the greatest exponent; ties: smallest start, then period."""
    return max(found.tolist(), key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


PART = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
SHAPE = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(PART)), ("best", PART), ("runs_sha256", pa.string()), ("collapsed", pa.string()), ("collapsed_sha256", pa.string())])


def collapse_runs(docs: DataFrame, rewrite: bool = False, texts: bool = True) -> DataFrame:
    """(doc_id, n_words, runs, best, runs_sha256, collapsed, collapsed_sha256) of every row. runs ascend by start, then period;
    best has the greatest exponent; collapsed is the text of the words kept, one blank apart, or null without texts.
    rewrite plants a periodic tail in one document in ten, by the checksum of its id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, whole in chunks(batches):
            ids = batch.column("doc_id").to_pylist()
            split = [words_of(t, i, rewrite) for t, i in zip(whole, ids)]
            rows = []
            for doc_id, words, found in zip(ids, split, runs_of_texts(split)):
                each = found.tolist()
                left = b" ".join(kept_words(words, found))
                best = strongest(found)
                listed = "".join(f"{s},{n},{p}\n" for s, n, p in each).encode()
                as_row = lambda r: dict(zip(("start", "length", "period"), r))
                rows.append((doc_id, len(words), [as_row(r) for r in each], best and as_row(best), hashlib.sha256(listed).hexdigest(), left.decode() if texts else None, hashlib.sha256(left).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), SHAPE)], schema=SHAPE)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, from_arrow_schema(SHAPE))
