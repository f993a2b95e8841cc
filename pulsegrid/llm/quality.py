"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio of trusted against raw text.

Byte n-grams are hashed to a fixed number of buckets. Raw-corpus counts come from every document; the trusted
multinomial from a bounded sample of labelled documents (TRUSTED_DOCS, the smallest hashes of their ids).
A document's score is the mean log-ratio of its n-grams; the verdict is a fixed threshold, the same for every
document and input.

Defined results: a null or empty text has no words, all counts zero, a score of zero, and fails the base rules.
Without any trusted document the two multinomials agree, so every score is zero and only base rules decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, only

BUCKETS, GRAM = 1 << 18, 4
#: Labelled documents that the trusted multinomial is fitted on, at most.
TRUSTED_DOCS = 20_000
#: Share of raw text mixed into the trusted multinomial; bounds a single n-gram's ratio below.
RAW_SHARE = 0.01
#: Mean log-ratio below which a document is rejected.
THRESHOLD = -0.5
#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"


def gram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket at every byte of the texts together, and the n-grams per text; a text's last GRAM - 1
    places, where no n-gram begins, have bucket -1."""
    data = [t.encode() for t in texts]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    raw = np.frombuffer(b"".join(data) + bytes(GRAM - 1), np.uint8).astype(np.uint32)
    n = len(raw) - GRAM + 1
    value = raw[:n].copy()
    for k in range(1, GRAM):
        value |= raw[k : n + k] << np.uint32(8 * k)
    buckets = ((value * np.uint32(2654435761)) >> np.uint32(32 - 18)).astype(np.int32)
    ends = np.cumsum(sizes)
    for k in range(1, GRAM):
        buckets[(ends - k)[sizes >= k]] = -1
    return buckets, sizes


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    data = text.encode()
    words = data.split()
    n = len(words)
    white = len(data) - sum(map(len, words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return n, len(text) - white, len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words that stand in a window which the text has at least twice."""
    n = len(words)
    if n <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, n)
    key = ids[: n - window + 1]
    for k in range(1, window):
        if (int(key.max()) + 1) * len(number) >= 1 << 62:  # renumber, so that products stay exact
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(number) + ids[k : n - window + 1 + k]
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    if not same.any():
        return 0
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(window):
        covered[k : len(key) + k] |= twice
    return int(covered.sum())


def trusted_ids(labels: DataFrame, limit: int = TRUSTED_DOCS) -> DataFrame:
    """At most limit ids of documents labelled good and not toxic; a bounded sample, fixed by hashes."""
    good = labels.filter("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def gram_counts(docs: DataFrame, trusted: DataFrame, text: str = "text") -> DataFrame:
    """(bucket, raw, trusted): n-gram counts of all documents and of the trusted ones; one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch, texts in chunks(batches, text):
            buckets, sizes = gram_buckets(texts)
            there = buckets >= 0
            raw += np.bincount(buckets[there], minlength=BUCKETS)
            chosen = np.repeat(batch.column("good").to_numpy(zero_copy_only=False).astype(bool), sizes) & there
            good += np.bincount(buckets[chosen], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(good[at])], names=["bucket", "raw", "trusted"])

    sample = F.broadcast(trusted.select("doc_id", F.lit(True).alias("good")))
    marked = only(docs, "doc_id", text).join(sample, "doc_id", "left").select(text, F.coalesce("good", F.lit(False)).alias("good"))
    found = marked.mapInArrow(run, "bucket int, raw long, trusted long")
    return found.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))


def ratios(counts: DataFrame) -> np.ndarray:
    """log(trusted / raw) of each bucket. counts has BUCKETS rows at most, whatever the input."""
    rows = counts.toPandas()
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[rows["bucket"]], good[rows["bucket"]] = rows["raw"], rows["trusted"]
    raw = (raw + 1) / (raw.sum() + BUCKETS)
    if not good.sum():
        return np.zeros(BUCKETS, np.float32)
    return np.log((1 - RAW_SHARE) * good / good.sum() / raw + RAW_SHARE).astype(np.float32)


def judge(docs: DataFrame, table: np.ndarray, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """(row, and the measures): row is a struct of the input's columns, so no name can clash."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = T.StructType([packed.schema["row"], *(T.StructField(c, T.LongType()) for c in longs), T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = np.append(shared.value, np.float32(0))  # bucket -1: nothing
        for batch, texts in chunks(batches, text):
            counts = np.array([base_counts(t) for t in texts], np.int64)
            failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
            buckets, sizes = gram_buckets(texts)
            sums = np.append(0, np.cumsum(ratio[buckets].astype(np.float64)))
            ends = np.cumsum(sizes)
            score = np.round((sums[ends] - sums[ends - sizes]) / np.maximum(sizes - GRAM + 1, 1), 6)
            columns = [batch.column("row"), *map(pa.array, counts.T), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return packed.mapInArrow(run, schema)


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The measures and the verdict of every document, beside its own columns in the struct row."""
    return judge(docs, ratios(gram_counts(docs, trusted_ids(labels))), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the rules keep, with their own columns only."""
    return quality_rules(docs, labels, threshold).filter("kept").select("row.*")
