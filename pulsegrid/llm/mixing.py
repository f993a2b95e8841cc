"""Soft-membership mixing: rates of documents whose expected domain token totals meet targets.

Labels define domains (toxic, low, clean). A softmax classifier over counts of hashed words and bytes is fitted on a bounded sample of
labelled documents (PER_DOMAIN of each domain, by the smallest hashes of their ids) and gives every document its
domain posteriors. Document rates w >= 0 then minimise the squared distance between the expected totals
sum_i w_i n_i p_id and the targets, each in shares of the domain's own total, by accelerated projected gradient from w = 1, scaled by 1 / n_i per document; the
largest eigenvalue of sum_i n_i p_i p_i' bounds the step. A step is one distributed sum over all documents; rates are
the fold of the steps so far, so only D numbers a step are sent.

Copies are the rate rounded down, and one more where a hash of doc_id and text, as a share in [0, 1), is below the
rest: expected totals of the rows returned are those of the rates, and the same document always has the same copies.

Defined results: a null or empty text has no tokens and the posteriors of the intercept alone. With fewer than two
labelled domains every posterior is that of the first domain found, and targets can still be met by one rate. Without any
labelled document there are no domains, and all rates are 1; an empty table stays empty. Of a document with several labels the
worst counts (toxic, then low). Rows that share a doc_id are rated by their own texts, and repeated rows alike; a null doc_id
is never labelled. Rates of equal documents tie, and so do their copies. Further columns of any name are kept in
apply_mix and not looked at.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, only, released, written

DOMAINS = ("clean", "low", "toxic")
#: Labelled documents of each domain that the classifier is fitted on, at most.
PER_DOMAIN = 1_500
#: Documents of the sample that a word or run must be in to have a weight.
LEAST_DOCS = 10
#: Entries of the sample's matrix that a step of the fit takes at once; bounds the driver's memory.
BLOCK = 1 << 17
WORDS = 1 << 17
BUCKETS = WORDS + (1 << 16)
#: The last row of the weights but one: a bucket without weight.
NOTHING = BUCKETS + 1
#: A text's sums are divided by this power of its number of features.
POWER = 0.75
#: Target totals as multiples of what the documents hold. Clearly toxic documents hold nine tenths of the toxic mass; the rest is a
#: little in very many clean ones, which a lower target would thin out.
TARGETS = {"clean": 1.0, "low": 0.75, "toxic": 0.1}
#: A rate this near a whole number is that number, so that clean documents at about 1 stay whole.
NEAR = 0.01
#: Word bytes of the classifier lower-cased (others become a space), and ASCII white space.
_WORD = np.array([b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0 for b in range(256)], np.uint8)
_WHITE = np.isin(np.arange(256), [0x20, *range(9, 14)])
#: Powers of an odd number, for a word's key; words repeat them after so many bytes.
_POWERS = np.cumprod(np.append(np.uint64(1), np.full(63, 0x9E3779B97F4A7C15, np.uint64)))


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words (A-Z lower-cased) of all texts one after the other, and where each text's begin and end; the
    bucket of the run of three bytes at every byte, NOTHING where it leaves its text; where each text begins and ends
    there; and each text's number of words between white space. Repeats count."""
    data = [t.encode() for t in texts]
    bounds = np.cumsum([0, *(len(d) + 1 for d in data)])
    raw = np.frombuffer(b"".join([d + b" " for d in data]) + b"  ", np.uint8)  # a space ends each text
    inside = ~_WHITE[raw]
    tokens = np.diff(np.searchsorted(np.flatnonzero(inside & ~np.append(False, inside[:-1])), bounds))
    low = _WORD[raw]
    starts = np.flatnonzero((low > 0) & ~np.append(False, low[:-1] > 0))
    words = np.zeros(0, np.int64)
    if len(starts):
        low = low[starts[0] :]
        own = (starts - starts[0]).astype(np.int32)
        part = np.arange(len(low), dtype=np.int32) - np.repeat(own, np.diff(np.append(own, np.int32(len(low)))))
        key = np.add.reduceat(low * _POWERS[part & 63], own)
        words = ((key ^ key >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - 17)).astype(np.int64)
    wide = raw.astype(np.uint32)
    runs = (((wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16)) * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64) + WORDS
    last = bounds[1:]
    runs[last - 1] = runs[np.maximum(last - 2, 0)] = NOTHING
    return words, np.searchsorted(starts, bounds), runs, bounds, tokens


def counted(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct buckets and how often it has each."""
    words, word_at, runs, run_at, _ = features(texts)
    out = []
    for i in range(len(texts)):
        own = np.append(words[word_at[i] : word_at[i + 1]], runs[run_at[i] : run_at[i + 1]])
        out.append(np.unique(own[own != NOTHING].astype(np.int32), return_counts=True))
    return out


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain): the number of each labelled document's domain; toxic goes before low."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
    named = labels.select("doc_id", domain.alias("domain")).filter("domain IS NOT NULL AND doc_id IS NOT NULL")
    return named.groupBy("doc_id").agg(F.max("domain").alias("domain"))


def shares(labels: DataFrame) -> np.ndarray:
    """Each domain's share of all labels."""
    out = np.zeros(len(DOMAINS))
    for r in domains_of(labels).groupBy("domain").agg(F.count("*").alias("n")).collect():  # a row a domain
        out[r["domain"]] = r["n"]
    return out / max(out.sum(), 1)


def labelled_sample(docs: DataFrame, labels: DataFrame, per_domain: int = PER_DOMAIN, text: str = "text") -> list[tuple[int, np.ndarray]]:
    """(domain, distinct buckets and their counts) of at most per_domain documents of each domain. Of rows that share a doc_id, the one
    of smallest text hash counts, so the sample is bounded whatever repeats."""
    named = domains_of(labels)
    parts = [named.filter(F.col("domain") == d).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_domain) for d in range(len(DOMAINS))]
    chosen = only(docs, "doc_id", text).join(F.broadcast(reduce(DataFrame.union, parts)), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, text):
            rows = [np.stack([own, n]).astype(np.int32).tobytes() for own, n in counted(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("domain"), pa.array(rows, pa.binary())], names=["doc_id", "domain", "words"])

    found = chosen.mapInArrow(run, "doc_id long, domain int, words binary")
    one = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("words").alias("h"), "domain", "words")).alias("r"))
    rows = one.select("doc_id", "r.domain", "r.words").orderBy("doc_id").collect()  # the bounded sample
    return [(r["domain"], np.frombuffer(r["words"], np.int32).reshape(2, -1)) for r in rows]


def cut_up(ends: np.ndarray, place: np.ndarray, value: np.ndarray) -> list[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of whole documents, of about BLOCK entries each: the documents, where each begins, and views of their columns and values."""
    begins = np.append(0, ends[:-1])
    first = np.flatnonzero(np.diff(begins // BLOCK, prepend=-1))
    rows = [slice(a, b) for a, b in zip(first, [*first[1:], len(ends)])]
    spans = [slice(begins[r.start], ends[r.stop - 1]) for r in rows]
    return [(r, begins[r] - own.start, place[own], value[own]) for r, own in zip(rows, spans)]


def slopes(blocks: list[tuple[slice, np.ndarray, np.ndarray, np.ndarray]], point: np.ndarray, of: Callable[[slice, np.ndarray], np.ndarray]) -> np.ndarray:
    """The transposed matrix times what "of" makes of its product with the point; beside the matrix, only one block's products are in memory."""
    out = np.zeros_like(point)
    for rows, begins, at, v in blocks:
        z = np.stack([np.add.reduceat(v * point[at, d], begins) for d in range(point.shape[1])], axis=1)
        found = np.repeat(of(rows, z), np.diff(np.append(begins, len(v))), axis=0)
        for d in range(point.shape[1]):
            out[:, d] += np.bincount(at, v * found[:, d], len(out))
    return out


def fit(sample: Sequence[tuple[int, np.ndarray]], share: np.ndarray | None = None, steps: int = 60, decay: float = 1e-5) -> np.ndarray:
    """Weights (BUCKETS + 3, domains) of a softmax model, by accelerated gradient steps over columns
    of like size. The driver holds the sample and one matrix of it, 12 bytes an entry. Domains weigh alike in the fit; the row BUCKETS is the intercept, the row NOTHING is zero, and the last row the
    logarithms of the domains' shares, by which posteriors follow the labels' own mix."""
    weights = np.zeros((BUCKETS + 3, len(DOMAINS)))
    if share is not None and share.any():
        weights[-1] = np.log(np.maximum(share, 1e-6))
    present = sorted({d for d, _ in sample})
    absent = [d for d in range(len(DOMAINS)) if d not in present]
    if present:
        weights[-1, absent] = -50.0
    if len(present) < 2:
        return weights.astype(np.float32)
    y = np.array([d for d, _ in sample])
    docs = np.zeros(BUCKETS, np.int32)
    for _, x in sample:
        docs[x[0]] += 1
    often = docs >= min(LEAST_DOCS, len(y) // 4)
    used = np.append(np.flatnonzero(often & (docs > 0)), BUCKETS)
    n = len(used)
    column = np.zeros(BUCKETS, np.int32)
    column[used[:-1]] = np.arange(n - 1)
    total = np.array([x[1].sum() + 1.0 for _, x in sample]) ** POWER
    ends = np.cumsum([np.count_nonzero(often[x[0]]) + 1 for _, x in sample])
    place, value = np.full(ends[-1], n - 1, np.int32), np.empty(ends[-1])
    for (_, x), all_of_it, begin, end in zip(sample, total, np.append(0, ends), ends):  # the intercept is a document's last
        kept = often[x[0]]
        place[begin : end - 1] = column[x[0][kept]]
        value[begin:end] = np.append(x[1][kept], 1) / all_of_it
    blocks = cut_up(ends, place, value)
    size = np.sqrt(sum(np.bincount(at, v * v, n) for _, _, at, v in blocks) / len(y))
    scale = np.where(used == BUCKETS, 1.0, 1 / (size + 0.3 * np.median(size)))
    for _, _, at, v in blocks:
        v *= scale[at]
    alike = (1 / np.bincount(y, minlength=len(DOMAINS))[y].astype(float) / len(present))[:, None]
    way = np.random.default_rng(0).normal(size=(n, 1))
    for _ in range(15):  # the largest curvature, by repeated products
        way = slopes(blocks, way, lambda rows, z: alike[rows] * z)
        largest = float(np.linalg.norm(way))
        way /= largest

    def missed(rows: slice, z: np.ndarray) -> np.ndarray:
        z[:, absent] = -50.0
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(p)), y[rows]] -= 1
        return p * alike[rows]

    own = ahead = np.zeros((n, len(DOMAINS)))
    t = 1.0
    for _ in range(steps):
        slope = slopes(blocks, ahead, missed) + decay * ahead
        last, own = own, ahead - slope / (0.5 * largest + decay)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead = own + (before - 1) / t * (own - last)
    own = own * scale[:, None]
    weights[used] = own
    return weights.astype(np.float32)


def model(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, bool]:
    """Weights, and whether any document is labelled. The driver gives the sample's memory back before the work goes on."""
    sample = labelled_sample(docs, labels)
    weights, any_labelled = fit(sample, shares(labels)), bool(sample)
    del sample
    released()
    return weights, any_labelled


def posteriors(texts: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Domain posteriors and tokens of each text."""
    words, word_at, runs, run_at, tokens = features(texts)
    sizes = np.diff(word_at) + np.maximum(np.diff(run_at) - 2, 0)
    out = np.zeros((len(texts), weights.shape[1]))
    for found, at in ((words, word_at), (runs, run_at)):
        there = np.diff(at) > 0
        for d in range(weights.shape[1]) if there.any() else ():
            column = np.ascontiguousarray(weights[:, d])
            out[there, d] += np.add.reduceat(column[found[: at[-1]]], at[:-1][there], dtype=np.float64)
    out = (out + weights[BUCKETS]) / ((sizes + 1.0) ** POWER)[:, None] + weights[-1]
    out = np.exp(out - out.max(axis=1, keepdims=True))
    return np.round(out / out.sum(axis=1, keepdims=True), 6), tokens


def memberships(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """(row, n_tokens, p, share): row is a struct of the input's columns; tokens are words between white space; share
    is a hash of doc_id and text in [0, 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    schema = T.StructType([packed.schema["row"], T.StructField("n_tokens", T.LongType()), T.StructField("p", T.ArrayType(T.DoubleType())), T.StructField("share", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, text):
            p, tokens = posteriors(texts, shared.value)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
            ids = batch.column("row").field("doc_id").to_pylist()
            share = [(xxhash.xxh64_intdigest(b"%d " % (i or 0) + t.encode(), 42) >> 11) / 2**53 for i, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(tokens.astype(np.int64)), lists, pa.array(share, pa.float64())], names=["row", "n_tokens", "p", "share"])

    return packed.mapInArrow(run, schema)


def rates(p: np.ndarray, steps: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The rate of each document after the steps, projected to w >= 0 each time, and the point, moved on by the
    last change, at which the next gradient is taken."""
    w = ahead = np.ones(len(p))
    t = 1.0
    for g in steps:
        last, w = w, np.maximum(0.0, ahead - p @ g)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead = w + (before - 1) / t * (w - last)
    return w, ahead


def fit_rates(members: DataFrame, targets: Mapping[str, float] = TARGETS, rounds: int = 60, tolerance: float = 5e-3) -> tuple[list[np.ndarray], dict[str, list[float]]]:
    """The steps in domain space, and the natural, target and reached totals of the domains."""
    domains = len(DOMAINS)

    def totals(steps: list[np.ndarray]) -> np.ndarray:
        """Expected totals at the rates, at the point ahead, and the matrix that bounds the gradient's slope."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(2 * domains + domains * domains)
            for batch in batches:
                p = batch.column("p").values.to_numpy().reshape(-1, domains)
                n = batch.column("n_tokens").to_numpy().astype(float)
                w, ahead = rates(p, steps)
                out += np.concatenate([(n * w) @ p, (n * ahead) @ p, (p.T @ (p * n[:, None])).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out)], names=["k", "x"])

        out = np.zeros(2 * domains + domains * domains)
        for r in members.select("n_tokens", "p").mapInArrow(run, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect():  # a row a number
            out[r["k"]] = r["x"]
        return out

    steps: list[np.ndarray] = []
    sums = totals(steps)
    natural = sums[:domains]
    target = natural * np.array([targets.get(d, 1.0) for d in DOMAINS])
    size = np.maximum(natural, 1.0)  # distances count in shares of a domain's own total
    bound = max(float(np.linalg.eigvalsh(sums[2 * domains :].reshape(domains, domains) / np.outer(size, size)).max()), 1e-9 / size.max())
    for _ in range(rounds):
        last = sums[:domains]
        steps.append((sums[domains : 2 * domains] - target) / size / size / bound)
        sums = totals(steps)
        if np.abs((sums[:domains] - target) / size).max() <= tolerance or np.abs((sums[:domains] - last) / size).max() <= tolerance / 100:
            break
    else:
        warnings.warn(f"rates not settled after {rounds} rounds: {sums[:domains]} for {target}", stacklevel=2)
    return steps, {"natural": natural.tolist(), "target": target.tolist(), "reached": sums[:domains].tolist()}


def with_rate(members: DataFrame, steps: Sequence[np.ndarray]) -> DataFrame:
    """members with rate and copies: the rate rounded down, or up for as large a share of documents as its fraction."""
    schema = T.StructType([*members.schema.fields, T.StructField("rate", T.DoubleType()), T.StructField("copies", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = np.round(rates(batch.column("p").values.to_numpy().reshape(-1, len(DOMAINS)), steps)[0], 6)
            whole = np.floor(w + NEAR)
            rest = np.where(w - whole <= NEAR, 0.0, w - whole)
            copies = (whole + (batch.column("share").to_numpy() < rest)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(w), pa.array(copies)], names=[*batch.schema.names, "rate", "copies"])

    return members.mapInArrow(run, schema)


def mix(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS) -> DataFrame:
    """(doc_id, n_tokens, p, rate, copies) of every document; texts are read once for their posteriors."""
    weights, any_labelled = model(docs, labels)
    found = memberships(only(docs, "doc_id", "text"), weights)
    members = written(found.select("row.doc_id", "n_tokens", "p", "share"), "memberships")
    return with_rate(members, fit_rates(members, targets if any_labelled else {})[0]).drop("share")


def apply_mix(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS) -> DataFrame:
    """docs, each as many times as its copies say. Posteriors are
    computed again rather than joined, which would shuffle the texts."""
    weights, any_labelled = model(docs, labels)
    members = memberships(docs, weights)
    steps, _ = fit_rates(written(members.select("n_tokens", "p"), "memberships"), targets if any_labelled else {})
    once = with_rate(members, steps).filter("copies > 0").withColumn("again", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return once.select("row.*")
