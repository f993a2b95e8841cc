"""Quality by perplexity: interpolated modified Kneser-Ney over characters, in sharded count joins.

The model's n-grams are ORDER characters, across word ends: white space runs count as one space, and a text begins with
ORDER - 1 marks, so every character has a whole context. An n-gram is a 64-bit key that numpy makes for all characters
of a batch at once; keys of different lengths differ by their start value. The model is trained on the documents labelled
good and not toxic, but for those of FOLD, which set the thresholds, so that a threshold is not that of texts the
model has seen. Counts, continuation counts, context totals and probabilities are tables keyed by n-gram, built by
grouping and joins; discounts are four counts of counts a level.

Scoring: documents are packed, in the order in which they are read, into blocks of BLOCK_BYTES with the distinct keys that
each block asks for. A join answers with the probabilities and back-off weights that the model has, and the
block's documents are scored with them. No table is broadcast, nothing is dealt by a document's key, and what is
shuffled grows with the corpus. A document is kept if its perplexity is at most MARGIN times its language's quantile
QUANTILE over the trusted documents of FOLD (all languages' together where a language has fewer than LEAST of them).

Defined results: a null or empty text, or white space alone, has no characters, perplexity 1 and is kept; without trusted
documents all probabilities are uniform, no threshold exists and every document is kept. A null language is a
language. A document with several labels is trusted if one says so; rows that share a doc_id, or have none, are each scored on
their own; a null doc_id is never trusted. Other columns of the input are not looked at.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import chunks, compressed_texts, only, written

ORDER = 4
QUANTILE, MARGIN, LEAST = 0.999, 1.0, 30
#: One of so many trusted documents, by a hash, sets thresholds and isn't trained on.
FOLD = 10
#: Bytes of a scored block, or one document: large, so that a block asks for few n-grams a byte.
BLOCK_BYTES = 24_000_000
#: The mark before a text's first character: no code point.
MARK = 0x110000
_STEP = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- n-gram keys
def code_points(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each after order - 1 marks, with one space for every run of ASCII white space and none
    at the ends; and the characters of each text."""
    plain = [" ".join(t.split()) if t.isascii() else b" ".join(t.encode().split()).decode() for t in texts]
    sizes = np.fromiter(map(len, plain), np.int64, len(plain))
    points = np.frombuffer("".join(plain).encode("utf-32-le"), np.uint32).astype(np.uint64)
    starts = np.repeat(np.cumsum(sizes) - sizes, order - 1)
    return np.insert(points, starts, np.uint64(MARK)), sizes


def distinct_grams(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray]:
    """The number of each character's n-gram among the distinct ones; for each distinct one, keys of its last 1 .. order
    characters, and of the 0 .. order - 1 before its last; and the characters of each text."""
    points, sizes = code_points(texts, order)
    place = np.arange(int(sizes.sum())) + np.repeat(np.arange(1, len(sizes) + 1) * (order - 1), sizes)
    key = points
    for k in range(1, order):
        key = np.append(np.zeros(1, np.uint64), key[:-1]) * _STEP + points
    of, top = pd.factorize(key[place])
    first = np.empty(len(top), np.int64)
    first[of[::-1]] = place[::-1]  # the first of a number's places is written last

    def ending(at: np.ndarray, k: int) -> np.ndarray:
        own = np.zeros(len(at), np.uint64)
        for j in range(k - 1, -1, -1):
            own = own * _STEP + points[at - j]
        own = (own ^ own >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(k)
        return (own ^ own >> np.uint64(32)).view(np.int64)

    ends = [ending(first, k) for k in range(1, order + 1)]
    return of, ends, [np.zeros(len(first), np.int64), *(ending(first - 1, k) for k in range(1, order))], sizes


# ---------------------------------------------------------------- training
def trusted_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, held): trusted documents, and whether they set thresholds rather than train."""
    good = labels.filter("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return good.withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(FOLD)) == 0)


def trusted_texts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(z): the texts of the documents named, compressed."""
    return compressed_texts(docs, trusted.select("doc_id")).join(trusted.select("doc_id"), "doc_id").select("z")


def gram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(e1 .. e_order, b1 .. b_(order - 1), a): counts of the n-grams of whole length, with the keys of their ends and of
    what stands before the last character."""
    names = [f"e{k}" for k in range(1, order + 1)] + [f"b{k}" for k in range(1, order)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, held, size = zstandard.ZstdDecompressor(), [], 0
        for batch in batches:
            for z in batch.column("z").to_pylist():
                held.append(unpack.decompress(z).decode())
                size += len(held[-1])
                if size > 2_000_000:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    def counted(own: list[str]) -> pa.RecordBatch:
        of, ends, before, _ = distinct_grams(own, order)
        n = np.bincount(of, minlength=len(ends[0])).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in [*ends, *before[1:], n]], names=[*names, "a"])

    found = texts.mapInArrow(run, ", ".join(f"{n} long" for n in [*names, "a"]))
    return found.groupBy(f"e{order}").agg(*[F.first(n).alias(n) for n in names if n != f"e{order}"], F.sum("a").alias("a"))


class Model:
    """Tables of a trained model: table (gram, p, weight) has the probability of each n-gram seen and the back-off weight
    of each context seen; floor is the probability of a character never seen."""

    def __init__(self, texts: DataFrame, order: int = ORDER):
        self.order = order
        now, levels = written(gram_counts(texts, order), "lm-top"), []
        for k in range(order, 0, -1):
            context = F.col(f"b{k - 1}") if k > 1 else F.lit(0).cast("long")
            end = F.col(f"e{k - 1}") if k > 1 else F.lit(0).cast("long")
            levels.append(now.select(F.lit(k).alias("level"), F.col(f"e{k}").alias("gram"), context.alias("context"), end.alias("end"), "a"))
            if k > 1:  # below the top, counts are of the different characters that stand before
                rest = [f"e{j}" for j in range(1, k - 1)] + [f"b{j}" for j in range(1, k - 1)]
                now = now.groupBy(f"e{k - 1}").agg(*[F.first(n).alias(n) for n in rest], F.count("*").alias("a"))
        every = written(reduce(DataFrame.union, levels), "lm-counts")
        of = {(r["level"], r["c"]): r["n"] for r in every.groupBy("level", F.least("a", F.lit(5)).alias("c")).agg(F.count("*").alias("n")).collect()}  # 5 rows a level
        discount = {k: self._discounts([of.get((k, c), 0) for c in range(1, 5)]) for k in range(1, order + 1)}
        cut = self._by_level(discount, F.col("a"))
        contexts = every.groupBy("level", "context").agg(F.sum("a").alias("total"), F.sum(cut).alias("lost"))
        contexts = written(contexts.withColumn("weight", F.col("lost") / F.col("total")), "lm-contexts")
        rows = every.join(contexts, ["level", "context"]).select("level", "gram", "end", "weight", ((F.col("a") - cut) / F.col("total")).alias("alpha"))
        rows = written(rows, "lm-grams")
        lowest = contexts.filter("level = 1").first()
        letters = sum(n for (level, _), n in of.items() if level == 1) + 1
        self.floor = (lowest["weight"] if lowest else 1.0) / letters
        last = rows.filter("level = 1").select("gram", (F.col("alpha") + self.floor).alias("p"))
        known = [last]
        for k in range(2, order + 1):
            below = last.select(F.col("gram").alias("end"), F.col("p").alias("below"))
            last = rows.filter(F.col("level") == k).join(below, "end").select("gram", (F.col("alpha") + F.col("weight") * F.col("below")).alias("p"))
            last = written(last, f"lm-p{k}")
            known.append(last)
        nothing = F.lit(None).cast("double")
        weights = contexts.filter("level > 1").select(F.col("context").alias("gram"), nothing.alias("p"), "weight")
        both = reduce(DataFrame.union, known).select("gram", "p", nothing.alias("weight")).union(weights)
        self.table = written(both.groupBy("gram").agg(F.max("p").alias("p"), F.max("weight").alias("weight")), "lm-table")

    @staticmethod
    def _discounts(n: list[int]) -> list[float]:
        """For counts of one, two, and three or more; fixed values where the counts of counts don't give them."""
        usual = [0.5, 1.0, 1.5]
        if not all(n[:3]):
            return usual
        y = n[0] / (n[0] + 2 * n[1])
        found = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
        return [d if 0 < d < k else u for k, d, u in zip((1, 2, 3), found, usual)]

    @staticmethod
    def _by_level(discount: dict[int, list[float]], a: Column) -> Column:
        out = F.lit(0.0)
        for k, (one, two, more) in discount.items():
            out = F.when(F.col("level") == k, F.when(a == 1, one).when(a == 2, two).otherwise(more)).otherwise(out)
        return out


# ---------------------------------------------------------------- scoring
def packed_blocks(docs: DataFrame, order: int) -> DataFrame:
    """(block, payload, asked): documents as compressed Arrow data, and the distinct keys that they need, as bytes. A block is
    a run of rows of one task, so its number follows from the task's and a task that runs again makes the same blocks; each is one row.
    They are dealt by number once: questions and scores read the same shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, held, asked, size = zstandard.ZstdCompressor(3), [], [], 0
        number = TaskContext.get().partitionId() << 24

        def packed() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).cast(schema)
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, schema) as writer:
                writer.write_table(rows)
            own = np.unique(np.concatenate(asked))
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([packer.compress(sink.getvalue())], pa.binary()), pa.array([own.tobytes()], pa.binary())], names=["block", "payload", "asked"])

        for batch, texts in chunks(batches):
            _, ends, before, _ = distinct_grams(texts, order)
            asked.append(np.unique(np.concatenate([*ends, *before[1:]])))
            held.append(batch)
            size += batch.nbytes
            if size > BLOCK_BYTES:
                yield packed()
                held, asked, size, number = [], [], 0, number + 1
        if held:
            yield packed()

    return only(docs, "doc_id", "lang", "text").mapInArrow(run, "block long, payload binary, asked binary").repartition("block")


def block_grams(packed: DataFrame) -> DataFrame:
    """(block, gram): the keys that a block asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, asked in zip(batch.column("block").to_pylist(), batch.column("asked").to_pylist()):
                own = np.frombuffer(asked, np.int64)
                for k in range(0, len(own), 100_000):
                    part = own[k : k + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), pa.array(part)], names=["block", "gram"])

    return packed.mapInArrow(run, "block long, gram long")


SCORES = "doc_id long, lang string, n_chars long, log_p double"


def log_probabilities(texts: list[str], answers: tuple[np.ndarray, np.ndarray, np.ndarray], floor: float, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Characters and the sum of their log-probabilities for each text; answers are sorted keys with log p and log weight."""
    known, log_p, log_w = answers
    of, ends, before, sizes = distinct_grams(texts, order)

    def found(values: np.ndarray, column: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.full(len(values), np.nan)
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        return np.where(known[at] == values, column[at], np.nan)

    value = np.nan_to_num(found(ends[0], log_p), nan=np.log(floor))
    for k in range(2, order + 1):
        seen = found(ends[k - 1], log_p)
        value = np.where(np.isnan(seen), value + np.nan_to_num(found(before[k - 1], log_w)), seen)
    sums, there = np.zeros(len(sizes)), sizes > 0
    if there.any():
        sums[there] = np.add.reduceat(value[of], (np.cumsum(sizes) - sizes)[there])
    return sizes, sums


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, n_chars, log_p) of every row."""
    packed = packed_blocks(docs, model.order)
    answers = block_grams(packed).join(model.table, "gram").select("block", "gram", F.log("p").cast("float").alias("log_p"), F.log("weight").cast("float").alias("log_w"))
    order, floor = model.order, model.floor

    def rate(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("gram")
        known = tuple(right.column(c).to_numpy().astype(t) for c, t in (("gram", np.int64), ("log_p", float), ("log_w", float)))
        out = []
        for payload in left.column("payload").to_pylist():
            rows = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(payload)).read_all()
            for batch, texts in chunks(iter(rows.to_batches())):
                sizes, sums = log_probabilities(texts, known, floor, order)
                out.append(pa.table({"doc_id": batch.column("doc_id"), "lang": batch.column("lang"), "n_chars": pa.array(sizes), "log_p": pa.array(np.round(sums, 6))}))
        return pa.concat_tables(out)

    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(rate, SCORES)


def thresholds(scored: DataFrame, quantile: float = QUANTILE, least: int = LEAST) -> DataFrame:
    """(lang, limit): the quantile of each language's held trusted perplexities, rounded up to hundredths. It comes
    from a histogram, so no language's rows meet in one task."""
    histogram = scored.filter("held").groupBy("lang", F.ceil(F.col("perplexity") * 100).alias("bin")).agg(F.count("*").alias("n"))
    every = histogram.groupBy(F.lit(True).alias("all"), "bin").agg(F.sum("n").alias("n"))

    def limit(rows: DataFrame, key: str) -> DataFrame:
        before = F.sum("n").over(Window.partitionBy(key).orderBy("bin"))
        total = F.sum("n").over(Window.partitionBy(key))
        reached = rows.withColumns({"before": before, "total": total}).filter(F.col("before") >= F.col("total") * quantile)
        return reached.groupBy(key).agg((F.min("bin") / 100).alias("limit"), F.max("total").alias("total"))

    return limit(histogram, "lang").filter(F.col("total") >= least).select("lang", "limit"), limit(every, "all").select("limit")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """(doc_id, lang, n_chars, perplexity, threshold, kept) of every row of docs."""
    docs = only(docs, "doc_id", "lang", "text")
    trusted = written(trusted_labels(labels), "lm-trusted")
    model = Model(trusted_texts(docs, trusted.filter("NOT held")))
    scored = score(docs, model)
    scored = scored.withColumn("perplexity", F.round(F.exp(-F.col("log_p") / F.greatest("n_chars", F.lit(1))), 4)).drop("log_p")
    scored = written(scored, "lm-scores")
    by_language, overall = thresholds(scored.join(trusted.filter("held"), "doc_id"), quantile)
    whole = overall.first()
    of_language = F.broadcast(by_language.withColumnRenamed("lang", "of_lang"))  # a row a language
    limits = scored.join(of_language, F.col("lang").eqNullSafe(F.col("of_lang")), "left").drop("of_lang")
    threshold = F.coalesce(F.col("limit"), F.lit(whole["limit"] if whole else None).cast("double")) * margin
    return limits.withColumn("threshold", threshold).withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))).drop("limit")
