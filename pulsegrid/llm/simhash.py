"""SimHash near-duplicates by covering locality-sensitive hashing.

Each of the 64 bits has a nonzero label of radius + 1 bits; table v keeps the bits whose label has an odd inner
product with v. Up to radius differing bits have labels that span no more than radius dimensions, so some
nonzero v is orthogonal to all of them, and that table keeps none of the differing bits: every pair within the
radius collides in some table. Candidates are verified, so the links are exact. A document may have several
fingerprints (parts), each with tables of its own; two documents are linked when any part is within the radius.

Documents with equal fingerprints are one node from the start. A bucket of moderate size is linked within its task
by a spanning forest (never all pairs as rows). A larger one goes through its midpoints: two fingerprints within
radius share a value that is within half the radius, rounded down, of one and rounded up of the other. So each emits those
values, and joins the smallest fingerprint that has one in the smaller distance; that is exact and linear in the bucket.

Two five-word shingle sets of similarity 0.8 have fingerprints that differ in about 10 of 64 bits, for which a
covering would need thousands of tables. Sets of single words differ far less where edits are scattered: about 4 of 64 bits. Where a
block was added or cut, one end of the text is as it was. So drop_near_duplicates takes fingerprints of the distinct words
of the whole text (WHOLE, radius 4) and of the first and the last words (EDGES of either, radius 2), as many words as the largest
numbers of a geometric scale below half the text's; texts that differ by a fifth in length share such a number. What these tables
link are candidates: each link is verified by the exact similarity of the five-word shingle sets, 0.8 or more.
A spanning forest of a bucket holds few of its pairs, and edits can take a pair out of every table's reach. So an exact way for
the rest follows: a set similarity join by prefixes of the shingles (first_shingles, remaining_pairs) finds every pair of texts of
different components that can be so similar, and those are verified as well. Each text meets the smallest one with a shingle first; only
pairs that are still in different components then follow. Together they are the components of all pairs at or above the similarity.

Defined results: null and empty texts have fingerprint zero and link like any other; texts that have no shingle in common but are both
without words are alike. Rows that share a doc_id are all returned, each by its own text; a row with a null doc_id belongs to the
component of its equals but links nothing itself. Ties of hashes at half a text's shingles give a zero bit. An empty table gives
none; further columns are not looked at, or kept in drop_near_duplicates. Very long texts are hashed whole, in one step each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, compressed_texts, only, shuffled, slices, word_hashes, written
from .components import connected_components
from .passages import shingle_hashes

#: Fingerprints of a bucket that one task compares directly.
DIRECT = 4096


def _lanes() -> np.ndarray:
    """For each byte, its bits as the eight bytes of a 64-bit integer: sums of up to 255 don't overflow."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view("<u8").ravel()


LANES = _lanes()


def hashes(text: str, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of so many words, A-Z lower-cased, joined by one space."""
    found = text.encode().lower().split()
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), seed)] if found else [], np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist())], np.uint64)


def fingerprints(per_text: list[np.ndarray]) -> np.ndarray:
    """A bit is 1 if over half of a text's hashes have it; no hashes: zero."""
    counts = np.array([len(h) for h in per_text], np.int64)
    out = np.zeros(len(per_text), np.uint64)
    if not counts.sum():
        return out
    flat = np.ascontiguousarray(np.concatenate(per_text)).view(np.uint8).reshape(-1, 8)
    starts = np.cumsum(counts) - counts
    parts = -(-counts // 255)  # sums of up to 255 rows fit a byte lane
    owner = np.repeat(np.arange(len(counts)), parts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    cuts = starts[owner] + 255 * within
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    having = owner[first]
    ones = np.empty((len(having), 64), np.int64)
    for byte in range(8):
        sums = np.add.reduceat(LANES[flat[:, byte]], cuts)
        ones[:, 8 * byte : 8 * byte + 8] = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
    bits = (2 * ones > counts[having][:, None]).astype(np.uint8)
    out[having] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _other(h: np.ndarray, part: int) -> np.ndarray:
    """Hashes of a further part, made from the first's."""
    h = (h ^ np.uint64(0x9E3779B97F4A7C15 * part % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def fingerprint_documents(docs: DataFrame, words: int, text: str = "text") -> DataFrame:
    """(doc_id, fps): a document's fingerprint as a list of one signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, text):
            flat = pa.array(fingerprints([hashes(t, words) for t in texts]).view(np.int64))
            ends = pa.array(np.arange(len(texts) + 1, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(ends, flat)], names=["doc_id", "fps"])

    return only(docs, "doc_id", text).mapInArrow(run, "doc_id long, fps array<long>")


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """Masks of the 2 ** (radius + 1) - 1 tables, as unsigned integers."""
    space = 2 ** (radius + 1)
    label = [1 + i % (space - 1) for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (label[i] & v).bit_count() % 2) for v in range(1, space)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the signed values that lie within radius of each other."""
    if len(values) == 2:
        a, b = values.tolist()
        return [(a, b)] if (((a ^ b) & (2**64 - 1)).bit_count()) <= radius else []
    rest, edges = values.view(np.uint64), []  # signed numbers would be counted by their absolute value
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            reached = np.full(len(rest), -1)
            for k in range(0, len(front), 256):
                near = np.bitwise_count(front[k : k + 256, None] ^ rest[None, :]) <= radius
                new = near.any(axis=0) & (reached < 0)
                reached[new] = k + near[:, new].argmax(axis=0)
            hit = reached >= 0
            edges += zip(front[reached[hit]].view(np.int64).tolist(), rest[hit].view(np.int64).tolist())
            front, rest = rest[hit], rest[~hit]
    return edges


def links(values: DataFrame, radius: int, direct: int = DIRECT) -> DataFrame:
    """Edges (part, a, b) that connect exactly those of a part's distinct fingerprints (part, fp) that are within
    radius, directly or by others."""
    spark = values.sparkSession
    masks = covering_masks(radius)
    n = len(masks)
    tables = F.array(*[F.struct((F.col("part") * n + t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for t, m in enumerate(masks)])
    dealt = values.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "fp")  # each row becomes n
    keys = dealt.select("fp", F.explode(tables).alias("x")).select("x.t", "x.k", "fp")
    sizes = keys.groupBy("t", "k").agg(F.count("*").alias("n")).filter("n > 1")
    members = written(keys.join(shuffled(sizes), ["t", "k"]), "simhash-buckets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("fps")
            flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_pylist()
            edges = [(t // n, *e) for t, a, b in zip(batch.column("t").to_pylist(), ends, ends[1:]) for e in forest(flat[a:b], radius)]
            columns = list(zip(*edges)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["part", "a", "b"])

    small = members.filter(F.col("n") <= direct).groupBy("t", "k").agg(F.collect_list("fp").alias("fps")).select("t", "fps")
    small = small.mapInArrow(compare, "part int, a long, b long")
    # of fixed size: tables x midpoints of the bits that a table doesn't keep
    flips = [(t, _signed(sum(1 << i for i in c)), r <= radius // 2) for t, m in enumerate(masks) for r in range(-(-radius // 2) + 1) for c in combinations([i for i in range(64) if not m >> i & 1], r)]
    flips = spark.createDataFrame(flips, "table int, flip long, near boolean")
    middle = members.filter(F.col("n") > direct).withColumn("table", F.col("t") % n).join(F.broadcast(flips), "table")
    middle = middle.select("t", "k", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"), "fp", "near")
    heads = middle.groupBy("t", "k", "mid").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("head"), F.count("*").alias("c")).filter("c > 1 AND head IS NOT NULL")
    large = middle.join(shuffled(heads), ["t", "k", "mid"]).filter("fp != head").select(F.expr(f"int(t div {n})").alias("part"), F.col("head").alias("a"), F.col("fp").alias("b"))
    return small.union(large).select("part", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(prints: DataFrame, radius: int, direct: int = DIRECT) -> DataFrame:
    """prints (doc_id, fps) with component_id: the smallest doc_id reachable over links within radius."""
    nodes = prints.groupBy("fps").agg(F.min("doc_id").alias("node"))
    nodes = written(nodes, "simhash-nodes")
    valued = nodes.filter("node IS NOT NULL").select("node", F.posexplode("fps").alias("part", "fp"))
    heads = written(valued.groupBy("part", "fp").agg(F.min("node").alias("head")), "simhash-heads")
    near = links(heads.select("part", "fp"), radius, direct)
    of_a = heads.select("part", F.col("fp").alias("a"), F.col("head").alias("u"))
    of_b = heads.select("part", F.col("fp").alias("b"), F.col("head").alias("v"))
    edges = near.join(shuffled(of_a), ["part", "a"]).join(shuffled(of_b), ["part", "b"]).select("u", "v")
    roots = connected_components(edges, "u", "v")
    of_node = nodes.join(shuffled(roots), "node", "left").select("fps", F.coalesce("root", "node").alias("component_id"))
    return prints.join(shuffled(written(of_node, "simhash-roots")), "fps")


def near_duplicates(docs: DataFrame, words: int, radius: int = 4) -> DataFrame:
    """(doc_id, fps, component_id) of every row of docs."""
    return components(written(fingerprint_documents(docs, words), "simhash"), radius)


# ---------------------------------------------------------------- near duplicates by verified similarity
WHOLE, EDGES, EDGE_RADIUS = 4, 3, 2
SHINGLE, SIMILARITY = 5, 0.8
#: Share of all shingles that tells first which texts can have a partner, and further rounds that do by all shingles.
LOW, ROUNDS = 0.32, 2
#: Ratio of the scale of word numbers for the ends of a text: EDGES steps span a difference of a quarter in length.
SCALE = 1.12
_STEPS = np.unique(np.rint(SCALE ** np.arange(260)).astype(np.int64))


def edge_sizes(n: int) -> list[int]:
    """The EDGES largest numbers of the scale up to half of n words; fewer for very short texts."""
    at = int(np.searchsorted(_STEPS, n / 2, side="right"))
    return _STEPS[max(0, at - EDGES) : at].tolist() if n >= 8 else []


def candidate_prints(texts: list[str]) -> list[list[tuple[int, int]]]:
    """(part, fingerprint) of each text: parts below WHOLE are of all its words, then come one of its first and one of its last
    words; the number of those words is mixed into the fingerprint's words, so only equal numbers meet."""
    sets, of, part = [], [], []
    for i, t in enumerate(texts):
        found = t.encode().lower().split()
        h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
        whole = np.unique(h)
        for p in range(WHOLE):
            sets.append(_other(whole, p) if p else whole)
            of.append(i)
            part.append(p)
        for size in edge_sizes(len(h)):
            for p, own in ((WHOLE, h[:size]), (WHOLE + 1, h[-size:])):
                sets.append(_other(np.unique(own), p + 2 * size))
                of.append(i)
                part.append(p)
    prints = fingerprints(sets).view(np.int64).tolist()
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for i, p, f in zip(of, part, prints):
        out[i].append((p, f))
    return out


def shingle_set(text: str) -> np.ndarray:
    """Sorted hashes of the distinct five-word shingles; of all words where there are fewer."""
    return np.unique(hashes(text, SHINGLE))


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets; of two empty ones it is 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1) if len(a) + len(b) else 1.0


def verified(edges: DataFrame, texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The edges (u, v) whose texts (doc_id, z) have shingle sets at least so similar. The texts of an edge meet in one
    row; a document in many edges spreads over partitions by the edge."""
    both = edges.join(shuffled(texts.withColumnsRenamed({"doc_id": "u", "z": "zu"})), "u").repartition("u", "v").join(shuffled(texts.withColumnsRenamed({"doc_id": "v", "z": "zv"})), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, last, own = zstandard.ZstdDecompressor(), None, None
        for batch in batches:
            keep = []
            for zu, zv in zip(batch.column("zu"), batch.column("zv")):
                zu, zv = zu.as_py(), zv.as_py()
                if zv != last:
                    last, own = zv, shingle_set(unpack.decompress(zv).decode())
                keep.append(alike(own, shingle_set(unpack.decompress(zu).decode())) >= least)
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.select("u", "v", "zu", "zv").mapInArrow(run, "u long, v long")


def edge_texts(edges: DataFrame, texts_of: DataFrame, hashed: DataFrame) -> DataFrame:
    """(doc_id, z) of the texts that are an end of an edge, named by their hash."""
    return node_texts(edges.select(F.explode(F.array("u", "v")).alias("h")).distinct(), texts_of, hashed)


def node_texts(nodes: DataFrame, texts_of: DataFrame, hashed: DataFrame) -> DataFrame:
    """(doc_id, z) of the texts (h), named by their hash; one document of each text gives it."""
    ends = nodes.join(shuffled(texts_of.select("h", F.col("named").alias("doc_id"))), "h")
    named = compressed_texts(hashed, ends.select("doc_id"), "h")
    return written(named.join(shuffled(ends), ["doc_id", "h"]).select(F.col("h").alias("doc_id"), "z").dropDuplicates(["doc_id"]), "simhash-named")


def prefix_size(n: int, least: float) -> int:
    """Of n shingles, in any order, those of which a set at least so similar must hold one."""
    return n - ceil(least * n - 1e-6) + 1


def low_shingles(hashed: DataFrame, least: float) -> DataFrame:
    """(s, node, need): the shingles of each text (h: node) whose hash is below LOW of all, and how many shingles that no other
    text has are too many for a text at least so similar. Hashes are quick ones: if two meet, a text is looked at further."""
    most = np.uint64(int(LOW * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            word, sizes = word_hashes(texts)
            value = shingle_hashes(word, SHINGLE) if len(word) >= SHINGLE else word[:0]
            owner = np.repeat(np.arange(len(texts)), sizes)[: len(value)]
            inside = np.arange(len(value)) - (np.cumsum(sizes) - sizes)[owner]
            at = np.flatnonzero((value < most) & (inside + SHINGLE <= sizes[owner]))
            rows = pa.array(owner[at])
            needs = np.array([prefix_size(max(1, n - SHINGLE + 1), least) for n in sizes.tolist()], np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(value[at].view(np.int64)), batch.column("h").take(rows), pa.array(needs[owner[at]])], names=["s", "node", "need"])

    return hashed.select("h", "text").mapInArrow(run, "s long, node long, need int")


def full_shingles(texts: DataFrame) -> DataFrame:
    """(s, node, n): all n shingles of each text (doc_id: node, z). A text without words has one shingle of its own kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in slices(batches, "z"):
            sets = [shingle_set(unpack.decompress(z.as_py()).decode()).view(np.int64) for z in batch.column("z")]
            sets = [own if len(own) else np.zeros(1, np.int64) for own in sets]
            sizes = np.array([len(own) for own in sets])
            of = np.repeat(np.arange(len(sets)), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), batch.column("doc_id").take(pa.array(of)), pa.array(sizes[of].astype(np.int32))], names=["s", "node", "n"])

    return texts.mapInArrow(run, "s long, node long, n int")


def first_shingles(hashed: DataFrame, texts_of: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """(s, node, n, i): of the texts (hashed: doc_id, text, h) that can have a partner in another component (roots: node, root) the
    first shingles, by their place i among all n of the text, in one order of all shingles. A text shares least * n of its shingles with
    each partner, so texts of which more are nobody else's have none: first told by the shingles of smallest hash, then by all shingles,
    which must be in texts of two components. Of what is left, shingles of the fewest texts come first. Two sets at least so similar
    share a shingle among the first of both."""
    lone = low_shingles(hashed, least).groupBy("s").agg(F.min("node").alias("node"), F.max("node").alias("b"), F.max("need").alias("need")).filter("node = b")
    free = lone.groupBy("node").agg(F.count("*").alias("own"), F.max("need").alias("need")).filter("own >= need").select(F.col("node").alias("h"))
    held = written(texts_of.select("h").join(shuffled(free), "h", "left_anti"), "simhash-held")
    owned = full_shingles(node_texts(held, texts_of, hashed)).join(shuffled(roots), "node", "left").select("s", "node", "n", F.coalesce("root", "node").alias("c"))
    rows = written(owned, "simhash-shingles")
    for _ in range(ROUNDS):  # each leaves fewer texts, whose shingles then stand in fewer of them
        shared = rows.groupBy("s").agg(F.min("c").alias("a"), F.max("c").alias("b"), F.count("*").alias("texts")).filter("a != b").select("s", "texts")
        met = rows.select("s", "node", "n", "c").join(shuffled(shared), "s")
        enough = met.groupBy("node").agg(F.count("*").alias("met"), F.max("n").alias("n")).filter(F.col("met") >= F.ceil(least * F.col("n") - 1e-6)).select("node", "met")
        rows = written(met.join(shuffled(enough), "node"), "simhash-shared")
    place = F.row_number().over(Window.partitionBy("node").orderBy("texts", "s")) - 1 + F.col("n") - F.col("met")
    return written(rows.select("s", "node", "n", place.alias("i")).filter(F.col("i") <= F.col("n") - F.ceil(least * F.col("n") - 1e-6)), "simhash-apart")


def remaining_pairs(first: DataFrame, roots: DataFrame, least: float, heads: bool) -> DataFrame:
    """(u, v): the pairs of texts of different components (roots: node, root) that share one of their first shingles and can be at
    least so similar: after the shingle they have enough left on both sides. All of them, or with heads only those of a text with the
    smallest one that has the shingle: no more rows than there are shingles."""
    apart = first.join(shuffled(roots), "node", "left").select("s", "node", "n", "i", F.coalesce("root", "node").alias("c"))
    other = apart.groupBy("s").agg(F.min(F.struct("node", "n", "i", "c")).alias("o")).select("s", "o.*") if heads else apart.select("s", "node", "n", "i", "c")
    other = other.toDF("s", "other", "on", "oi", "oc")
    left = F.least(F.col("n") - F.col("i"), F.col("on") - F.col("oi"))
    possible = (left >= least / (1 + least) * (F.col("n") + F.col("on")) - 1e-6) & (F.least("n", "on") >= least * F.greatest("n", "on") - 1e-6)
    pairs = apart.join(shuffled(other), "s").filter((F.col("node") > F.col("other")) & (F.col("c") != F.col("oc")) & possible)
    return written(pairs.select(F.col("node").alias("u"), F.col("other").alias("v")).distinct(), "simhash-rest")


def similar_documents(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, h, component_id, first) of all documents with a doc_id; a document is a doc_id with a text (of hash h). Texts are
    linked whose five-word shingle sets are at least so similar; component_id is the smallest doc_id of a component, and first is true
    for one document of each: that doc_id's, of smallest text hash."""
    docs = only(docs, "doc_id", "text").filter("doc_id IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            rows = candidate_prints(texts)
            ends = pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32))
            flat = pa.StructArray.from_arrays([pa.array([p for r in rows for p, _ in r], pa.int32()), pa.array([f for r in rows for _, f in r], pa.int64())], names=["part", "fp"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.ListArray.from_arrays(ends, flat)], names=["doc_id", "h", "prints"])

    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    prints = written(hashed.mapInArrow(run, "doc_id long, h long, prints array<struct<part:int,fp:long>>"), "simhash-prints")
    # a text is a node by its hash, whatever documents have it; each has the prints of one of them
    own = prints.groupBy("doc_id", "h").agg(F.first("prints").alias("prints"))
    texts_of = written(own.groupBy("h").agg(F.min_by("prints", "doc_id").alias("prints"), F.min("doc_id").alias("named")), "simhash-texts")
    valued = written(texts_of.select(F.col("h").alias("node"), F.explode("prints").alias("x")).select("node", "x.part", "x.fp").distinct(), "simhash-values")
    heads = written(valued.groupBy("part", "fp").agg(F.min("node").alias("head")), "simhash-heads")
    of_a = heads.select("part", F.col("fp").alias("a"), F.col("head").alias("u"))
    of_b = heads.select("part", F.col("fp").alias("b"), F.col("head").alias("v"))
    near = links(heads.filter(F.col("part") < WHOLE), 4).union(links(heads.filter(F.col("part") >= WHOLE), EDGE_RADIUS))
    edges = near.join(shuffled(of_a), ["part", "a"]).join(shuffled(of_b), ["part", "b"]).select("u", "v")
    edges = edges.union(valued.join(shuffled(heads), ["part", "fp"]).filter("node != head").select("node", "head"))
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "simhash-candidates")
    passed = verified(edges, edge_texts(edges, texts_of, hashed), least)
    roots = written(connected_components(passed, "u", "v"), "simhash-first")
    first = first_shingles(hashed, texts_of, roots, least)
    for heads in (True, False):  # what heads link needs no pair of its own any more
        rest = remaining_pairs(first, roots, least, heads)
        passed = verified(rest, edge_texts(rest, texts_of, hashed), least)
        roots = written(connected_components(roots.toDF("u", "v").union(passed), "u", "v"), "simhash-roots")
    of_text = texts_of.select("h", "named").join(shuffled(roots.withColumnRenamed("node", "h")), "h", "left").select("h", "named", F.coalesce("root", "h").alias("component"))
    least_doc = of_text.groupBy("component").agg(F.min(F.struct(F.col("named").alias("doc_id"), "h")).alias("kept"))
    known = of_text.join(shuffled(least_doc), "component").select("h", "kept")
    found = prints.select("doc_id", "h").distinct().join(shuffled(known), "h")
    return found.select("doc_id", "h", F.col("kept.doc_id").alias("component_id"), (F.struct("doc_id", "h") == F.col("kept")).alias("first"))


def drop_near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """docs with one document of each component. Rows equal in doc_id and text are one document, kept or dropped together; rows that
    share the doc_id alone are judged each by its own text; rows without a doc_id are kept."""
    gone = similar_documents(docs, least).filter("NOT first").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"))
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    kept = packed.join(shuffled(gone), (packed["row.doc_id"] == gone["_id"]) & (F.xxhash64(packed["row.text"]) == gone["_h"]), "left_anti")
    return kept.select("row.*")
