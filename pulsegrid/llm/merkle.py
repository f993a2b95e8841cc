"""Merkle manifest of a dataset: a hash tree for each language, and one over their roots, with a proof for every row.

A level of an aligned block of leaves is one string of fixed-width hex digests. Parents are hashes of its substrings of
eight digests; what stands left and right of a digest in its substring are the siblings. Blocks meet in the next round
as one digest each, so a tree of n leaves takes log(n) / log(BLOCK) rounds, and no task or row holds more than a block.
All of it is SQL functions. Levels are binary columns, as a substring of bytes takes its own length and not its offset.

Places within a language come from ranges of rows and one count a range, so a language with most rows is many tasks.

Defined results: null fields are "-" in a leaf. Rows without a doc_id stand first in their language, rows without a
language in a tree of their own that stands before the others. Rows that share a doc_id are leaves of their own, by
leaf; equal rows have equal leaves, so their order doesn't matter to any root (each has the proof of its own place).
A row without a doc_id counts as untampered. An empty table gives no rows. Columns beside the five are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import only, written

#: Digests that a parent joins, their width as hex text, and how many levels a block holds above its leaves.
RUN, WIDTH, LEVELS = 8, 64, 3
BLOCK = RUN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_of(*fields: Column) -> Column:
    """The hash of fields, each "-" if null, else its length in bytes, a colon and itself."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def leaves(docs: DataFrame, tampered: Column | None = None, change=lower_ascii) -> DataFrame:
    """(tree, doc_id, node, changed): a row's language as a key that sorts null first, its leaf, and the leaf of its
    changed text where tampered is true."""
    docs = only(docs, *FIELDS)
    own = [F.col(c) for c in FIELDS]
    changed = F.when(tampered, leaf_of(*own[:-1], change(own[-1]))) if tampered is not None else F.lit(None).cast("string")
    return docs.select(F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-")).alias("tree"), "doc_id", leaf_of(*own).alias("node"), changed.alias("changed"))


def placed(rows: DataFrame, *by: str) -> DataFrame:
    """rows with their place in the order of their tree (from 0) and the tree's size. A place is the rows of earlier ranges
    and those before it in its own range; the only windows run over one count a range and tree."""
    order = ["tree", *by, "tie"]
    ranged = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    stored = written(ranged.withColumn("at", F.monotonically_increasing_id()), "places")
    split = stored.withColumn("range", F.shiftright("at", 33))
    ranges = split.groupBy("tree", "range").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    own = Window.partitionBy("tree")
    before = F.sum("n").over(own.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("tree", "range", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(own).alias("total"))
    return split.join(ranges, ["tree", "range"]).withColumn("place", F.expr("at - first + before")).drop("at", "range", "first", "before")


def height(total: str) -> str:
    """SQL of the levels above total leaves: the powers of RUN that are below total."""
    return f"size(filter(sequence(0, 20), h -> shiftleft(1L, 3 * h) < {total}))"


def joined(array: str) -> str:
    return f"CAST(array_join({array}, '') AS BINARY)"


def parents(level: str) -> str:
    """SQL of the next level's string: the hash of each substring of RUN digests."""
    step = RUN * WIDTH
    return joined(f"transform(sequence(0, (length({level}) - 1) div {step}), i -> sha2(substring({level}, i * {step} + 1, {step}), 256))")


def blocks(nodes: DataFrame, done: int) -> DataFrame:
    """(tree, block, total, h, l0 to l3, rows, node): blocks of nodes (tree, place, total, node, row), h levels high, where
    done levels are below them. node is the block's own digest."""
    found = nodes.groupBy("tree", F.expr(f"place div {BLOCK}").alias("block")).agg(F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("place", "node", "row"))).alias("members"))
    found = found.withColumns({"h": F.expr(f"greatest(0, least({LEVELS}, {height('total')} - {done}))"), "l0": F.expr(joined("transform(members, m -> m.node)")), "rows": F.expr("transform(members, m -> m.row)")}).drop("members")
    for k in range(LEVELS):
        found = found.withColumn(f"l{k + 1}", F.expr(f"CASE WHEN {k} < h THEN {parents(f'l{k}')} ELSE l{k} END"))
    return found.withColumn("node", F.col(f"l{LEVELS}").cast("string"))


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every round, written, and the roots (tree, node). The driver learns the largest tree's size only."""
    largest = nodes.agg(F.max("total")).first()[0] or 0
    rounds, width = [], 1
    while not rounds or width < largest:
        rounds.append(written(blocks(nodes, LEVELS * len(rounds)), "blocks"))
        nodes = rounds[-1].select("tree", F.col("block").alias("place"), "total", "node", F.struct(F.lit(0).alias("none")).alias("row"))
        width *= BLOCK
    return rounds, rounds[-1].select("tree", "node")


def siblings(index: str) -> str:
    """SQL of the steps from the digest at index of a block to the block's own: what flanks it in its run, level by level."""
    step = RUN * WIDTH
    level = " ".join(f"WHEN {k} THEN l{k}" for k in range(LEVELS))
    at = f"shiftright({index}, 3 * k)"
    left = f"substring(CASE k {level} END, ({at} div {RUN}) * {step} + 1, ({at} % {RUN}) * {WIDTH})"
    right = f"substring(CASE k {level} END, ({at} + 1) * {WIDTH} + 1, ({RUN - 1} - {at} % {RUN}) * {WIDTH})"
    return f"transform(filter(sequence(0, {LEVELS - 1}), k -> k < h), k -> struct({left} AS l, {right} AS r))"


def descend(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(tree, rows, l0 to l3, h, above, and tops' columns): the lowest blocks with the steps above each. tops: (tree, above, …)
    for each tree's root. Paths of a round are one row a block of the round below it."""
    further = [c for c in tops.columns if c not in ("tree", "above")]
    paths = tops.withColumn("block", F.lit(0).cast("long"))
    for table in reversed(rounds[1:]):
        inner = table.drop("node", "rows").join(paths, ["tree", "block"])
        members = F.expr(f"transform(sequence(0, int(length(l0) div {WIDTH}) - 1), i -> struct(block * {BLOCK} + i AS block, concat({siblings('i')}, above) AS above))")
        paths = inner.select("tree", *further, F.inline(members))
    return rounds[0].drop("node", "total").join(paths, ["tree", "block"])


def folded(leaf: str, steps: str) -> str:
    """SQL of the root that a leaf and its steps give."""
    return f"aggregate({steps}, {leaf}, (x, s) -> sha2(concat(s.l, CAST(x AS BINARY), s.r), 256))"


def manifest(docs: DataFrame, tampered: Column | None = None, change=lower_ascii) -> DataFrame:
    """(doc_id, lang, leaf, subroot, root, siblings, proof_sha256, folded_root, verified) of every row. siblings is the proof:
    the digests beside the row's own, from its leaf to the root, as hex text. folded_root is what the proof makes of the
    row's leaf as it is now: changed where tampered is true."""
    stored = written(leaves(docs, tampered, change), "leaves")  # texts are read once; ranges are found over narrow rows
    nodes = placed(stored, "doc_id", "node").select("tree", "place", "total", "node", F.struct("doc_id", "changed").alias("row"))
    rounds, subroots = climb(nodes)
    tops = placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node"), "name")
    upper, root = climb(tops.select("tree", "place", "total", "node", F.struct("name").alias("row")))
    starts = root.select("tree", F.col("node").alias("root"), F.expr("CAST(array() AS array<struct<l: binary, r: binary>>)").alias("above"))
    named = F.expr(f"transform(sequence(0, size(rows) - 1), i -> struct(rows[i].name AS tree, CAST(substring(l0, i * {WIDTH} + 1, {WIDTH}) AS STRING) AS subroot, concat({siblings('i')}, above) AS above))")
    found = descend(rounds, descend(upper, starts).select("root", F.inline(named)))
    steps = f"concat({siblings('i')}, above)"
    leaf = f"CAST(substring(l0, i * {WIDTH} + 1, {WIDTH}) AS STRING)"
    row = f"transform(sequence(0, size(rows) - 1), i -> struct(rows[i].doc_id AS doc_id, {leaf} AS leaf, CAST({joined(f'transform({steps}, s -> CAST(concat(s.l, s.r) AS STRING))')} AS STRING) AS siblings, {folded(f'coalesce(rows[i].changed, {leaf})', steps)} AS folded_root))"
    each = found.select(F.expr("CASE WHEN tree <> '-' THEN substring(tree, 2) END").alias("lang"), "subroot", "root", F.inline(F.expr(row)))
    return each.withColumns({"proof_sha256": F.sha2("siblings", 256), "verified": F.expr("folded_root = root")})


def third_of_ids() -> Column:
    """True where 3 divides the checksum of the decimal doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
