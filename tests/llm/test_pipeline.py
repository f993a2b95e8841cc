"""Each stage of the pipeline against plain Python over its own input, odd rows included."""

from __future__ import annotations

import base64
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from pulsegrid.llm import mixing, passages, quality, simhash
from pulsegrid.llm import queries as q
from pulsegrid.llm.common import table, written

DATA = "/root/testdata/sf0.001"


def odd_rows(rng):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    long, shared = [word() for _ in range(300)], [word() for _ in range(70)]
    near = list(long)
    near[100] = "other"
    texts = [(900, " ".join(long)), (901, " ".join(near)), (902, " ".join([word() for _ in range(90)] + shared)), (903, " ".join([word() for _ in range(60)] + shared + [word() for _ in range(60)]))]
    texts += [(904, None), (905, ""), (None, " ".join(word() for _ in range(80))), (902, " ".join(word() for _ in range(120))), (906, " ".join(long)), (906, " ".join(long))]
    return [(t, i, "en", "own", len(t or "")) for i, t in texts]


def key(r):
    return (r.doc_id, r.text)


def plain_quality(rows, labels):
    """Base rules by regular expressions and the ratio by dictionaries of byte 4-grams in hashed buckets."""
    good = {r.doc_id for r in labels if r.quality == 1 and r.toxic == 0 and r.doc_id is not None}
    assert len(good) <= quality.TRUSTED_DOCS
    raw, trusted, grams = Counter(), Counter(), []
    for r in rows:
        data = (r.text or "").encode()
        own = [(int.from_bytes(data[i : i + 4], "little") * 2654435761 % 2**32) >> 14 for i in range(len(data) - 3)]
        grams.append(own)
        raw.update(own)
        if r.doc_id in good:
            trusted.update(own)
    n, m = sum(raw.values()) + quality.BUCKETS, sum(trusted.values())
    ratio = lambda b: np.log((1 - quality.RAW_SHARE) * trusted[b] / m / ((raw[b] + 1) / n) + quality.RAW_SHARE)
    known = {b: ratio(b) for b in raw}
    out = []
    for r, own in zip(rows, grams):
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        twice = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        score = sum(known[b] for b in own) / max(len(own), 1)
        if len(words) >= 50 and 100 * len(twice) <= 50 * len(words) and score >= quality.THRESHOLD:
            out.append(key(r))
    return Counter(out)


def plain_dedup(rows):
    """All pairs of shingle sets; of each component the smallest (doc_id, text hash) stays, with its equal rows."""
    docs = sorted({key(r) for r in rows if r.doc_id is not None}, key=lambda k: k[0])
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (k[1] or "").lower().split()) else set() for k in docs}
    root = {k: k for k in docs}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(docs, 2):
        x, y = sets[a], sets[b]
        if (not x and not y) or len(x & y) >= 0.8 * len(x | y):
            root[find(b)] = find(a)
    groups = defaultdict(list)
    for k in docs:
        groups[find(k)].append(k)
    kept = {min(g, key=lambda k: k[0]) for g in groups.values()}
    return Counter(key(r) for r in rows if r.doc_id is None or key(r) in kept)


def has_long_repeat(rows, n=60):
    """Documents that share n words in a row with one of a smaller doc_id."""
    first, found = {}, set()
    for k in sorted({key(r) for r in rows if r.doc_id is not None}, key=lambda k: k[0]):
        words = (k[1] or "").lower().split()
        for i in range(len(words) - n + 1):
            if first.setdefault(tuple(words[i : i + n]), k)[0] != k[0]:
                found.add(k)
    return found


def test_every_stage_equals_plain_python(spark):
    import corpus_pipeline
    import public_tokenizers
    import tiktoken

    stages = dict(corpus_pipeline.STAGES)
    given = table(spark, DATA, "documents")
    docs = given.unionByName(spark.createDataFrame(odd_rows(random.Random(12)), "text string, doc_id long, lang string, source string, n_chars long")).withColumn("row", F.lit("own"))
    labels = table(spark, DATA, "labels").collect()

    before = docs.collect()
    docs = written(stages["quality_rules"](spark, docs, DATA), "q")
    assert Counter(map(key, docs.collect())) == plain_quality(before, labels)

    # rejected rows come back in, so that the next stage has nulls, copies and repeated ids to judge
    docs = written(docs.unionByName(spark.createDataFrame([(*r, "own") for r in odd_rows(random.Random(12))], "text string, doc_id long, lang string, source string, n_chars long, row string")), "o")
    before = docs.collect()
    docs = written(stages["simhash_near_dedup"](spark, docs, DATA), "n")
    assert Counter(map(key, docs.collect())) == plain_dedup(before)

    before = docs.collect()
    docs = written(stages["substring_dedup"](spark, docs, DATA), "s")
    after = docs.collect()
    left = Counter(map(key, after))
    assert has_long_repeat(before) and not has_long_repeat(before) & {k for k in left if left[k]}
    by_id = defaultdict(list)
    for r in before:
        by_id[r.doc_id].append((r.text or "").split())
    for r in after:
        assert r.n_chars == len(r.text or "")
        words = iter
        assert any(all(w in rest for w in (r.text or "").split()) for rest in map(words, by_id[r.doc_id]))  # words in their order

    copies = {}
    for r in mixing.mix(docs, table(spark, DATA, "labels")).collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + r.copies
    docs = written(stages["mixing_to_targets"](spark, docs, DATA), "m")
    assert Counter(r.doc_id for r in docs.collect()) == +Counter(copies)

    with open(q.vocabulary(q.RANKS_50K), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((r.doc_id, tuple(library.encode_ordinary(r.text or ""))) for r in docs.collect())
    got = stages["bpe_encoding"](spark, docs, DATA).collect()
    assert Counter((r.doc_id, tuple(r.ids or ())) for r in got) == want and all(r.exact and r.n_tokens == len(r.ids or ()) for r in got)


def test_an_empty_table_goes_through_every_stage(spark):
    import corpus_pipeline

    docs = table(spark, DATA, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, DATA), name)
        assert docs.count() == 0
    assert passages.passages(table(spark, DATA, "documents").limit(0)).count() == 0
    assert simhash.near_duplicates(table(spark, DATA, "documents").limit(0), 4).count() == 0
