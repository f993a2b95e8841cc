"""The training-data operators against brute force, libraries and exact round trips, with odd inputs."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from pulsegrid.llm import bpe, language_model, licenses, media, mixing, passages, quality, registry, simhash, token_files, urls
from pulsegrid.llm import queries as q
from pulsegrid.llm.common import word_hashes

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "a", "don't  stop\n\n 'tis\r\n x", "é漢字 ٣١ \u2003wide\x85 \x1c", "a" * 3000, "ab'" * 900, "👍🏽 ok!!! ##", "\n".join(["same line"] * 30), " lead and trail \n"]


def frame(spark, texts, extra=""):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    letters = "aB's tre vell' 12  \n\t é漢٣!?.'\r 👍ab"
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(300)]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    with open(q.vocabulary(q.RANKS_50K), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_tables(spark, path, texts, labels=()):
    frame(spark, texts).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


# ---------------------------------------------------------------- 1: BPE
def test_bpe_equals_the_library_and_decodes(spark, texts, library, tmp_path):
    got = {r.doc_id: r for r in q.op1_bpe_codec(spark, write_tables(spark, tmp_path / "d", texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_offsets_give_the_pieces_and_an_empty_table_none(spark, texts):
    import public_tokenizers
    import regex

    path = q.vocabulary(q.RANKS_50K)
    coded = bpe.encode(frame(spark, texts), path)
    assert coded.first().piece_ends in (None, [])
    for decoded in (bpe.decode(coded.drop("text"), path), bpe.encode(frame(spark, texts), path, decoded=True)):
        for r in decoded.collect():
            want = [p.encode() for p in regex.findall(public_tokenizers.PATTERN, texts[r.doc_id] or "")]
            assert [bytes(r.decoded[a:b]) for a, b in zip([0, *r.piece_bytes], r.piece_bytes)] == want
    assert bpe.decode(bpe.encode(frame(spark, []), path), path).count() == 0


# ---------------------------------------------------------------- 2: token files
def test_token_files_equal_the_library(spark, texts, tmp_path):
    from tokenizers import Tokenizer

    texts = texts + ["<|endoftext|> said <|endoftext|>"]
    tokenizer = Tokenizer.from_file(q.vocabulary(q.TOKENIZER_50K))
    got = {r.doc_id: r for r in q.op2_token_files(spark, write_tables(spark, tmp_path / "d", texts)).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_files_are_in_document_order_and_hot_ids_spread(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i if i % 3 else None, " ".join(rng.choice("abcdefg") * 3 for _ in range(rng.randrange(30)))) for i in range(600)] + [(7, "same"), (7, "same"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("ids", F.lit("own")).withColumn("h", F.lit(1))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    folder = token_files.store(spark.read.parquet(f"{tmp_path}/documents.parquet"), q.vocabulary(q.TOKENIZER_50K), end=2)
    blocks = spark.read.parquet(f"{folder}/blocks").select("*", F.col("_metadata.file_name").alias("file"))
    files = sorted(blocks.groupBy("file").agg(F.min(F.coalesce("doc_id", F.lit(-1))).alias("a"), F.max(F.coalesce("doc_id", F.lit(-1))).alias("b")).collect(), key=lambda r: r.file)
    assert len(files) > 2 and all(x.b <= y.a for x, y in zip(files, files[1:]))
    assert sum(r.a == r.b == -1 for r in files) >= 1  # rows without an id are a third, and more than one file has them
    got = sorted(token_files.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    assert len(got) == len(rows) and [r.doc_id or -1 for r in got] == sorted(r.doc_id or -1 for r in got)
    assert all(x.start + x.n_ids == y.start for x, y in zip(got, got[1:]))
    empty = docs.limit(0).select("doc_id", "text")
    empty.write.parquet(f"{tmp_path}/empty.parquet")
    assert token_files.read_tokens(spark, token_files.store(spark.read.parquet(f"{tmp_path}/empty.parquet"), q.vocabulary(q.TOKENIZER_50K), end=2)).count() == 0


def test_codes_are_optimal_up_to_the_limit_and_prefix_free():
    counts = np.array([2**k for k in range(24)] + [0, 5])
    for limit in (6, 12, 25):
        n = token_files.code_lengths(counts, limit)
        used = n[n > 0].astype(int)
        assert used.max() <= limit and n[24] == 0 and abs(sum(0.5**used) - 1) < 1e-12
    assert token_files.code_lengths(np.array([0, 9, 0])).tolist() == [0, 1, 0]
    rng = np.random.default_rng(0)
    n = token_files.code_lengths(np.bincount(rng.zipf(1.3, 5000) % 300, minlength=300))
    ids = [rng.choice(np.flatnonzero(n), size=k) for k in (0, 1, 255, 256, 257, 3000)]
    coded = token_files.encode_blocks(ids, n, token_files.canonical(n))
    back = token_files.decode_blocks([(len(i), o, p) for i, (_, o, p) in zip(ids, coded)], token_files.decode_table(n))
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(ids, back))


# ---------------------------------------------------------------- 3: urls
def test_url_filter_equals_a_scan_over_rules(spark):
    hosts = ["com", "example.com", "m.Example.com", "xexample.com", "a.b.net", "example.net", "org", "", "example.net:80"]
    paths = ["", "/", "/en", "/en/", "/en/7", "/en/71/x", "/de/8", "/de/9/8", "/es/?q=/en/", "/es/x#f", "?a", "//en/7"]
    made = [f"https://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme/en/", "x://y://z/en/", "http://example.com/en/\0x", "http://example.com/en/7\n"]
    pages = spark.createDataFrame(list(enumerate(made)), "page_id long, url string").withColumns({"_found": F.lit(1), "found": F.lit(2), "rule": F.lit(3), "k0": F.lit(4)})
    found = urls.filter_urls(pages, q.URL_RULES)
    assert set(found.columns) == {"page_id", "url", "_found", "found", "k0", "host", "path", "rule", "verdict"}
    assert urls.filter_urls(pages.limit(0), q.URL_RULES).count() == 0
    rows = found.collect()
    assert len(rows) == len(made)
    for r in rows:
        rest = (r.url or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = host.lower()
        fits = [(h + p, v) for h, p, v in q.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_sql_twins(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{DATA}/pages.parquet'")
    want = con.execute(registry.oracle_sql()["op3_url_filter"]).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in q.op3_url_filter(spark, DATA).collect())


def test_a_long_segment_takes_time_in_proportion():
    import time

    trie = urls.build_trie([("example.com", f"/en/{'7' * k}", "allow") for k in range(1, 40)])
    assert urls.longest(trie, "example.com", "/en/" + "7" * 30 + "x") == ("example.com/en/" + "7" * 30, "allow")
    took = []
    for n in (100_000, 800_000):
        began = time.process_time()
        for _ in range(20):
            urls.longest(trie, "a.example.com", "/en/" + "7" * n)
        took.append(time.process_time() - began)
    assert took[1] < 40 * max(took[0], 0.001)


# ---------------------------------------------------------------- 4: passages
def brute_passages(texts, n=60):
    """Documents that share n words in a row with an earlier one."""
    first, found = {}, set()
    for i, t in enumerate(texts):
        w = (t or "").lower().split()
        for k in range(len(w) - n + 1):
            if first.setdefault(tuple(w[k : k + n]), i) != i:
                found.add(i)
    return found


def test_passages_find_every_long_repeat(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    shared = [[word() for _ in range(70)] for _ in range(3)]
    texts = []
    for i in range(60):
        own = [word() for _ in range(rng.randrange(80, 200))]
        if i % 2:
            at = rng.randrange(len(own))
            own[at:at] = shared[i % 3]
        texts.append(" ".join(own))
    near = texts[1].split()
    near[::20] = ["changed"] * len(near[::20])
    texts += [" ".join(near), None, "", "few words"]
    rows = passages.passages(frame(spark, texts)).collect()
    assert brute_passages(texts) <= {r.doc_id for r in rows} <= brute_passages(texts) | {60}
    assert 60 in {r.doc_id for r in rows}
    for r in rows:
        assert r.source < r.doc_id and r.end - r.start >= 50 and r.similarity >= 0.8
    kept = {r.doc_id: r for r in passages.drop_repeats(frame(spark, texts)).collect()}
    assert kept[0].text == texts[0] and kept[61].text is None
    repeated = " ".join(shared[1])
    assert sum(repeated in (r.text or "") for r in kept.values()) == 1
    assert all(r.n_chars == len(r.text or "") for r in kept.values())


def test_whole_copies_go_and_an_empty_table_stays_empty(spark):
    text = " ".join(f"w{i}" for i in range(120))
    assert {r.doc_id for r in passages.drop_repeats(frame(spark, [text] * 5)).collect()} == {0}
    assert passages.drop_repeats(frame(spark, [])).count() == 0


def random_words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(n)]


def test_chaining_in_reach_equals_all_pairs_behind_a_far_run():
    rng = random.Random(4)
    reach = passages.GAP + passages.K + passages.WINDOW
    for _ in range(200):
        own = sorted(rng.sample(range(620, 900), 25))
        x = np.array([*range(0, 500, 5), *own])
        y = np.array([*range(1000, 1500, 5), *(a + 1000 + rng.randrange(-20, 20) for a in own)])
        wide = np.array([rng.random() < 0.1 for _ in x])
        _, *ends = passages.runs(np.zeros(len(x), int), x, y, wide)
        x0, y0, x1, y1 = (a.tolist() for a in ends)
        best = []
        for i in range(len(x0)):
            gains = [best[j] - passages.GAP_COST * (x0[i] - x1[j] + y0[i] - y1[j]) for j in range(i) if y1[j] < y0[i] and max(x0[i] - x1[j], y0[i] - y1[j]) <= reach]
            best.append(x1[i] - x0[i] + passages.K + max([0, *gains]))
        assert np.allclose(passages.linked(x0, y0, x1, y1)[0], best)
    x, y = np.array([*range(0, 496, 5), 600, 608]), np.array([*range(1000, 1496, 5), 1600, 1609])
    _, *ends = passages.runs(np.zeros(len(x), int), x, y, np.zeros(len(x), bool))
    lists = [a.tolist() for a in ends]
    assert (600, 1600, 608, 1609) in [(lists[0][c[0]], lists[1][c[0]], lists[2][c[-1]], lists[3][c[-1]]) for c in passages.chains(*lists)]


def test_runs_of_groups_equal_a_plain_walk():
    rng = random.Random(14)
    rows = sorted({(rng.randrange(4), rng.randrange(200), rng.randrange(3) + rng.randrange(200) // 40 * 40, rng.random() < 0.1) for _ in range(400)})
    rows = [(g, x, x + d, w) for g, x, d, w in rows]
    want = []
    for g in range(4):
        for d in {y - x for h, x, y, _ in rows if h == g}:
            run = None
            for _, x, y, w in sorted(r for r in rows if r[0] == g and r[2] - r[1] == d):
                last = x + (passages.LONG - passages.K if w else 0)
                if run and x - run[1] <= passages.K + passages.WINDOW:
                    run[1] = max(run[1], last)
                else:
                    run = [x, last]
                    want.append((g, run, d))
    got = list(zip(*(c.tolist() for c in passages.runs(*(np.array(c) for c in zip(*rows))))))
    assert sorted(got) == sorted((g, a, a + d, b, b + d) for g, (a, b), d in want)


def test_passages_of_snippets_that_others_quote_are_found(spark):
    rng = random.Random(3)
    shared = random_words(rng, 80)
    texts = [" ".join(random_words(rng, 40) + shared[7 * k : 7 * k + 24] + random_words(rng, 40)) for k in range(8)]
    texts += [" ".join(random_words(rng, 60) + shared + random_words(rng, 60)) for _ in range(2)]
    rows = passages.passages(frame(spark, texts)).collect()
    assert {(r.doc_id, r.start, r.end) for r in rows} == {(9, 60, 140)} and rows[0].source == 8


def test_rows_that_share_an_id_are_cut_each_by_its_own_text(spark):
    rng = random.Random(6)
    shared, own = random_words(rng, 70), random_words(rng, 80)
    rows = [(1, " ".join(random_words(rng, 30) + shared)), (2, " ".join(own)), (2, " ".join(random_words(rng, 60) + shared)), (None, " ".join(shared)), (3, None), (3, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("v", F.lit("own")).withColumn("_spans", F.lit(0))
    got = sorted((r.doc_id or 0, len((r.text or "").split())) for r in passages.drop_repeats(docs).collect())
    assert got == [(0, 70), (1, 100), (2, 60), (2, 80), (3, 0), (3, 0)]


def test_the_scan_finds_first_and_previous_documents_across_partitions(spark):
    rng = random.Random(2)
    rows = sorted({(rng.choice([5, 5, 5, 6, 7, 8]), rng.randrange(40), 0, rng.randrange(30)) for _ in range(400)})
    seeds = spark.createDataFrame([(*r, False) for r in rows], passages.SEED).repartition(3)
    real, passages.seed_table = passages.seed_table, lambda docs: docs
    try:
        got = {tuple(r) for r in passages.matches(seeds).drop("wide").collect()}
    finally:
        passages.seed_table = real
    want = set()
    for h in {r[0] for r in rows}:
        docs = {}
        for _, d, _, p in (r for r in rows if r[0] == h):
            docs.setdefault(d, []).append(p)
        order = sorted(docs)
        for i, d in enumerate(order[1:], 1):
            want |= {(d, 0, s, 0, p, docs[s][0]) for p in docs[d] for s in (order[0], order[i - 1])}
    assert got == want


def test_every_exact_repeat_is_found_whatever_stands_before_it(spark):
    """Leads of 0 to 40 shared words, gaps of 1 to 40 changed ones, then 60 shared words; and loose chains beside them."""
    rng = random.Random(31)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    texts, want = [], {}
    for lead in range(0, 41, 4):
        for gap in range(1, 41, 3):
            shared, last, k = fresh(lead), fresh(60), len(texts)
            texts += [fresh(30) + shared + fresh(gap) + last + fresh(30), fresh(20) + shared + fresh(gap) + last + fresh(20)]
            want[k + 1] = (20 + lead + gap, 20 + lead + gap + 60)
    for _ in range(20):  # a long loose pair whose source also holds 70 words of it elsewhere
        loose = [fresh(18) for _ in range(12)]
        one = [w for part in loose for w in part + fresh(12)]
        two = [w for part in loose for w in part + fresh(12)]
        k = len(texts)
        texts += [one + fresh(40) + two[100:170] + fresh(40), two]
        want[k + 1] = (100, 170)
    for _ in range(10):  # sixty words within a text that goes on alike, but too loosely
        parts = [fresh(7) for _ in range(20)]
        whole = fresh(60)
        k = len(texts)
        texts += [[w for p in parts[:10] for w in p + fresh(9)] + whole + [w for p in parts[10:] for w in p + fresh(9)] for _ in range(2)]
        want[k + 1] = (160, 220)
    rows = passages.passages(frame(spark, [" ".join(t) for t in texts])).collect()
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, set()).update(range(r.start, r.end))
        assert r.source < r.doc_id and r.end - r.start >= 50 and r.similarity >= 0.8
    lost = {k: (a, b) for k, (a, b) in want.items() if len(found.get(k, set()) & set(range(a, b))) < b - a - 1}
    assert not lost


def test_alignment_goes_on_as_a_plain_walk_does():
    def resume(a, b, i, j, step):
        for total in range(1, 2 * passages.GAP + 1):
            for p in range(max(0, total - passages.GAP), min(passages.GAP, total) + 1):
                need = passages.SAME if 2 * p == total else passages.RUN
                at = [(i + step * (p + k), j + step * (total - p + k)) for k in range(need)]
                if all(0 <= x < len(a) and 0 <= y < len(b) and a[x] == b[y] for x, y in at):
                    return i + step * p, j + step * (total - p)
        return None

    rng = random.Random(17)
    for _ in range(3000):
        a = [rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randrange(1, 60))]
        b = [w for w in a if rng.random() > 0.1] if rng.random() < 0.7 else [rng.choice("abcd") for _ in range(30)]
        i, j, step = rng.randrange(len(a)), rng.randrange(max(1, len(b))), rng.choice((1, -1))
        n = 0
        while 0 <= i + step * n < len(a) and 0 <= j + step * n < len(b) and a[i + step * n] == b[j + step * n]:
            n += 1
        if b:
            assert passages._equal_words(a, b, i, j, step) == n
        i, j = i + step * n, j + step * n
        assert passages._resume(a, b, i, j, step) == resume(a, b, i, j, step), (a, b, i, j, step)


def test_parts_of_an_alignment_that_are_alike():
    assert passages.alike_stretches([(60, 60, 60)], 0.8) == [(0, 1)]
    assert passages.alike_stretches([(60, 60, 60), (15, 15, 0), (60, 60, 60)], 0.8) == [(0, 3)]
    assert passages.alike_stretches([(5, 5, 5), (16, 16, 0), (60, 60, 60), (16, 16, 0), (5, 5, 5), (16, 16, 0), (5, 5, 5)], 0.8) == [(0, 1), (2, 3), (4, 5), (6, 7)]
    rng = random.Random(2)
    for _ in range(200):
        parts = [(n, n, n) if k % 2 == 0 else (n, rng.randrange(1, 17), 0) for k, n in enumerate(rng.randrange(1, 40) for _ in range(15))]
        for lo, hi in passages.alike_stretches(parts, 0.8):
            left, right, equal = (sum(p[k] for p in parts[lo:hi]) for k in range(3))
            assert equal >= 0.8 * max(left, right)
        kept = {k for lo, hi in passages.alike_stretches(parts, 0.8) for k in range(lo, hi)}
        assert {k for k in range(0, 15, 2)} <= kept  # every stretch of equal words is in a part


def test_exact_repeats_are_found_whatever_other_documents_have_their_seeds(spark):
    """Each passage stands whole in one document; others before and after it quote all of it but a word at either end or more."""
    rng = random.Random(41)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    texts, want = [], {}
    for n in range(50, 56):
        shared = fresh(n)
        parts = [shared[:48], shared[-48:], shared[1:47], shared[3:49]]
        for part in (*parts, shared, *parts):
            texts.append(fresh(20) + part + fresh(20))
        want[len(texts)] = (len(texts) - len(parts) - 1, 30, 30 + n)
        texts.append(fresh(30) + shared + fresh(30))
    rows = passages.passages(frame(spark, [" ".join(t) for t in texts])).collect()
    assert {r.doc_id: (r.source, r.start, r.end) for r in rows} == want
    assert all(r.n_equal == r.end - r.start for r in rows)


def test_fuzzy_passages_are_mostly_found(spark):
    rng = random.Random(12)
    for n, share, least in ((80, 0.1, 0.9), (120, 0.15, 0.85)):
        texts = []
        for _ in range(60):
            words = random_words(rng, n)
            other = list(words)
            for k in rng.sample(range(1, n - 1), int(n * share)):
                other[k] = random_words(rng, 1)[0]
            texts += [" ".join(random_words(rng, 40) + own + random_words(rng, 40)) for own in (words, other)]
        found = {r.doc_id for r in passages.passages(frame(spark, texts)).collect()}
        assert len(found & set(range(1, 120, 2))) >= least * 60 and not found - set(range(1, 120, 2))


# ---------------------------------------------------------------- 5: simhash
def brute_components(fps, ids, radius=4):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (f, i), (g, j) in combinations(zip(fps, ids), 2):
        if (f ^ g).bit_count() <= radius:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprints_follow_the_contract(spark, texts, tmp_path):
    got = {r.doc_id: r for r in q.op5_simhash_components(spark, write_tables(spark, tmp_path / "d", texts)).collect()}
    fps = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    want = brute_components(fps, range(len(texts)))
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{f:016x}", want[i]) for i, f in enumerate(fps)}


@pytest.mark.parametrize(("direct", "radius"), [(4096, 4), (3, 4), (1, 3), (4096, 3)])
def test_covering_links_are_complete(spark, direct, radius):
    rng = random.Random(7)
    fps = []
    for _ in range(12):
        center = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            f = center
            for b in rng.sample(range(64), rng.randrange(0, 6)):
                f ^= 1 << b
            fps.append(f)
    rows = [(i, [f - (1 << 64) if f >> 63 else f]) for i, f in enumerate(fps)]
    got = simhash.components(spark.createDataFrame(rows, "doc_id long, fps array<long>"), radius, direct=direct).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(fps, range(len(fps)), radius)


def test_every_pair_within_the_radius_shares_a_table():
    masks = simhash.covering_masks(4)
    assert len(masks) == 31
    rng = random.Random(1)
    for _ in range(5000):
        flips = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not m & flips for m in masks)


def test_one_document_of_each_group_stays(spark):
    rng = random.Random(4)
    base = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)) for _ in range(6)]
    near = base[0].split()
    near[10] = "other"
    half = base[1].split()[:150] + base[3].split()[:150]
    docs = frame(spark, [*base, base[2], " ".join(near), base[2], " ".join(half)])
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == [0, 1, 2, 3, 4, 5, 9]
    assert simhash.drop_near_duplicates(frame(spark, [])).count() == 0
    odd = spark.createDataFrame([(None, base[0]), (1, base[0]), (1, base[0]), (2, None), (3, ""), (4, base[0])], "doc_id long, text string").withColumn("h", F.lit("own")).withColumn("node", F.lit(1))
    left = simhash.drop_near_duplicates(odd)
    assert left.columns == odd.columns and sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 1, 2]


def test_rows_that_share_an_id_are_judged_each_by_its_text(spark):
    rng = random.Random(8)
    a, b, c = (" ".join(random_words(rng, 120)) for _ in range(3))
    near = a.replace(a.split()[40], "other")
    for rows in ([(1, a), (2, a), (2, b)], [(1, a), (2, b), (2, a), (3, c), (3, b)], [(5, near), (5, a), (4, a), (4, b), (4, b), (None, a)]):
        for order in (rows, rows[::-1]):
            left = sorted(((r.doc_id or 0), r.text) for r in simhash.drop_near_duplicates(spark.createDataFrame(order, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("first", F.lit(2))).collect())
            want, seen = [], []
            for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
                family = "a" if t in (a, near) else t
                if family not in [f for f, _, _ in seen] or (family, i, t) in seen:
                    seen.append((family, i, t))
                    want.append((i, t))
            ids = lambda found: sorted(i for i, _ in found)
            assert ids(left) == ids([*want, *((0, t) for i, t in rows if i is None)])
            assert {t for _, t in left} >= {t for _, t in want if t not in (a, near)}


def test_near_duplicates_equal_all_pairs(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, simhash.shingle_set(r.text or "")) for r in docs.collect()]
    rng = random.Random(5)
    made = []
    for k in range(40):
        words = random_words(rng, 150)
        new = random_words(rng, 25)
        at = rng.randrange(150)
        made += [words, [words + new, new + words, words[:at] + new + words[at:], words[:130], [w if rng.random() > 0.015 else "zz" for w in words]][k % 5]]
    extra = [(100_000 + i, " ".join(w)) for i, w in enumerate(made)]
    rows += [(i, simhash.shingle_set(t)) for i, t in extra]
    pairs = [(i, j) for (i, a), (j, b) in combinations(rows, 2) if simhash.alike(a, b) >= 0.8]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs.union(spark.createDataFrame(extra, "doc_id long, text string"))).filter("NOT first").collect()}
    joined = sum(got.get(i, i) == got.get(j, j) for i, j in pairs)
    assert joined >= 0.95 * len(pairs)
    linked = {i for p in pairs for i in p}
    assert set(got) <= linked


def test_no_pair_of_similar_texts_is_missed(spark, monkeypatch):
    """Scattered edits beside added words, and groups that share half their words: no bucket of fingerprints holds every pair."""
    rng = random.Random(23)
    made = [None, "", " ", "\u2003", "one two", "ONE  two", "one two three"]
    for k in range(120):
        words = random_words(rng, 150)
        edited = [w if rng.random() > 0.012 else "zz" for w in words]
        at = rng.randrange(150)
        made += [" ".join(words), " ".join(edited[:at] + random_words(rng, 10 + k % 8) + edited[at:])]
    lead = random_words(rng, 60)
    for _ in range(12):
        own = lead + random_words(rng, 60)
        made += [" ".join(own), " ".join(own[:40] + own[45:])]
    rows = [(i, t) for i, t in enumerate(made)]
    sets = [set(simhash.shingle_set(t or "").tolist()) for t in made]
    root = list(range(len(made)))
    for i, j in combinations(range(len(made)), 2):
        a, b = sets[i], sets[j]
        if a == b or a and b and len(a & b) / len(a | b) >= 0.8:
            root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    assert got == dict(enumerate(root))
    # without the fingerprints' links the set join alone finds them
    monkeypatch.setattr(simhash, "links", lambda values, radius: spark.createDataFrame([], "part int, a long, b long"))
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()} == dict(enumerate(root))


def test_pairs_to_verify_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    """A large group of alike texts that no fingerprint links, and texts that share a passage, far from alike."""
    rng = random.Random(29)
    base, passage = random_words(rng, 300), random_words(rng, 60)
    made = [" ".join(base[: 4 * k] + random_words(rng, 4) + base[4 * k + 4 :]) for k in range(70)]
    made += [" ".join(random_words(rng, 60) + passage + random_words(rng, 60)) for _ in range(70)]
    seen, real = [], simhash.verified
    monkeypatch.setattr(simhash, "links", lambda values, radius: spark.createDataFrame([], "part int, a long, b long"))
    monkeypatch.setattr(simhash, "verified", lambda edges, *args: seen.append(edges.count()) or real(edges, *args))
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")).collect()}
    assert got == {i: 0 if i < 70 else i for i in range(140)}
    assert sum(seen) < 5 * 70, seen  # 70 * 69 / 2 pairs are alike


def test_windows_of_a_seed_are_one_match(spark):
    """A passage of many documents: a match for each of its long seeds, not one for each 50 words."""
    rng = random.Random(37)
    passage = random_words(rng, 200)
    texts = [" ".join(random_words(rng, 60) + passage + random_words(rng, 60)) for _ in range(12)]
    docs = passages.keyed(frame(spark, texts))
    found = passages.matched(passages.seed_table(docs)).filter("wide AND many")
    windows = passages.matched(passages.window_table(docs, found), windows=True)
    assert {r.doc_id for r in windows.collect()} >= set(range(1, 12))
    assert windows.count() < 2 * 11 * 200 / 4  # two for each of 151 windows and of 11 documents before
    rows = passages.passages(frame(spark, texts)).collect()
    assert {r.doc_id for r in rows if r.end - r.start >= 200} == set(range(1, 12))


def test_quick_hashes_of_words_are_those_of_split_words():
    rng = random.Random(31)
    texts = ["", " ", "A", "a b", "\x1c a\x0bB\tc\r\n", "\u00e9\u2003 x\x00y \u0130"] + [" ".join(random_words(rng, rng.randrange(40))) for _ in range(50)]
    for some in ([], texts[:2], texts):
        words, sizes = word_hashes(some)
        split = [w for t in some for w in t.encode().lower().split()]
        assert sizes.tolist() == [len(t.encode().lower().split()) for t in some] and len(words) == len(split)
        assert len(set(zip(words.tolist(), split))) == len(set(words.tolist())) == len(set(split))


# ---------------------------------------------------------------- 6: mixing
def test_rates_meet_the_targets_and_toxic_documents_go(spark):
    rng = random.Random(8)
    common = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(300)]
    rows, labels = [], []
    for i in range(240):
        words = [rng.choice(common) for _ in range(80)]
        if i % 4 == 0:
            words[5::20] = ["vile", "rotten", "nasty", "foul"]
        rows.append(" ".join(words))
        if i < 160:
            labels.append((i, 1, int(i % 4 == 0)))
    docs, lab = frame(spark, [*rows, None, ""]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    targets = {"clean": 1.0, "low": 0.75, "toxic": 0.05}
    got = {r.doc_id: r for r in mixing.mix(docs, lab, targets).collect()}
    assert len(got) == 242 and got[240].n_tokens == 0
    held_out = range(160, 240)
    right = sum((got[i].copies == 0) == (i % 4 == 0) for i in held_out)
    assert right >= 76
    steps, totals = mixing.fit_rates(mixing.memberships(docs, mixing.fit(mixing.labelled_sample(docs, lab))).select("n_tokens", "p"))
    assert all(abs(a - b) <= 0.02 * sum(totals["natural"]) for a, b in zip(totals["target"], totals["reached"]))
    assert {r.doc_id for r in mixing.apply_mix(docs, lab, targets).collect()} == {i for i, r in got.items() if r.copies}
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert mixing.apply_mix(docs, none).count() == 242


def test_totals_of_the_rows_returned_meet_the_targets(spark):
    rng = random.Random(9)
    sets = [["".join(rng.choice(abc) for _ in range(4)) for _ in range(200)] for abc in ("abcdef", "ghijkl", "mnopqr")]
    rows = [" ".join(rng.choice(sets[i % 3]) for _ in range(60)) for i in range(9000)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 != 1), int(i % 3 == 2)) for i in range(600)], "doc_id long, quality int, toxic int")
    for targets in (mixing.TARGETS, {"clean": 1.3, "low": 0.4, "toxic": 0.05}):
        got = mixing.mix(docs, labels, targets).collect()
        natural, reached = (sum(r.n_tokens * k * np.array(r.p) for r, k in zip(got, ks)) for ks in ([1] * len(got), [r.copies for r in got]))
        want = natural * [targets[d] for d in mixing.DOMAINS]
        assert (np.abs(reached - want) <= 0.02 * natural).all(), (targets, reached / natural)
        assert Counter(r.doc_id for r in mixing.apply_mix(docs, labels, targets).collect()) == +Counter({r.doc_id: r.copies for r in got})


def test_rates_equal_a_plain_least_squares_solver(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.4, 0.3, 0.2], 300)
    n = rng.integers(1, 200, 300)
    members = spark.createDataFrame([(int(k), [float(x) for x in row]) for k, row in zip(n, p)], "n_tokens long, p array<double>")
    targets = {"clean": 1.2, "low": 0.6, "toxic": 0.3}
    steps, totals = mixing.fit_rates(members, targets, rounds=400, tolerance=1e-7)
    natural = n @ p
    want = natural * [targets[d] for d in mixing.DOMAINS]
    w = np.ones(300)  # plain projected gradient, one document's step scaled by 1 / n
    a = (p * n[:, None]) / natural
    slope = np.linalg.eigvalsh(a.T @ (a / n[:, None])).max()
    for _ in range(20_000):
        w = np.maximum(0.0, w - a @ ((a.T @ w) - want / natural) / n / slope)
    got = mixing.rates(p, steps)[0]
    assert np.abs((n * got) @ p - want).max() <= 1e-4 * natural.max() and np.abs((n * w) @ p - want).max() <= 1e-4 * natural.max()
    assert np.allclose(totals["reached"], (n * got) @ p)


def test_repeated_ids_keep_the_sample_bounded_and_copies_stay(spark):
    rows = [(i % 5, f"word{i % 7} text {i}", "own") for i in range(300)] + [(None, "no id", "own"), (3, None, "own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").withColumn("p", F.lit(1)).withColumn("copies", F.lit(2))
    labels = spark.createDataFrame([(i, 1, int(i == 4)) for i in range(5)] + [(None, 0, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert len(mixing.labelled_sample(docs, labels)) == 5
    assert mixing.apply_mix(docs, labels).columns == docs.columns and mixing.mix(docs, labels).count() == 302
    assert mixing.mix(docs.limit(0), labels).count() == 0


def test_the_fit_holds_one_matrix_of_the_sample_whatever_its_blocks(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 3000, 2500) + 1500 * d, return_counts=True) for d in range(3) for _ in range(300)]
    sample = [(i // 300, np.stack(x).astype(np.int32)) for i, x in enumerate(rows)]
    sample[7] = (0, np.array([[mixing.BUCKETS - 1], [3]], np.int32))  # nothing of it is in enough documents
    entries = sum(x.shape[1] for _, x in sample)
    assert entries > 10 * mixing.BLOCK
    tracemalloc.start()
    whole = mixing.fit(sample, steps=5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 * entries, peak / entries
    for block in (1, 1 << 30):
        monkeypatch.setattr(mixing, "BLOCK", block)
        assert np.allclose(mixing.fit(sample, steps=5), whole, rtol=1e-5, atol=1e-7)


# ---------------------------------------------------------------- 7: media
def test_compact_pcm_is_without_loss():
    rng = np.random.default_rng(6)
    few = rng.integers(-32768, 32768, 200).astype(np.int16)
    made = [rng.integers(-32768, 32768, n).astype(np.int16) for n in (1, 2, 3, 64, 257, 10_001)] + [few[rng.integers(0, 200, n)] for n in (1, 100, 9000)]
    made += [media.resample(x, 8000, 16000) for x in made] + [np.array([-32768, 32767] * 40, np.int16)]
    for pcm in made:
        assert (media.expanded(media.compact(pcm)) == pcm).all()
    voice = media.resample(media.mulaw_table()[rng.integers(0, 256, 5000)].astype(np.int16), 8000, 16000)
    assert len(media.compact(voice)) < 5000 + 600


def test_audio_round_trip(spark, texts, tmp_path):
    got = {r.doc_id: r for r in q.op7_telephony_audio(spark, write_tables(spark, tmp_path / "d", texts)).collect()}
    for i, t in enumerate(texts):
        n, payload = media.text_payload(t)
        r = got[i]
        assert len(payload) % 64 == 0 and len(payload) > 0 and payload[:n] == (t or "").encode() and not any(payload[n:])
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (n, len(payload), zlib.crc32(payload[-64:]))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_sha256 == hashlib.sha256(media.wav(payload, r.format)).hexdigest()
        tag, _, stored = media.parse_wav(media.wav(payload, r.format))
        pcm = media.resample(media.decoded(tag, stored), 8000, 16000).astype("<i2")
        assert r.feature.startswith(f"peak={np.abs(pcm.astype(int)).max()};") and r.feature.endswith(f"pcm={zlib.crc32(pcm.tobytes()):08x}")
    assert got[0].feature == got[1].feature and {r.format for r in got.values()} == {media.MULAW, media.ALAW, media.IMA_ADPCM}


def test_columns_of_every_format_decode_and_bad_files_give_null(spark):
    data = bytes(range(256)) * 2
    rows = [(t, media.wav(data, t)) for t in (media.MULAW, media.ALAW, media.IMA_ADPCM)]
    rows += [(0, None), (0, b""), (0, b"RIFF"), (0, media.wav(data)[:30]), (0, media.wav(data, 99)), (1, media.wav(data)[:-100]), (0, b"x" * 500), (0, media.wav(data, rate=0))]
    df = spark.createDataFrame(rows, "tag int, media binary").withColumn("format", F.lit("own")).withColumn("feature", F.lit(1))
    for r in media.with_features(media.stored(media.decode_media(df), "pcm")).collect():
        if not r.tag:
            assert r.payload is None and r.feature is None and r.format is None
        elif r.tag > 1:
            assert bytes(r.payload) == data and r.format == r.tag
        else:
            assert bytes(r.payload) == data[:-100]
    assert media.decode_media(df.limit(0)).count() == 0


def test_decoders_against_plain_loops():
    table = media.mulaw_table()
    assert (table[0], table[0x7F], table[0x80], table[0xFF]) == (-32124, 0, 32124, 0)
    assert (media.alaw_table()[0xD5], media.alaw_table()[0x55], media.alaw_table()[0xAA]) == (8, -8, 32256)
    rng = random.Random(0)
    data = bytes(rng.randrange(256) for _ in range(media.BLOCK * 5))
    want = []
    for k in range(0, len(data), media.BLOCK):
        block = data[k : k + media.BLOCK]
        value, index = struct.unpack("<h", block[:2])[0], min(block[2], 88)
        want.append(value)
        for byte in block[4:]:
            for code in (byte & 15, byte >> 4):
                step = media.STEPS[index]
                change = (step >> 3) + (step >> 2 if code & 1 else 0) + (step >> 1 if code & 2 else 0) + (step if code & 4 else 0)
                value = max(-32768, min(32767, value - change if code & 8 else value + change))
                index = max(0, min(88, index + media.MOVES[code & 7]))
                want.append(value)
    assert media.adpcm_blocks(np.frombuffer(data, np.uint8)).ravel().tolist() == want
    assert media.parse_wav(media.wav(data, media.IMA_ADPCM)) == (media.IMA_ADPCM, 8000, data)


# ---------------------------------------------------------------- 8: quality
def brute_base(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_base_rules_and_verdicts(spark, texts, tmp_path):
    rng = random.Random(6)
    good = [" ".join(rng.choice(["the", "cat", "sat", "on", "mat", "and", "dog", "ran"]) + rng.choice("abcde") for _ in range(90)) for _ in range(40)]
    junk = [" ".join("".join(rng.choice("QXZ#%&") for _ in range(6)) for _ in range(90)) for _ in range(10)]
    every = texts + good + junk
    n = len(texts)
    path = write_tables(spark, tmp_path / "d", every, [(n + i, 1, 0) for i in range(30)])
    got = {r.doc_id: r for r in q.op8_quality_rules(spark, path).collect()}
    for i, t in enumerate(every):
        r, want = got[i], brute_base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    assert not any(got[n + 40 + i].kept for i in range(10))
    assert all(got[n + i].kept for i in range(40) if not got[n + i].base_failed)


def test_scores_equal_plain_ratios(spark, texts):
    rng = random.Random(16)
    every = texts[:80] + [" ".join(random_words(rng, 60)) for _ in range(20)]
    docs = frame(spark, every).withColumn("good", F.lit("own")).withColumn("bucket", F.lit(0))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(80, 95)] + [(80, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")

    def grams(t):
        d = (t or "").encode()
        return [(int.from_bytes(d[i : i + 4], "little") * 2654435761 % 2**32) >> 14 for i in range(len(d) - 3)]

    raw, good = Counter(g for t in every for g in grams(t)), Counter(g for t in every[80:95] for g in grams(t))
    n, m, b = sum(raw.values()), sum(good.values()), quality.BUCKETS
    ratio = lambda g: math.log((1 - quality.RAW_SHARE) * good[g] / m / ((raw[g] + 1) / (n + b)) + quality.RAW_SHARE)
    for r in quality.quality_rules(docs, labels).collect():
        own = grams(every[r.row.doc_id])
        want = sum(map(ratio, own)) / max(len(own), 1)
        assert abs(r.score - want) < 1e-5 and r.kept == (not r.base_failed and r.score >= quality.THRESHOLD)
    assert quality.keep_good(docs.limit(0), labels).count() == 0


# ---------------------------------------------------------------- 9: licenses
def test_base_phrases_and_exact_containment(spark):
    made = [None, "", "Under the MIT license: under the mit  License!", "xunder the mit license", "CC-BY-NC and Apache License, Version 2", "Licensed under the Apache License, Version 2.0.", "this work is licensed under a gnu general public license version 3", "of the " * 200 + "\nReleased under MIT License"]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, made)).collect()}
    assert [p.word for p in got[2].places] == [0, 4] and not got[3].places
    assert {p.label for p in got[4].places} == {"cc-by-nc", "apache-2"}
    for i, t in enumerate(made):
        want = set()
        for label, need, template in licenses.TEMPLATES:
            words = set(licenses.words_of(template))
            must, barred = ({w.lstrip("-").encode() for w in need.split() if (w[0] == "-") == minus} for minus in (False, True))
            for _, at, block in licenses.blocks(t or "", [licenses.window_of(template)]):
                share = len(words & set(block)) / len(words)
                if share >= licenses.THRESHOLD and must <= set(block) and not barred & set(block):
                    want.add((label, at, round(share, 9)))
        assert {(m.label, m.word, round(m.containment, 9)) for m in got[i].matches} == want
    assert {m.label for m in got[5].matches} >= {"apache-2"} and {m.label for m in got[7].matches} == {"mit"}


def test_labels_need_what_tells_licenses_apart(spark):
    made = ["Licensed under the Mozilla Public License, Version 2.0", "released under the same license", "This work is licensed under the GNU General Public License, version 2.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."]
    docs = frame(spark, [*made, None, ""]).withColumn("places", F.lit("own")).withColumn("n_words", F.lit(1))
    got = {r.doc_id: {m.label for m in r.matches} for r in licenses.scan(docs).collect()}
    assert [got[i] for i in range(6)] == [{"mpl-2"}, set(), {"gpl-2"}, {"cc-by-nc"}, set(), set()]
    assert licenses.scan(docs.limit(0)).count() == 0
    for label, _, text in licenses.TEMPLATES:
        assert label in {m.label for m in licenses.scan(frame(spark, [text.replace(" the ", "\n the ")])).first().matches} if len(text) > 300 else True


def test_wrapped_headers_and_long_templates_meet(spark):
    gpl = "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy */"
    long = " ".join(f"w{i}" for i in range(150))
    made = [gpl, bsd, mpl, "x y z\n" * 70 + bsd, long.replace(" w75", "\nw75"), None, "\n \n"]
    got = {r.doc_id: {m.label for m in r.matches} for r in licenses.scan(frame(spark, made), [*licenses.TEMPLATES, ("long", "w3", long)]).collect()}
    assert [got[i] for i in range(7)] == [{"gpl"}, {"bsd"}, {"mpl-2"}, {"bsd"}, {"long"}, set(), set()]


# ---------------------------------------------------------------- 10: language model
def plain_model(texts, order):
    """Modified Kneser-Ney by dictionaries: a function from (context, character) to a probability."""
    mark = "\0"
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        s = mark * (order - 1) + " ".join(t.split())
        counts[order].update(s[i - order + 1 : i + 1] for i in range(order - 1, len(s)))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cuts = []
    for k in range(order + 1):
        of = Counter(counts[k].values())
        cuts.append(language_model.Model._discounts([of[c] for c in range(1, 5)]))
    cut = lambda k, a: cuts[k][min(a, 3) - 1]
    contexts = [{} for _ in range(order + 1)]
    for k in range(1, order + 1):
        for g, a in counts[k].items():
            total, lost = contexts[k].get(g[:-1], (0, 0.0))
            contexts[k][g[:-1]] = total + a, lost + cut(k, a)
    letters = len(counts[1]) + 1

    def p(gram):
        k = len(gram)
        below = 1 / letters if k == 1 else p(gram[1:])
        total, lost = contexts[k].get(gram[:-1], (0, 0))
        if not total:
            return below
        a = counts[k][gram]
        return (a - cut(k, a) if a else 0) / total + lost / total * below

    return p


def test_scores_equal_a_plain_model(spark):
    rng = random.Random(3)
    train = [" ".join(rng.choice(["banana", "band", "bandana", "an", "and", "cab", "nab", "é漢"]) for _ in range(rng.randrange(1, 40))) for _ in range(30)]
    docs = frame(spark, train)
    asked = [*train[:5], "a  new\tbandana ", "xyz é漢漢 👍", "", None, " ", "b" * 3000]
    for order in (2, 3, 5):
        model = language_model.Model(docs.select(F.col("text")).rdd.map(lambda r: (bytearray(zstandard.ZstdCompressor().compress(r.text.encode())),)).toDF("z binary"), order)
        p = plain_model(train, order)
        got = {r.doc_id: r for r in language_model.score(frame(spark, asked), model).collect()}
        for i, t in enumerate(asked):
            s = " ".join((t or "").split())
            padded = "\0" * (order - 1) + s
            want = sum(math.log(p(padded[k : k + order])) for k in range(len(s)))
            assert got[i].n_chars == len(s) and abs(got[i].log_p - want) <= 1e-5 * max(1, abs(want)), (order, t)


def test_word_order_counts_and_odd_rows_are_scored(spark):
    rng = random.Random(13)
    chain = {w: rng.sample("river water stone tree cloud bird leaf sand".split(), 2) for w in "river water stone tree cloud bird leaf sand".split()}

    def text():
        words = ["river"]
        while len(words) < 80:
            words.append(rng.choice(chain[words[-1]]))
        return words

    made = [text() for _ in range(120)]
    shuffled = [rng.sample(w, len(w)) for w in made[-20:]]
    rows = [(i, "en", " ".join(w)) for i, w in enumerate(made + shuffled)] + [(None, None, "river water")] * 3 + [(5, "en", "river"), (200, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("block", F.lit("own")).withColumn("gram", F.lit(1))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(None, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")
    got = language_model.classify(docs, labels).collect()
    assert len(got) == len(rows)
    of = {r.doc_id: r.perplexity for r in got if r.doc_id is not None and r.n_chars > 100}
    assert max(of[i] for i in range(100, 120)) < min(of[120 + i] for i in range(20))
    assert language_model.classify(docs.limit(0), labels).count() == 0


def test_strange_text_is_less_likely(spark, texts):
    rng = random.Random(9)
    plain = [" ".join(rng.choice(["river", "water", "stone", "tree"]) for _ in range(60)) for _ in range(60)]
    strange = [" ".join("".join(rng.choice("QXZ#%&") for _ in range(6)) for _ in range(60)) for _ in range(5)]
    docs = frame(spark, plain + strange + [None, ""])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in language_model.classify(docs, labels).collect()}
    assert sum(got[i].kept for i in range(60)) >= 55 and not any(got[60 + i].kept for i in range(5))
    assert got[65].kept and got[65].perplexity == 1.0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.kept for r in language_model.classify(docs, none).collect())


# ---------------------------------------------------------------- pipeline
def test_pipeline_stages_keep_columns_and_clean_documents(spark):
    import corpus_pipeline
    from pulsegrid.llm.common import table, written

    docs = table(spark, DATA, "documents").withColumn("kept", F.lit("own")).withColumn("row", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, docs, DATA), name)
        assert after.columns == docs.columns
        assert after.count() <= docs.count()
        docs = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert last.count() == docs.count() and last.filter("NOT exact").count() == 0


def test_a_worker_gives_its_free_memory_back():
    import ctypes

    import pyarrow as pa
    from pulsegrid.llm import common

    def used():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    for _, texts in common.chunks(iter([pa.RecordBatch.from_pydict({"text": ["some words of a text"]})])):
        common.word_hashes(texts)
        assert common._powers.cache_info().currsize == 1
    assert common._powers.cache_info().currsize == 0
    if hasattr(ctypes.CDLL(None), "malloc_trim"):
        arrays = [np.ones(8000) for _ in range(2000)]  # 128 MB, and one array behind them that stays
        before, last = used(), arrays.pop()
        del arrays
        common.released()
        assert len(last) and used() < before - 100_000_000
