"""The manifest, personal data and periodic runs against brute force, libraries' rules and odd inputs."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import merkle, personal, repetitions, sql
from pulsegrid.llm import queries as q

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "a", "é漢字 \u2003wide\x85 \x1c", "a " * 3000, "👍🏽 ok!!! ##", "\n".join(["same line"] * 30), " lead and trail \n"]
CLASHING = ["tree", "place", "block", "row", "h", "l0", "node", "k", "spans", "runs", "total", "at"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def frame(spark, rows):
    found = spark.createDataFrame(rows, DOCS)
    return found.withColumns({c: F.lit("own") for c in CLASHING})


def save(docs, path):
    docs.write.parquet(f"{path}/documents.parquet")
    return str(path)


# ---------------------------------------------------------------- 11: the manifest
def brute_manifest(rows):
    """Roots and proofs by loops over lists; rows: doc_id, text, lang, source, n_chars."""

    def leaf(r, text):
        values = (r[0], r[3], r[2], r[4], text)
        return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
        return out

    def steps(tree, i):
        out = []
        for level in tree[:-1]:
            begin = i // 8 * 8
            out.append(("".join(level[begin:i]), "".join(level[i + 1 : begin + 8])))
            i //= 8
        return out

    langs = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))):
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: levels([leaf(r, r[1]) for r in langs[x]]) for x in order}
    top = levels([trees[x][-1][0] for x in order])
    found = []
    for at, x in enumerate(order):
        for i, r in enumerate(langs[x]):
            path = steps(trees[x], i) + steps(top, at)
            text = r[1]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            node = leaf(r, text)
            for a, b in path:
                node = sha(a, node, b)
            found.append((r[0], leaf(r, r[1]), trees[x][-1][0], top[-1][0], sha(*[a + b for a, b in path]), node, node == top[-1][0]))
    return sorted(found, key=str)


def manifest_rows(spark, path):
    return sorted((tuple(r) for r in q.op11_merkle_manifest(spark, path).collect()), key=str)


@pytest.mark.parametrize("n", [0, 1, 8, 9, 700, 4700])
def test_manifest_equals_loops(spark, tmp_path, n):
    rng = random.Random(n)
    langs = [None, "", "de", "é", "=", *(f"l{k}" for k in range(10))]
    rows = [(i * 3 if i % 7 else None, rng.choice(ODD + ["Big Letters", "É only"]), "en" if n < 9 or rng.random() < 0.8 else rng.choice(langs), rng.choice([None, "", "s"]), rng.choice([None, 0, -4, 12])) for i in range(n)]
    rows += rows[: n // 50] + [(r[0], "other", *r[2:]) for r in rows[: n // 50]]
    path = save(frame(spark, rows).repartition(5), tmp_path / "d")
    assert manifest_rows(spark, path) == brute_manifest(rows)


def test_proofs_fold_to_the_root(spark):
    rows = [(i, f"text {i}", "en" if i % 3 else "fr", "s", i) for i in range(1200)]
    found = merkle.manifest(frame(spark, rows)).collect()
    assert len(found) == 1200 and all(r.verified for r in found) and {r.lang for r in found} == {"en", "fr"}
    assert all(hashlib.sha256(r.siblings.encode()).hexdigest() == r.proof_sha256 for r in found)
    changed = merkle.manifest(frame(spark, rows), tampered=F.col("doc_id") == 7, change=lambda t: F.concat(t, F.lit("!"))).collect()
    assert [r.doc_id for r in changed if not r.verified] == [7] and changed[0].root == found[0].root


@pytest.mark.parametrize("name", sorted(sql.ORACLE))
def test_operators_equal_their_twins(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{DATA}/{file}'")
    found = con.execute(sql.ORACLE[name])
    columns = [c[0] for c in found.description]
    rows = getattr(q, name)(spark, DATA)
    assert sorted(rows.columns) == sorted(columns)
    assert sorted(map(str, found.fetchall())) == sorted(str(tuple(r)) for r in rows.select(*columns).collect())


# ---------------------------------------------------------------- 12: personal data
def luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    """The four patterns as the contract has them."""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found)


PIECES = ["@", "@@", "a.b", "x", ".", "..", "-", " ", "+", "1", "12", "255", "256", "0", "4111111111111111", "4111 1111-1111 1111", "(", ")", "mail.example.com", "me@", "+1 (212) 555-0100", "192.168.0.1", "é", "漢", "👍", "%", "_", "\n", "://", "http://u:p@h", "token", " = ", '"a1b2c3d4e5f6a7b8c9"', "iban ", "DE89 3704 0044 0532 0130 00", "account no 12345678", "ssn 123-45-6789", "00001.2.3.4.5"]


def test_base_spans_equal_the_patterns(spark, tmp_path):
    rng = random.Random(5)
    texts = ODD + ["1" * 500, "1.1." * 200, "a@" * 300, "a@b.c" * 100, "+1" * 200, "+1 " + "(" * 400, "4" * 12 + " " + "4" * 30, "x@y.z." + "é" * 10 + "\u0661\u0662"]
    texts += ["".join(rng.choice(PIECES) for _ in range(rng.randrange(14))) for _ in range(6000)]
    anchors = personal.automaton()
    for t in texts:
        found = personal.spans(t or "", anchors)
        assert [s for s in found if s[1] < 4] == base_spans(t or ""), t
        assert found == sorted(found) and all(0 <= a < b <= len(t) for a, _, b in found)
    rows = [(i if i % 5 else None, t, "en", "s", 1) for i, t in enumerate(texts[:400])]
    path = save(frame(spark, [*rows, rows[3], rows[3]]), tmp_path / "d")
    want = []
    for i, t, *_ in [*rows, rows[3], rows[3]]:
        found = base_spans(t or "")
        joined = ",".join(f"{personal.KINDS[k]}:{a}:{b}" for a, k, b in found)
        every = ",".join(f"{personal.KINDS[k]}:{a}:{b}" for a, k, b in personal.spans(t or "", anchors))
        want.append((i, *[sum(s[1] == k for s in found) for k in range(4)], hashlib.sha256(joined.encode()).hexdigest(), every))
    assert sorted(map(str, (tuple(r) for r in q.op12_personal_data(spark, path).collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("text, want", [
    ("see https://joe:s3cret@host.example/x", ["login:12:22"]),
    ("see https://host:80/a:b@c and ftp://joe@host", []),
    ("IBAN: DE89 3704 0044 0532 0130 00 thanks", ["iban:6:33"]),
    ("iban GB82WEST12345698765432, and iban GB82WEST12345698765433", ["iban:5:27"]),
    ("Account number 12-345-678, account 12", ["account:15:25"]),
    ("my ssn is", []),
    ("SSN: 123-45-6789", ["account:5:16"]),
    ("discount 12345678 accounted 12345678", []),
    ('token = "b44e15e09f0d41aa90cc"', ["secret:9:29"]),
    ("password: short1 and secret=abcdefghijklmnopqrst, tokens = a1b2c3d4e5f6a7b8c9", []),
])
def test_cues_and_schemes_expand(text, want):
    found = personal.spans(text, personal.automaton())
    assert [f"{personal.KINDS[k]}:{a}:{b}" for a, k, b in found if k >= 4] == want


def test_redaction_and_an_empty_table(spark):
    rows = [(1, "mail a@b.cd or +1 (212) 555-0100.", "en", "s", 1), (2, None, None, None, None)]
    found = {r.doc_id: r for r in personal.personal_data(frame(spark, rows), redact=True).collect()}
    assert found[1].redacted == "mail <email> or <phone>." and found[2].redacted == "" and found[2].spans == []
    assert personal.personal_data(frame(spark, [])).count() == 0


def test_long_texts_take_time_in_proportion():
    import time

    anchors, took = personal.automaton(), []
    for n in (20_000, 160_000):
        began = time.process_time()
        for piece in ("a@", "1.", "+1 ", "1 ", "x://", "token ", "iban AA11", "a.b-c"):
            personal.spans(piece * n, anchors)
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0]


# ---------------------------------------------------------------- 13: periodic runs
def brute_runs(words):
    n, found = len(words), set()
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(6, 4 * p):
                found.add((i, j - i + p, p))
            i = max(j, i + 1)
    smallest = {}
    for s, length, p in found:
        smallest[s, length] = min(p, smallest.get((s, length), p))
    return sorted((s, length, p) for (s, length), p in smallest.items())


def planted(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is None or h % 10 or not words:
        return words
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def brute_row(doc_id, text):
    words = planted(re.findall(r"[^\x20\x09-\x0D]+", text or ""), doc_id)
    found = brute_runs(words)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(*[f"{s},{n},{p}\n" for s, n, p in found]), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def made_texts(rng, count, most=60):
    out = []
    for _ in range(count):
        words = []
        while len(words) < rng.randrange(1, most):
            unit = [rng.choice("abc") for _ in range(rng.randrange(1, 6))]
            words += unit * rng.choice([1, 1, 2, 4, 5, 7]) + unit[: rng.randrange(3)]
        out.append(rng.choice([" ", "  ", "\n", "\t"]).join(words))
    return out


def test_runs_equal_brute_force(spark, tmp_path):
    rng = random.Random(9)
    texts = ODD + ["x y " * 40, "a\x1cb a\x85b " * 9, "a " * 5, "a " * 6, "a b a b a b a", "a b a b a b a b"] + made_texts(rng, 1500)
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(200))) for _ in range(100)]
    texts += [" ".join(map(str, range(n))) + (" " + " ".join(f"w{i % p}" for i in range(r))) for n, p, r in ((10, 37, 150), (0, 64, 256), (3, 65, 261), (500, 33, 131))]
    rows = [(i if i % 9 else None, t, "en", "s", 1) for i, t in enumerate(texts)]
    rows += rows[40:44] * 3 + [(7, "a b " * 9, "en", "s", 1)]
    got = q.op13_periodic_runs(spark, save(frame(spark, rows), tmp_path / "d"))
    want = sorted(map(str, (brute_row(r[0], r[1]) for r in rows)))
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert repetitions.collapse_runs(frame(spark, [])).count() == 0


def test_collapsed_text_and_copies_in_a_chunk(spark):
    long = " ".join(f"w{i}" for i in range(5000))
    rows = [(1, "go " * 9 + "on", "en", "s", 1), (2, long, "en", "s", 1), (3, long, "en", "s", 1), (4, (long + " ") * 4, "en", "s", 1)]
    found = {r.doc_id: r for r in repetitions.collapse_runs(frame(spark, rows).coalesce(1)).collect()}
    assert found[1].collapsed == "go on" and found[1].n_words == 10 and tuple(found[1].best) == (0, 9, 1)
    assert found[2].runs == found[3].runs == [] and found[2].collapsed == long
    assert tuple(found[4].best) == (0, 20000, 5000) and found[4].collapsed == long


def test_runs_of_random_arrays():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5, 40, 90):
        for _ in range(150):
            words = rng.integers(0, rng.integers(1, 4) + 1, n)
            got = repetitions.runs_of_texts([[str(w).encode() for w in words]])[0]
            assert list(map(tuple, got.tolist())) == brute_runs(words.tolist())
