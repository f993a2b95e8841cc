"""Plans of the training-data operators: what grows with the input is never gathered in the driver."""

from __future__ import annotations

import random

from pulsegrid.llm import components, passages, simhash


def test_no_side_that_grows_is_broadcast(spark, monkeypatch):
    plans, real = [], simhash.written

    def seen(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return real(df, name)

    monkeypatch.setattr(simhash, "written", seen)
    monkeypatch.setattr(components, "written", seen)
    prints = spark.createDataFrame([(i, [i % 50 * 2**40]) for i in range(200)], "doc_id long, fps array<long>")
    found = simhash.components(prints, 4)
    plans.append(("result", found._jdf.queryExecution().executedPlan().toString()))
    assert found.count() == 200
    assert {"simhash-buckets", "cc", "simhash-roots", "result"} <= {n for n, _ in plans}
    # the flips of a table's bits are of fixed size; a side that was exploded looks small to Spark and isn't
    assert [n for n, p in plans if p.count("BroadcastHashJoin") > p.count("flip#")] == []
    assert all("BroadcastHashJoin" not in p for n, p in plans if n in ("simhash-buckets", "result"))


def test_an_inexact_passage_whose_seeds_all_have_other_documents(spark):
    """Documents with one part of a passage are the first and the previous ones of every seed; the one with all of it is between them."""
    rng = random.Random(9)
    fresh = lambda n: " ".join(f"{rng.randrange(10**9):x}" for _ in range(n))
    for trial in range(3):
        one, two = fresh(27), fresh(28)
        apart = [f"{fresh(90)} {part} {fresh(90)}" for part in (one, two)]
        whole = [f"{fresh(60)} {one} {fresh(1)} {two} {fresh(60)}" for _ in range(2)]
        texts = [*apart, whole[0], *[f"{fresh(90)} {part} {fresh(90)}" for part in (one, two)], whole[1]]
        rows = passages.passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
        assert [(r.doc_id, r.source, r.start, r.end, r.source_start, r.n_equal) for r in rows] == [(5, 2, 60, 116, 60, 55)]
        left = {r.doc_id: r.text for r in passages.drop_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
        assert one not in left[5] and two not in left[5] and [left[i] for i in range(5)] == texts[:5]


def test_copies_ask_for_no_further_documents(spark):
    rng = random.Random(4)
    text = " ".join(f"{rng.randrange(10**6):x}" for _ in range(150))
    docs = passages.keyed(spark.createDataFrame([(i, text) for i in range(40)], "doc_id long, text string"))
    found = passages.matched(passages.written(passages.seed_table(docs), "seeds"))
    first = passages.aligned(docs, passages.chain_table(passages.all_matches(docs, found)), 50, 0.8)
    assert first.select("doc_id").distinct().count() == 39
    assert passages.further_chains(docs, found, first).count() == 0


def test_the_pipeline_cuts_passages_of_further_documents(spark):
    """The stage of the pipeline, over documents with their other columns: the third document with all of a passage is the source."""
    import corpus_pipeline

    rng = random.Random(11)
    fresh = lambda n: " ".join(f"{rng.randrange(10**9):x}" for _ in range(n))
    one, two = fresh(29), fresh(26)
    texts = [f"{fresh(90)} {part} {fresh(90)}" for part in (one, two)]
    texts += [f"{fresh(60)} {one} {fresh(1)} {two} {fresh(60)}", *[f"{fresh(90)} {part} {fresh(90)}" for part in (one, two)], f"{fresh(60)} {one} {fresh(1)} {two} {fresh(60)}"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)["substring_dedup"]
    left = {r.doc_id: r for r in stage(spark, docs, "").collect()}
    assert [left[i].text for i in range(5)] == texts[:5] and len(left[5].text.split()) == 120 and left[5].n_chars == len(left[5].text)
