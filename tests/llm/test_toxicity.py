"""Held-out accuracy on planted words, gradients by differences, cases that must not crash."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayledger.llm import toxicity

from .cases import documents, prose

BAD = ("vilething", "rotthing", "awfulness")


def rows(n, seed):
    rng, out = random.Random(seed), []
    for k in range(n):
        lang = rng.choice(["en", "de", "fr"])
        words, toxic = prose(lang, rng.randrange(5, 60), seed * 10_000 + k).split(), rng.random() < 0.3
        if toxic:
            words.insert(rng.randrange(len(words) + 1), rng.choice(BAD))
        out.append((k + seed * 10_000, " ".join(words), lang, "s", int(toxic)))
    return out


@pytest.fixture(scope="module")
def learned(spark):
    data = rows(500, 1)
    labels = spark.createDataFrame([(r[0], r[4], "x") for r in data] + [(None, 1, "x"), (5, None, "x"), (77_777, 1, "x")], "doc_id long, toxic int, text string")
    return toxicity.learn(documents(spark, [r[:4] for r in data]), labels)


def test_held_out_texts(spark, learned):
    fresh = rows(300, 2)
    docs = documents(spark, [r[:4] for r in fresh])
    got = {r.doc_id: r.score for r in toxicity.score(docs, learned, doc_id=docs["doc_id"]).collect()}
    assert len(got) == 300 and all(0 <= s <= 1 for s in got.values())
    assert sum((got[r[0]] >= 0.5) == bool(r[4]) for r in fresh) / 300 > 0.95


def test_nulls_long_texts_and_position(spark, learned):
    long_one = prose("en", 60_000, 3)
    docs = documents(spark, [(1, None, None, None), (2, "", "en", "s"), (3, long_one, "en", "s"), (4, f"{long_one} {BAD[0]}", "en", "s"),
                             (5, f"{BAD[0]} {long_one}", "en", "s"), (6, BAD[0].upper() + "!", "en", "s")])
    got = {r.doc_id: r.score for r in toxicity.score(docs, learned, doc_id=docs["doc_id"]).collect()}
    assert got[1] == got[2] and got[4] == pytest.approx(got[5], abs=0.05) and got[4] > got[3] and got[6] >= 0.5


def test_spans_do_not_change_pooling(learned):
    index = toxicity.Rows(learned.rows)
    texts = [index.codes(prose("de", n, n)) for n in (0, 1, 2, 7, 500)]
    whole = learned.pooled(texts)
    keep = toxicity.SPAN
    try:
        toxicity.SPAN = 3
        assert np.allclose(whole, learned.pooled(texts), atol=1e-5)
    finally:
        toxicity.SPAN = keep


def test_thresholds_by_language(spark, learned):
    docs = documents(spark, [r[:4] for r in rows(20, 4)])
    out = toxicity.flagged(toxicity.score(docs, learned, lang=docs["lang"]), learned).collect()
    assert all(r.flagged == (r.score >= r.threshold) for r in out)
    assert set(learned.thresholds) <= {"en", "de", "fr"}


def test_nothing_to_learn_from(spark):
    docs = documents(spark, [r[:4] for r in rows(10, 5)])
    none = toxicity.learn(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert none is None
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.flagged(toxicity.score(docs, none, lang=F.col("lang")), none).where("flagged").count() == 0


def test_long_texts_and_every_row_teach(spark):
    """Toxic texts are all longer than 20,000 characters: each has to be read to learn their word."""
    data = [(k, prose("en", 6_000, k) + (f" {BAD[0]}" if k % 2 else ""), "en", "s") for k in range(60)]
    net = toxicity.learn(documents(spark, data), spark.createDataFrame([(r[0], r[0] % 2) for r in data], "doc_id long, toxic int"))
    whole, stem = toxicity.buckets(BAD[0])
    assert whole in net.rows and stem in net.rows


def test_labels_are_dealt_by_id_at_any_size(spark):
    docs = documents(spark, [(1, "one", "en", "s"), (1, "again", "en", "s"), (2, None, "en", "s"), (3, "three", None, "s"), (4, "four", "en", "s")])
    known = spark.createDataFrame([(1, 0, True), (2, 1, False), (3, 1, False), (9, 1, False)], "doc_id long, toxic int, check boolean")
    rows = toxicity.labelled(docs, known)
    assert sorted((r.check, r.toxic, r.text) for r in rows.collect()) == [(False, 1, "three"), (True, 0, "again"), (True, 0, "one")]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_labelled_texts_keep_the_order_of_documents(spark):
    ids = [7, 3, 7, 11, 1, 3, 5, 2]
    docs = documents(spark, [(i, f"text {k}", "en", "s") for k, i in enumerate(ids)]).coalesce(1)
    known = spark.createDataFrame([(i, 0, False) for i in range(12)], "doc_id long, toxic int, check boolean").coalesce(1)
    assert [r.text for r in toxicity.labelled(docs, known).coalesce(1).collect()] == [f"text {k}" for k in range(len(ids))]
