"""Licence scans against loops over places, on made texts with whole, cut, doubled and changed passages."""

import re

import pytest
from pyspark.sql import functions as F

from wayledger.llm import licenses as L

from .cases import document_rows, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(L.UPPER, L.LOWER)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(rows):
    held = {}
    for _, text in rows:
        for w in set(words(text)):
            held[w] = held.get(w, 0) + 1
    filed = []
    for t in L.TEMPLATES:
        rare = sorted(set(t.words), key=lambda w: (held.get(w, 0), w))[:L.FILED]
        places = [k for k, w in enumerate(t.words) if w in rare]
        filed.append((t, places, -(-len(places) * 60 // 100)))
    out = []
    for i, text in rows:
        w = words(text)
        base = [(k, label) for phrase, label in L.BASE for k in range(len(w)) if w[k:k + len(phrase.split())] == phrase.split()]
        met = {}
        for t, places, need in filed:
            for start in range(-len(t.words), len(w)):
                at = lambda k: w[start + k] if 0 <= start + k < len(w) else None  # noqa: B023, E731
                if sum(at(k) == t.words[k] for k in places) >= need and all(
                        start + k >= 0 and w[start + k:start + k + len(p)] == p for k, p in t.phrases):
                    share = sum(at(k) == x for k, x in enumerate(t.words)) / len(t.words)
                    met[t.label] = max(share, met.get(t.label, 0))
        labels = {label for _, label in base}
        starts = [k for k, _ in base]
        out.append((str(i), len(w), len(base), str(min(starts, default=None)), str(max(starts, default=None)), ",".join(sorted(labels)),
                    ",".join(sorted(labels | set(met))), max([*met.values(), 0.5 if base else 0.0])))
    return sorted(out)


def seen(df):
    return sorted((str(r.doc_id), r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels, r.labels, r.score) for r in df.collect())


def licensed_rows():
    rows = [(i, t and t[:2_000]) for i, t, *_ in document_rows()]
    for k, t in enumerate(L.TEMPLATES):
        w = t.words
        rows += [(1_000 + k, t.text.upper()), (1_100 + k, "some prose before " + ", ".join(w) + ". and behind"), (1_200 + k, " ".join(w[:len(w) // 2])),
                 (1_300 + k, " ".join(x if j % 7 else "other" for j, x in enumerate(w))), (1_400 + k, " ".join([*w, *w, *w[2:]])), (1_500 + k, " ".join(w[::-1])),
                 (1_600 + k, " ".join(w[1:] + ["z"]))]
    return rows + [(1, "The MIT License. mit license? MIT\nLICENSE mit-license"), (1, "mit  license mit license"), (2, "General Public apache license"),
                   (3, "gnu general public license version 3.0, or GNU General Public License, version 2"), (4, "license"), (5, "mit"), (None, "Apache License"),
                   (6, "ﬀmit license"), (7, "mit licenſe mıt license"), (8, "license " * 3_000 + "mit license " * 3_000), (9, None), (10, "")]


def test_against_loops(spark):
    rows = licensed_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got, want = seen(L.scan(df, doc_id=F.col("doc_id"))), brute(rows)
    assert got == want
    by_id = {r[0]: r for r in want}
    for k, t in enumerate(L.TEMPLATES):
        assert t.label in by_id[str(1_000 + k)][6].split(",") and by_id[str(1_100 + k)][7] >= by_id[str(1_300 + k)][7]
    assert by_id["8"][2] == 3_000


def test_scan_is_native_and_moves_no_text(spark):
    df = spark.createDataFrame(licensed_rows(), "doc_id long, text string")
    plan = L.scan(df, doc_id=F.col("doc_id"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_clashing_columns_and_no_rows(spark):
    docs = documents(spark)
    out = L.scan(docs, doc_id=F.col("doc_id"), row=F.col("row"), score_before=F.col("score"))
    assert out.columns[:3] == ["doc_id", "row", "score_before"] and out.count() == docs.count()
    assert L.scan(docs.limit(0), doc_id=F.col("doc_id")).count() == 0


def test_a_phrase_outside_its_template_is_refused():
    with pytest.raises(ValueError, match="not part"):
        L.Template("x", "a b c", ("c a",)).phrases
