"""Windows found against a plain search, block by block and at once."""

import hashlib
import re

import pytest

from wayledger.llm import decontaminate

from .cases import document_rows, documents, prose

ITEM = prose("de", 30, 77)
SHORT = "short item"
BENCHMARK = [(1, ITEM), (2, SHORT), (3, None), (4, ""), (None, prose("fr", 20, 78)), (1, ITEM), (5, ITEM.upper()), (10, "  "),
             (11, "again " * 20), (12, "Sprünge 𝒳𝒴 über")]


def brute(rows):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+",
                                 "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    items = [(i, words(t)) for i, t in BENCHMARK]
    out = []
    for doc_id, text, *_ in rows:
        w, hit, ids = words(text), set(), set()
        for ident, iw in items:
            for k in range(max(1, len(iw) - 12) if iw else 0):
                win = iw[k:k + 13]
                for p in range(len(w) - len(win) + 1):
                    if w[p:p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        ids |= {str(ident)} if ident is not None else set()
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((str(doc_id), len(w), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def planted():
    filler = lambda n, k: prose("en", n, k)
    return [r for r in document_rows() if r[0] != 9] + [
        (300, filler(50, 1) + " " + ITEM + " " + filler(50, 2), "en", "a"),
        (301, " ".join(ITEM.split()[5:18]), "en", "a"), (302, " ".join(ITEM.split()[5:17]), "en", "a"),
        (303, filler(600, 3) + " SHORT! item " + filler(20, 4), "en", "a"), (304, "item short item", "en", "a"),
        (305, prose("fr", 20, 78), "fr", "a"), (306, "again " * 40, "en", "a"), (307, "sprünge 𝒳𝒴 ÜBER", "en", "a"),
        (308, "sprünge 𝒳𝒴 über x", "en", "a")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_report_against_brute_force(spark, block_bytes):
    docs, bench = documents(spark, planted()), spark.createDataFrame(BENCHMARK, "item_id long, text string")
    got = decontaminate.report(docs, bench, block_bytes=block_bytes).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == brute(planted())


def test_clean_keeps_columns_and_clean_rows(spark):
    docs, bench = documents(spark, planted()), spark.createDataFrame(BENCHMARK, "item_id long, text string")
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {301, 304, 305, 306} and {302, 303, 1, 3, 4, 5} <= ids


def test_nothing_to_compare(spark):
    docs, none = documents(spark), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(docs, none).where("n_hit > 0 or contaminated or n_items > 0").count() == 0
    assert decontaminate.report(docs, none).count() == docs.count()
    assert decontaminate.report(docs.limit(0), spark.createDataFrame(BENCHMARK, "item_id long, text string")).count() == 0


@pytest.mark.parametrize("items", [BENCHMARK, []])
def test_words_are_counted_where_they_are_compared(spark, items):
    docs, bench = documents(spark, planted()), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find(docs, bench, keep=False)
    assert sorted((str(r.doc_id), r.n_words) for r in found.collect()) == [r[:2] for r in brute(planted())]
    assert ("regexp_extract_all" in found._jdf.queryExecution().optimizedPlan().toString()) == (not items)
