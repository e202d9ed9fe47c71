"""Groups, links and counts of aligned tokens against loops over all pairs of tokens."""

import hashlib
import json
import os
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wayledger.llm import alignment
from wayledger.llm.catalog import op12

from .cases import document_rows, documents

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(alignment.VOCABULARY_A), reason="vocabularies are not here")


@pytest.fixture(scope="module")
def readers():
    a = Tokenizer.from_file(alignment.VOCABULARY_A)
    a.encode_special_tokens = True
    with open(alignment.VOCABULARY_A, encoding="utf-8") as file:
        names = {i: entry for entry, i in json.load(file)["model"]["vocab"].items()}
    alphabet = alignment.byte_alphabet()
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.MODEL_B)

    def spans(text):
        """(A tokens, B tokens) as (id, from, to); none if the bytes do not agree."""
        if not text:
            return [], []
        out = []
        for ids, data in ((a.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(alphabet[c] for c in names[i])),
                          (b.encode(text), lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())):
            at, tokens = 0, []
            for i in ids:
                tokens.append((i, at, at + len(data(i))))
                at += len(data(i))
            if b"".join(data(i) for i in ids) != (" " + text).encode():
                return [], []
            out.append(tokens)
        return out[0], out[1]

    return spans


def brute(rows, spans):
    docs = []
    for i, text in rows:
        a, b = spans(text)
        linked = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        parts, low = [], 0
        for cut in cuts:
            own = [",".join(str(t[0]) for t in side if low <= t[1] and t[2] <= cut) for side in (a, b)]
            parts.append("|".join(own))
            low = cut
        docs.append((i, a, b, linked, parts))
    held = Counter(p for *_, linked, _ in docs for p in set(linked))
    best = {}
    for (x, _), n in held.items():
        best[x] = max(n, best.get(x, 0))
    return sorted((str(i), len(a), len(b), len(parts), len(linked), sum(held[p] == best[p[0]] for p in linked), sum(held[p] for p in linked),
                   hashlib.sha256(";".join(parts).encode()).hexdigest() if parts else "") for i, a, b, linked, parts in docs)


def seen(df):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


ODD = [(1, "naïve ÄÖ 𝒳𝒴 中文 ​ end x"), (2, "<|endoftext|> and <s>hi</s> <0x41> <unk>"), (3, "▁under"), (4, "a\x00b\r\n\t  c   "), (5, "  lead"),
       (6, "İstanbul ǅ ﬁ é 🙂🙂👩‍👩‍👧"), (7, "don't we'll 12345 3.14 ...!!!"), (8, "x"), (9, " "), (10, "word " * 30), (10, "word " * 30), (11, None), (None, "none here"), (12, "")]


def test_against_all_pairs_of_tokens(spark, readers):
    rng = random.Random(3)
    rows = ODD + [(i, t and t[:600]) for i, t, *_ in document_rows()]
    rows += [(500 + k, "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x600), rng.randrange(0x4E00, 0x4F00), 0x1F600 + k % 40]))
                               for _ in range(60))) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert seen(alignment.align(df, doc_id=F.col("doc_id"))) == brute(rows, readers)


def test_chunks_do_not_change_the_result(spark, readers, monkeypatch):
    rows = [(i, t and t[:900]) for i, t, *_ in document_rows()]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    monkeypatch.setattr(alignment._slices, "__defaults__", (300,))
    assert seen(alignment.align(df, doc_id=F.col("doc_id"))) == brute(rows, readers)


def test_a_task_holds_one_chunk_at_a_time(spark):
    rows = [(k, f"word{k % 7} and more " * 2_000) for k in range(60)]  # 1.9 million characters in one partition
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    held = [sum(len(rows[d.doc_id][1]) for d in r.keep) for r in alignment.chunks(df, {"doc_id": F.col("doc_id")}).select("keep").collect()]
    assert sum(held) == sum(len(t) for _, t in rows) and max(held) <= 1 << 19
    out = alignment.align(df, doc_id=F.col("doc_id"))
    plan = out._jdf.queryExecution().toString()
    # A batch would take thousands of chunks, and gathered lists lie on the heap, uncounted.
    assert "FlatMapCoGroupsInArrow" in plan and "MapInArrow run" not in plan and "collect_list" not in plan
    assert {r.doc_id: (r.n_a, r.count_sum) for r in out.collect()}.keys() == {k for k, _ in rows}


def test_clashing_columns_long_texts_and_no_rows(spark):
    docs = documents(spark)
    out = alignment.align(docs, doc_id=F.col("doc_id"), chunk=F.col("row"), place=F.col("place"))
    assert out.columns[:3] == ["doc_id", "chunk", "place"] and out.count() == docs.count()
    assert alignment.align(docs.limit(0), doc_id=F.col("doc_id")).count() == 0
    assert alignment.align(docs.withColumn("text", F.lit(None).cast("string")), doc_id=F.col("doc_id")).agg(F.sum("n_a")).first()[0] == 0


def test_groups_with_their_bytes(spark, readers):
    rows = ODD[:10]
    got = {}
    for r in alignment.groups(spark.createDataFrame(rows, "doc_id long, text string"), doc_id=F.col("doc_id")).collect():
        got.setdefault(r.doc_id, []).append((r.number, r["from"], r["to"], list(r.a), list(r.b)))
    for i, text in rows:
        a, b = readers(text)
        want, low = [], 0
        for cut in sorted({x[2] for x in a} & {y[2] for y in b}):
            want.append((len(want), low, cut, [t[0] for t in a if low <= t[1] and t[2] <= cut], [t[0] for t in b if low <= t[1] and t[2] <= cut]))
            low = cut
        assert sorted(got.get(i, [])) == want


def test_pointers_reach_the_end_of_a_long_group():
    # A cuts at odd bytes, B at even ones, and both end at the last byte: one group over all.
    n = 4_001
    ends_a, ends_b = np.append(np.arange(1, n, 2), n), np.append(np.arange(2, n - 1, 2), n)
    starts = [np.append(0, e[:-1]) for e in (ends_a, ends_b)]
    assert set(alignment.terminals(ends_a, starts[0], ends_b, starts[1])) == {len(ends_a) - 1}


def test_query_over_the_whole_table(spark, readers):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r.text or "") < 3_000]
    short = spark.createDataFrame(rows, "doc_id long, text string")
    assert seen(alignment.align(short, doc_id=F.col("doc_id"))) == brute(rows, readers)
    whole = op12(spark, SF)
    assert whole.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
