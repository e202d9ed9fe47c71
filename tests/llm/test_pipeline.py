"""The pipeline over the smallest tables against its stages' promises, and the queries against their SQL."""

import os

import pytest

import corpus_pipeline
from check_oracle import connect
from check_oracle import rows as in_order
from wayledger.functions.pseudonym import PlateHasher
from wayledger.llm import decontaminate, language, mixing, pii
from wayledger.llm.catalog import ORACLES, QUERIES, TEST_KEY
from wayledger.llm.common import table

from .cases import documents
from .test_minhash import brute_groups

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cursor = con.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert in_order(df.columns, [tuple(r) for r in df.collect()]) == in_order(names, cursor.fetchall())


def test_every_operator_has_one_query():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))


def test_stages_against_their_operators(spark):
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialise(stage(spark, docs, SF))
        if name == "language_id":
            model = language.learn(docs)
            made = language.compressors(model)
            want = {i for i, r in kept.items() if language.decide(r.text, made)[3]}
        elif name == "near_duplicates":
            group, least = brute_groups([(i, r.text) for i, r in kept.items()])
            want = {least[group(r.text)] for r in kept.values()}
        elif name == "benchmark_decontamination":
            report = decontaminate.report(docs, table(spark, SF, "benchmark")).collect()
            want = {r.doc_id for r in report if not r.contaminated}
        elif name == "pii_surrogates":
            want = set(kept)
            shown = {r["row"].doc_id: r.text for r in pii.replaced(docs, PlateHasher(TEST_KEY)).collect()}
            assert {r.doc_id: r.text for r in out.collect()} == shown
        else:
            taken = {r.doc_id: len(r.positions) for r in mixing.assign(docs).collect()}
            got = out.groupBy("doc_id").count().collect()
            assert {r.doc_id: r["count"] for r in got} == {i: n for i, n in taken.items() if n}
            break
        assert out.columns == columns
        kept = {r.doc_id: r for r in out.collect()}
        assert set(kept) == want and out.count() == len(want)
        docs = out


def test_stages_bear_odd_rows_and_empty_tables(spark):
    for docs in (documents(spark), documents(spark).limit(0)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.materialise(stage(spark, docs, SF))
            assert docs.columns[:len(columns)] == columns if name != "mixing" else {*columns} <= {*docs.columns}


