"""Counts against encoding each text alone."""

import base64
import struct

import pytest
import tiktoken

from wayledger.llm import tokens

from .cases import document_rows, documents

pytestmark = pytest.mark.skipif(not __import__("os").path.exists(tokens.VOCABULARY), reason="vocabulary is not here")


@pytest.fixture(scope="module")
def expected():
    with open(tokens.VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("x", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return sorted((str(r[0]), len(encoding.encode_ordinary(r[1] or ""))) for r in document_rows())


@pytest.mark.parametrize("block_bytes", [2, 14, 4096, 1 << 20])
def test_counts_at_any_block_size(spark, tmp_path, expected, block_bytes):
    rows = document_rows() if block_bytes > 14 else [r for r in document_rows() if r[0] != 9]
    path = f"file://{tmp_path}/flat"
    tokens.write_files(documents(spark, rows), path)
    got = sorted((str(r.doc_id), r.n_tokens) for r in tokens.counts(spark, path, block_bytes=block_bytes).collect())
    assert got == (expected if block_bytes > 14 else [e for e in expected if e[0] != "9"])


def test_foreign_files(spark, tmp_path):
    ids = [5, 6, 0, 0, 7, 0, 8, 9]  # two, none, one, and two without a separator
    (tmp_path / "a.bin").write_bytes(struct.pack("<8I", *ids))
    (tmp_path / "b.bin").write_bytes(b"")
    for block in (4, 8, 12, 64):
        got = tokens.scan(spark, f"file://{tmp_path}", block_bytes=block, width=4, header=0).collect()
        assert sorted(r.n_tokens for r in got) == [0, 1, 2, 2]
    with pytest.raises(ValueError):
        tokens.scan(spark, f"file://{tmp_path}", block_bytes=5, width=4)


def test_no_documents(spark, tmp_path):
    tokens.write_files(documents(spark).limit(0), f"file://{tmp_path}/none")
    assert tokens.counts(spark, f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("number", [0, 1, -1, 32767, 32768, (1 << 63) - 1, -(1 << 63), None])
def test_numbers_survive_the_header(spark, number):
    from pyspark.sql import functions as F
    row = spark.createDataFrame([(tokens.header_of(number),)], "h array<long>").select(tokens._number(F.col("h")).alias("n")).first()
    assert row.n == number
    assert tokens.SEPARATOR not in tokens.header_of(number)
