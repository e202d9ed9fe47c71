"""Token counts from flat token files without an index.

A flat file is one sequence of fixed-width token ids; an end-of-document id stands behind each
document and nothing says where. Files are cut into blocks; in each block the separators are found
by one vector comparison. Documents inside a block are complete. What reaches over a border comes
as pieces, numbered by a prefix scan over the separators of the blocks before and added up.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's texts are split before merging: a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Id behind each document; two zero bytes, which no other id has.
SEPARATOR = 0
WIDTH = 2
BLOCK_BYTES = 1 << 20
FILE_ROWS = 4_096
#: Ids in front of each document that spell its number.
HEADER = 5
_DIGIT = 15
_NULL = 65_535


def header_of(doc_id: int | None) -> list[int]:
    """A document's number as ids, none of them the separator."""
    if doc_id is None:
        return [_NULL] * HEADER
    value = doc_id % (1 << 64)
    return [(value >> (_DIGIT * k)) % (1 << _DIGIT) + 1 for k in range(HEADER)]


def write_files(docs: DataFrame, path: str, vocabulary: str = VOCABULARY) -> None:
    """Write (doc_id, text) as flat files of 16-bit ids: header, token ids each one higher, separator.

    Spark's text writer puts its line separator, here the separator id, behind each row; so every
    executor writes its own files to any store. Null and empty texts have a header alone.
    """
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    if max(ranks.values()) + 1 >= 1 << (8 * WIDTH):
        raise ValueError("ids of this vocabulary do not fit")
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={})
        for batch in batches:
            rows = [np.concatenate([np.array(header_of(i.as_py()), "<u2"), (np.array(encoding.encode_ordinary(t.as_py() or ""), "<u4") + 1).astype("<u2")]).tobytes()
                    for i, t in zip(*batch.columns, strict=True)]
            yield pa.record_batch([pa.array(rows, pa.binary())], ["ids"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    slim.mapInArrow(run, "ids binary").select(F.col("ids").cast("string")).write.option(
        "lineSep", "\u0000" * WIDTH).option("compression", "none").option("maxRecordsPerFile", FILE_ROWS).text(path)


def _number(header: Column) -> Column:
    """The header's number, null where it says null."""
    digit = lambda k: F.element_at(header, k + 1) - 1
    low = digit(0)
    for k in range(1, HEADER - 1):
        low = low + F.shiftleft(digit(k), _DIGIT * k)
    # The last digit holds the 4 highest bits; shifting drops what lies beyond 64.
    return F.when(F.element_at(header, 1) != _NULL, F.shiftleft(digit(HEADER - 1), _DIGIT * (HEADER - 1)).bitwiseOR(low))


def scan(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES, width: int = WIDTH, separator: int = SEPARATOR,
         header: int = HEADER) -> DataFrame:
    """(path, header, n_tokens) for every document of the flat files under ``path``.

    ``header`` holds the first ids of a document, fewer if it is shorter; ``n_tokens`` counts the
    ids behind them. Two separators in a row enclose an empty document. What stands behind the last
    separator of a file is a document if there is anything. A file is read by one task, at most 2 GB
    of it, and handed on a block at a time. No files, or empty ones, give no rows.
    """
    if block_bytes % width:
        raise ValueError("a block must hold whole ids")
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    blocks = files.select("path", "content", F.explode(F.sequence(F.lit(0), ((F.col("length") - 1) / block_bytes).cast("int"))).alias("block")) \
        .select("path", "block", F.substring("content", F.col("block") * block_bytes + 1, F.lit(block_bytes)).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, block, data in zip(*batch.columns, strict=True):
                ids = np.frombuffer(data.as_py(), f"<u{width}")
                ends = np.flatnonzero(ids == separator)
                starts = np.concatenate(([0], ends + 1))
                sizes = np.concatenate((ends, [len(ids)])) - starts
                n, last = len(starts), len(ends)
                order = np.arange(n)
                short = np.minimum(sizes, header)
                at = np.repeat(starts - np.concatenate(([0], np.cumsum(short)[:-1])), short) + np.arange(short.sum())
                first = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(short))), pa.int32()), pa.array(ids[at].astype(np.int64)))
                yield pa.record_batch(
                    [pa.array([path.as_py()] * n), pa.array([block.as_py()] * n, pa.int32()), pa.array(order), pa.array((order == 0) | (order == last)),
                     pa.array(sizes), first, pa.array(np.where(order == 0, last, 0)), pa.array(order < last)],
                    ["path", "block", "place", "border", "n", "first", "separators", "closed"])

    pieces = blocks.mapInArrow(run, "path string, block int, place long, border boolean, n long, first array<long>, separators long, closed boolean")
    whole = pieces.where("not border").select("path", F.col("first").alias("header"), "n")
    # The first piece of a block carries the block's number of separators: their running sum numbers the documents.
    ahead = Window.partitionBy("path").orderBy("block", "place").rowsBetween(Window.unboundedPreceding, -1)
    numbered = pieces.where("border").withColumn("document", F.coalesce(F.sum("separators").over(ahead), F.lit(0)))
    joined = (numbered.groupBy("path", "document")
              .agg(F.sum("n").alias("n"), F.max("closed").alias("closed"),
                   F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "place", "first"))), lambda x: x["first"])), 1, header).alias("header"))
              .where("closed or n > 0").select("path", "header", "n"))
    return whole.unionByName(joined).select("path", "header", (F.greatest(F.col("n") - header, F.lit(0))).alias("n_tokens"))


def counts(spark: SparkSession, path: str, **options) -> DataFrame:
    """(doc_id, n_tokens) for files by ``write_files``."""
    return scan(spark, path, **options).select(_number(F.col("header")).alias("doc_id"), "n_tokens")
