"""Alignment of two tokenizers over the same text, and how often linked ids meet in a corpus.

Both tokenizers cut the bytes of a space and the text. Tokens of either overlap tokens of the other;
what hangs together over overlaps is a group, and groups end where tokens of both end at one byte.
Groups are found by pointer jumping: every token points to its farthest-right overlapping token, and
doubling the pointers leads each token to the last one of its group.

Texts are worked on in chunks of bounded size. A chunk is written once, as one row: its documents,
the different id pairs linked in it with their number of documents, and which document holds which
pair how often. Counts of pairs are summed over chunks, go back to each chunk as a dictionary of its
own pairs, and are added up per document there. No pair goes with its document through a shuffle, and
nothing is broadcast but the vocabularies. A task holds one chunk at a time, with one chunk's dictionary.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..session import materialise, small_batches

VOCABULARY_A = "/opt/tokenizers/byte_bpe_50k.json"
MODEL_B = "/opt/tokenizers/piece_bpe_32k.model"
#: How texts are split before the merges of the byte-level vocabulary: a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of text worked on at once; a longer text is a chunk of its own. Each takes about 130 bytes of arrays.
CHUNK_CHARS = 1 << 19
#: Bytes of a row group of stored chunks. Writers and readers hold a whole one, with up to 4,096 chunks.
GROUP_BYTES = 1 << 23
_SEPARATORS = (",", "|", ";", "")


def byte_alphabet() -> dict[str, int]:
    """The printable character that a byte-level vocabulary writes for each byte, by a rule: printable
    Latin-1 bytes stand for themselves, the others follow from code point 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def ranks_of(vocabulary: str = VOCABULARY_A) -> dict[bytes, int]:
    """Bytes of each entry of a byte-level vocabulary file to its id; added special tokens are left out."""
    with open(vocabulary, encoding="utf-8") as file:
        content = json.load(file)
    special = {t["id"] for t in content.get("added_tokens", [])}
    alphabet = byte_alphabet()
    return {bytes(alphabet[c] for c in entry): i for entry, i in content["model"]["vocab"].items() if i not in special}


class Encoders:
    """Both tokenizers and the bytes of their ids. Ids of the first are ranks of merges, so its engine needs no file."""

    def __init__(self, ranks: dict[bytes, int], model: bytes) -> None:
        self.a = tiktoken.Encoding("aligned", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for entry, i in ranks.items():
            self.bytes_a[i] = entry
        pieces = [(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode("utf-8", "surrogatepass") for p, byte in pieces]
        self.width_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.width_b = np.array([len(x) for x in self.bytes_b], np.int64)

    def encode(self, texts: list[str | None]) -> list[tuple[list[int], list[int]]]:
        """Ids of both; none where a text is null, empty, or not what its ids spell."""
        there = [t or "" for t in texts]
        out = []
        for text, ids_b in zip(there, self.b.encode(there, num_threads=1), strict=True):
            spaced = f" {text}"
            ids_a, data = self.a.encode_ordinary(spaced) if text else [], spaced.encode("utf-8", "surrogatepass")
            same = text and b"".join([self.bytes_b[i] for i in ids_b]) == data and b"".join([self.bytes_a[i] for i in ids_a]) == data
            out.append((ids_a, ids_b) if same else ([], []))
        return out


def terminals(ends_a: np.ndarray, starts_a: np.ndarray, ends_b: np.ndarray, starts_b: np.ndarray) -> np.ndarray:
    """For every token of A, then of B: the A token that ends its group.

    Both cut the same bytes. A token's farthest-right overlapping token is the one of the other side
    over its last byte; if that ends there as well, the group ends, and the A token points to itself.
    Each doubling halves the way that is left.
    """
    over_b = np.searchsorted(starts_b, ends_a, "left") - 1
    over_a = np.searchsorted(starts_a, ends_b, "left") - 1
    n = len(ends_a)
    own = np.arange(n)
    successor = np.concatenate([np.where(ends_b[over_b] > ends_a, n + over_b, own), over_a])
    while True:
        further = successor[successor]
        if np.array_equal(further, successor):
            return successor
        successor = further


def links(ends_a: np.ndarray, starts_a: np.ndarray, ends_b: np.ndarray, starts_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of tokens whose bytes overlap."""
    first = np.searchsorted(starts_b, starts_a, "right") - 1
    many = np.searchsorted(starts_b, ends_a, "left") - first
    at = np.repeat(np.arange(len(ends_a)), many)
    before = np.cumsum(many) - many
    return at, np.arange(len(at)) - np.repeat(before - first, many)


def spelled(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, doc_a: np.ndarray, doc_b: np.ndarray,
            n_docs: int, table: list[str]) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` for each document of a chunk; ``table`` has every id with each separator behind it."""
    size = len(table) // len(_SEPARATORS)
    step_a = np.diff(group_a, append=-1) != 0  # the last A token of its group
    step_b = np.diff(group_b, append=-1) != 0
    ends_doc = np.diff(doc_b, append=-1) != 0
    entry_a = ids_a + size * np.where(step_a, 1, 0)
    entry_b = ids_b + size * np.where(ends_doc, 3, np.where(step_b, 2, 0))
    # An A token stands behind the B tokens of earlier groups, a B token behind the A tokens up to its group.
    out = np.empty(len(ids_a) + len(ids_b), np.int64)
    out[np.arange(len(ids_a)) + np.searchsorted(group_b, group_a, "left")] = entry_a
    out[np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, "right")] = entry_b
    bounds = np.searchsorted(doc_a, np.arange(n_docs + 1)) + np.searchsorted(doc_b, np.arange(n_docs + 1))
    pieces = [table[k] for k in out.tolist()]
    return ["".join(pieces[bounds[k]:bounds[k + 1]]) for k in range(n_docs)]


class Chunk:
    """Documents of a chunk aligned: arrays over all their tokens, in order."""

    def __init__(self, texts: list[str | None], encoders: Encoders) -> None:
        encoded = encoders.encode(texts)
        self.n_a = np.array([len(a) for a, _ in encoded], np.int64)
        self.n_b = np.array([len(b) for _, b in encoded], np.int64)
        self.a = np.fromiter((i for a, _ in encoded for i in a), np.int64, int(self.n_a.sum()))
        self.b = np.fromiter((i for _, b in encoded for i in b), np.int64, int(self.n_b.sum()))
        docs = np.arange(len(texts))
        self.doc_a, self.doc_b = np.repeat(docs, self.n_a), np.repeat(docs, self.n_b)
        self.ends_a, self.ends_b = np.cumsum(encoders.width_a[self.a]), np.cumsum(encoders.width_b[self.b])
        self.starts_a, self.starts_b = self.ends_a - encoders.width_a[self.a], self.ends_b - encoders.width_b[self.b]
        if len(self.a):
            last = terminals(self.ends_a, self.starts_a, self.ends_b, self.starts_b)
            self.group_a, self.group_b = last[:len(self.a)], last[len(self.a):]
            self.link_a, self.link_b = links(self.ends_a, self.starts_a, self.ends_b, self.starts_b)
        else:
            self.group_a = self.group_b = self.link_a = self.link_b = np.zeros(0, np.int64)
        n = len(texts)
        self.n_groups = np.bincount(self.doc_a[np.flatnonzero(self.group_a == np.arange(len(self.a)))], minlength=n)
        self.n_links = np.bincount(self.doc_a[self.link_a], minlength=n)


def _encoders_of(spark: SparkSession, vocabulary_a: str, model_b: str):
    with open(model_b, "rb") as file:
        return spark.sparkContext.broadcast((ranks_of(vocabulary_a), file.read()))


def _slices(texts: list[str | None], size: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``size`` characters, or one text."""
    start = held = 0
    for k, text in enumerate(texts):
        n = len(text or "") + 64
        if k > start and held + n > size:
            yield start, k
            start, held = k, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def chunks(docs: DataFrame, keep: dict[str, Column], vocabulary_a: str = VOCABULARY_A, model_b: str = MODEL_B) -> DataFrame:
    """One row per chunk of (text): its documents with their ``keep`` columns and own figures, its pairs and their places."""
    shared = _encoders_of(docs.sparkSession, vocabulary_a, model_b)
    slim = docs.select(F.col("text").cast("string").alias("__text"), F.struct(*[c.alias(k) for k, c in keep.items()]).alias("keep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = Encoders(*shared.value)
        size_b = len(encoders.bytes_b)
        table = [f"{i}{s}" for s in _SEPARATORS for i in range(max(len(encoders.bytes_a), size_b))]
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts, kept = batch.column(0).to_pylist(), batch.column(1)
            for start, end in _slices(texts):
                own = Chunk(texts[start:end], encoders)
                shown = spelled(own.a, own.b, own.group_a, own.group_b, own.doc_a, own.doc_b, end - start, table)
                digests = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in shown]
                pair = own.a[own.link_a] * size_b + own.b[own.link_b]
                held, times = np.unique(own.doc_a[own.link_a] * (len(encoders.bytes_a) * size_b) + pair, return_counts=True)
                doc, pair = np.divmod(held, len(encoders.bytes_a) * size_b)
                pairs, place, in_docs = np.unique(pair, return_inverse=True, return_counts=True)
                row = {
                    "chunk": [number], "keep": [kept.slice(start, end - start).to_pylist()],
                    **{c: [getattr(own, c)] for c in ("n_a", "n_b", "n_groups", "n_links")}, "groups_sha256": [digests],
                    "pair": [pairs], "in_docs": [in_docs], "doc": [doc.astype(np.int32)], "place": [place.astype(np.int32)],
                    "times": [times.astype(np.int32)],
                }
                number += 1
                yield pa.record_batch([pa.array(v, t) for v, t in zip(row.values(), _arrow(batch.schema.field(1).type), strict=True)], list(row))

    ints, longs = "array<int>", "array<bigint>"
    schema = StructType([
        StructField("chunk", LongType()), StructField("keep", ArrayType(slim.schema["keep"].dataType)),
        *[StructField(c, ArrayType(LongType())) for c in ("n_a", "n_b", "n_groups", "n_links")], StructField("groups_sha256", ArrayType(StringType())),
        *StructType.fromDDL(f"pair {longs}, in_docs {longs}, doc {ints}, place {ints}, times {ints}").fields])
    return slim.mapInArrow(run, schema)


def _arrow(keep: pa.DataType) -> list[pa.DataType]:
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    return [pa.int64(), pa.list_(keep), longs, longs, longs, longs, pa.list_(pa.string()), longs, longs, ints, ints, ints]


def pair_counts(chunked: DataFrame, size_b: int) -> DataFrame:
    """(pair, count, best): documents that hold a pair of ids linked, and whether no pair of the same A id has more."""
    counts = (chunked.select(F.explode(F.arrays_zip("pair", "in_docs")).alias("x")).groupBy(F.col("x.pair").alias("pair"))
              .agg(F.sum("x.in_docs").alias("count")))
    same = Window.partitionBy(F.floor(F.col("pair") / F.lit(size_b)))
    return counts.select("pair", "count", (F.col("count") == F.max("count").over(same)).alias("best"))


def align(docs: DataFrame, vocabulary_a: str = VOCABULARY_A, model_b: str = MODEL_B, **keep: Column) -> DataFrame:
    """The ``keep`` columns and n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of (text).

    Texts that are null, empty, or that the ids of one side do not spell have no tokens: zeros and ''.
    Rows that repeat count as documents of their own. Only a chunk's own pairs, at most as many as it
    has links, are gathered for it. An empty table gives no rows.
    """
    with small_batches(docs.sparkSession):
        chunked = materialise(chunks(docs, keep, vocabulary_a, model_b), **{"parquet.block.size": GROUP_BYTES})
    size_b = sentencepiece.SentencePieceProcessor(model_file=model_b).get_piece_size()
    asked = chunked.select(F.col("chunk").alias("of"), F.explode("pair").alias("pair"))
    told = asked.join(pair_counts(chunked, size_b), "pair").select("of", "pair", "count", "best")
    figures = ["n_a", "n_b", "n_groups", "n_links"]
    rows = chunked.select("chunk", "keep", *figures, "groups_sha256", "doc", "place", "times")
    made = StructType([StructField("keep", chunked.schema["keep"].dataType.elementType), *[StructField(c, LongType()) for c in
                       (*figures, "n_best", "count_sum")], StructField("groups_sha256", StringType())])

    def run(chunk: pa.Table, told: pa.Table) -> pa.Table:
        """The documents of one chunk, and every pair of it with its count."""
        cell = {name: chunk.column(name)[0] for name in chunk.column_names}
        kept = cell["keep"].values
        count_sum, n_best = np.zeros(len(kept), np.int64), np.zeros(len(kept), np.int64)
        if told.num_rows:
            doc, place, times = (cell[c].values.to_numpy() for c in ("doc", "place", "times"))
            order = np.argsort(told.column("pair").to_numpy())  # places count a chunk's pairs in order
            count, best = told.column("count").to_numpy()[order], told.column("best").to_numpy()[order]
            np.add.at(count_sum, doc, times * count[place])
            np.add.at(n_best, doc, times * best[place].astype(np.int64))
        return pa.table([kept, *(cell[c].values for c in figures), pa.array(n_best), pa.array(count_sum), cell["groups_sha256"].values],
                        ["keep", *figures, "n_best", "count_sum", "groups_sha256"])

    out = rows.groupBy("chunk").cogroup(told.groupBy("of")).applyInArrow(run, made)
    return out.select("keep.*", *figures, "n_best", "count_sum", "groups_sha256")


def groups(docs: DataFrame, vocabulary_a: str = VOCABULARY_A, model_b: str = MODEL_B, **keep: Column) -> DataFrame:
    """One row per group, with the ``keep`` columns: its number in its text, bytes from and to (of a space and
    the text), and the ids of both sides in order."""
    shared = _encoders_of(docs.sparkSession, vocabulary_a, model_b)
    slim = docs.select(F.col("text").cast("string").alias("__text"), F.struct(*[c.alias(k) for k, c in keep.items()]).alias("keep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = Encoders(*shared.value)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for start, end in _slices(texts):
                own = Chunk(texts[start:end], encoders)
                last = np.flatnonzero(own.group_a == np.arange(len(own.a)))
                first = np.concatenate([[0], last[:-1] + 1]).astype(np.int64) if len(last) else last
                cut_a = np.concatenate([first, [len(own.a)]]).astype(np.int32)
                cut_b = np.concatenate([np.searchsorted(own.group_b, last), [len(own.b)]]).astype(np.int32)
                doc = own.doc_a[last]
                base = np.searchsorted(doc, doc, "left")
                origin = own.starts_a[first[base]] if len(last) else last
                kept = batch.column(1).slice(start, end - start).take(pa.array(doc))
                yield pa.record_batch([
                    kept, pa.array(np.arange(len(last)) - base), pa.array(own.starts_a[first] - origin), pa.array(own.ends_a[last] - origin),
                    pa.ListArray.from_arrays(cut_a, own.a), pa.ListArray.from_arrays(cut_b, own.b)], ["keep", "number", "from", "to", "a", "b"])

    made = StructType([slim.schema["keep"], *StructType.fromDDL("number bigint, `from` bigint, `to` bigint, a array<bigint>, b array<bigint>").fields])
    return slim.mapInArrow(run, made).select("keep.*", "number", "from", "to", "a", "b")
