"""Benchmark decontamination: a prefix-filtered set join of item windows with texts.

A window is 13 consecutive words of an item. Its shingles are ordered by how rare they are in all
texts, and since a whole window must occur, the prefix that must be joined is its rarest shingle.
A text position that holds that shingle fixes where the window would start; starts before the
first word or ends after the last fail the positional and length bounds; what remains is compared
word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

WINDOW = 13
SHINGLE = 3
#: Benchmark text in one broadcast index, in bytes; larger benchmarks go in several blocks.
BLOCK_BYTES = 8 << 20
#: Candidates verified at once.
STEP = 1 << 16

_WORD_BYTES = frozenset(range(0x30, 0x3A)) | frozenset(range(0x61, 0x7B)) | frozenset(range(0x80, 0x100))
#: Per UTF-8 byte: letters in lower case, digits and all beyond ASCII as they are, the rest a space.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD_BYTES else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


#: The same words as a pattern, before lower-casing.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


class _Ids(dict):
    """Word to number; 0 for words that no item has."""

    def __missing__(self, word: bytes) -> int:
        return 0


@dataclass
class Index:
    """Windows of one block of the benchmark; ``items[i]`` lists the ids of window ``i``."""

    vocabulary: dict[bytes, int]
    ids: np.ndarray  # windows x WINDOW, 0 behind short windows
    length: np.ndarray
    items: list[list[str]]
    codes: dict[int, np.ndarray]  # shingle length -> all shingle codes of windows of that kind, sorted
    key: dict[int, np.ndarray]  # shingle length -> prefix codes, sorted
    key_window: dict[int, np.ndarray]
    key_offset: dict[int, np.ndarray]

    @property
    def base(self) -> int:
        return len(self.vocabulary) + 1


def _codes(ids: np.ndarray, size: int, base: int) -> np.ndarray:
    """A number per run of ``size`` words, 0 where one of them is in no item."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    code, known = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(size):
        part = ids[k:k + n]
        code = code * base + part
        known &= part > 0
    return np.where(known, code, 0)


def build(items: list[tuple[str | None, str | None]], window: int = WINDOW, shingle: int = SHINGLE) -> Index:
    """Windows of the items; prefixes are chosen by ``choose_prefixes``."""
    vocabulary: dict[bytes, int] = {}
    found: dict[tuple[int, ...], list[str]] = {}
    for ident, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
        for at in range(max(1, len(ids) - window + 1) if ids else 0):
            owners = found.setdefault(tuple(ids[at:at + window]), [])
            if ident is not None and ident not in owners:
                owners.append(ident)
    if len(vocabulary) + 1 >= 2 ** (63 // shingle):
        raise ValueError("too many different words in one block: lower block_bytes")
    wins = list(found)
    ids = np.zeros((len(wins), window), np.int64)
    for i, w in enumerate(wins):
        ids[i, :len(w)] = w
    length = np.array([len(w) for w in wins], np.int64)
    index = Index(vocabulary, ids, length, [found[w] for w in wins], {}, {}, {}, {})
    kinds = np.minimum(length, shingle)
    for size in np.unique(kinds).tolist():
        index.codes[size] = np.unique(np.concatenate(
            [_codes(ids[i, :length[i]], size, index.base) for i in np.flatnonzero(kinds == size)]))
    return index


def choose_prefixes(index: Index, counts: dict[tuple[int, int], int], shingle: int = SHINGLE) -> None:
    """Order each window's shingles by rarity and keep the rarest as its prefix."""
    kinds = np.minimum(index.length, shingle)
    for size in index.codes:
        rows = []
        for i in np.flatnonzero(kinds == size).tolist():
            codes = _codes(index.ids[i, :index.length[i]], size, index.base).tolist()
            at = min(range(len(codes)), key=lambda k: (counts.get((size, codes[k]), 0), codes[k]))
            rows.append((codes[at], i, at))
        rows.sort()
        key, win, offset = zip(*rows, strict=True)
        index.key[size], index.key_window[size], index.key_offset[size] = map(np.array, (key, win, offset))


def hits(index: Index, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts and windows of all occurrences in a text, some at a time."""
    for size, key in index.key.items():
        codes = _codes(ids, size, index.base)
        lo, hi = np.searchsorted(key, codes), np.searchsorted(key, codes, "right")
        at = np.flatnonzero((hi > lo) & (codes > 0))
        ahead = np.cumsum(hi[at] - lo[at])
        for part in np.split(at, np.flatnonzero(np.diff(ahead // STEP)) + 1):
            many = hi[part] - lo[part]
            if not len(many):
                continue
            pos = np.repeat(part, many)
            entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo[part], many)
            win = index.key_window[size][entry]
            start = pos - index.key_offset[size][entry]
            fits = (start >= 0) & (start + index.length[win] <= len(ids))
            start, win = start[fits], win[fits]
            place = start[:, None] + np.arange(index.ids.shape[1])[None, :]
            inside = np.arange(index.ids.shape[1])[None, :] < index.length[win][:, None]
            same = (ids[np.minimum(place, len(ids) - 1)] == index.ids[win]) | ~inside
            good = same.all(1)
            yield start[good], win[good]


def _numbers(vocabulary: dict[bytes, int], words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words))


def _rarity(docs: DataFrame, index: Index) -> dict[tuple[int, int], int]:
    """How often each shingle of the index occurs in all texts. Bounded by the index."""
    shared = docs.sparkSession.sparkContext.broadcast((index.vocabulary, index.codes, index.base))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, codes, base = shared.value
        vocabulary = _Ids(words)
        sums = {size: np.zeros(len(c), np.int64) for size, c in codes.items()}
        for batch in batches:
            for text in batch.column(0):
                ids = _numbers(vocabulary, words_of(text.as_py()))
                for size, known in codes.items():
                    own = _codes(ids, size, base)
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    sums[size] += np.bincount(at[known[at] == own], minlength=len(known))
        for size, n in sums.items():
            seen = np.flatnonzero(n)
            for k in range(0, len(seen), STEP):
                some = seen[k:k + STEP]
                yield pa.record_batch([pa.array(np.full(len(some), size, np.int32)), pa.array(codes[size][some]), pa.array(n[some])],
                                      ["size", "code", "n"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "size int, code long, n long")
    rows = counted.groupBy("size", "code").agg(F.sum("n").alias("n")).collect()
    return {(r["size"], r["code"]): r["n"] for r in rows}


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[list[tuple[str | None, str | None]], bool]]:
    """Items in blocks of bounded size and whether each is the last; an item is never split."""
    slim = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // block_bytes)
    for part in range(parts):
        rows = slim.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        yield sorted({(r["item_id"], r["text"]) for r in rows}, key=str), part + 1 == parts


def _mark(marked: DataFrame, index: Index, last: bool) -> DataFrame:
    """Add one block's findings to ``spans`` and ``items`` and count the words; rows are neither moved nor dropped.

    The last block does not send the texts back.
    """
    # Plain values only: a worker need not have this module.
    shared = marked.sparkSession.sparkContext.broadcast(vars(index))
    out = [f for f in marked.schema.fields if not (last and f.name == "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = Index(**shared.value)
        vocabulary = _Ids(here.vocabulary)
        for batch in batches:
            names = batch.schema.names
            many, spans, items = [], [], []
            for text, old_spans, old_items in zip(*(batch.column(names.index(c)) for c in ("text", "spans", "items")), strict=True):
                ids = _numbers(vocabulary, words_of(text.as_py()))
                many.append(len(ids))
                edge, wins = np.zeros(len(ids) + 1, np.int64), []
                for start, win in hits(here, ids):
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + here.length[win], -1)
                    wins.append(np.unique(win))
                for s in old_spans.as_py():
                    edge[s["first"]] += 1
                    edge[s["beyond"]] -= 1
                inside = np.concatenate(([0], np.cumsum(edge[:-1]) > 0, [0])).astype(np.int8)
                turn = np.diff(inside)
                spans.append([{"first": a, "beyond": b} for a, b in
                              zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist(), strict=True)])
                items.append(sorted({*old_items.as_py(), *(i for w in wins for k in w.tolist() for i in here.items[k])}))
            new = {"n_words": pa.array(many, pa.int64()), "spans": pa.array(spans, batch.schema.field("spans").type),
                   "items": pa.array(items, batch.schema.field("items").type)}
            yield pa.record_batch([new.get(c, batch.column(names.index(c))) for c in kept], kept)

    kept = [f.name for f in out]
    return marked.mapInArrow(run, StructType(out))


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: bool = True) -> DataFrame:
    """(row, doc_id, n_words, spans, items) for every row of ``docs``.

    ``row`` holds all columns of the input; without ``keep`` it is left out. ``spans`` are the runs of
    hit words (first, beyond), sorted and apart; ``items`` the ids of the items with an occurring
    window, sorted as strings.

    An item of fewer words than ``window``, but not none, is one window. Null texts have no words.
    Items without an id count for the spans and are not named. Repeated items count once. Without
    items nothing is hit. Texts are read once per block of the benchmark and once to count shingles;
    no text is moved. The index of a block is broadcast; its size is bounded by ``block_bytes``.
    """
    text = F.col("text").cast("string")
    marked = docs.select(
        *[F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] * keep,
        F.col("doc_id"), text.alias("text"), F.lit(None).cast("long").alias("n_words"),
        F.from_json(F.lit("[]"), "array<struct<first:int,beyond:int>>").alias("spans"),
        F.from_json(F.lit("[]"), "array<string>").alias("items"))
    for block, last in _blocks(benchmark, block_bytes):
        index = build(block, window)
        choose_prefixes(index, _rarity(docs, index))
        marked = _mark(marked, index, last)
    # Texts are cut into words once, where they are compared; only without a block they have not been.
    if "text" in marked.columns:
        marked = marked.withColumn("n_words", F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long"))
    return marked.drop("text")


def is_contaminated(n_words, n_hit):
    """At least one word in twenty is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["beyond"] - s["first"]))
    return (find(docs, benchmark, keep=False, **options).withColumn("n_hit", n_hit)
            .select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                    is_contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated")))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows that are not contaminated, with the columns they came with."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["beyond"] - s["first"]))
    return find(docs, benchmark, **options).where(~is_contaminated(F.col("n_words"), n_hit)).select("row.*")
