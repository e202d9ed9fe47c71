"""Document fingerprints by MinHash, and near-duplicates from their bands.

A text is the set of its runs of five words. Each of many universal hash functions keeps the least
value it takes on that set; two texts agree on a function as often as their sets are alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, passing_dir, small_batches
from .common import one_row_each
from .components import components

SHINGLE = 5
FUNCTIONS = 128
BANDS, ROWS = 25, 5
SIMILARITY = 0.8
SEED = 11
#: Shingles hashed at once.
STEP = 1 << 11
#: Distinct words a worker remembers.
MEMORY = 1 << 17
#: Rows put together before they are handed on.
OUT_ROWS = 1_000
#: Sets that a worker remembers while it compares.
HELD_SETS = 64
#: Bits that tell of a set, for each share of the hash values, whether it has an odd number of them.
PARITIES = 512

_RNG = np.random.default_rng(SEED)
#: h(x) = (a x + b mod 2^64) / 2^32, a odd: universal on 64-bit shingle values.
_A = _RNG.integers(0, 1 << 63, FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, FUNCTIONS, dtype=np.uint64)
_PLACE = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Words(dict):
    """Word to a 64-bit value."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: str | None, words: Words, size: int = SHINGLE) -> np.ndarray:
    """A value per run of ``size`` words, repeats included; one for a shorter text, none without words."""
    own = np.fromiter(map(words.__getitem__, (text or "").encode("utf-8", "surrogatepass").lower().split()), np.uint64)
    if not len(own):
        return own
    if len(own) < size:
        own = np.concatenate([own, np.zeros(size - len(own), np.uint64)])
    n = len(own) - size + 1
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += own[k:k + n] * _PLACE[k]
    return (total ^ (total >> np.uint64(29))) * _PLACE[-1]


def signature(values: np.ndarray) -> np.ndarray:
    """The least value of each hash function; all ones for a text without words."""
    least = np.full(FUNCTIONS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), STEP):
        hashed = _A[:, None] * values[None, at:at + STEP]
        hashed += _B[:, None]
        np.minimum(least, hashed.min(1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def bands_of(sig: np.ndarray) -> list[int]:
    """One number per band of a signature; equal bands at different places have different numbers."""
    return [xxhash.xxh64_intdigest(sig[k * ROWS:(k + 1) * ROWS].tobytes(), k) - (1 << 63) for k in range(BANDS)]


def parities(items: np.ndarray) -> list[int]:
    """Whether the number of items is odd, for each value of their first bits. Sets that differ in d items differ in d of these at most."""
    odd = np.bincount((items >> np.uint64(64 - PARITIES.bit_length() + 1)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def key_of(items: np.ndarray) -> str:
    """A digest of a set of shingles, given in order."""
    return hashlib.md5(items.tobytes()).hexdigest()


def printed(sig: np.ndarray) -> bytes:
    """One byte of each value."""
    return sig.astype(np.uint8).tobytes()


def written(made: DataFrame) -> DataFrame:
    """Checksums and fingerprints as lower-case hexadecimal; as bytes, as they are kept meanwhile, they take half the disk."""
    return made.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal bytes less what chance makes equal; 1 for equal fingerprints."""
    equal = float((a.astype(np.uint8) == b.astype(np.uint8)).mean())
    return max(0.0, (equal - 1 / 256) / (1 - 1 / 256))


def edited(text: str, following: str) -> str:
    """The last third replaced by as much of the beginning of another text."""
    third = len(text) // 3
    return text[:len(text) - third] + following[:third]


def in_descending_ranges(docs: DataFrame) -> DataFrame:
    """(doc_id, text, extra): ids dealt to one range a partition and sorted downwards within it.

    Each partition ends with a copy of the row that follows its last, marked ``extra``: the first row
    of the next lower range that has rows, or of the topmost. Ids that are null come last. Only the
    bounds and the first id of each range, one per partition, reach the driver; texts move once.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = slim.select(F.col("doc_id").cast("double").alias("__id"))
    cuts = sorted(set(ids.where("__id is not null").approxQuantile("__id", [k / parts for k in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    splits = [-float("inf"), *(cuts or [0.0]), float("inf")]
    placed = Bucketizer(splits=splits, inputCol="__id", outputCol="__range").transform(
        slim.withColumn("__id", F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.7e308)))).withColumn("range", F.col("__range").cast("int"))
    heads = {r["range"]: r["head"] for r in placed.groupBy("range").agg(F.max("doc_id").alias("head")).collect()}
    order = sorted(heads, reverse=True)
    # The first row of a range closes the range above it; that of the topmost closes the lowest.
    closes = {r: order[(k - 1) % len(order)] for k, r in enumerate(order)}
    every = range(len(splits) - 1)
    at = (F.col("range") + 1).cast("int")
    head = F.element_at(F.array(*[F.lit(heads.get(r)).cast("long") for r in every]), at)
    to = F.element_at(F.array(*[F.lit(closes.get(r, 0)) for r in every]), at)
    own = F.struct(F.col("range").alias("to"), F.lit(False).alias("extra"))
    copy = F.when(F.col("doc_id").eqNullSafe(head), F.array(own, F.struct(to.alias("to"), F.lit(True).alias("extra")))).otherwise(F.array(own))
    dealt = placed.select("doc_id", "text", F.explode(copy).alias("at")).select("doc_id", "text", "at.*")
    return (dealt.repartitionById(len(splits) - 1, F.col("to"))
            .sortWithinPartitions("extra", F.col("doc_id").desc_nulls_last(), "text").select("doc_id", "text", "extra"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next for every row.

    The next document is the one with the next smaller id; after the last comes the first, and a
    single document follows itself. Null texts count as empty. Rows with equal ids follow each other
    by text. An empty table gives no rows.
    """
    return written(compared(docs).drop(*_MARKS))


def compared(docs: DataFrame) -> DataFrame:
    """The columns of :func:`fingerprints` as bytes (:func:`written`), and digest, key, n and bands as in :func:`marked`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, before, out, closed = Words(), None, [], False

        def packed() -> pa.RecordBatch:
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", *_MARKS]
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), *_MARKS.values()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for doc_id, text, extra in zip(*(c for c in batch.columns), strict=True):
                if closed:
                    continue  # rows that share the closing id
                doc_id, text, closed = doc_id.as_py(), text.as_py(), extra.as_py()
                items = np.unique(shingles(text, words))
                sig = signature(items)
                if before is not None:
                    other, old, old_items, old_sig = before
                    new = edited(old, text)
                    new_sig = signature(shingles(new, words))
                    out.append((other, len(old), hashlib.sha256(new.encode("utf-8", "surrogatepass")).digest(), printed(old_sig),
                                printed(new_sig), likeness(old_sig, new_sig), likeness(old_sig, sig), *mark(old, old_items, old_sig)))
                    if len(out) >= OUT_ROWS:
                        yield packed()
                        out.clear()
                before = (doc_id, text, items, sig)
        if out:
            yield packed()

    return in_descending_ranges(docs).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, "
             f"{_MARKS_SCHEMA}")


_MARKS = {"digest": pa.string(), "key": pa.string(), "n": pa.int64(), "bands": pa.list_(pa.int64())}
_MARKS_SCHEMA = "digest string, key string, n long, bands array<long>"


def mark(text: str | None, items: np.ndarray, sig: np.ndarray) -> tuple[str, str, int, list[int]]:
    return hashlib.md5((text or "").encode("utf-8", "surrogatepass")).hexdigest(), key_of(items), len(items), bands_of(sig)


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, key, n, bands) for every row: digests of its text and of its set of shingles, the
    size of the set and its bands. Shingles stay in the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            rows = []
            for t in batch.column(1):
                items = np.unique(shingles(t.as_py(), words))
                rows.append(mark(t.as_py(), items, signature(items)))
            columns = zip(*rows, strict=True) if rows else [[]] * len(_MARKS)
            yield pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, _MARKS.values(), strict=True))], ["doc_id", *_MARKS])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id long, {_MARKS_SCHEMA}")


def alike(docs: DataFrame, classes: DataFrame, pairs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Those (a, b) of ``pairs`` whose sets of shingles are as alike as asked, by the sets themselves.

    ``classes`` has (node, digest). Only texts of classes in a pair are moved, one for each class; they
    are written for as long as they are compared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held = Words(), {}

        def items(node: int, text: pa.Scalar) -> np.ndarray:
            if node not in held:
                if len(held) >= HELD_SETS:
                    held.clear()
                held[node] = np.unique(shingles(text.as_py(), words))
            return held[node]

        for batch in batches:
            out = []
            for a, b, text, text_b in zip(*batch.columns, strict=True):
                a, b = a.as_py(), b.as_py()
                x, y = items(a, text), items(b, text_b)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if shared >= similarity * (len(x) + len(y) - shared):
                    out.append((a, b))
            yield pa.record_batch([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    with passing_dir(docs.sparkSession) as folder:
        pairs = materialise(pairs, folder)
        nodes = pairs.select(F.col("a").alias("node")).distinct().union(pairs.select("b").distinct()).distinct()
        wanted = materialise(classes.join(nodes, "node", "left_semi").select("node", "digest"), folder)
        texts = materialise(texts_of(docs, wanted), folder)
        both = (pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
                .join(texts.select(F.col("node").alias("a"), "text"), "a"))
        return materialise(both.select("a", "b", "text", "text_b").mapInArrow(run, "a long, b long"))


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) for every row of ``wanted`` (node, digest), which is read twice."""
    # The first 20 bits of a digest keep most other texts where they are; there are 2^20 at most.
    start = F.substring("digest", 1, 5)
    starts = F.broadcast(wanted.select(start.alias("start")).distinct())
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    same = Window.partitionBy("digest").orderBy("start")
    texts = (docs.select(text.alias("text"), F.md5(text.cast("binary")).alias("digest")).withColumn("start", start)
             .join(starts, "start", "left_semi").withColumn("place", F.row_number().over(same)).where("place = 1"))
    return texts.join(wanted, "digest").select("node", "text")


def stars(filed: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b) of ``filed`` (value, node, n): every member of a value with the least, unless their sizes forbid it. One
    row a member at most, however many share a value. What this leaves out is for :func:`sharing` to find."""
    heads = filed.groupBy("value").agg(F.min("node").alias("a"), F.min_by("n", "node").alias("n_a"))
    close = F.least("n", "n_a") >= F.lit(similarity) * F.greatest("n", "n_a")  # sets of too different sizes cannot be alike
    return filed.join(heads, "value").where((F.col("node") > F.col("a")) & close).select("a", F.col("node").alias("b")).distinct()


def sharing(docs: DataFrame, opened: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b) for all sets of ``opened`` (node, n, root, digest) under different roots that may be as alike as asked.

    No such pair is left out. Two sets as alike as s share s / (1 + s) of the sum of their sizes at least. A shingle
    that only one root holds cannot be shared across roots; the c of a set that are left have one order for all, rare
    ones first. The first one that a pair shares is then followed, in either set, by as many as must still be shared.
    Nor do the sets differ in more shingles than the rest of that sum, so neither do more of their parities. Only
    pairs of which all this holds leave the join.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for node, text in zip(*batch.columns, strict=True):
                items = np.unique(shingles(text.as_py(), words))
                yield pa.record_batch([pa.array([node.as_py()], pa.int64()), pa.array([parities(items)], pa.list_(pa.int64())),
                                       pa.ListArray.from_arrays([0, len(items)], pa.array(items.view(np.int64)))], ["node", "odd", "own"])

    share = similarity / (1 + similarity)
    with passing_dir(docs.sparkSession) as folder:
        texts = texts_of(docs, opened.select("node", "digest")).select("node", "text")
        sets = materialise(texts.mapInArrow(run, "node long, odd array<long>, own array<long>"), folder)
        sizes = opened.select("node", "n", "root").join(sets.select("node", "odd"), "node")
        held = sets.select("node", F.explode("own").alias("value"))
        rooted = held.join(opened.select("node", "root"), "node")
        across = rooted.groupBy("value").agg(F.count("*").alias("many"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
        own = Window.partitionBy("node")
        placed = (held.join(across.select("value", "many"), "value")
                  .withColumn("c", F.count("*").over(own)).withColumn("place", F.row_number().over(own.orderBy("many", "value"))))
        # How many shingles follow a place, itself included. All bounds are a little wide, so that rounding leaves no pair out.
        after = placed.select("node", "value", (F.col("c") - F.col("place") + 1).alias("after")).join(sizes, "node")
        filed = materialise(after.where(F.col("after") >= F.lit(similarity) * F.col("n") - 1e-6), folder)
        left, right = (filed.select("value", *[F.col(c).alias(f"{c}_{k}") for c in ("node", "n", "root", "odd", "after")]) for k in "ab")
        # The smaller set shares more of its own, so fewer of its places can be the first.
        left = left.where(F.col("after_a") >= F.lit(2 * share) * F.col("n_a") - 1e-6)
        total = F.col("n_a") + F.col("n_b")
        unlike = sum((F.bit_count(F.col("odd_a")[k].bitwiseXOR(F.col("odd_b")[k])) for k in range(PARITIES // 64)), F.lit(0))
        found = left.join(right, "value").where(
            (F.col("root_a") != F.col("root_b")) & (F.struct("n_a", "node_a") < F.struct("n_b", "node_b"))
            & (F.least("after_a", "after_b") >= F.lit(share) * total - 1e-6) & (unlike <= F.lit(1 - 2 * share) * total + 1e-6))
        return materialise(found.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct())


def groups(docs: DataFrame, marks: DataFrame, similarity: float = SIMILARITY, also: DataFrame | None = None) -> DataFrame:
    """(key, class_id, root) for every set of shingles in ``marks``, which :func:`marked` made of ``docs``.

    ``class_id`` is the smallest id with that set; sets reach each other over links of at least the
    similarity where their root is the same. Sets that share a band are candidates, and so are texts that
    share a value in ``also`` (digest, value); the sets themselves decide. First each set is compared with the
    least of each of its bands, mostly one for all. Of the bands that still hold several roots, every pair
    under different roots that may be alike is compared (:func:`sharing`), so no candidate is left out,
    while neither many copies nor many unlike sets in a band make pairs.
    """
    one = Window.partitionBy("key").orderBy(F.col("doc_id").asc_nulls_last(), "digest")
    classes = materialise(marks.withColumn("place", F.row_number().over(one)).where("place = 1")
                          .select(F.monotonically_increasing_id().alias("node"), "key", F.col("doc_id").alias("class_id"), "digest", "n", "bands"))
    filed = classes.select("node", "n", F.explode("bands").alias("value"))
    if also is not None:
        named = also.join(marks.select("digest", "key").distinct(), "digest").select("key", "value").distinct()
        filed = filed.unionByName(materialise(classes.join(named, "key").select("node", "n", "value")))
    links = alike(docs, classes, stars(filed, similarity), similarity)
    roots = materialise(components(links, "a", "b"))
    # Only numbers of sets and bands are moved to tell the open ones; few sets have any.
    rooted = filed.select("node", "value").join(roots, "node", "left").select("node", "value", F.coalesce("root", "node").alias("root"))
    parted = rooted.groupBy("value").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("value")
    nodes = rooted.join(parted, "value", "left_semi").select("node").distinct()
    opened = materialise(classes.join(nodes, "node", "left_semi").join(roots, "node", "left").select("node", "n", F.coalesce("root", "node").alias("root"), "digest"))
    more = alike(docs, classes, sharing(docs, opened, similarity), similarity)
    if not more.isEmpty():
        roots = components(links.unionByName(more), "a", "b")
    return classes.join(roots, "node", "left").select("key", "class_id", F.coalesce("root", "node").alias("root"))


def fingerprints_and_groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The columns of :func:`fingerprints`, and class_id and near_id for every row.

    ``class_id`` is the smallest id with the same set of shingles, ``near_id`` the smallest that is
    reached over sets as alike as asked. Both are null where no such row has an id.
    """
    with small_batches(docs.sparkSession):
        marks = materialise(compared(docs))
        found = materialise(groups(docs, marks, similarity))
    named = found.join(found.groupBy("root").agg(F.min("class_id").alias("near_id")), "root").select("key", "class_id", "near_id")
    return written(marks.drop("digest", "n", "bands").join(named, "key").drop("key"))


def representatives(docs: DataFrame, similarity: float = SIMILARITY, also: DataFrame | None = None) -> DataFrame:
    """One row of each group of near-duplicates with all its columns, chosen as by :func:`.common.one_row_each`.

    ``also`` has further candidates, as in :func:`groups`.
    """
    with small_batches(docs.sparkSession):
        marks = materialise(marked(docs))
        found = groups(docs, marks, similarity, also)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "digest"))
    by_key = marks.groupBy("key").agg(first.alias("first")).join(found, "key")
    return one_row_each(docs, by_key.groupBy("root").agg(F.min("first").alias("first")).select("first.*"))
