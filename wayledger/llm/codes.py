"""Vector code compression: product codes whose codebooks are searched along a trie.

Vectors are cut into equal parts, each part becomes the number of its nearest codebook entry. The
different parts of a position, in lexicographic order, are the leaves of a trie over their components.
A walk in depth keeps, for the prefix it stands on, the squared distances of that prefix to all
entries, so parts with a common prefix share this work; a leaf adds what is left of its part, takes
the nearest entry and adds its part to that entry's sums, as often as the part occurs.

All arithmetic is on integers, so results do not depend on how rows are spread over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..session import materialise

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components from this size on cannot be squared and summed in 64 bits: they count as not finite.
LIMIT = 1 << 15
#: Parts of a trie walked at once.
BLOCK = 4_096
#: Leaves whose distances are worked out at once.
LEAVES = 512

Codebooks = list[np.ndarray]


def whole_vectors(rows: DataFrame, vector: Column, parts: int = PARTS, scale: int = SCALE, **keep: Column) -> DataFrame:
    """The ``keep`` columns and ``v``: components times ``scale``, floored, of every usable vector.

    Not usable are vectors that are null or hold a null, a component that is not finite or not below
    2^15 in size, and those whose length no other rule could compare: the length most usable vectors
    have (the least of several) is taken among positive multiples of ``parts``, others are left out.
    """
    doubles = vector.cast("array<double>")
    sound = F.forall("__x", lambda x: F.coalesce((x > -LIMIT) & (x < LIMIT), F.lit(False)))
    slim = rows.select(*[c.alias(k) for k, c in keep.items()], doubles.alias("__x"))
    good = slim.where(F.col("__x").isNotNull() & sound & (F.size("__x") > 0) & (F.size("__x") % parts == 0))
    made = materialise(good.select(*keep, F.transform("__x", lambda x: F.floor(x * scale).cast("int")).alias("v")))
    sizes = made.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("many")).orderBy(F.desc("many"), "n").first()
    return made if sizes is None else made.where(F.size("v") == sizes["n"])


def first_books(vectors: DataFrame, ident: str, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks:
    """The parts of the vectors with the ``entries`` smallest ids; of vectors that share an id, the least. A
    null counts as the largest id. At most ``entries`` vectors reach the driver."""
    ids = vectors.select(F.col(ident).isNull().alias("none"), F.col(ident).alias("id")).distinct().orderBy("none", "id").limit(entries)
    own = vectors.join(F.broadcast(ids), F.col(ident).eqNullSafe(F.col("id")))
    rows = own.groupBy("none", "id").agg(F.min("v").alias("v")).orderBy("none", "id").collect()
    if not rows:
        return []
    return list(np.split(np.array([r["v"] for r in rows], np.int64), parts, axis=1))


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each of ``parts``, which are different and in lexicographic order.

    The walk holds (from, to, depth, distances of the prefix). Children of a node that are a single
    part are leaves: their remaining components are added at once. Ties go to the lower entry.
    """
    n, width = parts.shape
    entry, error = np.empty(n, np.int64), np.empty(n, np.int64)
    if width * (int(np.abs(parts).max(initial=0)) + int(np.abs(book).max(initial=0))) ** 2 < 1 << 53:
        # Every sum is a whole number that doubles hold exactly, and their products are fast.
        parts, book = parts.astype(np.float64), book.astype(np.float64)
    # What the components from each depth on add to the square of an entry's distance.
    tails = np.concatenate([np.cumsum((book * book)[:, ::-1], axis=1)[:, ::-1], np.zeros((len(book), 1), book.dtype)], axis=1)
    nodes = [(0, n, 0, np.zeros(len(book), book.dtype))] if n else []
    while nodes:
        low, high, depth, so_far = nodes.pop()
        if high - low == 1:
            leaves = np.array([low])
        else:
            column = parts[low:high, depth]
            cuts = np.concatenate([[0], np.flatnonzero(column[1:] != column[:-1]) + 1, [high - low]])
            sizes = np.diff(cuts)
            leaves = low + cuts[:-1][sizes == 1]
            for k in np.flatnonzero(sizes > 1).tolist():
                step = book[:, depth] - column[cuts[k]]
                nodes.append((low + int(cuts[k]), low + int(cuts[k + 1]), depth + 1, so_far + step * step))
        for k in range(0, len(leaves), LEAVES):
            some = leaves[k:k + LEAVES]
            rest = parts[some, depth:]
            square = (rest * rest).sum(1)[:, None] + (tails[:, depth] + so_far)[None, :] - 2 * (rest @ book[:, depth:].T)
            best = square.argmin(1)
            entry[some], error[some] = best, square[np.arange(len(some)), best].astype(np.int64)
    return entry, error


def different(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows without repeats in lexicographic order, and the place of each row among them."""
    order = np.lexsort(rows.T[::-1])
    ordered = rows[order]
    new = np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(1)]) if len(rows) else np.zeros(0, bool)
    place = np.empty(len(rows), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], place


def part_table(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """(position, part, many): the different parts, counted, range-sorted into one trie after another."""
    width = (F.size("v") / parts).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.struct(p.alias("position"), F.slice("v", p * width + 1, width).alias("part")))
    counted = vectors.select(F.explode(cut).alias("x")).groupBy("x.position", "x.part").agg(F.count("*").alias("many"))
    return materialise(counted.repartitionByRange("position", "part").sortWithinPartitions("position", "part"))


def refined(table: DataFrame, books: Codebooks, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks after ``rounds`` of assigning every part and replacing each entry by the floored mean of its
    parts; entries without parts stay. A round reads the parts once; only sums per entry are shuffled and
    reach the driver."""
    spark = table.sparkSession
    width = books[0].shape[1]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held = [(np.zeros(len(b), np.int64), np.zeros(b.shape, np.int64)) for b in shared.value]
            for batch in batches:
                at = batch.column(0).to_numpy()
                flat = batch.column(1).flatten().to_numpy().astype(np.int64).reshape(len(at), -1)
                many = batch.column(2).to_numpy()
                for position in np.unique(at).tolist():
                    own, times = flat[at == position], many[at == position]
                    for k in range(0, len(own), BLOCK):
                        entry, _ = nearest(own[k:k + BLOCK], shared.value[position])
                        np.add.at(held[position][0], entry, times[k:k + BLOCK])
                        np.add.at(held[position][1], entry, own[k:k + BLOCK] * times[k:k + BLOCK, None])
            for position, (counts, sums) in enumerate(held):
                used = np.flatnonzero(counts)
                yield pa.record_batch([pa.array(np.full(len(used), position)), pa.array(used), pa.array(counts[used]),
                                       pa.array(list(sums[used]), pa.list_(pa.int64()))], ["position", "entry", "many", "sums"])

        sums = table.mapInArrow(run, "position long, entry long, many long, sums array<long>").groupBy("position", "entry").agg(
            F.sum("many").alias("many"), F.array(*[F.sum(F.get("sums", F.lit(k))) for k in range(width)]).alias("sums")).collect()
        books = [b.copy() for b in books]
        for r in sums:
            books[r["position"]][r["entry"]] = [s // r["many"] for s in r["sums"]]
        shared.unpersist()
    return books


def digest_of(books: Codebooks) -> str:
    """SHA-256 of all components by part, entry and position within the part."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def encoded(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """The rows of ``vectors`` without ``v``, with ``code`` (two hexadecimal digits a part, more for more than
    256 entries) and ``error``. No row is moved: each batch has its own tries."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    names = [c for c in vectors.columns if c != "v"]
    digits = max(2, len(f"{max(len(books[0]) - 1, 0):x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                some = batch.slice(start, BLOCK)
                rows = some.column(0).flatten().to_numpy().astype(np.int64).reshape(some.num_rows, -1)
                error, codes = np.zeros(some.num_rows, np.int64), []
                for part, book in zip(np.split(rows, len(shared.value), axis=1), shared.value, strict=True):
                    leaves, place = different(part)
                    entry, square = nearest(leaves, book)
                    error += square[place]
                    codes.append(entry[place])
                code = ["".join(f"{c:0{digits}x}" for c in row) for row in np.stack(codes, 1).tolist()]
                yield pa.record_batch([*some.columns[1:], pa.array(code, pa.string()), pa.array(error)], [*names, "code", "error"])

    made = StructType([*[vectors.schema[c] for c in names], StructField("code", StringType()), StructField("error", LongType())])
    return vectors.select("v", *names).mapInArrow(run, made)


def compress(
    rows: DataFrame, vector: Column, ident: Column, label: Column, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 for every usable vector.

    ``label_error`` sums the errors of equal labels, nulls together. Rows that repeat are coded and
    counted each. Without a usable vector there are no rows.
    """
    vectors = whole_vectors(rows, vector, parts, scale, vec_id=ident, label=label)
    books = first_books(vectors, "vec_id", parts, entries)
    if not books:
        return vectors.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                              F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    books = refined(part_table(vectors, parts), books, rounds)
    coded = materialise(encoded(vectors, books))
    per_label = coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    return coded.join(per_label, F.col("label").eqNullSafe(F.col("__label"))).select(
        "vec_id", "label", "code", "error", "label_error", F.lit(digest_of(books)).alias("codebooks_sha256"))
