"""Near-duplicates by SimHash, found in the space of per-segment bit counts.

A 64-bit fingerprint is cut into segments of ``segment_bits`` bits; the number of set bits of each
segment is one coordinate. Flipping one bit moves one coordinate by one, so the Manhattan distance of
two embedded fingerprints never exceeds their Hamming distance. The coordinates are split into two
groups: fingerprints at 3 or fewer differing bits lie within Manhattan distance 1 in one of them.
The grid therefore has one cell per vector of a group, and the range join looks into a cell and its
upper neighbours. Hamming distance decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import materialise, small_batches
from .common import one_row_each
from .components import components

SEED = 42
BITS = 64
GROUPS = 2
#: Fingerprints link at so many differing bits or fewer: one of GROUPS groups then differs by 1 at most.
DISTANCE = 2 * GROUPS - 1
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Bits that are set in over half the hashes of a text's word shingles, as a signed number."""
    # On UTF-8 bytes, lower() touches A-Z only and split() splits at ASCII white space only.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(shingle, len(words)) - 1:].tolist()
    counts = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[at:at + CHUNK], stops[at:at + CHUNK], strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * counts > n).astype(np.uint8), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, **keys: Column) -> DataFrame:
    """The key columns and ``fp`` for every row: its fingerprint as a signed number, 0 for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in batch.column(0)]
            yield pa.record_batch([*batch.columns[1:], pa.array(fps, pa.int64())], [*batch.schema.names[1:], "fp"])

    slim = docs.select(F.col("text").cast("string").alias("__text"), *[c.alias(k) for k, c in keys.items()])
    return slim.mapInArrow(run, StructType([*slim.schema.fields[1:], StructField("fp", LongType())]))


def embed(bits: Column, segment_bits: int = 2) -> Column:
    """Set bits of every segment of a group of 32 bits, each count in the place of its segment."""
    width, v = 1, bits
    while width < segment_bits:
        mask = F.lit(sum(((1 << width) - 1) << s for s in range(0, BITS // GROUPS, 2 * width))).cast("long")
        v = v.bitwiseAND(mask) + F.shiftrightunsigned(v, width).bitwiseAND(mask)
        width *= 2
    return v


def links(fps: DataFrame, segment_bits: int = 2) -> DataFrame:
    """(a, b), a < b, for all pairs of different fingerprints at 3 or fewer differing bits.

    ``fps`` holds distinct fingerprints in ``fp``. A pair may come once per group.
    """
    if segment_bits not in (1, 2, 4):
        raise ValueError("segment_bits must be 1, 2 or 4")
    half = BITS // GROUPS
    low = F.lit((1 << half) - 1).cast("long")
    parts = fps.select("fp", F.posexplode(F.array(*[
        embed(F.shiftrightunsigned("fp", half * g).bitwiseAND(low), segment_bits) for g in range(GROUPS)])).alias("part", "cell"))
    field = (1 << segment_bits) - 1
    # One step up in one coordinate; from the other side of the pair it is a step down.
    up = F.array(*[F.when(F.shiftrightunsigned("cell", s).bitwiseAND(F.lit(field).cast("long")) < segment_bits,
                          F.col("cell") + F.lit(1 << s).cast("long")) for s in range(0, half, segment_bits)])
    probes = parts.select("part", F.col("fp").alias("p"), F.col("cell").alias("own"),
                          F.explode(F.array_compact(F.concat(F.array("cell"), up))).alias("cell"))
    found = probes.join(parts, ["part", "cell"]).where(
        (F.bit_count(F.col("p").bitwiseXOR(F.col("fp"))) <= DISTANCE) & ((F.col("own") != F.col("cell")) | (F.col("p") < F.col("fp"))))
    return found.select(F.least("p", "fp").alias("a"), F.greatest("p", "fp").alias("b"))


def _roots(marks: DataFrame, segment_bits: int) -> DataFrame:
    """(fp, root) for every distinct fingerprint.

    Equal fingerprints form one class before anything is joined, so a flood of copies leaves each
    task as one row. Links and labels run between classes; nothing per document reaches the driver.
    """
    classes = materialise(marks.select("fp").distinct())
    roots = components(links(classes, segment_bits), "a", "b")
    return classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, segment_bits: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest id reachable over links.

    Null and empty texts have fingerprint 0 and link like any other. Rows without an id take part
    but are never named: their component has the smallest id there is, or null. Repeated rows come
    out as often as they go in. An empty table gives no rows.
    """
    marks = materialise(fingerprints(docs, shingle, doc_id=F.col("doc_id").cast("long")))
    rooted = _roots(marks, segment_bits)
    by_fp = marks.groupBy("fp").agg(F.min("doc_id").alias("least")).join(rooted, "fp")
    least = by_fp.groupBy("root").agg(F.min("least").alias("component_id"))
    named = by_fp.join(least, "root").select("fp", "component_id")
    return marks.join(named, "fp").select("doc_id", "fp", "component_id")


def linked(docs: DataFrame, shingle: int = 3, segment_bits: int = 2) -> DataFrame:
    """(digest, value) for every different text: the md5 of the text, and one value for all texts whose fingerprints reach each other."""
    digest = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    with small_batches(docs.sparkSession):
        marks = materialise(fingerprints(docs, shingle, digest=digest).distinct())
    return marks.join(_roots(marks, segment_bits), "fp").select("digest", F.xxhash64(F.lit("simhash"), "root").alias("value"))


def representatives(docs: DataFrame, shingle: int = 3, segment_bits: int = 2) -> DataFrame:
    """One row of each component with all its columns: that with the smallest id, then the smallest digest of its text.

    Rows without an id come last; a component of such rows keeps one of them. Of rows that repeat id
    and text one stays.
    """
    digest = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    marks = materialise(fingerprints(docs, shingle, doc_id=F.col("doc_id").cast("long"), digest=digest))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "digest"))
    by_fp = marks.groupBy("fp").agg(first.alias("first")).join(_roots(marks, segment_bits), "fp")
    kept = by_fp.groupBy("root").agg(F.min("first").alias("first")).select("first.*")
    return one_row_each(docs, kept)
