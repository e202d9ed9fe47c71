"""Hash-chained event logs: link hashes, verification, sequence gaps, node heads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import refdata as R
from .ordered import with_previous, with_running


def json_text(c: Column) -> Column:
    """JSON string literal of a text column, non-ASCII left as is."""
    escaped = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
    plain = escaped
    for code in range(0x20):
        escaped = F.replace(escaped, F.lit(chr(code)), F.lit(short.get(chr(code), f"\\u{code:04x}")))
    # Control characters are rare: texts without any are not searched for each.
    shown = F.when(c.rlike(r"[\x00-\x1F]"), escaped).otherwise(plain)
    return F.concat(F.lit('"'), shown, F.lit('"'))


def payload_digest(payload: Column) -> Column:
    """SHA-256 of the canonical payload text. The stored text is hashed, never re-serialised."""
    return F.sha2(F.encode(payload, "UTF-8"), 256)


def header_text() -> Column:
    """Canonical signed header: sorted keys, no spaces."""
    return F.concat(
        F.lit('{"captured_at":'), json_text(F.col("captured_at")),
        F.lit(',"node_id":'), json_text(F.col("node_id")),
        F.lit(',"payload_hash":'), json_text(F.col("payload_hash")),
        F.lit(',"prev_hash":'), json_text(F.col("prev_hash")),
        F.lit(',"sequence":'), F.col("sequence").cast("string"), F.lit("}"),
    )


def link_hash() -> Column:
    """What the next event must carry as ``prev_hash``."""
    return F.sha2(F.concat(F.encode(header_text(), "UTF-8"), F.unbase64("signature")), 256)


def with_verdict(events: DataFrame) -> DataFrame:
    """Add ``payload_hash_ok``, ``verified`` (fails closed) and ``link_hash``."""
    return (
        events.withColumn("payload_hash_ok", payload_digest(F.col("payload")) == F.col("payload_hash"))
        .withColumn("verified", F.col("payload_hash_ok") & F.coalesce("signature_ok", F.lit(False)))
        .withColumn("link_hash", link_hash())
    )


def chain_breaks(events: DataFrame, start: str | None = R.GENESIS) -> DataFrame:
    """Every event that breaks its node's chain, with the reason.

    ``start=None`` verifies a pruned chain from its first surviving link. A sequence gap is
    reported before a bad link, as only one reason is kept per event.
    """
    checked = with_verdict(events).select("node_id", "sequence", "prev_hash", "verified", "link_hash")
    linked = with_previous(checked, ["node_id"], "sequence", ["sequence", "link_hash"])
    first = F.col("prev_sequence").isNull()
    expected = F.when(first, F.col("prev_hash") if start is None else F.lit(start)).otherwise(F.col("prev_link_hash"))
    gap = ~first & (F.col("sequence") != F.col("prev_sequence") + 1)
    bad = ~F.col("verified") | (F.col("prev_hash") != expected)
    reason = F.when(
        gap, F.format_string("sequence gap at %d (expected %d)", "sequence", F.col("prev_sequence") + 1)
    ).when(bad, F.format_string("verification failed at sequence %d", "sequence"))
    return linked.withColumn("reason", reason).select("node_id", "sequence", "reason").filter("reason is not null")


def verify_chains(events: DataFrame, start: str | None = R.GENESIS) -> DataFrame:
    """One verdict per node: span, event count, first break."""
    spans = events.groupBy("node_id").agg(
        F.count("*").alias("n_events"), F.min("sequence").alias("first_sequence"),
        F.max("sequence").alias("last_sequence"),
    )
    first_break = chain_breaks(events, start).groupBy("node_id").agg(F.min_by("reason", "sequence").alias("reason"))
    return spans.join(first_break, "node_id", "left").select(
        "node_id", "n_events", "first_sequence", "last_sequence", F.col("reason").isNull().alias("ok"), "reason"
    )


def arrival_gaps(events: DataFrame, heads: DataFrame | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """Sequence gaps as seen in arrival order; a late event never moves the head back.

    ``ties`` are columns that order events with equal arrival, such as the batch; they are returned
    as well. Events that these leave equal are ordered by sequence.
    """
    seen = with_running(
        events.select("node_id", "sequence", "arrival", *ties), ["node_id"], "arrival", F.col("sequence"),
        "_head", inclusive=False, ties=[*ties, "sequence"],
    )
    if heads is not None:
        known = heads.select("node_id", F.col("chain_sequence").alias("_stored"))
        seen = seen.join(known, "node_id", "left")
    else:
        seen = seen.withColumn("_stored", F.lit(0).cast("bigint"))
    head = F.coalesce(F.greatest("_head", "_stored"), F.lit(0).cast("bigint"))
    return seen.filter(F.col("sequence") > head + 1).select(
        "node_id", "arrival", *ties, (head + 1).alias("expected"), F.col("sequence").alias("received"),
        (F.col("sequence") - head - 1).alias("missing"),
    )


def node_heads(events: DataFrame) -> DataFrame:
    """Highest sequence, its link hash and the last arrival per node."""
    return events.groupBy("node_id").agg(
        F.max("sequence").alias("chain_sequence"),
        F.max_by(link_hash(), F.col("sequence")).alias("chain_head"),
        F.max("received_at").alias("last_seen_at"),
    )


def stored_gaps(reads: DataFrame) -> DataFrame:
    """Missing sequence ranges of stored reads, per node."""
    seq = with_previous(reads.select("node_id", "sequence"), ["node_id"], "sequence", ["sequence"])
    return seq.filter(F.col("sequence") != F.col("prev_sequence") + 1).select(
        "node_id", (F.col("prev_sequence") + 1).alias("gap_from"), (F.col("sequence") - 1).alias("gap_to")
    )


def verify_stored_reads(reads: DataFrame) -> DataFrame:
    """Per node: reads, sequence span, signature failures, number of gaps."""
    counts = reads.groupBy("node_id").agg(
        F.count("*").alias("n_reads"), F.min("sequence").alias("first_sequence"),
        F.max("sequence").alias("last_sequence"),
        F.count_if(~F.coalesce("signature_ok", F.lit(False))).alias("signature_failures"),
    )
    gaps = stored_gaps(reads).groupBy("node_id").agg(F.count("*").alias("n_gaps"))
    return counts.join(gaps, "node_id", "left").fillna(0, ["n_gaps"])
