"""Signed event batches from JSON files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The payload stays raw text: its bytes are what was hashed.
EVENT = (
    "struct<node_id:string,sequence:string,captured_at:string,prev_hash:string,payload_hash:string,"
    "signature:string,payload:string,signature_ok:boolean>"
)
ENVELOPE = f"batch_id string, node_id string, received_at timestamp, arrival bigint, events array<{EVENT}>, _corrupt_record string"
REQUIRED = ["node_id", "sequence", "captured_at", "prev_hash", "payload_hash", "signature"]


def read_envelopes(spark: SparkSession, path: str, stream: bool = False, **options: str) -> DataFrame:
    """One row per delivered batch; lines that are not JSON land in ``_corrupt_record``."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(ENVELOPE).options(
        mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record", **options
    ).json(path)


def unpack(envelopes: DataFrame) -> DataFrame:
    """Events of the batches, with arrival numbers that keep the order inside a batch."""
    rows = envelopes.filter("_corrupt_record is null").select(
        "batch_id", F.col("node_id").alias("batch_node"), "received_at", F.col("arrival").alias("_base"),
        F.posexplode("events").alias("_pos", "e"),
    )
    return rows.select(
        "batch_id", "batch_node", "received_at", (F.col("_base") + F.col("_pos")).alias("arrival"), "e.*"
    )


def event_error() -> Column:
    """Why an event is refused, null when it is well formed."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED]))
    return (
        F.when(F.size(missing) > 0, F.concat(F.lit("malformed event: missing "), F.array_join(missing, ", ")))
        .when(F.expr("try_cast(sequence as bigint)").isNull(), "malformed event: bad sequence")
        .when(F.col("node_id") != F.col("batch_node"), F.concat(
            F.lit("event claims node '"), "node_id", F.lit("' in a '"), "batch_node", F.lit("' batch")))
    )


def split_wellformed(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(good, rejected)`` events."""
    judged = events.withColumn("error", event_error())
    good = judged.filter("error is null").drop("error").withColumn("sequence", F.col("sequence").cast("bigint"))
    return good, judged.filter("error is not null").select("batch_id", "batch_node", "sequence", "error")


def from_active_nodes(events: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(admitted, refused)``: events of unknown or inactive nodes are refused."""
    status = nodes.select("node_id", F.col("active").alias("_active"))
    joined = events.join(status, "node_id", "left")
    refused = joined.filter(~F.coalesce("_active", F.lit(False))).withColumn(
        "error", F.when(F.col("_active").isNull(), "node is not enrolled").otherwise("node is deactivated")
    )
    return joined.filter("_active").drop("_active"), refused.drop("_active")
