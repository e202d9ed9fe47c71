"""Table layouts: driver tables with explicit schemas, and the reads table by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rewrite

# Explicit schemas: no inference pass, and timestamps without zone are read as UTC instants,
# so time filters reach the Parquet scan.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
              " o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
                " l_extendedprice double, l_discount double, l_tax double, l_returnflag string,"
                " l_linestatus string, l_shipdate timestamp",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def write_reads(reads: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Reads by day, then by camera and time inside each file.

    Days are dealt to tasks by their size: adaptive execution splits a large day and puts small ones
    together (``spark.sql.adaptive.advisoryPartitionSizeInBytes``), so no task writes a whole large
    day and a small one is not cut into crumbs. ``overwrite`` replaces only the days present in
    ``reads``.
    """
    dated = reads.withColumn("capture_date", F.to_date("captured_at"))
    (
        dated.hint("rebalance", F.col("capture_date")).sortWithinPartitions("capture_date", "camera_id", F.col("captured_at").desc())
        .write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("capture_date").parquet(path)
    )


def read_reads(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def delete_rows(spark: SparkSession, path: str, gone: Column) -> int:
    """Remove rows of a reads table; returns the number of files rewritten.

    Only files that lose rows are read and written again, and files added meanwhile stay.
    """
    hit = F.coalesce(gone, F.lit(False))
    return rewrite.change(spark, path, lambda t: t.filter(hit), lambda t: t.filter(~hit), ["capture_date"])
