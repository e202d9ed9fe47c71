"""Tables of mergeable partial aggregates, kept up by micro-batches.

A batch adds what its own rows come to, in a folder of its own that is replaced if the batch is applied
again. Whoever reads the table merges the parts of a key, so the order and the cut of batches do not
matter. Folders of finished batches are merged ``FAN`` at a time into one of the next level: a part is
rewritten once a level, and the number of folders grows with the logarithm of the number of batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import file_system
from ..sources import rewrite

BATCH = "micro_batch"
FAN = 8
_MERGED = "merged"


def _level(key: str) -> int:
    """0 for a batch's own folder, else how often its parts were merged."""
    name = key.split("-")[0]
    return int(name[len(_MERGED):]) if name.startswith(_MERGED) else 0


def folders(spark: SparkSession, path: str) -> list[str]:
    """Keys of a table's finished folders, oldest first."""
    system, root = file_system(spark, path)
    found = []
    for status in system.listStatus(root) if system.exists(root) else []:
        name, _, key = status.getPath().getName().partition("=")
        if name == BATCH and (_level(key) or system.exists(file_system(spark, f"{path}/{BATCH}={key}/_SUCCESS")[1])):
            found.append((status.getModificationTime(), key))
    return [key for _, key in sorted(found)]


def add(parts: DataFrame, key: str, path: str, by: Sequence[str] = ()) -> None:
    """Store the parts of a batch, in place of what an earlier try has stored."""
    # A rebalance keeps the parts of one value of ``by`` in few files and splits a value that holds most of them.
    rows = parts.hint("rebalance", *by) if by else parts
    rows.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/{BATCH}={key}")


def fold(spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame], by: Sequence[str] = (), but: str | None = None) -> int:
    """Merge folders of finished batches, ``FAN`` of a level at a time; returns how many merges were made.

    ``but`` is the batch at hand, which may be applied again and stays as it is. What is cut short is
    finished by the next call.
    """
    system, root = file_system(spark, path)
    if not system.exists(root):
        return 0
    rewrite.recover(spark, path)
    made, level = 0, 0
    while True:
        keys = [k for k in folders(spark, path) if k != but]
        own = [k for k in keys if _level(k) == level]
        if len(own) >= FAN:
            names = [f"{path}/{BATCH}={k}" for k in own[:FAN]]
            rows = spark.read.option("basePath", path).parquet(*names).drop(BATCH)
            merged = merge(rows).withColumn(BATCH, F.lit(f"{_MERGED}{level + 1}-{uuid.uuid4().hex}"))
            rewrite.replace(spark, path, names, merged, [BATCH, *by])
            made += 1
        elif any(_level(k) > level for k in keys):
            level += 1
        else:
            return made
