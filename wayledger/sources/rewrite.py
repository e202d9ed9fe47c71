"""Change rows of Parquet tables in place, file by file, beside writers that append.

Only files that hold touched rows are read and replaced. New files are written to a hidden folder
together with the list of files they stand for; then the old ones are deleted and the new ones
moved in. A driver that ends in between leaves a folder that the next call finishes, so no row is
lost or doubled. Files that others add meanwhile are not on the list and stay.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import file_system

_HIDDEN = "_rewriting-"


def _path(spark: SparkSession, name: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)


def _files_below(system, folder) -> list[str]:
    found, listing = [], system.listFiles(folder, True)
    while listing.hasNext():
        name = listing.next().getPath().toString()
        if name.endswith(".parquet"):
            found.append(name)
    return found


def _finish(spark: SparkSession, table: str, hidden: str) -> None:
    """Delete the files that are replaced, move the new ones in, remove the folder. May be repeated."""
    system, rows = file_system(spark, f"{hidden}/rows")
    folders = {}
    for row in spark.read.text(f"{hidden}/old").collect():  # file names only
        old = _path(spark, row[0])
        system.delete(old, True)
        folders[old.getParent().toString()] = old.getParent()
    if system.exists(rows):
        top = system.getFileStatus(rows).getPath().toString()
        for name in _files_below(system, rows):
            target = _path(spark, f"{table}{name[len(top):]}")
            system.mkdirs(target.getParent())
            system.rename(_path(spark, name), target)
    top = system.makeQualified(_path(spark, table)).toString()
    for name, folder in folders.items():
        # A partition that has lost its last file goes; one that others write to is not empty.
        if system.makeQualified(folder).toString() != top and system.exists(folder) and not system.listStatus(folder):
            system.delete(folder, False)
    system.delete(_path(spark, hidden), True)


def recover(spark: SparkSession, table: str) -> int:
    """Finish or undo what an ended driver left in a table's folder; returns how many were finished."""
    system, root = file_system(spark, table)
    finished = 0
    for status in system.listStatus(root):
        name = status.getPath().getName()
        if name.startswith(_HIDDEN):
            if system.exists(_path(spark, f"{table}/{name}/old/_SUCCESS")):
                _finish(spark, table, f"{table}/{name}")
                finished += 1
            else:
                system.delete(status.getPath(), True)
    return finished


def replace(spark: SparkSession, table: str, old: Sequence[str], rows: DataFrame, partition_by: Sequence[str] = ()) -> None:
    """Let ``rows`` stand for the files ``old`` of a table."""
    hidden = f"{table}/{_HIDDEN}{uuid.uuid4().hex}"
    rows.write.partitionBy(*partition_by).parquet(f"{hidden}/rows")
    spark.createDataFrame([(name,) for name in old], "value string").coalesce(1).write.text(f"{hidden}/old")
    _finish(spark, table, hidden)


def change(
    spark: SparkSession, table: str, touched: Callable[[DataFrame], DataFrame], changed: Callable[[DataFrame], DataFrame],
    partition_by: Sequence[str] = (), schema: StructType | None = None,
) -> int:
    """Replace the files that hold rows of ``touched`` by ``changed`` of their rows; returns their number.

    A table that may have lost all its files needs its ``schema``. Both functions take a frame of the table; ``touched`` keeps the column ``_file``. Only file names
    reach the driver.
    """
    recover(spark, table)
    reader = spark.read.option("basePath", table)
    reader = reader.schema(schema) if schema is not None else reader
    every = reader.parquet(table)
    files = [r[0] for r in touched(every.withColumn("_file", F.col("_metadata.file_path"))).select("_file").distinct().collect()]
    if files:
        replace(spark, table, files, changed(reader.parquet(*files)), partition_by)
    return len(files)


def remove(
    spark: SparkSession, table: str, gone: DataFrame, on: Sequence[str], partition_by: Sequence[str] = (), schema: StructType | None = None,
) -> int:
    """Delete the rows of a table whose key columns stand in ``gone``; returns the number of files rewritten."""
    keys = gone.select(*on).distinct()
    return change(spark, table, lambda t: t.join(keys, list(on), "left_semi"),
                  lambda t: t.join(keys, list(on), "left_anti").select(t.columns), partition_by, schema)
