"""Evaluate expensive columns exactly once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns through a one-row generator.

    A plain projection is merged into every filter and projection that reads it, so a regular
    expression or a hash tree would be compiled and run once per reference. Neither filters
    nor projections move through a generator's output.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))
