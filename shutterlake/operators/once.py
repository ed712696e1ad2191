"""Columns that are made once a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def made_once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that come out of a generator of one row: no later expression or filter takes their definitions in and makes them anew each time it names them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
