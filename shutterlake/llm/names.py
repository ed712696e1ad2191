"""Columns beside those of a caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with as many underscores after it as make it a column that ``df`` doesn't have in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own_columns(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever marks their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
