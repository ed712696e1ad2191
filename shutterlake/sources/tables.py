"""Parquet tables of a scale-factor folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` under ``sf_dir``, by Spark's own reader so that any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
