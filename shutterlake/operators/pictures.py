"""Pairs of pictures verified by their structure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.pixels import ssim


def structural_pairs(pairs: DataFrame, pictures: DataFrame, least: float = 0.0) -> DataFrame:
    """``pairs(a, b)`` with ``ssim``, the structural similarity of their ``pictures(id, grid)``, where it is at least ``least``. Pairs with a picture that has no grid are left out.

    Grids move once for each pair that names them, so pairs should be candidates already; a picture in very many pairs is split by adaptive execution.
    """
    side = lambda x: pictures.select(F.col("id").alias(x), F.col("grid").alias(f"_{x}"))
    met = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return met.select("a", "b", ssim(F.col("_a"), F.col("_b")).alias("ssim")).filter(F.col("ssim") >= least)
