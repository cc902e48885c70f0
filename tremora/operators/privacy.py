"""Means of sites that don't tell what a site holds."""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def laplace(scale: float) -> Column:
    """A draw of Laplace noise for each row: the difference of two exponential ones, from seeds that nobody knows."""
    one, other = (F.ln(1 - F.rand(secrets.randbits(63))) for _ in range(2))
    return scale * (other - one)


def private_mean(sites: DataFrame, mean: str, weight: str, low: float, high: float, scale: float) -> DataFrame:
    """One row: the weighted mean of clipped and blurred means. A site's own mean is blurred before it is added."""
    clipped = F.least(F.greatest(mean, F.lit(low)), F.lit(high))
    blurred = sites.select((clipped + laplace(scale)).alias("m"), F.col(weight).alias("w"))
    return blurred.agg((F.sum(F.col("m") * F.col("w")) / F.sum("w")).alias("mean"))
