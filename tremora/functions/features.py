"""Window features of a measured value, directly or from mergeable moments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACES = 6


def tidy(x: Column, places: int = PLACES, nudge: float = 0.0) -> Column:
    """Rounded, without negative zero, so that results compare across engines; a nudge decides ties alike."""
    return F.round(x + F.lit(nudge) if nudge else x, places) + F.lit(0.0)


def rms(x: Column) -> Column:
    return F.sqrt(F.avg(x * x))


def peak(x: Column) -> Column:
    return F.max(F.abs(x))


def features(x: Column) -> list[Column]:
    """Aggregates of a window: sample standard deviation, population excess kurtosis, crest factor null at rest."""
    return [
        F.count(x).alias("n"),
        tidy(rms(x)).alias("rms"),
        tidy(peak(x)).alias("peak"),
        tidy(F.avg(x)).alias("mean"),
        tidy(F.stddev_samp(x)).alias("std"),
        tidy(F.kurtosis(x)).alias("kurtosis"),
        tidy(peak(x) / F.nullif(rms(x), F.lit(0.0))).alias("crest"),
    ]


def moments(x: Column, centre: float = 0.0) -> list[Column]:
    """What a window must keep so that wider windows can be built from it. A centre near the mean keeps precision."""
    d = x - F.lit(centre)
    return [
        F.count(x).alias("n"),
        *(F.sum(F.pow(d, F.lit(float(k)))).alias(f"s{k}") for k in range(1, 5)),
        F.max(F.abs(x)).alias("top"),
        F.sum(x * x).alias("square")
    ]


def merged() -> list[Column]:
    """Moments of wider windows."""
    return [
        *(F.sum(c).alias(c) for c in ("n", "s1", "s2", "s3", "s4")),
        F.max("top").alias("top"),
        F.sum("square").alias("square")
    ]


def finished(centre: float = 0.0) -> list[Column]:
    """Features from moments."""
    n = F.col("n").cast("double")
    m = F.col("s1") / n
    m2 = F.col("s2") / n - m * m
    m4 = F.col("s4") / n - 4 * m * F.col("s3") / n + 6 * m * m * F.col("s2") / n - 3 * F.pow(m, F.lit(4.0))
    level = F.sqrt(F.col("square") / n)
    return [
        F.col("n"),
        tidy(level, nudge=1e-9).alias("rms"),
        tidy(F.col("top"), nudge=1e-9).alias("peak"),
        tidy(m + F.lit(centre), nudge=1e-9).alias("mean"),
        tidy(F.when(F.col("n") > 1, F.sqrt(m2 * n / (n - 1))), nudge=1e-9).alias("std"),
        tidy(F.when((F.col("n") > 1) & (m2 > 0), m4 / (m2 * m2) - 3), 4, 1e-7).alias("kurtosis"),
        tidy(F.col("top") / F.nullif(level, F.lit(0.0)), nudge=1e-9).alias("crest"),
    ]


def significant(x: Column, digits: int = 7) -> Column:
    """Rounded to so many digits from the first that isn't zero."""
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * scale) / scale)


def significant_sql(x: str, digits: int = 7) -> str:
    scale = f"pow(10.0, {digits - 1} - floor(log10(abs({x}))))"
    return f"CASE WHEN {x} = 0 THEN 0.0 ELSE round({x} * {scale}) / {scale} END"
