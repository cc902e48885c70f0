"""Electrical quantities from phase values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unbalance(*phases: Column) -> Column:
    """Largest deviation from the mean of the phases, in percent of it."""
    mean = sum(phases[1:], phases[0]) / len(phases)
    return 100 * F.greatest(*(F.abs(p - mean) for p in phases)) / F.nullif(mean, F.lit(0.0))


def power_triangle(v: Column, i: Column) -> dict[str, Column]:
    """Aggregates over the samples of one phase: active, apparent and reactive power, power factor."""
    active = F.avg(v * i)
    apparent = F.sqrt(F.avg(v * v)) * F.sqrt(F.avg(i * i))
    return {
        "active": active,
        "apparent": apparent,
        "reactive": F.sqrt(F.greatest(apparent * apparent - active * active, F.lit(0.0))),
        "power_factor": active / F.nullif(apparent, F.lit(0.0))
    }


def park(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """Direct and quadrature currents of three phases."""
    return F.lit((2 / 3) ** 0.5) * a - (b + c) / F.lit(6**0.5), (b - c) / F.lit(2**0.5)
