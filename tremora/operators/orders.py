"""Order tracking: shaft phase from tacho pulses, samples at equal steps of the shaft, order spectra."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.functions import dsp
from tremora.operators.ranks import numbered
from tremora.operators.temporal import asof, beside
from tremora.session import cut


def shaft_phase(samples: DataFrame, pulses: DataFrame, by: list[str], at: str, width: int) -> DataFrame:
    """Samples between two pulses, with ``position``: turns since the first pulse of the group.

    A sample is joined as of its time with the pulse before it, which knows the next one; the phase goes evenly from
    one to the other. Pulses at one instant are one. Time is dealt into blocks of ``width``, so a group of any length
    is spread over tasks.
    """
    block = F.floor(F.col(at) / width)
    turns = numbered(pulses.select(*by, at).distinct(), by, [block], [at], "turn")
    turns = beside(turns, by, block, [at], [at], "next", ahead=True).select(
        *by, at, "turn", F.col(f"next.{at}").alias("until")
    )
    turns = cut(turns, "turns")  # read several times below
    matched = asof(samples, turns, by, at, ["turn", "until"], width=width)
    share = (F.col(at) - F.col(f"{at}_matched")) / (F.col("until") - F.col(f"{at}_matched"))
    return matched.where("until is not null").withColumn(
        "position", F.col("turn") - 1 + share
    ).drop("turn", "until", f"{at}_matched")


def even_steps(
    phased: DataFrame, by: list[str], order: list[str], value: str, points: int, turns: int = 64
) -> DataFrame:
    """(*by, step, value): values at each 1/``points`` of a turn, interpolated between the samples around it; a step
    needs a sample before it.
    """
    block = F.floor(F.col("position") / turns)
    phased = cut(phased, "phased")
    pairs = beside(phased, by, block, ["position", *order], ["position", value], "before").where("before is not null")
    p, p0, v, v0 = F.col("position"), F.col("before.position"), F.col(value), F.col(f"before.{value}")
    first, last = (F.floor(x * points).cast("long") for x in (p0, p))
    steps = pairs.where(last > first).withColumn("step", F.explode(F.sequence(first + 1, last)))
    share = (F.col("step") / points - p0) / (p - p0)
    return steps.select(*by, "step", (v0 + (v - v0) * share).alias(value))


def order_spectra(even: DataFrame, by: list[str], value: str, points: int, turns: int) -> DataFrame:
    """(*by, block, spectrum): the spectrum of each whole stretch of ``turns`` turns; order k is its bin k * turns."""
    size = points * turns
    block = F.floor(F.col("step") / size).cast("long")
    rows = even.groupBy(*by, block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("step", value))).alias("x"))
    whole = rows.where(F.size("x") == size)
    return whole.select(*by, "block", dsp.rfft(F.transform("x", lambda s: s[value])).alias("spectrum"))
