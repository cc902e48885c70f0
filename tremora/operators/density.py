"""Density clusters on a grid: only counts of cells are tied to each other, never points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.session import cut, forget


def density_clusters(points: DataFrame, a: str, b: str, least: int) -> DataFrame:
    """Add ``cluster`` to points with cell numbers a and b: the least cell that a chain of neighbouring dense cells
    leads to; null outside.

    A cell is dense with ``least`` points or more. Labels pass from cell to neighbouring cell, doubled in reach by
    pointer jumping, until none changes.
    """
    label = F.col(a) * 1_000_000 + F.col(b)
    cells = cut(
        points.groupBy(a, b)
            .agg(F.count("*").alias("n"))
            .where(F.col("n") >= least)
            .select(a, b, label.alias("cell"), label.alias("cluster")),
        "cells"
    )
    around = F.explode(
        F.array(*(F.struct((F.col(a) + i).alias(a), (F.col(b) + j).alias(b)) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    ).alias("near")
    while True:
        least_near = cells.select("cluster", around).select(
            f"near.{a}", f"near.{b}", "cluster"
        ).groupBy(a, b).agg(F.min("cluster").alias("m"))
        step = cells.join(least_near, [a, b]).select(
            a, b, "cell", F.least("cluster", "m").alias("cluster"), F.col("cluster").alias("before")
        )
        jump = step.select(F.col("cell").alias("to"), F.col("cluster").alias("further"))
        step = step.join(jump, F.col("cluster") == F.col("to"), "left").select(
            a, b, "cell", F.least("cluster", F.coalesce("further", "cluster")).alias("cluster"), "before"
        )
        new = cut(step, "cells")
        changed = not new.where("cluster <> before").isEmpty()
        forget(cells)
        cells = new.drop("before")
        if not changed:
            return points.join(cells.select(a, b, "cluster"), [a, b], "left")
