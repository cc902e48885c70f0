"""Exact ranks and quantiles without a task that holds a whole group.

Mergeable quantile sketches (KLL) give bounds between which a rank must lie, or that cut a group into cells of equal
depth whatever its values look like; what lies between the bounds is counted and ranked exactly. A sketch that errs
makes a cell larger, never a result wrong.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremora.session import cut

#: Cells of equal depth that a group is cut into.
CELLS = 64
#: Size of a sketch, and how far from a rank its bounds are set: several times the sketch's error.
SKETCH, MARGIN = 1024, 0.004
#: Tables of groups up to this many rows are broadcast.
BROADCAST_GROUPS = 10_000


def _sketches(rows: DataFrame, by: list[str], value: Column, window: Column | None = None) -> DataFrame:
    """A sketch of each group; with ``window`` one is made for each window first, and these are merged."""
    known = rows.where(~F.isnan(value))
    made = known.groupBy(*by, *([] if window is None else [window.alias("__w")])).agg(
        F.kll_sketch_agg_double(value, F.lit(SKETCH)).alias("__s")
    )
    if window is None:
        return made
    return made.groupBy(*by).agg(F.kll_merge_agg_double("__s", F.lit(SKETCH)).alias("__s"))


def settled(groups: DataFrame) -> DataFrame:
    """A table of groups, computed once. Up to BROADCAST_GROUPS rows are broadcast from the driver, where a broadcast
    comes from anyway; larger tables are written.
    """
    rows = groups.limit(BROADCAST_GROUPS + 1).collect()
    if len(rows) > BROADCAST_GROUPS:
        return cut(groups, "groups")
    return F.broadcast(groups.sparkSession.createDataFrame(rows, groups.schema))


def with_group(rows: DataFrame, groups: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Rows with what is known of their group; null keys are keys."""
    renamed = groups.withColumnsRenamed({c: f"__by_{c}" for c in by})
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by))
    return rows.join(renamed, same, how).drop(*(f"__by_{c}" for c in by))


def _cells(levels: DataFrame, by: list[str], value: str) -> DataFrame:
    """Add ``__cell``: steps of about equal numbers of levels of a group, in order of value."""
    x = F.col(value).cast("double")
    at = F.array(*(F.lit(i / CELLS) for i in range(1, CELLS)))
    bounds = _sketches(levels, by, x).select(*by, F.kll_sketch_get_quantile_double("__s", at).alias("__b"))
    dealt = with_group(levels, settled(bounds), by, "left")
    cell = F.when(F.isnan(x), CELLS).otherwise(F.size(F.filter("__b", lambda b: b <= x)))
    return dealt.withColumn("__cell", F.coalesce(cell, F.lit(0))).drop("__b")


def running(levels: DataFrame, by: list[str], value: str, count: str) -> DataFrame:
    """Add ``__before``: the counts of the lower values of a group. ``levels`` has a row for each distinct value.

    Only the sums of cells go through one window of a group, CELLS rows; the values of a cell are ranked among
    themselves.
    """
    dealt = cut(_cells(levels, by, value), "cells")
    sums = dealt.groupBy(*by, "__cell").agg(F.sum(count).alias("__n"))
    lower = Window.partitionBy(*by).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "__cell", F.coalesce(F.sum("__n").over(lower), F.lit(0)).alias("__base"))
    within = Window.partitionBy(*by, "__cell").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(sums, [*by, "__cell"]).withColumn(
        "__before", F.col("__base") + F.coalesce(F.sum(count).over(within), F.lit(0))
    ).drop("__cell", "__base")


def quantiles(
    rows: DataFrame, by: list[str], value: str, wanted: dict[str, float], window: Column | None = None
) -> DataFrame:
    """(*by, names of ``wanted``): exact quantiles of each group, interpolated between neighbours; nulls don't count,
    NaN is above all numbers.

    Three passes: sketches, counts of what lies below, between and above the bounds of each quantile, and the ranking
    of the part that holds it, under a hundredth of a group.
    """
    x = F.col("__v")
    rows = rows.where(F.col(value).isNotNull()).select(
        *by, F.col(value).cast("double").alias("__v"), *([] if window is None else [window.alias("__window")])
    )
    names, share = list(wanted), list(wanted.values())
    ends = F.array(*(F.lit(min(max(q + d, 0.0), 1.0)) for q in share for d in (-MARGIN, MARGIN)))
    sketches = _sketches(rows, by, x, None if window is None else F.col("__window"))
    bounds = settled(sketches.select(*by, F.kll_sketch_get_quantile_double("__s", ends).alias("__b")))
    dealt = with_group(rows.select(*by, "__v"), bounds, by, "left")
    # 0 below, 1 between, 2 above
    part = [
        F.when(x < F.col("__b")[2 * i], 0).when(x > F.col("__b")[2 * i + 1], 2).otherwise(1) for i in range(len(names))
    ]
    dealt = dealt.select(*by, "__v", *(p.alias(f"__p{i}") for i, p in enumerate(part)))
    counted = [F.count_if(F.col(f"__p{i}") == k).alias(f"__n{i}{k}") for i in range(len(names)) for k in (0, 1)]
    above = [
        F.min(F.when(F.col(f"__p{i}") > k, x)).alias(f"__m{i}{k}") for i in range(len(names)) for k in (0, 1)
    ]
    groups = dealt.groupBy(*by).agg(F.count("*").alias("__n"), *counted, *above)
    for i, q in enumerate(share):
        at = F.lit(q) * (F.col("__n") - 1)
        low, both = F.col(f"__n{i}0"), F.col(f"__n{i}0") + F.col(f"__n{i}1")
        home = F.when(F.floor(at) < low, 0).when(F.floor(at) < both, 1).otherwise(2)
        groups = groups.withColumn(f"__at{i}", at).withColumn(f"__h{i}", home).withColumn(
            f"__base{i}", F.when(home == 0, F.lit(0)).when(home == 1, low).otherwise(both)
        ).withColumn(f"__next{i}", F.when(home == 0, F.col(f"__m{i}0")).when(home == 1, F.col(f"__m{i}1")))
    groups = settled(groups)
    near = with_group(dealt, groups, by).where(
        reduce(or_, (F.col(f"__p{i}") == F.col(f"__h{i}") for i in range(len(names))))
    )
    each = F.explode(
        F.array(
            *(
                F.struct(
                    F.lit(i).alias("i"),
                    (F.col(f"__p{i}") == F.col(f"__h{i}")).alias("own"),
                    F.col(f"__at{i}").alias("at"),
                    F.col(f"__base{i}").alias("base"),
                    F.col(f"__next{i}").alias("next")
                )
                for i in range(len(names))
            )
        )
    ).alias("__q")
    ranked = near.select(*by, "__v", each).where("__q.own").withColumn(
        "__rank",
        F.col("__q.base") + F.row_number().over(Window.partitionBy(*by, "__q.i").orderBy("__v")) - 1
    )
    at = F.col("__q.at")
    found = ranked.groupBy(*by, F.col("__q.i").alias("__i")).agg(
        F.max(F.when(F.col("__rank") == F.floor(at), x)).alias("__a"),
        F.coalesce(F.max(F.when(F.col("__rank") == F.ceil(at), x)), F.max("__q.next")).alias("__b"),
        F.max(at - F.floor(at)).alias("__f")
    )
    level = F.when(F.col("__f") == 0, F.col("__a")).otherwise(
        F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("__f")
    )
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("__i") == i, level)).alias(n) for i, n in enumerate(names)))


def quantile(rows: DataFrame, by: list[str], value: str, q: float, name: str) -> DataFrame:
    """(*by, name): one exact quantile of each group."""
    return quantiles(rows, by, value, {name: q})


def numbered(rows: DataFrame, by: list[str], slots: list[Column], order: list[str], name: str) -> DataFrame:
    """Add ``name``: the place of each row among those of its group by (slots, order). Slots are coarse and in order;
    each is numbered on its own and moved by what lies before.
    """
    keys = [f"__s{i}" for i in range(len(slots))]
    dealt = rows.select("*", *(c.alias(k) for c, k in zip(slots, keys, strict=True)))
    sums = dealt.groupBy(*by, *keys).agg(F.count("*").alias("__n"))
    lower = Window.partitionBy(*by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__base", F.coalesce(F.sum("__n").over(lower), F.lit(0))).drop("__n")
    place = F.row_number().over(Window.partitionBy(*by, *keys).orderBy(*order))
    return dealt.join(sums, [*by, *keys]).withColumn(name, (F.col("__base") + place).cast("long")).drop("__base", *keys)
