"""Joins in time and range, written as unions, windows and equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    on: str,
    values: list[str],
    tolerance: Column | None = None,
    width: int | None = None
) -> DataFrame:
    """Each left row with the latest right row at or before it: one union and one sort, no expansion.

    ``values`` are taken from the right; with ``tolerance`` (in the unit of ``on``) older matches are null. With
    ``width``, time is dealt into blocks of it that are sorted on their own, each with the last right row before it, so
    no task holds all of a group.
    """
    carried = F.struct(F.col(on).alias("__at"), *values)
    keys = by if width is None else [*by, "__block"]
    block = [] if width is None else [F.floor(F.col(on) / width).alias("__block")]
    union = left.select("*", *block).withColumn("__side", F.lit(1)).withColumn(
        "__row", F.lit(None).cast(right.select(carried.alias("x")).schema["x"].dataType)
    )
    other = right.select(*by, on, *block, F.lit(0).alias("__side"), carried.alias("__row"))
    if width is not None:
        last = other.groupBy(*keys).agg(F.max_by("__row", on).alias("__row"))
        spine = last.unionByName(left.select(*by, *block).distinct(), allowMissingColumns=True).groupBy(*keys).agg(
            F.first("__row", ignorenulls=True).alias("__own")
        )
        earlier = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
        spine = spine.withColumn("__row", F.last("__own", ignorenulls=True).over(earlier)).where("__row is not null")
        start = (F.col("__block") * width).cast(left.schema[on].dataType)
        other = other.unionByName(
            spine.select(*by, start.alias(on), "__block", F.lit(-1).alias("__side"), "__row")
        )
    w = Window.partitionBy(*keys).orderBy(on, "__side").rowsBetween(Window.unboundedPreceding, 0)
    joined = union.unionByName(other, allowMissingColumns=True).withColumn(
        "__row", F.last("__row", ignorenulls=True).over(w)
    ).where("__side = 1")
    fresh = F.lit(True) if tolerance is None else F.col(on) - F.col("__row.__at") <= tolerance
    return joined.select(
        *left.columns,
        *(F.when(fresh, F.col(f"__row.{v}")).alias(v) for v in values),
        F.when(fresh, F.col("__row.__at")).alias(f"{on}_matched")
    )


def beside(
    rows: DataFrame, by: list[str], block: Column, order: list[str], values: list[str], name: str, ahead: bool = False
) -> DataFrame:
    """Add ``name``: a struct of ``values`` of the row before (or ahead) in a group by ``order``. Blocks, which follow
    the order, are sorted on their own; their edges are matched through one row a block.
    """
    keys = [*by, "__block"]
    dealt = rows.withColumn("__block", block)
    own = F.struct(*values)
    within = Window.partitionBy(*keys).orderBy(*order)
    edges = dealt.groupBy(*keys).agg((F.min_by if ahead else F.max_by)(own, F.struct(*order)).alias("__edge"))
    across = Window.partitionBy(*by).orderBy("__block")
    step = F.lead if ahead else F.lag
    edges = edges.select(*keys, step("__edge").over(across).alias("__edge"))
    return dealt.withColumn("__near", step(own).over(within)).join(edges, keys, "left").withColumn(
        name, F.coalesce("__near", "__edge")
    ).drop("__near", "__edge", "__block")


def interval(left: DataFrame, right: DataFrame, by: str, left_us: str, right_us: str, width_us: int) -> DataFrame:
    """Pairs of one key within ``width_us`` of each other: the left falls in a bucket, the right in it and its
    neighbours.
    """
    bucket = F.floor(F.col(left_us) / width_us)
    near = F.explode(F.array(*(F.floor(F.col(right_us) / width_us) + k for k in (-1, 0, 1))))
    pairs = left.withColumn("__b", bucket).join(right.withColumn("__b", near), [by, "__b"])
    return pairs.where(F.abs(F.col(left_us) - F.col(right_us)) <= width_us).drop("__b")


def range_to_bin(points: DataFrame, bins: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Points within [low, high): ranges are cut into cells of ``width`` and joined on the cell."""
    cells = bins.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return points.withColumn("__cell", F.floor(F.col(at) / width)).join(cells, "__cell").where(
        (F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))
    ).drop("__cell")


def trailing(
    rows: DataFrame,
    by: list[str],
    key: str,
    at: str,
    value: str,
    widths: dict[str, int],
    current: bool,
    carry: list[str] = []  # noqa: B006
) -> DataFrame:
    """(*by, key, *carry, and n_w, mean_w, m2_w of each width w): count, mean and sum of squared deviations of the
    values in the ``width`` before each row; with ``current`` the row and its peers count too.

    Time is dealt into blocks of the width. A window is the end of one block and the beginning of the next, so it is
    put together from a sum that runs up and one that runs down, and nothing is ever subtracted: values of any size
    keep their digits. Sums are about a value of the block. A row costs the same whatever a window holds, and no task
    holds more than a block of a group.
    """
    span = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(w).alias("width")) for n, w in widths.items())))
    own = rows.select(*by, key, *carry, F.col(at).alias("__at"), F.col(value).cast("double").alias("__x"), span.alias("__w"))
    own = own.withColumn("__block", F.floor(F.col("__at") / F.col("__w.width")))
    keys = [*by, "__w", "__block"]
    up = Window.partitionBy(*keys).orderBy("__at")
    so_far = up.rangeBetween(Window.unboundedPreceding, 0 if current else -1)
    own = own.withColumn("__ref", F.first("__x", ignorenulls=True).over(up)).withColumn("__d", F.col("__x") - F.col("__ref"))
    d, ref = F.col("__d"), F.col("__ref")
    own = own.withColumn(
        "__p", F.struct(F.count(d).over(so_far).alias("n"), F.sum(d).over(so_far).alias("s"), F.sum(d * d).over(so_far).alias("q"))
    )
    earlier = (F.col("__at") - F.col("__w.width")).alias("__at")
    asking = own.select(
        *by, key, *carry, "__w", (F.col("__block") - 1).alias("__block"), earlier, F.lit(None).cast("double").alias("__d"),
        ref.alias("__own"), F.lit(None).cast("double").alias("__ref"), "__p", F.lit(True).alias("__asks"),
    )
    down = Window.partitionBy(*keys).orderBy(F.col("__at").desc()).rangeBetween(Window.unboundedPreceding, 0)
    both = asking.unionByName(own.select(*keys, "__at", "__d", "__ref"), allowMissingColumns=True)
    both = both.select(
        *by, key, *carry, "__w", "__p", "__own", "__asks",
        F.count(d).over(down).alias("__n"), F.sum(d).over(down).alias("__s"), F.sum(d * d).over(down).alias("__q"),
        F.max("__ref").over(down).alias("__other"),
    ).where("__asks")
    n1, n2 = F.col("__p.n"), F.col("__n")
    off1, off2 = F.col("__p.s") / F.nullif(n1, F.lit(0)), F.col("__s") / F.nullif(n2, F.lit(0))
    mean1, mean2 = F.col("__own") + off1, F.col("__other") + off2
    step = F.col("__other") - F.col("__own") + (off2 - off1)
    apart = lambda q, s, n: F.coalesce(q - s * s / F.nullif(n, F.lit(0)), F.lit(0.0))
    across = F.coalesce(F.pow(step, F.lit(2.0)) * n1 * n2 / F.nullif(n1 + n2, F.lit(0)), F.lit(0.0))
    found = both.select(
        *by, key, *carry, F.col("__w.name").alias("__name"), (n1 + n2).alias("n"),
        F.coalesce(mean1 + step * n2 / F.nullif(n1 + n2, F.lit(0)), mean1, mean2).alias("mean"),
        F.greatest(apart(F.col("__p.q"), F.col("__p.s"), n1) + apart(F.col("__q"), F.col("__s"), n2) + across, F.lit(0.0)).alias("m2"),
    )
    if len(widths) == 1:
        name = next(iter(widths))
        return found.select(*by, key, *carry, *(F.col(c).alias(f"{c}_{name}") for c in ("n", "mean", "m2")))
    return found.groupBy(*by, key, *carry).agg(
        *(F.max(F.when(F.col("__name") == w, F.col(c))).alias(f"{c}_{w}") for w in widths for c in ("n", "mean", "m2"))
    )
