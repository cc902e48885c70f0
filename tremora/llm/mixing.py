"""Mixing sources to target weights by iterative proportional fitting.

Texts are counted into cells of source, language and topic. Each marginal has target shares of the budget of tokens:
given ones, or shares in proportion to tokens ** TEMPER. A target beyond what the corpus holds is cut to all of it,
and the rest goes to the other values of that marginal (``targets_of`` shows both). The expected tokens of the cells
are then raked to each marginal in turn, never beyond a cell's own tokens, until every share is within TOLERANCE of
its target, ROUNDS times at most. All of it is sums over the cell table, in windows while it is one partition, grouped and
joined beyond that; no cell leaves Spark, and no task holds a marginal of more than CELLS_PER_PART cells. A document is kept if the uniform number of its key's digest is below its cell's probability.

Defined results: a null text has no tokens; null sources and languages are values of their own; cells without tokens
have probability 1. Rows that repeat a key share its fate. Given shares need not add up to 1; values that are not
given get none. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremora.session import cut, forget

ROUNDS = 16
TOLERANCE = 0.004
FILL_STEPS = 8
TEMPER = 0.5
BUDGET = 0.6
#: Cell tables up to this many rows are broadcast, larger ones are joined by shuffle.
BROADCAST_CELLS = 100_000
#: Cells in a partition of the tables of each round; one partition is raked without a shuffle.
CELLS_PER_PART = 50_000
DIMENSIONS = ("source", "lang", "topic")
WORD = r"[^\x20\x09-\x0D]+"


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def topic(text: Column, n: Column) -> Column:
    """The genre of a text, from its length and signs."""
    text = F.coalesce(text, F.lit(""))
    pipes = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    return F.when(pipes * 10 >= F.greatest(n, F.lit(1)), "table").when(
        F.contains(text, F.lit("@")) | F.contains(text, F.lit("http")), "contact"
    ).when(n < 100, "short").when(n < 1000, "medium").otherwise("long")


def with_cells(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the number of tokens and the topic."""
    docs = docs.withColumn("n_tokens", tokens(F.col(text)))
    return docs.withColumn("topic", topic(F.col(text), F.col("n_tokens")))


def targets_of(
    cells: DataFrame,
    budget: float = BUDGET,
    shares: Mapping[str, DataFrame] | None = None,
    dimensions: tuple[str, ...] = DIMENSIONS,
    temper: float = TEMPER
) -> DataFrame:
    """(dim, v, wanted, t): the tokens that each value of each marginal should have, and those that it can have.
    ``shares`` may give (value, share) for any dimension.
    """
    own = []
    for d in dimensions:
        held = cells.groupBy(F.col(d).cast("string").alias("v")).agg(F.sum("n").cast("double").alias("m"))
        if given := (shares or {}).get(d):
            asked = given.select(
                F.col(given.columns[0]).cast("string").alias("__v"), F.col(given.columns[1]).cast("double").alias("s")
            )
            held = held.join(
                asked, F.col("v").eqNullSafe(F.col("__v")), "left"
            ).select("v", "m", F.coalesce("s", F.lit(0.0)).alias("s"))
        else:
            held = held.withColumn("s", F.pow("m", F.lit(temper)))
        own.append(held.select(F.lit(d).alias("dim"), "v", "m", "s"))
    table = own[0]
    for held in own[1:]:
        table = table.union(held)
    table = cut(table, "marginals")
    parts = table.count() // CELLS_PER_PART + 1
    # of each marginal: the budget, and the rate at which shares become tokens, raised as values reach all that they
    # have
    table = _with_sums(table, F.col("dim"), parts, b=F.col("m"), __s=F.col("s")).withColumn("b", budget * F.col("b"))
    table = table.withColumn("first", F.col("b") / F.nullif("__s", F.lit(0.0))).withColumn("rate", F.col("first"))
    table = table.drop("__s")
    if parts > 1:
        table = cut(table, "filled")
    for _ in range(FILL_STEPS):
        before = table
        full = F.col("s") * F.col("rate") >= F.col("m")
        table = _with_sums(
            table, F.col("dim"), parts, __m=F.when(full, F.col("m")).otherwise(0.0), __s=F.when(full, 0.0).otherwise(F.col("s"))
        ).withColumn(
            "rate", F.coalesce((F.col("b") - F.col("__m")) / F.nullif("__s", F.lit(0.0)), F.col("rate"))
        ).drop("__m", "__s")
        if parts > 1:
            table = cut(table, "filled")
            forget(before)
    return table.select(
        "dim",
        "v",
        (F.col("s") * F.col("first")).alias("wanted"),
        F.least(F.col("m"), F.col("s") * F.col("rate")).alias("t")
    )


def _with_sums(rows: DataFrame, key: Column, parts: int, **sums: Column) -> DataFrame:
    """Add sums over the rows of a key. What is one partition is summed in windows, without a shuffle or a join; of more
    rows only sums meet, which are joined, and no task holds a key; such rows are read twice and should lie in a table.
    """
    if parts == 1:
        by = Window.partitionBy(key)
        return rows.coalesce(1).withColumns({name: F.sum(x).over(by) for name, x in sums.items()})
    held = rows.groupBy(key.alias("__k")).agg(*(F.sum(x).alias(name) for name, x in sums.items()))
    return rows.join(held, key.eqNullSafe(F.col("__k"))).drop("__k")


def _aimed(raked: DataFrame, targets: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """Add each cell's targets, one for each marginal."""
    for d in dimensions:
        own = targets.where(F.col("dim") == d).select(F.col("v").alias("__v"), F.col("t").alias(f"__t_{d}"))
        raked = raked.join(own, F.col(d).cast("string").eqNullSafe(F.col("__v"))).drop("__v")
    return raked


def _moved(aimed: DataFrame, dim: str, parts: int) -> DataFrame:
    """Rake to one marginal; no cell gets more than it has."""
    summed = _with_sums(aimed, F.col(dim).cast("string"), parts, __sum=F.col("e"))
    share = F.col(f"__t_{dim}") / F.nullif("__sum", F.lit(0.0))
    return summed.withColumn(
        "e", F.least(F.col("n").cast("double"), F.coalesce(F.col("e") * share, F.lit(0.0)))
    ).drop("__sum")


def _distance(aimed: DataFrame, dimensions: tuple[str, ...]) -> float:
    sides = F.explode(
        F.array(
            *(
                F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("v"), F.col(f"__t_{d}").alias("t"))
                for d in dimensions
            )
        )
    ).alias("side")
    sums = aimed.select(sides, "e").groupBy("side").agg(F.sum("e").alias("__sum")).select("side.*", "__sum")
    most = sums.groupBy("dim").agg(F.max(F.abs(F.col("__sum") - F.col("t"))).alias("x"), F.sum("t").alias("b"))
    return most.agg(F.max(F.col("x") / F.nullif("b", F.lit(0.0)))).first()[0] or 0.0


def residual(raked: DataFrame, targets: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> float:
    """The largest distance of a share from its target."""
    return _distance(_aimed(raked, targets, dimensions), dimensions)


def rake(
    cells: DataFrame,
    budget: float = BUDGET,
    shares: Mapping[str, DataFrame] | None = None,
    dimensions: tuple[str, ...] = DIMENSIONS,
    rounds: int = ROUNDS,
    tolerance: float = TOLERANCE,
    temper: float = TEMPER
) -> DataFrame:
    """Add ``e``, the expected tokens of each cell in the sample. ``shares`` may give (value, share) for any of the
    dimensions.
    """
    targets = cut(targets_of(cells, budget, shares, dimensions, temper), "targets")
    parts = cells.count() // CELLS_PER_PART + 1
    raked = _aimed(cells.withColumn("e", F.col("n") * F.lit(float(budget))), targets, dimensions)
    raked = kept = cut(raked.coalesce(parts), "raked").coalesce(parts)
    for _ in range(rounds):
        for d in dimensions:
            raked = _moved(raked, d, parts)
            if parts > 1 or d == dimensions[-1]:
                raked = cut(raked.coalesce(parts), "raked").coalesce(parts)
                forget(kept)
                kept = raked
        if _distance(raked, dimensions) < tolerance:
            break
    return raked.drop(*(f"__t_{d}" for d in dimensions))


def calibrate(raked: DataFrame) -> DataFrame:
    """Add ``p``: the probability of a document of each cell."""
    return raked.withColumn(
        "p", F.round(F.least(F.lit(1.0), F.coalesce(F.col("e") / F.nullif("n", F.lit(0)), F.lit(1.0))), 6)
    )


def uniform(key: Column) -> Column:
    """A number in [0, 1) from the digest of a key."""
    return F.conv(
        F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10
    ).cast("double") / F.lit(float(1 << 32))


def probabilities(
    counted: DataFrame, budget: float = BUDGET, shares: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """(source, lang, topic, p) from rows with n_tokens."""
    cells = cut(counted.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("n")), "cells")
    return calibrate(rake(cells, budget, shares)).select(*DIMENSIONS, "p")


def with_probability(counted: DataFrame, mix: DataFrame) -> DataFrame:
    if mix.count() <= BROADCAST_CELLS:
        mix = F.broadcast(mix)
    mix = mix.select(*(F.col(d).alias(f"__{d}") for d in DIMENSIONS), F.col("p").alias("__p"))
    same = [F.col(d).eqNullSafe(F.col(f"__{d}")) for d in DIMENSIONS]
    return counted.join(mix, same[0] & same[1] & same[2]).drop(*(f"__{d}" for d in DIMENSIONS))


def sample_documents(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    budget: float = BUDGET,
    shares: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """The sampled rows, with the columns of the input (columns ``topic`` and ``n_tokens`` are kept as they are)."""
    own = docs.select("source", "lang", text)
    mix = probabilities(cut(with_cells(own, text).drop(text), "counted"), budget, shares)
    n = tokens(F.col(text))
    counted = docs.select(
        F.struct(*docs.columns).alias("__row"), F.col("source"), F.col("lang"), topic(F.col(text), n).alias("topic")
    )
    return with_probability(counted, mix).where(uniform(F.col("__row")[key]) < F.col("__p")).select("__row.*")


def op2_source_mixing(spark, sf_dir):
    """Probability and fate of every document."""
    from tremora.session import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    counted = cut(with_cells(docs).drop("text"), "counted")
    out = with_probability(counted, probabilities(counted))
    return out.select(
        "doc_id",
        "source",
        "lang",
        "topic",
        "n_tokens",
        F.col("__p").alias("probability"),
        (uniform(F.col("doc_id")) < F.col("__p")).alias("kept")
    )


def _sql() -> str:
    """The same computation with every round written out."""
    parts = [
        r"""d AS (SELECT doc_id, source, lang, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents)""",
        """c AS (SELECT *, CASE WHEN (length(coalesce(text, '')) - length(replace(coalesce(text, ''), '|', ''))) * 10 >= greatest(n_tokens, 1) THEN 'table'
  WHEN contains(coalesce(text, ''), '@') OR contains(coalesce(text, ''), 'http') THEN 'contact' WHEN n_tokens < 100 THEN 'short' WHEN n_tokens < 1000 THEN 'medium' ELSE 'long' END AS topic FROM d)""",
        "cells AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS n FROM c GROUP BY ALL)",
    ]
    parts.append(f"b AS (SELECT {BUDGET} * coalesce(sum(n), 0) AS b FROM cells)")
    for i, dim in enumerate(DIMENSIONS):
        parts.append(
            f"h{i} AS MATERIALIZED (SELECT {dim} AS v, sum(n) AS m, pow(sum(n), {TEMPER}) AS s FROM cells GROUP BY {dim})"
        )
        parts.append(f"f{i}_0 AS MATERIALIZED (SELECT any_value(b) / sum(s) AS rate FROM h{i}, b)")
        for k in range(FILL_STEPS):
            parts.append(
                f"f{i}_{k + 1} AS MATERIALIZED (SELECT coalesce((any_value(b) - sum(CASE WHEN s * rate >= m THEN m ELSE 0 END)) / nullif(sum(CASE WHEN s * rate >= m THEN 0 ELSE s END), 0), any_value(rate)) AS rate FROM h{i}, f{i}_{k}, b)"
            )
        parts.append(f"t{i} AS MATERIALIZED (SELECT v, least(m, s * rate) AS t FROM h{i}, f{i}_{FILL_STEPS})")
    targets = ", ".join(
        f"(SELECT t FROM t{i} WHERE v IS NOT DISTINCT FROM {dim}) AS t{i}" for i, dim in enumerate(DIMENSIONS)
    )
    parts.append(f"w0 AS (SELECT *, n * {BUDGET} AS e, {targets} FROM cells)")
    step, rounds = 0, []
    for r in range(ROUNDS):
        for i, dim in enumerate(DIMENSIONS):
            parts.append(
                f"w{step + 1} AS MATERIALIZED (SELECT * REPLACE (least(n, coalesce(e * t{i} / nullif(sum(e) OVER (PARTITION BY {dim}), 0), 0)) AS e) FROM w{step})"
            )
            step += 1
        apart = ", ".join(
            f"(SELECT max(abs(x)) FROM (SELECT sum(e) - any_value(t{i}) AS x FROM w{step} GROUP BY {dim}))"
            for i, dim in enumerate(DIMENSIONS)
        )
        rounds.append(
            f"SELECT {r} AS r, greatest({apart}) / (SELECT b FROM b) AS x, source, lang, topic, n, e FROM w{step}"
        )
    parts.append(f"all_rounds AS MATERIALIZED ({' UNION ALL '.join(rounds)})")
    parts.append(
        f"mix AS (SELECT source, lang, topic, round(least(1.0, coalesce(e / nullif(n, 0), 1.0)), 6) AS p FROM all_rounds WHERE r = (SELECT coalesce(min(r) FILTER (WHERE x < {TOLERANCE}), {ROUNDS - 1}) FROM all_rounds))"
    )
    return "WITH " + ",\n".join(parts) + """
SELECT c.doc_id, c.source, c.lang, c.topic, c.n_tokens, p AS probability, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0 < p AS kept
FROM c JOIN mix ON c.source IS NOT DISTINCT FROM mix.source AND c.lang IS NOT DISTINCT FROM mix.lang AND c.topic IS NOT DISTINCT FROM mix.topic"""


OP2_SQL = _sql()
