"""Wavelet packets, scalograms and kurtograms of waveforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremora.functions import filterbanks as fb
from tremora.functions.features import tidy
from tremora.plans.registry import query
from tremora.plans.signal import _WAVES
from tremora.session import table

DEPTH, MOMENTS = 4, 2
SCALES = [2.0, 4.0, 6.0, 8.0]


def _waves(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def _list(values) -> str:
    return "[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in values) + "]"


def _packets_sql() -> str:
    """The tree level by level: both filters on every node, the children of odd nodes the other way round."""
    low, high = fb.filter_pair(MOMENTS)
    dot = "list_transform(range(0, len(x) // 2), lambda k: list_sum(list_transform(h, lambda v, j: v * x[(2 * k + j - 1) % len(x) + 1])))"
    levels = ["l0 AS (SELECT vec_id, 0 AS node, x FROM x)"]
    for i in range(1, DEPTH + 1):
        levels.append(
            f"l{i} AS (SELECT vec_id, 2 * node + CASE WHEN node % 2 = 0 THEN side ELSE 1 - side END AS node, {dot} AS x FROM l{i - 1}, f)"
        )
    every = " UNION ALL ".join(f"SELECT {i} AS level, * FROM l{i}" for i in range(1, DEPTH + 1))
    return f"""WITH {_WAVES}, f AS (SELECT * FROM (VALUES (0, {_list(low)}), (1, {_list(high)})) t(side, h)), {", ".join(levels)}, e AS ({every})
SELECT vec_id, CAST(level AS INTEGER) AS level, CAST(node AS INTEGER) AS node, round(list_sum(list_transform(x, lambda v: v * v)), 6) + 0.0 AS energy FROM e"""


def _level_and_node(at):
    """Level and node of a number that goes through the levels one after the other."""
    level = F.floor(F.log2((at + 2).cast("double"))).cast("int")
    return level.alias("level"), (at + 2 - F.pow(F.lit(2.0), level)).cast("int").alias("node")


@query("wavelet_packets", _packets_sql())
def wavelet_packets(spark, sf_dir):
    """Energies of all nodes of a wavelet packet tree to depth 4, by frequency within a level."""
    rows = _waves(spark, sf_dir).select(
        "vec_id", F.posexplode(fb.packet_energies(DEPTH, MOMENTS)("embedding")).alias("at", "e")
    )
    return rows.select("vec_id", *_level_and_node(F.col("at")), tidy(F.col("e")).alias("energy"))


@query("wavelet_best_basis")
def wavelet_best_basis(spark, sf_dir):
    """The nodes of each waveform's packet tree whose coefficients have the least entropy together."""
    found = _waves(spark, sf_dir).select("vec_id", F.explode(fb.best_basis(DEPTH, MOMENTS)("embedding")).alias("at"))
    return found.select("vec_id", *_level_and_node(F.col("at")))


def _part(f: str) -> str:
    at = "((i - 1 - b + len(x) + len(x) // 2) % len(x) - len(x) // 2)"
    return f"list_sum(list_transform(x, lambda v, i: v * exp(-0.5 * pow({at} / s, 2)) * {f}({fb.MORLET} * {at} / s)))"


@query(
    "wavelet_scalogram",
    f"""WITH {_WAVES}, s AS (SELECT vec_id, x, unnest({_list(SCALES)}) AS s FROM x), b AS (SELECT vec_id, s, x, unnest(range(0, len(x))) AS b FROM s),
c AS (SELECT vec_id, s, (pow({_part("cos")}, 2) + pow({_part("sin")}, 2)) / s AS p FROM b)
SELECT vec_id, s AS scale, round(sum(p), 6) + 0.0 AS energy, round(sqrt(max(p)), 6) + 0.0 AS peak FROM c GROUP BY ALL""",
)
def wavelet_scalogram(spark, sf_dir):
    """Energy and largest coefficient of the Morlet transform at each scale."""
    s = fb.scalogram(SCALES)("embedding")
    rows = _waves(spark, sf_dir).select("vec_id", s.alias("s")).where("s is not null")
    scales = F.array(
        *(
            F.struct(
                F.lit(v).alias("scale"),
                tidy(F.col("s")[2 * i]).alias("energy"),
                tidy(F.col("s")[2 * i + 1]).alias("peak")
            )
            for i, v in enumerate(SCALES)
        )
    )
    return rows.select("vec_id", F.inline(scales))


TREE = 3


def _kurtogram_sql() -> str:
    """The tree for waveforms of 64 samples, with real and imaginary parts as two lists."""
    half = fb.TAPS // 2 - 1
    parts, filters = [], []
    for ways in (2, 3):
        for k, taps in enumerate(fb.split_filters(ways)):
            filters.append(f"({ways}, {k}, {_list(taps.real)}, {_list(taps.imag)})")
    at = f"(ways * k + j - {half})"

    def conv(a: str, b: str, sign: str) -> str:
        inside = f"CASE WHEN {at} BETWEEN 1 AND len(a) THEN {a}[j] * a[{at}] {sign} {b}[j] * b[{at}] ELSE 0 END"
        turned = "CASE WHEN side % 2 = 1 AND k % 2 = 1 THEN -1 ELSE 1 END"
        return f"list_transform(range(0, len(a) // ways), lambda k: {turned} * list_sum(list_transform(range(1, {fb.TAPS + 1}), lambda j: {inside})))"

    def level(name: str, ways: int, shown: str) -> None:
        parts.append(
            f"{name} AS (SELECT vec_id, {shown} AS level, {ways} * band + side AS band, {conv('re', 'im', '-')} AS a, {conv('im', 're', '+')} AS b FROM {above}, f WHERE ways = {ways})"
        )

    names, above = ["n0"], "n0"
    for i in range(1, TREE + 1):
        if (64 >> (i - 1)) // 3 >= fb.LEAST_SAMPLES:
            level(f"t{i}", 3, f"{i}.6")
            names.append(f"t{i}")
        level(f"n{i}", 2, f"{i}.0")
        names.append(f"n{i}")
        above = f"n{i}"
    power = "list_transform(a, lambda v, i: v * v + b[i] * b[i])"
    nodes = " UNION ALL ".join(f"SELECT vec_id, level, band, {power} AS p FROM {n}" for n in names)
    return f"""WITH {_WAVES}, f AS (SELECT * FROM (VALUES {", ".join(filters)}) t(ways, side, re, im)),
n0 AS (SELECT vec_id, 0.0 AS level, 0 AS band, list_transform(x, lambda v: v - list_avg(x)) AS a, list_transform(x, lambda v: 0.0::DOUBLE) AS b FROM x), {", ".join(parts)}, n AS ({nodes}),
k AS (SELECT vec_id, CAST(level AS DOUBLE) AS level, CAST(band AS INTEGER) AS band, round(list_avg(list_transform(p, lambda v: v * v)) / pow(list_avg(p), 2) - CASE WHEN level = 0 THEN 3 ELSE 2 END, 5) + 0.0 AS kurtosis FROM n)
SELECT * FROM k"""


_KURTOGRAM_SQL = _kurtogram_sql()


def _kurtogram(spark, sf_dir):
    rows = _waves(spark, sf_dir).select("vec_id", F.inline(fb.kurtogram(TREE)("embedding")))
    return rows.select("vec_id", "level", "band", tidy(F.col("kurtosis"), 5).alias("kurtosis"))


@query("kurtogram", _KURTOGRAM_SQL)
def kurtogram(spark, sf_dir):
    """Kurtosis of the envelope in every band of a tree cut in two and in three."""
    return _kurtogram(spark, sf_dir)


@query(
    "kurtogram_band",
    f"SELECT vec_id, level, band, kurtosis FROM ({_KURTOGRAM_SQL}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY kurtosis DESC, level, band) = 1"
)
def kurtogram_band(spark, sf_dir):
    """The band of largest kurtosis, for an envelope to be taken in: chosen within the row, nothing is shuffled."""
    nodes = F.transform(
        fb.kurtogram(TREE)("embedding"),
        lambda s: F.struct((-F.round(s["kurtosis"], 5)).alias("k"), s["level"].alias("level"), s["band"].alias("band"))
    )
    best = _waves(spark, sf_dir).select("vec_id", F.array_min(nodes).alias("s")).where("s is not null")
    return best.select("vec_id", "s.level", "s.band", (-F.col("s.k") + 0.0).alias("kurtosis"))
