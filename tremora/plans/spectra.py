"""Spectra over frames and time, peaks, bands, acoustic emission and electrical lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremora.functions import dsp
from tremora.functions.features import tidy
from tremora.operators.density import density_clusters
from tremora.operators.temporal import range_to_bin
from tremora.plans.registry import query
from tremora.plans.signal import _LIST, _WAVES, _amplitude, _power
from tremora.session import table

FRAME = 16


def _embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def _frames(spark, sf_dir):
    """(vec_id, frame, y): frames of FRAME samples; a rest at the end is left out."""
    numbers = F.sequence(F.lit(0), F.floor(F.size("embedding") / FRAME).cast("int") - 1)
    frames = F.transform(numbers, lambda i: F.slice("embedding", i * FRAME + 1, FRAME))
    return _embeddings(spark, sf_dir).select("vec_id", "label", F.posexplode(frames).alias("frame", "y"))


_FRAMES = f"{_WAVES}, f AS (SELECT vec_id, label, unnest(range(0, len(x) // {FRAME})) AS frame, x FROM x), y AS (SELECT vec_id, label, frame, x[frame * {FRAME} + 1 : frame * {FRAME} + {FRAME}] AS y FROM f)"


@query(
    "spectral_kurtosis",
    f"""WITH {_FRAMES}, k AS (SELECT vec_id, unnest(range(1, {FRAME // 2})) AS k, y FROM y), p AS (SELECT vec_id, k, {_power("k", "y")} AS p FROM k)
SELECT vec_id, k AS bin, round(avg(p * p) / nullif(avg(p) * avg(p), 0) - 2, 5) + 0.0 AS kurtosis FROM p GROUP BY ALL""",
)
def spectral_kurtosis(spark, sf_dir):
    """Kurtosis of each bin's power over the frames of a waveform."""
    bins = _frames(spark, sf_dir).select(
        "vec_id", F.posexplode(F.slice(dsp.rfft("y"), 2, FRAME // 2 - 1)).alias("at", "a")
    )
    p = F.col("a") * F.col("a")
    found = F.avg(p * p) / F.nullif(F.avg(p) * F.avg(p), F.lit(0.0)) - 2
    return bins.groupBy("vec_id", (F.col("at") + 1).cast("long").alias("bin")).agg(tidy(found, 5).alias("kurtosis"))


@query(
    "stft_frames",
    f"WITH {_FRAMES}, k AS (SELECT vec_id, frame, unnest(range(1, {FRAME // 2})) AS bin, y FROM y) SELECT vec_id, frame, bin, round({_amplitude('bin', 'y')}, 5) + 0.0 AS amplitude FROM k"
)
def stft_frames(spark, sf_dir):
    """Short-time spectra: a row for each frame and bin."""
    bins = _frames(spark, sf_dir).select(
        "vec_id",
        F.col("frame").cast("long").alias("frame"),
        F.posexplode(F.slice(dsp.rfft("y"), 2, FRAME // 2 - 1)).alias("at", "a")
    )
    return bins.select(
        "vec_id", "frame", (F.col("at") + 1).cast("long").alias("bin"), tidy(F.col("a"), 5).alias("amplitude")
    )


@query(
    "spectrum_waterfall",
    f"""WITH {_WAVES}, b AS (SELECT label, vec_id // 50 AS period, unnest(range(1, 9)) AS bin, x FROM x) SELECT label AS machine, period, bin, round(avg({_amplitude("bin")}), 5) + 0.0 AS amplitude, count(*) AS spectra FROM b GROUP BY ALL""",
)
def spectrum_waterfall(spark, sf_dir):
    """Mean spectrum of each machine by period, for a cascade plot."""
    rows = _embeddings(spark, sf_dir).select(
        F.col("label").alias("machine"),
        F.floor(F.col("vec_id") / 50).alias("period"),
        F.posexplode(F.slice(dsp.rfft("embedding"), 2, 8)).alias("at", "a")
    )
    return rows.groupBy("machine", "period", (F.col("at") + 1).cast("long").alias("bin")).agg(
        tidy(F.avg("a"), 5).alias("amplitude"), F.count("*").alias("spectra")
    )


@query(
    "spectrum_peaks",
    f"""WITH {_WAVES}, b AS (SELECT vec_id, unnest(range(1, 32)) AS bin, x FROM x), a AS (SELECT vec_id, bin, {_amplitude("bin")} AS a FROM b)
SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY a DESC, bin) AS BIGINT) AS place, bin, round(a, 5) AS amplitude FROM a QUALIFY place <= 3""",
)
def spectrum_peaks(spark, sf_dir):
    """The three largest bins of each spectrum: sorted within the row, nothing is shuffled."""
    ranked = F.transform(
        F.slice(dsp.rfft("embedding"), 2, 31), lambda a, i: F.struct((-a).alias("a"), (i + 1).cast("long").alias("bin"))
    )
    rows = _embeddings(spark, sf_dir).select(
        "vec_id", F.posexplode(F.slice(F.array_sort(ranked), 1, 3)).alias("at", "p")
    )
    return rows.select(
        "vec_id", (F.col("at") + 1).cast("long").alias("place"), "p.bin", F.round(-F.col("p.a"), 5).alias("amplitude")
    )


@query(
    "harmonic_table",
    f"""WITH {_WAVES}, b AS (SELECT vec_id, x, unnest(range(2, least(51, len(x) // 2))) AS harmonic FROM x) SELECT vec_id, harmonic, round(100 * sqrt({_power("harmonic")}) / nullif(sqrt({_power("1")}), 0), 4) + 0.0 AS percent FROM b""",
)
def harmonic_table(spark, sf_dir):
    """Each harmonic below half the samples, to the 50th, in percent of the fundamental."""
    rows = _embeddings(spark, sf_dir).select("vec_id", dsp.rfft("embedding").alias("s"))
    rows = rows.select("vec_id", F.element_at("s", 2).alias("base"), F.posexplode(F.slice("s", F.lit(3), F.least(F.lit(49), F.size("s") - 3))).alias("at", "a"))
    return rows.select(
        "vec_id",
        (F.col("at") + 2).cast("long").alias("harmonic"),
        tidy(100 * F.col("a") / F.nullif("base", F.lit(0.0)), 4).alias("percent")
    )


_PAIR = "h AS (SELECT vec_id, x[1:32] AS vs, x[33:64] AS cs FROM x)"
_PART = "list_sum(list_transform({0}, lambda v, i: v * {1}(2 * pi() * (i - 1) / len({0}))))"


@query(
    "displacement_power_factor",
    f"""WITH {_WAVES}, {_PAIR}, p AS (SELECT vec_id, {_PART.format("vs", "cos")} AS vr, {_PART.format("vs", "sin")} AS vi, {_PART.format("cs", "cos")} AS ir, {_PART.format("cs", "sin")} AS ii FROM h)
SELECT vec_id, round((vr * ir + vi * ii) / nullif(sqrt(vr * vr + vi * vi) * sqrt(ir * ir + ii * ii), 0), 5) + 0.0 AS displacement_pf FROM p""",
)
def displacement_power_factor(spark, sf_dir):
    """Cosine of the angle between the fundamentals of voltage (first half) and current (second half)."""
    def part(x, f):
        return dsp.total(F.transform(x, lambda v, i: v * f(2 * 3.141592653589793 * i / F.size(x))))

    rows = _embeddings(spark, sf_dir).select(
        "vec_id",
        dsp.doubles(F.slice("embedding", 1, 32)).alias("v"),
        dsp.doubles(F.slice("embedding", 33, 32)).alias("i")
    )
    parts = rows.select(
        "vec_id",
        *(
            part(F.col(x), f).alias(n)
            for x, f, n in (("v", F.cos, "vr"), ("v", F.sin, "vi"), ("i", F.cos, "ir"), ("i", F.sin, "ii"))
        )
    )
    size = F.sqrt(
        F.col("vr") * F.col("vr") + F.col("vi") * F.col("vi")
    ) * F.sqrt(F.col("ir") * F.col("ir") + F.col("ii") * F.col("ii"))
    return parts.select(
        "vec_id",
        tidy(
            (F.col("vr") * F.col("ir") + F.col("vi") * F.col("ii")) / F.nullif(size, F.lit(0.0)), 5
        ).alias("displacement_pf")
    )


@query(
    "ae_features",
    f"""WITH {_WAVES}, a AS (SELECT vec_id, x, list_transform(x, lambda v: abs(v)) AS a FROM x), o AS (SELECT *, list_filter(range(1, len(a) + 1), lambda i: a[i] > 0.2) AS over FROM a)
SELECT vec_id, round(sqrt({_LIST.format("v * v")} / len(x)), 6) AS rms, round(list_max(a), 6) AS peak, round(list_sum(list_transform(x, lambda v: v * v)) / 64000, 9) AS energy,
  CASE WHEN len(over) > 0 THEN CAST(list_max(over) - list_min(over) AS BIGINT) END AS duration, CASE WHEN len(over) > 0 THEN CAST(list_position(a, list_max(a)) - list_min(over) AS BIGINT) END AS rise,
  round(CAST((SELECT count(*) FROM unnest(over) u(i) WHERE i > 1 AND a[i - 1] <= 0.2) AS DOUBLE) / (len(x) / 64000.0), 4) AS counts_per_second FROM o""",
)
def ae_features(spark, sf_dir):
    """RMS, peak, energy, duration and rise time (in samples) of the burst over the threshold, crossings per second."""
    x, a, over = F.col("x"), F.col("a"), F.col("over")
    rows = _embeddings(spark, sf_dir).select(
        "vec_id", dsp.doubles(F.col("embedding")).alias("x")
    ).withColumn("a", F.transform(x, F.abs))
    rows = rows.withColumn("over", F.filter(F.sequence(F.lit(1), F.size(a)), lambda i: F.element_at(a, i) > 0.2))
    ups = F.size(F.filter(over, lambda i: (i > 1) & (F.element_at(a, F.greatest(i - 1, F.lit(1))) <= 0.2)))
    return rows.select(
        "vec_id", F.round(dsp.array_rms(x), 6).alias("rms"), F.round(F.array_max(a), 6).alias("peak"), F.round(dsp.total(F.transform(x, lambda v: v * v)) / 64_000, 9).alias("energy"),
        (F.array_max(over) - F.array_min(over)).cast("long").alias("duration"), F.when(F.size(over) > 0, F.array_position(a, F.array_max(a)) - F.array_min(over)).alias("rise"),
        F.round(ups.cast("double") / (F.size(x) / 64_000), 4).alias("counts_per_second"),
    )


def _line(hz: str) -> str:
    return _amplitude(f"({hz}) * len(x) / 640.0")


@query(
    "eccentricity_lines",
    f"""WITH {_WAVES}, a AS (SELECT vec_id, {_line("60 - 29.1")} AS low, {_line("60 + 29.1")} AS high, {_line("60")} AS base FROM x)
SELECT vec_id, round(20 * log10(greatest(low, high) / base), 4) + 0.0 AS level_db, round(20 * log10(greatest(low, high) / base), 4) > -35 AS eccentric FROM a WHERE base > 0 AND greatest(low, high) > 0""",
)
def eccentricity_lines(spark, sf_dir):
    """The supply line's sidebands at one turn of the rotor (60 Hz supply, 29.1 turns a second), the larger of the
    two.
    """
    x, rate = dsp.doubles(F.col("embedding")), F.lit(640.0)
    at = lambda hz: dsp.at_frequency(F.col("x"), F.lit(hz), rate)
    rows = _embeddings(spark, sf_dir).select("vec_id", x.alias("x")).select(
        "vec_id", F.greatest(at(60 - 29.1), at(60 + 29.1)).alias("side"), at(60.0).alias("base")
    ).where("base > 0 and side > 0")
    level = tidy(dsp.decibels(F.col("side") / F.col("base")), 4)
    return rows.select("vec_id", level.alias("level_db"), (level > -35).alias("eccentric"))


@query(
    "stator_rise",
    f"""WITH {_WAVES}, r AS (SELECT vec_id, label, (sqrt({_power("3")}) + sqrt({_power("5")})) / nullif(sqrt({_power("1")}), 0) AS r FROM x), b AS (SELECT label, avg(r) AS base FROM r WHERE vec_id % 2 = 0 GROUP BY label)
SELECT vec_id, round(r / nullif(base, 0), 4) + 0.0 AS rise, r > 1.5 * base AS suspect FROM r JOIN b ON r.label = b.label WHERE vec_id % 2 = 1""",
)
def stator_rise(spark, sf_dir):
    """Third and fifth harmonics of a machine's current against its baseline."""
    s = F.col("s")
    ratio = (s[3] + s[5]) / F.nullif(s[1], F.lit(0.0))
    rows = _embeddings(spark, sf_dir).select(
        "vec_id", "label", dsp.rfft("embedding").alias("s")
    ).select("vec_id", "label", ratio.alias("r"))
    base = rows.where("vec_id % 2 = 0").groupBy("label").agg(F.avg("r").alias("base"))
    found = rows.where("vec_id % 2 = 1").join(base, "label")
    return found.select(
        "vec_id",
        tidy(F.col("r") / F.nullif("base", F.lit(0.0)), 4).alias("rise"),
        (F.col("r") > 1.5 * F.col("base")).alias("suspect")
    )


@query(
    "park_modulus_spectrum",
    f"""WITH {_WAVES}, p AS (SELECT vec_id, list_transform(range(1, 17), lambda i: sqrt(pow(sqrt(2 / 3.0) * x[i] - (x[i + 16] + x[i + 32]) / sqrt(6), 2) + pow((x[i + 16] - x[i + 32]) / sqrt(2), 2))) AS m FROM x)
SELECT vec_id, round({_amplitude("2", "m")}, 5) + 0.0 AS line_2, round({_amplitude("4", "m")}, 5) + 0.0 AS line_4 FROM p""",
)
def park_modulus_spectrum(spark, sf_dir):
    """Lines of the modulus of Park's vector: the extended form. Three stretches of a waveform stand for the phases."""
    x = F.col("x")
    direct = lambda i: F.sqrt(F.lit(2 / 3.0)) * F.element_at(x, i) - (F.element_at(x, i + 16) + F.element_at(x, i + 32)) / F.sqrt(F.lit(6.0))
    quadrature = lambda i: (F.element_at(x, i + 16) - F.element_at(x, i + 32)) / F.sqrt(F.lit(2.0))
    modulus = F.transform(
        F.sequence(F.lit(1), F.lit(16)), lambda i: F.sqrt(direct(i) * direct(i) + quadrature(i) * quadrature(i))
    )
    rows = _embeddings(spark, sf_dir).select(
        "vec_id", dsp.doubles(F.col("embedding")).alias("x")
    ).select("vec_id", dsp.rfft(modulus).alias("s"))
    return rows.select("vec_id", tidy(F.col("s")[2], 5).alias("line_2"), tidy(F.col("s")[4], 5).alias("line_4"))


_MARKERS = "m AS (SELECT label AS machine, unnest([(1 + label) * 1.5, (1 + label) * 2.5]) AS hz FROM (SELECT DISTINCT label FROM embeddings))"


@query(
    "marker_on_spectrum",
    f"""WITH {_WAVES}, b AS (SELECT vec_id, label, unnest(range(1, 32)) AS bin, x FROM x), a AS (SELECT vec_id, label, bin, {_amplitude("bin")} AS a FROM b), {_MARKERS}
SELECT vec_id, CAST(round(hz, 4) AS DOUBLE) AS marker, bin, round(a, 5) + 0.0 AS amplitude FROM a JOIN m ON label = machine AND bin >= hz - 0.5 AND bin < hz + 0.5""",
)
def marker_on_spectrum(spark, sf_dir):
    """Defect-frequency markers of a machine joined to the spectrum bins that they fall in."""
    rows = _embeddings(spark, sf_dir)
    markers = rows.select(F.col("label").alias("machine")).distinct().select(
        "machine", F.explode(F.array((1 + F.col("machine")) * 1.5, (1 + F.col("machine")) * 2.5)).alias("hz")
    )
    markers = markers.select("machine", "hz", (F.col("hz") - 0.5).alias("low"), (F.col("hz") + 0.5).alias("high"))
    bins = rows.select(
        "vec_id", "label", F.posexplode(F.slice(dsp.rfft("embedding"), 2, 31)).alias("at", "a")
    ).select("vec_id", "label", (F.col("at") + 1).cast("long").alias("bin"), "a")
    found = range_to_bin(bins, markers, "bin", "low", "high", 1.0).where("label = machine")
    return found.select("vec_id", F.round("hz", 4).alias("marker"), "bin", tidy(F.col("a"), 5).alias("amplitude"))


@query(
    "spectrum_clusters",
    f"""WITH RECURSIVE {_WAVES}, p AS (SELECT vec_id, CAST(floor({_amplitude("4")} / 0.02) AS BIGINT) AS a, CAST(floor({_amplitude("8")} / 0.02) AS BIGINT) AS b FROM x),
c AS (SELECT a, b, count(*) AS n FROM p GROUP BY ALL HAVING count(*) >= 3), r AS (SELECT a, b, a AS s, b AS t FROM c UNION SELECT c.a, c.b, r.s, r.t FROM r JOIN c ON abs(c.a - r.a) <= 1 AND abs(c.b - r.b) <= 1),
l AS (SELECT a, b, min(s * 1000000 + t) AS cluster FROM r GROUP BY ALL) SELECT vec_id, cluster FROM p LEFT JOIN l USING (a, b)""",
)
def spectrum_clusters(spark, sf_dir):
    """Spectra by density: cells of two line amplitudes that hold three or more, tied to dense neighbours; others are
    noise (null).
    """
    s = F.col("s")
    rows = _embeddings(spark, sf_dir).select("vec_id", dsp.rfft("embedding").alias("s"))
    cells = rows.select("vec_id", F.floor(s[4] / 0.02).alias("a"), F.floor(s[8] / 0.02).alias("b"))
    return density_clusters(cells, "a", "b", 3).select("vec_id", "cluster")
