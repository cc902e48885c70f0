"""Signal and power queries on waveforms."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tremora.functions import dsp, power
from tremora.functions.features import tidy
from tremora.operators.ranks import quantile
from tremora.plans.registry import events, query
from tremora.session import table

RATE = 64_000.0


def _waves(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").withColumn("x", dsp.doubles(F.col("embedding")))


_WAVES = "x AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings)"
_LIST = "list_sum(list_transform(x, lambda v, i: {}))"


def _power(k: str, x: str = "x") -> str:
    """Squared magnitude at bin k in SQL."""
    angle = f"2 * pi() * ({k}) * (i - 1) / len({x})"
    return f"(pow(list_sum(list_transform({x}, lambda v, i: v * cos({angle}))), 2) + pow(list_sum(list_transform({x}, lambda v, i: v * sin({angle}))), 2))"


def _amplitude(k: str, x: str = "x") -> str:
    return f"2 * sqrt({_power(k, x)}) / len({x})"


@query(
    "wave_time_features",
    f"""WITH {_WAVES}, m AS (SELECT vec_id, x, list_avg(x) AS mu, sqrt({_LIST.format("v * v")} / len(x)) AS rms, list_max(list_transform(x, lambda v: abs(v))) AS peak FROM x),
k AS (SELECT *, list_sum(list_transform(x, lambda v: pow(v - mu, 2))) / len(x) AS m2, list_sum(list_transform(x, lambda v: pow(v - mu, 3))) / len(x) AS m3, list_sum(list_transform(x, lambda v: pow(v - mu, 4))) / len(x) AS m4 FROM m)
SELECT vec_id, round(rms, 6) AS rms, round(peak, 6) AS peak, round(peak / nullif(rms, 0), 6) AS crest, round(m3 / nullif(pow(m2, 1.5), 0), 6) + 0.0 AS skewness, round(m4 / nullif(m2 * m2, 0) - 3, 6) + 0.0 AS kurtosis FROM k""",
)
def wave_time_features(spark, sf_dir):
    x = F.col("x")
    rows = _waves(spark, sf_dir).select(
        "vec_id", x, dsp.array_mean(x).alias("mu"), dsp.array_rms(x).alias("rms"), dsp.array_peak(x).alias("peak")
    )
    rows = rows.select("*", *(dsp.central_moment(x, F.col("mu"), k).alias(f"m{k}") for k in (2, 3, 4)))
    zero = F.lit(0.0)
    return rows.select(
        "vec_id", F.round("rms", 6).alias("rms"), F.round("peak", 6).alias("peak"), F.round(F.col("peak") / F.nullif("rms", zero), 6).alias("crest"),
        tidy(F.col("m3") / F.nullif(F.pow("m2", F.lit(1.5)), zero)).alias("skewness"), tidy(F.col("m4") / F.nullif(F.col("m2") * F.col("m2"), zero) - 3).alias("kurtosis"),
    )


@query(
    "dft_harmonics",
    f"WITH {_WAVES} SELECT vec_id, round({_amplitude('4')}, 6) AS h1, round({_amplitude('8')}, 6) AS h2, round({_amplitude('12')}, 6) AS h3 FROM x"
)
def dft_harmonics(spark, sf_dir):
    """Amplitudes at one, two and three times the running speed."""
    return _waves(spark, sf_dir).select(
        "vec_id", *(F.round(dsp.amplitude(F.col("x"), F.lit(4.0 * k)), 6).alias(f"h{k}") for k in (1, 2, 3))
    )


@query("hann_dft", f"""WITH {_WAVES}, h AS (SELECT vec_id, list_transform(x, lambda v, i: v * 0.5 * (1 - cos(2 * pi() * (i - 1) / len(x)))) AS y FROM x)
SELECT vec_id, round({_amplitude("5", "y")} / 0.5, 6) AS amplitude FROM h""")  # fmt: skip
def hann_dft(spark, sf_dir):
    """Amplitude of a bin under the Hann window, corrected for its gain."""
    return _waves(spark, sf_dir).select("vec_id", dsp.hann(F.col("x")).alias("y")).select(
        "vec_id", F.round(dsp.amplitude(F.col("y"), F.lit(5.0), 0.5), 6).alias("amplitude")
    )


_HARMONICS = " + ".join(_power(str(h)) for h in range(2, 32))


@query(
    "thd_50",
    f"WITH {_WAVES} SELECT vec_id, round(sqrt({_HARMONICS}) / nullif(sqrt({_power('1')}), 0), 4) AS thd FROM x"
)
def thd_50(spark, sf_dir):
    """Total harmonic distortion over the harmonics below half the samples, 50 at most: one transform a row."""
    bins = F.least(F.lit(49), (F.size("embedding") / 2 - 2).cast("int"))
    harmonics = dsp.total(F.transform(F.slice("a", F.lit(3), bins), lambda v: v * v))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", dsp.rfft("embedding").alias("a"), "embedding")
    return rows.select(
        "vec_id", F.round(F.sqrt(harmonics) / F.nullif(F.element_at("a", 2), F.lit(0.0)), 4).alias("thd")
    )


@query(
    "sideband_ratio_db",
    f"""WITH {_WAVES}, s AS (SELECT vec_id, {_amplitude("(60 - 2 * 0.03 * 60) * len(x) / 640.0")} AS lower_a, {_amplitude("(60 + 2 * 0.03 * 60) * len(x) / 640.0")} AS upper_a, {_amplitude("60 * len(x) / 640.0")} AS base_a FROM x)
SELECT vec_id, round(20 * log10(lower_a / base_a), 4) + 0.0 AS ratio_db, round(20 * log10(upper_a / base_a), 4) + 0.0 AS upper_db, greatest(round(20 * log10(lower_a / base_a), 4), round(20 * log10(upper_a / base_a), 4)) > -40 AS broken_bar FROM s WHERE lower_a > 0 AND upper_a > 0 AND base_a > 0""",
)
def sideband_ratio_db(spark, sf_dir):
    """Both slip sidebands against the supply line; a fault where either is above -40 dB."""
    low, high = dsp.sidebands(F.lit(60.0), F.lit(0.03))
    at = lambda hz: dsp.at_frequency(F.col("x"), hz, F.lit(640.0))
    rows = _waves(spark, sf_dir).select(
        "vec_id", at(low).alias("a"), at(high).alias("c"), at(F.lit(60.0)).alias("b")
    ).where("a > 0 and b > 0 and c > 0")
    below, above = (tidy(dsp.decibels(F.col(c) / F.col("b")), 4) for c in "ac")
    return rows.select(
        "vec_id", below.alias("ratio_db"), above.alias("upper_db"), (F.greatest(below, above) > -40).alias("broken_bar")
    )


@query(
    "octave_bands",
    f"""WITH {_WAVES}, b AS (SELECT vec_id, unnest(list_transform(range(1, 33), lambda k: [CAST(k AS DOUBLE), list_sum(list_transform(x, lambda v, i: v * cos(2 * pi() * k * (i - 1) / len(x)))), list_sum(list_transform(x, lambda v, i: v * sin(2 * pi() * k * (i - 1) / len(x))))])) AS r FROM x)
SELECT vec_id, CAST(floor(3 * log2(r[1] * 1000 / 1000.0) + 1e-9) AS BIGINT) AS band, round(sum(r[2] * r[2] + r[3] * r[3]), 5) AS power FROM b GROUP BY ALL""",
)
def octave_bands(spark, sf_dir):
    """Power by third-octave band around 1 kHz; bins are 1 kHz apart."""
    n = F.size("embedding")
    spectra = table(spark, sf_dir, "embeddings").select(
        "vec_id", n.alias("n"), F.posexplode(dsp.rfft("embedding")).alias("k", "a")
    ).where("k > 0")
    band = F.floor(3 * F.log2(F.col("k") * (RATE / 64) / 1000) + 1e-9)
    one_sided = F.when(2 * F.col("k") == F.col("n"), F.col("n")).otherwise(F.col("n") / 2)
    return spectra.groupBy("vec_id", band.alias("band")).agg(
        F.round(F.sum(F.pow(F.col("a") * one_sided, F.lit(2.0))), 5).alias("power")
    )


@query(
    "noise_floor",
    f"""WITH {_WAVES}, b AS (SELECT vec_id, label, unnest(list_transform(range(20, 32), lambda k: 2 * sqrt(pow(list_sum(list_transform(x, lambda v, i: v * cos(2 * pi() * k * (i - 1) / len(x)))), 2) + pow(list_sum(list_transform(x, lambda v, i: v * sin(2 * pi() * k * (i - 1) / len(x)))), 2)) / len(x))) AS a FROM x)
SELECT label AS machine, round(quantile_cont(a, 0.5), 6) AS floor FROM b GROUP BY label""",
)
def noise_floor(spark, sf_dir):
    """Median amplitude in the high band by machine."""
    bins = table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("machine"), F.explode(F.slice(dsp.rfft("embedding"), 21, 12)).alias("a")
    )
    return quantile(bins, ["machine"], "a", 0.5, "floor").select("machine", F.round("floor", 6).alias("floor"))


@query(
    "spectrum_overlay",
    f"""WITH {_WAVES}, b AS (SELECT vec_id, label, unnest(range(1, 9)) AS k, x FROM x), a AS (SELECT vec_id, label, k, {_amplitude("k")} AS a FROM b),
h AS (SELECT label, k, avg(a) AS healthy FROM a WHERE vec_id % 2 = 0 GROUP BY ALL)
SELECT a.label AS machine, a.k AS bin, round(max(a.a - healthy), 6) + 0.0 AS worst_rise FROM a JOIN h ON a.label = h.label AND a.k = h.k WHERE vec_id % 2 = 1 GROUP BY ALL""",
)
def spectrum_overlay(spark, sf_dir):
    """Current against healthy spectra, bin by bin."""
    spectra = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("label").alias("machine"), F.posexplode(F.slice(dsp.rfft("embedding"), 2, 8)).alias("at", "a")
    )
    amplitudes = spectra.select("vec_id", "machine", (F.col("at") + 1).cast("long").alias("bin"), "a")
    healthy = amplitudes.where("vec_id % 2 = 0").groupBy("machine", "bin").agg(F.avg("a").alias("healthy"))
    return amplitudes.where("vec_id % 2 = 1").join(healthy, ["machine", "bin"]).groupBy("machine", "bin").agg(
        tidy(F.max(F.col("a") - F.col("healthy"))).alias("worst_rise")
    )


@query(
    "start_profile_distance",
    """WITH b AS (SELECT list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS y FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda v, i: pow(CAST(v AS DOUBLE) - y[i], 2))) / len(embedding)), 6) AS distance FROM embeddings, b""",
)
def start_profile_distance(spark, sf_dir):
    """Root mean square distance of a start profile from the baseline profile: the one baseline is broadcast."""
    rows = _waves(spark, sf_dir).select("vec_id", "x", F.lit(0).alias("baseline"))
    base = F.broadcast(rows.where("vec_id = 0").select("baseline", F.col("x").alias("b")).limit(1))
    apart = F.zip_with("x", "b", lambda v, b: (v - b) * (v - b))
    return rows.join(base, "baseline").select(
        "vec_id", F.round(F.sqrt(dsp.total(apart) / F.size("x")), 6).alias("distance")
    )


_G = "(p_size / 10.0) / (p_retailprice / 10.0 + 20) * cos(radians(15))"


@query(
    "bearing_frequencies",
    f"""SELECT p_partkey AS bearing_id, round(1800 / 60.0 / 2 * (1 - {_G}), 6) AS ftf, round((8 + p_size % 5) * (1800 / 60.0) / 2 * (1 - {_G}), 6) AS bpfo, round((8 + p_size % 5) * (1800 / 60.0) / 2 * (1 + {_G}), 6) AS bpfi,
  round((p_retailprice / 10.0 + 20) / (2 * (p_size / 10.0)) * (1800 / 60.0) * (1 - pow({_G}, 2)), 6) AS bsf FROM part""",
)
def bearing_frequencies(spark, sf_dir):
    found = dsp.bearing_frequencies(
        F.lit(1800.0), 8 + F.col("p_size") % 5, F.col("p_size") / 10.0, F.col("p_retailprice") / 10.0 + 20, F.lit(15.0)
    )
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("bearing_id"), *(F.round(c, 6).alias(n) for n, c in found.items())
    )


@query(
    "gear_mesh_orders",
    "SELECT p_partkey AS gear_id, CASE WHEN p_size * 500 >= 10000 THEN round((17 + p_size) * 1500 / 60.0, 6) END AS mesh_hz, CAST(17 + p_size AS DOUBLE) AS mesh_order FROM part",
)
def gear_mesh_orders(spark, sf_dir):
    """Gear-mesh frequency where sampling allows it, and its order of the shaft."""
    teeth = (17 + F.col("p_size")).cast("double")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("gear_id"),
        F.round(dsp.gear_mesh(F.lit(1500.0), teeth, F.col("p_size") * 500), 6).alias("mesh_hz"),
        F.round(teeth, 6).alias("mesh_order")
    )


_PHASES = "p AS (SELECT user_id, avg(value) FILTER (WHERE event_type = 'view') AS a, avg(value) FILTER (WHERE event_type = 'click') AS b, avg(value) FILTER (WHERE event_type = 'error') AS c FROM events GROUP BY user_id)"


def _phases(spark, sf_dir):
    pick = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value")))
    return events(spark, sf_dir).groupBy("user_id").agg(
        pick("view").alias("a"), pick("click").alias("b"), pick("error").alias("c")
    )


@query(
    "three_phase_unbalance",
    f"WITH {_PHASES} SELECT user_id AS asset_id, round(100 * greatest(abs(a - (a + b + c) / 3), abs(b - (a + b + c) / 3), abs(c - (a + b + c) / 3)) / ((a + b + c) / 3), 6) AS unbalance_pct FROM p WHERE a + b + c IS NOT NULL"
)
def three_phase_unbalance(spark, sf_dir):
    return _phases(spark, sf_dir).where("a + b + c is not null").select(
        F.col("user_id").alias("asset_id"),
        F.round(power.unbalance(F.col("a"), F.col("b"), F.col("c")), 6).alias("unbalance_pct")
    )


@query(
    "park_vector",
    f"WITH {_PHASES} SELECT user_id AS asset_id, round(sqrt(2 / 3.0) * a - (b + c) / sqrt(6), 6) + 0.0 AS direct, round((b - c) / sqrt(2), 6) + 0.0 AS quadrature FROM p WHERE a + b + c IS NOT NULL"
)
def park_vector(spark, sf_dir):
    d, q = power.park(F.col("a"), F.col("b"), F.col("c"))
    return _phases(spark, sf_dir).where("a + b + c is not null").select(
        F.col("user_id").alias("asset_id"), tidy(d).alias("direct"), tidy(q).alias("quadrature")
    )


@query(
    "power_triangle",
    """WITH s AS (SELECT event_type, value AS v, value * (0.5 + (event_id % 10) / 20.0) AS i FROM events), t AS (SELECT event_type, avg(v * i) AS p, sqrt(avg(v * v)) * sqrt(avg(i * i)) AS s FROM s GROUP BY event_type)
SELECT event_type AS phase, round(p, 4) AS active, round(s, 4) AS apparent, round(sqrt(greatest(s * s - p * p, 0)), 4) AS reactive, round(p / nullif(s, 0), 6) AS power_factor FROM t""",
)
def power_triangle(spark, sf_dir):
    v = F.col("value")
    found = power.power_triangle(v, v * (0.5 + (F.col("event_id") % 10) / 20.0))
    return events(spark, sf_dir).groupBy(F.col("event_type").alias("phase")).agg(
        *(F.round(c, 6 if n == "power_factor" else 4).alias(n) for n, c in found.items())
    )


@query(
    "velocity_rms_band",
    f"""WITH {_WAVES} SELECT vec_id, round(sqrt({" + ".join(f"pow({_amplitude(str(k))} / (2 * pi() * {k * 1000}), 2) / 2" for k in range(1, 9))}) * 1e6, 6) AS velocity FROM x""",
)
def velocity_rms_band(spark, sf_dir):
    """Velocity from acceleration by dividing bins by angular frequency, root-sum-squared over a band."""
    x = F.col("x")
    parts = [F.pow(dsp.amplitude(x, F.lit(float(k))) / (2 * math.pi * k * 1000), F.lit(2.0)) / 2 for k in range(1, 9)]
    return _waves(spark, sf_dir).select("vec_id", F.round(F.sqrt(sum(parts[1:], parts[0])) * 1e6, 6).alias("velocity"))


@query(
    "ae_bursts",
    f"""WITH {_WAVES}, c AS (SELECT vec_id, x, list_transform(range(2, len(x) + 1), lambda i: CASE WHEN abs(x[i]) > 0.2 AND abs(x[i - 1]) <= 0.2 THEN 1 ELSE 0 END) AS up FROM x)
SELECT vec_id, CAST(list_sum(up) AS BIGINT) AS counts, round(list_sum(list_transform(x, lambda v: v * v)) / 64000, 9) AS energy FROM c""",
)
def ae_bursts(spark, sf_dir):
    """Rising threshold crossings and energy of acoustic emission."""
    x = F.col("x")
    up = F.transform(
        F.sequence(F.lit(2), F.size(x)),
        lambda i: ((F.abs(F.element_at(x, i)) > 0.2) & (F.abs(F.element_at(x, i - 1)) <= 0.2)).cast("long")
    )
    return _waves(spark, sf_dir).select(
        "vec_id",
        F.aggregate(up, F.lit(0).cast("long"), lambda a, v: a + v).alias("counts"),
        F.round(dsp.total(F.transform(x, lambda v: v * v)) / RATE, 9).alias("energy")
    )


@query(
    "rfft_spectrum",
    f"""WITH {_WAVES}, b AS (SELECT vec_id, x, unnest(range(0, 33)) AS k FROM x) SELECT vec_id, k AS bin, round((CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END) * sqrt({_power("k")}) / len(x), 5) + 0.0 AS amplitude FROM b"""
)
def rfft_spectrum(spark, sf_dir):
    """Whole spectra in Arrow batches, exploded to bins."""
    spectra = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(dsp.rfft("embedding")).alias("bin", "a"))
    return spectra.select("vec_id", F.col("bin").cast("long").alias("bin"), tidy(F.col("a"), 5).alias("amplitude"))


BANK_RATE = 96_000.0
BANDS = {"low": (10.0, 1000.0), "middle": (1000.0, 10_000.0), "high": (10_000.0, 40_000.0)}


def _filtered_sql(x: str, taps: str, n: int) -> str:
    """Convolution with centred taps in SQL."""
    half = (n - 1) // 2
    return f"list_transform(range(1, len({x}) + 1), lambda i: list_sum(list_transform(range(1, {n + 1}), lambda j: CASE WHEN i + {half + 1} - j BETWEEN 1 AND len({x}) THEN {taps}[j] * {x}[i + {half + 1} - j] ELSE 0 END)))"


def _taps_sql(low: float, high: float, rate: float = RATE) -> str:
    return "[" + ", ".join(repr(float(h)) + "::DOUBLE" for h in dsp.band_taps(low, high, rate)) + "]"


_ENVELOPE = "[" + ", ".join(repr(float(h)) + "::DOUBLE" for h in dsp.low_pass(8_000.0, RATE)) + "]"


@query(
    "envelope_spectrum",
    f"""WITH {_WAVES}, t AS (SELECT {_taps_sql(8_000.0, 24_000.0)} AS h), b AS (SELECT vec_id, list_transform({_filtered_sql("x", "h", 31)}, lambda v: abs(v)) AS y FROM x, t), u AS (SELECT {_ENVELOPE} AS g),
l AS (SELECT vec_id, {_filtered_sql("y", "g", 31)} AS z FROM b, u), m AS (SELECT vec_id, list_transform(z, lambda v: v - list_avg(z)) AS z FROM l),
s AS (SELECT vec_id, list_transform(range(0, 33), lambda k: (CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END) * sqrt(pow(list_sum(list_transform(z, lambda v, i: v * cos(2 * pi() * k * (i - 1) / len(z)))), 2) + pow(list_sum(list_transform(z, lambda v, i: v * sin(2 * pi() * k * (i - 1) / len(z)))), 2)) / len(z)) AS e FROM m)
SELECT vec_id, CAST(list_position(e, list_max(e)) - 1 AS BIGINT) AS line, round(list_max(e), 6) AS amplitude FROM s""",
)
def envelope_spectrum(spark, sf_dir):
    """Strongest envelope line of each waveform."""
    found = table(spark, sf_dir, "embeddings").select(
        "vec_id", dsp.envelope(8_000.0, 24_000.0, RATE, 8_000.0)("embedding").alias("e")
    )
    return found.select(
        "vec_id",
        (F.array_position("e", F.array_max("e")) - 1).alias("line"),
        F.round(F.array_max("e"), 6).alias("amplitude")
    )


def _rms_sql(name: str) -> str:
    low, high = BANDS[name]
    return f"round(sqrt(list_sum(list_transform({_filtered_sql('x', _taps_sql(low, high, BANK_RATE), 31)}, lambda v: v * v)) / len(x)), 6) AS {name}"


@query(
    "band_bank",
    f"""WITH {_WAVES} SELECT vec_id, {_rms_sql("low")}, {_rms_sql("middle")}, {_rms_sql("high")} FROM x"""
)
def band_bank(spark, sf_dir):
    """RMS of each waveform in three pass bands, of signals sampled at 96 kHz; null for a band that the sampling rate
    can't hold.
    """
    rms = lambda low, high: F.round(dsp.array_rms(dsp.band_filter(low, high, BANK_RATE)("embedding")), 6) if high <= BANK_RATE / 2 else F.lit(None).cast("double")
    return table(spark, sf_dir, "embeddings").select("vec_id", *(rms(*band).alias(n) for n, band in BANDS.items()))


_TURN = "(4 * (u / n) + 2 * (u / n) * (u / n))"


@query(
    "order_resample",
    f"""WITH {_WAVES}, a AS (SELECT vec_id, x, len(x) AS n, list_transform(range(0, len(x)), lambda u: {_TURN.replace("n)", "len(x))")}) AS a FROM x),
g AS (SELECT vec_id, x, a, n, list_transform(range(0, 128), lambda j: a[1] + (a[n] - a[1]) * j / 127) AS g FROM a),
p AS (SELECT vec_id, x, a, g, n, list_transform(g, lambda v: least(greatest(len(list_filter(a, lambda t: t <= v)), 1), n - 1)) AS i FROM g),
y AS (SELECT vec_id, list_transform(g, lambda v, k: x[i[k]] + (x[i[k] + 1] - x[i[k]]) * (v - a[i[k]]) / (a[i[k] + 1] - a[i[k]])) AS y FROM p)
SELECT vec_id, round({_amplitude("6", "y")}, 6) AS order_1, round({_amplitude("12", "y")}, 6) AS order_2 FROM y""",
)
def order_resample(spark, sf_dir):
    """Order spectra after resampling a run-up to equal shaft angles."""
    n = F.size("embedding")
    turns = F.transform(F.sequence(F.lit(0), n - 1), lambda i: 4.0 * (i / n) + 2.0 * (i / n) * (i / n))
    resampled = dsp.order_resample(128)("embedding", turns)
    return table(spark, sf_dir, "embeddings").select("vec_id", dsp.rfft(resampled).alias("s")).select(
        "vec_id", F.round(F.col("s")[6], 6).alias("order_1"), F.round(F.col("s")[12], 6).alias("order_2")
    )
