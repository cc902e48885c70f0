"""Centroid clustering over space-filling-curve zone maps.

Vectors are put in the order of a Hilbert curve over the components in which the first centroids differ most, and cut
into blocks of consecutive vectors; a block keeps the least and the greatest value of every component. In each round
the box of a block tells which centroids can be nearest to any of its vectors: none whose least distance to the box is
beyond the smallest of the greatest distances, and none that is farther than the middle's nearest centroid everywhere
in the box (the difference of two squared distances is linear, so its extremes stand in corners). Only these
candidates are compared, exactly, one matrix product a block. Rounds read the table of blocks; tasks give sums and
counts of the centroids, so k rows reach the driver, whatever the number of vectors.

Arithmetic is in integers: components are floor(scale * x), new centroids are floor(sum / count). Defined results:
vectors that are null, of another length or hold null or non-finite components are left out; components beyond
2^27 are held there; sums beyond a long are null. Fewer vectors than centroids make fewer centroids. Rows that repeat
a key are vectors of their own; a null key comes last among the first centroids. An empty table stays empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremora.llm.vectors import integers, matrix, partial_sums, products, summed, whole
from tremora.session import cut

CENTROIDS = 40
ROUNDS = 5
DIMENSION = 64
SCALE = 256
#: Vectors of a block.
BLOCK = 128
#: Components that the curve runs through, and bits of each; together they fit a long.
CURVE, BITS = 8, 7


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on a Hilbert curve of points with non-negative integer coordinates below 2^bits, one row each.

    Bit by bit from the top: a set bit mirrors the lower bits of the first coordinate, a clear one swaps them with the
    first coordinate's; the Gray code of what is left, read across the coordinates, is the place.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(n):
            is_set = (x[i] >> bit & 1).astype(bool)
            swapped = np.where(is_set, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(is_set, low, swapped)
            if i:
                x[i] ^= swapped
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> bit & 1, (1 << bit) - 1, 0)
    x ^= turn
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            place = place << 1 | x[i] >> bit & 1
    return place


def curve_of(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(components, their lowest values, their steps) for a curve through the space around some centroids."""
    spread = centroids.std(axis=0)
    axes = np.argsort(-spread, kind="stable")[:CURVE]
    low = centroids.mean(axis=0)[axes] - 3 * np.maximum(spread[axes], 1.0)
    return axes, low, 6 * np.maximum(spread[axes], 1.0) / (1 << BITS)


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest, ties included, to a vector in the box."""
    outside = np.maximum(np.maximum(low - centroids, centroids - high), 0)
    nearest = (outside * outside).sum(axis=1)
    across = np.maximum(np.abs(centroids - low), np.abs(centroids - high))
    found = np.flatnonzero(nearest <= (across * across).sum(axis=1).min())
    # against the centroid nearest to the middle: its squared distance less another's, at the corner best for the other
    middle = 2 * centroids[found] - low - high
    best = centroids[found[np.argmin((middle.astype(float) ** 2).sum(axis=1))]]
    slope = 2 * (centroids[found] - best)
    corner = np.where(slope > 0, slope * high, slope * low).sum(axis=1)
    gain = corner - (centroids[found] ** 2).sum(axis=1) + (best**2).sum()
    return found[gain >= 0]


def assign(rows: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance) of each vector of a block; ties go to the smaller number."""
    some = candidates(low, high, centroids)
    near = centroids[some]
    square = (rows * rows).sum(axis=1)[:, None] - 2 * products(rows, near) + (near * near).sum(axis=1)
    best = np.argmin(square, axis=1)
    return some[best], square[np.arange(len(rows)), best]


def kept_vectors(rows: DataFrame, key: str, vector: str, scale: int, dimension: int) -> DataFrame:
    """(key, x): the whole vectors of the right length, as integers."""
    own = rows.select(F.col(key).alias("key"), F.col(vector).alias("x"))
    return own.where(whole(F.col("x")) & (F.size("x") == dimension)).select(
        "key", integers(F.col("x"), scale).alias("x")
    )


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The vectors of the k smallest digests of ``seed:key``, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    rows = vectors.select(digest.alias("d"), "x").orderBy(F.col("d").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r["x"] for r in rows], dtype=np.int64)


_BLOCK = "keys array<long>, n int, x binary, low binary, high binary"


def zone_map(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Blocks of consecutive vectors on the curve: keys, the vectors and the box around them."""
    axes, low, step = curve_of(centroids)

    @F.arrow_udf(T.LongType())
    def place(column: pa.Array) -> pa.Array:
        if not len(column):
            return pa.array([], pa.int64())
        cells = np.clip((matrix(column)[:, axes] - low) / step, 0, (1 << BITS) - 1)
        return pa.array(hilbert(cells.astype(np.int64), BITS))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            while n >= BLOCK:
                every = pa.Table.from_batches(held)
                whole_blocks = n // BLOCK * BLOCK
                yield packed(every.slice(0, whole_blocks))
                held, n = every.slice(whole_blocks).to_batches(), n - whole_blocks
        if n:
            yield packed(pa.Table.from_batches(held))

    def packed(rows: pa.Table) -> pa.RecordBatch:
        keys, x = rows.column(0).combine_chunks(), matrix(rows.column(1).combine_chunks())
        starts = range(0, len(x), BLOCK)
        parts = [x[a : a + BLOCK].astype("<i4") for a in starts]
        offsets = pa.array([*starts, len(x)], pa.int32())
        return pa.record_batch(
            [
                pa.ListArray.from_arrays(offsets, keys),
                pa.array([len(p) for p in parts], pa.int32()),
                pa.array([p.tobytes() for p in parts], pa.binary()),
                pa.array([p.min(axis=0).tobytes() for p in parts], pa.binary()),
                pa.array([p.max(axis=0).tobytes() for p in parts], pa.binary())
            ],
            names=["keys", "n", "x", "low", "high"]
        )

    # copies share a place: the key's hash deals them among partitions too
    placed = vectors.select("key", "x", place("x").alias("place"), F.xxhash64("key").alias("salt"))
    dealt = placed.repartitionByRange("place", "salt").sortWithinPartitions("place", "salt")
    return dealt.select("key", "x").mapInArrow(blocks, _BLOCK)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    for i in range(batch.num_rows):
        n = batch.column(1)[i].as_py()
        x, low, high = (
            np.frombuffer(batch.column(c)[i].as_buffer(), dtype="<i4").astype(np.int64) for c in (2, 3, 4)
        )
        yield batch.column(0)[i].values, x.reshape(n, -1), low, high


def round_sums(blocks: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """(vectors, sum of distances, componentwise sums) of each centroid that has any."""
    k, d = centroids.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(k, dtype=np.int64), np.zeros((k, d + 1), dtype=object)
        for batch in batches:
            found = [(x, *assign(x, low, high, centroids)) for _, x, low, high in _blocks(batch)]
            if found:
                x, near, square = (np.concatenate(part) for part in zip(*found, strict=True))
                n, sums = partial_sums(near, k, square, x)
                counts += n
                total += sums
        held = np.flatnonzero(counts)
        yield pa.record_batch(
            [
                pa.array(held, pa.int32()),
                pa.array(counts[held], pa.int64()),
                pa.array([[int(v) for v in row] for row in total[held]], pa.list_(pa.decimal128(38)))
            ],
            names=["cluster", "n", "sums"]
        )

    parts = blocks.mapInArrow(partial, "cluster int, n long, sums array<decimal(38,0)>")
    found = summed(parts, ["cluster"], d + 1)
    return {c: (n, int(s[0]), [int(v) for v in s[1:]]) for (c,), (n, s) in found.items()}


def fit(blocks: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The centroids after some rounds. Those without vectors stay."""
    for _ in range(rounds):
        centroids = centroids.copy()
        for c, (n, _, sums) in round_sums(blocks, centroids).items():
            centroids[c] = [s // n for s in sums]
    return centroids


def assigned(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(key, cluster, distance) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(keys, *assign(x, low, high, centroids)) for keys, x, low, high in _blocks(batch)]
            if found:
                yield pa.record_batch(
                    [
                        pa.concat_arrays([k for k, _, _ in found]),
                        pa.array(np.concatenate([c for _, c, _ in found]), pa.int32()),
                        pa.array(np.concatenate([s for _, _, s in found]), pa.int64())
                    ],
                    names=["key", "cluster", "distance"]
                )

    return blocks.mapInArrow(run, "key long, cluster int, distance long")


def cluster(
    rows: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    dimension: int = DIMENSION,
    seed: str = "2"
) -> tuple[DataFrame, np.ndarray, dict[int, tuple[int, int, list[int]]]]:
    """((key, cluster, distance) of every kept vector, centroids, (vectors, inertia, sums) of each centroid)."""
    vectors = kept_vectors(rows, key, vector, scale, dimension)
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        none = rows.sparkSession.createDataFrame([], "key long, cluster int, distance long")
        return none, centroids.reshape(0, dimension), {}
    blocks = cut(zone_map(vectors, centroids), "blocks")
    centroids = fit(blocks, centroids, rounds)
    return assigned(blocks, centroids), centroids, round_sums(blocks, centroids)


def _sql() -> str:
    """The rounds written out, one after the other."""
    dot = "list_dot_product"
    parts = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS x FROM embeddings
WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSION} AND len(embedding) = {DIMENSION})""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, x FROM v QUALIFY c < {CENTROIDS})"""
    ]
    for i in range(ROUNDS + 1):
        parts.append(
            f"a{i} AS MATERIALIZED (SELECT vec_id, v.x, min(struct_pack(d := {dot}(v.x, v.x) - 2 * {dot}(v.x, c{i}.x) + {dot}(c{i}.x, c{i}.x), c := c)) AS m FROM v, c{i} GROUP BY ALL)"
        )
        if i < ROUNDS:
            parts.append(
                f"""c{i + 1} AS MATERIALIZED (WITH s AS (SELECT m.c AS c, unnest(range({DIMENSION})) AS pos, unnest(x) AS x FROM a{i}), f AS (SELECT c, pos, floor(sum(x) / count(*)) AS x FROM s GROUP BY ALL),
n AS (SELECT c, list(x ORDER BY pos) AS x FROM f GROUP BY c) SELECT c{i}.c, coalesce(n.x, c{i}.x) AS x FROM c{i} LEFT JOIN n ON n.c = c{i}.c)"""
            )
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, CAST(m.d AS BIGINT) AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
sha256(array_to_string(list_transform(c{ROUNDS}.x, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} ON c{ROUNDS}.c = m.c"""


OP12_SQL = _sql()


def op12_centroid_clustering(spark, sf_dir):
    """The clusters of ``embeddings`` with the inertia of each and of all, and the digest of each centroid."""
    from tremora.session import table

    found, centroids, sums = cluster(table(spark, sf_dir, "embeddings"))
    long = lambda x: F.lit(x if x < 1 << 63 else None).cast("long")
    of = {c: (n, inertia) for c, (n, inertia, _) in sums.items()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    at = F.col("cluster") + 1
    none = F.array(F.lit(None))
    inertia = F.array(*(long(of[c][1] if c in of else 0) for c in range(len(centroids)))) if len(centroids) else none
    digests = F.array(*map(F.lit, digest)) if digest else none
    return found.select(
        F.col("key").alias("vec_id"),
        "cluster",
        "distance",
        F.element_at(inertia, at).cast("long").alias("cluster_inertia"),
        long(sum(i for _, i in of.values())).alias("inertia"),
        F.element_at(digests, at).cast("string").alias("centroid_sha256")
    )
