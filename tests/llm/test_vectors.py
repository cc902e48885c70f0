"""Clusters and codes of vectors against plain loops in integers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import rows_of_frame, rows_of_sql, views
from tremora.llm import clusters, registry, vector_codes
from tremora.session import table

BIG = float(3e38)


def plain_integers(vector, scale):
    return [max(-(1 << 27), min(1 << 27, math.floor(scale * float(np.float32(x))))) for x in vector]


def is_whole(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def nearest(x, entries):
    return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(entries))


def moved(rows, entries):
    groups = {}
    for x in rows:
        groups.setdefault(nearest(x, entries)[1], []).append(x)
    return [
        [sum(c) // len(groups[i]) for c in zip(*groups[i], strict=True)] if i in groups else e
        for i, e in enumerate(entries)
    ]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, short, long, empty and non-finite vectors, copies, ties, large components, null and repeated keys."""
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-8, 8, 4).astype(float).tolist(), i % 3 if i % 5 else None, "x") for i in range(90)]
    rows += [(100 + i, [1.0, 1.0, 1.0, 1.0], 7, "y") for i in range(300)]
    rows += [
        (1000, None, 1, None), (1001, [], 1, None), (1002, [1.0, None, 0.0, 0.0], 1, None),
        (1003, [float("nan"), 0.0, 0.0, 0.0], 1, None), (1004, [float("inf"), 0.0, 0.0, 0.0], 1, None),
        (1005, [0.5] * 3, 1, None), (1006, [0.5] * 8, 2, None), (None, [0.5] * 4, None, None), (5, [0.25] * 4, 1, None),
        (1007, [BIG, -BIG, 0.0, 0.0], 9, None),
    ]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, key string")


def test_the_curve_visits_neighbours():
    for n, bits in ((2, 3), (3, 3), (4, 2), (1, 4)):
        points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), axis=-1).reshape(-1, n)
        place = clusters.hilbert(points, bits)
        assert sorted(place.tolist()) == list(range(len(points)))
        assert (np.abs(np.diff(points[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def test_candidates_hold_every_nearest_centroid_and_leave_others_out():
    rng = np.random.default_rng(2)
    left_out = 0
    for _ in range(300):
        d = int(rng.integers(1, 6))
        centroids = rng.integers(-20, 20, (12, d))
        rows = rng.integers(-20, 20, d) + rng.integers(-3, 4, (9, d))
        some = set(clusters.candidates(rows.min(axis=0), rows.max(axis=0), centroids).tolist())
        square = ((rows[:, None] - centroids) ** 2).sum(axis=2)
        for r in square:
            assert set(np.flatnonzero(r == r.min()).tolist()) <= some
        left_out += 12 - len(some)
        near, distance = clusters.assign(rows, rows.min(axis=0), rows.max(axis=0), centroids)
        assert (near == square.argmin(axis=1)).all() and (distance == square.min(axis=1)).all()
    assert left_out > 300 * 6


@pytest.mark.parametrize("k", [1, 6, 1000])
def test_clusters_equal_plain_rounds(odd, k):
    found, centroids, sums = clusters.cluster(odd, k=k, rounds=3, scale=256, dimension=4)
    rows = [(r["vec_id"], r["embedding"]) for r in odd.collect()]
    kept = [(i, plain_integers(v, 256)) for i, v in rows if is_whole(v) and len(v) == 4]
    digest = lambda i: (i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "")
    want = [x for _, x in sorted(kept, key=lambda r: (digest(r[0]), r[1]))][:k]
    for _ in range(3):
        want = moved([x for _, x in kept], want)
    assert centroids.tolist() == want
    near = sorted(((i if i is not None else -1, c, d) for i, x in kept for d, c in [nearest(x, want)]))
    got = [(r["key"] if r["key"] is not None else -1, r["cluster"], r["distance"]) for r in found.collect()]
    assert sorted(got) == near
    assert {c: (n, d) for c, (n, d, _) in sums.items()} == {
        c: (sum(x == c for _, x, _ in near), sum(d for _, x, d in near if x == c)) for c in {c for _, c, _ in near}
    }


def test_search_measures_few_entries_and_finds_the_nearest():
    rng = np.random.default_rng(3)
    middles = rng.integers(-4000, 4000, (32, 16))
    entries = (middles[:, None] + rng.integers(-60, 60, (32, 8, 16))).reshape(-1, 16)
    book = vector_codes.Codebook(entries)
    x = entries[rng.integers(0, 256, 3000)] + rng.integers(-30, 30, (3000, 16))
    near, square, measured = book.search(x)
    every = ((x[:, None] - entries) ** 2).sum(axis=2)
    assert (near == every.argmin(axis=1)).all() and (square == every.min(axis=1)).all()
    assert measured < 3000 * 256 * 0.35
    for scale in (1, 3, 1 << 22, 1 << 27):  # copies among the entries and ties; numbers beyond a double's
        entries = rng.integers(-2, 3, (50, 3)) * scale
        x = rng.integers(-3, 4, (200, 3)) * scale
        every = ((x[:, None] - entries) ** 2).sum(axis=2)
        near, square, _ = vector_codes.Codebook(entries).search(x)
        assert (near == every.argmin(axis=1)).all() and (square == every.min(axis=1)).all()
    one = vector_codes.Codebook(np.array([[1, 2]])).search(np.array([[3, 4], [1, 2]]))
    assert one[0].tolist() == [0, 0] and one[1].tolist() == [8, 0]


@pytest.mark.parametrize("entries", [1, 9, 256])
def test_codes_equal_plain_rounds(odd, entries):
    codes, books = vector_codes.compress(odd, parts=2, entries=entries, rounds=2, scale=8)
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in odd.collect()]
    kept = [(i, plain_integers(v, 8), label) for i, v, label in rows if is_whole(v)]
    fit = [r for r in kept if len(r[1]) == 4]
    first = [x for _, x, _ in sorted(fit, key=lambda r: (r[0] is None, r[0] or 0, r[1]))][:entries]
    want = [[x[:2] for x in first], [x[2:] for x in first]]
    for _ in range(2):
        want = [moved([x[a : a + 2] for _, x, _ in fit], want[a // 2]) for a in (0, 2)]
    assert [b.tolist() for b in books] == want
    expected = []
    for i, x, label in kept:
        if len(x) == 4:
            (d0, e0), (d1, e1) = nearest(x[:2], want[0]), nearest(x[2:], want[1])
            expected.append((str(i), str(label), f"{e0:02x}{e1:02x}", d0 + d1))
        else:
            expected.append((str(i), str(label), "", -1))
    got = codes.collect()
    assert sorted(
        (str(r["key"]), str(r["label"]), r["code"] or "", -1 if r["error"] is None else r["error"]) for r in got
    ) == sorted(expected)
    totals = {}
    for r in got:
        totals[r["label"]] = totals.get(r["label"], 0) + (r["error"] or 0)
    for most in (vector_codes.BROADCAST_LABELS, 0):
        vector_codes.BROADCAST_LABELS, kept_limit = most, vector_codes.BROADCAST_LABELS
        try:
            summed = vector_codes.with_label_errors(codes).collect()
        finally:
            vector_codes.BROADCAST_LABELS = kept_limit
        assert len(summed) == len(got) and all((r["label_error"] or 0) == totals[r["label"]] for r in summed)
    back = vector_codes.decode(codes, books, scale=8).where("code is not null").first()
    numbers = bytes.fromhex(back["code"])
    assert np.allclose(back["vector"], [(v + 0.5) / 8 for p in (0, 1) for v in want[p][numbers[p]]])


def test_empty_tables(odd):
    none = odd.limit(0)
    assert clusters.cluster(none)[0].collect() == [] and vector_codes.compress(none)[0].collect() == []
    short = odd.where("vec_id = 1005")
    assert [tuple(r) for r in vector_codes.compress(short)[0].collect()] == [(1005, 1, None, None)]


@pytest.mark.parametrize("name", ["op12_centroid_clustering", "op13_vector_codes"])
def test_queries_equal_their_sql(name, spark, sf):
    frame, sql = registry.queries()[name](spark, sf), registry.oracle_sql()[name]
    names = sorted(frame.columns)
    assert sorted(views(sf).sql(sql).columns) == names
    assert rows_of_frame(frame, names) == rows_of_sql(views(sf), sql, names)
    assert frame.count() == table(spark, sf, "embeddings").where(F.size("embedding") == 64).count()
