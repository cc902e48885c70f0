"""Vector code compression: product codes whose nearest entries are found by Orchard search.

A vector is cut into consecutive parts; each part position has a codebook of its own, and a part is coded by the
number of its nearest entry. For every entry of a codebook the others are listed by their distance from it. A search
holds a current entry and goes down its list; an entry nearer to the part takes over and its list is gone down from
the top, entries that were measured are marked and skipped, and the search stops at the first list entry beyond twice
the current distance: by the triangle inequality no further one is nearer. All parts of a slice search in lockstep, a
few list entries a step; each measures only what its own search asks for.

Codebooks are fitted in rounds over a written table of integer vectors; tasks give counts and sums of their entries,
so the codebooks' own size reaches the driver, whatever the number of vectors.

Arithmetic is in integers: components are floor(scale * x), entries move to floor(sum / count), unused ones stay.
Defined results: vectors that are null or hold null or non-finite components are left out; components beyond 2^27
are held there. Vectors of another length than that of the smallest kept key, or of one that the parts don't divide,
get a null code and a null error. Fewer vectors than entries make fewer entries. Rows that repeat a key are vectors of
their own; null keys come last among the first entries. Sums of a label beyond a long raise. An empty table stays
empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.llm.vectors import group_sums, integers, matrix, products, summed, whole
from tremora.session import cut

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Vectors that search together, list entries that a step looks at, and entries a search begins with.
TOGETHER = 1024
STEP = 16
OPENING = 16
#: Tables of label sums up to this many rows are broadcast; beyond it labels are joined with salt.
BROADCAST_LABELS = 100_000
SALTS = 16


class Codebook:
    """Entries of one part position with the list of the others for each, by distance, then number."""

    def __init__(self, entries: np.ndarray):
        m = len(entries)
        self.entries = entries
        square = (entries * entries).sum(axis=1)
        gap = square[:, None] - 2 * products(entries, entries) + square
        rows = np.arange(m)
        order = np.lexsort((np.broadcast_to(rows, (m, m)), gap), axis=1)
        order = order[order != rows[:, None]].reshape(m, m - 1)
        width = -(-m // STEP) * STEP  # whole steps: what is behind the list's end is no entry, beyond any distance
        near, far = np.full((m, width), m), np.full((m, width), np.iinfo(np.int64).max)
        near[:, : m - 1] = order
        far[:, : m - 1] = np.take_along_axis(gap, order, axis=1)
        # by entry and step, so that a step of a list is one run of memory
        self.near, self.gap = near.reshape(m, -1, STEP), far.reshape(m, -1, STEP)
        self.listed = np.vstack([entries, np.zeros((1, entries.shape[1]), dtype=np.int64)])[self.near]
        self.squares = np.append(square, 0)[self.near]
        self.exact: dict[type, np.ndarray] = {}
        self.square = square
        self.opening = np.arange(0, m, max(m // OPENING, 1))

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(nearest entry, squared distance, entries measured) of each part; ties go to the lower number."""
        n, m = len(x), len(self.entries)
        own = (x * x).sum(axis=1)
        most = max(int(np.abs(x).max(initial=0)), int(np.abs(self.entries).max(initial=0)))
        exact = np.float32 if most * most * x.shape[1] < 1 << 24 else float if most * most * x.shape[1] < 1 << 53 else int
        parts = x.astype(exact)[:, :, None]
        if exact not in self.exact:
            self.exact = {exact: self.listed.astype(exact)}
        listed = self.exact[exact]
        first = own[:, None] - 2 * products(x, self.entries[self.opening]) + self.square[self.opening]
        at = np.argmin(first, axis=1)
        best, distance = self.opening[at], first[np.arange(n), at]
        seen = np.zeros((n, m + 1), dtype=bool)
        seen[:, self.opening] = True
        measured = n * len(self.opening)
        step = np.zeros(n, dtype=np.int64)
        going = np.arange(n)
        while len(going):
            current, at = best[going], step[going]
            near = self.near[current, at]
            inside = self.gap[current, at] <= 4 * distance[going, None]
            place = near + going[:, None] * (m + 1)
            marks = seen.ravel()[place]
            asked = inside & ~marks
            seen.ravel()[place] = marks | inside
            measured += int(asked.sum())
            found = np.matmul(listed[current, at], parts[going])[:, :, 0].astype(np.int64)
            square = np.where(asked, own[going, None] - 2 * found + self.squares[current, at], np.iinfo(np.int64).max)
            low = square.min(axis=1)
            number = np.where(square == low[:, None], near, m).min(axis=1)
            better = (low < distance[going]) | ((low == distance[going]) & (number < best[going]))
            moved = going[better]
            best[moved], distance[moved], step[moved] = number[better], low[better], 0
            step[going[~better]] += 1
            ended = ~better & (~inside[:, -1] | (step[going] >= self.near.shape[1]))
            going = going[~ended]
        return best, distance, measured


def integer_vectors(rows: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """(key, label, x) of the whole vectors."""
    own = rows.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("x"))
    return own.where(whole(F.col("x"))).withColumn("x", integers(F.col("x"), scale))


def first_books(vectors: DataFrame, parts: int, entries: int) -> list[np.ndarray] | None:
    """The parts of the vectors of the smallest keys, one array for each position; None if no vector can be cut so."""
    order = (F.col("key").asc_nulls_last(), F.col("x"))
    first = vectors.orderBy(*order).select(F.size("x")).first()
    if first is None or not first[0] or first[0] % parts:
        return None
    rows = vectors.where(F.size("x") == first[0]).orderBy(*order).select("x").limit(entries).collect()
    return np.split(np.array([r["x"] for r in rows], dtype=np.int64), parts, axis=1)


def _slices(x: np.ndarray) -> Iterator[np.ndarray]:
    for at in range(0, len(x), TOGETHER):
        yield x[at : at + TOGETHER]


def fit_round(vectors: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks whose entries stand in the middle of their parts."""
    width, lengths = books[0].shape[1], [len(b) for b in books]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Codebook(b) for b in books]
        counts = [np.zeros(n, dtype=np.int64) for n in lengths]
        sums = [np.zeros((n, width), dtype=np.int64) for n in lengths]
        for batch in batches:
            if not batch.num_rows:
                continue
            for x in _slices(matrix(batch.column(0))):
                for p, part in enumerate(np.split(x, len(books), axis=1)):
                    n, total = group_sums(search[p].search(part)[0], lengths[p], part)
                    counts[p] += n
                    sums[p] += total
        for p, n in enumerate(counts):
            held = np.flatnonzero(n)
            yield pa.record_batch(
                [
                    pa.array(np.full(len(held), p), pa.int32()),
                    pa.array(held, pa.int32()),
                    pa.array(n[held], pa.int64()),
                    pa.array(list(sums[p][held]), pa.list_(pa.int64()))
                ],
                names=["part", "entry", "n", "sums"]
            )

    found = vectors.select("x").mapInArrow(partial, "part int, entry int, n long, sums array<long>")
    moved = [b.copy() for b in books]
    for (p, e), (n, total) in summed(found, ["part", "entry"], width).items():
        moved[p][e] = [s // n for s in total]
    return moved


def coded(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(key, label, code, error): the numbers of the nearest entries, two hex digits each, and the squared error."""
    length = sum(b.shape[1] for b in books)
    label = vectors.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Codebook(b) for b in books]
        for batch in batches:
            n = batch.num_rows
            code, error = np.zeros((n, len(books)), dtype=np.uint8), np.zeros(n, dtype=np.int64)
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            fits = np.flatnonzero(sizes == length)
            if len(fits):
                x = matrix(batch.column(2).take(pa.array(fits)))
                for at in range(0, len(x), TOGETHER):
                    own = fits[at : at + TOGETHER]
                    for p, part in enumerate(np.split(x[at : at + TOGETHER], len(books), axis=1)):
                        entry, square, _ = search[p].search(part)
                        code[own, p] = entry
                        error[own] += square
            other = sizes != length
            digits = [None if o else c.tobytes().hex() for o, c in zip(other.tolist(), code, strict=True)]
            yield pa.record_batch(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(digits, pa.string()),
                    pa.array(error, pa.int64(), mask=other)
                ],
                names=["key", "label", "code", "error"]
            )

    return vectors.select("key", "label", "x").mapInArrow(run, f"key long, label {label}, code string, error long")


def compress(
    rows: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE
) -> tuple[DataFrame, list[np.ndarray]]:
    """((key, label, code, error) of every kept vector, codebooks)."""
    vectors = cut(integer_vectors(rows, key, vector, label, scale), "vectors")
    books = first_books(vectors, parts, entries)
    if books is None:
        none = F.lit(None)
        return vectors.select("key", "label", none.cast("string").alias("code"), none.cast("long").alias("error")), []
    usable = vectors.where(F.size("x") == sum(b.shape[1] for b in books))
    for _ in range(rounds):
        books = fit_round(usable, books)
    return coded(vectors, books), books


def decode(codes: DataFrame, books: list[np.ndarray], scale: int = SCALE, into: str = "vector") -> DataFrame:
    """Add the vectors that codes stand for: the middles of the entries' cells."""

    @F.arrow_udf("array<float>")
    def vectors(column: pa.Array) -> pa.Array:
        out = []
        for code in column.to_pylist():
            numbers = bytes.fromhex(code) if code else b""
            out.append(
                np.concatenate([(b[i] + 0.5) / scale for b, i in zip(books, numbers, strict=True)]).astype(np.float32)
                if code
                else None
            )
        return pa.array(out, pa.list_(pa.float32()))

    return codes.withColumn(into, vectors(F.col("code")))


def with_label_errors(codes: DataFrame) -> DataFrame:
    """Add the sum of the errors of equal labels; a label may hold any share of the rows."""
    sums = cut(
        codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "__label"), "labels"
    )
    same = F.col("label").eqNullSafe(F.col("__label"))
    if sums.count() <= BROADCAST_LABELS:
        return codes.join(F.broadcast(sums), same).drop("__label")
    salted = codes.withColumn("__salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    every = sums.withColumn("__other", F.explode(F.array(*(F.lit(i).cast("long") for i in range(SALTS)))))
    return salted.join(every, same & (F.col("__salt") == F.col("__other"))).drop("__label", "__salt", "__other")


def _sql() -> str:
    """The rounds written out, one after the other."""
    dot, width = "list_dot_product", 64 // PARTS
    parts = [
        f"""v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS x FROM embeddings
WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))""",
        f"""p AS MATERIALIZED (SELECT vec_id, part, x[part * {width} + 1 : part * {width} + {width}] AS x FROM v, (SELECT unnest(range({PARTS})) AS part))""",
        f"""c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x FROM p QUALIFY e < {ENTRIES})"""
    ]
    for i in range(ROUNDS + 1):
        parts.append(
            f"a{i} AS MATERIALIZED (SELECT vec_id, p.part, any_value(p.x) AS x, min(struct_pack(d := {dot}(p.x, p.x) - 2 * {dot}(p.x, c.x) + {dot}(c.x, c.x), e := e)) AS m FROM p JOIN c{i} c ON c.part = p.part GROUP BY vec_id, p.part)"
        )
        if i < ROUNDS:
            parts.append(
                f"""c{i + 1} AS MATERIALIZED (WITH s AS (SELECT part, m.e AS e, unnest(range({width})) AS pos, unnest(x) AS x FROM a{i}), f AS (SELECT part, e, pos, floor(sum(x) / count(*)) AS x FROM s GROUP BY ALL),
n AS (SELECT part, e, list(x ORDER BY pos) AS x FROM f GROUP BY part, e) SELECT c{i}.part, c{i}.e, coalesce(n.x, c{i}.x) AS x FROM c{i} LEFT JOIN n ON n.part = c{i}.part AND n.e = c{i}.e)"""
            )
    return f"""WITH {", ".join(parts)}, k AS (SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id),
b AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, e)) AS h FROM c{ROUNDS})
SELECT k.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT h FROM b) AS codebooks_sha256 FROM k JOIN v ON v.vec_id = k.vec_id"""


OP13_SQL = _sql()


def op13_vector_codes(spark, sf_dir):
    """Codes and errors of ``embeddings``, errors by label and the digest of the codebooks."""
    from tremora.session import table

    codes, books = compress(table(spark, sf_dir, "embeddings"))
    numbers = ",".join(str(v) for book in books for v in book.ravel().tolist())
    return with_label_errors(cut(codes, "codes")).select(
        F.col("key").alias("vec_id"),
        "code",
        "error",
        "label_error",
        F.lit(hashlib.sha256(numbers.encode()).hexdigest()).alias("codebooks_sha256")
    )
