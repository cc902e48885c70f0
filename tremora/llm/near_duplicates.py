"""Near duplicates: universal hash minima, banding, signature verification, star-contracted components.

Texts with the same words are one class, represented by its smallest key. Representatives get
BANDS * ROWS minima of their distinct shingles; documents whose minima agree on a whole band share a bucket.
Every member of a bucket is compared with the bucket's first; links that pass the signature check are
confirmed on full shingle sets, and components follow by alternating large-star and small-star. Buckets
that still hold several components are then searched again: each member outside the bucket's largest
component against all members of other components, so that no candidate pair between components stays
untried, while pairs within a component are never listed; longer signatures decide there which pairs are worth
a full comparison. A link of similarity THRESHOLD shares no band
with a probability of 5e-6; the signature check drops less than one such link in ten million.

Defined results: a text without words has no shingles and no links; one of fewer words than a shingle
has its whole sequence as the only one. Rows with one key count as one document. Rows without key belong
to the component of their text's class and are not kept where that has a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremora.llm.textscan import U, Words, column_of, mix, shingle_hashes, slices, text_buffers
from tremora.session import cut, forget

WIDTH = 5
BANDS, ROWS = 32, 4
THRESHOLD = 75
#: Of 128 bits, one from each minimum, those that must agree: documents of similarity 0.75 agree in 112 on average,
#: with a deviation of 3.7.
LEAST_BITS = 92
SEED = 77
#: The second search compares one bit of each of LONG minima: links agree in 1792 on average, with a deviation of 15;
#: fewer agree in one of 300,000.
LONG = 2048
LEAST_LONG = 1724
#: Sets of keys up to this size are broadcast, larger ones are joined by shuffle.
BROADCAST_KEYS = 1 << 18


def shingle_sets(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, Words]:
    """(hashes, rows) of the distinct shingles of each text, in order of rows."""
    data, offsets = text_buffers(column)
    words = Words(data, offsets, lower=True)
    grams = shingle_hashes(words.hash, width)
    own = words.doc[: len(grams)]
    whole = np.flatnonzero(own == words.doc[width - 1 :]) if len(grams) else np.zeros(0, dtype=np.int64)
    few = np.flatnonzero((words.count > 0) & (words.count < width))
    single = [
        shingle_hashes(words.hash[words.first[r] : words.first[r] + words.count[r]], int(words.count[r]))[0]
        for r in few
    ]
    hashes = np.concatenate((grams[whole], np.array(single, dtype=U)))
    rows = np.concatenate((own[whole], few))
    _, first = np.unique(mix(hashes + rows.astype(U) * U(0x9E3779B97F4A7C15)), return_index=True)
    first = first[np.argsort(rows[first], kind="stable")]
    return hashes[first], rows[first], words


def _parameters(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED + n)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * U(2) + U(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def minima(hashes: np.ndarray, rows: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """The least of each of n universal hashes over each row's shingles; rows must be ordered."""
    starts = np.flatnonzero(
        np.concatenate(([True], rows[1:] != rows[:-1]))
    ) if len(rows) else np.zeros(0, dtype=np.int64)
    out = np.zeros((n, len(starts)), dtype=np.uint32)
    if not len(starts):
        return out
    room = np.empty_like(hashes)
    for i, (a, b) in enumerate(zip(*_parameters(n), strict=True)):
        np.multiply(hashes, a, out=room)
        room += b
        np.right_shift(room, U(32), out=room)
        out[i] = np.minimum.reduceat(room, starts)
    return out


def low_bits(least: np.ndarray) -> np.ndarray:
    """The lowest bit of each minimum: a row of 64-bit integers for each document."""
    return np.packbits(
        (least & 1).astype(np.uint8), axis=0, bitorder="little"
    ).T.copy().view(U).reshape(least.shape[1], -1)


def band_hashes(least: np.ndarray) -> np.ndarray:
    """A hash of each band of minima and its number: a row for each document."""
    out = np.zeros((least.shape[1], BANDS), dtype=U)
    for b in range(BANDS):
        value = np.full(least.shape[1], b, dtype=U)
        for r in range(ROWS):
            value = mix(value * U(0x2545F4914F6CDD1D) + least[b * ROWS + r])
        out[:, b] = value
    return out


SIGNED = "doc long, n long, d1 long, d2 long, s1 long, s2 long, bands array<long>"


def signed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: number of shingles, digest of the words, bits of the minima, hashes of the bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                hashes, rows, words = shingle_sets(column_of(part, "t"))
                total = part.num_rows
                n = np.bincount(rows, minlength=total)
                full = np.flatnonzero(n)
                least = minima(hashes, rows)
                digest = np.zeros((2, total), dtype=U)
                if len(words.start):
                    begin = words.first[full]
                    position = np.arange(len(words.start)) - np.repeat(begin, words.count[full])
                    for k in range(2):
                        digest[k, full] = np.add.reduceat(
                            mix(words.hash ^ mix(position.astype(U) * U(2) + U(k))), begin
                        )
                bits = low_bits(least)
                sketch = np.zeros((2, total), dtype=U)
                sketch[:, full] = bits.T
                sizes = np.zeros(total + 1, dtype=np.int32)
                np.cumsum((n > 0) * BANDS, out=sizes[1:])
                columns = [
                    column_of(part, "k"),
                    pa.array(n),
                    *(pa.array(x.view(np.int64)) for x in (digest[0], digest[1], sketch[0], sketch[1])),
                    pa.ListArray.from_arrays(pa.array(sizes), pa.array(band_hashes(least).ravel().view(np.int64)))
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "n", "d1", "d2", "s1", "s2", "bands"])

    return docs.select(
        F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")
    ).mapInArrow(sign, SIGNED)


@F.arrow_udf(T.BooleanType())
def similar(left: pa.Array, right: pa.Array) -> pa.Array:
    """Whether the full shingle sets of two texts reach the threshold."""
    out, at = [], 0
    sizes = pa.record_batch([left, right], names=["x", "y"])
    for part in slices(sizes, "x", 256 << 10):
        for own in slices(part, "y", 256 << 10):
            (ha, ra, _), (hb, rb, _) = shingle_sets(own.column(0)), shingle_sets(own.column(1))
            total = own.num_rows
            spread = U(0x9E3779B97F4A7C15)
            common = ra[np.isin(mix(ha + ra.astype(U) * spread), mix(hb + rb.astype(U) * spread))]
            both = np.bincount(common, minlength=total)
            either = np.bincount(ra, minlength=total) + np.bincount(rb, minlength=total) - both
            out.append(pa.array((100 * both >= THRESHOLD * either) & (either > 0)))
            at += total
    return pa.concat_arrays(out) if out else pa.array([], pa.bool_())


def _alike(s1: str, s2: str, n: str, t1: str, t2: str, m: str):
    """The signature check, and the bound that sizes set on similarity."""
    differ = F.bit_count(F.col(s1).bitwiseXOR(F.col(t1))) + F.bit_count(F.col(s2).bitwiseXOR(F.col(t2)))
    return (differ <= 128 - LEAST_BITS) & (F.least(n, m) * 100 >= F.greatest(n, m) * THRESHOLD)


def only(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose k is among ``keys``."""
    keys = cut(keys, "keys")
    return texts.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, "k", "left_semi")


def long_bits(texts: DataFrame) -> DataFrame:
    """(doc, l0, l1, ..., bands): a bit of each of LONG minima and the hashes of the bands, for rows (k, t)."""
    names = [f"l{i}" for i in range(LONG // 64)]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t", 64 << 10):
                hashes, rows, _ = shingle_sets(column_of(part, "t"))
                bits = low_bits(minima(hashes, rows, LONG))
                keys = column_of(part, "k").take(pa.array(np.unique(rows)))
                bands = band_hashes(minima(hashes, rows))
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(bands) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel().view(np.int64))
                )
                yield pa.RecordBatch.from_arrays(
                    [keys, *(pa.array(np.ascontiguousarray(b).view(np.int64)) for b in bits.T), lists],
                    names=["doc", *names, "bands"]
                )

    return texts.mapInArrow(sign, "doc long, " + ", ".join(f"{n} long" for n in names) + ", bands array<long>")


def confirmed(pairs: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """The pairs (a, b) whose texts are similar on their full shingle sets."""
    ends = pairs.select(F.col("a").alias("k")).union(pairs.select(F.col("b").alias("k"))).distinct()
    texts = only(docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")), ends)
    left = pairs.join(texts.select(F.col("k").alias("a"), F.col("t").alias("ta")), "a")
    both = left.join(texts.select(F.col("k").alias("b"), F.col("t").alias("tb")), "b")
    return both.where(similar("ta", "tb")).select("a", "b").distinct()


#: Edges in a partition of the tables that the search for components writes.
EDGES_PER_PART = 50_000


def components(links: DataFrame) -> DataFrame:
    """(doc, component) of every linked document by alternating large-star and small-star; ``links`` has a and b."""
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    parts = links.count() // EDGES_PER_PART + 1  # neither step adds edges beyond twice their number
    edges = cut(links.distinct().coalesce(parts), "edges")
    while not _is_star(edges):
        # large star: every larger neighbour is tied to the least of the neighbourhood
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(
            F.col("b").alias("a"), F.col("m").alias("b")
        ).where("a <> b").distinct()
        large = cut(large.coalesce(parts), "edges")
        # small star: smaller neighbours and the document itself are tied to the least
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(
            F.col("b").alias("a"), F.col("m").alias("b")
        ).union(least.select("a", F.col("m").alias("b")))
        edges = cut(small.distinct().coalesce(parts), "edges")
    return edges.select(F.col("a").alias("doc"), F.col("b").alias("component"))


def _is_star(edges: DataFrame) -> bool:
    """Whether every document has one edge to a centre that has none of its own."""
    sizes = edges.agg(F.count("*").alias("n"), F.count_distinct("a").alias("d")).first()
    return sizes["n"] == sizes["d"] and edges.join(
        edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi"
    ).isEmpty()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row."""
    base = cut(signed(docs, key, text), "signed")
    some = base.where("n > 0")
    classes = some.groupBy("d1", "d2").agg(F.min("doc").alias("rep"))
    firsts = some.join(classes, ["d1", "d2"]).where("doc = rep").select("doc", "n", "s1", "s2", "bands")
    firsts = cut(firsts.dropDuplicates(["doc"]), "firsts")
    # only keys are dealt by bucket; what shares one gets its signature afterwards
    bands = firsts.select("doc", F.posexplode("bands").alias("band", "bucket"))
    leads = bands.groupBy("bucket").agg(F.min("doc").alias("first"), F.count("*").alias("size")).where("size > 1")
    shared = cut(bands.join(cut(leads, "leads"), "bucket"), "shared")
    signatures = firsts.select("doc", "n", "s1", "s2")
    lead = signatures.select(F.col("doc").alias("first"), F.struct("doc", "n", "s1", "s2").alias("lead"))
    grouped = cut(
        shared.join(signatures, "doc").join(lead, "first").select(
            "bucket", "band", "size", "doc", "n", "s1", "s2", "lead"
        ),
        "grouped"
    )
    forget(shared)
    star = grouped.select(
        "doc",
        "n",
        "s1",
        "s2",
        F.col("lead.doc").alias("b"),
        F.col("lead.n").alias("m"),
        F.col("lead.s1").alias("t1"),
        F.col("lead.s2").alias("t2")
    )
    star = star.where(
        (F.col("doc") != F.col("b")) & _alike("s1", "s2", "n", "t1", "t2", "m")
    ).select(F.col("doc").alias("a"), "b").distinct()
    links = cut(confirmed(star, docs, key, text), "links")
    found = components(links)

    more = cut(between_components(grouped, found, docs, key, text), "pairs")
    if not more.isEmpty():
        again = cut(confirmed(more, docs, key, text), "links")
        if not again.isEmpty():
            found = components(found.select(F.col("doc").alias("a"), F.col("component").alias("b")).union(again))
    named = base.select("doc", "n", "d1", "d2").join(classes, ["d1", "d2"], "left").join(
        found.withColumnRenamed("doc", "rep"), "rep", "left"
    )
    component = F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc"))
    out = named.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.col("component_id").isNull()))


def mixed_buckets(grouped: DataFrame, found: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, with the bucket's largest component as ``main``."""
    held = grouped.where("size > 2").select(
        "bucket", "band", "doc", "n", "s1", "s2", F.col("lead.doc").alias("lead")
    ).join(found, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    parts = held.groupBy("bucket", "component").agg(F.count("*").alias("c"))
    main = parts.groupBy("bucket").agg(
        F.max(F.struct("c", "component")).alias("main"), F.count("*").alias("parts")
    ).where("parts > 1").select("bucket", F.col("main.component").alias("main"))
    return cut(held.join(main, "bucket"), "mixed")


def between_components(grouped: DataFrame, found: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Untried pairs (a, b) of buckets that hold several components, as far as their long signatures agree."""
    mixed = mixed_buckets(grouped, found)
    texts = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    bits = cut(long_bits(only(texts, mixed.select(F.col("doc").alias("k")).distinct())), "bits")
    mixed = mixed.join(bits, "doc")
    names = [c for c in bits.columns if c.startswith("l")]
    other = mixed.select(
        "bucket", *(F.col(c).alias(f"o_{c}") for c in ("doc", "n", "s1", "s2", "component", "bands", *names))
    )
    untried = (F.col("component") != F.col("o_component")) & (F.col("o_doc") != F.col("lead")) & (
        (F.col("o_component") == F.col("main")) | (F.col("doc") < F.col("o_doc"))
    )
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"o_{c}"))) for c in names), F.lit(0))
    # a pair that shares several buckets belongs to the first of them
    earlier = F.arrays_overlap(F.slice("bands", F.lit(1), F.col("band")), F.slice("o_bands", F.lit(1), F.col("band")))
    same = [
        F.col("bucket") == F.col("o_bucket"),
        untried,
        _alike("s1", "s2", "n", "o_s1", "o_s2", "o_n"),
        (differ <= LONG - LEAST_LONG) & ~earlier
    ]
    pairs = mixed.where("component <> main and doc <> lead").join(
        other.withColumnRenamed("bucket", "o_bucket"), same[0] & same[1] & same[2] & same[3]
    )
    return pairs.select(F.greatest("doc", "o_doc").alias("a"), F.least("doc", "o_doc").alias("b")).distinct()


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of the input without those of a group other than its first."""
    dropped = near_duplicates(docs, key, text).where(
        ~F.col("kept") & F.col(key).isNotNull()
    ).select(F.col(key).alias("__key")).distinct()
    return docs.join(dropped, docs[key].cast("long") == F.col("__key"), "left_anti")


def op9_minhash_near_dedup(spark, sf_dir):
    """Components of near duplicates among all ``documents``."""
    from tremora.session import table

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
