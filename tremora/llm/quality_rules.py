"""Quality rules: fixed limits on counts, then n-gram perplexity within bands of each language.

The language model is an interpolated modified Kneser-Ney model over UTF-8 bytes, ORDER of them at a time, one model
for each language. Spark counts the n-grams of all texts (each task sends its distinct n-grams once) and, from them,
those of all shorter orders; nothing is cut off, and the corpus decides how large a model is. The orders up to LOW
(65,792 n-grams at most) are one file for each language. Longer n-grams lie in files dealt by the two bytes before
their last one, so that an n-gram, its contexts and all that it backs off to meet in one task. Files are sorted arrays
in the shared folder; workers load those that they meet. Any number of languages may occur.

A text's score leaves out what the model learned from that text: an n-gram or a context that no other text holds counts
as unseen (texts that are equal are one). The perplexity is that of the whole model.

A text is scored in segments of about SEGMENT bytes: the mean negative log-probability of each, in deviations from
what the model gives its language's n-grams. A segment that its own language doesn't explain takes the score of the language
that explains it best, so a quotation from another language is no junk. The score of the text is the median of its
segments: junk is junk throughout, while a clean text may hold a passage of anything. A document is rejected if its
score is further from its language's median than a multiple of the median absolute deviation, above or below.

Defined results: a null text is empty; a null language is a language of its own. Documents that fail the fixed limits
are not kept and do not shape the bands. Empty tables give no rows. Repeated rows count each.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremora.llm.files import Written, list_files, open_read
from tremora.llm.statistics import base_counts
from tremora.llm.textscan import U, array_slices, column_of, slices, text_buffers
from tremora.session import cut, forget, scratch

ORDER = 5
LOW = 2
#: Distinct n-grams in a file, about.
PART_GRAMS = 500_000
#: The two bytes before the last, times this, modulo the files of the language, are the number of a file.
MIX = 40_503
SEGMENT = 64
#: A segment so many deviations above its own language's mean is compared with the other languages.
FOREIGN = 3.0
ABOVE, BELOW = 8.0, 10.0
#: Deviations are taken as so much at least, and as so many times more where a language has only so many texts.
LEAST_DEVIATION, FEW = 0.05, 10
#: Band tables up to this many languages are broadcast, larger ones are joined by shuffle.
BROADCAST_LANGUAGES = 100_000
#: Bytes of models that a worker keeps.
LOADED_BYTES = 64 << 20
SCORES = ("score", "short_score")
LIMITS = ("low", "high", "short_low", "short_high")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Key of the n-gram that ends at each byte. Line feeds stand before each text."""
    pad = ORDER - 1
    padded = np.insert(data, np.repeat(offsets[:-1], pad), 0x0A).astype(U)
    key = np.zeros(len(padded), dtype=U)
    for k in range(ORDER):
        key[pad:] |= padded[k : len(padded) - pad + k] << U(8 * (pad - k))
    keep = np.ones(len(padded), dtype=bool)
    keep[(offsets[:-1] + pad * np.arange(len(offsets) - 1))[:, None] + np.arange(pad)[None, :]] = False
    return key[keep]


def _below(n: int) -> int:
    return (1 << 8 * n) - 1


def _counted(
    keys: np.ndarray, counts: np.ndarray, first: np.ndarray, last: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, their counts, and the least and greatest text of each."""
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
    if not len(at):
        return keys, counts, first, last
    return (
        keys[at],
        np.add.reduceat(counts[order], at),
        np.minimum.reduceat(first[order], at),
        np.maximum.reduceat(last[order], at)
    )


def count_grams(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(l, k, c, a, z) for each distinct n-gram of each language: its count, and the least and greatest digest of the
    texts that hold it, which are equal if it is one text.
    """
    names = ["l", "k", "c", "a", "z"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages: dict[str | None, int] = {}
        held: list[tuple] = []
        waiting = 0

        def sent(own: np.ndarray, *rest: np.ndarray) -> pa.RecordBatch:
            code = pa.array((own >> U(8 * ORDER)).astype(np.int32))
            listed = pa.array(list(languages) or [""], pa.string())
            return pa.RecordBatch.from_arrays(
                [listed.take(code), pa.array((own & U(_below(ORDER))).astype(np.int64)), *map(pa.array, rest)],
                names=names
            )

        for batch in batches:
            for part in slices(batch, "t"):
                data, offsets = text_buffers(column_of(part, "t"))
                code = np.array(
                    [languages.setdefault(x, len(languages)) for x in column_of(part, "l").to_pylist()], dtype=np.int64
                )
                size = np.diff(offsets)
                digest = np.repeat(column_of(part, "d").to_numpy(zero_copy_only=False), size)
                keys = grams(data, offsets) | np.repeat(code.astype(U) << U(8 * ORDER), size)
                held.append(_counted(keys, np.ones(len(keys), dtype=np.int64), digest, digest))
                waiting += len(held[-1][0])
                if waiting > 2_000_000:
                    held = [_counted(*map(np.concatenate, zip(*held, strict=True)))]
                    waiting = len(held[0][0])
                    if waiting > 1_000_000:
                        yield sent(*held[0])
                        held, waiting, languages = [], 0, {}
        if waiting:
            yield sent(*_counted(*map(np.concatenate, zip(*held, strict=True))))

    rows = docs.select(
        F.col(text).alias("t"), F.col(lang).cast("string").alias("l"), F.xxhash64(text).alias("d")
    ).mapInArrow(count, "l string, k long, c long, a long, z long")
    return rows.groupBy("l", "k").agg(F.sum("c").alias("c"), F.min("a").alias("a"), F.max("z").alias("z"))


def _discounts(counts: list[int]) -> list[float]:
    """Discounts of counts 0, 1, 2 and 3 or more from the numbers of n-grams seen once to four times."""
    n1, n2, n3, n4 = counts
    if not (n1 and n2 and n3):
        return [0.0, 0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return [0.0, *(min(max(d, 0.05), i - 0.05) for i, d in enumerate(found, 1))]


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _look(arrays: dict[str, np.ndarray], keys: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Natural logarithms of the probabilities of the last bytes given those before: of the whole model, and without
    n-grams and contexts of one text.
    """
    full, held = np.zeros(len(keys)), np.zeros(len(keys))
    settled = np.zeros(len(keys), dtype=bool)
    open_ = np.arange(len(keys))
    for n in range(order, 0, -1):
        own = keys[open_] & U(_below(n))
        at, hit = _find(arrays[f"k{n}"], own)
        p = arrays[f"p{n}"][at]
        new = hit & ~settled[open_]
        full[open_[new]] += p[new]
        settled[open_[new]] = True
        shared = hit & arrays[f"s{n}"][at]
        held[open_[shared]] += p[shared]
        open_, own = open_[~shared], own[~shared]
        if not len(open_):
            return full, held
        at, hit = _find(arrays[f"h{n}"], own >> U(8))
        w = np.where(hit, arrays[f"w{n}"][at], 0.0)
        new = ~settled[open_]
        full[open_[new]] += w[new]
        held[open_] += np.where(arrays[f"g{n}"][at], w, 0.0)
    full[open_[~settled[open_]]] -= np.log(256)
    held[open_] -= np.log(256)
    return full, held


def _extended(arrays: dict[str, np.ndarray], tables: dict[int, tuple]) -> dict[str, np.ndarray]:
    """The arrays with those of longer n-grams, from their sorted tables of (key, count, least text, greatest text)."""
    arrays = dict(arrays)
    for n in sorted(tables):
        k, c, first, last = tables[n]
        discount = arrays["discounts"][n - 1][np.minimum(c, 3)]
        begins = np.flatnonzero(np.append(True, (k[1:] ^ k[:-1]) >> U(8) > 0))
        group = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(k))))
        total = np.bincount(group, weights=c)
        weight = np.bincount(group, weights=discount) / total
        lower = np.exp(_look(arrays, k & U(_below(n - 1)), n - 1)[0])
        p = (c - discount) / total[group] + weight[group] * lower
        arrays |= {
            f"k{n}": k,
            f"p{n}": np.log(p),
            f"s{n}": first != last,
            f"h{n}": k[begins] >> U(8),
            f"w{n}": np.log(weight),
            f"g{n}": np.minimum.reduceat(first, begins) != np.maximum.reduceat(last, begins)
        }
    return arrays


def _tables(longest: int, least: int, table: tuple) -> dict[int, tuple]:
    """Tables of the orders down to the least: shorter n-grams count what continues them."""
    tables = {longest: table}
    for n in range(longest - 1, least - 1, -1):
        k, _, first, last = tables[n + 1]
        tables[n] = _counted(k & U(_below(n)), np.ones(len(k), dtype=np.int64), first, last)
    return tables


class Model:
    """One language: its short n-grams, and what finds the arrays of a file of longer ones."""

    def __init__(self, arrays: dict[str, np.ndarray], part: Callable[[int], dict[str, np.ndarray]]):
        self.arrays, self.part = arrays, part
        self.mean, self.deviation = arrays["scale"]
        self.parts = set(arrays["parts"].tolist())

    def both(self, keys: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities of the whole model, and without what one text alone holds."""
        keys, at = np.unique(keys.astype(U), return_inverse=True)
        full, held = np.zeros(len(keys)), np.zeros(len(keys))
        number = (keys >> U(8) & U(65535)).astype(np.int64) * MIX % int(self.arrays["n_parts"])
        by = np.argsort(number, kind="stable")
        for here in np.split(by, np.flatnonzero(np.diff(number[by])) + 1) if len(keys) else ():
            i = int(number[here[0]])
            own = (self.arrays | self.part(i), order) if i in self.parts else (self.arrays, LOW)
            full[here], held[here] = _look(own[0], keys[here], own[1])
        return full[at], held[at]

    def log_p(self, keys: np.ndarray) -> np.ndarray:
        return self.both(keys)[0]


def _name(language: str | None) -> str:
    return "none.npz" if language is None else hashlib.sha1(language.encode()).hexdigest() + ".npz"


def _store(folder: str, name: str, arrays: dict[str, np.ndarray]) -> str:
    buffer, out = io.BytesIO(), Written(folder, name)
    np.savez(buffer, **arrays)
    out.write(buffer.getvalue())
    return out.close()


def _load(path: str) -> dict[str, np.ndarray]:
    with open_read(path) as file:
        return dict(np.load(io.BytesIO(file.read())))


def train(docs: DataFrame, folder: str, text: str = "text", lang: str = "lang") -> DataFrame:
    """Count all texts and write the files of each language; (l, path, n_grams) of each. Run it once: keep what it
    returns with ``cut``.
    """
    counted = cut(count_grams(docs, text, lang), "n-grams")
    tables = {ORDER: counted}
    for n in range(ORDER - 1, LOW - 1, -1):
        tables[n] = tables[n + 1].groupBy("l", F.col("k").bitwiseAND(F.lit(_below(n))).alias("k")).agg(
            F.count("*").alias("c"), F.min("a").alias("a"), F.max("z").alias("z")
        )
    seen = [F.count_if(F.col("c") == i).alias(f"n{i}") for i in range(1, 5)]
    rows = None
    for n, t in tables.items():
        if n > LOW:
            own = t.groupBy("l").agg(F.count("*").alias("n_grams"), F.array(*seen).alias("seen"))
            own = own.withColumn("low", F.expr("cast(null as array<struct<k: long, c: long, a: long, z: long>>)"))
        else:  # 65,536 at most
            own = t.groupBy("l").agg(
                F.count("*").alias("n_grams"), F.array(*seen).alias("seen"),
                F.collect_list(F.struct("k", "c", "a", "z")).alias("low")
            )
        own = own.withColumn("n", F.lit(n))
        rows = own if rows is None else rows.union(own)
    heads = rows.groupBy("l").agg(
        F.array_sort(F.collect_list(F.struct("n", "seen"))).alias("seen"),
        F.max(F.when(F.col("n") == ORDER, F.col("n_grams"))).alias("n_grams"),
        F.max_by("low", -F.col("n")).alias("low")
    )

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                table = [np.array([x[c] for x in row["low"]], dtype=np.int64) for c in ("k", "c", "a", "z")]
                made = _tables(LOW, 1, _counted(table[0].astype(U), *table[1:]))
                numbers = [[int((made[n][1] == i).sum()) for i in range(1, 5)] for n in range(1, LOW)]
                numbers += [x["seen"] for x in row["seen"]]
                parts = row["n_grams"] // PART_GRAMS + 1
                arrays = {"discounts": np.array([_discounts(x) for x in numbers]), "n_parts": np.array(parts)}
                name = _name(row["l"])[: -len(".npz")]
                out.append((row["l"], name, _store(folder, f"{name}.head", _extended(arrays, made)), parts))
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["__l", "name", "head", "parts"]
            )

    listed = cut(heads.mapInArrow(head, "__l string, name string, head string, parts long"), "heads")
    small = F.broadcast(listed) if listed.count() <= BROADCAST_LANGUAGES else listed
    dealt = counted.join(small, F.col("l").eqNullSafe(F.col("__l"))).withColumn(
        "part", F.shiftright("k", 8).bitwiseAND(F.lit(65535)) * MIX % F.col("parts")
    ).select("l", "head", F.concat_ws(".", "name", "part").alias("f"), "k", "c", "a", "z")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            at = 0
            for f, n in _runs(column_of(batch, "f")):
                if held and column_of(held[0], "f")[0].as_py() != f:
                    yield written(held)
                    held = []
                held.append(batch.slice(at, n))
                at += n
        if held:
            yield written(held)

    def written(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        language, path, f = (rows[c][0].as_py() for c in ("l", "head", "f"))
        k, c, first, last = (rows[x].to_numpy() for x in ("k", "c", "a", "z"))
        arrays = _extended(_load(path), _tables(ORDER, LOW + 1, _counted(k.astype(U), c, first, last)))
        cost = -_look(arrays, arrays[f"k{ORDER}"], ORDER)[1]
        c = _counted(k.astype(U), c, first, last)[1]
        _store(folder, f"{f}.part", {x: v for x, v in arrays.items() if x[1:].isdigit() and int(x[1:]) > LOW})
        return pa.RecordBatch.from_pylist(
            [
                {
                    "l": language, "head": path, "part": int(f.rpartition(".")[2]), "n": len(k), "c": float(c.sum()),
                    "x": float((c * cost).sum()), "xx": float((c * cost**2).sum())
                }
            ],
            schema=pa.schema([("l", pa.string()), ("head", pa.string()), ("part", pa.int64()), ("n", pa.int64())]
                             + [(x, pa.float64()) for x in ("c", "x", "xx")])
        )

    parts = cut(
        dealt.repartition("f").sortWithinPartitions("f").mapInArrow(
            build, "l string, head string, part long, n long, c double, x double, xx double"
        ),
        "parts"
    )
    forget(counted)
    whole = parts.groupBy("l", "head").agg(
        F.collect_list("part").alias("parts"), *(F.sum(x).alias(x) for x in ("n", "c", "x", "xx"))
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                mean = row["x"] / row["c"]
                scale = np.array([mean, max(np.sqrt(max(row["xx"] / row["c"] - mean**2, 0.0)), 0.1)])
                arrays = _load(row["head"]) | {"scale": scale, "parts": np.array(row["parts"], dtype=np.int64)}
                path = _store(folder, _name(row["l"]), arrays)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["l"]], pa.string()), pa.array([path]), pa.array([row["n"]], pa.int64())],
                    names=["l", "path", "n_grams"]
                )

    return whole.mapInArrow(finish, "l string, path string, n_grams long")


def _runs(column: pa.Array) -> list[tuple[str | None, int]]:
    """Values of a sorted column and how often each stands in a row."""
    coded = column.dictionary_encode(null_encoding="encode")
    at = coded.indices.to_numpy(zero_copy_only=False)
    begins = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, dtype=np.int64)
    values = coded.dictionary.to_pylist()
    return [
        (values[at[b]], int(n))
        for b, n in zip(begins.tolist(), np.diff(np.append(begins, len(at))).tolist(), strict=True)
    ]


class Models:
    """The models of a folder, loaded when they are asked for; the least recently used files go."""

    _kept: dict[str, dict[str, np.ndarray]] = {}

    def __init__(self, folder: str):
        self.folder = folder
        self.names: list[str] | None = None

    def _file(self, name: str) -> dict[str, np.ndarray]:
        path = f"{self.folder}/{name}"
        found = self._kept.pop(path, None)
        self._kept[path] = found = _load(path) if found is None else found
        size = lambda arrays: sum(x.nbytes for x in arrays.values())
        while len(self._kept) > 1 and sum(map(size, self._kept.values())) > LOADED_BYTES:
            self._kept.pop(next(iter(self._kept)))
        return found

    def named(self, name: str) -> Model | None:
        if name not in self.all():
            return None
        return Model(self._file(name), lambda part: self._file(f"{name[: -len('.npz')]}.{part}.part"))

    def all(self) -> list[str]:
        if self.names is None:
            self.names = sorted(n for n in list_files(self.folder) if n.endswith(".npz"))
        return self.names


MEASURES = T.StructType(
    [
        *(T.StructField(c, T.LongType()) for c in COUNTS),
        T.StructField("log_perplexity", T.DoubleType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("short_score", T.DoubleType())
    ]
)


def _segments(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, row) of the segments of each text; an empty text has none."""
    size = np.diff(offsets)
    parts = np.where(size > 0, np.maximum(1, (size + SEGMENT // 2) // SEGMENT), 0)
    row = np.repeat(np.arange(len(size)), parts)
    number = np.arange(len(row)) - (np.cumsum(parts) - parts)[row]
    return offsets[row] + number * size[row] // np.maximum(
        parts[row], 1
    ), offsets[row] + (number + 1) * size[row] // np.maximum(parts[row], 1), row


def score_texts(
    data: np.ndarray, offsets: np.ndarray, languages: list[str | None], models: Models
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean negative log-probability, score, score by n-grams one byte shorter) of each text; 0 for an empty one or one
    whose language has no model.
    """
    key = grams(data, offsets)
    begin, end, row = _segments(offsets)
    code, own = np.unique([_name(x) for x in languages], return_inverse=True)
    cost = np.zeros(len(key))
    scaled = np.zeros((2, len(begin)))
    of_byte = np.repeat(own, np.diff(offsets))

    def deviations(model: Model, mean: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (mean - model.mean) / model.deviation * np.sqrt(n)

    for i, name in enumerate(code):
        if (model := models.named(name)) is None:
            continue
        here = of_byte == i
        some = own[row] == i
        n = (end - begin)[some]
        for k in (0, 1):
            full, alone = model.both(key[here], ORDER - k)
            if not k:
                cost[here] = -full
            unlearned = np.zeros(len(key))
            unlearned[here] = -alone
            total = np.concatenate(([0.0], np.cumsum(unlearned)))
            scaled[k, some] = deviations(model, (total[end[some]] - total[begin[some]]) / n, n)
    odd = np.flatnonzero(scaled[0] > FOREIGN)
    if len(odd):
        n = (end - begin)[odd]
        first = np.cumsum(n) - n
        keys = key[np.repeat(begin[odd] - first, n) + np.arange(int(n.sum()))]
        own_name = code[own[row[odd]]]
        for name in models.all():
            model = models.named(name)
            for k in (0, 1):
                found = deviations(model, np.add.reduceat(-model.both(keys, ORDER - k)[0], first) / n, n)
                # its own language learned from the text
                scaled[k, odd] = np.where(own_name == name, scaled[k, odd], np.minimum(scaled[k, odd], found))
    parts = np.bincount(row, minlength=len(languages))
    at = np.cumsum(parts) - parts
    full = np.flatnonzero(parts)
    score = np.zeros((2, len(languages)))
    for k in (0, 1):
        order = np.lexsort((scaled[k], row))
        middle = scaled[k, order[at[full] + (parts[full] - 1) // 2]] + scaled[k, order[at[full] + parts[full] // 2]]
        score[k, full] = middle / 2
    total = np.concatenate(([0.0], np.cumsum(cost)))
    size = np.diff(offsets)
    return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(size, 1), *score


def measures(folder: str, text: Column, lang: Column) -> Column:
    """Counts, mean negative log-probability and score of each text (both null for an empty one)."""

    @F.arrow_udf(MEASURES)
    def measure(texts: pa.Array, languages: pa.Array) -> pa.Array:
        models, parts, at = Models(folder), [], 0
        for part in array_slices(texts):
            counts, data, offsets, _ = base_counts(part)
            mean, score, short = score_texts(data, offsets, languages.slice(at, len(part)).to_pylist(), models)
            at += len(part)
            empty = np.diff(offsets) == 0
            parts.append(
                pa.StructArray.from_arrays(
                    [
                        *(pa.array(counts[c], pa.int64()) for c in COUNTS),
                        pa.array(mean, mask=empty),
                        pa.array(score, mask=empty),
                        pa.array(short, mask=empty)
                    ],
                    names=[f.name for f in MEASURES]
                )
            )
        kinds = [*((c, pa.int64()) for c in COUNTS), *((c, pa.float64()) for c in ("log_perplexity", *SCORES))]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct(kinds))

    return measure(text, lang.cast("string"))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


@dataclass
class Rules:
    """The folder of the trained models, and (lang, low, high, short_low, short_high): the bands of each language."""

    folder: str
    bands: DataFrame
    lang: str

    def judged(self, measured: DataFrame, m: str = "m", into: str = "kept") -> DataFrame:
        """Add whether a measured document is kept."""
        bands = self.bands.select(
            F.col(self.lang).alias("__lang"), *(F.col(c).alias(f"__{c}") for c in LIMITS)
        )
        if bands.count() <= BROADCAST_LANGUAGES:
            bands = F.broadcast(bands)
        low, high, short_low, short_high = (F.col(f"__{c}") for c in LIMITS)
        inside = F.coalesce(F.col(m)["score"].between(low, high), F.lit(True)) & F.coalesce(
            F.col(m)["short_score"].between(short_low, short_high), F.lit(True)
        )
        joined = measured.join(bands, F.col(self.lang).eqNullSafe(F.col("__lang")), "left")
        return joined.withColumn(into, ~base_failed(F.col(m)) & inside).drop("__lang", *(f"__{c}" for c in LIMITS))


def fit(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    above: float = ABOVE,
    below: float = BELOW,
    keep_text: bool = False
) -> tuple[Rules, DataFrame]:
    """Train on all texts, measure them all and set the bands; also returns the measured rows: the input's columns
    (without the text unless asked) and ``m``.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "models")
    cut(train(docs, folder, text, lang), "model-list")
    columns = [c for c in docs.columns if c != "m" and (keep_text or c != text)]
    measured = cut(docs.select(*columns, measures(folder, F.col(text), F.col(lang)).alias("m")), "measured")
    sound = measured.where(~base_failed(F.col("m"))).select(lang, *(F.col("m")[c].alias(c) for c in SCORES))
    half = lambda x: F.percentile_approx(x, 0.5, 10_000)
    middle = cut(sound.groupBy(lang).agg(*(half(c).alias(f"middle_{c}") for c in SCORES)), "middles")
    near = middle.withColumnRenamed(lang, "__lang")
    centred = sound.join(
        F.broadcast(near) if near.count() <= BROADCAST_LANGUAGES else near, F.col(lang).eqNullSafe(F.col("__lang"))
    )
    middles = [f"middle_{c}" for c in SCORES]
    few = 1 + FEW / F.count("*")
    spread = centred.groupBy(lang, *middles).agg(
        *((F.greatest(half(F.abs(F.col(c) - F.col(f"middle_{c}"))), F.lit(LEAST_DEVIATION)) * few).alias(c) for c in SCORES)
    )
    limits = [F.col(f"middle_{c}") + k * F.col(c) for c in SCORES for k in (-below, above)]
    bands = cut(spread.select(lang, *(x.alias(n) for x, n in zip(limits, LIMITS, strict=True))), "bands")
    return Rules(folder, bands, lang), measured


def filter_documents(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows whose texts pass all rules, with the columns of the input."""
    whole = docs.select(
        F.struct(*docs.columns).alias("__row"), F.col(text).alias("__text"), F.col(lang).alias("__lang_of")
    )
    rules, measured = fit(whole, "__text", "__lang_of")
    return rules.judged(measured, into="__kept").where("__kept").select("__row.*")


def op6_quality_rules(spark, sf_dir):
    """Counts and verdict of every text of ``documents``."""
    from tremora.session import table

    rules, measured = fit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    m = F.col("m")
    return rules.judged(measured).select(
        "doc_id",
        *(m[c].alias(c) for c in COUNTS),
        base_failed(m).alias("base_failed"),
        "kept",
        F.exp(m["log_perplexity"]).alias("perplexity"),
        *(m[c].alias(c) for c in SCORES)
    )
