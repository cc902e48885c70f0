"""Token ids in binary shards with a minimal perfect hash index.

Texts are encoded by the tokenizers library, dealt into shards by ranges of the key, sorted and
streamed into files: raw ids first, then the offsets of records, the keys and the index. The index
hashes keys level by level into bit arrays; a key that is alone at its place in a level is settled
there, and the rank of its bit is its slot, so n keys fill n slots. Each slot stores the number of a
record and a fingerprint of its key. A lookup reads the footer once, then for each key a block of bits
at a level or two, a rank, a slot and two offsets by range: a few hundred bytes whatever the size of the shard.

Texts are encoded word by word where the tokenizer allows it, which is tried out on the tokenizer itself (it must
lower letters, drop white space and end words at signs); with any other tokenizer whole texts are encoded.

Defined results: a null or empty text has the end id alone. Rows that repeat a key are separate
records in the order of their ids; the index leads to the first. Rows without key come first and are
not indexed. An empty table gives no shards.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremora.llm.files import Written, open_read
from tremora.llm.textscan import LOWER, Words, array_slices, column_of, mix, text_buffers
from tremora.llm.units import UnitIds, per_row, string_array

MAGIC = b"TRMIDS02"
END_ID = 1
DOCS_PER_SHARD = 1 << 14
MOST_SHARDS = 20_000
#: Bytes of text whose words are made distinct together, and words of one generation that a worker remembers: the
#: library's calls cost more than the memory.
TEXT_SLICE, REMEMBERED = 4 << 20, 300_000
#: Words of bits for each stored rank, and the bytes at the end of a shard that are read first.
RANK_WORDS = 8
FOOTER_GUESS = 1024
U = np.uint64
_encoders: dict[str, UnitIds] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# -- encoding ---------------------------------------------------------------------------------------


#: ASCII signs that end a run of letters for the tokenizer; no rule of it joins one with a letter before.
_SIGN = np.zeros(256, dtype=bool)
_SIGN[[*b"!\"#$%&()*+,-./:;=?@[]^_`{}~"]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True


class JoinedWords:
    """Encode many words in one call: they stand between marks of a single id that none of them contains."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.model.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        signs = (
            c
            for c in map(chr, range(0x2500, 0x2700))
            if len(self.ids(f"a {c} a")) == 3 and self.ids(f"a {c} a")[1:2] == self.ids(c)
        )
        self.mark = next(signs, None)
        self.mark_id = self.ids(self.mark)[0] if self.mark else -1
        self.splits = self._splits()

    def _splits(self) -> bool:
        """Whether texts may be encoded word by word: letters are lowered, white space leaves nothing, and a sign
        after a letter begins something new.
        """
        alike = [("ABCXYZ Qq", "abcxyz qq"), ("a  b\n\tc ", "a b c"), (" a\x0b\x0cb\r", "a b")]
        if any(
            self.ids(x) != self.ids(y) for x, y in alike
        ) or self.ids("one two") != self.ids("one") + self.ids("two"):
            return False
        signs = [chr(i) for i in np.flatnonzero(_SIGN)]
        tries = [(w, f"{c}{after}") for c in signs for w in ("a", "word") for after in ("", "s", "word", "9", c)]
        return all(self.ids(w + rest) == self.ids(w) + self.ids(rest) for w, rest in tries)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, dtype=self.dtype) for x in self.model.encode_batch(texts, add_special_tokens=False)]

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def __call__(self, words: list[str]) -> list[bytes]:
        plain = [w for w in words if self.mark and self.mark not in w and "<|" not in w]
        found: dict[str, bytes] = {}
        for i in range(0, len(plain), 4096):
            part = plain[i : i + 4096]
            ids = np.array(self.ids(f" {self.mark} ".join(part)), dtype=self.dtype)
            cuts = np.flatnonzero(ids == self.mark_id).tolist()
            raw, size = ids.tobytes(), self.dtype.itemsize
            if len(cuts) == len(part) - 1:
                found.update(
                    (w, raw[a * size : b * size])
                    for w, a, b in zip(part, [0, *(c + 1 for c in cuts)], [*cuts, len(ids)], strict=True)
                )
        return [found[w] if w in found else np.array(self.ids(w), dtype=self.dtype).tobytes() for w in words]


def _encoder(path: str) -> UnitIds:
    if path not in _encoders:
        encode = JoinedWords(path)
        _encoders[path] = UnitIds(encode, encode.dtype.str, REMEMBERED)
    return _encoders[path]


def encode_texts(column: pa.Array, path: str, end_id: int = END_ID) -> pa.Array:
    """Ids of each text and the end id, as little-endian integers of 16 bits, or 32 for large vocabularies.

    Words are the units where the tokenizer splits texts there; signs after ASCII letters begin new ones, and
    upper-case ASCII letters are lowered as the tokenizer would (neither where special tokens may stand).
    """
    encoder, out = _encoder(path), []
    if not encoder.encode.splits:
        texts = column.fill_null("") if column.null_count else column
        for part in array_slices(texts, TEXT_SLICE // 8):
            out.append(
                pa.array(
                    [
                        np.append(ids, encoder.dtype.type(end_id)).tobytes()
                        for ids in encoder.encode.whole(part.to_pylist())
                    ],
                    pa.binary()
                )
            )
        return pa.concat_arrays(out) if out else pa.array([], pa.binary())
    for part in array_slices(column, TEXT_SLICE):
        data, offsets = text_buffers(part)
        words = Words(data, offsets, hashes=False)
        begins = np.zeros(len(data), dtype=bool)
        begins[words.start] = True
        if b"<|" not in data.tobytes():
            data = LOWER[data]
            begins[1:] |= _SIGN[data[1:]] & _LETTER[data[:-1]] & ~begins[1:]
        inside = words.inside
        ids, counts = encoder.of_spans(
            string_array(data[inside], np.concatenate((np.flatnonzero(begins[inside]), [int(inside.sum())])))
        )
        n = per_row(counts, np.concatenate(([0], np.cumsum(begins)))[offsets])
        ends = np.cumsum(n + 1) - 1
        all_ids = np.full(int(n.sum()) + len(n), end_id, dtype=encoder.dtype)
        keep = np.ones(len(all_ids), dtype=bool)
        keep[ends] = False
        all_ids[keep] = ids
        bounds = np.concatenate(([0], ends + 1)) * encoder.dtype.itemsize
        out.append(
            pa.BinaryArray.from_buffers(
                pa.binary(), len(n), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(all_ids)]
            )
        )
    return pa.concat_arrays(out) if out else pa.array([], pa.binary())


# -- index ------------------------------------------------------------------------------------------


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return mix(keys ^ mix(np.full(1, level + 1, dtype=U))[0]) % U(size)


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys * U(0xA0761D6478BD642F) + U(0xE7037ED1A0B428DB)) >> U(32)).astype(np.uint32)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.base = np.concatenate(([0], np.cumsum([-(-s // 64) for s in sizes]))).astype(np.int64)
        self.rank = np.concatenate(([0], np.cumsum(np.bitwise_count(bits)))).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        sizes, parts, level = [], [], 0
        while len(keys):
            size = 2 * len(keys) + 63 & ~63
            place = _place(keys, level, size).astype(np.int64)
            alone = np.bincount(place, minlength=size)[place] == 1
            words = np.zeros(size // 64, dtype=U)
            np.bitwise_or.at(words, place[alone] >> 6, U(1) << (place[alone] & 63).astype(U))
            sizes.append(size)
            parts.append(words)
            keys, level = keys[~alone], level + 1
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, dtype=U))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for keys that fall through all levels. Foreign keys can get any slot."""
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            place = _place(keys[open_], level, size).astype(np.int64)
            word = self.base[level] + (place >> 6)
            bit = (place & 63).astype(U)
            hit = (self.bits[word] >> bit) & U(1) == 1
            below = self.bits[word] & ((U(1) << bit) - U(1))
            out[open_[hit]] = (self.rank[word] + np.bitwise_count(below))[hit]
            open_ = open_[~hit]
        return out


# -- shards -----------------------------------------------------------------------------------------


class ShardWriter:
    """Ids, then offsets, keys and index, then a footer that says where they stand."""

    def __init__(self, folder: str, id_bytes: int):
        self.id_bytes = id_bytes
        self.out = Written(folder, f"{uuid.uuid4().hex}.ids")
        self.out.write(MAGIC)
        self.keys: list[int | None] = []
        self.counts: list[int] = []

    def add(self, key: int | None, ids: bytes) -> None:
        self.out.write(ids)
        self.keys.append(key)
        self.counts.append(len(ids) // self.id_bytes)

    def close(self) -> dict:
        offsets = np.concatenate(([0], np.cumsum(self.counts, dtype=np.int64)))
        known = np.array([k for k in self.keys if k is not None], dtype=np.int64)
        unkeyed = len(self.keys) - len(known)
        distinct, first = np.unique(known, return_index=True)
        index = PerfectHash.of(distinct.view(U))
        slots = index.slots(distinct.view(U))
        records, prints = np.zeros(len(distinct), dtype=np.uint32), np.zeros(len(distinct), dtype=np.uint32)
        records[slots], prints[slots] = first + unkeyed, _fingerprints(distinct.view(U))
        footer = {
            "id_bytes": self.id_bytes,
            "records": len(self.keys),
            "unkeyed": unkeyed,
            "levels": index.sizes,
            "sections": {}
        }
        slots = np.stack((records, prints), axis=1)
        for name, array in (
            ("offsets", offsets),
            ("keys", known),
            ("bits", index.bits),
            ("ranks", index.rank[:-1:RANK_WORDS]),
            ("slots", slots)
        ):
            footer["sections"][name] = [self.out.at, array.size, array.dtype.str]
            self.out.write(array.tobytes())
        body = json.dumps(footer).encode()
        self.out.write(body + struct.pack("<Q", len(body)) + MAGIC)
        return {
            "path": self.out.close(),
            "records": len(self.keys),
            "tokens": int(offsets[-1]),
            "low": int(known[0]) if len(known) else None,
            "high": int(known[-1]) if len(known) else None
        }


class ShardReader:
    """Keyed and sequential access to a shard by range reads; opening it reads the footer alone."""

    def __init__(self, file):
        self.file, total = file, file.size()
        tail = self._read(max(0, total - FOOTER_GUESS), min(total, FOOTER_GUESS))
        if tail[-8:] != MAGIC:
            raise ValueError("not a shard")
        size = struct.unpack("<Q", tail[-16:-8])[0]
        self.footer = json.loads(
            tail[-16 - size : -16] if size + 16 <= len(tail) else self._read(total - 16 - size, size)
        )
        self.id_bytes, self.records = self.footer["id_bytes"], self.footer["records"]
        self.sizes = self.footer["levels"]
        self.base = np.cumsum([0, *(s // 64 for s in self.sizes)]).tolist()

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def section(self, name: str, first: int = 0, last: int | None = None) -> np.ndarray:
        """Values first to last (excluded) of a section."""
        at, n, kind = self.footer["sections"][name]
        kind = np.dtype(kind)
        last = n if last is None else min(last, n)
        return np.frombuffer(self._read(at + first * kind.itemsize, max(last - first, 0) * kind.itemsize), dtype=kind)

    def lookup(self, key: int) -> int:
        """The first record of a key, -1 if the shard doesn't hold it (but for equal fingerprints, one in 2^32)."""
        own = np.array([key], dtype=np.int64).view(U)
        for level, size in enumerate(self.sizes):
            place = int(_place(own, level, size)[0])
            word = self.base[level] + place // 64
            block = word // RANK_WORDS
            bits = self.section("bits", block * RANK_WORDS, word + 1)
            if not int(bits[-1]) >> place % 64 & 1:
                continue
            below = int(bits[-1]) & ((1 << place % 64) - 1)
            slot = int(
                self.section("ranks", block, block + 1)[0]
            ) + int(np.bitwise_count(bits[:-1]).sum()) + below.bit_count()
            record, mark = self.section("slots", 2 * slot, 2 * slot + 2).tolist()
            return record if mark == int(_fingerprints(own)[0]) else -1
        return -1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """``lookup`` of many keys, with the whole index in memory."""
        index, slots = PerfectHash(self.sizes, self.section("bits")), self.section("slots").reshape(-1, 2)
        keys = keys.astype(np.int64).view(U)
        at = index.slots(keys)
        out = np.full(len(keys), -1, dtype=np.int64)
        hit = np.flatnonzero(at >= 0)
        hit = hit[slots[at[hit], 1] == _fingerprints(keys[hit])]
        out[hit] = slots[at[hit], 0]
        return out

    def ids(self, first: int, last: int) -> tuple[bytes, np.ndarray]:
        """Ids of the records from first up to last, last excluded, as little-endian 32-bit integers; and where each
        begins (and the last ends), counted from the shard's first.
        """
        offsets = self.section("offsets", first, last + 1)
        raw = self._read(len(MAGIC) + int(offsets[0]) * self.id_bytes, int(offsets[-1] - offsets[0]) * self.id_bytes)
        return np.frombuffer(raw, dtype=f"<u{self.id_bytes}").astype("<u4").tobytes(), offsets


def write_shards(
    docs: DataFrame,
    folder: str,
    key: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    end_id: int = END_ID,
    docs_per_shard: int = DOCS_PER_SHARD
) -> DataFrame:
    """Write all texts; returns (shard, path, records, tokens, low, high), a row for each file. Run it once: keep what
    it returns with ``cut``.
    """
    path = tokenizer or default_tokenizer()
    docs = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    rows = docs.count()
    shards = max(1, -(-rows // max(docs_per_shard, -(-rows // MOST_SHARDS))))
    # only bounds of ranges reach the driver: as many as there are shards
    shares = [i / shards for i in range(1, shards)]
    bounds = (docs.agg(F.percentile_approx("k", shares, 100 * shards).alias("b")).first()["b"] or []) if shares else []
    bounds = np.array(sorted(set(bounds)), dtype=np.int64)

    def encode(batches: Iterator) -> Iterator:
        for batch in batches:
            keys = column_of(batch, "k")
            dealt = np.where(
                np.asarray(keys.is_null()),
                0,
                np.searchsorted(bounds, keys.fill_null(0).to_numpy(zero_copy_only=False), side="left")
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(dealt.astype(np.int32)), keys, encode_texts(column_of(batch, "t"), path, end_id)],
                names=["shard", "k", "ids"]
            )

    def write(batches: Iterator) -> Iterator:
        shard, writer = None, None
        for batch in batches:
            for s, k, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if s != shard:
                    if writer:
                        yield pa.RecordBatch.from_pylist([{"shard": shard, **writer.close()}], schema=listed)
                    shard, writer = s, ShardWriter(folder, _encoder(path).dtype.itemsize)
                writer.add(k, ids)
        if writer:
            yield pa.RecordBatch.from_pylist([{"shard": shard, **writer.close()}], schema=listed)

    listed = pa.schema(
        [
            ("shard", pa.int32()),
            ("path", pa.string()),
            ("records", pa.int64()),
            ("tokens", pa.int64()),
            ("low", pa.int64()),
            ("high", pa.int64())
        ]
    )
    encoded = docs.mapInArrow(encode, "shard int, k long, ids binary")
    dealt = encoded.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions(
        F.col("shard"), F.col("k").asc_nulls_first(), F.xxhash64("ids")
    )
    return dealt.mapInArrow(write, "shard int, path string, records long, tokens long, low long, high long")


def with_starts(shards: DataFrame) -> DataFrame:
    """Add the number of ids in all shards before. The list has a row for each file, MOST_SHARDS at most."""
    from pyspark.sql import Window

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


RECORD = T.StructType(
    [
        T.StructField("key", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_crc32", T.LongType())
    ]
)


def read_shards(shards: DataFrame, piece: int = 1 << 20) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every record, read from the files; each key is found through the index."""

    def read(batches: Iterator) -> Iterator:
        kinds = pa.schema(
            [("key", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
        )
        for batch in batches:
            for path, base in zip(
                column_of(batch, "path").to_pylist(), column_of(batch, "start").to_pylist(), strict=True
            ):
                with open_read(path) as file:
                    shard = ShardReader(file)
                    unkeyed, n = shard.footer["unkeyed"], shard.records
                    keys, offsets = shard.section("keys"), shard.section("offsets")  # DOCS_PER_SHARD of them
                    found = shard.find(keys)
                    again = np.zeros(len(found), dtype=bool)
                    again[1:] = keys[1:] == keys[:-1]
                    if not np.array_equal(found[~again], np.flatnonzero(~again) + unkeyed):
                        raise ValueError("the index doesn't lead to the records")
                    first = 0
                    while first < n:
                        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + piece, side="right")) - 1)
                        last = min(last, n)
                        ids, own = shard.ids(first, last)
                        view, at = memoryview(ids), (own - own[0]) * 4
                        sums = [zlib.crc32(view[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                        listed = [None if i < unkeyed else int(keys[i - unkeyed]) for i in range(first, last)]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(listed, pa.int64()),
                                pa.array(own[:-1] + base),
                                pa.array(np.diff(own)),
                                pa.array(sums, pa.int64())
                            ],
                            schema=kinds
                        )
                        first = last

    return shards.select("path", "start").mapInArrow(read, RECORD)


def fetch(shards: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Ids of the given keys by keyed access: (key, ids), ids null where no shard has the key. Keys are routed by the
    shards' ranges.
    """
    # MOST_SHARDS at most
    listed = shards.where(F.col("low").isNotNull()).orderBy("low").select("path", "low", "high").collect()
    paths, lows = [r["path"] for r in listed], np.array([r["low"] for r in listed], dtype=np.int64)

    def route(batches: Iterator) -> Iterator:
        for batch in batches:
            own = batch.column(0).drop_null()
            shard = np.searchsorted(lows, own.to_numpy(zero_copy_only=False), side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [own, pa.array(np.maximum(shard, 0).astype(np.int32))], names=["key", "shard"]
            )

    def read(batches: Iterator) -> Iterator:
        opened = (-1, None)
        for batch in batches:
            own, shard = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            out: list[bytes | None] = []
            for s, k in zip(shard.tolist(), own.tolist(), strict=True):
                if opened[0] != s:
                    opened = (s, ShardReader(open_read(paths[s])) if paths else None)
                i = opened[1].lookup(k) if opened[1] else -1
                out.append(None if i < 0 else opened[1].ids(i, i + 1)[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["key", "ids"])

    routed = keys.select(F.col(key).cast("long").alias("key")).mapInArrow(route, "key long, shard int")
    return routed.repartition("shard").sortWithinPartitions("shard", "key").mapInArrow(read, "key long, ids binary")


def op7_token_binary(spark, sf_dir):
    """All texts of ``documents`` written to shards in ascending order of doc_id and read back from the files."""
    from tremora.session import cut, scratch, table

    shards = cut(write_shards(table(spark, sf_dir, "documents"), scratch(spark, "ids")), "ids-list")
    listed = with_starts(shards).repartition(max(1, spark.sparkContext.defaultParallelism * 2), "path")
    return read_shards(listed).withColumnRenamed("key", "doc_id")
