"""SentencePiece encoding by an Aho-Corasick automaton and a single-pass Viterbi, and exact decoding.

The automaton holds all pieces of the vocabulary over UTF-8 bytes, in numpy arrays: transitions with failures
resolved, output links and the piece that ends in each state. Units are walked in lockstep, a byte of each at a time;
at every byte the output links are followed from state to state, and each piece that ends there relaxes the best score
of that position. Characters that no piece covers fall back to byte pieces. Segmentations maximise the sum of scores.
The scores are those of the file; the vocabulary at hand was built by merges and its scores are ranks, so its
segmentations are not those of replayed merges. ``scores="zipf"`` takes the logarithm of Zipf's law at the rank of a
piece instead. Decoding returns every text exactly.

Defined results: a null text counts as empty and has no pieces. Among equal scores the longer last piece wins. U+2581
in a text is encoded in bytes, so it survives decoding.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremora.llm.textscan import array_slices, give_back, text_buffers
from tremora.llm.units import UnitIds, gather, per_row, string_array

MARK = "▁"
#: Units that are walked together, and the bytes of the longest of them; longer units are walked alone.
TOGETHER, LONGEST = 4096, 128
#: Bytes of text whose units are made distinct together, and units of a generation that a worker remembers.
UNIT_SLICE, REMEMBERED = 512 << 10, 80_000
_loaded: dict[tuple[str, str], Pieces] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Automaton:
    """Byte strings as an Aho-Corasick automaton: ``step[state, byte]``, the string that ends in a state, and the next
    shorter one that does.
    """

    def __init__(self, strings: list[bytes]):
        lengths = np.array([len(x) for x in strings], dtype=np.int64)
        deepest = int(lengths.max(initial=0))
        letters = np.zeros((len(strings), deepest), dtype=np.uint8)
        for i, x in enumerate(strings):
            letters[i, : len(x)] = np.frombuffer(x, dtype=np.uint8)
        # the states of each depth are the distinct pairs of a state and a byte
        state, total = np.zeros(len(strings), dtype=np.int64), 1
        levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        for depth in range(deepest):
            longer = np.flatnonzero(lengths > depth)
            pairs, inverse = np.unique(state[longer] << 8 | letters[longer, depth], return_inverse=True)
            levels.append((pairs >> 8, pairs & 255, total))
            state[longer] = total + inverse
            total += len(pairs)
        self.step = np.zeros((total, 256), dtype=np.uint16 if total <= 1 << 16 else np.uint32)
        self.ends = np.full(total, -1, dtype=np.int32)
        self.ends[state[lengths > 0]] = np.flatnonzero(lengths > 0)
        self.link = np.zeros(total, dtype=np.int32)
        fails, failed = np.zeros(total, dtype=np.int64), 0
        if levels:
            self.step[0, levels[0][1]] = levels[0][2] + np.arange(len(levels[0][1]))
        for depth, (parent, byte, first) in enumerate(levels):
            own = first + np.arange(len(parent))
            fails[own] = failed
            self.link[own] = np.where(self.ends[fails[own]] >= 0, fails[own], self.link[fails[own]])
            self.step[own] = self.step[fails[own]]
            if depth + 1 < len(levels):
                child_of, child_byte, child_first = levels[depth + 1]
                failed = self.step[child_of, child_byte]  # where the parent's failure goes by the same byte
                self.step[child_of, child_byte] = child_first + np.arange(len(child_of))


class Pieces:
    """The vocabulary as an automaton, and the bytes of each piece."""

    def __init__(self, path: str, scores: str = "file"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        special = {
            i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
        }
        self.byte_ids = np.zeros(256, dtype=np.int32)
        self.bytes: list[bytes] = [b""] * n
        ranked = [i for i in range(n) if i not in special]
        norm = math.log(math.log(len(ranked) or 1) + 0.5772)
        self.vocabulary: dict[str, tuple[int, float]] = {}
        for rank, i in enumerate(ranked, 1):
            self.vocabulary[names[i]] = (i, -math.log(rank) - norm if scores == "zipf" else model.get_score(i))
            self.bytes[i] = names[i].replace(MARK, " ").encode()
        for i in range(n):
            if model.is_byte(i):
                self.byte_ids[int(names[i][3:5], 16)] = i
                self.bytes[i] = bytes([int(names[i][3:5], 16)])
        self.fallback = min((s for _, s in self.vocabulary.values()), default=0.0) - 10.0
        # joined[a, b]: some piece holds the ASCII characters a and b side by side; 128 stands for all others
        self.joined = np.zeros((129, 129), dtype=bool)
        self.joined[128, 128] = True
        for piece in self.vocabulary:
            codes = [min(ord(c), 128) for c in piece.replace(MARK, " ")]
            self.joined[codes[:-1], codes[1:]] = True
        listed = list(self.vocabulary.values())
        self.automaton = Automaton([self.bytes[i] for i, _ in listed])
        self.ids = np.array([i for i, _ in listed], dtype=np.int32)
        self.scores = np.array([s for _, s in listed])
        self.lengths = np.array([len(self.bytes[i]) for i, _ in listed], dtype=np.int32)
        self.units = UnitIds(self.encode, "<i4", REMEMBERED)
        self.sizes = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)

    def segment(self, unit: str) -> list[int]:
        """The best ids of a unit whose spaces stand for marks."""
        return np.frombuffer(self.encode([unit])[0], dtype="<i4").tolist()

    def encode(self, units: list[str]) -> list[bytes]:
        """The ids of each unit as little-endian bytes."""
        raw = [u.encode() for u in units]
        out: list[bytes] = [b""] * len(raw)
        short = sorted((i for i, x in enumerate(raw) if 0 < len(x) <= LONGEST), key=lambda i: -len(raw[i]))
        for at in range(0, len(short), TOGETHER):
            part = short[at : at + TOGETHER]
            for i, ids in zip(part, self._together([raw[i] for i in part]), strict=True):
                out[i] = ids
        for i, x in enumerate(raw):
            if len(x) > LONGEST:
                out[i] = self._alone(x)
        return out

    def _together(self, units: list[bytes]) -> list[bytes]:
        """Walk units, longest first, in lockstep."""
        size = np.array([len(u) for u in units])
        width = int(size[0])
        text = np.frombuffer(b"".join(u.ljust(width, b"\0") for u in units), dtype=np.uint8).reshape(len(units), width)
        best = np.zeros((len(units), width + 1))
        came = np.zeros((len(units), width + 1), dtype=np.int32)
        auto, state = self.automaton, np.zeros(len(units), dtype=np.int64)
        active = np.searchsorted(-size, -np.arange(width))  # how many units are longer than each position
        for t in range(width):
            n = int(active[t])
            state = auto.step[state[:n], text[:n, t]].astype(np.int64)
            best[:n, t + 1] = best[:n, t] + self.fallback
            came[:n, t + 1] = -1
            rows = np.arange(n)
            at = np.where(auto.ends[state] >= 0, state, auto.link[state])
            while True:
                open_ = np.flatnonzero(at)
                if not len(open_):
                    break
                rows, at = rows[open_], at[open_]
                piece = auto.ends[at]
                value = best[rows, t + 1 - self.lengths[piece]] + self.scores[piece]
                better = value > best[rows, t + 1]  # longer pieces come first
                best[rows[better], t + 1] = value[better]
                came[rows[better], t + 1] = piece[better]
                at = auto.link[at]
        rows, at, found, owner = np.arange(len(units)), size.copy(), [], []
        while len(rows):
            piece = came[rows, at]
            in_bytes = piece < 0
            found.append(np.where(in_bytes, self.byte_ids[text[rows, at - 1]], self.ids[piece]))
            owner.append(rows)
            at = at - np.where(in_bytes, 1, self.lengths[piece])
            rows, at = rows[at > 0], at[at > 0]
        owners = np.concatenate(owner)[::-1]
        order = np.argsort(owners, kind="stable")
        flat = np.concatenate(found)[::-1][order].astype("<i4").tobytes()
        ends = np.cumsum(np.bincount(owners, minlength=len(units))) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _alone(self, unit: bytes) -> bytes:
        """Walk one long unit."""
        step, ends, link = self.automaton.step, self.automaton.ends, self.automaton.link
        flat, width = memoryview(step).cast("B").cast(step.dtype.char), 256
        lengths, scores = self.lengths, self.scores
        best, came, state = [0.0] * (len(unit) + 1), [-1] * (len(unit) + 1), 0
        chains: dict[int, list[tuple[int, int, float]]] = {}
        for t, byte in enumerate(unit):
            state = flat[state * width + byte]
            if state not in chains:
                own, at = [], state
                while at:
                    if (piece := int(ends[at])) >= 0:
                        own.append((piece, int(lengths[piece]), float(scores[piece])))
                    at = int(link[at])
                chains[state] = own
            top, by = best[t] + self.fallback, -1
            for piece, length, score in chains[state]:
                value = best[t + 1 - length] + score
                if value > top:
                    top, by = value, piece
            best[t + 1], came[t + 1] = top, by
        out, t = [], len(unit)
        while t:
            piece = came[t]
            out.append(int(self.byte_ids[unit[t - 1]]) if piece < 0 else int(self.ids[piece]))
            t -= 1 if piece < 0 else int(lengths[piece])
        return np.array(out[::-1], dtype="<i4").tobytes()


def pieces(path: str, scores: str = "file") -> Pieces:
    if (path, scores) not in _loaded:
        _loaded[path, scores] = Pieces(path, scores)
    return _loaded[path, scores]


def encode_slice(column: pa.Array, model: Pieces) -> pa.Array:
    """Lists of ids; a space is put before each text that isn't empty."""
    data, offsets = text_buffers(column)
    size = np.diff(offsets)
    full = np.flatnonzero(size)
    data = np.insert(data, offsets[:-1][full], 0x20)
    offsets = np.concatenate(([0], np.cumsum(size + (size > 0))))
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[offsets] = True
    # no piece spans two characters that stand side by side in none, so the best ids of the parts are those of the whole
    kind = np.minimum(data, 128)
    begins[1:-1] |= ~model.joined[kind[:-1], kind[1:]]
    starts = np.flatnonzero(begins[: len(data)])
    ids, counts = model.units.of_spans(string_array(data, np.concatenate((starts, [len(data)]))))
    n = per_row(counts, np.searchsorted(starts, offsets))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(ids))


def decode_lists(column: pa.Array, model: Pieces) -> pa.Array:
    """Texts of lists of ids, without the space before."""
    column = column.fill_null([]) if column.null_count else column
    offsets = column.offsets.to_numpy().astype(np.int64)
    ids = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    data, counts = gather(model.flat, model.sizes, ids)
    ends = np.concatenate(([0], np.cumsum(counts)))[offsets - offsets[0]]
    raw = data.tobytes()
    return pa.array(
        [raw[a + 1 : b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary()
    ).cast(pa.string())


def encode_pieces(text: Column, path: str | None = None, scores: str = "file") -> Column:
    """Ids of the pieces of a text column."""
    path = path or default_model()

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(column: pa.Array) -> pa.Array:
        out = [encode_slice(x, pieces(path, scores)) for x in array_slices(column, UNIT_SLICE)]
        give_back()
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))

    return encode(F.coalesce(text, F.lit("")))


def decode_pieces(ids: Column, path: str | None = None, scores: str = "file", rows: int = 256) -> Column:
    """Texts of a column of ids."""
    path = path or default_model()

    @F.arrow_udf(T.StringType())
    def decode(column: pa.Array) -> pa.Array:
        out = [decode_lists(column.slice(i, rows), pieces(path, scores)) for i in range(0, len(column), rows)]
        give_back()
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    return decode(ids)


def encode_documents(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_pieces, exact, ids) of every row: ids of the whole text, and whether decoding them gives it back."""
    coded = docs.select(
        F.col(key), F.coalesce(F.col(text), F.lit("")).alias("__text")
    ).withColumn("ids", encode_pieces(F.col("__text")))
    back = coded.withColumn("exact", decode_pieces(F.col("ids")) == F.col("__text"))
    return back.select(key, F.size("ids").cast("long").alias("n_pieces"), "exact", "ids")


def op5_sentencepiece(spark, sf_dir):
    """All texts of ``documents`` encoded and decoded."""
    from tremora.session import table

    return encode_documents(table(spark, sf_dir, "documents"))
