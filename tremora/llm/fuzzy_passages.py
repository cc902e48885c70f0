"""Substring dedup: passages that repeat across documents, found by chaining shared k-mer seeds.

Every text is winnowed: of each WINDOW consecutive K-word seeds the least hash is kept, so any K + WINDOW - 1
equal words in two texts share a seed, and texts that agree in four words of five share several in fifty words.
For each seed the first document that holds it is its home, and each other occurrence is matched with the home
alone, so matches grow with occurrences, not with pairs. Tasks match the holders of a frequent seed among
themselves before the shuffle and send on PASSED_ON of them. Texts of equal words are matched as a whole.

Matches of a document and a home join along diagonals to anchors; anchors are chained in order on both sides,
gaps costing in proportion to their length, with a Fenwick tree for the best predecessor. Chains are aligned on
the words of both texts: their ends are extended, over insertions and deletions too, until the texts differ, and the
longest common subsequence of what lies between counts the words that agree. A second pass takes the stretches of
shared seeds that no passage covers, whose parts have other homes each, and finds a home for runs of neighbouring
seeds instead.

Defined results: null and empty texts, and texts below K words, hold no passages. A text of least_words words
or more that an earlier document has too is one passage, from its first word to its last. Rows without key are
left out. Rows with one key are one document. Repeats within a single document are not passages here. Case
of ASCII letters doesn't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremora.llm.textscan import U, Words, column_of, mix, shingle_hashes, slices, text_buffers
from tremora.session import cut, forget

K, WINDOW = 5, 6
#: Seeds that a task looks at together before the shuffle, and how many documents of each seed it sends on.
SEEDS_AT_ONCE = 1 << 19
PASSED_ON = 6
#: Words between two anchors of a chain that need no look. Up to WIDEST_GAP of them, half must agree, or the chain is
#: cut there.
LARGEST_GAP, WIDEST_GAP = 24, 96
GAP_COST = 0.1
LEAST_WORDS = 50
LEAST_IDENTITY = 0.75
#: Words around a chain that extension sees at first.
FLANK = 40
#: Extension ends where the score (+1 for an equal word, -1 for another) is so far below its best.
DROP = 8
#: After an insertion or deletion of up to SHIFT words, texts must agree in AGREE words in a row to go on.
SHIFT, AGREE = 10, 3
#: Neighbouring seeds whose runs get a home of their own in the second pass: 2 span about 9 words, 7 about 30.
RUNS = (2, 7)
#: Words that a stretch of shared seeds must span to be looked at again; the outer seeds of 51 equal words span 41.
LEAST_STRETCH = 40
_TOP = U(0xFFFFFFFFFFFFFFFF)
_SPREAD = U(0x9E3779B97F4A7C15)


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least (or greatest) of values[i : i + width] for every i that has so many, from minima within blocks."""
    op = np.minimum if least else np.maximum
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, _TOP if least else U(0), dtype=U)
    padded[:n] = values
    table = padded.reshape(blocks, width)
    forward = op.accumulate(table, axis=1).ravel()
    backward = op.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(backward[: n - width + 1], forward[width - 1 : n])


def winnow(grams: np.ndarray, rows: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Positions whose hash is the least of some window of its own row."""
    if not len(grams):
        return np.zeros(0, dtype=np.int64)
    pad = width - 1
    shift = np.cumsum(np.concatenate(([0], rows[1:] != rows[:-1]))) * pad + pad
    spread = np.full(len(grams) + int(shift[-1]) + pad, _TOP, dtype=U)
    at = np.arange(len(grams)) + shift
    spread[at] = grams
    least = _sliding(spread, width, True)
    least[least == _TOP] = 0
    # a position is chosen if the greatest of the minima of the windows that hold it is its own hash
    return np.flatnonzero(_sliding(least, width, False)[at - pad] == grams)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new group of equal values begins."""
    apart = np.zeros(max(len(columns[0]) - 1, 0), dtype=bool)
    for c in columns:
        apart |= c[1:] != c[:-1]
    return np.flatnonzero(np.concatenate(([True], apart))) if len(columns[0]) else np.zeros(0, dtype=np.int64)


SEED_ROWS = "seed long, doc long, at long, home long, home_at long"


def seeds(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """SEED_ROWS of the winnowed seeds. ``at`` is the position in words; ``home`` is given where the task has matched
    the row itself.

    A row whose seed is odd stands for the whole text: seed and the upper half of ``at`` are digests of its words, the
    lower half counts them.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        waiting = 0
        for batch in batches:
            for part in slices(batch, "t"):
                words = Words(*text_buffers(column_of(part, "t")), lower=True)
                keys = column_of(part, "k").to_numpy(zero_copy_only=False)
                grams = shingle_hashes(words.hash, K)
                rows = words.doc[: len(grams)]
                whole = np.flatnonzero(rows == words.doc[K - 1 :]) if len(grams) else np.zeros(0, dtype=np.int64)
                chosen = whole[winnow(grams[whole], rows[whole])]
                held.append((grams[chosen] & ~U(1), keys[rows[chosen]], chosen - words.first[rows[chosen]]))
                full = np.flatnonzero(words.count)
                if len(full):
                    begin = words.first[full]
                    place = (np.arange(len(words.start)) - np.repeat(begin, words.count[full])).astype(U)
                    digest = [np.add.reduceat(mix(words.hash ^ mix(place * U(2) + U(k))), begin) for k in range(2)]
                    held.append(
                        (
                            mix(digest[0]) | U(1),
                            keys[full],
                            ((digest[1] >> U(32) << U(32)) | words.count[full].astype(U)).view(np.int64)
                        )
                    )
                waiting += len(chosen)
                if waiting > SEEDS_AT_ONCE:
                    yield thinned(*(np.concatenate(c) for c in zip(*held, strict=True)))
                    held, waiting = [], 0
        if held:
            yield thinned(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return docs.select(
        F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")
    ).where("k is not null").mapInArrow(scan, SEED_ROWS)


def thinned(seed: np.ndarray, doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """The rows; where more than PASSED_ON documents have a seed, the later ones are matched with the first."""
    order = np.lexsort((at, doc, seed))
    seed, doc, at = seed[order], doc[order], at[order]
    begins = _starts(seed)
    group = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(seed))))
    first = np.zeros(len(seed), dtype=np.int64)
    first[_starts(seed, doc)] = 1
    number = np.cumsum(first)
    number -= number[begins][group] - 1  # of the document among those of its seed, from 1
    home, home_at = doc[begins][group], at[begins][group]
    late = (number > PASSED_ON) & ((seed & U(1) == 0) | (at == home_at))
    columns = [
        pa.array(seed.view(np.int64)),
        pa.array(doc),
        pa.array(at),
        pa.array(home, mask=~late),
        pa.array(home_at, mask=~late)
    ]
    return pa.RecordBatch.from_arrays(columns, names=["seed", "doc", "at", "home", "home_at"])


MATCHED = "seed long, doc long, home long, pos int, hpos int"


def matches(found: DataFrame) -> DataFrame:
    """MATCHED: each occurrence of a shared seed with the first document that has it. Where whole texts are equal,
    both positions are -1 times their words.
    """

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int, int] | None = None  # seed, document and place of the group that the batch before ended in
        for batch in batches:
            sent = np.asarray(batch.column(3).is_null())
            yield rows(*(c.filter(pa.array(~sent)).to_numpy(zero_copy_only=False) for c in batch.columns))
            seed, doc, at = (c.filter(pa.array(sent)).to_numpy(zero_copy_only=False) for c in batch.columns[:3])
            if not len(seed):
                continue
            begins = _starts(seed)
            home, home_at = doc[begins], at[begins]
            if last and last[0] == seed[0]:
                home[0], home_at[0] = last[1:]
            last = int(seed[-1]), int(home[-1]), int(home_at[-1])
            size = np.diff(np.append(begins, len(seed)))
            home, home_at = np.repeat(home, size), np.repeat(home_at, size)
            keep = (doc != home) & ((seed & 1 == 0) | (at == home_at))
            yield rows(seed[keep], doc[keep], at[keep], home[keep], home_at[keep])

    def rows(
        seed: np.ndarray, doc: np.ndarray, at: np.ndarray, home: np.ndarray, home_at: np.ndarray
    ) -> pa.RecordBatch:
        place = lambda x: np.where(seed & 1 == 1, -(at & 0xFFFFFFFF), x).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (seed, doc, home.astype(np.int64), place(at), place(home_at))],
            names=["seed", "doc", "home", "pos", "hpos"]
        )

    dealt = found.repartition(F.when(F.col("home").isNull(), F.col("seed")).otherwise(F.xxhash64("doc")))
    return dealt.sortWithinPartitions("seed", "doc", "at").mapInArrow(pair, MATCHED)


class Fenwick:
    """Greatest (value, item) over prefixes."""

    def __init__(self, n: int):
        self.best = [(-1e18, -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def top(self, n: int) -> tuple[float, int]:
        """The greatest of the first n places."""
        found = (-1e18, -1)
        while n:
            found = max(found, self.best[n])
            n -= n & -n
        return found


Anchor = tuple[int, int, int, int]


def linked_anchors(anchors: list[Anchor]) -> list[list[Anchor]]:
    """Anchors (x0, x1, y0, y1) in chains, best chain first; every anchor is in one of them."""
    anchors = sorted(anchors)
    ends = sorted({a[3] for a in anchors})
    rank = {y: i for i, y in enumerate(ends)}
    starts = np.searchsorted(ends, [a[2] for a in anchors], side="right").tolist()
    waiting = sorted(range(len(anchors)), key=lambda i: anchors[i][1])
    tree, score, before, put = Fenwick(len(ends)), [0.0] * len(anchors), [-1] * len(anchors), 0
    for i, (x0, x1, y0, _) in enumerate(anchors):
        while put < len(waiting) and anchors[waiting[put]][1] <= x0:
            j = waiting[put]
            tree.put(rank[anchors[j][3]], (score[j] + GAP_COST * (anchors[j][1] + anchors[j][3]), j))
            put += 1
        value, j = tree.top(starts[i])
        gain = value - GAP_COST * (x0 + y0)
        score[i] = x1 - x0 + max(0.0, gain)
        before[i] = j if gain > 0 else -1
    used, out = [False] * len(anchors), []
    for i in sorted(range(len(anchors)), key=lambda i: -score[i]):
        if used[i]:
            continue
        own = [i]
        used[i] = True
        while before[own[-1]] >= 0 and not used[before[own[-1]]]:
            own.append(before[own[-1]])
            used[own[-1]] = True
        out.append([anchors[j] for j in reversed(own)])
    return out


def _ends(own: list[Anchor]) -> Anchor:
    return own[0][0], own[-1][1], own[0][2], own[-1][3]


def chain(anchors: list[Anchor]) -> list[Anchor]:
    """The ranges of the chains of anchors, best first."""
    return [_ends(own) for own in linked_anchors(anchors)]


def _pieces(own: list[Anchor]) -> list[int]:
    """Ranges of the parts of a chain between its long gaps, one after the other."""
    out, begin = [], 0
    for i in range(1, len(own)):
        if max(own[i][0] - own[i - 1][1], own[i][2] - own[i - 1][3]) > LARGEST_GAP:
            out += _ends(own[begin:i])
            begin = i
    return [*out, *_ends(own[begin:])]


def whole_groups(
    batches: Iterator[pa.RecordBatch], keys: int, work: Callable[[list[np.ndarray]], Iterator[pa.RecordBatch]]
) -> Iterator[pa.RecordBatch]:
    """Hand on sorted rows as arrays such that rows equal in their first ``keys`` columns come together."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        own = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            own = [np.concatenate(x) for x in zip(held, own, strict=True)]
        if not len(own[0]):
            continue
        last = int(_starts(*own[:keys])[-1])  # the last group may go on in the next batch
        held = [x[last:] for x in own]
        if last:
            yield from work([x[:last] for x in own])
    if held is not None:
        yield from work(held)


def chains(found: DataFrame, least_seeds: int = 2) -> DataFrame:
    """(doc, home, x0, x1, y0, y1, pieces), word ranges of the chains of matches (doc, home, pos, hpos, width). A
    group is no larger than its document's seeds.
    """

    def out(own: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        doc, home, diagonal, pos, width = own
        gap = np.append(0, pos[1:] - pos[:-1] - width[:-1])
        begins = np.union1d(_starts(doc, home, diagonal), np.flatnonzero(gap > LARGEST_GAP))
        sizes = np.diff(np.append(begins, len(doc)))
        x0, x1 = pos[begins], np.maximum.reduceat(pos + width, begins) if len(begins) else pos[begins]
        y0, y1 = x0 - diagonal[begins], x1 - diagonal[begins]
        groups = _starts(doc[begins], home[begins])
        anchors = np.diff(np.append(groups, len(begins)))
        lone = groups[anchors == 1]
        lone = lone[sizes[lone] >= least_seeds]
        ranges = (x0[lone], x1[lone], y0[lone], y1[lone])
        rows = [(doc[begins[lone]], home[begins[lone]], *ranges)]
        pieces = np.stack(ranges, axis=1).astype(np.int32).tolist()
        found: list[tuple[int, ...]] = []
        for a, n in zip(groups[anchors > 1].tolist(), anchors[anchors > 1].tolist(), strict=True):
            d, h = int(doc[begins[a]]), int(home[begins[a]])
            for own_chain in linked_anchors(list(zip(*(v[a : a + n].tolist() for v in (x0, x1, y0, y1)), strict=True))):
                if len(own_chain) > 1 or least_seeds < 2 or own_chain[0][1] - own_chain[0][0] > K:
                    found.append((d, h, *_ends(own_chain)))
                    pieces.append(_pieces(own_chain))
        if found:
            rows.append(tuple(np.array(c) for c in zip(*found, strict=True)))
        columns = [np.concatenate(c) for c in zip(*rows, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                *(pa.array(c, pa.int64() if i < 2 else pa.int32()) for i, c in enumerate(columns)),
                pa.array(pieces, pa.list_(pa.int32()))
            ],
            names=["doc", "home", "x0", "x1", "y0", "y1", "pieces"]
        )

    ordered = found.select(
        "doc",
        "home",
        (F.col("pos") - F.col("hpos")).cast("long").alias("diagonal"),
        F.col("pos").cast("long"),
        F.col("width").cast("long")
    )
    ordered = ordered.repartition("doc", "home").sortWithinPartitions("doc", "home", "diagonal", "pos")
    return ordered.mapInArrow(
        lambda batches: whole_groups(batches, 2, out),
        "doc long, home long, x0 int, x1 int, y0 int, y1 int, pieces array<int>"
    )


#: Words of the first text whose positions are held as bits at once.
LCS_BLOCK = 2048


def common_words(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a row of bits at a time.

    Blocks of the first text follow one another; a bit for each word of the second carries over from block to block.
    """
    if a == b:
        return len(a)
    total, carries = 0, bytearray(len(b))
    for at in range(0, len(a), LCS_BLOCK):
        block = a[at : at + LCS_BLOCK]
        places: dict[int, int] = {}
        for i, w in enumerate(block):
            places[w] = places.get(w, 0) | 1 << i
        size = len(block)
        full = (1 << size) - 1
        row = full
        for j, w in enumerate(b):
            hit = row & places.get(w, 0)
            if hit or carries[j]:
                added = row + hit + carries[j]
                carries[j] = added >> size
                row = (added | (row - hit)) & full
        total += size - row.bit_count()
    return total


def _diagonal(a: np.ndarray, b: np.ndarray) -> tuple[int, int, bool]:
    """How far two texts agree word by word from their start, the score there, and whether it has not dropped since."""
    n = min(len(a), len(b))
    if not n:
        return 0, 0, True
    score = np.cumsum(np.where(a[:n] == b[:n], 1, -1))
    fallen = np.flatnonzero(np.maximum.accumulate(np.maximum(score, 0)) - score > DROP)
    if len(fallen):
        score = score[: fallen[0]]
    best = len(score) - 1 - int(np.argmax(score[::-1]))  # the last of equal ones
    return (best + 1, int(score[best]), not len(fallen)) if score[best] >= 0 else (0, 0, not len(fallen))


def _extend(a: np.ndarray, b: np.ndarray, more_a: bool, more_b: bool) -> tuple[int, int, bool]:
    """How many words of each text an extension takes from their start, and whether it needs the words that a text has
    beyond those given.
    """
    i, j, kept = 0, 0, 0
    at = (0, 0)

    def stopped() -> tuple[int, int, bool]:
        short_a, short_b = len(a) - at[0] < SHIFT + AGREE, len(b) - at[1] < SHIFT + AGREE
        ended = (at[0] == len(a) and not more_a) or (at[1] == len(b) and not more_b)
        return *at, not ended and ((short_a and more_a) or (short_b and more_b))

    while True:
        n, score, open_ = _diagonal(a[i:], b[j:])
        if kept + score <= 0 and (i or j):
            return stopped()  # what follows the shift is not worth it
        i, j = i + n, j + n
        at, kept = (i, j), 0
        left, right = a[i : i + SHIFT + AGREE], b[j : j + SHIFT + AGREE]
        if open_ or min(len(left), len(right)) < AGREE:
            return stopped()
        same = left[:, None] == right[None, :]
        run = same[: 1 - AGREE, : 1 - AGREE].copy()
        for k in range(1, AGREE):
            run &= same[k : len(left) - AGREE + 1 + k, k : len(right) - AGREE + 1 + k]
        da, db = np.nonzero(run)
        if not len(da):
            return stopped()
        best = int(np.argmin(np.maximum(da, db) * 64 + da + db))
        i, j = i + int(da[best]), j + int(db[best])
        kept = -max(int(da[best]), int(db[best]))


def agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence; what the texts begin and end with alike is not searched."""
    n = min(len(a), len(b))
    apart = np.flatnonzero(a[:n] != b[:n])
    head = int(apart[0]) if len(apart) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    apart = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(apart[0]) if len(apart) else n
    return head + tail + common_words(a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist())


_RANGE = [T.StructField(n, T.IntegerType()) for n in ("start", "end", "home_start", "home_end", "n_matched")]
ALIGNED = T.StructType(
    [T.StructField("found", T.ArrayType(T.StructType(_RANGE))), T.StructField("goes_on", T.BooleanType())]
)


def _joined(a: np.ndarray, b: np.ndarray, pieces: list[list[int]]) -> list[list[int]]:
    """Pieces of a chain, those put together whose gap agrees enough."""
    out = [list(pieces[0])]
    for x0, x1, y0, y1 in pieces[1:]:
        last = out[-1]
        gap = max(x0 - last[1], y0 - last[3])
        if gap <= LARGEST_GAP or (gap <= WIDEST_GAP and 2 * agreeing(a[last[1] : x0], b[last[3] : y0]) >= gap):
            last[1], last[3] = x1, y1
        else:
            out.append([x0, x1, y0, y1])
    return out


def align_one(
    a: np.ndarray, b: np.ndarray, pieces: list[list[int]], more: tuple[bool, bool, bool, bool]
) -> tuple[list[list[int]], bool]:
    """Passages of two runs of words around a chain: (start, end, start, end, words that agree). ``more`` tells where
    the texts go on: before and after each.
    """
    parts, found, goes_on = _joined(a, b, pieces), [], False
    for i, (x0, x1, y0, y1) in enumerate(parts):
        first, last = i == 0, i == len(parts) - 1
        low_a, low_b = (0, 0) if first else (parts[i - 1][1], parts[i - 1][3])
        high_a, high_b = (len(a), len(b)) if last else (parts[i + 1][0], parts[i + 1][2])
        la, lb, on_left = _extend(a[low_a:x0][::-1], b[low_b:y0][::-1], first and more[0], first and more[1])
        ra, rb, on_right = _extend(a[x1:high_a], b[y1:high_b], last and more[2], last and more[3])
        goes_on |= on_left or on_right
        x0, x1, y0, y1 = x0 - la, x1 + ra, y0 - lb, y1 + rb
        found.append([x0, x1, y0, y1, agreeing(a[x0:x1], b[y0:y1])])
    return found, goes_on


@F.arrow_udf(ALIGNED)
def align(
    x0: pa.Array,
    x1: pa.Array,
    y0: pa.Array,
    y1: pa.Array,
    pieces: pa.Array,
    left: pa.Array,
    right: pa.Array,
    flank: pa.Array
) -> pa.Array:
    """Align each chain within the words around it. ``left`` and ``right`` begin ``flank`` words before the chain, or
    with the text.

    ``goes_on`` tells that the words around the chain were used up and the texts may agree beyond them.
    """
    found, goes_on = [], []
    for a0, a1, b0, b1, own, wa, wb, wide in zip(
        *(c.to_pylist() for c in (x0, x1, y0, y1, pieces, left, right, flank)), strict=True
    ):
        a, b = np.frombuffer(wa, dtype="<u4"), np.frombuffer(wb, dtype="<u4")
        at_a, at_b = max(a0 - wide, 0), max(b0 - wide, 0)
        more = (at_a > 0, at_b > 0, at_a + len(a) == a1 + wide, at_b + len(b) == b1 + wide)
        local = [
            [own[i] - at_a, own[i + 1] - at_a, own[i + 2] - at_b, own[i + 3] - at_b] for i in range(0, len(own), 4)
        ]
        parts, on = align_one(a, b, local, more)
        found.append(
            [
                dict(
                    zip(
                        ("start", "end", "home_start", "home_end", "n_matched"),
                        (s + at_a, e + at_a, t + at_b, f + at_b, n),
                        strict=True
                    )
                )
                for s, e, t, f, n in parts
            ]
        )
        goes_on.append(on)
    kind = pa.list_(pa.struct([(f.name, pa.int32()) for f in _RANGE]))
    return pa.StructArray.from_arrays([pa.array(found, kind), pa.array(goes_on, pa.bool_())], names=ALIGNED.names)


def word_codes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, words): 32-bit hashes of the words of each text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                words = Words(*text_buffers(column_of(part, "t")), lower=True)
                codes = (mix(words.hash) >> U(32)).astype("<u4")
                bounds = np.concatenate((words.first, [len(codes)])) * 4
                yield pa.RecordBatch.from_arrays(
                    [
                        column_of(part, "k"),
                        pa.BinaryArray.from_buffers(
                            pa.binary(),
                            part.num_rows,
                            [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(codes)]
                        )
                    ],
                    names=["k", "words"]
                )

    return docs.select(
        F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")
    ).mapInArrow(scan, "k long, words binary")


#: Chains whose texts agree to the last of their flanking words get so many times the words.
WIDEN = 8
PASSAGE = ("doc", "start", "end", "home", "home_start", "home_end", "n_matched", "identity")


def aligned(linked: DataFrame, coded: DataFrame, least_words: int, least_identity: float) -> DataFrame:
    """PASSAGE of the chains that are passages."""
    flank, parts = FLANK, []
    names = linked.columns
    while True:
        begin = lambda a: F.greatest(F.col(a) - flank, F.lit(0))  # noqa: B023, E731
        piece = lambda a, b: F.substring(F.col("words"), begin(a) * 4 + 1, (F.col(b) + flank - begin(a)) * 4)  # noqa: B023, E731
        left = linked.join(coded.withColumnRenamed("k", "doc"), "doc").select(*names, piece("x0", "x1").alias("left"))
        both = left.join(coded.withColumnRenamed("k", "home"), "home").select(
            *names, "left", piece("y0", "y1").alias("right")
        )
        rows = cut(
            both.select(*names, align("x0", "x1", "y0", "y1", "pieces", "left", "right", F.lit(flank)).alias("a")),
            "aligned"
        )
        parts.append(rows.where("not a.goes_on").select("doc", "home", F.inline("a.found")))
        linked = rows.where("a.goes_on").select(*names)
        if linked.isEmpty():
            break
        flank *= WIDEN
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    identity = F.col("n_matched") / F.greatest(F.col("end") - F.col("start"), F.col("home_end") - F.col("home_start"))
    return rows.withColumn("identity", F.round(identity, 6)).where(
        (F.col("n_matched") >= least_words) & (F.col("identity") >= least_identity)
    ).select(*PASSAGE)


def maximal(passages: DataFrame) -> DataFrame:
    """The passages of each two documents that lie within no other of theirs."""
    before = Window.partitionBy("doc", "home").orderBy(
        "start", F.desc("end"), F.desc("n_matched"), "home_start"
    ).rowsBetween(Window.unboundedPreceding, -1)
    return passages.withColumn("reach", F.max("end").over(before)).where(
        F.col("reach").isNull() | (F.col("reach") < F.col("end"))
    ).drop("reach")


def left_over(found: DataFrame, linked: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc, home, pos, hpos, width): runs of neighbouring shared seeds that no passage covers, each with the first
    document that has the run.

    Only runs whose seeds have several homes are listed, and only homes that the document has not been aligned with
    there.
    """
    held = [
        found.select(
            F.col(d).alias("doc"),
            F.lit(1).alias("kind"),
            F.col(p).alias("a"),
            F.col("seed").alias("b"),
            F.col("home").alias("c")
        )
        for d, p in (("doc", "pos"), ("home", "hpos"))
    ]
    done = [
        passages.select(
            F.col(d).alias("doc"),
            F.lit(0).alias("kind"),
            F.col(a).alias("a"),
            F.col(b).cast("long").alias("b"),
            F.lit(0).cast("long").alias("c")
        )
        for d, a, b in (("doc", "start", "end"), ("home", "home_start", "home_end"))
    ]
    rows = held[0].union(held[1].distinct()).union(done[0]).union(done[1].distinct())

    def runs(own: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        doc, kind, a, b, home = own
        keys, docs, places, widths = [], [], [], []
        # stretches of seeds that stand close to each other; passages come first in each document
        begins = np.union1d(_starts(doc, kind), np.flatnonzero(np.append(0, a[1:] - a[:-1]) > LARGEST_GAP))
        ends = np.append(begins[1:], len(doc)) - 1
        several = np.minimum.reduceat(home, begins) < np.maximum.reduceat(home, begins) if len(begins) else np.zeros(
            0, dtype=bool
        )
        long = np.flatnonzero((kind[begins] == 1) & several & (a[ends] + K - a[begins] >= LEAST_STRETCH))
        heads = _starts(doc)
        head = heads[np.searchsorted(heads, begins[long], side="right") - 1]
        for s, e, h in zip(begins[long].tolist(), ends[long].tolist(), head.tolist(), strict=True):
            pos, at = np.unique(a[s : e + 1], return_index=True)
            seed, of = b[s : e + 1][at].view(U), home[s : e + 1][at]
            first = h + int(np.searchsorted(kind[h:s], 1))
            start, reach = a[h:first], np.maximum.accumulate(b[h:first]) if first > h else b[:0]
            for m in RUNS:
                n = len(pos) - m + 1
                if n <= 0:
                    continue
                upto = pos[m - 1 :] + K
                near = np.searchsorted(start, pos[:n], side="right") - 1
                inside = (near >= 0) & (reach[near] >= upto) if len(start) else np.zeros(n, dtype=bool)
                tight = np.maximum.reduce([pos[k : n + k] - pos[k - 1 : n + k - 1] for k in range(1, m)]) <= 2 * WINDOW
                mixed = np.logical_or.reduce([of[k : n + k] != of[:n] for k in range(1, m)])
                keep = np.flatnonzero(~inside & tight & mixed)
                keys.append(shingle_hashes(seed, m)[keep] ^ U(m))
                docs.append(np.full(len(keep), doc[s]))
                places.append(pos[keep])
                widths.append((upto - pos[:n])[keep])
        if keys:
            columns = [
                np.concatenate(keys).view(np.int64),
                np.concatenate(docs),
                np.concatenate(places).astype(np.int32),
                np.concatenate(widths).astype(np.int32)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["run", "doc", "pos", "width"])

    sorted_rows = rows.select(
        "doc", "kind", F.col("a").cast("long"), "b", "c"
    ).repartition("doc").sortWithinPartitions("doc", "kind", "a")
    listed = cut(
        sorted_rows.mapInArrow(
            lambda batches: whole_groups(batches, 1, runs), "run long, doc long, pos int, width int"
        ),
        "runs"
    )
    homes = listed.groupBy("run").agg(
        F.min("doc").alias("home"), F.min_by("pos", F.struct("doc", "pos")).alias("hpos"), F.max("doc").alias("last")
    ).where("home <> last")
    again = listed.join(
        cut(homes.drop("last"), "homes"), "run"
    ).where("doc <> home").select("doc", "home", "pos", "hpos", "width").distinct()
    tried = linked.select(F.col("doc").alias("d"), F.col("home").alias("h"), "x0", "x1")
    return again.join(
        tried,
        (F.col("doc") == F.col("d"))
        & (F.col("home") == F.col("h"))
        & (F.col("pos") + FLANK >= F.col("x0"))
        & (F.col("pos") < F.col("x1") + FLANK),
        "left_anti"
    )


def fuzzy_passages(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least_words: int = LEAST_WORDS,
    least_identity: float = LEAST_IDENTITY
) -> DataFrame:
    """(key, start, end, home, home_start, home_end, n_matched, identity): a row for each passage of a document that
    an earlier one has too.
    """
    found = cut(matches(seeds(docs, key, text)), "matches")
    n = -F.col("pos")
    copies = found.where("pos < 0").groupBy("doc").agg(F.min("home").alias("home"), F.max("pos").alias("pos"))
    copies = cut(
        copies.select(
            "doc",
            F.lit(0).alias("start"),
            n.alias("end"),
            "home",
            F.lit(0).alias("home_start"),
            n.alias("home_end"),
            n.alias("n_matched"),
            F.lit(1.0).alias("identity")
        ),
        "copies"
    )
    other = cut(found.where("pos >= 0").join(copies.select("doc"), "doc", "left_anti"), "other")
    linked = cut(chains(other.withColumn("width", F.lit(K))), "chains")
    forget(found)

    own = docs.select(F.col(key).cast("long").alias(key), F.col(text))

    def words_of(some: DataFrame) -> DataFrame:
        ends = some.select(F.col("doc").alias("k")).union(some.select(F.col("home").alias("k"))).distinct()
        return cut(word_codes(own.join(ends, F.col(key) == F.col("k"), "left_semi"), key, text), "words")

    coded = words_of(linked)
    first = cut(aligned(linked, coded, least_words, least_identity), "passages")
    again = cut(chains(left_over(other, linked, first), 1), "chains-again")
    forget(coded)
    coded = words_of(again)
    second = cut(aligned(again, coded, least_words, least_identity), "passages-again")
    rows = maximal(first.union(second).distinct()).union(
        copies.where(F.col("n_matched") >= least_words).select(*PASSAGE)
    )
    rows = cut(rows.withColumnRenamed("doc", key), "fuzzy")
    for frame in (other, linked, coded, first, again, second, copies):
        forget(frame)
    return rows


def op1_fuzzy_passages(spark, sf_dir):
    """Passages of ``documents`` that repeat across documents."""
    from tremora.session import table

    return fuzzy_passages(
        table(spark, sf_dir, "documents").select("doc_id", "text")
    ).withColumnRenamed("home", "home_doc_id")
