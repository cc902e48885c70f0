"""Baseline JPEG as a media column: lossless byte payloads, a vectorised scan decoder, DC thumbnails.

A payload of whole 64-byte units becomes a grayscale baseline JPEG whose quantised coefficients carry the bytes: in
each 8x8 block, coefficient k in zigzag order is byte k as a signed number. DC terms are coded as differences within a
row of blocks, AC terms as runs of zeros and sizes with a Huffman table made for text, and each row of blocks is a
restart interval. Huffman coding of coefficients is exact, so the file holds the payload without loss. The decoder is
not tied to that form: it parses the markers of any baseline file with one component and any Huffman tables and
decodes all restart intervals of a slice of rows in lockstep, one symbol of every interval at a time in numpy. Files
with several components, sampling factors or scans are decoded one at a time, and their luminance is kept.

Defined results: a null text counts as empty and yields one unit of zero bytes. A malformed or progressive file raises
ValueError in ``decode``; ``jpeg_features`` gives such a file, and a null, null features and the reason in ``error``.
A file without stored payload has null payload fields. Equal texts give equal files and features.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremora.llm.textscan import U, array_slices, text_buffers

UNIT = 64
DC_QUANT = 8
MEDIA_SLICE = 512 << 10

#: Fixed values of the format: coefficient order within a block.
ZIGZAG = np.array(
    [
        r * 8 + c
        for s in range(15)
        for r, c in sorted(((r, s - r) for r in range(8) if 0 <= s - r < 8), key=lambda x: x[0] if s % 2 else x[1])
    ]
)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def _grid(units: int) -> tuple[int, int]:
    """Blocks across and down that hold so many units."""
    across = int(np.ceil(np.sqrt(units)))
    return across, -(-units // across)


def _huffman_table(lengths: dict[int, int]) -> bytes:
    """Counts of codes by length and the symbols in order of length, as a file states them."""
    return bytes(
        sum(n == bits for n in lengths.values()) for bits in range(1, 17)
    ) + bytes(sorted(lengths, key=lambda x: (lengths[x], x)))


def _text_lengths() -> dict[int, int]:
    """Code lengths of (zeros before << 4 | size): ASCII letters are of size 7, other ASCII signs of size 6, further
    bytes of size 6 to 8.
    """
    common = {0x07: 1, 0x06: 2, 0x08: 4, 0x00: 5, 0x05: 6, 0x17: 7, 0x04: 8}
    rare = {run << 4 | size: 16 if run else 10 for run in range(16) for size in range(1, 9)} | {0xF0: 12}
    return rare | common


#: Differences of DC terms are of size 9 at most.
DC_TABLE = _huffman_table({size: 4 for size in range(10)})
AC_TABLE = _huffman_table(_text_lengths())


def _codes(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(code, its length) of each symbol."""
    code, bits = np.zeros(256, dtype=np.int32), np.zeros(256, dtype=np.int32)
    value, at = 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            code[table[at]], bits[table[at]] = value, length
            value, at = value + 1, at + 1
        value <<= 1
    return code, bits


#: Bits of the amounts 0 to 511.
_SIZE = np.array([n.bit_length() for n in range(512)], dtype=np.int32)


def _header(units: int, across: int, down: int) -> bytes:
    return b"".join((
        b"\xff\xd8",
        _segment(0xFE, b"units=%d" % units),
        _segment(0xDB, bytes((0, DC_QUANT, *[1] * 63))),
        _segment(0xC0, b"\x08" + (down * 8).to_bytes(2, "big") + (across * 8).to_bytes(2, "big") + b"\x01\x01\x11\x00"),
        _segment(0xC4, b"\x00" + DC_TABLE + b"\x10" + AC_TABLE),
        _segment(0xDD, across.to_bytes(2, "big")),
        _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ))


def encode(payloads: list[bytes]) -> list[bytes]:
    """A JPEG file for each payload of whole units."""
    sizes = [len(p) // UNIT for p in payloads]
    grids = [_grid(n) for n in sizes]
    blocks = [a * d for a, d in grids]
    raw = np.zeros((sum(blocks), UNIT), dtype=np.uint8)
    at = 0
    for payload, n, total in zip(payloads, sizes, blocks, strict=True):
        raw[at : at + n] = np.frombuffer(payload, dtype=np.uint8).reshape(n, UNIT)
        at += total
    # every row of blocks of a file is an interval
    interval_blocks = np.repeat([a for a, _ in grids], [d for _, d in grids])
    interval_at = np.cumsum(interval_blocks) - interval_blocks
    stuffed, begin = _entropy_coded(raw.view(np.int8).astype(np.int32), interval_at, interval_blocks)
    file_first = np.cumsum([0, *(d for _, d in grids)])
    number = np.arange(len(interval_at)) - np.repeat(file_first[:-1], np.diff(file_first))
    marks = np.stack((np.full(len(interval_at), 0xFF), 0xD0 | number % 8), axis=1).astype(np.uint8)
    marks[file_first[1:] - 1, 1] = 0xD9  # the last interval of a file ends it
    flat = np.insert(stuffed, np.repeat(begin[1:], 2), marks.ravel())
    ends = (begin + 2 * np.arange(len(begin)))[file_first]
    return [
        _header(n, a, d) + flat[s:e].tobytes() for n, (a, d),
        s,
        e in zip(sizes, grids, ends[:-1], ends[1:], strict=True)
    ]


def _entropy_coded(
    values: np.ndarray, interval_at: np.ndarray, interval_blocks: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The coded bytes of all blocks, zeros stuffed, and where each interval begins in them (and the last ends)."""
    dc_code, dc_bits = _codes(DC_TABLE)
    ac_code, ac_bits = _codes(AC_TABLE)
    rows = len(values)
    # a place for each coefficient, and the end of the block
    code, bits = np.zeros((rows, 65), dtype=np.int32), np.zeros((rows, 65), dtype=np.int32)
    step = np.diff(values[:, 0], prepend=np.int32(0))
    step[interval_at] = values[interval_at, 0]
    values = values.copy()
    values[:, 0] = step
    size = _SIZE[np.abs(values)]
    amount = values + (values < 0) * ((1 << size) - 1)
    code[:, 0], bits[:, 0] = dc_code[size[:, 0]] << size[:, 0] | amount[:, 0], dc_bits[size[:, 0]] + size[:, 0]
    place = np.arange(64, dtype=np.int32)
    there = values != 0
    there[:, 0] = True  # runs of zeros begin behind the DC term
    last = np.maximum.accumulate(np.where(there, place, 0), axis=1)
    run = np.zeros((rows, 64), dtype=np.int32)
    run[:, 1:] = place[1:] - last[:, :-1] - 1
    symbol = (run & 15) << 4 | size
    ac = slice(1, 64)
    code[:, ac] = np.where(there, ac_code[symbol] << size | amount, 0)[:, ac]
    bits[:, ac] = np.where(there, ac_bits[symbol] + size, 0)[:, ac]
    # the sixteenth zero of a run that goes on to another coefficient
    full = ~there & (run & 15 == 15) & (place < last[:, -1:])
    if full.any():
        code[:, :64][full], bits[:, :64][full] = ac_code[0xF0], ac_bits[0xF0]
    open_ = last[:, -1] < 63
    code[open_, 64], bits[open_, 64] = ac_code[0], ac_bits[0]

    per_block = bits.sum(axis=1, dtype=np.int64)
    total = np.add.reduceat(per_block, interval_at)
    fill = -total % 8  # ones up to a whole byte
    begin = np.concatenate(([0], np.cumsum((total + fill) // 8)))
    shift = np.repeat(8 * begin[:-1] - (np.cumsum(total) - total), interval_blocks)
    some = np.flatnonzero(bits.ravel())
    code, bits = code.ravel()[some].astype(np.int64), bits.ravel()[some].astype(np.int64)
    at = np.cumsum(bits) - bits + shift[some // 65]
    at, code, bits = np.concatenate(
        (at, 8 * begin[:-1] + total)
    ), np.concatenate((code, (1 << fill) - 1)), np.concatenate((bits, fill))
    # tokens are of 24 bits at most: each lies in one or two words of 32
    word, code = at >> 5, code << (64 - bits - (at & 31)).clip(max=63)
    code = code.view(np.uint64)
    n = int(begin[-1]) // 4 + 2
    high = np.bincount(word, weights=(code >> U(32)).astype(np.float64), minlength=n)
    low = np.bincount(word + 1, weights=(code & U(0xFFFFFFFF)).astype(np.float64), minlength=n)
    out = (high[:n] + low[:n]).astype(">u4").view(np.uint8)[: int(begin[-1])]
    full = out == 0xFF
    stuffed = np.insert(out, np.flatnonzero(full) + 1, 0)
    return stuffed, begin + np.concatenate(([0], np.cumsum(full)))[begin]


class Frame:
    """Markers of one file."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        self.tables: dict[int, bytes] = {}
        self.restart, self.comment, self.quant, at = 0, b"", {}, 2
        while True:
            if at + 4 > len(data) or data[at] != 0xFF:
                raise ValueError("broken marker")
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xC0:
                self.height, self.width, self.components = int.from_bytes(
                    body[1:3], "big"
                ), int.from_bytes(body[3:5], "big"), body[5]
                self.table = body[8]
                if body[0] != 8 or self.components != 1:
                    raise ValueError("only grayscale of 8 bits")
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not baseline")
            elif marker == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    self.tables[body[0]], body = body[1:n], body[n:]
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    n = 1 + 64 * (1 + wide)
                    self.quant[body[0] & 15], body = np.frombuffer(
                        body[1:n], dtype=">u2" if wide else np.uint8
                    ), body[n:]
            elif marker == 0xDD:
                self.restart = int.from_bytes(body[:2], "big")
            elif marker == 0xFE:
                self.comment = body
            elif marker == 0xDA:
                self.dc, self.ac = self.tables[body[2] >> 4], self.tables[0x10 | (body[2] & 15)]
                self.scan = at
                break
        self.across, self.down = -(-self.width // 8), -(-self.height // 8)

    @property
    def blocks(self) -> int:
        return self.across * self.down

    @property
    def intervals(self) -> int:
        return -(-self.blocks // self.restart) if self.restart else 1


def _lookup(table: bytes) -> np.ndarray:
    """For every 16 bits: the length of the code that they start with * 256 + its symbol; 0 where there is none."""
    out = np.zeros(1 << 16, dtype=np.uint16)
    code, at = 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _extend(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Signed values of amplitude bits."""
    return np.where(bits < (1 << np.maximum(size, 1) >> 1), bits - (1 << size) + 1, bits)


def _decode_alike(frames: list[Frame], files: list[bytes]) -> list[np.ndarray]:
    """Coefficients in zigzag order, a row for each block, of files that share Huffman tables."""
    dc, ac = _lookup(frames[0].dc), _lookup(frames[0].ac)
    parts = []
    for frame, data in zip(frames, files, strict=True):
        scan = np.frombuffer(data, dtype=np.uint8)[frame.scan :]
        parts.append(scan)
    stream = np.concatenate(parts)
    lead = np.flatnonzero(stream[:-1] == 0xFF)
    follow = stream[lead + 1]
    keep = np.ones(len(stream), dtype=bool)
    keep[lead[follow == 0] + 1] = False
    is_restart = (follow >= 0xD0) & (follow <= 0xD7)
    is_end = follow == 0xD9
    # in one file's entropy-coded data 0xFF precedes only 0, a restart marker or the end
    cuts = lead[is_restart | is_end]
    base = np.cumsum([0, *map(len, parts)])
    keep[cuts] = keep[cuts + 1] = False
    position = np.cumsum(keep) - keep
    starts = np.concatenate((base[:-1], lead[is_restart] + 2))
    starts.sort()
    lanes = position[starts].astype(np.int64) * 8
    owner = np.searchsorted(base, starts, side="right") - 1
    wanted = np.array([f.intervals for f in frames])
    if not np.array_equal(np.bincount(owner, minlength=len(frames)), wanted):
        raise ValueError("restart markers don't match the frame")
    data = np.concatenate((stream[keep], np.full(8, 0xFF, dtype=np.uint8)))
    words = data[:-3].astype(np.uint32)
    words = words << 24 | data[1:-2].astype(np.uint32) << 16 | data[2:-1].astype(np.uint32) << 8 | data[3:]
    limit = len(words) - 1

    def peek(at: np.ndarray, n) -> np.ndarray:
        """n bits, 16 at most."""
        return (
            words[np.minimum(at >> 3, limit)] >> (32 - n - (at & 7)).astype(np.uint32) & ((1 << n) - 1)
        ).astype(np.int64)

    restart = np.array([f.restart or f.blocks for f in frames])[owner]
    number = np.arange(len(starts)) - np.concatenate(([0], np.cumsum(wanted)))[owner]
    first_block = np.concatenate(([0], np.cumsum([f.blocks for f in frames])))[owner] + number * restart
    n_blocks = np.minimum(restart, np.array([f.blocks for f in frames])[owner] - number * restart)
    out = np.zeros((sum(f.blocks for f in frames), 64), dtype=np.int16)
    predictor = np.zeros(len(lanes), dtype=np.int64)

    def symbol(at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        entry = table[peek(at, 16)].astype(np.int64)
        if len(entry) and not entry.all():
            raise ValueError("no such code")
        return at + (entry >> 8), entry & 255

    for step in range(int(n_blocks.max(initial=0))):
        active = np.flatnonzero(n_blocks > step)
        block = first_block[active] + step
        at, size = symbol(lanes[active], dc)
        predictor[active] += _extend(peek(at, size), size)
        out[block, 0] = predictor[active]
        at = at + size
        k = np.zeros(len(active), dtype=np.int64)
        live = np.arange(len(active))
        while len(live):
            here, code = symbol(at[live], ac)
            run, size = code >> 4, code & 15
            k[live] += run + 1
            ended = code == 0
            inside = ~ended & (k[live] < 64) & (size > 0)
            out[block[live[inside]], k[live[inside]]] = _extend(peek(here[inside], size[inside]), size[inside])
            at[live] = here + size
            if ((k[live] > 63) & ~ended).any():
                raise ValueError("too many coefficients")
            live = live[~ended & (k[live] < 63)]
        lanes[active] = at
    if len(cuts) == len(starts) and (lanes > position[cuts] * 8).any():
        raise ValueError("the data end early")
    return np.split(out, np.cumsum([f.blocks for f in frames])[:-1])


def decode(files: list[bytes]) -> tuple[list[Frame], list[np.ndarray]]:
    """Frames and quantised coefficients of the files; files with equal tables are decoded together."""
    frames = [Frame(x) for x in files]
    groups: dict[tuple[bytes, bytes], list[int]] = {}
    for i, frame in enumerate(frames):
        groups.setdefault((frame.dc, frame.ac), []).append(i)
    out: list[np.ndarray] = [np.zeros((0, 64), dtype=np.int16)] * len(files)
    for own in groups.values():
        for i, blocks in zip(own, _decode_alike([frames[i] for i in own], [files[i] for i in own]), strict=True):
            out[i] = blocks
    return frames, out


class Picture:
    """Luminance (the first component) of one baseline file with any components, sampling factors and scans."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        tables: dict[int, list[int]] = {}
        self.quant: dict[int, np.ndarray] = {}
        self.comment, self.table, self.coefficients, parts, restart, at = b"", 0, None, {}, 0, 2
        tables_seen: dict[int, np.ndarray] = {}
        while data[at : at + 2] != b"\xff\xd9":
            if at + 4 > len(data) or data[at] != 0xFF:
                raise ValueError("broken marker")
            marker = data[at + 1]
            if marker == 0xFF:  # a fill byte
                at += 1
                continue
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker in (0xC0, 0xC1):
                self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                if body[0] != 8 or not self.height or not self.width:
                    raise ValueError("only 8 bits and a stated size")
                parts = {
                    body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i])
                    for i in range(body[5])
                }
                if not parts or not all(1 <= h <= 4 and 1 <= v <= 4 for h, v, _ in parts.values()):
                    raise ValueError("broken frame")
                self.first = body[6]
                self.h_most, self.v_most = max(p[0] for p in parts.values()), max(p[1] for p in parts.values())
                self.across, self.down = self._blocks(parts[self.first])
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not baseline")
            elif marker == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    tables[body[0]], body = _lookup(body[1:n]).tolist(), body[n:]
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    n = 1 + 64 * (1 + wide)
                    tables_seen[body[0] & 15], body = np.frombuffer(
                        body[1:n], dtype=">u2" if wide else np.uint8
                    ), body[n:]
            elif marker == 0xDD:
                restart = int.from_bytes(body[:2], "big")
            elif marker == 0xFE:
                self.comment = body
            elif marker == 0xDA:
                own = [
                    (body[1 + 2 * i], tables[body[2 + 2 * i] >> 4], tables[0x10 | body[2 + 2 * i] & 15])
                    for i in range(body[0])
                ]
                at = self._scan(data, at, own, parts, restart)
                if any(name == self.first for name, _, _ in own):
                    self.quant = {0: tables_seen[parts[self.first][2]]}
        if self.coefficients is None:
            raise ValueError("no luminance")

    def _blocks(self, part: tuple[int, int, int]) -> tuple[int, int]:
        return -(-(-(-self.width * part[0] // self.h_most)) // 8), -(-(-(-self.height * part[1] // self.v_most)) // 8)

    def _scan(self, data: bytes, at: int, own: list, parts: dict, restart: int) -> int:
        """Decode one scan and return where it ends."""
        segments, begin = [], at
        while True:
            at = data.find(b"\xff", at)
            if at < 0 or at + 1 >= len(data):
                raise ValueError("the data end early")
            if data[at + 1] == 0 or data[at + 1] == 0xFF:
                at += 2 if data[at + 1] == 0 else 1
                continue
            segments.append(data[begin:at].replace(b"\xff\x00", b"\xff"))
            if not 0xD0 <= data[at + 1] <= 0xD7:
                break
            at = begin = at + 2
        alone = len(own) == 1
        if alone:
            columns, lines = self._blocks(parts[own[0][0]])
        else:
            columns, lines = -(-self.width // (8 * self.h_most)), -(-self.height // (8 * self.v_most))
        units = columns * lines
        step = restart or units
        if len(segments) != -(-units // step):
            raise ValueError("restart markers don't match the frame")
        layout = [
            (name == self.first, 1 if alone else parts[name][0], 1 if alone else parts[name][1], dc, ac)
            for name, dc, ac in own
        ]
        wide = next((h for kept, h, _, _, _ in layout if kept), 0) * columns
        tall = next((v for kept, _, v, _, _ in layout if kept), 0) * lines
        out = np.zeros((tall, wide, 64), dtype=np.int16)
        for number, raw in enumerate(segments):
            limit, pos, last = 8 * len(raw), 0, [0] * len(layout)
            raw += b"\xff" * 8
            for unit in range(number * step, min(units, (number + 1) * step)):
                line, column = divmod(unit, columns)
                for i, (kept, h, v, dc, ac) in enumerate(layout):
                    for y in range(v):
                        for x in range(h):
                            k = 0
                            while k < 64:
                                bits = int.from_bytes(raw[pos >> 3 : (pos >> 3) + 5], "big") << (pos & 7) & 0xFFFFFFFFFF
                                entry = (ac if k else dc)[bits >> 24]
                                if not entry:
                                    raise ValueError("no such code")
                                length, code = entry >> 8, entry & 255
                                size = code & 15 if k else code
                                if size > 15:
                                    raise ValueError("too large a value")
                                value = bits >> (40 - length - size) & ((1 << size) - 1)
                                pos += length + size
                                if pos > limit:
                                    raise ValueError("the data end early")
                                if size and value < 1 << (size - 1):
                                    value -= (1 << size) - 1
                                if not k:
                                    last[i] += value
                                    value = last[i]
                                elif not code:
                                    break
                                else:
                                    k += code >> 4
                                    if k > 63:
                                        raise ValueError("too many coefficients")
                                if kept:
                                    out[line * v + y, column * h + x, k] = value
                                k += 1
        if any(kept for kept, *_ in layout):
            self.coefficients = out[: self.down, : self.across].reshape(-1, 64)
        return at


def read(files: list[bytes | None]) -> list[tuple[Frame | Picture, np.ndarray] | str]:
    """Frame and luminance coefficients of each file, or why it cannot be decoded; one file doesn't affect another."""
    out: list = ["no file"] * len(files)
    frames: dict[tuple[bytes, bytes], list[tuple[int, Frame]]] = {}
    rest = []
    broken = (ValueError, KeyError, IndexError, OverflowError)
    for i, data in enumerate(files):
        if data is None:
            continue
        try:
            frame = Frame(data)
            # one scan to the end, or the lanes of other files would be read
            if data.find(b"\xff\xd9", frame.scan) != len(data) - 2 or not frame.blocks:
                raise ValueError("more than one scan")
            frames.setdefault((frame.dc, frame.ac), []).append((i, frame))
        except broken:
            rest.append(i)
    groups = list(frames.values())
    while groups:
        group = groups.pop()
        try:
            for (i, frame), blocks in zip(
                group, _decode_alike([f for _, f in group], [files[i] for i, _ in group]), strict=True
            ):
                out[i] = frame, blocks
        except broken:
            if len(group) == 1:
                rest.append(group[0][0])
            else:  # the halves, so that a damaged file ends up alone
                groups += [group[: len(group) // 2], group[len(group) // 2 :]]
    for i in rest:
        try:
            picture = Picture(files[i])
            out[i] = picture, picture.coefficients
        except broken as e:
            out[i] = str(e) or "broken file"
    return out


def thumbnail(frame: Frame, blocks: np.ndarray) -> np.ndarray:
    """Luminance at an eighth of the size, from DC coefficients alone."""
    dc = blocks[:, 0].astype(np.float64) * float(frame.quant[frame.table][0]) / 8 + 128
    return np.clip(np.rint(dc), 0, 255).astype(np.uint8).reshape(frame.down, frame.across)


def thumbnail_hash(pixels: np.ndarray) -> str:
    """64 bits: which cells of an 8x8 reduction are brighter than their mean."""
    rows = np.linspace(0, pixels.shape[0], 9).astype(int)
    columns = np.linspace(0, pixels.shape[1], 9).astype(int)
    total = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1))
    total[1:, 1:] = pixels.astype(np.float64).cumsum(axis=0).cumsum(axis=1)
    low_r, low_c = np.minimum(rows[:-1], pixels.shape[0] - 1), np.minimum(columns[:-1], pixels.shape[1] - 1)
    high_r, high_c = np.maximum(rows[1:], low_r + 1), np.maximum(columns[1:], low_c + 1)
    area = (high_r - low_r)[:, None] * (high_c - low_c)[None, :]
    cells = (
        total[
            np.ix_(high_r, high_c)
        ] - total[np.ix_(low_r, high_c)] - total[np.ix_(high_r, low_c)] + total[np.ix_(low_r, low_c)]
    ) / area
    return np.packbits(cells.ravel() > cells.mean()).tobytes().hex()


def payload_of(frame: Frame, blocks: np.ndarray) -> bytes:
    """The payload that ``encode`` stored."""
    units = int(frame.comment.removeprefix(b"units="))
    return blocks[:units].astype(np.int8).tobytes()


@F.arrow_udf(T.BinaryType())
def text_to_jpeg(column: pa.Array) -> pa.Array:
    """Texts as JPEG files, padded with zero bytes to whole units."""
    out: list[bytes] = []
    for part in array_slices(column, MEDIA_SLICE):
        data, offsets = text_buffers(part)
        raw = data.tobytes()
        texts = [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        out += encode([t + bytes(-len(t) % UNIT if t else UNIT) for t in texts])
    return pa.array(out, pa.binary())


FEATURES = T.StructType(
    [
        T.StructField(n, t) for n, t in (
            ("payload_bytes", T.LongType()),
            ("payload_sha256", T.StringType()),
            ("tail_crc32", T.LongType()),
            ("media_bytes", T.LongType()),
            ("media_sha256", T.StringType()),
            ("width", T.IntegerType()),
            ("height", T.IntegerType()),
            ("feature", T.StringType()),
            ("error", T.StringType())
        )
    ]
)


@F.arrow_udf(FEATURES)
def jpeg_features(column: pa.Array) -> pa.Array:
    """What a stored file holds: payload digests, dimensions and the hash of its thumbnail."""
    rows: dict[str, list] = {f.name: [] for f in FEATURES}
    for part in array_slices(column, 2 * MEDIA_SLICE):
        files = part.to_pylist()
        for data, found in zip(files, read(files), strict=True):
            if isinstance(found, str):
                values = (*[None] * (len(rows) - 1), found)
            else:
                frame, blocks = found
                small = thumbnail(frame, blocks)
                stored = (None, None, None)
                if frame.comment.startswith(b"units=") and frame.comment[6:].isdigit():
                    payload = payload_of(frame, blocks)
                    stored = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]))
                values = (
                    *stored,
                    len(data),
                    hashlib.sha256(data).hexdigest(),
                    frame.width,
                    frame.height,
                    f"{frame.width}x{frame.height}:{thumbnail_hash(small)}:{zlib.crc32(small.tobytes()):08x}",
                    None
                )
            for name, value in zip(rows, values, strict=True):
                rows[name].append(value)
    kinds = [
        pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()
    ]
    return pa.StructArray.from_arrays(
        [pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], names=list(rows)
    )


def with_media(docs: DataFrame, text: str = "text", into: str = "media") -> DataFrame:
    """The input's rows with each text stored as a JPEG file; a column named ``into`` is replaced."""
    return docs.withColumn(into, text_to_jpeg(F.coalesce(F.col(text), F.lit(""))))


def with_features(media: DataFrame, column: str = "media", into: str = "media_features") -> DataFrame:
    """Decode a media column and add what it holds."""
    return media.withColumn(into, jpeg_features(F.col(column)))


def op10_jpeg_media(spark, sf_dir):
    """Every text of ``documents`` through the media column and back."""
    from tremora.session import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    media = with_media(docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")))
    found = with_features(media.select("doc_id", "n_bytes", "media"))
    return found.select(
        "doc_id", "n_bytes", *(F.col("media_features")[f.name].alias(f.name) for f in FEATURES if f.name != "error")
    )
