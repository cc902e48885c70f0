"""Secret scan with structural confirmation.

Patterns find the base spans (credential assignments, access keys, long hex runs). Beyond these, base64 and hex
candidates are decoded and reported only if their structure holds: DER private keys whose nested lengths add up (plain
or encrypted), OpenSSH key blobs whose length-prefixed fields fit, signed tokens whose header and payload are JSON
objects. Keys are looked for wherever their first bytes stand: behind other characters, wrapped over lines, between
armour lines, as base64 of an armoured key, with colons between hex digits. Texts are scanned whole and in linear
time, a slice of a partition at a time.

Defined results: a null or empty text has no spans. Spans of one kind never overlap. Matching is per row, so repeated
rows get equal spans, and other columns of the input pass through untouched.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremora.llm.textscan import IS_SPACE, Words, array_slices, code_point_ranks, text_buffers

#: Kinds in the order of ties. The first three are the base kinds.
KINDS = ("assign", "access", "hex", "private_key", "hex_key", "signed_token")
SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType())
        ]
    )
)

ASSIGN = re.compile(
    rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
DOTTED = re.compile(rb"[A-Za-z0-9_.-]+")
ARMOUR = re.compile(
    rb"-----BEGIN ([A-Z0-9 ]{0,40})PRIVATE KEY-----((?:\s*[A-Za-z-]{1,40}: [^\r\n-]*(?=[\r\n]))*)([A-Za-z0-9+/=\s\\]+)-----END \1PRIVATE KEY-----"
)
#: How the DER of a key begins: a sequence of a version, or (encrypted keys) of a sequence that names a cipher; in
#: base64 and in hex.
DER_BASE64 = re.compile(
    rb"M(?=(?:II[A-Za-z0-9+/_-]{2}(?:[AQgw]IB|[DTjz][A-D])|I[GH][A-Za-z0-9+/_-](?:AgE|M)|[A-H][A-Za-z0-9+/_-](?:CAQ|w))[A-Za-z0-9+/_-]{8})"
)
DER_HEX = re.compile(
    rb"3(?=0(?:82[0-9A-Fa-f]{4}|81[0-9A-Fa-f]{2}|[0-7][0-9A-Fa-f])(?:02010[0-9]|30(?:82[0-9A-Fa-f]{4}|81[0-9A-Fa-f]{2}|[0-7][0-9A-Fa-f])0609))"
)
DER_COLONS = re.compile(
    rb"3(?=0:(?:82:[0-9A-Fa-f]{2}:[0-9A-Fa-f]{2}|81:[0-9A-Fa-f]{2}|[0-7][0-9A-Fa-f]):(?:02:01:0[0-9]|30:(?:82:[0-9A-Fa-f]{2}:[0-9A-Fa-f]{2}|81:[0-9A-Fa-f]{2}|[0-7][0-9A-Fa-f]):06:09))"
)
OPENSSH, NESTED = b"b3BlbnNzaC1rZXktdjE", b"LS0tLS1CRUdJTi"
OPENSSH_BASE64, BASE64 = re.compile(OPENSSH), re.compile(rb"[A-Za-z0-9+/_-]*={0,2}")
#: The object identifiers of password-based encryption (PKCS#5 and PKCS#12) begin so.
CIPHERS = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
#: The shortest candidate that lies within one run of characters other than white space.
LEAST_RUN = 20
#: No private key has as many elements, or keys in a container.
MOST_ELEMENTS = 16
LEAST_SECRET = 6


def from_base64(text: bytes) -> bytes | None:
    """Standard or URL-safe base64, padded or not."""
    text = text.rstrip(b"=").translate(bytes.maketrans(b"-_", b"+/"))
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + b"=" * (-len(text) % 4), validate=True)
    except (ValueError, binascii.Error):
        return None


def der_elements(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the elements that fill data[start:end] exactly, or None."""
    found = []
    while start < end:
        if end - start < 2:
            return None
        tag, size, at = data[start], data[start + 1], start + 2
        if size & 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > end:
                return None
            size, at = int.from_bytes(data[at : at + width], "big"), at + width
        if at + size > end:
            return None
        found.append((tag, at, at + size))
        start = at + size
    return found


def is_private_key(data: bytes) -> bool:
    """DER of PKCS#1, PKCS#8 (plain or encrypted) or SEC1 private keys, or an OpenSSH key container."""
    if data.startswith(b"openssh-key-v1\x00"):
        at = 15
        for _ in range(3):  # cipher, key derivation and its options
            if at + 4 > len(data):
                return False
            at += 4 + int.from_bytes(data[at : at + 4], "big")
        return at + 4 <= len(data)
    outer = der_elements(data, 0, len(data)) if data[:1] == b"\x30" else None
    if not outer or len(outer) != 1:
        return False
    inner = der_elements(data, outer[0][1], outer[0][2])
    if not inner:
        return False
    tags = [tag for tag, _, _ in inner]
    if tags == [0x30, 0x04]:  # cipher and what it encrypts
        cipher = der_elements(data, inner[0][1], inner[0][2])
        return bool(cipher) and cipher[0][0] == 0x06 and data[
            cipher[0][1] : cipher[0][2]
        ].startswith(CIPHERS) and inner[1][2] - inner[1][1] >= 16
    if tags[0] != 0x02 or inner[0][2] - inner[0][1] != 1:
        return False
    if len(tags) >= 9 and tags[:9] == [0x02] * 9:  # version and eight numbers
        return True
    if len(tags) >= 3 and tags[1:3] == [0x30, 0x04]:  # algorithm and key
        algorithm = der_elements(data, inner[1][1], inner[1][2])
        return bool(algorithm) and algorithm[0][0] == 0x06
    return len(tags) >= 2 and tags[1] == 0x04 and inner[1][2] - inner[1][1] >= 16


def is_signed_token(text: bytes) -> bool:
    """Header and payload are JSON objects, the header names an algorithm and the signature decodes."""
    head, body, signature = text.split(b".")
    parts = [from_base64(x) for x in (head, body, signature)]
    if None in parts:
        return False
    try:
        header, payload = (json.loads(x) for x in parts[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(payload, dict)


def _run_spans(run: bytes) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) in a run without white space."""
    for match in ACCESS.finditer(run):
        yield 1, *match.span()
    for match in HEX.finditer(run):
        yield 2, *match.span()
    if run.count(b".") >= 2:
        for match in DOTTED.finditer(run):
            yield from _tokens(match[0], match.start())


def _tokens(dotted: bytes, base: int) -> Iterator[tuple[int, int, int]]:
    """Signed tokens among the parts between dots. A header may follow other characters: it begins with its base64
    brace.
    """
    parts = dotted.split(b".")
    starts = [0]
    for part in parts:
        starts.append(starts[-1] + len(part) + 1)
    free = 0
    for i in range(len(parts) - 2):
        if i < free or len(parts[i + 1]) < 2 or len(parts[i + 2]) < 8:
            continue
        for at in sorted({0, max(parts[i].find(b"eyJ"), 0), max(parts[i].rfind(b"eyJ"), 0)}):
            head = parts[i][at:]
            if len(head) >= 8 and head[:1] == b"e" and is_signed_token(b".".join((head, parts[i + 1], parts[i + 2]))):
                yield 5, base + starts[i] + at, base + starts[i + 3] - 1
                free = i + 3
                break


def _heads(byte: Callable, which: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """(fits, tag, start, stop) of the element whose head stands at each position, read a few bytes at a time."""
    tag, size = byte(which, at), byte(which, at + 1)
    width = np.where(size & 0x80, size & 0x7F, 0)
    fits = (at + 2 + width <= end) & (width <= 4) & (size != 0x80)
    number = np.zeros(len(at), dtype=np.int64)
    for k in range(4):
        number = np.where(k < width, number << 8 | byte(which, at + 2 + k), number)
    start = at + 2 + width
    stop = start + np.where(width > 0, number, size)
    return fits & (stop <= end), tag, start, stop


def _walk(byte: Callable, which: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """(number, tags, starts, stops) of the elements that fill each range exactly; the number is 0 where they don't or
    are more than any key has. Only heads are read, so a range costs the same whatever it claims to hold.
    """
    n = len(which)
    number, alive = np.zeros(n, dtype=np.int64), np.arange(n)
    tags, starts, stops = (np.full((n, MOST_ELEMENTS), -1, dtype=np.int64) for _ in range(3))
    at = at.copy()
    for k in range(MOST_ELEMENTS):
        fits, tag, start, stop = _heads(byte, which[alive], at[alive], end[alive])
        alive = alive[fits]
        tags[alive, k], starts[alive, k], stops[alive, k] = tag[fits], start[fits], stop[fits]
        at[alive] = stop[fits]
        done = at[alive] == end[alive]
        number[alive[done]] = k + 1
        alive = alive[~done]
        if not len(alive):
            break
    return number, tags, starts, stops


def _names(byte: Callable, which: np.ndarray, at: np.ndarray, names: tuple[bytes, ...]) -> np.ndarray:
    """Whether one of the names stands at each position."""
    found = np.zeros(len(which), dtype=bool)
    for name in names:
        same = np.ones(len(which), dtype=bool)
        for k, b in enumerate(name):
            same &= byte(which, at + k) == b
        found |= same
    return found


def der_key_sizes(byte: Callable[[np.ndarray, np.ndarray], np.ndarray], room: np.ndarray) -> np.ndarray:
    """Bytes of the private key (as in ``is_private_key``) that begins at each candidate, 0 where none does.

    ``byte(which, at)`` reads bytes of candidates, ``room`` says how many each has. All candidates are walked together,
    head by head; no body is read.
    """
    which = np.arange(len(room))
    sizes = np.zeros(len(room), dtype=np.int64)
    fits, tag, start, stop = _heads(byte, which, np.zeros(len(room), dtype=np.int64), room)
    which, start, stop = (x[fits & (tag == 0x30)] for x in (which, start, stop))
    number, tags, starts, stops = _walk(byte, which, start, stop)
    sealed = (number == 2) & (tags[:, 0] == 0x30) & (tags[:, 1] == 0x04) & (stops[:, 1] - starts[:, 1] >= 16)
    version = (number > 0) & (tags[:, 0] == 0x02) & (stops[:, 0] - starts[:, 0] == 1)
    numbers = version & (tags[:, :9] == 0x02).all(axis=1)
    named = version & (tags[:, 1] == 0x30) & (tags[:, 2] == 0x04)
    short = version & (tags[:, 1] == 0x04) & (stops[:, 1] - starts[:, 1] >= 16)
    for mask, column in ((sealed, 0), (named, 1)):
        some = np.flatnonzero(mask)
        inner, kinds, begins, ends = _walk(byte, which[some], starts[some, column], stops[some, column])
        good = (inner > 0) & (kinds[:, 0] == 0x06)
        if column == 0:
            longest = max(map(len, CIPHERS))
            good &= (ends[:, 0] - begins[:, 0] >= longest) & _names(byte, which[some], begins[:, 0], CIPHERS)
        mask[some[~good]] = False
    good = sealed | numbers | named | short
    sizes[which[good]] = stop[good]
    return sizes


_SEXTETS = np.full(256, -1, dtype=np.int64)
for _i, _c in enumerate(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"):
    _SEXTETS[_c] = _i
_SEXTETS[[0x2D, 0x5F]] = 62, 63
_NIBBLES = np.full(256, -1, dtype=np.int64)
for _i, _c in enumerate(b"0123456789abcdef"):
    _NIBBLES[[_c, ord(chr(_c).upper())]] = _i


class _Spaced:
    """The base64 characters of a text with white space left out, and how far they go on from each."""

    def __init__(self, raw: bytes, begin: int, end: int):
        data = np.frombuffer(raw, dtype=np.uint8)[begin:end]
        solid = ~IS_SPACE[data]
        self.begin, self.place = begin, np.flatnonzero(solid)
        self.rank = np.cumsum(solid) - solid
        self.sextet = _SEXTETS[data[self.place]]
        self.other = np.append(np.flatnonzero(self.sextet < 0), len(self.sextet))

    def index(self, positions: list[int]) -> np.ndarray:
        return self.rank[np.array(positions, dtype=np.int64) - self.begin]

    def letters(self, first: np.ndarray) -> np.ndarray:
        """Base64 characters from each index on."""
        return self.other[np.searchsorted(self.other, first)] - first

    def byte(self, first: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        top = len(self.sextet) - 1

        def read(which: np.ndarray, at: np.ndarray) -> np.ndarray:
            q = first[which] + at * 4 // 3
            two = self.sextet[np.minimum(q, top)] << 6 | self.sextet[np.minimum(q + 1, top)]
            return two >> (4 - at * 8 % 6) & 0xFF

        return read

    def end_of(self, first: int, bytes_: int) -> int:
        """Where the writing of so many bytes ends."""
        return int(self.place[first + -(-bytes_ * 8 // 6) - 1]) + 1 + self.begin


def _padded(raw: bytes, stop: int, end: int, bytes_: int) -> int:
    pad = -bytes_ % 3
    return stop + (pad if raw[stop : min(stop + pad, end)] == b"=" * pad else 0)


def _base64_keys(raw: bytes, begin: int, end: int) -> Iterator[tuple[int, int]]:
    """Spans of private keys in base64 within raw[begin:end]: wherever one begins, wrapped over lines or not, also as
    base64 of an armoured key.
    """
    starts = [m.start() for m in DER_BASE64.finditer(raw, begin, end)]
    boxed = [m.start() for m in OPENSSH_BASE64.finditer(raw, begin, end)]
    spaced = _Spaced(raw, begin, end) if starts or boxed else None
    if starts:
        first = spaced.index(starts)
        sizes = der_key_sizes(spaced.byte(first), spaced.letters(first) * 6 // 8)
        for i in np.flatnonzero(sizes).tolist():
            stop = spaced.end_of(int(first[i]), int(sizes[i]))
            yield starts[i], _padded(raw, stop, end, int(sizes[i]))
    if boxed:
        first = spaced.index(boxed)
        room = spaced.letters(first) * 6 // 8
        sizes = _container_sizes(spaced.byte(first), room)
        free = 0
        for i in np.flatnonzero(sizes).tolist():
            if boxed[i] < free:
                continue
            if sizes[i] > 0:
                stop = _padded(raw, spaced.end_of(int(first[i]), int(sizes[i])), end, int(sizes[i]))
            else:  # its head holds, its fields don't end here: the characters up to the next white space
                stop = BASE64.match(raw, boxed[i], end).end()
            yield boxed[i], stop
            free = stop
    at = raw.find(NESTED, begin, end)
    while at >= 0:
        match = BASE64.match(raw, at, end)
        if (plain := from_base64(match[0])) and any(_armoured(m) for m in ARMOUR.finditer(plain)):
            yield match.span()
        at = raw.find(NESTED, match.end(), end)


def _container_sizes(byte: Callable, room: np.ndarray) -> np.ndarray:
    """Bytes of each OpenSSH key container: three fields, the number of keys, as many public parts and the private one.
    -1 if only the fields up to the number are there, 0 if not even these.
    """
    which, at = np.arange(len(room)), np.full(len(room), 15, dtype=np.int64)
    name = b"openssh-key-v1\x00"
    sizes = np.where((room >= 19) & _names(byte, which, np.zeros(len(room), dtype=np.int64), (name,)), -1, 0)

    def number(alive: np.ndarray) -> np.ndarray:
        return sum(byte(alive, at[alive] + k) << (24 - 8 * k) for k in range(4))

    for _ in range(3):
        alive = np.flatnonzero(sizes)
        at[alive] += 4 + number(alive)
        sizes[alive[at[alive] + 4 > room[alive]]] = 0
    alive = np.flatnonzero(sizes)
    keys = np.zeros(len(room), dtype=np.int64)
    keys[alive] = number(alive)
    at[alive] += 4
    for k in range(MOST_ELEMENTS):
        alive = np.flatnonzero((sizes < 0) & (keys + 1 > k) & (keys < MOST_ELEMENTS) & (at + 4 <= room))
        at[alive] += 4 + number(alive)
        whole = alive[(keys[alive] == k) & (at[alive] <= room[alive])]
        sizes[whole] = at[whole]
    return sizes


def _hex_keys(raw: bytes, begin: int, end: int) -> Iterator[tuple[int, int]]:
    """Spans of private keys in hex, plain or with colons between the bytes."""
    for pattern, width in ((DER_HEX, 2), (DER_COLONS, 3)):
        starts = np.array([m.start() for m in pattern.finditer(raw, begin, end)], dtype=np.int64)
        if not len(starts):
            continue
        data = np.frombuffer(raw, dtype=np.uint8)[begin:end]
        nibble = _NIBBLES[data]
        if width == 2:
            other = np.append(np.flatnonzero(nibble < 0), len(data))
            room = (other[np.searchsorted(other, starts - begin)] - (starts - begin)) // 2
        else:
            room = _colon_room(nibble, data == 0x3A, starts - begin)

        def read(which, at, first=starts - begin, nibble=nibble, width=width):
            q = np.minimum(first[which] + at * width, len(nibble) - 2)
            return nibble[q] << 4 | nibble[q + 1]

        sizes = der_key_sizes(read, room)
        written = sizes * width - (width == 3)
        for i in np.flatnonzero(written >= 64).tolist():
            yield int(starts[i]), int(starts[i] + written[i])


def _colon_room(nibble: np.ndarray, colon: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bytes written as two hex digits, with colons between them, from each start on."""
    n = len(nibble)
    two = np.zeros(n, dtype=bool)
    two[:-1] = (nibble[:-1] >= 0) & (nibble[1:] >= 0)
    linked = np.zeros(n, dtype=bool)
    linked[:-3] = two[:-3] & colon[2:-1] & two[3:]
    room = np.zeros(len(starts), dtype=np.int64)
    for phase in range(3):  # bytes of one writing start at one phase
        mine = np.flatnonzero(starts % 3 == phase)
        breaks = np.flatnonzero(~linked[phase::3])
        own = starts[mine] // 3
        room[mine] = breaks[np.searchsorted(breaks, own)] - own + 1
    return np.where(two[starts], room, 0)


def _armoured(match: re.Match) -> bool:
    """Whether the body between the lines is a key. One with a cipher in its head lines can't be looked into: it must
    be whole blocks.
    """
    text = match[3].replace(b"\\n", b"").replace(b"\\r", b"")
    body = from_base64(bytes(b for b in text if not IS_SPACE[b]))
    if body and b"DEK-Info:" in match[2]:
        return len(body) >= 64 and len(body) % 8 == 0
    return bool(body) and is_private_key(body)


def _apart(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Without those that overlap an earlier one, or one that starts there too and is longer."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans, key=lambda x: (x[0], -x[1])):
        if not out or start >= out[-1][1]:
            out.append((start, end))
    return out


def _private_keys(raw: bytes, begin: int, end: int) -> Iterator[tuple[int, int]]:
    yield from (m.span() for m in ARMOUR.finditer(raw, begin, end) if _armoured(m))
    yield from _base64_keys(raw, begin, end)


def scan_slice(column: pa.Array) -> pa.Array:
    """Spans in code points of every text of a slice, by start, then kind."""
    data, offsets = text_buffers(column)
    rows = len(column)
    raw = data.tobytes()
    words = Words(data, offsets, hashes=False)
    found: list[tuple[int, int, int, int]] = []  # row, start byte, kind, end byte
    for i in np.flatnonzero(words.end - words.start >= LEAST_RUN):
        at = int(words.start[i])
        found += [(int(words.doc[i]), at + a, kind, at + b) for kind, a, b in _run_spans(raw[at : int(words.end[i])])]
    marks = np.flatnonzero((data == 0x3A) | (data == 0x3D))
    for row in np.unique(np.searchsorted(offsets, marks, side="right") - 1) if len(marks) else ():
        begin, end = int(offsets[row]), int(offsets[row + 1])
        found += [
            (int(row), m.start(), 0, m.end())
            for m in ASSIGN.finditer(raw, begin, end) if m.end(1) - m.start(1) >= LEAST_SECRET
        ]
    for kind, keys, hints in (
        (3, _private_keys, (b"PRIVATE KEY-----", OPENSSH, NESTED, DER_BASE64)), (4, _hex_keys, (DER_HEX, DER_COLONS))
    ):
        # rows that hold how a key may begin
        at = {
            m.start() for hint in hints for m in (re.compile(hint) if isinstance(hint, bytes) else hint).finditer(raw)
        }
        for row in np.unique(np.searchsorted(offsets, sorted(at), side="right") - 1) if at else ():
            found += [
                (int(row), a, kind, b) for a, b in _apart(list(keys(raw, int(offsets[row]), int(offsets[row + 1]))))
            ]
    found.sort()
    ranks = code_point_ranks(data)
    row = np.array([x[0] for x in found], dtype=np.int64)
    start = np.array([x[1] for x in found], dtype=np.int64)
    end = np.array([x[3] for x in found], dtype=np.int64)
    base = ranks[offsets[row]]
    structs = pa.StructArray.from_arrays(
        [
            pa.array([KINDS[x[2]] for x in found], pa.string()),
            pa.array(ranks[start] - base, pa.int32()),
            pa.array(ranks[end] - base, pa.int32())
        ],
        names=["kind", "start", "end"],
    )
    counts = np.zeros(rows + 1, dtype=np.int32)
    np.cumsum(np.bincount(row, minlength=rows), out=counts[1:])
    return pa.ListArray.from_arrays(pa.array(counts), structs)


@F.arrow_udf(SPANS)
def secret_spans(column: pa.Array) -> pa.Array:
    """Spans of secrets in each text: kind, start and end in code points, end exclusive."""
    parts = [scan_slice(x) for x in array_slices(column)]
    return pa.concat_arrays(parts) if parts else pa.array(
        [], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    )


def joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ","
    )


def find_secrets(docs: DataFrame, text: str = "text", into: str = "secrets") -> DataFrame:
    """The input's rows with the spans of each text; a column named ``into`` is replaced."""
    return docs.withColumn(into, secret_spans(F.col(text)))


def redact(docs: DataFrame, text: str = "text", mark: str = "[redacted]") -> DataFrame:
    """The input's rows with every span replaced by a mark; overlapping spans count as one."""
    spans = secret_spans(F.col(text))
    cuts = F.aggregate(
        F.col("__spans"),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(
                s["end"].alias("at"),
                F.concat(
                    acc["out"], F.substr(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)
                ).alias("out")
            ),
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))),
        lambda acc: F.concat(acc["out"], F.substr(F.col(text), acc["at"] + 1)),
    )
    clean = F.when(F.size("__spans") > 0, cuts).otherwise(F.col(text))
    return docs.withColumn("__spans", spans).withColumn(text, clean).drop("__spans")


def op3_secret_scan(spark, sf_dir):
    """The scan of ``documents``, with digests of base spans."""
    from tremora.session import table

    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    number = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"].isin(*KINDS[:3]))
    return found.select(
        "doc_id",
        number("assign").alias("n_assign"),
        number("access").alias("n_access"),
        number("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
        F.size(F.filter("secrets", lambda s: ~s["kind"].isin(*KINDS[:3]))).cast("long").alias("n_confirmed"),
    )
