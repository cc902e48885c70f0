"""Web archives: WARC records packaged in ZIP files, read by byte range.

Writing: equal payloads are found on their digests alone (largest page_id per digest, combined before
the shuffle), then each partition streams gzip-compressed WARC records into ZIP packages that store one
WARC member and its CDXJ index member without compression. The packages always carry ZIP64 records.

Reading: the reader parses the end record, the ZIP64 locator and directory and the central directory,
finds the stored WARC members, and reads single records by range as the package's indexes say: CDXJ or lines of JSON,
plain, gzip-compressed or deflated in the package. WARC members without an index are walked record by record in
ranges of bounded size. Nothing is extracted. Packages of other writers are read too: any names of members and records.

Defined results: a null payload is empty. Records with equal payloads revisit the one of largest
page_id; rows that repeat that page_id with that payload are responses too; payloads whose page_ids are
all null are responses. A null url is written as the record's own URN. Records of other writers have a null page_id;
what a record doesn't state is null.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.llm.files import Written, open_read

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES = 64 << 20
#: Bytes that are read at once where no index says how long a record is.
RANGE_BYTES = 1 << 20
_FULL = 0xFFFFFFFF


# -- ZIP packages -----------------------------------------------------------------------------------


class ZipWriter:
    """Stored members, streamed in turn; sizes follow each member's data and stand in the directory."""

    def __init__(self, out: Written):
        self.out, self.entries = out, []

    def begin(self, name: str) -> None:
        self.name, self.offset, self.crc, self.size = name.encode(), self.out.at, 0, 0
        self.out.write(
            struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x0808, 0, 0, 0x21, 0, 0, 0, len(self.name), 0) + self.name
        )

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.crc, self.size = zlib.crc32(data, self.crc), self.size + len(data)

    def end(self) -> None:
        self.out.write(struct.pack("<IIQQ", 0x08074B50, self.crc, self.size, self.size))
        self.entries.append((self.name, self.crc, self.size, self.offset))

    def close(self) -> str:
        start = self.out.at
        for name, crc, size, offset in self.entries:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset)
            self.out.write(
                struct.pack(
                    "<IHHHHHHIIIHHHHHII",
                    0x02014B50,
                    45,
                    45,
                    0x0808,
                    0,
                    0,
                    0x21,
                    crc,
                    _FULL,
                    _FULL,
                    len(name),
                    len(extra),
                    0,
                    0,
                    0,
                    0,
                    _FULL
                ) + name + extra
            )
        size, at, n = self.out.at - start, self.out.at, len(self.entries)
        self.out.write(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, size, start))
        self.out.write(struct.pack("<IIQI", 0x07064B50, 0, at, 1))
        self.out.write(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, _FULL, _FULL, 0))
        return self.out.close()


def _member_name(raw: bytes) -> str:
    """UTF-8 where it is that, else the code page of old archivers, in which every byte is a character."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("cp437")


class ZipReader:
    """Directory of a package, with ZIP64 fields where they are used; members are read by range."""

    def __init__(self, file):
        self.file, total = file, file.size()
        tail_at = max(0, total - 65557)
        tail = self.read(tail_at, total - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no end of central directory")
        _, _, _, _, n, size, start, _ = struct.unpack("<IHHHHIIH", tail[end : end + 22])
        if 0xFFFF == n or _FULL in (size, start):
            locator = self.read(tail_at + end - 20, 20)
            if locator[:4] != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            record = self.read(struct.unpack("<Q", locator[8:16])[0], 56)
            n, size, start = struct.unpack("<QQQ", record[32:56])
        directory, at = self.read(start, size), 0
        self.members: dict[str, tuple[int, int, int]] = {}
        for _ in range(n):
            head = struct.unpack("<IHHHHHHIIIHHHHHII", directory[at : at + 46])
            if head[0] != 0x02014B50:
                raise ValueError("broken central directory")
            method, packed, plain, named, extras, comment, offset = head[4], head[8], head[9], head[
                10
            ], head[11], head[12], head[16]
            name = _member_name(directory[at + 46 : at + 46 + named])
            extra = directory[at + 46 + named : at + 46 + named + extras]
            while len(extra) >= 4:
                kind, length = struct.unpack("<HH", extra[:4])
                body, extra = extra[4 : 4 + length], extra[4 + length :]
                if kind == 1:  # only the fields that are full stand here, in this order
                    if plain == _FULL:
                        plain, body = struct.unpack("<Q", body[:8])[0], body[8:]
                    if packed == _FULL:
                        packed, body = struct.unpack("<Q", body[:8])[0], body[8:]
                    if offset == _FULL:
                        offset = struct.unpack("<Q", body[:8])[0]
            self.members[name] = (method, offset, packed)
            at += 46 + named + extras + comment

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _data(self, name: str) -> tuple[int, int]:
        _, offset, size = self.members[name]
        named, extras = struct.unpack("<HH", self.read(offset + 26, 4))
        return offset + 30 + named + extras, size

    def stored(self, name: str) -> tuple[int, int]:
        """(start, size) of a stored member's data."""
        if self.members[name][0]:
            raise ValueError(f"{name} is compressed")
        return self._data(name)

    def lines(self, name: str) -> Iterator[bytes]:
        """Lines of a text member, stored or deflated, gzip-compressed (in any number of parts) or not, a range at a
        time.
        """
        at, size = self._data(name)
        steps = [zlib.decompressobj(-15)] if self.members[name][0] == 8 else []
        if self.members[name][0] not in (0, 8):
            raise ValueError(f"{name} is compressed in a way that isn't known")
        rest, gzipped = b"", None
        for begin in range(at, at + size, RANGE_BYTES):
            data = self.read(begin, min(RANGE_BYTES, at + size - begin))
            if steps:
                data = steps[0].decompress(data)
            if gzipped is None and data:
                gzipped = zlib.decompressobj(31) if name.endswith(".gz") and data[:2] == b"\x1f\x8b" else False
            if gzipped:
                plain = gzipped.decompress(data)
                while gzipped.eof and gzipped.unused_data:
                    data, gzipped = gzipped.unused_data, zlib.decompressobj(31)
                    plain += gzipped.decompress(data)
                data = plain
            *whole, rest = (rest + data).split(b"\n")
            yield from whole
        if rest:
            yield rest


# -- records ----------------------------------------------------------------------------------------


def own_urn(page_id, digest: str) -> str:
    return f"urn:x-page:{page_id}:{digest}"


def clean_url(url: str | None, own: str) -> str:
    return own if url is None else "".join(c if c > " " and c != "\x7f" else "%%%02X" % ord(c) for c in url)


def record(page_id, url, payload: bytes | None, size: int, digest: str, refers_to, date: str) -> bytes:
    """A gzip member with one record; ``payload`` is None for a revisit."""
    own = own_urn(page_id, digest)
    clean = clean_url(url, own)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (
        payload or b""
    )
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if payload is not None else 'revisit'}",
        f"WARC-Record-ID: <{own}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{digest}"
    ]
    if payload is None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}:{digest}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packer.flush()


def _fields(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name; folded lines are joined."""
    found: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").splitlines()[1:]:
        if line[:1] in " \t" and last:
            found[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            found[last] = value.strip()
    return found


def parse_record(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of a record, gzip-compressed or not; names of headers in lower case.
    Records of other content than HTTP have it whole as payload.
    """
    plain = zlib.decompress(member, 31) if member[:2] == b"\x1f\x8b" else member
    head, _, rest = plain.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields.get("content-length", len(rest)))]
    if not fields.get("content-type", "").startswith("application/http"):
        return fields, {}, block
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, _fields(http), payload


def walk_records(package: ZipReader, at: int, size: int) -> Iterator[bytes]:
    """The records of a WARC member in turn, without an index: read in ranges, one record in memory."""
    end = at + size
    while at < end:
        held = package.read(at, min(RANGE_BYTES, end - at))
        if held[:2] == b"\x1f\x8b":
            unpack, plain, begin = zlib.decompressobj(31), [], at
            while True:
                plain.append(unpack.decompress(held))
                at += len(held) - len(unpack.unused_data)
                if unpack.eof or at >= end:
                    break
                held = package.read(at, min(RANGE_BYTES, end - at))
            if at == begin:
                return
            yield b"".join(plain)
        else:
            while b"\r\n\r\n" not in held and at + len(held) < end:
                held += package.read(at + len(held), min(RANGE_BYTES, end - at - len(held)))
            head, found, _ = held.partition(b"\r\n\r\n")
            if not found:
                return
            total = len(head) + 4 + int(_fields(head).get("content-length", 0)) + 4
            yield held[:total] if total <= len(held) else package.read(at, min(total, end - at))
            at += total


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def sort_key(url: str) -> str:
    """The form of an address by which indexes are sorted: the host's parts from the last to the first, then the path.
    """
    scheme, _, rest = url.partition("://")
    if not rest:
        return url.lower()
    host, slash, path = rest.partition("/")
    name, colon, port = host.lower().partition(":")
    return ",".join(
        reversed(name.removeprefix("www.").split("."))
    ) + (f":{port}" if colon else "") + ")" + ("/" + path.lower() if slash else "/")


class _Package:
    def __init__(self, folder: str):
        name = uuid.uuid4().hex
        self.zip, self.index, self.rows = ZipWriter(Written(folder, f"{name}.wacz")), [], 0
        self.zip.begin("archive/data.warc.gz")

    def add(self, url: str, date: str, digest: str, kind: str, data: bytes) -> None:
        entry = {
            "url": url,
            "mime": "warc/revisit" if kind == "revisit" else "text/html",
            "status": "200",
            "digest": f"sha1:{digest}",
            "length": str(len(data)),
            "offset": str(self.zip.size),
            "filename": "data.warc.gz"
        }
        self.index.append(f"{sort_key(url)} {''.join(c for c in date if c.isdigit())[:14]} {json.dumps(entry)}\n")
        self.zip.write(data)
        self.rows += 1

    def close(self) -> dict:
        self.zip.end()
        self.zip.begin("indexes/index.cdxj")
        self.zip.write("".join(sorted(self.index)).encode())
        self.zip.end()
        return {"archive": self.zip.close(), "records": self.rows}


def write_archives(
    pages: DataFrame,
    folder: str,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    date: str = "1970-01-01T00:00:00Z",
    archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """Write a record for each row; returns (archive, records), a row for each package. Run it once: keep what it
    returns with ``cut``.
    """
    plain = pages.select(
        F.col(key).alias("k"), F.col(url).alias("u"), F.coalesce(F.col(html), F.lit("")).alias("h")
    ).withColumn("d", F.sha1("h"))
    last = plain.groupBy("d").agg(F.max("k").alias("last"))
    marked = plain.join(last, "d").withColumn(
        "response", F.coalesce(F.col("k") == F.col("last"), F.col("last").isNull())
    )
    # a revisit carries no payload, only its size
    marked = marked.select(
        "k", "u", "d", "last", F.octet_length("h").alias("n"), F.when(F.col("response"), F.col("h")).alias("h")
    )

    def write(batches: Iterator) -> Iterator[pd.DataFrame]:
        package = None
        for batch in batches:
            for k, u, d, last_k, n, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                package = package or _Package(folder)
                digest = base64.b32encode(bytes.fromhex(d)).decode()
                package.add(
                    clean_url(u, own_urn(k, digest)),
                    date,
                    digest,
                    "revisit" if h is None else "response",
                    record(k, u, None if h is None else h.encode(), n, digest, last_k, date)
                )
                if package.zip.size >= archive_bytes:
                    yield _rows([package.close()])
                    package = None
        if package:
            yield _rows([package.close()])

    return marked.mapInArrow(write, "archive string, records long")


def _rows(rows: list[dict]):
    import pyarrow as pa

    return pa.RecordBatch.from_pylist(rows)


def indexed(package: ZipReader) -> tuple[list[tuple[str, int, int]], set[str]]:
    """(WARC member, offset, length) of the records that the indexes list, in order of place, and the members they
    cover.
    """
    warcs = [n for n in package.members if n.lower().endswith((".warc.gz", ".warc"))]
    by_file = {n.rsplit("/", 1)[-1]: n for n in warcs}
    found: set[tuple[str, int, int]] = set()
    for name in package.members:
        if name in warcs or not name.lower().removesuffix(".gz").endswith((".cdxj", ".cdx", ".jsonl")):
            continue
        for line in package.lines(name):
            brace = line.find(b"{")
            if brace < 0:
                continue
            try:
                entry = json.loads(line[brace:])
                member = by_file.get(str(entry["filename"]).rsplit("/", 1)[-1])
                place = int(entry["offset"]), int(entry["length"])
            except (ValueError, KeyError, TypeError):
                continue  # a head line, or an entry of another kind
            if member:
                found.add((member, *place))
    return sorted(found), {m for m, _, _ in found}


def _row(member: bytes) -> tuple:
    fields, http, payload = parse_record(member)
    kind = fields.get("warc-type", "")
    digest = fields.get("warc-payload-digest", "").rpartition(":")[2] or None
    name, refers = (fields.get(x, "").strip("<>") for x in ("warc-record-id", "warc-refers-to"))
    own = name.startswith("urn:x-page:")
    if own and kind == "response" and (len(payload) != int(http["content-length"]) or base32_sha1(payload) != digest):
        raise ValueError("a payload doesn't match its headers")
    size = int(
        http["content-length"]
    ) if kind == "revisit" and http.get("content-length", "").isdigit() else None if kind == "revisit" else len(payload)
    number = lambda urn: int(x) if urn.startswith("urn:x-page:") and (x := urn.split(":")[2]) != "None" else None
    return (
        number(name),
        fields.get("warc-target-uri"),
        kind,
        size,
        digest if digest or kind == "revisit" else base32_sha1(payload),
        number(refers),
        None if kind == "revisit" else payload,
        name or None,
        refers or None
    )


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record of the packages: (page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload,
    record_id, refers_to_id).
    """
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, record_id string, refers_to_id string"

    def records(package: ZipReader) -> Iterator[bytes]:
        listed, covered = indexed(package)
        starts = {m: package.stored(m)[0] for m in covered}
        for member, offset, size in listed:
            yield package.read(starts[member] + offset, size)
        for member in package.members:
            if member not in covered and member.lower().endswith((".warc.gz", ".warc")):
                yield from walk_records(package, *package.stored(member))

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = pa.schema(
            [
                (n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t])
                for n, t in (x.split() for x in schema.split(", "))
            ]
        )
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_read(path) as file:
                    rows, held = [], 0
                    for member in records(ZipReader(file)):
                        rows.append(_row(member))
                        held += len(rows[-1][6] or b"") + 100
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)

    return archives.select("archive").mapInArrow(read, schema)


def op8_warc_zip(spark, sf_dir):
    """A record for each page, written to packages in the shared folder and read back from them."""
    from tremora.session import cut, scratch, table

    written = cut(write_archives(table(spark, sf_dir, "pages"), scratch(spark, "warc")), "warc-list")
    read = read_archives(written.repartition(max(1, spark.sparkContext.defaultParallelism * 2), "archive"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base 32 of the hexadecimal digest: five hexadecimal digits are four of its digits.
OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, max(page_id) AS last FROM p GROUP BY d),
x AS (SELECT p.page_id, octet_length(encode(h)) AS n, p.d, last FROM p JOIN m ON p.d = m.d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(d, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = last OR last IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last OR last IS NULL THEN NULL ELSE last END AS refers_to
FROM x
"""
