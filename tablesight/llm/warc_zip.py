"""WARC records in ZIP packages: written by tasks, read by ranges (operator 13).

A package is a ZIP archive that holds a WARC member (``archive/*.warc.gz``, one
gzip block a record) and an index of it (``indexes/*.cdxj``: offset and length of
every record), both *stored*, so that a record is a byte range of the package.

Reading has two stages.  The first reads, of every package, the end of the file,
the central directory (with ZIP64 records, in windows), the local headers of the
members it wants and the index lines, and emits ranges of neighbouring records of
about ``RANGE_BYTES``.  The ranges are dealt out to tasks, and the second stage
reads each with one seek.  Nothing is extracted, no package is read whole, and one
large package is read by many tasks.  A member without an index is walked record
by record in the first stage.

Writing streams a partition's records into packages of about ``PACKAGE_BYTES``
under names of their own.  A task's packages count once its row of the written
manifest does, so those of lost or repeated attempts are never read.  Files are
opened through ``pyarrow.fs`` from the folder's URI.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesight.llm.common import shared_uri, slices
from tablesight.operators.skew import hot_split_join
from tablesight.session import own_scratch, scratch_table

#: Payloads from this size on are stored once.
MIN_SHARED = 1000
#: A task starts another package once one holds this much.
PACKAGE_BYTES = 256 << 20
#: Bytes of neighbouring records that are read at once.
RANGE_BYTES = 2 << 20
#: Bytes that a task of the second stage reads, about.
TASK_BYTES = 16 << 20
WINDOW = 1 << 20
DATE = "2024-01-01T00:00:00Z"
STORED = 0

# Fixed values of the ZIP format: signatures and record layouts (little-endian).
LOCAL, LOCAL_FORM = b"PK\x03\x04", "<4s5H3I2H"
DESCRIPTOR, DESCRIPTOR_FORM = b"PK\x07\x08", "<4sIQQ"
CENTRAL, CENTRAL_FORM = b"PK\x01\x02", "<4s6H3I5H2I"
END64, END64_FORM = b"PK\x06\x06", "<4sQ2H2I4Q"
LOCATOR64, LOCATOR64_FORM = b"PK\x06\x07", "<4sIQI"
END, END_FORM = b"PK\x05\x06", "<4s4H2IH"
ZIP64_EXTRA = 1
VERSION_64 = 45
SIZES_FOLLOW = 8
UTF8_NAMES = 0x800
FULL_16, FULL_32 = 0xFFFF, 0xFFFFFFFF


class Member(NamedTuple):
    name: str
    method: int
    size: int
    header: int  # offset of the local header


class Source:
    """A file read by ranges."""

    def __init__(self, uri: str):
        from pyarrow import fs
        files, path = fs.FileSystem.from_uri(uri)
        self.uri = uri
        self.file = files.open_input_file(path)
        self.size = self.file.size()

    def read(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        out = self.file.read(length)
        if len(out) != length:
            raise ValueError(f"{self.uri}: {length} bytes at {start} are beyond its end")
        return out

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


def _end(source) -> tuple[int, int, int]:
    """(number of members, size and place of the central directory).  The place
    is counted back from its end, so that bytes put before the ZIP don't matter."""
    fixed = struct.calcsize(END_FORM)
    tail_at = max(0, source.size - fixed - FULL_16 - struct.calcsize(LOCATOR64_FORM))
    tail = source.read(tail_at, source.size - tail_at)
    at = tail.rfind(END)
    while at >= 0:
        if at + fixed <= len(tail):
            _, _, _, _, count, size, offset, note = struct.unpack_from(END_FORM, tail, at)
            if at + fixed + note == len(tail):
                break
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError(f"{source.uri}: no end of a ZIP archive")
    stop = tail_at + at
    locator = at - struct.calcsize(LOCATOR64_FORM)
    if locator >= 0 and tail[locator:locator + 4] == LOCATOR64:
        _, _, end64, _ = struct.unpack_from(LOCATOR64_FORM, tail, locator)
        length = struct.calcsize(END64_FORM)
        raw = source.read(end64, length) if end64 + length <= source.size else b""
        if raw[:4] != END64:  # bytes before the archive: the record lies right before its locator
            end64 = tail_at + locator - length
            raw = source.read(end64, length)
        if raw[:4] != END64:
            raise ValueError(f"{source.uri}: no ZIP64 end record")
        *_, count, size, offset = struct.unpack(END64_FORM, raw)
        stop = end64
    elif FULL_32 in (size, offset) or count == FULL_16:
        raise ValueError(f"{source.uri}: a ZIP64 archive without its locator")
    return count, size, stop - size


def _zip64(extra: bytes, fields: list[int]) -> list[int]:
    """The 32-bit fields, those that are full replaced from the ZIP64 extra field."""
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<2H", extra, at)
        if kind == ZIP64_EXTRA:
            wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, at + 4))
            return [next(wide) if f == FULL_32 else f for f in fields]
        at += 4 + length
    return fields


def members(source) -> Iterator[Member]:
    """The central directory's entries, read in windows."""
    count, left, at = _end(source)
    first = at
    held, shift = b"", None
    fixed = struct.calcsize(CENTRAL_FORM)
    for _ in range(count):
        while True:
            if len(held) >= fixed:
                entry = struct.unpack_from(CENTRAL_FORM, held)
                length = fixed + sum(entry[10:13])
                if len(held) >= length:
                    break
            if left <= 0:
                raise ValueError(f"{source.uri}: the central directory is cut off")
            part = source.read(at, min(WINDOW, left))
            held, at, left = held + part, at + len(part), left - len(part)
        if entry[0] != CENTRAL:
            raise ValueError(f"{source.uri}: no central directory entry where one is due")
        names, extras = entry[10], entry[11]
        name = held[fixed:fixed + names].decode("utf-8" if entry[3] & UTF8_NAMES else "cp437")
        size, _, header = _zip64(held[fixed + names:fixed + names + extras], [entry[9], entry[8], entry[16]])
        if shift is None:  # where the first entry's member really starts
            shift = 0 if header + 4 <= first and source.read(header, 4) == LOCAL else _shift(source, first)
        yield Member(name, entry[4], size, header + shift)
        held = held[length:]


def _shift(source, directory: int) -> int:
    """Bytes put before the archive: what the stated place of the directory lacks."""
    tail = source.read(max(0, source.size - FULL_16 - 100), min(source.size, FULL_16 + 100))
    *_, stated, _ = struct.unpack_from(END_FORM, tail, tail.rfind(END))
    if stated == FULL_32:
        at = tail.rfind(END64)
        stated = struct.unpack_from(END64_FORM, tail, at)[-1]
    return directory - stated


def data_start(source, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method != STORED:
        raise ValueError(f"{source.uri}: {member.name} is compressed, its records are no ranges of the package")
    form = struct.calcsize(LOCAL_FORM)
    head = struct.unpack(LOCAL_FORM, source.read(member.header, form))
    if head[0] != LOCAL:
        raise ValueError(f"{source.uri}: no local header of {member.name}")
    return member.header + form + head[9] + head[10]


def _windows(source, start: int, size: int) -> Iterator[bytes]:
    for at in range(start, start + size, WINDOW):
        yield source.read(at, min(WINDOW, start + size - at))


def index_lines(source, member: Member) -> Iterator[bytes]:
    """Lines of a stored index member; one ending in .gz is unpacked on the way."""
    unpack = zlib.decompressobj(31) if member.name.endswith(".gz") else None
    rest = b""
    for part in _windows(source, data_start(source, member), member.size):
        if unpack:
            plain = b""
            while part:  # an index may be several gzip blocks
                plain += unpack.decompress(part)
                part = unpack.unused_data
                if unpack.eof:
                    unpack = zlib.decompressobj(31)
            part = plain
        *lines, rest = (rest + part).split(b"\n")
        yield from lines
    if rest:
        yield rest


def walk(source, member: Member) -> Iterator[tuple[int, int]]:
    """(offset, length) of a WARC member's records, found by reading it through."""
    start = data_start(source, member)
    if member.name.endswith(".gz"):
        at, unpack, used = 0, zlib.decompressobj(31), 0
        for part in _windows(source, start, member.size):
            while part:
                unpack.decompress(part)
                rest = unpack.unused_data
                used += len(part) - len(rest)
                if unpack.eof:
                    yield at, used
                    at, used, unpack = at + used, 0, zlib.decompressobj(31)
                part = rest
        return
    at = 0
    while at < member.size:
        window, head = 4096, b""
        while b"\r\n\r\n" not in head:
            if len(head) == member.size - at:
                raise ValueError(f"{source.uri}: {member.name} ends within a record's header")
            head = source.read(start + at, min(window, member.size - at))
            window *= 2
        fields = head[:head.index(b"\r\n\r\n")]
        length = len(fields) + 4 + int(re.search(rb"(?im)^content-length:\s*(\d+)", fields)[1]) + 4
        yield at, length
        at += length


def record_ranges(source, limit: int = RANGE_BYTES) -> Iterator[tuple[str, int, int, list[int], list[int]]]:
    """(member, start, length, offsets, lengths): neighbouring records of a
    package's WARC members, with offsets from the start of the range."""
    listed = list(members(source))
    archives = {m.name.rsplit("/", 1)[-1]: m for m in listed if re.search(r"\.warc(\.gz)?$", m.name)}
    places: dict[str, list[tuple[int, int]]] = {}
    for index in listed:
        if re.search(r"\.(cdxj?|idx)(\.gz)?$", index.name):
            for line in index_lines(source, index):
                brace = line.find(b"{")
                if brace >= 0:
                    entry = json.loads(line[brace:])
                    name = entry["filename"].rsplit("/", 1)[-1]
                    if name not in archives:
                        raise ValueError(f"{source.uri}: the index names {name}, which is not a member")
                    places.setdefault(name, []).append((int(entry["offset"]), int(entry["length"])))
    for name, member in archives.items():
        at = data_start(source, member)
        first, stop, offsets, lengths = 0, 0, [], []
        for offset, length in sorted(places[name]) if name in places else walk(source, member):
            if offsets and (offset + length - first > limit or offset < stop):
                yield member.name, at + first, stop - first, offsets, lengths
                offsets, lengths = [], []
            if not offsets:
                first = offset
            offsets.append(offset - first)
            lengths.append(length)
            stop = offset + length
        if offsets:
            yield member.name, at + first, stop - first, offsets, lengths


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers with lower-case names, block) of one record, gzipped or not."""
    if raw[:2] == b"\x1f\x8b":
        raw = zlib.decompress(raw, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record at the indexed place")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    length = int(fields["content-length"])
    if len(rest) < length:
        raise ValueError(f"record {fields.get('warc-record-id')} is cut off")
    return fields, rest[:length]


def printable(text: str) -> str:
    """Text for a header line: blanks and control characters as %XX."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def warc_record(kind: str, record_id: str, url: str | None, payload: bytes, refers_to: str | None = None,
                date: str = DATE) -> bytes:
    """A ``response`` record with its payload, or a ``revisit`` of another record,
    whose block is the HTTP header alone."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http + payload if kind == "response" else http
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}",
             f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(block)}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {printable(url)}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <{refers_to}>",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class PackageWriter:
    """Writes a ZIP of stored members to a stream, front to back.

    Sizes and checksums follow each member's bytes, and every entry and the end of
    the archive are in ZIP64 form, whatever their sizes."""

    def __init__(self, stream):
        self.stream, self.at, self.entries, self.open = stream, 0, [], None

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def start(self, name: str) -> None:
        raw = name.encode()
        self.open = [raw, self.at, 0, 0]
        extra = struct.pack("<2H2Q", ZIP64_EXTRA, 16, 0, 0)
        self.write(struct.pack(LOCAL_FORM, LOCAL, VERSION_64, SIZES_FOLLOW | UTF8_NAMES, STORED, 0, 0x21, 0,
                               FULL_32, FULL_32, len(raw), len(extra)) + raw + extra)

    def add(self, data: bytes) -> int:
        """Append to the open member; its size before."""
        before = self.open[3]
        self.open[2] = zlib.crc32(data, self.open[2])
        self.open[3] += len(data)
        self.write(data)
        return before

    def finish(self) -> None:
        self.write(struct.pack(DESCRIPTOR_FORM, DESCRIPTOR, self.open[2], self.open[3], self.open[3]))
        self.entries.append(tuple(self.open))
        self.open = None

    def close(self) -> None:
        first = self.at
        for raw, header, crc, size in self.entries:
            extra = struct.pack("<2H3Q", ZIP64_EXTRA, 24, size, size, header)
            self.write(struct.pack(CENTRAL_FORM, CENTRAL, VERSION_64, VERSION_64, SIZES_FOLLOW | UTF8_NAMES, STORED,
                                   0, 0x21, crc, FULL_32, FULL_32, len(raw), len(extra), 0, 0, 0, 0, FULL_32)
                       + raw + extra)
        size, end64 = self.at - first, self.at
        n = len(self.entries)
        self.write(struct.pack(END64_FORM, END64, struct.calcsize(END64_FORM) - 12, VERSION_64, VERSION_64, 0, 0,
                               n, n, size, first))
        self.write(struct.pack(LOCATOR64_FORM, LOCATOR64, 0, end64, 1))
        self.write(struct.pack(END_FORM, END, 0, 0, FULL_16, FULL_16, FULL_32, FULL_32, 0))


def write_package(stream, records: Iterable[tuple[str, bytes]], name: str = "data", limit: int | None = None) -> int:
    """Write (index key, record) pairs as one package; stops once the WARC member
    holds ``limit`` bytes.  Returns the number of records."""
    package, index = PackageWriter(stream), []
    package.start(f"archive/{name}.warc.gz")
    info = (b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: %s\r\n"
            b"Content-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
            % (str(uuid.uuid4()).encode(), DATE.encode()))
    package.add(_gzip(info))
    for key, record in records:
        block = _gzip(record)
        offset = package.add(block)
        index.append(f'{printable(key)} {{"filename": "{name}.warc.gz", "offset": {offset}, "length": {len(block)}}}\n')
        if limit is not None and offset + len(block) >= limit:
            break
    package.finish()
    package.start(f"indexes/{name}.cdxj")
    for at in range(0, len(index), 4096):
        package.add("".join(index[at:at + 4096]).encode())
    package.finish()
    package.close()
    return len(index)


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_packages(records: DataFrame, folder: str, limit: int = PACKAGE_BYTES) -> DataFrame:
    """Write rows (record_id, url, payload binary, refers_to) as packages under
    ``folder``, one or more a partition; a row with ``refers_to`` is a revisit.
    Returns the written manifest (uri, n_records) of the packages that count."""
    source = records.select("record_id", "url", "payload", "refers_to")

    def run(batches):
        from pyarrow import fs

        def rows():
            for part in slices(batches, "payload"):
                for rid, url, payload, refers in zip(*(part.column(c).to_pylist() for c in range(4))):
                    kind = "response" if refers is None else "revisit"
                    yield url or rid, warc_record(kind, rid, url, payload or b"", refers)

        todo = rows()
        ahead = next(todo, None)
        while ahead is not None:
            uri = f"{folder}/{uuid.uuid4().hex}.wacz"
            files, path = fs.FileSystem.from_uri(uri)
            files.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with files.open_output_stream(path) as stream:
                n = write_package(stream, itertools.chain([ahead], todo), limit=limit)
            yield pa.RecordBatch.from_pylist([{"uri": uri, "n_records": n}],
                                             pa.schema([("uri", pa.string()), ("n_records", pa.int64())]))
            ahead = next(todo, None)

    return scratch_table(source.mapInArrow(run, "uri string, n_records long"), "packages")


RECORD_SCHEMA = ("uri string, member string, offset long, record_type string, record_id string, url string, "
                 "refers_to string, payload_digest string, payload_bytes long, payload binary")


def read_packages(packages: DataFrame, uri_col: str = "uri", payload: bool = True) -> DataFrame:
    """The response and revisit records of packages (one row each), in no order.

    ``payload_digest`` is the bare hexadecimal SHA-1, ``payload_bytes`` the full
    payload's length (of a revisit, from the HTTP header kept with it); a response
    whose payload does not give its digest is an error, as is a package that is no
    ZIP archive or whose members are cut off.  Packages without WARC members give
    no rows; null URIs are left out."""
    def locate(batches):
        form = pa.schema([("uri", pa.string()), ("member", pa.string()), ("start", pa.int64()), ("length", pa.int64()),
                          ("offsets", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with Source(uri) as source:
                    for found in record_ranges(source):
                        yield pa.RecordBatch.from_pylist([dict(zip(form.names, (uri, *found)))], form)

    def read(batches):
        names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
        types = [pa.int64() if " long" in x else pa.binary() if " binary" in x else pa.string()
                 for x in RECORD_SCHEMA.split(", ")]
        form = pa.schema(list(zip(names, types)))
        for batch in batches:
            for r in batch.to_pylist():
                with Source(r["uri"]) as source:
                    raw = source.read(r["start"], r["length"])
                rows = []
                for offset, length in zip(r["offsets"], r["lengths"]):
                    fields, block = parse_record(raw[offset:offset + length])
                    if fields["warc-type"] not in ("response", "revisit"):
                        continue
                    head, _, body = block.partition(b"\r\n\r\n")
                    digest = _hex(fields.get("warc-payload-digest"))
                    size = re.search(rb"(?im)^content-length:\s*(\d+)", head)
                    if fields["warc-type"] == "response":
                        own = hashlib.sha1(body).hexdigest()
                        if digest not in (None, own):
                            raise ValueError(f"{r['uri']}: payload of {fields.get('warc-record-id')} is not what its digest says")
                        digest, n = own, len(body)
                    else:
                        body, n = None, int(size[1]) if size else None
                    rows.append((r["uri"], r["member"], r["start"] + offset, fields["warc-type"],
                                 _bare(fields.get("warc-record-id")), fields.get("warc-target-uri"),
                                 _bare(fields.get("warc-refers-to")), digest, n, body if payload else None))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), types)], schema=form)

    found = (packages.select(F.col(uri_col).alias("uri")).filter("uri is not null").repartition("uri")
             .mapInArrow(locate, "uri string, member string, start long, length long, "
                                 "offsets array<long>, lengths array<long>"))
    # the rows that name ranges are small, the ranges are not: as many tasks as the bytes ask for
    found = scratch_table(found, "ranges")
    total = found.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    out = found.repartition(max(1, -(-total // TASK_BYTES)), "uri", "start").mapInArrow(read, RECORD_SCHEMA)
    return out if payload else out.drop("payload")


def _bare(text: str | None) -> str | None:
    return None if text is None else text.strip("<>")


def _hex(digest: str | None) -> str | None:
    """SHA-1 in hexadecimal of a digest header (base 32 or 16); null for other kinds."""
    if not digest or not digest.lower().startswith("sha1:"):
        return None
    value = digest[5:]
    return value.lower() if len(value) == 40 else base64.b32decode(value).hex()


PREFIX = "urn:page:"


def with_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int = MIN_SHARED) -> DataFrame:
    """Rows of ``write_packages`` for pages: of equal payloads (SHA-1, XXH64 and
    length) of at least ``least`` bytes the largest id is kept, others refer to it."""
    body = F.coalesce(pages[html_col].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"), body.alias("payload"))
    keyed = rows.withColumn("key", F.when(F.octet_length("payload") >= least, F.concat_ws(
        ":", F.sha1("payload"), F.xxhash64("payload"), F.octet_length("payload"))))
    groups = (keyed.filter("key is not null").groupBy("key")
              .agg(F.max("id").alias("largest"), F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1"))
    # written first: where few payloads are shared, the planner sees it and moves no page
    joined = hot_split_join(keyed, scratch_table(groups, "shared"), ["key"], "n_rows", "left")
    other = F.col("largest").isNotNull() & ~F.col("id").eqNullSafe(F.col("largest"))
    name = F.concat(F.lit(PREFIX), F.coalesce(F.col("id").cast("string"), F.lit("null")))
    return joined.select(name.alias("record_id"), "url", "payload", F.when(
        other, F.concat(F.lit(PREFIX), F.col("largest").cast("string"))).alias("refers_to"))


def page_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html") -> DataFrame:
    """Write the pages as WARC packages into the shared folder and read them back:
    page_id, payload_bytes, payload_digest, record_type, refers_to (and url).

    Null html is an empty payload; payloads under 1000 bytes are never shared.  A
    null id is smaller than any (so it revisits, unless all ids of its payload are
    null: then all are responses) and comes back null.  Rows repeated with the
    largest id are responses each.  Blanks and control characters in a URL come
    back as %XX; a null URL is left out.  Payloads may be of any length that fits a
    row.  Other columns are not read; an empty table gives no rows.
    """
    spark: SparkSession = pages.sparkSession
    folder = f"{shared_uri(spark)}/packages-{uuid.uuid4().hex}"
    own_scratch(folder)
    written = write_packages(with_revisits(pages, id_col, url_col, html_col), folder)

    def page(column: str):
        text = F.substring(F.col(column), len(PREFIX) + 1, 1 << 30)
        return F.when(text != "null", text).cast(pages.schema[id_col].dataType)

    return read_packages(written, payload=False).select(
        page("record_id").alias(id_col), "payload_bytes", "payload_digest", "record_type",
        page("refers_to").alias("refers_to"), "url")
