"""ZIP-packaged WARC (13): round trip, the zipfile module both ways, ranges, edge rows."""

import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tablesight.llm import queries as Q
from tablesight.llm import warc_zip as W

PAGES = "page_id long, url string, html string"


class Bytes:
    """A source in memory that notes what is read."""

    def __init__(self, raw):
        self.raw, self.uri, self.size, self.reads = raw, "memory", len(raw), []

    def read(self, start, length):
        self.reads.append((start, length))
        out = self.raw[start:start + length]
        if len(out) != length:
            raise ValueError("beyond the end")
        return out


def brute(rows):
    best = {}
    for i, _, html in rows:
        if len((html or "").encode()) >= 1000 and i is not None:
            best[html] = max(best.get(html, i), i)
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        keeper = best.get(html, i)
        kind = "response" if keeper == i else "revisit"
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), kind, None if kind == "response" else keeper))
    return out


def key(row):
    return tuple((x is None, str(x)) for x in row)


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def same(result, expected):
    assert sorted((tuple(r) for r in result.select(*COLUMNS).collect()), key=key) == sorted(expected, key=key)


def test_query_against_brute_force(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/pages.parquet").select("page_id", "url", "html").collect()]
    same(Q.op13_warc_packages(spark, sf_small), brute(rows))


def test_edge_rows(spark):
    long, wide = "x" * 1000, "é" * 500
    rows = [(1, "http://a/ b\n", long), (2, None, long), (9, "http://c", long), (None, "http://d", long), (3, "u", "x" * 999),
            (4, "u", "x" * 999), (5, "u", None), (6, "u", ""), (7, "u", wide), (8, "u", wide), (9, "http://c", long),
            (None, "n", "y" * 2000), (None, "n", "y" * 2000), (10, "u", "long line\r\n\r\nWARC/1.1 " * 200_000),
            (-3, "", "\x00\U0001F600" * 300)]
    df = spark.createDataFrame(rows, PAGES)
    same(W.page_archives(df.repartition(4)), brute(rows))
    clash = df.withColumns({"payload": F.lit(1), "Key": F.lit(2), "refers_to": F.lit(3)})
    out = W.page_archives(clash)
    same(out, brute(rows))
    assert {r["url"] for r in out.filter("page_id in (1, 2)").collect()} == {"http://a/%20b%0A", None}
    assert W.page_archives(df.limit(0)).count() == 0


def test_hot_payload(spark):
    df = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(
        F.col("id") % 3 == 0, F.repeat(F.lit("z"), 1500)).otherwise(F.col("id").cast("string")).alias("html"))
    out = W.page_archives(df)
    assert out.filter("record_type = 'revisit' and refers_to = 2997").count() == 999 and out.count() == 3000


def package(n=40, limit=None, **names):
    records = [(f"k{i}", W.warc_record("response", f"urn:page:{i}", f"http://x/{i}", b"p%d" % i * (i * 50))) for i in range(n)]
    stream = io.BytesIO()
    assert W.write_package(stream, iter(records), limit=limit, **names) == n
    return stream.getvalue(), records


def records_of(source, limit=W.RANGE_BYTES):
    out = []
    for _, start, length, offsets, lengths in W.record_ranges(source, limit):
        raw = source.read(start, length)
        out += [W.parse_record(raw[o:o + n]) for o, n in zip(offsets, lengths)]
    return [(f["warc-record-id"], block) for f, block in out if f["warc-type"] != "warcinfo"]


def test_package_is_a_zip_and_zip64_is_read():
    raw, records = package()
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None and z.namelist() == ["archive/data.warc.gz", "indexes/data.cdxj"]
        entry = json.loads(z.read("indexes/data.cdxj").split(b"\n")[7].split(b" ", 1)[1])
        part = z.read("archive/data.warc.gz")[entry["offset"]:entry["offset"] + entry["length"]]
    assert W.parse_record(part) == W.parse_record(records[7][1])
    whole = [(f["warc-record-id"], b) for f, b in (W.parse_record(r) for _, r in records)]
    assert records_of(Bytes(raw)) == whole
    assert records_of(Bytes(raw), 500) == whole
    assert records_of(Bytes(b"before it all" + raw)) == whole


@pytest.mark.parametrize("gz", [True, False])
@pytest.mark.parametrize("index", ["indexes/i.cdxj", "indexes/i.cdx.gz", None])
def test_packages_of_others(gz, index):
    _, records = package()
    body, lines = b"", ""
    for k, r in records:
        block = W._gzip(r) if gz else r
        lines += f'{k} 20240101000000 {{"filename":"a.warc{".gz" if gz else ""}","offset":"{len(body)}","length":{len(block)}}}\n'
        body += block
    stream = io.BytesIO()
    with zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED) as z:
        z.writestr("datapackage.json", "{}")
        with z.open(zipfile.ZipInfo("archive/a.warc" + (".gz" if gz else "")), "w", force_zip64=True) as f:
            f.write(body)
        for i in range(70_000 if index is None and gz else 3):  # more members than 16 bits count
            z.writestr(f"pages/{i}", "")
        if index:
            z.writestr(index, W._gzip(lines.encode()) if index.endswith("gz") else lines)
        z.comment = b"a note"
    whole = [(f["warc-record-id"], b) for f, b in (W.parse_record(r) for _, r in records)]
    assert records_of(Bytes(stream.getvalue())) == whole
    assert records_of(Bytes(b"#!sh\n" + stream.getvalue())) == whole


def test_only_ranges_are_read():
    raw, _ = package(4000)
    source = Bytes(raw)
    ranges = list(W.record_ranges(source))
    index = sum(m.size for m in W.members(Bytes(raw)) if m.name.startswith("indexes/"))
    assert sum(n for _, n in source.reads) < index + 4 * 65536 + 100_000 < len(raw) / 3
    assert sum(len(r[3]) for r in ranges) == 4000 and max(r[2] for r in ranges) <= W.RANGE_BYTES


def test_bad_packages():
    raw, _ = package(3)
    for broken in (b"", b"no zip", raw[:-1], raw[:-60]):
        with pytest.raises((ValueError, OSError)):
            records_of(Bytes(broken))
    stream = io.BytesIO()
    with zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/a.warc", "WARC/1.1")
    with pytest.raises(ValueError, match="compressed"):
        records_of(Bytes(stream.getvalue()))


def test_packages_roll_over_and_damage_is_found(spark, tmp_path):
    rows = [(f"urn:page:{i}", "u", b"%d" % i * 3000, None) for i in range(200)]
    df = spark.createDataFrame(rows, "record_id string, url string, payload binary, refers_to string").repartition(2)
    written = W.write_packages(df, f"file://{tmp_path}/p", limit=2000)
    assert written.count() > 10
    out = W.read_packages(written)
    assert {(r["record_id"], bytes(r["payload"])) for r in out.collect()} == {(r[0], r[2]) for r in rows}
    assert written.agg(F.sum("n_records")).first()[0] == 200
    bad = W.warc_record("response", "r", "u", b"abc").replace(b"\r\n\r\nabc", b"\r\n\r\nabd")
    with open(written.first()["uri"].removeprefix("file://"), "wb") as f:
        W.write_package(f, iter([("k", bad)]))
    with pytest.raises(Exception, match="digest"):
        W.read_packages(written).count()
