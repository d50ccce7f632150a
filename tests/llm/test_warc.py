"""Derivative records against an independent reading of pages and records."""

import gzip
import hashlib
import os
from html.parser import HTMLParser

import pytest

from codeweave.llm import warc

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


class Reader(HTMLParser):
    """Words of a page outside scripts, styles and the head, and its links, by the standard parser."""

    def __init__(self):
        super().__init__()
        self.words, self.links, self.off = [], [], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style", "head")
        if tag == "a" and dict(attrs).get("href") is not None:
            self.links.append(dict(attrs)["href"])

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style", "head")

    def handle_data(self, data):
        if not self.off:
            self.words.append(data)


def test_query(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    source = {r["page_id"]: r["record"] for r in warc.responses(pages).collect()}
    page = {r["page_id"]: r for r in pages.collect()}
    rows = warc.derive(warc.responses(pages), with_record=True).collect()
    assert len(rows) == 2 * len(page) and {r["record_type"] for r in rows} == {"metadata", "conversion"} and len({r["record_id"] for r in rows}) == len(rows)
    for r in rows:
        headers, block = warc.parse(source[r["page_id"]])
        own, body = warc.parse(r["record"])
        p = page[r["page_id"]]
        assert r["refers_to"] == own["warc-refers-to"] == headers["warc-record-id"] and r["target_uri"] == own["warc-target-uri"] == headers["warc-target-uri"] == p["url"]
        assert r["warc_date"] == headers["warc-date"] and r["source_payload_digest"] == headers["warc-payload-digest"] == warc.digest(p["html"].encode()) and r["digest_ok"]
        assert r["block_digest"] == own["warc-block-digest"] == warc.digest(body) and r["content_length"] == len(body) and r["block_sha256"] == hashlib.sha256(body).hexdigest()
        reader = Reader()
        reader.feed(p["html"])
        if r["record_type"] == "conversion":
            assert "".join(body.decode().split()) == "".join("".join(reader.words).split())
        else:
            fields = [x.split(": ", 1) for x in body.decode().split("\r\n")[:-1]]
            assert [v for k, v in fields if k == "outlink"] == [" ".join(x.split()) for x in reader.links]
            assert ["source-header-Content-Type", "text/html; charset=utf-8"] in fields and fields[0] == ["source-status", "HTTP/1.1 200 OK"]


def test_files_and_odd_records(spark):
    records = [warc.response(1, "http://a/b c\r\nX: y", "<title>A &amp; B</title><p>x<script>no</script> y &lt;z&gt;"), warc.response(None, None, None), warc.response(2, "", "<!-- open")]
    plain, packed = b"".join(records), b"".join(gzip.compress(r) for r in records)
    good = [(r, None) for r in records]
    assert list(warc.read_records(plain)) == list(warc.read_records(packed)) == list(warc.read_records(gzip.compress(plain))) == good and list(warc.read_records(b"")) == []
    assert list(warc.read_records(b"junk")) == [(None, "bytes that are no record")]
    no_length = records[1].replace(b"Content-Length: ", b"X-Length: ", 1).replace(b"\r\nContent-Length: ", b"\r\nX: ")
    for bad, reason in ((b"junk\r\n\r\n", "bytes that are no record"), (no_length, "no Content-Length"), (records[2][:-30] + b"\r\n\r\n", "wrong Content-Length")):
        assert list(warc.read_records(records[0] + bad + records[1])) == [good[0], (None, reason), good[1]]
    broken = bytearray(gzip.compress(records[1]))
    broken[12:40] = b"\xff" * 28
    assert list(warc.read_records(gzip.compress(records[0]) + bytes(broken) + gzip.compress(records[2]))) == [good[0], (None, "broken gzip member"), good[2]]
    assert list(warc.read_records(gzip.compress(records[0]) + gzip.compress(records[2])[:-9]))[0] == good[0]
    (meta, fields, ok, _), (conversion, text, _, _) = warc.derivatives(records[0])
    assert ok and text == b"A & B\nx\ny <z>" and b"title: A & B\r\n" in fields and dict(meta)["WARC-Target-URI"] == "http://a/b%20c%0D%0AX:%20y" and len(warc.parse(records[0])[0]) == 8
    assert [b for _, b, _, _ in warc.derivatives(records[1])][1] == b"" and "WARC-Target-URI" not in dict(warc.derivatives(records[1])[0][0])
    broken = records[0].replace(b"x<script>", b"X<script>")
    assert not warc.derivatives(broken)[0][2]
    assert warc.derivatives(warc.build([("WARC-Type", "request"), ("WARC-Record-ID", "<urn:x>")], b"x")) == []
    with pytest.raises(ValueError):
        warc.parse(no_length)
    assert warc.derivatives(warc.build([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>")], b"only <b>payload</b>"))[1][1] == b"only payload"
    odd = spark.createDataFrame([(1, None, None, 1), (None, "", "", 1), (3, "u", "<p>" + "word " * 200_000, 1), (3, "u", "same", 1), (3, "u", "same", 1)], "page_id long, url string, html string, record int")
    got = warc.derive(warc.responses(odd)).collect()
    assert len(got) == 10 and len({r["record_id"] for r in got}) == 8
    assert warc.derive(warc.responses(odd.limit(0))).count() == 0


def test_pages_of_all_kinds():
    read = lambda page: warc.read_page(page)[0]
    assert read("<html><head><title>t</title><meta x><body><p>one") == "one" and read("<head><title>t</title>word<p>two") == "word\ntwo" and read("<HEAD><Link a><DIV>x</DIV>") == "x"
    assert read("a<!-- b --> c<!-- d") == "a\nc" and read("a <b>c</b>d <script>x</SCRIPT >e<style>f") == "a cd\ne" and read("1 < 2 <3 <a") == "1 < 2 <3 <a"
    assert warc.read_page("<html lang='de'><title>A &lt; B</title><a data-href=x href = 'u&amp;v'>l</a><a href=w>m</a><a>n</a>")[1:] == ("A < B", "de", ["u&v", "w"])


def test_time_follows_length():
    import time

    for unit in ("<a ", "<!-- ", "<a href=\"", "<script>", "<title>", "<head>", "<html lang", "</p", "&amp", "<p>"):
        began = time.perf_counter()
        warc.read_page(unit * (1_000_000 // len(unit) * 3))
        assert time.perf_counter() - began < 20, unit


def test_bad_records_in_a_folder(spark, tmp_path):
    records = [warc.response(i, f"http://a/{i}", f"<p>page {i}") for i in range(4)]
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.warc").write_bytes(records[0] + b"WARC/1.1\r\nWARC-Type: response\r\n\r\nno length\r\n\r\n" + records[1])
    (tmp_path / "deep" / "b.warc.gz").write_bytes(gzip.compress(warc.build([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:i>")], b"x")) + b"".join(gzip.compress(r) for r in records[2:]))
    read = warc.read_files(spark, f"file://{tmp_path}")
    assert sorted((r["path"][-4:], r["page_id"], r["reason"]) for r in read.collect()) == [
        ("c.gz", 0, None), ("c.gz", 1, None), ("c.gz", 2, None), ("warc", 0, None), ("warc", 1, "no Content-Length"), ("warc", 2, None)]
    got = warc.derive(read).collect()
    assert sorted(r["record_type"] for r in got) == ["conversion"] * 4 + ["invalid"] + ["metadata"] * 4
    assert [r["reason"] for r in got if r["record_type"] == "invalid"] == ["null record"]
