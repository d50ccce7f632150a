"""WARC (operator 7): derivative builder.

Method. Every ``response`` record gives two derivatives: a ``metadata`` record (``application/warc-fields``: title, language, outlinks,
and the source's own headers) and a ``conversion`` record (``text/plain``: the page's text). Both carry the response's id in
``WARC-Refers-To``, its target URI, date and payload digest, and have block digests of their own. Ids are made from what a record
holds, so a task that runs again makes the same records. A response whose digest does not fit its block is marked
``digest_ok = false`` and still converted. A page is read by one forward pass over its marks (:func:`read_page`), whose time is
proportional to its length whatever it holds.

The operator reads whole records, so the same code serves folders of WARC files (:func:`read_files`, plain or gzip) and the
``pages`` table (:func:`responses`).

Defined cases: null html counts as an empty page; a null or empty URL leaves the target URI out; line breaks in a URL or header value are
percent-encoded or blanked, as they would end the header; repeated rows are one record, made twice with one id; a response without an
HTTP head is taken as payload only; records of other types give nothing; a null or malformed record gives one row of type ``invalid`` with the ``reason``, and
the others go on; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATE = "1970-01-01T00:00:00Z"
SCHEMA = ("page_id long, record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, "
          "block_digest string, source_payload_digest string, source_content_type string, digest_ok boolean, block_sha256 string, reason string")

#: Tags that part lines, tags whose content is no text, and those that a page's head may hold: any other one ends a head that is not closed.
BREAKS = set("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 article section nav header footer main aside blockquote pre hr title td th dd dt".split())
SKIPPED = set("script style noscript template".split())
OF_HEAD = set("html head title meta link base".split()) | SKIPPED
_MARK = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_END = {x: re.compile(f"</{x}", re.IGNORECASE) for x in [*SKIPPED, "title"]}
_HREF = re.compile(r"(?<![\w-])href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)
_LANG = re.compile(r"(?<![\w-])lang\s*=\s*[\"']?([A-Za-z-]+)", re.IGNORECASE)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(value: str) -> str:
    return " ".join(value.split())


def build(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record; its length header is added."""
    head = "".join(f"{k}: {_line(v)}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of one record."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/") or not gap:
        raise ValueError("not a WARC record")
    headers: dict[str, str] = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        headers[name.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    if not length.isdecimal():
        raise ValueError("no Content-Length")
    if len(rest) < int(length):
        raise ValueError("truncated record")
    return headers, rest[:int(length)]


def _members(data: bytes, step: int = 1 << 16) -> Iterator[tuple[bytes, str | None]]:
    """What a file says, a gzip member a time, and what is wrong with it; a plain file is one member."""
    if data[:2] != b"\x1f\x8b":
        yield data, None
        return
    at = 0
    while at >= 0 and at < len(data):
        out, pos, machine = [], at, zlib.decompressobj(31)
        try:
            while not machine.eof and pos < len(data):
                out.append(machine.decompress(data[pos:pos + step]))
                pos += step
            if not machine.eof:
                yield b"".join(out), "truncated gzip member"
                return
            yield b"".join(out), None
            at = min(pos, len(data)) - len(machine.unused_data)
            if data[at:at + 2] != b"\x1f\x8b":
                at = data.find(b"\x1f\x8b\x08", at)
        except zlib.error:
            yield b"".join(out), "broken gzip member"
            at = data.find(b"\x1f\x8b\x08", at + 1)


def read_records(data: bytes) -> Iterator[tuple[bytes | None, str | None]]:
    """(record, None) for each record of a WARC file, plain or gzip with any number of members, and (None, reason) for each bad part."""
    for part, wrong in _members(data):
        at = 0
        while at < len(part):
            reason, end = "bytes that are no record", part.find(b"\r\n\r\n", at)
            if part.startswith(b"WARC/", at):
                length = re.search(rb"\r\ncontent-length:[ \t]*(\d+)[ \t]*\r\n", part[at:end + 4], re.IGNORECASE) if end >= 0 else None
                reason = wrong or ("no Content-Length" if end >= 0 else "truncated record")
                if length:
                    stop = end + 4 + int(length[1])
                    if stop <= len(part) and (stop + 4 > len(part) or part.startswith(b"\r\n\r\n", stop)):
                        yield part[at:stop + 4], None
                        at = stop + 4
                        continue
                    reason = wrong or "truncated record" if stop > len(part) else "wrong Content-Length"
            if part[at:].strip():
                yield None, reason
            after = part.find(b"\r\nWARC/1.", at)
            at = after + 2 if after >= 0 else len(part)
        if wrong and not part:
            yield None, wrong


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, page_id, record, reason``: the records of all ``.warc`` and ``.warc.gz`` files below a folder, ``page_id`` being their place in the file.

    Files come through Spark's own reader, so any storage will do; one file is held by one task, and its records leave it in small batches.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc*").load(path).select("path", "content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, size = [], 0
                for place, (record, reason) in enumerate(read_records(content.as_py())):
                    rows.append((name, place, record, reason))
                    size += len(record or b"") + 100
                    if size > 1 << 24:
                        yield made(rows)
                        rows, size = [], 0
                if rows:
                    yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.binary(), pa.string()))], ["path", "page_id", "record", "reason"])

    return files.mapInArrow(run, "path string, page_id long, record binary, reason string")


def record_id(*parts: bytes) -> str:
    h = hashlib.sha256()
    for p in parts:
        h.update(len(p).to_bytes(8, "big") + p)
    return f"<urn:uuid:{uuid.UUID(bytes=h.digest()[:16], version=5)}>"


def response(page_id: int | None, url: str | None, page: str | None, date: str = DATE) -> bytes:
    """A response record of a page."""
    payload = (page or "").encode("utf-8", "surrogatepass")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n" + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    rid = record_id(b"response", str(page_id).encode(), uri.encode("utf-8", "surrogatepass"), payload)
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", rid), ("WARC-Date", date), *([("WARC-Target-URI", uri)] if uri else []),
               ("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", digest(payload)), ("Content-Type", "application/http; msgtype=response")]
    return build(headers, block)


def http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, headers, payload) of an HTTP response."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or not gap:
        return "", [], block
    lines = head.decode("utf-8", "replace").split("\r\n")
    return lines[0], [(a.strip(), b.strip()) for a, _, b in (x.partition(":") for x in lines[1:])], payload


def _lines(text: str) -> str:
    return "\n".join(x for line in entities.unescape(text).split("\n") if (x := " ".join(line.split())))


def read_page(page: str) -> tuple[str, str | None, str | None, list[str]]:
    """(text, title, language, outlinks) of a page, in one forward pass.

    Text: no scripts, styles, templates, comments and head; blocks on lines of their own, runs of blanks as one. A head that is not closed ends where the
    body begins: at a tag that no head holds, or at a word. A tag that is not closed is text; skipped content that is not closed goes on to the end.
    """
    out: list[str] = []
    title = language = None
    links: list[str] = []
    in_head, at = False, 0
    while m := _MARK.search(page, at):
        name = (m[3] or "").lower()
        end = page.find("-->" if m[1] else ">", m.end())
        if end < 0 and not m[1]:
            break
        said = page[at:m.start()]
        if in_head and said.strip():
            in_head = False
        if not in_head:
            out.append(said)
        if m[1]:
            out.append("\n")
            at = end + 3 if end >= 0 else len(page)
            continue
        rest, at = page[m.end():end], end + 1
        if m[2]:
            if name == "head":
                in_head = False
                out.append("\n")
        elif name == "head":
            in_head = True
        elif name in _END:
            close = _END[name].search(page, at)
            stop = close.start() if close else len(page)
            if name == "title":
                title = entities.unescape(page[at:stop]) if title is None else title
                if not in_head:
                    out.append("\n" + page[at:stop].replace("<", "&lt;"))
            gt = page.find(">", stop) if close else -1
            at = gt + 1 if gt >= 0 else len(page)
            out.append("\n")
        elif in_head and name and name not in OF_HEAD:
            in_head = False
        if name == "a" and not m[2] and (link := _HREF.search(rest)):
            links.append(entities.unescape(next((x for x in link.groups() if x is not None), "")))
        if name == "html" and not m[2] and language is None and (lang := _LANG.search(rest)):
            language = lang[1]
        if name in BREAKS and not in_head:
            out.append("\n")
    if not in_head or page[at:].strip():
        out.append(page[at:])
    return _lines("".join(out)), title, language, links


def derivatives(record: bytes) -> list[tuple[list[tuple[str, str]], bytes, bool, str]]:
    """(headers, block, source digest fits, source content type) of the metadata and the conversion record of a response; of no other record any."""
    source, block = parse(record)
    if "warc-type" not in source or "warc-record-id" not in source:
        raise ValueError("no WARC-Type or WARC-Record-ID")
    if source["warc-type"].lower() != "response":
        return []
    status, headers, payload = http(block)
    own = digest(payload)
    fits = source.get("warc-block-digest", digest(block)) == digest(block) and source.get("warc-payload-digest", own) == own
    rid = source["warc-record-id"]
    page = payload.decode("utf-8", "replace")
    kind = next((v for k, v in headers if k.lower() == "content-type"), source.get("content-type", ""))
    shared = [("WARC-Refers-To", rid), ("WARC-Date", source.get("warc-date", DATE)), *([("WARC-Target-URI", source["warc-target-uri"])] if source.get("warc-target-uri") else []), ("WARC-Source-Payload-Digest", source.get("warc-payload-digest", own))]
    fields = [("source-status", status), *((f"source-header-{k}", v) for k, v in headers), ("source-content-type", kind)]
    said, title, language, links = read_page(page)
    fields += [(k, v) for k, v in (("title", title), ("language", language)) if v is not None]
    fields += [("outlink", x) for x in links]
    meta = "".join(f"{_line(k)}: {_line(v)}\r\n" for k, v in fields).encode("utf-8", "surrogatepass")
    text = said.encode("utf-8", "surrogatepass")
    out = []
    for name, content, body in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain; charset=utf-8", text)):
        head = [("WARC-Type", name), ("WARC-Record-ID", record_id(name.encode(), rid.encode(), body)), *shared, ("WARC-Block-Digest", digest(body)), ("Content-Type", content)]
        out.append((head, body, fits, kind))
    return out


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """``page_id, record binary``: a response record of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [response(i.as_py(), u.as_py(), h.as_py(), date) for i, u, h in zip(*batch.columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["page_id", "record"])

    return rows.mapInArrow(run, "page_id long, record binary")


def derive(records: DataFrame, with_record: bool = False) -> DataFrame:
    """Two rows a response (``page_id, record``), one a bad record; ``with_record`` adds the finished WARC bytes. A map-only plan: no shuffle."""
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")] + ["record"] * with_record

    def rows_of(page_id: int | None, record: bytes | None) -> Iterator[list]:
        try:
            if record is None:
                raise ValueError("null record")
            made = derivatives(record)
        except ValueError as e:
            yield [page_id, "invalid", *[None] * 11, str(e), *[None] * with_record]
            return
        for head, body, fits, kind in made:
            h = dict(head)
            yield [page_id, h["WARC-Type"], h["WARC-Record-ID"], h["WARC-Refers-To"], h.get("WARC-Target-URI"), h["WARC-Date"], h["Content-Type"], len(body), h["WARC-Block-Digest"],
                   h["WARC-Source-Payload-Digest"], kind, fits, hashlib.sha256(body).hexdigest(), None, *([build(head, body)] if with_record else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), *[pa.string()] * 6, pa.int64(), *[pa.string()] * 3, pa.bool_(), pa.string(), pa.string(), *[pa.binary()] * with_record]
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for page_id, record in zip(batch.column(0), batch.column(1)):
                for row in rows_of(page_id.as_py(), record.as_py()):
                    for c, v in zip(cols, row):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return records.select("page_id", "record").mapInArrow(run, SCHEMA + ", record binary" * with_record)
