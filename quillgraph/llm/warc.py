"""WARC: reading and writing records, and a builder of derivative records.

For each response record the builder makes a ``metadata`` record (warc-fields: title,
language, outlinks, charset, status and the source's headers) and a ``conversion`` record
(the page's plain text). Both name the response in WARC-Refers-To with its target URI and
date, carry digests of their own block, and keep the response's digest as a field.
Records are rows, so any number of files is built without a shuffle.

Record ids are name-based (UUID version 5 of the response's id and the record's type; a response made of a
row is named by page_id, url and digest), so building again gives the same records.
Work is linear in a page, whatever is in it.

Defined results: null html or url counts as empty; a page without text has an empty
conversion block; a response without an HTTP header is all payload; bytes that aren't
UTF-8 are read with replacement; files that end inside a record give that record's rest
as its block with ``truncated`` true.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "headers map<string,string>, block binary, truncated boolean"
#: Headers of records made here that a table of pages has no value for.
DATE = "1970-01-01T00:00:00Z"

# What elements mean.
_DROPPED = frozenset("script style noscript template svg head".split())
_RAW = {n: re.compile(rf"(?i)</{n}\s*+>") for n in ("script", "style")}
_BREAK = frozenset("p div br hr h1 h2 h3 h4 h5 h6 li ul ol tr table section article nav header footer aside main blockquote pre dl dt dd figure form title".split())
_CELL = frozenset(("td", "th"))
_LINKS = frozenset("a link img script iframe".split())

# Every pattern goes over a text once: none can give back what it has taken.
_TAG = re.compile(r"<!--|<[!?][^<>]*+>|<(/?+)([A-Za-z][^\s<>/]*+)([^<>]*+)>")
_TITLE_END = re.compile(r"(?i)</title")
_LANG = re.compile(r"(?i)\slang\s*+=\s*+[\"']?+([\w-]++)")
_LINK = re.compile(r"(?i)\s(href|src)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
_CHARSET = re.compile(r"(?i)charset\s*=\s*[\"']?([\w-]+)")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*names: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(names))}>"


@dataclass
class Page:
    """What one pass over the tags of a page finds. A tag ends at the next ``<`` or ``>``; what isn't ended by ``>`` is text."""

    title: str | None = None
    lang: str | None = None
    links: list[tuple[str, str, str]] = field(default_factory=list)
    text: str = ""

    @classmethod
    def of(cls, page: str) -> Page:
        own, pieces = cls(), []
        at, shown, dropped = 0, 0, None  # text from ``shown`` on isn't taken yet; the element that is left out
        while m := _TAG.search(page, at):
            at = m.end()
            name, closing = (m[2] or "").lower(), bool(m[1])
            if dropped is None:
                pieces += [page[shown : m.start()], "\n" if name in _BREAK else "\t" if name in _CELL else ""]
                shown = at
            if m[0] == "<!--":
                end = page.find("-->", at)
                at = shown = len(page) if end < 0 else end + 3
                pieces.append(" ")
                continue
            if not name:
                continue
            if closing:
                if name == dropped:
                    dropped, shown = None, at
                continue
            own._opened(page, name, m[3], at)
            if dropped is None and name in _DROPPED:
                dropped = name
                pieces.append(" ")
            if name in _RAW:
                end = _RAW[name].search(page, at)
                at = end.end() if end else len(page)
                if dropped == name:
                    dropped, shown = (None, at) if end else (name, at)
        pieces.append("" if dropped else page[shown:])
        body = html.unescape("".join(pieces))
        lines = (re.sub(r"[^\S\n]+", " ", line).strip() for line in body.split("\n"))
        own.text = "\n".join(line for line in lines if line)
        return own

    def _opened(self, page: str, name: str, attributes: str, at: int) -> None:
        if name == "title" and self.title is None and (end := _TITLE_END.search(page, at)):
            self.title = " ".join(html.unescape(page[at : end.start()]).split())
        elif name == "title" and self.title is None:
            self.title = ""
        elif name == "html" and self.lang is None and (m := _LANG.search(attributes)):
            self.lang = m[1].lower()
        elif name in _LINKS and (m := _LINK.search(attributes)):
            url = html.unescape(m[2] or m[3] or m[4] or "").strip()
            self.links += [(url, name, m[1].lower())] if url else []


def plain_text(page: str) -> str:
    """The text of a page: blocks on lines of their own, entities decoded, white space collapsed."""
    return Page.of(page).text


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    truncated: bool = False

    def header(self, name: str, default: str = "") -> str:
        return next((v for k, v in self.headers.items() if k.lower() == name.lower()), default)

    def to_bytes(self) -> bytes:
        lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in self.headers.items() if k.lower() != "content-length"), f"Content-Length: {len(self.block)}"]
        return "\r\n".join(lines).encode() + b"\r\n\r\n" + self.block + b"\r\n\r\n"


@dataclass
class Http:
    """Status, headers and payload of a response's block."""

    status: str = ""
    headers: list[tuple[str, str]] = field(default_factory=list)
    payload: bytes = b""

    @classmethod
    def of(cls, block: bytes) -> Http:
        if not block.startswith(b"HTTP/"):
            return cls(payload=block)
        cut = re.search(rb"\r?\n\r?\n", block)
        head, payload = (block[: cut.start()], block[cut.end() :]) if cut else (block, b"")
        first, *rest = head.decode("latin-1").splitlines()
        headers: list[tuple[str, str]] = []
        for line in rest:
            if line[:1] in " \t" and headers:
                headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}")
            elif ":" in line:
                name, _, value = line.partition(":")
                headers.append((name.strip(), value.strip()))
        found = dict((k.lower(), v.lower()) for k, v in headers)
        if found.get("transfer-encoding") == "chunked":
            payload = cls._unchunked(payload)
        if found.get("content-encoding") in ("gzip", "x-gzip", "deflate"):
            try:
                payload = zlib.decompressobj(zlib.MAX_WBITS | 32).decompress(payload)
            except zlib.error:
                pass  # the payload is kept as it came
        return cls(first.split(" ", 2)[1] if " " in first else "", headers, payload)

    @staticmethod
    def _unchunked(data: bytes) -> bytes:
        out, at = [], 0
        while m := re.compile(rb"([0-9A-Fa-f]+)[^\r\n]*\r?\n").match(data, at):
            size = int(m[1], 16)
            if size == 0:
                break
            out.append(data[m.end() : m.end() + size])
            at = m.end() + size
            at += 2 if data[at : at + 2] == b"\r\n" else 1
        return b"".join(out) if out else data

    def text(self) -> str:
        content_type = next((v for k, v in self.headers if k.lower() == "content-type"), "")
        charset = (_CHARSET.search(content_type) or _CHARSET.search(self.payload[:1024].decode("latin-1")) or [None, "utf-8"])[1]
        try:
            return self.payload.decode(charset, "replace")
        except LookupError:
            return self.payload.decode("utf-8", "replace")


def derivatives(response: Record) -> list[Record]:
    """The metadata and conversion records of a response, linked to it."""
    http = Http.of(response.block)
    page = http.text()
    source = response.header("WARC-Record-ID")
    common = {"WARC-Refers-To": source, "WARC-Refers-To-Target-URI": response.header("WARC-Target-URI"), "WARC-Refers-To-Date": response.header("WARC-Date"), "WARC-Target-URI": response.header("WARC-Target-URI"), "WARC-Date": response.header("WARC-Date")}
    fields = [("http-status", http.status), *((f"http-header-{k.lower()}", v) for k, v in http.headers)]
    fields += [("source-block-digest", response.header("WARC-Block-Digest") or digest(response.block)), ("source-payload-digest", response.header("WARC-Payload-Digest") or digest(http.payload))]
    found = Page.of(page)
    fields += [("title", found.title or ""), ("language", found.lang or "")]
    fields += [("outlink", f"{re.sub(r'\s+', '%20', url)} {tag}/@{attribute}") for url, tag, attribute in found.links]
    block = "".join(f"{k}: {v}\r\n" for k, v in fields if v).encode()
    text = found.text.encode()
    made = []
    for kind, content_type, body in (("metadata", "application/warc-fields", block), ("conversion", "text/plain; charset=utf-8", text)):
        headers = {"WARC-Type": kind, "WARC-Record-ID": record_id(source, kind), **{k: v for k, v in common.items() if v}, "Content-Type": content_type, "WARC-Block-Digest": digest(body)}
        made.append(Record(headers, body))
    return made


def response_of(url: str, page: str, date: str = DATE, number: object = "") -> Record:
    """A response record of a page from a table; number tells pages apart that have one url and text."""
    payload = page.encode("utf-8", "replace")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    headers = {"WARC-Type": "response", "WARC-Record-ID": record_id(str(number), url, hashlib.sha256(payload).hexdigest()), "WARC-Target-URI": url, "WARC-Date": date, "Content-Type": "application/http; msgtype=response", "WARC-Block-Digest": digest(block), "WARC-Payload-Digest": digest(payload)}
    return Record(headers, block)


def parse(data: bytes) -> Iterator[Record]:
    """The records of a file's bytes, gzipped (by record or whole) or plain."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    reader = io.BufferedReader(stream)
    while line := reader.readline():
        if not line.startswith(b"WARC/"):
            continue
        headers: dict[str, str] = {}
        last = ""
        while (line := reader.readline().rstrip(b"\r\n")):
            text = line.decode("utf-8", "replace")
            if text[0] in " \t" and last:
                headers[last] += " " + text.strip()
            elif ":" in text:
                last, _, value = text.partition(":")
                headers[last] = value.strip()
        size = next((v for k, v in headers.items() if k.lower() == "content-length"), "0")
        size = int(size) if size.isdigit() else 0
        block = reader.read(size)
        yield Record(headers, block, len(block) < size)


def _rows(records: list[Record]) -> pa.RecordBatch:
    maps = pa.array([list(r.headers.items()) for r in records], pa.map_(pa.string(), pa.string()))
    return pa.RecordBatch.from_arrays([maps, pa.array([r.block for r in records], pa.binary()), pa.array([r.truncated for r in records], pa.bool_())], names=["headers", "block", "truncated"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files under a path that Spark can read: headers, block, truncated."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                held, size = [], 0
                for record in parse(data.as_py()):
                    held.append(record)
                    size += len(record.block)
                    if size > 8_000_000:
                        yield _rows(held)
                        held, size = [], 0
                yield _rows(held)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(records, RECORD)


def responses(pages: DataFrame) -> DataFrame:
    """Response records of the rows of pages (url, html and, if there is one, page_id)."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _rows([response_of(u or "", h or "", number=n) for u, h, n in zip(*(c.to_pylist() for c in batch.columns), strict=True)])

    return pages.select("url", "html", F.col("page_id") if "page_id" in pages.columns else F.lit("")).mapInArrow(records, RECORD)


def derived(records: DataFrame) -> DataFrame:
    """The metadata and conversion records of the response records among the rows."""

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for headers, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                record = Record(dict(headers or []), block or b"")
                if record.header("WARC-Type").lower() == "response":
                    out += derivatives(record)
            yield _rows(out)

    return records.select("headers", "block").mapInArrow(built, RECORD)


def file_bytes(headers: str = "headers", block: str = "block", zipped: bool = True) -> Column:
    """Each record as the bytes of a WARC file (a gzip member of its own); files are their concatenation."""

    @F.arrow_udf("binary")
    def encode(h: pa.Array, b: pa.Array) -> pa.Array:
        made = (Record(dict(x or []), y or b"").to_bytes() for x, y in zip(h.to_pylist(), b.to_pylist(), strict=True))
        return pa.array([gzip.compress(m, mtime=0) if zipped else m for m in made], pa.binary())

    return encode(F.col(headers), F.col(block))


def op3_warc_derivatives(pages: DataFrame) -> DataFrame:
    """Two rows for each page: its metadata and its conversion record, with their links, digests and text."""

    @F.arrow_udf("array<struct<record_type:string,record_id:string,refers_to:string,target_uri:string,content_type:string,block_digest:string,source_digest:string,content_length:bigint,content:string>>")
    def build(urls: pa.Array, bodies: pa.Array, numbers: pa.Array) -> pa.Array:
        out = []
        for url, body, number in zip(urls.to_pylist(), bodies.to_pylist(), numbers.to_pylist(), strict=True):
            response = response_of(url or "", body or "", number=number)
            out.append(
                [
                    {"record_type": r.header("WARC-Type"), "record_id": r.header("WARC-Record-ID"), "refers_to": r.header("WARC-Refers-To"), "target_uri": r.header("WARC-Target-URI"), "content_type": r.header("Content-Type"), "block_digest": r.header("WARC-Block-Digest"), "source_digest": response.header("WARC-Payload-Digest"), "content_length": len(r.block), "content": r.block.decode()}
                    for r in derivatives(response)
                ]
            )
        kind = pa.struct([(n, pa.int64() if n == "content_length" else pa.string()) for n in ("record_type", "record_id", "refers_to", "target_uri", "content_type", "block_digest", "source_digest", "content_length", "content")])
        return pa.array(out, pa.list_(kind))

    return pages.select("page_id", F.explode(build(F.col("url"), F.col("html"), F.col("page_id"))).alias("r")).select("page_id", "r.*")
