"""WARC derivative builder: response records to metadata and plain-text conversion records.

A response record's block is an HTTP message. Chunked transfer and gzip or
deflate coding are undone, the character set is that of Content-Type, else of
a meta tag, else UTF-8, and the markup is removed to give a conversion record;
a metadata record lists the source's headers and both digests. Both name the
response in WARC-Refers-To, keep its target URI and date, and carry digests of
their own blocks; record ids are derived from the source's id, and that of a
page from its key, url and payload, so a rerun writes the same records.

A value may hold one record or a whole file of them, gzipped or not; in a file
only responses are converted and other types passed over.

Edge cases: a null or unreadable record, a payload that can't be decoded, and
a value without a response give one row of type ``error`` that says why; null url and null html (in ``response_record``) leave the header out
and the payload empty; pages of any length are converted whole; bytes that are
not of the character set are replaced by U+FFFD; equal rows give equal records;
other columns pass through, but those named like an output are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

EPOCH = "1970-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122's for URLs
VERSION = b"WARC/1.1\r\n"

HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
BREAK = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul)\b[^<>]*>", re.I)
TAG = re.compile(r"<[!/?A-Za-z][^<>]*>")
BLANKS = re.compile(r"[^\S\n]+")
LINES = re.compile(r" ?\n[ \n]*")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def plain_text(page: str) -> str:
    """The visible text, a line for each block element."""
    page = HIDDEN.sub(" ", page)
    page = TAG.sub("", BREAK.sub("\n", page.replace("\n", " ")))
    return LINES.sub("\n", BLANKS.sub(" ", html.unescape(page))).strip()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC record; Content-Length is added."""
    clean = [(k, v.replace("\r", " ").replace("\n", " ")) for k, v in headers]
    head = "".join(f"{k}: {v}\r\n" for k, v in [*clean, ("Content-Length", str(len(block)))])
    return VERSION + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """(headers, block) of the first record."""
    headers, at, end = _bounds(raw, 0)
    return headers, raw[at:end]


def _bounds(raw: bytes, at: int) -> tuple[list[tuple[str, str]], int, int]:
    """(headers, start and end of the block) of the record at ``at``."""
    gap = raw.find(b"\r\n\r\n", at)
    if gap < 0 or not raw.startswith(b"WARC/", at):
        raise ValueError("no WARC header")
    headers = _headers(raw[at:gap].split(b"\r\n")[1:])
    size = dict((k.lower(), v) for k, v in headers).get("content-length", "")
    if not size.isdigit() or len(raw) - gap - 4 < int(size):
        raise ValueError("the block is cut off or has no length")
    return headers, gap + 4, gap + 4 + int(size)


def records(raw: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(headers, block) of every record of a file, gzipped or not."""
    if raw[:2] == b"\x1f\x8b":
        raw = inflated(raw, "gzip")
    at = 0
    while at < len(raw):
        headers, start, end = _bounds(raw, at)
        yield headers, raw[start:end]
        at = end
        while raw[at : at + 1] in (b"\r", b"\n"):
            at += 1


def inflated(data: bytes, coding: str) -> bytes:
    """gzip (of any number of members) or deflate, with or without its header."""
    out = []
    while data.strip(b"\0"):
        for bits in (31,) if coding == "gzip" else (15, -15):
            one = zlib.decompressobj(bits)
            try:
                out.append(one.decompress(data) + one.flush())
            except zlib.error:
                continue
            break
        else:
            raise ValueError(f"{coding} can't be read")
        if not one.eof:
            raise ValueError(f"{coding} is cut off")
        data = one.unused_data if coding == "gzip" else b""
    return b"".join(out)


def unchunked(body: bytes) -> bytes:
    """The body of a chunked transfer."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = re.match(rb"[0-9A-Fa-f]+", body[at : max(end, at)])
        if end < 0 or not size:
            raise ValueError("a chunk has no size")
        n = int(size[0], 16)
        if not n:
            return b"".join(out)
        if len(body) < end + 2 + n:
            raise ValueError("a chunk is cut off")
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


CHARSET = re.compile(r"charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)


def text_of(payload: bytes, headers: dict[str, str]) -> str:
    """A payload's characters, its content coding undone."""
    for coding in reversed([c.strip().lower() for c in headers.get("content-encoding", "").split(",")]):
        if coding in ("gzip", "x-gzip", "deflate"):
            payload = inflated(payload, coding.removeprefix("x-"))
        elif coding not in ("", "identity"):
            raise ValueError(f"content coding {coding}")
    named = CHARSET.search(headers.get("content-type", "")) or CHARSET.search(payload[:1024].decode("latin-1"))
    try:
        return payload.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def _headers(lines: list[bytes]) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and out:  # a folded line
            out[-1] = (out[-1][0], f"{out[-1][1]} {text.strip()}")
        elif ":" in text:
            name, _, value = text.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def response_record(key: str, url: str | None, page: str | None, date: str = EPOCH) -> bytes:
    """A response record around a page, as a crawler would have written it."""
    payload = (page or "").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{uuid.uuid5(NAMESPACE, f'{key} {digest(payload)}').urn}>"), ("WARC-Date", date)]
    headers += [("WARC-Target-URI", url)] if url is not None else []
    headers += [("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http;msgtype=response")]
    return record(headers, block)


def derive(raw: bytes | None) -> list[dict]:
    """The metadata and the conversion record of each response."""
    if raw is None:
        return [{"record_type": "error", "error": "no record"}]
    out, kinds = [], []
    try:
        for headers, block in records(raw):
            source = {k.lower(): v for k, v in headers}
            kinds.append(source.get("warc-type"))
            if kinds[-1] == "response":
                out += _derived(headers, source, block)
    except ValueError as e:
        return [*out, {"record_type": "error", "error": str(e)}]
    return out or [{"record_type": "error", "error": f"no response, but records of type {kinds}"}]


def _derived(headers: list[tuple[str, str]], source: dict[str, str], block: bytes) -> list[dict]:
    if not source.get("warc-record-id"):
        return [{"record_type": "error", "error": "no record id"}]
    http, _, body = block.partition(b"\r\n\r\n")
    status, *lines = http.split(b"\r\n")
    http_headers = _headers(lines)
    named = {k.lower(): v for k, v in http_headers}
    origin = source["warc-record-id"]
    try:
        payload = unchunked(body) if "chunked" in named.get("transfer-encoding", "").lower() else body
        text = plain_text(text_of(payload, named))
    except ValueError as e:
        return [{"record_type": "error", "refers_to": origin, "target_uri": source.get("warc-target-uri"), "error": str(e)}]
    found = digest(payload)
    stated = source.get("warc-payload-digest")
    agrees = stated in (found, digest(body))  # some writers digest the chunked form
    linked = [("WARC-Refers-To", origin)] + [(n, source[n.lower()]) for n in ("WARC-Target-URI",) if n.lower() in source]
    fields = [("source-status", status.decode("utf-8", "replace")), *[(f"source-http-{k.lower()}", v) for k, v in http_headers]]
    fields += [(f"source-{k.lower()}", v) for k, v in headers]
    fields += [("payload-digest", found), ("payload-digest-agrees", "unknown" if stated is None else str(agrees).lower()), ("text-characters", str(len(text)))]
    meta = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    out = []
    for kind, media, body in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain; charset=utf-8", text.encode())):
        own = f"<{uuid.uuid5(NAMESPACE, f'{kind} {origin}').urn}>"
        head = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", source.get("warc-date", EPOCH)), *linked]
        head += [("WARC-Block-Digest", digest(body)), ("Content-Type", media)]
        out.append({
            "record_type": kind, "record_id": own, "refers_to": origin, "target_uri": source.get("warc-target-uri"), "content_length": len(body),
            "block_digest": digest(body), "payload_digest": found, "record": record(head, body), "error": None,
        })
    return out


KINDS = {"record_type": T.StringType(), "record_id": T.StringType(), "refers_to": T.StringType(), "target_uri": T.StringType(), "content_length": T.LongType(), "block_digest": T.StringType(), "payload_digest": T.StringType(), "record": T.BinaryType(), "error": T.StringType()}
ARROW = {"record_type": pa.string(), "record_id": pa.string(), "refers_to": pa.string(), "target_uri": pa.string(), "content_length": pa.int64(), "block_digest": pa.string(), "payload_digest": pa.string(), "record": pa.binary(), "error": pa.string()}
AT_ONCE = 256


def derivatives(records: DataFrame, warc_col: str = "warc") -> DataFrame:
    """Two rows for each response in ``warc_col`` (binary, a record or a file of them): its metadata and its conversion record."""
    keep = [f for f in records.schema.fields if f.name != warc_col and f.name.lower() not in KINDS]
    names = [f.name for f in keep]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                yield _rows(batch.slice(at, AT_ONCE), names, batch.schema.names[-1])

    return records.select(*[f"`{n}`" for n in names], f"`{warc_col}`").mapInArrow(run, T.StructType([*keep, *[T.StructField(k, t) for k, t in KINDS.items()]]))


def _rows(part: pa.RecordBatch, names: list[str], warc_col: str) -> pa.RecordBatch:
    made = [derive(raw) for raw in part.column(warc_col).to_pylist()]
    which = pa.array([i for i, rows in enumerate(made) for _ in rows], pa.int64())
    flat = [r for rows in made for r in rows]
    return pa.RecordBatch.from_arrays([part.column(n).take(which) for n in names] + [pa.array([r.get(k) for r in flat], t) for k, t in ARROW.items()], names=[*names, *ARROW])


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A table of pages as response records: id and warc."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                key, url, page = (part.column(i).to_pylist() for i in range(3))
                warc = pa.array([response_record(f"{k} {u}", u, p) for k, u, p in zip(key, url, page)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), warc], names=[id_col, "warc"])

    schema = T.StructType([pages.schema[id_col], T.StructField("warc", T.BinaryType())])
    return pages.select(id_col, url_col, html_col).mapInArrow(run, schema)
