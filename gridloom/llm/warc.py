"""WARC derivatives: linked metadata and plain-text conversion records of responses.

``responses`` makes WARC/1.1 response records of a page table, ``derive`` turns response
records into two records each: a ``conversion`` with the page's plain text, and a
``metadata`` with what was on the page (title, links, language, HTTP status and
headers). Both name their source in WARC-Refers-To (and its target and date in the
WARC-Refers-To-* headers), the metadata also names the conversion, and both carry the
source's payload digest and headers on. ``serialize`` and ``parse`` are exact inverses
on records; ``write_files`` and ``read_files`` keep them as gzip members in Parquet,
``write_warc`` and ``read_warc`` as .warc.gz files, which are inflated record by record.
A page's markup is read in one linear pass, whatever its tags look like.

Every step works on one record at a time, so nothing is shuffled and memory is bounded
by the largest page.

Edge cases: a null html is an empty payload; a null url gives no target. Record ids are
derived from page_id, url and payload, so rows repeated whole have equal ids, and a
rerun of a lost task gives the same ones. Header names are compared without case; what
is derived of a record without an id refers to none. A response whose block isn't HTTP is taken as
payload whole; chunked, gzip and deflate bodies are decoded for the text, and the digest
stays that of the payload as it came. Records of other types are passed over by ``derive``. Undecodable bytes
of a payload become U+FFFD in the text only. Extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import itertools
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bytewords as bw
from gridloom.llm.session import tune

#: Pages carry no time of capture.
DATE = "1970-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
RECORDS = "page_id long, warc_type string, headers array<struct<name:string,value:string>>, block binary"
DERIVED = RECORDS + ", record_id string, refers_to string, target_uri string, payload_digest string, block_digest string, content_length long, text string"
#: Source headers that derived records carry on.
CARRIED = ("WARC-Target-URI", "WARC-Date", "WARC-IP-Address", "WARC-Warcinfo-ID", "WARC-Payload-Digest", "WARC-Identified-Payload-Type")
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8").bytes  # of URLs, RFC 4122

#: Elements whose content isn't text of the page, and tags that end a line or a cell.
_HIDDEN = frozenset(("script", "style", "noscript", "template", "title"))
_BREAKS = frozenset("br hr p div li ul ol dl dt dd tr table thead tbody section article header footer nav aside main form pre blockquote figure h1 h2 h3 h4 h5 h6".split())
_CELLS = frozenset(("td", "th"))
_ENDING, _SPACING = (names | {f"/{x}" for x in names} for names in (_BREAKS, _CELLS))
_READ = frozenset(("a", "html"))  # whose attributes are read
_NAME = re.compile(r"(/?)\s*([A-Za-z][A-Za-z0-9]*)")
#: Text and a tag behind it, as most are: only what is quoted by " may be anything but < or
#: >. It never looks past the next but one <.
_PLAIN = re.compile(r"([^<]*+)<(/?)([A-Za-z][A-Za-z0-9]*+)[^<>\"']*+(?:\"[^\"<>]*+\"[^<>\"']*+)*+>")
_INSIDE = re.compile(r"[<>\"']")
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in _HIDDEN}
_HREF = re.compile(r"[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_LANG = re.compile(r"[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    """A name-based id (version 5) of the parts."""
    made = bytearray(hashlib.sha1(_NAMESPACE + chr(31).join("" if p is None else str(p) for p in parts).encode()).digest()[:16])
    made[6], made[8] = made[6] & 0x0F | 0x50, made[8] & 0x3F | 0x80
    h = made.hex()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _tag_end(page: str, at: int) -> int:
    """The place behind the tag that begins at ``at``, past quoted values; where another
    tag begins before it ends, that place negated; the page's length if it isn't closed."""
    i = at + 1
    while m := _INSIDE.search(page, i):
        i, c = m.end(), m[0]
        if c == ">":
            return i
        if c == "<":
            return -m.start()
        i = page.find(c, i) + 1
        if not i:
            break
    return len(page)


def markup(page: str) -> Iterator[tuple[str, str, str, str | None]]:
    """(text, kind, name, content) of a page's pieces in their order, each with the text
    before it: ``tag`` with its name ("/p" for an end) and its source; ``hidden`` for
    comments and for elements that aren't shown, with what they hold (None if they aren't
    closed); ``end`` for the page's end.

    Each character is passed a bounded number of times, whatever the page: a tag that
    another one interrupts is text, and behind one that is never closed all is text."""
    at = start = 0
    size, plain = len(page), _PLAIN.match
    while True:
        if m := plain(page, at):
            text, slash, name = m.groups()
            name = name.lower()
            if slash or name not in _HIDDEN:
                yield (page[start:at] + text if at > start else text), "tag", slash + name, m[0][len(text) :] if name in _READ else ""
                at = start = m.end()
                continue
        at = page.find("<", at)
        if at < 0:
            break
        if page.startswith(("<!--", "<![CDATA["), at):
            comment = page[at + 2] == "-"
            end = page.find("-->" if comment else "]]>", at + (4 if comment else 9))
            yield page[start:at], "hidden", "", None if end < 0 else page[at:end]
            at = start = size if end < 0 else end + 3
            continue
        m = _NAME.match(page, at + 1)
        other = page[at + 1 : at + 2] in ("!", "?", "/")
        name = m[2].lower() if m else ""
        # A space before the name is let pass for tags that end a line or a cell only.
        if not other and (not m or (page[at + 1].isspace() and name not in _BREAKS and name not in _CELLS)):
            at += 1
            continue
        end = _tag_end(page, at)
        if end < 0:
            at = -end
            continue
        if end == size and page[-1:] != ">":
            break
        if name in _HIDDEN and not m[1]:
            close = _ENDS[name].search(page, end)
            yield page[start:at], "hidden", name, page[end : close.start()] if close else None
            end = close.end() if close else size
        else:
            yield page[start:at], "tag", (m[1] if m else "") + name, page[at:end]
        at = start = end
    yield page[start:], "end", "", ""


def read_page(page: str) -> dict:
    """The page's visible ``text``, a line for each block; its ``title`` and ``lang`` or
    None; and its ``links`` in their order."""
    lines: list[str] = []
    line = ""
    title = lang = None
    links: list[str] = []
    for text, kind, name, content in markup(page):
        line += text
        if name in _ENDING:
            if line:
                lines.append(line)
                line = ""
        elif kind == "hidden":
            line += " "
            if name == "title" and title is None and content is not None:
                title = " ".join(entities.unescape(content).split())
        elif name in _SPACING:
            line += "\t"
        elif name == "a":
            if m := _HREF.match(content):
                link = m[m.lastindex]
                links.append(entities.unescape(link) if "&" in link else link)
        elif name == "html" and lang is None and (m := _LANG.match(content)):
            lang = m[1]
    lines.append(line)
    # Spaces end an entity that has no semicolon, so they are made alike before.
    lines = [" ".join((entities.unescape(re.sub(r"\s+", " ", x)) if "&" in x else x).split()) for x in lines]
    return {"title": title, "lang": lang, "links": links, "text": "\n".join(filter(None, lines))}


def plain_text(page: str) -> str:
    """The visible text of a page, a line for each block."""
    return read_page(page)["text"]


def response(page_id: int | None, url: str | None, page: str | None) -> tuple[list[tuple[str, str]], bytes]:
    """Headers and block of a page's response record."""
    payload = (page or "").encode()
    own = digest(payload)
    block = HTTP.format(len(payload)).encode() + payload
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", page_id, url, own))]
    if url is not None:  # a line break would end the header
        headers.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    headers += [("WARC-Date", DATE), ("WARC-Payload-Digest", own), ("WARC-Block-Digest", digest(block))]
    return [*headers, ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))], block


def split_http(block: bytes) -> tuple[str | None, list[tuple[str, str]], bytes]:
    """(status line, headers, payload) of a response block."""
    head, cut, payload = block.partition(b"\r\n\r\n")
    if not (cut and head.startswith(b"HTTP/")):
        return None, [], block
    lines = head.decode("latin-1").split("\r\n")
    return lines[0], [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])], payload


def _unchunked(data: bytes) -> bytes:
    """The body of chunked transfer; what isn't well formed stays as it is."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        try:
            size = int(data[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            size = -1
        if size < 0 or end + 2 + size > len(data):
            return data
        if size == 0:
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + size])
        at = end + 2 + size + 2


def decoded(http: list[tuple[str, str]], payload: bytes) -> bytes:
    """The page's bytes, without transfer and content codings. A coding that isn't known
    or doesn't hold leaves them as they are."""
    of = {k.lower(): v.lower() for k, v in http}
    body = _unchunked(payload) if of.get("transfer-encoding") == "chunked" else payload
    try:
        if of.get("content-encoding") in ("gzip", "x-gzip"):
            return gzip.decompress(body)
        if of.get("content-encoding") == "deflate":
            return zlib.decompress(body)
    except (OSError, EOFError, zlib.error):
        pass
    return body


def derived(headers: list[tuple[str, str]], block: bytes) -> list[tuple[list[tuple[str, str]], bytes]]:
    """The metadata and the conversion record of a response."""
    of: dict[str, str] = {}
    for k, v in headers:  # names are compared without case
        of.setdefault(k.lower(), v)
    source = of.get("warc-record-id")
    status, http, payload = split_http(block)
    kind = next((v for k, v in http if k.lower() == "content-type"), "")
    charset = re.search(r"charset\s*=\s*[\"']?([\w-]+)", kind, re.I)
    body = decoded(http, payload)
    try:
        page = body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    seen = read_page(page)
    text = seen["text"].encode()
    names = {k.lower(): k for k in CARRIED}
    carried = [(names[k.lower()], v) for k, v in headers if k.lower() in names]
    if "warc-payload-digest" not in of:
        carried.append(("WARC-Payload-Digest", digest(payload)))
    refers = [("WARC-Refers-To", source)] if source else []
    refers += [(f"WARC-Refers-To-{k}", of[f"warc-{k.lower()}"]) for k in ("Target-URI", "Date") if f"warc-{k.lower()}" in of]
    # A source without an id is told apart by what it holds.
    ids = {t: record_id(t, source or digest(block), *(() if source else (of.get("warc-target-uri"), of.get("warc-date")))) for t in ("metadata", "conversion")}
    about = {
        "source": source,
        "conversion": ids["conversion"],
        "source-headers": headers,
        "http-status": status,
        "http-headers": http,
        "title": seen["title"],
        "lang": seen["lang"],
        "links": seen["links"],
        "payload-length": len(payload),
        "text-length": len(text),
    }
    out = []
    for t, kind, body in (("metadata", "application/json", json.dumps(about, ensure_ascii=False).encode()), ("conversion", "text/plain; charset=utf-8", text)):
        own = [("WARC-Type", t), ("WARC-Record-ID", ids[t]), *refers, *carried]
        own += [("WARC-Concurrent-To", ids["conversion"])] * (t == "metadata")
        out.append(([*own, ("WARC-Block-Digest", digest(body)), ("Content-Type", kind), ("Content-Length", str(len(body)))], body))
    return out


def serialize(headers: list[tuple[str, str]], block: bytes) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Records of uncompressed WARC bytes."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        headers = _headers(data[at:end])
        size = _length(headers)
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _headers(head: bytes) -> list[tuple[str, str]]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    return [(k, v.removeprefix(" ")) for k, _, v in (x.partition(":") for x in lines[1:])]


def _length(headers: list[tuple[str, str]]) -> int:
    return int(next(v for k, v in headers if k.lower() == "content-length"))


_PAIRS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))


def _pairs(headers: list[list[tuple[str, str]]]) -> pa.Array:
    edges = [0, *itertools.accumulate(map(len, headers))]
    names, values = (pa.array([x[i] for h in headers for x in h], pa.string()) for i in range(2))
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays([names, values], ["name", "value"])).cast(_PAIRS)


def _headers_of(column: pa.ListArray) -> list[list[tuple[str, str]]]:
    """The inverse; a null list has no headers."""
    pairs = column.flatten()
    flat = list(zip(*(pairs.field(i).to_pylist() for i in range(2)), strict=True))
    edges = [0, *itertools.accumulate(n or 0 for n in column.value_lengths().to_pylist())]
    return [flat[a:b] for a, b in itertools.pairwise(edges)]


def _responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bw.chunks(batches, "html"):
        ids = batch.column(0).to_pylist()
        made = [response(*x) for x in zip(ids, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(["response"] * len(ids)), _pairs([h for h, _ in made]), pa.array([b for _, b in made], pa.binary())], ["page_id", "warc_type", "headers", "block"])


def responses(pages: DataFrame) -> DataFrame:
    """A response record for each page: page_id, warc_type, headers, block."""
    tune(pages.sparkSession)
    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(_responses, RECORDS)


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 100):
            rows = []
            part = batch.slice(start, 100)
            columns = part.column(0).to_pylist(), part.column(1).to_pylist(), _headers_of(part.column(2)), part.column(3).to_pylist()
            for page, kind, headers, block in zip(*columns, strict=True):
                if kind != "response":
                    continue
                for own, body in derived(headers, block):
                    of = dict(own)
                    text = body.decode() if of["WARC-Type"] == "conversion" else None
                    rows.append((page, of["WARC-Type"], own, body, of["WARC-Record-ID"], of.get("WARC-Refers-To"), of.get("WARC-Target-URI"), of["WARC-Payload-Digest"], of["WARC-Block-Digest"], len(body), text))
            if rows:
                c = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.string(), None, pa.binary(), *[pa.string()] * 5, pa.int64(), pa.string()]
                names = ["page_id", "warc_type", "headers", "block", "record_id", "refers_to", "target_uri", "payload_digest", "block_digest", "content_length", "text"]
                yield pa.RecordBatch.from_arrays([_pairs(list(x)) if k is None else pa.array(x, k) for x, k in zip(c, kinds, strict=True)], names)


def derive(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of the response records in ``records``."""
    tune(records.sparkSession)
    return records.select("page_id", "warc_type", "headers", "block").mapInArrow(_derive, DERIVED)


def _found(records: list[tuple[list[tuple[str, str]], bytes]]) -> pa.RecordBatch:
    types = [next((v for k, v in h if k.lower() == "warc-type"), None) for h, _ in records]
    return pa.RecordBatch.from_arrays([pa.array(types, pa.string()), _pairs([h for h, _ in records]), pa.array([b for _, b in records], pa.binary())], ["warc_type", "headers", "block"])


def write_files(records: DataFrame, path: str) -> DataFrame:
    """Write records as gzip members. Each task makes the members; Spark's own writer
    stores them, so any file system it can reach will do. Reads back with
    ``read_files``. Returns the number of records by type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = [gzip.compress(serialize([(h["name"], h["value"]) for h in hs], b), mtime=0) for hs, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary()), batch.column(2)], ["member", "warc_type"])

    tune(records.sparkSession)
    records.select("headers", "block", "warc_type").mapInArrow(run, "member binary, warc_type string").write.parquet(path)
    return records.sparkSession.read.parquet(path).groupBy("warc_type").agg(F.count("*").alias("records"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """warc_type, headers and block of the members that ``write_files`` stored."""
    tune(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _found([r for m in batch.column(0).to_pylist() for r in parse(gzip.decompress(m))])

    schema = "warc_type string, headers array<struct<name:string,value:string>>, block binary"
    return spark.read.parquet(path).select("member").mapInArrow(run, schema)


def write_warc(records: DataFrame, path: str) -> None:
    """Write records as real .gz files of WARC records, one a partition, on any file
    system that Spark can write. Their names end in .txt.gz, as Spark's writer has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # The writer puts the two line ends behind each record.
            made = [serialize([(h["name"], h["value"]) for h in hs], b)[:-4] for hs, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])

    tune(records.sparkSession)
    lines = records.select("headers", "block").mapInArrow(run, "record binary").select(F.expr("record").cast("string").alias("value"))
    lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def stream(data: bytes, step: int = 1 << 16) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Records of the bytes of a .warc or .warc.gz file, whose gzip members may hold one
    record or several, inflated as far as the next record needs."""
    if data[:2] != b"\x1f\x8b":
        yield from parse(data)
        return
    held, at, inflate = bytearray(), 0, zlib.decompressobj(31)

    def more() -> bool:
        nonlocal at, inflate
        while at < len(data):
            chunk = data[at : at + step]
            out = inflate.decompress(chunk)
            at += len(chunk)
            if inflate.eof:
                at -= len(inflate.unused_data)
                inflate = zlib.decompressobj(31)
            if out:
                held.extend(out)
                return True
        return False

    while held or more():
        end = held.find(b"\r\n\r\n")
        while end < 0:
            seen = max(0, len(held) - 3)
            if not more():
                raise ValueError("the file ends within a record's headers")
            end = held.find(b"\r\n\r\n", seen)
        headers = _headers(bytes(held[:end]))
        stop = end + 4 + _length(headers)
        while len(held) < stop + 4:
            if not more():
                if len(held) < stop:
                    raise ValueError("the file ends within a record")
                break
        yield headers, bytes(held[end + 4 : stop])
        del held[: stop + 4]


def read_warc(spark: SparkSession, paths: str) -> DataFrame:
    """warc_type, headers and block of the records in .warc or .warc.gz files."""
    tune(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                found, size = [], 0
                for headers, block in stream(data):
                    found.append((headers, block))
                    size += len(block)
                    if size > bw.CHUNK:
                        yield _found(found)
                        found, size = [], 0
                if found:
                    yield _found(found)

    schema = "warc_type string, headers array<struct<name:string,value:string>>, block binary"
    return spark.read.format("binaryFile").load(paths).select("content").mapInArrow(run, schema)
