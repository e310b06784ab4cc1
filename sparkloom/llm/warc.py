"""WARC derivatives: metadata and plain-text conversion records from responses.

For every response two linked records are made, both with WARC-Refers-To naming the
response, its URI, date and payload digest: ``metadata`` (JSON: title, language, links,
source headers and the source's payload digest) and ``conversion`` (the page's text).
Each carries its own block digest and length; ids are derived from the response's id
and the kind, so a run repeated after a failure gives the same records.

Text: comments, scripts, styles and heads go; block ends become line feeds and other
tags go; character references are decoded as HTML says (a no-break space counts as a
blank); blanks are squeezed and empty lines dropped.  A comment, script, style or head
that never ends isn't one, nor is a tag.

Scale: one narrow map over Arrow batches, no shuffle, memory of one batch.  Every scan
is linear in the page: what has no end further on is looked for once, not once for
each opening.

Defined results: a null html counts as an empty payload; a null url gives an empty
target; line ends in a url are percent-encoded in headers; repeated rows give repeated
records (alike in every field); extra columns are not read.
"""

from __future__ import annotations

import hashlib
import html as markup
import json
import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FLAGS = re.IGNORECASE | re.ASCII
# patterns begin with a literal, by which the scan skips ahead
_OPEN = re.compile(r"<(?:!--|(script|style|head)\b)", _FLAGS)
_CLOSE = {None: re.compile("-->")} | {k: re.compile(rf"</{k}\s*>", _FLAGS) for k in ("script", "style", "head")}
_BREAK = re.compile(r"<(?:/(?:p|div|li|tr|h[1-6]|section|article|table|ul|ol|title)\s*>|br\s*/?>)", _FLAGS)
_TAG = re.compile(r"<[^>]*>")
_TITLE, _TITLE_END = re.compile(r"<title[^>]*>", _FLAGS), re.compile("</title", _FLAGS)
_HTML, _LANG = re.compile("<html", _FLAGS), re.compile(r"""="(?<=\blang=")""", _FLAGS)
_ANCHOR, _HREF = re.compile(r"<a\b", _FLAGS), re.compile(r"""="(?<=\bhref=")""", _FLAGS)
#: numeric references with more digits than any character has, zeros before them aside
_ZEROS = re.compile(r"&#([xX]?)0+(?=[0-9a-fA-F])")
_HUGE = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{7,});?")

BATCH_BYTES = 4 << 20
RECORD = (
    "page_id bigint, kind string, record_id string, refers_to string, target_uri string, date string, mime string, source_digest string, "
    "block_digest string, content_length bigint, block string, headers string"
)
MIME = {"metadata": "application/json", "conversion": "text/plain; charset=utf-8"}


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", status: str = "200 OK") -> DataFrame:
    """Pages as response records: id, target, date, HTTP headers and payload.

    ``date`` and ``status`` are what the pages don't tell; a table that has columns
    ``fetched_at`` or ``http_headers`` (strings) gives its own.
    """
    payload = F.coalesce("html", F.lit(""))
    digest = F.sha2(F.encode(payload, "UTF-8"), 256)
    key = F.md5(F.concat_ws("|", F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), digest))
    part = lambda a, n: F.substring(key, a, n)
    own = lambda name, other: F.coalesce(F.col(name).cast("string"), other) if name in pages.columns else other
    plain = F.concat(F.lit(f"HTTP/1.1 {status}\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"))
    return pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">")).alias("record_id"),
        F.coalesce("url", F.lit("")).alias("target_uri"),
        own("fetched_at", F.lit(date)).alias("date"),
        own("http_headers", plain).alias("http_headers"),
        F.concat(F.lit("sha256:"), digest).alias("payload_digest"),
        payload.alias("payload"),
    )


def _without_parts(html: str) -> str:
    """html with comments, scripts, styles and heads as blanks."""
    out, at, endless = [], 0, set()
    for m in _OPEN.finditer(html):
        kind = m[1] and m[1].lower()
        if m.start() < at or kind in endless:
            continue
        end = _CLOSE[kind].search(html, m.end())
        if end is None:
            endless.add(kind)
            continue
        out += (html[at : m.start()], " ")
        at = end.end()
    out.append(html[at:])
    return "".join(out)


def _without_tags(text: str) -> str:
    last = text.rfind(">") + 1  # what follows holds no whole tag
    return _TAG.sub(" ", text[:last]) + text[last:]


def decoded(text: str) -> str:
    """text with its character references decoded."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = _HUGE.sub("�", _ZEROS.sub(r"&#\1", text))
    return markup.unescape(text).replace("\xa0", " ")


def page_text(html: str) -> str:
    text = decoded(_without_tags(_BREAK.sub("\n", _without_parts(html))))
    for blank in "\t\r\f":
        text = text.replace(blank, " ")
    while "  " in text:
        text = text.replace("  ", " ")
    lines = [line.strip(" ") for line in text.split("\n")]
    return "\n".join([line for line in lines if line])


def title(html: str) -> str:
    """What stands between the first title tag and its end."""
    m = _TITLE.search(html, 0, html.rfind(">") + 1)
    end = m and _TITLE_END.search(html, m.end())
    return html[m.end() : end.start()] if end else ""


def _quoted(html: str, mark: re.Pattern) -> tuple[list[int], list[int]]:
    """Where the quoted values of an attribute begin: the place of ``="`` and that after it."""
    found = [m.end() for m in mark.finditer(html)]
    return [a - 2 for a in found], found


def language(html: str) -> str:
    """The last lang attribute of the first html tag that has a whole one."""
    starts, values = _quoted(html, _LANG)
    if not starts:
        return ""
    last = html.rfind('"')
    for m in _HTML.finditer(html):
        end = html.find(">", m.end())
        i = bisect_left(starts, len(html) if end < 0 else end) - 1
        while i >= 0 and starts[i] >= m.end():
            if values[i] <= last:
                return html[values[i] : html.index('"', values[i])]
            i -= 1
        if end < 0:
            break  # later html tags have no end either, and fewer attributes
    return ""


def links(html: str) -> list[str]:
    """The first href of every anchor that has a whole one."""
    starts, values = _quoted(html, _HREF)
    out, at, last = [], 0, html.rfind('"')
    for m in _ANCHOR.finditer(html) if starts else ():
        if m.start() < at:
            continue
        i = bisect_left(starts, m.end())
        if i == len(starts) or values[i] > last:
            break
        if html.find(">", m.end(), starts[i]) >= 0:
            continue
        at = html.index('"', values[i]) + 1
        out.append(html[values[i] : at - 1])
    return out


def _header(kind: str, source: dict, record_id: str, digest: str, length: int) -> str:
    uri = source["target_uri"].replace("\r", "%0D").replace("\n", "%0A")
    return "\r\n".join(
        (
            "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Refers-To: {source['record_id']}", f"WARC-Refers-To-Target-URI: {uri}",
            f"WARC-Refers-To-Date: {source['date']}", f"X-Refers-To-Payload-Digest: {source['payload_digest']}", f"WARC-Target-URI: {uri}", f"WARC-Date: {source['date']}",
            f"WARC-Block-Digest: {digest}", f"Content-Type: {MIME[kind]}", f"Content-Length: {length}",
        )
    )


def _records(source: dict) -> Iterator[tuple]:
    payload = source["payload"]
    about = {
        "title": title(payload), "lang": language(payload), "links": links(payload), "source_headers": source["http_headers"], "source_digest": source["payload_digest"],
    }
    blocks = {"metadata": json.dumps(about, ensure_ascii=False, separators=(",", ":")), "conversion": page_text(payload)}
    for kind, block in blocks.items():
        raw = block.encode()
        digest = f"sha256:{hashlib.sha256(raw).hexdigest()}"
        own = uuid.UUID(hashlib.md5(f"{kind}|{source['record_id']}".encode()).hexdigest())
        record_id = f"<urn:uuid:{own}>"
        yield (
            source["page_id"], kind, record_id, source["record_id"], source["target_uri"], source["date"], MIME[kind], source["payload_digest"], digest, len(raw), block,
            _header(kind, source, record_id, digest, len(raw)),
        )


_NAMES = [c.split()[0] for c in RECORD.split(", ")]
_KINDS = [pa.int64() if c.endswith("bigint") else pa.string() for c in RECORD.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=_NAMES)


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            source = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
            rows.extend(_records(source))
            size += len(source["payload"])
            if size > BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
    yield _batch(rows)


def derivatives(records: DataFrame) -> DataFrame:
    """Two rows for each response: kind, record_id, refers_to, headers, block, block_digest, content_length."""
    readable = F.make_valid_utf8("payload").alias("payload")  # digests are of the bytes as they are
    return records.select("page_id", "record_id", "target_uri", "date", "http_headers", "payload_digest", readable).mapInArrow(_derive, RECORD)


def record_text(derived: DataFrame) -> DataFrame:
    """The records as they stand in a file: headers, blank line, block, two line ends."""
    return derived.select(F.concat("headers", F.lit("\r\n\r\n"), "block", F.lit("\r\n\r\n")).alias("value"))
