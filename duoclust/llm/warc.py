"""Derivatives of web responses: a linked metadata record and a plain-text conversion record for each.

Both refer to the response by the record id that it came with, keep its target, date and headers, and carry digests of
their own block and of the response's payload. Every row is handled on its own; no shuffle is needed.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import json
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the record format.
VERSION, END = "WARC/1.1", "\r\n"
_DROP = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|$)", re.S | re.I)
_BLOCK = re.compile(r"</?(?:p|div|li|ul|ol|h[1-6]|tr|table|section|article|nav|header|footer|aside|form|blockquote|pre|br|hr|title|main|dd|dt|dl)\b[^>]*>", re.I)
_TAG = re.compile(r"<[/a-zA-Z!?][^>]*>")
_LINK = re.compile(r"""<(a|link|img|script|iframe)\b[^>]*?\b(href|src)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_META = re.compile(r"<meta\b[^>]*>", re.I)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
_TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.I | re.S)

SCHEMA = (
    "page_id long, record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, "
    "content_length long, block_digest string, payload_digest string, source_headers map<string,string>, block string"
)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """The same id for the same parts, so that a repeated task writes the same records."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(31).join(parts))}>"


def plain_text(page: str) -> str:
    text = _TAG.sub("", _BLOCK.sub("\n", _DROP.sub(" ", page)))
    lines = (" ".join(x.split()) for x in entities.unescape(text).split("\n"))
    return "\n".join(x for x in lines if x)


def _bare(value: str) -> str:
    return entities.unescape(value.strip("\"'"))


def metadata(page: str, headers: dict[str, str], payload_digest: str) -> str:
    """JSON of what the page says of itself; links in page order, with their element and attribute."""
    shown = _DROP.sub(lambda m: m.group()[: m.group().find(">") + 1] if m.group(1) else " ", page)
    title = _TITLE.search(shown)
    metas = [{k.lower(): _bare(v) for k, v in _ATTR.findall(m)} for m in _META.findall(shown)]
    links = [{"path": f"{a.lower()}@{b.lower()}", "url": _bare(c)} for a, b, c in _LINK.findall(shown)]
    return json.dumps({"headers": headers, "payload_digest": payload_digest, "title": " ".join(entities.unescape(title[1]).split()) if title else "", "metas": metas, "links": links}, ensure_ascii=False, sort_keys=True)


def responses_of_pages(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response rows (page_id, record_id, target_uri, warc_date, headers, payload) of a table of pages, which have no record
    ids: null, for derive() to make them. A null url or html counts as empty; further columns are left behind."""
    headers = F.create_map(F.lit("content-type"), F.lit("text/html; charset=utf-8"), F.lit("content-length"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.lit(None).cast("string").alias("record_id"), F.coalesce("url", F.lit("")).alias("target_uri"), F.lit(date).alias("warc_date"), headers.alias("headers"), F.coalesce("html", F.lit("")).alias("payload"))


def derive(responses: DataFrame) -> DataFrame:
    """Two records for each response row, named in SCHEMA. `refers_to` is the record_id of the response as it is; one
    that is null or empty is made of the response's target, date, headers and payload, so that different responses have
    different ids. The ids of the two records follow from it. Null targets, dates and payloads count as empty, null
    headers as none. A response with an empty payload still gets both, a conversion of length 0 among them. Equal rows
    give equal records, once each; an empty table gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page_id, response, uri, date, headers, payload in batch.itertuples(index=False):
                source = dict(sorted((k, v or "") for k, v in dict(headers if headers is not None else {}).items()))
                of_payload = digest(payload.encode("utf-8", "surrogatepass"))
                response = response or record_id("response", uri, date, json.dumps(source), of_payload)
                for kind, type_, block in (("metadata", "application/json", metadata(payload, source, of_payload)), ("conversion", "text/plain", plain_text(payload))):
                    data = block.encode("utf-8", "surrogatepass")
                    rows.append((None if pd.isna(page_id) else int(page_id), kind, record_id(kind, response), response, uri, date, type_, len(data), digest(data), of_payload, source, block))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")]).astype({"page_id": "Int64"})

    known = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("record_id", "target_uri", "warc_date"))
    return responses.select("page_id", *known, "headers", F.coalesce("payload", F.lit("")).alias("payload")).mapInPandas(run, SCHEMA)


def _field(name: str | Column, value: Column) -> Column:
    """One header line; line ends and other controls in a value are percent-encoded, so that a value stays on its line."""
    for code in (13, 10, 0):
        value = F.replace(value, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.concat(F.lit(name) if isinstance(name, str) else name, F.lit(": "), value)


def as_record(df: DataFrame) -> DataFrame:
    """One string column `value`: each record as it stands in a file, without its last line feed. Headers of the response
    are fields named X-Source-, with "-" for what may not stand in a name, in the order of their names."""
    fixed = [
        F.lit(VERSION), _field("WARC-Type", F.col("record_type")), _field("WARC-Record-ID", F.col("record_id")), _field("WARC-Refers-To", F.col("refers_to")),
        _field("WARC-Target-URI", F.col("target_uri")), _field("WARC-Date", F.col("warc_date")), _field("WARC-Block-Digest", F.col("block_digest")),
        _field("WARC-Payload-Digest", F.col("payload_digest")), _field("Content-Type", F.col("content_type")),
    ]
    source = F.transform(F.array_sort(F.map_entries("source_headers")), lambda e: _field(F.concat(F.lit("X-Source-"), F.regexp_replace(e["key"], r"[^A-Za-z0-9!#$%&'*+.^_`|~-]", "-")), e["value"]))
    length = _field("Content-Length", F.col("content_length").cast("string"))
    head = F.array_join(F.concat(F.array(*fixed), source, F.array(length)), END)
    return df.select(F.concat(head, F.lit(END + END), "block", F.lit(END + "\r")).alias("value"))


def write(df: DataFrame, path: str) -> None:
    """Files of records, one for each partition."""
    as_record(df).write.option("lineSep", "\n").text(path)
