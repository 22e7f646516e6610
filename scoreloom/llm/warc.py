"""Derived records of web captures: each response gives a metadata record and a plain-text conversion record.

A response is a row ``record_id, target_uri, date, headers, block``: its WARC headers and its HTTP message. Both derived records
refer to it (``WARC-Refers-To``), to each other (``WARC-Concurrent-To``), and carry its target, date, HTTP status, source
headers and payload digest. Identifiers are digests of what they name, so a repeated task or run gives the same records, and
equal captures have equal records. Nothing is shuffled; only the payload goes to Python, where one page at a time is scanned.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.session import ship_package

CAPTURED = "2024-01-01T00:00:00Z"  # the pages carry no time of their own
CRLF = "\r\n"

# Elements whose content is no text, and elements that end a line.
SILENT = ("script", "style", "noscript", "template", "head")
BLOCKS = "p|div|br|li|ul|ol|dl|dt|dd|h[1-6]|article|section|aside|main|nav|footer|header|table|tr|td|th|blockquote|pre|hr|form|title"

_GAP = r"[ \t\r\n\f/]"
_COMMENT = re.compile(r"<!--.*?-->", re.S)
_HIDDEN = re.compile("|".join(rf"<{n}(?:{_GAP}[^>]*)?>.*?</{n}{_GAP}*>" for n in SILENT), re.I | re.S)
_LINE = re.compile(rf"</?(?:{BLOCKS})(?:{_GAP}[^>]*)?>", re.I)
_TAG = re.compile(r"<[!/?a-zA-Z][^>]*>")
_BREAK = re.compile(r"[\t\r\n\f]+")
_LINES = re.compile(r"[ \t\r\f]*\n[ \t\r\f\n]*")
_BLANKS = re.compile(r"[ \t\r\f]{2,}|[\t\r\f]")
_TITLE = re.compile(rf"<title(?:{_GAP}[^>]*)?>(.*?)</title", re.I | re.S)
_LINK = re.compile(rf"""<a(?=[ \t\r\n\f])[^>]*?[ \t\r\n\f"']href[ \t\r\n\f]*=[ \t\r\n\f]*(?:"([^"]*)"|'([^']*)'|([^ \t\r\n\f"'>]+))""", re.I)
SCANNED = "title string, links array<string>, text string"


def _tidy(text: str) -> str:
    """References decoded once, in one pass; no-break spaces are blanks; runs of blanks and lines closed up."""
    text = unescape(text).replace("\xa0", " ") if "&" in text or "\xa0" in text else text
    return _BLANKS.sub(" ", _LINES.sub("\n", text)).strip(" \n")


def scan(markup: str) -> tuple[str, list[str], str]:
    """Title, link targets as written, and plain text of one page.

    Comments go; a silent element, up to its own closing tag, becomes a blank; tags of blocks become line ends, other tags go.
    Links are those outside comments and silent elements. References may be named, decimal or hexadecimal, of any length; one that
    stands for no character becomes U+FFFD or nothing, as in browsers. A silent element without closing tag is text.
    """
    found = _TITLE.search(markup)
    shown = _HIDDEN.sub(" ", _COMMENT.sub("", markup))
    links = ["".join(m) for m in _LINK.findall(shown)]
    text = _TAG.sub("", _LINE.sub("\n", _BREAK.sub(" ", shown)))
    return _tidy(_BREAK.sub(" ", found[1])) if found else "", links, _tidy(text)


def scanned(payload: Column | str) -> Column:
    """``scan`` of a column, as a struct; only the payload goes to Python."""

    @F.arrow_udf(SCANNED)
    def run(column: pa.Array) -> pa.Array:
        rows = [scan(x or "") for x in column.to_pylist()]
        parts = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.list_(pa.string()), pa.string()))]
        return pa.StructArray.from_arrays(parts, ["title", "links", "text"])

    return run(payload)


def _digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def _identifier(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts).cast("binary"))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12)), F.lit(">"))


def responses(pages: DataFrame, date: str = CAPTURED) -> DataFrame:
    """Pages as response records: ``page_id, record_id, target_uri, date, headers, block``. Null markup is an empty payload,
    a null address an empty target. Rows alike in identifier, address and markup have the same record identifier."""
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    size = F.octet_length(html).cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size, F.lit(CRLF * 2), html)
    made = pages.select("page_id", url.alias("target_uri"), F.lit(date).alias("date"), http.alias("block"), _digest(html).alias("payload"))
    made = made.withColumn("record_id", _identifier(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("target_uri"), F.col("payload")))
    headers = F.create_map(
        F.lit("WARC-Type"), F.lit("response"), F.lit("WARC-Record-ID"), F.col("record_id"), F.lit("WARC-Target-URI"), F.col("target_uri"),
        F.lit("WARC-Date"), F.col("date"), F.lit("WARC-Payload-Digest"), F.col("payload"), F.lit("Content-Type"), F.lit("application/http; msgtype=response"))
    return made.select("page_id", "record_id", "target_uri", "date", headers.alias("headers"), "block")


#: What every derived record has.
RECORD = (
    "record_type", "record_id", "refers_to", "concurrent_to", "target_uri", "date", "content_type", "payload_digest", "source_headers", "block",
    "block_digest", "content_length", "title", "n_links",
)


def derive(captures: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Two records for every response: the columns ``keep``, then those of ``RECORD``. A kept column whose name a record uses
    comes out as ``kept_`` and its name; other columns, whatever their names, are not read.

    A block without a blank line has no payload; null and empty blocks give empty records. A payload digest that the source states is
    preserved as it is, otherwise it is computed; ``source_headers`` are the response's own, null where it has none. The metadata
    block is of ``application/warc-fields``; null fields count as empty. Very long texts are scanned whole, one at a time. Repeated
    rows give repeated records with equal identifiers; an empty table gives none.
    """
    ship_package(captures.sparkSession)
    block = F.coalesce("block", F.lit(""))
    at = F.instr(block, CRLF * 2)
    kept = F.struct(F.lit(0).alias("_"), *[F.col(f"`{k}`").alias(k) for k in keep]).alias("_kept")
    split = captures.select(
        kept, "record_id", F.coalesce("target_uri", F.lit("")).alias("target_uri"), F.coalesce("date", F.lit("")).alias("date"), "headers",
        F.when(at > 0, F.substr(block, F.lit(1), at - 1)).otherwise(block).alias("head"),
        F.when(at > 0, F.substr(block, at + 4)).otherwise(F.lit("")).alias("payload"),
    )
    split = split.withColumn("payload_digest", F.coalesce(F.col("headers")["WARC-Payload-Digest"], _digest(F.col("payload"))))
    split = split.withColumn("page", scanned("payload")).drop("payload")
    split = split.withColumn("metadata_id", _identifier(F.lit("metadata"), F.col("record_id")))
    split = split.withColumn("conversion_id", _identifier(F.lit("conversion"), F.col("record_id")))
    first = F.split_part("head", F.lit(CRLF), F.lit(1))
    rest = F.filter(F.slice(F.split("head", CRLF), 2, 1 << 20), lambda h: h != "")
    fields = F.concat(
        F.array(F.concat(F.lit("http-status: "), F.split_part(first, F.lit(" "), F.lit(2))), F.concat(F.lit("title: "), F.col("page.title"))),
        F.transform(rest, lambda h: F.concat(F.lit("http-header: "), h)), F.transform("page.links", lambda u: F.concat(F.lit("outlink: "), u)))
    metadata = F.concat(F.array_join(fields, CRLF), F.lit(CRLF))
    pair = lambda kind, me, other, mime, text: F.struct(
        F.lit(kind).alias("record_type"), F.col(me).alias("record_id"), F.col(other).alias("concurrent_to"), F.lit(mime).alias("content_type"), text.alias("block"))
    both = F.array(pair("metadata", "metadata_id", "conversion_id", "application/warc-fields", metadata),
                   pair("conversion", "conversion_id", "metadata_id", "text/plain; charset=utf-8", F.col("page.text")))
    out = split.select(
        "_kept", F.col("record_id").alias("refers_to"), "target_uri", "date", "payload_digest", F.col("headers").alias("source_headers"),
        F.col("page.title").alias("title"), F.size("page.links").cast("long").alias("n_links"), F.explode(both).alias("r"))
    digest, size = _digest(F.col("r.block")), F.octet_length("r.block").cast("long")
    out = out.select("_kept", "r.*", "refers_to", "target_uri", "date", "payload_digest", "source_headers", digest.alias("block_digest"), size.alias("content_length"), "title", "n_links")
    names = [F.col("_kept").getField(k).alias(f"kept_{k}" if k in RECORD else k) for k in keep]
    return out.select(*names, *RECORD)


def header_lines(headers: Column) -> Column:
    """Headers as lines ``name: value``, by name; empty where there are none."""
    lines = F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))
    return F.coalesce(F.array_join(lines, CRLF), F.lit(""))


def serialised(records: DataFrame) -> DataFrame:
    """Every derived record as one string ``record``, headers and block; records are separated by two line ends. Headers of the
    source are preserved as ``X-Source-`` fields."""
    source = F.regexp_replace(header_lines(F.col("source_headers")), "(?m)^(?=.)", "X-Source-")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    return records.select(F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Refers-To", F.col("refers_to")),
        line("WARC-Concurrent-To", F.col("concurrent_to")), line("WARC-Target-URI", F.col("target_uri")), line("WARC-Date", F.col("date")),
        line("WARC-Refers-To-Payload-Digest", F.col("payload_digest")), line("WARC-Block-Digest", F.col("block_digest")), line("Content-Type", F.col("content_type")),
        line("Content-Length", F.col("content_length").cast("string")),
        F.when(source != "", F.concat(source, F.lit(CRLF))).otherwise(F.lit("")), F.lit(CRLF), F.col("block")).alias("record"))


def write_records(records: DataFrame, folder: str) -> None:
    """Write the records as WARC files, one per task."""
    serialised(records).write.mode("overwrite").option("lineSep", CRLF * 2).text(folder)


def report(pages: DataFrame) -> DataFrame:
    """Both derived records of every page, with digests in place of blocks."""
    out = derive(responses(pages), keep=("page_id",))
    return out.select(
        "page_id", "record_type", "record_id", "refers_to", "concurrent_to", "target_uri", "date", "content_type", "payload_digest", "block_digest",
        "content_length", "title", "n_links", header_lines(F.col("source_headers")).alias("source_headers"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _oracle() -> str:
    """Written on its own: text is taken between tags, and the references that occur in the pages are named one by one."""
    sub = lambda c, old, new: f"regexp_replace({c}, {_quoted(old)}, {_quoted(new)}, 'g')"
    hidden = "|".join(rf"<{n}(\s[^>]*)?>(?s:.*?)</{n}\s*>" for n in ("script", "style", "noscript", "template", "head"))

    def decoded(text: str) -> str:
        for name, sign in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("\xa0", " "), ("&amp;", "&")):
            text = f"replace({text}, {_quoted(name)}, {_quoted(sign)})"
        return f"trim({sub(sub(text, ' *' + chr(10) + '[ ' + chr(10) + ']*', chr(10)), ' {2,}', ' ')}, ' ' || chr(10))"

    shown = sub(sub("html", "(?s)<!--.*?-->", ""), f"(?i){hidden}", " ")
    lines = sub(sub("shown", r"[\t\r\n\f]+", " "), rf"(?i)</?({BLOCKS})([\s/][^>]*)?>", "\n")
    uuid = lambda e: f"'<urn:uuid:' || regexp_replace(md5({e}), '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.*)', '\\1-\\2-\\3-\\4-\\5') || '>'"
    return f"""WITH p AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS html FROM pages),
    d AS (SELECT *, 'sha256:' || sha256(html) AS payload_digest, {shown} AS shown,
        {sub("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)", "[ \t\r\n\f]+", " ")} AS raw_title FROM p),
    r AS (SELECT *, {uuid("'response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || target_uri || '|' || payload_digest")} AS refers_to,
        {decoded(sub(lines, "<[!/?a-zA-Z][^>]*>", ""))} AS body, {decoded("raw_title")} AS title, regexp_extract_all(shown, '(?i)<a\\s[^>]*href="([^"]*)"', 1) AS links FROM d),
    i AS (SELECT *, {uuid("'metadata|' || refers_to")} AS m, {uuid("'conversion|' || refers_to")} AS c,
        'http-status: 200' || chr(13) || chr(10) || 'title: ' || title || chr(13) || chr(10) || 'http-header: Content-Type: text/html; charset=utf-8' || chr(13) || chr(10)
        || 'http-header: Content-Length: ' || octet_length(encode(html)) || chr(13) || chr(10)
        || list_aggregate(list_prepend('', list_transform(links, lambda u: 'outlink: ' || u || chr(13) || chr(10))), 'string_agg', '') AS fields FROM r),
    b AS (SELECT *, 'metadata' AS record_type, m AS record_id, c AS concurrent_to, 'application/warc-fields' AS content_type, fields AS block FROM i
        UNION ALL SELECT *, 'conversion', c, m, 'text/plain; charset=utf-8', body FROM i)
    SELECT page_id, record_type, record_id, refers_to, concurrent_to, target_uri, '{CAPTURED}' AS date, content_type, payload_digest,
        'sha256:' || sha256(block) AS block_digest, CAST(octet_length(encode(block)) AS BIGINT) AS content_length, title, CAST(len(links) AS BIGINT) AS n_links,
        array_to_string(['Content-Type: application/http; msgtype=response', 'WARC-Date: {CAPTURED}', 'WARC-Payload-Digest: ' || payload_digest, 'WARC-Record-ID: ' || refers_to,
            'WARC-Target-URI: ' || target_uri, 'WARC-Type: response'], chr(13) || chr(10)) AS source_headers FROM b"""


ORACLE = _oracle()
