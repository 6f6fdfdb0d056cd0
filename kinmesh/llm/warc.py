"""WARC derivatives: from response records to linked metadata and conversion records.

Each response yields two records that refer to it by its identifier: `metadata` (title, language,
sizes, in application/warc-fields) and `conversion` (plain text). Both keep the source's HTTP header
block and its payload digest, and carry their own block digest and length. All expressions are
built-in, so that the table streams through one stage without a shuffle.
"""

from __future__ import annotations

from html.entities import html5, name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmesh.llm.common import table

#: Elements whose content is no text; the first two hide all that follows if they are never closed. Fixed values.
HIDDEN = ("script", "style", "noscript", "template", "head")
#: Elements that end a line. Fixed values.
BLOCKS = "p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|main|aside|blockquote|pre"
#: Characters by entity name, of HTML 4 and one of XML; the no-break space counts as a blank.
ENTITIES = {name: html5[f"{name};"].replace("\xa0", " ") for name in sorted({*name2codepoint, "apos"})}
HEADERS = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"

_HIDDEN_RE = r"(?is)<!--.*?(?:-->|\z)|" + "|".join(rf"<{tag}\b[^>]*>.*?(?:</{tag}\s*>{end})" for tag, end in zip(HIDDEN, (r"|\z", r"|\z", "", "", ""), strict=True))
_ENTITY_RE = "^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"
_BLOCK_RE = rf"(?i)</?(?:{BLOCKS})\b[^>]*>"
_TITLE_RE = r"(?is)<title[^>]*>(.*?)</title\s*>"
_LANG_RE = r"""(?is)<html[^>]*\blang=["']?([A-Za-z-]+)"""


def _decoded(text: Column) -> Column:
    """Named and numeric entities as characters, in one pass; what is none stays."""
    names = F.create_map(*(F.lit(x) for pair in ENTITIES.items() for x in pair))

    def piece(x: Column) -> Column:
        p, name = x["p"], x["name"]
        cp = F.when(F.lower(F.substring(name, 1, 2)) == "#x", F.conv(F.substr(name, F.lit(3)), 16, 10)).when(F.substring(name, 1, 1) == "#", F.substr(name, F.lit(2))).cast("bigint")
        real = cp.between(1, 0xD7FF) | cp.between(0xE000, 0x10FFFF)
        char = F.when(cp == 0xA0, F.lit(" ")).when(real, F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32"))
        known = F.when(F.substring(name, 1, 1) == "#", char).when(name != "", F.try_element_at(names, name))
        return F.coalesce(F.concat(known, F.substr(p, F.length(name) + 2)), F.concat(F.lit("&"), p))

    parts = F.split(text, "&")
    named = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.struct(p.alias("p"), F.regexp_extract(p, _ENTITY_RE, 1).alias("name")))
    joined = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(named, piece), ""))
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)


def _bare(html: Column) -> Column:
    text = F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN_RE, " ")
    return F.regexp_replace(F.regexp_replace(text, _BLOCK_RE, "\n"), "<[^>]*>", "")


def _tidy(text: Column) -> Column:
    text = F.regexp_replace(text, "[ \t\r\x0b\x0c]+", " ")
    return F.btrim(F.regexp_replace(text, " ?\n[ \n]*", "\n"), F.lit(" \n"))


def plain_text(html: Column) -> Column:
    """Text of a page: hidden elements and comments dropped, block tags as line ends, other tags dropped,
    entities decoded, runs of blanks and of line ends collapsed. Null gives the empty text."""
    return _tidy(_decoded(_bare(html)))


def record_id(*parts: Column) -> Column:
    """A URN that depends on the parts alone, so that a repeated run names the same records."""
    d = F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(d, a, n) for a, n in cuts)), F.lit(">"))


def derive(responses: DataFrame, *, key: str = "page_id", url: str = "url", payload: str = "html", headers: str | None = None) -> DataFrame:
    """Two rows a response: key, record_type, record_id, refers_to, target_uri, content_type, source_headers,
    refers_to_digest, block_digest, content_length, block.

    A null payload counts as an empty one and still yields both records, as does a null address (empty).
    Repeated rows yield repeated records; rows that share the key but not the address get other identifiers. Pages of any length are taken whole.
    Other columns are left out, whatever their names; an empty table gives an empty table.
    """
    body, address = F.coalesce(F.col(f"`{payload}`"), F.lit("")), F.coalesce(F.col(f"`{url}`"), F.lit(""))
    source = F.lit(HEADERS) if headers is None else F.coalesce(F.col(f"`{headers}`"), F.lit(""))
    base = responses.select(
        F.col(f"`{key}`").alias("_km_key"),
        address.alias("_km_url"),
        source.alias("_km_headers"),
        _bare(body).alias("_km_bare"),
        F.regexp_extract(body, _TITLE_RE, 1).alias("_km_head"),
        F.regexp_extract(body, _LANG_RE, 1).alias("_km_lang"),
        F.octet_length(body).cast("bigint").alias("_km_bytes"),
        F.concat(F.lit("sha256:"), F.sha2(body, 256)).alias("_km_digest"),
    )
    # Decoding names its input several times: what that costs to make is a column of its own, made once.
    base = base.withColumns({"_km_text": _tidy(_decoded(F.col("_km_bare"))), "_km_title": F.btrim(F.regexp_replace(_decoded(F.col("_km_head")), r"[ \t\r\n]+", " "), F.lit(" "))})
    fields = F.concat(
        F.lit("title: "), F.col("_km_title"), F.lit("\r\nlanguage: "), F.col("_km_lang"),
        F.lit("\r\npayload-bytes: "), F.col("_km_bytes").cast("string"), F.lit("\r\ntext-bytes: "), F.octet_length("_km_text").cast("string"), F.lit("\r\n"),
    )
    pair = F.array(
        F.struct(F.lit("metadata").alias("t"), F.lit("application/warc-fields").alias("c"), fields.alias("b")),
        F.struct(F.lit("conversion").alias("t"), F.lit("text/plain; charset=utf-8").alias("c"), F.col("_km_text").alias("b")),
    )
    rows = base.withColumn("_km_r", F.explode(pair))
    return rows.select(
        F.col("_km_key").alias(key),
        F.col("_km_r.t").alias("record_type"),
        record_id(F.col("_km_r.t"), F.col("_km_key"), F.col("_km_url")).alias("record_id"),
        record_id(F.lit("response"), F.col("_km_key"), F.col("_km_url")).alias("refers_to"),
        F.col("_km_url").alias("target_uri"),
        F.col("_km_r.c").alias("content_type"),
        F.col("_km_headers").alias("source_headers"),
        F.col("_km_digest").alias("refers_to_digest"),
        F.concat(F.lit("sha256:"), F.sha2(F.col("_km_r.b"), 256)).alias("block_digest"),
        F.octet_length(F.col("_km_r.b")).cast("bigint").alias("content_length"),
        F.col("_km_r.b").alias("block"),
    )


def as_records(derived: DataFrame, date: str | None = None) -> DataFrame:
    """The records as WARC/1.1 text in one column, record; date: now, if none is given.

    The source's payload digest and every line of its header block stand in extension fields, in order. One record a row, repeated rows
    included; an empty table gives an empty table.
    """
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    named = [
        ("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Refers-To-Payload-Digest", "refers_to_digest"),
        ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"),
    ]
    lines = [F.concat(F.lit(f"{name}: "), F.col(c).cast("string")) for name, c in named]
    source = F.transform(F.filter(F.split("source_headers", "\r?\n"), lambda x: x != ""), lambda x: F.concat(F.lit("WARC-Source-Header: "), x))
    head = F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines[:4], F.concat(F.lit("WARC-Date: "), now if date is None else F.lit(date)), *lines[4:], source)
    return derived.select(F.concat(head, F.lit("\r\n\r\n"), F.col("block"), F.lit("\r\n\r\n")).alias("record"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(table(spark, sf_dir, "pages"))


def oracle() -> str:
    def q(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def e(text: str) -> str:
        return "E" + q(text.replace("\\", "\\\\").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t"))

    names = "MAP {" + ", ".join(f"{q(n)}: {q(c)}" for n, c in ENTITIES.items()) + "}"

    def decoded(x: str) -> str:
        name = f"regexp_extract(p, {q(_ENTITY_RE)}, 1)"
        cp = f"CASE WHEN lower({name}[1:2]) = '#x' THEN CAST('0x' || {name}[3:] AS INT) ELSE CAST({name}[2:] AS INT) END"
        char = f"CASE WHEN {name} = '' THEN NULL WHEN {name}[1] <> '#' THEN {names}[{name}] WHEN {cp} = 160 THEN ' ' WHEN {cp} BETWEEN 1 AND 55295 OR {cp} BETWEEN 57344 AND 1114111 THEN chr({cp}) END"
        return f"(SELECT s[1] || array_to_string(list_transform(s[2:], lambda p: coalesce({char} || p[length({name}) + 2 :], '&' || p)), '') FROM (SELECT string_split({x}, '&') AS s))"

    text = f"regexp_replace(coalesce(html, ''), {q(_HIDDEN_RE)}, ' ', 'g')"
    text = decoded(f"regexp_replace(regexp_replace({text}, {q(_BLOCK_RE)}, chr(10), 'g'), '<[^>]*>', '', 'g')")
    text = rf"trim(regexp_replace(regexp_replace({text}, '[ \t\r\x0b\x0c]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10))"
    title = decoded(f"regexp_extract(coalesce(html, ''), {q(_TITLE_RE)}, 1)")
    urn = lambda kind: "(SELECT '<urn:uuid:' || d[1:8] || '-' || d[9:12] || '-' || d[13:16] || '-' || d[17:20] || '-' || d[21:32] || '>' FROM (SELECT md5(" + kind + " || '|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || url) AS d))"
    return f"""
WITH b AS (SELECT page_id, coalesce(url, '') AS url, {text} AS text,
             trim(regexp_replace({title}, '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS title,
             regexp_extract(coalesce(html, ''), {q(_LANG_RE)}, 1) AS lang,
             strlen(coalesce(html, '')) AS n, 'sha256:' || sha256(coalesce(html, '')) AS digest FROM pages),
r AS (SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
        'title: ' || title || {e(chr(13) + chr(10))} || 'language: ' || lang || {e(chr(13) + chr(10))} || 'payload-bytes: ' || CAST(n AS VARCHAR)
        || {e(chr(13) + chr(10))} || 'text-bytes: ' || CAST(strlen(text) AS VARCHAR) || {e(chr(13) + chr(10))} AS block FROM b
      UNION ALL SELECT *, 'conversion', 'text/plain; charset=utf-8', text FROM b)
SELECT page_id, record_type, {urn('record_type')} AS record_id, {urn("'response'")} AS refers_to, url AS target_uri, content_type,
  {e(HEADERS)} AS source_headers, digest AS refers_to_digest, 'sha256:' || sha256(block) AS block_digest,
  CAST(strlen(block) AS BIGINT) AS content_length, block FROM r"""
