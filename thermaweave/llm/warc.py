"""WARC derivative builder: linked metadata and plain-text conversion records from captured responses.

Every response row gives a metadata record (title, language, number of links) and a conversion record (plain text).
Both refer to the response's record id and carry its target URI and payload digest; each has its own block digest.
All of it is one pass without a shuffle, in Spark SQL functions but for character references, which Python decodes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Elements that have no text, tags that end a line, the character references that are decoded without
#: Python (the ampersand last).
SILENT = ("script", "style", "noscript", "template", "title")
BREAKS = "p|div|article|section|h[1-6]|li|ul|ol|table|tr|td|th|br|figure|figcaption|nav|body|html|head|header|footer|blockquote|pre|hr"
REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))
#: References of the no-break space.
BLANK = re.compile(r"&(?:nbsp;?|#0*160(?:;|(?![0-9]))|#[xX]0*[aA]0(?:;|(?![0-9a-fA-F])))")
#: (pattern, replacement) in turn; both Java's and RE2's syntax.
STEPS = (
    (r"(?is)<!--.*?(?:-->|\z)|" + "|".join(rf"<{t}(?:[\s/][^>]*)?>.*?(?:</{t}\s*>|\z)" for t in SILENT), ""),
    (rf"(?i)</?(?:{BREAKS})(?:[\s/][^>]*)?>", "\n"),
    (r"<[!/a-zA-Z][^>]*>", ""),
)
SPACES = ((r"[ \t\r\f\x0B]+", " "), (r" ?\n[ \n]*", "\n"))
#: A header's line; a line that begins with a blank goes on with the one before.
FIELD, FOLDED, MEDIA_TYPE = r"(?m)^([!#$%&'*+.^_`|~0-9A-Za-z-]+:[^\r\n]*)", r"\r?\n[ \t]+", r"(?im)^content-type:[ \t]*([^\r\n]*?)[ \t]*$"
TITLE, LANGUAGE, LINK = r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>", r"(?i)<html(?:\s[^>]*)?\slang=[\"']?([a-zA-Z-]*)", r"(?i)<a\s[^>]*href"


def _referred(c: Column) -> Column:
    for a, b in REFERENCES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _spaced(c: Column) -> Column:
    for p, r in SPACES:
        c = F.regexp_replace(c, p, r)
    return F.btrim(c, F.lit(" \n"))


def _stripped(html: Column) -> Column:
    for p, r in STEPS:
        html = F.regexp_replace(html, p, r)
    return html


def plain_text(html: Column) -> Column:
    return _spaced(_referred(_stripped(html)))


def decoded(text: str) -> str:
    """All character references, named and numeric, once; those of the no-break space are blanks, as in REFERENCES."""
    return unescape(BLANK.sub(" ", text))


def _with_all_references(base: DataFrame) -> DataFrame:
    """base with the columns title and text of its html, every reference decoded."""
    rows = base.withColumns({"title": F.regexp_replace(F.regexp_extract("html", TITLE, 1), r"\s+", " "), "text": _stripped(F.col("html"))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in ("title", "text"):
                b = b.set_column(b.schema.get_field_index(c), c, pa.array([decoded(x) if "&" in x else x for x in b.column(b.schema.get_field_index(c)).to_pylist()], type=pa.string()))
            yield b

    # Of the page only what the records hold goes to Python and back.
    rows = rows.withColumns({"language": F.regexp_extract("html", LANGUAGE, 1), "links": F.regexp_count("html", F.lit(LINK))}).drop("html")
    return rows.mapInArrow(run, rows.schema).withColumns({c: _spaced(F.col(c)) for c in ("title", "text")})


def record_id(kind: str, *parts: Column) -> Column:
    """A URN whose UUID is the md5 of the record's kind and parts."""
    h = F.md5(F.concat_ws("\n", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def header_fields(headers: Column) -> Column:
    """The lines of a block of HTTP headers that are fields, unfolded, in order, joined by line ends; null if null."""
    return F.array_join(F.regexp_extract_all(F.regexp_replace(headers, FOLDED, " "), F.lit(FIELD), 1), "\r\n")


def warc_date(c: Column) -> Column:
    """A time, or text that reads as one, in the form of WARC-Date, in UTC; null if it is none."""
    return F.date_format(F.to_utc_timestamp(c.try_cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def derive(pages: DataFrame, all_references: bool = True, headers: str | None = None, date: str | None = None, source_id: str | None = None) -> DataFrame:
    """Two rows per row of pages (page_id, url, html): page_id, record_type, record_id, refers_to, target_uri,
    source_type, source_length, source_digest, block_type, block_length, block_digest, block.

    Null HTML is an empty response: its text is empty and its metadata have an empty title. A null url stays null as
    target. Ids and digests follow content, so repeated rows give equal records. Text of any length is converted whole;
    other columns are not read; an empty table gives no rows. Titles and texts have all character references decoded,
    named and numeric, closed or not, as HTML has it; without all_references only those of REFERENCES, without Python.

    headers, date, source_id: names of columns of pages that hold more of the response. headers is its block of HTTP
    headers: the media type that it names is source_type, its fields are the column source_headers and, as `source-...`,
    fields of the metadata record; null, or no media type: text/html. date is the time of capture (a timestamp, or text
    that reads as one): the column created, which WARC-Date takes; null, or no time: null. source_id is the response's own
    record id, which refers_to keeps as it is; null or empty: the id that follows from page_id, url, digest and the columns named.
    Records of different responses have different ids, whatever of these they share.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    more = {}
    if headers:
        found = F.trim(F.regexp_extract(F.regexp_replace(F.col(headers), FOLDED, " "), MEDIA_TYPE, 1))
        more |= {"source_type": F.coalesce(F.nullif(found, F.lit("")), F.lit("text/html")), "source_headers": header_fields(F.col(headers))}
    if date:
        more["created"] = warc_date(F.col(date))
    if source_id:
        more["own_id"] = F.nullif(F.col(source_id).cast("string"), F.lit(""))
    base = pages.select(F.col("page_id"), F.col("url").alias("target_uri"), html.alias("html"), *[c.alias(k) for k, c in more.items()])
    base = base.withColumns({"source_digest": F.concat(F.lit("sha256:"), F.sha2("html", 256)), "source_length": F.octet_length("html").cast("long")})
    base = base.withColumn("refers_to", record_id("response", F.col("page_id"), F.col("target_uri"), F.col("source_digest"), *[F.col(k) for k in ("source_headers", "created") if k in more]))
    parts = [F.col("refers_to")]
    if source_id:  # ids of records tell responses apart that have one id by mistake
        base = base.withColumnRenamed("refers_to", "derived_id").withColumn("refers_to", F.coalesce("own_id", "derived_id"))
        parts.append(F.col("derived_id"))
    if all_references:
        base = _with_all_references(base)
        title, text, language, links = (F.col(c) for c in ("title", "text", "language", "links"))
    else:
        title = _spaced(_referred(F.regexp_replace(F.regexp_extract("html", TITLE, 1), r"\s+", " ")))
        text, language, links = plain_text(F.col("html")), F.regexp_extract("html", LANGUAGE, 1), F.regexp_count("html", F.lit(LINK))
    metadata = F.concat(F.lit("title: "), title, F.lit("\r\nlanguage: "), language, F.lit("\r\nlinks: "), links.cast("string"), F.lit("\r\n"))
    if headers:
        metadata = F.concat(metadata, F.coalesce(F.regexp_replace("source_headers", r"([^\r\n]+)(?:\r\n)?", "source-$1\r\n"), F.lit("")))
    kinds = F.array(F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("block_type"), metadata.alias("block")), F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain").alias("block_type"), text.alias("block")))
    rows = base.withColumn("_r", F.explode(kinds)).select("*", "_r.*")
    source_type = F.col("source_type") if headers else F.lit("text/html").alias("source_type")
    return rows.select(
        "page_id", "record_type", F.when(F.col("record_type") == "metadata", record_id("metadata", *parts)).otherwise(record_id("conversion", *parts)).alias("record_id"), "refers_to", "target_uri",
        source_type, "source_length", "source_digest", "block_type", F.octet_length("block").cast("long").alias("block_length"), F.concat(F.lit("sha256:"), F.sha2("block", 256)).alias("block_digest"), "block",
        *[c for c in ("source_headers", "created") if c in more],
    )


#: Header names and the columns they take; a null value has no line.
HEADERS = (
    ("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Block-Digest", "block_digest"),
    ("X-Source-Content-Type", "source_type"), ("X-Source-Content-Length", "source_length"), ("X-Source-Payload-Digest", "source_digest"), ("Content-Type", "block_type"), ("Content-Length", "block_length"),
)
#: When the query's records are dated; WARC-Date is mandatory and the given pages have no date.
CREATED = "2025-01-01T00:00:00Z"


def serialised(records: DataFrame, created: str = CREATED) -> DataFrame:
    """page_id, record_type, record: each record with its WARC/1.1 header, without the two line ends that close it.

    created: the WARC-Date of all records, unless records have a column `created`. A line end in a value is a blank.
    """
    def header(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\r\n]+", " "), F.lit("\r\n")), F.lit(""))

    date = F.coalesce("created", F.lit(created)) if "created" in records.columns else F.lit(created)
    fields = [header("WARC-Date", date), *[header(n, F.col(c)) for n, c in HEADERS]]
    return records.select("page_id", "record_type", F.concat(F.lit("WARC/1.1\r\n"), *fields, F.lit("\r\n"), F.col("block")).alias("record"))


def write(records: DataFrame, path: str) -> None:
    """Files of consecutive records. A record id may stand once, so equal records are written once (they are told by id)."""
    serialised(records.dropDuplicates(["record_id"])).select("record").write.option("lineSep", "\r\n\r\n").text(path)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(table(spark, sf_dir, "pages"))


def op7_serialised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serialised(derive(table(spark, sf_dir, "pages")))


#: A character reference; a name may go on into the text that follows it.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def _windows_1252(n: int) -> str:
    """What a numeric reference from 128 to 159 stands for."""
    return bytes([n]).decode("cp1252", "ignore") or chr(n)


def _oracle() -> str:
    def text(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def replaced(c: str, steps) -> str:
        for p, r in steps:
            c = f"regexp_replace({c}, {text(p)}, {'chr(10)' if r == chr(10) else text(r)}, 'g')"
        return c

    def uuid(kind: str, parts: str) -> str:
        h = f"md5(concat_ws(chr(10), {text(kind)}, {parts}))"
        return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"

    def spaced(c: str) -> str:
        return f"trim({replaced(c, SPACES)}, ' ' || chr(10))"

    names = ", ".join(f"({text(k)}, {text(' ' if k.rstrip(';') == 'nbsp' else v)})" for k, v in sorted(html5.items()))
    high = ", ".join(text(_windows_1252(n)) for n in range(128, 160))
    title = f"regexp_replace(regexp_extract(html, {text(TITLE)}, 1), '\\s+', ' ', 'g')"
    return f"""
WITH p AS MATERIALIZED (SELECT row_number() OVER () AS row_id, page_id, url AS target_uri, coalesce(html, '') AS html FROM pages),
parts AS (SELECT row_id, 'title' AS part, {title} AS body FROM p UNION ALL SELECT row_id, 'text', {replaced("html", STEPS)} FROM p),
lists AS (SELECT row_id, part, string_split_regex(body, {text(REFERENCE)}) AS pieces, regexp_extract_all(body, {text(REFERENCE)}) AS refs FROM parts),
cut AS MATERIALIZED (SELECT row_id, part, generate_subscripts(pieces, 1) AS i, unnest(pieces) AS piece, unnest(refs) AS ref FROM lists),
named(name, value) AS (VALUES {names}),
refs AS (SELECT DISTINCT ref, substr(ref, 2) AS s FROM cut WHERE ref IS NOT NULL),
numbers AS (SELECT ref, coalesce(CASE WHEN regexp_matches(s, '^#[xX]') THEN try_cast('0x0' || ltrim(rtrim(substr(s, 3), ';'), '0') AS BIGINT) ELSE try_cast('0' || ltrim(rtrim(substr(s, 2), ';'), '0') AS BIGINT) END, 1114112) AS n FROM refs WHERE s[1] = '#'),
decoded AS (
  SELECT ref, CASE WHEN n = 0 OR n BETWEEN 55296 AND 57343 OR n > 1114111 THEN chr(65533) WHEN n BETWEEN 128 AND 159 THEN [{high}][n - 127] WHEN n = 160 THEN ' '
    WHEN n BETWEEN 1 AND 8 OR n = 11 OR n BETWEEN 14 AND 31 OR n = 127 OR n BETWEEN 64976 AND 65007 OR n % 65536 >= 65534 THEN '' ELSE chr(n::INT) END AS value FROM numbers
  UNION ALL
  SELECT ref, coalesce(max_by(value || substr(s, length(name) + 1), length(name)), ref) FROM refs LEFT JOIN named ON starts_with(s, name) WHERE s[1] <> '#' GROUP BY ref),
whole AS (SELECT row_id, part, string_agg(piece || coalesce(value, ''), '' ORDER BY i) AS body FROM cut LEFT JOIN decoded USING (ref) GROUP BY row_id, part),
b AS (SELECT p.*, {spaced("t.body")} AS title, {spaced("w.body")} AS text, 'sha256:' || sha256(html) AS source_digest, strlen(html)::BIGINT AS source_length
  FROM p JOIN whole t ON t.row_id = p.row_id AND t.part = 'title' JOIN whole w ON w.row_id = p.row_id AND w.part = 'text'),
c AS (SELECT *, {uuid("response", "coalesce(page_id::VARCHAR, ''), coalesce(target_uri, ''), source_digest")} AS refers_to FROM b),
r AS (
  SELECT *, 'metadata' AS record_type, {uuid("metadata", "refers_to")} AS record_id, 'application/warc-fields' AS block_type,
    'title: ' || title || chr(13) || chr(10) || 'language: ' || regexp_extract(html, {text(LANGUAGE)}, 1) || chr(13) || chr(10) || 'links: ' || len(regexp_extract_all(html, {text(LINK)}))::VARCHAR || chr(13) || chr(10) AS block FROM c
  UNION ALL
  SELECT *, 'conversion', {uuid("conversion", "refers_to")}, 'text/plain', text FROM c)
SELECT page_id, record_type, record_id, refers_to, target_uri, 'text/html' AS source_type, source_length, source_digest, block_type,
  strlen(block)::BIGINT AS block_length, 'sha256:' || sha256(block) AS block_digest, block FROM r
"""


ORACLE = _oracle()
SERIALISED = f"SELECT page_id, record_type, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Date: {CREATED}' || chr(13) || chr(10) || " + " || ".join(
    f"coalesce('{n}: ' || regexp_replace({c}::VARCHAR, '[\\r\\n]+', ' ', 'g') || chr(13) || chr(10), '')" for n, c in HEADERS
) + f" || chr(13) || chr(10) || block AS record FROM ({ORACLE})"
