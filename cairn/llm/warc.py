"""WARC derivative builder: metadata and plain-text conversion records that refer to response records.

All of it is column expressions. The SQL at the end is written apart from them, for the same records.
"""

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm._common import table

#: WARC's version and the date of pages that have none.
VERSION, DATE = "WARC/1.1", "2024-01-01T00:00:00Z"
#: Elements whose content is not text, and elements that begin a new line.
HIDDEN = ("script", "style", "noscript", "template")
BLOCKS = "p div br li ul ol h1 h2 h3 h4 h5 h6 tr table article section nav header footer main title head body blockquote pre".split()
ENTITY = "&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def _decoded(text: Column) -> Column:
    """text with numeric and named entities as characters, once; what names none stays."""
    common = ("amp", "lt", "gt", "quot", "nbsp")
    names = F.create_map(*(F.lit(x) for name in [*common, *sorted(set(name2codepoint) - set(common))] for x in (name, chr(name2codepoint[name]))))

    def one(e: Column) -> Column:
        body = F.substring(e, F.lit(2), F.length(e) - 2)
        digits = F.regexp_extract(body, "^#([0-9]+)$", 1)
        point = F.when(digits != "", digits.cast("long")).otherwise(F.conv(F.regexp_extract(body, "^#[xX]([0-9a-fA-F]+)$", 1), 16, 10).cast("long"))
        valid = (point > 0) & (point <= 0x10FFFF) & ((point < 0xD800) | (point > 0xDFFF))
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, point)), 8, "0")), "UTF-32")
        return F.coalesce(F.when(F.startswith(body, F.lit("#")), char).otherwise(F.try_element_at(names, body)), e)

    def joined(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(ENTITY), F.lit(0))
        return F.array_join(F.zip_with(F.split(t, ENTITY), found, lambda x, e: F.concat(x, F.coalesce(one(e), F.lit("")))), "")

    # The text is used twice but made once, and is left alone where no entity can be.
    return F.element_at(F.transform(F.array(text), lambda t: F.when(F.contains(t, F.lit("&")), joined(t)).otherwise(t)), 1)


def visible_text(html: Column) -> Column:
    """The visible text of html: blocks on lines of their own, entities decoded once, blanks collapsed.

    Comments and hidden elements end where they say, or else with the document; of two that overlap the first counts.
    """
    hidden = "|".join([r"<!--.*?(?:-->|\z)", *(rf"<{t}(?:[\s/][^>]*)?>.*?(?:</{t}\s*>|\z)" for t in HIDDEN)])
    out = F.regexp_replace(html, f"(?is){hidden}", " ")
    out = F.regexp_replace(out, rf"(?i)</?(?:{'|'.join(BLOCKS)})(?:[\s/][^>]*)?>", "\n")
    out = _decoded(F.regexp_replace(out, "(?i)<[!/a-z][^>]*>", ""))
    out = F.regexp_replace(out, "[\\t\\r\u00a0 ]+", " ")
    return F.regexp_replace(F.regexp_replace(out, " ?\\n[\\n ]*", "\n"), "\\A[\\n ]+|[\\n ]+\\z", "")


def _urn(kind: str) -> Column:
    """A record's id: the same for the same page, kind and content."""
    h = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), "digest").cast("binary"))
    parts = (F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _fields(pairs: list[tuple[str, Column]]) -> Column:
    """Lines "name: value"; a null value has no line."""
    return F.concat_ws("", *(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")) for name, value in pairs))


def derive(pages: DataFrame, record_id: str | None = None, date: str | None = None, headers: str | None = None) -> DataFrame:
    """A metadata and a conversion record for each of pages (page_id, url, html), linked by refers_to.

    record_id, date, headers: columns of the response's own WARC-Record-ID, WARC-Date and header lines, if pages has them. Its id
    is what both records refer to (else one made of page, url and content); its date is theirs and is referred to (else DATE);
    its header lines are kept in the metadata record. Null html is an empty response; a null url stays null and has no header. Pages
    equal in all columns repeat their records; other columns are ignored; no pages: no records.
    """
    src = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), *(F.col(c).cast("string").alias(n) if c else F.lit(None).cast("string").alias(n) for c, n in ((record_id, "own_id"), (date, "own_date"), (headers, "own_headers"))))
    src = src.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("source_digest", F.concat(F.lit("sha256:"), "digest"))
    title = F.trim(F.regexp_replace(_decoded(F.regexp_extract("html", r"(?is)<title(?:\s[^>]*)?>(.*?)</title", 1)), "\\s+", " "))
    linked = src.select("page_id", "url", "source_digest", "own_headers", F.octet_length("html").cast("long").alias("source_length"), F.coalesce("own_id", _urn("response")).alias("refers_to"), F.coalesce("own_date", F.lit(DATE)).alias("date"), _urn("metadata").alias("metadata_id"), _urn("conversion").alias("conversion_id"), visible_text(F.col("html")).alias("plain"), title.alias("title"))
    kept = F.when(F.col("own_headers") != "", F.concat(F.regexp_replace(F.regexp_replace("own_headers", "\\A[\\r\\n]+|[\\r\\n]+\\z", ""), "(?m)^", "source-header: "), F.lit("\r\n")))
    about = F.concat(_fields([("title", F.col("title")), ("source-length", F.col("source_length")), ("source-digest", F.col("source_digest")), ("conversion", F.col("conversion_id"))]), F.coalesce(kept, F.lit("")))
    kinds = F.array(*(F.struct(F.lit(k).alias("warc_type"), F.col(f"{k}_id").alias("record_id"), block.alias("block"), F.lit(media).alias("media")) for k, block, media in (("metadata", about, "application/warc-fields"), ("conversion", F.col("plain"), "text/plain; charset=utf-8"))))
    r = linked.withColumn("k", F.explode(kinds)).select("page_id", "url", "refers_to", "source_digest", "source_length", "date", "k.*")
    r = r.withColumns({"content_length": F.octet_length("block").cast("long"), "block_digest": F.concat(F.lit("sha256:"), F.sha2(F.col("block").cast("binary"), 256))})
    head = _fields([("WARC-Type", F.col("warc_type")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Refers-To", F.col("refers_to")), ("WARC-Refers-To-Target-URI", F.col("url")), ("WARC-Refers-To-Date", F.col("date")), ("WARC-Target-URI", F.col("url")), ("WARC-Date", F.col("date")), ("WARC-Source-Digest", F.col("source_digest")), ("WARC-Block-Digest", F.col("block_digest")), ("Content-Type", F.col("media")), ("Content-Length", F.col("content_length"))])
    return r.select("page_id", "url", "warc_type", "record_id", "refers_to", "source_digest", "source_length", "block_digest", "content_length", F.concat(F.lit(f"{VERSION}\r\n"), head).alias("headers"), "block")


def write_warc(records: DataFrame, path: str) -> None:
    """WARC files: each record is its headers, an empty line, its block and two line ends."""
    records.selectExpr("concat(headers, '\\r\\n', block) AS value").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(table(spark, sf_dir, "pages"))


_NAMES = "MAP {" + ", ".join("'{}': '{}'".format(n, chr(p).replace("'", "''")) for n, p in sorted(name2codepoint.items())) + "}"


def _plain(x: str) -> str:
    """DuckDB: entities of x decoded, by cutting it at them."""
    e = "&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
    point = "CASE WHEN e[3] IN ('x', 'X') THEN ('0x' || e[4:-2])::bigint ELSE e[3:-2]::bigint END"
    # Points that are no character have none in this table either.
    char = f"CASE WHEN e[2] = '#' THEN CASE WHEN {point} BETWEEN 1 AND 55295 OR {point} BETWEEN 57344 AND 1114111 THEN chr(({point})::int) ELSE e END ELSE coalesce(names[e[2:-2]], e) END"
    return f"list_reduce(list_transform(list_zip(string_split_regex({x}, '{e}'), regexp_extract_all({x}, '{e}')), lambda p: coalesce(p[1], '') || coalesce(list_transform([p[2]], lambda e: CASE WHEN e IS NOT NULL THEN {char} END)[1], '')), lambda a, b: a || b)"


_GONE = "|".join(["<!--.*?(-->|$)", *(rf"<{t}([\s/][^>]*)?>.*?(</{t}\s*>|$)" for t in HIDDEN)])
_ID = "'<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>'"


def _id_sql(kind: str) -> str:
    return f"list_transform([md5('{kind}|' || coalesce(page_id::varchar, '') || '|' || coalesce(url, '') || '|' || digest)], lambda h: {_ID})[1]"


ORACLE = {
    "op7_warc": f"""
WITH s AS (SELECT page_id, url, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest, {_NAMES} AS names FROM pages),
t AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(html, '{_GONE}', ' ', 'gis'), '</?({"|".join(BLOCKS)})([\\s/][^>]*)?>', chr(10), 'gi'), '<[!/a-z][^>]*>', '', 'gi') AS bare, regexp_extract(html, '<title(\\s[^>]*)?>(.*?)</title', 2, 'is') AS head FROM s),
u AS (SELECT *, {_plain("bare")} AS decoded, trim(regexp_replace({_plain("head")}, '\\s+', ' ', 'g')) AS title FROM t),
v AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(decoded, '[\\t\\r\u00a0 ]+', ' ', 'g'), ' ?\\n[\\n ]*', chr(10), 'g'), '^[\\n ]+|[\\n ]+$', '', 'g') AS plain, {_id_sql("response")} AS refers_to, {_id_sql("metadata")} AS metadata_id, {_id_sql("conversion")} AS conversion_id, octet_length(encode(html))::bigint AS source_length FROM u),
w AS (SELECT page_id, url, 'metadata' AS warc_type, metadata_id AS record_id, refers_to, digest, source_length, 'application/warc-fields' AS media, concat('title: ', title, n, 'source-length: ', source_length, n, 'source-digest: sha256:', digest, n, 'conversion: ', conversion_id, n) AS block FROM v, (SELECT chr(13) || chr(10) AS n)
UNION ALL SELECT page_id, url, 'conversion', conversion_id, refers_to, digest, source_length, 'text/plain; charset=utf-8', plain FROM v),
x AS (SELECT *, octet_length(encode(block))::bigint AS content_length, 'sha256:' || sha256(block) AS block_digest FROM w)
SELECT page_id, url, warc_type, record_id, refers_to, 'sha256:' || digest AS source_digest, source_length, block_digest, content_length,
concat('{VERSION}', n, 'WARC-Type: ', warc_type, n, 'WARC-Record-ID: ', record_id, n, 'WARC-Refers-To: ', refers_to, n, 'WARC-Refers-To-Target-URI: ' || url || n, 'WARC-Refers-To-Date: {DATE}', n, 'WARC-Target-URI: ' || url || n, 'WARC-Date: {DATE}', n, 'WARC-Source-Digest: sha256:', digest, n, 'WARC-Block-Digest: ', block_digest, n, 'Content-Type: ', media, n, 'Content-Length: ', content_length, n) AS headers, block
FROM x, (SELECT chr(13) || chr(10) AS n)"""
}
