"""Queries: cleaning, chunking, line statistics, page text."""

from __future__ import annotations

from pyspark.sql import functions as F

from redline.functions.text import WS, clean_text
from redline.operators import text as T
from redline.operators.detect import detect_firm
from redline.plans.registry import query
from redline.plans.views_sql import with_views
from redline.sources import views as V
from redline.sources.tables import table

# DuckDB spellings shared by several oracles.
KEEP = "[^\\p{L}\\p{N}_ .,!?;:()\\-''\"]+"


def strip_sql(x: str) -> str:
    return "regexp_replace(" + x + ", '^" + WS + "+|" + WS + "+\\z', '', 'g')"


def clean_sql(x: str) -> str:
    t = "trim(regexp_replace(regexp_replace(" + x + ", '" + WS + "+', ' ', 'g'), '" + KEEP + "', '', 'g'))"
    return f"CASE WHEN length({t}) > 10 THEN {t} ELSE '' END"


@query("clean_text", f"SELECT doc_id, {clean_sql('text')} AS cleaned FROM documents")
def clean_text_q(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text")
    return d.select("doc_id", clean_text("text").alias("cleaned"))


def _chunk_sql(size=1000, overlap=200, lookback=100):
    lo = f"greatest(s + {size - lookback}, s)"
    e0 = f"(s + {size})"
    last = f"length(regexp_extract(substr(text, {lo} + 2, {e0} - {lo}), '(?s)^.*[.!?]', 0))"
    e = f"(CASE WHEN {e0} < n AND {last} > 0 THEN {lo} + 1 + {last} ELSE {e0} END)"
    return f"""
base AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL),
steps AS (
  WITH RECURSIVE st(doc_id, s, e, n, text) AS (
    SELECT doc_id, s, {e}, n, text FROM (SELECT doc_id, 0 AS s, n, text FROM base WHERE n > {size})
    UNION ALL
    SELECT doc_id, s, {e}, n, text FROM (SELECT doc_id, e - {overlap} AS s, n, text FROM st WHERE e - {overlap} < n)
  ) SELECT * FROM st),
pieces AS (
  SELECT doc_id, s, {strip_sql(f'substr(text, s + 1, e - s)')} AS chunk FROM steps
  UNION ALL
  SELECT doc_id, 0, text FROM base WHERE n <= {size}),
chunks AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS index,
         chunk AS text, CAST(length(chunk) AS INTEGER) AS length
  FROM pieces WHERE chunk <> '' OR doc_id IN (SELECT doc_id FROM base WHERE n <= {size}))"""


CHUNKS_SQL = "WITH " + _chunk_sql()


@query("chunk_text", CHUNKS_SQL + "\nSELECT doc_id, index, text, length FROM chunks")
def chunk_text_q(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text")
    return T.chunk_text(d)


def _file_chunks(spark, sf):
    cf = V.contract_files(spark, sf).select("doc_id", F.col("extracted_text").alias("text"), "filename",
                                            F.col("uploaded_at").alias("processed_at"))
    return T.chunk_text(cf, keep=("filename", "processed_at"))


FILE_CHUNKS_SQL = with_views("SELECT 1", "contract_files")[:-len("SELECT 1")].rstrip() + "," + \
    _chunk_sql() + """,
fchunks AS (SELECT c.*, f.filename, f.uploaded_at AS processed_at
            FROM chunks c JOIN contract_files f USING (doc_id))
"""


@query("chunk_training_rows", FILE_CHUNKS_SQL +
       "SELECT doc_id, index, text, filename AS source, md5(CAST(doc_id AS VARCHAR) || ':' || CAST(index AS VARCHAR))"
       " AS chunk_id FROM fchunks")
def chunk_training_rows_q(spark, sf):
    return T.chunk_training_rows(_file_chunks(spark, sf))


@query("chunk_preview", CHUNKS_SQL + "\nSELECT doc_id, index, text, length FROM chunks WHERE index < 5")
def chunk_preview_q(spark, sf):
    return T.chunk_preview(T.chunk_text(table(spark, sf, "documents", "doc_id", "text")))


@query("processed_listing", FILE_CHUNKS_SQL + """
SELECT doc_id, filename, CAST(count(*) AS BIGINT) AS total_chunks, CAST(sum(length) AS BIGINT) AS total_chunk_chars,
       max(processed_at) AS processed_at
FROM fchunks GROUP BY doc_id, filename""")
def processed_listing_q(spark, sf):
    return T.processed_listing(_file_chunks(spark, sf))


@query("line_stats", f"""
SELECT doc_id, CAST(len(lines) AS BIGINT) AS total_lines, CAST(len(ne) AS BIGINT) AS non_empty_lines,
       round(CASE WHEN len(ne) > 0 THEN list_sum(list_transform(ne, lambda x: length(x))) / len(ne) ELSE 0.0 END, 6)
         AS avg_line_length,
       array_to_string(list_transform(ne[1:5], lambda x: CASE WHEN length(x) > 100 THEN substr(x, 1, 100) || '...'
                                                              ELSE x END), chr(10)) AS first_lines,
       substr({strip_sql('text')}, 1, 500) AS preview
FROM (SELECT doc_id, text, string_split(text, chr(10)) AS lines,
             list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> '') AS ne
      FROM documents)""")
def line_stats_q(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text")
    return T.line_stats(d).drop("text")


def _status_sql():
    from redline.plans.q_compare import _with
    return _with("""
SELECT d.id, d.filename, d.extracted_text IS NOT NULL AND d.extracted_text <> '' AS text_extracted,
       CAST(CASE WHEN d.extracted_text IS NULL OR d.extracted_text = '' THEN 0 ELSE length(d.extracted_text) END
            AS BIGINT) AS text_length,
       d.law_firm_id, coalesce(f.name, 'N.A.') AS law_firm_name
FROM detected d LEFT JOIN law_firms f ON f.id = d.law_firm_id""")


@query("text_extraction_status", _status_sql())
def text_extraction_status_q(spark, sf):
    cf = V.contract_files(spark, sf)
    det = detect_firm(cf.select("id", "filename", "extracted_text"), V.law_firms(spark, sf))
    return T.text_extraction_status(det)


HTML_SQL = ("regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', ' ', 'g'),"
            " '(?is)<style\\b.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')")
for a, b in T.ENTITIES:
    HTML_SQL = f"replace({HTML_SQL}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
HTML_SQL = strip_sql(f"regexp_replace({HTML_SQL}, '{WS}+', ' ', 'g')")

PAGES_SQL = f"""
SELECT page_id, regexp_replace(url, '[?#].*$', '') AS doc_url,
       coalesce(TRY_CAST(nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '') AS INTEGER), 1) AS page_no,
       {HTML_SQL} AS text
FROM pages"""


@query("page_text", f"""
SELECT doc_url, CAST(count(*) AS BIGINT) AS total_pages,
       string_agg(chr(10) || '--- Page ' || CAST(page_no AS VARCHAR) || ' ---' || chr(10) || text || chr(10), ''
                  ORDER BY page_no, page_id) AS text
FROM ({PAGES_SQL}) GROUP BY doc_url""")
def page_text_q(spark, sf):
    p = table(spark, sf, "pages", "page_id", "url", "html")
    return T.assemble_pages(T.page_text(p))
