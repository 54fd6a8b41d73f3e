"""Queries: sections, comments, projects.

The DuckDB oracle cannot run lookahead regexes.  In ``sectioned_docs`` every line is a numbered
sentence without another full stop, so each pattern's lookahead ends a match at the end of the line: the oracle searches
line by line, pattern by pattern, and applies the same dict semantics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from redline.functions.text import WS
from redline.operators import sections as X
from redline.plans.q_text import strip_sql
from redline.plans.registry import query
from redline.plans.views_sql import VIEWS
from redline.sources import views as V

NUM = r"\p{Nd}+\.\p{Nd}+(?:\.\p{Nd}+)?"


def _ctes(*names: str, extra: str = "") -> str:
    parts = [f"{n} AS ({VIEWS[n]})" for n in names]
    if extra:
        parts.append(extra.strip().rstrip(","))
    return "WITH " + ",\n".join(parts) + "\n"


def _body_sql(x: str, max_len: int) -> str:
    s = f"regexp_replace({strip_sql(x)}, '{WS}+', ' ', 'g')"
    return f"CASE WHEN length({s}) > {max_len} THEN substr({s}, 1, {max_len}) || '...' ELSE {s} END"


# Per pattern list: number, separator, body of the patterns that documents can match.
LINE_PATTERNS = [(NUM, f"{WS}+"), (NUM, f"(?::|{WS})*")]
LINE_PATTERNS_STRICT = [(NUM, f"{WS}*(?:[:-]|{WS})*"), (NUM, f"(?::|{WS})*")]
SECTION_WORD = f"Section{WS}+{NUM}"


def _line_sections_sql(src: str, max_len: int, min_len: int | None, id_col: str = "doc_id",
                       extra_cols: str = "") -> str:
    """Sections of a sectioned text, line by line -> (id, section_num, section_text, first_pos)."""
    (n1, s1), (n3, s3) = LINE_PATTERNS_STRICT if min_len is not None else LINE_PATTERNS
    s2 = f"(?::|{WS})*" if min_len is not None else f"(?::|{WS})+"
    rxs = [f"({n1}){s1}([A-Z][^.]*)$", f"({SECTION_WORD}){s2}([^.]*)$", f"({n3}){s3}([A-Z][^.]*)$"]
    found = " UNION ALL ".join(
        f"SELECT {id_col}, {extra_cols} {p} AS p, pos, regexp_extract(l, '{rx}', 1) AS num, regexp_extract(l, '{rx}', 2) AS body "
        f"FROM ll WHERE regexp_matches(l, '{rx}')" for p, rx in enumerate(rxs))
    keep = f"WHERE length(section_text) > {min_len}" if min_len is not None else ""
    return f"""
WITH ll AS (SELECT {id_col}, {extra_cols} unnest(ls) AS l, generate_subscripts(ls, 1) AS pos
            FROM (SELECT {id_col}, {extra_cols} string_split(text, chr(10)) AS ls FROM {src})),
mm AS (SELECT {id_col}, {extra_cols} p, pos, regexp_replace({strip_sql('num')}, '^Section{WS}+', '') AS section_num,
              {_body_sql('body', max_len)} AS section_text FROM ({found})),
mk AS (SELECT * FROM mm {keep})
SELECT {id_col}, {extra_cols} section_num, arg_max(section_text, p * 1000000000 + pos) AS section_text,
       CAST(row_number() OVER (PARTITION BY {id_col} ORDER BY min(p * 1000000000 + pos)) - 1 AS INTEGER) AS first_pos
FROM mk GROUP BY {id_col}, {extra_cols} section_num"""


SECTIONS_SQL = _ctes("sectioned_docs", extra=f"secs AS ({_line_sections_sql('sectioned_docs', 2000, None)})")


@query("extract_sections", SECTIONS_SQL + "SELECT * FROM secs")
def extract_sections_q(spark, sf):
    return X.extract_sections(V.sectioned_docs(spark, sf))


@query("extract_sections_strict", _ctes("sectioned_docs") + f"SELECT * FROM ({_line_sections_sql('sectioned_docs', 1500, 50)})")
def extract_sections_strict_q(spark, sf):
    return X.extract_sections(V.sectioned_docs(spark, sf), patterns=X.SECTION_PATTERNS_STRICT, max_len=1500,
                              min_len=50)


KEY_SQL = ("CASE WHEN list_bool_and(list_transform(string_split(section_num, '.'), "
           "lambda x: TRY_CAST(x AS BIGINT) IS NOT NULL)) "
           "THEN list_transform(string_split(section_num, '.'), lambda x: TRY_CAST(x AS BIGINT)) "
           "ELSE [999, 999, 999]::BIGINT[] END")


@query("section_sort", SECTIONS_SQL + f"""
SELECT doc_id, section_num,
       CAST(row_number() OVER (PARTITION BY doc_id ORDER BY {KEY_SQL}, first_pos) - 1 AS INTEGER) AS sort_rank
FROM secs""")
def section_sort_q(spark, sf):
    s = X.extract_sections(V.sectioned_docs(spark, sf))
    w = Window.partitionBy("doc_id").orderBy(X.section_key("section_num"), "first_pos")
    return s.select("doc_id", "section_num", (F.row_number().over(w) - 1).cast("int").alias("sort_rank"))


# ---- projects -----------------------------------------------------------------------------------

PROJECT_FILES_SQL = """
pdf AS (SELECT project, filename, doc_id FROM contract_files WHERE suffix(filename, '.pdf')),
f1 AS (SELECT project, min(filename) AS f1 FROM pdf GROUP BY project),
f2 AS (SELECT pdf.project, min(filename) AS f2 FROM pdf JOIN f1 USING (project) WHERE filename > f1 GROUP BY ALL),
wf AS (SELECT project, min(filename) AS word_file FROM contract_files
       WHERE suffix(filename, '.docx') OR suffix(filename, '.doc') GROUP BY project),
chosen AS (SELECT pdf.project, pdf.doc_id, pdf.filename, CASE WHEN filename = f1 THEN 1 ELSE 2 END AS file_rank,
                  word_file
           FROM pdf JOIN f1 USING (project) JOIN f2 USING (project) JOIN wf USING (project)
           WHERE filename = f1 OR filename = f2),
psecs AS (SELECT c.project, c.file_rank, s.section_num, s.section_text, s.first_pos
          FROM chosen c JOIN secs s USING (doc_id)),
proj_sections AS (
  SELECT project, section_num, section_text,
         CAST(row_number() OVER (PARTITION BY project ORDER BY kr, kp) - 1 AS INTEGER) AS first_pos
  FROM (SELECT project, section_num, arg_max(section_text, file_rank * 1000000 + first_pos) AS section_text,
               min(file_rank) AS kr, arg_min(first_pos, file_rank * 1000000 + first_pos) AS kp
        FROM psecs GROUP BY project, section_num))"""

PROJECT_SQL = _ctes("sectioned_docs", "contract_files",
                    extra=f"secs AS ({_line_sections_sql('sectioned_docs', 2000, None)}),\n{PROJECT_FILES_SQL}")


def project_sections_df(spark, sf, **kw):
    """Sections of each project's two chosen PDFs: the (small) choice is joined to the texts
    first, so the regex pass only runs on the chosen documents."""
    files = V.contract_files(spark, sf).select("doc_id", "filename", "project")
    chosen = X.project_files(files)
    docs = V.sectioned_docs(spark, sf).select("doc_id", "text").join(chosen.select("doc_id", "project", "file_rank"),
                                                                     "doc_id")
    secs = X.extract_sections(docs, keep=("project", "file_rank"), **kw)
    return X.project_sections(secs)


@query("project_sections", PROJECT_SQL + "SELECT * FROM proj_sections")
def project_sections_q(spark, sf):
    return project_sections_df(spark, sf)


@query("discover_projects", _ctes("contract_files") + """
SELECT project, CAST(count(*) FILTER (WHERE suffix(filename, '.pdf')) AS BIGINT) AS n_pdf,
       CAST(count(*) FILTER (WHERE suffix(filename, '.docx') OR suffix(filename, '.doc')) AS BIGINT) AS n_word,
       count(*) FILTER (WHERE suffix(filename, '.pdf')) >= 2
         AND count(*) FILTER (WHERE suffix(filename, '.docx') OR suffix(filename, '.doc')) >= 1 AS qualifies
FROM contract_files GROUP BY project""")
def discover_projects_q(spark, sf):
    return X.discover_projects(V.contract_files(spark, sf).select("project", "filename"))


# ---- comments -----------------------------------------------------------------------------------

PARAS_SQL = f"""
paras AS (
  SELECT review_id, pos, p AS paragraph, regexp_extract_all(p, '({NUM})', 1) AS refs
  FROM (SELECT review_id, pos, {strip_sql('l')} AS p
        FROM (SELECT review_id, unnest(ls) AS l, generate_subscripts(ls, 1) - 1 AS pos
              FROM (SELECT review_id, string_split(text, chr(10)) AS ls FROM review_docs)))
  WHERE p <> ''),
marked AS (SELECT *, CAST(len(refs) > 0 AS INTEGER) AS has_ref,
                  sum(CAST(len(refs) > 0 AS INTEGER)) OVER (PARTITION BY review_id ORDER BY pos
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM paras),
grouped AS (
  SELECT review_id, cum - 1 AS k, 1 AS kind, paragraph AS comment, refs FROM marked WHERE has_ref = 1
  UNION ALL
  SELECT review_id, cum AS k, 0 AS kind, string_agg(paragraph, ' ' ORDER BY pos), []::VARCHAR[]
  FROM marked WHERE has_ref = 0 GROUP BY review_id, cum),
comments AS (SELECT review_id, CAST(row_number() OVER (PARTITION BY review_id ORDER BY k, kind) - 1 AS INTEGER)
                    AS comment_idx, comment, refs FROM grouped)"""

COMMENTS_SQL = _ctes("comment_docs", "review_docs", extra=PARAS_SQL)


def comments_df(spark, sf):
    r = V.review_docs(spark, sf)
    c = X.parse_comments(r.select("review_id", "text"), id_col="review_id")
    return c.join(r.select("review_id", "project"), "review_id")


@query("parse_comments_grouped", COMMENTS_SQL +
       "SELECT review_id, comment_idx, comment, array_to_string(refs, '|') AS refs FROM comments")
def parse_comments_grouped_q(spark, sf):
    c = X.parse_comments(V.review_docs(spark, sf).select("review_id", "text"), id_col="review_id")
    return c.select("review_id", "comment_idx", "comment", F.array_join("refs", "|").alias("refs"))


@query("parse_comments_flat", _ctes("comment_docs", "review_docs", extra=PARAS_SQL) + f"""
SELECT review_id, pos, c AS comment, array_to_string(refs, '|') AS refs, len(refs) > 0 AS has_section_refs
FROM (SELECT review_id, pos, refs, {strip_sql(f"regexp_replace(paragraph, '{WS}+', ' ', 'g')")} AS c
      FROM paras WHERE length(paragraph) > 10)
WHERE length(c) > 30""")
def parse_comments_flat_q(spark, sf):
    c = X.parse_comments_flat(V.review_docs(spark, sf).select("review_id", "text"), id_col="review_id")
    return c.select("review_id", F.col("pos").cast("bigint").alias("pos"), "comment",
                    F.array_join("refs", "|").alias("refs"), "has_section_refs")


@query("section_refs", f"""
SELECT doc_id, ref, CAST(count(*) AS BIGINT) AS n
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '({NUM})', 1)) AS ref FROM documents)
GROUP BY doc_id, ref""")
def section_refs_q(spark, sf):
    from redline.sources.tables import table
    d = table(spark, sf, "documents", "doc_id", "text")
    return (d.select("doc_id", F.explode(X.section_refs("text")).alias("ref"))
            .groupBy("doc_id", "ref").agg(F.count(F.lit(1)).cast("bigint").alias("n")))


FULL_SQL = _ctes("sectioned_docs", "contract_files", "comment_docs", "review_docs",
                 extra=f"secs AS ({_line_sections_sql('sectioned_docs', 2000, None)}),\n{PROJECT_FILES_SQL},"
                       f"\n{PARAS_SQL},\npcomments AS (SELECT c.*, r.project FROM comments c JOIN review_docs r "
                       f"USING (review_id))")


@query("quality_filter", FULL_SQL + """
SELECT review_id, comment_idx, comment, array_to_string(refs, '|') AS refs FROM pcomments c
WHERE length(comment) BETWEEN 10 AND 5000 AND length(trim(comment)) > 0
  AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(c.refs) AS ref) r
                  WHERE NOT EXISTS (SELECT 1 FROM proj_sections s WHERE s.project = c.project
                                    AND s.section_num = r.ref AND length(s.section_text) >= 20))""")
def quality_filter_q(spark, sf):
    c = comments_df(spark, sf)
    out = X.quality_filter(c, project_sections_df(spark, sf))
    return out.select("review_id", "comment_idx", "comment", F.array_join("refs", "|").alias("refs"))


@query("project_metadata", FULL_SQL + """
SELECT p.project, p.pdf_files, p.word_file, coalesce(s.sections_found, '') AS sections_found,
       CAST(coalesce(k.n_comments, 0) AS BIGINT) AS review_comments_count, coalesce(k.comments, '') AS review_comments
FROM (SELECT project, string_agg(filename, '|' ORDER BY file_rank) AS pdf_files, min(word_file) AS word_file
      FROM chosen GROUP BY project) p
LEFT JOIN (SELECT project, string_agg(section_num, '|' ORDER BY first_pos) AS sections_found
           FROM proj_sections GROUP BY project) s USING (project)
LEFT JOIN (SELECT project, count(*) AS n_comments, string_agg(md5(comment), '|' ORDER BY review_id, comment_idx) AS comments
           FROM pcomments GROUP BY project) k USING (project)""")
def project_metadata_q(spark, sf):
    files = V.contract_files(spark, sf).select("doc_id", "filename", "project")
    chosen = X.project_files(files)
    p = chosen.groupBy("project").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("file_rank", "filename")))["filename"], "|")
        .alias("pdf_files"), F.min("word_file").alias("word_file"))
    s = project_sections_df(spark, sf).groupBy("project").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("first_pos", "section_num")))["section_num"], "|")
        .alias("sections_found"))
    k = comments_df(spark, sf).groupBy("project").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.sort_array(F.collect_list(F.struct("review_id", "comment_idx", F.md5("comment").alias("c"))))["c"], "|")
        .alias("comments"))
    out = p.join(s, "project", "left").join(k, "project", "left")
    return out.select("project", "pdf_files", "word_file", F.coalesce("sections_found", F.lit("")).alias("sections_found"),
                      F.coalesce("n", F.lit(0)).cast("bigint").alias("review_comments_count"),
                      F.coalesce("comments", F.lit("")).alias("review_comments"))
