"""Section and review-comment extraction.

Section extraction runs the reference's ordered regexes over the whole text with
``regexp_extract_all`` (Java regex keeps the lookaheads), then applies the insertion-ordered
dict semantics in-row: ``array_distinct`` over the matched numbers gives first-insertion order,
the text of the *last* match of a number wins.  Everything is a narrow projection per document.

Comment parsing is a gaps-and-islands problem over the paragraphs of one review document; the
window partitions are single documents, so their size is bounded by a document, not by the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redline.functions.text import WS, _c
from redline.operators.text import py_strip

# Fixed values that must equal the reference (Python spelling): section patterns, tried in order.
SECTION_PATTERNS = [
    r'(\d+\.\d+(?:\.\d+)?)\s+([A-Z][^.]*?)(?=\n\d+\.\d+|\n[A-Z]{2,}|\Z)',
    r'(Section\s+\d+\.\d+(?:\.\d+)?)[:\s]+([^.]*?)(?=\nSection|\n[A-Z]{2,}|\Z)',
    r'(\d+\.\d+(?:\.\d+)?)[:\s]*([A-Z][^.]*?)(?=\n\d+\.\d+|\n[A-Z]{2,}|\Z)',
]
# Second processor's variant: different separators, 1500-char cap, bodies over 50 chars only.
SECTION_PATTERNS_STRICT = [
    r'(\d+\.\d+(?:\.\d+)?)\s*[:\-\s]*([A-Z][^.]*?)(?=\n\d+\.\d+|\n[A-Z]{2,}|\Z)',
    r'(Section\s+\d+\.\d+(?:\.\d+)?)[:\s]*([^.]*?)(?=\nSection|\n[A-Z]{2,}|\Z)',
    r'(\d+\.\d+(?:\.\d+)?)[:\s]*([A-Z][^.]*?)(?=\n\d+\.\d+|\n[A-Z]{2,}|\Z)',
]
# Declared wider list (articles, clauses) — usable as another `patterns` value.
SECTION_PATTERNS_DECLARED = SECTION_PATTERNS + [
    r'(Article\s+[IVX]+|\d+)[:\s]*([A-Z][^.]*?)(?=\nArticle|\n[A-Z]{2,}|\Z)',
    r'(Clause\s+\d+\.\d+(?:\.\d+)?)[:\s]*([^.]*?)(?=\nClause|\n[A-Z]{2,}|\Z)',
]
SECTION_REF_PATTERN = r'(\d+\.\d+(?:\.\d+)?)'
# Declared extra reference patterns.
SECTION_REF_PATTERNS_DECLARED = [
    r'(\d+\.\d+(?:\.\d+)?)',
    r'(Section\s+\d+\.\d+(?:\.\d+)?)',
    r'(Article\s+[IVX]+|\d+)',
    r'(Clause\s+\d+\.\d+(?:\.\d+)?)',
]
UNPARSEABLE_KEY = [999, 999, 999]


def java_regex(p: str) -> str:
    """Python (Unicode str) regex -> Java regex with the same meaning: ``\\s`` -> Unicode whitespace
    class, ``\\d`` -> ``\\p{Nd}``, ``\\Z`` -> ``\\z`` (Java's ``\\Z`` also matches before a final
    newline).  Inside a class the whitespace class is a Java class union."""
    out, i = [], 0
    while i < len(p):
        if p[i] == "\\" and i + 1 < len(p):
            n = p[i + 1]
            out.append({"s": WS, "d": r"\p{Nd}", "Z": r"\z"}.get(n, p[i:i + 2]))
            i += 2
        else:
            out.append(p[i])
            i += 1
    return "".join(out)


def _core(pattern: str) -> str:
    """The pattern without its final lookahead, for a text that is one whole match."""
    return "(?s)^" + java_regex(pattern[:pattern.rindex("(?=")]) + r"\z"


def _matches(text: Column, patterns) -> Column:
    """All (p, i, num, body) matches, in the reference's insertion order (pattern, then match).

    Each pattern passes over the text once, for its whole matches; number and body then come from
    the short match."""
    def tag(pi, core):
        return lambda x, i: F.struct(F.lit(pi).alias("p"), i.alias("i"), F.regexp_extract(x, core, 1).alias("num"),
                                     F.regexp_extract(x, core, 2).alias("body"))
    per = []
    for pi, p in enumerate(patterns):
        per.append(F.transform(F.regexp_extract_all(text, F.lit(java_regex(p)), F.lit(0)), tag(pi, _core(p))))
    return F.concat(*per)


def clean_section_num(c: Column) -> Column:
    """strip, then drop a leading 'Section' + whitespace (any case) — one regex pass."""
    return F.regexp_replace(c, "(?i)^" + WS + "*(?:Section" + WS + "+)?|" + WS + "+\\z", "")


def clean_section_body(c: Column, max_len: int) -> Column:
    """strip + collapse whitespace, then cut to max_len characters + '...'.  Written as chained
    single-reference regex replacements (collapse, then trim the one possible edge space, then
    cut), because lambda bodies get no common-subexpression elimination."""
    s = F.regexp_replace(c, WS + "+", " ")
    s = F.regexp_replace(s, "^ | \\z", "")
    return F.regexp_replace(s, "(?s)^(.{" + str(max_len) + "}).+", "$1...")


# Every built-in pattern needs a dotted number, so a text without one cannot match any of them.
NUMBER_GUARD = r"\p{Nd}\.\p{Nd}"


def section_array(text_col, patterns=SECTION_PATTERNS, max_len: int = 2000, min_len: int | None = None) -> Column:
    """Cleaned matches array<struct<num, body>> in the reference's insertion order.  For the
    built-in pattern lists, texts without any dotted number skip the regex passes (a cheap
    conditional guard; CASE WHEN evaluates the heavy branch only when needed)."""
    m = F.transform(_matches(_c(text_col), patterns),
                    lambda x: F.struct(clean_section_num(x["num"]).alias("num"),
                                       clean_section_body(x["body"], max_len).alias("body")))
    if min_len is not None:
        m = F.filter(m, lambda x: F.length(x["body"]) > min_len)
    if patterns is SECTION_PATTERNS or patterns is SECTION_PATTERNS_STRICT:
        empty = F.array().cast("array<struct<num:string,body:string>>")
        m = F.when(_c(text_col).rlike(NUMBER_GUARD), m).otherwise(empty)
    return m


def sections_from_matches(m: Column) -> Column:
    """Dict semantics over the matches in O(k log k): sort by (number, position); the first element
    of each number's run gives its insertion position, the last gives its (winning) body; then
    order the numbers by insertion position.  The sorted array is bound once with a one-element
    ``transform`` so the lambdas below read it without re-evaluating it."""
    tagged = F.array_sort(F.transform(m, lambda x, j: F.struct(x["num"].alias("num"), j.alias("j"),
                                                                 x["body"].alias("body"))))

    def runs(srt):
        n = F.size(srt)
        firsts = F.filter(srt, lambda x, i: (i == 0) | (F.get(srt, i - 1)["num"] != x["num"]))
        lasts = F.filter(srt, lambda x, i: (i == n - 1) | (F.get(srt, i + 1)["num"] != x["num"]))
        merged = F.zip_with(firsts, lasts, lambda a, b: F.struct(a["j"].alias("first_j"), a["num"].alias("section_num"),
                                                                 b["body"].alias("section_text")))
        return F.transform(F.array_sort(merged), lambda x: F.struct(x["section_num"].alias("section_num"),
                                                                     x["section_text"].alias("section_text")))
    return F.get(F.transform(F.array(tagged), runs), 0)


def extract_sections(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", patterns=SECTION_PATTERNS,
                     max_len: int = 2000, min_len: int | None = None, keep: tuple = ()) -> DataFrame:
    """One row per section: (id, section_num, section_text, first_pos) — first_pos is the 0-based
    dict insertion position.  The regex pass runs once per document (its result is a column that
    the dict step references, so the optimizer does not inline the expensive expression)."""
    staged = df.select(F.col(id_col), *keep, section_array(text_col, patterns, max_len, min_len).alias("_m"))
    out = staged.select(F.col(id_col), *keep, F.posexplode(sections_from_matches(F.col("_m"))).alias("first_pos", "s"))
    return out.select(id_col, *keep, F.col("s.section_num").alias("section_num"),
                      F.col("s.section_text").alias("section_text"),
                      F.col("first_pos").cast("int").alias("first_pos"))


def section_key(col) -> Column:
    """Numeric sort key of a dotted number; any unparseable part -> (999, 999, 999)."""
    parts = F.transform(F.split(_c(col), r"\."), lambda x: x.try_cast("bigint"))
    ok = F.forall(parts, lambda x: x.isNotNull())
    return F.when(ok, parts).otherwise(F.array(*[F.lit(v).cast("bigint") for v in UNPARSEABLE_KEY]))


def section_refs(col) -> Column:
    """All reference numbers found in a text (money such as 2,106.23 gives 106.23)."""
    return F.regexp_extract_all(_c(col), F.lit(java_regex(SECTION_REF_PATTERN)), F.lit(1))


# ---- projects ---------------------------------------------------------------------------------

def discover_projects(files: DataFrame, min_pdfs: int = 2, min_word: int = 1) -> DataFrame:
    """Per project: PDF and Word counts (case-sensitive extensions, as a file glob) and whether the
    project qualifies (>= 2 PDFs and >= 1 Word file)."""
    pdf = F.col("filename").endswith(".pdf")
    word = F.col("filename").endswith(".docx") | F.col("filename").endswith(".doc")
    g = files.groupBy("project").agg(F.count_if(pdf).cast("bigint").alias("n_pdf"),
                                     F.count_if(word).cast("bigint").alias("n_word"))
    return g.withColumn("qualifies", (F.col("n_pdf") >= min_pdfs) & (F.col("n_word") >= min_word))


def project_files(files: DataFrame) -> DataFrame:
    """The two first PDFs (by name) and the first Word file of every qualifying project.

    Picked with plain min() aggregates (map-side combined), never by sorting a whole project
    in one task, so a project holding a large share of the files does not create a hot task."""
    pdf = files.where(F.col("filename").endswith(".pdf")).select("project", "filename", "doc_id")
    first = pdf.groupBy("project").agg(F.min("filename").alias("f1"))
    second = (pdf.join(first, "project").where(F.col("filename") > F.col("f1"))
              .groupBy("project").agg(F.min("filename").alias("f2")))
    word = (files.where(F.col("filename").endswith(".docx") | F.col("filename").endswith(".doc"))
            .groupBy("project").agg(F.min("filename").alias("word_file")))
    picks = first.join(second, "project").join(word, "project")
    chosen = (pdf.join(picks, "project")
              .where((F.col("filename") == F.col("f1")) | (F.col("filename") == F.col("f2")))
              .select("project", "doc_id", "filename",
                      F.when(F.col("filename") == F.col("f1"), 1).otherwise(2).alias("file_rank"), "word_file"))
    return chosen


def project_sections(pdf_sections: DataFrame) -> DataFrame:
    """Merge the sections of a project's PDFs: a later file overrides the text, the first position
    (file_rank, first_pos) is kept.  Output position = 0-based insertion order in the project."""
    g = pdf_sections.groupBy("project", "section_num").agg(
        F.max_by("section_text", F.struct("file_rank", "first_pos")).alias("section_text"),
        F.min(F.struct("file_rank", "first_pos")).alias("k"))
    w = Window.partitionBy("project").orderBy("k")
    return g.select("project", "section_num", "section_text",
                    (F.row_number().over(w) - 1).cast("int").alias("first_pos"))


# ---- comments ---------------------------------------------------------------------------------

def comment_paragraphs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Stripped non-empty lines with their position and reference numbers."""
    p = df.select(F.col(id_col), F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "raw"))
    p = p.select(id_col, "pos", py_strip(F.col("raw")).alias("paragraph")).where(F.col("paragraph") != "")
    return p.withColumn("refs", section_refs("paragraph"))


def parse_comments(df: DataFrame, id_col: str = "project_id", text_col: str = "text") -> DataFrame:
    """Grouped comments: a paragraph with references is its own comment; runs of paragraphs without
    references are joined by a space into one comment (empty refs), emitted before the next
    referencing paragraph.  Output (id, comment_idx, comment, refs)."""
    p = comment_paragraphs(df, id_col, text_col).withColumn("has_ref", (F.size("refs") > 0).cast("int"))
    w = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p = p.withColumn("cum", F.sum("has_ref").over(w))
    refd = p.where("has_ref = 1").select(id_col, (F.col("cum") - 1).alias("k"), F.lit(1).alias("kind"),
                                         F.col("paragraph").alias("comment"), "refs")
    islands = (p.where("has_ref = 0").groupBy(id_col, F.col("cum").alias("k"))
               .agg(F.sort_array(F.collect_list(F.struct("pos", "paragraph"))).alias("ps"))
               .select(id_col, "k", F.lit(0).alias("kind"), F.array_join("ps.paragraph", " ").alias("comment"),
                       F.array().cast("array<string>").alias("refs")))
    allc = refd.unionByName(islands)
    wo = Window.partitionBy(id_col).orderBy("k", "kind")
    return allc.select(id_col, (F.row_number().over(wo) - 1).cast("int").alias("comment_idx"), "comment", "refs")


def parse_comments_flat(df: DataFrame, id_col: str = "project_id", text_col: str = "text") -> DataFrame:
    """Second processor's form: paragraphs over 10 chars, whitespace collapsed, over 30 chars kept;
    refs and has_section_refs per comment."""
    p = comment_paragraphs(df, id_col, text_col).where(F.length("paragraph") > 10)
    c = p.select(id_col, "pos", py_strip(F.regexp_replace("paragraph", WS + "+", " ")).alias("comment"), "refs")
    return (c.where(F.length("comment") > 30)
            .withColumn("has_section_refs", F.size("refs") > 0))


def quality_filter(comments: DataFrame, sections: DataFrame, key=("review_id", "comment_idx"), project_col: str = "project",
                   min_comment: int = 10, max_comment: int = 5000, min_section: int = 20) -> DataFrame:
    """Declared quality limits: comment length within [10, 5000], and every reference must resolve
    to a section of at least 20 characters in the comment's project.  ``key`` names one comment."""
    key = list(key)
    ok_sections = (sections.where(F.length("section_text") >= min_section)
                   .select(F.col("project").alias(project_col), F.col("section_num").alias("ref")).distinct())
    c = comments.where((F.length("comment") >= min_comment) & (F.length("comment") <= max_comment)
                       & (F.length(F.trim("comment")) > 0))
    refs = c.select(*key, project_col, F.explode("refs").alias("ref"))
    bad = refs.join(ok_sections, [project_col, "ref"], "left_anti").select(*key).distinct()
    return c.join(bad, key, "left_anti")
