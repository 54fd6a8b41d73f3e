"""Text cleaning, chunking, line statistics, page extraction.

Chunking is sequential *within* a document (each window's start depends on where the previous
one was cut) but independent across documents, so it runs as a per-row fold: ``aggregate`` over
a bounded ``sequence`` computes the (start, end) boundaries JVM-side, then ``posexplode`` emits
one row per chunk.  Documents are the unit of parallelism; no shuffle is involved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redline.functions.text import WS, WS_CHARS, clean_text  # noqa: F401  (re-export)

# Fixed values that must equal the reference: chunk window, overlap, and how far back a
# sentence end is searched.
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
LOOKBACK = 100


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``: trim Unicode whitespace at both ends (``btrim`` with the character
    set, no regex)."""
    return F.btrim(c, F.lit(WS_CHARS))


CHUNK_BLOCK = 64   # windows per inner fold (see chunk_windows_expr)


def _text_slice(blk: str, start1: str, length: str, seg: int) -> str:
    """SQL for substring(text, start1, length) read from the text's fixed-size segments `blk`
    (length <= seg): at most two adjacent segments are touched, so the cost does not grow with the
    position (a plain substring on UTF-8 walks from the start of the string)."""
    i0 = f"(({start1}) - 1) div {seg}"
    off = f"((({start1}) - 1) % {seg})"
    two = f"concat(get({blk}, CAST({i0} AS INT)), coalesce(get({blk}, CAST({i0} + 1 AS INT)), ''))"
    return f"substring({two}, {off} + 1, {length})"


def chunk_windows_expr(text_col: str, size: int, overlap: int, block: int = CHUNK_BLOCK) -> Column:
    """Array of chunk strings (stripped, empties dropped) of the reference's chunker for texts
    longer than `size`.

    * The text is cut once into code-point segments; every window and chunk is read from at most
      two segments, so each step costs O(segment) instead of O(position).
    * Windows are walked by a two-level fold: the inner ``aggregate`` produces up to `block`
      windows as one small array, the outer ``aggregate`` keeps the position and collects the
      blocks by reference (an array append copies the array, so one flat fold would be O(k^2)).
    The segments ride in the accumulator, so they are computed once per document."""
    if overlap >= size - 98 or overlap < 0 or size <= 0:
        # The reference loop may never terminate for these settings; refuse them.
        raise ValueError("chunk overlap must be >= 0 and < size - 98")
    min_step = size - 98 - overlap
    seg = max(4096, size + LOOKBACK + 2)
    t = text_col
    e0 = f"(st.s + {size})"
    lo = f"greatest(st.s + {size - LOOKBACK}, st.s)"
    window = _text_slice("acc.blk", f"{lo} + 2", f"{e0} - {lo}", seg)
    last = f"length(regexp_extract({window}, '(?s)^.*[.!?]', 0))"
    e = f"(CASE WHEN {e0} < acc.n AND {last} > 0 THEN {lo} + 1 + {last} ELSE {e0} END)"
    inner_step = (f"CASE WHEN st.done THEN st ELSE named_struct('s', {e} - {overlap}, "
                  f"'done', {e} - {overlap} >= acc.n, "
                  f"'b', array_append(st.b, named_struct('s', st.s, 'e', {e}))) END")
    inner = (f"aggregate(sequence(1, {block}), "
             f"named_struct('s', acc.s, 'done', acc.done, 'b', CAST(array() AS ARRAY<STRUCT<s: INT, e: INT>>)), "
             f"(st, j) -> {inner_step})")
    # `blk` binds the inner fold's result with a one-element transform, so it runs once per step.
    outer_step = (f"CASE WHEN acc.done THEN acc ELSE transform(array({inner}), r -> "
                  f"named_struct('s', r.s, 'n', acc.n, 'done', r.done, 'blk', acc.blk, "
                  f"'blocks', array_append(acc.blocks, r.b)))[0] END")
    piece = _text_slice("acc.blk", "w.s + 1", "w.e - w.s", seg)
    strip = f"btrim({piece}, {_ws_literal()})"
    finish = f"acc -> filter(transform(flatten(acc.blocks), w -> {strip}), c -> c <> '')"
    sql = (f"aggregate(sequence(1, CAST(length({t}) / {min_step} / {block} AS INT) + 2), "
           f"named_struct('s', 0, 'n', length({t}), 'done', false, "
           f"'blk', regexp_extract_all({t}, '(?s).{{1,{seg}}}', 0), "
           f"'blocks', CAST(array() AS ARRAY<ARRAY<STRUCT<s: INT, e: INT>>>)), "
           f"(acc, k) -> {outer_step}, {finish})")
    return F.expr(sql)


def _ws_literal() -> str:
    """WS_CHARS as a SQL string literal (unicode escapes, no quoting issues)."""
    return "'" + "".join(f"\\u{ord(c):04x}" for c in WS_CHARS) + "'"


def chunk_array(text_col: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                block: int = CHUNK_BLOCK) -> Column:
    t = F.col(text_col)
    return (F.when(t.isNull(), F.lit(None))
            .when(F.length(t) <= size, F.array(t))
            .otherwise(chunk_windows_expr(text_col, size, overlap, block)))


def chunk_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK_SIZE,
               overlap: int = CHUNK_OVERLAP, keep: tuple = (), block: int = CHUNK_BLOCK) -> DataFrame:
    """One row per chunk: (id, index, text, length) [+ keep columns]."""
    out = df.select(F.col(id_col), *keep,
                    F.posexplode(chunk_array(text_col, size, overlap, block)).alias("index", "chunk"))
    return out.select(id_col, *keep, F.col("index").cast("int").alias("index"), F.col("chunk").alias("text"),
                      F.length("chunk").cast("int").alias("length"))


def chunk_training_rows(chunks: DataFrame, id_col: str = "doc_id", source_col: str = "filename") -> DataFrame:
    """Chunk -> training record {text, source, chunk_id}; the id is deterministic."""
    cid = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.col("index").cast("string")))
    return chunks.select(F.col(id_col), "index", "text", F.col(source_col).alias("source"), cid.alias("chunk_id"))


def chunk_preview(chunks: DataFrame, k: int = 5) -> DataFrame:
    """First k chunks of every document (chunk index is already a per-document sequence)."""
    return chunks.where(F.col("index") < k)


def processed_listing(chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One summary row per processed document."""
    return chunks.groupBy(id_col, "filename").agg(
        F.count(F.lit(1)).cast("bigint").alias("total_chunks"),
        F.sum("length").cast("bigint").alias("total_chunk_chars"),
        F.max("processed_at").alias("processed_at"))


def line_stats(df: DataFrame, text_col: str = "text", preview_lines: int = 5, line_cut: int = 100,
               preview_chars: int = 500) -> DataFrame:
    """Line summary of an extracted text: total lines, non-empty lines, mean stripped length of the
    non-empty lines (0 if none), the first non-empty lines cut at 100 chars + '...', a preview."""
    lines = F.split(F.col(text_col), "\n")
    ne = F.filter(F.transform(lines, lambda x: py_strip(x)), lambda x: x != "")
    total_len = F.aggregate(ne, F.lit(0).cast("bigint"), lambda acc, x: acc + F.length(x))
    cut = F.transform(F.slice(ne, 1, preview_lines),
                      lambda x: F.when(F.length(x) > line_cut, F.concat(F.substring(x, 1, line_cut), F.lit("...")))
                      .otherwise(x))
    return df.select(
        "*",
        F.size(lines).cast("bigint").alias("total_lines"),
        F.size(ne).cast("bigint").alias("non_empty_lines"),
        F.round(F.when(F.size(ne) > 0, total_len / F.size(ne)).otherwise(F.lit(0.0)), 6).alias("avg_line_length"),
        F.array_join(cut, "\n").alias("first_lines"),
        F.substring(py_strip(F.col(text_col)), 1, preview_chars).alias("preview"),
    )


def text_extraction_status(files: DataFrame) -> DataFrame:
    """Upload reply fields: text_extracted, text_length (0 when none), firm label default 'N.A.'."""
    t = F.col("extracted_text")
    return files.select(
        "id", "filename",
        (t.isNotNull() & (t != "")).alias("text_extracted"),
        F.when(t.isNull() | (t == ""), F.lit(0)).otherwise(F.length(t)).cast("bigint").alias("text_length"),
        F.col("law_firm_id"),
        F.coalesce(F.col("law_firm_name"), F.lit("N.A.")).alias("law_firm_name"))


# ---- S3: markup pages -> plain text with page markers ------------------------------------------

# Entity replacements, '&amp;' last so '&amp;lt;' stays '&lt;'.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def html_to_text(c: Column) -> Column:
    s = F.regexp_replace(c, r"(?is)<script\b.*?</script>", " ")
    s = F.regexp_replace(s, r"(?is)<style\b.*?</style>", " ")
    s = F.regexp_replace(s, r"(?s)<!--.*?-->", " ")
    s = F.regexp_replace(s, r"<[^>]*>", " ")
    for a, b in ENTITIES:
        s = F.replace(s, F.lit(a), F.lit(b))
    s = F.regexp_replace(s, WS + "+", " ")
    return py_strip(s)


def page_text(pages: DataFrame) -> DataFrame:
    """Per page: document url (query/fragment removed), page number (``page=`` parameter, default
    1), plain text, and the text with its ``--- Page n ---`` marker."""
    page_no = F.coalesce(F.regexp_extract("url", r"[?&]page=([0-9]+)", 1).try_cast("int"), F.lit(1))
    txt = html_to_text(F.col("html"))
    return pages.select(
        "page_id",
        F.regexp_replace("url", r"[?#].*$", "").alias("doc_url"),
        page_no.alias("page_no"),
        txt.alias("text")).withColumn(
        "marked", F.concat(F.lit("\n--- Page "), F.col("page_no").cast("string"), F.lit(" ---\n"), F.col("text"),
                           F.lit("\n")))


def assemble_pages(pages_text: DataFrame) -> DataFrame:
    """Concatenate marked pages per document in page order.  The group is one document's pages,
    which is bounded by the document's page count, not by the corpus."""
    return (pages_text.groupBy("doc_url")
            .agg(F.sort_array(F.collect_list(F.struct("page_no", "page_id", "marked"))).alias("p"),
                 F.count(F.lit(1)).cast("bigint").alias("total_pages"))
            .select("doc_url", "total_pages", F.array_join("p.marked", "").alias("text")))
