"""Training-data loading, format detection, rendering, profiling, split.

Two of these need a *position* in an ordered set (the exact validation split and batch
assignment).  Neither uses a window over a whole group: a group (one language, one file) may
hold a third of all rows.  Both number rows inside buckets of bounded size and add what the
buckets before hold (:func:`sequence_within`, :func:`exact_hash_split`).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redline.functions.text import word_tokens
from redline.operators.text import py_strip

# Fixed values that must equal the reference: length buckets.
LENGTH_BUCKETS = [(100, "0-100"), (500, "100-500"), (1000, "500-1000"), (2000, "1000-2000"), (None, "2000+")]
MIN_TEXT_CHARS = 10
# Rows that one bucket of the exact split holds, about.
SPLIT_BUCKET_ROWS = 50_000


# ---- S4 / L1: loading and format detection ---------------------------------------------------

def load_examples(spark, paths: list[str], fmt: str = "auto") -> DataFrame:
    """Read JSONL / JSON training files into records ``(file, line_no, value)``.

    ``.jsonl``: one record per line; bad JSON and empty values (``{}``, ``[]``, ``null``, ...) are
    skipped.  ``.json``: the whole file is one document; a list gives one record per element,
    ``{"chunks": [...]}`` one ``{"text": ...}`` record per chunk, any other object one record.
    Missing files are skipped; if no file is given an error is raised.  With ``fmt='jsonl'`` or
    ``fmt='json'`` every path (files or folders of part files) is read that way."""
    paths = existing_paths(spark, paths)
    jl = [p for p in paths if (fmt == "jsonl") or (fmt == "auto" and p.endswith(".jsonl"))]
    js = [p for p in paths if (fmt == "json") or (fmt == "auto" and p.endswith(".json"))]
    parts = []
    empty = ["{}", "[]", "null", "false", "0", '""']
    if jl:
        t = (spark.read.option("ignoreMissingFiles", "true").text(jl)
             .select(F.input_file_name().alias("file"), F.col("value")))
        # Position of a line within its file: ids increase with the byte offset inside a file.
        t = t.withColumn("line_no", F.monotonically_increasing_id())
        v = F.try_parse_json(F.col("value"))
        t = t.where(v.isNotNull() & ~F.to_json(v).isin(*empty))
        parts.append(t.select("file", "line_no", "value"))
    if js:
        w = (spark.read.option("wholetext", "true").option("ignoreMissingFiles", "true").text(js)
             .select(F.input_file_name().alias("file"), F.try_parse_json("value").alias("v")))
        as_list = F.expr("try_variant_get(v, '$', 'array<variant>')")
        chunks = F.expr("try_variant_get(v, '$.chunks', 'array<variant>')")
        recs = (F.when(as_list.isNotNull(), F.transform(as_list, lambda x: F.to_json(x)))
                .when(chunks.isNotNull(), F.transform(chunks, lambda c: F.to_json(F.struct(
                    F.try_variant_get(c, "$.text", "string").alias("text")))))
                .otherwise(F.array(F.to_json("v"))))
        parts.append(w.where(F.col("v").isNotNull())
                     .select("file", F.posexplode(recs).alias("line_no", "value"))
                     .withColumn("line_no", F.col("line_no").cast("bigint")))
    if not parts:
        raise ValueError("no dataset file could be loaded")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def existing_paths(spark, paths: list[str]) -> list[str]:
    """The given paths (or glob patterns) that exist, checked through the cluster file system."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        st = hp.getFileSystem(conf).globStatus(hp)
        if st is not None and len(st) > 0:
            out.append(p)
    return out


def record_flags(records: DataFrame) -> DataFrame:
    """Adds has_messages / has_instruction_output / has_text flags from the JSON record."""
    def has(path):
        return F.expr(f"try_variant_get(try_parse_json(value), '{path}', 'variant')").isNotNull()
    return records.select("*", has("$.messages").alias("has_messages"),
                          (has("$.instruction") & has("$.output")).alias("has_instruction_output"),
                          has("$.text").alias("has_text"))


def detect_format(records: DataFrame, file_col: str = "file", line_col: str = "line_no") -> DataFrame:
    """Per file, from its first record: messages -> 'chat', instruction+output -> 'instruction',
    else 'text'.  ``min_by`` is a partial aggregate: no file is sorted in one task."""
    f = record_flags(records)
    first = f.groupBy(file_col).agg(F.min_by(F.struct("has_messages", "has_instruction_output"),
                                             F.col(line_col)).alias("first"))
    fmt = (F.when(F.col("first.has_messages"), "chat")
           .when(F.col("first.has_instruction_output"), "instruction").otherwise("text"))
    return first.select(file_col, fmt.alias("format"))


# ---- L2-L5: renderers ---------------------------------------------------------------------------

def render_chat(messages) -> Column:
    """Default chat template: system content, ``### Human:`` / ``### Assistant:`` turns, each
    followed by a blank line; other roles dropped."""
    m = F.col(messages) if isinstance(messages, str) else messages
    parts = F.transform(m, lambda x: F.when(x["role"] == "system", F.concat(x["content"], F.lit("\n\n")))
                        .when(x["role"] == "user", F.concat(F.lit("### Human: "), x["content"], F.lit("\n\n")))
                        .when(x["role"] == "assistant", F.concat(F.lit("### Assistant: "), x["content"], F.lit("\n\n"))))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull()), "")


def render_chat_manual(messages) -> Column:
    """Fallback: ``System:`` / ``Human:`` / ``Assistant:`` lines joined by a blank line."""
    m = F.col(messages) if isinstance(messages, str) else messages
    parts = F.transform(m, lambda x: F.when(x["role"] == "system", F.concat(F.lit("System: "), F.coalesce(x["content"], F.lit(""))))
                        .when(x["role"] == "user", F.concat(F.lit("Human: "), F.coalesce(x["content"], F.lit(""))))
                        .when(x["role"] == "assistant", F.concat(F.lit("Assistant: "), F.coalesce(x["content"], F.lit("")))))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull()), "\n\n")


def render_instruction(df: DataFrame) -> DataFrame:
    """Instruction records: need instruction and output; Input block only when input is non-empty."""
    i, x, o = F.col("instruction"), F.coalesce(F.col("input"), F.lit("")), F.col("output")
    text = F.when(x != "", F.concat(F.lit("### Instruction:\n"), i, F.lit("\n\n### Input:\n"), x,
                                    F.lit("\n\n### Response:\n"), o)) \
        .otherwise(F.concat(F.lit("### Instruction:\n"), i, F.lit("\n\n### Response:\n"), o))
    ok = i.isNotNull() & (i != "") & o.isNotNull() & (o != "")
    return df.where(ok).withColumn("text", text).withColumn("format", F.lit("instruction"))


def normalize_text(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Plain text records: stripped; dropped when the stripped text is shorter than 10 chars."""
    s = py_strip(F.col(text_col))
    return df.where(F.col(text_col).isNotNull() & (F.length(s) >= MIN_TEXT_CHARS)) \
        .withColumn(text_col, s).withColumn("format", F.lit("text"))


# ---- L7 / L8: profiling -------------------------------------------------------------------------

def dataset_stats(df: DataFrame, text_col: str = "text") -> DataFrame:
    """grouping sets ((), (format)): count, mean/min/max length; percentage of the total on the
    per-format rows.  The percentage window runs over the handful of aggregated rows only."""
    g = (df.withColumn("_len", F.length(text_col))
         .groupingSets([[], ["format"]], "format")
         .agg(F.count(F.lit(1)).cast("bigint").alias("n"), F.round(F.avg("_len"), 6).alias("avg_length"),
              F.min("_len").cast("bigint").alias("min_length"), F.max("_len").cast("bigint").alias("max_length"),
              F.grouping("format").alias("_g")))
    total = F.max(F.when(F.col("_g") == 1, F.col("n"))).over(Window.partitionBy(F.lit(0)))
    return g.select("format", "n", "avg_length", "min_length", "max_length",
                    F.round(F.col("n") * 100.0 / total, 6).alias("pct"))


def length_bucket(len_col: Column) -> Column:
    out = None
    for bound, label in LENGTH_BUCKETS:
        if bound is None:
            out = out.otherwise(F.lit(label))
        else:
            out = (F.when(len_col <= bound, F.lit(label)) if out is None
                   else out.when(len_col <= bound, F.lit(label)))
    return out


def length_histogram(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Count per length bucket (all five buckets, zero kept) and percentage of the total."""
    spark = df.sparkSession
    buckets = spark.createDataFrame([(i, label) for i, (_, label) in enumerate(LENGTH_BUCKETS)],
                                    "bucket_order int, bucket string")
    counts = df.groupBy(length_bucket(F.length(text_col)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    j = buckets.join(F.broadcast(counts), "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return j.select("bucket_order", "bucket", "n",
                    F.round(F.when(total > 0, F.col("n") * 100.0 / total).otherwise(F.lit(0.0)), 6).alias("pct"))


# ---- L9: exact reproducible split ---------------------------------------------------------------

def _hash_bits(key: Column, seed: int) -> Column:
    """60-bit unsigned rank of md5(seed || ':' || key) (first 15 hex digits)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 15), 16, 10).cast("bigint")


def exact_hash_split(df: DataFrame, key_col: str, frac: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds `split` ('validation' / 'train'): validation = the ceil(frac * n) rows with the smallest
    (md5(seed:key), key); `key_col` must be unique.

    Rows are dealt to buckets by the hash's leading bits, one distributed aggregate counts them and
    a running sum over the bucket counts gives each bucket the number of its validation rows; rows
    are ordered inside their bucket only (about BUCKET rows each)."""
    h = df.withColumn("_h", _hash_bits(F.col(key_col), seed))
    n = df.count()
    need = math.ceil(frac * n) if frac > 0 else 0
    bits = min(40, max(0, (n // SPLIT_BUCKET_ROWS).bit_length()))
    h = h.withColumn("_b", F.shiftright("_h", 60 - bits))
    counts = h.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    # Two levels, so that no window holds all buckets: parts of 2^12 buckets, then buckets.
    counts = counts.withColumn("_p", F.shiftright("_b", 12))
    parts = counts.groupBy("_p").agg(F.sum("_n").alias("_pn"))
    over_parts = parts.withColumn("_before", F.coalesce(F.sum("_pn").over(
        Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_pn")
    inside = Window.partitionBy("_p").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    take = (counts.join(over_parts, "_p")
            .select(F.col("_b").alias("_tb"),
                    (F.lit(need) - F.col("_before") - F.coalesce(F.sum("_n").over(inside), F.lit(0))).alias("_take")))
    ranked = h.withColumn("_rn", F.row_number().over(Window.partitionBy("_b").orderBy("_h", key_col)))
    return (ranked.join(take, F.col("_b") == F.col("_tb"))
            .withColumn("split", F.when(F.col("_rn") <= F.col("_take"), "validation").otherwise("train"))
            .drop("_h", "_b", "_tb", "_rn", "_take"))


# ---- L10-L12 ------------------------------------------------------------------------------------

def truncate_tokens(df: DataFrame, text_col: str = "text", max_length: int = 512) -> DataFrame:
    """Whitespace-token truncation: input tokens cut to max_length; labels are a copy."""
    toks = F.slice(word_tokens(text_col), 1, max_length)
    return df.withColumn("input_tokens", toks).withColumn("labels", F.col("input_tokens")) \
        .withColumn("n_tokens", F.size("input_tokens").cast("bigint"))


SEQUENCE_BUCKET_ROWS = 250_000
#: At most so many cut points, each from so many sampled rows.
MAX_CUTS, SAMPLES_PER_CUT = 1024, 64


def cut_points(df: DataFrame, order_cols: list, n: int, steps: int) -> Column:
    """Up to ``steps`` - 1 values of (order_cols) that cut the rows into parts of about equal number, as a
    sorted array of literals: quantiles of rows sampled by the hash of their values, so the same rows always
    give the same cuts.  About MAX_CUTS * SAMPLES_PER_CUT values at most meet in one task."""
    every = max(1, n // (steps * SAMPLES_PER_CUT))
    key = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order_cols)])
    some = df.where(F.pmod(F.xxhash64(*order_cols), F.lit(every)) == 0).agg(F.sort_array(F.collect_list(key)).alias("s"))
    at = F.transform(F.sequence(F.lit(1), F.lit(steps - 1)), lambda j: F.floor(j * F.size("s") / steps).cast("int"))
    cuts = F.transform(at, lambda i: F.get("s", i))
    found = some.select(F.array_distinct(F.array_compact(cuts)).alias("c")).first()["c"]
    types = [df.schema[c].dataType for c in order_cols]
    return F.array(*[F.struct(*[F.lit(v).cast(t).alias(f"o{i}") for i, (v, t) in enumerate(zip(cut, types, strict=True))])
                     for cut in found])


def cut_bucket(cuts: Column, order_cols: list, steps: int) -> Column:
    """The number of cuts that are not above the row's values, by binary search in the row."""
    key = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order_cols)])
    halves = [1 << k for k in reversed(range(steps.bit_length()))]
    return F.aggregate(F.array(*[F.lit(h) for h in halves]), F.lit(0), lambda lo, h: F.when(
        (lo + h <= F.size(cuts)) & (F.get(cuts, lo + h - 1) <= key), lo + h).otherwise(lo))


def sequence_within(df: DataFrame, group_cols: list, order_cols: list, name: str = "seq",
                    bucket_rows: int = SEQUENCE_BUCKET_ROWS) -> DataFrame:
    """0-based position of each row within its group in (order_cols) order, without a window over
    the whole group.

    Rows are dealt to buckets between cut points of the order columns, whatever their types (nulls
    first): a row's bucket follows from its values and the table's, nothing depends on partition ids.
    Cuts follow the data, so long common prefixes and skewed numbers spread over all buckets.  Rows
    are numbered inside (group, bucket) and the bucket's first position comes from the (group, bucket)
    counts; a hot group spreads over its buckets.  All columns pass through; (group, order) must be
    unique."""
    n = df.count()
    steps = min(MAX_CUTS, max(1, -(-n // bucket_rows)))
    if steps == 1:
        w = Window.partitionBy(*group_cols).orderBy(*order_cols)
        return df.withColumn(name, (F.row_number().over(w) - 1).cast("bigint"))
    b = df.withColumn("_b", cut_bucket(cut_points(df, order_cols, n, steps), order_cols, steps))
    keys = [f"_g{i}" for i in range(len(group_cols))]
    counts = b.groupBy(*group_cols, "_b").agg(F.count(F.lit(1)).alias("_n")).toDF(*keys, "_ob", "_n")
    before = Window.partitionBy(*keys).orderBy("_ob").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*group_cols, "_b").orderBy(*order_cols)
    on = F.col("_b") == F.col("_ob")
    for g, k in zip(group_cols, keys, strict=True):
        on = on & F.col(g).eqNullSafe(F.col(k))
    return (b.withColumn("_rn", F.row_number().over(inside)).join(offs, on)
            .withColumn(name, (F.col("_off") + F.col("_rn") - 1).cast("bigint"))
            .drop("_b", "_rn", "_ob", "_off", *keys))


def pad_plan(df: DataFrame, length_col: str, group_cols: list, order_cols: list, batch_size: int = 8,
             multiple: int = 8) -> DataFrame:
    """Batches of `batch_size` in order within each group; padded length = batch max rounded up to
    a multiple of 8; padding = padded * rows - sum(lengths).  (group, order) must be unique."""
    keys = list(group_cols) + list(order_cols)
    seq = sequence_within(df.select(*keys, length_col), group_cols, order_cols)
    b = seq.withColumn("batch", F.floor(F.col("seq") / batch_size).cast("bigint"))
    g = b.groupBy(*group_cols, "batch").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                                           F.max(length_col).cast("bigint").alias("max_length"),
                                           F.sum(length_col).cast("bigint").alias("total_length"))
    padded = (F.ceil(F.col("max_length") / multiple) * multiple).cast("bigint")
    return g.select(*group_cols, "batch", "n_rows", "max_length", padded.alias("padded_length"),
                    (padded * F.col("n_rows") - F.col("total_length")).cast("bigint").alias("padding"))
