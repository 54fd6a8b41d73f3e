"""Quality rules with adaptive thresholds.

Per document: word, symbol, repeated-line and repeated-window counts of the whole text.  Per
(language, source) and measure a quantile sketch: counts in buckets of bounded relative width
(the leading six bits of the value, so 1/32), kept as rows.  Sketches merge by adding counts, in
any order, with the same result; small groups are merged into their language, small languages
into the corpus.  The sketch's quartiles set a fence per group, and the documents are joined with
the fences of their group.

Defined cases: null and empty texts have no words and fail the base rule; null languages and
sources are groups of their own; repeated rows count and come out once each; an empty table gives
no rows; columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from redline.llm.common import WHITE, let, stored, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Groups with fewer documents take the sketch of their language, languages that of the corpus.
MIN_GROUP = 200
FENCE_IQR = 3
#: Measures in thousandths, with the distance beyond the quartile that is always allowed.
SLACK = {"mean_word": 1500, "symbols": 60, "dup_lines": 400, "repeats": 250}


def _repeat_words(ws: Column) -> Column:
    """Words in WINDOW-word windows that occur twice or more in the text, each counted once."""
    n = F.size(ws) - WINDOW + 1
    hashes = let(F.transform(ws, lambda w: F.xxhash64(w)), lambda wh: F.transform(
        F.sequence(F.lit(1), F.size(wh) - WINDOW + 1), lambda i: F.xxhash64(F.slice(wh, i, WINDOW))))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def positions(s):
            def repeated(k):
                own = F.get(s, k)["h"]
                return (own == F.get(s, k - 1)["h"]) | (own == F.get(s, k + 1)["h"])
            return F.sort_array(F.transform(
                F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.coalesce(repeated(k), F.lit(False))),
                lambda k: F.get(s, k)["i"]))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(let(ordered, positions), start,
                           lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")),
                           lambda a: a["n"])
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
    return F.when(n < 2, 0).otherwise(found)


def base_measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  source_col: str = "source") -> DataFrame:
    """(id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words):
    one narrow pass over the texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, WHITE, "") != "")
    per_text = let(words(text), lambda ws: F.struct(F.size(ws).alias("n"), _repeat_words(ws).alias("r")))
    per_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    return (df.select(
        F.col(id_col).alias(id_col), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"),
        per_text.alias("w"), per_lines.alias("l"),
        F.length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"))
        .select(id_col, "lang", "source", F.col("w.n").cast("long").alias("n_words"), "word_chars", "n_symbols",
                F.col("l.n").cast("long").alias("n_lines"),
                (F.col("l.n") - F.col("l.d")).cast("long").alias("n_dup_lines"),
                F.col("w.r").cast("long").alias("n_repeat_words")))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def measures() -> dict[str, Column]:
    """Integer measures in thousandths (documents that pass the base rule have words and lines)."""
    return {"mean_word": F.expr("1000 * word_chars div n_words"),
            "symbols": F.expr("1000 * n_symbols div word_chars"),
            "dup_lines": F.expr("1000 * n_dup_lines div n_lines"),
            "repeats": F.expr("1000 * n_repeat_words div n_words")}


def sketch(df: DataFrame) -> DataFrame:
    """(lang, source, measure, value, n): bucket counts; ``value`` is the bucket's lower end."""
    long = df.select("lang", "source", F.explode(F.create_map(
        *[x for k, c in measures().items() for x in (F.lit(k), c)])).alias("measure", "v"))
    shift = "greatest(length(bin(v)) - 6, 0)"
    return (long.select("lang", "source", "measure", F.expr(f"shiftleft(shiftright(v, {shift}), {shift})").alias("value"))
            .groupBy("lang", "source", "measure", "value").agg(F.count(F.lit(1)).alias("n")))


def _quartiles(sk: DataFrame, keys: list[str]) -> DataFrame:
    """Quartiles of sketches merged to ``keys``; a group has at most some hundred buckets."""
    merged = sk.groupBy(*keys, "measure", "value").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "measure")
    at = merged.select("*", F.sum("n").over(w.orderBy("value")).alias("upto"), F.sum("n").over(w).alias("total"))
    return at.groupBy(*keys, "measure").agg(
        F.first("total").alias("total"),
        F.min(F.when(4 * F.col("upto") >= F.col("total"), F.col("value"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("total"), F.col("value"))).alias("q3"))


def fences(sk: DataFrame) -> DataFrame:
    """(lang, source, <measure>_lo, <measure>_hi) for every group of the sketch."""
    own = _quartiles(sk, ["lang", "source"]).alias("o")
    lang = _quartiles(sk, ["lang"]).alias("g")
    whole = _quartiles(sk, []).alias("a")
    j = (own.join(lang, F.col("o.lang").eqNullSafe(F.col("g.lang")) & (F.col("o.measure") == F.col("g.measure")))
         .join(whole, F.col("o.measure") == F.col("a.measure")))

    def pick(c):
        return (F.when(F.col("o.total") >= MIN_GROUP, F.col(f"o.{c}"))
                .when(F.col("g.total") >= MIN_GROUP, F.col(f"g.{c}")).otherwise(F.col(f"a.{c}")))
    slack = F.create_map(*[F.lit(x) for kv in SLACK.items() for x in kv])[F.col("o.measure")]
    q = j.select(F.col("o.lang").alias("lang"), F.col("o.source").alias("source"), F.col("o.measure").alias("measure"),
                 pick("q1").alias("q1"), pick("q3").alias("q3"), slack.alias("slack"))
    reach = FENCE_IQR * (F.col("q3") - F.col("q1")) + F.col("slack")
    out = []
    for m in SLACK:
        out += [F.max(F.when(F.col("measure") == m, F.col("q1") - reach)).alias(f"{m}_lo"),
                F.max(F.when(F.col("measure") == m, F.col("q3") + reach)).alias(f"{m}_hi")]
    return q.groupBy("lang", "source").agg(*out)


def quality_filter(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                   source_col: str = "source") -> DataFrame:
    """One row per document: its counts, ``base_failed`` and ``kept``.

    ``kept`` needs the base rule and every measure within its group's fence.  The counts are
    stored once; the sketches and the joined filter read them back."""
    m = stored(base_measures(df, id_col, text_col, lang_col, source_col), "quality")
    f = fences(sketch(m.filter(~base_failed())))
    within = F.lit(True)
    for k, c in measures().items():
        within = within & c.between(F.col(f"{k}_lo"), F.col(f"{k}_hi"))
    m, f = m.alias("m"), f.alias("f")
    joined = m.join(f, F.col("m.lang").eqNullSafe(F.col("f.lang")) & F.col("m.source").eqNullSafe(F.col("f.source")), "left")
    failed = base_failed()
    return joined.select(F.col(f"m.{id_col}").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", failed.alias("base_failed"),
                         F.when(failed, F.lit(False)).otherwise(within).alias("kept"))
