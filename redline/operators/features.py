"""Text features (F1-F11): statistics, linguistic ratios, tokens, n-grams, counts, TF-IDF, PCA/SVD.

Term features are sparse.  Texts are tokenised once; n-grams are counted in runs of documents over
Arrow arrays, so that what is shuffled are sums per run, never n-grams per document.  The vocabulary is
a top-k over summed counts; longer n-grams are counted only where all their words are frequent enough
to be in it.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from redline.functions.stopwords import ENGLISH
from redline.functions.text import WS, word_tokens
from redline.operators.text import py_strip
from redline.session import materialize, ship_package

WS_INNER = WS[1:-1]
# Fixed values of the reference's readability formula.
FLESCH = (206.835, 1.015, 84.6)
SENTENCE_SPLIT = "[.!?]+(?:" + WS + r"+|\z)"
TOKEN_RX = r"[\p{L}\p{N}_]{2,}"


def default_stop_words() -> tuple:
    """The package's English list; a parameter everywhere."""
    return ENGLISH


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- F1 / F2 ----------------------------------------------------------------------------------

def sentence_count(text) -> Column:
    """Our sentence rule: pieces between terminator runs ('.', '!', '?') followed by whitespace or
    the end; pieces with only whitespace do not count."""
    return F.size(F.filter(F.split(_c(text), SENTENCE_SPLIT), lambda x: py_strip(x) != ""))


def stat_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """chars, words, sentences, mean word length, words per sentence, Flesch (vowel letters as
    syllables), lexical diversity (distinct words / words, case-sensitive); zeros when empty."""
    words = word_tokens(text_col)
    t = df.select("*", words.alias("_w"), sentence_count(text_col).alias("_s"))
    wc = F.size("_w")
    avg_wl = F.when(wc > 0, F.aggregate("_w", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)) / wc).otherwise(0.0)
    avg_sl = F.when(F.col("_s") > 0, wc / F.col("_s")).otherwise(0.0)
    syl = F.regexp_count(_c(text_col), F.lit("[aeiouAEIOU]"))
    flesch = F.when(wc > 0, F.lit(FLESCH[0]) - F.lit(FLESCH[1]) * avg_sl - F.lit(FLESCH[2]) * (syl / wc)).otherwise(0.0)
    lex = F.when(wc > 0, F.size(F.array_distinct("_w")) / wc).otherwise(0.0)
    return t.select(*[c for c in df.columns if c != text_col],
                    F.length(text_col).cast("bigint").alias("char_count"), wc.cast("bigint").alias("word_count"),
                    F.col("_s").cast("bigint").alias("sentence_count"),
                    F.round(avg_wl, 6).alias("avg_word_length"), F.round(avg_sl, 6).alias("avg_sentence_length"),
                    F.round(flesch, 6).alias("flesch_score"), F.round(lex, 6).alias("lexical_diversity"))


def ling_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """capitalised words / words (0 when no words); punctuation chars / chars (0 when empty)."""
    words = word_tokens(text_col)
    wc = F.size(words)
    caps = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    punct = F.regexp_count(_c(text_col), F.lit(r"[^\p{L}\p{N}_" + WS_INNER + "]"))
    n = F.length(text_col)
    return df.select(*[c for c in df.columns if c != text_col],
                     F.round(F.when(wc > 0, caps / wc).otherwise(0.0), 6).alias("capitalized_ratio"),
                     F.round(F.when(n > 0, punct / n).otherwise(0.0), 6).alias("punctuation_ratio"))


# ---- F3 / F4 / F5 -------------------------------------------------------------------------------

def remove_stop_words(df: DataFrame, in_col: str, out_col: str, stop_words=None) -> DataFrame:
    """Spark ML StopWordsRemover (JVM-side, case-insensitive)."""
    r = StopWordsRemover(inputCol=in_col, outputCol=out_col,
                         stopWords=list(stop_words if stop_words is not None else default_stop_words()))
    return r.transform(df)


def preprocess(df: DataFrame, text_col: str = "text", stop_words=None) -> DataFrame:
    """lower-case, drop every char that is not an ASCII letter or whitespace, whitespace tokens,
    stop words removed -> `tokens` array and the space-joined `processed` text."""
    # Looked at first, letters and blanks never meet the long class.
    cleaned = F.regexp_replace(F.lower(F.coalesce(text_col, F.lit(""))), "(?:(?![a-zA-Z \\n])[^" + WS_INNER + "])+", "")
    t = df.withColumn("_raw", word_tokens(cleaned))
    t = remove_stop_words(t, "_raw", "tokens", stop_words).drop("_raw")
    return t.withColumn("processed", F.array_join("tokens", " "))


#: Documents are worked on in runs of about so many bytes of tokens, or so many tokens.
RUN_BYTES = 2 << 20
RUN_TOKENS = 200_000


def _byte_ends(batch):
    """Running sum of the bytes of the second column's strings."""
    return np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)


def _token_ends(batch):
    """Running sum of the tokens in the second column's arrays of arrays."""
    sizes = pc.list_value_length(batch.column(1).flatten()).to_numpy(zero_copy_only=False)
    held = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])
    return held[np.cumsum(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))]


def _runs(batches, ends_of, most: int):
    """The batches cut into runs of rows of about ``most`` bytes or tokens (one row at least)."""
    for batch in batches:
        ends, a, done = ends_of(batch), 0, 0
        while a < len(ends):
            b = max(a + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(a, b - a)
            a, done = b, int(ends[b - 1])


#: A dictionary of at most so many bytes goes to the tokens, a larger one meets them in a shuffle.
SMALL_DICTIONARY = 16 << 20


def _lemmas(docs, found):
    """Lemmas of each row's token arrays: each token's dictionary forms, or itself; arrays of one id are
    merged by position and form."""
    for arrays, entries in zip(docs, found):
        forms: dict = {}
        for e in entries:
            forms.setdefault(e["token"], []).append(e["token"] if e["lemma"] is None else e["lemma"])
        if len(arrays) == 1 and all(len(f) == 1 for f in forms.values()):
            one = {t: f[0] for t, f in forms.items()}
            yield [one.get(t, t) for t in arrays[0]]
        else:
            all_ = [(i, x) for a in arrays for i, t in enumerate(a) for x in forms.get(t, (t,))]
            yield [x for _, x in sorted(all_, key=lambda p: (p[0], p[1] is not None, p[1] or ""))]


def lemma_map(tokens_df: DataFrame, dictionary: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """Replace each token by its dictionary form (dictionary: token, lemma); unknown tokens stay.
    A document's distinct tokens meet the dictionary; what was found joins the document's row, where
    the tokens are mapped in order."""
    ship_package(tokens_df.sparkSession)
    entries = materialize(dictionary.select("token", "lemma"))
    size = entries.agg(F.sum(F.octet_length("token") + F.coalesce(F.octet_length("lemma"), F.lit(0)) + 16)).first()[0] or 0
    if size <= SMALL_DICTIONARY:
        entries = F.broadcast(entries)
    kind = "struct<token:string,lemma:string>"
    hits = (tokens_df.select(id_col, F.explode(F.array_distinct(tokens_col)).alias("token")).join(entries, "token")
            .select(id_col, F.lit(None).cast("array<string>").alias("_d"), F.struct("token", "lemma").cast(kind).alias("_e")))
    docs = tokens_df.where(F.size(tokens_col) > 0).select(id_col, F.col(tokens_col).alias("_d"), F.lit(None).cast(kind).alias("_e"))
    # Of repeated rows the same entry is found more than once.
    g = docs.unionByName(hits).groupBy(id_col).agg(F.collect_list("_d").alias("_d"), F.array_distinct(F.collect_list("_e")).alias("_e"))
    schema = StructType([g.schema[id_col], StructField("lemmas", ArrayType(StringType()))])

    run_tokens = RUN_TOKENS

    def mapped(batches):
        for b in _runs(batches, _token_ends, run_tokens):
            out = pa.array(_lemmas(b.column(1).to_pylist(), b.column(2).to_pylist()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), out], names=schema.names)
    return g.mapInArrow(mapped, schema)


def plural_dictionary(tokens_df: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """A dictionary derived from the corpus vocabulary: a token ending in 's' maps to the token
    without it when that form also occurs."""
    vocab = tokens_df.select(F.explode(tokens_col).alias("token")).distinct()
    plural = vocab.where(F.col("token").endswith("s") & (F.length("token") > 2)) \
        .withColumn("lemma", F.expr("substring(token, 1, length(token) - 1)"))
    return plural.join(vocab.withColumnRenamed("token", "lemma"), "lemma", "left_semi")


def analyzer_tokens(text) -> Column:
    """Vectoriser tokens: lower-cased runs of 2+ word characters."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(TOKEN_RX), F.lit(0))


def term_arrays(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lo: int = 1, hi: int = 2,
                stop_words=None) -> DataFrame:
    """(id, terms): the word n-grams (lo..hi) of each text after stop-word removal.  n >= 2 uses Spark
    ML's compiled NGram transformer."""
    from pyspark.ml.feature import NGram
    t = remove_stop_words(df.select(id_col, analyzer_tokens(F.coalesce(text_col, F.lit(""))).alias("_tok")), "_tok", "_t", stop_words)
    cols = []
    for n in range(lo, hi + 1):
        if n == 1:
            cols.append(F.col("_t"))
        else:
            t = NGram(n=n, inputCol="_t", outputCol=f"_g{n}").transform(t)
            cols.append(F.col(f"_g{n}"))
    return t.select(id_col, F.concat(*cols).alias("terms"))


def _grams(batch, stop: set, lo: int, hi: int, within=None):
    """Per n from lo to hi: (row of each n-gram, its number, the n-grams by number) of a batch whose second
    column holds blank-joined tokens.  ``within``: longer n-grams count only if they hold no other words."""
    lists = pc.split_pattern(pc.fill_null(batch.column(1), ""), " ")
    words = lists.flatten().dictionary_encode()
    rows = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    names, at = words.dictionary, words.indices.to_numpy(zero_copy_only=False)
    dropped = pc.or_(pc.equal(names, ""), pc.is_in(names, pa.array(sorted(stop), pa.string())))
    keep = ~dropped.to_numpy(zero_copy_only=False)[at] if len(at) else np.zeros(0, bool)
    rows, at = rows[keep], at[keep]
    known = None if within is None else pc.is_in(names, within).to_numpy(zero_copy_only=False)
    gram, grams, fits = at, names, np.ones(len(at), bool) if known is None else known[at]
    for n in range(1, hi + 1):
        if n > 1:
            # The n-gram at i is the (n-1)-gram there and the word n-1 places on, in the same row.
            ok = fits[:-1] & (rows[:len(gram) - 1] == rows[n - 1:])
            if known is not None:
                ok &= known[at[n - 1:]]
            code, pairs = pd.factorize(np.where(ok, gram[:-1].astype(np.int64) * max(len(names), 1) + at[n - 1:], -1))
            pairs = np.maximum(pairs, 0)
            grams = pc.binary_join_element_wise(grams.take(pa.array(pairs // max(len(names), 1))),
                                                names.take(pa.array(pairs % max(len(names), 1))), " ")
            gram, fits = code, ok
        if n >= lo:
            here = slice(None) if n == 1 else fits
            yield n, rows[:len(gram)][here], gram[here], grams
        if len(gram) == 0:
            break


def _stop_set(stop_words) -> set:
    """Tokens are lower-cased, so are the stop words."""
    return {w.lower() for w in (stop_words if stop_words is not None else default_stop_words())}


def _joined_tokens(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, vectoriser tokens joined by blanks)"""
    ship_package(df.sparkSession)
    return df.select(id_col, F.array_join(analyzer_tokens(F.coalesce(text_col, F.lit(""))), " ").alias("_t"))


def _row_counts(tokens: DataFrame, lo: int, hi: int, stop: set) -> DataFrame:
    """(id, term, n): the n-grams of each row counted within it."""
    schema = StructType([tokens.schema[0], StructField("term", StringType()), StructField("n", LongType())])
    run_bytes = RUN_BYTES

    def count(batches):
        for run in _runs(batches, _byte_ends, run_bytes):
            for _, rows, gram, grams in _grams(run, stop, lo, hi):
                keys, n = np.unique(rows * max(len(grams), 1) + gram, return_counts=True)
                ids = run.column(0).take(pa.array(keys // max(len(grams), 1)))
                yield pa.RecordBatch.from_arrays([ids, grams.take(pa.array(keys % max(len(grams), 1))), pa.array(n, pa.int64())],
                                                 names=schema.names)
    return tokens.mapInArrow(count, schema)


def ngrams(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lo: int = 1, hi: int = 2,
           stop_words=None, counted: bool = False) -> DataFrame:
    """Word n-grams (lo..hi) after stop-word removal, as rows (id, term); ``counted``: one row
    (id, term, n) per id and term.

    Counts are made within a document's row; only rows whose id comes more than once (or is null) are
    summed by a shuffle."""
    if not counted:
        return term_arrays(df, id_col, text_col, lo, hi, stop_words).select(id_col, F.explode("terms").alias("term"))
    stop = _stop_set(stop_words)
    tokens = _joined_tokens(df, id_col, text_col)
    again = materialize(df.groupBy(F.col(id_col).alias("_again")).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("_again"))
    if again.isEmpty():
        return _row_counts(tokens, lo, hi, stop)
    same = F.col(id_col).eqNullSafe(F.col("_again"))
    alone = _row_counts(tokens.join(again, same, "left_anti"), lo, hi, stop)
    summed = _row_counts(tokens.join(again, same, "left_semi"), lo, hi, stop).groupBy(id_col, "term").agg(F.sum("n").alias("n"))
    return alone.unionByName(summed)


# ---- F6 / F7 / F8 -------------------------------------------------------------------------------

#: Words that longer n-grams are held against, at most; beyond, all n-grams are counted.
MOST_WORDS = 50_000


def _term_counts(tokens: DataFrame, lo: int, hi: int, stop: set, within: list | None = None) -> DataFrame:
    """(term, n) of the whole corpus, summed within runs of documents before the one exchange."""
    run_bytes = RUN_BYTES

    def count(batches):
        words = None if within is None else pa.array(within, pa.string())
        for run in _runs(batches, _byte_ends, run_bytes):
            for _, _, gram, grams in _grams(run, stop, lo, hi, words):
                n = np.bincount(gram, minlength=len(grams))
                used = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([grams.take(pa.array(used)), pa.array(n[used], pa.int64())], names=["term", "n"])
    return tokens.mapInArrow(count, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("tf"))


def _top(freq: DataFrame, most: int) -> list[tuple]:
    return [(-r["tf"], r["term"]) for r in freq.orderBy(F.col("tf").desc(), F.col("term")).limit(most).collect()]


def vocabulary(tokens: DataFrame, max_features: int = 1000, ngram=(1, 2), stop_words=None) -> list[str]:
    """The `max_features` most frequent terms of the corpus (ties: term ascending), of (id, tokens).

    An n-gram is no more frequent than each of its words, so those with a word that is rarer than the
    last of `max_features` single words cannot be among them, and are not counted."""
    lo, hi = ngram
    stop = _stop_set(stop_words)
    if lo > 1:
        return [t for _, t in _top(_term_counts(tokens, lo, hi, stop), max_features)]
    words = _term_counts(tokens, 1, 1, stop)
    if hi > 1:
        words = materialize(words)
    top, within = _top(words, max_features), None
    if hi > 1:
        if 0 < len(top) == max_features:
            frequent = words.where(F.col("tf") >= -top[-1][0]).limit(MOST_WORDS + 1).collect()
            within = [r["term"] for r in frequent] if len(frequent) <= MOST_WORDS else None
        top = sorted(top + _top(_term_counts(tokens, 2, hi, stop, within), max_features))[:max_features]
    return [t for _, t in top]


class TermVectors:
    """The counted vocabulary terms of each document, in its row: (id, _v), the terms' numbers and counts.

    A document is one row, so nothing but the vocabulary's sums is shuffled."""

    def __init__(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_features: int = 1000,
                 ngram=(1, 2), stop_words=None):
        tokens = materialize(_joined_tokens(df, id_col, text_col))
        self.id_col, self.ids, self.n_docs = id_col, df.select(id_col), tokens.count()
        self.terms = vocabulary(tokens, max_features, ngram, stop_words)
        # No rows if no text holds a term.
        self.rows = materialize(self._counted(tokens, ngram, _stop_set(stop_words))) if self.terms else None

    def _counted(self, tokens: DataFrame, ngram, stop: set) -> DataFrame:
        """(id, i, n): numbers of the terms that the row holds, ascending, and their counts."""
        schema = StructType([tokens.schema[0], StructField("i", ArrayType(IntegerType())), StructField("n", ArrayType(LongType()))])
        terms, run_bytes, lo, hi = self.terms, RUN_BYTES, *ngram

        def count(batches):
            names = pa.array(terms, pa.string())
            # Only these words can be in a term.
            words = pc.unique(pc.split_pattern(names, " ").flatten())
            for run in _runs(batches, _byte_ends, run_bytes):
                found = [np.zeros(0, np.int64)]
                for _, rows, gram, grams in _grams(run, stop, lo, hi, words):
                    number = pc.fill_null(pc.index_in(grams, names), -1).to_numpy(zero_copy_only=False)[gram]
                    found.append((rows * len(names) + number)[number >= 0])
                keys, n = np.unique(np.concatenate(found), return_counts=True)
                starts = np.searchsorted(keys, np.arange(len(run) + 1) * len(names)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [run.column(0), pa.ListArray.from_arrays(starts, pa.array(keys % len(names), pa.int32())),
                     pa.ListArray.from_arrays(starts, pa.array(n, pa.int64()))], names=schema.names)
        return tokens.mapInArrow(count, schema)

    def _long(self, value, name: str, kind: str) -> DataFrame:
        """(id, term, value of (index, count)) rows."""
        if self.rows is None:
            return self._none(name, kind)
        x = self.rows.select(self.id_col, value(F.arrays_zip("i", "n")).alias("_e")).select(self.id_col, F.explode("_e").alias("_e"))
        words = F.array(*[F.lit(t) for t in self.terms])
        return x.select(self.id_col, F.get(words, F.col("_e.i")).alias("term"), F.col("_e.x").cast(kind).alias(name))

    def _none(self, name: str, kind: str) -> DataFrame:
        return self.ids.select(self.id_col, F.lit("").alias("term"), F.lit(0).cast(kind).alias(name)).limit(0)

    def counts(self) -> DataFrame:
        """(id, term, count)"""
        return self._long(lambda e: F.transform(e, lambda x: F.struct(x["i"].alias("i"), x["n"].alias("x"))), "count", "bigint")

    def tfidf(self) -> DataFrame:
        """(id, term, tfidf): smoothed idf = ln((1 + n) / (1 + df)) + 1, times the count, L2-normalised
        within the row.  Document frequencies are one row per vocabulary term."""
        if self.rows is None:
            return self._none("tfidf", "double")
        df = {r["i"]: r["n"] for r in self.rows.select(F.explode("i").alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect()}
        idf = F.array(*[F.lit(math.log((1 + self.n_docs) / (1 + df.get(i, 0))) + 1) for i in range(len(self.terms))])

        def weighted(entries):
            x = F.transform(entries, lambda e: F.struct(e["i"].alias("i"), (e["n"] * F.get(idf, e["i"])).alias("x")))
            # The products and their norm are bound once per document.
            bound = F.transform(F.array(x), lambda w: F.struct(
                w.alias("w"), F.sqrt(F.aggregate(w, F.lit(0.0), lambda s, y: s + y["x"] * y["x"])).alias("norm")))
            return F.transform(bound, lambda b: F.transform(b["w"], lambda e: F.struct(
                e["i"].alias("i"), F.round(e["x"] / b["norm"], 6).alias("x"))))[0]
        return self._long(weighted, "tfidf", "double")


def count_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_features: int = 1000,
                   ngram=(1, 2), stop_words=None) -> DataFrame:
    """(id, term, count) for vocabulary terms; one row of `df` per document."""
    return TermVectors(df, id_col, text_col, max_features, ngram, stop_words).counts()


def binary_features(counts: DataFrame) -> DataFrame:
    return counts.withColumn("present", F.least(F.col("count"), F.lit(1)).cast("bigint"))


def tfidf_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_features: int = 1000,
                   ngram=(1, 2), stop_words=None) -> DataFrame:
    """(id, term, tfidf) for vocabulary terms; one row of `df` per document."""
    return TermVectors(df, id_col, text_col, max_features, ngram, stop_words).tfidf()


# ---- F9 / F10 -----------------------------------------------------------------------------------

def _moment_parts(batches, col: str):
    """Per batch the sums of products of all pairs of (1, components): rows (i, values of row i)."""
    for pdf in batches:
        if len(pdf):
            m = np.stack([np.append(1.0, np.asarray(v, float)) for v in pdf[col]])
            g = m.T @ m
            yield pd.DataFrame({"i": range(len(g)), "g": list(g)})


def _moments(df: DataFrame, col: str):
    """(n, sums, products) of the vectors: each task sums its batches' matrices, Spark sums those, and
    only (d + 1) x (d + 1) cells meet the driver.  Null vectors, and vectors with a null, are left out."""
    whole = F.col(col).isNotNull() & ~F.exists(col, lambda x: x.isNull())
    parts = (df.where(whole).select(F.col(col).cast("array<double>").alias(col))
             .mapInPandas(lambda b: _moment_parts(b, col), "i int, g array<double>"))
    cells = parts.select("i", F.posexplode("g").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    dim = max((r["i"] for r in cells), default=0) + 1
    m = np.zeros((dim, dim))
    for r in cells:
        m[r["i"], r["j"]] = r["v"]
    return m[0, 0], m[0, 1:], m[1:, 1:]


def _axes(matrix, k: int):
    """(values, vectors) of the k largest eigenvalues; a vector's largest component is positive."""
    if not len(matrix):
        return np.zeros(0), np.zeros((0, 0))
    values, vectors = np.linalg.eigh(matrix)
    top = np.argsort(-values, kind="stable")[:min(k, len(matrix))]
    v = vectors[:, top]
    return np.maximum(values[top], 0), v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])


def _projected(df: DataFrame, id_col: str, col: str, vectors, shift) -> DataFrame:
    """(id, components): the products with the columns of ``vectors``, less ``shift``; a vector that is
    null or holds a null has null components."""
    arr = F.col(col).cast("array<double>")
    comps = []
    for j in range(vectors.shape[1]):
        basis = F.array(*[F.lit(float(x)) for x in vectors[:, j]])
        dot = F.aggregate(F.zip_with(arr, basis, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
        comps.append(dot - F.lit(float(shift[j])))
    out = F.array(*comps) if comps else F.array().cast("array<double>")
    return df.select(id_col, F.when(~F.exists(col, lambda x: x.isNull()), out).alias("components"))


def pca(df: DataFrame, k: int, id_col: str = "vec_id", col: str = "embedding"):
    """(projected rows, explained variance ratio rows): centred vectors on min(k, d) principal components.

    Mean and covariance come from one distributed pass; only d x d numbers meet the driver.  An empty
    table has no rows and no ratios, vectors without any variance have ratios of 0."""
    n, sums, products = _moments(df, col)
    mean = sums / max(n, 1.0)
    cov = (products - n * np.outer(mean, mean)) / max(n - 1, 1.0)
    values, vectors = _axes(cov, k)
    total = np.trace(cov)
    ev = df.sparkSession.createDataFrame([(i, float(x / total) if total > 0 else 0.0) for i, x in enumerate(values)],
                                         "component int, explained_variance_ratio double")
    return _projected(df, id_col, col, vectors, mean @ vectors if len(mean) else []), ev


def svd(df: DataFrame, k: int, id_col: str = "vec_id", col: str = "embedding"):
    """Truncated SVD (no centering): rows projected onto the top min(k, d) right singular vectors,
    i.e. U * S, and the singular values.  An empty table has no rows and no values."""
    _, _, products = _moments(df, col)
    values, vectors = _axes(products, k)
    return _projected(df, id_col, col, vectors, np.zeros(len(values))), np.sqrt(values)


def reduce_dimensions(df: DataFrame, method: str = "pca", k: int = 100, **kw):
    if method == "pca":
        return pca(df, k, **kw)[0]
    if method == "svd":
        return svd(df, k, **kw)[0]
    raise ValueError(f"Unknown reduction method: {method}")


# ---- F11 ----------------------------------------------------------------------------------------

def extract_features(df: DataFrame, types=("tfidf", "statistical", "linguistic"), id_col: str = "doc_id",
                     text_col: str = "text", max_features: int = 1000, ngram=(1, 2), stop_words=None) -> DataFrame:
    """Long output (id, feature, value): families chosen by name; term families prefixed
    ``tfidf_`` / ``count_``, statistics ``stat_``, linguistic ratios ``ling_``.  Term families see
    the preprocessed text (F3), statistics and ratios the raw one."""
    parts = []
    clean = preprocess(df.select(id_col, text_col), text_col, stop_words).select(id_col, F.col("processed").alias(text_col))
    # One vocabulary and one counting pass for both term families.
    vectors = TermVectors(clean, id_col, text_col, max_features, ngram, stop_words) if {"tfidf", "count"} & set(types) else None
    if "tfidf" in types:
        parts.append(vectors.tfidf().select(id_col, F.concat(F.lit("tfidf_"), "term").alias("feature"), F.col("tfidf").alias("value")))
    if "count" in types:
        parts.append(vectors.counts().select(id_col, F.concat(F.lit("count_"), "term").alias("feature"),
                                             F.col("count").cast("double").alias("value")))
    if "statistical" in types:
        s = stat_features(df.select(id_col, text_col), text_col)
        names = [c for c in s.columns if c != id_col]
        parts.append(s.select(id_col, F.explode(F.array(*[F.struct(F.lit("stat_" + n).alias("feature"),
                                                                   F.col(n).cast("double").alias("value"))
                                                          for n in names])).alias("f"))
                     .select(id_col, "f.feature", "f.value"))
    if "linguistic" in types:
        g = ling_features(df.select(id_col, text_col), text_col)
        names = [c for c in g.columns if c != id_col]
        parts.append(g.select(id_col, F.explode(F.array(*[F.struct(F.lit("ling_" + n).alias("feature"),
                                                                   F.col(n).cast("double").alias("value"))
                                                          for n in names])).alias("f"))
                     .select(id_col, "f.feature", "f.value"))
    if not parts:
        raise ValueError("no feature family selected")
    return reduce(lambda a, b: a.unionByName(b), parts)
