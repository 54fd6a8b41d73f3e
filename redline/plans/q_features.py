"""Queries: text features."""

from __future__ import annotations

from pyspark.sql import functions as F

from redline.functions.text import WS
from redline.operators import features as FE
from redline.plans.q_text import strip_sql
from redline.plans.registry import query
from redline.session import materialize
from redline.sources.tables import table

WSI = WS[1:-1]


def _stop_sql() -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in FE.default_stop_words()) + "]"


WORDS = f"list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '')"
SENTS = f"len(list_filter(regexp_split_to_array(text, '[.!?]+(?:{WS}+|\\z)'), lambda x: {strip_sql('x')} <> ''))"

STAT_SQL = f"""
SELECT doc_id, CAST(length(text) AS BIGINT) AS char_count, CAST(len(w) AS BIGINT) AS word_count,
       CAST(s AS BIGINT) AS sentence_count,
       round(CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda x: length(x))) / len(w) ELSE 0.0 END, 6)
         AS avg_word_length,
       round(CASE WHEN s > 0 THEN len(w) / s ELSE 0.0 END, 6) AS avg_sentence_length,
       round(CASE WHEN len(w) > 0 THEN 206.835 - 1.015 * (CASE WHEN s > 0 THEN len(w) / s ELSE 0.0 END)
                  - 84.6 * (length(regexp_replace(text, '[^aeiouAEIOU]', '', 'g')) / len(w)) ELSE 0.0 END, 6)
         AS flesch_score,
       round(CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) ELSE 0.0 END, 6) AS lexical_diversity
FROM (SELECT doc_id, text, {WORDS} AS w, {SENTS} AS s FROM documents)"""


@query("stat_features", STAT_SQL)
def stat_features_q(spark, sf):
    return FE.stat_features(table(spark, sf, "documents", "doc_id", "text"))


LING_SQL = f"""
SELECT doc_id,
       round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: regexp_matches(x, '^\\p{{Lu}}'))) / len(w)
                  ELSE 0.0 END, 6) AS capitalized_ratio,
       round(CASE WHEN length(text) > 0
                  THEN length(regexp_replace(text, '[\\p{{L}}\\p{{N}}_{WSI}]', '', 'g')) / length(text)
                  ELSE 0.0 END, 6) AS punctuation_ratio
FROM (SELECT doc_id, text, {WORDS} AS w FROM documents)"""


@query("ling_features", LING_SQL)
def ling_features_q(spark, sf):
    return FE.ling_features(table(spark, sf, "documents", "doc_id", "text"))


def _tokens_sql() -> str:
    return (f"list_filter(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-zA-Z{WSI}]', '', 'g'), "
            f"'{WS}+'), lambda x: x <> ''), lambda x: NOT list_contains({_stop_sql()}, x))")


@query("preprocess_tokens", f"SELECT doc_id, array_to_string({_tokens_sql()}, ' ') AS processed FROM documents")
def preprocess_tokens_q(spark, sf):
    return FE.preprocess(table(spark, sf, "documents", "doc_id", "text")).select("doc_id", "processed")


@query("lemma_map", f"""
WITH t AS (SELECT doc_id, {_tokens_sql()} AS tokens FROM documents),
vocab AS (SELECT DISTINCT unnest(tokens) AS token FROM t),
dict AS (SELECT token, substr(token, 1, length(token) - 1) AS lemma FROM vocab
         WHERE suffix(token, 's') AND length(token) > 2 AND substr(token, 1, length(token) - 1) IN (SELECT token FROM vocab)),
x AS (SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM t)
SELECT doc_id, string_agg(coalesce(d.lemma, x.token), ' ' ORDER BY pos) AS lemmas
FROM x LEFT JOIN dict d USING (token) GROUP BY doc_id""")
def lemma_map_q(spark, sf):
    t = materialize(FE.preprocess(table(spark, sf, "documents", "doc_id", "text")).select("doc_id", "processed"))
    # Stored as one string, a document's tokens take the least room.
    t = t.select("doc_id", F.filter(F.split("processed", " "), lambda x: x != "").alias("tokens"))
    out = FE.lemma_map(t, FE.plural_dictionary(t))
    return out.select("doc_id", F.array_join("lemmas", " ").alias("lemmas"))


def _grams_sql(text: str = "text") -> str:
    toks = (f"list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}', 0), "
            f"lambda x: NOT list_contains({_stop_sql()}, x))")
    return f"""
toks AS (SELECT doc_id, {toks} AS t FROM documents),
terms AS (
  SELECT doc_id, unnest(t) AS term FROM toks
  UNION ALL
  SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM toks WHERE len(t) >= 2),
vocab AS (SELECT term FROM (SELECT term, count(*) AS tf FROM terms GROUP BY term) ORDER BY tf DESC, term LIMIT 1000),
counts AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS count FROM terms WHERE term IN (SELECT term FROM vocab)
           GROUP BY doc_id, term),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf
        FROM counts GROUP BY term),
tfidf AS (SELECT doc_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS tfidf
          FROM (SELECT c.doc_id, c.term, c.count * i.idf AS x FROM counts c JOIN idf i USING (term)))"""


GRAMS = "WITH " + _grams_sql().lstrip()


@query("ngrams", GRAMS + "\nSELECT doc_id, term, CAST(count(*) AS BIGINT) AS n FROM terms GROUP BY doc_id, term")
def ngrams_q(spark, sf):
    return FE.ngrams(table(spark, sf, "documents", "doc_id", "text"), counted=True)


@query("count_features", GRAMS + "\nSELECT doc_id, term, count FROM counts")
def count_features_q(spark, sf):
    return FE.count_features(table(spark, sf, "documents", "doc_id", "text"))


@query("binary_features", GRAMS + "\nSELECT doc_id, term, count, CAST(least(count, 1) AS BIGINT) AS present FROM counts")
def binary_features_q(spark, sf):
    return FE.binary_features(FE.count_features(table(spark, sf, "documents", "doc_id", "text")))


@query("tfidf_features", GRAMS + "\nSELECT doc_id, term, tfidf FROM tfidf")
def tfidf_features_q(spark, sf):
    return FE.tfidf_features(table(spark, sf, "documents", "doc_id", "text"))


@query("pca_explained_variance")
def pca_explained_variance_q(spark, sf):
    return FE.pca(table(spark, sf, "embeddings", "vec_id", "embedding"), 8)[1]


@query("pca")
def pca_q(spark, sf):
    e = table(spark, sf, "embeddings", "vec_id", "embedding")
    proj, _ = FE.pca(e, 8)
    return proj


@query("svd")
def svd_q(spark, sf):
    e = table(spark, sf, "embeddings", "vec_id", "embedding")
    proj, _ = FE.svd(e, 8)
    return proj


def _long(sql: str, prefix: str, cols: list[str]) -> str:
    parts = " UNION ALL ".join(f"SELECT doc_id, '{prefix}{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM ({sql})"
                               for c in cols)
    return parts


CLEAN_GRAMS = "WITH " + _grams_sql(f"array_to_string({_tokens_sql()}, ' ')").lstrip()


@query("feature_request", CLEAN_GRAMS + ",\nst AS (" + STAT_SQL + "),\nlg AS (" + LING_SQL + ")\n" + """
SELECT doc_id, 'tfidf_' || term AS feature, tfidf AS value FROM tfidf
UNION ALL SELECT doc_id, 'count_' || term AS feature, CAST(count AS DOUBLE) AS value FROM counts
UNION ALL """ + _long("SELECT * FROM st", "stat_", ["char_count", "word_count", "sentence_count", "avg_word_length",
                                                    "avg_sentence_length", "flesch_score", "lexical_diversity"])
       + " UNION ALL " + _long("SELECT * FROM lg", "ling_", ["capitalized_ratio", "punctuation_ratio"]))
def feature_request_q(spark, sf):
    return FE.extract_features(table(spark, sf, "documents", "doc_id", "text"), ("tfidf", "count", "statistical", "linguistic"))
