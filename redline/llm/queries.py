"""The registered queries of the subpackage, one per operator, each with production parameters
over its whole table, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import functions as F

from redline.llm import (fill_in_middle, line_dedup, mixing, near_dedup, packing, phrases, quality, sentence_pieces, token_counts,
                         topk, toxicity, url_filter, warc)
from redline.llm.common import begin, words
from redline.sources.scratch import scratch_path
from redline.sources.tables import table

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        @functools.wraps(fn)
        def run(spark, sf_dir):
            begin(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run
    return deco


# --- op6: URL filters ------------------------------------------------------------------------

SITE_RULES = [url_filter.site_rule("allow", "org", "/"), url_filter.site_rule("block", "example.org", "/es/"),
              url_filter.site_rule("block", "example.org", "/en/1"), url_filter.site_rule("allow", "com", "/fr/"),
              url_filter.site_rule("block", "com", "/de/")]
#: Host labels of junk sites, as whole hyphen-separated parts; (name, tokens that must all occur).
JUNK_HOSTS = [("spam-farm", ("spam", "farm")), ("cheap-pills", ("cheap", "pills")), ("casino", ("casino",)),
              ("free-money", ("free", "money")), ("adult", ("adult",)), ("porn", ("porn",)), ("viagra", ("viagra",))]
PATTERN_RULES = [url_filter.pattern_rule("block", f"host:{n}", rf"^(?:[^/]*[.-])?{n}(?:[.-][^/]*)?(?:/|$)", t)
                 for n, t in JUNK_HOSTS]

_SITE_SQL = ", ".join(f"('{r.verdict}', '{r.name.partition('/')[0]}', '/{r.name.partition('/')[2]}')" for r in SITE_RULES)
OP6_SQL = f"""
WITH r(verdict, rhost, rpath) AS (VALUES {_SITE_SQL}),
p0 AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p0),
d AS (SELECT DISTINCT host, path FROM p),
b AS (SELECT host, path, arg_min(rhost || rpath, (-length(rhost || rpath), -length(rhost), rhost || rpath)) AS rule,
             arg_min(verdict, (-length(rhost || rpath), -length(rhost), rhost || rpath)) AS verdict
      FROM d JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL),
j(name) AS (VALUES {", ".join(f"('{n}')" for n, _ in JUNK_HOSTS)}),
m AS (SELECT host, path, min('host:' || name) AS pattern FROM d, j
      WHERE regexp_matches(host, '(^|[.-])' || name || '([.-]|$)') GROUP BY ALL)
SELECT page_id, p.host AS host, p.path AS path, b.rule AS rule, CASE WHEN b.rule IS NULL THEN m.pattern END AS pattern,
       coalesce(b.verdict, CASE WHEN m.pattern IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN b ON p.host = b.host AND p.path = b.path LEFT JOIN m ON p.host = m.host AND p.path = m.path
"""


@register("op6_url_filter", OP6_SQL)
def op6_url_filter(spark, sf_dir):
    return url_filter.judge_urls(table(spark, sf_dir, "pages", "page_id", "url"), SITE_RULES + PATTERN_RULES)


# --- op10: quality rules ----------------------------------------------------------------------

_WS = r"\x20\x09-\x0D"
_MEASURES = {"mean_word": "1000 * word_chars // n_words", "symbols": "1000 * n_symbols // word_chars",
             "dup_lines": "1000 * n_dup_lines // n_lines", "repeats": "1000 * n_repeat_words // n_words"}


def _q(keys: str) -> str:
    by = keys + ", " if keys else ""
    on = f"PARTITION BY {by}measure"
    return f"""SELECT {by}measure, any_value(total) AS total, min(CASE WHEN 4 * upto >= total THEN value END) AS q1,
      min(CASE WHEN 4 * upto >= 3 * total THEN value END) AS q3
      FROM (SELECT *, sum(n) OVER ({on} ORDER BY value) AS upto, sum(n) OVER ({on}) AS total
            FROM (SELECT {by}measure, value, sum(n) AS n FROM sk GROUP BY ALL)) GROUP BY ALL"""


OP10_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^{_WS}]+') AS ws FROM t),
win AS (SELECT rid, unnest(range(1, len(ws) - {quality.WINDOW} + 2)) AS i, ws FROM w WHERE len(ws) >= {quality.WINDOW}),
win2 AS (SELECT rid, i, md5(array_to_string(ws[i:i + {quality.WINDOW - 1}], ' ')) AS h FROM win),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, h) AS c FROM win2) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT x) AS n FROM (SELECT rid, unnest(range(i, i + {quality.WINDOW})) AS x FROM rep) GROUP BY rid),
li AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{_WS}]')) AS ls FROM t),
m AS (SELECT t.rid, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(text, '[{_WS}]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
        CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
      FROM t JOIN w USING (rid) JOIN li USING (rid) LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m),
v AS ({" UNION ALL ".join(f"SELECT lang, source, '{k}' AS measure, {e} AS v FROM b WHERE NOT base_failed" for k, e in _MEASURES.items())}),
sk AS (SELECT lang, source, measure, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS value, count(*) AS n
       FROM v GROUP BY ALL),
o AS ({_q("lang, source")}), g AS ({_q("lang")}), a AS ({_q("")}),
sl(measure, slack) AS (VALUES {", ".join(f"('{k}', {s})" for k, s in quality.SLACK.items())}),
f0 AS (SELECT o.lang, o.source, o.measure, slack,
         CASE WHEN o.total >= {quality.MIN_GROUP} THEN o.q1 WHEN g.total >= {quality.MIN_GROUP} THEN g.q1 ELSE a.q1 END AS q1,
         CASE WHEN o.total >= {quality.MIN_GROUP} THEN o.q3 WHEN g.total >= {quality.MIN_GROUP} THEN g.q3 ELSE a.q3 END AS q3
       FROM o JOIN g ON o.lang IS NOT DISTINCT FROM g.lang AND o.measure = g.measure JOIN a ON a.measure = o.measure
       JOIN sl ON sl.measure = o.measure),
f AS (SELECT lang, source, measure, q1 - {quality.FENCE_IQR} * (q3 - q1) - slack AS lo, q3 + {quality.FENCE_IQR} * (q3 - q1) + slack AS hi FROM f0),
bad AS (SELECT DISTINCT rid FROM ({" UNION ALL ".join(f"SELECT rid FROM b JOIN f ON b.lang IS NOT DISTINCT FROM f.lang AND b.source IS NOT DISTINCT FROM f.source AND measure = '{k}' WHERE NOT base_failed AND NOT ({e} BETWEEN lo AND hi)" for k, e in _MEASURES.items())}))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND bad.rid IS NULL AS kept FROM b LEFT JOIN bad USING (rid)
"""


@register("op10_quality_rules", OP10_SQL)
def op10_quality_rules(spark, sf_dir):
    return quality.quality_filter(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))


# --- op8: line dedup --------------------------------------------------------------------------

@register("op8_line_dedup")
def op8_line_dedup(spark, sf_dir):
    m = line_dedup.mark_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return m.select(F.col("row.doc_id").alias("doc_id"), line_dedup.kept_text().alias("text"),
                    F.size("lines").alias("n_lines"), F.size("drop").alias("n_dropped"))


# --- op9: toxicity ----------------------------------------------------------------------------

@register("op9_toxicity")
def op9_toxicity(spark, sf_dir):
    return toxicity.score_documents(table(spark, sf_dir, "documents", "doc_id", "text"),
                                    table(spark, sf_dir, "labels", "doc_id", "toxic"))


# --- op7: exact top-k search ------------------------------------------------------------------

OP7_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
q AS (SELECT vec_id, min(v) AS v FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id,
             CAST(list_sum(list_transform(list_zip(q.v, v.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
      FROM q JOIN v ON q.vec_id <> v.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@register("op7_topk_search", OP7_SQL)
def op7_topk_search(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 20 == 0)


# --- op2: WARC --------------------------------------------------------------------------------

OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS top FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < top THEN top END AS refers_to FROM m
"""


@register("op2_warc", OP2_SQL)
def op2_warc(spark, sf_dir):
    index = warc.write_warc(table(spark, sf_dir, "pages", "page_id", "url", "html"), scratch_path(spark, "warc"))
    records = warc.read_warc(index, with_payload=False)
    return records.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


# --- op5: token counts ------------------------------------------------------------------------

def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@register("op5_token_counts")
def op5_token_counts(spark, sf_dir):
    pieces = token_counts.sentencepiece_vocabulary(tokenizer_path("piece_bpe_32k.model"))
    return token_counts.token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), pieces)


# --- op3: best-fit packing --------------------------------------------------------------------

@register("op3_packing")
def op3_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("word_bpe_49k.json"))


# --- op4: mixing ------------------------------------------------------------------------------

#: Topics of the documents by terms, in order of precedence.
TOPICS = {"legal": ("icense", "ll rights reserved"), "contact": ("@", "http"), "table": (" | ",),
          "code": (" = ", "();", "{")}
#: Target shares of tokens; the rest is tempered over the other values.
LANGUAGE_SHARES = {"en": 0.5, "de": 0.2, "fr": 0.15}
MIX = {"fixed": (None, LANGUAGE_SHARES, None), "alpha": (0.7, 1.0, 0.5), "keep_share": 0.7}


def mixed(docs):
    """Source, language and topic margins over word counts."""
    text = F.col("text")
    return mixing.mix(docs, F.size(words(text)), (F.col("source"), F.col("lang"), mixing.topic_by_terms(text, TOPICS)), **MIX)


@register("op4_mixing")
def op4_mixing(spark, sf_dir):
    m = mixed(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))
    return m.select(F.col("row.doc_id").alias("doc_id"), F.col("d0").alias("source"), F.col("d1").alias("lang"),
                    F.col("d2").alias("topic"), F.col("weight").alias("n_tokens"), "probability", "selected")


# --- op1: near-duplicate documents ------------------------------------------------------------

@register("op1_near_dedup")
def op1_near_dedup(spark, sf_dir):
    classes = near_dedup.near_duplicate_classes(table(spark, sf_dir, "documents", "doc_id", "text"))
    return classes.select("doc_id", "class_id")


# --- op11: fill-in-middle ---------------------------------------------------------------------

OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
        CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3,
        CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT *, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a,
        greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM u),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
        WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
        array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM f
"""


@register("op11_fill_in_middle", OP11_SQL)
def op11_fill_in_middle(spark, sf_dir):
    written = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents", "doc_id", "text"))
    return written.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                          F.sha2(fill_in_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


# --- op13: sentencepiece ids ------------------------------------------------------------------

@register("op13_sentence_pieces")
def op13_sentence_pieces(spark, sf_dir):
    coded = sentence_pieces.transcode(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


# --- op12: phrase collocations ----------------------------------------------------------------

OP12_SQL = r"""
WITH p AS (SELECT row_number() OVER () AS pid, lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece
           FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
nw AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) s(k) WHERE len(w) >= k),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cut AS (SELECT c.lang, c.k, phrase, a, w, j, array_to_string(w[1:j], ' ') AS p1, array_to_string(w[j + 1:], ' ') AS p2
        FROM c, (VALUES (1), (2), (3)) s(j) WHERE j < k),
sc AS (SELECT cut.*, f1.f AS l, f2.f AS r, (2000000::HUGEINT * a) // (f1.f::HUGEINT + f2.f) AS score FROM cut
       JOIN f f1 ON f1.lang = cut.lang AND f1.phrase = p1 JOIN f f2 ON f2.lang = cut.lang AND f2.phrase = p2),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
sub AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS around
        FROM c, (VALUES (2), (3)) s(m), (VALUES (1), (2), (3)) t(i) WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN sub ON sub.lang = best.lang AND sub.phrase = best.phrase
         WHERE NOT coalesce(100::HUGEINT * around >= 80::HUGEINT * a, false)),
rk AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT rk.lang AS lang, CAST(rank AS INTEGER) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       nw.n AS n, CAST(score AS BIGINT) AS score FROM rk JOIN nw ON nw.lang = rk.lang WHERE rank <= 2000
"""


@register("op12_phrases", OP12_SQL)
def op12_phrases(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents", "lang", "text"))
