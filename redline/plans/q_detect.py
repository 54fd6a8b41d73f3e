"""Queries: firm detection and document typing."""

from __future__ import annotations

from pyspark.sql import functions as F

from redline.functions import text as FT
from redline.operators import detect as D
from redline.plans.q_compare import _with
from redline.plans.registry import query
from redline.plans.views_sql import with_views
from redline.sources import views as V
from redline.sources.tables import table


@query("detect_firm", _with("""
SELECT d.id, d.law_firm_id, f.name AS law_firm_name
FROM detected d LEFT JOIN law_firms f ON f.id = d.law_firm_id"""))
def detect_firm_q(spark, sf):
    cf = V.contract_files(spark, sf).select("id", "extracted_text")
    return D.detect_firm(cf, V.law_firms(spark, sf)).drop("extracted_text")


@query("detect_all_firms", _with("""
SELECT c.id, coalesce(m.firms_matched, '') AS firms_matched, m.default_firm
FROM contract_files c LEFT JOIN (
  SELECT id, string_agg(firm_id, ',' ORDER BY firm_rank) AS firms_matched, arg_min(firm_id, firm_rank) AS default_firm
  FROM (SELECT DISTINCT c.id, kw.firm_id, kw.firm_rank FROM contract_files c
        JOIN kw ON strpos(lower(c.extracted_text), kw.kw) > 0)
  GROUP BY id) m USING (id)"""))
def detect_all_firms_q(spark, sf):
    cf = V.contract_files(spark, sf).select("id", "extracted_text")
    out = D.detect_all_firms(cf, V.law_firms(spark, sf))
    return out.select("id", F.array_join("firms_matched", ",").alias("firms_matched"), "default_firm")


@query("firm_keyword_counts", with_views("""
SELECT id AS firm_id, CAST(sum(len(keywords)) AS BIGINT) AS n_keywords
FROM law_firms GROUP BY ROLLUP (id)""", "law_firms"))
def firm_keyword_counts_q(spark, sf):
    return D.keyword_counts(V.law_firms(spark, sf))


@query("parse_keywords", """
SELECT conv_id, turn, array_to_string(kw, '|') AS keywords, CAST(len(kw) AS BIGINT) AS n_keywords
FROM (SELECT conv_id, turn, list_filter(list_transform(string_split(text, ','), lambda x: trim(x)),
                                        lambda x: x <> '') AS kw FROM conversations)""")
def parse_keywords_q(spark, sf):
    c = table(spark, sf, "conversations", "conv_id", "turn", "text")
    kw = FT.parse_keywords("text")
    return c.select("conv_id", "turn", F.array_join(kw, "|").alias("keywords"), F.size(kw).cast("bigint").alias("n_keywords"))


@query("firm_slug", """
SELECT s_suppkey, 'law_firm_' || replace(replace(lower(s_name), ' ', '_'), '&', 'and') AS firm_id,
       s_name || '|' || string_split(s_name, ' ')[1] AS default_keywords
FROM supplier""")
def firm_slug_q(spark, sf):
    s = table(spark, sf, "supplier", "s_suppkey", "s_name")
    return s.select("s_suppkey", FT.firm_slug("s_name", "law_firm_").alias("firm_id"),
                    F.array_join(FT.default_keywords("s_name"), "|").alias("default_keywords"))


def _rules_sql(rules, default, x):
    parts = []
    for needles, label in rules:
        cond = " OR ".join(f"strpos(lower({x}), '{n}') > 0" for n in needles)
        parts.append(f"WHEN {cond} THEN '{label}'")
    return f"CASE {' '.join(parts)} ELSE '{default}' END"


_TITLE = "concat_ws(' ', document_type, filename)"


@query("template_type", with_views(f"""
SELECT id, {_rules_sql(FT.TEMPLATE_RULES_A, 'main_contract', _TITLE)} AS type_rules_a,
       {_rules_sql(FT.TEMPLATE_RULES_B, 'main_contract', _TITLE)} AS type_rules_b
FROM contract_files""", "contract_files"))
def template_type_q(spark, sf):
    cf = V.contract_files(spark, sf).select("id", F.concat_ws(" ", "document_type", "filename").alias("title"))
    return cf.select("id", FT.template_type("title", FT.TEMPLATE_RULES_A).alias("type_rules_a"),
                     FT.template_type("title", FT.TEMPLATE_RULES_B).alias("type_rules_b"))


def _ctype_sql(x):
    parts = " ".join(f"WHEN regexp_matches(lower({x}), '{rx}') THEN '{label}'"
                     for label, rx in FT.contract_type_regexes())
    return f"CASE {parts} ELSE 'default' END"


@query("contract_type", f"SELECT doc_id, {_ctype_sql('text')} AS contract_type FROM documents")
def contract_type_q(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text")
    return d.select("doc_id", FT.contract_type("text").alias("contract_type"))


def _prompt_sql(x):
    parts = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in D.SYSTEM_PROMPTS.items())
    return f"CASE lower({x}) {parts} ELSE '{D.SYSTEM_PROMPTS['default']}' END"


@query("system_prompt_for_type", f"""
SELECT doc_id, contract_type, {_prompt_sql('contract_type')} AS system_prompt
FROM (SELECT doc_id, {_ctype_sql('text')} AS contract_type FROM documents)""")
def system_prompt_for_type_q(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text")
    t = d.select("doc_id", FT.contract_type("text").alias("contract_type"))
    return t.select("doc_id", "contract_type", D.prompt_for("contract_type").alias("system_prompt"))
