"""Law-firm detection and document typing.

Firm detection is a case-insensitive *contains* match, which has no equi key of its own.  Every
keyword therefore gets an anchor that any text containing it must hold as a whole: its longest
inner token (one with a separator on both sides within the keyword), or for keywords without one a
character gram.  Texts' distinct tokens (grams) meet the anchors in an equi join, and the few
candidate pairs are checked on the text.  Few anchors are sent to the texts, so nothing of a text is
shuffled; many meet the texts' ids and tokens in a shuffle.  Both find the same, without Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redline.functions.text import template_type, contract_type  # noqa: F401  (re-export)
from redline.session import materialize

SEPARATORS = r"[^\p{L}\p{N}]+"
INNER_TOKEN = r"(?<=[^\p{L}\p{N}])[\p{L}\p{N}]+(?=[^\p{L}\p{N}])"
GRAM = 3
#: Anchors of at most so many bytes are sent to the texts.
SMALL_ANCHORS = 8 << 20


def firm_keywords(firms: DataFrame) -> DataFrame:
    """(firm_rank, firm_id, firm_name, kw_pos, kw, kw_lower) for every non-empty keyword."""
    return (firms.select("firm_rank", F.col("id").alias("firm_id"), F.col("name").alias("firm_name"),
                         F.posexplode("keywords").alias("kw_pos", "kw"))
            .where(F.length("kw") > 0)
            .select("firm_rank", "firm_id", "firm_name", "kw_pos", "kw", F.lower("kw").alias("kw_lower")))


def keyword_anchors(firms: DataFrame) -> DataFrame:
    """Distinct (firm_rank, firm_id, firm_name, kw_lower, anchor, gram): gram is 0 for a token
    anchor, else the anchor's length in characters."""
    kw = firm_keywords(firms).select("firm_rank", "firm_id", "firm_name", "kw_lower").distinct()
    inner = F.regexp_extract_all("kw_lower", F.lit(INNER_TOKEN), F.lit(0))
    longest = F.array_max(F.transform(inner, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    gram = F.least(F.lit(GRAM), F.length("kw_lower"))
    return kw.withColumn("_t", longest).select(
        "firm_rank", "firm_id", "firm_name", "kw_lower", F.coalesce("_t", F.substring("kw_lower", F.lit(1), gram)).alias("anchor"),
        F.when(F.col("_t").isNull(), gram).otherwise(0).alias("gram"))


def _text_grams(low: Column, lengths: list[int]) -> Column:
    """Distinct character grams of the given lengths."""
    n = F.length(low)

    def grams(k: int) -> Column:
        at = F.when(n >= k, F.sequence(F.lit(1), n - k + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.substring(low, i, F.lit(k)))
    return F.array_distinct(F.concat(*[grams(k) for k in lengths]))


def firm_hits(docs: DataFrame, firms: DataFrame, id_col: str = "id", text_col: str = "extracted_text") -> DataFrame:
    """Distinct (_id, firm_rank, firm_id, firm_name) of the firms of which a text holds a keyword."""
    d = docs.select(F.col(id_col).alias("_id"), F.lower(text_col).alias("_low")).where(F.col("_low").isNotNull())
    anchors = materialize(keyword_anchors(firms))
    size = anchors.agg(F.sum(F.octet_length("kw_lower") + F.octet_length("anchor") + 64)).first()[0] or 0
    # Grams only of the lengths that some keyword needs (at most GRAM rows), none if none does.
    lengths = sorted(r["gram"] for r in anchors.where("gram > 0").select("gram").distinct().collect())
    tokens = F.explode(F.array_distinct(F.split("_low", SEPARATORS))).alias("anchor")
    grams = F.explode(_text_grams(F.col("_low"), lengths)).alias("anchor") if lengths else None
    if size <= SMALL_ANCHORS:
        d = d.where(F.col("_id").isNotNull())
        held = d.select("_id", "_low", tokens).join(F.broadcast(anchors.where("gram = 0")), "anchor")
        if lengths:
            held = held.unionByName(d.select("_id", "_low", grams).join(F.broadcast(anchors.where("gram > 0")), "anchor"))
        held = held.where(F.instr(F.col("_low"), F.col("kw_lower")) > 0)
        return held.select("_id", "firm_rank", "firm_id", "firm_name").distinct()
    cols = ["_id", "firm_rank", "firm_id", "firm_name", "kw_lower"]
    pairs = d.select("_id", tokens).join(anchors.where("gram = 0"), "anchor").select(*cols)
    if lengths:
        pairs = pairs.unionByName(d.select("_id", grams).join(anchors.where("gram > 0"), "anchor").select(*cols))
    pairs = pairs.withColumnRenamed("_id", "_hit_id")
    held = d.join(pairs, F.col("_id") == F.col("_hit_id")).where(F.instr(F.col("_low"), F.col("kw_lower")) > 0)
    return held.select("_id", "firm_rank", "firm_id", "firm_name").distinct()


def detect_firm(docs: DataFrame, firms: DataFrame, id_col: str = "id",
                text_col: str = "extracted_text") -> DataFrame:
    """Adds law_firm_id / law_firm_name: the first firm (by firm_rank) with any keyword that is a
    case-insensitive substring of the text; null when none hits or text is null."""
    best = (firm_hits(docs, firms, id_col, text_col).groupBy("_id")
            .agg(F.min_by(F.struct("firm_id", "firm_name"), F.struct("firm_rank", "firm_id")).alias("_b")))
    return (docs.join(best, F.col(id_col) == F.col("_id"), "left")
            .select(*docs.columns, F.col("_b.firm_id").alias("law_firm_id"), F.col("_b.firm_name").alias("law_firm_name")))


def detect_all_firms(docs: DataFrame, firms: DataFrame, id_col: str = "id",
                     text_col: str = "extracted_text") -> DataFrame:
    """Adds firms_matched (firm ids in firm order) and default_firm (the first)."""
    agg = firm_hits(docs, firms, id_col, text_col).groupBy("_id").agg(
        F.sort_array(F.collect_set(F.struct("firm_rank", "firm_id")))["firm_id"].alias("_f"))
    matched = F.coalesce("_f", F.array().cast("array<string>"))
    return (docs.join(agg, F.col(id_col) == F.col("_id"), "left")
            .select(*docs.columns, matched.alias("firms_matched"), F.get(matched, 0).alias("default_firm")))


def keyword_counts(firms: DataFrame) -> DataFrame:
    """Keywords per firm plus a grand-total row (rollup): firm_id null on the total row."""
    return (firms.rollup("id").agg(F.sum(F.size("keywords")).cast("bigint").alias("n_keywords"))
            .withColumnRenamed("id", "firm_id"))


# Fixed values that must equal the reference: system prompt per contract type.
SYSTEM_PROMPTS = {
    "default": "You are a legal contract review expert. Your task is to analyze contract sections and "
               "provide detailed, professional review comments. Focus on identifying potential risks, "
               "ambiguities, and areas that need clarification or modification.",
    "purchase_agreement": "You are a legal expert specializing in purchase agreements. Analyze the contract "
                          "sections for potential risks, payment terms, delivery conditions, and warranty "
                          "clauses. Provide detailed professional review comments.",
    "service_agreement": "You are a legal expert specializing in service agreements. Review the contract "
                         "sections focusing on service levels, performance metrics, liability limitations, "
                         "and termination clauses. Provide comprehensive professional analysis.",
    "employment_contract": "You are a legal expert specializing in employment contracts. Examine the contract "
                           "sections for compliance with labor laws, compensation terms, confidentiality "
                           "clauses, and termination procedures. Provide detailed legal review.",
    "nda": "You are a legal expert specializing in non-disclosure agreements. Analyze the contract sections "
           "for scope of confidentiality, permitted disclosures, duration of obligations, and enforcement "
           "mechanisms. Provide thorough legal analysis.",
}


def prompt_for(type_col, prompts: dict = SYSTEM_PROMPTS) -> Column:
    """Lower-cased contract type -> system prompt, default prompt otherwise.  The prompt table is
    a fixed handful of entries, so it is a map literal (a lookup without any join)."""
    m = F.create_map(*[x for k, v in prompts.items() for x in (F.lit(k), F.lit(v))])
    c = F.col(type_col) if isinstance(type_col, str) else type_col
    return F.coalesce(F.try_element_at(m, F.lower(c)), F.lit(prompts["default"]))
