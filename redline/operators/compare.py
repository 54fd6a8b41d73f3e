"""Template pairing and document comparison.

Pairing is an equi join on the firm with a residual predicate, so the hash key survives and
the disjunction only filters within a firm.  The relational line diff works on *counted*
lines: every document's lines are reduced to (doc, line, n) first (map-side combine, so a
document that repeats a line a million times ships one row), and only then joined per pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _untyped(c):
    return c.isNull() | (c == "")


def pair_templates(contracts: DataFrame, templates: DataFrame) -> DataFrame:
    """contracts(id, law_firm_id, document_type) x templates(id, law_firm_id, template_type).

    Typed contract -> templates of the same type; untyped -> all but legal_comments; a contract
    without any matching template is kept with null template columns."""
    c = contracts.select(F.col("id").alias("contract_id"), F.col("law_firm_id"),
                         F.col("document_type").alias("contract_type"))
    t = templates.select(F.col("id").alias("template_id"), F.col("law_firm_id").alias("t_firm"),
                         "template_type", F.col("file_name").alias("template_filename"))
    cond = ((c["law_firm_id"] == t["t_firm"]) &
            ((c["contract_type"] == t["template_type"]) |
             (_untyped(c["contract_type"]) & (t["template_type"] != "legal_comments"))))
    # Contracts without a firm have no partner: they stay out of the join and its shuffle.
    known = c.where(F.col("law_firm_id").isNotNull()).join(t, cond, "left").drop("t_firm")
    none = c.where(F.col("law_firm_id").isNull()).select("*", *[F.lit(None).cast(t.schema[x].dataType).alias(x)
                                                              for x in ("template_id", "template_type", "template_filename")])
    return known.unionByName(none)


def legal_comments(templates: DataFrame) -> DataFrame:
    """First legal_comments template per firm (by created_at, id) -> one comment record; templates
    whose content is blank give none."""
    t = (templates.where(F.col("template_type") == "legal_comments")
         .groupBy("law_firm_id")
         .agg(F.min_by(F.struct("id", "file_name", "content"), F.struct("created_at", "id")).alias("f")))
    return (t.where(F.length(F.trim("f.content")) > 0)
            .select("law_firm_id", F.col("f.id").alias("template_id"), F.col("f.file_name").alias("template_filename"),
                    F.trim("f.content").alias("comment"), F.lit("Legal Comments").alias("section"),
                    F.lit("info").alias("severity")))


def _line_counts(df: DataFrame, id_col: str, text_col: str, out_id: str) -> DataFrame:
    return (df.select(F.col(id_col).alias(out_id), F.explode(F.split(F.col(text_col), "\n")).alias("line"))
            .groupBy(out_id, "line").agg(F.count(F.lit(1)).alias("n")))


def line_diff(pairs: DataFrame, contracts: DataFrame, templates: DataFrame) -> DataFrame:
    """Multiset line difference per (contract, template) pair.

    One row per unmatched line occurrence: type 'removed' (in the template, not the contract) or
    'added' (in the contract, not the template), occurrence = 1-based copy number beyond the
    matched copies."""
    p = pairs.where(F.col("template_id").isNotNull()).select("contract_id", "template_id").distinct()
    # Only documents that take part in a pair are split into lines.
    used_c = contracts.join(p.select(F.col("contract_id").alias("id")), "id", "left_semi")
    used_t = templates.join(p.select(F.col("template_id").alias("id")), "id", "left_semi")
    cl = _line_counts(used_c, "id", "extracted_text", "contract_id")
    tl = _line_counts(used_t, "id", "content", "template_id")
    pc = p.join(cl, "contract_id").withColumnRenamed("n", "n_c")
    pt = p.join(tl, "template_id").withColumnRenamed("n", "n_t")
    both = pc.join(pt, ["contract_id", "template_id", "line"], "full_outer")
    n_c = F.coalesce("n_c", F.lit(0))
    n_t = F.coalesce("n_t", F.lit(0))
    d = both.select("contract_id", "template_id", "line", n_c.alias("n_c"), n_t.alias("n_t"))
    rem = d.where(F.col("n_t") > F.col("n_c")).select(
        "contract_id", "template_id", F.lit("removed").alias("type"), F.col("line").alias("content"),
        F.explode(F.sequence(F.col("n_c") + 1, F.col("n_t"))).alias("occurrence"))
    add = d.where(F.col("n_c") > F.col("n_t")).select(
        "contract_id", "template_id", F.lit("added").alias("type"), F.col("line").alias("content"),
        F.explode(F.sequence(F.col("n_t") + 1, F.col("n_c"))).alias("occurrence"))
    return rem.unionByName(add).withColumn("occurrence", F.col("occurrence").cast("bigint"))


def diff_counts(pairs: DataFrame, diffs: DataFrame) -> DataFrame:
    """Per pair: removed / added / total differences and a `differs` flag; pairs with no
    difference keep zero counts (left join from the pairs)."""
    agg = diffs.groupBy("contract_id", "template_id").agg(
        F.count_if(F.col("type") == "removed").alias("n_removed"),
        F.count_if(F.col("type") == "added").alias("n_added"))
    p = pairs.where(F.col("template_id").isNotNull()).select("contract_id", "template_id").distinct()
    out = p.join(agg, ["contract_id", "template_id"], "left")
    r = F.coalesce("n_removed", F.lit(0)).cast("bigint")
    a = F.coalesce("n_added", F.lit(0)).cast("bigint")
    return out.select("contract_id", "template_id", r.alias("n_removed"), a.alias("n_added"),
                      (r + a).alias("n_differences"), ((r + a) > 0).alias("differs"))


def contract_deviation(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """Per contract: firm, comparisons made, total differences (zero-pair contracts kept)."""
    per = counts.groupBy("contract_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_comparisons"),
        F.sum("n_differences").cast("bigint").alias("total_differences"),
        F.max("n_differences").cast("bigint").alias("max_differences"))
    base = pairs.select("contract_id", "law_firm_id", "contract_type").distinct()
    out = base.join(per, "contract_id", "left")
    return out.select("contract_id", "law_firm_id", "contract_type",
                      F.coalesce("n_comparisons", F.lit(0)).cast("bigint").alias("n_comparisons"),
                      F.coalesce("total_differences", F.lit(0)).cast("bigint").alias("total_differences"),
                      F.coalesce("max_differences", F.lit(0)).cast("bigint").alias("max_differences"))


def comment_report(pairs: DataFrame, diffs: DataFrame, shared: DataFrame) -> DataFrame:
    """One report per contract with a detected firm: the firm's shared (legal) comments, and the
    nested comparisons [{template, type, differences[...]}].  A contract with no template to compare
    against is a failed report.  Nesting is two bounded collect_lists: differences of one pair,
    comparisons of one contract."""
    per_pair = diffs.groupBy("contract_id", "template_id").agg(
        F.sort_array(F.collect_list(F.struct("type", "content", "occurrence"))).alias("differences"))
    p = pairs.where(F.col("template_id").isNotNull()).select("contract_id", "template_id", "template_type") \
        .join(per_pair, ["contract_id", "template_id"], "left") \
        .withColumn("differences", F.coalesce("differences", F.array().cast(per_pair.schema["differences"].dataType)))
    per_contract = p.groupBy("contract_id").agg(
        F.sort_array(F.collect_list(F.struct("template_id", "template_type", "differences"))).alias("comparisons"))
    base = pairs.select("contract_id", "law_firm_id", "contract_type").distinct()
    sc = shared.groupBy("law_firm_id").agg(
        F.sort_array(F.collect_list(F.struct("template_id", "comment", "section", "severity"))).alias("shared_comments"))
    out = base.join(per_contract, "contract_id", "left").join(sc, "law_firm_id", "left")
    comps = F.coalesce("comparisons", F.array().cast(per_contract.schema["comparisons"].dataType))
    shc = F.coalesce("shared_comments", F.array().cast(sc.schema["shared_comments"].dataType))
    n_diff = F.aggregate(comps, F.lit(0).cast("bigint"), lambda a, c: a + F.size(c["differences"]))
    return out.select(
        "contract_id", "law_firm_id", F.size(shc).cast("bigint").alias("n_shared_comments"),
        F.size(comps).cast("bigint").alias("n_comparisons"), n_diff.alias("n_differences"),
        (F.size(comps) == 0).alias("failed"),
        F.to_json(F.struct(F.col("contract_id").alias("contract_file_id"), F.col("law_firm_id"),
                           shc.alias("comments"),
                           F.array(F.struct(F.col("contract_id").alias("file"),
                                            F.coalesce("contract_type", F.lit("")).alias("document_type"),
                                            comps.alias("comparisons"))).alias("document_comparisons"))).alias("report"))


def comment_requests(requests: DataFrame, files: DataFrame, firms: DataFrame, templates: DataFrame) -> DataFrame:
    """One report per request over a list of contracts, against the templates of the request's firm.

    requests(request_id, law_firm_id, file_ids); files(id, filename, document_type, extracted_text);
    firms(id, name).  Unknown file ids are skipped; an unknown firm, or one without templates, fails
    the request.  A pair of contract and template is compared once, whatever the number of requests
    that name it.  Output: request_id, law_firm_id, law_firm_name, status, error, n_files,
    n_comparisons, n_differences and the nested report as JSON (null for a failed request).
    Lists are bounded by a request's files, a firm's templates and a pair's lines."""
    has_templates = templates.select(F.col("law_firm_id").alias("_tf")).distinct()
    r = (requests.join(firms.select(F.col("id").alias("_f"), F.col("name").alias("law_firm_name")), F.col("law_firm_id") == F.col("_f"), "left")
         .join(has_templates, F.col("law_firm_id") == F.col("_tf"), "left"))
    error = (F.when(F.col("_f").isNull(), "Law firm not found")
             .when(F.col("_tf").isNull(), F.concat(F.lit("No templates found for law firm: "), "law_firm_name")))
    r = r.select("request_id", "law_firm_id", "law_firm_name", error.alias("error"), "file_ids")
    f = files.select(F.col("id").alias("file_id"), "filename", F.coalesce("document_type", F.lit("")).alias("document_type"))
    named = (r.where(F.col("error").isNull()).select("request_id", "law_firm_id", F.posexplode("file_ids").alias("pos", "file_id"))
             .join(f, "file_id"))
    asked = named.select(F.col("file_id").alias("id"), "law_firm_id", "document_type").distinct()
    pairs = pair_templates(asked, templates).where(F.col("template_id").isNotNull())
    diffs = line_diff(pairs, files, templates)
    listed = diffs.groupBy("contract_id", "template_id").agg(
        F.sort_array(F.collect_list(F.struct("type", "content", "occurrence"))).alias("differences"))
    none = F.array().cast("array<struct<type:string,content:string,occurrence:bigint>>")
    per_pair = (pairs.select("contract_id", "law_firm_id", "template_id", "template_type", "template_filename")
                .join(listed, ["contract_id", "template_id"], "left")
                .withColumn("differences", F.coalesce("differences", none)))
    per_file = per_pair.groupBy("contract_id", "law_firm_id").agg(F.sort_array(F.collect_list(
        F.struct("template_id", "template_type", "template_filename", "differences"))).alias("comparisons"))
    no_comparison = F.array().cast(per_file.schema["comparisons"].dataType)
    c, n = per_file.alias("c"), named.alias("n")
    parts = (n.join(c, (F.col("n.file_id") == F.col("c.contract_id")) & (F.col("n.law_firm_id") == F.col("c.law_firm_id")), "left")
             .select("n.request_id", F.struct(
                 "n.pos", F.col("n.file_id").alias("contract_file_id"), F.col("n.filename").alias("contract_filename"),
                 "n.document_type", F.coalesce("c.comparisons", no_comparison).alias("comparisons")).alias("part")))
    per_request = parts.groupBy("request_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    shared = legal_comments(templates).select(F.col("law_firm_id").alias("_lf"), F.struct(
        F.col("template_id").alias("legal_comments_template_id"), F.col("template_filename").alias("legal_comments_template_filename"),
        "comment", "section", "severity").alias("shared"))
    out = r.join(per_request, "request_id", "left").join(shared, F.col("law_firm_id") == F.col("_lf"), "left")
    parts = F.coalesce("parts", F.array().cast(per_request.schema["parts"].dataType))
    comments = F.when(F.col("shared").isNull(), F.array().cast("array<struct<comment:string,section:string,severity:string>>")) \
        .otherwise(F.array(F.struct("shared.comment", "shared.section", "shared.severity")))
    n_comparisons = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: a + F.size(x["comparisons"]))
    n_differences = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: a + F.aggregate(
        x["comparisons"], F.lit(0).cast("bigint"), lambda b, y: b + F.size(y["differences"])))
    report = F.to_json(F.struct(
        F.transform(parts, lambda x: F.struct(x["contract_file_id"].alias("file_id"), x["contract_filename"].alias("filename"),
                                              x["document_type"].alias("document_type"))).alias("contract_files"),
        "law_firm_id", "law_firm_name", comments.alias("comments"),
        F.coalesce("shared.legal_comments_template_id", F.lit("")).alias("legal_comments_template_id"),
        F.coalesce("shared.legal_comments_template_filename", F.lit("")).alias("legal_comments_template_filename"),
        F.transform(parts, lambda x: x.dropFields("pos")).alias("document_comparisons")))
    ok = F.col("error").isNull()
    return out.select("request_id", "law_firm_id", "law_firm_name", F.when(ok, "completed").otherwise("failed").alias("status"),
                      "error", F.size(parts).cast("bigint").alias("n_files"), n_comparisons.alias("n_comparisons"),
                      n_differences.alias("n_differences"), F.when(ok, report).alias("report"))
