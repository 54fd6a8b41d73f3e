"""Derived views that map the corpus tables onto the contract-review data model.

The same definitions exist as DuckDB SQL in ``redline.plans.views_sql`` so the oracle sees
identical inputs.  All views are narrow projections / aggregations of the base tables, so
their size grows with the data and Catalyst prunes and pushes through them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redline.sources.tables import table

EPOCH = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"


def contract_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> uploaded contract files (id, filename, size, text, type, upload time)."""
    d = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    m4 = F.expr("(doc_id div 3) % 4")
    ext = (F.when(m4 == 0, ".pdf").when(m4 == 1, ".PDF").when(m4 == 2, ".docx")
           .otherwise(".txt"))
    doc_type = (F.when(m4 == 0, "purchase_agreement").when(m4 == 1, "rider")
                .when(m4 == 3, "legal_comments"))
    return d.select(
        F.col("doc_id").cast("string").alias("id"),
        "doc_id",
        F.concat(F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), ext).alias("filename"),
        F.octet_length("text").cast("bigint").alias("size_bytes"),
        F.col("text").alias("extracted_text"),
        F.col("source").alias("project"),
        "lang",
        doc_type.alias("document_type"),
        F.expr(f"{EPOCH} + make_dt_interval(0, 0, CAST(doc_id AS INT), 0)").alias("uploaded_at"),
        (m4 != 3).alias("processed"),
    )


def _firm_number():
    """Five benchmark passages make a firm, so firms grow with the table."""
    return F.expr("item_id div 5").cast("int")


def law_firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark -> firms of five items each; keywords = the whole passages of its items."""
    b = table(spark, sf_dir, "benchmark", "item_id", "text")
    g = (b.groupBy(_firm_number().alias("firm_rank"))
         .agg(F.sort_array(F.collect_list(F.struct("item_id", F.col("text").alias("kw")))).alias("kws")))
    return g.select(
        F.concat(F.lit("firm_"), F.col("firm_rank").cast("string")).alias("id"),
        F.concat(F.lit("Firm "), F.col("firm_rank").cast("string")).alias("name"),
        F.col("kws.kw").alias("keywords"),
        F.expr(f"{EPOCH} + make_dt_interval(firm_rank, 0, 0, 0)").alias("created_at"),
        "firm_rank",
    )


def contract_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark", "item_id", "text")
    m3 = F.col("item_id") % 3
    firm = _firm_number().cast("string")
    return b.select(
        F.concat(F.lit("tpl_"), F.col("item_id").cast("string")).alias("id"),
        F.concat(F.lit("firm_"), firm).alias("law_firm_id"),
        F.concat(F.lit("Firm "), firm).alias("law_firm_name"),
        F.when(m3 == 0, "purchase_agreement").when(m3 == 1, "rider")
         .otherwise("legal_comments").alias("template_type"),
        F.concat(F.lit("template_"), F.col("item_id").cast("string"), F.lit(".docx")).alias("file_name"),
        F.col("text").alias("content"),
        F.expr(f"{EPOCH} + make_dt_interval(0, CAST(item_id AS INT), 0, 0)").alias("created_at"),
    )


def sectioned_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sentence as a numbered paragraph, ten to a chapter; chapter numbers start again after five,
    so numbers repeat within long documents and between the files of a project.  Full stops become the
    paragraph breaks, line feeds blanks; nothing else is changed."""
    d = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    body = F.expr("""array_join(transform(filter(split(translate(text, '\\n', ' '), '[.]'), s -> trim(s) <> ''),
        (s, i) -> concat(CAST(i div 10 % 5 + 1 AS STRING), '.', CAST(i % 10 + 1 AS STRING), ' ', s)), '\\n')""")
    return d.select("doc_id", F.col("source").alias("project"), body.alias("text"))


def comment_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is one reviewer document; every third turn cites a section."""
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    para = F.when(F.col("turn") % 3 == 2,
                  F.concat(F.lit("Section 1."), F.col("turn").cast("string"), F.lit(": "), F.col("text"))
                  ).otherwise(F.col("text"))
    return (c.groupBy("conv_id")
            .agg(F.sort_array(F.collect_list(F.struct("turn", para.alias("p")))).alias("ps"))
            .select(F.col("conv_id").alias("project_id"),
                    F.array_join("ps.p", "\n").alias("text")))


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations -> one chat example per conversation: ordered messages array."""
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return (c.groupBy("conv_id")
            .agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
                 .alias("t"))
            .select(F.col("conv_id").alias("line_no"),
                    F.expr("transform(t, m -> named_struct('role', m.role, 'content', m.content))")
                    .alias("messages")))


def _status(col: str = "event_type"):
    return (F.when(F.col(col) == "purchase", "completed").when(F.col(col) == "error", "failed")
            .otherwise("processing"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    status = _status()
    done = status.isin("completed", "failed")
    return e.select(
        F.concat(F.lit("rev_"), F.col("event_id").cast("string")).alias("id"),
        "event_id",
        F.array(F.concat(F.lit("contract_"), F.col("user_id").cast("string"), F.lit(".pdf")),
                F.concat(F.lit("annex_"), (F.col("event_id") % 7).cast("string"), F.lit(".docx")))
        .alias("contract_files"),
        F.concat(F.lit("model_"), (F.col("user_id") % 3).cast("string")).alias("model_id"),
        F.concat(F.lit("Firm "), (F.col("user_id") % 8).cast("string")).alias("law_firm_name"),
        status.alias("status"),
        F.col("ts").alias("created_at"),
        F.when(done, F.expr("ts + make_dt_interval(0, 0, 0, CAST(value AS DECIMAL(18,6)))"))
        .alias("completed_at"),
        F.when(done, F.col("value")).alias("processing_time"),
    )


def review_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    status = (F.when(F.col("event_type") == "click", "completed")
              .when(F.col("event_type") == "error", "failed").otherwise("processing"))
    return e.select(
        F.concat(F.lit("cmt_"), F.col("event_id").cast("string")).alias("id"),
        "event_id",
        F.col("user_id").cast("string").alias("contract_file_id"),
        F.concat(F.lit("firm_"), (F.col("user_id") % 8).cast("string")).alias("law_firm_id"),
        status.alias("status"),
        F.col("ts").alias("created_at"),
        F.col("value").alias("processing_time"),
    )


def loss_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> training loss log: job = user, step = event id (time ordered), loss = value/100."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    return e.select(
        F.concat(F.lit("job_"), F.col("user_id").cast("string")).alias("job_id"),
        F.col("event_id").alias("step"),
        F.lit("loss").alias("metric"),
        (F.col("value") / 100).alias("value"),
        "ts",
        _status().alias("status"),
    )


def review_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewer documents with their project: conversation c reviews document c, or of each four the
    second and third the first one's; without such a document its project is 'unassigned'."""
    d = table(spark, sf_dir, "documents", "doc_id", "source")
    c = comment_docs(spark, sf_dir)
    return (c.join(d, c["project_id"] - c["project_id"] % 4 % 3 == d["doc_id"], "left")
            .select(F.coalesce("source", F.lit("unassigned")).alias("project"), F.col("project_id").alias("review_id"), "text"))
