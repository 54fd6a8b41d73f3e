"""Training-example construction.

Reference resolution (E1) is an exact equi join on (project, number) plus a fallback "first
section whose number contains the reference".  The fallback is answered without a theta join:
every section number is indexed under each of its substrings (numbers are a few characters, so
the index is a small constant factor of the sections table), and the reference equi-joins that
index.  No project-wide pairs are ever formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redline.operators.detect import SYSTEM_PROMPTS
from redline.operators.sections import section_key

# Fixed values that must equal the reference: prompts of the two example builders.
SYSTEM_PROMPT = SYSTEM_PROMPTS["default"]
SYSTEM_PROMPT_PROJECT = (
    "You are an expert legal contract reviewer specializing in real estate transactions. Your role is to "
    "analyze contract sections and provide detailed, professional review comments that identify potential "
    "risks, ambiguities, and areas requiring clarification or modification. Focus on practical legal "
    "concerns that could affect the parties involved.")


def substrings(c: Column) -> Column:
    """All distinct non-empty substrings of a (short) string."""
    n = F.length(c)
    return F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, n), lambda j: F.substring(c, i, j - i + 1)))))


def _ordered_join(df: DataFrame, keys: list, order: str, value: str, sep: str, name: str) -> DataFrame:
    return (df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("_p"))
            .select(*keys, F.array_join(F.col("_p")[value], sep).alias(name)))


def ref_context(comments: DataFrame, sections: DataFrame, key=("review_id", "comment_idx")) -> DataFrame:
    """(key..., context): per reference in order, the exact section ``Section n:\\nbody``, else the
    first section (by position) whose number contains the reference, else nothing; parts joined by
    a blank line.  Comments without references are not returned."""
    key = list(key)
    r = comments.select(*key, "project", F.posexplode("refs").alias("ref_pos", "ref"))
    s = sections.select("project", "section_num", "section_text", "first_pos")
    # Per project and reference one section number (the reference itself, or the first number that
    # contains it), before any comment is joined; section texts are fetched last.
    idx = (s.select("project", F.explode(substrings(F.col("section_num"))).alias("ref"), "section_num", "first_pos")
           .groupBy("project", "ref")
           .agg(F.max(F.col("section_num") == F.col("ref")).alias("exact"), F.min_by("section_num", "first_pos").alias("first")))
    idx = idx.select("project", "ref", F.when(F.col("exact"), F.col("ref")).otherwise(F.col("first")).alias("section_num"))
    parts = (r.join(idx, ["project", "ref"]).join(s.drop("first_pos"), ["project", "section_num"])
             .select(*key, "ref_pos",
                     F.concat(F.lit("Section "), F.col("section_num"), F.lit(":\n"), F.col("section_text")).alias("part")))
    ctx = _ordered_join(parts, key, "ref_pos", "part", "\n\n", "context")
    with_refs = comments.where(F.size("refs") > 0).select(*key)
    return with_refs.join(ctx, key, "left").select(*key, F.coalesce("context", F.lit("")).alias("context"))


def ref_context_exact(comments: DataFrame, sections: DataFrame, key=("review_id", "pos")) -> DataFrame:
    """Exact hits only, each ``Section n: body``; comments with no resolvable reference are dropped."""
    key = list(key)
    r = comments.where(F.col("has_section_refs")).select(*key, "project", F.posexplode("refs").alias("ref_pos", "ref"))
    s = sections.select("project", F.col("section_num").alias("ref"), "section_text")
    parts = r.join(s, ["project", "ref"]).select(
        *key, "ref_pos", F.concat(F.lit("Section "), F.col("ref"), F.lit(": "), F.col("section_text")).alias("part"))
    return _ordered_join(parts, key, "ref_pos", "part", "\n\n", "context")


def general_context(sections: DataFrame, k: int = 5, numeric_order: bool = True, sep_line: bool = True) -> DataFrame:
    """Per project: the first k sections (numeric section order, or insertion order) as context.
    The window partition is one project's sections, i.e. those of its two chosen documents."""
    order = [section_key("section_num"), "first_pos"] if numeric_order else ["first_pos"]
    w = Window.partitionBy("project").orderBy(*order)
    top = sections.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= k)
    sep = ":\n" if sep_line else ": "
    top = top.select("project", "_rk", F.concat(F.lit("Section "), "section_num", F.lit(sep), "section_text").alias("part"))
    return _ordered_join(top, ["project"], "_rk", "part", "\n\n", "context")


def _messages(system: Column, user: Column, assistant: Column) -> Column:
    return F.array(F.struct(F.lit("system").alias("role"), system.alias("content")),
                   F.struct(F.lit("user").alias("role"), user.alias("content")),
                   F.struct(F.lit("assistant").alias("role"), assistant.alias("content")))


def chat_examples(comments: DataFrame, sections: DataFrame, key=("review_id", "comment_idx")) -> DataFrame:
    """First builder: every comment becomes [system, user, assistant]; referenced comments get the
    reference context, others the general context (first 5 sections in numeric order)."""
    key = list(key)
    rc = ref_context(comments, sections, key)
    gc = general_context(sections, 5).withColumnRenamed("context", "gctx")
    c = comments.join(rc, key, "left").join(gc, "project", "left")
    has = F.size("refs") > 0
    user = F.when(has, F.concat(F.lit("Please review section(s) "), F.array_join("refs", ", "),
                                F.lit(" of this contract:\n\n"), F.coalesce("context", F.lit(""))))\
        .otherwise(F.concat(F.lit("Please review this contract and provide professional comments:\n\n"),
                            F.coalesce("gctx", F.lit(""))))
    return c.select(*key, "project", _messages(F.lit(SYSTEM_PROMPT), user, F.col("comment")).alias("messages"))


def chat_examples_project(comments: DataFrame, sections: DataFrame, key=("review_id", "pos")) -> DataFrame:
    """Second builder: referenced comments need an exact hit (else dropped); general comments get
    the first 3 sections by position (dropped when the project has none); prompts name the project."""
    key = list(key)
    rc = ref_context_exact(comments, sections, key)
    gc = general_context(sections, 3, numeric_order=False, sep_line=False).withColumnRenamed("context", "gctx")
    refd = comments.where(F.col("has_section_refs") & (F.size("refs") > 0)).join(rc, key)
    gen = comments.where(~(F.col("has_section_refs") & (F.size("refs") > 0))).join(gc, "project")
    u1 = F.concat(F.lit("Please review the following contract section(s) from the "), F.col("project"),
                  F.lit(" project:\n\n"), F.col("context"))
    u2 = F.concat(F.lit("Please provide a general review of this contract from the "), F.col("project"),
                  F.lit(" project:\n\n"), F.col("gctx"))
    a = refd.select(*key, "project", _messages(F.lit(SYSTEM_PROMPT_PROJECT), u1, F.col("comment")).alias("messages"))
    b = gen.select(*key, "project", _messages(F.lit(SYSTEM_PROMPT_PROJECT), u2, F.col("comment")).alias("messages"))
    return a.unionByName(b)


def example_json(messages: Column) -> Column:
    """JSON text of one example; we measure lengths on Spark's compact ``to_json`` encoding."""
    return F.to_json(F.struct(messages.alias("messages")))


def dataset_summary(examples: DataFrame) -> DataFrame:
    """Totals over examples: count, JSON characters, mean length, estimated tokens (chars div 4)."""
    n = F.length(example_json(F.col("messages")))
    g = examples.agg(F.count(F.lit(1)).cast("bigint").alias("total_examples"),
                     F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("total_dataset_size"))
    return g.select("total_examples", "total_dataset_size",
                    F.round(F.when(F.col("total_examples") > 0, F.col("total_dataset_size") / F.col("total_examples"))
                            .otherwise(F.lit(0.0)), 6).alias("average_example_length"),
                    F.floor(F.col("total_dataset_size") / 4).cast("bigint").alias("estimated_tokens"))


def example_counts(examples: DataFrame) -> DataFrame:
    """Examples per project plus the grand total (project null)."""
    return examples.rollup("project").agg(F.count(F.lit(1)).cast("bigint").alias("n_examples"))
