"""Physical-plan properties that matter at scale."""

import re

import pytest

from redline.plans.registry import QUERIES, load_all

load_all()
SIDE_EFFECTS = {"read_chat_jsonl", "write_training_jsonl", "write_features", "stream_ingest",
                "stream_status_counts", "stream_latest_job", "read_json_examples"}


def plan(df):
    df._jdf.queryExecution().executedPlan()   # force planning
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SIDE_EFFECTS))
def test_no_cartesian_or_nested_loop_join(spark, sf, name):
    p = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize("name", ["clean_text", "chunk_text", "line_stats",
                                  "extract_sections", "stat_features", "ling_features", "contract_type",
                                  "docx_text"])
def test_per_document_operators_do_not_shuffle(spark, sf, name):
    p = plan(QUERIES[name](spark, sf))
    assert not re.search(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", p)


def test_lookup_pushes_filter_and_prunes_columns(spark, sf):
    df = QUERIES["lookup_by_id"](spark, sf)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_id), EqualTo(event_id,777)]" in p
    assert "props" not in p.split("ReadSchema:")[1].split("\n")[0]


def test_detection_has_one_plan_without_python(spark, sf):
    """Equi joins only and no UDF, for any number of keywords; texts are read with their id alone."""
    from pyspark.sql import functions as F
    from redline.operators import detect as D
    from redline.sources import views as V
    docs = V.contract_files(spark, sf).select("id", "extracted_text")
    many = spark.range(100_000).select(
        F.concat(F.lit("f"), "id").alias("id"), F.lit("n").alias("name"), F.col("id").cast("int").alias("firm_rank"),
        F.array(F.concat(F.lit("the key "), "id", F.lit(" of it"))).alias("keywords"))
    for firms in (V.law_firms(spark, sf), many):
        p = plan(D.detect_firm(docs, firms))
        assert not re.search("Python|NestedLoop|Cartesian", p)
    assert "struct<doc_id:bigint,text:string>" in p


def test_firm_pairing_detects_once(spark, sf):
    p = plan(QUERIES["contract_deviation"](spark, sf))
    assert "regexp_extract_all" not in p and "Python" not in p   # detection is read back, not recomputed


def test_registry_needs_no_spark_jars(tmp_path):
    """queries() and oracle_sql() load where the jars of the Spark package are hidden."""
    import subprocess
    import sys
    code = ("import os, glob, zipfile, pyspark; home = os.path.dirname(pyspark.__file__)\n"
            "hide = lambda f: lambda p, *a, **b: [] if home in str(p) else f(p, *a, **b)\n"
            "glob.glob = hide(glob.glob); os.listdir = hide(os.listdir)\n"
            "class Gone:\n    def __init__(self, *a, **b): raise FileNotFoundError(a)\n"
            "zipfile.ZipFile = Gone\n"
            "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(o) <= set(q)")
    import os
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True).returncode == 0
