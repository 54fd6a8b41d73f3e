"""File sources and sinks: DOCX extraction from generated files, manifests, JSON/JSONL loading."""

import json
import os
import tempfile
import zipfile

from pyspark.sql import functions as F

from redline.operators import loader as L
from redline.sources import files as S
from redline.sources.scratch import scratch_path

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def _para(text):
    return f'<w:p><w:r><w:t xml:space="preserve">{text}</w:t></w:r></w:p>'


def make_docx(path, paragraphs, table=None):
    body = "".join(_para(p) for p in paragraphs)
    if table:
        rows = "".join("<w:tr>" + "".join(f"<w:tc>{_para(c)}</w:tc>" for c in row) + "</w:tr>" for row in table)
        body += f"<w:tbl>{rows}</w:tbl>"
    xml = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", xml)


def test_docx_extraction_and_manifest(spark):
    d = tempfile.mkdtemp(prefix="redline-docx-", dir="/tmp")
    make_docx(os.path.join(d, "Review Comments.docx"), ["1.1 Payment is late", "  second line  "],
              table=[["a", "b"], ["c", "d"]])
    make_docx(os.path.join(d, "empty.DOCX"), [])
    with open(os.path.join(d, "broken.docx"), "wb") as f:
        f.write(b"not a zip")
    with open(os.path.join(d, "notes.txt"), "w") as f:
        f.write("ignored")
    man = S.file_manifest(spark, d)
    assert sorted(r.filename for r in man.collect()) == ["Review Comments.docx", "broken.docx", "empty.DOCX"]
    files = spark.read.format("binaryFile").load(d)
    got = {os.path.basename(r.path): (r.extracted_text, r.error) for r in S.extract_docx(files).collect()}
    assert got["Review Comments.docx"] == ("1.1 Payment is late\n  second line  \na b \nc d", None)
    assert got["empty.DOCX"] == ("", None)
    assert got["broken.docx"][0] is None and got["broken.docx"][1].startswith("BadZipFile")
    assert got["notes.txt"] == (None, "unsupported file type")


def test_load_examples_jsonl_and_json_shapes(spark):
    d = tempfile.mkdtemp(prefix="redline-json-", dir="/tmp")
    with open(os.path.join(d, "a.jsonl"), "w") as f:
        f.write('{"messages": [{"role": "user", "content": "hi"}]}\n{bad json\n{}\n\n{"text": "plain text line"}\n')
    with open(os.path.join(d, "b.json"), "w") as f:
        json.dump([{"instruction": "i", "output": "o"}, {"instruction": "j", "output": "p"}], f)
    with open(os.path.join(d, "c.json"), "w") as f:
        json.dump({"chunks": [{"text": "chunk one"}, {"text": "chunk two"}]}, f)
    with open(os.path.join(d, "d.json"), "w") as f:
        json.dump({"text": "single object"}, f)
    paths = [os.path.join(d, n) for n in ["a.jsonl", "b.json", "c.json", "d.json", "missing.jsonl"]]
    recs = L.load_examples(spark, paths)
    by_file = {}
    for r in recs.collect():
        by_file.setdefault(os.path.basename(r.file), []).append(json.loads(r.value))
    assert len(by_file["a.jsonl"]) == 2
    assert [x["instruction"] for x in by_file["b.json"]] == ["i", "j"]
    assert [x["text"] for x in by_file["c.json"]] == ["chunk one", "chunk two"]
    assert by_file["d.json"] == [{"text": "single object"}]
    fmts = {os.path.basename(r.file): r.format for r in L.detect_format(recs).collect()}
    assert fmts == {"a.jsonl": "chat", "b.json": "instruction", "c.json": "text", "d.json": "text"}


def test_load_examples_broken_and_missing_json(spark):
    d = tempfile.mkdtemp(prefix="redline-json-", dir="/tmp")
    for name, text in (("broken.json", "[{broken"), ("empty.json", "[]"), ("one.json", '{"text": "t"}')):
        with open(os.path.join(d, name), "w") as f:
            f.write(text)
    recs = L.load_examples(spark, [os.path.join(d, n) for n in ("broken.json", "empty.json", "one.json", "missing.json")])
    assert [json.loads(r.value) for r in recs.collect()] == [{"text": "t"}]


def test_scoring_resumes_and_counts_attempts(spark):
    from redline.operators import scoring as B
    from redline.plans.q_scoring import _word_scorer
    r = spark.createDataFrame([(i, "w " * i + "x") for i in range(40)] + [(100, None), (101, "  ")], "id long, prompt string")
    log = scratch_path(spark, "score-test")
    first = B.resumable_score(r.where("id < 20"), log, _word_scorer, "bigint", slots=4)
    assert first.count() == 20
    # A round that was not written to its end does not count.
    r.limit(1).write.parquet(f"{log}/round=9")
    os.remove([os.path.join(log, "round=9", n) for n in os.listdir(os.path.join(log, "round=9")) if n == "_SUCCESS"][0])
    tries = B.score_log(spark, log, "bigint", "bigint").count()
    got = {x.id: (x.attempts, x.success, x.error, x.value) for x in B.resumable_score(r, log, _word_scorer, "bigint", slots=4).collect()}
    want = {}
    for i in range(40):
        n = (2 * i + 1) % 7
        want[i] = (3, False, "rejected", None) if n == 0 else (2 if n == 1 else 1, True, None, i + 1)
    assert got == want
    log_rows = B.score_log(spark, log, "bigint", "bigint")
    assert log_rows.where("id < 20").count() == tries and log_rows.groupBy("id", "attempt").count().where("count > 1").count() == 0
    assert log_rows.select("slot").distinct().count() == 4


def test_jsonl_sink_round_trip(spark):
    df = spark.createDataFrame([(1, "é ü — ok"), (2, 'quote " and \\ slash')], "id long, text string")
    path = scratch_path(spark, "sink-test")
    S.write_jsonl(df, path)
    back = spark.read.schema("id long, text string").json(path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_write_features_formats(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "doc_id long, v array<double>")
    paths = {}
    for fmt in ["json", "csv", "parquet"]:
        paths[fmt] = scratch_path(spark, f"feat-{fmt}")
        S.write_features(df, paths[fmt], fmt)
    assert spark.read.option("header", "true").csv(paths["csv"]).first().v == "[1.0,2.0]"
    assert spark.read.parquet(paths["parquet"]).first().v == [1.0, 2.0]
    assert spark.read.json(paths["json"]).first().v == [1.0, 2.0]
    import pytest
    with pytest.raises(ValueError):
        S.write_features(df, scratch_path(spark, "feat-x"), "xml")


def test_scratch_is_under_checkpoint_dir(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_batch_score_custom_scorer_errors_are_per_row(spark):
    import pandas as pd
    from redline.operators import scoring as B

    def scorer(prompts):
        if any("boom" in p for p in prompts):
            raise RuntimeError("scorer failed")
        return pd.DataFrame({"generated_text": prompts.str.upper(), "finish_reason": "stop",
                             "tokens_generated": prompts.str.split().str.len()})

    df = spark.createDataFrame([(1, "hello there"), (2, "boom now"), (3, "   "), (4, None)], "id long, prompt string")
    got = {r.id: (r.success, r.generated_text, r.error) for r in B.batch_score(df, "prompt", scorer, 2, keep=("id",)).collect()}
    assert got == {1: (True, "HELLO THERE", None), 2: (False, None, "scorer failed")}


def test_manifest_prefix_filter(spark):
    d = tempfile.mkdtemp(prefix="redline-prefix-", dir="/tmp")
    for n in ["ds1_a.pdf", "ds1_b.json", "ds2_a.pdf"]:
        with open(os.path.join(d, n), "w") as f:
            f.write("x")
    got = sorted(r.filename for r in S.file_manifest(spark, d, prefix="ds1_", extensions=None).collect())
    assert got == ["ds1_a.pdf", "ds1_b.json"]


def test_score_udf_in_sql(spark):
    import pandas as pd
    from redline.operators import scoring as B

    def scorer(prompts):
        return pd.DataFrame({"generated_text": prompts.str.upper(), "finish_reason": "stop", "tokens_generated": prompts.str.len()})
    df = spark.createDataFrame([("review this",)], "prompt string")
    spark.udf.register("score_prompt", B.score_udf(scorer))
    df.createOrReplaceTempView("prompts")
    r = spark.sql("SELECT score_prompt(prompt) AS s FROM prompts").first().s
    assert (r.generated_text, r.finish_reason, r.tokens_generated) == ("REVIEW THIS", "stop", 11)


def test_docx_tabs_and_breaks(spark):
    """A file built by hand: tabs and breaks inside runs, a table, text outside the body ignored."""
    import io
    import zipfile
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    xml = (f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Price</w:t><w:tab/><w:t>100</w:t><w:br/><w:t>Net</w:t></w:r>'
           '</w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc>'
           '</w:tr></w:tbl></w:body></w:document>')
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", xml)
    assert S.docx_text(buf.getvalue()) == "Price\t100\nNet\na b"
    assert S.docx_text(buf.getvalue(), tables=False) == "Price\t100\nNet"
