"""Properties, hand-worked values and brute-force checks for what the SQL oracle cannot express
(sections of whole texts, chunking, islands, detection by anchors, positions and splits)."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from redline.operators import examples as EX
from redline.operators import loader as L
from redline.operators import sections as X
from redline.operators import text as T
from redline.operators import windows as N
from redline.sources import views as V
from redline.sources.tables import table


# ---- tests --------------------------------------------------------------------------------------------

def _flat(text):
    return re.sub(r"\s+", " ", text)


def test_sections_are_unique_ordered_and_taken_from_the_text(spark, sf):
    for docs in (table(spark, sf, "documents", "doc_id", "text"), V.sectioned_docs(spark, sf)):
        texts = {r.doc_id: _flat(r.text) for r in docs.collect()}
        per_doc = {}
        for r in X.extract_sections(docs).collect():
            per_doc.setdefault(r.doc_id, []).append(r)
            body = r.section_text.removesuffix("...") if len(r.section_text) > 2000 else r.section_text
            assert "." not in body and r.section_num in texts[r.doc_id] and body in texts[r.doc_id]
        for rows in per_doc.values():
            assert sorted(r.first_pos for r in rows) == list(range(len(rows)))
            assert len({r.section_num for r in rows}) == len(rows)


def test_sections_hand_worked(spark):
    text = "1.1 Term\nof lease\n1.2 Rent is due. Late\n2.3Parking: two\nSection 4.1: Keys\n1.1 Term again"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [(r.section_num, r.section_text) for r in X.extract_sections(df).orderBy("first_pos").collect()]
    # First pattern: 1.1 twice (the later text wins, the first place stays); a full stop ends 1.2's
    # hope and 2.3 touches its text.  Second: the body of "Section 4.1" meets the stop of "1.1".
    # Third: 2.3 runs into "Section 4." and fails, 4.1 ends before the next number.
    assert got == [("1.1", "Term again"), ("4.1", "Keys")]


def _check_chunks(text, chunks, size, overlap):
    """Every chunk lies in the text, starts do not fall, no text but white space is left out, and a
    chunk is at most one character over the size."""
    if len(text) <= size:
        assert chunks == [text]
        return
    if any(text.find(c) != text.rfind(c) for c in chunks):
        return   # a text that repeats itself does not tell where a chunk was
    at = end = 0
    for c in chunks:
        assert c and len(c) <= size + 1 and c == c.strip()
        found = text.find(c)
        assert found >= at
        assert found >= 0 and text[end:found].strip() == ""
        at, end = found, max(end, found + len(c))
    assert text[end:].strip() == ""


def test_chunks_cover_documents(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "text")
    got = {}
    for r in T.chunk_text(docs).collect():
        got.setdefault(r.doc_id, []).append((r["index"], r.text))
    for r in docs.collect():
        chunks = sorted(got.get(r.doc_id, []))
        assert [i for i, _ in chunks] == list(range(len(chunks)))
        _check_chunks(r.text, [t for _, t in chunks], 1000, 200)


def test_chunks_hand_worked(spark):
    # 25 characters a sentence; cut after the last full stop within 100 characters of the size.
    text = ("x" * 23 + ". ") * 20
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [r.text for r in T.chunk_text(df, size=300, overlap=50).orderBy("index").collect()]
    # The stop at 298 ends the first chunk; the second begins 50 characters before, at a blank.
    assert got == [text[:299], text[250:499]]


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet="ab .!?\n", min_size=0, max_size=2600), st.sampled_from([(300, 50), (1000, 200), (250, 0)]),
       st.sampled_from([1, 2, 3]))
def test_chunk_blocks_do_not_matter(spark, text, params, block):
    size, overlap = params
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")

    def chunks(**kw):
        return [r.text for r in T.chunk_text(df, size=size, overlap=overlap, **kw).orderBy("index").collect()]
    assert chunks() == chunks(block=block)


def test_comments_keep_order_and_lose_no_paragraph(spark, sf):
    r = V.review_docs(spark, sf).select("review_id", "text")
    got = {}
    for row in X.parse_comments(r, id_col="review_id").collect():
        got.setdefault(row.review_id, []).append((row.comment_idx, row.comment, row.refs))
    for row in r.collect():
        mine = sorted(got.get(row.review_id, []))
        assert [i for i, _, _ in mine] == list(range(len(mine)))
        assert " ".join(c for _, c, _ in mine) == " ".join(p.strip() for p in row.text.split("\n") if p.strip())


def test_ref_context_hand_worked(spark):
    sections = [("p", "2.10.1", "deep", 0), ("p", "1.2", "rent", 1), ("p", "11.2", "keys", 2), ("q", "9.9", "other", 0)]
    comments = [("r", 1, "p", ["1.2"]), ("r", 2, "p", ["10.1", "9.9"]), ("r", 3, "p", ["2.1", "11.2"]), ("r", 4, "p", []),
                ("r", 5, "p", ["1.2", "1.2"])]
    sdf = spark.createDataFrame(sections, "project string, section_num string, section_text string, first_pos int")
    cdf = spark.createDataFrame(comments, "review_id string, comment_idx int, project string, refs array<string>")
    got = {r.comment_idx: r.context for r in EX.ref_context(cdf, sdf).collect()}
    assert got == {1: "Section 1.2:\nrent",                       # exact, although 11.2 holds it too
                   2: "Section 2.10.1:\ndeep",                    # contained; 9.9 is another project's
                   3: "Section 2.10.1:\ndeep\n\nSection 11.2:\nkeys",
                   5: "Section 1.2:\nrent\n\nSection 1.2:\nrent"}


def test_sequence_within_equals_row_number_with_payload(spark):
    d = (spark.range(0, 1_200_000, 1, 7).select(
        (F.col("id") * 7919 % 1_200_000).alias("o"), F.when(F.col("id") % 5 != 0, F.col("id") % 3).alias("g"),
        F.concat(F.lit("payload "), F.xxhash64("id").cast("string")).alias("v")))
    got = L.sequence_within(d, ["g"], ["o"], "seq", bucket_rows=100_000)
    want = d.withColumn("want", F.row_number().over(Window.partitionBy("g").orderBy("o")) - 1)
    both = got.alias("a").join(want.alias("b"), F.col("a.o") == F.col("b.o"))
    bad = both.where((F.col("seq") != F.col("want")) | (F.col("a.v") != F.col("b.v")))
    assert got.count() == 1_200_000 and both.count() == 1_200_000 and bad.count() == 0


def test_sequence_within_other_order_types(spark, sf):
    d = spark.createDataFrame([("a", None), ("a", "x"), ("a", "xy"), ("a", "b"), ("a", "é"), ("b", "x"), (None, "x"), (None, "a")],
                              "g string, o string")
    for col in ("o", "d", "t"):
        x = d.withColumn("d", F.ascii("o").cast("double")).withColumn("t", F.timestamp_seconds(F.ascii("o") * 1000 + F.length("o")))
        order = [col, "o"]
        got = L.sequence_within(x, ["g"], order, bucket_rows=2)
        want = x.withColumn("seq", F.row_number().over(Window.partitionBy("g").orderBy(*order)) - 1)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


def test_exact_split_is_exact_and_partition_independent(spark, sf, monkeypatch):
    d = table(spark, sf, "documents", "doc_id")
    a = L.exact_hash_split(d, "doc_id", 0.1, 42)
    b = L.exact_hash_split(d.repartition(5), "doc_id", 0.1, 42)
    va = sorted(r.doc_id for r in a.where("split = 'validation'").collect())
    vb = sorted(r.doc_id for r in b.where("split = 'validation'").collect())
    n = d.count()
    assert va == vb and len(va) == -(-n // 10)
    monkeypatch.setattr(L, "SPLIT_BUCKET_ROWS", 3)   # many buckets
    assert va == sorted(r.doc_id for r in L.exact_hash_split(d, "doc_id", 0.1, 42).where("split = 'validation'").collect())


def test_running_extremes_across_buckets_equal_window(spark, sf):
    log = V.loss_log(spark, sf).select("job_id", "step", "value")
    got = N.running_extreme(log, "job_id", "step", "value", "best", "min", bucket_width=16)
    want = log.withColumn("best", F.min("value").over(
        Window.partitionBy("job_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    excl = N.running_extreme(log, "job_id", "step", "value", "prev", "max", inclusive=False, bucket_width=8)
    want2 = log.withColumn("prev", F.max("value").over(
        Window.partitionBy("job_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)))
    assert sorted(map(tuple, excl.collect())) == sorted(map(tuple, want2.select(*excl.columns).collect()))


def test_early_stop_matches_python(spark, sf):
    log = V.loss_log(spark, sf).select("job_id", "step", "value")
    got = {r.job_id: (r.stop_step, r.stop_value) for r in N.early_stop(log, 3).collect()}
    series = {}
    for r in log.collect():
        series.setdefault(r.job_id, []).append((r.step, r.value))
    want = {}
    for job, pts in series.items():
        best, streak = None, 0
        for step, v in sorted(pts):
            if best is None or v < best:
                best, streak = v, 0
            else:
                streak += 1
                if streak >= 3:
                    want[job] = (step, v)
                    break
    assert got == want


_PIECES = st.sampled_from(["1.2", "3.4.5", "12.1", " ", "  ", "\t", "\n", "\n\n", ".", ":", "-", "Section ", "section ",
                           "Abc", "DEF", "xy", "Q", "é", " ", " ", "7", "!"])


@settings(max_examples=20, deadline=None)
@given(st.lists(_PIECES, min_size=0, max_size=40).map("".join))
def test_comment_parsing_properties(spark, text):
    """Order is kept and no paragraph is lost; each paragraph with a number is a comment of its own, and
    of two comments in a row at least one has a reference."""
    df = spark.createDataFrame([("p", text)], "project_id string, text string")
    got = [(r.comment, r.refs) for r in X.parse_comments(df).orderBy("comment_idx").collect()]
    paragraphs = [p.strip() for p in text.split("\n") if p.strip()]
    assert " ".join(c for c, _ in got) == " ".join(paragraphs)
    cited = [p for p in paragraphs if re.search(r"\d\.\d", p)]
    assert [c for c, refs in got if refs] == cited
    assert all(a or b for (_, a), (_, b) in zip(got, got[1:]))


def test_comment_parsing_hand_worked(spark):
    text = "  First remark\ngoes on \n\nSee 1.2 and 3.4.5, then 1.2\nPay 2,106.23 now\n last\tline \r\n"
    df = spark.createDataFrame([("p", text), ("q", "\n \n"), ("r", "7.1")], "project_id string, text string")
    got = [(r.project_id, r.comment_idx, r.comment, r.refs) for r in X.parse_comments(df).orderBy("project_id", "comment_idx").collect()]
    assert got == [("p", 0, "First remark goes on", []), ("p", 1, "See 1.2 and 3.4.5, then 1.2", ["1.2", "3.4.5", "1.2"]),
                   ("p", 2, "Pay 2,106.23 now", ["106.23"]), ("p", 3, "last\tline", []), ("r", 0, "7.1", ["7.1"])]


def test_quality_filter_judges_each_review_by_itself(spark):
    """A reference that review A cannot resolve does not touch the comment of the same number in B."""
    sections = spark.createDataFrame([("p", "1.1", "a section of twenty characters"), ("p", "1.2", "short"), ("q", "9.9", "x" * 30)],
                                     "project string, section_num string, section_text string")
    comments = spark.createDataFrame([
        ("A", 0, "see section 9.9 please", ["9.9"], "p"), ("B", 0, "see section 1.1 please", ["1.1"], "p"),
        ("B", 1, "a general remark", [], "p"), ("B", 2, "see the short 1.2", ["1.2"], "p"), ("C", 0, "see 1.1 and 1.1", ["1.1", "1.1"], "p"),
        ("C", 1, "tiny", [], "p"), ("D", 0, "see section 9.9 please", ["9.9"], "q")],
        "review_id string, comment_idx int, comment string, refs array<string>, project string")
    got = sorted((r.review_id, r.comment_idx) for r in X.quality_filter(comments, sections).collect())
    assert got == [("B", 0), ("B", 1), ("C", 0), ("D", 0)]


def test_section_queries_have_work_to_do(spark, sf):
    """Least row counts, so that an input without sections cannot pass for a green query."""
    from redline.plans.registry import QUERIES, load_all
    load_all()
    least = {"extract_sections": 3000, "extract_sections_strict": 2000, "section_sort": 3000, "project_sections": 200,
             "quality_filter": 30, "ref_context_exact": 5, "general_context": 5, "general_context_first3": 5,
             "chat_examples_project": 50, "orphan_check": 1, "distinct_union": 10}
    assert {q: n for q, n in least.items() if QUERIES[q](spark, sf).count() < n} == {}
    contexts = [r.context for r in QUERIES["ref_context"](spark, sf).collect()]
    assert 2 * sum(c != "" for c in contexts) >= len(contexts) > 10
    docs = V.sectioned_docs(spark, sf).collect()
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents", "doc_id", "text").collect()}
    for r in docs:   # no character but full stops and line feeds is lost
        assert re.sub(r"(?m)^\d\.\d+ ", "", r.text).replace("\n", "").replace(" ", "") == re.sub(r"[.\n ]", "", texts[r.doc_id])
    # Overrides: the same number in both files of a project, the later text wins.
    secs = X.extract_sections(V.sectioned_docs(spark, sf))
    assert secs.groupBy("doc_id").count().agg(F.max("count")).first()[0] > 30


def test_sequence_within_spreads_common_prefixes_and_skewed_numbers(spark):
    n, rows = 200_000, 5_000
    d = spark.range(0, n, 1, 5).select(
        F.concat(F.lit("job_number_"), F.col("id").cast("string")).alias("s"),
        F.when(F.col("id") % 10 != 0, F.col("id") / 1e9).otherwise(F.pow(F.col("id").cast("double"), 4)).alias("x"),
        F.when(F.col("id") % 3 != 0, F.lit("same")).otherwise(F.lit(None)).alias("tie"), "id", F.lit("g").alias("g"))
    for order in (["s"], ["x", "id"], ["tie", "id"]):
        steps = n // rows
        spread = d.withColumn("b", L.cut_bucket(L.cut_points(d, order, n, steps), order, steps)).groupBy("b").count().collect()
        assert len(spread) == steps and max(r["count"] for r in spread) < 2 * rows
        got = L.sequence_within(d, ["g"], order, bucket_rows=rows).select("id", "seq")
        want = d.select("id", (F.row_number().over(Window.partitionBy("g").orderBy(*order)) - 1).alias("want"))
        assert got.join(want, "id").where("seq <> want").count() == 0


def test_detection_equals_substring_search(spark):
    """Anchored detection against plain substring search, for keywords of every shape."""
    from redline.operators import detect as D
    rng = random.Random(3)
    words = ["ab", "Abc", "x", "Lease", "de", "F&G", "né", "12"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) + rng.choice(["", ".", "!"]) for _ in range(60)]
    docs = [(str(i), t) for i, t in enumerate(texts)] + [("none", None), ("empty", "")]
    firms = [(f"f{i}", f"Firm {i}", [" ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))[rng.randint(0, 1):]
                                      for _ in range(3)] + (["b"] if i == 5 else []), i) for i in range(6)]
    ddf = spark.createDataFrame(docs, "id string, extracted_text string")
    fdf = spark.createDataFrame(firms, "id string, name string, keywords array<string>, firm_rank int")
    want = {i: [f for f, _, ks, _ in firms if t is not None and any(k and k.lower() in t.lower() for k in ks)] for i, t in docs}
    assert {r.id: list(r.firms_matched) for r in D.detect_all_firms(ddf, fdf).collect()} == want
    assert {r.id: r.law_firm_id for r in D.detect_firm(ddf, fdf).collect()} == {i: (w or [None])[0] for i, w in want.items()}
    assert any(want.values()) and not all(want.values())
