"""Edge cases pinned in FIXTURES.md, on small inline inputs."""

import math

from pyspark.sql import functions as F

from redline.functions import text as FT
from redline.operators import compare as C
from redline.operators import detect as D
from redline.operators import examples as EX
from redline.operators import features as FE
from redline.operators import loader as L
from redline.operators import reports as R
from redline.operators import sections as X
from redline.operators import text as T
from redline.operators import validate as VD


def one(spark, col, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("y")).first()["y"]


# ---- T1 / T2 ---------------------------------------------------------------------------------------

def test_clean_text_short_is_empty(spark):
    assert one(spark, FT.clean_text("x"), "short") == ""


def test_clean_text_drops_symbols_keeps_accents(spark):
    # whitespace is collapsed before symbols are dropped, so a double space can remain (quirk kept)
    assert one(spark, FT.clean_text("x"), "Prix @ #10 pour l'été, ok!") == "Prix  10 pour l'été, ok!"


def test_clean_text_collapses_newlines_into_one_line(spark):
    assert one(spark, FT.clean_text("x"), "line one here\n\n  line two") == "line one here line two"


def chunks(spark, text, size=1000, overlap=200):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [(r["index"], r["text"]) for r in T.chunk_text(df, size=size, overlap=overlap).orderBy("index").collect()]


def test_chunk_exact_size_is_one_unstripped_chunk(spark):
    text = " " + "a" * 998 + " "
    assert chunks(spark, text) == [(0, text)]


def test_chunk_1001_chars_without_terminators(spark):
    text = "".join(chr(ord("a") + i % 26) for i in range(1001))
    assert chunks(spark, text) == [(0, text[:1000]), (1, text[800:1001])]


def test_chunk_1700_chars_last_chunk_inside_overlap(spark):
    text = "".join(chr(ord("a") + i % 26) for i in range(1700))
    got = chunks(spark, text)
    assert [c for _, c in got] == [text[:1000], text[800:1700], text[1600:1700]]


def test_chunk_period_at_index_1000_gives_1001_chars(spark):
    text = "b" * 1000 + "." + "c" * 500
    got = chunks(spark, text)
    assert len(got[0][1]) == 1001


def test_chunk_rejects_non_terminating_overlap(spark):
    import pytest
    with pytest.raises(ValueError):
        T.chunk_array("text", 1000, 950)


# ---- D ---------------------------------------------------------------------------------------------

def _firms(spark):
    return spark.createDataFrame(
        [("f1", "Alpha & Co", ["alpha llp"], 0), ("f2", "Beta", ["beta", "gamma"], 1)],
        "id string, name string, keywords array<string>, firm_rank int")


def test_detect_first_firm_by_rank_and_substring(spark):
    docs = spark.createDataFrame([("d1", "Signed by BETA and Alpha LLP."), ("d2", "the omegamma clause"),
                                  ("d3", "nothing here"), ("d4", None)], "id string, extracted_text string")
    got = {r.id: r.law_firm_id for r in D.detect_firm(docs, _firms(spark)).collect()}
    assert got == {"d1": "f1", "d2": "f2", "d3": None, "d4": None}


def test_detect_all_firms_in_rank_order(spark):
    docs = spark.createDataFrame([("d1", "gamma then alpha llp")], "id string, extracted_text string")
    r = D.detect_all_firms(docs, _firms(spark)).first()
    assert r.firms_matched == ["f1", "f2"] and r.default_firm == "f1"


def test_template_type_rule_sets(spark):
    names = ["Unit 1 - Purchase Agreement.pdf", "X Rider.pdf", "Contract Comments X.docx", "misc.pdf"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.t for r in df.select(FT.template_type("n", FT.TEMPLATE_RULES_A).alias("t")).collect()]
    assert got == ["purchase_agreement", "rider", "legal_comments", "main_contract"]
    assert one(spark, FT.template_type("x", FT.TEMPLATE_RULES_B), "review of sale.docx") == "purchase_agreement"


def test_contract_type_nda_inside_word(spark):
    assert one(spark, FT.contract_type("x"), "See the calendar") == "nda"
    assert one(spark, FT.contract_type("x"), "A Purchase\n Agreement") == "purchase_agreement"
    assert one(spark, FT.contract_type("x"), "buy\nsell") == "default"


def test_firm_slug_and_keywords(spark):
    assert one(spark, FT.firm_slug("x", "law_firm_"), "Smith & Jones LLP") == "law_firm_smith_and_jones_llp"
    assert one(spark, FT.parse_keywords("x"), " a, b,,c ") == ["a", "b", "c"]


def test_prompt_for_type_default(spark):
    assert one(spark, D.prompt_for(F.col("x")), "NDA") == D.SYSTEM_PROMPTS["nda"]
    assert one(spark, D.prompt_for(F.col("x")), "unknown") == D.SYSTEM_PROMPTS["default"]


# ---- J ---------------------------------------------------------------------------------------------

def test_pairing_untyped_and_typed_without_template(spark):
    contracts = spark.createDataFrame([("c1", "f", None), ("c2", "f", "rider"), ("c3", "f", "purchase_agreement")],
                                      "id string, law_firm_id string, document_type string")
    templates = spark.createDataFrame([("t1", "f", "purchase_agreement", "a.docx"), ("t2", "f", "legal_comments", "b.docx"),
                                       ("t3", "f", "main_contract", "c.docx")],
                                      "id string, law_firm_id string, template_type string, file_name string")
    got = sorted((r.contract_id, r.template_id) for r in C.pair_templates(contracts, templates).collect())
    assert got == [("c1", "t1"), ("c1", "t3"), ("c2", None), ("c3", "t1")]


def test_line_multiset_diff_counts_duplicates(spark):
    pairs = spark.createDataFrame([("c", "t")], "contract_id string, template_id string")
    contracts = spark.createDataFrame([("c", "x\nx\ny")], "id string, extracted_text string")
    templates = spark.createDataFrame([("t", "x\nz\nz")], "id string, content string")
    got = sorted((r.type, r.content, r.occurrence) for r in C.line_diff(pairs, contracts, templates).collect())
    assert got == [("added", "x", 2), ("added", "y", 1), ("removed", "z", 1), ("removed", "z", 2)]


# ---- X / E -----------------------------------------------------------------------------------------

def _sections(spark, text, **kw):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [(r.section_num, r.section_text, r.first_pos)
            for r in X.extract_sections(df, **kw).orderBy("first_pos").collect()]


def test_section_body_with_period_does_not_match(spark):
    assert _sections(spark, "1.1 Terms apply. More text\n1.2 Payment due") == [("1.2", "Payment due", 0)]


def test_section_number_twice_last_text_first_position(spark):
    got = _sections(spark, "1.1 First body\n1.2 Second body\n1.1 Third body")
    assert got == [("1.1", "Third body", 0), ("1.2", "Second body", 1)]


def test_section_prefix_form(spark):
    assert _sections(spark, "Section 2.1: Delivery terms") == [("2.1", "Delivery terms", 0)]


def test_declared_pattern_list_finds_articles_and_clauses(spark):
    text = "Article IV: Scope\nArticle V Term\nClause 7.2: Keys"
    got = _sections(spark, text, patterns=X.SECTION_PATTERNS_DECLARED)
    assert ("Article IV", "Scope") in [(n, t) for n, t, _ in got]
    assert ("Clause 7.2", "Keys") in [(n, t) for n, t, _ in got] and ("7.2", "Keys") in [(n, t) for n, t, _ in got]


def test_section_sort_key(spark):
    df = spark.createDataFrame([("1.10",), ("1.2",), ("A.1",)], "n string")
    got = [r.n for r in df.orderBy(X.section_key("n")).collect()]
    assert got == ["1.2", "1.10", "A.1"]


def test_comment_islands(spark):
    df = spark.createDataFrame([("p", "a\nb\nsee 1.2\nc")], "project_id string, text string")
    got = [(r.comment, r.refs) for r in X.parse_comments(df).orderBy("comment_idx").collect()]
    assert got == [("a b", []), ("see 1.2", ["1.2"]), ("c", [])]


def test_section_refs_money(spark):
    assert one(spark, X.section_refs("x"), "pay $ 2,106.23 now") == ["106.23"]


def test_ref_context_fallback_first_by_position(spark):
    sections = spark.createDataFrame([("p", "5.1.2", "deep", 0), ("p", "15.1", "other", 1)],
                                      "project string, section_num string, section_text string, first_pos int")
    comments = spark.createDataFrame([("r", 0, "p", ["5.1"])], "review_id string, comment_idx int, project string, refs array<string>")
    assert EX.ref_context(comments, sections).first().context == "Section 5.1.2:\ndeep"


# ---- V / L -----------------------------------------------------------------------------------------

def _lines(spark, values):
    return spark.createDataFrame(list(enumerate(values, 1)), "line_no long, value string")


def test_validate_empty_content_counts_as_valid_but_strict_rejects(spark):
    line = '{"messages":[{"role":"system","content":"s"},{"role":"user","content":" "},{"role":"assistant","content":"a"}]}'
    r = VD.validate_chat(_lines(spark, [line])).first()
    assert r.valid and r.errors == ["Line 1: Message 2 missing or empty content"]
    assert not VD.validate_chat_strict(_lines(spark, [line])).first().valid


def test_validate_error_kinds(spark):
    bad = ["{not json", '{"x": 1}', '{"messages":[{"role":"user","content":"u"}]}',
           '{"messages":[{"role":"user","content":"u"},{"role":"system","content":"s"},{"role":"assistant","content":"a"}]}']
    got = [r.errors[0] for r in VD.validate_chat(_lines(spark, bad)).orderBy("line_no").collect()]
    assert got == ["Line 1: JSON decode error", "Line 2: Missing 'messages' field", "Line 3: Expected 3 messages, got 1",
                   "Line 4: Expected roles ['system', 'user', 'assistant'], got ['user', 'system', 'assistant']"]


def test_detect_format_first_record_wins_and_misfits_drop(spark):
    recs = spark.createDataFrame([("f", 1, '{"messages":[{"role":"user","content":"hi"}]}'), ("f", 2, '{"text":"plain text here"}')],
                                 "file string, line_no long, value string")
    assert L.detect_format(recs).first().format == "chat"


def test_normalize_text_drops_short(spark):
    df = spark.createDataFrame([("  123456789  ",), ("1234567890",)], "text string")
    assert [r.text for r in L.normalize_text(df).collect()] == ["1234567890"]


def test_length_histogram_buckets(spark):
    df = spark.createDataFrame([("a" * n,) for n in (100, 101, 500, 2000, 2001)], "text string")
    got = {r.bucket: r.n for r in L.length_histogram(df).collect()}
    assert got == {"0-100": 1, "100-500": 2, "500-1000": 0, "1000-2000": 1, "2000+": 1}


# ---- F / R / A ---------------------------------------------------------------------------------------

def test_stat_features_empty_text_all_zero(spark):
    df = spark.createDataFrame([(1, "")], "doc_id long, text string")
    r = FE.stat_features(df).first()
    assert (r.char_count, r.word_count, r.sentence_count, r.flesch_score, r.lexical_diversity) == (0, 0, 0, 0.0, 0.0)


def test_tfidf_idf_smoothing(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, "alpha gamma")], "doc_id long, text string")
    got = {(r.doc_id, r.term): r.tfidf for r in FE.tfidf_features(df, ngram=(1, 1), stop_words=[]).collect()}
    idf_beta = math.log(3 / 2) + 1
    norm = math.sqrt(1 + idf_beta ** 2)
    assert abs(got[(1, "alpha")] - round(1 / norm, 6)) < 1e-9
    assert abs(got[(1, "beta")] - round(idf_beta / norm, 6)) < 1e-9


def test_human_size(spark):
    assert one(spark, FT.human_size("x"), 0, "x long") == "0 Bytes"
    assert one(spark, FT.human_size("x"), 1536, "x long") == "1.5 KB"
    assert one(spark, FT.human_size("x"), 1152, "x long") == "1.13 KB"


def test_dashboard_no_rows_is_zero(spark):
    empty = spark.createDataFrame([], "id string, status string")
    r = R.dashboard_stats(empty, empty).first()
    assert (r.total_reviews, r.total_comments, r.success_rate_pct) == (0, 0, 0)


# ---- more helpers -------------------------------------------------------------------------------------

def test_status_buckets_and_labels(spark):
    df = spark.createDataFrame([("Completed",), ("ERROR",), ("pending",), (None,)], "s string")
    got = [r.b for r in df.select(FT.status_bucket("s").alias("b")).collect()]
    assert got == ["success", "error", "warning", "default"]
    jobs = spark.createDataFrame([("running",), ("stopped",), ("queued",)], "s string")
    got = [r.b for r in jobs.select(FT.status_bucket("s", FT.JOB_STATUS_BUCKETS, other="default", lower=False)
                                    .alias("b")).collect()]
    assert got == ["primary", "warning", "default"]
    assert one(spark, FT.human_duration("x"), 3725, "x long") == "1h 2m 5s"
    assert one(spark, FT.processing_time_label("x"), 12.345, "x double") == "12.35s"
    assert one(spark, FT.processing_time_label("x"), 0.0, "x double") == "N/A"


def test_split_with_zero_fraction_is_all_train(spark):
    df = spark.createDataFrame([(i,) for i in range(20)], "k long")
    assert {r.split for r in L.exact_hash_split(df, "k", 0.0).collect()} == {"train"}


def test_validate_messages_of_other_types(spark):
    """Messages that are no list: a string has a length, null and numbers have none."""
    from redline.operators import validate as VD
    lines = ['{"messages":"hello"}', '{"messages":null}', '{"messages":5}', '{"messages":"abc"}', '{"messages":[1,2,3]}']
    df = spark.createDataFrame(list(enumerate(lines, 1)), "line_no long, value string")
    got = {r.line_no: (r.valid, r.errors) for r in VD.validate_chat(df).collect()}
    assert not any(v for v, _ in got.values()) and all(len(e) == 1 for _, e in got.values())
    assert got[1][1] == ["Line 1: Expected 3 messages, got 5"]
    s = VD.validation_summary(VD.validate_chat(df)).first()
    assert (s.valid_examples, s.invalid_examples, s.n_errors) == (0, 5, 5)


def test_insert_if_absent_nulls_and_names_inside_the_batch(spark):
    from redline.operators import changes as W
    base = spark.createDataFrame([("a", "n1"), (None, "n2")], "k string, u string")
    new = spark.createDataFrame([("a", "x", 1), ("b", "n1", 2), ("c", "y", 3), ("c", "y", 3), ("d", "y", 4), (None, "z", 5),
                                 ("e", None, 6), ("f", None, 7), ("c", "w", 8)], "k string, u string, o int")
    got = sorted((r.o, r.action) for r in W.insert_if_absent(base, new, ["k"], "o", ["u"]).collect())
    assert got == [(1, "rejected"), (2, "rejected"), (3, "duplicate"), (3, "inserted"), (4, "rejected"), (5, "rejected"),
                   (6, "inserted"), (7, "inserted"), (8, "duplicate")]


def test_insert_if_absent_batch_duplicates_and_rejects(spark):
    from redline.operators import changes as W
    base = spark.createDataFrame([("a", "Alpha")], "id string, name string")
    new = spark.createDataFrame([("a", "Other", 1), ("b", "Beta", 2), ("b", "Beta2", 3), ("c", "Alpha", 4)],
                                "id string, name string, seq int")
    got = sorted((r.id, r.name, r.action) for r in W.insert_if_absent(base, new, ["id"], "seq", ["name"]).collect())
    assert got == [("a", "Other", "rejected"), ("b", "Beta", "inserted"), ("b", "Beta2", "duplicate"),
                   ("c", "Alpha", "rejected")]


def test_cancel_only_unfinished_jobs(spark):
    from redline.operators import changes as W
    jobs = spark.createDataFrame([("j1", "processing"), ("j2", "completed"), ("j3", "processing")],
                                 "job_id string, status string")
    req = spark.createDataFrame([("j1", 5), ("j2", 6)], "job_id string, requested_at int")
    got = sorted((r.job_id, r.status, r.action) for r in W.cancel_jobs(jobs, req).collect())
    assert got == [("j1", "cancelled", "cancelled"), ("j2", "completed", "rejected"), ("j3", "processing", "unchanged")]


def test_shared_keyword_between_firms(spark):
    firms = spark.createDataFrame([("f1", "One", ["shared term"], 0), ("f2", "Two", ["Shared Term", "zeta"], 1)],
                                  "id string, name string, keywords array<string>, firm_rank int")
    docs = spark.createDataFrame([("d", "a SHARED TERM here and zeta")], "id string, extracted_text string")
    assert D.detect_firm(docs, firms).first().law_firm_id == "f1"
    assert D.detect_all_firms(docs, firms).first().firms_matched == ["f1", "f2"]


# ---- shapes of the reference's own script fixtures (own wording) ----------------------------------------

CONTRACT = ("SUPPLY AGREEMENT\n\n1.1 Definitions\nTerms used here have the meanings below.\n\n"
            "1.2 Scope\nThe supplier delivers the goods listed in the annex.\n\n"
            "2.1 Price\nThe buyer pays the agreed price within thirty days\n\n"
            "2.2 Delivery\nGoods are delivered to the named site.")


def test_numbered_contract_periods_block_sections(spark):
    got = _sections(spark, CONTRACT)
    # every body ending in a period is blocked; the one without a period runs to the next number
    assert got == [("2.1", "Price The buyer pays the agreed price within thirty days", 0)]


def test_review_text_comments(spark):
    review = ("General remarks on the draft\n"
              "Section 1.2 Review:\nThe scope in section 1.2 should list exclusions.\n"
              "Also check the annex wording\nSection 2.1 Review:\nPayment terms in 2.1 are too short.")
    df = spark.createDataFrame([("p", review)], "project_id string, text string")
    got = [(r.comment, r.refs) for r in X.parse_comments(df).orderBy("comment_idx").collect()]
    assert got == [("General remarks on the draft", []),
                   ("Section 1.2 Review:", ["1.2"]),
                   ("The scope in section 1.2 should list exclusions.", ["1.2"]),
                   ("Also check the annex wording", []),
                   ("Section 2.1 Review:", ["2.1"]),
                   ("Payment terms in 2.1 are too short.", ["2.1"])]
    flat = [r.comment for r in X.parse_comments_flat(df).orderBy("pos").collect()]
    assert flat == ["The scope in section 1.2 should list exclusions.", "Payment terms in 2.1 are too short."]


def test_text_only_projects_do_not_qualify(spark):
    files = spark.createDataFrame([("p1", "a.txt"), ("p1", "b.txt"), ("p1", "c.txt"), ("p2", "x.txt"),
                                   ("p2", "y.pdf"), ("p2", "z.pdf"), ("p2", "w.docx")], "project string, filename string")
    got = {r.project: (r.n_pdf, r.n_word, r.qualifies) for r in X.discover_projects(files).collect()}
    assert got == {"p1": (0, 0, False), "p2": (2, 1, True)}
