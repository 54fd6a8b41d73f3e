"""Small tests of what reviews found: work per distinct value instead of per row, and whole inputs."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from redline.functions.text import WS_CHARS as FE_WS
from redline.operators import detect as D
from redline.operators import features as FE
from redline.operators import scoring as B
from redline.plans.registry import QUERIES, load_all
from redline.session import materialize
from redline.sources.scratch import scratch_path
from redline.streaming import jobs as ST

load_all()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_review_prompt_texts_travel_per_file_list(spark, monkeypatch):
    files = spark.createDataFrame([("1", "a.txt", "one"), ("2", "b.txt", "second"), ("3", "c.txt", ""), ("4", "d.txt", None),
                                   ("5", "e.txt", "x"), ("5", "f.txt", "yy")], "id string, filename string, extracted_text string")
    asked = [(i, ["1", "2"]) for i in range(40)] + [(100, ["2", "1"]), (101, ["1", "9"]), (102, ["3"]), (103, ["4", "1"]), (104, ["5"]),
                                                    (105, [None]), (106, []), (107, None), (108, ["1"]), (108, ["2"]), (None, ["1"])]
    requests = spark.createDataFrame(asked, "request_id long, file_ids array<string>")
    monkeypatch.setattr(B, "REQUESTS_PER_COPY", 3)
    out = B.review_prompt(requests, files)
    got = {r.request_id: tuple(r)[1:] for r in out.collect()}
    one, two, five = "Contract: a.txt\n\none", "Contract: b.txt\n\nsecond", ["Contract: e.txt\n\nx", "Contract: f.txt\n\nyy"]

    def prompt(*sections):
        return False, len(sections), sum(map(len, sections)), "\n\n".join(sections)
    failed = (True, None, None, None)
    assert got == {i: prompt(one, two) for i in range(40)} | {
        100: prompt(two, one), 101: failed, 102: failed, 103: failed, 104: prompt(*five), 105: failed,
        108: prompt(one, two), None: prompt(one)}
    assert len(out.collect()) == len(got)
    # What is gathered per request is ids alone.
    gathered = [line for line in plan(out).splitlines() if re.search(r"keys=\[request_id", line)]
    assert gathered and not any("filename" in line or re.search(r"struct\(pos, pos#\d+, s,", line) for line in gathered)


def test_json_examples_hold_every_text_in_every_shape(spark, tmp_path):
    rows = [(c, t, f"text {c} {t}") for c in range(250) for t in range(2)] + [(250, 0, None)]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = QUERIES["read_json_examples"](spark, str(tmp_path)).collect()
    for form in (0, 1):
        assert sorted(r.text for r in got if r.form == form) == sorted(x for c, _, x in rows if x and c % 2 == form)
    assert sorted((r.part, r.line_no, r.text) for r in got if r.form == 2) == [
        (0, 0, "text 2 0"), (1, 0, "text 102 0"), (2, 0, "text 202 0")]
    assert {r.form for r in got} == {0, 1, 2}


def _brute_grams(text, lo, hi, stop):
    tokens = [t for t in re.findall(r"\w{2,}", (text or "").lower()) if t not in stop]
    return [" ".join(tokens[i:i + n]) for n in range(lo, hi + 1) for i in range(len(tokens) - n + 1)]


def _texts(spark, n=300, seed=7):
    r = random.Random(seed)
    words = ["the", "of", "B", "x"] + [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(r.choices(words, weights=[5, 5, 2, 1] + [40 // (i + 1) + 1 for i in range(40)], k=r.randrange(30)))) for i in range(n)]
    rows += [(1000, None), (1001, ""), (1002, "the a"), (3, "w1 w2 w1"), (3, "w1 w2"), (None, "w1 w2"), (None, "w1")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("lo,hi,run", [(1, 1, 1), (1, 2, 1 << 20), (1, 3, 60), (2, 3, 400), (3, 4, 1 << 20)])
def test_term_counts_match_brute_force(spark, monkeypatch, lo, hi, run):
    monkeypatch.setattr(FE, "RUN_BYTES", run)
    rows, df = _texts(spark)
    stop = set(FE.default_stop_words())
    grams = [(i, g) for i, text in rows for g in _brute_grams(text, lo, hi, stop)]
    got = FE.ngrams(df, lo=lo, hi=hi, counted=True).collect()
    assert {(r.doc_id, r.term): r.n for r in got} == Counter(grams) and len(got) == len(set(grams))
    freq = Counter(g for _, g in grams)
    ranked = sorted(freq, key=lambda g: (-freq[g], g))
    for most in (1, 7, 30, 45, 5000):
        tokens = FE._joined_tokens(df, "doc_id", "text")
        assert FE.vocabulary(tokens, most, (lo, hi)) == ranked[:most]
    counts = sorted((r.doc_id or 0, r.term, r["count"]) for r in FE.count_features(df, max_features=30, ngram=(lo, hi)).collect())
    assert counts == sorted((i or 0, g, n) for i, text in rows for g, n in Counter(_brute_grams(text, lo, hi, stop)).items()
                            if g in set(ranked[:30]))


def test_ngrams_of_rows_with_one_id_are_not_shuffled(spark):
    df = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha")], "doc_id long, text string")
    assert "Exchange" not in plan(FE.ngrams(df, counted=True))
    twice = df.unionByName(df.where("doc_id = 1"))
    assert {(r.doc_id, r.term): r.n for r in FE.ngrams(twice, counted=True).collect()} == {
        (1, "alpha"): 2, (1, "beta"): 4, (1, "alpha beta"): 2, (1, "beta beta"): 2, (2, "alpha"): 1}


def test_long_ngrams_are_counted_only_of_frequent_words(spark, monkeypatch):
    seen, count = [], FE._term_counts
    monkeypatch.setattr(FE, "_term_counts", lambda *a: seen.append(count(*a)) or seen[-1])
    df = spark.createDataFrame([(i, f"rare{i} alpha beta once{i}") for i in range(50)], "doc_id long, text string")
    assert FE.vocabulary(FE._joined_tokens(df, "doc_id", "text"), 2) == ["alpha", "alpha beta"]
    assert [r.term for r in seen[1].collect()] == ["alpha beta"]


@pytest.mark.parametrize("small", [0, 1 << 20])
def test_lemmas_keep_order_repeats_and_nulls(spark, monkeypatch, small):
    monkeypatch.setattr(FE, "SMALL_DICTIONARY", small)
    monkeypatch.setattr(FE, "RUN_TOKENS", 3 if small else 200_000)
    rows = [(1, ["cats", "see", "cats", "dogs"]), (2, []), (3, ["x"]), (4, ["cats", "b"]), (4, ["a"]), (None, ["dogs"]), (None, ["cats"]),
            (5, None), (6, [None, "many"])]
    tokens = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    forms = spark.createDataFrame([("cats", "cat"), ("dogs", "dog"), ("b", None), ("many", "z"), ("many", "y"), (None, "n")], "token string, lemma string")
    out = FE.lemma_map(tokens, forms)
    assert sorted(((r.doc_id or 0, r.lemmas) for r in out.collect()), key=lambda r: r[0]) == [
        (0, ["cat", "dog"]), (1, ["cat", "see", "cat", "dog"]), (3, ["x"]), (4, ["a", "cat", "b"]), (6, [None, "y", "z"])]
    # Tokens are not dealt out by their positions.
    assert "posexplode" not in plan(out)


def test_preprocess_keeps_letters_and_blanks_only(spark):
    text = "".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x3100), 0x1F600])) + " Cats_and 42 dogs’ x　y\x85z"
    got = FE.preprocess(spark.createDataFrame([(text,), (None,)], "text string")).collect()
    low = spark.createDataFrame([(text,)], "t string").select(F.lower("t")).first()[0]
    want = [w for w in "".join(c for c in low if re.match("[a-z]", c) or c in FE_WS).split() if w not in FE.default_stop_words()]
    assert got[0].tokens == want and got[1].tokens == []


@pytest.mark.parametrize("kind", [["the long key", "ab", "x"], ["the long key"]])
def test_few_and_many_keywords_find_the_same_firms(spark, monkeypatch, kind):
    firms = spark.createDataFrame([("f1", "one", kind, 1), ("f2", "two", ["KEY one two"], 2)],
                                  "id string, name string, keywords array<string>, firm_rank int")
    docs = spark.createDataFrame([("1", "so The Long Key it is"), ("2", "a key one two."), ("2", "cabin"), ("3", None), (None, "the long key"),
                                  ("4", "the long keys, key one two"), ("5", "x")], "id string, extracted_text string")
    found = []
    for size in (0, 1 << 20):
        monkeypatch.setattr(D, "SMALL_ANCHORS", size)
        out = D.detect_all_firms(docs, firms)
        found.append(sorted((r.id or "", r.extracted_text or "", r.firms_matched) for r in out.collect()))
        gone = [line for line in plan(D.firm_hits(docs, firms)).splitlines() if "SortMergeJoin" in line]
        assert bool(gone) == (size == 0)
    assert found[0] == found[1]


def test_second_delivery_stores_no_text(spark, monkeypatch):
    """Uploads that the sink has are told by their ids; files of a batch hold a bucket each."""
    stored = []
    monkeypatch.setattr(ST, "materialize", lambda df: stored.append(df.columns) or materialize(df))
    rows = [(str(i), i, "word " * i) for i in range(40)] + [("7", 7, "word " * 7), (None, None, "of none")]
    files = spark.createDataFrame(rows, "id string, doc_id long, extracted_text string").repartition(6)
    firms = spark.createDataFrame([("f1", "one", ["word word"], 1)], "id string, name string, keywords array<string>, firm_rank int")
    out = scratch_path(spark, "second-out")
    write = ST.ingest_writer(firms, out, buckets=4)
    write(files, 0)
    got = spark.read.parquet(out)
    assert sorted(r.id or "" for r in got.select("id").distinct().collect()) == sorted({i or "" for i, _, _ in rows})
    names = got.select(F.input_file_name().alias("f"), "bucket").distinct()
    assert names.count() == got.select("bucket").distinct().count()
    before = got.count()
    del stored[:]
    write(files.where("id is not null"), 1)
    assert spark.read.parquet(out).count() == before and not any("extracted_text" in c for c in stored)
