"""URL filter, quality rules and line dedup: defined cases, and no Python in their plans."""

import random
from hashlib import md5

from pyspark.sql import functions as F

from redline.llm import line_dedup, quality, url_filter
from redline.llm.common import stored
from redline.llm.queries import PATTERN_RULES, QUERIES, SITE_RULES


def test_native_plans_hold_no_python(spark, sf):
    for name in ("op6_url_filter", "op8_line_dedup", "op10_quality_rules"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop")), name


def test_url_cases(llm):
    urls = ["http://example.org", "http://EXAMPLE.org/", "http://a.b.example.org/es/x?q#f", "http://notexample.org/es/",
            "https://example.org/en/10", "https://example.org/EN/1", "http://x.com/fr/y", "http://com/de/", "nothing", None, "",
            "http://www.spam-farm.net/x", "http://spamfarm.net/", "http://spam-farm.org/", "a://b://c/d", "http://x.com:80/de/"]
    df = llm.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(99, urls[2], "x")] * 2, "page_id long, url string, rule string")
    got = {}
    for r in url_filter.judge_urls(df, SITE_RULES + PATTERN_RULES).collect():
        got.setdefault(r.page_id, []).append((r.host, r.path, r.rule, r.verdict))
    assert len(got[99]) == 2
    assert got[0] == [("example.org", "", None, "allow")]           # an empty path starts with no rule's
    assert got[1] == [("example.org", "/", "org/", "allow")]
    assert got[2] == [("a.b.example.org", "/es/x", "example.org/es/", "block")]
    assert got[3][0][2:] == ("org/", "allow")
    assert got[4][0][2:] == ("example.org/en/1", "block") and got[5][0][2:] == ("org/", "allow")
    assert got[6][0][2:] == ("com/fr/", "allow") and got[7][0][2:] == ("com/de/", "block")
    assert got[8] == got[9] == got[10] == [("", "", None, "allow")]
    assert got[11][0][2:] == (None, "block") and got[12][0][2:] == (None, "allow")
    assert got[13][0][2:] == ("org/", "allow")                       # a site rule goes first
    assert got[14] == [("b:", "//c/d", None, "allow")] and got[15][0][2:] == (None, "allow")
    assert url_filter.judge_urls(df.limit(0), SITE_RULES).count() == 0


def test_rules_are_filed_under_their_rarest_token(llm):
    sites = llm.createDataFrame([("a.org/x/",), ("b.org/y/",), ("c.com/x/",)], "site string")
    rules = [url_filter.site_rule("block", "org", "/x/"), url_filter.pattern_rule("block", "any", "q", ())]
    got = {r.rule: r.token for r in url_filter.rule_index(sites, rules).collect()}
    assert got == {"org/x/": "org", "any": ""}                       # org and x twice each: the smaller name


def _repeat_words(ws):
    seen, covered = {}, set()
    for i in range(len(ws) - 7):
        seen.setdefault(tuple(ws[i:i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {x for i in at for x in range(i, i + 8)}
    return len(covered)


def test_quality_counts_equal_brute_force(docs):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += [None, "", " \n\t", "x", "a b\n a b\nA b", "#*$%&|<> é 日本", "w " * 30_000, "l\n\nl\n \nl\x0bm"]
    df = docs(list(enumerate(texts)))
    for r in quality.base_measures(df).collect():
        text = texts[r.doc_id] or ""
        ws = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").split(" ") if w]
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert (r.n_words, r.word_chars) == (len(ws), sum(map(len, ws)))
        assert r.n_symbols == sum(text.count(c) for c in "#*$%&|<>")
        assert (r.n_lines, r.n_dup_lines) == (len(lines), len(lines) - len(set(lines)))
        assert r.n_repeat_words == _repeat_words(ws), text[:80]


def test_quality_thresholds_follow_their_group(llm):
    """The same text is kept where its group looks like it and goes where it is an outlier."""
    rng = random.Random(1)

    def prose(k):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) + "#" * (i < k) for i in range(40))
    rows = [(i, prose(0), "en", "plain") for i in range(300)] + [(1000 + i, prose(18), "en", "tables") for i in range(300)]
    rows += [(2000, prose(18), "en", "plain"), (2001, None, None, None), (2001, None, None, None)]
    got = {r.doc_id: r.kept for r in quality.quality_filter(llm.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(300)) and all(got[1000 + i] for i in range(300))
    assert got[2000] is False and got[2001] is False


def test_quality_sketch_merges_in_any_order(llm):
    from pyspark.sql import DataFrame
    df = llm.range(5000).select(F.lit("en").alias("lang"), (F.col("id") % 3).cast("string").alias("source"),
                                F.lit(10).cast("long").alias("n_words"), (F.col("id") * 37 % 977 + 1).alias("word_chars"),
                                F.lit(0).cast("long").alias("n_symbols"), F.lit(1).cast("long").alias("n_lines"),
                                F.lit(0).cast("long").alias("n_dup_lines"), F.lit(0).cast("long").alias("n_repeat_words"))

    def rows(x: DataFrame):
        return sorted(map(tuple, x.groupBy("measure", "value").agg(F.sum("n")).collect()))
    parts = quality.sketch(df.filter("source = '0'")).unionByName(quality.sketch(df.filter("source <> '0'")))
    assert rows(parts) == rows(quality.sketch(df.repartition(7)))


def _passage(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n))


def test_recurring_passages_go_and_copies_stay(docs):
    rng = random.Random(2)
    passage, footer = _passage(rng, 60), "Posted on day {1} by {0} of the team"
    rows = []
    for i in range(12):   # documents of their own that share a passage and a line with variable fields
        own = [_passage(rng, 30), passage, _passage(rng, 25), footer.format("".join(rng.choice("klmnop") for _ in range(5)), i)]
        rows.append((i, "\n".join(own)))
    family = [_passage(rng, 40) for _ in range(3)]
    rows += [(100 + i, "\n".join(family)) for i in range(10)]                     # exact copies
    for i in range(10):                                                            # near copies: one word differs
        words = family[2].split()
        words[i] = f"zz{'q' * i}"
        rows.append((200 + i, "\n".join([*family[:2], " ".join(words)])))
    rows += [(300, None), (301, ""), (302, passage), (303, "\n\n"), (304, "a b"), (305, "x y z " * 20_000)]
    df = docs(rows)
    out = {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(df).collect()}
    assert out.keys() == dict(rows).keys()
    for i in range(12):
        lines = dict(rows)[i].split("\n")
        assert out[i] == "\n".join([lines[0], lines[2]]), out[i]
    for i in [*range(100, 110), *range(200, 210), 300, 301, 303, 304, 305]:
        assert out[i] == dict(rows)[i]
    assert out[302] == ""
    assert line_dedup.drop_recurring_lines(df).columns == df.columns
    assert line_dedup.drop_recurring_lines(df.limit(0)).count() == 0


def test_repeated_rows_get_the_same_lines(docs):
    rng = random.Random(4)
    line = _passage(rng, 12)
    rows = [(i, line + "\n" + _passage(rng, 20)) for i in range(6)]
    out = [r.text for r in line_dedup.drop_recurring_lines(docs(rows + rows[:2])).collect()]
    assert len(out) == 8 and not any(line in t for t in out)


def _dropped(docs, rows):
    """doc_id -> the text after line dedup."""
    return {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(docs(rows)).collect()}


def _swapped(line, i, word):
    ws = line.split(" ")
    ws[i] = word
    return " ".join(ws)


def test_families_of_short_texts_keep_their_lines(docs):
    """One- and two-line texts whose near copies differ in white space, a line feed or a word."""
    rng = random.Random(6)
    rows = []

    def family(texts):
        rows.extend([(len(rows) + i, t) for i, t in enumerate(texts)])
    for n in (3, 8, 12, 60, 200):
        one = _passage(rng, n)
        family([one, one + "\n", one.replace(" ", "  "), "\t" + one, one + " \n\n", "\n" + one])
    for n in (7, 12, 60, 200):
        one = _passage(rng, n)
        family([_swapped(one, n // 2, f"zz{'q' * i}") for i in range(8)])
    for n, m in ((8, 8), (12, 30), (60, 60), (10, 120)):
        first, second = _passage(rng, n), _passage(rng, m)
        family([f"{first}\n{second}", f"{first} \n\n{second}", f"{first}\n{second}\n", f"{first}\t\n{second}"])
        family([f"{_swapped(first, n - 2, f'yy{chr(97 + i) * 3}')}\n{second}" for i in range(6)])
    for n in (40, 120):   # the other lines are short
        line, words = _passage(rng, n), [_passage(rng, 2) for _ in range(20)]
        family(["\n".join([*words[:i], "odd", *words[i + 1:], line]) for i in range(6)])
    out = _dropped(docs, rows)
    assert out == dict(rows)


def test_a_hot_family_does_not_keep_a_recurring_line(docs):
    """A passage of unrelated documents, one of which has far more near copies than there are others."""
    rng = random.Random(7)
    passage = _passage(rng, 60)
    rows = [(i, f"{_passage(rng, 40)}\n{passage}\n{_passage(rng, 40)}") for i in range(12)]
    head, tail = rows[0][1].split("\n")[::2]
    rows += [(100 + i, f"{_swapped(head, i % 40, f'zz{i // 40}'.translate(str.maketrans('0123456789', 'qrstuvwxyz')))}\n{passage}\n{tail}")
             for i in range(400)]
    out = _dropped(docs, rows)
    assert not any(passage in t for t in out.values())
    assert all(out[i] == t.replace(passage + "\n", "") for i, t in rows)


def test_shared_blocks_of_lines_go(docs):
    """Blocks of recurring lines on short own texts."""
    rng = random.Random(8)
    rows, own = [], {}
    for lines, words in ((5, 100), (6, 50), (10, 100)):
        block = [_passage(rng, 30) for _ in range(lines)]
        for _ in range(30):
            own[len(rows)] = _passage(rng, words)
            rows.append((len(rows), "\n".join([*block[:2], own[len(rows)], *block[2:]])))
    assert _dropped(docs, rows) == own


def test_clean_short_lines_and_number_tables_stay(docs):
    """Unrelated short lines that begin alike, and rows of numbers of one length; the same row recurs."""
    rng = random.Random(9)
    phone = "Tel 555 1234 99"
    rows = []
    for i in range(60):
        lines = [_passage(rng, 30)]
        lines += [f"we are now {_passage(rng, 1)}", f"it was the {_passage(rng, 2)}", f"at the end {_passage(rng, 1)} the {_passage(rng, 1)}"]
        lines += [" ".join(str(rng.randrange(10**6)) for _ in range(n)) for n in (3, 5, 8)]
        lines += [f"Total {rng.randrange(10**6)} {rng.randrange(10**6)}.5 kg {rng.randrange(10**6)}"]
        rows.append((i, "\n".join([*lines, phone])))
    assert _dropped(docs, rows) == {i: t[:-len(phone) - 1] for i, t in rows}


def test_long_passages_go_from_two_documents_on(docs):
    """A passage of over 50 words in two or three documents goes, a short line stays."""
    rng = random.Random(10)
    rows, want = [], {}
    for n in (2, 3):
        passage, short = _passage(rng, 55), _passage(rng, 20)
        for _ in range(n):
            own = _passage(rng, 80)
            want[len(rows)] = f"{own}\n{short}"
            rows.append((len(rows), f"{own}\n{passage}\n{short}"))
    family = [_passage(rng, 60) for _ in range(3)]   # near copies keep theirs
    for i in range(6):
        want[len(rows)] = "\n".join([*family[:2], _swapped(family[2], 5 * i, "zzzz")])
        rows.append((len(rows), want[len(rows)]))
    assert _dropped(docs, rows) == want


def test_only_lines_of_shared_leaves_travel(docs):
    """lines that no other text or template can meet leave before the joins; what is dropped stays the same."""
    def own(d, k, n=8):
        return " ".join(f"w{chr(97 + d)}{chr(97 + k)}{chr(97 + i)}" for i in range(n))
    shared = "the same footer line stands in every text here"
    # Blanks, tabs and digits elsewhere in a text change neither its words nor its templates.
    variants = [shared, shared.replace(" ", "  "), shared.replace(" ", "\t"), f" {shared} ", shared]
    texts = ["\n".join([own(d, k) for k in range(5)] + [v] + ([own(d, 9, 2) + " 7"] if d == 4 else [])) for d, v in enumerate(variants)]
    # One text alone with two templates of one leaf, and one with a line twice.
    texts += ["aa bb cc dd ee ff\naa bb cc gg hh ii", "\n".join([own(8, 1), own(8, 1)])]
    df = docs(list(enumerate(texts)) + [(100, texts[0]), (101, None)])
    lines = line_dedup.line_table(df).collect()
    assert {(bytes(r.key), r.no) for r in lines} == {(md5(t.encode()).digest(), n) for t in texts[:5] for n in [5]} | {
        (md5(texts[5].encode()).digest(), n) for n in (0, 1)}
    assert len({r.tmpl for r in lines if r.no == 5}) == 1
    got = {r.doc_id: r for r in line_dedup.mark_lines(df).select("row.doc_id", "drop", line_dedup.kept_text().alias("text")).collect()}
    assert all(list(got[d].drop) == [5] and variants[d] not in got[d].text.split("\n") for d in range(5))
    assert got[100].text == got[0].text and got[101].text is None
    assert all(got[d].text == texts[d] for d in (5, 6))


def test_line_dedup_cuts_only_wanted_texts_and_sorts_none(docs, monkeypatch):
    """The texts whose positions are looked at are cut after the join, and the last join sorts no texts."""
    plans = {}

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
        return stored(df, name)
    monkeypatch.setattr(line_dedup, "stored", noted)
    rows = [(i, f"alpha beta gamma delta x{'abcdefgh'[i]} omega rho tau\nown {'qrstuvwx'[i]} words {i} of {'jklmnopq'[i]}") for i in range(8)]
    marked = line_dedup.mark_lines(docs(rows))
    last = marked._jdf.queryExecution().executedPlan().toString()
    assert {len(r["drop"]) for r in marked.collect()} == {1}
    at = plans["line-tokens"]
    cut, join = (next(i for i, x in enumerate(at) if what in x) for what in (" AS ls", "Join "))
    assert cut < join
    assert "ShuffledHashJoin" in last and "SortMergeJoin" not in last


def test_digits_and_white_space_are_found(spark):
    seen = spark.range(256).selectExpr("id", "decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE') AS c")
    found = {r.id for r in seen.filter(F.concat(F.lit("ab"), "c").rlike(line_dedup.DIGIT_OR_WHITE)).collect()}
    assert found == {9, 11, 12, 13, *range(48, 58)}


def _word_hashes(spark, words):
    return {r.w: r.h for r in spark.createDataFrame([(w,) for w in set(words)], "w string").select("w", F.xxhash64("w").alias("h")).collect()}


def test_text_table_equals_a_plain_sketch(docs, spark):
    """long and short, repetitive, empty and odd texts; hashes are made once, sorting and cutting run compiled."""
    rng = random.Random(11)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(n)) for n in (1, 2, 5, 6, 64, 65, 129, 900)]
    texts += ["ab cd " * 400, "", " \n\n", "a  b\tc 12\n\n x1y <*> <*> z", "1 2 3\n4 5 6 seven eight nine", _passage(rng, 700).replace(" ", "\n")]
    words = {t: [["<*>" if any(c in "0123456789" for c in w) else w for w in x.replace("\t", " ").split(" ") if w] for x in t.split("\n")] for t in texts}
    hashed = _word_hashes(spark, [w for ls in words.values() for x in ls for w in x])
    shingles = {}

    def grams(h):
        return [tuple(h[i:i + n]) for n in (3, 6) for i in range(len(h) - n + 1)]
    flat = {t: [hashed[w] for x in ls for w in x] for t, ls in words.items()}
    for n in (3, 6):
        every = {g for h in flat.values() for g in grams(h) if len(g) == n}
        names = [f"c{j}" for j in range(n)]
        df = spark.createDataFrame(list(every), ", ".join(f"{c} bigint" for c in names))
        shingles |= {tuple(r[:n]): r[n] for r in df.select(*names, F.xxhash64(*names)).collect()}
    table = line_dedup.text_table(docs(list(enumerate(texts))))
    got = {bytes(r.key): r for r in table.collect()}
    for t, h in flat.items():
        r = got[md5(t.encode()).digest()]
        first = {n: {shingles[g] for g in grams(h) if len(g) == n and g[0] & 3 == 0} for n in (3, 6)}
        short = len(h) <= 64 or len(first[3]) < 16
        assert (r.sk.n, r.sk.short) == (len(h), short)
        assert r.sk.s == (None if short else sorted(first[3])[:64])
        assert r.sk.w == (sorted(set(h))[:128] if short or len(h) <= 128 else None)
        assert r.sk.b == (sorted({shingles[g] for g in grams(h)})[:32] if short else sorted(first[6])[:16])
        assert [(x.no, x["size"]) for x in r.ls] == [(i, len(x)) for i, x in enumerate(words[t]) if len(x) >= 3]
        assert r.any == bool(r.ls)


def test_digits_are_masked_in_linear_time(spark):
    """a word that is very long is read once, not once from each of its characters."""
    long = "q" * 400_000
    df = spark.createDataFrame([(f"{long} a1 1 b {long}2 c-3-d  e",)], "x string")
    assert df.select(line_dedup.masked_tokens(F.col("x"))).first()[0] == [long, "<*>", "<*>", "b", "<*>", "<*>", "e"]
