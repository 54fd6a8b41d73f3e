"""Top-k search, mixing, token counts and toxicity against brute force or held-out rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from redline.llm import mixing, token_counts, topk, toxicity
from redline.llm.queries import tokenizer_path


def _brute_top(rows, k):
    vecs = sorted({(i, tuple(int(np.floor(64.0 * x)) for x in v)) for i, v in rows
                   if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)})
    out = []
    for q in sorted({i for i, _ in vecs if i % 20 == 0}):
        own = min(v for i, v in vecs if i == q)
        scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in vecs if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def test_topk_equals_brute_force(llm, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "SET", 4)
    rng = random.Random(1)
    same = [0.5, -0.25, 0.125, 0.0]
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)] if i % 3 else same) for i in range(300)]       # a third are one vector
    rows += [(400, None), (401, [1.0, None, 0.0, 0.0]), (402, [float("nan")] * 4), (420, [float("inf"), 0.0, 0.0, 0.0]), (440, []),
             (441, [2.0]), (460, [1e9, 1.0, -1e9, 0.0]), (None, same), (5, rows[5][1]), (20, same), (20, [0.9] * 4)]
    df = llm.createDataFrame([(*r, 1, b"x") for r in rows], "vec_id long, embedding array<double>, rank int, ids binary")
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, 7)
    want = _brute_top([r for r in rows if r[0] != 460], 7)
    plain = topk.top_k(df.filter("vec_id <> 460"), F.col("vec_id") % 20 == 0, 7)
    assert sorted(map(tuple, plain.select("query_id", "rank", "vec_id", "score").collect())) == want
    assert got.filter("query_id = 460").count() == 7          # beyond the bound: held, no overflow
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0
    assert topk.top_k(df.filter("vec_id = 20"), F.lit(True), 3).count() == 0


@pytest.mark.parametrize("largest, k", [(1.5, 30), (600.0, 150), (1e7, 1)])
def test_topk_over_slabs_and_groups(llm, monkeypatch, largest, k):
    """Vectors of 8 and 32 bits, sums of floats and longs, queries in several groups, more asked for than a slab or the table holds."""
    for name, value in (("BLOCK", 4), ("SET", 2), ("QUERIES", 2), ("GROUP", 5), ("SLAB_BYTES", 64)):
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(2)
    rows = [(i, [rng.choice([largest, -largest, 0.0, rng.uniform(-1, 1)]) for _ in range(3)]) for i in range(0, 400, 4)]
    df = llm.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == _brute_top(rows, k)


def test_topk_repeats_no_queries_through_the_driver(llm, monkeypatch):
    """Queries look small to Spark; repeated for many sets of documents they must not be broadcast."""
    for name, value in (("BLOCK", 4), ("SET", 2), ("QUERIES", 8)):
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(3)
    df = llm.createDataFrame([(i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(400)], "vec_id long, embedding array<double>")
    found = topk.top_k(df, F.col("vec_id") % 20 == 0, 3)
    assert found.count() == 60
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_bounds_hold_and_blocks_are_skipped():
    rng = np.random.default_rng(2)
    v = np.sort(rng.integers(-60, 60, (640, 8)), axis=0).astype(np.int32)
    q = rng.integers(-60, 60, (5, 8)).astype(np.int32)
    starts = np.arange(0, 640, 64)
    bounds = topk.block_bounds(q.astype(float), v, starts)
    best = np.stack([(q @ v[s:s + 64].T).max(axis=1) for s in starts], axis=1)
    assert (bounds >= best).all()
    q, calls = np.abs(q) + 1, []   # the last block is best for all
    real = topk._Best.add

    def counted(self, a, s, i):
        calls.append(len(a))
        return real(self, a, s, i)
    topk._Best.add = counted
    try:
        topk.search_blocks(np.full(5, -1), q, np.full(5, -2.0 ** 62), np.arange(640), v, 3, block=64)
    finally:
        topk._Best.add = real
    assert len(calls) < len(starts)


def test_wide_integers_stay_exact():
    q = np.array([[2 ** 28, 1]], np.int32)
    v = np.array([[2 ** 28 - 1, 3], [2 ** 28, 0]], np.int32)
    best = topk.search_blocks(np.array([9]), q, np.full(1, -2.0 ** 62), np.array([1, 2]), v, 2)
    assert list(best.s) == [2 ** 56, 2 ** 56 - 2 ** 28 + 3] and list(best.i) == [2, 1]


def _raked(cells, targets, rounds=500):
    w = {c: float(n) for c, n in cells.items() if n}
    for _ in range(rounds):
        for d, t in enumerate(targets):
            sums = {}
            for c, x in w.items():
                sums[c[d]] = sums.get(c[d], 0) + x
            w = {c: x * t[c[d]] / sums[c[d]] for c, x in w.items()}
    return w


def _mix(df, **kw):
    return mixing.mix(df, F.col("n"), (F.col("source"), F.col("lang"), F.col("topic")), **kw)


@pytest.mark.parametrize("bound", [mixing.MAX_DRIVER_BYTES, 0])
def test_raking_and_budget_equal_brute_force(llm, monkeypatch, bound):
    monkeypatch.setattr(mixing, "MAX_DRIVER_BYTES", bound)      # on the driver, and by joins
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice(["en", "de"]), rng.choice("xyz"), rng.randint(0, 50)) for i in range(3000)]
    df = llm.createDataFrame(rows, "doc_id long, source string, lang string, topic string, n long")
    cells = {}
    for _, s, l, t, n in rows:
        cells[(s, l, t)] = cells.get((s, l, t), 0) + n
    total = sum(cells.values())

    def margin(d):
        out = {}
        for c, n in cells.items():
            out[c[d]] = out.get(c[d], 0) + n
        return out

    def tempered(d, alpha):
        p = {v: n ** alpha for v, n in margin(d).items()}
        return {v: x / sum(p.values()) for v, x in p.items()}
    want = _raked(cells, [tempered(0, 0.7), {"en": 0.6, "de": 0.4}, tempered(2, 0.5)])
    out = _mix(df, fixed=(None, {"en": 0.6}, None), keep_share=0.5).collect()
    p = {(r.d0, r.d1, r.d2): r.probability for r in out}
    lo, hi = 0.0, 1e9      # the rate by bisection
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(cells[c], mid * w) for c, w in want.items()) < 0.5 * total else (lo, mid)
    for c, w in want.items():
        assert p[c] == pytest.approx(min(1.0, lo * w / cells[c]), rel=1e-3)
    assert len(out) == len(rows)
    kept = sum(r.weight for r in out if r.selected)
    assert kept == pytest.approx(0.5 * total, rel=0.1)
    again = {r.row.doc_id: r.selected for r in _mix(df.repartition(5), fixed=(None, {"en": 0.6}, None), keep_share=0.5).collect()}
    assert again == {r.row.doc_id: r.selected for r in out}


@pytest.mark.parametrize("bound", [mixing.MAX_DRIVER_BYTES, 0])
def test_targets_of_zero_and_targets_that_no_weights_meet(llm, monkeypatch, bound):
    monkeypatch.setattr(mixing, "MAX_DRIVER_BYTES", bound)
    cells = llm.createDataFrame([("a", "en", "x", 10), ("a", "en", "y", 10), ("b", "en", "y", 10)], "d0 string, d1 string, d2 string, n long")

    def targets(*dims):
        return [llm.createDataFrame(list(d.items()), "value string, target double") for d in dims]
    raked = mixing.rake(cells, targets({"a": 0.6, "b": 0.4}, {"en": 1.0}, {"x": 0.0, "y": 1.0}), rounds=3)
    assert {(r.d0, r.d2): round(r.w, 9) for r in raked.collect()} == {("a", "x"): 0.0, ("a", "y"): 0.6, ("b", "y"): 0.4}
    with pytest.warns(UserWarning, match="raking"):
        mixing.rake(cells, targets({"a": 0.6, "b": 0.4}, {"en": 1.0}, {"x": 0.9, "y": 0.1}), rounds=1)


def test_mixing_cases(llm):
    schema = "doc_id long, source string, lang string, topic string, n long, probability string, d0 int"
    assert _mix(llm.createDataFrame([], schema)).count() == 0
    rows = [(1, None, None, None, None, "p", 1), (None, "a", "en", "x", 0, None, 2), (2, "a", "en", "y", 5, "", 3), (2, "a", "en", "y", 5, "", 3)]
    out = _mix(llm.createDataFrame(rows, schema), keep_share=1.0).collect()
    assert len(out) == 4 and all(r.selected for r in out) and {r.row.probability for r in out} == {"p", None, ""}


def _greedy(word, initial, inner):
    n = i = 0
    while i < len(word):
        pieces = initial if i == 0 else inner
        j = next((j for j in range(len(word), i, -1) if word[i:j] in pieces), None)
        if j is None:
            return 1
        n, i = n + 1, j
    return n


def test_automaton_equals_greedy_matching():
    rng = random.Random(4)
    for _ in range(200):
        words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 5))) for _ in range(6)]
        initial, inner = {w for w in words if rng.random() < 0.6}, {w for w in words if rng.random() < 0.6}
        two, one = token_counts.Automaton(tuple(initial), tuple(inner)), token_counts.Automaton(tuple(initial))
        for _ in range(30):
            w = "".join(rng.choice("ab" if rng.random() < 0.97 else "c") for _ in range(rng.randint(1, 14)))
            assert two.count(w) == _greedy(w, initial, inner)
            assert one.count(w) == _greedy(w, initial, initial)


def test_token_counts_of_texts(llm, docs):
    pieces = token_counts.sentencepiece_vocabulary(tokenizer_path("piece_bpe_32k.model"))
    texts = ["The lease, and the RENT.", None, "", " \t\n", "été 日本 ☃☃", "a" * 5_000, "word " * 20_000, "x\x0by z"]
    v = set(pieces)
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts.token_counts(docs(list(enumerate(texts))), pieces).collect()}
    for i, t in enumerate(texts):
        ws = [w.decode() for w in (t or "").encode().split()]
        assert got[i] == (len(ws), sum({w: _greedy("▁" + w, v, v) for w in set(ws)}[w] for w in ws))
    vocab = ("un", "##aff", "##able", "##a", "##f", "a")
    got = token_counts.token_counts(docs([(1, "unaffable a b")]), vocab, continuation="##").first()
    assert (got.n_words, got.n_tokens) == (3, 3 + 1 + 1)
    assert token_counts.token_counts(docs([(1, "x")]).limit(0), pieces).count() == 0


def _labelled(llm, rows):
    df = llm.createDataFrame([(i, t, y) for i, (t, y) in enumerate(rows)], "doc_id long, text string, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "toxic")


def test_held_out_accuracy_and_cases(llm):
    rng = random.Random(5)
    rows = []
    for _ in range(1500):
        ws, y = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(40)], int(rng.random() < 0.2)
        if y:
            for _ in range(rng.randint(1, 3)):
                ws[rng.randrange(40)] = rng.choice(["idiot", "Scum!!", "moron,", "grobhaft" + rng.choice("abc")])
        rows.append((" ".join(ws), y))
    docs, labels = _labelled(llm, rows)
    extra = llm.createDataFrame([(9001, None), (9002, ""), (9003, "IDIOT " * 20_000), (None, "scum"), (3, "moron"), (3, "moron")], docs.schema)
    out = toxicity.score_documents(docs.unionByName(extra), labels).collect()
    held = [r for r in out if r.held_out and r.doc_id < len(rows)]
    right = [r.predicted == rows[r.doc_id][1] for r in held if r.doc_id != 3]
    assert len(right) > 300 and sum(right) / len(right) > 0.97
    special = {r.doc_id: r.predicted for r in out if r.doc_id is None or r.doc_id > 9000}
    assert special == {9001: 0, 9002: 0, 9003: 1, None: 1} and len(out) == 1506
    assert all(0 <= r.score <= 1 for r in out)
    assert toxicity.keep_clean(docs.unionByName(extra), labels).filter("doc_id = 9003 or doc_id is null").count() == 0
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0
    none = toxicity.score_documents(docs.limit(3), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0}


def test_counterfactual_term_spares_neutral_mentions(llm):
    """A group is named mostly in toxic rows; with the penalty neutral mentions score lower, and
    swapping the group changes the score less."""
    rng = random.Random(6)
    rows = []
    for i in range(2400):
        y = int(rng.random() < 0.3)
        ws = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(15)]
        if y and rng.random() < 0.6:
            ws[0] = "idiot"
        if rng.random() < (0.7 if y else 0.05):
            ws[1] = "muslims"
        elif rng.random() < 0.3:
            ws[1] = "christians"
        rows.append((" ".join(ws), y))
    docs, labels = _labelled(llm, rows)
    asked = llm.createDataFrame([(1, "we met muslims today"), (2, "we met christians today"), (3, "you idiot")], "doc_id long, text string")

    def scores(strength):
        model = toxicity.fit(docs, labels, counterfactual=strength)
        return {r.doc_id: r.s for r in asked.select("doc_id", toxicity.scorer(model)("text").alias("s")).collect()}
    free, bound = scores(0.0), scores(5.0)
    assert free[1] - free[2] > 0.3 and abs(bound[1] - bound[2]) < 0.3 * (free[1] - free[2])
    assert bound[1] < free[1] and bound[3] > bound[1]


def test_large_components_are_exact_or_an_error(llm):
    """Scores above 2^53 that differ by one keep their order; components beyond 2^28 count in full."""
    big = float(2 ** 22 - 1)
    rows = [(0, [big] * 3)] + [(i, [big, big, big - (8 - i) / 64]) for i in range(1, 7)]
    df = llm.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [int(64 * x) for x in v] for i, v in rows}
    want = sorted(((sum(a * b for a, b in zip(whole[0], whole[i])), i) for i in range(1, 7)), key=lambda r: (-r[0], r[1]))[:3]
    got = topk.top_k(df, F.col("vec_id") == 0, 3).orderBy("rank").collect()
    assert [(r.score, r.vec_id) for r in got] == want
    wide = llm.createDataFrame([(0, [5e6, 1.0]), (1, [6e6, 1.0]), (2, [1e8, 0.0])], "vec_id long, embedding array<double>")
    got = topk.top_k(wide, F.col("vec_id") == 0, 2).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, 4096 * 5 * 10 ** 14), (1, 4096 * (3 * 10 ** 13 + 1))]
    far = llm.createDataFrame([(0, [5e17, 1.0]), (1, [6e6, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="out of range"):
        topk.top_k(far, F.col("vec_id") == 0, 1).collect()


def test_toxicity_learns_from_one_row_per_id(llm, monkeypatch):
    """Repeated ids multiply neither labels nor texts: what is collected stays within max_rows."""
    rng = random.Random(9)
    words = [[rng.choice(["sun", "tree", "river", "stone"] + (["vile"] if i % 2 else [])) for _ in range(20)] for i in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(words)]
    labels = [(i, int("vile" in w)) for i, w in enumerate(words)]
    docs = llm.createDataFrame(rows * 50, "doc_id long, text string")
    y = llm.createDataFrame(labels * 3, "doc_id long, toxic int")
    seen = []
    real = toxicity.fit_weights
    monkeypatch.setattr(toxicity, "fit_weights", lambda y, *a, **k: seen.append(len(y)) or real(y, *a, **k))
    once = toxicity.fit(llm.createDataFrame(rows, "doc_id long, text string"), llm.createDataFrame(labels, "doc_id long, toxic int"))
    many = toxicity.fit(docs, y)
    assert seen[0] == seen[1] <= 40 and once == many


def test_token_counts_keep_large_ids_beside_a_null_one(docs):
    got = token_counts.token_counts(docs([(2**53 + 1, "a b"), (None, "c"), (2**60 + 3, None)]), ("▁a", "▁b", "▁c")).collect()
    assert {(r.doc_id, r.n_words, r.n_tokens) for r in got} == {(2**53 + 1, 2, 2), (None, 1, 1), (2**60 + 3, 0, 0)}
