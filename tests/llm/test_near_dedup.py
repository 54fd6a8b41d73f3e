"""Near duplicates against brute force, and the parts of the method."""

import random

import numpy as np
import pytest

from redline.llm import near_dedup as N
from redline.llm.common import stored
from redline.llm.components import components


def _words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]


def _similarity(a, b):
    """The definition: sum over common d of 1 / sum_e max(a_e / a_d, b_e / b_d)."""
    keys = set(a) | set(b)
    return sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in keys) for d in set(a) & set(b))


def _shingles(text):
    ws = text.split()
    out = {}
    for i in range(max(1, len(ws) - 4) if ws else 0):
        out[tuple(ws[i:i + 5])] = out.get(tuple(ws[i:i + 5]), 0) + 1
    return out


def test_similarity_and_signature_estimate():
    rng, s = random.Random(1), N.Shingler()
    errors = []
    for rep in range(30):
        a = _words(rng, 120)
        b = [w if rng.random() > rep / 150 else "x" for w in a] + a[:rep]
        d, x, w = s.shingles([[t.encode() for t in a], [t.encode() for t in b]])
        exact = N.probability_jaccard(x[d == 0], w[d == 0], x[d == 1], w[d == 1])
        assert exact == pytest.approx(_similarity(_shingles(" ".join(a)), _shingles(" ".join(b))), abs=1e-9)
        sig = N.signatures(d, x, w, 2)
        errors.append((sig[0] == sig[1]).mean() - exact)
    assert abs(np.mean(errors)) < 0.03 and max(map(abs, errors)) < 0.2


def test_signature_scale_and_short_texts():
    s = N.Shingler()
    texts = [t.encode().split() for t in ["a b c", "a b c", "one two three four five six", "x " * 40, "x " * 80, ""]]
    d, x, w = s.shingles(texts)
    assert [int((d == i).sum()) for i in range(6)] == [1, 1, 2, 1, 1, 0]
    sig = N.signatures(d, x, w, 6)
    assert (sig[0] == sig[1]).all() and (sig[3] == sig[4]).all() and (sig[5] == 0).all()


def test_sets_equal_single_calls():
    rng, s = random.Random(2), N.Shingler()
    texts = [[w.encode() for w in _words(rng, n)] for n in (0, 1, 4, 5, 6, 300, 0, 17)]
    for (x, w), t in zip(s.sets(texts), texts, strict=True):
        d, x1, w1 = s.shingles([t])
        assert (x == x1).all() and (w == w1).all()


def test_components_equal_union_find(llm):
    rng = random.Random(3)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(150)] + [(1000, i) for i in range(1001, 1200)]
    edges += [(i, i + 1) for i in range(3000, 3060)]
    own = {}

    def find(v):
        while own.get(v, v) != v:
            v = own[v]
        return v
    for u, v in edges:
        a, b = find(u), find(v)
        own[max(a, b)] = min(a, b)
    nodes = {x for e in edges for x in e}
    want = {x: find(x) for x in nodes if find(x) != x}
    got = {r.node: r.root for r in components(llm.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want


def _brute(rows):
    sets = {i: _shingles(t) for i, t in rows if t and t.split()}
    own = {i: i for i in sets}

    def find(i):
        while own[i] != i:
            i = own[i]
        return i
    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if set(sets[i]) & set(sets[j]) and _similarity(sets[i], sets[j]) >= N.THRESHOLD - 1e-9:
                a, b = find(i), find(j)
                own[max(a, b)] = min(a, b)
    return {i: find(i) if i in sets else i for i, _ in rows}


@pytest.fixture(scope="module")
def corpus():
    """Families of copies at many distances, a hot group of near copies that also differ from each
    other, shared passages, and the cases the docstring defines."""
    rng = random.Random(7)
    rows, n = [], 0
    for _ in range(12):
        base = _words(rng, rng.randint(20, 150))
        for k in range(4):
            rows.append((n := n + 1, " ".join(w if rng.random() > k * 0.02 else rng.choice("xyz") for w in base)))
    hot = _words(rng, 90)
    for _ in range(150):
        text = list(hot)
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(90)] = _words(rng, 1)[0]
        rows.append((n := n + 1, " ".join(text)))
    passage = _words(rng, 60)
    for _ in range(10):
        rows.append((n := n + 1, " ".join(_words(rng, 40) + passage)))
    rows += [(n + i, t) for i, t in enumerate([None, "", " \n", "one", "one", "a b c d", "a  b\nc d", "w " * 5_000, "w " * 9_000], 1)]
    return rows


def test_few_edges_make_few_files_and_stars_no_round(llm, monkeypatch):
    from redline.llm import components as graph
    calls = []
    monkeypatch.setattr(graph, "stored", lambda df, name: calls.append(stored(df, name)) or calls[-1])
    stars = llm.createDataFrame([(1, 2), (1, 3), (5, 4), (6, 4)], "u long, v long")
    assert {r.node: r.root for r in components(stars).collect()} == {2: 1, 3: 1, 5: 4, 6: 4}
    assert len(calls) == 1
    calls.clear()
    old = {k: llm.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        llm.conf.set("spark.sql.shuffle.partitions", "64")
        llm.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        chains = llm.createDataFrame([(20 * c + i, 20 * c + i + 1) for c in range(40) for i in range(7)], "u long, v long")
        got = {r.node: r.root for r in components(chains).collect()}
    finally:
        for k, v in old.items():
            llm.conf.set(k, v)
    assert got == {20 * c + i: 20 * c for c in range(40) for i in range(1, 8)}
    assert len(calls) > 1 and all(len(e.inputFiles()) <= llm.sparkContext.defaultParallelism for e in calls[1:])


def test_classes_equal_brute_force(docs, corpus):
    got = {r.doc_id: r.class_id for r in N.near_duplicate_classes(docs(corpus)).collect()}
    want = _brute(corpus)
    assert got == want
    assert sum(1 for i, c in want.items() if i != c) > 50


def test_one_document_of_each_class_stays(docs, corpus):
    repeated = corpus + [corpus[0], corpus[0], corpus[-9], corpus[-8]]
    df = docs(repeated)
    out = N.drop_near_duplicates(df)
    assert out.columns == df.columns
    ids = sorted(r.doc_id for r in out.collect())
    wordless = [i for i, t in repeated if not (t or "").split()]
    want = sorted([c for i, c in _brute(corpus).items() if i == c and i not in wordless] + wordless)
    assert ids == want


def test_empty_and_single_tables(docs):
    assert N.near_duplicate_classes(docs([(1, "x")]).limit(0)).count() == 0
    assert [tuple(r) for r in N.near_duplicate_classes(docs([(1, "x y z")])).select("doc_id", "class_id").collect()] == [(1, 1)]
    got = {(r.doc_id, r.class_id) for r in N.near_duplicate_classes(docs([(None, "p q r s t u"), (5, "p q r s t u"), (None, "z")])).collect()}
    assert got == {(None, 5), (5, 5), (None, None)}


def test_large_ids_stay_exact_beside_a_null_one(docs):
    rows = [(2**53 + 1, "one two three four five six seven"), (None, "a b c d e f g h"), (2**60 + 3, "p q r s t u v w x"),
            (2**60 + 4, "p q r s t u v w x")]
    assert {(r.doc_id, r.class_id) for r in N.near_duplicate_classes(docs(rows)).collect()} == {
        (2**53 + 1, 2**53 + 1), (None, None), (2**60 + 3, 2**60 + 3), (2**60 + 4, 2**60 + 3)}
    assert {r.doc_id for r in N.drop_near_duplicates(docs(rows)).collect()} == {2**53 + 1, None, 2**60 + 3}
