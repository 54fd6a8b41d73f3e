"""Ordered differences: both texts are rebuilt, small scripts are shortest, listing and hunks by hand."""

import random

import pytest

from redline.operators import ordered_diff as D
from redline.plans.registry import QUERIES, load_all

load_all()


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@pytest.fixture(scope="module")
def texts():
    """(template, contract) texts: edits, moves, repeats, empties, nulls and odd line ends."""
    rng = random.Random(11)
    out = [("", ""), (None, "a\nb"), ("a\nb", None), ("a", "a"), ("x\n" * 40, "x\n" * 25), ("a\r\nb\x0bc d\n\n", "a\nb\nc\nd\n\n"),
           ("-- dash\nkeep\n++ plus", "keep\n++ plus too\n-- x"), ("1\n2\n3\n4", "3\n4\n1\n2")]
    for _ in range(40):
        a = [rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 30))]
        b = [x for x in a if rng.random() > 0.2]
        for _ in range(rng.randint(0, 6)):
            b.insert(rng.randint(0, len(b)), rng.choice("abcxyz"))
        out.append(("\n".join(a), "\n".join(b)))
    base = [f"line {i}" for i in range(400)]
    out.append(("\n".join(base), "\n".join(base[200:] + ["new", ""] * 30 + base[:200])))
    return out


def _script(spark, texts, **kw):
    c = spark.createDataFrame([(f"c{k}", b, "t") for k, (_, b) in enumerate(texts)], "id string, extracted_text string, line string")
    t = spark.createDataFrame([(f"t{k}", a, "t") for k, (a, _) in enumerate(texts)], "id string, content string, side string")
    pairs = spark.createDataFrame([(f"c{k}", f"t{k}") for k in range(len(texts))] * 2 + [("c0", None)], "contract_id string, template_id string")
    return D.edit_script(pairs, c, t, **kw)


def _by_pair(script):
    got = {}
    for r in script.orderBy("seq").collect():
        got.setdefault(int(r.contract_id[1:]), []).append((r.seq, r.op, r.content))
    return got


@pytest.mark.parametrize("most", [D.MAX_MATCHES, 10])
def test_scripts_rebuild_both_texts_and_small_ones_are_shortest(spark, texts, most):
    got = _by_pair(_script(spark, texts, max_matches=most))
    for k, (a, b) in enumerate(texts):
        rows = got.get(k, [])
        a, b = (a or "").splitlines(), (b or "").splitlines()
        assert [s for s, _, _ in rows] == list(range(len(rows)))
        assert [x for _, op, x in rows if op != "added"] == a and [x for _, op, x in rows if op != "removed"] == b
        kept = sum(op == "equal" for _, op, _ in rows)
        assert kept <= _lcs(a, b) and (most == 10 or kept == _lcs(a, b))
        for (_, one, _), (_, two, _) in zip(rows, rows[1:]):
            assert (one, two) != ("added", "removed")


def test_longest_chain():
    assert D.longest_chain([], []) == []
    assert [(i, j) for i, j in sorted((([0, 0, 1, 1, 2])[m], ([1, 0, 1, 0, 2])[m]) for m in D.longest_chain([0, 0, 1, 1, 2], [1, 0, 1, 0, 2]))] \
        == [(0, 0), (1, 1), (2, 2)]


def test_listing_numbers_context_and_skips_equal_runs(spark):
    lines = [str(i) for i in range(20)]
    changed = lines[:5] + ["new"] + lines[6:15] + lines[16:]
    texts = [("\n".join(lines), "\n".join(changed)), ("-- gone\nsame\nold", "same\n++ more\nnew"), ("same", "same")]
    script = _script(spark, texts)
    rows = sorted((r.contract_id, r.line_number, r.type, r.content, r.context) for r in D.template_diff(script).collect())
    # 2 3 4 -5 +new 6 7 8 | 12 13 14 -15 16 17 18
    assert [r for r in rows if r[0] == "c0"] == [("c0", 3, "removed", "5", "template"), ("c0", 4, "added", "new", "contract"),
                                                 ("c0", 11, "removed", "15", "template")]
    # A removed line with -- and an added one with ++ read as headers: not listed, not counted.
    assert [r for r in rows if r[0] == "c1"] == [("c1", 1, "removed", "old", "template"), ("c1", 2, "added", "new", "contract")]
    assert not [r for r in rows if r[0] == "c2"]
    got = sorted((r.contract_id, r.hunk, r.first_seq, r.last_seq, r.n_removed, r.n_added) for r in D.hunks(script).collect())
    assert got[:2] == [("c0", 0, 2, 9, 1, 1), ("c0", 1, 13, 19, 1, 0)] and len([g for g in got if g[0] == "c1"]) == 1
    by_line = D.diff_by_line(D.template_diff(script), 2).where("contract_id = 'c0'").orderBy("line_number").collect()
    assert [(r.line_number, list(r.removed), list(r.added)) for r in by_line] == [(3, ["5"], []), (4, [], ["new"])]


def test_registered_differences_rebuild_every_pair(spark, sf):
    from redline.sources import views as V
    texts = {r.id: r.extracted_text.splitlines() for r in V.contract_files(spark, sf).collect()}
    content = {r.id: r.content.splitlines() for r in V.contract_templates(spark, sf).collect()}
    rows = {}
    for r in QUERIES["edit_script"](spark, sf).orderBy("seq").collect():
        rows.setdefault((r.contract_id, r.template_id), []).append(r)
    assert len(rows) == QUERIES["diff_counts"](spark, sf).count()
    for (c, t), script in rows.items():
        assert [r.content for r in script if r.op != "added"] == content[t]
        assert [r.content for r in script if r.op != "removed"] == texts[c]
    assert QUERIES["template_diff"](spark, sf).count() > 10 and QUERIES["diff_by_line"](spark, sf).count() > 10
