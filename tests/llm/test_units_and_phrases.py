"""Fill-in-middle, sentencepiece chunks and phrase mining against brute force and the library."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from redline.llm import fill_in_middle as M
from redline.llm import phrases as P
from redline.llm import sentence_pieces as S
from redline.llm.queries import tokenizer_path

MODEL = tokenizer_path("piece_bpe_32k.model")
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = ["", " ", "  ", "a", "a" * 8, "a" * 7 + " ", " " * 8, " " * 17, "x\x00y \x0b z\x1c", "日本語 テキスト ", "𝄞 é\u0085\xa0 ",
       "▁x ▁ ▁▁y", "a▁ b ▁", "<s> </s> <0x41>", "has <P> in it", "< S> <M", "tail \n\n"]


def _random_texts(n, alphabet, most, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, most))) for _ in range(n)]


TEXTS = ODD + _random_texts(400, "ab \t\n\x0b\x0c\r\x1c\x85é日𝄞<PSM>▁", 70, 1)
#: Ids that doubles cannot hold, null ids and a repeated row.
BIG = [(2**53 + 1, "one two three four five six"), (None, "a b"), (2**60 + 3, "p q r s t"), (2**60 + 3, "p q r s t"), (7, None)]


# --- fill-in-middle ---------------------------------------------------------------------------

def test_units_and_cuts_equal_the_pattern():
    units, want = M.Units([t.encode() for t in TEXTS]), [[len(x.encode()) for x in UNIT.findall(t)] for t in TEXTS]
    assert units.n.tolist() == [len(w) for w in want]
    rng = random.Random(2)
    for _ in range(30):
        k = np.array([rng.randint(0, len(w)) for w in want])
        assert units.cut(k).tolist() == [sum(w[:i]) for w, i in zip(want, k, strict=True)]


def _fim(key, text):
    """The contract, by hand: (n, form, prefix characters, middle characters, output)."""
    text = text or ""
    h = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    u = UNIT.findall(text)
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(u), "plain", None, None, text
    pre, mid, suf = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h4 % 100 < 80:
        return len(u), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(u), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_in_middle_equals_brute_force_and_is_restored(docs):
    rows = list(enumerate(TEXTS)) + BIG + [(9, "long \t text " * 60_000)]
    df = M.fill_in_middle(docs(rows))
    got = df.withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(repr, [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got])) == \
        sorted(map(repr, [(i, *_fim(i, t)) for i, t in rows]))
    assert Counter(r.back for r in got) == Counter(t or "" for _, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_empty_table(docs):
    assert M.fill_in_middle(docs([(1, "x")]).limit(0)).count() == 0


# --- sentencepiece ----------------------------------------------------------------------------

def _library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_model_splits_at_markers_and_others_do_not():
    sp = _library()
    assert S.splits_at_markers(sp)

    class Crossing:
        normalize, get_piece_size = sp.normalize, staticmethod(lambda: 1)

        @staticmethod
        def id_to_piece(_):
            return "of▁the"
    assert not S.splits_at_markers(Crossing)


@pytest.mark.parametrize("bound", [S.TABLE_BYTES, 2000])
def test_chunk_ids_equal_the_library(monkeypatch, bound):
    monkeypatch.setattr(S, "TABLE_BYTES", bound)
    table, texts = S.ChunkTable(MODEL), TEXTS + _random_texts(300, "ab  ▁\n日𝄞,A<s>\x00", 90, 3)
    got = [x.tolist() for i in range(0, len(texts), 50) for x in table.encode(texts[i:i + 50])]
    assert got == [_library().encode(t) for t in texts]
    table.whole = True
    assert [x.tolist() for x in table.encode(texts)] == got


def test_transcode_round_trip(docs):
    rows = list(enumerate(TEXTS)) + BIG + [(9, "long word " * 50_000), (10, "x" * 300_000)]
    df, sp = docs(rows), _library()
    want = []
    for i, t in rows:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, ids, sp.decode(ids)))
    got = [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in S.transcode(df, MODEL).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    back = S.decode(S.encode(df, MODEL), MODEL).collect()
    assert sorted(map(repr, [(r.doc_id, r.decoded) for r in back])) == sorted(map(repr, [(i, d) for i, _, d in want]))
    assert S.transcode(df.limit(0), MODEL).count() == 0


# --- phrases ----------------------------------------------------------------------------------

def _counts(rows):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    return f, n


def _collocations(rows, least, top):
    f, n = _counts(rows)
    out = []
    for lang in n:
        mine = {p: c for (g, p), c in f.items() if g == lang and c >= least}
        around = Counter()
        for p, c in mine.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    around[p[i:i + k]] = max(around[p[i:i + k]], c)
        scored = []
        for p, a in mine.items():
            if len(p) > 1 and not 100 * around[p] >= 80 * a:
                score, k = min((2_000_000 * a // (mine[p[:k]] + mine[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), mine[p[:k]], mine[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = ["The", "of", "a", "é", "Ünd", "x1", "日本", "b", "\x00q", "mm", "\x1c", "z"]
    rows = [(rng.choice(["en", "en", "en", "de", None]),
             "".join(rng.choice(words) + rng.choice([" "] * 8 + ["  ", "\t", ". ", ",", "\n", "\r\n", "!? "]) for _ in range(rng.randint(0, 60))))
            for _ in range(250)]
    return rows + [("en", None), ("de", ""), (None, " . "), ("en", "the end of " * 3000), ("en", "aa bb cc dd. ee ff " * 40)]


def _run(llm, rows, least, top):
    df = llm.createDataFrame([(t, g, 1, "u") for g, t in rows], "text string, lang string, f int, unit string").repartition(3)
    return sorted(tuple(r) for r in P.collocations(df, min_count=least, top=top).collect())


def test_collocations_equal_brute_force(llm, corpus):
    for top in (60, 7):
        got = _run(llm, corpus, 5, top)
        assert got == _collocations(corpus, 5, top) and len(got) >= 3 * top


def test_windows_and_units_lose_no_phrase_at_the_seams(llm, corpus, monkeypatch):
    blob = b"".join(P.canonical((t or "").encode()) for _, t in corpus)

    def counted():
        return Counter((n, int(x), int(c)) for g in P._windows(blob, "en") for n in range(1, 5)
                       for i, fp in [g.at(n)] for x, c in zip(fp, g.checks(i, n), strict=True))
    want = counted()
    monkeypatch.setattr(P, "WINDOW_BYTES", 40)
    assert counted() == want
    words = Counter((len(p), " ".join(p)) for (_, p), c in _counts([("en", t) for _, t in corpus])[0].items() for _ in range(c))
    assert sorted(words.values()) == sorted(want.values())
    # Units are cut between pieces, and have as many numbers as their size needs.
    monkeypatch.setattr(P, "UNIT_BYTES", 30)
    parts = list(P._blobs(blob))
    assert b"".join(parts) == blob and len(parts) > 50 and all(p.endswith(b"\n") for p in parts)
    units = P._units(llm.createDataFrame(corpus, "lang string, text string").coalesce(1), "text", "lang").collect()
    assert sum(len(u.text) for u in units) == len(blob) and len({u.unit for u in units}) == len(units)


def test_long_text_without_delimiter(llm):
    """A unit beyond the greatest byte of a pointer."""
    text = ("x" * 1000 + " ") * 17_500 + "bb cc " * 40
    df = llm.createDataFrame([(text, "en")], "text string, lang string")
    assert sorted(tuple(r) for r in P.collocations(df).collect()) == _collocations([("en", text)], 30, 2000)


@pytest.mark.parametrize("bits", [64, 7])
def test_colliding_fingerprints_are_counted_by_text(llm, corpus, bits):
    """With fingerprints of 7 bits nearly all stand for several phrases."""
    df = llm.createDataFrame([(t, g) for g, t in corpus], "text string, lang string")
    assert sorted(tuple(r) for r in P.collocations(df, min_count=5, top=60, bits=bits).collect()) == _collocations(corpus, 5, 60)
    units = P.stored(P._units(df, "text", "lang"), "t-units")
    marks = [P._bitmap(P._count_level(units, n, None, bits).select("fp")) for n in range(1, 5)]
    found = P._occurrences(units, marks, bits)
    assert (found.filter("c0 <> c1").count() > 0) == (bits == 7)
    # All n-grams are marked here: counts and the texts behind the pointers are those of brute force.
    if bits == 64:
        f, _ = _counts(corpus)
        assert {(r.lang, r.phrase): r.f for r in P._pointed(units, found).collect()} == {(g, " ".join(p)): c for (g, p), c in f.items()}


def test_empty_table(llm):
    df = llm.createDataFrame([], "text string, lang string")
    assert P.collocations(df).count() == 0
    df = llm.createDataFrame([(None, None), ("", "en")], "text string, lang string")
    assert P.collocations(df).count() == 0
