"""Packing: the tokenizer's own ids, whole coverage, sequence limits, against brute force."""

import random
import zlib

import numpy as np
import pytest

from redline.llm import packing as K
from redline.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")
ODD = ["", "  ", "Don't it's we'll I'M THEY'RE", "á éx ́y", "ΣΑΣ ΟΔΟΣ İstanbul", "<|startoftext|> hi <|endoftext|>",
       "x\x01y \x01 z", "a b c\x1cd\u0085e f", "日本語 テキスト 123 4５6", "\x00 ab\x00c", "ﬁ Å ẞ ß", "'s 's's '", "‍​",
       "A,b,C. D., e!. ... f.g", "Été, l'été. ÉTÉ... naïve? 12,5 a1b2"]


def _ids(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [t.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]


def test_encoder_equals_tokenizer():
    rng, e = random.Random(1), K.ChunkEncoder(PATH)
    texts = ODD + [" ".join("".join(rng.choice("abcXYZé.,'-1ß ") for _ in range(rng.randint(1, 9))) for _ in range(200)) for _ in range(20)]
    got = e.encode([t.encode() for t in texts]) + e.encode([t.encode() for t in texts])
    want = _ids(texts)
    assert [list(g) + [0] for g in got] == want + want


def test_encoder_with_little_memory_equals_tokenizer():
    """The worker's chunks are trimmed again and again; hits, ids and keys stay together."""
    rng, e = random.Random(5), K.ChunkEncoder(PATH, cache_bytes=20_000)
    texts = [" ".join("".join(rng.choice("abcXé.,'-1") for _ in range(rng.randint(1, 4))) for _ in range(60)) for _ in range(60)] + ODD
    got = [list(g) + [0] for i in range(0, len(texts), 5) for g in e.encode([t.encode() for t in texts[i:i + 5]])]
    assert got == _ids(texts) and e._bytes() < 60_000


def _check_plan(counts, capacity):
    plan, placed, seen = K.pack_counts(dict(counts), capacity), {}, {}
    for n, rank, k, first, offset, per in plan:
        assert rank == seen.get(n, 0)
        seen[n] = rank + k
        for i in range(k):
            placed.setdefault(first + i // per, []).append((offset + i % per * n, n))
    assert seen == {n: c for n, c in counts.items() if c}
    for parts in placed.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= capacity and sum(3 * n > capacity for _, n in parts) <= 2
    return len(placed)


def test_plans_are_gapless_and_near_the_least():
    rng = random.Random(2)
    for _ in range(150):
        capacity = rng.choice([9, 30, 100, 2048])
        counts = {rng.randint(1, capacity): rng.randint(1, 60) for _ in range(rng.randint(1, 25))}
        least = -(-sum(n * c for n, c in counts.items()) // capacity)
        large = sum(c for n, c in counts.items() if 2 * n > capacity)
        assert _check_plan(counts, capacity) <= max(1.25 * least + 1, 1.25 * large + least / 2 + 2, sum(c for n, c in counts.items() if 3 * n > capacity))


def test_plan_grows_with_lengths_not_rows():
    few = K.pack_counts({n: 3 for n in range(1, 2049)})
    many = K.pack_counts({n: 3_000_000 for n in range(1, 2049)})
    assert len(many) < 3 * len(few) and len(many) < 40_000


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(0, 900))) for _ in range(60)]
    texts += ODD + [None, "long " * 40_000] + ["same text"] * 3
    return list(enumerate(texts)) + [(0, texts[0])] * 2


def test_every_piece_has_its_place(docs, rows):
    want = dict(zip(range(len(rows)), _ids([t for _, t in rows]), strict=True))
    got = K.pack_documents(docs(rows), PATH, with_ids=True).collect()
    assert len(got) == sum(-(-len(w) // 2048) for w in want.values())
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        assert r.length == len(r.ids) <= 2048
        assert r.ids_crc32 == zlib.crc32(np.asarray(r.ids, "<u4").tobytes())
    for n, (i, _) in enumerate(rows):
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        if sum(j == i for j, _ in rows) == 1:
            assert [r.piece for r in parts] == list(range(len(parts))) and [r.start for r in parts] == [2048 * k for k in range(len(parts))]
            assert [x for r in parts for x in r.ids] == want[n]
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 2048
    seqs = {r.sequence_id: len(r.ids) for r in K.sequences(K.pack_documents(docs(rows), PATH, with_ids=True)).collect()}
    assert sum(seqs.values()) == sum(map(len, want.values())) and max(seqs.values()) <= 2048


def test_ranks_over_many_buckets(docs, monkeypatch):
    monkeypatch.setattr(K, "BUCKET_ROWS", 4)
    got = K.pack_documents(docs([(i, "a b c") for i in range(50)]), PATH).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 50 and {r.sequence_id for r in got} == {0}


def test_empty_table(docs):
    assert K.pack_documents(docs([(1, "x")]).limit(0), PATH).count() == 0


def test_large_ids_stay_exact_beside_a_null_one(docs):
    ids = [2**53 + 1, None, 2**60 + 3]
    got = K.pack_documents(docs([(i, "a b c") for i in ids]), PATH).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(map(str, ids))
