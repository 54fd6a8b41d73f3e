"""The pipeline stage by stage on planted documents, and the run as a whole."""

import random

import pytest

import __spark_entry__ as E
import corpus_pipeline as P
from redline.llm import mixing, packing, toxicity


def _prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def planted(tmp_path_factory, llm):
    """A folder with documents and labels: clean and toxic texts, copies, near copies, a passage."""
    rng = random.Random(1)
    passage = _prose(rng, 60)
    rows, labels, kinds, n = [], [], {}, 0

    def add(text, kind, toxic=None):
        nonlocal n
        rows.append((n, text, rng.choice(["en", "de"]), rng.choice(["s0", "s0", "s1"]), len(text or "")))
        kinds[n] = kind
        if toxic is not None:
            labels.append((n, 1, toxic))
        n += 1
    for _ in range(500):
        add("\n".join(_prose(rng, 40) for _ in range(3)), "clean", 0)
    for _ in range(120):
        ws = _prose(rng, 90).split()
        for _ in range(3):
            ws[rng.randrange(90)] = rng.choice(["idiot", "scum", "moron"])
        add(" ".join(ws), "toxic", 1)
    for _ in range(20):
        base = [_prose(rng, 50) for _ in range(3)]
        add("\n".join(base), "clean")
        add("\n".join(base), "copy")
        ws = base[1].split()
        ws[7] = "zzzz"
        add("\n".join([base[0], " ".join(ws), base[2]]), "copy")
    for _ in range(15):
        add("\n".join([_prose(rng, 45), passage, _prose(rng, 45)]), "passage")
    add(None, "clean")
    add("", "clean")
    folder = str(tmp_path_factory.mktemp("planted"))
    llm.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4) \
        .write.parquet(f"{folder}/documents.parquet")
    llm.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, {r[0]: r[1] for r in rows}, kinds, passage


def test_stages_on_planted_documents(llm, planted):
    folder, texts, kinds, passage = planted
    docs, seen = llm.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in P.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        docs = P.stored(stage(llm, docs, folder), f"test-{name}")
        seen.append(name)
        if name == "packing":
            assert {r.doc_id for r in docs.collect()} == set(before)
            assert {"doc_id", "piece", "start", "length", "sequence_id", "offset"} <= set(docs.columns)
            continue
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = {r.doc_id: r.text for r in docs.collect()}
        gone = {kinds[i] for i in set(before) - set(after)}
        if name == "toxicity":
            assert gone == {"toxic"} and sum(kinds[i] == "toxic" for i in after) <= 6
        elif name == "line_dedup":
            assert not gone and not any(passage in (t or "") for t in after.values())
            assert all(after[i] == texts[i] for i in after if kinds[i] in ("clean", "copy"))
        elif name == "near_dedup":
            assert gone == {"copy"} and not any(kinds[i] == "copy" for i in after)
        else:
            words = {i: len((t or "").split()) for i, t in before.items()}
            assert 0.6 < sum(words[i] for i in after) / sum(words.values()) < 0.8
    assert seen == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]


def test_run_equals_the_stages(llm, planted):
    folder = planted[0]
    docs = llm.read.parquet(f"{folder}/documents.parquet")
    for name, stage in P.STAGES:
        docs = P.stored(stage(llm, docs, folder), f"test-{name}")
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = E.queries()["pipeline"](llm, folder)
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, docs.select(*cols).collect()))


def test_stages_call_the_operators():
    names = set(P.toxicity.__code__.co_names) | set(P.mixing.__code__.co_names) | set(P.packing.__code__.co_names)
    assert {"keep_clean", "mixed", "pack_documents"} <= names
    assert toxicity.keep_clean and mixing.mix and packing.pack_documents


def test_empty_documents(llm, planted):
    folder = planted[0]
    docs = llm.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in P.STAGES:
        docs = P.stored(stage(llm, docs, folder), f"test-{name}")
        assert docs.count() == 0
