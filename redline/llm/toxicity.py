"""Toxicity: a counterfactual-regularised linear classifier.

Features of a text are its distinct lower-case words and their leading ``PREFIXES`` characters.
1. The model learns from labelled rows outside the held-out fold, at most ``MAX_FIT_ROWS`` of them
   (the smallest hashes of their ids).  Spark counts in how many of their toxic and clean texts
   each feature occurs and keeps the ``MAX_FEATURES`` with the largest likelihood ratio (``MIN_RATIO`` at
   least), besides the identity terms themselves.
2. Weights are fitted on the same rows.  Every text that holds an identity term is paired with a copy in
   which the term is swapped for another one of its group; the loss is the log loss plus
   ``counterfactual`` times the squared difference of the two scores before the logistic, so that
   a weight which only tells groups apart costs more than it earns.
3. Whole texts are scored in Arrow batches; tasks hold the bounded weight table only.

Defined cases: null and empty texts have no features and get the intercept's score; null ids and
labels are not learned from; of repeated label rows each counts; without labelled rows of both
classes every score is the smoothed share of toxic rows (0 without any); an empty table gives no
rows; columns other than those named are ignored.
"""

from __future__ import annotations

import hashlib
import math
import string
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redline.llm.common import stored, worker_state

MAX_FEATURES = 1500
MIN_DOCS = 3
#: Least likelihood ratio of a feature: with up to some hundred thousand candidates a smaller one
#: is no evidence.
MIN_RATIO = 20.0
MAX_FIT_ROWS = 20_000
PREFIXES = (3, 4, 5, 6, 7)
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
#: Entries of a task's word cache before it starts afresh (memory bound, no effect on results).
CACHE_WORDS = 200_000
#: Texts whose features are counted together in a task (memory bound).
COUNT_TEXTS = 1000

#: Groups of terms that may stand for each other in a sentence; the first term is the neutral one.
IDENTITY_GROUPS: tuple[tuple[str, ...], ...] = (
    ("people", "women", "men", "immigrants", "refugees", "foreigners"),
    ("believers", "christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("religious", "christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("person", "woman", "man", "immigrant", "refugee", "foreigner"),
    ("human", "gay", "lesbian", "bisexual", "transgender", "straight", "queer"),
    ("citizen", "american", "african", "asian", "european", "mexican", "arab"),
    ("abled", "disabled", "blind", "deaf", "autistic"),
    ("someone", "black", "white", "latino"),
)
_EDGE = string.punctuation + "«»„“”‘’…¿¡"


def word_features(token: str) -> tuple[str, ...]:
    """The bare lower-case word of a token and its leading characters (none for bare symbols)."""
    w = token.strip(_EDGE)
    return (w, *("^" + w[:n] for n in PREFIXES if len(w) > n)) if w else ()


def text_features(text: str | None) -> set[str]:
    return {f for t in set((text or "").lower().split()) for f in word_features(t)}


@dataclass
class Model:
    """``weights`` by feature, at most MAX_FEATURES plus the identity terms."""

    weights: dict[str, float] = field(default_factory=dict)
    intercept: float = 0.0
    constant: float | None = None


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def _count_features(batches):
    """Per run of COUNT_TEXTS texts: texts with the feature, by label."""
    worker_state("toxicity-fit", dict)
    for pdf in batches:
        for at in range(0, len(pdf), COUNT_TEXTS):
            part = pdf.iloc[at:at + COUNT_TEXTS]
            n: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, y in zip(part["text"], part["toxic"], strict=True):
                n[y].update(text_features(text))
            keys = list(n[0].keys() | n[1].keys())
            yield pd.DataFrame({"feature": keys, "clean": [n[0][k] for k in keys], "toxic": [n[1][k] for k in keys]})


def likelihood_ratio(toxic: Column, clean: Column, all_toxic: int, all_clean: int) -> Column:
    """G2 statistic of the 2 x 2 table of feature and label."""
    total = all_toxic + all_clean
    have = toxic + clean

    def part(o: Column, e: Column) -> Column:
        return F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    return 2 * (part(toxic, have * all_toxic / total) + part(clean, have * all_clean / total)
                + part(all_toxic - toxic, (total - have) * all_toxic / total)
                + part(all_clean - clean, (total - have) * all_clean / total))


def select_features(train: DataFrame, all_toxic: int, all_clean: int) -> list[str]:
    """The top features of ``train(text, toxic)``; ties go to the smaller feature."""
    counts = (train.select("text", "toxic").mapInPandas(_count_features, "feature string, clean long, toxic long")
              .groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
              .filter(F.col("clean") + F.col("toxic") >= MIN_DOCS))
    g = likelihood_ratio(F.col("toxic"), F.col("clean"), all_toxic, all_clean)
    top = counts.select("feature", F.round(g, 6).alias("g")).filter(F.col("g") >= MIN_RATIO).orderBy(F.desc("g"), "feature").limit(MAX_FEATURES)
    return [r["feature"] for r in top.collect()]


def _swap(groups) -> dict[str, str]:
    """Each identity term's stand-in: the next one of its group."""
    return {t: g[(i + 1) % len(g)] for g in groups for i, t in enumerate(g)}


def _encode(batches, index: dict[str, int], groups):
    """(toxic, feature numbers, feature numbers of the swapped copy or null)."""
    swap = _swap(groups)
    for pdf in batches:
        rows = []
        for text, y in zip(pdf["text"], pdf["toxic"], strict=True):
            tokens = {t.strip(_EDGE) for t in set((text or "").lower().split())}
            own = sorted({index[f] for t in tokens for f in word_features(t) if f in index})
            other = None
            if not swap.keys().isdisjoint(tokens):
                other = sorted({index[f] for t in tokens for f in word_features(swap.get(t, t)) if f in index})
            rows.append((int(y), own, other))
        yield pd.DataFrame(rows, columns=["toxic", "own", "other"])


def fit_weights(y: np.ndarray, own: list, other: list, n_features: int, counterfactual: float = 5.0,
                l2: float = 2e-4, steps: int = 400, rate: float = 0.3) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the log loss plus the counterfactual and the ridge penalty."""
    def flat(lists):
        return (np.repeat(np.arange(len(lists)), [len(x) for x in lists]),
                np.fromiter((i for x in lists for i in x), dtype=np.int64))
    row, col = flat(own)
    pairs = [(a, b) for a, b in zip(own, other, strict=True) if b is not None]
    drow, dcol, dsign = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    if pairs:
        ra, ca = flat([a for a, _ in pairs])
        rb, cb = flat([b for _, b in pairs])
        drow, dcol = np.concatenate([ra, rb]), np.concatenate([ca, cb])
        dsign = np.concatenate([np.ones(len(ca)), -np.ones(len(cb))])
    n = len(y)
    base = math.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    w, b = np.zeros(n_features), base
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, steps + 1):
        z = np.bincount(row, weights=w[col], minlength=n) + b
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.bincount(col, weights=err[row], minlength=n_features) / n + l2 * w
        if len(pairs):
            d = np.bincount(drow, weights=dsign * w[dcol], minlength=len(pairs))
            g += counterfactual * 2 * np.bincount(dcol, weights=dsign * d[drow], minlength=n_features) / n
        grad = np.append(g, err.mean())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        step = rate * min(1.0, 2 * (1 - t / (steps + 1))) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", counterfactual: float = 5.0, groups=IDENTITY_GROUPS,
        max_rows: int = MAX_FIT_ROWS) -> Model:
    """Learn from the labelled rows outside the held-out fold: one text per id (the smallest, where ids
    repeat), toxic if any of its labels says so."""
    y = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
    y = y.filter(F.col("toxic").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    # At most max_rows ids: small enough to broadcast, so that only their texts are shuffled.
    chosen = y.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # One row per id, however often documents repeat it: no more than max_rows rows are ever collected.
    train = (texts.join(F.broadcast(chosen), "id").groupBy("id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"))
    train = stored(train, "toxicity-sample")
    n = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    clean, toxic = n.get(0, 0), n.get(1, 0)
    if not clean or not toxic:
        return Model(constant=toxic / max(1, clean + toxic))
    features = select_features(train, toxic, clean)
    features += sorted({t for g in groups for t in g} - set(features))
    index = {f: i for i, f in enumerate(features)}
    rows = train.mapInPandas(lambda b: _encode(b, index, groups),
                             "toxic int, own array<int>, other array<int>").collect()
    # Adam's sums depend on the order of the rows, which Spark does not fix.
    rows = sorted((r["toxic"], tuple(r["own"]), r["other"] is not None, tuple(r["other"] or ())) for r in rows)
    w, b = fit_weights(np.array([r[0] for r in rows], float), [r[1] for r in rows],
                       [r[3] if r[2] else None for r in rows], len(features), counterfactual)
    return Model({f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-6}, b)


def scorer(model: Model):
    """A pandas function column: score of each text."""
    weights, intercept, constant = model.weights, model.intercept, model.constant
    key = ("toxicity", hashlib.md5(repr(sorted(weights.items())).encode()).hexdigest())

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if constant is not None:
            return pd.Series(np.full(len(texts), float(constant)))
        out = np.empty(len(texts))
        cache: dict[str, tuple[str, ...]] = worker_state(key, dict)
        for i, text in enumerate(texts):
            seen: set[str] = set()
            for t in set(text.lower().split()) if text else ():
                f = cache.get(t)
                if f is None:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    f = cache[t] = tuple(x for x in word_features(t) if x in weights)
                if f:
                    seen.update(f)
            z = intercept + math.fsum(weights[f] for f in seen)
            out[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        return pd.Series(out)
    return score


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic", threshold: float = THRESHOLD, **fit_args) -> DataFrame:
    """(id, held_out, score, predicted) for every document."""
    model = fit(docs, labels, id_col, text_col, label_col, **fit_args)
    scored = docs.select(F.col(id_col).alias(id_col), held_out(F.col(id_col)).alias("held_out"),
                         scorer(model)(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               label_col: str = "toxic", threshold: float = THRESHOLD, **fit_args) -> DataFrame:
    """The documents scored below the threshold, all columns."""
    model = fit(docs, labels, id_col, text_col, label_col, **fit_args)
    return docs.filter(scorer(model)(F.col(text_col)) < threshold)
