"""Near-duplicate documents by ProbMinHash.

Similarity is the probability Jaccard of the texts' five-word shingles weighted by their counts;
it equals the Jaccard index where no shingle repeats, and 1 minus it is a metric.

1. Signature (ProbMinHash): every shingle is a Poisson process of rate equal to its weight whose
   points fall on random registers; a register keeps the shingle of its earliest point, so two
   texts agree in a register with the probability that is their similarity.  Points are made in
   rounds (first points of all shingles, second points of those still early enough, ...) and a
   shingle stops at its text's time limit; the limit is doubled for the texts that have empty
   registers left.  Registers keep 16 bits of the shingle's hash.
2. Texts with the same words collapse to one node.  Bands of registers are hashed to buckets.
3. In each bucket, nodes are compared with the bucket's leader only; verified links merge classes
   and the leader retires.  Buckets whose nodes then share a class are done.  The nodes of the other
   buckets form groups (what buckets connect), which are compared in blocks of bounded size; pairs
   of one class are skipped there.  So every pair that shares a bucket is compared or connected
   already, and no row is ever made for a pair of a group: a family costs one row per pair of
   blocks.
4. Verification: pairs whose signatures rule out the threshold by five standard deviations go, the
   others are compared exactly on their whole texts.

Texts travel only to the verification, by the row that stands for a node.  The output is one row
per document: its class, named by the smallest id.

Defined cases: a text with fewer than five words is one shingle; null texts and texts without
words are classes of their own, never duplicates; texts with the same words are duplicates; null
ids may belong to a class but do not name it (a class of null ids only has a null name); repeated
rows come out once each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redline.llm.common import stored, worker_state
from redline.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
#: 24 bands of 5 registers: a pair at the threshold meets in a band with probability 0.99993.
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
#: Bytes of text that a task handles at a time, and words it remembers (memory bounds).
RUN_BYTES, CACHE_WORDS = 1 << 19, 500_000
#: Texts of a block of the verification, on average: a task holds two blocks at a time.
BLOCK = 64
#: Rounds in which the nodes of a bucket are compared with one leader, before blocks are compared.
STAR_ROUNDS = 2
_SIGNATURE = "doc_id string, h long, key binary, sig binary"

_M1, _M2, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


_POWERS = np.array([pow(0x9E3779B97F4A7C15, j + 1, 2 ** 64) for j in range(SHINGLE)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Weighted shingles of texts; remembers word hashes."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def shingles(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, 48-bit shingle hash, weight) of fewer than 65536 texts given as words,
        sorted by both."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known = self.known
        for w in set().union(*texts):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        n = np.array([len(t) for t in texts], np.int64)
        h = np.fromiter(map(known.__getitem__, itertools.chain.from_iterable(texts)), np.uint64, count=int(n.sum()))
        doc = np.repeat(np.arange(len(texts)), n)
        start = np.cumsum(n) - n
        x = h * _POWERS[0]
        for j in range(1, SHINGLE):
            x[:-j] += h[j:] * _POWERS[j]
        # Windows may not cross texts; a text with fewer words is one shingle.
        keep = np.repeat(start + n, n) - np.arange(len(h)) >= SHINGLE
        for k in range(1, SHINGLE):
            at = start[n == k]
            x[at] = np.uint64(k) + sum(h[at + j] * _POWERS[j] for j in range(k))
            keep[at] = True
        x = _mixed(x)
        # Text number and hash in one integer: one plain sort.
        both = np.sort((doc[keep].astype(np.uint64) << np.uint64(48)) | (x[keep] >> np.uint64(16)))
        first = np.ones(len(both), bool)
        first[1:] = both[1:] != both[:-1]
        at = np.nonzero(first)[0]
        both, w = both[at], np.diff(np.append(at, len(both))).astype(np.float64)
        return (both >> np.uint64(48)).astype(np.int64), both & np.uint64(2 ** 48 - 1), w

    def sets(self, texts: list[list[bytes]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(hashes, weights) of each text."""
        doc, x, w = self.shingles(texts)
        ends = np.searchsorted(doc, np.arange(len(texts) + 1))
        return [(x[i:j], w[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]


def _shingler() -> Shingler:
    """A task's own; what other operators kept in the worker goes."""
    worker_state("near_dedup", dict)
    return Shingler()


def signatures(doc: np.ndarray, x: np.ndarray, w: np.ndarray, n_docs: int, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash: per text and register the low 16 bits of the earliest shingle's hash."""
    sig = np.zeros((n_docs, registers), np.uint16)
    total = np.bincount(doc, weights=w, minlength=n_docs)
    todo = total > 0
    horizon = registers * (math.log(registers) + 3)   # in units of 1 / total weight
    while todo.any():
        own = todo[doc]
        d, e, rate = doc[own], x[own], w[own]
        limit = horizon / total[d]
        t = np.zeros(len(d))
        at, when, what = [], [], []
        k = 0
        while len(d):
            k += 1
            r = _mixed(e + np.array([k], np.uint64) * _G)
            t = t + -np.log((r >> np.uint64(11)).astype(np.float64) * 2.0 ** -53 + 2.0 ** -54) / rate
            alive = t <= limit
            d, e, rate, limit, t, r = d[alive], e[alive], rate[alive], limit[alive], t[alive], r[alive]
            at.append(d * registers + (_mixed(r + _M2) % np.uint64(registers)).astype(np.int64))
            when.append(t)
            what.append(e)
        at, when, what = np.concatenate(at), np.concatenate(when), np.concatenate(what)
        late_first = np.argsort(when)[::-1]   # of several points of a register the last write stays
        at, what = at[late_first], what[late_first]
        now, filled = np.zeros_like(sig), np.zeros(sig.shape, bool)
        now.reshape(-1)[at] = (what >> np.uint64(17)).astype(np.uint16)
        filled.reshape(-1)[at] = True
        done = filled.all(axis=1) & todo
        sig[done] = now[done]
        todo &= ~done
        horizon *= 2
    return sig


def probability_jaccard(xa: np.ndarray, wa: np.ndarray, xb: np.ndarray, wb: np.ndarray) -> float:
    """Exact similarity of two weighted sets (sorted hashes and weights).

    sum over common d of 1 / sum_e max(a_e / a_d, b_e / b_d); the inner sum comes from sorting the
    common shingles by b_e / a_e and two running sums."""
    _, ia, ib = np.intersect1d(xa, xb, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    a, b = wa[ia], wb[ib]
    only_a, only_b = wa.sum() - a.sum(), wb.sum() - b.sum()
    ratio = b / a
    order = np.argsort(ratio, kind="stable")
    a, b, ratio = a[order], b[order], ratio[order]
    # max(a_e / a_d, b_e / b_d) is b_e / b_d exactly where ratio_e > ratio_d.
    above = np.searchsorted(ratio, ratio, side="right")
    sum_a, sum_b = np.concatenate([[0.0], np.cumsum(a)]), np.concatenate([[0.0], np.cumsum(b)])
    inner = (sum_a[above] + only_a) / a + (sum_b[-1] - sum_b[above] + only_b) / b
    return float((1 / inner).sum())


def _runs(texts):
    """Positions [a, b) of consecutive texts of about RUN_BYTES together."""
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 64
        if size >= RUN_BYTES:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _sign(batches):
    """(doc_id, h, text) -> signature rows; key is the MD5 of the words, null without any."""
    shingler = _shingler()
    for pdf in batches:
        texts = [t or b"" for t in pdf["text"]]
        for a, b in _runs(texts):
            words = [t.split() for t in texts[a:b]]
            sig = signatures(*shingler.shingles(words), len(words))
            part = pdf.iloc[a:b]
            yield pd.DataFrame({
                "doc_id": part["doc_id"], "h": part["h"],
                "key": [hashlib.md5(b" ".join(w)).digest() if w else None for w in words],
                "sig": [sig[i].tobytes() if w else None for i, w in enumerate(words)]})


def sign(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, key, sig) per row; (doc_id, h) finds the row's text again."""
    text = F.col(text_col).cast("binary")
    # Ids travel as text: pandas would make doubles of a batch with a null id.
    rows = df.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    return rows.mapInPandas(_sign, _SIGNATURE).withColumn("doc_id", F.col("doc_id").cast("long"))


def buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, node) of the buckets with more than one node."""
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)),
                       lambda i: F.xxhash64(i, F.substring("sig", i * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    rows = stored(nodes.select("node", F.explode(band).alias("bucket")), "dedup-bands")
    shared = (rows.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("b"))
              .filter("a < b").select("bucket"))
    return rows.join(shared, "bucket").select("bucket", "node")


def _agreeing(batches, least: float):
    """Pairs whose signatures agree in at least ``least`` registers."""
    for pdf in batches:
        if not len(pdf):
            continue
        a = np.frombuffer(b"".join(pdf["sig_a"]), np.uint16).reshape(len(pdf), REGISTERS)
        b = np.frombuffer(b"".join(pdf["sig_b"]), np.uint16).reshape(len(pdf), REGISTERS)
        yield pdf.loc[(a == b).sum(axis=1) >= least, ["a", "b"]]


def _verify(batches, threshold: float):
    """Exact similarities; a row holds the texts of two blocks of nodes and the pairs to compare."""
    shingler = _shingler()

    def compared(rows):
        texts = [t for row in rows for t in row.texts]
        sets = shingler.sets([t["text"].split() for t in texts])
        at = 0
        for row in rows:
            own = {t["node"]: sets[at + i] for i, t in enumerate(row.texts)}
            at += len(row.texts)
            for p in row.pairs:
                if probability_jaccard(*own[p["a"]], *own[p["b"]]) >= threshold - 1e-9:
                    yield p["a"], p["b"]
    for pdf in batches:
        rows, size, out = [], 0, []
        for row in pdf.itertuples(index=False):   # some rows at a time: one call for all their texts
            rows.append(row)
            size += sum(len(t["text"]) + 64 for t in row.texts)
            if size >= RUN_BYTES:
                out += compared(rows)
                rows, size = [], 0
        out += compared(rows)
        yield pd.DataFrame(out, columns=["u", "v"], dtype="int64")


def _node_texts(df: DataFrame, nodes: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, text) of the wanted nodes, through the row that stands for each."""
    at = nodes.join(wanted, "node", "left_semi").select("node", "doc_id", "h").alias("n")
    text = F.col(text_col).cast("binary")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text")).alias("d")
    found = rows.join(at, F.col("d.h").eqNullSafe(F.col("n.h")) & F.col("d.id").eqNullSafe(F.col("n.doc_id")))
    return found.select("node", "text").dropDuplicates(["node"])


def verified_links(df: DataFrame, nodes: DataFrame, pairs: DataFrame, threshold: float, id_col: str,
                   text_col: str) -> DataFrame:
    """(u, v): the pairs (a, b) at or above the threshold."""
    slack = 5 * math.sqrt(threshold * (1 - threshold) / REGISTERS)
    sig = nodes.select("node", "sig")
    both = (pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b")
            .select("a", "b", "sig_a", "sig_b").mapInPandas(lambda p: _agreeing(p, REGISTERS * (threshold - slack)), "a long, b long"))
    near = stored(both, "dedup-near")
    ends = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = stored(_node_texts(df, nodes, ends, id_col, text_col), "dedup-texts")
    # Nodes are dealt to blocks; a text travels once per pair of blocks, not once per pair.
    blocks = F.lit(max(1, texts.count() // BLOCK))
    placed = near.select("a", "b", F.pmod(F.xxhash64("a"), blocks).alias("x"), F.pmod(F.xxhash64("b"), blocks).alias("y"))
    pairs = placed.groupBy("x", "y").agg(F.collect_list(F.struct("a", "b")).alias("pairs"))
    with_texts = (placed.select("x", "y", F.explode(F.array("a", "b")).alias("node")).distinct().join(texts, "node")
                  .groupBy("x", "y").agg(F.collect_list(F.struct("node", "text")).alias("texts")))
    units = pairs.join(with_texts, ["x", "y"]).select("pairs", "texts")
    return stored(units.mapInPandas(lambda p: _verify(p, threshold), "u long, v long"), "dedup-links")


def _open_buckets(active: DataFrame, classes: DataFrame) -> DataFrame:
    """(bucket, node, root) of the buckets whose nodes are of several classes."""
    named = active.join(classes, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    mixed = (named.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y"))
             .filter("x < y").select("bucket"))
    return stored(named.join(mixed, "bucket", "left_semi"), "dedup-active")


def link_classes(df: DataFrame, nodes: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """(node, root) of the nodes whose class has a smaller node."""
    spark = nodes.sparkSession
    active = shared = stored(buckets(nodes), "dedup-buckets")
    classes = spark.createDataFrame([], "node long, root long")
    tried = spark.createDataFrame([], "a long, b long")
    for _ in range(STAR_ROUNDS):
        named = _open_buckets(active, classes)
        if named.isEmpty():
            break
        lead = named.groupBy("bucket").agg(F.min("node").alias("ln"))
        lead = lead.join(named.toDF("bucket", "ln", "lr"), ["bucket", "ln"])
        pairs = (named.join(lead, "bucket").filter("root <> lr").select(F.col("ln").alias("a"), F.col("node").alias("b"))
                 .distinct().join(tried, ["a", "b"], "left_anti"))
        pairs = stored(pairs, "dedup-pairs")
        found = verified_links(df, nodes, pairs, threshold, id_col, text_col)
        classes = components(found.unionByName(classes.toDF("u", "v")))
        tried = tried.unionByName(pairs)
        used = lead.select("bucket", F.col("ln").alias("node"))
        active = named.select("bucket", "node").join(used, ["bucket", "node"], "left_anti")
    rest = _open_buckets(shared, classes)
    if rest.isEmpty():
        return classes
    found = block_links(df, nodes, rest, threshold, id_col, text_col)
    return components(found.unionByName(classes.toDF("u", "v")))


def _compare_blocks(batches, threshold: float, least: float):
    """Links between the classes of two blocks.  Pairs of one class, or of classes that a link
    found here joins, are not compared."""
    shingler = _shingler()
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            same = row.x == row.y
            p, q = list(row.p), list(row.p if same else row.q)
            a = np.frombuffer(b"".join(m["sig"] for m in p), np.uint16).reshape(len(p), REGISTERS)
            b = np.frombuffer(b"".join(m["sig"] for m in q), np.uint16).reshape(len(q), REGISTERS)
            sets = dict(zip([m["node"] for m in p + q], shingler.sets([m["text"].split() for m in p + q]), strict=True))
            own: dict = {}

            def find(r, own=own):
                while r in own:
                    r = own[r]
                return r
            for i, m in enumerate(p):
                agree = (b == a[i]).sum(axis=1)
                for j in np.nonzero(agree >= least)[0]:
                    o = q[j]
                    if same and j <= i or find(m["root"]) == find(o["root"]):
                        continue
                    if probability_jaccard(*sets[m["node"]], *sets[o["node"]]) >= threshold - 1e-9:
                        out.append((m["node"], o["node"]))
                        own[find(m["root"])] = find(o["root"])
        yield pd.DataFrame(out, columns=["u", "v"], dtype="int64")


def block_links(df: DataFrame, nodes: DataFrame, rest: DataFrame, threshold: float, id_col: str,
                text_col: str) -> DataFrame:
    """(u, v): links between the classes of what shares buckets in ``rest(bucket, node, root)``.

    Nodes that buckets connect form a group.  A group's nodes are dealt to blocks of about BLOCK,
    large classes to blocks of their own; blocks meet unless they are of one class.  No row is made
    for a pair of nodes."""
    star = rest.groupBy("bucket").agg(F.min("node").alias("v"))
    groups = components(rest.join(star, "bucket").select(F.col("node").alias("u"), "v").distinct())
    members = (rest.select("node", "root").distinct().join(groups.toDF("node", "g"), "node", "left")
               .withColumn("g", F.coalesce("g", "node")))
    members = stored(members, "dedup-groups")
    sizes = members.groupBy("g", "root").agg(F.count(F.lit(1)).alias("n"))
    small = sizes.filter(F.col("n") < BLOCK).groupBy("g").agg(F.sum("n").alias("s"))
    sizes = sizes.join(small, "g", "left")
    big = F.col("n") >= BLOCK
    pure = F.when(big, F.col("root"))
    parts = F.greatest(F.lit(1), F.floor(F.when(big, F.col("n")).otherwise(F.col("s")) / BLOCK)).cast("long")
    sub = F.pmod(F.when(big, F.xxhash64("node")).otherwise(F.xxhash64("root")), parts)
    placed = members.join(sizes, ["g", "root"]).select("g", "node", "root", pure.alias("pure"), sub.alias("sub"))
    placed = stored(placed.withColumn("block", F.xxhash64("g", "pure", "sub")), "dedup-placed")
    texts = stored(_node_texts(df, nodes, placed.select("node"), id_col, text_col), "dedup-texts")
    full = (placed.join(nodes.select("node", "sig"), "node").join(texts, "node").groupBy("block")
            .agg(F.collect_list(F.struct("node", "root", "sig", "text")).alias("m")))
    full = stored(full, "dedup-blocks")
    ids = placed.select("g", "block", "pure").distinct()
    units = (ids.toDF("g", "x", "px").join(ids.toDF("g", "y", "py"), "g")
             .filter((F.col("x") <= F.col("y")) & ~F.coalesce(F.col("px") == F.col("py"), F.lit(False))).select("x", "y"))
    units = stored(units, "dedup-units")
    # Spread by the number of comparisons, not by bytes: they are what takes the time.
    tasks = int(max(1, units.count() // 8))
    met = (units.join(full.toDF("x", "p"), "x").join(full.toDF("y", "q"), "y").select("x", "y", "p", "q")
           .repartition(tasks, "x", "y"))
    least = REGISTERS * (threshold - 5 * math.sqrt(threshold * (1 - threshold) / REGISTERS))
    return stored(met.mapInPandas(lambda t: _compare_blocks(t, threshold, least), "u long, v long"), "dedup-links")


def near_duplicate_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, h, class_id, first): one row per input row.

    ``class_id`` is the smallest id of the class; ``first`` marks the rows that stand for it (the
    smallest (id, h) of the class; repeats of that row are marked too)."""
    signed = stored(sign(df, id_col, text_col), "dedup-signed")
    texts = signed.filter(F.col("key").isNotNull()).dropDuplicates(["key"])
    nodes = stored(texts.withColumn("node", F.monotonically_increasing_id()), "dedup-nodes")
    classes = link_classes(df, nodes, threshold, id_col, text_col)
    named = (nodes.select("key", "node").join(classes, "node", "left")
             .select("key", F.coalesce("root", "node").alias("root")))
    rows = stored(signed.select("doc_id", "h", "key").join(named, "key", "left"), "dedup-rows")
    # Rows without words have no root: each is a class by itself.
    grouped = rows.filter(F.col("root").isNotNull())
    best = grouped.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    joined = grouped.join(best, "root")
    lead = (joined.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("root").agg(F.min("h").alias("lead_h")))
    out = (joined.join(lead, "root").select(
        "doc_id", "h", "class_id",
        (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("h") == F.col("lead_h"))).alias("first")))
    alone = rows.filter(F.col("root").isNull()).select("doc_id", "h", F.col("doc_id").alias("class_id"), F.lit(True).alias("first"))
    return out.unionByName(alone)


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         threshold: float = THRESHOLD) -> DataFrame:
    """The input with one document of each class, all columns."""
    c = stored(near_duplicate_classes(df, id_col, text_col, threshold).filter("first"), "dedup-kept")
    counted = c.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).toDF("keep_id", "keep_h", "keep_n")
    text = F.col("row").getField(text_col).cast("binary")
    rows = df.select(F.struct("*").alias("row"))
    kept = rows.join(counted, F.col("row").getField(id_col).cast("long").eqNullSafe(F.col("keep_id"))
                     & F.xxhash64(text).eqNullSafe(F.col("keep_h")))
    kept = stored(kept, "dedup-out")
    # Only rows that occur more than once are shuffled; texts without words stay, repeated or not.
    wordless = F.size(F.filter(F.split(F.coalesce(F.col("row").getField(text_col), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")) == 0
    once = kept.filter((F.col("keep_n") == 1) | wordless)
    many = kept.filter((F.col("keep_n") > 1) & ~wordless).dropDuplicates(["keep_id", "keep_h"])
    return once.unionByName(many).select("row.*")
