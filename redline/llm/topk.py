"""Exact top-k inner products with block-at-a-time pruning.

Vectors of integers, of the narrowest type that holds them, are stored in document-range blocks: the
rows are range-partitioned by their dominating signed term and id, and each block holds its ids, its
forward index (the vectors) and, per signed term, the largest weight of any of its vectors.  For a
query, a block's bound is the sum over the terms of the query's weight times the block's maximum; no
vector of the block scores higher.  The partitions are dealt to slabs, the queries to groups, and a
task meets one slab with one group: it holds the slab and takes the group's query blocks one by one.
Blocks are visited by falling bound and scored through the forward index, for the queries whose k-th
score their bound reaches.  A first pass over each query's best block per slab gives the score that
the second pass starts from.

The work is queries times blocks by definition, and no plan has a row per pair of them: documents
travel once per group, queries once per slab, always by a shuffle (a join that repeats queries would
look as small as the queries to Spark and be broadcast through the driver).  A task's memory is one slab and one
query block, a query keeps k scores per slab, and the driver gets a bounded sample of range keys.

Defined cases: vectors that are null, or hold null or non-finite components, take no part; shorter
vectors are padded with zeros; an empty vector scores 0; components beyond 32 bits take a wide
path, and a quantised component or score beyond +-2^62 is an error; repeated rows (same id and vector) count once; of several vectors of one query
id the smallest is the query; rows with the query's own id are never its candidates; ties go to
the smaller id; no queries or no candidates give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from redline.llm.common import stored

BLOCK = 256
#: Document blocks that lie in one row, and queries in one query block (memory of a task).
SET = 32
QUERIES = 512
#: Most bytes of a slab's vectors, most queries of a group, and most range partitions (the driver's sample of keys).
SLAB_BYTES = 32 << 20
GROUP = 1 << 18
MAX_PARTS = 2000
#: Blocks that are scored together at most.
WIDE = 8
LIMIT = 2 ** 62

_SET = "set long, part int, ids binary, vectors binary"
_HITS = "query_id long, vec_id long, score long"


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) per component in double arithmetic; beyond +-LIMIT an error."""
    def component(x):
        y = x.cast("double") * scale
        return F.when((y >= -float(LIMIT)) & (y < float(LIMIT)), F.floor(y)).otherwise(
            F.raise_error(F.concat(F.lit("vector component out of range: "), x.cast("string"))).cast("long"))
    return F.transform(vector, lambda x: F.when(x.isNotNull(), component(x)))


def usable(vector: Column) -> Column:
    """Not null and every component present and finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def _pack(batches, rows_per_pack: int, dim: int, kind):
    """Rows (id, v) of a partition in runs: (set, part, ids, vectors) with the bytes of int64 ids and vectors of the given kind."""
    from pyspark import TaskContext
    part, n = TaskContext.get().partitionId(), 0
    ids: list[np.ndarray] = []
    vecs: list[np.ndarray] = []

    def packs(full: bool):
        nonlocal n, ids, vecs
        if not ids:
            return
        a, m = np.concatenate(ids), np.concatenate(vecs)
        upto = len(a) // rows_per_pack * rows_per_pack if full else len(a)
        for i in range(0, upto, rows_per_pack):
            yield (part * 1_000_000 + n, part, a[i:i + rows_per_pack].tobytes(), m[i:i + rows_per_pack].tobytes())
            n += 1
        ids, vecs = [a[upto:]], [m[upto:]]
    for pdf in batches:
        if not len(pdf):
            continue
        m = np.zeros((len(pdf), dim), kind)
        for i, v in enumerate(pdf["v"]):
            m[i, :len(v)] = v
        ids.append(pdf["id"].to_numpy(np.int64))
        vecs.append(m)
        out = list(packs(True))
        if out:
            yield pd.DataFrame(out, columns=["set", "part", "ids", "vectors"])
    out = [p for p in packs(False) if p[2]]
    if out:
        yield pd.DataFrame(out, columns=["set", "part", "ids", "vectors"])


def block_bounds(queries: np.ndarray, vectors: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Queries x blocks: summed term maxima.  Each component makes two terms, x+ and x-."""
    hi = np.maximum.reduceat(vectors, starts, axis=0).astype(np.float64)
    lo = np.minimum.reduceat(vectors, starts, axis=0).astype(np.float64)
    return np.maximum(queries, 0) @ hi.T + np.minimum(queries, 0) @ lo.T


class _Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.copy()
        self.q, self.s, self.i = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, q: np.ndarray, s: np.ndarray, i: np.ndarray) -> None:
        q, s, i = np.concatenate([self.q, q]), np.concatenate([self.s, s]), np.concatenate([self.i, i])
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
        rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
        keep = rank < self.k
        self.q, self.s, self.i = q[keep], s[keep], i[keep]
        last = rank[keep] == self.k - 1
        self.floor[self.q[last]] = np.maximum(self.floor[self.q[last]], self.s[last])


class _Blocks:
    """Document blocks with their term maxima, from packs (ids, vectors)."""

    def __init__(self, packs: list, block: int):
        self.ids, self.vectors = np.concatenate([i for i, _ in packs]), np.concatenate([v for _, v in packs])
        at = np.cumsum([0, *(len(i) for i, _ in packs)])
        self.starts = np.concatenate([np.arange(a, b, block) for a, b in zip(at[:-1], at[1:], strict=True)])
        self.ends = np.append(self.starts[1:], len(self.ids))
        self.hi, self.lo = (f.reduceat(self.vectors, self.starts, axis=0) for f in (np.maximum, np.minimum))
        self.largest = max(int(self.hi.max(initial=0)), -int(self.lo.min(initial=0)))

    def of(self, blocks, kind) -> tuple[np.ndarray, np.ndarray]:
        """The ids and vectors of some blocks."""
        at = [slice(self.starts[b], self.ends[b]) for b in blocks]
        return np.concatenate([self.ids[x] for x in at]), np.concatenate([self.vectors[x] for x in at]).astype(kind)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries in a type whose sums are exact with these blocks, and their bounds (see ``block_bounds``)."""
        most = max(int(queries.max(initial=0)), -int(queries.min(initial=0))) * self.largest * max(1, queries.shape[1])
        # Beyond longs sums are of Python integers.
        kind = np.float32 if most < 2 ** 24 else np.float64 if most < 2 ** 53 else np.int64 if most < LIMIT else object
        q = queries.astype(kind)
        return q, np.maximum(q, 0) @ self.hi.T.astype(kind) + np.minimum(q, 0) @ self.lo.T.astype(kind)


def _fits(scores: np.ndarray, others: np.ndarray) -> None:
    if scores.dtype == object and (others & (np.abs(scores) >= LIMIT)).any():
        raise ValueError("a score does not fit a long")


def seed_scores(docs: _Blocks, qids: np.ndarray, queries: np.ndarray, m: int) -> np.ndarray:
    """Queries x m: the m best scores in each query's best block, -LIMIT where there are fewer."""
    q, bounds = docs.bounds(queries)
    at, out = bounds.argmax(axis=1), np.full((len(qids), m), -LIMIT, np.int64)
    for b in np.unique(at):
        own = np.flatnonzero(at == b)
        ids, v = docs.of([b], q.dtype)
        s, others = q[own] @ v.T, ids[None, :] != qids[own][:, None]
        _fits(s, others)
        s = np.where(others, s, -LIMIT)
        some = min(m, s.shape[1])
        s = np.sort(s, axis=1) if s.dtype == object else np.partition(s, s.shape[1] - some, axis=1)
        out[own, :some] = s[:, -some:].astype(np.int64)
    return out


def search(docs: _Blocks, qids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> _Best:
    """The k best of each query that reach its floor: blocks by falling bound, each for the queries whose k-th score it may reach."""
    q, bounds = docs.bounds(queries)
    order, best = np.argsort(-bounds.max(axis=0), kind="stable"), _Best(len(qids), k, floor.astype(np.int64))
    found, waiting, done, width = [], 0, 0, 1

    def merged() -> None:
        nonlocal found, waiting
        if waiting:
            best.add(*(np.concatenate([f[c] for f in found]) for c in range(3)))
        found, waiting = [], 0
    while done < len(order):
        step = order[done:done + width]
        done, width = done + width, min(2 * width, WIDE)
        want = bounds[:, step] >= best.floor[:, None]
        any_own = np.flatnonzero(want.any(axis=1))
        # Together where most are wanted, else block by block.
        together = 2 * np.count_nonzero(want) >= len(any_own) * len(step)
        for own, blocks in [(any_own, step)] if together else [(np.flatnonzero(w), [b]) for w, b in zip(want.T, step, strict=True)]:
            if not len(own):
                continue
            ids, v = docs.of(blocks, q.dtype)
            s = (q if len(own) == len(q) else q[own]) @ v.T
            if s.dtype == object:
                _fits(s, ids[None, :] != qids[own][:, None])
            i, j = np.divmod(np.flatnonzero((s >= best.floor[own].astype(q.dtype)[:, None]).ravel()), len(ids))
            other = ids[j] != qids[own[i]]
            i, j = i[other], j[other]
            found.append((own[i], s[i, j].astype(np.int64), ids[j]))
            waiting += len(i)
            if waiting >= 8 * len(qids):
                merged()
    merged()
    return best


def search_blocks(qids: np.ndarray, queries: np.ndarray, floor: np.ndarray, ids: np.ndarray, vectors: np.ndarray,
                  k: int, block: int = BLOCK) -> _Best:
    """``search`` over blocks of these vectors."""
    return search(_Blocks([(ids, vectors)], block), qids, queries, floor, k)


def _cells(batches, dim: int, kind, block: int):
    """(blocks, set, qids, queries, floor) for each query block: rows come by cell, a cell's documents first."""
    cell, packs, docs = None, [], None
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            if row.cell != cell:
                cell, packs, docs = row.cell, [], None
            ids = np.frombuffer(row.ids, np.int64)
            vectors = np.frombuffer(row.vectors, kind).reshape(len(ids), dim)
            if not row.query:
                packs.append((ids, vectors))
                continue
            if packs:
                docs, packs = _Blocks(packs, block), []
            if docs is not None:
                floor = np.full(len(ids), -LIMIT, np.int64) if row.floor is None else np.frombuffer(row.floor, np.int64)
                yield docs, row.set, ids, vectors, floor


def _seeds(batches, m: int, dim: int, kind, block: int):
    for docs, at, qids, queries, _ in _cells(batches, dim, kind, block):
        yield pd.DataFrame({"set": [at], "best": [seed_scores(docs, qids, queries, m).tobytes()]})


def _floors(batches, m: int, k: int):
    """The k-th of the seeds of each query, -LIMIT where there are fewer."""
    for pdf in batches:
        out = []
        for seeds in pdf["seeds"]:
            s = np.concatenate([np.frombuffer(b, np.int64).reshape(-1, m) for b in seeds], axis=1)
            out.append((np.partition(s, -k, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(s), -LIMIT, np.int64)).tobytes())
        yield pd.DataFrame({"set": pdf["set"], "floor": out})


def _search(batches, k: int, dim: int, kind, block: int):
    for docs, _, qids, queries, floor in _cells(batches, dim, kind, block):
        best = search(docs, qids, queries, floor, k)
        yield pd.DataFrame({"query_id": qids[best.q], "vec_id": best.i, "score": best.s})


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` marks its k best others."""
    rows = (vectors.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
            .select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"),
                    F.coalesce(is_query, F.lit(False)).alias("q")).dropDuplicates(["id", "v", "q"]))
    rows = stored(rows, "topk-vectors")
    n, asked, dim, largest = rows.agg(F.count(F.lit(1)), F.count_if("q"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if (largest or 0) <= np.iinfo(t).max)
    dim, block = max(1, dim or 0), BLOCK
    per_set = BLOCK * SET
    parts = max(1, min(MAX_PARTS, -(-n // per_set)))
    # Near vectors share a range: the position of the largest component, with its sign.
    size = F.transform("v", lambda x: F.abs(x))
    top = F.array_position(size, F.array_max(size))
    key = F.coalesce(top * F.signum(F.get("v", (top - 1).cast("int"))), F.lit(0.0))
    docs = (rows.select("id", "v", key.alias("key")).repartitionByRange(int(parts), "key", "id")
            .sortWithinPartitions("key", "id").select("id", "v")
            .mapInPandas(lambda b: _pack(b, per_set, dim, kind), _SET))
    docs = stored(docs, "topk-blocks")
    queries = (rows.filter("q").groupBy("id").agg(F.min("v").alias("v"))
               .repartition(int(max(1, parts // 8)), "id")
               .mapInPandas(lambda b: _pack(b, QUERIES, dim, kind), _SET))
    queries = stored(queries, "topk-queries")
    # Slabs that fit a task, and enough of them for all cores.
    slabs = int(min(parts, max(-(-n * dim * np.dtype(kind).itemsize // SLAB_BYTES), 4 * vectors.sparkSession.sparkContext.defaultParallelism)))
    groups = int(max(1, -(-asked // GROUP)))

    def dealt(df: DataFrame, own: Column, others: Column, query: bool, floor: Column) -> DataFrame:
        return df.select("*", own.alias("own"), F.explode(others).alias("other")).select(
            ((F.col("other") * groups + F.col("own")) if query else (F.col("own") * groups + F.col("other"))).alias("cell"),
            F.lit(query).alias("query"), "set", "ids", "vectors", floor.alias("floor"))

    def meet(q: DataFrame, floor: Column) -> DataFrame:
        """A partition per slab and group: the slab's documents, then the group's queries."""
        none = F.lit(None).cast("binary")
        both = dealt(docs, F.col("part") % slabs, F.sequence(F.lit(0), F.lit(groups - 1)), False, none).unionByName(
            dealt(q, F.col("part") % groups, F.sequence(F.lit(0), F.lit(slabs - 1)), True, floor))
        return both.repartitionById(slabs * groups, F.col("cell")).sortWithinPartitions("cell", "query", "set")
    # The best k are spread over the slabs, so few seeds of each hold nearly all of them.
    m = min(k, -(-4 * k // slabs))
    seeds = meet(queries, F.lit(None).cast("binary")).mapInPandas(lambda b: _seeds(b, m, dim, kind, block), "set long, best binary")
    floors = stored(seeds.groupBy("set").agg(F.collect_list("best").alias("seeds"))
                    .mapInPandas(lambda b: _floors(b, m, k), "set long, floor binary"), "topk-floors")
    hits = (meet(queries.join(floors.hint("merge"), "set", "left"), F.col("floor"))
            .mapInPandas(lambda b: _search(b, k, dim, kind, block), _HITS))
    return _ranked(hits, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
