"""Packing documents into sequences: large-item matching, then best fit.

1. Tokens: every whole text is encoded in tasks (a document's ids, then the end id), and documents
   beyond the capacity, only those, are cut into capacity-long pieces.
2. Plan: only the number of pieces per length counts, at most ``capacity`` numbers whatever the
   data's size.  Pieces above a third of the capacity go at most two to a sequence: from the
   longest down, each is matched with the longest other one that fits.  Smaller pieces, from the
   longest down, go to the sequences with the smallest gap that holds them; new sequences open
   when no gap does.  Equal lengths are placed together, so the plan has one row per run of equal
   placements (length, first rank, first sequence, offset, pieces per sequence).
3. Placement: pieces of one length are ranked by bucketed row numbers (a bucket is a hash of the
   piece, its size is bounded, and its first rank comes from the bucket counts), and a rank is
   looked up in the plan.

Defined cases: a null or empty text is its end id alone; very long texts are encoded whole; texts
of the same length are ranked by a hash of row and place, id and piece, equal rows in any order;
an empty table gives no rows; columns other than those named are ignored.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from redline.llm.common import begin, runs, stored, worker_state

# Spark runs one task per core; a tokenizer's own threads would only compete with other tasks.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

CAPACITY = 2048
END_ID = 0
#: Pieces of one length and bucket that one task ranks, on average.
BUCKET_ROWS = 50_000
#: A worker remembers chunks in about so many bytes (a parameter: more of them spare encoding, fewer leave
#: memory to others); an entry costs Python so much beside its text and ids.
CACHE_BYTES, ENTRY_BYTES = 384 << 20, 190
_MARK = "\x01"


class ChunkEncoder:
    """Ids of texts whose tokenizer cuts at white space, and lower-cases and cuts into runs of
    letters, single digits and runs of other characters before it merges.

    A text is cut at ASCII white space; each distinct chunk is looked up.  A new chunk of plain
    Latin characters is put together from its runs, and only new runs are encoded (many in one
    call, with a mark between them); any other new chunk is encoded whole."""

    _RUNS = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
    _LAST_LATIN = "\u024f"

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        mark = self._encode(_MARK)
        assert len(mark) == 1
        self.mark = mark[0]
        self.cache_bytes = cache_bytes
        # The same merges for runs that are cut and lower-cased already.
        self.merger = Tokenizer.from_file(path)
        self.merger.normalizer = normalizers.Sequence([])
        self.merger.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._clear()

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _clear(self) -> None:
        """Entries are slices of ``ids``; chunks map to entry numbers."""
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.starts = self.lens = np.zeros(0, np.int64)
        self.hits, self.key_bytes = np.zeros(0, np.int64), 0

    def _bytes(self) -> int:
        return ENTRY_BYTES * len(self.known) + self.key_bytes + 4 * self.used

    def _trim(self) -> None:
        """Back to half the bytes: the chunks met most often stay."""
        hits = np.zeros(len(self.starts), np.int64)
        hits[:len(self.hits)] = self.hits
        keys = list(self.known)
        at = np.fromiter(self.known.values(), np.int64, count=len(keys))
        cost = ENTRY_BYTES + np.fromiter(map(len, keys), np.int64, count=len(keys)) + 4 * self.lens[at]
        order = np.argsort(-hits[at], kind="stable")
        order = order[:int(np.searchsorted(np.cumsum(cost[order]), self.cache_bytes // 2, side="right"))]
        ids, ends = self._gather(at[order])
        kept, hits, lens = [keys[i] for i in order], hits[at[order]] // 2, self.lens[at[order]]
        self._clear()
        self.known = dict(zip(kept, self._append(ids, ends - lens, lens), strict=True))
        self.key_bytes, self.hits = sum(map(len, kept)), hits

    def _append(self, ids: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> range:
        """Entry numbers of slices of ``ids``."""
        n = self.used + len(ids)
        if n > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(n - len(self.ids), len(self.ids)), np.uint32)])
        self.ids[self.used:n] = ids
        first = len(self.starts)
        self.starts = np.concatenate([self.starts, starts + self.used])
        self.lens = np.concatenate([self.lens, lens])
        self.used = n
        return range(first, first + len(starts))

    def _gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of entries, one after another, and where each ends."""
        start, n = self.starts[which], self.lens[which]
        ends = np.cumsum(n)
        return self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - n), n)], ends

    def _enter(self, texts: list[str], tokenizer) -> list[int]:
        """Entry numbers of texts without the mark, encoded together."""
        ids, starts, lens, used = [], [], [], 0
        joined = [f" {_MARK} ".join(texts[i:i + 100]) for i in range(0, len(texts), 100)]
        for encoding in tokenizer.encode_batch_fast(joined, add_special_tokens=False):
            part = np.asarray(encoding.ids, np.uint32)
            ends = np.append(np.nonzero(part == self.mark)[0], len(part))
            begin = np.append(0, ends[:-1] + 1)
            ids.append(part)
            starts.append(begin + used)
            lens.append(ends - begin)
            used += len(part)
        if not ids:
            return []
        return list(self._append(np.concatenate(ids), np.concatenate(starts), np.concatenate(lens)))

    def _learn(self, chunks: set[bytes]) -> None:
        """New chunks: most are a run of ASCII letters, with a full stop or comma at most; the
        others are cut by the pattern, or encoded whole.  Runs are chunks themselves."""
        whole, several = [], []
        runs = {c for c in chunks if c.isalpha()}   # of bytes: ASCII letters only
        for c in chunks - runs:
            if c[-1] in b".," and c[:-1].isalpha():
                several.append((c, (c[:-1], c[-1:])))
                continue
            s = c.decode()
            if "'" in s or not s.isprintable() or not (s.isascii() or max(s) <= self._LAST_LATIN):
                whole.append((c, s))
            else:
                several.append((c, [r.encode() for r in self._RUNS.findall(s.lower())]))
        known = self.known
        new = [r for r in runs.union(*(rs for _, rs in several)) if r not in known]
        self.key_bytes += sum(map(len, chunks)) + sum(map(len, new))
        known.update(zip(new, self._enter([r.decode() for r in new], self.merger), strict=True))
        several = [(c, rs) for c, rs in several if c not in known]   # runs of one chunk are known by now
        if several:
            flat, ends = self._gather(np.fromiter((known[r] for _, rs in several for r in rs), np.int64))
            ends = ends[np.cumsum([len(rs) for _, rs in several]) - 1]
            starts = np.append(0, ends[:-1])
            known.update(zip((c for c, _ in several), self._append(flat, starts, ends - starts), strict=True))
        plain = [(c, s) for c, s in whole if _MARK not in s]
        known.update(zip((c for c, _ in plain), self._enter([s for _, s in plain], self.tokenizer), strict=True))
        for c, s in whole:
            if _MARK in s:
                ids = np.asarray(self._encode(s), np.uint32)
                known[c] = self._append(ids, np.zeros(1, np.int64), np.array([len(ids)]))[0]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        split = [t.lower().split() for t in texts]   # of bytes: ASCII letters only
        if self._bytes() > self.cache_bytes:
            self._trim()
        chunks = list(itertools.chain.from_iterable(split))
        which = np.fromiter(map(self.known.get, chunks, itertools.repeat(-1)), np.int64, count=len(chunks))
        missing = np.nonzero(which < 0)[0]
        if len(missing):
            new = [chunks[i] for i in missing]
            self._learn(set(new))
            which[missing] = np.fromiter(map(self.known.__getitem__, new), np.int64, count=len(new))
        hits = np.bincount(which, minlength=len(self.starts))
        hits[:len(self.hits)] += self.hits
        self.hits = hits
        flat, ends = self._gather(which)
        at = np.concatenate([[0], ends])[np.cumsum([0] + [len(s) for s in split])]
        return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False,
           cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): one row per piece of every document."""
    begin(df.sparkSession)
    fields = [StructField("id", df.schema[id_col].dataType), StructField("piece", IntegerType()), StructField("start", LongType()),
              StructField("length", LongType()), StructField("ids_crc32", LongType())]
    schema = StructType(fields + [StructField("ids", ArrayType(IntegerType()))] * with_ids)

    def cut(batches):
        encoder = worker_state(("encoder", tokenizer, cache_bytes), lambda: ChunkEncoder(tokenizer, cache_bytes))
        end = np.array([end_id], np.uint32)
        for batch in batches:
            texts = batch.column(1)
            for a, b in runs(texts):
                at, no, start, length, crc, out = [], [], [], [], [], []
                for i, ids in enumerate(encoder.encode([t or b"" for t in texts.slice(a, b - a).to_pylist()])):
                    ids = np.concatenate([ids, end]).astype("<u4")
                    for p, s in enumerate(range(0, len(ids), capacity)):
                        part = ids[s:s + capacity]
                        at.append(a + i)
                        no.append(p)
                        start.append(s)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            out.append(part.astype(np.int32))
                columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(no, pa.int32()), pa.array(start, pa.int64()),
                           pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(np.cumsum([0, *length]).astype(np.int32), np.concatenate(out)))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
    # Ids stay in Arrow, whatever their type, nulls among them.
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary")).mapInArrow(cut, schema)


def pack_counts(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Plan for ``counts[length]`` pieces: rows (length, first rank, pieces, first sequence, offset,
    pieces per sequence); the i-th piece of a row goes to sequence first + i // per."""
    left = {n: c for n, c in counts.items() if c > 0}
    ranked: dict[int, int] = defaultdict(int)
    plan: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)   # gap -> runs (first sequence, sequences)
    sequences = 0

    def place(n: int, k: int, first: int, offset: int, per: int = 1) -> None:
        plan.append((n, ranked[n], k, first, offset, per))
        ranked[n] += k
        left[n] -= k

    # Large pieces: the longest with the longest that fits beside it, at most two to a sequence.
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            mate = next((m for m in large if left[m] and m + n <= capacity and (m < n or m == n and left[n] > 1)), None)
            if mate is None:
                k = left[n]
                place(n, k, sequences, 0)
                gap = capacity - n
            elif mate == n:
                k = left[n] // 2
                place(n, 2 * k, sequences, 0, 2)
                gap = capacity - 2 * n
            else:
                k = min(left[n], left[mate])
                place(n, k, sequences, 0)
                place(mate, k, sequences, n)
                gap = capacity - n - mate
            if gap:
                gaps[gap].append((sequences, k))
            sequences += k
    # Small pieces: best fit, decreasing; k alike in one run of sequences with the same gap.
    for n in sorted((n for n in left if left[n] and 3 * n <= capacity), reverse=True):
        for gap in range(n, capacity + 1):
            while left[n] and gaps.get(gap):
                first, bins = gaps[gap].pop()
                per = gap // n
                full = min(bins, left[n] // per)
                if full:
                    place(n, full * per, first, capacity - gap, per)
                    if gap - per * n:
                        gaps[gap - per * n].append((first, full))
                if full < bins and left[n]:
                    k = left[n]   # fewer than per: they share the next sequence
                    place(n, k, first + full, capacity - gap, k)
                    if gap - k * n:
                        gaps[gap - k * n].append((first + full, 1))
                    full += 1
                if full < bins:
                    gaps[gap].append((first + full, bins - full))
            if not left[n]:
                break
        if left[n]:
            per = capacity // n
            full, k = divmod(left[n], per)
            if full:
                place(n, full * per, sequences, 0, per)
                if capacity - per * n:
                    gaps[capacity - per * n].append((sequences, full))
                sequences += full
            if k:
                place(n, k, sequences, 0, k)
                if capacity - k * n:
                    gaps[capacity - k * n].append((sequences, 1))
                sequences += 1
    return plan


def _ranks(rows: DataFrame, total: int) -> DataFrame:
    """Adds ``rank``: 0, 1, ... within each length, by bucketed row numbers."""
    buckets = max(1, -(-total // BUCKET_ROWS))
    # Equal rows too are dealt over all buckets, by their place in the stored pieces.
    spread = F.xxhash64("id", "piece", "ids_crc32", F.monotonically_increasing_id())
    rows = stored(rows.withColumn("bucket", F.pmod(spread, F.lit(buckets))), "pack-pieces")
    w = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = (rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
             .select("length", "bucket", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("first")))
    inside = Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")
    return (rows.withColumn("rn", F.row_number().over(inside)).join(first, ["length", "bucket"])
            .withColumn("rank", F.col("first") + F.col("rn") - 1).drop("bucket", "first", "rn"))


def pack(df: DataFrame, capacity: int = CAPACITY, id_col: str = "id") -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with a ``length`` of at most ``capacity``."""
    rows = stored(df, "pack-input").withColumnRenamed(id_col, "id")
    # At most ``capacity`` counts, however many pieces there are.
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    plan = sorted(pack_counts(counts, capacity))
    table = np.array(plan, np.int64).reshape(-1, 6)
    schema = StructType(rows.schema.fields + [StructField("sequence_id", LongType()), StructField("offset", LongType())])

    names = rows.columns

    def lookup(batches):
        # Runs are sorted by (length, first rank): one key finds the run of a piece.
        key = table[:, 0] * (1 << 40) + table[:, 1]
        for batch in batches:
            n, rank = (np.asarray(batch.column(c), np.int64) for c in ("length", "rank"))
            run = table[np.searchsorted(key, n * (1 << 40) + rank, side="right") - 1]
            i, per = rank - run[:, 1], run[:, 5]
            own = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(run[:, 3] + i // per), pa.array(run[:, 4] + i % per * n)], names=schema.names)
    ranked = _ranks(rows, sum(counts.values())).select(*rows.columns, "rank")
    return ranked.mapInArrow(lookup, schema).withColumnRenamed("id", id_col)


def pack_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False,
                   cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """One row per piece of every document with its place; ``with_ids`` adds the piece's ids."""
    p = pieces(df, tokenizer, id_col, text_col, capacity, end_id, with_ids, cache_bytes)
    return pack(p, capacity).withColumnRenamed("id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed token sequences, from pieces that carry their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
