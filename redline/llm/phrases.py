"""Phrase collocation mining by Rabin-Karp fingerprints.

1. Units: the lower-cased texts of a language, words parted by one blank and pieces by a line feed, dealt
   into blobs of about ``UNIT_BYTES``, whatever the length of a text or the share of a language.
2. Levels 1 to ``MAX_WORDS``: prefix polynomials over a unit's bytes give the fingerprint of every n-gram
   (64 bits, the language mixed in) from two places.  A task reduces each window of a unit to one count per
   fingerprint, the shuffle sums them, and those of ``min_count`` or more leave their mark in a bitmap.  An
   n-gram is only counted where both its (n-1)-grams are marked one level below.  A bitmap has a fixed
   greatest size; false marks only cost time, and where it is full it spares less.
3. Occurrences: one more pass takes the n-grams that all bitmaps let through, few of the whole, and the
   shuffle aggregates them exactly: count, one occurrence pointer (unit and byte), least and greatest check
   (a second polynomial, modulo a prime of 31 bits).
4. Collisions: fingerprints whose checks differ stand for several texts; all their occurrences are counted
   again by the text itself.
5. Only the phrases that remain are materialised, each from the unit that its pointer names.
6. Scores and nesting are joins of phrase tables by (language, text); arithmetic is decimal.

Defined cases: null texts have no words; a null language is ``und``; repeated rows count each time; texts of
any length count whole, n-grams across the seams of a unit included; ties are broken by the stated order; an
empty table gives no rows; columns other than the two named are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from redline.llm.common import begin, stored

MIN_COUNT = 30
MAX_WORDS = 4
TOP = 2000
#: A phrase goes if a longer one that holds it has so many percent of its count.
NESTED_PERCENT = 80
SCALE = 2_000_000
UNIT_BYTES = 64 << 10
#: A task holds so many bytes of units before it writes them, and works on windows of so many.
HELD_BYTES, WINDOW_BYTES = 4 << 20, 1 << 20
#: Row groups of the units: a reader holds one at a time.
ROW_GROUP_BYTES = 16 << 20
#: Bits of a bitmap per fingerprint, and at most (16 MB).
BITS_EACH, MAX_BITS = 16, 1 << 27
#: Rows of a phrase part are dealt over so many salts.
SALTS = 8
#: Bits of a fingerprint (tests keep few, so that they collide).
FINGERPRINT_BITS = 64

_BASE, _PRIME, _PRIME_BASE = 0x9E3779B97F4A7C15, (1 << 31) - 1, 1_220_703_125
_BASES = {"wrap": (_BASE, pow(_BASE, -1, 1 << 64)), "modulo": (_PRIME_BASE, pow(_PRIME_BASE, -1, _PRIME))}
#: A pointer is (unit << _OFFSET_BITS) + byte; units beyond that size have several numbers.
_OFFSET_BITS, _UNIT_NO_BITS = 24, 20
_DELIMITERS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")


# --- units ------------------------------------------------------------------------------------

def canonical(text: bytes) -> bytes:
    """Words parted by one blank, each piece that has words ended by a line feed."""
    pieces = (p.split(b" ") for p in text.lower().translate(_DELIMITERS).split(b"\n"))
    lines = (b" ".join(filter(None, p)) for p in pieces)
    return b"".join(x + b"\n" for x in lines if x)


def _blobs(text: bytes):
    """The text cut between pieces."""
    a = 0
    while a < len(text):
        b = text.find(b"\n", min(a + UNIT_BYTES, len(text)) - 1) + 1
        yield text[a:b]
        a = b


def _units(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, unit, n_words, text)."""
    schema = StructType([StructField("lang", StringType()), StructField("unit", LongType()),
                         StructField("n_words", LongType()), StructField("text", BinaryType())])

    def deal(batches):
        no = TaskContext.get().partitionId() << _UNIT_NO_BITS
        last = no + (1 << _UNIT_NO_BITS)
        size = 0
        held: dict[str, list[bytes]] = {}

        def flush():
            nonlocal no, size
            langs, numbers, blobs = [], [], []
            for lang, texts in held.items():
                for blob in _blobs(b"".join(texts)):
                    langs.append(lang)
                    numbers.append(no)
                    blobs.append(blob)
                    no += (len(blob) >> _OFFSET_BITS) + 1
            if no > last:
                raise ValueError("a partition holds too many units: repartition the documents")
            held.clear()
            size = 0
            counts = [x.count(b" ") + x.count(b"\n") for x in blobs]
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(numbers, pa.int64()),
                                               pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())], names=schema.names)
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                held.setdefault(lang.as_py(), []).append(x := canonical(text.as_py()))
                size += len(x)
                if size >= HELD_BYTES:
                    yield flush()
        if held:
            yield flush()
    rows = df.select(F.coalesce(F.col(lang_col), F.lit("und")), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")))
    return rows.mapInArrow(deal, schema)


# --- fingerprints -----------------------------------------------------------------------------

_TABLES: dict[str, tuple] = {}


def _table(name: str, size: int, make) -> tuple:
    """Tables of powers of at least ``size`` entries; a worker keeps the longest ones it needed."""
    if name not in _TABLES or len(_TABLES[name][0]) < size:
        size = -(-size >> 18) << 18
        _TABLES[name] = tuple(make(base, size) for base in _BASES[name])
    return _TABLES[name]


def _powers(size: int) -> tuple:
    """Powers of the base and of its inverse, modulo 2^64."""
    def wrap(base, n):
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, out=out)
    return _table("wrap", size, wrap)


def _residues(size: int) -> tuple:
    """Powers of the other base and of its inverse, modulo the prime."""
    def modulo(base, n):
        out = np.ones(n, np.uint32)
        done = 1
        while done < n:
            k = min(done, n - done, 1 << 16)
            out[done:done + k] = out[:k].astype(np.int64) * pow(base, done, _PRIME) % _PRIME
            done += k
        return out
    return _table("modulo", size, modulo)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads a polynomial's value over all bits (the low ones depend on low ones only)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Grams:
    """The n-grams of a window of a unit: ``own`` words and up to MAX_WORDS after them."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray, piece: np.ndarray, own: int,
                 lang: str, bits: int):
        self.own, self.piece, self.drop = own, piece, np.uint64(64 - bits)
        self.seed = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))
        self.base = int(starts[0])
        self.part = text[self.base:int(ends[-1])]
        power, self.inverse = _powers(len(self.part))
        self.poly = np.zeros(len(self.part) + 1, np.uint64)
        np.cumsum((self.part + np.uint64(1)) * power[:len(self.part)], out=self.poly[1:])
        self.starts, self.ends = starts - self.base, ends - self.base

    def at(self, n: int, more: int = 0):
        """(index of the first word, fingerprint) of the n-grams that lie in one piece; ``more`` takes
        in those that begin so many words after the window's own."""
        i = np.arange(max(0, min(self.own + more, len(self.starts) - n + 1)))
        i = i[self.piece[i] == self.piece[i + n - 1]]
        s = self.starts[i]
        return i, _mixed((self.poly[self.ends[i + n - 1]] - self.poly[s]) * self.inverse[s] + self.seed) >> self.drop

    def over(self, n: int, marks: np.ndarray | None):
        """As ``at``, of the n-grams whose (n-1)-grams are both in the bitmap ``marks``."""
        i, fp = self.at(n)
        if marks is None:
            return i, fp
        j, part = self.at(n - 1, more=1)
        fine = np.zeros(len(self.starts) + 1, bool)
        fine[j[_marked(marks, part)]] = True
        keep = fine[i] & fine[i + 1]
        return i[keep], fp[keep]

    @functools.cached_property
    def check(self) -> np.ndarray:
        powers = _residues(len(self.part))[0][:len(self.part)]
        return np.append(0, np.cumsum((self.part + np.int64(1)) * powers % _PRIME))

    def checks(self, i: np.ndarray, n: int) -> np.ndarray:
        s = self.starts[i]
        value = (self.check[self.ends[i + n - 1]] - self.check[s]) % _PRIME * _residues(len(self.part))[1][s]
        return (value + int(self.seed % np.uint64(_PRIME))) % _PRIME


def _windows(blob: bytes, lang: str, bits: int = FINGERPRINT_BITS):
    """Grams of a text, window by window: memory is bounded, whatever the text's size."""
    text = np.frombuffer(blob, np.uint8)
    ends = np.flatnonzero((text == 32) | (text == 10))
    starts = np.append(0, ends[:-1] + 1)
    piece = np.cumsum(text[ends] == 10)
    piece = np.append(0, piece[:-1])
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + WINDOW_BYTES)))
        c = min(len(ends), b + MAX_WORDS)
        yield Grams(text, starts[a:c], ends[a:c], piece[a:c], b - a, lang, bits)
        a = b


def _joined(batch):
    """(lang, the batch's units of that language one after another, their numbers, where each starts).

    Each unit ends with a line feed, so no n-gram reaches from one into the next."""
    langs = batch.column(0).to_pylist()
    for lang in dict.fromkeys(langs):
        which = [i for i, x in enumerate(langs) if x == lang]
        blobs = [batch.column(2)[i].as_py() for i in which]
        starts = np.cumsum([0, *map(len, blobs)])[:-1]
        yield lang, b"".join(blobs), np.array([batch.column(1)[i].as_py() for i in which], np.int64), starts


def _marked(bitmap: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """May the fingerprints be among those the bitmap was made of?"""
    low = np.uint64(len(bitmap) * 8 - 1)
    out = np.ones(len(fp), bool)
    for p in (fp & low, (fp >> np.uint64(32)) & low):
        out &= (bitmap[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def _bitmap(fingerprints: DataFrame):
    """A broadcast bitmap with two bits per fingerprint; its size follows their number up to MAX_BITS."""
    n = fingerprints.count()
    bits = min(MAX_BITS, max(1 << 10, 1 << (BITS_EACH * n - 1).bit_length()))
    place = F.explode(F.array(F.col("fp"), F.shiftrightunsigned("fp", 32)))
    rows = (fingerprints.select(place.alias("p")).select(F.col("p").bitwiseAND(F.lit(bits - 1)).alias("p"))
            .groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("v")))
    got = rows.toArrow()      # at most MAX_BITS / 64 rows of 16 bytes
    words = np.zeros(bits // 64, "<u8")
    words[got["w"].to_numpy()] = got["v"].to_numpy().view(np.uint64)
    return fingerprints.sparkSession.sparkContext.broadcast(words.tobytes())


def _count_level(units: DataFrame, n: int, below, bits: int = FINGERPRINT_BITS) -> DataFrame:
    """(fp, cnt): counts of the n-grams whose parts are marked in ``below``."""
    schema = StructType([StructField("fp", LongType()), StructField("cnt", LongType())])

    def count(batches):
        marks = None if below is None else np.frombuffer(below.value, np.uint8)
        for batch in batches:
            for lang, text, _, _ in _joined(batch):
                for g in _windows(text, lang, bits):
                    fp, cnt = np.unique(g.over(n, marks)[1], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(cnt.astype(np.int64))], names=schema.names)
    rows = units.select("lang", "unit", "text").mapInArrow(count, schema)
    return rows.groupBy("fp").agg(F.sum("cnt").alias("cnt"))


def _occurrences(units: DataFrame, marks: list, bits: int = FINGERPRINT_BITS) -> DataFrame:
    """(n, fp, cnt, at, c0, c1): counts, an occurrence and the checks of the n-grams that are marked."""
    schema = StructType([StructField("n", IntegerType()), StructField("fp", LongType()), StructField("cnt", LongType()),
                         StructField("at", LongType()), StructField("chk", IntegerType())])

    def count(batches):
        bitmaps = [np.frombuffer(m.value, np.uint8) for m in marks]
        for batch in batches:
            for lang, text, numbers, starts in _joined(batch):
                for g in _windows(text, lang, bits):
                    for n, own in enumerate(bitmaps, 1):
                        i, fp = g.over(n, bitmaps[n - 2] if n > 1 else None)
                        keep = _marked(own, fp)
                        i, fp = i[keep], fp[keep]
                        if not len(i):
                            continue
                        order = np.argsort(fp, kind="stable")
                        i, fp = i[order], fp[order]
                        chk = g.checks(i, n)
                        first = np.flatnonzero(np.append(True, (fp[1:] != fp[:-1]) | (chk[1:] != chk[:-1])))
                        cnt = np.diff(np.append(first, len(fp)))
                        byte = g.base + g.starts[i[first]]
                        unit = np.searchsorted(starts, byte, side="right") - 1
                        place = (numbers[unit] << _OFFSET_BITS) + byte - starts[unit]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(first), n, np.int32)), pa.array(fp[first].view(np.int64)),
                             pa.array(cnt.astype(np.int64)), pa.array(place.astype(np.int64)),
                             pa.array(chk[first].astype(np.int32))], names=schema.names)
    rows = units.select("lang", "unit", "text").mapInArrow(count, schema)
    return rows.groupBy("n", "fp").agg(F.sum("cnt").alias("cnt"), F.min("at").alias("at"),
                                       F.min("chk").alias("c0"), F.max("chk").alias("c1"))


# --- texts ------------------------------------------------------------------------------------

def _pointed(units: DataFrame, found: DataFrame) -> DataFrame:
    """(lang, phrase, f): the texts of fingerprints, from the units that their pointers name."""
    wanted = (found.groupBy(F.shiftright("at", _OFFSET_BITS).alias("at_unit"))
              .agg(F.collect_list(F.struct(F.col("at").bitwiseAND((1 << _OFFSET_BITS) - 1).alias("o"), "n", "cnt")).alias("w")))
    schema = StructType([StructField("lang", StringType()), StructField("phrase", StringType()), StructField("f", LongType())])

    def read(batches):
        for batch in batches:
            for lang, far, blob, wanted in zip(*(batch.column(k) for k in range(4)), strict=True):
                text, w, far = blob.as_py(), wanted.values, far.as_py() << _OFFSET_BITS
                phrases = [_SPANS[n].match(text, far + o).group().decode(errors="replace")
                           for o, n in zip(w.field("o").to_pylist(), w.field("n").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang.as_py()] * len(phrases), pa.string()), pa.array(phrases, pa.string()), w.field("cnt")],
                    names=schema.names)
    numbers = F.sequence(F.lit(0).cast("long"), F.shiftright(F.octet_length("text").cast("long"), _OFFSET_BITS))
    one = (units.select("lang", "unit", "text", F.explode(numbers).alias("far"))
           .join(wanted, F.col("unit") + F.col("far") == F.col("at_unit")).select("lang", "far", "text", "w"))
    return one.mapInArrow(read, schema)


_SPANS = {n: re.compile(rb"[^ \n]+" + rb" [^ \n]+" * (n - 1)) for n in range(1, MAX_WORDS + 1)}


def _recounted(units: DataFrame, n: int, fingerprints: DataFrame, bits: int = FINGERPRINT_BITS) -> DataFrame:
    """(lang, phrase, f): counts by text of the n-grams whose fingerprint stands for several."""
    marks = _bitmap(fingerprints)
    schema = StructType([StructField("lang", StringType()), StructField("fp", LongType()),
                         StructField("phrase", StringType()), StructField("cnt", LongType())])

    def count(batches):
        bitmap = np.frombuffer(marks.value, np.uint8)
        for batch in batches:
            for lang, text, _, _ in _joined(batch):
                for g in _windows(text, lang, bits):
                    i, fp = g.at(n)
                    keep = _marked(bitmap, fp)
                    seen: dict = {}
                    for k, x in zip(i[keep], fp[keep].view(np.int64), strict=True):
                        key = (int(x), text[g.base + g.starts[k]:g.base + g.ends[k + n - 1]].decode(errors="replace"))
                        seen[key] = seen.get(key, 0) + 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(seen), pa.string()), pa.array([k[0] for k in seen], pa.int64()),
                         pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())],
                        names=schema.names)
    rows = units.select("lang", "unit", "text").mapInArrow(count, schema)
    return (rows.groupBy("lang", "fp", "phrase").agg(F.sum("cnt").alias("f"))
            .join(fingerprints.select("fp"), "fp", "left_semi").select("lang", "phrase", "f"))


def frequent_phrases(df: DataFrame, text_col: str = "text", lang_col: str = "lang",
                     min_count: int = MIN_COUNT, bits: int = FINGERPRINT_BITS) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, f): the phrases of up to MAX_WORDS words with their exact counts,
    (lang, n): the number of words)."""
    begin(df.sparkSession)
    units = stored(_units(df, text_col, lang_col), "phrase-units", **{"parquet.block.size": ROW_GROUP_BYTES})
    marks: list = []
    for n in range(1, MAX_WORDS + 1):
        level = _count_level(units, n, marks[-1] if marks else None, bits).filter(F.col("cnt") >= min_count)
        marks.append(_bitmap(stored(level.select("fp"), "phrase-marks")))
    found = stored(_occurrences(units, marks, bits).filter(F.col("cnt") >= min_count), "phrase-occurrences")
    phrases = [_pointed(units, found.filter("c0 = c1"))]
    for n in sorted(r["n"] for r in found.filter("c0 <> c1").select("n").distinct().collect()):
        clash = found.filter(f"c0 <> c1 AND n = {n}")
        phrases.append(_recounted(units, n, clash, bits).filter(F.col("f") >= min_count))
    return (stored(functools.reduce(DataFrame.unionByName, phrases), "phrases"),
            units.groupBy("lang").agg(F.sum("n_words").alias("n")))


# --- collocations -----------------------------------------------------------------------------

def _part(words: Column, start, length) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT,
                 top: int = TOP, bits: int = FINGERPRINT_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases."""
    table, totals = frequent_phrases(df, text_col, lang_col, min_count, bits)
    w = F.split("phrase", " ")
    phrases = table.select("lang", "phrase", F.col("f").alias("a"), w.alias("w"), F.size(w).alias("size"))
    many = phrases.filter("size > 1")
    # Parts of all cuts, looked up in the phrases; the rows of a part are dealt over salts.
    cuts = (many.select("lang", "phrase", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
            .select("lang", "phrase", "a", "k", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"), F.explode(F.array(
                F.struct(F.lit(True).alias("first"), _part(F.col("w"), 1, F.col("k")).alias("part")),
                F.struct(F.lit(False).alias("first"), _part(F.col("w"), F.col("k") + 1, F.col("size") - F.col("k")).alias("part")))).alias("x"))
            .select("lang", "phrase", "a", "k", "salt", "x.first", "x.part"))
    counts = table.select("lang", F.col("phrase").alias("part"), "f", F.explode(F.array(*[F.lit(s).cast("long") for s in range(SALTS)])).alias("salt"))
    cut = (cuts.join(counts, ["lang", "part", "salt"]).groupBy("lang", "phrase", "a", "k")
           .agg(F.max(F.when(F.col("first"), F.col("f"))).alias("l"), F.max(F.when(~F.col("first"), F.col("f"))).alias("r")))
    score = F.expr(f"(CAST({SCALE} AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0))) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    scored = (cut.withColumn("score", score).groupBy("lang", "phrase", "a")
              .agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score"))
    # The greatest count of a longer phrase around each phrase.
    inner = (many.filter("size > 2").select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
             .select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("s"))
             .groupBy("lang", _part(F.col("w"), F.col("s"), F.col("m")).alias("phrase")).agg(F.max("a").alias("around")))
    nested = F.expr(f"100 * CAST(around AS DECIMAL(19,0)) >= {NESTED_PERCENT} * CAST(a AS DECIMAL(19,0))")
    kept = scored.join(inner, ["lang", "phrase"], "left").filter(~F.coalesce(nested, F.lit(False)))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    return (kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).join(totals, "lang")
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
