"""Fill-in-middle transformation of texts, cut by SWAR selection.

A unit is a run of ASCII white space with the run of other characters after it, or white space at the
end of a text.  A text's UTF-8 bytes, padded with blanks, are viewed as 64-bit words; the bytes at
which units end are marked arithmetically, eight bytes at a time; ``bitwise_count`` gives the units of
each word.  The end of the k-th unit is in the word where the cumulative count reaches k, found by
binary search, and there at the bit that is left once the lower marks are cleared.  All texts of a run
share one buffer, so there is no step per character or unit.

Which texts are transformed, where they are cut and in which form they are written follows from a hash
of seed and id alone.  Texts that hold a sentinel stay plain, so the text can be rebuilt from the output.

Defined cases: null and empty texts are plain and empty; white space alone is one unit; the text of a
null id draws as if its id were the empty text; texts of any length are cut whole; repeated rows get the
same cut; an empty table gives no rows; columns other than the two named are ignored, ids are carried
in Arrow as they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from redline.llm.common import begin, runs

SENTINELS = (b"<P>", b"<S>", b"<M>")
PREFIX, SUFFIX, MIDDLE = SENTINELS
#: Shares in percent: texts that are transformed, and of these, texts in the form suffix first.
FIM_PERCENT, SPM_PERCENT = 50, 80

_ONES = np.uint64(0x0101010101010101)
_LOW = np.uint64(0x7F) * _ONES
_HIGH = np.uint64(0x80) * _ONES


def _white(x: np.ndarray) -> np.ndarray:
    """The high bit of every byte that is ASCII white space."""
    blank = x ^ (np.uint64(0x20) * _ONES)
    blank = ~(((blank & _LOW) + _LOW) | blank)
    low = x & _LOW
    control = (low + np.uint64(0x80 - 0x09) * _ONES) & ~(low + np.uint64(0x80 - 0x0E) * _ONES) & ~x
    return (blank | control) & _HIGH


class Units:
    """The units of some texts: ``n`` of each, and the byte at which the k-th ends."""

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter(map(len, texts), np.int64, count=len(texts))
        words = sizes // 8 + 1                      # at least one blank after each text
        self.first = np.cumsum(words) - words
        x = np.frombuffer(b"".join(t + b" " * (8 - len(t) % 8) for t in texts), "<u8")
        white = _white(x)
        after = white >> np.uint64(8)
        after[:-1] |= white[1:] << np.uint64(56)
        ends = ~white & after & _HIGH
        # White space at the end of a text is a unit of its own.
        last = self.first + (sizes - 1) // 8
        bit = np.uint64(0x80) << (8 * ((sizes - 1) % 8)).astype(np.uint64)
        trailing = np.flatnonzero(sizes)
        trailing = trailing[(white[last[trailing]] & bit[trailing]) != 0]
        ends[last[trailing]] |= bit[trailing]
        self.ends = ends
        self.counts = np.bitwise_count(ends).astype(np.int64)
        self.upto = np.cumsum(self.counts)
        self.before = np.append(0, self.upto)[self.first]
        self.n = np.append(0, self.upto)[self.first + words] - self.before

    def cut(self, k: np.ndarray) -> np.ndarray:
        """For each text the number of bytes of its first k[i] units."""
        word = np.minimum(np.searchsorted(self.upto, self.before + k), len(self.upto) - 1)
        rank = self.before + k - (self.upto[word] - self.counts[word])
        marks = self.ends[word]
        for r in range(1, 8):
            marks = np.where(rank > r, marks & (marks - np.uint64(1)), marks)
        lowest = marks & (~marks + np.uint64(1))
        byte = np.bitwise_count(lowest - np.uint64(1)).astype(np.int64) // 8
        return np.where(k > 0, (word - self.first) * 8 + byte + 1, 0)


def draws(seed: int, key: str) -> list[int]:
    """Four numbers of 32 bits from the hash of seed and key."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return [int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12)]


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42,
                   fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output): units, form (plain, psm or spm), characters
    of prefix and middle (null: plain) and the text as written."""
    begin(df.sparkSession)
    schema = StructType([StructField(id_col, df.schema[id_col].dataType), StructField("n", LongType()),
                         StructField("form", StringType()), StructField("prefix_chars", LongType()),
                         StructField("middle_chars", LongType()), StructField("output", StringType())])

    def write(t: bytes, start: int, end: int, spm: bool):
        head, middle, tail = t[:start], t[start:end], t[end:]
        if spm:
            parts = (SUFFIX, tail, PREFIX, head, MIDDLE, middle)
        else:
            parts = (PREFIX, head, SUFFIX, tail, MIDDLE, middle)
        return "spm" if spm else "psm", len(head.decode(errors="replace")), len(middle.decode(errors="replace")), b"".join(parts)

    def transform(batches):
        for batch in batches:
            texts = batch.column(2)
            for a, b in runs(texts):
                part = [t or b"" for t in texts.slice(a, b - a).to_pylist()]
                units = Units(part)
                drawn = [draws(seed, k or "") for k in batch.column(1).slice(a, b - a).to_pylist()]
                h = np.array(drawn, np.int64).reshape(-1, 4)
                one, two = h[:, 0] % (units.n + 1), h[:, 1] % (units.n + 1)
                start, end = units.cut(np.minimum(one, two)), units.cut(np.maximum(one, two))
                out = []
                for i, t in enumerate(part):
                    if not t or h[i, 2] % 100 >= fim_percent or any(s in t for s in SENTINELS):
                        out.append(("plain", None, None, t))
                    else:
                        out.append(write(t, start[i], end[i], h[i, 3] % 100 < spm_percent))
                form, prefix, middle, output = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(units.n, pa.int64()), pa.array(form, pa.string()),
                     pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())],
                    names=schema.names)
    rows = df.select(F.col(id_col), F.col(id_col).cast("string").alias("key"), F.col(text_col).cast("binary"))
    return rows.mapInArrow(transform, schema)


def restored(output: Column, form: Column) -> Column:
    """The text from what was written: a transformed output falls into four parts at the sentinels."""
    parts = F.split(output, "<[PSM]>", -1)
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
