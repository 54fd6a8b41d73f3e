"""Sentencepiece encoding and decoding by a table of distinct chunks.

A chunk is a run of white space markers with the characters up to the next marker.  Where no piece
of the model has a marker after another character, and the model leaves the text as it is but for
the markers, no merge reaches from one chunk into the next.  Then each distinct chunk is segmented
once, its ids go into the task's table, and a text's ids are the entries of its chunks, joined by
position.  ``splits_at_markers`` checks this for the model given; other models encode whole texts.
Decoding is the library's, over the whole id list of a text.

A table belongs to a Python worker and is bounded in bytes; it starts afresh beyond that.  A table
over the whole corpus would send every word of every text through a shuffle to spare a fraction of
the segmentations.

Defined cases: null and empty texts have the begin and end ids only; texts of any length are encoded
whole; repeated rows come out once each; null ids stay null, and ids are carried in Arrow as they
are; an empty table gives no rows; columns other than the two named are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from redline.llm.common import begin, runs, worker_state

#: A worker's table holds about so many bytes.
TABLE_BYTES = 64 << 20
#: Python's own cost of an entry: key, dictionary slot, place in the arrays.
ENTRY_BYTES = 150
MARK = "▁"


def splits_at_markers(sp) -> bool:
    """Can texts be cut before every run of markers without changing their ids?"""
    probe = "  a  ﬁ Å\t b "
    if sp.normalize(probe) != MARK + probe.replace(" ", MARK):
        return False
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    return not any(MARK in p.lstrip(MARK) for p in pieces)


class ChunkTable:
    """Ids of texts.  A chunk's key is the chunk without its first marker, which the library puts
    back; the empty key is a marker alone, at the end of a text."""

    _CHUNKS = re.compile(" ( *[^ ]*)")

    def __init__(self, model: str):
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.whole = not splits_at_markers(self.sp)
        self.bos, self.eos = self.sp.bos_id(), self.sp.eos_id()
        self._clear()

    def _clear(self) -> None:
        alone = [] if self.whole else self.sp.encode("a ")[len(self.sp.encode("a")):]
        self.known = {"": 0}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ids[:len(alone)] = alone
        self.used = len(alone)
        self.starts, self.lens = np.zeros(1, np.int64), np.array([len(alone)], np.int64)
        self.bytes = 0

    def _learn(self, keys: list[str]) -> None:
        coded = self.sp.encode(keys, num_threads=1)
        lens = np.fromiter(map(len, coded), np.int64, count=len(keys))
        flat = np.fromiter((i for c in coded for i in c), np.uint32, count=int(lens.sum()))
        n = self.used + len(flat)
        if n > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(n - len(self.ids), len(self.ids)), np.uint32)])
        self.ids[self.used:n] = flat
        first = len(self.starts)
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(lens) - lens])
        self.lens = np.concatenate([self.lens, lens])
        self.used = n
        self.known.update(zip(keys, range(first, first + len(keys)), strict=True))
        self.bytes += ENTRY_BYTES * len(keys) + sum(map(len, keys)) + 4 * len(flat)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, without begin and end."""
        if self.whole:
            return [np.asarray(ids, np.uint32) for ids in self.sp.encode(texts, num_threads=1)]
        if self.bytes > TABLE_BYTES:
            self._clear()
        flat, sizes = [], []
        for t in texts:
            keys = self._CHUNKS.findall(" " + t.replace(MARK, " ")) if t else []
            flat += keys
            sizes.append(len(keys))
        which = np.fromiter(map(self.known.get, flat, _absent()), np.int64, count=len(flat))
        missing = np.flatnonzero(which < 0)
        if len(missing):
            new = [flat[i] for i in missing]
            self._learn(list(dict.fromkeys(new)))
            which[missing] = np.fromiter(map(self.known.__getitem__, new), np.int64, count=len(new))
        # Entries are slices of ``ids``; all are gathered at once, one after another.
        n = self.lens[which]
        ends = np.cumsum(n)
        ids = self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[which] - (ends - n), n)]
        at = np.append(0, ends)[np.cumsum([0, *sizes])]
        return [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _absent():
    while True:
        yield -1


def transcode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", bos: bool = True,
              eos: bool = True, with_text: bool = True) -> DataFrame:
    """(id, ids[, decoded]) of every whole text: its ids as little-endian unsigned 32-bit integers,
    and what the library decodes from them."""
    begin(df.sparkSession)
    fields = [StructField(id_col, df.schema[id_col].dataType), StructField("ids", BinaryType())]
    schema = StructType(fields + [StructField("decoded", StringType())] * with_text)

    def code(batches):
        table = worker_state(("pieces", model), lambda: ChunkTable(model))
        head = np.array([table.bos] * bos, np.uint32)
        tail = np.array([table.eos] * eos, np.uint32)
        for batch in batches:
            texts = batch.column(1)
            for a, b in runs(texts):
                part = [(t or b"").decode(errors="replace") for t in texts.slice(a, b - a).to_pylist()]
                ids = [np.concatenate([head, x, tail]).astype("<u4") for x in table.encode(part)]
                out = [batch.column(0).slice(a, b - a), pa.array([x.tobytes() for x in ids], pa.binary())]
                if with_text:
                    out.append(pa.array(table.sp.decode([x.tolist() for x in ids], num_threads=1), pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=schema.names)
    rows = df.select(F.col(id_col), F.col(text_col).cast("binary"))
    return rows.mapInArrow(code, schema)


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", bos: bool = True,
           eos: bool = True) -> DataFrame:
    """(id, ids) as by ``transcode``."""
    return transcode(df, model, id_col, text_col, bos, eos, with_text=False)


def decode(df: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded) of id lists as ``encode`` returns them; null: empty."""
    begin(df.sparkSession)
    schema = StructType([StructField(id_col, df.schema[id_col].dataType), StructField("decoded", StringType())])

    def back(batches):
        table = worker_state(("pieces", model), lambda: ChunkTable(model))
        for batch in batches:
            for a, b in runs(batch.column(1)):
                ids = [np.frombuffer(x or b"", "<u4").tolist() for x in batch.column(1).slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(table.sp.decode(ids, num_threads=1), pa.string())],
                    names=schema.names)
    return df.select(F.col(id_col), F.col(ids_col).cast("binary")).mapInArrow(back, schema)
