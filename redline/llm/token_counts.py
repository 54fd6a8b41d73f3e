"""Token counts by a linear longest-match automaton.

The vocabulary is a trie.  Each node that no vocabulary piece ends at, or whose longest match must
be taken back, has a failure link: the node for what is left of the path after the greedy pieces
were cut off, and the number of those pieces.  Reading a word follows trie edges and, where there
is none, the failure link, adding its number; so greedy longest-match-first lengths come out in
time linear in the word, and no piece is ever built.

Words are runs of characters other than ASCII white space.  Two vocabulary styles: ``start`` marks
the pieces that begin a word (``▁the``) and is prefixed to each word; or ``continuation`` marks
those inside (``##ing``).  A word that the vocabulary cannot cover is one unknown token.

Defined cases: null and empty texts have no words and no tokens; long words and texts are read
whole; repeated rows come out once each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from redline.llm.common import begin, worker_state

#: Words that a task remembers before it starts afresh (memory bound, no effect on results).
CACHE_WORDS = 300_000


class Automaton:
    """Nodes are numbers: ``edges[n]`` maps a character to a node, ``fail[n]`` is a node or -1,
    ``popped[n]`` the number of pieces that the failure link stands for."""

    def __init__(self, initial: tuple[str, ...], inner: tuple[str, ...] | None = None):
        """``inner`` None: the same pieces match at the start and inside of a word."""
        self.edges: list[dict[str, int]] = [{}]
        self.fail, self.popped = [-1], [0]
        self._ends = {False: set(), True: set()}
        self.root = 0
        self.inner_root = 0 if inner is None else self._node()
        for root, pieces in ((0, initial), (self.inner_root, inner or ())):
            for p in pieces:
                self._add(root, p)
        self._link()

    def _node(self) -> int:
        self.edges.append({})
        self.fail.append(-1)
        self.popped.append(0)
        return len(self.edges) - 1

    def _add(self, root: int, piece: str) -> None:
        n = root
        for c in piece:
            nxt = self.edges[n].get(c)
            if nxt is None:
                nxt = self.edges[n][c] = self._node()
            n = nxt
        if n != root:
            self._ends[True].add(n)

    def _link(self) -> None:
        """Breadth first, so that every link used lies nearer to its root."""
        level = list(dict.fromkeys((self.root, self.inner_root)))
        while level:
            below = []
            for n in level:
                for c, child in self.edges[n].items():
                    below.append(child)
                    if child in self._ends[True]:
                        self.fail[child], self.popped[child] = self.inner_root, 1
                        continue
                    at, cut = self.fail[n], self.popped[n]
                    while at >= 0 and c not in self.edges[at]:
                        cut += self.popped[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[child], self.popped[child] = self.edges[at][c], cut
            level = below

    def count(self, word: str) -> int:
        """Pieces of the greedy longest-match segmentation; 1 if there is none."""
        edges, fail, popped = self.edges, self.fail, self.popped
        n, total = self.root, 0
        for c in word:
            nxt = edges[n].get(c)
            while nxt is None:
                if fail[n] < 0:
                    return 1
                total += popped[n]
                n = fail[n]
                nxt = edges[n].get(c)
            n = nxt
        while n != self.inner_root:
            if fail[n] < 0:
                return 1
            total += popped[n]
            n = fail[n]
        return total


def _automaton(pieces: tuple[str, ...], continuation: str) -> Automaton:
    if continuation:
        return Automaton(tuple(p for p in pieces if not p.startswith(continuation)),
                         tuple(p[len(continuation):] for p in pieces if p.startswith(continuation)))
    return Automaton(pieces)


def sentencepiece_vocabulary(path: str) -> tuple[str, ...]:
    """Normal pieces of a sentencepiece model (no control, unknown or byte pieces)."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return tuple(sp.id_to_piece(i) for i in range(sp.get_piece_size())
                 if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)))


def token_counts(df: DataFrame, pieces: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text",
                 start: str = "▁", continuation: str = "") -> DataFrame:
    """(id, n_words, n_tokens) of every whole text."""
    begin(df.sparkSession)
    schema = StructType([StructField(id_col, df.schema[id_col].dataType), StructField("n_words", LongType()),
                         StructField("n_tokens", LongType())])
    prefix = "" if continuation else start

    def count(batches):
        # Tasks that follow in the same worker find both ready.
        automaton, known = worker_state(("automaton", hash(pieces), prefix, continuation),
                                        lambda: (_automaton(pieces, continuation), {}))

        def lookup(w: bytes) -> int:
            n = known[w] = automaton.count(prefix + w.decode())
            return n
        for batch in batches:
            words, tokens = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for i, value in enumerate(batch.column(1)):
                if text := value.as_py():
                    ws = text.split()
                    words[i] = len(ws)
                    tokens[i] = sum(known[w] if w in known else lookup(w) for w in ws)
                    if len(known) > CACHE_WORDS:
                        known.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(tokens)], names=schema.names)
    # Ids stay in Arrow, whatever their type, nulls among them.
    return df.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(count, schema)
