"""Word-piece counts by a linear longest-match automaton.

Greedy longest-match segmentation normally restarts after each piece. The automaton reads every character once: a trie
of the vocabulary where each node keeps a failure link (the node reached once the pieces forced by the longest match
are taken off) and how many pieces were taken off on the way. Summing those counts gives the number of pieces without
building any. Words repeat, so counts are remembered in a table of bounded size.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from helixframe.llm._common import bounded_batches
from helixframe.llm.packing import byte_symbols

SCHEMA = "doc_id long, n_words long, n_pieces long, n_unknown long, n_bytes long"
#: Words whose counts a worker remembers before it starts afresh.
MEMO_WORDS = 400_000


class Automaton:
    """Greedy longest-match piece counts over byte strings.

    ``initial`` holds the pieces that may start a word, ``inner`` those that may follow. A word that the greedy match
    can't finish counts as one unknown piece.
    """

    def __init__(self, initial: Iterable[bytes], inner: Iterable[bytes]):
        # Node 0 is the root of a word's first piece, node 1 that of all later ones.
        self.next: list[dict[int, int]] = [{}, {}]
        self.ends = [False, False]
        for root, pieces in ((0, initial), (1, inner)):
            for piece in pieces:
                if piece:
                    self._add(root, piece)
        self._link()

    def _add(self, node: int, piece: bytes) -> None:
        for c in piece:
            to = self.next[node].get(c)
            if to is None:
                to = self.next[node][c] = len(self.next)
                self.next.append({})
                self.ends.append(False)
            node = to
        self.ends[node] = True

    def _link(self) -> None:
        # fail[v]: where matching goes on when v has no edge for the next byte, or -1; popped[v]: pieces taken off by that.
        n = len(self.next)
        self.fail, self.popped = [-1] * n, [0] * n
        level = [(0, to, c) for c, to in self.next[0].items()] + [(1, to, c) for c, to in self.next[1].items()]
        while level:
            after = []
            for parent, v, c in level:
                if self.ends[v]:
                    self.fail[v], self.popped[v] = 1, 1
                else:
                    at, taken = self.fail[parent], self.popped[parent]
                    while at >= 0 and c not in self.next[at]:
                        taken += self.popped[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[v], self.popped[v] = self.next[at][c], taken
                after.extend((v, to, x) for x, to in self.next[v].items())
            level = after

    def count(self, word: bytes) -> int:
        """The number of pieces of ``word``; -1 if it can't be cut into pieces."""
        step, fail, popped = self.next, self.fail, self.popped
        at, total = 0, 0
        for c in word:
            to = step[at].get(c)
            while to is None:
                total += popped[at]
                at = fail[at]
                if at < 0:
                    return -1
                to = step[at].get(c)
            at = to
        while at > 1:
            total += popped[at]
            at = fail[at]
        return total if at == 1 or not word else -1


@lru_cache(maxsize=2)
def byte_vocabulary(path: str) -> Automaton:
    """The automaton of a byte-level vocabulary file: pieces that begin with the space symbol start a word, others follow."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    symbols, special = byte_symbols(), {t["content"] for t in spec["added_tokens"]}
    pieces = [bytes(symbols[c] for c in t) for t in spec["model"]["vocab"] if t not in special]
    # The space of a word's first piece is taken off, so that a word's own bytes are what is matched.
    first = [p[1:] for p in pieces if p[:1] == b" " and len(p) > 1]
    inner = [p for p in pieces if p[:1] != b" "]
    # Every byte may start a word: single bytes are in any byte-level vocabulary.
    return Automaton({*first, *(p for p in inner if len(p) == 1)}, inner)


def count_tokens(docs: DataFrame, vocab: str) -> DataFrame:
    """doc_id, n_words, n_pieces, n_unknown, n_bytes of each row of ``docs`` (doc_id, text).

    Words are runs of characters other than space and U+0009 to U+000D. An unknown word counts as one piece. A null or
    empty text has zero words and pieces; a null doc_id stays null; repeated rows are counted once each; no row gives no
    rows. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = byte_vocabulary(vocab)

        class Memo(dict):
            def __missing__(self, word: bytes) -> int:
                if len(self) >= MEMO_WORDS:
                    self.clear()
                self[word] = n = auto.count(word)
                return n

        memo = Memo()
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = (text or "").encode()
                counts = [memo[w] for w in raw.split()]
                unknown = counts.count(-1)
                for c, v in zip(out, (doc, len(counts), sum(counts) + 2 * unknown, unknown, len(raw)), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "n_words", "n_pieces", "n_unknown", "n_bytes"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
