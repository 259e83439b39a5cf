"""Token counts by a linear longest-match automaton.

The vocabulary is a trie with two roots, one for the start of a word and one
for its continuation. Every node has a failure link, the node that is reached
once the longest possible pieces have been popped off its text, and the number
of pieces popped. A word is then read once, character by character, adding the
counts of the links it takes: greedy word-piece length without any piece.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kunits.llm.sentencepiece_codec import MARK, PieceModel

#: A word: letters, digits and underscores, or one other visible character.
WORDS = re.compile(r"\w+|[^\w\s]")
#: Words kept by a worker between batches; only memory depends on it.
KEPT_WORDS = 1_000_000
SCHEMA = "doc_id long, n_words long, n_tokens long, n_unknown long"


class CountAutomaton:
    """starts: pieces that begin a word; more: pieces that continue one."""

    def __init__(self, starts: set[str], more: set[str]):
        self.child: list[dict[str, int]] = [{}, {}]
        final = [False, False]
        for root, words in ((0, starts), (1, more)):
            for word in words:
                node = root
                for c in word:
                    if c not in self.child[node]:
                        self.child[node][c] = len(self.child)
                        self.child.append({})
                        final.append(False)
                    node = self.child[node][c]
                final[node] = bool(word) or final[node]
        n = len(self.child)
        #: Failure link, -1 where the text so far can't be split; pieces popped on the way.
        self.link, self.popped = [-1] * n, [0] * n
        queue = deque((root, c, node) for root in (0, 1) for c, node in self.child[root].items())
        while queue:
            parent, c, node = queue.popleft()
            if final[node]:
                self.link[node], self.popped[node] = 1, 1
            else:
                at, count = self.link[parent], self.popped[parent]
                while at >= 0 and c not in self.child[at]:
                    count += self.popped[at]
                    at = self.link[at]
                if at >= 0:
                    self.link[node], self.popped[node] = self.child[at][c], count
            queue.extend((node, d, below) for d, below in self.child[node].items())
        self._kept: dict[str, int] = {}

    def length(self, word: str) -> int:
        """Pieces of the word, 0 where the vocabulary can't spell it."""
        child, link, popped = self.child, self.link, self.popped
        node = count = 0
        for c in word:
            below = child[node].get(c)
            while below is None:
                count += popped[node]
                node = link[node]
                if node < 0:
                    return 0
                below = child[node].get(c)
            node = below
        while node != 1:
            count += popped[node]
            node = link[node]
            if node < 0:
                return 0
        return count

    def lengths(self, words: list[str]) -> np.ndarray:
        kept = self._kept
        new = set(words).difference(kept)
        if len(kept) + len(new) > KEPT_WORDS:
            kept.clear()
            new = set(words)
        for w in new:
            kept[w] = self.length(w)
        return np.fromiter(map(kept.__getitem__, words), np.int64, len(words))


def from_json(data: bytes) -> CountAutomaton:
    """starts and more, as :func:`vocabulary` writes them."""
    parts = json.loads(data)
    return CountAutomaton(set(parts["starts"]), set(parts["more"]))


def vocabulary(model: bytes) -> bytes:
    """Word pieces of a SentencePiece vocabulary: marked pieces start a word, others continue it."""
    ids = PieceModel.parse(model).ids
    starts = sorted(p[1:] for p in ids if p[0] == MARK and len(p) > 1 and MARK not in p[1:])
    more = sorted(p for p in ids if MARK not in p)
    return json.dumps({"starts": starts, "more": more}).encode()


_automata: dict[str, CountAutomaton] = {}


def count_tokens(df: DataFrame, vocab: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Greedy word-piece counts of every whole text; one row for each row of *df*.

    A word that the vocabulary can't spell counts as one token and as unknown;
    words have no length limit. Null and empty texts have no words. Repeated
    rows are counted each; other columns don't matter. Narrow: no shuffle.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocab)  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hashlib.sha256(shared.value).hexdigest()
        if key not in _automata:
            _automata[key] = from_json(shared.value)
        automaton = _automata[key]
        for batch in batches:
            found: list[list[int]] = []
            for at in range(0, batch.num_rows, 256):
                for text in batch.column(1).slice(at, 256).to_pylist():
                    lengths = automaton.lengths(WORDS.findall(text or ""))
                    unknown = int((lengths == 0).sum())
                    found.append([len(lengths), int(lengths.sum()) + unknown, unknown])
            counts = np.array(found, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[:, i]) for i in range(3))], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
