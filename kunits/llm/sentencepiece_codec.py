"""SentencePiece encoding and decoding by a shared-prefix forward pass.

The distinct marked words of a batch are sorted, which lays them out as a trie
in depth-first order. One stack holds the forward states of the current path;
a word keeps the states of the prefix that it shares with its predecessor and
only computes those of its own tail.

* Unigram models: a state is the best score of the prefix and its last piece
  (Viterbi).
* BPE models: the sum of scores doesn't decide, so a state is the last piece
  of the prefix's unique BPE encoding. Piece ``b`` may follow piece ``a`` iff
  BPE leaves their joined text as ``a, b``; a sequence is the BPE encoding of
  its text iff all neighbours are so. Hence each prefix has exactly one state,
  found from the states of shorter prefixes, as in Viterbi. Which pieces end
  at a place is told by the longest ending that begins a piece (Aho-Corasick),
  which the stack holds as well.

Texts are cut into words, words told apart and ids put together and decoded by
Arrow and numpy; Python only works on the distinct words of a slice.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kunits.llm.common import lean

MARK = "▁"
#: Piece types of the model format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words kept by a worker between slices; only memory depends on it.
KEPT_WORDS = 300_000
#: Pairs of pieces and steps between endings kept by a worker; only memory depends on it.
KEPT_STEPS = 800_000
#: Bytes of text worked on at once (or one text); only memory depends on it.
SLICE_BYTES = 1_500_000
SCHEMA = "doc_id long, n_tokens long, ids array<int>, n_chars long, decoded_sha256 string, round_trip boolean"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message: number and value."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class _Ending(dict):
    """An ending of a text that begins a piece; its items are the longest such endings after one more character."""

    __slots__ = ("fits", "model", "text")

    def __init__(self, model: PieceModel, text: str):
        self.model, self.text = model, text
        whole = [(len(text) - i, model.ids[text[i:]]) for i in range(len(text)) if text[i:] in model.ids]
        #: Pieces at the end, the longest first: where their predecessor stands in the stack, the piece, its predecessors.
        self.fits = [(-size, piece, model.after(piece)) for size, piece in whole]

    def __missing__(self, char: str) -> _Ending:
        text = self.text + char
        while text not in self.model.beginnings:
            text = text[1:]
        found = self.model.ending(text)
        if text:  # characters outside the vocabulary are without number
            self.model.count()
            self[char] = found
        return found


class _After(dict):
    """Whether BPE keeps a piece after the piece that is asked for (-1: after nothing)."""

    __slots__ = ("model", "piece")

    def __init__(self, model: PieceModel, piece: int):
        self.model, self.piece = model, piece

    def __missing__(self, a: int) -> bool:
        self.model.count()
        kept = self[a] = self.model.follows(a, self.piece)
        return kept


class PieceModel:
    """Vocabulary of a SentencePiece model: pieces as (text, score, type)."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: str, dummy_prefix: bool = True):
        if kind not in ("unigram", "bpe"):
            raise ValueError(f"model type {kind} is not supported")
        if any(t == USER_DEFINED for _, _, t in pieces):
            raise ValueError("user-defined pieces are not supported")
        self.kind, self.dummy_prefix = kind, dummy_prefix
        self.texts = [p for p, _, _ in pieces]
        self.scores = [s for _, s, _ in pieces]
        self.types = [t for _, _, t in pieces]
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t in (NORMAL, UNUSED)}
        self.unknown = next(i for i, t in enumerate(self.types) if t == UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        #: Every ending of a piece: a longer ending can only be one if this one is.
        self.endings = {p[i:] for p in self.ids for i in range(len(p))} if kind == "unigram" else set()
        #: Every beginning of a piece, the empty one too.
        self.beginnings = {""} | {p[:i] for p in self.ids for i in range(1, len(p) + 1)} if kind == "bpe" else set()
        #: Whether no piece crosses words; else a text is one word.
        self.cut = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        #: Characters of each piece; at -1 of one character outside the vocabulary.
        self.widths = [*map(len, self.texts), 1]
        usual = [s for s, t in zip(self.scores, self.types, strict=True) if t == NORMAL]
        self.unknown_score = min(usual, default=0.0) - 10.0
        self._endings: dict[str, _Ending] = {}
        self._after: dict[int, _After] = {}
        self._growths: dict[int, list[tuple[float, str, str]]] = {}
        self._steps = 0
        self._kept: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        #: What each piece decodes to.
        self.raw = [bytes([self.byte_of[i]]) if t == BYTE else " ⁇ ".encode() if t == UNKNOWN else b"" if t == CONTROL else p.replace(MARK, " ").encode() for i, (p, _, t) in enumerate(pieces)]
        self._raw = pa.array(self.raw, pa.large_binary())

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        """Read a ``.model`` file's bytes. Character maps and space removal are refused."""
        pieces, kind, dummy = [], "unigram", True
        for number, value in _fields(data):
            if number == 1:
                got = dict(_fields(value))
                pieces.append((got[1].decode(), struct.unpack("<f", got.get(2, b"\0\0\0\0"))[0], got.get(3, NORMAL)))
            elif number == 2:
                kind = {1: "unigram", 2: "bpe", 3: "word", 4: "char"}[dict(_fields(value)).get(3, 1)]
            elif number == 3:
                rules = dict(_fields(value))
                dummy = bool(rules.get(3, 1))
                if rules.get(2) or rules.get(4, 1):
                    raise ValueError("only models without character map and space removal are supported")
        return cls(pieces, kind, dummy)

    # States. Pieces below 0 stand for one character outside the vocabulary.

    def _growth(self, piece: int) -> list[tuple[float, str, str]]:
        """Plain BPE of a piece alone, the best pair first, the leftmost of equals.

        Before each merge, and at the end: the merge's score, the first and the
        last part. Empty if it doesn't end in the piece.
        """
        if piece not in self._growths:
            parts, steps = list(self.texts[piece]), []
            while len(parts) > 1:
                best, at = -np.inf, -1
                for i in range(len(parts) - 1):
                    p = self.ids.get(parts[i] + parts[i + 1])
                    if p is not None and self.scores[p] > best:
                        best, at = self.scores[p], i
                if at < 0:
                    break
                steps.append((best, parts[0], parts[-1]))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self._growths[piece] = [*steps, (-np.inf, parts[0], parts[-1])] if len(parts) == 1 else []
        return self._growths[piece]

    def follows(self, a: int, b: int) -> bool:
        """Whether BPE keeps piece b after piece a (-1: after nothing).

        Both grow as they do alone unless a pair across their border, with the
        parts that stand there, comes first.
        """
        right = self._growth(b)
        if a < 0:
            return bool(right)
        left, i, j = self._growth(a), 0, 0
        while left and right:
            (before, _, end), (behind, begin, _) = left[i], right[j]
            across = self.ids.get(end + begin)
            if across is not None and before < self.scores[across] >= behind:
                return False
            if before == behind == -np.inf:
                return True
            if before >= behind:
                i += 1
            else:
                j += 1
        return False

    def ending(self, text: str) -> _Ending:
        """The state of an ending, made once."""
        if text not in self._endings:
            self._endings[text] = _Ending(self, text)
        return self._endings[text]

    def after(self, piece: int) -> _After:
        if piece not in self._after:
            self._after[piece] = _After(self, piece)
        return self._after[piece]

    def count(self) -> None:
        """One more step is kept; beyond the limit all are found anew."""
        self._steps += 1
        if self._steps > KEPT_STEPS:
            self._steps = 1
            for kept in (*self._endings.values(), *self._after.values()):
                kept.clear()

    def _bpe(self, words: Iterable[str]) -> Iterator[list[int]]:
        last, path, before = [-1], [self.ending("")], ""
        for word in words:
            common = _shared(before, word)
            del last[common + 1 :], path[common + 1 :]
            ending = path[common]
            for char in word[common:]:
                ending = ending[char]
                path.append(ending)
                for back, piece, after in ending.fits:
                    if after[last[back]]:
                        last.append(piece)
                        break
                else:
                    last.append(-1)
            before = word
            yield self._traced(word, last)

    def _viterbi(self, words: Iterable[str]) -> Iterator[list[int]]:
        ids, scores, endings = self.ids, self.scores, self.endings
        best, last, before = [0.0], [-1], ""
        for word in words:
            common = _shared(before, word)
            del best[common + 1 :], last[common + 1 :]
            for end in range(common + 1, len(word) + 1):
                top, piece, size = -np.inf, -1, 1
                while size <= end and (ending := word[end - size : end]) in endings:
                    p = ids.get(ending)
                    if p is not None and best[end - size] + scores[p] > top:
                        top, piece = best[end - size] + scores[p], p
                    size += 1
                if word[end - 1] not in ids and best[end - 1] + self.unknown_score > top:
                    top, piece = best[end - 1] + self.unknown_score, -1
                best.append(top)
                last.append(piece)
            before = word
            yield self._traced(word, last)

    def _traced(self, word: str, last: list[int]) -> list[int]:
        out, at, widths = [], len(word), self.widths
        while at:
            piece = last[at]
            out.append(piece)
            at -= widths[piece]
        out.reverse()
        return self._spelled(word, out) if -1 in out else out

    def _spelled(self, word: str, ids: list[int]) -> list[int]:
        """The ids of a word with those of bytes, or the unknown piece, for its characters outside the vocabulary."""
        out, at = [], 0
        for piece in ids:
            if piece >= 0:
                out.append(piece)
            elif self.bytes:
                out.extend(self.bytes[b] for b in word[at].encode())
            elif not (out and out[-1] == self.unknown):  # neighbouring unknown characters make one piece
                out.append(self.unknown)
            at += self.widths[piece]
        return out

    def _known(self, words: list[str]) -> list[bytes]:
        """Piece ids of each of these distinct words, 4 bytes each in this machine's order."""
        if len(self._kept) > KEPT_WORDS // 2:  # those that aren't asked for while the next half fills up go
            self._older, self._kept = self._kept, {}
        kept, older = self._kept, self._older
        missing = [w for w in words if w not in kept]
        kept.update((w, older[w]) for w in missing if w in older)
        new = sorted(w for w in missing if w not in kept)
        forward = self._bpe if self.kind == "bpe" else self._viterbi
        kept.update((w, array("i", ids).tobytes()) for w, ids in zip(new, forward(new), strict=True))
        return list(map(kept.__getitem__, words))

    def _words(self, texts: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray]:
        """The words of all texts end to end, spaces and marks as spaces, and the place of each text's first (and the end)."""
        texts = pc.replace_substring(texts, MARK, " ")
        if self.dummy_prefix:
            texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
        ends = np.cumsum(np.concatenate([[0], pc.binary_length(texts).to_numpy(zero_copy_only=False)])).astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: ends[-1]]
        begins = np.zeros(len(data) + 1, bool)
        if self.cut and len(data):
            space = data == ord(" ")
            begins[1:-1] = space[1:] & ~space[:-1]
        begins[ends] = True
        places = np.flatnonzero(begins).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(places) - 1, pa.py_buffer(places), pa.py_buffer(data))
        return words, np.searchsorted(places, ends)

    def pieces(self, texts: pa.LargeStringArray) -> tuple[pa.Array, np.ndarray]:
        """Piece ids of all texts end to end, and the place of each text's first (and the end). No text is null."""
        words, firsts = self._words(texts)
        coded = words.dictionary_encode()
        ids = self._known(pc.replace_substring(coded.dictionary, " ", MARK).to_numpy(zero_copy_only=False).tolist())
        ends = np.cumsum(np.fromiter((0, *map(len, ids)), np.int64, len(ids) + 1)) // 4
        flat = np.frombuffer(b"".join(ids), np.int32)
        lists = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(flat)).take(coded.indices)
        return lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)[firsts]

    def packed(self, texts: list[str]) -> list[bytes]:
        """Piece ids of each text, 4 bytes each in this machine's order."""
        ids, ends = self.pieces(pa.array(texts, pa.large_string()))
        flat = ids.to_numpy()
        return [flat[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Piece ids of each text."""
        return [np.frombuffer(x, np.int32).tolist() for x in self.packed(texts)]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of piece ids; unknown pieces become U+2047 between spaces."""
        ids = pa.array(ids, pa.int32())
        return self.decode_all(ids, np.array([0, len(ids)]))[0]

    def decode_all(self, ids: pa.Array, ends: np.ndarray) -> list[str]:
        """The texts of piece ids that stand end to end; from and to where each one's do."""
        raw = self._raw.take(ids)
        places = np.concatenate([[0], np.cumsum(pc.binary_length(raw).to_numpy(zero_copy_only=False))]).astype(np.int64)[ends].tolist()
        data = memoryview(raw.buffers()[2] or b"")
        texts = [str(data[a:b], "utf-8", "replace") for a, b in zip(places, places[1:], strict=False)]
        return [t[1:] if self.dummy_prefix and t[:1] == " " else t for t in texts]


def _shared(a: str, b: str) -> int:
    """Length of the common prefix; neighbours of a sorted list mostly differ near their ends."""
    n, step = min(len(a), len(b)), 1
    if a[:n] == b[:n]:
        return n
    while a[:n] != b[:n]:
        n, step = max(n - step, 0), 2 * step
    while a[n] == b[n]:
        n += 1
    return n


_models: dict[str, PieceModel] = {}


def forget() -> None:
    _models.clear()


def loaded(data: bytes) -> PieceModel:
    """The model of these bytes, parsed once in each worker."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _models:
        _models[key] = PieceModel.parse(data)
    return _models[key]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of ids and texts, of SLICE_BYTES or one row; null texts are empty."""
    texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
    batch = pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "text"])
    ends, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        size = max(1, int(np.searchsorted(ends, done + SLICE_BYTES, "right")) - at)
        yield batch.slice(at, size)
        at += size


def encode_documents(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode it again; one row for each row of *df*.

    Narrow: no shuffle; each slice of a batch sorts its own distinct words. Null and empty
    texts have no pieces and decode to the empty text. ``decoded_sha256`` and
    ``n_chars`` are taken of the decoded text, ``round_trip`` tells whether it
    is the text. Repeated rows are encoded each; other columns don't matter.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # one vocabulary file

    @lean(forget)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = loaded(shared.value)
        for batch in batches:
            for part in _slices(batch):
                column = part.column(1)
                ids, ends = codec.pieces(column)
                back, texts = codec.decode_all(ids, ends), column.to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(np.diff(ends)),
                        pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), ids),
                        pa.array(list(map(len, back)), pa.int64()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
                        pa.array([a == b.replace(MARK, " ") for a, b in zip(back, texts, strict=True)], pa.bool_()),
                    ],
                    ["doc_id", "n_tokens", "ids", "n_chars", "decoded_sha256", "round_trip"],
                )

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
