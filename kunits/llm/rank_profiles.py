"""Language identification by rank-order profiles.

A profile lists the most frequent letter n-grams of a text or a language, most
frequent first. A document goes to the language whose profile is nearest by
the out-of-place distance: for each n-gram of the document, how far apart its
two ranks are, or the profile's size where the language lacks it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kunits.llm.common import written

#: N-grams in a profile, and documents of each language that its profile is learned from at most (those whose ids have the least hashes).
SIZE, PER_LANGUAGE = 300, 4_000
LONGEST = 3
FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"
#: Ids of the sample that are broadcast at most; more are joined by shuffling.
BROADCAST_IDS = 1_000_000
#: Code points of a text that are counted at once.
CHUNK = 1 << 20
_BITS = 21  # of a code point
_DENSE = 1 << 21  # largest table of counts by n-gram
_COUNTS = "lang string, gram long, n long"
_JUDGED = "doc_id long, lang_pred string, score double"


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _counted(at: np.ndarray, new: int) -> tuple[np.ndarray, np.ndarray]:
    """N-grams that end in the last *new* places of *at* (code points, 0 between words), and their counts."""
    seen = np.bincount(at)
    letters = np.flatnonzero(seen)
    place = np.zeros(len(seen), np.int64)
    place[letters] = np.arange(1, len(letters) + 1)
    base = len(letters) + 1
    ids = place[at]
    gap = at == 0
    last, middle, first = ids[-new:], ids[-new - 1 : -1], ids[-new - 2 : -2]
    g1 = last[~gap[-new:]] * base * base
    two = ~(gap[-new:] & gap[-new - 1 : -1])
    three = ~gap[-new - 1 : -1]  # a gap within is two words
    g2 = (middle * base + last)[two] * base
    g3 = ((first * base + middle) * base + last)[three]
    keys = np.concatenate([g1, g2, g3])
    if base**3 <= max(_DENSE, 4 * len(keys)):
        table = np.bincount(keys)
        found = np.flatnonzero(table)
        n = table[found]
    else:
        found, n = np.unique(keys, return_counts=True)
    back = np.concatenate([[0], letters + 1])  # gaps are 1, so that an n-gram sorts behind its beginnings
    packed = back[found // (base * base)] << 2 * _BITS | back[found // base % base] << _BITS | back[found % base]
    return packed, n


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The letter n-grams of a text in ascending order, and their counts.

    Words are maximal runs of letters in lower case, with a mark at both ends;
    n-grams have one to three places, lie within a word and aren't the mark
    alone. An n-gram is packed into 63 bits: code points plus one, the mark as 1.
    """
    lower = text.lower()
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    tail = np.zeros(2, np.int64)  # what precedes: gaps
    for start in range(0, len(lower), CHUNK):
        code = np.frombuffer(lower[start : start + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        letter = _is_letter()[code]
        follows = np.concatenate([[tail[-1] > 0], letter[:-1]])
        keep = letter | follows  # of a run between words its first place
        code[~letter] = 0
        part = code[keep]
        if len(part):
            at = np.concatenate([tail, part])
            parts.append(_counted(at, len(part)))
            tail = at[-2:]
    if len(lower) and tail[-1]:  # the last word's end
        parts.append(_counted(np.concatenate([tail, [0]]), 1))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return merged(parts)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    found, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return found, np.bincount(where, np.concatenate([n for _, n in parts]), len(found)).astype(np.int64)


def shown(gram: int) -> str:
    """A packed n-gram as text, with ``_`` for the mark."""
    places = [gram >> 2 * _BITS, gram >> _BITS & (1 << _BITS) - 1, gram & (1 << _BITS) - 1]
    return "".join("_" if p == 1 else chr(p - 1) for p in places if p)


def top(keys: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """The *size* most frequent n-grams, ties in ascending order of the n-gram."""
    if len(n) > 4 * size:
        least = np.partition(n, len(n) - size)[len(n) - size]
        keys, n = keys[n >= least], n[n >= least]
    return keys[np.argsort(-n, kind="stable")[:size]]


@dataclass(frozen=True)
class Profiles:
    """Profiles of all languages: each n-gram's entries (language and rank), n-gram by n-gram."""

    languages: tuple[str, ...]
    size: int
    grams: np.ndarray
    starts: np.ndarray
    of: np.ndarray
    ranks: np.ndarray

    @classmethod
    def of_lists(cls, lists: dict[str, list[int]], size: int) -> Profiles:
        languages = tuple(sorted(lists))
        rows = sorted((g, i, rank) for i, name in enumerate(languages) for rank, g in enumerate(lists[name]))
        flat = np.array(rows, np.int64).reshape(-1, 3)
        found, starts = np.unique(flat[:, 0], return_index=True)
        return cls(languages, size, found, np.append(starts, len(flat)), flat[:, 1], flat[:, 2])

    def distances(self, listed: np.ndarray) -> np.ndarray:
        """Out-of-place distance of a document's profile to each language."""
        far = np.full(len(self.languages), float(self.size * len(listed)))
        if not len(self.grams) or not len(listed):
            return far
        at = np.minimum(np.searchsorted(self.grams, listed), len(self.grams) - 1)
        here = np.flatnonzero(self.grams[at] == listed)
        first, n = self.starts[at[here]], self.starts[at[here] + 1] - self.starts[at[here]]
        entries = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        near = self.size - np.abs(self.ranks[entries] - np.repeat(here, n))
        return far - np.bincount(self.of[entries], near, len(self.languages))

    def judge(self, text: str | None) -> tuple[str, float]:
        """The nearest language (of several, the first by name), and by which share the next one is farther."""
        keys, n = grams(text or "")
        if not len(keys) or not self.languages:
            return UNKNOWN, 0.0
        listed = top(keys, n, self.size)
        far = self.distances(listed)
        best = int(np.argmin(far))
        others = np.delete(far, best)
        second = float(others.min()) if len(others) else float(self.size * len(listed))
        return self.languages[best], (second - float(far[best])) / second if second else 0.0


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def learning_sample(documents: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, text of at most *per_language* ids of each language outside the held-out fold.

    Ids are chosen without reading texts: those of the least hashes, from a
    share of the ids that is first cut by hash to a few times the wanted ones.
    Rows of an id are one, with the least text.
    """
    base = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    base = base.where("doc_id is not null and lang is not null and text is not null").where(~held_out(F.col("doc_id")))
    ids = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang")).where("doc_id is not null and lang is not null").where(~held_out(F.col("doc_id")))
    sizes = ids.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("ids"))
    chance = F.xxhash64("doc_id").cast("double") / F.lit(2.0**64) + 0.5
    few = ids.join(sizes, "lang").where(chance * F.col("ids") <= 4 * per_language).select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).distinct()
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = written(few.withColumn("nth", nth).where(F.col("nth") <= per_language).select("lang", "doc_id"), "profile-ids")
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_IDS else chosen
    return base.join(chosen, ["lang", "doc_id"], "left_semi").groupBy("lang", "doc_id").agg(F.min("text").alias("text")).select("lang", "text")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            by: dict[str, list] = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(grams(text))
            for lang, parts in by.items():
                keys, n = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], ["lang", "gram", "n"])


def learn(documents: DataFrame, size: int = SIZE, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles of all languages that rows outside the held-out fold name.

    Rows with a null id, text or language teach nothing; a language whose
    texts have no letter has an empty profile. The driver gets *size* n-grams
    a language.
    """
    sample = learning_sample(documents, per_language, id_col, text_col, lang_col)
    counted = sample.mapInArrow(_count, _COUNTS).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = counted.withColumn("rank", order).where(F.col("rank") <= size).orderBy("lang", "rank")
    lists: dict[str, list[int]] = {}
    for r in best.collect():
        lists.setdefault(r.lang, []).append(r.gram)
    return Profiles.of_lists(lists, size)


def identify(documents: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of *documents*.

    Whole texts are counted. ``und`` with score 0 where the text is null or
    has no letter, or no language was learned; a text without any learned
    n-gram goes to the first language by name with score 0. The score is the
    share by which the next language is farther. A null id isn't held out;
    repeated rows are judged each; other columns don't matter. No shuffle.
    """
    shared = documents.sparkSession.sparkContext.broadcast(profiles)  # *size* n-grams a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            said = [known.judge(t) for at in range(0, batch.num_rows, 256) for t in batch.column(1).slice(at, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in said], pa.string()), pa.array([s for _, s in said], pa.float64())], ["doc_id", "lang_pred", "score"])

    judged = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _JUDGED)
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
