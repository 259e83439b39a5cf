"""Substring deduplication with difference-cover anchors.

A window of 20 words goes if the same words start earlier. Hashing all windows
is avoided: words are hashed in short anchors, and only at positions whose
remainder modulo a period is in a difference cover. For any two positions the
cover has a shift that puts both on it, so two equal windows share an aligned
anchor. Anchors that occur once are settled; around the others the whole
windows are hashed (96 bits), and the least (document, start) of each hash
stays.

Hashes travel in packed blocks: each task first combines its own equal hashes,
so a passage that fills a third of the corpus costs one entry per task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kunits.llm.common import lean

WINDOW = 20
#: A perfect difference cover: every remainder modulo 13 is a difference of two of these (fixed values).
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Words hashed together in a task; anchors that a bucket should hold.
CHUNK, BUCKET = 1_000_000, 1_000_000
#: Bytes of text whose documents' repeats are put together in a task.
PART = 64_000_000
LATE = 2**63 - 1  # the document id that stands for null
#: Word hashes that a worker keeps.
KEPT_HASHES = 150_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Hashes(dict):
    """64-bit hashes of words; bounded by clearing."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT_HASHES:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_hashes = _Hashes()


def forget() -> None:
    _hashes.clear()


def words(text: str | None) -> list[bytes]:
    """Runs of other than space and ``\\t\\n\\v\\f\\r``."""
    return (text or "").encode().split()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M2
    return h ^ (h >> np.uint64(29))


def _rolled(h: np.ndarray, at: np.ndarray, size: int, factor: np.uint64) -> np.ndarray:
    """Hashes of the *size* words from each position of *at*."""
    out = np.zeros(len(at), np.uint64)
    for i in range(size):
        out = out * factor + h[at + i]
    return _mixed(out)


def _chunks(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(rows of the chunk as lists of columns but the text, words of each row, hashes of all words)."""
    rows: list[tuple] = []
    counts: list[int] = []
    hashed: list[np.ndarray] = []
    held = 0
    for batch in batches:
        others = [batch.column(i) for i in range(batch.num_columns) if i != text_at]
        for i in range(batch.num_rows):
            w = words(batch.column(text_at)[i].as_py())
            rows.append(tuple(c[i].as_py() for c in others))
            counts.append(len(w))
            hashed.append(np.fromiter(map(_hashes.__getitem__, w), np.uint64, len(w)))
            held += len(w)
            if held >= CHUNK:
                yield rows, np.array(counts, np.int64), np.concatenate(hashed)
                rows, counts, hashed, held = [], [], [], 0
    if rows:
        yield rows, np.array(counts, np.int64), np.concatenate(hashed)


def _places(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and position within it of each word."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


_PACKED = "bucket int, docs binary, marks binary, sizes binary, keys binary, places binary"
_NAMES = ["bucket", "docs", "marks", "sizes", "keys", "places"]
_REPLY = "part int, docs binary, marks binary, sizes binary, places binary"
_RUNS = "doc long, mark long, runs binary"
_ANCHOR, _LONG = np.dtype("<u4"), np.dtype([("a", "<u8"), ("b", "<u4")])


def _pack(bucket: int, docs: np.ndarray, marks: np.ndarray, row: np.ndarray, place: np.ndarray, keys: np.ndarray) -> tuple:
    """One packed block; *row* must be in order."""
    seen, sizes = np.unique(row, return_counts=True)
    return (bucket, docs[seen].astype("<i8").tobytes(), marks[seen].astype("<i8").tobytes(), sizes.astype("<i4").tobytes(), keys.tobytes(), place.astype("<i4").tobytes())


def _blocks(deal: np.ndarray, buckets: int, docs: np.ndarray, marks: np.ndarray, row: np.ndarray, place: np.ndarray, keys: np.ndarray) -> Iterator[tuple]:
    """Packed blocks of entries, dealt by a hash."""
    bucket = ((deal >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    for some in np.split(order, _edges(bucket[order])[1:]):  # the buckets that occur, however many there are
        if len(some):
            yield _pack(int(bucket[some[0]]), docs, marks, row[some], place[some], keys[some])


def _settled(buckets: int, docs: np.ndarray, marks: np.ndarray, row: np.ndarray, place: np.ndarray, keys: np.dtype) -> Iterator[tuple]:
    """Packed blocks of entries that pass the reducers as they are, spread over further buckets."""
    for at in range(0, len(row), 100_000):
        some = slice(at, at + 100_000)
        yield _pack(buckets + int(docs[row[at]] + at) % buckets, docs, marks, row[some], place[some], np.empty(0, keys))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i else pa.int32()) for i, c in enumerate(columns)], _NAMES)


def _unpacked(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    docs = np.frombuffer(b"".join(group.docs), "<i8")
    marks = np.frombuffer(b"".join(group.marks), "<i8")
    sizes = np.frombuffer(b"".join(group.sizes), "<i4")
    return np.repeat(docs, sizes), np.repeat(marks, sizes), np.frombuffer(b"".join(group.places), "<i4")


def _edges(*keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal keys."""
    if not len(keys[0]):
        return np.empty(0, int)
    return np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])


def _replies(doc: np.ndarray, mark: np.ndarray, place: np.ndarray, parts: int) -> pd.DataFrame:
    """Places by document, packed in a row for each part of the documents."""
    part = (_mixed(doc.astype(np.uint64)) % np.uint64(parts)).astype(np.int32)
    order = np.lexsort((place, mark, doc, part))
    part, doc, mark, place = part[order], doc[order], mark[order], place[order].astype("<i4")
    rows = []
    cuts = np.r_[_edges(part), len(part)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        heads = _edges(doc[a:b], mark[a:b])
        sizes = np.diff(np.r_[heads, b - a]).astype("<i4")
        rows.append((part[a], doc[a:b][heads].tobytes(), mark[a:b][heads].tobytes(), sizes.tobytes(), place[a:b].tobytes()))
    return pd.DataFrame(rows, columns=["part", "docs", "marks", "sizes", "places"])


def _runs_of(back: int):
    """Merges the places of a part's documents to runs (first, last); each place reaches *back* before it."""

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        doc, mark, place = _unpacked(group)
        order = np.lexsort((place, mark, doc))
        doc, mark, last = doc[order], mark[order], place[order].astype(np.int64)
        first = np.maximum(last - back, 0)
        fresh = np.zeros(len(doc), bool)
        fresh[_edges(doc, mark)] = True
        fresh[1:] |= first[1:] > last[:-1] + 1
        at = np.flatnonzero(fresh)
        runs = np.stack([first[at], last[np.r_[at[1:], len(doc)] - 1]], axis=1).astype("<i4") if len(at) else np.empty((0, 2), "<i4")
        doc, mark = doc[at], mark[at]
        heads = _edges(doc, mark)
        rows = [(doc[a], mark[a], runs[a:b].tobytes()) for a, b in zip(heads, np.r_[heads[1:], len(doc)].astype(int), strict=True)]
        return pd.DataFrame(rows, columns=["doc", "mark", "runs"])

    return merge


def _anchor_stage(buckets: int, parts: int, window: int):
    """Places of anchors that occur more than once (a few others may pass)."""
    size = window - PERIOD + 1
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True

    @lean(forget)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, counts, h in _chunks(batches, 2):
            docs, marks = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
            row, place = _places(counts)
            at = np.flatnonzero(cover[place % PERIOD] & (place <= counts[row] - size))
            key = _rolled(h, at, size, _M1)
            row, place = row[at], place[at]
            _, first, inverse, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            twice, first = np.flatnonzero(times[inverse] > 1), np.sort(first)
            out = list(_settled(buckets, docs, marks, row[twice], place[twice], _ANCHOR))
            out += _blocks(key[first], buckets, docs, marks, row[first], place[first], key[first].astype(_ANCHOR))
            yield _batch(out)

    def reduce(group: pd.DataFrame) -> pd.DataFrame:
        doc, mark, place = _unpacked(group)
        if group.bucket.iloc[0] < buckets:
            _, inverse, times = np.unique(np.frombuffer(b"".join(group["keys"]), _ANCHOR), return_inverse=True, return_counts=True)
            many = times[inverse] > 1
            doc, mark, place = doc[many], mark[many], place[many]
        return _replies(doc, mark, place, parts)

    return run, reduce


def _later(doc: np.ndarray, place: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries that come after the least (document, place) of their key, the least ones), as indices in order."""
    order = np.lexsort((place, doc, keys["b"], keys["a"]))
    a, b, d, p = keys["a"][order], keys["b"][order], doc[order], place[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.empty(0, bool)
    head = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0)) if len(a) else np.empty(0, int)
    after = (d != d[head]) | (p != p[head])
    return np.sort(order[after]), np.sort(order[~after])


def _window_stage(buckets: int, parts: int, window: int):
    """Starts of windows whose words also start earlier."""

    @lean(forget)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, counts, h in _chunks(batches, 2):
            docs, marks = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
            base = np.cumsum(counts) - counts
            near = np.zeros(len(h) + 1, np.int32)
            for (_, _, runs, *_), n, low in zip(rows, counts, base, strict=True):
                runs = np.frombuffer(runs, "<i4").astype(np.int64)
                np.add.at(near, low + runs[::2], 1)
                np.add.at(near, low + np.minimum(runs[1::2] + 1, n), -1)
            row, place = _places(counts)
            at = np.flatnonzero((np.cumsum(near[:-1]) > 0) & (place <= counts[row] - window))
            keys = np.empty(len(at), _LONG)
            keys["a"] = deal = _rolled(h, at, window, _M1)
            keys["b"] = _rolled(_mixed(h ^ _M1), at, window, _M2) >> np.uint64(32)
            row, place = row[at], place[at]
            later, least = _later(docs[row], place, keys)
            out = list(_settled(buckets, docs, marks, row[later], place[later], _LONG))
            out += _blocks(deal[least], buckets, docs, marks, row[least], place[least], keys[least])
            yield _batch(out)

    def reduce(group: pd.DataFrame) -> pd.DataFrame:
        doc, mark, place = _unpacked(group)
        if group.bucket.iloc[0] < buckets:
            later, _ = _later(doc, place, np.frombuffer(b"".join(group["keys"]), _LONG))
            doc, mark, place = doc[later], mark[later], place[later]
        return _replies(doc, mark, place, parts)

    return run, reduce


def kept_text(text: str, runs: np.ndarray, window: int = WINDOW) -> tuple[str, int, int]:
    """(text without the words of windows that start in the runs, words before, words removed)."""
    raw = text.encode()
    spans = [m.span() for m in _RUN.finditer(raw)]
    cover = np.zeros(len(spans) + 1, np.int32)
    np.add.at(cover, runs[:, 0], 1)
    np.add.at(cover, runs[:, 1] + window, -1)
    gone = np.cumsum(cover[:-1]) > 0
    kept = np.flatnonzero(~gone)
    if not len(kept):
        return "", len(spans), len(spans)
    cuts = np.flatnonzero(np.diff(kept) > 1)
    runs = zip(np.r_[kept[0], kept[cuts + 1]], np.r_[kept[cuts], kept[-1]], strict=True)
    return b" ".join(raw[spans[a][0] : spans[b][1]] for a, b in runs).decode(), len(spans), int(gone.sum())


_RUN = re.compile(rb"[^\x20\x09-\x0D]+")


def remove_repeats(documents: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", n_words: str = "n_words", n_removed: str = "n_removed") -> DataFrame:
    """The rows of *documents* with the repeated words cut out of their texts.

    All columns stay; *n_words* and *n_removed* are added (replaced, if there).
    A text without repeats is unchanged; in others the words between cuts keep
    their white space and a cut leaves one space. A null text stays null, with
    no words. A null id comes after all others. Rows that repeat an id are
    judged each, by (id, start): equal places aren't earlier than each other.
    """
    if window < PERIOD:
        raise ValueError(f"windows of fewer than {PERIOD} words have no aligned anchor")
    doc, mark, text = F.coalesce(F.col(id_col).cast("long"), F.lit(LATE)), F.xxhash64(F.col(text_col)), F.col(text_col)
    size = documents.agg(F.sum(F.octet_length(text_col)).alias("n")).head().n or 0
    buckets = max(8, int(size / 6 * len(COVER) / PERIOD / BUCKET))  # about six bytes a word
    parts = max(8, int(size / PART))
    rest = [c for c in documents.columns if c not in (text_col, n_words, n_removed)]
    packed = documents.select(doc.alias("doc"), mark.alias("mark"), text.alias("text"), F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in rest)).alias("rest"))
    run, reduce = _anchor_stage(buckets, parts, window)
    anchors = packed.select("doc", "mark", "text").mapInArrow(run, _PACKED).groupBy("bucket").applyInPandas(reduce, _REPLY)
    anchors = anchors.groupBy("part").applyInPandas(_runs_of(PERIOD - 1), _RUNS)
    # Both joins take the same columns, so that Spark shuffles the texts once; with the mark of the text
    # among the keys, rows without an id are dealt by their texts.
    asked = packed.join(anchors, ["doc", "mark"]).select("doc", "mark", "text", "runs", "rest")
    run, reduce = _window_stage(buckets, parts, window)
    found = asked.mapInArrow(run, _PACKED).groupBy("bucket").applyInPandas(reduce, _REPLY)
    found = found.groupBy("part").applyInPandas(_runs_of(0), _RUNS)

    schema = T.StructType([packed.schema["rest"], T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    @lean(forget)
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: list[tuple[str | None, int, int]] = []
                for text, runs in zip(part.column("text").to_pylist(), part.column("runs").to_pylist(), strict=True):
                    out.append(kept_text(text, np.frombuffer(runs, "<i4").reshape(-1, 2), window) if runs else (text, len(words(text)), 0))
                texts, before, gone = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("rest"), pa.array(texts, pa.string()), pa.array(before, pa.int64()), pa.array(gone, pa.int64())], ["rest", "text", "n_words", "n_removed"])

    done = packed.join(found, ["doc", "mark"], "left").select("text", "runs", "rest").mapInArrow(cut, schema)
    columns = [F.col("text").alias(text_col) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in documents.columns if c not in (n_words, n_removed)]
    return done.select(*columns, F.col("n_words").alias(n_words), F.col("n_removed").alias(n_removed))
