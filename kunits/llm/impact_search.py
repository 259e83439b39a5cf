"""Ranked lexical search over a two-level quantised index.

Level one holds, for each term of a document, its impact rounded up to a byte;
level two holds exact counts. Bytes give an upper and a lower bound of every
score. An item's k-th largest lower bound is its threshold, and documents
whose upper bound reaches it are rescored exactly, in integers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kunits.llm.common import written

TOP = 20
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Impacts are below ONE / 1000; a byte counts steps of STEP, rounded up, and is stored less 128.
ONE, TF_PART, LENGTH_PART = 1_000_000_000, 1000, 12
STEP = -(-ONE // TF_PART // 255)
#: Terms that tasks get to filter by at most (else all are indexed), and terms of items that are searched at once.
VOCABULARY, QUERY_BLOCK = 1_000_000, 200_000
#: Sums of (document, item) and their addends that a task holds at once.
CELLS, ADDENDS = 2_000_000, 1_000_000
_LONG_TEXT = 1 << 20
_RAW = "doc_id long, n long, terms array<string>, tfs array<long>"


def term_counts(text: str | None) -> Counter[str]:
    """Terms of a whole text with A-Z in lower case, and how often each occurs."""
    text = text or ""
    said = Counter(TERM.findall(text) if len(text) <= _LONG_TEXT else (m[0] for m in TERM.finditer(text)))
    found: Counter[str] = Counter()
    for term, n in said.items():
        found[term.translate(_LOWER)] += n
    return found


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, term, times. Rows that repeat an item count once; other texts of the same item are added to it."""
    kind = items.schema[id_col].dataType
    distinct = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).where("text is not null").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = [term_counts(t) for t in batch.column(1).to_pylist()]
            repeat = np.repeat(np.arange(batch.num_rows), [len(c) for c in counted])
            terms, times = pa.array([t for c in counted for t in c], pa.string()), pa.array([n for c in counted for n in c.values()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(repeat)), terms, times], ["item", "term", "times"])

    schema = T.StructType([T.StructField("item", kind), T.StructField("term", T.StringType()), T.StructField("times", T.LongType())])
    return distinct.mapInArrow(run, schema).groupBy("item", "term").agg(F.sum("times").alias("times"))


@dataclass(frozen=True)
class Index:
    """A row for each document: doc_id, n, terms with their impacts (level one) and counts (level two)."""

    table: DataFrame
    n_documents: int
    n_terms: int

    def frequencies(self) -> DataFrame:
        """term, df: documents that hold the term."""
        return self.table.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def build(documents: DataFrame, terms: set[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Index every row of *documents*; with *terms*, only those are kept of each row (its length counts all).

    The statistics that impacts need cover all documents, so counts are
    written first and impacts derived from them.
    """
    shared = documents.sparkSession.sparkContext.broadcast(terms)  # no more than VOCABULARY, see search

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lengths, kept = [], []
                for text in part.column(1).to_pylist():
                    found = term_counts(text)
                    lengths.append(found.total())
                    kept.append(found if wanted is None else {t: n for t, n in found.items() if t in wanted})
                lists = [pa.array([list(k) for k in kept], pa.list_(pa.string())), pa.array([list(k.values()) for k in kept], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    base = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    raw = written(base.mapInArrow(run, _RAW), "term-counts")
    size = raw.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    tf = f"transform(tfs, tf -> cast((({ONE}L * tf) div ({TF_PART}L * tf + {LENGTH_PART}L * m) + {STEP - 1}) div {STEP} - 128 as tinyint))"
    m = f"75L + (25L * n * {size.documents}L) div {max(size.terms, 1)}L"
    table = raw.where("size(terms) > 0").withColumn("m", F.expr(m)).select("doc_id", "m", "terms", F.expr(tf).alias("impacts"), "tfs")
    return Index(written(table, "impacts"), size.documents, size.terms)


@dataclass(frozen=True)
class Weights:
    """Weights of a block of items, term by term; what a task needs to score documents."""

    items: list
    terms: pa.Array
    starts: np.ndarray
    item: np.ndarray
    weight: np.ndarray

    @classmethod
    def of_rows(cls, rows: list[tuple]) -> Weights:
        """From (item, term, weight)."""
        items = list(dict.fromkeys(r[0] for r in rows))
        number = {x: i for i, x in enumerate(items)}
        placed = sorted((term, number[x], w) for x, term, w in rows)
        terms = list(dict.fromkeys(p[0] for p in placed))
        sizes = Counter(p[0] for p in placed)
        starts = np.concatenate([[0], np.cumsum([sizes[t] for t in terms])]).astype(np.int64)
        return cls(items, pa.array(terms, pa.string()), starts, np.array([p[1] for p in placed], np.int64), np.array([p[2] for p in placed], np.int64))

    def slices(self, batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """Bounded parts of a batch: first row, rows, and for each addend its cell (row by item), entry and posting.

        Postings are places in the flat lists of the whole batch.
        """
        lists = batch.column("terms")
        known = np.asarray(pc.fill_null(pc.index_in(lists.flatten(), value_set=self.terms), -1), np.int64)
        offsets = np.asarray(lists.offsets, np.int64) - lists.offsets[0].as_py()
        fan = np.where(known >= 0, self.starts[known + 1] - self.starts[known], 0)
        before = np.concatenate([[0], np.cumsum(fan)])[offsets]  # addends before each row
        rows, start = max(1, CELLS // len(self.items)), 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(before, before[start] + ADDENDS, "right")) - 1
            stop = min(max(stop, start + 1), start + rows, batch.num_rows)  # a row has no more addends than the block has weights
            here = np.arange(offsets[start], offsets[stop])
            here = here[fan[here] > 0]
            n = fan[here]
            entry = np.repeat(self.starts[known[here]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            posting = np.repeat(here, n)
            row = np.searchsorted(offsets, posting, "right") - 1 - start
            yield start, stop - start, row * len(self.items) + self.item[entry], entry, posting
            start = stop

    def bounds(self, impacts: np.ndarray, rows: int, cells: np.ndarray, entry: np.ndarray, posting: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all scores in steps, a row for each document and a column for each item."""
        byte, weight = impacts[posting] + 128.0, self.weight[entry]
        upper = np.bincount(cells, byte * weight, rows * len(self.items))
        lower = np.bincount(cells, np.maximum(byte - 1, 0) * weight, rows * len(self.items))
        return lower.reshape(rows, -1), upper.reshape(rows, -1)


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(batch.column(name).flatten(), np.int64)


def thresholds(index: Index, block: Broadcast[Weights], k: int) -> np.ndarray:
    """The k-th largest lower bound of each item of a block; 0 where fewer documents have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = block.value
        best = np.zeros((k, len(weights.items)))
        for batch in batches:
            impacts = _flat(batch, "impacts")
            for _, rows, *found in weights.slices(batch):
                both = np.concatenate([best, weights.bounds(impacts, rows, *found)[0]])
                best = np.partition(both, len(both) - k, axis=0)[-k:]
        place, item = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(best[place, item])], ["item", "lower"])

    lower = index.table.select("terms", "impacts").mapInArrow(run, "item int, lower double")
    nth = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("lower")))
    found = np.zeros(len(block.value.items))
    for r in lower.withColumn("nth", nth).where(F.col("nth") <= k).where(F.col("nth") == k).select("item", "lower").collect():  # one row an item of the block
        found[r.item] = r.lower
    return found


def rescored(index: Index, block: Broadcast[Weights], least: np.ndarray) -> DataFrame:
    """item (its place in the block), doc_id, score of every document whose upper bound reaches the item's threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = block.value
        for batch in batches:
            impacts, tfs = _flat(batch, "impacts"), _flat(batch, "tfs")
            m = np.asarray(batch.column("m"), np.int64)
            offsets = np.asarray(batch.column("terms").offsets, np.int64)
            length = np.repeat(m, np.diff(offsets))
            for start, rows, cells, entry, posting in weights.slices(batch):
                upper = weights.bounds(impacts, rows, cells, entry, posting)[1]
                asked = ((upper >= least) & (upper > 0)).ravel()
                mine = asked[cells]
                at, e, p = cells[mine], entry[mine], posting[mine]
                exact = (ONE * tfs[p]) // (TF_PART * tfs[p] + LENGTH_PART * length[p])
                score = np.zeros(rows * len(weights.items), np.int64)
                np.add.at(score, at, weights.weight[e] * exact)
                hit = np.flatnonzero(score > 0)
                ids = batch.column("doc_id").take(pa.array(start + hit // len(weights.items)))
                yield pa.RecordBatch.from_arrays([pa.array(hit % len(weights.items), pa.int32()), ids, pa.array(score[hit])], ["item", "doc_id", "score"])

    return index.table.mapInArrow(run, "item int, doc_id long, score long")


def search(documents: DataFrame, items: DataFrame, k: int = TOP, item_col: str = "item_id", item_text: str = "text", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's *k* best documents with a score above 0.

    Equal scores rank by ascending doc_id, null ids last. Null and empty texts
    have no terms: such documents are found by no item and aren't counted,
    such items find none. Repeated documents are documents each; repeated
    rows of an item count once, different texts of one item_id are one item.
    Other columns don't matter. Items are searched in blocks, each against
    all rows; a document longer than others only takes a slice of its own.
    """
    spark = documents.sparkSession
    asked = written(item_terms(items, item_col, item_text), "item-terms")
    distinct = asked.select("term").distinct()
    few = distinct.count() <= VOCABULARY
    index = build(documents, {r.term for r in distinct.collect()} if few else None, id_col, text_col)
    ratio = F.lit(2.0 * index.n_documents + 2.0) / (2.0 * F.col("df") + 1.0)
    weight = F.floor(F.lit(1000.0) * F.log(ratio)).cast("long")
    weighed = written(asked.join(index.frequencies(), "term").select("item", "term", (F.col("times") * weight).alias("weight")).where("weight > 0"), "item-weights")
    blocks = -(-weighed.count() // QUERY_BLOCK)
    kind = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", items.schema[item_col].dataType)])
    scored = [spark.createDataFrame([], T.StructType([kind["item_id"], *T.StructType.fromDDL("doc_id long, score long").fields]))]
    for i in range(blocks):
        rows = [tuple(r) for r in weighed.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i).collect()]  # about QUERY_BLOCK, or one item
        if not rows:
            continue
        weights = Weights.of_rows(rows)
        block = spark.sparkContext.broadcast(weights)
        found = rescored(index, block, thresholds(index, block, k))
        names = F.broadcast(spark.createDataFrame(list(enumerate(weights.items)), kind))
        scored.append(found.join(names, "item").select("item_id", "doc_id", "score"))
    whole = scored[0]
    for part in scored[1:]:
        whole = whole.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return whole.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
