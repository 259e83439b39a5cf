"""Nearest neighbours by an adaptive dimension scan.

Vectors are normalised, rotated by a random orthogonal matrix and assigned to
inverted lists. Within a probed list, candidates lie in column blocks; after
each block a hypothesis test on the partial distances abandons those that
can't be among the nearest but with small probability. Survivors are scored
exactly, by cosine of the original vectors in double precision.

Equal vectors are searched once: of the copies of a vector only the k + 1
least ids can be among anyone's k nearest, so the others are left out of the
lists, without loss. Lists are cut into bounded blocks by a hash of the id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kunits.llm.common import written

#: Rows that train the lists at most (those of the least hash); all rows are indexed.
SAMPLE = 65_536
#: Lists at most: sixteen of the sample's rows for each. Up to there they grow with the square root of the rows.
LISTS = SAMPLE // 16
#: Columns between two tests; strictness of the test; candidates and queries of a block.
STEP, EPSILON, BLOCK, QUERY_BLOCK, SEED = 16, 2.1, 4096, 2048, 11


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not zero, all components finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotation(size: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def _nearest_centre(rows: np.ndarray, middle: np.ndarray) -> np.ndarray:
    return np.concatenate([(rows[a : a + 2048] @ middle.T).argmax(axis=1) for a in range(0, len(rows), 2048)])


def _unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)  # no overflow in the squares
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def centres(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = SEED) -> np.ndarray:
    """Spherical k-means of unit vectors."""
    rng = np.random.default_rng(seed)
    lists = max(1, min(lists, len(sample)))
    found = sample[rng.choice(len(sample), lists, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest_centre(sample, found)
        total = np.zeros_like(found)
        np.add.at(total, near, sample)
        norm = np.linalg.norm(total, axis=1)
        empty = norm == 0
        total[empty] = sample[rng.choice(len(sample), int(empty.sum()))]
        norm[empty] = 1
        found = total / norm[:, None]
    return found


def probes_for(sample: np.ndarray, middle: np.ndarray, k: int, recall: float, queries: int = 256) -> int:
    """Lists to probe so that the sample's own k nearest are in them with this recall."""
    some = sample[:queries]
    close = some @ sample.T
    close[np.arange(len(some)), np.arange(len(some))] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(middle)
    near = np.argpartition(-close, k - 1, axis=1)[:, :k]
    home = _nearest_centre(sample, middle)
    place = np.argsort(np.argsort(-(some @ middle.T), axis=1), axis=1)
    ranks = np.take_along_axis(place, home[near], axis=1)
    return int(np.quantile(ranks, recall, method="higher")) + 1


def scan(queries: np.ndarray, columns: np.ndarray, k: int, epsilon: float = EPSILON, step: int = STEP, start: np.ndarray | None = None) -> list[np.ndarray]:
    """Candidates of each query that the tests leave; *columns* has a row for each dimension.

    For a random rotation the first d of D squared differences estimate the
    whole distance as D/d times their sum; a candidate goes as soon as that
    exceeds the k-th distance known so far by more than the test's margin.
    """
    size, count = columns.shape
    out = []
    for query in queries:
        part = np.zeros(count)
        alive = np.arange(count)
        # The k nearest of a first bunch bound the rest.
        first = min(count, max(4 * k, 64))
        known = ((columns[:, :first] - query[:, None]) ** 2).sum(axis=0)
        bound = np.partition(known, k - 1)[k - 1] if first >= k else np.inf
        for low in range(0, size, step):
            high = min(low + step, size)
            part[alive] += ((columns[low:high, alive] - query[low:high, None]) ** 2).sum(axis=0)
            if high < size:
                margin = (1 + epsilon / math.sqrt(high)) ** 2
                alive = alive[part[alive] * (size / high) <= bound * margin + 1e-9]
        if len(alive) > k:
            left = part[alive]
            alive = alive[left <= np.partition(left, k - 1)[k - 1] + 1e-9]
        out.append(alive)
    return out


def nearest(
    vectors: DataFrame, queries: Column, k: int = 5, recall: float = 0.99, lists: int = LISTS, sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found of each query row.

    *queries* is a condition on ``vec_id``; candidates are all rows but the
    query's own. Vectors that aren't usable, null ids and vectors whose length
    isn't the most frequent one take no part. Of rows that repeat an id the
    one of the greatest vector counts. There are half as many lists as the
    square root of the distinct vectors, *lists* at most, and one where a block
    holds all; as many are probed as the sample's own neighbours need for
    *recall*, 4 at least.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null").where(usable(F.col("v")))
    rows = rows.groupBy("vec_id").agg(F.max("v").alias("v"))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sizes:
        return empty
    size = sizes[0].n
    rows = rows.where(F.size("v") == size)
    # Equal vectors: the k + 1 least ids of each; the window's limit works before the shuffle too.
    own = W.partitionBy("v").orderBy("vec_id")
    kept = rows.withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= k + 1).drop("nth")
    kept = kept.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    kept = written(kept.withColumn("rep", F.col("ids")[0]), "vectors")
    count = kept.count()
    given = kept.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("v").toArrow().column("v").combine_chunks()  # bounded by *sample*
    train = given.flatten().to_numpy().reshape(len(given), size)
    n_lists = max(1, min(lists, int(math.sqrt(count) / 2), len(train))) if count > BLOCK else 1
    turn = rotation(size)
    train = _unit(train) @ turn
    middle = centres(train, n_lists)
    n_probes = min(n_lists, max(4, probes_for(train, middle, k, recall)))
    shared = spark.sparkContext.broadcast((turn, middle))  # at most lists x dimensions

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn, middle = shared.value
        for pdf in batches:
            if len(pdf):
                near = _nearest_centre(_unit(np.stack(pdf.v)) @ turn, middle)
                yield pdf.assign(list=near.astype(np.int32))[["rep", "ids", "v", "list"]]

    listed = kept.mapInPandas(assign, "rep long, ids array<long>, v array<double>, list int")
    listed = written(listed, "lists")
    # Distinct query vectors, with the query ids that have them.
    asked = rows.where(queries).select(F.col("vec_id").alias("query_id"), "v").join(kept.select("v", "rep"), "v")
    asked = written(asked.select("query_id", "rep", "v"), "queries")
    distinct = asked.groupBy("rep").agg(F.first("v").alias("v"))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn, middle = shared.value
        for pdf in batches:
            for at in range(0, len(pdf), 1024):
                some = pdf[at : at + 1024]
                near = np.argpartition(-(_unit(np.stack(some.v)) @ turn @ middle.T), n_probes - 1, axis=1)[:, :n_probes]
                yield pd.DataFrame({"rep": np.repeat(some.rep.to_numpy(), n_probes), "v": [v for v in some.v for _ in range(n_probes)], "list": near.ravel().astype(np.int32)})

    sent = written(distinct.mapInPandas(probe, "rep long, v array<double>, list int"), "sent")
    # Lists and the queries that probe them are cut into bounded blocks; each pair of blocks is a task's group.
    cuts = listed.groupBy("list").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    asks = sent.groupBy("list").agg(F.ceil(F.count("*") / F.lit(QUERY_BLOCK)).cast("int").alias("parts"))
    cuts = F.broadcast(cuts.join(asks, "list"))  # one row for each list

    def dealt(count: str) -> Column:
        return F.pmod(F.xxhash64("rep"), F.col(count)).cast("int")

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    blocked = listed.join(cuts, "list").withColumns({"block": dealt("blocks"), "part": every("parts")}).drop("blocks", "parts")
    sent = sent.join(cuts, "list").withColumns({"part": dealt("parts"), "block": every("blocks")}).drop("blocks", "parts")

    def search(key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"rep": [], "vec_id": [], "score": []})
        turn, _ = shared.value
        c = c.sort_values("rep")
        plain, ids = np.stack(c.v), list(c.ids)
        columns = np.ascontiguousarray((_unit(plain) @ turn).T)
        norms = np.sqrt((plain * plain).sum(axis=1))
        out: list[tuple[int, int, float]] = []
        asks = np.stack(q.v)
        for rep, v, left in zip(q.rep, asks, scan(_unit(asks) @ turn, columns, k + 1), strict=True):
            score = (plain[left] * v).sum(axis=1) / (norms[left] * math.sqrt((v * v).sum()))
            some = [(-s, i) for s, at in zip(score, left, strict=True) for i in ids[at]]
            out.extend((rep, i, -s) for s, i in sorted(some)[: k + 1])
        return pd.DataFrame(out, columns=["rep", "vec_id", "score"])

    found = (
        sent.groupBy("list", "block", "part").cogroup(blocked.groupBy("list", "block", "part"))
        .applyInPandas(search, "rep long, vec_id long, score double")
    )
    best = W.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).select("rep", "vec_id", "score")
    ranked = asked.select("query_id", "rep").join(found, "rep").where(F.col("query_id") != F.col("vec_id"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
