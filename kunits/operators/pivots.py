"""Exact nearest neighbours by pivots: cells that can't hold a neighbour are left out for a query.

Unit vectors are dealt to the cell of their nearest pivot; a cell knows the
least and largest distance of its vectors to its pivot. A query's own cells
give it *k* candidates and with them a bound. By the triangle inequality a
vector's distance to the query is at least the difference of their distances
to any pivot, so cells beyond the bound are left out and nothing is lost.

Cells lie in parts of a bounded number of rows. A query goes once to each part
that holds a cell it looks in, with the list of these cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kunits.operators.vectors import INDEX_BLOCK, QUERY_BLOCK, best_of_block, matrix
from kunits.session import Scratch

#: Pivots at most (they go to every task), and the cell of vectors without a direction.
PIVOTS, NOWHERE = 1024, -1
#: Distances are compared with this much slack, more than rounding adds.
SLACK = 1e-6
#: Rows whose distances from all pivots are held at a time, and rows of a batch of queries and the parts they go to.
ROWS_AT_ONCE, VISITS_AT_ONCE = 1024, 8192


@dataclass(frozen=True)
class Cells:
    """Pivots, and for each cell (the last one is NOWHERE) its rows, least and largest distance."""

    pivots: np.ndarray
    rows: np.ndarray
    near: np.ndarray
    far: np.ndarray

    def open_to(self, distances: np.ndarray, bound: float) -> np.ndarray:
        """Cells that may hold a vector within *bound* of a query at *distances* from the pivots."""
        least = np.maximum(np.maximum(distances - self.far[:-1], self.near[:-1] - distances), 0.0)
        # The cosine with a vector that has no direction counts as 0.
        return np.flatnonzero((np.append(least, np.sqrt(2.0)) <= bound + SLACK) & (self.rows > 0))

    def parts(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The first part of each cell and in how many it lies: cells beside each other share parts of *most* rows, one of more has its own."""
        first, spread = np.zeros(len(self.rows), np.int64), np.maximum(-(-self.rows // most), 1)
        number, held = 0, 0
        for c in self._chain():
            if held and held + self.rows[c] > most:
                number, held = number + 1, 0
            first[c], held = number, held + self.rows[c]
            if spread[c] > 1:
                number, held = number + spread[c], 0
        return first, spread

    def _chain(self) -> list[int]:
        """Cells in an order in which each pivot follows one that is near it; NOWHERE is the last."""
        left, chain = np.ones(len(self.pivots), bool), []
        while left.any():
            near = self.pivots @ self.pivots[chain[-1]] if chain else np.zeros(len(left))
            chain.append(int(np.where(left, near, -np.inf).argmax()))
            left[chain[-1]] = False
        return [*chain, len(self.rows) - 1]


def units(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as unit rows; those of another length, incomplete, not finite or zero are rows of zeros."""
    given = matrix(column, width)
    given[~np.isfinite(given).all(axis=1)] = 0.0
    most = np.abs(given).max(axis=1, initial=0.0)
    given = np.divide(given, most[:, None], out=np.zeros_like(given), where=most[:, None] > 0)  # squares neither overflow nor vanish
    size = np.sqrt((given * given).sum(axis=1))
    return np.divide(given, size[:, None], out=np.zeros_like(given), where=size[:, None] > 0)


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (rows @ pivots.T), 0.0))


def _chosen(index: DataFrame, width: int, most: int) -> np.ndarray:
    """Pivots: the different directions among the rows of the least hashes."""
    n = min(most, max(1, int(index.count() ** 0.5)))
    rows = index.where(F.size("v") == width).orderBy(F.xxhash64("id"), "id").limit(2 * n).select("v").toArrow()
    found = units(rows.column("v").combine_chunks(), width) if rows.num_rows else np.zeros((0, width))
    found = np.unique(np.round(found[found.any(axis=1)], 12), axis=0)[:n]
    return found / np.sqrt((found * found).sum(axis=1))[:, None] if len(found) else found


def _visits(batch: pa.RecordBatch, cells: Cells, first: np.ndarray, spread: np.ndarray, k: int, width: int, carried: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Queries with the parts they go to and their cells there: with a bound all cells within it but their own, without one their nearest cells of more than *k* rows together."""
    bound_at = batch.schema.get_field_index("bound")
    at_once = max(1, VISITS_AT_ONCE // int((first + spread).max()))
    for start in range(0, batch.num_rows, at_once):
        some = batch.slice(start, at_once)
        given = units(some.column(some.schema.get_field_index("v")), width)
        far = _distances(given, cells.pivots) if len(cells.pivots) else np.zeros((len(given), 0))
        owner, part, opened, rows = [], [], [], []
        for i in range(len(given)):
            lost = not given[i].any()
            order = np.argsort(far[i], kind="stable")
            held = np.cumsum(cells.rows[order])
            go = own = order[: int(np.searchsorted(held, k, "right")) + 1] if not lost else order[:0]
            if bound_at >= 0:
                go = np.setdiff1d(cells.open_to(far[i], np.inf if lost else some.column(bound_at)[i].as_py()), own)
            go = go[cells.rows[go] > 0]
            by: dict[int, list[int]] = {}
            for c in go.tolist():
                for p in range(int(first[c]), int(first[c] + spread[c])):
                    by.setdefault(p, []).append(c)
            owner += [i] * len(by)
            part += by
            opened += by.values()
            rows += [int(cells.rows[go].sum()) if not n else 0 for n in range(len(by))]
        columns = [some.column(some.schema.get_field_index(name)).take(pa.array(owner, pa.int64())) for name in carried]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(part, pa.int32()), pa.array(opened, schema.field("_cells").type), pa.array(rows, pa.int64())], schema=schema)


def top_k_cosine_pruned(
    index: DataFrame, query: DataFrame, k: int, vector: str = "vector", key: str = "id", filters: list[str] | None = None, most_pivots: int = PIVOTS, index_block: int = INDEX_BLOCK, query_block: int = QUERY_BLOCK, scratch: Scratch | None = None
) -> tuple[DataFrame, dict[str, int]]:
    """(query_id, id, score, rank; what was compared): exact search, the rows of ``top_k_cosine_many``.

    The second value counts pairs of a query and a row: ``compared`` of
    ``all``. How many are spared depends on the vectors: where all lie about
    equally far apart, as random ones of many dimensions do, few are. A query
    with less than *k* rows of its filter columns in its own cells, and one
    without a direction, meets every cell. Nothing grows with the pairs of a
    query and a cell but lists of numbers: vectors go to the parts that cells
    lie in (:meth:`Cells.parts`), so a dense cell takes no task whole.
    """
    scratch, names = scratch or Scratch(index.sparkSession), list(filters or [])
    if names:  # a null is equal to nothing
        index, query = index.dropna(subset=names), query.dropna(subset=names)
    own = lambda df: df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), *names)
    rows, asked = own(index), own(query)
    width = rows.unionByName(asked).agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    width = max(width, 1)
    pivots = _chosen(rows, width, most_pivots)
    kind = index.schema[key].dataType
    in_cell = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("distance", T.DoubleType())])
    placed_as = to_arrow_schema(in_cell)
    shared = index.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE)):
            given = units(batch.column(batch.schema.get_field_index("v")), width)
            some = given.any(axis=1) & bool(len(shared.value))
            far = _distances(given, shared.value) if len(shared.value) else np.zeros((len(given), 1))
            cell = np.where(some, far.argmin(axis=1), NOWHERE)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(np.where(some, far.min(axis=1), 0.0))], schema=placed_as)

    placed = scratch.stored(rows.mapInArrow(place, in_cell), "cells")
    counted = {r.cell: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("distance").alias("near"), F.max("distance").alias("far")).collect()}  # a row a pivot
    every = [*range(len(pivots)), NOWHERE]
    of = lambda name: np.array([counted[c][name] if c in counted else 0 for c in every], np.float64)
    cells = Cells(pivots, of("n").astype(np.int64), of("near"), of("far"))
    first, spread = cells.parts(index_block)
    cells_shared = index.sparkSession.sparkContext.broadcast((cells, first, spread))
    part_of = F.broadcast(index.sparkSession.createDataFrame([(c, int(f), int(n)) for c, f, n in zip(every, first, spread, strict=True)], "cell int, _first int, _spread int"))  # a row a pivot
    met = T.StructType([*asked.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_cells", T.ArrayType(T.IntegerType())), T.StructField("_rows", T.LongType())])
    met_as, carried, nowhere = to_arrow_schema(met), asked.columns, len(pivots)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _visits(batch, *cells_shared.value, k, width, carried, met_as)

    def best(x: pa.Table, y: pa.Table) -> pa.Table:
        cell, opened = x.column("cell").to_numpy(), y.column("_cells")

        def looked_at(at: int, to: int) -> np.ndarray:
            there = np.zeros((to - at, nowhere + 1), bool)
            for i, some in enumerate(opened.slice(at, to - at).to_pylist()):
                there[i, some] = True
            return there[:, cell]  # NOWHERE is the last

        return best_of_block(x, y, k, width, looked_at)

    def searched(pairs: DataFrame, name: str) -> tuple[DataFrame, int]:
        """Best rows of the cells that queries look in, and how many pairs were compared."""
        pairs = scratch.stored(pairs, f"{name}-visits")
        visits = pairs.groupBy("_part").agg(F.count("*").alias("n"), F.sum("_rows").alias("rows")).collect()  # a row a part
        dealt = F.broadcast(index.sparkSession.createDataFrame([(r["_part"], -(-r.n // query_block)) for r in visits], "_part int, _turns int"))
        share = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        a = placed.join(part_of, "cell").withColumn("_part", F.col("_first") + share("_spread")).join(dealt, "_part").select("id", "v", *names, "cell", "_part", F.explode(F.sequence(F.lit(0), F.col("_turns") - 1)).alias("_turn"))
        b = pairs.join(dealt, "_part").select("id", "v", *names, "_cells", "_part", share("_turns").alias("_turn"))
        by = [*names, "_part", "_turn"]
        found = a.groupBy(*by).cogroup(b.groupBy(*by)).applyInArrow(best, f"query_id {kind.simpleString()}, id {kind.simpleString()}, score double")
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        kept = scratch.stored(found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"), f"{name}-found")
        scratch.drop(pairs)
        return kept, sum(r.rows for r in visits)

    near, compared = searched(asked.mapInArrow(visit, met), "near")
    # A query that found fewer than k has no bound; scores and distances: d * d = 2 - 2 * score.
    bound = near.groupBy(F.col("query_id").alias("_id")).agg(F.when(F.count("*") >= k, F.sqrt(F.greatest(F.lit(2.0) - 2.0 * F.min("score"), F.lit(0.0)))).otherwise(F.lit(float("inf"))).alias("bound"))
    bounded = asked.join(bound, F.col("id") == F.col("_id"), "left").select(*asked.columns, F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    rest, more = searched(bounded.mapInArrow(visit, met), "rest")
    scratch.drop(placed)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    whole = near.unionByName(rest).withColumn("rank", rank).where(F.col("rank") <= k)
    return whole.select("query_id", F.col("id").alias(key), "score", "rank"), {"compared": int(compared + more), "all": int(cells.rows.sum() * asked.count())}
