"""Pruned exact search against the search of all blocks; timers of streams."""

from __future__ import annotations

import time
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest

from kunits.operators import pivots, vectors
from kunits.session import Scratch

VECTORS = "id long, label int, vector array<double>, score string"


def _clusters(n: int, seed: int = 0) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, 6))
    return [(i, i % 2, (centres[i % 12] + 0.03 * rng.standard_normal(6)).tolist(), "own") for i in range(n)]


ODD = [(900, 0, None, "x"), (901, 0, [0.0] * 6, "x"), (902, 0, [1.0, 2.0], "x"), (903, 1, [None, 1.0, 1.0, 1.0, 1.0, 1.0], "x"), (904, 1, [1e200, 0.0, 0.0, 0.0, 0.0, 0.0], "x")]


def _rows(df) -> list[tuple]:
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("filters", [None, ["label"]])
def test_pruned_search_is_the_whole_search(spark, filters):
    rows = _clusters(360)
    rows += [(i, row[1], row[2], "own") for i, row in zip((700, 701, 702, 703), rows, strict=False)]  # copies: ties
    index = spark.createDataFrame(rows + ODD[:4], VECTORS)
    query = index.where("id % 10 = 0 or id >= 900")
    found, told = pivots.top_k_cosine_pruned(index, query, 5, filters=filters, index_block=40, query_block=7)
    assert _rows(found) == _rows(vectors.top_k_cosine_many(index, query, 5, filters=filters))
    lost = 4 * index.count()  # queries without a direction meet every row
    assert told["all"] == query.count() * index.count() and told["compared"] - lost < told["all"] / 2


def test_pruned_search_of_few_rows(spark):
    index = spark.createDataFrame(_clusters(4) + ODD, VECTORS)
    found, told = pivots.top_k_cosine_pruned(index, index.where("id in (0, 901, 904)"), 20)
    by: dict[int, list] = {}
    for r in found.collect():
        by.setdefault(r.query_id, []).append(r)
    assert {q: len(r) for q, r in by.items()} == {0: 8, 901: 8, 904: 8}  # all but itself
    assert all(r.score == 0 for r in by[901])
    assert told["compared"] <= told["all"]
    none = index.where("false")
    assert pivots.top_k_cosine_pruned(none, none, 3)[0].count() == 0
    assert pivots.top_k_cosine_pruned(index, none, 3)[0].count() == 0
    flat = index.where("id in (900, 901)")
    assert _rows(pivots.top_k_cosine_pruned(flat, flat, 3)[0]) == [(900, 1, 901, 0.0), (901, 1, 900, 0.0)]


class _Counted(Scratch):
    """Scratch that notes how many rows each table has."""

    def stored(self, df, name):
        back = super().stored(df, name)
        self.rows = {**getattr(self, "rows", {}), name: back.count()}
        return back


@pytest.mark.parametrize("block", [20_000, 50])
def test_queries_go_to_parts_not_to_cells(spark, block):
    """A query's vector is written once a part of the index, however many cells it looks in there."""
    rng = np.random.default_rng(1)
    index = spark.createDataFrame([(i, i % 2, rng.standard_normal(16).tolist(), "x") for i in range(400)], VECTORS)
    query, kept = index.where("id % 10 = 0"), _Counted(spark)
    found, told = pivots.top_k_cosine_pruned(index, query, 5, index_block=block, scratch=kept)
    assert _rows(found) == _rows(vectors.top_k_cosine_many(index, query, 5))
    assert told["compared"] > told["all"] / 2  # so nearly all cells are looked in
    assert kept.rows["rest-visits"] <= query.count() * (1 if block > 400 else 16)  # parts that can't be joined hold over 50 rows together


def test_parts_of_cells():
    cells = pivots.Cells(np.eye(4), np.array([5, 25, 0, 6, 4]), np.zeros(5), np.zeros(5))
    first, spread = cells.parts(10)
    assert spread.tolist() == [1, 3, 1, 1, 1]
    held: dict[int, int] = {}
    for c, (f, n) in enumerate(zip(first.tolist(), spread.tolist(), strict=True)):
        for p in range(f, f + n):
            held[p] = held.get(p, 0) + -(-int(cells.rows[c]) // n)
    assert max(held.values()) <= 10 and sorted(held) == list(range(max(held) + 1))


def test_visits_come_in_small_batches():
    """A batch of queries that look in all cells of many parts isn't written as one."""
    rng = np.random.default_rng(2)
    found = pivots.units(pa.array(rng.standard_normal((300, 8)).tolist()), 8)
    cells = pivots.Cells(found, np.full(301, 10), np.zeros(301), np.full(301, 2.0))
    first, spread = cells.parts(10)
    schema = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.float64())), ("_part", pa.int32()), ("_cells", pa.list_(pa.int32())), ("_rows", pa.int64())])
    batch = pa.record_batch({"id": pa.array(range(200)), "v": pa.array(rng.standard_normal((200, 8)).tolist()), "bound": pa.array([2.0] * 200)})
    made = list(pivots._visits(batch, cells, first, spread, 5, 8, ["id", "v"], schema))
    assert max(b.num_rows for b in made) <= pivots.VISITS_AT_ONCE
    assert sum(b.num_rows for b in made) == 200 * 300  # all parts but that of the own cell
    assert sum(sum(b.column(4).to_pylist()) for b in made) == 200 * 3000


def test_missing_filter_columns_match_nothing(spark):
    index = spark.createDataFrame([(i, [None, 1][i % 2], [float(i), 1.0], "x") for i in range(8)], VECTORS)
    found, _ = pivots.top_k_cosine_pruned(index, index, 3, filters=["label"])
    assert _rows(found) == _rows(vectors.top_k_cosine_many(index, index, 3, filters=["label"]))


def test_vectors_as_matrix():
    odd = [[1.0, 2.0], None, [3.0], [None, 1.0], [], [4.0, 5.0]]
    assert vectors.matrix(pa.array(odd), 2).tolist() == [[1, 2], [0, 0], [0, 0], [0, 0], [0, 0], [4, 5]]
    assert vectors.matrix(pa.chunked_array([pa.array(odd).slice(1, 3), pa.array(odd).slice(4)]), 2).tolist() == [[0, 0]] * 4 + [[4, 5]]
    assert vectors.matrix(pa.array([None, []], pa.list_(pa.float64())), 0).shape == (2, 0)


def test_cells_that_may_hold_a_neighbour():
    cells = pivots.Cells(np.eye(3), np.array([5, 5, 0, 1]), np.array([0.1, 0.5, 0.0, 0.0]), np.array([0.2, 0.6, 0.0, 0.0]))
    assert cells.open_to(np.array([0.5, 0.5, 0.5]), 0.1).tolist() == [1]  # the first is too far, the third empty
    assert cells.open_to(np.array([0.5, 0.5, 0.5]), 0.3).tolist() == [0, 1]
    assert cells.open_to(np.array([0.5, 0.0, 0.5]), 0.4).tolist() == [0]  # too near the second's pivot
    assert cells.open_to(np.array([0.5, 0.5, 0.5]), 2.0).tolist() == [0, 1, 3]


def test_native_search_of_many_queries(spark, monkeypatch):
    index = spark.createDataFrame(_clusters(60), VECTORS).drop("score")
    query = index.where("id % 5 = 0")
    few = _rows(vectors.top_k_cosine(index, query, 3, filters=["label"]))
    monkeypatch.setattr(vectors, "BROADCAST_QUERIES", 3)
    assert _rows(vectors.top_k_cosine(index, query, 3, filters=["label"])) == few
    assert _rows(vectors.top_k_cosine(index, query, 3)) == _rows(vectors.top_k_cosine_many(index, query, 3))
    monkeypatch.setattr(vectors, "BROADCAST_QUERIES", 100)
    assert _rows(vectors.top_k_cosine(index, query, 3)) == _rows(vectors.top_k_cosine_many(index, query, 3))


# Timers

T0 = datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def _run(made, tmp_path, out: list) -> None:
    """Take all files that are there, in one batch each, and go on from the checkpoint."""
    sink = lambda rows, n: out.extend(tuple(r) for r in rows.collect())
    q = made.writeStream.foreachBatch(sink).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)


def _give(spark, tmp_path, rows: list[tuple], schema: str) -> None:
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))


OUTCOMES = "provider string, at timestamp, outcome string"


def test_a_cooldown_ends_by_its_timer(rocks, tmp_path):
    from kunits.streaming import timers

    spark, out = rocks, []
    stream = lambda: spark.readStream.schema(OUTCOMES).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    made = lambda: timers.cooldowns(stream(), "provider", "at", "outcome", base_ms=1000, delay="0 seconds")
    _give(spark, tmp_path, [("p", T0, "failure"), ("p", T0 + timedelta(seconds=1), "failure"), ("q", T0, "cancelled"), ("r", T0, "failure"), ("r", T0, "success")], OUTCOMES)
    _run(made(), tmp_path, out)
    assert sorted(x[:3] for x in out) == [("p", "cooling", 2), ("r", "reset", 0)]
    assert [x[3] for x in out if x[0] == "p"] == [T0 + timedelta(seconds=3)]
    out.clear()
    # Started anew from the checkpoint: no event of p comes, time passes by another provider's event.
    _give(spark, tmp_path, [("z", T0 + timedelta(seconds=20), "success")], OUTCOMES)
    _run(made(), tmp_path, out)
    assert ("p", "ended", 2, T0 + timedelta(seconds=3)) in out
    out.clear()
    # Failures still count until a success: the next cooldown is longer.
    _give(spark, tmp_path, [("p", T0 + timedelta(seconds=30), "failure"), ("z", T0 + timedelta(seconds=30), "cancelled")], OUTCOMES)
    _run(made(), tmp_path, out)
    assert [x for x in out if x[0] == "p"] == [("p", "cooling", 3, T0 + timedelta(seconds=34))]


def _run_until(made, tmp_path, out: list, rows: int) -> None:
    """A stream on processing time makes batches for ever: stop it once *rows* have come."""
    sink = lambda given, n: out.extend(tuple(r) for r in given.collect())
    q = made.writeStream.foreachBatch(sink).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    end = time.time() + 90
    while len(out) < rows and time.time() < end and q.isActive:
        time.sleep(0.3)
    q.stop()


EVENTS = "task string, at timestamp, asked string"


@pytest.mark.parametrize("idle_ms", [3_600_000, 1000])
def test_states_live_as_long_as_told(rocks, tmp_path, idle_ms):
    from kunits.streaming import timers

    spark, out = rocks, []
    stream = lambda: spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    table = {"waiting": ("running",), "running": ("stored", "failed")}
    made = lambda: timers.state_machine(stream(), "task", "asked", "at", table, idle_ms=idle_ms)
    _give(spark, tmp_path, [("a", T0, "stored"), ("a", T0 + timedelta(seconds=2), "stored"), ("a", T0 + timedelta(seconds=1), "running"), ("b", T0, "running")], EVENTS)
    _run_until(made(), tmp_path, out, 4)
    assert sorted((x[0], *x[2:]) for x in out) == [("a", "running", "stored", "stored", True), ("a", "waiting", "running", "running", True), ("a", "waiting", "stored", "waiting", False), ("b", "waiting", "running", "running", True)]
    out.clear()
    time.sleep(1.5)
    _give(spark, tmp_path, [("b", T0, "failed"), ("a", T0, "running")], EVENTS)
    _run_until(made(), tmp_path, out, 2)
    on = [("a", "stored", "running", "stored", False), ("b", "running", "failed", "failed", True)]  # goes on where it was
    anew = [("a", "waiting", "running", "running", True), ("b", "waiting", "failed", "waiting", False)]  # forgotten between
    assert sorted((x[0], *x[2:]) for x in out) == (on if idle_ms > 1000 else anew)


def test_large_search_goes_in_blocks(spark, monkeypatch):
    """beyond a number of pairs nothing is scored pair by pair in native columns; nulls match no label."""
    rows = _clusters(200) + [(i, None, [1.0] * 6, "x") for i in (300, 301)] + [(i, i % 2, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], "x") for i in range(310, 320)]
    index = spark.createDataFrame(rows, VECTORS).drop("score")
    query = index.where("id % 5 = 0")
    few = vectors.top_k_cosine(index, query, 3, filters=["label"])
    monkeypatch.setattr(vectors, "NATIVE_PAIRS", 100)
    monkeypatch.setattr(vectors, "QUERIES_AT_ONCE", 7)
    many = vectors.top_k_cosine(index, query, 3, filters=["label"])
    assert "FlatMapCoGroups" in many._jdf.queryExecution().executedPlan().toString()
    assert _rows(many) == _rows(few)
