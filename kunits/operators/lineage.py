"""Evolution of records: who replaces whom, and what the newest version of each record is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kunits.session import Scratch, parts_of

SUPERSEDES = "supersedes"


def successors(edges: DataFrame, order: str = "order") -> DataFrame:
    """id, next, n_successors: of several records that supersede one, the last by *order* and id follows it."""
    asked = edges.where(F.col("type") == SUPERSEDES).where("source is not null and target is not null")
    last = F.max(F.struct(F.col(order).alias("order"), F.col("source").alias("id")))["id"]
    distinct = asked.groupBy("target", "source").agg(F.max(order).alias(order))
    return distinct.groupBy(F.col("target").alias("id")).agg(last.alias("next"), F.count("*").alias("n_successors"))


def evolution_index(records: DataFrame, edges: DataFrame, order: str = "order", key: str = "id", scratch: Scratch | None = None) -> DataFrame:
    """id, newest, depth, cycle, n_successors for each record: its newest version by following ``supersedes`` edges.

    *edges* has source, target, type and an order: the source supersedes the
    target. ``depth`` counts the steps to the newest version, which has 0. A
    record that lies on a ring has ``cycle`` = ``on``, one whose steps end
    in a ring ``into``, others ``none``; of a ring nothing is the newest, so
    newest and depth are null. Edges to or from unknown records don't count,
    repeated records count once.

    Pointers double their reach in each round (2, 4, 8 steps), so a chain of a
    million versions takes twenty rounds and no row grows. Rounds end when no
    pointer reached its end: distances have no gaps, so what is left never
    will. On a ring pointers permute its records, so what pointers of records
    that never end still reach, once that set stays the same, is the ring.
    """
    scratch = scratch or Scratch(records.sparkSession)
    ids = records.select(F.col(key).alias("id")).where("id is not null").distinct()
    edges = scratch.stored(edges.select("source", "target", "type", F.col(order).alias(order)), "edges")
    parts = parts_of(edges)
    known = edges.repartition(parts, "source").join(ids.select(F.col("id").alias("source")), "source", "left_semi").repartition(parts, "target").join(ids.select(F.col("id").alias("target")), "target", "left_semi")
    step = scratch.stored(ids.join(successors(known, order), "id", "left"), "steps")
    scratch.drop(edges)
    # at: where the pointer is; depth: steps taken; open: whether it may go on.
    now = scratch.stored(step.select("id", F.coalesce("next", "id").alias("at"), F.col("next").isNotNull().cast("long").alias("depth"), F.col("next").isNotNull().alias("open")), "pointers")
    open_before, ring_before = -1, -1
    while True:
        counted = now.where("open").agg(F.count("*").alias("n"), F.count_distinct("at").alias("reached")).first()
        if not counted.n or (counted.n == open_before and counted.reached == ring_before):
            break
        open_before, ring_before = counted.n, counted.reached
        ahead = now.select(F.col("id").alias("at"), F.col("at").alias("_at"), F.col("depth").alias("_depth"), F.col("open").alias("_open"))
        going = now.where("open").join(ahead, "at").select("id", F.col("_at").alias("at"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_open").alias("open"))
        after = scratch.stored(going.unionByName(now.where("not open")), "pointers")
        scratch.drop(now)
        now = after
    ring = now.where("open").select(F.col("at").alias("id")).distinct().withColumn("ring", F.lit(True))
    cycle = F.when(~F.col("open"), "none").when(F.col("ring").isNotNull(), "on").otherwise("into")
    found = now.join(ring, "id", "left").join(step.select("id", "n_successors"), "id")
    end = lambda c: F.when(~F.col("open"), F.col(c))
    return found.select("id", end("at").alias("newest"), end("depth").alias("depth"), cycle.alias("cycle"), F.coalesce("n_successors", F.lit(0)).alias("n_successors"))
