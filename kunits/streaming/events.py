"""Streams: limiters, late terminals, leases, state machines, cooldowns, intake, windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kunits.schema import PRODUCTION

TERMINAL = ("stored", "failed", "written", "success", "archived", "cancelled")


def limiter_violations(starts: DataFrame, key: list[str], at: str, most: int, interval: str = "1 second") -> DataFrame:
    """key, window, starts: intervals in which more than *most* starts fell. Works on streams and tables."""
    return starts.groupBy(*key, F.window(at, interval).alias("window")).agg(F.count("*").alias("starts")).where(F.col("starts") > most)


def sliding_starts(starts: DataFrame, key: list[str], at: str, seconds: int) -> DataFrame:
    """Adds recent: starts of the key in the *seconds* up to each one, itself included."""
    w = W.partitionBy(*key).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return starts.withColumn("recent", F.count("*").over(w))


def late_progress(events: DataFrame, key: str, at: str, status: str, terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """Adds accepted: progress after a key's first terminal event is dropped."""
    end = F.min(F.when(F.col(status).isin(*terminal), F.col(at))).over(W.partitionBy(key))
    return events.withColumn("accepted", F.col(status).isin(*terminal) & (F.col(at) == end) | end.isNull() | (F.col(at) < end))


def last_state(events: DataFrame, key: str, at: str, status: str, terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """key, status: the first terminal status, else the latest: partial aggregates only."""
    end = F.min_by(F.when(F.col(status).isin(*terminal), F.col(status)), F.when(F.col(status).isin(*terminal), F.col(at)))
    return events.groupBy(key).agg(F.coalesce(end, F.max_by(status, at)).alias("status"))


def debounced(events: DataFrame, key: str, at: str, interval: str = "500 milliseconds") -> DataFrame:
    """The last write of each key in each interval."""
    row = F.struct(*events.columns)
    return events.groupBy(F.col(key), F.window(at, interval).alias("_w")).agg(F.max_by(row, at).alias("_r")).select("_r.*")


def owners(claims: DataFrame, key: str, at: str, owner: str) -> DataFrame:
    """key, owner: of several claims of a lease the first wins."""
    return claims.groupBy(key).agg(F.min_by(owner, F.struct(at, owner)).alias(owner))


def deduplicated(stream: DataFrame, key: str, at: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark's delay: intake by content hash."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def tumbling(stream: DataFrame, at: str, width: str, keys: list[str], delay: str = "10 minutes", **measures: Column) -> DataFrame:
    """Measures by event-time window; windows close at the watermark."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, width).alias("window"), *keys).agg(F.count("*").alias("n"), *(c.alias(k) for k, c in measures.items()))


def sessions(stream: DataFrame, at: str, gap: str, key: str, delay: str = "10 minutes") -> DataFrame:
    """key, session, n: events with less than *gap* between them."""
    return stream.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("session"), key).agg(F.count("*").alias("n"))


def with_transitions(events: DataFrame, key: str, at: str, state: str, table: dict[str, tuple[str, ...]] = PRODUCTION) -> DataFrame:
    """Adds previous, legal: each event's state against the one before, by the fixed table; for tables."""
    before = F.lag(state).over(W.partitionBy(key).orderBy(at))
    legal = before.isNull() | (before == F.col(state))
    for a, b in table.items():
        legal = legal | ((before == a) & F.col(state).isin(*b)) if b else legal
    return events.withColumns({"previous": before, "legal": legal})


def state_machine(stream: DataFrame, key: str, state: str, at: str, table: dict[str, tuple[str, ...]] = PRODUCTION, start: str = "waiting") -> DataFrame:
    """key, at, previous, asked, state, accepted: a state machine over a stream, one state a key.

    An event that the table doesn't allow is refused and changes nothing; so
    does progress after the end. Events of a batch are taken in order of *at*.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.get[0] if held.exists else start
        rows = []
        for pdf in frames:
            rows += pdf[[at, state]].values.tolist()
        out = []
        for when, asked in sorted(rows):
            ok = asked == now or asked in table.get(now, ())
            out.append((k[0], when, now, asked, asked if ok else now, ok))
            now = asked if ok else now
        held.update((now,))
        yield pd.DataFrame(out, columns=[key, at, "previous", "asked", "state", "accepted"])

    fields = f"{key} {stream.schema[key].dataType.simpleString()}, {at} {stream.schema[at].dataType.simpleString()}, previous string, asked string, state string, accepted boolean"
    return stream.groupBy(key).applyInPandasWithState(step, fields, "state string", "append", GroupStateTimeout.NoTimeout)


def cooldowns(stream: DataFrame, key: str, at: str, outcome: str, base_ms: int = 1000, most_ms: int = 60_000, delay: str = "1 minute") -> DataFrame:
    """key, failures, until: failures in a row and the end of the cooldown; success resets, cancelling doesn't count."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        failures = held.get[0] if held.exists and not held.hasTimedOut else 0
        rows = sorted(r for pdf in frames for r in pdf[[at, outcome]].values.tolist()) if not held.hasTimedOut else []
        until = None
        for when, what in rows:
            if what == "failure":
                failures += 1
                until = when + pd.Timedelta(milliseconds=min(base_ms * 2 ** (min(failures, 40) - 1), most_ms))
            elif what == "success":
                failures, until = 0, None
        if held.hasTimedOut or not failures:
            held.remove()
        else:
            held.update((failures,))
        if rows:
            yield pd.DataFrame([(k[0], failures, until)], columns=[key, "failures", "until"])

    fields = f"{key} {stream.schema[key].dataType.simpleString()}, failures int, until timestamp"
    return stream.withWatermark(at, delay).groupBy(key).applyInPandasWithState(step, fields, "failures int", "append", GroupStateTimeout.EventTimeTimeout)


def file_intake(spark: Any, folder: str, glob: str = "*") -> DataFrame:
    """A stream of files under a folder: path, source_hash, content, modificationTime."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
    rows = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(folder)
    return rows.withColumn("source_hash", F.sha2("content", 256))


def run_pipeline(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> Any:
    """Run whole-document operators on each micro-batch; *sink* gets (rows, batch id) and must be idempotent by id."""
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def cancel(spark: Any, group: str) -> None:
    """Stop the jobs of a group, as an abort signal would."""
    spark.sparkContext.cancelJobGroup(group)
