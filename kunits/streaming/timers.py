"""Streams with timers and states that end by themselves: cooldowns and state machines.

Both need the RocksDB state store
(``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kunits.schema import PRODUCTION

COOLING, ENDED, RESET = "cooling", "ended", "reset"
FAILURE, SUCCESS = "failure", "success"


def _milliseconds(at: Any) -> int:
    moment = pd.Timestamp(at)
    return int((moment if moment.tzinfo is None else moment.tz_convert("UTC").tz_localize(None)).value // 1_000_000)


def _moment(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, UTC).replace(tzinfo=None)


class Cooldown(StatefulProcessor):
    """Failures in a row of a key, and a timer at the end of the cooldown that they cause."""

    def __init__(self, key: str, at: str, outcome: str, base_ms: int, most_ms: int):
        self.key, self.at, self.outcome, self.base_ms, self.most_ms = key, at, outcome, base_ms, most_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("cooldown", "failures int, until_ms long")

    def _shown(self, key: tuple, what: str, failures: int, until: int | None) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]], "what": [what], "failures": [failures], "until": pd.Series([None if until is None else _moment(until)], dtype="datetime64[us]")})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of the interface
        failures, until = self.held.get() if self.held.exists() else (0, None)
        seen = sorted((_milliseconds(r[0]), r[1]) for frame in rows for r in frame[[self.at, self.outcome]].itertuples(index=False, name=None))
        changed = False
        for when, what in seen:
            if what == FAILURE:
                failures, changed = failures + 1, True
                until = when + min(self.base_ms * 2 ** (min(failures, 40) - 1), self.most_ms)
            elif what == SUCCESS:
                changed, failures, until = changed or failures > 0, 0, None
        if not changed:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if failures:
            self.held.update((failures, until))
            self.handle.registerTimer(until)
            yield self._shown(key, COOLING, failures, until)
        else:
            self.held.clear()
            yield self._shown(key, RESET, 0, None)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of the interface
        if self.held.exists():
            failures, until = self.held.get()
            yield self._shown(key, ENDED, failures, until)

    def close(self) -> None:
        pass


def cooldowns(stream: DataFrame, key: str, at: str, outcome: str, base_ms: int = 1000, most_ms: int = 60_000, delay: str = "1 minute") -> DataFrame:
    """key, what, failures, until: ``cooling`` at failures, ``ended`` when the time is over, ``reset`` at a success after failures.

    The end comes by a timer of event time, whether the key has another event
    or not. Failures double the cooldown until a success; what is cancelled
    counts for nothing. Rows of a batch are taken in order of time.
    """
    fields = T.StructType([T.StructField(key, stream.schema[key].dataType), *T.StructType.fromDDL("what string, failures int, until timestamp").fields])
    grouped = stream.withWatermark(at, delay).groupBy(key)
    return grouped.transformWithStateInPandas(Cooldown(key, at, outcome, base_ms, most_ms), outputStructType=fields, outputMode="Append", timeMode="EventTime")


class Machine(StatefulProcessor):
    """The state of a key; it is forgotten when the key was idle for long."""

    def __init__(self, key: str, state: str, at: str, table: dict[str, tuple[str, ...]], start: str, idle_ms: int):
        self.key, self.state, self.at, self.table, self.start, self.idle_ms = key, state, at, table, start, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("state", "state string", self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of the interface
        now = self.held.get()[0] if self.held.exists() else self.start
        out = []
        for when, asked in sorted(r for frame in rows for r in frame[[self.at, self.state]].itertuples(index=False, name=None)):
            ok = asked == now or asked in self.table.get(now, ())
            out.append((key[0], when, now, asked, asked if ok else now, ok))
            now = asked if ok else now
        self.held.update((now,))
        yield pd.DataFrame(out, columns=[self.key, self.at, "previous", "asked", "state", "accepted"])

    def close(self) -> None:
        pass


def state_machine(stream: DataFrame, key: str, state: str, at: str, table: dict[str, tuple[str, ...]] = PRODUCTION, start: str = "waiting", idle_ms: int = 7 * 24 * 3_600_000) -> DataFrame:
    """key, at, previous, asked, state, accepted: as ``events.state_machine``; a key that is idle for *idle_ms* begins anew."""
    fields = T.StructType([T.StructField(key, stream.schema[key].dataType), T.StructField(at, stream.schema[at].dataType), *T.StructType.fromDDL("previous string, asked string, state string, accepted boolean").fields])
    return stream.groupBy(key).transformWithStateInPandas(Machine(key, state, at, table, start, idle_ms), outputStructType=fields, outputMode="Append", timeMode="ProcessingTime")
