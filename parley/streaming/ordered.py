"""Rules along sessions on a state processor: rows wait until the watermark has passed them, so they are folded in the order of their time however they arrive,
and a rule may ask to be woken at a time at which no row comes.

A rule is a fold of ``live`` (``step``, ``dump``, ``load``, ``STATE``, ``OUT``). It may have ``wake()``, the time at which it wants to act or None, and ``at(session, t)``, its row then
(with a null ord). A wake comes before rows of the same time. ``idle`` seconds after a session's last row its state goes. The batch form runs the same loop to the end of each session, so
both give the same rows; a stream gives those that its watermark has reached.

Streams need the RocksDB state store (``use_state_store``).
"""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def use_state_store(spark: SparkSession) -> None:
    """State processors keep lists, timers and times to live, which only this store has. Holds for queries that start afterwards."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def out_schema(rows: DataFrame, rule: type, more: str = "") -> str:
    """The rule's columns with the session's own type."""
    return rule.OUT.replace("session long", f"session {rows.schema['session'].dataType.simpleString()}") + more


def advance(rule, make, rows: list, last: float | None, idle: float | None, upto: float, reset: str | None = None) -> tuple[list[tuple], Any, float | None, int]:
    """Fold rows (sorted by time) and wakes in order while they are not after ``upto``: results with their times, the rule, the time of the last row, and how many rows were taken."""
    out, at = [], 0
    while True:
        wake = rule.wake() if hasattr(rule, "wake") else None
        end = last + idle if idle is not None and last is not None else None
        row = rows[at] if at < len(rows) else None
        times = [(t, k) for k, t in enumerate((wake, end, row and row.s)) if t is not None]
        t, kind = min(times, default=(float("inf"), 3))
        if t > upto or kind == 3:
            return out, rule, last, at
        if kind == 0:
            out.append((*rule.at(rule.session, t), t))
        elif kind == 1:
            rule, last = make(), None
        else:
            at, last = at + 1, row.s
            if reset and getattr(row, reset):
                rule = make()
            else:
                rule.session = row.session
                out.append((*rule.step(row), row.s))


def _plain(pdf: pd.DataFrame) -> list[tuple]:
    """Rows as tuples of Python values; missing ones are None."""
    value = lambda x: x.tolist() if hasattr(x, "tolist") else x
    tidy = lambda x: None if x is None or x is pd.NaT or (isinstance(x, float) and x != x) else x
    return [tuple(tidy(value(x)) for x in row) for row in pdf.itertuples(index=False, name=None)]


def folded_in_time(rows: DataFrame, rule: type, idle: float | None = None, reset: str | None = None, **options) -> DataFrame:
    """The batch form: a rule along each session in the order of (s, ord), with its wakes; ``t`` is the time of each result."""
    columns = rows.columns
    names = [c.split()[0] for c in rule.OUT.split(", ")] + ["t"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held = [SimpleNamespace(**dict(zip(columns, r))) for r in _plain(pdf.sort_values(["s", "ord"]))]
        out, *_ = advance(rule(**options), lambda: rule(**options), held, None, idle, float("inf"), reset)
        return pd.DataFrame(out, columns=names, dtype=object)

    return rows.groupBy("session").applyInPandas(run, out_schema(rows, rule, ", t double"))


class Ordered(StatefulProcessor):
    """State of a session: the rule's own and the last row's time as values, and a list of rows that the watermark has not passed yet."""

    def __init__(self, rule: type, options: dict, columns: list[str], schema: str, idle: float | None, reset: str | None):
        self.rule, self.options, self.columns, self.schema, self.idle, self.reset = rule, options, columns, schema, idle, reset
        self.names = [c.split()[0] for c in rule.OUT.split(", ")] + ["t"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fold = handle.getValueState("fold", self.rule.STATE)
        self.last = handle.getValueState("last", "t double")
        self.waiting = handle.getListState("waiting", self.schema)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            held = _plain(pdf[self.columns])
            self.waiting.appendList(held)
            first = min(r[self.columns.index("s")] for r in held)
            self.handle.registerTimer(max(int(first * 1000) + 1, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() / 1000
        held = [SimpleNamespace(**dict(zip(self.columns, r))) for r in (self.waiting.get() if self.waiting.exists() else ())]
        held.sort(key=lambda r: (r.s, r.ord))
        rule = self.rule(**self.options)
        if self.fold.exists():
            rule.load(tuple(self.fold.get()))
        rule.session = key[0]
        last = self.last.get()[0] if self.last.exists() else None
        out, rule, last, taken = advance(rule, lambda: self.rule(**self.options), held, last, self.idle, upto, self.reset)
        if taken:
            left = [tuple(getattr(r, c) for c in self.columns) for r in held[taken:]]
            self.waiting.put(left) if left else self.waiting.clear()
        if last is None:
            self.fold.clear()
            self.last.clear()
        else:
            self.fold.update(tuple(rule.dump()))
            self.last.update((last,))
        # the next thing to happen: a waiting row, a wake or the end of an idle session
        after = [r.s for r in held[taken : taken + 1]]
        if last is not None:
            wake = rule.wake() if hasattr(rule, "wake") else None
            after += [t for t in (wake, last + self.idle if self.idle is not None else None) if t is not None]
        if after:
            self.handle.registerTimer(max(int(min(after) * 1000) + 1, timerValues.getCurrentWatermarkInMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=self.names, dtype=object)

    def close(self) -> None:
        pass


def streamed_in_time(rows: DataFrame, rule: type, late: str = "10 seconds", idle: float | None = None, reset: str | None = None, **options) -> DataFrame:
    """``folded_in_time`` on a stream. Rows have ``s`` in seconds since 1970; those over ``late`` behind the newest may come after the watermark and are dropped."""
    columns = rows.columns
    timed = rows.withColumn("__at", F.timestamp_seconds("s")).withWatermark("__at", late)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    processor = Ordered(rule, options, columns, schema, idle, reset)
    return timed.groupBy("session").transformWithStateInPandas(processor, out_schema(rows, rule, ", t double"), "Append", "EventTime")


class Arriving(StatefulProcessor):
    """Rows folded as they arrive; the state lives for ``idle_ms`` of processing time after its last change."""

    def __init__(self, rule: type, options: dict, columns: list[str], idle_ms: int, reset: str | None):
        self.rule, self.options, self.columns, self.idle_ms, self.reset = rule, options, columns, idle_ms, reset
        self.names = [c.split()[0] for c in rule.OUT.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fold = handle.getValueState("fold", self.rule.STATE, self.idle_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        rule = self.rule(**self.options)
        if self.fold.exists():
            rule.load(tuple(self.fold.get()))
        held = [SimpleNamespace(**dict(zip(self.columns, r))) for pdf in rows for r in _plain(pdf[self.columns])]
        out = []
        for row in sorted(held, key=lambda r: (r.s, r.ord)):
            if self.reset and getattr(row, self.reset):
                rule = self.rule(**self.options)
            else:
                out.append(rule.step(row))
        self.fold.update(tuple(rule.dump()))
        if out:
            yield pd.DataFrame(out, columns=self.names, dtype=object)

    def close(self) -> None:
        pass


def streamed_on_arrival(rows: DataFrame, rule: type, idle_ms: int = 3_600_000, reset: str | None = None, **options) -> DataFrame:
    """A rule on a stream in the order of arrival, sorted within a micro-batch, for sessions whose rows come in order. Nothing waits for a watermark."""
    processor = Arriving(rule, options, rows.columns, idle_ms, reset)
    return rows.groupBy("session").transformWithStateInPandas(processor, out_schema(rows, rule), "Append", "ProcessingTime")
