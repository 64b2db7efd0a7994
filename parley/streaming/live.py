"""Live sessions: windows with watermarks, and keyed state for deduplication, speaker decisions and timelines.

Each stateful rule is one fold over a session's rows, used by the batch form (rows sorted within a session) and by the stream
(rows of a micro-batch, with the state carried on), so both give the same answer on ordered input. State is bounded by the retention.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import out_schema, streamed_on_arrival

RETENTION = 30.0


def timed(events: DataFrame) -> DataFrame:
    """Event time as TIMESTAMP, which watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, width: str, slide: str | None = None, late: str = "30 seconds", by: tuple = ("event_type",), value: str = "value") -> DataFrame:
    """Counts and sums by window. On a stream, rows later than the watermark are dropped."""
    frame = F.window("ts", width, slide) if slide else F.window("ts", width)
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(frame.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, gap: str, key: str = "user_id", late: str = "30 seconds") -> DataFrame:
    """Session windows by key. On a stream the last one stays open behind the watermark."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


@dataclass
class Snippets:
    """What each call adds: of its words (``operators.words.call_words``) those that start over ``slack`` after the last end of the call before that gave any. A last end over a second
    past the call's begin can't be right, and the begin takes its place. A snippet equal to the one before is dropped (a null text), though its last end counts."""

    slack: float = 0.03
    last: float = float("-inf")
    snippet: str = ""

    def step(self, row) -> tuple:
        last = row.s if self.last > row.s + 1.0 else self.last
        kept = [i for i, start in enumerate(row.starts) if start > last + self.slack]
        if not kept:
            return (row.session, row.ord, 0, None, None)
        text, self.last = " ".join(row.words[i] for i in kept), float(max(row.ends[i] for i in kept))
        fresh = text != self.snippet
        self.snippet = text
        return (row.session, row.ord, len(kept), text if fresh else None, self.last)

    STATE = "last double, snippet string"
    OUT = "session long, ord long, n int, text string, last_end double"

    def dump(self) -> tuple:
        return (self.last, self.snippet)

    def load(self, held: tuple) -> Snippets:
        self.last, self.snippet = held
        return self


@dataclass
class Speaker:
    """The current speaker of a session: another one, or none where the confidence is under ``least``, takes over once ``cooldown`` seconds have gone since the last switch or match;
    the same speaker's confidence is an exponential mean."""

    cooldown: float = 1.0
    least: float = 0.0
    alpha: float = 0.3
    speaker: str | None = None
    confidence: float = 0.0
    since: float = float("-inf")

    def step(self, row) -> tuple:
        sure = row.spk is not None and row.confidence >= self.least
        if sure and row.spk == self.speaker:
            self.confidence, self.since = self.alpha * row.confidence + (1 - self.alpha) * self.confidence, row.s
        elif sure and (self.speaker is None or row.s - self.since >= self.cooldown):
            self.speaker, self.confidence, self.since = row.spk, row.confidence, row.s
        elif not sure and self.speaker is not None and row.s - self.since >= self.cooldown:
            self.speaker, self.confidence, self.since = None, 0.0, row.s
        return (row.session, row.ord, self.speaker, self.confidence)

    STATE = "speaker string, confidence double, since double"
    OUT = "session long, ord long, speaker string, confidence double"

    def dump(self) -> tuple:
        return (self.speaker, self.confidence, self.since)

    def load(self, held: tuple) -> Speaker:
        self.speaker, self.confidence, self.since = held
        return self


@dataclass
class Silence:
    """``silent`` is only confirmed by a second silent chunk in a row; a chunk with speech (a confidence of ``least``) takes the first one back."""

    least: float = 0.05
    strikes: int = 0

    def step(self, row) -> tuple:
        self.strikes = 0 if row.confidence >= self.least else self.strikes + 1
        return (row.session, row.ord, self.strikes == 1, self.strikes >= 2)

    STATE = "strikes int"
    OUT = "session long, ord long, flagged boolean, silent boolean"

    def dump(self) -> tuple:
        return (self.strikes,)

    def load(self, held: tuple) -> Silence:
        self.strikes = held[0]
        return self


@dataclass
class Accumulation:
    """Seconds of speech held for the next decision: over three times ``need`` they are cut to twice ``need``; ``ready`` from ``need`` on."""

    need: float = 0.5
    held: float = 0.0

    def step(self, row) -> tuple:
        self.held += row.e - row.s
        if self.held > 3 * self.need:
            self.held = 2 * self.need
        return (row.session, row.ord, self.held, self.held >= self.need)

    STATE = "held double"
    OUT = "session long, ord long, held double, ready boolean"

    def dump(self) -> tuple:
        return (self.held,)

    def load(self, held: tuple) -> Accumulation:
        self.held = held[0]
        return self


@dataclass
class Buffer:
    """A buffer of at most ``most`` seconds with an absolute clock: what is over goes from its head, ``t0`` moves on by as much, and the cursor (how far it was processed) moves back.

    The buffer is processed when at least ``fresh`` seconds are new and ``interval`` seconds have gone since the last time.
    """

    most: float = 12.0
    fresh: float = 1.0
    interval: float = 0.5
    t0: float = 0.0
    length: float = 0.0
    cursor: float = 0.0
    last: float = float("-inf")

    def step(self, row) -> tuple:
        self.length += row.e - row.s
        over = max(0.0, self.length - self.most)
        self.length, self.t0, self.cursor = self.length - over, self.t0 + over, max(0.0, self.cursor - over)
        due = self.length - self.cursor >= self.fresh and row.s - self.last >= self.interval
        if due:
            self.cursor, self.last = self.length, row.s
        return (row.session, row.ord, self.t0, self.length, due)

    def wake(self) -> float | None:
        """What is new waits only for the interval."""
        return self.last + self.interval if self.length - self.cursor >= self.fresh else None

    def at(self, session, t: float) -> tuple:
        self.cursor, self.last = self.length, t
        return (session, None, self.t0, self.length, True)

    STATE = "t0 double, length double, cursor double, last double"
    OUT = "session long, ord long, t0 double, length double, due boolean"

    def dump(self) -> tuple:
        return (self.t0, self.length, self.cursor, self.last)

    def load(self, held: tuple) -> Buffer:
        self.t0, self.length, self.cursor, self.last = held
        return self


@dataclass
class Microbatch:
    """Overlap detection on a buffer of at most ``most`` seconds: it runs once ``least`` seconds are held and ``interval`` seconds have gone since the last run, and keeps the last ``kept`` seconds.

    ``begins`` is the session's time at the head of the buffer.
    """

    least: float = 0.6
    interval: float = 1.0
    kept: float = 1.0
    most: float = 5.0
    begins: float = 0.0
    length: float = 0.0
    last: float = 0.0
    new: float = 0.0

    def step(self, row) -> tuple:
        self._cut(self.length + row.e - row.s, self.most)
        self.new += row.e - row.s
        due, begins, length = self.length >= self.least and row.s - self.last >= self.interval, self.begins, self.length
        if due:
            self._run(row.s)
        return (row.session, row.ord, begins, length, due)

    def wake(self) -> float | None:
        """Enough is held, and some of it is new: it waits only for the interval."""
        return self.last + self.interval if self.length >= self.least and self.new > 0 else None

    def at(self, session, t: float) -> tuple:
        begins, length = self.begins, self.length
        self._run(t)
        return (session, None, begins, length, True)

    def _run(self, t: float) -> None:
        self.last, self.new = t, 0.0
        self._cut(self.length, self.kept)

    def _cut(self, length: float, most: float) -> None:
        self.begins, self.length = self.begins + max(0.0, length - most), min(length, most)

    STATE = "begins double, length double, last double, new double"
    OUT = "session long, ord long, begins double, length double, due boolean"

    def dump(self) -> tuple:
        return (self.begins, self.length, self.last, self.new)

    def load(self, held: tuple) -> Microbatch:
        self.begins, self.length, self.last, self.new = held
        return self


@dataclass
class Display:
    """Who is shown: speech shows its speaker (nobody, if unknown); silence the last known speaker, until it has lasted ``hold`` seconds. That end is a row of its own, as no chunk need come then."""

    hold: float = 1.5
    known: str | None = None
    began: float | None = None
    cleared: bool = True

    def step(self, row) -> tuple:
        if row.speech:
            self.known, self.began, self.cleared = row.spk if row.spk is not None else self.known, None, False
            return (row.session, row.ord, row.spk)
        if self.began is None:
            self.began = row.s
        return (row.session, row.ord, None if self.cleared else self.known)

    def wake(self) -> float | None:
        return None if self.began is None or self.cleared or self.known is None else self.began + self.hold

    def at(self, session, t: float) -> tuple:
        self.cleared = True
        return (session, None, None)

    STATE = "known string, began double, cleared boolean"
    OUT = "session long, ord long, shown string"

    def dump(self) -> tuple:
        return (self.known, self.began, self.cleared)

    def load(self, held: tuple) -> Display:
        self.known, self.began, self.cleared = held
        return self


@dataclass
class Timeline:
    """Spans by speaker: one of the same speaker is extended, another is appended; from the oldest on, those that ended over ``RETENTION`` seconds ago go."""

    names: list = field(default_factory=list)
    starts: list = field(default_factory=list)
    ends: list = field(default_factory=list)

    def step(self, row) -> tuple:
        if self.names and self.names[-1] == row.spk:
            self.ends[-1] = row.e
        else:
            self.names.append(row.spk)
            self.starts.append(row.s)
            self.ends.append(row.e)
        while self.ends and self.ends[0] < row.s - RETENTION:
            for x in (self.names, self.starts, self.ends):
                x.pop(0)
        return (row.session, row.ord, len(self.names), ",".join(sorted(set(self.names))))

    STATE = "names array<string>, starts array<double>, ends array<double>"
    OUT = "session long, ord long, spans int, speakers string"

    def dump(self) -> tuple:
        return (self.names, self.starts, self.ends)

    def load(self, held: tuple) -> Timeline:
        self.names, self.starts, self.ends = (list(x) for x in held)
        return self


def _steps(pdf: pd.DataFrame, state, rule: type, options: dict, reset: str | None) -> tuple[list, object]:
    """The results of a session's rows in order, and the state after them; a row whose ``reset`` is true starts afresh and has no result."""
    out = []
    for row in pdf.sort_values(["s", "ord"]).itertuples():
        if reset and getattr(row, reset):
            state = rule(**options)
        else:
            out.append(state.step(row))
    return out, state


def folded(rows: DataFrame, rule: type, reset: str | None = None, **options) -> DataFrame:
    """A rule along each session of a batch, in the order of (s, ord). ``reset`` names a boolean column of control rows, which clear their session's state."""
    names = [c.split()[0] for c in rule.OUT.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_steps(pdf, rule(**options), rule, options, reset)[0], columns=names)

    return rows.groupBy("session").applyInPandas(run, out_schema(rows, rule))


#: The same rules on a stream, in the order of arrival or, with timers, of event time.
streamed = streamed_on_arrival


def silences(rows: DataFrame, least: float = 0.05) -> DataFrame:
    """(session, ord, flagged, silent), the batch form of ``Silence`` without a fold: silent rows since the last one with speech are counted by a window."""
    order = Window.partitionBy("session").orderBy("s", "ord").rowsBetween(Window.unboundedPreceding, 0)
    heard = F.coalesce(F.col("confidence") >= least, F.lit(False))
    runs = rows.select("session", "s", "ord", heard.alias("__heard")).withColumn("__run", F.sum(F.col("__heard").cast("int")).over(order))
    strikes = F.sum((~F.col("__heard")).cast("int")).over(Window.partitionBy("session", "__run").orderBy("s", "ord").rowsBetween(Window.unboundedPreceding, 0))
    return runs.withColumn("__strikes", strikes).select("session", "ord", (F.col("__strikes") == 1).alias("flagged"), (F.col("__strikes") >= 2).alias("silent"))


def held_display(rows: DataFrame, hold: float = 1.5) -> DataFrame:
    """(session, ord, shown): a chunk with speech (``speech``) shows its speaker; silence shows the last known speaker until ``hold`` seconds after the silence began."""
    order = Window.partitionBy("session").orderBy("s", "ord").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("__run", F.sum(F.col("speech").cast("int")).over(order)).withColumn("__last", F.last(F.when(F.col("speech"), F.col("spk")), ignorenulls=True).over(order))
    began = F.min(F.when(~F.col("speech"), F.col("s"))).over(Window.partitionBy("session", "__run"))
    return run.withColumn("__began", began).select("session", "ord", F.when(F.col("speech"), F.col("spk")).when(F.col("s") - F.col("__began") < hold, F.col("__last")).alias("shown"))


def warm_up_label(speaker, elapsed, speech, warm_up: float = 1.0, need: float = 0.5):
    """The speaker; without one, null in the first ``warm_up`` seconds or before ``need`` seconds of speech, then "Unknown"."""
    return F.coalesce(speaker, F.when((elapsed >= warm_up) & (speech >= need), F.lit("Unknown")))


def expanded_speakers(found, current, session, registry):
    """Speakers of an overlap: where fewer than two were found, the current one and the session's are added, then enrolled ones until there are two."""
    wide = F.array_union(F.array_union(found, F.array_compact(F.array(current))), session)
    rest = F.slice(F.array_except(registry, wide), 1, F.greatest(F.lit(2) - F.size(wide), F.lit(0)))
    return F.when(F.size(found) >= 2, found).otherwise(F.concat(wide, rest))


def recent(overlaps: DataFrame, now, since=None, retention: float = RETENTION) -> DataFrame:
    """Overlaps that ended at most ``retention`` seconds before ``now``, from the start ``since`` on."""
    kept = overlaps.where(F.col("e") >= F.lit(now) - retention)
    return kept if since is None else kept.where(F.col("s") >= F.lit(since))


def live_chunks(rows: DataFrame) -> DataFrame:
    """(session, sample_rate, seconds, samples) of JSON messages (``value``) with base64 float32 ``audio_data``, ``sample_rate`` and ``session_id``, "default" where it is missing."""

    @F.pandas_udf("array<float>")
    def decoded(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None else np.frombuffer(b[: len(b) // 4 * 4], dtype="<f4"))

    parts = rows.select(F.from_json(F.col("value").cast("string"), "audio_data string, sample_rate int, session_id string").alias("m")).select("m.*").withColumn("raw", F.unbase64("audio_data"))
    return parts.select(F.coalesce("session_id", F.lit("default")).alias("session"), "sample_rate", (F.floor(F.octet_length("raw") / 4) / F.col("sample_rate")).alias("seconds"), decoded("raw").alias("samples"))
