"""Stateful streams: cleaning, interpolation and as-of on rows in the order of event time.

Rows come in any order within the watermark's delay. A processor keeps those of a series that are later than the
watermark (its state is bounded by the delay) and hands the others, in the order of (ts, row_pos), to its automaton
once no earlier row can come. A row that is late beyond the watermark is dropped by Spark. Timers are in event time: one
wakes a series for its earliest waiting row; one ends it when nothing came for `quiet`, which releases what the
automaton still holds and deletes the state of the series. (Spark's own TTL counts processing time, which would make
results depend on the speed of the run.) What comes later starts the series anew, so results are those of the batch
operators on each stretch between gaps longer than `quiet`.

A session needs spark.sql.streaming.stateStore.providerClass to name the RocksDB provider; `rocksdb` sets it. Spark puts the
state of a micro-batch in the checkpoint with its offsets, so a restarted query goes on where it was.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.grid import checked_step
from tidemark.operators.sbad import detect

ROW = "ts long, row_pos long, tag int, value double"
CLEANED = "series_id string, ts timestamp, value double, row_pos long"

#: A row as automata see it: microseconds since the epoch, place, tag of its stream, value or None.
Row = tuple[int, int, int, float | None]


def rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class InOrder(StatefulProcessor):
    """Feeds rows to an automaton in order. Automata keep what they know in `mark` and rows they hold back in `held`."""

    #: Schema of `mark`, and the columns that are put out besides series_id.
    mark_schema = "ts long"
    columns = ("ts", "value", "row_pos")

    def __init__(self, quiet_minutes: float):
        self.quiet = int(quiet_minutes * 6e7)

    # what an automaton defines
    def take(self, rows: Iterable[Row], mark: tuple | None, held: list[Row]) -> tuple[list[tuple], tuple | None, list[Row]]:
        """What some rows, in order, put out, and what the automaton knows and holds after them."""
        raise NotImplementedError

    def end(self, mark: tuple | None, held: list[Row]) -> list[tuple]:
        """What is put out when a series has ended."""
        return []

    # what Spark calls
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ROW)
        self.held = handle.getListState("held", ROW)
        self.mark = handle.getValueState("mark", self.mark_schema)
        self.last = handle.getValueState("last", "ts long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new: list[Row] = []
        for df in rows:
            ts = df["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
            values = [None if v is None or np.isnan(v) else float(v) for v in df["value"]]
            new += zip(ts.tolist(), df["row_pos"].tolist(), df["tag"].tolist(), values, strict=True)
        self.waiting.appendList(new)
        self._wake(min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due, later = sorted((r for r in waiting if r[0] <= now), key=lambda r: r[:3]), [r for r in waiting if r[0] > now]
        out = []
        mark = tuple(self.mark.get()) if self.mark.exists() else None
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        last = self.last.get()[0] if self.last.exists() else None
        while due:  # stretches between quiet gaps
            n = 0
            while n < len(due) and (last is None or due[n][0] - last <= self.quiet):
                last, n = due[n][0], n + 1
            if n:
                made, mark, held = self.take(due[:n], mark, held)
                out += made
                due = due[n:]
            if due:
                out += self.end(mark, held)
                mark, held, last = None, [], None
        if last is not None and now - last > self.quiet:
            out += self.end(mark, held)
            mark, held, last = None, [], None
        for state, value in ((self.waiting, later), (self.held, held)):
            state.put(value) if value else state.clear()
        for state, value in ((self.mark, mark), (self.last, None if last is None else (last,))):
            state.update(value) if value is not None else state.clear()
        if later:
            self._wake(min(r[0] for r in later))
        if last is not None:
            self._wake(last + self.quiet + 1000)
        if out:
            frame = pd.DataFrame(out, columns=list(self.columns))
            frame.insert(0, "series_id", key[0])
            frame["ts"] = pd.to_datetime(frame["ts"], unit="us")
            yield frame

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))

    def close(self) -> None:
        pass


class ConstantRuns(InOrder):
    """Runs of one repeated value become missing if they last so many minutes or longer. It holds a run until it is that long.

    mark: the run's first time, value and rows, and whether it is long.
    """

    mark_schema = "ts long, value double, n long, long boolean"

    def __init__(self, min_minutes: float, quiet_minutes: float):
        super().__init__(quiet_minutes)
        self.least = int(min_minutes * 6e7)

    def take(self, rows, mark, held):
        out = []
        for r in rows:
            ts, pos, _, value = r
            if value is None or mark is None or value != mark[1]:
                out += self.end(mark, held)
                mark, held = (None, []) if value is None else ((ts, value, 1, False), [r])
                if value is None:
                    out.append((ts, None, pos))
                continue
            start, _, n, long = mark
            mark = (start, value, n + 1, long or ts - start >= self.least)
            held.append(r)
            if mark[3]:
                out += [(h[0], None, h[1]) for h in held]
                held = []
        return out, mark, held

    def end(self, mark, held):
        return [(h[0], h[3], h[1]) for h in held]


class SlopeParts(InOrder):
    """The slope-based detection on each part between gaps longer than `quiet`; it holds the part that is open."""

    def __init__(self, max_change: float, max_length: float, quiet_minutes: float):
        super().__init__(quiet_minutes)
        self.limits = max_change, max_length

    def take(self, rows, mark, held):
        return [], None, [*held, *rows]

    def end(self, mark, held):
        if not held:
            return []
        minutes = np.array([(h[0] - held[0][0]) / 6e7 for h in held])
        values = detect(minutes, np.array([np.nan if h[3] is None else h[3] for h in held]), *self.limits)
        return [(h[0], None if np.isnan(v) else float(v), h[1]) for h, v in zip(held, values, strict=True)]


class Interpolated(InOrder):
    """Values on an equidistant grid, on the line between the two known ones around each point, if these are at most max_gap apart.

    Times count in whole seconds; it holds the rows of the second that is open. mark: the next point, the last known time and its value.
    """

    mark_schema = "next long, t long, value double"
    columns = ("ts", "value")

    def __init__(self, step_minutes: float, offset_minutes: float, max_gap_minutes: float, quiet_minutes: float):
        super().__init__(quiet_minutes)
        self.step, self.most = checked_step(step_minutes), max_gap_minutes * 60
        self.offset = round(offset_minutes * 60) % self.step if offset_minutes > 0 else 0

    def take(self, rows, mark, held):
        out, rows = [], [*held, *rows]
        open_ = rows[-1][0] // 1_000_000
        for t, group in itertools.groupby((r for r in rows if r[0] // 1_000_000 < open_), key=lambda r: r[0] // 1_000_000):
            made, mark = self._second(t, list(group), mark)
            out += made
        return out, mark, [r for r in rows if r[0] // 1_000_000 == open_]

    def end(self, mark, held):
        if not held:
            return []
        t = held[-1][0] // 1_000_000
        out, (point, _, _) = self._second(t, held, mark)
        return out + [(p * 1_000_000, None) for p in range(point, t + 1, self.step)]

    def _second(self, t: int, rows: list[Row], mark: tuple | None) -> tuple[list[tuple], tuple]:
        """The points that the rows of one second settle."""
        known = [(r[1], r[3]) for r in rows if r[3] is not None]
        if mark is None:
            base = t - t % 3600 + self.offset
            mark = (base + max(0, -((base - t) // self.step)) * self.step, None, None)
        point, before, value = mark
        if not known:
            # no later value is near enough to the one before, or there is none before
            until = t if before is None or t - before >= self.most else point - 1
            points = range(point, until + 1, self.step)
            return [(p * 1_000_000, None) for p in points], (point + len(points) * self.step, before, value)
        now = min(known)[1]
        near, out = before is not None and t - before <= self.most, []
        for p in range(point, t + 1, self.step):
            out.append((p * 1_000_000, now if p == t else value + (now - value) / (t - before) * (p - before) if near else None))
        return out, (point + len(out) * self.step, t, now)


class AsOf(InOrder):
    """For each row of the left stream (tag 1) the last known value of the right one (tag 0) at or before it, at most `within` old."""

    mark_schema = "ts long, value double"
    columns = ("ts", "row_pos", "value", "found_ts", "found")

    def __init__(self, within_minutes: float, quiet_minutes: float):
        super().__init__(quiet_minutes)
        self.within = int(within_minutes * 6e7)

    def take(self, rows, mark, held):
        out = []
        for ts, pos, tag, value in sorted(rows, key=lambda r: (r[0], r[2], r[1])):  # at one time the right stream first
            if tag == 0:
                if value is not None and (mark is None or mark[0] != ts):
                    mark = (ts, value)
            else:
                hit = mark is not None and ts - mark[0] <= self.within
                out.append((ts, pos, value, pd.Timestamp(mark[0], unit="us") if hit else pd.NaT, mark[1] if hit else None))
        return out, mark, []


def _run(stream: DataFrame, processor: InOrder, schema: str, late: str | None) -> DataFrame:
    if late is not None:
        stream = stream.withWatermark("ts", late)
    if "tag" not in stream.columns:
        stream = stream.withColumn("tag", F.lit(0))
    return stream.select("series_id", "ts", "row_pos", "tag", "value").groupBy("series_id").transformWithStateInPandas(processor, schema, "Append", "EventTime")


def drop_constant_runs(stream: DataFrame, min_minutes: float, quiet_minutes: float, late: str = "1 hour") -> DataFrame:
    """(series_id, ts, value, row_pos) of a stream of the same columns: clean.drop_constant_runs after the watermark."""
    return _run(stream, ConstantRuns(min_minutes, quiet_minutes), CLEANED, late)


def slope_anomalies(stream: DataFrame, max_change: float, max_length: float, quiet_minutes: float, late: str = "1 hour") -> DataFrame:
    """sbad.sbad(split_gap=quiet_minutes), without filling, after the watermark."""
    return _run(stream, SlopeParts(max_change, max_length, quiet_minutes), CLEANED, late)


def interpolated(stream: DataFrame, step: float, offset: float = 0, max_gap: float = 60, quiet_minutes: float | None = None, late: str = "1 hour") -> DataFrame:
    """(series_id, ts, value): regrid with "intrpl" after the watermark. A series holds one known value and the rows of the delay."""
    return _run(stream, Interpolated(step, offset, max_gap, max(max_gap, quiet_minutes or max_gap)), "series_id string, ts timestamp, value double", late)


def asof(left: DataFrame, right: DataFrame, within_minutes: float, late: str = "1 hour") -> DataFrame:
    """(series_id, ts, row_pos, value, found_ts, found) for each row of the left stream; both have (series_id, ts, row_pos, value).

    Of right rows at one time the one with the smallest row_pos counts; null values don't. A right row is kept for
    within_minutes of event time at most, and until the next one.
    """
    columns = ["series_id", "ts", "row_pos", "value"]
    both = [s.withWatermark("ts", late).select(*columns, F.lit(tag).alias("tag")) for tag, s in ((1, left), (0, right))]
    out = "series_id string, ts timestamp, row_pos long, value double, found_ts timestamp, found double"
    return _run(both[0].unionAll(both[1]), AsOf(within_minutes, within_minutes), out, None)
