"""Slope-based anomaly detection, iterated to a fixpoint.

`detect` is the detection on the rows of one part in order, as a stream's state runs it. `sbad` gives the same rows for series of any
length by windows over time buckets: what each of the two automata does at a row follows from a few facts about the rows before
and after it, each of which is carried over bucket bounds.

For the first, whether it is open is decided by the last row that was missing or calm. The second looks at events: jumps,
breaks (no slope) and time-outs. It is closed after a break or time-out, and the first jump opens it. A run of equal signs that meets it
open, closes it by its first jump and opens it again by its second. So a run of two jumps or more leaves it open whatever
was before, and among single jumps after such a run it is open and closed in turn.

A missing value stays missing and resets both automata, so the rows between two of them settle by themselves, whatever the number of
passes elsewhere. Stretches of at most CHUNK rows are dealt in chunks and settled by `detect` at once; only longer ones take passes
by windows, each of which cuts them further.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.clean import ORDER, fill_gaps
from tidemark.operators.info import gaps
from tidemark.operators.ordered import KEY, bucketed, carried, numbered, running
from tidemark.plans.lineage import dropped, stored

ROUNDS = 50
#: Rows between missing ones that a task may settle; a chunk holds fewer than twice as many.
CHUNK = 50_000
#: Microseconds.
MINUTE = 6e7


def slopes(times: np.ndarray, values: np.ndarray, minute: float = 1.0) -> np.ndarray:
    out = np.full(len(values), np.nan)
    with np.errstate(divide="ignore", invalid="ignore"):
        out[1:] = np.diff(values) / (np.diff(times) / minute)
    return out


def trim_after_missing(values: np.ndarray, slope: np.ndarray, limit: float) -> None:
    """Remove values that follow a missing one (or the start) as long as the series still jumps."""
    open_ = False
    for i in range(len(values)):
        if i == 0 or np.isnan(values[i]):
            open_ = True
        elif open_ and not np.isnan(slope[i]):
            if abs(slope[i]) > limit:
                values[i - 1] = np.nan
            else:
                open_ = False


def remove_excursions(minutes: np.ndarray, values: np.ndarray, slope: np.ndarray, limit: float, longest: float) -> None:
    """Remove what lies between a jump and the jump back, or between a jump and a gap or the end soon after."""
    start, last, sign = None, None, 0
    for i, s in enumerate(slope):
        if np.isnan(s):
            if start is not None:
                if minutes[max(i - 1, 0)] - minutes[last] <= longest:
                    values[start:i] = np.nan
                start = None
        elif abs(s) > limit:
            if start is None:
                start, last, sign = i, i, np.sign(s)
            elif np.sign(s) == sign:
                last = i
            else:
                values[start:i] = np.nan
                start = None
        elif start is not None and minutes[i - 1] - minutes[last] > longest:
            start = None
    if start is not None:
        values[start:] = np.nan


def detect(times: np.ndarray, values: np.ndarray, limit: float, longest: float, minute: float = 1.0, rounds: int = ROUNDS) -> np.ndarray:
    """Values with anomalies made NaN: both passes in turn until three counts of removals are equal. minute: in units of times."""
    values = values.astype(float).copy()
    slope, counts, before = slopes(times, values, minute), [0], int(np.isnan(values).sum())

    def settled() -> bool:
        counts.append(int(np.isnan(values).sum()) - before)
        return len(counts) >= 3 and len(set(counts[-3:])) == 1

    for _ in range(rounds):
        trim_after_missing(values, slope, limit)
        if settled():
            break
        slope = slopes(times, values, minute)
        remove_excursions(times, values, slope, limit, longest * minute)
        if settled():
            break
        slope = slopes(times, values, minute)
    return values


def _beside(rows: DataFrame, what: Column, by: str) -> DataFrame:
    """Adds _p and _n: `what`, a struct, of the row before and of the row after, over bucket bounds too."""
    inside, across = Window.partitionBy(by, KEY).orderBy("_i"), Window.partitionBy(by).orderBy(KEY)
    edges = rows.groupBy(by, KEY).agg(F.min_by(what, "_i").alias("_first"), F.max_by(what, "_i").alias("_last"))
    edges = edges.select(by, KEY, F.lag("_last").over(across).alias("_pe"), F.lead("_first").over(across).alias("_ne"))
    rows = rows.withColumns({"_pi": F.lag(what).over(inside), "_ni": F.lead(what).over(inside)}).join(edges, [by, KEY])
    return rows.withColumns({"_p": F.coalesce("_pi", "_pe"), "_n": F.coalesce("_ni", "_ne")}).drop("_pi", "_ni", "_pe", "_ne")


def _slope(value: Column, ts: Column, value_before: Column, ts_before: Column) -> Column:
    """Change in a minute; null where a value is missing, or neither time nor value changes."""
    change, minutes = value - value_before, (F.unix_micros(ts) - F.unix_micros(ts_before)) / 6e7
    slope = F.when(minutes != 0, change / F.nullif(minutes, F.lit(0.0))).when(change > 0, F.lit(float("inf"))).when(change < 0, F.lit(float("-inf")))
    return F.when(~F.isnan(change), slope)


def _trimmed(rows: DataFrame, by: str, limit: float) -> DataFrame:
    """trim_after_missing over whole series: a value goes if the next one is a jump away and the last decisive row wasn't calm."""
    columns = rows.columns
    rows = _beside(rows, F.struct("ts", "value"), by)
    v, t, p, n = F.col("value"), F.col("ts"), F.col("_p"), F.col("_n")
    decisive = F.when(v.isNull() | p.isNull(), True).when(F.abs(_slope(v, t, p["value"], p["ts"])) <= limit, False)
    rows = carried(rows.withColumn("_jump", F.abs(_slope(n["value"], n["ts"], v, t)) > limit), "_open", decisive, ["_i"], by=by)
    return rows.withColumn("value", F.when(~F.coalesce(F.col("_jump") & F.col("_open"), F.lit(False)), v)).select(columns)


def _without_excursions(rows: DataFrame, by: str, limit: float, longest: float) -> DataFrame:
    """remove_excursions over whole series."""
    columns, micros = rows.columns, longest * 6e7
    us, jump = F.unix_micros, F.col("kind").isin(-1.0, 1.0)
    rows = _beside(rows, F.struct("ts", "value"), by)
    slope = _slope(F.col("value"), F.col("ts"), F.col("_p.value"), F.col("_p.ts"))
    # 1 and -1: jumps, 0: a break, 2: calm for too long after a jump
    sure = F.when(slope.isNull(), 0.0).when(F.abs(slope) > limit, F.signum(slope))
    rows = carried(rows.withColumn("kind", sure), "_e", F.when(F.col("kind").isNotNull(), F.struct("kind", "ts")), ["_i"], own=False, by=by)
    late = (F.col("_e.kind") != 0) & (us("_p.ts") - us("_e.ts") > micros)
    rows = rows.withColumns({"kind": F.coalesce("kind", F.when(late, 2.0)), "_before": F.col("_p.ts")}).drop("_p", "_n", "_e")
    told = stored(rows, "slopes")
    events = _beside(told.where("kind is not null").select(by, KEY, "_i", "ts", "kind", "_before"), F.struct("kind", "ts"), by)
    first = jump & ~F.coalesce(F.col("_p.kind").isin(-1.0, 1.0), F.lit(False))
    start = first | (jump & (F.col("_p.kind") != F.col("kind")))
    single = start & ~F.coalesce(F.col("_n.kind") == F.col("kind"), F.lit(False))
    events = events.withColumns({"first": first, "start": start, "anchor": first | (start & ~single), "_since": us("_before") - us("_p.ts")}).drop("_p", "_n")
    events = running(events, "run", F.col("start").cast("long"), ["_i"], by=by)
    events = carried(events, "_from", F.when(F.col("anchor"), F.col("run")), ["_i"], own=False, by=by)
    met_open = F.col("start") & ~F.col("first") & ((F.col("run") - F.col("_from")) % 2 == 1)
    events = stored(events.withColumn("closing", met_open).select(by, KEY, "_i", "kind", "start", "closing", "_since"), "events")
    turns = _beside(events, F.struct((jump & ~F.col("closing")).alias("open")), by)
    was_open = F.coalesce("_p.open", F.lit(False))
    ended = F.when(F.col("closing"), True).when(was_open & (F.col("kind") == 0), F.col("_since") <= micros).when(was_open & (F.col("kind") == 2), False)
    opened = jump & ~F.col("closing") & (F.col("start") | ~was_open)
    turns = carried(turns.withColumns({"_ended": ended, "_opened": opened}).drop("_p", "_n"), "_fate", F.col("_ended"), ["_i"], forward=True, own=False, by=by)
    mark = F.when(F.col("_opened"), F.coalesce("_fate", F.lit(True))).when(F.col("_ended").isNotNull(), False)
    marked = told.join(turns.select(by, KEY, "_i", mark.alias("_mark")).where("_mark is not null"), [by, KEY, "_i"], "left")
    out = carried(marked, "_gone", F.col("_mark"), ["_i"], by=by).withColumn("value", F.when(~F.coalesce("_gone", F.lit(False)), F.col("value")))
    out = stored(out.select(columns), "excursions")
    dropped(told, events)
    return out


def _stretches(rows: DataFrame, by: str) -> DataFrame:
    """Adds _from, the number of the last missing row up to this one (0: none), and _end, that of the series' last row."""
    gone, every = F.when(F.col("value").isNull(), F.col("_i")), Window.unboundedPreceding
    inside = F.max(gone).over(Window.partitionBy(by, KEY).orderBy("_i").rowsBetween(every, 0))
    edges = rows.groupBy(by, KEY).agg(F.max(gone).alias("_gone"), F.max("_i").alias("_top"))
    edge = F.max("_gone").over(Window.partitionBy(by).orderBy(KEY).rowsBetween(every, -1))
    edges = edges.select(by, KEY, edge.alias("_edge"), F.max("_top").over(Window.partitionBy(by)).alias("_end"))
    return rows.withColumn("_inside", inside).join(edges, [by, KEY]).withColumn("_from", F.coalesce("_inside", "_edge", F.lit(0))).drop("_inside", "_edge")


def _settle(columns: list[str], limit: float, longest: float, rounds: int) -> Callable[[pa.Table], pa.Table]:
    """Of one chunk, whole stretches of a series: its rows with anomalies made missing."""

    def run(chunk: pa.Table) -> pa.Table:
        chunk = chunk.sort_by("_i")
        times, values = chunk["ts"].cast(pa.int64()).to_numpy(), np.array(chunk["value"].to_numpy(), dtype=float)
        ends_series = chunk["_i"][-1].as_py() == chunk["_end"][0].as_py()
        starts = np.union1d([0], np.flatnonzero(np.isnan(values)))
        jumps = np.add.reduceat(np.abs(slopes(times, values, MINUTE)) > limit, starts)
        for a, b in zip(starts[jumps > 0].tolist(), np.append(starts[1:], len(values))[jumps > 0].tolist(), strict=True):
            if b == len(values) and ends_series:
                values[a:] = detect(times[a:], values[a:], limit, longest, MINUTE, rounds)
            else:  # a missing row follows
                values[a:b] = detect(np.append(times[a:b], times[b - 1]), np.append(values[a:b], np.nan), limit, longest, MINUTE, rounds)[:-1]
        return chunk.set_column(chunk.column_names.index("value"), "value", pa.array(values, from_pandas=True)).select(columns)

    return run


def _split(rows: DataFrame, by: str) -> tuple[DataFrame, DataFrame | None]:
    """(rows of stretches of at most CHUNK rows, the others), with _from and _end; after each of the others a missing row is added."""
    runs = rows.groupBy(by, "_from", "_end").agg(F.count("*").alias("_n"), F.max("_i").alias("_last"), F.max("ts").alias("ts"), F.max(KEY).alias(KEY))
    long = stored(runs.where(F.col("_n") > CHUNK), "long")
    if long.isEmpty():
        dropped(long)
        return rows, None
    which = long.select(by, "_from")
    added = long.where("_last < _end").select(by, "_from", "_end", KEY, "ts", (F.col("_last") + 1).alias("_i"), F.lit(True).alias("_added"))
    return rows.join(which, [by, "_from"], "left_anti"), rows.join(which, [by, "_from"], "left_semi").unionByName(added, allowMissingColumns=True)


def sbad(series: DataFrame, max_change: float, max_length: float, max_gap: float | None = None, digits: int | None = None, split_gap: float | None = None) -> DataFrame:
    """max_change in units a minute, max_length and max_gap in minutes. Runs jobs: each pass is written as a table.

    split_gap: after a gap longer than so many minutes a series starts anew, as in a stream. Passes over long stretches end when
    two in turn have removed nothing anywhere, or no stretch is long any more.
    """
    by, columns = "series_id", series.columns
    rows = series.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    if split_gap is not None:
        rows = gaps(rows).withColumn("_cut", (F.coalesce("gap_s", F.lit(0.0)) > split_gap * 60).cast("long"))
        rows = running(bucketed(rows), "_part", F.col("_cut"), ORDER).withColumn("_series", F.struct("series_id", "_part")).select("_series", *columns)
        by = "_series"
    # even numbers: an odd one is that of an added row
    rows = stored(numbered(bucketed(rows), "_i", ORDER, by=by).withColumns({"_i": F.col("_i") * 2, "_added": F.lit(False)}), "sbad")
    done = []
    for k in range(ROUNDS):
        told = stored(_stretches(rows, by), "stretches")
        dropped(rows)
        short, long = _split(told, by)
        chunks = short.withColumn("_chunk", F.floor(F.col("_from") / (2 * CHUNK))).groupBy(by, "_chunk")
        kept = [*columns, "_added"]
        done.append(stored(chunks.applyInArrow(_settle(kept, max_change, max_length, ROUNDS - k), short.select(kept).schema), "settled"))
        if long is None:
            dropped(told)
            break
        rest = stored(long.drop("_from", "_end"), "rest")
        dropped(told)
        trimmed = stored(_trimmed(rest, by, max_change), "trimmed")
        rows = _without_excursions(trimmed, by, max_change, max_length)
        missing = [t.where("value is null").count() for t in (rest, rows)]
        dropped(rest, trimmed)
        if missing[0] == missing[1] or k == ROUNDS - 1:
            done.append(rows.select(kept))
            break
    out = done[0]
    for other in done[1:]:
        out = out.unionByName(other)
    return fill_gaps(out.where("not _added").select(columns), max_gap, digits)
