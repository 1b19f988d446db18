"""Supervised windows: for each reference time the values of all series at the steps of their horizons.

Rows stay long, (utc_ref, feature, step, value), until the last aggregate makes one row a sample.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.clean import ORDER
from tidemark.operators.ordered import asof, bucketed, numbered, running


@dataclass(frozen=True)
class Horizon:
    """Steps of a feature: n points from start_h to end_h hours after the reference time.

    method: "linear", "nearest" (the next value, else the one before) or "average" over [start, end).
    """

    feature: str
    start_h: float
    end_h: float
    n: int
    method: str = "linear"


def steps(refs: DataFrame, h: Horizon) -> DataFrame:
    """(utc_ref, feature, step, ts) of all reference times."""
    width = (h.end_h - h.start_h) * 3.6e9 / (h.n - 1) if h.n > 1 else 0
    at = F.unix_micros("utc_ref") + h.start_h * 3.6e9 + F.col("step") * width
    return refs.select("utc_ref", F.lit(h.feature).alias("series_id"), F.explode(F.sequence(F.lit(0), F.lit(h.n - 1))).alias("step")).withColumn("ts", F.timestamp_micros(at.cast("long")))


def _sampled(series: DataFrame, refs: DataFrame, h: Horizon) -> DataFrame:
    own = series.where(F.col("series_id") == h.feature)
    near = asof(steps(refs, h), own)
    p, n = F.col("prior.value"), F.col("next.value")
    tp, tn, t = F.unix_micros("prior.ts"), F.unix_micros("next.ts"), F.unix_micros("ts")
    if h.method == "linear":  # a missing neighbour is a barrier
        value = F.when(tp == tn, p).otherwise(p + (n - p) * ((t - tp) / (tn - tp)))
    else:
        value = F.when(F.col("next").isNotNull(), n).otherwise(p)
    return near.select("utc_ref", F.col("series_id").alias("feature"), "step", value.alias("value"))


def _averaged(series: DataFrame, refs: DataFrame, h: Horizon) -> DataFrame:
    """The mean of the values in [ref + start, ref + end), repeated at all steps.

    Time is cut into buckets as wide as the window, which lies in two of them at most; in each it is a difference
    of two sums from the bucket's start, so no sum is larger than a window's. A window that holds a value that
    isn't finite has none.
    """
    width = max(int((h.end_h - h.start_h) * 3.6e9), 1)
    own = series.where((F.col("series_id") == h.feature) & F.col("value").isNotNull())
    finite = ~F.isnan("value") & (F.abs("value") < float("inf"))
    own = own.withColumn("series_id", F.floor(F.unix_micros("ts") / width).cast("string")).withColumn("_known", F.when(finite, F.col("value")).otherwise(0.0)).withColumn("_other", F.when(finite, 0).otherwise(1))
    own = bucketed(own)
    for name, what in (("_s", F.col("_known")), ("_c", F.lit(1)), ("_x", F.col("_other"))):
        own = running(own, name, what, ORDER)
    last = own.groupBy("series_id", "ts").agg(F.max_by(F.struct("_s", "_c", "_x"), "row_pos").alias("value")).withColumn("row_pos", F.lit(0))
    lo, hi = (F.unix_micros("utc_ref") + F.lit(int(e * 3.6e9)) for e in (h.start_h, h.end_h))
    at = refs.select("utc_ref", lo.alias("_lo"), hi.alias("_hi")).withColumn("_b", F.explode(F.expr(f"sequence(floor(_lo / {width}), floor((_hi - 1) / {width}))")))
    edges = F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.expr(f"greatest(_lo, _b * {width})").alias("edge")), F.struct(F.lit(1).alias("sign"), F.expr(f"least(_hi, (_b + 1) * {width})").alias("edge"))))
    # one microsecond before the edge: what comes before [ and what comes before )
    at = at.select("utc_ref", F.col("_b").cast("string").alias("series_id"), edges.alias("_e")).select("utc_ref", "series_id", "_e.sign", F.timestamp_micros(F.col("_e.edge") - 1).alias("ts"))
    near = asof(at, last)
    total = lambda name: F.sum(F.col("sign") * F.coalesce(F.col(f"prior.value.{name}"), F.lit(0)))
    mean = near.groupBy("utc_ref").agg(F.when((total("_c") > 0) & (total("_x") == 0), total("_s") / total("_c")).alias("value"))
    return mean.select("utc_ref", F.lit(h.feature).alias("feature"), F.explode(F.sequence(F.lit(0), F.lit(h.n - 1))).alias("step"), "value")


def long_windows(series: DataFrame, refs: DataFrame, horizons: list[Horizon]) -> DataFrame:
    """(utc_ref, feature, step, value) for every reference time, feature and step."""
    out = None
    for h in horizons:
        one = (_averaged if h.method == "average" else _sampled)(series, refs, h)
        out = one if out is None else out.unionAll(one)
    return out


def complete(windows: DataFrame, expected: int) -> DataFrame:
    """Windows of the reference times that lack none of the expected values."""
    good = windows.groupBy("utc_ref").agg(F.count("value").alias("n")).where(F.col("n") == expected).select("utc_ref")
    return windows.join(good, "utc_ref", "left_semi")


def samples(windows: DataFrame, horizons: list[Horizon], name: str = "x") -> DataFrame:
    """(utc_ref, x array<array<float>>): steps x features, for complete samples."""
    order = {h.feature: i for i, h in enumerate(horizons)}
    place = F.create_map(*[F.lit(v) for kv in order.items() for v in kv])[F.col("feature")]
    rows = complete(windows, sum(h.n for h in horizons)).withColumn("_f", place)
    by_step = rows.groupBy("utc_ref", "step").agg(F.transform(F.array_sort(F.collect_list(F.struct("_f", "value"))), lambda s: s.value.cast("float")).alias("v"))
    return by_step.groupBy("utc_ref").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "v"))), lambda s: s.v).alias(name))


def reference_range(info: DataFrame) -> DataFrame:
    """(start, end): the smallest first and the smallest last time of the input series."""
    return info.agg(F.min("utc_min").alias("start"), F.min("utc_max").alias("end"))


def reference_grid(span: DataFrame, step_min: int, offset_min: int = 0) -> DataFrame:
    """(utc_ref) from an hour before the start's hour plus the offset, in steps, from the start on."""
    step, t0 = step_min * 60, "s - pmod(s, 3600) - 3600"
    s = span.select(F.unix_seconds("start").alias("s"), F.unix_seconds("end").alias("e"))
    first = F.expr(f"{t0} + {offset_min * 60} + cast(ceil((s - ({t0} + {offset_min * 60})) / {step}) as bigint) * {step}")
    return s.select(F.explode(F.sequence(first, F.col("e"), F.lit(step).cast("long"))).alias("g")).select(F.timestamp_seconds("g").alias("utc_ref"))


#: Rows of a series in which one task finds the windows.
STRETCH = 100_000


def sliding(series: DataFrame, length: int, ahead: int = 1) -> DataFrame:
    """(series_id, i, x array, y): each run of so many values and the value after it, or with ahead > 1 the array of those.

    A series is cut into stretches, each with the first rows of the next one, so no row is copied more than once.
    """
    rows = numbered(bucketed(series), "i", ORDER).select("series_id", "i", F.coalesce("value", F.lit(float("nan"))).alias("value"))
    stretch, size = F.floor((F.col("i") - 1) / STRETCH), length + ahead
    early = ((F.col("i") - 1) % STRETCH < size - 1) & (stretch > 0)
    rows = rows.withColumn("_own", stretch).withColumn("_stretch", F.explode(F.when(early, F.array(stretch, stretch - 1)).otherwise(F.array(stretch))))
    w = Window.partitionBy("series_id", "_stretch").orderBy("i")
    values = [F.lead("value", k).over(w) for k in range(size)]
    rows = rows.select("series_id", "i", "_own", "_stretch", F.array(*values).alias("_v"), F.lead("i", size - 1).over(w).alias("_last"))
    after = F.element_at("_v", -1) if ahead == 1 else F.slice("_v", length + 1, ahead)
    return rows.where("_own = _stretch and _last is not null").select("series_id", "i", F.slice("_v", 1, length).alias("x"), after.alias("y"))


def pairs(series: DataFrame, refs: DataFrame, inputs: list[Horizon], outputs: list[Horizon]) -> DataFrame:
    """(utc_ref, x, y): input and output samples of the reference times at which both are complete."""
    return samples(long_windows(series, refs, inputs), inputs, "x").join(samples(long_windows(series, refs, outputs), outputs, "y"), "utc_ref")


def pair_range(info: DataFrame, inputs: list[str], outputs: list[str], start_h: float, end_h: float) -> DataFrame:
    """(start, end) of the reference times: from the latest first input plus the past that a sample needs (start_h is
    0 or less) to the earliest last output minus the time ahead."""
    lo = F.max(F.when(F.col("series_id").isin(inputs), F.unix_micros("utc_min"))) - F.lit(int(start_h * 3.6e9))
    hi = F.min(F.when(F.col("series_id").isin(outputs), F.unix_micros("utc_max"))) - F.lit(int(end_h * 3.6e9))
    return info.agg(F.timestamp_micros(lo).alias("start"), F.timestamp_micros(hi).alias("end"))


def calendar_steps(refs: DataFrame, h: Horizon, over_horizon: bool) -> DataFrame:
    """The steps' times for calendar features: those of the horizon, or the reference time at every step."""
    out = steps(refs, h)
    return out if over_horizon else out.withColumn("ts", F.col("utc_ref"))


def rank_over(df: DataFrame, key: str, order: str) -> DataFrame:
    """Adds n, the place within the key."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(order)))
