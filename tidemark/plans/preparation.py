"""The preparation chains: adjusting series to one grid, and the cleaning pipeline."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import clean, sbad
from tidemark.operators.info import timestep
from tidemark.operators.regrid import RegridSpec, first_per_time, regrid
from tidemark.plans.lineage import checkpointed


def adjust(series: DataFrame, spec: RegridSpec) -> DataFrame:
    """Series whose step and offset already are the wanted ones stay as they are; the others are regridded."""
    steps = timestep(series)
    aligned = steps.where((F.col("step_min") == spec.step) & (F.col("offset_min") == spec.offset)).select("series_id")
    rest = series.join(aligned, "series_id", "left_anti")
    same = first_per_time(series.join(aligned, "series_id", "left_semi")).select("series_id", "ts", "value")
    return same.unionByName(regrid(rest, spec))


@dataclass(frozen=True)
class CleanSpec:
    """Limits in minutes and units; a step without its limit is left out."""

    constant_min: float | None = None
    zeros: bool = False
    low: float | None = None
    high: float | None = None
    max_change: float | None = None
    max_length: float | None = None
    short_min: float | None = None
    max_gap: float | None = None
    digits: int | None = None

    def __post_init__(self):
        for name in ("constant_min", "max_change", "max_length", "short_min", "max_gap"):
            v = getattr(self, name)
            if v is not None and (isinstance(v, bool) or not isinstance(v, int | float) or v < 0):
                raise ValueError(f"{name} must be a number of 0 or more")
        if self.low is not None and self.high is not None and self.low >= self.high:
            raise ValueError("low must be below high")
        if (self.max_change is None) != (self.max_length is None):
            raise ValueError("max_change and max_length go together")
        if self.digits is not None and not 0 <= self.digits <= 15:
            raise ValueError("digits must be between 0 and 15")


def cleaned(series: DataFrame, spec: CleanSpec) -> DataFrame:
    """Constant runs, zeros, range and slopes, each followed by gap filling, then short runs.

    Each filled result is checkpointed, so this runs jobs.
    """
    columns = series.columns

    def fill(df: DataFrame) -> DataFrame:
        return checkpointed(clean.fill_gaps(df, spec.max_gap, spec.digits).select(columns))

    if spec.constant_min is not None:
        # filling reads its input twice; the other steps below are cheap to read again
        series = fill(checkpointed(clean.drop_constant_runs(series, spec.constant_min)))
    if spec.zeros:
        series = fill(clean.drop_zeros(series))
    if spec.low is not None or spec.high is not None:
        series = fill(clean.clip_range(series, spec.low, spec.high))
    if spec.max_change is not None:
        series = fill(sbad.sbad(series, spec.max_change, spec.max_length))
    return clean.drop_short_runs(series, spec.short_min)
