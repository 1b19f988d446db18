"""Writers: delimited text, JSON lines, previews and plot data."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import safe_cell

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def as_text(series: DataFrame, missing: str = "") -> DataFrame:
    """(UTC, value) as text; missing values as the given word."""
    return series.select(F.date_format("ts", TIME_FORMAT).alias("UTC"), F.coalesce(F.col("value").cast("string"), F.lit(missing)).alias("value"))


def write_csv(df: DataFrame, path: str, safe: bool = False, mode: str = "error") -> None:
    """Semicolon-separated text; safe: no cell that a spreadsheet takes as a formula."""
    if safe:
        df = df.select(*[safe_cell(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
    df.write.mode(mode).option("sep", ";").option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def write_samples(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def stream_lines(df: DataFrame, chunk: int = 50_000) -> Iterator[str]:
    """JSON lines for a client: a first line with the number of rows, chunks of rows, a last line. One partition
    at a time comes to the driver."""
    yield json.dumps({"type": "meta", "total_rows": df.count()})
    rows: list = []
    for r in df.select(F.to_json(F.struct("*"))).toLocalIterator():
        rows.append(json.loads(r[0]))
        if len(rows) == chunk:
            yield json.dumps({"type": "data", "data": rows})
            rows = []
    if rows:
        yield json.dumps({"type": "data", "data": rows})
    yield json.dumps({"type": "complete", "success": True})


def preview(df: DataFrame, n: int = 100, order: str = "ts") -> DataFrame:
    return df.orderBy(order).limit(n)


def trace(series: DataFrame, name: str, y: str = "value") -> DataFrame:
    """One row a series with a JSON trace (x: ISO times, y: values or null), for results small enough to plot."""
    point = F.array_sort(F.collect_list(F.struct("ts", F.when(~F.isnan(y), F.col(y)).alias("y"))))
    return series.groupBy("series_id").agg(point.alias("_p")).select(
        "series_id",
        F.to_json(F.struct(F.lit(name).alias("name"), F.transform("_p", lambda p: F.date_format(p.ts, "yyyy-MM-dd'T'HH:mm:ss")).alias("x"), F.transform("_p", lambda p: p.y).alias("y")), {"ignoreNullFields": "false"}).alias("trace"),
    )
