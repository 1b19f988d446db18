"""Delimited text to series: detection on a few lines in the driver, the rest as one lazy plan."""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalar import clean_time, date_and_time, local_to_utc, strip_trailing_delimiters, to_number

# The date formats that are tried, in this order.
FORMATS = [
    # ISO 8601
    "yyyy-MM-dd'T'HH:mm:ssxx",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxx",
    "yyyy-MM-dd'T'HH:mmxx",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm",
    # with a space
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    # day first, points or slashes
    "dd.MM.yyyy HH:mm:ss",
    "dd.MM.yyyy HH:mm:ss.SSSSSS",
    "dd.MM.yyyy HH:mm",
    "dd.MM.yyyy",
    "dd/MM/yyyy HH:mm:ss",
    "dd/MM/yyyy HH:mm:ss.SSSSSS",
    "dd/MM/yyyy HH:mm",
    "dd/MM/yyyy",
    # month first
    "MM/dd/yyyy HH:mm:ss",
    "MM/dd/yyyy HH:mm",
    "MM/dd/yyyy",
    "MM-dd-yyyy HH:mm:ss",
    "MM-dd-yyyy HH:mm",
    "MM-dd-yyyy",
    # year first, slashes
    "yyyy/MM/dd HH:mm:ss",
    "yyyy/MM/dd HH:mm:ss.SSSSSS",
    "yyyy/MM/dd HH:mm",
    "yyyy/MM/dd",
    # day first, dashes
    "dd-MM-yyyy HH:mm:ss",
    "dd-MM-yyyy HH:mm:ss.SSSSSS",
    "dd-MM-yyyy HH:mm",
    "dd-MM-yyyy",
    # without separators
    "yyyyMMdd HH:mm:ss",
    "yyyyMMddHHmmss",
    "yyyyMMdd",
    # times alone
    "HH:mm:ss.SSSSSS",
    "HH:mm:ss",
    "HH:mm",
    # twelve hours
    "yyyy-MM-dd hh:mm:ss a",
    "yyyy-MM-dd hh:mm a",
    "dd.MM.yyyy hh:mm:ss a",
    "dd.MM.yyyy hh:mm a",
    "dd/MM/yyyy hh:mm:ss a",
    "MM/dd/yyyy hh:mm:ss a",
]


@dataclass(frozen=True)
class TextSpec:
    """delimiter, encoding: None to detect them; time, date and value: 0-based columns; zone: of the times in the file."""

    delimiter: str | None = None
    header: bool = True
    time: int = 0
    date: int | None = None
    value: int = 1
    format: str | None = None
    zone: str = "UTC"
    encoding: str | None = "UTF-8"


def consistent_delimiter(lines: list[str]) -> str:
    """Of comma, semicolon and tab the one that gives the most columns, equally many in all lines; else a comma."""
    best, most = ",", 1
    for d in (",", ";", "\t"):
        counts = {len(line.split(d)) for line in lines if line.strip()}
        if len(counts) == 1 and (n := counts.pop()) > most:
            best, most = d, n
    return best


def frequent_delimiter(line: str) -> str:
    """The most frequent of semicolon, comma, tab and bar in a line; a semicolon if there is none."""
    return max((";", ",", "\t", "|"), key=line.count) if line else ";"


def sniffed_delimiter(text: str) -> str | None:
    try:
        return csv.Sniffer().sniff(text[:5000], delimiters=",;\t|").delimiter
    except csv.Error:
        return None


def header_columns(line: str) -> tuple[str, list[str]]:
    """(separator, names) of a header with a UTC column and 2 to 100 columns; ValueError otherwise."""
    sep = next((d for d in (";", "\t", ",") if d in line), None)
    names = [n.strip() for n in line.split(sep)] if sep else []
    if not 2 <= len(names) <= 100 or "UTC" not in names:
        raise ValueError("the header needs 2 to 100 columns, one of them named UTC")
    return sep, names


def unique_names(names: list[str]) -> list[str]:
    """Repeated names get a number: Temp, Temp.1."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        k = seen.get(n, 0)
        seen[n] = k + 1
        out.append(f"{n}.{k}" if k else n)
    return out


def head(spark: SparkSession, path: str, n: int = 5, encoding: str = "UTF-8") -> list[str]:
    """The first lines of a text file, without a byte order mark."""
    return raw_head(spark, path, n).decode(encoding, "ignore").lstrip("\ufeff").splitlines()[:n]


def raw_head(spark: SparkSession, path: str, n: int) -> bytes:
    """The bytes of the first lines, whatever they are encoded in."""
    rows = spark.read.text(path).select(F.col("value").cast("binary")).limit(n).collect()
    return b"\n".join(bytes(r[0]) for r in rows)


def read_strings(spark: SparkSession, path: str, delimiter: str, header: bool, encoding: str = "UTF-8") -> DataFrame:
    """All columns as text, malformed lines dropped, named by the header (repeated names numbered) or '0', '1'..."""
    first = head(spark, path, 1, encoding)
    cells = next(csv.reader(first, delimiter=delimiter)) if first else []
    names = unique_names([c.strip() for c in cells]) if header else [str(i) for i in range(len(cells))]
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    wide = encoding.upper().startswith("UTF-16")  # its lines can't be split by bytes: a file is one task's
    out = spark.read.csv(path, schema=schema, sep=delimiter, header=header, encoding=encoding, mode="DROPMALFORMED", enforceSchema=True, multiLine=wide)
    return out.toDF(*names)


def encoding_of(first: bytes) -> str:
    """By a file's first bytes: what its byte order mark says; else UTF-8 if they can be read so, else Latin 1."""
    marks = ((b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE"), (b"\xef\xbb\xbf", "UTF-8"))
    for mark, name in marks:
        if first.startswith(mark):
            return name
    try:
        first[:-3].decode() if len(first) > 3 else first.decode()  # the cut may lie within a character
    except UnicodeDecodeError as e:
        return "UTF-8" if e.start >= len(first) - 6 and e.reason == "unexpected end of data" else "ISO-8859-1"
    return "UTF-8"


def detect_encoding(spark: SparkSession, path: str, lines: int = 50) -> str:
    """The encoding of a text file, from its first lines."""
    return encoding_of(raw_head(spark, path, lines))


def pick_columns(names: list[str], terms: tuple[str, ...], time: str = "UTC") -> str:
    """The first column whose name holds one of the terms in any case, else the first that isn't the time."""
    found = [n for n in names if any(t in n.lower() for t in terms)] or [n for n in names if n != time]
    if not found:
        raise ValueError("there is no column beside the time")
    return found[0]


# What names of load columns hold.
LOAD_TERMS = ("last", "load", "leistung", "kw", "w")


def with_original(df: DataFrame, time: str = "UTC") -> DataFrame:
    """Measurement columns as numbers, each with the text it came from beside it as <name>_original."""
    names = [c for c in df.columns if c != time]
    if not names:
        raise ValueError("there is no measurement column")
    return df.select(*[F.col(f"`{time}`")] * (time in df.columns), *[c for n in names for c in (to_number(F.col(f"`{n}`")).alias(n), F.col(f"`{n}`").alias(f"{n}_original"))])


def safe_name(name: str) -> str:
    """The last part of a path without control characters; ValueError if it is empty or climbs up."""
    out = "".join(c for c in name.strip() if c.isprintable()).rpartition("/")[2]
    if not out or ".." in out:
        raise ValueError(f"{name!r} is no file name")
    return out


def detect_format(df: DataFrame, column: str, custom: str | None = None, cleaned: bool = False) -> str | None:
    """The first format by which any row of the column can be read: one aggregate over all formats."""
    formats = ([custom] if custom else []) + FORMATS
    c = F.trim(clean_time(F.col(column))) if cleaned else F.trim(column)
    row = df.agg(*[F.count(F.try_to_timestamp(c, F.lit(f))).alias(f"f{i}") for i, f in enumerate(formats)]).first()
    return next((f for i, f in enumerate(formats) if row[i]), None)


def standardise(df: DataFrame, spec: TextSpec, series_id: str = "series") -> DataFrame:
    """(series_id, ts, value, row_pos) in UTC; rows without a readable time are dropped.

    row_pos is unique and grows with the place in the input within a partition.
    """
    names = df.columns
    time = F.col(f"`{names[spec.time]}`")
    if spec.date is not None:
        time = date_and_time(F.col(f"`{names[spec.date]}`"), time)
    rows = df.select(time.alias("_time"), F.col(f"`{names[spec.value]}`").alias("_raw"), F.monotonically_increasing_id().alias("row_pos"))
    joined = spec.date is not None  # only these are cleaned: a time in one column may end in AM or PM
    fmt = detect_format(rows, "_time", spec.format, joined)
    if fmt is None:
        raise ValueError("no known format fits the time column")
    ts: Column = F.try_to_timestamp(F.trim(clean_time(F.col("_time"))) if joined else F.trim("_time"), F.lit(fmt))
    if "xx" not in fmt and spec.zone != "UTC":
        ts = local_to_utc(ts, spec.zone)
    return rows.select(F.lit(series_id).alias("series_id"), ts.alias("ts"), to_number(F.col("_raw")).alias("value"), "row_pos").where("ts is not null")


def read_series(spark: SparkSession, path: str, spec: TextSpec, series_id: str | None = None) -> DataFrame:
    encoding = spec.encoding or detect_encoding(spark, path)
    sample = head(spark, path, encoding=encoding)
    found = consistent_delimiter(sample)
    if spec.delimiter is not None and spec.delimiter != found:
        raise ValueError(f"the delimiter is {found!r}, not {spec.delimiter!r}")
    return standardise(read_strings(spark, path, found, spec.header, encoding), spec, series_id or path.rsplit("/", 1)[-1])


def from_base64(df: DataFrame, column: str) -> DataFrame:
    """The lines of base64-encoded text, one a row, trailing delimiters cut; columns_of() splits them."""
    lines = F.split(F.decode(F.unbase64(column), "UTF-8"), "\r?\n")
    return df.select(F.explode(lines).alias("line")).where("line != ''").select(strip_trailing_delimiters(F.col("line"), ";").alias("line"))


def columns_of(lines: DataFrame, names: list[str], delimiter: str = ";") -> DataFrame:
    """Lines split at the delimiter into text columns; cells that a line lacks are null."""
    cells = F.split("line", re.escape(delimiter), -1)
    return lines.select(*[F.get(cells, F.lit(i)).alias(n) for i, n in enumerate(names)])


def rows_of_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, bytes): data rows below the header, and the size, of each text file of a folder."""
    lines = spark.read.text(path).select("_metadata.file_path", "_metadata.file_size", "value").where("value != ''")
    return lines.groupBy(F.col("file_path").alias("file")).agg((F.count("*") - 1).alias("n"), F.first("file_size").alias("bytes"))


def check_strict(series_rows: DataFrame, names: list[str], path: str, delimiter: str, fmt: str = "yyyy-MM-dd HH:mm:ss") -> None:
    """The eight checks of the strict format; ValueError names the first that fails.

    series_rows: two text columns.
    """
    from tidemark.operators.info import step_deviation

    if not path.lower().endswith(".csv"):
        raise ValueError("the file name must end in .csv")
    if delimiter != ";":
        raise ValueError("the delimiter must be a semicolon")
    if len(names) != 2:
        raise ValueError("there must be two columns")
    if names[0] != "UTC":
        raise ValueError("the first column must be named UTC")
    ts = F.try_to_timestamp(F.col(f"`{names[0]}`"), F.lit(fmt))
    rows = series_rows.select(F.lit("s").alias("series_id"), ts.alias("ts"), to_number(F.col(f"`{names[1]}`")).alias("value"), F.monotonically_increasing_id().alias("row_pos"))
    n, bad, times = rows.agg(F.count("*"), F.count_if(F.col("ts").isNull()), F.count_distinct("ts")).first()
    if n < 2:
        raise ValueError("there must be two rows or more")
    if bad:
        raise ValueError(f"{bad} times aren't of the format {fmt}")
    if times != n:
        raise ValueError("times are repeated")
    if (step_deviation(rows).first()["deviation"] or 0) > 0.001:
        raise ValueError("the time step varies by more than 0.1 %")
