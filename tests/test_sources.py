"""Readers and writers through files: what is written is what is read."""

import base64
import datetime as dt
import json

import pytest

from tidemark.functions import scalar
from tidemark.operators import forecast, scale
from tidemark.sources import sinks, text

ROWS = [(dt.datetime(2024, 1, 1, h, 15), None if h == 3 else h * 1.5) for h in range(8)]


def lines(sep=";", time="%Y-%m-%d %H:%M:%S"):
    return [f"UTC{sep}load", *[f"{t.strftime(time)}{sep}{'' if v is None else v}" for t, v in ROWS]]


def put(folder, name, content, encoding="utf-8", mark=b""):
    path = folder / name
    path.write_bytes(mark + "\n".join(content).encode(encoding))
    return str(path)


def series(df):
    return sorted((r["ts"], r["value"]) for r in df.collect())


@pytest.mark.parametrize("sep", [",", ";", "\t"])
@pytest.mark.parametrize("time", ["%Y-%m-%d %H:%M:%S", "%d.%m.%Y %H:%M", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %I:%M:%S %p", "%d.%m.%Y %I:%M %p"])
def test_read_series(spark, tmp_path, sep, time):
    path = put(tmp_path, "a.csv", lines(sep, time))
    out = text.read_series(spark, path, text.TextSpec())
    assert series(out) == ROWS
    assert out.first()["series_id"] == "a.csv"


def test_twelve_hour_afternoon(spark):
    rows = spark.createDataFrame([("2024-01-15 02:30:00 PM", "1")], "t string, v string")
    assert series(text.standardise(rows, text.TextSpec())) == [(dt.datetime(2024, 1, 15, 14, 30), 1.0)]


def test_wrong_delimiter(spark, tmp_path):
    with pytest.raises(ValueError, match="delimiter"):
        text.read_series(spark, put(tmp_path, "a.csv", lines(";")), text.TextSpec(delimiter=","))


def test_no_time(spark, tmp_path):
    with pytest.raises(ValueError, match="no known format"):
        text.read_series(spark, put(tmp_path, "a.csv", ["UTC;load", "x;1", "y;2"]), text.TextSpec())


def test_date_and_time_columns(spark):
    rows = spark.createDataFrame([("2024-03-01 00:00:00", "12:30:00 h", "7")], "d string, t string, v string")
    assert series(text.standardise(rows, text.TextSpec(date=0, time=1, value=2))) == [(dt.datetime(2024, 3, 1, 12, 30), 7.0)]


def test_local_time(spark):
    rows = spark.createDataFrame([("2024-07-01 12:00:00", "1"), ("2024-03-31 02:30:00", "2")], "t string, v string")
    assert series(text.standardise(rows, text.TextSpec(zone="Europe/Vienna"))) == [(dt.datetime(2024, 7, 1, 10), 1.0)]
    one = spark.createDataFrame([(dt.datetime(2024, 7, 1, 10),)], "ts timestamp").select(scalar.utc_to_local("ts").alias("l")).first()["l"]
    assert one == dt.datetime(2024, 7, 1, 12)


@pytest.mark.parametrize(("encoding", "mark", "found"), [("utf-8", b"", "UTF-8"), ("utf-8", b"\xef\xbb\xbf", "UTF-8"), ("utf-16-le", b"\xff\xfe", "UTF-16LE"), ("utf-16-be", b"\xfe\xff", "UTF-16BE"), ("latin-1", b"", "ISO-8859-1")])
def test_encodings(spark, tmp_path, encoding, mark, found):
    content = ["Zeit;Größe", *lines()[1:]]
    path = put(tmp_path, "a.csv", content, encoding, mark)
    assert text.encoding_of(open(path, "rb").read()) == found
    assert text.detect_encoding(spark, path) == found
    assert text.head(spark, path, 1, found) == ["Zeit;Größe"]
    assert series(text.read_series(spark, path, text.TextSpec(encoding=None))) == ROWS


def test_cut_within_a_character():
    assert text.encoding_of("aé".encode()[:-1]) == "UTF-8"
    assert text.encoding_of(b"") == "UTF-8"


def test_delimiters():
    assert text.consistent_delimiter(["a;b;c", "1;2;3"]) == ";"
    assert text.consistent_delimiter(["a;b", "1"]) == ","
    assert text.frequent_delimiter("a|b|c;d") == "|"
    assert text.frequent_delimiter("") == ";"
    assert text.sniffed_delimiter("a;b\n1;2\n3;4\n") == ";"
    assert text.header_columns("UTC; a ;b") == (";", ["UTC", "a", "b"])
    for bad in ("a;b", "UTC", "UTC;" + ";".join("x" * 1 for _ in range(100))):
        with pytest.raises(ValueError, match="header"):
            text.header_columns(bad)
    assert text.unique_names(["T", "T", "x", "T"]) == ["T", "T.1", "x", "T.2"]


def test_malformed_lines_and_repeated_names(spark, tmp_path):
    path = put(tmp_path, "a.csv", ["UTC;v;v", "2024-01-01 00:00:00;1;2", "2024-01-01 01:00:00;1;2;3;4", '2024-01-01 02:00:00;"5";6'])
    out = text.read_strings(spark, path, ";", True)
    assert out.columns == ["UTC", "v", "v.1"]
    assert [r["v"] for r in out.orderBy("UTC").collect()] in (["1", "5"], ["1", "1", "5"])


def test_folder_of_parts(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    put(folder, "1.csv", lines()[:4])
    put(folder, "2.csv", [lines()[0], *lines()[4:]])
    assert series(text.standardise(text.read_strings(spark, str(folder), ";", True), text.TextSpec())) == ROWS
    sizes = text.rows_of_files(spark, str(folder)).collect()
    assert sorted(r["n"] for r in sizes) == [3, 5]
    assert sum(r["bytes"] for r in sizes) == sum(p.stat().st_size for p in folder.iterdir())


def test_base64(spark):
    raw = base64.b64encode("a;b;;\r\n1;2\r\n\r\n3;4;".encode()).decode()
    out = text.columns_of(text.from_base64(spark.createDataFrame([(raw,)], "c string"), "c"), ["a", "b"])
    assert [tuple(r) for r in out.collect()] == [("a", "b"), ("1", "2"), ("3", "4")]


def test_strict(spark):
    good = [(f"2024-01-01 0{h}:00:00", str(h)) for h in range(4)]
    frame = lambda rows: spark.createDataFrame(rows, "UTC string, v string")
    text.check_strict(frame(good), ["UTC", "v"], "a.csv", ";")
    cases = [
        (good, ["UTC", "v"], "a.txt", ";", "csv"),
        (good, ["UTC", "v"], "a.csv", ",", "semicolon"),
        (good, ["UTC", "v", "w"], "a.csv", ";", "two columns"),
        (good, ["time", "v"], "a.csv", ";", "named UTC"),
        (good[:1], ["UTC", "v"], "a.csv", ";", "two rows"),
        ([*good, ("01.01.2024", "1")], ["UTC", "v"], "a.csv", ";", "format"),
        ([*good, good[0]], ["UTC", "v"], "a.csv", ";", "repeated"),
        ([*good, ("2024-01-01 09:00:00", "1")], ["UTC", "v"], "a.csv", ";", "step"),
    ]
    for rows, names, path, sep, word in cases:
        with pytest.raises(ValueError, match=word):
            text.check_strict(frame(rows), names, path, sep)


def test_names():
    assert text.pick_columns(["UTC", "Temp", "Leistung_kW"], text.LOAD_TERMS) == "Leistung_kW"
    assert text.pick_columns(["UTC", "a"], ("zz",)) == "a"
    with pytest.raises(ValueError, match="no column"):
        text.pick_columns(["UTC"], ("zz",))
    assert text.safe_name("/tmp/a\x00b.csv") == "ab.csv"
    for bad in ("", "x/", "a/..", "..b"):
        with pytest.raises(ValueError, match="no file name"):
            text.safe_name(bad)
    assert scale.feature_names(["a"], {"Y", "H"}) == ["a", "Y_sin", "Y_cos", "H"]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("s", t, v, i) for i, (t, v) in enumerate(ROWS)], "series_id string, ts timestamp, value double, row_pos long")
    path = str(tmp_path / "out")
    sinks.write_csv(sinks.as_text(df).coalesce(1), path)
    assert series(text.standardise(text.read_strings(spark, path, ";", True), text.TextSpec())) == ROWS
    risky = spark.createDataFrame([("=1+1", "-2"), ("ok", "+x")], "a string, b string")
    sinks.write_csv(risky, str(tmp_path / "safe"), safe=True)
    assert sorted(tuple(r) for r in spark.read.csv(str(tmp_path / "safe"), sep=";", header=True).collect()) == [("'=1+1", "-2"), ("ok", "'+x")]


def test_json_and_samples(spark, tmp_path):
    df = spark.createDataFrame([("s", t, v, i) for i, (t, v) in enumerate(ROWS)], "series_id string, ts timestamp, value double, row_pos long")
    sinks.write_json(df, str(tmp_path / "j"))
    assert series(spark.read.schema(df.schema).json(str(tmp_path / "j"))) == ROWS
    sinks.write_samples(df, str(tmp_path / "p"))
    assert series(spark.read.parquet(str(tmp_path / "p"))) == ROWS
    got = [json.loads(x) for x in sinks.stream_lines(df.orderBy("row_pos"), chunk=3)]
    assert [g["type"] for g in got] == ["meta", "data", "data", "data", "complete"]
    assert got[0]["total_rows"] == sum(len(g["data"]) for g in got[1:-1]) == 8
    assert [r["row_pos"] for r in sinks.preview(df, 3).collect()] == [0, 1, 2]
    line = json.loads(sinks.trace(df, "load").first()["trace"])
    assert line["x"][0] == "2024-01-01T00:15:00"
    assert line["y"] == [v for _, v in ROWS]


def test_forecast_output(spark):
    class Twice:
        def predict(self, df):
            return df.selectExpr("*", "x * 2 as y_pred")

    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1), k, k / 10) for k in range(3)], "utc_ref timestamp, step int, x double")
    scaler = spark.createDataFrame([("load", 100.0, 200.0, 0.0, 1.0)], "feature string, data_min double, data_max double, out_min double, out_max double")
    out = forecast.run(rows, Twice(), ["x"], scaler, 1, 15, "load").orderBy("utc").collect()
    assert [tuple(r) for r in out] == [(dt.datetime(2024, 1, 1, 1, 15 * k), 100.0 + 20 * k) for k in range(3)]
