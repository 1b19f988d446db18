"""Named queries over the driver's tables and the SQL that gives the same rows.

Times are returned as whole seconds or microseconds since the epoch, doubles rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import calendar, scalar
from tidemark.operators import accounts, clean, decompose, forecast, info, joins, metrics, models, networks, outputs, regression, sbad, scale, setops, support, windows
from tidemark.operators.grid import anchor_start
from tidemark.operators.ordered import asof
from tidemark.operators.regrid import RegridSpec, first_per_time, regrid
from tidemark.plans.lineage import shared_path, stored
from tidemark.plans.preparation import CleanSpec, adjust, cleaned
from tidemark.sources import keyed, sinks
from tidemark.sources.tables import event_series, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
MISSING = 7


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


def us(c: str = "ts"):
    return F.unix_micros(c)


S = "s AS (SELECT event_type AS series_id, ts, epoch_us(ts) AS u, epoch_us(ts) // 1000000 AS t, value, event_id AS row_pos FROM events)"
N = f"s AS (SELECT event_type AS series_id, ts, epoch_us(ts) AS u, epoch_us(ts) // 1000000 AS t, CASE WHEN event_id % {MISSING} != 0 THEN value END AS value, event_id AS row_pos FROM events)"
D = "d AS (SELECT series_id, t, arg_min(value, row_pos) AS value FROM s WHERE value IS NOT NULL GROUP BY ALL)"
E = "d AS (SELECT series_id, ts, t, arg_min(value, row_pos) AS value FROM s WHERE value IS NOT NULL GROUP BY series_id, ts, t)"
#: Grid of a step of an hour and an offset of 10 minutes, as RegridSpec(step=60, offset=10).
G = """lim AS (SELECT series_id, min(t) AS lo, max(t) AS hi FROM s GROUP BY 1),
g0 AS (SELECT series_id, hi, lo - lo % 3600 + 600 AS b, lo FROM lim),
g1 AS (SELECT series_id, hi, CASE WHEN b >= lo THEN b ELSE b + 3600 END AS t0 FROM g0),
g AS (SELECT series_id, unnest(generate_series(t0, hi, 3600)) AS g FROM g1)"""
#: Known values by whole seconds, prior and next of each grid point.
PN = """p AS (SELECT g.series_id, g.g, d.t AS tp, d.value AS vp FROM g ASOF LEFT JOIN d ON g.series_id = d.series_id AND g.g >= d.t),
pn AS (SELECT p.*, d.t AS tn, d.value AS vn FROM p ASOF LEFT JOIN d ON p.series_id = d.series_id AND p.g <= d.t)"""


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the place of each row in the whole order: partitions of a range sort are numbered side by side."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    at = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row a partition
    rows = rows.withColumn("_at", at)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(sizes), "_part").withColumn(name, F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def grid_out(df: DataFrame) -> DataFrame:
    return df.select("series_id", F.unix_seconds("ts").alias("g"), r6("value").alias("value"))


# --- series and grids --------------------------------------------------------------------


@query(f"""WITH {N} SELECT series_id, epoch_us(min(ts)) AS utc_min, epoch_us(max(ts)) AS utc_max, count(*) AS n_all, count(value) AS n_num,
 round(count(value) / count(*) * 100, 6) AS rate_num, round((max(u) - min(u)) / (count(*) - 1) / 6e7, 6) AS delt_min, round(min(value), 6) AS val_min, round(max(value), 6) AS val_max FROM s GROUP BY 1""")
def series_info(spark, sf_dir):
    out = info.series_info(event_series(spark, sf_dir, MISSING))
    return out.select("series_id", us("utc_min").alias("utc_min"), us("utc_max").alias("utc_max"), "n_all", "n_num", *[r6(c).alias(c) for c in ("rate_num", "delt_min", "val_min", "val_max")])


@query(f"""WITH {S}, l AS (SELECT series_id, ts, u - lag(u) OVER (PARTITION BY series_id ORDER BY ts, row_pos) AS g FROM s),
 m AS (SELECT series_id, CAST(round_even(median(g / 1e6) / 60, 0) AS INTEGER) AS step_min, min(ts) AS f FROM l GROUP BY 1)
 SELECT series_id, step_min, CASE WHEN step_min > 0 THEN minute(f) % step_min ELSE 0 END AS offset_min FROM m""")
def timestep_detect(spark, sf_dir):
    return info.timestep(event_series(spark, sf_dir))


@query(f"WITH {S}, l AS (SELECT series_id, u - lag(u) OVER (PARTITION BY series_id ORDER BY ts, row_pos) AS g FROM s) SELECT series_id, round(max(g) / 6e7, 6) AS max_gap_min FROM l GROUP BY 1")
def gap_max(spark, sf_dir):
    return info.max_gap(event_series(spark, sf_dir)).withColumn("max_gap_min", r6("max_gap_min"))


@query(f"""WITH {S}, l AS (SELECT series_id, (u - lag(u) OVER (PARTITION BY series_id ORDER BY ts, row_pos)) / 1e6 AS g FROM s),
 m AS (SELECT series_id, avg(g) AS m FROM l GROUP BY 1) SELECT l.series_id, round(max(abs(g - m) / m), 6) AS deviation FROM l JOIN m USING (series_id) GROUP BY 1""")
def step_deviation(spark, sf_dir):
    return info.step_deviation(event_series(spark, sf_dir)).withColumn("deviation", r6("deviation"))


@query(f"""WITH {N}, l AS (SELECT *, (u - lag(u) OVER (PARTITION BY series_id ORDER BY ts, row_pos)) / 1e6 AS g FROM s), m AS (SELECT series_id, median(g) AS m FROM l GROUP BY 1)
 SELECT l.series_id, count(*) AS n_rows, count(*) FILTER (value IS NULL) AS n_missing, count(*) FILTER (g > 2 * m) AS n_irregular, CAST(count(*) - count(DISTINCT u) AS BIGINT) AS n_repeated FROM l JOIN m USING (series_id) GROUP BY 1""")
def series_report(spark, sf_dir):
    return info.report(event_series(spark, sf_dir, MISSING))


@query("""SELECT count(l_extendedprice) AS n, round(avg(l_extendedprice), 6) AS mean, round(stddev_samp(l_extendedprice), 6) AS std, min(l_extendedprice) AS min, round(quantile_cont(l_extendedprice, 0.25), 6) AS q25,
 round(quantile_cont(l_extendedprice, 0.5), 6) AS q50, round(quantile_cont(l_extendedprice, 0.75), 6) AS q75, max(l_extendedprice) AS max FROM lineitem""")
def describe(spark, sf_dir):
    out = info.describe(table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return out.select("n", r6("mean").alias("mean"), r6("std").alias("std"), "min", *[r6(c).alias(c) for c in ("q25", "q50", "q75")], "max")


SPEC = {"step": 60, "offset": 10, "max_gap": 120}


@query(f"WITH {S}, {E}, {G} SELECT g.series_id, g.g, round(avg(d.value), 6) AS value FROM g LEFT JOIN d ON d.series_id = g.series_id AND d.t BETWEEN g.g - 1800 AND g.g + 1800 GROUP BY ALL")
def regrid_mean(spark, sf_dir):
    return grid_out(regrid(event_series(spark, sf_dir), RegridSpec("mean", **SPEC)))


@query(f"WITH {N}, {D}, {G}, {PN} SELECT series_id, g, round(CASE WHEN tn = tp THEN vp WHEN tn - tp <= 7200 THEN vp + (vn - vp) / (tn - tp) * (g - tp) END, 6) AS value FROM pn")
def regrid_intrpl(spark, sf_dir):
    return grid_out(regrid(event_series(spark, sf_dir, MISSING), RegridSpec("intrpl", **SPEC)))


@query(f"""WITH {S}, {E}, {G}, j AS (SELECT g.series_id, g.g, d.value, row_number() OVER (PARTITION BY g.series_id, g.g ORDER BY abs(d.t - g.g), d.ts) AS k
 FROM g LEFT JOIN d ON d.series_id = g.series_id AND d.t BETWEEN g.g - 1800 AND g.g + 1800) SELECT series_id, g, round(value, 6) AS value FROM j WHERE k = 1""")
def regrid_nearest(spark, sf_dir):
    return grid_out(regrid(event_series(spark, sf_dir), RegridSpec("nearest", **SPEC)))


@query(f"""WITH {S}, {E}, {G}, j AS (SELECT g.series_id, g.g, d.value, rank() OVER (PARTITION BY g.series_id, g.g ORDER BY abs(d.t - g.g)) AS k
 FROM g LEFT JOIN d ON d.series_id = g.series_id AND d.t BETWEEN g.g - 1800 AND g.g + 1800) SELECT series_id, g, round(avg(value), 6) AS value FROM j WHERE k = 1 GROUP BY ALL""")
def regrid_nearest_mean(spark, sf_dir):
    return grid_out(regrid(event_series(spark, sf_dir), RegridSpec("nearest (mean)", **SPEC)))


@query(f"WITH {N}, {D}, {G}, {PN} SELECT series_id, g, round(CASE WHEN tn = tp THEN vp WHEN tn - tp <= 7200 THEN CASE WHEN g - tp < tn - g THEN vp ELSE vn END END, 6) AS value FROM pn")
def regrid_nearest_maxdelta(spark, sf_dir):
    return grid_out(regrid(event_series(spark, sf_dir, MISSING), RegridSpec("nearest (max. delta)", **SPEC)))


@query(f"WITH {S}, {G} SELECT series_id, g, CAST(NULL AS DOUBLE) AS value FROM g")
def regrid_none(spark, sf_dir):
    return grid_out(regrid(event_series(spark, sf_dir), RegridSpec("none", **SPEC)))


@query("""WITH a(anchor, start) AS (SELECT o_orderkey * 60 % 86400, o_custkey * 61 % 86400 FROM orders)
 SELECT anchor, start, CASE WHEN anchor >= start THEN anchor - (anchor - start) // 420 * 420 ELSE anchor + (start - anchor) // 420 * 420 END AS grid_start FROM a""")
def grid_anchor(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey * 60 % 86400 as anchor", "o_custkey * 61 % 86400 as start")
    return rows.withColumn("grid_start", anchor_start("anchor", "start", 420))


@query(f"""WITH {S}, st AS (SELECT series_id, min(t) - min(t) % 3600 + 600 AS b, min(t) AS lo, max(t) AS hi FROM s GROUP BY 1)
 SELECT series_id, count(*) AS n, round(sum(value), 4) AS total FROM (WITH {E}, {G} SELECT g.series_id, g.g, avg(d.value) AS value FROM g LEFT JOIN d ON d.series_id = g.series_id AND d.t BETWEEN g.g - 1800 AND g.g + 1800 GROUP BY ALL) GROUP BY 1""")
def adjust_series(spark, sf_dir):
    out = adjust(event_series(spark, sf_dir), RegridSpec("mean", **SPEC))
    return out.groupBy("series_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


for _how in ("mean", "sum", "min", "max"):
    _f = "avg" if _how == "mean" else _how
    _v = "coalesce(value, 0)" if _how == "sum" else "value"

    def _resample(spark, sf_dir, how=_how):
        return grid_out(info.resample(event_series(spark, sf_dir), 1800, how))

    _resample.__name__ = f"resample_{_how}"
    query(f"""WITH {S}, b AS (SELECT series_id, t - t % 1800 AS g, {_f}(value) AS value FROM s GROUP BY ALL), e AS (SELECT series_id, unnest(generate_series(min(g), max(g), 1800)) AS g FROM b GROUP BY 1)
 SELECT e.series_id, e.g, round({_v}, 6) AS value FROM e LEFT JOIN b USING (series_id, g)""")(_resample)


# --- filters and cleaning ----------------------------------------------------------------


def rows_out(df: DataFrame) -> DataFrame:
    return df.select("series_id", "row_pos", r6("value").alias("value"))


@query(f"WITH {S} SELECT series_id, row_pos, round(value, 6) AS value FROM s WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'")
def time_filter(spark, sf_dir):
    return rows_out(clean.time_range(event_series(spark, sf_dir), "2024-01-05 00:00:00", "2024-01-12 12:00:00"))


@query("SELECT o_custkey AS cust, epoch_us(o_orderdate) AS at, min(o_orderkey) AS first_key FROM orders GROUP BY ALL")
def dedup_first(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("series_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("row_pos"))
    return first_per_time(rows).select(F.col("series_id").cast("long").alias("cust"), us().alias("at"), F.col("row_pos").alias("first_key"))


@query(f"WITH {N} SELECT series_id, row_pos, round(value, 6) AS value FROM s WHERE value IS NOT NULL")
def drop_missing(spark, sf_dir):
    return rows_out(event_series(spark, sf_dir, MISSING).dropna(subset=["ts", "value"]))


@query(f"WITH {S} SELECT series_id, row_pos, CASE WHEN NOT (value > 100 OR value < 10) THEN round(value, 6) END AS value FROM s")
def range_clip(spark, sf_dir):
    return rows_out(clean.clip_range(event_series(spark, sf_dir), 10, 100))


@query(f"WITH {S} SELECT series_id, row_pos, nullif(round(value, 6) - round(value, 6) % 10, 0) AS value FROM s")
def zero_elim(spark, sf_dir):
    s = event_series(spark, sf_dir).withColumn("value", F.round("value", 6) - F.round("value", 6) % 10)
    return clean.drop_zeros(s).select("series_id", "row_pos", "value")


@query(f"""WITH {N}, l AS (SELECT *, lag(value) OVER w AS pv, lag(u) OVER w AS pu FROM s WINDOW w AS (PARTITION BY series_id ORDER BY ts, row_pos))
 SELECT series_id, row_pos, CASE WHEN u != pu THEN round((value - pv) / ((u - pu) / 6e7), 6) END AS slope FROM l""")
def slope(spark, sf_dir):
    return clean.slope(event_series(spark, sf_dir, MISSING)).select("series_id", "row_pos", r6("slope").alias("slope"))


@query(f"""WITH {N}, p AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN u END IGNORE NULLS) OVER b AS tp, last_value(value IGNORE NULLS) OVER b AS vp,
 first_value(CASE WHEN value IS NOT NULL THEN u END IGNORE NULLS) OVER f AS tn, first_value(value IGNORE NULLS) OVER f AS vn FROM s
 WINDOW b AS (PARTITION BY series_id ORDER BY ts, row_pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY series_id ORDER BY ts, row_pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT series_id, row_pos, round(CASE WHEN value IS NOT NULL THEN value WHEN tn - tp <= 120 * 6e7 THEN vp + (u - tp) / 6e7 * ((vn - vp) / ((tn - tp) / 6e7)) END, 6) AS value FROM p""")
def gap_fill(spark, sf_dir):
    return rows_out(clean.fill_gaps(event_series(spark, sf_dir, MISSING), 120))


_COARSE = "CASE WHEN event_id % 7 != 0 THEN floor(value / 50) END"


def _coarse(spark, sf_dir):
    return event_series(spark, sf_dir, MISSING).withColumn("value", F.floor(F.col("value") / 50).cast("double"))


@query(f"""WITH s AS (SELECT event_type AS series_id, ts, epoch_us(ts) AS u, {_COARSE} AS value, event_id AS row_pos FROM events),
 b AS (SELECT *, CASE WHEN value = lag(value) OVER w THEN 0 ELSE 1 END AS br FROM s WINDOW w AS (PARTITION BY series_id ORDER BY ts, row_pos)),
 r AS (SELECT *, sum(br) OVER (PARTITION BY series_id ORDER BY ts, row_pos ROWS UNBOUNDED PRECEDING) AS run FROM b),
 x AS (SELECT series_id, run FROM r WHERE value IS NOT NULL GROUP BY ALL HAVING count(*) >= 2 AND max(u) - min(u) >= 60 * 6e7)
 SELECT r.series_id, r.row_pos, CASE WHEN x.run IS NULL THEN r.value END AS value FROM r LEFT JOIN x USING (series_id, run)""")
def const_runs(spark, sf_dir):
    return clean.drop_constant_runs(_coarse(spark, sf_dir), 60).select("series_id", "row_pos", "value")


@query(f"""WITH {N}, b AS (SELECT *, CASE WHEN (value IS NULL) = (lag(value) OVER w IS NULL) AND lag(row_pos) OVER w IS NOT NULL THEN 0 ELSE 1 END AS br FROM s WINDOW w AS (PARTITION BY series_id ORDER BY ts, row_pos)),
 r AS (SELECT *, sum(br) OVER (PARTITION BY series_id ORDER BY ts, row_pos ROWS UNBOUNDED PRECEDING) AS run, max(u) OVER (PARTITION BY series_id) AS top FROM b),
 x AS (SELECT series_id, run FROM r WHERE value IS NOT NULL GROUP BY ALL HAVING max(u) - min(u) < 300 * 6e7 AND max(u) < max(top))
 SELECT r.series_id, r.row_pos, CASE WHEN x.run IS NULL THEN round(r.value, 6) END AS value FROM r LEFT JOIN x USING (series_id, run)""")
def short_runs(spark, sf_dir):
    return rows_out(clean.drop_short_runs(event_series(spark, sf_dir, MISSING), 300))


@query(f"""WITH {N}, i AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts, row_pos) AS i FROM s),
 p AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ip, last_value(value IGNORE NULLS) OVER b AS vp, first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER f AS inx, first_value(value IGNORE NULLS) OVER f AS vn FROM i
 WINDOW b AS (PARTITION BY series_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY series_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT series_id, row_pos, round(CASE WHEN value IS NOT NULL THEN value WHEN i - ip <= 1 THEN CASE WHEN inx IS NOT NULL THEN vp + (vn - vp) * (i - ip) / (inx - ip) ELSE vp END END, 6) AS value FROM p""")
def fill_rows_limit(spark, sf_dir):
    return rows_out(clean.fill_linear_rows(event_series(spark, sf_dir, MISSING), limit=1))


@query()
def sbad_fixpoint(spark, sf_dir):
    return rows_out(sbad.sbad(event_series(spark, sf_dir), 5.0, 120.0, 60.0, 3))


@query()
def clean_pipeline(spark, sf_dir):
    return rows_out(cleaned(event_series(spark, sf_dir, MISSING), CleanSpec(constant_min=60, zeros=True, low=0, high=250, max_change=5, max_length=120, short_min=10, max_gap=120, digits=3)))


@query("""WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem)
 SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem, q WHERE l_extendedprice BETWEEN a - 0.5 * (b - a) AND b + 0.5 * (b - a)""")
def iqr_filter(spark, sf_dir):
    return clean.drop_outliers(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_extendedprice"], 0.5)


@query("WITH q AS (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem) SELECT l_orderkey, l_linenumber, abs((l_extendedprice - m) / s) > 1.5 AS outlier FROM lineitem, q")
def zscore_flag(spark, sf_dir):
    return clean.flag_outliers(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", "zscore").drop("l_extendedprice")


# --- joins and sets ----------------------------------------------------------------------


def _hourly(spark, sf_dir):
    h = event_series(spark, sf_dir).withColumn("ts", F.date_trunc("hour", "ts"))
    return h.groupBy("series_id", "ts").agg(F.avg("value").alias("value"), F.min("row_pos").alias("row_pos"))


def _pairs(spark, sf_dir):
    h = _hourly(spark, sf_dir)
    return joins.pair_by_time(h.where("series_id = 'click'"), h.where("series_id = 'purchase'"))


H = "h AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, avg(value) AS value FROM events GROUP BY ALL)"
XY = f"{H}, xy AS (SELECT a.ts, a.value AS x, b.value AS y FROM h a JOIN h b ON a.ts = b.ts AND a.series_id = 'click' AND b.series_id = 'purchase')"


@query(f"WITH {XY} SELECT epoch_us(ts) AS ts, round(x, 6) AS x, round(y, 6) AS y FROM xy")
def hash_join_utc(spark, sf_dir):
    return _pairs(spark, sf_dir).select(us().alias("ts"), r6("x").alias("x"), r6("y").alias("y"))


@query("""WITH a AS (SELECT value, row_number() OVER (ORDER BY event_id) AS n FROM events WHERE event_type = 'click'), b AS (SELECT value, row_number() OVER (ORDER BY event_id) AS n FROM events WHERE event_type = 'view')
 SELECT n, round(a.value, 6) AS x, round(b.value, 6) AS y FROM a JOIN b USING (n)""")
def row_join(spark, sf_dir):
    s = event_series(spark, sf_dir)
    x, y = (s.where(F.col("series_id") == k).withColumn("pair", F.lit(1)) for k in ("click", "view"))
    return joins.pair_by_row(x, y, "pair").select("n", r6("x").alias("x"), r6("y").alias("y"))


_ASOF = """WITH o AS (SELECT o_orderkey, epoch_us(o_orderdate) AS u, o_orderdate AS ts FROM orders), e AS (SELECT ts, arg_min(value, event_id) AS value FROM events GROUP BY 1)
 SELECT o_orderkey, round(e.value, 6) AS value, epoch_us(e.ts) AS at FROM o ASOF LEFT JOIN e ON o.ts {op} e.ts"""


def _asof(spark, sf_dir, side):
    o = table(spark, sf_dir, "orders").select(F.lit("all").alias("series_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), "o_orderkey")
    e = event_series(spark, sf_dir).withColumn("series_id", F.lit("all"))
    return asof(o, e).select("o_orderkey", r6(F.col(f"{side}.value")).alias("value"), us(f"{side}.ts").alias("at"))


@query(_ASOF.format(op=">="))
def asof_prev(spark, sf_dir):
    return _asof(spark, sf_dir, "prior")


@query(_ASOF.format(op="<="))
def asof_next(spark, sf_dir):
    return _asof(spark, sf_dir, "next")


@query(f"WITH {H} SELECT epoch_us(coalesce(a.ts, b.ts)) AS ts, round(a.value, 6) AS a, round(b.value, 6) AS b FROM (SELECT * FROM h WHERE series_id = 'click') a FULL JOIN (SELECT * FROM h WHERE series_id = 'error') b ON a.ts = b.ts")
def outer_align(spark, sf_dir):
    h = _hourly(spark, sf_dir)
    out = joins.align(h.where("series_id = 'click'"), h.where("series_id = 'error'"), ["ts"])
    return out.select(us().alias("ts"), r6("a").alias("a"), r6("b").alias("b"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def anti_join(spark, sf_dir):
    big = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.without(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), big, ["c_custkey"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def semi_join(spark, sf_dir):
    big = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.having(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), big, ["c_custkey"])


@query(f"WITH {H} SELECT series_id, epoch_us(ts) AS ts, ts IN (SELECT ts FROM h WHERE value > 100) AS flag FROM h")
def membership_flag(spark, sf_dir):
    h = _hourly(spark, sf_dir)
    return joins.flag(h.select("series_id", "ts"), h.where("value > 100"), ["ts"]).select("series_id", us().alias("ts"), "flag")


@query("SELECT a.n_name AS input_id, b.n_name AS output_id FROM nation a, nation b WHERE a.n_regionkey = 0 AND b.n_regionkey = 1")
def file_pairs(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumnRenamed("n_name", "series_id")
    return joins.file_pairs(n.where("n_regionkey = 0"), n.where("n_regionkey = 1"))


@query(f"WITH {N}, a AS (SELECT series_id, u, value FROM s WHERE row_pos % 3 != 2), b AS (SELECT series_id, u, value FROM s WHERE row_pos % 3 != 0) SELECT series_id, u, round(value, 6) AS value FROM (SELECT * FROM a UNION SELECT * FROM b)")
def union_dedup_sort(spark, sf_dir):
    s = event_series(spark, sf_dir, MISSING)
    out = setops.merge(s.where("row_pos % 3 != 2").drop("row_pos"), s.where("row_pos % 3 != 0").drop("row_pos"))
    return out.select("series_id", us().alias("u"), r6("value").alias("value")).orderBy("u")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) UNION ALL SELECT o_orderkey, o_totalprice * 2 FROM orders WHERE o_orderkey % 3 = 0")
def replace_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return setops.replace_by_key(o, o.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2), "o_orderkey")


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM (SELECT o_custkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 1) GROUP BY 1")
def upsert_add(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_totalprice").alias("total"))
    even, odd = (table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 2 == k).select("o_custkey", F.col("o_totalprice").alias("total")) for k in (0, 1))
    return setops.upsert_add(even, odd, ["o_custkey"], "total").withColumn("total", F.round("total", 2)).select(o.columns)


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 0.0 FROM customer WHERE c_custkey % 2 = 1")
def insert_missing(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return setops.insert_missing(c.where("c_custkey % 2 = 0"), c.withColumn("c_acctbal", F.lit(0.0)), ["c_custkey"])


@query("SELECT c_custkey, greatest(c_acctbal, 100.0) AS c_acctbal FROM customer")
def raise_to(spark, sf_dir):
    return setops.raise_to(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", F.lit(100.0))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(spark, sf_dir):
    return setops.top(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 25, F.desc("o_totalprice"), "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 200")
def reservoir(spark, sf_dir):
    return setops.sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 200, "o_orderkey")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) AS place FROM orders")
def permutation(spark, sf_dir):
    out = setops.permuted(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    return ranked(out.withColumn("_h", setops.shuffled("o_orderkey")), ["_h", "o_orderkey"], "place").select("o_orderkey", "place")


@query("SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0")
def intersect_rows(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_suppkey").alias("k"))
    return setops.in_both(a, table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("k")))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def newest_per_key(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return joins.newest(o, "o_custkey", "o_orderdate", "o_orderkey").drop("o_orderdate")


# --- regression --------------------------------------------------------------------------


@query("""WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem)
 SELECT l_orderkey, l_linenumber, round(a * l_quantity + b, 4) AS y_hat, abs(l_extendedprice - (a * l_quantity + b)) <= abs(a * l_quantity + b) * 0.1 + 1000 AS inside FROM lineitem, f""")
def linreg_tolerance(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return regression.linear(regression.usable(p), "dep", 1000, 0.1).select("l_orderkey", "l_linenumber", F.round("y_hat", 4).alias("y_hat"), "inside")


@query(f"""WITH {XY}, f AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM xy) SELECT row_number() OVER (ORDER BY x, epoch_us(ts)) AS place, round(x, 6) AS x, round(a * x + b, 4) AS y_hat FROM xy, f""")
def linreg_by_x(spark, sf_dir):
    out = regression.linear(regression.usable(_pairs(spark, sf_dir)), "cnt", 20)
    return ranked(out, ["x", "ts"], "place").select("place", r6("x").alias("x"), F.round("y_hat", 4).alias("y_hat")).orderBy("place")


@query(f"""WITH {XY}, m AS (SELECT avg(x) AS mx FROM xy), z AS (SELECT ts, x, y, x - mx AS c FROM xy, m),
 q AS (SELECT count(*) AS s0, sum(c) AS s1, sum(c*c) AS s2, sum(c*c*c) AS s3, sum(c*c*c*c) AS s4, sum(y) AS t0, sum(c*y) AS t1, sum(c*c*y) AS t2 FROM z),
 d AS (SELECT *, s4*(s2*s0-s1*s1) - s3*(s3*s0-s1*s2) + s2*(s3*s1-s2*s2) AS det FROM q),
 k AS (SELECT (t2*(s2*s0-s1*s1) - s3*(t1*s0-s1*t0) + s2*(t1*s1-s2*t0))/det AS a, (s4*(t1*s0-s1*t0) - t2*(s3*s0-s1*s2) + s2*(s3*t0-t1*s2))/det AS b, (s4*(s2*t0-t1*s1) - s3*(s3*t0-t1*s2) + t2*(s3*s1-s2*s2))/det AS c0 FROM d)
 SELECT epoch_us(ts) AS ts, round(a*c*c + b*c + c0, 4) AS y_hat, abs(y - (a*c*c + b*c + c0)) <= 20 AS inside FROM z, k""")
def polyreg_tolerance(spark, sf_dir):
    return regression.quadratic(regression.usable(_pairs(spark, sf_dir)), "cnt", 20).select(us().alias("ts"), F.round("y_hat", 4).alias("y_hat"), "inside")


@query(f"WITH {XY} SELECT round(min(x), 6) AS x_min, round(max(x), 6) AS x_max, round(min(y), 6) AS y_min, round(max(y), 6) AS y_max, count(*) AS n FROM xy")
def pair_extent(spark, sf_dir):
    out = regression.extent(regression.usable(_pairs(spark, sf_dir)))
    return out.select(*[r6(c).alias(c) for c in ("x_min", "x_max", "y_min", "y_max")], "n")


# --- features, windows, scaling, metrics -------------------------------------------------


@query("""SELECT event_id, round(sin(epoch_us(ts)/1e6/31557600*2*pi()), 6) AS y_sin, round(cos(epoch_us(ts)/1e6/31557600*2*pi()), 6) AS y_cos, round(sin(epoch_us(ts)/1e6/604800*2*pi()), 6) AS w_sin,
 round(cos(epoch_us(ts)/1e6/86400*2*pi()), 6) AS d_cos, CAST(isodow(ts) - 1 AS INTEGER) AS dayofweek, CAST(quarter(ts) AS INTEGER) AS quarter, CAST(day(last_day(ts)) AS INTEGER) AS days_in_month, CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend FROM events""")
def calendar_features(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    y, w, d, p = calendar.cyclic(F.col("ts"), "Y"), calendar.cyclic(F.col("ts"), "W"), calendar.cyclic(F.col("ts"), "D"), calendar.parts(F.col("ts"))
    return e.select("event_id", r6(y[0]).alias("y_sin"), r6(y[1]).alias("y_cos"), r6(w[0]).alias("w_sin"), r6(d[1]).alias("d_cos"), *[p[k].alias(k) for k in ("dayofweek", "quarter", "days_in_month", "is_weekend")])


@query("""SELECT event_id, round(sin(((dayofyear(l)-1)*86400 + hour(l)*3600 + minute(l)*60 + second(l)) / (366*86400.0) * 2*pi()), 6) AS y_sin, round(cos((hour(l)*3600 + minute(l)*60 + second(l)) / 86400.0 * 2*pi()), 6) AS d_cos
 FROM (SELECT event_id, ts + INTERVAL 1 HOUR AS l FROM events)""")
def calendar_local(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    y, d = (calendar.cyclic_local(F.col("ts"), k, "Europe/Vienna") for k in ("Y", "D"))
    return e.select("event_id", r6(y[0]).alias("y_sin"), r6(d[1]).alias("d_cos"))


@query("SELECT event_id, CAST(strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d') IN ('2024-01-01', '2024-01-06') AS INTEGER) AS holiday FROM events")
def holiday_flag(spark, sf_dir):
    return calendar.with_holiday(table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))).select("event_id", "holiday")


HORIZONS = [windows.Horizon("click", -3, 0, 4), windows.Horizon("view", -2, 0, 3, "nearest")]


def _refs(spark, sf_dir):
    i = info.series_info(event_series(spark, sf_dir).where("series_id in ('click', 'view')"))
    return windows.reference_grid(windows.reference_range(i), 360)


_WINDOW = """WITH e AS (SELECT event_type AS f, epoch_us(ts) AS u, arg_min(value, event_id) AS v FROM events GROUP BY ALL),
 span AS (SELECT min(a) // 1000000 AS s, min(b) // 1000000 AS e FROM (SELECT f, min(u) AS a, max(u) AS b FROM e WHERE f IN ('click', 'view') GROUP BY 1)),
 ref AS (SELECT unnest(generate_series(s - s % 3600 - 3600 + CAST(ceil((s % 3600 + 3600) / 21600) AS BIGINT) * 21600, e, 21600)) * 1000000 AS r FROM span)"""


@query(f"""{_WINDOW}, st AS (SELECT r, 'click' AS f, k AS step, r + (k - 3) * 3600000000 AS u FROM ref, range(4) t(k) UNION ALL SELECT r, 'view', k, r + (k - 2) * 3600000000 FROM ref, range(3) t(k)),
 p AS (SELECT st.*, e.u AS tp, e.v AS vp FROM st ASOF LEFT JOIN e ON st.f = e.f AND st.u >= e.u), n AS (SELECT p.*, e.u AS tn, e.v AS vn FROM p ASOF LEFT JOIN e ON p.f = e.f AND p.u <= e.u),
 v AS (SELECT r, f, step, CASE WHEN f = 'click' THEN CASE WHEN tp = tn THEN vp ELSE vp + (vn - vp) * ((u - tp) / (tn - tp)) END ELSE CASE WHEN tn IS NOT NULL THEN vn ELSE vp END END AS value FROM n)
 SELECT r AS utc_ref, f AS feature, step, round(value, 6) AS value FROM v WHERE r IN (SELECT r FROM v GROUP BY 1 HAVING count(value) = 7)""")
def supervised_windows(spark, sf_dir):
    out = windows.complete(windows.long_windows(event_series(spark, sf_dir), _refs(spark, sf_dir), HORIZONS), 7)
    return out.select(us("utc_ref").alias("utc_ref"), "feature", F.col("step").cast("long").alias("step"), r6("value").alias("value"))


@query(f"""{_WINDOW} SELECT r AS utc_ref, k AS step, round((SELECT avg(value) FROM events WHERE event_type = 'click' AND epoch_us(ts) >= r - 21600000000 AND epoch_us(ts) < r), 6) AS value FROM ref, range(2) t(k)""")
def window_avg(spark, sf_dir):
    out = windows.long_windows(event_series(spark, sf_dir), _refs(spark, sf_dir), [windows.Horizon("click", -6, 0, 2, "average")])
    return out.select(us("utc_ref").alias("utc_ref"), F.col("step").cast("long").alias("step"), r6("value").alias("value"))


@query(f"""{_WINDOW}, st AS (SELECT r, f, k AS step, r + (k - 3) * 3600000000 AS u FROM ref, range(4) t(k), (VALUES ('click'), ('view')) x(f)),
 p AS (SELECT st.*, e.u AS tp, e.v AS vp FROM st ASOF LEFT JOIN e ON st.f = e.f AND st.u >= e.u), n AS (SELECT p.*, e.u AS tn, e.v AS vn FROM p ASOF LEFT JOIN e ON p.f = e.f AND p.u <= e.u),
 v AS (SELECT r, f, step, CASE WHEN tp = tn THEN vp ELSE vp + (vn - vp) * ((u - tp) / (tn - tp)) END AS value FROM n)
 SELECT r AS utc_ref, step, round(max(CASE WHEN f = 'click' THEN value END)::FLOAT, 3) AS click, round(max(CASE WHEN f = 'view' THEN value END)::FLOAT, 3) AS view FROM v WHERE r IN (SELECT r FROM v GROUP BY 1 HAVING count(value) = 8) GROUP BY ALL""")
def sample_tensors(spark, sf_dir):
    h = [windows.Horizon("click", -3, 0, 4), windows.Horizon("view", -3, 0, 4)]
    out = windows.samples(windows.long_windows(event_series(spark, sf_dir), _refs(spark, sf_dir), h), h)
    rows = out.select(us("utc_ref").alias("utc_ref"), F.posexplode("x").alias("step", "_v"))
    return rows.select("utc_ref", F.col("step").cast("long").alias("step"), F.round(F.col("_v")[0], 3).alias("click"), F.round(F.col("_v")[1], 3).alias("view"))


@query(f"""WITH {S}, n AS (SELECT series_id, row_number() OVER w AS i, value AS x1, lead(value, 1) OVER w AS x2, lead(value, 2) OVER w AS x3, lead(value, 3) OVER w AS y, lead(row_pos, 3) OVER w AS last FROM s WINDOW w AS (PARTITION BY series_id ORDER BY ts, row_pos))
 SELECT series_id, i, round(x1, 6) AS x1, round(x2, 6) AS x2, round(x3, 6) AS x3, round(y, 6) AS y FROM n WHERE last IS NOT NULL""")
def sliding_sequences(spark, sf_dir):
    out = windows.sliding(event_series(spark, sf_dir), 3)
    return out.select("series_id", "i", *[r6(F.col("x")[k]).alias(f"x{k + 1}") for k in range(3)], r6("y").alias("y"))


@query(f"""WITH {S}, n AS (SELECT series_id, row_number() OVER w AS i, value AS x1, lead(value, 1) OVER w AS x2, lead(value, 2) OVER w AS y1, lead(value, 3) OVER w AS y2, lead(value, 4) OVER w AS y3, lead(row_pos, 4) OVER w AS last FROM s WINDOW w AS (PARTITION BY series_id ORDER BY ts, row_pos))
 SELECT series_id, i, round(x1, 6) AS x1, round(x2, 6) AS x2, round(y1, 6) AS y1, round(y2, 6) AS y2, round(y3, 6) AS y3 FROM n WHERE last IS NOT NULL""")
def in_out_windows(spark, sf_dir):
    out = windows.sliding(event_series(spark, sf_dir), 2, 3)
    return out.select("series_id", "i", *[r6(F.col("x")[k]).alias(f"x{k + 1}") for k in range(2)], *[r6(F.col("y")[k]).alias(f"y{k + 1}") for k in range(3)])


_NEXT = [windows.Horizon("click", 0, 2, 3, "nearest")]


@query(f"""{_WINDOW}, st AS (SELECT r, f, k AS step, r + (k - d) * 3600000000 AS u FROM ref, (SELECT unnest([0, 1, 2]) AS k, 2 AS d, 'view' AS f UNION ALL SELECT unnest([0, 1, 2]), 0, 'click') t),
 p AS (SELECT st.*, e.u AS tp, e.v AS vp FROM st ASOF LEFT JOIN e ON st.f = e.f AND st.u >= e.u), n AS (SELECT p.*, e.u AS tn, e.v AS vn FROM p ASOF LEFT JOIN e ON p.f = e.f AND p.u <= e.u),
 v AS (SELECT r, f, step, CASE WHEN tn IS NOT NULL THEN vn ELSE vp END AS value FROM n)
 SELECT r AS utc_ref, step, round(max(CASE WHEN f = 'view' THEN value END)::FLOAT, 3) AS x, round(max(CASE WHEN f = 'click' THEN value END)::FLOAT, 3) AS y FROM v WHERE r IN (SELECT r FROM v GROUP BY 1 HAVING count(value) = 6) GROUP BY ALL""")
def xy_pairs(spark, sf_dir):
    out = windows.pairs(event_series(spark, sf_dir), _refs(spark, sf_dir), [windows.Horizon("view", -2, 0, 3, "nearest")], _NEXT)
    both = out.select(us("utc_ref").alias("utc_ref"), F.posexplode(F.arrays_zip("x", "y")).alias("step", "_v"))
    return both.select("utc_ref", F.col("step").cast("long").alias("step"), *[F.round(F.col(f"_v.{c}")[0], 3).alias(c) for c in ("x", "y")])


@query("""WITH f AS (SELECT CAST(n_nationkey + 1 AS INTEGER) AS place, n_name AS feature, n_nationkey % 2 = 0 AS scaled, 1.0::DOUBLE AS high, 0.0::DOUBLE AS low FROM nation), m AS (SELECT max(place) AS n FROM f)
 SELECT * FROM f UNION ALL SELECT CAST(n + k AS INTEGER), c, s, 1.0, CASE WHEN k < 5 THEN 0.0 ELSE -1.0 END FROM m, (VALUES (1, 'Y_sin', true), (2, 'Y_cos', true), (3, 'D_sin', false), (4, 'D_cos', false), (5, 'H_sin', true), (6, 'H_cos', true)) t(k, c, s)""")
def scale_list(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).alias("place"), F.col("n_name").alias("feature"), (F.col("n_nationkey") % 2 == 0).alias("scaled"), F.lit(1.0).alias("high"), F.lit(0.0).alias("low"))
    return scale.scale_rows(n, {"Y": (True, True, 1, 0), "M": (False, True, 1, 0), "D": (True, False, 1, 0), "H": (True, True, 1, -1)})


@query(f"""{_WINDOW} SELECT r AS utc_ref, k AS step, m AS mode, round(sin((r + CASE WHEN m = 'horizon' THEN (k - 2) * 3600000000 ELSE 0 END) / 1e6 / 86400 * 2 * pi()), 6) AS d_sin FROM ref, range(3) t(k), (VALUES ('horizon'), ('current')) x(m)""")
def calendar_steps(spark, sf_dir):
    h = windows.Horizon("view", -2, 0, 3)
    both = [windows.calendar_steps(_refs(spark, sf_dir), h, over).withColumn("mode", F.lit(m)) for over, m in ((True, "horizon"), (False, "current"))]
    out = both[0].unionByName(both[1])
    return out.select(us("utc_ref").alias("utc_ref"), F.col("step").cast("long").alias("step"), "mode", r6(calendar.cyclic(F.col("ts"), "D")[0]).alias("d_sin"))


def _features(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("feature"), F.col("l_extendedprice").alias("value"))


@query("""SELECT l_orderkey, l_linenumber, l_returnflag AS feature, round((l_extendedprice - lo) / (hi - lo) * 2 - 1, 6) AS value FROM lineitem JOIN (SELECT l_returnflag, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1) USING (l_returnflag)""")
def minmax_scale(spark, sf_dir):
    df = _features(spark, sf_dir)
    return scale.transform(df, scale.fit(df, low=-1, high=1)).withColumn("value", r6("value"))


@query("""WITH s AS (SELECT l_returnflag AS feature, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1)
 SELECT l_orderkey, l_linenumber, feature, round(lo + (l_discount + 1) / 2 * (hi - lo), 4) AS value FROM lineitem JOIN s ON feature = l_returnflag""")
def minmax_inverse(spark, sf_dir):
    """Discounts, taken as scaled numbers between -1 and 1, put on the range of the prices."""
    s = scale.fit(_features(spark, sf_dir), low=-1, high=1)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("feature"), F.col("l_discount").alias("value"))
    return scale.inverse(rows, s).withColumn("value", F.round("value", 4))


@query(f"""WITH {S}, n AS (SELECT series_id, row_pos, row_number() OVER (PARTITION BY series_id ORDER BY ts, row_pos) AS i, count(*) OVER (PARTITION BY series_id) AS n FROM s)
 SELECT series_id, row_pos, CASE WHEN i <= round_even(n * 0.7::DOUBLE, 0) THEN 'train' WHEN i <= round_even(n * 0.7::DOUBLE, 0) + round_even(n * 0.2::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split FROM n""")
def split_70_20_10(spark, sf_dir):
    return scale.split_in_order(event_series(spark, sf_dir)).select("series_id", "row_pos", "split")


@query("WITH h AS (SELECT o_orderkey, substr(md5('42:' || o_orderkey), 1, 7) AS u FROM orders) SELECT o_orderkey, CASE WHEN u < 'b333333' THEN 'train' WHEN u < 'e666666' THEN 'val' ELSE 'test' END AS split FROM h")
def split_random(spark, sf_dir):
    return scale.split_by_hash(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


def _predictions(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("sample_id"), F.lit("price").alias("feature"), (F.col("l_linenumber") - 1).alias("step"), F.col("l_extendedprice").alias("y_true"), (F.col("l_quantity") * 1500).alias("y_pred")
    )


P = "p AS (SELECT l_orderkey AS sample_id, 'price' AS feature, l_linenumber - 1 AS step, l_extendedprice AS y, l_quantity * 1500 AS q FROM lineitem)"
M = """round(avg(abs(y - q)), 4) AS mae, round(sqrt(avg((y - q) * (y - q))), 4) AS rmse, round(avg(abs((y - q) / y)) * 100, 6) AS mape, round(sqrt(avg((y - q) * (y - q))) / (max(y) - min(y)), 6) AS nrmse,
 round(sum(abs(y - q)) / sum(abs(y)) * 100, 6) AS wape, round(avg(2 * abs(y - q) / (abs(y) + abs(q))) * 100, 6) AS smape"""


def _metrics(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), *[r6(c).alias(c) for c in ("mape", "nrmse", "wape", "smape")])


@query(f"WITH {P}, l AS (SELECT *, lag(y) OVER (ORDER BY sample_id, step, y) AS b FROM p) SELECT feature, {M}, round(avg(abs(y - q)) / avg(abs(y - b)), 6) AS mase FROM l GROUP BY 1")
def metrics_overall(spark, sf_dir):
    out = metrics.evaluate(_predictions(spark, sf_dir), with_mase=True).withColumn("mase", r6("mase"))
    return _metrics(out, "feature", "mase")


@query(f"WITH {P} SELECT feature, step, {M} FROM p GROUP BY ALL")
def metrics_per_step(spark, sf_dir):
    return _metrics(metrics.evaluate(_predictions(spark, sf_dir), ["feature", "step"]), "feature", "step")


@query(f"""WITH {P}, a AS (SELECT sample_id, feature, k AS level, step // k AS block, avg(y) AS y, avg(q) AS q FROM p, range(1, 13) t(k) WHERE step // k < 7 // k GROUP BY ALL) SELECT feature, CAST(level AS INTEGER) AS level, {M} FROM a GROUP BY ALL""")
def metrics_levels(spark, sf_dir):
    return _metrics(metrics.evaluate(metrics.averaged_levels(_predictions(spark, sf_dir), 7), ["feature", "level"]), "feature", "level")


@query(f"""WITH {P}, a AS (SELECT sample_id, feature, k AS level, step // k AS block, avg(y) AS y, avg(q) AS q FROM p, range(1, 13) t(k) WHERE step // k < 7 // k GROUP BY ALL), e AS (SELECT feature, level * 15 AS delta_min, {M}, avg((y - q) * (y - q)) AS mse FROM a GROUP BY feature, level)
 SELECT feature, CAST(delta_min AS INTEGER) AS delta_min, unnest(['MAE', 'MAPE', 'MSE', 'RMSE', 'NRMSE', 'WAPE', 'sMAPE']) AS metric,
 unnest([mae, round(mape, 4), round(mse, 0), rmse, round(nrmse, 4), round(wape, 4), round(smape, 4)]) AS value FROM e""")
def evaluation_tables(spark, sf_dir):
    out = metrics.evaluation_table(metrics.evaluate(metrics.averaged_levels(_predictions(spark, sf_dir), 7), ["feature", "level"]), 15)
    return out.select("feature", "delta_min", "metric", F.when(F.col("metric") == "MSE", F.round("value", 0)).otherwise(F.round("value", 4)).alias("value"))


@query("""WITH m AS (SELECT s_nationkey AS metric, s_name AS model, s_acctbal AS value FROM supplier) SELECT metric, arg_min(model, value) AS best_model, min(value) AS best_value FROM m GROUP BY 1""")
def best_model(spark, sf_dir):
    m = table(spark, sf_dir, "supplier").select(F.lit(1).alias("d"), F.col("s_nationkey").alias("metric"), F.col("s_name").alias("model"), F.col("s_acctbal").alias("value"))
    return metrics.best(m, ["d"]).drop("d")


@query("SELECT l_returnflag AS feature, min(l_extendedprice) AS low, round(quantile_cont(l_extendedprice, 0.25), 6) AS q25, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50, round(quantile_cont(l_extendedprice, 0.75), 6) AS q75, max(l_extendedprice) AS high FROM lineitem GROUP BY 1")
def violin_stats(spark, sf_dir):
    out = metrics.distribution(_features(spark, sf_dir), "feature", "value")
    return out.select("feature", "low", *[r6(c).alias(c) for c in ("q25", "q50", "q75")], "high")


@query("""WITH v AS (SELECT l_returnflag AS f, l_extendedprice AS v FROM lineitem), st AS (SELECT f, count(*) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) * pow(count(*), -0.2) AS w FROM v GROUP BY 1),
 a AS (SELECT f, n, lo, hi, w, (v - lo) / (hi - lo) * 511 AS p FROM v JOIN st USING (f)), b AS (SELECT f, p, least(floor(p), 510) AS c FROM a),
 c AS (SELECT f, c AS cell, sum(1 - (p - c)) AS s FROM b GROUP BY ALL UNION ALL SELECT f, c + 1, sum(p - c) FROM b GROUP BY ALL),
 x AS (SELECT *, lo - 2 * w + k * (hi - lo + 4 * w) / 99 AS x FROM st, range(100) t(k))
 SELECT f AS feature, CAST(k AS INTEGER) AS point, round(x, 4) AS x, round(1e6 * sum(s * exp(-0.5 * pow((x - lo - cell * (hi - lo) / 511) / w, 2))) / (n * w * sqrt(2 * pi())), 6) AS density FROM x JOIN c USING (f) GROUP BY f, k, x, n, w""")
def violin_density(spark, sf_dir):
    out = metrics.density(_features(spark, sf_dir), "feature", "value")
    return out.select("feature", "point", F.round("x", 4).alias("x"), F.round(1e6 * F.col("density"), 6).alias("density"))


@query(f"WITH {P} SELECT sample_id, step, round(y - q, 6) AS residual FROM p")
def residuals(spark, sf_dir):
    return metrics.residuals(_predictions(spark, sf_dir)).select("sample_id", "step", r6("residual").alias("residual"))


_LINEAR = """r AS (SELECT l_orderkey AS sample_id, l_linenumber - 1 AS step, l_quantity AS q, l_discount AS d, (l_linenumber - 1)::DOUBLE AS s, l_extendedprice AS y, substr(md5('42:' || l_orderkey), 1, 7) AS u FROM lineitem),
 c AS (SELECT var_pop(q) AS qq, var_pop(d) AS dd, var_pop(s) AS ss, covar_pop(q, d) AS qd, covar_pop(q, s) AS qs, covar_pop(d, s) AS ds, covar_pop(q, y) AS qy, covar_pop(d, y) AS dy, covar_pop(s, y) AS sy, avg(q) AS mq, avg(d) AS md, avg(s) AS ms, avg(y) AS my FROM r WHERE u < 'b333333'),
 k AS (SELECT *, qq * (dd * ss - ds * ds) - qd * (qd * ss - ds * qs) + qs * (qd * ds - dd * qs) AS det FROM c),
 w AS (SELECT mq, md, ms, my, (qy * (dd * ss - ds * ds) - qd * (dy * ss - ds * sy) + qs * (dy * ds - dd * sy)) / det AS a, (qq * (dy * ss - ds * sy) - qy * (qd * ss - ds * qs) + qs * (qd * sy - dy * qs)) / det AS b, (qq * (dd * sy - dy * ds) - qd * (qd * sy - dy * qs) + qy * (qd * ds - dd * qs)) / det AS e FROM k),
 o AS (SELECT sample_id, step, CASE WHEN u < 'e666666' THEN 'val' ELSE 'test' END AS split, my + a * (q - mq) + b * (d - md) + e * (s - ms) AS p FROM r, w WHERE u >= 'b333333')"""


@query(f"WITH {_LINEAR} SELECT sample_id, step, split, round(p, 1) AS y_pred FROM o")
def linear_model(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample_id"), (F.col("l_linenumber") - 1).alias("step"), "l_quantity", "l_discount", F.col("l_extendedprice").alias("y"))
    out = models.train_and_predict(scale.split_by_hash(df, "sample_id"), ["l_quantity", "l_discount"], models.make("LIN"))
    return out.select("sample_id", "step", "split", F.round("y_pred", 1).alias("y_pred"))


def _outputs(spark, sf_dir):
    """A sample for each order, its line numbers being the outputs."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample_id"), (F.col("l_linenumber") - 1).alias("step"), "l_quantity", "l_discount", F.col("l_extendedprice").alias("y"))
    return scale.split_by_hash(rows, "sample_id")


@query("""WITH r AS (SELECT l_orderkey AS sample_id, l_linenumber - 1 AS step, l_quantity AS q, l_discount AS d, l_extendedprice AS y, substr(md5('42:' || l_orderkey), 1, 7) AS u FROM lineitem),
 c AS (SELECT step, var_pop(q) AS qq, var_pop(d) AS dd, covar_pop(q, d) AS qd, covar_pop(q, y) AS qy, covar_pop(d, y) AS dy, avg(q) AS mq, avg(d) AS md, avg(y) AS my FROM r WHERE u < 'b333333' GROUP BY 1),
 w AS (SELECT *, (qy * dd - dy * qd) / (qq * dd - qd * qd) AS a, (dy * qq - qy * qd) / (qq * dd - qd * qd) AS b FROM c)
 SELECT sample_id, step, CASE WHEN u < 'e666666' THEN 'val' ELSE 'test' END AS split, round(my + a * (q - mq) + b * (d - md), 1) AS y_pred FROM r JOIN w USING (step) WHERE u >= 'b333333'""")
def linear_per_output(spark, sf_dir):
    out = models.train_and_predict(_outputs(spark, sf_dir), ["l_quantity", "l_discount"], outputs.LinearOutputs(["step"]))
    return out.select("sample_id", "step", "split", F.round("y_pred", 1).alias("y_pred"))


@query()
def boosted_per_output(spark, sf_dir):
    model = outputs.BoostedOutputs(["step"], rounds=4, step=0.5, depth=3)
    out = models.train_and_predict(_outputs(spark, sf_dir), ["l_quantity", "l_discount"], model)
    return out.select("sample_id", "step", "split", F.round("y_pred", 1).alias("y_pred"))


def _scaled_forecast(spark, sf_dir, model):
    """Predictions of prices from scaled quantities and discounts, for a model fitted on scaled prices."""
    df = scale.split_by_hash(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample_id"), (F.col("l_linenumber") - 1).alias("step"), "l_quantity", "l_discount", F.col("l_extendedprice").alias("y")), "sample_id")
    train, names = df.where("split = 'train'"), ["l_quantity", "l_discount"]
    long = lambda c: train.select(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
    scaler_in, scaler_out = scale.fit(long("l_quantity").unionAll(long("l_discount"))), scale.fit(long("y"))
    scaled = train.withColumn("feature", F.lit("y"))
    scaled = scale.transform(scaled, scaler_out, value="y")
    for c in names:
        scaled = scale.transform(scaled.withColumn("feature", F.lit(c)), scaler_in, value=c)
    model = model.fit(scaled, names)
    out = forecast.predicted(df.where("split != 'train'"), model, scaler_in, scaler_out, names, "y")
    return out.select("sample_id", "step", F.round("y_pred", 1).alias("y_pred"))


@query(f"WITH {_LINEAR} SELECT sample_id, step, round(p, 1) AS y_pred FROM o")
def predict_scaled(spark, sf_dir):
    return _scaled_forecast(spark, sf_dir, models.make("LIN"))


@query()
def support_vector_forecast(spark, sf_dir):
    return _scaled_forecast(spark, sf_dir, support.SupportVector("rbf", size=32))


def _hourly_windows(spark, sf_dir, ahead):
    """A day of hourly values and the hours after it, on the range from 0 to 1 of each series."""
    s = regrid(event_series(spark, sf_dir), RegridSpec("intrpl", 60, max_gap=1440)).withColumn("row_pos", F.unix_seconds("ts")).withColumn("feature", F.col("series_id"))
    s = scale.transform(s, scale.fit(s.where("value is not null"))).drop("feature")
    return stored(scale.split_by_hash(windows.sliding(s, 24, ahead), "i"), "windows")


def _network_forecast(rows, net):
    model = networks.Network(net, epochs=3, slices=4, rate=0.01).fit(rows.where("split = 'train'"), rows.where("split = 'val'"))
    out = model.predict(rows.where("split = 'test'"))
    return out.select("series_id", "i", F.transform("y_pred", lambda v: F.round(v, 4)).alias("y_pred"))


@query()
def dense_forecast(spark, sf_dir):
    return _network_forecast(_hourly_windows(spark, sf_dir, 6), networks.Dense(24, 6, units=32, layers=2))


@query()
def convolution_forecast(spark, sf_dir):
    return _network_forecast(_hourly_windows(spark, sf_dir, 24), networks.Convolution(24, 24, units=8, layers=2, kernel=3))


@query()
def stl_decomposition(spark, sf_dir):
    s = regrid(event_series(spark, sf_dir), RegridSpec("intrpl", 60, max_gap=1440)).where("value is not null").withColumn("row_pos", F.unix_seconds("ts"))
    return decompose.decompose(s, 24).select("series_id", F.col("row_pos").alias("t"), *[r6(c).alias(c) for c in ("value", "trend", "seasonal", "resid")])


@query()
def ar_residuals(spark, sf_dir):
    s = regrid(event_series(spark, sf_dir), RegridSpec("intrpl", 60, max_gap=1440)).where("value is not null").withColumn("row_pos", F.unix_seconds("ts"))
    return decompose.forecast_residuals(s, 24).select("series_id", F.col("row_pos").alias("t"), r6("forecast").alias("forecast"), r6("error").alias("error"))


@query(f"""WITH {S}, l AS (SELECT series_id, row_pos, value, lag(value) OVER (PARTITION BY series_id ORDER BY ts, row_pos) AS x FROM s),
 m AS (SELECT series_id, regr_slope(value, x) AS a, regr_intercept(value, x) AS b FROM l GROUP BY 1)
 SELECT series_id, row_pos, round(b + a * x, 4) AS forecast, round(abs(value - (b + a * x)), 4) AS error FROM l JOIN m USING (series_id)""")
def ar_first_order(spark, sf_dir):
    out = decompose.forecast_residuals(event_series(spark, sf_dir), 1)
    return out.select("series_id", "row_pos", F.round("forecast", 4).alias("forecast"), F.round("error", 4).alias("error"))


@query(f"WITH {N} SELECT min(m) AS utc_ref FROM (SELECT max(u) AS m FROM s WHERE value IS NOT NULL GROUP BY series_id)")
def forecast_reference(spark, sf_dir):
    return forecast.reference_time(event_series(spark, sf_dir, MISSING)).select(us("utc_ref").alias("utc_ref"))


@query(f"""WITH s AS (SELECT event_type AS series_id, epoch_us(ts) AS u, arg_min(value, event_id) AS value FROM events GROUP BY ALL), tt AS (SELECT unnest(generate_series(1704153600, 1705968000, 10800)) * 1000000 AS u), g AS (SELECT * FROM tt, (SELECT DISTINCT series_id FROM s)),
 p AS (SELECT g.*, s.u AS tp, s.value AS vp FROM g ASOF LEFT JOIN s ON g.series_id = s.series_id AND g.u >= s.u), n AS (SELECT p.*, s.u AS tn, s.value AS vn FROM p ASOF LEFT JOIN s ON p.series_id = s.series_id AND p.u <= s.u)
 SELECT series_id, u, round(CASE WHEN tp = tn THEN vp ELSE vp + (vn - vp) * ((u - tp) / (tn - tp)) END, 6) AS value FROM n""")
def interpolate_at_times(spark, sf_dir):
    times = spark.range(1704153600, 1705968001, 10800).select(F.timestamp_seconds("id").alias("ts"))
    return forecast.at_times(event_series(spark, sf_dir), times).select("series_id", us().alias("u"), r6("value").alias("value"))


# --- accounts ----------------------------------------------------------------------------

NOW = "2024-06-15 12:00:00"


def _accounts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    subs = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.when(F.col("o_orderkey") % 4 == 0, "active").otherwise("canceled").alias("status"), F.col("o_orderdate").cast("timestamp").alias("started_at"))
    return subs.withColumn("created_at", F.col("started_at"))


@query(f"""WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, DATE '2024-06-15' AS n FROM orders), m AS (SELECT *, CAST((year(n) - year(s)) * 12 + month(n) - month(s) AS INTEGER) AS k FROM d),
 p AS (SELECT *, CASE WHEN CAST(s + to_months(k) AS DATE) > n THEN k - 1 ELSE k END AS j FROM m) SELECT o_orderkey, CAST(CAST(s + to_months(j) AS DATE) AS VARCHAR) AS period_start, CAST(CAST(s + to_months(j + 1) AS DATE) AS VARCHAR) AS period_next FROM p""")
def period_start(spark, sf_dir):
    now, at = F.lit(NOW).cast("timestamp"), F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", calendar.period_start(at, now).cast("string").alias("period_start"), calendar.period_next(at, now).cast("string").alias("period_next"))


USED = """s AS (SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate AS ts FROM orders WHERE o_orderkey % 4 = 0),
 a AS (SELECT user_id, arg_max(ts, (ts, id)) AS s FROM s GROUP BY 1), b AS (SELECT c_custkey AS user_id, CAST(s AS DATE) AS s FROM customer LEFT JOIN a ON user_id = c_custkey),
 m AS (SELECT *, CAST((2024 - year(s)) * 12 + 6 - month(s) AS INTEGER) AS k FROM b), p AS (SELECT user_id, coalesce(CAST(s + to_months(CASE WHEN CAST(s + to_months(k) AS DATE) > DATE '2024-06-15' THEN k - 1 ELSE k END) AS DATE), DATE '2024-06-01') AS st FROM m),
 ev AS (SELECT user_id % (SELECT max(c_custkey) FROM customer) AS user_id, ts + INTERVAL 150 DAY AS ts, value FROM events),
 used AS (SELECT p.user_id, coalesce(round(sum(value), 4), 0) AS used FROM p LEFT JOIN ev ON ev.user_id = p.user_id AND ev.ts >= p.st GROUP BY 1)"""


def _used(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    most = c.agg(F.max("user_id").alias("m"))
    periods = accounts.current_period(c, _accounts(spark, sf_dir), F.lit(NOW).cast("timestamp"))
    ev = table(spark, sf_dir, "events").join(most).select((F.col("user_id") % F.col("m")).alias("user_id"), (F.col("ts").cast("timestamp") + F.expr("interval 150 days")).alias("ts"), "value")
    return accounts.usage(ev, periods, "value", "ts").withColumn("used", F.round("used", 4))


@query(f"WITH {USED} SELECT user_id, used FROM used")
def period_usage(spark, sf_dir):
    return _used(spark, sf_dir)


@query(f"""WITH {USED}, l AS (SELECT c_custkey AS user_id, CASE c_mktsegment WHEN 'BUILDING' THEN -1 WHEN 'MACHINERY' THEN 100 WHEN 'FURNITURE' THEN NULL ELSE 0 END AS quota FROM customer)
 SELECT user_id, used, quota, coalesce(quota < 0 OR used < quota, false) AS allowed, CASE WHEN NOT quota < 0 THEN greatest(quota - used, 0) END AS remaining FROM used JOIN l USING (user_id)""")
def quota_check(spark, sf_dir):
    plan = F.when(F.col("c_mktsegment") == "BUILDING", -1).when(F.col("c_mktsegment") == "MACHINERY", 100).when(F.col("c_mktsegment") == "FURNITURE", None).otherwise(0)
    return accounts.quota(_used(spark, sf_dir), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), plan.alias("quota")))


@query("""WITH RECURSIVE q AS (SELECT o_orderkey AS id, o_custkey AS user_id, CAST(o_totalprice AS DECIMAL(28, 6)) AS a, CASE WHEN c_custkey % 7 = 0 THEN -1 ELSE (c_custkey % 10) * 200000 + 50000 END AS quota,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
 r AS (SELECT id, user_id, k, coalesce(quota < 0 OR a <= quota, false) AS ok, CASE WHEN quota < 0 OR a <= quota THEN a ELSE 0 END AS used FROM q WHERE k = 1
  UNION ALL SELECT q.id, q.user_id, q.k, coalesce(quota < 0 OR used + a <= quota, false), CASE WHEN quota < 0 OR used + a <= quota THEN used + a ELSE used END FROM r JOIN q ON q.user_id = r.user_id AND q.k = r.k + 1)
 SELECT id AS o_orderkey, ok AS admitted, CAST(used AS DOUBLE) AS used FROM r""")
def quota_admission(spark, sf_dir):
    key = F.col("c_custkey")
    limits = table(spark, sf_dir, "customer").select(key.alias("user_id"), F.when(key % 7 == 0, -1).otherwise(key % 10 * 200000 + 50000).alias("quota"))
    requests = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("o_orderdate"), "o_totalprice")
    return accounts.admit(requests, limits, "o_totalprice", "o_orderdate", "o_orderkey").select("o_orderkey", "admitted", F.col("used").cast("double").alias("used"))


SUBS = """sub AS (SELECT o_orderkey AS id, o_custkey AS user_id, CASE o_orderkey % 11 WHEN 0 THEN 'active' ELSE 'canceled' END AS status, o_orderdate + CASE o_orderkey % 11 WHEN 0 THEN INTERVAL 2000 DAY ELSE INTERVAL 20 DAY END AS e FROM orders),
 n AS (SELECT id AS sid, CASE WHEN id % 3 = 0 THEN 'warn1' ELSE 'warn2' END AS kind, CASE WHEN id % 7 = 0 THEN 'bounced' ELSE 'sent' END AS st, e + INTERVAL 25 DAY AS sent FROM sub WHERE id % 2 = 0 UNION ALL SELECT id, 'warn1', 'sent', e + INTERVAL 24 DAY FROM sub WHERE id % 5 = 0)"""
RETENTION_NOW = "1998-01-10 00:00:00"


@query(f"""WITH {SUBS}, now AS (SELECT (SELECT max(o_orderdate) FROM orders) AS now), u AS (SELECT user_id, bool_or(status = 'active' AND e > now) AS safe, max((e, id)) AS s FROM sub, now GROUP BY 1), c AS (SELECT user_id, s[1] AS e, s[2] AS id FROM u WHERE NOT safe),
 l AS (SELECT sid, kind, arg_max(st, sent) AS st, max(sent) AS sent FROM n GROUP BY ALL), j AS (SELECT c.*, w1.sent AS s1, w2.sent AS s2, e + INTERVAL 30 DAY AS due FROM c LEFT JOIN l w1 ON w1.sid = id AND w1.kind = 'warn1' LEFT JOIN l w2 ON w2.sid = id AND w2.kind = 'warn2'
 WHERE coalesce(w1.st, '') != 'bounced' AND coalesce(w2.st, '') != 'bounced'),
 a AS (SELECT user_id, id AS subscription_id, CASE WHEN s1 IS NULL THEN CASE WHEN now >= due - INTERVAL 7 DAY THEN 'warn1' END WHEN s2 IS NULL THEN CASE WHEN now >= greatest(due - INTERVAL 24 HOUR, s1 + INTERVAL 24 HOUR) THEN 'warn2' END
 ELSE CASE WHEN now >= greatest(due, s2 + INTERVAL 24 HOUR) THEN 'delete' END END AS action FROM j, now) SELECT * FROM a WHERE action IS NOT NULL""")
def retention_action(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    now = F.lit(o.agg(F.max(F.col("o_orderdate").cast("timestamp"))).first()[0])
    live = F.col("o_orderkey") % 11 == 0
    none = F.lit(None).cast("timestamp")
    subs = o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.when(live, "active").otherwise("canceled").alias("status"),
        (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(F.when(live, 2000).otherwise(20))).alias("expires_at"), none.alias("scheduled_deletion_at"), none.alias("data_deleted_at"),
    )
    later = lambda n: F.col("expires_at") + F.make_dt_interval(F.lit(n))
    a = subs.where("id % 2 = 0").select(F.col("id").alias("subscription_id"), F.when(F.col("id") % 3 == 0, "warn1").otherwise("warn2").alias("kind"), F.when(F.col("id") % 7 == 0, "bounced").otherwise("sent").alias("status"), later(25).alias("sent_at"))
    b = subs.where("id % 5 = 0").select(F.col("id").alias("subscription_id"), F.lit("warn1").alias("kind"), F.lit("sent").alias("status"), later(24).alias("sent_at"))
    return accounts.retention_actions(subs, a.unionAll(b), now).drop("deletion_date")


@query("SELECT p_partkey, CASE WHEN p_size % 4 != 0 THEN p_size % 4 WHEN p_partkey % 4 = 1 THEN 5 WHEN p_partkey % 4 = 2 THEN -1 ELSE 0 END AS max_runs FROM part")
def plan_limits(spark, sf_dir):
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, "Free").when(k == 1, "Pro").when(k == 2, "Enterprise").otherwise("Other")
    limit = F.when(F.col("p_size") % 4 != 0, F.col("p_size") % 4).when(F.col("p_partkey") % 2 == 0, 0)
    return accounts.fill_training_limits(table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), limit.alias("max_runs"))).select("p_partkey", "max_runs")


@query("""WITH s AS (SELECT o_custkey AS user_id, o_orderdate AS ts FROM orders), l AS (SELECT user_id, max(ts) AS last_at FROM s WHERE user_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 9 = 0) GROUP BY 1)
 SELECT user_id, epoch_us(last_at) AS last_at FROM l WHERE date_diff('day', CAST(last_at AS DATE), DATE '2024-06-15') > 180""")
def stale_users(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"), "o_orderkey")
    return accounts.stale_users(o, o.where("o_orderkey % 9 = 0"), F.lit(NOW).cast("timestamp")).select("user_id", us("last_at").alias("last_at"))


@query("""WITH f AS (SELECT l_orderkey AS k, count(*) AS n, '[' || string_agg('{"line":' || l_linenumber || ',"flag":"' || l_returnflag || '"}', ',' ORDER BY l_linenumber, l_returnflag) || ']' AS files FROM lineitem GROUP BY 1)
 SELECT o_orderkey, coalesce(n, 0) AS n_files, coalesce(files, '[]') AS files FROM orders LEFT JOIN f ON k = o_orderkey""")
def session_list_json(spark, sf_dir):
    files = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag"))
    return accounts.session_list(table(spark, sf_dir, "orders").select("o_orderkey"), files, "o_orderkey", ["line", "flag"], ["line", "flag"])


@query("SELECT o_custkey AS user_id, CAST(round(sum(o_totalprice), 2) AS DOUBLE) AS used FROM orders GROUP BY 1")
def keyed_upserts(spark, sf_dir):
    """Sums by customer in a stored table: two halves of the orders as batches, the second one applied twice."""
    path = shared_path(spark, "usage")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_totalprice").cast("decimal(28,6)").alias("used"), "o_orderkey")
    for number, half in enumerate((0, 1, 1)):
        batch = rows.where(F.pmod(F.xxhash64("o_orderkey"), F.lit(2)) == half).groupBy("user_id").agg(F.sum("used").cast("decimal(28,6)").alias("used"))
        keyed.apply(path, batch, ["user_id"], lambda old, new: setops.upsert_add(old, new, ["user_id"], "used").withColumn("used", F.col("used").cast("decimal(28,6)")), min(number, 1), 16)
    return keyed.read(spark, path).select("user_id", F.round(F.col("used").cast("double"), 2).alias("used"))


# --- text --------------------------------------------------------------------------------


@query("""WITH t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '=' || p_name WHEN 1 THEN ' +' || p_name WHEN 2 THEN '-12.5' WHEN 3 THEN '@' || p_name ELSE p_name END AS raw FROM part)
 SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 1, 3) THEN '''' || raw ELSE raw END AS cell FROM t""")
def csv_sanitize(spark, sf_dir):
    k, n = F.col("p_partkey") % 5, F.col("p_name")
    raw = F.when(k == 0, F.concat(F.lit("="), n)).when(k == 1, F.concat(F.lit(" +"), n)).when(k == 2, "-12.5").when(k == 3, F.concat(F.lit("@"), n)).otherwise(n)
    return table(spark, sf_dir, "part").select("p_partkey", scalar.safe_cell(raw).alias("cell"))


@query("SELECT p_partkey, p_retailprice AS price FROM part")
def decimal_comma(spark, sf_dir):
    text = F.concat(F.regexp_replace(F.col("p_retailprice").cast("string"), r"\.", ","), F.lit(" EUR"))
    return table(spark, sf_dir, "part").select("p_partkey", scalar.decimal_comma(text).alias("price"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_retailprice WHEN 1 THEN p_size END AS number FROM part")
def to_number(spark, sf_dir):
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.concat(F.lit(" "), F.col("p_retailprice").cast("string"))).when(k == 1, F.col("p_size").cast("string")).when(k == 2, F.concat(F.col("p_size").cast("string"), F.lit("d"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", scalar.to_number(raw).alias("number"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice END AS load, CASE WHEN p_partkey % 3 = 0 THEN 'n/a' ELSE CAST(p_retailprice AS VARCHAR) END AS load_original FROM part")
def keep_original(spark, sf_dir):
    from tidemark.sources.text import pick_columns, with_original

    raw = F.when(F.col("p_partkey") % 3 == 0, "n/a").otherwise(F.col("p_retailprice").cast("string"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("UTC"), raw.alias("load"))
    name = pick_columns(rows.columns, ("load",))
    return with_original(rows).select(F.col("UTC").alias("p_partkey"), name, f"{name}_original")


@query("SELECT o_orderkey, epoch_us(date_trunc('minute', o_orderdate)) AS at FROM orders")
def datetime_multi(spark, sf_dir):
    from tidemark.sources.text import TextSpec, standardise

    rows = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "dd.MM.yyyy HH:mm").alias("t"), F.col("o_orderkey").cast("string").alias("k"))
    return standardise(rows, TextSpec()).select(F.col("value").cast("long").alias("o_orderkey"), us().alias("at"))


@query("SELECT event_id, CASE WHEN value IS NOT NULL THEN printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) END AS hms FROM (SELECT event_id, value, CAST(floor(value * 1000) AS BIGINT) AS s FROM events)")
def duration_text(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalar.hms(F.floor(F.col("value") * 1000)).alias("hms"))


@query("""WITH t AS (SELECT event_id, ts, timezone('Europe/Vienna', ts) AS z FROM (SELECT event_id, ts + to_days(CAST(event_id % 330 AS INTEGER)) AS ts FROM events)) SELECT event_id, epoch_us(z) AS utc FROM t
 WHERE NOT (ts >= TIMESTAMP '2024-03-31 02:00:00' AND ts < TIMESTAMP '2024-03-31 03:00:00') AND NOT (ts >= TIMESTAMP '2024-10-27 02:00:00' AND ts < TIMESTAMP '2024-10-27 03:00:00')""")
def local_to_utc(spark, sf_dir):
    ts = F.col("ts").cast("timestamp") + F.make_dt_interval((F.col("event_id") % 330).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", us(scalar.local_to_utc(ts, "Europe/Vienna")).alias("utc")).where("utc is not null")


@query(f"WITH {N} SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS \"UTC\", row_pos, value IS NULL AS missing FROM s")
def csv_rows(spark, sf_dir):
    s = event_series(spark, sf_dir, MISSING)
    return s.select(F.date_format("ts", sinks.TIME_FORMAT).alias("UTC"), "row_pos", F.col("value").isNull().alias("missing"))
