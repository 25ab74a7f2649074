"""Statistics over events and order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratiolake.operators import stats

_KEEP = {"event_type", "l_returnflag", "l_linestatus", "n", "user_id", "event_id"}


def _round(df: DataFrame) -> DataFrame:
    return df.select(*[c if c in _KEEP else (F.round(c, 6) + 0).alias(c) for c in df.columns])


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")


def s01_means(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_returnflag", "l_discount", "l_extendedprice")
    return _round(stats.means(rows, "l_returnflag", "l_discount", "l_extendedprice"))


def s06_rank_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _round(stats.describe(_events(spark, d), "event_type", "value"))


def s08_moving_average(spark: SparkSession, d: str) -> DataFrame:
    return _round(stats.moving_average(_events(spark, d), "user_id", ["ts", "event_id"], "value", 3).select("event_id", "user_id", "moving_average"))


def s09_grouped_mean(spark: SparkSession, d: str) -> DataFrame:
    return _round(stats.grouped_mean(_events(spark, d), "event_type", "value", 10.0))


def s10_mean_of_means(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    per = rows.groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_quantity").alias("m"), F.count("*").alias("k"))
    return _round(stats.mean_of_means(per, "l_returnflag", "m", "k"))


def s12_weighted_median(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_returnflag", "l_extendedprice", "l_quantity")
    return _round(stats.weighted_median(rows, "l_returnflag", "l_extendedprice", "l_quantity"))


def s13_grouped_median(spark: SparkSession, d: str) -> DataFrame:
    return _round(stats.grouped_median(_events(spark, d), "event_type", "value", 10.0))


def s16_outlier_effect(spark: SparkSession, d: str) -> DataFrame:
    return _round(stats.outlier_effect(_events(spark, d), "event_type", "value"))


QUERIES = {f.__name__: f for f in (s01_means, s06_rank_statistics, s08_moving_average, s09_grouped_mean, s10_mean_of_means, s12_weighted_median, s13_grouped_median, s16_outlier_effect)}

ORACLE_SQL = {
    "s01_means": "SELECT l_returnflag, round(avg(x), 6) AS mean, round(sum(x * w) / nullif(sum(w), 0), 6) AS weighted_mean, round(exp(avg(ln(x)) FILTER (x > 0)), 6) AS geometric_mean, round(count(*) FILTER (x > 0) / sum(1 / x) FILTER (x > 0), 6) AS harmonic_mean, round(sqrt(avg(x * x)), 6) AS rms FROM (SELECT l_returnflag, l_discount AS x, l_extendedprice AS w, nullif(l_discount, 0) AS y FROM lineitem) GROUP BY 1",
    "s06_rank_statistics": """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
m AS (SELECT event_type, value, count(*) AS c FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
k AS (SELECT event_type, floor(n * 0.1) AS k, i, n, value FROM r),
b AS (SELECT event_type, min(value) FILTER (i = k + 1) AS lo, min(value) FILTER (i = n - k) AS hi FROM k GROUP BY 1)
SELECT k.event_type, any_value(n) AS n, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3,
  round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, round((SELECT arg_max(value, (c, -value)) FROM m WHERE m.event_type = k.event_type), 6) AS mode,
  round(min(value), 6) AS least, round(max(value), 6) AS most, round(max(value) - min(value), 6) AS range,
  round(avg(value) FILTER (i > k AND i <= n - k), 6) AS trimmed_mean, round(avg(least(greatest(value, lo), hi)), 6) AS winsorized_mean
FROM k JOIN b ON b.event_type = k.event_type GROUP BY k.event_type""",
    "s08_moving_average": "SELECT event_id, user_id, CASE WHEN count(*) OVER w = 3 THEN round(avg(value) OVER w, 6) END AS moving_average FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)",
    "s09_grouped_mean": "SELECT event_type, round(avg(floor(value / 10) * 10 + 5), 6) AS grouped_mean FROM events GROUP BY 1",
    "s10_mean_of_means": "SELECT l_returnflag, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1",
    "s12_weighted_median": "SELECT l_returnflag, round(min(x), 6) AS weighted_median FROM (SELECT l_returnflag, l_extendedprice AS x, sum(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS u, sum(l_quantity) OVER (PARTITION BY l_returnflag) AS t FROM lineitem) WHERE u >= t / 2 GROUP BY 1",
    "s13_grouped_median": "WITH c AS (SELECT event_type, floor(value / 10) * 10 AS low, count(*) AS f FROM events WHERE value IS NOT NULL GROUP BY 1, 2), u AS (SELECT *, sum(f) OVER (PARTITION BY event_type ORDER BY low) AS u, sum(f) OVER (PARTITION BY event_type) AS n FROM c) SELECT event_type, round(low + (n / 2 - (u - f)) / f * 10, 6) AS grouped_median FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY low) AS i FROM u WHERE u >= n / 2) WHERE i = 1",
    "s16_outlier_effect": """
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
a AS (SELECT event_type, avg(value) AS mean, median(value) AS median FROM events GROUP BY 1),
b AS (SELECT e.event_type, avg(value) AS mean, median(value) AS median FROM events e JOIN q ON q.event_type = e.event_type WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY 1)
SELECT a.event_type, round(a.mean, 6) AS mean, round(a.median, 6) AS median, round(b.mean, 6) AS mean_inner, round(b.median, 6) AS median_inner, round(a.mean - a.median, 6) AS gap, round(b.mean - b.median, 6) AS gap_inner
FROM a JOIN b ON a.event_type = b.event_type""",
}
