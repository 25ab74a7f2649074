"""Descriptive statistics per group, exact, without sorting a whole group in one task.

`cumulative` is the base of all that needs ranks: equal values are added up first and dealt out in ranges; a
window runs inside each range, and the ranges' totals, a few rows a group, give the offsets. Any quantile,
median, trimmed or winsorized mean is then an aggregate over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratiolake.functions.arith import div
from ratiolake.tables import before_each_range, ranged


def cumulative(rows: DataFrame, group: str, value: str, weight: str | None = None) -> DataFrame:
    """(group, value, w, upto, total): w the weight (else count) of the value's rows, upto that of all values up to it.

    Null values are left out; null weights count as 0. A null group is a group.
    """
    w = F.sum(F.coalesce(F.col(weight), F.lit(0.0))) if weight else F.count("*")
    each = ranged(rows.filter(F.col(value).isNotNull()).groupBy(group, value).agg(w.alias("w")), [group, value], "values")
    inside = Window.partitionBy(group, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("_in", F.sum("w").over(inside))
    totals = before_each_range(each, group, "w")
    joined = placed.join(totals, placed[group].eqNullSafe(totals["_g"]) & (placed["_range"] == totals["_r"]))
    return joined.select(group, value, "w", (F.col("_in") + F.col("_before")).alias("upto"), "total")


def at_rank(value: str, rank: Column) -> Column:
    """Aggregate over `cumulative`: the value at a rank from 1."""
    return F.min(F.when(F.col("upto") >= rank, F.col(value)))


def quantile(value: str, p: float) -> Column:
    """Aggregate over `cumulative`: the quantile with linear interpolation between ranks."""
    h = (F.col("total") - 1) * p
    lo, hi = at_rank(value, F.floor(h) + 1), at_rank(value, F.ceil(h) + 1)
    return lo + (hi - lo) * F.max(h - F.floor(h))


def describe(rows: DataFrame, group: str, value: str, tail: float = 0.1) -> DataFrame:
    """Rank statistics per group: quartiles, median, iqr, mode (the smallest of several), range, trimmed and winsorized mean with floor(n * tail) values off each end."""
    c = cumulative(rows, group, value)
    k = F.floor(F.col("total") * tail)
    inner = F.greatest(F.lit(0), F.least(F.col("upto"), F.col("total") - k) - F.greatest(F.col("upto") - F.col("w"), k))
    kept, held = F.sum(F.col(value) * inner), F.sum(inner)
    low, high = at_rank(value, k + 1), at_rank(value, F.col("total") - k)
    out = c.groupBy(group).agg(
        F.max("total").alias("n"),
        quantile(value, 0.25).alias("q1"),
        quantile(value, 0.5).alias("median"),
        quantile(value, 0.75).alias("q3"),
        F.min(value).alias("least"),
        F.max(value).alias("most"),
        F.max(F.struct("w", (-F.col(value)).alias("v"))).alias("_mode"),
        div(kept, held).alias("trimmed_mean"),
        div(kept + F.max(k) * (low + high), F.max("total")).alias("winsorized_mean"),
    )
    return out.select(group, "n", "q1", "median", "q3", (F.col("q3") - F.col("q1")).alias("iqr"), (-F.col("_mode.v")).alias("mode"), "least", "most", (F.col("most") - F.col("least")).alias("range"), "trimmed_mean", "winsorized_mean")


def means(rows: DataFrame, group: str, value: str, weight: str) -> DataFrame:
    """Arithmetic, weighted, geometric, harmonic and quadratic mean per group; the geometric and harmonic one over positive values."""
    x, w = F.col(value), F.col(weight)
    up = F.when(x > 0, x)
    return rows.groupBy(group).agg(
        F.avg(x).alias("mean"),
        div(F.sum(F.coalesce(x, F.lit(0.0)) * F.coalesce(w, F.lit(0.0))), F.sum(F.coalesce(w, F.lit(0.0)))).alias("weighted_mean"),
        F.exp(F.avg(F.ln(up))).alias("geometric_mean"),
        div(F.count(up).cast("double"), F.sum(1 / up)).alias("harmonic_mean"),
        F.sqrt(F.avg(x * x)).alias("rms"),
    )


def weighted_median(rows: DataFrame, group: str, value: str, weight: str) -> DataFrame:
    """The smallest value whose cumulative weight is half the total or more."""
    return cumulative(rows, group, value, weight).filter(F.col("upto") >= F.col("total") / 2).groupBy(group).agg(F.min(value).alias("weighted_median"))


def grouped_median(rows: DataFrame, group: str, value: str, width: float) -> DataFrame:
    """Median of values known by class only: L + ((N/2 - C) / f) * h for the class that holds the middle."""
    classes = rows.select(group, (F.floor(F.col(value) / width) * width).cast("double").alias("low"))
    c = cumulative(classes, group, "low").filter(F.col("upto") >= F.col("total") / 2)
    first = c.groupBy(group).agg(F.min_by(F.struct("low", "w", "upto", "total"), "low").alias("m"))
    return first.select(group, (F.col("m.low") + (F.col("m.total") / 2 - (F.col("m.upto") - F.col("m.w"))) / F.col("m.w") * width).alias("grouped_median"))


def grouped_mean(rows: DataFrame, group: str, value: str, width: float) -> DataFrame:
    """Mean by class midpoints."""
    middle = F.floor(F.col(value) / width) * width + width / 2
    return rows.groupBy(group).agg(F.avg(middle).alias("grouped_mean"))


def mean_of_means(means_of: DataFrame, group: str, mean: str, n: str) -> DataFrame:
    return means_of.groupBy(group).agg(div(F.sum(F.col(mean) * F.col(n)), F.sum(n).cast("double")).alias("mean"))


def moving_average(rows: DataFrame, group: str, order: list[str], value: str, k: int) -> DataFrame:
    """rows with the mean of the last k values; null until there are k."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(-(k - 1), 0)
    return rows.withColumn("moving_average", F.when(F.count(F.lit(1)).over(w) == k, F.avg(value).over(w)))


def outlier_effect(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Mean and median with and without values over 1.5 iqr from the quartiles, and how far apart they are."""
    d = describe(rows, group, value).select(F.col(group).alias("_g"), "q1", "q3", "iqr")
    inner = rows.join(d, rows[group].eqNullSafe(d["_g"])).filter(F.col(value).between(F.col("q1") - 1.5 * F.col("iqr"), F.col("q3") + 1.5 * F.col("iqr")))
    mid = lambda r, s: cumulative(r, group, value).groupBy(group).agg(div(F.sum(F.col(value) * F.col("w")), F.max("total").cast("double")).alias(f"mean{s}"), quantile(value, 0.5).alias(f"median{s}"))
    both = mid(rows, "").join(mid(inner, "_inner"), group)
    return both.withColumn("gap", F.col("mean") - F.col("median")).withColumn("gap_inner", F.col("mean_inner") - F.col("median_inner"))
