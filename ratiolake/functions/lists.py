"""Tools over lists in a row: arrays of doubles, in their order, through higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arith import Results, div


def product(values: Column) -> Column:
    return F.aggregate(values, F.lit(1.0), lambda k, x: k * x)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda k, x: k + x)


def equivalent(base: Column, percents: Column) -> Results:
    """One percentage for several in a row; null percents count as 0."""
    k = product(F.transform(percents, lambda p: 1 + F.coalesce(p, F.lit(0.0)) / 100))
    return {"coefficient": k, "percent": (k - 1) * 100, "final": base * k, "naive": total(F.transform(percents, lambda p: F.coalesce(p, F.lit(0.0))))}


def composition(base: Column, percents: Column) -> Results:
    """A percentage of a percentage of ... base; a null base makes only the amount null."""
    k = product(F.transform(percents, lambda p: F.coalesce(p, F.lit(0.0)) / 100))
    return {"coefficient": k, "percent": k * 100, "amount": base * k}


def weighted(rows: Column) -> Results:
    """rows: array of struct(rate, weight); nulls count as 0, weights may be negative."""
    w = total(F.transform(rows, lambda r: F.coalesce(r["weight"], F.lit(0.0))))
    s = total(F.transform(rows, lambda r: F.coalesce(r["rate"], F.lit(0.0)) * F.coalesce(r["weight"], F.lit(0.0))))
    return {"weights": w, "weighted_sum": s, "mean": div(s, w)}


def label(index: Column) -> Column:
    """A to Z for 0 to 25, then AA, AB and so on."""
    letter = lambda n: F.char((n + 65).cast("int"))
    return F.when(index < 26, letter(index)).otherwise(F.concat(letter(F.floor(index / 26) - 1), letter(index % 26)))


def parts(values: Column) -> Results:
    """Shares of the parts of a whole; shares are null if the sum is 0."""
    s = total(F.transform(values, lambda v: F.coalesce(v, F.lit(0.0))))
    first = F.coalesce(F.try_element_at(values, F.lit(1)), F.lit(0.0))
    shares = F.transform(values, lambda v, i: F.struct(label(i).alias("label"), v.alias("value"), (div(F.coalesce(v, F.lit(0.0)), s) * 100).alias("percent")))
    return {"total": s, "first_percent": div(first, s) * 100, "rest": s - first, "rest_percent": div(s - first, s) * 100, "shares": shares}


def _columns(r1: Column, r2: Column) -> Column:
    """The table's columns that have both cells: array of struct(at, r1, r2, k); k is null if r1 is 0."""
    both = F.transform(F.arrays_zip(r1.alias("r1"), r2.alias("r2")), lambda c, i: F.struct((i + 1).alias("at"), c["r1"].alias("r1"), c["r2"].alias("r2"), div(c["r2"], c["r1"]).alias("k")))
    return F.filter(both, lambda c: c["r1"].isNotNull() & c["r2"].isNotNull())


def _bad(columns: Column) -> Column:
    k0 = F.try_element_at(columns, F.lit(1))["k"]
    return F.filter(columns, lambda c: F.abs(c["k"] - k0) > 1e-9 * F.greatest(F.lit(1.0), F.abs(k0)))


def table_check(r1: Column, r2: Column) -> Results:
    """Whether two rows are proportional: code 'div0', 'need_data', 'not_proportional' or 'ok'; k and the numbers of bad columns."""
    c = _columns(r1, r2)
    zero = F.exists(c, lambda x: x["r1"] == 0)
    code = F.when(zero, "div0").when(F.size(c) < 2, "need_data").when(F.size(_bad(c)) > 0, "not_proportional").otherwise("ok")
    return {"code": code, "k": F.when(~zero & (F.size(c) >= 2), F.try_element_at(c, F.lit(1))["k"]), "bad": F.when(code == "not_proportional", F.transform(_bad(c), lambda x: x["at"])).otherwise(F.array().cast("array<int>"))}


def table_complete(r1: Column, r2: Column) -> Results:
    """The one empty cell of two proportional rows: code, the row and column it is in, its value."""
    c = _columns(r1, r2)
    k = F.try_element_at(c, F.lit(1))["k"]
    gaps = lambda r: F.filter(F.transform(r, lambda x, i: F.when(x.isNull(), i + 1)), lambda i: i.isNotNull())
    g1, g2 = gaps(r1), gaps(r2)
    code = (
        F.when(F.exists(c, lambda x: x["r1"] == 0), "div0")
        .when(F.size(g1) + F.size(g2) != 1, "need_one_empty")
        .when(F.size(c) == 0, "no_reference")
        .when(F.size(_bad(c)) > 0, "not_proportional")
        .when((F.size(g1) == 1) & (k == 0), "div0")
        .otherwise("ok")
    )
    at = F.when(code == "ok", F.try_element_at(F.concat(g1, g2), F.lit(1)))
    other = lambda r: F.coalesce(F.try_element_at(r, at), F.lit(0.0))
    return {"code": code, "row": F.when(code == "ok", F.when(F.size(g1) == 1, 1).otherwise(2)), "at": at, "value": F.when(code == "ok", F.when(F.size(g1) == 1, div(other(r2), k)).otherwise(k * other(r1)))}
