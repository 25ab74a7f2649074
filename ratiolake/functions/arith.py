"""Percentage and rule-of-three tools as column expressions.

Each tool takes columns of doubles and gives its results by name. The rules are the same everywhere: a null
input makes a null result, a zero denominator makes null and never an error or infinity, and values are
unrounded doubles, computed in the order written. All are plain expressions inside whole-stage code generation, but
for the greatest common divisor, which is no function of Spark: Arrow batches go through numpy.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Results = dict[str, Column]


def div(x: Column, y: Column) -> Column:
    """x / y; null where y is 0."""
    return F.try_divide(x, y)


def trend(delta: Column) -> Column:
    return F.when(delta > 0, "up").when(delta < 0, "down").when(delta == 0, "flat")


def of_number(percent: Column, base: Column) -> Results:
    return {"amount": base * percent / 100, "coefficient": percent / 100, "one_percent": base / 100}


def what_percent(x: Column, y: Column) -> Results:
    return {"ratio": div(x, y), "percent": div(x, y) * 100}


def variation(a: Column, b: Column) -> Results:
    return {"delta": b - a, "percent": div(b - a, a) * 100, "multiplier": div(b, a), "trend": trend(b - a)}


def increase_decrease(base: Column, rate: Column) -> Results:
    k = 1 + rate / 100
    return {"coefficient": k, "final": base * k, "delta": base * k - base, "trend": trend(rate)}


def reverse(final: Column, rate: Column) -> Results:
    return {"base": div(final, 1 + rate / 100)}


def applied_rate(a: Column, b: Column) -> Results:
    return {"coefficient": div(b, a), "rate": (div(b, a) - 1) * 100, "difference": b - a}


def missing_rate(base: Column, target: Column) -> Results:
    return applied_rate(base, target)


def coefficient(mode: Column, x: Column) -> Results:
    """mode 'percent_to_coef' or 'coef_to_percent'."""
    return {"converted": F.when(mode == "percent_to_coef", 1 + x / 100).when(mode == "coef_to_percent", (x - 1) * 100)}


def relative_difference(a: Column, b: Column) -> Results:
    d, m = F.abs(a - b), (F.abs(a) + F.abs(b)) / 2
    return {"difference": d, "mean": m, "percent": div(d, m) * 100}


def successive(base: Column, *percents: Column) -> Results:
    """Null percents count as 0 here."""
    k = F.lit(1.0)
    for p in percents:
        k = k * (1 + F.coalesce(p, F.lit(0.0)) / 100)
    return {"coefficient": k, "final": base * k, "percent": (k - 1) * 100}


def difference_to(a: Column, b: Column, ref: Column) -> Results:
    """ref 'a' or 'b' names the value that the difference b - a is held against."""
    return {
        "difference": b - a,
        "percent": div(b - a, F.when(ref == "a", a).when(ref == "b", b)) * 100,
        "ratio": F.when(ref == "a", div(b, a)).when(ref == "b", div(a, b)),
    }


def compare(p: Column, q: Column, base: Column) -> Results:
    ca, cb = 1 + p / 100, 1 + q / 100
    va, vb = base * ca, base * cb
    return {"value_a": va, "value_b": vb, "difference": vb - va, "percent": div(vb - va, va) * 100}


def cumulative_or_naive(base: Column, p: Column, q: Column) -> Results:
    compounded, naive = base * (1 + p / 100) * (1 + q / 100), base * (1 + (p + q) / 100)
    return {"compounded": compounded, "naive": naive, "difference": compounded - naive, "percent": div(compounded - naive, naive) * 100}


def points(a: Column, b: Column) -> Results:
    return {"points": b - a, "percent": div(b - a, a) * 100, "ratio": div(b, a)}


def error(measured: Column, reference: Column) -> Results:
    d = measured - reference
    return {"signed": d, "absolute": F.abs(d), "percent": div(F.abs(d), F.abs(reference)) * 100, "ratio": div(measured, reference)}


def of_total(value: Column, total: Column) -> Results:
    ratio = div(value, total)
    return {"ratio": ratio, "percent": ratio * 100, "remaining": total - value, "percent_left": 100 - ratio * 100, "over": (total != 0) & (value > total)}


def part_of_total(mode: Column, part: Column, percent: Column, total: Column) -> Results:
    """mode 'pctFromPart', 'valueFromPct' or 'totalFromPartPct'; any other works like the last for rest."""
    value, whole = percent / 100 * total, div(part, percent / 100)
    rest = F.when(mode == "pctFromPart", total - part).when(mode == "valueFromPct", total - value).otherwise(whole - part)
    result = F.when(mode == "pctFromPart", div(part, total) * 100).when(mode == "valueFromPct", value).when(mode == "totalFromPartPct", whole)
    warning = F.when((mode == "pctFromPart") & (total == 0), "total_zero").when((mode == "totalFromPartPct") & (percent == 0), "percent_zero")
    return {"result": result, "rest": rest, "warning": warning}


#: What a variation means, by the signs of both values and where its percentage lies (above, below). The first row that fits counts; None fits all.
MEANINGS = [
    # first, second, above, below, code
    (0, 0, None, None, "both_zero"),
    (0, None, None, None, "from_zero"),
    (1, 0, None, None, "minus_100"),
    (1, 1, 1000, None, "huge"),
    (1, 1, None, -100, "below_minus_100"),
    (1, 1, None, None, "ok"),
    (None, None, None, None, "generic"),
]
#: Warnings by the signs of both values.
WARNINGS = [(0, 1, "initial_zero"), (0, -1, "initial_zero"), (1, -1, "negative_final")]


def limits(a: Column, b: Column) -> Results:
    """A variation with a warning and what it means; both are null for null inputs."""
    v = div(b - a, a) * 100

    def fits(first: int | None, second: int | None, above: float | None = None, below: float | None = None) -> Column:
        rules = [F.signum(c) == sign for c, sign in ((a, first), (b, second)) if sign is not None]
        rules += [v > above] if above is not None else []
        rules += [v < below] if below is not None else []
        return reduce(Column.__and__, rules, F.lit(True))

    meaning = F.coalesce(*[F.when(fits(*row[:-1]), row[-1]) for row in MEANINGS])
    warning = F.coalesce(*[F.when(fits(*row[:-1]), row[-1]) for row in WARNINGS])
    return {"delta": b - a, "coefficient": div(b, a), "percent": v, "warning": warning, "meaning": F.when(a.isNotNull() & b.isNotNull(), meaning)}


@F.pandas_udf(T.LongType())
def common_divisor(a: pd.Series, b: pd.Series) -> pd.Series:
    known = a.notna() & b.notna()
    out = pd.Series(pd.NA, index=a.index, dtype="Int64")
    out[known] = np.gcd(a[known].to_numpy(np.int64), b[known].to_numpy(np.int64))
    return out


def gcd(a: Column, b: Column) -> Column:
    """The greatest common divisor of two columns of integers (or doubles that are integers below 2**53), a batch of rows at a time."""
    return common_divisor(F.abs(a).cast("long"), F.abs(b).cast("long"))


def whole(x: Column) -> Column:
    """x as an integer, if it is one to within 1e-9."""
    n = F.floor(x + 0.5).cast("double")
    return F.when(F.abs(x - n) < 1e-9, n)


def ratio(a: Column, b: Column) -> Results:
    """The ratio is reduced only where both numbers are whole to within 1e-9, and not both 0."""
    wa, wb = whole(a), whole(b)
    g = gcd(wa, wb).cast("double")
    reduced = F.when(g != 0, F.concat((wa / g).cast("long").cast("string"), F.lit(":"), (wb / g).cast("long").cast("string")))
    return {
        "a_of_b": div(a, b) * 100,
        "b_of_a": div(b, a) * 100,
        "share_a": div(a, a + b) * 100,
        "share_b": div(b, a + b) * 100,
        "reduced": reduced,
        "warning": F.when(a.isNull() | b.isNull(), F.lit(None).cast("string")).when(b == 0, "b_zero").when(a == 0, "a_zero"),
    }


def rule_of_three(a: Column, b: Column, c: Column) -> Results:
    """a is to b as c is to x."""
    return {"ratio": div(b, a), "x": div(b * c, a)}


def inverse_rule_of_three(a: Column, b: Column, c: Column) -> Results:
    return {"product": a * b, "x": div(a * b, c)}
