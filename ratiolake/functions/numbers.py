"""Fractions, ratios and rounding. All native, but for what needs a double's exact decimal digits."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache
from math import gcd as gcd_of

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arith import Results, div, gcd


@F.pandas_udf(T.StringType())
def to_fixed(x: pd.Series, places: pd.Series) -> pd.Series:
    """x with so many places as its exact binary value rounds, halves away from zero: 1.005 gives 1.00, -2.5 gives -3."""

    def one(v: float, p: float) -> str | None:
        if v is None or p is None or v != v or p != p or v in (float("inf"), float("-inf")):
            return None
        return f"{Decimal(v).quantize(Decimal(1).scaleb(-int(p)), ROUND_HALF_UP):f}"

    return pd.Series([one(v, p) for v, p in zip(x, places, strict=True)], dtype=object)


def signed_fixed(x: Column, places: Column) -> Column:
    """As to_fixed, with + if the rounded number is above 0."""
    text = to_fixed(x, places)
    return F.when(text.cast("double") > 0, F.concat(F.lit("+"), text)).otherwise(text)


_FRACTION = T.StructType([T.StructField("num", T.DoubleType()), T.StructField("den", T.DoubleType())])


@F.pandas_udf(_FRACTION)
def decimal_fraction(x: pd.Series) -> pd.DataFrame:
    """The fraction that the shortest decimal digits of x spell, at most 12 of them after the point, reduced."""
    from math import gcd as common

    rows = []
    for v in x:
        if v is None or v != v or v in (float("inf"), float("-inf")):
            rows.append((None, None))
            continue
        digits = max(0, min(12, -Decimal(repr(abs(v))).normalize().as_tuple().exponent))
        scale = 10**digits
        num = int(abs(v) * scale + 0.5)
        g = common(num, scale) or 1
        rows.append(((-1 if v < 0 else 1) * (num // g) + 0.0, float(scale // g)))
    return pd.DataFrame(rows, columns=["num", "den"])


def percent_to_fraction(percent: Column) -> Column:
    """struct(num, den) of a percentage."""
    return decimal_fraction(percent / 100)


def best_fraction(x: Column, most: int = 1000) -> Column:
    """struct(num, den): the reduced fraction nearest x with a denominator up to `most`, the smallest denominator of equals; one within 1e-12 ends the search."""

    @F.pandas_udf(_FRACTION)
    def nearest(x: pd.Series) -> pd.DataFrame:
        v = x.to_numpy(float)
        a = np.abs(v)
        num, den, err = np.zeros(len(a)), np.ones(len(a)), np.full(len(a), np.inf)
        for d in range(1, most + 1):
            n = np.floor(a * d + 0.5)
            e = np.abs(a - n / d)
            closer = (err >= 1e-12) & (e < err)
            num, den, err = np.where(closer, n, num), np.where(closer, float(d), den), np.where(closer, e, err)
        return pd.DataFrame({"num": np.where(v == 0, 0.0, np.sign(v) * num), "den": den})

    return F.when(x.isNotNull(), nearest(x))


def simplify(num: Column, den: Column) -> Results:
    """A fraction of whole numbers in lowest terms, the sign above; null if den is 0."""
    g = gcd(num, den).cast("double")
    s = F.signum(den)
    return {"num": F.when(den != 0, s * num / g), "den": F.when(den != 0, s * den / g)}


def add(a: Column, b: Column, c: Column, d: Column) -> Results:
    """a/b + c/d in lowest terms."""
    return simplify(a * d + c * b, b * d)


def compare(a: Column, b: Column, c: Column, d: Column) -> Column:
    """-1, 0 or 1 as a/b is below, at or above c/d; null if a denominator is 0."""
    return F.when((b != 0) & (d != 0), F.signum((a * d - c * b) * F.signum(b * d)).cast("int"))


def share(total: Column, a: Column, b: Column) -> Results:
    """total dealt in the ratio a : b."""
    return {"first": div(total * a, a + b), "second": div(total * b, a + b)}


def same_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether a : b and c : d are the same, to within 1e-9."""
    return F.when((b != 0) & (d != 0), F.abs(a / b - c / d) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(a / b)))


def _scale(places: Column) -> Column:
    return F.pow(F.lit(10.0), places.cast("double"))


def round_half_up(x: Column, places: Column) -> Column:
    """Halves go away from zero."""
    return F.signum(x) * F.floor(F.abs(x) * _scale(places) + 0.5) / _scale(places)


def truncate(x: Column, places: Column) -> Column:
    return F.signum(x) * F.floor(F.abs(x) * _scale(places)) / _scale(places)


def magnitude(x: Column) -> Column:
    """The power of ten that x has its first digit at; null for 0."""
    return F.when(x != 0, F.floor(F.log10(F.abs(x)) + 1e-12).cast("int"))


def significant(x: Column, digits: Column) -> Column:
    return F.when(x == 0, F.lit(0.0)).otherwise(round_half_up(x, digits - 1 - magnitude(x)))


def rounding_error(x: Column, places: Column) -> Results:
    rounded = round_half_up(x, places)
    return {"rounded": rounded, "absolute": F.abs(rounded - x), "percent": div(F.abs(rounded - x), F.abs(x)) * 100}


def fraction_to_percent(num: Column, den: Column) -> Results:
    """A fraction of whole numbers in lowest terms, as a decimal and as a percentage."""
    return {**simplify(num, den), "decimal": div(num, den), "percent": div(num, den) * 100}


def decimal_percent(mode: Column, x: Column) -> Column:
    """mode 'to_percent': x * 100; 'to_decimal': x / 100."""
    return F.when(mode == "to_percent", x * 100).when(mode == "to_decimal", x / 100)


def unit_fraction(num: Column, den: Column) -> Column:
    """'1/n' for fractions of that form, else null."""
    return F.when(num == 1, F.concat(F.lit("1/"), den.cast("long").cast("string")))


_PERIODIC = T.StructType([T.StructField("whole", T.LongType()), T.StructField("before", T.StringType()), T.StructField("period", T.StringType()), T.StructField("length", T.LongType())])


def _primes(n: int) -> list[int]:
    """The distinct prime factors of n."""
    found, d = [], 2
    while d * d <= n:
        if n % d == 0:
            found.append(d)
            while n % d == 0:
                n //= d
        d += 1
    return found + ([n] if n > 1 else [])


@lru_cache(1 << 14)
def period_length(n: int) -> tuple[int, int]:
    """How many digits of 1/n come before its period, and how many the period has: what 2 and 5 take, and the order of 10 modulo the rest."""
    powers = []
    for p in (2, 5):
        powers.append(0)
        while n % p == 0:
            n, powers[-1] = n // p, powers[-1] + 1
    if n == 1:
        return max(powers), 0
    order = n
    for p in _primes(n):
        order = order // p * (p - 1)
    for p in _primes(order):
        while order % p == 0 and pow(10, order // p, n) == 1:
            order //= p
    return max(powers), order


def _digits(rest: int, den: int, n: int) -> Iterator[str]:
    """The first n digits of rest/den after the point, a thousand at a time."""
    for at in range(0, n, 1000):
        k = min(1000, n - at)
        some, rest = divmod(rest * 10**k, den)
        yield str(some).zfill(k)


def periodic(num: Column, den: Column, most: int = 10_000) -> Column:
    """struct(whole, before, period, length): a fraction of whole numbers as a decimal, the digits after the point before and in the period, and how many the period has.

    whole is the absolute value's; period is empty where the decimal ends, and null where it has more than `most` digits.
    Null for a null number or a denominator of 0.
    """

    @F.pandas_udf(_PERIODIC)
    def told(num: pd.Series, den: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(num, den, strict=True):
            if pd.isna(a) or pd.isna(b) or b == 0:
                rows.append((None,) * 4)
                continue
            a, b = abs(int(a)), abs(int(b))
            g = gcd_of(a, b)
            a, b = a // g, b // g
            first, length = period_length(b)
            head, rest = divmod(a % b * 10**first, b)
            rows.append((a // b, str(head).zfill(first) if first else "", None if length > most else "".join(_digits(rest, b, length)), length))
        return pd.DataFrame(rows, columns=["whole", "before", "period", "length"]).astype({"whole": "Int64", "length": "Int64"})

    known = num.isNotNull() & den.isNotNull() & (den != 0)
    return F.when(known, told(num.cast("long"), den.cast("long")))
