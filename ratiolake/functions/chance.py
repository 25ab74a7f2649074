"""Random numbers that follow from a seed, shuffles and weighted picks: the same everywhere, for every seed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import fnv1a

#: The steps of the generator (mulberry32).
STEP, MASK = 0x6D2B79F5, 0xFFFFFFFF


def _u32(x: Column) -> Column:
    return x.bitwiseAND(F.lit(MASK))


def _times(a: Column, b: Column) -> Column:
    """a * b modulo 2**32 of numbers below it, without leaving 63 bits."""
    high = a * F.shiftright(b, 16)
    return _u32(a * b.bitwiseAND(F.lit(0xFFFF)) + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16))


def random(seed: Column, nth: Column) -> Column:
    """The nth number, from 1, in [0, 1) that the generator gives for a seed. Each follows from its number alone, so none waits for another."""
    a = _u32(_u32(seed.cast("long")) + nth.cast("long") * F.lit(STEP))
    t = _times(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(1)))
    t = t.bitwiseXOR(_u32(t + _times(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))))
    return t.bitwiseXOR(F.shiftright(t, 14)) / F.lit(float(1 << 32))


def randoms(seed: int, n: int) -> np.ndarray:
    """The first n numbers of a seed, as `random` gives them."""
    m = np.uint64(MASK)
    a = (np.uint64(seed & MASK) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(STEP)) & m
    t = (a ^ a >> np.uint64(15)) * (a | np.uint64(1)) & m
    t ^= (t + ((t ^ t >> np.uint64(7)) * (t | np.uint64(61)) & m)) & m
    return (t ^ t >> np.uint64(14)) / float(1 << 32)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _orders(size: pd.Series, seed: pd.Series) -> pd.Series:
    def one(n: int, seed: int) -> list[int]:
        order = list(range(n))
        with np.errstate(over="ignore"):
            places = (randoms(seed, n - 1) * np.arange(n, 1, -1)).astype(np.int64).tolist()
        for i, j in zip(range(n - 1, 0, -1), places, strict=True):
            order[i], order[j] = order[j], order[i]
        return order

    return pd.Series([one(int(n), int(s)) if n > 1 else list(range(max(0, int(n)))) for n, s in zip(size, seed, strict=True)], dtype=object)


def shuffled(values: Column, seed: Column) -> Column:
    """An array in an order that follows from the seed: from the last place down, each is exchanged with one at or before it; null for a null array or seed.

    The order is made of numbers, a step for each, in Arrow batches; the values stay in the JVM.
    """
    known = values.isNotNull() & seed.isNotNull()
    order = _orders(F.coalesce(F.size(values), F.lit(0)), F.coalesce(seed.cast("long"), F.lit(0)))
    return F.when(known, F.transform(order, lambda i: F.get(values, i)))


def seed_of(seed: Column, name: Column) -> Column:
    """A seed of its own for each name: the seed and the name's FNV-1a hash, bit by bit different."""
    return _u32(seed.cast("long")).bitwiseXOR(fnv1a(name).cast("long"))


def pick(weights: Column, chance: Column) -> Column:
    """The place, from 0, of the weight in which `chance` of their sum falls; places without a weight over 0 are never picked, null if there is none.

    chance: a number in [0, 1).
    """
    total = F.aggregate(F.filter(weights, lambda w: w > 0), F.lit(0.0), lambda a, w: a + w)
    start = F.struct((chance * total).alias("left"), F.lit(None).cast("int").alias("at"), F.lit(0).alias("i"))

    def step(s: Column, w: Column) -> Column:
        left = F.when(w > 0, s["left"] - w).otherwise(s["left"])
        hit = s["at"].isNull() & (w > 0) & (left <= 0)
        return F.struct(left.alias("left"), F.when(hit, s["i"]).otherwise(s["at"]).alias("at"), (s["i"] + 1).alias("i"))

    return F.aggregate(F.transform(weights, lambda w: w.cast("double")), start, step, lambda s: s["at"])
