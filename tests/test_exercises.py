"""Exercises that follow from a seed, and decimals with a period, against plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from ratiolake.functions import chance
from ratiolake.functions import numbers as nu
from ratiolake.operators import exercises as ex


def generator(seed):
    """The published generator, with a state."""
    a = seed & 0xFFFFFFFF
    while True:
        a = (a + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((a ^ a >> 15) * (a | 1)) & 0xFFFFFFFF
        t ^= (t + ((t ^ t >> 7) * (t | 61) & 0xFFFFFFFF)) & 0xFFFFFFFF
        yield ((t ^ t >> 14) & 0xFFFFFFFF) / 4294967296


def test_numbers_by_index_are_those_of_the_generator():
    for seed in (1, 7, 123456, 2**31 - 1, -3):
        g = generator(seed)
        assert chance.randoms(seed, 500).tolist() == [next(g) for _ in range(500)]
    d = ex.Draws(9)
    g = generator(9)
    assert [d.next() for _ in range(3000)] == [next(g) for _ in range(3000)]


def test_shuffles_are_swaps_from_the_last_place_down(spark):
    rows = [(i, list(range(n))) for i, n in enumerate([0, 1, 2, 9, 300])] + [(None, [1]), (5, None)]
    got = spark.createDataFrame(rows, "s long, v array<int>").select(chance.shuffled(F.col("v"), F.col("s")).alias("x")).collect()
    for (s, v), r in zip(rows, got, strict=True):
        if v is not None and s is not None:
            g, v = generator(s), list(v)
            for i in range(len(v) - 1, 0, -1):
                j = math.floor(next(g) * (i + 1))
                v[i], v[j] = v[j], v[i]
        assert r.x == (v if s is not None else None)


@pytest.mark.parametrize("level", ex.NUMBERS)
def test_exercises_keep_to_their_rules(level):
    kinds = list(ex.KINDS)
    for seed in range(1, 120):
        found = ex.of_seed(seed, level, kinds, 20, 2)
        assert len(found) == 20 and found == ex.of_seed(seed, level, kinds, 20, 2)
        assert {"essential", "variation"} <= {k for k, _, _ in found}
        shown = [(k, *(x.text() for x in s)) for k, s, _ in found if k != "essential"]
        assert len(set(shown)) == len(shown)
        for kind, s, answer in found:
            v = [x.value for x in s]
            assert math.isfinite(answer)
            if kind == "variation" or kind == "fill-step":
                assert math.isclose(v[0] * (1 + answer / 100), v[1], rel_tol=1e-9, abs_tol=1e-9)
            if kind == "reverse":
                assert math.isclose(answer * (1 + v[0] / 100), v[1])
            if kind == "cumul":
                assert math.isclose(math.prod(1 + p / 100 for p in v[1:-2]), 1 + answer / 100, abs_tol=1e-9) and math.isclose(v[-2], v[0] * (1 + answer / 100), abs_tol=1e-6)
            if kind == "shares":
                assert math.isclose(answer, 100 * v[0] / sum(v[:3]))
            if kind == "weighted":
                assert min(v[:-1:2]) <= answer <= max(v[:-1:2]) and (level != "easy" or len(v) == 5)
            if kind == "points":
                assert v[1] > v[0] and math.isclose(answer, 100 * v[2] / v[0])
            if kind in ("traps",):
                assert math.isclose(answer, -v[0] * v[0] / 100)
            if kind == "error-check":
                assert v[2] == v[0] + v[1] and math.isclose(answer, v[2] + v[0] * v[1] / 100)


def test_few_possible_exercises_end_the_tries():
    # without signs and with few numbers there are some hundred different ones at most; the tries end
    found = ex.of_seed(5, "easy", ["essential"], 50, 0)
    assert 30 < len(found) <= 50 and {k for k, _, _ in found} == {"essential"}


def test_rows_of_seeds(spark):
    seeds = spark.createDataFrame([(1, "easy"), (None, "easy"), (2, "other"), (0, "hard"), (2**40, "medium")], "seed long, level string")
    got = ex.exercises(seeds, count=60).groupBy("seed").count().collect()
    assert {r.seed: r["count"] for r in got} == {1: 50, 0: 50, 2**40: 50}
    assert ex.exercises(seeds.limit(0)).count() == 0
    with pytest.raises(ValueError):
        ex.exercises(seeds, ["unknown"])


def long_division(a, b):
    a, b = abs(a), abs(b)
    digits, seen, r = "", {}, a % b
    while r and r not in seen:
        seen[r] = len(digits)
        r *= 10
        digits += str(r // b)
        r %= b
    n = seen[r] if r else len(digits)
    return a // b, digits[:n], digits[n:], len(digits) - n


def test_periods_are_those_of_long_division(spark):
    rows = [(a, b) for b in [1, 2, 3, 6, 7, 8, 12, 13, 28, 97, 125, 250, 990, 1024, 9999, -7] for a in (0, 1, 5, 22, -9, 123456)] + [(1, 0), (None, 3), (1, 10007), (1, 1000003)]
    got = spark.createDataFrame(rows, "a long, b long").select(nu.periodic(F.col("a"), F.col("b"), 20000).alias("p")).collect()
    for (a, b), r in zip(rows, got, strict=True):
        if a is None or b == 0:
            assert r.p is None
        elif b == 1000003:
            assert r.p.period is None and pow(10, r.p.length, b) == 1
        else:
            assert tuple(r.p) == long_division(a, b)
