"""Exercises with percentages that follow from a seed: kinds, numbers and answers as rows.

A seed's numbers are drawn in order, and what is drawn next depends on what was accepted: quotas of kinds, no exercise twice, at
most ATTEMPTS tries for each. So a seed is a fold over its random numbers, a small one in one worker; seeds are independent rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal
from math import floor, prod
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from ratiolake.functions.chance import randoms

#: Numbers that exercises of a level are made of.
NUMBERS = {
    "easy": [20, 25, 40, 50, 60, 80, 100, 120, 200, 250, 400, 500, 1000, 2000],
    "medium": [18, 36, 72, 96, 125, 150, 180, 240, 360, 480, 750, 1200, 1500, 3200],
    "hard": [37, 58, 99, 135, 175, 260, 420, 875, 1333, 2460, 5100, 7800],
}
#: Easy percentages, and how often one is negative; others are drawn between limits and rounded to one of two steps.
EASY_PERCENTS, NEGATIVE = [5, 10, 12.5, 15, 20, 25, 30, 40, 50], 0.35
LOWEST, HIGHEST, STEPS, FINE = {True: -60, False: 1}, {True: 180, False: 80}, (0.5, 1), 0.4
#: Easy shares that a number is of another, and the limits of others.
EASY_SHARES, SHARES = [0.1, 0.2, 0.25, 0.5, 0.75, 1.2], (0.05, 1.8)
#: Limits of whole numbers by level.
PARTS = {"easy": [(5, 50), (5, 60), (5, 70)], "medium": [(10, 200), (10, 250), (10, 300)], "hard": [(10, 200), (10, 250), (10, 300)]}
CHANGES = {"easy": (2, 2), "medium": (2, 3), "hard": (2, 4)}
RATES, WEIGHTS = (40, 98), {"easy": (10, 80), "medium": (10, 80), "hard": (10, 200)}
UP_AND_DOWN = {"easy": (5, 40), "medium": (5, 40), "hard": (5, 60)}
#: The most exercises of a seed, tries for each, and kinds that have one at least.
MOST, ATTEMPTS, ONCE = 50, 25, ("essential", "variation")


class Shown(NamedTuple):
    """A number as an exercise shows it: with so many places (None: as it is), with a sign or not."""

    value: float
    places: int | None = None
    signed: bool = False

    def text(self) -> str:
        if self.places is None:
            return str(self.value)
        v = Decimal(self.value).quantize(Decimal(1).scaleb(-self.places), ROUND_HALF_UP)
        return ("+" if self.signed and v > 0 else "") + f"{abs(v) if not v else v:f}"


class Draws:
    """The numbers of a seed one after the other, and what is made of them."""

    def __init__(self, seed: int):
        self.seed, self.at, self.held = seed, 0, randoms(seed, 256).tolist()

    def next(self) -> float:
        if self.at == len(self.held):
            self.held = randoms(self.seed, 4 * self.at).tolist()
        self.at += 1
        return self.held[self.at - 1]

    def one_of(self, values: Sequence):
        return values[floor(self.next() * len(values))]

    def between(self, low: float, high: float) -> float:
        return low + (high - low) * self.next()

    def whole(self, limits: tuple[int, int]) -> int:
        return floor(self.between(limits[0], limits[1] + 1))

    def percent(self, level: str, signed: bool, over: bool) -> float:
        if level == "easy":
            p = self.one_of(EASY_PERCENTS)
            return -p if signed and self.next() < NEGATIVE else p
        step = STEPS[0] if self.next() < FINE else STEPS[1]
        return rounded(self.between(LOWEST[signed], HIGHEST[over]), step)


def rounded(x: float, places: float) -> float:
    scale = 10.0**places
    return floor(x * scale + 0.5) / scale


#: What an exercise shows, its answer, and which of the kind's wordings it has, if not the only one.
Made = tuple[list[Shown], float] | tuple[list[Shown], float, int] | None


def _essential(d: Draws, level: str, places: int) -> Made:
    if d.next() < 0.5:
        y = d.one_of(NUMBERS[level])
        p = d.percent(level, False, level != "easy")
        return [Shown(p, places), Shown(y, 0), Shown(p / 100 * y, places)], p / 100 * y
    y = d.one_of(NUMBERS[level])
    share = d.one_of(EASY_SHARES) if level == "easy" else d.between(*SHARES)
    x = rounded(y * share, 0 if level == "easy" else 2)
    return [Shown(x, places), Shown(y, places), Shown(x / y * 100, places)], x / y * 100, 1


def _change(d: Draws, level: str, places: int, exact: bool) -> Made:
    first = d.one_of(NUMBERS[level])
    last = first * (1 + d.percent(level, True, level == "hard") / 100)
    last = last if exact else rounded(last, 0 if level == "easy" else 2)
    p = (last - first) / first * 100
    return [Shown(first, places), Shown(last, places), Shown(p, places, True)], p


def _reverse(d: Draws, level: str, places: int) -> Made:
    last = d.one_of(NUMBERS[level])
    p = d.percent(level, True, level == "hard")
    if 1 + p / 100 == 0:
        return None
    return [Shown(p, places, True), Shown(last, places), Shown(last / (1 + p / 100), places)], last / (1 + p / 100)


def _successive(d: Draws, level: str, places: int) -> Made:
    n = 2 if level == "easy" else d.whole(CHANGES[level])
    changes = [d.percent(level, True, level == "hard") for _ in range(n)]
    base, coefficient = d.one_of(NUMBERS[level]), prod((1 + p / 100 for p in changes), start=1.0)
    total = (coefficient - 1) * 100
    return [Shown(base, places), *(Shown(p, places, True) for p in changes), Shown(base * coefficient, places), Shown(total, places, True)], total


def _shares(d: Draws, level: str, places: int) -> Made:
    parts = [d.whole(limits) for limits in PARTS[level]]
    p = parts[0] / sum(parts) * 100
    return [*map(Shown, parts), Shown(p, places)], p


def _weighted(d: Draws, level: str, places: int) -> Made:
    n = 2 if level == "easy" else d.whole((2, 3))
    pairs = [(rounded(d.between(*RATES), 1), d.whole(WEIGHTS[level])) for _ in range(n)]
    p = sum(r * w for r, w in pairs) / sum(w for _, w in pairs)
    return [*(s for r, w in pairs for s in (Shown(r, 1), Shown(w))), Shown(p, places)], p


def _points(d: Draws, level: str, places: int) -> Made:
    a = rounded(d.between(2, 40), 1)
    b = rounded(d.between(a + 1, a + d.between(1, 25)), 1)
    relative = (b - a) / a * 100
    return [Shown(a, 1), Shown(b, 1), Shown(b - a, places), Shown(relative, places, True)], relative


def _up_and_down(d: Draws, level: str, places: int) -> Made:
    base, p = d.one_of(NUMBERS[level]), d.whole(UP_AND_DOWN[level])
    last = base * (1 + p / 100) * (1 - p / 100)
    total = (last - base) / base * 100
    return [Shown(p), Shown(base, places), Shown(last, places), Shown(total, places, True)], total


def _mistake(d: Draws, level: str, places: int) -> Made:
    base = d.one_of(NUMBERS[level])
    p, q = d.whole((5, 40)), d.whole((5, 40))
    coefficient = (1 + p / 100) * (1 + q / 100)
    return [Shown(p), Shown(q), Shown(p + q), Shown(base, places), Shown((coefficient - 1) * 100, places, True), Shown(base * coefficient, places)], (coefficient - 1) * 100


KINDS: dict[str, Callable[[Draws, str, int], Made]] = {
    "essential": _essential, "variation": lambda *x: _change(*x, exact=False), "reverse": _reverse, "cumul": _successive, "shares": _shares, "weighted": _weighted,
    "points": _points, "traps": _up_and_down, "error-check": _mistake, "fill-step": lambda *x: _change(*x, exact=True),
}


def _quotas(kinds: Sequence[str], n: int, d: Draws) -> dict[str, int]:
    """How many of each kind are wanted: one of those in ONCE, the rest as drawn."""
    quota = dict.fromkeys(kinds, 0)
    for kind in [k for k in ONCE if k in quota][:n]:
        quota[kind] = 1
    for _ in range(n - sum(quota.values())):
        quota[d.one_of(kinds)] += 1
    return quota


def _wanted(quota: dict[str, int], d: Draws) -> str:
    """A kind by what is left of its quota; any of them once all are met."""
    open_kinds = {kind: n for kind, n in quota.items() if n}
    if not open_kinds:
        return d.one_of(list(quota))
    left = d.next() * sum(open_kinds.values())
    for kind, n in open_kinds.items():
        left -= n
        if left <= 0:
            break
    return kind


def of_seed(seed: int, level: str, kinds: Sequence[str], count: int, places: int) -> list[tuple[str, list[Shown], float]]:
    """(kind, numbers, answer) of a seed's exercises."""
    d, n = Draws(min(max(seed, 1), (1 << 31) - 1)), min(max(count, 1), MOST)
    quota, found, known = _quotas(kinds, n, d), [], set()
    for _ in range(n * ATTEMPTS):
        if len(found) == n:
            break
        kind = _wanted(quota, d)
        made = KINDS[kind](d, level, places)
        if made is None or (sign := (kind, made[2:], *(x.text() for x in made[0]))) in known:
            continue
        known.add(sign)
        found.append((kind, *made[:2]))
        quota[kind] = max(0, quota[kind] - 1)
    return found


EXERCISES = "seed bigint, n int, kind string, numbers array<double>, shown array<string>, answer double"


def exercises(seeds: DataFrame, kinds: Sequence[str] = ("essential", "variation", "cumul"), count: int = 10, places: int = 2) -> DataFrame:
    """EXERCISES of seeds (seed, level): up to `count` for each, in order, none twice as it is shown; the last of the numbers shown belong to the answer.

    Null seeds and levels that are not in NUMBERS give none. Seeds are taken between 1 and 2**31 - 1.
    """
    if unknown := [k for k in kinds if k not in KINDS]:
        raise ValueError(f"unknown kinds: {unknown}")
    kinds = list(dict.fromkeys(kinds)) or ["essential"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int32(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.string()), pa.float64())
        for batch in batches:
            rows = []
            for seed, level in zip(batch["seed"].to_pylist(), batch["level"].to_pylist(), strict=True):
                if seed is not None and level in NUMBERS:
                    rows += [(seed, i, kind, [float(x.value) for x in shown], [x.text() for x in shown], answer) for i, (kind, shown, answer) in enumerate(of_seed(seed, level, kinds, count, places), 1)]
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["seed", "n", "kind", "numbers", "shown", "answer"])

    return seeds.select("seed", "level").selectExpr("cast(seed as bigint) as seed", "level").mapInArrow(make, EXERCISES)
