"""Count-min sketches that tell 'at most once' from 'maybe more': counters stop at two.

Each task sketches its own partition; the partial sketches meet by blocks of cells and are added up.
Because cells only ever over-count, whatever occurs twice is found; other items are found falsely now
and then. A sketch of up to MAX_CELLS goes to every task as bits. A larger one stays distributed: the same cells
are counted as rows of a table, and rows learn by joins which of their items have full cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, map_rows, written

ROWS = 2
#: Cells are dealt out in blocks of this many.
BLOCK = 1 << 16
MIN_CELLS, MAX_CELLS = 1 << 17, 1 << 30
#: Bytes of bits that the driver fetches at a time.
FETCH = 1 << 26
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Items held before they are sketched.
_HOLD = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cells_for(items: int) -> int:
    """Cells of a row for so many items, 8 each; up to MAX_CELLS they go to every task (2 rows of 128 MB of bits)."""
    return max(MIN_CELLS, 1 << max(0, 8 * items - 1).bit_length())


def _cell(x: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (mix(x * _ODD[row] + np.uint64(row)) >> np.uint64(65 - cells.bit_length())).astype(np.int64)


class Repeated:
    """Answers whether items may occur more than once."""

    def __init__(self, cells: int, bits: list[np.ndarray]):
        self.cells, self.bits = cells, bits

    def maybe(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for row, bits in enumerate(self.bits):
            c = _cell(x, row, self.cells)
            out &= (bits[c >> 3] >> (c & 7).astype(np.uint8) & 1).astype(bool)
        return out


def repeated_items(df: DataFrame, items: Callable[[pa.RecordBatch], Iterator[np.ndarray]], cells: int):
    """A broadcast Repeated over all that items() yields (arrays of 64-bit numbers, one number an occurrence).

    The driver receives the finished bits alone: ROWS * cells / 8 bytes, whatever the input.
    """
    arrow_batches(df.sparkSession)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            for x in items(batch):
                held.append(x)
                n += len(x)
                if n >= _HOLD:
                    yield from _sketched(np.concatenate(held), cells)
                    held, n = [], 0
        if n:
            yield from _sketched(np.concatenate(held), cells)

    spark = df.sparkSession
    parts = df.mapInArrow(partial, "row int, block int, once binary, more binary")
    blocks = written(parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "row", "block").mapInArrow(_merged, "row int, block int, bits binary"), "sketch")
    bits = [np.zeros(cells // 8, np.uint8) for _ in range(ROWS)]
    step = FETCH // (ROWS * BLOCK // 8)
    for first in range(0, cells // BLOCK, step):
        for x in blocks.filter(F.col("block").between(first, first + step - 1)).toArrow().to_batches():
            for row, block, b in zip(*(x[i].to_pylist() for i in range(3)), strict=True):
                bits[row][block * BLOCK // 8 : (block + 1) * BLOCK // 8] = np.frombuffer(b, np.uint8)
    return spark.sparkContext.broadcast(Repeated(cells, bits))


def _sketched(x: np.ndarray, cells: int) -> Iterator[pa.RecordBatch]:
    for row in range(ROWS):
        c = np.sort(_cell(x, row, cells))
        first = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
        count = np.diff(np.append(first, len(c)))
        c = c[first]
        at = np.flatnonzero(np.concatenate(([True], c[1:] // BLOCK != c[:-1] // BLOCK)))
        offset = (c % BLOCK).astype(np.uint16)
        once, more, blocks = [], [], (c[at] // BLOCK).astype(np.int32)
        for a, b in zip(at, np.append(at[1:], len(c)), strict=True):
            twice = count[a:b] > 1
            once.append(offset[a:b][~twice].tobytes())
            more.append(offset[a:b][twice].tobytes())
        yield pa.record_batch([pa.array(np.full(len(at), row, np.int32)), pa.array(blocks), pa.array(once, pa.binary()), pa.array(more, pa.binary())], names=["row", "block", "once", "more"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for row, block, once, more in zip(*(batch[i].to_pylist() for i in range(4)), strict=True):
            n = counts.setdefault((row, block), np.zeros(BLOCK, np.uint8))
            o = np.frombuffer(once, np.uint16)
            n[o] = np.minimum(n[o] + 1, 2)
            n[np.frombuffer(more, np.uint16)] = 2
    for (row, block), n in counts.items():
        if (n > 1).any():
            yield pa.record_batch([pa.array([row], pa.int32()), pa.array([block], pa.int32()), pa.array([np.packbits(n > 1, bitorder="little").tobytes()], pa.binary())], names=["row", "block", "bits"])


def known_items(docs: DataFrame, items: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]], cells: int) -> DataFrame:
    """(d, t, known) of docs (d, t and what items() needs): the items of each (d, t) that may occur more than once, as Repeated would say, for sketches of any size.

    items() yields arrays of 64-bit numbers and of the rows of the batch they are in. The counts of cells are a table; they are added
    up with map-side combine, and only full cells are kept and joined.
    """

    def listed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        d, t = (batch[x].to_numpy(zero_copy_only=False) for x in ("d", "t"))
        for x, row in items(batch):
            yield pa.record_batch([pa.array(x.view(np.int64)), *(pa.array(_cell(x, r, cells)) for r in range(ROWS)), pa.array(d[row]), pa.array(t[row])], names=["item", *_AT, "d", "t"])

    each = written(map_rows(docs, lambda: listed, "item bigint, " + ", ".join(f"{c} bigint" for c in _AT) + ", d bigint, t bigint"), "items")
    cell = F.explode(F.array(*[F.struct(F.lit(r).alias("row"), F.col(c).alias("cell")) for r, c in enumerate(_AT)])).alias("at")
    full = written(each.select(cell).groupBy("at.row", "at.cell").agg(F.count("*").alias("n")).filter("n > 1").select("row", "cell"), "full-cells")
    for r, c in enumerate(_AT):
        each = each.join(full.filter(F.col("row") == r).select(F.col("cell").alias(c)), c)
    return each.groupBy("d", "t").agg(F.collect_set("item").alias("known"))


_AT = [f"cell{r}" for r in range(ROWS)]


def among(known: pa.Array) -> Callable[[np.ndarray], np.ndarray]:
    """Which items are among those of a batch's column known."""
    some = np.unique(known.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
    return lambda items: np.isin(items, some)
