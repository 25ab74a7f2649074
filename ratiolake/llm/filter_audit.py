"""How filters of a corpus overlap, by Walsh-Hadamard transform.

A document's failed filters are the bits of a mask. For each part of the corpus and each label the 2**n signed
parity sums of the masks are added up, one pass with map-side combine, whatever the number of orders asked
about. The transform is its own inverse but for a factor of 2**n, so the sums give the number of documents of each
mask exactly, in whole numbers. All n! orders of the filters are then evaluated from these cells, and each
filter's removals summed over all orders follow from the masks alone: a document that fails k filters is
removed by each of these in n! / k of the orders.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, fields
from hashlib import sha256
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, raw_texts, written

LETTERS = "ABCDE"
#: Stands for a null doc_id, which is smaller than any other.
_NO_ID = -(1 << 63)
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SYMBOL = re.compile(rb"[#$%&*|]")
_WORD_END = re.compile(rb"[ \t-\r]")
#: Bytes of a text whose words are listed at a time.
_PART = 1 << 20
#: Parts of the corpus whose rows are made at a time.
_TOGETHER = 64


def own_failures(raw: bytes) -> int:
    """The bits of the filters A to D that a text fails; E needs the other texts."""
    n, at, distinct = 0, 0, set()
    while at < len(raw):
        cut = _WORD_END.search(raw, at + _PART)
        end = cut.start() if cut else len(raw)
        words = raw[at:end].split()  # of bytes: exactly U+0020 and U+0009 to U+000D
        n += len(words)
        distinct.update(words)
        at = end
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    points = len(raw) if raw.isascii() else len(raw.decode("utf-8", "replace"))
    return (n < 50) | (100 * len(distinct) < 65 * n) << 1 | (100 * capitals > 5 * points) << 2 | (_SYMBOL.search(raw) is not None) << 3


def failures(docs: DataFrame) -> DataFrame:
    """(d, part, mask) for each row of docs (doc_id, text, source; more columns are ignored): the filters of LETTERS it fails, A the lowest bit.

    A: under 50 words; B: fewer than 65 distinct words in 100; C: over 5 capitals A-Z in 100 code points;
    D: any of #$%&*|; E: the text of a smaller doc_id, which may itself fail filters. Words are
    `[^\\x20\\x09-\\x0D]+` as they stand. A null text is empty, a null source the part ''. A null doc_id is smaller
    than any other; rows that repeat a text and its smallest doc_id all pass E. Texts are told apart by SHA-256.
    """
    rows = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("d"), F.coalesce("source", F.lit("")).alias("part"), "text")

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        masks, digests = [], []
        for raw in raw_texts(batch["text"]):
            masks.append(own_failures(raw))
            digests.append(sha256(raw).digest())
        yield pa.record_batch([batch["d"], batch["part"], pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], names=["d", "part", "mask", "digest"])

    told = written(map_rows(rows, lambda: work, "d bigint, part string, mask int, digest binary"), "failures")
    # by text and document, so that thousands of copies of a text do not meet in one task
    first = told.groupBy("digest").agg(F.min("d").alias("d")).withColumn("first", F.lit(True))
    copy = F.when(F.col("first"), 0).otherwise(1 << 4)
    return told.join(first, ["digest", "d"], "left").select("d", "part", F.col("mask").bitwiseOR(copy).alias("mask"))


def parity_sums(masks: DataFrame, n: int) -> DataFrame:
    """(part, told) of masks (part, good, toxic, mask): a struct for each label met in the part, of good, toxic and `sums`.

    sums has, for each s below 2**n, the sum over the rows of 1 where mask and s share an even number of bits, else of -1.
    """
    odd = lambda s: F.bit_count(F.col("mask").bitwiseAND(F.lit(s))).bitwiseAND(F.lit(1))
    sums = F.array(*[F.sum(1 - 2 * odd(s)) for s in range(1 << n)])
    by_label = masks.groupBy("part", "good", "toxic").agg(sums.alias("sums"))
    return by_label.groupBy("part").agg(F.collect_list(F.struct("good", "toxic", "sums")).alias("told"))


def inverted(sums: np.ndarray) -> np.ndarray:
    """The number of rows of each mask, from parity sums along the last axis."""
    x, width = sums.astype(np.int64), 1
    while width < x.shape[-1]:
        pairs = x.reshape(*x.shape[:-1], -1, 2, width)
        x = np.stack([pairs[..., 0, :] + pairs[..., 1, :], pairs[..., 0, :] - pairs[..., 1, :]], axis=-2).reshape(sums.shape)
        width *= 2
    cells, rest = np.divmod(x, x.shape[-1])
    if rest.any() or (cells < 0).any():
        raise ValueError("not the parity sums of any rows")
    return cells


@dataclass
class Steps:
    """All orders of some filters, a row for each step; a matrix has the masks that count at each step."""

    order: list[str]
    step: np.ndarray
    kept: np.ndarray
    removed: np.ndarray
    redundant: np.ndarray
    unique_fails: np.ndarray
    #: Not 0 or 1: in how many of all orders a mask is removed by the filter of the step.
    shapley: np.ndarray


def steps(letters: str = LETTERS) -> Steps:
    n = len(letters)
    masks = np.arange(1 << n)
    failed = np.array([bin(m).count("1") for m in masks])
    of_orders = np.where(failed > 0, factorial(n) // np.maximum(failed, 1), 0)
    rows = []
    for order in permutations(letters):
        before = 0
        for i, letter in enumerate(order):
            bit = 1 << letters.index(letter)
            fails, earlier = (masks & bit) > 0, (masks & before) > 0
            rows.append(("".join(order), i + 1, (masks & (before | bit)) == 0, fails & ~earlier, fails & earlier, masks == bit, fails * of_orders))
            before |= bit
    return Steps([r[0] for r in rows], np.array([r[1] for r in rows], np.int32), *(np.array([r[i] for r in rows], np.int64) for i in range(2, 7)))


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
AUDIT = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS)


def audit(masks: DataFrame, letters: str = LETTERS) -> DataFrame:
    """What each filter does at each place of each order, from masks (part, good, toxic, mask): the columns of AUDIT.

    One row for each part, order of the letters and step, zeros too; an empty table gives no rows. Null flags count as
    false. kept and removed count what is there after the step and goes at it, redundant what fails its filter but
    went earlier, unique_fails what fails no other; good_lost and toxic_lost are parts of removed. shapley is the
    filter's removals summed over all orders.
    """
    n = len(letters)
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    told = parity_sums(masks.select("part", *flags, "mask"), n)

    def make():
        all_steps = steps(letters)
        at = {f.name: getattr(all_steps, f.name) for f in fields(all_steps)}

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for first in range(0, batch.num_rows, _TOGETHER):
                some = batch.slice(first, _TOGETHER)
                parts, found = some["part"].to_pylist(), some["told"].to_pylist()
                sums = np.zeros((3, len(parts), 1 << n), np.int64)  # of all, good, toxic
                for i, labels in enumerate(found):
                    for x in labels:
                        for k in [0] + [1] * x["good"] + [2] * x["toxic"]:
                            sums[k, i] += np.array(x["sums"], np.int64)
                every, good, toxic = inverted(sums)
                counts = {c: (every @ at[c].T) for c in ("kept", "removed", "redundant", "unique_fails", "shapley")}
                counts |= {"good_lost": good @ at["removed"].T, "toxic_lost": toxic @ at["removed"].T}
                rows = len(at["order"])
                columns = [pa.array(np.repeat(parts, rows), pa.string()), pa.array(at["order"] * len(parts)), pa.array(np.tile(at["step"], len(parts)))]
                yield pa.record_batch([*columns, *(pa.array(counts[c].ravel()) for c in COUNTS)], names=["part", "filter_order", "step", *COUNTS])

        return work

    return map_rows(told, make, AUDIT)


def labelled_failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, good, toxic, mask) of failures(docs), with labels (doc_id, quality, toxic): 1 is true, all else and no label false.

    Of rows that repeat a doc_id in labels, one that says 1 is enough; labels without doc_id are left out.
    """
    said = lambda c: F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False))
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("d")).agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    return failures(docs).join(known, "d", "left").select("part", "good", "toxic", "mask")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(labelled_failures(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, length(t) AS points, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS capitals,
  doc_id > min(doc_id) OVER (PARTITION BY t) AS copied FROM d),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  CASE WHEN len(ws) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 'B' ELSE '' END || CASE WHEN 100 * capitals > 5 * points THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN copied THEN 'E' ELSE '' END AS fails FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before FROM o, range(1, 6) r(step)),
z AS (SELECT s.*, c.*, contains(fails, f) AS fail, regexp_matches(fails, '[-' || before || ']') AS earlier FROM s, c)
SELECT part, filter_order, step::INTEGER AS step, coalesce(sum(n) FILTER (NOT fail AND NOT earlier), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fail AND NOT earlier), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (fail AND earlier), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = f), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (fail AND NOT earlier), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fail AND NOT earlier), 0)::BIGINT AS toxic_lost,
  (sum(coalesce(sum(n) FILTER (fail AND NOT earlier), 0)) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM z GROUP BY part, filter_order, step, f
"""
