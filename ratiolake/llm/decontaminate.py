"""Benchmark decontamination by pigeonhole edit matching.

Test items are normalised and taken in passages. A passage with an error budget of k is split into k + 1
pieces: text within k edits of the passage has at least one piece unchanged. All pieces are found in one
walk over each text (Aho-Corasick); around each hit, Myers' bit-parallel algorithm measures the least
edit distance between the passage and any stretch of the text there. Where a passage begins or ends at the edge of a
word of its item, that edge is part of it: a letter or digit of the text that runs on there is an edit like any other.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, placed, raw_texts, written

#: Code points of a passage (an item under two of them is one passage), and of each edit allowed.
PASSAGE, PER_EDIT = 160, 20
#: Code points of passages that one walk over the texts looks for (some 60 bytes each in a worker); more take more walks.
AT_ONCE = 4_000_000


def normal(raw: bytes) -> str:
    """Lower case (of all scripts), each run of white space (U+0020, U+0009 to U+000D) one space, none at the ends."""
    return b" ".join(raw.split()).decode().lower()


def passages(item: str, size: int = PASSAGE) -> list[tuple[str, bool, bool]]:
    """The item in parts of `size` code points, the last one with what is left over, each with whether it begins and ends at the edge of a word."""
    n = max(1, len(item) // size)
    at = [i * size for i in range(n)] + [len(item)]
    edge = [not (item[a - 1 : a].isalnum() and item[a : a + 1].isalnum()) for a in at]
    return [(item[a:b], first, last) for a, b, first, last in zip(at, at[1:], edge, edge[1:], strict=False)]


def pieces(passage: str, per_edit: int = PER_EDIT) -> list[tuple[int, str]]:
    """budget + 1 parts of almost equal length, with their places; the budget is one edit for each per_edit code points over the first."""
    n = max(1, len(passage) // per_edit)
    at = [len(passage) * i // n for i in range(n + 1)]
    return [(a, passage[a:b]) for a, b in zip(at, at[1:], strict=False)]


def least_distance(pattern: str, text: str, first: bool = False, last: bool = False) -> int:
    """The least edit distance between pattern and any substring of text (Myers 1999, on one long integer).

    first and last put an edge of a word before and after the pattern: a sign of its own that any code point is equal to but letters and digits.
    """
    m = len(pattern) + first + last
    if not m:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(pattern, first):
        where[ch] = where.get(ch, 0) | 1 << i
    edge = (1 if first else 0) | (1 << m - 1 if last else 0)
    mask, top = (1 << m) - 1, 1 << m - 1
    pv, mv, score, best = mask, 0, m, m
    for ch in text:
        eq = where.get(ch, 0)
        if edge and not ch.isalnum():
            eq |= edge
        xv = eq | mv
        xh = ((eq & pv) + pv ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & mask, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            best = min(best, score)
        ph, mh = ph << 1 & mask, mh << 1 & mask
        pv, mv = mh | ~(xv | ph) & mask, ph & xv
    return best


class Matcher:
    """Finds the passages of a list (item_ids, passage, first, last) that a text holds within their budgets."""

    def __init__(self, listed: list[tuple[list[int | None], str, bool, bool]], per_edit: int = PER_EDIT):
        import ahocorasick

        self.found = ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = {}
        self.passages: list[tuple[list[int | None], str, bool, bool, int]] = []
        for ids, p, first, last in listed:
            cut = pieces(p, per_edit)
            for at, x in cut:
                where.setdefault(x, []).append((len(self.passages), at))
            self.passages.append((ids, p, first, last, len(cut) - 1))
        for x, places in where.items():
            self.found.add_word(x, (len(x), places))
        if where:
            self.found.make_automaton()
        self.any = bool(where)

    def items_in(self, text: str) -> dict[int | None, int]:
        """item_id and its passage's least distance, for each item with a passage within budget."""
        out: dict[int | None, int] = {}
        if not self.any:
            return out
        tried, exact = set(), set()
        for end, (n, places) in self.found.iter(text):
            for k, at in places:
                start = end + 1 - n - at
                if k in exact or (k, start) in tried:
                    continue
                tried.add((k, start))
                ids, p, first, last, budget = self.passages[k]
                here = start >= 0 and text.startswith(p, start)
                if here and not (first and text[max(0, start - 1) : start].isalnum()) and not (last and text[start + len(p) : start + len(p) + 1].isalnum()):
                    exact.add(k)
                    d = 0
                elif budget:
                    a, b = start - budget - 1, start + len(p) + budget + 1
                    # the ends of the text are edges of words
                    d = least_distance(p, " " * (a < 0) + text[max(0, a) : b] + " " * (b > len(text)), first, last)
                else:
                    d = 1
                if d <= budget:
                    for i in ids:
                        out[i] = min(d, out.get(i, d))
        return out


_MATCHER: dict[tuple[str, int], Matcher] = {}


@dataclass
class Block:
    """Passages that one walk looks for: a broadcast list of (item_ids, passage, first, last) under a name, one of so many."""

    name: str
    listed: Broadcast
    of: int

    def matcher(self, per_edit: int) -> Matcher:
        """Made once in each worker, which holds one at a time."""
        key = (self.name, per_edit)
        if key not in _MATCHER:
            _MATCHER.clear()
            _MATCHER[key] = Matcher(self.listed.value, per_edit)
        return _MATCHER[key]


def passage_blocks(items: DataFrame, size: int = PASSAGE, at_once: int = AT_ONCE) -> Iterator[Block]:
    """The passages of items (item_id, text) to look for, in blocks of about at_once code points.

    Passages that several items share are one. The driver holds one block at a time.
    """

    edged = ["passage", "first", "last"]

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, found = [], []
        for i, raw in zip(batch["item_id"].to_pylist(), raw_texts(batch["text"]), strict=True):
            own = [x for x in passages(normal(raw), size) if x[0]]
            ids += [i] * len(own)
            found += own
        columns = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.bool_(), pa.bool_()))]
        yield pa.record_batch([pa.array(ids, pa.int64()), *columns], names=["item_id", *edged])

    known = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    each = map_rows(known, lambda: cut, "item_id bigint, passage string, first boolean, last boolean").distinct()
    # collect_set leaves null ids out; they are told by a flag
    each = each.groupBy(*edged).agg(F.array_sort(F.collect_set("item_id")).alias("ids"), F.bool_or(F.col("item_id").isNull()).alias("unnamed"))
    each = written(each, "passages")
    n = -(-(each.agg(F.sum(F.length("passage"))).first()[0] or 0) // at_once) or 1
    sc = items.sparkSession.sparkContext
    for k in range(n):
        part = each if n == 1 else each.filter(F.pmod(F.xxhash64("passage"), F.lit(n)) == k)
        yield Block(uuid.uuid4().hex, sc.broadcast(sorted(((r.ids + [None] * r.unnamed, r.passage, r["first"], r["last"]) for r in part.toLocalIterator()), key=lambda x: x[1:])), n)


def find_items(docs: DataFrame, items: DataFrame, passage: int = PASSAGE, per_edit: int = PER_EDIT, at_once: int = AT_ONCE) -> DataFrame:
    """Which test items (item_id, text) each of docs (doc_id, text; more columns are ignored) holds.

    Both are compared in lower case with single spaces. An item counts as held if some passage of it
    occurs within len(passage) // per_edit - 1 edits (insertions, deletions, changes of a code point).
    A letter or digit that runs on where a passage begins or ends at the edge of a word is one more edit. Null and empty items are held by nothing; a null item_id is one of its own, last
    in item_ids; items that repeat an id are one item. Null and empty texts hold nothing. Rows that repeat a
    doc_id are rows like others. Items are a stated query set: they go to all texts, in blocks of about
    at_once code points; each block is one walk over docs, a job of its own.

    One row per row of docs: doc_id, item_ids (sorted), distance (the least, null without items), contaminated.
    """
    rows = docs.select("doc_id", "text")
    found = F.col("item_ids"), F.col("distance")
    told = None
    for k, block in enumerate(passage_blocks(items, passage, at_once)):
        if block.of == 1:
            return _walked(rows, block, per_edit, "doc_id").select("doc_id", *found, (F.size("item_ids") > 0).alias("contaminated"))
        if k == 0:
            spots = written(placed(rows).select(F.col("row.doc_id").alias("doc_id"), "file", "at", F.col("row.text").alias("text")).withColumn("place", F.struct("file", "at")), "spots")
        hits = written(_walked(spots, block, per_edit, "place").filter(F.size("item_ids") > 0), "walk")
        told = hits if told is None else told.unionByName(hits)
        block.listed.unpersist()
    got = told.groupBy("place").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.min("distance").alias("distance"))
    told = spots.select("doc_id", "place").join(got, "place", "left").select("doc_id", F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), "distance")
    return told.select("doc_id", *found, (F.size("item_ids") > 0).alias("contaminated"))


def _walked(rows: DataFrame, block: Block, per_edit: int, key: str) -> DataFrame:
    """(key, item_ids, distance) for each of rows (key, text)."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        m = block.matcher(per_edit)
        got = [m.items_in(normal(raw)) for raw in raw_texts(batch["text"])]
        ids = [sorted(x, key=lambda i: (i is None, i)) for x in got]
        yield pa.record_batch([batch[key], pa.array(ids, pa.list_(pa.int64())), pa.array([min(x.values(), default=None) for x in got], pa.int64())], names=[key, "item_ids", "distance"])

    rows = rows.select(key, "text")
    schema = T.StructType([rows.schema[key], T.StructField("item_ids", T.ArrayType(T.LongType())), T.StructField("distance", T.LongType())])
    return map_rows(rows, lambda: work, schema)


def clean_rows(docs: DataFrame, items: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """docs, all columns, without the rows that hold a test item by the rules of find_items."""
    out = docs.select(F.struct("*").alias("row"))
    for block in passage_blocks(items, at_once=at_once):

        def work(batch: pa.RecordBatch, block=block) -> Iterator[pa.RecordBatch]:
            m = block.matcher(PER_EDIT)
            yield batch.filter(pa.array([not m.items_in(normal(raw)) for raw in raw_texts(batch["row"].field("text"))], pa.bool_()))

        out = map_rows(out, lambda work=work: work, out.schema)
        if block.of > 1:
            out = written(out, "clean")
            block.listed.unpersist()
    return out.select("row.*")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
