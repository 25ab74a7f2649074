"""Substring deduplication: words in windows that occur more than once in the corpus go.

A window's anchor is the run of `grain` words in it with the least hash, so equal windows have equal
anchors at the same place, and about one run in eight is an anchor. Partition sketches of anchor
occurrences, added up, over-count every window. A second pass groups the windows estimated repeated by a
128-bit hash of their words; those that prove single are the sketch's false alarms, and since a single
window has one place, the grouping itself says where. The last pass removes the rest.

A sketch goes to all tasks while it has at most MAX_CELLS cells. A larger one stays spread out, as a table of
the cells that were hit: anchors are the cells, each partition's counts are added up in the shuffle, and
the cells hit more than once are joined back to the texts that hit them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from . import sketch
from .common import map_rows, raw_texts, written
from .words import BLOCK_BYTES, Words, blocks, parts, sliding


class Windows:
    """The windows of some texts and their anchors."""

    def __init__(self, words: Words, width: int, grain: int):
        self.words, self.width = words, width
        reach = width - grain + 1
        self.run = words.runs(grain)
        self.valid = words.inside(width)
        if not len(self.valid):
            self.anchor = self.occurrences = np.zeros(0, np.uint64)
            self.places = np.zeros(0, np.int64)
            return
        self.anchor = sliding(self.run, reach, np.minimum)
        # a run is an anchor if it equals the largest least hash among the windows that hold it
        least = np.where(self.valid, self.anchor, np.uint64(0))
        pad = np.zeros(reach - 1, np.uint64)
        self.places = np.flatnonzero(self.run == sliding(np.concatenate((pad, least, pad)), reach, np.maximum))
        self.occurrences = self.run[self.places]

    def suspects(self, maybe: Maybe) -> np.ndarray:
        """Starts of the windows that may be repeated."""
        at = np.flatnonzero(self.valid)
        return at[maybe(self.anchor[at])] if len(at) else at


#: Which of some anchors may occur more than once.
Maybe = Callable[[np.ndarray], np.ndarray]


class Scan:
    """The windows of some texts, taken together in blocks, long texts in parts."""

    def __init__(self, texts: list[bytes], width: int, grain: int, size: int = BLOCK_BYTES):
        self.texts, self.width, self.grain, self.size = texts, width, grain, size

    def blocks(self) -> Iterator[tuple[int, int, Windows, int | None, bool]]:
        """(index of the first text, its words before the block, windows, how many words are the block's own, whether the text ends in it); own is None for whole texts."""
        for first, words in blocks(self.texts, self.size):
            if isinstance(words, bytes):
                at = 0
                for part, own, last in parts(words, self.width - 1, self.size):
                    yield first, at, Windows(part, self.width, self.grain), own, last
                    at += own
            else:
                yield first, 0, Windows(words, self.width, self.grain), None, True

    def suspects(self, maybe: Maybe) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, word, digest) of each window that may be repeated."""
        for first, base, windows, *_ in self.blocks():
            at = windows.suspects(maybe)
            if len(at):
                words = windows.words
                text = words.text
                hashes = b"".join([xxh3_128_digest(text[a:b]) for a, b in zip(words.start[at].tolist(), words.end[at + self.width - 1].tolist(), strict=True)])
                doc = words.doc[at]
                yield first + doc, at - words.first[doc] + base, np.frombuffer(hashes, np.int64).reshape(-1, 2)

    def removal(self, maybe: Maybe, single: list[np.ndarray | None]) -> Iterator[tuple[bytes, int, int, list[int], list[int]]]:
        """For each text what is left, words, words removed, and where removed spans start and end; single: its windows that prove single."""
        width = self.width
        for first, base, windows, own, last in self.blocks():
            words = windows.words
            hit = np.zeros(len(words.hash), np.int32)
            hit[windows.suspects(maybe)] = 1
            for i in range(len(words.first) - 1):
                if single[first + i] is not None:
                    s = single[first + i] - base
                    hit[words.first[i] + s[(s >= 0) & (s < words.first[i + 1] - words.first[i])]] = 0
            if base == 0:
                held: list[bytes] = []
                kept: list[np.ndarray] = []
                before = np.zeros(width - 1, np.int32)
            # windows lie inside their texts, so what covers a text's words starts in it
            hit = np.concatenate((before, hit if own is None else hit[:own]))
            total = np.concatenate(([0], np.cumsum(hit)))
            keep = total[width:] == total[:-width]
            if own is None:
                for i in range(len(words.first) - 1):
                    k = keep[words.first[i] : words.first[i + 1]]
                    yield words.words_of(i, None if k.all() else k), len(k), *_removed(k)
                continue
            before = hit[len(hit) - width + 1 :]
            if keep.any():
                held.append(words.words_of(0, np.concatenate((keep, np.zeros(len(words.hash) - own, bool)))))
            kept.append(keep)
            if last:
                keep = np.concatenate(kept)
                yield b" ".join(held), len(keep), *_removed(keep)


def _removed(keep: np.ndarray) -> tuple[int, list[int], list[int]]:
    """How many words go, and where the spans of these start and end."""
    if keep.all():
        return 0, [], []
    edge = np.flatnonzero(np.diff(np.concatenate(([True], keep, [True])))).tolist()
    return int(len(keep) - keep.sum()), edge[::2], edge[1::2]


def remove_repeats(docs: DataFrame, width: int = 35, grain: int = 20, most_cells: int = sketch.MAX_CELLS) -> DataFrame:
    """docs (doc_id, text; more columns are ignored) without the words of repeated windows.

    Words are `[^\\x20\\x09-\\x0D]+`, compared as they are. A window is `width` consecutive words of one
    row. A word goes if a window that covers it has the same words as a window that starts elsewhere, in
    the same row or another; rows that repeat a doc_id are rows like others. Null and empty texts, and
    texts shorter than a window, lose nothing; texts of any length are taken in parts. An empty table gives
    no rows. most_cells: a sketch that needs more cells stays distributed instead of going to every task.

    One row per row: doc_id, kept_text (words joined by a space), n_words, n_removed, and removed_from,
    removed_to: the spans of word numbers that went, end exclusive.
    """
    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.xxhash64("text").alias("t"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # anchors: two in width - grain + 2 words, of some six bytes each
    anchors = size // 6 * 2 // (width - grain + 2)
    cells = sketch.cells_for(anchors)
    if cells <= most_cells:

        def occurrences(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            for _, _, windows, *_ in Scan(list(raw_texts(batch["text"])), width, grain).blocks():
                yield windows.occurrences

        repeated = sketch.repeated_items(docs.select("text"), occurrences, cells)
        searched = docs.withColumn("known", F.lit(None).cast("array<bigint>"))
    else:

        def placed(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for first, _, windows, *_ in Scan(list(raw_texts(batch["text"])), width, grain).blocks():
                yield windows.occurrences, first + windows.words.doc[windows.places]

        repeated = None
        known = sketch.known_items(docs, placed, cells)
        searched = written(docs.join(known, ["d", "t"], "left"), "searched")

    def maybe(batch: pa.RecordBatch) -> Maybe:
        if repeated is not None:
            return repeated.value.maybe
        return sketch.among(batch["known"])

    def suspected(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        d, t = (batch[x].to_numpy(zero_copy_only=False) for x in ("d", "t"))
        for doc, at, h in Scan(list(raw_texts(batch["text"])), width, grain).suspects(maybe(batch)):
            yield pa.record_batch([pa.array(x) for x in (h[:, 0].copy(), h[:, 1].copy(), d[doc], t[doc], at.astype(np.int32))], names=["h1", "h2", "d", "t", "at"])

    windows = map_rows(searched.select("d", "t", "text", "known"), lambda: suspected, "h1 bigint, h2 bigint, d bigint, t bigint, at int")
    counted = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("d").alias("d"), F.min("t").alias("t"), F.min("at").alias("at"))
    single = counted.filter("n = 1").groupBy("d", "t").agg(F.collect_list("at").alias("single"))

    def removed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        single = [x.values.to_numpy() if x.is_valid else None for x in batch["single"]]
        rows = list(Scan(list(raw_texts(batch["text"])), width, grain).removal(maybe(batch), single))
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        out = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
        yield pa.record_batch([batch["doc_id"], out[0].cast(pa.string()), *out[1:]], names=["doc_id", "kept_text", "n_words", "n_removed", "removed_from", "removed_to"])

    schema = "doc_id bigint, kept_text string, n_words bigint, n_removed bigint, removed_from array<int>, removed_to array<int>"
    return map_rows(searched.join(single.hint("shuffle_hash"), ["d", "t"], "left").select("doc_id", "text", "known", "single"), lambda: removed, schema)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws[i] AS word, i FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
x AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 34], ' ')) AS h
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM x) WHERE n > 1),
m AS (SELECT p.doc_id, p.i, p.word, coalesce(max(r.i) OVER (PARTITION BY p.doc_id ORDER BY p.i), -99) > p.i - 35 AS gone
      FROM p LEFT JOIN r ON p.doc_id = r.doc_id AND p.i = r.i)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
  sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept
  FROM m GROUP BY doc_id) k ON w.doc_id = k.doc_id
"""
