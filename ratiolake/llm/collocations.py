"""Phrases whose words stand together more often than apart, by contiguous pattern growth.

Growth goes to the right, one word at a time, and only frequent patterns are grown. Words, then pairs of frequent
words are counted over all texts. Every place where two frequent pairs follow each other becomes a pointer: the
word there, its continuation as far as pairs stay frequent, and how many equal places the task has seen. Pointers are
dealt out by their prefix and sorted, so what a pattern occurs at is a range of rows, and a task grows each of its
prefixes depth first by narrowing ranges. A prefix with more pointers than TASK_ROWS or a thousandth of all is not grown in one
task: its extensions by one word are counted with map-side combine, and each of them is a prefix by itself.

Words travel as 64-bit hashes. The count of words holds each hash against its words, and all starts again
with another seed should two words share one, so counts are exact. What is broadcast are bitmaps of hashed
words and pairs of at most MAX_BITS, which let through all that is frequent and little else.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh3_64_intdigest

from .common import LOWER, UPPER, arrow_batches, map_rows, raw_texts, written
from .sketch import mix

#: Words of a phrase at most, occurrences at least, phrases told of a language.
WORDS, LEAST, TOP = 5, 100, 2000
#: A score is in thousandths.
SCALE = 1000
#: A phrase goes if one that holds it has this share of its occurrences, in hundredths.
SHARE = 100
#: Pointers of a prefix that one task grows: so many, and not more than one of so many parts of all.
TASK_ROWS, TASK_PARTS = 1 << 14, 1000
#: Bits of the largest bitmap: 32 MB.
MAX_BITS = 1 << 28
#: Bytes of text whose words are listed at a time; words, pairs and pointers that are held before they are added up.
_PART, _HELD_WORDS, _HELD = 1 << 20, 1 << 18, 1 << 20
#: Words whose hashes a task remembers.
_KNOWN = 1 << 18
#: Stands between pieces; no text in UTF-8 has this byte. As a number it is 0.
_END = b"\xff"
_FOLD = bytes.maketrans(UPPER.encode() + b".,;:!?\n\x0b\x0c\r", LOWER.encode() + _END * 10)
_COLUMNS = [f"w{i}" for i in range(1, WORDS + 1)]


class _Hashes(dict):
    """The number of each word: its hash with a seed, never 0."""

    def __init__(self, seed: int):
        super().__init__()
        self.seed = seed
        self[_END] = 0

    def __missing__(self, word: bytes) -> int:
        if len(self) > _KNOWN:
            self.clear()
            self[_END] = 0
        self[word] = found = xxh3_64_intdigest(word, self.seed) or 1
        return found


def _listed(raws: list[bytes]) -> Iterator[list[bytes]]:
    """Words of some texts, _END after each piece, some _PART bytes at a time; no word is cut."""
    held, size = [], 0
    for raw in raws:
        text, at = raw.translate(_FOLD) + _END, 0
        while at < len(text):
            end = min(at + _PART, len(text))
            while text[end - 1] not in b" \t\xff":
                end += 1
            held.append(text[at:end])
            size += end - at
            at = end
            if size >= _PART:
                yield b"".join(held).replace(_END, b" \xff ").split()
                held, size = [], 0
    if held:
        yield b"".join(held).replace(_END, b" \xff ").split()


def _by_lang(batch: pa.RecordBatch) -> dict[str, list[bytes]]:
    raws: dict[str, list[bytes]] = {}
    for lang, raw in zip(batch["lang"].to_pylist(), raw_texts(batch["text"]), strict=True):
        raws.setdefault(lang, []).append(raw)
    return raws


def _numbered(raws: list[bytes], known: _Hashes) -> Iterator[np.ndarray]:
    """Numbers of the words of some texts; each array starts with the WORDS - 1 last numbers of the one before, so that these are followed too."""
    tail = np.zeros(0, np.uint64)
    for words in _listed(raws):
        ids = np.concatenate((tail, np.fromiter(map(known.__getitem__, words), np.uint64, len(words))))
        yield ids
        tail = ids[max(0, len(ids) - WORDS + 1) :]
    yield np.concatenate((tail, np.zeros(WORDS - 1, np.uint64)))


def word_counts(docs: DataFrame) -> tuple[DataFrame, int]:
    """(lang, id, word, n) of docs (lang, text), all words, and the seed of their hashes, in which no two words of a language share one."""
    for seed in range(100):

        def make():
            held: dict[str, Counter] = {}

            def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
                for lang, raws in _by_lang(batch).items():
                    for words in _listed(raws):
                        held.setdefault(lang, Counter()).update(words)
                        if sum(map(len, held.values())) > _HELD_WORDS:
                            yield from told()

            def told() -> Iterator[pa.RecordBatch]:
                for lang, counts in held.items():
                    counts.pop(_END, None)
                    words = list(counts)
                    ids = np.array([xxh3_64_intdigest(w, seed) or 1 for w in words], np.uint64).view(np.int64)
                    yield pa.record_batch([pa.array([lang] * len(words), pa.string()), pa.array(ids), pa.array(words, pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "id", "word", "n"])
                held.clear()

            return work, told

        found = _mapped(docs, make, "lang string, id bigint, word string, n bigint").groupBy("lang", "id").agg(F.sum("n").alias("n"), F.min("word").alias("word"), F.max("word").alias("other"))
        found = written(found, "words")
        if found.filter("word <> other").isEmpty():
            return found.drop("other"), seed
    raise ValueError("words share hashes with every seed")


def _mapped(docs: DataFrame, make, schema: str) -> DataFrame:
    """mapInArrow with state per task: make() gives the function of a batch, and one for what it still holds at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, rest = make()
        for batch in batches:
            yield from work(batch)
        yield from rest()

    arrow_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def _bitmap(hashes: DataFrame) -> Broadcast:
    """A broadcast array of bits that has those of all hashes (h): 16 bits for each, MAX_BITS at most. The driver receives the bits alone."""
    bits = max(1 << 15, min(MAX_BITS, 1 << (16 * hashes.count()).bit_length()))
    at = hashes.select((F.col("h").bitwiseAND(F.lit(bits - 1)) + 1).alias("at"))
    blocks = at.groupBy(F.bitmap_bucket_number("at").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    whole = np.zeros(bits // 8, np.uint8)
    for block, some in zip(*(c.to_pylist() for c in blocks.toArrow().columns), strict=True):
        whole[(block - 1) * 4096 : block * 4096] = np.frombuffer(some, np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(whole)


def _maybe(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a + mix(b))


def _added_up(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of some columns, and how often each occurs."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    first = np.ones(len(order), bool)
    if len(order):
        first[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    at = np.flatnonzero(first)
    return [c[at] for c in columns], np.diff(np.append(at, len(order)))


def _counted(docs: DataFrame, seed: int, names: list[str], rows_of) -> DataFrame:
    """(lang, names, n): rows that rows_of(ids) gives (a list of columns) for the numbered words of docs, added up as they come."""

    def make():
        known = _Hashes(seed)
        held: dict[str, list[list[np.ndarray]]] = {}

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for lang, raws in _by_lang(batch).items():
                for ids in _numbered(raws, known):
                    held.setdefault(lang, []).append(rows_of(ids))
                    if sum(len(x[0]) for some in held.values() for x in some) > _HELD:
                        yield from told()

        def told() -> Iterator[pa.RecordBatch]:
            for lang, some in held.items():
                columns, n = _added_up([np.concatenate([x[i] for x in some]) for i in range(len(names))])
                if len(n):
                    yield pa.record_batch([pa.array([lang] * len(n), pa.string()), *(pa.array(c.view(np.int64)) for c in columns), pa.array(n)], names=["lang", *names, "n"])
            held.clear()

        return work, told

    return _mapped(docs, make, "lang string, " + ", ".join(f"{c} bigint" for c in [*names, "n"]))


def frequent_pairs(docs: DataFrame, seed: int, frequent: DataFrame, least: int) -> DataFrame:
    """(lang, w1, w2, n): pairs of frequent words (lang, id) that follow each other `least` times or more in docs."""
    words = _bitmap(frequent.select(F.col("id").alias("h")))

    def pairs(ids: np.ndarray) -> list[np.ndarray]:
        good = _maybe(words.value, ids) & (ids != 0)
        n = max(0, len(ids) - WORDS + 1)
        at = np.flatnonzero(good[:n] & good[1 : n + 1])
        return [ids[at], ids[at + 1]]

    return written(_counted(docs, seed, _COLUMNS[:2], pairs).groupBy("lang", *_COLUMNS[:2]).agg(F.sum("n").alias("n")).filter(F.col("n") >= least), "pairs")


def pointers(docs: DataFrame, seed: int, pairs: DataFrame) -> DataFrame:
    """(lang, w1 to w5, n): where frequent pairs follow each other, the words there as far as they do (0 beyond); n equal ones of a task are one row."""

    def hashed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        a, b = (batch[c].to_numpy().view(np.uint64) for c in _COLUMNS[:2])
        yield pa.record_batch([pa.array(_pair_hash(a, b).view(np.int64))], names=["h"])

    known = _bitmap(written(map_rows(pairs.select(*_COLUMNS[:2]), lambda: hashed, "h bigint"), "pair_hashes"))

    def found(ids: np.ndarray) -> list[np.ndarray]:
        n = max(0, len(ids) - WORDS + 1)
        follows = np.zeros(len(ids), bool)
        if n:
            follows[:-1] = _maybe(known.value, _pair_hash(ids[:-1], ids[1:])) & (ids[:-1] != 0) & (ids[1:] != 0)
        at = np.flatnonzero(follows[:n] & follows[1 : n + 1])
        columns, goes_on = [ids[at], ids[at + 1], ids[at + 2]], np.ones(len(at), bool)
        for k in range(3, WORDS):
            goes_on = goes_on & follows[at + k - 1]
            columns.append(np.where(goes_on, ids[at + k], np.uint64(0)))
        return columns

    return written(_counted(docs, seed, _COLUMNS, found), "pointers")


def grown(rows: DataFrame, depth: int, least: int) -> DataFrame:
    """(lang, words, f): all patterns of three words and more with `least` occurrences or more whose first `depth` words are those of pointers.

    Each prefix of so many words is grown by one task, depth first; its pointers fit there.
    """
    names = _COLUMNS[:depth]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "lang", *names).sortWithinPartitions("lang", *_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None
        for batch in batches:
            some = pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
            starts = _starts(some, names)
            whole = int(starts[-1])  # the last prefix may go on in the next batch
            if whole:
                yield from _patterns(some.slice(0, whole), starts[:-1], depth, least)
            left = some.slice(whole)
        if left is not None and left.num_rows:
            yield from _patterns(left, np.zeros(1, np.int64), depth, least)

    return dealt.mapInArrow(run, "lang string, words array<bigint>, f bigint")


def _starts(some: pa.Table, names: list[str]) -> np.ndarray:
    """Where in sorted rows a language or prefix begins."""
    new = np.zeros(some.num_rows, bool)
    if some.num_rows:
        new[0] = True
        lang = some["lang"].combine_chunks().dictionary_encode().indices.to_numpy()
        for c in (lang, *(some[k].to_numpy() for k in names)):
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new) if some.num_rows else np.zeros(1, np.int64)


def _patterns(some: pa.Table, starts: np.ndarray, depth: int, least: int) -> Iterator[pa.RecordBatch]:
    words, n = [some[c].to_numpy() for c in _COLUMNS], some["n"].to_numpy()
    out: list[tuple[int, int, int]] = []  # first row, words, occurrences

    def grow(low: int, high: int, k: int) -> None:
        """Rows low to high are the pointers of a pattern of k words: its frequent extensions, and theirs."""
        next_word = words[k][low:high]
        cuts = np.concatenate(([0], np.flatnonzero(next_word[1:] != next_word[:-1]) + 1))
        sums = np.add.reduceat(n[low:high], cuts)
        ends = np.append(cuts[1:], high - low)
        for i in np.flatnonzero((sums >= least) & (next_word[cuts] != 0)):
            a, b = low + int(cuts[i]), low + int(ends[i])
            if k + 1 >= 3:
                out.append((a, k + 1, int(sums[i])))
            if k + 1 < WORDS:
                grow(a, b, k + 1)

    ends = np.append(starts[1:], some.num_rows)
    for i in np.flatnonzero(np.add.reduceat(n, starts) >= least):
        grow(int(starts[i]), int(ends[i]), depth)
    if out:
        lang = some["lang"].combine_chunks().take(pa.array([a for a, _, _ in out]))
        found = [[int(words[j][a]) for j in range(k)] for a, k, _ in out]
        yield pa.record_batch([lang, pa.array(found, pa.list_(pa.int64())), pa.array([f for _, _, f in out], pa.int64())], names=["lang", "words", "f"])


def _prefixes(batch: pa.RecordBatch, depth: int) -> np.ndarray:
    """A hash of the language and the first `depth` words of each row."""
    lang = batch["lang"].dictionary_encode()
    h = np.array([xxh3_64_intdigest(x) for x in lang.dictionary.to_pylist()], np.uint64)[lang.indices.to_numpy()]
    for c in _COLUMNS[:depth]:
        h = mix(h + batch[c].to_numpy().view(np.uint64))
    return h


def parted(rows: DataFrame, depth: int, task_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Pointers whose first `depth` words have no more than task_rows of them, and the others, if there are any.

    A bitmap of the hashed prefixes tells; that it takes some small ones for large costs a few counts more.
    """
    prefix = ["lang", *_COLUMNS[:depth]]
    large = rows.groupBy(*prefix).agg(F.count("*").alias("size")).filter(F.col("size") > task_rows).select(*prefix)

    def hashed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch([pa.array(_prefixes(batch, depth).view(np.int64))], names=["h"])

    large = written(map_rows(large, lambda: hashed, "h bigint"), "large")
    if large.isEmpty():
        return rows, None
    bits = _bitmap(large)

    def of(wanted: bool) -> DataFrame:
        def some(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            yield batch.filter(pa.array(_maybe(bits.value, _prefixes(batch, depth)) == wanted))

        return map_rows(rows, lambda: some, rows.schema)

    return of(False), of(True)


def longer_patterns(rows: DataFrame, least: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """(lang, words, f): all patterns of three words and more with `least` occurrences or more among pointers."""
    found = None
    task_rows = min(task_rows, 1 + rows.count() // TASK_PARTS)
    for depth in range(1, WORDS):
        few, many = parted(rows, depth, task_rows)
        more = grown(few, depth, least)
        found = more if found is None else found.unionByName(more)
        if many is None:
            break
        rows = written(many.filter(F.col(_COLUMNS[depth]) != 0), "large_pointers")
        if depth + 1 >= 3:
            longer = ["lang", *_COLUMNS[: depth + 1]]
            counts = rows.groupBy(*longer).agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
            found = found.unionByName(counts.select("lang", F.array(*longer[1:]).alias("words"), "f"))
    return found


def scored(phrases: DataFrame, totals: DataFrame, scale: int = SCALE) -> DataFrame:
    """(lang, words, a, l, r, n, score) of phrases (lang, words, f) of two words and more; totals (lang, n).

    All parts of a phrase are among phrases. Of its cuts into a first part and the rest the one with the lowest
    floor(scale * a * n / (l * r)) counts, the earliest of equal ones. Exact up to 10**17 words.
    """
    f_of = lambda name: phrases.select("lang", F.col("words").alias(f"{name}_words"), F.col("f").alias(name))
    cut = F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")
    x = phrases.filter(F.size("words") > 1).select("lang", "words", F.col("f").alias("a"), cut)
    x = x.select("lang", "words", "a", "k", F.slice("words", F.lit(1), F.col("k")).alias("l_words"), F.slice("words", F.col("k") + 1, F.size("words")).alias("r_words"))
    x = x.join(f_of("l"), ["lang", "l_words"]).join(f_of("r"), ["lang", "r_words"]).join(totals, "lang")
    d = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"cast({d('a')} * {d('n')} as decimal(35, 0)) * {scale} div ({d('l')} * {d('r')})")
    best = F.min(F.struct(score.alias("score"), "k", "a", "l", "r", "n")).alias("best")
    return x.groupBy("lang", "words").agg(best).select("lang", "words", *[f"best.{c}" for c in ("a", "l", "r", "n", "score")])


def without_parts(candidates: DataFrame, share: int = SHARE) -> DataFrame:
    """candidates (lang, words, a and more) but those whose words lie inside a longer one with `share` hundredths of their occurrences.

    It is enough to look one word further: what lies between a phrase and a longer one around it occurs at least as often as that.
    """
    longer = candidates.filter(F.size("words") > 2)
    inner = F.array(F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", F.lit(2), F.size("words") - 1))
    around = longer.select("lang", F.explode(inner).alias("words"), "a").groupBy("lang", "words").agg(F.max("a").alias("around"))
    x = candidates.join(around, ["lang", "words"], "left")
    return x.filter(F.col("around").isNull() | (100 * F.col("around") < share * F.col("a"))).drop("around")


def in_words(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """phrases (lang, words and more) with `phrase`, their words (lang, id, word) joined by one space, instead of words."""
    at = phrases.select("lang", "words", F.posexplode("words").alias("i", "id")).join(words.select("lang", "id", "word"), ["lang", "id"])
    text = at.groupBy("lang", "words").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    return phrases.join(text, ["lang", "words"]).drop("words")


def ranked(phrases: DataFrame, top: int = TOP) -> DataFrame:
    """The first `top` of each language by score, then occurrences, then phrase in byte order, with `rank` from 1; no language meets in one task before its rows are that few."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = F.row_number().over(Window.partitionBy("lang", "_some").orderBy(*order))
    few = phrases.withColumn("_some", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", some).filter(F.col("rank") <= top)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, task_rows: int = TASK_ROWS) -> DataFrame:
    """The best phrases of each language of docs (lang, text; more columns are ignored).

    A-Z are lower-cased; texts are split at `[.,;:!?\\x0A-\\x0D]` into pieces, and these into words `[^\\x20\\x09]+`. A null
    text is empty, a null lang `und`. Of a language n counts all words, f(phrase) all places in pieces where
    its words follow each other. Phrases of 2 to WORDS words with a = f >= least are candidates; see `scored`,
    `without_parts` and `ranked`. Rows that repeat a text count each time. An empty table gives no rows.

    One row per phrase: lang, rank, phrase, a, l, r, n, score.
    """
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    words, seed = word_counts(docs)
    frequent = written(words.filter(F.col("n") >= least), "frequent")
    pairs = frequent_pairs(docs, seed, frequent, least)
    longer = longer_patterns(pointers(docs, seed, pairs), least, task_rows)
    phrases = frequent.select("lang", F.array("id").alias("words"), F.col("n").alias("f")).unionByName(pairs.select("lang", F.array(*_COLUMNS[:2]).alias("words"), F.col("n").alias("f"))).unionByName(longer)
    candidates = written(scored(written(phrases, "phrases"), words.groupBy("lang").agg(F.sum("n").alias("n"))), "candidates")
    return ranked(in_words(without_parts(candidates), frequent), top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, size, ws[i : i + size - 1] AS phrase FROM (
  SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM w, range(1, 6) s(size))),
f AS (SELECT lang, phrase, any_value(size) AS size, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
t AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM w GROUP BY lang),
c AS (SELECT f.lang, f.phrase, f.size, f.f AS a, k, x.f AS l, y.f AS r, t.n, (1000 * f.f::HUGEINT * t.n) // (x.f::HUGEINT * y.f) AS score
  FROM f JOIN range(1, 5) s(k) ON k < f.size JOIN f x ON x.lang = f.lang AND x.phrase = f.phrase[1 : k] JOIN f y ON y.lang = f.lang AND y.phrase = f.phrase[k + 1 : f.size] JOIN t ON t.lang = f.lang),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT DISTINCT s.lang, s.phrase FROM f s JOIN (SELECT lang, f, size, phrase, unnest(range(1, size + 1)) AS u FROM f) z
  ON z.lang = s.lang AND z.phrase[u : u + s.size - 1] = s.phrase AND s.size < z.size AND u + s.size - 1 <= z.size AND 100 * z.f >= 100 * s.f WHERE s.size > 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(phrase, ' ')) AS rank, array_to_string(phrase, ' ') AS phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM b WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.lang = b.lang AND i.phrase = b.phrase) QUALIFY rank <= 2000
"""
