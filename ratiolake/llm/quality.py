"""A quality classifier: random Fourier features of document statistics, ridge by normal equations, isotonic calibration.

Each text is read once and becomes STATISTICS, numbers of its bytes, words and lines; all else works on that small
table. cos(w x + b) with random w and b approximates a Gaussian kernel over the standardised statistics. Each
partition of the labelled rows adds up its normal equations, apart for FOLDS folds, and Spark adds up the
partitions': the driver receives FOLDS matrices of a fixed size and solves one small system for all rows, and
one without each fold. Rows scored by the system that has not seen them calibrate the score: labels are
counted by cells of the score, and the best non-decreasing steps through them are what a score means.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128

from .common import map_rows, raw_texts, written

#: What is told of a text, in this order.
STATISTICS = (
    "log_bytes", "log_words", "log_lines", "log_word_length", "log_line_length", "distinct_words", "distinct_pairs", "distinct_lines", "top_word", "short_words", "long_words", "repeated_neighbours",
    "capitals", "lower", "digits", "white", "not_ascii", "full_stops", "commas", "exclamations", "other_marks", "symbols", "brackets", "control", "shouted_words", "open_lines",
)
#: Labelled texts that the fit uses at most, about; with more, so many are drawn by a hash of the text.
FIT_ROWS = 400_000
#: Random features, folds, tasks of the fit, the kernel's width in standard deviations times the root of the statistics, and the ridge's weight for each row.
FEATURES, FOLDS, FIT_TASKS, WIDTH, RIDGE = 384, 4, 32, 0.6, 1e-4
#: Cells of the score from -0.5 to 1.5 in which labels are counted for calibration.
CELLS = 2048
#: What is predicted as good.
GOOD = 0.3
#: Bytes of a text taken at a time.
_PART = 1 << 20
_CLASS = np.zeros(256, np.int64)  # 0: lower-case letters
for _i, _some in enumerate((range(65, 91), range(48, 58), b" \t\n\x0b\x0c\r", range(128, 256), b".?", b",;:", b"!", b"'\"`-_", b"#$%&*|+=<>@^~/\\", b"()[]{}", [*range(9), *range(14, 32), 127]), 1):
    _CLASS[list(_some)] = _i
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\x0b\x0c\r")] = True


def parts(raw: bytes, size: int | None = None) -> Iterator[bytes]:
    """A text in parts of some `size` bytes, cut after white space; a longer word stays whole."""
    at, size = 0, size or _PART
    while at < len(raw):
        end = at + size
        while end < len(raw) and not _BLANK[raw[end - 1]]:
            end += 1
        yield raw[at:end]
        at = end


def statistics(raw: bytes) -> list[float]:
    """STATISTICS of a text; all zero for an empty one. Long texts are taken in parts, only distinct words and lines are held."""
    chars = np.zeros(12, np.int64)
    words_n = shouted = short = long_ = same = letters = 0
    counts: dict[bytes, int] = {}
    pairs: set[int] = set()
    before = b""
    for part in parts(raw):
        chars += np.bincount(_CLASS[np.frombuffer(part, np.uint8)], minlength=12)
        words = part.split()
        words_n += len(words)
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        neighbours = list(zip([before, *words[:-1]] if before else words[:-1], words if before else words[1:], strict=True))
        pairs.update(map(hash, neighbours))
        same += sum(a == b for a, b in neighbours)
        before = words[-1] if words else before
    for w, n in counts.items():
        size = len(w)
        letters += n * size
        short += n * (size <= 3)
        long_ += n * (size > 12)
        shouted += n * (size > 1 and w.isupper())
    lines, kinds, open_ = 0, set(), 0
    for line in raw.split(b"\n") if len(raw) < 1 << 26 else _lines(raw):
        x = line.strip()
        if x:
            lines += 1
            kinds.add(hash(x))
            open_ += x[-1] not in b".!?"
    b, n, k = max(len(raw), 1), max(words_n, 1), max(lines, 1)
    share = (chars / b).tolist()
    if not words_n:
        return [np.log1p(len(raw))] + [0.0] * 11 + [share[i] for i in (1, 0, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11)] + [0.0, 0.0]
    return [
        np.log1p(len(raw)), np.log1p(words_n), np.log1p(lines), np.log1p(letters / n), np.log1p(len(raw) / k), len(counts) / n, len(pairs) / n, len(kinds) / k, max(counts.values()) / n, short / n, long_ / n, same / n,
        *(share[i] for i in (1, 0, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11)), shouted / n, open_ / k,
    ]


def _lines(raw: bytes) -> Iterator[bytes]:
    at = 0
    while at <= len(raw):
        end = raw.find(b"\n", at)
        end = len(raw) if end < 0 else end
        yield raw[at:end]
        at = end + 1


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, x, digest) for each row of docs (doc_id, text; more columns are ignored): STATISTICS of the text, null as empty, and 128 bits that tell texts apart."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        xs, digests = [], []
        for raw in raw_texts(batch["text"]):
            xs.append(statistics(raw))
            digests.append(xxh3_128(raw).digest())
        yield pa.record_batch([batch["doc_id"], pa.array(xs, pa.list_(pa.float64())), pa.array(digests, pa.binary())], names=["doc_id", "x", "digest"])

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), lambda: work, "doc_id bigint, x array<double>, digest binary")


@dataclass
class Model:
    """A score from 0 to 1 for rows of STATISTICS."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    #: Places of the ridge's score, in order, and what they mean; between them lines.
    at: np.ndarray
    means: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.scale)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.at):
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.features(x) @ self.weights, self.at, self.means), 0.0, 1.0)


_drawn: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def fourier(z: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised rows, always the same ones, and a constant."""
    n = z.shape[1]
    if n not in _drawn:
        rng = np.random.Generator(np.random.PCG64(13))
        _drawn[n] = rng.normal(0, 1 / (WIDTH * np.sqrt(n)), (n, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
    w, b = _drawn[n]
    # beyond 8 deviations a statistic says no more
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(np.clip(z, -8, 8) @ w + b), np.ones((len(z), 1))])


def isotonic(weight: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The non-decreasing values closest to total / weight in squares by weight: neighbours out of order are pooled."""
    w, t, n = [], [], []
    for a, b in zip(weight.tolist(), total.tolist(), strict=True):
        w.append(a)
        t.append(b)
        n.append(1)
        while len(w) > 1 and t[-2] * w[-1] >= t[-1] * w[-2]:
            a, b, k = w.pop(), t.pop(), n.pop()
            w[-1] += a
            t[-1] += b
            n[-1] += k
    return np.repeat(np.array(t) / np.array(w), n) if w else np.zeros(0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit(rows: DataFrame, most: int = FIT_ROWS) -> Model:
    """A Model from labelled rows (x, digest, label 0 to 1); null labels are left out.

    Rows of one digest are one, with the mean of their labels, so that copies weigh as one. With more than `most`
    of them about so many are drawn by the digest. Without any, every score is 0.5.
    """
    one = rows.filter("label is not null").groupBy("digest").agg(F.first("x").alias("x"), F.avg(F.col("label").cast("double")).alias("y"))
    one = written(one.withColumn("drawn", F.pmod(F.xxhash64("digest"), F.lit(1 << 30))), "labelled")
    n = one.count()
    if not n:
        return Model(np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)), np.zeros(0), np.zeros(0), np.zeros(0))
    one = one.filter(F.col("drawn") < int((1 << 30) * min(1.0, most / n)) + 1)
    one = written(one.select("x", "y", (F.col("drawn") % FOLDS).cast("int").alias("fold")).repartition(FIT_TASKS, F.xxhash64("digest")), "fit")
    told = one.agg(*[f(F.col("x")[i]).alias(f"{name}{i}") for name, f in (("m", F.avg), ("s", F.stddev_pop)) for i in range(len(STATISTICS))]).first()
    mean = np.array([told[f"m{i}"] for i in range(len(STATISTICS))])
    scale = np.array([told[f"s{i}"] for i in range(len(STATISTICS))])
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(0), np.zeros(0), np.zeros(0))
    d = FEATURES + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((FOLDS, d, d + 2))
        for batch in batches:
            z, y, fold = model.features(_matrix(batch["x"])), batch["y"].to_numpy(), batch["fold"].to_numpy()
            for f in range(FOLDS):
                zf, yf = z[fold == f], y[fold == f]
                sums[f, :, :d] += zf.T @ zf
                sums[f, :, d] += zf.T @ yf
                sums[f, 0, d + 1] += len(yf)
        yield pa.record_batch([pa.array(range(FOLDS), pa.int32()), pa.array([s.tobytes() for s in sums], pa.binary())], names=["fold", "sums"])

    def added(table: pa.Table) -> pa.Table:
        total = np.zeros(d * (d + 2))
        for s in sorted(table["sums"].to_pylist()):  # in one order, whichever task ends first
            total += np.frombuffer(s)
        return pa.table([table["fold"][:1].combine_chunks(), pa.array([total.tobytes()], pa.binary())], names=["fold", "sums"])

    by_fold = {r.fold: np.frombuffer(r.sums).reshape(d, d + 2) for r in one.mapInArrow(partial, "fold int, sums binary").groupBy("fold").applyInArrow(added, "fold int, sums binary").collect()}
    every = sum(by_fold.values())

    def solved(sums: np.ndarray) -> np.ndarray:
        penalty = np.eye(d) * max(sums[0, d + 1], 1.0) * RIDGE
        penalty[-1, -1] = 1e-9
        return np.linalg.solve(sums[:, :d] + penalty, sums[:, d])

    unseen = np.stack([solved(every - by_fold[f]) for f in range(FOLDS)], axis=1)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, fold = model.features(_matrix(batch["x"])), batch["fold"].to_numpy()
            s = np.take_along_axis(z @ unseen, fold[:, None].astype(np.int64), axis=1)[:, 0]
            cell = np.clip(((s + 0.5) / 2 * CELLS).astype(np.int64), 0, CELLS - 1)
            yield pa.record_batch([pa.array(cell), batch["y"], pa.array(s)], names=["cell", "y", "s"])

    found = one.mapInArrow(cells, "cell bigint, y double, s double").groupBy("cell").agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.avg("s").alias("s")).orderBy("cell").toArrow()
    n_of, y_of, at = (found[c].to_numpy().astype(float) for c in ("n", "y", "s"))
    return Model(mean, model.scale, solved(every), at, isotonic(n_of, y_of))


def held_out() -> Column:
    """Rows whose labels nothing learns from: the CRC-32 of doc_id as text is divisible by 5; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def quality_scores(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """How likely each of docs (doc_id, text; more columns are ignored) is of good quality, as labels (doc_id, quality) mark it.

    Only labels of rows that are not held_out are learnt from; of several of a doc_id the mean counts, null ones
    and those without doc_id are left out. A score depends on the text alone. Null texts are empty; these
    have a score too. Rows that repeat a doc_id are scored each by itself. An empty table gives no rows.

    One row per row of docs: doc_id, held_out, score (0 to 1), predicted (1 from a score of GOOD on).
    """
    told = written(described(docs), "statistics")
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("label"))
    model = told.sparkSession.sparkContext.broadcast(fit(told.filter(~held_out()).join(known, "doc_id"), most))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch([batch["doc_id"], pa.array(model.value.scores(_matrix(batch["x"])))], names=["doc_id", "score"])

    scored = map_rows(told.select("doc_id", "x"), lambda: work, "doc_id bigint, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
