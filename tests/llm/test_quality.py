"""The classifier: held-out accuracy over whole tables, its parts against plain numpy, odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratiolake.llm import quality as q

from .cases import ODD, table, with_clashes

LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture(scope="module")
def scored(spark):
    d = "/root/testdata/sf0.01"
    return {r.doc_id: r for r in q.op13_quality(spark, d).collect()}, {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}, spark.read.parquet(f"{d}/documents.parquet").count()


def test_held_out_accuracy(scored):
    rows, labels, n = scored
    assert len(rows) == n
    held = [(rows[i], y) for i, y in labels.items() if rows[i].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    right = sum(r.predicted == y for r, y in held) / len(held)
    most = max(np.mean([y for _, y in held]), 1 - np.mean([y for _, y in held]))
    assert right >= 0.95 > most
    good, bad = ([r.score for r, y in held if y == k] for k in (1, 0))
    assert np.mean([(a > b) + (a == b) / 2 for a in good for b in bad]) >= 0.93  # area under the ROC curve
    assert np.mean([(r.score - y) ** 2 for r, y in held]) <= 0.05


def test_held_out_labels_and_other_columns_change_nothing(spark):
    rows = [(i, ("All well, and more of it. " if i % 3 else "JUNK #%$ ") * (1 + i % 7)) for i in range(120)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(120)]
    plain = {r.doc_id: r for r in q.quality_scores(table(spark, rows), table(spark, labels, LABELS)).collect()}
    turned = [(i, y if zlib.crc32(str(i).encode()) % 5 else 1 - y, t) for i, y, t in labels]
    docs = with_clashes(table(spark, rows)).withColumn("lang", F.lit("xx")).withColumn("x", F.lit("mine"))
    other = {r.doc_id: r for r in q.quality_scores(docs, with_clashes(table(spark, turned, LABELS))).collect()}
    assert {i: (r.predicted, r.held_out) for i, r in plain.items()} == {i: (r.predicted, r.held_out) for i, r in other.items()}
    assert max(abs(plain[i].score - other[i].score) for i in plain) < 1e-6
    assert all(r.predicted == int(i % 3 > 0) for i, r in plain.items())


def test_odd_rows(spark):
    labels = [(i, i % 2, 0) for i in range(1, 9)] + [(None, 1, 1), (4, None, 0), (5, 0, 0)]
    got = q.quality_scores(table(spark, ODD), table(spark, labels, LABELS)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in ODD)
    assert all(0 <= r.score <= 1 for r in got) and all(r.held_out for r in got if r.doc_id is None)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1  # null and empty texts
    assert q.quality_scores(table(spark, []), table(spark, labels, LABELS)).count() == 0
    unknown = q.quality_scores(table(spark, ODD), table(spark, [], LABELS)).collect()
    assert {r.score for r in unknown} == {0.5} and len(unknown) == len(ODD)


def test_one_class_and_copies(spark):
    rows = [(i, "the same text") for i in range(300)] + [(1000 + i, f"text number {i}!") for i in range(40)]
    got = q.quality_scores(table(spark, rows), table(spark, [(i, 1, 0) for i, _ in rows], LABELS)).collect()
    assert len(got) == 340 and all(r.score > 0.9 for r in got)


def test_normal_equations_are_those_of_all_rows_together(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, len(q.STATISTICS)))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    data = [(xs.tolist(), i.to_bytes(16, "big"), int(v)) for i, (xs, v) in enumerate(zip(x, y, strict=True))]
    model = q.fit(spark.createDataFrame(data, "x array<double>, digest binary, label int").repartition(7))
    z = q.fourier((x - x.mean(0)) / x.std(0))
    penalty = np.eye(z.shape[1]) * len(x) * q.RIDGE
    penalty[-1, -1] = 1e-9
    assert np.allclose(z @ np.linalg.solve(z.T @ z + penalty, z.T @ y), z @ model.weights, atol=1e-6)
    assert (np.diff(model.means) >= 0).all() and (np.diff(model.at) > 0).all()


def test_random_features_approximate_the_kernel(monkeypatch):
    monkeypatch.setattr(q, "FEATURES", 20000)
    monkeypatch.setattr(q, "_drawn", {})
    a, b = np.random.default_rng(2).normal(size=(2, 30, 6))
    close = (q.fourier(a)[:, :-1] * q.fourier(b)[:, :-1]).sum(1)
    assert np.abs(close - np.exp(-((a - b) ** 2).sum(1) / (2 * q.WIDTH**2 * 6))).max() < 0.05


def test_isotonic_is_the_best_non_decreasing_fit():
    assert q.isotonic(np.array([1, 1, 2, 1]), np.array([0, 1, 0, 1])).tolist() == [0, 1 / 3, 1 / 3, 1]
    rng = np.random.default_rng(3)
    w, t = rng.integers(1, 5, 40), rng.random(40)
    best = q.isotonic(w, t * w)
    # by the min-max formula
    cut = lambda a, b: (t * w)[a : b + 1].sum() / w[a : b + 1].sum()
    assert np.allclose(best, [max(min(cut(a, b) for b in range(i, 40)) for a in range(i + 1)) for i in range(40)])


def test_long_texts_in_parts(monkeypatch):
    raw = ("Éa b, LOUD  x1\n\n" * 30 + "word " * 9 + "\tend").encode()
    whole = q.statistics(raw)
    monkeypatch.setattr(q, "_PART", 7)
    assert q.statistics(raw) == whole and len(whole) == len(q.STATISTICS)
    assert b"".join(q.parts(raw)) == raw and list(q._lines(raw)) == raw.split(b"\n")
    assert q.statistics(b"") == [0.0] * len(q.STATISTICS) and len(q.statistics(b" \n ")) == len(q.STATISTICS)
