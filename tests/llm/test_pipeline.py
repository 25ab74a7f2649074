"""The pipeline against plain Python, stage by stage, on its own documents."""

import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402

from ratiolake.llm import bpe  # noqa: E402

from .cases import DOCS, lower  # noqa: E402
from .test_bpe_and_counts import library  # noqa: E402
from .test_decontaminate import brute as holds_items  # noqa: E402
from .test_language_id import plain  # noqa: E402
from .test_near_dedup import brute  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    random.seed(14)
    path = tmp_path_factory.mktemp("corpus")
    vocabulary = {"en": [f"the{i}ing" for i in range(80)], "fr": [f"qu{i}eaux" for i in range(80)]}
    rows = []
    for i in range(120):
        lang = "en" if i % 3 else "fr"
        rows.append((i, " ".join(random.choice(vocabulary[lang]) for _ in range(random.randint(30, 90))), lang, f"s{i % 4}", 0))
    item = " ".join(random.choice(vocabulary["en"]) for _ in range(30))
    rows += [(200, rows[5][1].upper(), "en", "s1", 0), (201, rows[5][1], "en", "s1", 0), (202, rows[7][1] + " tail", "en", "s1", 0), (203, f"start {item[:40]}x{item[41:]} end", "en", "s1", 0), (204, None, None, None, None), (205, "", "en", "s1", 0), (206, "\x01\x02" * 100, None, None, None)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, [(1, item)]


def test_run(spark, folder):
    """Each stage in plain Python, on what its predecessor kept; the rows, ids and digests of run()."""
    path, rows, items = folder
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "bpe"]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    spoken = plain([(d, t, lang, None, source, None) for d, t, lang, source, _ in rows], [(t, lang) for _, t, lang, *_ in rows])
    kept = {r[0]: r[1] for r, (_, _, accepted) in zip(rows, spoken, strict=True) if accepted}
    assert not kept.keys() & {204, 205, 206}
    last = {}
    for d, t in sorted(kept.items()):
        last[lower(t)] = d
    kept = {d: kept[d] for d in last.values()}
    groups = brute(list(kept.items()), 5)
    kept = {d: t for d, t in kept.items() if groups[d] == d}
    held = {r[0] for r in holds_items(list(kept.items()), items) if r[3]}
    kept = {d: t for d, t in kept.items() if d not in held}
    assert 203 in held and 202 not in kept and 201 in kept and 200 not in kept and 5 not in kept
    assert got.keys() == kept.keys()
    for d, (ids, text) in zip(kept, library(bpe.tokenizer_file(), kept.values()), strict=True):
        r = got[d]
        assert (r.n_tokens, r.ids) == (len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_columns_stay_and_empty_tables_pass(spark, folder, tmp_path):
    path, *_ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for table in (docs, docs.limit(0)):
            assert stage(spark, table, path).columns == docs.columns
    empty = docs.limit(0)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, empty, path).write.parquet(f"{tmp_path}/{i}")
        empty = spark.read.parquet(f"{tmp_path}/{i}")
        assert empty.count() == 0
