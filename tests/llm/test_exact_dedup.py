import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from ratiolake.llm import exact_dedup
from ratiolake.llm.common import scratch

from .cases import ODD, lower, table, with_clashes

ROWS = [*ODD, (20, "A b"), (21, "a B"), (22, "a b "), (23, "É"), (24, "é"), (25, "dup"), (25, "dup"), (25, "dup")]


def brute(rows):
    groups = defaultdict(list)
    for i, (d, t) in enumerate(rows):
        groups[lower(t)].append((d is not None, d, i))
    out = []
    for t, g in groups.items():
        keep = max(g, key=lambda x: (x[0], x[1] or 0))[1]
        out += [(d, keep, len(g), hashlib.sha256(t.encode()).hexdigest()) for _, d, _ in g]
    return sorted(out, key=repr), len(groups)


def check(got, rows):
    want, n = brute(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == n == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_groups(spark):
    check(exact_dedup.exact_groups(with_clashes(table(spark, ROWS).repartition(3))).collect(), ROWS)


def test_texts_that_share_a_digest_are_told_apart_by_their_bytes(spark):
    weak = lambda text: F.substring(F.unhex(F.sha2(text, 256)), 1, 0)
    check(exact_dedup.exact_groups(table(spark, ROWS), digest=weak).collect(), ROWS)


def test_empty_table_and_rows_that_stay(spark):
    assert exact_dedup.exact_groups(table(spark, [])).collect() == []
    docs = with_clashes(table(spark, ROWS))
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    assert sorted(lower(r.text) for r in out.collect()) == sorted({lower(t) for _, t in ROWS})


def test_state_outlives_the_stream(spark):
    arrivals, state = scratch(spark, "a"), scratch(spark, "s")
    cols = "digest binary, doc_id bigint, file string, row bigint"
    for rows in ([(b"x", 1, "f", 0), (b"y", 2, "f", 1)], [(b"x", 5, "g", 0)]):
        table(spark, [(bytearray(a), b, c, d) for a, b, c, d in rows], cols).write.mode("append").parquet(arrivals)
        got = exact_dedup.keyed_state(spark, arrivals, state)
    seen = {bytes(r.key.digest): list(r.value) for r in got.select("key", "value").collect()}
    assert seen[b"x"][0] == 5 and seen[b"x"][-1] == 2 and seen[b"y"][0] == 2 and seen[b"y"][-1] == 1
