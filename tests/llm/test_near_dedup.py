import random

import numpy as np
import pytest

from ratiolake.llm import near_dedup
from ratiolake.llm.graph import components
from ratiolake.llm.words import Words

from .cases import ODD, lower, table, with_clashes


def sets(rows, k):
    out = {}
    for d, t in rows:
        w = lower(t).encode().split()
        out.setdefault(d, []).append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def brute(rows, k):
    own = [(d, s) for d, many in sets(rows, k).items() for s in many]
    least = lambda d: -1 if d is None else d
    top = {least(d): least(d) for d, _ in own}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, (d, x) in enumerate(own):
        for e, y in own[:i]:
            common = len(x & y)
            if x and y and 100 * common >= 80 * (len(x) + len(y) - common):
                a, b = sorted((find(least(d)), find(least(e))))
                top[b] = a
    return {d: find(least(d)) for d, _ in own}


def check(spark, rows, k):
    want = brute(rows, k)
    n = {d: [len(s) for s in many] for d, many in sets(rows, k).items()}
    got = near_dedup.near_groups(with_clashes(table(spark, rows)).repartition(3), k).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (-1 if r.component_id is None else r.component_id) == want[r.doc_id], r
        assert r.n_shingles in n[r.doc_id]
        assert r.kept == (r.doc_id == r.component_id)


def edited(words, n, vocabulary):
    t = words[:]
    for _ in range(n):
        t[random.randrange(len(t))] = random.choice(vocabulary)
    return " ".join(t)


def test_small_and_large_families(spark):
    """A family of 150, with rows on both sides of 0.8 from most others, one with edits of its own in common, and small ones."""
    random.seed(8)
    vocabulary = [f"w{i}" for i in range(4000)]
    base = [random.choice(vocabulary) for _ in range(120)]
    branch = edited(base, 9, vocabulary).split()
    rows = [(1000 + i, edited(base if i % 3 else branch, random.choice([0, 1, 2, 3, 5, 7, 8, 9, 10, 11, 12, 14]), vocabulary)) for i in range(150)]
    for i in range(60):
        own = [random.choice(vocabulary) for _ in range(random.randint(1, 150))]
        rows += [(2000 + 3 * i + j, edited(own, random.randint(0, 5), vocabulary).upper() if j else " ".join(own)) for j in range(random.randint(1, 3))]
    random.shuffle(rows)
    check(spark, rows + [(d, t) for d, t in ODD if d is not None], 2)


def test_five_words_and_odd_rows(spark):
    random.seed(9)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [random.choice(vocabulary) for _ in range(200)]
    rows = [*ODD, *[(50 + i, edited(base, i % 5, vocabulary)) for i in range(12)]]
    check(spark, rows, 5)
    docs = with_clashes(table(spark, rows))
    out = near_dedup.one_of_each(docs, 5)
    assert out.columns == docs.columns
    want = brute(rows, 5)
    assert {r.doc_id for r in out.collect()} == {d for d, c in want.items() if (-1 if d is None else d) == c}
    assert near_dedup.near_groups(table(spark, [])).collect() == []


def test_families_among_unrelated_documents_of_a_small_vocabulary(spark):
    """Unrelated documents with smaller identifiers have the keys of nearly all planted pairs."""
    rng = np.random.default_rng(1)
    n, pairs, size = 3000, 200, 400
    vocabulary = rng.integers(0, 1 << 63, size).astype(np.uint64)
    hashed = np.stack([(vocabulary * a + b) >> np.uint64(32) for a, b in zip(near_dedup._A, near_dedup._B, strict=True)]).astype(np.uint32)
    has = rng.random((n + 2 * pairs, size)) < 0.3
    for i in range(n, n + 2 * pairs, 2):
        y, k = has[i].copy(), int(has[i].sum() * 0.1)
        gone, new = rng.choice(np.flatnonzero(y), k, False), rng.choice(np.flatnonzero(~y), k, False)
        y[gone], y[new] = False, True
        has[i + 1] = y
    low = np.stack([hashed[:, x].min(axis=1) for x in has])
    nodes = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(low)], "id bigint, minima binary")
    got = {r.id: r.comp for r in near_dedup.loose_families(nodes).collect()}
    keys = near_dedup.table_keys(low)
    for i in range(n + 2 * pairs):
        linked = ((keys == keys[i]).sum(axis=1) >= 2) & ((low == low[i]).sum(axis=1) >= near_dedup.LOOSE)
        assert {got.get(j, j) for j in np.flatnonzero(linked).tolist()} == {got.get(i, i)}


def test_strays_meet_a_large_family_without_a_row_for_each_pair(spark, monkeypatch):
    """300 rows of a family and 30 strays in a key, and a key of strays alone; packs of strays and shares of rows leave no pair out."""
    rng = np.random.default_rng(3)
    low = rng.integers(0, 1 << 32, (400, near_dedup.MINIMA)).astype(np.uint32)
    for i in range(330):  # the key's four minima and, of strays, up to 11 more as in another row
        has = rng.random(near_dedup.MINIMA) < (0.8 if i < 300 else 0.3)
        has[[0, 1, 16, 17]] = True
        low[i, has] = low[399, has]
    family = [0] * 300 + list(range(300, 330)) + [330] * 5 + list(range(335, 399))
    low[340, :14] = low[335, :14]
    low[341, 4:20] = low[335, 4:20]
    placed = [(7, i, family[i], 0, 330, 30) for i in range(330)] + [(8, i, family[i], 330, 69, 64) for i in range(330, 399)]
    placed = spark.createDataFrame(placed, "key bigint, id bigint, family bigint, main bigint, size bigint, strays bigint")
    sig = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(low)], "id bigint, minima binary")
    moved, before = [], near_dedup.map_rows
    monkeypatch.setattr(near_dedup, "map_rows", lambda df, *more: moved.append(df.count()) or before(df, *more))
    got = {frozenset((family[r.a], family[r.b])) for r in near_dedup.strays_met(placed, sig).collect()}
    keys, want = near_dedup.table_keys(low), set()
    for some in (range(330), range(330, 399)):
        for i in some:
            for j in some:
                if family[i] != family[j] and (keys[i] == keys[j]).sum() >= 2 and (low[i] == low[j]).sum() >= near_dedup.LOOSE:
                    want.add(frozenset((family[i], family[j])))
    assert got == want and frozenset((335, 341)) in want and 5 < len(want) < 400
    assert moved == [330 + 69 * 2]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 200), (101, 102), (60, 50), (61, 50)]
    got = {r.id: r.comp for r in components(table(spark, edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200, 50: 50, 60: 50, 61: 50}
    assert components(table(spark, [], "a bigint, b bigint")).collect() == []


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_long_words_of_two_letters_are_told_apart(spark):
    rows = [(i, f"{thue_morse(n, letters)} x") for i, (n, letters) in enumerate([(1024, "ab"), (1024, "ba"), (4096, "ab"), (4096, "ba"), (16, "ab"), (16, "ba"), (17, "ab"), (17, "ba")])]
    assert all(r.component_id == r.doc_id for r in near_dedup.near_groups(table(spark, rows), 2).collect())
    assert len(set(Words([t.encode() for _, t in rows]).hash.tolist())) == len(rows) + 1


@pytest.mark.parametrize("shared, n, most", [(889, 1000, 0.006), (919, 1000, 0.002), (948, 1000, 0.001)])
def test_recall_of_the_tables(shared, n, most):
    """Pairs of similarity 0.80, 0.85 and 0.90 that have no two tables in common, or too few minima: the computed chance is 0.0006 at 0.80."""
    rng = np.random.default_rng(shared)
    missed, pairs = 0, 1500
    for _ in range(pairs // 100):
        sets = []
        for _ in range(100):
            x = rng.integers(0, 1 << 63, 2 * n - shared, np.uint64)
            sets += [np.sort(x[:n]), np.sort(np.concatenate((x[:shared], x[n:])))]
        low = near_dedup.minima(sets)
        keys = near_dedup.table_keys(low)
        a, b = low[::2], low[1::2]
        missed += int((((keys[::2] == keys[1::2]).sum(1) < 2) | ((a == b).sum(1) < near_dedup.LOOSE)).sum())
    assert missed <= most * pairs
