import random
from collections import Counter, defaultdict

import numpy as np

from ratiolake.llm import line_dedup, near_dedup, substring_dedup
from ratiolake.llm import words as word_hash
from ratiolake.llm.words import parts

from .cases import ODD, table, with_clashes, words

STRIP = b" \t\n\x0b\x0c\r"


def brute_lines(rows, min_chars, min_docs):
    keyed = lambda line: line.strip(STRIP).lower()
    docs = defaultdict(set)
    for d, t in rows:
        for line in (t or "").encode().split(b"\n"):
            if len(keyed(line).decode()) >= min_chars:
                docs[keyed(line)].add(-1 if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").encode().split(b"\n")
        stay = [x for x in lines if len(docs[keyed(x)]) < min_docs or max(docs[keyed(x)]) == (-1 if d is None else d)]
        out.append((d, b"\n".join(stay).decode(), len(lines), len(lines) - len(stay)))
    return sorted(out, key=repr)


def test_lines(spark):
    long = "x" * 39 + "é"
    rows = [*ODD, *[(i, f"{long}\nown {i}\n  {long.upper().replace('É', 'é')}\t\n" + "y" * 39 + "\n\n") for i in range(30, 36)], (36, long + "\n" + long), (36, "other\n" + long), (37, ("z" * 50 + "\n") * 3), (38, "q" * 50)]
    rows += [(40 + i, "z" * 50) for i in range(3)]
    rows += [(None, f"{long}\n{i}") for i in range(4)]
    got = line_dedup.dedup_lines(with_clashes(table(spark, rows)).repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_lines(rows, 40, 5)
    assert sum(r.n_dropped for r in got) > 6
    assert line_dedup.dedup_lines(table(spark, [])).collect() == []


def brute_windows(rows, width):
    every = [words(t) for _, t in rows]
    n = Counter(tuple(w[i : i + width]) for w in every for i in range(len(w) - width + 1))
    out = []
    for (d, _), w in zip(rows, every, strict=True):
        gone = set()
        for i in range(len(w) - width + 1):
            if n[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((d, b" ".join(x for i, x in enumerate(w) if i not in gone).decode(), len(w), len(gone)))
    return sorted(out, key=repr)


def test_windows(spark):
    random.seed(4)
    word = lambda n: [random.choice("abcdefgh") * random.randint(1, 4) for _ in range(n)]
    passage, other = word(60), word(35)
    rows = list(ODD)
    for i in range(60):
        t = word(random.randint(0, 150))
        if i % 4 == 0:
            t[20:20] = passage[i % 20 : 36 + i % 24]
        if i % 7 == 0:
            t += other[: 34 + i % 2]
        if i % 9 == 0 and len(t) > 80:
            t = t[:80] + ["edit"] + t[81:]
        rows.append((100 + i, "\n".join(" ".join(t[k : k + 9]) for k in range(0, len(t), 9))))
    rows += [(300, "ha " * 36), (301, "ho " * 35), (302, rows[-1][1]), (302, "same id " + " ".join(word(90))), (303, "a\0b " * 40)]
    want = brute_windows(rows, 35)
    for most_cells in (1 << 20, 0):  # a sketch that goes to all tasks, and one that stays a table
        got = substring_dedup.remove_repeats(with_clashes(table(spark, rows)).repartition(3), most_cells=most_cells).collect()
        assert sorted(((r.doc_id, r.kept_text, r.n_words, r.n_removed) for r in got), key=repr) == want
        for r in got:
            assert sum(b - a for a, b in zip(r.removed_from, r.removed_to, strict=True)) == r.n_removed
    assert substring_dedup.remove_repeats(table(spark, []), most_cells=-1).collect() == []
    assert substring_dedup.remove_repeats(table(spark, [])).collect() == []


def test_narrow_windows_and_a_crowded_sketch(spark, monkeypatch):
    """The sketch may take single windows for repeated ones; the exact pass puts that right."""
    from ratiolake.llm import sketch

    monkeypatch.setattr(sketch, "cells_for", lambda n: sketch.MIN_CELLS)
    random.seed(5)
    rows = [(i, " ".join(random.choice("abc") for _ in range(random.randint(0, 60)))) for i in range(300)]
    got = substring_dedup.remove_repeats(table(spark, rows), width=6, grain=3).collect()
    assert sorted(((r.doc_id, r.kept_text, r.n_words, r.n_removed) for r in got), key=repr) == brute_windows(rows, 6)


def test_texts_in_parts_are_as_whole(spark):
    """Windows, sets and spans of texts that are taken in parts of any size are those of the whole texts."""
    random.seed(15)
    texts = [" ".join(random.choice("abc") * random.choice([1, 1, 2, 30]) for _ in range(n)).encode() for n in (0, 1, 5, 40, 300, 2000)] + [b"  lead  \n trail \t", b"x" * 500, b" " * 700, b"q r " * 400]
    width, grain = 6, 3
    whole = substring_dedup.Scan(texts, width, grain, 1 << 20)
    maybe = lambda a: a % np.uint64(3) != 0
    flat = lambda scan: sorted((int(d), int(a), tuple(x)) for doc, at, h in scan.suspects(maybe) for d, a, x in zip(doc, at, h.tolist(), strict=True))
    single = [None if i % 2 else np.arange(0, 200, 3, dtype=np.int32)[: len(t.split())] for i, t in enumerate(texts)]
    for size in (1, 7, 50, 333):
        part = substring_dedup.Scan(texts, width, grain, size)
        assert flat(part) == flat(whole)
        assert list(part.removal(maybe, single)) == list(whole.removal(maybe, single))
        found = lambda scan: {int(x) for _, _, w, *_ in scan.blocks() for x in w.occurrences}
        assert found(part) == found(whole)
    for t in texts:
        for k in (1, 2, 5):
            want = next(near_dedup.shingle_sets([t], k))
            runs = [np.unique(p.runs(k)[:own]) for p, own, _ in parts(t, k - 1, 40)]
            assert len(t.split()) < k or (np.unique(np.concatenate(runs)) == want).all()


def test_spans_over_several_sums(monkeypatch):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, 3000).astype(np.uint8)
    start = np.sort(rng.integers(0, 3001, 200))
    end = np.maximum.accumulate(np.minimum(3000, start + rng.integers(0, 900, 200)))
    want = word_hash._spans(a, word_hash._BYTES, start, end, 1)
    monkeypatch.setattr(word_hash, "_SUM", 64)
    small = word_hash._Powers(word_hash._BASE)
    assert (word_hash._spans(a, small, start, end, 1) == want).all()
    byhand = [sum((int(a[j]) + 1) * pow(word_hash._BASE, j - i, 1 << 64) for j in range(i, e)) % (1 << 64) for i, e in zip(start[:40].tolist(), end[:40].tolist(), strict=True)]
    assert want[:40].tolist() == byhand


def test_distributed_cells_over_count_and_never_miss(spark):
    import numpy as np
    import pyarrow as pa

    from ratiolake.llm import sketch

    rng = np.random.default_rng(8)
    values = [rng.integers(0, 60, 5).tolist() for _ in range(30)]
    docs = spark.createDataFrame([(i % 20, 0, v) for i, v in enumerate(values)], "d long, t long, v array<long>").repartition(4)

    def items(batch):
        yield batch["v"].flatten().to_numpy().view(np.uint64), np.repeat(np.arange(batch.num_rows), [len(x) for x in batch["v"]])

    counts = np.bincount(np.concatenate(values), minlength=60)
    for cells in (4, 64, 1 << 20):
        known = {r.d: set(r.known) for r in sketch.known_items(docs, items, cells).collect()}
        of = {}
        for i, v in enumerate(values):
            of.setdefault(i % 20, set()).update(v)
        assert all({x for x in of[d] if counts[x] > 1} <= known.get(d, set()) <= of[d] for d in of)
        if cells == 1 << 20:
            assert all(known.get(d, set()) == {x for x in of[d] if counts[x] > 1} for d in of)
    assert sketch.among(pa.array([[3, 5], None, []], pa.list_(pa.int64())))(np.array([3, 4], np.uint64)).tolist() == [True, False]
