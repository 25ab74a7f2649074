"""The audit of filters against plain counting, document by document and order by order."""

import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from ratiolake.llm import filter_audit as fa

from .cases import DOCS, LONG, ODD, table, with_clashes


def plain_failures(rows):
    least = {}
    order = lambda i: (i is not None, i)
    for i, t, *_ in rows:
        least[t or ""] = min(least.get(t or "", order(i)), order(i))
    out = []
    for i, t, *_ in rows:
        t = t or ""
        words = [w for w in re.split("[ \t-\r]+", t) if w]
        out.append({x for x, bad in zip("ABCDE", (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), bool(set("#$%&*|") & set(t)), order(i) > least[t]), strict=True) if bad})
    return out


def plain_audit(rows, labels):
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1 and i is not None} for k in (0, 1))
    parts = {}
    for r, fails in zip(rows, plain_failures(rows), strict=True):
        parts.setdefault(r[3] or "", []).append((fails, r[0] in good, r[0] in toxic))
    out = {}
    for part, docs in parts.items():
        gone_at = Counter()
        for order in permutations("ABCDE"):
            left = docs
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                gone_at[f] += len(gone)
                alone = sum(d[0] == {f} for d in docs)
                out[part, "".join(order), k + 1] = [len(left), len(gone), sum(f in d[0] for d in docs) - len(gone), alone, sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for (p, order, k), x in out.items():
            if p == part:
                x.append(gone_at[order[k - 1]])
    return out


def rows_of(df):
    return {(r.part, r.filter_order, r.step): [r[c] for c in fa.COUNTS] for r in df.collect()}


WORDS = " ".join(f"w{i}" for i in range(60))
ROWS = [
    *[(i, t, "en", "s", 1) for i, t in ODD],
    *[(100 + i, WORDS + (" #" if i % 2 else "") + (" LOUD" * 60 if i % 3 == 0 else ""), "en", None if i % 5 else "t", 1) for i in range(40)],
    (200, WORDS, "en", "", 1), (199, WORDS, "en", "t", 1), (199, WORDS, "en", "t", 1), (201, "É" * 19 + "A", "en", "t", 1), (202, LONG + "z", "en", "t", 1),
]


def test_counts_are_those_of_plain_counting(spark):
    labels = [(i, i % 2, (i // 2) % 2) for i in range(100, 140)] + [(101, 1, None), (None, 1, 1), (1, None, None), (6, 1, 1)]
    docs = with_clashes(table(spark, ROWS, DOCS))
    got = rows_of(fa.audit(fa.labelled_failures(docs, with_clashes(table(spark, labels, "doc_id bigint, quality int, toxic int")))))
    assert got == plain_audit(ROWS, labels)


def test_words_of_long_texts_are_counted_in_parts(monkeypatch):
    text = (" ".join(f"w{i % 70}" for i in range(400)) + "\n\tend ").encode()
    whole = fa.own_failures(text)
    monkeypatch.setattr(fa, "_PART", 5)
    assert fa.own_failures(text) == whole == 2


def test_empty_table(spark):
    assert fa.audit(fa.labelled_failures(table(spark, [], DOCS), table(spark, [], "doc_id bigint, quality int, toxic int"))).count() == 0


def test_any_number_of_filters(spark):
    masks = table(spark, [("p", True, None, m) for m in (0, 1, 2, 3, 3)], "part string, good boolean, toxic boolean, mask int")
    got = rows_of(fa.audit(masks, "XY"))
    assert got["p", "YX", 1] == [2, 3, 0, 1, 3, 0, 4] and got["p", "YX", 2] == [1, 1, 2, 1, 1, 0, 4] and len(got) == 4


def test_transform_is_exact_and_refuses_other_sums():
    cells = np.random.default_rng(1).integers(0, 1 << 40, (3, 32))
    signs = np.array([[(-1) ** bin(a & b).count("1") for a in range(32)] for b in range(32)])
    assert (fa.inverted(cells @ signs.T) == cells).all()
    with pytest.raises(ValueError):
        fa.inverted(np.array([3, 2]))


def test_one_text_in_thousands_of_copies(spark):
    rows = [(i, WORDS, "en", "s", 1) for i in range(3000)]
    got = rows_of(fa.audit(fa.labelled_failures(table(spark, rows, DOCS), table(spark, [], "doc_id bigint, quality int, toxic int"))))
    assert got["s", "EABCD", 1] == [1, 2999, 0, 2999, 0, 0, 2999 * 120]
