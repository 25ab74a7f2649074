"""Phrases against counting every run of words in plain Python."""

import random
import re
from collections import Counter

import pytest

from ratiolake.llm import collocations as co

from .cases import DOCS, ODD, lower, table, with_clashes


def brute(rows, least, top=co.TOP):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang or "und" if lang != "" else ""] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang if lang is not None else "und", tuple(words[i : i + k])] += 1
    f = {p: c for p, c in f.items() if c >= least}
    out = {}
    for (lang, p), a in f.items():
        if len(p) == 1 or any(la == lang and len(q) > len(p) and c >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (la, q), c in f.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i, p.decode(), -a, le, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, le, r) in enumerate(sorted(found)[:top], 1))


def got(df):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def texts(n, seed=7):
    rng = random.Random(seed)
    words = ["Zum", "zum", "éa", "É", "of", "the", "a\x00b", "x" * 300, " ", "one", "two", "three", "four", "five", "six"]
    fixed = ["one two three four five six", "of the one", "the the the the the the"]
    out = []
    for i in range(n):
        some = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randrange(30))]
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\r\n", "\x0b", "! "]) for w in some)
        out.append((i, text, rng.choice(["en", "en", "de", None, ""]), "s", 1))
    return out


@pytest.mark.parametrize("task_rows", [1, 40, co.TASK_ROWS])
def test_phrases_are_those_of_brute_force(spark, task_rows):
    rows = texts(300) + [(i, t, "en", "s", 1) for i, t in ODD[:5]]
    want = brute(rows, 6)
    assert got(co.collocations(with_clashes(table(spark, rows, DOCS)).repartition(5), 6, task_rows=task_rows)) == want
    assert len(want) > 50 and {x[0] for x in want} >= {"en", "und"}


def test_small_parts_and_a_full_memory(spark, monkeypatch):
    rows = texts(120, 3)
    for name, n in (("_PART", 8), ("_HELD", 5), ("_HELD_WORDS", 4), ("_KNOWN", 3)):
        monkeypatch.setattr(co, name, n)
    known = co._Hashes(0)
    raws = [(t or "").encode() for _, t, *_ in rows]
    found = [x for ids in co._numbered(raws, known) for x in ids[: max(0, len(ids) - co.WORDS + 1)].tolist()]
    monkeypatch.undo()
    whole = co._Hashes(0)
    assert found == [x for ids in co._numbered(raws, whole) for x in ids[: max(0, len(ids) - co.WORDS + 1)].tolist()]
    assert [whole[w] for words in co._listed(raws) for w in words] == found


def test_ties_and_the_first_ranks(spark):
    rows = [(i, f"a{i % 4} b{i % 4}. B c", "en", "s", 1) for i in range(40)]
    assert got(co.collocations(table(spark, rows, DOCS), 5, top=2)) == brute(rows, 5, 2)
    assert [x[2] for x in brute(rows, 5)][:2] == ["a0 b0", "a1 b1"]


def test_one_phrase_in_every_text(spark):
    rows = [(i, "Of the same " * 40, "en", "s", 1) for i in range(200)]
    assert got(co.collocations(table(spark, rows, DOCS), 100, task_rows=1)) == brute(rows, 100)


def test_numbers_beyond_64_bits(spark):
    big = 10**16
    phrases = table(spark, [("en", [1], 3 * big + 1), ("en", [2], 2 * big + 3), ("en", [1, 2], big + 7)], "lang string, words array<bigint>, f bigint")
    r = co.scored(phrases, table(spark, [("en", 9 * big + 5)], "lang string, n bigint")).first()
    assert r.score == 1000 * (big + 7) * (9 * big + 5) // ((3 * big + 1) * (2 * big + 3))
    r = co.scored(phrases.filter("f = f"), table(spark, [("en", 10**17)], "lang string, n bigint")).first()
    assert r.score == 1000 * (big + 7) * 10**17 // ((3 * big + 1) * (2 * big + 3))


def test_words_that_share_a_hash_start_all_again(spark):
    # two words of one hash and seed can't be had in a test, so the count is shown them
    rows = table(spark, [("en", "aa bb")], "lang string, text string")
    assert co.word_counts(rows)[1] == 0
    found = co.xxh3_64_intdigest(b"aa", 0)
    assert found != co.xxh3_64_intdigest(b"aa", 1) and co._Hashes(1)[b"aa"] == co.xxh3_64_intdigest(b"aa", 1)


def test_odd_and_empty_tables(spark):
    rows = [(i, t, None, None, None) for i, t in ODD]
    assert got(co.collocations(table(spark, rows, DOCS), 2)) == brute(rows, 2)
    assert co.collocations(table(spark, [], DOCS)).count() == 0
    assert co.collocations(table(spark, rows[:4], DOCS), 2).count() == 0
