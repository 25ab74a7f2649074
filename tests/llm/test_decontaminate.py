import random

from ratiolake.llm import decontaminate as dc

from .cases import ODD, table, with_clashes


def distance(p, t, first=False, last=False):
    """None in p is the edge of a word."""
    p, t = [None] * first + list(p) + [None] * last, f" {t} "
    before = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        now = [i]
        for j, b in enumerate(t, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (b.isalnum() if a is None else a != b)))
        before = now
    return min(before)


def test_myers():
    random.seed(11)
    for _ in range(3000):
        p, t = ("".join(random.choice("abé ") for _ in range(random.randint(0, n))) for n in (12, 25))
        for first, last in ((False, False), (True, False), (False, True), (True, True)):
            assert dc.least_distance(p, f" {t} ", first, last) == distance(p, t, first, last)


def brute(rows, items):
    out, no_id = [], 1 << 62
    for d, t in rows:
        text, found = dc.normal((t or "").encode()), {}
        for item_id, item in items:
            item = dc.normal((item or "").encode())
            for p, first, last in dc.passages(item):
                n = distance(p, text, first, last)
                if p and n <= max(1, len(p) // dc.PER_EDIT) - 1:
                    key = no_id if item_id is None else item_id
                    found[key] = min(n, found.get(key, n))
        out.append((d, [None if i == no_id else i for i in sorted(found)], min(found.values(), default=None), bool(found)))
    return sorted(out, key=repr)


def test_items_within_their_budget(spark):
    random.seed(12)
    word = lambda: "".join(random.choice("abcdefghijé") for _ in range(random.randint(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(random.randint(4, 60)).capitalize()) for i in range(12)] + [(50, "short"), (51, None), (52, ""), (None, text(20)), (-1, text(20)), (53, text(10)), (53, text(12)), (54, "no"), (None, "short")]
    rows = [(d, t) for d, t in ODD if len(t or "") < 1000]
    for i in range(90):
        part = list(random.choice(items)[1] or "")
        for _ in range(random.choice([0, 0, 1, 2, 3, 5, 8])):
            at = random.randrange(len(part)) if part else 0
            part[at : at + random.randint(0, 1)] = random.choice(["", "z", "y"])
        part = "".join(part)
        rows.append((100 + i, f"{text(i % 9)} {part.upper().replace(' ', '  ' if i % 2 else chr(10)) if i % 5 else part[len(part) // 3 :]} {text(i % 7)}"))
    rows += [(300, "a SHORT one"), (301, "shorter"), (302, "x short, y"), (303, "know nothing"), (304, "no")]
    docs, tests = with_clashes(table(spark, rows)).repartition(3), table(spark, items, "item_id bigint, text string")
    want = brute(rows, items)
    assert sum(w[3] for w in want) > 30 and sum(not w[3] for w in want) > 20
    for at_once in (dc.AT_ONCE, 700):
        got = dc.find_items(docs, tests, at_once=at_once).collect()
        assert sorted((tuple(r) for r in got), key=repr) == want
        clean = dc.clean_rows(docs, tests, at_once)
        assert clean.columns == docs.columns
        assert sorted((r.doc_id for r in clean.collect()), key=repr) == sorted((w[0] for w in want if not w[3]), key=repr)


def test_empty_tables(spark):
    none, items = table(spark, []), table(spark, [], "item_id bigint, text string")
    assert dc.find_items(none, items).collect() == [] and dc.clean_rows(none, items).collect() == []
    got = dc.find_items(table(spark, [(1, "x"), (None, None)]), items).collect()
    assert [(r.item_ids, r.distance, r.contaminated) for r in got] == [([], None, False)] * 2


def test_the_registered_query_against_brute_force(spark, sf):
    """Whole tables of the smallest scale; a cheap bound (shared pieces) tells which pairs need the table of distances."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {}
    for d, t in docs:
        text, found = dc.normal((t or "").encode()), {}
        for item_id, item in items:
            for p, first, last in dc.passages(dc.normal((item or "").encode())):
                budget = len(p) // dc.PER_EDIT - 1
                third = [p[i : i + dc.PER_EDIT // 2] for i in range(0, len(p), dc.PER_EDIT // 2)]
                # budget edits leave at least one whole tenth-part of the passage in place
                for i, x in enumerate(third):
                    at = text.find(x)
                    while at >= 0:
                        start = at - i * (dc.PER_EDIT // 2)
                        a, b = start - budget - 1, start + len(p) + budget + 1
                        n = dc.least_distance(p, " " * (a < 0) + text[max(0, a) : b] + " " * (b > len(text)), first, last)
                        if n <= budget:
                            found[item_id] = min(n, found.get(item_id, n))
                        at = text.find(x, at + 1)
        want[d] = (sorted(found), min(found.values(), default=None), bool(found))
    got = {r.doc_id: (r.item_ids, r.distance, r.contaminated) for r in dc.op8_decontaminate(spark, sf).collect()}
    assert got == want and any(w[2] for w in want.values())


def test_one_rule_for_passages_of_all_lengths(spark):
    """Items of 5 to 300 code points, inside words, at edges, and in a very long text."""
    items = [(n, ("abcde fghij " * 30)[:n].strip()) for n in (5, 19, 21, 39, 41, 59, 62, 170, 300)]
    rows = []
    for n, item in items:
        rows += [(n, f"x {item}, y"), (1000 + n, f"x{item} y"), (2000 + n, f"x{item}y")]
    rows.append((3, "lorem ipsum " * 20000 + "abcde"))
    got = {r.doc_id: (r.item_ids, r.distance) for r in dc.find_items(table(spark, rows), table(spark, items, "item_id bigint, text string")).collect()}
    for d, text in rows[:-1]:
        want = brute([(d, text)], items)[0]
        assert got[d] == (want[1], want[2])
    assert got[3] == ([5], 0) and got[1019] == ([5], 0) and 21 not in got[1021][0] and got[1062][0][-1] >= 41
