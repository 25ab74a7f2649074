import hashlib
import random
import re

from ratiolake.llm import pii

from .cases import ODD, table, with_clashes

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def holds(kind, s):
    digits = re.sub(r"\D", "", s)
    if kind == 1:
        return all(int(p) <= 255 for p in s.split("."))
    if kind == 2:
        luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
        return 13 <= len(digits) <= 19 and luhn
    return kind != 3 or 9 <= len(digits) <= 15


def brute(text):
    return [(k, *m.span()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text or "") if holds(k, m[0])]


def told(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)


def test_base_spans_are_those_of_the_patterns():
    random.seed(10)
    for _ in range(40000):
        text = "".join(random.choice("a1@.+- 9(0é") for _ in range(random.randint(0, 40)))
        assert pii.base_spans(text) == brute(text), text
    for text in ("4111 1111-1111 1111 x", "+1 (212) 555-0100", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3.255", "é@x.y a@b@c.d.e"):
        assert pii.base_spans(text) == brute(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 200000, "a" * 200000 + "@", "1." * 100000, "+" * 1000 + "1" * 100000, "a1" * 100000):
        pii.base_spans(text)
        list(pii.tokens(text, []))
    for text in ("1.2.3.4," * 40000, "(1 (1 " * 40000, "1 " * 100000, ") 1" * 50000, "a@b.c" + "x" * 100000 + " 1" * 50000):
        pii.candidates(text)


def test_tokens_and_contexts_are_whole():
    long = "7" * 100
    text = f"call {'w' * 300} {long} then"
    assert list(pii.tokens(text, [])) == [(306, 406)]
    two = pii.patterns(text, 306, 406)
    other = pii.patterns(text.replace("www", "wvw", 1), 306, 406)
    assert two[1].endswith("_ then") and two != other and two[0].startswith("call ")
    text = "x a@b.c, 12 34 10.0.0.1 z"
    base, near = pii.candidates(text)
    assert [n["patterns"] for n in near] == [["^ x _", "x _ ,"], ["0 0 _", "0 _ z"]]
    assert pii.patterns("a@b.c x 12345678", 8, 16, 5) == ["@ x _", "x _ $"] and pii.patterns("12345678 y", 0, 8) == ["^ ^ _", "^ _ y"]


def plain(texts):
    """What find_personal_data does, in plain Python: spans for each text."""
    near = [pii.candidates(t or "") for t in texts]
    links, seeds, forms = {}, {}, {}
    for _, found in near:
        for x in found:
            for p in x["patterns"]:
                links.setdefault(p, set()).add(x["token"])
            if x["kind"] >= 0:
                seeds.setdefault(x["token"], set()).add(x["kind"])
            else:
                forms[x["token"]] = forms.get(x["token"], 0) | x["form"]
    known: dict = {t: set(k) for t, k in seeds.items()}
    while True:
        new = set()
        for p, instances in links.items():
            for k in range(4):
                held = [t for t in instances if k in known.get(t, ())]
                sure = sum(t in seeds for t in held)
                fitting = sum(k in seeds[t] if t in seeds else forms[t] >> k & 1 for t in instances)
                if len(held) >= pii.SUPPORT and len(instances) >= pii.SUPPORT:
                    score = (sure + pii.FOUND * (len(held) - sure)) / (len(held) + len(instances) - fitting + pii.UNKNOWN * (fitting - len(held)))
                    if score >= pii.RELIABLE:
                        new |= {(t, k) for t in instances if t not in seeds and forms[t] >> k & 1}
        if all(k in known.get(t, ()) for t, k in new):
            break
        for t, k in new:
            known.setdefault(t, set()).add(k)
    out = []
    for base, found in near:
        added = {(k, x["start"], x["end"]) for x in found if x["kind"] < 0 for k in known.get(x["token"], ()) if x["form"] >> k & 1}
        added = {x for x in added if not any(y != x and y[0] == x[0] and y[1] <= x[1] and y[2] >= x[2] for y in added)}
        out.append(told(sorted({*base} | added)))
    return out


def test_the_registered_query_against_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = dict(zip([r.doc_id for r in docs], plain([r.text for r in docs]), strict=True))
    got = pii.op6_personal_data(spark, sf).collect()
    assert {r.doc_id: r.spans for r in got} == want
    for r in got:
        base = brute({d.doc_id: d.text for d in docs}[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(told(base).encode()).hexdigest() and r.n_phone == sum(k == 3 for k, _, _ in base)


def test_rounds_go_on_until_nothing_is_new(spark):
    """Each context is known only once the tokens of the one before are found: twelve rounds."""
    numbers = lambda i: [f"212.555.{1000 + 10 * i + j}" for j in range(3)]
    texts = [f"start here +1 (212) 555-{1000 + j} soon" for j in range(12)] + [f"start here {x} soon" for x in numbers(0)]
    for i in range(12):
        texts += [f"step w{chr(97 + i)} {x} ok{chr(97 + i)}" for x in numbers(i) + numbers(i + 1)]
    want = plain(texts)
    assert all(w for w in want)
    got = {r.doc_id: r.spans for r in pii.find_personal_data(table(spark, list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_contexts_add_unseen_identifiers_and_nothing_else(spark):
    phone = lambda i: f"+1 (212) 555-{1000 + i}"
    rows = [(i, f"word{i} please call {phone(i)} after {i} days") for i in range(12)]
    rows += [(100, "so please call 212.555.7777 after tea"), (101, "was 212.555.7777 there"), (102, "please call nobody after 1234567 days"), (103, "item 212.555.9999 sold")]
    rows += [(110, "please call 7755331 after lunch"), (111, "please call AB-123-456-xyz after lunch")]
    rows += [(200, "mail bob@example.com or 10.0.0.1 or 4111 1111 1111 1111"), *ODD]
    rows += [(300 + i, f"order no {7000000 + i} shipped") for i in range(50)]
    got = pii.find_personal_data(with_clashes(table(spark, rows)).repartition(3)).collect()
    assert len(got) == len(rows)
    texts = {}
    for d, t in rows:
        texts.setdefault(d, []).append(t)
    for r in got:
        assert r.base in [told(brute(t)) for t in texts[r.doc_id]]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] in [[sum(k == i for k, _, _ in brute(t)) for i in range(4)] for t in texts[r.doc_id]]
    spans = {r.doc_id: r.spans for r in got}
    text = dict(rows)[100]
    assert spans[100] == f"phone:{text.index('212')}:{text.index('212') + 12}"
    assert spans[101] == "phone:4:16" and spans[110] == "phone:12:19"
    assert not any(spans[d] for d in (102, 103, 111, *range(300, 350)))
    assert spans[200] == told(brute(dict(rows)[200]))
    assert pii.find_personal_data(table(spark, [])).collect() == []


def test_unseen_identifiers_of_each_kind_and_form(spark):
    unseen = {
        "email": ["jane.doe(at)example.org", "bob_at_example.com"],
        "ip": ["10-0-0-12"],
        "card": ["4111 1111 1111 1112"],
        "phone": ["0171 234 567", "(212) 555-7777"],
    }
    # the last digit makes the Luhn sum a multiple of 10
    cards = [f"411111111111{i:03d}" for i in range(12)]
    cards = [next(c + str(d) for d in range(10) if pii.luhn(c + str(d))) for c in cards]
    seen = {"email": lambda i: f"a{i}@example.org", "ip": lambda i: f"10.0.1.{i}", "card": lambda i: cards[i], "phone": lambda i: f"+1 212 555 {1000 + i}"}
    rows = [(100 * k + i, f"this {kind} entry {seen[kind](i)} noted") for k, kind in enumerate(pii.KINDS) for i in range(12)]
    want = {}
    for k, kind in enumerate(pii.KINDS):
        for i, x in enumerate(unseen[kind]):
            d = 1000 + 10 * k + i
            rows.append((d, f"this {kind} entry {x} noted"))
            want[d] = f"{kind}:{len(kind) + 12}:{len(kind) + 12 + len(x)}"
    got = {r.doc_id: r.spans for r in pii.find_personal_data(table(spark, rows)).collect()}
    assert {d: got[d] for d in want} == want


def test_half_of_a_context_unseen(spark):
    rows = [(i, f"please call +1 (212) 555-{1000 + i} today") for i in range(12)]
    rows += [(100 + i, f"please call 212.555.{2000 + i} today") for i in range(12)]
    # three phones among numbers of another kind tell nothing
    rows += [(200 + i, f"ticket no +1 (212) 555-{3000 + i} closed") for i in range(3)]
    rows += [(300 + i, f"ticket no 10.0.2.{i} closed") for i in range(12)] + [(400, "ticket no 212.555.9999 closed")]
    got = {r.doc_id: r.spans for r in pii.find_personal_data(table(spark, rows)).collect()}
    assert all(got[100 + i] == "phone:12:24" for i in range(12))
    assert got[400] == ""


def test_long_context_words_are_folded_like_short_ones():
    for n in (60, 70, 5000):
        one, other = (pii.patterns(f"to {w} 12345678 x", len(w) + 4, len(w) + 12) for w in ("Ab1" * n, "aB7" * n))
        assert one == other and max(map(len, one)) < 200
    assert pii.patterns("to " + "a" * 70 + " 1", 74, 75) != pii.patterns("to " + "a" * 69 + "b 1", 74, 75)
