"""Personal data: seed patterns, and identifiers that bootstrapping over their contexts adds.

Base patterns find e-mail and IP addresses, card and phone numbers. These seed entities induce lexical
patterns (the two words before, or the words on both sides), and together with other identifier-like tokens
they make a graph of patterns and instances. Spark scores it in rounds until nothing new is found: a pattern by
what is known of its instances, an instance by the patterns that vouch for it. Tokens that a high-confidence
pattern of a kind vouches for, and that could be of that kind by their form, are found wherever they stand.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_hexdigest

from .common import map_rows, raw_texts, written

KINDS = ["email", "ip", "card", "phone"]
#: A pattern needs so many distinct known instances of a kind, and so high a score.
SUPPORT, RELIABLE = 3, 0.8
#: What a found instance weighs for a pattern, where a seed weighs 1; and what an unknown instance of a kind's form
#: weighs against it, where one of another form or kind weighs 1.
FOUND, UNKNOWN = 0.9, 0.1
#: Code points of a context's word that are written out; of a longer one the first ones and a hash of all.
WRITTEN = 64

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9]+")
_GAP = re.compile(r"[ \t-\r]")
_STARTS = re.compile(r"[0-9]+|\(at\)|\[at\]|_at_")
_SPACED = re.compile(r"[0-9+(][0-9().+/-]*(?: [0-9(][0-9().+/-]*)*")
_BLANK = frozenset(" \t\n\x0b\x0c\r")
_EDGE = ".,;:!?\"'()[]{}<>|"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from each @ in time linear in the text."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Matches of [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+) whose parts are at most 255: each four parts of a dotted number."""
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield at, end
            at = end + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 13 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), kind as an index of KINDS, in that order and then by start."""
    found = [(0, *s) for s in emails(text)] if "@" in text else []
    if _NUMBER.search(text):
        found += [(1, *s) for s in ips(text)]
        found += [(2, *s) for s in cards(text)]
        if "+" in text:
            found += [(3, *s) for s in phones(text)]
    return found


def tokens(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Tokens with digits or an at-mark, and runs of numbers with single blanks between, without punctuation at their ends, that touch none of the taken spans, which are in order.

    Tokens are what stands between white space, whole, however long.
    """
    k = 0
    for m in _SPACED.finditer(text):
        a, b = m.span()
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        # a bracket stays that is closed inside
        closed = text.rfind(")", a, b)
        while a < b and text[a] in _EDGE and closed < a:
            a += 1
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if (k == len(taken) or taken[k][0] >= b) and text.find(" ", a, b) >= 0 and (a == 0 or text[a - 1] in _BLANK or text[a - 1] in _EDGE):
            yield a, b
    k = last = 0
    for m in _STARTS.finditer(text):
        if m.start() < last:
            continue
        a, b = m.span()
        while a > last and text[a - 1] not in _BLANK:
            a -= 1
        end = _GAP.search(text, b)
        last = b = end.start() if end else len(text)
        while a < b and text[a] in _EDGE:
            a += 1
        while a < b and text[b - 1] in _EDGE:
            b -= 1
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if (k == len(taken) or taken[k][0] >= b) and a < b:
            yield a, b


def _near(text: str, at: int, to: int, n: int) -> list[str]:
    """Up to n whole words of text next to `at`, towards `to` (before or after it), nearest first; no more text is read than they need."""
    reach, step = 80, -1 if to < at else 1
    while True:
        far = max(to, at - reach) if step < 0 else min(to, at + reach)
        found = (text[far:at] if step < 0 else text[at:far]).split()
        # the farthest word may be cut
        if far == to or len(found) > n:
            return found[::-1][:n] if step < 0 else found[:n]
        reach *= 4


def patterns(text: str, start: int, end: int, floor: int = 0, ceiling: int | None = None) -> list[str]:
    """The lexical patterns around a span: two words before it, and one on each side, in lower case; digits become 0.

    Contexts end at floor and ceiling, where the neighbouring base spans are: @ stands for one, ^ and $ for
    the ends of the text.
    """
    ceiling = len(text) if ceiling is None else ceiling
    before = [*_near(text, start, floor, 2), *["@" if floor else "^"] * 2][:2]
    after = [*_near(text, end, ceiling, 1), "@" if ceiling < len(text) else "$"][0]
    folded = (_NUMBER.sub("0", w.lower()) for w in (before[1], before[0], after))
    one, two, after = (w if len(w) <= WRITTEN else f"{w[:16]}#{xxh64_hexdigest(w)}" for w in folded)
    return [f"{one} {two} _", f"{two} _ {after}"]


def candidates(text: str) -> tuple[list[tuple[int, int, int]], list[dict]]:
    """The base spans of a text, and these and other candidates with their kind (-1 if unknown), form and patterns."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    starts, ends = sorted(a for a, _ in taken), sorted(b for _, b in taken)

    def told(kind: int, form: int, a: int, b: int) -> dict:
        i, j = bisect_right(ends, a), bisect_left(starts, b)
        around = patterns(text, a, b, ends[i - 1] if i else 0, starts[j] if j < len(starts) else None)
        return {"kind": kind, "form": form, "start": a, "end": b, "token": text[a:b].lower(), "patterns": around}

    near = [told(k, 0, a, b) for k, a, b in base]
    return base, near + [told(-1, f, a, b) for a, b in tokens(text, taken) if (f := could_be(text[a:b]))]


def could_be(token: str) -> int:
    """Bits of the kinds a token may be by its form."""
    n = sum(ch.isdigit() for ch in token)
    plain = all(ch.isdigit() or ch in "+-.()/ " for ch in token)
    return (1 if re.fullmatch(r"[A-Za-z0-9._%+-]+(?:\(at\)|\[at\]|_at_)[A-Za-z0-9.\[\]()-]+", token) else 0) | (2 if re.fullmatch(r"[0-9]{1,3}(?:[.:-][0-9]{1,3}){3}(?::[0-9]+)?", token) else 0) | (4 if plain and 13 <= n <= 19 else 0) | (8 if plain and 7 <= n <= 15 else 0)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Personal data in docs (doc_id, text; more columns are ignored).

    One row per row: doc_id, n_email, n_ip, n_card, n_phone (base spans), base and spans: strings of
    kind:start:end in code points, end exclusive, joined by commas, by kind as in KINDS and then by start.
    base has the matches of the base patterns; spans has these and what the contexts add. Null and empty
    texts have none. Rows that repeat a doc_id are rows like others. An empty table gives no rows.
    """

    def make():
        task, count = TaskContext.get().partitionId() << 40, 0

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            nonlocal count
            rows = []
            for raw in raw_texts(batch["text"]):
                text = raw.decode()
                base, near = candidates(text)
                count += 1
                rows.append((task + count, [{"kind": k, "start": a, "end": b} for k, a, b in base], near))
            kinds = (pa.int64(), _SPANS, _NEAR)
            yield pa.record_batch([batch["doc_id"], *(pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", "row", "base", "near"])

        return work

    span = "kind: int, start: int, end: int"
    seen = written(map_rows(docs.select("doc_id", "text"), make, f"doc_id bigint, row bigint, base array<struct<{span}>>, near array<struct<kind: int, form: int, start: int, end: int, token: string, patterns: array<string>>>"), "personal")
    near = seen.select("row", F.explode("near").alias("x")).select("row", "x.*")
    added = near.filter("kind < 0").join(discovered(near), "token").filter("(form & shiftleft(1, found)) <> 0")
    added = added.groupBy("row").agg(F.collect_set(F.struct(F.col("found").alias("kind"), "start", "end")).alias("added"))
    # of a run of numbers and a token in it, both of one kind, the run is told
    added = added.withColumn("added", F.expr("filter(added, x -> not exists(added, y -> y.kind = x.kind and y.start <= x.start and y.end >= x.end and y <> x))"))
    all_of = seen.select("doc_id", "row", "base").join(added, "row", "left")
    names = F.array(*map(F.lit, KINDS))

    def told(spans):
        return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")

    counts = [F.size(F.filter("base", _is_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    nothing = F.array().cast(f"array<struct<{span}>>")
    return all_of.select("doc_id", *counts, told(F.col("base")).alias("base"), told(F.concat("base", F.coalesce("added", nothing))).alias("spans"))


def _is_kind(i: int):
    return lambda s: s["kind"] == i


_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
_NEAR = pa.list_(pa.struct([("kind", pa.int32()), ("form", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("token", pa.string()), ("patterns", pa.list_(pa.string()))]))


def discovered(near: DataFrame) -> DataFrame:
    """(token, found): tokens that the pattern-instance graph of near (kind, form, token, patterns) takes for a kind.

    What was found stays found, so each round adds tokens or is the last.
    """
    edges = written(near.select(F.explode("patterns").alias("pattern"), "token", "kind", "form").distinct(), "graph")
    links = edges.select("pattern", "token").distinct()
    bit = F.when(F.col("kind") >= 0, F.expr("shiftleft(1, kind)")).otherwise(0)
    may_be = edges.groupBy("token").agg(F.bit_or(bit).alias("seed"), F.bit_or("form").alias("form"))
    may_be = may_be.select("token", F.when(F.col("seed") != 0, F.col("seed")).otherwise(F.col("form")).alias("fits"), "seed", "form")
    able = [F.count_if(F.col("fits").bitwiseAND(1 << i) != 0) for i in range(len(KINDS))]
    of_pattern = links.join(may_be, "token").groupBy("pattern").agg(F.count("*").alias("instances"), F.array(*able).alias("able"))
    of_pattern = written(of_pattern.filter(F.col("instances") >= SUPPORT), "patterns")
    seeds = edges.filter("kind >= 0").select("token", F.col("kind").alias("found"), F.lit(True).alias("sure")).distinct()
    # what can still be found: no seeds, and of a form
    open_ones = written(links.join(may_be.filter("seed = 0 and form <> 0").select("token", "form"), "token"), "open")
    found, n = None, 0
    while True:
        known = seeds if found is None else seeds.unionByName(found.withColumn("sure", F.lit(False)))
        held = links.join(known, "token").groupBy("pattern", "found").agg(F.count_if("sure").alias("sure"), F.count("*").alias("held"))
        fitting = F.element_at("able", F.col("found") + 1)
        score = (F.col("sure") + FOUND * (F.col("held") - F.col("sure"))) / (F.col("held") + F.col("instances") - fitting + UNKNOWN * (fitting - F.col("held")))
        good = held.filter(F.col("held") >= SUPPORT).join(of_pattern, "pattern").filter(score >= RELIABLE).select("pattern", "found")
        new = open_ones.join(good, "pattern").filter("(form & shiftleft(1, found)) <> 0").select("token", "found")
        found = written((new if found is None else new.unionByName(found)).distinct(), "found")
        before, n = n, found.count()
        if n == before:
            return found


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")
