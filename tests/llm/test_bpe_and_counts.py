import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ratiolake.llm import bpe, token_counts
from ratiolake.llm.common import scratch

from .cases import ODD, table, with_clashes, words

PATH = bpe.tokenizer_file()


def library(path, texts):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    out = []
    for x in texts:
        ids = t.encode(x or "", add_special_tokens=False).ids
        out.append((ids, t.decode(ids, skip_special_tokens=False)))
    return out


def shared_rows():
    random.seed(6)
    word = lambda: random.choice(["the", "The,", "it's", "x_y", "naïve", "Ünder.", "12.5", "(a)", "“q”", "é", "a b", "<|endoftext|>", "<|ENDOFTEXT|>", "don't!", "日本語", "İ", "ΟΔΟΣ.", "a.,b", "'ll"])
    passage = " ".join(word() + str(i % 7) for i in range(1500))
    rows = list(ODD)
    for i in range(12):
        own = " ".join(word() for _ in range(random.randint(0, 400)))
        rows.append((100 + i, own + ("\n" if i % 2 else " ") + (passage if i % 3 else passage[: 3000 + i]) + " " + own[::2]))
    return [*rows, (200, rows[-1][1]), (201, "  lead"), (202, "trail \n"), (203, "x" * 5000 + " " + "y" * 5000)]


def test_ids_and_texts_are_the_library_s(spark):
    for path in (PATH, public_tokenizers.path("byte_bpe_50k.json")):
        rows = shared_rows()
        want = sorted(((d, len(ids), ids, text) for (d, _), (ids, text) in zip(rows, library(path, [t for _, t in rows]), strict=True)), key=repr)
        for most_cells in (1 << 30, 0):  # a sketch that goes to all tasks, and one that stays distributed
            got = bpe.encode(with_clashes(table(spark, rows)).repartition(3), path, ("n_tokens", "ids", "decoded"), most_cells).collect()
            assert sorted((tuple(r) for r in got), key=repr) == want
    assert bpe.encode(table(spark, []), PATH).collect() == []


def made(tmp_path, name, **parts):
    """A small tokenizer of words with an end mark, and whether words apart by white space are told from its JSON."""
    pieces = [*"abcdehtx.,", *(x + "</w>" for x in "abcdehtx.,"), "th", "the</w>", "[UNK]"]
    told = {
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "decoder": None,
        "model": {"type": "BPE", "dropout": None, "unk_token": "[UNK]", "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": {x: i for i, x in enumerate(pieces)}, "merges": [["t", "h"], ["th", "e</w>"]]},
    }
    told |= parts
    path = tmp_path / f"{name}.json"
    path.write_text(json.dumps(told))
    return str(path), bpe.words_apart(told)


def test_shortcuts_are_taken_from_the_tokenizer_s_json(spark, tmp_path):
    added = lambda content, normalized: [{"id": 23, "content": content, "single_word": False, "lstrip": False, "rstrip": False, "normalized": normalized, "special": False}]
    letters = {"type": "Split", "pattern": {"Regex": bpe._LETTERS}, "behavior": "Removed", "invert": True}
    kinds = {
        "words": (dict(normalizer={"type": "Lowercase"}), (True, False)),
        "letters": (dict(normalizer={"type": "Lowercase"}, pre_tokenizer=letters), (True, True)),
        "case": (dict(pre_tokenizer=letters), (True, False)),
        "spaced": (dict(added_tokens=added("a b c", False)), (True, False)),
        "normalized": (dict(added_tokens=added("the cat", True), normalizer={"type": "Lowercase"}), (False, False)),
        "none": (dict(pre_tokenizer=None), (False, False)),
        "strip": (dict(normalizer={"type": "Strip", "strip_left": True, "strip_right": True}), (False, False)),
        "other": (dict(pre_tokenizer={"type": "Split", "pattern": {"Regex": "the cat"}, "behavior": "Isolated", "invert": False}), (False, False)),
    }
    random.seed(16)
    part = lambda: random.choice(["The", "the cat.", "a b c", "cat.,", "a", "b", "x", "THE CAT", "c.", ",", "e" * 70])
    passage = " ".join(part() for _ in range(900))
    rows = [(i, " ".join(part() for _ in range(i * 20)) + random.choice([" ", "\n", "  "]) + passage[i:] * (i % 3)) for i in range(12)] + [(50, None), (51, " ")]
    for name, (parts, want) in kinds.items():
        path, told = made(tmp_path, name, **parts)
        assert told == want, name
        ids = sorted(((d, ids, text) for (d, _), (ids, text) in zip(rows, library(path, [t for _, t in rows]), strict=True)), key=repr)
        got = bpe.encode(table(spark, rows).repartition(2), path, want=("ids", "decoded")).collect()
        assert sorted((tuple(r) for r in got), key=repr) == ids, name


def test_stretches(monkeypatch):
    with open(PATH, encoding="utf-8") as f:
        c = bpe.Codec(f.read())
    text = "".join(t or "" for _, t in shared_rows()[10:])
    want = c.ids(text)
    raw = text.encode()
    parts = bpe.chunks(raw, c.agreed(raw, bpe.cuts([raw])[0]))
    assert len(parts) > 20
    monkeypatch.setattr(bpe, "STRETCH", 3000)
    assert np.frombuffer(c.encode_all(parts), c.kind).tolist() == want
    assert c.decode(np.array(want)) == c.tokenizer.decode(want, skip_special_tokens=False)
    monkeypatch.setattr(bpe, "MEMO", 40)
    assert np.frombuffer(c.encode_all(parts), c.kind).tolist() == want
    whole = bpe.cuts([raw])
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 777)
    assert bpe.cuts([raw]) == whole


def test_digests(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = bpe.op2_bpe(spark, sf).collect()
    for r, (ids, text) in zip(got, library(PATH, [texts[r.doc_id] for r in got]), strict=True):
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_cuts_follow_the_content():
    random.seed(7)
    body = " ".join("".join(random.choice("abcdefgh") for _ in range(6)) for _ in range(3000)).encode()
    one, two = bpe.cuts([body, b"a different start " + body])
    shared = {c for c in bpe.chunks(body, one)} & {c for c in bpe.chunks(b"a different start " + body, two)}
    assert len(one) > 5 and len(shared) >= len(one) - 2
    assert b"".join(bpe.chunks(body, one)) == body


def test_ledger(spark):
    rows = "doc_id bigint, source string, lang string, text string, op string, batch string, docs bigint"
    make = lambda *x: spark.createDataFrame([(*r, "b", 9) for r in x], rows)
    ledger = token_counts.Ledger(spark, scratch(spark, "test-ledger"))
    both = {token_counts.WORDS: "", "bpe": PATH}
    assert ledger.totals().collect() == []
    first = make((1, "a", "en", "one two", "insert"), (2, "a", "en", None, None), (3, "b", None, "x", "insert"), (4, None, "en", "y z w", "insert"), (4, None, "en", "again", "insert"), (None, "a", "en", "w", "insert"))
    assert ledger.commit("1", first, both) and not ledger.commit("1", first, both)

    def words_now():
        return {(r.source, r.lang): (r.docs, r.tokens) for r in ledger.totals().filter(f"version = '{token_counts.WORDS}'").collect()}

    assert words_now() == {("a", "en"): (3, 3), ("b", None): (1, 1), (None, "en"): (2, 4)}
    assert ledger.commit("2", make((1, "a", "en", None, "delete"), (4, "c", "de", "p q", "revise"), (9, "z", "z", None, "delete"), (None, None, None, None, "delete")), both)
    assert words_now() == {("a", "en"): (1, 0), ("b", None): (1, 1), ("c", "de"): (1, 2)}
    assert ledger.commit("3", make().limit(0), both)
    # what a driver that was lost before the mark left behind counts for nothing, and the next try overwrites it
    left = spark.createDataFrame([(3, "b", "xx", token_counts.WORDS, 5, 500)], token_counts.CHANGES)
    left.write.parquet(f"{ledger.path}/changes/batch=4/bucket=3")
    left.drop("doc_id").write.parquet(f"{ledger.path}/totals/batch=4")
    assert words_now() == {("a", "en"): (1, 0), ("b", None): (1, 1), ("c", "de"): (1, 2)}
    assert ledger.commit("4", make((3, "b", "fr", "one two three", "revise")), both)
    assert words_now() == {("a", "en"): (1, 0), ("b", "fr"): (1, 3), ("c", "de"): (1, 2)}


def test_what_a_ledger_refuses(spark):
    rows = "doc_id bigint, source string, lang string, text string, op string"
    make = lambda *x: spark.createDataFrame(list(x), rows)
    ledger = token_counts.Ledger(spark, scratch(spark, "test-ledger"))
    count = {token_counts.WORDS: ""}
    one = make((1, "a", "en", "x y", None), (2, "a", "en", "x", "insert"))
    for op in ("DELETE", "upsert", ""):
        with pytest.raises(ValueError, match="unknown operations"):
            ledger.commit("1", make((1, "a", "en", "x y", op)), count)
    for name in ("a/b", "", "..", "_x", "a b", "x=1"):
        with pytest.raises(ValueError, match="name of a batch"):
            ledger.commit(name, one, count)
    assert ledger.commit("1", one, count) and not ledger.commit("1", one.orderBy("doc_id", ascending=False), count)
    with pytest.raises(ValueError, match="other changes"):
        ledger.commit("1", make((1, "a", "en", "x z", None), (2, "a", "en", "x", "insert")), count)
    lock, fs = ledger._file(f"{ledger.path}/lock")
    assert fs.createNewFile(lock)
    with pytest.raises(RuntimeError):
        ledger.commit("2", make((1, None, None, None, "delete")), count)
    fs.delete(lock, False)
    assert ledger.commit("2", make((1, None, None, None, "delete")), count)
    assert [tuple(r) for r in ledger.totals().collect()] == [("a", "en", token_counts.WORDS, 1, 1)]


def test_counts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {}
    for r, (ids, _) in zip(docs, library(PATH, [r.text for r in docs]), strict=True):
        for v, n in ((token_counts.WORDS, len(words(r.text))), ("word_bpe_49k-1", len(ids))):
            k = (r.source, r.lang, v)
            want[k] = (want.get(k, (0, 0))[0] + 1, want.get(k, (0, 0))[1] + n)
    assert {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in token_counts.op4_token_counts(spark, sf).collect()} == want
