"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes cuts each text, at white space, into chunks that copies of a passage share
wherever it stands. Sketches tell which chunks may occur more than once. Texts without such a chunk are
encoded where they are. Of the others, each distinct shared chunk is encoded once, its ids are joined
back, and the pieces are put together in order. Every cut was tried before: what stands at its two sides is
encoded together and apart, and where the ids differ, the chunks there are joined and encoded as one.

What has to stand there for agreement to settle the matter depends on the tokenizer. If its JSON says that
words between white space are encoded each by itself (`by_word`), only added tokens can reach over a cut, and
the words next to it tell. Of other tokenizers the whole chunks at both sides are compared.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from . import sketch
from .common import map_rows, raw_texts, written
from .words import _BYTES, BLOCK_BYTES, _spans

#: Mean and least bytes of a chunk, bytes that the rolling hash sees.
MEAN, LEAST, SEEN = 1024, 256, 16
#: Words whose ids a worker remembers, and the bytes of the longest.
MEMO, REMEMBERED = 400_000, 64
#: Bytes of text that are encoded together, and tokens that are decoded together.
STRETCH = 1 << 20
WANT = ("n_tokens", "ids_sha256", "decoded_sha256")
KINDS = {"n_tokens": "bigint", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
_ARROW = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


class Codec:
    """A tokenizer of the tokenizers library, from its JSON; truncation and padding off."""

    def __init__(self, source: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        told = json.loads(source)
        self.tokens = None if told.get("decoder") else [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        added = [x["content"].encode() for x in told.get("added_tokens") or ()]
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None
        self.spaced = [x for x in added if len(x.split()) > 1 or x.strip() != x]
        self.by_word, self.no_case = words_apart(told)
        self.memo: dict[bytes, bytes] = {}

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, raw: bytes) -> bytes:
        """The ids of a text, packed as numbers of self.kind."""
        if not self.by_word or self.added and self.added.search(raw):
            return np.array(self.ids(raw.decode()), self.kind).tobytes()
        if self.no_case:
            raw = re.sub(rb"(?<=[a-z0-9])([.,]+)(?=\s|$)", rb" \1", raw.lower())  # of bytes: A-Z alone
        words, memo = raw.split(), self.memo
        try:
            return b"".join([memo[w] for w in words])
        except KeyError:
            missing = list({w for w in words if w not in memo})
        if len(memo) + len(missing) > MEMO:
            memo.clear()
            missing = list(set(words))
        got = self.tokenizer.encode_batch_fast([w.decode() for w in missing], add_special_tokens=False)
        new = {w: np.array(e.ids, self.kind).tobytes() for w, e in zip(missing, got, strict=True)}
        out = b"".join([new[w] if w in new else memo[w] for w in words])
        memo.update([(w, e) for w, e in new.items() if len(w) <= REMEMBERED][: MEMO - len(memo)])
        return out

    def encode_all(self, parts: list[bytes]) -> bytes:
        """The ids of parts of a text whose cuts agree, some STRETCH bytes at a time."""
        out, held, size = [], [], 0
        for x in parts:
            held.append(x)
            size += len(x)
            if size >= STRETCH:
                out.append(self.encode(b"".join(held)))
                held, size = [], 0
        return b"".join([*out, self.encode(b"".join(held))]) if held else b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """As the library's decode(ids, skip_special_tokens=False); without a decoder it puts a space between tokens."""
        if self.tokens is None:
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        tokens = self.tokens
        return " ".join([" ".join([tokens[i] for i in ids[at : at + STRETCH].tolist()]) for at in range(0, len(ids), STRETCH)])

    def agreed(self, raw: bytes, at: list[int]) -> list[int]:
        """Those cuts of a text at which its ids are the same together and apart."""
        out = []
        for before, cut, after in zip([0, *at], at, [*at[1:], len(raw)], strict=False):
            if self.by_word:
                if any(raw.find(x, max(0, cut - len(x) + 1), cut + len(x)) >= 0 for x in self.spaced):
                    continue
                before = max(raw.rfind(b" ", before, cut), raw.rfind(b"\n", before, cut), before)
                gap = _GAP.search(raw, cut + 1, after)
                after = gap.start() if gap else after
            together = self.ids(raw[before:after].decode())
            if together == self.ids(raw[before:cut].decode()) + self.ids(raw[cut:after].decode()):
                out.append(cut)
        return out


_GAP = re.compile(rb"[ \n]")
#: A pattern that splits text into letters, single numbers and signs, and never takes white space.
_LETTERS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def words_apart(told: dict) -> tuple[bool, bool]:
    """What a tokenizer's JSON says: whether words between white space are encoded each by itself, and whether besides A-Z count as a-z and . and , at a word's end stand alone.

    Only what is known to keep words apart is taken: normalizers that work on single characters and their
    marks (NFC, Lowercase, white space to one space), a split that never takes white space, bytes as they
    are, no post-processing, and added tokens that are looked for in the text as it stands.
    """

    def steps(part: dict | None, inner: str) -> list[dict]:
        return [] if part is None else part[inner] if part["type"] == "Sequence" else [part]

    normal = steps(told.get("normalizer"), "normalizers")
    blank = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    local = all(x["type"] in ("NFC", "Lowercase") or x == blank for x in normal)
    cut = steps(told.get("pre_tokenizer"), "pretokenizers")
    raw_bytes = all(x["type"] == "ByteLevel" and not x.get("add_prefix_space") and x.get("use_regex") is False for x in cut[1:])
    letters = bool(cut) and cut[0] == {"type": "Split", "pattern": {"Regex": _LETTERS}, "behavior": "Removed", "invert": True}
    words = bool(cut) and cut[0] == {"type": "WhitespaceSplit"}
    plain = not told.get("post_processor") and told["model"].get("type") == "BPE" and not told["model"].get("dropout")
    as_is = not any(x.get("normalized") for x in told.get("added_tokens") or ())
    by_word = local and raw_bytes and (letters or words) and plain and as_is
    return by_word, by_word and letters and any(x["type"] == "Lowercase" for x in normal)


_CODECS: dict[str, Codec] = {}


def codec(source: str) -> Codec:
    """The Codec of a JSON text, made once in each worker."""
    if source not in _CODECS:
        _CODECS.clear()
        _CODECS[source] = Codec(source)
    return _CODECS[source]


def cuts(texts: list[bytes]) -> list[list[int]]:
    """Where each text is cut: at a space or line feed, the first after a place that the rolling hash picks."""
    out: list[list[int]] = []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK_BYTES):
            size += len(texts[end])
            end += 1
        block = texts[at:end]
        starts = np.concatenate(([0], np.cumsum([len(x) for x in block])))
        a = np.frombuffer(b"".join(block), np.uint8)
        picked = [np.zeros(0, np.int64)]
        for first in range(0, max(0, len(a) - SEEN + 1), BLOCK_BYTES):
            part = a[first : first + BLOCK_BYTES + SEEN - 1]
            i = np.arange(len(part) - SEEN + 1)
            h = _spans(part, _BYTES, i, i + SEEN, 1)
            picked.append(np.flatnonzero(sketch.mix(h) < np.uint64((1 << 64) // MEAN)) + SEEN + first)
        picked = np.concatenate(picked)
        gaps = np.flatnonzero((a == 32) | (a == 10))
        for k in range(len(block)):
            first, last = starts[k], starts[k + 1]
            own = picked[np.searchsorted(picked, first + LEAST) : np.searchsorted(picked, last)]
            found, before = [], int(first)
            for g in gaps[np.minimum(np.searchsorted(gaps, own), len(gaps) - 1)].tolist() if len(gaps) else ():
                if g - before >= LEAST and g < last:
                    found.append(g - int(first))
                    before = g
            out.append(found)
        at = end
    return out


def chunks(raw: bytes, at: list[int]) -> list[bytes]:
    return [raw[a:b] for a, b in zip([0, *at], [*at, len(raw)], strict=True)]


def _columns(c: Codec, packed: list[bytes], want: tuple[str, ...]) -> list[pa.Array]:
    rows = []
    for p in packed:
        ids = np.frombuffer(p, c.kind)
        row: dict = {"n_tokens": len(ids)}
        if "ids" in want:
            row["ids"] = ids.astype(np.int32)
        if "ids_sha256" in want:
            row["ids_sha256"] = sha256(ids.astype("<u4").tobytes()).hexdigest()
        if "decoded" in want or "decoded_sha256" in want:
            text = c.decode(ids)
            if "decoded" in want:
                row["decoded"] = text
            if "decoded_sha256" in want:
                row["decoded_sha256"] = sha256(text.encode()).hexdigest()
        rows.append(row)
    return [pa.array([r[w] for r in rows], _ARROW[w]) for w in want]


def encode(docs: DataFrame, tokenizer: str, want: tuple[str, ...] = WANT, most_cells: int = sketch.MAX_CELLS) -> DataFrame:
    """Encode every text of docs (doc_id, text; more columns are ignored) with a tokenizer's JSON file, and decode it.

    Null texts are empty and have no ids. Rows that repeat a doc_id are rows like others. An empty table
    gives no rows. Texts of any length are encoded in stretches; one single word is not cut. tokenizer is a path on the driver, read once. One row per row: doc_id and the columns
    of KINDS that want names. most_cells: a sketch of chunks that needs more cells stays distributed instead of going to every task. The ids are those of the library for the whole text, without special tokens
    added; their strings in a text are special, as in the library.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        source = spark.sparkContext.broadcast(f.read())
    docs = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.xxhash64("text").alias("t"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    cells = sketch.cells_for(size // MEAN + 1)

    def digests(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        texts = list(raw_texts(batch["text"]))
        got = [[xxh3_128_digest(c) for c in chunks(raw, at)] for raw, at in zip(texts, cuts(texts), strict=True)]
        yield np.frombuffer(b"".join(x for some in got for x in some), np.uint64)[::2].copy(), np.repeat(np.arange(len(got)), [len(x) for x in got])

    if cells <= most_cells:
        repeated = sketch.repeated_items(docs.select("text"), lambda batch: (x for x, _ in digests(batch)), cells)
        searched = docs.select("doc_id", "text", F.lit(None).cast("array<bigint>").alias("known"))
    else:
        repeated = None
        searched = docs.join(sketch.known_items(docs, digests, cells), ["d", "t"], "left").select("doc_id", "text", "known")

    def make():
        c, task, sent = codec(source.value), TaskContext.get().partitionId() << 40, set()
        count = 0

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            nonlocal count
            texts = list(raw_texts(batch["text"]))
            maybe = sketch.among(batch["known"]) if repeated is None else repeated.value.maybe
            whole_id, whole, rows = [], [], []
            for doc_id, raw, at in zip(batch["doc_id"].to_pylist(), texts, cuts(texts), strict=True):
                parts = chunks(raw, c.agreed(raw, at))  # what does not agree is joined, and encoded as one
                keys = [xxh3_128_digest(x) for x in parts]
                shared = maybe(np.frombuffer(b"".join(keys), np.uint64)[::2])
                count += 1
                if not shared.any():
                    whole_id.append(doc_id)
                    whole.append(c.encode_all(parts))
                    continue
                run: list[bytes] = []
                for i, (part, key, s) in enumerate(zip(parts, keys, shared, strict=True)):
                    if not s:
                        run.append(part)
                        if i + 1 < len(parts) and not shared[i + 1]:
                            continue
                        rows.append((doc_id, task + count, i, None, None, c.encode_all(run)))
                        run = []
                    else:
                        rows.append((doc_id, task + count, i, key, None if key in sent else part, None))
                        sent.add(key)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            n = len(whole)
            done = _columns(c, whole, want)
            left = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            pieces = [pa.concat_arrays([pa.array(whole_id, pa.int64()), left[0]]), *(pa.concat_arrays([pa.nulls(n, x.type), x]) for x in left[1:])]
            results = [pa.concat_arrays([x, pa.nulls(len(rows), x.type)]) for x in done]
            yield pa.record_batch([*pieces, *results], names=["doc_id", "row", "at", "key", "chunk", "packed", *want])

        return work

    ends = ", ".join(f"{w} {KINDS[w]}" for w in want)
    parts = written(map_rows(searched, make, f"doc_id bigint, row bigint, at int, key binary, chunk binary, packed binary, {ends}"), "bpe")
    finished = parts.filter("row is null").select("doc_id", *want)
    once = parts.filter("chunk is not null").select("key", "chunk").dropDuplicates(["key"])

    def encoded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c = codec(source.value)
        yield pa.record_batch([batch["key"], pa.array([c.encode(x.as_py()) for x in batch["chunk"]], pa.binary())], names=["key", "packed"])

    ids = map_rows(once, lambda: encoded, "key binary, packed binary")
    refs = parts.filter("key is not null").select("doc_id", "row", "at", "key").join(ids, "key").select("doc_id", "row", "at", "packed")
    runs = parts.filter("packed is not null").select("doc_id", "row", "at", "packed")
    pieces = refs.unionByName(runs).groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.collect_list("at").alias("at"), F.collect_list("packed").alias("packed"))

    def assembled(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c = codec(source.value)
        packed = [b"".join(p for _, p in sorted(zip(at, got, strict=True))) for at, got in zip(batch["at"].to_pylist(), batch["packed"].to_pylist(), strict=True)]
        yield pa.record_batch([batch["doc_id"], *_columns(c, packed, want)], names=["doc_id", *want])

    return finished.unionByName(map_rows(pieces.select("doc_id", "at", "packed"), lambda: assembled, f"doc_id bigint, {ends}"))


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_file())
