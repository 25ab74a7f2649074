"""PDF files as tables of objects, and what documents hold as joins over them.

One pass over the bytes gives a row for each object with its dictionary as JSON; references are
{"ref": number}, names begin with /. All else is relational and lies in `pdf_reports`, so a file with a million
objects spreads over tasks like any other rows. Encrypted files have one error row; an object that can't be read has
its own, and reading goes on at the next.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator, Sequence
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from ratiolake.sources.pdf_filters import decoded

OBJECTS = "path string, obj bigint, gen bigint, dict string, stream_start bigint, stream_length bigint, refs array<bigint>, error string"
_TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|\[|\]|/[^\s()<>\[\]{}/%]*|\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|(\d+)\s+(\d+)\s+R\b|[^\s()<>\[\]{}/%]+", re.S)
_OBJECT = re.compile(rb"(?<!\d)(\d{1,10})\s+(\d{1,5})\s+obj\b")
_STREAM = re.compile(rb"\s*stream\r?\n")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _bytes(raw: bytes) -> bytes:
    """The bytes of a string as it stands, in brackets or in hexadecimal."""
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    octal = lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], b"" if m[1] in b"\r\n" else m[1])
    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", octal, raw[1:-1], flags=re.S)


def string_bytes(operands: bytes) -> bytes:
    """The bytes of all strings among operands, one after the other."""
    return b"".join(_bytes(m[0]) for m in _TOKEN.finditer(operands) if m[0][:1] == b"(" or m[0][:1] == b"<" and m[0] != b"<<")


def _string(raw: bytes) -> str:
    data = _bytes(raw)
    return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("latin-1")


def parse(text: bytes, at: int, refs: list[int]):
    """The value at a place, and where it ends. Nesting is kept on a list, so deep files need no deep stack."""
    stack: list = []
    for m in _TOKEN.finditer(text, at):
        t = m[0]
        if t[:1] == b"%":
            continue
        if t == b"endobj":
            raise ValueError("object ends inside a value")
        if t in (b"<<", b"["):
            stack.append([t])
            continue
        if t in (b">>", b"]"):
            if not stack:
                raise ValueError("unbalanced dictionary")
            head, *items = stack.pop()
            value = items if head == b"[" else {str(k)[1:]: v for k, v in zip(items[::2], items[1::2], strict=False)}
        elif m[1]:
            refs.append(int(m[1]))
            value = {"ref": int(m[1])}
        elif t[:1] in (b"(", b"<"):
            value = _string(t)
        elif t[:1] == b"/":
            value = re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), t).decode("latin-1")
        elif t in (b"true", b"false", b"null"):
            value = {b"true": True, b"false": False, b"null": None}[t]
        elif re.fullmatch(rb"[+-]?(\d+\.?\d*|\.\d+)", t):
            value = float(t) if b"." in t else int(t)
        else:
            value = t.decode("latin-1")
        if not stack:
            return value, m.end()
        stack[-1].append(value)
    raise ValueError("unexpected end of file")


class Found(NamedTuple):
    """An object of a file: its value, references, own bytes, and where its stream is; or why it can't be read."""

    obj: int
    gen: int
    value: Any = None
    refs: Sequence[int] = ()
    body: bytes = b""
    start: int | None = None
    length: int | None = None
    error: str | None = None


def objects_in(data: bytes) -> list[Found]:
    """The objects of a file; its trailer is object 0. Of objects that repeat a number, the last."""
    found: dict[int, Found] = {}
    trailer: dict = {}
    at, gaps = 0, []
    while m := _OBJECT.search(data, at):
        gaps.append((at, m.start()))
        number, gen = int(m[1]), int(m[2])
        try:
            refs: list[int] = []
            value, at = parse(data, m.end(), refs)
            body = data[m.end() : at].strip()
            start = length = None
            if isinstance(value, dict) and (s := _STREAM.match(data, at)):
                start, length = s.end(), _length(data, s.end(), value.get("Length"))
                at = start + length
                if value.get("Type") == "/XRef":
                    trailer |= value
                if value.get("Type") == "/ObjStm":
                    found |= {x.obj: x for x in _packed(value, data[start : start + length])}
            found[number] = Found(number, gen, value, refs, body, start, length)
        except (ValueError, KeyError, TypeError, IndexError, zlib.error) as e:
            found[number] = Found(number, gen, error=str(e) or type(e).__name__)
            at = m.end()
    for a, b in [*gaps, (at, len(data))]:  # outside of objects
        for m in re.compile(rb"trailer\s*(?=<<)").finditer(data, a, b):
            trailer |= parse(data, m.end(), [])[0]
    if "Encrypt" in trailer:
        raise ValueError("encrypted")
    told = {k: v for k, v in trailer.items() if k in ("Root", "Info", "ID", "Size")}
    found[0] = Found(0, 65535, told, [v["ref"] for v in told.values() if isinstance(v, dict) and "ref" in v])
    return list(found.values())


def _length(data: bytes, start: int, declared: Any) -> int:
    """The length of the stream that starts there: as declared if `endstream` follows, else up to it."""
    if isinstance(declared, int) and declared >= 0 and data[start + declared : start + declared + 20].lstrip().startswith(b"endstream"):
        return declared
    return max(0, data.find(b"endstream", start) - start)


def _packed(value: dict, body: bytes) -> Iterator[Found]:
    """The objects that a stream of objects holds."""
    inner = decoded(body, value.get("Filter"), value.get("DecodeParms"))
    numbers = [int(x) for x in inner[: value["First"]].split()]
    for n, offset in zip(numbers[::2], numbers[1::2], strict=True):
        refs: list[int] = []
        at = value["First"] + offset
        one, end = parse(inner, at, refs)
        yield Found(n, 0, one, refs, inner[at:end].strip())


def objects(files: DataFrame) -> DataFrame:
    """A row for each object of files (path, content), with the columns of OBJECTS; dict is JSON of any value."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string()]
        names = [c.rsplit(" ", 1)[0].split()[0] for c in OBJECTS.split(", ")]
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                try:
                    rows = [(path, x.obj, x.gen, None if x.error else json.dumps(x.value), x.start, x.length, sorted(set(x.refs)), x.error) for x in objects_in(content.as_py() or b"")]
                except (ValueError, KeyError, TypeError, IndexError, zlib.error) as e:
                    rows = [(path, *[None] * 6, str(e) or type(e).__name__)]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.select("path", "content").mapInArrow(read, OBJECTS)


BODIES = "path string, obj bigint, body binary, stream binary"


def bodies(files: DataFrame) -> DataFrame:
    """The bytes of each object of files (path, content) that can be read, but the trailer's: its value, and its stream as stored. Files that can't be read have no rows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                data = content.as_py() or b""
                try:
                    rows = [(path, x.obj, x.body, None if x.start is None else data[x.start : x.start + x.length]) for x in objects_in(data) if x.obj and not x.error]
                except (ValueError, KeyError, TypeError, IndexError, zlib.error):
                    rows = []
                columns = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["path", "obj", "body", "stream"])

    return files.select("path", "content").mapInArrow(read, BODIES)


def references(body: bytes) -> list[int]:
    """The objects that a value refers to."""
    return sorted({int(m[1]) for m in _TOKEN.finditer(body) if m[1]})


def renumbered(body: bytes, new: dict[int, int]) -> bytes:
    """A value whose references have new numbers; those to objects without one become null."""
    return _TOKEN.sub(lambda m: m[0] if not m[1] else b"%d 0 R" % new[int(m[1])] if int(m[1]) in new else b"null", body)


def edited(body: bytes, drop: Iterable[str], add: dict[str, str]) -> bytes:
    """A dictionary without the keys of drop, and then with those of add that it lacks; other values stay as they are."""
    spans, depth, key, begin = [], 0, None, 0
    for m in _TOKEN.finditer(body):
        t = m[0]
        if t[:1] == b"%":
            continue
        if t in (b">>", b"]"):
            depth -= 1
        if depth == 1 and key is None and t[:1] == b"/":
            key, begin = t[1:].decode("latin-1"), m.start()
        elif depth == 1 and key is not None and t not in (b"<<", b"["):
            spans.append((key, begin, m.end()))
            key = None
        if t in (b"<<", b"["):
            depth += 1
        if depth == 0:
            break
    if not body.startswith(b"<<"):
        return body
    drop = set(drop)
    kept = [(k, body[a:b]) for k, a, b in spans if k not in drop]
    has = {k for k, _ in kept}
    more = [b"/%s %s" % (k.encode("latin-1"), v.encode("latin-1")) for k, v in add.items() if k not in has]
    return b"<< " + b" ".join([*(x for _, x in kept), *more]) + b" >>"


def written_as(value: Any) -> str:
    """A value as PDF text, from what `parse` gives for it: text that begins with / is a name."""
    if isinstance(value, dict):
        return f"{value['ref']} 0 R" if set(value) == {"ref"} and isinstance(value["ref"], int) else "<< " + " ".join(f"/{k} {written_as(v)}" for k, v in value.items()) + " >>"
    if isinstance(value, list):
        return "[" + " ".join(map(written_as, value)) + "]"
    if isinstance(value, str) and value.startswith("/"):
        return "/" + re.sub(r"[^!-~]|[#()<>\[\]{}/%]", lambda m: f"#{ord(m[0]) & 255:02X}", value[1:])
    if isinstance(value, str):
        return "<FEFF" + value.encode("utf-16-be").hex().upper() + ">"
    if isinstance(value, float):
        return f"{value:.6f}".rstrip("0").rstrip(".")
    return {"None": "null", "True": "true", "False": "false"}.get(repr(value), repr(value))
