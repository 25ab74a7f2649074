"""The text of PDF pages: what codes of a font stand for, and where strings are shown.

A worker reads the content of one page, and the map of one font; what codes mean is a join of the codes shown with the
ranges of their font's map, by blocks of codes, so that no code meets all ranges.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratiolake.sources import pdf_reports as rep
from ratiolake.sources.pdf_objects import string_bytes
from ratiolake.tables import written

_WORD = re.compile(rb"<([0-9A-Fa-f\s]*)>|(\[)|(\])|([A-Za-z]+)")
#: Codes of a block of the join.
BLOCK = 256
#: What stands for a code without text.
UNKNOWN = "�"
MAPS = "path string, cmap bigint, first bigint, last bigint, text string"


def _unicode(raw: bytes) -> str:
    return raw.decode("utf-16-be", "replace")


def map_ranges(data: bytes) -> Iterator[tuple[int, int, str]]:
    """(first, last, text) of a map from codes to text: text is that of the first code, the others follow it by their last unit; a list gives a range for each of its texts.

    Ranges that end before they begin are left out.
    """
    held: list[bytes | list[bytes]] = []
    kind, listed = None, None
    for m in _WORD.finditer(data):
        if m[4]:
            if m[4] in (b"endbfchar", b"endbfrange"):
                kind = None
            elif m[4] in (b"beginbfchar", b"beginbfrange"):
                kind, held, listed = m[4], [], None
            continue
        if kind is None:
            continue
        if m[2]:
            listed = []
        elif m[3]:
            held.append(listed or [])
            listed = None
        else:
            digits = re.sub(rb"\s", b"", m[1])
            raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            (held if listed is None else listed).append(raw)
        if listed is None and len(held) == (2 if kind == b"beginbfchar" else 3):
            first, to = int.from_bytes(held[0], "big"), held[-1]
            last = first if kind == b"beginbfchar" else int.from_bytes(held[1], "big")
            if isinstance(to, list):
                yield from ((first + i, first + i, _unicode(x)) for i, x in enumerate(to[: max(0, last - first + 1)]))
            elif first <= last:
                yield first, last, _unicode(to)
            held = []


def font_maps(files: DataFrame, objs: DataFrame) -> DataFrame:
    """MAPS: the ranges of all maps to text (cmap: their object) that fonts of files refer to; what can't be decoded has none."""
    wanted = objs.select("path", rep._ref("ToUnicode").alias("obj")).filter("obj is not null").distinct()
    streams = rep.streams_of(files, rep._resolved(wanted, "obj", objs, "dict", "stream_start", "stream_length"), objs)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, obj, data in zip(batch["path"].to_pylist(), batch["obj"].to_pylist(), batch["data"].to_pylist(), strict=True):
                rows = [(path, obj, *r) for r in map_ranges(data or b"")]
                yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["path", "cmap", "first", "last", "text"])

    return written(streams.filter("error is null").select("path", "obj", "data").mapInArrow(read, MAPS), "maps")


def _text_of(code: Column) -> Column:
    """The text of a code in a range: the last unit of the first code's text, further on."""
    unit = F.conv(F.hex(F.encode(F.right("text", F.lit(1)), "UTF-32")), 16, 10).cast("long") + (code - F.col("first"))
    moved = F.decode(F.unhex(F.lpad(F.hex(unit), 8, "0")), "UTF-32")
    return F.when(code == F.col("first"), F.col("text")).otherwise(F.concat(F.left("text", F.length("text") - 1), moved))


def code_texts(maps: DataFrame) -> DataFrame:
    """(path, cmap, code, text): a row for each code of maps; of ranges that hold the same code the one that begins last counts."""
    x = maps.select("*", F.explode(F.sequence("first", "last")).alias("code"))
    return x.withColumn("text", _text_of(F.col("code"))).groupBy("path", "cmap", "code").agg(F.max_by("text", F.struct("first", "last", "text")).alias("text"))


def with_texts(codes: DataFrame, maps: DataFrame) -> DataFrame:
    """codes (path, cmap, code and more) with `text`, null where no range of their map has them; joined by blocks of codes."""
    ranges = maps.select("path", "cmap", "first", "last", "text", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor(F.col("last") / BLOCK))).alias("block"))
    asked = codes.select("path", "cmap", "code").distinct().withColumn("block", F.floor(F.col("code") / BLOCK))
    found = asked.join(ranges.hint("merge"), ["path", "cmap", "block"]).filter(F.col("code").between(F.col("first"), F.col("last")))
    found = found.withColumn("text", _text_of(F.col("code"))).groupBy("path", "cmap", "code").agg(F.max_by("text", F.struct("first", "last", "text")).alias("text"))
    return codes.join(found.hint("merge"), ["path", "cmap", "code"], "left")


SHOWN = "path string, page int, at int, run int, font string, size double, x double, y double, codes binary"
Matrix = tuple[float, float, float, float, float, float]
_ONE: Matrix = (1, 0, 0, 1, 0, 0)


def times(a: Matrix, b: Matrix) -> Matrix:
    """First a, then b."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def shown(ops: list[tuple[str, str]]) -> Iterator[tuple]:
    """(at, run, font, size, x, y, codes) of each string that a page's operators show.

    x and y are where the string's line matrix stands on the page. Strings shown one after the other, without a move between them, are a run.
    """
    state: tuple[Matrix, str | None, float, float] = (_ONE, None, 0.0, 0.0)  # matrix, font, size, leading
    stack, line, run, moved = [], _ONE, 0, True
    for at, (op, args) in enumerate(ops):
        ctm, font, size, lead = state
        a = args.split() if op not in ("Tj", "TJ", "'", '"') else []
        number = [float(v) for v in a if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)", v)]
        if op == "q":
            stack.append(state)
        elif op == "Q":
            state = stack.pop() if stack else state
        elif op == "cm" and len(number) == 6:
            state = (times(tuple(number), ctm), font, size, lead)
        elif op == "Tf" and a:
            state = (ctm, a[0].lstrip("/"), number[-1] if number else 0.0, lead)
        elif op == "TL" and number:
            state = (ctm, font, size, number[0])
        elif op == "BT":
            line, moved = _ONE, True
        elif op == "Tm" and len(number) == 6:
            line, moved = tuple(number), True
        elif op in ("Td", "TD") and len(number) == 2:
            line, moved = times((1, 0, 0, 1, *number), line), True
            state = (ctm, font, size, -number[1]) if op == "TD" else state
        elif op == "T*" or op in ("'", '"'):
            line, moved = times((1, 0, 0, 1, 0, -lead), line), True
        if op in ("Tj", "TJ", "'", '"'):
            run, moved = run + moved, False
            place = times(line, state[0])
            yield at, run, state[1], state[2], place[4], place[5], string_bytes(args.encode("latin-1"))


def shown_strings(ops: DataFrame) -> DataFrame:
    """SHOWN: the strings of pages, from `pdf_reports.page_ops`; the operators of a page meet in one worker."""
    of_page = ops.groupBy("path", "page").agg(F.array_sort(F.collect_list(F.struct("at", "op", "args"))).alias("ops"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.binary())
        for batch in batches:
            for path, page, listed in zip(batch["path"].to_pylist(), batch["page"].to_pylist(), batch["ops"].to_pylist(), strict=True):
                rows = [(path, page, *r) for r in shown([(o["op"], o["args"]) for o in listed])]
                yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["path", "page", "at", "run", "font", "size", "x", "y", "codes"])

    return of_page.mapInArrow(read, SHOWN)


def shown_codes(strings: DataFrame, objs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, page, at, run, x, y, font, cmap, i, code) of SHOWN: a row for each code; font is the object of the font, null if the page has none of the name.

    Codes of composite fonts have two bytes, those of others one.
    """
    used = rep._resolved(rep.page_resources(objs, nodes, "Font"), "obj", objs, "dict")
    used = used.select("path", "page", F.col("name").alias("font"), F.col("obj").alias("font_obj"), rep._ref("ToUnicode").alias("cmap"), F.when(rep._name("Subtype") == "Type0", 2).otherwise(1).alias("width"))
    x = written(strings, "strings").join(written(used, "used").hint("merge"), ["path", "page", "font"], "left").withColumn("width", F.coalesce("width", F.lit(1)))
    count = F.floor(F.octet_length("codes") / F.col("width")).cast("int")
    x = x.withColumn("i", F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))))
    code = F.conv(F.hex(F.expr("substring(codes, i * width + 1, width)")), 16, 10).cast("long")
    return x.select("path", "page", "at", "run", "x", "y", F.col("font_obj").alias("font"), "cmap", "i", code.alias("code"))


def codes_without_text(codes: DataFrame, maps: DataFrame) -> DataFrame:
    """(path, font, code, n): codes that pages show in a font with a map which has no text for them, and how often."""
    x = with_texts(codes.filter("cmap is not null"), maps)
    return x.filter("text is null").groupBy("path", "font", "code").agg(F.count("*").alias("n"))


def text_runs(codes: DataFrame, maps: DataFrame) -> DataFrame:
    """(path, page, line, x, y, text): the runs of shown_codes as text. Lines go down the page, runs of a line to the right; equal heights, to a hundredth, are a line.

    Codes of fonts without a map are told as Latin-1, codes that a map lacks as UNKNOWN.
    """
    x = with_texts(codes, maps)
    text = F.coalesce("text", F.when(F.col("cmap").isNull(), F.decode(F.unhex(F.lpad(F.hex("code"), 2, "0")), "ISO-8859-1")), F.lit(UNKNOWN))
    runs = x.groupBy("path", "page", "run").agg(F.min_by(F.struct("x", "y"), F.struct("at", "i")).alias("p"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "i", text.alias("t")))), lambda c: c["t"]), "").alias("text"))
    height = F.round("p.y", 2)
    line = F.dense_rank().over(Window.partitionBy("path", "page").orderBy(height.desc()))
    return runs.select("path", "page", line.alias("line"), F.col("p.x").alias("x"), F.col("p.y").alias("y"), "text")
