"""PDF files by their bytes: cross-reference entries, linearization, encryption.

What patterns can find is found with SQL functions over windows of the file, cut before anything is decoded.
Cross-reference sections, which may be compressed and lead to older ones, go through a small Python function
that sees one file at a time. A file that can't be read gives a row with an error, and never fails a job.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratiolake.functions.text import permissions
from ratiolake.sources.pdf_filters import decoded
from ratiolake.sources.pdf_objects import parse

#: Bytes at a file's end where startxref is looked for, and of the two ends for linearization.
TAIL, ENDS = 4096, 256_000


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of the PDF files at a path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "length", "content")


def latin(content: Column, start: Column, length: Column) -> Column:
    """A window of bytes, from 1, as text with a character for each byte."""
    return F.decode(F.substring(content, start, length), "ISO-8859-1")


def _number(text: Column, key: str) -> Column:
    """The whole number after a key that no letter follows."""
    return F.regexp_extract(text, rf"/{key}(?![A-Za-z])\s*(-?\d+)", 1).try_cast("long")


def linearization(files: DataFrame, ends: int = ENDS) -> DataFrame:
    """(path, linearized, dict_found, L, H_offset, H_length, O, E, N, T, header, startxref, eof_count) of files (path, content)."""
    n = F.octet_length("content")
    x = files.select("path", latin(F.col("content"), F.lit(1), F.lit(ends)).alias("head"), latin(F.col("content"), F.greatest(F.lit(1), n - ends + 1), F.lit(ends)).alias("tail"))
    keyword = F.rlike("head", F.lit(r"/Linearized\s+1\b"))
    # what lies between one >> and the next, from its first <<; what is after the last is not closed
    pieces = F.split("head", ">>")
    closed = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    told = F.get(F.filter(closed, lambda p: F.rlike(p, F.lit(r"(?s)<<.*/Linearized\s+1\b"))), 0)
    x = x.withColumn("dict", F.coalesce(F.regexp_extract(told, r"(?s)<<(.*)", 1), F.lit("")))
    hint = lambda i: F.regexp_extract("dict", r"/H(?![A-Za-z])\s*\[\s*([+-]?\d+)\s+([+-]?\d+)", i).try_cast("long")
    some = lambda c: F.when(c != "", c)
    return x.select(
        "path",
        (keyword & (F.col("dict") != "")).alias("linearized"),
        (F.col("dict") != "").alias("dict_found"),
        _number(F.col("dict"), "L").alias("L"),
        hint(1).alias("H_offset"),
        hint(2).alias("H_length"),
        *[_number(F.col("dict"), k).alias(k) for k in ("O", "E", "N", "T")],
        some(F.regexp_extract("head", r"%PDF-\d\.\d", 0)).alias("header"),
        F.regexp_extract("tail", r"startxref\s+(\d+)\s+", 1).try_cast("long").alias("startxref"),
        F.regexp_count("tail", F.lit("%%EOF")).alias("eof_count"),
    )


def encryption(files: DataFrame) -> DataFrame:
    """(path, encrypted, filter, v, r, key_bits, p, and the eight permissions, all true without encryption) of files (path, content)."""
    whole = F.decode("content", "ISO-8859-1")
    x = files.select("path", whole.alias("s"))
    x = x.withColumn("trailers", F.regexp_extract_all("s", F.lit(r"(?s)trailer\s*<<(.*?)startxref"), F.lit(1)))
    last = F.try_element_at("trailers", F.lit(-1))
    ref = F.regexp_extract(F.coalesce(last, F.col("s")), r"/Encrypt(?![A-Za-z])\s+(\d+\s+\d+)\s+R", 1)
    x = x.withColumn("ref", ref)
    target = F.expr(r"""regexp_extract(s, concat('(?s)(?<![0-9])', regexp_replace(ref, '\\s+', '\\\\s+'), '\\s+obj\\s*<<(.*?)endobj'), 1)""")
    x = x.withColumn("dict", F.when(F.col("ref") != "", target).otherwise(F.regexp_extract("s", r"(?s)/Encrypt(?![A-Za-z])\s*<<(.*?)>>\s*(?:/|>>|$)", 1)))
    encrypted = F.rlike(F.coalesce(last, F.col("s")), F.lit(r"/Encrypt\b"))
    p, r = _number(F.col("dict"), "P"), _number(F.col("dict"), "R")
    allowed = {k: F.when(~encrypted, True).when(p.isNotNull(), c) for k, c in permissions(p, r).items()}
    some = lambda c: F.when(c != "", c)
    return x.select(
        "path", encrypted.alias("encrypted"), some(F.regexp_extract("dict", r"/Filter\s*/(\w+)", 1)).alias("filter"), _number(F.col("dict"), "V").alias("v"), r.alias("r"), _number(F.col("dict"), "Length").alias("key_bits"), p.alias("p"), *[c.alias(k) for k, c in allowed.items()]
    )


XREF = "path string, obj_number bigint, gen bigint, kind string, offset bigint, next_free bigint, stream_obj bigint, stream_index bigint, error string"


def xref_entries(files: DataFrame, tail: int = TAIL, window: int | None = None) -> DataFrame:
    """A row for each cross-reference entry of files (path, content) with the columns of XREF; kind is inUse, free or compressed.

    The last startxref in the file's last `tail` bytes says where the newest section is; it may be a table or
    a compressed stream. Older sections that /Prev (or /XRefStm) points to add the objects that no newer
    one has. window bounds the bytes read of a section, whole files are read without it. A file that can't
    be read has one row with an error.
    """
    n = F.octet_length("content")
    end = latin(F.col("content"), F.greatest(F.lit(1), n - tail + 1), F.lit(tail))
    starts = F.regexp_extract_all(end, F.lit(r"startxref\s+(\d{1,18})"), F.lit(1))
    x = files.select("path", "content", F.try_element_at(starts, F.lit(-1)).try_cast("long").alias("at"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in XREF.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 4, pa.string()]
        for batch in batches:
            for path, content, at in zip(batch["path"], batch["content"], batch["at"].to_pylist(), strict=True):
                try:
                    rows = [(*e, None) for e in sections(content.as_py() or b"", at, window)]
                except (ValueError, IndexError, zlib.error) as e:
                    rows = [(*[None] * 7, str(e) or type(e).__name__)]
                columns = list(zip(*[(path.as_py(), *r) for r in rows], strict=True)) or [()] * 9
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return x.select("path", "content", "at").mapInArrow(read, XREF)


def sections(data: bytes, at: int | None, window: int | None = None) -> list[tuple]:
    """The entries of the section at a place and of the older ones it leads to, newest first; each object once."""
    out: dict[int, tuple] = {}
    todo, seen = [at], set()
    while todo:
        at = todo.pop(0)
        if at in seen:
            continue
        seen.add(at)
        if at is None or at >= len(data):
            raise ValueError("no cross-reference section at startxref")
        found, older = section(data[at : at + window] if window else data[at:])
        for e in found:
            out.setdefault(e[0], e)
        todo += older
    return list(out.values())


def section(window: bytes) -> tuple[list[tuple], list[int]]:
    """The entries of the cross-reference section that some bytes start with, and where older sections are."""
    if re.match(rb"\s*xref\b", window):
        found, end = table(window)
        trailer = re.compile(rb"(?s)\s*trailer\s*<<(.*?)(?:startxref|$)").match(window, end)
        told = trailer[1] if trailer else b""
        return found, [p for k in (b"XRefStm", b"Prev") if (p := _entry(told, k, -1)) >= 0]
    m = re.match(rb"(?s)\s*\d+\s+\d+\s+obj\s*(<<.*?>>)\s*stream\r?\n", window)
    if not m:
        raise ValueError("no cross-reference section at startxref")
    return stream(m[1], window[m.end() :]), [p for p in [_entry(m[1], b"Prev", -1)] if p >= 0]


def table(text: bytes) -> tuple[list[tuple], int]:
    """The entries of a table, and where it ends."""
    at, out = re.match(rb"\s*xref\s*", text).end(), []
    while head := re.compile(rb"\s*(\d+)\s+(\d+)[ \t]*\r?\n?").match(text, at):
        first, n = int(head[1]), int(head[2])
        at = head.end()
        for i in range(n):
            e = re.compile(rb"\s*(\d{1,10})\s+(\d{1,5})\s+([nf])").match(text, at)
            if not e:
                raise ValueError("broken cross-reference table")
            at = e.end()
            used = e[3] == b"n"
            out.append((first + i, int(e[2]), "inUse" if used else "free", int(e[1]) if used else None, None if used else int(e[1]), None, None))
    return out, at


def _entry(told: bytes, key: bytes, default: int) -> int:
    m = re.search(rb"/" + key + rb"(?![A-Za-z])\s*(\d+)", told)
    return int(m[1]) if m else default


def stream(told: bytes, body: bytes) -> list[tuple]:
    """The entries of a cross-reference stream with its dictionary and what follows it; its filters are undone."""
    value = parse(told, 0, [])[0]
    size_told = value.get("Length")
    if isinstance(size_told, int) and body[size_told : size_told + 20].lstrip().startswith(b"endstream"):
        body = body[:size_told]
    elif b"endstream" in body:
        body = body[: body.index(b"endstream")]
    data = decoded(body, value.get("Filter"), value.get("DecodeParms"))
    widths = value.get("W")
    if not isinstance(widths, list) or len(widths) != 3:
        raise ValueError("cross-reference stream without /W")
    size = sum(widths)
    index = value.get("Index") or [0, value.get("Size", 0)]
    numbers = [k for a, n in zip(index[::2], index[1::2], strict=True) for k in range(a, a + n)]
    out = []
    for k, i in zip(numbers, range(0, len(data) - size + 1, size), strict=False):
        a, b = i + widths[0], i + widths[0] + widths[1]
        kind = int.from_bytes(data[i:a], "big") if widths[0] else 1
        one, two = int.from_bytes(data[a:b], "big"), int.from_bytes(data[b : i + size], "big")
        if kind == 0:
            out.append((k, two, "free", None, one, None, None))
        elif kind == 1:
            out.append((k, two, "inUse", one, None, None, None))
        elif kind == 2:
            out.append((k, 0, "compressed", None, None, one, two))
    return out


def xref_totals(entries: DataFrame) -> DataFrame:
    """Per path the number of entries of each kind and the largest offset."""
    return entries.groupBy("path").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("inUse", "free", "compressed")], F.max("offset").alias("max_offset"))


def scan_score(pages: DataFrame) -> DataFrame:
    """How likely documents are scans, from pages (path, font_count, image_count, fax_like): path, score 0 to 100, scanned.

    Pages with images give 20; none with fonts 55 more, or few with fonts 25; fax-like images 30; fonts on most pages take 20.
    """
    p = pages.groupBy("path").agg(F.count("*").alias("n"), F.count_if(F.col("font_count") > 0).alias("fonts"), F.count_if(F.col("image_count") > 0).alias("images"), F.count_if(F.col("fax_like")).alias("fax"))
    has = F.col("images") > 0
    few = F.col("fonts") <= F.greatest(F.lit(1), F.floor(F.col("n") * 0.1))
    score = F.when(has, 20).otherwise(0) + F.when(has & (F.col("fonts") == 0), 55).when(has & few, 25).otherwise(0) + F.when(F.col("fax") > 0, 30).otherwise(0) - F.when(F.col("fonts") >= F.floor(F.col("n") * 0.8), 20).otherwise(0)
    score = F.greatest(F.lit(0), F.least(F.lit(100), score))
    return p.select("path", score.alias("score"), (score >= 60).alias("scanned"))
