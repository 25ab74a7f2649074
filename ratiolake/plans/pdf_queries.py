"""PDF reports over files that are made from suppliers by string functions, so that SQL can tell what they hold."""

from __future__ import annotations

from collections.abc import Callable
from inspect import signature

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratiolake.sources import pdf
from ratiolake.sources import pdf_objects as po
from ratiolake.sources import pdf_reports as rep
from ratiolake.sources import pdf_text as pt
from ratiolake.sources import pdf_writer as pw
from ratiolake.operators.relational import page_ranges
from ratiolake.tables import spread, written


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _if(cond: Column, text: str | Column) -> Column:
    return F.when(cond, text).otherwise("")


def _stream(number: Column | int, entries: str | Column, body: Column) -> Column:
    return _text(F.lit(number), " 0 obj << ", entries, " /Length ", F.length(body), " >> stream\n", body, "\nendstream endobj\n")


def _filtered(k: Column, number: Column, text: Column) -> Column:
    """A stream as it is, in hexadecimal, that after run lengths (one literal run), or with a filter that isn't undone."""
    digits = F.hex(F.encode(text, "UTF-8"))
    runs = F.concat(F.lpad(F.hex(F.length(text) - 1), 2, "0"), digits, F.lit("80>"))
    return (
        F.when(k % 7 == 1, _stream(number, "/Filter /ASCIIHexDecode", F.concat(digits, F.lit(">")))).when(k % 7 == 2, _stream(number, "/Filter [/ASCIIHexDecode /RunLengthDecode] /DecodeParms [null null]", runs))
        .when(k % 7 == 3, _stream(number, "/Filter /JPXDecode", text)).otherwise(_stream(number, "", text))
    )


def _page(k: Column, n: Column, i: Column) -> Column:
    """The objects of page i of n: the page, a link out, one to the next page, a note, content; on the first page also links whose parts are objects of their own."""
    at = lambda extra: 100 + i * 10 + extra
    even = i % 2 == 0
    resources = _if(even, "/Resources << /Font << /F1 20 0 R /F3 23 0 R >> /XObject << /Im1 30 0 R /Im2 31 0 R >> >> ")
    box = F.when(i == 1, "/MediaBox [0 0 792 612] ").when(i == 2, "/MediaBox [0 0 100 100.3] ").otherwise("")
    notes = _text(at(1), " 0 R ", at(2), " 0 R ", at(3), " 0 R", _if(i == 0, " 104 0 R 107 0 R 108 0 R 109 0 R 52 0 R"), _if(i == n - 1, " 55 0 R"))
    contents = F.when(even, _text(at(5), " 0 R")).otherwise(_text("[", at(5), " 0 R ", at(6), " 0 R]"))
    kind = F.when(i % 3 == 0, "Highlight").when(i % 3 == 1, "Text").otherwise("Odd")
    return _text(
        at(0), " 0 obj << /Type /Page /Parent 3 0 R ", resources, box, "/Annots [", notes, "] /Contents ", contents, " >> endobj\n",
        at(1), " 0 obj << /Type /Annot /Subtype /Link /Rect ", F.when(even, "[0 0 10 10]").otherwise("89 0 R"), " /A << /S /URI /URI (https://x.org/", k, "/", i, ") >> >> endobj\n",
        at(2), " 0 obj << /Subtype /Link /Dest [", 100 + (i + 1) % n * 10, " 0 R /Fit] >> endobj\n",
        at(3), " 0 obj << /Subtype /", kind, " /C ", F.when(even, "88 0 R").otherwise("[1 0 0.5]"), " /F 4 /T (by ", i, ") /M (D:2025) /NM (n", k, ") /Contents (note \\(", i, "\\)) /QuadPoints [0 1 2 3 4 5 6 7] >> endobj\n",
        _if(i == 0, _text("104 0 obj << /Subtype /Link /A 85 0 R >> endobj\n107 0 obj << /Subtype /Link /Dest (named) >> endobj\n108 0 obj << /Subtype /Link /A << /S /URI >> >> endobj\n109 0 obj << /Subtype /Link /Dest 87 0 R >> endobj\n",
            "85 0 obj << /S /URI /URI 86 0 R >> endobj\n86 0 obj (https://y.org/", k, ") endobj\n87 0 obj [", 90 + n * 10, " 0 R /Fit] endobj\n88 0 obj [1 0 0.5] endobj\n")),
        _if(i == 1, "89 0 obj [0 0 10 10] endobj\n"),
        _filtered(k, at(5), _text("q 1 0 0 1 0 0 cm BT /F1 12 Tf (Page ", i, ") Tj [(a) 3 (b)] TJ ET /Im1 Do Q")),
        _if(~even, _stream(at(6), "", F.lit("BI /W 1 /H 1 ID x EI 0 0 5 5 re W n % end"))),
    )


#: A map of space and of letters from A to z; digits have no text.
_CMAP = "1 beginbfchar <20> <0020> endbfchar 1 beginbfrange <41> <7A> <0041> endbfrange"


def pdf_files(spark: SparkSession, d: str) -> DataFrame:
    """(path, content): a file for each supplier; one in fifty says that it is encrypted."""
    k, name, n = F.col("k"), F.col("name"), F.col("n")
    s = spread(spark.read.parquet(f"{d}/supplier.parquet")).select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 4 + 1).cast("int").alias("n"))
    numbers = F.sequence(F.lit(0), n - 1)
    old = "xref\n0 1\n0000000000 65535 f \n5 1\n0000000055 00002 n \ntrailer << /Size 6 >>\n"
    body = _text(
        "%PDF-1.5\n", _if(k % 3 == 0, old), _if(k % 6 == 0, _text("5 0 obj << /Linearized 1 /L ", k, " /H [ 10 20 ] /O 5 /E 99 /N ", n, " /T 77 >> endobj\n")),
        "1 0 obj << /Type /Catalog /Pages 2 0 R /Outlines 40 0 R /AcroForm << /Fields [51 0 R 53 0 R 55 0 R] >> /Names << /EmbeddedFiles 60 0 R >>", _if(k % 3 == 0, " /OpenAction 80 0 R"), " >> endobj\n",
        "2 0 obj << /Type /Pages /Kids ", F.when(k % 5 == 0, "92 0 R").otherwise("[3 0 R]"), " /MediaBox [0 0 595.28 841.89] /Resources 4 0 R >> endobj\n",
        "3 0 obj << /Type /Pages /Parent 2 0 R /Kids [", F.array_join(F.transform(numbers, lambda i: _text(100 + i * 10, " 0 R")), " "), _if(k % 11 == 0, " 100 0 R"), "] /Count ", n, _if(k % 2 == 1, " /Rotate 90"), " >> endobj\n",
        "4 0 obj << /Font << /F2 21 0 R >> >> endobj\n",
        "20 0 obj << /Type /Font /Subtype /TrueType /BaseFont /ABCDEF+Arial-Bold /FontDescriptor 22 0 R /ToUnicode 24 0 R /Encoding /WinAnsiEncoding >> endobj\n",
        "21 0 obj << /Type /Font /Subtype /Type1 /BaseFont /Helvetica >> endobj\n22 0 obj << /Type /FontDescriptor", _if(k % 3 != 0, " /FontFile2 26 0 R"), " >> endobj\n",
        "23 0 obj << /Type /Font /Subtype /Type0 /BaseFont /Noto-Italic /DescendantFonts ", F.when(k % 2 == 0, "91 0 R").otherwise("[25 0 R]"), " /Encoding /Identity-H >> endobj\n",
        _if(k % 2 == 0, "91 0 obj [25 0 R] endobj\n"), _if(k % 5 == 0, "92 0 obj [3 0 R] endobj\n"), _if(k % 13 == 0, "97 0 obj << /Broken [ >> endobj\n"),
        "25 0 obj << /Type /Font /Subtype /CIDFontType2 /BaseFont /Noto-Italic /FontDescriptor 27 0 R >> endobj\n27 0 obj << /Type /FontDescriptor /FontFile3 26 0 R >> endobj\n",
        _stream(24, "", F.lit(_CMAP)), _stream(26, "", F.lit("font")),
        _stream(30, _text("/Type /XObject /Subtype /Image /Width ", k, " /Height 20 /BitsPerComponent ", F.when(k % 5 == 0, "1").otherwise("8"), " /ColorSpace /DeviceGray /Filter /DCTDecode"), F.lit("abcd")),
        _stream(31, F.when(k % 2 == 0, _text("/Type /XObject /Subtype /Image /Width ", k, " /Height 20 /BitsPerComponent 8 /ColorSpace /DeviceRGB /Filter /DCTDecode")).otherwise(_text("/Type /XObject /Subtype /Image /Width ", k + 1, " /Height 20 /BitsPerComponent 8 /ColorSpace /DeviceRGB /Filter [/ASCII85Decode /JPXDecode]")), F.lit("efgh")),
        "40 0 obj << /Type /Outlines /First 41 0 R >> endobj\n41 0 obj << /Title (Chapter ", k, ") /Parent 40 0 R /Next 42 0 R /First 43 0 R /Dest [100 0 R /Fit] >> endobj\n",
        "42 0 obj << /Title (Annex) /Parent 40 0 R /A << /S /GoTo /D [", 90 + n * 10, " 0 R /Fit] >>", _if(k % 7 == 0, " /Next 41 0 R"), " >> endobj\n43 0 obj << /Title (Part ", name, ") /Parent 41 0 R >> endobj\n",
        "51 0 obj << /T (person) /FT /Tx /Ff 3 /MaxLen 40 /Kids [52 0 R] >> endobj\n52 0 obj << /Type /Annot /Subtype /Widget /T (name) /Parent 51 0 R /V (", name, ") /Rect [1 2 3 4] /AP << /N 57 0 R >>", _if(k % 2 == 1, " /Q 1"), " >> endobj\n", _stream(57, "/Type /XObject /Subtype /Form /BBox [0 0 2 2]", F.lit("q Q")), _if(k % 3 == 0, _stream(58, "/Type /XObject /Subtype /Form", F.lit("n"))),
        "53 0 obj << /T (agree) /FT /Btn /V /Yes /TU (Say yes) >> endobj\n55 0 obj << /Type /Annot /Subtype /Widget /FT /Sig /T (seal)", _if(k % 2 == 0, " /V 56 0 R"), _if(k % 3 == 0, " /AP << /N << /Off 58 0 R /On 57 0 R >> >>"), " /Rect [7.5 8 5.25 6] >> endobj\n",
        "56 0 obj << /Type /Sig /Filter /Adobe.PPKLite /SubFilter ", F.when(k % 4 == 0, "/ETSI.CAdES.detached").otherwise("/adbe.pkcs7.detached"), " /ByteRange [0 10 20 ", k, "] /Contents <61626364> /M (D:20240101) /Name (", name, ") >> endobj\n",
        "60 0 obj << /Kids [61 0 R 64 0 R] >> endobj\n61 0 obj << /Names [(a.txt) 62 0 R] >> endobj\n64 0 obj << /Names [(b) 65 0 R (c) 66 0 R] >> endobj\n",
        "62 0 obj << /Type /Filespec /F (a.txt) /UF (u.txt) /EF << /F 63 0 R >> >> endobj\n65 0 obj << /Type /Filespec /EF << /F 63 0 R >> >> endobj\n66 0 obj << /Type /Filespec /F (c.bin) >> endobj\n",
        _stream(63, "/Type /EmbeddedFile /Subtype /text#2Fplain /Params << /CheckSum <0102FF> /ModDate (D:2024) >>", F.lit("hello")),
        "70 0 obj << /Title ( ", name, " ) /Author () /Producer (p", k, ") >> endobj\n80 0 obj << /S /JavaScript /JS (x) >> endobj\n90 0 obj [1 2 (three)] endobj\n",
        "99 0 obj << /Filter /Standard /V 2 /R 3 /Length 128 /P ", -k, " >> endobj\n",
        F.array_join(F.transform(numbers, lambda i: _page(k, n, i)), ""),
    )
    s = s.withColumn("body", body)
    table = _text("xref\n0 3\n0000000000 65535 f \n0000000010 00000 n \n0000000020 00000 n \n100 1\n", F.lpad((k * 7).cast("string"), 10, "0"), " 00000 n \n")
    end = _text("trailer << /Root 1 0 R /Info 70 0 R /Size 200", _if(k % 3 == 0, " /Prev 9"), _if(k % 50 == 0, " /Encrypt 99 0 R"), " >>\nstartxref\n", F.length("body"), "\n%%EOF\n")
    return s.select(_text("s", k, ".pdf").alias("path"), F.encode(_text(F.col("body"), table, end), "UTF-8").alias("content"))


def xref_stream_files(spark: SparkSession, d: str) -> DataFrame:
    """(path, content): a file for each supplier whose cross-reference section is a stream, in hexadecimal, that leads to an older table; one in nine has a broken one."""
    k = F.col("s_suppkey")
    number = lambda c, width: F.lpad(F.hex(c), width, "0")
    rows = [_text("00", number(k % 7, 4), "00"), _text("01", number(k + 300, 4), "01"), _text("02", number(k % 9, 4), number(k % 5, 2))]
    body = _text("%PDF-1.5\nxref\n9 1\n0000000009 00000 n \ntrailer << /Size 10 >>\n")
    told = _text("5 0 obj << /Type /XRef /W ", F.when(k % 9 == 8, "[1 2]").otherwise("[1 2 1]"), " /Index [0 2 ", k % 3 + 3, " 1] /Size 9 /Prev 9 /Filter /ASCIIHexDecode /Length 25 >> stream\n", *rows, ">\nendstream endobj\nstartxref\n", F.length(body), "\n%%EOF\n")
    return spread(spark.read.parquet(f"{d}/supplier.parquet")).select(_text("x", k, ".pdf").alias("path"), F.encode(_text(body, told), "UTF-8").alias("content"))


def j12_xref_streams(spark: SparkSession, d: str) -> DataFrame:
    return pdf.xref_entries(xref_stream_files(spark, d))


def a05_compressed(spark: SparkSession, d: str) -> DataFrame:
    return pdf.xref_totals(j12_xref_streams(spark, d).filter("error is null"))


def _steps(files: DataFrame, n: int) -> tuple[DataFrame, ...]:
    """The first n of files, their objects, and their pages; what is not asked for is not made."""
    found = [files]
    if n > 1:
        found.append(written(po.objects(files), "objects").filter("error is null"))
    if n > 2:
        found.append(rep.page_nodes(found[1]))
    return tuple(found)


def _read(spark: SparkSession, d: str, n: int = 3) -> tuple[DataFrame, ...]:
    return _steps(written(pdf_files(spark, d), "pdf"), n)


def unreadable(spark: SparkSession, d: str) -> DataFrame:
    """Files and objects that can't be read, with the reason."""
    return po.objects(pdf_files(spark, d)).filter("error is not null").select("path", "obj", "error")


def _joined(df: DataFrame, *arrays: str) -> DataFrame:
    return df.withColumns({a: F.array_join(F.col(a).cast("array<string>"), ",") for a in arrays})


def _query(make: Callable[..., DataFrame], name: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query of as many of the steps as make has parameters."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        return make(*_read(spark, d, len(signature(make).parameters)))

    query.__name__ = name
    return query


def _fields(objs: DataFrame, nodes: DataFrame) -> DataFrame:
    return rep.form_fields(objs, rep.page_annotations(objs, nodes))


def _notes(objs: DataFrame, nodes: DataFrame) -> DataFrame:
    return rep.annotations(rep.page_annotations(objs, nodes), objs)


def _ops(files: DataFrame, objs: DataFrame, nodes: DataFrame) -> DataFrame:
    return rep.page_ops(files, objs, nodes)


def _codes(files: DataFrame, objs: DataFrame, nodes: DataFrame) -> DataFrame:
    return pt.shown_codes(pt.shown_strings(_ops(files, objs, nodes)), objs, nodes)


_MAKE: dict[str, Callable[..., DataFrame]] = {
    "j01_form_fields": lambda f, o, n: _fields(o, n).drop("obj"),
    "j02_metadata": lambda f, o: rep.metadata(o).select("path", "Title", "Author", "Producer").join(rep.metadata_filled(rep.metadata(o)).hint("merge"), "path"),
    "j03_outline": lambda f, o, n: rep.outline(o, n),
    "j04_links": lambda f, o, n: rep.links(_notes(o, n), n),
    "j05_fonts": lambda f, o, n: _joined(rep.fonts(o, n).select("path", "obj", "base_font", "subtype", "encoding", "file", "embedded", "status", "to_unicode", "name_family", "name_weight", "name_style", "pages"), "pages"),
    "j06_pages": lambda f, o, n: rep.pages(n).select("path", "page", "obj", "width", "height", "rotation", "width_mm", "size_name", "orientation", "error"),
    "j07_images": lambda f, o, n: _joined(rep.images(o, n), "pages"),
    "j07_unique_images": lambda f, o, n: _joined(rep.unique_images(rep.images(o, n)), "pages"),
    "j08_annotations": lambda f, o, n: _joined(_notes(o, n).drop("uri", "to", "target"), "quad_points", "color", "rect"),
    "j09_signatures": lambda f, o, n: _joined(rep.signatures(o, _fields(o, n)).drop("obj", "reason"), "byte_range"),
    "j10_attachments": lambda f, o: rep.attachments(o).drop("description", "created"),
    "j10_objects_and_xref": lambda f, o: rep.with_xref(rep.inventory(o), pdf.xref_entries(f)).select("path", "obj", "kind", "n_keys", "xref_kind", "xref_offset").filter("obj in (1, 2, 90, 100)"),
    "j11_objects": lambda f, o: rep.inventory(o).drop("n_keys", "declared", "filters"),
    "j11_findings": lambda f, o: rep.findings(o, rep.inventory(o)),
    "j12_xref": lambda f: pdf.xref_entries(f).select("path", "obj_number", "gen", "kind", "offset", "next_free", "error"),
    "j13_page_ops": lambda f, o, n: _ops(f, o, n),
    "k06_font_maps": lambda f, o: pt.code_texts(pt.font_maps(f, o)),
    "k06_codes_without_text": lambda f, o, n: pt.codes_without_text(_codes(f, o, n), pt.font_maps(f, o)),
    "k06_text": lambda f, o, n: pt.text_runs(_codes(f, o, n), pt.font_maps(f, o)),
    "j13_notes": lambda f, o, n: rep.content_notes(rep.page_content(f, o, n)),
    "j14_scan": lambda f, o, n: pdf.scan_score(rep.scan_pages(o, n)),
    "j15_encryption": lambda f: pdf.encryption(f).select("path", "encrypted", "filter", "v", "r", "key_bits", "p", "print", "modify", "print_high_quality"),
    "j16_linearization": lambda f: pdf.linearization(f).select("path", "linearized", "L", "H_offset", "N", "header", "eof_count"),
    "a04_page_sizes": lambda f, o, n: rep.page_sizes(rep.pages(n)),
    "a05_xref_totals": lambda f: pdf.xref_totals(pdf.xref_entries(f)),
    "a06_link_counts": lambda f, o, n: rep.link_counts(rep.links(_notes(o, n), n)),
    "a07_font_counts": lambda f, o, n: rep.font_counts(rep.fonts(o, n)),
    "a09_object_totals": lambda f, o: rep.object_totals(rep.inventory(o), hide_other=True).select("path", "streams", "arrays", "stream_bytes", "largest", "scripts", "files", "orphans"),
    "a10_attachment_totals": lambda f, o: rep.attachment_totals(rep.attachments(o)),
    "a11_signature_counts": lambda f, o, n: rep.signature_counts(rep.signatures(o, _fields(o, n))),
    "a12_annotation_counts": lambda f, o, n: rep.annotation_counts(_notes(o, n)),
    "a13_op_totals": lambda f, o, n: rep.op_totals(rep.page_op_counts(_ops(f, o, n))),
    "a20_tree_count": lambda f, o, n: rep.outline(o, n).groupBy("path").agg(F.count("*").alias("items"), F.max("level").alias("depth")),
    "f03_embedding_problems": lambda f, o, n: rep.embedding_problems(rep.fonts(o, n)).select("path", "obj", "status"),
    "f04_filled_fields": lambda f, o, n: rep.filled_fields(_fields(o, n)).select("path", "name", "type"),
    "f05_tree_filter": lambda f, o, n: rep.tree_filter(rep.outline(o, n), "#00000000").select("path", "place", "title"),
}

#: Pages that a split takes, by what the supplier's number leaves when divided by 3; null is a file for each page.
_RANGES = ["2-3, 1", "4-2,x,9", None]


def _sources(files: DataFrame) -> DataFrame:
    """The files by tens of supplier numbers."""
    k = F.regexp_extract("path", r"(\d+)", 1).cast("long")
    return files.select(F.concat(F.lit("m"), F.floor(k / 10).cast("string"), F.lit(".pdf")).alias("out"), (k % 10).cast("int").alias("idx"), "path")


def _merge(files: DataFrame, objs: DataFrame, nodes: DataFrame, policy: str = "keep-first", custom: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    return pw.merged(files, objs, nodes, _sources(files), policy, custom)


def _plan(nodes: DataFrame) -> DataFrame:
    """Odd numbers by _RANGES, even ones page by page."""
    k = F.regexp_extract("path", r"(\d+)", 1).cast("long")
    n = nodes.filter("page is not null").groupBy("path").agg(F.max("page").alias("n"))
    text = F.when(k % 3 == 0, _RANGES[0]).when(k % 3 == 1, _RANGES[1])
    each = F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: F.struct(i.alias("first"), i.alias("last")))
    return pw.split_plan(nodes, n.select("path", F.when(text.isNotNull(), page_ranges(text, F.col("n"))).otherwise(each).alias("ranges")))


def _split(files: DataFrame, objs: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    plan = _plan(nodes)
    return pw.split(files, objs, nodes, plan), plan


def _again(chunks: DataFrame, n: int = 3) -> tuple[DataFrame, ...]:
    """What was written, read as any file is: the first n steps."""
    return _steps(written(pw.whole(chunks), "again"), n)


def _shown(nodes: DataFrame) -> DataFrame:
    return rep.pages(nodes).select("path", "page", "width", "height", "rotation", "error")


def _right_places(files: DataFrame) -> DataFrame:
    """(path, objects, right): how many entries the cross-reference table has, and at how many of their places the object stands."""
    e = pdf.xref_entries(files).filter("kind = 'inUse'").join(files, "path")
    found = F.expr("decode(substring(content, cast(offset + 1 as int), length(cast(obj_number as string)) + 6), 'ISO-8859-1')") == F.concat(F.col("obj_number").cast("string"), F.lit(" 0 obj"))
    return e.groupBy("path").agg(F.count("*").alias("objects"), F.count_if(found).alias("right"))


def _info(chunks: DataFrame) -> DataFrame:
    return rep.metadata(_again(chunks, 2)[1]).select("path", "Title", "Author", "Subject", "Keywords", "Producer")


def _fonts_of(chunks: DataFrame) -> DataFrame:
    _, o, n = _again(chunks)
    return _joined(rep.fonts(o, n).select("path", "base_font", "status", "pages"), "pages")


def _totals(some: DataFrame, mapping: DataFrame) -> DataFrame:
    length = pw.whole(some).select(F.col("path").alias("out"), F.octet_length("content").alias("length"))
    return pw.merge_totals(some, mapping).join(length.hint("merge"), "out").select("out", "sources", "pages", (F.col("bytes") == F.col("length")).alias("all_bytes"))


def _clean(f: DataFrame, o: DataFrame, n: DataFrame, rebuild: bool) -> DataFrame:
    """What went, and what is left: objects, those that nothing reaches, annotations, fields and findings."""
    some, report = pw.sanitized(f, o, n, rebuild=rebuild)
    _, o2, n2 = _again(some)
    inv = written(rep.inventory(o2), "inventory")
    left = inv.groupBy("path").agg(F.count("*").alias("objects"), F.count_if(~F.col("reached")).alias("orphans"))
    found = rep.findings(o2, inv).groupBy("path").agg(F.count("*").alias("findings"))
    notes = rep.page_annotations(o2, n2).groupBy("path").agg(F.count("*").alias("annotations"))
    x = written(report, "report").join(written(left, "left").hint("merge"), "path").join(found.hint("merge"), "path", "left").join(notes.hint("merge"), "path", "left")
    return x.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("findings", "annotations")})


def _flat(f: DataFrame, o: DataFrame, n: DataFrame) -> DataFrame:
    """Operators that stand before and after a page's own, how many fields there were and are, and the annotations left."""
    f2, o2, n2 = _again(pw.flattened(f, o, n))
    ops = _ops(f2, o2, n2).join(rep.page_resources(o2, n2, "XObject").groupBy("path", "page").agg(F.count("*").alias("drawings")).hint("merge"), ["path", "page"], "left")
    of_page = ops.groupBy("path", "page", "drawings").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "op", "args"))), lambda x: F.trim(F.concat_ws(" ", x["args"], x["op"]))), " ").alias("content"))
    of_page = written(of_page, "shown")
    fields = lambda a, b, name: written(_fields(a, b).groupBy("path").agg(F.count("*").alias(name)), "counts")
    notes = rep.page_annotations(o2, n2).groupBy("path", "page").agg(F.count("*").alias("annotations"))
    x = of_page.join(notes.hint("merge"), ["path", "page"], "left").join(fields(o, n, "before").hint("merge"), "path", "left").join(fields(o2, n2, "after").hint("merge"), "path", "left")
    return x.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("annotations", "before", "after", "drawings")})


_CUSTOM = {"Title": " All ", "Author": "", "Keywords": "one, two words,,three"}
_MAKE |= {
    "j18_merge": lambda f, o, n: _shown(_again(_merge(f, o, n)[0])[2]),
    "j18_mapping": lambda f, o, n: pw.merge_mapping(_sources(f), n),
    "j18_metadata": lambda f, o, n: _info(_merge(f, o, n)[0]),
    "j18_custom_metadata": lambda f, o, n: _info(_merge(f, o, n, "custom", _CUSTOM)[0]),
    "j18_xref": lambda f, o, n: _right_places(*_again(_merge(f, o, n)[0], 1)),
    "j18_fonts": lambda f, o, n: _fonts_of(_merge(f, o, n)[0]),
    "a18_merge_totals": lambda f, o, n: _totals(*_merge(f, o, n)),
    "j19_plan": lambda f, o, n: _plan(n),
    "j19_split": lambda f, o, n: _shown(_again(_split(f, o, n)[0])[2]),
    "j19_fonts": lambda f, o, n: _fonts_of(_split(f, o, n)[0]),
    "j19_xref": lambda f, o, n: _right_places(*_again(_split(f, o, n)[0], 1)),
    "j20_flatten": lambda f, o, n: _flat(f, o, n),
    "j21_sanitize": lambda f, o, n: _clean(f, o, n, rebuild=False),
    "j21_rebuild": lambda f, o, n: _clean(f, o, n, rebuild=True),
}

QUERIES = {name: _query(make, name) for name, make in _MAKE.items()} | {"j15_unreadable": unreadable, "j12_xref_streams": j12_xref_streams, "a05_compressed": a05_compressed}

_ALL = "a AS (SELECT s_suppkey AS k, s_name AS name, 's' || s_suppkey || '.pdf' AS path, 1 + s_suppkey % 4 AS n FROM supplier)"
_S = f"WITH {_ALL}, s AS (SELECT * FROM a WHERE k % 50 <> 0), p AS (SELECT *, unnest(range(n)) AS i FROM s)"
_FONTS = f"""{_S}, f AS (
  SELECT path, k, 20 AS obj, 'ABCDEF+Arial-Bold' AS base_font, 'TrueType' AS subtype, 'WinAnsiEncoding' AS encoding, CASE WHEN k % 3 <> 0 THEN 'FontFile2' END AS file, k % 3 <> 0 AS embedded, CASE WHEN k % 3 <> 0 THEN 'subset' ELSE 'none' END AS status, true AS to_unicode, 'Arial' AS name_family, 'bold' AS name_weight, 'unknown' AS name_style, true AS sub,
    (SELECT string_agg((i + 1)::VARCHAR, ',' ORDER BY i) FROM p WHERE p.k = s.k AND i % 2 = 0) AS pages FROM s
  UNION ALL SELECT path, k, 21, 'Helvetica', 'Type1', NULL, NULL, NULL, 'unknown', false, 'Helvetica', 'unknown', 'unknown', false, (SELECT string_agg((i + 1)::VARCHAR, ',' ORDER BY i) FROM p WHERE p.k = s.k AND i % 2 = 1) FROM s WHERE n > 1
  UNION ALL SELECT path, k, 23, 'Noto-Italic', 'Type0', 'Identity-H', 'FontFile3', true, 'full', false, 'Noto', 'unknown', 'italic', false, (SELECT string_agg((i + 1)::VARCHAR, ',' ORDER BY i) FROM p WHERE p.k = s.k AND i % 2 = 0) FROM s)"""
_IMAGES = f"""{_S}, m AS (
  SELECT path, k, 30 AS obj, k AS width, 20 AS height, CASE WHEN k % 5 = 0 THEN 1 ELSE 8 END AS bits, 'DeviceGray' AS colorspace, 'DCTDecode' AS filters, 'jpg' AS ext FROM s
  UNION ALL SELECT path, k, 31, CASE WHEN k % 2 = 0 THEN k ELSE k + 1 END, 20, 8, 'DeviceRGB', CASE WHEN k % 2 = 0 THEN 'DCTDecode' ELSE 'ASCII85Decode+JPXDecode' END, CASE WHEN k % 2 = 0 THEN 'jpg' ELSE 'jp2' END FROM s),
im AS (SELECT m.path, m.k, obj, width::INTEGER AS width, height, bits, colorspace, filters, ext, 4::BIGINT AS length, count(*) AS occurrences, string_agg((i + 1)::VARCHAR, ',' ORDER BY i) AS pages FROM m JOIN p ON p.k = m.k AND i % 2 = 0 GROUP BY ALL)"""
_OPS = f"""{_S}, o AS (SELECT path, (i + 1)::INTEGER AS page, unnest(range(CASE WHEN i % 2 = 0 THEN 9 ELSE 13 END))::INTEGER AS "at", i FROM p)
, ops AS (SELECT path, page, "at", ['q', 'cm', 'BT', 'Tf', 'Tj', 'TJ', 'ET', 'Do', 'Q', 'INLINE_IMAGE', 're', 'W', 'n']["at" + 1] AS op, ['', '1 0 0 1 0 0', '', '/F1 12', '(Page ' || i || ')', '[ (a) 3 (b) ]', '', '/Im1', '', '/W 1 /H 1', '0 0 5 5', '', '']["at" + 1] AS args FROM o)"""
_XREF = f"""WITH {_ALL}, x AS (
  SELECT path, k, unnest([0, 1, 2, 100]) AS obj_number FROM a UNION ALL SELECT path, k, 5 FROM a WHERE k % 3 = 0)
, e AS (SELECT path, obj_number::BIGINT AS obj_number, CASE obj_number WHEN 0 THEN 65535 WHEN 5 THEN 2 ELSE 0 END::BIGINT AS gen, CASE WHEN obj_number = 0 THEN 'free' ELSE 'inUse' END AS kind,
  CASE obj_number WHEN 1 THEN 10 WHEN 2 THEN 20 WHEN 5 THEN 55 WHEN 100 THEN k * 7 END::BIGINT AS "offset", CASE WHEN obj_number = 0 THEN 0::BIGINT END AS next_free, NULL::VARCHAR AS error FROM x)"""
_OUTLINE = f"""{_S}, t AS (
  SELECT path, k, name, '1' AS place, 1 AS level, 'Chapter ' || k AS title, 41::BIGINT AS obj, 1 AS page FROM s
  UNION ALL SELECT path, k, name, '1.1', 2, 'Part ' || name, 43, NULL FROM s UNION ALL SELECT path, k, name, '2', 1, 'Annex', 42, n FROM s)"""
_SIGNED = f"{_S}, g AS (SELECT path, k, n, name, CASE WHEN k % 4 = 0 THEN 'ETSI.CAdES.detached' ELSE 'adbe.pkcs7.detached' END AS sub_filter FROM s WHERE k % 2 = 0)"
_NOTES = f"""{_S}, c AS (SELECT path, (i + 1)::INTEGER AS page, i, k, n, unnest(CASE WHEN i = 0 THEN [0, 1, 2, 3, 4, 5, 6] ELSE [0, 1, 2] END)::INTEGER AS "at" FROM p)
, an AS (SELECT *, [101 + 10 * i, 102 + 10 * i, 103 + 10 * i, 104, 107, 108, 109]["at" + 1]::BIGINT AS obj, CASE WHEN "at" <> 2 THEN 'Link' WHEN i % 3 = 0 THEN 'Highlight' WHEN i % 3 = 1 THEN 'Text' ELSE 'Unknown' END AS subtype FROM c)"""

ORACLE_SQL = {
    "j01_form_fields": f"""{_S}
SELECT path, 'person.name' AS name, 'name' AS partial_name, 'text' AS type, name AS value, NULL AS default_value, NULL AS tooltip, true AS read_only, true AS required, CASE WHEN k % 2 = 1 THEN 'center' ELSE 'left' END AS justification, 40 AS max_length, 1 AS page, '[1,2,3,4]' AS rect FROM s
UNION ALL SELECT path, 'agree', 'agree', 'checkbox', '/Yes', NULL, 'Say yes', false, false, 'left', -1, NULL, NULL FROM s
UNION ALL SELECT path, 'seal', 'seal', 'signature', CASE WHEN k % 2 = 0 THEN '{{"ref":56}}' END, NULL, NULL, false, false, 'left', -1, n, '[7.5,8,5.25,6]' FROM s""",
    "j02_metadata": f"{_S} SELECT path, name AS Title, NULL AS Author, 'p' || k AS Producer, 8 AS total, 2 AS filled, 6 AS empty FROM s",
    "j03_outline": f"{_OUTLINE} SELECT path, place, level, title, obj, page FROM t",
    "j04_links": f"""{_NOTES} SELECT path, page, "at", CASE WHEN "at" IN (0, 3, 5) THEN 'url' ELSE 'internal' END AS kind, CASE "at" WHEN 0 THEN 'https://x.org/' || k || '/' || i WHEN 3 THEN 'https://y.org/' || k END AS url,
  CASE "at" WHEN 1 THEN (i + 1) % n + 1 WHEN 6 THEN n END AS target_page FROM an WHERE "at" <> 2""",
    "j05_fonts": f"{_FONTS} SELECT path, obj, base_font, subtype, encoding, file, embedded, status, to_unicode, name_family, name_weight, name_style, pages FROM f",
    "j06_pages": f"{_S} SELECT path, i + 1 AS page, 100 + 10 * i AS obj, CASE i WHEN 1 THEN 792e0 WHEN 2 THEN 100e0 ELSE 595.28e0 END AS width, CASE i WHEN 1 THEN 612e0 WHEN 2 THEN 100.3e0 ELSE 841.89e0 END AS height, CASE WHEN k % 2 = 1 THEN 90 ELSE 0 END AS rotation, CASE i WHEN 1 THEN 279.4e0 WHEN 2 THEN 35.28e0 ELSE 210e0 END AS width_mm, CASE i WHEN 1 THEN 'Letter' WHEN 2 THEN NULL ELSE 'A4' END AS size_name, CASE i WHEN 1 THEN 'landscape' WHEN 2 THEN 'square' ELSE 'portrait' END AS orientation, NULL AS error FROM p UNION ALL SELECT path, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'page tree enters an object again' FROM s WHERE k % 11 = 0",
    "j07_images": f"{_IMAGES} SELECT * EXCLUDE k FROM im",
    "j07_unique_images": f"{_IMAGES} SELECT path, width, height, filters, length, min(obj) AS obj, sum(occurrences)::BIGINT AS occurrences, any_value(pages) AS pages FROM im GROUP BY 1, 2, 3, 4, 5",
    "j08_annotations": f"{_NOTES} SELECT path, page, \"at\", obj, subtype, CASE WHEN \"at\" = 2 THEN '0.0,1.0,2.0,3.0,4.0,5.0,6.0,7.0' END AS quad_points, CASE WHEN \"at\" = 2 THEN '1.0,0.0,0.5' END AS color, CASE WHEN \"at\" = 2 THEN 4 ELSE 0 END AS flags, CASE WHEN \"at\" = 2 THEN 'note (' || i || ')' END AS contents, CASE WHEN \"at\" = 2 THEN 'by ' || i END AS author, CASE WHEN \"at\" = 2 THEN 'D:2025' END AS modified, CASE WHEN \"at\" = 2 THEN 'n' || k END AS name, CASE WHEN \"at\" IN (0, 3, 5) THEN 'URI' END AS action, CASE WHEN \"at\" = 0 THEN '0.0,0.0,10.0,10.0' END AS rect FROM an",
    "j09_signatures": f"{_SIGNED} SELECT path, 'seal' AS name, n AS page, 'Adobe.PPKLite' AS filter, sub_filter, '0,10,20,' || k AS byte_range, 4 AS contents_length, 'D:20240101' AS signed_at, name AS signer FROM g",
    "j10_attachments": f"""{_S} SELECT path, 62 AS obj, 'u.txt' AS name, 'text/plain' AS mime, 5 AS size, '0102FF' AS checksum, 'D:2024' AS modified FROM s
UNION ALL SELECT path, 65, 'b', 'text/plain', 5, '0102FF', 'D:2024' FROM s UNION ALL SELECT path, 66, 'c.bin', NULL, NULL, NULL, NULL FROM s""",
    "j10_objects_and_xref": f"""{_S} SELECT path, 1 AS obj, 'dict' AS kind, CASE WHEN k % 3 = 0 THEN 6 ELSE 5 END AS n_keys, 'inUse' AS xref_kind, 10 AS xref_offset FROM s
UNION ALL SELECT path, 2, 'dict', 4, 'inUse', 20 FROM s UNION ALL SELECT path, 90, 'array', NULL, NULL, NULL FROM s UNION ALL SELECT path, 100, 'dict', 5, 'inUse', k * 7 FROM s""",
    "j11_findings": f"""{_S} SELECT path, 'openaction' AS kind, 1 AS obj FROM s WHERE k % 3 = 0 UNION ALL SELECT path, 'embeddedfiles', unnest([1, 62, 63, 65, 66]) FROM s UNION ALL SELECT path, 'javascript', 80 FROM s UNION ALL SELECT path, 'uri', 85 FROM s""",
    "j12_xref": f"{_XREF} SELECT * FROM e",
    "j12_xref_streams": """WITH s AS (SELECT s_suppkey AS k, 'x' || s_suppkey || '.pdf' AS path FROM supplier), g AS (SELECT * FROM s WHERE k % 9 <> 8)
SELECT path, 0::BIGINT AS obj_number, 0::BIGINT AS gen, 'free' AS kind, NULL::BIGINT AS "offset", k % 7 AS next_free, NULL::BIGINT AS stream_obj, NULL::BIGINT AS stream_index, NULL::VARCHAR AS error FROM g
UNION ALL SELECT path, 1, 1, 'inUse', k + 300, NULL, NULL, NULL, NULL FROM g UNION ALL SELECT path, 3 + k % 3, 0, 'compressed', NULL, NULL, k % 9, k % 5, NULL FROM g UNION ALL SELECT path, 9, 0, 'inUse', 9, NULL, NULL, NULL, NULL FROM g
UNION ALL SELECT path, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'cross-reference stream without /W' FROM s WHERE k % 9 = 8""",
    "a05_compressed": "SELECT 'x' || s_suppkey || '.pdf' AS path, 2 AS inUse, 1 AS free, 1 AS compressed, s_suppkey + 300 AS max_offset FROM supplier WHERE s_suppkey % 9 <> 8",
    "j13_page_ops": f"{_OPS} SELECT * FROM ops",
    "k06_font_maps": f"{_S} SELECT path, 24 AS cmap, code::BIGINT AS code, chr(code::INTEGER) AS text FROM s, (SELECT 32 AS code UNION ALL SELECT unnest(range(65, 123)))",
    "k06_codes_without_text": f"{_S} SELECT path, 20 AS font, (48 + i)::BIGINT AS code, count(*) AS n FROM p WHERE i % 2 = 0 GROUP BY ALL",
    "k06_text": f"{_S} SELECT path, (i + 1)::INTEGER AS page, 1 AS line, 0e0 AS x, 0e0 AS y, 'Page ' || CASE WHEN i % 2 = 0 THEN chr(65533) ELSE i::VARCHAR END || 'ab' AS text FROM p",
    "j13_notes": f"{_S} SELECT path, i + 1 AS page, 105 + 10 * i AS obj, 'unsupported filter JPXDecode' AS note FROM p WHERE k % 7 = 3",
    "j14_scan": f"{_S} SELECT path, score, score >= 60 AS scanned FROM (SELECT path, greatest(0, 20 + CASE WHEN n <= 1 THEN 25 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 30 ELSE 0 END - 20) AS score FROM s)",
    "j15_encryption": f"WITH {_ALL} SELECT path, e AS encrypted, CASE WHEN e THEN 'Standard' END AS filter, CASE WHEN e THEN 2 END AS v, CASE WHEN e THEN 3 END AS r, CASE WHEN e THEN 128 END AS key_bits, CASE WHEN e THEN -k END AS p, CASE WHEN e THEN (u & 4) <> 0 ELSE true END AS print, CASE WHEN e THEN (u & 8) <> 0 ELSE true END AS modify, CASE WHEN e THEN (u & 2048) <> 0 ELSE true END AS print_high_quality FROM (SELECT *, k % 50 = 0 AS e, 4294967296 - k AS u FROM a)",
    "j15_unreadable": f"WITH {_ALL} SELECT path, NULL::BIGINT AS obj, 'encrypted' AS error FROM a WHERE k % 50 = 0 UNION ALL SELECT path, 97, 'object ends inside a value' FROM a WHERE k % 50 <> 0 AND k % 13 = 0",
    "j16_linearization": f"WITH {_ALL} SELECT path, k % 6 = 0 AS linearized, CASE WHEN k % 6 = 0 THEN k END AS L, CASE WHEN k % 6 = 0 THEN 10 END AS H_offset, CASE WHEN k % 6 = 0 THEN n END AS N, '%PDF-1.5' AS header, 1 AS eof_count FROM a",
    "a04_page_sizes": f"{_S}, z AS (SELECT path, CASE i WHEN 1 THEN 'Letter' WHEN 2 THEN 'Unknown' ELSE 'A4' END AS size, count(*) AS n, min(i) AS first FROM p GROUP BY 1, 2) SELECT path, size, n, row_number() OVER (PARTITION BY path ORDER BY n DESC, first) AS rank FROM z QUALIFY rank <= 3",
    "a05_xref_totals": f"{_XREF} SELECT path, count(*) FILTER (kind = 'inUse') AS inUse, count(*) FILTER (kind = 'free') AS free, 0 AS compressed, max(\"offset\") AS max_offset FROM e GROUP BY 1",
    "a06_link_counts": f"{_S} SELECT path, 2 * n + 4 AS links, n + 2 AS url, n + 2 AS internal, 0 AS unknown FROM s",
    "a07_font_counts": f"""{_FONTS} SELECT path, count(*) AS fonts, count(*) FILTER (embedded) AS embedded, count(*) FILTER (NOT embedded) AS not_embedded, count(*) FILTER (embedded IS NULL) AS unknown, count(*) FILTER (subtype = 'Type0') AS type0, count(*) FILTER (subtype = 'TrueType') AS truetype, count(*) FILTER (subtype = 'Type1') AS type1,
  count(*) FILTER (sub) AS subsets, count(*) FILTER (status = 'full') AS full_files, count(*) FILTER (status = 'subset') AS subset_files, count(*) FILTER (status = 'none') AS none_files, count(*) FILTER (to_unicode) AS to_unicode FROM f GROUP BY 1""",
    "a09_object_totals": f"""{_S}, b AS (SELECT path, k, n, n // 2 AS odd, CASE k % 7 WHEN 1 THEN 139 WHEN 2 THEN 143 ELSE 69 END AS own FROM s)
SELECT path, 6 + n + odd + (k % 3 = 0)::INTEGER AS streams, 3 + (n > 1)::INTEGER + (k % 2 = 0)::INTEGER + (k % 5 = 0)::INTEGER AS arrays, {20 + len(_CMAP)} + n * own + odd * 41 + (k % 3 = 0)::INTEGER AS stream_bytes, greatest(own, {len(_CMAP)}) AS largest, 1 AS scripts, 4 AS files, 2 + (k % 3 <> 0)::INTEGER + (k % 6 = 0)::INTEGER + (k % 2 = 1)::INTEGER AS orphans FROM b""",
    "a10_attachment_totals": f"{_S} SELECT path, 3 AS files, 2 AS with_mime, 10 AS bytes FROM s",
    "a11_signature_counts": f"{_SIGNED} SELECT path, 1 AS signatures, 1 AS with_range, (k % 4 = 0)::INTEGER AS etsi, (k % 4 <> 0)::INTEGER AS pkcs7 FROM g",
    "a12_annotation_counts": f"{_NOTES} SELECT path, count(*) AS annotations, count(*) FILTER (subtype = 'Highlight') AS highlight, count(*) FILTER (subtype = 'Text') AS text, 0 AS freetext, 0 AS ink FROM an GROUP BY 1",
    "a13_op_totals": f"{_OPS} SELECT path, count(DISTINCT page) AS pages, count(*) AS ops, count(*) FILTER (op IN ('Tj', 'TJ')) AS text, count(*) FILTER (op = 'Do') AS xobject, count(*) FILTER (op IN ('cm', 'q', 'Q', 're', 'W', 'n')) AS graphics, bool_or(op = 'INLINE_IMAGE') AS inline_images FROM ops GROUP BY 1",
    "a20_tree_count": f"{_S} SELECT path, 3 AS items, 2 AS depth FROM s",
    "f03_embedding_problems": f"{_FONTS} SELECT path, obj, status FROM f WHERE status IN ('none', 'unknown')",
    "f04_filled_fields": f"{_S} SELECT path, 'person.name' AS name, 'text' AS type FROM s UNION ALL SELECT path, 'agree', 'checkbox' FROM s UNION ALL SELECT path, 'seal', 'signature' FROM s WHERE k % 2 = 0",
    "f05_tree_filter": f"{_OUTLINE} SELECT path, place, title FROM t WHERE contains(name, '#00000000') AND place <> '2'",
}

#: Objects of every file: number, kind, type, subtype, action, whether scripts or files, condition to be there, condition to be reached, length of a stream.
_KNOWN = [
    (1, "dict", "Catalog", "", "", 0, 0, "true", "true", ""), (2, "dict", "Pages", "", "", 0, 0, "true", "true", ""), (3, "dict", "Pages", "", "", 0, 0, "true", "true", ""), (4, "dict", "", "", "", 0, 0, "true", "true", ""),
    (5, "dict", "", "", "", 0, 0, "k % 6 = 0", "false", ""), (20, "dict", "Font", "TrueType", "", 0, 0, "true", "true", ""), (21, "dict", "Font", "Type1", "", 0, 0, "true", "true", ""), (22, "dict", "FontDescriptor", "", "", 0, 0, "true", "true", ""),
    (23, "dict", "Font", "Type0", "", 0, 0, "true", "true", ""), (24, "stream", "", "", "", 0, 0, "true", "true", str(len(_CMAP))), (25, "dict", "Font", "CIDFontType2", "", 0, 0, "true", "true", ""), (26, "stream", "", "", "", 0, 0, "true", "true", "4"),
    (27, "dict", "FontDescriptor", "", "", 0, 0, "true", "true", ""), (30, "stream", "XObject", "Image", "", 0, 0, "true", "true", "4"), (31, "stream", "XObject", "Image", "", 0, 0, "true", "true", "4"), (40, "dict", "Outlines", "", "", 0, 0, "true", "true", ""),
    *[(i, "dict", "", "", "", 0, 0, "true", "true", "") for i in (41, 42, 43, 51, 53, 60, 61, 64, 70)], (52, "dict", "Annot", "Widget", "", 0, 0, "true", "true", ""), (55, "dict", "Annot", "Widget", "", 0, 0, "true", "true", ""),
    (56, "dict", "Sig", "", "", 0, 0, "true", "k % 2 = 0", ""), (57, "stream", "XObject", "Form", "", 0, 0, "true", "true", "3"), (58, "stream", "XObject", "Form", "", 0, 0, "k % 3 = 0", "true", "1"),
    *[(i, "dict", "Filespec", "", "", 0, 1, "true", "true", "") for i in (62, 65, 66)], (63, "stream", "EmbeddedFile", "text/plain", "", 0, 1, "true", "true", "5"), (80, "dict", "", "", "JavaScript", 1, 0, "true", "k % 3 = 0", ""),
    (85, "dict", "", "", "URI", 0, 0, "true", "true", ""), (86, "string", "", "", "", 0, 0, "true", "true", ""), (87, "array", "", "", "", 0, 0, "true", "true", ""), (88, "array", "", "", "", 0, 0, "true", "true", ""), (89, "array", "", "", "", 0, 0, "n > 1", "true", ""),
    (90, "array", "", "", "", 0, 0, "true", "false", ""), (91, "array", "", "", "", 0, 0, "k % 2 = 0", "true", ""), (92, "array", "", "", "", 0, 0, "k % 5 = 0", "true", ""), (99, "dict", "", "", "", 0, 0, "true", "false", ""),
    *[(i, "dict", "", "Link", "", 0, 0, "true", "true", "") for i in (104, 107, 108, 109)],
]
_OBJECTS = " UNION ALL ".join(
    f"SELECT path, {i} AS obj, '{kind}' AS kind, nullif('{type_}', '') AS type, nullif('{sub}', '') AS subtype, {length or 'NULL'} AS stream_length, nullif('{action}', '') AS action, {js} = 1 AS has_js, {file} = 1 AS has_file, {reached} AS reached FROM s WHERE {there}"
    for i, kind, type_, sub, action, js, file, there, reached, length in _KNOWN
)
_PAGE_OBJECTS = " UNION ALL ".join(
    f"SELECT path, {i} + 10 * i, '{kind}', {type_}, {sub}, {length}, NULL, false, false, true FROM p WHERE {there}"
    for i, kind, type_, sub, length, there in [
        (100, "dict", "'Page'", "NULL", "NULL", "true"), (101, "dict", "'Annot'", "'Link'", "NULL", "true"), (102, "dict", "NULL", "'Link'", "NULL", "true"), (103, "dict", "NULL", "['Highlight', 'Text', 'Odd'][i % 3 + 1]", "NULL", "true"),
        (105, "stream", "NULL", "NULL", "CASE k % 7 WHEN 1 THEN 139 WHEN 2 THEN 143 ELSE 69 END", "true"), (106, "stream", "NULL", "NULL", "41", "i % 2 = 1"),
    ]
)
ORACLE_SQL["j11_objects"] = f"{_S} {_OBJECTS} UNION ALL {_PAGE_OBJECTS}"

# Written files: m are sources with the number of their output and of their first page there; each is a page's size.
_MERGE = f"""{_S}, m AS (SELECT *, 'm' || k // 10 || '.pdf' AS out, k % 10 AS idx, CASE WHEN k % 50 = 0 THEN 0 ELSE n END AS pages FROM a)
, q AS (SELECT *, coalesce(sum(pages) OVER (PARTITION BY out ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS first FROM m)
, u AS (SELECT q.*, p.i, first + p.i AS page FROM q JOIN p USING (k))"""
_BOX = "CASE i WHEN 1 THEN 792e0 WHEN 2 THEN 100e0 ELSE 595.28e0 END AS width, CASE i WHEN 1 THEN 612e0 WHEN 2 THEN 100.3e0 ELSE 841.89e0 END AS height, CASE WHEN k % 2 = 1 THEN 90 ELSE 0 END AS rotation, NULL AS error"
_SPLIT = f"""{_S}, g AS (SELECT path, k, n, unnest(CASE WHEN k % 3 = 0 THEN CASE n WHEN 1 THEN [[1, 1]] WHEN 2 THEN [[1, 2]] ELSE [[1, 3]] END WHEN k % 3 = 1 THEN CASE n WHEN 1 THEN [[1, 1]] WHEN 2 THEN [[2, 2]] ELSE [[2, n]] END
  ELSE list_transform(range(1, n + 1), lambda j: [j, j]) END) AS r, unnest(range(CASE WHEN k % 3 = 2 THEN n ELSE 1 END)) AS j FROM s)
, h AS (SELECT path, k, n, j + 1 AS part, r[1] AS first, r[2] AS last, 's' || k || '_split_' || (j + 1) || '_p' || r[1] || CASE WHEN r[1] <> r[2] THEN '-' || r[2] ELSE '' END || '.pdf' AS out FROM g)
, v AS (SELECT h.*, i, i + 2 - first AS page FROM h JOIN p USING (k) WHERE i + 1 BETWEEN first AND last)"""
#: Objects that some pages of a file reach: c pages, d of them odd; e an even one, o an odd one, f the first, l the last is among them.
_REACHED = "c * 5 + d + e * (10 + (k % 2 = 0)::INTEGER) + o * 3 + f * 9 + l * (1 + (k % 2 = 0)::INTEGER + (k % 3 = 0)::INTEGER) + (f = 1 OR (l = 1 AND k % 3 = 0))::INTEGER"
_AMONG = "count(*) AS c, count(*) FILTER (i % 2 = 1) AS d, bool_or(i % 2 = 0)::INTEGER AS e, bool_or(i % 2 = 1)::INTEGER AS o, bool_or(i = 0)::INTEGER AS f, bool_or(i = n - 1)::INTEGER AS l"


def _fonts_sql(start: str, table: str, by: str) -> str:
    """Fonts of the pages of a table (k, i, page and more) by output."""
    some = f"string_agg(page::VARCHAR, ',' ORDER BY page) AS pages FROM {table}"
    return f"""{start} SELECT {by} AS path, 'ABCDEF+Arial-Bold' AS base_font, CASE WHEN k % 3 <> 0 THEN 'subset' ELSE 'none' END AS status, {some} WHERE i % 2 = 0 GROUP BY {by}, k
UNION ALL SELECT {by}, 'Noto-Italic', 'full', {some} WHERE i % 2 = 0 GROUP BY {by}, k UNION ALL SELECT {by}, 'Helvetica', 'unknown', {some} WHERE i % 2 = 1 GROUP BY {by}, k"""


_FIRST = "(SELECT out, arg_min(name, idx) AS name FROM q WHERE pages > 0 GROUP BY out)"
_CLEANED = "FROM (SELECT s.*, n // 2 AS odd FROM s)"
ORACLE_SQL |= {
    "j18_merge": f"{_MERGE} SELECT out AS path, page, {_BOX} FROM u",
    "j18_mapping": f"{_MERGE} SELECT out, idx, path, pages, first, first + pages - 1 AS last FROM q",
    "j18_metadata": f"{_MERGE} SELECT out AS path, name AS Title, NULL AS Author, NULL AS Subject, NULL AS Keywords, NULL AS Producer FROM {_FIRST}",
    "j18_custom_metadata": f"{_MERGE} SELECT out AS path, 'All' AS Title, NULL AS Author, NULL AS Subject, 'one two words three' AS Keywords, NULL AS Producer FROM {_FIRST}",
    "j18_xref": f"{_MERGE}, w AS (SELECT out, k, idx, {_AMONG} FROM u GROUP BY out, k, idx, n) SELECT out AS path, (3 + max(idx) + 1 + sum({_REACHED}))::BIGINT AS objects, (3 + max(idx) + 1 + sum({_REACHED}))::BIGINT AS right FROM w GROUP BY out",
    "j18_fonts": _fonts_sql(_MERGE, "u", "out"),
    "a18_merge_totals": f"{_MERGE} SELECT out, count(*) AS sources, sum(pages)::BIGINT AS pages, true AS all_bytes FROM q GROUP BY out",
    "j19_plan": f"{_SPLIT} SELECT out, path, part, first, last FROM h",
    "j19_split": f"{_SPLIT} SELECT out AS path, page, {_BOX} FROM v",
    "j19_fonts": _fonts_sql(_SPLIT, "v", "out"),
    "j19_xref": f"{_SPLIT}, w AS (SELECT out, k, {_AMONG} FROM v GROUP BY out, k, n) SELECT out AS path, 4 + {_REACHED} AS objects, 4 + {_REACHED} AS right FROM w",
    "j20_flatten": f"""{_OPS}, c AS (SELECT path, page, string_agg(trim(args || ' ' || op), ' ' ORDER BY "at") AS own FROM ops GROUP BY 1, 2)
, d AS (SELECT p.path, (i + 1)::INTEGER AS page, i, k, n, own, (i = 0)::INTEGER AS one, (i = n - 1 AND k % 3 = 0)::INTEGER AS two FROM p JOIN c ON c.path = p.path AND c.page = p.i + 1)
SELECT path, page, CASE WHEN one + two > 0 THEN 'q ' || own || ' Q' ELSE own END || CASE WHEN one = 1 THEN ' q 1 0 0 1 1 2 cm /FlatWidget-1 Do Q' ELSE '' END || CASE WHEN two = 1 THEN ' q 1 0 0 1 5.25 6 cm /FlatWidget-' || (one + 1) || ' Do Q' ELSE '' END AS content,
  CASE WHEN i % 2 = 0 THEN 2 ELSE 0 END + one + two AS drawings, CASE WHEN i = 0 THEN 7 ELSE 3 END AS annotations, 3 AS before, 0 AS after FROM d""",
    "j21_sanitize": f"""{_S} SELECT path, n AS pages, 3 * n + 6 AS annotations_removed, k % 3 = 0 AS open_action_removed, false AS catalog_aa_removed, true AS names_removed, true AS form_removed, true AS metadata_cleared, false AS rebuilt,
  8 + (k % 5 = 0)::INTEGER + 2 * n + odd + 9 + (k % 2 = 0)::INTEGER + 2 AS objects, 0 AS orphans, 0 AS findings, 0 AS annotations {_CLEANED}""",
    "j21_rebuild": f"""{_S} SELECT path, n AS pages, 3 * n + 6 AS annotations_removed, false AS open_action_removed, false AS catalog_aa_removed, false AS names_removed, false AS form_removed, true AS metadata_cleared, true AS rebuilt,
  4 + 2 * n + odd + 9 + (k % 2 = 0)::INTEGER + CASE WHEN n > 1 THEN 2 ELSE 0 END AS objects, 0 AS orphans, 0 AS findings, 0 AS annotations {_CLEANED}""",
}
