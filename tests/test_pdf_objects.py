import zlib

from ratiolake.sources import pdf
from ratiolake.sources import pdf_objects as po
from ratiolake.sources import pdf_reports as rep
from ratiolake.tables import written


def make():
    font = b"6 0 obj << /Type /Font /Subtype /TrueType /BaseFont /ABCDEF+Arial-Bold /FontDescriptor 7 0 R /ToUnicode 8 0 R >> endobj\n"
    inner = b"20 0 21 33 << /T (Name) /FT /Tx /Ff 3 /V (x) >> << /Type /Orphan >>"
    first = inner.index(b"<<")
    inner = b"20 0 21 " + str(inner.index(b"<< /Type /Orphan") - first).encode() + b" " + inner[first:]
    first = inner.index(b"<<")
    packed = zlib.compress(inner)
    return (
        b"%PDF-1.7\n1 0 obj << /Type /Catalog /Pages 2 0 R /AcroForm << /Fields [20 0 R] >> >> endobj\n"
        b"2 0 obj << /Type /Pages /Kids [3 0 R 10 0 R] /MediaBox [0 0 595.28 841.89] /Rotate -90 >> endobj\n"
        b"3 0 obj << /Type /Page /Parent 2 0 R /Annots [4 0 R 5 0 R 9 0 R] /Resources << /Font << /F1 6 0 R >> >> >> endobj\n"
        b"4 0 obj << /Type /Annot /Subtype /Link /A << /S /URI /URI (http://a\\)b) >> >> endobj\n"
        b"5 0 obj << /Subtype /Link /Dest [11 0 R /Fit] >> endobj\n9 0 obj << /Subtype /Widget >> endobj\n" + font + b"7 0 obj << /FontFile2 12 0 R >> endobj\n8 0 obj << /Length 3 >> stream\nabc\nendstream endobj\n"
        b"10 0 obj << /Type /Pages /Kids [11 0 R] /Rotate 0 >> endobj\n11 0 obj << /Type /Page /MediaBox [0 0 792 612] /Annots 14 0 R >> endobj\n14 0 obj [15 0 R] endobj\n15 0 obj << /Subtype /Highlight /Contents (n) >> endobj\n"
        b"12 0 obj << /Length 4 /Type /XObject /Subtype /Image /Width 3 /Height 2 /Filter [/DCTDecode] >> stream\nendo\nendstream endobj\n"
        b"13 0 obj << /Title (  T\\351 ) /Author () /Producer <FEFF00e9> >> endobj\n16 0 obj << /ByteRange [0 1 2 3] /SubFilter /ETSI.CAdES >> endobj\n17 0 obj << /S /JavaScript /JS (x) >> endobj\n"
        b"18 0 obj << /Type /Filespec /F (a.txt) /EF << /F 8 0 R >> >> endobj\n"
        b"19 0 obj << /Type /ObjStm /N 2 /First " + str(first).encode() + b" /Filter /FlateDecode /Length " + str(len(packed)).encode() + b" >> stream\n" + packed + b"\nendstream endobj\ntrailer << /Root 1 0 R /Info 13 0 R /Size 30 >>\nstartxref\n0\n%%EOF"
    )


def test_tables_of_objects(spark, tmp_path):
    noisy = b"%PDF-1.4\n1 0 obj << /Type /Catalog /Note (see /Encrypt) >> endobj\n2 0 obj << /Length 22 >> stream\n/Encrypt trailer << >>\n\nendstream endobj\ntrailer << /Root 1 0 R >>\n"
    files = {"a.pdf": make(), "b.pdf": b"1 0 obj << /A 1 >> endobj trailer << /Encrypt 2 0 R >>", "c.pdf": b"5 0 obj << /A [ endobj", "d.pdf": noisy}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    objs = written(po.objects(pdf.read_files(spark, str(tmp_path))), "test-objects")
    errors = {r.path[-5:]: r.error for r in objs.filter("error is not null").collect()}
    assert set(errors) == {"b.pdf", "c.pdf"} and errors["b.pdf"] == "encrypted"
    assert objs.filter("path like '%c.pdf' and error is not null").first().obj == 5
    objs = objs.filter("error is null and path like '%a.pdf'")
    nodes = rep.page_nodes(objs)
    p = rep.pages(nodes)
    assert [(r.page, r.obj, r.width, r.rotation, r.size_name, r.orientation, r.width_mm) for r in p.orderBy("page").collect()] == [(1, 3, 595.28, 270, "A4", "portrait", 210.0), (2, 11, 792.0, 0, "Letter", "landscape", 279.4)]
    m = rep.metadata(objs).first()
    assert (m.Title, m.Author, m.Producer, m.Creator) == ("Té", None, "é", None)
    notes = rep.annotations(rep.page_annotations(objs, nodes), objs)
    assert sorted((r.page, r.kind, r.url, r.target_page) for r in rep.links(notes, nodes).collect()) == [(1, "internal", None, 2), (1, "url", "http://a)b", None)]
    assert {(r.page, r.subtype) for r in notes.collect()} == {(1, "Link"), (2, "Highlight")}
    f = rep.fonts(objs, nodes).first()
    assert (f.base_font, f.embedded, f.status, f.file, f.to_unicode, f.name_family, f.name_subset, f.name_weight, f.pages) == ("ABCDEF+Arial-Bold", True, "subset", "FontFile2", True, "Arial", True, "bold", [1])
    inv = {r.obj: r for r in rep.inventory(objs).collect()}
    assert inv[17].has_js and not inv[17].reached and not inv[21].reached and inv[20].reached and inv[12].reached and inv[15].reached
    assert inv[14].kind == "array" and inv[8].kind == "stream" and inv[2].n_keys == 4


def chain(n, last):
    """A page tree that is n levels deep; its last node has one page and the object `last`."""
    body = b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n"
    for i in range(2, n + 2):
        kids = b"%d 0 R" % (i + 1) if i < n + 1 else b"9000 0 R %d 0 R" % last
        body += b"%d 0 obj << /Type /Pages /Kids [%s] >> endobj\n" % (i, kids)
    return body + b"9000 0 obj << /Type /Page /MediaBox [0 0 9 9] >> endobj\ntrailer << /Root 1 0 R >>\n"


def test_deep_and_cyclic_trees(spark):
    files = spark.createDataFrame([("deep", chain(12, 9000)), ("cycle", chain(3, 2))], "path string, content binary")
    nodes = rep.page_nodes(written(po.objects(files), "test-objects"))
    assert sorted((r.path, r.page, r.error) for r in rep.pages(nodes).filter("page is not null").collect()) == [("cycle", 1, None), ("deep", 1, None)]
    assert sorted((r.path, r.error) for r in rep.pages(nodes).filter("page is null").collect()) == [(p, "page tree enters an object again") for p in ("cycle", "deep")]


def test_long_chains_are_reached_to_the_end(spark):
    nodes = spark.range(30).selectExpr("'p' as path", "id as obj")
    edges = spark.range(29).selectExpr("'p' as path", "id as a", "id + 1 as b").unionByName(spark.createDataFrame([("p", 29, 3)], "path string, a long, b long"))
    assert rep.reachable(nodes, edges, nodes.filter("obj = 5")).count() == 27


def test_large_tables_and_older_sections():
    n = 120_000  # more than the 2 MB that a window once had
    table = b"xref\n0 %d\n" % n + b"".join(b"%010d 00000 n \n" % i for i in range(n)) + b"trailer << /Prev 0 >>\nstartxref\n"
    old = b"xref\n0 1\n0000000000 65535 f \n%d 1\n0000000077 00000 n \ntrailer << /Size 1 >>\nstartxref\n" % (n + 5)
    found = pdf.sections(old + table, len(old))
    assert len(found) == n + 1 and found[0][3] == 0 and found[-1][:4] == (n + 5, 0, "inUse", 77)


def test_content_operators():
    data = b"q (a (b) \\) c) Tj % no Tj\n[1 (x)] TJ << /A 1 >> BDC /Im1 Do BI /W 1 ID Tj EI -1.5 .5 m Q"
    assert list(rep.content_ops(data)) == [("q", ""), ("Tj", "(a (b) \\) c)"), ("TJ", "[ 1 (x) ]"), ("BDC", "<< /A 1 >>"), ("Do", "/Im1"), ("INLINE_IMAGE", "/W 1"), ("m", "-1.5 .5"), ("Q", "")]
    assert len(list(rep.content_ops(data, 2))) == 2


def test_kids_that_are_listed_again_do_not_multiply_pages(spark):
    levels = b"".join(b"%d 0 obj << /Type /Pages /Kids [%d 0 R %d 0 R] >> endobj\n" % (i, i + 1, i + 1) for i in range(2, 32))
    body = b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n" + levels + b"32 0 obj << /Type /Page >> endobj\ntrailer << /Root 1 0 R >>\n"
    nodes = rep.page_nodes(written(po.objects(spark.createDataFrame([("p", body)], "path string, content binary")), "test-objects"))
    assert sorted((r.page or 0, r.obj, r.error) for r in nodes.collect()) == [(0, None, "page tree enters an object again"), (1, 32, None)]


def test_a_broken_object_leaves_the_others(spark):
    body = b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 7 0 obj << /A [ << >> endobj 8 0 obj ( ] endobj\n2 0 obj << /Type /Pages /Kids [3 0 R] >> endobj 3 0 obj << /Type /Page >> endobj 9 0 obj << /Type /ObjStm /Filter /JPXDecode /First 4 >> stream\nx\nendstream endobj trailer << /Root 1 0 R >>"
    found = {x.obj: x.error for x in po.objects_in(body)}
    assert found[7] == "object ends inside a value" and found[9] == "unsupported filter JPXDecode" and found[2] is found[3] is None
    assert rep.page_nodes(written(po.objects(spark.createDataFrame([("p", body)], "path string, content binary")).filter("error is null"), "test-objects")).count() == 1


def test_linearization_dictionaries_of_any_size(spark):
    before, after = b"/Pad (" + b"x" * 9000 + b") ", b" /Pad2 (" + b"y" * 9000 + b")"
    rows = [("big", b"%PDF-1.4\n5 0 obj << " + before + b"/Linearized 1" + after + b" /N 7 >> endobj"), ("open", b"5 0 obj << /Linearized 1 /N 7"), ("other", b"1 0 obj << /A 1 >> /Linearized 1 >> endobj")]
    got = {r.path: (r.linearized, r.N) for r in pdf.linearization(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {"big": (True, 7), "open": (False, None), "other": (False, None)}


def test_values_behind_references(spark):
    body = (
        b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Type /Pages /Kids 4 0 R /MediaBox 5 0 R >> endobj 4 0 obj [3 0 R] endobj 5 0 obj [0 0 9 9] endobj\n"
        b"3 0 obj << /Type /Page /Annots [6 0 R 7 0 R << /Subtype /Link /A << /S /URI >> >> << /Subtype /Link /Dest 10 0 R >> << /Subtype /Link /A << /S /Launch >> >> << /Subtype /Link >> << /Subtype /Link /A 99 0 R /Dest (x) >>]"
        b" /Resources << /Font << /F 20 0 R >> >> >> endobj 6 0 obj << /Subtype /Link /A 9 0 R /C 11 0 R /Contents 12 0 R >> endobj 7 0 obj << /Subtype /Link /Dest (name) >> endobj\n"
        b"9 0 obj << /S /URI /URI (http://a) >> endobj 10 0 obj [3 0 R /Fit] endobj 11 0 obj [0.5] endobj 12 0 obj (said) endobj\n"
        b"20 0 obj << /Type /Font /Subtype /Type0 /BaseFont /X /DescendantFonts 21 0 R >> endobj 21 0 obj [22 0 R] endobj 22 0 obj << /FontDescriptor 23 0 R >> endobj 23 0 obj << /FontFile3 24 0 R >> endobj trailer << /Root 1 0 R >>"
    )
    objs = written(po.objects(spark.createDataFrame([("p", body)], "path string, content binary")), "test-objects")
    nodes = rep.page_nodes(objs)
    notes = rep.annotations(rep.page_annotations(objs, nodes), objs)
    assert [tuple(r)[2:] for r in rep.links(notes, nodes).orderBy("at").collect()] == [(0, "url", "http://a", None), (1, "internal", None, None), (2, "url", None, None), (3, "internal", None, 1), (4, "unknown", None, None), (6, "internal", None, None)]
    first = notes.filter("at = 0").first()
    assert (first.color, first.contents) == ([0.5, 0.5, 0.5], "said")
    assert [(r.status, r.file) for r in rep.fonts(objs, nodes).collect()] == [("full", "FontFile3")]
    assert [(r.page, r.width) for r in rep.pages(nodes).collect()] == [(1, 9.0)]


def bookmarks(tree, more=b""):
    """A file with a tree of bookmarks, as lists of (title, below); objects are numbered depth first from 10."""
    out, number = [], [10]

    def chain(items):
        first = above = None
        for title, below in items:
            obj = number[0]
            number[0] += 1
            out.append([obj, title, None, None])
            mine = out[-1]
            first = first or obj
            if above is not None:
                above[3] = obj
            above = mine
            mine[2] = chain(below)
        return first

    first = chain(tree)
    body = b"".join(b"%d 0 obj << /Title (%s)%s%s >> endobj\n" % (o, t.encode(), b" /First %d 0 R" % f if f else b"", b" /Next %d 0 R" % n if n else b"") for o, t, f, n in out)
    return b"1 0 obj << /Type /Catalog /Outlines 2 0 R >> endobj 2 0 obj << /First %d 0 R >> endobj\n" % (first or 99) + body + more + b"trailer << /Root 1 0 R >>"


def numbered(tree, above=""):
    for i, (title, below) in enumerate(tree, 1):
        yield f"{above}{i}", title
        yield from numbered(below, f"{above}{i}.")


def test_outlines_of_any_shape(spark):
    deep = []
    for i in range(40):
        deep = [(f"d{i}", deep), (f"e{i}", [])]
    trees = {"deep": deep, "long": [(f"t{i}", [("u", [])] if i % 50 == 0 else []) for i in range(700)], "none": []}
    ring = b"900 0 obj << /Title (r) /Next 901 0 R >> endobj 901 0 obj << /Title (s) /Next 900 0 R >> endobj 902 0 obj << /Title (self) /Next 902 0 R >> endobj\n"
    files = [(k, bookmarks(t, ring)) for k, t in trees.items()]
    files.append(("again", b"1 0 obj << /Type /Catalog /Outlines << /First 3 0 R >> >> endobj 3 0 obj << /Title (a) /First 4 0 R /Next 4 0 R >> endobj 4 0 obj << /Title (b) /Next 3 0 R /First 3 0 R >> endobj trailer << /Root 1 0 R >>"))
    objs = written(po.objects(spark.createDataFrame(files, "path string, content binary")), "test-objects")
    got = {}
    for r in rep.outline(objs, rep.page_nodes(objs)).collect():
        assert r.level == r.place.count(".") + 1
        got.setdefault(r.path, set()).add((r.place, r.title))
    assert got == {"deep": set(numbered(deep)), "long": set(numbered(trees["long"])), "again": {("1", "a"), ("1.1", "b")}}
