"""Merged, split and cleaned files, written and read again; queries over made files are in test_queries."""

import pytest

from ratiolake.sources import pdf
from ratiolake.sources import pdf_objects as po
from ratiolake.sources import pdf_reports as rep
from ratiolake.sources import pdf_writer as pw
from ratiolake.tables import written


def test_dictionaries_are_edited_as_they_stand():
    body = b"<< /A << /B [1 2] >> /B 5 0 R % note\n/C (x >> /D) /D /E /F <AB> >>"
    assert po.edited(body, ["B"], {}) == b"<< /A << /B [1 2] >> /C (x >> /D) /D /E /F <AB> >>"
    assert po.edited(body, ["A", "C", "D", "F"], {"B": "0", "G": "[7 0 R]"}) == b"<< /B 5 0 R /G [7 0 R] >>"
    assert po.edited(b"[1 2]", ["A"], {"B": "1"}) == b"[1 2]"
    assert po.renumbered(b"[1 0 R (1 0 R) 2 3 R /1]", {1: 9}) == b"[9 0 R (1 0 R) null /1]"
    assert po.references(b"<< /A 5 0 R /B [6 1 R 5 0 R (7 0 R)] >>") == [5, 6]


def test_values_as_text():
    value = {"A": [1, 2.5, -0.0000001, True, None, "/N(x", "t\u00e9(", {"ref": 3}], "ref": {"ref": 1}}
    text = po.written_as(value)
    assert po.parse(text.encode(), 0, [])[0] == {**value, "A": [1, 2.5, 0, True, None, "/N(x", "t\u00e9(", {"ref": 3}]}


def page(i, more=b""):
    return b"%d 0 obj << /Type /Page /Parent 2 0 R /Contents %d 0 R %s >> endobj\n%d 0 obj << /Length 1 >> stream\n%d\nendstream endobj\n" % (i, i + 1, more, i + 1, i % 10)


def file(*pages, more=b"", catalog=b"", info=b""):
    kids = b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(pages)))
    body = b"".join(page(10 + 2 * i, p) for i, p in enumerate(pages))
    return b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R " + catalog + b" >> endobj\n2 0 obj << /Type /Pages /MediaBox [0 0 9 9] /Kids [" + kids + b"] >> endobj\n" + body + more + b"trailer << /Root 1 0 R " + info + b" >>\n"


@pytest.fixture
def read(spark):
    def of(files):
        f = written(spark.createDataFrame(list(files.items()), "path string, content binary"), "test-files") if isinstance(files, dict) else written(files, "test-files")
        objs = written(po.objects(f), "test-objects").filter("error is null")
        return f, objs, rep.page_nodes(objs)

    return of


def test_merge(spark, read):
    shared = b"/Resources << /Font << /F 90 0 R >> >>"
    files = {
        "a": file(shared, shared, more=b"90 0 obj << /Type /Font /BaseFont /A >> endobj 91 0 obj << /Orphan true >> endobj\n92 0 obj << /Title ( T\351 ) /Keywords (x, y z,) /Producer (p) >> endobj\n", info=b"/Info 92 0 R", catalog=b"/OpenAction 91 0 R"),
        "b": b"trailer << /Encrypt 1 0 R >>",
        "c": file(b"/Annots [<< /Subtype /Link /Dest [10 0 R] >>]"),
    }
    f, o, n = read(files)
    sources = spark.createDataFrame([("x.pdf", 0, "b"), ("x.pdf", 1, "a"), ("x.pdf", 2, "c"), ("x.pdf", 3, "a"), ("y.pdf", 0, "b")], "out string, idx int, path string")
    some, mapping = pw.merged(f, o, n, sources)
    assert sorted(tuple(r) for r in mapping.collect()) == [("x.pdf", 0, "b", 0, 1, 0), ("x.pdf", 1, "a", 2, 1, 2), ("x.pdf", 2, "c", 1, 3, 3), ("x.pdf", 3, "a", 2, 4, 5), ("y.pdf", 0, "b", 0, 1, 0)]
    f2, o2, n2 = read(pw.whole(some))
    assert [(r.path, r.page, r.width) for r in rep.pages(n2).orderBy("page").collect()] == [("x.pdf", i, 9.0) for i in range(1, 6)]
    assert sorted((r.base_font, r.pages) for r in rep.fonts(o2, n2).collect()) == [("A", [1, 2]), ("A", [4, 5])]
    assert rep.inventory(o2).filter("not reached").count() == 0 and o2.filter("dict like '%Orphan%'").count() == 0
    m = rep.metadata(o2).first()
    assert (m.Title, m.Keywords, m.Producer) == ("T\u00e9", "x y z", None)
    assert [r.target_page for r in rep.links(rep.annotations(rep.page_annotations(o2, n2), o2), n2).collect()] == [3]
    data = f2.first().content
    entries = pdf.sections(bytes(data), int(bytes(data).rsplit(b"startxref", 1)[1].split()[0]))
    assert all(bytes(data)[e[3] :].startswith(b"%d 0 obj" % e[0]) for e in entries if e[2] == "inUse") and len(entries) == o2.count()
    assert rep.metadata(read(pw.whole(pw.merged(f, o, n, sources, "blank")[0]))[1]).first().Title is None
    with pytest.raises(ValueError):
        pw.merged(f, o, n, sources, "other")


def test_split_keeps_to_its_pages(spark, read):
    files = {"s.PDF": file(b"/Annots [<< /Subtype /Link /Dest [12 0 R] >>] /Resources 90 0 R", b"/Resources 90 0 R /Rotate 90", b"", more=b"90 0 obj << /Font << /F 91 0 R >> >> endobj 91 0 obj << /Type /Font /BaseFont /A >> endobj\n")}
    f, o, n = read(files)
    plan = pw.split_plan(n)
    assert sorted((r.out, r.first, r["last"]) for r in plan.collect()) == [("s_split_1_p1.pdf", 1, 1), ("s_split_2_p2.pdf", 2, 2), ("s_split_3_p3.pdf", 3, 3)]
    some = pw.split(f, o, n, plan)
    f2, o2, n2 = read(pw.whole(some))
    assert sorted((r.path, r.base_font) for r in rep.fonts(o2, n2).collect()) == [("s_split_1_p1.pdf", "A"), ("s_split_2_p2.pdf", "A")]
    assert {r.path: r.n for r in o2.groupBy("path").count().withColumnRenamed("count", "n").collect()} == {"s_split_1_p1.pdf": 9, "s_split_2_p2.pdf": 9, "s_split_3_p3.pdf": 7}
    assert [(r.page, r.rotation) for r in rep.pages(n2).filter("path like '%p2.pdf'").collect()] == [(1, 90)]
    assert all(r.bytes == len(x.content) for r in pw.split_report(some, plan).collect() for x in f2.collect() if x.path == r.out)
    ten = spark.createDataFrame([("s.PDF", [(i % 3 + 1, i % 3 + 1) for i in range(10)])], "path string, ranges array<struct<first:int,last:int>>")
    assert sorted(r.out for r in pw.split_plan(n, ten, " cut ").collect())[0] == "s_cut_01_p1.pdf" and "s_cut_3_p3.pdf" in {r.out for r in pw.split_plan(n, ten, "cut", pad=False).collect()}


def test_sanitize_and_flatten(spark, read):
    catalog = b"/AcroForm << /Fields [90 0 R] >> /OpenAction 95 0 R /AA << /WC 95 0 R >> /Metadata 96 0 R"
    widgets = (
        b"90 0 obj << /FT /Btn /T (b) /V /Yes /Subtype /Widget /Rect [9 8 1 2] /AP << /N << /Yes 91 0 R /Off 92 0 R >> >> >> endobj 91 0 obj << /Length 0 >> stream\n\nendstream endobj\n92 0 obj << /Length 0 >> stream\n\nendstream endobj\n"
        b"93 0 obj << /Subtype /Widget /Rect [-1 0.25 3 3] >> endobj 95 0 obj << /S /JavaScript /JS (x) >> endobj 96 0 obj << /Length 1 /Type /Metadata >> stream\nm\nendstream endobj\n"
    )
    f, o, n = read({"a": file(b"/Annots [90 0 R 93 0 R << /Subtype /Text >>] /AA << /O 95 0 R >> /Resources << /XObject << /Im 91 0 R >> >>", b"", catalog=catalog, more=widgets)})
    some, report = pw.sanitized(f, o, n, rebuild=False)
    assert report.first().asDict() == {"path": "a", "pages": 2, "annotations_removed": 3, "open_action_removed": True, "catalog_aa_removed": True, "names_removed": False, "form_removed": True, "metadata_cleared": True, "rebuilt": False}
    _, o2, _ = read(pw.whole(some))
    assert o2.filter("dict like '%JavaScript%' or dict like '%Widget%' or dict like '%/Metadata%'").count() == 0
    kept, report = pw.sanitized(f, o, n, rebuild=False, annotations=False, actions=False, form=False, metadata=False)
    assert read(pw.whole(kept))[1].filter("dict like '%JavaScript%' or dict like '%Widget%'").count() == 3 and not report.first().open_action_removed
    f3, o3, n3 = read(pw.whole(pw.flattened(f, o, n)))
    ops = [(r.op, r.args) for r in rep.page_ops(f3, o3, n3).filter("page = 1").orderBy("at").collect()]
    assert ops == [("q", ""), ("Q", "0"), ("q", ""), ("cm", "1 0 0 1 1 2"), ("Do", "/FlatWidget-1"), ("Q", "")]
    assert {r.name for r in rep.page_resources(o3, n3, "XObject").collect()} == {"Im", "FlatWidget-1"}
    assert [r.dict for r in rep.page_annotations(o3, n3).collect()] == ['{"Subtype":"/Text"}'] and rep.form_fields(o3, rep.page_annotations(o3, n3)).count() == 0
