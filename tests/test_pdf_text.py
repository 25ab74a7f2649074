"""Maps of codes, and where text is shown."""

import math

from ratiolake.sources import pdf_objects as po
from ratiolake.sources import pdf_reports as rep
from ratiolake.sources import pdf_text as pt
from ratiolake.tables import written

MAP = b"""/CIDInit /ProcSet findresource begin 1 begincodespacerange <0000> <FFFF> endcodespacerange
2 beginbfchar <0001> <00660069> <0003> <D83DDE00> endbfchar
3 beginbfrange <0010> <0012> <0041> <0020> <0022> [<0078> <0079007A> <0031>] <0030> <002F> <0041> endbfrange
1 beginbfrange <00F0><0210><0100> endbfrange endcmap"""


def test_maps():
    assert list(pt.map_ranges(MAP)) == [(1, 1, "fi"), (3, 3, "\U0001f600"), (16, 18, "A"), (32, 32, "x"), (33, 33, "yz"), (34, 34, "1"), (240, 528, "Ā")]
    assert list(pt.map_ranges(b"1 beginbfchar <1> <0041> endbfchar beginbfrange <2>")) == [(16, 16, "A")] and list(pt.map_ranges(b"")) == []


def ops(text):
    return list(rep.content_ops(text.encode()))


def test_places_are_products_of_matrices():
    got = list(pt.shown(ops("q 2 0 0 2 10 20 cm BT /F1 9 Tf 1 0 0 1 5 6 Tm (a) Tj (b) Tj 0 -3 Td [(c) -5 (d)] TJ ET Q BT 14 TL /F2 8 Tf 7 8 Td (e) Tj T* (f) Tj (g) ' 1 2 (h) \" ET Q (z) Tj")))
    assert [(r[1], r[2], r[3], r[4], r[5], r[6]) for r in got] == [
        (1, "F1", 9, 20, 32, b"a"), (1, "F1", 9, 20, 32, b"b"), (2, "F1", 9, 20, 26, b"cd"), (3, "F2", 8, 7, 8, b"e"),
        (4, "F2", 8, 7, -6, b"f"), (5, "F2", 8, 7, -20, b"g"), (6, "F2", 8, 7, -34, b"h"), (6, "F2", 8, 7, -34, b"z"),
    ]
    a = math.pi / 6
    turned = list(pt.shown(ops(f"{math.cos(a):.9f} {math.sin(a):.9f} {-math.sin(a):.9f} {math.cos(a):.9f} 1 2 cm BT 1 0 0 1 10 0 Tm 0 4 TD (x) Tj T* (y) Tj ET")))
    for r, (x, y) in zip(turned, ((10, 4), (10, 8)), strict=True):
        assert math.isclose(r[4], 1 + x * math.cos(a) - y * math.sin(a), abs_tol=1e-6) and math.isclose(r[5], 2 + x * math.sin(a) + y * math.cos(a), abs_tol=1e-6)


def test_text_of_pages(spark):
    content = b"BT /F 9 Tf 1 0 0 1 50 700 Tm <000100100003> Tj 1 0 0 1 10 700 Tm <00F10099> Tj /G 9 Tf 0 -20 Td (p\\351\\)) Tj ET"
    file = (
        b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Type /Pages /Kids [3 0 R] >> endobj 3 0 obj << /Type /Page /Contents 4 0 R /Resources << /Font << /F 5 0 R /G 6 0 R >> >> >> endobj\n"
        b"4 0 obj << /Length %d >> stream\n%s\nendstream endobj 5 0 obj << /Type /Font /Subtype /Type0 /ToUnicode 7 0 R >> endobj 6 0 obj << /Type /Font /Subtype /Type1 >> endobj\n"
        b"7 0 obj << /Length %d >> stream\n%s\nendstream endobj 8 0 obj << /Type /Font /ToUnicode 9 0 R >> endobj 9 0 obj << /Filter /Crypt /Length 1 >> stream\nx\nendstream endobj trailer << /Root 1 0 R >>"
    ) % (len(content), content, len(MAP), MAP)
    files = spark.createDataFrame([("p", file)], "path string, content binary")
    objs = written(po.objects(files), "test-objects")
    nodes, maps = rep.page_nodes(objs), pt.font_maps(files, objs)
    codes = pt.shown_codes(pt.shown_strings(rep.page_ops(files, objs, nodes)), objs, nodes)
    assert [(r.line, r.x, r.y, r.text) for r in pt.text_runs(codes, maps).orderBy("line", "x").collect()] == [(1, 10.0, 700.0, f"ā{pt.UNKNOWN}"), (1, 50.0, 700.0, "fiA\U0001f600"), (2, 10.0, 680.0, "pé)")]
    assert [tuple(r) for r in pt.codes_without_text(codes, maps).collect()] == [("p", 5, 0x99, 1)]
    assert {(r.code, r.text) for r in pt.code_texts(maps).filter("code between 17 and 33 or code > 527").collect()} == {(17, "B"), (18, "C"), (32, "x"), (33, "yz"), (528, chr(0x100 + 528 - 240))}
