import zlib

import pytest
from pyspark.sql import functions as F

from ratiolake.functions import arith, lists, numbers
from ratiolake.functions import text as tx
from ratiolake.operators import relational, stats, translation
from ratiolake.sources import pdf, xliff


def one(spark, columns, **values):
    """The results of column expressions over one row of doubles."""
    row = spark.range(1).select(*[F.lit(v).cast("double" if not isinstance(v, str) else "string").alias(k) for k, v in values.items()])
    return row.select(*[c.alias(k) for k, c in columns.items()]).first()



GOLDENS = [
    (lambda A, B: arith.of_total(A, B)["percent"], [(25, 200, 12.5), (50, 80, 62.5), (300, 1200, 25), (5, 0, None), (None, 3, None)]),
    (lambda A, B: arith.applied_rate(A, B)["rate"], [(80, 100, 25), (1200, 1110, -7.5), (5000, 4900, -2), (0, 1, None)]),
    (lambda A, B: arith.error(A, B)["percent"], [(102, 100, 2), (98, 100, 2), (45, 60, 25), (1, 0, None)]),
    (lambda A, B: arith.points(A, B)["percent"], [(10, 12, 20), (50, 40, -20), (2, 3, 50), (0, 3, None)]),
    (lambda A, B: arith.difference_to(A, B, F.lit("a"))["percent"], [(80, 100, 25), (100, 80, -20), (1200, 1110, -7.5)]),
    (lambda A, B: arith.difference_to(A, B, F.lit("b"))["percent"], [(80, 100, 20)]),
    (lambda A, B: arith.relative_difference(A, B)["percent"], [(98, 102, 4), (-12, 8, 200), (0, 0, None)]),
    (lambda A, B: arith.reverse(A, B)["base"], [(80, -20, 100), (110, 10, 100), (255, -15, 300), (500, 25, 400), (1, -100, None)]),
    (lambda A, B: arith.limits(A, B)["percent"], [(100, 0, -100), (100, 50, -50), (50, 100, 100), (1, 100, 9900), (0, 10, None)]),
    (lambda A, B: arith.cumulative_or_naive(F.lit(1000.0), A, B)["compounded"], [(10, 10, 1210), (20, -20, 960)]),
    (lambda A, B: arith.rule_of_three(A, B, F.lit(4.0))["x"], [(10, 25, 10), (0, 1, None)]),
    (lambda A, B: arith.inverse_rule_of_three(A, B, F.lit(5.0))["x"], [(10, 20, 40)]),
    (lambda A, B: numbers.best_fraction(A / B)["den"], [(1, 8, 8), (1, 3, 3), (0, 3, 1), (-2, 6, 3)]),
    (lambda A, B: numbers.percent_to_fraction(A * B)["num"], [(12.5, 1, 1), (50, 1, 1), (0, 1, 0), (-75, 1, -3)]),
    (lambda A, B: numbers.compare(A, B, F.lit(1.0), F.lit(2.0)), [(1, 3, -1), (2, 4, 0), (-3, -4, 1), (1, 0, None)]),
    (lambda A, B: numbers.significant(A, B), [(123456, 3, 123000), (0.0012345, 2, 0.0012), (0, 2, 0), (-2.5, 1, -3)]),
    (lambda A, B: numbers.truncate(A, B), [(1.239, 2, 1.23), (-1.239, 2, -1.23)]),
]


@pytest.mark.parametrize("case", range(len(GOLDENS)))
def test_goldens(spark, case):
    tool, rows = GOLDENS[case]
    df = spark.createDataFrame([tuple(None if x is None else float(x) for x in r) for r in rows], "a double, b double, want double")
    for r in df.select("want", tool(F.col("a"), F.col("b")).cast("double").alias("got")).collect():
        assert r.got == (None if r.want is None else pytest.approx(r.want, abs=1e-9))


def test_exact_formats(spark):
    rows = [(1.005, 2, "1.00"), (0.125, 2, "0.13"), (-2.5, 0, "-3"), (1e21, 1, "1000000000000000000000.0"), (None, 2, None), (0.1 + 0.2, 6, "0.300000")]
    got = spark.createDataFrame(rows, "x double, p int, want string").select("want", numbers.to_fixed("x", "p").alias("got"), numbers.signed_fixed(F.col("x"), F.col("p")).alias("s")).collect()
    assert all(r.got == r.want for r in got)
    assert [r.s for r in got][:3] == ["+1.00", "+0.13", "-3"]


def test_lists(spark):
    df = spark.createDataFrame([([10.0, 10.0], [20.0, 30.0, 50.0], [25.0, 75.0], [10.0, 20.0, 30.0], [25.0, 50.0, None]), ([20.0, -20.0], [], [], [0.0, 1.0], [1.0, 1.0])], "p array<double>, c array<double>, v array<double>, r1 array<double>, r2 array<double>")
    got = df.select(lists.equivalent(F.lit(None).cast("double"), F.col("p"))["percent"].alias("e"), lists.composition(F.lit(1000.0), F.col("c"))["amount"].alias("c"), lists.parts(F.col("v"))["first_percent"].alias("f"), *[c.alias(f"t_{k}") for k, c in lists.table_complete(F.col("r1"), F.col("r2")).items()], lists.table_check(F.col("r1"), F.col("r2"))["code"].alias("check")).collect()
    assert [r.e for r in got] == [pytest.approx(21), pytest.approx(-4)]
    assert got[0].c == pytest.approx(30) and got[0].f == 25 and got[1].f is None
    assert (got[0].t_code, got[0].t_row, got[0].t_at, got[0].t_value, got[0].check) == ("ok", 2, 3, 75, "ok")
    assert (got[1].t_code, got[1].check) == ("div0", "div0")


def test_statistics(spark):
    df = spark.createDataFrame([("a", float(x), float(w)) for x, w in [(10, 2), (12, 5), (14, 3)]] + [("b", 2.0, 1.0), ("b", 10.0, 1.0), ("b", 4.0, 1.0), ("b", 8.0, 1.0), (None, 5.0, 1.0), ("c", None, 1.0)], "g string, x double, w double")
    assert {r.g: r.weighted_median for r in stats.weighted_median(df, "g", "x", "w").collect()} == {"a": 12, "b": 4, None: 5}
    d = {r.g: r for r in stats.describe(df, "g", "x", 0.25).collect()}
    assert d["b"].median == 6 and d["b"].trimmed_mean == 6 and d["b"].winsorized_mean == 6 and d[None].median == 5
    m = stats.moving_average(spark.createDataFrame([(i, float(v)) for i, v in enumerate([10, 13, 9, 12, 11])], "i int, v double").withColumn("g", F.lit(1)), "g", ["i"], "v", 3).orderBy("i").collect()
    assert [r.moving_average and round(r.moving_average, 2) for r in m] == [None, None, 10.67, 11.33, 10.67]


def casing(text, mode):
    low = text.lower()
    if mode == "invert":
        return "".join(c.lower() if c == c.upper() != c.lower() else c.upper() if c == c.lower() != c.upper() else c for c in text)
    out, cap = "", True
    for i, c in enumerate(low):
        if mode == "title":
            cap = i == 0 or low[i - 1].isspace() or low[i - 1] in "-’'(\""
        if cap and c.isalpha():
            out, cap = out + c.upper(), False
            continue
        out += c
        if mode == "sentence" and c in ".!?…\n":
            cap = True
    return out


def test_casing(spark, sf):
    texts = ["bonjour tout le monde", "hello-world_from tools", "uNe CaSSe bIzArRe", "ceci est une phrase. en voici une autre !", "日本語 ひらがな", "straße “x” …ça", ""]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(50).collect()]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    for r in df.select("t", tx.invert_case(t).alias("invert"), tx.sentence_case(t).alias("sentence"), tx.title_case(t).alias("title")).collect():
        for mode in ("invert", "sentence", "title"):
            assert r[mode] == casing(r.t, mode), (mode, r.t[:80])
    local = {"tr": ("istanbul I i", "İSTANBUL I İ"), "el": ("Ελλάδα ίσως ϋ", "ΕΛΛΑΔΑ ΙΣΩΣ Ϋ"), "lt": ("i\u0307\u0300 x", "I\u0300 X")}
    for locale, (text, want) in local.items():
        assert df.limit(1).select(tx.upper(F.lit(text), locale)).first()[0] == want
    assert df.limit(1).select(tx.lower(F.lit("Ì J\u0301 IX"), "lt")).first()[0] == "i\u0307\u0300 j\u0307\u0301 ix"


def test_small_formats(spark):
    got = one(spark, {"n": tx.output_name(F.lit("test.PDF"), F.lit("metadata")), "e": tx.output_name(F.lit(""), F.lit("export")), "b": tx.byte_size(F.lit(1536)), "num": tx.number(F.lit("12,5 %")), "bad": tx.number(F.lit("x")), "q": tx.quiz_right(F.lit(66.72), F.lit(66.7), F.lit(1)), "font": tx.font_name(F.lit("/ABCDEF+Arial-BoldItalic"))["family"], "r": relational.page_ranges(F.lit("1-3,2-5,7"), F.lit(10)), "s": relational.page_ranges(F.lit("5-2"), F.lit(10)), "o": relational.page_ranges(F.lit("0,99"), F.lit(10))}, x=1.0)
    assert (got.n, got.e, got.b, got.num, got.bad, got.q, got.font) == ("test-metadata.json", "pdf-export.json", "1.5 KB", 12.5, None, True, "Arial")
    assert [[(x.first, x.last) for x in v] for v in (got.r, got.s, got.o)] == [[(1, 5), (7, 7)], [(2, 5)], [(1, 1), (10, 10)]]


def test_translation(spark, tmp_path):
    units = spark.createDataFrame([("fr", "a", "x {{v}}", "y", "translated"), ("fr", "b", "same", "TODO", "new"), ("fr", "c_katex", r"\\frac{1}", "", "new"), ("fr", "d", "q", "r", "needs-review")], "locale string, unit_id string, source string, target string, state string")
    done, rest = translation.to_translate(units, spark.createDataFrame([("fr", "b:" + str(spark.range(1).select(tx.fnv1a(F.lit("same"))).first()[0]), "pareil")], "locale string, key string, translation string"))
    assert [tuple(r) for r in done.collect()] == [("fr", "b", "same", "pareil", "translated")]
    assert {r.unit_id for r in rest.collect()} == {"c_katex", "d"}
    assert {(r.unit_id, r.severity) for r in translation.problems(units).collect()} == {("a", "error"), ("c_katex", "error")}
    xliff.write_xliff(units.repartition(3), str(tmp_path / "x"))
    text = "".join(f.read_text() for f in sorted((tmp_path / "x" / "locale=fr").glob("part-*")))
    assert text.startswith("<xliff ") and text.endswith("</xliff>\n")
    (tmp_path / "fr.xlf").write_text(text)
    back = {r.unit_id: (r.source, r.target, r.state) for r in xliff.read_units(spark, str(tmp_path / "fr.xlf")).collect()}
    assert back["a"] == ("x {{v}}", "y", "translated") and len(back) == 4


def test_pdf(spark, tmp_path):
    head = b"%PDF-1.5\n1 0 obj\n<< /Linearized 1 /L 1234 /H [ 10 20 ] /O 5 /E 99 /N 1 /T 77 >>\nendobj\n"
    classic = head + b"x" * 50
    at = len(classic)
    classic += b"xref\n0 2\n0000000003 65535 f \n0000000017 00000 n \n5 1\n0000000100 00001 n \ntrailer\n<< /Size 6 /Encrypt 9 0 R /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % at
    data = bytes([1, 0, 16, 0, 2, 0, 5, 3, 0, 0, 9, 1])
    body = zlib.compress(data)
    modern = b"%PDF-1.7\n" + b"7 0 obj\n<< /Type /XRef /Size 9 /W [1 2 1] /Index [0 2 8 1] /Root 1 0 R /ID [<aa><bb>] /Filter /FlateDecode /Length %d >>\nstream\n" % len(body) + body + b"\nendstream endobj\nstartxref\n9\n%%EOF"
    for name, content in {"a.pdf": classic, "b.pdf": modern, "c.pdf": b"junk", "d.pdf": b"startxref\n999\n", "e.txt": b"x"}.items():
        (tmp_path / name).write_bytes(content)
    files = pdf.read_files(spark, str(tmp_path))
    entries = pdf.xref_entries(files).collect()
    of = lambda n: [tuple(r)[1:] for r in entries if r.path.endswith(n)]
    assert of("a.pdf") == [(0, 65535, "free", None, 3, None, None, None), (1, 0, "inUse", 17, None, None, None, None), (5, 1, "inUse", 100, None, None, None, None)]
    assert of("b.pdf") == [(0, 0, "inUse", 16, None, None, None, None), (1, 0, "compressed", None, None, 5, 3, None), (8, 1, "free", None, 9, None, None, None)]
    assert of("c.pdf")[0][-1] and of("d.pdf")[0][-1]
    lin = {r.path[-5:]: r for r in pdf.linearization(files).collect()}
    a = lin["a.pdf"]
    assert (a.linearized, a.L, a.H_offset, a.H_length, a.O, a.E, a.N, a.T, a.header, a.startxref, a.eof_count) == (True, 1234, 10, 20, 5, 99, 1, 77, "%PDF-1.5", at, 1)
    assert not lin["b.pdf"].linearized and lin["c.pdf"].header is None
    (tmp_path / "f.pdf").write_bytes(b"9 0 obj\n<< /Filter /Standard /V 2 /R 3 /Length 128 /P -44 >>\nendobj\ntrailer\n<< /Encrypt 9 0 R >>\nstartxref\n0\n")
    enc = {r.path[-5:]: r for r in pdf.encryption(pdf.read_files(spark, str(tmp_path))).collect()}
    f = enc["f.pdf"]
    assert (f.encrypted, f.filter, f.v, f.r, f.key_bits, f.p) == (True, "Standard", 2, 3, 128, -44)
    assert (f.print, f.modify, f.copy, f.annotate, f.print_high_quality) == (True, False, True, False, True)
    assert not enc["b.pdf"].encrypted and enc["b.pdf"].copy
    pages = spark.createDataFrame([("x", 0, 1, False), ("x", 0, 1, True), ("y", 2, 0, False)], "path string, font_count int, image_count int, fax_like boolean")
    assert {r.path: (r.score, r.scanned) for r in pdf.scan_score(pages).collect()} == {"x": (100, True), "y": (0, False)}
