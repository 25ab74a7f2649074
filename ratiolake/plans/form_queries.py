"""Fractions, ratios, rounding, and small text forms over lineitem, part, customer, pages and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratiolake.functions import numbers as nu
from ratiolake.functions import text as tx
from ratiolake.operators import translation as tr

from .text_queries import _ESC, _UNIT, _units

LINE = ["l_orderkey", "l_linenumber"]


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """lineitem with whole numbers a, b, c, d (b and d not 0) and an amount x."""
    whole = lambda c: c.cast("long")
    a, b = whole(F.col("l_linenumber")), whole(F.col("l_quantity"))
    return spark.read.parquet(f"{d}/lineitem.parquet").select(*LINE, a.alias("a"), b.alias("b"), whole(F.col("l_suppkey") % 7).alias("c"), (a + 1).alias("d"), F.col("l_extendedprice").cast("double").alias("x"))


def _named(results: dict[str, Column], prefix: str = "") -> list[Column]:
    return [c.alias(prefix + n) for n, c in results.items()]


def p24_percent_to_fraction(spark: SparkSession, d: str) -> DataFrame:
    f = nu.percent_to_fraction(F.col("b").cast("double"))
    return _lines(spark, d).select(*LINE, f.alias("f")).select(*LINE, "f.num", "f.den")


def p25_decimal_to_percent(spark: SparkSession, d: str) -> DataFrame:
    """Of each ratio that occurs, its percentage and best fraction."""
    x = F.col("a").cast("double") / F.col("b")
    rows = _lines(spark, d).select("a", "b").distinct()
    return rows.select("a", "b", (x * 100).alias("percent"), nu.best_fraction(x).alias("f")).select("a", "b", "percent", "f.num", "f.den")


def k01_fractions(spark: SparkSession, d: str) -> DataFrame:
    a, b, c, e = map(F.col, "abcd")
    return _lines(spark, d).select(*LINE, *_named(nu.simplify(a, b), "simple_"), *_named(nu.add(a, b, c, e), "sum_"), nu.compare(a, b, c, e).alias("compared"))


def k02_ratios(spark: SparkSession, d: str) -> DataFrame:
    a, b, c, e = (F.col(n).cast("double") for n in "abcd")
    return _lines(spark, d).select(*LINE, *_named(nu.share(F.col("x"), a, b)), nu.same_ratio(a, b, c, e).alias("same"))


def k03_rounding(spark: SparkSession, d: str) -> DataFrame:
    x, places = F.col("x"), F.col("a") % 3
    return _lines(spark, d).select(*LINE, nu.truncate(x, places).alias("truncated"), nu.magnitude(x).alias("magnitude"), nu.significant(x, F.lit(3)).alias("significant"), *_named(nu.rounding_error(x, places)))


def t06_normalize(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.md5(tx.normalize(F.col("text"))).alias("normal"), F.md5(tx.collapse_blanks(F.col("text"))).alias("collapsed"))


def t09_words(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", tx.words(F.col("text")).alias("w"))
    return docs.select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ")).alias("words"))


def t17_names(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", tx.safe_name(F.col("url")).alias("safe"), tx.output_name(F.col("url"), F.lit("links")).alias("output"))


def t18_byte_size(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").select(*LINE, tx.byte_size(F.col("l_orderkey").cast("long") * F.col("l_suppkey").cast("long") * 7).alias("size"))


def t19_numbers(spark: SparkSession, d: str) -> DataFrame:
    written = F.when(F.col("a") == 7, F.lit("none")).otherwise(F.concat(F.col("a"), F.lit(","), F.col("b"), F.lit(" %")))
    return _lines(spark, d).select(*LINE, tx.number(written).alias("number"))


def t20_quiz(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select(*LINE, tx.quiz_right(F.col("x") + F.col("a") / 1000.0, F.col("x"), F.lit(2)).alias("is_right"))


def t22_braces(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat("p_brand", F.lit(r"{{x}} &amp;#123; \\frac \\\\a"))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", tx.escape_braces(text).alias("escaped"), tx.unescape_braces(tx.escape_braces(text)).alias("back"))


def t23_controls(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("c_custkey") % 2 == 1, F.concat("c_name", F.lit("\x0c\x01z"))).otherwise(F.col("c_name"))
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", tx.illegal_controls(text).alias("illegal"), tx.visible_controls(text).alias("visible"))


def t31_font_name(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    name = F.concat(F.when(F.col("p_partkey") % 3 == 0, "/ABCDEF+").otherwise("/"), F.replace("p_brand", F.lit("#"), F.lit("")), F.when(k == 0, "-Bold").when(k == 1, "-Italic").when(k == 2, ",Regular").otherwise("Oblique"))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", *_named(tx.font_name(name)))


def i03_create_locale(spark: SparkSession, d: str) -> DataFrame:
    source, _, locales = _units(spark, d)
    return tr.create_locale(source, locales)


QUERIES = {
    f.__name__: f
    for f in (
        p24_percent_to_fraction,
        p25_decimal_to_percent,
        k01_fractions,
        k02_ratios,
        k03_rounding,
        t06_normalize,
        t09_words,
        t17_names,
        t18_byte_size,
        t19_numbers,
        t20_quiz,
        t22_braces,
        t23_controls,
        t31_font_name,
        i03_create_locale,
    )
}

_L = "(SELECT l_orderkey, l_linenumber, l_linenumber::BIGINT AS a, l_quantity::BIGINT AS b, (l_suppkey % 7)::BIGINT AS c, l_linenumber::BIGINT + 1 AS d, l_extendedprice::DOUBLE AS x FROM lineitem)"
_ROUND = "sign({x}) * floor(abs({x}) * pow(10e0, {p}) + {h}) / pow(10e0, {p})"

ORACLE_SQL = {
    "p24_percent_to_fraction": f"SELECT l_orderkey, l_linenumber, (b // gcd(b, 100))::DOUBLE AS num, (100 // gcd(b, 100))::DOUBLE AS den FROM {_L}",
    "p25_decimal_to_percent": f"SELECT DISTINCT a, b, a::DOUBLE / b * 100 AS percent, (a // gcd(a, b))::DOUBLE AS num, (b // gcd(a, b))::DOUBLE AS den FROM {_L}",
    "k01_fractions": f"""SELECT l_orderkey, l_linenumber, (a // gcd(a, b))::DOUBLE AS simple_num, (b // gcd(a, b))::DOUBLE AS simple_den,
  ((a * d + c * b) // gcd(a * d + c * b, b * d))::DOUBLE AS sum_num, (b * d // gcd(a * d + c * b, b * d))::DOUBLE AS sum_den, sign(a * d - c * b)::INTEGER AS compared FROM {_L}""",
    "k02_ratios": f"SELECT l_orderkey, l_linenumber, x * a / (a + b) AS first, x * b / (a + b) AS second, abs(a / b - c / d) <= 1e-9 * greatest(1e0, abs(a / b)) AS same FROM (SELECT l_orderkey, l_linenumber, x, a::DOUBLE AS a, b::DOUBLE AS b, c::DOUBLE AS c, d::DOUBLE AS d FROM {_L})",
    "k03_rounding": f"""SELECT l_orderkey, l_linenumber, truncated, magnitude, {_ROUND.format(x="x", p="(2 - magnitude)", h="0.5e0")} AS significant, rounded, abs(rounded - x) AS absolute, abs(rounded - x) / nullif(abs(x), 0) * 100 AS percent
FROM (SELECT *, {_ROUND.format(x="x", p="(a % 3)", h="0")} AS truncated, {_ROUND.format(x="x", p="(a % 3)", h="0.5e0")} AS rounded, floor(log10(abs(x)) + 1e-12)::INTEGER AS magnitude FROM {_L})""",
    "t06_normalize": r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS normal,
  md5(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS collapsed FROM documents""",
    "t09_words": r"SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS words FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+(?:[''’\-][\p{L}\p{N}]+)*') AS w FROM documents)",
    "t17_names": r"""SELECT page_id, regexp_replace(url, '[\\/:*?"<>|]', '_', 'g') AS safe, CASE WHEN regexp_replace(trim(coalesce(url, '')), '(?i)\.pdf$', '') = '' THEN 'pdf' ELSE regexp_replace(trim(url), '(?i)\.pdf$', '') END || '-links.json' AS output FROM pages""",
    "t18_byte_size": "SELECT l_orderkey, l_linenumber, CASE WHEN n <= 0 THEN '0 B' WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN round(n / 1024e0, 1) || ' KB' WHEN n < 1073741824 THEN round(n / 1048576e0, 1) || ' MB' ELSE round(n / 1073741824e0, 1) || ' GB' END AS size FROM (SELECT l_orderkey, l_linenumber, l_orderkey::BIGINT * l_suppkey::BIGINT * 7 AS n FROM lineitem)",
    "t19_numbers": f"SELECT l_orderkey, l_linenumber, CASE WHEN a <> 7 THEN CAST(a || '.' || b AS DOUBLE) END AS number FROM {_L}",
    "t20_quiz": f"SELECT l_orderkey, l_linenumber, abs((x + a / 1000e0) - x) <= 0.5e0 * pow(10e0, -2) AS is_right FROM {_L}",
    "t22_braces": r"""SELECT p_partkey, replace(replace(s, '{', '&#123;'), '}', '&#125;') AS escaped, s AS back FROM (SELECT p_partkey, replace(regexp_replace(p_brand || '{{x}} &amp;#123; \\frac \\\\a', '\\{2,}', '\\', 'g'), '&amp;#123;', '{') AS s FROM part)""",
    "t23_controls": r"SELECT c_custkey, c_custkey % 2 = 1 AS illegal, CASE WHEN c_custkey % 2 = 1 THEN c_name || '\fz' ELSE c_name END AS visible FROM customer",
    "t31_font_name": """SELECT p_partkey, p_partkey % 3 = 0 AS subset, b || e AS base, CASE WHEN k = 3 THEN b || e ELSE b END AS family, k = 0 AS bold, k IN (1, 3) AS italic, CASE k WHEN 0 THEN 'bold' WHEN 2 THEN 'regular' ELSE 'unknown' END AS weight,
  CASE k WHEN 1 THEN 'italic' WHEN 2 THEN 'normal' WHEN 3 THEN 'oblique' ELSE 'unknown' END AS style
FROM (SELECT p_partkey, p_partkey % 4 AS k, replace(p_brand, '#', '') AS b, CASE p_partkey % 4 WHEN 0 THEN '-Bold' WHEN 1 THEN '-Italic' WHEN 2 THEN ',Regular' ELSE 'Oblique' END AS e FROM part)""",
    "i03_create_locale": f"""SELECT locale, unit_id, CASE WHEN k THEN e ELSE ns END AS source, CASE WHEN k THEN e ELSE 'TODO' END AS target, CASE WHEN k THEN 'translated' ELSE 'new' END AS state
FROM (SELECT *, {_ESC.format("ns")} AS e, contains(unit_id, 'katex') AS k FROM (SELECT {_UNIT} AS unit_id, c_name || CASE WHEN c_custkey % 3 = 0 THEN ' {{{{x}}}}' ELSE '' END AS ns FROM customer WHERE c_custkey % 5 <> 1), (VALUES ('fr'), ('de')) l(locale))""",
}
