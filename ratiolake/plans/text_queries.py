"""Readability, paths, placeholders and translation units over documents, pages and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratiolake.functions import text as tx
from ratiolake.operators import translation as tr

LOCALES = ["fr", "en", "de", "es"]


def t10_readability(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    x = tx.readability(docs, "text").drop("text")
    m = {c: F.col(c) for c in tx.COUNTS.names}
    s, found = tx.score(m), tx.issues(m)
    return x.select(
        "doc_id", "chars", "chars_no_spaces", "words", "sentences", "paragraphs", *[F.round(c, 9).alias(c) for c in ("word_length", "sentence_length", "long", "very_long", "density")], s.alias("score"), tx.level(s).alias("level"), F.array_join(found, ",").alias("issues"), F.array_join(tx.tips(found), ",").alias("tips")
    )


def t02_casing(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.md5(tx.invert_case(F.col("text"))).alias("inverted"), F.md5(tx.sentence_case(F.col("text"))).alias("sentence"), F.md5(tx.title_case(F.col("text"))).alias("title"), tx.has_no_case(F.col("text")).alias("no_case"))


def t16_paths(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_replace("url", "^[a-z]+://[^/]+", "")
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", path.alias("path"))
    return pages.select("page_id", tx.normal_path(F.col("path")).alias("normal"), tx.strip_locale(F.col("path"), LOCALES).alias("bare"), tx.switch_locale(F.col("path"), F.lit("fr"), LOCALES).alias("french"))


def t26_hash(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", tx.fnv1a(F.col("url")).alias("hash"))


def t28_sizes(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    w, h = F.col("l_partkey").cast("double"), F.when(F.col("l_linenumber") == 1, F.lit(842.0)).otherwise(F.col("l_suppkey") * 8.0)
    return rows.select("l_orderkey", "l_linenumber", tx.points_to_mm(w).alias("mm"), tx.paper_name(w, h).alias("paper"), tx.orientation(w, h).alias("orientation"), F.pmod(F.col("l_linenumber") * 90 - 180, F.lit(360)).alias("turned"))


def t30_permissions(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", (-F.col("l_partkey")).alias("p"), F.col("l_linenumber").alias("r"))
    return rows.select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in tx.permissions(F.col("p"), F.col("r")).items()])


def _units(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Units made from customers: some new in the source, some changed there, some only in the targets."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    unit = F.concat(F.lit("u"), F.col("c_custkey"), F.when(F.col("c_custkey") % 7 == 0, "_katex").otherwise(""))
    source = c.filter("c_custkey % 5 <> 1").select(unit.alias("unit_id"), F.concat("c_name", F.when(F.col("c_custkey") % 3 == 0, " {{x}}").otherwise("")).alias("source"))
    target = F.when(F.col("c_custkey") % 11 == 0, F.lit(None)).when(F.col("c_custkey") % 11 == 1, "TODO").otherwise(F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, " {{x}}").otherwise("")))
    state = F.when(F.col("c_custkey") % 4 == 0, "new").when(F.col("c_custkey") % 4 == 1, "needs-review").when(F.col("c_custkey") % 4 == 2, "translated").otherwise("")
    old = F.concat("c_name", F.when(F.col("c_custkey") % 6 == 0, "  {{x}} ").otherwise(""))
    targets = c.filter("c_custkey % 5 <> 2").select(F.when(F.col("c_nationkey") % 2 == 0, "fr").otherwise("de").alias("locale"), unit.alias("unit_id"), old.alias("source"), target.alias("target"), state.alias("state"))
    return source, targets, spark.createDataFrame([("fr",), ("de",)], "locale string")


def i02_merge(spark: SparkSession, d: str) -> DataFrame:
    return tr.merge(*_units(spark, d))


def i05_problems(spark: SparkSession, d: str) -> DataFrame:
    return tr.problems(_units(spark, d)[1], strict=True)


def i06_progress(spark: SparkSession, d: str) -> DataFrame:
    return tr.progress(_units(spark, d)[1], 500)


QUERIES = {f.__name__: f for f in (t10_readability, t02_casing, t16_paths, t26_hash, t28_sizes, t30_permissions, i02_merge, i05_problems, i06_progress)}

_UNIT = "'u' || c_custkey || CASE WHEN c_custkey % 7 = 0 THEN '_katex' ELSE '' END"
_TARGETS = f"SELECT CASE WHEN c_nationkey % 2 = 0 THEN 'fr' ELSE 'de' END AS locale, {_UNIT} AS unit_id, c_name || CASE WHEN c_custkey % 6 = 0 THEN '  {{{{x}}}} ' ELSE '' END AS source, CASE c_custkey % 11 WHEN 0 THEN NULL WHEN 1 THEN 'TODO' ELSE c_name || CASE WHEN c_custkey % 2 = 0 THEN ' {{{{x}}}}' ELSE '' END END AS target, CASE c_custkey % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'needs-review' WHEN 2 THEN 'translated' ELSE '' END AS state FROM customer WHERE c_custkey % 5 <> 2"
_ESC = "replace(replace({}, '{{', '&#123;'), '}}', '&#125;')"
_WORDS = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}]+(?:[''’\-][\p{{L}}\p{{N}}]+)*')"

_UP = "CASE {0} WHEN 'ß' THEN 'SS' ELSE upper({0}) END"
_START = f"""regexp_extract(z, '^[^\\p{{L}}]*') || {_UP.format("substr(z, length(regexp_extract(z, '^[^\\p{L}]*')) + 1, 1)")} || substr(z, length(regexp_extract(z, '^[^\\p{{L}}]*')) + 2)"""

ORACLE_SQL = {
    "t02_casing": rf"""
SELECT doc_id, md5(array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN c = {_UP.format("c")} AND c <> lower(c) THEN lower(c) WHEN c = lower(c) AND c <> {_UP.format("c")} THEN {_UP.format("c")} ELSE c END), '')) AS inverted,
  md5(array_to_string(list_transform(regexp_extract_all(lower(text), '[^.!?…
]*[.!?…
]|[^.!?…
]+$'), lambda z: {_START}), '')) AS sentence,
  md5(array_to_string(list_transform(regexp_extract_all(lower(text), '[\s\-’''("]+|[^\s\-’''("]+'), lambda z: CASE WHEN regexp_matches(z, '^\p{{L}}') THEN {_UP.format("z[1]")} || substr(z, 2) ELSE z END), '')) AS title, upper(text) = lower(text) AS no_case FROM documents""",
    "t10_readability": rf"""
WITH n AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents),
x AS (SELECT doc_id, t, {_WORDS.format("t")} AS w, list_filter(list_transform(string_split(regexp_replace(t, '([.!?。！？…])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ' || chr(10) || chr(9))), lambda s: s <> '') AS s,
  list_filter(list_transform(string_split(regexp_replace(t, '\n\s*\n', chr(1), 'g'), chr(1)), lambda s: trim(s, ' ' || chr(10) || chr(9))), lambda s: s <> '') AS p FROM n),
y AS (SELECT doc_id, length(t) AS chars, length(regexp_replace(t, '\s+', '', 'g')) AS chars_no_spaces, len(w) AS words, greatest(1, len(s)) AS sentences, greatest(1, len(p)) AS paragraphs,
  coalesce(list_sum(list_transform(w, lambda z: length(z)))::DOUBLE / nullif(len(w), 0), 0) AS word_length, len(w)::DOUBLE / greatest(1, len(s)) AS sentence_length,
  list_filter(list_transform(s, lambda z: len({_WORDS.format("z")})), lambda k: k > 0) AS per, coalesce(len(regexp_extract_all(t, '[.,;:!?…、。！？；：]'))::DOUBLE / nullif(len(w), 0), 0) AS density FROM x),
z AS (SELECT *, coalesce(len(list_filter(per, lambda k: k > 25))::DOUBLE / nullif(len(per), 0), 0) AS long, coalesce(len(list_filter(per, lambda k: k > 35))::DOUBLE / nullif(len(per), 0), 0) AS very_long FROM y),
c AS (SELECT *, greatest(0, least(100, floor(100 - greatest(0, least(40, sentence_length - 14)) * 1.6e0 - long * 28 - very_long * 22 - greatest(0, least(3.5e0, word_length - 4.6e0)) * 10
  - CASE WHEN words >= 120 THEN greatest(0, least(6, greatest(2, floor(words / 90 + 0.5e0)) - paragraphs)) * 6 ELSE 0 END
  - CASE WHEN words >= 40 AND density < 0.02e0 THEN 6 ELSE 0 END - CASE WHEN words >= 40 AND density > 0.18e0 THEN 6 ELSE 0 END + 0.5e0)))::BIGINT AS score,
  list_filter([CASE WHEN sentence_length > 22 OR long > 0.25e0 THEN 'readability_issue_long_sentences' END, CASE WHEN very_long > 0.12e0 THEN 'readability_issue_very_long_sentences' END, CASE WHEN word_length > 6.2e0 THEN 'readability_issue_long_words' END, CASE WHEN words >= 120 AND paragraphs <= 1 THEN 'readability_issue_no_paragraphs' END, CASE WHEN words >= 60 AND density < 0.02e0 THEN 'readability_issue_low_punctuation' END, CASE WHEN words >= 60 AND density > 0.18e0 THEN 'readability_issue_high_punctuation' END], lambda i: i IS NOT NULL) AS i FROM z)
SELECT doc_id, chars, chars_no_spaces, words, sentences, paragraphs, round(word_length, 9) AS word_length, round(sentence_length, 9) AS sentence_length, round(long, 9) AS long, round(very_long, 9) AS very_long, round(density, 9) AS density, score,
  CASE WHEN score >= 85 THEN 'very_easy' WHEN score >= 70 THEN 'easy' WHEN score >= 50 THEN 'medium' WHEN score >= 30 THEN 'hard' ELSE 'very_hard' END AS level,
  CASE WHEN len(i) = 0 THEN 'readability_issue_none' ELSE array_to_string(i, ',') END AS issues,
  CASE WHEN len(i) = 0 THEN 'readability_tip_keep_it_up' ELSE array_to_string(list_transform(i, lambda k: CASE k WHEN 'readability_issue_long_sentences' THEN 'readability_tip_shorten_sentences' WHEN 'readability_issue_very_long_sentences' THEN 'readability_tip_split_sentences' WHEN 'readability_issue_long_words' THEN 'readability_tip_simpler_words' WHEN 'readability_issue_no_paragraphs' THEN 'readability_tip_add_paragraphs' WHEN 'readability_issue_low_punctuation' THEN 'readability_tip_add_punctuation' ELSE 'readability_tip_reduce_punctuation' END), ',') END AS tips
FROM c""",
    "t16_paths": r"SELECT page_id, n AS normal, b AS bare, CASE WHEN b = '/' THEN '/fr' ELSE '/fr' || b END AS french FROM (SELECT *, CASE WHEN regexp_matches(n, '^/(fr|en|de|es)(/|$)') THEN CASE WHEN length(n) <= 4 THEN '/' ELSE substr(n, 4) END ELSE n END AS b FROM (SELECT page_id, CASE WHEN p = '/' THEN p ELSE regexp_replace(p, '/$', '') END AS n FROM (SELECT page_id, regexp_replace('/' || regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+', ''), '[?#].*$', ''), '/{2,}', '/', 'g') AS p FROM pages)))",
    "t26_hash": "SELECT page_id, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(url, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS hash FROM pages",
    "t28_sizes": "SELECT l_orderkey, l_linenumber, floor(w / 72 * 25.4e0 * 100 + 0.5e0) / 100 AS mm, CASE WHEN greatest(abs(w - 595.28e0), abs(h - 841.89e0)) <= 2 THEN 'A4' WHEN greatest(abs(w - 841.89e0), abs(h - 595.28e0)) <= 2 THEN 'A4' WHEN (w BETWEEN 839.89e0 AND 843.89e0 AND h BETWEEN 1188.55e0 AND 1192.55e0) OR (h BETWEEN 839.89e0 AND 843.89e0 AND w BETWEEN 1188.55e0 AND 1192.55e0) THEN 'A3' WHEN (w BETWEEN 417.53e0 AND 421.53e0 AND h BETWEEN 593.28e0 AND 597.28e0) OR (h BETWEEN 417.53e0 AND 421.53e0 AND w BETWEEN 593.28e0 AND 597.28e0) THEN 'A5' WHEN (w BETWEEN 610 AND 614 AND h BETWEEN 790 AND 794) OR (h BETWEEN 610 AND 614 AND w BETWEEN 790 AND 794) THEN 'Letter' WHEN (w BETWEEN 610 AND 614 AND h BETWEEN 1006 AND 1010) OR (h BETWEEN 610 AND 614 AND w BETWEEN 1006 AND 1010) THEN 'Legal' WHEN (w BETWEEN 790 AND 794 AND h BETWEEN 1222 AND 1226) OR (h BETWEEN 790 AND 794 AND w BETWEEN 1222 AND 1226) THEN 'Tabloid' END AS paper, CASE WHEN abs(w - h) <= 0.5e0 THEN 'square' WHEN w > h THEN 'landscape' ELSE 'portrait' END AS orientation, ((l_linenumber * 90 - 180) % 360 + 360) % 360 AS turned FROM (SELECT l_orderkey, l_linenumber, l_partkey::DOUBLE AS w, CASE WHEN l_linenumber = 1 THEN 842e0 ELSE l_suppkey * 8e0 END AS h FROM lineitem)",
    "t30_permissions": "SELECT l_orderkey, l_linenumber, u & 4 <> 0 AS print, u & 8 <> 0 AS modify, u & 16 <> 0 AS copy, u & 32 <> 0 AS annotate, u & 256 <> 0 AS fill_forms, u & 512 <> 0 AS accessibility, u & 1024 <> 0 AS assemble, CASE WHEN l_linenumber >= 3 THEN u & 2048 <> 0 END AS print_high_quality FROM (SELECT *, 4294967296 - l_partkey AS u FROM lineitem)".replace("u & ", "(u & ").replace(" <> 0", ") <> 0"),
    "i05_problems": f"""
WITH u AS ({_TARGETS}), x AS (SELECT *, contains(source, '{{{{x}}}}') AS a, CASE WHEN target <> 'TODO' THEN contains(target, '{{{{x}}}}') ELSE NULL END AS b, contains(unit_id, 'katex') AS k FROM u)
SELECT locale, unit_id, 'error' AS severity, 'missing placeholders: {{{{x}}}}' AS message FROM x WHERE a AND NOT b
UNION ALL SELECT locale, unit_id, 'warning', 'extra placeholders: {{{{x}}}}' FROM x WHERE b AND NOT a
UNION ALL SELECT locale, unit_id, 'error', 'braces in source formula' FROM x WHERE k AND a
UNION ALL SELECT locale, unit_id, 'error', 'braces in target formula' FROM x WHERE k AND contains(target, '{{')
UNION ALL SELECT locale, unit_id, 'warning', 'missing translation' FROM x WHERE coalesce(target, '') IN ('', 'TODO')""",
    "i06_progress": f"SELECT locale, count(*) AS total, count(*) FILTER (s = 'done') AS done, count(*) FILTER (s = 'review') AS review, count(*) FILTER (s = 'todo') AS todo, floor(count(*) FILTER (s = 'done') / 500 * 100 + 0.5e0)::BIGINT AS progress FROM (SELECT locale, CASE WHEN state = 'translated' AND coalesce(target, '') NOT IN ('', 'TODO') THEN 'done' WHEN state = 'needs-review' THEN 'review' WHEN state = 'new' OR coalesce(target, '') IN ('', 'TODO') THEN 'todo' ELSE 'done' END AS s FROM ({_TARGETS})) GROUP BY 1",
    "i02_merge": f"""
WITH s AS (SELECT {_UNIT} AS unit_id, c_name || CASE WHEN c_custkey % 3 = 0 THEN ' {{{{x}}}}' ELSE '' END AS ns FROM customer WHERE c_custkey % 5 <> 1),
w AS (SELECT l.locale, s.* FROM s, (VALUES ('fr'), ('de')) l(locale)), u AS ({_TARGETS}),
x AS (SELECT coalesce(u.locale, w.locale) AS locale, coalesce(u.unit_id, w.unit_id) AS unit_id, u.source, u.target, u.state, w.ns, u.unit_id IS NULL AS fresh, contains(coalesce(u.unit_id, w.unit_id), 'katex') AS k FROM u FULL JOIN w ON u.locale = w.locale AND u.unit_id = w.unit_id),
y AS (SELECT *, {_ESC.format("ns")} AS e, CASE WHEN coalesce(target, '') <> '' THEN {_ESC.format("target")} ELSE {_ESC.format("ns")} END AS now FROM x),
z AS (SELECT *, CASE WHEN ns IS NULL THEN 'kept' WHEN fresh THEN 'added' WHEN k AND (source IS DISTINCT FROM e OR coalesce(target, '') <> now) THEN 'formula' WHEN NOT k AND trim(regexp_replace(ns, '\\s+', ' ', 'g')) <> trim(regexp_replace(source, '\\s+', ' ', 'g')) THEN 'source' ELSE 'same' END AS change FROM y)
SELECT locale, unit_id, CASE WHEN change IN ('added', 'formula') THEN CASE WHEN k THEN e ELSE ns END WHEN change = 'source' THEN ns ELSE source END AS source,
  CASE change WHEN 'added' THEN CASE WHEN k THEN e ELSE 'TODO' END WHEN 'formula' THEN now ELSE target END AS target,
  CASE WHEN change = 'added' AND NOT k THEN 'new' WHEN change IN ('added', 'formula') THEN 'translated' WHEN change = 'source' AND state <> 'new' THEN 'needs-review' ELSE state END AS state, change FROM z""",
}
