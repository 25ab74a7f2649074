"""Catalogues, seeded chance, formulas, links and names over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratiolake.functions import chance
from ratiolake.functions import numbers as nu
from ratiolake.functions import text as tx
from ratiolake.operators import catalogue as cat
from ratiolake.operators import exercises as ex
from ratiolake.operators import relational as rel
from ratiolake.operators import translation as tr
from ratiolake.sources import xliff
from ratiolake.tables import spread

from .form_queries import LINE, _lines, _named
from .text_queries import _TARGETS, _units


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Parts as items: a third of them is not available."""
    return _t(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", F.col("p_partkey").alias("at"), (F.col("p_partkey") % 3 != 0).alias("available"))


def g01_collated(spark: SparkSession, d: str) -> DataFrame:
    """The nations of each region in the order of French titles."""
    titles = F.array_sort(F.collect_list(F.struct(F.collate("n_name", "fr").alias("title"))))
    return _t(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(titles, lambda t: t["title"].cast("string")), ",").alias("titles"))


def g02_sections(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d).withColumnRenamed("p_brand", "section")
    number = F.regexp_extract("section", r"(\d+)$", 1).cast("int")
    declared = items.select("section").distinct().filter(number % 3 != 0).select("section", F.when(number % 3 == 1, number).alias("section_order"))
    return cat.sections(items, declared).select("p_partkey", "section", "section_order", F.col("rank").cast("long").alias("rank"))


def g03_priorities(spark: SparkSession, d: str) -> DataFrame:
    """Related items with a priority list for each fourth item; what is not available is left out."""
    items = _items(spark, d)
    first = items.filter("p_partkey % 4 = 0").select("p_partkey", F.posexplode(F.array(F.col("p_partkey") + 9, F.col("p_partkey") + 5, F.col("p_partkey"), F.col("p_partkey") + 1)).alias("at", "related"))
    return rel.tiered_top_k(items, "p_partkey", "at", [["p_brand", "p_type"], ["p_brand"], []], 6, "available", first).withColumn("rank", F.col("rank").cast("long"))


def g05_ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    each = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda x: x["l_returnflag"])
    return _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(cat.ordered_distinct(each), ",").alias("flags"))


def j02_editorial(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d)
    texts = items.select("p_brand", "p_type").distinct().filter(F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int") % 2 == 1).withColumn("editorial", F.concat_ws("/", "p_brand", "p_type"))
    return cat.with_editorial(items, texts, ["p_brand", "p_type"]).select("p_partkey", "editorial")


def f06_lesson_search(spark: SparkSession, d: str) -> DataFrame:
    p = _items(spark, d)
    return p.filter(cat.lesson_search(" Econ", F.col("p_name"), F.col("p_brand"), F.array("p_type"), F.array(F.lit("intro"), F.col("p_name")))).select("p_partkey")


def f07_availability(spark: SparkSession, d: str) -> DataFrame:
    return cat.availability(_items(spark, d), "p_brand")


def f10_projection(spark: SparkSession, d: str) -> DataFrame:
    return cat.projected(_items(spark, d), ["p_partkey"], {"p_size": True, "p_type": False, "p_brand": True})


def f11_flattened(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers by region and nation, a nested row for each region, flattened again."""
    s, n, r = (_t(spark, d, x) for x in ("supplier", "nation", "region"))
    pairs = lambda k, v: F.map_from_entries(F.collect_list(F.struct(k, v)))
    x = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    x = x.groupBy("r_name", "n_name").agg(F.struct(pairs(F.col("s_suppkey").cast("string"), F.col("s_name")).alias("items")).alias("g"))
    x = x.groupBy("r_name").agg(F.struct(pairs(F.col("n_name"), F.col("g")).alias("groups")).alias("c"))
    return cat.flattened(x.select(F.create_map("r_name", "c").alias("tree")), "tree")


def a21_tag_balance(spark: SparkSession, d: str) -> DataFrame:
    return tx.tag_balance(_t(spark, d, "pages"), ["page_id"], "html", ["p", "ul", "li", "div", "html"])


def i04_point_updates(spark: SparkSession, d: str) -> DataFrame:
    targets = _units(spark, d)[1]
    c = _t(spark, d, "customer").filter("c_custkey % 3 = 0")
    changes = c.select(F.when(F.col("c_nationkey") % 2 == 0, "fr").otherwise("de").alias("locale"), F.concat(F.lit("u"), "c_custkey", F.when(F.col("c_custkey") % 7 == 0, "_katex").otherwise("")).alias("unit_id"), F.when(F.col("c_custkey") % 2 == 0, "new source").alias("source"), F.concat(F.lit("new "), "c_name").alias("target"), F.when(F.col("c_custkey") % 4 == 0, "translated").alias("state"))
    return tr.updated(targets, changes)


def i09_locales(spark: SparkSession, d: str) -> DataFrame:
    """The languages of each source's documents, in the order they first occur, French first."""
    first = _t(spark, d, "documents").groupBy("source", "lang").agg(F.min("doc_id").alias("first"))
    targets = F.transform(F.array_sort(F.collect_list(F.struct("first", "lang"))), lambda x: x["lang"])
    x = first.groupBy("source").agg(targets.alias("targets"))
    return x.select("source", F.array_join(tr.locales(F.lit("fr"), F.concat("targets", F.reverse("targets"))), ",").alias("locales"))


def t14_templates(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d)
    numbers = F.create_map(F.lit("a"), F.col("x") / 7, F.lit("b_1"), F.col("b").cast("double"), F.lit("e"), F.lit(-0.0001))
    texts = F.create_map(F.lit("c"), F.lit("x_y %\\"), F.lit("empty"), F.lit(""))
    latex = F.lit(r"{{a}} \times {{b_1}} = \frac{{c}}{2} + {{none}}{{empty}} - {{e}}")
    return rows.select(*LINE, tx.fill_template(latex, numbers, texts, 3).alias("formula"))


def t15_latex(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("&#123;"), "p_name", F.lit("&rbrace; \\\\\\frac \\\\times \text 5\\\\% \\\\other"), F.col("p_size").cast("string"))
    return _t(spark, d, "part").select("p_partkey", tx.normal_latex(raw).alias("latex"))


def t17_unique_names(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").select("event_id", "user_id", F.concat("event_type", F.lit(".a.txt")).alias("name"))
    x = tx.unique_names(e, "user_id", "name", ["event_id"])
    return x.select("event_id", "unique_name", tx.split_name(F.concat(F.lit("a/b:"), "user_id", F.lit(".PDF")), F.col("event_id") % 12, F.lit(12)).alias("part"))


def t20_choices(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").select(*LINE, tx.choice_right(F.nullif(F.col("l_returnflag"), F.lit("A")), F.lit("N")).alias("right"))


def t27_share_links(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "pages").select("page_id", "url", F.concat(F.lit("Page n°"), "page_id", F.lit(" (it's ~ok!) *")).alias("title"), F.when(F.col("page_id") % 2 == 0, "é & ü?").otherwise("").alias("text"))
    return p.select("page_id", *_named(tx.share_links(F.col("url"), F.col("title"), F.col("text"))))


def p24_fraction_to_percent(spark: SparkSession, d: str) -> DataFrame:
    a, b, x = F.col("a"), F.col("b"), F.col("x")
    found = nu.percent_to_fraction(F.floor(x) / 4 * 10)
    rows = _lines(spark, d).select(*LINE, *_named(nu.fraction_to_percent(a, b)), F.floor(x).alias("whole"), found.alias("f"))
    return rows.select(*LINE, "num", "den", "decimal", "percent", (F.col("f.num") / F.col("f.den") == F.col("whole") / 40).alias("same_value"), "f.den", nu.unit_fraction(F.col("num"), F.col("den")).alias("unit")).toDF(*LINE, "num", "den", "decimal", "percent", "same_value", "found_den", "unit")


def p25_directions(spark: SparkSession, d: str) -> DataFrame:
    mode = F.when(F.col("a") % 2 == 0, "to_percent").otherwise("to_decimal")
    return _lines(spark, d).select(*LINE, nu.decimal_percent(mode, F.col("x")).alias("converted"))


def g11_shuffle(spark: SparkSession, d: str) -> DataFrame:
    """The lines of each order in an order that follows from its key."""
    x = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct().groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("l"))
    return x.select("l_orderkey", F.array_join(chance.shuffled(F.col("l"), F.col("l_orderkey")).cast("array<string>"), ",").alias("shuffled"))


def g11_named_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Numbers from a seed of its own for each part, after its name."""
    own = chance.seed_of(F.col("p_partkey"), F.col("p_name"))
    return _t(spark, d, "part").select("p_partkey", own.alias("seed"), chance.random(own, F.lit(1)).alias("first"))


def k02_periods(spark: SparkSession, d: str) -> DataFrame:
    """Quantities of lines as parts of their order's number, as decimals with a period."""
    x = _t(spark, d, "lineitem").select(*LINE, "l_partkey", F.col("l_quantity").cast("long").alias("q"))
    return x.select(*LINE, nu.periodic(F.col("l_partkey"), F.col("q")).alias("p")).select(*LINE, "p.*")


def i01_parse_xliff(spark: SparkSession, d: str) -> DataFrame:
    """A document for each brand, with a unit for each part; every tenth is told twice, the second time without target."""
    t = lambda *some: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in some])
    k = F.col("p_partkey")
    unit = t('<unit id="', k, '">\n<segment><source>', F.col("p_name"), "</source><target", F.when(k % 2 == 0, ' state="translated"').otherwise(""), ">", F.col("p_type"), "</target></segment></unit>\n")
    unit = t(unit, F.when(k % 10 == 0, t('<unit note="x" id="', k, '"><segment state="initial"><source xml:space="preserve">', F.col("p_brand"), "</source></segment></unit>")).otherwise(""))
    files = _t(spark, d, "part").groupBy(F.col("p_brand").alias("path")).agg(t('<xliff version="2.0" trgLang="fr"><file id="f">', F.array_join(F.array_sort(F.collect_list(unit)), "\n"), "</file></xliff>").alias("content"))
    return xliff.parse_units(files)


def i07_to_translate(spark: SparkSession, d: str) -> DataFrame:
    """Names of parts as units, a third of them translated; every fourth has an entry in the cache, and every eighth one of an older source."""
    k = F.col("p_partkey")
    unit = _t(spark, d, "part").select(k, F.lit("fr").alias("locale"), F.concat(F.lit("part."), k.cast("string")).alias("unit_id"), F.col("p_name").alias("source"), F.when(k % 3 == 0, F.col("p_type")).when(k % 3 == 1, "TODO").alias("target"), F.when(k % 5 == 0, "needs-review").otherwise("").alias("state"))
    old = F.when(k % 8 == 0, F.concat("source", F.lit("!"))).otherwise(F.col("source"))
    cache = unit.filter(k % 4 == 0).select("locale", F.concat_ws(":", "unit_id", tx.fnv1a(old).cast("string")).alias("key"), F.concat(F.lit("fr "), "source").alias("translation"))
    done, rest = tr.to_translate(unit.drop("p_partkey"), cache)
    return done.select("unit_id", "source", "target", "state").unionByName(rest.select("unit_id", "source"), allowMissingColumns=True)


def t01_locale_casing(spark: SparkSession, d: str) -> DataFrame:
    """Names with dotted and dotless i, in upper and lower case by the rules of Turkish and of no language."""
    name = F.concat("p_name", F.lit(" ıiİI ß"))
    return _t(spark, d, "part").select("p_partkey", *[f(name, loc).alias(f"{f.__name__}_{loc or 'root'}") for f in (tx.upper, tx.lower) for loc in ("", "tr")])


def t21_formulas(spark: SparkSession, d: str) -> DataFrame:
    """Names of parts as ids and texts, some with commands of formulas."""
    k = F.col("p_partkey")
    t = F.concat("p_name", F.when(k % 4 == 0, r" \dfrac{a}{b}").when(k % 4 == 1, r" 50\% more").when(k % 4 == 2, r" \alpha % frac").otherwise(r" \ text"))
    unit = F.concat("p_brand", F.when(k % 3 == 0, "_KaTeX").when(k % 3 == 1, "_latex").otherwise("_latex_x"))
    return _t(spark, d, "part").select(k, tx.is_formula_id(unit).alias("formula_id"), tx.looks_like_formula(F.when(k % 7 != 0, t)).alias("formula"))


def t24_marks(spark: SparkSession, d: str) -> DataFrame:
    """Placeholders of texts with single and paired marks, one of them twice, and one that is not closed."""
    k = F.col("p_partkey").cast("string")
    t = F.concat(F.lit('{{a}} <ph id="0" equiv="P'), k, F.lit('"/> <ph equiv="open"> <pc id="1" equivStart="S'), k, F.lit('" equivEnd="E" type="fmt">x</pc> {{a}} <ph equiv="P'), k, F.lit('" disp="x"/>'))
    return _t(spark, d, "part").select("p_partkey", F.array_join(tx.placeholders(t), ",").alias("marks"))


def t27_regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions for languages and time zones put together from nations."""
    lang = F.concat(F.lower(F.left("n_name", F.lit(2))), F.lit("-X"))
    zone = F.concat(F.lit("Asia/"), F.when(F.col("n_nationkey") % 5 == 0, "Tokyo").when(F.col("n_nationkey") % 5 == 1, "Shanghai").otherwise(F.col("n_name")))
    return _t(spark, d, "nation").select("n_nationkey", tx.region(F.when(F.col("n_nationkey") % 4 != 3, lang).otherwise("zh-TW"), zone).alias("region"), tx.region(F.upper(lang), F.lit(None).cast("string")).alias("by_language"))


def p24_odd_percentages(spark: SparkSession, d: str) -> DataFrame:
    """Percentages with many decimals as fractions of at most twelve digits."""
    f = nu.percent_to_fraction(F.col("p_retailprice") / 7)
    return _t(spark, d, "part").select("p_partkey", f["num"].alias("num"), f["den"].alias("den"))


def p25_odd_fractions(spark: SparkSession, d: str) -> DataFrame:
    """The nearest fractions of quotients that are none of small numbers."""
    f = nu.best_fraction(F.col("p_retailprice") / (F.col("p_size") + 1234.5))
    return _t(spark, d, "part").select("p_partkey", f["num"].alias("num"), f["den"].alias("den"))


def p26_exercises(spark: SparkSession, d: str) -> DataFrame:
    """Five exercises of two kinds for each part, medium and hard ones in turn."""
    seeds = spread(_t(spark, d, "part")).select(F.col("p_partkey").alias("seed"), F.when(F.col("p_partkey") % 2 == 0, "medium").otherwise("hard").alias("level"))
    x = ex.exercises(seeds, ("shares", "traps"), 5)
    return x.select("seed", "n", "kind", F.array_join(F.transform(F.slice("numbers", 1, 2), lambda v: v.cast("long").cast("string")), ",").alias("numbers"), F.get("numbers", 2).alias("third"), "answer")


def g14_weighted_pick(spark: SparkSession, d: str) -> DataFrame:
    weights = F.array(F.col("l_quantity"), F.lit(0.0), F.col("l_linenumber").cast("double"), F.lit(7.0))
    r = chance.random(F.col("l_orderkey") - 5, F.col("l_linenumber"))
    # a column of its own: inside the pick it would be computed again wherever it stands
    drawn = _t(spark, d, "lineitem").select(*LINE, "l_partkey", "l_suppkey", r.alias("chance"), weights.alias("_weights"))
    return drawn.select(*LINE, "l_partkey", "l_suppkey", "chance", chance.pick(F.col("_weights"), F.col("chance")).alias("picked"))


QUERIES = {f.__name__: f for f in (g01_collated, g02_sections, g03_priorities, g05_ordered_distinct, j02_editorial, f06_lesson_search, f07_availability, f10_projection, f11_flattened, a21_tag_balance, i04_point_updates, i09_locales, t14_templates, t15_latex, t17_unique_names, t20_choices, t27_share_links, p24_fraction_to_percent, p25_directions, g11_shuffle, g11_named_seeds, k02_periods, i01_parse_xliff, i07_to_translate, t01_locale_casing, t21_formulas, t24_marks, t27_regions, p24_odd_percentages, p25_odd_fractions, p26_exercises, g14_weighted_pick)}

_ITEMS = "i AS (SELECT *, p_partkey % 3 <> 0 AS available, regexp_extract(p_brand, '(\\d+)$', 1)::INTEGER AS number FROM part)"


def _random(seed: str, nth: str) -> str:
    """SQL for the nth number of a seed."""
    m = "4294967296"
    a = f"((({seed})::HUGEINT + ({nth})::HUGEINT * 1831565813) % {m} + {m}) % {m}"
    t = f"(SELECT (xor(a::BIGINT, a::BIGINT >> 15)::HUGEINT * (a::BIGINT | 1)::HUGEINT % {m})::BIGINT AS t FROM (SELECT {a} AS a))"
    u = f"(SELECT xor(t, ((t::HUGEINT + xor(t, t >> 7)::HUGEINT * (t | 61)::HUGEINT) % {m})::BIGINT) AS u FROM {t})"
    return f"(SELECT xor(u, u >> 14)::DOUBLE / {m} FROM {u})"


_ENC = "replace(replace(replace(replace(replace(url_encode({}), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*')"
_URL, _TITLE, _TEXT = _ENC.format("url"), _ENC.format("title"), _ENC.format("text")

ORACLE_SQL = {
    "g01_collated": "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS titles FROM nation GROUP BY 1",
    "g02_sections": f"WITH {_ITEMS}, s AS (SELECT p_partkey, available, CASE WHEN number % 3 <> 0 THEN p_brand ELSE '__other' END AS section, CASE number % 3 WHEN 1 THEN number WHEN 2 THEN 999 ELSE 9999 END AS section_order FROM i) SELECT p_partkey, section, section_order, row_number() OVER (PARTITION BY section ORDER BY available DESC, p_partkey) AS rank FROM s",
    "g03_priorities": f"""WITH {_ITEMS}, c AS (SELECT a.p_partkey, b.p_partkey AS related,
  CASE WHEN a.p_partkey % 4 = 0 AND b.p_partkey - a.p_partkey IN (9, 5, 1) THEN -1 WHEN a.p_brand = b.p_brand AND a.p_type = b.p_type THEN 0 WHEN a.p_brand = b.p_brand THEN 1 ELSE 2 END AS tier FROM i a, i b WHERE b.available AND a.p_partkey <> b.p_partkey)
SELECT p_partkey, related, row_number() OVER (PARTITION BY p_partkey ORDER BY tier, CASE WHEN tier = -1 THEN -related ELSE related END) AS rank FROM c QUALIFY rank <= 6""",
    "g05_ordered_distinct": "WITH f AS (SELECT l_orderkey, l_returnflag, min((l_linenumber, l_returnflag)) AS first FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, string_agg(l_returnflag, ',' ORDER BY first) AS flags FROM f GROUP BY 1",
    "j02_editorial": f"WITH {_ITEMS} SELECT p_partkey, CASE WHEN number % 2 = 1 THEN p_brand || '/' || p_type END AS editorial FROM i WHERE available",
    "f06_lesson_search": "SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'econ')",
    "f07_availability": f"WITH {_ITEMS} SELECT p_brand, count(*) FILTER (available) AS available, count(*) FILTER (NOT available) AS to_come FROM i GROUP BY 1",
    "f10_projection": "SELECT p_partkey, p_size, p_brand FROM part",
    "f11_flattened": "SELECT r_name AS category, n_name AS \"group\", s_suppkey::VARCHAR AS item, s_name AS title, '/' || r_name || '/' || n_name || '/' || s_suppkey AS route FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "a21_tag_balance": r"SELECT page_id, tag, len(regexp_extract_all(html, '<' || tag || '(\s[^>]*)?>')) AS opened, len(regexp_extract_all(html, '</' || tag || '>')) AS closed FROM pages, (VALUES ('p'), ('ul'), ('li'), ('div'), ('html')) t(tag) WHERE opened > 0",
    "i04_point_updates": f"""WITH u AS ({_TARGETS}), c AS (SELECT CASE WHEN c_nationkey % 2 = 0 THEN 'fr' ELSE 'de' END AS locale, 'u' || c_custkey || CASE WHEN c_custkey % 7 = 0 THEN '_katex' ELSE '' END AS unit_id, CASE WHEN c_custkey % 2 = 0 THEN 'new source' END AS source, 'new ' || c_name AS target, CASE WHEN c_custkey % 4 = 0 THEN 'translated' END AS state FROM customer WHERE c_custkey % 3 = 0)
SELECT coalesce(u.locale, c.locale) AS locale, coalesce(u.unit_id, c.unit_id) AS unit_id, coalesce(c.source, u.source) AS source, coalesce(c.target, u.target) AS target, coalesce(c.state, CASE WHEN u.unit_id IS NULL THEN 'new' ELSE u.state END) AS state FROM u FULL JOIN c ON u.locale = c.locale AND u.unit_id = c.unit_id""",
    "i09_locales": "SELECT source, concat_ws(',', 'fr', string_agg(lang, ',' ORDER BY first) FILTER (lang <> 'fr')) AS locales FROM (SELECT source, lang, min(doc_id) AS first FROM documents GROUP BY 1, 2) GROUP BY 1",
    "t14_templates": r"""SELECT l_orderkey, l_linenumber, regexp_replace(printf('%.3f', floor((l_extendedprice / 7 + 2.220446049250313e-16) * 1000 + 0.5e0) / 1000), '\.?0+$', '') || ' \times ' || l_quantity::BIGINT || ' = \frac' || 'x\_y \%\\' || '{2} + \text{none}\text{empty} - 0' AS formula FROM lineitem""",
    "t15_latex": r"SELECT p_partkey, '{' || p_name || '} \frac \times \text 5\% \\other' || p_size AS latex FROM part",
    "t17_unique_names": "SELECT event_id, event_type || CASE WHEN n = 1 THEN '.a.txt' ELSE '.a (' || n || ').txt' END AS unique_name, 'a_b_' || user_id || '-part-' || lpad((event_id % 12)::VARCHAR, 2, '0') || '.pdf' AS part FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events)",
    "t20_choices": "SELECT l_orderkey, l_linenumber, coalesce(nullif(l_returnflag, 'A') = 'N', false) AS right FROM lineitem",
    "t27_share_links": f"""WITH p AS (SELECT page_id, url, 'Page n°' || page_id || ' (it''s ~ok!) *' AS title, CASE WHEN page_id % 2 = 0 THEN 'é & ü?' ELSE '' END AS text FROM pages)
SELECT page_id, 'mailto:?subject=' || {_TITLE} || '&body=' || CASE WHEN text <> '' THEN {_TEXT} || '%0A%0A' ELSE '' END || {_URL} AS email, 'https://wa.me/?text=' || CASE WHEN text <> '' THEN {_TEXT} || '%20' ELSE '' END || {_URL} AS whatsapp,
  'https://t.me/share/url?url=' || {_URL} || '&text=' || CASE WHEN text <> '' THEN {_TEXT} ELSE {_TITLE} END AS telegram, 'https://www.linkedin.com/sharing/share-offsite/?url=' || {_URL} AS linkedin, 'https://www.facebook.com/sharer/sharer.php?u=' || {_URL} AS facebook,
  'https://twitter.com/intent/tweet?url=' || {_URL} || CASE WHEN text <> '' THEN '&text=' || {_TEXT} ELSE '' END AS x FROM p""",
    "p24_fraction_to_percent": """WITH l AS (SELECT l_orderkey, l_linenumber, l_linenumber::BIGINT AS a, l_quantity::BIGINT AS b, floor(l_extendedprice)::BIGINT AS w FROM lineitem)
SELECT l_orderkey, l_linenumber, (a // gcd(a, b))::DOUBLE AS num, (b // gcd(a, b))::DOUBLE AS den, a::DOUBLE / b AS decimal, a::DOUBLE / b * 100 AS percent, true AS same_value, (40 // gcd(w, 40))::DOUBLE AS found_den, CASE WHEN a // gcd(a, b) = 1 THEN '1/' || (b // gcd(a, b)) END AS unit FROM l""",
    "p25_directions": "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice * 100 ELSE l_extendedprice / 100 END AS converted FROM lineitem",
    "g11_shuffle": f"""WITH l AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_linenumber)) AS l FROM lineitem GROUP BY 1),
r AS (SELECT k, n, {_random("k", "n")} AS r FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem), range(1, 8) x(n)),
rs AS (SELECT k, list(r ORDER BY n) AS rs FROM r GROUP BY 1),
j AS (SELECT l.k, l, list_transform(range(len(l), 1, -1), lambda i: [i::INTEGER, floor(rs[len(l) - i + 1] * i)::INTEGER + 1]) AS swaps FROM l JOIN rs ON rs.k = l.k)
SELECT k AS l_orderkey, array_to_string(list_reduce(list_prepend(l, swaps), lambda acc, e: list_transform(range(1, len(acc) + 1), lambda x: CASE x WHEN e[1] THEN acc[e[2]] WHEN e[2] THEN acc[e[1]] ELSE acc[x] END)), ',') AS shuffled FROM j""",
    "g11_named_seeds": f"""WITH RECURSIVE h AS (SELECT p_partkey, p_name, 0 AS i, 2166136261::HUGEINT AS h FROM part UNION ALL
  SELECT p_partkey, p_name, i + 1, (xor(h::BIGINT, ascii(substr(p_name, i + 1, 1))::BIGINT)::HUGEINT * 16777619) % 4294967296 FROM h WHERE i < length(p_name)),
s AS (SELECT p_partkey, xor(h::BIGINT, p_partkey) AS seed FROM h WHERE i = length(p_name)) SELECT p_partkey, seed, {_random("seed", "1")} AS first FROM s""",
    "k02_periods": """WITH RECURSIVE q AS (SELECT l_orderkey, l_linenumber, l_partkey AS a, l_quantity::BIGINT AS b FROM lineitem), d AS (SELECT DISTINCT a % b AS r0, b FROM q),
s AS (SELECT r0, b, r0 AS r, [r0] AS seen, '' AS digits FROM d UNION ALL
  SELECT r0, b, (r * 10) % b, list_append(seen, (r * 10) % b), digits || (r * 10 // b)::VARCHAR FROM s WHERE r <> 0 AND NOT list_contains(seen[:len(seen) - 1], r)),
e AS (SELECT r0, b, digits, CASE WHEN r = 0 THEN length(digits) ELSE list_position(seen, r) - 1 END AS n FROM s WHERE r = 0 OR list_contains(seen[:len(seen) - 1], r))
SELECT l_orderkey, l_linenumber, a // q.b AS whole, digits[1 : n] AS before, digits[n + 1 :] AS period, length(digits) - n AS length FROM q JOIN e ON e.r0 = q.a % q.b AND e.b = q.b""",
    "i01_parse_xliff": """SELECT p_brand AS path, p_partkey::VARCHAR AS unit_id, CASE WHEN p_partkey % 10 = 0 THEN p_brand ELSE p_name END AS source, CASE WHEN p_partkey % 10 <> 0 THEN p_type END AS target,
  CASE WHEN p_partkey % 10 <> 0 AND p_partkey % 2 = 0 THEN 'translated' ELSE '' END AS state FROM part""",
    "i07_to_translate": """WITH u AS (SELECT p_partkey AS k, 'part.' || p_partkey AS unit_id, p_name AS source FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 5 = 0)
SELECT unit_id, source, CASE WHEN k % 8 = 4 AND k % 5 <> 0 THEN 'fr ' || source END AS target, CASE WHEN k % 8 = 4 AND k % 5 <> 0 THEN 'translated' END AS state FROM u""",
    "t01_locale_casing": """WITH n AS (SELECT p_partkey, p_name AS n FROM part) SELECT p_partkey, upper(n) || ' IIİI SS' AS upper_root, replace(upper(replace(n, 'i', '#')), '#', 'İ') || ' IİİI SS' AS upper_tr,
  lower(n) || ' ıii' || chr(775) || 'i ß' AS lower_root, replace(lower(replace(n, 'I', '#')), '#', 'ı') || ' ıiiı ß' AS lower_tr FROM n""",
    "t21_formulas": "SELECT p_partkey, p_partkey % 3 <> 2 AS formula_id, p_partkey % 4 < 2 AND p_partkey % 7 <> 0 AS formula FROM part",
    "t24_marks": "SELECT p_partkey, '{{a}},ph:P' || p_partkey || ',pc:S' || p_partkey || ',pc:E' AS marks FROM part",
    "t27_regions": """WITH n AS (SELECT n_nationkey AS k, lower(n_name[1:2]) AS l FROM nation), r AS (SELECT k, l, CASE l WHEN 'zh' THEN 'CN' WHEN 'ja' THEN 'JP' WHEN 'ko' THEN 'KR' WHEN 'ru' THEN 'RU_CIS'
  ELSE CASE WHEN l IN ('en', 'fr', 'de', 'es', 'it', 'nl', 'pt', 'sv', 'da', 'no', 'fi', 'pl', 'cs', 'sk', 'ro', 'hu', 'el', 'tr', 'uk', 'bg') THEN 'EU_US' ELSE 'GLOBAL' END END AS own FROM n)
SELECT k AS n_nationkey, CASE WHEN k % 4 = 3 OR k % 5 = 1 THEN 'CN' WHEN l = 'ja' OR k % 5 = 0 THEN 'JP' ELSE own END AS region, own AS by_language FROM r""",
    "p24_odd_percentages": """WITH x AS (SELECT p_partkey, p_retailprice / 7 / 100 AS x FROM part), d AS (SELECT *, least(12, length(split_part(x::VARCHAR, '.', 2))) AS n FROM x),
f AS (SELECT *, floor(x * (10::BIGINT ** n) + 0.5e0)::BIGINT AS num, (10::BIGINT ** n)::BIGINT AS den FROM d) SELECT p_partkey, (num // gcd(num, den))::DOUBLE AS num, (den // gcd(num, den))::DOUBLE AS den FROM f""",
    "p25_odd_fractions": """WITH x AS (SELECT p_partkey, p_retailprice / (p_size + 1234.5e0) AS x FROM part), e AS (SELECT p_partkey, d, floor(x * d + 0.5e0) AS n, abs(x - floor(x * d + 0.5e0) / d) AS e FROM x, range(1, 1001) r(d)),
b AS (SELECT p_partkey, min(d) FILTER (e < 1e-12) AS exact, arg_min(d, (e, d)) AS best FROM e GROUP BY 1) SELECT p_partkey, n AS num, d::DOUBLE AS den FROM b JOIN e USING (p_partkey) WHERE d = coalesce(exact, best)""",
    "p26_exercises": f"""WITH RECURSIVE r AS (SELECT p_partkey AS seed, p_partkey % 2 = 1 AS hard, list({_random("greatest(p_partkey, 1)", "n")} ORDER BY n) AS rs FROM part, range(1, 121) x(n) GROUP BY 1, 2),
t AS (SELECT seed, hard, rs, 0 AS tries, 5 AS i, len(list_filter(rs[1:5], lambda r: r < 0.5)) AS q1, len(list_filter(rs[1:5], lambda r: r >= 0.5)) AS q2, []::BIGINT[][] AS found FROM r
UNION ALL SELECT seed, hard, rs, tries + 1, i + CASE WHEN shares THEN 4 ELSE 3 END, CASE WHEN shares AND new THEN greatest(q1 - 1, 0) ELSE q1 END, CASE WHEN NOT shares AND new THEN greatest(q2 - 1, 0) ELSE q2 END, CASE WHEN new THEN list_append(found, sign) ELSE found END
  FROM (SELECT *, NOT list_contains(found, sign) AS new FROM (SELECT *, CASE WHEN shares THEN [floor(10 + 191 * rs[i + 2])::BIGINT, floor(10 + 241 * rs[i + 3])::BIGINT, floor(10 + 291 * rs[i + 4])::BIGINT]
      WHEN hard THEN [floor(5 + 56 * rs[i + 3])::BIGINT, [37, 58, 99, 135, 175, 260, 420, 875, 1333, 2460, 5100, 7800][1 + floor(rs[i + 2] * 12)::INTEGER]]
      ELSE [floor(5 + 36 * rs[i + 3])::BIGINT, [18, 36, 72, 96, 125, 150, 180, 240, 360, 480, 750, 1200, 1500, 3200][1 + floor(rs[i + 2] * 14)::INTEGER]] END AS sign
    FROM (SELECT *, CASE WHEN q1 + q2 = 0 THEN rs[i + 1] < 0.5 ELSE q1 > 0 AND (q2 = 0 OR rs[i + 1] * (q1 + q2) <= q1) END AS shares FROM t WHERE len(found) < 5 AND tries < 125)))),
e AS (SELECT seed, unnest(found) AS s, unnest(range(1, 6)) AS n FROM t WHERE len(found) = 5),
v AS (SELECT seed, n::INTEGER AS n, len(s) = 3 AS shares, s, s[2] * (1 + s[1] / 100e0) * (1 - s[1] / 100e0) AS last FROM e)
SELECT seed, n, CASE WHEN shares THEN 'shares' ELSE 'traps' END AS kind, s[1] || ',' || s[2] AS numbers, CASE WHEN shares THEN s[3]::DOUBLE ELSE last END AS third,
  CASE WHEN shares THEN s[1] / (s[1] + s[2] + s[3])::DOUBLE * 100 ELSE (last - s[2]) / s[2] * 100 END AS answer FROM v""",
    "g14_weighted_pick": f"WITH r AS (SELECT *, {_random('l_orderkey - 5', 'l_linenumber')} AS chance FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, chance, CASE WHEN chance * (l_quantity + l_linenumber + 7) <= l_quantity THEN 0 WHEN chance * (l_quantity + l_linenumber + 7) <= l_quantity + l_linenumber THEN 2 ELSE 3 END AS picked FROM r",
}
