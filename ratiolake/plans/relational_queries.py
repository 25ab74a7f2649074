"""Joins, filters, tiers, sets and conditional aggregates over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratiolake.operators import relational as rel
from ratiolake.tables import short_list


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def a03_top_types(spark: SparkSession, d: str) -> DataFrame:
    """The four most frequent types; ties by the first seen."""
    seen = _t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))
    return seen.orderBy(F.desc("n"), "first_id").limit(4)


def a05_conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").agg(
        F.count_if(F.col("o_orderstatus") == "O").alias("open"),
        F.count_if(F.col("o_orderstatus") == "F").alias("finished"),
        F.count_if(~F.col("o_orderstatus").isin("O", "F")).alias("other"),
        F.max("o_totalprice").alias("most"),
    )


def a09_mixed_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.max("l_extendedprice").alias("most"), F.round(F.avg("l_discount"), 6).alias("mean_discount"), F.count_if(F.col("l_tax") > 0.05).alias("taxed"), F.bool_or(F.col("l_discount") == 0).alias("any_full")
    )


def a12_counts_by_pivot(spark: SparkSession, d: str) -> DataFrame:
    wide = _t(spark, d, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "2-HIGH"]).agg(F.count(F.lit(1)))
    return wide.select("o_orderstatus", F.coalesce("1-URGENT", F.lit(0)).alias("urgent"), F.coalesce("2-HIGH", F.lit(0)).alias("high"))


def a15_merge_by_key(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences added, places united and sorted, the first value that is there."""
    rows = _t(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > 25, F.col("l_returnflag")).alias("flag"))
    first = F.min_by("flag", F.when(F.col("flag").isNotNull(), F.struct("l_orderkey", "l_linenumber", "flag")))
    return rows.groupBy("l_partkey").agg(F.count("*").alias("occurrences"), F.array_join(F.array_sort(F.collect_set("l_linenumber")).cast("array<string>"), ",").alias("places"), first.alias("first_flag"))


def j01_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Supplier with nation and region; gone if one is missing."""
    s, n, r = (_t(spark, d, x) for x in ("supplier", "nation", "region"))
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select("s_suppkey", "s_name", "n_name", "r_name")


def j03_unknown_keys(spark: SparkSession, d: str) -> DataFrame:
    c, o = _t(spark, d, "customer"), _t(spark, d, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey", "c_name")


def j04_duplicates(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").distinct()
    return rel.later_duplicates(rows, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def j05_other_bucket(spark: SparkSession, d: str) -> DataFrame:
    """Sections with their items; items of an undeclared section go to __other, empty sections stay."""
    declared = _t(spark, d, "nation").filter("n_regionkey < 3").select("n_nationkey", "n_name")
    per = _t(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    joined = declared.join(per, declared["n_nationkey"] == per["c_nationkey"], "full_outer")
    return joined.groupBy(F.coalesce("n_name", F.lit("__other")).alias("section")).agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))


def j11_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The first of several lookups that has a value."""
    c = _t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    spent = _t(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderpriority").alias("own"))
    n, r = _t(spark, d, "nation"), _t(spark, d, "region")
    n = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("nation"), "r_name")
    x = c.join(spent, c["c_custkey"] == spent["o_custkey"], "left").join(n, c["c_nationkey"] == n["n_nationkey"], "left")
    return x.select("c_custkey", F.coalesce("own", "nation", "r_name").alias("found"))


def j12_cross(spark: SparkSession, d: str) -> DataFrame:
    """Every route in every locale; the locales are a short list."""
    names = F.array(*map(F.lit, short_list(_t(spark, d, "nation"), "n_name")))
    return _t(spark, d, "region").select("r_name", F.explode(names).alias("n_name")).select(F.concat(F.lit("/"), F.lower("r_name"), F.lit("/"), F.lower("n_name")).alias("route"))


def f01_haystack(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "part")
    return p.filter(rel.haystack(" Brand#1", F.col("p_name"), F.col("p_brand"), F.col("p_type"))).select("p_partkey", "p_brand")


def f02_any_field(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "part")
    return p.filter(rel.any_field("11", F.col("p_partkey"), F.col("p_brand"))).select("p_partkey", "p_brand")


def f08_page_range(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("most"))
    return rows.filter(rel.in_range(F.col("l_linenumber"), F.lit(9), F.lit(3), F.col("most"))).select("l_orderkey", "l_linenumber", "most")


def g03_related(spark: SparkSession, d: str) -> DataFrame:
    items = _t(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    return rel.tiered_top_k(items.withColumn("at", F.col("p_partkey")), "p_partkey", "at", [["p_brand", "p_type"], ["p_brand"], ["p_type"], []], 6)


def g04_keep_first(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return rel.keep_first(rows, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


def g06_union(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")).union(_t(spark, d, "customer").select("c_nationkey")).distinct()


def g07_differences(spark: SparkSession, d: str) -> DataFrame:
    per = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") == "N", F.col("l_linenumber"))).alias("a"), F.collect_set(F.when(F.col("l_linestatus") == "O", F.col("l_linenumber"))).alias("b"))
    both = rel.differences(F.col("a"), F.col("b"))
    return per.select("l_orderkey", *[F.array_join(F.array_sort(c).cast("array<string>"), ",").alias(n) for n, c in both.items()])


def g09_merge_intervals(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 10).alias("a"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int") - 20).alias("b"))
    return rel.merge_intervals(rows, "l_orderkey", "a", "b").toDF("l_orderkey", "first_page", "last_page")


def g12_offsets(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", F.col("l_quantity").cast("long").alias("pages"))
    return rel.offsets(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "pages"], "pages").select("l_orderkey", "l_linenumber", "pages", F.col("first").alias("first_page"))


def g13_batches(spark: SparkSession, d: str) -> DataFrame:
    return rel.batches(_t(spark, d, "events").select("event_id", "event_type"), "event_type", ["event_id"], 40)


QUERIES = {f.__name__: f for f in (a03_top_types, a05_conditional_counts, a09_mixed_aggregate, a12_counts_by_pivot, a15_merge_by_key, j01_lookup, j03_unknown_keys, j04_duplicates, j05_other_bucket, j11_fallback, j12_cross, f01_haystack, f02_any_field, f08_page_range, g03_related, g04_keep_first, g06_union, g07_differences, g09_merge_intervals, g12_offsets, g13_batches)}

ORACLE_SQL = {
    "a03_top_types": "SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1 ORDER BY n DESC, first_id LIMIT 4",
    "a05_conditional_counts": "SELECT count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) AS other, max(o_totalprice) AS most FROM orders",
    "a09_mixed_aggregate": "SELECT l_returnflag, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS quantity, max(l_extendedprice) AS most, round(avg(l_discount), 6) AS mean_discount, count(*) FILTER (l_tax > 0.05e0) AS taxed, bool_or(l_discount = 0) AS any_full FROM lineitem GROUP BY 1",
    "a12_counts_by_pivot": "SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '2-HIGH') AS high FROM orders GROUP BY 1",
    "a15_merge_by_key": "SELECT l_partkey, count(*) AS occurrences, array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS places, arg_min(l_returnflag, (l_orderkey, l_linenumber, l_returnflag)) FILTER (l_quantity > 25) AS first_flag FROM lineitem GROUP BY 1",
    "j01_lookup": "SELECT s_suppkey, s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "j03_unknown_keys": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)",
    "j04_duplicates": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey) AS i FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM lineitem)) WHERE i > 1",
    "j05_other_bucket": "SELECT section, sum(n)::BIGINT AS n FROM (SELECT coalesce(n_name, '__other') AS section, coalesce(c.n, 0) AS n FROM (SELECT * FROM nation WHERE n_regionkey < 3) d FULL JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c ON d.n_nationkey = c.c_nationkey) GROUP BY 1",
    "j11_fallback": "SELECT c_custkey, coalesce((SELECT max(o_orderpriority) FROM orders WHERE o_custkey = c_custkey), CASE WHEN n_nationkey % 2 = 0 THEN n_name END, r_name) AS found FROM customer LEFT JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON c_nationkey = n_nationkey",
    "j12_cross": "SELECT '/' || lower(r_name) || '/' || lower(n_name) AS route FROM region, nation",
    "f01_haystack": "SELECT p_partkey, p_brand FROM part WHERE contains(lower(coalesce(p_name, '') || ' ' || coalesce(p_brand, '') || ' ' || coalesce(p_type, '')), 'brand#1')",
    "f02_any_field": "SELECT p_partkey, p_brand FROM part WHERE contains(p_partkey::VARCHAR, '11') OR contains(lower(p_brand), '11')",
    "f08_page_range": "SELECT l_orderkey, l_linenumber, l_quantity::INTEGER AS most FROM lineitem WHERE l_linenumber BETWEEN greatest(1, least(3, l_quantity::INTEGER)) AND greatest(1, least(9, l_quantity::INTEGER))",
    "g03_related": "SELECT p_partkey, related, rank FROM (SELECT a.p_partkey, b.p_partkey AS related, row_number() OVER (PARTITION BY a.p_partkey ORDER BY CASE WHEN a.p_brand = b.p_brand AND a.p_type = b.p_type THEN 0 WHEN a.p_brand = b.p_brand THEN 1 WHEN a.p_type = b.p_type THEN 2 ELSE 3 END, b.p_partkey) AS rank FROM part a, part b WHERE a.p_partkey <> b.p_partkey) WHERE rank <= 6",
    "g04_keep_first": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events) WHERE i = 1",
    "g06_union": "SELECT s_nationkey AS nation FROM supplier UNION SELECT c_nationkey FROM customer",
    "g07_differences": "SELECT l_orderkey, coalesce(string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) FILTER (a AND NOT b), '') AS missing, coalesce(string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) FILTER (b AND NOT a), '') AS extra FROM (SELECT l_orderkey, l_linenumber, bool_or(l_returnflag = 'N') AS a, bool_or(l_linestatus = 'O') AS b FROM lineitem GROUP BY 1, 2) GROUP BY 1",
    "g09_merge_intervals": "WITH x AS (SELECT l_orderkey, least(a, b) AS a, greatest(a, b) AS b FROM (SELECT l_orderkey, l_linenumber * 10 AS a, l_linenumber * 10 + l_quantity::INTEGER - 20 AS b FROM lineitem)), p AS (SELECT DISTINCT l_orderkey, unnest(range(a, b + 1)) AS p FROM x), i AS (SELECT l_orderkey, p, p - row_number() OVER (PARTITION BY l_orderkey ORDER BY p) AS g FROM p) SELECT l_orderkey, min(p)::INTEGER AS first_page, max(p)::INTEGER AS last_page FROM i GROUP BY l_orderkey, g",
    "g12_offsets": "SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS pages, (sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity ROWS UNBOUNDED PRECEDING) - l_quantity::BIGINT + 1)::BIGINT AS first_page FROM lineitem",
    "g13_batches": "SELECT event_id, event_type, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 40 AS batch FROM events",
}
