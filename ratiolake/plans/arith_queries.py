"""The scalar tools over the rows of the driver's tables. Inputs hold zeros, nulls and negative numbers on purpose."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratiolake.functions import arith, lists

_LINE = ("lineitem", ["l_orderkey", "l_linenumber"])
_PRICE, _DISC, _TAX = "l_extendedprice", "l_discount * 100", "l_tax * 100"
_QTY = "nullif(l_quantity, 10)"
_STEP = "cast(l_linenumber - 2 as double)"

# name: (table and keys, inputs, tool, results with the SQL that gives them)
_ROWS: dict[str, tuple[tuple[str, list[str]], dict[str, str], Callable[..., arith.Results], dict[str, str]]] = {
    "p01_percentage_of_number": (_LINE, {"p": _DISC, "b": _PRICE}, arith.of_number, {"amount": "b * p / 100", "coefficient": "p / 100", "one_percent": "b / 100"}),
    "p02_what_percent": (_LINE, {"x": _QTY, "y": _STEP}, arith.what_percent, {"ratio": "x / nullif(y, 0)", "percent": "x / nullif(y, 0) * 100"}),
    "p03_variation": (_LINE, {"a": _STEP, "b": _QTY}, arith.variation, {"delta": "b - a", "percent": "(b - a) / nullif(a, 0) * 100", "multiplier": "b / nullif(a, 0)", "trend": "CASE WHEN b > a THEN 'up' WHEN b < a THEN 'down' WHEN b = a THEN 'flat' END"}),
    "p04_increase_decrease": (_LINE, {"b": _PRICE, "r": "l_discount * 100 - 5"}, arith.increase_decrease, {"coefficient": "1 + r / 100", "final": "b * (1 + r / 100)", "delta": "b * (1 + r / 100) - b", "trend": "CASE WHEN r > 0 THEN 'up' WHEN r < 0 THEN 'down' WHEN r = 0 THEN 'flat' END"}),
    "p05_reverse": (_LINE, {"f": _PRICE, "r": "CASE WHEN l_linenumber = 4 THEN -100e0 ELSE -l_discount * 100 END"}, arith.reverse, {"base": "f / nullif(1 + r / 100, 0)"}),
    "p06_applied_rate": (_LINE, {"a": _STEP, "b": _QTY}, arith.applied_rate, {"coefficient": "b / nullif(a, 0)", "rate": "(b / nullif(a, 0) - 1) * 100", "difference": "b - a"}),
    "p07_missing_rate": (_LINE, {"a": _PRICE, "b": "l_extendedprice * (1 - l_discount)"}, arith.missing_rate, {"coefficient": "b / nullif(a, 0)", "rate": "(b / nullif(a, 0) - 1) * 100", "difference": "b - a"}),
    "p08_coefficient": (_LINE, {"m": "CASE WHEN l_linenumber % 2 = 0 THEN 'percent_to_coef' ELSE 'coef_to_percent' END", "x": _DISC}, arith.coefficient, {"converted": "CASE WHEN m = 'percent_to_coef' THEN 1 + x / 100 ELSE (x - 1) * 100 END"}),
    "p09_relative_difference": (_LINE, {"a": _STEP, "b": "cast(3 - l_linenumber as double)"}, arith.relative_difference, {"difference": "abs(a - b)", "mean": "(abs(a) + abs(b)) / 2", "percent": "abs(a - b) / nullif((abs(a) + abs(b)) / 2, 0) * 100"}),
    "p10_successive": (_LINE, {"b": _PRICE, "p": f"-{_DISC}", "q": _TAX, "s": _QTY}, arith.successive, {"coefficient": "1e0 * (1 + p / 100) * (1 + q / 100) * (1 + coalesce(s, 0) / 100)", "final": "b * (1e0 * (1 + p / 100) * (1 + q / 100) * (1 + coalesce(s, 0) / 100))", "percent": "(1e0 * (1 + p / 100) * (1 + q / 100) * (1 + coalesce(s, 0) / 100) - 1) * 100"}),
    "p11_difference_relative": (_LINE, {"a": _STEP, "b": _QTY, "r": "CASE WHEN l_returnflag = 'A' THEN 'a' ELSE 'b' END"}, arith.difference_to, {"difference": "b - a", "percent": "(b - a) / nullif(CASE WHEN r = 'a' THEN a ELSE b END, 0) * 100", "ratio": "CASE WHEN r = 'a' THEN b / nullif(a, 0) ELSE a / nullif(b, 0) END"}),
    "p12_compare": (_LINE, {"p": f"-{_DISC}", "q": _TAX, "b": f"CASE WHEN l_linenumber = 5 THEN 0e0 ELSE {_PRICE} END"}, arith.compare, {"value_a": "b * (1 + p / 100)", "value_b": "b * (1 + q / 100)", "difference": "b * (1 + q / 100) - b * (1 + p / 100)", "percent": "(b * (1 + q / 100) - b * (1 + p / 100)) / nullif(b * (1 + p / 100), 0) * 100"}),
    "p13_cumulative_or_naive": (_LINE, {"b": _PRICE, "p": f"-{_DISC}", "q": _TAX}, arith.cumulative_or_naive, {"compounded": "b * (1 + p / 100) * (1 + q / 100)", "naive": "b * (1 + (p + q) / 100)", "difference": "b * (1 + p / 100) * (1 + q / 100) - b * (1 + (p + q) / 100)", "percent": "(b * (1 + p / 100) * (1 + q / 100) - b * (1 + (p + q) / 100)) / nullif(b * (1 + (p + q) / 100), 0) * 100"}),
    "p14_points": (_LINE, {"a": _DISC, "b": _TAX}, arith.points, {"points": "b - a", "percent": "(b - a) / nullif(a, 0) * 100", "ratio": "b / nullif(a, 0)"}),
    "p17_error": (_LINE, {"m": _QTY, "r": _STEP}, arith.error, {"signed": "m - r", "absolute": "abs(m - r)", "percent": "abs(m - r) / nullif(abs(r), 0) * 100", "ratio": "m / nullif(r, 0)"}),
    "p18_of_total": (_LINE, {"v": _QTY, "t": "cast((l_linenumber - 2) * 20 as double)"}, arith.of_total, {"ratio": "v / nullif(t, 0)", "percent": "v / nullif(t, 0) * 100", "remaining": "t - v", "percent_left": "100 - v / nullif(t, 0) * 100", "over": "t <> 0 AND v > t"}),
    "p19_part_of_total": (_LINE, {"m": "CASE l_returnflag WHEN 'A' THEN 'pctFromPart' WHEN 'N' THEN 'valueFromPct' ELSE 'totalFromPartPct' END", "a": _QTY, "p": _DISC, "t": _STEP}, arith.part_of_total, {"result": "CASE m WHEN 'pctFromPart' THEN a / nullif(t, 0) * 100 WHEN 'valueFromPct' THEN p / 100 * t ELSE a / nullif(p / 100, 0) END", "rest": "CASE m WHEN 'pctFromPart' THEN t - a WHEN 'valueFromPct' THEN t - p / 100 * t ELSE a / nullif(p / 100, 0) - a END", "warning": "CASE WHEN m = 'pctFromPart' AND t = 0 THEN 'total_zero' WHEN m = 'totalFromPartPct' AND p = 0 THEN 'percent_zero' END"}),
    "p21_limits": (
        _LINE,
        {"a": _STEP, "b": "CASE WHEN l_quantity < 5 THEN 0e0 WHEN l_quantity > 45 THEN -l_quantity WHEN l_quantity = 20 THEN NULL ELSE l_quantity END"},
        arith.limits,
        {
            "delta": "b - a",
            "coefficient": "b / nullif(a, 0)",
            "percent": "(b - a) / nullif(a, 0) * 100",
            "warning": "CASE WHEN a = 0 AND b <> 0 THEN 'initial_zero' WHEN a > 0 AND b < 0 THEN 'negative_final' END",
            "meaning": "CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN a = 0 THEN CASE WHEN b = 0 THEN 'both_zero' ELSE 'from_zero' END WHEN a > 0 AND b = 0 THEN 'minus_100' WHEN a > 0 AND b > 0 THEN CASE WHEN (b - a) / a * 100 > 1000 THEN 'huge' ELSE 'ok' END ELSE 'generic' END",
        },
    ),
    "p23_ratio": (
        _LINE,
        {"a": _QTY, "b": "CASE WHEN l_linenumber = 6 THEN 0.5e0 ELSE cast(4 * (l_linenumber - 2) as double) END"},
        arith.ratio,
        {
            "a_of_b": "a / nullif(b, 0) * 100",
            "b_of_a": "b / nullif(a, 0) * 100",
            "share_a": "a / nullif(a + b, 0) * 100",
            "share_b": "b / nullif(a + b, 0) * 100",
            "reduced": "CASE WHEN abs(b - floor(b + 0.5)) < 1e-9 AND gcd(abs(a)::BIGINT, abs(b)::BIGINT) <> 0 THEN (a::BIGINT // gcd(abs(a)::BIGINT, abs(b)::BIGINT))::VARCHAR || ':' || (b::BIGINT // gcd(abs(a)::BIGINT, abs(b)::BIGINT))::VARCHAR END",
            "warning": "CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN b = 0 THEN 'b_zero' WHEN a = 0 THEN 'a_zero' END",
        },
    ),
    "r01_rule_of_three": (_LINE, {"a": _STEP, "b": _PRICE, "c": _QTY}, arith.rule_of_three, {"ratio": "b / nullif(a, 0)", "x": "b * c / nullif(a, 0)"}),
    "r04_inverse_rule_of_three": (_LINE, {"a": _QTY, "b": _PRICE, "c": _STEP}, arith.inverse_rule_of_three, {"product": "a * b", "x": "a * b / nullif(c, 0)"}),
}


def _row_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    (table, keys), inputs, tool, _ = _ROWS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*keys, *[f"{e} AS {n}" for n, e in inputs.items()])
        return rows.select(*keys, *[c.alias(n) for n, c in tool(*[F.col(n) for n in inputs]).items()])

    return run


def _row_sql(name: str) -> str:
    (table, keys), inputs, _, results = _ROWS[name]
    inner = ", ".join([*keys, *[f"{e} AS {n}" for n, e in inputs.items()]])
    return f"SELECT {', '.join([*keys, *[f'{e} AS {n}' for n, e in results.items()]])} FROM (SELECT {inner} FROM {table})"


def _order_lists(spark: SparkSession, sf_dir: str, **columns: str) -> DataFrame:
    """Per order, arrays over its lines by line number."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey", "l_linenumber", *[f"{e} AS {n}" for n, e in columns.items()])
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", *columns)))
    rows = rows.groupBy("l_orderkey").agg(lines.alias("lines"))
    return rows.select("l_orderkey", *[F.col(f"lines.{n}").alias(n) for n in columns])


def _named(keys: list[str], results: arith.Results, places: int | None = None) -> list[Column | str]:
    rounded = {"coefficient", "percent", "final", "naive", "amount", "weights", "weighted_sum", "mean", "total", "first_percent", "rest", "rest_percent"}
    return [*keys, *[(F.round(c, places) if places is not None and n in rounded else c).alias(n) for n, c in results.items()]]


def p15_equivalent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _order_lists(spark, sf_dir, p="CASE WHEN l_linenumber = 3 THEN NULL ELSE -l_discount * 100 END")
    return rows.select(*_named(["l_orderkey"], lists.equivalent(F.lit(1000.0), F.col("p"))))


def p16_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _order_lists(spark, sf_dir, p="100 - l_discount * 100")
    return rows.select(*_named(["l_orderkey"], lists.composition(F.lit(1000.0), F.col("p"))))


def p20_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _order_lists(spark, sf_dir, rate="nullif(l_discount * 100, 0)", weight="CASE WHEN l_orderkey % 5 = 0 THEN 0e0 ELSE l_quantity - 20 END")
    return rows.select(*_named(["l_orderkey"], lists.weighted(F.arrays_zip("rate", "weight")), 6))


def p22_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _order_lists(spark, sf_dir, v="l_quantity")
    out = rows.select("l_orderkey", F.explode(lists.parts(F.col("v"))["shares"]).alias("s"))
    return out.select("l_orderkey", "s.label", "s.value", F.round("s.percent", 6).alias("percent"))


def r05_table_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _order_lists(spark, sf_dir, a="CASE WHEN l_linenumber = 4 AND l_orderkey % 7 = 0 THEN 0e0 ELSE cast(l_linenumber as double) END", b="CASE WHEN l_linenumber = 3 AND l_orderkey % 3 = 0 THEN NULL ELSE l_linenumber * 2.5e0 + CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END END")
    out = lists.table_check(F.col("a"), F.col("b"))
    return rows.select("l_orderkey", out["code"].alias("code"), out["k"].alias("k"), F.array_join(out["bad"].cast("array<string>"), ",").alias("bad"))


def r06_table_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _order_lists(spark, sf_dir, a="CASE WHEN l_linenumber = 1 AND l_orderkey % 2 = 0 THEN NULL ELSE cast(l_linenumber as double) END", b="CASE WHEN l_linenumber = 2 AND l_orderkey % 2 = 1 THEN NULL WHEN l_orderkey % 11 = 0 THEN 0e0 ELSE l_linenumber * 2.5e0 END")
    out = lists.table_complete(F.col("a"), F.col("b"))
    return rows.select("l_orderkey", out["code"].alias("code"), out["row"].alias("cell_row"), out["at"].cast("long").alias("cell_at"), out["value"].alias("cell_value"))


_TABLE = """
WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, a NULLS FIRST, b NULLS FIRST) AS i, a, b FROM (SELECT l_orderkey, l_linenumber, {a} AS a, {b} AS b FROM lineitem)),
c AS (SELECT *, b / nullif(a, 0) AS k, first_value(b / nullif(a, 0)) OVER (PARTITION BY l_orderkey ORDER BY i) AS k0 FROM l WHERE a IS NOT NULL AND b IS NOT NULL),
o AS (SELECT l_orderkey, count(*) AS n, bool_or(a = 0) AS zero, any_value(k0) AS k0,
        count(*) FILTER (abs(k - k0) > 1e-9 * greatest(1, abs(k0))) AS n_bad,
        string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (abs(k - k0) > 1e-9 * greatest(1, abs(k0))) AS bad FROM c GROUP BY l_orderkey),
g AS (SELECT l_orderkey, count(*) FILTER (a IS NULL) AS g1, count(*) FILTER (b IS NULL) AS g2,
        min(i) FILTER (a IS NULL) AS i1, min(i) FILTER (b IS NULL) AS i2,
        min(b) FILTER (a IS NULL) AS other1, min(a) FILTER (b IS NULL) AS other2 FROM l GROUP BY l_orderkey)
"""
_CHECK = _TABLE.format(a="CASE WHEN l_linenumber = 4 AND l_orderkey % 7 = 0 THEN 0e0 ELSE cast(l_linenumber as double) END", b="CASE WHEN l_linenumber = 3 AND l_orderkey % 3 = 0 THEN NULL ELSE l_linenumber * 2.5e0 + CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END END")
_COMPLETE = _TABLE.format(a="CASE WHEN l_linenumber = 1 AND l_orderkey % 2 = 0 THEN NULL ELSE cast(l_linenumber as double) END", b="CASE WHEN l_linenumber = 2 AND l_orderkey % 2 = 1 THEN NULL WHEN l_orderkey % 11 = 0 THEN 0e0 ELSE l_linenumber * 2.5e0 END")

QUERIES = {name: _row_query(name) for name in _ROWS} | {
    "p15_equivalent": p15_equivalent,
    "p16_composition": p16_composition,
    "p20_weighted": p20_weighted,
    "p22_parts": p22_parts,
    "r05_table_check": r05_table_check,
    "r06_table_complete": r06_table_complete,
}

ORACLE_SQL = {name: _row_sql(name) for name in _ROWS} | {
    "p15_equivalent": "SELECT l_orderkey, k AS coefficient, (k - 1) * 100 AS percent, 1000 * k AS final, s AS naive FROM (SELECT l_orderkey, list_reduce(list_prepend(1e0, list(1 + coalesce(p, 0) / 100 ORDER BY l_linenumber, p NULLS FIRST)), lambda a, x: a * x) AS k, list_reduce(list_prepend(0e0, list(coalesce(p, 0) ORDER BY l_linenumber, p NULLS FIRST)), lambda a, x: a + x) AS s FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN NULL ELSE -l_discount * 100 END AS p FROM lineitem) GROUP BY l_orderkey)",
    "p16_composition": "SELECT l_orderkey, k AS coefficient, k * 100 AS percent, 1000 * k AS amount FROM (SELECT l_orderkey, list_reduce(list_prepend(1e0, list((100 - l_discount * 100) / 100 ORDER BY l_linenumber, l_discount DESC)), lambda a, x: a * x) AS k FROM lineitem GROUP BY l_orderkey)",
    "p20_weighted": "SELECT l_orderkey, round(w, 6) AS weights, round(s, 6) + 0 AS weighted_sum, round(s / nullif(w, 0), 6) + 0 AS mean FROM (SELECT l_orderkey, sum(w) AS w, sum(coalesce(r, 0) * w) AS s FROM (SELECT l_orderkey, nullif(l_discount * 100, 0) AS r, CASE WHEN l_orderkey % 5 = 0 THEN 0e0 ELSE l_quantity - 20 END AS w FROM lineitem) GROUP BY l_orderkey)",
    "p22_parts": "SELECT l_orderkey, chr((64 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity))::INTEGER) AS label, l_quantity AS value, round(l_quantity / nullif(sum(l_quantity) OVER (PARTITION BY l_orderkey), 0) * 100, 6) AS percent FROM lineitem",
    "r05_table_check": _CHECK + "SELECT g.l_orderkey, CASE WHEN o.zero THEN 'div0' WHEN coalesce(o.n, 0) < 2 THEN 'need_data' WHEN o.n_bad > 0 THEN 'not_proportional' ELSE 'ok' END AS code, CASE WHEN NOT o.zero AND o.n >= 2 THEN o.k0 END AS k, CASE WHEN NOT o.zero AND o.n >= 2 THEN coalesce(o.bad, '') ELSE '' END AS bad FROM g LEFT JOIN o ON g.l_orderkey = o.l_orderkey",
    "r06_table_complete": _COMPLETE + ", s AS (SELECT g.*, o.k0 AS k, CASE WHEN o.zero THEN 'div0' WHEN g1 + g2 <> 1 THEN 'need_one_empty' WHEN o.n IS NULL THEN 'no_reference' WHEN o.n_bad > 0 THEN 'not_proportional' WHEN g1 = 1 AND o.k0 = 0 THEN 'div0' ELSE 'ok' END AS code FROM g LEFT JOIN o ON g.l_orderkey = o.l_orderkey) SELECT l_orderkey, code, CASE WHEN code = 'ok' THEN CASE WHEN g1 = 1 THEN 1 ELSE 2 END END AS cell_row, CASE WHEN code = 'ok' THEN coalesce(i1, i2) END AS cell_at, CASE WHEN code = 'ok' THEN CASE WHEN g1 = 1 THEN other1 / k ELSE k * other2 END END AS cell_value FROM s",
}
