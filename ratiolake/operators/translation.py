"""Translation units as tables (locale, unit_id, source, target, state): merge, check, progress, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratiolake.functions import text as tx
from ratiolake.tables import short_list

UNIT = ["locale", "unit_id", "source", "target", "state"]


def create_locale(source: DataFrame, locales: DataFrame) -> DataFrame:
    """Units of new locales: to be done, but for formulas, which are copied. locales is a short list."""
    return merge(source, source.sparkSession.createDataFrame([], "locale string, unit_id string, source string, target string, state string"), locales).drop("change")


def merge(source: DataFrame, targets: DataFrame, locales: DataFrame) -> DataFrame:
    """Target units brought up to date with source units (unit_id, source), and what was done: UNIT, change.

    New units are added, as TODO and new, or copied if they are formulas. Formulas get escaped braces on
    both sides. Where a source has changed but for white space, it is replaced and the unit marked
    needs-review unless it is new. Units that only a target has stay as they are. locales (locale) is a list of 10,000 at most.
    """
    listed = F.array(*map(F.lit, short_list(locales, "locale"))).cast("array<string>")
    wanted = source.select("unit_id", F.col("source").alias("new_source"), F.explode(listed).alias("locale"))
    x = targets.withColumn("known", F.lit(True)).join(wanted, ["locale", "unit_id"], "full_outer")
    formula, escaped = tx.is_formula_id(F.col("unit_id")), tx.escape_braces(F.col("new_source"))
    now = tx.escape_braces(F.when(F.coalesce("target", F.lit("")) != "", F.col("target")).otherwise(F.col("new_source")))
    mended = ~F.col("source").eqNullSafe(escaped) | (F.coalesce("target", F.lit("")) != now)
    changed = tx.collapse_blanks(F.coalesce("new_source", F.lit(""))) != tx.collapse_blanks(F.coalesce("source", F.lit("")))
    change = F.when(F.col("new_source").isNull(), "kept").when(F.col("known").isNull(), "added").when(formula & mended, "formula").when(~formula & changed, "source").otherwise("same")
    x = x.withColumn("change", change)
    c = F.col("change")
    return x.select(
        "locale",
        "unit_id",
        F.when((c == "added") & ~formula, F.col("new_source")).when(c.isin("added", "formula"), escaped).when(c == "source", F.col("new_source")).otherwise(F.col("source")).alias("source"),
        F.when((c == "added") & ~formula, "TODO").when(c == "added", escaped).when(c == "formula", now).otherwise(F.col("target")).alias("target"),
        F.when((c == "added") & ~formula, "new").when(c.isin("added", "formula"), "translated").when((c == "source") & (F.coalesce("state", F.lit("")) != "new"), "needs-review").otherwise(F.col("state")).alias("state"),
        "change",
    )


def status_of(target: Column, state: Column) -> Column:
    """'done', 'review' or 'todo', by the first rule that holds."""
    some, s = F.coalesce(target, F.lit("")), F.coalesce(state, F.lit(""))
    return F.when((s == "translated") & (some != "") & (some != "TODO"), "done").when(s == "needs-review", "review").when((s == "new") | (some == "TODO") | (some == ""), "todo").otherwise("done")


def progress(units: DataFrame, n_source: int) -> DataFrame:
    """Per locale total, done, review, todo, and done as a rounded percentage of the source's units."""
    s = status_of(F.col("target"), F.col("state"))
    out = units.withColumn("_s", s).groupBy("locale").agg(F.count("*").alias("total"), *[F.count_if(F.col("_s") == x).alias(x) for x in ("done", "review", "todo")])
    return out.withColumn("progress", tx.math_round(F.col("done") / F.lit(float(n_source)) * 100) if n_source else F.lit(0).cast("long"))


def problems(units: DataFrame, strict: bool = False) -> DataFrame:
    """(locale, unit_id, severity, message) for each fault of a unit."""
    target = F.when((F.coalesce("target", F.lit("")) != "") & (F.col("target") != "TODO"), F.col("target"))
    a, b = tx.placeholders(F.col("source")), tx.placeholders(target)
    missing, extra = F.array_except(a, b), F.array_except(b, a)
    formula, bare = tx.is_formula_id(F.col("unit_id")), lambda c: F.rlike(F.col(c), F.lit(r"[{}]"))
    told = lambda cond, severity, message: F.when(cond, F.struct(F.lit(severity).alias("severity"), message.alias("message")))
    faults = [
        told(tx.illegal_controls(F.col("source")), "error", F.lit("control characters in source")),
        told(tx.illegal_controls(F.col("target")), "error", F.lit("control characters in target")),
        told(F.size(missing) > 0, "error", F.concat(F.lit("missing placeholders: "), F.array_join(missing, ", "))),
        told(F.size(extra) > 0, "warning", F.concat(F.lit("extra placeholders: "), F.array_join(extra, ", "))),
        told(formula & bare("source"), "error", F.lit("braces in source formula")),
        told(formula & bare("target"), "error", F.lit("braces in target formula")),
    ]
    if strict:
        faults.append(told(F.trim(F.coalesce("target", F.lit(""))).isin("", "TODO"), "warning", F.lit("missing translation")))
    return units.select("locale", "unit_id", F.explode(F.array_compact(F.array(*faults))).alias("f")).select("locale", "unit_id", "f.*")


def to_translate(units: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units that need translation: those a cache (locale, key, translation) answers, as finished UNIT rows, and the rest (locale, unit_id, source).

    The key of a unit is its id and the FNV-1a hash of its plain source. What is to be reviewed is never taken from the cache.
    """
    some = F.coalesce("target", F.lit(""))
    need = units.filter(F.coalesce(F.col("state"), F.lit("")).isin("new", "needs-review") | some.isin("", "TODO"))
    formula = tx.is_formula_id(F.col("unit_id"))
    plain = F.when(formula, tx.unescape_braces(F.col("source"))).otherwise(F.col("source"))
    plain = F.when(tx.illegal_controls(plain), tx.visible_controls(plain)).otherwise(plain)
    need = need.withColumn("plain", plain).withColumn("key", F.concat_ws(":", "unit_id", tx.fnv1a(F.col("plain")).cast("string")))
    found = need.join(cache.select("locale", "key", "translation"), ["locale", "key"], "left")
    hit = (F.coalesce("translation", F.lit("")) != "") & (F.coalesce("state", F.lit("")) != "needs-review")
    done = found.filter(hit).select("locale", "unit_id", "source", F.when(formula, tx.escape_braces(F.col("translation"))).otherwise(F.col("translation")).alias("target"), F.lit("translated").alias("state"))
    return done, found.filter(~hit).select("locale", "unit_id", F.col("plain").alias("source"))


def updated(units: DataFrame, changes: DataFrame) -> DataFrame:
    """units with point updates (locale, unit_id, source, target, state): what is not null there replaces what was; unknown units are added, as new unless told otherwise."""
    c = changes.select("locale", "unit_id", *[F.col(x).alias(f"_{x}") for x in UNIT[2:]])
    x = units.withColumn("_known", F.lit(True)).join(c, ["locale", "unit_id"], "full_outer")
    state = F.when(F.col("_known").isNull(), F.coalesce("_state", F.lit("new"))).otherwise(F.coalesce("_state", "state"))
    return x.select("locale", "unit_id", F.coalesce("_source", "source").alias("source"), F.coalesce("_target", "target").alias("target"), state.alias("state"))


def locales(source: Column, targets: Column) -> Column:
    """The source's locale and those of an array of targets, once each, in order; nulls are left out."""
    return F.array_distinct(F.array_compact(F.concat(F.array(source), targets)))
