"""A catalogue of items by category and group: flattening, lookups, sections, search, availability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratiolake.tables import ranked

from .relational import haystack

#: The section of items whose own is not declared, and where it and sections without an order stand.
OTHER, LAST, UNDECLARED = "__other", 999, 9999


def flattened(nested: DataFrame, tree: str) -> DataFrame:
    """(category, group, item, title, route) of maps in maps: category -> struct(groups: group -> struct(items: item -> title))."""
    c = nested.select(F.explode(tree).alias("category", "c"))
    g = c.select("category", F.explode("c.groups").alias("group", "g"))
    return g.select("category", "group", F.explode("g.items").alias("item", "title")).withColumn("route", F.concat_ws("/", F.lit(""), "category", "group", "item"))


def by_title(items: DataFrame, title: str, locale: str = "fr") -> DataFrame:
    """items in the order that readers of a language expect of titles."""
    return items.orderBy(F.collate(F.col(title), locale))


def sections(items: DataFrame, declared: DataFrame) -> DataFrame:
    """items (section, at, available and more) with section_order and `rank`, their place in the section: what is available first, else by at.

    declared: (section, section_order). Items of other sections, or of none, come in OTHER, which is last. Ranks are counted over ranges, so no section meets in one task.
    """
    d = declared.select(F.col("section").alias("_s"), F.coalesce("section_order", F.lit(LAST)).alias("_o"))
    x = items.join(d, F.col("section") == F.col("_s"), "left")
    x = x.select(*[F.coalesce("_s", F.lit(OTHER)).alias(c) if c == "section" else c for c in items.columns], F.coalesce("_o", F.lit(UNDECLARED)).alias("section_order"))
    # what is available first; where it isn't known, last
    late = F.coalesce(1 - F.col("available").cast("int"), F.lit(2))
    return ranked(x.withColumn("_late", late), ["section"], ["_late", "at"], "rank", "sections").drop("_late")


def with_editorial(items: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """Available items with the text that has all their keys, null where there is none; texts are unique by keys."""
    return items.filter("available").join(texts, keys, "left")


def lesson_search(needle: str, title: Column, subtitle: Column, tags: Column, parts: Column) -> Column:
    """Whether title, subtitle, tags or the titles of parts hold the needle."""
    return haystack(needle, title, subtitle, F.array_join(tags, " "), F.array_join(parts, " "))


def availability(items: DataFrame, by: str) -> DataFrame:
    """Per group how many items are available, and how many are to come."""
    return items.groupBy(by).agg(F.count_if("available").alias("available"), F.count_if(~F.coalesce(F.col("available"), F.lit(False))).alias("to_come"))


def projected(rows: DataFrame, always: list[str], optional: dict[str, bool]) -> DataFrame:
    """rows with the columns that are always there and those of the optional ones that are asked for."""
    return rows.select(*always, *[c for c, wanted in optional.items() if wanted])


def ordered_distinct(values: Column) -> Column:
    """An array without repeats, in order of first occurrence."""
    return F.array_distinct(values)
