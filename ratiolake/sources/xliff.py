"""XLIFF files as tables of translation units, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_units(spark: SparkSession, path: str) -> DataFrame:
    """(path, unit_id, source, target, state) of all files at a path; of units that repeat an id in a file, the last. No target is null, no state ''."""
    return parse_units(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")))


def parse_units(files: DataFrame) -> DataFrame:
    """As read_units, of a table (path, content)."""
    blocks = F.regexp_extract_all("content", F.lit(r'(?s)<unit\b[^>]*\bid="[^"]*"[^>]*>.*?</unit>'), F.lit(0))
    u = files.select("path", F.posexplode(blocks).alias("at", "unit"))
    got = lambda pattern, group: F.regexp_extract("unit", pattern, group)
    target = r"(?s)<target\b([^>]*)>(.*?)</target>"
    u = u.select(
        "path",
        "at",
        got(r'<unit\b[^>]*\bid="([^"]*)"', 1).alias("unit_id"),
        got(r"(?s)<source\b[^>]*>(.*?)</source>", 1).alias("source"),
        F.when(F.rlike("unit", F.lit(target)), got(target, 2)).alias("target"),
        F.regexp_extract(got(target, 1), r'\bstate="([^"]*)"', 1).alias("state"),
    )
    last = u.groupBy("path", "unit_id").agg(F.max_by(F.struct("source", "target", "state"), "at").alias("u"))
    return last.select("path", "unit_id", "u.*")


def xliff_lines(units: DataFrame) -> DataFrame:
    """(locale, part, unit_id, line): the lines of a document per locale of (locale, unit_id, source, target, state); part is 0 for the head, 1 for units, 2 for the end."""
    unit = F.concat(
        F.lit('  <unit id="'), F.col("unit_id"), F.lit('"><segment><source>'), F.coalesce("source", F.lit("")), F.lit("</source><target"),
        F.when(F.coalesce("state", F.lit("")) != "", F.concat(F.lit(' state="'), F.col("state"), F.lit('"'))).otherwise(""),
        F.lit(">"), F.coalesce("target", F.lit("")), F.lit("</target></segment></unit>"),
    )
    head = F.concat(F.lit('<xliff version="2.0" trgLang="'), F.col("locale"), F.lit('">'))
    around = units.select("locale").distinct().select("locale", F.explode(F.array(F.struct(F.lit(0).alias("part"), head.alias("line")), F.struct(F.lit(2).alias("part"), F.lit("</xliff>").alias("line")))).alias("x"))
    around = around.select("locale", "x.part", F.lit("").alias("unit_id"), "x.line")
    return units.select("locale", F.lit(1).alias("part"), "unit_id", unit.alias("line")).unionByName(around)


def write_xliff(units: DataFrame, path: str) -> None:
    """A folder locale=... of text files for each locale, its lines in order over the files by their names; no task has a whole locale to hold."""
    lines = xliff_lines(units).repartitionByRange("locale", "part", "unit_id").sortWithinPartitions("locale", "part", "unit_id")
    lines.select("locale", "line").write.partitionBy("locale").text(path)
