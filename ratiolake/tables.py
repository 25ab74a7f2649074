"""Intermediate tables: written to the folder that all executors see, and read again."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Bytes of rows up to which a written table may be broadcast. Its files don't tell: rows that are much alike take far less on disk.
BROADCAST = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A local session that names none (as in tests) gets a new one; others must name one."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_ratiolake_tables", None)
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        where = sc._ratiolake_tables = tempfile.mkdtemp(prefix="ratiolake-")
    return where


def _stored(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """df as a table in the shared folder, read again, and about how many bytes its rows take."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/ratiolake/{name}-{uuid.uuid4().hex}"
    seen = Observation()
    weight = reduce(Column.__add__, [_weight(df[f"`{f.name}`"], f.dataType) for f in df.schema], F.lit(16))
    df.observe(seen, F.sum(weight.cast("long")).alias("bytes")).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get.get("bytes") or 0


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: cuts lineage, is computed once, and survives lost executors. Rows of more than BROADCAST bytes are joined by sorting."""
    return written_any(df, name)[0]


def written_any(df: DataFrame, name: str) -> tuple[DataFrame, bool]:
    """`written`, and whether it has rows, which is known without another job."""
    back, size = _stored(df, name)
    return back.hint("merge") if size > BROADCAST else back, size > 0


def _weight(c: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes in a row."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(c), F.lit(0)) * 24 + 16
    if isinstance(kind, T.StructType):
        return reduce(Column.__add__, [_weight(c[f.name], f.dataType) for f in kind], F.lit(8))
    return F.lit(8)


def united(tables: list[DataFrame]) -> DataFrame:
    """The rows of all tables as one that is not broadcast: what `written` knows of its tables does not pass a union."""
    return reduce(DataFrame.unionByName, tables).hint("merge")


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt out evenly over tasks, for work that is large beside its rows: a small file would be one task, whatever comes of it."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def ranged(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """rows with `_range`: dealt out in ranges of the columns `by`, of about equal size, in order; written once.

    Rows that agree on all of them share a range. A window inside a range of a group, with what lies before
    it in the group, gives ranks and running sums without a whole group in a task.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _stored(rows.repartitionByRange(n, *by).withColumn("_range", F.spark_partition_id()), name)[0]


def before_each_range(rows: DataFrame, group: str, amount: str | None = None) -> DataFrame:
    """(_g, _r, _before, total) for each range of each group of ranged rows: what lies before it, and all of it; rows are counted, or an amount added up.

    There may be as many groups as rows, so neither side of a join with it is broadcast.
    """
    sums = written(rows.groupBy(group, "_range").agg((F.sum(amount) if amount else F.count("*")).alias("_t")), "sums")
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(F.col(group).alias("_g"), F.col("_range").alias("_r"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"), F.sum("_t").over(Window.partitionBy(group)).alias("total")).hint("merge")


def ranked(rows: DataFrame, by: list[str], order: list[str], column: str, name: str) -> DataFrame:
    """rows with their number in their group, from 1, as `column`: a large group is numbered range by range. Null is a group like others."""
    x = ranged(rows, [*by, *order], name)
    counts = x.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    x = x.withColumn("_here", F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order)))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by], F.col("_range") == F.col("_r"))
    return x.join(counts.hint("merge"), same).select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_before") + F.col("_here")).alias(column))


def short_list(rows: DataFrame, column: str, most: int = 10_000) -> list:
    """The distinct values of a column that is a list by its meaning, in order, null last; ValueError if there are more than `most`."""
    found = [r[0] for r in rows.select(column).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has over {most} values, and is no list")
    return sorted(found, key=lambda v: (v is None, v))
