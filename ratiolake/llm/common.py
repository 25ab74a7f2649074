"""What the corpus operators share: a working folder all executors see, Arrow batches, text rules."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the word rule, and with line feed of the line rule: space and U+0009 to U+000D.
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A local session that names none (as in tests) gets a new one; others must name one."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir")
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        where = getattr(sc, "_ratiolake_dir", None)
        if where is None:
            where = sc._ratiolake_dir = tempfile.mkdtemp(prefix="ratiolake-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/ratiolake/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete every table that `written` and `scratch` made; results that still read them become invalid."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/ratiolake")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def arrow_batches(spark: SparkSession, rows: int = 2000, size: str = "8m") -> None:
    """Bound what a Python worker holds at once, for texts of any length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow with state per task: make() runs once in each task and gives the function of a batch."""
    arrow_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)

    return df.mapInArrow(run, schema)


def raw_texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of a string column, null as empty, one row at a time."""
    for x in column.cast(pa.binary() if column.type == pa.string() else pa.large_binary()):
        yield x.as_py() or b""


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts of ASCII alone take the JVM's fast path."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


#: Bits of the largest filter that maybe_among broadcasts: 256 MB.
MAX_BITS = 1 << 31


def placed(docs: DataFrame) -> DataFrame:
    """(row, file, at): each row of docs as one struct, so that its names meet no others, and where it stands.

    What isn't read from files and at most filtered and projected since, or has a column that hides the files'
    metadata, is written first.
    """
    spark = docs.sparkSession
    plan = docs._jdf.queryExecution().analyzed().toString().splitlines()
    if "_metadata" not in (c.lower() for c in docs.columns) and all(re.match(r"[ :+-]*(Project|Filter|SubqueryAlias|Relation)\b", x) for x in plan):
        try:
            return docs.select(F.struct("*").alias("row"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
        except AnalysisException:
            pass
    path = scratch(spark, "arrived")
    packed = docs.select(F.struct("*").alias("row"))
    packed.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(packed.schema).parquet(path).select("row", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))


def without(docs: DataFrame, gone: DataFrame, on: dict[str, Column]) -> DataFrame:
    """docs less the rows for which the expressions `on` (null equals null) are among gone's columns of these names.

    All columns of docs stay, whatever their names: a row travels as one struct. Only rows that a bitmap of
    gone's keys can't clear are moved and joined.
    """
    packed = docs.select(F.struct("*").alias("row"), F.struct(*[c.alias(n) for n, c in on.items()]).alias("own"))
    return left_over(packed, gone, list(on)).select("row.*")


def left_over(packed: DataFrame, gone: DataFrame, names: list[str]) -> DataFrame:
    """(row) of packed (row, own): rows whose struct `own` of the given names is not among gone's rows."""
    gone = written(gone.select(*names).distinct().select(F.xxhash64(*names).alias("gone_key"), F.struct(*names).alias("gone")), "gone")
    bitmap, bits = _bitmap(gone, "gone_key")
    keyed = packed.select("row", "own", F.xxhash64(*[F.col("own")[n] for n in names]).alias("key")).withColumn("_at", _place("key", bits))
    keyed = keyed.withColumn("_bucket", F.bitmap_bucket_number("_at")).join(F.broadcast(bitmap), "_bucket", "left").withColumn("near", F.coalesce(_bit_set(), F.lit(False)))
    same = F.col("key") == F.col("gone_key")
    for n in names:
        same = same & F.col("own")[n].eqNullSafe(F.col("gone")[n])
    return keyed.filter("not near").select("row").unionByName(keyed.filter("near").select("row", "own", "key").join(gone, same, "left_anti").select("row"))


def _place(key: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits)) + 1


def _bitmap(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    bits = max(1 << 15, min(MAX_BITS, 1 << (16 * keys.count()).bit_length()))
    at = keys.select(_place(key, bits).alias("at"))
    return at.groupBy(F.bitmap_bucket_number("at").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("_bits")), bits


def _bit_set() -> Column:
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(bitmap_bit_position(_at) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return byte.bitwiseAND(F.expr("shiftleft(1, cast(bitmap_bit_position(_at) % 8 as int))")) != 0


def maybe_among(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows whose value of the column `key` may be among those of keys: all that are, and a few others."""
    return parted(rows, keys, key)[0]


def parted(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """rows whose value of the column `key` may be among those of keys, and the others, which are not.

    A bitmap of hashed values, 16 bits for each of keys but never over MAX_BITS, goes to the rows, so
    that most of the others stay out of the join that follows and their texts are not moved.
    """
    bitmap, bits = _bitmap(keys, key)
    at = rows.withColumn("_at", _place(key, bits)).withColumn("_bucket", F.bitmap_bucket_number("_at"))
    near = at.join(F.broadcast(bitmap), "_bucket").filter(_bit_set())
    far = at.join(F.broadcast(bitmap), "_bucket", "left").filter(~F.coalesce(_bit_set(), F.lit(False)))
    return near.select(*rows.columns), far.select(*rows.columns)
