"""Exact deduplication as a stateful stream.

Arrivals (digest, stable identifier, content locator) stream through a keyed aggregation whose state
lives in RocksDB and never expires: for each digest it holds the row that stays, its locator and the
number of rows. Rows whose digest was seen before (hits) are then held against the stored row's full
text; should two texts share a digest, they are told apart by their bytes. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, left_over, maybe_among, placed, scratch, written

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How the state is kept: on disk, with a bound on memory over all of an executor's partitions.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": PROVIDER,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no room set aside on disk
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def sha_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def keyed_state(spark: SparkSession, arrivals: str, state: str, partitions: int | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Stream the files under arrivals that the state in folder `state` has not seen yet through the keyed state; return it.

    Running it again after more files came adds those alone: the folder holds offsets and state.
    Columns: digest; first struct(doc_id, file, row) of the row that stays; n, the rows so far.
    """
    before = {k: spark.conf.get(k, None) for k in [*STATE, "spark.sql.shuffle.partitions"]}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    if partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        reader = spark.readStream.schema("digest binary, doc_id bigint, file string, row bigint")
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        seen = reader.parquet(arrivals).groupBy("digest").agg(F.max("doc_id").alias("doc_id"), F.max_by(F.struct("file", "row"), F.struct("doc_id", "file", "row")).alias("place"), F.count("*").alias("n"))
        query = seen.writeStream.format("noop").outputMode("update").trigger(availableNow=True).option("checkpointLocation", state).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.format("statestore").load(state)


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha_digest) -> DataFrame:
    """One row per row of docs (doc_id, text; more columns are ignored) with the group of equal texts it is in.

    Texts are equal when identical after lower-casing A-Z; null is the empty text, and empty texts are
    equal. The row with the largest doc_id stays; if rows repeat that doc_id, the one that comes last in
    its file does, so one row of a group stays always. A null doc_id is smaller than any other. An empty
    table gives no rows. digest: of the normalised text; a weak one costs time, not correctness.

    Columns: doc_id, keep_id, group_size, kept, text_sha256.
    """
    return _groups(placed(docs.select("doc_id", "text")), digest).drop("file", "at")


def _groups(rows: DataFrame, digest: Callable[[Column], Column] = sha_digest) -> DataFrame:
    """The columns of exact_groups and the place (file, at) for rows (row, file, at) whose struct has doc_id and text."""
    spark = rows.sparkSession
    rows = rows.select(F.coalesce("row.doc_id", F.lit(_NO_ID)).alias("doc_id"), ascii_lower(F.coalesce("row.text", F.lit(""))).alias("norm"), "file", "at")
    arrivals = scratch(spark, "arrivals")
    rows.select(digest(F.col("norm")).alias("digest"), "doc_id", "file", F.col("at").alias("row"), F.unhex(F.sha2("norm", 256)).alias("sha")).write.parquet(arrivals)
    state = keyed_state(spark, arrivals, scratch(spark, "state"))
    state = state.select("key.digest", "value.*").toDF("digest", "keep_id", "place", "place_order", "group_size").select("digest", "keep_id", "place", "group_size")
    state = written(state, "groups")

    arrived = spark.read.parquet(arrivals).select("digest", "doc_id", "file", F.col("row").alias("at"), F.lower(F.hex("sha")).alias("text_sha256"))
    kept = (F.col("file") == F.col("place.file")) & (F.col("at") == F.col("place.row"))
    groups = arrived.join(state, "digest").withColumn("kept", kept)
    # full bytes on hits, found by their places; groups of one have nothing to be compared with
    several = state.filter("group_size > 1").select("digest", "place")
    hits = written(maybe_among(arrived.drop("text_sha256"), several, "digest").join(several, "digest").select("file", "at", "digest", kept.alias("kept"), _spot().alias("spot")), "hits")
    texts = written(maybe_among(rows.withColumn("spot", _spot()), hits, "spot").drop("spot").join(hits.drop("spot"), ["file", "at"]), "hit-texts")
    stored = texts.filter("kept").select("digest", F.col("norm").alias("stored"))
    differ = written(texts.filter("not kept").join(stored, "digest").filter("norm <> stored").select("digest"), "collisions").distinct()
    if not differ.isEmpty():
        apart = texts.drop("kept").join(differ, "digest")
        by_text = apart.groupBy("norm").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "file", F.col("at").alias("row"))).alias("place"))
        apart = apart.join(by_text, "norm").withColumns({"keep_id": F.col("place.doc_id"), "kept": kept, "text_sha256": F.sha2("norm", 256)})
        whole = groups.join(differ, "digest", "left_anti")
        groups = whole.select(*_OUT).unionByName(apart.select(*_OUT))
    return groups.select(_null_back("doc_id"), _null_back("keep_id"), *_OUT[2:])


def _spot() -> Column:
    return F.xxhash64("file", "at")


#: Stands for a null doc_id, which is smaller than any other.
_NO_ID = -(1 << 63)
_OUT = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "file", "at"]


def _null_back(name: str) -> Column:
    return F.when(F.col(name) != _NO_ID, F.col(name)).alias(name)


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs, all columns, without the rows that exact_groups does not keep."""
    rows = placed(docs)
    gone = _groups(rows).filter("not kept").select("file", "at")
    return left_over(rows.select("row", F.struct("file", "at").alias("own")), gone, ["file", "at"]).select("row.*")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
