"""Token totals that signed changes maintain.

A ledger is a folder of two tables. `changes` has, for each batch, signed rows of documents and tokens per
doc_id, source, language and tokenizer version; `totals` has their sums per source, language and version.
An insert adds, a delete takes away what the ledger has counted for the doc_id so far, a revision does both.
Everything adds up, so totals need no order and no old batch is ever rewritten. A batch is written under its
own name and counts once its mark is there: to commit it again changes nothing, and what a lost driver left
half written is overwritten by the next try. The mark has a digest of the batch, so that other changes under
the same name are told. Changes lie in BUCKETS folders by doc_id: a delete reads those of its own only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import STRETCH, chunks, codec, cuts, tokenizer_file
from .common import map_rows, raw_texts, scratch

CHANGES = "doc_id bigint, source string, lang string, version string, docs bigint, tokens bigint"
TOTALS = "source string, lang string, version string, docs bigint, tokens bigint"
#: Folders by doc_id in each batch of changes.
BUCKETS = 16
#: The version that counts words `[^\x20\x09-\x0D]+`; other versions count by a tokenizer's JSON file.
WORDS = "words-1"


def counted(rows: DataFrame, tokenizers: dict[str, str]) -> DataFrame:
    """rows (doc_id, source, lang, text) as (doc_id, source, lang, version, tokens), one for each version. Null texts have none."""
    spark = rows.sparkSession
    sources = {}
    for version, path in tokenizers.items():
        if version != WORDS:
            with open(path, encoding="utf-8") as f:
                sources[version] = spark.sparkContext.broadcast(f.read())

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for version in tokenizers:
            if version == WORDS:
                n = [len(raw.split()) for raw in raw_texts(batch["text"])]  # of bytes: exactly that white space
            else:
                c = codec(sources[version].value)
                width = 2 if c.kind == "<u2" else 4
                n = [len(c.encode_all(chunks(raw, c.agreed(raw, cuts([raw])[0])) if len(raw) > STRETCH else [raw])) // width for raw in raw_texts(batch["text"])]
            yield pa.record_batch([batch["doc_id"], batch["source"], batch["lang"], pa.array([version] * len(n)), pa.array(n, pa.int64())], names=["doc_id", "source", "lang", "version", "tokens"])

    return map_rows(rows.select("doc_id", "source", "lang", "text"), lambda: work, "doc_id bigint, source string, lang string, version string, tokens bigint")


def _bucket(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(BUCKETS)).cast("int").alias("bucket")


class Ledger:
    """Token totals in a folder that all executors see."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        p, fs = self._file(path)
        return fs.exists(p)

    def _marks(self) -> DataFrame | None:
        if not self._exists(f"{self.path}/commits"):
            return None
        return self.spark.read.schema("name string, digest string, batch string").parquet(f"{self.path}/commits")

    def _committed(self, table: str, schema: str) -> DataFrame:
        marks = self._marks()
        if marks is None:
            return self.spark.createDataFrame([], schema)
        more = ", bucket int" if table == "changes" else ""
        return self.spark.read.schema(f"{schema}, batch string{more}").parquet(f"{self.path}/{table}").join(F.broadcast(marks.select("batch").distinct()), "batch", "left_semi").drop("batch")

    def commit(self, batch: str, changes: DataFrame, tokenizers: dict[str, str]) -> bool:
        """Apply changes (doc_id, source, lang, text, op) under a batch name; False if they were there already.

        op is 'insert', 'delete' or 'revise', and null counts as 'insert'; anything else is refused with a
        ValueError, as is a name that isn't of letters, digits, `.`, `_` and `-`, and a name that was
        committed with other changes or tokenizers. Deletes and revisions take away all that earlier batches
        counted for the doc_id, whatever its source, language or version then; if a doc_id has several such
        rows in a batch, that happens once. Inserts and revisions add one document for each row. Null
        source, lang and doc_id are values of their own. More columns are ignored. An empty batch commits
        and changes nothing. One commit runs at a time: a second one meets the ledger's lock and is refused
        with a RuntimeError; the lock of a driver that was lost is the file `lock`, to be deleted by hand.
        """
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", batch):
            raise ValueError(f"not a name of a batch: {batch!r}")
        rows = changes.select("doc_id", "source", "lang", "text", F.coalesce("op", F.lit("insert")).alias("op"))
        own = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in rows.columns]).cast("decimal(38,0)")
        told = rows.agg(F.count("*").alias("n"), F.sum(own).alias("sum"), F.collect_set(F.when(~F.col("op").isin("insert", "delete", "revise"), F.left("op", F.lit(20)))).alias("odd")).first()
        if told.odd:
            raise ValueError(f"unknown operations: {sorted(told.odd)[:5]}")
        digest = f"{told.n}:{told.sum}:{','.join(sorted(tokenizers))}"
        lock, fs = self._file(f"{self.path}/lock")
        if not fs.createNewFile(lock):
            raise RuntimeError(f"another commit is under way, or was lost and left {self.path}/lock")
        try:
            marks = self._marks()
            known = marks.filter(F.col("batch") == batch).first() if marks is not None else None
            if known is None:
                self._apply(batch, rows, tokenizers)
                self.spark.createDataFrame([(batch, digest)], "name string, digest string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/batch={batch}")
            elif known.digest != digest:
                raise ValueError(f"batch {batch!r} was committed with other changes")
            return known is None
        finally:
            fs.delete(lock, False)

    def _apply(self, batch: str, rows: DataFrame, tokenizers: dict[str, str]) -> None:
        plus = counted(rows.filter("op <> 'delete'"), tokenizers).withColumn("docs", F.lit(1).cast("long"))
        undone = rows.filter("op in ('delete', 'revise')").select(F.col("doc_id").alias("_id")).distinct()
        buckets = [r.bucket for r in undone.select(_bucket(F.col("_id"))).distinct().collect()]
        before = self._committed("changes", CHANGES)
        if buckets and "bucket" in before.columns:
            before = before.filter(F.col("bucket").isin(buckets))
        minus = before.join(undone, before["doc_id"].eqNullSafe(undone["_id"]), "left_semi")
        minus = minus.groupBy("doc_id", "source", "lang", "version").agg((-F.sum("docs")).alias("docs"), (-F.sum("tokens")).alias("tokens")).filter("docs <> 0 or tokens <> 0")
        names = [f.split()[0] for f in CHANGES.split(", ")]
        signed = plus.select(*names).unionByName(minus.select(*names)).withColumn("bucket", _bucket(F.col("doc_id")))
        signed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/changes/batch={batch}")
        told = self.spark.read.schema(CHANGES).parquet(f"{self.path}/changes/batch={batch}")
        told.groupBy("source", "lang", "version").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.mode("overwrite").parquet(f"{self.path}/totals/batch={batch}")

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens over all committed batches; what has come to nothing is left out."""
        sums = self._committed("totals", TOTALS).groupBy("source", "lang", "version").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.filter("docs <> 0 or tokens <> 0")


def rolled(spark: SparkSession, sf_dir: str, tokenizers: dict[str, str]) -> DataFrame:
    """Totals of all documents through a ledger: registered without text or language, revised as their texts arrive, some withdrawn and restored, one batch repeated. Null texts count as empty, null sources, languages and doc_ids as values of their own; an empty table gives no rows."""
    ledger = Ledger(spark, scratch(spark, "ledger"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    none = F.lit(None).cast("string")
    arrived = docs.withColumn("op", F.lit("revise"))
    french = docs.filter("lang = 'fr'")
    ledger.commit("registered", docs.withColumns({"lang": none, "text": none, "op": F.lit("insert")}), tokenizers)
    ledger.commit("arrived", arrived, tokenizers)
    ledger.commit("withdrawn", french.withColumns({"text": none, "op": F.lit("delete")}), tokenizers)
    ledger.commit("restored", french.withColumn("op", F.lit("insert")), tokenizers)
    ledger.commit("arrived", arrived, tokenizers)
    return ledger.totals()


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, words and tokens by source, language and tokenizer version."""
    return rolled(spark, sf_dir, {WORDS: "", "word_bpe_49k-1": tokenizer_file()})


def op4_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op4_token_counts, words alone, so that SQL can tell the same."""
    return rolled(spark, sf_dir, {WORDS: ""})


OP4_WORDS_SQL = rf"""
SELECT source, lang, '{WORDS}' AS version, count(*) AS docs,
  sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS tokens
FROM documents GROUP BY 1, 2
"""
