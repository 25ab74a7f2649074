"""Line deduplication: lines that many documents share go from all but the last of those documents."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, map_rows, parted, raw_texts, written

_STRIP = BLANK.encode()
#: Stands for a null doc_id, which counts as one document smaller than any other.
_NO_ID = -(1 << 63)


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The hash under which a line is counted; None for lines too short to count."""
    key = line.strip(_STRIP).lower()  # of bytes: A-Z alone
    if len(key) < min_chars or not key.isascii() and len(key.decode()) < min_chars:
        return None
    return blake2b(key, digest_size=16).digest()


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(d, t, key) for each line of docs (d, t, text) that is long enough, once per row of docs."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, keys = [], []
        for raw in raw_texts(batch["text"]):
            found = {k for line in raw.split(b"\n") if (k := line_key(line, min_chars))}
            n.append(len(found))
            keys += found
        row = np.repeat(np.arange(len(n)), n)
        yield pa.record_batch([batch["d"].take(pa.array(row)), batch["t"].take(pa.array(row)), pa.array(keys, pa.binary())], names=["d", "t", "key"])

    return map_rows(docs.select("d", "t", "text"), lambda: work, "d bigint, t bigint, key binary")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs (doc_id, text; more columns are ignored) without their shared lines.

    Texts are split at line feeds; null and empty texts are one empty line. A line's key is the line
    without white space (U+0020, U+0009 to U+000D) at its ends, A-Z in lower case. Keys of min_chars code
    points or more that min_docs or more distinct doc_ids hold lose all their lines, except in the largest
    of these doc_ids, which keeps every one. Rows that repeat a doc_id are one document. A null doc_id is
    one document, smaller than any other. An empty table gives no rows.

    Only texts that may lose a line are moved, to meet the keys of their lines.
    One row per row of docs: doc_id, kept_text, n_lines, n_dropped.
    """
    docs = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(_NO_ID)).alias("d"), F.xxhash64("text").alias("t"))
    lines = written(line_hashes(docs, min_chars), "lines")
    shared = lines.select("d", "key").distinct().groupBy("key").agg(F.count("*").alias("n"), F.max("d").alias("last")).filter(F.col("n") >= min_docs)
    # written, so that both sides of the join are dealt out anew and the lines of a common key can be split
    shared = written(shared.select("key", "last"), "shared")
    # by document and text, so that not even rows without an identifier meet in one task
    drop = lines.join(shared, "key").filter("d <> last").groupBy("d", "t").agg(F.collect_set("key").alias("keys"))
    drop = written(drop.withColumn("own", F.xxhash64("d", "t")), "drop")
    near, far = parted(docs.withColumn("own", F.xxhash64("d", "t")), drop, "own")
    rows = near.join(drop.select("d", "t", "keys").hint("shuffle_hash"), ["d", "t"], "left").select("doc_id", "text", "keys")
    rows = rows.unionByName(far.select("doc_id", "text", F.lit(None).cast("array<binary>").alias("keys")))
    return map_rows(rows, lambda: lambda b: _reassemble(b, min_chars), "doc_id bigint, kept_text string, n_lines bigint, n_dropped bigint")


def _reassemble(batch: pa.RecordBatch, min_chars: int) -> Iterator[pa.RecordBatch]:
    kept, n_lines, n_dropped = [], [], []
    for raw, keys in zip(raw_texts(batch["text"]), batch["keys"], strict=True):
        lines = raw.split(b"\n")
        stay = lines
        if keys.is_valid:
            gone = set(keys.as_py())
            stay = [x for x in lines if line_key(x, min_chars) not in gone]
        kept.append(b"\n".join(stay))
        n_lines.append(len(lines))
        n_dropped.append(len(lines) - len(stay))
    yield pa.record_batch([batch["doc_id"], pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=["doc_id", "kept_text", "n_lines", "n_dropped"])


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH l AS (
  SELECT doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))),
s AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.doc_id, l.pos, l.line, s.key IS NOT NULL AND l.doc_id <> s.last AS gone FROM l LEFT JOIN s ON l.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
