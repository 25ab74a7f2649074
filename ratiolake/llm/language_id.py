"""Language identification by fusing evidence as Bayes' rule has it.

The likelihood of a text comes from hashed byte trigrams, fitted here on a bounded sample of rows that
carry a label. To it come what a page declares in its markup, the suffix of its address, and a prior of its
host. How far declarations and suffixes are to be trusted, and what a host usually has, is counted over all
rows by the language that the text alone suggests; counts of a host are smoothed towards its domain, those
of the domain towards the whole. Each row's own count is taken out of its host's before it is used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, raw_texts, without, written

BUCKETS = 1 << 15
#: Expected labelled texts for each language that the fit uses; languages with fewer than LEAST are left out.
SAMPLE, LEAST = 2000, 3
#: A text counts as at most so many independent trigrams.
WEIGHT = 50.0
#: Rows of its parent that a host or domain is smoothed with.
SMOOTH = 10.0
#: The least posterior of a language that is accepted, and how far a text's mean log-probability may lie from that
#: of the language's own sample (0) towards that of trigrams never seen in it (1).
ACCEPT, STRANGE = 0.5, 0.75
#: The languages that may be fitted, by their codes of two letters in ISO 639-1.
LANGUAGES = tuple(
    "aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy "
    "ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv "
    "mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw "
    "ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu".split()
)
_SPREAD = np.uint32(2654435761)


def trigrams(raw: bytes) -> np.ndarray:
    """Buckets of a text's byte trigrams: A-Z in lower case, white space as single spaces, one at each end."""
    a = np.frombuffer(b" " + b" ".join(raw.lower().split()) + b" ", np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.zeros(0, np.int64)
    return ((((a[:-2] << 16) | (a[1:-1] << 8) | a[2:]) * _SPREAD) >> np.uint32(17)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    #: Log-probability of each bucket in each language: BUCKETS x languages.
    logp: np.ndarray
    #: Mean log-probability of a language's own sample, and of trigrams never seen in it.
    usual: list[float] = field(default_factory=list)
    unseen: list[float] = field(default_factory=list)

    def score(self, raw: bytes) -> tuple[int, np.ndarray]:
        """Trigrams of a text, and their mean log-probability in each language."""
        t = trigrams(raw)
        return len(t), self.logp[t].mean(axis=0) if len(t) and self.languages else np.zeros(len(self.languages))


def fit(labelled: DataFrame, sample: int = SAMPLE, least: int = LEAST, known: tuple[str, ...] = LANGUAGES) -> Model:
    """A Model from labelled rows (text, label); null labels and texts without trigrams are left out.

    Only labels of the stated list `known` are fitted, and of these only such as `least` distinct texts or
    more carry. Of each label about `sample` distinct texts are used, chosen by a hash of the text, so copies
    weigh as one; the driver receives at most BUCKETS counts for each label.
    """
    rows = labelled.select("text", "label").filter(F.col("label").isin(*known) & F.col("text").isNotNull()).withColumn("hash", F.xxhash64("text"))
    counts = {r.label: r.n for r in rows.groupBy("label", "hash").agg(F.lit(1).alias("one")).groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") >= least).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32))
    share = F.coalesce(*[F.when(F.col("label") == x, F.lit(min(1.0, sample / counts[x]))) for x in languages])
    chosen = rows.filter((F.pmod(F.xxhash64("hash"), F.lit(1 << 30)) / float(1 << 30)) < share).groupBy("label", "hash").agg(F.first("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            for raw, label in zip(raw_texts(batch["text"]), batch["label"].to_pylist(), strict=True):
                np.add.at(total[languages.index(label)], trigrams(raw), 1)
        k, bucket = np.nonzero(total)
        yield pa.record_batch([pa.array(k.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[k, bucket])], names=["k", "bucket", "n"])

    found = chosen.mapInArrow(count, "k int, bucket int, n bigint").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((BUCKETS, len(languages)))
    n[found["bucket"].to_numpy(), found["k"].to_numpy()] = found["n"].to_numpy()
    total = n.sum(axis=0)
    logp = np.log((n + 0.5) / (total + 0.5 * BUCKETS))
    return Model(languages, logp.astype(np.float32), ((n * logp).sum(axis=0) / np.maximum(total, 1)).tolist(), np.log(0.5 / (total + 0.5 * BUCKETS)).tolist())


def identify(rows: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """The language of each of rows (text, declared, suffix, host, domain), all but text nullable evidence.

    keys are further columns to carry. One row per row: keys, language, posterior, text_language,
    n_trigrams, accepted. A row is accepted if its best language has a posterior of ACCEPT or more and its
    text does not look STRANGE for it. Null and empty texts, and all rows if
    the model has no languages, have no language and are not accepted. Ties go to the language first in
    the alphabet. Null or unknown evidence weighs nothing; rows without host share the domain's prior, and
    without domain that of all rows.
    """
    spark = rows.sparkSession
    told = spark.sparkContext.broadcast(model)
    L = len(model.languages)

    def scored(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        got = [told.value.score(raw) for raw in raw_texts(batch["text"])]
        rest = [batch[c] for c in batch.schema.names if c != "text"]
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.record_batch([*rest, pa.array([n for n, _ in got], pa.int64()), pa.array([s.astype(np.float64) for _, s in got], pa.list_(pa.float64()))], names=[*names, "n", "mean"])

    kept = rows.select(F.struct(*keys).alias("keys"), "declared", "suffix", "host", "domain", "text")
    schema = T.StructType([*(f for f in kept.schema if f.name != "text"), T.StructField("n", T.LongType()), T.StructField("mean", T.ArrayType(T.DoubleType()))])
    carried = [F.col("keys")[k].alias(k) for k in keys]
    base = written(map_rows(kept, lambda: scored, schema).withColumn("best", F.when((F.col("n") > 0) & (F.size("mean") > 0), F.array_position("mean", F.array_max("mean")).cast("int"))), "scores")
    if not L:
        nothing = F.lit(None).cast("string")
        return base.select(*carried, nothing.alias("language"), F.lit(None).cast("double").alias("posterior"), nothing.alias("text_language"), F.col("n").alias("n_trigrams"), F.lit(False).alias("accepted"))

    def tally(*by: str) -> DataFrame:
        """Rows by the best language of their text, an array of counts for each value of `by`."""
        each = F.array(*[F.count_if(F.col("best") == i + 1).cast("double") for i in range(L)])
        return base.filter("best is not null").groupBy(*by).agg(each.alias("n_of"))

    def shares(counts: Column, prior: Column, strength: Column | float) -> Column:
        total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(counts, prior, lambda c, p: (c + strength * p) / (total + strength))

    whole = tally().first()["n_of"] if L else []
    whole = [float(x or 0) for x in whole]
    base_prior = [(x + 1) / (sum(whole) + L) for x in whole]
    everywhere = F.array(*map(F.lit, base_prior))
    zeros = F.array_repeat(F.lit(0.0), L)
    own = F.transform(F.sequence(F.lit(1), F.lit(L)), lambda i: F.when(i == F.col("best"), 1.0).otherwise(0.0))
    less = lambda counts: F.zip_with(F.coalesce(counts, zeros), own, lambda c, o: F.greatest(c - o, F.lit(0.0)))

    x = base
    for by in (["domain"], ["host", "domain"], ["declared"], ["suffix"]):
        # a row without the value has nothing to be joined with: its key is one of many that no tally has
        here = F.when(F.col(by[0]).isNotNull(), F.to_json(F.struct(*[F.col(c) for c in by])))
        t = tally(*by).filter(F.col(by[0]).isNotNull()).select(here.alias("key"), F.col("n_of").alias(f"by_{by[0]}"))
        x = x.withColumn("key", F.coalesce(here, F.pmod(F.xxhash64("mean", "n"), F.lit(4096)).cast("string"))).join(t, "key", "left").drop("key")
    domain = shares(less(F.col("by_domain")), everywhere, SMOOTH)
    host = shares(less(F.col("by_host")), domain, SMOOTH)
    # P(evidence | language) but for a factor that is the same in all languages: the value's share of each language's rows
    per = F.array(*map(F.lit, [n + SMOOTH for n in whole]))

    def trust(name: str) -> Column:
        counts = less(F.col(f"by_{name}"))
        total = F.aggregate(counts, F.lit(0.0), lambda a, v: a + v)
        lift = F.zip_with(counts, per, lambda c, n: (c + F.lit(SMOOTH) * total / F.lit(max(1.0, sum(whole)))) / n)
        return F.when(F.col(f"by_{name}").isNotNull() & (total > 0), F.transform(lift, lambda v: F.log(v + F.lit(1e-6)))).otherwise(zeros)

    x = x.withColumn("_host", F.transform(host, lambda p: F.log(p))).withColumn("_declared", trust("declared")).withColumn("_suffix", trust("suffix"))
    weight = F.least(F.col("n").cast("double"), F.lit(WEIGHT))
    total = F.zip_with(F.zip_with(F.transform("mean", lambda m: m * weight), "_host", lambda a, b: a + b), F.zip_with("_declared", "_suffix", lambda a, b: a + b), lambda a, b: a + b)
    x = x.withColumn("total", total).withColumn("top", F.array_max("total"))
    x = x.withColumn("at", F.array_position("total", F.col("top")).cast("int")).withColumn("posterior", 1 / F.aggregate("total", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("top"))))
    names = F.array(*map(F.lit, model.languages))
    sure = F.col("best").isNotNull()
    usual, unseen = (F.element_at(F.array(*map(F.lit, v)), F.col("at")) for v in (model.usual, model.unseen))
    fits = usual - F.element_at("mean", F.col("at")) < STRANGE * (usual - unseen)
    return x.select(
        *carried,
        F.when(sure, F.element_at(names, F.col("at"))).alias("language"),
        F.when(sure, F.col("posterior")).alias("posterior"),
        F.when(sure, F.element_at(names, F.coalesce("best", F.lit(1)))).alias("text_language"),
        F.col("n").alias("n_trigrams"),
        F.coalesce(sure & (F.col("posterior") >= ACCEPT) & fits, F.lit(False)).alias("accepted"),
    )


def documents_as_rows(docs: DataFrame, *more: Column) -> DataFrame:
    """documents (text, lang, source) as identify takes them: lang is what was declared, source the host."""
    none = F.lit(None).cast("string")
    return docs.select(*more, "text", F.col("lang").alias("declared"), none.alias("suffix"), F.col("source").alias("host"), none.alias("domain"))


def pages_as_rows(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html): the declared lang attribute, the address's language folder or else top-level suffix, host and domain."""
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]+)", 1))
    folder = F.regexp_extract("url", r"^[a-zA-Z]+://[^/]+/([a-z]{2})(?=[/?#]|$)", 1)
    head = F.lower(F.regexp_extract("html", r"(?is)<html[^>]*\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1))
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>|&[a-zA-Z#0-9]+;", " ")
    some = lambda c: F.when(c != "", c)
    suffix = F.coalesce(some(folder), some(F.regexp_extract(host, r"\.([a-z]+)$", 1)))
    return pages.select("page_id", text.alias("text"), some(head).alias("declared"), suffix.alias("suffix"), some(host).alias("host"), some(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).alias("domain"))


def accepted_rows(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, source and more), all columns, less the rows whose language identify does not accept.

    Rows with null or empty texts go; rows that repeat a doc_id are judged each by itself, and equal rows alike.
    """
    own = F.xxhash64("text", "lang", "source")
    told = identify(documents_as_rows(docs, F.col("doc_id"), own.alias("hash")), fit(docs.select("text", F.col("lang").alias("label"))), ["doc_id", "hash"])
    return without(docs, told.filter("not accepted").select("doc_id", "hash"), {"doc_id": F.col("doc_id"), "hash": own})


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(documents_as_rows(docs, F.col("doc_id")), fit(docs.select("text", F.col("lang").alias("label"))), ["doc_id"])
    return out.withColumn("kept", F.col("accepted"))


def op10_language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = written(pages_as_rows(spark.read.parquet(f"{sf_dir}/pages.parquet")), "pages")
    return identify(pages, fit(pages.select("text", F.col("declared").alias("label"))), ["page_id"])
