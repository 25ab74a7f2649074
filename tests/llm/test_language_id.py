import math

import numpy as np
from pyspark.sql import functions as F

from ratiolake.llm import language_id as li

from .cases import DOCS, ODD, with_clashes


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    model = li.fit(docs.filter(half).select("text", F.col("lang").alias("label")))
    assert model.languages == ["de", "en", "es", "fr"]
    none = F.lit(None).cast("string")
    rest = docs.filter(~half).select("doc_id", "lang", "text", none.alias("declared"), none.alias("suffix"), none.alias("host"), none.alias("domain"))
    got = li.identify(rest, model, ["doc_id", "lang"]).collect()
    assert len(got) > 400
    assert sum(r.text_language == r.lang for r in got) / len(got) > 0.98
    assert sum(r.accepted for r in got) / len(got) > 0.99


def test_evidence_moves_what_the_text_leaves_open(spark):
    words = {"aa": "alpha beta gamma delta", "bb": "uno dos tres cuatro"}
    rows = [(i, words[x] + f" {i}", x, x, f"h{x}", "d") for i in range(60) for x in words]
    rows += [(1000, "zzz", "bb", "bb", None, None), (1001, "zzz", "aa", None, None, None), (1002, "zzz", None, "bb", None, None), (1003, "zzz", None, None, "hbb", "d"), (1004, words["aa"] * 30, "bb", "bb", "hbb", "d"), (1005, "zzz", "qq", "qq", "new", "new")]
    rows += [(1010, None, "aa", "aa", "haa", "d"), (1011, "", None, None, None, None), (1012, "alpha", None, None, None, None), (1012, "alpha", None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, declared string, suffix string, host string, domain string")
    model = li.fit(df.filter("doc_id < 1000").select("text", F.col("declared").alias("label")), known=("aa", "bb"))
    got = {r.doc_id: r for r in li.identify(with_clashes(df.drop("host", "domain").withColumns({"host": F.lit(None), "domain": F.lit(None)})).drop("host", "domain").join(df.select(F.col("doc_id").alias("j"), "host", "domain").distinct(), F.col("doc_id") == F.col("j")), model, ["doc_id"]).collect()}
    assert [got[d].language for d in (1000, 1001, 1002, 1003)] == ["bb", "aa", "bb", "bb"]
    assert got[1004].language == "aa" and got[1004].accepted  # a long text outweighs the rest
    assert got[1012].language == "aa"
    for d in (1010, 1011):
        assert got[d].language is None and not got[d].accepted
    assert not got[1005].accepted  # fits no language better than chance


def test_odd_tables(spark):
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in ODD], DOCS)
    assert li.fit(docs.select("text", F.col("lang").alias("label"))).languages == []
    assert li.accepted_rows(docs).collect() == [] and li.accepted_rows(docs.limit(0)).collect() == []
    told = li.identify(li.documents_as_rows(docs, F.col("doc_id")), li.fit(docs.select("text", F.col("lang").alias("label"))), ["doc_id"]).collect()
    assert len(told) == len(ODD) and not any(r.accepted for r in told)


def test_rejected_rows_go_and_columns_stay(spark, sf):
    docs = with_clashes(spark.read.parquet(f"{sf}/documents.parquet"))
    odd = docs.limit(1).withColumns({"doc_id": F.lit(-5).cast("long"), "text": F.lit("\x01\x02" * 200), "lang": F.lit(None).cast("string")}).unionByName(docs.limit(1).withColumns({"doc_id": F.lit(-6).cast("long"), "text": F.lit(None).cast("string")}))
    out = li.accepted_rows(docs.unionByName(odd))
    assert out.columns == docs.columns
    ids = {r.doc_id for r in out.collect()}
    assert ids == {r.doc_id for r in docs.select("doc_id").collect()}


def plain(rows, labelled):
    """What fit and identify do, in plain Python: rows of (key, text, declared, suffix, host, domain), labelled of (text, label)."""
    texts = {}
    for t, label in labelled:
        if t is not None and label in li.LANGUAGES:
            texts.setdefault(label, set()).add(t)
    langs = sorted(x for x, v in texts.items() if len(v) >= li.LEAST)
    assert all(len(texts[x]) <= li.SAMPLE for x in langs)
    n = np.zeros((li.BUCKETS, len(langs)))
    for k, x in enumerate(langs):
        for t in texts[x]:
            for b in li.trigrams(t.encode()).tolist():
                n[b, k] += 1
    total = n.sum(axis=0)
    logp = np.log((n + 0.5) / (total + 0.5 * li.BUCKETS))
    usual, unseen = (n * logp).sum(axis=0) / total, np.log(0.5 / (total + 0.5 * li.BUCKETS))
    logp = logp.astype(np.float32)
    told = []
    for r in rows:
        t = li.trigrams((r[1] or "").encode())
        told.append((len(t), logp[t].mean(axis=0).astype(float) if len(t) else None))
    best = [int(np.argmax(m)) if c else None for c, m in told]
    L = len(langs)
    whole = [sum(b == k for b in best) for k in range(L)]
    counted = [{} for _ in range(4)]
    keys = lambda r: (r[5] and (r[5],), r[4] and (r[4], r[5]), r[2] and (r[2],), r[3] and (r[3],))
    for r, b in zip(rows, best, strict=True):
        for by, key in zip(counted, keys(r), strict=True):
            if key and b is not None:
                by.setdefault(key, [0.0] * L)[b] += 1
    out = []
    for r, b, (c, mean) in zip(rows, best, told, strict=True):
        if b is None:
            out.append((None, None, False))
            continue
        own = [[max(x - (k == b), 0.0) for k, x in enumerate(by.get(key, [0.0] * L))] for by, key in zip(counted, keys(r), strict=True)]
        mixed = lambda counts, prior: [(x + li.SMOOTH * p) / (sum(counts) + li.SMOOTH) for x, p in zip(counts, prior, strict=True)]
        prior = mixed(own[1], mixed(own[0], [(x + 1) / (sum(whole) + L) for x in whole]))
        s = [m * min(c, li.WEIGHT) + math.log(p) for m, p in zip(mean, prior, strict=True)]
        for counts in own[2:]:
            if sum(counts) > 0:
                s = [v + math.log((x + li.SMOOTH * sum(counts) / sum(whole)) / (w + li.SMOOTH) + 1e-6) for v, x, w in zip(s, counts, whole, strict=True)]
        k = int(np.argmax(s))
        post = 1 / sum(math.exp(v - s[k]) for v in s)
        out.append((langs[k], post, post >= li.ACCEPT and usual[k] - mean[k] < li.STRANGE * (usual[k] - unseen[k])))
    return out


def same(got, want):
    assert len(got) == len(want)
    for key, (language, posterior, accepted) in want.items():
        r = got[key]
        assert (r.language, r.accepted) == (language, accepted), key
        assert posterior is None or abs(r.posterior - posterior) < 1e-4


def test_documents_and_pages_against_plain_python(spark, sf):
    """The registered queries over their whole tables."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = plain([(r.doc_id, r.text, r.lang, None, r.source, None) for r in docs], [(r.text, r.lang) for r in docs])
    same({r.doc_id: r for r in li.op10_language_id(spark, sf).collect()}, dict(zip([r.doc_id for r in docs], want, strict=True)))
    rows = li.pages_as_rows(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    assert all(r.text and "<" not in r.text and r.host and r.domain for r in rows)
    want = plain([(r.page_id, r.text, r.declared, r.suffix, r.host, r.domain) for r in rows], [(r.text, r.declared) for r in rows])
    got = {r.page_id: r for r in li.op10_language_id_pages(spark, sf).collect()}
    same(got, dict(zip([r.page_id for r in rows], want, strict=True)))
    assert sum(got[r.page_id].language == r.declared for r in rows) / len(rows) > 0.8
