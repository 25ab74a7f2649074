"""Rows that every operator of documents must bear, and plain helpers."""

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside; tables may have such columns too.
CLASHES = ["d", "t", "n", "key", "row", "at", "kept", "family", "digest", "norm", "packed", "near", "base", "id", "own", "file", "gone", "gone_key", "spot", "hash", "place"]
CLASHES += ["_k", "_at", "_bucket", "_near", "_bits", "_file", "_row", "_metadata", "_row_hash", "_g0", "with.dot"]


def table(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema)


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(f"other {c}") for c in CLASHES})


LONG = "lorem " * 30000
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n\x0b\x0c\r "),
    (4, "One"),
    (5, "one"),
    (6, LONG),
    (7, LONG),
    (7, LONG),
    (8, "É é  x y \U0001f600 ǅ Σς"),
    (None, "no id"),
    (None, None),
]


def words(text):
    return (text or "").encode().split()


def lower(text):
    return (text or "").encode().lower().decode()
