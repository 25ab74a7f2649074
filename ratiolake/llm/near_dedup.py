"""Near-duplicate groups by MinHash with tensored banding.

Two collections of GROUPS small hashes each (a hash is PER minima) give GROUPS * GROUPS table keys, one for
each pair of a hash of the first and one of the second: 32 minima serve 64 tables of four minima each, which
would take 256. Sets that are equal are one node from the start, and nodes of equal minima are tied. In each
table the rows of a key are tried with the key's smallest row; ties that agree with the minima form loose
families. Then every two rows of a key that are of different families are tried, as they are where all but a
few rows are of one family; other keys are split by one more hash, as rows that share two tables share three.

Links are then settled exactly on the full sets inside each family. Small families compare all their sets
in one task of bounded size. In a large one every set x is written as its difference D(x) from the sets'
majority; with s(x) = 9 |D(x)| - |x|, x and y have a similarity of 0.8 just if
s(x) + s(y) <= 18 |D(x) & D(y)|. Where the left side is 0 or less the row with the least s stands for all,
so one tie to it is enough; other pairs must share elements of their differences, and are found by the rarest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh3_128_digest

from .common import map_rows, maybe_among, raw_texts, without, written
from .graph import components
from .sketch import mix
from .words import Words, blocks, parts

GROUPS, PER = 8, 2
MINIMA = 2 * GROUPS * PER
#: Of MINIMA, so many are equal in rows of a loose family.
LOOSE = 13
#: Rows of a key outside its largest family, up to which all are tried with all rows of the key; so many travel together.
STRAYS = 32
#: Hashes that a split key has at most; all pairs of different families are tried there, however many.
DEEPEST = 3
#: Rows of a family that one task compares, and bytes of their texts.
SMALL, SMALL_BYTES = 32, 32 << 20
#: Shingles hashed together.
AT_ONCE = 1 << 16
#: Rows of a larger family that meet what stands for the family in one task, and of a key that meet its strays there.
SHARE = 64
_NO_ID = -(1 << 63)
_rng = np.random.Generator(np.random.PCG64(20240501))
_A = _rng.integers(0, 1 << 64, MINIMA, np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 64, MINIMA, np.uint64)


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct runs of k words, A-Z in lower case; of all its words if there are fewer."""
    for _, words in blocks([x.lower() for x in texts]):
        if isinstance(words, bytes):
            runs = [np.unique(part.runs(k)[:own]) for part, own, _ in parts(words, k - 1)]
            runs = [x for x in runs if len(x)]
            if runs:
                yield np.unique(np.concatenate(runs))
                continue
            words = Words([words])
        yield from _sets_of(words, k)


def _sets_of(words: Words, k: int) -> Iterator[np.ndarray]:
    runs = words.runs(k)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(runs[a : b - k + 1])
        elif b > a:
            whole = np.frombuffer(xxh3_128_digest(words.text[words.start[a] : words.end[b - 1]]), np.uint64)[:1]
            yield whole.copy()
        else:
            yield np.zeros(0, np.uint64)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """MINIMA minima of each of some sets, none of them empty: a row each. Some AT_ONCE shingles are hashed together."""
    out = np.empty((len(sets), MINIMA), np.uint32)
    i = 0
    while i < len(sets):
        j, size = i + 1, len(sets[i])
        while j < len(sets) and size + len(sets[j]) <= AT_ONCE:
            size += len(sets[j])
            j += 1
        first = np.concatenate(([0], np.cumsum([len(x) for x in sets[i : j - 1]]))).astype(np.int64)
        low = np.full((j - i, MINIMA), ~np.uint64(0))
        shingles = np.concatenate(sets[i:j]) if j > i + 1 else sets[i]
        # a set that is larger by itself is taken in slices
        for at in range(0, len(shingles), AT_ONCE):
            part = shingles[at : at + AT_ONCE]
            for m in range(MINIMA):
                low[:, m] = np.minimum(low[:, m], np.minimum.reduceat(part * _A[m] + _B[m], first))
        out[i:j] = low >> np.uint64(32)
        i = j
    return out


def table_keys(signatures: np.ndarray) -> np.ndarray:
    """GROUPS * GROUPS keys of each row of MINIMA minima; the low bits of a key are its table."""
    group = group_hashes(signatures)
    one, two = group[:, :GROUPS], group[:, GROUPS:]
    table = np.arange(GROUPS * GROUPS, dtype=np.uint64).reshape(GROUPS, GROUPS)
    keys = mix(one[:, :, None] * np.uint64(3) + mix(two[:, None, :] + table))
    return (keys - keys % np.uint64(GROUPS * GROUPS) + table).reshape(len(signatures), -1)


def group_hashes(signatures: np.ndarray) -> np.ndarray:
    """The 2 * GROUPS hashes of each row of MINIMA minima."""
    s = signatures.astype(np.uint64)
    return mix((s[:, ::2] << np.uint64(32) | s[:, 1::2]) + np.uint64(1))


def split_keys(group: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, mask, key): for each row of hashes and the mask of those in its key, all keys of one hash more."""
    bit = np.uint32(1) << np.arange(2 * GROUPS, dtype=np.uint32)
    held = (masks[:, None] & bit) != 0
    hashed = mix(group + np.arange(1, 2 * GROUPS + 1, dtype=np.uint64))
    total = np.where(held, hashed, np.uint64(0)).sum(axis=1, dtype=np.uint64)
    row, g = np.nonzero(~held)
    mask = masks[row] | bit[g]
    return row, mask, mix(total[row] + hashed[row, g] + mix(mask.astype(np.uint64)))


def near_groups(docs: DataFrame, k: int = 5) -> DataFrame:
    """Groups of near duplicates among docs (doc_id, text; more columns are ignored).

    A text's set is that of its distinct runs of k words `[^\\x20\\x09-\\x0D]+`, A-Z in lower case; with fewer
    words the whole sequence is one. Null texts and texts without words have the empty set and are linked
    with nothing. Sets with 100 * intersection >= 80 * union are linked; links make groups. Candidates come
    from the tables: two sets of similarity 0.8 are missed there with a chance of 0.0006, of 0.85 with 0.00007.
    Rows that repeat a doc_id are one document. A null doc_id is smaller than any other. An empty table
    gives no rows.

    One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable), kept.
    """
    docs = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("d"), "text")

    def described(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = list(shingle_sets(list(raw_texts(batch["text"])), k))
        same = [xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
        found = iter(minima([x for x in sets if len(x)]))
        lows = [next(found).tobytes() if len(x) else None for x in sets]
        yield pa.record_batch([batch["d"], pa.array([len(x) for x in sets], pa.int64()), pa.array(same, pa.binary()), pa.array(lows, pa.binary()), batch["bytes"]], names=["d", "n", "same", "minima", "bytes"])

    base = written(map_rows(docs.withColumn("bytes", F.octet_length("text").cast("long")), lambda: described, "d bigint, n bigint, same binary, minima binary, bytes bigint"), "sets")
    nodes = written(base.filter("n > 0").groupBy("same").agg(F.min_by(F.struct(F.col("d").alias("id"), "bytes"), "d").alias("first"), F.first("minima").alias("minima")).select("same", "first.*", "minima"), "nodes")

    families = loose_families(nodes.select("id", "minima"))
    links = settled(docs, families.join(nodes.select("id", "bytes"), "id"), k)
    groups = components(links)

    placed = nodes.select("same", "id").join(groups, "id", "left").select("same", F.coalesce("comp", "id").alias("comp"))
    out = base.select("d", "n", "same").join(placed, "same", "left").select("d", F.col("n").alias("n_shingles"), F.coalesce("comp", "d").alias("comp"))
    back = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    return out.select(back("d").alias("doc_id"), "n_shingles", back("comp").alias("component_id"), (F.col("d") == F.col("comp")).alias("kept"))


def one_of_each(docs: DataFrame, k: int = 5) -> DataFrame:
    """docs, all columns, less the rows that near_groups does not keep."""
    return without(docs, near_groups(docs, k).filter("not kept").select("doc_id"), {"doc_id": F.col("doc_id")})


def loose_families(nodes: DataFrame) -> DataFrame:
    """Families (id, comp) of nodes (id, minima): what share table keys and have LOOSE minima in common, and what these join.

    Of two rows that share a key either both are in one family at the end, or they were tried with each other.
    A key of more than STRAYS rows outside its largest family is replaced by all keys of one hash more.
    """
    alike = nodes.groupBy("minima").agg(F.min("id").alias("own"))
    ties = [nodes.join(alike, "minima").filter("id <> own").select(F.col("own").alias("a"), F.col("id").alias("b"))]
    sig = written(alike.select(F.col("own").alias("id"), "minima"), "minima")

    def keyed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        minima_of = _signatures(batch["minima"])
        ids = np.repeat(batch["id"].to_numpy(), GROUPS * GROUPS)
        yield pa.record_batch([pa.array(table_keys(minima_of).ravel().view(np.int64)), pa.array(ids)], names=["key", "id"])

    def split(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        row, mask, key = split_keys(group_hashes(_signatures(batch["minima"])), batch["mask"].to_numpy().astype(np.uint32))
        yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(mask.astype(np.int32)), pa.array(batch["id"].to_numpy()[row])], names=["key", "mask", "id"])

    mask = F.expr(f"shiftleft(1, cast(pmod(key, {GROUPS * GROUPS}) div {GROUPS} as int)) | shiftleft(1, {GROUPS} + cast(pmod(key, {GROUPS}) as int))")
    rows = map_rows(sig, lambda: keyed, "key bigint, id bigint")
    for hashes in range(2, DEEPEST + 1):
        # rows that share two tables share three hashes: seen in two keys here, or in one of three hashes
        tables = 2 if hashes == 2 else 1
        first = rows.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("key", "first")
        rows = written(rows.join(first, "key"), "keys")
        pairs = rows.filter("id <> first").groupBy(F.col("first").alias("a"), F.col("id").alias("b")).agg(F.count("*").alias("tables"))
        ties.append(written(agreeing(pairs.filter(F.col("tables") >= tables), sig), "ties"))
        families = components(_all(ties))

        placed = rows.join(families, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("family"), *(["mask"] if hashes > 2 else []))
        mixed = rows.join(families, "id", "left").groupBy("key").agg(F.min(F.coalesce("comp", "id")).alias("one"), F.max(F.coalesce("comp", "id")).alias("other")).filter("one < other").select("key")
        placed = written(placed.join(mixed, "key"), "mixed")
        if placed.isEmpty():
            return families
        shares = placed.groupBy("key", "family").agg(F.count("*").alias("n"))
        main = shares.groupBy("key").agg(F.max(F.struct("n", "family")).alias("m"), F.sum("n").alias("size"))
        main = main.select("key", F.col("m.family").alias("main"), "size", (F.col("size") - F.col("m.n")).alias("strays"))
        placed = written(placed.join(main, "key"), "placed")
        few = placed if hashes == DEEPEST else placed.filter(F.col("strays") <= STRAYS)
        more = written(strays_met(few, sig), "ties")
        found = not more.isEmpty()
        if found:
            ties.append(more)
        many = placed.filter(F.col("strays") > STRAYS)
        if hashes == DEEPEST or many.isEmpty():
            return components(_all(ties)) if found else families
        many = many.select("id", "key", (mask if hashes == 2 else F.col("mask")).alias("mask"))
        rows = map_rows(many.select("id", "mask").distinct().join(sig, "id"), lambda: split, "key bigint, mask int, id bigint").distinct()


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, MINIMA)


def agreeing(pairs: DataFrame, sig: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose rows of sig (id, minima) have LOOSE minima in common."""
    both = pairs.join(sig.toDF("a", "a_minima"), "a").join(sig.toDF("b", "b_minima"), "b").select("a", "b", "a_minima", "b_minima")

    def agree(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ok = (_signatures(batch["a_minima"]) == _signatures(batch["b_minima"])).sum(axis=1) >= LOOSE
        yield pa.record_batch([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(ok))

    return map_rows(both, lambda: agree, "a bigint, b bigint")


def strays_met(placed: DataFrame, sig: DataFrame) -> DataFrame:
    """Ties (a, b) between families: a pair for each two that have rows in a key of placed (key, id, family, main, size, strays) which share two tables and have LOOSE minima in common.

    A key's rows outside its largest family `main` are packed into arrays, and each row of the key meets these: no pair of
    rows is a row of its own, whatever a key has.
    """
    full = placed.join(sig, "id")
    # both sides of a key with many rows are dealt over shares of it
    shares = F.ceil(F.col("size") / SHARE).cast("int")
    pack = F.pmod(F.xxhash64("id"), F.ceil(F.col("strays") / STRAYS))
    packs = full.filter("family <> main").groupBy("key", "size", pack.alias("pack")).agg(F.collect_list(F.struct("id", "family", "minima")).alias("strays"))
    packs = packs.select("key", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"), "strays")
    rows = full.select("key", F.pmod(F.xxhash64("id"), shares).cast("int").alias("share"), "id", "family", "minima", "main")

    def meet(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch["strays"]).to_numpy())
        x = batch["strays"].flatten()
        x_id, x_family, x_minima = (x.field(c) for c in ("id", "family", "minima"))
        y_family = batch["family"].to_numpy()[at]
        # two strays meet twice
        tried = np.flatnonzero((x_family.to_numpy() != y_family) & ((y_family == batch["main"].to_numpy()[at]) | (x_id.to_numpy() < batch["id"].to_numpy()[at])))
        same = _signatures(x_minima)[tried] == _signatures(batch["minima"])[at[tried]]
        shared = same.reshape(-1, 2 * GROUPS, PER).all(axis=2)
        ok = tried[(same.sum(axis=1) >= LOOSE) & (shared[:, :GROUPS].sum(axis=1) * shared[:, GROUPS:].sum(axis=1) >= 2)]
        one = ok[np.unique(np.stack((x_family.to_numpy()[ok], y_family[ok])), axis=1, return_index=True)[1]]
        yield pa.record_batch([pa.array(x_id.to_numpy()[one]), pa.array(batch["id"].to_numpy()[at[one]])], names=["a", "b"])

    return map_rows(rows.join(packs, ["key", "share"]).select("id", "family", "main", "minima", "strays"), lambda: meet, "a bigint, b bigint")


def settled(docs: DataFrame, families: DataFrame, k: int) -> DataFrame:
    """The exact links (a, b) inside families (id, comp, bytes of the text) of docs (d, text); some that others imply are left out.

    One task compares a family of SMALL rows or fewer, if their texts are of SMALL_BYTES or fewer; rows of
    others are spread over tasks.
    """
    sizes = families.groupBy("comp").agg(F.count("*").alias("size"), F.sum("bytes").alias("bytes"))
    few = (F.col("size") <= SMALL) & (F.col("bytes") <= SMALL_BYTES)
    members = written(families.drop("bytes").join(sizes.withColumn("few", few).drop("bytes"), "comp").select(F.col("id").alias("d"), F.col("comp").alias("family"), "size", "few"), "families")
    texts = maybe_among(docs, members.select("d"), "d").join(members, "d")

    def compare(table: pa.Table) -> pa.Table:
        ids = table["d"].to_pylist()
        sets = list(shingle_sets([x for c in table["text"].chunks for x in raw_texts(c)], k))
        found = []
        for i, x in enumerate(sets):
            for j in range(i):
                y = sets[j]
                least, most = sorted((len(x), len(y)))
                if 100 * least >= 80 * most:
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * common >= 80 * (len(x) + len(y) - common):
                        found.append((ids[i], ids[j]))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    small = texts.filter("few").select("family", "d", "text").groupBy("family").applyInArrow(compare, "a bigint, b bigint")
    if members.filter("not few").isEmpty():
        return small
    return small.unionByName(_settled_large(texts.filter("not few"), k))


def _with_family(rows: DataFrame, families: DataFrame, how: str) -> DataFrame:
    """rows (family, size, d) with the columns of families (family, size), a family's rows spread over tasks."""
    shares = F.ceil(F.col("size") / SHARE).cast("int")
    rows = rows.withColumn("share", F.pmod(F.xxhash64("d"), shares).cast("int"))
    copies = families.withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("size")
    return rows.join(copies, ["family", "share"], how).drop("share")


def _settled_large(texts: DataFrame, k: int) -> DataFrame:
    def as_sets(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = [x.view(np.int64) for x in shingle_sets(list(raw_texts(batch["text"])), k)]
        yield pa.record_batch([batch["family"], batch["size"], batch["d"], pa.array(sets, pa.list_(pa.int64()))], names=["family", "size", "d", "shingles"])

    sets = written(map_rows(texts.select("family", "size", "d", "text"), lambda: as_sets, "family bigint, size bigint, d bigint, shingles array<bigint>"), "large")
    most = sets.select("family", "size", F.explode("shingles").alias("e")).groupBy("family", "size", "e").agg(F.count("*").alias("n")).filter("2 * n > size")
    centre = most.groupBy("family", "size").agg(F.collect_list("e").alias("centre"))

    def differences(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out, s = [], []
        for x, c in zip(batch["shingles"], batch["centre"], strict=True):
            x = x.values.to_numpy()
            d = np.setxor1d(x, c.values.to_numpy(), assume_unique=True) if c.is_valid else x
            out.append(d)
            s.append(9 * len(d) - len(x))
        yield pa.record_batch([batch["family"], batch["size"], batch["d"], pa.array(s, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["family", "size", "d", "s", "diff"])

    diffs = written(map_rows(_with_family(sets, centre, "left").select("family", "size", "d", "shingles", "centre"), lambda: differences, "family bigint, size bigint, d bigint, s bigint, diff array<bigint>"), "differences")
    middle = diffs.groupBy("family", "size").agg(F.min(F.struct("s", "d")).alias("m")).select("family", "size", F.col("m.s").alias("m_s"), F.col("m.d").alias("m_d"))
    # written, so that what follows is dealt out anew and no task has a whole family
    placed = written(_with_family(diffs, middle, "inner").withColumn("apart", F.col("s") + F.col("m_s") > 0), "placed")
    star = placed.filter("not apart and d <> m_d").select(F.col("m_d").alias("a"), F.col("d").alias("b"))
    # pairs of which one at least is not tied to the middle
    nearest = placed.filter("apart").groupBy("family", "size").agg(F.min("s").alias("least_s"))
    placed = written(_with_family(placed, nearest, "inner"), "placed")
    each = placed.select("family", "d", "s", "apart", "least_s", F.explode("diff").alias("e"))
    often = each.groupBy("family", "e").agg(F.count("*").alias("n"), F.max("apart").alias("wanted"))
    each = each.join(often.filter("n > 1 and wanted").select("family", "e", "n"), ["family", "e"])
    # elements in order of rarity: a pair that has t in common has one at which each side has t left
    by_rarity = Window.partitionBy("family", "d").orderBy("n", "e")
    shared = F.count("*").over(Window.partitionBy("family", "d"))
    each = each.withColumn("left", shared - F.row_number().over(by_rarity) + 1)
    need = F.greatest(F.lit(1), F.ceil((F.col("s") + F.col("least_s")) / 18))
    held = each.filter(F.col("left") >= need).select("family", "e", F.col("d").alias("y"), F.col("s").alias("y_s"), F.col("left").alias("y_left"))
    asked = each.filter("apart").select("family", "e", F.col("d").alias("x"), F.col("s").alias("x_s"), F.col("left").alias("x_left"))
    pairs = asked.join(held, ["family", "e"]).filter("x <> y and x_s + y_s > 0 and 18 * least(x_left, y_left) >= x_s + y_s").select("family", "x", "y").distinct()
    full = diffs.select("family", "d", "s", "diff")
    checked = pairs.join(full.toDF("family", "x", "x_s", "x_diff"), ["family", "x"]).join(full.toDF("family", "y", "y_s", "y_diff"), ["family", "y"])
    close = checked.filter(F.size(F.array_intersect("x_diff", "y_diff")) * 18 >= F.col("x_s") + F.col("y_s"))
    return star.unionByName(close.select(F.col("x").alias("a"), F.col("y").alias("b")))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=2)


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, ws[i] || ' ' || ws[i + 1] AS e FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM w WHERE len(ws) >= 2)
  UNION ALL SELECT doc_id, ws[1] FROM w WHERE len(ws) = 1),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.e = y.e AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.c >= 80 * (na.n + nb.n - p.c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
g AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, g.component_id, d.doc_id = g.component_id AS kept
FROM documents d JOIN g ON g.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
