"""What PDF documents hold, as joins over their tables of objects (`pdf_objects.objects`).

All take objects of any number of files and give rows with their path. Trees are walked level by level over
all files at once, until a level is empty; each level is written once. Objects met before are not entered
again, so cyclic files end; where a page tree repeats an object, its file has a row that says so. What joins and
aggregates make of objects is joined by sorting: as a broadcast it would go through the driver, and grow with the files.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratiolake.functions import text as tx
from ratiolake.functions.numbers import round_half_up
from ratiolake.sources.pdf_filters import decoded
from ratiolake.tables import united, written, written_any


def _get(key: str, of: str = "dict") -> Column:
    return F.get_json_object(of, f"$.{key}")


def _ref(key: str, of: str = "dict") -> Column:
    return F.get_json_object(of, f"$.{key}.ref").cast("long")


def _name(key: str, of: str = "dict") -> Column:
    return F.regexp_replace(_get(key, of), "^/", "")


def _resolved(rows: DataFrame, key: str, objs: DataFrame, name: str, *more: str) -> DataFrame:
    """rows with the dictionary of the object whose number the column `key` has, as column `name`; null if there is none."""
    other = objs.select(F.col("path").alias("_p"), F.col("obj").alias("_o"), F.col("dict").alias(name), *more)
    return rows.join(other, (F.col("path") == F.col("_p")) & (F.col(key) == F.col("_o")), "left").drop("_p", "_o")


def followed(rows: DataFrame, by: list[str], keys: dict[str, str], objs: DataFrame, of: str = "dict") -> DataFrame:
    """rows with the values of keys (column: path in the dictionary `of`) as JSON columns; a reference gives the value of the object it names, null if there is none.

    by are columns, path among them, that tell the rows apart. Only references are moved, all of them in one join.
    """
    entry = [F.struct(F.lit(c).alias("k"), F.get_json_object(of, f"$.{at}").alias("v")) for c, at in keys.items()]
    x = rows.withColumn("_all", F.map_from_entries(F.array(*entry)))
    number = lambda v: F.regexp_extract(v, r'^\{"ref":(?: )?(\d+)\}$', 1).try_cast("long")
    asked = x.select(*by, F.explode("_all").alias("_k", "_v")).withColumn("_to", number(F.col("_v"))).filter("_to is not null")
    # as get_json_object gives it: text without quotes
    told = _resolved(asked, "_to", objs, "_d").withColumn("_d", F.get_json_object(F.concat(F.lit("["), "_d", F.lit("]")), "$[0]")).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_k", "_d"))).alias("_told"))
    told = told.select(*[F.col(c).alias(f"_by_{c}") for c in by], "_told")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by])
    x = x.join(told.hint("merge"), same, "left").drop(*[f"_by_{c}" for c in by])
    value = lambda c: F.when(number(F.col("_all")[c]).isNotNull(), F.try_element_at("_told", F.lit(c))).otherwise(F.col("_all")[c])
    return x.withColumns({c: value(c) for c in keys}).drop("_all", "_told")


def resolved_value(rows: DataFrame, column: str, objs: DataFrame, arrays_only: bool = False) -> DataFrame:
    """rows whose JSON value in `column` is that of the object it refers to, if it is a reference; arrays_only leaves references to other values."""
    x = _resolved(rows.withColumn("_to", F.get_json_object(column, "$.ref").cast("long")), "_to", objs, "_told")
    follow = F.col("_to").isNotNull() & (F.startswith("_told", F.lit("[")) if arrays_only else F.lit(True))
    return x.withColumn(column, F.when(follow, F.col("_told")).otherwise(F.col(column))).drop("_to", "_told")


def catalog(objs: DataFrame) -> DataFrame:
    """(path, root, dict) of each file's catalogue."""
    return _resolved(objs.filter("obj = 0").select("path", _ref("Root").alias("root")), "root", objs, "dict")


def reachable(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, obj) of what the roots reach over edges (path, a, b), one step a round, until nothing new is reached."""
    seen = frontier = roots.select("path", "obj").distinct()
    to = edges.select(F.col("path").alias("_p"), "a", "b")
    while True:
        step = frontier.join(to, (F.col("path") == F.col("_p")) & (F.col("obj") == F.col("a"))).select("path", F.col("b").alias("obj")).distinct()
        frontier, some = written_any(step.join(seen, ["path", "obj"], "left_anti").join(nodes.select("path", "obj"), ["path", "obj"], "left_semi"), "frontier")
        if not some:
            return seen
        seen = written(seen.unionByName(frontier), "seen")


# -- pages ----------------------------------------------------------------------------------------------


#: What a page has from the nodes above it if not itself, and the column for it.
INHERITED = {"MediaBox": "box", "CropBox": "crop", "Rotate": "turn", "Resources": "resources"}


def _tree_entries(objs: DataFrame) -> DataFrame:
    """(path, node, leaf, _kids, _box, _crop, _turn, _resources, contents, annots) of all objects that can be read: what page trees are walked over, references followed once for all levels."""
    x = objs.filter("obj is not null and dict is not null").select("path", F.col("obj").alias("node"), "dict")
    keys = {"_kids": "Kids", "_box": "MediaBox", "_crop": "CropBox", "_turn": "Rotate"}
    some = F.rlike("dict", F.lit(f'"({"|".join(keys.values())})"'))
    x = followed(x.filter(some), ["path", "node"], keys, objs).unionByName(x.filter(~some).withColumns({c: F.lit(None).cast("string") for c in keys}))
    # most objects have none of these; a name is looked for before the object is parsed for it
    got = lambda key: F.when(F.contains("dict", F.lit(f'"{key}"')), _get(key))
    leaf = F.coalesce(F.contains("dict", F.lit('Page"')) & (_name("Type") == "Page"), F.lit(False))
    return written(x.select("path", "node", leaf.alias("leaf"), *keys, got("Resources").alias("_resources"), got("Contents").alias("contents"), got("Annots").alias("annots")), "nodes")


def page_nodes(objs: DataFrame) -> DataFrame:
    """(path, page, obj, box, crop, turn, resources, contents, annots, error): pages in order, as JSON what they have or inherit.

    error is null, but for one row of each file whose page tree enters an object again: of several places of an
    object the first counts, in its level and of all levels. Each level is written once.
    """
    inherited, entries = list(INHERITED.values()), _tree_entries(objs).withColumnsRenamed({"path": "_p", "node": "_o"})
    level = catalog(objs).select("path", _ref("Pages").alias("node"), F.array().cast("array<int>").alias("place"), *[F.lit(None).cast("string").alias(c) for c in inherited], F.lit(False).alias("again"), F.lit(False).alias("met"))
    level, levels = level.filter("node is not null"), []
    while True:
        x = level.join(entries, (F.col("path") == F.col("_p")) & (F.col("node") == F.col("_o")))
        kids = F.when(F.col("leaf") | F.col("met"), None).otherwise(F.from_json("_kids", "array<struct<ref:bigint>>"))
        x = x.select("path", "node", "place", "again", "met", *[F.coalesce(f"_{c}", c).alias(c) for c in inherited], "contents", "annots", kids.alias("kids"))
        levels.append(written(x, "tree"))
        if levels[-1].filter("kids is not null").isEmpty():
            break
        seen = united([t.select("path", "node") for t in levels]).distinct().withColumn("met", F.lit(True))
        below = levels[-1].filter("kids is not null").select("path", F.posexplode("kids").alias("i", "kid"), "place", *inherited)
        below = below.select("path", F.col("kid.ref").alias("node"), F.struct(F.concat("place", F.array("i")).alias("place"), *inherited).alias("x")).filter("node is not null")
        below = below.groupBy("path", "node").agg(F.min("x").alias("x"), F.count("*").alias("n")).join(seen, ["path", "node"], "left")
        level = below.select("path", "node", "x.*", (F.col("n") > 1).alias("again"), F.coalesce("met", F.lit(False)).alias("met"))
    found = reduce(DataFrame.unionByName, levels)
    page = F.row_number().over(Window.partitionBy("path").orderBy("place"))
    leaves = found.filter("kids is null and not met").select("path", page.alias("page"), F.col("node").alias("obj"), *inherited, "contents", "annots", F.lit(None).cast("string").alias("error"))
    told = found.filter("again or met").select("path").distinct().select("path", F.lit("page tree enters an object again").alias("error"))
    return written(leaves.unionByName(told, allowMissingColumns=True), "pages")


def pages(nodes: DataFrame) -> DataFrame:
    """(path, page, obj, width, height, rotation, mm, names of size and orientation, error) of page_nodes."""
    b = F.from_json("box", "array<double>")
    w, h = F.abs(F.get(b, 2) - F.get(b, 0)), F.abs(F.get(b, 3) - F.get(b, 1))
    mm = lambda c: round_half_up(c / 72 * 25.4, F.lit(2))
    turn = F.when(F.col("page").isNotNull(), F.pmod(F.coalesce(F.col("turn").cast("double").cast("int"), F.lit(0)), F.lit(360)))
    return nodes.select("path", "page", "obj", w.alias("width"), h.alias("height"), turn.alias("rotation"), mm(w).alias("width_mm"), mm(h).alias("height_mm"), tx.paper_name(w, h).alias("size_name"), F.when(w.isNotNull(), tx.orientation(w, h)).alias("orientation"), "error")


def page_sizes(in_pages: DataFrame, most: int = 3) -> DataFrame:
    """(path, size, n, rank): the `most` most frequent page sizes of each file, Unknown for those without a name; ties by the first page."""
    n = in_pages.filter("page is not null").groupBy("path", F.coalesce("size_name", F.lit("Unknown")).alias("size")).agg(F.count("*").alias("n"), F.min("page").alias("first"))
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("n"), "first"))
    return n.withColumn("rank", rank).filter(F.col("rank") <= most).select("path", "size", "n", "rank")


#: The keys of the information dictionary.
INFO = ["Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate"]


def metadata(objs: DataFrame) -> DataFrame:
    """path and the keys of INFO, trimmed; blank ones are null."""
    x = _resolved(objs.filter("obj = 0").select("path", _ref("Info").alias("info")), "info", objs, "dict")
    return x.select("path", *[F.when(F.trim(_get(k)) != "", F.trim(_get(k))).alias(k) for k in INFO])


def metadata_filled(told: DataFrame) -> DataFrame:
    """(path, total, filled, empty): how many keys of metadata have a value."""
    filled = sum((F.when(F.col(k).isNotNull(), 1).otherwise(0) for k in INFO[1:]), F.when(F.col(INFO[0]).isNotNull(), 1).otherwise(0))
    return told.select("path", F.lit(len(INFO)).alias("total"), filled.alias("filled"), (len(INFO) - filled).alias("empty"))


# -- annotations and links ------------------------------------------------------------------------------

#: The kinds of annotations that are told by name.
SUBTYPES = "Text Link FreeText Line Square Circle Polygon PolyLine Highlight Underline Squiggly StrikeOut Stamp Caret Ink Popup FileAttachment Sound Movie Redact".split()


def page_annotations(objs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, page, annot, dict): what stands in the pages' lists, widgets too; a list may be an object of its own, an entry a dictionary in place."""
    p = nodes.filter("annots is not null").select("path", "page", "annots", F.get_json_object("annots", "$.ref").cast("long").alias("list"))
    p = _resolved(p, "list", objs, "_l").select("path", "page", F.posexplode(F.from_json(F.coalesce("_l", "annots"), "array<string>")).alias("at", "entry"))
    p = _resolved(p.withColumn("annot", F.get_json_object("entry", "$.ref").cast("long")), "annot", objs, "_d")
    return written(p.select("path", "page", "at", "annot", F.when(F.col("annot").isNull(), F.col("entry")).otherwise(F.col("_d")).alias("dict")).filter("dict is not null"), "annotations")


def annotations(of_pages: DataFrame, objs: DataFrame) -> DataFrame:
    """(path, page, at, obj, subtype, rect, quad_points, color, flags, contents, author, modified, name, uri, action, to, target) of page_annotations, but widgets.

    Values may be references. action is the name of the action, to whether a destination is told, target the page object it names.
    """
    kind = _name("Subtype")
    by = ["path", "page", "at"]
    x = of_pages.filter(F.coalesce(kind, F.lit("")) != "Widget")
    keys = {"_rect": "Rect", "_quads": "QuadPoints", "_c": "C", "_flags": "F", "_contents": "Contents", "_author": "T", "_modified": "M", "_nm": "NM", "_a": "A", "_dest": "Dest"}
    x = written(followed(x.withColumn("_kind", kind), by, keys, objs).drop("dict"), "notes")
    x = followed(x, by, {"_s": "S", "_uri": "URI", "_d": "D"}, objs, "_a")
    kind = F.col("_kind")
    c = F.from_json("_c", "array<double>")
    color = F.when(F.size(c) == 3, c).when(F.size(c) == 1, F.array(F.get(c, 0), F.get(c, 0), F.get(c, 0)))
    action = F.when(F.startswith("_s", F.lit("/")), F.regexp_replace("_s", "^/", ""))
    to = F.when(action == "GoTo", F.col("_d")).when(action.isNull(), F.col("_dest"))
    some = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return x.select(
        "path", "page", "at", F.col("annot").alias("obj"), F.when(kind.isin(*SUBTYPES), kind).otherwise("Unknown").alias("subtype"), F.from_json("_rect", "array<double>").alias("rect"),
        F.from_json("_quads", "array<double>").alias("quad_points"), color.alias("color"), F.coalesce(F.col("_flags").try_cast("int"), F.lit(0)).alias("flags"), F.col("_contents").alias("contents"),
        F.col("_author").alias("author"), F.col("_modified").alias("modified"), F.col("_nm").alias("name"), F.when(action == "URI", some(F.col("_uri"))).alias("uri"), action.alias("action"),
        ((action == "GoTo") | (action.isNull() & F.col("_dest").isNotNull())).alias("to"), F.get_json_object(to, "$[0].ref").cast("long").alias("target"),
    )


def links(notes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, page, at, kind, url, target_page) of link annotations: url, internal or unknown; those without action and destination are left out.

    A url may be without address; an internal link has no page where its destination is a name or no page of the file.
    """
    told = F.coalesce("to", F.lit(False))
    a = notes.filter((F.col("subtype") == "Link") & (F.col("action").isNotNull() | told))
    to = nodes.filter("page is not null").select(F.col("path").alias("_p"), F.col("obj").alias("_o"), F.col("page").alias("target_page"))
    a = a.join(to, (F.col("path") == F.col("_p")) & (F.col("target") == F.col("_o")), "left")
    kind = F.when(F.col("action") == "URI", "url").when(told, "internal").otherwise("unknown")
    return a.select("path", "page", "at", kind.alias("kind"), F.col("uri").alias("url"), "target_page")


def link_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("path").agg(F.count("*").alias("links"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("url", "internal", "unknown")])


def annotation_counts(notes: DataFrame) -> DataFrame:
    return notes.groupBy("path").agg(F.count("*").alias("annotations"), *[F.count_if(F.col("subtype") == k).alias(k.lower()) for k in ("Highlight", "Text", "FreeText", "Ink")])


# -- fonts and images -----------------------------------------------------------------------------------


def page_resources(objs: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """(path, page, name, obj): entries of one kind (Font, XObject) in the pages' resources, which may be objects of their own."""
    p = nodes.filter("resources is not null").select("path", "page", "resources", F.get_json_object("resources", "$.ref").cast("long").alias("own"))
    p = _resolved(p, "own", objs, "_r").select("path", "page", F.get_json_object(F.coalesce("_r", "resources"), f"$.{kind}").alias("listed"))
    p = _resolved(p.withColumn("own", F.get_json_object("listed", "$.ref").cast("long")), "own", objs, "_l")
    entries = F.explode(F.from_json(F.coalesce("_l", "listed"), "map<string,struct<ref:bigint>>")).alias("name", "entry")
    return p.select("path", "page", entries).select("path", "page", "name", F.col("entry.ref").alias("obj")).filter("obj is not null")


def fonts(objs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Fonts of pages: (path, obj, base_font, subtype, encoding, file, embedded, status, to_unicode, parts of the name, pages).

    file is the kind of font file; embedded is null and status unknown where no descriptor says; that of a
    composite font is its first descendant's.
    """
    used = page_resources(objs, nodes, "Font").groupBy("path", "obj").agg(F.array_sort(F.collect_set("page")).alias("pages"))
    f = written(_resolved(used, "obj", objs, "dict").filter("dict is not null"), "fonts")
    f = followed(f, ["path", "obj"], {"_below": "DescendantFonts"}, objs).withColumn("below", F.get_json_object("_below", "$[0].ref").cast("long"))
    f = _resolved(f, "below", objs, "_b").withColumn("descriptor", F.coalesce(_ref("FontDescriptor"), _ref("FontDescriptor", "_b")))
    f = _resolved(f, "descriptor", objs, "_d")
    file = F.coalesce(*[F.when(_ref(k, "_d").isNotNull(), F.lit(k)) for k in ("FontFile", "FontFile2", "FontFile3")])
    f = f.select("path", "obj", _name("BaseFont").alias("base_font"), _name("Subtype").alias("subtype"), _name("Encoding").alias("encoding"), file.alias("file"), F.when(F.col("_d").isNotNull(), file.isNotNull()).alias("embedded"), _ref("ToUnicode").isNotNull().alias("to_unicode"), "pages")
    parts = tx.font_name(F.col("base_font"))
    status = F.when(F.col("embedded").isNull(), "unknown").when(~F.col("embedded"), "none").when(parts["subset"], "subset").otherwise("full")
    return f.select("*", status.alias("status"), *[c.alias(f"name_{k}") for k, c in parts.items()])


def font_counts(found: DataFrame) -> DataFrame:
    """Per path how many fonts are embedded or not, of which kinds, and of which embedding."""
    c = lambda cond, name: F.count_if(cond).alias(name)
    kinds = [c(F.col("subtype") == k, k.lower()) for k in ("Type0", "TrueType", "Type1")]
    return found.groupBy("path").agg(F.count("*").alias("fonts"), c(F.col("embedded"), "embedded"), c(~F.col("embedded"), "not_embedded"), c(F.col("embedded").isNull(), "unknown"), *kinds, c(F.col("name_subset"), "subsets"), *[c(F.col("status") == k, f"{k}_files") for k in ("full", "subset", "none")], c("to_unicode", "to_unicode"))


def embedding_problems(found: DataFrame, subsets_too: bool = False) -> DataFrame:
    """Fonts that are not embedded or of which it isn't known; subsets too if asked for."""
    bad = ~F.coalesce("embedded", F.lit(False))
    return found.filter(bad | (F.col("status") == "subset") if subsets_too else bad)


def images(objs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Images of pages: (path, obj, width, height, bits, colorspace, filters, ext, length, occurrences, pages)."""
    used = page_resources(objs, nodes, "XObject").groupBy("path", "obj").agg(F.count("*").alias("occurrences"), F.array_sort(F.collect_set("page")).alias("pages"))
    x = _resolved(used, "obj", objs, "dict", "stream_length").filter((_name("Subtype") == "Image") & F.col("stream_length").isNotNull())
    x = followed(x, ["path", "obj"], {k: k for k in ("Width", "Height", "BitsPerComponent", "ColorSpace", "Filter")}, objs)
    f = F.coalesce(F.array_join(F.transform(F.from_json("Filter", "array<string>"), lambda n: F.regexp_replace(n, "^/", "")), "+"), F.regexp_replace("Filter", "^/", ""))
    ext = F.when(F.contains(f, F.lit("DCTDecode")), "jpg").when(F.contains(f, F.lit("JPXDecode")), "jp2").otherwise("bin")
    return x.select("path", "obj", *[F.col(k).try_cast("int").alias(n) for k, n in (("Width", "width"), ("Height", "height"), ("BitsPerComponent", "bits"))], F.regexp_replace("ColorSpace", "^/", "").alias("colorspace"), f.alias("filters"), ext.alias("ext"), F.col("stream_length").alias("length"), "occurrences", "pages")


def unique_images(found: DataFrame) -> DataFrame:
    """Images that agree in size, filters and bytes as one: occurrences added up, pages united, the first object."""
    same = ["path", "width", "height", "filters", "length"]
    return found.groupBy(*same).agg(F.min("obj").alias("obj"), F.sum("occurrences").alias("occurrences"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages"))


def scan_pages(objs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, page, font_count, image_count, fax_like) for `pdf.scan_score`: fax-like images are of one bit or have a fax filter."""
    f = page_resources(objs, nodes, "Font").groupBy("path", "page").agg(F.count("*").alias("font_count"))
    x = _resolved(page_resources(objs, nodes, "XObject"), "obj", objs, "dict").filter(_name("Subtype") == "Image")
    fax = (_get("BitsPerComponent") == "1") | F.rlike(F.coalesce(_get("Filter"), F.lit("")), F.lit("CCITTFaxDecode|JBIG2Decode"))
    x = x.groupBy("path", "page").agg(F.count("*").alias("image_count"), F.bool_or(F.coalesce(fax, F.lit(False))).alias("fax_like"))
    p = nodes.filter("page is not null").select("path", "page").join(f, ["path", "page"], "left").join(x.hint("merge"), ["path", "page"], "left")
    return p.select("path", "page", F.coalesce("font_count", F.lit(0)).alias("font_count"), F.coalesce("image_count", F.lit(0)).alias("image_count"), F.coalesce("fax_like", F.lit(False)).alias("fax_like"))


# -- forms, signatures, attachments, outline ------------------------------------------------------------


def form_fields(objs: DataFrame, of_pages: DataFrame) -> DataFrame:
    """(path, obj, name, partial_name, type, value, default_value, tooltip, read_only, required, justification, max_length, page, rect) of fields without fields below them.

    Names and attributes are put together up the tree; the page is that of the field's widget.
    """
    # notes have a T too, but neither a type nor a parent
    field = objs.filter(_get("T").isNotNull() & (_get("FT").isNotNull() | _ref("Parent").isNotNull()))
    above = field.filter(_ref("Parent").isNotNull()).select("path", _ref("Parent").alias("obj")).distinct()
    keys = {"ft": _name("FT"), "v": _get("V"), "dv": _get("DV"), "tu": _get("TU"), "ff": _get("Ff"), "q": _get("Q"), "most": _get("MaxLen")}
    x = field.join(above, ["path", "obj"], "left_anti")
    x = x.select("path", "obj", _get("T").alias("name"), _get("T").alias("partial"), _get("Rect").alias("rect"), _ref("Parent").alias("up"), *[c.alias(k) for k, c in keys.items()])
    x = written(x.withColumn("been", F.array("obj")), "fields")
    done = x.filter("up is null")
    left = x.filter("up is not null")
    while not left.isEmpty():
        x = _resolved(left, "up", objs, "dict")
        x = x.select("path", "obj", F.concat_ws(".", _get("T"), "name").alias("name"), "partial", "rect", F.when(F.array_contains("been", F.coalesce("up", F.lit(-1))), F.lit(None)).otherwise(_ref("Parent")).alias("next"), F.concat("been", F.array("up")).alias("been"), *[F.coalesce(k, c).alias(k) for k, c in keys.items()])
        x = written(x.withColumnRenamed("next", "up"), "fields")
        done, left = done.unionByName(x.filter("up is null"), allowMissingColumns=True), x.filter("up is not null")
    # a signature's value is told as its reference, all else as what it names
    for k in ("v", "dv", "rect"):
        done = _resolved(done.withColumn("_to", F.get_json_object(k, "$.ref").cast("long")), "_to", objs, "_value")
        done = done.withColumn("_value", F.get_json_object(F.concat(F.lit("["), "_value", F.lit("]")), "$[0]"))
        done = done.withColumn(k, F.when(F.col("_to").isNotNull() & ((F.col("ft") != "Sig") | F.lit(k != "v")), F.col("_value")).otherwise(F.col(k))).drop("_to", "_value")
    flags = F.coalesce(F.col("ff").try_cast("long"), F.lit(0))
    bit = lambda n: flags.bitwiseAND(F.lit(1 << (n - 1))) != 0
    kind = F.when(F.col("ft") == "Tx", "text").when(F.col("ft") == "Btn", F.when(bit(17), "button").when(bit(16), "radio").otherwise("checkbox")).when(F.col("ft") == "Ch", F.when(bit(18), "dropdown").otherwise("list")).when(F.col("ft") == "Sig", "signature").otherwise("unknown")
    q = F.when(F.col("q").cast("int") == 1, "center").when(F.col("q").cast("int") == 2, "right").otherwise("left")
    w = of_pages.filter(_name("Subtype") == "Widget").select(F.col("path").alias("_p"), "page", F.explode(F.array_compact(F.array("annot", _ref("Parent")))).alias("_o"), _get("Rect").alias("_rect"))
    w = w.groupBy("_p", "_o").agg(F.min(F.struct("page", "_rect")).alias("w"))
    out = done.join(w.hint("merge"), (F.col("path") == F.col("_p")) & (F.col("obj") == F.col("_o")), "left")
    return out.select(
        "path", "obj", "name", F.col("partial").alias("partial_name"), kind.alias("type"), F.col("v").alias("value"), F.col("dv").alias("default_value"), F.col("tu").alias("tooltip"), bit(1).alias("read_only"), bit(2).alias("required"), q.alias("justification"),
        F.coalesce(F.col("most").cast("int"), F.lit(-1)).alias("max_length"), F.col("w.page").alias("page"), F.coalesce("rect", "w._rect").alias("rect"),
    )


def filled_fields(fields: DataFrame) -> DataFrame:
    """Fields that have a value: blank text and empty lists are none."""
    v = F.trim(F.coalesce("value", F.lit("")))
    return fields.filter((v != "") & (F.regexp_replace(v, r"\s", "") != "[]"))


def signatures(objs: DataFrame, fields: DataFrame) -> DataFrame:
    """(path, obj, name, page, filter, sub_filter, byte_range, contents_length, signed_at, signer, reason) of signature fields that are signed."""
    s = fields.filter("type = 'signature' and value is not null").select("path", "obj", "name", "page", "value", F.get_json_object("value", "$.ref").cast("long").alias("own"))
    s = followed(_resolved(s, "own", objs, "_s").withColumn("dict", F.coalesce("_s", "value")), ["path", "obj"], {f"_{k}": k for k in ("Filter", "SubFilter", "ByteRange", "Contents", "M", "Name", "Reason")}, objs)
    plain = lambda k: F.regexp_replace(f"_{k}", "^/", "")
    return s.select("path", "obj", "name", "page", plain("Filter").alias("filter"), plain("SubFilter").alias("sub_filter"), F.from_json("_ByteRange", "array<bigint>").alias("byte_range"), F.length("_Contents").cast("long").alias("contents_length"), F.col("_M").alias("signed_at"), F.col("_Name").alias("signer"), F.col("_Reason").alias("reason"))


def signature_counts(found: DataFrame) -> DataFrame:
    kind = F.lower(F.coalesce("sub_filter", F.lit("")))
    return found.groupBy("path").agg(F.count("*").alias("signatures"), F.count_if(F.size("byte_range") >= 4).alias("with_range"), F.count_if(F.contains(kind, F.lit("etsi"))).alias("etsi"), F.count_if(F.contains(kind, F.lit("pkcs7"))).alias("pkcs7"))


def attachments(objs: DataFrame) -> DataFrame:
    """(path, obj, name, description, mime, size, checksum, created, modified) of files in the tree of names; size is that of the stream as stored. Any value may be a reference."""
    names = followed(written(catalog(objs), "catalog"), ["path"], {"names": "Names"}, objs).select("path", F.coalesce(F.get_json_object("names", "$.EmbeddedFiles"), F.lit("{}")).alias("node"))
    level, levels = names, []
    while True:
        x = _resolved(level.withColumn("own", F.get_json_object("node", "$.ref").cast("long")), "own", objs, "_d").select("path", "node", F.coalesce("_d", "node").alias("_d"))
        x = written(x, "level")
        levels.append(written(followed(x, ["path", "node"], {"names": "Names", "kids": "Kids"}, objs, "_d").select("path", "node", "names", F.from_json("kids", "array<string>").alias("kids")), "names"))
        if levels[-1].filter("kids is not null").isEmpty():
            break
        seen = united([t.select("path", "node") for t in levels])
        level = levels[-1].select("path", F.explode("kids").alias("node")).distinct().join(seen, ["path", "node"], "left_anti")
    pairs = F.from_json("names", "array<string>")
    every = reduce(DataFrame.unionByName, levels).filter("names is not null").select("path", "node", F.posexplode(pairs).alias("at", "key"), F.get(pairs, F.col("at") + 1).alias("spec")).filter("at % 2 = 0")
    s = _resolved(every.withColumn("obj", F.get_json_object("spec", "$.ref").cast("long")), "obj", objs, "_s").withColumn("dict", F.coalesce("_s", "spec"))
    s = written(s.select("path", "node", "at", "key", "obj", "dict"), "files")
    by = ["path", "node", "at"]
    s = followed(s, by, {"uf": "UF", "f": "F", "description": "Desc", "ef": "EF"}, objs)
    s = s.select(*by, "obj", F.coalesce("uf", "f", "key").alias("name"), "description", F.coalesce(_ref("F", "ef"), _ref("UF", "ef")).alias("file"))
    f = written(_resolved(s, "file", objs, "dict", F.col("stream_length").alias("size")), "embedded")
    f = followed(f, by, {"mime": "Subtype", "params": "Params"}, objs)
    return f.select("path", "obj", "name", "description", F.regexp_replace("mime", "^/", "").alias("mime"), "size", F.hex(F.encode(_get("CheckSum", "params"), "ISO-8859-1")).alias("checksum"), _get("CreationDate", "params").alias("created"), _get("ModDate", "params").alias("modified"))


def attachment_totals(found: DataFrame) -> DataFrame:
    return found.groupBy("path").agg(F.count("*").alias("files"), F.count_if(F.col("mime").isNotNull()).alias("with_mime"), F.sum(F.coalesce("size", F.lit(0))).alias("bytes"))


def _doubled(state: DataFrame, add: Callable[[Column, Column], Column], rounds: int, name: str) -> DataFrame:
    """(path, obj, to, told) of state (path, obj, to, told, done) followed to the end: a step takes each row that isn't done to where its `to` leads, so that steps double.

    told of a row on the way is put before the row's own by add(earlier, own). After so many rounds what isn't done goes in a circle, and is left out, as are rows that lead nowhere.
    """
    state = written(state, name)
    for _ in range(rounds):
        if state.filter("not done").isEmpty():
            break
        there = state.select(F.col("path").alias("_p"), F.col("obj").alias("_o"), F.col("to").alias("_to"), F.col("told").alias("_told"), F.col("done").alias("_done"))
        on = (F.col("path") == F.col("_p")) & (F.col("to") == F.col("_o"))
        further = state.filter("not done").join(there, on).select("path", "obj", F.col("_to").alias("to"), add(F.col("_told"), F.col("told")).alias("told"), F.col("_done").alias("done"))
        state = written(state.filter("done").unionByName(further), name)
    return state.filter("done").drop("done")


def outline(objs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, place, level, title, obj, page): the tree of bookmarks, place its numbers from the top as 1.2.1.

    An item stands where a First leads to it, else where a Next does; of several the one with the smallest number counts. So each stands
    once, and items in a circle that the top does not lead to are left out. Ranks in chains of Next, and then places down the tree, are
    found for all files at once in as many rounds as the logarithms of the longest chain and of the depth.
    """
    c = _resolved(catalog(objs).withColumn("own", _ref("Outlines")), "own", objs, "_top")
    start = c.select("path", F.coalesce(_ref("First", "_top"), F.get_json_object(_get("Outlines"), "$.First.ref").cast("long")).alias("obj"), F.struct(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("by")).alias("from"))
    target = F.coalesce(F.get_json_object("dict", "$.Dest[0].ref"), F.get_json_object("dict", "$.A.D[0].ref")).cast("long")
    items = objs.filter(_get("Title").isNotNull() & F.col("obj").isNotNull()).select("path", "obj", _get("Title").alias("title"), _ref("First").alias("first"), _ref("Next").alias("next"), target.alias("target"))
    items = written(items, "bookmarks")
    leads = [items.select("path", F.col(k).alias("obj"), F.struct(F.lit(i).alias("kind"), F.col("obj").alias("by")).alias("from")) for i, k in enumerate(("first", "next"))]
    found = reduce(DataFrame.unionByName, leads, start).filter("obj is not null and obj <> from.by").groupBy("path", "obj").agg(F.min("from").alias("from"))
    found = written(found.join(items.select("path", "obj"), ["path", "obj"], "left_semi").select("path", "obj", "from.*"), "leads")
    most = items.groupBy("path").count().agg(F.max("count")).first()[0] or 0
    rounds = most.bit_length() + 1

    head = F.col("kind") == 0
    ranks = _doubled(found.select("path", "obj", F.when(head, F.col("obj")).otherwise(F.col("by")).alias("to"), F.lit(1).cast("long").alias("told"), head.alias("done")), lambda a, b: a + b, rounds, "ranks")
    heads = found.filter(head).select(F.col("path").alias("_p"), F.col("obj").alias("_o"), F.col("by").alias("up"))
    placed = ranks.join(heads, (F.col("path") == F.col("_p")) & (F.col("to") == F.col("_o")))
    top = F.col("up") == 0
    places = _doubled(placed.select("path", "obj", F.col("up").alias("to"), F.col("told").cast("string").alias("told"), top.alias("done")), lambda a, b: F.concat(a, F.lit("."), b), rounds, "places")

    told = places.select("path", "obj", F.col("told").alias("place"), F.size(F.split("told", r"\.")).alias("level")).join(items.select("path", "obj", "title", "target"), ["path", "obj"])
    to = nodes.filter("page is not null").select(F.col("path").alias("_p"), F.col("obj").alias("_o"), "page")
    return told.join(to, (F.col("path") == F.col("_p")) & (F.col("target") == F.col("_o")), "left").select("path", "place", "level", "title", "obj", "page")


def tree_filter(tree: DataFrame, needle: str) -> DataFrame:
    """Rows of a tree (path, place, title) whose title holds the needle, and all above these; an empty needle keeps all."""
    wanted = needle.strip().lower()
    if not wanted:
        return tree
    parts = F.split("place", r"\.")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    keep = tree.filter(F.contains(F.lower("title"), F.lit(wanted))).select("path", F.explode(up).alias("place")).distinct()
    return tree.join(keep.hint("merge"), ["path", "place"], "left_semi")


# -- objects --------------------------------------------------------------------------------------------


def inventory(objs: DataFrame) -> DataFrame:
    """(path, obj, kind, type, subtype, n_keys, stream_length, declared, filters, action, has_js, has_file, reached) of all objects; reached: from the trailer's Root and Info."""
    good = objs.filter("obj is not null")
    edges = good.select("path", F.col("obj").alias("a"), F.explode("refs").alias("b"))
    got = reachable(good, edges, good.filter("obj = 0")).withColumn("reached", F.lit(True))
    first = F.left("dict", F.lit(1))
    kind = F.when(F.col("stream_length").isNotNull(), "stream").when(first == "{", F.when(_get("ref").isNotNull() & (F.size(F.json_object_keys("dict")) == 1), "other").otherwise("dict")).when(first == "[", "array").when(first == '"', F.when(F.rlike("dict", F.lit('^"/')), "name").otherwise("string")).when(F.rlike("dict", F.lit("^[-0-9]")), "number").otherwise("other")
    x = good.filter("obj <> 0").join(got, ["path", "obj"], "left")
    js = _get("JS").isNotNull() | (F.coalesce(_name("S"), F.lit("")) == "JavaScript")
    file = _get("EF").isNotNull() | F.coalesce(_name("Type"), F.lit("")).isin("Filespec", "EmbeddedFile")
    return x.select("path", "obj", kind.alias("kind"), _name("Type").alias("type"), _name("Subtype").alias("subtype"), F.when(first == "{", F.size(F.json_object_keys("dict"))).alias("n_keys"), "stream_length", _get("Length").cast("long").alias("declared"), _get("Filter").alias("filters"), F.when(first == "{", _name("S")).alias("action"), js.alias("has_js"), file.alias("has_file"), F.coalesce("reached", F.lit(False)).alias("reached"))


def with_xref(inv: DataFrame, entries: DataFrame) -> DataFrame:
    """inventory with each object's cross-reference entry (xref_kind, xref_offset); null where there is none."""
    e = entries.filter("obj_number is not null").select("path", F.col("obj_number").alias("obj"), F.col("kind").alias("xref_kind"), F.col("offset").alias("xref_offset"))
    return inv.join(e.hint("merge"), ["path", "obj"], "left")


def object_totals(inv: DataFrame, hide_other: bool = False) -> DataFrame:
    """Per path objects by kind, total and largest stream, mean number of keys, scripts, files and orphans."""
    x = inv.filter("kind <> 'other'") if hide_other else inv
    return x.groupBy("path").agg(
        F.count("*").alias("objects"), *[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("dict", "stream", "array")], F.sum(F.coalesce("stream_length", F.lit(0))).alias("stream_bytes"), F.max("stream_length").alias("largest"), F.avg("n_keys").alias("mean_keys"),
        F.count_if("has_js").alias("scripts"), F.count_if("has_file").alias("files"), F.count_if(~F.col("reached")).alias("orphans"),
    )


#: What an action's name is told as.
ACTIONS = {"JavaScript": "javascript", "URI": "uri", "Launch": "launch", "SubmitForm": "submitform", "GoToR": "gotor", "Rendition": "rendition"}


def findings(objs: DataFrame, inv: DataFrame) -> DataFrame:
    """(path, kind, obj): what opens, runs or carries files, once each: from the catalogue, from actions, and from objects of files."""
    c = _resolved(catalog(objs).withColumn("own", _ref("Names")), "own", objs, "_n").withColumn("names", F.coalesce("_n", _get("Names")))
    told = F.array_compact(F.array(F.when(_get("OpenAction").isNotNull(), "openaction"), *[F.when(F.get_json_object("names", f"$.{k}").isNotNull(), k.lower()) for k in ("EmbeddedFiles", "JavaScript")]))
    roots = c.select("path", F.explode(told).alias("kind"), F.col("root").alias("obj"))
    known = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    acts = inv.filter("action is not null").select("path", F.coalesce(F.try_element_at(known, F.col("action")), F.lit("unknown-action")).alias("kind"), "obj")
    files = inv.filter("has_file").select("path", F.lit("embeddedfiles").alias("kind"), "obj")
    return roots.unionByName(acts).unionByName(files).distinct()


# -- content of pages -----------------------------------------------------------------------------------

_OPERATOR = re.compile(
    rb"%[^\r\n]*|(?P<image>\bBI\b(?P<head>.*?)\bID\b.*?\bEI\b)|(?P<operand>\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<<|>>|<[0-9A-Fa-f\s]*>|[\[\]]|/[^\s()<>\[\]{}/%]*|[+-]?(?:\d+\.?\d*|\.\d+)(?![^\s()<>\[\]{}/%])|\b(?:true|false|null)\b)|(?P<name>[^\s()<>\[\]{}/%]+)", re.S
)
OPS = "path string, page int, at int, op string, args string"


def content_ops(data: bytes, most: int | None = None) -> Iterator[tuple[str, str]]:
    """(operator, operands as they stand) of a content stream; an inline image is one operator with its dictionary. most ends it early."""
    held: list[bytes] = []
    n = 0
    for m in _OPERATOR.finditer(data):
        if m["operand"] is not None:
            held.append(m["operand"])
        elif m["image"] is not None or m["name"] is not None:
            op, args = ("INLINE_IMAGE", m["head"].strip()) if m["image"] is not None else (m["name"].decode("latin-1"), b" ".join(held))
            yield op, args.decode("latin-1")
            held, n = [], n + 1
            if n == most:
                return


def _content_streams(objs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, page, i, obj, dict, stream_start, stream_length): the content streams of pages, in order."""
    p = nodes.filter("contents is not null").select("path", "page", "contents", F.get_json_object("contents", "$.ref").cast("long").alias("own"))
    p = _resolved(p, "own", objs, "_c", "stream_length")
    several = F.from_json(F.when(F.col("stream_length").isNotNull(), F.concat(F.lit("["), "contents", F.lit("]"))).otherwise(F.coalesce("_c", "contents")), "array<struct<ref:bigint>>")
    p = p.select("path", "page", F.posexplode(several).alias("i", "r")).select("path", "page", "i", F.col("r.ref").alias("obj"))
    return _resolved(p, "obj", objs, "dict", "stream_start", "stream_length").filter("stream_start is not null")


STREAMS = "path string, obj bigint, data binary, error string"


def streams_of(files: DataFrame, wanted: DataFrame, objs: DataFrame) -> DataFrame:
    """STREAMS: the streams of wanted (path, obj, dict, stream_start, stream_length), each once, decoded; those with an unknown filter or broken bytes as they are, with the reason."""
    wanted = written(wanted.filter("stream_start is not null"), "streams")
    p = followed(wanted.dropDuplicates(["path", "obj"]), ["path", "obj"], {"filters": "Filter", "parms": "DecodeParms"}, objs)
    listed = p.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(F.col("stream_start").alias("start"), F.col("stream_length").alias("length"), "obj", "filters", "parms"))).alias("streams"))

    def value(told: str | None):
        return None if told is None else json.loads(told) if told[:1] in "[{" else told

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, streams in zip(batch["path"].to_pylist(), batch["content"], batch["streams"].to_pylist(), strict=True):
                whole = content.as_buffer()
                for s in streams:
                    data, error = whole[s["start"] : s["start"] + s["length"]].to_pybytes(), None
                    try:
                        data = decoded(data, value(s["filters"]), value(s["parms"]))
                    except ValueError as e:
                        error = str(e)
                    yield pa.record_batch([pa.array([x], k) for x, k in zip((path, s["obj"], data, error), (pa.string(), pa.int64(), pa.binary(), pa.string()), strict=True)], names=["path", "obj", "data", "error"])

    return files.select("path", "content").join(listed, "path").mapInArrow(read, STREAMS)


def page_content(files: DataFrame, objs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, page, i, obj, data, error): the content streams of pages, in order, as streams_of gives them; one that several pages have is decoded once."""
    listed = written(_content_streams(objs, nodes), "content")
    return listed.select("path", "page", "i", "obj").join(streams_of(files, listed, objs).hint("merge"), ["path", "obj"])


def content_notes(content: DataFrame) -> DataFrame:
    """(path, page, obj, note): streams of page_content that could not be decoded."""
    return content.filter("error is not null").select("path", "page", "obj", F.col("error").alias("note"))


def page_ops(files: DataFrame, objs: DataFrame, nodes: DataFrame, most: int | None = None) -> DataFrame:
    """The operators of each page's content, in order: OPS. Streams of a page are joined by a line feed; those that can't be decoded are taken as they are."""
    of_page = page_content(files, objs, nodes).groupBy("path", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "data"))), lambda x: x["data"]).alias("parts"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, page, parts in zip(batch["path"].to_pylist(), batch["page"].to_pylist(), batch["parts"].to_pylist(), strict=True):
                ops = list(content_ops(b"\n".join(parts), most))
                yield pa.record_batch([pa.array([path] * len(ops), pa.string()), pa.array([page] * len(ops), pa.int32()), pa.array(range(len(ops)), pa.int32()), pa.array([o for o, _ in ops], pa.string()), pa.array([a for _, a in ops], pa.string())], names=["path", "page", "at", "op", "args"])

    return of_page.mapInArrow(read, OPS)


def page_op_counts(ops: DataFrame) -> DataFrame:
    """(path, page, ops, text, xobject, graphics, inline_images)."""
    of = lambda *names: F.count_if(F.col("op").isin(*names))
    return ops.groupBy("path", "page").agg(F.count("*").alias("ops"), of("Tj", "TJ", "'", '"').alias("text"), of("Do").alias("xobject"), of("cm", "q", "Q", "re", "W", "n").alias("graphics"), F.bool_or(F.col("op") == "INLINE_IMAGE").alias("inline_images"))


def op_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("path").agg(F.count("*").alias("pages"), *[F.sum(c).alias(c) for c in ("ops", "text", "xobject", "graphics")], F.bool_or("inline_images").alias("inline_images"))
