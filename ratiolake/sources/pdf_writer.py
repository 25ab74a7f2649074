"""PDF files from parts of others: merge, split, sanitize and flatten, for any number of files at once.

Objects travel as rows with their own bytes, so what is not changed is written as it was read. What an output has
is what its pages, or its catalogue, reach once entries are taken out. Objects get new numbers by ranks over ranges
of an output, references follow by joins, and offsets are running sums over ranges again, so that neither a large file nor
a merge of many meets in one task. An output is a table of chunks in order; `whole` puts small files together.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratiolake.operators.relational import offsets
from ratiolake.sources import pdf_objects as po
from ratiolake.sources import pdf_reports as rep
from ratiolake.tables import before_each_range, ranged, united, written, written_any

#: Numbers of an output's own objects; the page tree node of its source i is NODES + i.
CATALOG, ROOT, INFO, NODES = 1, 2, 3, 4
HEADER = "%PDF-1.7\n"
PARTS = "path string, obj bigint, body binary, stream binary, refs array<bigint>"
#: Keys of the information dictionary that a merge sets.
TOLD = ["Title", "Author", "Subject", "Keywords"]
EDITS = "path string, obj bigint, drop array<string>, add map<string,string>"


def pdf_text(text: Column) -> Column:
    """Text as a PDF string: hexadecimal UTF-16 with its mark."""
    return F.concat(F.lit("<FEFF"), F.hex(F.encode(text, "UTF-16BE")), F.lit(">"))


def json_as_pdf(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with JSON values in some columns as PDF text; null stays null."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [pa.array([None if v is None else po.written_as(json.loads(v)) for v in batch[c].to_pylist()], pa.string()) if c in columns else batch[c] for c in batch.schema.names]
            yield pa.record_batch(out, names=batch.schema.names)

    return rows.mapInArrow(work, rows.schema)


def parts(files: DataFrame, edits: DataFrame | None = None, more: DataFrame | None = None) -> DataFrame:
    """PARTS of files (path, content): each object's bytes after edits, its stream, and what it refers to; a stream's length is told in place.

    edits (EDITS) take keys out of dictionaries and then add those that are missing, as PDF text. more (path, obj, body,
    stream) are further objects.
    """
    rows = po.bodies(files)
    rows = rows if more is None else rows.unionByName(more)
    if edits is None:
        rows = rows.withColumns({"drop": F.lit(None).cast("array<string>"), "add": F.lit(None).cast("map<string,string>")})
    else:
        rows = rows.join(edits.hint("merge"), ["path", "obj"], "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = []
            for body, size, drop, add in zip(batch["body"].to_pylist(), pc.binary_length(batch["stream"]).to_pylist(), batch["drop"].to_pylist(), batch["add"].to_pylist(), strict=True):
                drop, add = list(drop or ()), dict(add or ())
                if size is not None:
                    drop, add = [*drop, "Length"], {**add, "Length": str(size)}
                bodies.append(po.edited(body, drop, add) if drop or add else body)
            refs = pa.array([po.references(b) for b in bodies], pa.list_(pa.int64()))
            yield pa.record_batch([batch["path"], batch["obj"], pa.array(bodies, pa.binary()), batch["stream"], refs], names=["path", "obj", "body", "stream", "refs"])

    return written(rows.select("path", "obj", "body", "stream", "drop", "add").mapInArrow(work, PARTS), "parts")


def reached(roots: DataFrame, of: DataFrame, cut: DataFrame | None = None) -> DataFrame:
    """(out, idx, path, obj) of all that the objects of roots (out, idx, path, obj) reach among parts, a step a round; nodes of cut (path, obj) are entered from no other object."""
    edges = of.select(F.col("path").alias("_p"), F.col("obj").alias("_a"), F.explode("refs").alias("_b"))
    if cut is not None:
        edges = edges.join(cut.select(F.col("path").alias("_p"), F.col("obj").alias("_b")).distinct(), ["_p", "_b"], "left_anti")
    edges = written(edges.join(of.select(F.col("path").alias("_p"), F.col("obj").alias("_b")), ["_p", "_b"], "left_semi"), "edges")
    last, some = written_any(roots.select("out", "idx", "path", "obj").distinct(), "reached")
    found = [last]
    while some:
        step = found[-1].join(edges, (F.col("path") == F.col("_p")) & (F.col("obj") == F.col("_a"))).select("out", "idx", "path", F.col("_b").alias("obj")).distinct()
        last, some = written_any(step.join(united(found), ["out", "idx", "path", "obj"], "left_anti"), "reached")
        found.append(last)
    return reduce(DataFrame.unionByName, found)


def numbered(members: DataFrame, reserved: DataFrame) -> DataFrame:
    """members (out, idx, path, obj) with `number`: ranks in each output after its reserved (out, reserved) numbers."""
    x = ranged(members, ["out", "idx", "obj"], "members")
    before = before_each_range(x, "out")
    here = F.row_number().over(Window.partitionBy("out", "_range").orderBy("idx", "obj"))
    x = x.withColumn("_here", here).join(before, (F.col("out") == F.col("_g")) & (F.col("_range") == F.col("_r"))).join(reserved.hint("merge"), "out")
    return written(x.select("out", "idx", "path", "obj", (F.col("reserved") + F.col("_before") + F.col("_here")).alias("number")), "numbers")


def serialised(numbers: DataFrame, of: DataFrame, tails: DataFrame | None = None) -> DataFrame:
    """(out, number, data): each object as it stands in its output, references renumbered; tails (out, idx, obj, tail) are added to dictionaries as they are."""
    x = numbers.join(of, ["path", "obj"])
    to = numbers.select("out", "idx", F.col("obj").alias("_ref"), F.col("number").alias("_to"))
    asked = x.select("out", "idx", "obj", F.explode("refs").alias("_ref")).join(to, ["out", "idx", "_ref"])
    new = written(asked.groupBy("out", "idx", "obj").agg(F.collect_list(F.struct("_ref", "_to")).alias("new")), "references")
    x = x.join(new, ["out", "idx", "obj"], "left")
    x = x.withColumn("tail", F.lit(None).cast("string")) if tails is None else x.join(tails.hint("merge"), ["out", "idx", "obj"], "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = []
            for number, body, stream, new, tail in zip(*(batch[c].to_pylist() for c in ("number", "body", "stream", "new", "tail")), strict=True):
                body = po.renumbered(body, {r["_ref"]: r["_to"] for r in new or ()})
                if tail is not None:
                    body = b"%s %s >>" % (body[:-2].rstrip(), tail.encode())
                inner = b"" if stream is None else b"\nstream\n" + stream + b"\nendstream"
                data.append(b"%d 0 obj\n%s%s\nendobj\n" % (number, body, inner))
            yield pa.record_batch([batch["out"], batch["number"], pa.array(data, pa.binary())], names=["out", "number", "data"])

    return x.select("out", "number", "body", "stream", "new", "tail").mapInArrow(work, "out string, number bigint, data binary")


def chunks(objects: DataFrame, ends: DataFrame) -> DataFrame:
    """(out, section, at, data): files in chunks, ordered by section and at, from objects (out, number, data), numbers from 1 on without gaps, and ends (out, root, info).

    Sections: 0 the header, 1 objects, 2 the table's head, 3 its entries, range by range, 4 the end.
    """
    x = ranged(objects.withColumn("size", F.octet_length("data").cast("long")), ["out", "number"], "serialised")
    before = before_each_range(x, "out", "size")
    w = Window.partitionBy("out", "_range").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    placed = x.select("out", "number", "size", "_range", F.sum("size").over(w).alias("_upto")).join(before, (F.col("out") == F.col("_g")) & (F.col("_range") == F.col("_r")))
    entry = F.concat(F.lpad((F.lit(len(HEADER)) + F.col("_before") + F.col("_upto") - F.col("size")).cast("string"), 10, "0"), F.lit(" 00000 n \n"))
    lines = placed.select("out", "_range", F.struct("number", entry.alias("entry")).alias("e")).groupBy("out", "_range").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["entry"]), "").alias("text"))
    totals = written(x.groupBy("out").agg(F.count("*").alias("n"), F.sum("size").alias("size")).join(ends.hint("merge"), "out"), "totals")
    text = lambda *some: F.concat(*[F.lit(s) if isinstance(s, str) else s.cast("string") for s in some])
    as_bytes = lambda c: F.encode(c, "ISO-8859-1")
    head = text("xref\n0 ", F.col("n") + 1, "\n0000000000 65535 f \n")
    end = text("trailer\n<< /Size ", F.col("n") + 1, " /Root ", F.col("root"), " 0 R /Info ", F.col("info"), " 0 R >>\nstartxref\n", F.col("size") + len(HEADER), "\n%%EOF\n")
    part = lambda of, section, at, data: of.select("out", F.lit(section).alias("section"), at.cast("long").alias("at"), data.alias("data"))
    none = F.lit(0)
    some = [part(totals, 0, none, as_bytes(F.lit(HEADER))), part(x, 1, F.col("number"), F.col("data")), part(totals, 2, none, as_bytes(head)), part(lines, 3, F.col("_range"), as_bytes(F.col("text"))), part(totals, 4, none, as_bytes(end))]
    return written(reduce(DataFrame.unionByName, some), "chunks")


def whole(some: DataFrame) -> DataFrame:
    """(path, content) of chunks whose files each fit a row: 2 GB at most."""
    laid = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "at", F.decode("data", "ISO-8859-1").alias("text")))), lambda c: c["text"]), "")
    return some.groupBy(F.col("out").alias("path")).agg(F.encode(laid, "ISO-8859-1").alias("content"))


def sizes(some: DataFrame) -> DataFrame:
    """(out, bytes) of chunks."""
    return some.groupBy("out").agg(F.sum(F.octet_length("data")).cast("long").alias("bytes"))


# -- pages of other files ---------------------------------------------------------------------------------


def page_edits(nodes: DataFrame, *drop: str) -> DataFrame:
    """EDITS for pages that leave their tree: what they inherit is their own, their parent goes, and the keys of drop."""
    p = json_as_pdf(nodes.filter("page is not null").select("path", "obj", *rep.INHERITED.values()), list(rep.INHERITED.values()))
    entries = F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(k).alias("key"), F.col(c).alias("value"))) for k, c in rep.INHERITED.items()])
    gone = F.array(*[F.lit(k) for k in ("Parent", *drop)])
    return p.select("path", "obj", gone.alias("drop"), F.map_from_entries(F.array_compact(entries)).alias("add"))


def tree_nodes(objs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, obj) of pages and of nodes of page trees."""
    kind = F.get_json_object("dict", "$.Type").isin("/Page", "/Pages")
    return united([objs.filter(kind).select("path", "obj"), nodes.filter("page is not null").select("path", "obj")]).distinct()


def of_pages(files: DataFrame, objs: DataFrame, nodes: DataFrame, wanted: DataFrame, info: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """chunks of files made of pages: wanted (out, idx, path, page, to) says which page `to` of an output is, info (out, info) its information as PDF text.

    Each output has all that its pages reach, but other pages, and nothing else. A page that several outputs want is in each of them.
    """
    of = parts(files.join(wanted.select("path").distinct(), "path", "left_semi"), page_edits(nodes, *drop))
    pages = written(wanted.join(nodes.filter("page is not null").select("path", "page", "obj"), ["path", "page"]), "wanted")
    members = reached(pages, of, tree_nodes(objs, nodes))
    sources = pages.groupBy("out", "idx").agg(F.count("*").alias("n"))
    per_out = written(pages.groupBy("out").agg(F.max("idx").alias("last"), F.count("*").alias("n")), "outputs")
    numbers = numbered(members, per_out.select("out", (F.col("last") + NODES).alias("reserved")))
    tails = pages.select("out", "idx", "obj", F.concat(F.lit("/Parent "), (F.col("idx") + NODES).cast("string"), F.lit(" 0 R")).alias("tail"))
    text = lambda *some: F.encode(F.concat(*[F.lit(s) if isinstance(s, str) else s.cast("string") for s in some]), "UTF-8")
    own = lambda of, number, *body: of.select("out", number.cast("long").alias("number"), text(number, " 0 obj\n", *body, "\nendobj\n").alias("data"))
    at = written(numbers.join(pages.select("out", "idx", "obj", "to"), ["out", "idx", "obj"]).groupBy("out", "idx").agg(F.array_sort(F.collect_list(F.struct("to", "number"))).alias("kids")), "kids")
    kids = lambda c: F.array_join(F.transform(c, lambda k: F.concat(k.cast("string"), F.lit(" 0 R"))), " ")
    some = [
        serialised(numbers, of, tails),
        own(per_out, F.lit(CATALOG), "<< /Type /Catalog /Pages ", F.lit(ROOT), " 0 R >>"),
        own(per_out, F.lit(ROOT), "<< /Type /Pages /Kids [", kids(F.sequence(F.lit(NODES), F.col("last") + NODES)), "] /Count ", F.col("n"), " >>"),
        own(per_out.join(info.hint("merge"), "out", "left"), F.lit(INFO), F.coalesce("info", F.lit("<< >>"))),
        # sources without pages have a node as well, so that numbers have no gaps
        own(per_out.select("out", F.explode(F.sequence(F.lit(0), "last")).alias("idx")).join(at.hint("merge"), ["out", "idx"], "left").join(sources.hint("merge"), ["out", "idx"], "left"), F.col("idx") + NODES, "<< /Type /Pages /Parent ", F.lit(ROOT), " 0 R /Kids [", F.coalesce(kids(F.col("kids")["number"]), F.lit("")), "] /Count ", F.coalesce("n", F.lit(0)), " >>"),
    ]
    return chunks(reduce(DataFrame.unionByName, some), per_out.select("out", F.lit(CATALOG).alias("root"), F.lit(INFO).alias("info")))


def information(told: DataFrame) -> DataFrame:
    """(out, info) of rows (out, TOLD and whatever keys): keys that are not null, as PDF text."""
    keys = [c for c in told.columns if c != "out"]
    entries = F.concat_ws(" ", *[F.when(F.col(k).isNotNull(), F.concat(F.lit(f"/{k} "), pdf_text(F.col(k)))) for k in keys])
    return told.select("out", F.concat(F.lit("<< "), entries, F.lit(" >>")).alias("info"))


def keyword_list(text: Column) -> Column:
    """Keywords between commas, joined by spaces."""
    return F.array_join(F.filter(F.transform(F.split(text, ","), lambda k: F.trim(k)), lambda k: k != ""), " ")


def merge_mapping(sources: DataFrame, nodes: DataFrame) -> DataFrame:
    """(out, idx, path, pages, first, last): which pages of its output each of sources (out, idx, path) gives; files that can't be read have none."""
    n = nodes.filter("page is not null").groupBy("path").agg(F.count("*").alias("pages"))
    x = sources.select("out", "idx", "path").join(n, "path", "left").withColumn("pages", F.coalesce("pages", F.lit(0)))
    x = offsets(x, "out", ["idx"], "pages")
    return x.select("out", "idx", "path", "pages", "first", (F.col("first") + F.col("pages") - 1).alias("last"))


def merged(files: DataFrame, objs: DataFrame, nodes: DataFrame, sources: DataFrame, policy: str = "keep-first", custom: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, mapping) of files (path, content) merged as sources (out, idx from 0, path) say: all pages of each, in order.

    What only a catalogue reaches, as bookmarks, is left behind. policy says what the information is: keep-first, that of
    the first source with pages, where it is not empty; blank, empty texts; custom, those of custom that are not blank.
    An object of several pages of a source is written once. objs and nodes are those of files; a source that can't be read gives no pages.
    """
    mapping = written(merge_mapping(sources, nodes), "mapping")
    with_pages = mapping.filter("pages > 0")
    wanted = with_pages.join(nodes.filter("page is not null").select("path", "page"), "path").select("out", "idx", "path", "page", (F.col("first") + F.col("page") - 1).alias("to"))
    outs = with_pages.groupBy("out").agg(F.min_by("path", "idx").alias("path"))
    if policy == "keep-first":
        told = outs.join(rep.metadata(objs).hint("merge"), "path").select("out", "Title", "Author", "Subject", F.nullif(keyword_list(F.col("Keywords")), F.lit("")).alias("Keywords"))
    elif policy == "blank":
        told = outs.select("out", *[F.lit("").alias(k) for k in TOLD])
    elif policy == "custom":
        given = {k: (custom or {}).get(k, "").strip() for k in TOLD}
        given["Keywords"] = " ".join(k.strip() for k in given["Keywords"].split(",") if k.strip())
        told = outs.select("out", *[F.lit(v or None).cast("string").alias(k) for k, v in given.items()])
    else:
        raise ValueError(f"unknown policy of metadata: {policy}")
    return of_pages(files, objs, nodes, wanted, information(told)), mapping


def merge_totals(some: DataFrame, mapping: DataFrame) -> DataFrame:
    """(out, sources, pages, bytes) of a merge."""
    return mapping.groupBy("out").agg(F.count("*").alias("sources"), F.sum("pages").alias("pages")).join(sizes(some), "out")


def split_plan(nodes: DataFrame, ranges: DataFrame | None = None, prefix: str = "split", pad: bool = True) -> DataFrame:
    """(out, path, part, first, last): the files that each file's pages go to: one for each page, or for each of ranges (path, ranges of structs first, last).

    An output is called after its source, prefix, number (padded with zeros to one width) and pages. Files without ranges are not split.
    """
    n = nodes.filter("page is not null").groupBy("path").agg(F.max("page").alias("n"))
    each = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.struct(i.alias("first"), i.alias("last")))
    x = n.select("path", each.alias("ranges")) if ranges is None else n.join(ranges, "path").select("path", "ranges")
    x = x.select("path", F.size("ranges").alias("many"), F.posexplode("ranges").alias("i", "r")).withColumn("part", F.col("i") + 1)
    number = F.lpad(F.col("part").cast("string"), F.length(F.col("many").cast("string")), "0") if pad else F.col("part").cast("string")
    pages = F.concat(F.lit("p"), F.col("r.first").cast("string"), F.when(F.col("r.first") != F.col("r.last"), F.concat(F.lit("-"), F.col("r.last").cast("string"))).otherwise(""))
    return x.select(F.concat(F.regexp_replace("path", r"(?i)\.pdf$", ""), F.lit(f"_{prefix.strip() or 'split'}_"), number, F.lit("_"), pages, F.lit(".pdf")).alias("out"), "path", "part", F.col("r.first").alias("first"), F.col("r.last").alias("last"))


def split(files: DataFrame, objs: DataFrame, nodes: DataFrame, plan: DataFrame) -> DataFrame:
    """chunks of the files of a split_plan; each has its pages, in order, and only what these reach, without information."""
    wanted = plan.select("out", F.lit(0).alias("idx"), "path", "first", F.explode(F.sequence("first", "last")).alias("page"))
    wanted = wanted.select("out", "idx", "path", "page", (F.col("page") - F.col("first") + 1).alias("to"))
    return of_pages(files, objs, nodes, wanted, plan.select("out", F.lit("<< >>").alias("info")))


def split_report(some: DataFrame, plan: DataFrame) -> DataFrame:
    """split_plan with the pages and bytes of each output."""
    return plan.join(sizes(some).hint("merge"), "out").withColumn("pages", F.col("last") - F.col("first") + 1)


# -- files that stay, but for what is taken out -------------------------------------------------------------


def kept_catalog(files: DataFrame, objs: DataFrame, edits: DataFrame, info: DataFrame, more: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, parts' numbers) of files (path, content) after edits: what their catalogue reaches then, with the information (out, info) given."""
    of = parts(files, edits, more)
    roots = written(rep.catalog(objs).filter("root is not null").select(F.col("path").alias("out"), F.lit(0).alias("idx"), "path", F.col("root").alias("obj")), "roots")
    numbers = numbered(reached(roots, of), roots.select("out", F.lit(1).alias("reserved")))
    ends = written(numbers.join(roots.hint("merge"), ["out", "idx", "path", "obj"]).select("out", F.col("number").alias("root"), F.lit(1).alias("info")), "ends")
    own = ends.select("out").join(info.hint("merge"), "out", "left").select("out", F.lit(1).cast("long").alias("number"), F.encode(F.concat(F.lit("1 0 obj\n"), F.coalesce("info", F.lit("<< >>")), F.lit("\nendobj\n")), "UTF-8").alias("data"))
    return chunks(serialised(numbers, of).unionByName(own), ends), numbers


#: What a sanitized catalogue loses, by option; pages lose annotations with their additional actions.
CATALOG_KEYS = {"actions": ["OpenAction", "AA"], "names": ["Names"], "form": ["AcroForm"], "metadata": ["Metadata"]}
#: The keys of the information that are emptied.
EMPTIED = ["Title", "Author", "Subject", "Keywords", "Producer", "Creator"]


def sanitized(files: DataFrame, objs: DataFrame, nodes: DataFrame, rebuild: bool = True, annotations: bool = True, actions: bool = True, names: bool = True, form: bool = True, metadata: bool = True) -> tuple[DataFrame, DataFrame]:
    """(chunks, report) of files without what opens, runs, carries or tells; outputs have the names of their sources.

    rebuild makes a new catalogue from the pages alone; without it the old one stays, less the entries of the options. In both no object stays
    that only a dropped entry reached. report: path, pages, annotations_removed, open_action_removed, catalog_aa_removed,
    names_removed, form_removed (what the catalogue lost, false where it is new), metadata_cleared, rebuilt.
    """
    drop = ("Annots", "AA") if annotations else ()
    blank = objs.filter("obj = 0").select(F.col("path").alias("out"), *[F.lit("").alias(k) for k in EMPTIED])
    info = information(blank) if metadata else blank.select("out", F.lit("<< >>").alias("info"))
    good = nodes.filter("page is not null")
    lost = {k for name, keys in CATALOG_KEYS.items() if {"actions": actions, "names": names, "form": form, "metadata": metadata}[name] for k in keys}
    has = rep.catalog(objs)
    if rebuild:
        some = of_pages(files, objs, nodes, good.select(F.col("path").alias("out"), F.lit(0).alias("idx"), "path", "page", F.col("page").alias("to")), info, drop)
    else:
        edits = has.filter("root is not null").select("path", F.col("root").alias("obj"), F.array(*map(F.lit, sorted(lost))).cast("array<string>").alias("drop"))
        if drop:
            edits = edits.unionByName(good.select("path", "obj", F.array(*map(F.lit, drop)).alias("drop")))
        some, _ = kept_catalog(files, objs, edits.withColumn("add", F.lit(None).cast("map<string,string>")), info)
    listed = _annotation_lists(objs, good)
    went = {k: F.lit(k in lost and not rebuild) & rep._get(k).isNotNull() for k in ("OpenAction", "AA", "Names", "AcroForm")}
    report = good.groupBy("path").agg(F.count("*").alias("pages")).join(listed.hint("merge"), "path", "left").join(has.hint("merge"), "path")
    return some, report.select(
        "path", "pages", F.coalesce("annotations", F.lit(0)).alias("annotations_removed") if annotations else F.lit(0).cast("long").alias("annotations_removed"),
        went["OpenAction"].alias("open_action_removed"), went["AA"].alias("catalog_aa_removed"), went["Names"].alias("names_removed"), went["AcroForm"].alias("form_removed"), F.lit(metadata).alias("metadata_cleared"), F.lit(rebuild).alias("rebuilt"),
    )


def _annotation_lists(objs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, annotations): how many entries the annotation lists of a file's pages have."""
    p = rep.resolved_value(nodes.filter("annots is not null"), "annots", objs)
    return p.groupBy("path").agg(F.sum(F.coalesce(F.size(F.from_json("annots", "array<string>")), F.lit(0))).alias("annotations"))


# -- forms as content of pages --------------------------------------------------------------------------------


def placements(objs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, page, at, widget, appearance, x, y, name): the widgets of pages whose appearance can be drawn, with the name of the drawing in its page.

    The appearance of a button's state is that of the field's value, else of Off.
    """
    w = rep.page_annotations(objs, nodes).filter(rep._name("Subtype") == "Widget")
    by = ["path", "page", "at"]
    w = rep.followed(w, by, {"_rect": "Rect", "_ap": "AP", "_up": "Parent", "_as": "V"}, objs)
    w = w.withColumn("_state", F.regexp_replace(F.coalesce("_as", rep._get("V", "_up"), F.lit("/Off")), "^/", ""))
    w = w.withColumn("_n", rep._get("N", "_ap"))
    states = F.from_json("_n", "map<string,struct<ref:bigint>>")
    own = F.get_json_object("_n", "$.ref").cast("long")
    of_state = F.coalesce(F.try_element_at(states, F.col("_state")), F.try_element_at(states, F.lit("Off")))["ref"]
    box = F.from_json("_rect", "array<double>")
    w = w.withColumn("appearance", F.coalesce(own, of_state)).filter("appearance is not null")
    name = F.concat(F.lit("FlatWidget-"), F.row_number().over(Window.partitionBy("path", "page").orderBy("at")).cast("string"))
    return w.select(*by, F.col("annot").alias("widget"), "appearance", F.least(F.get(box, 0), F.get(box, 2)).alias("x"), F.least(F.get(box, 1), F.get(box, 3)).alias("y"), name.alias("name"))


def flattened(files: DataFrame, objs: DataFrame, nodes: DataFrame) -> DataFrame:
    """chunks of files whose form fields are drawn into their pages and gone; outputs have the names of their sources.

    A page's own content is put between q and Q; then each widget's appearance is drawn at its rectangle's corner. Widgets without
    appearance go as well. Other annotations stay.
    """
    drawn = written(placements(objs, nodes), "placements")
    number = lambda c: F.regexp_replace(F.call_function("format_number", c, F.lit("0.######")), r"^-0$", "0")
    one = F.concat(F.lit("q\n1 0 0 1 "), number(F.col("x")), F.lit(" "), number(F.col("y")), F.lit(" cm\n/"), F.col("name"), F.lit(" Do\nQ\n"))
    of_page = drawn.groupBy("path", "page").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", one.alias("ops")))), lambda o: o["ops"]), "").alias("ops"),
        F.collect_list(F.struct("name", "appearance")).alias("names"),
    )
    last = objs.groupBy("path").agg(F.max("obj").alias("last"))
    listed = rep.page_annotations(objs, nodes).withColumn("_widget", F.coalesce(rep._name("Subtype") == "Widget", F.lit(False)))
    rest = listed.filter("not _widget").groupBy("path", "page").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce(F.concat(F.lit('{"ref": '), F.col("annot").cast("string"), F.lit("}")), F.col("dict")).alias("e")))).alias("rest"))
    touched = listed.filter("_widget").select("path", "page").distinct()
    p = nodes.filter("page is not null").join(touched.hint("merge"), ["path", "page"]).join(rest.hint("merge"), ["path", "page"], "left").join(of_page.hint("merge"), ["path", "page"], "left").join(last.hint("merge"), "path")
    p = rep.resolved_value(p, "resources", objs)
    p = p.withColumn("_xo", rep._get("XObject", "resources"))
    p = rep.resolved_value(p, "_xo", objs)
    p = rep.resolved_value(p.withColumn("_c", F.col("contents")), "_c", objs, arrays_only=True)
    rest_text = F.concat(F.lit("["), F.array_join(F.transform(F.coalesce("rest", F.array().cast("array<struct<at:int,e:string>>")), lambda e: e["e"]), ", "), F.lit("]"))
    base = F.col("last") + 3 * (F.col("page") - 1)
    p = written(json_as_pdf(p.select("path", "page", "obj", "ops", "names", base.alias("base"), rest_text.alias("annots"), "resources", F.col("_xo").alias("forms"), F.col("_c").alias("contents")), ["annots", "contents"]), "flat")

    def with_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            adds = []
            for base, names, annots, resources, forms, contents in zip(*(batch[c].to_pylist() for c in ("base", "names", "annots", "resources", "forms", "contents")), strict=True):
                add = {"Annots": annots}
                if names:
                    told = json.loads(resources) if resources else {}
                    told["XObject"] = {**(json.loads(forms) if forms else {}), **{x["name"]: {"ref": x["appearance"]} for x in names}}
                    inside = (contents or "").strip()
                    inside = inside[1:-1].strip() if inside.startswith("[") else inside
                    add |= {"Resources": po.written_as(told), "Contents": f"[{base + 1} 0 R {inside} {base + 2} 0 R {base + 3} 0 R]"}
                adds.append(list(add.items()))
            drop = [[k for k, _ in a] for a in adds]
            yield pa.record_batch([batch["path"], batch["obj"], pa.array(drop, pa.list_(pa.string())), pa.array(adds, pa.map_(pa.string(), pa.string()))], names=["path", "obj", "drop", "add"])

    edits = p.mapInArrow(with_forms, EDITS)
    form = rep.catalog(objs).filter("root is not null").select("path", F.col("root").alias("obj"), F.array(F.lit("AcroForm")).alias("drop"), F.lit(None).cast("map<string,string>").alias("add"))
    more = p.filter("ops is not null").select("path", F.posexplode(F.array(F.lit("q\n"), F.lit("Q\n"), F.col("ops"))).alias("i", "text"), "base")
    more = more.select("path", (F.col("base") + F.col("i") + 1).cast("long").alias("obj"), F.encode(F.lit("<< >>"), "UTF-8").alias("body"), F.encode("text", "UTF-8").alias("stream"))
    told = rep.metadata(objs).select(F.col("path").alias("out"), *rep.INFO)
    return kept_catalog(files, objs, edits.unionByName(form), information(told), more)[0]
