"""What plans do with tables that are larger than their files tell, and with work that is larger than its rows."""

import pytest
from pyspark.sql import functions as F

from ratiolake import tables
from ratiolake.functions import chance
from ratiolake.plans import pdf_queries, registry


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_much_alike_are_not_broadcast_for_their_small_file(spark):
    alike = tables.written(spark.range(60_000).select("id", F.repeat(F.lit("same"), 100).alias("text")), "alike")
    few = tables.written(spark.range(10).select("id", F.lit("x").alias("text")), "few")
    assert "Broadcast" not in physical(spark.range(1000).join(alike.filter("id > 3").select("id"), "id", "left"))
    assert "Broadcast" not in physical(tables.united([few, alike]).distinct().join(tables.united([few, alike]), "id"))
    assert "Broadcast" in physical(spark.range(1000).join(few, "id"))


def test_written_tells_sizes_of_all_types_and_of_no_rows(spark):
    rows = spark.range(50).select("id", F.array("id").alias("a b"), F.create_map(F.lit("k"), "id").alias("m"), F.struct("id", F.lit("t").alias("t")).alias("s"), F.lit(None).cast("binary").alias("n.o"))
    assert tables.written(rows, "types").count() == 50
    assert tables.written(rows.filter("id < 0"), "none").count() == 0


def test_files_and_exercises_are_made_by_all_tasks(spark, sf):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for rows in (pdf_queries.pdf_files(spark, sf), pdf_queries.xref_stream_files(spark, sf), pdf_queries.unreadable(spark, sf), registry.QUERIES["p26_exercises"](spark, sf)):
        assert rows.rdd.getNumPartitions() == n > 1


def test_a_pick_does_not_draw_again(spark, sf):
    drawn = spark.range(1).select(chance.random(F.col("id"), F.col("id")).alias("chance"))
    step = str(chance.STEP)
    assert plan(registry.QUERIES["g14_weighted_pick"](spark, sf)).count(step) == plan(drawn.select("chance", F.rand())).count(step) > 0


def test_related_items_are_ranked_in_their_row(spark, sf):
    for name in ("g03_related", "g03_priorities"):
        found = plan(registry.QUERIES[name](spark, sf))
        assert "windowspecdefinition(p_partkey" not in found and "Window" in found


@pytest.mark.parametrize("name", ["a07_font_counts", "j18_fonts", "j20_flatten", "j21_sanitize", "k06_codes_without_text"])
def test_joins_of_pdf_rows_are_never_broadcast(spark, sf, monkeypatch, name):
    """With all written tables taken for large ones, every join of every step asks for sorting."""
    monkeypatch.setattr(tables, "BROADCAST", -1)
    plans, before = [], tables._stored
    monkeypatch.setattr(tables, "_stored", lambda df, *more: plans.append(plan(df)) or before(df, *more))
    plans.append(plan(registry.QUERIES[name](spark, sf)))
    joins = {line.strip(" :+-") for text in plans for line in text.splitlines() if line.strip(" :+-").startswith("Join")}
    assert joins and not [j for j in joins if "strategy=merge" not in j]


#: Queries beside those above whose plans are looked at, and steps that nothing of a query reads; of files that are written and read again, steps after that.
MORE = ["a04_page_sizes", "a05_xref_totals", "a06_link_counts", "a10_attachment_totals", "j18_mapping", "j18_merge", "j18_metadata", "j18_xref", "j19_fonts", "j19_plan", "j19_split", "j19_xref", "j21_rebuild", "k06_text"]
UNREAD = {
    "a05_xref_totals": {"objects", "tree"},
    "a10_attachment_totals": {"tree"},
    "j18_mapping": {"chunks"},
    "j18_metadata": {"tree"},
    "j18_xref": {"objects", "tree"},
    "j19_plan": {"chunks"},
    "j19_xref": {"objects", "tree"},
}


@pytest.mark.parametrize("name", MORE)
def test_queries_make_what_they_need_and_broadcast_nothing(spark, sf, monkeypatch, name):
    """As above; and steps that nothing reads are not made."""
    monkeypatch.setattr(tables, "BROADCAST", -1)
    plans, made, before = [], [], tables._stored
    monkeypatch.setattr(tables, "_stored", lambda df, as_name: (plans.append(physical(df)), made.append(as_name)) and before(df, as_name))
    plans.append(physical(registry.QUERIES[name](spark, sf)))
    assert not [p for p in plans if "Broadcast" in p]
    later = made[made.index("again") :] if "again" in made else made
    assert later and not UNREAD.get(name, set()) & set(later)


@pytest.mark.parametrize("name", ["a06_link_counts", "j20_flatten"])
def test_plans_of_pdf_queries_stay_small(spark, sf, monkeypatch, name):
    """The driver holds a plan, and plans it anew after each of its stages; what a plan reads twice is in it twice."""
    joins, before = {}, tables._stored

    def count(df, step):
        joins[step] = max(joins.get(step, 0), sum(line.strip(" :+-").startswith("Join") for line in plan(df).splitlines()))

    monkeypatch.setattr(tables, "_stored", lambda df, step: count(df, step) or before(df, step))
    count(registry.QUERIES[name](spark, sf), "result")
    assert max(joins.values()) <= 10, joins
    assert joins["tree"] <= 2, joins
