r"""Chat formatting from event logs.

A log is partitioned by conversation and message and sorted by sequence; its streamed deltas, edits and
regenerations are folded into final messages, and the messages of a conversation are rendered in order.
DataFrame functions only.

The template writes each turn as ``<s>role\ntext</s>``. Inside roles and texts, control strings (those of
the template and other common ones) get a backslash after their first character, one more if they have
some there already, so reading back is exact. In roles, % and line feeds are written %25 and %0A.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import written

OPEN, CLOSE = "<s>", "</s>"
#: What follows the first character of a control string: <s> </s> [INST] [/INST] <<SYS>> <</SYS>> <|name|>
CONTROL = r"/?s>|/?INST\]|/?SYS>>|\|[A-Za-z0-9_]+\|>"

EVENTS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("part", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({CONTROL})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({CONTROL})", "$1$2$3")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, part, role, text) of a log with the columns of EVENTS.

    Events of one message apply by seq (ties by kind, role, text): 'delta' appends its text, 'edit' and
    'regenerate' replace what is there, 'delete' removes the message unless a later event brings it back.
    Other kinds, null included, count as 'delta'; null text is empty. The role is that of the last event
    that has one, else empty. Null conv_id, turn and part are values of their own and sort first.
    """
    log = F.array_sort(F.collect_list(F.struct(F.col("seq"), F.coalesce("kind", F.lit("delta")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    told = events.groupBy("conv_id", "turn", "part").agg(log.alias("log"))
    at = F.transform("log", lambda e, i: F.when(e["kind"].isin("edit", "regenerate", "delete"), i + 1).otherwise(0))
    told = told.withColumn("from", F.greatest(F.array_max(at), F.lit(1)))
    told = told.withColumn("rest", F.expr("slice(log, from, size(log))"))
    text = F.array_join(F.transform(F.filter("rest", lambda e: e["kind"] != "delete"), lambda e: e["text"]), "")
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r != "")
    gone = (F.size("rest") == 1) & (F.element_at("rest", 1)["kind"] == "delete")
    return told.filter(~gone).select("conv_id", "turn", "part", F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_mask.

    loss_mask is an array of spans (start, end) in code points of `formatted`, in order: the texts of
    loss_role alone, without their marks. Each turn is rendered and placed on its own row; the rows of a
    conversation meet only to become its one formatted text. Roles and texts are those of fold_events, which are never null: a message
    with a null one would be counted but not written. Empty texts are turns like others, a null conv_id is a conversation. An empty
    table gives no rows.
    """
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))
    m = messages.select("conv_id", "turn", "part", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    m = m.withColumn("segment", F.concat("head", "body", F.lit(CLOSE)))
    w = Window.partitionBy("conv_id").orderBy("turn", "part")
    start = F.sum(F.length("segment")).over(w) - F.length("segment") + F.length("head")
    m = m.select("conv_id", F.row_number().over(w).alias("at"), "segment", start.alias("start"), (start + F.length("body")).alias("end"), (F.col("role") == loss_role).alias("learn"))
    m = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "segment", "start", "end", "learn"))).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return m.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda t: t["segment"]), "").alias("formatted"), spans.alias("loss_mask"))


def turns_back(rendered: DataFrame) -> DataFrame:
    """One row per turn of what `render` gave, read from `formatted` and `loss_mask` alone: conv_id, at, role, text, learned.

    at counts turns from 0; learned is the unescaped text under the mask, null for turns that it leaves out.
    A turn is taken apart by itself, so the work grows with the text and not with turns times text. A null
    conv_id is a conversation; one without turns, or with a null text, gives no rows.
    """
    parts = F.split("formatted", CLOSE, -1)
    t = rendered.select("conv_id", "loss_mask", F.posexplode(F.slice(parts, 1, F.size(parts) - 1)).alias("at", "part"))
    before = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.select("conv_id", "at", "part", (F.sum(F.length("part") + len(CLOSE)).over(before) - F.length("part") - len(CLOSE)).alias("first"))
    spans = rendered.select("conv_id", F.explode("loss_mask").alias("m")).select("conv_id", F.col("m.start").alias("start"), F.col("m.end").alias("end"))
    # a span lies in the turn that ends next after it: spans and turns in one order, turns last at a place
    ends = t.select("conv_id", (F.col("first") + F.length("part")).alias("to"), F.lit(1).alias("turn"), "at", "part", "first", F.lit(None).cast("long").alias("start"))
    asked = spans.select("conv_id", F.col("end").alias("to"), F.lit(0).alias("turn"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("string").alias("part"), F.lit(None).cast("long").alias("first"), "start")
    so_far = Window.partitionBy("conv_id").orderBy("to", "turn")
    both = ends.unionByName(asked).withColumns({"from": F.lag("start").over(so_far), "until": F.lag("to").over(so_far)})
    t = both.filter("turn = 1")
    body = F.substr("part", F.lit(len(OPEN) + 1))
    cut = F.instr(body, "\n")
    under = F.when(F.col("from") >= F.col("first"), unescape(F.substr("part", (F.col("from") - F.col("first") + 1).cast("int"), (F.col("until") - F.col("from")).cast("int"))))
    return t.select("conv_id", "at", unescape_role(F.substr(body, F.lit(1), cut - 1)).alias("role"), unescape(F.substr(body, cut + 1)).alias("text"), under.alias("learned"))


def digests(rendered: DataFrame) -> DataFrame:
    """One row per conversation of what `render` gave: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back. A null conv_id is a conversation; one without turns has no row."""
    rows = turns_back(rendered).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "role", "text", "learned"))).alias("turns"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["learned"].isNotNull()), lambda t: t["learned"]), "")
    rows = rows.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), loss.alias("loss"))
    long = rendered.select(F.col("conv_id").alias("c"), F.length("formatted").cast("long").alias("formatted_chars"))
    return rows.join(long, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def turns_as_events(conversations: DataFrame) -> DataFrame:
    """A log with the columns of EVENTS, as a service that streams replies leaves it, of a table conv_id, turn, role, text.

    Each text comes in three deltas. Before them, turns of even number have a draft that a regeneration
    replaces, and others a delta that an edit replaces. Rows that share a turn stay apart.
    """
    w = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = conversations.select("conv_id", "turn", F.row_number().over(w).cast("long").alias("part"), "role", F.coalesce("text", F.lit("")).alias("text"))
    third = F.ceil(F.length("text") / 3).cast("int")
    piece = lambda i: F.substr("text", F.lit(1) + third * i, third)
    even = F.pmod(F.coalesce("turn", F.lit(0)), F.lit(2)) == 0
    event = lambda seq, kind, text: F.struct(F.lit(seq).cast("long").alias("seq"), kind.alias("kind"), text.alias("text"))
    first = F.when(even, F.lit("regenerate")).otherwise(F.lit("edit"))
    log = F.array(event(0, F.lit("delta"), F.lit("draft of ")), event(1, F.lit("delta"), piece(1)), event(2, first, piece(0)), event(3, F.lit("delta"), piece(1)), event(4, F.lit("delta"), piece(2)))
    return rows.select("conv_id", "turn", "part", "role", F.explode(log).alias("e")).select("conv_id", "turn", "part", "e.seq", "e.kind", "role", "e.text")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return digests(written(render(fold_events(turns_as_events(rows.unionByName(probe)))), "chats"))


_ESCAPED = r"regexp_replace({}, '([<\[])(\\*)(/?s>|/?INST\]|/?SYS>>|\|[A-Za-z0-9_]+\|>)', '\1\\\2\3', 'g')"
OP9_SQL = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(8 + length({_ESCAPED.format("replace(replace(role, '%', '%25'), chr(10), '%0A')")}) + length({_ESCAPED.format("text")}))::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""
