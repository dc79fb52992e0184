r"""Chat formatting with Spark expressions alone.

A conversation's rows are collected as structs, sorted by (turn, role, text), and cut into blocks where the role changes.
Each block becomes one marked turn; the texts of a block are put together with a part mark:

    <turn ROLE>\nTEXT\n<part>\nTEXT\n</turn>\n

A role is URL-encoded. A control string inside a text (`<turn `, `<part>` or `</turn>`) gets one backslash before it. A
real mark stands after a line feed, or at the start, and never after a backslash, so the escape is undone by taking one
backslash away, whatever backslashes the text has of its own.

`loss_spans` (start from 0, length, in code points) cover the assistant's texts, without marks. Everything is linear in a
conversation's length but for the list of spans, one for each text of the assistant.

Nulls: a null text or role counts as empty; null turns sort first; rows with a null conv_id make one conversation of
their own. Repeated rows are turns like any other. An empty table gives no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = r"(<turn |<part>|</turn>)"
PART, END = "\n<part>\n", "\n</turn>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\" + CONTROL, "$1")


def opening(role: Column) -> Column:
    return F.concat(F.lit("<turn "), F.url_encode(role), F.lit(">\n"))


def format_chats(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """turns (conv_id, turn, role, text) -> conv_id, formatted, loss_spans array<struct<start: long, length: long>>."""
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sorted_ = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))  # by the texts as they are: escaping comes after
    rows = rows.groupBy("conv_id").agg(F.transform(sorted_, lambda t: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), escaped(t["text"]).alias("text"))).alias("turns"))
    starts = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    rows = rows.withColumn("starts", starts)
    upto = lambda k: F.coalesce(F.get("starts", k + 1), F.size("turns"))
    block = lambda s, k: F.struct(F.get("turns", s)["role"].alias("role"), F.transform(F.slice("turns", s + 1, upto(k) - s), lambda t: t["text"]).alias("texts"))
    rows = rows.select("conv_id", F.transform("starts", block).alias("blocks"))
    marked = F.transform("blocks", lambda b: F.struct(F.length(opening(b["role"])).alias("head"), F.concat(opening(b["role"]), F.array_join(b["texts"], PART), F.lit(END)).alias("body"), (b["role"] == trained_role).alias("trained"), F.transform(b["texts"], F.length).alias("sizes")))
    rows = rows.select("conv_id", marked.alias("marked"))
    # Running positions: over the blocks, and over the texts of a block that counts.
    long, none = lambda x: F.lit(x).cast("long"), F.array().cast("array<struct<start:long,length:long>>")
    span = lambda at, n: F.struct(at.alias("start"), n.cast("long").alias("length"))
    texts = lambda b, at: F.aggregate(b["sizes"], F.struct((at + b["head"]).alias("at"), none.alias("spans")), lambda a, n: F.struct((a["at"] + n + len(PART)).alias("at"), F.array_append(a["spans"], span(a["at"], n)).alias("spans")))["spans"]
    walk = F.aggregate("marked", F.struct(long(0).alias("at"), none.alias("spans")), lambda a, b: F.struct((a["at"] + F.length(b["body"])).alias("at"), F.when(b["trained"], F.concat(a["spans"], texts(b, a["at"]))).otherwise(a["spans"]).alias("spans")))
    return rows.select("conv_id", F.array_join(F.transform("marked", lambda b: b["body"]), "").alias("formatted"), walk["spans"].alias("loss_spans"))


def read_chats(chats: DataFrame) -> DataFrame:
    """The output of format_chats read back: conv_id, turns array<struct<role, text>>, loss_texts array<string>."""
    pieces = F.filter(F.split("formatted", END, -1), lambda p: p != "")
    head = lambda p: F.substring_index(p, ">\n", 1)
    role = lambda p: F.url_decode(F.substr(head(p), F.lit(len("<turn ") + 1)))
    parts = lambda p: F.split(F.substr(p, F.length(head(p)) + 3), PART, -1)
    turns = F.flatten(F.transform(pieces, lambda p: F.transform(parts(p), lambda t: F.struct(role(p).alias("role"), unescaped(t).alias("text")))))
    loss = F.transform("loss_spans", lambda s: unescaped(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return chats.select("conv_id", turns.alias("turns"), loss.alias("loss_texts"), "formatted", "loss_spans")
