r"""Chat formatting of typed content parts, in DataFrame functions only.

A visitor walks each message's parts in order. A text part is escaped; an image, audio
or document part leaves a placeholder and records its reference and the number of tokens
it expands to. A turn reads ``### role: body</turn>`` and a line feed.

Escaping is reversible: ``\`` becomes ``\b``, ``#`` becomes ``\h``, ``<`` becomes ``\l``
(and ``:`` becomes ``\c`` in roles), so neither turn marks nor placeholders can occur in
escaped text, and reading back is plain splitting in linear time.

The loss mask lists the spans of assistant text in the formatted string, in code points:
the turn, where the turn starts, where the span starts and where it stops.

Defined results. Null text, role or parts: empty. Turns sort by turn, role, content, nulls
first; repeated rows stay. A null conversation id is one conversation. An unknown part
type leaves a placeholder like an attachment. An empty table gives no rows. One
conversation makes one output cell, so its length is bounded by what a cell can hold;
everything before that last step runs row by row and spills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .secrets import let, running_sums

OPEN, AFTER_ROLE, CLOSE = "### ", ": ", "</turn>\n"
#: Fixed values of the template: what is escaped, and as what. The escape sign is first.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
LEARNED_ROLE = "assistant"


def escape(text: Column, pairs: tuple = ESCAPES) -> Column:
    for raw, safe in pairs:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column, pairs: tuple = ESCAPES) -> Column:
    for raw, safe in reversed(pairs):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def _parts(df: DataFrame, content_col: str) -> Column:
    """Content as an array of (type, text, ref, tokens); a string is one text part."""
    content = F.col(content_col)
    if isinstance(df.schema[content_col].dataType, T.ArrayType):
        return F.coalesce(
            F.transform(
                content,
                lambda p: F.struct(
                    F.coalesce(p["type"], F.lit("text")).alias("type"),
                    F.coalesce(p["text"], F.lit("")).alias("text"),
                    p["ref"].alias("ref"),
                    F.coalesce(p["tokens"].cast("long"), F.lit(0).cast("long")).alias("tokens"),
                ),
            ),
            F.array().cast("array<struct<type:string,text:string,ref:string,tokens:bigint>>"),
        )
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(content, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("tokens")))


def _visit(part: Column) -> Column:
    return F.when(part["type"] == "text", escape(part["text"])).otherwise(F.concat(F.lit("<|"), escape(part["type"]), F.lit("|>")))


def format_chat(
    messages: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    content_col: str = "text",
) -> DataFrame:
    """One row per conversation: id, ``formatted``, ``loss``, ``attachments``, ``n_turns``, ``expanded_tokens``.

    ``content_col`` is a string, or an array of structs (type, text, ref, tokens). Other
    columns are left aside. ``expanded_tokens`` sums what the attachments expand to.
    """
    role = F.coalesce(F.col(role_col), F.lit(""))
    turns = messages.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("t"), role.alias("r"), _parts(messages, content_col).alias("p"))
    turns = turns.select("*", F.transform("p", lambda p: _visit(p)).alias("v"), F.concat(F.lit(OPEN), escape(F.col("r"), ROLE_ESCAPES), F.lit(AFTER_ROLE)).alias("head"))
    turns = turns.withColumn("piece", F.concat("head", F.array_join("v", ""), F.lit(CLOSE)))
    before = Window.partitionBy("c").orderBy(F.asc_nulls_first("t"), "r", "p")
    turns = turns.select(
        "c", "r", "p", "v", "head", "piece",
        (F.row_number().over(before) - 1).cast("long").alias("n"),
        (F.sum(F.length("piece").cast("long")).over(before.rowsBetween(Window.unboundedPreceding, 0)) - F.length("piece")).alias("at"),
    )
    body_at = F.col("at") + F.length("head")
    # Texts that follow each other directly are one span: no prefix sums over parts for plain text.
    all_text = ~F.exists("p", lambda p: p["type"] != "text")
    whole = F.array(_span(F.col("n"), F.col("at"), body_at, F.col("at") + F.length("piece") - len(CLOSE)))
    sizes = F.transform("v", lambda x: F.length(x).cast("long"))
    by_part = let(
        running_sums(sizes),
        lambda stops: F.filter(
            F.transform(
                "v",
                lambda x, i: F.when(F.col("p")[i]["type"] == "text", _span(F.col("n"), F.col("at"), body_at + stops[i] - F.length(x), body_at + stops[i])),
            ),
            lambda s: s.isNotNull(),
        ),
    )
    nothing = F.array().cast("array<struct<turn:bigint,turn_start:bigint,start:bigint,stop:bigint>>")
    attached = F.transform(
        F.filter("p", lambda p: p["type"] != "text"),
        lambda p: F.struct(F.col("n").alias("turn"), p["type"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens")),
    )
    turns = turns.select(
        "c", "n", "piece",
        F.when(F.col("r") != LEARNED_ROLE, nothing).when(all_text, whole).otherwise(by_part).alias("loss"),
        attached.alias("attached"),
    )
    got = turns.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("n", "piece", "loss", "attached"))).alias("turns"))
    return got.select(
        F.col("c").alias(conv_col),
        F.array_join(F.col("turns.piece"), "").alias("formatted"),
        F.flatten("turns.loss").alias("loss"),
        F.flatten("turns.attached").alias("attachments"),
        F.size("turns").cast("long").alias("n_turns"),
        F.aggregate(F.flatten("turns.attached"), F.lit(0).cast("long"), lambda s, x: s + x["tokens"]).alias("expanded_tokens"),
    )


def _span(turn: Column, turn_start: Column, start: Column, stop: Column) -> Column:
    return F.struct(turn.alias("turn"), turn_start.cast("long").alias("turn_start"), start.cast("long").alias("start"), stop.cast("long").alias("stop"))


def read_turns(formatted: Column) -> Column:
    """(role, text) of each turn of a formatted string; placeholders stay in the text."""
    pieces = F.filter(F.split(formatted, CLOSE, -1), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), AFTER_ROLE, 1), ROLE_ESCAPES).alias("role"),
            unescape(F.substr(p, F.length(F.substring_index(p, AFTER_ROLE, 1)) + len(AFTER_ROLE) + 1)).alias("text"),
        ),
    )


def read_loss(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped, span by span."""
    return F.transform(
        F.transform(F.array(F.split(formatted, CLOSE, -1)), lambda pieces: F.transform(loss, lambda s: F.substr(pieces[s["turn"].cast("int")], (s["start"] - s["turn_start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))))[0],
        lambda t: unescape(t),
    )
