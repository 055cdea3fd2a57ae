"""Chat formatting: typed content parts flattened into one string per conversation.

Each message holds ordered parts of type text, image, audio or document.  A visitor written as Spark
expressions turns text parts into escaped text and the others into placeholders, and records which
attachment each placeholder stands for and how many tokens it will expand to.

Template of a turn:  <|turn|>ROLE\\nBODY<|end|>\\n
Control strings all begin with "<".  Inside roles and texts "%" becomes "%25" and "<" becomes "%3C" (and a newline
in a role "%0A"), so no text, nor two parts side by side, can forge a control string, and the escape can be undone.

Edge cases: null text, null parts, null parts of a list and null roles count as empty; an empty table gives an empty
result; repeated rows stay, ordered by (turn, role, text), with null turns first; messages without conv_id form one
conversation; a part of an unknown type is kept as a document placeholder; a conversation is one string, so it must fit
a row (2 GB) however long its texts are; columns other than those named are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PARTS = "array<struct<type:string,text:string,ref:string,tokens:int>>"
TURN, END = "<|turn|>", "<|end|>\n"
#: Tokens that a placeholder expands to where the part does not say.
EXPANSION = {"image": 576, "audio": 750, "document": 1024}


def escape(col: F.Column) -> F.Column:
    return F.replace(F.replace(col, F.lit("%"), F.lit("%25")), F.lit("<"), F.lit("%3C"))


def unescape(col: F.Column) -> F.Column:
    return F.replace(F.replace(col, F.lit("%3C"), F.lit("<")), F.lit("%25"), F.lit("%"))


def text_part(col: F.Column) -> F.Column:
    """A plain text as a list of one part."""
    return F.array(
        F.struct(
            F.lit("text").alias("type"),
            F.coalesce(col, F.lit("")).alias("text"),
            F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("int").alias("tokens"),
        )
    ).cast(PARTS)


def _kind(part: F.Column) -> F.Column:
    return F.when(part["type"].isin("text", "image", "audio"), part["type"]).otherwise(F.lit("document"))


def _render(part: F.Column) -> F.Column:
    return F.when(part["type"] == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(
        F.concat(F.lit("<|"), _kind(part), F.lit("|>"))
    )


def _expansion(part: F.Column) -> F.Column:
    known = F.coalesce(*[F.when(_kind(part) == kind, F.lit(n)) for kind, n in EXPANSION.items()])
    return F.coalesce(part["tokens"], known)


def format_chat(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans, attachments, expanded_tokens.

    messages has conv_id, turn, role and either text or parts (type PARTS).  loss_spans are
    (start, length) in code points of the bodies under the loss mask; attachments are in the order of
    their placeholders.
    """
    parts = F.col("parts").cast(PARTS) if "parts" in messages.columns else text_part(F.col("text"))
    role = F.coalesce(F.col("role"), F.lit(""))
    head = F.concat(F.lit(TURN), F.replace(escape(role), F.lit("\n"), F.lit("%0A")), F.lit("\n"))
    rows = messages.select(
        "conv_id", "turn", role.alias("role"), head.alias("head"), F.coalesce(parts, F.array().cast(PARTS)).alias("parts")
    )
    rows = rows.withColumn("parts", F.filter("parts", lambda p: p.isNotNull()))
    rows = rows.withColumn("body", F.array_join(F.transform("parts", _render), "")).select(
        "conv_id",
        "turn",
        "role",
        F.concat("head", "body", F.lit(END)).alias("piece"),
        F.length("head").alias("before"),
        F.length("body").alias("inside"),
        F.transform(
            F.filter("parts", lambda p: ~p["type"].eqNullSafe("text")),
            lambda p: F.struct(_kind(p).alias("type"), p["ref"].alias("ref"), _expansion(p).alias("tokens")),
        ).alias("attached"),
    )
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "piece")
    rows = rows.withColumn("at", F.sum(F.length("piece")).over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("piece"))
    turns = F.array_sort(F.collect_list(F.struct("at", "turn", "role", "piece", "before", "inside", "attached")))
    packed = rows.groupBy("conv_id").agg(turns.alias("turns"))
    return packed.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(
            F.filter("turns", lambda t: t["role"] == loss_role),
            lambda t: F.struct((t["at"] + t["before"]).cast("int").alias("start"), t["inside"].alias("length")),
        ).alias("loss_spans"),
        F.flatten(F.transform("turns", lambda t: t["attached"])).alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def parse_chat(formatted: F.Column) -> F.Column:
    """The turns of a formatted string: array of (role, text, parts).

    parts are (type, text) in order, type text for what lies between placeholders; text joins the texts of the parts.
    """
    turns = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda t: t != "")
    pieces = r"<\|(?:" + "|".join(EXPANSION) + r")\|>|[^<]+"

    def part(piece):
        kind = F.when(F.startswith(piece, F.lit("<")), F.substr(piece, F.lit(3), F.length(piece) - 4)).otherwise("text")
        return F.struct(kind.alias("type"), F.when(kind == "text", unescape(piece)).alias("text"))

    def read(turn):
        role = F.substring_index(F.substr(turn, F.lit(len(TURN) + 1)), "\n", 1)
        body = F.substr(turn, F.length(role) + F.lit(len(TURN) + 2))
        parts = F.transform(F.regexp_extract_all(body, F.lit(pieces), F.lit(0)), part)
        text = F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")
        return F.struct(unescape(F.replace(role, F.lit("%0A"), F.lit("\n"))).alias("role"), text.alias("text"), parts.alias("parts"))

    return F.transform(turns, read)


def masked_text(formatted: F.Column, spans: F.Column) -> F.Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + F.lit(1), s["length"]))), ""
    )
