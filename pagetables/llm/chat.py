"""Chat formatting: typed content parts to one marked text per conversation, and back.

Column expressions only. A turn becomes <|im_start|>role\\ncontent<|im_end|>\\n. In texts, each
"<|" gets a backslash between its two characters (and "<\\|" another one), so no text can
hold a control string; unescape() takes exactly one away.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetables.llm.common import only

START, END = "<|im_start|>", "<|im_end|>"

PART = "struct<type string, text string, ref string, width long, height long, seconds double, pages long>"

#: Tokens that a model sees in place of one attachment, by kind of part.
EXPANSION: Mapping[str, Callable[[Column], Column]] = {
    "image": lambda p: F.ceil(F.greatest(p["width"], F.lit(1)) / 28) * F.ceil(F.greatest(p["height"], F.lit(1)) / 28),
    "audio": lambda p: F.ceil(F.greatest(p["seconds"], F.lit(0.0)) * 25),
    "document": lambda p: F.greatest(p["pages"], F.lit(1)) * 512,
}


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def text_part(text: Column) -> Column:
    """A list of one text part, for tables that hold plain texts."""
    none = F.lit(None)
    return F.array(F.struct(
        F.lit("text").alias("type"), text.alias("text"), none.cast("string").alias("ref"), none.cast("long").alias("width"),
        none.cast("long").alias("height"), none.cast("double").alias("seconds"), none.cast("long").alias("pages")))


def visit(parts: Column, on_text: Callable[[Column], Column], on_attachment: Callable[[str, Column], Column]) -> Column:
    """One value per part, in order: on_attachment for the kinds of EXPANSION, else on_text."""
    def one(part: Column) -> Column:
        value = on_text(F.coalesce(part["text"], F.lit("")))
        for kind in EXPANSION:
            value = F.when(part["type"] == kind, on_attachment(kind, part)).otherwise(value)
        return value
    return F.transform(parts, one)


def flatten_parts(parts: Column) -> Column:
    """Content of a turn: escaped texts and placeholders like <|image|> in their order."""
    return F.array_join(visit(parts, escape, lambda kind, _: F.lit(f"<|{kind}|>")), "")


def attachments(parts: Column) -> Column:
    """Kind, reference and expanded tokens of each placeholder, in order. Unknown sizes count as
    the smallest."""
    shape = "struct<kind string, ref string, tokens long>"
    nothing = F.lit(None).cast(shape)
    return F.filter(visit(parts, lambda _: nothing, lambda kind, p: F.struct(
        F.lit(kind).alias("kind"), p["ref"].alias("ref"), F.coalesce(EXPANSION[kind](p), F.lit(1)).cast("long").alias("tokens"),
    ).cast(shape)), lambda a: a.isNotNull())


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                parts_col: str | None = None, text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation, with one Exchange.

    Takes a row per turn, with either an array of PART in parts_col or a text in text_col.
    Returns conv_col, n_turns, formatted, loss_spans (start and end in code points of
    what the loss covers: the contents of loss_role), attachments (in the order of their
    placeholders, with n, the place of their turn) and expanded_tokens, their sum.

    Null roles, texts and parts are empty. A null conv_col is a conversation of its own. Turns
    of equal number stand in the order of role and content; repeated rows are repeated turns.
    An empty table gives no rows.
    """
    parts = text_part(F.col(f"`{text_col}`")) if parts_col is None else F.coalesce(
        F.col(f"`{parts_col}`"), F.array().cast(f"array<{PART}>"))
    rows = only(turns, [conv_col, turn_col, role_col, parts_col or text_col]).select(
        F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"), parts.alias("parts"))
    rows = rows.select("conv", "turn", "role", flatten_parts(F.col("parts")).alias("content"), attachments(F.col("parts")).alias("files"))
    rows = rows.withColumn("head", F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n")))
    rows = rows.withColumn("chars", F.char_length("head") + F.char_length("content") + len(END) + 1)
    order = Window.partitionBy("conv").orderBy("turn", "role", "content")
    rows = rows.withColumns({
        "n": F.row_number().over(order),
        "end": F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    })
    each = F.sort_array(F.collect_list(F.struct(
        "n", F.concat("head", "content", F.lit(END + "\n")).alias("marked"), (F.col("role") == loss_role).alias("loss"),
        (F.col("end") - len(END) - 1 - F.char_length("content")).alias("from"), (F.col("end") - len(END) - 1).alias("to"),
        "files")))
    grouped = rows.groupBy("conv").agg(each.alias("each"))
    spans = F.transform(F.filter("each", lambda t: t["loss"]), lambda t: F.struct(t["from"].alias("start"), t["to"].alias("end")))
    files = F.flatten(F.transform("each", lambda t: F.transform(t["files"], lambda a: F.struct(
        t["n"].alias("n"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    result = grouped.select(
        F.col("conv").alias(conv_col), F.size("each").cast("long").alias("n_turns"),
        F.array_join(F.transform("each", lambda t: t["marked"]), "").alias("formatted"),
        spans.alias("loss_spans"), files.alias("attachments"))
    return result.withColumn("expanded_tokens", F.aggregate(
        "attachments", F.lit(0).cast("long"), lambda total, a: total + a["tokens"]))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: role and content, unescaped."""
    def one(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        body = F.substr(piece, F.char_length(role) + 2, F.char_length(piece) - F.char_length(role) - 2 - len(END))
        return F.struct(_unescape_role(role).alias("role"), unescape(body).alias("content"))
    pieces = F.split(formatted, r"<\|im_start\|>")
    return F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), one)


def read_loss(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, one span after the other."""
    return F.array_join(F.transform(loss_spans, lambda s: unescape(F.substr(
        formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
