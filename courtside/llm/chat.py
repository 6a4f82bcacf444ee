"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is a list of parts (text, image, audio, document). A visitor, one expression per kind of part, flattens
them in order: text is escaped, the others become a placeholder and an entry in the list of attachments with the number of
tokens that the placeholder stands for. The template puts each turn between control strings:

    <|turn|>role<|says|>content<|end|>

Control strings inside roles and texts are broken up by a backslash after their first character, and backslashes are doubled, so that
what is marked up can be read back and no text can open or close a turn. The strings of other common
templates (</s>, <s>, [INST], [/INST], <<SYS>>, <</SYS>>) are broken up likewise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
# What control strings begin with, here and in other templates; the first character is parted from the rest.
_CONTROL = r"(?:\\|<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\]))"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
PARTS = f"array<{PART}>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, f"({_CONTROL})", r"$1\\")


def unescaped(text: Column) -> Column:
    """Undo ``escaped``: the backslash after the first character of a control string goes, a doubled one becomes single."""
    return F.regexp_replace(text, r"(?s)(\\|<|\[)\\", "$1")


# ---- parts -----------------------------------------------------------------------------------------------

TILE, TILE_TOKENS, IMAGE_TOKENS = 512, 170, 85       # an image: one summary and a number per tile
AUDIO_TOKENS, PAGE_TOKENS = 25, 300                  # per second begun, per page


def expanded_tokens(part: Column) -> Column:
    """Tokens an attachment stands for; unknown sizes count as one tile, second or page."""
    tiles = F.ceil(F.greatest(F.coalesce(part.width, F.lit(1)), F.lit(1)) / TILE) * F.ceil(F.greatest(F.coalesce(part.height, F.lit(1)), F.lit(1)) / TILE)
    return (F.when(part.kind == "image", IMAGE_TOKENS + TILE_TOKENS * tiles)
            .when(part.kind == "audio", AUDIO_TOKENS * F.ceil(F.greatest(F.coalesce(part.seconds, F.lit(1.0)), F.lit(1.0))))
            .when(part.kind == "document", PAGE_TOKENS * F.greatest(F.coalesce(part.pages, F.lit(1)), F.lit(1)))
            .otherwise(0).cast("bigint"))


def visit(part: Column) -> Column:
    """What a part looks like in the formatted text. Unknown kinds are shown as their text."""
    return (F.when(part.kind == "image", F.lit("<|image|>")).when(part.kind == "audio", F.lit("<|audio|>"))
            .when(part.kind == "document", F.lit("<|document|>")).otherwise(escaped(F.coalesce(part.text, F.lit("")))))


def is_attachment(part: Column) -> Column:
    return F.coalesce(part.kind.isin("image", "audio", "document"), F.lit(False))


def text_part(text: Column) -> Column:
    """A content list of one text part; null is the empty text."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), *[
        F.lit(None).cast(kind).alias(name) for name, kind in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]))


# ---- conversations ---------------------------------------------------------------------------------------

def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts",
                 loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv, formatted, loss (spans of formatted, in characters), attachments, n_turns, n_tokens_attached.

    ``parts`` is an array of PART. Turns go by number, ties by role and then content, nulls first; repeated rows stay. A null role is the
    empty one, a null list of parts and a null part are empty. Rows without a conversation id form one conversation. Places in
    the formatted text come from running sums over a conversation's turns, which Spark sorts and spills; only
    the finished conversation is one row. The loss spans cover the contents of ``loss_role``.
    """
    from pyspark.sql import Window
    content = F.array_join(F.transform(F.col("parts"), visit), "")
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                        F.coalesce(F.filter(F.col(parts).cast(PARTS), lambda p: p.isNotNull()), F.array().cast(PARTS)).alias("parts"))
    rows = rows.withColumn("head", F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(SAYS))).withColumn("body", content)
    rows = rows.withColumn("size", F.char_length("head") + F.char_length("body") + len(END))
    order = Window.partitionBy("conv").orderBy("turn", "role", "body")
    rows = (rows.withColumn("number", F.row_number().over(order))
            .withColumn("begin", F.coalesce(F.sum(F.col("size").cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    start = F.col("begin") + F.char_length("head")
    span = F.when(F.col("role") == loss_role, F.struct(start.alias("start"), (start + F.char_length("body")).alias("stop")))
    attached = F.transform(F.filter("parts", is_attachment), lambda p, k: F.struct(
        F.col("number").alias("turn"), k.alias("place"), p.kind.alias("kind"), p.ref.alias("ref"), expanded_tokens(p).alias("tokens")))
    made = rows.select("conv", "number", F.concat("head", "body", F.lit(END)).alias("piece"), span.alias("span"), attached.alias("attached"))
    whole = made.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("number", "piece", "span", "attached"))).alias("t"))
    out = whole.select(
        F.col("conv").alias(conv), F.array_join(F.col("t.piece"), "").alias("formatted"),
        F.filter(F.col("t.span"), lambda s: s.isNotNull()).alias("loss"), F.flatten(F.col("t.attached")).alias("attachments"),
        F.size("t").cast("bigint").alias("n_turns"))
    return out.withColumn("n_tokens_attached", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda n, a: n + a.tokens))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text as (role, text), unescaped."""
    pieces = F.filter(F.split(formatted, r"<\|turn\|>"), lambda p: p != "")
    def one(p):
        return F.struct(unescaped(F.substring_index(p, SAYS, 1)).alias("role"),
                        unescaped(F.regexp_replace(p, r"(?s)^.*?<\|says\|>|<\|end\|>$", "")).alias("text"))
    return F.transform(pieces, one)


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substr(formatted, (s.start + 1).cast("int"), (s.stop - s.start).cast("int")))), "")
