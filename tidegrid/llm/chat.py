r"""Chat formatting with a grammar round trip, by DataFrame functions only.

The grammar of the output::

    chat := "<s>" turn*
    turn := "[INST] " role " [/INST]" text "</s>"

Roles and texts hold no bare control string.  Where they do, a backslash is put after its first character, and one more where
there are some already (``</s>`` is written ``<\/s>``, and ``<\/s>`` is written ``<\\/s>``); reading takes one away again.
Conversations are first rendered as they are; the text is parsed again and compared with the source, and where the two differ,
or the parser meets a bare control string, the conflicting content is escaped and the result parsed and compared once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Control strings, as first character and rest.
_RESTS = [r"s>", r"/s>", r"INST\]", r"/INST\]", r"<SYS>>", r"</SYS>>", r"\|im_start\|>", r"\|im_end\|>", r"\|endoftext\|>"]
_REST = "(" + "|".join(_RESTS) + ")"
BARE = r"[<\[]" + _REST
#: Turns of a block of `loss_mask`.
BLOCK_TURNS = 256
TURN = "(?s)^\\[INST\\] (.*?) \\[/INST\\](.*)$"


def escape(x: Column) -> Column:
    return F.regexp_replace(x, r"([<\[])(\\*)" + _REST, r"$1$2\\$3")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"([<\[])\\(\\*)" + _REST, "$1$2$3")


def _render(turns: Column, how=lambda x: x) -> Column:
    return F.concat(F.lit("<s>"), F.concat_ws("", F.transform(turns, lambda t: F.concat(F.lit("[INST] "), how(t["role"]), F.lit(" [/INST]"), how(t["text"]), F.lit("</s>")))))


def _parts(chat: Column) -> Column:
    """The turns as they stand in the output; null where the output isn't of the grammar."""
    body = F.split(F.substring(chat, 4, 2147483647), r"\Q</s>\E", -1)
    turns = F.slice(body, 1, F.size(body) - 1)
    fine = chat.startswith("<s>") & (F.element_at(body, -1) == "") & F.forall(turns, lambda x: x.rlike(TURN))
    return F.when(fine, F.transform(turns, lambda x: F.struct(F.regexp_extract(x, TURN, 1).alias("role"), F.regexp_extract(x, TURN, 2).alias("text"))))


def parse(chat: Column) -> Column:
    """array<struct<role, text>> of an output; null if it isn't of the grammar or holds a bare control string."""
    parts = _parts(chat)
    bare = F.exists(parts, lambda t: t["role"].rlike(BARE) | t["text"].rlike(BARE))
    return F.when(~bare, F.transform(parts, lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text"))))


def loss_mask(chat: Column, assistant: str) -> Column:
    """array<struct<start, length>>: where in the output the assistant's texts stand, in code points from 0.

    Turns are measured in blocks, first each block's length and then the turns inside, so no array grows turn by turn over the
    whole of a long conversation.
    """
    parts = _parts(chat)
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0)), F.lit(BLOCK_TURNS)), lambda k: F.slice(parts, k + 1, BLOCK_TURNS))
    width = lambda t: F.length(t["role"]) + F.length(t["text"]) + 19

    def next_start(acc, block):
        end = acc["at"] + F.aggregate(block, F.lit(0), lambda n, t: n + width(t))
        return F.struct(end.alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts"))

    def step(acc, t):
        start = acc["at"] + F.length(t["role"]) + 15
        span = F.struct(start.alias("start"), F.length(t["text"]).alias("length"))
        spans = F.when(unescape(t["role"]) == assistant, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + width(t)).alias("at"), spans.alias("spans"))

    starts = F.aggregate(blocks, F.struct(F.lit(3).alias("at"), F.array().cast("array<int>").alias("starts")), next_start, lambda acc: acc["starts"])
    none = F.array().cast("array<struct<start:int,length:int>>")
    return F.flatten(F.zip_with(blocks, starts, lambda block, at: F.aggregate(block, F.struct(at.alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])))


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", assistant: str = "assistant") -> DataFrame:
    """(conv_id, formatted, mask, escaped, round_trip): one row for each conversation, with its turns in order.

    Null roles and texts are empty; rows without a turn number come first; ties in it go by role, then text, and repeated rows
    are turns of their own.  Rows without a conversation id make one conversation with a null id.  Other columns are ignored;
    an empty table gives no rows.  A conversation is one output text, so its turns meet in one task.
    """
    one = F.struct(rows[turn_col].cast("long").alias("turn"), F.coalesce(rows[role_col], F.lit("")).alias("role"), F.coalesce(rows[text_col], F.lit("")).alias("text"))
    chats = rows.select(rows[conv_col].cast("long").alias("conv_id"), one.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    chats = chats.select("conv_id", F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    same = lambda c: F.coalesce(parse(F.col(c)) == F.col("turns"), F.lit(False))
    chats = chats.withColumn("plain", _render(F.col("turns"))).withColumn("fits", same("plain"))
    chats = chats.withColumn("formatted", F.when(F.col("fits"), F.col("plain")).otherwise(_render(F.col("turns"), escape)))
    return chats.select("conv_id", "formatted", loss_mask(F.col("formatted"), assistant).alias("mask"), (~F.col("fits")).alias("escaped"), (F.col("fits") | same("formatted")).alias("round_trip"))


def read_chats(chats: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, loss string): the turns, and all text under the mask, read from the output."""
    loss = F.concat_ws("", F.transform("mask", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))))
    return chats.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), loss.alias("loss"))
