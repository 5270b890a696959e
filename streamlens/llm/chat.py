"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role are
merged into a block by array functions; blocks become segments of text, each with a flag that says
whether it counts for the loss. The formatted text is the segments joined:

    <|im_start|>role\\ntext<|im_sep|>text of the next turn of the same role<|im_end|>\\n

Inside roles and texts ``&`` becomes ``&amp;`` and ``<|`` becomes ``&lt;|``, and in roles a line
end becomes ``&#10;``, so no text can hold a control string and all is read back as it was.
``read_chat`` splits the formatted text again.

A conversation is one row of the output, so its turns meet in one task; Spark's limit of 2 GB a
row holds. Conversations themselves are spread over all tasks.

Defined results: null roles and texts are empty. Turns of the same number (also repeated rows) are
ordered by role and text; a null turn comes first. Rows with a null conv_id form one conversation.
An empty table gives an empty table. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamlens.llm.common import let, stored

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def _blocks(turns: Column) -> Column:
    """Adjacent turns of one role as one struct of the role and its texts."""

    def merged(t: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(t) - 1),
            lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, i - 1)["role"]),
        )
        return let(
            starts,
            lambda s: F.transform(
                s,
                lambda a, k: F.struct(
                    F.get(t, a)["role"].alias("role"),
                    F.transform(
                        F.slice(t, a + 1, F.coalesce(F.get(s, k + 1), F.size(t)) - a), lambda x: x["text"]
                    ).alias("texts"),
                ),
            ),
        )

    return let(turns, merged)


def _segment(text: Column, train: Column) -> Column:
    return F.struct(text.alias("text"), train.alias("train"))


def _segments(block: Column) -> Column:
    role = F.replace(escape(block["role"]), F.lit("\n"), F.lit("&#10;"))
    train = block["role"] == LOSS_ROLE
    texts = F.transform(
        block["texts"],
        lambda text, i: F.array(
            _segment(
                F.when(i == 0, F.concat(F.lit(START), role, F.lit("\n"))).otherwise(F.lit(SEP)), F.lit(False)
            ),
            _segment(escape(text), train),
        ),
    )
    return F.concat(F.flatten(texts), F.array(_segment(F.lit(END + "\n"), F.lit(False))))


def format_chat(conversations: DataFrame) -> DataFrame:
    """conv_id and its ``segments``: the formatted text in parts, and whether each is trained on."""
    turns = conversations.select(
        "conv_id",
        F.struct(
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return grouped.select("conv_id", _blocks(F.col("turns")).alias("blocks")).select(
        "conv_id", F.flatten(F.transform("blocks", _segments)).alias("segments")
    )


def stored_chat(chats: DataFrame) -> DataFrame:
    """Formatted conversations as a written table."""
    return stored(chats, "chats")


def formatted(segments: Column | str) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def _quoted(mark: str) -> str:
    return mark.replace("|", "\\|")


def read_chat(text: Column) -> Column:
    """The turns of a formatted text, as structs of role and text."""

    def turns(block: Column) -> Column:
        inner = F.substr(block, F.lit(len(START) + 1))
        return let(
            F.substring_index(inner, "\n", 1),
            lambda role: F.transform(
                F.split(F.substr(inner, F.length(role) + 2), _quoted(SEP)),
                lambda t: F.struct(
                    unescape(F.replace(role, F.lit("&#10;"), F.lit("\n"))).alias("role"), unescape(t).alias("text")
                ),
            ),
        )

    blocks = F.filter(F.split(text, _quoted(END) + "\n"), lambda b: F.startswith(b, F.lit(START)))
    return F.flatten(F.transform(blocks, turns))


def chat_report(chats: DataFrame) -> DataFrame:
    """Digests of what is read back from formatted conversations."""
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["train"]), lambda s: unescape(s["text"])), "")
    read = chats.select("conv_id", formatted("segments").alias("text"), loss.alias("loss"))
    parsed = read.select("conv_id", "text", "loss", read_chat(F.col("text")).alias("turns"))
    spoken = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("text").cast("long").alias("formatted_chars"),
    )
