"""Chat formatting in Spark expressions: turns to one marked-up text with a loss mask, and back.

A conversation's turns are collected as structs, sorted by (turn, role, text), and adjacent turns of
one role merged into a block:

    <|role|>user<|text|>first text<|turn|>second text<|end|>

Inside texts and roles a backslash is doubled and every control string gets one after its first
character, so no control string is left in them and `unescaped` gives the exact text back. The mask
holds the places of the assistant's escaped texts, marks between them left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLE, TEXT, TURN, END = "<|role|>", "<|text|>", "<|turn|>", "<|end|>"

#: Control strings beside the template's own that texts must not smuggle in: `<|`, `<s>`, `</s>`, `[INST]`, `[/INST]`.
CONTROL = r"(<)(\||/?s>)|(\[)(/?INST\])"

LEARNT = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1$3\\$2$4")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _quoted(mark: str) -> str:
    return mark.replace("|", r"\|")


def formatted(turns: DataFrame, learnt: str = LEARNT) -> DataFrame:
    """(conv_id, formatted, mask) for rows (conv_id, turn, role, text); mask: array of (start, length) in code points.

    Null texts and roles count as empty; a null turn comes first; equal rows are turns of their own;
    rows without a conv_id make one conversation. Other columns are ignored.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    t = F.col("t")
    changes = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, F.greatest(i - 1, F.lit(0)))["role"]))
    starts = sorted_turns.select("conv_id", "t", changes.alias("s"))
    merged = starts.select(
        "conv_id",
        F.transform(
            "s",
            lambda s, k: F.struct(
                escaped(F.get(t, s)["role"]).alias("role"),
                (F.get(t, s)["role"] == learnt).alias("learnt"),
                F.transform(F.slice(t, s + 1, F.coalesce(F.get(F.col("s"), k + 1), F.size(t)) - s), lambda x: escaped(x["text"])).alias("texts"),
            ),
        ).alias("blocks"),
    )
    text = F.array_join(F.transform("blocks", lambda b: F.concat(F.lit(ROLE), b["role"], F.lit(TEXT), F.array_join(b["texts"], TURN), F.lit(END))), "")
    head = len(ROLE) + len(TEXT)
    pieces = F.flatten(
        F.transform(
            "blocks",
            lambda b, k: F.transform(
                b["texts"],
                lambda x, i: F.struct(
                    F.when(i > 0, len(TURN)).otherwise(F.length(b["role"]) + head + F.when(k > 0, len(END)).otherwise(0)).alias("before"),
                    F.length(x).alias("n"),
                    b["learnt"].alias("learnt"),
                ),
            ),
        )
    )
    none = F.array().cast("array<struct<start:int,n:int>>")
    mask = F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("at"), none.alias("mask")),
        lambda a, p: F.struct(
            (a["at"] + p["before"] + p["n"]).alias("at"),
            F.when(p["learnt"], F.concat(a["mask"], F.array(F.struct((a["at"] + p["before"]).alias("start"), p["n"].alias("n"))))).otherwise(a["mask"]).alias("mask"),
        ),
        lambda a: a["mask"],
    )
    return merged.select("conv_id", text.alias("formatted"), mask.alias("mask"))


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, turns, loss, formatted_chars): the turns as (role, text) and the text under the mask, from the formatted text alone."""
    blocks = F.filter(F.split("formatted", _quoted(END)), lambda b: b != "")
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.array(F.split(F.substr(b, F.lit(len(ROLE) + 1)), _quoted(TEXT), 2)),
                lambda p: F.transform(
                    F.split(F.get(p, F.lit(1)), _quoted(TURN)), lambda x: F.struct(unescaped(F.get(p, F.lit(0))).alias("role"), unescaped(x).alias("text"))
                ),
            )[0],
        )
    )
    loss = F.array_join(F.transform("mask", lambda m: unescaped(F.substr("formatted", m["start"] + 1, m["n"]))), "")
    return chats.select("conv_id", turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))


def digests(chats: DataFrame) -> DataFrame:
    back = read_back(chats)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
