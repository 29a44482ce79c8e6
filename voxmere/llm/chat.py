"""Chat formatting in Spark expressions: turns are sorted, merged where neighbours share a role, and concatenated.

Template: `<|im_start|>` role newline text, further texts of the same role each after `<|im_sep|>`, `<|im_end|>` newline.
In roles and texts a backslash is doubled and `<|` becomes `<\\|`, so no control string can stand inside a text and every
text reads back exactly; a newline in a role becomes `<|nl|>`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SEP, CLOSE, LINE = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n", "<|nl|>"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, segments, formatted): one row for each conversation.

    segments is the output in pieces, array<struct<text, learned>>; learned marks what the loss is taken over, the texts
    of the assistant. formatted is all segments in order. Turns go by turn number, then role, then text; a null turn goes
    first, a null role or text counts as empty, repeated rows are turns of their own, and rows with a null conversation
    id are one conversation. A conversation is one value of the result, so its turns meet in one row.
    """
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    roles = sorted_turns.withColumn("roles", F.col("turns.role")).withColumn("n", F.size("turns"))
    placed = roles.withColumn(
        "placed",
        F.zip_with(
            "turns",
            F.zip_with(
                F.concat(F.array(F.lit(None).cast("string")), F.slice("roles", 1, F.col("n") - 1)),
                F.concat(F.slice("roles", 2, F.col("n")), F.array(F.lit(None).cast("string"))),
                lambda a, b: F.struct(a.alias("before"), b.alias("after")),
            ),
            lambda t, r: F.struct(t["role"].alias("role"), t["text"].alias("text"), (~t["role"].eqNullSafe(r["before"])).alias("opens"), (~t["role"].eqNullSafe(r["after"])).alias("closes")),
        ),
    )

    def pieces(t: Column) -> Column:
        name = F.replace(escape(t["role"]), F.lit("\n"), F.lit(LINE))
        head = F.when(t["opens"], F.concat(F.lit(OPEN), name, F.lit("\n"))).otherwise(F.lit(SEP))
        plain = lambda text: F.struct(text.alias("text"), F.lit(False).alias("learned"))
        body = F.struct(escape(t["text"]).alias("text"), (t["role"] == LEARNED).alias("learned"))
        return F.array(plain(head), body, plain(F.when(t["closes"], F.lit(CLOSE)).otherwise(F.lit(""))))

    segments = placed.select("conv_id", F.flatten(F.transform("placed", pieces)).alias("segments"))
    return segments.withColumn("formatted", F.array_join("segments.text", ""))


def read_chats(chats: DataFrame) -> DataFrame:
    """(conv_id, blocks, turns): what the formatted strings say; turns is array<struct<role, text>>, blocks their number
    after merging."""
    parts = F.split("formatted", "\\Q" + CLOSE + "\\E")
    blocks = F.filter(parts, lambda b: b != F.lit(""))

    def turns_of(block: Column) -> Column:
        role = unescape(F.replace(F.substring_index(F.substr(block, F.lit(len(OPEN) + 1)), "\n", 1), F.lit(LINE), F.lit("\n")))
        texts = F.split(F.regexp_replace(block, "(?s)\\A[^\\n]*\\n", ""), "\\Q" + SEP + "\\E")
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return chats.select("conv_id", F.size(blocks).cast("long").alias("blocks"), F.flatten(F.transform(blocks, turns_of)).alias("turns"), "segments", "formatted")


def digest_chats(chats: DataFrame) -> DataFrame:
    """The digest of the contract, taken from the output alone."""
    learned = F.transform(F.filter("segments", lambda s: s["learned"]), lambda s: unescape(s["text"]))
    back = read_chats(chats).withColumn("learned", F.array_join(learned, ""))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "blocks",
    )
