"""Chat formatting by perspective rotation (DataFrame operations only).

For every participant of a conversation the dialogue is rendered once, with that participant as the assistant and the others
as users under their names. The mask lists the spans of characters that the assistant says, end marks included.
A long conversation is rendered in parts of a fixed number of turns, and a part with more messages than turns (messages
without a turn, conversations without a name) in pieces of as many messages, so no row holds more than a piece. Messages
are numbered by a global range sort, so no task holds more than a range either. A piece tells at which character of
the whole rendering it starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import stored

#: Turns of a part, and messages of a piece.
PART = 256
END = "<|end|>\n"
#: For messages without a role.
NOBODY = "unknown"


def rotate(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part: int = PART) -> DataFrame:
    """``conv_id``, ``speaker``, ``part``, ``piece``, ``starts_at``, ``n_messages``, ``text``, ``mask`` (array of start and stop within the piece).

    Messages are ordered by turn (null last), then role and text; ties are equal messages, and repeated rows are repeated messages. A null
    role is ``unknown``, a null text is empty, a null conversation is one conversation of its own; a participant without words
    in a piece still gets its rendering, with an empty mask. A very long text is one message, however long. An empty table gives
    an empty result; other columns play no part.
    """
    rows = messages.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit(NOBODY)).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("said"),
        F.coalesce(F.floor(F.col(turn_col) / part), F.lit((1 << 62))).cast("long").alias("part"),
    )
    speakers = rows.select("conv", F.col("role").alias("speaker")).distinct()
    order = ["conv", "part", "turn", "role", "said", "n"]
    dealt = stored(rows.withColumn("n", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()).withColumn("n", F.monotonically_increasing_id()), "messages")
    # a row for each part and range: where its messages begin, and how many of the part come before
    ranges = dealt.groupBy("conv", "part", "range").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("k"))
    ranges = stored(ranges.withColumn("above", F.coalesce(F.sum("k").over(Window.partitionBy("conv", "part").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("k"), "ranges")
    same = [dealt["range"] == ranges["range"], dealt["part"] == ranges["part"], dealt["conv"].eqNullSafe(ranges["conv"])]
    numbered = dealt.join(ranges, same).select(dealt["conv"], dealt["part"], "turn", "role", "said", F.floor((F.col("n") - F.col("first") + F.col("above")) / part).alias("piece"))
    parts = numbered.groupBy("conv", "part", "piece").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNull().alias("last"), "turn", "role", "said"))).alias("messages"))
    each = parts.join(speakers, parts["conv"].eqNullSafe(speakers["conv"])).select(parts["conv"], "part", "piece", "speaker", "messages")
    mine = lambda m: m["role"] == F.col("speaker")
    head = lambda m: F.when(mine(m), F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user:"), m["role"], F.lit("|>\n")))
    pieces = F.transform("messages", lambda m: F.struct(head(m).alias("head"), F.concat(m["said"], F.lit(END)).alias("body"), mine(m).alias("mine")))
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("mask")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["body"])).alias("at"),
            F.when(p["mine"], F.array_append(acc["mask"], F.struct((acc["at"] + F.length(p["head"])).alias("start"), (acc["at"] + F.length(p["head"]) + F.length(p["body"])).alias("stop")))).otherwise(acc["mask"]).alias("mask"),
        ),
    )
    done = each.withColumn("pieces", pieces).select("conv", "speaker", "part", "piece", F.size("messages").alias("n_messages"), F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "").alias("text"), spans["mask"].alias("mask"))
    # places of the pieces: one number a piece, added up for each rendering
    before = Window.partitionBy("conv", "speaker").orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    return done.withColumn("starts_at", F.coalesce(F.sum(F.length("text").cast("long")).over(before), F.lit(0))).select(F.col("conv").alias(conv_col), "speaker", "part", "piece", "starts_at", "n_messages", "text", "mask")
