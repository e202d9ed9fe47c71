"""Chat formatting of logged conversations, after their snapshots have been collapsed.

Chat systems log a conversation anew with every turn, so one conversation stands in the log many
times, each time a turn longer. A rolling hash over the turns so far identifies every prefix; a
conversation whose whole hash is another's prefix hash is a snapshot of it and goes. The rest is
rendered with role markers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns of a conversation that are hashed and rendered together: 2^8.
BLOCK_BITS = 8
_FIRST = -(1 << 63)


def _turns(conversations: DataFrame) -> DataFrame:
    """Distinct turns with their hashes. ``key`` stands for the conversation and is never null."""
    turns = conversations.select(
        F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("id")).alias("key"),
        F.coalesce(F.col("turn").cast("long"), F.lit(_FIRST)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    return turns.withColumns({
        "block": F.shiftright("turn", BLOCK_BITS),
        "h1": F.xxhash64("turn", "role", "text", F.lit(1)),
        "h2": F.xxhash64("turn", "role", "text", F.lit(2))})


def _prefixes(turns: DataFrame) -> DataFrame:
    """(p1, p2, n) of every beginning that ends with a whole turn and is not the whole conversation.

    The hash of a beginning is the exclusive or of its turns' hashes, so it adds up: first over
    blocks of turns, then within a block. A conversation of any length is spread over its blocks.
    """
    blocks = turns.groupBy("key", "block").agg(
        F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"), F.count("*").alias("m"), F.max("turn").alias("last"))
    ahead = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select(
        "key", "block", F.max("last").over(Window.partitionBy("key")).alias("last"),
        *[F.coalesce(f(c).over(ahead), F.lit(0)).alias(c) for f, c in ((F.bit_xor, "x1"), (F.bit_xor, "x2"), (F.sum, "m"))])
    so_far = Window.partitionBy("key", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return (turns.join(base, ["key", "block"]).select(
        "turn", "last", F.col("x1").bitwiseXOR(F.bit_xor("h1").over(so_far)).alias("p1"),
        F.col("x2").bitwiseXOR(F.bit_xor("h2").over(so_far)).alias("p2"), (F.col("m") + F.count("*").over(so_far)).alias("n"))
        .where("turn < last").select("p1", "p2", "n").distinct())


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that no other continues.

    Of equal conversations the one with the smallest id stays; ``n_copies`` counts them. Copies are
    grouped before anything is joined, so a conversation logged a million times is one row.
    """
    turns = _turns(conversations)
    return _maximal(turns).select(F.when(~F.col("key.none"), F.col("key.id")).alias("conv_id"), "n_turns", "n_copies")


def _maximal(turns: DataFrame) -> DataFrame:
    whole = turns.groupBy("key").agg(F.bit_xor("h1").alias("p1"), F.bit_xor("h2").alias("p2"), F.count("*").alias("n"))
    contents = whole.groupBy("p1", "p2", "n").agg(F.min("key").alias("key"), F.count("*").alias("n_copies"))
    return contents.join(_prefixes(turns), ["p1", "p2", "n"], "left_anti").select("key", F.col("n").alias("n_turns"), "n_copies")


def rendered_turn(role: Column, text: Column) -> Column:
    """A turn between its markers. Markers inside a text are broken up, so none can be forged."""
    plain = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit("<|im_start|>"), plain(role), F.lit("\n"), plain(text), F.lit("<|im_end|>\n"))


def render(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, text): each maximal conversation, rendered.

    A turn is what stands under one turn number; of several rows there, all count, by role and text.
    Repeated rows count once. Turns without a number come first; null roles and texts are empty.
    Rows without a conversation belong to one conversation of their own, whose id is null. An empty
    table gives no rows. Only conversations that begin at the same turn number prefix each other.

    Turns are joined into the text a block at a time, then the blocks.
    """
    turns = _turns(conversations)
    kept = _maximal(turns)
    part = F.struct("turn", "role", F.col("text").alias("body"), rendered_turn(F.col("role"), F.col("text")).alias("shown"))
    in_order = lambda parts: F.array_join(F.transform(F.array_sort(parts), lambda x: x["shown"]), "")
    blocks = (turns.join(kept.select("key"), "key", "left_semi").groupBy("key", "block").agg(F.collect_list(part).alias("parts"))
              .select("key", F.struct("block", in_order(F.col("parts")).alias("shown")).alias("part")))
    texts = blocks.groupBy("key").agg(F.collect_list("part").alias("parts")).select("key", in_order(F.col("parts")).alias("text"))
    return kept.join(texts, "key").select(
        F.when(~F.col("key.none"), F.col("key.id")).alias("conv_id"), "n_turns", "n_copies", "text")
