"""Logged conversations without those that a longer one begins with, with built-in
functions only.

A chat log holds a snapshot after each turn. The hash of a conversation's first k turns
is kept up turn by turn; a conversation whose whole hash is that of a prefix of a longer
one goes, as do all but one of equal ones. What stays is rendered turn by turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.llm.shared import shared_folder, stored

CHUNK = 1024  # turns that one task orders


def collapsed(conversations: DataFrame, folder: str | None = None) -> DataFrame:
    """One row per turn of the maximal conversations: conv_id, position (from 1),
    n_turns, role, rendered.

    Turns are ordered by turn, then role, then text, nulls first; rows that repeat all of
    conv_id, turn, role and text count once. Two turns are equal if role and text are,
    null being equal to null only. Of equal conversations the smallest conv_id stays.
    Rows with a null conv_id belong to no conversation and are left out. A null role or
    text is rendered as empty. Other columns are ignored."""
    folder = folder or shared_folder(conversations.sparkSession)
    turns = stored(_numbered(conversations), folder, "turns")
    prefixes = stored(_prefixes(turns), folder, "prefixes")
    sizes = prefixes.groupBy("conv_id").agg(F.max("position").alias("n_turns"))
    prefixes = prefixes.join(sizes, "conv_id")
    whole = prefixes.filter("position = n_turns")
    key = ["position", "one", "two"]
    same = prefixes.groupBy(*key).agg(
        F.max("n_turns").alias("longest"), F.min(F.when(F.col("position") == F.col("n_turns"), F.col("conv_id"))).alias("first")
    )
    longer = same.filter("longest > position").select(*key)
    repeated = whole.join(same.select(*key, "first"), key).filter("conv_id > first").select("conv_id")
    kept = whole.join(longer, key, "left_anti").join(repeated, "conv_id", "left_anti").select("conv_id", "n_turns")
    return turns.join(kept, "conv_id").select("conv_id", "position", "n_turns", "role", rendered(F.col("role"), F.col("text")).alias("rendered"))


def rendered(role: Column, text: Column) -> Column:
    empty = F.lit("")
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, empty), F.lit("\n"), F.coalesce(text, empty), F.lit("<|im_end|>\n"))


def _numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, chunk, position, role, text. A conversation of any length is ordered in
    chunks of its turn numbers, which are then set behind each other."""
    rows = conversations.filter("conv_id IS NOT NULL").select("conv_id", "turn", "role", "text").distinct()
    rows = rows.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(2**62))))
    within = F.row_number().over(Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "text"))
    sizes = rows.groupBy("conv_id", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("conv_id", "chunk", F.coalesce(F.sum("n").over(_earlier()), F.lit(0)).alias("before"))
    numbered = rows.withColumn("within", within).join(before, ["conv_id", "chunk"])
    return numbered.select("conv_id", "chunk", (F.col("before") + F.col("within")).alias("position"), "role", "text")


def _earlier():
    """The earlier chunks of a conversation: a row for every CHUNK turns."""
    return Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)


def _prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, position and the hash, in two numbers, of all turns up to position. A
    turn's hashes depend on its place, so their exclusive or depends on the order."""
    tagged = lambda c: F.coalesce(F.concat(F.lit("+"), F.col(c)), F.lit("-"))  # noqa: E731  null is not empty
    content = F.unhex(F.sha2(F.concat(tagged("role"), F.lit("\0"), tagged("text")), 256))
    rows = turns.select("conv_id", "chunk", "position", F.xxhash64("position", content).alias("one"), F.xxhash64(content, "position").alias("two"))
    upto = Window.partitionBy("conv_id", "chunk").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    sizes = rows.groupBy("conv_id", "chunk").agg(F.bit_xor("one").alias("one"), F.bit_xor("two").alias("two"))
    before = sizes.select("conv_id", "chunk", *[F.coalesce(F.bit_xor(c).over(_earlier()), F.lit(0)).alias(f"{c}_before") for c in ("one", "two")])
    running = rows.select("conv_id", "chunk", "position", *[F.bit_xor(c).over(upto).alias(c) for c in ("one", "two")])
    running = running.join(before, ["conv_id", "chunk"])
    return running.select("conv_id", "position", *[F.col(c).bitwiseXOR(F.col(f"{c}_before")).alias(c) for c in ("one", "two")])
