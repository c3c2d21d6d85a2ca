"""Chat formatting after cumulative-snapshot collapse.

Logs often hold a conversation many times, each snapshot a prefix of the next.
Every turn gets a hash of its place, role and text; their running xor is the
rolling hash of the prefix that ends there (two hashes of 64 bits, as one alone
would clash in large corpora). A conversation whose whole hash is a proper
prefix hash of another one is not maximal, nor is one whose whole hash is also
that of a conversation with a smaller id; anti-joins drop both, and what stays
is rendered turn by turn.

Only hashes are compared, so the turns' texts are moved once, to be rendered.
A prefix that a third of all conversations share is one row for each task after
partial aggregation.

Defined results: turns go by `turn`, then role, then text, nulls first; after
that a null role is "user" and a null text is empty; rows that occur twice count once; turns
with a null conversation id take no part; extra columns are ignored; an empty
table gives an empty result. The tokens of the format inside a text are broken
by a zero-width space, so no text can forge a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import maybe_among

START, END = "<|im_start|>", "<|im_end|>"
#: What tells a turn from others without its text.
TURN = ("conv_id", "turn", "said_by", "which", "h1", "h2")
#: Turns of one conversation, number and role for which the filter that finds their texts is made; with more, more texts are moved.
TIES = 1 << 18


def _turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, said_by (the role as logged), text and two hashes of what is said."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").alias("said_by"), "text")
    role, text = F.coalesce("said_by", F.lit("user")), F.coalesce("text", F.lit(""))
    # a null text and an empty one are rows of their own, and so are a null role and "user"
    which = F.concat(F.col("said_by").isNull().cast("string"), F.col("text").isNull().cast("string")).alias("which")
    return rows.where(F.col("conv_id").isNotNull()).select("*", which, F.xxhash64(F.lit(1), role, text).alias("h1"), F.xxhash64(F.lit(2), text, role).alias("h2"))


def _order_of_ties(rows: DataFrame, slim: DataFrame) -> DataFrame:
    """conv_id, turn, said_by, which, h1, h2 and nth (by text) of turns that share their conversation, number and role with others: only such texts are moved."""
    tied = slim.groupBy("conv_id", "turn", "said_by").agg(F.count("*").alias("n")).where("n > 1")
    key = F.xxhash64("conv_id", "turn", "said_by")
    few = maybe_among(rows.withColumn("key", key), "key", tied.select(key.alias("key")), TIES)
    same = [few[c].eqNullSafe(tied[c]) for c in ("conv_id", "turn", "said_by")]
    few = few.join(tied, same, "left_semi").select("conv_id", "turn", "said_by", "which", "h1", "h2", "text").distinct()
    w = Window.partitionBy("conv_id", "turn", "said_by").orderBy(F.asc_nulls_first("text"))
    return few.select(*[F.col(c).alias(f"t_{c}") for c in TURN], F.row_number().over(w).alias("nth"))


def numbered_turns(turns: DataFrame) -> DataFrame:
    """Distinct turns with place (from 1) and the rolling hashes a, b of the prefix that ends there."""
    rows = _turns(turns)
    # rows without their texts: those meet again only where a conversation is kept
    slim = rows.select(*TURN).distinct()
    ties = _order_of_ties(rows, slim)
    placed = slim.join(ties, [slim[c].eqNullSafe(ties[f"t_{c}"]) for c in TURN], "left").select(*[slim[c] for c in TURN], "nth")
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("said_by"), "nth")
    placed = placed.withColumn("place", F.row_number().over(order).cast("long"))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.withColumns(
        {"a": F.expr("bit_xor(xxhash64(place, h1))").over(running), "b": F.expr("bit_xor(xxhash64(h2, place))").over(running)}
    )


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and whole hashes of the conversations that are no prefix or later copy of another one."""
    placed = numbered_turns(turns)
    whole = Window.partitionBy("conv_id")
    marked = placed.withColumn("n_turns", F.max("place").over(whole))
    prefixes = marked.where("place < n_turns").groupBy("place", "a", "b").agg(F.lit(1).alias("_one")).select(F.col("place").alias("n_turns"), "a", "b")
    ends = marked.where("place = n_turns").select("conv_id", "n_turns", "a", "b")
    copies = ends.groupBy("n_turns", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    return copies.join(prefixes, ["n_turns", "a", "b"], "left_anti")


def _broken(text: Column) -> Column:
    """The format's tokens within a text, broken up."""
    return F.replace(F.replace(text, F.lit(START), F.lit("<|\u200bim_start|>")), F.lit(END), F.lit("<|\u200bim_end|>"))


def render_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies (equal conversations, itself included) and chat (the rendered text) of each maximal conversation.

    A role is one word of the format: white space and the format's signs in it become `_`.
    """
    kept = maximal(turns).select("conv_id", "n_turns", "n_copies")
    rows = _turns(turns).select("conv_id", "turn", "said_by", "text")
    role = lambda t: F.regexp_replace(F.coalesce(t["said_by"], F.lit("user")), r"[\s<|>]+", "_")
    said = lambda t: F.concat(F.lit(START), role(t), F.lit("\n"), _broken(F.coalesce(t["text"], F.lit(""))), F.lit(END), F.lit("\n"))
    # a maximal conversation is one output row, so its turns meet by nature
    listed = rows.join(kept, "conv_id").groupBy("conv_id", "n_turns", "n_copies").agg(F.collect_set(F.struct("turn", "said_by", "text")).alias("t"))
    chat = F.array_join(F.transform(F.sort_array("t"), said), "")  # nulls first
    return listed.select("conv_id", "n_turns", "n_copies", chat.alias("chat"))
