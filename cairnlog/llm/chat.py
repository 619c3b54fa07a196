"""Dialogues of several parties, written once from every participant's view.

In a participant's view its own turns are the assistant's, all others are those of named
users, and only the assistant's words are learnt. A view is a row per turn with the
text of that turn and its place in the whole dialogue, so a conversation of any length
is never held by one task: turns are cut into segments, and only the sizes of segments
are summed up along a conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers per segment of a conversation.
SEGMENT = 256
#: Parts of a conversation's turns that have no number.
UNNUMBERED_PARTS = 4096
SYSTEM = "system"
#: Stands for a role that is null or blank; an escaped name never begins like that.
NOBODY = "%"
#: Characters that would end a name or its line, and how they are written; "%" is one, so
#: that different names stay different.
ESCAPES = {"%": "%25", "|": "%7C", "<": "%3C", ">": "%3E", "\n": "%0A"}

# Markers of the rendered text.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def _safe(text: Column) -> Column:
    """Markers inside a text are broken up, so that a turn cannot pose as another."""
    return F.replace(text, F.lit(OPEN), F.lit("< |"))


def _name(role: Column) -> Column:
    """The role as it stands in a header, different for different roles."""
    name = role
    for character, code in ESCAPES.items():
        name = F.replace(name, F.lit(character), F.lit(code))
    return F.when(role.isNull() | (F.trim(role) == ""), F.lit(NOBODY)).otherwise(name)


def _header(role: Column, viewer: Column) -> Column:
    own = F.lit(f"{OPEN}assistant{CLOSE}")
    system = F.lit(f"{OPEN}system{CLOSE}")
    other = F.concat(F.lit(f"{OPEN}user name="), role, F.lit(CLOSE))
    return F.when(role == viewer, own).when(role == SYSTEM, system).otherwise(other)


def rotate_perspectives(
    conversations: DataFrame,
    *,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """One row per conversation, viewer and turn.

    ``<id>, viewer, turn, name, speaks_as, segment, start, end, learn_start, learn_end``:
    ``segment`` is the rendered turn, its place in the dialogue in code points, end
    exclusive; ``learn_start`` to ``learn_end`` covers the words and end mark of the
    viewer's own turns and is empty for others. Segments in turn order make the dialogue.

    System turns have no view of their own. Names are escaped (``ESCAPES``), so different
    roles are different participants; null and blank roles are one, named ``%``. A null
    text is empty. Turns without a number come first, in the order of digests of role and
    text; turns with equal numbers follow role and text; repeated rows stay. Rows with a null id form one conversation. Without
    participants (only system turns) there is no row. Other columns are ignored.
    """
    text = _safe(F.coalesce(F.col(text_column).cast("string"), F.lit("")))
    turn = F.col(turn_column).cast("long")
    # Unnumbered turns are cut by their digests, which also order them.
    unnumbered = F.lit(-(2**62)) + F.pmod(F.xxhash64(role_column, text_column), F.lit(UNNUMBERED_PARTS))
    turns = conversations.select(
        F.col(id_column).alias("id"),
        turn.alias("turn"),
        _name(F.col(role_column).cast("string")).alias("role"),
        text.alias("text"),
        F.coalesce(F.floor(turn / SEGMENT), unnumbered).alias("part"),
    )
    sizes = turns.groupBy("id", "part", "role").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")
    )
    viewers = (
        sizes.where(F.col("role") != SYSTEM)
        .select(F.col("id").alias("v_id"), F.col("role").alias("viewer"))
        .distinct()
    )
    seen = sizes.join(viewers, F.col("id").eqNullSafe(F.col("v_id"))).drop("v_id")
    around = F.length(_header(F.col("role"), F.col("viewer"))) + len(END) + 1
    parts = seen.groupBy("id", "part", "viewer").agg(
        F.sum(F.col("chars") + F.col("n") * around).alias("size")
    )
    # One row per segment of turns and viewer.
    before = (
        Window.partitionBy("id", "viewer")
        .orderBy("part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    bases = parts.select(
        F.col("id").alias("b_id"),
        F.col("part").alias("b_part"),
        "viewer",
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"),
    )
    views = turns.join(
        bases, F.col("id").eqNullSafe(F.col("b_id")) & (F.col("part") == F.col("b_part"))
    )
    header = _header(F.col("role"), F.col("viewer"))
    rendered = views.withColumn("header", header).withColumn(
        "segment", F.concat("header", "text", F.lit("\n" + END))
    )
    inside = (
        Window.partitionBy("id", "part", "viewer")
        .orderBy("turn", "role", "text")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    end = F.col("base") + F.sum(F.length("segment")).over(inside)
    placed = rendered.withColumn("end", end).withColumn("start", F.col("end") - F.length("segment"))
    own = F.col("role") == F.col("viewer")
    speaks_as = F.when(own, "assistant").when(F.col("role") == SYSTEM, SYSTEM).otherwise("user")
    return placed.select(
        F.col("id").alias(id_column),
        "viewer",
        "turn",
        F.col("role").alias("name"),
        speaks_as.alias("speaks_as"),
        "segment",
        "start",
        "end",
        (F.col("start") + F.length("header")).alias("learn_start"),
        F.when(own, F.col("end"))
        .otherwise(F.col("start") + F.length("header"))
        .alias("learn_end"),
    )
