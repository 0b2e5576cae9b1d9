"""Chat formatting of reply trees, in DataFrame functions only.

A message names its parent. Iterative self-joins double the pointers to ancestors (2^k at round k) and sum depth and
score along the way, so a thread of any length takes logarithmically many rounds. Leaves are ranked by the mean score
of their root-to-leaf path; the tables of the rounds then enumerate the messages of the chosen paths only. Each path
is formatted as one conversation.

Template: `### role`, line feed, text, line feed, `</turn>`, line feed. In texts and roles `\\` is written `\\e`, `<`
is `\\l`, `#` is `\\h`, and in roles a line feed is `\\n`: no text can imitate a control string, and every text comes
back exactly. The output is a list of segments with a loss flag; assistant texts alone carry loss.

Defined results: null roles and texts count as empty. A parent that does not exist, or a message naming itself, makes
a root; null tree ids form one tree. Every row counts: a message with a null id hangs on its parent and has no replies,
rows that repeat an id are siblings or what their parents say, and replies to the id go to the first of them by parent,
role, text and score. A reply cycle raises. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eligrid.llm.common import stored
from eligrid.session import checkpoint

END = "\n</turn>\n"
HEAD = "### "


def from_turns(turns: DataFrame) -> DataFrame:
    """Turn tables as reply trees: each row answers the one before it; rows that repeat a turn go by role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("message", F.row_number().over(order).cast("long"))
    return rows.select(
        F.col("conv_id").alias("tree"), "message", (F.col("message") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score")
    )


def keyed(messages: DataFrame) -> DataFrame:
    """Messages as (tree, message, parent, score, role, text, id): `message` is a key of the row's own, in the order of ids."""
    order = Window.partitionBy("tree").orderBy(F.col("message").asc_nulls_last(), "parent", "role", "text", "score")
    rows = messages.select("tree", "message", "parent", "role", "text", "score").withColumn("key", F.row_number().over(order).cast("long"))
    first = rows.filter("message IS NOT NULL").groupBy(F.col("tree").alias("t"), F.col("message").alias("m")).agg(F.min("key").alias("up"))
    linked = F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("m")) & ~F.col("parent").eqNullSafe(F.col("message"))
    return rows.join(first, linked, "left").select("tree", F.col("key").alias("message"), F.col("up").alias("parent"), "score", "role", "text", F.col("message").alias("id"))


def paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, leaf, rank, message) of the `top` best root-to-leaf paths of every tree; ties go to the smaller leaf.

    Message ids are unique and not null within a tree, as `keyed` makes them.
    """
    own = messages.select("tree", "message", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    ids = own.select(F.col("tree").alias("t"), F.col("message").alias("m"))
    links = own.join(
        ids, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("m")) & (F.col("parent") != F.col("message")), "left"
    ).select("tree", "message", F.col("m").alias("up"), F.when(F.col("m").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("score").alias("total"))
    state = checkpoint(links)
    rounds, size = [], state.agg(F.count(F.lit(1)).alias("n"), F.count("up").alias("open")).collect()[0]
    limit = size["n"].bit_length() + 1
    while size["open"]:
        if len(rounds) > limit:
            raise ValueError("replies form a cycle")
        rounds.append(state.filter("up IS NOT NULL").select(F.col("tree").alias("t"), F.col("message").alias("m"), F.col("up").alias("next")))
        other = state.select(F.col("tree").alias("t"), F.col("message").alias("m"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("total").alias("s2"))
        # Messages that have reached their root are done; only the others go on.
        moved = state.filter("up IS NOT NULL").join(other, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("m")))
        moved = moved.select("tree", "message", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"), (F.col("total") + F.col("s2")).alias("total"))
        state = checkpoint(state.filter("up IS NULL").union(moved))
        size = state.agg(F.count("up").alias("open")).collect()[0]
    parents = links.filter("up IS NOT NULL").select(F.col("tree").alias("t"), F.col("up").alias("m")).distinct()
    leaves = state.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("message") == F.col("m")), "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / (F.col("depth") + 1)), "message")
    chosen = leaves.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    # Every ancestor distance has one binary form, so each round at most doubles the set and repeats nothing.
    on_path = chosen.select("tree", F.col("message").alias("leaf"), "rank", "message")
    for jump in reversed(rounds):
        more = on_path.join(jump, F.col("tree").eqNullSafe(F.col("t")) & (F.col("message") == F.col("m"))).select("tree", "leaf", "rank", F.col("next").alias("message"))
        on_path = checkpoint(on_path.union(more))
    depth = state.select(F.col("tree").alias("t"), F.col("message").alias("m"), "depth")
    return on_path.join(depth, F.col("tree").eqNullSafe(F.col("t")) & (F.col("message") == F.col("m"))).select("tree", "leaf", "rank", "message", "depth")


def _escaped(text):
    for found, code in (("\\", "\\e"), ("<", "\\l"), ("#", "\\h")):
        text = F.replace(text, F.lit(found), F.lit(code))
    return text


def _plain(text):
    for code, found in (("\\l", "<"), ("\\h", "#"), ("\\e", "\\")):
        text = F.replace(text, F.lit(code), F.lit(found))
    return text


def formatted(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, leaf, rank, segments): segments are (text, loss); their texts joined are the conversation."""
    own = keyed(messages)
    texts = own.select(
        F.col("tree").alias("t"), F.col("message").alias("m"), "id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = paths(own, top).join(texts, F.col("tree").eqNullSafe(F.col("t")) & (F.col("message") == F.col("m")))
    turns = rows.groupBy("tree", "leaf", "rank").agg(
        F.max_by("id", "depth").alias("leaf_id"), F.array_sort(F.collect_list(F.struct("depth", "role", "text"))).alias("turns")
    )

    def segments(turn):
        head = F.concat(F.lit(HEAD), F.replace(_escaped(turn["role"]), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
        make = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            make(head, F.lit(False)),
            make(_escaped(turn["text"]), turn["role"] == "assistant"),
            make(F.lit(END), F.lit(False)),
        )

    return turns.select("tree", F.col("leaf_id").alias("leaf"), "rank", F.flatten(F.transform("turns", segments)).alias("segments"))


def read_back(out: DataFrame) -> DataFrame:
    """Turns and loss text recovered from the formatted output alone: tree, turns (role, text), loss_text, conversation."""
    whole = out.select(
        "tree",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("conversation"),
        _plain(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), "")).alias("loss_text"),
    )
    blocks = F.split("conversation", END, -1)

    def turn(block):
        line = F.instr(block, F.lit("\n"))
        role = F.substring(block, F.lit(len(HEAD) + 1), line - 1 - len(HEAD))
        return F.struct(
            _plain(F.replace(role, F.lit("\\n"), F.lit("\n"))).alias("role"),
            _plain(F.substring(block, line + 1, F.length(block))).alias("text"),
        )

    return whole.select("tree", "conversation", "loss_text", F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), turn).alias("turns"))


def write(messages: DataFrame, top: int = 1) -> DataFrame:
    """The formatted conversations as a written table."""
    return stored(formatted(messages, top), "chat")
