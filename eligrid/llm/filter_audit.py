"""Filter interaction audit: what five filters remove in every order, from one pass over the texts and a Gray-code walk.

Each document gets a mask with one bit per filter it fails. Counts per (part, mask) are all the audit needs: 32 cells a
part. A walk in Gray-code order visits all 32 sets of active filters by toggling one filter at a time; every cell keeps
a counter of its active failures, and the running survivors change only by cells whose counter leaves or reaches zero.
The survivors of the 32 sets are stored, and each step of each of the 120 orders is a difference of two of them.

Filters (words: runs of characters other than blanks and control spaces): A under 200 words; B less than half of the words distinct; C more
than 2 % capital A-Z; D any of #$%&*|; E the text of a smaller doc_id. Copies of a text share all bits but E, so E
comes from counts and smallest ids per distinct text: groups of copies are pre-aggregated, never gathered.

Defined results: null text is empty (it fails A; empty texts are copies of each other); null source is the part '';
a null doc_id is no smaller than any and fails E never; rows that repeat the smallest doc_id of a text all pass E;
a document without a label, with a null label or a null doc_id counts as neither good nor toxic; labels that repeat a
doc_id count as one, 1 if any says 1. Other columns of both tables are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eligrid.llm.common import stored

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
SPACES = r"[\x20\x09-\x0D]+"
SALTS = 64
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
RESULT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def _bit(failed: Column, place: int) -> Column:
    return F.when(failed, 1 << place).otherwise(0)


def text_mask(text: Column) -> Column:
    """Bits of A to D; they depend on the text alone."""
    words = F.array_remove(F.split(text, SPACES, -1), "")
    facts = F.struct(F.size(words).alias("n"), F.size(F.array_distinct(words)).alias("d"))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    # The struct of counts is computed once for both filters on words.
    of_words = F.element_at(F.transform(F.array(facts), lambda x: _bit(x["n"] < 200, 0) + _bit(100 * x["d"].cast("long") < 50 * x["n"].cast("long"), 1)), 1)
    return of_words + _bit(100 * capitals.cast("long") > 2 * F.length(text).cast("long"), 2) + _bit(text.rlike(r"[#$%&*|]"), 3)


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part by the filters they fail."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = (
        docs.select(
            "doc_id",
            F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
            F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("digest"),
            text_mask(text).alias("mask"),
        )
        .groupBy("doc_id", "part", "digest", "mask")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic")
    )
    # Null ids match no label; a salt keeps them from meeting in one task.
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest", "part"), F.lit(SALTS))).otherwise(F.lit(0))
    marked = rows.withColumn("salt", salt).join(known.withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left")
    groups = (
        marked.select("doc_id", "part", "digest", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
        .groupBy("digest", "part", "mask", "good", "toxic")
        .agg(
            F.sum("n").alias("n"),
            F.min("doc_id").alias("low"),
            F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
            # Rows that carry the smallest id of this group; several where ids repeat.
            F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", -F.col("n")))).alias("first"),
        )
    )
    # Written, so that the texts are read once for both uses.
    groups = stored(groups, "audit-groups")
    lowest = groups.groupBy("digest").agg(F.min("low").alias("lowest"))
    passing = F.col("n_null") + F.when(F.col("low") == F.col("lowest"), -F.col("first.col2")).otherwise(0)
    split = groups.join(lowest, "digest").select("part", "mask", "good", "toxic", "n", F.coalesce(passing, F.col("n_null")).alias("passing"))
    sides = split.select(
        "part", "good", "toxic",
        F.explode(
            F.array(
                F.struct(F.col("mask").alias("mask"), F.col("passing").alias("n")),
                F.struct((F.col("mask") + (1 << 4)).alias("mask"), (F.col("n") - F.col("passing")).alias("n")),
            )
        ).alias("side"),
    ).select("part", "good", "toxic", "side.*").filter("n > 0")
    return sides.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def gray_toggles(filters: int = len(FILTERS)) -> list[int]:
    """The filter toggled at each step of a walk through all subsets from the empty one."""
    return [(step & -step).bit_length() - 1 for step in range(1, 1 << filters)]


def survivors(counts):
    """(parts, subsets, measures): what no active filter fails, for all 32 sets; counts: (parts, cells, measures)."""
    import numpy as np

    cell = np.arange(counts.shape[1])
    failures = np.zeros(len(cell), np.int64)
    running = counts.sum(axis=1)
    states = np.zeros_like(counts)
    active = 0
    states[:, active] = running
    for place in gray_toggles():
        touched = (cell >> place) & 1 == 1
        active ^= 1 << place
        if active >> place & 1:
            running = running - counts[:, touched & (failures == 0)].sum(axis=1)
            failures[touched] += 1
        else:
            failures[touched] -= 1
            running = running + counts[:, touched & (failures == 0)].sum(axis=1)
        states[:, active] = running
    return states


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step; see the contract of the query."""
    by_part = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))

    def walk(batches):
        import numpy as np
        import pyarrow as pa

        orders = list(permutations(range(len(FILTERS))))
        names = ["".join(FILTERS[f] for f in order) for order in orders]
        step_filter = np.array(orders)
        before = np.array([[sum(1 << f for f in order[:k]) for k in range(len(order))] for order in orders])
        after = before | (1 << step_filter)
        for batch in batches:
            # Few parts at a time: 600 rows come of each.
            for low in range(0, batch.num_rows, 64):
                piece = batch.slice(low, 64).to_pydict()
                counts = np.zeros((len(piece["part"]), SUBSETS, 3), np.int64)
                for i, listed in enumerate(piece["cells"]):
                    for c in listed:
                        counts[i, c["mask"]] = c["n"], c["good"], c["toxic"]
                states = survivors(counts)
                lost = states[:, before] - states[:, after]
                fails = np.stack([counts[:, (np.arange(SUBSETS) >> f) & 1 == 1, 0].sum(axis=1) for f in range(len(FILTERS))], axis=1)
                alone = counts[:, 1 << np.arange(len(FILTERS)), 0]
                shares = np.stack([lost[:, step_filter == f, 0].sum(axis=1) for f in range(len(FILTERS))], axis=1)
                removed = lost[..., 0]
                columns = {
                    "kept": states[:, after, 0],
                    "removed": removed,
                    "redundant": fails[:, step_filter] - removed,
                    "unique_fails": alone[:, step_filter],
                    "good_lost": lost[..., 1],
                    "toxic_lost": lost[..., 2],
                    "shapley": shares[:, step_filter],
                }
                steps = len(FILTERS)
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array(np.repeat(np.array(piece["part"], object), len(orders) * steps), pa.string()),
                        "filter_order": pa.array(np.tile(np.repeat(np.array(names, object), steps), len(piece["part"])), pa.string()),
                        "step": pa.array(np.tile(np.arange(1, steps + 1), len(orders) * len(piece["part"])), pa.int32()),
                        **{k: pa.array(v.ravel(), pa.int64()) for k, v in columns.items()},
                    }
                )

    return by_part.mapInArrow(walk, RESULT)
