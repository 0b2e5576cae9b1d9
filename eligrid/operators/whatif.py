"""What-if scenarios: overlay field changes, evaluate all at once, compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eligrid import model
from eligrid.functions import cells
from eligrid.functions import vocab as V
from eligrid.operators import decision, predicate_index, profiles
from eligrid.session import checkpoint, within_limit

BASE = "current"


def scenarios(profile_cells: DataFrame, changes: dict[str, tuple[str, Column, str]]) -> DataFrame:
    """Each profile as it is and once per change: name -> (field, value, kind).

    `changed` is the slot that differs, -1 for the profile as it is.
    """
    variants = [F.struct(F.lit(BASE).alias("scenario"), F.lit(-1).alias("changed"), F.col("cells").alias("cells"))]
    for name, (field, value, kind) in changes.items():
        slot = model.FIELD_SLOT[field]
        made = _replaced(slot, cells.cell(value, kind))
        variants.append(F.struct(F.lit(name).alias("scenario"), F.lit(slot).alias("changed"), made.alias("cells")))
    varied = profile_cells.select("profile_id", "state", "extras", F.inline(F.array(*variants)))
    return varied.withColumn("populated", profiles.populated_slots(F.col("cells")))


def _replaced(slot: int, cell: Column) -> Column:
    return F.transform("cells", lambda c, i: F.when(i == slot, cell).otherwise(c))


def evaluate(profile_cells: DataFrame, nested: DataFrame, changes: dict) -> DataFrame:
    """Determinations of all scenarios in one pass over the profiles.

    A scenario is evaluated only against schemes with a rule on the changed field; the
    status of every other scheme is that of the profile as it is (see `aligned`).
    """
    slots = sorted({model.FIELD_SLOT[field] for field, _, _ in changes.values()})
    touched = F.array_intersect("required_slots", F.array(*[F.lit(s) for s in slots]))
    per_change = nested.withColumn("changed", F.explode(F.concat(F.array(F.lit(-1)), touched)))
    rows = scenarios(profile_cells, changes)
    # The index knows one key per row: state and changed field together.
    key = F.concat_ws("|", "state", "changed")
    keyed = checkpoint(per_change.withColumn("state", key).drop("changed"))
    index = predicate_index.build(keyed)
    if index is None or not within_limit(keyed):
        return decision.determinations(rows, per_change, keys=("state", "changed")).drop("changed")
    placed = decision.placed(rows, nested.select("state").distinct()).withColumn("state", key)
    found = predicate_index.whole_determinations(placed, keyed, index, "scenario")
    return found.withColumn("state", F.substring_index("state", "|", 1))


def aligned(evaluated: DataFrame, names: list[str]) -> DataFrame:
    """Current and hypothetical status side by side.

    A conditional aggregation without a join; only statuses are shuffled.
    """
    pick = lambda name: F.max(F.when(F.col("scenario") == name, F.col("status")))
    wide = evaluated.groupBy("profile_id", "scheme_id").agg(
        pick(BASE).alias("old_status"), *[pick(n).alias(f"s{i}") for i, n in enumerate(names)]
    )
    rows = F.array(
        *[F.struct(F.lit(n).alias("scenario"), F.coalesce(f"s{i}", "old_status").alias("new_status")) for i, n in enumerate(names)]
    )
    return wide.select("profile_id", "scheme_id", "old_status", F.inline(rows))


def join_results(current: DataFrame, hypothetical: DataFrame) -> DataFrame:
    """Align two result tables; a scheme missing on one side counts as INELIGIBLE."""
    old = current.select("profile_id", "scheme_id", F.col("status").alias("old_status"))
    new = hypothetical.select("profile_id", "scheme_id", F.col("status").alias("new_status"))
    return old.join(new, ["profile_id", "scheme_id"], "full_outer").withColumns(
        {c: F.coalesce(c, F.lit("INELIGIBLE")) for c in ("old_status", "new_status")}
    )


def change() -> Column:
    """gained / lost / improved / worsened / unchanged; equal ranks of other statuses are none."""
    ranks = F.create_map(*[F.lit(x) for kv in V.STATUS_RANK.items() for x in kv])
    rank = lambda c: F.coalesce(F.try_element_at(ranks, F.col(c)), F.lit(0))
    old, new = rank("old_status"), rank("new_status")
    return (
        F.when(F.col("old_status") == F.col("new_status"), "unchanged")
        .when(new > old, F.when(F.col("new_status") == "ELIGIBLE", "gained").otherwise("improved"))
        .when(new < old, F.when(F.col("old_status") == "ELIGIBLE", "lost").otherwise("worsened"))
        .otherwise("none")
    )


def compare(rows: DataFrame, keys: list[str]) -> DataFrame:
    counted = rows.withColumn("change", change()).groupBy(*keys).agg(
        *[F.count_if(F.col("change") == c).alias(c) for c in ("gained", "lost", "improved", "worsened", "unchanged")],
        F.count_if(F.col("old_status") == "ELIGIBLE").alias("current_eligible"),
        F.count_if(F.col("new_status") == "ELIGIBLE").alias("what_if_eligible"),
    )
    return counted.withColumn(
        "net_impact",
        F.when(F.col("what_if_eligible") > F.col("current_eligible"), "positive")
        .when(F.col("what_if_eligible") < F.col("current_eligible"), "negative")
        .otherwise("neutral"),
    )


def suggestions(profiles: DataFrame, top: int = 3) -> DataFrame:
    """Missing documents worth getting, by stated potential, in listed order on ties."""
    options = F.array_compact(
        F.array(
            *[
                F.when(
                    ~F.coalesce(F.col(model.column_of(f)), F.lit(False)),
                    F.struct((-F.lit(p)).alias("key"), F.lit(i).alias("i"), F.lit(f).alias("field"), F.lit(t).alias("suggestion"), F.lit(p).alias("potential")),
                )
                for i, (f, t, p) in enumerate(V.SUGGESTIONS)
            ]
        )
    )
    best = F.slice(F.array_sort(options), 1, top)
    return profiles.select("profile_id", F.posexplode(best).alias("pos", "s")).select(
        "profile_id", (F.col("pos") + 1).alias("rank"), "s.field", "s.suggestion", "s.potential"
    )
