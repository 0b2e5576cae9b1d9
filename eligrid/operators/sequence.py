"""Application sequencing over the relationship graph of the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eligrid.session import broadcast_if_small, checkpoint

EXCLUDED = ("INELIGIBLE", "DISQUALIFIED")


def numbered(df: DataFrame, column: str, *order: str) -> DataFrame:
    """Rows numbered from one in the given order, without moving them into one task.

    Ranges are sorted side by side and each starts after the rows of the ranges before it; only their sizes meet.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written, because rows must not change their range between the two uses.
    ranged = checkpoint(df.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()))
    # One row per range.
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n")).select(
        "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranged.withColumn("__inside", inside).join(F.broadcast(sizes), "__range").withColumn(
        column, (F.col("__before") + F.col("__inside")).cast("int")
    ).drop("__range", "__inside", "__before")


def rank_edges(edges: DataFrame) -> DataFrame:
    """Prerequisite edges ranked by confidence, then file position, from one."""
    return numbered(edges, "rank", "confidence", "position")


def _heads(node: str, seed: int):
    return F.pmod(F.xxhash64(F.col(node), F.lit(seed)), F.lit(2)) == 1


def cycle_cut(ranked: DataFrame) -> int:
    """How many of the lowest edges must go until no cycle is left: the rank of the weakest edge of the strongest cycle.

    The graph is peeled from both ends for all ranks at once. An edge can lie on a cycle of edges of rank r or more
    only if an edge that enters its source and one that leaves its target are of rank r or more; so each round lowers
    every edge to the best rank of its neighbours on either side, and an edge without one goes. Edges of the strongest
    cycle are never lowered below its weakest rank, and where a round lowers nothing the best rank left is that of a
    cycle. Chains are shortened meanwhile: a node with one edge in and one out is replaced by an edge of the lower rank
    (a coin per node and round picks nodes that are not neighbours), which turns a ring into a loop in a logarithmic
    number of rounds. A loop proves a cycle, and edges of no better rank go as well. No table has more rows than twice the
    edges; rounds follow the depth that is left once chains are shortened.
    """
    best = lambda df: df.groupBy("src", "dst").agg(F.max("r").alias("r"))
    edges = checkpoint(best(ranked.select("src", "dst", F.col("rank").alias("r"))))
    proven, before, turn = 0, None, 0
    while True:
        loop = F.col("src") == F.col("dst")
        facts = edges.agg(
            F.count("*").alias("n"), F.sum("r").alias("total"), F.max("r").alias("top"), F.max(F.when(loop, F.col("r"))).alias("loop")
        ).first()
        proven = max(proven, facts["loop"] or 0)
        if (facts["top"] or 0) <= proven:
            return proven
        if (facts["n"], facts["total"]) == before:
            return facts["top"]
        before = facts["n"], facts["total"]
        turn += 1
        live = edges.where(F.col("r") > proven)
        ends = live.select(
            F.explode(
                F.array(
                    F.struct(F.col("src").alias("node"), F.col("dst").alias("next"), F.lit(None).cast("string").alias("prev"), F.col("r").alias("out"), F.lit(None).cast("int").alias("in")),
                    F.struct(F.col("dst").alias("node"), F.lit(None).cast("string").alias("next"), F.col("src").alias("prev"), F.lit(None).cast("int").alias("out"), F.col("r").alias("in")),
                )
            ).alias("e")
        ).select("e.*")
        nodes = ends.groupBy("node").agg(
            F.max("in").alias("in"), F.max("out").alias("out"), F.count("in").alias("n_in"), F.count("out").alias("n_out"),
            F.max("prev").alias("prev"), F.max("next").alias("next"),
        )
        skipped = (F.col("n_in") == 1) & (F.col("n_out") == 1) & (F.col("prev") != F.col("node")) & _heads("node", turn) & ~_heads("prev", turn)
        nodes = nodes.withColumn("skipped", skipped)
        source = nodes.select(F.col("node").alias("src"), F.col("in").alias("above"), F.col("skipped").alias("src_skipped"))
        target = nodes.select(F.col("node").alias("dst"), F.col("out").alias("below"), F.col("skipped").alias("dst_skipped"), F.col("next").alias("beyond"))
        # A missing neighbour is a null rank: that edge is peeled.
        lowered = (
            live.join(source, "src").join(target, "dst")
            .where("above IS NOT NULL AND below IS NOT NULL AND NOT src_skipped")
            .select("src", F.when(F.col("dst_skipped"), F.col("beyond")).otherwise(F.col("dst")).alias("dst"), F.least("r", "above", "below").alias("r"))
        )
        edges = checkpoint(best(lowered))


def break_cycles(edges: DataFrame) -> DataFrame:
    """Edges with `removed` set on those dropped to make the graph acyclic."""
    ranked = checkpoint(rank_edges(edges))
    return ranked.withColumn("removed", F.col("rank") <= cycle_cut(ranked))


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Longest-path level per node of an acyclic edge set; each round follows only the edges of nodes just raised."""
    current = checkpoint(nodes.select("scheme_id").distinct().withColumn("level", F.lit(0)).withColumn("raised", F.lit(True)))
    arcs = checkpoint(edges.select("src", "dst").distinct())
    while True:
        pushed = (
            current.where("raised").join(arcs, F.col("scheme_id") == F.col("src"))
            .groupBy(F.col("dst").alias("scheme_id"))
            .agg((F.max("level") + 1).alias("from_src"))
        )
        better = F.coalesce(F.col("from_src") > F.col("level"), F.lit(False))
        now = checkpoint(
            current.join(pushed, "scheme_id", "left").select(
                "scheme_id", F.when(better, F.col("from_src")).otherwise(F.col("level")).alias("level"), better.alias("raised")
            )
        )
        if not now.where("raised").head(1):
            return now.select("scheme_id", "level")
        current = now


def steps(dets: DataFrame, ordered: DataFrame, edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """Numbered application steps per profile.

    Levels come from the whole acyclic graph once; any subset of a topological
    order is one too, so a profile only filters and numbers. Profiles are dealt over
    `tasks`, if given: what follows costs more than the few bytes of its rows show.
    """
    sources = edges.groupBy(F.col("dst").alias("scheme_id")).agg(
        F.array_sort(F.collect_set("src")).alias("sources")
    )
    dim = ordered.join(sources, "scheme_id", "left").withColumn(
        "sources", F.coalesce("sources", F.array().cast("array<string>"))
    )
    confidence = F.when(F.col("composite") == 0, 1.0).otherwise(F.col("composite"))
    rows = dets.where(~F.col("status").isin(*EXCLUDED)).select(
        "profile_id", "scheme_id", "status", confidence.alias("confidence")
    )
    placed = rows.join(broadcast_if_small(dim), "scheme_id")
    per_profile = (placed.repartition(tasks, "profile_id") if tasks else placed).groupBy("profile_id").agg(
        F.array_sort(F.collect_list(F.struct("level", "scheme_id", "status", "confidence", "sources"))).alias("s")
    )
    ids = F.transform("s", lambda x: x["scheme_id"])
    return per_profile.withColumn("ids", ids).select(
        "profile_id", F.posexplode("s").alias("pos", "x"), "ids"
    ).select(
        "profile_id", (F.col("pos") + 1).alias("step"), "x.scheme_id", "x.status", "x.confidence", "x.level",
        F.array_intersect("x.sources", "ids").alias("depends_on"),
    )


PARALLEL_STATE = "struct<rows:array<struct<id:string,first:int,groups:array<int>>>,opened:array<int>>"


def parallel_groups(stepped: DataFrame, edges: DataFrame) -> DataFrame:
    """Groups of steps that may run side by side, without listing pairs.

    The pairwise greedy merge is a fold over the ordered steps: a step joins every
    group that holds, as its owner group, an earlier step it has no prerequisite
    edge with. `opened[g]` counts the steps whose first group is g, so membership is
    a comparison of counts with the few neighbours of a step.
    """
    both = edges.select(F.col("src").alias("scheme_id"), F.col("dst").alias("near")).union(
        edges.select("dst", "src")
    )
    near = both.groupBy("scheme_id").agg(F.collect_set("near").alias("near"))
    per_profile = (
        stepped.join(broadcast_if_small(near), "scheme_id", "left")
        .groupBy("profile_id")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("step", "scheme_id", F.coalesce("near", F.array().cast("array<string>")).alias("near"))
                )
            ).alias("s")
        )
    )
    ids = F.transform("s", lambda x: x["scheme_id"])
    count = F.size("s")

    def advance(acc: Column, x: Column) -> Column:
        touching = F.filter(acc["rows"], lambda r: F.array_contains(x["near"], r["id"]))
        owned_by_neighbours = lambda g: F.size(F.filter(touching, lambda r: r["first"] == g))
        joins = F.filter(
            F.transform(acc["opened"], lambda n, g: F.when(n > owned_by_neighbours(g), g)), lambda g: g.isNotNull()
        )
        # Steps after this one it has no edge with; without any it opens nothing.
        after = count - x["step"] - F.size(
            F.array_intersect(x["near"], F.slice(ids, x["step"] + 1, F.greatest(count - x["step"], F.lit(0))))
        )
        opens = (F.size(joins) == 0) & (after > 0)
        fresh = F.size(acc["opened"])
        first = F.when(F.size(joins) > 0, joins[0]).when(opens, fresh)
        groups = F.when(opens, F.array(fresh)).otherwise(joins)
        # Only a step with a later partner adds members to its group.
        counted = F.when(
            opens, F.concat(acc["opened"], F.array(F.lit(1)))
        ).otherwise(
            F.transform(acc["opened"], lambda n, g: F.when(g == first, n + 1).otherwise(n))
        )
        return F.struct(
            F.concat(
                acc["rows"],
                F.array(F.struct(x["scheme_id"].alias("id"), first.cast("int").alias("first"), groups.cast("array<int>").alias("groups"))),
            ).alias("rows"),
            counted.cast("array<int>").alias("opened"),
        ).cast(PARALLEL_STATE)

    start = F.struct(
        F.array().cast("array<struct<id:string,first:int,groups:array<int>>>").alias("rows"),
        F.array().cast("array<int>").alias("opened"),
    ).cast(PARALLEL_STATE)
    folded = per_profile.select("profile_id", F.aggregate("s", start, advance).alias("state"))
    return (
        folded.select("profile_id", F.posexplode("state.rows").alias("pos", "r"))
        .select("profile_id", "pos", F.col("r.id").alias("scheme_id"), F.explode("r.groups").alias("group_no"))
    )


def choice_sets(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Mutually exclusive pairs once each; the id counts repeated pairs too."""
    ids = known.select("scheme_id")
    exclusive = (
        edges.where("relationship_type = 'MUTUAL_EXCLUSION'")
        .join(ids.withColumnRenamed("scheme_id", "scheme_a"), "scheme_a", "left_semi")
        .join(ids.withColumnRenamed("scheme_id", "scheme_b"), "scheme_b", "left_semi")
    )
    counted = numbered(exclusive, "n", "position")
    lo, hi = F.least("scheme_a", "scheme_b"), F.greatest("scheme_a", "scheme_b")
    return counted.groupBy(lo.alias("lo"), hi.alias("hi")).agg(
        F.min_by(F.struct("scheme_a", "scheme_b"), "n").alias("pair"), F.min("n").alias("n")
    ).select(
        F.concat(F.lit("CS-"), F.lpad(F.col("n").cast("string"), 3, "0")).alias("choice_set_id"),
        "pair.scheme_a", "pair.scheme_b",
    )


def complementary(edges: DataFrame, schemes: DataFrame) -> DataFrame:
    """Ordered complementary pairs once each, named where the scheme is known."""
    names = schemes.select("scheme_id", "scheme_name")
    pairs = edges.where("relationship_type = 'COMPLEMENTARY'").select("scheme_a", "scheme_b").distinct()
    a = names.select(F.col("scheme_id").alias("scheme_a"), F.col("scheme_name").alias("name_a"))
    b = names.select(F.col("scheme_id").alias("scheme_b"), F.col("scheme_name").alias("name_b"))
    return pairs.join(a, "scheme_a", "left").join(b, "scheme_b", "left").select(
        "scheme_a", "scheme_b",
        F.concat(
            F.lit("If you are applying for "), F.coalesce("name_a", "scheme_a"), F.lit(", also consider "),
            F.coalesce("name_b", "scheme_b"),
            F.lit(" — these schemes complement each other and can be held simultaneously."),
        ).alias("rationale"),
    )
