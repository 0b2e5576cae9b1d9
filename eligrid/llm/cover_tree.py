"""Embedding near-dedup by dual traversal of cover trees: exact pairs of equal label with cosine >= a threshold.

On unit vectors a cosine limit c is a distance limit sqrt(2 - 2c). Equal vectors are one class. Classes of a label
are dealt to the nearest of a few pivots (the top of a nested net over a bounded sample; large labels only) and cells
are cut into blocks of at most BLOCK classes. A pair of blocks meets in one task unless the covering radii of their
cells rule every link out. There each block becomes a cover tree, nested levels with halving radii, and both trees
are descended together: a node pair is dropped when its distance exceeds both covering radii plus the limit. What is
left is compared in double precision.

A task returns a count per vector and a star per local component, never pairs. Neither pivots nor blocks change the
result. Without structure in the data no bound can prune and the work is that of all blocks of a label against each
other; memory stays that of two blocks.

Defined results: null labels, null vectors, vectors with null or non-finite components and zero vectors link with
nothing and are their own component; very small and very large components count like others, as every vector is
scaled by a power of two first; vectors of one label but different length do not link. Null vec_ids take part,
a component's id is the smallest that is not null. Repeated vec_ids are separate rows. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligrid.llm.common import components, stored
from eligrid.session import broadcast_if_small

BLOCK = 1024
PIVOTS = 256
# Values (classes x dimensions) in the sample that pivots come from.
SAMPLE_VALUES = 1 << 20


def scaled(vectors):
    """Vectors times a power of two each, so that squares neither underflow nor overflow; cosines stay bit for bit."""
    import numpy as np

    x = np.asarray(vectors, np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def unit(vectors):
    import numpy as np

    x = scaled(vectors)
    return x / np.sqrt((x * x).sum(1))[:, None]


def distances(a, b):
    import numpy as np

    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def cover_tree(x, smallest):
    """Levels from the root down: (centre rows, parent in the level above, covering radius) and the leaf of each row.

    Level k is a net of radius 2 / 2^k inside every node above; a centre stays a centre on all deeper levels.
    """
    import numpy as np

    centres, parents = np.zeros(1, np.int64), np.zeros(1, np.int64)
    groups = [np.arange(len(x))]
    spans = [distances(x, x[:1]).max()]
    levels = [(centres, parents, np.array(spans))]
    radius = 2.0
    while radius > smallest and max(map(len, groups)) > 1:
        radius /= 2
        next_centres, next_parents, next_groups, next_spans = [], [], [], []
        for node, (centre, rows, span) in enumerate(zip(centres, groups, spans)):
            if len(rows) == 1 or span <= radius:
                next_centres.append(centre)
                next_parents.append(node)
                next_groups.append(rows)
                next_spans.append(span)
                continue
            pick = centre
            while len(rows):
                far = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x[rows] @ x[pick])))
                near = far <= radius
                near |= rows == pick
                next_centres.append(pick)
                next_parents.append(node)
                next_groups.append(rows[near])
                next_spans.append(far[near].max())
                rows = rows[~near]
                pick = rows[0] if len(rows) else pick
        centres, groups, spans = np.array(next_centres), next_groups, next_spans
        levels.append((centres, np.array(next_parents), np.array(spans)))
    leaf = np.empty(len(x), np.int64)
    for node, rows in enumerate(groups):
        leaf[rows] = node
    return levels, leaf


def dual_pairs(x, y, cosine, same):
    """Row pairs (i, j) with cosine at or above the limit; for same, both orders and no row with itself."""
    import numpy as np

    limit = math.sqrt(max(0.0, 2.0 - 2.0 * cosine)) + 1e-7
    tree_x = cover_tree(x, limit / 4)
    tree_y = tree_x if same else cover_tree(y, limit / 4)
    deep = max(len(tree_x[0]), len(tree_y[0]))
    live = np.ones((1, 1), bool)
    for level in range(deep):
        sides = []
        for tree, rows in ((tree_x, x), (tree_y, y)):
            if level < len(tree[0]):
                centres, parents, spans = tree[0][level]
            else:
                centres, _, spans = tree[0][-1]
                parents = np.arange(len(centres))
            sides.append((rows[centres], parents, spans))
        (cx, px, rx), (cy, py, ry) = sides
        live = live[px][:, py]
        live &= distances(cx, cy) <= rx[:, None] + ry[None, :] + limit
        if not live.any():
            return np.zeros((0, 2), np.int64)
    rows, cols = np.flatnonzero(live.any(1)[tree_x[1]]), np.flatnonzero(live.any(0)[tree_y[1]])
    close = live[tree_x[1][rows]][:, tree_y[1][cols]]
    close &= x[rows] @ y[cols].T >= cosine - 1e-9
    i, j = np.nonzero(close)
    i, j = rows[i], cols[j]
    if same:
        i, j = i[i != j], j[i != j]
    return np.stack((i, j), 1)


def _block_pair(cosine):
    def run(table):
        import numpy as np
        import pyarrow as pa

        side = table.column("side").to_numpy()
        cls, copies = table.column("cls").to_numpy(), table.column("copies").to_numpy()
        raw = np.array(table.column("vector").combine_chunks().flatten().to_numpy(), np.float64).reshape(len(table), -1)
        order = np.lexsort((cls, side))
        side, cls, copies, raw = side[order], cls[order], copies[order], raw[order]
        n = int((side == 0).sum())
        same = n == len(side)
        raw = scaled(raw)
        x = unit(raw)
        pairs = dual_pairs(x[:n], x[:n] if same else x[n:], cosine, same)
        i, j = pairs[:, 0], pairs[:, 1] + (0 if same else n)
        # The final word is the cosine itself in double precision.
        lengths = np.sqrt((raw * raw).sum(1))
        exact = np.zeros(len(i), bool)
        for at in range(0, len(i), 1 << 16):
            a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            exact[at : at + (1 << 16)] = (raw[a] * raw[b]).sum(1) / (lengths[a] * lengths[b]) >= cosine
        i, j = i[exact], j[exact]
        links = np.bincount(i, copies[j], len(cls)).astype(np.int64)
        if not same:
            links += np.bincount(j, copies[i], len(cls)).astype(np.int64)
        head = cls.copy()
        while len(i):
            before = head.copy()
            np.minimum.at(head, i, before[j])
            np.minimum.at(head, j, before[i])
            if (head == before).all():
                break
        hit = links > 0
        return pa.table({"cls": pa.array(cls[hit]), "links": pa.array(links[hit]), "head": pa.array(head[hit])})

    return run


def pivots_of(sample, most):
    """At most `most` pivots: centres of the nested net over the sample, level by level, so that prefixes are nets too."""
    import numpy as np

    if not len(sample):
        return np.zeros((0, 0))
    levels, _ = cover_tree(unit(sample), 0.25)
    order = list(dict.fromkeys(int(c) for centres, _, _ in levels for c in centres))
    return unit(sample)[order[:most]]


def near_duplicates(
    vectors: DataFrame,
    cosine: float = 0.98,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    block: int = BLOCK,
    most_pivots: int = PIVOTS,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    import numpy as np

    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector")
    )
    finite = F.forall("vector", lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf"))) & ~F.isnan(v))
    usable = F.col("label").isNotNull() & F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists("vector", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("cls", F.when(usable, F.xxhash64("label", "vector")))
    classes = stored(
        rows.filter("cls IS NOT NULL").groupBy("cls", "label", "vector").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies")), "cover-classes"
    )
    if classes.groupBy("cls").count().filter("count > 1").head(1):
        raise ValueError("two different vectors share a 64-bit digest")
    classes = classes.withColumn("dim", F.size("vector"))
    sizes = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).withColumn("cells", F.least(F.lit(most_pivots), F.ceil(F.col("n") / block)).cast("int"))
    sizes = stored(sizes, "cover-sizes")
    # Pivots per vector length, from a bounded sample of labels that need more than one cell.
    large = sizes.filter("cells > 1")
    nets = {}
    for r in large.select("dim").distinct().limit(16).collect():
        dim = r["dim"]
        some = classes.filter(F.col("dim") == dim).join(F.broadcast(large.filter(F.col("dim") == dim).select("label").limit(100_000)), "label", "left_semi")
        take = max(most_pivots, min(8192, SAMPLE_VALUES // dim))
        picked = some.select("vector", F.xxhash64("cls").alias("h")).orderBy("h").limit(take).collect()
        nets[dim] = pivots_of(np.array([p["vector"] for p in picked], np.float64), most_pivots)

    def cells(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for dim, count, vector in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("dim", "cells", "vector"))):
                net = nets.get(dim)
                if count <= 1 or net is None or not len(net):
                    out.append((0, 4.0))
                else:
                    far = distances(unit([vector]), net[:count])[0]
                    out.append((int(far.argmin()), float(far.min())))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in ("cls", "label", "dim", "copies", "vector")), pa.array([c for c, _ in out], pa.int32()), pa.array([d for _, d in out], pa.float64())],
                ["cls", "label", "dim", "copies", "vector", "cell", "far"],
            )

    dealt = classes.join(broadcast_if_small(sizes.select("label", "dim", "cells"), written=True), ["label", "dim"]).select("cls", "label", "dim", "copies", "vector", "cells")
    dealt = stored(dealt.mapInArrow(cells, "cls long, label string, dim int, copies long, vector array<double>, cell int, far double"), "cover-cells")
    spans = dealt.groupBy("label", "dim", "cell").agg(F.max("far").alias("span"), F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    spans = stored(spans, "cover-spans")
    blocks = spans.select("label", "dim", "cell", "span", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    apart = [(int(d), a, b, float(m[a, b])) for d, net in nets.items() for m in (distances(net, net),) for a in range(len(net)) for b in range(len(net))]
    gaps = spark.createDataFrame(apart or [(0, 0, 0, 0.0)], "dim int, cell int, cell2 int, gap double")  # at most 16 * PIVOTS^2 rows
    limit = math.sqrt(max(0.0, 2.0 - 2.0 * cosine)) + 1e-6
    right = blocks.select("label", "dim", F.col("cell").alias("cell2"), F.col("span").alias("span2"), F.col("block").alias("block2"))
    met = (
        blocks.join(right, ["label", "dim"])
        .filter("cell < cell2 OR cell = cell2 AND block <= block2")
        .join(F.broadcast(gaps), ["dim", "cell", "cell2"], "left")
        .filter((F.col("cell") == F.col("cell2")) | F.col("gap").isNull() | (F.col("gap") <= F.col("span") + F.col("span2") + limit))
        .withColumn("pair", F.concat_ws("/", "label", "dim", "cell", "block", "cell2", "block2"))
    )
    one = met.select("pair", "label", "dim", "cell", "block", F.lit(0).alias("side"))
    two = met.filter("cell <> cell2 OR block <> block2").select("pair", "label", "dim", F.col("cell2").alias("cell"), F.col("block2").alias("block"), F.lit(1).alias("side"))
    placed = dealt.join(broadcast_if_small(spans.select("label", "dim", "cell", "blocks"), written=True), ["label", "dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("cls", F.lit(7)), F.col("blocks")).cast("int"))
    found = (
        placed.join(one.union(two), ["label", "dim", "cell", "block"])
        .select("pair", "side", "cls", "copies", "vector")
        .groupBy("pair")
        .applyInArrow(_block_pair(cosine), "cls long, links long, head long")
    )
    found = stored(found, "cover-links")
    stars = components(found.filter("cls <> head").select(F.col("cls").alias("a"), F.col("head").alias("b"))).toDF("cls", "component")
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    groups = classes.select("cls", "low", "copies").join(stars, "cls", "left").join(counts, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    groups = stored(groups, "cover-groups")
    lowest = groups.groupBy("component").agg(F.min("low").alias("component_id"))
    members = groups.join(lowest, "component").select("cls", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    linked = rows.filter("cls IS NOT NULL").select("vec_id", "cls").join(members, "cls").select("vec_id", "n_links", "component_id")
    alone = rows.filter("cls IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
