"""Exact dedup by Golomb-coded fingerprint exchange.

Each source block (a bounded run of rows of one scan task) sorts its distinct fingerprints and sends every owner of a
fingerprint range one Golomb-Rice coded list. Owners answer with a bitmap per block: which fingerprints exist in
another block too. Only rows with such a fingerprint, or one that repeats inside their block, are suspects; their
texts alone are shuffled and compared byte by byte.

Defined results: null text counts as empty, and empty texts are equal to each other. Null doc_id ranks below every
other. Rows that repeat both doc_id and text are a group like any other, of which exactly one row is kept. An empty
table gives an empty result. Other columns are neither read nor returned.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligrid.llm.common import lower_ascii, stored
from eligrid.session import broadcast_if_small

# Rows of one source block, and fingerprints of one owner: what a task holds at once.
BLOCK_ROWS = 1 << 17
OWNER_FINGERPRINTS = 1 << 21
# Bytes of suspect ids (as JSON, some 16 an id) that are still broadcast.
SOUGHT_BYTES = 64 << 20
# Extra fingerprint bits beyond log2(rows): about one row in 2**SPARE_BITS is a false suspect.
SPARE_BITS = 10

BLOCKS = (
    "src long, owner int, n int, k int, unary binary, rest binary, "
    "ids array<bigint>, digests binary, repeats binary"
)


def rice_encode(gaps):
    """(k, unary bits, remainder bits) of non-negative gaps; Golomb code with a power of two as divisor."""
    import numpy as np

    k = max(0, int(math.log2(max(1.0, float(gaps.mean()) * math.log(2))))) if len(gaps) else 0
    high = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(high + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    unary[ends] = 1
    shifts = np.arange(k, dtype=np.uint64)
    low = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return k, np.packbits(unary).tobytes(), np.packbits(low.ravel()).tobytes()


def rice_decode(n, k, unary, rest):
    """The gaps again."""
    import numpy as np

    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    high = np.diff(ends, prepend=-1) - 1
    low = np.unpackbits(np.frombuffer(rest, np.uint8))[: n * k].reshape(n, k).astype(np.uint64)
    return (high.astype(np.uint64) << np.uint64(k)) | (low << np.arange(k, dtype=np.uint64)).sum(1, dtype=np.uint64)


def _source(bits, owners, block_rows):
    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        ids, digests = [], []
        state = {"block": 0}

        def flush():
            src = (TaskContext.get().partitionId() << 24) | state["block"]
            state["block"] += 1
            sha = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)
            prints = sha[:, :8].copy().view(">u8").ravel().astype(np.uint64) >> np.uint64(64 - bits)
            order = np.lexsort((*sha.T[::-1], prints))
            prints, sha, own = prints[order], sha[order], [ids[i] for i in order]
            owner = ((prints * np.uint64(owners)) >> np.uint64(bits)).astype(np.int64)
            cuts = np.searchsorted(owner, np.arange(owners + 1))
            rows = []
            for o in np.unique(owner):
                a, b = int(cuts[o]), int(cuts[o + 1])
                distinct, first = np.unique(prints[a:b], return_index=True)
                counts = np.diff(np.append(first, b - a)).astype("<u4")
                k, unary, rest = rice_encode(np.diff(distinct, prepend=np.uint64(0)))
                rows.append((src, int(o), len(distinct), k, unary, rest, own[a:b], sha[a:b].tobytes(), counts.tobytes()))
            ids.clear()
            digests.clear()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[i] for r in rows], t)
                    for i, t in enumerate(
                        (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary())
                    )
                ],
                ["src", "owner", "n", "k", "unary", "rest", "ids", "digests", "repeats"],
            )

        for batch in batches:
            ids_in, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            for doc_id, text in zip(ids_in, texts):
                ids.append(doc_id)
                digests.append(hashlib.sha256((text.as_py() or b"").lower()).digest())
                if len(ids) >= block_rows:
                    yield flush()
        if ids:
            yield flush()

    return run


def _answer(table):
    """Owner side: per source block, which of its fingerprints another block has as well."""
    import numpy as np
    import pyarrow as pa

    rows = table.to_pylist()
    lists = [np.cumsum(rice_decode(r["n"], r["k"], r["unary"], r["rest"]), dtype=np.uint64) for r in rows]
    every, place, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    shared, at, bitmaps = counts[place] > 1, 0, []
    for part in lists:
        bitmaps.append(np.packbits(shared[at : at + len(part)]).tobytes())
        at += len(part)
    return pa.table(
        {
            "src": pa.array([r["src"] for r in rows], pa.int64()),
            "owner": pa.array([r["owner"] for r in rows], pa.int32()),
            "bitmap": pa.array(bitmaps, pa.binary()),
        }
    )


def _rows(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for r in batch.to_pylist():
            repeats = np.frombuffer(r["repeats"], "<u4")
            flags = np.unpackbits(np.frombuffer(r["bitmap"], np.uint8))[: r["n"]].astype(bool) | (repeats > 1)
            sha, n = r["digests"].hex(), len(r["ids"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(r["ids"], pa.int64()),
                    pa.array([f"{r['src']:016x}-{r['owner']:08x}-{i:08x}" for i in range(n)]),
                    pa.array([sha[i * 64 : i * 64 + 64] for i in range(n)]),
                    pa.array(np.repeat(flags, repeats)),
                ],
                ["doc_id", "row_id", "text_sha256", "suspect"],
            )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, suspect."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = docs.count()
    bits = min(60, max(8, math.ceil(math.log2(total + 1)) + SPARE_BITS))
    owners = min(1 << 15, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // OWNER_FINGERPRINTS + 1))
    # Text is read once here; digests, ids and coded lists stay in a written table, so later steps and
    # recomputed tasks all see the same blocks.
    blocks = stored(docs.mapInArrow(_source(min(bits, 60), owners, block_rows), BLOCKS), "dedup-blocks")
    answers = blocks.select("src", "owner", "n", "k", "unary", "rest").groupBy("owner").applyInArrow(_answer, "src long, owner int, bitmap binary")
    rows = (
        blocks.select("src", "owner", "n", "ids", "digests", "repeats")
        .join(answers, ["src", "owner"])
        .mapInArrow(_rows, "doc_id long, row_id string, text_sha256 string, suspect boolean")
    )
    rows = stored(rows, "dedup-rows")
    suspects = rows.filter("suspect")
    # Byte verification: the texts of suspects only, equal bytes combined before the shuffle. While the suspects' ids
    # are few, they go to the texts; otherwise both sides are shuffled by id.
    sought = stored(suspects.select(F.col("doc_id").alias("wanted")).distinct(), "dedup-suspects")
    sought = broadcast_if_small(sought, limit=SOUGHT_BYTES, written=True)
    texts = docs.join(sought, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi").select(lower_ascii(F.col("text")).alias("norm"))
    verified = (
        texts.withColumn("text_sha256", F.sha2(F.encode("norm", "UTF-8"), 256))
        .groupBy("text_sha256", "norm")
        .agg(F.count(F.lit(1)).alias("copies"))
        .groupBy("text_sha256")
        .agg(F.count(F.lit(1)).alias("variants"))
    )
    groups = suspects.groupBy("text_sha256").agg(
        F.max(F.struct("doc_id", "row_id")).alias("top"), F.count(F.lit(1)).alias("size")
    )
    groups = groups.join(verified, "text_sha256", "left").select(
        F.col("text_sha256"),
        "size",
        F.when(F.col("variants") == 1, F.col("top"))
        .otherwise(F.raise_error(F.concat(F.lit("texts with one digest differ: "), F.col("text_sha256"))))
        .alias("top"),
    )
    joined = suspects.join(groups, "text_sha256").select(
        "doc_id",
        F.col("top.doc_id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row_id") == F.col("top.row_id")).alias("kept"),
        "text_sha256",
        "suspect",
    )
    alone = rows.filter("not suspect").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "suspect"
    )
    return joined.unionByName(alone)
