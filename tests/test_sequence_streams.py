"""Order-dependent operators against brute force on small fixtures."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eligrid.operators import sequence
from eligrid.streaming import streams


def greedy_groups(order, linked):
    """The pairwise merge, pair by pair."""
    groups = []
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if (a, b) in linked:
                continue
            mine = next((g for g in groups if a in g), None)
            if mine is None:
                mine = [a]
                groups.append(mine)
            if b not in mine:
                mine.append(b)
    return {i: set(g) for i, g in enumerate(groups)}


def test_parallel_groups_match_the_pairwise_merge(spark):
    rng = random.Random(3)
    for _ in range(4):
        names = [f"s{i}" for i in range(7)]
        edges = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < 0.55]
        order = names[:]
        stepped = spark.createDataFrame([(1, i + 1, s) for i, s in enumerate(order)], "profile_id int, step int, scheme_id string")
        arcs = spark.createDataFrame(edges or [("x", "y")], "src string, dst string")
        got = {}
        for r in sequence.parallel_groups(stepped, arcs).collect():
            got.setdefault(r.group_no, set()).add(r.scheme_id)
        linked = set(edges) | {(b, a) for a, b in edges}
        assert got == greedy_groups(order, linked)


def brute_cut(edges):
    def cyclic(es):
        nodes = {n for e in es for n in e}
        while True:
            free = [n for n in nodes if not any(d == n and s in nodes for s, d in es)]
            if not free:
                return bool(nodes)
            nodes -= set(free)

    for k in range(len(edges) + 1):
        if not cyclic(edges[k:]):
            return k


def test_cycle_cut_matches_dropping_edges_one_by_one(spark):
    rng = random.Random(5)
    for _ in range(2):
        pairs = [(f"n{rng.randrange(6)}", f"n{rng.randrange(6)}") for _ in range(9)]
        pairs = [p for p in pairs if p[0] != p[1]]
        rows = [(s, d, i / 10, i) for i, (s, d) in enumerate(pairs)]
        frame = spark.createDataFrame(rows, "src string, dst string, confidence double, position int")
        cut = sequence.break_cycles(frame)
        assert cut.where("removed").count() == brute_cut(pairs)


@pytest.mark.parametrize("seed", range(3))
def test_cycle_cut_on_rings_chains_and_loops(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"r{i}", f"r{(i + 1) % 40}") for i in range(40)] + [(f"c{i}", f"c{i + 1}") for i in range(40)]
    pairs += [(f"r{rng.randrange(40)}", f"c{rng.randrange(40)}") for _ in range(10)] + [(f"c{rng.randrange(40)}", f"r{rng.randrange(40)}") for _ in range(seed)]
    pairs += [("x", "x"), ("y", "z"), ("y", "z")]
    rng.shuffle(pairs)
    rows = [(s, d, rng.choice([0.1, 0.5, 0.9]), i) for i, (s, d) in enumerate(pairs)]
    frame = spark.createDataFrame(rows, "src string, dst string, confidence double, position int")
    cut = sequence.break_cycles(frame)
    order = [(s, d) for s, d, _, _ in sorted(rows, key=lambda r: (r[2], r[3]))]
    assert [(r.src, r.dst) for r in cut.orderBy("rank").collect()] == order
    assert cut.where("removed").count() == brute_cut(order)
    assert sequence.cycle_cut(spark.createDataFrame([], "src string, dst string, rank int")) == 0


def test_cycle_cut_of_many_edges(spark, monkeypatch):
    """A hundred thousand edges, cut known by construction: no table outgrows the edges, few rounds."""
    n, rows = 100_000, []
    made = sequence.checkpoint

    def counted(df):
        kept = made(df)
        rows.append(kept.count())
        return kept

    monkeypatch.setattr(sequence, "checkpoint", counted)
    forward = spark.range(n).select(
        F.concat(F.lit("n"), F.col("id") % 20000).alias("src"),
        F.concat(F.lit("n"), F.col("id") % 20000 + 1500 + F.pmod(F.xxhash64("id"), F.lit(900))).alias("dst"), F.col("id").cast("int").alias("rank"),
    )
    # A ring of 64 nodes beside the acyclic part, its weakest edge of rank 70,000.
    ring = spark.range(64).select(F.concat(F.lit("ring"), "id").alias("src"), F.concat(F.lit("ring"), (F.col("id") + 1) % 64).alias("dst"), (F.col("id") * 7 + 70_000).cast("int").alias("rank"))
    assert sequence.cycle_cut(forward.union(ring)) == 70_000
    assert max(rows) <= n + 64 and len(rows) < 60


def alerts(spark, n=300):
    rng = random.Random(11)
    start, rows = datetime(2024, 1, 1), []
    at = 0.0
    for i in range(n):
        at += rng.choice([0.5, 1.0, 3.0, 4.0, 11.0, 4000.0])
        rows.append((i, start + timedelta(seconds=at), 1, rng.choice(["error", "view"])))
    return rows, spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string")


def brute_sent(rows):
    last, sent = {}, set()
    for event_id, ts, _, kind in rows:
        if kind not in last or (ts - last[kind]).total_seconds() >= 10:
            last[kind] = ts
            sent.add((kind, event_id))
    return sent


def test_suppression_in_batch_and_stream_matches_a_loop(spark, tmp_path):
    rows, frame = alerts(spark)
    want = brute_sent(rows)
    assert {(r.event_type, r.event_id) for r in streams.suppressed_alerts_batch(frame).collect()} == want
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    half = len(rows) // 2
    frame.where(F.col("event_id") < half).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    frame.where(F.col("event_id") >= half).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    source = streams.file_stream(spark, str(tmp_path), "events", files_per_trigger=1)
    out = streams.run_available(streams.suppressed_alerts(source), "test-alerts")
    assert {(r.event_type, r.event_id) for r in out.collect()} == want


def test_suppression_of_files_that_come_newest_first(spark, tmp_path):
    rows, frame = alerts(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    path = str(tmp_path / "events.parquet")
    for part in reversed(range(6)):
        frame.where(F.col("event_id").between(part * 50, part * 50 + 49)).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    source = lambda: streams.file_stream(spark, str(tmp_path), "events", files_per_trigger=1)
    out = streams.run_available(streams.suppressed_alerts(source()), "test-newest-first").collect()
    assert len(out) == len(brute_sent(rows)) and {(r.event_type, r.event_id) for r in out} == brute_sent(rows)
    with pytest.raises(ValueError, match="later than the watermark"):
        streams.run_available(streams.suppressed_alerts(source(), "2 minutes"), "test-late-alerts")


def test_suppression_continues_from_batch_to_batch(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(seconds=3.5 * i), 1, "error") for i in range(90)]
    frame = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    for part in range(3):
        frame.where(F.col("event_id").between(part * 30, part * 30 + 29)).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
        time.sleep(0.05)
    source = streams.file_stream(spark, str(tmp_path), "events", files_per_trigger=1)
    out = streams.run_available(streams.suppressed_alerts(source, "20 seconds"), "test-batches").collect()
    # Several batches released alerts of one burst.
    assert len({r.batch_id for r in out}) > 2
    assert sorted((r.event_type, r.event_id) for r in out) == sorted(brute_sent(rows))


def test_exact_rate_counts_the_last_minute(spark):
    rows, frame = alerts(spark)
    got = {r.event_id: r.n for r in streams.rate_exact(frame, 0).collect()}
    for event_id, ts, _, _ in rows:
        near = sum(1 for _, t, _, _ in rows if timedelta(0) <= ts - t < timedelta(seconds=60))
        assert got[event_id] == near
