"""Nothing vanishes: long sentences, deep profiles, foreign states, broken files, large schemes, late rows."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eligrid import session
from eligrid.operators import ambiguity, decision, mining, profiles, rulebase
from eligrid.sources import feeds, rules as files
from eligrid.streaming import streams
from test_decision import AGE, RULE, people, rule

LONG = "Every household of the area " + "with papers in good order " * 12 + "may be helped at the discretion of the collector"


def test_triggers_after_the_shown_part_of_a_sentence_count(spark):
    texts = spark.createDataFrame([(1, "s", LONG)], "position int, slug string, eligibility string")
    mined = mining.extract_rules(texts)
    row = mined.collect()[0]
    assert len(row.sentence) > 300 and len(row.source_quote) == 200 and "discretion" not in row.source_quote
    codes = {r.code for r in ambiguity.flags(mined).collect()}
    assert codes == set(spark.range(1).select(ambiguity.detect(F.lit(LONG)).alias("c")).collect()[0].c) and codes
    assert all(len(r.ambiguity_id) == 4 + 64 for r in ambiguity.flags(mined).collect())


def test_profiles_of_any_depth(spark):
    lines = spark.createDataFrame([(1, json.dumps({"a": {"b": {"c": {"d": {"e": {"f": 7}}}}, "x": 1}})), (2, "{}")], "profile_id int, value string")
    got = {(r.field, r.number) for r in feeds.described(feeds.nested_profiles(lines)).collect()}
    assert got == {("a.b.c.d.e.f", 7.0), ("a.x", 1.0)}


def test_digest_covers_every_kind_of_column(spark):
    schema = "a string, land double, schemes array<string>, extra string"
    rows = [("x", 1.5, ["p"], None), ("x", 2.5, ["p"], None), ("x", 1.5, ["p", "q"], None), ("x", 1.5, ["p:q"], None), ("x", 1.5, ["p"], "e"), ("x|y", 1.5, ["p"], None)]
    frame = spark.createDataFrame(rows, schema)
    assert frame.select(profiles.profile_hash(frame, frame.columns)).distinct().count() == len(rows)


def bound(spark, rules):
    rules = spark.createDataFrame(rules, RULE)
    schemes = rules.groupBy("scheme_id").agg(F.first("scheme_id").alias("scheme_name")).selectExpr("scheme_id", "scheme_name", "'m' AS ministry", "'active' AS status", "1 AS position")
    queue = spark.createDataFrame([], "rule_id string")
    ready = rulebase.bind(rulebase.active_rules(rulebase.load_ready(rules), schemes, queue))
    return rulebase.nest(schemes, ready, rulebase.exclusions(rules, queue))


@pytest.mark.parametrize("limit", [1 << 28, 0])
def test_a_state_outside_the_list_meets_the_central_rules(spark, limit):
    nested = bound(spark, [rule("A", 1, *AGE)])
    foreign = people(spark).withColumn("state", F.lit("XX"))
    assert decision.meet(foreign, nested, limit).count() == 3


def test_a_scheme_may_have_more_rules_than_sixteen_bits_count(spark):
    one = bound(spark, [rule("A", 1, *AGE)]).where("state = 'UP'")
    many = one.withColumn("rules", F.array_repeat(F.col("rules")[0], 40_000))
    got = {r.profile_id: r for r in decision.determinations(people(spark).where("profile_id < 3"), many).collect()}
    assert got[1].rules_passed == 40_000 and got[1].status == "ELIGIBLE" and got[2].rules_failed == 40_000


def write(path, **docs):
    path.mkdir()
    for name, text in docs.items():
        (path / f"{name}.json").write_text(text)
    return str(path)


def scheme(name, *ids):
    return {"scheme_id": name, "rules": [{"rule_id": i, "field": "f", "operator": "EQ"} for i in ids]}


def test_rule_files(spark, tmp_path):
    path = write(tmp_path / "good", a=json.dumps([scheme("A", "old1", "old2"), scheme("B")]), b=json.dumps(scheme("A", "new")))
    got = {(r.scheme_id, r.rule_id) for r in files.read_rule_base(spark, path).collect()}
    assert got == {("A", "new"), ("B", None)}
    broken = write(tmp_path / "bad", a=json.dumps(scheme("A", "r")), b="{not json")
    assert [r.file_name for r in files.unreadable(spark, broken).collect()] == ["b.json"]
    with pytest.raises(Exception, match="not valid JSON: b.json"):
        files.read_rule_base(spark, broken).collect()


def test_files_in_any_order_lose_no_rows(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    start = datetime(2024, 1, 1)
    for hour in (9, 7, 5, 3, 1):
        rows = [(hour * 10 + i, start + timedelta(hours=hour, seconds=i), 1, "view") for i in range(3)]
        frame = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    source = lambda: streams.file_stream(spark, str(tmp_path), "events", files_per_trigger=1)
    kept = streams.run_available(streams.rate_windows(source(), 1, "10 days"), "wide", "update")
    assert kept.select("window_start").distinct().count() == 5 * 6
    with pytest.raises(ValueError, match="later than the watermark"):
        streams.run_available(streams.rate_windows(source(), 1), "narrow", "update")


def test_late_rows_of_batches_long_past_stop_the_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    for hour in (9, 10, 1, 11, 12, 13):
        frame = spark.createDataFrame([(hour, datetime(2024, 1, 1, hour), 1, "view")], "event_id long, ts timestamp_ntz, user_id long, event_type string")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    source = streams.file_stream(spark, str(tmp_path), "events", files_per_trigger=1)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        with pytest.raises(ValueError, match="later than the watermark"):
            streams.run_available(streams.rate_windows(source, 0), "long-past", "update")
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")


def test_short_ids_that_collide_are_reported(spark):
    rows = [("Pradhan Mantri Awas Yojana Gramin East", "t"), ("Pradhan Mantri Awas Yojana Gramin West", "t"), ("Other", "t")]
    inputs = feeds.parse_inputs(spark.createDataFrame(rows, "scheme_name string, eligibility string"))
    assert [r.names for r in feeds.id_collisions(inputs).collect()] == [2]
    assert inputs.select("scheme_key").distinct().count() == 3


def test_broadcasts_are_bounded_by_bytes(spark):
    wide = spark.range(10).withColumn("x", F.repeat(F.lit("y"), 10_000))
    assert session.measured_bytes(wide) > 100_000 and not session.within_limit(wide, 50_000)
    plan = lambda d: spark.range(3).join(session.broadcast_if_small(d, 50_000), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(spark.range(10)) and "broadcast" not in plan(wide)


def test_listed_values_keep_their_types_and_pipes(spark, tmp_path):
    one = {"scheme_id": "A", "rules": [{"rule_id": "r", "field": "applicant.age", "operator": "IN", "values": ["x|y", 3, True], "ambiguity_flags": [{"ambiguity_id": "AMB-1", "severity": "HIGH"}, "loose"]}]}
    rules = files.read_rule_base(spark, write(tmp_path / "typed", a=json.dumps(one)))
    row = rulebase.bind(rulebase.load_ready(rules), files.flags_of(rules)).collect()[0]
    assert [(i["kind"], i["s"], i["f"]) for i in row["items"]] == [("str", "x|y", None), ("num", "3", 3.0), ("bool", "True", 1.0)]
    assert row["notes"] == ["AMB-1"] and row["high_notes"] == 1
