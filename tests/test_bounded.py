"""Bounded retrieval, anchored matching, file verdicts and trimming against plain Python."""

import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from eligrid.functions.grams import grams
from eligrid.operators import conversation, relationships, retrieval
from eligrid.sources import rules as files


@pytest.mark.parametrize("seed", range(2))
def test_pruned_top_k_equals_full_scores(spark, seed, monkeypatch):
    monkeypatch.setattr(retrieval, "SEED_ROWS", 5)
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 3, 20, 200])))) for i in range(300)] + [(900, ""), (901, None)]
    asked = [(i, " ".join(rng.choices(words, weights, k=12))) for i in range(12)] + [(50, "nothing shared"), (51, words[59])]
    d = spark.createDataFrame(docs, "doc_id int, text string")
    q = retrieval.term_counts(spark.createDataFrame(asked, "item_id int, text string"), "item_id", "text").select("item_id", "term", "c")
    counts = retrieval.term_counts(d, "doc_id", "text")
    index = counts.join(retrieval.idf(counts, d), "term").select("doc_id", "term", "total", (F.col("c") / F.col("total") * F.col("idf")).alias("weight"))
    full = retrieval.top_k(q, index.drop("total"), "item_id", "doc_id", 3)
    pruned = retrieval.top_k_pruned(q, retrieval.blocked(index, F.col("total")).drop("total"), "item_id", "doc_id", 3)
    columns = ["item_id", "doc_id", "score", "rank"]
    assert sorted(map(tuple, pruned.select(*columns).collect())) == sorted(map(tuple, full.select(*columns).collect()))


def test_candidates_stay_far_below_all_pairs(spark, folder):
    """Over the benchmark's passages: pairs that are scored in full, against queries times documents."""
    d = spark.read.parquet(f"{folder.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    q = retrieval.term_counts(spark.read.parquet(f"{folder}/benchmark.parquet"), "item_id", "text").select("item_id", "term", "c")
    counts = retrieval.term_counts(d, "doc_id", "text")
    index = counts.join(retrieval.idf(counts, d), "term").select("doc_id", "term", "total", (F.col("c") / F.col("total") * F.col("idf")).alias("weight"))
    some, _ = retrieval.candidates(q, retrieval.blocked(index, F.col("total")).drop("total"), "item_id", "doc_id", 3)
    assert some.count() < 0.3 * d.count() * q.select("item_id").distinct().count()


@pytest.mark.parametrize("block", [7, 1 << 20])
def test_texts_are_scored_in_place(spark, block, monkeypatch):
    """The rows of the full scores, copies and odd texts included; no pairs and no postings in any exchange."""
    monkeypatch.setattr(retrieval, "BLOCK_SCORES", block)
    rng = random.Random(4)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 3, 20, 200])))) for i in range(300)] + [(900, ""), (901, None), (902, "12 !")]
    docs += [(1000 + i, docs[5][1]) for i in range(50)]
    asked = [(f"q{i}", " ".join(rng.choices(words, weights, k=12))) for i in range(12)] + [("q50", "nothing shared"), ("q51", words[59])]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    q = retrieval.term_counts(spark.createDataFrame(asked, "item_id string, text string"), "item_id", "text").select("item_id", "term", "c")
    full = retrieval.top_k(q, retrieval.postings(d, "doc_id", "text"), "item_id", "doc_id", 3)
    found = retrieval.top_k_of_texts(q, d, "item_id", "doc_id", "text", 3)
    columns = ["item_id", "doc_id", "score", "rank"]
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(map(tuple, full.select(*columns).collect()))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    assert retrieval.top_k_of_texts(q, d, "item_id", "doc_id", "text", 3, limit=0) is None


def test_mentions_by_anchor(spark):
    ids = ["a", "Zq", "brand#1", "Brand#12", "BRAND#123456789", "xbrand#12", "ü-id", "", None, "same", "Same"]
    texts = ["see BRAND#12 now", "nothing", "", None, "brand#123456789", "zq", "Ü-ID", "the SAME", "long " * 20_000 + "xbrand#12", "aaaa"]
    got = relationships.mentions(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(i,) for i in ids], "other string"), "text", "other")
    want = [(t, i) for t in texts for i in ids if i and t is not None and i.lower() in t.lower()]
    assert sorted(map(tuple, got.select("text", "other").collect())) == sorted(want)
    grams = relationships._grams(F.col("text"), 8)
    assert spark.createDataFrame([("ab" * 5000,)], "text string").select(F.size(grams)).first()[0] == 2


def test_exclusions_name_schemes(spark):
    rules = spark.createDataFrame(
        [("S-01", "disqualifying", "x|S-02", "not with s-03"), ("S-02", "eligibility", "S-03", None), ("S-03", "disqualifying", "S-03", "s-01 holders")],
        "scheme_id string, rule_type string, values_text string, value_text string",
    )
    schemes = spark.createDataFrame([("S-01",), ("S-02",), ("S-03",)], "scheme_id string")
    assert sorted(map(tuple, relationships.exclusions(rules, schemes).collect())) == [("S-01", "S-02"), ("S-01", "S-03")]


def test_shared_pairs_list_each_pair_once(spark):
    rng = random.Random(1)
    sets = [(f"s{i}", rng.sample("abcdef", rng.randint(1, 3)), rng.sample("xyz", 1)) for i in range(25)]
    sets += [("t0", ["a", "b"], ["x"]), ("t1", ["b", "a"], ["x"])]
    made = spark.createDataFrame(sets, "scheme_id string, fields array<string>, types array<string>").withColumn("fields", F.array_sort("fields"))
    got = sorted((r.scheme_a, r.scheme_b, round(r.jaccard, 6), round(r.overlap, 6), r.same_benefit) for r in relationships.shared_pairs(made).collect())
    want = []
    for a, fa, ta in sets:
        for b, fb, tb in sets:
            shared = len(set(fa) & set(fb))
            if a < b and shared:
                want.append((a, b, round(min(1.0, 1.2 * shared / (len(fa) + len(fb) - shared)), 6), round(shared / max(len(fa), len(fb)), 6), bool(set(ta) & set(tb))))
    assert got == sorted(want)


def test_name_search_by_grams(spark):
    rng = random.Random(4)
    names = [(f"n{i}", "".join(rng.choice("abAB 1-") for _ in range(rng.randint(0, 14))), rng.choice(["", "ab", None]), i) for i in range(60)]
    queries = [(i, " ".join("".join(rng.choice("ab1") for _ in range(rng.randint(1, 5))) for _ in range(4))) for i in range(30)] + [(99, ""), (98, "zzz")]
    got = retrieval.name_search(
        spark.createDataFrame(queries, "query_id int, text string"), spark.createDataFrame(names, "scheme_id string, scheme_name string, short_name string, position int")
    )
    want = []
    stop = set(retrieval.V.STOP_WORDS)
    for q, text in queries:
        words = {w for w in text.split() if w not in stop}
        hits = [(sum(w in " ".join(x for x in (name, short) if x is not None).lower() for w in words), -p, s) for s, name, short, p in names]
        best = max(hits)
        if best[0]:
            want.append((q, best[2], best[0]))
    assert sorted(map(tuple, got.select("query_id", "scheme_id", "hits").collect())) == sorted(want)
    index = retrieval.name_index(spark.createDataFrame([("x", "q" * 10 + "abcdefghij" * 30, None, 1)], "scheme_id string, scheme_name string, short_name string, position int"))
    assert index.count() <= retrieval.GRAM * 310


def test_broken_list_files_are_named(spark, tmp_path):
    good = spark.range(2500).select(F.format_string("r%05d", "id").alias("relationship_id"), F.lit("a").alias("scheme_a"), F.lit("b").alias("scheme_b"), F.lit("OVERLAP").alias("relationship_type"), F.lit(0.7).alias("confidence"))
    path = f"{tmp_path}/edges"
    files.write_lists(good.coalesce(1), path, "relationships", 1000)
    assert files.verdicts(spark, path, "relationships").count() == 3
    assert files.read_relationships(spark, path).count() == 2500
    (tmp_path / "edges" / "torn.json").write_text('{"relationships": [')
    (tmp_path / "edges" / "other.json").write_text('{"edges": []}')
    bad = {r.file_name: r.reason for r in files.verdicts(spark, path, "relationships").where("verdict = 'rejected'").collect()}
    assert bad == {"torn.json": "not valid JSON", "other.json": "no list and no list under relationships"}
    for read in (files.read_relationships, files.read_flags, files.read_queue):
        with pytest.raises(PySparkException, match="torn.json|other.json|part-"):
            read(spark, path).collect()
    assert files.read_relationships(spark, path, strict=False).count() == 2500


def test_trim_keeps_turns_that_share_a_number(spark):
    rows = [("a", 1, "user", "x")] * 3 + [("a", 2, "user", "y"), ("a", 2, "assistant", "z")]
    rows += [("b", 1, "user", f"m{i}") for i in range(9)] + [("c", i, "user", "t") for i in range(7)] + [(None, 1, None, "q")] * 7 + [("d", None, "user", "n")] * 8
    got = conversation.trim(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).groupBy("conv_id").count().collect()
    assert {r.conv_id: r["count"] for r in got} == {"a": 5, "b": 7, "c": 7, None: 7, "d": 7}
    assert math.isclose(sum(r["count"] for r in got), 33)


def test_grams_are_all_substrings(spark):
    rng = random.Random(6)
    texts = ["", None, "ab", "x" * 255, "y\n" * 128, "".join(rng.choice("abcé😀\n") for _ in range(600)), "z" * 257, "q" * 512 + "r"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    for size in (1, 2, 8):
        for row in frame.select("t", grams(F.col("t"), size).alias("g")).collect():
            t = row.t or ""
            assert row.g == [t[i : i + size] for i in range(len(t) - size + 1)]
    # Linear in the text: a million characters in seconds.
    assert spark.range(1).select(F.size(grams(F.repeat(F.lit("abcdefghij"), 100_000), 8))).first()[0] == 1_000_000 - 7
