"""Decontamination, filter audit and source audit on awkward tables, against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from eligrid.llm import decontamination, filter_audit, source_audit

DOCS = "doc_id long, text string, lang string, source string, n_chars long, item_id int, part string, mask int, words string, hit int, n long, table string, key int"


def documents(spark, rows, parts=3):
    """rows: (doc_id, text, lang, source); the other columns carry names that the operators use themselves."""
    made = spark.createDataFrame([(i, t, lang, src, 1, 2, "p", 3, "w", 4, 5, "t", 6) for i, t, lang, src in rows], DOCS)
    return made.repartition(parts) if rows else made


def as_rows(df):
    return sorted(map(str, map(tuple, df.collect())))


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contaminated(rows, bench):
    windows = defaultdict(set)
    for item, text in bench:
        w = words(text)
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[i : i + k])].add(item)
    out = []
    for doc, text, *_ in rows:
        w = words(text)
        hit, items = set(), set()
        for k in range(1, 11):
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit |= set(range(i, i + k))
                    items |= {x for x in windows[tuple(w[i : i + k])] if x is not None}
        names = ",".join(sorted(map(str, items)))
        out.append((doc, len(w), len(hit), len(items), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(map(str, out))


PASSAGE = "one two three four five six seven eight nine ten eleven twelve"


def leaky():
    rng = random.Random(5)
    filler = lambda n: " ".join(rng.choice("amber birch cedar dune ember fjord".split()) for _ in range(n))
    rows = [
        (1, filler(30) + ". " + PASSAGE.upper() + "! " + filler(10), "en", "a"),
        (2, PASSAGE.replace(" ", "--\n"), "en", "a"),
        (3, " ".join(PASSAGE.split()[:9]), "en", "a"),
        (4, None, "en", None),
        (5, "", None, "a"),
        (5, "?! ...", "en", "a"),
        (None, PASSAGE, "en", "a"),
        (None, PASSAGE, "en", "a"),
        (7, "short item here and SHORT  item", "en", "a"),
        (8, " ".join([PASSAGE] * 40), "en", "a"),
        (9, "Ünïcode ÜNÏCODE ünïcode été 7 8 9", "fr", "a"),
        (10, (filler(20_000) + " " + PASSAGE), "en", "a"),
        (11, "same same " * 400, "en", "a"),
    ]
    bench = [(1, PASSAGE), (2, "short ITEM"), (3, None), (4, "..."), (5, "Ünïcode"), (None, "cedar dune ember fjord amber birch cedar"), (1, PASSAGE), (30, "x " + PASSAGE), (31, "same same same")]
    return rows, bench


@pytest.mark.parametrize("table_bytes", [decontamination.TABLE_BYTES, 300])
def test_contamination_equals_brute_force(spark, table_bytes):
    rows, bench = leaky()
    table = spark.createDataFrame(bench, "item_id long, text string")
    found = decontamination.contamination(documents(spark, rows), table, table_bytes=table_bytes)
    assert as_rows(decontamination.report(found)) == contaminated(rows, bench)


def test_contamination_of_empty_tables(spark):
    rows, bench = leaky()
    table = spark.createDataFrame(bench, "item_id long, text string")
    assert as_rows(decontamination.report(decontamination.contamination(documents(spark, rows), table.limit(0)))) == contaminated(rows, [])
    assert decontamination.contamination(documents(spark, []), table).collect() == []


def test_removal_of_documents_and_spans(spark):
    rows, bench = leaky()
    docs = documents(spark, rows)
    found = decontamination.contamination(docs, spark.createDataFrame(bench, "item_id long, text string"))
    left = decontamination.without_documents(found)
    assert left.columns == docs.columns
    dirty = [r.contaminated for r in decontamination.report(found).collect()]
    assert left.count() == len(rows) - sum(dirty)
    cut = decontamination.without_spans(found)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    again = decontamination.report(decontamination.contamination(cut, spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")))
    assert not any(r.contaminated for r in again.collect())
    text = {r.doc_id: r.text for r in cut.collect()}
    assert text[1] == rows[0][1].replace(PASSAGE.upper() + "! ", "")
    assert text[3] == rows[2][1] and text[4] is None and text[2] == ""
    lead = documents(spark, [(1, "(..) a " + PASSAGE + " b. " + PASSAGE, "en", "s")])
    cut = decontamination.without_spans(decontamination.contamination(lead, spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")))
    assert cut.collect()[0].text == "(..) a b. "


def test_scan_makes_no_shuffle_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    found = decontamination.report(decontamination.contamination(docs, spark.read.parquet(f"{folder}/benchmark.parquet")))
    plan = found._jdf.queryExecution().explainString(found.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    main = plan[plan.index("== Physical Plan ==") : plan.index("FileScan parquet")].split("Subquery")
    assert len(main) > 1 and "Exchange" not in main[0] and "Join" not in main[0]
    # The table reaches the scan inside its expression and is no column of a row.
    assert not re.search(r"#\d+(, \[id=#\d+\])? AS table#", "Subquery".join(main[:2]))


def mask(text):
    x = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", x)
    caps = len(re.findall("[A-Z]", x))
    return (len(w) < 200) + 2 * (100 * len(set(w)) < 50 * len(w)) + 4 * (100 * caps > 2 * len(x)) + 8 * bool(re.search(r"[#$%&*|]", x))


def audited(rows, labels):
    low = {}
    for doc, text, *_ in rows:
        if doc is not None:
            low[text or ""] = min(doc, low.get(text or "", doc))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    bad = {d for d, _, t in labels if t == 1 and d is not None}
    parts = defaultdict(list)
    for doc, text, _, source in rows:
        parts[source or ""].append((mask(text) + 16 * (doc is not None and doc > low[text or ""]), doc in good, doc in bad))
    out = []
    for part, docs in parts.items():
        shapley = Counter()
        steps = []
        for order in permutations(range(5)):
            alive = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in alive if d[0] >> f & 1]
                alive = [d for d in alive if not d[0] >> f & 1]
                fails = sum(d[0] >> f & 1 for d in docs)
                shapley[f] += len(gone)
                steps.append((part, "".join("ABCDE"[i] for i in order), step, len(alive), len(gone), fails - len(gone), sum(d[0] == 1 << f for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone), f))
        out += [(*s[:9], shapley[s[9]]) for s in steps]
    return sorted(map(str, out))


def audited_rows():
    rng = random.Random(2)
    rows = []
    for i in range(120):
        n = rng.choice([0, 1, 150, 199, 200, 260])
        vocabulary = [f"w{k}" for k in range(rng.choice([3, 99, 100, 400]))]
        text = rng.choice([" ", "\n", "\x0b"]).join(rng.choice(vocabulary) for _ in range(n)) + rng.choice(["", "", "#", "ABCDEFGHIJ", "  x", "É"])
        rows.append((i, text, "en", rng.choice(["a", "b", None, ""])))
    rows += [(200 + i, rows[i % 7][1], "en", "hot") for i in range(60)]
    rows += [(3, rows[3][1], "en", "a"), (None, rows[3][1], "en", "a"), (None, rows[3][1], "en", "b"), (None, "only null", "en", None), (500, None, "en", "x"), (501, None, None, "x"), (500, None, "en", "x")]
    rows += [(600, "long " * 100_000, "en", "long"), (601, "Q" * 300_000, "en", "long")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 260, 2)] + [(0, 1, 1), (0, 0, 0), (None, 1, 1)]
    return rows, labels


def test_filter_audit_equals_every_order(spark):
    rows, labels = audited_rows()
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert as_rows(filter_audit.audit(documents(spark, rows), known)) == audited(rows, labels)
    assert filter_audit.audit(documents(spark, []), known).collect() == []
    assert as_rows(filter_audit.audit(documents(spark, rows), known.limit(0))) == audited(rows, [])


def test_gray_walk_visits_every_subset():
    toggles = filter_audit.gray_toggles()
    seen, active = {0}, 0
    for f in toggles:
        active ^= 1 << f
        seen.add(active)
    assert len(toggles) == 31 and seen == set(range(32))
    counts = np.random.default_rng(0).integers(0, 9, (4, 32, 3))
    states = filter_audit.survivors(counts)
    for s in range(32):
        assert (states[:, s] == counts[:, [m for m in range(32) if not m & s]].sum(axis=1)).all()


def test_transducer_is_minimal_and_ordered():
    rng = random.Random(9)
    terms = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 7))) for _ in range(600)} | {"été".encode(), b"a" * 5000})
    machine = source_audit.Transducer.from_bytes(source_audit.Transducer.build(terms).to_bytes())
    assert machine.ordinals(terms).tolist() == list(range(len(terms)))
    assert [machine.term(i) for i in range(len(terms))] == terms
    others = [b"", b"zz", b"a" * 4999, b"a" * 5001, b"abcabcabc"]
    assert machine.ordinals([t for t in others if t not in terms]).tolist() == [-1] * sum(t not in terms for t in others)
    # One state per distinct set of futures.
    futures = {tuple(t[len(p) :] for t in terms if t.startswith(p)) for p in {t[:i] for t in terms for i in range(min(len(t), 9) + 1)}}
    assert len(source_audit.Transducer.build([t for t in terms if len(t) < 9]).final) <= len(futures)
    with pytest.raises(ValueError):
        source_audit.Transducer.build([b"b", b"a"])


def test_shares_are_exact():
    for n, total, terms in [(0, 0, 1), (5, 17, 3), (10**15, 2 * 10**15, 7), (8_999_999_999_999, 8_999_999_999_999, 1)]:
        assert int(source_audit.shares(np.array([n]), np.array([total]), terms)[0]) == 1 + 10**9 * (n + 1) // (total + terms)


def diverged(rows, least=3, top=200):
    docs = [(lang or "", src or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for _, t, lang, src in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for own, _, w in docs if own == lang for t in set(w))
        kept = sorted((t for t, n in df.items() if n >= least), key=lambda t: t.encode())
        sources = sorted({s for own, s, _ in docs if own == lang}, key=str.encode)
        n = {s: Counter(t for own, src, w in docs if own == lang and src == s for t in w if df[t] >= least) for s in sources}
        whole = sum(n.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))
        f = lambda p, q: (p - q) ** 2 // q
        for s in sources:
            pairs = [(-sum(f(share(n[s], t), share(n[o], t)) for t in kept), o.encode(), o) for o in sources if o != s]
            out += [(lang, s, "pair", o, -v, r) for r, (v, _, o) in enumerate(sorted(pairs), 1)]
            best = [(-f(share(n[s], t), share(whole, t)), t.encode(), t) for t in kept if n[s][t] and share(n[s], t) > share(whole, t)]
            out += [(lang, s, "term", t, -v, r) for r, (v, _, t) in enumerate(sorted(best)[:top], 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize("shard_terms,round_bytes,cells,flush", [(500_000, 64 << 20, 1 << 20, 200_000), (5, 900, 40, 30)])
def test_divergence_equals_brute_force(spark, monkeypatch, shard_terms, round_bytes, cells, flush):
    monkeypatch.setattr(source_audit, "ROUND_BYTES", round_bytes)
    monkeypatch.setattr(source_audit.build_shards, "__defaults__", (shard_terms,))
    monkeypatch.setattr(source_audit.compare_blocks, "__defaults__", (cells, source_audit.TOP))
    monkeypatch.setattr(source_audit.document_counts, "__defaults__", (flush,))
    monkeypatch.setattr(source_audit.recount, "__defaults__", (flush, flush))
    rng = random.Random(3)
    vocabulary = ["The", "été", "ÉTÉ", "naïve", "x", "end.", "a1b", "日本", "under_score", "Same", "sAME"] + [f"{a}{b}" for a in "pqrs" for b in "uvwxyz"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 40))), rng.choice(["en", "fr", None]), rng.choice(["hot", "hot", "s1", "s2", None])) for i in range(60)]
    rows += [(1, None, "en", "s1"), (None, "", "de", "only"), (None, "??", "de", "other"), (7, "rare words here", "it", "one"), (8, "long " * 50_000 + "y" * 100_000, "en", "s9"), (8, "y" * 100_000, "en", "s1"), (9, "y" * 100_000, "en", "s2")]
    assert as_rows(source_audit.divergence(documents(spark, rows))) == diverged(rows)


def test_divergence_of_empty_and_termless_tables(spark):
    assert source_audit.divergence(documents(spark, [])).collect() == []
    rows = [(1, "one", "en", "a"), (2, None, "en", "b"), (3, "two", None, None)]
    assert as_rows(source_audit.divergence(documents(spark, rows))) == diverged(rows)


def test_compared_rows_are_flat(spark):
    """A list among the rows of a block would be sized anew with every row; names and totals come as numbers."""
    counts = spark.createDataFrame([("b", "s", 0, 3), ("b", "t", 1, 2), ("a", "s", 0, 5)], "lang string, source string, ordinal long, n long")
    facts = spark.createDataFrame(
        [("a", 1, [("s", 5)]), ("b", 2, [("s", 3), ("t", 2)]), ("c", 0, [("s", 0)])], "lang string, terms long, sources array<struct<source:string,total:long>>"
    )
    made = source_audit.compare_blocks(counts, facts)
    grouped = next(line for line in made._jdf.queryExecution().optimizedPlan().toString().split("\n") if "compare(" in line)
    assert "facts" not in grouped and "lang" not in grouped.split("compare(")[1].split(")")[0]
    p = lambda n, total: 1 + 10**9 * (n + 1) // (total + 2)
    want = sum((p(x, 3) - p(y, 2)) ** 2 // p(y, 2) for x, y in ((3, 0), (0, 2)))
    assert {(r.lang, r.source, r.other): r.value for r in made.collect() if r.ordinal < 0}[("b", 0, 1)] == want
    assert {r.lang for r in made.collect()} <= {"a", "b"}
