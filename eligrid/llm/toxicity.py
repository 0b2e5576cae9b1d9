"""Toxicity by weak supervision: many voters, a generative label model over them, a linear classifier on its posteriors.

Voters are a fixed lexicon of insults, a repeated-insult and a second-person pattern, and patterns mined from the
labelled rows: whole words, word beginnings, and beginnings that several distinct words of a text share, which toxic
texts hold and clean ones do not. The label model treats votes as emissions of a hidden class, estimates each voter's
rates by expectation maximisation and the correlations of voters given the class, and discounts voters that say the
same thing. A logistic regression over the mined patterns is trained on the posteriors and scores every text.

Only rows whose crc32(doc_id as text) mod 5 is not 0 teach anything. The fit reads at most TRAIN_ROWS labelled rows
(the smallest by hash); scoring reads every whole text. Labels, lang, source and doc_id are not inputs of a score.

Defined results: null and empty texts fire no voter and get the score of such a text; a null doc_id counts as held
out; rows of documents that share a doc_id share its label; repeated doc_ids in labels count as toxic if any row says so, labels other than 0 and 1 are ignored. Without
toxic or without clean training rows the lexicon alone decides. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligrid.llm.common import free_cache, stored, worker_cache

TRAIN_ROWS = 20_000
# Patterns kept for the classifier and voters of the label model, the most telling first.
PATTERNS = 4096
VOTERS = 256
PREFIXES = (4, 5, 6)
# Distinct words of a text with one beginning from which on that is a pattern of its own.
SHARED = (2, 4, 8)
LONGEST_WORD = 24

INSULTS = (
    "asshole bastard bitch clown coward creep cretin degenerate despicable disgrace disgusting dumb dumbass fool "
    "freak garbage halfwit idiot idiotic ignorant imbecile jerk loser lowlife moron moronic pathetic pig rat "
    "retard scum scumbag shameful sickening sleaze stupid swine trash trashy twit ugly useless vermin vile worm "
    "worthless wretch"
).split()


@dataclass
class Model:
    weights: dict = field(default_factory=dict)  # pattern -> weight; "=word", "^beginning" or "4^beginning"
    bias: float = -3.0


def words_of(text):
    import re

    return set(re.findall(r"[^\W\d_]+", text.lower()))


def patterns_of(word):
    """The patterns a word fires; of a very long word the whole stands as its digest, so patterns stay short."""
    from hashlib import blake2b

    whole = word if len(word) <= LONGEST_WORD else "#" + blake2b(word.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
    return ["=" + whole] + ["^" + word[:n] for n in PREFIXES if len(word) >= n]


def fired_by(words, of=patterns_of):
    """The patterns that a text's distinct words fire together."""
    counts = {}
    for word in words:
        for p in of(word):
            counts[p] = counts.get(p, 0) + 1
    return {*counts, *(f"{n}{p}" for p, c in counts.items() if c > 1 and p[0] == "^" for n in SHARED if c >= n)}


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """(toxic, text) of at most `limit` labelled rows outside the held-out fold."""
    known = (
        labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL")
        .filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    # Rows are chosen by id and text digest, so an id that many rows share is bounded like any other; of rows that
    # repeat both, one is read.
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("digest", F.xxhash64("text"))
    rows = texts.select("doc_id", "digest").join(known, "doc_id").distinct()
    # At most `limit` narrow rows: a proven bound for the broadcast.
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "digest").limit(limit)
    return texts.join(F.broadcast(chosen), ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"]).select("toxic", "text")


def _mined(batches):
    import pyarrow as pa

    free_cache()
    for batch in batches:
        toxic, found = [], []
        for row in range(batch.num_rows):
            hits = fired_by(words_of(batch.column(1)[row].as_py()))
            toxic += [batch.column(0)[row].as_py()] * len(hits)
            found += hits
            if len(found) >= 1 << 16 or row + 1 == batch.num_rows:
                for at in range(0, len(found), 1 << 18):
                    yield pa.RecordBatch.from_arrays([pa.array(found[at : at + (1 << 18)]), pa.array(toxic[at : at + (1 << 18)], pa.int32())], ["pattern", "toxic"])
                toxic, found = [], []


def _votes(patterns):
    """Rows of (label, fired pattern numbers, insults counted, second-person insult)."""
    number = {p: i for i, p in enumerate(patterns)}
    insults = set(INSULTS)

    def run(batches):
        import re

        import pyarrow as pa

        free_cache()
        aimed = re.compile(r"\b(?:you|your|they|he|she)\b(?:\W+\w+){0,4}?\W+(?:" + "|".join(INSULTS) + r")\b")
        for batch in batches:
            rows = []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                fired = sorted(number[p] for p in fired_by(words) if p in number)
                count = 0
                if words & insults:
                    count = sum(w in insults for w in re.findall(r"[^\W\d_]+", text.lower()))
                rows.append((label, fired, count, bool(count and aimed.search(text.lower()))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.bool_()))],
                ["label", "fired", "insults", "aimed"],
            )

    return run


def label_model(votes, labels, rounds: int = 25, label_rate: float = 0.95):
    """Posterior of class 1 for each row of a 0/1 vote matrix; given labels are one more, noisy voter.

    Rates of every voter come from expectation maximisation. Correlations given the class are measured from the
    residuals of votes, and a voter's evidence is divided by the number of voters it moves together with.
    """
    import numpy as np

    votes = votes.astype(np.float32)
    n, m = votes.shape
    posterior = np.where(labels == 1, label_rate, 1 - label_rate)
    share = np.ones(m)
    for step in range(rounds):
        mass1, mass0 = posterior.sum(), (1 - posterior).sum()
        prior = np.clip(mass1 / n, 1e-3, 1 - 1e-3)
        on1 = (posterior @ votes + 0.5) / (mass1 + 1)
        on0 = ((1 - posterior) @ votes + 0.05) / (mass0 + 1)
        if step in (0, rounds // 2):
            residual = votes - np.outer(posterior, on1) - np.outer(1 - posterior, on0)
            spread = np.sqrt((residual**2).sum(0)) + 1e-6
            together = np.abs((residual.T @ residual) / np.outer(spread, spread))
            share = 1 / np.maximum(1, np.where(together > 0.2, together, 0).sum(0))
        yes = share * (np.log(on1) - np.log(on0))
        no = share * (np.log1p(-on1) - np.log1p(-on0))
        logit = np.log(prior / (1 - prior)) + votes @ (yes - no) + no.sum()
        logit += np.where(labels == 1, 1, -1) * np.log(label_rate / (1 - label_rate))
        posterior = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return posterior


def linear_classifier(rows, size, target, rounds: int = 1500, decay: float = 1e-5):
    """(weights, bias) of a logistic regression on sparse 0/1 rows by accelerated gradient steps."""
    import numpy as np

    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.fromiter((c for r in rows for c in r), np.int64, len(at))
    weights, bias = np.zeros(size), 0.0
    speed_w, speed_b = np.zeros(size), 0.0
    reach = max(1.0, float(np.bincount(at, minlength=len(rows)).max()) + 1) if len(at) else 1.0
    # Classes count alike, so rare toxic rows are not drowned.
    weight = np.where(target >= 0.5, 0.5 / max(1e-9, (target >= 0.5).mean()), 0.5 / max(1e-9, (target < 0.5).mean()))
    rate = 4.0 / (reach * max(1.0, weight.max()) ** 0.5)
    for _ in range(rounds):
        ahead_w, ahead_b = weights + 0.9 * speed_w, bias + 0.9 * speed_b
        logit = np.bincount(at, ahead_w[col], len(rows)) + ahead_b
        error = weight * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - target) / len(rows)
        step_w = np.bincount(col, error[at], size) + decay * ahead_w
        speed_w = 0.9 * speed_w - rate * step_w
        speed_b = 0.9 * speed_b - rate * error.sum()
        weights, bias = weights + speed_w, bias + speed_b
    return weights, bias


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> Model:
    """Everything is learnt from at most `limit` labelled rows; what reaches the driver is bounded by it too."""
    import numpy as np

    lexicon = Model({"=" + w: 6.0 for w in INSULTS}, -3.0)
    rows = stored(training_rows(docs, labels, limit), "toxicity-train")
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    if not n1 or not n0:
        return lexicon
    # Patterns of toxic rows first (few), then how often the clean rows hold those.
    least = max(2, n1 // 200)
    mined = rows.mapInArrow(_mined, "pattern string, toxic int").groupBy("pattern").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
    lift = (F.col("t") / n1 + 1e-9) / ((F.col("n") - F.col("t") + 0.5) / (n0 + 1))
    best = (
        mined.filter((F.col("t") >= least) & (lift > 5))
        .orderBy(F.desc(F.col("t") * F.log(lift)), "pattern")
        .limit(PATTERNS)
        .collect()
    )
    patterns = [r["pattern"] for r in best]
    patterns += [p for p in ("=" + w for w in INSULTS) if p not in set(patterns)]
    data = rows.mapInArrow(_votes(patterns), "label int, fired array<int>, insults int, aimed boolean").collect()
    labels01 = np.array([r["label"] for r in data])
    voters = min(VOTERS, len(best))
    votes = np.zeros((len(data), voters + 4), np.int8)
    for i, r in enumerate(data):
        votes[i, [c for c in r["fired"] if c < voters]] = 1
        votes[i, voters:] = (r["insults"] > 0, r["insults"] > 1, r["aimed"], not r["fired"])
    target = label_model(votes, labels01)
    weights, bias = linear_classifier([r["fired"] for r in data], len(patterns), target)
    learnt = {p: round(float(w), 6) for p, w in zip(patterns, weights) if abs(w) > 1e-4}
    # Insults that the training rows never show keep the lexicon's opinion.
    seen = np.bincount(np.fromiter((c for r in data for c in r["fired"]), np.int64), minlength=len(patterns))
    for i, p in enumerate(patterns):
        if not seen[i]:
            learnt[p] = 2.0
    return Model(learnt, round(float(bias), 6))


def score_column(model: Model, text):
    """Column of scores from 0 to 1."""
    weights, bias = dict(model.weights), model.bias
    key = ("toxicity", hash((bias, len(weights), sum(weights.values()))))

    @F.pandas_udf("double")
    def score(texts):
        import math
        import re

        import pandas as pd

        # Patterns with a weight, alone or shared by several words.
        known = {p.lstrip("0123456789") if p[0] not in "=^" else p for p in weights}

        class Fired(dict):
            """word -> the known patterns it fires; most words fire none."""

            def __missing__(self, word):
                value = tuple(p for p in patterns_of(word) if p in known)
                if len(self) < 500_000:
                    self[word] = value
                return value

        fired, find = worker_cache(key, Fired), re.compile(r"[^\W\d_]+").findall
        out = []
        for text in texts:
            words = [w for w in set(find(text.lower())) if fired[w]] if text else []
            hits = fired_by(words, fired.__getitem__) if words else ()
            logit = bias + math.fsum(weights.get(p, 0.0) for p in hits)
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, logit)))))
        return pd.Series(out, dtype="float64")

    return score(text)


def scores(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    model = fit(docs, labels, limit)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    scored = docs.select("doc_id", held.alias("held_out"), score_column(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
