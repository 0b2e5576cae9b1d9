"""N-gram Jaccard join by grouped prefixes.

A document is its set of word shingles (64-bit hashes). Documents with equal sets form one group, so copies cost
nothing further; a group is known by the prefix of its set and its size, and group pairs are found, filtered and
verified, then expanded to members. The steps:

1. Frequencies of all shingles over all documents: tasks send every owner of a key range one coded list of distinct
   keys with counts. Keys above a frequency limit are the frequent ones; the limit rises until at most
   FREQUENT_KEYS remain, which bounds what is broadcast.
2. Order of shingles: infrequent ones by hash, then frequent ones by frequency. Prefixes under this order go to the
   owners of their keys. Infrequent keys list all their group pairs there; no list is longer than the limit.
3. Frequent keys, which reach a prefix only when a text consists of them, are linked along chains first (by size,
   then by hash). When chains have joined what they can, only pairs between different components are left, and
   all of these are listed: nothing is lost, and a large group of near copies needs no pair list.
4. Pairs pass the size and position filters (both exact) and, for frequent keys, a bitmap bound of the overlap. The
   others are verified on whole sets: 100 * intersection >= 80 * union by default.

Defined results: a text of fewer words than a shingle has is one shingle of all its words; without words the set is
empty and links with nothing. Null texts are empty. Null doc_ids take part in links; a component's id is the
smallest doc_id that is not null. Repeated doc_ids are separate rows. An empty table gives no rows. Other columns
are ignored. Two different sets with one 64-bit digest raise an error instead of being taken for copies.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eligrid.llm.common import components, stored, worker_cache
from eligrid.session import broadcast_if_small

# Documents that may hold a shingle before it counts as frequent, and the most keys that are broadcast (12 bytes each).
FREQUENT_FROM = 8
FREQUENT_KEYS = 2_000_000
# Shingles gathered before a task sends a list, keys of one owner, bits of the overlap bitmap.
FLUSH = 1 << 19
OWNER_KEYS = 1 << 21
BITMAP = 1024
# Words whose hash a worker keeps, documents of one Arrow batch.
CACHE_WORDS = 150_000
BATCH_ROWS = 1000


class Shingler:
    """Shingle sets of texts as sorted arrays of 64-bit hashes; words are cut at ASCII white space, A-Z lower-cased."""

    def __init__(self, words: int):
        import xxhash

        self.words = words
        digest = xxhash.xxh3_64_intdigest

        class Hashes(dict):
            def __missing__(self, word):
                value = digest(word)
                if len(self) < CACHE_WORDS and len(word) <= 64:
                    self[word] = value
                return value

        self.hash_of = Hashes().__getitem__

    def sets(self, texts):
        """One array per text; texts are bytes or None."""
        import numpy as np

        def mix(a):
            a = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            return a ^ (a >> np.uint64(32))

        def flush(parts, lengths):
            h = np.concatenate([np.fromiter(map(self.hash_of, p), np.uint64, len(p)) for p in parts])
            w, rolled = self.words, h
            if len(h) >= w:
                rolled = mix(h[: len(h) - w + 1])
                for k in range(1, w):
                    rolled = mix(rolled + h[k : len(h) - w + 1 + k])
            at = 0
            for n in lengths:
                if n >= w:
                    yield np.unique(rolled[at : at + n - w + 1])
                else:
                    one = np.array([n], np.uint64)
                    for x in h[at : at + n]:
                        one = mix(one + x)
                    yield one if n else one[:0]
                at += n

        parts, lengths = [], []
        for text in texts:
            words = text.lower().split() if text else []
            parts.append(words)
            lengths.append(len(words))
            if len(parts) >= 64 or len(words) > 50_000:
                yield from flush(parts, lengths)
                parts, lengths = [], []
        if parts:
            yield from flush(parts, lengths)


def shingler(words):
    return worker_cache(("shingler", words), lambda: Shingler(words))


def digest_of(values):
    """(64-bit digest, second digest) of a set."""
    import numpy as np
    import xxhash

    both = xxhash.xxh3_128_intdigest(values.tobytes())
    low, high = both & (2**64 - 1), both >> 64
    return np.array([low, high], np.uint64).view(np.int64).tolist()


def owner_cuts(keys, bits, owners):
    """Where each owner's keys begin in a sorted list; owner of a key: key * owners >> bits."""
    import numpy as np

    first = np.array([-(-(o << bits) // owners) for o in range(owners)] + [1 << bits], np.uint64)
    return np.searchsorted(keys, first).tolist()


def _packed(values):
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _unpacked(data, kind):
    import numpy as np
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _frequency_lists(words, bits, owners):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        gathered, size = [], 0

        def lists():
            keys, counts = np.unique(np.concatenate(gathered) >> np.uint64(64 - bits), return_counts=True)
            cuts = owner_cuts(keys, bits, owners)
            rows = [(o, a, b) for o, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if a < b]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([o for o, _, _ in rows], pa.int32()),
                    pa.array([_packed(np.diff(keys[a:b], prepend=np.uint64(0))) for _, a, b in rows], pa.binary()),
                    pa.array([_packed(counts[a:b].astype(np.uint32)) for _, a, b in rows], pa.binary()),
                ],
                ["owner", "keys", "counts"],
            )

        make = shingler(words)
        for batch in batches:
            for values in make.sets(x.as_py() for x in batch.column(0).cast(pa.binary())):
                gathered.append(values)
                size += len(values)
                if size >= FLUSH:
                    yield lists()
                    gathered, size = [], 0
        if size:
            yield lists()

    return run


def _frequencies(least):
    def run(table):
        import numpy as np
        import pyarrow as pa

        keys = np.concatenate([np.cumsum(_unpacked(x.as_py(), np.uint64), dtype=np.uint64) for x in table.column("keys")])
        counts = np.concatenate([_unpacked(x.as_py(), np.uint32) for x in table.column("counts")]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        total = np.add.reduceat(counts, first)
        often = total > least
        return pa.table({"key": pa.array(keys[first][often].astype(np.int64)), "n": pa.array(total[often])})

    return run


def bitmap_of(values):
    import numpy as np

    bits = np.zeros(BITMAP, np.uint8)
    bits[(values & np.uint64(BITMAP - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view("<i8").tolist()


POSTINGS = (
    "owner int, kind string, tokens binary, groups binary, sizes binary, places binary, "
    "docs array<struct<doc_id:bigint,text_hash:bigint,grp:bigint,check:bigint,size:int>>, "
    "often array<struct<token:bigint,grp:bigint,size:int,place:int,bits:array<bigint>>>"
)


def prefix_length(n, percent):
    return n - -(-percent * n // 100) + 1


def _postings(words, percent, bits, owners, frequent):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        keys, counts = frequent.value
        make, part = shingler(words), TaskContext.get().partitionId()
        schema = pa.schema(
            [("owner", pa.int32()), ("kind", pa.string())]
            + [(n, pa.binary()) for n in ("tokens", "groups", "sizes", "places")]
            + [
                ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("grp", pa.int64()), ("check", pa.int64()), ("size", pa.int32())]))),
                ("often", pa.list_(pa.struct([("token", pa.int64()), ("grp", pa.int64()), ("size", pa.int32()), ("place", pa.int32()), ("bits", pa.list_(pa.int64()))]))),
            ]
        )
        docs, often, lists, size, serial = [], [], [], 0, 0

        def out():
            rows = [{"owner": (part + serial) % owners, "kind": "docs", "docs": docs, "often": often}]
            if lists:
                token = np.concatenate([x[0] for x in lists]) >> np.uint64(64 - bits)
                lengths = [len(x[0]) for x in lists]
                group = np.repeat(np.array([x[1] for x in lists], np.int64), lengths)
                sizes = np.repeat(np.array([x[2] for x in lists], np.uint32), lengths)
                place = np.concatenate([np.arange(n, dtype=np.uint32) for n in lengths])
                order = np.argsort(token, kind="stable")
                token, group, sizes, place = token[order], group[order], sizes[order], place[order]
                cuts = owner_cuts(token, bits, owners)
                for o, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                    if a < b:
                        rows.append(
                            {
                                "owner": o,
                                "kind": "list",
                                "tokens": _packed(np.diff(token[a:b], prepend=np.uint64(0))),
                                "groups": group[a:b].tobytes(),
                                "sizes": _packed(sizes[a:b]),
                                "places": _packed(place[a:b]),
                            }
                        )
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        for batch in batches:
            ids, hashes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for doc_id, text_hash, values in zip(ids, hashes, make.sets(x.as_py() for x in batch.column(1).cast(pa.binary()))):
                n = len(values)
                group, check = digest_of(values)
                docs.append({"doc_id": doc_id, "text_hash": text_hash, "grp": group, "check": check, "size": n})
                if n:
                    want = prefix_length(n, percent)
                    cut = values >> np.uint64(64 - bits)
                    at = np.searchsorted(keys, cut)
                    at[at == len(keys)] = 0
                    known = keys[at] == cut if len(keys) else np.zeros(n, bool)
                    rare = values[~known][:want]
                    lists.append((rare, group, n))
                    size += len(rare)
                    if len(rare) < want:
                        mine = np.flatnonzero(known)
                        mine = mine[np.lexsort((values[mine], counts[at[mine]]))][: want - len(rare)]
                        marks = bitmap_of(values)
                        for i, v in enumerate(values[mine].view(np.int64).tolist()):
                            often.append({"token": v, "grp": group, "size": n, "place": len(rare) + i, "bits": marks})
                if size >= FLUSH or len(docs) >= 4096 or len(often) >= 8192:
                    yield out()
                    docs, often, lists, size, serial = [], [], [], 0, serial + 1
        if docs:
            yield out()

    return run


FOUND = (
    "kind string, a long, b long, docs array<struct<doc_id:bigint,text_hash:bigint,grp:bigint,check:bigint,size:int>>, "
    "often array<struct<token:bigint,grp:bigint,size:int,place:int,bits:array<bigint>>>"
)


def _pairs_of_owner(percent):
    """All group pairs of the infrequent keys of an owner that pass the size and position filters."""

    def run(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        docs = table.filter(pc.equal(table.column("kind"), "docs")).select(["kind", "docs", "often"])
        lists = table.filter(pc.equal(table.column("kind"), "list"))
        a = b = np.zeros(0, np.int64)
        if len(lists):
            token = np.concatenate([np.cumsum(_unpacked(x.as_py(), np.uint64), dtype=np.uint64) for x in lists.column("tokens")])
            group = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in lists.column("groups")])
            size = np.concatenate([_unpacked(x.as_py(), np.uint32) for x in lists.column("sizes")]).astype(np.int64)
            place = np.concatenate([_unpacked(x.as_py(), np.uint32) for x in lists.column("places")]).astype(np.int64)
            order = np.argsort(token, kind="stable")
            token, group, size, place = token[order], group[order], size[order], place[order]
            pairs, step = [], 1
            here = np.flatnonzero(token[:-1] == token[1:])
            while len(here):
                x, y = here, here + step
                least = -(-percent * (size[x] + size[y]) // (100 + percent))
                good = (
                    (group[x] != group[y])
                    & (100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y]))
                    & (np.minimum(size[x] - place[x], size[y] - place[y]) >= least)
                )
                gx, gy = group[x[good]], group[y[good]]
                pairs.append(np.stack((np.minimum(gx, gy), np.maximum(gx, gy)), 1))
                step += 1
                here = here[here + step < len(token)]
                here = here[token[here] == token[here + step]]
            if pairs:
                both = np.unique(np.concatenate(pairs), axis=0)
                a, b = both[:, 0], both[:, 1]
        schema = pa.schema([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64()), table.schema.field("docs"), table.schema.field("often")])
        none = [pa.nulls(len(docs), pa.int64())] * 2
        found = pa.table([docs.column("kind"), *none, docs.column("docs"), docs.column("often")], schema=schema)
        named = pa.array(["pair"] * len(a), pa.string())
        pair = pa.table([named, pa.array(a, pa.int64()), pa.array(b, pa.int64()), *(pa.nulls(len(a), schema.field(n).type) for n in ("docs", "often"))], schema=schema)
        return pa.concat_tables([found, pair])

    return run


def _sets(words):
    def run(batches):
        import pyarrow as pa

        make = shingler(words)
        for batch in batches:
            groups, values = batch.column(0).to_pylist(), []
            kept = []
            for group, found in zip(groups, make.sets(x.as_py() for x in batch.column(1).cast(pa.binary()))):
                if digest_of(found)[0] == group:
                    kept.append(group)
                    values.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(values, pa.binary())], ["grp", "shingles"])

    return run


def _verified(percent):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            a, b = [], []
            for x, y, left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                left, right = np.frombuffer(left.as_py(), np.uint64), np.frombuffer(right.as_py(), np.uint64)
                common = len(left) + len(right) - len(np.union1d(left, right))
                if 100 * common >= percent * (len(left) + len(right) - common):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def jaccard_groups(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    frequent_from: int = FREQUENT_FROM,
    frequent_keys: int = FREQUENT_KEYS,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, group_id (equal for equal sets)."""
    import numpy as np

    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).collect()[0]["b"]
    tokens = max(1, size // 5)
    bits = min(63, 16 + math.ceil(math.log2(tokens + 1)))
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    owners = max(shuffles, tokens // OWNER_KEYS)

    counted = stored(
        docs.select("text")
        .mapInArrow(_frequency_lists(words, bits, owners), "owner int, keys binary, counts binary")
        .groupBy("owner")
        .applyInArrow(_frequencies(frequent_from), "key long, n long"),
        "jaccard-frequent",
        BATCH_ROWS,
    )
    # The limit that leaves at most frequent_keys keys; any set of keys gives a valid order. The table of counts has
    # a row per power of two.
    steps = {r["p"]: r["c"] for r in counted.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count(F.lit(1)).alias("c")).collect()}
    limit, left = 0, sum(steps.values())
    for p in sorted(steps):
        if left <= frequent_keys:
            break
        left -= steps[p]
        limit = 2 ** (p + 1) - 1
    table = counted.filter(F.col("n") > limit).toArrow()
    keys, counts = table.column("key").to_numpy().astype(np.uint64), table.column("n").to_numpy()
    order = np.argsort(keys)
    frequent = spark.sparkContext.broadcast((keys[order], np.minimum(counts[order], 2**31 - 1).astype(np.int32)))

    found = stored(
        docs.mapInArrow(_postings(words, percent, bits, owners, frequent), POSTINGS)
        .groupBy("owner")
        .applyInArrow(_pairs_of_owner(percent), FOUND),
        "jaccard-found",
        BATCH_ROWS,
    )
    profiles = found.filter("kind = 'docs'").select(F.explode("docs").alias("d")).select("d.*")
    often = stored(
        found.filter("kind = 'docs'").select(F.explode("often").alias("o")).select("o.*").dropDuplicates(["token", "grp"]), "jaccard-often"
    )
    least = lambda n: F.ceil(n * percent / F.lit(100 + percent))

    def chain(rows, *order):
        """Neighbours in the order within every token that could be linked."""
        by = Window.partitionBy("token").orderBy(*order)
        names = [c for c in ("grp", "size", "place", "component") if c in rows.columns]
        near = rows.select(*names, *[F.lag(c).over(by).alias(f"{c}_1") for c in names]).filter("grp_1 IS NOT NULL AND grp <> grp_1")
        good = (
            (100 * F.least("size", "size_1") >= percent * F.greatest("size", "size_1"))
            & (F.least(F.col("size") - F.col("place"), F.col("size_1") - F.col("place_1")) >= least(F.col("size") + F.col("size_1")))
        )
        if "component" in names:
            good = good & (F.col("component") != F.col("component_1"))
        return near.filter(good).select(F.least("grp", "grp_1").alias("a"), F.greatest("grp", "grp_1").alias("b"))

    pairs = found.filter("kind = 'pair'").select("a", "b").union(chain(often, "size", "grp")).distinct()
    pairs = stored(pairs, "jaccard-pairs")
    # Sets of groups that any pair or frequent key names, from one document each.
    named = pairs.select(F.col("a").alias("grp")).union(pairs.select("b")).union(often.select("grp")).distinct()
    # The text's hash goes with the id, so many rows of one id, or of none, do not all meet.
    first = F.min(F.struct("doc_id", "text_hash")).alias("first")
    firsts = profiles.groupBy("grp").agg(first).join(named, "grp").select("grp", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash"))
    same = (F.col("text_hash") == F.col("first_hash")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    texts = docs.join(broadcast_if_small(stored(firsts, "jaccard-firsts"), written=True), same).select("grp", "text")
    # Rows that repeat id and text give one set.
    found_sets = texts.mapInArrow(_sets(words), "grp long, shingles binary").dropDuplicates(["grp"])
    sets = stored(found_sets, "jaccard-sets", BATCH_ROWS)

    def verify(candidates):
        left = sets.select(F.col("grp").alias("a"), F.col("shingles").alias("left"))
        right = sets.select(F.col("grp").alias("b"), F.col("shingles").alias("right"))
        both = candidates.join(left, "a").join(right, "b").select("a", "b", "left", "right")
        return stored(both.mapInArrow(_verified(percent), "a long, b long"), "jaccard-links", BATCH_ROWS)

    def labelled(stars):
        """Frequent-key rows of tokens that still join different components."""
        rows = often.join(stars.withColumnRenamed("node", "grp"), "grp", "left").withColumn("component", F.coalesce("component", "grp"))
        mixed = rows.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("token")
        return rows.join(mixed, "token", "left_semi")

    stars = stored(components(verify(pairs)), "jaccard-stars")
    # Chains in an order independent of the first one reach most of what is still apart.
    more = verify(chain(labelled(stars), F.xxhash64("grp", "token"), "grp").distinct())
    stars = stored(components(stars.toDF("a", "b").union(more)), "jaccard-stars")
    # All that remains: pairs of different components, one of them not the token's most common one.
    rows = stored(labelled(stars), "jaccard-rest")
    common = (
        rows.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("token").agg(F.max(F.struct("n", "component")).alias("m"))
    ).select("token", F.col("m.component").alias("main"))
    rows = rows.join(common, "token").withColumn("other", F.col("component") != F.col("main"))
    one, two = rows.alias("x"), rows.filter("other").alias("y")
    differing = sum((F.bit_count(F.col("x.bits")[i].bitwiseXOR(F.col("y.bits")[i])) for i in range(BITMAP // 64)), F.lit(0))
    total = F.col("x.size") + F.col("y.size")
    rest = one.join(
        two,
        (F.col("x.token") == F.col("y.token"))
        & (F.col("x.component") != F.col("y.component"))
        & (~F.col("x.other") | (F.col("x.grp") < F.col("y.grp")))
        & (100 * F.least("x.size", "y.size") >= percent * F.greatest("x.size", "y.size"))
        & (F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place")) >= least(total))
        & (differing <= total - 2 * least(total)),
    ).select(F.least("x.grp", "y.grp").alias("a"), F.greatest("x.grp", "y.grp").alias("b"))
    last = verify(rest.distinct())
    stars = stored(components(stars.toDF("a", "b").union(last)), "jaccard-stars").toDF("grp", "component")

    # Components of groups, then of their members. Digests that stand for different sets stop the job.
    groups = (
        profiles.filter("size > 0")
        .groupBy("grp")
        .agg(F.min("doc_id").alias("low"), F.min("check").alias("c1"), F.max("check").alias("c2"))
        .select("grp", "low", F.when(F.col("c1") != F.col("c2"), F.raise_error(F.lit("two shingle sets share a digest"))).alias("clash"))
        .filter("clash IS NULL")
        .join(stars, "grp", "left")
        .withColumn("component", F.coalesce("component", "grp"))
    )
    lowest = groups.groupBy("component").agg(F.min("low").alias("component_id"))
    members = stored(groups.join(lowest, "component").select("grp", "component_id"), "jaccard-members")
    full = profiles.filter("size > 0").join(members, "grp").select("doc_id", F.col("size").cast("long").alias("n_shingles"), "component_id", F.col("grp").alias("group_id"))
    none = profiles.filter("size = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("grp").alias("group_id"))
    return full.union(none)
