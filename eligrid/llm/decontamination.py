"""Benchmark decontamination: a shipped hash set of test windows, scanned by every document; DataFrame functions only.

Words are lower-cased in A-Z only and are runs of digits, a-z and characters beyond ASCII. A window is `size`
consecutive words of a benchmark item; an item of fewer words, but not none, is one window. The windows are put in a
hash table of buckets, which every task gets as one value together with a bit table of signatures, hashes of four of a
window's words. A document tries the signature of each of its own windows; where the bit is set it hashes the whole
window, looks it up and compares all words. The scan needs no shuffle and no join.

The table is bounded: (window, item) pairs are dealt by hash to as many tables of at most TABLE_BYTES as they need, and
the documents are scanned once per table. A window that very many items share is dealt like any other.

Defined results: null and empty texts have no words and are never hit; null and repeated doc_ids keep their rows; an
item with a null id marks words but is not counted among the items; items that repeat an id count once; an empty
benchmark hits nothing; an empty table gives an empty result. Other columns of both tables are ignored, and
`without_documents` and `without_spans` return the documents' own columns, whatever their names. Work and memory are
linear in a text's length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eligrid.llm.common import lower_ascii, stored

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The same boundaries in a text whose letters still have their case.
RAW_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SIZE = 10
# Bytes of windows, ids and buckets in one table; it travels with the tasks.
TABLE_BYTES = 16 << 20
ENTRY_BYTES = 96
# Signature bits per window (one window in so many passes by chance), in chunks of CHUNK.
BITS, CHUNK = 32, 1024

SPAN = "array<struct<start:int,end:int>>"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), SEPARATORS, -1), "")


def _bound(value: Column, use) -> Column:
    """use(value) with value computed once, also where a lambda uses it again and again."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _starts(words: Column, size) -> Column:
    """Start positions, from 1, of all runs of `size` words."""
    count = F.size(words)
    return F.when(count >= size, F.sequence(F.lit(1), count - size + 1)).otherwise(F.array().cast("array<int>"))


def _signature(words: Column, start: Column, size: int) -> Column:
    """Hash of up to four words of the window of `size` words at start (from 1), spread over it."""
    places = sorted({0, size // 3, 2 * size // 3, size - 1})
    return F.xxhash64(*[F.element_at(words, start + F.lit(p)) for p in places])


def windows_of(benchmark: DataFrame, size: int = SIZE, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(hash, signature, size, words, item_id): the distinct windows of every item."""
    items = benchmark.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("all_words")).filter(F.size("all_words") > 0)

    def windows(w):
        own = F.least(F.lit(size), F.size(w))
        return F.transform(_starts(w, own), lambda i: F.slice(w, i, own))

    each = items.select("item_id", F.explode(_bound(F.col("all_words"), windows)).alias("words")).distinct()
    signature = F.coalesce(*[F.when(F.size("words") == k, _signature(F.col("words"), F.lit(1), k)) for k in range(1, size + 1)])
    return each.select(F.xxhash64("words").alias("hash"), signature.alias("signature"), F.size("words").alias("size"), "words", "item_id")


def _tables(windows: DataFrame, table_bytes: int) -> list[tuple[DataFrame, int, int, list[int]]]:
    """(one-row table, number of buckets, number of bits, window sizes) for each part of the windows."""
    width = F.lit(ENTRY_BYTES) + F.octet_length(F.array_join("words", " ")) + F.octet_length(F.coalesce(F.col("item_id").cast("string"), F.lit("")))
    total = windows.agg(F.sum(width)).collect()[0][0] or 0
    parts = max(1, -(-int(total) // table_bytes))
    dealt = windows.withColumn("part", F.pmod(F.xxhash64("words", "item_id", F.lit(7)), F.lit(parts)))
    facts = {r["part"]: r for r in dealt.groupBy("part").agg(F.count_distinct("words").alias("n"), F.collect_set("size").alias("sizes")).collect()}
    spark = windows.sparkSession
    tables = []
    for part in sorted(facts):
        own = dealt.filter(F.col("part") == part)
        buckets = 1 << max(4, int(facts[part]["n"]).bit_length())
        bits = max(CHUNK, buckets * BITS)
        entries = own.groupBy("hash", "words").agg(F.collect_set("item_id").alias("items"))
        filled = entries.groupBy(F.pmod("hash", F.lit(buckets)).alias("b")).agg(F.collect_list(F.struct("words", "items")).alias("entries"))
        every = spark.range(buckets).select(F.col("id").alias("b")).join(filled, "b", "left")
        lists = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "entries"))), lambda x: x["entries"]).alias("entries"))
        bit = F.pmod("signature", F.lit(bits))
        set_bits = own.groupBy((bit / CHUNK).cast("long").alias("c")).agg(F.collect_set((bit % CHUNK).cast("int")).alias("on"))
        chunks = spark.range(bits // CHUNK).select(F.col("id").alias("c")).join(set_bits, "c", "left")
        on = F.coalesce("on", F.array().cast("array<int>"))
        flags = chunks.select("c", F.transform(F.sequence(F.lit(0), F.lit(CHUNK - 1)), lambda i: F.array_contains(on, i)).alias("flags"))
        flat = flags.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("c", "flags"))), lambda x: x["flags"])).alias("flags"))
        tables.append((lists.select(F.struct("entries", flat.scalar().alias("flags")).alias("table")), buckets, bits, sorted(facts[part]["sizes"])))
    return tables


def _scanned(words: Column, table: Column, buckets: int, bits: int, sizes: list[int]) -> Column:
    """(n_words, spans, items) of one document: word ranges of its verified windows, and the items that have them."""
    slot = lambda h, n: (F.pmod(h, F.lit(n)) + 1).cast("int")

    def of_size(x, size):
        w, t = x["words"], x["table"]
        likely = F.filter(_starts(w, F.lit(size)), lambda i: F.element_at(t["flags"], slot(_signature(w, i, size), bits)))

        def verified(i):
            own = F.slice(w, i, F.lit(size))
            return F.transform(
                F.filter(F.element_at(t["entries"], slot(F.xxhash64(own), buckets)), lambda e: e["words"] == own),
                lambda e: F.struct((i - 1).alias("start"), (i + F.lit(size - 1)).alias("end"), e.alias("entry")),
            )

        # An empty bucket is null.
        return F.flatten(F.filter(F.transform(likely, verified), lambda v: F.size(v) > 0))

    def digest(found, count):
        # A window that occurs again adds its items once.
        entries = F.array_distinct(F.transform(found, lambda y: y["entry"]))
        return F.struct(
            count.alias("n_words"),
            F.transform(found, lambda y: F.struct(y["start"].alias("start"), y["end"].alias("end"))).alias("spans"),
            F.array_distinct(F.flatten(F.transform(entries, lambda e: e["items"]))).alias("items"),
        )

    # Words and table are arguments of one lambda, so both are made once a row and neither is copied.
    return _bound(
        F.struct(words.alias("words"), table.alias("table")),
        lambda x: _bound(F.concat(*[of_size(x, s) for s in sizes]), lambda found: digest(found, F.size(x["words"]))),
    )


def _merged(spans: Column) -> Column:
    """Overlapping and touching spans as one, in order."""
    state = F.struct(F.array().cast(SPAN).alias("done"), F.lit(-1).alias("start"), F.lit(-1).alias("end"))

    def step(acc, s):
        joins = s["start"] <= acc["end"]
        closed = F.array_append(acc["done"], F.struct(acc["start"].alias("start"), acc["end"].alias("end")))
        return F.struct(
            F.when(joins | (acc["start"] < 0), acc["done"]).otherwise(closed).alias("done"),
            F.when(joins, acc["start"]).otherwise(s["start"]).alias("start"),
            F.when(joins, F.greatest(acc["end"], s["end"])).otherwise(s["end"]).alias("end"),
        )

    return F.aggregate(
        F.array_sort(F.array_distinct(spans)),
        state,
        step,
        lambda acc: F.when(acc["start"] < 0, acc["done"]).otherwise(F.array_append(acc["done"], F.struct(acc["start"].alias("start"), acc["end"].alias("end")))),
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = SIZE,
    text_col: str = "text",
    table_bytes: int = TABLE_BYTES,
) -> DataFrame:
    """One row per document: all columns of docs as struct `doc`, n_words, spans (merged word ranges), items (sorted ids as text)."""
    windows = stored(windows_of(benchmark, size), "test-windows")
    tables = _tables(windows, table_bytes)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    words = words_of(F.col("doc").getField(text_col))
    kind = f"array<{windows.schema['item_id'].dataType.simpleString()}>"
    if not tables:
        found = rows.select("doc", F.size(words).alias("n_words"), F.array().cast(SPAN).alias("spans"), F.array().cast(kind).alias("items"))
    elif len(tables) == 1:
        found = _scan(rows, words, tables[0])
    else:
        # Every row has a key of its own, written once, so that the scans of all tables can be put together.
        keyed = stored(rows.withColumn("key", F.monotonically_increasing_id()), "scanned-rows")
        some = reduce(DataFrame.union, [_scan(keyed, words, t).filter(F.size("spans") > 0).drop("doc") for t in tables])
        merged = some.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        found = keyed.join(merged, "key", "left").select(
            "doc", F.size(words).alias("n_words"), F.coalesce("spans", F.array().cast(SPAN)).alias("spans"), F.coalesce("items", F.array().cast(kind)).alias("items")
        )
    return found.select("doc", F.col("n_words").cast("long"), _merged(F.col("spans")).alias("spans"), F.array_sort(F.col("items").cast("array<string>")).alias("items"))


def _scan(rows: DataFrame, words: Column, table) -> DataFrame:
    one, buckets, bits, sizes = table
    # Spark allows no subquery inside a lambda function's expression; as a column of its own, used once, it is merged
    # into the scan's expression and reaches it by reference.
    ready = rows.withColumn("table", one.scalar())
    hit = ready.select(*rows.columns, _scanned(words, F.col("table"), buckets, bits, sizes).alias("hit"))
    # A generator over one struct: filters above it do not compute the scan again.
    return hit.select(*rows.columns, F.inline(F.array("hit")))


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of `contamination`."""
    n_hit = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"]).cast("long")
    return found.select(
        F.col("doc").getField(id_col).alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def without_documents(found: DataFrame) -> DataFrame:
    """Documents that hold no test window, with their own columns."""
    return found.filter(F.size("spans") == 0).select("doc.*")


def without_spans(found: DataFrame, text_col: str = "text") -> DataFrame:
    """All documents; the words of every hit span and what follows each of them up to the next word are cut out."""
    text = F.coalesce(F.col("doc").getField(text_col).cast("string"), F.lit(""))
    parts = F.split(text, RAW_SEPARATORS, -1)
    gaps = F.regexp_extract_all(text, F.lit(RAW_SEPARATORS), F.lit(0))

    def rebuilt(p, g):
        # Piece i is word i with what follows it; a text that starts with a separator has an empty word first.
        pieces = F.zip_with(p, g, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
        lead = F.when(F.element_at(p, 1) == "", 1).otherwise(0)
        ends = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["end"] + lead))
        starts = F.concat(F.transform("spans", lambda s: s["start"] + lead), F.array(F.size(p)))
        return F.transform(F.array(pieces), lambda q: F.array_join(F.flatten(F.zip_with(ends, starts, lambda a, b: F.slice(q, a + 1, b - a))), ""))

    clean = F.element_at(F.element_at(F.zip_with(F.array(parts), F.array(gaps), rebuilt), 1), 1)
    cut = F.when(F.size("spans") > 0, clean).otherwise(F.col("doc").getField(text_col))
    return found.select(F.col("doc").withField(f"`{text_col}`", cut).alias("doc")).select("doc.*")
