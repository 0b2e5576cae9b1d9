"""Secret scan with an incremental blob ledger, in DataFrame functions only.

Every version of every path is content-addressed (SHA-256 of the text). The ledger holds which (blob, rule, rule
version) pairs were scanned and their spans; a scan reads only blobs with an unseen pair, once per distinct blob, and
adds the outcome, empty ones too. Findings are joined back to all paths by content address.

Positions come from two passes of one pattern: the pieces between matches (`split`) and the matches themselves
(`regexp_extract_all`); running lengths of both give code-point offsets. Letters of the assign keywords match in
either case within ASCII only.

Defined results: null text counts as empty and has no spans; null and repeated doc_ids keep their rows; an empty
table gives an empty result. Other columns are ignored. This method needs no spans beyond the base rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eligrid.llm.common import free_names, scratch, stored

# Rules in order of listing: kind, version, pattern, group whose length counts, least length of that group.
_ASSIGN = (
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
RULES = (
    ("assign", 1, _ASSIGN, 1, 6),
    # Maximal runs: a run that is too short cannot hold a match, so the least length may stand in the pattern.
    ("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)
SPAN = "array<struct<start:int,end:int>>"
LEDGER = f"blob string, kind string, version int, spans {SPAN}"
MARK = "[SECRET]"


def _at_least(least):
    return lambda x: F.length(x) >= least


def _equal_to(place):
    return lambda x: x == place


def versions_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, blob, text): every version with its content address."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.sha2(F.encode(text, "UTF-8"), 256).alias("blob"), text.alias("text"))


def _matches(blobs: DataFrame, rules) -> DataFrame:
    """(blob, kind, version, spans) where a rule has a span; blobs: blob, text, todo (kinds to scan)."""
    hits = [F.array_contains("todo", kind) & F.col("text").rlike(pattern) for kind, _, pattern, _, _ in rules]
    per_rule = []
    for hit, (kind, version, pattern, group, least) in zip(hits, rules):
        per_rule.append(
            F.when(
                hit,
                F.struct(
                    F.lit(kind).alias("kind"),
                    F.lit(version).alias("version"),
                    F.transform(F.split("text", pattern, -1), F.length).alias("gaps"),
                    F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.length).alias("sizes"),
                    F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(group)), _at_least(least)).alias("good"),
                ),
            )
        )
    some = hits[0]
    for hit in hits[1:]:
        some = some | hit
    found = blobs.filter(some).select("blob", F.explode(F.filter(F.array(*per_rule), lambda x: x.isNotNull())).alias("m"))
    # Rows that repeat doc_id and text are scanned alike; one of them goes on.
    found = found.select("blob", "m.*").dropDuplicates(["blob", "kind", "version"])
    each = found.select("blob", "kind", "version", F.posexplode(F.arrays_zip("gaps", "sizes", "good")).alias("i", "z")).select(
        "blob", "kind", "version", "i", F.col("z.gaps").alias("gap"), F.col("z.sizes").alias("size"), F.col("z.good").alias("good")
    )
    # One row per match and running sums over them: a text full of matches stays linear.
    order = Window.partitionBy("blob", "kind", "version").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    spans = each.withColumn("end", F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(order).cast("int")).filter("good")
    return (
        spans.select("blob", "kind", "version", (F.col("end") - F.col("size")).alias("start"), "end")
        .groupBy("blob", "kind", "version")
        .agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    )


def unseen(versions: DataFrame, ledger: DataFrame | None, rules=RULES) -> DataFrame:
    """(blob, first_id, todo): blobs with rules not yet scanned at their present version, and those kinds."""
    wanted = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("version")) for k, v, *_ in rules])
    firsts = versions.groupBy("blob").agg(F.min("doc_id").alias("first_id"))
    if ledger is None:
        return firsts.select("blob", "first_id", F.transform(wanted, lambda w: w["kind"]).alias("todo"))
    seen = ledger.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("seen"))
    none = F.array().cast("array<struct<kind:string,version:int>>")
    todo = F.transform(F.array_except(wanted, F.coalesce("seen", none)), lambda w: w["kind"])
    return firsts.join(seen, "blob", "left").select("blob", "first_id", todo.alias("todo")).filter(F.size("todo") > 0)


def additions(versions: DataFrame, ledger: DataFrame | None, rules=RULES) -> DataFrame:
    """Ledger rows for the unseen pairs of these versions."""
    todo = unseen(versions, ledger, rules)
    want = todo.select(F.col("blob").alias("want"), "first_id", "todo")
    # The join on the first path of a blob moves each text once and no copies; blobs are never grouped with texts.
    texts = versions.join(want, (F.col("blob") == F.col("want")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).select("blob", "text", "todo")
    found = _matches(texts, rules)
    number = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v, *_ in rules])
    pairs = todo.select("blob", F.explode("todo").alias("kind")).withColumn("version", number)
    return pairs.join(found, ["blob", "kind", "version"], "left").select("blob", "kind", "version", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def scan(docs: DataFrame, ledger_path: str | None = None, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bring the ledger up to date and return (doc_id, blob, found) for every row of docs.

    found: array of (start, kind, end) sorted by start, then kind as listed. A ledger path keeps the ledger between
    calls; without one a new ledger is written to the shared folder.
    """
    spark = docs.sparkSession
    versions = versions_of(docs, id_col, text_col)
    path = ledger_path or scratch(spark, "ledger")
    ledger = spark.read.schema(LEDGER).parquet(path) if ledger_path and _exists(spark, path) else None
    additions(versions, ledger, rules).write.mode("append").parquet(path)
    now = spark.read.schema(LEDGER).parquet(path)
    current = F.coalesce(*[F.when((F.col("kind") == k) & (F.col("version") == v), F.lit(i)) for i, (k, v, *_) in enumerate(rules)])
    findings = (
        now.filter(F.size("spans") > 0)
        .withColumn("place", current)
        .filter("place IS NOT NULL")
        # Two scans at once may both append a pair.
        .dropDuplicates(["blob", "place"])
        .groupBy("blob")
        .agg(F.collect_list(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("place").alias("place"), s["end"].alias("end")))).alias("lists"))
        .select("blob", F.array_sort(F.flatten("lists")).alias("found"))
    )
    paths = versions.select("doc_id", "blob")
    return paths.join(findings, "blob", "left").select("doc_id", "blob", F.coalesce("found", F.array().cast("array<struct<start:int,place:int,end:int>>")).alias("found"))


def _exists(spark, path):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def summary(scanned: DataFrame, rules=RULES) -> DataFrame:
    """Counts per kind, the digest of all spans and their listing, per row of `scan`."""
    names = F.array(*[F.lit(k) for k, *_ in rules])
    listing = F.array_join(
        F.transform("found", lambda s: F.concat_ws(":", F.element_at(names, s["place"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    places = F.transform("found", lambda s: s["place"])
    counts = [F.size(F.filter(places, _equal_to(i))).cast("long").alias(f"n_{k}") for i, (k, *_) in enumerate(rules)]
    return scanned.select("doc_id", *counts, F.sha2(F.encode(listing, "UTF-8"), 256).alias("base_sha256"), listing.alias("spans"))


def masked(docs: DataFrame, rules=RULES) -> DataFrame:
    """The same rows and columns, with MARK in place of every secret and n_chars counted again."""
    columns = docs.columns
    own, blob, spans = free_names(docs, "own_blob", "blob", "found")
    found = scan(docs, rules=rules).filter(F.size("found") > 0).select("blob", F.explode("found").alias("s")).distinct()
    # A span begins a mark of its own unless an earlier one reaches beyond its start.
    before = Window.partitionBy("blob").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    each = found.select("blob", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.coalesce(F.max("s.end").over(before), F.lit(0)).alias("at"))
    cuts = F.array_sort(F.collect_list(F.when(F.col("start") >= F.col("at"), F.struct("at", "start"))))
    found = each.groupBy("blob").agg(F.struct(cuts.alias("cuts"), F.max("end").alias("last")).alias("found"))
    found = stored(found.select(F.col("blob").alias(blob), F.col("found").alias(spans)), "secret-spans")
    keyed = docs.withColumn(own, F.sha2(F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8"), 256))
    text = F.col("text")

    def rebuilt(wide):
        """Four bytes a character, so that a piece is cut without walking the text from its start."""

        def piece(start, length):
            # The decoder takes one byte order mark off the front; with this one it leaves the text's own.
            return F.decode(F.concat(F.lit(b"\x00\x00\xfe\xff"), F.substring(wide, start * 4 + 1, length * 4)), "UTF-32")

        kept = F.transform(F.col(spans)["cuts"], lambda c: piece(c["at"], c["start"] - c["at"]))
        tail = piece(F.col(spans)["last"], F.octet_length(wide))
        return F.array_join(F.concat(kept, F.array(tail)), MARK)

    # The array binds the encoded text once for all pieces.
    clean = F.transform(F.array(F.encode(text.cast("string"), "UTF-32")), rebuilt)[0]
    out = keyed.join(found, F.col(own) == F.col(blob), "left").withColumn("text", F.when(F.col(spans).isNull(), text).otherwise(clean))
    if "n_chars" in columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return out.select(*columns)
