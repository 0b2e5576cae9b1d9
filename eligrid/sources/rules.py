"""Rule-base files: JSON in three layouts, edge lists, flag lists, review queues, sinks."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eligrid.functions import cells

SIDECARS = ("review_queue.json", "relationships.json", "ambiguity_map.json", "BATCH_INDEX.json")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder all executors can see: below the shared checkpoint folder if one is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def documents(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Whole JSON files as variants, sidecar and hidden files left out.

    A file that does not parse stops the job with its name; without `strict` its `doc` is
    null (see `unreadable`).
    """
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    name = F.col("_metadata.file_name")
    kept = files.select("value", name.alias("file_name")).where(
        ~F.col("file_name").isin(*SIDECARS) & ~F.startswith("file_name", F.lit(".")) & ~F.startswith("file_name", F.lit("_"))
    )
    doc = F.try_parse_json("value")
    if strict:
        doc = F.when(doc.isNull(), F.raise_error(F.concat(F.lit("not valid JSON: "), F.col("file_name"))).cast("variant")).otherwise(doc)
    return kept.select("file_name", doc.alias("doc"))


def unreadable(spark: SparkSession, path: str) -> DataFrame:
    """Names of the files that do not parse."""
    return documents(spark, path, strict=False).where("doc IS NULL").select("file_name")


def _elements(v: Column) -> Column:
    """A top-level list as an array of variants; a single object as a list of one."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))


def _get(v: Column, *names: str, kind: str = "string") -> Column:
    return F.coalesce(*[F.try_variant_get(v, f"$.{n}", kind) for n in names])


def kind_of(v: Column) -> Column:
    """Cell kind of a variant: null, str, num, bool or list."""
    shape = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    return (
        F.when(shape == "VOID", "null").when(shape == "STRING", "str").when(shape == "BOOLEAN", "bool")
        .when(F.startswith(shape, F.lit("ARRAY")), "list").otherwise("num")
    )


def text_of(v: Column) -> Column:
    text = F.try_variant_get(v, "$", "string")
    return F.when(kind_of(v) == "bool", F.initcap(text)).otherwise(text)


def cell_of(v: Column) -> Column:
    """Typed cell of a variant; a list keeps its elements' texts."""
    kind, text = kind_of(v), text_of(v)
    listed = F.try_variant_get(v, "$", "array<string>")
    number = (
        F.when(kind == "num", F.try_variant_get(v, "$", "double"))
        .when(kind == "bool", F.try_variant_get(v, "$", "boolean").cast("double"))
        .when(kind == "str", cells.text_as_double(text))
    )
    return F.struct(
        kind.alias("kind"), F.when(kind == "list", cells.list_text(listed)).otherwise(text).alias("s"),
        number.cast("double").alias("f"), F.when(kind == "list", listed).alias("a"),
    ).cast(cells.CELL)


def read_rule_base(spark: SparkSession, path: str) -> DataFrame:
    """Rules of all layouts: batch list, {"scheme", "rules"} and flat scheme files.

    Keys may be snake or Pascal case; a free-text Condition stands in for the
    condition type only where none is given; unstructured flags are dropped. A scheme
    without rules keeps one row without a rule; of a scheme found in several files the
    last file in name order counts, alone.
    """
    items = documents(spark, path).select("file_name", F.explode(_elements(F.col("doc"))).alias("item"))
    scheme = F.coalesce(F.try_variant_get("item", "$.scheme", "variant"), F.col("item"))
    rules = F.try_variant_get("item", "$.rules", "array<variant>")
    found = items.select("file_name", scheme.alias("s"), rules.alias("rules")).withColumn("own", _get(F.col("s"), "scheme_id"))
    last = found.groupBy(F.col("own").alias("last_own")).agg(F.max("file_name").alias("last_file"))
    found = found.join(last, F.col("own").eqNullSafe(F.col("last_own")) & (F.col("own").isNull() | (F.col("file_name") == F.col("last_file"))))
    rows = found.select("s", F.posexplode_outer("rules").alias("pos", "r"))
    r = F.col("r")
    value = _get(r, "value", "Value", kind="variant")
    values = F.coalesce(_get(r, "values", "Values", kind="array<variant>"), F.array().cast("array<variant>"))
    flags = F.filter(
        F.coalesce(_get(r, "ambiguity_flags", "Ambiguity_Flags", kind="array<variant>"), F.array().cast("array<variant>")),
        lambda f: F.startswith(F.schema_of_variant(f), F.lit("OBJECT")),
    )
    return rows.select(
        _get(F.col("s"), "scheme_id").alias("scheme_id"),
        _get(F.col("s"), "scheme_name").alias("scheme_name"),
        F.coalesce(_get(F.col("s"), "status"), F.lit("active")).alias("status"),
        (F.col("pos") + 1).alias("ord"),
        _get(r, "rule_id", "Rule_ID").alias("rule_id"),
        _get(r, "rule_type", "Rule_Type").alias("rule_type"),
        _get(r, "condition_type", "Condition_Type", "Condition").alias("condition_type"),
        _get(r, "field", "Field").alias("field"),
        _get(r, "operator", "Operator").alias("operator"),
        kind_of(value).alias("value_kind"),
        text_of(value).alias("value_text"),
        _get(r, "value_min", "Value_Min", kind="double").alias("value_min"),
        _get(r, "value_max", "Value_Max", kind="double").alias("value_max"),
        F.array_join(F.transform(values, text_of), "|").alias("values_text"),
        F.transform(values, cell_of).alias("items"),
        F.when(F.size(values) > 0, kind_of(values[0])).otherwise("str").alias("values_kind"),
        F.coalesce(_get(r, "audit_status", "Audit_Status"), F.lit("PENDING")).alias("audit_status"),
        F.coalesce(_get(r, "state_scope"), F.lit("central")).alias("state_scope"),
        _get(r, "supersedes_rule_id").alias("supersedes_rule_id"),
        _get(r, "logic_group").alias("logic_group"),
        _get(r, "logic_operator").alias("logic_operator"),
        _get(r, "confidence", "Confidence", kind="double").alias("confidence"),
        _get(r, "display_text", "Display_Text").alias("display_text"),
        F.coalesce(_get(r, "source_anchor.source_quote", "source_quote", "Source_Quote"), F.lit("")).alias("source_quote"),
        F.coalesce(_get(r, "source_anchor.source_url", "source_url", "Source_URL"), F.lit("")).alias("source_url"),
        F.coalesce(_get(r, "source_anchor.notification_date", "notification_date"), F.lit("2024-01-01")).alias("notification_date"),
        F.transform(flags, lambda f: F.try_variant_get(f, "$.ambiguity_type_code", "int")).alias("flag_codes"),
        F.transform(
            flags,
            lambda f, i: F.struct(
                i.alias("pos"), F.try_variant_get(f, "$.ambiguity_id", "string").alias("ambiguity_id"),
                F.try_variant_get(f, "$.severity", "string").alias("severity"),
            ),
        ).alias("rule_flags"),
        _get(r, "prerequisite_scheme_id").alias("prerequisite_scheme_id"),
    )


def schemes_of(rules: DataFrame) -> DataFrame:
    """Scheme rows of a rule base read from files, also of schemes without rules."""
    return rules.groupBy("scheme_id").agg(F.first("scheme_name").alias("scheme_name"), F.first("status").alias("status")).withColumns(
        {"ministry": F.lit(None).cast("string"), "position": F.lit(0)}
    )


def flags_of(rules: DataFrame) -> DataFrame:
    """Flag rows that the rules of a rule base carry themselves; without a severity a flag has no effect."""
    each = rules.where("rule_id IS NOT NULL").select("scheme_id", "rule_id", "ord", F.inline("rule_flags"))
    return each.where("severity IS NOT NULL")


def _entry_files(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(file_name, entries, reason): every file that is a list or an object holding one under `key`; else a reason."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    docs = files.select(F.col("_metadata.file_name").alias("file_name"), F.try_parse_json("value").alias("doc"))
    entries = F.coalesce(F.try_variant_get("doc", f"$.{key}", "array<variant>"), F.try_variant_get("doc", "$", "array<variant>"))
    reason = F.when(F.col("doc").isNull(), "not valid JSON").when(F.col("entries").isNull(), f"no list and no list under {key}")
    return docs.withColumn("entries", entries).select("file_name", "entries", reason.alias("reason"))


def verdicts(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Reject table: per file whether it is read, why not, and how many entries it holds."""
    return _entry_files(spark, path, key).select(
        "file_name", F.when(F.col("reason").isNull(), "read").otherwise("rejected").alias("verdict"),
        F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce(F.size("entries"), F.lit(0)).cast("long").alias("entries"),
    )


def _listed(spark: SparkSession, path: str, key: str, strict: bool = True) -> DataFrame:
    """Entries of all files below a path; a file that is rejected stops the job with its name, or is left out unless strict."""
    files = _entry_files(spark, path, key)
    if strict:
        stop = F.raise_error(F.concat("reason", F.lit(": "), "file_name")).cast("array<variant>")
        files = files.withColumn("entries", F.when(F.col("reason").isNotNull(), stop).otherwise(F.col("entries")))
    return files.select(F.explode("entries").alias("e"))


def write_lists(rows: DataFrame, path: str, key: str | None = None, size: int = 1000) -> None:
    """JSON lists of at most `size` rows, a file each, bare or under a key; rows are struct or plain values of one column."""
    value = F.col(rows.columns[0]) if len(rows.columns) == 1 else F.struct(*rows.columns)
    dealt = rows.select(F.floor(F.monotonically_increasing_id() / size).alias("file"), value.alias("entry"))
    packed = dealt.groupBy("file").agg(F.to_json(F.collect_list("entry")).alias("value"))
    text = F.concat(F.lit('{"' + key + '":'), "value", F.lit("}")) if key else F.col("value")
    packed.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def read_relationships(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Edge list; rows without both ends, a type or a confidence in [0, 1] are dropped."""
    rows = _listed(spark, path, "relationships", strict).select(
        _get(F.col("e"), "relationship_id").alias("relationship_id"),
        _get(F.col("e"), "scheme_a").alias("scheme_a"),
        _get(F.col("e"), "scheme_b").alias("scheme_b"),
        _get(F.col("e"), "relationship_type").alias("relationship_type"),
        _get(F.col("e"), "confidence", kind="double").alias("confidence"),
        F.coalesce(_get(F.col("e"), "display_to_user", kind="boolean"), F.lit(False)).alias("display_to_user"),
    )
    valid = F.col("scheme_a").isNotNull() & F.col("scheme_b").isNotNull() & F.col("relationship_type").isNotNull()
    return rows.where(valid & F.col("confidence").between(0.0, 1.0)).withColumn(
        "display_to_user", F.col("display_to_user") & (F.col("confidence") >= 0.60)
    )


def read_flags(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Ambiguity flags; codes outside 1 to 30 are dropped."""
    rows = _listed(spark, path, "flags", strict).select(
        *[_get(F.col("e"), n).alias(n) for n in ("ambiguity_id", "scheme_id", "rule_id", "severity")],
        _get(F.col("e"), "ambiguity_type_code", kind="int").alias("type_code"),
    )
    return rows.where(F.col("type_code").between(1, 30))


def read_queue(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Rule ids to leave out."""
    rows = _listed(spark, path, "rules", strict)
    return rows.select(F.try_variant_get("e", "$", "string").alias("rule_id")).distinct()


def write_batches(schemes: DataFrame, path: str) -> None:
    """One JSON line per scheme, partitioned by its batch number; a batch is gathered first, so it is one file."""
    schemes.repartition("batch").write.mode("overwrite").partitionBy("batch").json(path)


def batch_index(schemes: DataFrame) -> DataFrame:
    """Per batch (fifty schemes at most): count and ordered scheme ids."""
    return schemes.groupBy("batch").agg(
        F.count("*").alias("schemes_count"),
        F.transform(F.array_sort(F.collect_list(F.struct("position", "scheme_id"))), lambda x: x["scheme_id"]).alias("scheme_ids"),
    )


def export(rows: DataFrame, path: str, fmt: str) -> None:
    """JSON or CSV export; Markdown expects a `value` column of finished lines."""
    writer = rows.write.mode("overwrite")
    if fmt == "json":
        writer.json(path)
    elif fmt == "csv":
        writer.option("header", "true").csv(path)
    elif fmt == "markdown":
        writer.text(path)
    else:
        raise ValueError(f"unknown export format {fmt!r}; use json, csv or markdown")
