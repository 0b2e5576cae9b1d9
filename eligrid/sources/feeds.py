"""Raw inputs: scheme CSV, parse inputs, HTML sections, feeds and profile JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eligrid.sources.rules import kind_of

RAW_COLUMNS = ("scheme_name", "slug", "eligibility", "level", "tags")


def read_raw_schemes(spark: SparkSession, path: str) -> DataFrame:
    """Raw scheme CSV: header, quoted multi-line text, doubled quotes, BOM stripped."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    return raw.toDF(*[c.lstrip("﻿") for c in raw.columns])


def parse_inputs(rows: DataFrame) -> DataFrame:
    """Parse inputs of CSV rows; `error` names what makes a row unusable."""
    name, text = F.col("scheme_name"), F.col("eligibility")
    slug = F.substring(F.regexp_replace(F.upper(name), "[^A-Z0-9]", "_"), 1, 32)
    trimmed = F.regexp_replace(slug, "^_+|_+$", "")
    return rows.withColumns(
        {
            "scheme_id": F.when(trimmed == "", "UNKNOWN").otherwise(trimmed),
            "scheme_key": F.sha2(F.coalesce(name, F.lit("")), 256),
            "input_type": F.lit("kaggle_csv"),
            "error": F.when(name.isNull(), "missing scheme_name")
            .when(text.isNull(), "missing eligibility")
            .when(F.regexp_replace(text, r"(?U)\s+", "") == "", "blank eligibility"),
        }
    )


def id_collisions(inputs: DataFrame) -> DataFrame:
    """Short scheme ids that stand for several names; `scheme_key` tells those apart."""
    counted = inputs.groupBy("scheme_id").agg(F.count_distinct("scheme_key").alias("names"))
    return counted.where("names > 1")


def section_text(html: Column, tag: str = "section", element_id: str | None = "eligibility") -> Column:
    """Plain text of the first such element: tags dropped, white space collapsed."""
    marker = "[^>]*id=['\"]" + element_id + "['\"]" if element_id else ""
    inner = F.regexp_extract(html, f"(?is)<{tag}{marker}[^>]*>(.*?)</{tag}>", 1)
    spaced = F.regexp_replace(inner, "<[^>]+>", " ")
    return F.trim(F.regexp_replace(spaced, r"(?U)\s+", " "))


def html_inputs(pages: DataFrame, tag: str = "section", element_id: str | None = "eligibility") -> DataFrame:
    text = section_text(F.col("html"), tag, element_id)
    return pages.withColumn("text", text).withColumn("error", F.when(F.col("text") == "", "empty section"))


ENTRY = "title string, summary string, updated string, published string, id string"
ITEM = "title string, description string, pubDate string, guid string, link string"


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Atom entries and RSS items in one shape; each fallback takes the first present element."""
    atom = spark.read.schema(ENTRY).option("rowTag", "entry").xml(path)
    atom = atom.select(
        F.coalesce("id", "title", F.lit("")).alias("gazette_ref"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("summary", "title", F.lit("")).alias("summary"),
        F.substring(F.coalesce("updated", "published", F.lit("")), 1, 10).alias("notification_date"),
    )
    rss = spark.read.schema(ITEM).option("rowTag", "item").xml(path)
    mail_day = F.try_to_date(F.regexp_extract("pubDate", r"(\d{1,2} [A-Z][a-z]{2} \d{4})", 1), "d MMM yyyy")
    rss = rss.select(
        F.coalesce("guid", "link", "title", F.lit("")).alias("gazette_ref"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("description", "title", F.lit("")).alias("summary"),
        F.coalesce(mail_day.cast("string"), F.substring(F.coalesce("pubDate", F.lit("")), 1, 10)).alias("notification_date"),
    )
    return atom.unionByName(rss)


def flat_profiles(lines: DataFrame, text: str = "value") -> DataFrame:
    """Long form of flat dot-path profiles: (profile_id, field, value)."""
    pairs = F.from_json(F.col(text), "map<string,variant>")
    return lines.select("profile_id", F.explode(pairs).alias("field", "value"))


def nested_profiles(lines: DataFrame, text: str = "value") -> DataFrame:
    """Long form of nested profiles: objects are unfolded into dot paths until none is left.

    Each further level is planned only after a look whether any row has one.
    """
    level = flat_profiles(lines, text)
    leaves = None
    while leaves is None or not level.isEmpty():
        is_object = F.coalesce(F.startswith(F.schema_of_variant("value"), F.lit("OBJECT")), F.lit(False))
        flat = level.where(~is_object)
        leaves = flat if leaves is None else leaves.unionByName(flat)
        inner = F.try_variant_get("value", "$", "map<string,variant>")
        level = level.where(is_object).select("profile_id", "field", F.explode(inner).alias("key", "inner")).select(
            "profile_id", F.concat_ws(".", "field", "key").alias("field"), F.col("inner").alias("value")
        )
    return leaves


def described(long_rows: DataFrame) -> DataFrame:
    """Kind, number and text of long profile values."""
    v = F.col("value")
    listed = F.array_join(F.try_variant_get(v, "$", "array<string>"), ",")
    return long_rows.select(
        "profile_id", "field", kind_of(v).alias("kind"),
        F.when(kind_of(v) == "num", F.try_variant_get(v, "$", "double")).alias("number"),
        F.when(kind_of(v) == "list", listed).when(kind_of(v) != "num", F.try_variant_get(v, "$", "string")).alias("text"),
    )
