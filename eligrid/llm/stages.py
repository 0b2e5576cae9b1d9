"""Pipeline stages: (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of documents.

Every stage works on any table with doc_id and text, whatever its other columns; null and repeated doc_ids, null and
empty texts and empty tables pass through by the rules of the operator that the stage calls.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from eligrid.llm import golomb_dedup, group_jaccard, harmonic_pack, secret_ledger
from eligrid.llm import toxicity as weak
from eligrid.llm.common import free_names, load, lower_ascii, stored
from eligrid.llm.queries import vocabulary_file


def toxicity(spark, docs, sf_dir):
    """Documents scored 0.5 or more go."""
    model = weak.fit(docs, load(spark, sf_dir, "labels"))
    return docs.filter(weak.score_column(model, F.col("text")) < 0.5)


def exact_dedup(spark, docs, sf_dir):
    """Of equal texts the row with the largest doc_id stays; of rows that repeat doc_id and text, one."""
    own, kept_id, kept_sha = free_names(docs, "own_digest", "kept_id", "kept_sha")
    kept = golomb_dedup.exact_duplicates(docs).filter("kept").select(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_sha)).distinct()
    keyed = docs.withColumn(own, F.sha2(F.encode(lower_ascii(F.col("text")), "UTF-8"), 256))
    chosen = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(kept_sha)), "left_semi")
    return chosen.dropDuplicates(["doc_id", own]).select(*docs.columns)


def ngram_jaccard(spark, docs, sf_dir):
    """Of rows linked by shared shingles one stays: the smallest doc_id, nulls last, then the smallest text digest.

    Every row has a key of its own, so null and repeated doc_ids are told apart. Rows without shingles stay.
    """
    (row,) = free_names(docs, "row_key")
    # Written, so that every scan sees the same keys.
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "jaccard-rows")
    found = group_jaccard.jaccard_groups(rows, id_col=row).select(F.col("doc_id").alias(row), "component_id")
    digest = F.sha2(F.encode(F.col("text"), "UTF-8"), 256)
    place = rows.select(row, F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", digest.alias("digest"), F.col(row).alias("row")).alias("place"))
    kept = found.join(place, row).groupBy("component_id").agg(F.min("place").alias("head")).select(F.col("head.row").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def secrets(spark, docs, sf_dir):
    """Texts stay, every secret in them is replaced by a mark; n_chars follows."""
    return secret_ledger.masked(docs)


def packing(spark, docs, sf_dir):
    return harmonic_pack.pieces(harmonic_pack.pack_documents(docs, vocabulary_file("word_bpe_49k.json")))
