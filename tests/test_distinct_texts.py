"""Text analysis runs once per distinct text and gives what a row-by-row evaluation gives."""

from pyspark.sql import functions as F

from eligrid.operators import ambiguity, mining

TEXTS = ["Age 18 years and above", "Income must be at least Rs. 1,20,000 per annum", "Short one, subject to availability", None]


def _rows(spark, repeats):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(len(TEXTS) * repeats)]
    return spark.createDataFrame(rows, "n bigint, sentence string")


def test_each_distinct_text_is_analysed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def width(text):
        seen.add(1)
        return None if text is None else len(text)

    got = mining.analysed(_rows(spark, 50), {"w": width("sentence")}).collect()
    assert len(got) == 50 * len(TEXTS)
    assert all(r.w == (None if r.sentence is None else len(r.sentence)) for r in got)
    assert seen.value == len(TEXTS)


def test_rows_agree_with_and_without_the_lookup(spark):
    columns = {"field": mining.canonical_field(F.col("sentence")), "kind": mining.condition_type(F.col("field")), "codes": ambiguity.detect(F.col("sentence"))}
    rows = _rows(spark, 5)
    looked_up = mining.analysed(rows, columns).orderBy("n").collect()
    in_place = mining.analysed(rows, columns, limit=0).orderBy("n").collect()
    assert looked_up == in_place and any(r.codes for r in looked_up)
