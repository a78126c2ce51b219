"""Quality rules where no text passes the base rules, and where a group is larger than its sketches."""

import pytest
from pyspark.sql import functions as F

from weir.llm import quality_rules

from test_small import documents, odd_texts


@pytest.mark.parametrize("broadcast", ["-1", "10485760"])
def test_no_text_passes_the_base_rules(spark, broadcast):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        docs = documents(spark, ["too short", None, "", "again " * 40])
        for _ in range(5):
            rows = quality_rules.quality_rules(docs).collect()
            assert len(rows) == 4 and all(r["base_failed"] and not r["kept"] for r in rows)
            assert quality_rules.quality_rules(docs.limit(0)).count() == 0
        assert quality_rules.passing(docs).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_thresholds_of_a_group_beyond_its_sketch(spark):
    n = 20_000
    judged = spark.range(n).select(
        F.lit("en").alias("_lang"), F.concat(F.lit("s"), (F.col("id") % 3 == 0).cast("string")).alias("_source"),
        F.struct(F.lit(False).alias("base_failed"), *[(F.col("id") * 7919 % 1000).alias(s) for s in quality_rules.SHARES]).alias("rules"))
    for limits in (r["limits"] for r in quality_rules.thresholds(judged.repartition(16), sketch=256).collect()):
        w = (limits["word_length_high"] - limits["word_length_low"]) / 17  # low = q1 - 8 w, high = q1 + w + 8 w
        q1 = limits["word_length_low"] + 8 * w
        assert abs(q1 - 250) < 50 and abs(q1 + w - 750) < 50


def test_odd_texts_under_both_joins(spark):
    docs = documents(spark, odd_texts() * 2)
    rows = quality_rules.quality_rules(docs).collect()
    assert len(rows) == 2 * len(odd_texts())
