from pyspark.sql import functions as F

from sheetforge.llm import mixing


def test_rates_above_one_draw(spark):
    rows = spark.range(400).select(F.col("id").cast("string").alias("id"))
    for rate in (599.0, 780.0, 5000.0):
        got = [r[0] for r in rows.select(mixing.repetitions(F.col("id"), F.lit(rate), 17)).collect()]
        mean = sum(got) / len(got)
        var = sum((x - mean) ** 2 for x in got) / len(got)
        assert abs(mean - rate) < 5 * (rate / 400) ** 0.5
        assert 0.7 < var / rate < 1.35


def test_source_of_one_document(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, "typo").otherwise("src0").alias("source"))
    out = mixing.mix_sources(docs, {"src0": 0.5, "*": 0.5})
    n = out.where("source = 'typo'").count()
    assert abs(n - 2000) < 5 * 2000**0.5
    assert n == out.where("source = 'typo'").select("copy").distinct().count()
