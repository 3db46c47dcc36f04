import corpus_pipeline
from pyspark.sql import functions as F

from sheetforge.llm import queries
from test_near_duplicates import brute
from test_texts import brute_leaks

SMALL = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    step = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL).cache()
        if name != "sharding":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        step[name] = (docs, out)
        docs = out

    def rows(df):
        return sorted((r["doc_id"], r["text"]) for r in df.collect())

    scored = {r["doc_id"] for r in queries.op1_toxicity(spark, SMALL).where("predicted = 0").collect()}
    assert {d for d, _ in rows(step["toxicity"][1])} == scored
    before, after = (rows(x) for x in step["jaccard_join"])
    assert {d for d, _ in after} == {c for _, _, c in brute(before)} and len(after) == len({d for d, _ in after})
    before, after = (rows(x) for x in step["decontamination"])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert [d for d, _ in after] == sorted(d for d, _, hit, _ in brute_leaks(before, items, 10) if not hit)
    before, after = (x.groupBy("source").count() for x in step["mixing"])
    assert step["mixing"][1].join(step["mixing"][0], "doc_id", "left_anti").count() == 0
    sharded = step["sharding"][1]
    assert sharded.count() == step["sharding"][0].count()
    assert sharded.groupBy("text").agg(F.countDistinct("shard").alias("s")).where("s > 1").count() == 0
    assert sharded.groupBy("shard").agg((F.max("slot") + 1 - F.count("*")).alias("gap")).where("gap <> 0").count() == 0


def test_leaks_go_by_row(spark):
    leak = spark.read.parquet(f"{SMALL}/benchmark.parquet").where("length(text) > 100").first()["text"]
    rows = [(None, leak, "clean? no"), (None, "clean", "x"), (5, leak, "x"), (5, "clean too", "x"), (6, None, "x"), (7, "clean", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string").withColumn("maybe", F.lit(1)).withColumn("gone", F.lit(2)).withColumn("key", F.lit(3))
    out = corpus_pipeline.drop_leaks(spark, docs, SMALL)
    assert out.columns == docs.columns
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in out.collect()))) == sorted(map(str, ((d, t) for d, t, _ in rows if t != leak)))


def test_mixing_shares(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = corpus_pipeline.mix(spark, docs, SMALL)
    n = docs.count()
    share = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    for source, weight in queries.MIX_WEIGHTS.items():
        if source != "*":
            assert abs(share[source] - weight * n) < 5 * (weight * n) ** 0.5
