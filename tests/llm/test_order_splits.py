import pytest
from pyspark.sql import functions as F

from sheetforge.llm import training_order


@pytest.fixture
def docs(spark, tmp_path):
    spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")).repartition(16).write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield spark.read.parquet(str(tmp_path / "t"))
    for name in ("spark.sql.files.openCostInBytes", "spark.sql.leafNodeDefaultParallelism", "spark.sql.files.maxPartitionBytes"):
        spark.conf.unset(name)


def between(spark, monkeypatch, name, first, then):
    """The setting changes between the two reads."""
    spark.conf.set(name, first)
    keep = training_order.stored

    def stored(df, label):
        out = keep(df, label)
        spark.conf.set(name, then)
        return out

    monkeypatch.setattr(training_order, "stored", stored)


@pytest.mark.parametrize(("first", "then"), [("2", "16"), ("16", "2")])
def test_executors_come_and_go_between_the_reads(spark, docs, tmp_path, monkeypatch, first, then):
    between(spark, monkeypatch, "spark.sql.leafNodeDefaultParallelism", first, then)
    rows, folder = training_order.materialise(docs, length=16, shard_span=100, out_dir=f"file://{tmp_path}/out")
    out = rows.collect()
    assert sorted(r["doc"] for r in out) == list(range(400))
    assert sorted(r["slot"] for r in out) == list(range(400))
    assert len(training_order.read_slots(folder, 0, 1000, length=16)) == 400


@pytest.mark.parametrize(("first", "then"), [("1m", "700"), ("700", "1m")])
def test_other_splits_fail(spark, docs, tmp_path, monkeypatch, first, then):
    between(spark, monkeypatch, "spark.sql.files.maxPartitionBytes", first, then)
    with pytest.raises(Exception, match="other splits"):
        training_order.materialise(docs, length=16, shard_span=100, out_dir=f"file://{tmp_path}/out")
