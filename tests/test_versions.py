"""The bucketed, versioned store against the plain store operators."""

import pytest
from pyspark.sql import functions as F

from sheetforge.operators import store, versions

LAYOUTS = {name: versions.Layout(x.key, x.by, 64) for name, x in versions.LAYOUTS.items()}


def tables(spark, n=2_000):
    ids = spark.range(n).select(F.col("id").cast("int").alias("drawing_id"))
    return {
        "drawings": ids.withColumn("name", F.concat(F.lit("d"), "drawing_id")),
        "runtimes": ids.select((F.col("drawing_id") * 2).alias("runtime_id"), "drawing_id", F.lit(1.5).alias("machine_runtime")),
        "searchdata": ids.select((F.col("drawing_id") + 7).alias("searchdata_id"), "drawing_id", F.array(F.lit("x")).alias("material")),
        "history": ids.where("drawing_id < 50").select(F.col("drawing_id").alias("history_id"), F.lit("q").alias("query_path")),
        "feedbacks": ids.where("drawing_id < 100").select(F.col("drawing_id").alias("feedback_id"), (F.col("drawing_id") % 50).alias("history_id"), "drawing_id"),
    }


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def root(spark, tmp_path):
    where = f"file://{tmp_path}/store"
    versions.create(spark, where, tables(spark), LAYOUTS)
    return where


def test_a_small_upsert_rewrites_few_buckets(spark, root):
    base = tables(spark)["drawings"]
    delta = spark.createDataFrame([(5, "new"), (5_000, "more")], "drawing_id int, name string")
    before = versions.manifest(spark, root)["tables"]
    assert versions.change(spark, root, {"drawings": delta}) == 2
    after = versions.manifest(spark, root)["tables"]
    changed = {b for b in {*before["drawings"]["folders"], *after["drawings"]["folders"]} if before["drawings"]["folders"].get(b) != after["drawings"]["folders"].get(b)}
    assert len(changed) == delta.select(versions.bucket("drawing_id", 64)).distinct().count() and len(before["drawings"]["folders"]) == 64
    assert all(before[t] == after[t] for t in before if t != "drawings")
    assert rows(versions.read(spark, root, "drawings")) == rows(store.upsert(base, delta, "drawing_id"))
    assert rows(versions.read(spark, root, "drawings", 1)) == rows(base)


def test_a_row_that_moves_to_another_drawing(spark, root):
    moved = spark.createDataFrame([(20, 999, 7.0)], "runtime_id int, drawing_id int, machine_runtime double")
    versions.change(spark, root, {"runtimes": moved})
    out = versions.read(spark, root, "runtimes")
    assert [tuple(r) for r in out.where("runtime_id = 20").collect()] == [(20, 999, 7.0)] and out.count() == 2_000


@pytest.mark.parametrize("feedback", ["restrict", "cascade"])
def test_cascades_as_the_plain_ones(spark, root, feedback):
    keys = spark.createDataFrame([(3,), (150,), (77_777,)], "drawing_id int")
    want = store.delete_drawings(tables(spark), keys, feedback)
    _, blocked = versions.delete_drawings(spark, root, keys, feedback)
    assert rows(blocked) == rows(want["blocked"])
    for name in ("drawings", "runtimes", "searchdata", "feedbacks"):
        assert rows(versions.read(spark, root, name)) == rows(want[name])
    plain = store.delete_history(tables(spark)["history"], want["feedbacks"], keys.selectExpr("drawing_id as history_id"))
    versions.delete_history(spark, root, keys.selectExpr("drawing_id as history_id"))
    assert rows(versions.read(spark, root, "history")) == rows(plain["history"]) and rows(versions.read(spark, root, "feedbacks")) == rows(plain["feedbacks"])


def test_a_job_that_dies_between_two_tables_changes_nothing(spark, root, monkeypatch):
    write, done = versions._write, []

    def dies(df, where, name, layout):
        if done:
            raise RuntimeError("killed")
        done.append(name)
        return write(df, where, name, layout)

    monkeypatch.setattr(versions, "_write", dies)
    with pytest.raises(RuntimeError):
        versions.delete_drawings(spark, root, spark.createDataFrame([(150,)], "drawing_id int"))
    monkeypatch.setattr(versions, "_write", write)
    assert len(done) == 1 and versions.manifest(spark, root)["version"] == 1
    for name, df in tables(spark).items():
        assert rows(versions.read(spark, root, name)) == rows(df)
    # a manifest that was cut off counts as none, and the next change goes on behind it
    fs, where = versions._fs(spark, f"{root}/versions/{2:012d}.json")
    out = fs.create(where, False)
    out.write(bytearray(b'{"tables": {'))
    out.close()
    assert versions.manifest(spark, root)["version"] == 1
    assert versions.change(spark, root, deletes={"drawings": (spark.createDataFrame([(1,)], "drawing_id int"), "drawing_id")}) == 3
    assert versions.read(spark, root, "drawings").count() == 1_999
    assert versions.vacuum(spark, root, keep=1) >= 2
    assert versions.read(spark, root, "drawings").count() == 1_999


def test_a_second_writer_is_refused(spark, root, monkeypatch):
    state = versions.manifest(spark, root)
    versions.change(spark, root, deletes={"drawings": (spark.createDataFrame([(1,)], "drawing_id int"), "drawing_id")})
    with pytest.raises(RuntimeError):
        versions._commit(spark, root, state["tables"], state["version"])
