import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sheetforge.plans import domain, queries

SMALL = "/root/testdata/sf0.001"


def test_retrieval_end_to_end(spark):
    corpus, drawings = domain.tables(spark, SMALL, "corpus", "drawings")
    rows, known = corpus.collect(), {r["drawing_id"] for r in drawings.collect()}
    x = np.array([r["search_vector"] for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = {}
    for i, r in enumerate(rows):
        if r["drawing_id"] % 20 == 0:
            near = sorted((-round(float(s), 12), rows[j]["drawing_id"], rows[j]["label"]) for j, s in enumerate(x @ x[i]))[:5]
            for k in (3, 5):
                want.setdefault((k, str(r["label"])), []).append(sum(d in known and label == r["label"] for _, d, label in near[:k]) / k)
    got = {(r["k"], r["tag"]): (r["precision"], r["n"]) for r in queries.QUERIES["w3_retrieval"](spark, SMALL).collect()}
    assert got == {key: (round(sum(v) / len(v), 6), len(v)) for key, v in want.items()}


def test_clusters_have_boxes_of_any_position(spark):
    boxes = domain.tables(spark, SMALL, "boxes")[0].where("drawing_id < 40").withColumn("pos", F.col("pos") + 7)
    rows = queries.c14_text_clusters(boxes)
    assert rows.count() == boxes.count() > 0


def test_prompts_of_different_tags_stay_apart(spark):
    # number 1 of src11 and number 11 of src1 read alike when tag and number are joined without a gap
    rows = [(tag, 5 * prompt + i, "Both Relevant" if tag == "src1" else "NOT Relevant") for tag, prompt in (("src1", 11), ("src11", 1), (None, 0), (None, 1)) for i in range(5)]
    ranked = spark.createDataFrame(rows, "tag string, pos int, label string")
    assert queries.h12_all_prompts(ranked).collect() == [(0.25, 0.25, 12)]
    con = duckdb.connect()
    con.register("rows", pa.table({"tag": [r[0] for r in rows], "pos": pa.array([r[1] for r in rows], pa.int32()), "label": [r[2] for r in rows]}))
    sql = entry.oracle_sql()["h12_all_prompts"].split(" r AS (", 1)[1]
    assert con.execute("WITH ranked AS (FROM rows), r AS (" + sql).fetchall() == [(0.25, 0.25, 12)]
