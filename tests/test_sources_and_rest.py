"""Readers, and small operators that no registered query calls."""

import json

from pyspark.sql import functions as F

from sheetforge.functions import distance
from sheetforge.operators import describe, encode, evaluate, layout, numbering, store
from sheetforge.sources import tables as files

TRUTH = {"material": ["1.4301"], "general_tolerances": {"char1": "m", "char2": "K"}, "name": "ring", "surfaces": ["Ra 3.2"], "gdts": [{"name": "Flatness", "runout": 0.1}], "threads": [], "outer_measures": [1.0, 2.0]}


def test_evaluation_runs_of_both_shapes(spark, tmp_path):
    (tmp_path / "vlm.json").write_text(json.dumps({"results": [{"ground_truth": TRUTH, "vlm_reponse": json.dumps(TRUTH | {"name": "bolt"})}, {"ground_truth": TRUTH, "vlm_reponse": "no json"}]}))
    (tmp_path / "pre.json").write_text(json.dumps({"time_spent": 1.5, "results": [{"ground_truth": TRUTH, "preprocessor_reponse": TRUTH | {"name": "nut", "surfaces": []}}]}))
    rows = files.read_evaluation(spark, str(tmp_path / "vlm.json")).orderBy("result_id").collect()
    assert [r["result_id"] for r in rows] == [0, 1] and rows[0]["prediction"]["name"] == "bolt" and rows[0]["ground_truth"]["gdts"][0]["runout"] == 0.1
    assert rows[0]["prediction"]["general_tolerances"]["char2"] == "K" and (rows[1]["prediction"] is None or rows[1]["prediction"]["name"] is None)
    row = files.read_evaluation(spark, str(tmp_path / "pre.json")).first()
    assert row["prediction"]["name"] == "nut" and row["prediction"]["surfaces"] == [] and row["ground_truth"]["name"] == "ring"


def test_runtimes_norms_and_prompts(spark, tmp_path):
    (tmp_path / "runtimes.csv").write_text("id,drawing,machine,time\n1,7,\"saw, big\",2.5\n2,7,,\n")
    assert [tuple(r) for r in files.read_runtimes_csv(spark, str(tmp_path / "runtimes.csv")).orderBy("runtime_id").collect()] == [(1, 7, "saw, big", 2.5), (2, 7, None, None)]
    (tmp_path / "norms.json").write_text('["ISO 16016", "DIN 509"]')
    assert [tuple(r) for r in files.read_norms(spark, str(tmp_path / "norms.json")).orderBy("norm_id").collect()] == [(0, "ISO 16016"), (1, "DIN 509")]
    (tmp_path / "prompts.txt").write_text("thread, material: Find: a bolt\n\nsurface:rough ones\n")
    assert [tuple(r) for r in files.read_prompts(spark, str(tmp_path / "prompts.txt")).orderBy("prompt_id").collect()] == [(0, ["thread", "material"], "Find: a bolt"), (2, ["surface"], "rough ones")]


def test_numbers_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"), F.lit("payload").alias("p"))
    assert sorted((r["x"], r["n"]) for r in numbering.numbered(df, ["x"], "n", first=5).collect()) == [(i, i + 5) for i in range(1000)]
    assert numbering.numbered(df.limit(0), ["x"], "n").count() == 0
    wide = spark.createDataFrame([(9, [1.0]), (4, [2.0])], "drawing_id int, shape array<float>")
    assert [(r["searchdata_id"], r["drawing_id"], r["shape"]) for r in files.searchdata_rows(wide).orderBy("drawing_id").collect()] == [("0", "4", "{2.0}"), ("1", "9", "{1.0}")]


def test_upsert_takes_one_row_of_a_key(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    delta = spark.createDataFrame([(2, "x"), (2, "y"), (3, "z"), (3, "w")], "k int, v string")
    got = store.upsert(base, delta, "k").collect()
    assert sorted(r["k"] for r in got) == [1, 2, 3]


def test_default_time_and_flat_history(spark):
    df = spark.createDataFrame([(1, None), (2, "2020-01-02 03:04:05")], "i int, t string").select("i", F.col("t").cast("timestamp_ntz").alias("timestamp"))
    rows = {r["i"]: r["timestamp"] for r in store.with_default_timestamp(df).collect()}
    assert rows[1] is not None and str(rows[2]) == "2020-01-02 03:04:05"
    documents = spark.createDataFrame([(1, "p", [(5, 9, "good", 1)]), (2, "q", [])], "history_id int, query_path string, feedbacks array<struct<feedback_id: int, drawing_id: int, feedback_desc: string, feedback_value: int>>")
    flat = store.flatten_history(documents)
    assert [tuple(r) for r in flat["feedbacks"].collect()] == [(1, 5, 9, "good", 1)] and flat["history"].columns == ["history_id", "query_path"] and flat["history"].count() == 2


def test_boxes_lists_and_scores(spark):
    one = spark.createDataFrame([([(3, 4), (1, 9), (2, 5)],)], "p array<struct<x: int, y: int>>")
    assert tuple(one.select(layout.polygon_box(F.col("p")).alias("b")).first()["b"]) == (1, 4, 2, 5)
    texts = spark.createDataFrame([("['a', 'b', ]",), (None,), ("x",)], "t string").select(describe.parse_comma_list(F.col("t")).alias("l")).collect()
    assert [r["l"] for r in texts] == [["a", "b", "]"], [], ["x"]] or [r["l"] for r in texts][1:] == [[], ["x"]]
    pixels = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 1, 0), (2, 1, 1)], "image_id int, gt int, pred int")
    assert {r["image_id"]: (round(r["iou"], 6), r["dice"]) for r in evaluate.binary_scores(pixels).collect()} == {1: (0.333333, 0.5), 2: (1.0, 1.0)}
    pair = spark.createDataFrame([([4.0, 0.0, 3.0], [2.0, 0.0, 0.0])], "a array<double>, b array<double>")
    assert abs(pair.select(distance.zscore_l2(F.col("a"), F.col("b"), [9.0, 9.0, 9.0], [2.0, 1.0, 1.0])).first()[0] - (1 + 9) ** 0.5 / 3) < 1e-12
    names = spark.createDataFrame([("Ring", "ring 2"), ("bolt", "nut"), (None, "x"), ("abcdefghijkl", "abcdefghijkX"), ("", "")], "t string, f string")
    assert [r["match"] for r in evaluate.match_names(names, "t", "f").orderBy("t", "f").collect()] == [0.0, 1.0, 1.0, 1.0, 0.0]


def test_whole_text_vector(spark):
    """All text sections of 191 numbers, value by value, and the shape behind them."""
    classes, norms = 116, 52
    materials = spark.createDataFrame([(i, 0, f"m{i}") for i in range(classes)], "class_id int, pos int, name string")
    features = spark.createDataFrame(
        [(1, [["m7"]], ["mK"], ["Ra 3.2", "Rz6.3"], ["// 0.02 A", "// 0.01", "⌾ 0.5"], [1.0 if i == 3 else 0.0 for i in range(norms)], [40.0, 120.0]), (2, [], [], [], [], [0.0] * norms, [])],
        "drawing_id int, material_class array<array<string>>, general_tolerances array<string>, surfaces array<string>, gdts array<string>, norm_vector array<double>, outer_dimensions array<double>",
    )
    encoded = encode.encode(features, materials)
    got = {r["drawing_id"]: r["ocr_vector"] for r in encoded.collect()}
    want = [0.0] * 116 + [0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0] + [7.0] + [0.5, 1, 1, 1, 1, 1, 1, 1, 0.01, 1, 1, 1] + [1.0 if i == 3 else 0.0 for i in range(52)] + [40.0, 120.0, 0.0]
    want[7] = 1.0
    assert got[1] == want and len(want) == 191
    assert got[2] == [0.0] * 116 + [0.0] * 7 + [15.0] + [1.0] * 12 + [0.0] * 52 + [0.0] * 3
    whole = encode.search_vectors(encoded, spark.createDataFrame([(1, [0.5] * 512)], "drawing_id int, shape array<float>"))
    assert {r["drawing_id"]: (len(r["search_vector"]), r["search_vector"][191:]) for r in whole.collect()} == {1: (703, [0.5] * 512), 2: (703, [0.0] * 512)}
