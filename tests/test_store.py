from sheetforge.operators import store
from sheetforge.sources import tables


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_is_idempotent_and_last_wins(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "drawing_id int, name string")
    delta = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "drawing_id int, name string, at int")
    once = store.upsert(base, delta, "drawing_id", order="at")
    assert rows(once) == [(1, "a"), (2, "d"), (3, "e")]
    assert rows(store.upsert(once, once, "drawing_id")) == rows(once)


def _tables(spark):
    return {
        "drawings": spark.createDataFrame([(i,) for i in range(4)], "drawing_id int"),
        "runtimes": spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 2)], "runtime_id int, drawing_id int"),
        "searchdata": spark.createDataFrame([(0, 0), (1, 1)], "searchdata_id int, drawing_id int"),
        "feedbacks": spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "feedback_id int, history_id int, drawing_id int"),
    }


def test_cascade_and_restrict(spark):
    keys = spark.createDataFrame([(0,), (2,)], "drawing_id int")
    kept = store.delete_drawings(_tables(spark), keys)
    assert rows(kept["drawings"]) == [(0,), (1,), (3,)] and rows(kept["blocked"]) == [(0,)]
    assert rows(kept["runtimes"]) == [(1, 0), (2, 0), (3, 1)]
    gone = store.delete_drawings(_tables(spark), keys, feedback="cascade")
    assert rows(gone["drawings"]) == [(1,), (3,)] and rows(gone["feedbacks"]) == [(2, 1, 1)] and rows(gone["searchdata"]) == [(1, 1)]


def test_unknown_parent_is_refused(spark):
    child = spark.createDataFrame([(1, 1), (2, 10), (3, None)], "searchdata_id int, drawing_id int")
    good, bad = store.check_parents(child, [(_tables(spark)["drawings"], "drawing_id")])
    assert [r["searchdata_id"] for r in good.collect()] == [1]
    assert sorted(r["searchdata_id"] for r in bad.collect()) == [2, 3]


def test_nested_documents_both_ways(spark):
    drawings = spark.createDataFrame([(1, b"img"), (2, b"")], "drawing_id int, original_drawing binary")
    runtimes = spark.createDataFrame([(2, 1, "m2", 2.0), (1, 1, "m1", 1.0)], "runtime_id int, drawing_id int, machine string, machine_runtime double")
    search = spark.createDataFrame([(7, 1, ["x"])], "searchdata_id int, drawing_id int, material array<string>")
    feedbacks = spark.createDataFrame([(1, 5, 1, "ok", 2)], "feedback_id int, history_id int, drawing_id int, feedback_desc string, feedback_value int")
    docs = store.drawing_documents(drawings, runtimes, search, feedbacks)
    first, second = docs.orderBy("drawing_id").collect()
    assert [r["runtime_id"] for r in first["runtimes"]] == [1, 2] and second["runtimes"] == [] and second["searchdata"] is None
    back = store.flatten_documents(docs)
    assert rows(back["runtimes"].select(*runtimes.columns)) == rows(runtimes)
    assert rows(back["feedbacks"].select(*feedbacks.columns)) == rows(feedbacks)
    assert [(r[0], bytes(r[1])) for r in back["drawings"].orderBy("drawing_id").collect()] == [(1, b"img"), (2, b"")]


def test_serial_ids_follow(spark):
    base = spark.createDataFrame([(5,)], "feedback_id int")
    new = spark.createDataFrame([(c,) for c in "dbca"], "name string")
    assert sorted((r["name"], r["feedback_id"]) for r in store.with_serial_ids(new, base, "feedback_id", ["name"]).collect()) == [("a", 6), ("b", 7), ("c", 8), ("d", 9)]


def test_csv_round_trip(spark, tmp_path):
    wide = spark.createDataFrame([(1, b"a,b", [1.5, 2.0], ['x "y"', "p, q"], "t\nu"), (2, b"", [], [], None)], "drawing_id int, original_drawing binary, search_vector array<float>, material array<string>, llm_text string")
    tables.write_drawings_and_searchdata(wide, str(tmp_path / "d"), str(tmp_path / "s"))
    back = tables.read_searchdata_csv(spark, str(tmp_path / "s")).orderBy("drawing_id").collect()
    assert back[0]["search_vector"] == [1.5, 2.0] and back[0]["material"] == ['x "y"', "p, q"] and back[0]["llm_text"] == "t\nu" and back[1]["material"] == []
    assert [r["searchdata_id"] for r in back] == [0, 1]
    images = tables.read_drawings_csv(spark, str(tmp_path / "d")).orderBy("drawing_id").collect()
    assert bytes(images[0]["original_drawing"]) == b"a,b"


def test_files_and_dictionaries(spark, tmp_path):
    (tmp_path / "f").mkdir()
    for name in ("b.PNG", "a.pdf", "c.txt"):
        (tmp_path / "f" / name).write_bytes(b"z")
    good, bad = tables.read_drawing_files(spark, str(tmp_path / "f"))
    assert sorted((r["drawing_id"], r["path"][-5:]) for r in good.collect()) == [(0, "a.pdf"), (1, "b.PNG")] and bad.count() == 1
    (tmp_path / "m.json").write_text('[["A", "B"], ["C"]]')
    assert rows(tables.read_material_classes(spark, str(tmp_path / "m.json"))) == [(0, 0, "A"), (0, 1, "B"), (1, 0, "C")]
    (tmp_path / "p.txt").write_text("name:find it\n\na, b:two: parts\n")
    assert [(r["tags"], r["prompt"]) for r in tables.read_prompts(spark, str(tmp_path / "p.txt")).orderBy("prompt_id").collect()] == [(["name"], "find it"), (["a", "b"], "two: parts")]
