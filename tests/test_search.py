import numpy as np
from pyspark.sql import functions as F

from sheetforge.functions import distance
from sheetforge.operators import encode, search

LAYOUT = {"material": 3, "tolerances": 2, "surfaces": 1, "gdt": 2, "norm": 2, "dim": 3, "shape": 4}


def vectors(spark, n, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        flags = rng.integers(0, 2, 5).tolist()
        v = [*flags, int(rng.integers(0, 16)), *rng.random(2).round(2).tolist(), *rng.integers(0, 2, 2).tolist(), *rng.integers(0, 200, 3).tolist(), *rng.normal(size=4).tolist()]
        rows.append((i, [float(x) for x in v]))
    rows += [(n, [0.0] * 17), (n + 1, [0.0] * 17), (n + 2, [1.0])]
    return spark.createDataFrame(rows, "drawing_id int, search_vector array<double>")


def test_kernel_equals_columns(spark):
    v = vectors(spark, 40)
    hits = search.search(v.where("drawing_id < 9 or drawing_id = 40").withColumnRenamed("drawing_id", "query_id"), v, k=7, layout=LAYOUT)
    pairs = v.where("drawing_id < 9 or drawing_id = 40").select(F.col("drawing_id").alias("query_id"), F.col("search_vector").alias("q")).join(v.where(F.size("search_vector") == 17))
    want = pairs.select("query_id", "drawing_id", distance.composite_distance(F.col("q"), F.col("search_vector"), layout=LAYOUT).alias("d")).toPandas()
    for q, part in hits.toPandas().groupby("query_id"):
        mine = part.sort_values("rank")
        exact = want[want["query_id"] == q].assign(r=lambda x: x["d"].round(9)).sort_values(["r", "drawing_id"]).head(7)
        assert np.allclose(mine["distance"], exact["d"])
        assert mine["drawing_id"].tolist()[:1] == exact["drawing_id"].tolist()[:1]


def test_special_cases(spark):
    row = spark.createDataFrame([([0.0, 0.0], [0.0, 0.0], [1.0, -1.0], [10.0, 20.0, 0.0], [20.0, 10.0, 0.0], [500.0, 0.0, 9.0])], "a array<double>, b array<double>, c array<double>, d array<double>, e array<double>, f array<double>")
    got = row.select(
        distance.jaccard_distance(F.col("a"), F.col("b")), distance.cosine_distance(F.col("a"), F.col("c")), distance.cosine_distance(F.col("c"), F.col("c")), distance.dimension_distance(F.col("d"), F.col("e")), distance.dimension_distance(F.col("d"), F.col("f"))
    ).first()
    assert tuple(got) == (0.0, 1.0, 1.0, 0.0, 1.0)
    assert distance.normalised_weights([0.0] * 7) == [0.0] * 7
    assert abs(sum(distance.normalised_weights([1.0] * 7)) - 1) < 1e-12


def test_text_search_ties_and_ids(spark):
    corpus = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)] + [(9, [0.0, 0.0])], "drawing_id int, llm_vector array<double>")
    hits = search.text_search(spark.createDataFrame([(1, [2.0, 0.0])], "query_id int, llm_vector array<double>"), corpus, k=3, dim=2)
    assert search.ranked_ids(hits).first()["ids"] == [0, 1, 2]


def test_encoding(spark):
    row = spark.createDataFrame([(["Ra 3.2", "Rz6.3", "Rt 0.1", "Ra 1..2", "Xx 3"], ["// 0.02 A", "=0", "= 0.5", "⌾ 3"], ["mK", "-h"])], "s array<string>, g array<string>, t array<string>")
    grades = row.select(F.transform("s", encode.surface_grade)).first()[0]
    assert grades == [8, 7, 15, 15, 15]
    gdt = row.select(encode.gdt_vector(F.col("g"))).first()[0]
    assert gdt[8] == 0.02 and gdt[7] == 0.5 and gdt[0] == 1.0
    assert row.select(encode.tolerance_vector(F.col("t"))).first()[0] == [0, 1, 0, 0, 1, 1, 0]


def test_representative_view(spark):
    views = spark.createDataFrame([(1, 0, [0.0, 0.0]), (1, 1, [1.0, 1.0]), (1, 2, [2.0, 2.0]), (2, 0, [5.0, 5.0])], "drawing_id int, view_pos int, embedding array<double>")
    drawings = spark.createDataFrame([(1,), (2,), (3,)], "drawing_id int")
    got = {r["drawing_id"]: (r["view_pos"], r["shape"]) for r in encode.representative_embedding(views, drawings=drawings, dim=2).collect()}
    assert got == {1: (1, [1.0, 1.0]), 2: (0, [5.0, 5.0]), 3: (None, [0.0, 0.0])}


def clustered(spark, n, centres=12, seed=8):
    rng = np.random.default_rng(seed)
    base = [np.concatenate([rng.integers(0, 2, 5), [rng.integers(0, 16)], rng.random(2), rng.integers(0, 2, 2), rng.integers(0, 900, 3), rng.normal(size=4)]).astype(float) for _ in range(centres)]
    rows = []
    for i in range(n):
        v = base[i % centres].copy()
        if i % 5:
            v[10:13] += rng.integers(0, 4, 3)
            v[13:] += rng.normal(0, 0.02, 4)
        rows.append((i, v.tolist()))
    rows += [(n, [0.0] * 17), (n + 1, [0.0] * 17), (n + 2, [1.0]), (n + 3, [float("nan")] * 17), (n + 4, [None] * 17), (n + 5, None)]
    return spark.createDataFrame(rows, "drawing_id int, search_vector array<double>")


def test_blocks_are_skipped_and_nothing_is_lost(spark, monkeypatch):
    monkeypatch.setattr(search, "LISTED", 1_000)  # several passes over the queries
    v = clustered(spark, 6_000).repartition(3)
    queries = v.where("drawing_id % 20 = 0").withColumnRenamed("drawing_id", "query_id")
    for weights in ([1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 6.0], [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 2.0], [1.0, 0.0, 0.0, 0.0, 0.5, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0, 0.0, 3.0, 0.0]):
        count = (spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0))
        hits = search.search(queries, v, k=4, weights=weights, layout=LAYOUT, count=count).toPandas()
        skipped, compared = count[0].value, count[1].value
        assert 2 * skipped > compared, (weights, skipped, compared)
        assert len(hits) == 4 * 301
        metric = search.composite_metric(weights, LAYOUT)
        rows = [(r["drawing_id"], r["search_vector"]) for r in v.collect() if r["search_vector"] and len(r["search_vector"]) == 17 and None not in r["search_vector"] and np.isfinite(r["search_vector"]).all()]
        ids, corpus = np.array([i for i, _ in rows]), np.array([x for _, x in rows])
        wanted = ids % 20 == 0
        full = metric.distance(metric.prepare(corpus[wanted]), metric.prepare(corpus))
        mine = {q: part.sort_values("rank")["distance"].to_numpy() for q, part in hits.groupby("query_id")}
        for q, line in zip(ids[wanted], full, strict=True):
            assert np.allclose(mine[q], np.sort(line)[:4], atol=1e-9)


def test_bounds_are_below_every_row(spark):
    rng = np.random.default_rng(2)
    kinds = {"material": 6, "surfaces": 1, "gdt": 5, "dim": 3}
    for trial in range(60):
        for name, n in kinds.items():
            kind = search._KINDS[name] if trial % 2 or name != "gdt" else search._Similarity()
            x = rng.integers(0, 3, (40, n)) * (rng.random((40, n)) < rng.random()) * rng.choice([1.0, -1.0, 2.5])
            a, b = kind.prepare(x[:15].astype(float)), kind.prepare(x[15:].astype(float))
            block = {key: np.array([value]) for key, value in kind.block(b).items()}
            assert (kind.bound(a, block)[:, 0] <= kind.distance(a, b).min(1) + 1e-9).all(), name


def test_weights_of_zero_and_below(spark):
    v = clustered(spark, 200)
    queries = v.where("drawing_id < 3").withColumnRenamed("drawing_id", "query_id")
    zero = search.search(queries, v, k=2, weights=[0.0] * 7, layout=LAYOUT).collect()
    assert sorted((r["query_id"], r["drawing_id"], r["distance"]) for r in zero) == [(q, d, 0.0) for q in range(3) for d in (0, 1)]
    away = search.search(queries, v, k=3, weights=[-1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0], layout=LAYOUT).toPandas()
    metric = search.composite_metric([-1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0], LAYOUT)
    corpus = np.array([r["search_vector"] for r in v.where("drawing_id < 202").orderBy("drawing_id").collect()])
    full = metric.distance(metric.prepare(corpus[:3]), metric.prepare(corpus))
    for q in range(3):
        assert np.allclose(away[away["query_id"] == q].sort_values("rank")["distance"], np.sort(full[q])[:3])
