"""Tiled joins against the gathered ones and against plain loops."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sheetforge.operators import layout, tiles

RECT = "drawing_id int, rect_id int, x int, y int, w int, h int"


def drawing(n, seed, wide=4_000, drawings=3):
    r = np.random.default_rng(seed)
    rows = []
    for d in range(drawings):
        for i in range(n):
            w, h = (int(v) for v in r.choice([r.integers(0, 12, 2), r.integers(10, 300, 2), r.integers(500, wide, 2)]))
            rows.append((d, i, int(r.integers(-100, wide)), int(r.integers(-100, wide)), w, h))
        rows.append((d, n, *rows[-1][2:]))  # a repeat
    return rows


@pytest.fixture
def few(monkeypatch):
    monkeypatch.setattr(tiles, "MANY", 10)


def strictly_in(a, b):
    cx, cy = a[2] + a[4] // 2, a[3] + a[5] // 2
    return b[2] < cx < b[2] + b[4] and b[3] < cy < b[3] + b[5]


def plain_nested(rows):
    lost = set()
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[2:] != b[2:] and strictly_in(a, b):
                loser = b if a[4] * a[5] >= b[4] * b[5] else a
                lost.add((loser[0], loser[1]))
    return sorted(r for r in rows if (r[0], r[1]) not in lost)


@pytest.mark.parametrize("many", [10, 10_000])
def test_nested_by_tiles_and_gathered(spark, monkeypatch, many):
    monkeypatch.setattr(tiles, "MANY", many)
    rows = drawing(120, 1) + [(9, 0, 5, 5, 40, 40)]
    assert sorted(map(tuple, layout.without_nested(spark.createDataFrame(rows, RECT)).collect())) == plain_nested(rows)


@pytest.mark.parametrize("many", [10, 10_000])
def test_cells_by_tiles_and_joined(spark, monkeypatch, many):
    monkeypatch.setattr(tiles, "MANY", many)
    cells, boxes = drawing(60, 2), drawing(80, 3)
    got = layout.assign_cells(spark.createDataFrame(boxes, RECT.replace("rect_id", "pos")), spark.createDataFrame(cells, RECT)).select("drawing_id", "rect_id", "pos").collect()
    assert sorted(map(tuple, got)) == sorted((c[0], c[1], b[1]) for b in boxes for c in cells if b[0] == c[0] and strictly_in(b, c))


@pytest.mark.parametrize("many", [10, 10_000])
def test_regions_by_tiles_and_gathered(spark, monkeypatch, many):
    monkeypatch.setattr(tiles, "MANY", many)
    cells, boxes = drawing(40, 4), drawing(80, 5, drawings=4)
    frames = [(d, 0, 50, 50, 3_000, 2_500) for d in (0, 1)]

    def region(b):
        frame = next((f for f in frames if f[0] == b[0]), None)
        if frame is None:
            return "outside"
        cx, cy, g = b[2] + b[4] // 2, b[3] + b[5] // 2, layout.GROWN
        if any(c[0] == b[0] and c[4] * c[5] < frame[4] * frame[5] and c[2] - g <= cx < c[2] + c[4] + g and c[3] - g <= cy < c[3] + c[5] + g for c in cells):
            return "info"
        return "drawing" if frame[2] + g <= cx < frame[2] + frame[4] - g and frame[3] + g <= cy < frame[3] + frame[5] - g else "outside"

    out = layout.box_regions(spark.createDataFrame(boxes, RECT.replace("rect_id", "pos")), spark.createDataFrame(cells, RECT), spark.createDataFrame(frames, RECT))
    assert out.columns == ["drawing_id", "pos", "x", "y", "w", "h", "region"]
    assert sorted(map(tuple, out.collect())) == sorted((*b, region(b)) for b in boxes)


def test_a_drawing_of_50000_boxes_is_dealt_over_tasks(spark):
    side = 224  # boxes of 10 by 10, 20 apart, each with a smaller one inside
    grid = spark.range(side * side).select(F.lit(1).alias("drawing_id"), F.col("id").cast("int").alias("rect_id"), (F.col("id") % side * 20).cast("int").alias("x"), F.floor(F.col("id") / side * 1).cast("int").alias("row"))
    outer = grid.select("drawing_id", "rect_id", "x", (F.col("row") * 20).alias("y"), F.lit(10).alias("w"), F.lit(10).alias("h"))
    inner = outer.select("drawing_id", (F.col("rect_id") + 1_000_000).alias("rect_id"), (F.col("x") + 3).alias("x"), (F.col("y") + 3).alias("y"), F.lit(4).alias("w"), F.lit(4).alias("h"))
    both = outer.unionByName(inner)
    kept = layout.without_nested(both)
    assert kept.count() == side * side and kept.where("rect_id >= 1000000").count() == 0
    pairs = layout.assign_cells(inner.withColumnRenamed("rect_id", "pos"), outer)
    assert pairs.where("pos = rect_id + 1000000").count() == pairs.count() == side * side
    parts = pairs.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in parts) < 0.5 * side * side


def test_no_join_of_a_drawing_with_itself_and_few_exchanges(spark):
    rects = spark.createDataFrame(drawing(9, 6), RECT)
    plan = layout.without_nested(rects)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    plan = layout.box_regions(rects.withColumnRenamed("rect_id", "pos"), rects, rects.where("rect_id = 0"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2


@pytest.mark.parametrize("seed", [11, 12])
def test_reachability_by_rounds_and_by_page(spark, monkeypatch, seed):
    r = np.random.default_rng(seed)
    rows = []
    for d in range(6):
        for i in range(60):
            w, h = (int(v) for v in r.choice([r.integers(1, 15, 2), r.integers(10, 90, 2), r.integers(150, 400, 2)]))
            rows.append((d, i, *(int(v) for v in r.integers(0, 1_500, 2)), w, h))
        if d < 4:
            rows.append((d, 60, 100, 100, 900, 700))
    rects = spark.createDataFrame(rows, RECT)
    frames = rects.where("rect_id = 60")
    want = sorted(map(tuple, layout.reachable_cells(rects, frames).collect()))
    assert 20 < len(want) < len(rows) - 60
    monkeypatch.setattr(tiles, "MANY", 10)
    assert sorted(map(tuple, layout.reachable_cells(rects, frames).collect())) == want


def test_a_chain_of_20000_cells(spark):
    n = 20_000
    chain = spark.range(n).select(F.lit(1).alias("drawing_id"), F.col("id").cast("int").alias("rect_id"), (F.col("id") * 30).cast("int").alias("x"), F.lit(0).alias("y"), F.lit(25).alias("w"), F.lit(25).alias("h"))
    lone = chain.where("rect_id < 50").selectExpr("drawing_id", "rect_id + 100000 as rect_id", "x", "y + 500 as y", "w", "h")
    frames = spark.createDataFrame([(1, 999_999, -105, 0, 100, 25)], RECT)
    out = layout.reachable_cells(chain.unionByName(lone), frames)
    assert out.count() == n and out.where("rect_id >= 100000").count() == 0


def test_many_drawings_at_once_reach_what_each_reaches_alone(spark, monkeypatch):
    rows = np.random.default_rng(9)
    rects = [(d, i, *map(int, rows.integers(0, 220, 2)), *map(int, rows.integers(0, 40, 2))) for d in range(40) for i in range(int(rows.integers(1, 9)))]
    frames = [(d, 99, 0, 0, 100, 100) for d in range(0, 40, 2)]
    want = set()
    for d, *_, x, y, w, h in frames:
        todo = [(x, y, w, h)]
        while todo:
            f = todo.pop()
            for r in rects:
                if r[0] == d and r not in want and layout._touched(*f, *(np.array([v]) for v in r[2:]), 20)[0]:
                    want.add(r)
                    todo.append(r[2:])
    calls = []
    inner = layout._touched
    monkeypatch.setattr(layout, "_touched", lambda *a: calls.append(1) or inner(*a))
    captured = {}
    monkeypatch.setattr(layout, "_grouped", lambda df, group, columns, run, added, **_: captured.update(run=run) or df)
    layout.reachable_cells(spark.createDataFrame(rects, RECT), spark.createDataFrame(frames, RECT))
    every = sorted([(*r, False) for r in rects] + [(*f, True) for f in frames])
    batch = pa.RecordBatch.from_pylist([dict(zip(("rect_id", "x", "y", "w", "h", "_frame"), r[1:], strict=True)) for r in every])
    at, _ = captured["run"](np.array([r[0] for r in every]), batch)
    assert {every[i][:6] for i in at} == want
    # as many rounds as the longest chain has steps, not one for each drawing and cell
    assert len(calls) < 15
