import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sheetforge.operators import layout

RECT = "drawing_id int, rect_id int, x int, y int, w int, h int"
BOX = "drawing_id int, pos int, x int, y int, w int, h int, text string"


def plain_clusters(points, eps=20, least=20):
    points = np.array(points).reshape(-1, 2)
    near = [np.flatnonzero(((points - p) ** 2).sum(1) <= eps * eps) for p in points]
    core = [len(n) >= least for n in near]
    labels, now = [-1] * len(points), 0
    for i in range(len(points)):
        if labels[i] != -1 or not core[i]:
            continue
        todo = [i]
        while todo:
            j = todo.pop(0)
            if labels[j] != -1:
                continue
            labels[j] = now
            if core[j]:
                todo += [int(k) for k in near[j] if labels[k] == -1]
        now += 1
    return labels


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 160), st.integers(0, 60)), min_size=1, max_size=120))
def test_density_clusters(points):
    got = layout.density_clusters(np.array(points), eps=12, least=5).tolist()
    want = plain_clusters(points, 12, 5)
    assert [g == -1 for g in got] == [w == -1 for w in want]
    core = [sum((a - c) ** 2 + (b - d) ** 2 <= 144 for c, d in points) >= 5 for a, b in points]
    assert [g for g, c in zip(got, core) if c] == [w for w, c in zip(want, core) if c]


def test_grid_equals_all_pairs():
    points = np.random.default_rng(2).integers(0, 400, (1_600, 2))
    assert (layout.density_clusters(points, 9, 6) == layout._few_clusters(points, 9, 6)).all()


def test_corners_count_twice():
    edges = layout.perimeter(0, 0, 2, 1)
    assert len(edges) == 2 * 3 + 2 * 2 and (edges == [0, 0]).all(1).sum() == 2


def test_lines_can_share_a_box():
    assert layout.line_rows([0, 9, 4], 10) == [[0, 2], [1]]
    assert layout.line_rows([0, 8, 4], 12) == [[0, 2], [1, 2]]


def test_text_clusters_and_noise(spark):
    boxes = spark.createDataFrame([(1, 0, 0, 0, 30, 10, "a"), (1, 1, 50, 0, 30, 10, "b"), (1, 2, 400, 400, 1, 1, "c"), (1, 3, 110, 0, 30, 10, "d")], BOX)
    got = {r["pos"]: r["cluster"] for r in layout.text_clusters(boxes).collect()}
    assert got[0] == got[1] and got[2] not in (got[0], got[3])


def test_reachability(spark):
    rects = spark.createDataFrame([(1, 0, 0, 0, 500, 500), (1, 1, 10, 10, 40, 40), (1, 2, 69, 10, 20, 20), (1, 3, 250, 250, 20, 20), (2, 0, 0, 0, 9, 9)], RECT)
    frames = layout.inner_frames(rects, spark.createDataFrame([(1, 400_000), (2, 400_000)], "drawing_id int, image_area long"))
    assert [r["rect_id"] for r in frames.collect()] == [0]
    got = {(r["drawing_id"], r["rect_id"]) for r in layout.reachable_cells(rects, frames).collect()}
    assert got == {(1, 0), (1, 1), (1, 2)}


def test_nested_and_equal_sizes(spark):
    rects = spark.createDataFrame([(1, 0, 0, 0, 100, 100), (1, 1, 10, 10, 20, 20), (1, 2, 200, 0, 50, 50), (1, 3, 205, 0, 50, 50)], RECT)
    assert {r["rect_id"] for r in layout.without_nested(rects).collect()} == {0}


def test_cell_edges_are_out(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0, 20, 20)], RECT)
    boxes = spark.createDataFrame([(1, 0, 10, 10, 20, 20, "edge"), (1, 1, 5, 5, 10, 10, "in")], BOX)
    assert [r["text"] for r in layout.assign_cells(boxes, cells).collect()] == ["in"]


def test_regions_are_half_open(spark):
    frame = spark.createDataFrame([(1, 9, 0, 0, 200, 200)], RECT)
    cells = spark.createDataFrame([(1, 0, 50, 50, 20, 20)], RECT)
    boxes = spark.createDataFrame([(1, i, x, 60, 0, 0, "t") for i, x in enumerate((45, 44, 74, 75, 4, 5, 195))], BOX)
    got = {r["pos"]: r["region"] for r in layout.box_regions(boxes, cells, frame).collect()}
    assert got == {0: "info", 1: "drawing", 2: "info", 3: "drawing", 4: "outside", 5: "drawing", 6: "outside"}


def test_rotation(spark):
    rects = spark.createDataFrame([(1, i, 10, 20, 30, 40, r, 100, 200) for i, r in enumerate((0, 90, 180, 270))], RECT + ", rotation int, image_w int, image_h int")
    got = [tuple(r)[2:6] for r in layout.rotate_rects(rects).orderBy("rect_id").collect()]
    assert got == [(10, 20, 30, 40), (20, 60, 40, 30), (60, 140, 30, 40), (140, 10, 40, 30)]


def test_whole_page(spark):
    rects = spark.createDataFrame([(1, 0, 0, 0, 600, 600), (1, 1, 0, 500, 200, 100), (1, 2, 0, 500, 200, 100)], RECT)
    pages = spark.createDataFrame([(1, 700_000), (2, 100)], "drawing_id int, image_area long")
    boxes = spark.createDataFrame(
        [(1, 0, 60, 520, 20, 10, "right"), (1, 1, 20, 521, 20, 10, "left"), (1, 2, 20, 560, 20, 10, "below"), (1, 3, 300, 100, 60, 10, "note"), (1, 4, 300, 300, 20, 10, "120"), (2, 0, 1, 1, 9, 9, "loose"), (2, 1, 1, 30, 9, 9, "7")], BOX
    )
    got = {(r["drawing_id"], r["kind"], r["text"], r["is_text"]) for r in layout.merge_text(boxes, rects, pages).collect()}
    assert got == {(1, "cell", "left right\nbelow", True), (1, "cluster", "note", True), (1, "measure", "120", False), (2, "box", "loose", True), (2, "box", "7", False)}


def test_text_of_groups_joins_nothing_back(spark):
    rows = [(1, 0, 0, 0, 20, 10, "a", 0, 0, 90, 80, 5), (1, 1, 30, 1, 20, 10, "b", 0, 0, 90, 80, 5), (1, 2, 0, 40, 20, 10, "c", 0, 0, 90, 80, 5), (2, 0, 0, 0, 9, 9, "d", 7, 7, 1, 1, 5)]
    boxes = spark.createDataFrame(rows, BOX + ", c_x int, c_y int, c_w int, c_h int, rect_id int")
    out = layout._framed_text(boxes, ["drawing_id", "rect_id"], ("c_x", "c_y", "c_w", "c_h"))
    assert sorted(tuple(r[c] for c in ("drawing_id", "text", "x", "y", "w", "h")) for r in out.collect()) == [(1, "a b\nc", 0, 0, 90, 80), (2, "d", 7, 7, 1, 1)]
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 2
