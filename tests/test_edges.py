"""Clusters by intervals on edges against DBSCAN over pixel lists."""

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sheetforge.operators import edges, layout, tiles

BOX = "drawing_id int, pos int, x int, y int, w int, h int"


def by_pixels(boxes, eps=layout.EPS, least=layout.MIN_POINTS):
    points = np.concatenate([layout.perimeter(*b) for b in boxes])
    labels = layout.density_clusters(points, eps, least)
    first = {}
    for i, p in enumerate(map(tuple, points.tolist())):
        first.setdefault(p, i)
    return [int(labels[first[b[0], b[1]]]) for b in boxes]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(-30, 120), st.integers(-30, 90), st.integers(0, 14), st.integers(0, 9)), min_size=1, max_size=14), st.sampled_from([(20, 20), (7, 9), (5, 18), (12, 40)]))
def test_labels_equal_those_of_pixels(boxes, how):
    assert edges.box_clusters(np.array(boxes), *how).tolist() == by_pixels(boxes, *how)


def test_large_boxes_and_dots():
    r = np.random.default_rng(3)
    for _ in range(15):
        boxes = [tuple(int(v) for v in (*r.integers(0, 700, 2), *r.choice([r.integers(0, 3, 2), r.integers(5, 60, 2), r.integers(100, 400, 2)]))) for _ in range(25)]
        assert edges.box_clusters(np.array(boxes), 20, 20).tolist() == by_pixels(boxes)


@pytest.mark.parametrize("tile", [64, 100, 1_024])
def test_tiles_give_the_same_labels(spark, monkeypatch, tile):
    rows = []
    r = np.random.default_rng(4)
    for d in range(4):
        rows += [(d, i, *(int(v) for v in (*r.integers(-50, 420, 2), *r.choice([r.integers(0, 3, 2), r.integers(2, 25, 2), r.integers(60, 200, 2)])))) for i in range(22)]
    rows.append((1, 5, *rows[22 + 5][2:]))  # a repeated pos
    boxes = spark.createDataFrame(rows, BOX)
    want = sorted(map(tuple, layout.text_clusters(boxes).collect()))
    monkeypatch.setattr(tiles, "MANY", 5)
    monkeypatch.setattr(edges, "TILE", tile)
    assert sorted(map(tuple, layout.text_clusters(boxes).collect())) == want


def test_many_pages_at_once():
    rng = np.random.default_rng(4)
    pages = [np.stack([rng.integers(-300, 300, n), rng.integers(-300, 300, n), rng.integers(0, 45, n), rng.integers(0, 30, n)], axis=1) for n in rng.integers(1, 9, 60)]
    pages[7][0] = [0, 0, 5_000, 4_000]  # wider than all other pages
    page = np.repeat(np.arange(len(pages)) * 3, [len(p) for p in pages])
    for eps, least in ((20, 20), (20, 60), (3, 5)):
        found = edges.box_clusters(np.concatenate(pages), eps, least, page)
        assert found.tolist() == [x for p in pages for x in by_pixels(p.tolist(), eps, least)]


def test_sure_edges_are_core():
    rng = np.random.default_rng(5)
    for box in np.stack([rng.integers(0, 9, 200), rng.integers(0, 9, 200), rng.integers(0, 30, 200), rng.integers(0, 30, 200)], axis=1):
        for least in (10, 20, 40, 60):
            own = edges.sides(box[None])
            first, counts = edges.pixel_counts(own, own, 20)
            core = [bool((counts[a:b] >= least).all()) for a, b in zip(first, first[1:], strict=False)]
            assert all(c for c, sure in zip(core, edges.sure_edges(box[None], 20, least), strict=True) if sure)


def test_a_page_costs_no_round_of_its_own():
    rng = np.random.default_rng(6)
    n = 60_000
    boxes = np.stack([rng.integers(0, 500, n), rng.integers(0, 500, n), rng.integers(20, 50, n), rng.integers(10, 16, n)], axis=1)
    began = time.process_time()
    for at in range(0, n, 3_000):
        edges.box_clusters(boxes[at : at + 3_000], 20, 20, np.arange(3_000) // 3)
    # one page at a time these 20,000 pages took 26 s
    assert time.process_time() - began < 8
