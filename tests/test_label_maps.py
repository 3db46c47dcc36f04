"""Label maps and runs against counting pixel by pixel."""

import random
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sheetforge.operators import evaluate, labelmaps


def _images(seed, labels):
    r = random.Random(seed)

    def image(n):
        out = []
        while len(out) < n:
            out += [r.choice(labels)] * r.randrange(1, 40)
        return out[:n]

    sizes = [0, 1, 7, 4096, 5000, 20_000]
    return {i: [(image(n), image(n)) for n in sizes[: i + 1]] for i in range(len(sizes))}


def _plain(images):
    return {(i, g, p): n for i, tiles in images.items() for (g, p), n in Counter(x for a, b in tiles for x in zip(a, b, strict=True)).items()}


def test_byte_maps_count_every_pixel_pair(spark):
    images = _images(1, [0, 1, 2, 200, 255])
    rows = [(i, bytearray(a), bytearray(b), 9) for i, tiles in images.items() for a, b in tiles] + [(3, None, bytearray(5), 9), (4, bytearray(5), None, 9), (None, bytearray([1]), bytearray([2]), 9)]
    maps = spark.createDataFrame(rows, "image_id int, gt binary, pred binary, counts int")
    got = {(r["image_id"], r["gt"], r["pred"]): r["n"] for r in labelmaps.map_pairs(maps).collect()}
    assert got == _plain(images) | {(None, 1, 2): 1}
    assert labelmaps.map_pairs(maps.limit(0)).count() == 0
    runs = maps.select("image_id", *[labelmaps.run_lengths(F.col(c)).alias(c) for c in ("gt", "pred")])
    assert {(r["image_id"], r["gt"], r["pred"]): r["n"] for r in labelmaps.run_pairs(runs).collect()} == got
    assert all(x["label"] != y["label"] for r in runs.where("gt is not null").collect() for x, y in zip(r["gt"], r["gt"][1:]))


def test_runs_need_no_more_work_for_larger_images(spark):
    big = 10**12
    rows = [(1, [(7, big), (-3, 0), (9, 5), (9, 5)], [(7, big - 1), (2, 11)]), (2, [], []), (3, [(4, 0)], [])]
    maps = spark.createDataFrame(rows, "image_id int, gt array<struct<label:int,n:bigint>>, pred array<struct<label:int,n:bigint>>")
    assert {tuple(r) for r in labelmaps.run_pairs(maps).collect()} == {(1, 7, 7, big - 1), (1, 7, 2, 1), (1, 9, 2, 10)}


def test_maps_that_do_not_fit_fail(spark):
    with pytest.raises(Exception, match="3 and 2 pixels"):
        labelmaps.map_pairs(spark.createDataFrame([(1, bytearray(3), bytearray(2))], "image_id int, gt binary, pred binary")).collect()
    runs = "image_id int, gt array<struct<label:int,n:bigint>>, pred array<struct<label:int,n:bigint>>"
    with pytest.raises(Exception, match="3 and 2 pixels"):
        labelmaps.run_pairs(spark.createDataFrame([(1, [(0, 3)], [(0, 2)])], runs)).collect()
    with pytest.raises(Exception, match="labels from 0 to 255"):
        labelmaps.packed_labels(spark.createDataFrame([(1, 0, 256, 0)], "image_id int, pos long, gt int, pred int"), ["image_id"]).collect()


def test_scores_equal_those_of_pixels(spark):
    images = _images(2, [0, 1, 2])
    pixels = spark.createDataFrame([(i, t, k, g, p) for i, tiles in images.items() for t, (a, b) in enumerate(tiles) for k, (g, p) in enumerate(zip(a, b, strict=True))], "image_id int, tile int, pos int, gt int, pred int")
    maps = labelmaps.packed_labels(pixels, ["image_id", "tile"])
    for a, b in zip(maps.where("image_id = 5").orderBy("tile").collect(), images[5][1:], strict=True):
        assert (list(a["gt"]), list(a["pred"])) == b
    pairs = labelmaps.map_pairs(maps)
    for scored in (evaluate.per_class_scores, evaluate.binary_scores, evaluate.segmentation_scores):
        assert sorted(map(str, scored(pixels).collect())) == sorted(map(str, scored(pairs).collect()))


def test_runs_of_a_batch_hold_no_object_for_a_run(monkeypatch):
    taken = {}
    monkeypatch.setattr(labelmaps.F, "arrow_udf", lambda _: lambda f: taken.update(run=f) or (lambda c: c))
    labelmaps.run_lengths("gt")
    tile = bytes(range(256)) * 16
    maps = pa.array([tile] * 300 + [None, b"", b"\x07\x07"], pa.binary())
    tracemalloc.start()
    runs = taken["run"](maps)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert runs[0].as_py()[:2] == [{"label": 0, "n": 1}, {"label": 1, "n": 1}] and len(runs[299]) == 4_096
    assert runs[300:].to_pylist() == [None, [], [{"label": 7, "n": 2}]]
    # 1.2 million runs; a dict for each took some 300 MB
    assert peak < 60e6
