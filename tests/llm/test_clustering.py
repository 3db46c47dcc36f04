"""Clustering over zone maps against a plain loop in whole numbers."""

import hashlib
import itertools

import numpy as np
import pyarrow.parquet as pq
import pytest

from sheetforge.llm import clustering, queries
from sheetforge.llm.common import stored

SMALL = "/root/testdata/sf0.001"


def plain(rows, dims=64, k=40, rounds=5):
    """[(id, cluster, distance, cluster inertia, inertia, digest)] by Python's whole numbers."""
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], dtype="<i4").tobytes()))
    centroids = [v for _, v in first[:k]]

    def nearest():
        c = np.array(centroids, dtype=object)
        out = []
        for i, v in kept:
            d = ((c - np.array(v, dtype=object)) ** 2).sum(1).tolist()
            at = min(range(len(d)), key=lambda x: (d[x], x))
            out.append((i, at, d[at], v))
        return out

    for _ in range(rounds):
        found = nearest()
        for c in range(len(centroids)):
            mine = [v for _, at, _, v in found if at == c]
            if mine:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine)]
    found = nearest()
    sums = {}
    for _, at, d, _ in found:
        sums[at] = sums.get(at, 0) + d
    return [(i, at, d, sums[at], sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[at])).encode()).hexdigest()) for i, at, d, _ in found]


def same(got, want):
    return sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize(("dims", "bits"), [(1, 3), (2, 3), (3, 2), (5, 1)])
def test_the_curve_visits_all_cells_by_single_steps(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = [k.tobytes() for k in clustering.hilbert_keys(cells, bits)]
    assert len(set(keys)) == len(cells)
    path = cells[sorted(range(len(cells)), key=keys.__getitem__)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_candidates_hold_every_nearest_centroid():
    r = np.random.default_rng(4)
    pruned = 0
    for spread in (1, 5, 60):
        for _ in range(60):
            points = r.integers(-100, 100, 6) + r.integers(-spread, spread + 1, (40, 6))
            centroids = r.integers(-120, 120, (15, 6))
            some = clustering.candidates(points.min(0).astype(float), points.max(0).astype(float), centroids.astype(float))
            near, distance = clustering.nearest(points, centroids)
            assert set(near) <= set(some)
            again, same_distance = clustering.nearest(points, centroids[some])
            assert (some[again] == near).all() and (same_distance == distance).all()
            pruned += 15 - len(some)
    assert pruned > 1_000


def test_large_components_are_exact():
    points = np.array([[clustering.LARGEST, -clustering.LARGEST], [clustering.LARGEST - 1, 7]])
    centroids = np.array([[-clustering.LARGEST, clustering.LARGEST], [clustering.LARGEST, 6]])
    near, distance = clustering.nearest(points, centroids)
    assert near.tolist() == [1, 1] and distance.tolist() == [(clustering.LARGEST + 6) ** 2, 2]


def test_query_on_all_vectors(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{SMALL}/embeddings.parquet").to_pylist()]
    got = queries.op11_clusters(spark, SMALL)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert same(got.collect(), plain(rows))


def test_odd_vectors_ties_repeats_and_names(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 5), 0.5, -1.0]) for i in range(30)]
    odd = [(90, None), (91, [1.0, None, 2.0]), (92, [1.0, nan, 2.0]), (93, [inf, 1.0, 2.0]), (94, [1.0, 2.0]), (95, [])]
    rows = [*good, *odd, (None, [0.0, 0.0, 0.0]), (None, [9.0, 0.0, 0.0]), (3, [3.0, 0.5, -1.0]), (3, [7.0, 7.0, 7.0]), (97, [2.0**17, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, v string, cluster string")
    assert same(clustering.cluster(df, dims=3, k=4, block_rows=16).collect(), plain(rows, dims=3, k=4))
    assert clustering.cluster(df, dims=3, k=99).count() == 35  # fewer vectors than centroids
    assert clustering.cluster(df.limit(0), dims=3).count() == 0
    assert clustering.cluster(df, dims=8).count() == 0
    # beyond LARGEST components are held, and a sum that no long holds is null
    far = spark.createDataFrame([(i, [1e30 * (-1) ** i, 0.0, 0.0]) for i in range(600)], "vec_id long, embedding array<double>")
    out = clustering.cluster(far, dims=3, k=1).collect()
    assert len(out) == 600 and {r["distance"] for r in out} == {clustering.LARGEST**2} and {r["inertia"] for r in out} == {None}


def test_copies_and_clusters_are_pruned(spark):
    r = np.random.default_rng(6)
    centres = r.normal(0, 4, (40, 64))
    rows = [(i, (centres[i % 40] + r.normal(0, 0.02, 64)).tolist()) for i in range(1_600)] + [(9_000 + i, centres[0].tolist()) for i in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = stored(clustering.whole_vectors(df), "vectors")
    blocks = stored(clustering.curve_blocks(vectors, 64, 16), "blocks")
    centroids = clustering.first_centroids(vectors, 40, 64, "2:")
    counts = clustering.candidate_counts(blocks, centroids).collect()
    assert sum(c["n"] for c in counts) == len(rows)
    assert sum(c["n"] * c["candidates"] for c in counts) < 0.5 * len(rows) * 40
