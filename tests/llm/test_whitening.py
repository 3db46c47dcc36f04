"""Whitening against a dense eigendecomposition, and the qd solver against a dense SVD."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from sheetforge.llm import qd, queries, whitening

SMALL = "/root/testdata/sf0.001"


def shapes():
    r = np.random.default_rng(0)
    left, right = (np.linalg.qr(r.normal(size=(30, 30)))[0] for _ in range(2))
    spectra = {"repeated": [5.0] * 10 + [2.0] * 10 + [1.0] * 10, "deficient": [5.0] * 10 + [*np.linspace(1, 2, 10)] + [0.0] * 10, "graded": [10.0**-x for x in np.arange(0, 15, 0.5)], "close": [1 + 1e-9 * x for x in range(30)]}
    out = {name: left @ np.diag(values) @ right for name, values in spectra.items()}
    out |= {"dense": r.normal(size=(64, 64)), "triangle": np.linalg.qr(r.normal(size=(900, 64)), "r"), "identity": np.eye(12), "diagonal": np.diag([3.0, 3, 3, 1, 1, 0.5]), "ones": np.ones((9, 9))}
    return out | {"one": np.array([[3.0]]), "two": r.normal(size=(2, 2)), "shifted": np.triu(r.normal(size=(8, 8)), 1), "zero": np.zeros((3, 3))}


@pytest.mark.parametrize("name", list(shapes()))
def test_singular_values_and_vectors(name):
    m = shapes()[name]
    values, vectors = qd.right_singular(m)
    top = max(np.linalg.norm(m, 2), 1e-300)
    assert np.abs(values - np.linalg.svd(m, compute_uv=False)).max() <= 1e-13 * top
    assert np.abs(vectors.T @ vectors - np.eye(len(m))).max() < 1e-11
    assert np.abs(m.T @ (m @ vectors) - vectors * values**2).max() <= 1e-13 * top * top


def test_bidiagonal_form_keeps_the_matrix():
    m = np.random.default_rng(1).normal(size=(20, 20))
    a, b, p = qd.bidiagonalise(m)
    both = np.diag(a) + np.diag(b, 1)
    assert (a >= 0).all() and (b >= 0).all()
    assert np.abs(p.T @ p - np.eye(20)).max() < 1e-13
    assert np.abs(p.T @ m.T @ m @ p - both.T @ both).max() < 1e-11


def test_small_values_of_a_bidiagonal_keep_their_digits():
    # the smallest value of this Kahan-like matrix is far below the rounding of the largest; dense solvers lose it
    from fractions import Fraction

    a, b = np.array([1.0, 1e-5, 1e-10, 1e-15]), np.array([1.0, 1e-5, 1e-10])
    values = qd.dqds(a, b)
    full = [[Fraction(0)] * 4 for _ in range(4)]
    for i in range(4):
        full[i][i] = Fraction(float(a[i]))
        if i < 3:
            full[i][i + 1] = Fraction(float(b[i]))
    gram = [[sum(full[k][i] * full[k][j] for k in range(4)) for j in range(4)] for i in range(4)]

    def below(x: Fraction) -> int:
        """Eigenvalues of the exact Gram matrix below x, by Sturm's count."""
        count, last = 0, None
        for i in range(4):
            last = gram[i][i] - x - (gram[i][i - 1] ** 2 / last if i else 0)
            count += last < 0
        return count

    for rank, value in enumerate(values):
        square = Fraction(float(value)) ** 2
        slack = Fraction(1, 10**13)
        assert below(square * (1 - slack)) <= 3 - rank < below(square * (1 + slack))


def plain(rows, components=16):
    """(rows, n, S, eigenvalues, eigenvectors) by a dense solver over the distinct whole vectors."""
    kept = [(i, [int(np.floor(64 * float(c))) + 1_000_000 for c in v]) for i, v in rows]
    fit = np.array(sorted({tuple(x) for _, x in kept}), dtype=np.int64)
    n, total = len(fit), fit.sum(0)
    centred = (n * fit - total) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return kept, fit, n, total, values[::-1], vectors[:, ::-1]


def test_query_on_all_vectors(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{SMALL}/embeddings.parquet").to_pylist()]
    kept, fit, n, total, values, vectors = plain(rows)
    got = queries.op12_whitening(spark, SMALL)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    table = got.toPandas()
    assert len(table) == 16 * len(rows) and set(table["n"]) == {n} and table["identity_error"].nunique() == 1 and table["identity_error"].max() < 1e-9
    wide = table.pivot(index="vec_id", columns="component", values="whitened")
    first = table[table["component"] == 1].set_index("vec_id")
    for i, x in kept:
        top = n * np.array(x, dtype=object) - total
        assert first.loc[i, "deviation"] == (top**2).sum()
    x = np.array([v for _, v in kept])
    centred = (n * x - total) / n
    for c in range(16):
        mine = wide.loc[[i for i, _ in kept], c + 1].to_numpy()
        want = centred @ vectors[:, c] / np.sqrt(values[c])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-6
        assert abs(table[table["component"] == c + 1]["explained"].iloc[0] / (values[c] / values.sum()) - 1) < 1e-10


def test_odd_vectors_repeats_and_names(spark):
    nan, inf = float("nan"), float("inf")
    r = np.random.default_rng(2)
    good = [(i, r.normal(size=3).tolist()) for i in range(40)]
    odd = [(90, None), (91, [1.0, None, 2.0]), (92, [1.0, nan, 2.0]), (93, [inf, 1.0, 2.0]), (94, [1.0, 2.0]), (95, [])]
    more = [(None, good[0][1]), (3, good[3][1]), (3, good[5][1]), (7, [v + 1e-6 for v in good[7][1]])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in [*good, *odd, *more]], "vec_id long, embedding array<double>, n int, y string")
    out = whitening.whiten(df).toPandas()
    kept, fit, n, total, values, _ = plain([*good, *more])
    assert len(out) == 3 * len(kept) and set(out["n"]) == {n} and n < len(kept)
    assert out["identity_error"].max() < 1e-12 and abs(out.drop_duplicates("component")["explained"].sum() - 1) < 1e-12
    assert out["id"].isna().sum() == 3
    # nothing varies, or nothing is there
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.where("vec_id = 95")).count() == 0
    assert whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<double>")).count() == 0
    # two dimensions that move together have one component
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], "vec_id long, embedding array<double>")
    out = whitening.whiten(line).toPandas()
    assert set(out["component"]) == {1} and len(out) == 9 and abs(out["explained"].iloc[0] - 1) < 1e-12 and abs((out["whitened"] ** 2).mean() - 1) < 1e-12


def test_large_entries_are_exact_or_null(spark):
    rows = [(i, [float((-1) ** i * 2.0**s), float(i)]) for i, s in enumerate([3, 20, 24, 25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    kept, fit, n, total, *_ = plain(rows)
    out = {r["id"]: r["deviation"] for r in whitening.whiten(df).collect()}
    for i, x in kept:
        want = ((n * np.array(x, dtype=object) - total) ** 2).sum()
        assert out[i] == (want if want < 1 << 63 else None)
    far = spark.createDataFrame([(i, [1e38 * (-1) ** i, float(i)]) for i in range(6)], "vec_id long, embedding array<double>")
    assert {r["deviation"] for r in whitening.whiten(far).collect()} == {None}
