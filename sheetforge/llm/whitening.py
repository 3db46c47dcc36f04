"""Whitening of embeddings by a bidiagonal qd solver.

Distinct vectors, as whole numbers, are the fit list. Each task reduces its centred rows block by block to a triangle (QR of the last
triangle over the next block); triangles are joined the same way in two shuffled levels, so the driver gets a few of them, each as
wide as a vector. The singular values of the last one (``qd``: Householder bidiagonalisation, dqds) are those of all centred rows; its
right vectors, from twisted factorisations, are the whitening directions. The covariance itself is never formed, so small
directions keep their digits.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetforge.llm import qd
from sheetforge.llm.common import dropped, finite_rows, stored
from sheetforge.shipping import ship

#: Partial results are joined in so many groups, those in so many, and the driver joins these.
LEVELS = (1_024, 32)
#: Entries beyond this are held there; so are their squares' sums, which no long holds: such deviations are null.
LARGEST = 1 << 62
_LONG = (1 << 63) - 1


def _packed(y: np.ndarray) -> list[bytes]:
    """Rows of whole numbers as bytes, each in the least of 2, 4 and 8 bytes a number that holds it: equal rows have equal bytes."""
    size = np.maximum(np.abs(y).max(axis=1, initial=0), 1)
    out = []
    for row, most in zip(y, size):
        out.append(row.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8").tobytes())
    return out


def _unpacked(rows: list[bytes], dims: int) -> np.ndarray:
    if len({len(r) for r in rows}) == 1:
        return np.frombuffer(b"".join(rows), dtype=f"<i{len(rows[0]) // dims}").reshape(-1, dims).astype(np.int64)
    return np.array([np.frombuffer(r, dtype=f"<i{len(r) // dims}") for r in rows], dtype=np.int64).reshape(-1, dims)


def _whole(x: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(x * scale), -float(LARGEST), float(LARGEST)).astype(np.int64)


def _joined(df: DataFrame, columns: str, partial: Callable[[Iterator[pa.RecordBatch]], bytes | None], join: Callable[[list[bytes]], bytes]) -> bytes | None:
    """One value of all rows: ``partial`` of each task's batches, joined by ``join`` in the groups of LEVELS, then on the driver; None without rows."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = partial(batches)
        if data is not None:
            yield pa.RecordBatch.from_pydict({"node": [TaskContext.get().partitionId()], "data": [data]}, schema=pa.schema([("node", pa.int64()), ("data", pa.binary())]))

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"node": [int(rows["at"].iloc[0])], "data": [join([*rows.sort_values("node")["data"]])]})

    nodes = df.select(columns).mapInArrow(parts, "node long, data binary")
    for level in LEVELS:
        nodes = nodes.withColumn("at", F.col("node") % level).groupBy("at").applyInPandas(group, "node long, data binary")
    found = sorted(((r["node"], bytes(r["data"])) for r in nodes.collect()))
    return join([data for _, data in found]) if found else None


def _moments(fit: DataFrame, dims: int) -> tuple[int, list[int], int]:
    """(rows, sums of each dimension, the largest difference within a dimension), all exact."""

    def join(parts: list[bytes]) -> bytes:
        some = [json.loads(p) for p in parts]
        return json.dumps([sum(s[0] for s in some), [sum(x) for x in zip(*(s[1] for s in some))], [min(x) for x in zip(*(s[2] for s in some))], [max(x) for x in zip(*(s[3] for s in some))]]).encode()

    def partial(batches: Iterator[pa.RecordBatch]) -> bytes | None:
        parts = []
        for batch in batches:
            if batch.num_rows:
                y = _unpacked(batch.column(0).to_pylist(), dims)
                exact = y if np.abs(y).max() < 1 << 40 else y.astype(object)
                parts.append(json.dumps([len(y), [int(v) for v in exact.sum(0)], y.min(0).tolist(), y.max(0).tolist()]).encode())
                parts = [join(parts)]
        return parts[0] if parts else None

    data = _joined(fit, "y", partial, join)
    if data is None:
        return 0, [0] * dims, 0
    n, sums, low, high = json.loads(data)
    return n, sums, max(b - a for a, b in zip(low, high))


class _Centred:
    """n * y - S of rows, exact."""

    def __init__(self, n: int, sums: list[int], spread: int, dims: int) -> None:
        self.n, self.sums, self.dims = n, sums, dims
        self.small = n * max(spread, 1) < 1 << 61 and max(abs(s) for s in sums) + n * spread < 1 << 62
        self.narrow = self.small and dims * (n * spread) ** 2 <= _LONG

    def numerators(self, y: np.ndarray) -> np.ndarray:
        if self.small:
            return y * self.n - np.array(self.sums, dtype=np.int64)
        return y.astype(object) * self.n - np.array(self.sums, dtype=object)

    def rows(self, y: np.ndarray) -> np.ndarray:
        """y - S / n in doubles, from the exact numerator."""
        return self.numerators(y).astype(np.float64) / self.n

    def deviations(self, y: np.ndarray) -> list[int | None]:
        """Exact sums of squares of the numerators; None where no long holds them."""
        top = self.numerators(y)
        if self.narrow:
            return (top * top).sum(1).tolist()
        return [d if d <= _LONG else None for d in ((top.astype(object)) ** 2).sum(1).tolist()]


def _triangle(fit: DataFrame, centred: _Centred, dims: int) -> np.ndarray:
    """The triangle R of a QR factorisation of all centred rows."""

    def reduced(rows: list[np.ndarray]) -> np.ndarray:
        return np.linalg.qr(np.concatenate(rows), mode="r")

    def join(parts: list[bytes]) -> bytes:
        return reduced([np.frombuffer(p).reshape(-1, dims) for p in parts]).tobytes()

    def partial(batches: Iterator[pa.RecordBatch]) -> bytes | None:
        r = np.zeros((0, dims))
        for batch in batches:
            if batch.num_rows:
                r = reduced([r, centred.rows(_unpacked(batch.column(0).to_pylist(), dims))])
        return r.tobytes() if len(r) else None

    r = np.frombuffer(_joined(fit, "y", partial, join)).reshape(-1, dims)
    return np.concatenate([r, np.zeros((dims - len(r), dims))])


def _identity_error(fit: DataFrame, centred: _Centred, dims: int, directions: np.ndarray) -> float:
    """Largest absolute entry of the whitened fit list's covariance, centred by its own mean, minus the identity."""
    width = directions.shape[1]

    def join(parts: list[bytes]) -> bytes:
        n, mean, square = 0.0, np.zeros(width), np.zeros((width, width))
        for part in parts:
            data = np.frombuffer(part)
            m, other, more = data[0], data[1 : 1 + width], data[1 + width :].reshape(width, width)
            gap = other - mean
            square = square + more + np.outer(gap, gap) * (n * m / (n + m))
            mean = mean + gap * (m / (n + m))
            n += m
        return np.concatenate([[n], mean, square.ravel()]).tobytes()

    def partial(batches: Iterator[pa.RecordBatch]) -> bytes | None:
        parts: list[bytes] = []
        for batch in batches:
            if batch.num_rows:
                w = centred.rows(_unpacked(batch.column(0).to_pylist(), dims)) @ directions
                mean = w.mean(0)
                parts.append(np.concatenate([[len(w)], mean, ((w - mean).T @ (w - mean)).ravel()]).tobytes())
                parts = [join(parts)]
        return parts[0] if parts else None

    data = np.frombuffer(_joined(fit, "y", partial, join))
    return float(np.abs(data[1 + width :].reshape(width, width) / data[0] - np.eye(width)).max())


def usual_length(df: DataFrame, vector_col: str) -> int:
    """The most frequent length of the vectors without null and non-finite entries (ties: the longer); 0 without any."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    top = df.where(x.isNotNull() & finite).groupBy(F.size(vector_col).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return top["n"] if top else 0


def whiten(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16, scale: int = 64, dims: int | None = None) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component.

    Entries become floor(scale * c), held within LARGEST; a constant added to all of them changes no column. The fit list is each distinct such vector
    once: n vectors with sums S. Components are numbered from 1 by falling variance, at most ``components``, and only those along which the
    fit list varies: a constant table, one vector or an empty table give no rows. deviation: sum of (n * y - S)^2, exact (null where no long
    holds it). whitened: the centred vector along the component over its deviation; either sign, the same for all rows. explained: share of the
    total variance. identity_error: measured in a pass over the whitened fit list.

    Null vectors and those with null or non-finite entries are left out, and so are vectors of another length than ``dims`` (default: the
    usual one), for which there is no covariance. Rows that repeat an id or a vector, and null ids, each get their rows; other
    columns are ignored whatever their names. Equal variances come in any order.
    """
    spark = df.sparkSession
    ship(spark)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    dims = usual_length(df, vector_col) if dims is None else dims
    nothing = spark.createDataFrame([], schema)
    if not dims:
        return nothing

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = finite_rows(batch.column(0), dims)
            yield pa.RecordBatch.from_arrays([pa.array(_packed(_whole(x, scale)), pa.binary())], ["y"])

    slim = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    fit = stored(slim.select("x").mapInArrow(packed, "y binary").distinct(), "fit")
    n, sums, spread = _moments(fit, dims)
    if not spread:
        return nothing
    centred = _Centred(n, sums, spread, dims)
    values, vectors = qd.right_singular(_triangle(fit, centred, dims))
    # a value below what rounding leaves of the largest one is none
    varies = int((values > values[0] * dims * 8 * np.finfo(float).eps).sum())
    take = min(components, varies)
    directions = vectors[:, :take] * (np.sqrt(n) / values[:take])
    explained = values[:take] ** 2 / (values**2).sum()
    error = _identity_error(fit, centred, dims, directions)
    dropped(fit)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, x = finite_rows(batch.column(1), dims)
            y = _whole(x, scale)
            m = len(y)
            if not m:
                continue
            which = pa.array(np.repeat(np.arange(m), take))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).filter(pa.array(good)).take(which),
                    pa.array(np.tile(np.arange(1, take + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * take, n, dtype=np.int64)),
                    pa.array(centred.deviations(y), pa.int64()).take(which),
                    pa.array((centred.rows(y) @ directions).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * take, error)),
                ],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return slim.mapInArrow(rows, schema)
