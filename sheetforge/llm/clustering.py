"""Lloyd's clustering over space-filling-curve zone maps, in whole numbers.

Vectors are laid along a Hilbert curve and cut into blocks; a block keeps the box of its least and greatest components. The box bounds
the distance of every vector in it to a centroid from below and above, and the difference of two centroids' distances as well (it is linear, so
a corner has the least). Centroids that another one beats all over the box are no candidates; the others are compared with
the block's vectors exactly, as one matrix product. Blocks are stored once and read by every round. A round sends one sum for each task and
centroid through a shuffle, so a cluster that holds a third of all rows is no heavier than others.

The bounds prune where vectors of a block are near each other against the distance of centroids: copies, clusters, few dimensions. Many independent
dimensions make wide boxes, and then nearly all centroids stay candidates; that costs the bounds, never a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetforge.llm.common import dropped, finite_rows, stored
from sheetforge.shipping import ship

#: Rows of a block at most.
BLOCK_ROWS = 512
#: Rows of the chunks that blocks are made of.
CHUNK = 16
#: Directions that the curve runs through, and bits of each.
CURVE_DIMS, CURVE_BITS = 4, 8
#: Components are held within plus and minus this, so that squared distances of 64 of them fit in a long.
LARGEST = 1 << 27
#: Up to this size of components sums of squares are exact in doubles.
_EXACT = 1 << 21


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of cells in 0 .. 2**bits - 1, as rows of bytes that sort like the places.

    Works on the transposed index: rotations are undone from the top bit down, then the Gray code is taken (J. Skilling, Programming the
    Hilbert curve, 2004); all rows at once.
    """
    x = np.ascontiguousarray(cells.astype(np.uint32).T)
    n = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1)).astype(np.uint32)
            x[0] ^= np.where(high, q - 1, swap).astype(np.uint32)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where(x[n - 1] & q, q - 1, 0).astype(np.uint32)
    x ^= turn
    planes = np.stack([(x >> b & 1).astype(np.uint8) for b in range(bits - 1, -1, -1)])  # top bits of all dimensions first
    return np.packbits(planes.reshape(bits * n, -1).T, axis=1)


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to some point of the box, ties included."""
    below = np.maximum(np.maximum(low - centroids, centroids - high), 0.0)
    above = np.maximum(np.abs(centroids - low), np.abs(high - centroids))
    least, most = (below * below).sum(1), (above * above).sum(1)
    best = int(most.argmin())
    # d(p, b) - d(p, best) = |b|^2 - |best|^2 - 2 p (b - best): the corner that makes it least
    step = centroids - centroids[best]
    corner = np.where(step > 0, high, low)
    margin = ((centroids + centroids[best] - 2 * corner) * step).sum(1)
    size = max(np.abs(low).max(), np.abs(high).max(), np.abs(centroids).max())
    slack = 0.0 if size < _EXACT else 1e-9 * size * size * len(low)
    return np.flatnonzero((least <= most[best] + slack) & (margin <= slack))


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of whole numbers: the nearest row of ``centroids`` (ties: the first) and the exact squared distance."""
    if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) < _EXACT:
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        squared = (p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)
    else:
        squared = np.stack([np.square(points - c).sum(1) for c in centroids], axis=1)
    at = squared.argmin(1)
    return at, squared[np.arange(len(points)), at].astype(np.int64)


def whole_vectors(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 256) -> DataFrame:
    """(id, v) of the vectors with exactly ``dims`` components, none null or non-finite; v: floor(scale * x) as 32-bit numbers in binary.

    Components beyond LARGEST are held there: their squared distances wouldn't fit in a long.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            good, x = finite_rows(part.column(1), dims)
            v = np.clip(np.floor(x * scale), -LARGEST, LARGEST).astype("<i4")
            yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(good)), pa.array([r.tobytes() for r in v], pa.binary())], ["id", "v"])

    slim = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    return slim.mapInArrow(batches, f"id {kind}, v binary")


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i4").reshape(-1, dims).astype(np.int64)


def block_ends(x: np.ndarray, block_rows: int, chunk: int = CHUNK, wider: float = 1.75) -> np.ndarray:
    """Where to cut rows in curve order into blocks: 0, ..., len(x).

    Chunks of a few rows are joined while the joint box is at most ``wider`` times as wide as the narrowest of them, so rows that lie close together keep a
    narrow box and don't share one with others.
    """
    ends, low, high, narrow = [0], None, None, 0.0
    for at in range(0, len(x), chunk):
        piece = x[at : at + chunk]
        a, b = piece.min(0), piece.max(0)
        width = float((b - a).sum())
        if low is not None:
            both = float((np.maximum(high, b) - np.minimum(low, a)).sum())
            if at - ends[-1] < block_rows and both <= wider * max(min(narrow, width), len(a)):
                low, high, narrow = np.minimum(low, a), np.maximum(high, b), min(narrow, width)
                continue
            ends.append(at)
        low, high, narrow = a, b, width
    return np.array([*ends, len(x)] if len(x) else [0])


def curve_blocks(vectors: DataFrame, dims: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of ``vectors`` (id, v) along the curve: ids, v (all vectors one after the other), low and high (the box), as binary.

    The curve runs through the CURVE_DIMS directions of most variance: in all dimensions at once its first bits would part vectors that are near each
    other. Along each, cells are equal parts of the range of two standard deviations about the mean; what is beyond lies in the outer cells. Equal keys are
    dealt by the id as well, so many copies of a vector are many blocks in many tasks.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["id"].dataType.simpleString()
    levels = 1 << CURVE_BITS

    def moments(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two = 0, np.zeros(dims), np.zeros((dims, dims))
        for part in parts:
            x = _rows(part.column(0), dims).astype(np.float64)
            n, one, two = n + len(x), one + x.sum(0), two + x.T @ x
        schema = pa.schema([("dim", pa.int32()), ("n", pa.float64()), ("one", pa.float64()), ("two", pa.list_(pa.float64()))])
        yield pa.RecordBatch.from_pydict({"dim": list(range(dims)), "n": [float(n)] * dims, "one": one, "two": list(two)}, schema=schema)

    parts = vectors.select("v").mapInArrow(moments, "dim int, n double, one double, two array<double>")
    sums = parts.select("dim", "n", "one", F.posexplode("two").alias("other", "two")).groupBy("dim", "other").agg(*[F.sum(c).alias(c) for c in ("n", "one", "two")])
    n, mean, square = 1.0, np.zeros(dims), np.zeros((dims, dims))
    for r in sums.collect():  # one row for each pair of dimensions
        n = max(r["n"], 1.0)
        mean[r["dim"]] = r["one"] / n
        square[r["dim"], r["other"]] = r["two"] / n
    values, directions = np.linalg.eigh(square - np.outer(mean, mean))
    axes = directions[:, ::-1][:, :CURVE_DIMS] / np.sqrt(np.maximum(values[::-1][:CURVE_DIMS], 1e-9))

    def keyed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            cells = np.clip(np.floor(((_rows(part.column(1), dims) - mean) @ axes) * (levels / 4) + levels / 2), 0, levels - 1)
            keys = hilbert_keys(cells, CURVE_BITS)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([k.tobytes() for k in keys], pa.binary())], ["id", "v", "key"])

    def blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = _rows(part.column(1), dims)
            ends = block_ends(x, block_rows)
            spans = list(zip(ends, ends[1:]))
            columns = [
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), part.column(0)),
                pa.array([x[a:b].astype("<i4").tobytes() for a, b in spans], pa.binary()),
                *(pa.array([f(x[a:b], axis=0).astype("<i4").tobytes() for a, b in spans], pa.binary()) for f in (np.min, np.max)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["ids", "v", "low", "high"])

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = vectors.mapInArrow(keyed, f"id {kind}, v binary, key binary").withColumn("salt", F.xxhash64("id", F.monotonically_increasing_id()))
    ordered = ordered.repartitionByRange(parts, "key", "salt").sortWithinPartitions("key", "salt").select("id", "v")
    return ordered.mapInArrow(blocks, f"ids array<{kind}>, v binary, low binary, high binary")


def _assigned(part: pa.RecordBatch, centroids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """For each block of a batch of (v, low, high): its row, vectors, nearest centroids, distances, number of candidates."""
    dims = centroids.shape[1]
    exact = centroids.astype(np.float64)
    for at in range(part.num_rows):
        points, low, high = (np.frombuffer(part.column(c)[at].as_py(), dtype="<i4").astype(np.int64) for c in (0, 1, 2))
        points = points.reshape(-1, dims)
        some = candidates(low.astype(np.float64), high.astype(np.float64), exact)
        near, distance = nearest(points, centroids[some])
        yield at, points, some[near], distance, len(some)


def next_centroids(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid's mean of the vectors nearest to it, rounded down; one without vectors stays."""
    k, dims = centroids.shape

    def sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for part in parts:
            for _, points, near, _, _ in _assigned(part, centroids):
                order = np.argsort(near, kind="stable")
                found, first = np.unique(near[order], return_index=True)
                total[found] += np.add.reduceat(points[order], first, axis=0)
                n += np.bincount(near, minlength=k)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict(
            {"cluster": used.astype(np.int32), "n": n[used], "total": [total[c] for c in used]},
            schema=pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))]),
        )

    parts = blocks.select("v", "low", "high").mapInArrow(sums, "cluster int, n long, total array<long>")
    wide = "decimal(38,0)"
    whole = parts.select("cluster", "n", F.posexplode("total").alias("dim", "part")).groupBy("cluster", "dim").agg(F.sum(F.col("part").cast(wide)).alias("total"), F.sum(F.col("n").cast(wide)).alias("n"))
    out = centroids.copy()
    for r in whole.collect():  # one row for each centroid and dimension
        out[r["cluster"], r["dim"]] = int(r["total"]) // int(r["n"])
    return out


def assign(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of all vectors in blocks; distance: squared, exact."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at, _, near, distance, _ in _assigned(part, centroids):
                yield pa.RecordBatch.from_arrays([part.column(3)[at].values, pa.array(near.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    return blocks.select("v", "low", "high", "ids").mapInArrow(batches, f"id {kind}, cluster int, distance long")


def candidate_counts(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(n, candidates) of each block: its vectors, and the centroids that its box leaves to compare."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = [(len(points), some) for _, points, _, _, some in _assigned(part, centroids)]
            yield pa.RecordBatch.from_pydict({"n": [r[0] for r in rows], "candidates": [r[1] for r in rows]}, schema=pa.schema([("n", pa.int64()), ("candidates", pa.int64())]))

    return blocks.select("v", "low", "high").mapInArrow(batches, "n long, candidates long")


def first_centroids(vectors: DataFrame, k: int, dims: int, prefix: str) -> np.ndarray:
    """The ``k`` vectors of least sha256 of prefix and id (a null id counts as empty), in that order; rows of one id by their components."""
    key = F.sha2(F.concat(F.lit(prefix), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    some = vectors.select(key.alias("key"), F.hex("v").alias("v")).orderBy("key", "v").limit(k).collect()
    return np.array([np.frombuffer(bytes.fromhex(r["v"]), dtype="<i4") for r in some], dtype=np.int64).reshape(-1, dims)


def cluster(
    df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 256, k: int = 40, rounds: int = 5, prefix: str = "2:",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector with ``dims`` finite components.

    Components become floor(scale * x), held within LARGEST. The first centroids are the ``k`` vectors of ``first_centroids`` (all, if there are fewer);
    ``rounds`` times each vector goes to the nearest one (ties: the smaller number) and each centroid becomes the mean of its vectors, rounded down;
    then vectors are assigned once more. All sums are exact; an inertia that no long holds is null. Rows that repeat an id or a vector, and null
    ids, each count and each get a row. Null vectors and those of another length or with a null or non-finite component are left out. An empty
    table gives an empty result; other columns are ignored whatever their names. Vectors and blocks are tables in the shared folder; the driver holds
    k centroids, never vectors.
    """
    spark = df.sparkSession
    ship(spark)
    vectors = stored(whole_vectors(df, id_col=id_col, vector_col=vector_col, dims=dims, scale=scale), "vectors")
    centroids = first_centroids(vectors, k, dims, prefix)
    kind = vectors.schema["id"].dataType.simpleString()
    if not len(centroids):
        return spark.createDataFrame([], f"id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    blocks = stored(curve_blocks(vectors, dims, block_rows), "blocks")
    for _ in range(rounds):
        before, centroids = centroids, next_centroids(blocks, centroids)
        if (before == centroids).all():  # later rounds change nothing
            break
    found = stored(assign(blocks, centroids), "assigned")
    dropped(vectors, blocks)
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}

    def held(x: int) -> int | None:
        return x if x < 1 << 63 else None

    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(c, held(s), held(sum(sums.values())), digests[c]) for c, s in sums.items()]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
