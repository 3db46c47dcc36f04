"""Exact nearest neighbours of many queries: composite distance and cosine similarity.

The queries are a table in the shared folder (one that pyarrow opens, as all executors read it). Each task holds a slice of its corpus rows,
cut into blocks of near rows, and streams over the queries. A block has bounds for each section: the union of its flags with their least and greatest number, boxes of
its numbers, and a cone about its directions. Together they bound the distance of every row of the block from below, and a block whose bound lies
above the k-th distance that a query has so far in this task is skipped. A task sends one list of k rows for each query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyarrow import fs, parquet
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetforge.functions.distance import DIMENSION_STDS, LAYOUT, SURFACE_STD, WEIGHTS
from sheetforge.scratch import stored

#: Queries that a task compares at once, rows of a corpus block, bytes of corpus vectors that a task holds.
BLOCK, ROWS, SLICE_BYTES = 512, 256, 96 << 20
#: Entries of the running lists that a task holds (queries times k); more queries are searched in several passes.
LISTED = 4_000_000

# A section's rows are prepared once (a dict of arrays, one entry a row), its blocks are summed up once (a dict of arrays, one entry a block).
Prepared = dict[str, np.ndarray]


def _zero_sums(x: np.ndarray) -> np.ndarray:
    """Rows whose entries, added from left to right, give 0."""
    return np.cumsum(x, axis=1)[:, -1] == 0 if x.shape[1] else np.ones(len(x), dtype=bool)


class _Flags:
    """Positions that differ, by positions that are set in either; 0 when there are none."""

    def prepare(self, x: np.ndarray) -> Prepared:
        on = (x != 0).astype(np.float64)
        return {"x": x, "on": on, "n": on.sum(1)}

    def distance(self, a: Prepared, b: Prepared) -> np.ndarray:
        both = a["on"] @ b["on"].T
        either = a["n"][:, None] + b["n"][None, :] - both
        values = np.intersect1d(a["x"][a["x"] != 0], b["x"][b["x"] != 0])
        if len(values) == 1 and (a["x"] == a["on"] * values[0]).all() and (b["x"] == b["on"] * values[0]).all():
            same = both
        else:
            same = np.zeros_like(both)
            for value in values:
                same += (a["x"] == value).astype(np.float64) @ (b["x"] == value).astype(np.float64).T
        return np.divide(either - same, either, out=np.zeros_like(either), where=either > 0)

    def block(self, rows: Prepared) -> Prepared:
        return {"any": rows["on"].max(0), "low": rows["n"].min(), "high": rows["n"].max()}

    def bound(self, a: Prepared, blocks: Prepared) -> np.ndarray:
        most = np.minimum(a["on"] @ blocks["any"].T, blocks["high"])
        either = a["n"][:, None] + np.maximum(blocks["low"], most) - most
        return 1 - np.divide(most, either, out=np.where(either > 0, 0.0, 1.0), where=either > 0)

    def spread(self, rows: Prepared) -> np.ndarray:
        return rows["on"]


class _Grade:
    """Difference of single numbers in deviations."""

    def prepare(self, x: np.ndarray) -> Prepared:
        return {"x": x}

    def distance(self, a: Prepared, b: Prepared) -> np.ndarray:
        return np.abs(a["x"] - b["x"].T) / SURFACE_STD

    def block(self, rows: Prepared) -> Prepared:
        return {"low": rows["x"].min(0), "high": rows["x"].max(0)}

    def bound(self, a: Prepared, blocks: Prepared) -> np.ndarray:
        return np.maximum(0, np.maximum(blocks["low"].T - a["x"], a["x"] - blocks["high"].T)) / SURFACE_STD

    def spread(self, rows: Prepared) -> np.ndarray:
        return rows["x"] / SURFACE_STD


class _Sizes:
    """Least distance over the orders of three lengths, at most 1."""

    def prepare(self, x: np.ndarray) -> Prepared:
        return {"x": x}

    def _least(self, a: np.ndarray, gap: Callable[[np.ndarray], np.ndarray], others: int) -> np.ndarray:
        best = np.full((len(a), others), 1.0)
        for order in permutations(range(3)):
            far = gap(a[:, None, list(order)]) / np.array(DIMENSION_STDS)
            best = np.minimum(best, np.sqrt((far * far).sum(2)) / 3)
        return best

    def distance(self, a: Prepared, b: Prepared) -> np.ndarray:
        return self._least(a["x"], lambda x: x - b["x"][None, :, :], len(b["x"]))

    def block(self, rows: Prepared) -> Prepared:
        return {"low": rows["x"].min(0), "high": rows["x"].max(0)}

    def bound(self, a: Prepared, blocks: Prepared) -> np.ndarray:
        return self._least(a["x"], lambda x: np.maximum(0, np.maximum(blocks["low"][None] - x, x - blocks["high"][None])), len(blocks["low"]))

    def spread(self, rows: Prepared) -> np.ndarray:
        return np.clip(rows["x"] / np.array(DIMENSION_STDS), -3, 3)


class _Direction:
    """1 - cosine; 1 where the entries of either sum to 0."""

    base = 1.0

    def _none(self, x: np.ndarray) -> np.ndarray:
        return _zero_sums(x)

    def prepare(self, x: np.ndarray) -> Prepared:
        return {"x": x, "length": np.linalg.norm(x, axis=1), "none": self._none(x)}

    def distance(self, a: Prepared, b: Prepared) -> np.ndarray:
        length = a["length"][:, None] * b["length"][None, :]
        out = self.base - np.divide(a["x"] @ b["x"].T, length, out=np.zeros_like(length), where=length > 0)
        out[a["none"], :] = self.base
        out[:, b["none"]] = self.base
        return out

    def _units(self, rows: Prepared) -> np.ndarray:
        length = np.where(rows["none"] | (rows["length"] == 0), np.inf, rows["length"])
        return rows["x"] / length[:, None]

    def block(self, rows: Prepared) -> Prepared:
        units = self._units(rows)
        some = units[np.abs(units).max(1, initial=0) > 0]
        axis = some.sum(0)
        size = np.linalg.norm(axis)
        axis = axis / size if size > 0 else axis
        angle = np.arccos(np.clip((some @ axis).min(initial=1.0), -1, 1)) if len(some) and size > 0 else np.pi
        return {"axis": axis, "angle": angle if len(some) else 0.0, "none": float(len(some) < len(units)), "some": float(len(some) > 0)}

    def bound(self, a: Prepared, blocks: Prepared) -> np.ndarray:
        away = np.arccos(np.clip(self._units(a) @ blocks["axis"].T, -1, 1))
        cone = self.base - np.cos(np.clip(away - blocks["angle"] - 1e-7, 0, np.pi))
        out = np.where(blocks["some"] > 0, np.where(blocks["none"] > 0, np.minimum(cone, self.base), cone), self.base)
        out[a["none"] | (a["length"] == 0), :] = self.base
        return out

    def spread(self, rows: Prepared) -> np.ndarray:
        return self._units(rows)


class _Similarity(_Direction):
    """Minus the cosine; 0 where either has no length."""

    base = 0.0

    def _none(self, x: np.ndarray) -> np.ndarray:
        return ~x.any(axis=1)


class _Nothing:
    """No section at all: every distance is 0."""

    def prepare(self, x: np.ndarray) -> Prepared:
        return {"x": x}

    def distance(self, a: Prepared, b: Prepared) -> np.ndarray:
        return np.zeros((len(a["x"]), len(b["x"])))

    def block(self, rows: Prepared) -> Prepared:
        return {"n": len(rows["x"])}

    def bound(self, a: Prepared, blocks: Prepared) -> np.ndarray:
        return np.zeros((len(a["x"]), len(blocks["n"])))

    def spread(self, rows: Prepared) -> np.ndarray:
        return np.zeros((len(rows["x"]), 1))


_KINDS = {"material": _Flags(), "tolerances": _Flags(), "surfaces": _Grade(), "gdt": _Direction(), "norm": _Flags(), "dim": _Sizes(), "shape": _Direction()}


class Metric:
    """A weighted sum of section distances, and its bounds for blocks. ``parts``: (kind, first position, length, weight); sections of weight 0 are left out."""

    def __init__(self, parts: list[tuple[object, int, int, float]]) -> None:
        self.parts = [p for p in parts if p[3]] or [(_Nothing(), 0, 0, 1.0)]
        self.bounded = all(p[3] > 0 for p in self.parts)

    def prepare(self, vectors: np.ndarray) -> list[Prepared]:
        return [kind.prepare(np.ascontiguousarray(vectors[:, at : at + n])) for kind, at, n, _ in self.parts]

    def distance(self, a: list[Prepared], b: list[Prepared]) -> np.ndarray:
        found = [weight * kind.distance(x, y) for (kind, _, _, weight), x, y in zip(self.parts, a, b, strict=True)]
        return reduce(np.add, found)

    def blocks(self, rows: list[Prepared], cuts: list[np.ndarray]) -> list[Prepared]:
        out = []
        for (kind, _, _, _), prepared in zip(self.parts, rows, strict=True):
            each = [kind.block(take(prepared, cut)) for cut in cuts]
            out.append({name: np.array([e[name] for e in each]) for name in each[0]})
        return out

    def bound(self, a: list[Prepared], blocks: list[Prepared]) -> np.ndarray:
        """A value that no row of a block is below, with room for rounding."""
        found = [weight * kind.bound(x, y) for (kind, _, _, weight), x, y in zip(self.parts, a, blocks, strict=True)]
        total = reduce(np.add, found)
        return total - 1e-9 * (1 + np.abs(total)) if self.bounded else np.full_like(total, -np.inf)

    def spread(self, rows: list[Prepared]) -> np.ndarray:
        """Coordinates in which near rows are near, for cutting rows into blocks."""
        return np.concatenate([abs(weight) * kind.spread(prepared) for (kind, _, _, weight), prepared in zip(self.parts, rows, strict=True)], axis=1)


def take(prepared: Prepared, rows: np.ndarray) -> Prepared:
    return {name: values[rows] for name, values in prepared.items()}


def composite_metric(weights: list[float], layout: dict[str, int]) -> Metric:
    parts, at = [], 0
    for (name, n), weight in zip(layout.items(), weights, strict=True):
        parts.append((_KINDS[name], at, n, weight))
        at += n
    return Metric(parts)


def cut_into_blocks(points: np.ndarray, most: int = ROWS) -> list[np.ndarray]:
    """Row numbers of blocks of at most ``most`` rows: halves at the median of the widest coordinate, again and again."""
    done, open_ = [], [np.arange(len(points))]
    while open_:
        rows = open_.pop()
        if len(rows) <= most:
            if len(rows):
                done.append(rows)
            continue
        axis = int(points[rows].var(0).argmax())
        order = rows[np.argsort(points[rows, axis], kind="stable")]
        open_ += [order[len(order) // 2 :], order[: len(order) // 2]]
    return done


class RunningLists:
    """The k best rows that each query has so far: least value, then least id."""

    def __init__(self, queries: int, k: int) -> None:
        self.values = np.full((queries, k), np.inf)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)
        self.skipped = self.compared = 0

    def merge(self, rows: np.ndarray, values: np.ndarray, ids: np.ndarray) -> None:
        """Takes values (a row of them for each of ``rows``) of corpus rows ``ids`` in."""
        k = self.values.shape[1]
        # at most the k least of a row and their ties can enter
        limit = np.partition(values, k - 1, axis=1)[:, k - 1] if values.shape[1] > k else np.full(len(rows), np.inf)
        at, column = np.nonzero(values <= np.minimum(limit, self.values[rows, -1])[:, None])
        line = np.concatenate([np.repeat(np.arange(len(rows)), k), at])
        value = np.concatenate([self.values[rows].ravel(), values[at, column]])
        name = np.concatenate([self.ids[rows].ravel(), ids[column]])
        order = np.lexsort((name, value, line))
        counts = np.bincount(line, minlength=len(rows))
        first = np.cumsum(counts) - counts
        chosen = order[first[:, None] + np.arange(k)]
        self.values[rows], self.ids[rows] = value[chosen], name[chosen]

    def add_slice(self, metric: Metric, ids: np.ndarray, vectors: np.ndarray, queries: Iterator[np.ndarray]) -> None:
        """Compares all queries, given block by block in the order of the lists, with a slice of corpus rows."""
        rows = metric.prepare(vectors)
        cuts = cut_into_blocks(metric.spread(rows))
        blocks = metric.blocks(rows, cuts)
        parts = [[take(p, cut) for p in rows] for cut in cuts]
        first = 0
        for wanted in queries:
            prepared = metric.prepare(wanted)
            mine = np.arange(first, first + len(wanted))
            first += len(wanted)
            bound = metric.bound(prepared, blocks)
            for b in np.argsort(bound.min(0), kind="stable"):
                open_ = np.flatnonzero(bound[:, b] <= self.values[mine, -1])
                self.skipped += len(wanted) - len(open_)
                self.compared += len(open_)
                if len(open_):
                    some = prepared if len(open_) == len(wanted) else [take(p, open_) for p in prepared]
                    self.merge(mine[open_], metric.distance(some, parts[b]), ids[cuts[b]])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _nearest(queries: DataFrame, corpus: DataFrame, k: int, width: int, metric: Metric, id_col: str, vec_col: str, query_col: str, score: str, count=None) -> DataFrame:
    """Top k of each query by least distance, ties by id.

    The queries are a stored table. A task holds one slice of corpus rows, one block of queries, and the running lists of all queries; where
    these would be more than LISTED entries, the queries go in several passes. ``count``: an accumulator that takes up how many pairs of a query and
    a block were skipped; one for those compared.
    """
    usable = (F.size("v") == width) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    wanted = queries.select(F.col(query_col).cast("long").alias("q"), F.col(vec_col).cast("array<double>").alias("v")).where(usable)
    listed = stored(wanted, "queries")
    total = listed.count()
    passes = max(1, -(-total * k // LISTED))
    each = [(listed, total)] if passes == 1 else [(part, part.count()) for part in (stored(listed.where(F.pmod(F.xxhash64("q"), F.lit(passes)) == p), "queries") for p in range(passes))]
    rows = corpus.select(F.col(id_col).cast("long"), F.col(vec_col).cast("array<double>").alias("v")).where(usable)
    found = reduce(DataFrame.unionByName, [rows.mapInArrow(_pass(sorted(part.inputFiles()), n, k, width, metric, id_col, score, count), f"query_id long, {id_col} long, {score} double") for part, n in each])
    rank = Window.partitionBy("query_id").orderBy(score, id_col)
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def _pass(files: list[str], total: int, k: int, width: int, metric: Metric, id_col: str, score: str, count) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's search of its corpus rows for the queries in ``files``."""

    def batches_of(column: str) -> Iterator[pa.Array]:
        for file in files:
            store, path = fs.FileSystem.from_uri(file)
            with store.open_input_file(path) as source:
                for batch in parquet.ParquetFile(source).iter_batches(batch_size=BLOCK, columns=[column]):
                    if len(batch):
                        yield batch.column(0)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = RunningLists(total, k)
        ids: list[np.ndarray] = []
        vectors: list[np.ndarray] = []

        def search_slice() -> None:
            best.add_slice(metric, np.concatenate(ids), np.concatenate(vectors), (_matrix(v, width) for v in batches_of("v")))
            ids.clear()
            vectors.clear()

        for batch in batches:
            if len(batch):
                ids.append(batch[0].to_numpy())
                vectors.append(_matrix(batch[1], width))
                if sum(v.nbytes for v in vectors) >= SLICE_BYTES:
                    search_slice()
        if ids:
            search_slice()
        if count is not None:
            count[0].add(best.skipped)
            count[1].add(best.compared)
        first = 0
        for names in batches_of("q"):
            mine = slice(first, first + len(names))
            first += len(names)
            at, place = np.nonzero(np.isfinite(best.values[mine]))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(at)), pa.array(best.ids[mine][at, place]), pa.array(best.values[mine][at, place])], names=["query_id", id_col, score])

    return local


def search(queries: DataFrame, corpus: DataFrame, k: int = 5, weights: list[float] | None = None, layout: dict[str, int] = LAYOUT, *, id_col: str = "drawing_id", vec_col: str = "search_vector", query_col: str = "query_id", count=None) -> DataFrame:
    """(query_id, drawing_id, distance, rank): the k nearest drawings of each query by composite distance.

    Exact; ties go to the smaller id. Vectors of another width than the layout's, or with null or non-finite entries, are passed over. Where all weights are 0 all distances are 0.
    ``count``: two accumulators, for pairs of a query and a block that were skipped, and compared.
    """
    weights = WEIGHTS if weights is None else weights
    return _nearest(queries, corpus, k, sum(layout.values()), composite_metric(weights, layout), id_col, vec_col, query_col, "distance", count)


def text_search(queries: DataFrame, corpus: DataFrame, k: int = 10, *, dim: int, id_col: str = "drawing_id", vec_col: str = "llm_vector", query_col: str = "query_id", count=None) -> DataFrame:
    """(query_id, drawing_id, score, rank): the k rows of greatest cosine similarity."""

    metric = Metric([(_Similarity(), 0, dim, 1.0)])
    found = _nearest(queries, corpus, k, dim, metric, id_col, vec_col, query_col, "score", count)
    return found.withColumn("score", -F.col("score"))


def ranked_ids(hits: DataFrame, id_col: str = "drawing_id") -> DataFrame:
    """(query_id, ids): the ids of each query in rank order."""
    return hits.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", id_col))), lambda x: x[id_col]).alias("ids"))
