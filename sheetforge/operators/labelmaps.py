"""Label images as byte strings and as runs: scores without a row for each pixel.

A label map is a byte string, one byte for each pixel in reading order; a run-length map is a list of (label, n).
Both may come in tiles, several rows of one key. A pair of maps is counted by one code for each pixel pair (bytes) or
each overlap of two runs (lists), so what leaves a row is at most one count for each pair of labels that occurs.
``evaluate.class_counts`` and the scores built on it take these counts in the place of pixels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COUNTS = "array<struct<gt:int,pred:int,n:bigint>>"
_RUNS = "array<struct<label:int,n:bigint>>"


def packed_labels(pixels: DataFrame, by: list[str], pos: str = "pos", labels: tuple[str, ...] = ("gt", "pred")) -> DataFrame:
    """(by, label maps): rows of pixels packed in the order of ``pos``, ties by label; a tile in ``by`` bounds a map.

    Labels are whole numbers from 0 to 255; a pixel with another or a null label raises an error, as a byte can't hold it.
    """
    wrong = None
    for c in labels:
        own = F.col(c).isNull() | ~F.col(c).between(0, 255)
        wrong = own if wrong is None else wrong | own
    checked = pixels.where(F.when(wrong, F.raise_error(F.lit("a label map holds labels from 0 to 255")).cast("boolean")).otherwise(F.lit(True)))
    listed = F.sort_array(F.collect_list(F.struct(pos, *labels)))
    rows = checked.groupBy(*by).agg(listed.alias("_p"))

    def packed(c: str) -> Column:
        return F.unhex(F.array_join(F.transform("_p", lambda x: F.lpad(F.hex(x[c].cast("long")), 2, "0")), ""))

    return rows.select(*by, *[packed(c).alias(c) for c in labels])


def run_lengths(labels: Column) -> Column:
    """Runs (label, n) of a label map; null for null, none for an empty map."""

    @F.arrow_udf(_RUNS)
    def runs(maps: pa.Array) -> pa.Array:
        found, sizes = [], []
        for one in maps:
            x = np.frombuffer(one.as_buffer() if one.is_valid else b"", dtype=np.uint8)
            starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, dtype=np.int64)
            found.append(x[starts])
            sizes.append(np.diff(np.r_[starts, len(x)]))
        values = {"label": pa.array(np.concatenate([np.zeros(0, dtype=np.uint8), *found]).astype(np.int32)), "n": pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *sizes]))}
        return _lists([len(x) for x in found], values, maps.is_null())

    return runs(labels)


def _lists(sizes: list[int], values: dict[str, pa.Array], mask: pa.Array | None = None) -> pa.Array:
    """Lists of structs, by the lists' lengths and the fields of all of them one behind the other: no object for a run."""
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.StructArray.from_arrays(list(values.values()), names=list(values)), mask=mask)


def _summed(pairs: DataFrame, key: str) -> DataFrame:
    return pairs.select(key, F.inline("counts")).groupBy(key, "gt", "pred").agg(F.sum("n").alias("n"))


def map_pairs(maps: DataFrame, key: str = "image_id", gt: str = "gt", pred: str = "pred") -> DataFrame:
    """(key, gt, pred, n): pixels of each pair of labels of two label maps, over all rows of a key.

    Maps of one row must be equally long, else the job fails with their lengths. Rows without one of the maps count
    nothing; a null key is a key like any other. Other columns are ignored, whatever their names.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b in zip(batch[1], batch[2], strict=True):
                x, y = np.frombuffer(a.as_buffer(), dtype=np.uint8), np.frombuffer(b.as_buffer(), dtype=np.uint8)
                if len(x) != len(y):
                    raise ValueError(f"label maps of {len(x)} and {len(y)} pixels can't be compared")
                found = np.bincount(x.astype(np.int64) << 8 | y, minlength=1)
                codes = np.flatnonzero(found)
                out.append([{"gt": int(c) >> 8, "pred": int(c) & 255, "n": int(n)} for c, n in zip(codes, found[codes], strict=True)])
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(out, pa.list_(pa.struct([("gt", pa.int32()), ("pred", pa.int32()), ("n", pa.int64())])))], names=[key, "counts"])

    both = maps.where(F.col(gt).isNotNull() & F.col(pred).isNotNull()).select(key, F.col(gt).alias("a"), F.col(pred).alias("b"))
    return _summed(both.mapInArrow(count, f"`{key}` {both.schema[key].dataType.simpleString()}, counts {_COUNTS}"), key)


def run_pairs(maps: DataFrame, key: str = "image_id", gt: str = "gt", pred: str = "pred") -> DataFrame:
    """As ``map_pairs`` for run-length maps: the ends of both lists cut the image into pieces, each counted once.

    Labels are any whole numbers. Runs of no pixels count nothing; negative or null lengths fail the job.
    """

    def ends(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(labels, ends of the runs) of each list; all lists' runs stay in one array each."""
        runs = lists.flatten()
        label, n = runs.field("label"), runs.field("n")
        if runs.null_count or label.null_count or n.null_count:
            raise ValueError("a run needs a label and a length")
        label, n, upto = label.to_numpy().astype(np.int64), n.to_numpy().astype(np.int64), lists.offsets.to_numpy()
        if (n < 0).any():
            raise ValueError("a run can't have a negative length")
        for low, high in zip(upto - upto[0], upto[1:] - upto[0], strict=False):
            yield label[low:high], np.cumsum(n[low:high])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for (x, upto), (y, until) in zip(ends(batch[1]), ends(batch[2]), strict=True):
                sizes = [int(e[-1]) if len(e) else 0 for e in (upto, until)]
                if sizes[0] != sizes[1]:
                    raise ValueError(f"label maps of {sizes[0]} and {sizes[1]} pixels can't be compared")
                cuts = np.union1d(upto, until)
                cuts = cuts[cuts > 0]
                # a piece ends at its cut, so its run is the first whose end reaches the cut
                pairs = np.stack([x[np.searchsorted(upto, cuts)], y[np.searchsorted(until, cuts)], np.diff(cuts, prepend=0)])
                pairs = pairs[:, np.lexsort(pairs[:2])]
                first = np.flatnonzero((np.diff(pairs[:2], axis=1, prepend=pairs[:2, :1] - 1) != 0).any(axis=0))
                out.append(np.stack([*pairs[:2, first], np.add.reduceat(pairs[2], first) if len(first) else pairs[2]]))
            flat = np.concatenate([np.zeros((3, 0), dtype=np.int64), *out], axis=1)
            counts = {name: pa.array(row).cast(kind) for name, row, kind in zip(("gt", "pred", "n"), flat, (pa.int32(), pa.int32(), pa.int64()), strict=True)}
            yield pa.RecordBatch.from_arrays([batch[0], _lists([o.shape[1] for o in out], counts)], names=[key, "counts"])

    both = maps.where(F.col(gt).isNotNull() & F.col(pred).isNotNull()).select(key, F.col(gt).alias("a"), F.col(pred).alias("b"))
    return _summed(both.mapInArrow(count, f"`{key}` {both.schema[key].dataType.simpleString()}, counts {_COUNTS}"), key)
