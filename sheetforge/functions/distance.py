"""Distances between drawings as column expressions, section by section and composed."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sections of a search vector: name and length.
LAYOUT = {"material": 116, "tolerances": 7, "surfaces": 1, "gdt": 12, "norm": 52, "dim": 3, "shape": 512}
#: Start weights; shape counts six times. They are not normalised.
WEIGHTS = [1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 6.0]
# Means and deviations of the surface grade and of the outer dimensions.
SURFACE_MEAN, SURFACE_STD = 7.047478619876142, 0.92944175211206
DIMENSION_MEANS = [41.90041286, 133.08905338, 0.0]
DIMENSION_STDS = [88.95143844, 232.11359118, 1.0]


def sections(vector: Column, layout: dict[str, int] = LAYOUT) -> dict[str, Column]:
    """The named slices of a search vector."""
    out, start = {}, 1
    for name, length in layout.items():
        out[name] = F.slice(vector, start, length)
        start += length
    return out


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def jaccard_distance(a: Column, b: Column) -> Column:
    """Positions that differ and are non-zero in either, by positions non-zero in either; 0 when there are none."""
    either = F.aggregate(F.zip_with(a, b, lambda x, y: F.when((x != 0) | (y != 0), 1.0).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x != y, 1.0).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    return F.when(either == 0, F.lit(0.0)).otherwise(differ / F.nullif(either, F.lit(0.0)))


def zscore_l2(a: Column, b: Column, means: list[float], stds: list[float]) -> Column:
    """Euclidean distance of standardised vectors by their length. The means cancel."""
    scales = F.array(*[F.lit(float(s)) for s in stds])
    squares = F.zip_with(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), scales, lambda d, s: (d / s) * (d / s))
    return F.sqrt(_sum(squares)) / len(stds)


def surface_distance(a: Column, b: Column) -> Column:
    """Distance of two surface grades given as arrays of one."""
    return F.abs(F.get(a, F.lit(0)).cast("double") - F.get(b, F.lit(0)).cast("double")) / SURFACE_STD


def dimension_distance(a: Column, b: Column) -> Column:
    """Least distance over the orders of ``a``, at most 1."""
    best = []
    for order in permutations(range(3)):
        terms = [((F.get(a, F.lit(p)).cast("double") - F.get(b, F.lit(i)).cast("double")) / DIMENSION_STDS[i]) for i, p in enumerate(order)]
        best.append(F.sqrt(sum((t * t for t in terms[1:]), terms[0] * terms[0])) / 3)
    return F.least(F.lit(1.0), *best)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 when the elements of either sum to 0."""
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    zero = (_sum(F.transform(a, lambda x: x.cast("double"))) == 0) | (_sum(F.transform(b, lambda x: x.cast("double"))) == 0)
    return F.when(zero, F.lit(1.0)).otherwise(1 - dot(a, b) / F.nullif(length, F.lit(0.0)))


METRICS = {"material": jaccard_distance, "tolerances": jaccard_distance, "surfaces": surface_distance, "gdt": cosine_distance, "norm": jaccard_distance, "dim": dimension_distance, "shape": cosine_distance}


def composite_distance(query: Column, other: Column, weights: list[float] | None = None, layout: dict[str, int] = LAYOUT, metrics: dict | None = None) -> Column:
    """Weighted sum of the section distances; ``metrics`` maps a section to a function of two array columns."""
    weights = WEIGHTS if weights is None else weights
    if len(weights) != len(layout):
        raise ValueError("one weight for each section is needed")
    left, right = sections(query, layout), sections(other, layout)
    metrics = METRICS | (metrics or {})
    parts = [metrics[name](left[name], right[name]) * float(w) for name, w in zip(layout, weights, strict=True)]
    return sum(parts[1:], parts[0])


def normalised_weights(weights: list[float], shape_factor: float = 6.0) -> list[float]:
    """User weights: shape counts ``shape_factor`` times, the sum is 1; all 0 when the sum is."""
    raised = [*weights[:-1], weights[-1] * shape_factor]
    total = sum(raised)
    return [w / total if total else 0.0 for w in raised]
