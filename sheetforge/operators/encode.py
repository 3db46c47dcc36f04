"""Encoding of extracted attributes as a sectioned search vector."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetforge.functions.distance import LAYOUT, sections
from sheetforge.operators.extract import GDT_SYMBOLS, numbers_only

# Steps of the surface grades N0 to N14 by kind of measurement; None: the grade doesn't exist.
SURFACE_STEPS = {
    "ra": [0.012, 0.025, 0.05, 0.1, 0.2, 0.4, 0.8, 1.6, 3.2, 6.3, 12.5, 25, 50, 100, 200],
    "rt": [None, 0.25, 0.5, 0.8, 1.6, 2.5, 4, 8, 16, 25, 50, 100, None, None, None],
    "rz": [0.05, 0.1, 0.2, 0.4, 0.8, 1.6, 3.2, 6.3, 12.5, 25, 50, 100, 200, 400, None],
    "ry": [0.05, 0.1, 0.2, 0.4, 0.8, 1.6, 3.2, 6.3, 12.5, 25, 50, 100, 200, 400, None],
}
NO_GRADE = 15
TOLERANCE_CLASSES, GEOMETRY_CLASSES = "fmcv", "hkl"


def material_vector(classes: Column, count: int, dictionary: Column) -> Column:
    """Multi-hot of the material classes; ``dictionary`` is the array of all classes' name lists."""
    return F.transform(F.slice(dictionary, 1, count), lambda names: F.when(F.array_contains(classes, names), 1.0).otherwise(0.0))


def tolerance_vector(tolerances: Column) -> Column:
    """Multi-hot of the classes of length and of geometry, case aside."""

    def hot(letter: str, place: int) -> Column:
        return F.when(F.exists(tolerances, lambda t: F.lower(F.substring(t, place, 1)) == letter), 1.0).otherwise(0.0)

    return F.array(*[hot(c, 1) for c in TOLERANCE_CLASSES], *[hot(c, 2) for c in GEOMETRY_CLASSES])


def surface_grade(surface: Column) -> Column:
    """Largest grade whose step the value reaches; NO_GRADE for unknown kinds, bad numbers and values below all steps."""
    kind, value = F.lower(F.substring(surface, 1, 2)), F.trim(F.substring(surface, 3, 1_000)).try_cast("double")
    out = F.lit(None).cast("int")
    for name, steps in SURFACE_STEPS.items():
        reached = [F.when(value >= float(s), F.lit(i)) for i, s in enumerate(steps) if s is not None]
        out = F.when(kind == name, F.greatest(*reached)).otherwise(out)
    return F.coalesce(out, F.lit(NO_GRADE))


def surface_feature(surfaces: Column) -> Column:
    """Least grade of a list of surfaces; NO_GRADE when it's empty."""
    return F.coalesce(F.array_min(F.transform(surfaces, surface_grade)), F.lit(NO_GRADE))


def gdt_vector(gdts: Column) -> Column:
    """Smallest tolerance of each symbol, from 1.0 down; a value of 0 gives way to the next one. Bad numbers don't count."""

    def smallest(symbol: str) -> Column:
        values = F.transform(F.filter(gdts, lambda g: F.contains(g, F.lit(symbol))), lambda g: numbers_only(g).try_cast("double"))
        return F.aggregate(values, F.lit(1.0), lambda a, x: F.when(x.isNotNull() & ((x < a) | (a <= 0)), x).otherwise(a))

    return F.array(*[smallest(s) for s in GDT_SYMBOLS])


def three_measures(values: Column) -> Column:
    """The first three measures, padded with 0."""
    return F.slice(F.concat(values.cast("array<double>"), F.array(*[F.lit(0.0)] * 3)), 1, 3)


def padded_with_largest(values: Column) -> Column:
    """Three measures of a list, padded with its largest."""
    doubles = values.cast("array<double>")
    return F.slice(F.concat(doubles, F.array_repeat(F.coalesce(F.array_max(doubles), F.lit(0.0)), 3)), 1, 3)


def encode(features: DataFrame, materials: DataFrame, *, norm_col: str = "norm_vector", dims_col: str = "outer_dimensions") -> DataFrame:
    """``features`` (lists of a drawing) plus ocr_vector: all sections but the shape.

    ``materials`` is (class_id, pos, name), a small dictionary that is sent along; ``norm_col`` holds the norm section.
    """
    named = materials.groupBy("class_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"))
    listed = named.agg(F.transform(F.sort_array(F.collect_list(F.struct("class_id", "names"))), lambda x: x["names"]).alias("_dictionary"), F.count("*").alias("_classes"))
    joined = features.crossJoin(F.broadcast(listed))  # one row: the dictionary
    hot = F.transform(F.col("_dictionary"), lambda names: F.when(F.array_contains("material_class", names), 1.0).otherwise(0.0))
    dims = F.transform(F.col(dims_col), lambda d: d["value"]) if "struct" in features.schema[dims_col].dataType.simpleString() else F.col(dims_col)
    vector = F.concat(hot, tolerance_vector(F.col("general_tolerances")), F.array(surface_feature(F.col("surfaces")).cast("double")), gdt_vector(F.col("gdts")), F.col(norm_col), three_measures(dims))
    return joined.withColumn("ocr_vector", vector).drop("_dictionary", "_classes")


def search_vectors(encoded: DataFrame, shapes: DataFrame, key: str = "drawing_id", dim: int = LAYOUT["shape"]) -> DataFrame:
    """(drawing_id, search_vector): text sections and shape; zeros for drawings without one."""
    zeros = F.array_repeat(F.lit(0.0), dim)
    return encoded.join(shapes.select(key, "shape"), key, "left").select(key, F.concat("ocr_vector", F.coalesce(F.col("shape").cast("array<double>"), zeros)).alias("search_vector"))


def split_vector(df: DataFrame, vec_col: str = "search_vector", layout: dict[str, int] = LAYOUT) -> DataFrame:
    """``df`` plus one column for each section of its search vector."""
    return df.withColumns(sections(F.col(vec_col), layout))


def representative_embedding(views: DataFrame, key: str = "drawing_id", *, pos: str = "view_pos", vec_col: str = "embedding", drawings: DataFrame | None = None, dim: int = LAYOUT["shape"]) -> DataFrame:
    """(drawing_id, view_pos, shape): of each drawing the view nearest to the mean of its views, the first on ties.

    Means are vectors summed in part before the shuffle, so a drawing of very many views is no load on one task. Drawings of
    ``drawings`` without a view get zeros.
    """
    vectors = views.where(F.col(vec_col).isNotNull()).select(key, array_to_vector(F.col(vec_col).cast("array<double>")).alias("_v"))
    means = vectors.groupBy(key).agg(Summarizer.mean(F.col("_v")).alias("_m")).select(key, vector_to_array("_m").alias("_mean"))
    gap = F.aggregate(F.zip_with(F.col(vec_col), F.col("_mean"), lambda x, m: (x.cast("double") - m) * (x.cast("double") - m)), F.lit(0.0), lambda a, x: a + x)
    measured = views.join(means, key).withColumn("_d", F.round(F.sqrt(gap), 9))
    best = measured.groupBy(key).agg(F.min_by(F.struct(F.col(pos).alias("view_pos"), F.col(vec_col).cast("array<double>").alias("shape")), F.struct("_d", pos)).alias("_b")).select(key, "_b.*")
    if drawings is None:
        return best
    return drawings.select(key).distinct().join(best, key, "left").withColumn("shape", F.coalesce("shape", F.array_repeat(F.lit(0.0), dim)))
