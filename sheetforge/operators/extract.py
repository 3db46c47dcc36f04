"""Attributes of technical drawings in text blobs: surfaces, tolerances of form, threads, norms, measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Symbols of geometric tolerances in the order of the search vector.
GDT_SYMBOLS = ["⌾", "◯", "◠", "⌓", "ￌ", "↗", "⌰", "=", "//", "▱", "∠", "⌖"]
# Symbol names in the order in which they are looked for.
GDT_NAMES = {"-": "Straightness", "▱": "Flatness", "◯": "Circularity", "⌓": "Profile of a Surface", "◠": "Profile of a Line", "ￌ": "Perpendicularity", "∠": "Angularity", "//": "Parallelism", "⌖": "Position", "⌾": "Concentricity", "=": "Symmetry", "↗": "Circular Runout", "⌰": "Total Runout"}
# Patterns of the attributes.
SURFACE = r"(Ra|Rz|Rt)\s*\d+\.*\d*"
GDT = r"(⌾|◯|◠|⌓|ￌ|↗|⌰|=|//|▱|∠|⌖)\s*\d+\.*\d*\s*[A-Z]*"
THREADS = [r"(M)\d+\.*\d*(x)*\d*\.*\d*", r'(G)\d+/*\d*(")', r'\d*/*\d*"*[0-9\-x"]*\s*(NPT)\d*/*\d*"*[0-9\-x"]*', r'\d*/*\d*"*[0-9\-x"]*\s*(UNF)\d*/*\d*"*[0-9\-x"]*']
NORM = r"(din |iso )+\d+"
TOLERANCE_NORMS = ["2768", "7168"]

LISTS = ["material", "material_class", "general_tolerances", "surfaces", "gdts", "threads", "other_isos"]


def find_all(text: Column, pattern: str) -> Column:
    """All matches from left to right; none for an empty pattern or a null text."""
    if not pattern:
        return F.array().cast("array<string>")
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def numbers_only(text: Column) -> Column:
    """Digits and dots of a text."""
    return F.regexp_replace(text, "[^0-9.]", "")


def surfaces(text: Column) -> Column:
    return find_all(text, SURFACE)


def gdts(text: Column) -> Column:
    return find_all(text, GDT)


def threads(text: Column) -> Column:
    return F.concat(*[find_all(text, p) for p in THREADS])


def norms(text: Column) -> Column:
    """Numbers of norms but those of general tolerances."""
    found = F.transform(find_all(F.lower(text), NORM), numbers_only)
    return F.filter(found, lambda n: ~n.isin(*TOLERANCE_NORMS) & (n != ""))


def measure(text: Column) -> Column:
    """struct(value, is_diameter) of a measure text; value is null when it's none.

    None: angles, texts without number, radii, numbers with a part of more than three digits, norms; scales too,
    but a diameter sign comes before them.
    """
    number = F.regexp_extract(text, r"\d+\.?\d*", 0)
    parts_fit = ~F.exists(F.split(number, r"\."), lambda p: F.length(p) > 3)
    low = F.lower(text)
    usable = ~text.contains("°") & (number != "") & ~text.rlike(r"R.?\d+\.?\d*") & parts_fit & ~low.contains("din") & ~low.contains("iso")
    diameter = text.contains("SW") | text.contains("⌀")
    value = F.when(usable & (diameter | ~text.contains(":")), number.try_cast("double"))
    return F.struct(value.alias("value"), F.coalesce(usable & diameter, F.lit(False)).alias("is_diameter"))


def classify(row: dict[str, Column]) -> Column:
    """Class of a blob: that of its first non-empty list, else null."""
    order = [("material", "material"), ("general_tolerances", "general_tolerance"), ("surfaces", "surface"), ("gdts", "gdt"), ("threads", "thread"), ("other_isos", "iso")]
    out = F.lit(None).cast("string")
    for name, label in reversed(order):
        out = F.when(F.size(row[name]) > 0, label).otherwise(out)
    return out


def extract_blobs(blobs: DataFrame, text_col: str = "text") -> DataFrame:
    """``blobs`` plus the lists that patterns find and the blob's class.

    Columns material, material_class and general_tolerances are taken from ``blobs`` where the fuzzy step has
    added them, else they are empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    empty = {"material": "array<string>", "material_class": "array<array<string>>", "general_tolerances": "array<string>"}
    out = blobs.withColumns({k: F.array().cast(t) for k, t in empty.items() if k not in blobs.columns})
    out = out.withColumns({"surfaces": surfaces(text), "gdts": gdts(text), "threads": threads(text), "other_isos": norms(text)})
    return out.withColumn("class", classify({c: F.col(c) for c in LISTS}))


def gather(blobs: DataFrame, key: str = "drawing_id", pos: str = "pos", lists: list[str] | None = None) -> DataFrame:
    """Lists of each drawing's blobs, joined in blob order, in one pass. Blobs without any finding don't travel.

    ``lists``: those to gather (default: all); patterns of the others aren't looked for.
    """
    lists = LISTS if lists is None else lists
    # what comes out of explode is computed once, whatever reads it
    rows = blobs.select(key, F.explode(F.array(F.struct(pos, *lists))).alias("_b"))
    some = F.expr(" or ".join(f"size(_b.{c}) > 0" for c in lists))
    gathered = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.when(some, F.col("_b")))).alias("_l"))
    empty = {c: "array<array<string>>" if c == "material_class" else "array<string>" for c in lists}

    def joined_up(name: str) -> Column:
        return F.coalesce(F.flatten(F.transform("_l", lambda x: x[name])), F.array().cast(empty[name])).alias(name)

    return gathered.select(key, *[joined_up(c) for c in lists])


def outer_measures(blobs: DataFrame, key: str = "drawing_id", pos: str = "pos") -> DataFrame:
    """(drawing_id, outer_dimensions): two largest measures of each drawing with their boxes.

    Of unclassified blobs that aren't plain text: the largest diameter and the larger of the others, or
    the largest horizontal and vertical one. A missing one is 0 without box; the first blob wins ties.
    """
    m = measure(F.coalesce(F.col("text"), F.lit("")))
    usable = F.col("class").isNull() & ~F.col("is_text")
    # a list of at most one measure for each blob: what comes out of explode is computed once, whatever reads it; keys without one stay
    rows = blobs.select(key, pos, *"xywh", F.explode_outer(F.when(usable, F.array(m))).alias("_m"))
    value, diameter = F.col("_m.value"), F.col("_m.is_diameter")
    box = F.struct(value.alias("value"), "x", "y", "w", "h")
    order = F.struct(value, -F.col(pos))

    def largest(which: Column) -> Column:
        chosen = which & (value > 0)
        return F.max_by(F.when(chosen, box), F.when(chosen, order))

    best = rows.groupBy(key).agg(
        largest(~diameter & (F.col("w") >= F.col("h"))).alias("horizontal"), largest(~diameter & (F.col("w") < F.col("h"))).alias("vertical"), largest(diameter).alias("diameter")
    )
    none = F.struct(F.lit(0.0).alias("value"), *[F.lit(None).cast("int").alias(c) for c in ("x", "y", "w", "h")])
    h, v = F.coalesce("horizontal", none), F.coalesce("vertical", none)
    other = F.when(h["value"] > v["value"], h).otherwise(v)
    pair = F.when(F.col("diameter").isNotNull(), F.array("diameter", other)).otherwise(F.array(h, v))
    return best.select(key, pair.alias("outer_dimensions"))


def gdt_parts(text: Column) -> Column:
    """struct(characteristic, value, reference): last symbol found of the list, first number, the rest.

    The rest keeps the symbol, as it does for callers that read it.
    """
    present = F.filter(F.array(*[F.lit(s) for s in GDT_SYMBOLS]), lambda s: F.contains(text, s))
    number = F.regexp_extract(text, r"\d+\.*\d*", 0)
    rest = F.trim(F.when(number == "", text).otherwise(F.replace(text, number, F.lit(""))))
    return F.struct(F.try_element_at(present, F.lit(-1)).alias("characteristic"), number.try_cast("double").alias("value"), rest.alias("reference"))


def gdt_name(text: Column) -> Column:
    """struct(name, runout): name of the first symbol of GDT_NAMES in the text, and its first number."""
    names = F.filter(F.array(*[F.struct(F.lit(k).alias("s"), F.lit(v).alias("n")) for k, v in GDT_NAMES.items()]), lambda s: F.contains(text, s["s"]))
    return F.struct(F.get(names, F.lit(0))["n"].alias("name"), F.regexp_extract(text, r"\d+\.*\d*", 0).try_cast("double").alias("runout"))
