"""Display roll-ups, descriptions and text building for drawings; chat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetforge.operators.encode import surface_grade, three_measures
from sheetforge.operators.extract import GDT_NAMES, gdt_parts

# Names of the tolerance classes in descriptions.
TOLERANCE_NAMES = {"f": "fine", "m": "medium", "c": "coarse", "v": "very coarse"}
GEOMETRY_NAMES = {"h": "tight", "k": "normal", "l": "loose"}
# The sentences before and instead of the results of a search.
RESULTS_HEAD = "Here are the retrieved results from the previous search:"
NO_RESULTS = "No previous search has been performed, so there are no search results yet."
# Labels and sentences of descriptions.
NAME_LABEL = "Name: "
MATERIAL_LABEL = "Material"
TOLERANCE_LABEL = "Toleranzen nach ISO-2768"
SURFACE_LABEL = "Oberflächenrauheit"
GDT_LABEL = "GD&T"
THREAD_LABEL = "Gewinde"
DIMENSIONS_BEFORE, DIMENSIONS_AFTER = "Die Aussendimensionen des Teils sind ", " Millimeter. "
NO_DIMENSIONS = "Keine Aussendimensionen"


# ------------------------------------------------------------------------------ roll-ups


def tightest_surface(surfaces: Column) -> Column:
    """Surface of least grade, the first on ties; null for an empty list."""
    ranked = F.transform(surfaces, lambda s, i: F.struct(surface_grade(s).alias("g"), i.alias("i"), s.alias("s")))
    return F.array_min(ranked)["s"]


def tightest_tolerance(tolerances: Column, case_aside: bool = True) -> Column:
    """struct(dimension_class, geometry_class): best letter of each kind; entries with an unknown letter don't count.

    With ``case_aside`` - is the last class of both kinds, and the result when there is nothing; without, letters must be lower
    case and the result is then empty.
    """
    first, second = ("fmcv-", "hkl-") if case_aside else ("fmcv", "hkl")
    shown = F.transform(tolerances, lambda t: F.lower(t) if case_aside else t)
    good = F.filter(shown, lambda t: (F.length(t) == 2) & (F.instr(F.lit(first), F.substring(t, 1, 1)) > 0) & (F.instr(F.lit(second), F.substring(t, 2, 1)) > 0))

    def best(letters: str, place: int) -> Column:
        at = F.array_min(F.transform(good, lambda t: F.instr(F.lit(letters), F.substring(t, place, 1))))
        return F.coalesce(F.substring(F.lit(letters), at, F.lit(1)), F.lit("-" if case_aside else ""))

    return F.struct(best(first, 1).alias("dimension_class"), best(second, 2).alias("geometry_class"))


def tightest_gdt(gdts: Column) -> Column:
    """``"<symbol> <value>"`` of the least value, the first on ties; null for an empty list."""
    parts = F.transform(gdts, lambda g, i: F.struct(gdt_parts(g)["value"].alias("v"), i.alias("i"), gdt_parts(g)["characteristic"].alias("c")))
    best = F.array_min(F.filter(parts, lambda p: p["v"].isNotNull()))
    return F.concat_ws(" ", best["c"], best["v"].cast("string"))


def display_row(features: DataFrame, key: str = "drawing_id") -> DataFrame:
    """One row to show for each drawing: material, dimensions, tolerances, surface, geometric tolerance."""
    dims = F.transform("outer_dimensions", lambda x: x.cast("string"))
    return features.select(
        key,
        F.try_element_at("material", F.lit(1)).alias("material"),
        F.array_join(dims, "x").alias("dimensions"),
        F.concat(tightest_tolerance(F.col("general_tolerances"))["dimension_class"], tightest_tolerance(F.col("general_tolerances"))["geometry_class"]).alias("general_tolerance"),
        tightest_surface(F.col("surfaces")).alias("surface"),
        tightest_gdt(F.col("gdts")).alias("gdt"),
    )


def drawing_record(response: DataFrame, key: str = "drawing_id") -> DataFrame:
    """(drawing_id, drawing): lists of a preprocessor's answer or a stored document as one struct with three dimensions."""
    empty = F.array().cast("array<string>")
    lists = [F.coalesce(F.col(c), empty).alias(c) for c in ("material", "general_tolerances", "surfaces", "gdts", "threads", "other_isos") if c in response.columns]
    return response.select(key, F.struct(*lists, three_measures(F.coalesce("outer_dimensions", F.array().cast("array<double>"))).alias("outer_dimensions")).alias("drawing"))


def to_dict(df: DataFrame, column: str = "drawing") -> DataFrame:
    """The struct as JSON text."""
    return df.withColumn(column, F.to_json(column, {"ignoreNullFields": "false"}))


def from_dict(df: DataFrame, schema: str, column: str = "drawing") -> DataFrame:
    """JSON text as the struct of ``schema``."""
    return df.withColumn(column, F.from_json(column, schema))


# ------------------------------------------------------------------------------ descriptions


def labelled_line(items: Column, section: str) -> Column:
    """``"<section>: a, b"`` with distinct items in order, ``keine`` for none."""
    distinct = F.array_sort(F.array_distinct(items))
    return F.concat(F.lit(section + ": "), F.when(F.coalesce(F.size(distinct), F.lit(0)) == 0, "keine").otherwise(F.array_join(distinct, ", ")))


def _named(letter: Column, names: dict[str, str]) -> Column:
    out = letter
    for k, v in names.items():
        out = F.when(letter == k, v).otherwise(out)
    return out


def tolerance_words(tolerance: Column) -> Column:
    """Letters of a general tolerance as words joined by ``and``."""
    low = F.lower(tolerance)
    return F.concat_ws(" and ", _named(F.substring(low, 1, 1), TOLERANCE_NAMES), _named(F.substring(low, 2, 1), GEOMETRY_NAMES))


def gdt_words(gdt: Column) -> Column:
    """Symbols of a geometric tolerance replaced by their names, in the order of GDT_NAMES."""
    for symbol, name in GDT_NAMES.items():
        gdt = F.replace(gdt, F.lit(symbol), F.lit(name))
    return gdt


def dimension_line(dims: Column) -> Column:
    joined = F.array_join(F.transform(dims, lambda x: x.cast("string")), "x")
    said = F.concat(F.lit(DIMENSIONS_BEFORE), joined, F.lit(DIMENSIONS_AFTER))
    return F.when(F.coalesce(F.size(dims), F.lit(0)) == 0, NO_DIMENSIONS).otherwise(said)


def describe(features: DataFrame, *, name: str = "name", materials: str = "material_names") -> DataFrame:
    """``features`` plus description: seven lines on name, material, tolerances, surfaces, forms, threads, dimensions.

    ``materials`` holds the list of name lists of the drawing's material classes.
    """
    names = F.transform(materials, lambda m: F.array_join(m, ", "))
    lines = [
        F.concat(F.lit(NAME_LABEL), F.coalesce(F.col(name), F.lit(""))),
        labelled_line(names, MATERIAL_LABEL),
        labelled_line(F.transform("general_tolerances", tolerance_words), TOLERANCE_LABEL),
        labelled_line(F.col("surfaces"), SURFACE_LABEL),
        labelled_line(F.transform("gdts", gdt_words), GDT_LABEL),
        labelled_line(F.col("threads"), THREAD_LABEL),
        dimension_line(F.col("outer_dimensions")),
    ]
    return features.withColumn("description", F.concat_ws("\n", *lines))


# ------------------------------------------------------------------------------ model answers


def last_json_field(answer: Column, field: str = "component_name") -> Column:
    """Field of the last JSON object in an answer; empty when there's none."""
    last = F.try_element_at(F.regexp_extract_all(answer, F.lit(r"(?s)\{.*?\}"), F.lit(0)), F.lit(-1))
    return F.coalesce(F.get_json_object(last, f"$.{field}"), F.lit(""))


def typed_answer(df: DataFrame, schema: str, column: str = "answer", start: str = "OUTPUT START", end: str = "OUTPUT END") -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows by whether the text between the marks is a complete record; good ones have it as ``record``.

    Checked: three measures, a name and a number for each geometric tolerance, tolerance classes of at most one letter.
    """
    between = F.split_part(F.split_part(F.col(column), F.lit(start), F.lit(2)), F.lit(end), F.lit(1))
    parsed = df.withColumn("record", F.from_json(F.trim(F.regexp_replace(between, "```(json)?", "")), schema, {"mode": "PERMISSIVE"}))
    r = F.col("record")
    valid = (
        r.isNotNull()
        & (F.size(r["outer_measures"]) == 3)
        & F.forall(r["gdts"], lambda g: g["name"].isNotNull() & g["runout"].isNotNull())
        & (F.length(r["general_tolerances"]["char1"]) <= 1)
        & (F.length(r["general_tolerances"]["char2"]) <= 1)
    )
    marked = parsed.withColumn("_ok", F.coalesce(valid, F.lit(False)))
    return marked.where("_ok").drop("_ok"), marked.where("not _ok").drop("_ok", "record")


# ------------------------------------------------------------------------------ chats


def chat_messages(turns: DataFrame) -> DataFrame:
    """Messages of users and assistants."""
    return turns.where(F.col("role").isin("user", "assistant"))


def last_messages(turns: DataFrame) -> DataFrame:
    """(conv_id, text): last message of each conversation."""
    return turns.groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


def results_context(queries: DataFrame, hits: DataFrame, texts: DataFrame, key: str = "drawing_id", text: str = "llm_text") -> DataFrame:
    """(query_id, context): a head and ``Teil: <text>`` lines of the non-empty texts of a query's hits in rank order."""
    some = hits.join(texts.where(F.coalesce(F.col(text), F.lit("")) != "").select(key, text), key)
    lines = some.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", key, text))), lambda x: F.concat(F.lit("Teil: "), x[text])), "\n").alias("context"))
    searched = hits.select("query_id", F.lit(True).alias("_any")).distinct()
    said = F.when(F.col("_any"), F.trim(F.concat(F.lit(RESULTS_HEAD + "\n"), F.coalesce("context", F.lit(""))))).otherwise(F.lit(NO_RESULTS))
    return queries.select("query_id").join(lines, "query_id", "left").join(searched, "query_id", "left").select("query_id", F.regexp_replace(said, r"\s+$", "").alias("context"))


# ------------------------------------------------------------------------------ text helpers


def clean_texts(texts: Column) -> Column:
    """Texts without blanks-only ones and single quotes, commas escaped."""
    plain = F.transform(texts, lambda t: F.replace(F.replace(t, F.lit("'"), F.lit("")), F.lit(","), F.lit("\\,")))
    return F.filter(plain, lambda t: F.trim(t) != "")


def parse_list(text: Column) -> Column:
    """``[a,'b']`` to a list of texts without brackets, quotes and empty items; blanks stay. Null gives an empty list."""
    items = F.filter(F.split(F.translate(text, "[]'\"", ""), ","), lambda t: t != "")
    return F.coalesce(items, F.array().cast("array<string>"))


def parse_comma_list(text: Column) -> Column:
    """``[a, b]`` or ``a, b`` to a list of texts without brackets, single quotes and empty items."""
    items = F.filter(F.split(F.replace(F.regexp_replace(F.trim(text), r"^[\[\]]+|[\[\]]+$", ""), F.lit("'"), F.lit("")), ", "), lambda t: t != "")
    return F.coalesce(items, F.array().cast("array<string>"))


def parse_float_list(text: Column) -> Column:
    """As parse_list, with numbers; items that are none are dropped."""
    return F.filter(F.transform(parse_list(text), lambda t: t.try_cast("double")), lambda x: x.isNotNull())


def decimal_comma(text: Column) -> Column:
    """Number of a text with a decimal comma or dot."""
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def transliterate(text: Column) -> Column:
    """Umlauts without dots, sharp s as ss, plus-minus as +-."""
    return F.replace(F.replace(F.translate(text, "äöüÄÖÜ", "aouAOU"), F.lit("ß"), F.lit("ss")), F.lit("±"), F.lit("+-"))


def equal_runs(df: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """(group, value, start, end, length): runs of more than one equal neighbour in the order of ``order``."""
    line = Window.partitionBy(*group).orderBy(order)
    new = F.when(F.lag(value).over(line).eqNullSafe(F.col(value)) & F.lag(order).over(line).isNotNull(), 0).otherwise(1)
    runs = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*group, "_run", value).agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("length")).where("length > 1").drop("_run")


def distinct_non_empty(items: Column) -> Column:
    """Items without repeats and empty ones, in their order."""
    return F.array_distinct(F.filter(items, lambda t: t.isNotNull() & (t != "")))
