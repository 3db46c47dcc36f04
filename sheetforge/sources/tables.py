"""Schemas of the store, and readers and writers of its files.

Arrays travel in CSV files as literals in braces: ``{1.0,2.5}``, and lists of texts as ``{"a","b, c"}``.
Missing lists are read as empty lists.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetforge.operators.numbering import numbered
from sheetforge.scratch import stored

DRAWINGS = "drawing_id int, original_drawing binary"
RUNTIMES = "runtime_id int, drawing_id int, machine string, machine_runtime double"
SEARCHDATA = (
    "searchdata_id int, drawing_id int, shape array<float>, material array<string>, general_tolerances array<string>, surfaces array<string>, "
    "gdts array<string>, threads array<string>, outer_dimensions array<float>, search_vector array<float>, part_number string, ocr_text array<string>, "
    "runtime_text string, llm_text string, llm_vector array<float>"
)
HISTORY = "history_id int, query_drawing binary, query_path string, timestamp timestamp_ntz"
FEEDBACKS = "feedback_id int, history_id int, drawing_id int, feedback_desc string, feedback_value int"
ANSWER = "material array<string>, general_tolerances struct<char1:string, char2:string>, name string, surfaces array<string>, gdts array<struct<name:string, runout:double>>, threads array<string>, outer_measures array<double>"

FLOAT_LISTS = ["shape", "outer_dimensions", "search_vector", "llm_vector"]
TEXT_LISTS = ["material", "general_tolerances", "surfaces", "gdts", "threads", "ocr_text"]
ACCEPTED_FILES = ["png", "jpg", "jpeg", "pdf"]


# ------------------------------------------------------------------------------ array literals


def parse_numbers(literal: Column) -> Column:
    """``{1.5,2}`` to array<float>; null, empty or ``{}`` give an empty array."""
    inside = F.trim(F.regexp_replace(literal, r"^\s*\{|\}\s*$", ""))
    parsed = F.transform(F.split(inside, r"\s*,\s*"), lambda x: x.try_cast("float"))
    return F.when(F.coalesce(inside, F.lit("")) == "", F.array().cast("array<float>")).otherwise(parsed)


def parse_texts(literal: Column) -> Column:
    """``{"a","b, c",d}`` to array<string>; quotes protect commas, a backslash the next character."""
    items = F.regexp_extract_all(F.regexp_replace(literal, r"^\s*\{|\}\s*$", ""), F.lit(r'"(?:[^"\\]|\\.)*"|[^,]+'), F.lit(0))
    plain = F.transform(items, lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r'^"|"$', ""), r"\\(.)", "$1"))
    return F.coalesce(plain, F.array().cast("array<string>"))


def numbers_literal(values: Column) -> Column:
    """array of numbers to ``{1.5,2.0}``; null gives ``{}``."""
    return F.concat(F.lit("{"), F.coalesce(F.array_join(values.cast("array<string>"), ","), F.lit("")), F.lit("}"))


def texts_literal(values: Column) -> Column:
    """array of texts to ``{"a","b"}`` with quotes and backslashes escaped."""
    quoted = F.transform(values, lambda x: F.concat(F.lit('"'), F.regexp_replace(x, r'(["\\])', r"\\$1"), F.lit('"')))
    return F.concat(F.lit("{"), F.coalesce(F.array_join(quoted, ","), F.lit("")), F.lit("}"))


# ------------------------------------------------------------------------------ CSV files


def _csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Columns by position, all as text: headers of old files differ from the table's names."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=True, multiLine=True, quote='"', escape='"')


def _names(schema: str) -> list[str]:
    return T._parse_datatype_string(schema).names


def read_drawings_csv(spark: SparkSession, path: str) -> DataFrame:
    """drawing_id, base64 image -> drawings."""
    rows = _csv(spark, path, _names(DRAWINGS))
    return rows.select(F.col("drawing_id").cast("int"), F.unbase64("original_drawing").alias("original_drawing"))


def read_runtimes_csv(spark: SparkSession, path: str) -> DataFrame:
    """runtime_id, drawing_id, machine, run time -> runtimes."""
    rows = _csv(spark, path, _names(RUNTIMES))
    return rows.select(F.col("runtime_id").cast("int"), F.col("drawing_id").cast("int"), "machine", F.col("machine_runtime").cast("double"))


def read_searchdata_csv(spark: SparkSession, path: str) -> DataFrame:
    """Search data with array literals -> searchdata."""
    rows = _csv(spark, path, _names(SEARCHDATA))

    def typed(name: str) -> Column:
        if name in FLOAT_LISTS:
            return parse_numbers(F.col(name)).alias(name)
        if name in TEXT_LISTS:
            return parse_texts(F.col(name)).alias(name)
        return F.col(name).cast("int").alias(name) if name.endswith("_id") else F.col(name)

    return rows.select(*[typed(c) for c in _names(SEARCHDATA)])


def searchdata_rows(wide: DataFrame) -> DataFrame:
    """Second projection of a wide table of drawings (one row for each): searchdata with array literals and ids 0, 1, ... by drawing_id.

    Only keys are numbered; the wide rows are joined with them.
    """
    ids = numbered(wide.select("drawing_id").distinct(), ["drawing_id"], "searchdata_id", first=0)
    joined = wide.drop("searchdata_id").join(ids, "drawing_id")

    def text(name: str) -> Column:
        if name not in joined.columns:
            return F.lit("{}" if name in FLOAT_LISTS + TEXT_LISTS else None).cast("string").alias(name)
        column = F.col(name)
        return (numbers_literal(column) if name in FLOAT_LISTS else texts_literal(column) if name in TEXT_LISTS else column.cast("string")).alias(name)

    return joined.select(*[text(c) for c in _names(SEARCHDATA)])


def write_drawings_and_searchdata(wide: DataFrame, drawings_path: str, searchdata_path: str) -> None:
    """Writes a wide table (drawing_id, original_drawing, search data) as two CSV folders."""
    options = {"header": True, "quote": '"', "escape": '"', "mode": "overwrite", "quoteAll": True}
    wide.select("drawing_id", F.base64("original_drawing").alias("original_drawing")).write.csv(drawings_path, **options)
    searchdata_rows(wide).write.csv(searchdata_path, **options)


# ------------------------------------------------------------------------------ other sources


def read_drawing_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(drawings, rejected): files of a folder with ids by path, and the paths of files of other kinds.

    Ids are dealt on paths only; contents are read again behind them, so no image is shuffled.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    good = F.lower("path").rlike(r"\.(" + "|".join(ACCEPTED_FILES) + ")$")
    ids = numbered(files.where(good).select("path"), ["path"], "drawing_id", first=0)
    # a table of paths, stored, so Spark knows its size and broadcasts it only if it is small
    accepted = files.where(good).join(ids, "path")
    return accepted.select("drawing_id", "path", F.col("content").alias("original_drawing")), files.where(~good).select("path")


def new_files(spark: SparkSession, folder: str, seen: str, pattern: str = "*") -> DataFrame:
    """(path, length, modified, drawing_id) of files of a folder that the manifest ``seen`` doesn't hold as they are now.

    A path that the manifest knows in another length or time has changed and keeps its id; new paths get ids behind the greatest known one, in their order. The table is
    stored, so a file that comes or changes while the load runs waits for the next one. Pass it to ``mark_seen`` when its rows are safe; without that the
    next load finds the same files again.
    """
    files = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter=pattern).load(folder)
    listed = stored(files.select("path", "length", F.col("modificationTime").alias("modified")), "listed")
    known = _seen_files(spark, seen)
    last = known.agg(F.max("drawing_id")).first()[0]
    same = ["path", "length", "modified"]
    fresh = listed.join(known, same, "left_anti").join(known.select("path", "drawing_id"), "path", "left")
    first = numbered(fresh.where("drawing_id is null").select("path"), ["path"], "drawing_id", first=0 if last is None else last + 1)
    return stored(fresh.where("drawing_id is not null").select(*same, "drawing_id").unionByName(fresh.drop("drawing_id").join(first, "path").select(*same, "drawing_id")), "fresh")


def _seen_files(spark: SparkSession, seen: str) -> DataFrame:
    """The last entry of each path of a manifest; empty before the first load."""
    schema = "path string, length long, modified timestamp, drawing_id long, loaded long"
    where = spark._jvm.org.apache.hadoop.fs.Path(seen)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema).drop("loaded")
    rows = spark.read.schema(schema).parquet(seen)
    return rows.groupBy("path").agg(F.max_by(F.struct("length", "modified", "drawing_id"), F.struct("loaded", "modified")).alias("r")).select("path", "r.*")


def mark_seen(fresh: DataFrame, seen: str) -> None:
    """Adds files of ``new_files`` to the manifest."""
    spark = fresh.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(seen)
    loaded = 0
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        loaded = (spark.read.parquet(seen).agg(F.max("loaded")).first()[0] or 0) + 1
    fresh.select("path", "length", "modified", F.col("drawing_id").cast("long").alias("drawing_id"), F.lit(loaded).cast("long").alias("loaded")).write.mode("append").parquet(seen)


def read_new_drawing_files(spark: SparkSession, folder: str, seen: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(drawings, rejected, fresh) of the files that ``seen`` doesn't hold: as ``read_drawing_files``, and the files to pass to ``mark_seen`` afterwards.

    Files of other kinds take ids too, so ids of drawings have gaps.
    """
    good = F.lower("path").rlike(r"\.(" + "|".join(ACCEPTED_FILES) + ")$")
    fresh = new_files(spark, folder, seen)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    drawings = files.select("path", F.col("content").alias("original_drawing")).join(fresh.where(good).select("path", "drawing_id"), "path")
    return drawings.select("drawing_id", "path", "original_drawing"), fresh.where(~good).select("path"), fresh


def read_material_classes(spark: SparkSession, path: str) -> DataFrame:
    """JSON list of synonym lists -> (class_id, pos, name)."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.from_json("value", "array<array<string>>")).alias("class_id", "names")).select("class_id", F.posexplode("names").alias("pos", "name"))


def read_norms(spark: SparkSession, path: str) -> DataFrame:
    """JSON list of norm names -> (norm_id, name)."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.from_json("value", "array<string>")).alias("norm_id", "name"))


def split_prompts(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines ``tag1,tag2:prompt`` -> other columns, tags, prompt; blank lines go."""
    rows = lines.where(F.trim(column) != "")
    return rows.select(
        *[c for c in lines.columns if c != column],
        F.transform(F.split(F.split_part(column, F.lit(":"), F.lit(1)), ","), lambda t: F.trim(t)).alias("tags"),
        F.trim(F.expr(f"substr({column}, instr({column}, ':') + 1)")).alias("prompt"),
    )


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """Prompt file -> (prompt_id, tags, prompt), ids by line."""
    return split_prompts(spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("prompt_id", "value")))


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation run ``{results: [{ground_truth, <answer>}]}`` -> (result_id, ground_truth, prediction).

    The answer is JSON text under vlm_reponse or a struct under preprocessor_reponse (fixed names, spelled so in the files); a result without either has
    a null prediction.
    """
    answer = T._parse_datatype_string(ANSWER)
    result = T.StructType([T.StructField("ground_truth", answer), T.StructField("vlm_reponse", T.StringType()), T.StructField("preprocessor_reponse", answer)])
    runs = spark.read.json(path, schema=T.StructType([T.StructField("results", T.ArrayType(result))]), multiLine=True)
    prediction = F.coalesce(F.from_json("r.vlm_reponse", answer), F.col("r.preprocessor_reponse"))
    return runs.select(F.posexplode("results").alias("result_id", "r")).select("result_id", "r.ground_truth", prediction.alias("prediction"))


def read_table(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int = 16, **options: str) -> DataFrame:
    """Database table read in ``parts`` key ranges."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)


def write_table(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    """Database table written in batches by each partition."""
    df.write.jdbc(url, table, mode=mode, properties={"batchsize": "10000"} | options)


def _quoted(url: str, name: str) -> str:
    return f"`{name}`" if url.startswith("jdbc:mysql") or url.startswith("jdbc:mariadb") else f'"{name}"'


def merge_statement(url: str, table: str, staging: str, columns: list[str], keys: list[str]) -> str:
    """One statement that replaces the rows of ``table`` with a key that ``staging`` has, and adds the others; by the database's own words where it lacks MERGE."""
    q = {c: _quoted(url, c) for c in columns}
    every, others = ", ".join(q[c] for c in columns), [c for c in columns if c not in keys]
    if url.startswith(("jdbc:postgresql", "jdbc:sqlite")):
        sets = ", ".join(f"{q[c]} = excluded.{q[c]}" for c in others)
        return f"INSERT INTO {table} ({every}) SELECT {every} FROM {staging} WHERE 1 = 1 ON CONFLICT ({', '.join(q[c] for c in keys)}) DO " + (f"UPDATE SET {sets}" if others else "NOTHING")
    if url.startswith(("jdbc:mysql", "jdbc:mariadb")):
        sets = ", ".join(f"{q[c]} = VALUES({q[c]})" for c in others or keys)
        return f"INSERT INTO {table} ({every}) SELECT {every} FROM {staging} ON DUPLICATE KEY UPDATE {sets}"
    met = " AND ".join(f"t.{q[c]} = s.{q[c]}" for c in keys)
    update = "WHEN MATCHED THEN UPDATE SET " + ", ".join(f"{q[c]} = s.{q[c]}" for c in others) + " " if others else ""
    return f"MERGE INTO {table} t USING {staging} s ON {met} {update}WHEN NOT MATCHED THEN INSERT ({every}) VALUES ({', '.join('s.' + q[c] for c in columns)})"


def delete_statement(url: str, table: str, staging: str, keys: list[str]) -> str:
    """One statement that removes the rows of ``table`` with a key that ``staging`` has."""
    q = [_quoted(url, c) for c in keys]
    met = " AND ".join(f"s.{c} = {table}.{c}" for c in q)
    return f"DELETE FROM {table} WHERE EXISTS (SELECT 1 FROM {staging} s WHERE {met})"


def _with_staging(df: DataFrame, url: str, statement, options: dict[str, str]) -> int:
    """Writes ``df`` to a table of its own, runs ``statement(its name)`` in one transaction and drops the table; returns the rows changed."""
    spark = df.sparkSession
    staging = f"sheetforge_{uuid.uuid4().hex[:16]}"
    jvm = spark._jvm
    properties = jvm.java.util.Properties()
    for name, value in options.items():
        properties.setProperty(name, str(value))
    if "driver" in options:
        jvm.org.apache.spark.util.Utils.classForName(options["driver"], True, True)
    write_table(df, url, staging, mode="errorifexists", **options)
    connection = jvm.java.sql.DriverManager.getConnection(url, properties)
    try:
        connection.setAutoCommit(False)
        work = connection.createStatement()
        try:
            changed = work.executeUpdate(statement(staging))
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        finally:
            work.executeUpdate(f"DROP TABLE {staging}")
            connection.commit()
            work.close()
    finally:
        connection.close()
    return changed


def upsert_table(df: DataFrame, url: str, table: str, keys: list[str], **options: str) -> int:
    """Puts rows into a database table, replacing those with the same ``keys``; returns the rows changed.

    The partitions write a staging table in batches; one merge statement then changes the table, so a failed job leaves it as it was. The keys need a unique index in the
    databases that merge on conflict. Of rows with the same keys the greatest by the other columns counts; rows with a null key are left out.
    """
    others = [c for c in df.columns if c not in keys]
    known = df.dropna(subset=keys)
    one = known.groupBy(*keys).agg(F.max(F.struct(*others)).alias("_r")).select(*keys, "_r.*").select(*df.columns) if others else known.distinct()
    return _with_staging(one, url, lambda staging: merge_statement(url, table, staging, df.columns, keys), options)


def delete_from_table(found: DataFrame, url: str, table: str, keys: list[str], **options: str) -> int:
    """Removes the rows of a database table whose ``keys`` stand in ``found``, by one statement; returns how many."""
    return _with_staging(found.select(*keys).dropna().distinct(), url, lambda staging: delete_statement(url, table, staging, keys), options)
