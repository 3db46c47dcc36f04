"""A store of several tables that change together: bucketed files and versioned manifests.

Each table lies in buckets by a hash of one column; children of a drawing are bucketed by the drawing, so a cascade meets the same buckets in all of them. A change
writes new files for the buckets that it meets and leaves the others. A manifest names the folder of each bucket of all tables; writing the next
one switches all tables at once. A job that dies before leaves the old version, and files that nothing names.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetforge.operators import store
from sheetforge.scratch import stored

BUCKET = "bucket_no"
#: Parts of a bucket's rows that tasks write, so that a bucket with a third of all rows isn't one task's.
SPREAD = 8


@dataclass
class Layout:
    """How a table lies: its key, the column that decides the bucket, how many buckets."""

    key: str
    by: str
    buckets: int = 256


#: Layout of the drawing store.
LAYOUTS = {
    "drawings": Layout("drawing_id", "drawing_id"), "runtimes": Layout("runtime_id", "drawing_id"), "searchdata": Layout("searchdata_id", "drawing_id"),
    "feedbacks": Layout("feedback_id", "drawing_id"), "history": Layout("history_id", "history_id"),
}


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, where = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def _read_text(spark: SparkSession, path: str) -> str:
    fs, where = _fs(spark, path)
    data = fs.open(where)
    try:
        return bytes(data.readAllBytes()).decode("utf-8")
    finally:
        data.close()


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of all manifests, rising; also of those that a killed writer left incomplete."""
    return [int(n.removesuffix(".json")) for n in _names(spark, f"{root}/versions") if n.endswith(".json")]


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """The manifest of a version (default: the last complete one)."""
    for n in reversed(versions(spark, root)) if version is None else [version]:
        try:
            found = json.loads(_read_text(spark, f"{root}/versions/{n:012d}.json"))
        except ValueError:  # a writer died while it wrote
            continue
        return found | {"version": n}
    raise FileNotFoundError(f"no complete version in {root}")


def _commit(spark: SparkSession, root: str, tables: dict, after: int) -> int:
    """Writes the manifest behind version ``after``; fails if another change came first, for the file may not exist yet."""
    known = versions(spark, root)
    if any(n > after and _complete(spark, root, n) for n in known):
        raise RuntimeError(f"the store has changed since version {after}; nothing was switched")
    n = max([after, *known]) + 1
    fs, where = _fs(spark, f"{root}/versions/{n:012d}.json")
    out = fs.create(where, False)
    try:
        out.write(bytearray(json.dumps({"tables": tables}).encode("utf-8")))
    finally:
        out.close()
    return n


def _complete(spark: SparkSession, root: str, n: int) -> bool:
    try:
        json.loads(_read_text(spark, f"{root}/versions/{n:012d}.json"))
    except ValueError:
        return False
    return True


def bucket(by: str, buckets: int) -> Column:
    """Bucket of a row; rows with a null there share one."""
    return F.pmod(F.xxhash64(F.col(by).cast("string")), F.lit(buckets)).cast("int")


def _write(df: DataFrame, root: str, name: str, layout: Layout) -> dict[str, str]:
    """Writes rows by bucket; bucket -> folder."""
    spark = df.sparkSession
    folder = f"data/{name}/{uuid.uuid4().hex}"
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.withColumn(BUCKET, bucket(layout.by, layout.buckets)).repartition(parts, BUCKET, F.pmod(F.xxhash64(layout.key), F.lit(SPREAD)))
    dealt.write.partitionBy(BUCKET).parquet(f"{root}/{folder}")
    return {n.split("=")[1]: f"{folder}/{n}" for n in _names(spark, f"{root}/{folder}") if n.startswith(f"{BUCKET}=")}


def _open(spark: SparkSession, root: str, table: dict, buckets: list[str] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(table["schema"])
    paths = [f"{root}/{p}" for b, p in sorted(table["folders"].items()) if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def create(spark: SparkSession, root: str, tables: dict[str, DataFrame], layouts: dict[str, Layout] | None = None) -> int:
    """Writes the first version of a store."""
    layouts = LAYOUTS if layouts is None else layouts
    if versions(spark, root):
        raise FileExistsError(root)
    made = {}
    for name, df in tables.items():
        if BUCKET in df.columns:
            raise ValueError(f"{name} has a column {BUCKET}")
        made[name] = {"layout": asdict(layouts[name]), "schema": df.schema.jsonValue(), "folders": _write(df, root, name, layouts[name])}
    return _commit(spark, root, made, 0)


def read(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A table of the store as of a version (default: the last)."""
    return _open(spark, root, manifest(spark, root, version)["tables"][name])


def change(spark: SparkSession, root: str, upserts: dict[str, DataFrame] | None = None, deletes: dict[str, tuple[DataFrame, str]] | None = None) -> int:
    """Deletes, then upserts, in any number of tables, as one new version.

    ``deletes``: table -> (keys, the column that they are of); ``upserts``: table -> rows, of which those of equal key count as in ``store.upsert``.
    Of the buckets that no row of the change belongs to only key columns are read, and those only where the key is not what the table is bucketed by.
    """
    upserts, deletes = upserts or {}, deletes or {}
    state = manifest(spark, root)
    tables = dict(state["tables"])
    for name in sorted({*upserts, *deletes}):
        table, layout = tables[name], Layout(**tables[name]["layout"])
        whole = _open(spark, root, table)
        met = []
        if name in upserts:
            delta = stored(upserts[name].select(*whole.columns), "delta")
            met += [delta, *([whole.join(delta.select(layout.key).distinct(), layout.key, "left_semi")] if layout.key != layout.by else [])]
        if name in deletes:
            keys, column = deletes[name]
            keys = stored(keys.select(column).distinct(), "keys")
            met.append(keys if column == layout.by else whole.join(keys, column, "left_semi"))
        touched = {str(r["b"]) for df in met for r in df.select(bucket(layout.by, layout.buckets).alias("b")).distinct().collect()}  # at most the buckets
        if not touched:
            continue
        rows = _open(spark, root, table, [*touched])
        if name in deletes:
            rows = store.delete(rows, keys, column)
        if name in upserts:
            rows = store.upsert(rows, delta, layout.key)
        fresh = _write(rows, root, name, layout)
        tables[name] = table | {"folders": {b: p for b, p in table["folders"].items() if b not in touched} | fresh}
    return _commit(spark, root, tables, state["version"])


def delete_drawings(spark: SparkSession, root: str, keys: DataFrame, feedback: str = "restrict") -> tuple[int, DataFrame]:
    """``store.delete_drawings`` in the store: all four tables change at once. Returns (version, blocked keys)."""
    keys = stored(keys.select("drawing_id").distinct(), "keys")
    feedbacks = read(spark, root, "feedbacks")
    blocked = stored(store.blocked_keys(feedbacks, keys, "drawing_id") if feedback == "restrict" else keys.limit(0), "blocked")
    gone = stored(keys.join(blocked, "drawing_id", "left_anti"), "gone")
    return change(spark, root, deletes={n: (gone, "drawing_id") for n in ("drawings", "runtimes", "searchdata", "feedbacks")}), blocked


def delete_history(spark: SparkSession, root: str, keys: DataFrame) -> int:
    """History rows with their feedbacks, at once."""
    return change(spark, root, deletes={n: (keys, "history_id") for n in ("history", "feedbacks")})


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Removes manifests but the last ``keep`` complete ones, and files that none of these names; returns the folders removed. Not while a change runs."""
    whole = [n for n in versions(spark, root) if _complete(spark, root, n)]
    kept = whole[-keep:]
    named = {p for n in kept for t in manifest(spark, root, n)["tables"].values() for p in t["folders"].values()}
    removed = 0
    for n in versions(spark, root):
        if n not in kept and n < kept[-1]:
            fs, where = _fs(spark, f"{root}/versions/{n:012d}.json")
            fs.delete(where, False)
    for table in _names(spark, f"{root}/data"):
        for run in _names(spark, f"{root}/data/{table}"):
            for part in _names(spark, f"{root}/data/{table}/{run}"):
                path = f"data/{table}/{run}/{part}"
                if part.startswith(f"{BUCKET}=") and path not in named:
                    fs, where = _fs(spark, f"{root}/{path}")
                    fs.delete(where, True)
                    removed += 1
    return removed
