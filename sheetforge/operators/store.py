"""Store operations as table jobs: lookups, upserts, deletes with cascades, referential checks, nested documents.

Tables are large, deltas and key lists usually small; every operation is one join on the key, whose strategy is left to
Spark. Image bytes are never carried through a join that doesn't need them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetforge.operators.numbering import numbered
from sheetforge.scratch import stored

#: child table -> (foreign key, parent table)
PARENTS = {"runtimes": [("drawing_id", "drawings")], "searchdata": [("drawing_id", "drawings")], "feedbacks": [("history_id", "history"), ("drawing_id", "drawings")]}


def lookup(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is among ``keys`` (a table with that column): by primary or by foreign key."""
    return df.join(keys.select(column).distinct(), column, "left_semi").select(*df.columns)


def not_found(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Keys without any row."""
    return keys.select(column).distinct().join(df.select(column), column, "left_anti")


def upsert(base: DataFrame, delta: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """``base`` with rows of ``delta`` replacing those of equal key; of several for one key the last by ``order`` counts, one by a hash without it."""
    others = [c for c in delta.columns if c != key]
    latest = Window.partitionBy(key).orderBy(F.desc(order) if order is not None else F.xxhash64(*others) if others else F.col(key))
    delta = delta.withColumn("_r", F.row_number().over(latest)).where("_r = 1").drop("_r")
    if order is not None and order not in base.columns:
        delta = delta.drop(order)
    delta = stored(delta, "delta")  # read twice, and the same row must win both times
    return base.join(delta.select(key), key, "left_anti").unionByName(delta)


def delete(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is not among ``keys``; rows with a null there stay."""
    return df.join(keys.select(column).distinct(), column, "left_anti").select(*df.columns)


def blocked_keys(children: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Keys that children still point to."""
    return keys.select(column).distinct().join(children.select(column), column, "left_semi")


def delete_drawings(tables: dict[str, DataFrame], keys: DataFrame, feedback: str = "restrict") -> dict[str, DataFrame]:
    """Deletes drawings with their runtimes and search data.

    ``feedback``: "restrict" keeps drawings that have feedbacks (listed as "blocked"), "cascade" deletes those too.
    """
    keys = keys.select("drawing_id").distinct()
    blocked = blocked_keys(tables["feedbacks"], keys, "drawing_id") if feedback == "restrict" else keys.limit(0)
    gone = keys.join(blocked, "drawing_id", "left_anti")
    out = {name: delete(tables[name], gone, "drawing_id") for name in ("drawings", "runtimes", "searchdata", "feedbacks")}
    return out | {"blocked": blocked}


def delete_history(history: DataFrame, feedbacks: DataFrame, keys: DataFrame, feedback: str = "cascade") -> dict[str, DataFrame]:
    """Deletes history rows, with their feedbacks or only those without."""
    keys = keys.select("history_id").distinct()
    blocked = blocked_keys(feedbacks, keys, "history_id") if feedback == "restrict" else keys.limit(0)
    gone = keys.join(blocked, "history_id", "left_anti")
    return {"history": delete(history, gone, "history_id"), "feedbacks": delete(feedbacks, gone, "history_id"), "blocked": blocked}


def check_parents(child: DataFrame, parents: list[tuple[DataFrame, str]]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows of ``child`` by whether each parent key exists; a null key is unknown."""
    marked = child
    for i, (parent, column) in enumerate(parents):
        known = parent.select(F.col(column), F.lit(True).alias(f"_known{i}")).distinct()
        marked = marked.join(known, column, "left")
    good = F.lit(True)
    for i in range(len(parents)):
        good = good & F.coalesce(F.col(f"_known{i}"), F.lit(False))
    return marked.where(good).select(*child.columns), marked.where(~good).select(*child.columns)


def drawing_documents(drawings: DataFrame, runtimes: DataFrame, searchdata: DataFrame, feedbacks: DataFrame) -> DataFrame:
    """(drawing_id, original_drawing, runtimes, searchdata, feedbacks): children are gathered before they are joined."""

    def gathered(df: DataFrame, first: str, name: str) -> DataFrame:
        fields = [first, *[c for c in df.columns if c not in (first, "drawing_id")]]
        return df.groupBy("drawing_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))

    found = searchdata.select("drawing_id", F.struct(*[c for c in searchdata.columns if c != "drawing_id"]).alias("searchdata"))
    nested = (
        drawings.select("drawing_id")
        .join(gathered(runtimes, "runtime_id", "runtimes"), "drawing_id", "left")
        .join(found, "drawing_id", "left")
        .join(gathered(feedbacks, "feedback_id", "feedbacks"), "drawing_id", "left")
    )
    image = F.base64("original_drawing").alias("original_drawing")
    # images come last, by one more join on the key
    return nested.join(drawings.select("drawing_id", image), "drawing_id").select(
        "drawing_id", "original_drawing", F.coalesce("runtimes", F.array()).alias("runtimes"), "searchdata", F.coalesce("feedbacks", F.array()).alias("feedbacks")
    )


def history_documents(history: DataFrame, feedbacks: DataFrame) -> DataFrame:
    """History rows with their feedbacks as a list, sorted by id."""
    fields = ["feedback_id", *[c for c in feedbacks.columns if c not in ("feedback_id", "history_id")]]
    lists = feedbacks.groupBy("history_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("feedbacks"))
    joined = history.join(lists, "history_id", "left").withColumn("feedbacks", F.coalesce("feedbacks", F.array()))
    return joined.withColumn("query_drawing", F.base64("query_drawing")) if "query_drawing" in history.columns else joined


def flatten_documents(documents: DataFrame) -> dict[str, DataFrame]:
    """Tables of nested drawing documents; the drawing's key is pushed into its children."""
    return {
        "drawings": documents.select("drawing_id", F.unbase64("original_drawing").alias("original_drawing")),
        "runtimes": documents.select("drawing_id", F.explode("runtimes").alias("r")).select("drawing_id", "r.*"),
        "searchdata": documents.where("searchdata is not null").select("drawing_id", "searchdata.*"),
        "feedbacks": documents.select("drawing_id", F.explode("feedbacks").alias("f")).select("drawing_id", "f.*"),
    }


def flatten_history(documents: DataFrame) -> dict[str, DataFrame]:
    """History and feedback tables of nested history documents."""
    return {
        "history": documents.drop("feedbacks"),
        "feedbacks": documents.select("history_id", F.explode("feedbacks").alias("f")).select("history_id", "f.*"),
    }


def with_serial_ids(new_rows: DataFrame, base: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``new_rows`` with ids that follow the greatest of ``base``, in the order of ``order``; dealt in two steps, so no task orders all rows."""
    top = base.agg(F.coalesce(F.max(key), F.lit(0)).cast("long").alias("_top"))  # one row
    others = [c for c in new_rows.columns if c != key]
    ranked = numbered(new_rows.select(*others), order, "_id")
    return ranked.crossJoin(F.broadcast(top)).select((F.col("_top") + F.col("_id")).alias(key), *others)


def with_default_timestamp(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """Missing times become the current one."""
    return df.withColumn(column, F.coalesce(F.col(column), F.localtimestamp()))


def ranked_documents(hits: DataFrame, documents: DataFrame, key: str = "drawing_id") -> DataFrame:
    """Documents of ranked hits (query_id, rank, key, ...), with the rank kept."""
    return hits.join(documents, key).select(*hits.columns, *[c for c in documents.columns if c != key])
