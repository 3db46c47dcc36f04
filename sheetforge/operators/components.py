"""Connected components, and extremes over hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetforge.scratch import dropped, stored


def with_extremes(df: DataFrame, keys: list[str], spread: str, values: dict[str, tuple]) -> DataFrame:
    """``df`` with aggregates (minima or maxima, by name) over ``keys``; rows of one key never gather in one task.

    Rows are dealt by keys and a salt of ``spread``. Aggregates of the salts are merged for each key, go back to the salts that
    the key has, and are joined there.
    """
    tasks = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(tasks)))
    some = dealt.groupBy(*keys, "_salt").agg(*[f(v).alias(k) for k, (f, v) in values.items()])
    whole = some.groupBy(*keys).agg(*[f(k).alias(k) for k, (f, _) in values.items()], F.collect_list("_salt").alias("_salt"))
    back = whole.select(*keys, *values, F.explode("_salt").alias("_salt"))
    return dealt.join(back, [*keys, "_salt"], "left").drop("_salt")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node of an undirected graph.

    ``edges`` has columns a, b (long, non-null). Returns (node, component) for every node that has an edge to
    another one. Alternates large-star and small-star steps until no edge changes; each round
    is a table in the shared folder, so nothing of the graph passes through the driver except two numbers.
    """
    slim = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    current = stored(slim, "edges")
    digest = None
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            with_extremes(both, ["u"], "v", {"m": (F.min, "v")})
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
            .where("u <> v")
            .distinct()
        )
        small = (
            with_extremes(large, ["u"], "v", {"m": (F.min, "v")})
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        before, current = current, stored(small, "edges")
        dropped(before)
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == digest:
            break
        digest = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
