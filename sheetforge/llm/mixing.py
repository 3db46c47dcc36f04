"""Mixing sources to target weights by Poisson replication.

Each document is repeated k times, k drawn from a Poisson distribution whose mean is the repetition
rate of its source. The draw inverts the distribution at a uniform number hashed from seed and
document id, so it needs no state: any task, at any time, draws the same count for a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetforge.llm.common import hex_key, stored, unit_hash, unused

#: Share of the mixed corpus by source. Sources that aren't listed share the weight of "*" in proportion
#: to the square root of their size.
DEFAULT_WEIGHTS = {"*": 1.0}


def source_rates(docs: DataFrame, weights: dict[str, float], *, source_col: str, size: Column, total: float | None = None, temper: float = 0.5) -> DataFrame:
    """(_source, _rate): mean number of repetitions that brings each source to its target share.

    rate = share * total / size of the source; ``total`` (default: the size of the corpus) is the size
    of the mixed corpus. One row per source; the sizes are summed over all documents. Weights of listed sources that
    have no document, and of "*" where all sources are listed, go to the others in proportion.
    """
    spark = docs.sparkSession
    sizes = docs.groupBy(F.col(source_col).alias("_source")).agg(F.sum(size).cast("double").alias("_size"))
    listed = {k: v for k, v in weights.items() if k != "*"}
    if listed:
        wanted = spark.createDataFrame([(k, float(v)) for k, v in listed.items()], "_s string, _w double")
        sizes = sizes.join(F.broadcast(wanted), F.col("_source") == F.col("_s"), "left").drop("_s")
    else:
        sizes = sizes.withColumn("_w", F.lit(None).cast("double"))
    has = F.col("_size") > 0
    free = F.when(F.col("_w").isNull() & has, F.pow("_size", F.lit(temper))).otherwise(F.lit(0.0))
    rest = F.lit(float(weights.get("*", 0.0)))
    sums = sizes.agg(F.sum("_size").alias("_all"), F.sum(free).alias("_free"), F.sum(F.when(has, F.coalesce("_w", F.lit(0.0))).otherwise(F.lit(0.0))).alias("_held"))
    scale = F.col("_held") + F.when(F.col("_free") > 0, rest).otherwise(F.lit(0.0))
    share = F.coalesce(F.col("_w"), rest * free / F.nullif(F.col("_free"), F.lit(0.0))) / F.nullif(scale, F.lit(0.0))
    whole = F.col("_all") if total is None else F.lit(float(total))
    return sizes.crossJoin(F.broadcast(sums)).select(  # one row of sums
        "_source", F.when(has, F.coalesce(share, F.lit(0.0)) * whole / F.col("_size")).otherwise(F.lit(0.0)).alias("_rate")
    )


#: Largest mean that one draw inverts: exp(-rate) and the tail stay well inside doubles.
MOST_RATE = 600


def poisson_count(u: Column, rate: Column, most: int | Column) -> Column:
    """Smallest k whose Poisson(rate) distribution function exceeds u, for k up to ``most``.

    A rate of 0 gives 0. ``most`` must lie far in the tail of the largest rate.
    """
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(most) if isinstance(most, int) else most),
        F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.lit(0).alias("k")),
        lambda a, i: F.struct(
            (a["p"] * rate / i).alias("p"),
            (a["c"] + a["p"] * rate / i).alias("c"),
            (a["k"] + F.when(u >= a["c"], 1).otherwise(0)).alias("k"),
        ),
        lambda a: a["k"],
    )
    return step


def repetitions(known: Column, rate: Column, seed: int) -> Column:
    """Poisson count of mean ``rate``, drawn by seed and id.

    A rate above MOST_RATE is the sum of m draws of mean rate / m, each at a uniform of its own; the sum of
    Poisson counts is Poisson with the whole rate.
    """

    def draw(u: Column, mean: Column) -> Column:
        return poisson_count(u, mean, F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int"))

    m = F.ceil(rate / MOST_RATE).cast("int")
    sum_ = F.aggregate(F.sequence(F.lit(1), m), F.lit(0), lambda total, i: total + draw(unit_hash(hex_key(F.lit(seed), known, F.lit("part"), i)), rate / m))
    return F.when(rate > MOST_RATE, sum_).otherwise(draw(unit_hash(hex_key(F.lit(seed), known)), rate))


#: Rate tables of up to so many sources go to every task; larger ones are joined by shuffling.
MOST_SOURCES = 200_000


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    size: Column | None = None,
    seed: int = 17,
    total: float | None = None,
    temper: float = 0.5,
    shuffled: bool = True,
) -> DataFrame:
    """``docs`` with each row repeated by its Poisson count, plus copy (0, 1, ...) and mix_key.

    The size of a row is ``size`` (default 1: shares of documents). mix_key is a 128-bit hash of
    seed, id and copy; partition p has the p-th range of it and is sorted by it, which is the global shuffle. The key is uniform, so
    the ranges follow from its first digits, without sampling.
    Rows with equal ids (repeated rows, null ids) draw the same count; a null source is a source
    of its own; a rate of any size is drawn; an empty table gives an empty result. Columns of ``docs`` called copy or mix_key
    are replaced; any other names may be used. The rates are one row for each source. They are broadcast up to MOST_SOURCES of them, so
    that no source, however hot, is gathered; beyond that they are joined, and Spark splits hot sources.
    """
    spark = docs.sparkSession
    carried = [c for c in docs.columns if c.lower() not in ("copy", "mix_key")]
    weights = weights or DEFAULT_WEIGHTS
    rates = stored(source_rates(docs, weights, source_col=source_col, size=F.lit(1) if size is None else size, total=total, temper=temper), "rates")
    source, rate = unused(docs, "source_of_rate"), unused(docs, "rate")
    rates = rates.toDF(source, rate)
    if rates.count() <= MOST_SOURCES:
        rates = F.broadcast(rates)
    known = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    drawn = (
        docs.select(*carried)
        .join(rates, F.col(source_col).eqNullSafe(F.col(source)), "left")
        # the count stands in one place only, so each row is drawn once
        .select(*carried, F.posexplode(F.array_repeat(F.lit(True), repetitions(known, F.coalesce(F.col(rate), F.lit(0.0)), seed))).alias("copy", "mix_key"))
        .withColumn("mix_key", hex_key(F.lit(seed), known, F.col("copy")))
    )
    if not shuffled:
        return drawn
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    place = F.floor(unit_hash(F.col("mix_key")) * parts).cast("int")
    return drawn.repartitionById(parts, place).sortWithinPartitions("mix_key")
