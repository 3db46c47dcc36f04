"""Document fingerprints by winnowing, with DataFrame functions only.

Each run of CHARS code points has a Karp-Rabin hash; of every SPAN neighbouring hashes the least is selected, the rightmost on
ties, with its position. Two texts that share CHARS + SPAN - 1 code points in a row share a selected hash, whatever their
script and with or without white space. A text with fewer than SPAN hashes keeps them all.

The rolling hash of a run is the polynomial of its code points, sum of (code + 1) * BASE^i modulo MODULUS. All runs are hashed at once by doubling: the
polynomial of 2m code points is that of the first m plus BASE^m times that of the next m, so a run of k code points
costs log2(k) array passes instead of one row-wise scan, which SQL functions lack. Hash and position are packed into one long: 31 bits of hash
above 27 bits of reversed position, so that a plain minimum prefers the smaller hash and then the later position. The
minimum over a window is built by doubling too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetforge.llm.common import unused

CHARS, SPAN = 10, 16  # of code points
BASE, MODULUS = 1_664_525_021, (1 << 31) - 1  # products of two residues fit a long
_POSITIONS = 1 << 27


def rolling_hashes(df: DataFrame, text: Column, out: str, k: int = CHARS) -> DataFrame:
    """``df`` with ``out``: the hashes of all runs of k code points of a text, in order, as array of long.

    A text of fewer than k code points has one, of all of them; the empty one too.
    """
    codes, size = unused(df, "codes"), unused(df, "size")
    df = df.withColumn(codes, F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long") + 1)).withColumn(size, F.size(codes))

    def joined(first: str, m: int, second: str) -> Column:
        """Polynomials of the runs that begin with those of ``first``, of m code points, and go on with those of ``second``."""
        later = F.slice(second, F.lit(m + 1), F.col(size))
        return F.zip_with(F.col(first), later, lambda x, y: (x + F.coalesce(y, F.lit(0)) * F.lit(pow(BASE, m, MODULUS))) % F.lit(MODULUS))

    runs, steps = {1: codes}, []
    while 2 * max(runs) <= k:
        m = max(runs)
        steps.append(unused(df, f"run{2 * m}"))
        df = df.withColumn(steps[-1], joined(runs[m], m, runs[m]))
        runs[2 * m] = steps[-1]
    have, whole = max(runs), runs[max(runs)]
    while have < k:
        more = max(m for m in runs if m <= k - have)
        steps.append(unused(df, f"run{have + more}"))
        df = df.withColumn(steps[-1], joined(whole, have, runs[more]))
        have, whole = have + more, steps[-1]
    return df.withColumn(out, F.slice(whole, F.lit(1), F.greatest(F.col(size) - (k - 1), F.lit(1)))).drop(codes, size, *steps)


def winnowed(df: DataFrame, text_col: str, out: str, k: int = CHARS, window: int = SPAN) -> DataFrame:
    """``df`` with ``out``: packed selected hashes of the runs of k code points of a text, in text order.

    Every text has at least one, the empty one too; null counts as empty. A text of fewer than k code points has one gram,
    itself; one of fewer than ``window`` grams keeps them all. Very long texts are read in whole; one beyond 2^27 code points raises an error.
    """
    grams, n, few = unused(df, "grams"), unused(df, "n_grams"), unused(df, "few")
    df = rolling_hashes(df, F.coalesce(F.col(text_col), F.lit("")), grams, k)
    df = df.withColumn(grams, F.transform(grams, _packed)).withColumn(n, F.size(grams))
    df = df.withColumn(n, F.when(F.col(n) <= _POSITIONS, F.col(n)).otherwise(F.raise_error(F.lit("a text has more than 2^27 code points")).cast("int")))
    df = df.withColumn(few, F.when(F.col(n) < window, F.col(grams)))
    least = F.array_distinct(F.slice(grams, F.lit(1), F.greatest(F.col(n) - (window - 1), F.lit(1))))
    return _window_minima(df, grams, n, window).withColumn(out, F.coalesce(few, least)).drop(grams, n, few)


def _packed(value: Column, position: Column) -> Column:
    return F.shiftleft(value, 27) + (F.lit(_POSITIONS - 1) - position)


def _window_minima(df: DataFrame, column: str, n: str, window: int) -> DataFrame:
    """``df`` whose ``column``, an array of ``n`` values, has at each place the least of the ``window`` values from there on."""
    span = 1
    while span < window:
        step = min(span, window - span)
        # least() skips the nulls past the end, where windows are cut off and dropped by the caller
        df = df.withColumn(column, F.zip_with(F.col(column), F.slice(column, F.lit(step + 1), F.col(n)), lambda x, y: F.least(x, y)))
        span += step
    return df


def hashes(selected: Column) -> Column:
    """The hashes of packed selections, each once."""
    return F.array_distinct(F.transform(selected, lambda x: F.shiftright(x, 27)))


def as_text(selected: Column) -> Column:
    """Selections as text: hash@position, in text order."""
    return F.array_join(F.transform(selected, lambda x: F.concat(F.hex(F.shiftright(x, 27)), F.lit("@"), (F.lit(_POSITIONS - 1) - x.bitwiseAND(F.lit(_POSITIONS - 1))).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Share of the hashes of two sets that both have, as twice the common ones by all; 0 to 1."""
    return 2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)).cast("double")


def with_next(docs: DataFrame, id_col: str, columns: list[str], order: list[str], derive: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``derive(docs)`` with next_<column>: the values of the next row by ``id_col``, then ``order``; the first row follows the last.

    ``derive`` adds columns row by row; it runs where rows have been dealt, so what it adds isn't shuffled.

    Rows are dealt to buckets between quantiles of the id, so that no task sorts the table. The last row of a
    bucket takes the first of the next bucket from a table of one row for each bucket. Null ids come first.
    """
    spark = docs.sparkSession
    buckets = 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    bounds = docs.agg(F.percentile_approx(key, [i / buckets for i in range(1, buckets)], 100 * buckets)).first()[0] or []
    # a binary search among the bounds, however many
    splits = [float("-inf"), *sorted({float(b) for b in bounds}), float("inf")]
    dealt = docs.withColumn("_key", key).withColumn("_at", key.cast("double")).withColumn("_bucket", F.lit(0))
    if len(splits) > 2:
        dealt = Bucketizer(splits=splits, inputCol="_at", outputCol="_bucket").transform(dealt.drop("_bucket"))
    dealt = dealt.withColumn("_bucket", F.col("_bucket").cast("int")).drop("_at")
    line = Window.partitionBy("_bucket").orderBy("_key", *order)
    first_key = dealt.groupBy("_bucket").agg(F.min("_key").alias("_key"))
    at_first = dealt.join(F.broadcast(first_key), ["_bucket", "_key"])  # at most `buckets` rows
    firsts = at_first.withColumn("_r", F.row_number().over(line)).where("_r = 1").transform(derive).select("_bucket", *[F.col(c).alias(f"_first_{c}") for c in columns])
    ring = Window.orderBy("_bucket")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follow = firsts.select("_bucket", *[F.coalesce(F.lead(f"_first_{c}").over(ring), F.first(f"_first_{c}").over(whole)).alias(f"_first_{c}") for c in columns])
    led = derive(dealt.repartition("_bucket"))
    kept = [c for c in led.columns if c not in ("_key", "_bucket")]
    led = led.withColumns({f"next_{c}": F.lead(c).over(line) for c in columns} | {"_last": F.lead("_key").over(line).isNull()})
    joined = led.join(follow, "_bucket")
    return joined.select(*kept, *[F.when(F.col("_last"), F.col(f"_first_{c}")).otherwise(F.col(f"next_{c}")).alias(f"next_{c}") for c in columns])


def edited_pairs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = CHARS, window: int = SPAN) -> DataFrame:
    """(doc_id, n_chars, edited, selected, edited_selected, next_selected) of all rows.

    The edited text has its last floor(n_chars / 4) code points replaced by as many first ones of the next
    document (or all of it). Null texts are empty; rows with equal ids follow each other by text; a single row is its own
    next; an empty table gives an empty result. Other columns are dropped, whatever their names.

    What is selected from windows inside the unedited part is the same in both texts, so of an edited text only the windows that
    reach beyond it are winnowed; the result is that of the whole text.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    both = with_next(slim, "doc_id", ["text", "selected"], ["text"], lambda df: winnowed(df, "text", "selected", k, window))
    quarter = "cast(floor(length(text) / 4) as int)"
    edited = F.concat(F.expr(f"left(text, length(text) - {quarter})"), F.expr(f"left(next_text, {quarter})"))
    # a window is k + window - 1 code points; positions up to `same` are selected by windows of the unedited part alone
    kept = F.expr(f"length(text) - {quarter}")
    span = k + window - 1
    enough = kept >= span + window - 1
    same = F.when(enough, kept - span).otherwise(F.lit(-1))
    start = F.when(enough, kept - (span + window - 1)).otherwise(F.lit(0))
    rows = both.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "selected", "next_selected", same.alias("same"), start.alias("start"))
    tail = winnowed(rows.withColumn("tail", F.expr("substring(edited, start + 1)")), "tail", "tail_selected", k, window)

    def at(x: Column) -> Column:
        return F.lit(_POSITIONS - 1) - x.bitwiseAND(F.lit(_POSITIONS - 1))

    first = F.filter("selected", lambda x: at(x) <= F.col("same"))
    rest = F.filter(F.transform("tail_selected", lambda x: x - F.col("start")), lambda x: at(x) > F.col("same"))
    out = tail.select("doc_id", "n_chars", "edited", "selected", F.concat(first, rest).alias("edited_selected"), "next_selected")
    # filters on the result don't go below a generator; pushed further they would repeat each doubling twice
    return out.select(F.inline(F.array(F.struct(*out.columns))))
