"""Medians by counting passes against sorting."""

import random
import statistics

from pyspark.sql import functions as F

from sheetforge.operators import evaluate


def test_medians_by_passes_equal_sorted_ones(spark):
    r = random.Random(6)
    fields = {
        "even": [r.random() for _ in range(500)],
        "odd": [r.gauss(0, 5) for _ in range(501)],
        "same": [2.5] * 300,
        "two": [1.0] * 150 + [4.0] * 150,
        "steps": [float(r.randrange(3)) for _ in range(400)],
        "tails": [r.choice([1e300, -1e300, 1e-300, 1.0, 2.0, 3.0]) * r.random() for _ in range(401)],
        "few": [3.0, 1.0, 2.0],
    }
    rows = [(f, v) for f, values in fields.items() for v in values] + [("even", None), ("odd", float("nan")), ("none", None), (None, 7.0)] + [(None, float(i)) for i in range(200)]
    r.shuffle(rows)
    values = spark.createDataFrame(rows, "field string, value double")
    for gathered in (100, 1_000_000):
        got = {x["field"]: x for x in evaluate.field_summary(values, gathered=gathered).collect()}
        assert set(got) == {*fields, "none", None}
        for f, listed in [*fields.items(), (None, [7.0, *map(float, range(200))])]:
            assert got[f]["median"] == statistics.median(listed) or abs(got[f]["median"] / statistics.median(listed) - 1) < 1e-12, f
            assert got[f]["n"] == len(listed)
        assert got["none"]["median"] is None and got["none"]["n"] == 0


def test_one_field_of_all_rows_is_held_by_no_task(spark):
    values = spark.range(0, 300_000, 1, 8).select(F.lit("all").alias("field"), (F.col("id") * 7919 % 300_000).cast("double").alias("value"))
    row = evaluate.field_summary(values, gathered=10_000).first()
    assert (row["median"], row["n"]) == (149_999.5, 300_000)
