import duckdb
import pytest

import __spark_entry__ as entry

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
CHECKED = ["w2_search", "f5_composite_distance", "d1_extract_blobs", "d13_outer_measures", "b10_drawing_documents", "c9_nested_rects", "g10_description", "h1_match_exact", "h14_segmentation", "h14_label_maps", "h14_run_lengths"]


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{entry.SMALL}/{t}.parquet'")
    got, want = entry.queries()[name](spark, entry.SMALL).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)

    def number(v):
        # a missing number equals a missing number; frames say NaN, which equals nothing
        return round(float(v), 5) if v == v else float("-inf")

    def plain(frame):
        return sorted(tuple(number(v) if isinstance(v, float) or type(v).__name__.startswith("float") else str(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))

    assert plain(got) == plain(want)
