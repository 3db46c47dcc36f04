"""Database reads and writes against the embedded database on Spark's class path."""

import uuid

import pytest
from pyspark.sql import functions as F

from sheetforge.sources import tables

DRIVER = "org.apache.derby.jdbc.EmbeddedDriver"
SCHEMA = "drawing_id int, name string, size double"


@pytest.fixture
def url(spark, tmp_path):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    return f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"


def stored_rows(spark, url):
    return sorted(map(tuple, tables.read_table(spark, url, "drawings", "drawing_id", 0, 100, parts=3, driver=DRIVER).collect()))


def test_upserts_replace_and_add(spark, url):
    first = spark.createDataFrame([(i, f"n{i}", float(i)) for i in range(20)], SCHEMA)
    tables.write_table(first, url, "drawings", driver=DRIVER)
    more = spark.createDataFrame([(3, "new", None), (3, "older", 1.0), (50, "added", 5.0), (None, "lost", 1.0)], SCHEMA)
    assert tables.upsert_table(more, url, "drawings", ["drawing_id"], driver=DRIVER) == 2
    want = sorted([*((i, f"n{i}", float(i)) for i in range(20) if i != 3), (3, "older", 1.0), (50, "added", 5.0)])
    assert stored_rows(spark, url) == want
    tables.upsert_table(more, url, "drawings", ["drawing_id"], driver=DRIVER)
    assert stored_rows(spark, url) == want  # saving twice changes nothing
    assert tables.delete_from_table(more.select("drawing_id"), url, "drawings", ["drawing_id"], driver=DRIVER) == 2
    assert stored_rows(spark, url) == [r for r in want if r[0] not in (3, 50)]


def test_a_failed_merge_changes_nothing(spark, url):
    tables.write_table(spark.createDataFrame([(1, "a", 1.0)], SCHEMA), url, "drawings", driver=DRIVER)
    with pytest.raises(Exception):
        tables.upsert_table(spark.createDataFrame([(1, "b", 2.0, 9)], SCHEMA + ", more int"), url, "drawings", ["drawing_id"], driver=DRIVER)
    assert stored_rows(spark, url) == [(1, "a", 1.0)]
    left = spark.read.jdbc(url, "sys.systables", properties={"driver": DRIVER}).where(F.lower("tablename").startswith("sheetforge_"))
    assert left.count() == 0


def test_statements_of_other_databases():
    args = ("drawings", "stage", ["id", "name"], ["id"])
    assert tables.merge_statement("jdbc:postgresql://h/d", *args) == 'INSERT INTO drawings ("id", "name") SELECT "id", "name" FROM stage WHERE 1 = 1 ON CONFLICT ("id") DO UPDATE SET "name" = excluded."name"'
    assert tables.merge_statement("jdbc:mysql://h/d", *args) == "INSERT INTO drawings (`id`, `name`) SELECT `id`, `name` FROM stage ON DUPLICATE KEY UPDATE `name` = VALUES(`name`)"
    assert tables.merge_statement("jdbc:postgresql://h/d", "t", "s", ["id"], ["id"]).endswith("DO NOTHING")
