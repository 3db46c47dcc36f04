"""Drawing tables derived from the given star schema, by SQL that means the same in Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from sheetforge.shipping import ship

BASE = ["part", "lineitem", "orders", "embeddings", "documents", "labels", "conversations", "benchmark", "supplier", "events"]

DOMAIN = {
    "lines": "SELECT CAST(l_orderkey AS INT) AS o, l_linenumber AS n, CAST(MIN(l_partkey) AS INT) AS p, CAST(MIN(l_suppkey) AS INT) AS s, MIN(l_quantity) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber",
    "drawings": "SELECT CAST(p_partkey AS INT) AS drawing_id, p_name AS name, CONCAT('scan ', p_brand) AS image FROM part",
    "runtimes": "SELECT o * 10 + n AS runtime_id, p AS drawing_id, CONCAT('M', CAST(s % 20 AS STRING)) AS machine, q AS machine_runtime FROM lines",
    "history": "SELECT CAST(o_orderkey AS INT) AS history_id, o_orderpriority AS query_path, o_orderdate AS timestamp FROM orders",
    "feedbacks": "SELECT o * 10 + n AS feedback_id, o AS history_id, p AS drawing_id, CONCAT('note ', CAST(s AS STRING)) AS feedback_desc, n % 3 AS feedback_value FROM lines WHERE s % 4 = 0",
    "blobs": """SELECT o AS drawing_id, n AS pos, p % 900 AS x, s * 7 AS y, 10 + p % 40 AS w, 10 + s % 40 AS h,
      CASE p % 10 WHEN 0 THEN CONCAT('Ra ', CAST(s % 30 AS STRING), '.', CAST(n AS STRING))
        WHEN 1 THEN CONCAT('M', CAST(s % 40 AS STRING), 'x1.5 G1/', CAST(n AS STRING), '" 1/2 NPT')
        WHEN 2 THEN CONCAT('⌾ 0.0', CAST(n AS STRING), ' A') WHEN 3 THEN CONCAT('DIN ISO ', CAST(1000 + s % 90 * 10 AS STRING))
        WHEN 4 THEN CONCAT('⌀', CAST(s % 90 AS STRING)) WHEN 5 THEN CAST(s % 400 AS STRING) WHEN 6 THEN 'DIN ISO 2768 mK'
        WHEN 7 THEN CONCAT('// 0.', CAST(n AS STRING), ' B Rz', CAST(s % 20 AS STRING)) WHEN 8 THEN CONCAT('R', CAST(s % 50 AS STRING), ' 45°')
        ELSE CONCAT('SW ', CAST(s % 60 AS STRING), ':1 Rt 0.', CAST(n AS STRING)) END AS text,
      p % 13 = 0 AS is_text FROM lines""",
    "rects": "SELECT o AS drawing_id, n AS rect_id, (p % 12) * 40 AS x, (s % 12) * 40 AS y, 60 + (p % 5) * 40 AS w, 60 + (s % 5) * 40 AS h FROM lines",
    "frames": "SELECT drawing_id, CAST(MIN(rect_id) AS INT) AS rect_id, 0 AS x, 0 AS y, 600 AS w, 600 AS h FROM rects GROUP BY drawing_id",
    "pages": "SELECT DISTINCT o AS drawing_id, CAST(90000 AS BIGINT) AS image_area FROM lines",
    "boxes": """SELECT o AS drawing_id, n AS pos, (s % 25) * 20 AS x, (p % 25) * 20 AS y, 20 + p % 30 AS w, 10 + s % 6 AS h, CASE p % 11 WHEN 0 THEN CONCAT('Ra ', CAST(s % 30 AS STRING), '.2') WHEN 1 THEN 'DIN ISO 2768 mK' WHEN 2 THEN CONCAT('DIN ISO ', CAST(1000 + s % 90 * 10 AS STRING))
        WHEN 3 THEN CONCAT('⌀', CAST(s % 90 AS STRING)) WHEN 4 THEN CAST(s % 400 AS STRING) WHEN 5 THEN CONCAT('M', CAST(s % 40 AS STRING), 'x1.5') WHEN 6 THEN CONCAT('// 0.0', CAST(n AS STRING), ' A')
        WHEN 7 THEN 'red ring' WHEN 8 THEN 'Werkstoff' WHEN 9 THEN CONCAT('part no ', CAST(p % 7 AS STRING)) ELSE CONCAT('w', CAST(p % 7 AS STRING)) END AS text FROM lines""",
    "corpus": "SELECT CAST(vec_id AS INT) AS drawing_id, embedding AS search_vector, label FROM embeddings",
    "features": """SELECT CAST(p_partkey AS INT) AS drawing_id, p_name AS name, CASE WHEN p_size % 3 = 0 THEN 'mK' WHEN p_size % 3 = 1 THEN 'f-' ELSE 'xh' END AS tolerance,
      CASE WHEN p_size % 5 = 0 THEN 'c-' ELSE 'vL' END AS tolerance2, CONCAT('Ra ', CAST(p_size AS STRING), '.2') AS surface, CONCAT('Rz', CAST(p_size % 7 AS STRING), '.5') AS surface2,
      CONCAT('⌾ 0.', CAST(p_size AS STRING), ' A') AS gdt, CONCAT('// 0.0', CAST(p_size % 9 AS STRING)) AS gdt2, CAST(p_size AS DOUBLE) AS d1, CAST(p_size % 11 AS DOUBLE) AS d2 FROM part""",
    "ranked": """SELECT source AS tag, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INT) AS pos,
      CASE WHEN quality = 0 THEN 'NOT Relevant' WHEN toxic = 1 THEN 'Only Feature 1 Relevant' WHEN doc_id % 7 = 0 THEN 'Only Feature 2 Relevant' ELSE 'Both Relevant' END AS label
      FROM (SELECT d.source AS source, d.doc_id AS doc_id, l.quality AS quality, l.toxic AS toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id) j""",
    "pixels": "SELECT CAST(o % 500 AS INT) AS image_id, CAST(FLOOR(o / 500) AS BIGINT) * 8 + n AS pos, CAST(p % 3 AS INT) AS gt, CAST(CASE WHEN s % 4 = 0 THEN s % 3 ELSE p % 3 END AS INT) AS pred FROM lines",
}

#: Domain tables in an order in which each uses only earlier ones.
ORDER = list(DOMAIN)


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named domain or base tables of a folder."""
    ship(spark)
    base = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE}
    found: dict[str, DataFrame] = {}

    def get(name: str) -> DataFrame:
        if name in base and name not in DOMAIN:
            return base[name]
        if name not in found:
            sql = DOMAIN[name]
            used = {t: get(t) for t in [*BASE, *ORDER] if t != name and f" {t}" in sql.replace("\n", " ") and (t in base or ORDER.index(t) < ORDER.index(name))}
            for t in sorted(used, key=len, reverse=True):
                sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
            # tables by name of their frames: the session's views stay as they are
            found[name] = spark.sql(sql, **used)
        return found[name]

    return [get(n) for n in names]


def with_tables(sql: str, *names: str) -> str:
    """SQL text with the named domain tables, and those that they use, in front of it."""
    needed: list[str] = []

    def add(name: str) -> None:
        for t in ORDER[: ORDER.index(name)]:
            if f"FROM {t}" in DOMAIN[name] and t not in needed:
                add(t)
        if name not in needed:
            needed.append(name)

    for n in names:
        add(n)
    head = ", ".join(f"{n} AS ({DOMAIN[n]})" for n in needed)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
