"""Registered queries over derived drawing tables, with SQL of the same meaning for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetforge.functions import distance
from sheetforge.operators import describe, encode, evaluate, extract, fuzzy, labelmaps, layout, search, store
from sheetforge.plans import workloads
from sheetforge.plans.domain import tables, with_tables
from sheetforge.scratch import stored
from sheetforge.sources import tables as files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(*names: str, sql: str | None = None, uses: tuple[str, ...] | None = None):
    """Registers a query of the named tables and, if there is one, its SQL (which may use further tables)."""

    def keep(function: Callable[..., DataFrame]):
        QUERIES[function.__name__] = lambda spark, sf_dir: function(*tables(spark, sf_dir, *names))
        if sql is not None:
            from sheetforge.plans.domain import DOMAIN

            ORACLES[function.__name__] = with_tables(sql, *[n for n in (uses or names) if n in DOMAIN]) if any(n in DOMAIN for n in (uses or names)) else sql
        return function

    return keep


# ------------------------------------------------------------------------------ sources


@query("corpus", sql="SELECT drawing_id, len(search_vector) AS n, round(list_sum(search_vector::DOUBLE[]), 3) + 0.0 AS total FROM corpus")
def a3_array_literals(corpus: DataFrame) -> DataFrame:
    """Vectors written as array literals and parsed again."""
    text = corpus.select("drawing_id", files.numbers_literal(F.col("search_vector")).alias("t"))
    back = text.select("drawing_id", files.parse_numbers(F.col("t")).alias("v"))
    return back.select("drawing_id", F.size("v").cast("long").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


@query("features", sql="SELECT drawing_id, '{\"' || tolerance || '\",\"' || replace(surface, '.', ',') || '\"}' AS literal, 2 AS n, replace(surface, '.', ',') AS last FROM features")
def a4_text_literals(features: DataFrame) -> DataFrame:
    """Lists of texts as quoted literals, and back."""
    literal = files.texts_literal(F.array("tolerance", F.replace("surface", F.lit("."), F.lit(","))))
    rows = features.select("drawing_id", literal.alias("literal"))
    back = files.parse_texts(F.col("literal"))
    return rows.select("drawing_id", "literal", F.size(back).alias("n"), F.try_element_at(back, F.lit(-1)).alias("last"))


@query("documents", sql="SELECT doc_id, lang AS tag, source AS tag2, length(trim(text, ' ')) AS n FROM (SELECT doc_id, lang, source, coalesce(replace(replace(trim(text, ' '), chr(10), ' '), ':', ';'), '') AS text FROM documents)")
def a7_split_prompts(documents: DataFrame) -> DataFrame:
    """Prompt lines of two tags split into tags and prompt."""
    text = F.coalesce(F.replace(F.replace(F.trim("text"), F.lit("\n"), F.lit(" ")), F.lit(":"), F.lit(";")), F.lit(""))
    lines = documents.select("doc_id", F.concat_ws(":", F.concat_ws(",", "lang", "source"), text).alias("value"))
    return files.split_prompts(lines).select("doc_id", F.get("tags", F.lit(0)).alias("tag"), F.get("tags", F.lit(1)).alias("tag2"), F.length("prompt").cast("long").alias("n"))


# ------------------------------------------------------------------------------ store


@query("drawings", "feedbacks", sql="SELECT drawing_id, name FROM drawings WHERE drawing_id IN (SELECT drawing_id FROM feedbacks WHERE feedback_value = 2)")
def b1_lookup_by_key(drawings: DataFrame, feedbacks: DataFrame) -> DataFrame:
    return store.lookup(drawings, feedbacks.where("feedback_value = 2"), "drawing_id").select("drawing_id", "name")


@query("runtimes", "drawings", sql="SELECT runtime_id, drawing_id, machine, machine_runtime FROM runtimes WHERE drawing_id IN (SELECT drawing_id FROM drawings WHERE name LIKE 'red%')")
def b2_children_of_keys(runtimes: DataFrame, drawings: DataFrame) -> DataFrame:
    return store.lookup(runtimes, drawings.where("name like 'red%'"), "drawing_id")


@query("feedbacks", "drawings", sql="SELECT drawing_id FROM drawings WHERE drawing_id NOT IN (SELECT drawing_id FROM feedbacks)")
def b3_keys_not_found(feedbacks: DataFrame, drawings: DataFrame) -> DataFrame:
    return store.not_found(feedbacks, drawings, "drawing_id")


@query("history", sql="SELECT history_id, query_path FROM history")
def b4_get_all(history: DataFrame) -> DataFrame:
    return history.select("history_id", "query_path")


@query("drawings", "features", sql="SELECT drawing_id, CASE WHEN drawing_id % 3 = 0 THEN concat(name, ' rev') ELSE name END AS name FROM drawings UNION ALL SELECT drawing_id + 1000000000, name FROM drawings WHERE drawing_id % 5 = 0")
def b5_upsert(drawings: DataFrame, features: DataFrame) -> DataFrame:
    """Two updates for each third drawing, the later one wins, and new rows."""
    old = drawings.select("drawing_id", "name", F.lit(1).alias("at")).where("drawing_id % 3 = 0")
    revised = old.select("drawing_id", F.concat("name", F.lit(" rev")).alias("name"), F.lit(2).alias("at"))
    new = drawings.where("drawing_id % 5 = 0").select((F.col("drawing_id") + 1_000_000_000).alias("drawing_id"), "name", F.lit(1).alias("at"))
    return store.upsert(drawings.select("drawing_id", "name"), old.unionByName(revised).unionByName(new), "drawing_id", order="at")


@query("runtimes", "drawings", sql="SELECT machine, count(*) AS n FROM runtimes WHERE drawing_id NOT IN (SELECT drawing_id FROM drawings WHERE name LIKE '%ring') GROUP BY machine")
def b6_delete_by_key(runtimes: DataFrame, drawings: DataFrame) -> DataFrame:
    return store.delete(runtimes, drawings.where("name like '%ring'"), "drawing_id").groupBy("machine").agg(F.count("*").alias("n"))


_GONE = "gone AS (SELECT drawing_id FROM drawings WHERE drawing_id % 4 = 1 AND drawing_id NOT IN (SELECT drawing_id FROM feedbacks))"


@query("drawings", "runtimes", "feedbacks", sql=f"""WITH {_GONE}
  SELECT 'drawings' AS tab, count(*) AS n FROM drawings WHERE drawing_id NOT IN (SELECT * FROM gone)
  UNION ALL SELECT 'runtimes', count(*) FROM runtimes WHERE drawing_id NOT IN (SELECT * FROM gone)
  UNION ALL SELECT 'feedbacks', count(*) FROM feedbacks
  UNION ALL SELECT 'blocked', count(*) FROM drawings WHERE drawing_id % 4 = 1 AND drawing_id IN (SELECT drawing_id FROM feedbacks)""")
def b7_cascade_restrict(drawings: DataFrame, runtimes: DataFrame, feedbacks: DataFrame) -> DataFrame:
    """Drawings deleted with their children where no feedback stands against it; rows left by table."""
    left = store.delete_drawings({"drawings": drawings, "runtimes": runtimes, "searchdata": drawings.select("drawing_id"), "feedbacks": feedbacks}, drawings.where("drawing_id % 4 = 1"))
    parts = [left[t].groupBy().agg(F.count("*").alias("n")).select(F.lit(t).alias("tab"), "n") for t in ("drawings", "runtimes", "feedbacks", "blocked")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("history", "feedbacks", sql="SELECT feedback_value, count(*) AS n FROM feedbacks WHERE history_id % 3 <> 0 GROUP BY feedback_value")
def b8_cascade_history(history: DataFrame, feedbacks: DataFrame) -> DataFrame:
    left = store.delete_history(history, feedbacks, history.where("history_id % 3 = 0"))
    return left["feedbacks"].groupBy("feedback_value").agg(F.count("*").alias("n"))


@query("feedbacks", "drawings", "history", sql="SELECT feedback_id, drawing_id % 2 = 0 AND history_id % 3 <> 0 AS accepted FROM feedbacks")
def b9_check_parents(feedbacks: DataFrame, drawings: DataFrame, history: DataFrame) -> DataFrame:
    good, bad = store.check_parents(feedbacks, [(drawings.where("drawing_id % 2 = 0"), "drawing_id"), (history.where("history_id % 3 <> 0"), "history_id")])
    return good.select("feedback_id", F.lit(True).alias("accepted")).unionByName(bad.select("feedback_id", F.lit(False).alias("accepted")))


_DOCUMENT = """WITH r AS (SELECT drawing_id, count(*) AS n, sum(machine_runtime) AS total, min(runtime_id) AS first FROM runtimes GROUP BY 1),
  f AS (SELECT drawing_id, count(*) AS n, sum(feedback_value) AS v FROM feedbacks GROUP BY 1)
  SELECT drawing_id, base64(image::BLOB) AS original_drawing, coalesce(r.n, 0) AS n_runtimes, r.total AS total_runtime, r.first AS first_runtime, coalesce(f.n, 0) AS n_feedbacks, f.v::BIGINT AS feedback_sum, name
  FROM drawings LEFT JOIN r USING (drawing_id) LEFT JOIN f USING (drawing_id)"""


@query("drawings", "runtimes", "feedbacks", sql=_DOCUMENT)
def b10_drawing_documents(drawings: DataFrame, runtimes: DataFrame, feedbacks: DataFrame) -> DataFrame:
    """Nested documents, read through their lists."""
    docs = store.drawing_documents(drawings.select("drawing_id", F.col("image").cast("binary").alias("original_drawing")), runtimes, drawings.select("drawing_id", "name"), feedbacks)

    def total(items: str, field: str):
        return F.when(F.size(items) > 0, F.aggregate(items, F.lit(0.0), lambda a, x: a + x[field]))

    return docs.select(
        "drawing_id", "original_drawing", F.size("runtimes").cast("long").alias("n_runtimes"), total("runtimes", "machine_runtime").alias("total_runtime"), F.get("runtimes", F.lit(0))["runtime_id"].alias("first_runtime"),
        F.size("feedbacks").cast("long").alias("n_feedbacks"), total("feedbacks", "feedback_value").cast("long").alias("feedback_sum"), F.col("searchdata.name").alias("name"),
    )


@query("history", "feedbacks", sql="SELECT history_id, query_path, count(feedback_id) AS n, coalesce(string_agg(feedback_desc, '|' ORDER BY feedback_id), '') AS notes FROM history LEFT JOIN feedbacks USING (history_id) GROUP BY 1, 2")
def b11_history_documents(history: DataFrame, feedbacks: DataFrame) -> DataFrame:
    docs = store.history_documents(history, feedbacks)
    return docs.select("history_id", "query_path", F.size("feedbacks").cast("long").alias("n"), F.array_join(F.transform("feedbacks", lambda f: f["feedback_desc"]), "|").alias("notes"))


@query("drawings", "runtimes", "feedbacks", sql="SELECT drawing_id, runtime_id, machine, machine_runtime FROM runtimes JOIN drawings USING (drawing_id)")
def b12_flatten_documents(drawings: DataFrame, runtimes: DataFrame, feedbacks: DataFrame) -> DataFrame:
    docs = store.drawing_documents(drawings.select("drawing_id", F.col("image").cast("binary").alias("original_drawing")), runtimes, drawings.select("drawing_id", "name"), feedbacks)
    return store.flatten_documents(docs)["runtimes"]


@query("drawings", sql="SELECT drawing_id, image AS back, base64(image::BLOB) AS encoded FROM drawings")
def b13_base64(drawings: DataFrame) -> DataFrame:
    coded = drawings.select("drawing_id", F.base64(F.col("image").cast("binary")).alias("encoded"))
    return coded.select("drawing_id", F.unbase64("encoded").cast("string").alias("back"), "encoded")


@query("history", "feedbacks", sql="SELECT (SELECT max(feedback_id) FROM feedbacks) + row_number() OVER (ORDER BY history_id) AS feedback_id, history_id FROM history")
def b14_serial_ids(history: DataFrame, feedbacks: DataFrame) -> DataFrame:
    return store.with_serial_ids(history.select("history_id"), feedbacks, "feedback_id", ["history_id"])


# ------------------------------------------------------------------------------ layout


@query("rects", "pages", sql="""SELECT drawing_id, rect_id, x, y, w, h FROM (SELECT r.*, row_number() OVER (PARTITION BY drawing_id ORDER BY w * h, rect_id) AS k FROM rects r JOIN pages USING (drawing_id)
  WHERE w * h > 0.33 * image_area AND w * h < image_area) WHERE k = 1""")
def c3_inner_frames(rects: DataFrame, pages: DataFrame) -> DataFrame:
    return layout.inner_frames(rects, pages)


_TOUCH = " OR ".join(
    f"(c.x <= {x} + {w} + 10 AND c.x + c.w >= {x} - 10 AND c.y <= {y} + {h} + 10 AND c.y + c.h >= {y} - 10)"
    for x, y, w, h in (("f.x", "f.y", "f.w", "0"), ("f.x + f.w", "f.y", "0", "f.h"), ("f.x", "f.y + f.h", "f.w", "0"), ("f.x", "f.y", "0", "f.h"))
)


@query("rects", "pages", sql=f"""WITH RECURSIVE start AS (SELECT drawing_id, x, y, w, h FROM (SELECT r.*, row_number() OVER (PARTITION BY drawing_id ORDER BY w * h, rect_id) AS k FROM rects r JOIN pages USING (drawing_id)
    WHERE w * h > 0.33 * image_area AND w * h < image_area) WHERE k = 1),
  f(drawing_id, x, y, w, h) AS (SELECT * FROM start UNION SELECT c.drawing_id, c.x, c.y, c.w, c.h FROM f JOIN rects c ON c.drawing_id = f.drawing_id WHERE {_TOUCH})
  SELECT r.drawing_id, r.rect_id FROM rects r JOIN start USING (drawing_id) WHERE EXISTS (SELECT 1 FROM f JOIN rects c ON c.drawing_id = f.drawing_id WHERE c.drawing_id = r.drawing_id AND c.rect_id = r.rect_id AND ({_TOUCH}))""")
def c4_reachable_cells(rects: DataFrame, pages: DataFrame) -> DataFrame:
    rects = stored(rects, "rects")
    return layout.reachable_cells(rects, layout.inner_frames(rects, pages)).select("drawing_id", "rect_id")


@query("rects", sql="""SELECT drawing_id, rect_id, rotation, CASE rotation WHEN 90 THEN y WHEN 180 THEN 800 - x - w WHEN 270 THEN 900 - y - h ELSE x END AS x,
  CASE rotation WHEN 90 THEN 800 - x - w WHEN 180 THEN 900 - y - h WHEN 270 THEN x ELSE y END AS y,
  CASE WHEN rotation IN (90, 270) THEN h ELSE w END AS w, CASE WHEN rotation IN (90, 270) THEN w ELSE h END AS h FROM (SELECT *, (drawing_id % 4) * 90 AS rotation FROM rects)""")
def c5_rotate(rects: DataFrame) -> DataFrame:
    turned = layout.rotate_rects(rects.withColumns({"rotation": F.col("drawing_id") % 4 * 90, "image_w": F.lit(800), "image_h": F.lit(900)}))
    return turned.drop("image_w", "image_h")


@query("rects", sql="""WITH t AS (SELECT drawing_id, (((x - (rect_id % 4) * 90) % 360) + 360) % 360 AS a, count(*) AS n, min(rect_id) AS f FROM rects WHERE y > 40 GROUP BY 1, 2)
  SELECT drawing_id, arg_min(a, (-n, f)) AS angle FROM t GROUP BY 1""")
def c6_dominant_angle(rects: DataFrame) -> DataFrame:
    rows = rects.select("drawing_id", F.col("rect_id").alias("pos"), F.when(F.col("y") > 40, F.col("x")).alias("angle"), (F.col("rect_id") % 4 * 90).alias("applied"))
    return layout.dominant_angle(rows)


_CX, _CY = "b.x + CAST(floor(b.w / 2) AS INT)", "b.y + CAST(floor(b.h / 2) AS INT)"
_REGION = f"""SELECT b.drawing_id, b.pos, CASE WHEN EXISTS (SELECT 1 FROM rects c WHERE c.drawing_id = b.drawing_id AND c.w * c.h < f.w * f.h AND {_CX} >= c.x - 5 AND {_CX} < c.x + c.w + 5 AND {_CY} >= c.y - 5 AND {_CY} < c.y + c.h + 5) THEN 'info'
  WHEN {_CX} >= f.x + 5 AND {_CX} < f.x + f.w - 5 AND {_CY} >= f.y + 5 AND {_CY} < f.y + f.h - 5 THEN 'drawing' ELSE 'outside' END AS region FROM boxes b JOIN frames f USING (drawing_id)"""


@query("boxes", "rects", "frames", sql=_REGION)
def c7_regions(boxes: DataFrame, rects: DataFrame, frames: DataFrame) -> DataFrame:
    return layout.box_regions(boxes, stored(rects, "rects"), frames).select("drawing_id", "pos", "region")


@query("rects", "frames", sql="SELECT drawing_id, min(rect_id) AS rect_id, x, y, w, h FROM rects WHERE NOT (x = 0 AND y = 0 AND w = 60 AND h = 60) GROUP BY drawing_id, x, y, w, h")
def c8_distinct_rects(rects: DataFrame, frames: DataFrame) -> DataFrame:
    return layout.without_frame(layout.distinct_rects(rects), frames.withColumns({"w": F.lit(60), "h": F.lit(60)}))


@query("rects", sql="""WITH p AS (SELECT a.drawing_id, CASE WHEN a.w * a.h >= b.w * b.h THEN b.rect_id ELSE a.rect_id END AS rect_id FROM rects a JOIN rects b USING (drawing_id)
  WHERE (a.x, a.y, a.w, a.h) <> (b.x, b.y, b.w, b.h) AND a.x + a.w // 2 > b.x AND a.x + a.w // 2 < b.x + b.w AND a.y + a.h // 2 > b.y AND a.y + a.h // 2 < b.y + b.h)
  SELECT r.* FROM rects r WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.drawing_id = r.drawing_id AND p.rect_id = r.rect_id)""")
def c9_nested_rects(rects: DataFrame) -> DataFrame:
    return layout.without_nested(stored(rects, "rects"))


@query("boxes", "rects", sql="SELECT b.drawing_id, r.rect_id, b.pos FROM boxes b JOIN rects r USING (drawing_id) WHERE b.x + b.w // 2 > r.x AND b.x + b.w // 2 < r.x + r.w AND b.y + b.h // 2 > r.y AND b.y + b.h // 2 < r.y + r.h")
def c10_assign_cells(boxes: DataFrame, rects: DataFrame) -> DataFrame:
    return layout.assign_cells(boxes, stored(rects, "rects")).select("drawing_id", "rect_id", "pos")


@query("boxes")
def c11_line_groups(boxes: DataFrame) -> DataFrame:
    """Text lines of each drawing; order-dependent, tested against a plain version."""
    return layout.line_groups(boxes, ["drawing_id"])


@query("boxes", sql="""WITH w AS (SELECT drawing_id, CAST(y // 100 AS INT) AS line, y + h // 2 AS cy, x + w // 2 AS cx, pos, text FROM boxes),
  l AS (SELECT drawing_id, line, avg(cy) AS y, string_agg(text, ' ' ORDER BY cx, pos, text) AS t FROM w GROUP BY 1, 2)
  SELECT drawing_id, string_agg(t, chr(10) ORDER BY y, line, t) AS text FROM l GROUP BY 1""")
def c12_merged_text(boxes: DataFrame) -> DataFrame:
    lines = boxes.select("drawing_id", "pos", F.floor(F.col("y") / 100).cast("int").alias("line"))
    return layout.merged_text(boxes, lines, ["drawing_id"])


@query("blobs", sql="""WITH c AS (SELECT drawing_id, pos, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS a, length(regexp_replace(text, '[^0-9]', '', 'g')) AS d FROM blobs)
  SELECT drawing_id, pos, round(CASE WHEN a + d = 0 THEN 0.0 ELSE a / (a + d) END, 6) AS share FROM c""")
def c13_letter_share(blobs: DataFrame) -> DataFrame:
    return blobs.select("drawing_id", "pos", F.round(layout.letter_share(F.col("text")), 6).alias("share"))


@query("boxes")
def c14_text_clusters(boxes: DataFrame) -> DataFrame:
    """Density clusters of text boxes; tested against a plain version."""
    return layout.text_clusters(stored(boxes, "boxes"))


@query("boxes", sql="SELECT drawing_id, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM boxes GROUP BY 1")
def c15_outer_boxes(boxes: DataFrame) -> DataFrame:
    return layout.outer_boxes(boxes, ["drawing_id"])


@query("boxes", "rects", "pages")
def c16_merge_text(boxes: DataFrame, rects: DataFrame, pages: DataFrame) -> DataFrame:
    """The whole layout step; its parts have SQL of their own."""
    return layout.merge_text(stored(boxes, "boxes"), stored(rects, "rects"), pages)


@query("rects", sql="SELECT drawing_id, rect_id, row_number() OVER (PARTITION BY drawing_id ORDER BY w * h DESC, rect_id DESC) - 1 AS view_pos FROM rects")
def c17_ordered_views(rects: DataFrame) -> DataFrame:
    return layout.ordered_views(rects.withColumnRenamed("rect_id", "idx")).select("drawing_id", F.col("idx").alias("rect_id"), "view_pos")


@query("rects", sql="SELECT drawing_id, count(*) FILTER (WHERE w > h) >= count(*) FILTER (WHERE w <= h) AS horizontal FROM rects WHERE NOT (w > 150 AND h > 150) GROUP BY 1")
def c18_orientation(rects: DataFrame) -> DataFrame:
    return layout.page_orientation(rects, most=150)


# ------------------------------------------------------------------------------ extraction

_THREADS = " || ".join(f"regexp_extract_all(text, '{p}')" for p in extract.THREADS)
_LISTS = f"""SELECT drawing_id, pos, x, y, w, h, text, is_text, regexp_extract_all(text, '{extract.SURFACE}') AS surfaces, regexp_extract_all(text, '{extract.GDT}') AS gdts, {_THREADS} AS threads,
  list_filter(list_transform(regexp_extract_all(lower(text), '{extract.NORM}'), lambda n: regexp_replace(n, '[^0-9.]', '', 'g')), lambda n: n NOT IN ('2768', '7168') AND n <> '') AS other_isos FROM blobs"""
_CLASSED = f"lists AS ({_LISTS}), classed AS (SELECT *, CASE WHEN len(surfaces) > 0 THEN 'surface' WHEN len(gdts) > 0 THEN 'gdt' WHEN len(threads) > 0 THEN 'thread' WHEN len(other_isos) > 0 THEN 'iso' END AS class FROM lists)"
_JOINED = "array_to_string(surfaces, '|') AS surfaces, array_to_string(gdts, '|') AS gdts, array_to_string(threads, '|') AS threads, array_to_string(other_isos, '|') AS other_isos"


def _joined(*names: str):
    return [F.array_join(c, "|").alias(c) for c in names]


@query("blobs", sql=f"WITH {_CLASSED} SELECT drawing_id, pos, {_JOINED}, class FROM classed")
def d1_extract_blobs(blobs: DataFrame) -> DataFrame:
    """Surfaces, geometric tolerances, threads, norms and class of all blobs."""
    return extract.extract_blobs(blobs).select("drawing_id", "pos", *_joined("surfaces", "gdts", "threads", "other_isos"), "class")


@query("blobs", sql=f"WITH {_CLASSED} SELECT drawing_id, array_to_string(flatten(list(surfaces ORDER BY pos)), '|') AS surfaces, array_to_string(flatten(list(gdts ORDER BY pos)), '|') AS gdts, array_to_string(flatten(list(threads ORDER BY pos)), '|') AS threads, array_to_string(flatten(list(other_isos ORDER BY pos)), '|') AS other_isos FROM classed GROUP BY 1")
def d11_gather(blobs: DataFrame) -> DataFrame:
    return extract.gather(extract.extract_blobs(blobs)).select("drawing_id", *_joined("surfaces", "gdts", "threads", "other_isos"))


_MEASURE = r"""CASE WHEN contains(text, '°') OR num = '' OR regexp_matches(text, 'R.?\d+\.?\d*') OR len(list_filter(string_split(num, '.'), lambda p: length(p) > 3)) > 0 OR contains(lower(text), 'din') OR contains(lower(text), 'iso') THEN NULL
  WHEN dia OR NOT contains(text, ':') THEN TRY_CAST(num AS DOUBLE) END"""
_NUM = r"regexp_extract(text, '\d+\.?\d*') AS num, contains(text, 'SW') OR contains(text, '⌀') AS dia"


@query("blobs", sql=f"SELECT drawing_id, pos, {_MEASURE} AS value, dia AND {_MEASURE} IS NOT NULL AS is_diameter FROM (SELECT *, {_NUM} FROM blobs)")
def d12_measures(blobs: DataFrame) -> DataFrame:
    m = extract.measure(F.col("text"))
    return blobs.select("drawing_id", "pos", m["value"].alias("value"), m["is_diameter"].alias("is_diameter"))


@query("blobs", sql=f"""WITH {_CLASSED}, m AS (SELECT drawing_id, pos, w, h, dia, {_MEASURE} AS v FROM (SELECT *, {_NUM} FROM classed WHERE class IS NULL AND NOT is_text)),
  b AS (SELECT drawing_id, coalesce(max(v) FILTER (WHERE NOT dia AND w >= h AND v > 0), 0) AS hor, coalesce(max(v) FILTER (WHERE NOT dia AND w < h AND v > 0), 0) AS ver, max(v) FILTER (WHERE dia AND v > 0) AS d FROM m GROUP BY 1),
  k AS (SELECT DISTINCT drawing_id FROM blobs)
  SELECT drawing_id, CASE WHEN d IS NULL THEN coalesce(hor, 0.0) ELSE d END AS first, CASE WHEN d IS NULL THEN coalesce(ver, 0.0) ELSE greatest(hor, ver) END AS second FROM k LEFT JOIN b USING (drawing_id)""")
def d13_outer_measures(blobs: DataFrame) -> DataFrame:
    out = extract.outer_measures(extract.extract_blobs(blobs))
    return out.select("drawing_id", F.get("outer_dimensions", F.lit(0))["value"].alias("first"), F.get("outer_dimensions", F.lit(1))["value"].alias("second"))


_SYMBOLS = "[" + ", ".join(f"'{s}'" for s in extract.GDT_SYMBOLS) + "]"


@query("blobs", sql=rf"""WITH n AS (SELECT drawing_id, pos, text, regexp_extract(text, '\d+\.*\d*') AS num, list_filter({_SYMBOLS}, lambda s: contains(text, s)) AS f FROM blobs)
  SELECT drawing_id, pos, f[-1] AS characteristic, TRY_CAST(num AS DOUBLE) AS value, trim(CASE WHEN num = '' THEN text ELSE replace(text, num, '') END, ' ') AS reference FROM n""")
def d15_gdt_parts(blobs: DataFrame) -> DataFrame:
    p = extract.gdt_parts(F.col("text"))
    return blobs.select("drawing_id", "pos", p["characteristic"].alias("characteristic"), p["value"].alias("value"), p["reference"].alias("reference"))


_NAMED = "CASE " + " ".join(f"WHEN contains(text, '{k}') THEN '{v}'" for k, v in extract.GDT_NAMES.items()) + " END"


@query("blobs", sql=rf"SELECT drawing_id, pos, {_NAMED} AS name, TRY_CAST(regexp_extract(text, '\d+\.*\d*') AS DOUBLE) AS runout FROM blobs")
def d16_gdt_names(blobs: DataFrame) -> DataFrame:
    g = extract.gdt_name(F.col("text"))
    return blobs.select("drawing_id", "pos", g["name"].alias("name"), g["runout"].alias("runout"))


def _materials(part: DataFrame) -> DataFrame:
    """A small dictionary from the table itself: kinds as classes, names as synonyms."""
    names = part.groupBy("p_name").agg(F.min("p_type").alias("p_type"))
    return names.select((F.abs(F.hash("p_type")) % 97).alias("class_id"), F.row_number().over(_by("p_name")).alias("pos"), F.col("p_name").alias("name"))


def _by(column: str):
    from pyspark.sql import Window

    return Window.orderBy(column)


_CANDIDATE = "CASE WHEN m[i] = 1 THEN coalesce(prev[i - 1], 0) + 1 ELSE prev[i] END"
_ROW = f"list_transform(range(1, len(m) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda i: {_CANDIDATE})))"


def _sql_ratios(pairs: str) -> str:
    """CTEs up to ratios(t, w, r): partial ratios of the pairs (t, w) of a SELECT, none of them empty; LCS by dynamic programming."""
    return f"""pairs AS (SELECT DISTINCT t, w FROM ({pairs})),
  sided AS (SELECT t, w, CASE WHEN length(t) <= length(w) THEN t ELSE w END AS a, CASE WHEN length(t) <= length(w) THEN w ELSE t END AS b FROM pairs UNION SELECT t, w, w, t FROM pairs WHERE length(t) = length(w)),
  wins AS (SELECT t, w, a, unnest(list_concat(list_transform(range(1, length(a)), lambda i: b[1:i]), list_transform(range(0, length(b) - length(a) + 1), lambda i: b[i + 1:i + length(a)]),
    list_transform(range(length(b) - length(a) + 1, length(b)), lambda i: b[i + 1:length(b)]))) AS v FROM sided),
  grids AS (SELECT a, v, list_transform(range(1, length(v) + 1), lambda j: 0) AS zero, list_transform(range(1, length(a) + 1), lambda i: list_transform(range(1, length(v) + 1), lambda j: CASE WHEN a[i] = v[j] THEN 1 ELSE 0 END)) AS marks
    FROM (SELECT DISTINCT a, v FROM wins)),
  lcs AS (SELECT a, v, list_max(list_reduce(marks, lambda prev, m: {_ROW}, zero)) AS l FROM grids),
  ratios AS (SELECT t, w, max(200 * l / (length(a) + length(v))) AS r FROM wins JOIN lcs USING (a, v) GROUP BY 1, 2)"""


@query("part", sql=f"""WITH words AS (SELECT regexp_extract(p_brand, '[0-9]+')::BIGINT AS word_id, min(p_name) AS word FROM part GROUP BY p_brand), texts AS (SELECT p_partkey, regexp_replace(p_name, '[aeo]', 'e', 'g') AS text FROM part),
  {_sql_ratios('SELECT lower(text) AS t, lower(word) AS w FROM texts, words')}, best AS (SELECT t, max(word_id) AS word_id FROM ratios JOIN words ON w = lower(word) WHERE r >= 85 AND length(t) >= 5 GROUP BY 1)
  SELECT p_partkey, text, coalesce(word_id, -1) AS word_id FROM texts LEFT JOIN best ON t = lower(text)""")
def d7_fuzzy_match(part: DataFrame) -> DataFrame:
    """Drawing names against a word list; tested against a plain version."""
    words = part.groupBy("p_brand").agg(F.min("p_name").alias("word")).select(F.regexp_extract("p_brand", r"\d+", 0).cast("long").alias("word_id"), "word")
    texts = part.select("p_partkey", F.regexp_replace("p_name", "[aeo]", "e").alias("text"))
    return fuzzy.fuzzy_match(texts, words).withColumn("word_id", F.coalesce("word_id", F.lit(-1)))


@query("blobs", "part")
def d8_materials_and_tolerances(blobs: DataFrame, part: DataFrame) -> DataFrame:
    """Materials and general tolerances of all blobs; tested against a plain version."""
    out = fuzzy.match_attributes(blobs, _materials(part))
    return out.select("drawing_id", "pos", F.array_join("material", "|").alias("material"), F.array_join("general_tolerances", "|").alias("general_tolerances"))


# ------------------------------------------------------------------------------ encoding


def _hot(letters: str, place: int) -> str:
    return ", ".join(f"CASE WHEN lower(substr(tolerance, {place}, 1)) = '{c}' OR lower(substr(tolerance2, {place}, 1)) = '{c}' THEN 1 ELSE 0 END" for c in letters)


@query("features", sql=f"SELECT drawing_id, concat_ws('', {_hot('fmcv', 1)}, {_hot('hkl', 2)}) AS hot FROM features")
def e2_tolerance_vector(features: DataFrame) -> DataFrame:
    hot = encode.tolerance_vector(F.array("tolerance", "tolerance2"))
    return features.select("drawing_id", F.array_join(F.transform(hot, lambda x: x.cast("int").cast("string")), "").alias("hot"))


def _grade(column: str) -> str:
    kinds = " ".join(
        f"WHEN lower(substr({column}, 1, 2)) = '{k}' THEN greatest({', '.join(f'CASE WHEN v >= {s} THEN {i} END' for i, s in enumerate(steps) if s is not None)})" for k, steps in encode.SURFACE_STEPS.items()
    )
    return f"(SELECT coalesce(CASE {kinds} END, 15) FROM (SELECT TRY_CAST(trim(substr({column}, 3)) AS DOUBLE) AS v))"


@query("features", sql=f"SELECT drawing_id, {_grade('surface')} AS grade, {_grade('surface2')} AS grade2, least({_grade('surface')}, {_grade('surface2')}) AS feature FROM features")
def e3_surface_grades(features: DataFrame) -> DataFrame:
    return features.select("drawing_id", encode.surface_grade(F.col("surface")).alias("grade"), encode.surface_grade(F.col("surface2")).alias("grade2"), encode.surface_feature(F.array("surface", "surface2")).alias("feature"))


@query("features", sql="SELECT drawing_id, least(1.0, CAST(regexp_replace(gdt, '[^0-9.]', '', 'g') AS DOUBLE)) AS concentric, least(1.0, CAST(regexp_replace(gdt2, '[^0-9.]', '', 'g') AS DOUBLE)) AS parallel, 1.0::DOUBLE AS other FROM features")
def e5_gdt_vector(features: DataFrame) -> DataFrame:
    v = encode.gdt_vector(F.array("gdt", "gdt2"))
    return features.select("drawing_id", F.get(v, F.lit(0)).alias("concentric"), F.get(v, F.lit(8)).alias("parallel"), F.get(v, F.lit(3)).alias("other"))


def _norms(part: DataFrame) -> DataFrame:
    """A dictionary of norms: one for each size in steps of five, so a bounded number."""
    sizes = part.select((F.col("p_size") - F.col("p_size") % 5).alias("norm_id")).distinct()
    return sizes.select("norm_id", F.concat(F.lit("DIN ISO "), (10_000 + F.col("norm_id") * 200).cast("string")).alias("name"))


@query("blobs", "part", sql=rf"""WITH norms AS (SELECT DISTINCT p_size - p_size % 5 AS norm_id, (10000 + (p_size - p_size % 5) * 200)::VARCHAR AS norm FROM part),
  found AS (SELECT drawing_id, unnest(list_filter(list_transform(regexp_extract_all(lower(text), '(?:din |iso )+[0-9]+'), lambda x: regexp_replace(x, '[^0-9.]', '', 'g')), lambda x: x NOT IN ('2768', '7168', ''))) AS number FROM blobs),
  {_sql_ratios('SELECT norm AS t, number AS w FROM norms, found')}, hot AS (SELECT DISTINCT drawing_id, t FROM found JOIN ratios ON number = w WHERE r >= 85),
  every AS (SELECT drawing_id, norm_id, norm FROM (SELECT DISTINCT drawing_id FROM blobs), norms)
  SELECT every.drawing_id, string_agg(CASE WHEN t IS NULL THEN '0' ELSE '1' END, '' ORDER BY norm_id) AS norms FROM every LEFT JOIN hot ON hot.drawing_id = every.drawing_id AND t = norm GROUP BY 1""")
def e6_norm_flags(blobs: DataFrame, part: DataFrame) -> DataFrame:
    """Known norms that drawings name, fuzzily; tested against a plain version."""
    known = _norms(part)
    found = extract.gather(extract.extract_blobs(blobs), lists=["other_isos"])
    out = fuzzy.norm_flags(found, known)
    return out.select("drawing_id", F.array_join(F.transform("norm_vector", lambda x: x.cast("int").cast("string")), "").alias("norms"))


@query("features", sql="SELECT drawing_id, d1 AS a, d2 AS b, 0.0::DOUBLE AS c, greatest(d1, d2) AS padded FROM features")
def e7_three_measures(features: DataFrame) -> DataFrame:
    three, padded = encode.three_measures(F.array("d1", "d2")), encode.padded_with_largest(F.array("d1", "d2"))
    return features.select("drawing_id", F.get(three, F.lit(0)).alias("a"), F.get(three, F.lit(1)).alias("b"), F.get(three, F.lit(2)).alias("c"), F.get(padded, F.lit(2)).alias("padded"))


_VIEWS = """WITH v AS (SELECT label AS drawing_id, drawing_id AS view_pos, unnest(range(1, 65)) AS i, unnest(search_vector) AS x FROM corpus), m AS (SELECT drawing_id, i, avg(x::DOUBLE) AS m FROM v GROUP BY 1, 2),
  d AS (SELECT v.drawing_id, view_pos, round(sqrt(sum((x - m) * (x - m))), 9) AS d FROM v JOIN m USING (drawing_id, i) GROUP BY 1, 2)"""


@query("corpus", sql=f"{_VIEWS} SELECT drawing_id, arg_min(view_pos, (d, view_pos)) AS view_pos FROM d GROUP BY 1")
def e10_representative_view(corpus: DataFrame) -> DataFrame:
    views = corpus.select(F.col("label").alias("drawing_id"), F.col("drawing_id").alias("view_pos"), F.col("search_vector").alias("embedding"))
    return encode.representative_embedding(views).select("drawing_id", "view_pos")


# ------------------------------------------------------------------------------ distances and search

#: The given 64-wide vectors read as sections.
LAYOUT64 = {"material": 12, "tolerances": 7, "surfaces": 1, "gdt": 12, "norm": 13, "dim": 3, "shape": 16}


def _vectors(corpus: DataFrame) -> DataFrame:
    """Multi-hot sections by sign; dimensions scaled to millimetres."""
    flags = [*range(19), *range(32, 45)]
    v = F.transform("search_vector", lambda x, i: F.when(i.isin(*flags), F.when(x > 0, 1.0).otherwise(0.0)).when(i.isin(45, 46), F.round(x.cast("double") * 1000, 3)).otherwise(x.cast("double")))
    return corpus.select("drawing_id", v.alias("search_vector"))


def _piece(v: str, first: int, last: int) -> str:
    return f"{v}[{first}:{last}]"


def _sql_jaccard(a: str, b: str) -> str:
    either = f"len(list_filter(list_zip({a}, {b}), lambda z: z[1] <> 0 OR z[2] <> 0))"
    return f"CASE WHEN {either} = 0 THEN 0.0 ELSE len(list_filter(list_zip({a}, {b}), lambda z: z[1] <> z[2])) / {either} END"


def _sql_cosine(a: str, b: str) -> str:
    return f"CASE WHEN list_sum({a}) = 0 OR list_sum({b}) = 0 THEN 1.0 ELSE 1 - list_cosine_similarity({a}, {b}) END"


def _sql_dimension(a: str, b: str) -> str:
    from itertools import permutations

    sums = [" + ".join(f"pow(({a}[{p + 1}] - {b}[{i + 1}]) / {distance.DIMENSION_STDS[i]}, 2)" for i, p in enumerate(order)) for order in permutations(range(3))]
    return "least(1.0, " + ", ".join(f"sqrt({s}) / 3" for s in sums) + ")"


def _sql_composite(weights: list[float]) -> str:
    parts, start = [], 1
    kinds = {"material": _sql_jaccard, "tolerances": _sql_jaccard, "norm": _sql_jaccard, "gdt": _sql_cosine, "shape": _sql_cosine, "dim": _sql_dimension, "surfaces": lambda a, b: f"abs({a}[1] - {b}[1]) / {distance.SURFACE_STD}"}
    for (name, n), w in zip(LAYOUT64.items(), weights, strict=True):
        parts.append(f"{w} * ({kinds[name](_piece('q.v', start, start + n - 1), _piece('c.v', start, start + n - 1))})")
        start += n
    return " + ".join(parts)


_FLAGS = ", ".join(str(i) for i in [*range(1, 20), *range(33, 46)])
_VEC = f"vec AS (SELECT drawing_id, list_transform(search_vector, lambda x, i: CASE WHEN i IN ({_FLAGS}) THEN CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END WHEN i IN (46, 47) THEN round(x::DOUBLE * 1000, 3) ELSE x::DOUBLE END)::DOUBLE[] AS v FROM corpus)"
_NEAREST = f"""WITH {_VEC}, d AS (SELECT q.drawing_id AS query_id, c.drawing_id, {_sql_composite(distance.WEIGHTS)} AS distance FROM vec q, vec c WHERE q.drawing_id % 20 = 0)
  SELECT query_id, drawing_id, round(distance, 5) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, drawing_id) AS rank FROM d) WHERE rank <= 5"""


@query("corpus", sql=f"WITH {_VEC} SELECT drawing_id, len(v[1:12]) AS material, round(list_sum(v[13:19]), 4) AS tolerances, round(v[20], 4) AS surface, round(list_sum(v[49:64]), 4) AS shape FROM vec")
def e9_sections(corpus: DataFrame) -> DataFrame:
    s = encode.split_vector(_vectors(corpus), layout=LAYOUT64)

    def total(c: str):
        return F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 4)

    return s.select("drawing_id", F.size("material").cast("long").alias("material"), total("tolerances").alias("tolerances"), F.round(F.get("surfaces", F.lit(0)), 4).alias("surface"), total("shape").alias("shape"))


@query("corpus", sql=f"WITH {_VEC} SELECT q.drawing_id AS a, c.drawing_id AS b, round({_sql_composite(distance.WEIGHTS)}, 5) AS distance FROM vec q JOIN vec c ON c.drawing_id = q.drawing_id + 1")
def f5_composite_distance(corpus: DataFrame) -> DataFrame:
    """Column form of the composite distance between neighbours in the table."""
    v = _vectors(corpus)
    pairs = v.select(F.col("drawing_id").alias("a"), F.col("search_vector").alias("q"), (F.col("drawing_id") + 1).alias("b")).join(v.select(F.col("drawing_id").alias("b"), F.col("search_vector").alias("c")), "b")
    return pairs.select("a", "b", F.round(distance.composite_distance(F.col("q"), F.col("c"), layout=LAYOUT64), 5).alias("distance"))


@query("corpus", sql=f"""WITH {_VEC}, p AS (SELECT q.drawing_id AS a, c.drawing_id AS b, q.v[46:48] AS x, c.v[46:48] AS y FROM vec q JOIN vec c ON c.drawing_id = q.drawing_id + 1)
  SELECT a, b, round(sqrt({" + ".join(f"pow((x[{i + 1}] - y[{i + 1}]) / {s}, 2)" for i, s in enumerate(distance.DIMENSION_STDS))}) / 3, 5) AS distance FROM p""")
def f10_standardised_distance(corpus: DataFrame) -> DataFrame:
    """Standardised distance of the outer dimensions of neighbours in the table, in their given order."""
    v = _vectors(corpus).select("drawing_id", F.slice("search_vector", 46, 3).alias("dims"))
    pairs = v.select(F.col("drawing_id").alias("a"), F.col("dims").alias("x"), (F.col("drawing_id") + 1).alias("b")).join(v.select(F.col("drawing_id").alias("b"), F.col("dims").alias("y")), "b")
    return pairs.select("a", "b", F.round(distance.zscore_l2(F.col("x"), F.col("y"), distance.DIMENSION_MEANS, distance.DIMENSION_STDS), 5).alias("distance"))


@query("corpus", sql=_NEAREST)
def f7_search(corpus: DataFrame) -> DataFrame:
    """Five nearest of every twentieth drawing among all."""
    v = _vectors(corpus)
    hits = search.search(v.where("drawing_id % 20 = 0").withColumnRenamed("drawing_id", "query_id"), v, k=5, layout=LAYOUT64)
    return hits.select("query_id", "drawing_id", F.round("distance", 5).alias("distance"), "rank")


_COSINE = """WITH d AS (SELECT q.drawing_id AS query_id, c.drawing_id, list_cosine_similarity(q.search_vector::DOUBLE[], c.search_vector::DOUBLE[]) AS score FROM corpus q, corpus c WHERE q.drawing_id % 20 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, drawing_id) AS rank FROM d)"""


@query("corpus", sql=f"{_COSINE} SELECT query_id, drawing_id, round(score, 5) AS score, rank FROM r WHERE rank <= 10")
def f8_text_search(corpus: DataFrame) -> DataFrame:
    v = corpus.select("drawing_id", F.col("search_vector").alias("llm_vector"))
    hits = search.text_search(v.where("drawing_id % 20 = 0").withColumnRenamed("drawing_id", "query_id"), v, k=10, dim=64)
    return hits.select("query_id", "drawing_id", F.round("score", 5).alias("score"), "rank")


@query("corpus", sql=f"{_COSINE} SELECT query_id, string_agg(drawing_id, ',' ORDER BY rank) AS ids FROM r WHERE rank <= 10 GROUP BY 1")
def f9_ranked_ids(corpus: DataFrame) -> DataFrame:
    v = corpus.select("drawing_id", F.col("search_vector").alias("llm_vector"))
    hits = search.text_search(v.where("drawing_id % 20 = 0").withColumnRenamed("drawing_id", "query_id"), v, k=10, dim=64)
    return search.ranked_ids(hits).select("query_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


_W2 = _NEAREST.replace("SELECT query_id, drawing_id, round(distance, 5) AS distance, rank FROM", "SELECT h.query_id, h.drawing_id, round(h.distance, 5) AS distance, h.rank, d2.name, coalesce(t.n, 0) AS n_runtimes, t.total AS total_runtime FROM", 1).replace(
    ") WHERE rank <= 5", ") h JOIN drawings d2 USING (drawing_id) LEFT JOIN (SELECT drawing_id, count(*) AS n, sum(machine_runtime) AS total FROM runtimes GROUP BY 1) t USING (drawing_id) WHERE h.rank <= 5", 1
)


@query("corpus", "drawings", "runtimes", sql=_W2)
def w2_search(corpus: DataFrame, drawings: DataFrame, runtimes: DataFrame) -> DataFrame:
    """Flagship: nearest drawings of every twentieth one, with names and machine run times."""
    v = _vectors(corpus)
    out = workloads.search_with_runtimes(v.where("drawing_id % 20 = 0").withColumnRenamed("drawing_id", "query_id"), v, drawings, runtimes, k=5, layout=LAYOUT64)
    return out.select("query_id", "drawing_id", F.round("distance", 5).alias("distance"), "rank", "name", "n_runtimes", "total_runtime")


# ------------------------------------------------------------------------------ display and texts

_LOW = "list_transform([tolerance, tolerance2], lambda t: lower(t))"
_GOOD = f"list_filter({_LOW}, lambda t: instr('fmcv-', substr(t, 1, 1)) > 0 AND instr('hkl-', substr(t, 2, 1)) > 0)"


@query("features", sql=f"""SELECT drawing_id, CASE WHEN {_grade('surface')} <= {_grade('surface2')} THEN surface ELSE surface2 END AS surface,
  coalesce(substr('fmcv-', list_min(list_transform({_GOOD}, lambda t: instr('fmcv-', substr(t, 1, 1))))::BIGINT, 1), '-') AS dimension_class,
  coalesce(substr('hkl-', list_min(list_transform({_GOOD}, lambda t: instr('hkl-', substr(t, 2, 1))))::BIGINT, 1), '-') AS geometry_class FROM features""")
def g1_tightest(features: DataFrame) -> DataFrame:
    """Tightest surface and general tolerance."""
    t = describe.tightest_tolerance(F.array("tolerance", "tolerance2"))
    return features.select("drawing_id", describe.tightest_surface(F.array("surface", "surface2")).alias("surface"), t["dimension_class"].alias("dimension_class"), t["geometry_class"].alias("geometry_class"))


_FORM = """CASE WHEN CAST(regexp_extract(gdt, '\\d+\\.\\d+') AS DOUBLE) <= CAST(regexp_extract(gdt2, '\\d+\\.\\d+') AS DOUBLE) THEN '⌾ ' || CAST(regexp_extract(gdt, '\\d+\\.\\d+') AS DOUBLE) ELSE '// ' || CAST(regexp_extract(gdt2, '\\d+\\.\\d+') AS DOUBLE) END"""


@query("features", sql=f"SELECT drawing_id, {_FORM} AS gdt, d1 || 'x' || d2 AS dimensions, name AS material FROM features".replace("\\\\", "\\"))
def g3_display_row(features: DataFrame) -> DataFrame:
    """Display rows: form tolerance, dimensions, first material."""
    lists = features.select(
        "drawing_id", F.array("name").alias("material"), F.array("d1", "d2").alias("outer_dimensions"), F.array("tolerance", "tolerance2").alias("general_tolerances"), F.array("surface", "surface2").alias("surfaces"), F.array("gdt", "gdt2").alias("gdts")
    )
    return describe.display_row(lists).select("drawing_id", "gdt", "dimensions", "material")


@query("features", sql="SELECT drawing_id, name AS material, surface, d1 AS a, 0.0::DOUBLE AS c FROM features")
def g6_record_round_trip(features: DataFrame) -> DataFrame:
    """Drawing structs to JSON and back."""
    lists = features.select("drawing_id", F.array("name").alias("material"), F.array("surface").alias("surfaces"), F.array("d1", "d2").alias("outer_dimensions"))
    record = describe.drawing_record(lists)
    back = describe.from_dict(describe.to_dict(record), record.schema["drawing"].dataType.simpleString())
    d = F.col("drawing")
    return back.select("drawing_id", F.get(d["material"], F.lit(0)).alias("material"), F.get(d["surfaces"], F.lit(0)).alias("surface"), F.get(d["outer_dimensions"], F.lit(0)).alias("a"), F.get(d["outer_dimensions"], F.lit(2)).alias("c"))


def _sql_words(column: str) -> str:
    first = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in describe.TOLERANCE_NAMES.items())
    second = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in describe.GEOMETRY_NAMES.items())
    return f"(CASE substr(lower({column}), 1, 1) {first} ELSE substr(lower({column}), 1, 1) END || ' and ' || CASE substr(lower({column}), 2, 1) {second} ELSE substr(lower({column}), 2, 1) END)"


def _sql_line(section: str, *items: str) -> str:
    return f"'{section}: ' || array_to_string(list_sort(list_distinct([{', '.join(items)}])), ', ')"


def _sql_gdt(column: str) -> str:
    for k, v in extract.GDT_NAMES.items():
        column = f"replace({column}, '{k}', '{v}')"
    return column


_DESCRIBED = " || chr(10) || ".join(
    ["'Name: ' || name", _sql_line("Material", "name || ', ' || name"), _sql_line("Toleranzen nach ISO-2768", _sql_words("tolerance"), _sql_words("tolerance2")), _sql_line("Oberflächenrauheit", "surface", "surface2"), _sql_line("GD&T", _sql_gdt("gdt"), _sql_gdt("gdt2")), "'Gewinde: keine'", "'Die Aussendimensionen des Teils sind ' || d1 || 'x' || d2 || ' Millimeter. '"]
)


@query("features", sql=f"SELECT drawing_id, {_DESCRIBED} AS description FROM features")
def g10_description(features: DataFrame) -> DataFrame:
    """Seven-line descriptions."""
    lists = features.select(
        "drawing_id", "name", F.array(F.array("name", "name")).alias("material_names"), F.array("tolerance", "tolerance2").alias("general_tolerances"), F.array("surface", "surface2").alias("surfaces"), F.array("gdt", "gdt2").alias("gdts"),
        F.array().cast("array<string>").alias("threads"), F.array("d1", "d2").alias("outer_dimensions"),
    )
    return describe.describe(lists).select("drawing_id", "description")


@query("features", sql="SELECT drawing_id, name AS component FROM features")
def g11_last_json(features: DataFrame) -> DataFrame:
    answer = F.concat(F.lit('Sure {"component_name": "no"} then\n{"component_name":\n"'), "name", F.lit('"} done'))
    return features.select("drawing_id", describe.last_json_field(answer).alias("component"))


@query("features", sql="SELECT drawing_id, d1 % 3 <> 0 AS valid FROM features")
def g12_typed_answers(features: DataFrame) -> DataFrame:
    """Model answers parsed to records; every third lacks a measure."""
    measures = F.when(F.col("d1") % 3 == 0, F.lit("[1, 2]")).otherwise(F.lit("[1, 2, 3]"))
    answer = F.concat(F.lit('x OUTPUT START {"material": [], "general_tolerances": {"char1": "m", "char2": "k"}, "name": "'), "name", F.lit('", "surfaces": [], "gdts": [{"name": "Flatness", "runout": 0.1}], "threads": [], "outer_measures": '), measures, F.lit("} OUTPUT END y"))
    good, bad = describe.typed_answer(features.select("drawing_id", answer.alias("answer")), f"struct<{', '.join(p for p in [_colon(files.ANSWER)])}>")
    return good.select("drawing_id", F.lit(True).alias("valid")).unionByName(bad.select("drawing_id", F.lit(False).alias("valid")))


def _colon(schema: str) -> str:
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(schema).simpleString()[len("struct<") : -1]


@query("conversations", sql="SELECT conv_id, turn, role FROM conversations WHERE role IN ('user', 'assistant')")
def g13_chat_messages(conversations: DataFrame) -> DataFrame:
    return describe.chat_messages(conversations).select("conv_id", "turn", "role")


@query("conversations", sql="SELECT conv_id, arg_max(text, turn) AS text FROM conversations GROUP BY 1")
def g14_last_messages(conversations: DataFrame) -> DataFrame:
    return describe.last_messages(conversations)


@query("corpus", "drawings", sql=f"{_COSINE} SELECT query_id, '{describe.RESULTS_HEAD}' || chr(10) || string_agg('Teil: ' || name, chr(10) ORDER BY rank) AS context FROM r JOIN drawings USING (drawing_id) WHERE rank <= 10 GROUP BY 1")
def g15_results_context(corpus: DataFrame, drawings: DataFrame) -> DataFrame:
    v = corpus.select("drawing_id", F.col("search_vector").alias("llm_vector"))
    queries = v.where("drawing_id % 20 = 0").withColumnRenamed("drawing_id", "query_id")
    hits = search.text_search(queries, v, k=10, dim=64)
    return describe.results_context(queries.select(F.col("query_id").cast("long")), hits, drawings.select("drawing_id", F.col("name").alias("llm_text")))


@query("features", sql="SELECT drawing_id, name || '\\,' || tolerance AS cleaned, 1 AS n, name AS listed, d1 + 0.5 AS number FROM features")
def g16_clean_texts(features: DataFrame) -> DataFrame:
    """Cleaning and list parsing."""
    cleaned = describe.clean_texts(F.array(F.concat_ws(",", F.concat(F.lit("'"), "name"), "tolerance"), F.lit("  ")))
    listed = describe.distinct_non_empty(describe.parse_list(F.concat(F.lit("['"), "name", F.lit("',,'"), "name", F.lit("']"))))
    number = describe.decimal_comma(F.concat(F.col("d1").cast("int").cast("string"), F.lit(",5")))
    return features.select("drawing_id", F.get(cleaned, F.lit(0)).alias("cleaned"), F.size(listed).alias("n"), F.get(listed, F.lit(0)).alias("listed"), number.alias("number"))


@query("documents", sql="SELECT doc_id, md5(replace(replace(translate(coalesce(text, ''), 'äöüÄÖÜ', 'aouAOU'), 'ß', 'ss'), '±', '+-')) AS digest FROM documents")
def g18_transliterate(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.md5(describe.transliterate(F.coalesce("text", F.lit("")))).alias("digest"))


@query("lines", sql="""WITH c AS (SELECT o, n, s % 3 AS v, n - row_number() OVER (PARTITION BY o, s % 3 ORDER BY n) AS g0, CASE WHEN lag(s % 3) OVER (PARTITION BY o ORDER BY n) = s % 3 THEN 0 ELSE 1 END AS new FROM lines),
  r AS (SELECT *, sum(new) OVER (PARTITION BY o ORDER BY n) AS run FROM c) SELECT o, v, min(n) AS start, max(n) AS "end", count(*) AS length FROM r GROUP BY o, run, v HAVING count(*) > 1""")
def g19_equal_runs(lines: DataFrame) -> DataFrame:
    return describe.equal_runs(lines.select("o", "n", (F.col("s") % 3).alias("v")), ["o"], "n", "v")


# ------------------------------------------------------------------------------ evaluation

_PAIRS = "t AS (SELECT o, list(s % 5 ORDER BY n) AS truth, list(CASE WHEN p % 3 = 0 THEN s % 7 ELSE s % 5 END ORDER BY n) AS found FROM lines GROUP BY 1)"


def _pairs(lines: DataFrame, prefix: str = "") -> DataFrame:
    truth, found = F.concat(F.lit(prefix), (F.col("s") % 5).cast("string")), F.concat(F.lit(prefix), F.when(F.col("p") % 3 == 0, F.col("s") % 7).otherwise(F.col("s") % 5).cast("string"))
    rows = F.sort_array(F.collect_list(F.struct("n", truth.alias("t"), found.alias("f"))))
    return lines.groupBy("o").agg(rows.alias("r")).select("o", F.transform("r", lambda x: x["t"]).alias("truth"), F.transform("r", lambda x: x["f"]).alias("found"))


@query("lines", sql=f"""WITH {_PAIRS}, m AS (SELECT o, len(truth) AS n, list_sum(list_transform(list_distinct(truth), lambda v: least(len(list_filter(truth, lambda x: x = v)), len(list_filter(found, lambda x: x = v)))))::INT AS tp FROM t)
  SELECT o, tp, n - tp AS fp, n - tp AS fn, round(tp / (2 * n - tp), 6) AS accuracy FROM m""")
def h1_match_exact(lines: DataFrame) -> DataFrame:
    """Multiset matches and scores (H1, H4)."""
    counts = evaluate.match_exact(_pairs(lines), "o", "truth", "found")
    return counts.select("o", "tp", "fp", "fn", F.round(evaluate.scores(F.col("tp"), F.col("fp"), F.col("fn"))["accuracy"], 6).alias("accuracy"))


@query("lines")
def h2_match_fuzzy(lines: DataFrame) -> DataFrame:
    """Greedy fuzzy matches (H2, H3); tested against a plain version."""
    pairs = _pairs(lines, "Ra 3.")
    first = evaluate.match_fuzzy(pairs, "o", "truth", "found", 80)
    again = evaluate.match_fuzzy(pairs, "o", "truth", "found", 90, "skipping").select("o", F.col("tp").alias("tp_skipping"))
    return first.join(again, "o")


_CHARS = "c AS (SELECT drawing_id, substr(tolerance, 1, 1) = substr(tolerance2, 1, 1) AS a, substr(tolerance, 2, 1) = substr(tolerance2, 2, 1) AS b FROM features), k AS (SELECT drawing_id, a::INT + b::INT AS tp FROM c)"


@query("features", sql=f"WITH {_CHARS} SELECT drawing_id, tp / 2 AS accuracy, CASE WHEN tp = 0 THEN 0.0 ELSE tp / 2 END AS precision, 1.0::DOUBLE AS recall FROM k WHERE tp > 0 UNION ALL SELECT drawing_id, 0.0, 0.0, 1.0 FROM k WHERE tp = 0")
def h5_tolerance_scores(features: DataFrame) -> DataFrame:
    def chars(c: str):
        return F.struct(F.substring(c, 1, 1).alias("char1"), F.substring(c, 2, 1).alias("char2"))

    return features.select("drawing_id", chars("tolerance").alias("t"), chars("tolerance2").alias("f")).select("drawing_id", evaluate.tolerance_scores(F.col("t"), F.col("f")).alias("s")).select("drawing_id", "s.*")


@query("part", sql=f"""WITH n AS (SELECT p_partkey, lower(p_name) AS t, lower(regexp_replace(p_name, 'e', 'a', 'g')) AS w FROM part), {_sql_ratios('SELECT t, w FROM n')}
  SELECT p_partkey, CASE WHEN r > 90 THEN 1.0 ELSE 0.0 END::DOUBLE AS match FROM n JOIN ratios USING (t, w)""")
def h6_name_match(part: DataFrame) -> DataFrame:
    """Fuzzy name matches; tested against a plain version."""
    return evaluate.match_names(part.select("p_partkey", "p_name", F.regexp_replace("p_name", "e", "a").alias("found")), "p_name", "found").select("p_partkey", "match")


def _sql_gap(a: str, b: str) -> str:
    return f"CASE WHEN {a} = 0 OR {b} = 0 THEN greatest({a}, {b}) ELSE greatest({a}, {b}) / least({a}, {b}) END"


def _sql_measures() -> str:
    from itertools import permutations

    truth, found = ["d1", "d2", "7.0"], ["d2", "(d1 + 1)", "0.0"]
    return "least(" + ", ".join("(" + " + ".join(_sql_gap(truth[p], found[i]) for i, p in enumerate(order)) + ")" for order in permutations(range(3))) + ")"


@query("features", sql=f"SELECT drawing_id, round({_sql_measures()}, 6) AS distance FROM features")
def h7_measure_distance(features: DataFrame) -> DataFrame:
    return features.select("drawing_id", F.round(evaluate.measure_distance(F.array(F.col("d1"), F.col("d2"), F.lit(7.0)), F.array(F.col("d2"), F.col("d1") + 1)), 6).alias("distance"))


@query("runtimes", sql="SELECT machine AS field, round(avg(machine_runtime), 6) AS mean, quantile_cont(machine_runtime, 0.5) AS median, count(*) AS n FROM runtimes GROUP BY 1")
def h8_field_summary(runtimes: DataFrame) -> DataFrame:
    out = evaluate.field_summary(runtimes.select(F.col("machine").alias("field"), F.col("machine_runtime").alias("value")))
    return out.withColumn("mean", F.round("mean", 6))


@query("runtimes", sql="""WITH s AS (SELECT machine, min(machine_runtime) AS lo, max(machine_runtime) AS hi FROM runtimes GROUP BY 1)
  SELECT machine AS field, CASE WHEN hi = lo THEN 10 ELSE least(19, floor((machine_runtime - lo) / (hi - lo) * 20))::INT END AS bin, count(*) AS n FROM runtimes JOIN s USING (machine) GROUP BY 1, 2""")
def h8_histogram(runtimes: DataFrame) -> DataFrame:
    return evaluate.histogram(runtimes.select(F.col("machine").alias("field"), F.col("machine_runtime").alias("value")))


_CODES = "r AS (SELECT tag, CAST(floor(pos / 5) AS INT) AS prompt_id, pos % 5 + 1 AS rank, CASE WHEN label LIKE '%Feature%' THEN 0 WHEN label LIKE '%NOT%' THEN -1 ELSE 1 END AS rel, CASE WHEN label LIKE '%Feature 1%' THEN 1 WHEN label LIKE '%Feature 2%' THEN 2 WHEN label LIKE '%NOT%' THEN -1 ELSE 0 END AS feature FROM ranked)"


def _codes(ranked: DataFrame) -> DataFrame:
    return evaluate.relevance_codes(evaluate.ranks_in_chunks(ranked))


@query("ranked", sql=f"WITH {_CODES}, e AS (SELECT tag, prompt_id, count(*) FILTER (WHERE rel = 1 AND rank <= 3) / 3 AS p, count(*) FILTER (WHERE rel >= 0 AND rank <= 3) / 3 AS q FROM r GROUP BY 1, 2) SELECT tag, round(avg(p), 6) AS precision, round(avg(q), 6) AS precision_partly, count(*) AS n FROM e GROUP BY 1")
def h9_precision_at_3(ranked: DataFrame) -> DataFrame:
    """precision@3 for each tag, partly right results counted both ways."""
    out = evaluate.precision_at_k(_codes(ranked), 3, by=["tag"], partial=True)
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "precision_partly")})


@query("ranked", sql=f"""WITH {_CODES}, x AS (SELECT tag || '-a' AS t, tag, prompt_id, rank, CASE WHEN feature IN (0, 1) THEN 1 ELSE -1 END AS rel FROM r UNION ALL SELECT tag || '-b', tag, prompt_id, rank, CASE WHEN feature IN (0, 2) THEN 1 ELSE -1 END FROM r),
  e AS (SELECT t, prompt_id, count(*) FILTER (WHERE rel = 1 AND rank <= 5) / 5 AS p FROM x GROUP BY 1, 2) SELECT t AS tag, round(avg(p), 6) AS precision, count(*) AS n FROM e GROUP BY 1""")
def h11_precision_per_tag(ranked: DataFrame) -> DataFrame:
    """Two-tag prompts as one relevance list per tag."""
    rows = _codes(ranked).withColumn("tags", F.array(F.concat("tag", F.lit("-a")), F.concat("tag", F.lit("-b"))))
    return evaluate.precision_at_k(evaluate.per_tag_relevance(rows), 5, by=["tag"]).withColumn("precision", F.round("precision", 6))


@query("ranked", sql=f"""WITH {_CODES}, x AS (SELECT 's' AS k, concat_ws(' ', prompt_id, tag) AS id, rank, rel FROM r UNION ALL SELECT 'a', concat_ws(' ', prompt_id, tag), rank, CASE WHEN feature IN (0, 1) THEN 1 ELSE -1 END FROM r
  UNION ALL SELECT 'b', concat_ws(' ', prompt_id, tag), rank, CASE WHEN feature IN (0, 2) THEN 1 ELSE -1 END FROM r),
  e AS (SELECT k, id, count(*) FILTER (WHERE rel = 1 AND rank <= 3) / 3 AS p, count(*) FILTER (WHERE rel >= 0 AND rank <= 3) / 3 AS q FROM x GROUP BY 1, 2) SELECT round(avg(p), 6) AS precision, round(avg(q), 6) AS precision_partly, count(*) AS n FROM e""")
def h12_all_prompts(ranked: DataFrame) -> DataFrame:
    """Simple and two-tag prompts together: overall precision@3 (H12). A prompt is a number and a tag, the number first, so that no two read alike."""
    rows = _codes(ranked).withColumn("prompt_id", F.concat_ws(" ", F.col("prompt_id").cast("string"), "tag"))
    tag = F.coalesce("tag", F.lit(""))
    per_tag = evaluate.per_tag_relevance(rows.withColumn("tags", F.array(F.concat(tag, F.lit("-a")), F.concat(tag, F.lit("-b")))))
    out = evaluate.precision_at_k(evaluate.all_prompts(rows, per_tag), 3, key="prompt", partial=True)
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "precision_partly")})


@query("corpus", "drawings", sql=f"{_COSINE} SELECT query_id AS prompt_id, rank, drawing_id, name FROM r JOIN drawings USING (drawing_id) WHERE rank <= 5")
def h13_labelling_tasks(corpus: DataFrame, drawings: DataFrame) -> DataFrame:
    v = corpus.select("drawing_id", F.col("search_vector").alias("llm_vector"))
    queries = v.where("drawing_id % 20 = 0").withColumnRenamed("drawing_id", "query_id")
    hits = search.text_search(queries, v, k=10, dim=64)
    prompts = queries.select(F.col("query_id").cast("long").alias("prompt_id"))
    return evaluate.labelling_tasks(prompts, hits, drawings.select("drawing_id", "name")).select("prompt_id", "rank", "drawing_id", "name")


_SEG = """k AS (SELECT image_id, c, count(*) FILTER (WHERE gt = c AND pred = c) AS tp, count(*) FILTER (WHERE gt <> c AND pred = c) AS fp, count(*) FILTER (WHERE gt = c AND pred <> c) AS fn FROM pixels, (SELECT unnest([0, 1, 2]) AS c) GROUP BY 1, 2),
  s AS (SELECT *, CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) END AS iou, CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END AS dice FROM k)"""


@query("pixels", sql=f"WITH {_SEG} SELECT image_id, c AS class, tp, fp, fn, round(iou, 6) AS iou, round(dice, 6) AS dice FROM s")
def h14_class_scores(pixels: DataFrame) -> DataFrame:
    out = evaluate.per_class_scores(pixels)
    return out.withColumns({"iou": F.round("iou", 6), "dice": F.round("dice", 6)})


@query("pixels", sql=f"WITH {_SEG} SELECT image_id, c AS class, tp, fp, fn, round(iou, 6) AS iou, round(dice, 6) AS dice FROM s")
def h14_label_maps(pixels: DataFrame) -> DataFrame:
    """Class scores of label images in tiles of byte strings."""
    tiles = labelmaps.packed_labels(pixels.withColumn("tile", F.expr("pos div 4096")), ["image_id", "tile"])
    out = evaluate.per_class_scores(labelmaps.map_pairs(tiles))
    return out.withColumns({"iou": F.round("iou", 6), "dice": F.round("dice", 6)})


@query("pixels", sql="""SELECT image_id, round(coalesce(count(*) FILTER (WHERE gt = 0 AND pred = 0) / nullif(count(*) FILTER (WHERE gt = 0 OR pred = 0), 0), 1.0), 6) AS iou, round(coalesce(2 * count(*) FILTER (WHERE gt = 0 AND pred = 0)
  / nullif(count(*) FILTER (WHERE gt = 0) + count(*) FILTER (WHERE pred = 0), 0), 1.0), 6) AS dice, count(*) AS n FROM pixels GROUP BY 1""")
def h14_run_lengths(pixels: DataFrame) -> DataFrame:
    """Scores of the background, and pixels, of label images in tiles of runs."""
    tiles = labelmaps.packed_labels(pixels.withColumn("tile", F.expr("pos div 4096")), ["image_id", "tile"])
    pairs = labelmaps.run_pairs(tiles.select("image_id", *[labelmaps.run_lengths(F.col(c)).alias(c) for c in ("gt", "pred")]))
    whole = pairs.groupBy("image_id").agg(F.sum("n").alias("n"))
    return evaluate.binary_scores(pairs).join(whole, "image_id").select("image_id", F.round("iou", 6).alias("iou"), F.round("dice", 6).alias("dice"), "n")


@query("pixels", sql=f"""WITH {_SEG}, i AS (SELECT image_id, avg(iou) AS a, avg(dice) AS b, avg(iou) FILTER (WHERE c > 0) AS x, avg(dice) FILTER (WHERE c > 0) AS y, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM s GROUP BY 1)
  SELECT count(*) AS images, round(avg(a), 6) AS iou_macro, round(avg(b), 6) AS dice_macro, round(avg(x), 6) AS iou_macro_fg, round(avg(y), 6) AS dice_macro_fg, round(sum(tp) / (sum(tp) + sum(fp) + sum(fn)), 6) AS iou_micro, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS dice_micro FROM i""")
def h14_segmentation(pixels: DataFrame) -> DataFrame:
    out = evaluate.segmentation_scores(pixels)
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c != "images"})


@query("pixels", sql="""WITH t AS (SELECT image_id, CASE WHEN pred = 2 THEN 2 WHEN gt = 0 THEN 0 ELSE 1 END AS truth, pred FROM pixels)
  SELECT image_id, truth, count(*) AS n FROM t GROUP BY 1, 2""")
def h15_truth_classes(pixels: DataFrame) -> DataFrame:
    return pixels.select("image_id", evaluate.truth_classes(F.col("gt") == 0, F.col("pred") == 2).alias("truth")).groupBy("image_id", "truth").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------------------ whole workloads


@query("boxes", "rects", "pages", "part")
def w1_index(boxes: DataFrame, rects: DataFrame, pages: DataFrame, part: DataFrame) -> DataFrame:
    """Bulk load: layout, extraction, gathering and encoding of all drawings; its steps have SQL of their own."""
    out = workloads.index_drawings(stored(boxes, "boxes"), stored(rects, "rects"), pages, _materials(part), _norms(part))
    vector = F.array_join(F.transform("ocr_vector", lambda x: F.round(x, 4).cast("string")), " ")
    return out.select("drawing_id", F.size("ocr_vector").alias("width"), F.sha2(vector, 256).alias("vector_sha256"), F.array_join("surfaces", "|").alias("surfaces"), F.array_join("other_isos", "|").alias("norms"))


@query("corpus", "drawings")
def w3_retrieval(corpus: DataFrame, drawings: DataFrame) -> DataFrame:
    """Text retrieval, its labelling tasks and precision@k by tag; a hit is right when its label is the prompt's."""
    nodes = corpus.select("drawing_id", F.col("search_vector").alias("llm_vector"))
    prompts = corpus.where("drawing_id % 20 = 0").select(F.col("drawing_id").cast("long").alias("prompt_id"), F.col("search_vector").alias("llm_vector"), F.col("label").cast("string").alias("tag"))
    truth = corpus.select("drawing_id", F.col("label").cast("string").alias("_truth"))

    def judge(tasks: DataFrame) -> DataFrame:
        return tasks.join(truth, "drawing_id").withColumn("label", F.when(F.col("_truth").eqNullSafe(F.col("tag")), "Both Relevant").otherwise("NOT Relevant"))

    return workloads.text_retrieval(prompts, nodes, drawings.select("drawing_id", "name"), judge, dim=64)
