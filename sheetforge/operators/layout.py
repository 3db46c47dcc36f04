"""Layout of scanned drawings: frames, cells, regions, text lines and clusters.

Everything is keyed by drawing; rectangles are rows (drawing_id, id, x, y, w, h). Joins carry the drawing as
equi-key with the inequalities behind it. Only order-dependent steps run as helpers on one drawing or cell at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetforge.operators import edges, tiles
from sheetforge.operators.components import connected_components
from sheetforge.operators.numbering import numbered
from sheetforge.scratch import stored

FRAME_SHARE, TOUCH, GROWN, EPS, MIN_POINTS = 0.33, 20, 5, 20, 20
#: Rows, or pairs of rows, that a task's helper works on together.
AT_ONCE = 50_000


def _grouped(df: DataFrame, group: list[str], columns: list[str], run, added: str, wanted: Column | None = None, power: int = 1) -> DataFrame:
    """(group, added columns) from ``run(page, rows)``, called for many groups at once.

    A group is a page, a cell or a cluster, so its few boxes travel as one list. ``rows`` is a record batch of the rows of some groups, each sorted by
    ``columns``, ``page`` the number of each row's group. ``run`` gives the numbers of the rows to return, repeats allowed, and the added columns of these.
    ``wanted``: a condition on the list ``_rows``. Groups are taken together up to ``AT_ONCE`` of the sum of their sizes to the ``power``.
    """

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch[len(group)]
            rows, sizes = pa.RecordBatch.from_struct_array(lists.flatten()), np.diff(lists.offsets.to_numpy()).astype(np.int64)
            ends, load = np.cumsum(sizes), np.cumsum(sizes**power)
            low = 0
            while low < len(sizes):
                done = load[low - 1] if low else 0
                high = max(low + 1, int(np.searchsorted(load, done + AT_ONCE, side="right")))
                begin = int(ends[low] - sizes[low])
                page = np.repeat(np.arange(low, high), sizes[low:high])
                at, found = run(page - low, rows.slice(begin, len(page)))
                keys = pa.array(page[at])
                yield pa.RecordBatch.from_arrays([*[batch[i].take(keys) for i in range(len(group))], *found], names=[*group, *names])
                low = high

    names = [part.split()[0] for part in added.split(", ")]
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in group) + ", " + added
    lists = df.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("_rows"))
    return (lists if wanted is None else lists.where(wanted)).mapInArrow(call, schema)


def _typed(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


def _whole(rows: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of whole numbers; a missing one is an error."""
    if rows[name].null_count:
        raise ValueError(f"a box without {name}")
    return rows[name].to_numpy(zero_copy_only=False).astype(np.int64)


def polygon_box(points: Column) -> Column:
    """struct(x, y, w, h) around an array of points."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("w"), (F.array_max(ys) - F.array_min(ys)).alias("h"))


def centre(prefix: str = "") -> tuple[Column, Column]:
    """Middle of a box, rounded down."""
    x, y, w, h = (F.col(f"{prefix}{c}") for c in "xywh")
    return x + F.floor(w / 2).cast("int"), y + F.floor(h / 2).cast("int")


def inner_frames(rects: DataFrame, pages: DataFrame, min_ratio: float = FRAME_SHARE) -> DataFrame:
    """(drawing_id, rect_id, x, y, w, h): smallest rectangle of more than ``min_ratio`` of the page and less than all of it."""
    area = F.col("w").cast("long") * F.col("h")
    fit = rects.join(pages.select("drawing_id", "image_area"), "drawing_id").where((area > min_ratio * F.col("image_area")) & (area < F.col("image_area")))
    return fit.groupBy("drawing_id").agg(F.min_by(F.struct("rect_id", "x", "y", "w", "h"), F.struct(area, "rect_id")).alias("f")).select("drawing_id", "f.*")


def _touched(fx: np.ndarray, fy: np.ndarray, fw: np.ndarray, fh: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, dist: float) -> np.ndarray:
    """Which rectangles touch one of the four edges, thickened by ``dist``, of the rectangle beside them (f)."""
    near, half = np.zeros(len(x), dtype=bool), dist / 2
    for ex, ey, ew, eh in ((fx, fy, fw, 0.0), (fx + fw, fy, 0.0, fh), (fx, fy + fh, fw, 0.0), (fx, fy, 0.0, fh)):
        near |= (x <= ex + ew + half) & (x + w >= ex - half) & (y <= ey + eh + half) & (y + h >= ey - half)
    return near


def reachable_cells(rects: DataFrame, frames: DataFrame, dist: int = TOUCH, checked: bool = False) -> DataFrame:
    """Rectangles reachable from the frame by steps to any that touches one of the four edges thickened by ``dist``.

    A search through each drawing's rectangles, which are a page's cells and so few; drawings of many go through ``_reached_by_rounds``.
    """

    def spread(page: np.ndarray, rows: pa.RecordBatch) -> tuple[np.ndarray, list[pa.Array]]:
        frame = rows["_frame"].to_numpy(zero_copy_only=False)
        x, y, w, h = (rows[c].to_numpy(zero_copy_only=False).astype(np.float64) for c in "xywh")
        size = np.bincount(page, minlength=1)
        start = np.cumsum(size) - size
        burnt, fresh = np.zeros(len(page), dtype=bool), np.flatnonzero(frame)
        while len(fresh):
            n = size[page[fresh]]
            a = np.repeat(fresh, n)
            b = np.arange(len(a)) + np.repeat(start[page[fresh]] - np.cumsum(n) + n, n)
            open_ = ~(frame[b] | burnt[b])
            a, b = a[open_], b[open_]
            fresh = np.unique(b[_touched(x[a], y[a], w[a], h[a], x[b], y[b], w[b], h[b], dist)])
            burnt[fresh] = True
        at = np.flatnonzero(burnt)
        return at, [rows[c].take(pa.array(at)) for c in names]

    names = ["rect_id", "x", "y", "w", "h"]
    large = _large(rects, checked)
    few, many = _divided(rects, large)
    both = few.select("drawing_id", *names, F.lit(False).alias("_frame")).unionByName(frames.select("drawing_id", *names, F.lit(True).alias("_frame")))
    out = _grouped(both, ["drawing_id"], [*names, "_frame"], spread, _typed(rects, names), wanted=F.exists("_rows", lambda r: r["_frame"]), power=2)
    return out if large is None else out.unionByName(_reached_by_rounds(many.select("drawing_id", *names), frames, dist))


def _reached_by_rounds(rects: DataFrame, frames: DataFrame, dist: int) -> DataFrame:
    """``reachable_cells`` of drawings of many rectangles: a table of touches, met by tiles, and rounds that go from the newly reached ones.

    Rectangles within one tile that reach each other are a hop of one round: groups in which all steps go both ways are joined
    beforehand, so a chain of cells takes few rounds whatever its length.
    """
    half = dist / 2
    listed = stored(numbered(rects.withColumn("_frame", F.lit(False)).unionByName(frames.join(rects.select("drawing_id").distinct(), "drawing_id", "left_semi").select(*rects.columns, F.lit(True).alias("_frame"))), ["drawing_id", "rect_id", "x", "y", "w", "h", "_frame"], "_n"), "listed")
    met = tiles.boxes_near_boxes(listed.select("drawing_id", "_n", *"xywh"), half)
    a, b = ({c: F.col(f"{side}{c}").cast("double") for c in "xywh"} for side in ("a_", "b_"))

    def touches(f: dict, r: dict) -> Column:
        """Whether r touches an edge of f."""
        edges_ = ((f["x"], f["y"], f["w"], F.lit(0.0)), (f["x"] + f["w"], f["y"], F.lit(0.0), f["h"]), (f["x"], f["y"] + f["h"], f["w"], F.lit(0.0)), (f["x"], f["y"], F.lit(0.0), f["h"]))
        hits = [(r["x"] <= ex + ew + half) & (r["x"] + r["w"] >= ex - half) & (r["y"] <= ey + eh + half) & (r["y"] + r["h"] >= ey - half) for ex, ey, ew, eh in edges_]
        return hits[0] | hits[1] | hits[2] | hits[3]

    steps = stored(met.select(F.col("a__n").alias("a"), F.col("b__n").alias("b"), touches(a, b).alias("out"), touches(b, a).alias("back")).where("out or back"), "steps")
    groups = connected_components(steps.where("out and back").select("a", "b"))
    group = stored(listed.select("_n").join(groups, F.col("_n") == F.col("node"), "left").select("_n", F.coalesce("component", "_n").alias("g")), "group")

    def of(df: DataFrame, column: str, out: str) -> DataFrame:
        return df.join(group.select(F.col("_n").alias(column), F.col("g").alias(out)), column)

    one_way = steps.select(F.explode(F.array(F.when(F.col("out"), F.struct("a", "b")), F.when(F.col("back"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).alias("s")).where("s is not null").select("s.a", "s.b")
    hops = stored(of(of(one_way, "a", "ga"), "b", "gb").where("ga <> gb").select("ga", "gb").distinct(), "hops")
    start = of(listed.where("_frame").select(F.col("_n").alias("a")), "a", "g").select("g").distinct()
    reached = fresh = stored(start, "reached")
    while not fresh.isEmpty():
        found = hops.join(fresh.select(F.col("g").alias("ga")), "ga").select(F.col("gb").alias("g")).distinct()
        fresh = stored(found.join(reached, "g", "left_anti"), "fresh")
        reached = stored(reached.unionByName(fresh), "reached")
    # a frame's own group is reached where any step leads into it; what only starts there is the frame itself
    return _into(listed, group, reached, one_way, rects.columns)


def _into(listed: DataFrame, group: DataFrame, reached: DataFrame, one_way: DataFrame, columns: list[str]) -> DataFrame:
    """Rectangles, but frames, of reached groups that a step from a reached one leads to."""
    inside = group.join(reached, "g").select("_n")
    entered = one_way.join(inside.select(F.col("_n").alias("a")), "a").select(F.col("b").alias("_n")).distinct()
    return listed.where("not _frame").join(entered, "_n", "left_semi").select(*columns)


def rotate_rects(rects: DataFrame, rotation: str = "rotation", width: str = "image_w", height: str = "image_h") -> DataFrame:
    """Rectangles turned with their page by 0, 90, 180 or 270 degrees; other angles leave them."""
    x, y, w, h, r = (F.col(c) for c in ("x", "y", "w", "h", rotation))
    iw, ih = F.col(width), F.col(height)
    return rects.withColumns(
        {
            "x": F.when(r == 90, y).when(r == 180, iw - x - w).when(r == 270, ih - y - h).otherwise(x),
            "y": F.when(r == 90, iw - x - w).when(r == 180, ih - y - h).when(r == 270, x).otherwise(y),
            "w": F.when(r.isin(90, 270), h).otherwise(w),
            "h": F.when(r.isin(90, 270), w).otherwise(h),
        }
    )


def dominant_angle(angles: DataFrame, key: str = "drawing_id", pos: str = "pos", angle: str = "angle", applied: str = "applied") -> DataFrame:
    """(drawing_id, angle): most frequent angle less the rotation applied, modulo 360; the first seen wins ties."""
    turned = angles.where(F.col(angle).isNotNull()).withColumn("_a", F.pmod(F.col(angle) - F.col(applied), F.lit(360)))
    counted = turned.groupBy(key, "_a").agg(F.count("*").alias("_n"), F.min(pos).alias("_first"))
    return counted.groupBy(key).agg(F.min_by("_a", F.struct(-F.col("_n"), "_first")).alias("angle"))


def _in_grown(x: Column, y: Column, box: Column, grown: int) -> Column:
    return (x >= box["x"] - grown) & (x < box["x"] + box["w"] + grown) & (y >= box["y"] - grown) & (y < box["y"] + box["h"] + grown)


def _size(box: Column) -> Column:
    return box["w"].cast("long") * box["h"]


def _large(boxes: DataFrame, checked: bool) -> DataFrame | None:
    """Drawings of many boxes; none where the caller has ``checked`` that there are none."""
    return None if checked else tiles.large_drawings(boxes)


def _divided(df: DataFrame, large: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the ordinary drawings, and those of the large ones."""
    if large is None:
        return df, None
    return df.join(large, "drawing_id", "left_anti"), df.join(large, "drawing_id", "left_semi")


def box_regions(boxes: DataFrame, cells: DataFrame, frames: DataFrame, box_id: str = "pos", grown: int = GROWN, checked: bool = False) -> DataFrame:
    """``boxes`` plus region: info (centre in a cell, smaller than the frame, grown by ``grown``), drawing (in the shrunk frame), outside.

    A drawing's cells are gathered once and looked through in the row; drawings of many cells go through tiles, by ``box_id``.
    """
    cx, cy = centre()
    frame = frames.select("drawing_id", F.struct("x", "y", "w", "h").alias("_frame"))
    in_frame = _in_grown(cx, cy, F.col("_frame"), -grown)
    large = _large(cells, checked)
    few_boxes, many_boxes = _divided(boxes, large)
    few_cells, many_cells = _divided(cells, large)
    gathered = few_cells.groupBy("drawing_id").agg(F.collect_list(F.struct("x", "y", "w", "h")).alias("_cells"))
    met = few_boxes.join(frame.join(gathered, "drawing_id", "left"), "drawing_id", "left")
    info = F.exists("_cells", lambda c: (_size(c) < _size(F.col("_frame"))) & _in_grown(cx, cy, c, grown))

    def named(df: DataFrame, info: Column) -> DataFrame:
        return df.withColumn("region", F.when(info, "info").when(in_frame, "drawing").otherwise("outside")).select(*boxes.columns, "region")

    out = named(met, info)
    if large is None:
        return out
    corners = {"_x0": F.col("x") - grown, "_y0": F.col("y") - grown, "_x1": F.col("x") + F.col("w") + grown, "_y1": F.col("y") + F.col("h") + grown}
    grow = many_cells.join(frame, "drawing_id").where(F.col("w").cast("long") * F.col("h") < _size(F.col("_frame"))).select("drawing_id", *[v.alias(k) for k, v in corners.items()])
    points = many_boxes.select("drawing_id", box_id, cx.alias("_cx"), cy.alias("_cy"))
    inside = (F.col("_cx") >= F.col("_x0")) & (F.col("_cx") < F.col("_x1")) & (F.col("_cy") >= F.col("_y0")) & (F.col("_cy") < F.col("_y1"))
    hits = tiles.points_in_boxes(points, grow, "_cx", "_cy", ("_x0", "_y0"), ("_x1", "_y1"), inside).select("drawing_id", box_id).distinct().withColumn("_info", F.lit(True))
    return out.unionByName(named(many_boxes.join(frame, "drawing_id", "left").join(hits, ["drawing_id", box_id], "left"), F.col("_info")))


def distinct_rects(rects: DataFrame) -> DataFrame:
    """Rectangles without repeats, the first kept."""
    return rects.groupBy("drawing_id", "x", "y", "w", "h").agg(F.min("rect_id").alias("rect_id")).select("drawing_id", "rect_id", "x", "y", "w", "h")


def without_frame(rects: DataFrame, frames: DataFrame) -> DataFrame:
    """Rectangles but the frame itself."""
    own = F.struct("x", "y", "w", "h")
    gathered = frames.groupBy("drawing_id").agg(F.collect_list(own).alias("_frames"))
    same = F.exists("_frames", lambda f: (f["x"] == F.col("x")) & (f["y"] == F.col("y")) & (f["w"] == F.col("w")) & (f["h"] == F.col("h")))
    return rects.join(gathered, "drawing_id", "left").where(~F.coalesce(same, F.lit(False))).select("drawing_id", "rect_id", "x", "y", "w", "h")


def _strictly_in(cx: Column, cy: Column, p: str) -> Column:
    x, y, w, h = (F.col(f"{p}{c}") for c in "xywh")
    return (cx > x) & (cx < x + w) & (cy > y) & (cy < y + h)


def _centre_in(a: Column, b: Column) -> Column:
    """Whether the middle of box a lies strictly in box b."""
    cx, cy = a["x"] + F.floor(a["w"] / 2), a["y"] + F.floor(a["h"] / 2)
    return (cx > b["x"]) & (cx < b["x"] + b["w"]) & (cy > b["y"]) & (cy < b["y"] + b["h"])


def without_nested(rects: DataFrame, checked: bool = False) -> DataFrame:
    """Rectangles without those that lose to another: of a pair where one's centre lies strictly inside the other, the smaller goes.

    Of equal sizes the one around goes, so two that hold each other's centres both go. A drawing's rectangles are gathered once; those of
    drawings of many meet by tiles.
    """
    large = _large(rects, checked)
    few, many = _divided(rects, large)
    rows = few.groupBy("drawing_id").agg(F.collect_list(F.struct(*[c for c in rects.columns if c != "drawing_id"])).alias("_rows"))

    def differ(a: Column, b: Column) -> Column:
        return (a["x"] != b["x"]) | (a["y"] != b["y"]) | (a["w"] != b["w"]) | (a["h"] != b["h"])

    def loses(a: Column) -> Column:
        return F.exists("_rows", lambda b: differ(a, b) & (_centre_in(a, b) & (_size(a) < _size(b)) | _centre_in(b, a) & (_size(b) >= _size(a))))

    lost = rows.withColumn("_lost", F.transform(F.filter("_rows", loses), lambda r: r["rect_id"]))
    kept = lost.select("drawing_id", F.inline(F.filter("_rows", lambda r: ~F.array_contains("_lost", r["rect_id"])))).select(*rects.columns)
    if large is None:
        return kept
    pairs = _strictly_met(_named(many, "a_"), many, "a_")
    larger = F.col("a_w").cast("long") * F.col("a_h") >= F.col("c_w").cast("long") * F.col("c_h")
    uneven = F.struct("a_x", "a_y", "a_w", "a_h") != F.struct("c_x", "c_y", "c_w", "c_h")
    losers = pairs.where(uneven).select("drawing_id", F.when(larger, F.col("c_rect_id")).otherwise(F.col("a_rect_id")).alias("rect_id")).distinct()
    return kept.unionByName(many.join(losers, ["drawing_id", "rect_id"], "left_anti").select(*rects.columns))


def _named(rects: DataFrame, prefix: str) -> DataFrame:
    return rects.select("drawing_id", *[F.col(c).alias(prefix + c) for c in ("rect_id", "x", "y", "w", "h")])


def _strictly_met(boxes: DataFrame, cells: DataFrame, prefix: str = "") -> DataFrame:
    """Pairs of boxes (columns with ``prefix``) and cells (columns with c_) of large drawings, the box's centre strictly in the cell."""
    cx, cy = centre(prefix)
    points = boxes.withColumns({"_cx": cx, "_cy": cy})
    named = _named(cells, "c_").withColumns({"_x1": F.col("c_x") + F.col("c_w"), "_y1": F.col("c_y") + F.col("c_h")})
    return tiles.points_in_boxes(points, named, "_cx", "_cy", ("c_x", "c_y"), ("_x1", "_y1"), _strictly_in(F.col("_cx"), F.col("_cy"), "c_"))


def assign_cells(boxes: DataFrame, cells: DataFrame, box_id: str = "pos", carry: tuple[str, ...] = (), checked: bool = False) -> DataFrame:
    """(drawing_id, rect_id, box columns): boxes whose centre lies strictly in a cell; one row per cell. Drawings of many cells go through tiles.

    ``carry``: columns of the cell to add, with c_ before their names.
    """
    cx, cy = centre()
    large = _large(cells, checked)
    few_boxes, many_boxes = _divided(boxes, large)
    few_cells, many_cells = _divided(cells, large)
    met = few_boxes.withColumns({"_cx": cx, "_cy": cy}).join(_named(few_cells, "c_"), "drawing_id").where(_strictly_in(F.col("_cx"), F.col("_cy"), "c_"))
    columns = ["drawing_id", F.col("c_rect_id").alias("rect_id"), *[c for c in boxes.columns if c != "drawing_id"], *carry]
    if large is None:
        return met.select(*columns)
    return met.select(*columns).unionByName(_strictly_met(many_boxes, many_cells).select(*columns))


def line_rows(ys: list[int], avg_height: int) -> list[list[int]]:
    """Rows of positions: a box joins every row whose mean y is closer than half the average height, else starts one.

    Means are those before the box is placed.
    """
    rows: list[list[int]] = []
    sums: list[int] = []
    for i, y in enumerate(ys):
        near = [r for r in range(len(rows)) if abs(sums[r] / len(rows[r]) - y) < avg_height // 2]
        for r in near:
            rows[r].append(i)
            sums[r] += y
        if not near:
            rows.append([i])
            sums.append(y)
    return rows


def line_groups(boxes: DataFrame, group: list[str], pos: str = "pos", carry: tuple[str, ...] = ()) -> DataFrame:
    """(group, pos, line, carried columns): lines of the boxes of a cell or cluster, taken in the order of ``pos``; a box can be in two."""

    def lines(page: np.ndarray, rows: pa.RecordBatch) -> tuple[np.ndarray, list[pa.Array]]:
        heights = _whole(rows, "h")
        middles, heights = (_whole(rows, "y") + heights // 2).tolist(), heights.tolist()
        at: list[int] = []
        numbers: list[int] = []
        ends = np.cumsum(np.bincount(page)).tolist()
        for begin, end in zip([0, *ends], ends, strict=False):
            if end - begin == 1:
                at.append(begin)
                numbers.append(0)
                continue
            for line, members in enumerate(line_rows(middles[begin:end], round(sum(heights[begin:end]) / (end - begin)))):
                at += [begin + i for i in members]
                numbers += [line] * len(members)
        own = pa.array(at, pa.int64())
        return np.array(at, dtype=np.int64), [rows[pos].take(own), pa.array(numbers, pa.int32()), *[rows[c].take(own) for c in carry]]

    added = f"{_typed(boxes, [pos])}, line int" + (f", {_typed(boxes, list(carry))}" if carry else "")
    return _grouped(boxes.select(*group, pos, "y", "h", *carry), group, [pos, "y", "h", *carry], lines, added)


def merged_text(boxes: DataFrame, lines: DataFrame, group: list[str], pos: str = "pos") -> DataFrame:
    """(group, text): lines by mean y, words by x; words joined by blanks, lines by line feeds. Ties keep the order."""
    cx, cy = centre()
    return _read(boxes.withColumns({"_cx": cx, "_cy": cy}).select(*group, pos, "_cx", "_cy", "text").join(lines, [*group, pos]), group, pos, {})


def _read(words: DataFrame, group: list[str], pos: str, extremes: dict[str, tuple]) -> DataFrame:
    """(group, text, extremes) of words with their lines and middles. ``extremes``: column -> (F.min or F.max, name)."""
    order = F.sort_array(F.collect_list(F.struct("_cx", pos, "text")))
    ends = [f(c).alias(n) for c, (f, n) in extremes.items()]
    each = words.groupBy(*group, "line").agg(F.array_join(F.transform(order, lambda x: x["text"]), " ").alias("_t"), F.avg("_cy").alias("_y"), *ends)
    whole = F.sort_array(F.collect_list(F.struct("_y", "line", "_t")))
    return each.groupBy(*group).agg(F.array_join(F.transform(whole, lambda x: x["_t"]), "\n").alias("text"), *[f(n).alias(n) for f, n in extremes.values()])


def _framed_text(boxes: DataFrame, group: list[str], frame: tuple[str, ...]) -> DataFrame:
    """(group, text, x, y, w, h): the text of the boxes of each group and what lies around the rectangles ``frame``.

    Boxes carry all that is needed through the lines, so nothing is joined back; one exchange by drawing serves both groupings behind them.
    """
    cx, cy = centre()
    x, y, w, h = (F.col(c) for c in frame)
    ready = boxes.withColumns({"_cx": cx, "_cy": cy, "_x0": x, "_y0": y, "_x1": x + w, "_y1": y + h})
    lined = line_groups(ready, group, carry=("_cx", "_cy", "text", "_x0", "_y0", "_x1", "_y1")).repartition("drawing_id")
    read = _read(lined, group, "pos", {"_x0": (F.min, "x"), "_y0": (F.min, "y"), "_x1": (F.max, "_right"), "_y1": (F.max, "_bottom")})
    return read.withColumns({"w": F.col("_right") - F.col("x"), "h": F.col("_bottom") - F.col("y")}).drop("_right", "_bottom")


def letter_share(text: Column) -> Column:
    """ASCII letters by letters and digits; 0 when there are none."""
    letters, digits = F.length(F.regexp_replace(text, "[^A-Za-z]", "")), F.length(F.regexp_replace(text, "[^0-9]", ""))
    return F.when(letters + digits == 0, F.lit(0.0)).otherwise(letters / F.nullif(letters + digits, F.lit(0)))


def perimeter(x: int, y: int, w: int, h: int) -> np.ndarray:
    """Pixels of the four edges of a box: top, bottom, right, left; corners come twice."""
    across, down = np.arange(w + 1), np.arange(h + 1)
    return np.concatenate(
        [np.stack([x + across, np.full(w + 1, y)], 1), np.stack([x + across, np.full(w + 1, y + h)], 1), np.stack([np.full(h + 1, x + w), y + down], 1), np.stack([np.full(h + 1, x), y + down], 1)]
    )


def _few_clusters(points: np.ndarray, eps: float, least: int) -> np.ndarray:
    x, y = points[:, 0], points[:, 1]
    near = (x[:, None] - x) ** 2 + (y[:, None] - y) ** 2 <= eps * eps
    core = near.sum(1) >= least
    labels, now = np.full(len(points), -1), 0
    for i in np.flatnonzero(core):
        if labels[i] != -1:
            continue
        labels[i] = now
        front = np.array([i])
        while len(front):
            fresh = np.flatnonzero(near[front].any(0) & (labels == -1))
            labels[fresh] = now
            front = fresh[core[fresh]]
        now += 1
    return labels


def density_clusters(points: np.ndarray, eps: float = EPS, least: int = MIN_POINTS) -> np.ndarray:
    """DBSCAN labels of integer points, repeats counted; clusters in the order of their first core point, noise -1.

    Few points are compared all with all; more lie in a grid of cells of ``eps``, and neighbours are looked up in the nine
    cells around.
    """
    if len(points) <= 1_500:
        return _few_clusters(points, eps, least)
    size = int(np.ceil(eps))
    grid: dict[tuple[int, int], list[int]] = {}
    for i, (x, y) in enumerate(points // size):
        grid.setdefault((int(x), int(y)), []).append(i)
    cells = {c: np.array(v) for c, v in grid.items()}

    def around(i: int) -> np.ndarray:
        cx, cy = (int(v) for v in points[i] // size)
        near = np.concatenate([cells[c] for c in ((cx + a, cy + b) for a in (-1, 0, 1) for b in (-1, 0, 1)) if c in cells])
        gap = points[near] - points[i]
        return near[(gap * gap).sum(1) <= eps * eps]

    labels, now = np.full(len(points), -1), 0
    core: dict[int, np.ndarray | None] = {}

    def neighbours(i: int) -> np.ndarray | None:
        if i not in core:
            found = around(i)
            core[i] = found if len(found) >= least else None
        return core[i]

    for i in range(len(points)):
        if labels[i] != -1 or neighbours(i) is None:
            continue
        labels[i] = now
        todo = [i]
        while todo:
            j = todo.pop()
            found = neighbours(j)
            if found is None:
                continue
            fresh = found[labels[found] == -1]
            labels[fresh] = now
            todo.extend(fresh.tolist())
        now += 1
    return labels


def text_clusters(boxes: DataFrame, pos: str = "pos", carry: tuple[str, ...] = ()) -> DataFrame:
    """(drawing_id, pos, cluster, carried columns): clusters of the text boxes of a drawing by the pixels of their edges.

    A box has the label of its top left pixel. A box that is noise becomes a cluster of its own, numbered behind
    the others. Drawings of many boxes are clustered by tiles.
    """

    def cluster(page: np.ndarray, rows: pa.RecordBatch) -> tuple[np.ndarray, list[pa.Array]]:
        own = edges.box_clusters(np.stack([_whole(rows, c) for c in "xywh"], axis=1), EPS, MIN_POINTS, page)
        most = np.full(len(page), -1)
        np.maximum.at(most, page, own)
        noise = own == -1
        rank = np.cumsum(noise)
        before = rank[np.searchsorted(page, page)] - noise[np.searchsorted(page, page)]
        return np.arange(len(page)), [rows[pos], pa.array(np.where(noise, most[page] + rank - before, own), pa.int32()), *[rows[c] for c in carry]]

    columns = list(dict.fromkeys([pos, "x", "y", "w", "h", *carry]))
    slim = boxes.select("drawing_id", *columns)
    large = tiles.large_drawings(slim)
    few, many = _divided(slim, large)
    out = _grouped(few, ["drawing_id"], columns, cluster, f"{_typed(boxes, [pos])}, cluster int" + (f", {_typed(boxes, list(carry))}" if carry else ""))
    if large is None:
        return out
    found = edges.tiled_box_clusters(many, pos, EPS, MIN_POINTS)
    most = F.coalesce(F.max("cluster").over(Window.partitionBy("drawing_id")), F.lit(-1))
    behind = F.row_number().over(Window.partitionBy("drawing_id", F.col("cluster").isNull()).orderBy(pos, "x", "y", "w", "h"))
    named = found.select("drawing_id", pos, F.coalesce("cluster", most + behind).cast("int").alias("cluster"))
    return out.unionByName(named.join(many.select("drawing_id", pos, *carry), ["drawing_id", pos]) if carry else named)


def outer_boxes(boxes: DataFrame, group: list[str]) -> DataFrame:
    """(group, x, y, w, h) around the boxes of each group."""
    right, bottom = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    return boxes.groupBy(*group).agg(F.min("x").alias("x"), F.min("y").alias("y"), (right - F.min("x")).alias("w"), (bottom - F.min("y")).alias("h"))


def merge_text(boxes: DataFrame, rects: DataFrame, pages: DataFrame) -> DataFrame:
    """(drawing_id, pos, x, y, w, h, text, is_text, kind): text blobs of drawings.

    Cells of the info block, text clusters and single measures of the drawing region; of pages without a frame the
    boxes as they are. Empty cells give no row; boxes elsewhere are dropped. pos numbers the blobs of a drawing from 0: cells by
    rectangle, then clusters by number, then measures, or boxes, by their place.
    """
    frames = stored(inner_frames(rects, pages), "frames")
    ordinary = tiles.large_drawings(rects) is None
    burnt = stored(reachable_cells(rects, frames, checked=ordinary), "cells")
    placed = stored(box_regions(boxes, burnt, frames, checked=ordinary), "regions")
    # dealt by drawing once: what follows groups and joins by drawing
    cells = without_frame(distinct_rects(burnt.repartition("drawing_id")), frames)
    cells = stored(without_nested(box_regions(cells, burnt, frames, "rect_id", checked=ordinary).where("region = 'info'").drop("region"), checked=ordinary), "info")

    def blobs(df: DataFrame, step: int, at: str, text_like: Column, kind: str) -> DataFrame:
        return df.select("drawing_id", F.lit(step).alias("_step"), F.col(at).cast("long").alias("_at"), *"xywh", "text", text_like.alias("is_text"), F.lit(kind).alias("kind"))

    box = ("c_x", "c_y", "c_w", "c_h")
    in_cells = assign_cells(placed.where("region = 'info'").drop("region"), cells, carry=box, checked=ordinary)
    from_cells = blobs(_framed_text(in_cells, ["drawing_id", "rect_id"], box), 0, "rect_id", F.lit(True), "cell")

    drawn = placed.where("region = 'drawing'").drop("region")
    is_text = letter_share(F.col("text")) > 0.5
    clustered = text_clusters(drawn.where(is_text), carry=("x", "y", "w", "h", "text"))
    from_clusters = blobs(_framed_text(clustered, ["drawing_id", "cluster"], ("x", "y", "w", "h")), 1, "cluster", F.lit(True), "cluster")
    measures = blobs(drawn.where(~is_text), 2, "pos", F.lit(False), "measure")
    # without a frame every box is outside
    loose = blobs(placed.where("region = 'outside'").join(frames.select("drawing_id"), "drawing_id", "left_anti"), 3, "pos", is_text, "box")
    order = Window.partitionBy("drawing_id").orderBy("_step", "_at")
    every = from_cells.unionByName(from_clusters).unionByName(measures).unionByName(loose)
    return every.select("drawing_id", (F.row_number().over(order) - 1).alias("pos"), *"xywh", "text", "is_text", "kind")


def ordered_views(views: DataFrame, key: str = "drawing_id", idx: str = "idx") -> DataFrame:
    """Views of a drawing numbered by falling area, later ones first on ties."""
    order = Window.partitionBy(key).orderBy((F.col("w").cast("long") * F.col("h")).desc(), F.col(idx).desc())
    return views.withColumn("view_pos", F.row_number().over(order) - 1)


def page_orientation(rects: DataFrame, most: int = 1000) -> DataFrame:
    """(drawing_id, horizontal): whether lying rectangles are at least as many as the others, big ones aside."""
    usable = rects.where(~((F.col("w") > most) & (F.col("h") > most)))
    lying = F.count_if(F.col("w") > F.col("h"))
    return usable.groupBy("drawing_id").agg((lying >= F.count("*") - lying).alias("horizontal"))
