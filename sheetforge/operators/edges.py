"""Density clusters of boxes by the pixels of their edges, without a row or an entry for each pair of pixels.

An edge is a segment; how many of its pixels lie within a distance of a pixel follows from two subtractions. Core pixels form intervals on
their edges, and two intervals are linked if they are near enough as rectangles. So a page costs its edges' lengths times the few edges near
each. Pages of many boxes are cut into tiles: each tile counts for its own pieces of edges, with those of a margin beside it, and gives its intervals and
links; components over all tiles make the clusters.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetforge.operators.components import connected_components
from sheetforge.operators.numbering import numbered
from sheetforge.scratch import dropped, stored

#: Side of a tile of a page of many boxes.
TILE = 1_024
_AT_ONCE = 2_000_000


def sides(boxes: np.ndarray) -> np.ndarray:
    """The four edges of boxes (x, y, w, h), as rows (x0, y0, x1, y1): top, bottom, right, left of each box in turn."""
    x, y, w, h = boxes.T
    return np.stack([np.stack([x, y, x + w, y], 1), np.stack([x, y + h, x + w, y + h], 1), np.stack([x + w, y, x + w, y + h], 1), np.stack([x, y, x, y + h], 1)], axis=1).reshape(-1, 4)


def near_pairs(a: np.ndarray, b: np.ndarray, eps: float, pages: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of pairs of rectangles (x0, y0, x1, y1) whose nearest points are at most ``eps`` apart. Rows of b are sorted by x, so only a band of them is looked at.

    ``pages``: the pages of both, whose order is that of x (see ``apart``); then only rows of one page are looked at.
    """
    if not len(a) or not len(b):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    order = np.argsort(b[:, 0], kind="stable")
    widest = int((b[:, 2] - b[:, 0]).max())
    starts = b[order, 0]
    first = np.searchsorted(starts, a[:, 0] - eps - widest)
    last = np.searchsorted(starts, a[:, 2] + eps, side="right")
    if pages is not None:
        first = np.maximum(first, np.searchsorted(pages[1][order], pages[0]))
        last = np.maximum(first, np.minimum(last, np.searchsorted(pages[1][order], pages[0], side="right")))
    left, right = [], []
    at = 0
    while at < len(a):
        sizes = np.cumsum(last[at:] - first[at:])
        many = max(1, int(np.searchsorted(sizes, _AT_ONCE, side="right")))
        some = np.arange(at, min(at + many, len(a)))
        n = last[some] - first[some]
        i = np.repeat(some, n)
        j = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[some], n)]
        dx = np.maximum(0, np.maximum(b[j, 0] - a[i, 2], a[i, 0] - b[j, 2]))
        dy = np.maximum(0, np.maximum(b[j, 1] - a[i, 3], a[i, 1] - b[j, 3]))
        met = dx * dx + dy * dy <= eps * eps
        left.append(i[met])
        right.append(j[met])
        at += many
    return np.concatenate(left), np.concatenate(right)


def apart(edges: np.ndarray, page: np.ndarray, eps: float) -> np.ndarray:
    """How far each edge moves along x so that pages, in whose order the edges come, stand side by side, more than ``eps`` from each other."""
    starts = np.flatnonzero(np.diff(page, prepend=-1))
    if not len(starts):
        return np.zeros(0, dtype=np.int64)
    low, high = np.minimum.reduceat(edges[:, 0], starts), np.maximum.reduceat(edges[:, 2], starts)
    width = high - low + int(np.ceil(eps)) + 1
    return np.repeat(np.cumsum(width) - width - low, np.diff(starts, append=len(page)))


def _halves(eps: float) -> np.ndarray:
    """Half the chord, in whole pixels, at each whole distance from a pixel; -1 beyond ``eps``."""
    return np.array([int(np.floor(np.sqrt(eps * eps - d * d) + 1e-9)) for d in range(int(np.floor(eps)) + 1)] + [-1])


def sure_edges(boxes: np.ndarray, eps: float, least: int) -> np.ndarray:
    """Which edges of boxes, in the order of ``sides``, have only core pixels by the pixels of their own box alone.

    A pixel's own edge counts least at its ends, an edge at a right angle where the pixel is farthest from it, the opposite edge at its ends.
    """
    reach, half = int(np.floor(eps)), _halves(eps)

    def enough(along: np.ndarray, across: np.ndarray) -> np.ndarray:
        own = np.minimum(along, reach) + 1
        beside = np.where(along <= reach, 2 * (np.minimum(across, half[np.minimum(along, reach)]) + 1), 0)
        opposite = np.where(across <= reach, np.minimum(along, half[np.minimum(across, reach)]) + 1, 0)
        return own + beside + opposite >= least

    level, upright = enough(boxes[:, 2], boxes[:, 3]), enough(boxes[:, 3], boxes[:, 2])
    return np.stack([level, level, upright, upright], axis=1).reshape(-1)


def pixel_counts(wanted: np.ndarray, edges: np.ndarray, eps: float, pages: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first pixel of each wanted edge, and the count of all; pixels of ``edges`` within ``eps`` of each pixel, repeats counted)."""
    length = (wanted[:, 2] - wanted[:, 0]) + (wanted[:, 3] - wanted[:, 1]) + 1
    first = np.concatenate([[0], np.cumsum(length)])
    counts = np.zeros(first[-1], dtype=np.int64)
    reach = int(np.floor(eps))
    half = _halves(eps)
    flat = edges[:, 1] == edges[:, 3]
    level = wanted[:, 1] == wanted[:, 3]
    i, j = near_pairs(wanted, edges, eps, pages)
    at = 0
    while at < len(i):
        many = max(1, int(np.searchsorted(np.cumsum(length[i[at:]]), _AT_ONCE, side="right")))
        a, b = i[at : at + many], j[at : at + many]
        at += many
        n = length[a]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        a, b = np.repeat(a, n), np.repeat(b, n)
        x = wanted[a, 0] + np.where(level[a], step, 0)
        y = wanted[a, 1] + np.where(level[a], 0, step)
        off = np.minimum(np.abs(np.where(flat[b], y - edges[b, 1], x - edges[b, 0])), reach + 1)
        along = np.where(flat[b], x, y)
        low, high = np.where(flat[b], edges[b, 0], edges[b, 1]), np.where(flat[b], edges[b, 2], edges[b, 3])
        here = np.minimum(along + half[off], high) - np.maximum(along - half[off], low) + 1
        counts += np.bincount(first[a] + step, weights=np.where(half[off] < 0, 0, np.maximum(here, 0)), minlength=len(counts)).astype(np.int64)
    return first, counts


def core_intervals(edges: np.ndarray, first: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edge, first pixel, rectangle) of each run of core pixels on an edge."""
    bound = np.zeros(len(core) + 1, dtype=bool)
    bound[first] = True
    begins = np.flatnonzero(core & (np.concatenate([[False], core[:-1]]) == 0) | core & bound[:-1])
    ends = np.flatnonzero(core & (np.concatenate([core[1:], [False]]) == 0) | core & bound[1:])
    edge = np.searchsorted(first, begins, side="right") - 1
    level = edges[edge, 1] == edges[edge, 3]
    a, b = begins - first[edge], ends - first[edge]
    x, y = edges[edge, 0], edges[edge, 1]
    return edge, begins, np.stack([x + np.where(level, a, 0), y + np.where(level, 0, a), x + np.where(level, b, 0), y + np.where(level, 0, b)], axis=1)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each node's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def box_clusters(boxes: np.ndarray, eps: float, least: int, page: np.ndarray | None = None) -> np.ndarray:
    """Label of the top left pixel of each box (x, y, w, h) under DBSCAN of all edge pixels; clusters in the order of their first core pixel, noise -1.

    A pixel that is no core but near some has the first of their clusters. ``page``: ascending numbers of the boxes' pages, clustered each for itself
    at once. Pixels are counted only for edges that their own box doesn't make core.
    """
    page = np.zeros(len(boxes), dtype=np.int64) if page is None else page
    edges, on = sides(boxes), np.repeat(page, 4)
    edges[:, [0, 2]] += apart(edges, on, eps)[:, None]
    sure = sure_edges(boxes, eps, least)
    doubtful = np.flatnonzero(~sure)
    first, counts = pixel_counts(edges[doubtful], edges, eps, (on[doubtful], on))
    edge, _, spans = core_intervals(edges[doubtful], first, counts >= least)
    edge, spans = np.concatenate([np.flatnonzero(sure), doubtful[edge]]), np.concatenate([edges[sure], spans])
    if not len(edge):
        return np.full(len(boxes), -1)
    order = np.argsort(edge, kind="stable")
    spans, at = spans[order], on[edge[order]]
    i, j = near_pairs(spans, spans, eps, (at, at))
    roots = _roots(len(spans), i[i < j], j[i < j])
    # intervals are in pixel order, so the least of a component has its first core pixel; numbers begin at 0 on each page
    least_of, number = np.unique(roots, return_inverse=True)
    number = number - np.searchsorted(at[least_of], at)
    labels = np.full(len(boxes), len(spans))
    box, near = near_pairs(edges[::4][:, [0, 1, 0, 1]], spans, eps, (page, at))
    # a core pixel is linked to no interval of another cluster, so the least number is its own
    np.minimum.at(labels, box, number[near])
    return np.where(labels < len(spans), labels, -1)


def tiled_box_clusters(boxes: DataFrame, pos: str, eps: int, least: int) -> DataFrame:
    """(drawing_id, pos, cluster) as ``box_clusters``, noise null, for drawings of many boxes: one task for each tile.

    Rows that repeat a pos each get theirs.
    """
    listed = stored(numbered(boxes.select("drawing_id", pos, "x", "y", "w", "h"), ["drawing_id", pos, "x", "y", "w", "h"], "n"), "boxes")
    x, y, x1, y1 = F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")
    each = F.array(*[F.struct(F.lit(s).alias("side"), a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1")) for s, (a, b, c, d) in enumerate([(x, y, x1, y), (x, y1, x1, y1), (x1, y, x1, y1), (x, y, x, y1)])])
    pieces = listed.select("drawing_id", "n", F.inline(each))
    for low, high, at in (("x0", "x1", "tx"), ("y0", "y1", "ty")):
        pieces = pieces.withColumn(at, F.explode(F.sequence(F.floor(F.col(low) / TILE), F.floor(F.col(high) / TILE))))
        pieces = pieces.withColumns({low: F.greatest(F.col(low).cast("long"), F.col(at) * TILE), high: F.least(F.col(high).cast("long"), (F.col(at) + 1) * TILE - 1)})
    # a tile sees its pieces, and those that can count for, or lie in, the margin in which it needs core pixels
    seen = pieces
    for low, high, at in (("x0", "x1", "sx"), ("y0", "y1", "sy")):
        seen = seen.withColumn(at, F.explode(F.sequence(F.floor((F.col(low) - 2 * eps) / TILE), F.floor((F.col(high) + 2 * eps) / TILE))))

    def tile(rows: pd.DataFrame) -> pd.DataFrame:
        sx, sy = int(rows["sx"].iloc[0]), int(rows["sy"].iloc[0])
        rows = rows.sort_values(["n", "side", "tx", "ty"]).reset_index(drop=True)
        own = ((rows["tx"] == sx) & (rows["ty"] == sy)).to_numpy()
        if not own.any():
            return pd.DataFrame({c: [] for c in _COLUMNS})
        edges = rows[["x0", "y0", "x1", "y1"]].to_numpy(dtype=np.int64)
        first, counts = pixel_counts(edges, edges, eps)
        line = np.repeat(np.arange(len(edges)), np.diff(first))
        step = np.arange(first[-1]) - first[line]
        level = edges[line, 1] == edges[line, 3]
        px, py = edges[line, 0] + np.where(level, step, 0), edges[line, 1] + np.where(level, 0, step)
        # counts are whole within eps of the tile
        whole = (px >= sx * TILE - eps) & (px < (sx + 1) * TILE + eps) & (py >= sy * TILE - eps) & (py < (sy + 1) * TILE + eps)
        core = (counts >= least) & whole
        edge, begins, spans = core_intervals(edges, first, core)
        keys = rows[["n", "side", "tx", "ty"]].to_numpy(dtype=np.int64)
        at = np.where(edges[edge, 1] == edges[edge, 3], spans[:, 0], spans[:, 1])
        to = np.where(edges[edge, 1] == edges[edge, 3], spans[:, 2], spans[:, 3])
        mine = own[edge]
        out = []

        def add(kind: int, left: np.ndarray, left_at: np.ndarray, right: np.ndarray, right_at: np.ndarray) -> None:
            out.append(np.concatenate([np.full((len(left), 1), kind), left, left_at[:, None], right, right_at[:, None]], axis=1))

        add(0, keys[edge[mine]], at[mine], keys[edge[mine]], to[mine])
        i, j = near_pairs(spans, spans, eps)
        linked = mine[i] & ((i < j) | ~mine[j])
        i, j = i[linked], j[linked]
        add(1, keys[edge[i]], at[i], keys[edge[j]], at[j])
        tops = np.flatnonzero(own & (keys[:, 1] == 0) & rows["begins"].to_numpy())
        corners = edges[tops][:, [0, 1, 0, 1]]
        i, j = near_pairs(corners, spans, eps)
        add(2, keys[tops[i]], np.zeros(len(i), dtype=np.int64), keys[edge[j]], at[j])
        table = pd.DataFrame(np.concatenate(out), columns=_COLUMNS[1:])
        table.insert(0, "drawing_id", rows["drawing_id"].iloc[0])
        return table

    schema = f"drawing_id {boxes.schema['drawing_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in _COLUMNS[1:])
    corner = listed.select("n", F.col("x").alias("_x"))
    dealt = seen.join(corner, "n").withColumn("begins", F.col("x0") == F.col("_x")).drop("_x")
    found = stored(dealt.groupBy("drawing_id", "sx", "sy").applyInPandas(tile, schema), "tiles")
    nodes = found.where("kind = 0").select("drawing_id", "n", "side", "tx", "ty", F.col("at").alias("low"), F.col("at2").alias("high"))
    nodes = stored(numbered(nodes, ["drawing_id", "n", "side", "tx", "ty", "low"], "node"), "nodes")

    def named(df: DataFrame, suffix: str, out: str) -> DataFrame:
        """``df`` with the node that the pixel of these columns belongs to."""
        refs = nodes.select(*[F.col(c).alias(c + suffix) for c in ("n", "side", "tx", "ty")], "low", "high", F.col("node").alias(out))
        return df.join(refs, [c + suffix for c in ("n", "side", "tx", "ty")]).where(f"at{suffix} between low and high").drop("low", "high")

    links = named(named(found.where("kind = 1"), "", "a"), "2", "b").select("a", "b")
    loops = nodes.select(F.col("node").alias("a"), F.col("node").alias("b"))
    joined = connected_components(links)
    root = loops.join(joined, F.col("a") == F.col("node"), "left").select(F.col("a").alias("node"), F.coalesce("component", "a").alias("root"))
    # nodes are numbered in pixel order but for the tiles of one edge, which go by x or y as pixels do: the root has the first core pixel
    roots = root.select("root").distinct().join(nodes.select(F.col("node").alias("root"), "drawing_id"), "root")
    ranks = roots.withColumn("cluster", (F.row_number().over(Window.partitionBy("drawing_id").orderBy("root")) - 1).cast("int"))
    near = named(found.where("kind = 2"), "2", "node").join(root, "node").join(ranks.select("root", "cluster"), "root").groupBy("n").agg(F.min("cluster").alias("cluster"))
    out = stored(listed.join(near, "n", "left").select("drawing_id", pos, "x", "y", "w", "h", "cluster"), "labels")
    dropped(listed, found, nodes)
    return out


_COLUMNS = ["drawing_id", "kind", "n", "side", "tx", "ty", "at", "n2", "side2", "tx2", "ty2", "at2"]
