"""The whole layout step against a plain version, blob by blob, over all pages of the smallest tables and over made pages with every case."""

import random
from collections import defaultdict

import numpy as np
import pytest

from sheetforge.operators import layout
from sheetforge.plans import domain, queries

SMALL = "/root/testdata/sf0.001"
RECT = "drawing_id int, rect_id int, x int, y int, w int, h int"
BOX = "drawing_id int, pos int, x int, y int, w int, h int, text string"


def centre(r):
    return r["x"] + r["w"] // 2, r["y"] + r["h"] // 2


def strictly(p, r):
    return r["x"] < p[0] < r["x"] + r["w"] and r["y"] < p[1] < r["y"] + r["h"]


def grown(p, r, g):
    return r["x"] - g <= p[0] < r["x"] + r["w"] + g and r["y"] - g <= p[1] < r["y"] + r["h"] + g


def same(a, b):
    return all(a[c] == b[c] for c in "xywh")


def reached(frame, rects):
    def touches(f, r):
        for x, y, w, h in ((f["x"], f["y"], f["w"], 0), (f["x"] + f["w"], f["y"], 0, f["h"]), (f["x"], f["y"] + f["h"], f["w"], 0), (f["x"], f["y"], 0, f["h"])):
            if r["x"] <= x + w + 10 and r["x"] + r["w"] >= x - 10 and r["y"] <= y + h + 10 and r["y"] + r["h"] >= y - 10:
                return True
        return False

    burnt, todo = set(), [frame]
    while todo:
        f = todo.pop()
        for i, r in enumerate(rects):
            if i not in burnt and touches(f, r):
                burnt.add(i)
                todo.append(r)
    return [rects[i] for i in sorted(burnt)]


def wordy(text):
    letters, digits = sum(c.isascii() and c.isalpha() for c in text), sum(c in "0123456789" for c in text)
    return letters > 0.5 * (letters + digits) if letters + digits else False


def merged(boxes):
    """Text of boxes in the order of pos: lines by mean y, words by x."""
    limit, lines = round(sum(b["h"] for b in boxes) / len(boxes)) // 2, []
    for b in boxes:
        y = centre(b)[1]
        near = [line for line in lines if abs(sum(centre(m)[1] for m in line) / len(line) - y) < limit]
        for line in near or [lines.append([]) or lines[-1]]:
            line.append(b)
    order = sorted(range(len(lines)), key=lambda i: (sum(centre(m)[1] for m in lines[i]) / len(lines[i]), i))
    return "\n".join(" ".join(b["text"] for b in sorted(lines[i], key=lambda b: (centre(b)[0], b["pos"], b["text"]))) for i in order)


def clusters(boxes):
    points = np.concatenate([layout.perimeter(*(b[c] for c in "xywh")) for b in boxes])
    labels = layout.density_clusters(points)
    first = {}
    for i, p in enumerate(map(tuple, points.tolist())):
        first.setdefault(p, i)
    own = [int(labels[first[b["x"], b["y"]]]) for b in boxes]
    free = iter(range(int(labels.max()) + 1, 10**6))
    return [next(free) if label == -1 else label for label in own]


def plain_page(boxes, rects, area):
    boxes = sorted(boxes, key=lambda b: b["pos"])
    fit = [r for r in rects if 0.33 * area < r["w"] * r["h"] < area]
    if not fit:
        return [(b["x"], b["y"], b["w"], b["h"], b["text"], wordy(b["text"]), "box") for b in boxes]
    frame = min(fit, key=lambda r: (r["w"] * r["h"], r["rect_id"]))
    burnt = reached(frame, rects)

    def region(r):
        p = centre(r)
        if any(c["w"] * c["h"] < frame["w"] * frame["h"] and grown(p, c, 5) for c in burnt):
            return "info"
        return "drawing" if grown(p, frame, -5) else "outside"

    cells = [r for i, r in enumerate(sorted(burnt, key=lambda r: r["rect_id"])) if not same(r, frame)]
    cells = [r for i, r in enumerate(cells) if not any(same(r, q) for q in cells[:i]) and region(r) == "info"]
    lost = set()
    for a in cells:
        for b in cells:
            if not same(a, b) and strictly(centre(a), b):
                lost.add(b["rect_id"] if a["w"] * a["h"] >= b["w"] * b["h"] else a["rect_id"])
    out = []
    for cell in (c for c in cells if c["rect_id"] not in lost):
        inside = [b for b in boxes if region(b) == "info" and strictly(centre(b), cell)]
        if inside:
            out.append((cell["x"], cell["y"], cell["w"], cell["h"], merged(inside), True, "cell"))
    drawn = [b for b in boxes if region(b) == "drawing"]
    words = [b for b in drawn if wordy(b["text"])]
    groups = defaultdict(list)
    for b, label in zip(words, clusters(words) if words else []):
        groups[label].append(b)
    for label in sorted(groups):
        g = groups[label]
        x, y = min(b["x"] for b in g), min(b["y"] for b in g)
        out.append((x, y, max(b["x"] + b["w"] for b in g) - x, max(b["y"] + b["h"] for b in g) - y, merged(g), True, "cluster"))
    return out + [(b["x"], b["y"], b["w"], b["h"], b["text"], False, "measure") for b in drawn if not wordy(b["text"])]


def by_page(rows):
    found = defaultdict(list)
    for r in rows:
        found[r["drawing_id"]].append(r)
    return found


def compare(out, boxes, rects, areas):
    got = by_page(out)
    boxes, rects = by_page(boxes), by_page(rects)
    kinds = defaultdict(int)
    for d, page in boxes.items():
        mine = sorted(got.get(d, []), key=lambda r: r["pos"])
        assert [r["pos"] for r in mine] == list(range(len(mine)))
        want = plain_page([r.asDict() for r in page], [r.asDict() for r in rects.get(d, [])], areas[d])
        assert [tuple(r[c] for c in ("x", "y", "w", "h", "text", "is_text", "kind")) for r in mine] == want, d
        for w in want:
            kinds[w[-1]] += 1
    assert set(got) <= set(boxes)
    return kinds


def test_all_pages(spark):
    boxes, rects, pages = (t.collect() for t in domain.tables(spark, SMALL, "boxes", "rects", "pages"))
    kinds = compare(queries.QUERIES["c16_merge_text"](spark, SMALL).collect(), boxes, rects, {r["drawing_id"]: r["image_area"] for r in pages})
    assert set(kinds) == {"cell", "cluster", "measure", "box"}


@pytest.mark.parametrize("seed", [1, 2])
def test_made_pages(spark, seed):
    r = random.Random(seed)
    rects, boxes, areas = [], [], []
    for d in range(30):
        areas.append((d, 1_000_000))
        if d % 10:
            rects.append((d, 0, 20, 20, 950, 900))
        for i in range(1, r.randint(2, 14)):
            rects.append((d, i, r.randrange(20, 900, 30), r.randrange(700, 900, 30), r.choice([30, 60, 200]), r.choice([30, 60])))
        texts = ["word", "Ra 3.2", "120", "12x4", "DIN 7", "a b", "é", ""]
        for i in range(r.randint(1, 25)):
            boxes.append((d, i, r.randrange(0, 950, 7), r.choice([r.randrange(0, 950, 7), r.randrange(700, 930, 5)]), r.randint(5, 60), r.randint(5, 20), r.choice(texts)))
    tables = spark.createDataFrame(boxes, BOX), spark.createDataFrame(rects, RECT), spark.createDataFrame(areas, "drawing_id int, image_area long")
    kinds = compare(layout.merge_text(*tables).collect(), tables[0].collect(), tables[1].collect(), dict(areas))
    assert min(kinds[k] for k in ("cell", "cluster", "measure", "box")) > 5
