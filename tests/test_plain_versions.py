"""Registered queries without SQL against plain versions over all rows of the smallest tables."""

import re
from collections import defaultdict

import numpy as np

from sheetforge.operators import fuzzy, layout
from sheetforge.plans import domain, queries
from test_fuzzy import plain_ratio
from test_layout import plain_clusters

SMALL = "/root/testdata/sf0.001"
_known: dict[tuple[str, str], float] = {}


def ratio(a, b):
    if (a, b) not in _known:
        _known[a, b] = plain_ratio(a, b)
    return _known[a, b]


def run(spark, name):
    return queries.QUERIES[name](spark, SMALL).collect()


def table(spark, name):
    return domain.tables(spark, SMALL, name)[0].collect()


def any_match(text, words):
    return len(text) >= 5 and any(ratio(w.lower(), text.lower()) >= 85 for w in words)


def plain_tolerance(text):
    spelled = [i for i, w in enumerate(fuzzy.TOLERANCE_NAMES) if len(text) >= 5 and ratio(w, text.lower()) >= 85]
    if spelled:
        return "fmcv"[spelled[-1] % 4] + "-"
    for norm, known in fuzzy.TOLERANCE_LETTERS.items():
        if norm in text:
            letters = re.findall("[A-Za-z]", text[text.index(norm) + 4 :])[:2] + ["$", "$"]
            return "".join(c if c.lower() in k else "-" for c, k in zip(letters, known))
        assert len(text) < 4 or ratio(norm, text) <= 80, text  # near misses don't occur in these tables
    return "--"


def test_materials_and_tolerances(spark):
    names = defaultdict(list)
    for r in queries._materials(domain.tables(spark, SMALL, "part")[0]).orderBy("class_id", "pos", "name").collect():
        names[r["class_id"]].append(r["name"])
    groups = list(names.values())
    gate = fuzzy.MATERIAL_WORDS + [n for g in groups for n in g]
    texts = {(r["drawing_id"], r["pos"]): r["text"] for r in table(spark, "blobs")}
    got = run(spark, "d8_materials_and_tolerances")
    assert len(got) == len(texts)
    seen = {}
    for r in got:
        text = texts[r["drawing_id"], r["pos"]]
        if text not in seen:
            tolerance = plain_tolerance(text) if any_match(text, fuzzy.TOLERANCE_WORDS) else ""
            best, material = 85, ""
            if any_match(text, gate):
                for n in (n for g in groups for n in g):
                    if (s := ratio(n, text)) > best:
                        best, material = s, n
            seen[text] = (material, tolerance)
        assert (r["material"], r["general_tolerances"]) == seen[text], text
    assert any(t for _, t in seen.values())


def test_fuzzy_list_matches(spark):
    rows = {r["o"]: (r["truth"], r["found"]) for r in queries._pairs(domain.tables(spark, SMALL, "lines")[0], "Ra 3.").collect()}

    def greedy(truth, found, cutoff, skipping):
        left, hits = list(found), 0
        for t in truth:
            i = 0
            while i < len(left):
                if ratio(t, left[i]) > cutoff:
                    hits += 1
                    left.pop(i)
                    if not skipping:
                        break
                i += 1
        return hits

    for r in run(spark, "h2_match_fuzzy"):
        truth, found = rows[r["o"]]
        tp = greedy([t.replace(" ", "") for t in truth], [f.replace(" ", "") for f in found], 80, False)
        assert (r["tp"], r["fp"], r["fn"], r["tp_skipping"]) == (tp, len(found) - tp, len(truth) - tp, greedy(truth, found, 90, True))


def pages_of(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["drawing_id"], r["pos"])):
        out[r["drawing_id"]].append(r)
    return out


def plain_lines(boxes):
    """[(box index, line)]: each box joins every line whose mean middle is nearer than half the mean height."""
    limit, lines = round(sum(b["h"] for b in boxes) / len(boxes)) // 2, []
    for i, b in enumerate(boxes):
        y = b["y"] + b["h"] // 2
        near = [line for line in lines if abs(sum(m for _, m in line) / len(line) - y) < limit]
        for line in near or [lines.append([]) or lines[-1]]:
            line.append((i, y))
    return [(i, n) for n, line in enumerate(lines) for i, _ in line]


def test_line_groups(spark):
    boxes = pages_of(table(spark, "boxes"))
    want = sorted((d, page[i]["pos"], line) for d, page in boxes.items() for i, line in plain_lines(page))
    got = run(spark, "c11_line_groups")
    columns = [c for c in ("drawing_id", "pos", "line")]
    assert sorted(tuple(r[c] for c in columns) for r in got) == want


def test_text_clusters(spark):
    """Labels of all boxes of all pages, noise included, from the pixels of the edges: by the point operator, and on each 25th page by comparing all pairs."""
    boxes = pages_of(table(spark, "boxes"))
    got = {(r["drawing_id"], r["pos"]): r["cluster"] for r in run(spark, "c14_text_clusters")}
    assert len(got) == sum(map(len, boxes.values()))
    for i, d in enumerate(sorted(boxes)):
        page, points, at = boxes[d], [], []
        for b in page:
            x, y, w, h = b["x"], b["y"], b["w"], b["h"]
            at.append((x, y))
            points += [(x + i, y) for i in range(w + 1)] + [(x + i, y + h) for i in range(w + 1)] + [(x + w, y + i) for i in range(h + 1)] + [(x, y + i) for i in range(h + 1)]
        for labels in [layout.density_clusters(np.array(points)).tolist(), *([plain_clusters(points)] if i % 25 == 0 else [])]:
            mine = [labels[points.index(p)] for p in at]
            behind = iter(range(max([*mine, -1, *labels]) + 1, len(points)))
            assert [next(behind) if label == -1 else label for label in mine] == [got[d, b["pos"]] for b in page], d


def test_merged_blobs_and_their_order(spark):
    """Blobs of all pages: pages without a frame keep their boxes in order; with one, each text stands once, cells before clusters before measures."""
    boxes, out = pages_of(table(spark, "boxes")), pages_of(run(spark, "c16_merge_text"))
    rank = {"cell": 0, "cluster": 1, "measure": 2, "box": 3}
    kinds = set()
    for d, blobs in out.items():
        assert [b["pos"] for b in blobs] == list(range(len(blobs)))
        steps = [rank[b["kind"]] for b in blobs]
        assert steps == sorted(steps)
        kinds |= {b["kind"] for b in blobs}
        if 3 in steps:
            assert [b["text"] for b in blobs] == [b["text"] for b in boxes[d]]
        else:
            words = sorted(w for b in boxes[d] for w in b["text"].split())
            for b in blobs:
                assert all(w in words for w in b["text"].split())
    assert kinds == set(rank)


def test_index_vector_value_by_value(spark):
    """The text sections of each drawing from its blobs, by the rules of each section."""
    blobs = pages_of(run(spark, "c16_merge_text"))
    rows = {r["drawing_id"]: r for r in run(spark, "w1_index")}
    assert set(rows) == set(blobs)
    surfaces = {d: [m[0] for b in page for m in re.finditer(r"(?:Ra|Rz|Rt)\s*\d+\.*\d*", b["text"])] for d, page in blobs.items()}
    norms = {d: [re.sub("[^0-9.]", "", m[0]) for b in page for m in re.finditer(r"(?:din |iso )+\d+", b["text"].lower())] for d, page in blobs.items()}
    assert {d: r["surfaces"] for d, r in rows.items()} == {d: "|".join(x) for d, x in surfaces.items()}
    assert {d: r["norms"] for d, r in rows.items()} == {d: "|".join(n for n in x if n not in ("2768", "7168")) for d, x in norms.items()}
    assert len({r["width"] for r in rows.values()}) == 1 and any(surfaces.values()) and any(norms.values())
