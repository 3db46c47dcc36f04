"""The index workload against a plain version: every list and every number of each drawing's vector, over all pages of the smallest tables."""

import re
from collections import defaultdict

from sheetforge.operators import encode, extract, fuzzy
from sheetforge.plans import domain, queries, workloads
from test_plain_versions import any_match, plain_tolerance, ratio

SMALL = "/root/testdata/sf0.001"
_of_text: dict[str, dict] = {}


def plain_measure(text):
    found = re.search(r"\d+\.?\d*", text)
    number = found[0] if found else ""
    usable = "°" not in text and number and not re.search(r"R.?\d+\.?\d*", text) and all(len(p) <= 3 for p in number.split(".")) and "din" not in text.lower() and "iso" not in text.lower()
    diameter = "SW" in text or "⌀" in text
    return (float(number) if usable and (diameter or ":" not in text) else None), bool(usable and diameter)


def plain_lists(text, groups, gate):
    if text in _of_text:
        return _of_text[text]
    out = defaultdict(list)
    if any_match(text, fuzzy.TOLERANCE_WORDS):
        out["general_tolerances"] = [plain_tolerance(text)]
    if any_match(text, gate):
        best = 85
        for names in groups:
            for n in names:
                if (s := ratio(n, text)) > best:
                    best, out["material"], out["material_class"] = s, [n], [names]
    out["surfaces"] = [m[0] for m in re.finditer(extract.SURFACE, text)]
    out["gdts"] = [m[0] for m in re.finditer(extract.GDT, text)]
    out["threads"] = [m[0] for p in extract.THREADS for m in re.finditer(p, text)]
    out["other_isos"] = [n for m in re.finditer(extract.NORM, text.lower()) if (n := re.sub("[^0-9.]", "", m[0])) not in ("2768", "7168", "")]
    _of_text[text] = out
    return out


def plain_grade(surface):
    steps = encode.SURFACE_STEPS.get(surface[:2].lower())
    try:
        value = float(surface[2:])
    except ValueError:
        return 15
    return max((i for i, s in enumerate(steps) if s is not None and value >= s), default=15) if steps else 15


def plain_gdts(gdts):
    out = []
    for symbol in extract.GDT_SYMBOLS:
        least = 1.0
        for g in gdts:
            if symbol in g:
                try:
                    x = float(re.sub("[^0-9.]", "", g))
                except ValueError:
                    continue
                if x < least or least <= 0:
                    least = x
        out.append(least)
    return out


def plain_dims(blobs):
    best = {"h": (0.0, 0), "v": (0.0, 0), "d": None}
    for b in blobs:
        value, diameter = plain_measure(b["text"])
        if value is None or value <= 0:
            continue
        kind = "d" if diameter else "h" if b["w"] >= b["h"] else "v"
        if best[kind] is None or value > best[kind][0]:
            best[kind] = (value, b["pos"])
    other = max(best["h"][0], best["v"][0])
    first = [best["d"][0], other] if best["d"] else [best["h"][0], best["v"][0]]
    return [*first, 0.0]


def test_every_list_and_number(spark):
    boxes, rects, pages, part = domain.tables(spark, SMALL, "boxes", "rects", "pages", "part")
    materials, norms = queries._materials(part), queries._norms(part)
    names = defaultdict(list)
    for r in materials.orderBy("class_id", "pos", "name").collect():
        names[r["class_id"]].append(r["name"])
    groups = list(names.values())
    gate = fuzzy.MATERIAL_WORDS + [n for g in groups for n in g]
    known = ["".join(ch for ch in r["name"] if ch.isdigit() or ch == ".") for r in norms.orderBy("norm_id", "name").collect()]
    by_page = defaultdict(list)
    for b in queries.QUERIES["c16_merge_text"](spark, SMALL).orderBy("drawing_id", "pos").collect():
        by_page[b["drawing_id"]].append(b)
    rows = {r["drawing_id"]: r for r in workloads.index_drawings(boxes, rects, pages, materials, norms).collect()}
    assert set(rows) == set(by_page)
    seen = defaultdict(int)
    for d, blobs in by_page.items():
        whole, free = defaultdict(list), []
        for b in blobs:
            lists = plain_lists(b["text"], groups, gate)
            for c in extract.LISTS:
                whole[c] += lists[c]
            if not any(lists[c] for c in extract.LISTS if c != "material_class") and not b["is_text"]:
                free.append(b)
        for c in extract.LISTS:
            assert list(rows[d][c]) == whole[c], (d, c)
            seen[c] += len(whole[c])
        hot = [float(g in whole["material_class"]) for g in groups]
        tolerances = [t.lower() for t in whole["general_tolerances"]]
        letters = [float(any(t[:1] == c for t in tolerances)) for c in "fmcv"] + [float(any(t[1:2] == c for t in tolerances)) for c in "hkl"]
        grade = float(min(map(plain_grade, whole["surfaces"]), default=15))
        flags = [float(any(len(p) >= 5 and ratio(n, p) >= 85 for n in set(whole["other_isos"]))) for p in known]
        want = [*hot, *letters, grade, *plain_gdts(whole["gdts"]), *flags, *plain_dims(free)]
        got = list(rows[d]["ocr_vector"])
        assert len(got) == len(want) and all(abs(a - b) < 1e-9 for a, b in zip(got, want)), (d, [(i, a, b) for i, (a, b) in enumerate(zip(got, want)) if a != b])
        seen["dims"] += sum(x > 0 for x in want[-3:])
    assert all(seen[c] for c in ("general_tolerances", "surfaces", "gdts", "threads", "other_isos", "dims")), dict(seen)
