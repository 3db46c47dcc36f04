import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheetforge.operators import fuzzy


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def plain_ratio(a, b):
    if not a or not b:
        return 100.0 if a == b else 0.0
    if len(a) > len(b):
        a, b = b, a

    def best(s, t):
        n = len(s)
        windows = [t[:i] for i in range(1, n)] + [t[i : i + n] for i in range(len(t) - n + 1)] + [t[i:] for i in range(len(t) - n + 1, len(t))]
        return max(200 * lcs(s, w) / (n + len(w)) for w in windows)

    return max(best(a, b), best(b, a)) if len(a) == len(b) else best(a, b)


@settings(max_examples=300, deadline=None)
@given(st.text("abcd", max_size=9), st.text("abcde", max_size=14))
def test_ratio_equals_plain_version(a, b):
    assert abs(fuzzy.ratio(a, b) - plain_ratio(a, b)) < 1e-9


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", min_size=5, max_size=12), st.lists(st.text("abcd", min_size=1, max_size=8), max_size=6))
def test_last_match_loses_nothing(text, words):
    hits = [i for i, w in enumerate(words) if plain_ratio(w.lower(), text.lower()) >= 85]
    assert fuzzy.last_match(text, words) == (hits[-1] if hits else None)


def test_tolerances_and_materials():
    assert fuzzy.tolerance_class("ISO 2768 mK") == "mK"
    assert fuzzy.tolerance_class("DIN 7168") == "--"
    assert fuzzy.tolerance_class("Toleranz mittel") == "m-"
    assert fuzzy.last_match("abc", ["abc"]) is None
    assert fuzzy.best_class("Werkstoff 1.4301", [["Rotguss"], ["1.4301", "X5CrNi18.10"]])[:2] == (1, 0)


def test_greedy_variants():
    assert fuzzy.greedy_matches(["Ra3.2"], ["Ra3.2", "Ra3.2"], 80) == 1
    assert fuzzy.greedy_matches(["Ra3.2"], ["Ra3.2", "x", "Ra3.2"], 90, skipping=True) == 2
    assert fuzzy.greedy_matches(["a1"], ["a1", "a1"], 90, skipping=True) == 1  # the text behind a removed one is passed over


def test_blobs_are_matched_once_per_text(spark):
    rng = random.Random(3)
    texts = ["Werkstoff 1.4301", "ISO 2768 mK", "nothing here", None, ""]
    blobs = spark.createDataFrame([(i, rng.choice(texts)) for i in range(40)], "drawing_id int, text string")
    materials = spark.createDataFrame([(0, 0, "Rotguss"), (1, 0, "1.4301"), (1, 1, "X5CrNi18.10")], "class_id int, pos int, name string")
    rows = fuzzy.match_attributes(blobs, materials).collect()
    assert len(rows) == 40
    for r in rows:
        assert r["material"] == (["1.4301"] if r["text"] == texts[0] else [])
        assert r["general_tolerances"] == (["mK"] if r["text"] == texts[1] else [])
        if r["material"]:
            assert r["material_class"] == [["1.4301", "X5CrNi18.10"]]
    near = fuzzy.nearest_class(blobs.where("text is not null and text <> ''"), materials, text_col="text").where(F.col("text") == texts[0]).first()
    assert near["nearest"] == ["1.4301", "X5CrNi18.10"]


def test_norm_flags(spark):
    numbers = spark.createDataFrame([(1, ["16016"]), (2, []), (3, ["9999", "13715"])], "drawing_id int, other_isos array<string>")
    norms = spark.createDataFrame([(0, "ISO 16016"), (1, "DIN EN ISO 13715")], "norm_id int, name string")
    got = {r["drawing_id"]: r["norm_vector"] for r in fuzzy.norm_flags(numbers, norms).collect()}
    assert got == {1: [1.0, 0.0], 2: [0.0, 0.0], 3: [0.0, 1.0]}


def test_a_pair_of_texts_is_aligned_once(monkeypatch):
    calls = []
    inner = fuzzy.alignment
    monkeypatch.setattr(fuzzy, "alignment", lambda a, b: calls.append((a, b)) or inner(a, b))
    rng = np.random.default_rng(8)
    for _ in range(300):
        truth, found = ([f"Quartz 7.{v}" for v in rng.integers(0, n, 4)] for n in (5, 7))
        fuzzy.greedy_matches(truth, found, 90)
    assert len(calls) == len(set(calls)) <= 35


def test_norm_flags_read_their_input_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def listed(n):
        read.add(1)
        return [str(n)] if n else []

    numbers = spark.range(40).select(F.col("id").alias("drawing_id"), listed(F.when(F.col("id") % 2 == 0, 10000 + F.col("id") * 100)).alias("other_isos"))
    norms = spark.createDataFrame([(1, "DIN 10000"), (2, "DIN 10200"), (3, "DIN 99999")], "norm_id int, name string")
    got = {r["drawing_id"]: r["norm_vector"] for r in fuzzy.norm_flags(numbers, norms).collect()}
    assert len(got) == 40 and got[0][0] == got[2][1] == 1.0 and got[1] == [0.0, 0.0, 0.0]
    assert read.value == 40
