import random
import re

import pytest
from pyspark.sql import functions as F

from sheetforge.llm import jaccard_join
from sheetforge.llm.common import connected_components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and (both := len(x & y)) * 100 >= 80 * (len(x) + len(y) - both):
                u, v = sorted((find(a), find(b)))
                root[v] = u
    return sorted((d, len(s), find(d)) for d, s in sets)


def corpus(seed, n=60, copies=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(n):
        base = [rng.choice(words) for _ in range(rng.randint(1, 140))]
        if i % 3 == 0:
            base += passage
        rows.append(base)
        for _ in range(rng.randint(0, copies)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(copy)
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("fan", [32, 4])
def test_equals_brute_force(spark, monkeypatch, fan):
    monkeypatch.setattr(jaccard_join, "FAN", fan)  # 4: trees of several levels
    monkeypatch.setattr(jaccard_join, "CHUNK", 2 * fan)
    rows = corpus(7) + [(9001, None), (9002, ""), (9003, " \t\n"), (9004, "one TWO"), (9005, "One two"), (9006, "x " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("token", F.lit(0))
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(docs).collect())
    assert got == brute(rows)


def test_repeated_null_and_empty(spark):
    rows = [(1, "a b c d e f"), (1, "u v w x y z"), (2, "u v w x y z"), (None, "a b c d e f"), (None, "q"), (3, "q r s t u v w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard_join.jaccard_components(docs).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, 1), (None, 1, None), (3, 3, 3)], key=str)
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0


def test_deduplicate_keeps_one(spark):
    rows = corpus(11, 25)
    docs = spark.createDataFrame([*rows, rows[0], (None, "zz")], "doc_id long, text string")
    kept = sorted((r["doc_id"] for r in jaccard_join.deduplicate(docs).collect()), key=str)
    assert kept == sorted([*{c for _, _, c in brute(rows)}, None], key=str)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert connected_components(edges.limit(0)).count() == 0


def test_bounds_never_drop_a_link():
    rng = random.Random(1)
    import numpy as np

    for _ in range(300):
        a = {rng.getrandbits(64) for _ in range(rng.randint(1, 90))}
        b = set(rng.sample(sorted(a), max(1, int(len(a) * rng.uniform(0.6, 1))))) | {rng.getrandbits(64) for _ in range(rng.randint(0, 20))}
        x, y = (np.array(sorted(s), dtype=np.uint64) for s in (a, b))
        both = len(a & b)
        if 100 * both >= 80 * len(a | b):
            maps = [jaccard_join._bitmap(s, 128) for s in (x, y)]
            assert jaccard_join.could_link(len(a), maps[0], len(b), maps[1], 80)


def test_registered_tables_go_through_trees(spark, monkeypatch):
    seen, keep = [], jaccard_join.tree_candidates

    def spy(members, percent):
        seen.append(members.count())
        return keep(members, percent)

    monkeypatch.setattr(jaccard_join, "tree_candidates", spy)
    monkeypatch.setattr(jaccard_join, "FAN", 4)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null")
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(docs).collect())
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert seen and seen[0] > 0
