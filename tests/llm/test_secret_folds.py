"""Labelled candidates are judged by forests that didn't see them; candidates without evidence by all."""

import random
import re
import time

from sheetforge.llm import secrets

SCHEMA = "doc_id long, text string, source string"


def test_the_forest_overrules_a_rule_and_judges_what_no_rule_decides(spark):
    rng = random.Random(8)

    def value(n=24):
        return "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789") for _ in range(n)) + "7a"

    def number():
        return str(rng.randrange(10**17, 10**18))

    rows, truth = [], {}
    for i in range(150):
        # labelled by their neighbours
        rows += [(10 * i, f'secret = "{value()}" was set', "conf"), (10 * i + 1, f"version {number()} went out", "blog")]
        truth |= {10 * i: True, 10 * i + 1: False}
    for i in range(8):  # a plain number under a secret name: the rule says secret
        rows.append((10 * i + 2, f'secret = "{number()}" was set', "conf"))
        truth[10 * i + 2] = False
    for i in range(60):  # nothing near them decides
        rows += [(10 * i + 3, f"took {value()} with it", "conf")]
        truth |= {10 * i + 3: True}
    out = secrets.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    assert {r["doc"] % 10: r["label"] for r in out} == {0: 1.0, 1: 0.0, 2: 1.0, 3: None}
    overruled = [r for r in out if r["doc"] % 10 == 2]
    assert sum(not r["is_secret"] for r in overruled) >= 6, [r["probability"] for r in overruled]
    silent = [r for r in out if r["doc"] % 10 == 3]
    assert sum(r["is_secret"] for r in silent) >= 57
    right = sum(r["is_secret"] == truth[r["doc"]] for r in out)
    assert right >= 0.97 * len(out)


def test_copies_of_a_value_share_its_fold(spark):
    """One value that is a secret in thousands of rows teaches nothing about itself: without it nothing is left to learn secrets from."""
    rows = [(i, 'secret = "q7RbT2xKp9LmW4zN8sVc" here', "s") for i in range(500)] + [(1000 + i, f"card {10**15 + i * 7919} paid", "s") for i in range(300)]
    out = secrets.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 800
    assert {(r["doc"] < 1000, r["probability"]) for r in out} == {(True, 1.0), (False, 0.0)}  # the evidence stands


def test_findings_given_train_one_forest(spark):
    rows = [(i, f'secret = "{"Zq9"[i % 3]}{i}kX4vB8nM2{i * 37}tR" here', "s") for i in range(60)] + [(100 + i, f"card {10**15 + i * 7919} paid", "s") for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    findings = secrets.label_findings(secrets.with_features(secrets.find_candidates(docs)))
    out = secrets.scan(docs, findings).collect()
    assert all(r["is_secret"] == (r["doc"] < 100) for r in out)


def test_runs_of_colons_are_searched_once(spark):
    texts = {1: "aa:" * 100_000, 2: "aa:bb@" * 50_000, 3: "a@b:c@d " * 3, 4: "x" * 300_000 + ":y@z", 5: "see https://me:pa:ss@h.example", 6: "é(user:geh3im@host)"}
    began = time.perf_counter()
    found = secrets.find_candidates(spark.createDataFrame([(i, t, "s") for i, t in texts.items()], SCHEMA)).collect()
    assert time.perf_counter() - began < 60
    values = {i: [r["candidate"] for r in found if r["doc"] == i] for i in texts}
    assert values[1] == []
    assert values[3] == ["c"] * 3
    assert values[5] == ["pa:ss"]
    assert values[6] == ["geh3im"]
    assert re.fullmatch("x+", values[4][0])
