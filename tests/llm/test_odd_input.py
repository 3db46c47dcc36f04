"""Odd records, very long texts and few labels."""

import json
import random
import re
import time
import unicodedata

import pyarrow.parquet as pq
import pytest

from sheetforge.llm import chat, toxicity

SMALL = "/root/testdata/sf0.001"
ODD = [
    {"messages[].role": "a", "messages[].content": "b"},
    {"messages[].role": "a", "messages[].content": "b", "messages": 5},
    {"messages": [{"role": "a", "content": "b"}, 5]},
    {"messages": {"role": "a", "content": "b"}},
    {"conversations[].from": 1, "conversations[].value": []},
    {"role": "a", "text": "b", "turn": {"a": 1}},
    {"turn": [1], "role": "a", "text": "b"},
    {"a.b": 1}, {"": {"": []}}, {"instruction": {"x": 1}, "output": 2},
]


def test_odd_records_give_their_null_row(spark):
    records = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(ODD)] + [(99, json.dumps({"messages": [{"role": "user", "content": "x"}]}))], "id long, raw string")
    rows = {r["conv_id"]: r for r in chat.canonical_turns_json(records, "id", "raw").collect()}
    assert len(rows) == len(ODD) + 1
    assert all((rows[i]["layout"], rows[i]["turn"], rows[i]["role"], rows[i]["text"]) == (None,) * 4 for i in range(len(ODD)))
    assert rows[99]["layout"] == "messages" and rows[99]["text"] == "x"


def test_names_with_dots_are_no_structure():
    flat, nested = {"a.b": 1, "c[]": 2}, {"a": {"b": 1}, "c": [2]}
    assert chat.fingerprint(chat.value_paths(flat)) != chat.fingerprint(chat.value_paths(nested))


def plain_fold(text: str) -> str:
    """Word by word: from the first place in a word where letters meet digits or signs, these are replaced."""
    out = unicodedata.normalize("NFKC", text).lower().translate(toxicity.HOMOGLYPHS)
    out = re.sub("[̀-ͯ​-‏⁠﻿­]", "", unicodedata.normalize("NFD", out)) if not text.isascii() else text.lower()
    parts = []
    for piece in re.split(r"([\w@$!€]+)", out):
        for start in range(len(piece)):
            rest = piece[start:]
            if re.match(r"[^\W\d_]*[\d@$!€]+[^\W\d_]|[^\W\d_]+[\d@$€]", rest):
                piece = piece[:start] + rest.rstrip("!").translate(toxicity.DIGITS)
                break
        parts.append(piece)
    return " ".join(re.findall(r"[^\W_]+", "".join(parts)))


def plain_weigh(folded: str, model: toxicity.Model) -> tuple[float, int, int]:
    """Longest term at each word's start, none inside an exception phrase."""
    if not folded:
        return 0.0, 0, 0
    text, total, hits = f" {folded} ", 0.0, 0
    spared = [(m.start(), m.start() + len(p) + 1) for p in map(toxicity.fold, model.exceptions) for m in re.finditer(f"(?= {re.escape(p)})", text)]
    for m in re.finditer(" ", text):
        found = [(len(k), w) for t, w in model.terms.items() if text.startswith(k := " " + toxicity.fold(t.rstrip("*")) + ("" if t.endswith("*") else " "), m.start())]
        if found and not any(a <= m.start() <= b - 1 for a, b in spared):
            total, hits = total + max(found)[1], hits + 1
    return total, hits, folded.count(" ") + 1


def test_folding_and_weights_against_plain_versions():
    model = toxicity.Model()
    automaton = model.automaton()
    r = random.Random(9)
    texts = [t or "" for t in pq.read_table(f"{SMALL}/documents.parquet", columns=["text"]).column(0).to_pylist()]
    texts += ["".join(r.choice("ab1!_ $éａ²0-") for _ in range(r.randint(0, 30))) for _ in range(3_000)]
    texts += [" ".join(r.choice(["1d1ot", "trash", "can", "class", "clown", "fish", "idiot", "proof", "ѕtupid", "st!upid", "loser!!", "losers", "bracket"]) for _ in range(r.randint(0, 12))) for _ in range(500)]
    for text in texts:
        folded = toxicity.fold(text)
        assert folded == plain_fold(text), text
        weight, hits, words = toxicity.weigh(folded, automaton)
        want = plain_weigh(folded, model)
        assert (round(weight, 9), hits, words) == (round(want[0], 9), *want[1:]), text


@pytest.mark.parametrize("piece", ["a" * 1_000_000 + " 1", "漢" * 1_000_000 + " 1", "1" * 1_000_000 + " a", "!" * 1_000_000 + "a", "a!" * 300_000, "a_1!" * 200_000, "trash can " * 100_000, "@" * 500_000 + " $"])
def test_very_long_texts_take_linear_time(piece):
    automaton = toxicity.Model().automaton()
    began = time.process_time()
    toxicity.weigh(toxicity.fold(piece), automaton)
    assert time.process_time() - began < 12


def test_words_of_few_texts_teach_nothing(spark):
    r = random.Random(3)
    words = ["".join(r.choice("bcdfghklmnprstvw") + r.choice("aeiou") for _ in range(4)) for _ in range(300)]
    rows = []
    for i in range(1_500):
        said = [r.choice(words) for _ in range(40)]
        toxic = i % 10 == 0
        if toxic:
            said.insert(r.randrange(40), "zzwurgel" + r.choice(["", "n", "st"]))
            said += [f"seltsam{i % 70}{r.choice('xyz')}"]
        rows.append((i, " ".join(said), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    learned = set(model.terms) - set(toxicity.SEED)
    assert any(t.startswith("zz") for t in learned)
    assert all(t.startswith(("zz", "sel")) for t in learned)
    # a labelled id that repeats is one row of the sample, and changes nothing
    again = toxicity.learn(docs.select("doc_id", "text").unionByName(docs.where("doc_id = 10").select("doc_id", "text").crossJoin(spark.range(50)).drop("id")), docs.select("doc_id", "toxic"))
    assert again.terms == model.terms and again.coefficients == model.coefficients
