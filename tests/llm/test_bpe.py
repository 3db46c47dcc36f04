"""Byte-level BPE against the tokenizers library and a plain merge loop."""

import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from sheetforge.llm import bpe, queries

SMALL = "/root/testdata/sf0.001"
PATH = queries.TOKENIZER


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def model():
    with open(PATH) as f:
        return bpe.ByteBpe(f.read())


def ids(packed: bytes) -> list[int]:
    return np.frombuffer(packed, "<u4").tolist()


def plain_merges(symbols: list[int], merges: dict[int, int], width: int) -> list[int]:
    """Looks through all pairs for each merge."""
    out = list(symbols)
    while True:
        best = min(((merges[a * width + b], i) for i, (a, b) in enumerate(zip(out, out[1:])) if a * width + b in merges), default=None)
        if best is None:
            return out
        out[best[1] : best[1] + 2] = [best[0] % width]


def test_trees_against_a_plain_loop():
    r = random.Random(5)
    for width, n in ((4, 3), (6, 12), (12, 40)):
        pairs = r.sample([(a, b) for a in range(width) for b in range(width)], n)
        full = width + n
        merges = {a * full + b: rank * full + width + rank for rank, (a, b) in enumerate(pairs)}
        extra = [(width + r.randrange(n), r.randrange(full)) for _ in range(2 * n)]
        merges |= {a * full + b: (n + i) * full + r.randrange(width, full) for i, (a, b) in enumerate(extra) if a * full + b not in merges}
        keys = np.array([*sorted(merges), 1 << 61])
        made = np.array([*(merges[k] for k in sorted(merges)), bpe._NONE])

        def lookup(a, b):
            key = np.where((a < 0) | (b < 0), -1, a * full + b)
            at = np.searchsorted(keys, key)
            value = np.where(keys[at] == key, made[at], bpe._NONE)
            return np.where(value == bpe._NONE, bpe._NONE, value // full), value % full

        rows = [[r.randrange(width) for _ in range(r.randint(1, 16))] for _ in range(300)]
        want = [plain_merges(row, merges, full) for row in rows]
        assert [bpe.merge_symbols(row, merges, full) for row in rows] == want
        padded = np.array([row + [-1] * (16 - len(row)) for row in rows])
        assert [[s for s in row if s >= 0] for row in bpe.merge_rows(padded, lookup).tolist()] == want


def test_every_code_point_as_the_library(model, library):
    points = [c for c in [*range(0x3000), *range(0x3000, 0x110000, 7)] if not 0xD800 <= c < 0xE000]
    points += [c for c in (0x558, 0x88F, 0xA7CE, 0x10940, 0x11DE0, 0x1246F, 0x18E00, 0x3347A, 0x3FC3F)]
    texts = [f"a{c}{c}b {c} 1{c}'s" for c in map(chr, points)]
    want = library.encode_batch(texts, add_special_tokens=False)
    assert all(ids(a) == b.ids for a, b in zip(model.encode_all(iter(texts)), want))


def test_odd_texts_as_the_library(model, library):
    r = random.Random(1)
    texts = ["", " ", "\n\n \t", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "<|endoftext", "a" * 5_000, "\x00\x7f", "I'll we've 'S 's"]
    for alphabet in ("ab", " a", "aAé漢 \n'", "<|endoftext|>x ", " \t\n a'sdlrve1 "):
        texts += ["".join(r.choice(alphabet) for _ in range(n)) + "<|endoftext|>" + alphabet for n in (1, 2, 33, 700)]
    for text, packed in zip(texts, model.encode_all(iter(texts))):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids(packed) == want and ids(model.encode(text)) == want
        assert model.decode(packed) == library.decode(want, skip_special_tokens=False)


def test_ids_that_are_no_text_as_the_library(model, library):
    r = random.Random(2)
    for _ in range(200):
        some = [r.randrange(50_300) for _ in range(12)]
        packed = np.array(some, dtype="<u4").tobytes()
        assert model.decode(packed) == library.decode(some, skip_special_tokens=False)


def test_few_remembered_pieces_change_nothing(model, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    monkeypatch.setattr(bpe, "SPLIT_CHARS", 40)
    texts = ["one two three four five six", "two " + "x" * 90, "", "one one seven eight nine ten eleven"] * 5
    assert [ids(p) for p in model.encode_all(iter(texts))] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_a_very_long_text_without_a_blank(model, library):
    r = random.Random(3)
    text = "".join(r.choice("etaoinshr") for _ in range(250_000))
    assert ids(model.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_query_on_all_documents(spark, library):
    rows = {r["doc_id"]: r for r in queries.op13_bpe(spark, SMALL).collect()}
    docs = pq.read_table(f"{SMALL}/documents.parquet").to_pylist()
    assert len(rows) == len(docs)
    for d in docs:
        want = library.encode(d["text"] or "", add_special_tokens=False).ids
        text = library.decode(want, skip_special_tokens=False)
        row = rows[d["doc_id"]]
        assert row["n_tokens"] == len(want)
        assert row["ids_sha256"] == hashlib.sha256(np.array(want, dtype="<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_nulls_repeats_clashing_names_and_empty_tables(spark):
    rows = [(1, "a b", "x", 3), (1, "a b", "y", 3), (None, "a b", None, 3), (2, None, "z", 3), (3, "", "z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, given_ string, ids int")
    out = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert out.columns == ["doc_id", "text", "given_", "ids", "decoded"]
    got = sorted(((r["doc_id"], r["given_"], bytes(r["ids"]), r["decoded"]) for r in out.collect()), key=str)
    one = got[0][2]
    assert len(one) == 8 and got == sorted([(1, "x", one, "a b"), (1, "y", one, "a b"), (None, None, one, "a b"), (2, "z", b"", ""), (3, "z", b"", "")], key=str)
    assert bpe.decode(bpe.encode(docs.limit(0), PATH), PATH).count() == 0


def test_files_of_other_kinds_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        bpe.encode(spark.createDataFrame([("a",)], "text string"), "/opt/tokenizers/word_bpe_49k.json")
