"""Toxicity scores from a weighted lexicon.

Texts are folded (compatibility forms, homoglyphs, accents, digit and sign substitutions), all terms
are found in one pass by an Aho-Corasick automaton, hits inside exception phrases are dropped, and the summed
weights are set against the length of the text. A small logistic model turns that into a score.

The lexicon has a seed list and terms learned from labelled rows. A term is a whole word, or the
beginning of words (written with a trailing *).
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetforge.llm.common import dropped, stored

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = str.maketrans(
    "аеорсухіјѕԁһкмтвнгԛԝαοερτυνικηωχγß"
    "АВЕКМНОРСТУХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
    "ıłøđðħŧ",
    "aeopcyxijsdhkmtbhrqwaoeptuvikhwxyb"
    "abekmhopctyxijsabezhikmnoptyx"
    "iloddht",
)
# Digits and signs that stand for letters inside words.
DIGITS = str.maketrans("0134578@$!€", "oieastbasie")
# A word that mixes letters with digits or signs. It starts where neither a letter nor a digit or sign stands before and no part of it is read
# again in another split, so long runs take linear time.
_MIXED = re.compile(r"(?<![^\W_])(?<![@$!€])(?:[^\W\d_]*+[\d@$!€]++[^\W\d_][\w@$!€]*+|[^\W\d_]++[\d@$€][\w@$!€]*+)")
_COMBINING = re.compile(r"[̀-ͯ​-‏⁠﻿­]")
_WORD = re.compile(r"[^\W_]+")

#: Seed terms and weights; learned terms come on top and replace a seed's weight where they meet.
SEED = {
    "idiot*": 3.0, "moron*": 3.0, "stupid*": 2.5, "scum*": 3.0, "loser*": 2.5, "trash*": 2.0, "worthless": 2.5,
    "pathetic": 2.5, "disgusting": 2.5, "clown*": 2.0, "imbecile*": 3.0, "bastard*": 3.0, "asshole*": 4.0, "bitch*": 3.5,
    "shit*": 3.0, "fuck*": 3.5, "cunt*": 4.0, "dumbass*": 3.5, "retard*": 3.5, "scumbag*": 3.5, "vermin*": 2.5, "degenerate*": 2.0,
}
#: Phrases in which a term is no insult.
EXCEPTIONS = ["trash can", "trash bin", "trash collection", "class clown", "clown fish", "clownfish", "circus clown", "shiitake", "shitake", "scumble", "losers bracket", "idiot proof", "idiot light", "fire retardant", "flame retardant"]

#: Different terms that a worker counts before it passes them on; about 200 bytes each.
MOST_TERMS = 100_000


def fold(text: str) -> str:
    """Lower case without look-alikes: NFKC, homoglyphs and accents to plain Latin, digits in words to letters.

    Only words that mix letters with digits or signs have these replaced, so numbers stay numbers.
    """
    if text.isascii():
        out = text.lower()
    else:
        out = unicodedata.normalize("NFKC", text).lower().translate(HOMOGLYPHS)
        out = _COMBINING.sub("", unicodedata.normalize("NFD", out))
    if re.search(r"[\d@$€!]", out):
        out = _MIXED.sub(lambda m: m[0].rstrip("!").translate(DIGITS), out)
    return " ".join(_WORD.findall(out))


@dataclass
class Model:
    """Lexicon (term -> weight) and the coefficients of the logistic model on ``features``."""

    terms: dict[str, float] = field(default_factory=lambda: dict(SEED))
    exceptions: list[str] = field(default_factory=lambda: list(EXCEPTIONS))
    coefficients: tuple[float, float, float] = (-2.5, 0.8, 2.0)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            start = term.endswith("*")
            key = " " + fold(term.rstrip("*")) + ("" if start else " ")
            found.add_word(key, (len(key) - 1, weight, start))
        for phrase in self.exceptions:
            key = " " + fold(phrase)
            found.add_word(key, (len(key) - 1, None, True))
        if len(found):
            found.make_automaton()
        return found


def weigh(folded: str, automaton) -> tuple[float, int, int]:
    """(summed weight, hits, words) of a folded text. At each place the longest term counts; terms inside an exception phrase don't."""
    if not folded:
        return 0.0, 0, 0
    words = folded.count(" ") + 1
    if not len(automaton):
        return 0.0, 0, words
    best: dict[int, tuple[int, float]] = {}
    spared: list[tuple[int, int]] = []
    for end, (length, weight, _) in automaton.iter(f" {folded} "):
        begin = end - length
        if weight is None:
            spared.append((begin, end))
        elif begin not in best or best[begin][0] < length:
            best[begin] = (length, weight)
    if spared:
        spared.sort()
        starts, ends = [x for x, _ in spared], list(accumulate((y for _, y in spared), max))
        best = {b: v for b, v in best.items() if not ((i := bisect_right(starts, b)) and ends[i - 1] >= b)}
    return sum(w for _, w in best.values()), len(best), words


def features(weight: float, words: int) -> tuple[float, float]:
    """Of a text: log of the summed weight, and weight for each square root of a word."""
    return math.log1p(weight), weight / math.sqrt(words) if words else 0.0


def score_of(weight: float, words: int, coefficients: tuple[float, float, float]) -> float:
    a, b = features(weight, words)
    z = coefficients[0] + coefficients[1] * a + coefficients[2] * b
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = 20_000, min_contexts: int = 5, min_ratio: float = 6.0, min_share: float = 0.02) -> Model:
    """A model from labelled rows; ``labels`` has ``id_col`` and ``label_col`` (0/1).

    It is fitted on at most ``fit_rows`` labelled ids, those of least hash; an id that repeats counts once, with its least text and greatest label. Candidate terms
    are beginnings of words (3 to 10 letters) and whole words. Per candidate the toxic and other
    rows that have it are counted in Spark, and the different words that stand before it in toxic rows: copies of
    one text repeat the same neighbours, a term of its own has many. Kept are those with a
    likelihood ratio of at least ``min_ratio`` in ``min_share`` of the toxic rows, or one of 50 anywhere, and enough
    neighbours (``min_contexts``, and a quarter of their toxic rows or 20); of nested ones only that with most evidence. The rows are
    split in two halves by a hash of the text, and a term must stand in toxic rows of both, so that one text and its repetitions teach nothing.
    All terms that pass are taken; they can be no more than the bounded sample holds.
    Null labels and ids are left out. Without usable rows the seed model remains.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("_label"))
    sample = known.orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(fit_rows)
    # at most fit_rows rows, so the texts stay where they are
    labelled = docs.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("_text")).join(F.broadcast(sample), id_col)
    one_each = labelled.groupBy(id_col).agg(F.min("_text").alias("text"), F.max("_label").cast("int").alias("label"))
    # a bounded table, read by each of the steps below
    rows = stored(one_each.select("text", "label", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half")), "sample")

    totals = {(r["label"], r["half"]): r["n"] for r in rows.groupBy("label", "half").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = (sum(n for (label, _), n in totals.items() if label == x) for x in (1, 0))
    if not n_pos or not n_neg:
        return Model()

    over = (F.col("pos") / F.lit(n_pos)) / ((F.col("neg") + F.lit(0.5)) / F.lit(n_neg + 1))
    best = (
        rows.mapInArrow(term_counts, "term string, pos0 long, pos1 long, neg0 long, neg1 long, near long")
        .groupBy("term")
        .agg(*[F.sum(c).alias(c) for c in ("pos0", "pos1", "neg0", "neg1")], F.bit_count(F.expr("bit_or(near)")).alias("near"))
        .withColumns({"pos": F.col("pos0") + F.col("pos1"), "neg": F.col("neg0") + F.col("neg1")})
        .where((F.col("pos0") > 0) & (F.col("pos1") > 0) & (F.col("near") >= F.greatest(F.lit(min_contexts), F.least(F.lit(20), F.col("pos") / 4))) & ((over >= 50) | (over >= min_ratio) & (F.col("pos") >= min_share * n_pos)))
        .select("term", "pos", "neg")
        .collect()
    )
    model = Model()
    model.terms |= _strongest(best, n_pos, n_neg)
    sample_rows = rows.select("text", "label").mapInArrow(_measurer(model), "weight double, hits long, words long, label int").collect()
    dropped(rows)
    model.coefficients = _fit([(r["weight"], r["words"], r["label"]) for r in sample_rows])
    return model


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (text, label, half): the candidate terms with their toxic and other rows by half, and a bit for each word (by hash) before them in toxic rows.

    A term comes once for each MOST_TERMS different ones that a task has met, so what a worker holds doesn't grow with its share of the rows.
    """
    found: dict[str, list[int]] = {}
    for batch in batches:
        for text, label, half in zip(*(batch[i].to_pylist() for i in range(3)), strict=True):
            for term, near in _terms_of(text or "", bool(label)).items():
                x = found.get(term)
                if x is None:
                    x = found[term] = [0, 0, 0, 0, 0]
                x[(0 if label else 2) + half] += 1
                x[4] |= near
            if len(found) > MOST_TERMS:
                yield _flushed(found)
    yield _flushed(found)


def _terms_of(text: str, toxic: bool) -> dict[str, int]:
    """The text's terms, each with the bits of the words before it; without bits if not toxic."""
    words = fold(text).split()
    near = dict.fromkeys(words, 0)
    if toxic:
        for before, w in zip(["", *words], words, strict=False):
            near[w] |= 1 << zlib.crc32(before.encode("utf-8", "surrogatepass")) % 62
    out: dict[str, int] = {}
    for w, bits in near.items():
        for term in (*(w[:n] + "*" for n in range(3, min(10, len(w)) + 1)), w):
            out[term] = out.get(term, 0) | bits
    return out


def _flushed(found: dict[str, list[int]]) -> pa.RecordBatch:
    out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *(pa.array([v[i] for v in found.values()], pa.int64()) for i in range(5))], names=["term", "pos0", "pos1", "neg0", "neg1", "near"])
    found.clear()
    return out


def _strongest(found: list, n_pos: int, n_neg: int) -> dict[str, float]:
    """Terms by falling evidence (toxic rows times log ratio), longer first on ties; one that begins
    a chosen one, or that a chosen one begins, is passed over."""

    def weight(r) -> float:
        return math.log((r["pos"] + 0.5) / (n_pos + 1)) - math.log((r["neg"] + 0.5) / (n_neg + 1))

    chosen: dict[str, float] = {}
    stems: set[str] = set()
    begun: set[str] = set()
    for r in sorted(found, key=lambda r: (-round(r["pos"] * weight(r), 6), -len(r["term"]), r["term"])):
        stem = r["term"].rstrip("*")
        if stem in begun or any(stem[:n] in stems for n in range(1, len(stem) + 1)):
            continue
        stems.add(stem)
        begun.update(stem[:n] for n in range(1, len(stem) + 1))
        chosen[r["term"]] = round(min(6.0, max(0.5, weight(r))), 4)
    return chosen


def _measurer(model: Model):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            out = [weigh(fold(t or ""), automaton) for t in batch[0].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), batch[1]], names=["weight", "hits", "words", "label"])

    return measure


def _fit(rows: list[tuple[float, int, int]], rounds: int = 60, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Ridge logistic regression on ``features`` by Newton steps."""
    x = np.array([(1.0, *features(w, n)) for w, n, _ in rows])
    y = np.array([float(label) for _, _, label in rows])
    beta = np.zeros(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (p - y) + ridge * beta
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(3)
        step = np.linalg.solve(hess, grad)
        beta = beta - step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (default: all) plus score, predicted, hits, words.

    One row per row, repeated rows too; null and empty texts count as texts without words; an empty table gives an empty result. Very long texts are read in whole.
    Carried columns named like an added one are replaced.
    """
    added = ("score", "predicted", "hits", "words")
    names = [c for c in (carry if carry is not None else docs.columns) if c not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            found = [weigh(fold(t or ""), automaton) for t in batch.column(text_col).to_pylist()]
            scores = [score_of(w, n, model.coefficients) for w, _, n in found]
            own = [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array([h for _, h, _ in found], pa.int64()), pa.array([n for _, _, n in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *own], names=[*names, *added])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in names)
    return docs.select(*dict.fromkeys([*names, text_col])).mapInArrow(run, f"{kinds}score double, predicted int, hits long, words long")
