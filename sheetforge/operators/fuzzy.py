"""Fuzzy matching of texts against dictionaries.

Title-block texts repeat heavily, so distinct texts are matched and results joined back. An index of letter pairs rules out the words that can't reach the
ratio asked for, the others are aligned. A dictionary is a small table of
words; beyond ``DICTIONARY_LIMIT`` words matching refuses rather than sending a table of unknown size to the tasks.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetforge.functions.grams import Words
from sheetforge.scratch import stored

DICTIONARY_LIMIT = 50_000
#: Lists up to so many words are gone through without an index; so many promising names are aligned first.
FEW, FIRST = 4, 4
# Words that announce tolerances and materials.
TOLERANCE_WORDS = ["2768", "7168", "toleranz", "tolerance"]
MATERIAL_WORDS = ["material", "werkstoff", "halbzeug"]
# Spelled-out classes, and the letters of the two norms.
TOLERANCE_NAMES = ["fein", "mittel", "grob", "sehr grob", "fine", "middle", "coarse", "very coarse"]
TOLERANCE_LETTERS = {"2768": ("fmcv", "hkl"), "7168": ("fmgs", "abcdrstu")}


def _lcs(bits: dict[str, int], size: int, window: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows; ``bits`` has the places of each letter."""
    s = (1 << size) - 1
    full = s
    for ch in window:
        match = s & bits.get(ch, 0)
        s = ((s + match) | (s - match)) & full
    return size - s.bit_count()


def alignment(a: str, b: str) -> tuple[float, int, int]:
    """(score, start, end): best ratio of the shorter text against windows of the longer one, and that window.

    Windows: shorter beginnings, all of full length, shorter endings; ratio = 200 * LCS / (both lengths). The
    first best counts. For texts of equal length the swapped match is taken if better. start and end lie in ``b`` when b is the
    longer text; else they are those of the whole of b. Two empty texts match fully, one empty text not at all.
    """
    if not a or not b:
        return (100.0 if a == b else 0.0), 0, 0
    if len(a) > len(b):
        score, _, _ = alignment(b, a)
        return score, 0, len(b)
    n, m = len(a), len(b)
    bits: dict[str, int] = {}
    for i, ch in enumerate(a):
        bits[ch] = bits.get(ch, 0) | 1 << i
    if (at := b.find(a)) >= 0:
        return 100.0, at, at + n
    best = (0.0, 0, 0)

    def tried(start: int, end: int) -> None:
        nonlocal best
        most = 200 * min(n, end - start) / (n + end - start)
        if most > best[0]:
            score = 200 * _lcs(bits, n, b[start:end]) / (n + end - start)
            if score > best[0]:
                best = (score, start, end)

    for end in range(1, n):
        tried(0, end)
    for start in range(m - n + 1):
        if b[start + n - 1] in bits:
            tried(start, start + n)
    for start in range(m - n + 1, m):
        tried(start, m)
    if n == m and best[0] < 100:
        swapped = _one_way(b, a)
        if swapped > best[0]:
            return swapped, 0, m
    return best


def _one_way(a: str, b: str) -> float:
    bits: dict[str, int] = {}
    for i, ch in enumerate(a):
        bits[ch] = bits.get(ch, 0) | 1 << i
    n = len(a)
    windows = [b[:i] for i in range(1, n)] + [b] + [b[i:] for i in range(1, n)]
    return max(200 * _lcs(bits, n, w) / (n + len(w)) for w in windows)


def ratio(a: str, b: str) -> float:
    """Partial ratio of two texts, 0 to 100."""
    return alignment(a, b)[0]


#: Lists of attributes repeat few texts; a process keeps the ratios of so many pairs.
known_ratio = lru_cache(maxsize=100_000)(ratio)


@F.pandas_udf(T.DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Partial ratio of two text columns; null where either is."""
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def could_reach(a: str, letters: frozenset[str], cutoff: float) -> bool:
    """Whether enough letters of the shorter text ``a`` occur at all for its ratio to reach ``cutoff``.

    With c letters present, LCS <= c, and the best window for it has c letters: ratio <= 200 c / (len(a) + c).
    """
    present = sum(ch in letters for ch in a)
    return 200 * present / (len(a) + present) >= cutoff if present else False


class Tally:
    """Pairs of a text and a word that a task met, and those of them that it aligned."""

    def __init__(self) -> None:
        self.pairs = self.aligned = 0


def lower(words: list[str]) -> Words:
    return Words([w.lower() for w in words])


def last_match(text: str, words: list[str] | Words, cutoff: float = 85, min_len: int = 5, tally: Tally | None = None) -> int | None:
    """Position of the last word with a ratio of at least ``cutoff``, case aside; None for short texts. ``words``: a list, or its ``lower`` form."""
    if len(text) < min_len:
        return None
    low = text.lower()
    if not isinstance(words, Words):
        words = lower(words)
    if len(words) > FEW:
        open_ = words.index.candidates(low, cutoff)[::-1].tolist()
    else:
        open_ = range(len(words) - 1, -1, -1)
    if tally:
        tally.pairs += len(words)
    letters = frozenset(low)
    for i in open_:
        word = words.words[i]
        if len(word) > len(low) or could_reach(word, letters, cutoff):
            if tally:
                tally.aligned += 1
            if ratio(word, low) >= cutoff:
                return i
    return None


class Classes:
    """Classes of names, with one list of all names."""

    def __init__(self, classes: list[list[str]]) -> None:
        self.classes = classes
        self.places = [(c, p) for c, names in enumerate(classes) for p in range(len(names))]
        self.names = Words([classes[c][p] for c, p in self.places])


def best_class(text: str, classes: list[list[str]] | Classes, above: float = 85, tally: Tally | None = None) -> tuple[int, int, float] | None:
    """(class, name, ratio) of the first best name, case kept, if it is over ``above``.

    The names with most letter pairs in common are aligned first; then only those are left that can reach the best of them.
    """
    if not isinstance(classes, Classes):
        classes = Classes(classes)
    places, listed = classes.places, classes.names.words
    letters = frozenset(text)
    known: dict[int, float] = {}
    if tally:
        tally.pairs += len(listed)

    def score(i: int) -> float:
        if i not in known:
            known[i] = ratio(listed[i], text)
            if tally:
                tally.aligned += 1
        return known[i]

    open_, floor = range(len(listed)), above
    if len(listed) > FEW:
        index = classes.names.index
        shared = index.shared(text)
        open_ = index.candidates(text, above, shared)
        if len(open_) > FIRST:
            most = (shared[0] + shared[1])[open_]
            floor = max([above, *(score(int(i)) for i in open_[np.argsort(-most, kind="stable")[:FIRST]])])
            open_ = index.candidates(text, floor, shared)
    best, found = above, None
    for i in map(int, open_):
        name = listed[i]
        if i not in known and len(name) <= len(text) and not could_reach(name, letters, max(best, floor)):
            continue
        if score(i) > best:
            best, found = score(i), (*places[i], score(i))
    return found


_TOLERANCE_NAMES = lower(TOLERANCE_NAMES)


def tolerance_class(text: str) -> str:
    """Two letters of the general tolerance in a text, - for each that isn't found."""
    spelled = last_match(text, _TOLERANCE_NAMES)
    if spelled is not None:
        return "fmcv"[spelled % 4] + "-"
    for norm, (first, second) in TOLERANCE_LETTERS.items():
        score, start, end = alignment(norm, text)
        if end - start > 2 and score > 80 and start + end:
            letters = [ch for ch in text[end:] if ch in string.ascii_letters][:2]
            letters += ["$"] * (2 - len(letters))
            return "".join(ch if ch.lower() in known else "-" for ch, known in zip(letters, (first, second), strict=True))
    return "--"


def _dictionary(words: DataFrame, *columns: str) -> list[tuple]:
    rows = [tuple(r) for r in words.select(*columns).limit(DICTIONARY_LIMIT + 1).collect()]
    if len(rows) > DICTIONARY_LIMIT:
        raise ValueError(f"more than {DICTIONARY_LIMIT} words; split the dictionary")
    return sorted(rows)


def _on_distinct(df: DataFrame, text_col: str, run, schema: str, names: list[str], count=None) -> DataFrame:
    """``df`` with columns that ``run(text, tally)`` gives, computed once for each distinct text.

    ``count``: two accumulators, for pairs of a text and a word, and for those that were aligned.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally = Tally()
            texts = batch[0].to_pylist()
            rows = [run(t, tally) for t in texts]
            if count is not None:
                count[0].add(tally.pairs)
                count[1].add(tally.aligned)
            frame = pd.DataFrame({"_text": texts} | {n: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(names)})
            yield from pa.Table.from_pandas(frame, schema=_arrow, preserve_index=False).to_batches()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    _arrow = to_arrow_schema(_parse_datatype_string(f"_text string, {schema}"))
    distinct = df.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("_text")).distinct()
    found = distinct.mapInArrow(each, f"_text string, {schema}")
    return df.join(found, F.col(text_col) == F.col("_text"), "left").drop("_text")


def fuzzy_match(df: DataFrame, words: DataFrame, *, text_col: str = "text", cutoff: float = 85, min_len: int = 5, out: str = "word_id", count=None) -> DataFrame:
    """``df`` plus ``out``: id of the last matching word of ``words`` (word_id, word), or null. ``count``: as in ``_on_distinct``."""
    listed = _dictionary(words, "word_id", "word")
    ids, texts = [i for i, _ in listed], lower([w for _, w in listed])

    def run(text: str, tally: Tally) -> tuple:
        at = last_match(text, texts, cutoff, min_len, tally)
        return (None if at is None else ids[at],)

    return _on_distinct(df, text_col, run, f"{out} long", [out], count)


def match_attributes(blobs: DataFrame, materials: DataFrame, *, text_col: str = "text", count=None) -> DataFrame:
    """``blobs`` plus material, material_class and general_tolerances as lists of at most one entry.

    ``materials`` is (class_id, pos, name). A gate of keywords and names comes before each of the two.
    """
    classes: dict[int, list[str]] = {}
    for c, _, name in _dictionary(materials, "class_id", "pos", "name"):
        classes.setdefault(c, []).append(name)
    groups = list(classes.values())
    gate, named, tolerances = lower(MATERIAL_WORDS + [n for g in groups for n in g]), Classes(groups), lower(TOLERANCE_WORDS)

    def run(text: str, tally: Tally) -> tuple:
        material, group, tolerance = [], [], []
        if last_match(text, tolerances) is not None:
            tolerance = [tolerance_class(text)]
        if last_match(text, gate, tally=tally) is not None and (best := best_class(text, named, tally=tally)):
            material, group = [groups[best[0]][best[1]]], [groups[best[0]]]
        return material, group, tolerance

    out = _on_distinct(blobs, text_col, run, "material array<string>, material_class array<array<string>>, general_tolerances array<string>", ["material", "material_class", "general_tolerances"], count)
    return out.withColumns({"material": F.coalesce("material", F.array().cast("array<string>")), "material_class": F.coalesce("material_class", F.array().cast("array<array<string>>")), "general_tolerances": F.coalesce("general_tolerances", F.array().cast("array<string>"))})


def nearest_class(df: DataFrame, materials: DataFrame, *, text_col: str, count=None) -> DataFrame:
    """``df`` plus nearest: names of the class with the best ratio, without a threshold; the text itself if none scores."""
    classes: dict[int, list[str]] = {}
    for c, _, name in _dictionary(materials, "class_id", "pos", "name"):
        classes.setdefault(c, []).append(name)
    groups = list(classes.values())

    named = Classes(groups)

    def run(text: str, tally: Tally) -> tuple:
        best = best_class(text, named, 0, tally)
        return (groups[best[0]] if best else [text],)

    return _on_distinct(df, text_col, run, "nearest array<string>", ["nearest"], count)


def norm_flags(numbers: DataFrame, norms: DataFrame, *, key: str = "drawing_id", list_col: str = "other_isos") -> DataFrame:
    """(key, norm vector): which known norms fuzzily match any number of a drawing.

    The known norm is the text and the drawing's number the word; letters of the norm are dropped first.
    """
    known = _dictionary(norms, "norm_id", "name")
    plain = ["".join(ch for ch in name if ch.isdigit() or ch == ".") for _, name in known]

    lowered = lower(plain)

    def run(number: str, _: Tally) -> tuple:
        near = lowered.index.candidates(number.lower(), 85).tolist()
        return ([i for i in near if last_match(plain[i], [number]) is not None],)

    # read twice, so kept: what the lists come from is worked out once
    numbers = stored(numbers.select(key, list_col), "numbers")
    exploded = numbers.select(key, F.explode(list_col).alias("_number"))
    flags = _on_distinct(exploded, "_number", run, "_near array<int>", ["_near"])
    places = flags.select(key, F.explode("_near").alias("_i")).groupBy(key).agg(F.collect_set("_i").alias("_set"))
    span = F.sequence(F.lit(0), F.lit(len(plain) - 1))
    vector = F.transform(span, lambda i: F.when(F.array_contains(F.coalesce("_set", F.array().cast("array<int>")), i), 1.0).otherwise(0.0))
    return numbers.select(key).distinct().join(places, key, "left").select(key, vector.alias("norm_vector"))


def greedy_matches(truth: list[str], found: list[str], cutoff: float, skipping: bool = False) -> int:
    """Number of matches of two lists of texts, first fit, each found text once.

    ``skipping``: the variant for materials. A truth goes on after a match, and the text behind a removed one is passed over.
    """
    left, hits = list(found), 0
    for t in truth:
        i = 0
        while i < len(left):
            if known_ratio(t, left[i]) > cutoff:
                hits += 1
                del left[i]
                if not skipping:
                    break
            i += 1
    return hits


def match_count(cutoff: float, spaceless: bool = True, skipping: bool = False):
    """Column function (truth list, found list) -> number of fuzzy matches."""

    @F.pandas_udf(T.IntegerType())
    def count(truth: pd.Series, found: pd.Series) -> pd.Series:
        def plain(x) -> list[str]:
            return [t.replace(" ", "") if spaceless else t for t in (x if x is not None else [])]

        return pd.Series([greedy_matches(plain(t), plain(f), cutoff, skipping) for t, f in zip(truth, found, strict=True)], dtype=np.int32)

    return count
