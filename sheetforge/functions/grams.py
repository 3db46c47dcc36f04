"""Which words of a dictionary can match a text at all: an index of letter pairs with a bound on the partial ratio.

Let a be the shorter of two texts, of n letters, and w the window of the longer one that gives a ratio of at least c, with L letters in common: 200 L >=
c (n + |w|). A letter of a that isn't matched spoils at most two of a's n - 1 letter pairs, a letter of w that isn't matched at most one. So at
least n - 1 - 2 (n - L) - (|w| - L) of a's pairs stand in the longer text. Words with fewer are left out before any alignment; no match is lost.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from functools import lru_cache

import numpy as np


@lru_cache(maxsize=100_000)
def pairs_needed(n: int, cutoff: float) -> int:
    """Letter pairs of a text of n letters that must stand in a longer one for a partial ratio of at least ``cutoff``; 0 or less: no bound."""
    least = n
    for window in range(1, n + 1):
        common = max(0, int(np.ceil(cutoff * (n + window) / 200 - 1e-9)))
        if common <= window:
            least = min(least, n - 1 - 2 * (n - common) - (window - common))
    return least


def letter_pairs(text: str) -> list[str]:
    return [text[i : i + 2] for i in range(len(text) - 1)]


class PairIndex:
    """Postings of the letter pairs of a list of words."""

    def __init__(self, words: tuple[str, ...]) -> None:
        self.lengths = np.array([len(w) for w in words], dtype=np.int64)
        listed: dict[str, list[int]] = {}
        for i, word in enumerate(words):
            for pair in letter_pairs(word):
                listed.setdefault(pair, []).append(i)
        # a word stands as often as it has the pair; ``once``: one time
        self.every = {pair: np.array(at, dtype=np.int32) for pair, at in listed.items()}
        self.once = {pair: np.unique(at) for pair, at in self.every.items()}
        self._needed: dict[float, np.ndarray] = {}

    def needed(self, cutoff: float) -> np.ndarray:
        """``pairs_needed`` of each word."""
        if cutoff not in self._needed:
            if len(self._needed) > 64:
                self._needed.clear()
            each = {n: pairs_needed(int(n), cutoff) for n in np.unique(self.lengths)}
            self._needed[cutoff] = np.array([each[n] for n in self.lengths], dtype=np.int64)
        return self._needed[cutoff]

    def shared(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(pairs of each word that stand in the text, pairs of the text that stand in each word)."""
        own = Counter(letter_pairs(text))
        met = [(self.every[pair], self.once[pair], times) for pair, times in own.items() if pair in self.every]
        n = len(self.lengths)
        if not met:
            return np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        here = np.bincount(np.concatenate([every for every, _, _ in met]), minlength=n)
        weights = np.repeat([times for _, _, times in met], [len(once) for _, once, _ in met])
        there = np.bincount(np.concatenate([once for _, once, _ in met]), weights=weights, minlength=n)
        return here, there

    def candidates(self, text: str, cutoff: float, shared: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Numbers of the words whose partial ratio with the text can be ``cutoff`` or more, ascending."""
        here, there = shared or self.shared(text)
        n = len(text)
        return np.flatnonzero((self.lengths <= n) & (here >= self.needed(cutoff)) | (self.lengths >= n) & (there >= pairs_needed(n, cutoff)))


class Words:
    """A list of words with its index, which each process builds once, when first asked for."""

    _built: dict[str, PairIndex] = {}

    def __init__(self, words: list[str]) -> None:
        self.words = list(words)
        self.key = hashlib.sha256("\0".join(self.words).encode("utf-8", "surrogatepass")).hexdigest() + f"-{len(self.words)}"

    def __len__(self) -> int:
        return len(self.words)

    @property
    def index(self) -> PairIndex:
        if self.key not in Words._built:
            if len(Words._built) >= 8:
                Words._built.clear()
            Words._built[self.key] = PairIndex(tuple(self.words))
        return Words._built[self.key]
