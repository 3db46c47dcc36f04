"""Helpers that several text operators share: shared-folder tables, words, shingles, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetforge.operators.components import connected_components, with_extremes  # noqa: F401
from sheetforge.scratch import dropped, shared_dir, stored  # noqa: F401
from sheetforge.shipping import ship

def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only, as the word definitions of the near-duplicate operators ask."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, with the package's code on the executors."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, or the first longer form of it that no column of ``df`` has."""
    have = {c.lower() for c in df.columns}
    while name in have:
        name = "_" + name
    return name


def hex_key(*parts: Column) -> Column:
    """128-bit key of the parts as hex text; the same in every engine that has md5."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def unit_hash(key: Column) -> Column:
    """Uniform number in [0, 1) from the first 13 hex digits (52 bits) of an md5 text."""
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def finite_rows(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows of a list column have exactly ``dims`` entries, none null or non-finite; the entries of those rows)."""
    right = np.asarray(column.value_lengths().fill_null(-1)) == dims
    x = column.filter(pa.array(right)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    good = np.isfinite(x).all(1)
    right[right] = good
    return right, x[good]


# ---------------------------------------------------------------------------------------------
# Word shingles, vectorised over the bytes of one text

_MIX = np.uint64(0xD6E8FEB86659FD93)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20_240_601).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_powers = np.cumprod(np.full(64, _STEP, dtype=np.uint64))


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a linear 64-bit hash over all bits."""
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(32))


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hash of each white-space separated word (\\x20, \\x09-\\x0D) of lower-cased UTF-8 bytes."""
    global _powers
    words = data.split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    flat = np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8)
    ends = np.flatnonzero(flat == 32)
    starts = np.empty_like(ends)
    starts[0] = 0
    starts[1:] = ends[:-1] + 1
    size = ends - starts + 1
    longest = int(size.max())
    if longest > len(_powers):
        _powers = np.cumprod(np.full(max(longest, 2 * len(_powers)), _STEP, dtype=np.uint64))
    values = _BYTE[flat] * _powers[np.arange(len(flat)) - np.repeat(starts, size)]
    return mix64(np.add.reduceat(values, starts))


def shingle_hashes(text: str | None, k: int = 5) -> np.ndarray:
    """Hashes of the k-word shingles of a text in order; a shorter text is one shingle, no word gives none."""
    words = word_hashes(text.encode("utf-8", "surrogatepass").lower()) if text else np.empty(0, dtype=np.uint64)
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    h = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        h = h * _STEP + words[i : i + n]
    return mix64(h + np.uint64(k))
