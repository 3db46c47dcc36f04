"""Byte-level BPE by a segment tree over the ranks of adjacent pairs.

A piece of text is a row of byte symbols. Leaf i of the tree holds the rank of the pair that starts at symbol i, with i itself
below it, so the least leaf is the leftmost pair of the lowest rank, and the root holds it. A merge changes three leaves: the pair
itself, the one before it and the one that goes; each is a walk from the leaf to the root. The piece is done when the root holds no
rank. A piece of n bytes takes O(n log n) steps whatever its merges, so texts without a blank are no worse than others. The short pieces of
many texts go through their trees side by side, a merge of each at a time.
"""

from __future__ import annotations

import hashlib
import json
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetforge.llm.common import unused
from sheetforge.llm.training_order import PATTERN

#: A vocabulary file goes to all executors; no file of a public tokenizer is near this size.
FILE_BYTES = 64 << 20
#: Pieces up to so many bytes are remembered by a worker, so many of them; then it starts anew.
SHORT, REMEMBERED = 32, 300_000
#: So many characters of text are split at a time, and so many pieces are merged side by side.
SPLIT_CHARS, SIDE_BY_SIDE = 2_000_000, 20_000
_NONE = 1 << 62

# Letters and numbers of Unicode 17 and 18, which the splits of published vocabularies don't know; they count as signs.
LATER_LETTERS = (
    r"\u0558\u058B-\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F\uA7CE-\uA7CF\uA7D2\uA7D4\uA7DD\uA7E2\uA7F1\uAB6C-\uAB6D\U000107BB-\U000107BF"
    r"\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A\U00011DB0-\U00011DDB\U00011DF1\U00016EA0-\U00016EB8"
    r"\U00016EBB-\U00016ED3\U00016FF2-\U00016FF3\U000187F8-\U000187FF\U00018CD6-\U00018CDA\U00018D09-\U00018D20\U00018D80-\U00018DF2"
    r"\U00018E00-\U00019191\U000191A0-\U000191D2\U0001B123-\U0001B128\U0001B168\U0001D6A6\U0001DF1F-\U0001DF24\U0001DF2B-\U0001DF81"
    r"\U0001DF90-\U0001DF96\U0001DFCD-\U0001DFFF\U0001E6C0-\U0001E6DE\U0001E6E0-\U0001E6E2\U0001E6E4-\U0001E6E5\U0001E6E7-\U0001E6ED"
    r"\U0001E6F0-\U0001E6F4\U0001E6FE-\U0001E6FF\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD\U000323B0-\U00033479\U0003D000-\U0003FC3F"
)
LATER_NUMBERS = r"\U00011DE0-\U00011DE9\U0001246F\U00012475-\U0001247F\U00012550-\U00012686\U00016FF4-\U00016FF6"
_LATER = regex.compile(f"[{LATER_LETTERS}{LATER_NUMBERS}]")
_PIECES = regex.compile(PATTERN)
_PIECES_WITH_LATER = regex.compile(
    rf"(?V1)'(?:[sdmt]|ll|ve|re)| ?[\p{{L}}--[{LATER_LETTERS}]]+| ?[\p{{N}}--[{LATER_NUMBERS}]]+| ?[[^\s\p{{L}}\p{{N}}]||[{LATER_LETTERS}{LATER_NUMBERS}]]+|\s+(?!\S)|\s+"
)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next free one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def _set_leaf(tree: list[int], at: int, value: int) -> None:
    """Writes a leaf and renews the minima above it, as far as they change."""
    tree[at] = value
    while at > 1:
        other = tree[at ^ 1]
        if other < value:
            value = other
        at >>= 1
        if tree[at] == value:
            return
        tree[at] = value


def merge_symbols(symbols: list[int], merges: dict[int, int], width: int) -> list[int]:
    """The symbols after all merges: always the leftmost pair of the lowest rank.

    Symbols are numbers below ``width``; ``merges`` has a * width + b -> rank * width + merged symbol. A leaf holds that value above
    the pair's place, so the root tells rank, symbol and place.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    out, get = list(symbols), merges.get
    size = 1 << (n - 2).bit_length()
    bits = n.bit_length()
    place = (1 << bits) - 1
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        found = get(out[i] * width + out[i + 1])
        if found is not None:
            tree[size + i] = found << bits | i
    for at in range(size - 1, 0, -1):
        left, right = tree[2 * at], tree[2 * at + 1]
        tree[at] = left if left < right else right
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (top := tree[1]) != _NONE:
        i = top & place
        j = after[i]
        k = after[j]
        merged = out[i] = (top >> bits) % width
        out[j] = -1
        after[i] = k
        found = None
        if k < n:
            before[k] = i
            found = get(merged * width + out[k])
            _set_leaf(tree, size + j, _NONE)
        _set_leaf(tree, size + i, _NONE if found is None else found << bits | i)
        h = before[i]
        if h >= 0:
            found = get(out[h] * width + merged)
            value = _NONE if found is None else found << bits | h
            if tree[size + h] != value:
                _set_leaf(tree, size + h, value)
    return [s for s in out if s >= 0]


def _packed(ids: list[int]) -> bytes:
    data = array("I", ids)
    if sys.byteorder != "little":
        data.byteswap()
    return data.tobytes()


def merge_rows(symbols: np.ndarray, lookup) -> np.ndarray:
    """``merge_symbols`` for the rows of an array, each padded with -1: all trees take their next merge at the same time.

    ``lookup(a, b)`` gives (rank and merged symbol in one number, merged symbol) of pairs, _NONE where there is no merge. The result has -1 where
    symbols are gone.
    """
    rows, n = symbols.shape
    out = np.full((rows, n + 1), -1, dtype=np.int64)
    out[:, :n] = symbols
    size = 1 << (n - 1).bit_length()
    bits = n.bit_length()
    tree = np.full((rows, 2 * size), _NONE, dtype=np.int64)
    merged = np.full((rows, n), -1, dtype=np.int64)  # the symbol that the pair at a place makes

    def leaves(at, left, right):
        ranks, made = lookup(left, right)
        return np.where(ranks == _NONE, _NONE, ranks << bits | at), made

    tree[:, size : size + n], merged[:] = leaves(np.arange(n), out[:, :n], out[:, 1:])
    for level in range(size.bit_length() - 2, -1, -1):
        low = 1 << level
        np.minimum(tree[:, 2 * low : 4 * low : 2], tree[:, 2 * low + 1 : 4 * low : 2], out=tree[:, low : 2 * low])
    after = np.tile(np.arange(1, n + 2), (rows, 1))
    before = np.tile(np.arange(-1, n), (rows, 1))
    live = np.flatnonzero(tree[:, 1] != _NONE)
    while len(live):
        i = tree[live, 1] & ((1 << bits) - 1)
        j = after[live, i]
        k = after[live, j]
        new = merged[live, i]
        out[live, i], out[live, j] = new, -1
        after[live, i], before[live, k] = k, i
        h = before[live, i]
        tree[live, size + j] = _NONE
        tree[live, size + i], merged[live, i] = leaves(i, new, out[live, k])
        value, made = leaves(h, out[live, h], new)
        first = h < 0
        h = np.where(first, j, h)  # no pair before: the leaf that is empty now is written again
        tree[live, size + h] = np.where(first, _NONE, value)
        merged[live, h] = made
        for at in (size + h, size + i, size + j):
            while at[0] > 1:
                at = at >> 1
                tree[live, at] = np.minimum(tree[live, 2 * at], tree[live, 2 * at + 1])
        live = live[tree[live, 1] != _NONE]
    return out[:, :n]


class ByteBpe:
    """A byte-level BPE vocabulary read from the JSON text of a tokenizer file.

    Files that ask for anything else (normalizers, other splits, prefix spaces, fused unknowns, stripping added tokens)
    raise ValueError rather than give other ids.
    """

    def __init__(self, text: str) -> None:
        file = json.loads(text)
        model, split, decoder = file["model"], file.get("pre_tokenizer") or {}, file.get("decoder") or {}
        odd = [k for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges", "dropout") if model.get(k)]
        odd += [] if split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") else ["pre_tokenizer"]
        odd += [] if decoder.get("type") == "ByteLevel" else ["decoder"]
        odd += ["normalizer"] if file.get("normalizer") else []
        added = file.get("added_tokens") or []
        odd += [k for k in ("single_word", "lstrip", "rstrip", "normalized") if any(t.get(k) for t in added)]
        if model.get("type") != "BPE" or odd:
            raise ValueError(f"not a plain byte-level BPE file: {', '.join(odd) or model.get('type')}")
        ids, shown = model["vocab"], byte_symbols()
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        self.width = max(ids.values()) + 1
        self.merges = {ids[a] * self.width + ids[b]: rank * self.width + ids[a + b] for rank, (a, b) in reversed(list(enumerate(pairs)))}
        keys = np.array([*self.merges, 1 << 61], dtype=np.int64)
        self.order = np.argsort(keys)
        self.keys, self.made = keys[self.order], np.array([*self.merges.values(), _NONE], dtype=np.int64)[self.order]
        self.of_byte = [ids[s] for s in shown]
        values = {s: bytes([b]) for b, s in enumerate(shown)}
        self.bytes_of = {i: b"".join(values[c] for c in s) if all(c in values for c in s) else s.encode() for s, i in [*ids.items(), *((t["content"], t["id"]) for t in added)]}
        self.added = {t["content"]: t["id"] for t in added if t["content"]}
        # leftmost, and the longest of those that start there
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.added, key=lambda s: (-len(s), s)))) if self.added else None
        self.seen: dict[str, bytes] = {}

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = np.where((left < 0) | (right < 0), -1, left * self.width + right)
        at = np.searchsorted(self.keys, key)
        value = np.where(self.keys[at] == key, self.made[at], _NONE)
        return np.where(value == _NONE, _NONE, value // self.width), value % self.width

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces, packed: the short ones of like length side by side, the long ones one by one."""
        ids, kinds, of_byte = {}, {}, np.array(self.of_byte, dtype=np.int64)
        for piece in pieces:
            data = piece.encode("utf-8", "replace")
            if len(data) > SHORT:
                ids[piece] = _packed(merge_symbols([self.of_byte[b] for b in data], self.merges, self.width))
            else:
                kinds.setdefault(max(4, 1 << (len(data) - 1).bit_length()), []).append((piece, data))
        for n, rows in kinds.items():
            for at in range(0, len(rows), SIDE_BY_SIDE):
                some = rows[at : at + SIDE_BY_SIDE]
                flat = np.frombuffer(b"".join(data.ljust(n, b"\0") for _, data in some), dtype=np.uint8).reshape(-1, n)
                used = np.arange(n) < np.array([len(data) for _, data in some])[:, None]
                out = merge_rows(np.where(used, of_byte[flat], -1), self._lookup)
                left = out >= 0
                packed, ends = out[left].astype("<u4").tobytes(), np.cumsum(left.sum(1) * 4).tolist()
                ids |= {piece: packed[a:b] for (piece, _), a, b in zip(some, [0, *ends], ends)}
        return ids

    def encode_all(self, texts: Iterator[str]) -> Iterator[bytes]:
        """Token ids of each text, four bytes each, little-endian; an added token's own text is its id."""
        held: list[list] = []
        chars = 0
        for text in texts:
            parts: list = []
            at = 0
            for found in self.cut.finditer(text) if self.cut else ():
                parts += [self._split(text[at : found.start()]), _packed([self.added[found[0]]])]
                at = found.end()
            held.append([*parts, self._split(text[at:])])
            chars += len(text)
            if chars > SPLIT_CHARS:
                yield from self._ids(held)
                held, chars = [], 0
        yield from self._ids(held)

    def encode(self, text: str) -> bytes:
        """Token ids of one text, as in ``encode_all``."""
        return next(self.encode_all(iter([text])))

    @staticmethod
    def _split(text: str) -> list[str]:
        pieces = _PIECES_WITH_LATER if not text.isascii() and _LATER.search(text) else _PIECES
        return pieces.findall(text)

    def _ids(self, held: list[list]) -> Iterator[bytes]:
        wanted = {piece for parts in held for part in parts if isinstance(part, list) for piece in part}
        new = wanted - self.seen.keys()
        if len(self.seen) + len(new) > REMEMBERED:
            self.seen = {piece: self.seen[piece] for piece in wanted - new}
        self.seen |= self._learn(new)
        get = self.seen.__getitem__
        for parts in held:
            yield b"".join([b"".join(map(get, part)) if isinstance(part, list) else part for part in parts])
        for piece in new:
            if len(piece) > SHORT:
                del self.seen[piece]

    def decode(self, ids: bytes) -> str:
        """The text of packed token ids; ids outside the vocabulary are left out, bytes that are no UTF-8 become U+FFFD."""
        get = self.bytes_of.get
        return b"".join([get(i, b"") for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_loaded: dict[bytes, ByteBpe] = {}


def _vocabulary(spark: SparkSession, path: str):
    """The file's bytes, read on the driver and sent to the executors once."""
    with open(path, "rb") as f:
        data = f.read(FILE_BYTES + 1)
    if len(data) > FILE_BYTES:
        raise ValueError(f"{path} is larger than {FILE_BYTES} bytes")
    _model(data)  # a file that can't be used fails here
    return spark.sparkContext.broadcast(data)


def _model(data: bytes) -> ByteBpe:
    """The process's vocabulary for a file's bytes; later tasks find it loaded, with the pieces it has seen."""
    key = hashlib.sha256(data).digest()
    if key not in _loaded:
        _loaded[key] = ByteBpe(data.decode("utf-8"))
    return _loaded[key]


def _mapped(df: DataFrame, source: str, name: str, kind: str, convert, file, carry: list[str] | None) -> DataFrame:
    """The columns ``carry`` of ``df`` (default: all) plus column ``name`` (an earlier one of that name goes), made by ``convert(vocabulary, values)`` from the bytes of ``source``, in Arrow batches."""
    kept = [c for c in (df.columns if carry is None else carry) if c.lower() != name.lower()]
    given = unused(df, "given_")
    schema = df.select(*kept).withColumn(name, F.lit(None).cast(kind)).schema
    arrow = {"binary": pa.binary(), "string": pa.string()}[kind]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(file.value)
        for part in parts:
            values = part.column(part.schema.get_field_index(given))
            made = pa.array(convert(model, (v.as_py() or b"" for v in values)), arrow, size=len(values))
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), made], [*kept, name])

    return df.select(*kept, F.col(source).cast("binary").alias(given)).mapInArrow(batches, schema)


def encode(docs: DataFrame, tokenizer: str, *, text_col: str = "text", ids_col: str = "ids", carry: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``carry``; default: all) plus ``ids_col``: token ids of each whole text, binary, four bytes each, little-endian.

    ``tokenizer`` is a JSON file of a byte-level BPE that the driver can read. A null or empty text has no ids (an empty value, never null). All
    rows are kept: repeated ones and those with null ids get their own value; columns may have any names, but one called ``ids_col`` is
    replaced. An empty table gives an empty one. A text is taken whole, whatever its length; ties of rank go to the left.
    """
    file = _vocabulary(docs.sparkSession, tokenizer)
    return _mapped(docs, text_col, ids_col, "binary", lambda model, values: model.encode_all(v.decode("utf-8", "replace") for v in values), file, carry)


def decode(rows: DataFrame, tokenizer: str, *, ids_col: str = "ids", text_col: str = "decoded", carry: list[str] | None = None) -> DataFrame:
    """``rows`` plus ``text_col``: the text of the ids in ``ids_col`` (as ``encode`` gives them), special tokens included.

    Null and empty ids give an empty text; ids outside the vocabulary are left out; bytes that are no UTF-8 become U+FFFD. Other columns stay
    as in ``encode``.
    """
    file = _vocabulary(rows.sparkSession, tokenizer)
    return _mapped(rows, ids_col, text_col, "string", lambda model, values: map(model.decode, values), file, carry)
