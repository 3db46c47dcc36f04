"""Benchmark decontamination with a distributed positional inverted index.

Postings of the training corpus are kept as rows (term, row, position). A phrase is found by starting from
the postings of its rarest term, shifting them by the term's offset in the phrase, and
intersecting with the equally shifted postings of its other terms.

The corpus is read once. With a vocabulary of the phrases, a task keeps only postings that can take part in a
match: a phrase of L terms needs L neighbouring words that all occur in phrases of L terms. This loses
nothing and leaves a small part of the postings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetforge.llm.common import stored

#: Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SALTS = 16
_SEPARATORS = bytes(32 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8 bytes; none for null."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_SEPARATORS).split() if text else []


def phrase_windows(items: DataFrame, width: int, *, id_col: str, text_col: str) -> DataFrame:
    """(item, start, terms): every window of ``width`` consecutive words of each item; an item with
    fewer words, but not none, is one window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item, start, terms = [], [], []
            for i, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                words = [w.decode("utf-8", "surrogatepass") for w in words_of(text)]
                for s in range(max(1, len(words) - width + 1) if words else 0):
                    item.append(i)
                    start.append(s)
                    terms.append(words[s : s + width])
            yield pa.RecordBatch.from_arrays([pa.array(item, batch.schema.field(0).type), pa.array(start, pa.int32()), pa.array(terms, pa.list_(pa.string()))], names=["item", "start", "terms"])

    kind = items.schema[id_col].dataType.simpleString()
    return items.select(id_col, text_col).mapInArrow(cut, f"item {kind}, start int, terms array<string>")


def _runs(mask: np.ndarray, least: int) -> np.ndarray:
    """``mask`` without its runs of True shorter than ``least``."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    begin, end = edge[::2], edge[1::2]
    out = np.zeros(len(mask), dtype=bool)
    for b, e in zip(begin, end, strict=True):
        if e - b >= least:
            out[b:e] = True
    return out


def build_index(docs: DataFrame, vocabulary: dict[str, int] | None = None, *, id_col: str, text_col: str) -> DataFrame:
    """Segments of the index: (row, doc, n_words, terms array<string>, positions array<int>).

    One row per document, also for texts without words; terms[i] stands at positions[i]. ``vocabulary``
    maps a term to a bit set of phrase lengths (bit L: it occurs in a phrase of L terms); with it only postings
    in runs that a phrase could fill are kept. Without it all postings are. ``row`` numbers the rows, so that
    repeated or null ids stay apart.
    """
    vocab = None if vocabulary is None else {k.encode("utf-8", "surrogatepass"): v for k, v in vocabulary.items()}
    lengths = [] if vocab is None else [n for n in range(1, 63) if any(v >> n & 1 for v in vocab.values())]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, terms, positions = [], [], []
            for text in batch[2].to_pylist():
                words = words_of(text)
                n_words.append(len(words))
                if vocab is None:
                    keep = range(len(words))
                else:
                    get = vocab.get
                    bits = np.fromiter([get(w, 0) for w in words], dtype=np.int64, count=len(words))
                    mask = np.zeros(len(words), dtype=bool)
                    for n in lengths:
                        can = (bits >> n & 1).astype(bool)
                        if np.count_nonzero(can) >= n:
                            mask |= _runs(can, n)
                    keep = np.flatnonzero(mask).tolist()
                positions.append(keep)
                terms.append([words[i].decode("utf-8", "surrogatepass") for i in keep])
            yield pa.RecordBatch.from_arrays(
                [batch[0], batch[1], pa.array(n_words, pa.int64()), pa.array(terms, pa.list_(pa.string())), pa.array(positions, pa.list_(pa.int32()))],
                names=["row", "doc", "n_words", "terms", "positions"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc"), text_col)
    return rows.mapInArrow(index, f"row long, doc {kind}, n_words long, terms array<string>, positions array<int>")


def postings(segments: DataFrame) -> DataFrame:
    """(term, row, position) of an index."""
    return segments.select("row", F.explode(F.arrays_zip("terms", "positions")).alias("p")).select(F.col("p.terms").alias("term"), "row", F.col("p.positions").alias("position"))


def phrase_matches(index: DataFrame, windows: DataFrame) -> DataFrame:
    """(window, row, begin): every exact occurrence of each window in the index.

    ``index`` is postings, ``windows`` has (window, terms). Starts from each window's rarest term
    (by postings; first in the window on ties), then intersects with the others at their offsets.
    """
    slots = windows.select("window", F.size("terms").alias("length"), F.posexplode("terms").alias("offset", "term"))
    wanted = slots.select("term").distinct()
    # a table of its own, so that Spark can split a term that many windows have when it joins the counts
    counts = stored(index.groupBy("term").agg(F.count("*").alias("n")).join(wanted, "term", "left_semi"), "counts")
    # a window with a term that has no posting cannot match
    ranked = slots.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order = Window.partitionBy("window").orderBy("n", "offset")
    ranked = ranked.withColumn("place", F.row_number().over(order)).withColumn("least", F.min("n").over(Window.partitionBy("window"))).where("least > 0")
    first = ranked.where("place = 1").select("window", "length", "term", "offset")
    rest = ranked.where("place > 1").select("window", "term", "offset")
    # a frequent term's postings are dealt to several tasks
    salted = first.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    start = index.withColumn("_salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(salted, ["term", "_salt"]).select("window", "row", (F.col("position") - F.col("offset")).alias("begin"), "length").where("begin >= 0")
    need = start.join(rest, "window", "left").select("window", "row", "begin", "length", "term", (F.col("begin") + F.col("offset")).alias("position"))
    alone = need.where("term is null").select("window", "row", "begin")
    met = (
        need.where("term is not null")
        .join(index, ["term", "row", "position"])
        .groupBy("window", "row", "begin", "length")
        .agg(F.count("*").alias("met"))
        .where("met = length - 1")
        .select("window", "row", "begin")
    )
    return met.unionByName(alone)


def proximity_matches(index: DataFrame, queries: DataFrame, slop: int) -> DataFrame:
    """(query, row, begin, end): documents where all distinct terms of a query occur within ``slop`` words.

    ``queries`` has (query, terms). Starts from the rarest term's postings; for each of them the nearest
    posting of every other term is looked up. One row per rarest-term posting that has all
    others within ``slop`` positions of it; begin and end span the nearest ones.
    """
    slots = queries.select("query", F.explode(F.array_distinct("terms")).alias("term"))
    counts = index.groupBy("term").agg(F.count("*").alias("n")).join(slots.select("term").distinct(), "term", "left_semi")
    ranked = slots.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    per = Window.partitionBy("query")
    ranked = ranked.withColumn("place", F.row_number().over(per.orderBy("n", "term"))).withColumn("terms", F.count("*").over(per)).withColumn("least", F.min("n").over(per)).where("least > 0")
    anchor = index.join(ranked.where("place = 1").select("query", "term", "terms"), "term").select("query", "row", "terms", F.col("position").alias("at"))
    need = anchor.join(ranked.where("place > 1").select("query", "term"), "query", "left")
    single = need.where("term is null").select("query", "row", F.col("at").alias("begin"), F.col("at").alias("end"))
    near = (
        need.where("term is not null")
        .join(index, ["term", "row"])
        .where(F.abs(F.col("position") - F.col("at")) <= slop)
        .groupBy("query", "row", "terms", "at", "term")
        .agg(F.min_by("position", F.struct(F.abs(F.col("position") - F.col("at")), "position")).alias("position"))
        .groupBy("query", "row", "terms", "at")
        .agg(F.count("*").alias("met"), F.min("position").alias("low"), F.max("position").alias("high"))
        .where("met = terms - 1")
        .select("query", "row", F.least("at", "low").alias("begin"), F.greatest("at", "high").alias("end"))
    )
    return near.unionByName(single)


def decontaminate(docs: DataFrame, items: DataFrame, *, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", vocabulary_limit: int = 2_000_000) -> DataFrame:
    """Overlap of each document with benchmark items.

    Returns one row per row of ``docs``: doc, n_words, n_hit (words inside any occurrence of a window),
    items (array of item ids whose windows occur, sorted as strings, as strings), row.
    A null or wordless text has no words and no hit; a null item text has no window; repeated documents or items count
    like any other. Other columns are ignored.

    The vocabulary of the benchmark prunes the postings. It is sent to the tasks only up to ``vocabulary_limit``
    terms; beyond that the index keeps all postings, with the same result.
    """
    windows = stored(phrase_windows(items, width, id_col=item_id, text_col=item_text), "windows")
    numbered = stored(windows.select("terms").distinct().select(F.monotonically_increasing_id().alias("window"), "terms"), "phrases")
    terms = numbered.select(F.size("terms").alias("n"), F.explode("terms").alias("term")).groupBy("term").agg(F.expr("bit_or(shiftleft(1L, n))").alias("bits"))
    known = terms.limit(vocabulary_limit + 1).collect()
    vocabulary = {r["term"]: r["bits"] for r in known} if len(known) <= vocabulary_limit and width < 62 else None
    segments = stored(build_index(docs, vocabulary, id_col=id_col, text_col=text_col), "segments")
    index = stored(postings(segments), "postings")
    hits = stored(phrase_matches(index, numbered), "hits").join(numbered.select("window", F.size("terms").alias("length"), "terms"), "window")
    words = (
        hits.select("row", F.explode(F.sequence(F.col("begin"), F.col("begin") + F.col("length") - 1)).alias("position"))
        .distinct()
        .groupBy("row")
        .agg(F.count("*").alias("n_hit"))
    )
    names = windows.select("terms", F.col("item").cast("string").alias("item")).distinct()
    found = (
        hits.select("row", "terms").distinct().join(names, "terms").select("row", "item").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    )
    return (
        segments.select("row", "doc", "n_words")
        .join(words, "row", "left")
        .join(found, "row", "left")
        .select("row", "doc", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    )
