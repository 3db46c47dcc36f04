"""N-gram Jaccard join by signature trees.

Documents are sets of word shingles. Two are linked when their Jaccard similarity reaches a threshold t.
The result is the linked components, exact, without listing all pairs of a group of copies.

1. *Order.* A fixed-size sketch counts shingles over the whole corpus. Shingles are ordered by how far
   their counter stands above the mean, then by hash; those of passages that many documents share come last.
2. *Blocks.* Sets with similarity >= t share a shingle among the first n - ceil(t n) + 1 of their order
   (prefix filter), so each such shingle that several sets have is a block, and no link is outside all blocks.
3. *Hubs.* Each member of a block is tested against the block's smallest member; the links found give first
   components. Pairs inside one component need no further test.
4. *Signature trees.* Every block that still joins several components becomes a tree: leaves hold up to FAN members
   of like size and component, inner nodes the OR of their token bitmaps, their size range and collision slack. A dual traversal from the root
   down drops node pairs whose maximum possible overlap is below what the smallest sizes would need, and those inside one component; at the
   leaves sizes and then the members' own bitmaps drop single pairs. Surviving pairs are verified on the full sets.

No key gathers rows: minima over hot keys are taken in two steps (``with_extremes``), hubs with many pairs are dealt to
several tasks, and large blocks are numbered in chunks.

Bounds never drop a link: common shingles set common bits, and shingles that fall on an occupied
bit are counted as slack.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheetforge.llm.common import connected_components, dropped, mix64, shingle_hashes, stored, unused, with_extremes

SKETCH_BITS = 18
SLICES = 64
LEAST_WIDTH = 2048  # bits of a document's bitmap
TREE_WIDTH = 1024  # bits of the bitmaps in trees: members' ones folded
FAN = 32
CHUNK = 256  # members of a block that are numbered together
MOST_IDS = 8_000_000  # ids that a filter of bounded size tells apart well; more are joined
SALTS = 64
HOT_LEVEL = 10  # a counter about 1,000 above what is usual


# ---------------------------------------------------------------------------------------------
# Shingle order


def shingle_levels(docs: DataFrame, text_col: str, k: int) -> np.ndarray:
    """Level of each of 2**SKETCH_BITS counters: 0 for usual load, else the log of the excess.

    Each task counts its own texts; slices of the counters are summed by streaming over them. The result's
    size is fixed, so it may go to the driver and back.
    """
    size, each = 1 << SKETCH_BITS, (1 << SKETCH_BITS) // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for text in batch[0].to_pylist():
                h = shingle_hashes(text, k)
                if len(h):
                    np.add.at(total, (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([total[i * each : (i + 1) * each].tobytes() for i in range(SLICES)], pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            for s, counts in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                if s != at:
                    if at is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slice", "counts"])
                    at, total = s, np.zeros(each, dtype=np.int64)
                total += np.frombuffer(counts, dtype=np.int64)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slice", "counts"])

    schema = "slice int, counts binary"
    parts = docs.select(text_col).mapInArrow(count, schema).repartition("slice").sortWithinPartitions("slice").mapInArrow(add, schema)
    total = np.zeros(size, dtype=np.int64)
    for row in parts.collect():
        total[row["slice"] * each : (row["slice"] + 1) * each] += np.frombuffer(row["counts"], dtype=np.int64)
    mean = total.mean()
    return np.floor(np.log2(np.maximum(total - mean - 3 * np.sqrt(mean), 0) + 1)).astype(np.uint8)


# ---------------------------------------------------------------------------------------------
# Signatures


def _bitmap(h: np.ndarray, width: int) -> bytes:
    """Bits of the set at h mod width."""
    bits = np.zeros(width, dtype=np.uint8)
    bits[(h & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: int, width: int, to: int) -> int:
    """OR of the parts of a bitmap, down to a smaller width."""
    while width > to:
        width >>= 1
        bits = (bits >> width) | (bits & ((1 << width) - 1))
    return bits


def needed(n_a: int, n_b: int, percent: int) -> int:
    """Least overlap at which two sets of these sizes are linked."""
    return -(-percent * (n_a + n_b) // (100 + percent))


def _width(n: int, each: int, least: int) -> int:
    """Power of two of at least ``each`` bits for each of n members, and ``least``."""
    return max(least, 1 << (each * n - 1).bit_length())


def could_link(n_a: int, bits_a: bytes, n_b: int, bits_b: bytes, percent: int) -> bool:
    """Whether the maximum possible overlap by size and bitmap reaches the needed one."""
    if min(n_a, n_b) < needed(n_a, n_b, percent):
        return False
    width = 8 * min(len(bits_a), len(bits_b))
    a = folded(int.from_bytes(bits_a, "little"), 8 * len(bits_a), width)
    b = folded(int.from_bytes(bits_b, "little"), 8 * len(bits_b), width)
    slack = min(n_a - a.bit_count(), n_b - b.bit_count())
    return (a & b).bit_count() + slack >= needed(n_a, n_b, percent)


def signatures(docs: DataFrame, levels: np.ndarray, *, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """(doc, n, key_a, key_b, bits, small, prefix): set size, 128-bit key of the set, bitmap of at least 4 bits
    for each member, the same folded to TREE_WIDTH, first shingles in the order."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 256):  # long texts: keep results of a few rows at a time
                batch = whole.slice(start, 256)
                size, key_a, key_b, bits, small, prefix = [], [], [], [], [], []
                for text in batch[1].to_pylist():
                    h = np.unique(shingle_hashes(text, k))
                    n = len(h)
                    size.append(n)
                    if not n:
                        key_a.append(None)
                        key_b.append(None)
                        bits.append(None)
                        small.append(None)
                        prefix.append([])
                        continue
                    again = mix64(h ^ np.uint64(0x5851F42D4C957F2D))
                    key_a.append(int(np.add.reduce(again).view(np.int64)))
                    key_b.append(int(np.bitwise_xor.reduce(mix64(again)).view(np.int64)))
                    bits.append(_bitmap(h, _width(n, 4, LEAST_WIDTH)))
                    small.append(_bitmap(h, TREE_WIDTH))
                    level = levels[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    first = n - -(-percent * n // 100) + 1
                    prefix.append(h[np.argsort(level, kind="stable")[:first]].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch[0].cast(pa.int64()), pa.array(size, pa.int64()), pa.array(key_a, pa.int64()), pa.array(key_b, pa.int64()), pa.array(bits, pa.binary()), pa.array(small, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))],
                    names=["doc", "n", "key_a", "key_b", "bits", "small", "prefix"],
                )

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(sign, "doc long, n long, key_a long, key_b long, bits binary, small binary, prefix array<long>")


# ---------------------------------------------------------------------------------------------
# Verification


def _places(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix64(ids.astype(np.int64).view(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    return (h & np.uint64(bits - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def id_filter(ids: DataFrame) -> np.ndarray | None:
    """Bloom filter (packed bits) of the ids of a one-column table, 16 bits an id; None for more than MOST_IDS ids.

    Its size is bounded, so it may go through the driver; ids that it lets pass wrongly are dealt with by the joins behind it.
    """
    n = ids.count()
    if n > MOST_IDS:
        return None
    bits = max(1 << 16, 1 << (16 * n - 1).bit_length())
    each = bits // SLICES

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits, dtype=bool)
        for batch in batches:
            for at in _places(batch[0].to_numpy(), bits):
                own[at] = True
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([np.packbits(own[i * each : (i + 1) * each]).tobytes() for i in range(SLICES)], pa.binary())], names=["slice", "marks"])

    def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, marks in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                found[s] = found.get(s, np.uint8(0)) | np.frombuffer(marks, dtype=np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], names=["slice", "marks"])

    out = np.zeros(bits, dtype=bool)
    schema = "slice int, marks binary"
    for row in ids.mapInArrow(mark, schema).repartition("slice").mapInArrow(either, schema).collect():
        out[row["slice"] * each : (row["slice"] + 1) * each] |= np.unpackbits(np.frombuffer(row["marks"], dtype=np.uint8)).astype(bool)
    return np.packbits(out)


def _maybe(bits: np.ndarray):
    """Column function: whether the filter can't rule an id out; false for null."""

    @F.pandas_udf("boolean")
    def test(key: pd.Series) -> pd.Series:
        have = np.unpackbits(bits).astype(bool)
        one, two = _places(key.to_numpy(), len(have))
        return pd.Series(have[one] & have[two])

    return lambda column: F.when(column.isNull(), F.lit(False)).otherwise(test(F.coalesce(column, F.lit(0))))


def _endpoints(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id"))


def _met(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the columns of ``table`` (id, ...) for both ends, as <column>_a and <column>_b.

    A hub stands in many pairs. Ids with more pairs than a task should get have their row repeated SALTS times and their pairs dealt
    over the repetitions.
    """
    spark = pairs.sparkSession
    fair = max(1_000, pairs.count() // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    hubs = stored(_endpoints(pairs).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > fair).select("id"), "hot")
    hot = None if hubs.isEmpty() else id_filter(hubs)
    values = [c for c in table.columns if c != "id"]

    def salted(df: DataFrame, key: str, salt) -> DataFrame:
        return df.withColumn("salt", F.lit(0) if hot is None else F.when(_maybe(hot)(F.col(key)), salt).otherwise(F.lit(0)))

    if hot is None:
        rows = table.withColumn("salt", F.lit(0))
    else:
        rows = table.withColumn("salt", F.explode(F.when(_maybe(hot)(F.col("id")), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    out = pairs.select("a", "b")
    for key, other in (("a", "b"), ("b", "a")):
        side = rows.select(F.col("id").alias(key), "salt", *[F.col(c).alias(f"{c}_{key}") for c in values])
        out = salted(out, key, F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")).join(side, [key, "salt"]).drop("salt")
    return out


def verified(pairs: DataFrame, docs: DataFrame, *, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose texts' shingle sets have the similarity.

    The texts are scanned in place and only sets of wanted ids, by a filter of bounded size, leave the scan. Where more ids are wanted than
    a filter holds, the texts are joined with them instead.
    """
    ids = _endpoints(pairs).distinct()
    wanted = id_filter(ids)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if wanted is None:
        texts = texts.join(ids, "id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = None if wanted is None else np.unpackbits(wanted).astype(bool)
        for batch in batches:
            few = batch
            if have is not None:
                one, two = _places(batch[0].fill_null(0).to_numpy(), len(have))
                few = batch.filter(pa.array(have[one] & have[two]))
            for start in range(0, len(few), 256):
                part = few.slice(start, 256)
                found = [np.unique(shingle_hashes(t, k)).tobytes() for t in part[1].to_pylist()]
                yield pa.RecordBatch.from_arrays([part[0], pa.array(found, pa.binary())], names=["id", "shingles"])

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch[2], batch[3], strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch[0], batch[1]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    found = stored(texts.mapInArrow(sets, "id long, shingles binary"), "sets")
    return _met(pairs, found).select("a", "b", "shingles_a", "shingles_b").mapInArrow(test, "a long, b long")


def _pruned(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that sizes and bitmaps allow; ``marks`` has (doc, n, bits). Only bitmaps of wanted ids are moved."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [could_link(n, x, m, y, percent) for n, x, m, y in zip(*(batch[i].to_pylist() for i in range(2, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch[0], batch[1]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    wanted = id_filter(_endpoints(pairs).distinct())
    slim = marks.where("n > 0").select(F.col("doc").alias("id"), "n", "bits")
    if wanted is not None:
        slim = slim.where(_maybe(wanted)(F.col("id")))
    return _met(pairs, slim).select("a", "b", "n_a", "bits_a", "n_b", "bits_b").mapInArrow(test, "a long, b long")


# ---------------------------------------------------------------------------------------------
# Signature trees

_NODE = "block long, node long, low long, high long, slack long, one long, bits binary"


def _leaf_nodes(leaves: DataFrame) -> DataFrame:
    """Node of each leaf: size range, slack, the component if it is a single one, and OR of the members' bitmaps."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for members in batch[2].to_pylist():
                either, slack = 0, 0
                for m in members:
                    bits = int.from_bytes(m["small"], "little")
                    either |= bits
                    slack = max(slack, m["n"] - bits.bit_count())
                sizes, parts = [m["n"] for m in members], {m["component"] for m in members}
                out.append((min(sizes), max(sizes), slack, parts.pop() if len(parts) == 1 else None, either.to_bytes(TREE_WIDTH // 8, "little")))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch[0], batch[1], *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary())], names=["block", "node", "low", "high", "slack", "one", "bits"])

    return leaves.select("block", "node", "members").mapInArrow(build, _NODE)


def _parents(nodes: DataFrame) -> DataFrame:
    """Nodes of the next level up, FAN children each."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            either = []
            for maps in batch[6].to_pylist():
                x = 0
                for bits in maps:
                    x |= int.from_bytes(bits, "little")
                either.append(x.to_bytes(TREE_WIDTH // 8, "little"))
            yield pa.RecordBatch.from_arrays([*(batch[i] for i in range(6)), pa.array(either, pa.binary())], names=["block", "node", "low", "high", "slack", "one", "bits"])

    single = F.when((F.min("one") == F.max("one")) & (F.count("one") == F.count("*")), F.min("one"))
    up = nodes.groupBy("block", F.expr(f"node div {FAN}").alias("node")).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("slack").alias("slack"), single.alias("one"), F.collect_list("bits").alias("bits"))
    return up.mapInArrow(build, _NODE)


def _node_pairs(pairs: DataFrame, percent: int) -> DataFrame:
    """(block, node_a, node_b) of node pairs of several components whose maximum possible overlap suffices for their smallest members."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for low_a, high_a, slack_a, one_a, bits_a, low_b, high_b, slack_b, one_b, bits_b in zip(*(batch[i].to_pylist() for i in range(3, 13)), strict=True):
                near = 100 * high_a >= percent * low_b and 100 * high_b >= percent * low_a and not (one_a is not None and one_a == one_b)
                keep.append(near and (int.from_bytes(bits_a, "little") & int.from_bytes(bits_b, "little")).bit_count() + min(slack_a, slack_b) >= needed(low_a, low_b, percent))
            yield pa.RecordBatch.from_arrays([batch[0], batch[1], batch[2]], names=["block", "node_a", "node_b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(test, "block long, node_a long, node_b long")


def _leaf_pairs(percent: int):
    """Task function (same, x, y lists of members) -> pairs (a, b) of different components that sizes and bitmaps allow."""

    def unpacked(members: list[dict]) -> list[tuple[int, int, int, int, int]]:
        bits = [int.from_bytes(m["small"], "little") for m in members]
        return sorted((m["n"], m["doc"], m["component"], x, m["n"] - x.bit_count()) for m, x in zip(members, bits, strict=True))

    def flush(found: list[tuple[int, int]]) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])
        found.clear()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # pairs listed already; a pair can stand in many blocks. It only spares repeats, so it may be emptied
        for batch in batches:
            found: list[tuple[int, int]] = []
            for same, left, right in zip(*(batch[i] for i in range(3)), strict=True):
                same, left, right = same.as_py(), left.as_py(), right.as_py()  # one pair of leaves at a time
                a = unpacked(left)
                b = a if same else unpacked(right)
                for i, (n, doc, component, x, slack) in enumerate(a):
                    for m, other, theirs, y, more in a[i + 1 :] if same else b:
                        if 100 * n < percent * m:
                            break  # sizes rise
                        if component == theirs or 100 * m < percent * n or (x & y).bit_count() + min(slack, more) < needed(n, m, percent):
                            continue
                        pair = (doc, other) if doc < other else (other, doc)
                        if pair not in seen:
                            seen.add(pair)
                            found.append(pair)
                if len(found) > 20_000:
                    yield flush(found)
                if len(seen) > 100_000:
                    seen.clear()
            yield flush(found)

    return run


def tree_candidates(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of one block and of different components that the trees can't rule out.

    ``members`` has (block, m, doc, component, n, small), m being the block's size. Members are cut into leaves in the order of size
    band, component and size; of a block of more than CHUNK members each chunk, dealt by hash, is numbered by itself, so no task holds a block.
    Blocks of up to FAN members are trees of one leaf, which is the root: the traversal starts and ends there.
    """
    room = 4 * CHUNK // FAN
    chunk = F.pmod(F.xxhash64("doc"), F.ceil(F.col("m") / CHUNK))
    order = Window.partitionBy("block", "chunk").orderBy(F.floor(F.log(F.col("n").cast("double")) / F.lit(0.2)), "component", "n", "doc")
    numbered = members.withColumn("chunk", chunk).withColumn("node", F.expr("chunk") * room + F.floor((F.row_number().over(order) - 1) / FAN).cast("long"))
    # grouped where they were numbered, without another shuffle
    gathered = numbered.groupBy("block", "chunk", "node").agg(F.max(F.col("m") > FAN).alias("inner"), F.collect_list(F.struct("doc", "component", "n", "small")).alias("members"))
    leaves = stored(gathered.select("block", "node", "inner", "members"), "leaves")
    larger = leaves.where("inner")
    met, made = leaves.where("not inner").select(F.lit(True).alias("same"), F.col("members").alias("x"), F.expr("slice(members, 1, 0)").alias("y")), [leaves]
    top = larger.agg(F.max("node")).first()[0]
    if top is not None:
        levels = [stored(_leaf_nodes(larger), "nodes")]
        while top >= FAN:
            levels.append(stored(_parents(levels[-1]), "nodes"))
            top //= FAN
        # the top level has up to FAN nodes of a block, all under one root
        down = levels[-1].select("block").distinct().select("block", F.lit(0).cast("long").alias("node_a"), F.lit(0).cast("long").alias("node_b"))
        columns = ("low", "high", "slack", "one", "bits")
        for nodes in reversed(levels):
            low = nodes.withColumn("up", F.expr(f"node div {FAN}"))
            a = low.select("block", F.col("up").alias("node_a"), F.col("node").alias("a"), *[F.col(c).alias(f"{c}_a") for c in columns])
            b = low.select("block", F.col("up").alias("node_b"), F.col("node").alias("b"), *[F.col(c).alias(f"{c}_b") for c in columns])
            both = down.join(a, ["block", "node_a"]).join(b, ["block", "node_b"]).where("a <= b")
            down = stored(_node_pairs(both.select("block", "a", "b", *[f"{c}_a" for c in columns], *[f"{c}_b" for c in columns]), percent), "pairs")
            made.append(down)
        made += levels
        left = larger.select("block", F.col("node").alias("node_a"), F.col("members").alias("x"))
        right = larger.select("block", F.col("node").alias("node_b"), F.col("members").alias("y"))
        pairs = down.join(left, ["block", "node_a"]).join(right, ["block", "node_b"])
        met = met.unionByName(pairs.select((F.col("node_a") == F.col("node_b")).alias("same"), "x", "y"))
    out = stored(met.mapInArrow(_leaf_pairs(percent), "a long, b long").distinct(), "near")
    dropped(*made)
    return out


# ---------------------------------------------------------------------------------------------
# The join


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(doc, n_shingles, component): one row per row of ``docs``.

    component is the smallest id reachable by links of at least ``percent`` % Jaccard similarity on the sets of
    distinct k-word shingles; A-Z is lower-cased, words are separated by ASCII white space. A text of fewer
    words is one shingle; null and wordless texts have none and link with nothing. Equal sets are one
    class and are compared once. Ids are whole numbers. Rows that repeat an id are one document: they share a
    component. Rows with a null id get the smallest id of the rows with an equal set, else null, and link no further.
    """
    spark: SparkSession = docs.sparkSession
    source = {"id_col": id_col, "text_col": text_col, "k": k}
    levels = shingle_levels(docs, text_col, k)
    marks = stored(signatures(docs, levels, percent=percent, **source), "signatures")
    slim = stored(with_extremes(marks.select("doc", "n", "key_a", "key_b"), ["key_a", "key_b", "n"], "doc", {"rep": (F.min, "doc")}).select("doc", "n", "rep"), "classes")

    # blocks: shingles in the prefixes of different documents. A shingle whose counter is low has few rows, so they may meet in a window;
    # those of the other shingles count as shared
    token = Window.partitionBy("token")
    slot = F.shiftrightunsigned("token", 64 - SKETCH_BITS)
    often = [i for i, level in enumerate(levels.tolist()) if level >= HOT_LEVEL]
    rows = marks.where("n > 0 and doc is not null").select("doc", F.explode("prefix").alias("token"))
    hot = slot.isin(often) if often else F.lit(False)
    rare = rows.where(~hot).withColumns({"lo": F.min("doc").over(token), "hi": F.max("doc").over(token)}).where("lo <> hi").select("token", "doc")
    shared = rare.unionByName(rows.where(hot).select("token", "doc")) if often else rare
    # the smallest document of a class stands for it
    blocks = stored(shared.join(slim.where("rep = doc").select("doc", "n").distinct(), "doc").select("token", F.col("doc").alias("rep"), "n").distinct(), "blocks")

    # hubs
    first = F.struct("rep", "n")
    led = blocks.where(~hot).withColumn("hub", F.min(first).over(token))
    if often:
        led = led.unionByName(with_extremes(blocks.where(hot), ["token"], "rep", {"hub": (F.min, first)}))
    stars = (
        led.where((F.col("rep") != F.col("hub.rep")) & (100 * F.col("n") >= percent * F.col("hub.n")) & (100 * F.col("hub.n") >= percent * F.col("n")))
        .select(F.col("rep").alias("a"), F.col("hub.rep").alias("b"))
        .distinct()
    )
    twice = slim.where("rep is not null and doc is not null")
    least = twice.groupBy("doc").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi")
    same_id = twice.join(least, "doc").where("rep <> lo").select(F.col("rep").alias("a"), F.col("lo").alias("b"))
    hubs = stored(stars, "hubs")
    tested = stored(_pruned(hubs, marks, percent), "stars")
    one = stored(connected_components(verified(tested, docs, percent=percent, **source).unionByName(same_id)), "components")

    # trees over what is left; most documents are in no component yet, and a filter tells them apart in place
    linked = id_filter(one.select("node"))
    joined, alone = blocks, None
    if linked is not None:
        marked = blocks.withColumn("linked", _maybe(linked)(F.col("rep")))
        joined, alone = marked.where("linked").drop("linked"), marked.where("not linked").select("token", "rep", "n", F.col("rep").alias("component"))
    named = joined.join(one.withColumnRenamed("node", "rep"), "rep", "left").select("token", "rep", "n", F.coalesce("component", "rep").alias("component"))
    labelled = stored(named if alone is None else named.unionByName(alone), "labelled")
    alike = (
        labelled.groupBy("token")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.bit_xor(F.xxhash64("rep")).alias("p"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("q"), F.count("*").alias("m"))
        .where("lo <> hi")
    )
    chosen = stored(alike.groupBy("p", "q", "m").agg(F.min("token").alias("token")).select("token", "m"), "chosen")
    few = id_filter(chosen.select("token"))
    members = (labelled if few is None else labelled.where(_maybe(few)(F.col("token")))).join(chosen, "token").select(F.col("token").alias("block"), "m", F.col("rep").alias("doc"), "component", "n")
    near = tree_candidates(members.join(marks.where("n > 0").select("doc", "n", "small"), ["doc", "n"]), percent)
    left = stored(_pruned(near, marks, percent), "candidates")
    more = verified(left, docs, percent=percent, **source)
    node = one.withColumnRenamed("component", "root")
    lifted = (
        more.join(node.select(F.col("node").alias("a"), F.col("root").alias("root_a")), "a", "left")
        .join(node.select(F.col("node").alias("b"), F.col("root").alias("root_b")), "b", "left")
        .select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    )
    two = stored(connected_components(lifted), "components")
    dropped(marks, blocks, hubs, tested, labelled, chosen, near, left)

    # the components of documents that are in none stay out of the join keys' way: null keys meet nothing
    return (
        slim.join(one.select(F.col("node").alias("rep"), F.col("component").alias("c1")), "rep", "left")
        .withColumn("c1", F.coalesce("c1", "rep"))
        .join(two.select(F.col("node").alias("c1"), F.col("component").alias("c2")), "c1", "left")
        .select("doc", F.col("n").alias("n_shingles"), F.coalesce("c2", "c1", "rep", "doc").alias("component"))
    )


def without_keys(docs: DataFrame, gone: DataFrame, key: Column) -> DataFrame:
    """``docs`` without the rows whose ``key`` is in the one-column table ``gone``; null keys stay.

    A filter of bounded size tells most rows apart in place; only rows that it can't clear are joined. Where there are more keys than it holds,
    all rows are.
    """
    name, own, maybe = unused(docs, "gone"), unused(docs, "key"), unused(docs, "maybe")
    listed = stored(gone.where(F.col(gone.columns[0]).isNotNull()).toDF(name).distinct(), "gone")
    keyed = docs.withColumn(own, key)
    bits = id_filter(listed.select(F.xxhash64(name)))
    if bits is None:
        return keyed.join(listed, F.col(own) == F.col(name), "left_anti").drop(own)
    marked = keyed.withColumn(maybe, _maybe(bits)(F.xxhash64(own)))
    clear = marked.where(~F.col(maybe)).select(*docs.columns)
    rest = marked.where(F.col(maybe))
    return clear.unionByName(rest.join(listed, F.col(own) == F.col(name), "left_anti").select(*docs.columns))


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose id is in the one-column table ``ids``; null ids stay."""
    return without_keys(docs, ids.select(F.col(ids.columns[0]).cast("long")), F.col(id_col).cast("long"))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest id.

    Rows that repeat the kept id are one document; one of the least text is kept. Rows with a null id stay. Columns stay as they are, whatever
    their names.
    """
    found = stored(jaccard_components(docs, id_col=id_col, text_col=text_col, k=k, percent=percent), "found")
    losers = found.where("doc <> component").select("doc")
    kept = without_ids(docs, losers, id_col)
    twice, rank = unused(docs, "twice"), unused(docs, "rank")
    repeated = stored(found.where("doc = component").groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc").alias(twice)), "repeated")
    if repeated.isEmpty():
        return kept
    once = without_ids(kept, repeated, id_col)
    ranked = kept.join(repeated, kept[id_col].cast("long") == repeated[twice], "left_semi").withColumn(rank, F.row_number().over(Window.partitionBy(id_col).orderBy(text_col)))
    return once.unionByName(ranked.where(F.col(rank) == 1).drop(rank))
