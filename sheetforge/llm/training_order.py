"""Training-order materialisation: every sequence gets a global slot, shards are written in slot order.

Texts are encoded once and cut into sequences of fixed length. Sequences are numbered by text; a keyed
Feistel network on the smallest even number of bits that holds the count, walked until it falls below the count, permutes the numbers.
So a sequence's place follows from its number and the key alone: no random keys, no state. Ranges of
places are shards; a shard is a file of records of one stride, so a slot lies at a known offset of a known file,
and a reader can resume at any slot. Shards are written under a temporary name and renamed, and whole
ones are kept when a lost task is run again.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheetforge.llm.common import mix64, shared_dir, stored

# The pattern that goes with the byte-level vocabulary files.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
HEADER = np.dtype([("row", "<i8"), ("chunk", "<i4"), ("used", "<i4")])


_encodings: dict[str, object] = {}


def encoding_for(path: str):
    """The process's tokenizer for a file of ranks; later tasks find it loaded."""
    import tiktoken

    if path not in _encodings:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def encode(encoding, text: str, width: int = 2) -> bytes:
    """Token ids of a text as little-endian unsigned numbers of ``width`` (2 or 4) bytes."""
    try:
        ids = array({2: "H", 4: "I"}[width], encoding.encode_ordinary(text))
    except OverflowError as e:
        raise ValueError("the vocabulary has ids above 65,535: pass id_bytes=4") from e
    if sys.byteorder != "little":
        ids.byteswap()
    return ids.tobytes()


def feistel(index: np.ndarray, n: int, key: int, rounds: int = 4) -> np.ndarray:
    """Keyed permutation of 0 .. n-1, applied to an array of indices; walks the cycle while outside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in range(rounds):
            spin = mix64(right + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF))
            left, right = right, left ^ (spin & mask)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


#: Up to so many tasks write one shard each; a larger order is written by four tasks for each shuffle partition, or so many.
WRITERS = 512
_SPLITS = "spark.sql.files.minPartitionNum"


@contextmanager
def _held_splits(spark: SparkSession, parts: str) -> Iterator[None]:
    """Within it, files are split for ``parts`` parts at least, not for the cores of live executors."""
    was = spark.conf.get(_SPLITS, None)
    spark.conf.set(_SPLITS, parts)
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(_SPLITS)
        else:
            spark.conf.set(_SPLITS, was)


def materialise(
    docs: DataFrame, *, tokenizer: str = "/opt/tokenizers/byte_bpe_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text",
    length: int = 512, end_id: int = 50_256, key: int = 2_024, shard_span: int = 40_960, id_bytes: int = 2, out_dir: str | None = None,
) -> tuple[DataFrame, str]:
    """Writes all documents as shards of fixed-stride records in training order.

    Returns (rows, folder). Rows: doc, row, chunk, slot, shard, byte_offset (of the
    record in its shard), n_tokens, tokens_crc32 (both without padding). A record is HEADER and ``length`` ids of ``id_bytes`` (2, or 4 for
    vocabularies above 65,536), padded with ``end_id``. Every text, the empty and null ones too, ends with ``end_id``, so each row has a sequence;
    repeated rows are kept; an empty table has no shard; other columns are ignored whatever their names. ``docs`` is read twice and must come the same way both
    times. For a table read from files the splits are held for both reads, so executors may come and go; if the rows of a
    task differ all the same, the job fails.

    ``out_dir`` is a folder that all executors share; default: a new one below spark.checkpoint.dir. The shards lie in a
    folder below it whose name is a digest of the rows (ids, texts, their order) and of all parameters: another run of the same job finds its whole
    shards and resumes, a run over other documents never meets them. ``tokenizer`` is a path that each executor has, and counts by that path.

    A text has at most as many tokens as bytes, so it gets numbers for that many sequences without being encoded; those that
    it doesn't need stay unused. The permutation runs over all numbers; ``shard_span`` permuted numbers make a shard, and a
    sequence's slot is its rank among the used ones. So texts are encoded once and sequences shuffled once; a task writes a range of shards.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    stride = HEADER.itemsize + id_bytes * length
    stop = np.array([end_id], dtype=f"<u{id_bytes}").tobytes()
    row, text = F.monotonically_increasing_id(), F.coalesce(F.col(text_col), F.lit(""))
    most = F.ceil((F.octet_length(text) + 1) / F.lit(float(length))).cast("long")
    # rows are numbered within their task, whose number is the upper bits
    numbered = docs.select(F.col(id_col).alias("doc"), row.alias("row"), F.shiftrightunsigned(row, 33).alias("part"), text.alias("text"))
    parts = next(filter(None, (spark.conf.get(c, None) for c in (_SPLITS, "spark.sql.leafNodeDefaultParallelism"))), str(spark.sparkContext.defaultParallelism))
    with _held_splits(spark, parts):
        seen = docs.select(F.shiftrightunsigned(row, 33).alias("part"), most.alias("n"), F.xxhash64(row, F.col(id_col).cast("string"), text).alias("print"))
        sums = stored(seen.groupBy("part").agg(F.sum("n").alias("n"), F.bit_xor("print").alias("print")), "numbers")
    total, prints = sums.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64("part", "n", "print")), F.lit(0))).first()
    name = hashlib.sha256(repr((total, prints, tokenizer, length, end_id, key, shard_span, id_bytes)).encode()).hexdigest()[:24]
    folder = f"{(out_dir or f'{shared_dir(spark)}/sheetforge/shards-{uuid.uuid4().hex}').rstrip('/')}/order-{name}"
    running = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("part", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("base"), F.col("n").alias("whole"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, done, want = encoding_for(tokenizer), 0, 0
        for table in batches:
            for start in range(0, len(table), 64):
                batch = table.slice(start, 64)
                if batch[3].null_count:
                    raise RuntimeError("rows of a task that was not there when they were counted; docs came in other splits")
                want = batch[4][0].as_py()
                docs_, rows, numbers, records, index = [], [], [], [], []
                for doc, row, text, base in zip(*(batch[i].to_pylist() for i in range(4)), strict=True):
                    tokens = encode(encoding, text, id_bytes) + stop
                    n = -(-len(tokens) // (id_bytes * length))
                    docs_ += [doc] * n
                    rows += [row] * n
                    numbers += range(n)
                    index += range(base + done, base + done + n)
                    records += [tokens[id_bytes * length * c : id_bytes * length * (c + 1)] for c in range(n)]
                    done += -(-(len(text.encode()) + 1) // length)
                if done > want:
                    raise RuntimeError(f"more rows in a task than were counted ({done} numbers, {want} counted); docs came in other splits")
                order = feistel(np.array(index, dtype=np.int64), total, key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(order // shard_span, pa.int64()), pa.array(order, pa.int64()), pa.array(docs_, batch.schema.field(0).type), pa.array(rows, pa.int64()), pa.array(numbers, pa.int32()), pa.array(records, pa.binary())],
                    names=["shard", "place", "doc", "row", "chunk", "tokens"],
                )
        if done != want:
            raise RuntimeError(f"fewer rows in a task than were counted ({done} numbers, {want} counted); docs came in other splits")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        shard, sink, name, at = None, None, "", 0

        def close() -> None:
            if sink is not None:
                sink.close()
                store.move(name, shard_path(root, shard))

        for batch in batches:
            places, sizes, sums_ = [], [], []
            for s, row, chunk, tokens in zip(*(batch[i].to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if s != shard:
                    close()
                    shard, at, name = s, 0, f"{root}/.shard-{s:06d}-{uuid.uuid4().hex}"
                    done = store.get_file_info(shard_path(root, s)).type == fs.FileType.File
                    sink = None if done else store.open_output_stream(name)
                n = len(tokens) // id_bytes
                if sink is not None:
                    sink.write(np.array([(row, chunk, n)], dtype=HEADER).tobytes() + tokens + stop * (length - n))
                places.append(at)
                sizes.append(n)
                sums_.append(zlib.crc32(tokens))
                at += 1
            yield pa.RecordBatch.from_arrays([batch[1], batch[2], batch[3], batch[0], pa.array(places, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sums_, pa.int64())], names=["doc", "row", "chunk", "shard", "at", "n_tokens", "tokens_crc32"])
        close()

    # one row for each task, so it may be broadcast; the texts stay in their tasks and in their order
    based = numbered.join(F.broadcast(before), "part", "left").select("doc", "row", "text", "base", "whole")
    sequences = based.mapInArrow(cut, f"shard long, place long, doc {kind}, row long, chunk int, tokens binary")
    shards = max(1, -(-total // shard_span))
    # a shard goes to one task whole; a task has a range of them
    tasks = min(shards, max(WRITERS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    placed = sequences.repartitionById(tasks, F.expr(f"cast(shard * {tasks} div {shards} as int)")).sortWithinPartitions("shard", "place").select("shard", "doc", "row", "chunk", "tokens")
    with _held_splits(spark, parts):
        written = stored(placed.mapInArrow(write, f"doc {kind}, row long, chunk int, shard long, at long, n_tokens int, tokens_crc32 long"), "written")
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = written.groupBy("shard").agg(F.count("*").alias("n"))  # one row for each shard
    firsts = counts.select("shard", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("first"))
    rows = written.join(F.broadcast(firsts), "shard").select(
        "doc", "row", "chunk", (F.col("first") + F.col("at")).alias("slot"), "shard", (F.col("at") * stride).alias("byte_offset"), "n_tokens", "tokens_crc32"
    )
    return rows, folder


def shard_path(root: str, shard: int) -> str:
    return f"{root}/shard-{shard:08d}.bin"


def read_slots(folder: str, first: int, count: int, *, length: int = 512, id_bytes: int = 2) -> list[tuple[int, int, np.ndarray]]:
    """(row, chunk, ids) of the sequences at ``count`` slots from ``first`` on; reads stop at the end of the order.

    Slots run through the shards in the order of their names; file sizes tell where each begins.
    """
    store, root = fs.FileSystem.from_uri(folder)
    stride = HEADER.itemsize + id_bytes * length
    files = sorted((i.path, i.size) for i in store.get_file_info(fs.FileSelector(root)) if i.path.rsplit("/", 1)[-1].startswith("shard-"))
    out: list[tuple[int, int, np.ndarray]] = []
    start = 0
    for path, size in files:
        n = size // stride
        wanted = range(max(first, start), min(first + count, start + n))
        if wanted:
            with store.open_input_file(path) as file:
                file.seek((wanted[0] - start) * stride)
                for _ in wanted:
                    data = file.read(stride)
                    row, chunk, used = np.frombuffer(data[: HEADER.itemsize], dtype=HEADER)[0].tolist()
                    out.append((row, chunk, np.frombuffer(data[HEADER.itemsize :], dtype=f"<u{id_bytes}")[:used]))
        start += n
    return out
