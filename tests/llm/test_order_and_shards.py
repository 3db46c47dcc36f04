import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetforge.llm import fingerprints, mixing, sharding, training_order


# ------------------------------------------------------------------------------ fingerprints


def test_likeness_and_next(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 4) for _ in range(rng.randint(1, 300))) for _ in range(30)]
    rows = [(3 * i, t) for i, t in enumerate(texts)] + [(200, texts[0]), (201, ""), (202, None), (203, "é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("selected", F.lit(1))
    got = {r["doc_id"]: r for r in fingerprints.edited_pairs(docs).withColumn("fp", fingerprints.as_text(F.col("selected"))).collect()}
    order = sorted(rows)
    for i, (d, t) in enumerate(order):
        t, following = t or "", order[(i + 1) % len(order)][1] or ""
        q = len(t) // 4
        assert got[d]["n_chars"] == len(t)
        assert got[d]["edited"] == t[: len(t) - q] + following[:q], d
        assert got[d]["next_selected"] == got[order[(i + 1) % len(order)][0]]["selected"]
    assert got[0]["fp"] == got[200]["fp"] and got[201]["fp"] == got[202]["fp"]
    likeness = fingerprints.edited_pairs(docs).select("doc_id", fingerprints.likeness(fingerprints.hashes(F.col("selected")), fingerprints.hashes(F.col("edited_selected"))).alias("l")).collect()
    assert all(0 <= r["l"] <= 1 for r in likeness)
    long = [r["l"] for r in likeness if got[r["doc_id"]]["n_chars"] > 300]
    assert sum(long) / len(long) > 0.55


def test_single_row_and_empty_table(spark):
    one = spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")
    assert fingerprints.edited_pairs(one).first()["edited"] == "abcdefab"
    assert fingerprints.edited_pairs(one.limit(0)).count() == 0
    ties = spark.createDataFrame([(1, "bbbb"), (1, "aaaa"), (None, "cccc")], "doc_id long, text string")
    assert sorted(r["edited"] for r in fingerprints.edited_pairs(ties).collect()) == ["aaab", "bbbc", "ccca"]


# ------------------------------------------------------------------------------ mixing


def test_poisson_inversion(spark):
    us = [0.0, 0.05, 0.3, 0.5, 0.77, 0.999, 0.9999999]
    for rate in (0.0, 0.2, 1.0, 7.5):
        got = [r[0] for r in spark.createDataFrame([(u,) for u in us], "u double").select(mixing.poisson_count(F.col("u"), F.lit(rate), 80)).collect()]
        want = []
        for u in us:
            k, p = 0, math.exp(-rate)
            c = p
            while u >= c and k < 80 and rate:
                k += 1
                p *= rate / k
                c += p
            want.append(k)
        assert got == want


def test_shares_and_odd_rows(spark):
    rows = [(i, "s" + str(min(3, i % 10 // 3)), "t") for i in range(6000)]
    docs = spark.createDataFrame([*rows, (0, "s0", "t"), (None, None, None)], "doc_id long, source string, text string").withColumn("copy", F.lit("old"))
    out = mixing.mix_sources(docs, {"s0": 0.7, "s1": 0.1, "*": 0.2})
    share = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(share["s0"] / 6002 - 0.7) < 0.03 and abs(share["s1"] / 6002 - 0.1) < 0.03
    assert out.columns == ["doc_id", "source", "text", "copy", "mix_key"]
    assert out.where("doc_id = 0").count() % 2 == 0
    keys = [r["mix_key"] for r in out.select("mix_key").collect()]
    assert keys == sorted(keys)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


# ------------------------------------------------------------------------------ shards


def test_longest_first():
    assert sharding.longest_first([("a", 5), ("b", 4), ("c", 3), ("d", 3), ("e", 3)], 2) == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}


@pytest.mark.parametrize("bundles", [24_576, 7])
def test_shards(spark, bundles):
    rng = random.Random(8)
    rows = [(i, rng.choice(["same text"] * 3 + [str(i) * rng.randint(1, 40)])) for i in range(1500)] + [(5000, None), (5000, None), (None, ""), (5001, "é" * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit("old")).withColumn("n", F.lit(1))
    out = sharding.assign_shards(docs, 5, bundles=bundles, rows_per_part=100).toPandas()
    assert len(out) == len(rows) and list(out.columns) == ["doc_id", "text", "n", "size", "shard", "slot"]
    assert (out["size"] == [len((t or "").encode()) + 8 for t in out["text"]]).all()
    assert out.assign(t=out["text"].fillna("")).groupby("t")["shard"].nunique().max() == 1
    for _, part in out.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert sharding.assign_shards(docs.limit(0), 5).count() == 0


# ------------------------------------------------------------------------------ training order


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 1000, 4097])
def test_feistel_is_a_permutation(n):
    slots = training_order.feistel(np.arange(n), n, 5)
    assert sorted(slots.tolist()) == list(range(n))
    if n > 200:
        assert (slots != training_order.feistel(np.arange(n), n, 6)).any() and abs(np.corrcoef(slots, np.arange(n))[0, 1]) < 0.2


def test_shards_round_trip(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(0, 60)))) for i in range(70)] + [(3, "alpha"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("slot", F.lit(0)).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    table, folder = training_order.materialise(docs, length=16, shard_span=30, out_dir=f"file://{tmp_path}/out")
    for _ in range(2):  # a second run finds its shards whole
        out = table.toPandas().sort_values("slot")
        assert out["slot"].tolist() == list(range(len(out)))
    read = training_order.read_slots(folder, 0, 10_000, length=16)
    assert len(read) == len(out)
    assert [x[:2] for x in training_order.read_slots(folder, 7, 25, length=16)] == [x[:2] for x in read[7:32]]
    encoding = training_order.encoding_for("/opt/tokenizers/byte_bpe_50k.tiktoken")
    texts = {}
    for (row, chunk, ids), (_, r) in zip(read, out.iterrows()):
        assert (row, chunk, len(ids)) == (r["row"], r["chunk"], r["n_tokens"]) and zlib.crc32(ids.astype("<u2").tobytes()) == r["tokens_crc32"]
        texts.setdefault((row, r["doc"]), {})[chunk] = ids
    got = sorted((-1 if d != d or d is None else int(d), b"".join(parts[c].tobytes() for c in sorted(parts))) for (_, d), parts in texts.items())
    assert got == sorted((-1 if d is None else d, training_order.encode(encoding, t or "") + np.array([50256], dtype="<u2").tobytes()) for d, t in rows)
    assert training_order.materialise(docs.limit(0), length=16)[0].count() == 0


def test_a_folder_never_mixes_two_inputs(spark, tmp_path):
    out_dir = f"file://{tmp_path}/out"
    for texts in (["alpha"] * 40, ["other words here"] * 40, ["alpha"] * 40):
        name = f"{tmp_path}/{len(list(tmp_path.iterdir()))}"
        spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(name)
        table, folder = training_order.materialise(spark.read.parquet(name), length=16, shard_span=20, out_dir=out_dir)
        read = training_order.read_slots(folder, 0, 1000, length=16)
        rows = table.orderBy("slot").collect()
        assert [zlib.crc32(ids.astype("<u2").tobytes()) for _, _, ids in read] == [r["tokens_crc32"] for r in rows] and len(rows) == 40


def test_order_equals_plain_version(spark, tmp_path):
    """Slots, shards and offsets of all documents against a plain computation from the rows' order."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs.coalesce(1).write.parquet(f"{tmp_path}/t")
    docs = spark.read.parquet(f"{tmp_path}/t")
    length, span, key = 64, 1000, 2_024
    table, _ = training_order.materialise(docs, length=length, shard_span=span, key=key, out_dir=f"file://{tmp_path}/out")
    encoding, numbers, base = training_order.encoding_for("/opt/tokenizers/byte_bpe_50k.tiktoken"), [], 0
    rows = docs.withColumn("row", F.monotonically_increasing_id()).orderBy("row").collect()
    for r in rows:
        tokens = [*encoding.encode_ordinary(r["text"] or ""), 50256]
        numbers += [(base + c, r["row"], c, len(tokens[c * length : (c + 1) * length])) for c in range(-(-len(tokens) // length))]
        base += -(-(len((r["text"] or "").encode()) + 1) // length)
    half = max(1, (max(base - 1, 1).bit_length() + 1) // 2)

    def place(x):
        while True:
            left, right = x >> half, x & (1 << half) - 1
            for r in range(4):
                spin = int(training_order.mix64(np.array([(right + key * 0x9E3779B97F4A7C15 + r * 0xC2B2AE3D27D4EB4F) % 2**64], dtype=np.uint64))[0])
                left, right = right, left ^ spin & (1 << half) - 1
            x = left << half | right
            if x < base:
                return x

    want, first = [], {}
    for slot, (at, row, chunk, n) in enumerate(sorted((place(x), row, chunk, n) for x, row, chunk, n in numbers)):
        first.setdefault(at // span, slot)
        want.append((row, chunk, slot, at // span, (slot - first[at // span]) * (16 + 2 * length), n))
    assert [tuple(r) for r in table.select("row", "chunk", "slot", "shard", "byte_offset", "n_tokens").orderBy("slot").collect()] == want


def test_ids_of_four_bytes(spark, tmp_path):
    with pytest.raises(ValueError, match="id_bytes"):
        training_order.encode(type("E", (), {"encode_ordinary": lambda self, t: [70_000]})(), "x")
    spark.createDataFrame([(1, "alpha beta")], "doc_id long, text string").write.parquet(f"{tmp_path}/t")
    _, folder = training_order.materialise(spark.read.parquet(f"{tmp_path}/t"), length=8, id_bytes=4, out_dir=f"file://{tmp_path}/out")
    (_, _, ids), = training_order.read_slots(folder, 0, 9, length=8, id_bytes=4)
    assert ids.tolist() == [*training_order.encoding_for("/opt/tokenizers/byte_bpe_50k.tiktoken").encode_ordinary("alpha beta"), 50256]


def test_mixing_names_and_absent_sources(spark):
    docs = spark.createDataFrame([(i, "a" if i % 4 else "b", "x") for i in range(4000)], "doc_id long, source string, rate string").withColumn("source_of_rate", F.lit(1)).withColumn("_rate", F.lit(2))
    out = mixing.mix_sources(docs, {"a": 0.3, "gone": 0.4, "b": 0.3})
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["a"] - 2000) < 250 and abs(n["b"] - 2000) < 350  # the absent weight goes to both
    assert out.columns == ["doc_id", "source", "rate", "source_of_rate", "_rate", "copy", "mix_key"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(source" not in plan


def test_shards_equal_plain_version(spark):
    """Shard and slot of all documents against a plain LPT; also with clashing names."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").withColumn("item_", F.lit("clash"))
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.assign_shards(docs, 24).collect()}
    rows = [(r["doc_id"], len((r["text"] or "").encode()) + 8, hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in docs.collect()]
    total, size, item = sum(r[1] for r in rows), {}, {}
    for _, n, k in rows:
        size[k] = size.get(k, 0) + n
    for k, n in size.items():
        item[k] = k if n >= max(1, int(total / 24 / 512)) else f"b{int(k[:12], 16) % 24_576}"
    loads, placed, of = [0] * 24, {}, {}
    for k, n in size.items():
        of[item[k]] = of.get(item[k], 0) + n
    for name, n in sorted(of.items(), key=lambda x: (-x[1], x[0])):
        placed[name] = min(range(24), key=lambda s: (loads[s], s))
        loads[placed[name]] += n
    assert {d: got[d][0] for d, _, _ in rows} == {d: placed[item[k]] for d, _, k in rows}
    for s in range(24):
        assert sorted(x for shard, x in got.values() if shard == s) == list(range(sum(shard == s for shard, _ in got.values())))
