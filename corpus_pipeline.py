"""Corpus pipeline: toxic documents out, near copies to one, leaks out, sources mixed, shards dealt.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetforge.llm import decontamination, jaccard_join, mixing, sharding, toxicity
from sheetforge.llm.common import shared_dir, table
from sheetforge.llm.queries import MIX_WEIGHTS
from sheetforge.shipping import ship

SHARDS = 24


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by a model of the labelled rows outside the held-out fifth."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    return toxicity.score(docs, model, carry=docs.columns).where("predicted = 0").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each component under 0.8 Jaccard similarity on 5-word shingles."""
    ship(spark)
    return jaccard_join.deduplicate(docs, k=5, percent=80).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of 10 benchmark words.

    Whether a row leaks follows from its text alone, so rows are told apart by the text's digest: rows with null or
    repeated ids are judged like all others.
    """
    digest = F.md5(F.coalesce("text", F.lit("")))
    found = decontamination.decontaminate(docs.select(digest.alias("digest"), "text"), table(spark, sf_dir, "benchmark"), width=10, id_col="digest")
    return jaccard_join.without_keys(docs, found.where("n_hit > 0").select("doc"), digest)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that the sources have their target shares, in a global random order."""
    return mixing.mix_sources(docs, MIX_WEIGHTS).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with size, shard and slot; equal texts together, bytes of the shards near equal."""
    return sharding.assign_shards(docs, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", one_of_each_group),
    ("decontamination", drop_leaks),
    ("mixing", mix),
    ("sharding", shard),
]

#: The learned lexicon can't be said in SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; the tables between them lie in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/sheetforge/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{i}-{name}")
    raise AssertionError
