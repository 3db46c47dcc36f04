"""The three workloads end to end: index a corpus, search it with production data, evaluate text retrieval."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetforge.functions.distance import LAYOUT
from sheetforge.operators import encode, evaluate, extract, fuzzy, layout, search, store
from sheetforge.scratch import stored


def index_drawings(boxes: DataFrame, rects: DataFrame, pages: DataFrame, materials: DataFrame, norms: DataFrame | None = None) -> DataFrame:
    """Attributes and text sections of the search vector of each drawing, from boxes and rectangles.

    ``materials`` and ``norms`` are small dictionaries; without norms their section is empty.
    """
    blobs = stored(layout.merge_text(boxes, rects, pages), "blobs")
    found = stored(extract.extract_blobs(fuzzy.match_attributes(blobs, materials)), "found")
    gathered = extract.gather(found).join(extract.outer_measures(found), "drawing_id", "left")
    if norms is not None:
        gathered = gathered.join(fuzzy.norm_flags(gathered, norms), "drawing_id", "left")
    else:
        gathered = gathered.withColumn("norm_vector", F.array().cast("array<double>"))
    return encode.encode(gathered, materials)


def search_with_runtimes(queries: DataFrame, corpus: DataFrame, drawings: DataFrame, runtimes: DataFrame, k: int = 5, weights: list[float] | None = None, layout: dict[str, int] = LAYOUT) -> DataFrame:
    """Nearest drawings with names, number and sum of machine run times. Run times are summed before they are joined."""
    hits = search.search(queries, corpus, k, weights, layout)
    keys = hits.select("drawing_id").distinct()
    totals = store.lookup(runtimes, keys, "drawing_id").groupBy("drawing_id").agg(F.count("*").alias("n_runtimes"), F.sum("machine_runtime").alias("total_runtime"))
    named = store.ranked_documents(hits, drawings)
    return named.join(totals, "drawing_id", "left").withColumn("n_runtimes", F.coalesce("n_runtimes", F.lit(0)))


def retrieval_precision(ranked: DataFrame, ks: tuple[int, ...] = (3, 5)) -> DataFrame:
    """(k, tag, precision, n) of ranked relevance lists with tags."""
    parts = [evaluate.precision_at_k(ranked, k, by=["tag"]).withColumn("k", F.lit(k)) for k in ks]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("k", "tag", F.round("precision", 6).alias("precision"), "n")


def text_retrieval(prompts: DataFrame, nodes: DataFrame, documents: DataFrame, judge: Callable[[DataFrame], DataFrame], *, dim: int, k: int = 10, labelled: int = 5, ks: tuple[int, ...] = (3, 5)) -> DataFrame:
    """(k, tag, precision, n) of the nearest ``k`` nodes of each prompt, the first ``labelled`` of which are judged.

    ``prompts`` has prompt_id, tag and llm_vector, ``nodes`` drawing_id and llm_vector. ``judge`` adds the label text to the
    labelling tasks. A prompt without a task counts with precision 0.
    """
    hits = stored(search.text_search(prompts.withColumnRenamed("prompt_id", "query_id"), nodes, k, dim=dim), "hits")
    asked = prompts.select("prompt_id", "tag")
    judged = judge(evaluate.labelling_tasks(asked, hits, documents, labelled))
    codes = evaluate.relevance_codes(judged).select("prompt_id", "rank", "relevance")
    return retrieval_precision(asked.join(codes, "prompt_id", "left"), ks)
