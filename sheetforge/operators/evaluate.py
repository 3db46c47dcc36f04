"""Scores of extraction, retrieval and segmentation against labelled truth."""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetforge.operators.fuzzy import match_count, partial_ratio
from sheetforge.scratch import stored

# ------------------------------------------------------------------------------ extraction


def scores(tp: Column, fp: Column, fn: Column) -> Column:
    """struct(accuracy, precision, recall); an empty denominator gives 1."""

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / F.nullif(whole, F.lit(0))).otherwise(F.lit(1.0))

    return F.struct(share(tp, tp + fp + fn).alias("accuracy"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"))


def match_exact(results: DataFrame, key: str, truth: str, found: str) -> DataFrame:
    """(key, tp, fp, fn): multiset overlap of two list columns; both lie in the same row, so nothing is shuffled. Null elements match nothing."""

    def times(values: str, v: Column) -> Column:
        return F.size(F.filter(values, lambda x: x == v))

    hits = F.transform(F.array_distinct(truth), lambda v: F.least(times(truth, v), times(found, v)))
    tp = F.coalesce(F.aggregate(hits, F.lit(0), lambda a, x: a + x), F.lit(0))
    rows = results.select(key, F.greatest(F.size(truth), F.lit(0)).alias("_n"), F.greatest(F.size(found), F.lit(0)).alias("_m"), tp.alias("tp"))
    return rows.select(key, "tp", (F.col("_m") - F.col("tp")).alias("fp"), (F.col("_n") - F.col("tp")).alias("fn"))


def gdt_keys(gdts: Column) -> Column:
    """``name_runout`` of each geometric tolerance."""
    return F.transform(gdts, lambda g: F.concat_ws("_", g["name"], g["runout"].cast("string")))


def match_fuzzy(results: DataFrame, key: str, truth: str, found: str, cutoff: float = 80, variant: str = "first_fit") -> DataFrame:
    """(key, tp, fp, fn): greedy fuzzy matches of two lists; each found text counts once.

    ``variant``: "first_fit" (spaces aside, a truth takes one text) or "skipping" (for materials: a truth goes on, and the text
    behind a removed one is passed over).
    """
    skipping = variant == "skipping"
    tp = match_count(cutoff, spaceless=not skipping, skipping=skipping)(F.col(truth), F.col(found))
    sizes = [F.greatest(F.size(c), F.lit(0)).alias(n) for c, n in ((truth, "_n"), (found, "_m"))]
    # both lists lie in the row, so nothing is shuffled
    rows = results.select(key, *sizes, tp.alias("tp"))
    return rows.select(key, "tp", (F.col("_m") - F.col("tp")).alias("fp"), (F.col("_n") - F.col("tp")).alias("fn"))


def tolerance_scores(truth: Column, found: Column) -> Column:
    """struct(accuracy, precision, recall) of two structs (char1, char2); accuracy is by the two letters."""
    same = [truth[c] == found[c] for c in ("char1", "char2")]
    tp = sum((s.cast("int") for s in same[1:]), same[0].cast("int"))
    wrong = [(~s & (F.length(found[c]) > 0)).cast("int") for s, c in zip(same, ("char1", "char2"), strict=True)]
    fp = wrong[0] + wrong[1]
    fn = 2 - tp - fp
    both = scores(tp, fp, fn)
    return F.struct((tp / 2).alias("accuracy"), both["precision"].alias("precision"), both["recall"].alias("recall"))


def match_names(results: DataFrame, truth: str, found: str, *, above: float = 90, out: str = "match") -> DataFrame:
    """``results`` plus ``out``: 1.0 when the names match fuzzily, case aside, else 0.0; also where either is null.

    A name inside the other matches in full. Only distinct pairs that this doesn't decide are aligned.
    """
    t, f = F.lower(truth), F.lower(found)
    inside = ((t.contains(f) | f.contains(t)) & (t != "") & (f != "")) | (t == f)
    marked = results.withColumns({"_t": t, "_f": f, "_in": F.coalesce(inside, F.lit(False))})
    open_ = marked.where("not _in and _t is not null and _f is not null").select("_t", "_f").distinct()
    scored = open_.withColumn("_s", partial_ratio("_t", "_f"))
    return marked.join(scored, ["_t", "_f"], "left").select(*results.columns, F.when(F.col("_in") | (F.col("_s") > above), 1.0).otherwise(0.0).alias(out))


def measure_distance(truth: Column, found: Column) -> Column:
    """Least sum of size ratios over the orders of three true measures; a zero side counts as the other. Found ones are padded with 0."""
    padded = F.slice(F.concat(found.cast("array<double>"), F.array(*[F.lit(0.0)] * 3)), 1, 3)

    def gap(a: Column, b: Column) -> Column:
        return F.when((a == 0) | (b == 0), F.greatest(a, b)).otherwise(F.greatest(a, b) / F.nullif(F.least(a, b), F.lit(0.0)))

    sums = []
    for order in permutations(range(3)):
        parts = [gap(F.get(truth.cast("array<double>"), F.lit(p)), F.get(padded, F.lit(i))) for i, p in enumerate(order)]
        sums.append(parts[0] + parts[1] + parts[2])
    return F.least(*sums)


#: Fields of more values than this get their median by counting passes.
GATHERED = 100_000
#: Bins of a counting pass.
BINS = 1_024


def field_summary(values: DataFrame, field: str = "field", value: str = "value", gathered: int | None = None) -> DataFrame:
    """(field, mean, median, n) of the scores of each field, all exact. Null values and NaN don't count.

    Medians of fields of more than ``gathered`` values (default: GATHERED) are found by ``selected_medians``, so no task holds such a field.
    """
    gathered = GATHERED if gathered is None else gathered
    x = F.col(value).cast("double")
    clean = values.select(field, F.when(~F.isnan(x), x).alias("_v"))
    stats = stored(clean.groupBy(field).agg(F.avg("_v").alias("mean"), F.count("_v").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "stats")
    large = stats.where(F.col("n") > gathered)
    if large.isEmpty():
        few = clean.groupBy(field).agg(F.percentile("_v", F.lit(0.5)).alias("median"))
    else:
        some = clean.join(large.select(F.col(field).alias("_f")), F.col(field).eqNullSafe(F.col("_f")), "left_anti")
        many = selected_medians(clean.where("_v is not null"), large.select(field, F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), "n"), field)
        few = some.groupBy(field).agg(F.percentile("_v", F.lit(0.5)).alias("median")).unionByName(many)
    medians = few.withColumnRenamed(field, "_f")
    return stats.join(medians, F.col(field).eqNullSafe(F.col("_f")), "left").select(field, "mean", "median", "n")


def selected_medians(values: DataFrame, spans: DataFrame, field: str) -> DataFrame:
    """(field, median) of ``values`` (field, _v), from ``spans`` (field, lo, hi, n), by selection.

    Each pass counts the values of a field's range in equal bins, with the least and greatest of each bin. Where the two middle places lie in two bins, or in one
    of a single value, they are found; else the range shrinks to that bin's least and greatest value. A pass sends one row for each task, field and bin.
    Infinite values count as the largest double.
    """
    largest = F.lit(1.7976931348623157e308)
    v = F.least(largest, F.greatest(-largest, F.col("_v")))
    values = values.select(F.col(field).alias("_f"), v.alias("_v"))
    held = {c: F.least(largest, F.greatest(-largest, F.col(c))) for c in ("lo", "hi")}
    middle = {"k1": F.floor((F.col("n") - 1) / 2), "k2": F.floor(F.col("n") / 2)}
    state = stored(spans.select(field, *[c.alias(k) for k, c in held.items()], *[c.cast("long").alias(k) for k, c in middle.items()]), "ranges")
    found = []
    while not state.isEmpty():
        rows = values.join(state, F.col("_f").eqNullSafe(F.col(field))).where("_v between lo and hi")
        # halves, so that no difference overflows
        share = (F.col("_v") / 2 - F.col("lo") / 2) / F.nullif(F.col("hi") / 2 - F.col("lo") / 2, F.lit(0.0))
        at = F.least(F.lit(BINS - 1), F.floor(F.coalesce(share, F.lit(0.0)) * BINS)).cast("int")
        counts = rows.groupBy(field, "k1", "k2", at.alias("bin")).agg(F.count("*").alias("c"), F.min("_v").alias("least"), F.max("_v").alias("most"))
        running = Window.partitionBy(field).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        placed = counts.withColumn("before", F.coalesce(F.sum("c").over(running), F.lit(0)))

        def holds(k: str) -> Column:
            return (F.col("before") <= F.col(k)) & (F.col(k) < F.col("before") + F.col("c"))

        ends = {"lo": F.max(F.when(holds("k1"), F.col("least"))), "low": F.max(F.when(holds("k1"), F.col("most"))), "high": F.max(F.when(holds("k2"), F.col("least"))), "before": F.max(F.when(holds("k1"), F.col("before")))}
        both = F.max(holds("k1") & holds("k2"))
        step = stored(placed.groupBy(field, "k1", "k2").agg(*[c.alias(k) for k, c in ends.items()], both.alias("same")), "pass")
        one = F.col("same") & (F.col("lo") == F.col("low"))
        found.append(step.where(~F.col("same") | one).select(field, (0.5 * F.col("low") + 0.5 * F.col("high")).alias("median")))
        state = step.where(F.col("same") & ~one).select(field, "lo", F.col("low").alias("hi"), (F.col("k1") - F.col("before")).alias("k1"), (F.col("k2") - F.col("before")).alias("k2"))
    return reduce(DataFrame.unionByName, found)


def histogram(values: DataFrame, field: str = "field", value: str = "value", bins: int = 20) -> DataFrame:
    """(field, bin, n): equal bins between least and greatest value of a field; the last one is closed."""
    span = values.groupBy(field).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    x, lo, hi = F.col(value), F.col("_lo"), F.col("_hi")
    at = F.when(hi == lo, F.lit(bins // 2)).otherwise(F.least(F.lit(bins - 1), F.floor((x - lo) / F.nullif(hi - lo, F.lit(0.0)) * bins).cast("int")))
    return values.where(x.isNotNull()).join(span, field).groupBy(field, at.alias("bin")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------------------ retrieval


def relevance_codes(labels: DataFrame, label: str = "label") -> DataFrame:
    """``labels`` plus relevance (1, 0 partly, -1) and feature (0 both, 1, 2, -1) of a label text."""
    text = F.col(label)
    one, two, no = text.contains("Feature 1"), text.contains("Feature 2"), text.contains("NOT")
    return labels.withColumns({"relevance": F.when(one | two, 0).when(no, -1).otherwise(1), "feature": F.when(one, 1).when(two, 2).when(no, -1).otherwise(0)})


def precision_at_k(ranked: DataFrame, k: int, *, key: str = "prompt_id", rank: str = "rank", relevance: str = "relevance", by: list[str] | None = None, partial: bool = False) -> DataFrame:
    """Mean share of relevant rows among the first k of each key, by ``by`` (default: overall).

    Divides by k even where fewer rows exist. With ``partial`` two columns: partly relevant rows as right, and as wrong.
    """
    by = by or []
    top = ranked.where(F.col(rank) <= k)
    keys = ranked.select(*dict.fromkeys([*by, key])).distinct()
    hit = F.sum(F.when(F.col(relevance) == 1, 1).otherwise(0)) / F.lit(float(k))
    partly = F.sum(F.when(F.col(relevance) >= 0, 1).otherwise(0)) / F.lit(float(k))
    each = top.groupBy(*dict.fromkeys([*by, key])).agg(hit.alias("_p"), partly.alias("_q"))
    full = keys.join(each, list(dict.fromkeys([*by, key])), "left")
    means = [F.avg(F.coalesce("_p", F.lit(0.0))).alias("precision"), F.count("*").alias("n")]
    if partial:
        means.insert(1, F.avg(F.coalesce("_q", F.lit(0.0))).alias("precision_partly"))
    return full.groupBy(*by).agg(*means)


def ranks_in_chunks(labels: DataFrame, pos: str = "pos", size: int = 5) -> DataFrame:
    """``labels`` plus prompt_id and rank: labels come in chunks of ``size`` in the order of prompts."""
    return labels.withColumns({"prompt_id": F.floor(F.col(pos) / size).cast("int"), "rank": (F.pmod(F.col(pos), F.lit(size)) + 1).cast("int")})


def per_tag_relevance(ranked: DataFrame) -> DataFrame:
    """(prompt_id, tag, rank, relevance): one relevance list for each tag of a prompt with two.

    ``ranked`` has tags and feature; a row counts for a tag when both features fit, or the tag's.
    """
    rows = ranked.select("prompt_id", "rank", "feature", F.posexplode("tags").alias("_i", "tag"))
    fits = (F.col("feature") == 0) | (F.col("feature") == F.col("_i") + 1)
    return rows.select("prompt_id", "tag", "rank", F.when(fits, 1).otherwise(-1).alias("relevance"))


def all_prompts(simple: DataFrame, per_tag: DataFrame) -> DataFrame:
    """(prompt, rank, relevance) of simple prompts (prompt_id, rank, relevance) and of two-tag ones, one list for each tag.

    ``per_tag`` is as of ``per_tag_relevance``. prompt is a struct, so that ids of the two sets don't meet.
    """
    none = F.lit(None).cast("string")
    one = simple.select(F.struct(F.lit("simple").alias("kind"), F.col("prompt_id").cast("string").alias("id"), none.alias("tag")).alias("prompt"), "rank", "relevance")
    two = per_tag.select(F.struct(F.lit("complex").alias("kind"), F.col("prompt_id").cast("string").alias("id"), F.col("tag")).alias("prompt"), "rank", "relevance")
    return one.unionByName(two)


def labelling_tasks(prompts: DataFrame, hits: DataFrame, documents: DataFrame, k: int = 5, key: str = "drawing_id") -> DataFrame:
    """(prompt_id, prompt, tags, rank, document columns): the first k of each retrieval, to be labelled."""
    top = hits.where(F.col("rank") <= k).withColumnRenamed("query_id", "prompt_id")
    return prompts.join(top, "prompt_id").join(documents, key)


# ------------------------------------------------------------------------------ segmentation


def truth_classes(view_is_paper: Column, is_shape: Column) -> Column:
    """2 shape, 1 clutter (ink that is no shape), 0 background."""
    return F.when(is_shape, 2).when(view_is_paper, 0).otherwise(1)


def _pixels(pixels: DataFrame, which: Column | None = None) -> Column:
    """Number of pixels, of those ``which`` holds for."""
    n = F.col("n") if "n" in pixels.columns else F.lit(1)
    return F.coalesce(F.sum(n if which is None else F.when(which, n)), F.lit(0)).cast("long")


def class_counts(pixels: DataFrame, classes: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """(image_id, class, tp, fp, fn) of label pairs; one row for each image and class.

    A row is a pixel or, with a column n as of ``labelmaps.map_pairs``, that many; so in all scores below.
    """
    pairs = pixels.groupBy("image_id", "gt", "pred").agg(_pixels(pixels).alias("n"))
    rows = pairs.select("image_id", "gt", "pred", "n", F.explode(F.array(*[F.lit(c) for c in classes])).alias("class"))
    g, p = F.col("gt") == F.col("class"), F.col("pred") == F.col("class")

    def total(which: Column) -> Column:
        return F.sum(F.when(which, F.col("n")).otherwise(0))

    return rows.groupBy("image_id", "class").agg(total(g & p).alias("tp"), total(~g & p).alias("fp"), total(g & ~p).alias("fn"))


def overlap(tp: Column, fp: Column, fn: Column, empty: float | None = None) -> tuple[Column, Column]:
    """IoU and Dice; ``empty`` where nothing is there."""
    some = tp + fp + fn > 0
    iou = F.when(some, tp / F.nullif(tp + fp + fn, F.lit(0)))
    dice = F.when(some, 2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)))
    return (iou, dice) if empty is None else (F.coalesce(iou, F.lit(empty)), F.coalesce(dice, F.lit(empty)))


def per_class_scores(pixels: DataFrame) -> DataFrame:
    """(image_id, class, tp, fp, fn, iou, dice); null where the class is absent in both."""
    counts = class_counts(pixels)
    iou, dice = overlap(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.withColumns({"iou": iou, "dice": dice})


def segmentation_scores(pixels: DataFrame) -> DataFrame:
    """One row: foreground macro scores averaged over images, micro scores over all images and classes, mean macro ones."""
    each = per_class_scores(pixels)
    fore = F.when(F.col("class") > 0, F.col("iou")), F.when(F.col("class") > 0, F.col("dice"))
    images = each.groupBy("image_id").agg(
        F.avg("iou").alias("iou_macro"), F.avg("dice").alias("dice_macro"), F.avg(fore[0]).alias("iou_fg"), F.avg(fore[1]).alias("dice_fg"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    )
    iou, dice = overlap(F.sum("tp"), F.sum("fp"), F.sum("fn"))
    return images.agg(F.count("*").alias("images"), F.avg("iou_macro").alias("iou_macro"), F.avg("dice_macro").alias("dice_macro"), F.avg("iou_fg").alias("iou_macro_fg"), F.avg("dice_fg").alias("dice_macro_fg"), iou.alias("iou_micro"), dice.alias("dice_micro"))


def binary_scores(pixels: DataFrame, value: int = 0) -> DataFrame:
    """(image_id, iou, dice) of one class against the rest; 1 where it's nowhere."""
    g, p = F.col("gt") == value, F.col("pred") == value
    counts = pixels.groupBy("image_id").agg(_pixels(pixels, g & p).alias("tp"), _pixels(pixels, ~g & p).alias("fp"), _pixels(pixels, g & ~p).alias("fn"))
    iou, dice = overlap(F.col("tp"), F.col("fp"), F.col("fn"), empty=1.0)
    return counts.select("image_id", iou.alias("iou"), dice.alias("dice"))
