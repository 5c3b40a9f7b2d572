"""Evaluation, quality and run metrics: counts, ratios, percentiles, one-to-one scoring against a truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import geometry as G
from palimpsest.functions import quality as Q
from palimpsest.functions import similarity as S

from .matching import greedy_match


def _over(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


# --- precision and recall ------------------------------------------------------------------------------------------------------------


def with_ratios(counts: DataFrame) -> DataFrame:
    """tp, fp, fn with precision, recall, f1 and accuracy; nothing over nothing is 0."""
    c = F.col
    out = counts.withColumns({"precision": _over(c("tp"), c("tp") + c("fp")), "recall": _over(c("tp"), c("tp") + c("fn")), "accuracy": _over(c("tp"), c("tp") + c("fp") + c("fn"))})
    return out.withColumn("f1", _over(2 * c("precision") * c("recall"), c("precision") + c("recall")))


def precision_recall(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tp, fp, fn and ratios of rows(keys, truth, predicted) of booleans."""
    t, p = F.col("truth"), F.col("predicted")
    return with_ratios(rows.groupBy(*keys).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn")))


def set_precision_recall(predicted: DataFrame, truth: DataFrame, keys: list[str], item: str) -> DataFrame:
    """keys, tp, fp, fn and ratios of two sets of items, such as pages."""
    a, b = predicted.select(*keys, item).distinct().withColumn("p", F.lit(True)), truth.select(*keys, item).distinct().withColumn("t", F.lit(True))
    rows = a.join(b, [*keys, item], "full_outer").select(*keys, F.coalesce("t", F.lit(False)).alias("truth"), F.coalesce("p", F.lit(False)).alias("predicted"))
    return precision_recall(rows, keys)


def macro_average(scores: DataFrame) -> DataFrame:
    """Means over groups, and the range of f1."""
    return scores.agg(F.count(F.lit(1)).alias("n_groups"), *(F.avg(c).alias(f"mean_{c}") for c in ("precision", "recall", "f1")), F.min("f1").alias("min_f1"), F.max("f1").alias("max_f1"))


def matches_truth(tolerance: float = 0.1, least_text: float = 0.6) -> Column:
    """Join condition of prediction p and truth t of one page: types agree, and place or text do. A modification also meets an
    addition or deletion."""
    c = F.col
    kind = (c("p.diff_type") == c("t.diff_type")) | (c("p.diff_type") == "modified") | (c("t.diff_type") == "modified")
    place = (F.abs(G.center_x("p.bbox") - G.center_x("t.bbox")) <= tolerance) & (F.abs(G.center_y("p.bbox") - G.center_y("t.bbox")) <= tolerance)
    text = F.greatest(S.match_similarity("p.old_text", "t.old_text"), S.match_similarity("p.new_text", "t.new_text")) >= least_text
    return (c("p.change_type") == c("t.change_type")) & kind & (F.coalesce(place, F.lit(False)) | text)


def score_predictions(predicted: DataFrame, truth: DataFrame, by_type: bool = False) -> DataFrame:
    """pair_id (and change_type), tp, fp, fn and ratios: each prediction, in order, takes the first truth that is free and fits.

    predicted and truth: pair_id, page_num, number (their order), diff_type, change_type, old_text, new_text, bbox.
    """
    p, t = predicted.alias("p"), truth.alias("t")
    rows = p.join(t, (F.col("p.pair_id") == F.col("t.pair_id")) & (F.col("p.page_num") == F.col("t.page_num")) & (F.col("p.change_type") == F.col("t.change_type"))).filter(matches_truth())
    cand = rows.select(F.col("p.pair_id").alias("pair_id"), F.col("p.number").alias("a"), F.col("t.number").alias("b"), F.lit(1.0).alias("score"), F.col("p.change_type").alias("change_type"))
    keys = ["pair_id", "change_type"] if by_type else ["pair_id"]
    tp = greedy_match(cand, ["pair_id"]).join(predicted.select("pair_id", F.col("number").alias("a"), "change_type"), ["pair_id", "a"]).groupBy(*keys).agg(F.count(F.lit(1)).alias("tp"))
    n_p, n_t = predicted.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_p")), truth.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_t"))
    out = n_p.join(n_t, keys, "full_outer").join(tp, keys, "left").na.fill(0, ["n_p", "n_t", "tp"])
    return with_ratios(out.select(*keys, "tp", (F.col("n_p") - F.col("tp")).alias("fp"), (F.col("n_t") - F.col("tp")).alias("fn")))


def pair_score(pred_text: Column, true_text: Column, same_page: Column, same_type: Column) -> Column:
    """A text score that counts on the same page and for the same type only."""
    return F.when(same_page & same_type, S.match_similarity(pred_text, true_text)).otherwise(0.0)


# --- documents and runs ----------------------------------------------------------------------------------------------------------------


def nearest_rank(sorted_values: Column, share: float) -> Column:
    """The value at floor(n * share) of a sorted array, not interpolated; null if it is empty."""
    n = F.size(sorted_values)
    return F.try_element_at(sorted_values, F.greatest(F.least(F.floor(n * share).cast("int"), n - 1), F.lit(0)) + 1)


def manifest(blocks: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, pages, blocks, lines, characters, kind of document and confidences of blocks(keys, page_num, text, confidence, is_ocr)."""
    rows = blocks.groupBy(*keys).agg(
        F.count_distinct("page_num").alias("n_pages"),
        F.count(F.lit(1)).alias("n_blocks"),
        F.sum(F.size(F.split("text", "\n"))).alias("n_lines"),
        F.sum(F.length("text")).alias("n_chars"),
        F.bool_or("is_ocr").alias("_any"),
        F.bool_and("is_ocr").alias("_all"),
        F.array_sort(F.collect_list("confidence")).alias("_c"),
    )
    kind = F.when(F.col("_all"), "scanned").when(F.col("_any"), "hybrid").otherwise("digital")
    return rows.withColumns({"doc_kind": kind, **{f"confidence_p{int(p * 100)}": nearest_rank(F.col("_c"), p) for p in (0.1, 0.5, 0.9)}}).drop("_any", "_all", "_c")


def confidence_stats(words: DataFrame, keys: list[str], high: float = 80) -> DataFrame:
    """keys, n_words, n_empty (below 0), mean, median and the share of high confidences."""
    c = F.col("confidence")
    return words.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_words"), F.count_if(c < 0).alias("n_empty"), F.avg(F.when(c >= 0, c)).alias("mean"), F.median(F.when(c >= 0, c)).alias("median"), (F.count_if(c >= high) / F.count(F.lit(1))).alias("share_high"))


def calibration(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, mean, median, sample deviation, range and count of confidences."""
    c = "confidence"
    return words.groupBy(*keys).agg(F.avg(c).alias("mean"), F.median(c).alias("median"), F.stddev_samp(c).alias("stdev"), F.min(c).alias("min"), F.max(c).alias("max"), F.count(c).alias("n"))


def page_ocr_quality(blocks: DataFrame, keys: list[str], least_chars: int = 20, least_confidence: float = 0.4, most_gibberish: float = 0.5) -> DataFrame:
    """keys, n_chars, mean_confidence (percentages as shares), gibberish, is_low of blocks(keys, text, confidence)."""
    share = F.when(F.col("confidence") > 1, F.col("confidence") / 100).otherwise(F.col("confidence"))
    good = F.regexp_count("text", F.lit(r"[\p{L}\p{N}\s]"))
    out = blocks.groupBy(*keys).agg(F.sum(F.length("text")).alias("n_chars"), F.avg(share).alias("mean_confidence"), (1 - F.sum(good) / F.greatest(F.sum(F.length("text")), F.lit(1))).alias("gibberish"))
    return out.withColumn("is_low", (F.col("n_chars") < least_chars) | (F.col("mean_confidence") < least_confidence) | (F.col("gibberish") > most_gibberish))


def ocr_successful(pages: DataFrame, keys: list[str], least_blocks: int = 1, least_chars: int = 50) -> DataFrame:
    """keys, ok: some page that is not low has blocks enough, or there is text enough and not all pages are low."""
    return pages.groupBy(*keys).agg((F.bool_or((F.col("n_blocks") >= least_blocks) & ~F.col("is_low")) | ((F.sum("n_chars") >= least_chars) & ~F.bool_and("is_low"))).alias("ok"))


def is_scanned(pages: DataFrame, keys: list[str], sample: int = 5, least: float = 0.1) -> DataFrame:
    """keys, is_scanned: of the first pages too few have 50 characters of sound text; pages(keys, page_num, text)."""
    stats = Q.text_layer_stats("text")
    rows = pages.filter(F.col("page_num") <= sample).withColumn("_s", stats)
    good = (F.col("_s.n") >= 50) & ~Q.looks_like_garbage("_s")
    return rows.groupBy(*keys).agg((F.avg(good.cast("int")) < least).alias("is_scanned"))


def is_digital(pages: DataFrame, keys: list[str], sample: int = 2, least: float = 200) -> DataFrame:
    """keys, is_digital: the first pages hold so many characters on average."""
    return pages.filter(F.col("page_num") <= sample).groupBy(*keys).agg((F.avg(F.length(F.trim("text"))) >= least).alias("is_digital"))


def quality_report(diffs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, counts by severity, share of phantoms, precision proxy and a score of 0 to 100 of diffs(keys, severity, confidence)."""
    n = lambda s: F.count_if(F.col("severity") == s).alias(s)
    rows = diffs.groupBy(*keys).agg(*(n(s) for s in ("none", "low", "medium", "high", "critical")), F.count(F.lit(1)).alias("total"), F.avg("confidence").alias("mean_confidence"))
    c = F.col
    total = F.greatest(c("total"), F.lit(1))
    rows = rows.withColumns({"phantom_ratio": c("none") / total, "precision_proxy": (c("total") - c("none")) / total, "significant_share": (c("medium") + c("high") + c("critical")) / total})
    return rows.withColumn("quality_score", 40 * c("precision_proxy") + 30 * (1 - c("phantom_ratio")) + 30 * c("significant_share"))


def engine_parity(pairs: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """keys, mean, least and greatest similarity of two engines' texts."""
    rows = pairs.withColumn("_r", S.ratio(a, b))
    return rows.groupBy(*keys).agg(F.avg("_r").alias("mean"), F.min("_r").alias("min"), F.max("_r").alias("max"), F.count(F.lit(1)).alias("n"))


def gating_stats(gates: DataFrame, keys: list[str]) -> DataFrame:
    """keys, counts of gate decisions and the shares skipped, phantom and semantic of gates(keys, gate)."""
    d, r = F.col("gate.decision"), F.col("gate.reason")
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    return gates.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.count_if(d == "same") / n).alias("skip_rate"), (F.count_if((d == "same") & (r != "identical")) / n).alias("phantom_rate"), (F.count_if(r.isin("semantic", "no_embedding")) / n).alias("semantic_rate"))


def run_performance(runs: DataFrame, target: float = 3.0) -> DataFrame:
    """runs(total_seconds, pages) with seconds a page, pages a minute and whether the target is met."""
    per = F.col("total_seconds") / F.greatest(F.col("pages"), F.lit(1))
    return runs.withColumns({"seconds_per_page": per, "pages_per_minute": _over(60 * F.col("pages"), F.col("total_seconds")), "on_target": per < target})


def fusion_reduction(before: Column, after: Column) -> Column:
    """Percent fewer diffs after fusion."""
    return F.when(before > 0, (1 - after / before) * 100).otherwise(0.0)


def bbox_variety(boxes: DataFrame, keys: list[str], least: float = 0.01) -> DataFrame:
    """keys, varied, in_unit: whether boxes differ in place and size, and lie between 0 and 1."""
    spread = lambda n: F.max(F.col(f"bbox.{n}")) - F.min(F.col(f"bbox.{n}"))
    return boxes.groupBy(*keys).agg(((spread("x") > least) | (spread("y") > least) | (spread("width") > least) | (spread("height") > least)).alias("varied"), F.bool_and(G.is_share("bbox")).alias("in_unit"))


def dense_index(rows: DataFrame, value: str, index: str) -> DataFrame:
    """value, index (from 0) of the distinct values in sorted order, without bringing them together: ranges of values are numbered
    alone, after those before them."""
    ranged = rows.select(value).distinct().repartitionByRange(value).sortWithinPartitions(value)
    numbered = ranged.select(value, F.spark_partition_id().alias("_part"))
    from palimpsest.session import stored

    numbered = stored(numbered, "dense-index")  # the ranges must not be drawn twice
    sizes = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))  # a row a range
    within = F.row_number().over(Window.partitionBy("_part").orderBy(value)) - 1
    return numbered.withColumn("_k", within).join(F.broadcast(offsets), "_part").select(value, (F.col("_before") + F.col("_k")).cast("bigint").alias(index))
