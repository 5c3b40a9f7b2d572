"""What a reader of the differences asks for: nearby ones merged, stacked ones counted once, filters, next and previous."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import geometry as G
from palimpsest.functions import text as X


def _anchor() -> Column:
    """A diff's box, or else its box in the other document."""
    return F.coalesce("bbox", "bbox_b")


def merge_nearby(diffs: DataFrame, x_threshold: float = 0.05, y_threshold: float = 0.02) -> DataFrame:
    """Chains of diffs of equal types, each near the one before it (on its line sideways, or just below), as one each.

    Order is page, height, side; a diff without any box stays alone.
    """
    a = _anchor()
    w = Window.partitionBy("pair_id", "page_num").orderBy(F.coalesce(a["y"], F.lit(1e9)), F.coalesce(a["x"], F.lit(1e9)), "diff_id")
    before = F.lag(F.struct(a.alias("box"), "change_type", "diff_type")).over(w)
    rows = diffs.withColumns({"_box": a, "_before": before})
    b, p = F.col("_box"), F.col("_before.box")
    below = b["y"] - G.bottom(p)
    beside = b["x"] - G.right(p)
    same_line = F.abs(b["y"] - p["y"]) < y_threshold
    near = (below.between(0, y_threshold)) | (same_line & (beside < x_threshold))
    chained = (F.col("_before.change_type") == F.col("change_type")) & (F.col("_before.diff_type") == F.col("diff_type")) & near
    rows = rows.withColumn("_group", F.sum(F.when(F.coalesce(chained, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_n", F.row_number().over(w))
    texts = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.length(c) > 0, F.struct("_n", F.col(c).alias("t"))))), lambda t: t["t"]), " ")
    return rows.groupBy("pair_id", "page_num", "_group").agg(
        F.min_by("diff_id", "_n").alias("diff_id"),
        F.first("change_type").alias("change_type"),
        F.first("diff_type").alias("diff_type"),
        texts("old_text").alias("old_text"),
        texts("new_text").alias("new_text"),
        G.union_box("bbox").alias("bbox"),
        G.union_box("bbox_b").alias("bbox_b"),
        F.avg("confidence").alias("confidence"),
        F.count(F.lit(1)).alias("merged_count"),
    ).drop("_group")


def collapse_stacked(diffs: DataFrame, x_tolerance: float = 0.1) -> DataFrame:
    """Logical changes: diffs of one page, of equal types and about the same side, counted as one with all their boxes."""
    col = F.bround(G.center_x("bbox") / x_tolerance) * x_tolerance
    rows = diffs.withColumn("_col", F.coalesce(col.cast("string"), F.concat(F.lit("none/"), "diff_id")))
    order = F.struct(F.col("bbox.y").alias("y"), F.col("diff_id").alias("id"))
    texts = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.length(c) > 0, F.struct(order.alias("o"), F.col(c).alias("t"))))), lambda t: t["t"]), " ")
    return rows.groupBy("pair_id", "page_num", "change_type", "diff_type", "_col").agg(
        F.min_by("diff_id", order).alias("diff_id"),
        texts("old_text").alias("old_text"),
        texts("new_text").alias("new_text"),
        G.union_box("bbox").alias("bbox"),
        F.array_compact(F.collect_list("bbox")).alias("bboxes"),
        F.avg("confidence").alias("confidence"),
        F.count(F.lit(1)).alias("collapsed_count"),
    ).drop("_col")


def numbered(diffs: DataFrame) -> DataFrame:
    """diffs with their index (from 0) in a pair, in page order."""
    w = Window.partitionBy("pair_id").orderBy("page_num", F.coalesce(F.col("bbox.y"), F.lit(0.0)), F.coalesce(F.col("bbox.x"), F.lit(0.0)), "diff_id")
    return diffs.withColumn("index", F.row_number().over(w) - 1)


def shown(diffs: DataFrame, content: bool = True, formatting: bool = True, layout: bool = True, visual: bool = True) -> DataFrame:
    """Diffs of the chosen types; numbers that they have stay."""
    kinds = [k for k, on in (("content", content), ("formatting", formatting), ("layout", layout), ("visual", visual)) if on]
    return diffs.filter(F.col("change_type").isin(kinds)) if kinds else diffs.limit(0)


def neighbours(diffs: DataFrame) -> DataFrame:
    """Numbered diffs with the index of the next and the one before in their pair; after the last comes the first."""
    w = Window.partitionBy("pair_id").orderBy("index")
    whole = Window.partitionBy("pair_id")
    return diffs.withColumns({"next_index": F.coalesce(F.lead("index").over(w), F.min("index").over(whole)), "previous_index": F.coalesce(F.lag("index").over(w), F.max("index").over(whole))})


def by_index(diffs: DataFrame, pair_id: int, index: int) -> DataFrame:
    return diffs.filter((F.col("pair_id") == pair_id) & (F.col("index") == index))


def listed(diffs: DataFrame) -> DataFrame:
    """pair_id, page_num, change_type, description for a list."""
    return diffs.select("pair_id", "page_num", "change_type", F.coalesce("description", "subtype", "diff_type").alias("description"))


def is_punctuation_only(old: str = "old_text", new: str = "new_text", subtype: str = "subtype") -> Column:
    """The subtype says so, or no side has a letter or digit."""
    bare = lambda c: ~X._text(c).rlike(r"[\p{L}\p{N}]")
    return F.coalesce(F.col(subtype).isin("punctuation", "punctuation_shift"), F.lit(False)) | (bare(old) & bare(new))


def boxes_to_draw(side: str, words: str | None = None) -> Column:
    """The boxes of a diff on side a or b: of its words if it has some there, else its own; nothing for an addition on side a or
    a deletion on side b."""
    own = F.col("bbox") if side == "a" else F.coalesce("bbox_b", "bbox")
    main = F.when(own.isNotNull(), F.array(own)).otherwise(F.array().cast(f"array<{G.BOX}>"))
    hidden = F.col("diff_type") == ("added" if side == "a" else "deleted")
    out = main if words is None else F.when(F.size(words) > 0, F.col(words)).otherwise(main)
    return F.when(hidden, F.array().cast(f"array<{G.BOX}>")).otherwise(out)


def export_rows(diffs: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """One row a pair for a JSON sink: metadata, counts, and the diffs in page order as an array of structs."""
    order = F.struct("page_num", F.coalesce(F.col("bbox.y"), F.lit(0.0)).alias("y"), F.coalesce(F.col("bbox.x"), F.lit(0.0)).alias("x"), F.col("diff_id").alias("id"))
    listed_ = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.struct(*diffs.columns).alias("d")))), lambda r: r["d"])
    count = lambda c, v: F.count_if(F.col(c) == v).alias(v)
    out = diffs.groupBy("pair_id").agg(
        F.struct(F.count(F.lit(1)).alias("total"), *(count("change_type", v) for v in ("content", "formatting", "layout", "visual")), *(count("diff_type", v) for v in ("added", "deleted", "modified"))).alias("summary"),
        listed_.alias("diffs"),
    )
    out = out.withColumn("coordinate_system", F.struct(F.lit("share").alias("unit"), F.lit("top-left").alias("origin")))
    if pages is not None:
        sizes = pages.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("page_num", "width", "height"))).alias("pages"))
        out = out.join(sizes, "pair_id", "left")
    return out


def notes(diffs: DataFrame, preview: int = 100) -> DataFrame:
    """pair_id, page_num, color, note, bbox: what an annotated copy shows."""
    cut = lambda c: F.substring(X._text(c), 1, preview)
    color = F.when(F.col("diff_type") == "added", "green").when(F.col("diff_type") == "deleted", "red").otherwise("yellow")
    note = F.concat_ws(": ", F.initcap("diff_type"), F.concat_ws(" -> ", F.when(X._text("old_text") != "", cut("old_text")), F.when(X._text("new_text") != "", cut("new_text"))))
    return diffs.select("pair_id", "page_num", color.alias("color"), note.alias("note"), "bbox")
