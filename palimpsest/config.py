"""Settings and engine profiles: immutable values on the driver, and a small table for joins. Nothing global is changed by a run."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX = "spark.palimpsest."


@dataclass(frozen=True)
class Settings:
    """Thresholds that decide results. from_session() reads overrides such as spark.palimpsest.text_similarity_threshold."""

    text_similarity_threshold: float = 0.82
    ocr_text_similarity_threshold: float = 0.72
    formatting_change_threshold: float = 0.1
    font_size_change_threshold_pt: float = 1.0
    color_difference_threshold: int = 10
    block_alignment_distance_threshold: float = 100.0
    table_overlap_threshold: float = 0.3
    figure_overlap_threshold: float = 0.3
    table_structure_confidence_threshold: float = 0.5
    ocr_table_structure_confidence_threshold: float = 0.75
    table_style_inset_change_threshold: float = 0.02
    table_style_bbox_change_threshold: float = 0.01
    caption_search_distance: float = 100.0
    header_footer_band: float = 0.1
    header_footer_repetition: float = 0.33
    header_footer_match: float = 0.3
    ocr_min_text_similarity_for_match: float = 0.7
    ocr_min_change_chars: int = 1
    ocr_min_change_ratio: float = 0.005
    ocr_ignore_punctuation_diffs: bool = True
    ocr_ignore_whitespace_diffs: bool = True
    ocr_ignore_case_diffs: bool = True
    ocr_aggressive_noise_filter: bool = True
    skip_formatting_for_ocr: bool = True
    paragraph_gap: float = 1.5
    line_reflow_font_size_diff: float = 0.2
    always_merge_paragraphs: bool = True
    fusion_strategy: str = "triangulation"
    fusion_iou_threshold: float = 0.3
    line_alignment_threshold: float = 0.55
    layout_tolerance: float = 0.02
    report_unaligned_b: bool = False

    @classmethod
    def from_session(cls, spark: SparkSession) -> Settings:
        out = cls()
        for f in fields(cls):
            raw = spark.conf.get(PREFIX + f.name, None)
            if raw is not None:
                kind = type(getattr(out, f.name))
                out = replace(out, **{f.name: raw.lower() == "true" if kind is bool else kind(raw)})
        return out


@dataclass(frozen=True)
class EngineProfile:
    """What differs between sources of text."""

    engine_name: str
    text_similarity_threshold: float = 0.82
    semantic_change_threshold: float = 0.50
    gating_identical_threshold: float = 0.98
    gating_likely_identical_threshold: float = 0.92
    gating_gray_zone_low: float = 0.70
    gating_gray_zone_high: float = 0.85
    min_confidence_threshold: float = 0.3
    use_confidence_weighting: bool = True
    confidence_weight_power: float = 1.0
    ignore_punctuation_diffs: bool = True
    ignore_whitespace_diffs: bool = True
    ignore_case_diffs: bool = False
    aggressive_noise_filter: bool = False
    merge_hyphenated_words: bool = True
    normalize_diacritics: bool = False
    min_change_chars: int = 2
    min_change_ratio: float = 0.015
    skip_formatting_comparison: bool = True
    skip_header_footer_comparison: bool = True
    layout_position_tolerance: float = 0.05
    table_cell_text_threshold: float = 0.85
    table_structure_confidence_threshold: float = 0.5
    render_dpi: int = 100
    use_image_checksum: bool = False
    min_chars_per_page: int = 25
    min_avg_confidence: float = 0.55
    max_gibberish_ratio: float = 0.35


# One row an engine, in the order of the fields.
_ROWS = (
    ("paddle", 0.85, 0.50, 0.96, 0.90, 0.70, 0.85, 0.5, True, 1.5, True, True, False, True, True, False, 2, 0.02, True, True, 0.04, 0.80, 0.6, 100, True, 25, 0.60, 0.30),
    ("tesseract", 0.78, 0.45, 0.94, 0.86, 0.65, 0.82, 0.35, True, 1.0, True, True, True, True, True, True, 3, 0.025, True, True, 0.06, 0.70, 0.7, 100, True, 20, 0.45, 0.40),
    ("deepseek", 0.88, 0.55, 0.97, 0.92, 0.72, 0.88, 0.0, False, 1.0, True, True, False, False, True, False, 2, 0.015, True, False, 0.03, 0.85, 0.5, 72, False, 30, 0.0, 0.25),
    ("native", 0.90, 0.60, 0.99, 0.95, 0.80, 0.92, 0.0, False, 1.0, False, False, False, False, False, False, 1, 0.01, False, False, 0.02, 0.90, 0.3, 144, False, 10, 0.0, 0.10),
)
PROFILES = {r[0]: EngineProfile(*r) for r in _ROWS}


def profile(engine: str | None) -> EngineProfile:
    """The profile of an engine; native for others."""
    return PROFILES.get((engine or "").strip().lower(), PROFILES["native"])


def profile_table(spark: SparkSession) -> DataFrame:
    """Profiles as rows: four of them, for broadcast joins."""
    return spark.createDataFrame([asdict(p) for p in PROFILES.values()])


def with_profile(rows: DataFrame, engine: str) -> DataFrame:
    """rows with their engine's profile as a struct; unknown engines have that of native text."""
    table = profile_table(rows.sparkSession)
    keyed = table.select(F.col("engine_name").alias("_e"), F.struct(*table.columns).alias("profile"))
    name = F.lower(F.trim(F.coalesce(F.col(engine), F.lit(""))))
    known = F.when(name.isin(*PROFILES), name).otherwise("native")
    return rows.withColumn("_e", known).join(F.broadcast(keyed), "_e").drop("_e")


def document_engine(pages: DataFrame, keys: list[str], engine: str = "engine") -> DataFrame:
    """keys, engine: the first engine in page order."""
    return pages.groupBy(*keys).agg(F.coalesce(F.min_by(engine, F.when(F.col(engine).isNotNull(), F.col("page_num"))), F.lit("native")).alias("engine"))


def engine_priority(priority: list[str], policy: str = "auto_fallback") -> tuple[list[str], bool]:
    """The engines to try and whether falling back is allowed: a strict policy tries the first alone."""
    if policy not in ("strict", "auto_fallback"):
        raise ValueError(f"unknown policy {policy!r}")
    return (priority[:1], False) if policy == "strict" else (list(priority), True)


def select_engines(priority: list[str], available: dict[str, bool]) -> tuple[list[str], dict[str, str]]:
    """Engines that are there, in order, and why the others are not."""
    chosen = [e for e in priority if available.get(e)]
    return chosen, {e: "unavailable" if e in available else "unknown" for e in priority if e not in chosen}


def successful_attempt(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Of attempts(keys, rank, engine, ok, n_chars) the first that worked; without any, that of most characters with its failure."""
    best = F.struct((~F.col("ok")).cast("int").alias("failed"), F.when(F.col("ok"), F.col("rank")).otherwise(-F.col("n_chars")).alias("order"), F.col("rank").alias("r"))
    return attempts.groupBy(*keys).agg(F.min_by(F.struct("engine", "ok", "n_chars"), best).alias("_b"), F.array_sort(F.collect_list(F.struct("rank", "engine"))).alias("_tried")).select(
        *keys, "_b.engine", "_b.ok", "_b.n_chars", F.transform("_tried", lambda t: t["engine"]).alias("attempted")
    )
