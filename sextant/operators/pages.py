"""Recognised text lines to pages, and the choice between two readings of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions.strings import SPACE, clean_text, join_unique_texts, normalize_lines, squeeze
from sextant.operators.ranking import best_per_key
from sextant.settings import DEFAULTS, Settings

PAGE = ["doc_id", "page"]


def page_readings(lines: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Roll recognised lines (doc_id, page, line_no, text, score) up to pages.

    Low scores and repeated lines go; the rest gives the text, its confidences and the
    layout flags.
    """
    cleaned = (
        lines.withColumn("text", clean_text("text"))
        .filter((F.col("text") != "") & (F.col("score") >= settings.ocr_min_confidence))
        .withColumn("key", squeeze("text"))
    )
    firsts = best_per_key(
        cleaned.select(*PAGE, "key", "line_no", "text", "score"), [*PAGE, "key"], [F.col("line_no")]
    )
    pages = firsts.groupBy(*PAGE).agg(
        F.sort_array(F.collect_list(F.struct("line_no", "text", "score"))).alias("lines"),
        F.min("score").alias("min_confidence"),
        F.count("*").alias("line_count"),
    )
    # scores are added in the order of the lines: the last digit of a sum of doubles hangs on it, and a mean may be the limit
    total = F.aggregate("lines", F.lit(0.0), lambda acc, x: acc + x["score"])
    pages = pages.withColumn("avg_confidence", total / F.col("line_count"))
    return pages.select(
        *PAGE,
        normalize_lines(F.array_join(F.transform("lines", lambda x: x["text"]), "\n")).alias("text"),
        "avg_confidence",
        "min_confidence",
        "line_count",
        (F.col("avg_confidence") < settings.ocr_low_confidence).alias("low_confidence"),
        (F.col("line_count") >= settings.ocr_complex_layout_lines).alias("complex_layout"),
    )


def reading_reason(strategy, text, low_confidence, complex_layout) -> Column:
    """Why a page needs the second reading; empty when it does not."""
    kind = F.lit(strategy) if isinstance(strategy, str) else strategy
    return (
        F.when(kind.isin("vision", "vision_first"), F.lit("vision_first"))
        .when(kind == "hybrid", F.lit("hybrid"))
        .when(kind != "auto", F.lit(""))
        .when(F.coalesce(text, F.lit("")) == "", F.lit("no_ocr_text"))
        .when(low_confidence, F.lit("low_confidence"))
        .when(complex_layout, F.lit("complex_layout"))
        .otherwise(F.lit(""))
    )


def combine_readings(first: DataFrame, second: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Choose or merge two readings of each page.

    ``first`` comes from :func:`page_readings`; ``second`` has doc_id, page and
    second_text. A page without a usable second reading keeps the first one.
    """
    both = first.select("*", F.lit(True).alias("__has_first")).join(second, PAGE, "full_outer")
    other = F.substring(normalize_lines(F.coalesce("second_text", F.lit(""))), 1, settings.ocr_vision_max_chars)
    reason = reading_reason(
        settings.ocr_strategy, F.col("text"), F.coalesce("low_confidence", F.lit(False)),
        F.coalesce("complex_layout", F.lit(False)),
    )
    staged = both.select(
        *PAGE,
        F.coalesce("__has_first", F.lit(False)).alias("has_first"),
        F.coalesce("text", F.lit("")).alias("first_text"),
        other.alias("other_text"),
        reason.alias("reason"),
        "avg_confidence",
        "min_confidence",
        F.coalesce("line_count", F.lit(0)).alias("line_count"),
        F.coalesce("low_confidence", F.lit(True)).alias("low_confidence"),
        F.coalesce("complex_layout", F.lit(False)).alias("complex_layout"),
    )
    used = (F.col("reason") != "") & (F.col("other_text") != "")
    merged = F.col("reason").isin("hybrid", "complex_layout")
    mode = (
        F.when(~used, F.lit("ocr"))
        .when(~F.col("has_first"), F.lit("vision"))
        .when(merged, F.lit("hybrid"))
        .when(F.col("reason") == "vision_first", F.lit("vision_first"))
        .otherwise(F.lit("vision_fallback"))
    )
    text = (
        F.when(~used, F.col("first_text"))
        .when(F.col("has_first") & merged, join_unique_texts(F.array("first_text", "other_text")))
        .otherwise(F.col("other_text"))
    )
    return staged.select(
        *PAGE,
        F.when(F.col("has_first"), F.col("first_text")).otherwise(F.col("other_text")).alias("raw_text"),
        text.alias("clean_text"),
        mode.alias("mode"),
        F.col("reason"),
        used.alias("second_used"),
        "first_text",
        F.when(used, F.col("other_text")).otherwise(F.lit("")).alias("other_text"),
        "avg_confidence",
        "min_confidence",
        "line_count",
        "low_confidence",
        "complex_layout",
    ).filter("clean_text <> '' OR raw_text <> ''")


def reading_metadata(pages: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Hash, sizes, truncation flag and rounded confidences of combined readings."""
    limit = settings.ocr_raw_max_chars
    raw = F.col("raw_text")
    return pages.select(
        *PAGE,
        F.when(raw == "", F.lit("")).otherwise(F.sha2(raw, 256)).alias("raw_hash"),
        F.length(raw).cast("long").alias("raw_chars"),
        F.length("clean_text").cast("long").alias("clean_chars"),
        F.substring(raw, 1, limit).alias("raw_text"),
        (F.length(raw) > limit).alias("raw_truncated"),
        F.when(F.col("first_text") != "", F.sha2("first_text", 256)).alias("first_hash"),
        F.when(F.col("other_text") != "", F.sha2("other_text", 256)).alias("other_hash"),
        "mode",
        "second_used",
        F.col("line_count").cast("long").alias("line_count"),
        "low_confidence",
        "complex_layout",
        F.round(F.round("avg_confidence", 9), 4).alias("avg_confidence"),
        F.round(F.round("min_confidence", 9), 4).alias("min_confidence"),
    )


def sparse_pages(pages: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Pages within the page limit whose extracted text is too short, with its length."""
    chars = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), rf"(?U){SPACE}+", ""))
    counted = pages.groupBy(*PAGE).agg(F.sum(chars).alias("chars"))
    return counted.filter(
        (F.col("page") <= settings.ocr_page_limit) & (F.col("chars") < settings.ocr_page_min_chars)
    )
