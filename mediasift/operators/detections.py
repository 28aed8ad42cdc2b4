"""Detections folded into scores: conditional maxima, argmax labels, ignored labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift.functions.columns import clamp01


def _highest(when: Column, confidence: Column) -> Column:
    return F.coalesce(F.max(F.when(when, confidence)), F.lit(0.0))


def nudity_columns() -> list[Column]:
    """Highest confidence of classes named exposed, and of those named covered; other classes (faces) count for neither."""
    name, c = F.upper("label"), clamp01(F.col("confidence"))
    exposed = name.contains("EXPOSED")
    return [_highest(exposed, c).alias("nudity_exposed"), _highest(~exposed & name.contains("COVERED"), c).alias("nudity_covered")]


def weapon_columns() -> list[Column]:
    """Highest confidence by kind of weapon, told by the words in a label."""
    name, c = F.lower("label"), clamp01(F.col("confidence"))
    gun = name.contains("gun") | name.contains("firearm")
    firearm = gun | name.contains("rifle") | name.contains("pistol")
    knife = name.contains("knife") | name.contains("dagger")
    guns, toys, knives = _highest(firearm, c), _highest(name.contains("toy") & gun, c), _highest(knife, c)
    named = {"yolo_firearm_realistic": guns, "yolo_firearm_toy": toys, "yolo_firearm": guns, "yolo_knife": knives, "yolo_knife_dangerous": knives, "yolo_firearm_any": F.greatest(guns, toys)}
    return [value.alias(n) for n, value in named.items()]


def detection_scores(detections: DataFrame, *columns: Column) -> DataFrame:
    """One row an item with the given columns (nudity_columns, weapon_columns), in one aggregation."""
    return detections.groupBy("media_id").agg(*columns)


def symbol_scores(detections: DataFrame, ignore: tuple[str, ...] = (), review: float = 0.30, block: float = 0.90) -> DataFrame:
    """Counts, highest confidence and its label (the first of equals) of detections whose label isn't ignored."""
    kept = detections if not ignore else detections.filter(~F.lower(F.trim("label")).isin(*ignore))
    found = kept.groupBy("media_id").agg(F.count("*").alias("forbidden_symbols_detection_count"), F.max("confidence").alias("forbidden_symbols_max_conf"), F.max_by("label", F.struct("confidence", -F.col("seq"))).alias("top_label"))
    top = F.col("forbidden_symbols_max_conf")
    return found.withColumns({"forbidden_symbols_detected": F.lit(1.0), "forbidden_symbols_review_hit": F.when(top >= review, 1.0).otherwise(0.0), "forbidden_symbols_block_hit": F.when(top >= block, 1.0).otherwise(0.0)})


#: Scores of the symbol engine, in the order it gives them.
SYMBOL_SCORES = ("forbidden_symbols_detected", "forbidden_symbols_max_conf", "forbidden_symbols_review_hit", "forbidden_symbols_block_hit", "forbidden_symbols_detection_count", "forbidden_symbols_top_conf")
NOT_RUN = "FORBIDDEN_SYMBOLS_YOLO_MAX_FRAMES<=0"


def symbol_results(media: DataFrame, detections: DataFrame, most_frames: int = 2, ignore: tuple[str, ...] = (), review: float = 0.30, block: float = 0.90) -> DataFrame:
    """media_id, scores and details of every item; detections (frame_pos, …) of the first most_frames frames count.

    With most_frames of 0 or less no frame is looked at: all scores are 0 and details say why.
    """
    zeros = F.map_from_entries(F.array(*[F.struct(F.lit(n), F.lit(0.0)) for n in SYMBOL_SCORES]))
    if most_frames <= 0:
        told = F.create_map(*map(F.lit, ("detection_count", "0", "top_label", "", "inference_skipped", "true", "skip_reason", NOT_RUN)))
        return media.select("media_id", zeros.alias("scores"), told.alias("details"))
    found = symbol_scores(detections.filter(F.col("frame_pos") < most_frames), ignore, review, block).withColumn("forbidden_symbols_top_conf", F.col("forbidden_symbols_max_conf"))
    scores = F.create_map(*[x for n in SYMBOL_SCORES for x in (F.lit(n), F.col(n).cast("double"))])
    details = F.create_map(F.lit("detection_count"), F.coalesce(F.col("forbidden_symbols_detection_count"), F.lit(0)).cast("string"), F.lit("top_label"), F.coalesce("top_label", F.lit("")))
    joined = media.select("media_id").join(found, "media_id", "left")
    return joined.select("media_id", F.when(F.col("forbidden_symbols_detected").isNull(), zeros).otherwise(scores).alias("scores"), details.alias("details"))
