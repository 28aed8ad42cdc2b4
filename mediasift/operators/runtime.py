"""Runtime statistics of a run: by item, overall, by engine, slowest files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift.functions.columns import safe_ms

SKIPPED = ("skipped", "skip", "disabled")
LABELS = ("OK", "REVIEW", "BLOCK")


def item_rollup(runs: DataFrame, items: DataFrame) -> DataFrame:
    """Time of each item by engine. runs: media_id, engine, engine_ord, took_ms; items: media_id, total_ms."""
    took = safe_ms(F.col("took_ms"))
    by_item = runs.groupBy("media_id").agg(
        F.sum(took).alias("engine_total_ms"),
        F.count("*").alias("engine_count"),
        F.max_by("engine", F.struct(took.alias("t"), (-F.col("engine_ord")).alias("o"))).alias("slowest_engine"),
        F.max(took).alias("slowest_engine_ms"),
    )
    zero = F.lit(0).cast("bigint")
    joined = items.select("media_id", safe_ms(F.col("total_ms")).alias("total_ms")).join(by_item, "media_id", "left")
    sums = {c: F.coalesce(c, zero) for c in ("engine_total_ms", "engine_count", "slowest_engine_ms")}
    joined = joined.withColumns(sums)
    return joined.withColumn("unattributed_ms", F.greatest(zero, F.col("total_ms") - F.col("engine_total_ms")))


def item_engines(runs: DataFrame) -> DataFrame:
    """media_id and engines: name, status and took_ms of each engine's run, in the order they stand."""
    run = F.struct("engine_ord", F.coalesce("engine", F.lit("engine")).alias("name"), F.lower(F.coalesce("status", F.lit(""))).alias("status"), safe_ms(F.col("took_ms")).alias("took_ms"))
    listed = F.transform(F.sort_array(F.collect_list(run)), lambda r: F.struct(r["name"].alias("name"), r["status"].alias("status"), r["took_ms"].alias("took_ms")))
    return runs.groupBy("media_id").agg(listed.alias("engines"))


def nearest_rank(column: str, q: float) -> Column:
    """The value at rank ceil(q/100 * n), q held to 0..100; 0 for no values."""
    share = min(100.0, max(0.0, q)) / 100
    return F.coalesce(F.expr(f"percentile_disc({share}D) WITHIN GROUP (ORDER BY {column})").cast("bigint"), F.lit(0).cast("bigint"))


def time_columns(column: str, prefix: str = "") -> list[Column]:
    """average (two decimals), whole median, minimum, maximum and 95th percentile of a millisecond column."""
    zero = F.lit(0).cast("bigint")
    return [
        F.coalesce(F.round(F.sum(column) / F.count("*"), 2), F.lit(0.0)).alias(f"avg_{prefix}ms"),
        F.coalesce(F.percentile(column, 0.5).cast("bigint"), zero).alias(f"median_{prefix}ms"),
        F.coalesce(F.min(column), zero).alias(f"min_{prefix}ms"),
        F.coalesce(F.max(column), zero).alias(f"max_{prefix}ms"),
        nearest_rank(column, 95).alias(f"p95_{prefix}ms"),
    ]


def file_summary(items: DataFrame, wall_ms: int | None = None) -> DataFrame:
    """One row over all items (total_ms)."""
    clean = items.select(safe_ms(F.col("total_ms")).alias("t"))
    total = F.coalesce(F.sum("t"), F.lit(0).cast("bigint"))
    wall = total if wall_ms is None else F.lit(max(0, int(wall_ms))).cast("bigint")
    return clean.agg(F.count("*").alias("total_files"), total.alias("total_ms"), wall.alias("total_wall_ms"), *time_columns("t", "file_"))


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """Items by label, the three usual ones even at zero."""
    found = verdicts.select(F.coalesce(F.when(F.col("label") != "", F.col("label")), F.lit("UNKNOWN")).alias("label")).groupBy("label").agg(F.count("*").alias("items"))
    usual = verdicts.sparkSession.createDataFrame([(x, 0) for x in LABELS], "label string, items bigint")
    return found.unionByName(usual).groupBy("label").agg(F.sum("items").alias("items"))


def engine_rollup(runs: DataFrame) -> DataFrame:
    """Runs, outcomes and times of each engine (engine, status, took_ms)."""
    status = F.lower(F.coalesce("status", F.lit("")))
    clean = runs.select(F.coalesce("engine", F.lit("engine")).alias("engine"), status.alias("s"), safe_ms(F.col("took_ms")).alias("t"))
    return clean.groupBy("engine").agg(
        F.count("*").alias("runs"),
        F.count_if(F.col("s") == "ok").alias("ok"),
        F.count_if(F.col("s").isin(*SKIPPED)).alias("skipped"),
        F.count_if(F.col("s") == "error").alias("error"),
        F.count_if(~F.col("s").isin("ok", "error", *SKIPPED)).alias("other_status"),
        F.sum("t").alias("total_ms"),
        *time_columns("t"),
    )


def engine_ranking(rollup: DataFrame) -> DataFrame:
    return rollup.orderBy(F.desc("total_ms"), F.desc("avg_ms"), "engine")


def slowest_files(items: DataFrame, k: int = 10) -> DataFrame:
    """The k slowest items; ties keep the order of input_ord."""
    return items.orderBy(F.desc("total_ms"), "input_ord").limit(k)


def exit_code(verdicts: DataFrame) -> DataFrame:
    """0 if there are items and all are OK, else 2."""
    return verdicts.agg(F.when(F.coalesce(F.bool_and(F.col("label") == "OK"), F.lit(False)), 0).otherwise(2).alias("exit_code"))
