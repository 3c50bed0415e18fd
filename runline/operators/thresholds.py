"""The threshold of each fold, chosen on its training sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runline.operators import intervals, matching


def threshold_grid(spark: SparkSession, low: float = 0.2, high: float = 0.8, step: float = 0.025) -> DataFrame:
    """25 values from 0.200 to 0.800, rounded to 3 digits."""
    n = round((high - low) / step) + 1
    return spark.range(n).select(F.round(F.lit(low) + F.col("id") * F.lit(step), 3).alias("threshold"))


def rows_reaching(rows: DataFrame, value: str, grid: list[float], keys: list[str]) -> DataFrame:
    """(keys, threshold, n_rows): rows with at least each threshold. A row is counted once, with the number of thresholds it reaches; thresholds
    multiply these counts only."""
    levels = sorted(grid)
    reach = sum((F.col(value) >= t).cast("int") for t in levels)
    counts = rows.groupBy(*keys, reach.alias("_k")).agg(F.count("*").alias("_n"))
    each = counts.select(*keys, "_k", "_n", F.posexplode(F.array(*[F.lit(t) for t in levels])).alias("_i", "threshold"))
    return each.groupBy(*keys, "threshold").agg(F.coalesce(F.sum(F.when(F.col("_k") > F.col("_i"), F.col("_n"))), F.lit(0)).alias("n_rows"))


def threshold_scores(
    smoothed: DataFrame, gt: DataFrame, thresholds: list[float], keys: list[str], value: str, gap: int, min_len: int, iou_weight: float = 0.7, f1_weight: float = 0.3, order: str = "row_idx"
) -> DataFrame:
    """Objective of each series at each threshold: 0.7 mean best IoU + 0.3 f1. Rows are compressed to runs before the
    thresholds multiply anything."""
    pred = intervals.runs_over_thresholds(smoothed, value, thresholds, keys, gap, min_len, order)
    return scores_of(pred, gt.select(*keys, "start", "end"), smoothed.select(*keys).distinct(), thresholds, keys, iou_weight, f1_weight)


def scores_of(pred: DataFrame, gt: DataFrame, series: DataFrame, thresholds: list[float], keys: list[str], iou_weight: float = 0.7, f1_weight: float = 0.3) -> DataFrame:
    """The same for given intervals of each series and threshold."""
    grid = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    scored = matching.evaluate_segments(pred, gt.select(*keys, "start", "end", grid), series.select(*keys, grid), [*keys, "threshold"])
    return scored.select(*keys, "threshold", (F.lit(iou_weight) * F.col("mean_best_gt_iou") + F.lit(f1_weight) * F.col("f1")).alias("objective"))


def best_threshold(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the threshold of the best mean objective over its rows, the lowest one on ties."""
    mean = scores.groupBy(*keys, "threshold").agg(F.round(F.avg("objective"), 9).alias("train_objective"))
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("train_objective"), "threshold"))
    return mean.withColumn("_r", best).where("_r = 1").drop("_r")


def select_threshold(scores: DataFrame, folds: DataFrame, session: str = "session_id") -> DataFrame:
    """Per fold the best threshold over its training sessions."""
    return best_threshold(folds.join(scores.withColumnRenamed(session, "train_session"), "train_session"), ["test_session"])
