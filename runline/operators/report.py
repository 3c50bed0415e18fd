"""Row metrics and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runline.operators import intervals, ranges
from runline.operators.matching import f1_of, iou_pairs, ratio

METRICS = ["precision", "recall", "f1", "matched_mean_iou", "mean_best_gt_iou", "best_any_iou", "row_f1"]


def row_metrics(pred: DataFrame, gt: DataFrame, lengths: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy, precision, recall and f1 of rows, from intervals alone: overlaps of unions give the counts, no row is made.

    lengths: `keys` and `n_rows`. Predictions may overlap each other; intervals lie within the series.
    """
    p, g = intervals.merge_close(pred, keys, 0), intervals.merge_close(gt, keys, 0)
    inter = F.least("pred_end", "gt_end") - F.greatest("pred_start", "gt_start") + 1
    tp = iou_pairs(p, g, keys).groupBy(*keys).agg(F.sum(inter).alias("tp"))
    rows = lengths.select(*keys, "n_rows").join(tp, keys, "left")
    rows = rows.join(p.groupBy(*keys).agg(F.sum("length").alias("pos")), keys, "left").join(g.groupBy(*keys).agg(F.sum("length").alias("true")), keys, "left")
    rows = rows.fillna(0, ["tp", "pos", "true"])
    tp, pos, true, n = F.col("tp"), F.col("pos"), F.col("true"), F.col("n_rows")
    precision, recall = ratio(tp, pos), ratio(tp, true)
    return rows.select(*keys, ratio(n - pos - true + 2 * tp, n).alias("row_accuracy"), precision.alias("row_precision"), recall.alias("row_recall"), f1_of(precision, recall).alias("row_f1"))


def row_auc(df: DataFrame, prob: str, label: str, keys: list[str]) -> DataFrame:
    """Exact area under the ROC curve with ties; null for one class. Equal probabilities are aggregated first; the others are in ranges, and what lies
    below a range is carried into it, so one series of any number of different probabilities is spread over tasks."""
    c = F.col
    counts = df.groupBy(*keys, c(prob).alias("_prob")).agg(F.sum((c(label) == 1).cast("long")).alias("_pos"), F.sum((c(label) != 1).cast("long")).alias("_neg"))
    ranged = ranges.in_ranges(counts, keys, ["_prob"])
    before = ranges.carried(ranged.groupBy(*keys, "_part").agg(F.sum("_neg").alias("_sum")), keys, _below="_sum").drop("_sum")
    inside = Window.partitionBy(*keys, "_part").orderBy("_prob").rowsBetween(Window.unboundedPreceding, -1)
    area = ranged.withColumn("_in", F.coalesce(F.sum("_neg").over(inside), F.lit(0))).join(before, [*keys, "_part"])
    area = area.withColumn("_area", c("_pos") * (c("_in") + c("_below") + c("_neg") / 2.0))
    sums = area.groupBy(*keys).agg(*[F.sum(x).alias(x) for x in ("_area", "_pos", "_neg")])
    return sums.select(*keys, F.when((c("_pos") > 0) & (c("_neg") > 0), c("_area") / (c("_pos") * c("_neg"))).alias("row_auc"))


def count_error(evaluated: DataFrame) -> DataFrame:
    error = F.col("n_pred") - F.col("n_gt")
    return evaluated.withColumns({"count_error": error, "count_abs_error": F.abs(error)})


def fold_summary(evaluated: DataFrame, rows: DataFrame, auc: DataFrame, errors: DataFrame, gt_text: DataFrame, pred_text: DataFrame, keys: list[str]) -> DataFrame:
    """One wide row per fold; mean boundary errors skip nulls."""
    means = errors.groupBy(*keys).agg(F.avg("start_abs_error").alias("mean_start_abs_error"), F.avg("end_abs_error").alias("mean_end_abs_error"))
    out = count_error(evaluated)
    for other in (rows, auc, means, gt_text, pred_text):
        out = out.join(other, keys, "left")
    return out


def overall_metrics(summary: DataFrame, metrics: list[str]) -> DataFrame:
    """Per metric: mean, sample deviation, min, median, max over the folds, nulls skipped."""
    long = summary.select(*[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([], metrics, "metric", "value")
    return long.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.percentile("value", 0.5).alias("median"), F.max("value").alias("max")
    )


def experiment_comparison(summary: DataFrame, metrics: list[str], experiment: str = "experiment") -> DataFrame:
    """Means per experiment, best `mean_best_gt_iou` first; ties by name."""
    means = summary.groupBy(experiment).agg(*[F.avg(m).alias(f"mean_{m}") for m in metrics])
    return means.orderBy(F.desc("mean_mean_best_gt_iou"), experiment)


def all_folds(summaries: list[DataFrame]) -> DataFrame:
    out = summaries[0]
    for s in summaries[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out
