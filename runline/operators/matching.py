"""Predicted against true intervals: overlap joins, greedy one-to-one matching, boundary errors, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runline.operators import greedy
from runline.sources.scratch import Scratch

def segment_iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Inclusive intersection over union; 0 for disjoint or reversed intervals."""
    inter = F.least(a_end, b_end) - F.greatest(a_start, b_start) + 1
    union = (a_end - a_start + 1) + (b_end - b_start + 1) - inter
    valid = (inter > 0) & (a_end >= a_start) & (b_end >= b_start)
    return F.when(valid, inter / union).otherwise(0.0)


def _side(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("start", "end")) - 1
    return df.select(*keys, number.cast("int").alias(f"{name}_index"), F.col("start").alias(f"{name}_start"), F.col("end").alias(f"{name}_end"))


def _level(start: Column, end: Column) -> Column:
    """The least power of two (its exponent) that is no shorter than an interval."""
    return F.when(end > start, F.length(F.bin(end - start))).otherwise(0)


def _cells(side: DataFrame, keys: list[str], name: str, other: DataFrame) -> DataFrame:
    """An interval at its own level (`_own`), and at the higher levels that the other side has: at each, the one or two cells of that length it lies in."""
    s, e = F.col(f"{name}_start"), F.col(f"{name}_end")
    present = other.groupBy(*keys).agg(F.collect_set("_q").alias("_levels"))  # at most 63 a series
    levels = F.array_union(F.array("_q"), F.filter("_levels", lambda q: q > F.col("_q")))
    each = side.join(present, keys).select(*side.columns, F.explode(levels).alias("_l")).withColumn("_own", F.col("_l") == F.col("_q"))
    width = F.pow(F.lit(2.0), F.col("_l")).cast("long")
    return each.withColumn("_b", F.explode(F.sequence(F.floor(s / width), F.floor(e / width))))


def iou_pairs(pred: DataFrame, gt: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping pairs of one series with their IoU; indices from 0 in order of start. Two intervals meet at the level of the longer one: in cells as
    long as it, of which either lies in one or two. So an interval of a whole series costs two cells, and short ones do not crowd them: at
    that level they are met by the long ones only."""
    c, reach = F.col, [f"{n}_{x}" for n in ("pred", "gt") for x in ("start", "end")]
    p, g = _side(pred, keys, "pred").withColumn("_q", _level(c("pred_start"), c("pred_end"))), _side(gt, keys, "gt").withColumn("_q", _level(c("gt_start"), c("gt_end")))
    p, g = p.where("pred_end >= pred_start"), g.where("gt_end >= gt_start")
    cells_p, cells_g = _cells(p, keys, "pred", g).drop("_q"), _cells(g, keys, "gt", p).drop("_q").withColumnRenamed("_own", "_other")
    both = cells_p.join(cells_g, [*keys, "_l", "_b"]).where("_own or _other")
    meets = (c("pred_start") <= c("gt_end")) & (c("gt_start") <= c("pred_end"))
    first = F.floor(F.greatest("pred_start", "gt_start") / F.pow(F.lit(2.0), c("_l")).cast("long"))
    both = both.where(meets & (c("_b") == first)).select(*keys, "pred_index", *reach[:2], "gt_index", *reach[2:])
    return both.withColumn("iou", segment_iou(c("pred_start"), c("pred_end"), c("gt_start"), c("gt_end")))


def match_segments(pred: DataFrame, gt: DataFrame, keys: list[str], threshold: float = 0.10, width: int = greedy.WIDTH, pairs: DataFrame | None = None) -> DataFrame:
    """Greedy one-to-one: pairs by (iou, pred_index, gt_index) from the largest down to `threshold`; each side once. By rounds: two pairs compete
    if they share a side, and then both lie in what that side spans. pairs: those of `iou_pairs`, if they are known."""
    c = F.col
    pairs = (iou_pairs(pred, gt, keys) if pairs is None else pairs).where(c("iou") >= threshold)
    order = [F.desc("iou"), F.desc("pred_index"), F.desc("gt_index")]
    places = (F.greatest("pred_start", "gt_start"), F.least("pred_start", "gt_start"), F.greatest("pred_end", "gt_end"))
    kept = greedy.greedy(pairs, keys, order, greedy.Shared(), ["pred_index", "gt_index"], *places, width=width)
    return kept.select(*keys, "iou", "pred_index", "gt_index", "pred_start", "pred_end", "gt_start", "gt_end")


def best_pred_per_gt(pred: DataFrame, gt: DataFrame, keys: list[str], pairs: DataFrame | None = None) -> DataFrame:
    """Each true interval with its prediction of largest IoU, the first on ties; where none overlaps, prediction 0 with IoU 0;
    nulls (IoU 0) where the series has no prediction."""
    c = F.col
    pairs = iou_pairs(pred, gt, keys) if pairs is None else pairs
    best = pairs.groupBy(*keys, "gt_index").agg(F.max_by(F.struct("pred_index", "pred_start", "pred_end", "iou"), F.struct("iou", -c("pred_index"))).alias("b"))
    first = _side(pred, keys, "pred").where("pred_index = 0").select(*keys, F.struct("pred_index", "pred_start", "pred_end", F.lit(0.0).alias("iou")).alias("f"))
    rows = _side(gt, keys, "gt").join(best, [*keys, "gt_index"], "left").join(first, keys, "left").withColumn("x", F.coalesce("b", "f"))
    return rows.select(*keys, "gt_index", "gt_start", "gt_end", c("x.pred_index").alias("pred_index"), c("x.pred_start").alias("pred_start"), c("x.pred_end").alias("pred_end"), F.coalesce("x.iou", F.lit(0.0)).alias("iou"))


def boundary_errors(pred: DataFrame, gt: DataFrame, keys: list[str]) -> DataFrame:
    rows = best_pred_per_gt(pred, gt, keys)
    return rows.withColumns({"start_abs_error": F.abs(F.col("pred_start") - F.col("gt_start")), "end_abs_error": F.abs(F.col("pred_end") - F.col("gt_end"))})


def best_iou_summary(pred: DataFrame, gt: DataFrame, groups: DataFrame, keys: list[str], empty: float | None = 1.0, pairs: DataFrame | None = None) -> DataFrame:
    """Per group: mean over true intervals of their best IoU, and the best IoU of any pair. Both lists empty: `empty`;
    one of them empty: 0."""
    best = best_pred_per_gt(pred, gt, keys, pairs).groupBy(*keys).agg(F.avg("iou").alias("m"), F.max("iou").alias("b"), F.count("*").alias("n_gt"))
    n = pred.groupBy(*keys).agg(F.count("*").alias("n_pred"))
    rows = groups.select(*keys).join(best, keys, "left").join(n, keys, "left").fillna(0, ["n_gt", "n_pred"])
    nothing = (F.col("n_gt") == 0) & (F.col("n_pred") == 0)

    def value(c: str) -> Column:
        return F.when(nothing, F.lit(empty).cast("double")).otherwise(F.coalesce(c, F.lit(0.0)))

    return rows.select(*keys, value("m").alias("mean_best_gt_iou"), value("b").alias("best_any_iou"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def f1_of(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def evaluate_segments(pred: DataFrame, gt: DataFrame, groups: DataFrame, keys: list[str], threshold: float = 0.10, empty: float | None = 1.0) -> DataFrame:
    """Per group: n_pred, n_gt, tp, fp, fn, precision, recall, f1, matched_mean_iou and the best-IoU summary. Overlapping pairs are written once for both."""
    pairs = Scratch(pred.sparkSession, "pairs").stored(iou_pairs(pred, gt, keys))
    matched = match_segments(pred, gt, keys, threshold, pairs=pairs).groupBy(*keys).agg(F.count("*").alias("tp"), F.avg("iou").alias("matched_mean_iou"))
    p, g = pred.groupBy(*keys).agg(F.count("*").alias("n_pred")), gt.groupBy(*keys).agg(F.count("*").alias("n_gt"))
    rows = groups.select(*keys).join(p, keys, "left").join(g, keys, "left").join(matched, keys, "left").fillna(0, ["n_pred", "n_gt", "tp"]).fillna(0.0, ["matched_mean_iou"])
    rows = rows.withColumns({"fp": F.col("n_pred") - F.col("tp"), "fn": F.col("n_gt") - F.col("tp"), "precision": ratio(F.col("tp"), F.col("n_pred")), "recall": ratio(F.col("tp"), F.col("n_gt"))})
    rows = rows.withColumn("f1", f1_of(F.col("precision"), F.col("recall")))
    return rows.join(best_iou_summary(pred, gt, groups, keys, empty, pairs), keys)


def matched_segments(pred: DataFrame, gt: DataFrame, keys: list[str], threshold: float = 0.10) -> DataFrame:
    rows = match_segments(pred, gt, keys, threshold)
    return rows.withColumns({"pred_length": F.col("pred_end") - F.col("pred_start") + 1, "gt_length": F.col("gt_end") - F.col("gt_start") + 1})


def predicted_segments(pred: DataFrame, keys: list[str]) -> DataFrame:
    """With `pred_no` from 1."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("start", "end"))
    return pred.select(*keys, number.alias("pred_no"), "start", "end", (F.col("end") - F.col("start") + 1).alias("length"))


def gt_pred_segments(pred: DataFrame, gt: DataFrame, keys: list[str]) -> DataFrame:
    """Both, stacked, with `type` and `segment_no` from 1."""
    both = predicted_segments(gt, keys).withColumn("type", F.lit("GT")).unionByName(predicted_segments(pred, keys).withColumn("type", F.lit("PRED")))
    return both.withColumnRenamed("pred_no", "segment_no")
