"""Intervals [start, end] of row numbers, inclusive and from 0: tables of keys, seg_no, start, end, length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runline.operators import temporal
from runline.operators.clean import BLOCK


def _numbered(df: DataFrame, keys: list[str]) -> DataFrame:
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("start", "end")) - 1
    return df.select(*keys, number.cast("int").alias("seg_no"), "start", "end", (F.col("end") - F.col("start") + 1).alias("length"))


def contiguous_segments(df: DataFrame, mask: Column, keys: list[str], order: str = "row_idx", block: int = BLOCK) -> DataFrame:
    """Maximal runs of consecutive rows for which `mask` holds. Runs are found within blocks of rows; those that meet at a
    block's border are joined, a window over runs instead of rows."""
    hit = df.where(mask).select(*keys, F.col(order).cast("long").alias("_i")).withColumn("_block", F.floor(F.col("_i") / block))
    island = F.col("_i") - F.row_number().over(Window.partitionBy(*keys, "_block").orderBy("_i"))
    runs = hit.withColumn("_g", island).groupBy(*keys, "_block", "_g").agg(F.min("_i").alias("start"), F.max("_i").alias("end"))
    return merge_close(runs, keys, 0)


def merge_close(segments: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Joins an interval to the one before where at most `gap` rows lie between; nested ones are absorbed."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reached = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reached.isNull() | (F.col("start") - reached - 1 > gap), 1).otherwise(0)
    grouped = segments.withColumn("_new", fresh).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return _numbered(grouped.groupBy(*keys, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")), keys)


def filter_short(segments: DataFrame, min_len: int, keys: list[str]) -> DataFrame:
    return _numbered(segments.where(F.col("end") - F.col("start") + 1 >= min_len), keys)


def segments_from_mask(df: DataFrame, mask: Column, keys: list[str], min_len: int, merge_gap: int, order: str = "row_idx") -> DataFrame:
    """Runs, merged first, and only then filtered by length."""
    return filter_short(merge_close(contiguous_segments(df, mask, keys, order), keys, merge_gap), min_len, keys)


def prob_to_segments(df: DataFrame, prob: str, threshold: float, keys: list[str], w: int, gap: int, min_len: int, order: str = "row_idx") -> DataFrame:
    smoothed = temporal.smooth_rows(df.select(*keys, order, F.col(prob).alias("_p")), {"_p": "_p"}, w, keys, order).withColumn("_p", F.round("_p", 9))
    return segments_from_mask(smoothed, F.col("_p") >= threshold, keys, min_len, gap, order)


def prob_to_blobs(df: DataFrame, prob: str, thresholds: list[float], keys: list[str], w: int, gap: int, min_len: int, order: str = "row_idx") -> DataFrame:
    """Intervals at each threshold, smoothed once. A row enters the runs only once, with the thresholds that it reaches;
    thresholds are exploded on runs of equal reach, not on rows."""
    smoothed = temporal.smooth_rows(df.select(*keys, order, F.col(prob).alias("_p")), {"_p": "_p"}, w, keys, order).withColumn("_p", F.round("_p", 9))
    return runs_over_thresholds(smoothed, "_p", thresholds, keys, gap, min_len, order)


def runs_over_thresholds(df: DataFrame, value: str, thresholds: list[float], keys: list[str], gap: int, min_len: int, order: str = "row_idx", block: int = BLOCK) -> DataFrame:
    levels = sorted(thresholds)
    reach = sum((F.col(value) >= t).cast("int") for t in levels)
    w = Window.partitionBy(*keys, "_block").orderBy("_i")
    rows = df.select(*keys, F.col(order).cast("long").alias("_i"), reach.alias("_k")).withColumn("_block", F.floor(F.col("_i") / block))
    rows = rows.withColumn("_new", F.when(F.col("_k") == F.lag("_k").over(w), 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.where("_k > 0").groupBy(*keys, "_block", "_run", "_k").agg(F.min("_i").alias("start"), F.max("_i").alias("end"))
    return expand_runs(runs.select(*keys, "_k", "start", "end"), thresholds, keys, gap, min_len)


def expand_runs(runs: DataFrame, thresholds: list[float], keys: list[str], gap: int, min_len: int) -> DataFrame:
    """Intervals at each threshold from runs of rows that reach the `_k` lowest ones; runs may be cut anywhere."""
    each = runs.withColumn("threshold", F.explode(F.slice(F.array(*[F.lit(t) for t in sorted(thresholds)]), 1, F.col("_k"))))
    per = [*keys, "threshold"]
    return filter_short(merge_close(merge_close(each, per, 0), per, gap), min_len, per)


def segments_to_mask(rows: DataFrame, segments: DataFrame, keys: list[str], name: str = "mask", order: str = "row_idx", block: int = BLOCK) -> DataFrame:
    """`rows` with 1 inside any interval, else 0; intervals may overlap or reach past the ends. A sweep within each block of
    rows: +1 where an interval (or its part in the block) starts, -1 after its end, running sum; none is expanded to rows."""
    c = F.col
    valid = segments.select(*keys, F.greatest("start", F.lit(0)).cast("long").alias("_s"), c("end").cast("long").alias("_e")).where("_e >= _s")
    parts = valid.withColumn("_block", F.explode(F.sequence(F.floor(c("_s") / block), F.floor(c("_e") / block))))
    first = F.greatest("_s", c("_block") * block)
    last = F.least("_e", (c("_block") + 1) * block - 1)
    steps = parts.select(*keys, "_block", F.explode(F.array(F.struct(first.alias("i"), F.lit(1).alias("d")), F.struct((last + 1).alias("i"), F.lit(-1).alias("d")))).alias("x"))
    steps = steps.groupBy(*keys, "_block", c("x.i").alias("_i")).agg(F.sum("x.d").alias("_d"))
    joined = rows.withColumns({"_i": c(order).cast("long"), "_block": F.floor(c(order) / block)}).join(steps, [*keys, "_block", "_i"], "left")
    depth = F.sum(F.coalesce("_d", F.lit(0))).over(Window.partitionBy(*keys, "_block").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumn("_depth", depth).withColumn(name, (c("_depth") > 0).cast("int")).select(*rows.columns, name)


def mask_regions(rows: DataFrame, pred: DataFrame, gt: DataFrame, keys: list[str], order: str = "row_idx") -> DataFrame:
    """Intervals that are `gt_only`, `pred_only` or `overlap`."""
    both = segments_to_mask(segments_to_mask(rows.select(*keys, order), pred, keys, "_p", order), gt, keys, "_g", order)
    region = F.when((F.col("_p") == 1) & (F.col("_g") == 1), "overlap").when(F.col("_p") == 1, "pred_only").when(F.col("_g") == 1, "gt_only")
    return contiguous_segments(both.withColumn("region", region), F.col("region").isNotNull(), [*keys, "region"], order)


def interval_text(segments: DataFrame, groups: DataFrame, keys: list[str], name: str = "intervals") -> DataFrame:
    """`s-e | s-e` in order for each of `groups`; `-` for none."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end"))), lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), " | ")
    found = segments.groupBy(*keys).agg(text.alias(name))
    return groups.select(*keys).join(found, keys, "left").fillna("-", [name])
