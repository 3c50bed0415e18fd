"""The final intervals of a fold, and the row-level export."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runline.operators import candidates, greedy, intervals
from runline.sources.scratch import Scratch


def target_counts(segments: DataFrame, folds: DataFrame, session: str = "session_id", low: float = 0.75, high: float = 1.55) -> DataFrame:
    """Per fold: the rounded mean number of true intervals of its training sessions (those without count), and the bounds."""
    n = segments.groupBy(F.col(session).alias("train_session")).agg(F.count("*").alias("k"))
    mean = folds.join(n, "train_session", "left").fillna(0, ["k"]).groupBy("test_session").agg(F.rint(F.avg("k")).cast("long").alias("target"))
    least = F.greatest(F.lit(1), F.floor(F.col("target") * F.lit(low))).cast("long")
    return mean.withColumn("low", least).withColumn("high", F.greatest("low", F.ceil(F.col("target") * F.lit(high))).cast("long"))


def select_final(ranked: DataFrame, targets: DataFrame, fold: list[str], score: str = "rank_score", iou: float = 0.55, backfill: float = 0.75, width: int = greedy.WIDTH) -> DataFrame:
    """Greedy by rank (ties: lowest cluster_id), dropping IoU > `iou` with a kept one, up to `high` per fold. Acceptance goes by rank, so
    the cap is a rank over what is kept. Folds with fewer than `low` take further intervals by rank whose IoU with all taken so far is at
    most `backfill`: again greedy, with what is taken kept beforehand, and again cut by rank."""
    c, scratch = F.col, Scratch(ranked.sparkSession, "select")
    order = [F.desc(score), c("cluster_id")]
    place = F.row_number().over(Window.partitionBy(*fold).orderBy(*order))
    first = candidates.nms(ranked, fold, score, "cluster_id", iou, strict=True, width=width)
    first = first.withColumn("_place", place).join(targets.select(*fold, "low", "high"), fold).where(c("_place") <= c("high"))
    first = scratch.stored(first.select(*ranked.columns, "low"))
    short = first.groupBy(*fold, "low").agg(F.count("*").alias("_n")).where(c("_n") < c("low")).select(*fold, (c("low") - c("_n")).alias("_want"))
    short = scratch.stored(short)
    first = first.drop("low")
    rest = ranked.join(first.select(*fold, "cluster_id"), [*fold, "cluster_id"], "left_anti")
    queue = first.withColumn("_taken", F.lit(True)).unionByName(rest.select(*ranked.columns).withColumn("_taken", F.lit(False))).join(short, fold)
    more = greedy.greedy_intervals(queue, fold, order, backfill, strict=True, settled="_taken", width=width)
    more = more.withColumn("_rank", place).where(c("_rank") <= c("_want")).select(*ranked.columns)
    return first.unionByName(more).withColumn("segment_no", F.row_number().over(Window.partitionBy(*fold).orderBy("start", "end", "cluster_id")))


def row_predictions(rows: DataFrame, tracks: list[DataFrame], segments: DataFrame, keys: list[str], order: str = "row_idx", name: str = "pred_phase2") -> DataFrame:
    """Every row with its tracks (equi joins on keys and row) and whether a final interval covers it."""
    out = rows
    for t in tracks:
        out = out.join(t, [*keys, order], "left")
    return intervals.segments_to_mask(out, segments, keys, name, order)
