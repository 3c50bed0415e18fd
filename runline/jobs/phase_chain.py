"""Stage two from rows with branch probabilities to final intervals, as tables that follow one from the other."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runline.config import Stage2
from runline.operators import boundary, candidates, clusters, folds, intervals, matching, report, select, temporal
from runline.sources.scratch import Scratch

K = "session_id"
KEYS = [K]
BLOB_KEYS = [K, "branch", "threshold"]


class PhaseChain:
    """The tables of one run over one log. Each is written once and read again, so the plan of a step is its own, and nothing
    stays in the session's cache."""

    def __init__(self, scratch: Scratch, source: DataFrame, branches: dict[str, tuple[list[str], float]], p: Stage2):
        """source: session_id, row_idx and removed_row (both the compact index), original_row, ts, phase, target_phase2, the sensors, and
        the probability of each branch in a column of its name. branches: name -> (sensors, weight of jumps), in order."""
        self.scratch, self.source, self.branches, self.p = scratch, source, branches, p

    def by_branch(self):
        """A map of the columns that are named by branches."""
        return F.map_from_arrays(F.array(*[F.lit(b) for b in self.branches]), F.array(*self.branches))

    @cached_property
    def rows(self) -> DataFrame:
        return self.scratch.stored(self.source)

    @cached_property
    def lengths(self) -> DataFrame:
        return self.scratch.stored(self.rows.groupBy(K).agg(F.count("*").alias("n_rows")))

    @cached_property
    def groups(self) -> DataFrame:
        return self.lengths.select(K)

    @cached_property
    def truth(self) -> DataFrame:
        return self.scratch.stored(intervals.contiguous_segments(self.rows, F.col("target_phase2") == 1, KEYS))

    @cached_property
    def folds(self) -> DataFrame:
        return folds.loo_folds(self.groups)

    @cached_property
    def prior(self) -> DataFrame:
        return self.scratch.stored(folds.duration_prior(self.truth, self.folds).withColumnRenamed("test_session", K))

    @cached_property
    def signals(self) -> DataFrame:
        """boundary of each branch."""
        wide = self.scratch.stored(boundary.branch_boundary_signals(self.rows, self.branches, KEYS))
        return wide.select(K, "row_idx", F.explode(self.by_branch()).alias("branch", "boundary"))

    def signal(self, branch: str) -> DataFrame:
        return self.signals.where(F.col("branch") == branch).drop("branch")

    @cached_property
    def tracks(self) -> DataFrame:
        """The global boundary signal and the support of every row."""
        both = boundary.global_boundary_signal(self.signal("program"), self.signal("physical"), KEYS)
        support = boundary.probability_support_track(self.rows, *self.branches, KEYS)
        return self.scratch.stored(both.join(support, [K, "row_idx"]))

    @cached_property
    def branch_rows(self) -> DataFrame:
        """prob_s and boundary of each row and branch."""
        long = self.rows.select(K, "row_idx", F.explode(self.by_branch()).alias("branch", "prob"))
        smoothed = temporal.smooth_rows(long, {"prob_s": "prob"}, self.p.smooth, [K, "branch"])
        both = smoothed.select(K, "branch", "row_idx", F.round("prob_s", 9).alias("prob_s")).join(self.signals.withColumn("boundary", F.round("boundary", 9)), [K, "branch", "row_idx"])
        return self.scratch.stored(both)

    @cached_property
    def blobs(self) -> DataFrame:
        found = intervals.runs_over_thresholds(self.branch_rows, "prob_s", list(self.p.blob_thresholds), [K, "branch"], self.p.merge_gap, self.p.min_len)
        return self.scratch.stored(candidates.with_prior(found, self.prior, KEYS))

    @cached_property
    def points(self) -> DataFrame:
        return candidates.candidate_split_points(self.blobs, self.branch_rows, BLOB_KEYS, self.p.peak_quantile, self.p.max_splits)

    @cached_property
    def pool(self) -> DataFrame:
        """Cut blobs as candidates, in the order of branch, threshold and start."""
        place = F.array_position(F.array(*[F.lit(b) for b in self.branches]), F.col("branch"))
        made = {"smooth_window": self.p.smooth, "merge_gap": self.p.merge_gap, "min_blob_len": self.p.min_len, "peak_quantile": self.p.peak_quantile}
        found = candidates.generate_candidates(self.blobs, self.branch_rows, BLOB_KEYS, self.p.peak_quantile, settings=made)
        return self.scratch.stored(found.withColumn("ord", F.row_number().over(Window.partitionBy(K).orderBy(place, F.desc("threshold"), "start"))))

    @cached_property
    def scored(self) -> DataFrame:
        return candidates.candidate_nms_score(self.pool, KEYS)

    @cached_property
    def kept(self) -> DataFrame:
        return self.scratch.stored(candidates.nms(self.scored, KEYS, "nms_score", "ord", self.p.nms_iou))

    @cached_property
    def members(self) -> DataFrame:
        return self.scratch.stored(clusters.cluster_candidates(self.kept, KEYS))

    @cached_property
    def stats(self) -> DataFrame:
        return self.scratch.stored(clusters.cluster_stats(self.members, KEYS))

    @cached_property
    def votes(self) -> DataFrame:
        return self.scratch.stored(clusters.boundary_votes(self.members, self.lengths, KEYS))

    @cached_property
    def voted(self) -> DataFrame:
        return self.scratch.stored(clusters.vote_boundaries(self.stats, self.votes, self.tracks, self.lengths, KEYS))

    @cached_property
    def refined(self) -> DataFrame:
        return self.scratch.stored(clusters.refine_boundaries(self.voted, self.tracks, self.lengths, KEYS, self.p.refine_radius))

    @cached_property
    def features(self) -> DataFrame:
        return self.scratch.stored(clusters.cluster_features(self.refined, self.tracks, self.lengths, KEYS))

    @cached_property
    def ranked(self) -> DataFrame:
        return self.scratch.stored(clusters.rank_clusters(self.features, KEYS))

    @cached_property
    def vote_tracks(self) -> DataFrame:
        return clusters.vote_tracks(self.votes, self.stats, self.tracks, self.lengths, KEYS)

    @cached_property
    def final(self) -> DataFrame:
        targets = select.target_counts(self.truth, self.folds).withColumnRenamed("test_session", K)
        return self.scratch.stored(select.select_final(self.ranked, targets, KEYS, iou=self.p.select_iou, backfill=self.p.backfill_iou))

    @cached_property
    def row_table(self) -> DataFrame:
        """Every row with labels, probabilities, signals, votes and whether a final interval covers it."""
        smoothed = {f"prob_{b}_smooth": b for b in self.branches}
        own = temporal.smooth_rows(self.rows.select(K, "row_idx", "original_row", "removed_row", "ts", "phase", "target_phase2", *self.branches), smoothed, self.p.smooth, KEYS)
        own = own.withColumnsRenamed({b: f"prob_{b}_raw" for b in self.branches})
        by_branch = [self.signal(b).withColumnRenamed("boundary", f"boundary_{b}") for b in self.branches if b != "program_physical"]
        return select.row_predictions(own, [*by_branch, self.tracks, self.vote_tracks], self.final, KEYS)

    @cached_property
    def summary(self) -> DataFrame:
        """Counts, scores and lengths allowed of each fold."""
        stored = self.scratch.stored  # a row per fold each; one plan of all of them would be too large for the driver
        scored = stored(matching.evaluate_segments(self.final, self.truth, self.groups, KEYS, empty=self.p.empty_iou))
        rows = stored(report.row_metrics(self.final, self.truth, self.lengths, KEYS))
        auc = stored(report.row_auc(self.rows.withColumn("p", F.round("program_physical", 9)), "p", "target_phase2", KEYS))
        clustered = stored(self.members.groupBy(K).agg(F.countDistinct("cluster_id").alias("n_clusters"), F.count("*").alias("n_candidates")))
        texts = [stored(intervals.interval_text(x, self.groups, KEYS, n)) for x, n in ((self.truth, "gt_intervals"), (self.final, "pred_intervals"))]
        errors = stored(matching.boundary_errors(self.final, self.truth, KEYS))
        out = report.fold_summary(scored, rows, auc, errors, *texts, KEYS)
        return out.join(clustered, K, "left").fillna(0, ["n_clusters", "n_candidates"]).join(self.prior.select(K, *candidates.PRIOR), K)
