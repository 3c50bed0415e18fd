"""The two studies from rows to reports, leave-one-session-out, with fitted models. Every step is a table for the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runline.config import Stage1, Stage2
from runline.jobs.phase_chain import PhaseChain
from runline.operators import clean, folds, intervals, matching, model, report, temporal, thresholds
from runline.sources import sessions
from runline.sources.scratch import Scratch

K = "session_id"
SUMMARY_METRICS = [
    "row_accuracy", "row_precision", "row_recall", "row_f1", "row_auc", "precision", "recall", "f1", "matched_mean_iou", "mean_best_gt_iou", "best_any_iou",
    "mean_start_abs_error", "mean_end_abs_error", "count_abs_error",
]


def _features(rows: DataFrame, sensors: list[str], windows: tuple, keep: list[str], diffs: bool) -> DataFrame:
    """Windows over all sensors at once; experiments and branches are choices of columns. Absent sensors are 0."""
    ready = clean.clean_numeric(clean.select_feature_group(rows, sensors, [K, "row_idx", *keep]), sensors, [K])
    return temporal.temporal_features(ready, sensors, list(windows), [K], keep, with_diff=diffs)


def _models(features: DataFrame, label: str, sensors: dict[str, list[str]], windows: tuple, diffs: bool, max_rows: int | None, scratch: Scratch) -> dict[tuple, model.LogReg]:
    """A model per group of sensors and test session, all fitted together on the sessions that are not tested. A training row is written once, with a
    bit per fold that has it."""
    pairs = scratch.stored(folds.loo_folds(features.select(K).distinct()))
    tests = [r[0] for r in pairs.select("test_session").distinct().orderBy("test_session").collect()]  # a row per session
    kind = pairs.schema["test_session"].dataType.simpleString()
    numbers = F.broadcast(features.sparkSession.createDataFrame(list(zip(tests, range(len(tests)), strict=True)), f"test_session {kind}, _fold int"))
    bits = model.member_bits(F.col("_fold"), len(tests))
    aggregates = [v.alias(n) for n, v in bits.items()]
    if max_rows is None:
        rows = features.join(pairs.join(numbers, "test_session").groupBy(F.col("train_session").alias(K)).agg(*aggregates), K)
    else:
        sample = folds.balanced_sample(features, pairs, label, max_rows).join(numbers, "test_session")
        rows = features.join(sample.groupBy(K, "row_idx").agg(*aggregates), [K, "row_idx"])
    own = {(x, t): (k, temporal.rolling_columns(s, list(windows), diffs)) for x, s in sensors.items() for k, t in enumerate(tests)}
    return model.fit(scratch.stored(rows), list(bits), own, label) if own else {}


def saved(tables: dict[str, DataFrame], path: str, name: str, replace: str = "tables") -> DataFrame:
    """All tables of a study, committed together to `path`, by experiment and session; and one of them as it is read again. replace: see `write_tables`."""
    sessions.write_tables(tables, path, ["experiment", K], replace=replace)
    one = tables[name]
    return one.sparkSession.read.schema(one.schema).parquet(f"{path}/{name}").select(*one.columns)


def localise_production(scratch: Scratch, rows: DataFrame, experiments: dict[str, list[str]], p: Stage1, label: str = "production") -> dict[str, DataFrame]:
    """rows: session_id, row_idx, the label (0/1) and the sensors. Per experiment and test session: a model and a threshold from the
    other sessions, intervals on the test session, and how well they match. All tables are keyed by experiment and session_id
    (the test session)."""
    c, both = F.col, ["experiment", K]
    sensors = list(dict.fromkeys(x for group in experiments.values() for x in group))
    features = scratch.stored(_features(rows, sensors, p.windows, [label], False))
    models = _models(features, label, experiments, p.windows, False, p.max_train_rows, scratch)
    kind = features.schema[K].dataType.simpleString()
    names, types, series = ["experiment", "test_session"], ["string", kind], ["experiment", "test_session", K]
    runs = scratch.stored(model.score_runs(features, models, names, types, [K], list(p.thresholds), p.smooth))
    found = scratch.stored(intervals.expand_runs(runs, list(p.thresholds), series, p.merge_gap, p.min_len))
    gt = scratch.stored(intervals.contiguous_segments(features, c(label) == 1, [K]))
    lengths = scratch.stored(features.groupBy(K).agg(F.count("*").alias("n_rows")))
    fitted = features.sparkSession.createDataFrame([(*k, m.converged) for k, m in models.items()], f"experiment string, test_session {kind}, converged boolean")
    every = scratch.stored(fitted.select(*names).join(lengths.select(K)))  # a row per model and session
    train, elsewhere = every.where(c(K) != c("test_session")), c(K) != c("test_session")
    trained = thresholds.scores_of(found.where(elsewhere), train.join(gt, K), train, list(p.thresholds), series, p.best_iou_weight, p.f1_weight)
    chosen = scratch.stored(thresholds.best_threshold(trained, names).join(fitted, names))
    pred = scratch.stored(found.where(~elsewhere).join(chosen.select(*names, "threshold"), [*names, "threshold"]).select(*both, "seg_no", "start", "end", "length"))
    groups = scratch.stored(chosen.select("experiment", c("test_session").alias(K), "threshold", "converged").join(lengths, K))
    tested = model.score_rows(features, models, names, types, [K, "row_idx", label], own=(K, "test_session"))
    true = groups.select(*both).join(gt, K)
    errors = scratch.stored(matching.boundary_errors(pred, true, both))
    summary = report.fold_summary(
        matching.evaluate_segments(pred, true, groups, both, p.match_iou, p.empty_iou), report.row_metrics(pred, true, groups, both), report.row_auc(tested, "prob", label, both),
        errors, intervals.interval_text(true, groups, both, "gt_intervals"), intervals.interval_text(pred, groups, both, "pred_intervals"), both,
    )
    summary = scratch.stored(summary.join(groups, both))
    return {
        "boundary_errors": errors, "predicted_segments": matching.predicted_segments(pred, both), "matched_segments": matching.matched_segments(pred, true, both, p.match_iou),
        "best_match_per_gt_segment": matching.best_pred_per_gt(pred, true, both), "threshold_selection": chosen, "loo_summary": summary,
        "overall_metrics": report.all_folds([report.overall_metrics(summary.where(c("experiment") == x), SUMMARY_METRICS).withColumn("experiment", F.lit(x)) for x in experiments]),
        "all_experiments_fold_results": report.all_folds([summary]), "experiment_comparison_summary": report.experiment_comparison(summary, SUMMARY_METRICS),
    }


def localise_phase(scratch: Scratch, rows: DataFrame, branches: dict[str, tuple[list[str], float]], p: Stage2, label: str = "phase") -> dict[str, DataFrame]:
    """rows: session_id, row_idx, ts, phase and the sensors. Production is dropped by its label, the rest re-indexed; a model per branch
    and test session scores the test session; candidates, clusters, votes, refined and selected intervals follow."""
    kept = clean.remove_production(clean.drop_null_labels(rows, label), list(p.valid_phases), [K], label, target=p.target_phase).withColumn("row_idx", F.col("removed_row"))
    kept = scratch.stored(kept)
    sensors = {b: s for b, (s, _) in branches.items()}
    every = list(dict.fromkeys(x for s in sensors.values() for x in s))
    features = scratch.stored(_features(kept, every, p.windows, ["target_phase2"], True))
    models = _models(features, "target_phase2", sensors, p.windows, True, p.max_train_rows, scratch)
    kind = features.schema[K].dataType.simpleString()
    scored = model.score_rows(features, models, ["branch", "test_session"], ["string", kind], [K, "row_idx"], own=(K, "test_session"))
    wide = scored.groupBy(K, "row_idx").agg(*[F.max(F.when(F.col("branch") == b, F.col("prob"))).alias(b) for b in branches])
    chain = PhaseChain(scratch, kept.join(wide, [K, "row_idx"]), branches, p)
    summary = scratch.stored(chain.summary)
    return {
        "candidate_pool": chain.pool, "candidate_clusters": chain.stats, "final_selected_segments": chain.final, "cluster_candidate_features": chain.features,
        "ranked_cluster_candidates": chain.ranked, "boundary_errors": matching.boundary_errors(chain.final, chain.truth, [K]), "row_predictions": chain.row_table,
        "stage2_loo_summary": summary, "stage2_gt_pred_segments": matching.gt_pred_segments(chain.final, chain.truth, [K]),
        "stage2_duration_prior_by_fold": folds.duration_prior_by_fold(chain.prior.withColumnRenamed(K, "test_session"), chain.folds),
        "stage2_overall_metrics": report.overall_metrics(summary, SUMMARY_METRICS),
    }
