"""Registered queries run over all sessions of the log, and workflows agree with plain Python on a small one."""

import numpy as np
import pandas as pd

from runline.jobs import stage_one, stage_two, workflows
from runline.operators import temporal
from runline.sources.machine_log import machine_log
from runline.sources.scratch import Scratch

SF = "/root/testdata/sf0.001"


def test_models_of_all_sessions(spark):
    all_ = {r[0] for r in machine_log(spark, SF).select("session_id").distinct().collect()}
    rows = stage_one.QUERIES["train_logreg"](spark, SF).collect()
    assert {r.test_session for r in rows} == all_ and len(all_) == 30


def test_stage_two_reads_all_sessions(spark):
    rows = stage_two.fixture(spark, SF)
    assert rows.select("session_id").distinct().count() == 30
    assert rows.count() == machine_log(spark, SF).where("phase <> 5").count()


def fitted(x, y, rounds=60):
    """Newton steps of the same objective: weights and intercept penalised, classes weighed alike."""
    mean, std = x.mean(axis=0), x.std(axis=0)
    std[std == 0] = 1
    z = np.hstack([(x - mean) / std, np.ones((len(x), 1))])
    s = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve(z.T @ (z * (s * p * (1 - p))[:, None]) + np.eye(len(w)), z.T @ (s * (p - y)) + w)
    return lambda q: 1 / (1 + np.exp(-(np.hstack([(q - mean) / std, np.ones((len(q), 1))]) @ w)))


def centred(x, w, stat):
    at = range(len(x))
    parts = [x[max(0, i - w // 2) : i + (w - 1) // 2 + 1] for i in at]
    return np.array([np.mean(p) if stat == "mean" else (np.std(p, ddof=1) if len(p) > 1 else 0.0) for p in parts])


def features_of(log, sensors, windows):
    out = {}
    for s, part in log.groupby("session_id"):
        cols = []
        for c in sensors:
            x = part.sort_values("row_idx")[c].to_numpy(float)
            d = np.abs(np.diff(x, prepend=x[0]))
            cols += [x, *[v for w in windows for v in (centred(x, w, "mean"), centred(x, w, "std"), centred(d, w, "mean"))]]
        out[s] = np.stack(cols, axis=1)
    return out


def runs(mask, gap, least):
    found, at = [], None
    for i, m in enumerate([*mask, False]):
        if m and at is None:
            at = i
        if not m and at is not None:
            found.append([at, i - 1])
            at = None
    merged = []
    for a, b in found:
        if merged and a - merged[-1][1] - 1 <= gap:
            merged[-1][1] = b
        else:
            merged.append([a, b])
    return [tuple(x) for x in merged if x[1] - x[0] + 1 >= least]


def iou(a, b):
    inter = min(a[1], b[1]) - max(a[0], b[0]) + 1
    return max(0, inter) / (a[1] - a[0] + 1 + b[1] - b[0] + 1 - inter) if inter > 0 else 0.0


def objective(pred, gt):
    best = [max([iou(p, g) for p in pred] or [0.0]) for g in gt]
    pairs = sorted(((iou(p, g), i, j) for i, p in enumerate(pred) for j, g in enumerate(gt) if iou(p, g) >= 0.1), reverse=True)
    up, ug = set(), set()
    for _, i, j in pairs:
        if i not in up and j not in ug:
            up.add(i), ug.add(j)
    precision, recall = (len(up) / len(pred) if pred else 0.0), (len(up) / len(gt) if gt else 0.0)
    f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
    return 0.7 * (float(np.mean(best)) if gt else (1.0 if not pred else 0.0)) + 0.3 * f1


def test_production_workflow_against_plain_python(spark):
    sensors = ["feed_rate", "spindle_speed", "raw_score"]
    rows = machine_log(spark, SF).where("session_id <= 5")
    p = stage_one.FIXTURE
    tables = workflows.localise_production(Scratch(spark, "t"), rows, {"all": sensors}, p)
    log = rows.toPandas()
    x = features_of(log, sensors, p.windows)
    y = {s: part.sort_values("row_idx")["production"].to_numpy() for s, part in log.groupby("session_id")}
    gt = {s: runs(y[s] == 1, 0, 1) for s in y}
    chosen = {r.test_session: r.threshold for r in tables["threshold_selection"].collect()}
    found = {}
    for r in tables["predicted_segments"].collect():
        found.setdefault(r.session_id, []).append((r.start, r.end))
    for test in y:
        train = [s for s in y if s != test]
        score = fitted(np.vstack([x[s] for s in train]), np.concatenate([y[s] for s in train]))
        smooth = {s: np.round(centred(score(x[s]), p.smooth, "mean"), 9) for s in y}
        mean = {t: round(float(np.mean([objective(runs(smooth[s] >= t, p.merge_gap, p.min_len), gt[s]) for s in train])), 9) for t in p.thresholds}
        best = min(t for t in mean if mean[t] == max(mean.values()))
        assert chosen[test] == best
        assert sorted(found.get(test, [])) == runs(smooth[test] >= best, p.merge_gap, p.min_len)
    summary = {r.session_id: r for r in tables["loo_summary"].collect()}
    assert set(summary) == set(y) and all(summary[s].n_gt == len(gt[s]) and summary[s].n_pred == len(found.get(s, [])) for s in y)
    assert {r.metric for r in tables["overall_metrics"].collect()} == set(workflows.SUMMARY_METRICS)


def test_phase_workflow_scores_by_the_fold_of_a_row(spark):
    rows = machine_log(spark, SF).where("session_id <= 4")
    branches = {"program": (["program_status", "tool_number"], 0.65), "physical": (["feed_rate", "spindle_speed"], 0.25), "program_physical": (["program_status", "tool_number", "feed_rate", "spindle_speed"], 0.45)}
    tables = workflows.localise_phase(Scratch(spark, "t"), rows, branches, stage_two.FIXTURE)
    log = rows.where("phase <> 5").toPandas().sort_values(["session_id", "row_idx"])
    x, names = {}, temporal.rolling_columns(branches["physical"][0], list(stage_two.FIXTURE.windows), True)
    for s, part in log.groupby("session_id"):
        cols = {}
        for c in branches["physical"][0]:
            v = part[c].to_numpy(float)
            d = np.diff(v, prepend=v[0])
            cols |= {c: v, f"{c}_diff1": d, f"{c}_absdiff1": np.abs(d)}
            for w in stage_two.FIXTURE.windows:
                cols |= {f"{c}_mean_{w}": centred(v, w, "mean"), f"{c}_std_{w}": centred(v, w, "std"), f"{c}_absdiff_mean_{w}": centred(np.abs(d), w, "mean")}
        x[s] = pd.DataFrame(cols)[names].to_numpy()
    y = {s: (part["phase"].to_numpy() == 2).astype(int) for s, part in log.groupby("session_id")}
    got = tables["row_predictions"].orderBy("session_id", "row_idx").toPandas()
    for test in y:
        train = [s for s in y if s != test]
        score = fitted(np.vstack([x[s] for s in train]), np.concatenate([y[s] for s in train]))
        assert np.allclose(got[got.session_id == test]["prob_physical_raw"], score(x[test]), atol=1e-4)
    final = tables["final_selected_segments"].collect()
    assert {r.session_id for r in tables["stage2_loo_summary"].collect()} == set(y) and len(final) > 0
    covered = {(r.session_id, i) for r in final for i in range(r.start, r.end + 1)}
    assert all(((r.session_id, r.row_idx) in covered) == bool(r.pred_phase2) for r in got.itertuples())
