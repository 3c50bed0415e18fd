"""Distributed forms against plain whole-list versions, on random cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from runline.operators import candidates, clusters, intervals, matching, model, ranges, report, select, thresholds

CASES = 60


def plain_iou(a, b):
    inter = min(a[1], b[1]) - max(a[0], b[0]) + 1
    return inter / (a[1] - a[0] + b[1] - b[0] + 2 - inter) if inter > 0 else 0.0


def random_segments(rng, n):
    out = []
    for _ in range(n):
        a = rng.randrange(80)
        out.append((a, a + rng.randrange(1, 25)))
    return sorted(out)


@pytest.fixture(scope="module")
def cases(spark):
    rng = random.Random(5)
    pred = {k: random_segments(rng, rng.randrange(9)) for k in range(CASES)}
    gt = {k: random_segments(rng, rng.randrange(9)) for k in range(CASES)}

    def table(d):
        return spark.createDataFrame([(k, i, a, b) for k, x in d.items() for i, (a, b) in enumerate(x)], "k int, seg_no int, start long, `end` long")

    return pred, gt, table(pred), table(gt)


def test_matching(spark, cases):
    pred, gt, p, g = cases
    assert matching.iou_pairs(p, g, ["k"]).count() == sum(plain_iou(a, b) > 0 for k in pred for a in pred[k] for b in gt[k])
    got = {(r.k, r.pred_index, r.gt_index) for r in matching.match_segments(p, g, ["k"]).collect()}
    want = set()
    for k in pred:
        used_p, used_g = set(), set()
        for iou, i, j in sorted(((plain_iou(a, b), i, j) for i, a in enumerate(pred[k]) for j, b in enumerate(gt[k])), reverse=True):
            if iou >= 0.1 and i not in used_p and j not in used_g:
                want.add((k, i, j))
                used_p.add(i)
                used_g.add(j)
    assert got == want
    best = {(r.k, r.gt_index): r.pred_index for r in matching.best_pred_per_gt(p, g, ["k"]).collect()}
    for k in gt:
        for j, b in enumerate(gt[k]):
            ious = [plain_iou(a, b) for a in pred[k]]
            assert best[k, j] == (ious.index(max(ious)) if ious else None)


@pytest.mark.parametrize("strict", [False, True])
def test_nms(spark, strict):
    rng = random.Random(8)
    rows = [(k, o, *s, rng.randrange(6) / 5) for k in range(CASES) for o, s in enumerate(random_segments(rng, 12))]
    df = spark.createDataFrame(rows, "k int, ord int, start long, `end` long, score double")
    got = {(r.k, r.ord) for r in candidates.nms(df, ["k"], "score", "ord", 0.3, strict).collect()}
    want = set()
    for k in range(CASES):
        kept = []
        for _, o, a, b, s in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[4], r[1])):
            if not any(plain_iou((a, b), x) > 0.3 or (not strict and plain_iou((a, b), x) == 0.3) for x in kept):
                kept.append((a, b))
                want.add((k, o))
    assert got == want


def test_clustering(spark):
    rng = random.Random(9)
    rows = [(k, o, rng.randrange(300) / 2, 12) for k in range(CASES) for o in range(20)]
    got = {(r.k, r.ord): r.cluster_id for r in clusters.cluster_candidates(spark.createDataFrame(rows, "k int, ord int, center double, median_len long"), ["k"]).collect()}
    for k in range(CASES):
        number, current = 1, []
        for _, o, c, _ in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1])):
            if current and abs(c - np.mean(current)) > 8:
                number, current = number + 1, []
            current.append(c)
            assert got[k, o] == number


def test_runs_over_thresholds(spark):
    rng = random.Random(11)
    rows = [(k, i, rng.randrange(11) / 10) for k in range(20) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, row_idx long, p double")
    levels = [0.2, 0.5, 0.55, 0.9]
    got = {(r.k, r.threshold, r.start, r.end) for r in intervals.runs_over_thresholds(df, "p", levels, ["k"], 1, 3).collect()}
    want = set()
    for t in levels:
        found = intervals.segments_from_mask(df, F.col("p") >= t, ["k"], 3, 1)
        want |= {(r.k, t, r.start, r.end) for r in found.collect()}
    assert got == want


def test_threshold_ties_take_the_lowest(spark):
    scores = spark.createDataFrame([(1, 0.2, 0.5), (1, 0.3, 0.5), (1, 0.4, 0.1)], "session_id int, threshold double, objective double")
    pairs = spark.createDataFrame([(2, 1)], "test_session int, train_session int")
    assert thresholds.select_threshold(scores, pairs).first().threshold == 0.2


def test_many_models_against_plain_newton(spark):
    rng = np.random.default_rng(2)
    frames, rows = {}, []
    for k in (1, 2):
        x = rng.normal(size=(300, 3)) * [1, 5, 0] + [0, 2, 4]
        y = (x[:, 0] * k + 0.3 * x[:, 1] + rng.normal(size=300) > 1).astype(int)
        frames[k] = (x, y)
        rows += [(k, *map(float, a), int(b)) for a, b in zip(x, y, strict=True)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double, y int").repartition(5)
    models = model.train_logreg(df, ["a", "b", "c"], ["k"], "y")
    for k, (x, y) in frames.items():
        std = x.std(axis=0)
        std[std < 1e-9] = 1
        z = np.hstack([(x - x.mean(axis=0)) / std, np.ones((300, 1))])
        s = np.where(y == 1, 300 / (2 * y.sum()), 300 / (2 * (300 - y.sum())))
        w = np.zeros(4)
        for _ in range(60):
            p = 1 / (1 + np.exp(-z @ w))
            w -= np.linalg.solve((z * (s * p * (1 - p))[:, None]).T @ z + np.eye(4), z.T @ (s * (p - y)) + w)
        assert np.allclose(models[k,].weights, w, atol=1e-5) and abs(models[k,].weights[2]) < 1e-9
    scored = model.score_rows(df, models, ["model"], ["int"], ["k", "a", "b", "c", "y"])
    m = models[1,]
    row = scored.where("model = 1").first()
    z = ((np.array([row.a, row.b, row.c]) - m.mean) / m.std) @ m.weights[:-1] + m.weights[-1]
    assert scored.count() == 1200 and abs(row.prob - 1 / (1 + np.exp(-z))) < 1e-9


def test_one_class_has_no_weights(spark):
    df = spark.createDataFrame([(1, 0.5, 1), (1, 0.7, 1)], "k int, a double, y int")
    assert not model.train_logreg(df, ["a"], ["k"], "y")[1,].weights.any()


def test_refinement(spark):
    rng = np.random.default_rng(4)
    for _ in range(15):
        n = int(rng.integers(60, 140))
        boundary, support = rng.random(n), rng.random(n)
        start = int(rng.integers(0, n - 30))
        end = start + int(rng.integers(8, 25))
        median, low, high, radius = 16, 8, 30, 7

        def entropy(v):
            p = min(max(v.mean(), 1e-9), 1 - 1e-9)
            return -(p * np.log2(p) + (1 - p) * np.log2(1 - p))

        def value(a, b):
            if b < a or not low <= b - a + 1 <= high:
                return -np.inf
            lo, hi = max(0, a - 10), min(n - 1, b + 10)
            whole, inside = support[lo : hi + 1], support[a : b + 1]
            outside = np.concatenate((support[lo:a], support[b + 1 : hi + 1]))
            gain = max(0, entropy(whole) - len(inside) / len(whole) * entropy(inside) - len(outside) / len(whole) * entropy(outside))
            return round(0.45 * gain + 0.35 * (boundary[a] + boundary[b]) / 2 + 0.2 * inside.mean(), 12)

        best = (start, end)
        for a in range(max(0, start - radius), min(n - 1, start + radius) + 1):
            for b in range(max(0, end - radius), min(n - 1, end + radius) + 1):
                if value(a, b) > value(*best):
                    best = (a, b)
        assert clusters.refine_one(start, end, 0, n, boundary, support, median, low, high, radius) == best


def walked(rows, conflict):
    kept = []
    for r in rows:
        if not any(conflict(r, x) for x in kept):
            kept.append(r)
    return kept


@pytest.mark.parametrize(("threshold", "strict", "width"), [(0.1, False, 4), (0.3, True, 16), (0.55, True, 8), (0.88, False, 8), (1.0, True, 8)])
def test_greedy_rounds_against_whole_list(spark, threshold, strict, width):
    """Blocks far narrower than chains of conflicts: several rounds, with copies of items in the blocks beside."""
    rng = random.Random(int(threshold * 100))
    rows = [(k, o, a, a + rng.choice([0, 1, 3, 9, 40]), rng.randrange(8) / 7) for k in range(6) for o, a in enumerate(rng.randrange(150) for _ in range(90))]
    df = spark.createDataFrame(rows, "k int, ord int, start long, `end` long, score double")

    def conflict(a, b):
        iou = plain_iou(a[2:4], b[2:4])
        return iou > threshold or (iou == threshold and not strict) or a[2:4] == b[2:4]

    want = {r[:2] for k in range(6) for r in walked(sorted((r for r in rows if r[0] == k), key=lambda r: (-r[4], r[1])), conflict)}
    assert {(r.k, r.ord) for r in candidates.nms(df, ["k"], "score", "ord", threshold, strict, width).collect()} == want


def test_matching_in_narrow_blocks(spark, cases):
    _, _, p, g = cases
    wide = {tuple(r) for r in matching.match_segments(p, g, ["k"]).collect()}
    assert {tuple(r) for r in matching.match_segments(p, g, ["k"], width=5).collect()} == wide


def test_long_monotonous_chain(spark):
    """100,000 intervals in one chain, each of higher rank than the next one: no list, a few rounds, every second one kept."""
    df = spark.range(100_000).select(F.lit(1).alias("k"), F.col("id").alias("ord"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 14).alias("end"), (-F.col("id")).cast("double").alias("score"))
    kept = candidates.nms(df, ["k"], "score", "ord", 0.1, width=100_000)
    assert kept.count() == 50_000 and kept.where("ord % 2 = 1").count() == 0


def test_final_selection_against_whole_list(spark):
    rng = random.Random(12)
    rows = [(k, i, a, a + rng.randrange(5, 40), rng.randrange(30) / 29) for k in range(12) for i, a in enumerate(rng.randrange(120) for _ in range(25))]
    bounds = {k: (low, max(low, rng.randrange(1, 14))) for k in range(12) for low in [rng.randrange(1, 12)]}
    df = spark.createDataFrame(rows, "k int, cluster_id int, start long, `end` long, rank_score double")
    targets = spark.createDataFrame([(k, *b) for k, b in bounds.items()], "k int, low long, high long")
    got = {(r.k, r.cluster_id) for r in select.select_final(df, targets, ["k"], width=16).collect()}
    want = set()
    for k, (low, high) in bounds.items():
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[4], r[1]))
        first = walked(own, lambda a, b: plain_iou(a[2:4], b[2:4]) > 0.55)[:high]
        taken = list(first)
        for r in own:
            if len(taken) < low and r not in first and not any(plain_iou(r[2:4], t[2:4]) > 0.75 for t in taken):
                taken.append(r)
        want |= {r[:2] for r in taken}
    assert got == want


@pytest.mark.parametrize("width", [3, 50, 1 << 18])
def test_clusters_over_blocks(spark, width):
    """Chains over many blocks: the state that enters each is settled pass by pass; ids go on."""
    rng = random.Random(width)
    rows = [(k, o, rng.randrange(120) / 2, 12) for k in range(8) for o in range(70)]
    df = spark.createDataFrame(rows, "k int, ord int, center double, median_len long")
    got = {(r.k, r.ord): r.cluster_id for r in clusters.cluster_candidates(df, ["k"], width=width).collect()}
    assert len(got) == len(rows)
    for k in range(8):
        number, current = 1, []
        for _, o, c, _ in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1])):
            if current and abs(c - np.mean(current)) > 8:
                number, current = number + 1, []
            current.append(c)
            assert got[k, o] == number


@pytest.mark.parametrize("width", [4, 60, 1 << 18])
def test_merged_pieces_over_blocks(spark, width):
    rng, rows, want = random.Random(3), [], set()
    for k in range(15):
        cuts = sorted(rng.sample(range(1, 200), rng.randrange(0, 60)))
        pieces = list(zip([0, *cuts], [*[x - 1 for x in cuts], 199], strict=True))
        rows += [(k, a, b) for a, b in pieces]
        want |= {(k, a, b) for a, b in candidates.merge_short_pieces(pieces, 6)}
    df = spark.createDataFrame(rows, "k int, start long, `end` long")
    assert {tuple(r) for r in candidates.merge_pieces(df, ["k"], 6, width).collect()} == want


def test_a_session_of_one_chain_is_walked_by_several_tasks(spark):
    df = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").alias("ord"), F.col("id").cast("double").alias("center"), F.lit(12).cast("long").alias("median_len"))
    found = clusters.cluster_candidates(df, ["k"], width=4000)
    got = {r.ord: r.cluster_id for r in found.collect()}
    number, total, n = 0, 0.0, 0
    for i in range(20_000):
        if n and abs(i - total / n) <= 8:
            total, n = total + i, n + 1
        else:
            number, total, n = number + 1, float(i), 1
        assert got[i] == number


def test_pairs_of_intervals_of_any_length(spark):
    """Lengths from 1 to 10^7 in one series, against all pairs."""
    rng = random.Random(21)

    def some(n):
        return sorted({(a, a + int(10 ** rng.uniform(0, 7)) - 1) for a in (rng.randrange(10**7) for _ in range(n))} | {(0, 10**7 - 1), (5, 5), (5, 6)})

    pred, gt = {k: some(60) for k in range(3)}, {k: some(60) for k in range(3)}
    p, g = (spark.createDataFrame([(k, a, b) for k, x in d.items() for a, b in x], "k int, start long, `end` long") for d in (pred, gt))
    got = sorted((r.k, r.pred_index, r.gt_index) for r in matching.iou_pairs(p, g, ["k"]).collect())
    assert got == sorted((k, i, j) for k in pred for i, a in enumerate(pred[k]) for j, b in enumerate(gt[k]) if plain_iou(a, b) > 0)


def test_places_and_percentiles_in_ranges(spark):
    """Groups over several ranges, null keys, ties."""
    rng = random.Random(22)
    rows = [(rng.choice([1, 1, 1, 1, 2, None]), rng.choice([rng.random(), 0.5, 1.0]), i) for i in range(3000)] + [(3, 0.25, -1), (4, None, -2)]
    df = spark.createDataFrame(rows, "k int, v double, i long").repartition(7)
    got = ranges.placed(df, ["k"], ["v", "i"])
    for k in (1, 2, None, 3, 4):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [r.i for r in got.where(F.col("k").eqNullSafe(F.lit(k).cast("int"))).orderBy("pos").collect()] == [r[2] for r in own]
    points = [0.0, 0.1, 0.5, 0.88, 1.0]
    found = {(r.k, r.point): r.value for r in ranges.percentiles(df, ["k"], "v", points).collect()}
    want = df.groupBy("k").agg(F.percentile("v", F.array(*[F.lit(x) for x in points])).alias("q")).where("q is not null").collect()
    assert len(found) == 5 * len(want)
    for r in want:
        for x, q in zip(points, r.q, strict=True):
            assert abs(found[r.k, x] - q) < 1e-12


def test_auc_of_one_series_in_ranges(spark):
    rng = random.Random(23)
    rows = [(1, round(rng.random(), 3), int(rng.random() < 0.3)) for _ in range(4000)]
    got = report.row_auc(spark.createDataFrame(rows, "k int, p double, y int").repartition(6), "p", "y", ["k"]).first().row_auc
    pos, neg = [p for _, p, y in rows if y], [p for _, p, y in rows if not y]
    assert abs(got - sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)) < 1e-12


@pytest.mark.parametrize("block", [7, 40, 1000])
def test_split_points_over_blocks(spark, block):
    """Long blobs over many blocks, signals with many ties or none, two thresholds of one signal: against whole arrays."""
    rng, n = np.random.default_rng(31), 400
    signals = {1: np.round(rng.random(n), 9), 2: np.floor(rng.random(n) * 4) / 4, 3: np.where(rng.random(n) < 0.9, 0.0, rng.random(n)), 4: np.full(n, 0.5)}
    signal = spark.createDataFrame([(k, i, float(x)) for k, v in signals.items() for i, x in enumerate(v)], "k int, row_idx long, boundary double")
    spans = [(1, 0.5, 0, 399), (1, 0.35, 5, 120), (2, 0.5, 30, 390), (2, 0.35, 30, 390), (3, 0.5, 3, 333), (4, 0.5, 0, 250), (4, 0.35, 10, 12)]
    median, low, high = 30, 6, 50
    blobs = spark.createDataFrame([(*s, median, low, high) for s in spans], "k int, threshold double, start long, `end` long, median_len long, min_allowed_len long, max_allowed_len long")
    got = {}
    for r in candidates.candidate_split_points(blobs, signal, ["k", "threshold"], block=block).collect():
        got.setdefault((r.k, r.threshold, r.start, r.end), []).append((r.rank, r.idx, r.score))
    for k, t, a, b in spans:
        v, size = signals[k][a : b + 1], b - a + 1
        points = set()
        if size >= high:
            points |= set(np.flatnonzero(v >= np.quantile(v, 0.88) - 1e-12).tolist())
            parts = int(min(max(round(size / median), 1), 31))
            for j in range(1, parts):
                at = round(size * j / parts)
                lo, hi = max(0, at - median // 2), min(size - 1, at + median // 2)
                if hi > lo:
                    points.add(lo + int(v[lo : hi + 1].argmax()))
        want = sorted(((float(v[i]), a + i) for i in points if i + 1 >= low and size - 1 - i >= low), reverse=True)
        assert [(i, s) for _, i, s in sorted(got.get((k, t, a, b), []))] == [(i, s) for s, i in want]
