"""Votes of ends on rows: each end against each row, whatever the blocks and the way they are added up."""

import math

import numpy as np
import pytest

from runline.operators import candidates, clusters

K = ["k"]


def made(spark, n, count, seed=5):
    rng = np.random.default_rng(seed)
    start = rng.integers(0, n - 1, count)
    end = np.minimum(n - 1, start + rng.integers(0, 40, count))
    rows = [(1 + i % 2, int(i % 3), int(a), int(b), float(rng.random()), 20 + 30 * (i % 2)) for i, (a, b) in enumerate(zip(start, end, strict=True))]
    members = spark.createDataFrame(rows, "k int, cluster_id int, start long, `end` long, confidence double, median_len long")
    return rows, members, spark.createDataFrame([(1, n), (2, n)], "k int, n_rows long")


def each(rows, n):
    out = {}
    for k, cluster, start, end, confidence, median in rows:
        radius = max(5, int(median * 0.35))
        for place, at in enumerate((start, end)):
            for row in range(max(0, at - radius), min(n - 1, at + radius) + 1):
                out.setdefault((k, cluster, row), [0.0, 0.0])[place] += max(1e-6, confidence**2) * math.exp(-0.5 * ((row - at) / max(1.0, radius / 2)) ** 2)
    return out


@pytest.mark.parametrize(("block", "one_by_one"), [(1 << 17, 512), (16, 512), (1 << 17, 0), (16, 0)])
def test_votes_equal_each_end_on_each_row(spark, block, one_by_one):
    rows, members, lengths = made(spark, 150, 90)
    want = each(rows, 150)
    held, clusters.ONE_BY_ONE = clusters.ONE_BY_ONE, one_by_one
    try:
        for n in (150, 151):
            for k, cluster in {(r[0], r[1]) for r in rows}:
                mine = [r for r in rows if (r[0], r[1]) == (k, cluster)]
                at, weight = np.array([r[2] for r in mine]), np.array([max(1e-6, r[4] ** 2) for r in mine])
                votes, voted = clusters.gaussian_votes(at, weight, max(5, int(mine[0][5] * 0.35)), 0, n)
                for row in range(150):
                    assert abs(votes[row] - want.get((k, cluster, row), (0.0,))[0]) < 1e-12
                    assert not voted[row] or votes[row] > 0
    finally:
        clusters.ONE_BY_ONE = held
    got = {(r.k, r.cluster_id, r.row_idx): (r.start_votes, r.end_votes) for r in clusters.boundary_votes(members, lengths, K, block=block).collect()}
    assert got.keys() == want.keys()
    assert all(abs(x - y) < 1e-12 for key, v in got.items() for x, y in zip(v, want[key], strict=True))


def rows_generated(spark, after):
    """Rows out of all explodes, in executions from number `after` on."""
    store, out = spark._jsparkSession.sharedState().statusStore(), 0
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs = store.executionsList()
    for run in (runs.apply(i).executionId() for i in range(runs.size())):
        told = store.executionMetrics(run)
        for node in (store.planGraph(run).allNodes().apply(i) for i in range(store.planGraph(run).allNodes().size() if run >= after else 0)):
            for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
                if node.name() == "Generate" and m.name() == "number of output rows" and told.contains(m.accumulatorId()):
                    out += int(told.apply(m.accumulatorId()).replace(",", ""))
    return out


def test_votes_are_no_rows(spark):
    """3,000 members whose votes reach 14,001 rows each: 84 million votes, but ends and rows that have votes alone are made."""
    n = 60_000
    rows = [(1, 1, 20_000 + i, 20_000 + i + 7, 0.5, 20_000) for i in range(3000)]
    members = spark.createDataFrame(rows, "k int, cluster_id int, start long, `end` long, confidence double, median_len long")
    after = spark._jsparkSession.sharedState().statusStore().executionsCount()
    votes = clusters.boundary_votes(members, spark.createDataFrame([(1, n)], "k int, n_rows long"), K)
    got = {r.row_idx: (r.start_votes, r.end_votes) for r in votes.collect()}
    assert 6000 <= rows_generated(spark, after) <= 20_000
    assert sorted(got) == list(range(13_000, 30_007))
    sigma = 3500.0
    for row in (13_000, 20_000, 21_500, 30_006):
        for place, shift in ((0, 0), (1, 7)):
            at = np.arange(20_000, 23_000) + shift
            near = np.abs(row - at) <= 7000
            assert abs(got[row][place] - (0.25 * np.exp(-0.5 * ((row - at[near]) / sigma) ** 2)).sum()) < 1e-9


def tracks(spark, n, seed=9):
    rng = np.random.default_rng(seed)
    boundary, support = rng.random(n).round(2), rng.random(n)
    frame = spark.createDataFrame([(1, i, float(b), float(s)) for i, (b, s) in enumerate(zip(boundary, support, strict=True))], "k int, row_idx long, boundary double, support double")
    return boundary, support, frame, spark.createDataFrame([(1, n)], "k int, n_rows long")


CLUSTERS = "k int, cluster_id int, start long, `end` long, median_len long, min_allowed_len long, max_allowed_len long"


@pytest.mark.parametrize("block", [7, 64, 50_000])
def test_rows_within_blocks(spark, block):
    boundary, support, signal, _ = tracks(spark, 100)
    asked = spark.createDataFrame([(1, "a", -1, -1), (1, "b", 0, 0), (1, "c", 60, 75), (1, "d", 90, 120), (1, "e", 5, 4)], "k int, name string, _lo long, _hi long")
    got = {(r.name, r.row_idx): r for r in candidates.rows_within(asked, signal, ["boundary", "support"], K, block=block).collect()}
    assert sorted(got) == [("b", 0), *[("c", i) for i in range(60, 76)], *[("d", i) for i in range(90, 100)]]
    for (_, row), r in got.items():
        assert r.boundary == boundary[row] and r.support == support[row]
        assert abs(r.s_boundary - boundary[: row + 1].sum()) < 1e-9 and abs(r.s_support - support[: row + 1].sum()) < 1e-9


def test_refined_and_voted_without_rows_of_clusters(spark):
    """Clusters of 20,000 and fewer rows: the same ends as on the whole tracks, and no cluster is expanded to its rows."""
    n = 30_000
    boundary, support, signal, lengths = tracks(spark, n)
    rows = [(1, 1, 4000, 24_000, 20_000, 100, 40_000), (1, 2, 40, 80, 60, 20, 200), (1, 3, 29_900, 29_990, 60, 18, 5000), (1, 4, 0, 29_999, 20_000, 18, 40_000), (1, 5, 29_990, 29_999, 60, 5000, 6000)]
    after = spark._jsparkSession.sharedState().statusStore().executionsCount()
    got = {r.cluster_id: (r.start, r.end) for r in clusters.refine_boundaries(spark.createDataFrame(rows, CLUSTERS), signal, lengths, K).collect()}
    assert rows_generated(spark, after) < 200
    assert got == {r[1]: clusters.refine_one(r[2], r[3], 0, n, boundary, support, r[4], r[5], r[6], 50) for r in rows}

    stats = spark.createDataFrame([(*r, float(r[2] + r[3]) / 2) for r in rows], f"{CLUSTERS}, center_mean double").withColumnsRenamed({"start": "start_median", "end": "end_median"})
    votes = [(1, c, i, float((i * 7) % 5), float((i * 11) % 3)) for c, at in ((1, 4000), (2, 60), (3, 29_900)) for i in range(at - 30, at + 30)]
    after = spark._jsparkSession.sharedState().statusStore().executionsCount()
    voted = clusters.vote_boundaries(stats, spark.createDataFrame(votes, "k int, cluster_id int, row_idx long, start_votes double, end_votes double"), signal, lengths, K).collect()
    assert rows_generated(spark, after) < 200
    for r in voted:
        reach, ends = max(5, int(r.median_len * 0.35), int(r.median_len * 0.75)), []
        for place, median in ((3, r.start_median), (4, r.end_median)):
            value = np.zeros(n)
            mine = [v for v in votes if v[1] == r.cluster_id]
            for v in mine:
                value[v[2]] = v[place] / max(x[place] for x in mine)
            lo = max(0, median - reach)
            ends.append(lo + int(np.round(0.72 * value + 0.28 * boundary, 12)[lo : median + reach + 1].argmax()))
        start, end = ends if ends[1] > ends[0] else (r.start_median, r.end_median)
        if r.min_allowed_len <= end - start + 1 <= r.max_allowed_len:
            assert (r.start, r.end) == (start, end)
