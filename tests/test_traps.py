"""Hand vectors: each case where a plausible implementation would differ."""

import math

import pytest
from pyspark.sql import functions as F

from runline.operators import candidates, clean, clusters, folds, intervals, matching, report, select, temporal
from runline.sources import sessions

K = ["k"]


def series(spark, values, kind="double", name="v", key=1):
    return spark.createDataFrame([(key, i, v) for i, v in enumerate(values)], f"k int, row_idx long, {name} {kind}")


def segs(spark, pairs, key=1):
    return spark.createDataFrame([(key, i, a, b, b - a + 1) for i, (a, b) in enumerate(pairs)], "k int, seg_no int, start long, `end` long, length long")


def spans(df):
    return [(r.start, r.end) for r in df.orderBy("k", "start").collect()]


def group(spark):
    return spark.createDataFrame([(1,)], "k int")


def test_clean(spark):
    def run(values, **kw):
        return [r.v for r in clean.clean_numeric(series(spark, values, "string"), ["v"], K, **kw).orderBy("row_idx").collect()]

    values = [None, "x", "inf", "2", None, " 3 ", "1d"]
    assert run(values) == [2.0, 2.0, 2.0, 2.0, 2.0, 3.0, 3.0] == run(values, block=2)
    assert run([None, "nan", "true"]) == [0.0, 0.0, 0.0] == run([None, "nan", "true"], block=2)
    assert run(["-1.5e1", "+.5", "1f", "0x1"]) == [-15.0, 0.5, 0.5, 0.5]
    flags = clean.clean_numeric(series(spark, [True, None, False], "boolean"), ["v"], K).orderBy("row_idx").collect()
    assert [r.v for r in flags] == [1.0, 1.0, 0.0]


def test_labels(spark):
    assert [r.v for r in clean.label_int(series(spark, [None, 1.9, math.nan], "double"), "v", K).orderBy("row_idx").collect()] == [1, 1, 1]
    assert [r.v for r in clean.drop_null_labels(series(spark, ["5", None, "x", "2.7"], "string"), "v").orderBy("row_idx").collect()] == [5, 2]


def test_removal_joins_neighbours(spark):
    rows = clean.remove_production(series(spark, [2, 2, 5, 5, 2], "int", "phase"), [1, 2, 3, 4, 6], K).withColumn("row_idx", F.col("removed_row"))
    assert spans(intervals.contiguous_segments(rows, F.col("target_phase2") == 1, K)) == [(0, 2)]
    assert [r.original_row for r in rows.orderBy("row_idx").collect()] == [0, 1, 4]


def test_absent_feature_and_constant(spark):
    assert clean.select_feature_group(series(spark, [1.0]), ["v", "w"], ["k"]).first().w == 0.0
    for values, want in (([3.0, 3.0], [0.0, 0.0]), ([math.nan, math.inf, 4.0], [0.0, 0.0, 1.0])):
        assert [r.v for r in clean.minmax_normalise(series(spark, values), ["v"], K).orderBy("row_idx").collect()] == want


def test_even_window(spark):
    rows = series(spark, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])
    got = rows.select("row_idx", temporal.rolling_mean("v", 4, K).alias("m")).orderBy("row_idx").collect()
    assert [r.m for r in got] == [3 / 2, 6 / 3, 10 / 4, 14 / 4, 18 / 4, 15 / 3]
    assert series(spark, [7.0]).select(temporal.rolling_std("v", 5, K).alias("s")).first().s == 0.0


@pytest.mark.parametrize("block", [3, 7, 1000])
def test_halo_equals_windows(spark, block):
    values = [float((i * 37) % 11) for i in range(40)]
    rows = series(spark, values)
    for windows in ([5], [4, 9], [15]):
        a = temporal.temporal_features(rows, ["v"], windows, K, with_diff=True, block=block).orderBy("row_idx").collect()
        b = temporal.temporal_features_sql(rows, ["v"], windows, K, with_diff=True).orderBy("row_idx").collect()
        assert [x.asDict().keys() for x in a] == [x.asDict().keys() for x in b]
        for x, y in zip(a, b, strict=True):
            assert all(abs(x[c] - y[c]) < 1e-9 for c in y.asDict())


@pytest.mark.parametrize(("mask", "want"), [([0, 1, 1, 0, 1], [(1, 2), (4, 4)]), ([0, 0], []), ([1, 1, 1], [(0, 2)])])
def test_runs(spark, mask, want):
    rows = series(spark, mask, "int")
    found = intervals.contiguous_segments(rows, F.col("v") == 1, K)
    assert spans(found) == want
    assert [r.mask for r in intervals.segments_to_mask(rows, found, K).orderBy("row_idx").collect()] == mask


@pytest.mark.parametrize(("pairs", "gap", "want"), [([(0, 2), (5, 6)], 2, [(0, 6)]), ([(0, 2), (5, 6)], 1, [(0, 2), (5, 6)]), ([(0, 9), (2, 3), (11, 12)], 1, [(0, 12)])])
def test_merge(spark, pairs, gap, want):
    merged = intervals.merge_close(segs(spark, pairs), K, gap)
    assert spans(merged) == want == spans(intervals.merge_close(merged, K, gap))


def test_merge_before_filter(spark):
    rows = series(spark, [1, 1, 0, 1, 1], "int")
    assert spans(intervals.segments_from_mask(rows, F.col("v") == 1, K, 5, 1)) == [(0, 4)]


def test_mask_clips(spark):
    got = intervals.segments_to_mask(series(spark, [0] * 4, "int"), segs(spark, [(-3, 0), (2, 90), (2, 3), (-9, -5)]), K).orderBy("row_idx").collect()
    assert [r.mask for r in got] == [1, 0, 1, 1]


def test_iou(spark):
    def iou(a, b):
        return spark.range(1).select(matching.segment_iou(*[F.lit(x) for x in (*a, *b)]).alias("i")).first().i

    assert iou((0, 9), (5, 14)) == 5 / 15 and iou((0, 4), (5, 9)) == 0 and iou((5, 3), (0, 9)) == 0 and iou((3, 3), (3, 3)) == 1


def test_greedy(spark):
    tie = matching.match_segments(segs(spark, [(0, 9), (0, 9)]), segs(spark, [(0, 9)]), K).collect()
    assert [(r.pred_index, r.gt_index) for r in tie] == [(1, 0)]
    order = matching.match_segments(segs(spark, [(0, 9), (5, 14)]), segs(spark, [(0, 3), (4, 13)]), K).collect()
    assert sorted((r.pred_index, r.gt_index) for r in order) == [(0, 0), (1, 1)]


def test_best_when_disjoint_or_empty(spark):
    pred, gt = segs(spark, [(0, 1), (20, 21)]), segs(spark, [(10, 11)])
    row = matching.boundary_errors(pred, gt, K).first()
    assert (row.pred_index, row.iou, row.start_abs_error, row.end_abs_error) == (0, 0.0, 10, 10)
    row = matching.boundary_errors(pred.limit(0), gt, K).first()
    assert row.pred_index is None and row.iou == 0.0 and row.start_abs_error is None
    for empty in (1.0, None):
        row = matching.evaluate_segments(pred.limit(0), gt.limit(0), group(spark), K, empty=empty).first()
        assert (row.mean_best_gt_iou, row.best_any_iou, row.f1, row.tp) == (empty, empty, 0.0, 0)
    row = matching.evaluate_segments(pred, gt.limit(0), group(spark), K).first()
    assert (row.mean_best_gt_iou, row.precision, row.fp) == (0.0, 0.0, 2)


def test_interval_text(spark):
    assert intervals.interval_text(segs(spark, [(5, 6), (0, 2)]), group(spark), K).first().intervals == "0-2 | 5-6"
    assert intervals.interval_text(segs(spark, [(0, 1)]).limit(0), group(spark), K).first().intervals == "-"


def test_prior(spark):
    pairs = spark.createDataFrame([(9, 1)], "test_session int, train_session int")
    own = segs(spark, [(0, 0), (10, 11), (20, 23), (30, 39)]).withColumnRenamed("k", "session_id")
    row = folds.duration_prior(own, pairs).first()
    assert (row.p10_len, row.median_len, row.n_train_segments, row.min_allowed_len) == (1, 3, 4, 18)
    row = folds.duration_prior(own.limit(0), pairs).first()
    assert (row.n_train_segments, row.min_len, row.median_len, row.mean_segment_count) == (0, 18, 80, 0.0)


@pytest.mark.parametrize(("pos", "neg", "cap", "want"), [(10, 100, 40, (10, 30)), (100, 5, 40, (20, 5)), (10, 30, 40, (10, 30))])
def test_sample(spark, pos, neg, cap, want):
    rows = series(spark, [1] * pos + [0] * neg + [7], "int", "y").withColumnRenamed("k", "session_id")
    pairs = spark.createDataFrame([(9, 1), (8, 1)], "test_session int, train_session int")
    got = folds.balanced_sample(rows, pairs, "y", cap)
    for t in (8, 9):
        assert tuple(got.where(f"test_session = {t} and y = {y}").count() for y in (1, 0)) == want


def test_auc(spark):
    rows = spark.createDataFrame([(1, 0.1, 0), (1, 0.4, 0), (1, 0.4, 1), (1, 0.8, 1), (2, 0.3, 1)], "k int, p double, y int")
    assert {r.k: r.row_auc for r in report.row_auc(rows, "p", "y", K).collect()} == {1: 0.875, 2: None}


def test_row_metrics_of_overlapping_predictions(spark):
    n = spark.createDataFrame([(1, 10)], "k int, n_rows long")
    row = report.row_metrics(segs(spark, [(0, 3), (2, 5)]), segs(spark, [(4, 7)]), n, K).first()
    assert (row.row_precision, row.row_recall, row.row_accuracy) == (2 / 6, 2 / 4, 4 / 10)


@pytest.mark.parametrize(("pieces", "want"), [([(0, 9), (10, 11), (12, 30)], [(0, 11), (12, 30)]), ([(0, 1), (2, 30)], [(0, 30)]), ([(0, 20), (21, 22)], [(0, 22)]), ([(0, 1)], [(0, 1)])])
def test_short_pieces(pieces, want):
    assert candidates.merge_short_pieces(pieces, 5) == want


def test_split_pieces():
    assert candidates.split_pieces(0, 9, [(0.9, 5)], 5, 3, 10) == [(0, 9)]  # not longer than allowed
    assert candidates.split_pieces(0, 19, [(0.9, 9), (0.8, 10), (0.3, 4)], 10, 5, 12) == [(0, 9), (10, 19)]


def test_select_keeps_exact_threshold(spark):
    # IoU of (0,19) and (0,10): 11/20 = 0.55 is kept; with NMS at >= it would go.
    rows = spark.createDataFrame([(1, 1, 0, 19, 0.9), (1, 2, 0, 10, 0.8), (1, 3, 0, 18, 0.7), (1, 4, 30, 40, 0.1)], "k int, cluster_id int, start long, `end` long, rank_score double")
    targets = spark.createDataFrame([(1, 4, 3, 7)], "k int, target long, low long, high long")
    got = select.select_final(rows, targets, K).orderBy("start", "end").collect()
    assert [r.cluster_id for r in got] == [2, 1, 4] and [r.segment_no for r in got] == [1, 2, 3]
    capped = select.select_final(rows, targets.withColumn("high", F.lit(2)).withColumn("low", F.lit(1)), K)
    assert sorted(r.cluster_id for r in capped.collect()) == [1, 2]
    more = select.select_final(rows, targets.withColumn("low", F.lit(4)), K, backfill=0.96)
    assert sorted(r.cluster_id for r in more.collect()) == [1, 2, 3, 4]
    assert candidates.nms(rows.where("cluster_id < 3"), K, "rank_score", "cluster_id", 0.55).count() == 1


def test_chain_of_centers(spark):
    rows = [(1, i, float(c), 10) for i, c in enumerate([0, 7, 14, 15, 40, 47])]
    got = clusters.cluster_candidates(spark.createDataFrame(rows, "k int, ord int, center double, median_len long"), K)
    assert [r.cluster_id for r in got.orderBy("ord").collect()] == [1, 1, 2, 2, 3, 3]


def test_names(spark):
    names = ["data_from_session_13.csv", "data_from_2020.csv", "DATA_FROM_2021-11-26.csv", "Sess-2.csv", "s_2b.csv", "data_from_2021-12-07.csv"]
    got = spark.createDataFrame([(n,) for n in names], "file_name string").select("file_name", sessions.session_of_name(F.col("file_name")).alias("i")).collect()
    assert [r.i for r in got] == [13, None, 1, 2, None, 2]
    found = sessions.session_from_filename(spark.createDataFrame([(n,) for n in names], "file_name string"), [1, 2, 13, 14])
    assert {r.session_id: r.file_name for r in found.collect()}[2] == "data_from_2021-12-07.csv"
    assert [r.session_id for r in sessions.missing_sessions(found, [1, 2, 13, 14]).collect()] == [14]


def test_time(spark):
    rows = spark.createDataFrame([("2021-01-02 03:04:05",), ("x",), (None,), ("1000000000",)], "Time string")
    assert [r.u for r in sessions.parse_time(rows).select(F.unix_micros("ts").alias("u")).collect()] == [1609556645000000, None, None, 1000000]
    assert sessions.parse_time(spark.createDataFrame([(5,)], "TIME_IN_MS long"), unit="ms").select(F.unix_micros("ts").alias("u")).first().u == 5000


def test_csv_sessions(spark, tmp_path):
    head = " DateTime , Production ,FeedRate"
    (tmp_path / "Data_from_2021-12-07.csv").write_text(head + "\n" + "".join(f"2021-01-01 00:00:{i:02d},{i % 2},{'x' if i == 3 else i}\n" for i in range(50)))
    (tmp_path / "Data_from_2021-11-26.csv").write_text("Production,FeedRate,SpindleCleaning\n" + "".join(f"{'' if i < 2 else 1},{i},{i}\n" for i in range(30)))
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    rows = sessions.require_columns(sessions.read_sessions(spark, str(tmp_path)), ["Production", "FeedRate"])
    got = rows.orderBy("session_id", "row_idx").collect()
    assert [(r.session_id, r.row_idx) for r in got] == [(1, i) for i in range(30)] + [(2, i) for i in range(50)]
    assert got[3].SpindleCleaning == "3" and got[33].SpindleCleaning is None and got[33].FeedRate == "x"
    with pytest.raises(FileNotFoundError):
        sessions.read_sessions(spark, str(tmp_path), "none_*.csv")
    with pytest.raises(ValueError, match="Absent"):
        sessions.require_columns(rows, ["Absent"])
    sessions.write_tables({"full": rows, "none": rows.limit(0)}, str(tmp_path / "out"), ["session_id"])
    assert spark.read.parquet(str(tmp_path / "out" / "full")).count() == 80
    assert "FeedRate" in spark.read.parquet(str(tmp_path / "out" / "none")).columns


def test_tables_are_committed_together(spark, tmp_path):
    """A run that fails while it writes leaves the former tables; an interrupted commit is carried on; partitions are replaced alone."""
    path = str(tmp_path / "out")
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "s int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "s int, v string")

    def read(name="t"):
        return sorted((r.s, r.v) for r in spark.read.schema("s int, v string").parquet(f"{path}/{name}").collect())

    sessions.write_tables({"t": old, "u": old}, path, ["s"])
    broken = new.select(F.raise_error(F.lit("broken")).cast("int").alias("s"), "v")
    with pytest.raises(Exception, match="broken"):
        sessions.write_tables({"t": new, "u": broken}, path)
    assert read() == [(1, "a"), (2, "b")] == read("u")
    sessions.write_tables({"t": new}, path, ["s"], replace="partitions")
    assert read() == [(1, "a"), (2, "c"), (3, "d")] and not [x for x in (tmp_path / "out").iterdir() if x.name.startswith("_")]
    # Decided, staged, but not moved.
    new.write.parquet(f"{path}/_staging-1/t")
    spark.createDataFrame([('{"staging": "_staging-1", "moves": ["t"]}',)], "value string").coalesce(1).write.text(f"{path}/_commit")
    assert sessions.finish_commit(spark, path) and not sessions.finish_commit(spark, path)
    assert read() == [(2, "c"), (3, "d")]
    sessions.write_tables({"t": new.limit(0)}, path, ["s"])
    assert read() == [] and read("u") == [(1, "a"), (2, "b")]


def test_target_sessions_without_a_file(spark, tmp_path):
    for name in ("Data_from_2021-11-26.csv", "session_2.csv", "x_session_2.csv", "other.csv"):
        (tmp_path / name).write_text("a\n" + "".join(f"{name}{i}\n" for i in range(5)))
    rows = sessions.read_target_sessions(spark, str(tmp_path), [1, 2]).orderBy("session_id", "row_idx").collect()
    assert [(r.session_id, r.row_idx, r.a) for r in rows] == [(1, i, f"Data_from_2021-11-26.csv{i}") for i in range(5)] + [(2, i, f"x_session_2.csv{i}") for i in range(5)]
    with pytest.raises(FileNotFoundError, match="sessions 7, 13"):
        sessions.read_target_sessions(spark, str(tmp_path), [1, 7, 13])


def test_a_file_of_many_splits_is_numbered_by_them(spark, tmp_path):
    lines = [f"{i},{'x' * (i % 50)}" for i in range(4000)]
    (tmp_path / "Data_from_1.csv").write_text("a,b\n" + "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = sessions.read_files(spark, str(tmp_path)).select("a", "row_idx").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 4000 and all(int(r.a) == r.row_idx for r in rows)
