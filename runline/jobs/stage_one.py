"""Registered queries of the first stage: cleaning, windows, intervals, matching, folds, reports; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runline import config
from runline.config import Stage1
from runline.jobs import workflows
from runline.operators import clean, folds, intervals, matching, model, report, temporal, thresholds
from runline.sources import sessions
from runline.sources.machine_log import KEYS, SQL, machine_log, study_log
from runline.sources.scratch import Scratch

# Parameters of the fixture: a tenth of the real ones, as its sessions are.
W, THRESHOLD, GAP, MIN_LEN, GRID = 15, 0.5, 3, 4, [0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]
MOST_ROWS = 800
K = "session_id"
QUERIES: dict = {}
ORACLE: dict = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir, f=f: rounded(f(spark, sf_dir))
        QUERIES[f.__name__].__name__ = f.__name__
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- pieces of SQL


def r(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


def runs(name: str, src: str, mask: str, keys: str = K, row: str = "row_idx") -> str:
    return f"""{name} AS (SELECT {keys}, min(i) AS s, max(i) AS e FROM (
  SELECT {keys}, {row} AS i, {row} - row_number() OVER (PARTITION BY {keys} ORDER BY {row}) AS g FROM {src} WHERE {mask}) GROUP BY {keys}, g)"""


def merged(name: str, src: str, gap: int, keys: str = K) -> str:
    return f"""{name} AS (SELECT {keys}, min(s) AS s, max(e) AS e FROM (
  SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (
   SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 <= {gap} THEN 0 ELSE 1 END AS n
   FROM {src})) GROUP BY {keys}, g)"""


def long_only(name: str, src: str, least: int) -> str:
    return f"{name} AS (SELECT * FROM {src} WHERE e - s + 1 >= {least})"


def numbered(src: str, keys: str = K) -> str:
    return f"SELECT {keys}, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY s, e) - 1 AS INTEGER) AS seg_no, s AS start, e AS \"end\", e - s + 1 AS length FROM {src}"


def frame(w: int, row: str = "row_idx") -> str:
    return f"PARTITION BY {K} ORDER BY {row} ROWS BETWEEN {w // 2} PRECEDING AND {(w - 1) // 2} FOLLOWING"


def smoothed(value: str = "raw_score", w: int = W) -> str:
    return f"sm AS (SELECT {K}, row_idx, production, {value}, round(avg({value}) OVER ({frame(w)}), 9) AS p FROM ml)"


PRED = ",\n".join([smoothed(), runs("pr", "sm", f"p >= {THRESHOLD}"), merged("pm", "pr", GAP), long_only("pf", "pm", MIN_LEN), f"pred AS (SELECT *, CAST(row_number() OVER (PARTITION BY {K} ORDER BY s, e) - 1 AS INTEGER) AS i FROM pf)"])
GT = ",\n".join([runs("gr", "ml", "production = 1"), f"gt AS (SELECT *, CAST(row_number() OVER (PARTITION BY {K} ORDER BY s, e) - 1 AS INTEGER) AS i FROM gr)"])
IOU = "CASE WHEN least(p.e, g.e) >= greatest(p.s, g.s) THEN (least(p.e, g.e) - greatest(p.s, g.s) + 1) / CAST((p.e - p.s + 1) + (g.e - g.s + 1) - (least(p.e, g.e) - greatest(p.s, g.s) + 1) AS DOUBLE) ELSE 0.0 END"
PAIRS = f"pairs AS (SELECT p.{K}, p.i AS pi, p.s AS ps, p.e AS pe, g.i AS gi, g.s AS gs, g.e AS ge, {IOU} AS iou FROM pred p JOIN gt g USING ({K}))"
#: The whole list of pairs, walked from the best down; no split into groups.
MATCHED = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY iou DESC, pi DESC, gi DESC) AS rn FROM pairs WHERE iou >= 0.1),
walk AS (SELECT DISTINCT {K}, CAST(0 AS BIGINT) AS rn, CAST([] AS INTEGER[]) AS up, CAST([] AS INTEGER[]) AS ug, CAST(NULL AS BOOLEAN) AS take FROM ranked
 UNION ALL
 SELECT w.{K}, x.rn, CASE WHEN list_contains(w.up, x.pi) OR list_contains(w.ug, x.gi) THEN w.up ELSE list_append(w.up, x.pi) END,
  CASE WHEN list_contains(w.up, x.pi) OR list_contains(w.ug, x.gi) THEN w.ug ELSE list_append(w.ug, x.gi) END,
  NOT (list_contains(w.up, x.pi) OR list_contains(w.ug, x.gi))
 FROM walk w JOIN ranked x ON w.{K} = x.{K} AND x.rn = w.rn + 1),
matched AS (SELECT x.* FROM ranked x JOIN walk w ON x.{K} = w.{K} AND x.rn = w.rn WHERE w.take)"""
BEST = f"""best AS (SELECT g.{K}, g.i AS gi, g.s AS gs, g.e AS ge, x.pi, x.ps, x.pe, coalesce(x.iou, 0.0) AS iou FROM gt g LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY {K}, gi ORDER BY iou DESC, pi) AS rn FROM pairs) x ON x.{K} = g.{K} AND x.gi = g.i AND x.rn = 1)"""
EVALUATED = f"""ev AS (SELECT a.{K}, coalesce(p.n, 0) AS n_pred, coalesce(g.n, 0) AS n_gt, coalesce(m.n, 0) AS tp, coalesce(m.q, 0.0) AS mq, b.mb, b.bb FROM (SELECT DISTINCT {K} FROM ml) a
 LEFT JOIN (SELECT {K}, count(*) AS n FROM pred GROUP BY {K}) p USING ({K}) LEFT JOIN (SELECT {K}, count(*) AS n FROM gt GROUP BY {K}) g USING ({K})
 LEFT JOIN (SELECT {K}, count(*) AS n, avg(iou) AS q FROM matched GROUP BY {K}) m USING ({K}) LEFT JOIN (SELECT {K}, avg(iou) AS mb, max(iou) AS bb FROM best GROUP BY {K}) b USING ({K})),
ev2 AS (SELECT {K}, n_pred, n_gt, tp, n_pred - tp AS fp, n_gt - tp AS fn, CASE WHEN n_pred > 0 THEN tp / CAST(n_pred AS DOUBLE) ELSE 0.0 END AS precision, CASE WHEN n_gt > 0 THEN tp / CAST(n_gt AS DOUBLE) ELSE 0.0 END AS recall, mq AS matched_mean_iou,
  CASE WHEN n_gt = 0 AND n_pred = 0 THEN 1.0 ELSE coalesce(mb, 0.0) END AS mean_best_gt_iou, CASE WHEN n_gt = 0 AND n_pred = 0 THEN 1.0 ELSE coalesce(bb, 0.0) END AS best_any_iou FROM ev),
ev3 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM ev2)"""


def sql(*parts: str, recursive: bool = False) -> str:
    *ctes, last = parts
    return f"WITH {'RECURSIVE ' if recursive else ''}{SQL},\n" + ",\n".join(ctes) + ("\n" if ctes else "") + last if ctes else f"WITH {SQL}\n{last}"


def pred_of(log: DataFrame) -> DataFrame:
    return intervals.prob_to_segments(log, "raw_score", THRESHOLD, KEYS, W, GAP, MIN_LEN)


def gt_of(log: DataFrame) -> DataFrame:
    return intervals.contiguous_segments(log, F.col("production") == 1, KEYS)


def sides(spark: SparkSession, sf_dir: str):
    """The log, its predicted and true intervals (written, as they are used several times), its sessions."""
    log, scratch = machine_log(spark, sf_dir), Scratch(spark, "sides")
    return log, scratch.stored(pred_of(log)), scratch.stored(gt_of(log)), log.select(K).distinct()


# ---- sources

NAMES = "CASE event_id % 5 WHEN 0 THEN concat('Data_from_session_', event_id, '.csv') WHEN 1 THEN concat('DATA_FROM_S-', event_id % 3, '.csv') WHEN 2 THEN 'data_from_2021-12-07.csv' WHEN 3 THEN concat('x_sess ', event_id, '.CSV') ELSE 'data_from_2022-04.csv' END"


@query(f"""SELECT session_id, max(f) AS file_name FROM (SELECT f, CASE lower(f) WHEN 'data_from_2021-11-26.csv' THEN 1 WHEN 'data_from_2021-12-07.csv' THEN 2 WHEN 'data_from_2022-04.csv' THEN 13
 ELSE TRY_CAST(regexp_extract(lower(f), '(session|sess|s)[_\\- ]*(1|2|13)\\b', 2) AS INTEGER) END AS session_id FROM (SELECT {NAMES} AS f FROM events)) WHERE session_id IN (1, 2, 13) GROUP BY session_id""")
def session_from_filename(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.expr(NAMES).alias("file_name"))
    return sessions.session_from_filename(names, [1, 2, 13])


@query(f"SELECT day(ts)::INTEGER AS {K}, event_id, row_number() OVER (PARTITION BY day(ts) ORDER BY ts, event_id) - 1 AS row_idx FROM events")
def row_index(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.dayofmonth("ts").alias(K), "event_id", "ts")
    return sessions.row_index(rows, KEYS, ["ts", "event_id"]).drop("ts")


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN NULL ELSE epoch_us(date_trunc('second', ts)) END AS micros FROM events")
def parse_time(spark, sf_dir):
    text = F.when(F.col("event_id") % 7 == 0, "not a time").when(F.col("event_id") % 5 == 0, None).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", text.alias("DateTime"))
    return sessions.parse_time(rows).select("event_id", F.unix_micros("ts").alias("micros"))


def _session_files(spark, sf_dir) -> str:
    """The log as one CSV file per session, in order of rows, with blanks around a column's name."""
    log = machine_log(spark, sf_dir).select(K, "row_idx", "feed_rate", "tool_number")
    path = Scratch(spark, "files").path()
    n = log.agg(F.max(K)).first()[0] or 1
    one_each = log.repartitionById(n, F.col(K) - 1).sortWithinPartitions("row_idx").select(F.col(K).alias("day"), F.col("row_idx").alias("place"), F.col("feed_rate").alias("  feed_rate "), "tool_number")
    one_each.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


FILES_SQL = sql(f"SELECT {K}, row_idx, CAST({K} AS BIGINT) AS day, row_idx AS place, {r('feed_rate', 'feed_rate')}, tool_number FROM ml")


def _typed(rows: DataFrame) -> DataFrame:
    return rows.select(K, "row_idx", F.col("day").cast("long").alias("day"), F.col("place").cast("long").alias("place"), F.col("feed_rate").cast("double").alias("feed_rate"), F.col("tool_number").cast("int").alias("tool_number"))


@query(FILES_SQL)
def read_sessions(spark, sf_dir):
    return _typed(sessions.read_sessions(spark, _session_files(spark, sf_dir), "part-*.csv"))


@query(FILES_SQL)
def normalise_header(spark, sf_dir):
    rows = spark.read.option("header", True).csv(_session_files(spark, sf_dir))
    named = sessions.require_columns(sessions.normalise_header(rows), ["day", "place", "feed_rate", "tool_number"])
    return _typed(named.withColumns({K: F.col("day").cast("int"), "row_idx": F.col("place").cast("long")}))


@query(sql(f"SELECT {K}, count(*) AS n, {r('sum(feed_rate)', 'total')} FROM ml GROUP BY {K}"))
def write_tables(spark, sf_dir):
    path = Scratch(spark, "tables").path()
    sessions.write_tables({"log": machine_log(spark, sf_dir).select(K, "row_idx", "feed_rate")}, path, [K])
    return spark.read.parquet(f"{path}/log").groupBy(K).agg(F.count("*").alias("n"), F.sum("feed_rate").alias("total"))


# ---- cleaning

CLEAN = f"""num AS (SELECT {K}, row_idx, CASE WHEN isfinite(TRY_CAST(coolant_flow AS DOUBLE)) THEN TRY_CAST(coolant_flow AS DOUBLE) END AS v FROM ml),
cl AS (SELECT {K}, row_idx, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY {K} ORDER BY row_idx ROWS UNBOUNDED PRECEDING),
  first_value(v IGNORE NULLS) OVER (PARTITION BY {K} ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0.0) AS v FROM num)"""


@query(sql(CLEAN, f"SELECT {K}, row_idx, {r('v', 'coolant_flow')} FROM cl"))
def clean_numeric(spark, sf_dir):
    return clean.clean_numeric(machine_log(spark, sf_dir).select(K, "row_idx", "coolant_flow"), ["coolant_flow"], KEYS, block=None)


@query(sql(CLEAN, f"SELECT {K}, row_idx, {r('v', 'coolant_flow')} FROM cl"))
def clean_numeric_in_blocks(spark, sf_dir):
    return clean.clean_numeric(machine_log(spark, sf_dir).select(K, "row_idx", "coolant_flow"), ["coolant_flow"], KEYS, block=64)


@query(sql(CLEAN, f"SELECT {K}, row_idx, CAST(trunc(v) AS INTEGER) AS coolant_flow FROM cl"))
def label_int(spark, sf_dir):
    return clean.label_int(machine_log(spark, sf_dir).select(K, "row_idx", "coolant_flow"), "coolant_flow", KEYS)


@query(sql(CLEAN, f"SELECT {K}, row_idx, CAST(trunc(v) AS INTEGER) AS coolant_flow FROM num WHERE v IS NOT NULL"))
def drop_null_labels(spark, sf_dir):
    return clean.drop_null_labels(machine_log(spark, sf_dir).select(K, "row_idx", "coolant_flow"), "coolant_flow")


@query(sql(f"SELECT {K}, row_idx AS original_row, row_number() OVER (PARTITION BY {K} ORDER BY row_idx) - 1 AS removed_row, phase, CAST(phase = 2 AS INTEGER) AS target_phase2 FROM ml WHERE phase IN (1, 2, 3, 4, 6)"))
def remove_production(spark, sf_dir):
    out = clean.remove_production(machine_log(spark, sf_dir).select(K, "row_idx", "phase"), [1, 2, 3, 4, 6], KEYS)
    return out.select(K, "original_row", "removed_row", "phase", "target_phase2")


@query(sql(f"SELECT {K}, row_idx, {r('feed_rate', 'feed_rate')}, {r('CAST(0 AS DOUBLE)', 'spindle_cleaning')}, tool_number FROM ml"))
def select_feature_group(spark, sf_dir):
    return clean.select_feature_group(machine_log(spark, sf_dir), ["feed_rate", "spindle_cleaning", "tool_number"], [K, "row_idx"])


@query(sql(f"SELECT {K}, row_idx, {r('CASE WHEN max(spindle_speed) OVER w > min(spindle_speed) OVER w THEN (spindle_speed - min(spindle_speed) OVER w) / (max(spindle_speed) OVER w - min(spindle_speed) OVER w) ELSE 0.0 END', 'spindle_speed')} FROM ml WINDOW w AS (PARTITION BY {K})"))
def minmax_normalise(spark, sf_dir):
    return clean.minmax_normalise(machine_log(spark, sf_dir).select(K, "row_idx", "spindle_speed"), ["spindle_speed"], KEYS)


@query(sql(GT, f"SELECT a.{K}, a.n AS n_rows, {r('a.q', 'positive_ratio')}, coalesce(b.n, 0) AS n_segments FROM (SELECT {K}, count(*) AS n, avg(production) AS q FROM ml GROUP BY {K}) a LEFT JOIN (SELECT {K}, count(*) AS n FROM gt GROUP BY {K}) b USING ({K})"))
def session_profile(spark, sf_dir):
    log = machine_log(spark, sf_dir)
    return clean.session_profile(log, "production", gt_of(log), KEYS)


# ---- windows

DIFF = f"df AS (SELECT {K}, row_idx, production, feed_rate AS x, coalesce(feed_rate - lag(feed_rate) OVER (PARTITION BY {K} ORDER BY row_idx), 0.0) AS d FROM ml)"


def _window_query(**cols):
    def run(spark, sf_dir):
        return temporal.step_rows(machine_log(spark, sf_dir), cols, KEYS, block=2000).select(K, "row_idx", *cols)

    return run


def _named(name: str, run, text: str):
    run.__name__ = name
    query(text)(run)


_named("row_diff", _window_query(diff1=("feed_rate", "diff"), absdiff1=("feed_rate", "absdiff")), sql(DIFF, f"SELECT {K}, row_idx, {r('d', 'diff1')}, {r('abs(d)', 'absdiff1')} FROM df"))
@query(sql(f"SELECT {K}, row_idx, {r(f'avg(feed_rate) OVER ({frame(W)})', 'm')}, {r(f'avg(feed_rate) OVER ({frame(4)})', 'even')} FROM ml"))
def rolling_mean(spark, sf_dir):
    return temporal.rolling_rows(machine_log(spark, sf_dir), {"m": ("feed_rate", "mean", W), "even": ("feed_rate", "mean", 4)}, KEYS, block=2000)


@query(sql(f"SELECT {K}, row_idx, {r(f'coalesce(stddev_samp(feed_rate) OVER ({frame(W)}), 0.0)', 's')} FROM ml"))
def rolling_std(spark, sf_dir):
    return temporal.rolling_rows(machine_log(spark, sf_dir), {"s": ("feed_rate", "std", W)}, KEYS, block=2000)


@query(sql(f"SELECT {K}, row_idx, {r(f'avg(raw_score) OVER ({frame(W)})', 'smoothed')}, {r('raw_score', 'same')} FROM ml"))
def smooth(spark, sf_dir):
    rows = temporal.smooth_rows(machine_log(spark, sf_dir).select(K, "row_idx", "raw_score"), {"smoothed": "raw_score"}, W, KEYS, block=2000)
    return temporal.smooth_rows(rows, {"same": "raw_score"}, 1, KEYS).drop("raw_score")


_named("change_flag", _window_query(changed=("program_status", "change")), sql(f"SELECT {K}, row_idx, {r(f'coalesce(CAST(CAST(program_status <> lag(program_status) OVER (PARTITION BY {K} ORDER BY row_idx) AS INTEGER) AS DOUBLE), 0.0)', 'changed')} FROM ml"))


@query(sql(DIFF, f"SELECT {K}, row_idx, {r(f'avg(abs(d)) OVER ({frame(W)})', 'absdiff_mean')} FROM df"))
def rolling_absdiff_mean(spark, sf_dir):
    return temporal.rolling_rows(machine_log(spark, sf_dir), {"absdiff_mean": ("feed_rate", "absdiff_mean", W)}, KEYS, block=2000)


def _features_sql(diffs: bool) -> str:
    cols = []
    for c, x in (("feed_rate", "x"), ("spindle_speed", "y")):
        cols += [r(x, c), *([r(f"d{x}", f"{c}_diff1"), r(f"abs(d{x})", f"{c}_absdiff1")] if diffs else [])]
        for w in (5, W):
            cols += [r(f"avg({x}) OVER ({frame(w)})", f"{c}_mean_{w}"), r(f"coalesce(stddev_samp({x}) OVER ({frame(w)}), 0.0)", f"{c}_std_{w}"), r(f"avg(abs(d{x})) OVER ({frame(w)})", f"{c}_absdiff_mean_{w}")]
    both = f"fx AS (SELECT {K}, row_idx, production, x, y, " + ", ".join(f"coalesce({x} - lag({x}) OVER (PARTITION BY {K} ORDER BY row_idx), 0.0) AS d{x}" for x in "xy") + " FROM (SELECT *, feed_rate AS x, spindle_speed AS y FROM ml))"
    return sql(both, f"SELECT {K}, row_idx, {', '.join(cols)} FROM fx")


@query(_features_sql(True))
def temporal_features(spark, sf_dir):
    return temporal.temporal_features(machine_log(spark, sf_dir), ["feed_rate", "spindle_speed"], [5, W], KEYS, with_diff=True, block=2000)


@query(_features_sql(False))
def temporal_features_sql(spark, sf_dir):
    return temporal.temporal_features_sql(machine_log(spark, sf_dir), ["feed_rate", "spindle_speed"], [5, W], KEYS)


@query(sql(DIFF, GT, f"SELECT d.{K}, d.row_idx, {r('x', 'feed_rate')}, {r(f'avg(x) OVER (PARTITION BY d.{K} ORDER BY d.row_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)', 'feed_rate_mean_5')}, d.production, g.i AS segment FROM df d LEFT JOIN gt g ON g.{K} = d.{K} AND d.row_idx BETWEEN g.s AND g.e"))
def make_xy(spark, sf_dir):
    log = machine_log(spark, sf_dir)
    features = temporal.temporal_features_sql(log, ["feed_rate"], [5], KEYS).select(K, "row_idx", "feed_rate", "feed_rate_mean_5")
    return temporal.make_xy(features, log, gt_of(log), KEYS, "production")


# ---- intervals


@query(sql(GT, numbered("gt")))
def contiguous_segments(spark, sf_dir):
    return gt_of(machine_log(spark, sf_dir))


@query(sql(smoothed(), runs("pr", "sm", f"p >= {THRESHOLD}"), merged("pm", "pr", GAP), numbered("pm")))
def merge_close(spark, sf_dir):
    log = machine_log(spark, sf_dir)
    rows = log.select(K, "row_idx", "raw_score")
    rows = temporal.smooth_rows(rows, {"p": "raw_score"}, W, KEYS).withColumn("p", F.round("p", 9))
    return intervals.merge_close(intervals.contiguous_segments(rows, F.col("p") >= THRESHOLD, KEYS), KEYS, GAP)


@query(sql(runs("gr", "ml", "tool_number <> 3"), long_only("gl", "gr", 9), numbered("gl")))
def filter_short(spark, sf_dir):
    return intervals.filter_short(intervals.contiguous_segments(machine_log(spark, sf_dir), F.col("tool_number") != 3, KEYS), 9, KEYS)


@query(sql(runs("gr", "ml", "tool_number <> 3"), merged("gm", "gr", 1), long_only("gl", "gm", 12), numbered("gl")))
def segments_from_mask(spark, sf_dir):
    return intervals.segments_from_mask(machine_log(spark, sf_dir), F.col("tool_number") != 3, KEYS, 12, 1)


@query(sql(PRED, numbered("pred")))
def prob_to_segments(spark, sf_dir):
    return pred_of(machine_log(spark, sf_dir))


def _per_threshold(thresholds: list[float]) -> list[str]:
    """Every threshold over all rows: no runs."""
    keys = f"{K}, threshold"
    grid = f"sg AS (SELECT sm.*, t.threshold FROM sm CROSS JOIN (SELECT CAST(unnest({thresholds}) AS DOUBLE) AS threshold) t)"
    return [smoothed(), grid, runs("tr", "sg", "p >= threshold", keys), merged("tm", "tr", GAP, keys), long_only("tf", "tm", MIN_LEN)]


@query(sql(*_per_threshold([0.5, 0.35]), numbered("tf", f"{K}, threshold")))
def prob_to_blobs(spark, sf_dir):
    return intervals.prob_to_blobs(machine_log(spark, sf_dir), "raw_score", [0.50, 0.35], KEYS, W, GAP, MIN_LEN)


@query(sql(PRED, f"SELECT m.{K}, m.row_idx, CAST(max(CASE WHEN p.s IS NULL THEN 0 ELSE 1 END) AS INTEGER) AS mask FROM ml m LEFT JOIN pred p ON p.{K} = m.{K} AND m.row_idx BETWEEN p.s AND p.e GROUP BY m.{K}, m.row_idx"))
def segments_to_mask(spark, sf_dir):
    log = machine_log(spark, sf_dir)
    return intervals.segments_to_mask(log.select(K, "row_idx"), pred_of(log), KEYS)


REGIONS = f"rg AS (SELECT m.{K}, m.row_idx, CASE WHEN p.s IS NOT NULL AND g.s IS NOT NULL THEN 'overlap' WHEN p.s IS NOT NULL THEN 'pred_only' WHEN g.s IS NOT NULL THEN 'gt_only' END AS region FROM ml m LEFT JOIN pred p ON p.{K} = m.{K} AND m.row_idx BETWEEN p.s AND p.e LEFT JOIN gt g ON g.{K} = m.{K} AND m.row_idx BETWEEN g.s AND g.e)"


@query(sql(PRED, GT, REGIONS, runs("rr", "rg", "region IS NOT NULL", f"{K}, region"), numbered("rr", f"{K}, region")))
def mask_regions(spark, sf_dir):
    log, pred, gt, _ = sides(spark, sf_dir)
    return intervals.mask_regions(log, pred, gt, KEYS)


def _text(src: str, name: str) -> str:
    return f"SELECT a.{K}, coalesce(string_agg(concat(b.s, '-', b.e), ' | ' ORDER BY b.s, b.e), '-') AS {name} FROM (SELECT DISTINCT {K} FROM ml) a LEFT JOIN {src} b ON a.{K} = b.{K} AND b.s IS NOT NULL GROUP BY a.{K}"


@query(sql(PRED, _text("pred", "intervals").replace("coalesce(string_agg", "coalesce(string_agg")))
def interval_text(spark, sf_dir):
    log, pred, _, groups = sides(spark, sf_dir)
    return intervals.interval_text(pred, groups, KEYS)


# ---- matching


@query(sql(PRED, GT, PAIRS, f"SELECT {K}, pi AS pred_index, gi AS gt_index, {r('iou', 'iou')} FROM pairs"))
def segment_iou(spark, sf_dir):
    log, pred, gt, _ = sides(spark, sf_dir)
    p = pred.select(K, F.col("seg_no").alias("pred_index"), F.col("start").alias("a"), F.col("end").alias("b"))
    g = gt.select(K, F.col("seg_no").alias("gt_index"), F.col("start").alias("x"), F.col("end").alias("y"))
    return p.join(g, K).select(K, "pred_index", "gt_index", matching.segment_iou(F.col("a"), F.col("b"), F.col("x"), F.col("y")).alias("iou"))


@query(sql(PRED, GT, PAIRS, f"SELECT {K}, pi AS pred_index, ps AS pred_start, pe AS pred_end, gi AS gt_index, gs AS gt_start, ge AS gt_end, {r('iou', 'iou')} FROM pairs WHERE iou > 0"))
def iou_pairs(spark, sf_dir):
    _, pred, gt, _ = sides(spark, sf_dir)
    return matching.iou_pairs(pred, gt, KEYS)


@query(sql(PRED, GT, PAIRS, MATCHED, f"SELECT {K}, {r('iou', 'iou')}, pi AS pred_index, gi AS gt_index, ps AS pred_start, pe AS pred_end, gs AS gt_start, ge AS gt_end FROM matched", recursive=True))
def match_segments(spark, sf_dir):
    _, pred, gt, _ = sides(spark, sf_dir)
    return matching.match_segments(pred, gt, KEYS)


@query(sql(PRED, GT, PAIRS, BEST, f"SELECT {K}, gi AS gt_index, gs AS gt_start, ge AS gt_end, pi AS pred_index, ps AS pred_start, pe AS pred_end, {r('iou', 'iou')} FROM best"))
def best_pred_per_gt(spark, sf_dir):
    _, pred, gt, _ = sides(spark, sf_dir)
    return matching.best_pred_per_gt(pred, gt, KEYS)


@query(sql(PRED, GT, PAIRS, BEST, f"SELECT {K}, gi AS gt_index, gs AS gt_start, ge AS gt_end, pi AS pred_index, ps AS pred_start, pe AS pred_end, {r('iou', 'iou')}, abs(ps - gs) AS start_abs_error, abs(pe - ge) AS end_abs_error FROM best"))
def boundary_errors(spark, sf_dir):
    _, pred, gt, _ = sides(spark, sf_dir)
    return matching.boundary_errors(pred, gt, KEYS)


@query(sql(PRED, GT, PAIRS, MATCHED, BEST, EVALUATED, f"SELECT {K}, {r('mean_best_gt_iou', 'mean_best_gt_iou')}, {r('best_any_iou', 'best_any_iou')} FROM ev3", recursive=True))
def best_iou_summary(spark, sf_dir):
    _, pred, gt, groups = sides(spark, sf_dir)
    return matching.best_iou_summary(pred, gt, groups, KEYS)


EV_COLUMNS = f"{K}, n_pred, n_gt, tp, fp, fn, " + ", ".join(r(m, m) for m in ("precision", "recall", "f1", "matched_mean_iou", "mean_best_gt_iou", "best_any_iou"))


@query(sql(PRED, GT, PAIRS, MATCHED, BEST, EVALUATED, f"SELECT {EV_COLUMNS} FROM ev3", recursive=True))
def evaluate_segments(spark, sf_dir):
    _, pred, gt, groups = sides(spark, sf_dir)
    return matching.evaluate_segments(pred, gt, groups, KEYS)


@query(sql(PRED, GT, PAIRS, MATCHED, f"SELECT {K}, {r('iou', 'iou')}, pi AS pred_index, gi AS gt_index, ps AS pred_start, pe AS pred_end, gs AS gt_start, ge AS gt_end, pe - ps + 1 AS pred_length, ge - gs + 1 AS gt_length FROM matched", recursive=True))
def matched_segments(spark, sf_dir):
    _, pred, gt, _ = sides(spark, sf_dir)
    return matching.matched_segments(pred, gt, KEYS)


@query(sql(PRED, f"SELECT {K}, i + 1 AS pred_no, s AS start, e AS \"end\", e - s + 1 AS length FROM pred"))
def predicted_segments(spark, sf_dir):
    return matching.predicted_segments(pred_of(machine_log(spark, sf_dir)), KEYS)


@query(sql(PRED, GT, f"SELECT {K}, i + 1 AS segment_no, s AS start, e AS \"end\", e - s + 1 AS length, 'PRED' AS type FROM pred UNION ALL SELECT {K}, i + 1, s, e, e - s + 1, 'GT' FROM gt"))
def gt_pred_segments(spark, sf_dir):
    _, pred, gt, _ = sides(spark, sf_dir)
    return matching.gt_pred_segments(pred, gt, KEYS)


# ---- folds, training, thresholds

FOLDS = f"s AS (SELECT DISTINCT {K} FROM ml), folds AS (SELECT a.{K} AS test_session, b.{K} AS train_session FROM s a JOIN s b ON a.{K} <> b.{K})"


@query(sql(FOLDS, "SELECT * FROM folds"))
def loo_folds(spark, sf_dir):
    return folds.loo_folds(machine_log(spark, sf_dir))


def _sample_sql(most: int, name: str = "sample") -> str:
    """Ranks of a fold: the row's hash times the fold's factor, modulo a prime."""
    return f"""ct AS (SELECT {K}, count(*) AS n, sum(production) AS pos FROM ml GROUP BY {K}),
qt AS (SELECT {K}, CASE WHEN n <= {most} THEN pos ELSE least(pos, {most // 2}) END AS q1, CASE WHEN n <= {most} THEN n - pos ELSE least(n - pos, {most} - least(pos, {most // 2})) END AS q0 FROM ct),
hs AS (SELECT {K}, row_idx, production, CAST('0x' || substr(md5(concat_ws('|', CAST({K} AS VARCHAR), CAST(row_idx AS VARCHAR))), 1, 8) AS BIGINT) % 2147483647 AS h FROM ml),
rk AS (SELECT f.test_session, m.{K}, m.row_idx, m.production, q1, q0, row_number() OVER (PARTITION BY f.test_session, m.{K}, m.production ORDER BY h * (1 + (1042 + f.test_session) * 2654435761 % 2147483646) % 2147483647, m.row_idx) AS rn
 FROM folds f JOIN hs m ON m.{K} = f.train_session JOIN qt ON qt.{K} = m.{K}),
{name} AS (SELECT test_session, {K}, row_idx, production FROM rk WHERE rn <= CASE WHEN production = 1 THEN q1 ELSE q0 END)"""


def _sample(log: DataFrame, most: int) -> DataFrame:
    return folds.balanced_sample(log, folds.loo_folds(log), "production", most)


_SAMPLES = [sql(FOLDS, _sample_sql(n), f"SELECT test_session, {K}, row_idx, production, {n} AS max_rows FROM sample") for n in (100, 8000)]


@query(" UNION ALL ".join(f"SELECT * FROM ({x})" for x in _SAMPLES))
def balanced_sample(spark, sf_dir):
    """At the studies' own cap, and at one that even the smallest table's sessions exceed."""
    log = machine_log(spark, sf_dir)
    return _sample(log, 100).withColumn("max_rows", F.lit(100)).unionByName(_sample(log, 8000).withColumn("max_rows", F.lit(8000)))


@query(sql(FOLDS, _sample_sql(8000), f"SELECT test_session, feature, {r('avg(x)', 'mean')}, {r('CASE WHEN stddev_pop(x) = 0 THEN 1.0 ELSE stddev_pop(x) END', 'std')} FROM (SELECT s.test_session, u.feature, u.x FROM sample s JOIN (SELECT {K}, row_idx, 'feed_rate' AS feature, feed_rate AS x FROM ml UNION ALL SELECT {K}, row_idx, 'spindle_speed', spindle_speed FROM ml) u USING ({K}, row_idx)) GROUP BY test_session, feature"))
def standard_scaler(spark, sf_dir):
    log = machine_log(spark, sf_dir)
    rows = _sample(log, 8000).join(log.select(K, "row_idx", "feed_rate", "spindle_speed"), [K, "row_idx"])
    return folds.standard_scaler(rows, ["feed_rate", "spindle_speed"], ["test_session"])


def _training_rows(spark, sf_dir, features=("feed_rate", "spindle_speed", "raw_score")):
    log = machine_log(spark, sf_dir)
    rows = temporal.temporal_features_sql(log, list(features), [5], KEYS)
    sample = folds.balanced_sample(log, folds.loo_folds(log), "production", max_rows=MOST_ROWS)
    return log, Scratch(spark, "training").stored(sample.join(rows, [K, "row_idx"])), [c for c in rows.columns if c not in (K, "row_idx")]


@query()
def train_logreg(spark, sf_dir):
    """Weights per fold, over all sessions; SQL has no fit, tests compare with a plain Newton fit."""
    _, rows, names = _training_rows(spark, sf_dir)
    models = model.train_logreg(rows, names, ["test_session"], "production")
    entries = [F.struct(F.lit(k[0]).alias("test_session"), F.lit(f).alias("feature"), F.lit(float(w)).alias("weight")) for k, m in sorted(models.items()) for f, w in zip([*m.features, "intercept"], m.weights, strict=True)]
    return spark.range(1).select(F.inline(F.array(*entries)))


#: Groups of the log's sensors as stage one takes them; spindle_cleaning is absent.
EXPERIMENTS = {"EXP01_all": ["program_status", "tool_number", "coolant_flow", "feed_rate", "spindle_speed", "spindle_cleaning"], "EXP03_program_only": ["program_status", "tool_number"], "EXP04_physical_only": ["coolant_flow", "feed_rate", "spindle_speed", "spindle_cleaning"]}
FIXTURE = Stage1(windows=(5, W), smooth=W, merge_gap=GAP, min_len=MIN_LEN, thresholds=tuple(GRID), max_train_rows=MOST_ROWS)


@query()
def production_workflow(spark, sf_dir):
    """All of stage one with fitted models, over all sessions and three groups of sensors: its summary of folds."""
    tables = workflows.localise_production(Scratch(spark, "production"), machine_log(spark, sf_dir), EXPERIMENTS, FIXTURE)
    return tables["loo_summary"]


@query()
def production_study(spark, sf_dir):
    """The first study with its own seven groups of sensors and parameters: its tables written, the folds of all experiments read again."""
    scratch = Scratch(spark, "production-study")
    return workflows.saved(workflows.localise_production(scratch, study_log(spark, sf_dir), config.EXPERIMENTS, Stage1()), scratch.path(), "all_experiments_fold_results")


COEFFICIENTS = (["feed_rate", "spindle_speed", "raw_score"], [50.0, 50.0, 0.4], [29.0, 28.0, 0.2], [0.3, -0.2, 2.5], -0.7)
Z = "-0.7e0 + (feed_rate - 50e0) / 29e0 * 0.3e0 + (spindle_speed - 50e0) / 28e0 * (-0.2e0) + (raw_score - 0.4e0) / 0.2e0 * 2.5e0"
SCORED = f"SELECT {K}, row_idx, {r(f'1 / (1 + exp(-({Z})))', 'prob')} FROM ml"


@query(sql(SCORED.replace("row_idx,", "row_idx, 'fixed' AS model,")))
def score_rows(spark, sf_dir):
    import numpy as np

    names, mean, std, weights, intercept = COEFFICIENTS
    models = {("fixed",): model.LogReg(names, np.array(mean), np.array(std), np.array([*weights, intercept]))}
    return model.score_rows(machine_log(spark, sf_dir), models, ["model"], ["string"], [K, "row_idx"])


@query(sql(SCORED))
def score_expression(spark, sf_dir):
    return machine_log(spark, sf_dir).select(K, "row_idx", model.score_expression(*COEFFICIENTS).alias("prob"))


@query(sql(f"tg AS (SELECT round(0.2e0 + i * 0.025e0, 3) AS threshold FROM range(25) t(i)), {smoothed()}", f"SELECT {K}, {r('threshold', 'threshold')}, count(*) FILTER (p >= threshold) AS n_rows FROM sm CROSS JOIN tg GROUP BY {K}, threshold"))
def threshold_grid(spark, sf_dir):
    """How many rows of each session reach each threshold of the grid."""
    log = machine_log(spark, sf_dir)
    rows = temporal.smooth_rows(log.select(K, "row_idx", "raw_score"), {"p": "raw_score"}, W, KEYS, block=2000).withColumn("p", F.round("p", 9))
    return thresholds.rows_reaching(rows, "p", [t.threshold for t in thresholds.threshold_grid(spark).collect()], KEYS)  # 25 rows


def _in_thresholds(text: str) -> str:
    """The evaluation SQL with the threshold as a further key."""
    return text.replace(f"USING ({K})", "USING (kt)").replace(K, "kt")


T_KEYED = "th AS (SELECT CAST(unnest([0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]) AS DOUBLE) AS threshold)"
OBJECTIVE = ",\n".join([
    *_per_threshold(GRID),
    GT.replace("gt AS", "gt0 AS"),
    f"pred AS (SELECT {K} * 1000 + CAST(round(threshold * 100) AS INTEGER) AS kt, s, e, CAST(row_number() OVER (PARTITION BY {K}, threshold ORDER BY s, e) - 1 AS INTEGER) AS i FROM tf)",
    f"gt AS (SELECT {K} * 1000 + CAST(round(threshold * 100) AS INTEGER) AS kt, s, e, i FROM gt0 CROSS JOIN (SELECT DISTINCT threshold FROM sg))",
    _in_thresholds(PAIRS), _in_thresholds(MATCHED), _in_thresholds(BEST),
    _in_thresholds(EVALUATED).replace("SELECT DISTINCT kt FROM ml", f"SELECT DISTINCT {K} * 1000 + CAST(round(threshold * 100) AS INTEGER) AS kt FROM sg"),
    f"ob AS (SELECT kt // 1000 AS {K}, (kt % 1000) / 100.0::DOUBLE AS threshold, 0.7::DOUBLE * mean_best_gt_iou + 0.3::DOUBLE * f1 AS objective FROM ev3)",
])


def _scores(log: DataFrame) -> DataFrame:
    rows = temporal.smooth_rows(log.select(K, "row_idx", "raw_score"), {"p": "raw_score"}, W, KEYS).withColumn("p", F.round("p", 9))
    return thresholds.threshold_scores(rows, gt_of(log), GRID, KEYS, "p", GAP, MIN_LEN)


@query(sql(OBJECTIVE, f"SELECT {K}, {r('threshold', 'threshold')}, {r('objective', 'objective')} FROM ob", recursive=True))
def threshold_scores(spark, sf_dir):
    return _scores(machine_log(spark, sf_dir))


@query(sql(OBJECTIVE, FOLDS, f"SELECT test_session, {r('threshold', 'threshold')}, {r('q', 'train_objective')} FROM (SELECT *, row_number() OVER (PARTITION BY test_session ORDER BY q DESC, threshold) AS rn FROM (SELECT f.test_session, o.threshold, round(avg(o.objective), 9) AS q FROM folds f JOIN ob o ON o.{K} = f.train_session GROUP BY ALL)) WHERE rn = 1", recursive=True))
def select_threshold(spark, sf_dir):
    log = machine_log(spark, sf_dir)
    return thresholds.select_threshold(_scores(log), folds.loo_folds(log))


PRIOR = f"""ln AS (SELECT f.test_session, CAST(g.e - g.s + 1 AS DOUBLE) AS n FROM folds f JOIN gt g ON g.{K} = f.train_session),
prior0 AS (SELECT test_session, count(*) AS n_train_segments, min(n) AS lo, quantile_cont(n, [0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95]) AS q, avg(n) AS mean_len, stddev_pop(n) AS std_len FROM ln GROUP BY test_session),
prior AS (SELECT p.test_session, n_train_segments, greatest(1, CAST(trunc(lo) AS BIGINT)) AS min_len, {", ".join(f"greatest(1, CAST(trunc(q[{i}]) AS BIGINT)) AS {n}_len" for i, n in enumerate(["p5", "p10", "p25", "median", "p75", "p90", "p95"], 1))}, mean_len, std_len,
  n_train_segments / CAST((SELECT count(*) FROM folds f WHERE f.test_session = p.test_session) AS DOUBLE) AS mean_segment_count FROM prior0 p),
pr2 AS (SELECT *, CAST(greatest(18, floor(p10_len * CAST(0.45 AS DOUBLE))) AS BIGINT) AS min_allowed_len, CAST(greatest(median_len + 1, ceil(p90_len * CAST(1.85 AS DOUBLE))) AS BIGINT) AS max_allowed_len FROM prior)"""
PRIOR_COLUMNS = "test_session, n_train_segments, min_len, p5_len, p10_len, p25_len, median_len, p75_len, p90_len, p95_len, " + ", ".join(r(m, m) for m in ("mean_len", "std_len", "mean_segment_count")) + ", min_allowed_len, max_allowed_len"


@query(sql(GT, FOLDS, PRIOR, f"SELECT {PRIOR_COLUMNS} FROM pr2"))
def duration_prior(spark, sf_dir):
    log = machine_log(spark, sf_dir)
    return folds.duration_prior(gt_of(log), folds.loo_folds(log))


@query(sql(GT, FOLDS, PRIOR, f"SELECT {PRIOR_COLUMNS}, (SELECT string_agg(CAST(train_session AS VARCHAR), ', ' ORDER BY train_session) FROM folds f WHERE f.test_session = pr2.test_session) AS train_sessions FROM pr2"))
def duration_prior_by_fold(spark, sf_dir):
    log = machine_log(spark, sf_dir)
    pairs = folds.loo_folds(log)
    return folds.duration_prior_by_fold(folds.duration_prior(gt_of(log), pairs), pairs)


# ---- reports

ROWS = f"""mk AS (SELECT m.{K}, m.row_idx, m.production AS g, max(CASE WHEN p.s IS NULL THEN 0 ELSE 1 END) AS h FROM ml m LEFT JOIN pred p ON p.{K} = m.{K} AND m.row_idx BETWEEN p.s AND p.e GROUP BY ALL),
rm AS (SELECT {K}, avg(CAST(g = h AS INTEGER)) AS row_accuracy, coalesce(sum(g * h) / nullif(CAST(sum(h) AS DOUBLE), 0), 0.0) AS row_precision, coalesce(sum(g * h) / nullif(CAST(sum(g) AS DOUBLE), 0), 0.0) AS row_recall FROM mk GROUP BY {K}),
rm2 AS (SELECT *, CASE WHEN row_precision + row_recall > 0 THEN 2 * row_precision * row_recall / (row_precision + row_recall) ELSE 0.0 END AS row_f1 FROM rm)"""
AUC = f"""rank AS (SELECT {K}, production, rank() OVER (PARTITION BY {K} ORDER BY rs) + (count(*) OVER (PARTITION BY {K}, rs) - 1) / 2.0 AS k FROM (SELECT {K}, production, round(raw_score, 9) AS rs FROM ml)),
auc AS (SELECT {K}, (sum(CASE WHEN production = 1 THEN k END) - sum(production) * (sum(production) + 1) / 2.0) / nullif(CAST(sum(production) * sum(1 - production) AS DOUBLE), 0) AS row_auc FROM rank GROUP BY {K})"""
ROW_COLUMNS = ", ".join(r(m, m) for m in ("row_accuracy", "row_precision", "row_recall", "row_f1"))


def _lengths(log: DataFrame) -> DataFrame:
    return log.groupBy(K).agg(F.count("*").alias("n_rows"))


@query(sql(PRED, ROWS, f"SELECT {K}, {ROW_COLUMNS} FROM rm2"))
def row_metrics(spark, sf_dir):
    log, pred, gt, _ = sides(spark, sf_dir)
    return report.row_metrics(pred, gt, _lengths(log), KEYS)


def _auc(log: DataFrame) -> DataFrame:
    return report.row_auc(log.withColumn("rs", F.round("raw_score", 9)), "rs", "production", KEYS)


@query(sql(AUC, f"SELECT {K}, {r('row_auc', 'row_auc')} FROM auc"))
def row_auc(spark, sf_dir):
    return _auc(machine_log(spark, sf_dir))


@query(sql(PRED, GT, PAIRS, MATCHED, BEST, EVALUATED, f"SELECT {K}, n_pred, n_gt, n_pred - n_gt AS count_error, abs(n_pred - n_gt) AS count_abs_error FROM ev3", recursive=True))
def count_error(spark, sf_dir):
    _, pred, gt, groups = sides(spark, sf_dir)
    return report.count_error(matching.evaluate_segments(pred, gt, groups, KEYS)).select(K, "n_pred", "n_gt", "count_error", "count_abs_error")


SUMMARY = ",\n".join([
    PRED, GT, PAIRS, MATCHED, BEST, EVALUATED, ROWS, AUC,
    f"er AS (SELECT {K}, avg(abs(ps - gs)) AS a, avg(abs(pe - ge)) AS b FROM best GROUP BY {K})", f"tg AS ({_text('gt', 'gt_intervals')})", f"tp AS ({_text('pred', 'pred_intervals')})",
    f"su AS (SELECT * EXCLUDE (a, b), a AS mean_start_abs_error, b AS mean_end_abs_error, n_pred - n_gt AS count_error, abs(n_pred - n_gt) AS count_abs_error FROM ev3 LEFT JOIN rm2 USING ({K}) LEFT JOIN auc USING ({K}) LEFT JOIN er USING ({K}) LEFT JOIN tg USING ({K}) LEFT JOIN tp USING ({K}))",
])
SUMMARY_COLUMNS = EV_COLUMNS + f", count_error, count_abs_error, {ROW_COLUMNS}, {r('row_auc', 'row_auc')}, {r('mean_start_abs_error', 'mean_start_abs_error')}, {r('mean_end_abs_error', 'mean_end_abs_error')}, gt_intervals, pred_intervals"


def summary_of(log: DataFrame, pred: DataFrame, gt: DataFrame, groups: DataFrame) -> DataFrame:
    return report.fold_summary(
        matching.evaluate_segments(pred, gt, groups, KEYS), report.row_metrics(pred, gt, _lengths(log), KEYS), _auc(log), matching.boundary_errors(pred, gt, KEYS),
        intervals.interval_text(gt, groups, KEYS, "gt_intervals"), intervals.interval_text(pred, groups, KEYS, "pred_intervals"), KEYS,
    )


@query(sql(SUMMARY, f"SELECT {SUMMARY_COLUMNS} FROM su", recursive=True))
def fold_summary(spark, sf_dir):
    return summary_of(*sides(spark, sf_dir))


OVERALL = ["precision", "recall", "f1", "row_auc", "count_abs_error"]


@query(sql(SUMMARY, " UNION ALL ".join(f"SELECT '{m}' AS metric, {r(f'avg({m})', 'mean')}, {r(f'stddev_samp({m})', 'std')}, {r(f'min({m})', 'min')}, {r(f'quantile_cont(CAST({m} AS DOUBLE), 0.5)', 'median')}, {r(f'max({m})', 'max')} FROM su" for m in OVERALL), recursive=True))
def overall_metrics(spark, sf_dir):
    return report.overall_metrics(summary_of(*sides(spark, sf_dir)), OVERALL)


def _experiments(spark, sf_dir):
    """Two experiments: the score itself, and a coarser threshold."""
    log, pred, gt, groups = sides(spark, sf_dir)
    other = Scratch(spark, "sides").stored(intervals.prob_to_segments(log, "raw_score", 0.6, KEYS, W, GAP, MIN_LEN))
    one = matching.evaluate_segments(pred, gt, groups, KEYS).withColumn("experiment", F.lit("t50"))
    return [one, matching.evaluate_segments(other, gt, groups, KEYS).withColumn("experiment", F.lit("t60"))]


def _two_experiments(last: str) -> str:
    second = ",\n".join([PRED, GT, PAIRS, MATCHED, BEST, EVALUATED]).replace(f"p >= {THRESHOLD}", "p >= 0.6")
    for name in ("sm", "pr", "pm", "pf", "pred", "gr", "gt", "pairs", "ranked", "walk", "matched", "best", "ev", "ev2", "ev3"):
        import re

        second = re.sub(rf"(?<![\w.]){name}(?=( AS \(| [a-z]+ |\)|$|\n| WHERE| USING| GROUP| JOIN| LEFT| x | w ))(?! AS BIGINT)", f"{name}_b", second)
    return sql(PRED, GT, PAIRS, MATCHED, BEST, EVALUATED, second, last, recursive=True)


BOTH = "(SELECT *, 't50' AS experiment FROM ev3 UNION ALL SELECT *, 't60' AS experiment FROM ev3_b)"


@query(_two_experiments(f"SELECT {EV_COLUMNS}, experiment FROM {BOTH}"))
def all_folds(spark, sf_dir):
    return report.all_folds(_experiments(spark, sf_dir))


COMPARED = ["precision", "recall", "f1", "matched_mean_iou", "mean_best_gt_iou", "best_any_iou"]


@query(_two_experiments(f"SELECT experiment, {', '.join(r(f'avg({m})', f'mean_{m}') for m in COMPARED)} FROM {BOTH} GROUP BY experiment"))
def experiment_comparison(spark, sf_dir):
    return report.experiment_comparison(report.all_folds(_experiments(spark, sf_dir)), COMPARED)
