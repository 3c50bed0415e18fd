"""Registered queries of the second stage, on rows without production: signals, candidates, clusters, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runline import config
from runline.config import Stage2
from runline.jobs import workflows
from runline.jobs.phase_chain import BLOB_KEYS, PhaseChain
from runline.jobs.stage_one import BEST, EVALUATED, MATCHED, PAIRS, frame, long_only, merged, r, rounded, runs
from runline.operators import boundary, candidates, clean, clusters, intervals
from runline.sources.machine_log import SQL, machine_log, study_log
from runline.sources.scratch import Scratch

K = "session_id"
KEYS = [K]
W, GAP, MIN_LEN, THRESHOLDS = 15, 3, 4, [0.5, 0.35]
BRANCHES = {"program": (["program_status", "tool_number"], 0.65), "physical": (["feed_rate", "spindle_speed"], 0.25), "program_physical": (["program_status", "tool_number", "feed_rate", "spindle_speed"], 0.45)}
QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir, f=f: rounded(f(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- the fixture, in Spark and in SQL

M2 = f"""m2 AS (SELECT {K}, row_idx AS original_row, row_number() OVER (PARTITION BY {K} ORDER BY row_idx) - 1 AS row_idx, ts, phase, feed_rate, spindle_speed, CAST(tool_number AS DOUBLE) AS tool_number, CAST(program_status AS DOUBLE) AS program_status,
 CAST((event_id * 37) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) * CAST(0.4 AS DOUBLE) + CASE WHEN phase = 2 THEN CAST(0.45 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END AS program,
 CAST((event_id * 53) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) * CAST(0.5 AS DOUBLE) + CASE WHEN phase = 2 THEN CAST(0.35 AS DOUBLE) ELSE CAST(0.15 AS DOUBLE) END AS physical
 FROM ml WHERE phase <> 5),
m3 AS (SELECT *, (program + physical) / 2 AS program_physical, count(*) OVER (PARTITION BY {K}) AS n_rows FROM m2)"""


def fixture(spark, sf_dir) -> DataFrame:
    """Rows of all sessions without production, with a stand-in probability per branch."""
    c = F.col
    rows = clean.remove_production(machine_log(spark, sf_dir), [1, 2, 3, 4, 6], KEYS).withColumn("row_idx", c("removed_row"))

    def prob(k: int, spread: float, high: float, low: float):
        return ((c("event_id") * k) % 100).cast("double") / F.lit(100.0) * F.lit(spread) + F.when(c("phase") == 2, high).otherwise(low)

    rows = rows.withColumns({"program": prob(37, 0.4, 0.45, 0.1), "physical": prob(53, 0.5, 0.35, 0.15)}).withColumn("program_physical", (c("program") + c("physical")) / 2)
    return rows.withColumns({"tool_number": c("tool_number").cast("double"), "program_status": c("program_status").cast("double")})


def norm(x: str, by: str = K) -> str:
    w = f"OVER (PARTITION BY {by})"
    return f"CASE WHEN max({x}) {w} > min({x}) {w} THEN ({x} - min({x}) {w}) / (max({x}) {w} - min({x}) {w}) ELSE 0.0 END"


def signal_sql(name: str, branch: str) -> str:
    sensors, j = BRANCHES[branch]
    order = f"OVER (PARTITION BY {K} ORDER BY row_idx)"
    steps = ", ".join(f"coalesce(abs({c} - lag({c}) {order}), 0.0) AS d_{c}, coalesce(CAST(CAST({c} <> lag({c}) {order} AS INTEGER) AS DOUBLE), 0.0) AS j_{c}" for c in sensors)
    means = ", ".join(f"avg(d_{c}) OVER ({frame(9)}) AS d_{c}, j_{c}" for c in sensors)
    total = " + ".join(f"CAST({1 - j} AS DOUBLE) * ({norm(f'd_{c}')}) + CAST({j} AS DOUBLE) * ({norm(f'j_{c}')})" for c in sensors)
    return f"""{name}1 AS (SELECT {K}, row_idx, {steps} FROM m3), {name}2 AS (SELECT {K}, row_idx, {means} FROM {name}1), {name}3 AS (SELECT {K}, row_idx, {total} AS t FROM {name}2),
{name}4 AS (SELECT {K}, row_idx, avg(t) OVER ({frame(7)}) AS t FROM {name}3), {name} AS (SELECT {K}, row_idx, {norm('t')} AS boundary FROM {name}4)"""


SIGNALS = ",\n".join([signal_sql("bp", "program"), signal_sql("bq", "physical"), signal_sql("bb", "program_physical"),
    f"g0 AS (SELECT {K}, row_idx, CAST(0.55 AS DOUBLE) * p.boundary + CAST(0.45 AS DOUBLE) * q.boundary AS t FROM bp p JOIN bq q USING ({K}, row_idx)), gs AS (SELECT {K}, row_idx, {norm('t')} AS boundary FROM g0)"])
SUPPORT = f"""t0 AS (SELECT {K}, row_idx, CAST(0.40 AS DOUBLE) * ({norm('program')}) + CAST(0.25 AS DOUBLE) * ({norm('physical')}) + CAST(0.35 AS DOUBLE) * ({norm('program_physical')}) AS t FROM m3),
t1 AS (SELECT {K}, row_idx, avg(t) OVER ({frame(21)}) AS t FROM t0), tr AS (SELECT {K}, row_idx, {norm('t')} AS support FROM t1)"""
PRIOR = f"""{runs('gr', 'm3', 'phase = 2')},
s AS (SELECT DISTINCT {K} FROM m3), fo AS (SELECT a.{K}, b.{K} AS train FROM s a JOIN s b ON a.{K} <> b.{K}),
ln AS (SELECT fo.{K}, CAST(g.e - g.s + 1 AS DOUBLE) AS n FROM fo JOIN gr g ON g.{K} = fo.train),
p0 AS (SELECT {K}, quantile_cont(n, [0.10, 0.50, 0.90]) AS q FROM ln GROUP BY {K}),
p1 AS (SELECT {K}, greatest(1, CAST(trunc(q[1]) AS BIGINT)) AS p10, greatest(1, CAST(trunc(q[2]) AS BIGINT)) AS median_len, greatest(1, CAST(trunc(q[3]) AS BIGINT)) AS p90 FROM p0),
prior AS (SELECT {K}, median_len, CAST(greatest(18, floor(p10 * CAST(0.45 AS DOUBLE))) AS BIGINT) AS min_allowed_len, CAST(greatest(median_len + 1, ceil(p90 * CAST(1.85 AS DOUBLE))) AS BIGINT) AS max_allowed_len FROM p1)"""
KB = f"{K}, branch, threshold"
BLOB = "branch, threshold, s, e"
#: Blobs of all branches and thresholds.
BLOBS = ",\n".join([
    "pb AS (" + " UNION ALL ".join(f"SELECT {K}, row_idx, '{b}' AS branch, {i} AS bno, round(avg({b}) OVER ({frame(W)}), 9) AS p FROM m3" for i, b in enumerate(BRANCHES)) + ")",
    "pg AS (SELECT pb.*, t.threshold FROM pb CROSS JOIN (SELECT CAST(unnest([0.5, 0.35]) AS DOUBLE) AS threshold) t)",
    runs("b1", "pg", "p >= threshold", KB), merged("b2", "b1", GAP, KB), long_only("b3", "b2", MIN_LEN),
    f"bs AS (SELECT {K}, row_idx, branch, round(boundary, 9) AS boundary FROM (SELECT *, 'program' AS branch FROM bp UNION ALL SELECT *, 'physical' FROM bq UNION ALL SELECT *, 'program_physical' FROM bb))",
    f"b4 AS (SELECT b.*, q.median_len, q.min_allowed_len, q.max_allowed_len, b.e - b.s + 1 AS n FROM b3 b JOIN prior q USING ({K}))",
])
#: Places where long blobs may be cut: the top of the signal, and the best row near each evenly spaced anchor.
POINTS = f"""x0 AS (SELECT b.*, x.row_idx AS i, x.boundary AS v FROM b4 b JOIN bs x ON x.{K} = b.{K} AND x.branch = b.branch AND x.row_idx BETWEEN b.s AND b.e WHERE n >= max_allowed_len),
x1 AS (SELECT {K}, {BLOB}, quantile_cont(v, 0.88) AS q FROM x0 GROUP BY ALL),
x2 AS (SELECT *, n * a / CAST(k AS DOUBLE) AS t FROM (SELECT *, unnest(range(1, k)) AS a FROM (SELECT *, CAST(least(greatest(round_even(n / CAST(median_len AS DOUBLE), 0), 1), 31) AS BIGINT) AS k FROM b4 WHERE n >= max_allowed_len))),
x3 AS (SELECT {K}, {BLOB}, a, greatest(0, CAST(round_even(t, 0) AS BIGINT) - median_len // 2) AS lo, least(n - 1, CAST(round_even(t, 0) AS BIGINT) + median_len // 2) AS hi FROM x2),
x4 AS (SELECT x0.*, row_number() OVER (PARTITION BY x0.{K}, x0.branch, x0.threshold, x0.s, x0.e, a ORDER BY v DESC, i) AS rn FROM x3 JOIN x0 USING ({K}, {BLOB}) WHERE hi > lo AND i - s BETWEEN lo AND hi),
x5 AS (SELECT {K}, {BLOB}, i, v, median_len, min_allowed_len, max_allowed_len FROM x0 JOIN x1 USING ({K}, {BLOB}) WHERE v >= q - 1e-12 UNION SELECT {K}, {BLOB}, i, v, median_len, min_allowed_len, max_allowed_len FROM x4 WHERE rn = 1),
pt AS (SELECT *, row_number() OVER (PARTITION BY {K}, {BLOB} ORDER BY v DESC, i DESC) AS k FROM x5 WHERE i - s + 1 >= min_allowed_len AND e - i >= min_allowed_len)"""
#: The points by rank, walked with the list of cuts. Cuts keep the least length apart, so no piece is too short.
CUTS = f"""lb AS (SELECT *, greatest(want + 1, CAST(ceil(want * CAST(1.35 AS DOUBLE)) AS BIGINT)) AS most FROM (SELECT *, greatest(1, CAST(round_even(n / CAST(median_len AS DOUBLE), 0) AS BIGINT)) AS want FROM b4 WHERE n > max_allowed_len)),
sw AS (SELECT {K}, {BLOB}, min_allowed_len AS low, most, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS cuts FROM lb
 UNION ALL
 SELECT w.{K}, w.branch, w.threshold, w.s, w.e, w.low, w.most, x.k, CASE WHEN x.v >= 0.40 AND len(w.cuts) < 30 AND len(w.cuts) + 2 <= w.most AND len(list_filter(w.cuts, lambda t: abs(t - x.i) < w.low)) = 0 THEN list_append(w.cuts, x.i) ELSE w.cuts END
 FROM sw w JOIN pt x ON x.{K} = w.{K} AND x.branch = w.branch AND x.threshold = w.threshold AND x.s = w.s AND x.e = w.e AND x.k = w.k + 1 WHERE x.k <= 90),
ed AS (SELECT {K}, {BLOB}, list_concat([s - 1], list_sort(max_by(cuts, k)), [e]) AS edges FROM sw GROUP BY {K}, {BLOB}
 UNION ALL SELECT {K}, {BLOB}, [s - 1, e] FROM b4 WHERE n <= max_allowed_len),
pc AS (SELECT {K}, branch, threshold, s AS blob_start, e AS blob_end, edges[j] + 1 AS s, edges[j + 1] AS e FROM (SELECT *, unnest(range(1, len(edges))) AS j FROM ed))"""
#: The pieces as candidates, with their confidence from dense means.
POOL = ",\n".join([
    BLOBS, POINTS, CUTS,
    f"""pool0 AS (SELECT b.{K}, b.branch, b.threshold, b.s, b.e, b.e - b.s + 1 AS length, (b.s + b.e) / CAST(2 AS DOUBLE) AS center, q.median_len, q.min_allowed_len, q.max_allowed_len,
 (SELECT avg(p) FROM pb WHERE pb.{K} = b.{K} AND pb.branch = b.branch AND pb.row_idx BETWEEN b.s AND b.e) AS mp,
 (SELECT sum(CASE WHEN x.row_idx = b.s THEN x.boundary ELSE 0.0 END) + sum(CASE WHEN x.row_idx = b.e THEN x.boundary ELSE 0.0 END) FROM bs x WHERE x.{K} = b.{K} AND x.branch = b.branch) AS be FROM pc b JOIN prior q USING ({K}))""",
    f"""pool AS (SELECT *, CAST(0.58 AS DOUBLE) * mp + CAST(0.32 AS DOUBLE) * be / 2 + CAST(0.10 AS DOUBLE) * (1 - least(1.0, abs(length - median_len) / CAST(median_len AS DOUBLE))) AS confidence,
 row_number() OVER (PARTITION BY {K} ORDER BY CASE branch WHEN 'program' THEN 0 WHEN 'physical' THEN 1 ELSE 2 END, threshold DESC, s) AS ord FROM pool0)""",
    f"""scored AS (SELECT *, {norm('confidence')} AS confidence_norm, 1 / (1 + abs(length - median_len) / CAST(median_len AS DOUBLE)) AS duration_fit FROM pool), nm AS (SELECT *, CAST(0.78 AS DOUBLE) * confidence_norm + CAST(0.22 AS DOUBLE) * duration_fit AS nms_score FROM scored)""",
])
IOU = "CASE WHEN least(t.e, x.e) >= greatest(t.s, x.s) THEN (least(t.e, x.e) - greatest(t.s, x.s) + 1) / CAST(t.e - t.s + 1 + x.e - x.s + 1 - (least(t.e, x.e) - greatest(t.s, x.s) + 1) AS DOUBLE) ELSE 0.0 END"
#: The whole list by score, walked with the list of what is kept.
NMS = f"""nr AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY nms_score DESC, ord) AS rn FROM nm),
nw AS (SELECT DISTINCT {K}, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(s BIGINT, e BIGINT)[]) AS kept, CAST(NULL AS BOOLEAN) AS take FROM nr
 UNION ALL
 SELECT {K}, rn, CASE WHEN take THEN list_append(kept, {{'s': s, 'e': e}}) ELSE kept END, take FROM (
  SELECT w.{K}, x.rn, x.s, x.e, w.kept, len(list_filter(w.kept, lambda t: {IOU} >= 0.88)) = 0 AS take FROM nw w JOIN nr x ON w.{K} = x.{K} AND x.rn = w.rn + 1)),
kept AS (SELECT x.* FROM nr x JOIN nw w ON x.{K} = w.{K} AND x.rn = w.rn WHERE w.take)"""
CLUSTERS = f"""cr AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY center, ord) AS cn FROM kept),
cw AS (SELECT {K}, cn, center AS total, 1 AS n, 1 AS cluster_id FROM cr WHERE cn = 1
 UNION ALL
 SELECT w.{K}, x.cn, CASE WHEN abs(x.center - w.total / w.n) <= greatest(8, CAST(trunc(x.median_len * CAST(0.70 AS DOUBLE)) AS BIGINT)) THEN w.total + x.center ELSE x.center END,
  CASE WHEN abs(x.center - w.total / w.n) <= greatest(8, CAST(trunc(x.median_len * CAST(0.70 AS DOUBLE)) AS BIGINT)) THEN w.n + 1 ELSE 1 END,
  CASE WHEN abs(x.center - w.total / w.n) <= greatest(8, CAST(trunc(x.median_len * CAST(0.70 AS DOUBLE)) AS BIGINT)) THEN w.cluster_id ELSE w.cluster_id + 1 END
 FROM cw w JOIN cr x ON w.{K} = x.{K} AND x.cn = w.cn + 1),
mb AS (SELECT x.*, w.cluster_id FROM cr x JOIN cw w ON x.{K} = w.{K} AND x.cn = w.cn),
cs AS (SELECT {K}, cluster_id, count(*) AS n_members, string_agg(DISTINCT branch, ',' ORDER BY branch) AS branches, count(DISTINCT branch) AS branch_diversity, sum(center * greatest(confidence, 1e-6)) / sum(greatest(confidence, 1e-6)) AS center_mean,
 CAST(trunc(quantile_cont(s, 0.5)) AS BIGINT) AS start_median, CAST(trunc(quantile_cont(e, 0.5)) AS BIGINT) AS end_median, sum(confidence) AS total_confidence, avg(confidence) AS mean_confidence, max(median_len) AS median_len, max(min_allowed_len) AS min_allowed_len, max(max_allowed_len) AS max_allowed_len FROM mb GROUP BY {K}, cluster_id),
cs2 AS (SELECT *, total_confidence * (1 + CAST(0.12 AS DOUBLE) * (branch_diversity - 1)) + CAST(0.15 AS DOUBLE) * mean_confidence AS score FROM cs)"""
#: Votes of every cluster on every row.
VOTES = f"""vr AS (SELECT *, greatest(5, CAST(trunc(median_len * CAST(0.35 AS DOUBLE)) AS BIGINT)) AS rad FROM mb),
dv AS (SELECT c.{K}, c.cluster_id, m.row_idx,
 coalesce((SELECT sum(greatest(1e-6, v.confidence * v.confidence) * exp(-0.5 * power((m.row_idx - v.s) / greatest(1.0, v.rad / CAST(2 AS DOUBLE)), 2))) FROM vr v WHERE v.{K} = c.{K} AND v.cluster_id = c.cluster_id AND abs(m.row_idx - v.s) <= v.rad), 0.0) AS sv,
 coalesce((SELECT sum(greatest(1e-6, v.confidence * v.confidence) * exp(-0.5 * power((m.row_idx - v.e) / greatest(1.0, v.rad / CAST(2 AS DOUBLE)), 2))) FROM vr v WHERE v.{K} = c.{K} AND v.cluster_id = c.cluster_id AND abs(m.row_idx - v.e) <= v.rad), 0.0) AS ev
 FROM cs2 c JOIN m3 m USING ({K}))"""


def sql(*parts: str) -> str:
    *ctes, last = parts
    return f"WITH RECURSIVE {SQL},\n{M2},\n" + ",\n".join(ctes) + ("" if not ctes else "\n") + last if ctes else f"WITH {SQL},\n{M2}\n{last}"


VOTED = f"""nv AS (SELECT {K}, cluster_id, row_idx, {norm('sv', f'{K}, cluster_id')} AS sv, {norm('ev', f'{K}, cluster_id')} AS ev FROM dv),
tv AS (SELECT v.{K}, v.cluster_id, v.row_idx, round(CAST(0.72 AS DOUBLE) * sv + CAST(0.28 AS DOUBLE) * g.boundary, 12) AS sv, round(CAST(0.72 AS DOUBLE) * ev + CAST(0.28 AS DOUBLE) * g.boundary, 12) AS ev,
 c.start_median, c.end_median, greatest(greatest(5, CAST(trunc(c.median_len * CAST(0.35 AS DOUBLE)) AS BIGINT)), CAST(trunc(c.median_len * CAST(0.75 AS DOUBLE)) AS BIGINT)) AS reach
 FROM nv v JOIN gs g USING ({K}, row_idx) JOIN cs2 c USING ({K}, cluster_id)),
a1 AS (SELECT {K}, cluster_id, row_idx AS s FROM (SELECT *, row_number() OVER (PARTITION BY {K}, cluster_id ORDER BY sv DESC, row_idx) AS rn FROM tv WHERE abs(row_idx - start_median) <= reach) WHERE rn = 1),
a2 AS (SELECT {K}, cluster_id, row_idx AS e FROM (SELECT *, row_number() OVER (PARTITION BY {K}, cluster_id ORDER BY ev DESC, row_idx) AS rn FROM tv WHERE abs(row_idx - end_median) <= reach) WHERE rn = 1),
w1 AS (SELECT c.*, m.n_rows, CASE WHEN e <= s THEN start_median ELSE s END AS s, CASE WHEN e <= s THEN end_median ELSE e END AS e FROM cs2 c JOIN a1 USING ({K}, cluster_id) JOIN a2 USING ({K}, cluster_id) JOIN (SELECT DISTINCT {K}, n_rows FROM m3) m USING ({K})),
w2 AS (SELECT * EXCLUDE (s, e), CASE WHEN e - s + 1 < min_allowed_len THEN greatest(0, CAST(round_even(round(center_mean, 9), 0) AS BIGINT) - min_allowed_len // 2) ELSE s END AS s, s AS s0, e AS e0 FROM w1),
w3 AS (SELECT * EXCLUDE (s0, e0), CASE WHEN e0 - s0 + 1 < min_allowed_len THEN least(n_rows - 1, s + min_allowed_len - 1) ELSE e0 END AS e FROM w2),
w4 AS (SELECT * EXCLUDE (s, e), CASE WHEN e - s + 1 > max_allowed_len THEN greatest(0, CAST(round_even(round(center_mean, 9), 0) AS BIGINT) - max_allowed_len // 2) ELSE s END AS s, s AS s0, e AS e0 FROM w3),
vb AS (SELECT * EXCLUDE (s0, e0), CASE WHEN e0 - s0 + 1 > max_allowed_len THEN least(n_rows - 1, s + max_allowed_len - 1) ELSE e0 END AS e FROM w4)"""
def _h(p: str) -> str:
    q = f"least(greatest({p}, 1e-9), 1 - 1e-9)"
    return f"(-({q} * log2({q}) + (1 - {q}) * log2(1 - {q})))"


def gain_sql(src: str) -> str:
    """Means over all rows of each part."""
    return f"""cx AS (SELECT {K}, cluster_id, s, e, greatest(0, s - greatest(10, CAST(round_even(0.5 * median_len, 0) AS BIGINT))) AS lo, least(n_rows - 1, e + greatest(10, CAST(round_even(0.5 * median_len, 0) AS BIGINT))) AS hi FROM {src}),
pa AS (SELECT c.{K}, c.cluster_id, avg(support) AS a, avg(support) FILTER (row_idx BETWEEN s AND e) AS i, avg(support) FILTER (row_idx NOT BETWEEN s AND e) AS o, count(*) AS n, count(*) FILTER (row_idx BETWEEN s AND e) AS ni FROM cx c JOIN tr USING ({K}) WHERE row_idx BETWEEN lo AND hi GROUP BY ALL),
eg AS (SELECT {K}, cluster_id, CASE WHEN n < 3 OR n = ni THEN 0.0 ELSE greatest(0.0, {_h('a')} - ni / CAST(n AS DOUBLE) * {_h('i')} - (n - ni) / CAST(n AS DOUBLE) * {_h('o')}) END AS entropy_gain FROM pa)"""


def features_sql(src: str) -> str:
    return f"""fe AS (SELECT c.*, c.e - c.s + 1 AS length, 1 / (1 + abs(c.e - c.s + 1 - c.median_len) / CAST(c.median_len AS DOUBLE)) AS duration_fit, x.internal_boundary, x.internal_prob, x.boundary_support, x.prob_support, eg.entropy_gain FROM {src} c JOIN (
 SELECT v.{K}, v.cluster_id, avg(boundary) AS internal_boundary, avg(support) AS internal_prob, (sum(boundary) FILTER (row_idx = s) + sum(boundary) FILTER (row_idx = e)) / 2 AS boundary_support, (sum(support) FILTER (row_idx = s) + sum(support) FILTER (row_idx = e)) / 2 AS prob_support
 FROM {src} v JOIN gs USING ({K}) JOIN tr USING ({K}, row_idx) WHERE row_idx BETWEEN s AND e GROUP BY ALL) x USING ({K}, cluster_id) JOIN eg USING ({K}, cluster_id))"""


FEATURE_NAMES = ["duration_fit", "boundary_support", "internal_boundary", "prob_support", "internal_prob", "entropy_gain"]
#: All pairs of ends near the voted ones; sums of the support between them from a running sum.
REFINED = f"""ps AS (SELECT {K}, row_idx, g.boundary, sum(support) OVER (PARTITION BY {K} ORDER BY row_idx) AS t FROM tr JOIN gs g USING ({K}, row_idx)),
r0 AS (SELECT {K}, cluster_id, s, e, n_rows, median_len, min_allowed_len, max_allowed_len, greatest(10, CAST(round_even(0.5 * median_len, 0) AS BIGINT)) AS around FROM vb),
r1 AS (SELECT *, unnest(range(greatest(0, s - 50), least(n_rows - 1, s + 50) + 1)) AS a FROM r0), r2 AS (SELECT *, unnest(range(greatest(0, e - 50), least(n_rows - 1, e + 50) + 1)) AS b FROM r1),
r3 AS (SELECT *, b - a + 1 AS n, greatest(0, a - around) AS lo, least(n_rows - 1, b + around) AS hi FROM r2 WHERE b - a + 1 BETWEEN greatest(1, min_allowed_len) AND greatest(min_allowed_len, max_allowed_len)),
r4 AS (SELECT r3.*, pa.boundary AS ba, pe.boundary AS bb, pe.t - coalesce(pz.t, 0.0) AS inside, ph.t - coalesce(pl.t, 0.0) AS whole, hi - lo + 1 AS m FROM r3
 JOIN ps pa ON pa.{K} = r3.{K} AND pa.row_idx = a JOIN ps pe ON pe.{K} = r3.{K} AND pe.row_idx = b JOIN ps ph ON ph.{K} = r3.{K} AND ph.row_idx = hi
 LEFT JOIN ps pz ON pz.{K} = r3.{K} AND pz.row_idx = a - 1 LEFT JOIN ps pl ON pl.{K} = r3.{K} AND pl.row_idx = lo - 1),
r5 AS (SELECT *, round(CAST(0.45 AS DOUBLE) * CASE WHEN m < 3 OR m = n THEN 0.0 ELSE greatest(0.0, {_h('whole / m')} - n / CAST(m AS DOUBLE) * {_h('inside / n')} - (m - n) / CAST(m AS DOUBLE) * {_h('(whole - inside) / greatest(m - n, 1)')}) END
 + CAST(0.35 AS DOUBLE) * (ba + bb) / 2 + CAST(0.20 AS DOUBLE) * inside / n, 12) AS score FROM r4),
r6 AS (SELECT {K}, cluster_id, a, b FROM (SELECT *, row_number() OVER (PARTITION BY {K}, cluster_id ORDER BY score DESC, CASE WHEN a = s AND b = e THEN 0 ELSE 1 END, a, b) AS rn FROM r5) WHERE rn = 1),
rv AS (SELECT v.* REPLACE (coalesce(r6.a, v.s) AS s, coalesce(r6.b, v.e) AS e) FROM vb v LEFT JOIN r6 USING ({K}, cluster_id))"""
TRACKS = f"""vt AS (SELECT {K}, row_idx, sum(greatest(1e-6, c.score) * (CAST(0.72 AS DOUBLE) * v.sv + CAST(0.28 AS DOUBLE) * g.boundary)) AS a, sum(greatest(1e-6, c.score) * (CAST(0.72 AS DOUBLE) * v.ev + CAST(0.28 AS DOUBLE) * g.boundary)) AS b FROM nv v JOIN gs g USING ({K}, row_idx) JOIN cs2 c USING ({K}, cluster_id) GROUP BY {K}, row_idx),
vn AS (SELECT {K}, row_idx, {norm('a')} AS start_vote, {norm('b')} AS end_vote FROM vt)"""
CHAIN = (SIGNALS, SUPPORT, PRIOR, POOL, NMS, CLUSTERS, VOTES, VOTED, REFINED, gain_sql("rv"), features_sql("rv"))
RANKED = f"rk AS (SELECT *, 0.75::DOUBLE * cluster_score_norm + 0.25::DOUBLE * entropy_gain_norm AS rank_score FROM (SELECT *, {norm('score')} AS cluster_score_norm, {norm('entropy_gain')} AS entropy_gain_norm FROM fe))"
#: The whole list by rank, walked with the list of what is kept; then again for folds that are short of the least count.
FINAL = f"""tn AS (SELECT fo.{K}, CAST(round_even(avg(coalesce(n, 0)), 0) AS BIGINT) AS target FROM fo LEFT JOIN (SELECT {K} AS train, count(*) AS n FROM gr GROUP BY ALL) USING (train) GROUP BY ALL),
tg AS (SELECT *, greatest(low, CAST(ceil(target * CAST(1.55 AS DOUBLE)) AS BIGINT)) AS high FROM (SELECT *, greatest(1, CAST(floor(target * CAST(0.75 AS DOUBLE)) AS BIGINT)) AS low FROM tn)),
rr AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY rank_score DESC, cluster_id) AS rn FROM rk JOIN tg USING ({K})),
f1 AS (SELECT DISTINCT {K}, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(s BIGINT, e BIGINT)[]) AS kept, CAST([] AS BIGINT[]) AS ids, low FROM rr
 UNION ALL
 SELECT {K}, rn, CASE WHEN take THEN list_append(kept, {{'s': s, 'e': e}}) ELSE kept END, CASE WHEN take THEN list_append(ids, cluster_id) ELSE ids END, low FROM (
  SELECT w.{K}, x.rn, x.s, x.e, x.cluster_id, w.kept, w.ids, w.low, len(w.kept) < x.high AND len(list_filter(w.kept, lambda t: {IOU} > 0.55)) = 0 AS take FROM f1 w JOIN rr x ON w.{K} = x.{K} AND x.rn = w.rn + 1)),
fa AS (SELECT {K}, arg_max(kept, rn) AS kept, arg_max(ids, rn) AS ids, any_value(low) AS low FROM f1 GROUP BY {K}),
f2 AS (SELECT {K}, CAST(0 AS BIGINT) AS rn, kept, ids, low FROM fa
 UNION ALL
 SELECT {K}, rn, CASE WHEN take THEN list_append(kept, {{'s': s, 'e': e}}) ELSE kept END, CASE WHEN take THEN list_append(ids, cluster_id) ELSE ids END, low FROM (
  SELECT w.{K}, x.rn, x.s, x.e, x.cluster_id, w.kept, w.ids, w.low, len(w.kept) < w.low AND len(list_filter(w.kept, lambda t: {IOU} > 0.75 OR (t.s = x.s AND t.e = x.e))) = 0 AS take FROM f2 w JOIN rr x ON w.{K} = x.{K} AND x.rn = w.rn + 1)),
fb AS (SELECT {K}, unnest(arg_max(ids, rn)) AS cluster_id FROM f2 GROUP BY {K}),
fin AS (SELECT rr.*, row_number() OVER (PARTITION BY {K} ORDER BY s, e, cluster_id) AS segment_no FROM rr JOIN fb USING ({K}, cluster_id))"""


FIXTURE = Stage2(windows=(5, W), smooth=W, merge_gap=GAP, min_len=MIN_LEN, blob_thresholds=tuple(THRESHOLDS))


def chain_of(spark, sf_dir: str) -> PhaseChain:
    return PhaseChain(Scratch(spark, "stage-two"), fixture(spark, sf_dir), BRANCHES, FIXTURE)


# ---- queries


@query(sql(SIGNALS, " UNION ALL ".join(f"SELECT {K}, row_idx, {r('boundary', 'boundary')}, '{b}' AS branch FROM {n}" for n, b in (("bp", "program"), ("bq", "physical"), ("bb", "program_physical")))))
def branch_boundary_signal(spark, sf_dir):
    return chain_of(spark, sf_dir).signals


@query(sql(SIGNALS, f"SELECT {K}, row_idx, {r('boundary', 'boundary')} FROM gs"))
def global_boundary_signal(spark, sf_dir):
    chain = chain_of(spark, sf_dir)
    return boundary.global_boundary_signal(chain.signal("program"), chain.signal("physical"), KEYS)


@query(sql(SUPPORT, f"SELECT {K}, row_idx, {r('support', 'support')} FROM tr"))
def probability_support_track(spark, sf_dir):
    return boundary.probability_support_track(chain_of(spark, sf_dir).rows, *BRANCHES, KEYS)


@query(sql(SIGNALS, PRIOR, BLOBS, POINTS, f"SELECT {K}, branch, {r('threshold', 'threshold')}, s AS start, e AS \"end\", i AS idx, {r('v', 'score')}, k AS rank FROM pt"))
def candidate_split_points(spark, sf_dir):
    return chain_of(spark, sf_dir).points


@query(sql(SIGNALS, PRIOR, BLOBS, POINTS, CUTS, f"SELECT {K}, branch, {r('threshold', 'threshold')}, blob_start, blob_end, s AS start, e AS \"end\" FROM pc"))
def split_blob(spark, sf_dir):
    """Cut blobs, short pieces merged."""
    chain = chain_of(spark, sf_dir)
    return candidates.split_blob(chain.blobs, chain.points, BLOB_KEYS).drop(*candidates.PRIOR)


#: Runs of one tool are pieces of a session; those of fewer than 3 rows join a neighbour. The whole list, walked as a list.
PIECES = f"""mq AS (SELECT {K}, list({{'s': s, 'e': e}} ORDER BY s) AS p FROM (SELECT {K}, min(row_idx) AS s, max(row_idx) AS e FROM (SELECT *, row_idx - row_number() OVER (PARTITION BY {K}, program_status ORDER BY row_idx) AS g FROM m3) GROUP BY {K}, program_status, g) GROUP BY {K}),
mw AS (SELECT {K}, 0 AS step, p, list_position(list_transform(p, lambda x: x.e - x.s + 1 < 3), true) AS i FROM mq
 UNION ALL
 SELECT {K}, step + 1, q, list_position(list_transform(q, lambda x: x.e - x.s + 1 < 3), true) FROM (SELECT {K}, step,
  CASE WHEN to_left THEN list_concat(p[:i - 2], [{{'s': p[i - 1].s, 'e': p[i].e}}], p[i + 1:]) ELSE list_concat(p[:i - 1], [{{'s': p[i].s, 'e': p[i + 1].e}}], p[i + 2:]) END AS q FROM (
  SELECT *, i = len(p) OR (i > 1 AND p[i - 1].e - p[i - 1].s <= p[i + 1].e - p[i + 1].s) AS to_left FROM mw WHERE i > 0 AND len(p) > 1))),
mp AS (SELECT {K}, unnest(arg_max(p, step)) AS x FROM mw GROUP BY {K})"""


@query(sql(PIECES, f"SELECT {K}, x.s AS start, x.e AS \"end\" FROM mp"))
def merge_short_pieces(spark, sf_dir):
    pieces = intervals.contiguous_segments(chain_of(spark, sf_dir).rows, F.lit(True), [K, "program_status"])
    return candidates.merge_pieces(pieces, KEYS, 3)


POOLED = (SIGNALS, PRIOR, POOL)


@query(sql(*POOLED, f"SELECT {K}, branch, {r('threshold', 'threshold')}, s AS start, e AS \"end\", {r('confidence', 'confidence')} FROM pool"))
def segment_confidence(spark, sf_dir):
    chain = chain_of(spark, sf_dir)
    pieces = candidates.split_blob(chain.blobs, chain.points, BLOB_KEYS)
    return candidates.segment_confidence(pieces, chain.branch_rows, [K, "branch"]).select(*BLOB_KEYS, "start", "end", "confidence")


@query(sql(*POOLED, f"SELECT {K}, branch, {r('threshold', 'threshold')}, s AS start, e AS \"end\", length, {r('center', 'center')}, {r('confidence', 'confidence')}, median_len, min_allowed_len, max_allowed_len, ord, {W} AS smooth_window, {GAP} AS merge_gap, {MIN_LEN} AS min_blob_len, CAST(0.88 AS DOUBLE) AS peak_quantile FROM pool"))
def generate_candidates(spark, sf_dir):
    return chain_of(spark, sf_dir).pool


@query(sql(*POOLED, f"SELECT {K}, ord, {r('confidence_norm', 'confidence_norm')}, {r('duration_fit', 'duration_fit')}, {r('nms_score', 'nms_score')} FROM nm"))
def candidate_nms_score(spark, sf_dir):
    return chain_of(spark, sf_dir).scored.select(K, "ord", "confidence_norm", "duration_fit", "nms_score")


@query(sql(*POOLED, NMS, f"SELECT {K}, ord, branch, s AS start, e AS \"end\" FROM kept"))
def nms(spark, sf_dir):
    return chain_of(spark, sf_dir).kept.select(K, "ord", "branch", "start", "end")


@query(sql(*POOLED, NMS, f"SELECT a.{K}, n_before, n_after, n_program, n_physical, n_program_physical, {r('n_after / CAST(n_before AS DOUBLE)', 'keep_ratio')} FROM (SELECT {K}, count(*) AS n_before FROM nm GROUP BY {K}) a JOIN (SELECT {K}, count(*) AS n_after, count(*) FILTER (branch = 'program') AS n_program, count(*) FILTER (branch = 'physical') AS n_physical, count(*) FILTER (branch = 'program_physical') AS n_program_physical FROM kept GROUP BY {K}) b USING ({K})"))
def nms_diagnostics(spark, sf_dir):
    chain = chain_of(spark, sf_dir)
    return candidates.nms_diagnostics(chain.pool, chain.kept, chain.groups, KEYS, list(BRANCHES))


@query(sql(*POOLED, NMS, CLUSTERS, f"SELECT {K}, ord, cluster_id FROM mb"))
def cluster_candidates(spark, sf_dir):
    return chain_of(spark, sf_dir).members.select(K, "ord", "cluster_id")


STAT_COLUMNS = f"{K}, cluster_id, n_members, branches, branch_diversity, {r('center_mean', 'center_mean')}, start_median, end_median, {r('total_confidence', 'total_confidence')}, {r('mean_confidence', 'mean_confidence')}, {r('score', 'score')}"


@query(sql(*POOLED, NMS, CLUSTERS, f"SELECT {STAT_COLUMNS} FROM cs2"))
def cluster_stats(spark, sf_dir):
    return chain_of(spark, sf_dir).stats.drop(*candidates.PRIOR)


@query(sql(*POOLED, NMS, CLUSTERS, VOTES, f"SELECT {K}, cluster_id, row_idx, {r('sv', 'start_votes')}, {r('ev', 'end_votes')} FROM dv WHERE sv > 0 OR ev > 0"))
def boundary_votes(spark, sf_dir):
    return chain_of(spark, sf_dir).votes


@query(sql(SIGNALS, SUPPORT, PRIOR, POOL, NMS, CLUSTERS, VOTES, VOTED, f"SELECT {K}, cluster_id, s AS start, e AS \"end\" FROM vb"))
def vote_boundaries(spark, sf_dir):
    return chain_of(spark, sf_dir).voted.select(K, "cluster_id", "start", "end")


@query(sql(*CHAIN[:9], f"SELECT {K}, cluster_id, s AS start, e AS \"end\" FROM rv"))
def refine_boundaries(spark, sf_dir):
    return chain_of(spark, sf_dir).refined.select(K, "cluster_id", "start", "end")


@query(sql(*CHAIN[:10], f"SELECT {K}, cluster_id, {r('entropy_gain', 'entropy_gain')} FROM eg"))
def entropy_gain(spark, sf_dir):
    chain = chain_of(spark, sf_dir)
    return clusters.entropy_gain(chain.refined, chain.tracks, chain.lengths, KEYS).select(K, "cluster_id", "entropy_gain")


@query(sql(*CHAIN, f"SELECT {K}, cluster_id, s AS start, e AS \"end\", length, {', '.join(r(x, x) for x in FEATURE_NAMES)} FROM fe"))
def cluster_features(spark, sf_dir):
    return chain_of(spark, sf_dir).features.select(K, "cluster_id", "start", "end", "length", *FEATURE_NAMES)


@query(sql(SIGNALS, SUPPORT, PRIOR, POOL, NMS, CLUSTERS, VOTES, VOTED, TRACKS, f"SELECT {K}, row_idx, {r('start_vote', 'start_vote')}, {r('end_vote', 'end_vote')} FROM vn"))
def vote_tracks(spark, sf_dir):
    return chain_of(spark, sf_dir).vote_tracks


@query(sql(*CHAIN, RANKED, f"SELECT {K}, cluster_id, {r('cluster_score_norm', 'cluster_score_norm')}, {r('entropy_gain_norm', 'entropy_gain_norm')}, {r('rank_score', 'rank_score')} FROM rk"))
def rank_clusters(spark, sf_dir):
    return chain_of(spark, sf_dir).ranked.select(K, "cluster_id", "cluster_score_norm", "entropy_gain_norm", "rank_score")


@query(sql(*CHAIN, RANKED, FINAL, f"SELECT {K}, segment_no, cluster_id, s AS start, e AS \"end\", {r('rank_score', 'rank_score')} FROM fin"))
def select_final(spark, sf_dir):
    return chain_of(spark, sf_dir).final.select(K, "segment_no", "cluster_id", "start", "end", "rank_score")


_ROW_VALUES = [*[f"prob_{b}_raw" for b in BRANCHES], *[f"prob_{b}_smooth" for b in BRANCHES], "boundary_program", "boundary_physical", "boundary", "support", "start_vote", "end_vote"]


@query(sql(*CHAIN, RANKED, FINAL, TRACKS, f"""rx AS (SELECT m.*, {', '.join(f'm.{b} AS prob_{b}_raw, avg(m.{b}) OVER ({frame(W).replace(f"PARTITION BY {K} ORDER BY row_idx", f"PARTITION BY m.{K} ORDER BY m.row_idx")}) AS prob_{b}_smooth' for b in BRANCHES)}, p.boundary AS boundary_program, q.boundary AS boundary_physical, g.boundary, t.support, v.start_vote, v.end_vote,
 CAST(EXISTS (SELECT 1 FROM fin f WHERE f.{K} = m.{K} AND m.row_idx BETWEEN f.s AND f.e) AS INTEGER) AS pred_phase2
 FROM m3 m JOIN bp p ON p.{K} = m.{K} AND p.row_idx = m.row_idx JOIN bq q ON q.{K} = m.{K} AND q.row_idx = m.row_idx JOIN gs g ON g.{K} = m.{K} AND g.row_idx = m.row_idx JOIN tr t ON t.{K} = m.{K} AND t.row_idx = m.row_idx LEFT JOIN vn v ON v.{K} = m.{K} AND v.row_idx = m.row_idx)""",
 f"SELECT {K}, row_idx, original_row, row_idx AS removed_row, epoch_us(ts) AS time_us, phase, CAST(phase = 2 AS INTEGER) AS target_phase2, pred_phase2, {', '.join(r(x, x) for x in _ROW_VALUES)} FROM rx"))
def row_predictions(spark, sf_dir):
    rows = chain_of(spark, sf_dir).row_table
    return rows.select(K, "row_idx", "original_row", "removed_row", F.unix_micros(F.col("ts").cast("timestamp")).alias("time_us"), "phase", "target_phase2", "pred_phase2", *_ROW_VALUES)


SCORES = ["precision", "recall", "f1", "matched_mean_iou", "mean_best_gt_iou", "best_any_iou"]
#: Final intervals against true ones as in the first stage; two empty lists have no mean IoU here.
EVALUATED_2 = (
    f"gt AS (SELECT *, CAST(row_number() OVER (PARTITION BY {K} ORDER BY s, e) - 1 AS INTEGER) AS i FROM gr), pred AS (SELECT *, CAST(row_number() OVER (PARTITION BY {K} ORDER BY s, e) - 1 AS INTEGER) AS i FROM fin)",
    PAIRS, MATCHED, BEST, EVALUATED.replace("THEN 1.0", "THEN NULL"),
    f"mk AS (SELECT m.{K}, m.row_idx, CAST(m.phase = 2 AS INTEGER) AS g, CAST(EXISTS (SELECT 1 FROM fin f WHERE f.{K} = m.{K} AND m.row_idx BETWEEN f.s AND f.e) AS INTEGER) AS h FROM m3 m)",
    f"rm AS (SELECT {K}, avg(CAST(g = h AS INTEGER)) AS row_accuracy, coalesce(sum(g * h) / nullif(CAST(sum(h) AS DOUBLE), 0), 0.0) AS row_precision, coalesce(sum(g * h) / nullif(CAST(sum(g) AS DOUBLE), 0), 0.0) AS row_recall FROM mk GROUP BY {K})",
    f"au AS (SELECT {K}, (sum(CASE WHEN g = 1 THEN k END) - sum(g) * (sum(g) + 1) / 2.0) / nullif(CAST(sum(g) * sum(1 - g) AS DOUBLE), 0) AS row_auc FROM (SELECT {K}, CAST(phase = 2 AS INTEGER) AS g, rank() OVER (PARTITION BY {K} ORDER BY p) + (count(*) OVER (PARTITION BY {K}, p) - 1) / 2.0 AS k FROM (SELECT *, round(program_physical, 9) AS p FROM m3)) GROUP BY {K})",
    f"er AS (SELECT {K}, avg(abs(ps - gs)) AS mean_start_abs_error, avg(abs(pe - ge)) AS mean_end_abs_error FROM best GROUP BY {K})",
    f"tx AS (SELECT a.{K}, coalesce((SELECT string_agg(concat(s, '-', e), ' | ' ORDER BY s, e) FROM gr WHERE gr.{K} = a.{K}), '-') AS gt_intervals, coalesce((SELECT string_agg(concat(s, '-', e), ' | ' ORDER BY s, e) FROM fin WHERE fin.{K} = a.{K}), '-') AS pred_intervals, (SELECT count(*) FROM mb WHERE mb.{K} = a.{K}) AS n_candidates, (SELECT count(DISTINCT cluster_id) FROM mb WHERE mb.{K} = a.{K}) AS n_clusters FROM s a)",
)


@query(sql(*CHAIN, RANKED, FINAL, *EVALUATED_2, f"""SELECT {K}, n_pred, n_gt, tp, fp, fn, {', '.join(r(m, m) for m in SCORES)}, n_pred - n_gt AS count_error, abs(n_pred - n_gt) AS count_abs_error, {', '.join(r(m, m) for m in ('row_accuracy', 'row_precision', 'row_recall'))},
 {r('CASE WHEN row_precision + row_recall > 0 THEN 2 * row_precision * row_recall / (row_precision + row_recall) ELSE 0.0 END', 'row_f1')}, {r('row_auc', 'row_auc')}, {r('mean_start_abs_error', 'mean_start_abs_error')}, {r('mean_end_abs_error', 'mean_end_abs_error')}, gt_intervals, pred_intervals, n_clusters, n_candidates, median_len, min_allowed_len, max_allowed_len
 FROM ev3 LEFT JOIN rm USING ({K}) LEFT JOIN au USING ({K}) LEFT JOIN er USING ({K}) LEFT JOIN tx USING ({K}) JOIN prior USING ({K})"""))
def stage2_summary(spark, sf_dir):
    """Counts and scores of the final intervals of each fold."""
    return chain_of(spark, sf_dir).summary


@query()
def phase_workflow(spark, sf_dir):
    """All of stage two with fitted models, over all sessions: its summary of folds."""
    tables = workflows.localise_phase(Scratch(spark, "phase"), machine_log(spark, sf_dir), BRANCHES, FIXTURE)
    return tables["stage2_loo_summary"]


@query()
def phase_study(spark, sf_dir):
    """The second study with its own sensors, branches and parameters: its tables written, its summary of folds read again."""
    scratch = Scratch(spark, "phase-study")
    return workflows.saved(workflows.localise_phase(scratch, study_log(spark, sf_dir), config.BRANCHES, Stage2()), scratch.path(), "stage2_loo_summary")
