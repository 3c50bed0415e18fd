"""Clusters of candidates, boundaries by vote, refinement, ranking. Clusters are named by fold keys and cluster_id."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runline.operators import clean, scan
from runline.operators.candidates import PRIOR, at_rows, first_largest, rows_within
from runline.sources.scratch import partitions


def _join_cluster(state: list[float] | None, center: float, ord: int, radius: int):
    """state: sum and number of the centers of the current cluster."""
    total, n = state or (0.0, 0.0)
    joins = n > 0 and abs(center - total / n) <= radius
    return [total + center, n + 1] if joins else [center, 1.0], [(ord, center, not joins)]


def cluster_candidates(candidates: DataFrame, fold: list[str], ord: str = "ord", factor: float = 0.70, width: int = scan.WIDTH) -> DataFrame:
    """Adds `cluster_id` (from 1, by center). In order of center, a candidate joins the current cluster if it is within the
    radius of its mean center: an ordered scan that carries the sum and the number of its centers. Numbers go on from block to block by a small
    table of how many clusters begin in each."""
    c = F.col
    radius = F.greatest(F.lit(8), (c("median_len") * F.lit(factor)).cast("int"))
    rows = candidates.select(*fold, c("center").cast("double").alias("center"), c(ord).cast("long").alias("_ord"), radius.alias("_radius"))
    each, _ = scan.scan(rows, fold, [c("center"), c("_ord")], c("center"), ["center", "_ord", "_radius"], _join_cluster, "_ord long, _at double, _new boolean", width)
    begun = each.groupBy(*fold, "_block").agg(F.count_if("_new").alias("_k"))
    before = F.sum("_k").over(Window.partitionBy(*fold).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    inner = Window.partitionBy(*fold, "_block").orderBy("_at", "_ord").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("_k", F.count_if("_new").over(inner)).join(begun.select(*fold, "_block", F.coalesce(before, F.lit(0)).alias("_before")), [*fold, "_block"])
    numbered = each.select(*fold, c("_ord").cast(candidates.schema[ord].dataType).alias(ord), (c("_before") + c("_k")).cast("int").alias("cluster_id"))
    return candidates.join(numbered, [*fold, ord])


def cluster_stats(members: DataFrame, fold: list[str]) -> DataFrame:
    """One row per cluster: members, branches, diversity, confidences, score, weighted center, truncated median ends."""
    c = F.col
    weight = F.greatest(c("confidence"), F.lit(1e-6))
    out = members.groupBy(*fold, "cluster_id").agg(
        F.count("*").alias("n_members"),
        F.array_join(F.sort_array(F.collect_set("branch")), ",").alias("branches"),
        F.countDistinct("branch").alias("branch_diversity"),
        (F.sum(c("center") * weight) / F.sum(weight)).alias("center_mean"),
        F.percentile("start", 0.5).cast("long").alias("start_median"),
        F.percentile("end", 0.5).cast("long").alias("end_median"),
        F.sum("confidence").alias("total_confidence"),
        F.avg("confidence").alias("mean_confidence"),
        *[F.max(p).alias(p) for p in PRIOR],
    )
    score = c("total_confidence") * (1 + F.lit(0.12) * (c("branch_diversity") - 1)) + F.lit(0.15) * c("mean_confidence")
    return out.withColumn("score", score)


def vote_radius() -> Column:
    return F.greatest(F.lit(5), (F.col("median_len") * F.lit(0.35)).cast("int"))


#: Rows of a block of votes. Up to so many different ends are added one by one, more of them by a Fourier transform.
VOTE_BLOCK, ONE_BY_ONE = 1 << 17, 512


def gaussian_votes(at: np.ndarray, weight: np.ndarray, radius: int, first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Votes on the rows first ... first + n - 1 of ends at the rows `at`, each of which votes `radius` rows to either side, and which of the rows have any."""
    at, same = np.unique(at, return_inverse=True)
    weight = np.bincount(same, weight)
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / max(1.0, radius / 2)) ** 2)
    low, high = np.clip(at - radius - first, 0, n), np.clip(at + radius + 1 - first, 0, n)
    voted = np.cumsum(np.bincount(low, minlength=n + 1) - np.bincount(high, minlength=n + 1))[:n] > 0
    if len(at) > ONE_BY_ONE:
        spread = np.bincount(at - first + radius, weight, n + 2 * radius)
        size = 1 << (n + 2 * radius).bit_length()
        total = np.fft.irfft(np.fft.rfft(spread, size) * np.fft.rfft(kernel, size), size)[2 * radius : 2 * radius + n]
        return np.where(voted, np.maximum(total, 0.0), 0.0), voted
    total = np.zeros(n)
    for a, b, w, p in zip(low.tolist(), high.tolist(), weight.tolist(), (first - at + radius).tolist(), strict=True):
        total[a:b] += w * kernel[a + p : b + p]
    return total, voted


def boundary_votes(members: DataFrame, lengths: DataFrame, fold: list[str], order: str = "row_idx", block: int = VOTE_BLOCK) -> DataFrame:
    """(cluster, row, start_votes, end_votes): sums of Gaussian votes, only on rows that have any. lengths: `n_rows` of each fold's series.

    What is dealt are the ends, to the blocks of rows that their votes reach; ends at one row are added up first. A vote is no row, so work does not grow
    with members times the rows that each reaches."""
    c, spark = F.col, members.sparkSession
    weight = F.greatest(F.lit(1e-6), c("confidence") * c("confidence"))
    rows = members.join(lengths.select(*fold, "n_rows"), fold).select(*fold, "cluster_id", "n_rows", vote_radius().alias("_r"), weight.alias("_w"), "start", "end")
    both = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), c(end).cast("long").alias("at")) for k, end in enumerate(("start", "end"))]))
    ends = rows.withColumn("_e", both).groupBy(*fold, "cluster_id", "n_rows", "_r", c("_e.k").alias("_k"), c("_e.at").alias("_at")).agg(F.sum("_w").alias("_w"))
    reached = F.sequence(F.floor(F.greatest(F.lit(0), c("_at") - c("_r")) / block), F.floor(F.least(c("n_rows") - 1, c("_at") + c("_r")) / block))
    group = [*fold, "cluster_id", "_block"]
    dealt = ends.withColumn("_block", F.explode(reached)).repartition(partitions(spark), *group)  # so many tasks, however few rows are dealt
    schema = f"{', '.join(f'`{k}` {members.schema[k].dataType.simpleString()}' for k in [*fold, 'cluster_id'])}, `{order}` long, start_votes double, end_votes double"
    names = [*fold, "cluster_id", order, "start_votes", "end_votes"]

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        kind, at, radius, weight_ = (table.column(x).to_numpy() for x in ("_k", "_at", "_r", "_w"))
        first = key[-1].as_py() * block
        n = min(block, table.column("n_rows")[0].as_py() - first)
        sums, some = np.zeros((2, n)), np.zeros(n, bool)
        for r in np.unique(radius):
            for k in (0, 1):
                mine = (kind == k) & (radius == r)
                if mine.any():
                    votes, voted = gaussian_votes(at[mine], weight_[mine], int(r), first, n)
                    sums[k] += votes
                    some |= voted
        found = np.flatnonzero(some)
        same = [pa.repeat(k, len(found)) for k in key[:-1]]
        return pa.table([*same, pa.array(first + found), pa.array(sums[0, found]), pa.array(sums[1, found])], names=names)

    return dealt.groupBy(*group).applyInArrow(run, schema)


def _normal_votes(votes: DataFrame, lengths: DataFrame, fold: list[str]) -> DataFrame:
    """Votes scaled as if they had a value on all rows: the least is 0, unless every row of the series has one."""
    c = F.col
    ends = votes.join(lengths.select(*fold, "n_rows"), fold).groupBy(*fold, "cluster_id").agg(
        *[x for v in ("start_votes", "end_votes") for x in (F.max(v).alias(f"hi_{v}"), F.when(F.count("*") >= F.max("n_rows"), F.min(v)).otherwise(0.0).alias(f"lo_{v}"))]
    )

    def scaled(v: str) -> Column:
        return F.when(c(f"hi_{v}") > c(f"lo_{v}"), (c(v) - c(f"lo_{v}")) / (c(f"hi_{v}") - c(f"lo_{v}"))).otherwise(0.0)

    return votes.join(ends, [*fold, "cluster_id"]).withColumns({v: scaled(v) for v in ("start_votes", "end_votes")}).select(*votes.columns)


def vote_boundaries(stats: DataFrame, votes: DataFrame, signal: DataFrame, lengths: DataFrame, fold: list[str], order: str = "row_idx", boundary: str = "boundary") -> DataFrame:
    """Adds `start` and `end` to the clusters: the first best row of 0.72 votes + 0.28 boundary near each median end; the medians
    if that reverses them; re-centred to the shortest or longest length allowed. Centers are rounded to 9 digits first: sums in
    another order must not tip a half."""
    c = F.col
    scaled = _normal_votes(votes, lengths, fold)
    track = signal.select(*fold, order, F.least(F.greatest(boundary, F.lit(0.0)), F.lit(1.0)).alias("_g"))
    rows = stats.join(lengths.select(*fold, "n_rows"), fold)
    reach = F.greatest(vote_radius(), (c("median_len") * F.lit(0.75)).cast("int"))

    rows = rows.withColumn("_reach", reach)
    medians = rows.select(*fold, "cluster_id", "n_rows", "start_median", "end_median", "_reach")

    def value(votes: Column) -> Column:
        return F.round(F.lit(0.72) * votes + F.lit(0.28) * c("_g"), 12)

    # The best row of the boundary alone, and the best of the rows with votes: more votes are never worse, so the better one of both is the best of all.
    ends = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), c(f"{k}_median").alias("at")) for k in ("start", "end")]))
    asked = medians.withColumn("_e", ends).select(*fold, "cluster_id", c("_e.k").alias("_end"), F.greatest(F.lit(0), c("_e.at") - c("_reach")).cast("long").alias("_lo"), F.least(c("n_rows") - 1, c("_e.at") + c("_reach")).cast("long").alias("_hi"))
    plain = first_largest(asked, track, "_g", fold, order).select(*fold, "cluster_id", "_end", value(F.lit(0.0)).alias("_v"), order)
    near = {k: F.when(F.abs(c(order) - c(f"{k}_median")) <= c("_reach"), c(f"{k}_votes")).alias(f"_{k}_votes") for k in ("start", "end")}
    voted = scaled.join(medians.drop("n_rows"), [*fold, "cluster_id"]).select(*fold, "cluster_id", order, *near.values()).where("_start_votes is not null or _end_votes is not null").join(track, [*fold, order])
    voted = voted.select(*fold, "cluster_id", order, *[value(c(f"_{k}_votes")).alias(f"_v_{k}") for k in near])
    plain = plain.select(*fold, "cluster_id", order, *[F.when(c("_end") == k, c("_v")).alias(f"_v_{k}") for k in near])
    best = plain.unionByName(voted).groupBy(*fold, "cluster_id").agg(*[(-F.max(F.when(c(f"_v_{k}").isNotNull(), F.struct(c(f"_v_{k}").alias("v"), (-c(order)).alias("i"))))["i"]).alias(f"_{k}") for k in near])
    out = rows.join(best, [*fold, "cluster_id"])
    reversed_ = c("_end") <= c("_start")
    out = out.withColumn("start", F.when(reversed_, c("start_median")).otherwise(c("_start"))).withColumn("end", F.when(reversed_, c("end_median")).otherwise(c("_end")))
    for limit, bad in (("min_allowed_len", c("end") - c("start") + 1 < c("min_allowed_len")), ("max_allowed_len", c("end") - c("start") + 1 > c("max_allowed_len"))):
        first = F.greatest(F.lit(0), F.rint(F.round("center_mean", 9)).cast("long") - F.floor(c(limit) / 2))
        out = out.withColumn("_bad", bad).withColumn("_first", first)
        out = out.withColumn("start", F.when(c("_bad"), c("_first")).otherwise(c("start")).cast("long"))
        out = out.withColumn("end", F.when(c("_bad"), F.least(c("n_rows") - 1, c("start") + c(limit) - 1)).otherwise(c("end")).cast("long"))
    return out.drop("_start", "_end", "_bad", "_first", "_reach")


def _entropy(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return -(q * F.log2(q) + (1 - q) * F.log2(1 - q))


def entropy_gain(segments: DataFrame, signal: DataFrame, lengths: DataFrame, fold: list[str], track: str = "support", order: str = "row_idx") -> DataFrame:
    """Adds `entropy_gain`: binary entropy of the context's mean, less that of inside and outside by size; at least 0. The context
    is the interval and half a median length on either side. Four sums up to a row per interval."""
    c = F.col
    around = F.greatest(F.lit(10), F.rint(F.lit(0.5) * F.greatest(c("median_len"), F.lit(1))).cast("long"))
    out = segments if "n_rows" in segments.columns else segments.join(lengths.select(*fold, "n_rows"), fold)
    out = out.withColumn("_lo", F.greatest(F.lit(0), c("start") - around)).withColumn("_hi", F.least(c("n_rows") - 1, c("end") + around))
    places = {"a": c("_lo") - 1, "b": c("start") - 1, "c": c("end"), "d": c("_hi")}
    out = at_rows(out, signal, [track], places, fold, {f"_{k}": (k, f"s_{track}") for k in places}, order)
    n, inside = c("_hi") - c("_lo") + 1, c("end") - c("start") + 1
    outside = n - inside
    gain = _entropy((c("_d") - c("_a")) / n) - inside / n * _entropy((c("_c") - c("_b")) / inside) - outside / n * _entropy((c("_d") - c("_a") - c("_c") + c("_b")) / outside)
    value = F.when((n < 3) | (outside <= 0), 0.0).otherwise(F.greatest(F.lit(0.0), gain))
    return out.withColumn("entropy_gain", value).drop("_lo", "_hi", "_a", "_b", "_c", "_d")


def refine_at(start: int, end: int, n_rows: int, rows: np.ndarray, boundary: np.ndarray, sums: np.ndarray, median: int, low: int, high: int, radius: int) -> tuple[int, int]:
    """The best pair of ends near the given ones, all pairs at once. rows: the numbers, in order, of those rows that the search needs, with the boundary
    and the sum of the support up to each; the sum before the first one is 0 if it is not among them."""
    around = max(10, round(0.5 * max(1, median)))

    def upto(row):
        return np.where(row < rows[0], 0.0, sums[np.searchsorted(rows, np.maximum(row, rows[0]))])

    def entropy(p):
        p = np.clip(p, 1e-9, 1 - 1e-9)
        return -(p * np.log2(p) + (1 - p) * np.log2(1 - p))

    a, b = np.meshgrid(np.arange(max(0, start - radius), min(n_rows - 1, start + radius) + 1), np.arange(max(0, end - radius), min(n_rows - 1, end + radius) + 1), indexing="ij")
    size = b - a + 1
    fits = (size >= max(1, low)) & (size <= max(low, high))
    if not fits.any():
        return start, end
    a, b, size = a[fits], b[fits], size[fits]
    lo, hi = np.maximum(0, a - around), np.minimum(n_rows - 1, b + around)
    n, inside = hi - lo + 1, upto(b) - upto(a - 1)
    outside = n - size
    whole = upto(hi) - upto(lo - 1)
    gain = entropy(whole / n) - size / n * entropy(inside / size) - outside / n * entropy((whole - inside) / np.maximum(outside, 1))
    gain = np.where((n < 3) | (outside <= 0), 0.0, np.maximum(gain, 0))
    score = np.round(0.45 * gain + 0.35 * (boundary[np.searchsorted(rows, a)] + boundary[np.searchsorted(rows, b)]) / 2 + 0.20 * inside / size, 12)
    best = score.argmax()  # scanned by start, then end: the first of equals
    here = np.flatnonzero((a == start) & (b == end))
    if len(here) and score[here[0]] >= score[best]:
        return start, end
    return int(a[best]), int(b[best])


def refine_one(start: int, end: int, first: int, n_rows: int, boundary: np.ndarray, support: np.ndarray, median: int, low: int, high: int, radius: int) -> tuple[int, int]:
    """`refine_at` on a slice of the tracks that begins at row `first`."""
    return refine_at(start, end, n_rows, np.arange(first, first + len(support)), boundary, np.cumsum(support), median, low, high, radius)


def refine_boundaries(segments: DataFrame, signal: DataFrame, lengths: DataFrame, fold: list[str], radius: int = 50, order: str = "row_idx", boundary: str = "boundary", track: str = "support") -> DataFrame:
    """Moves `start` and `end` within `radius` to the best of 0.45 entropy gain + 0.35 boundary + 0.20 mean support. A group is one
    cluster with the rows that its search reads: those near its ends and those near the ends of its context, where sums up to a row are looked up. So
    its size does not grow with the cluster's length."""
    c = F.col
    rows = segments if "n_rows" in segments.columns else segments.join(lengths.select(*fold, "n_rows"), fold)
    around, last = F.greatest(F.lit(10), F.rint(F.lit(0.5) * c("median_len")).cast("long")), c("n_rows") - 1
    need, name = ["start", "end", "n_rows", *PRIOR], [*fold, "cluster_id"]

    def within(first: Column, end: Column) -> Column:
        return F.struct(F.greatest(F.lit(0), F.least(last, first)).cast("long").alias("lo"), F.least(last, end).cast("long").alias("hi"))

    shifts = {"start": (-around, F.lit(0)), "end": (F.lit(0), around)}
    ends = [within(c(k) + by - radius - 1, F.greatest(F.lit(0), c(k) + by + radius)) for k, both in shifts.items() for by in both]
    short = c("end") - c("start") + 2 * around <= 6 * radius
    near = F.explode(F.when(short, F.array(within(c("start") - around - radius - 1, c("end") + around + radius))).otherwise(F.array(*ends))).alias("_near")
    asked = rows.select(*name, *need, near).select(*name, *need, c("_near.lo").alias("_lo"), c("_near.hi").alias("_hi"))
    read = rows_within(asked, signal, [boundary, track], fold, order).drop("_lo", "_hi", track)
    kinds = ", ".join(f"`{k}` {segments.schema[k].dataType.simpleString()}" for k in name)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates(order).sort_values(order)
        x = part.iloc[0]
        a, b = refine_at(int(x["start"]), int(x["end"]), int(x["n_rows"]), part[order].to_numpy(), part[boundary].to_numpy(), part[f"s_{track}"].to_numpy(), int(x["median_len"]), int(x["min_allowed_len"]), int(x["max_allowed_len"]), radius)
        return pd.DataFrame([[*[x[k] for k in name], a, b]], columns=[*name, "start", "end"])

    moved = read.groupBy(*name).applyInPandas(run, f"{kinds}, start long, end long")
    return segments.drop("start", "end").join(moved, name)


def cluster_features(segments: DataFrame, signal: DataFrame, lengths: DataFrame, fold: list[str], order: str = "row_idx", boundary: str = "boundary", track: str = "support") -> DataFrame:
    """Adds length, duration_fit, boundary_support, internal_boundary, prob_support, internal_prob and entropy_gain."""
    c = F.col
    out = at_rows(
        segments, signal, [boundary, track], {"before": c("start") - 1, "start": c("start"), "end": c("end")}, fold,
        {"_b": ("before", f"s_{boundary}"), "_t": ("before", f"s_{track}"), "_b0": ("start", boundary), "_t0": ("start", track),
         "_bb": ("end", f"s_{boundary}"), "_tt": ("end", f"s_{track}"), "_b1": ("end", boundary), "_t1": ("end", track)}, order,
    )
    n, m = c("end") - c("start") + 1, F.greatest(c("median_len"), F.lit(1))
    out = out.withColumns({
        "length": n, "duration_fit": 1 / (1 + F.abs(n - m) / m), "boundary_support": (c("_b0") + c("_b1")) / 2, "internal_boundary": (c("_bb") - c("_b")) / n,
        "prob_support": (c("_t0") + c("_t1")) / 2, "internal_prob": (c("_tt") - c("_t")) / n,
    })
    return entropy_gain(out.drop("_b", "_t", "_b0", "_t0", "_bb", "_tt", "_b1", "_t1"), signal, lengths, fold, track, order)


def vote_tracks(votes: DataFrame, clusters: DataFrame, signal: DataFrame, lengths: DataFrame, fold: list[str], order: str = "row_idx", boundary: str = "boundary") -> DataFrame:
    """start_vote and end_vote of every row: sums over clusters of score x (0.72 votes + 0.28 boundary), normalised. Votes are
    sparse; the boundary part is the same for all clusters, so it is added once, times the sum of scores."""
    c = F.col
    score = clusters.select(*fold, "cluster_id", F.greatest(F.lit(1e-6), c("score")).alias("_s"))
    sparse = _normal_votes(votes, lengths, fold).join(score, [*fold, "cluster_id"]).groupBy(*fold, order).agg(F.sum(c("_s") * c("start_votes")).alias("_a"), F.sum(c("_s") * c("end_votes")).alias("_b"))
    total = score.groupBy(*fold).agg(F.sum("_s").alias("_all"))
    rows = signal.select(*fold, order, F.least(F.greatest(boundary, F.lit(0.0)), F.lit(1.0)).alias("_g")).join(total, fold, "left").join(sparse, [*fold, order], "left").fillna(0.0, ["_all", "_a", "_b"])
    out = rows.select(*fold, order, *[(F.lit(0.72) * c(x) + F.lit(0.28) * c("_g") * c("_all")).alias(n) for x, n in (("_a", "start_vote"), ("_b", "end_vote"))])
    return clean.minmax_normalise(out, ["start_vote", "end_vote"], fold)


def rank_clusters(features: DataFrame, fold: list[str], weight: float = 0.25) -> DataFrame:
    """Adds cluster_score_norm, entropy_gain_norm and rank_score = 0.75 and 0.25 of them, over the fold's clusters."""
    both = features.withColumns({"cluster_score_norm": F.col("score"), "entropy_gain_norm": F.col("entropy_gain")})
    scaled = clean.minmax_normalise(both, ["cluster_score_norm", "entropy_gain_norm"], fold)
    return scaled.withColumn("rank_score", F.lit(1 - weight) * F.col("cluster_score_norm") + F.lit(weight) * F.col("entropy_gain_norm"))
