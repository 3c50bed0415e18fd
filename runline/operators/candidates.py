"""Candidate intervals: blobs of high probability, cut at boundary peaks, scored, freed of near doubles.

Blobs and candidates carry `median_len`, `min_allowed_len` and `max_allowed_len` of their fold (see duration_prior).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from runline.operators import clean, greedy, scan
from runline.sources.scratch import Scratch

PRIOR = ["median_len", "min_allowed_len", "max_allowed_len"]


def with_prior(df: DataFrame, prior: DataFrame, keys: list[str]) -> DataFrame:
    """One row per fold joined on."""
    return df.join(prior.select(*keys, *PRIOR), keys)


#: Value ranges that a blob's rows are first counted by.
BINS = 1024


def _over_blocks(signal: DataFrame, asked: DataFrame, own: list[str], answer, schema: str, order: str, value: str, block: int) -> DataFrame:
    """`answer(rows, values, question)` gives rows of `schema` for each question of `asked` (own keys, `_lo`, `_hi`: rows it is about) and each block of the
    signal that it reaches. The signal is dealt once, whatever the questions; a question goes to its blocks."""
    c, names = F.col, [x.split(" ")[0].strip("`") for x in schema.split(", ")]
    of = [f"_b_{k}" for k in own]
    rows = signal.select(*[c(k).alias(o) for k, o in zip(own, of, strict=True)], c(order).cast("long").alias("_row"), c(value).cast("double").alias("_value"), F.floor(c(order) / block).alias("_at"))
    questions = asked.withColumn("_block", F.explode(F.sequence(F.floor(c("_lo") / block), F.floor(c("_hi") / block))))

    types = to_arrow_schema(T._parse_datatype_string(schema))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            row, v = left.column("_row").to_numpy(), left.column("_value").to_numpy()
            sorted_ = np.argsort(row, kind="stable")
            row, v = row[sorted_], v[sorted_]
            for q in right.to_pylist():
                a, b = np.searchsorted(row, q["_lo"]), np.searchsorted(row, q["_hi"], side="right")
                if b > a:
                    out += answer(row[a:b], v[a:b], q)
        columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
        return pa.table([pa.array(list(x), f.type) for x, f in zip(columns, types, strict=True)], schema=types)

    return rows.groupBy(*of, "_at").cogroup(questions.groupBy(*own, "_block")).applyInArrow(run, schema)


def _place(v: np.ndarray | float, low: float, high: float):
    """Value range of a value: it never falls as values rise."""
    return np.clip(np.floor((v - low) / max(high - low, 1e-300) * BINS), 0, BINS - 1).astype(np.int64)


def _counts_by_range(row: np.ndarray, v: np.ndarray, q: dict) -> list[tuple]:
    bins, n = np.unique(_place(v, q["_min"], q["_max"]), return_counts=True)
    return [(q["_id"], int(k), int(m)) for k, m in zip(bins, n, strict=True)]


def _values_and_best(row: np.ndarray, v: np.ndarray, q: dict) -> list[tuple]:
    """For an anchor the first of the largest values; for a blob the different values in the ranges that hold its quantile."""
    if q["_a"] is not None:
        k = int(v.argmax())
        return [(q["_id"], q["_a"], int(row[k]), float(v[k]), None)]
    mine, n = np.unique(v[np.isin(_place(v, q["_min"], q["_max"]), q["_bins"])], return_counts=True)
    return [(q["_id"], None, None, float(x), int(m)) for x, m in zip(mine, n, strict=True)]


def _peaks(row: np.ndarray, v: np.ndarray, q: dict) -> list[tuple]:
    at = np.flatnonzero(v >= q["_q"] - 1e-12)
    return [(q["_id"], int(row[k]), float(v[k])) for k in at]


def candidate_split_points(
    blobs: DataFrame, signal: DataFrame, keys: list[str], quantile: float = 0.88, max_splits: int = 30, order: str = "row_idx", value: str = "boundary", block: int = clean.BLOCK
) -> DataFrame:
    """(blob, idx, score, rank): rows of long blobs where the signal is in its top quantile of the blob, or the first maximum
    near one of the evenly spaced anchors; none too near an end. Blobs are named by keys, start and end; the signal may lack some of the keys.

    Blobs are not expanded to rows: they and their anchors go as questions to the blocks of the signal that they reach. A blob's quantile is found by
    counts of its values by ranges, and then the values of the range that holds its rank.
    """
    c, scratch = F.col, Scratch(blobs.sparkSession, "points")
    own, blob = [k for k in keys if k in signal.columns], [*keys, "start", "end"]
    long = blobs.where(c("end") - c("start") + 1 >= c("max_allowed_len")).select(*blob, *PRIOR).distinct()
    long = long.withColumn("_n", c("end") - c("start") + 1).withColumn("_m", F.greatest(c("median_len"), F.lit(1)))
    long = long.withColumn("_k", F.least(F.greatest(F.rint(c("_n") / c("_m")), F.lit(1.0)), F.lit(max_splits + 1.0)).cast("int"))
    span = signal.groupBy(*own).agg(F.min(value).alias("_min"), F.max(value).alias("_max"))
    long = scratch.stored(long.join(span, own).withColumn("_id", F.monotonically_increasing_id()))
    asked = long.select(*own, "_id", "_min", "_max", c("start").alias("_lo"), c("end").alias("_hi"))
    counted = _over_blocks(signal, asked, own, _counts_by_range, "_id long, _bin long, _count long", order, value, block)
    bins = Window.partitionBy("_id").orderBy("_bin")
    ranked = counted.groupBy("_id", "_bin").agg(F.sum("_count").alias("_count")).withColumn("_upto", F.sum("_count").over(bins))
    place = (F.sum("_count").over(Window.partitionBy("_id")) - 1) * F.lit(float(quantile))
    ranked = ranked.withColumns({"_low": F.floor(place), "_high": F.ceil(place), "_share": place - F.floor(place)})
    holds = ((c("_upto") > c("_low")) & (c("_upto") - c("_count") <= c("_low"))) | ((c("_upto") > c("_high")) & (c("_upto") - c("_count") <= c("_high")))
    held = ranked.where(holds).groupBy("_id").agg(
        F.collect_list("_bin").alias("_bins"), F.min(c("_upto") - c("_count")).alias("_below"), *[F.max(x).alias(x) for x in ("_low", "_high", "_share")]
    )  # one range or two; ranges between them are empty
    held = scratch.stored(held)
    anchors = long.where("_k > 1").withColumn("_a", F.explode(F.sequence(F.lit(1), c("_k") - 1))).withColumn("_at", F.rint(c("_n") * c("_a") / c("_k")).cast("long"))
    half = F.floor(c("_m") / 2)
    anchors = anchors.withColumns({"_lo": F.greatest(F.lit(0), c("_at") - half), "_hi": F.least(c("_n") - 1, c("_at") + half)}).where("_hi > _lo")
    anchors = anchors.select(*own, "_id", "_a", (c("start") + c("_lo")).alias("_lo"), (c("start") + c("_hi")).alias("_hi"))
    asked = asked.join(held.select("_id", "_bins"), "_id").unionByName(anchors, allowMissingColumns=True)
    found = scratch.stored(_over_blocks(signal, asked, own, _values_and_best, "_id long, _a int, idx long, score double, n long", order, value, block))
    best = found.where("_a is not null").groupBy("_id", "_a").agg(F.max(F.struct("score", (-c("idx")).alias("neg"))).alias("b")).select("_id", (-c("b.neg")).alias("idx"), c("b.score").alias("score"))
    values = found.where("_a is null").groupBy("_id", "score").agg(F.sum("n").alias("n")).withColumn("_upto", F.sum("n").over(Window.partitionBy("_id").orderBy("score"))).join(held, "_id")
    values = values.withColumn("_upto", c("_upto") + c("_below"))

    def at_rank(rank: str) -> Column:
        return F.max(F.when((c("_upto") > c(rank)) & (c("_upto") - c("n") <= c(rank)), c("score")))

    cut = values.groupBy("_id").agg(at_rank("_low").alias("_v0"), at_rank("_high").alias("_v1"), F.max("_share").alias("_share"), F.max(c("_high") - c("_low")).alias("_gap"))
    cut = cut.select("_id", F.when(c("_gap") == 0, c("_v0")).otherwise((1 - c("_share")) * c("_v0") + c("_share") * c("_v1")).alias("_q"))
    asked = long.select(*own, "_id", c("start").alias("_lo"), c("end").alias("_hi")).join(cut, "_id")
    peaks = _over_blocks(signal, asked, own, _peaks, "_id long, idx long, score double", order, value, block)
    points = long.select(*blob, *PRIOR, "_id").join(peaks.unionByName(best).distinct(), "_id").drop("_id")
    points = points.where((c("idx") - c("start") + 1 >= c("min_allowed_len")) & (c("end") - c("idx") >= c("min_allowed_len")))
    rank = F.row_number().over(Window.partitionBy(*blob).orderBy(F.desc("score"), F.desc("idx")))
    return points.select(*blob, "idx", "score", rank.alias("rank"))


def merge_short_pieces(pieces: list[tuple[int, int]], min_len: int) -> list[tuple[int, int]]:
    """The first piece that is too short joins its only neighbour, or the shorter one (left on a tie); again, until none is."""
    out = sorted(map(list, pieces))
    while len(out) > 1:
        short = next((i for i, (a, b) in enumerate(out) if b - a + 1 < min_len), None)
        if short is None:
            break
        left = out[short - 1] if short else None
        right = out[short + 1] if short + 1 < len(out) else None
        to_left = right is None or (left is not None and left[1] - left[0] <= right[1] - right[0])
        if to_left:
            left[1] = out[short][1]
        else:
            right[0] = out[short][0]
        del out[short]
    return [tuple(p) for p in out]


def _merge_piece(state: list[float] | None, start: int, end: int, least: int):
    """state: the last piece that is long enough, and the short one behind it, which waits for the piece that comes next. Only these two can
    still change: all that lies before is final."""
    left, short = (state[:2], state[2:]) if state else ([], [])
    left, short = [x for x in left if x >= 0], [x for x in short if x >= 0]
    piece = [start, end]
    if short:
        if left and left[1] - left[0] <= end - start:
            left = [left[0], short[1]]
        else:
            piece = [short[0], end]
    if piece[1] - piece[0] + 1 < least:
        return [*(left or NO_PIECE), *piece], []
    return [*piece, *NO_PIECE], [(int(left[0]), int(left[1]))] if left else []


NO_PIECE = [-1.0, -1.0]


def merge_pieces(pieces: DataFrame, keys: list[str], least: str | int, width: int = scan.WIDTH) -> DataFrame:
    """`merge_short_pieces` over a table: pieces (start, end; from 0 on) of each value of `keys`, e.g. of one blob or session. least: a number, or a
    column that is the same for all pieces of a value. An ordered scan that carries two pieces, so a value's pieces are walked by many tasks."""
    limit, c = F.lit(least) if isinstance(least, int) else F.col(least), F.col
    rows = pieces.select(*keys, c("start").cast("long").alias("start"), c("end").cast("long").alias("end"), limit.cast("long").alias("_least"))
    merged, exits = scan.scan(rows, keys, [c("start"), c("end")], c("start"), ["start", "end", "_least"], _merge_piece, "start long, `end` long", width)
    last = exits.groupBy(*keys).agg(F.max_by("_exit", "_block").alias("s"))
    begin = F.when(c("s")[0] >= 0, c("s")[0]).otherwise(c("s")[2])
    final = F.when(c("s")[2] >= 0, c("s")[3]).otherwise(c("s")[1])
    return merged.select(*keys, "start", "end").unionByName(last.select(*keys, begin.cast("long").alias("start"), final.cast("long").alias("end")))


def split_pieces(start: int, end: int, points: list[tuple[float, int]], median: int, low: int, high: int, max_splits: int = 30, least: float = 0.40, tolerance: float = 0.35) -> list[tuple[int, int]]:
    """Greedy cuts of one blob; points in order of rank. A cut ends a piece, the next one begins after it."""
    n = end - start + 1
    if n <= high:
        return [(start, end)]
    wanted = max(1, round(n / max(1, median)))
    most = max(wanted + 1, -int(-(wanted * (1 + tolerance)) // 1))
    cuts: list[int] = []
    for score, at in points[: 3 * max_splits]:
        if len(cuts) >= max_splits:
            break
        if score < least or len(cuts) + 2 > most or any(abs(at - x) < low for x in cuts):
            continue
        edges = [start - 1, *sorted([*cuts, at]), end]
        if min(b - a for a, b in zip(edges[:-1], edges[1:], strict=True)) >= low:
            cuts = sorted([*cuts, at])
    edges = [start - 1, *cuts, end]
    return merge_short_pieces([(a + 1, b) for a, b in zip(edges[:-1], edges[1:], strict=True)], low)


def split_blob(blobs: DataFrame, points: DataFrame, keys: list[str], max_splits: int = 30, least: float = 0.40) -> DataFrame:
    """Pieces of each blob: keys, blob_start, blob_end, start, end and the prior. A group is one blob and its best 90 points."""
    blob = [*keys, "start", "end"]
    top = points.where(F.col("rank") <= 3 * max_splits).groupBy(*blob).agg(F.array_sort(F.collect_list(F.struct("rank", "score", "idx"))).alias("points"))
    rows = blobs.select(*blob, *PRIOR).distinct().join(top, blob, "left")
    kinds = ", ".join(f"`{k}` {blobs.schema[k].dataType.simpleString()}" for k in keys)

    def run(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                row = r._asdict()
                given = row["points"] if row["points"] is not None else []
                pieces = split_pieces(row["start"], row["end"], [(p["score"], p["idx"]) for p in given], row["median_len"], row["min_allowed_len"], row["max_allowed_len"], max_splits, least)
                out += [[*[row[k] for k in keys], row["start"], row["end"], a, b, *[row[p] for p in PRIOR]] for a, b in pieces]
            yield pd.DataFrame(out, columns=[*keys, "blob_start", "blob_end", "start", "end", *PRIOR])

    return rows.mapInPandas(run, f"{kinds}, blob_start long, blob_end long, start long, end long, " + ", ".join(f"{p} long" for p in PRIOR))


def rows_within(asked: DataFrame, signal: DataFrame, cols: list[str], keys: list[str], order: str = "row_idx", block: int = clean.BLOCK) -> DataFrame:
    """`asked` (keys, `_lo`, `_hi`, and what else tells its rows apart) with each row of the signal from `_lo` to `_hi`: its number, its columns `cols`, and for
    each the sum over the series up to and including the row (`s_` + name).

    The signal is dealt once by blocks of rows, and a question goes to the blocks that it reaches, so none is expanded to rows before they meet. Sums are
    those within a block, plus those of the blocks before, from a small table (a row per block)."""
    c, of = F.col, [f"_b_{k}" for k in keys]
    at = F.floor(c(order) / block)
    rows = signal.select(*[c(k).alias(o) for k, o in zip(keys, of, strict=True)], at.alias("_at"), c(order).cast("long").alias("_row"), *[c(x).cast("double").alias(f"_v_{x}") for x in cols])
    some = asked.where("_hi >= 0 and _hi >= _lo")
    questions = some.withColumn("_block", F.explode(F.sequence(F.floor(F.greatest(F.lit(0), c("_lo")) / block), F.floor(c("_hi") / block))))
    kinds = T.StructType([*questions.schema.fields, T.StructField(order, T.LongType()), *[T.StructField(n, T.DoubleType()) for n in [*cols, *[f"s_{x}" for x in cols]]]])
    types = to_arrow_schema(kinds)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return types.empty_table()
        row = left.column("_row").to_numpy()
        sorted_ = np.argsort(row, kind="stable")
        row = row[sorted_]
        first = np.searchsorted(row, right.column("_lo").to_numpy())
        n = np.searchsorted(row, right.column("_hi").to_numpy(), side="right") - first
        each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first, n)
        values = [left.column(f"_v_{x}").fill_null(0.0).to_numpy()[sorted_] for x in cols]
        told = [pa.array(x[each]) for x in (row, *values, *[np.cumsum(v) for v in values])]
        return pa.table([*right.take(pa.array(np.repeat(np.arange(len(n)), n))).columns, *told], names=types.names)

    found = rows.groupBy(*of, "_at").cogroup(questions.groupBy(*keys, "_block")).applyInArrow(run, kinds)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = signal.groupBy(*keys, at.alias("_block")).agg(*[F.sum(x).alias(f"_t_{x}") for x in cols])
    carried = totals.select(*keys, "_block", *[F.coalesce(F.sum(f"_t_{x}").over(before), F.lit(0.0)).alias(f"_c_{x}") for x in cols])
    return found.join(carried, [*keys, "_block"]).select(*asked.columns, order, *cols, *[(c(f"s_{x}") + c(f"_c_{x}")).alias(f"s_{x}") for x in cols])


def first_largest(asked: DataFrame, signal: DataFrame, value: str, keys: list[str], order: str = "row_idx", block: int = clean.BLOCK) -> DataFrame:
    """`asked` (keys, `_lo`, `_hi`, and what else tells its rows apart) with the largest value of the signal between, and the first row that has it, per block of
    the signal that the question reaches."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields)
    names = asked.columns

    def answer(row: np.ndarray, v: np.ndarray, q: dict) -> list[tuple]:
        k = int(v.argmax())
        return [(*[q[n] for n in names], int(row[k]), float(v[k]))]

    return _over_blocks(signal, asked, keys, answer, f"{kinds}, `{order}` long, `{value}` double", order, value, block)


def at_rows(df: DataFrame, signal: DataFrame, cols: list[str], rows: dict[str, Column], keys: list[str], names: dict[str, tuple[str, str]], order: str = "row_idx", block: int = clean.BLOCK) -> DataFrame:
    """Looks up columns of `signal`, and their sums up to a row (`s_` + name), at some rows of each interval; 0 outside the series.

    rows: place -> row number, given the interval's start and end (and what its keys fix). names: new column -> (place, column).
    """
    c, interval = F.col, [*keys, "start", "end"]
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("place"), v.cast("long").alias("row")) for k, v in rows.items()])).alias("_w")
    asked = df.select(*interval, wanted).select(*interval, c("_w.place").alias("_place"), c("_w.row").alias("_lo"), c("_w.row").alias("_hi")).distinct()
    met = rows_within(asked, signal, cols, keys, order, block)
    found = met.groupBy(*interval).agg(*[F.max(F.when(c("_place") == place, c(col))).alias(new) for new, (place, col) in names.items()])
    return df.join(found, interval, "left").fillna(0.0, list(names))


def segment_confidence(segments: DataFrame, signal: DataFrame, keys: list[str], prob: str = "prob_s", boundary: str = "boundary", order: str = "row_idx") -> DataFrame:
    """Adds `confidence`: 0.58 mean probability + 0.32 mean boundary at both ends + 0.10 (1 - relative distance to the median
    length, at most 1). Means come from sums up to a row: three look-ups per interval, whatever its length."""
    c = F.col
    out = at_rows(
        segments, signal, [prob, boundary], {"before": c("start") - 1, "start": c("start"), "end": c("end")}, keys,
        {"_before": ("before", f"s_{prob}"), "_upto": ("end", f"s_{prob}"), "_b0": ("start", boundary), "_b1": ("end", boundary)}, order,
    )
    n, m = c("end") - c("start") + 1, F.greatest(c("median_len"), F.lit(1))
    off = F.least(F.lit(1.0), F.abs(n - m) / m)
    value = F.lit(0.58) * (c("_upto") - c("_before")) / n + F.lit(0.32) * (c("_b0") + c("_b1")) / 2 + F.lit(0.10) * (1 - off)
    return out.withColumn("confidence", value).drop("_before", "_upto", "_b0", "_b1")


def generate_candidates(
    blobs: DataFrame, signal: DataFrame, keys: list[str], quantile: float = 0.88, prob: str = "prob_s", boundary: str = "boundary", order: str = "row_idx", settings: dict[str, int | float] | None = None
) -> DataFrame:
    """Pieces of all blobs with length, center and confidence. `keys` name series, branch and threshold; the signal has them
    but for the threshold. settings: further columns that tell how the blobs were made, alike for all."""
    own = [k for k in keys if k in signal.columns]
    points = candidate_split_points(blobs, signal, keys, quantile, value=boundary, order=order)
    pieces = Scratch(blobs.sparkSession, "pieces").stored(split_blob(blobs, points, keys))  # read twice
    scored = segment_confidence(pieces, signal, own, prob, boundary, order)
    n = F.col("end") - F.col("start") + 1
    return scored.select(*keys, "start", "end", n.alias("length"), ((F.col("start") + F.col("end")) / 2).alias("center"), "confidence", *PRIOR, *[F.lit(v).alias(n) for n, v in (settings or {}).items()])


def candidate_nms_score(candidates: DataFrame, fold: list[str]) -> DataFrame:
    """0.78 x confidence normalised over the fold's pool + 0.22 / (1 + relative distance to the median length)."""
    c = F.col
    scaled = clean.minmax_normalise(candidates.withColumn("confidence_norm", c("confidence")), ["confidence_norm"], fold)
    m = F.greatest(c("median_len"), F.lit(1))
    fit = 1 / (1 + F.abs(c("length") - m) / m)
    return scaled.withColumn("duration_fit", fit).withColumn("nms_score", F.lit(0.78) * c("confidence_norm") + F.lit(0.22) * c("duration_fit"))


def nms(df: DataFrame, keys: list[str], score: str, ord: str, threshold: float = 0.88, strict: bool = False, width: int = greedy.WIDTH) -> DataFrame:
    """Rows kept by score (ties by `ord`): one is dropped if its IoU with a kept one is >= threshold (`strict`: > it). By rounds over blocks of rows."""
    return greedy.greedy_intervals(df, keys, [F.desc(score), F.col(ord)], threshold, strict, width=width)


def nms_diagnostics(before: DataFrame, after: DataFrame, groups: DataFrame, fold: list[str], branches: list[str]) -> DataFrame:
    """Counts before and after, their ratio (1 for an empty pool), and what is left per branch."""
    b = before.groupBy(*fold).agg(F.count("*").alias("n_before"))
    a = after.groupBy(*fold).agg(F.count("*").alias("n_after"), *[F.count_if(F.col("branch") == x).alias(f"n_{x}") for x in branches])
    out = groups.select(*fold).join(b, fold, "left").join(a, fold, "left").fillna(0)
    return out.withColumn("keep_ratio", F.when(F.col("n_before") > 0, F.col("n_after") / F.col("n_before")).otherwise(1.0))
