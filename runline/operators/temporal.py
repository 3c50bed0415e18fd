"""Centred windows over the row axis: rows i - w//2 ... i + (w-1)//2, cut at the ends of the series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runline.operators.clean import BLOCK, finite


def ordered(keys: list[str], order: str = "row_idx") -> Window:
    return Window.partitionBy(*keys).orderBy(order)


def centred(keys: list[str], w: int, order: str = "row_idx") -> Window:
    return ordered(keys, order).rowsBetween(-(w // 2), (w - 1) // 2)


def row_diff(c: str, keys: list[str], order: str = "row_idx") -> Column:
    """x[i] - x[i-1]; 0 for the first row."""
    return F.coalesce(F.col(c) - F.lag(c).over(ordered(keys, order)), F.lit(0.0))


def change_flag(c: str, keys: list[str], order: str = "row_idx") -> Column:
    """1 where the value differs from the row before; 0 for the first row."""
    return F.coalesce((F.col(c) != F.lag(c).over(ordered(keys, order))).cast("double"), F.lit(0.0))


def step_rows(df: DataFrame, cols: dict[str, tuple[str, str]], keys: list[str], order: str = "row_idx", block: int = BLOCK) -> DataFrame:
    """`df` with, for each new name, the `diff`, `absdiff` or `change` of a column from row to row (see `row_diff`, `change_flag`). Over blocks with a halo of
    one row, so a series of any length is spread over tasks."""
    part = [*keys, "_block"]
    kinds = {"diff": row_diff, "absdiff": lambda *a: F.abs(row_diff(*a)), "change": change_flag}
    steps = in_blocks(df, keys, 1, order, block).withColumns({n: kinds[kind](c, part, order) for n, (c, kind) in cols.items()})
    return steps.where("_own").select(*df.columns, *cols)


def rolling_mean(c: str, w: int, keys: list[str], order: str = "row_idx") -> Column:
    return F.avg(c).over(centred(keys, w, order))


def rolling_std(c: str, w: int, keys: list[str], order: str = "row_idx") -> Column:
    """Sample deviation; 0 where the window has one row."""
    return F.coalesce(F.stddev_samp(c).over(centred(keys, w, order)), F.lit(0.0))


def smooth(c: str, w: int, keys: list[str], order: str = "row_idx") -> Column:
    """Centred mean; the column itself for w <= 1. For short series; `smooth_rows` has no task per series."""
    return F.col(c) if w <= 1 else rolling_mean(c, w, keys, order)


def running_mean(c: str, w: int, keys: list[str], order: str = "row_idx") -> Column:
    """Centred mean as a difference of two running sums: work per row does not grow with `w`. Cancellation costs digits as
    the series grows, so use it on series of bounded length (blocks)."""
    up, down = ordered(keys, order).rowsBetween(Window.unboundedPreceding, (w - 1) // 2), ordered(keys, order).rowsBetween(Window.unboundedPreceding, -(w // 2) - 1)
    total = F.coalesce(F.sum(c).over(up), F.lit(0.0)) - F.coalesce(F.sum(c).over(down), F.lit(0.0))
    n = F.count(c).over(up) - F.count(c).over(down)
    return F.when(n > 0, total / n)


def smooth_rows(df: DataFrame, cols: dict[str, str], w: int, keys: list[str], order: str = "row_idx", block: int = BLOCK) -> DataFrame:
    """`df` with centred means (new name: column). Over blocks with a halo, so a series of any length is spread over tasks."""
    if w <= 1:
        return df.withColumns({n: F.col(c).cast("double") for n, c in cols.items()})
    spread = in_blocks(df, keys, w // 2 + 1, order, block)
    means = spread.withColumns({f"_m_{n}": running_mean(c, w, [*keys, "_block"], order) for n, c in cols.items()})
    own = means.where("_own").withColumns({n: F.col(f"_m_{n}") for n in cols})
    return own.select(*dict.fromkeys([*df.columns, *cols]))


def rolling_rows(df: DataFrame, cols: dict[str, tuple[str, str, int]], keys: list[str], order: str = "row_idx", block: int = BLOCK) -> DataFrame:
    """`keys`, `order` and, for each name, a statistic (`mean`, `std`, `absdiff_mean`, `diff`) of a column over `w` rows; the
    same plan as temporal_features, for a choice of columns."""
    reach = max(w for _, _, w in cols.values()) // 2 + 1
    used = list(dict.fromkeys(c for c, _, _ in cols.values()))
    spread = in_blocks(df.select(*keys, order, *used), keys, reach, order, block)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable").reset_index(drop=True)
        out = {k: part[k] for k in [*keys, order]}
        for name, (c, stat, w) in cols.items():
            x = part[c].astype(float)
            if stat in ("absdiff_mean", "diff"):
                x = x.diff().fillna(0.0)
            out[name] = x if stat == "diff" else _rolling(x.abs() if stat == "absdiff_mean" else x, w)._over("std" if stat == "std" else "mean").fillna(0.0)
        return pd.DataFrame(out)[part["_own"].to_numpy()]

    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [*keys, order]] + [f"`{c}` double" for c in cols])
    return spread.groupBy(*keys, "_block").applyInPandas(run, schema)


def in_blocks(df: DataFrame, keys: list[str], reach: int, order: str = "row_idx", block: int = BLOCK) -> DataFrame:
    """Rows with `_block`, and the `reach` rows on either side of a block copied into it (`_own` false).

    A series of any length is spread over tasks; rows near a border are copied once, or more where reach > block.
    """
    at = F.col(order)
    first, last = F.floor((at - reach) / block), F.floor((at + reach) / block)
    copies = df.withColumn("_block", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    return copies.withColumn("_own", F.floor(at / block) == F.col("_block"))


def rolling_columns(cols: list[str], windows: list[int], diffs: bool) -> list[str]:
    out = []
    for c in cols:
        out += [c, *([f"{c}_diff1", f"{c}_absdiff1"] if diffs else [])]
        out += [f"{c}_{k}_{w}" for w in windows for k in ("mean", "std", "absdiff_mean")]
    return out


def temporal_features(
    df: DataFrame, cols: list[str], windows: list[int], keys: list[str], keep: list[str] | None = None, with_diff: bool = False, order: str = "row_idx", block: int = BLOCK
) -> DataFrame:
    """`keys`, `order`, `keep`, and for each sensor: itself, [diff1, absdiff1], and per window mean, std and mean of the absolute
    differences. All sensors and windows in one pass over blocks with a halo, so work per row does not grow with a window.
    """
    keep = [*keys, order, *(keep or [])]
    names = rolling_columns(cols, windows, with_diff)
    reach = max(windows, default=1) // 2 + 1
    spread = in_blocks(df.select(*dict.fromkeys([*keep, *cols])), keys, reach, order, block)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable").reset_index(drop=True)
        own, out = part["_own"].to_numpy(), {c: part[c] for c in keep}
        for c in cols:
            x = part[c].astype(float)
            diff = x.diff().fillna(0.0)
            if part[order].iloc[0] > 0:
                diff.iloc[0] = 0.0  # a halo row: used only beyond the reach of the block's own rows
            out[c] = x
            if with_diff:
                out[f"{c}_diff1"], out[f"{c}_absdiff1"] = diff, diff.abs()
            for w in windows:
                out[f"{c}_mean_{w}"] = _rolling(x, w).mean()
                out[f"{c}_std_{w}"] = _rolling(x, w).std().fillna(0.0)
                out[f"{c}_absdiff_mean_{w}"] = _rolling(diff.abs(), w).mean()
        frame = pd.DataFrame(out)[own]
        frame[names] = frame[names].replace([np.inf, -np.inf], np.nan).fillna(0.0)
        return frame[[*keep, *names]]

    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"`{c}` double" for c in names])
    return spread.groupBy(*keys, "_block").applyInPandas(run, schema)


class _rolling:
    """Centred windows of pandas reach (w-1)//2 rows back; ours w//2."""

    def __init__(self, x: pd.Series, w: int):
        self.x, self.w, self.n = x, w, len(x)

    def _over(self, stat: str) -> pd.Series:
        ahead = (self.w - 1) // 2
        padded = pd.concat([self.x, pd.Series([np.nan] * ahead)], ignore_index=True)
        rolled = getattr(padded.rolling(self.w, min_periods=1), stat)()
        return rolled.iloc[ahead:].reset_index(drop=True)

    def mean(self) -> pd.Series:
        return self._over("mean")

    def std(self) -> pd.Series:
        return self._over("std")


def temporal_features_sql(df: DataFrame, cols: list[str], windows: list[int], keys: list[str], keep: list[str] | None = None, with_diff: bool = False, order: str = "row_idx") -> DataFrame:
    """The same by window frames only: for narrow tables and short windows."""
    keep = [*keys, order, *(keep or [])]
    df = df.select(*dict.fromkeys([*keep, *cols])).withColumns({f"_d_{c}": row_diff(c, keys, order) for c in cols})
    df = df.withColumns({f"_a_{c}": F.abs(f"_d_{c}") for c in cols})
    out = {}
    for c in cols:
        out[c] = F.col(c).cast("double")
        if with_diff:
            out[f"{c}_diff1"], out[f"{c}_absdiff1"] = F.col(f"_d_{c}"), F.col(f"_a_{c}")
        for w in windows:
            out[f"{c}_mean_{w}"] = rolling_mean(c, w, keys, order)
            out[f"{c}_std_{w}"] = rolling_std(c, w, keys, order)
            out[f"{c}_absdiff_mean_{w}"] = rolling_mean(f"_a_{c}", w, keys, order)
    return df.select(*keep, *[finite(v).alias(n) for n, v in out.items()])


def make_xy(features: DataFrame, labels: DataFrame, segments: DataFrame, keys: list[str], label: str, order: str = "row_idx", bin: int = 4096) -> DataFrame:
    """Features with the label and the number (from 0) of the true interval a row is in, null outside. Rows and intervals
    meet by buckets of `bin` rows."""
    rows = features.join(labels.select(*keys, order, label), [*keys, order]).withColumn("_b", F.floor(F.col(order) / bin))
    own = segments.select(*keys, F.col("seg_no").alias("segment"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    own = own.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_start") / bin), F.floor(F.col("_end") / bin))))
    on = [rows[k] == own[k] for k in [*keys, "_b"]] + [rows[order].between(own["_start"], own["_end"])]
    joined = rows.join(own, on, "left")
    return joined.select(*[rows[c] for c in rows.columns if c != "_b"], "segment")
