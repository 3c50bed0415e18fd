"""Signals along the rows: how likely a boundary is, and how well the branches' probabilities support an interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runline.operators import clean, temporal
from runline.sources.scratch import Scratch


def branch_boundary_signals(df: DataFrame, branches: dict[str, tuple[list[str], float]], keys: list[str], order: str = "row_idx", inner: int = 9, outer: int = 7, block: int = clean.BLOCK) -> DataFrame:
    """keys, order, and a signal per branch (name: sensors, weight of jumps). Per present sensor (1 - jump) x normalised smoothed
    |difference| + jump x normalised changes, summed, smoothed, normalised. Sensors that the table lacks are skipped. What a
    sensor gives is computed once for all branches; all windows are over blocks with a halo. What is normalised is read twice, so it is written first."""
    c, present = F.col, [x for x in dict.fromkeys(x for sensors, _ in branches.values() for x in sensors) if x in df.columns]
    rows = clean.clean_numeric(df.select(*keys, order, *present), present, keys, order, block)
    spread = temporal.in_blocks(rows, keys, inner // 2 + outer // 2 + 2, order, block)
    part = [*keys, "_block"]
    steps = spread.select(
        *part, order, "_own",
        *[F.abs(temporal.row_diff(x, part, order)).alias(f"d_{x}") for x in present],
        *[temporal.change_flag(x, part, order).alias(f"j_{x}") for x in present],
    )
    smoothed = steps.withColumns({f"d_{x}": temporal.running_mean(f"d_{x}", inner, part, order) for x in present}) if inner > 1 else steps
    scratch = Scratch(df.sparkSession, "signals")
    scaled = clean.minmax_normalise(scratch.stored(smoothed), [f"{k}_{x}" for x in present for k in "dj"], keys, c("_own")) if present else smoothed

    def total(sensors: list[str], jump: float) -> Column:
        out = F.lit(0.0)
        for x in sensors:
            if x in present:
                out = out + F.lit(1.0 - jump) * c(f"d_{x}") + F.lit(jump) * c(f"j_{x}")
        return out

    summed = scaled.select(*part, order, "_own", *[total(*spec).alias(f"_{b}") for b, spec in branches.items()])
    out = summed.withColumns({b: temporal.running_mean(f"_{b}", outer, part, order) if outer > 1 else c(f"_{b}") for b in branches}).where("_own")
    return clean.minmax_normalise(scratch.stored(out.select(*keys, order, *branches)), list(branches), keys)


def branch_boundary_signal(df: DataFrame, sensors: list[str], jump: float, keys: list[str], order: str = "row_idx", name: str = "boundary", inner: int = 9, outer: int = 7, block: int = clean.BLOCK) -> DataFrame:
    """keys, order, and the signal of one branch."""
    return branch_boundary_signals(df, {name: (sensors, jump)}, keys, order, inner, outer, block)


def global_boundary_signal(program: DataFrame, physical: DataFrame, keys: list[str], order: str = "row_idx", name: str = "boundary") -> DataFrame:
    """0.55 program + 0.45 physical, normalised; both inputs have `boundary`."""
    p = program.withColumnRenamed("boundary", "_p").join(physical.withColumnRenamed("boundary", "_q"), [*keys, order])
    mixed = p.select(*keys, order, (F.lit(0.55) * F.col("_p") + F.lit(0.45) * F.col("_q")).alias(name))
    return clean.minmax_normalise(mixed, [name], keys)


def probability_support_track(df: DataFrame, program: str, physical: str, both: str, keys: list[str], order: str = "row_idx", name: str = "support", w: int = 21) -> DataFrame:
    """0.40, 0.25 and 0.35 of the three normalised probabilities, smoothed, normalised."""
    scaled = clean.minmax_normalise(df.select(*keys, order, *[F.col(c).alias(a) for c, a in ((program, "_a"), (physical, "_b"), (both, "_c"))]), ["_a", "_b", "_c"], keys)
    mixed = scaled.select(*keys, order, (F.lit(0.40) * F.col("_a") + F.lit(0.25) * F.col("_b") + F.lit(0.35) * F.col("_c")).alias("_m"))
    smoothed = temporal.smooth_rows(mixed, {name: "_m"}, w, keys, order)
    return clean.minmax_normalise(smoothed.select(*keys, order, name), [name], keys)
