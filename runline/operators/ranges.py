"""Order without one task per series: rows in ranges of their order, places from counts per range, and what follows from places."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runline.sources.scratch import Scratch


def in_ranges(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """`rows` in the order of `keys` and `order` (a written table): range `_part`, and `_at`, which goes up by one from row to row of a range. Ranges are
    cut by a sample of the rows, so a long series is in several of them."""
    by = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    stored = Scratch(rows.sparkSession, "ranges").stored(rows.repartitionByRange(*by).sortWithinPartitions(*by).select("*", F.monotonically_increasing_id().alias("_at")))
    return stored.withColumn("_part", F.shiftright("_at", 33))


def carried(parts: DataFrame, keys: list[str], **sums: str) -> DataFrame:
    """Per key and range, the sum of a column over the ranges before (new name: column): a table of a row per range."""
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for n, c in sums.items()])


def placed(rows: DataFrame, keys: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """`rows` with their place (from 0) in the order of each value of `keys`. Rows alike in `order` are placed in any order."""
    ranged = in_ranges(rows, keys, order)
    runs = ranged.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_k"))
    runs = carried(runs, keys, _before="_k")
    runs = runs.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_range"), (F.col("_before") - F.col("_first")).alias("_add"))
    on = F.col("_part") == F.col("_range")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return ranged.join(runs, on).select(*rows.columns, (F.col("_at") + F.col("_add")).cast("long").alias(name))


def percentiles(rows: DataFrame, keys: list[str], value: str, points: list[float]) -> DataFrame:
    """(keys, point, value): exact percentiles with linear interpolation, nulls left out. Of each group only the two values beside a point's rank are
    taken from its ranges; none is held whole."""
    c = F.col
    known = placed(rows.where(c(value).isNotNull()).select(*keys, c(value).cast("double").alias("_v")), keys, ["_v"], "_pos")
    sizes = rows.where(c(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("_n"))
    asked = sizes.select(*keys, "_n", F.explode(F.array(*[F.lit(float(p)) for p in points])).alias("point")).withColumn("_h", (c("_n") - 1) * c("point"))
    low, high = F.floor("_h"), F.ceil("_h")
    parts = F.when(low == high, F.array(F.struct(low.alias("at"), F.lit(1.0).alias("share")))).otherwise(
        F.array(F.struct(low.alias("at"), (high - c("_h")).alias("share")), F.struct(high.alias("at"), (c("_h") - low).alias("share")))
    )
    asked = asked.select(*[c(k).alias(f"_k_{k}") for k in keys], "point", F.explode(parts).alias("_p"))
    on = c("_pos") == c("_p.at")
    for k in keys:
        on = on & c(k).eqNullSafe(c(f"_k_{k}"))
    return known.join(asked, on).groupBy(*keys, "point").agg(F.sum(c("_v") * c("_p.share")).alias("value"))
