"""Cleaning and projection of session rows. A series is named by `keys`; its rows are ordered by `order`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a block: a longer series is worked on block by block, over many tasks.
BLOCK = 50_000

_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def to_number(df: DataFrame, name: str) -> Column:
    """A finite double, or null. Texts such as '1d', 'inf' and 'true' are null; a boolean column is 1/0."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.BooleanType):
        return c.cast("int").cast("double")
    if isinstance(kind, T.StringType):
        return F.when(c.rlike(_NUMBER), F.trim(c).try_cast("double"))
    number = c.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def clean_numeric(df: DataFrame, cols: list[str], keys: list[str], order: str = "row_idx", block: int | None = BLOCK) -> DataFrame:
    """Text to double, non-finite to null, then filled forward, backward, and with 0; fills reach over the whole series.

    Only nulls before the first value need the backward fill, and that is the series' first value. A series is filled in
    blocks of so many rows, over many tasks; what each block ends with is carried on by a small table (a row per block).
    `block` None: by windows over the whole series, for short ones.
    """
    whole = Window.partitionBy(*keys).orderBy(order)
    parsed = df.withColumns({c: to_number(df, c) for c in cols})
    if block is None:
        back, all_rows = whole.rowsBetween(Window.unboundedPreceding, 0), whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return parsed.withColumns({c: F.coalesce(F.last(c, True).over(back), F.first(c, True).over(all_rows), F.lit(0.0)) for c in cols})
    parsed = parsed.withColumn("_block", F.floor(F.col(order) / block))
    inner = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = parsed.withColumns({c: F.last(c, True).over(inner) for c in cols})

    def edge(c: str, best) -> Column:
        return best(F.col(c), F.when(F.col(c).isNotNull(), F.col(order)))

    ends = parsed.groupBy(*keys, "_block").agg(
        *[edge(c, F.max_by).alias(f"_last_{c}") for c in cols], *[edge(c, F.min_by).alias(f"_first_{c}") for c in cols]
    )
    blocks = Window.partitionBy(*keys).orderBy("_block")
    before, after = blocks.rowsBetween(Window.unboundedPreceding, -1), blocks.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = ends.select(
        *keys, "_block", *[F.coalesce(F.last(f"_last_{c}", True).over(before), F.first(f"_first_{c}", True).over(after), F.lit(0.0)).alias(f"_carry_{c}") for c in cols]
    )
    joined = filled.join(carried, [*keys, "_block"], "left")
    return joined.withColumns({c: F.coalesce(c, f"_carry_{c}") for c in cols}).select(*df.columns)


def label_int(df: DataFrame, label: str, keys: list[str], order: str = "row_idx") -> DataFrame:
    """The cleaned label, truncated to int."""
    return clean_numeric(df, [label], keys, order).withColumn(label, F.col(label).cast("int"))


def drop_null_labels(df: DataFrame, label: str) -> DataFrame:
    """Rows whose label is a number, with the label truncated to int."""
    return df.withColumn(label, to_number(df, label)).dropna(subset=[label]).withColumn(label, F.col(label).cast("int"))


def remove_production(df: DataFrame, valid: list[int], keys: list[str], label: str = "phase", order: str = "row_idx", target: int = 2, block: int = BLOCK) -> DataFrame:
    """Rows of the valid phases with `original_row`, a compact `removed_row`, and `target_phase2`. Rows are numbered within
    blocks; how many the blocks before have, comes from a small table."""
    kept = df.where(F.col(label).isin(list(valid))).withColumn("_block", F.floor(F.col(order) / block))
    counts = kept.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(order)) - 1
    numbered = kept.withColumn("_inside", inside).join(counts, [*keys, "_block"])
    out = numbered.withColumns({"original_row": F.col(order).cast("long"), "removed_row": (F.col("_before") + F.col("_inside")).cast("long"), "target_phase2": (F.col(label) == target).cast("int")})
    return out.select(*df.columns, "original_row", "removed_row", "target_phase2")


def select_feature_group(df: DataFrame, cols: list[str], keep: list[str]) -> DataFrame:
    """`keep` and the sensors in order; an absent one is a constant 0."""
    return df.select(*keep, *[F.col(c) if c in df.columns else F.lit(0.0).alias(c) for c in cols])


def finite(c: Column) -> Column:
    """Null, NaN and infinities as 0."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)


def minmax_normalise(df: DataFrame, cols: list[str], keys: list[str], within: Column | None = None) -> DataFrame:
    """Each column to 0..1 within its series; all 0 where it is constant. The ends come from an aggregate (of the rows for
    which `within` holds), a row per series, joined back: no task holds a series. `df` is read twice; store it if it is dear."""
    ready = df.withColumns({c: finite(F.col(c).cast("double")) for c in cols})
    ends = (ready if within is None else ready.where(within)).groupBy(*keys).agg(*[f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])

    def scaled(c: str) -> Column:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        return F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(0.0)

    return ready.join(ends, keys).withColumns({c: scaled(c) for c in cols}).select(*df.columns)


def session_profile(df: DataFrame, label: str, segments: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, share of positive labels, number of true intervals; a session without intervals has 0."""
    rows = df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.avg((F.col(label) == 1).cast("double")).alias("positive_ratio"))
    found = segments.groupBy(*keys).agg(F.count("*").alias("n_segments"))
    return rows.join(found, keys, "left").fillna(0, ["n_segments"])
