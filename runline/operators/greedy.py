"""Greedy choice by rounds: what walking the whole list by rank would keep, without a list.

Every item knows the places where items lie that can conflict with it. Items are dealt to blocks of places, and as copies to the blocks beside
that they can reach. A block is walked by rank: an item that conflicts with a kept one is dropped; one that conflicts with an undecided one
is undecided; a copy from another block that conflicts with neither is undecided too, as items further off may drop it; an item of the block
itself is kept. What is kept or dropped so is final, so the next round has the undecided items alone, beside those kept just before, and its
blocks are wider while they hold few enough. Each round decides at least the highest open item of every chain.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runline.sources.scratch import Scratch

#: Places in a block at first, and open items that a block may have for the next ones to be four times as wide.
WIDTH, MOST_OPEN = 1 << 18, 100_000

KEPT, OPEN = 1, 2


class Overlaps:
    """Intervals (start, end) conflict if their IoU is >= `threshold` (`strict`: > it); the same interval always does."""

    def __init__(self, threshold: float, strict: bool = False):
        if threshold <= 0:
            raise ValueError("only a threshold above 0 bounds what an interval can conflict with")
        self.threshold, self.strict, self.spread = threshold, strict, max(0, math.ceil(math.log2(1 / min(1.0, threshold))))
        self.cells: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def fresh(self) -> Overlaps:
        return Overlaps(self.threshold, self.strict)

    def add(self, start: int | None, end: int | None) -> None:
        if start is not None and end is not None and end >= start:
            q = (end - start + 1).bit_length() - 1
            self.cells.setdefault((q, start >> q), []).append((start, end))

    def meets(self, start: int | None, end: int | None) -> bool:
        """Conflicting intervals differ in length by at most the threshold's ratio, so few cells of length and start hold them."""
        if start is None or end is None or end < start:
            return False
        n, t = end - start + 1, min(1.0, self.threshold)
        q, back, on = n.bit_length() - 1, int(n * (1 / t - 1)) + 1, int(n * (1 - t)) + 1
        for size in range(max(0, q - self.spread), q + self.spread + 1):
            for cell in range((start - back) >> size, ((start + on) >> size) + 1):
                for a, b in self.cells.get((size, cell), ()):
                    inter = min(b, end) - max(a, start) + 1
                    if inter > 0:
                        iou = inter / (b - a + 1 + n - inter)
                        if iou > self.threshold or (iou == self.threshold and not self.strict) or (a == start and b == end):
                            return True
        return False


class Shared:
    """Pairs conflict if they have a side in common."""

    def __init__(self):
        self.sides: tuple[set, set] = (set(), set())

    def fresh(self) -> Shared:
        return Shared()

    def add(self, *pair: int) -> None:
        for side, x in zip(self.sides, pair, strict=True):
            side.add(x)

    def meets(self, *pair: int) -> bool:
        return any(x in side for side, x in zip(self.sides, pair, strict=True))


def _walk(names: list[str], group: list[str], shape: list[str], rule):
    """Batches sorted by block, settled items first, then by rank. Gives the block's own items that are kept now or still open."""

    def run(batches):
        at, kept, open_ = None, rule.fresh(), rule.fresh()
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            blocks = zip(*[column[g].to_pylist() for g in group], strict=True)
            items = zip(*[column[s].to_pylist() for s in shape], strict=True)
            rows, states = [], []
            for i, (block, item, own, settled) in enumerate(zip(blocks, items, column["_own"].to_pylist(), column["_settled"].to_pylist(), strict=True)):
                if block != at:
                    at, kept, open_ = block, rule.fresh(), rule.fresh()
                if settled:
                    kept.add(*item)
                elif kept.meets(*item):
                    continue
                elif open_.meets(*item) or not own:
                    open_.add(*item)
                    if own:
                        rows.append(i)
                        states.append(OPEN)
                else:
                    kept.add(*item)
                    rows.append(i)
                    states.append(KEPT)
            taken = batch.select(names).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(states, pa.int32())], names=[*names, "_state"])

    return run


def greedy(items: DataFrame, keys: list[str], order: list[Column], rule, shape: list[str], place: Column, low: Column, high: Column, settled: str | None = None, width: int = WIDTH) -> DataFrame:
    """Rows of `items` that are kept when each value of `keys` is walked in `order`, and a row is dropped if it conflicts (`rule`, over the columns
    `shape`) with one kept before.

    place: where a row stands; low, high: between these stands every row that it can conflict with. settled: a boolean column of rows that are kept
    beforehand; they are not returned. Rows alike in `order` are taken in the order of `shape`. Nulls in `shape` conflict with nothing.
    """
    scratch, names = Scratch(items.sparkSession, "greedy"), items.columns
    where = F.coalesce(place.cast("long"), F.lit(0))
    rows = items.withColumns({"_place": where, "_low": F.coalesce(low.cast("long"), where), "_high": F.coalesce(high.cast("long"), where), "_settled": F.coalesce(settled, F.lit(False)) if settled else F.lit(False)})
    kept = None
    while True:
        blocks = F.explode(F.sequence(F.floor(F.col("_low") / width), F.floor(F.col("_high") / width)))
        dealt = rows.withColumn("_block", blocks).withColumn("_own", F.col("_block") == F.floor(F.col("_place") / width))
        group = [*keys, "_block"]
        dealt = dealt.repartition(*group).sortWithinPartitions(*group, F.desc("_settled"), *order, *shape)
        carried = [*names, "_place", "_low", "_high"]
        schema = rows.select(*carried).withColumn("_state", F.lit(0)).schema
        found = scratch.stored(dealt.mapInArrow(_walk(carried, group, shape, rule), schema))
        now = found.where(f"_state = {KEPT}").select(*names)
        kept = now if kept is None else kept.unionByName(now)
        left = found.where(f"_state = {OPEN}")
        most = left.groupBy(*keys, F.floor(F.col("_place") / (4 * width)).alias("_wider")).count().agg(F.max("count")).first()[0]
        if most is None:
            return kept
        width = 4 * width if most <= MOST_OPEN else width
        rows = found.select(*carried, (F.col("_state") == KEPT).alias("_settled"))


def greedy_intervals(items: DataFrame, keys: list[str], order: list[Column], threshold: float, strict: bool = False, settled: str | None = None, width: int = WIDTH) -> DataFrame:
    """`greedy` over intervals `start`, `end`, two of which conflict by their IoU. Such intervals together are at most one of them over the threshold
    long, so their starts are near."""
    t, n, start = min(1.0, threshold), F.col("end") - F.col("start") + 1, F.col("start")
    back = F.when(n > 0, F.ceil(n * (1 / t - 1))).otherwise(0)
    return greedy(items, keys, order, Overlaps(threshold, strict), ["start", "end"], start, start - back - 1, start + back + 1, settled, width)
