"""Ordered scans with a carried state, in parallel: blocks of places are walked on their own, from the state that enters each one.

The first pass takes no state to enter any block. What each block ends with goes into a small table (a row per block); a block that
is entered with another state than it was walked with, is walked again, until none is left. Walks from different states tend to meet, so
few passes are needed; the first block of every series that is not settled yet is settled by each pass.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from runline.sources.scratch import Scratch

#: Places in a block.
WIDTH = 1 << 18


def _walk(group: list[str], values: list[str], out: pa.Schema, step):
    """Batches sorted by block and order; the state that enters a block is on each of its rows."""

    def run(batches):
        at, state = None, None
        rows: list[tuple] = []

        def told():
            columns = zip(*rows, strict=True) if rows else [[]] * len(out)
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, out, strict=True)], schema=out)
            rows.clear()
            return batch

        width = len(out) - len(group) - 1

        def close():
            if at is not None:
                rows.append((*at, *[None] * width, state))

        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            blocks = zip(*[column[g].to_pylist() for g in group], strict=True)
            items = zip(*[column[v].to_pylist() for v in values], strict=True)
            for block, item, entry in zip(blocks, items, column["_entry"].to_pylist(), strict=True):
                if block != at:
                    close()
                    at, state = block, entry
                state, found = step(state, *item)
                rows += [(*block, *f, None) for f in found]
            yield told()
        close()
        yield told()

    return run


def scan(rows: DataFrame, keys: list[str], order: list[Column], place: Column, values: list[str], step, out: str, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Walks each series in `order`: `step(state, *values)` gives the next state (a list of floats) and a list of rows of `out`; the state is None
    at the start. Returns those rows with the block that they come from (`_block`), and per block the state it ends with (`_exit`).

    place: a number that does not decrease in the order; rows of one block of places are walked by one task, as a stream.
    """
    scratch, group = Scratch(rows.sparkSession, "scan"), [*keys, "_block"]
    rows = scratch.stored(rows.withColumn("_block", F.floor(place / width).cast("long")))
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in group)
    schema = rows.sparkSession.createDataFrame([], f"{kinds}, {out}, _exit array<double>").schema
    walk = _walk(group, values, to_arrow_schema(schema), step)
    w = Window.partitionBy(*keys).orderBy("_block")
    entries = scratch.stored(rows.select(*group).distinct().withColumn("_entry", F.lit(None).cast("array<double>")))
    passes, exits = [], None
    while True:
        met = rows.join(entries, group).repartition(*group).sortWithinPartitions(*group, *order)
        number = len(passes)
        passes.append(scratch.stored(met.mapInArrow(walk, schema)))
        fresh = passes[-1].where("_exit is not null").select(*group, "_exit", F.lit(number).alias("_pass"))
        fresh = fresh.join(entries, group).select(*group, "_exit", "_pass", "_entry")
        if exits is not None:
            fresh = exits.join(fresh.select(*group), group, "left_anti").unionByName(fresh)
        exits = scratch.stored(fresh.withColumn("_due", F.lag("_exit").over(w)).select(*group, "_exit", "_pass", "_entry", "_due"))
        entries = exits.where(~F.col("_due").eqNullSafe(F.col("_entry"))).select(*group, F.col("_due").alias("_entry"))
        if entries.isEmpty():
            break
        exits = exits.drop("_due")
    last = exits.select(*group, "_pass")
    found = None
    for number, one in enumerate(passes):
        own = one.where("_exit is null").drop("_exit")
        own = own if len(passes) == 1 else own.join(last.where(F.col("_pass") == number).select(*group), group)
        found = own if found is None else found.unionByName(own)
    return found, exits.select(*group, "_exit")
