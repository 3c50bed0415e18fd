"""Connected components of a table of links, by large-star and small-star steps over tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runline.llm.scratch import Scratch


def _join_in_task(batches):
    """Links of each node of a batch of links to the smallest one that the batch connects it with: fewer, and shorter chains."""
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        nodes, links = np.unique(np.concatenate([a, b]), return_inverse=True)
        u, v = links[: len(a)], links[len(a) :]
        least = np.arange(len(nodes))
        while True:
            fresh = least.copy()
            low = np.minimum(least[u], least[v])
            for x in (u, v):
                np.minimum.at(fresh, x, low)
                np.minimum.at(fresh, least[x], low)
            fresh = fresh[fresh]
            if (fresh == least).all():
                break
            least = fresh
        moved = np.flatnonzero(least != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[least[moved]])], ["u", "v"])


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(node, component) of every node of `links` (a, b: longs) that has a link to another one; the component is its smallest
    node. links: a stored table.

    Links are first contracted batch by batch. Each step replaces links by links to smaller neighbours and is written, so
    nothing is recomputed; a node with many links is aggregated before it is shuffled. Steps grow with the logarithm of the
    longest path.
    """
    edges = links.select("a", "b").where("a <> b").mapInArrow(_join_in_task, "u long, v long").distinct()
    edges, state = scratch.stored(edges), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = scratch.stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(edges)
        edges = step
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
