"""Merkle manifest of a dataset: a tree of digests per group of rows, one above the groups, and a proof for every row.

Leaves are put in order once: a range partitioning, whose per-task counts give each leaf its index in its group. Building is event-driven:
a task keeps, for each parent that it met, the indexed digests of the children seen so far. Once there are as many as the group's size says the
parent must have, the parent is emitted and is itself the next event, for its own parent. What is still waiting when a task ends, the
frontier, is shuffled by the ancestor some levels up, so that whole subtrees meet, and the same step goes on there. Leaves come in
order, so a task leaves at most seven nodes a level and side.

Proofs come from the links of nodes to their parents, followed backwards: blocks of four levels, from the top down. A block's task has the path
of its topmost node, and gives each node in it the run around it and its parent's path. No row moves more than its own digest.
"""

from __future__ import annotations

import dataclasses
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runline.llm.scratch import Scratch, partitions

ARITY = 8
#: Levels that meet in one task: a block has at most ARITY ** LEVELS leaves.
LEVELS = 4
#: Rows of digests in one task.
ROWS = 500_000

NODE, OPEN, TOP = 0, 1, 2


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts' texts in a row, each as its UTF-8 byte count, `:` and itself; `-` if it is null."""
    texts = [p.cast("string") for p in parts]
    framed = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*framed), 256))


def as_hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def fold(leaf: Column, path: Column) -> Column:
    """The root (hexadecimal text) that a leaf's digest and its path lead to."""
    return F.aggregate(path, as_hex(leaf), lambda below, run: F.sha2(F.concat(as_hex(run["before"]), below, as_hex(run["after"])), 256))


def _tasks(spark: SparkSession, rows: int) -> int:
    return max(partitions(spark), -(-rows // ROWS))


def _placed(scratch: Scratch, rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` (key, digest, further columns; a stored table) with `pos`, the place within its key by `order`, and `size`, rows of the key."""
    spark = scratch.spark
    # Rows alike in all of `order` are told apart by their place in the stored table, so that no cut is forced to keep them together.
    rows = rows.select("*", F.monotonically_increasing_id().alias("_n"))
    by = [F.col(c).asc_nulls_first() for c in ("key", *order, "_n")]
    rows = rows.repartitionByRange(_tasks(spark, rows.count()), *by).sortWithinPartitions(*by).drop("_n")
    rows = scratch.stored(rows.select("*", F.monotonically_increasing_id().alias("_at")))
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    runs = rows.groupBy("key", "_part").agg(F.min("_at").alias("first"), F.count("*").alias("k"))
    upto = Window.partitionBy("key").orderBy("_part")
    runs = runs.select("key", "_part", (F.sum("k").over(upto) - F.col("k") - F.col("first")).alias("_add"), F.sum("k").over(Window.partitionBy("key")).alias("size"))
    # A key's rows are spread over its parts, so no task of this join has more than a part holds.
    return rows.join(scratch.stored(runs), ["key", "_part"]).withColumn("pos", F.col("_at") + F.col("_add")).drop("_at", "_part", "_add")


def _combine(batches):
    """Events: nodes (key, size, level, pos, digest) in any order. Gives all nodes that become whole, the tops, and what is left open."""
    waiting: dict[tuple, dict[int, bytes]] = {}
    names = ["kind", "key", "size", "level", "pos", "digest"]

    def rows(found):
        types = (pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
        columns = zip(*found, strict=True) if found else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    for batch in batches:
        found = []
        for key, size, level, pos, own in zip(*(batch.column(c).to_pylist() for c in names[1:]), strict=True):
            nodes = -(-size // ARITY**level)
            while nodes > 1:
                parent = pos // ARITY
                children = waiting.setdefault((key, size, level, parent), {})
                children[pos] = own
                if len(children) < min(ARITY, nodes - parent * ARITY):
                    break
                del waiting[key, size, level, parent]
                own = hashlib.sha256("".join(children[c].hex() for c in sorted(children)).encode()).digest()
                level, pos, nodes = level + 1, parent, -(-nodes // ARITY)
                found.append((NODE, key, size, level, pos, own))
            else:
                found.append((TOP, key, size, level, pos, own))
        yield rows(found)
    left = [(OPEN, key, size, level, pos, own) for (key, size, level, _), children in waiting.items() for pos, own in children.items()]
    for low in range(0, len(left), 10_000):
        yield rows(left[low : low + 10_000])


def _block(levels: int) -> Column:
    """Index of a node's ancestor on level `levels`, or of the node itself if it is higher."""
    return F.expr(f"pos div cast(power({ARITY}, greatest(0, {levels} - level)) as bigint)")


def _built(scratch: Scratch, leaves: DataFrame) -> DataFrame:
    """(kind, key, size, level, pos, digest) of all nodes above the leaves, and a row of kind TOP per key. leaves: as _placed gives them."""
    events, levels, steps = leaves.select("key", "size", F.lit(0).alias("level"), "pos", "digest"), 0, []
    kinds = "kind int, key string, size long, level int, pos long, digest binary"
    while True:
        steps.append(scratch.stored(events.mapInArrow(_combine, kinds)))
        frontier = steps[-1].where(f"kind = {OPEN}")
        left = frontier.count()
        if not left:
            break
        levels += LEVELS
        events = frontier.select("key", "size", "level", "pos", "digest").repartition(_tasks(scratch.spark, left), "key", _block(levels))
    out = steps[0]
    for step in steps[1:]:
        out = out.unionByName(step)
    return out.where(f"kind <> {OPEN}")


def _height(size: int) -> int:
    levels = 0
    while size > 1:
        size, levels = -(-size // ARITY), levels + 1
    return levels


_PATH = "array<struct<before: binary, after: binary>>"


def _walk(lowest: int, schema: pa.Schema):
    """One step down: rows sorted by (key, block), the block's own path first, then its nodes from the highest level to the lowest."""
    step = [pa.field("before", pa.binary()), pa.field("after", pa.binary())]

    def run(batches):
        at, own_path, subroot, paths = None, [], None, {}
        out: list[dict] = []
        open_run: list[dict] = []

        def close():
            """All members of a run are known: each gets the digests around it."""
            for i, row in enumerate(open_run):
                level, pos = row["level"], row["pos"]
                above = paths.get((level + 1, pos // ARITY), own_path)
                if -(-row["size"] // ARITY**level) > 1:
                    run_of = (b"".join(r["digest"] for r in open_run[:i]), b"".join(r["digest"] for r in open_run[i + 1 :]))
                    above = [run_of, *above]
                if level > lowest:
                    paths[level, pos] = above
                else:
                    row["path"], row["subroot"] = above, subroot
                    out.append(row)
            open_run.clear()

        def told():
            offsets, before, after = [0], [], []
            for row in out:
                for a, b in row["path"]:
                    before.append(a)
                    after.append(b)
                offsets.append(len(before))
            runs = pa.StructArray.from_arrays([pa.array(before, pa.binary()), pa.array(after, pa.binary())], fields=step)
            done = {"path": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs)}
            arrays = [done[f.name].cast(f.type) if f.name in done else pa.array([r[f.name] for r in out], f.type) for f in schema]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for whole in batches:
            for low in range(0, whole.num_rows, 2000):
                for row in whole.slice(low, 2000).to_pylist():
                    if (row["key"], row["block"]) != at:
                        close()
                        at, paths = (row["key"], row["block"]), {}
                    if row["level"] is None:
                        own_path, subroot = [(r["before"], r["after"]) for r in row["path"]], row["subroot"]
                        continue
                    if open_run and (open_run[0]["level"], open_run[0]["pos"] // ARITY) != (row["level"], row["pos"] // ARITY):
                        close()
                    open_run.append(row)
                yield told()
        close()
        yield told()

    return run


def _proved(scratch: Scratch, leaves: DataFrame, nodes: DataFrame, tops: DataFrame, tallest: int, carried: list[str]) -> DataFrame:
    """`leaves` with `path` and `subroot`. tops: (key, size, path, subroot) per key; `tallest`: size of the largest key."""
    spark = scratch.spark
    steps = max(1, -(-_height(tallest) // LEVELS))
    # Levels above the leaves, by size: a group enters at the step in which its top is.
    bounds = [(ARITY ** (LEVELS * j), ARITY ** (LEVELS * (j + 1))) for j in range(steps)]
    kinds = {f.name: f.dataType for f in leaves.schema}
    above, tasks = None, _tasks(spark, leaves.count())
    for j in reversed(range(steps)):
        more, most = bounds[j]
        lowest, highest = LEVELS * j, LEVELS * (j + 1)
        entered = tops.where((F.col("size") <= most) & ((F.col("size") > more) | F.lit(j == 0))).select("key", F.lit(0).cast("long").alias("block"), "size", "path", "subroot")
        above = entered if above is None else entered.unionByName(above.select("key", F.col("pos").alias("block"), "size", "path", "subroot"))
        # Nodes of these levels but the tops, which stand for themselves in `above`.
        inner = nodes.where((F.col("kind") == NODE) & (F.col("level") >= lowest) & (F.col("level") < highest) & (F.col("size") > F.pow(F.lit(float(ARITY)), F.col("level"))))
        inner = inner.select("key", "size", "level", "pos", "digest")
        if j == 0:
            inner = inner.unionByName(leaves.withColumn("level", F.lit(0)), allowMissingColumns=True)
        rows = inner.withColumn("block", _block(highest)).unionByName(above, allowMissingColumns=True)
        by = ["key", "block", F.col("level").desc_nulls_first(), "pos"]
        rows = rows.repartition(tasks if j == 0 else partitions(spark), "key", "block").sortWithinPartitions(*by)
        names = ["key", "size", "pos", "digest", *(carried if j == 0 else [])]
        schema = spark.createDataFrame([], f"path {_PATH}, subroot binary").schema
        for name in names:
            schema = schema.add(name, kinds[name])
        found = rows.mapInArrow(_walk(lowest, _arrow(schema)), schema)
        above = found if j == 0 else scratch.stored(found)
    return above


def _arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


@dataclasses.dataclass
class Manifest:
    """Tables of a dataset's tree: `nodes` (kind, key, size, level, pos, digest) above the leaves of all groups, `subroots` (key, size, digest), the
    `root` (None for no rows), and `proofs`: the given rows with `path`, their runs from the leaf up to the root, and `subroot`."""

    nodes: DataFrame
    subroots: DataFrame
    root: bytes | None
    proofs: DataFrame


def manifest(spark: SparkSession, rows: DataFrame, id: str = "doc_id", group: str = "lang", leaf: str = "leaf") -> Manifest:
    """Manifest of `rows`, whose column `leaf` is their digest (32 bytes). In each group leaves ascend by `id`, nulls first. While there are several nodes,
    every ARITY consecutive ones become one, the digest of theirs as hexadecimal text; groups, nulls first and else in the byte order of their
    text, likewise.

    Rows of one id are put in the order of their digests; repeated rows are leaves of their own. Any column may be null but `leaf`. Texts
    are read by whoever digests them, not here: of a row only id, group, digest and the further columns given move. No rows: no root, empty
    tables. Columns of any name may be given; in `proofs` the id and the others keep their names, but none may be called path or subroot.
    """
    others = [c for c in rows.columns if c not in (id, group, leaf)]
    clash = {"path", "subroot"} & {id, group, *others}
    if clash:
        raise ValueError(f"columns with the names of results: {sorted(clash)}")
    scratch = Scratch(spark, "merkle")
    own = {c: f"own_{i}" for i, c in enumerate([id, group, *others])}
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    table = scratch.stored(rows.select(key.alias("key"), F.col(leaf).alias("digest"), *[F.col(c).alias(o) for c, o in own.items()]))
    leaves = scratch.stored(_placed(scratch, table, [own[id], "digest"]))
    nodes = _built(scratch, leaves)
    subroots = scratch.stored(nodes.where(f"kind = {TOP}").select("key", "size", "digest"))
    groups = subroots.select(F.lit("").alias("key"), "digest", F.col("key").alias("group"), F.col("size").alias("rows"))
    groups = scratch.stored(_placed(scratch, groups, ["group"]))
    upper = _built(scratch, groups)
    top = upper.where(f"kind = {TOP}").select("digest", "size").first()
    n_groups, tallest = top["size"] if top else 0, subroots.agg(F.max("size")).first()[0] or 0
    start = groups.select("key", "size").limit(1).select("key", "size", F.array().cast(_PATH).alias("path"), F.lit(None).cast("binary").alias("subroot"))
    of_groups = _proved(scratch, groups, upper, start, n_groups, ["group", "rows"])
    tops = scratch.stored(of_groups.select(F.col("group").alias("key"), F.col("rows").alias("size"), "path", F.col("digest").alias("subroot")))
    proofs = _proved(scratch, leaves, nodes, tops, tallest, list(own.values()))
    named = proofs.select(*[F.col(o).alias(c) for c, o in own.items()], F.col("digest").alias(leaf), "path", "subroot")
    return Manifest(nodes, subroots, top["digest"] if top else None, named)
