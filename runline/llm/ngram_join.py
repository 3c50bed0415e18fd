"""Exact Jaccard join of word n-gram sets: prefix trees over globally ordered sets.

All sets follow one order of n-grams: rarest first, ties by hash. An n-gram that one set alone has can't be shared, so a
set is its size, the number of those (`lead`), and its shared n-grams in that order: a path in a tree of sets. Two similar
sets meet at their first common n-gram, which lies within a short beginning (prefix) of both.

1. Every text is read once. A task numbers its texts by chunks and deals the chunk's n-grams, sorted, over ranges of hashes.
2. A range counts in how many sets each n-gram is, and returns those of two sets or more to their chunks. An n-gram that is in
   many texts of one chunk is not dealt text by text: its chunk sends it once, as frequent.
3. A chunk gives each set's size, digest, shared n-grams in global order, and prefix. Equal sets count once (by digest).
4. Sets that a chain of common prefix n-grams connects are one group; no pair crosses groups. A group is one tree, held as
   its sorted paths. It is walked from the root; a set that is asked for joins the walk at the first n-gram of the path
   that its own prefix has, and the overlaps with the path so far are kept for all of them, so that all sets below
   a node share them. A set leaves the walk at a node below which the n-grams that remain, of its own or of the longest path,
   can't reach the overlap that their sizes ask for, or below which all belong to its component already.
5. A group too large for a task is dealt into slices, each a tree of its own together with some sets that all slices have. What
   then lies in different components under a common n-gram is compared: pair by pair under rare ones, under frequent ones by
   walks of blocks of sets through trees of other blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runline.llm import words as W
from runline.llm.components import components
from runline.llm.scratch import Scratch

#: Bits of an n-gram's hash. Unequal n-grams of one pair of texts of 500 words collide with a chance of 1e-9.
BITS = 48
_NO_ID = -(1 << 63)
#: Frequencies from here on count as one; it is also that of an n-gram in at least so many texts of a chunk (about 2 MB).
MOST_FREQUENT, FREQUENT_IN_CHUNK = (1 << 15) - 1, 16
#: Bytes of text per range of hashes, of sets per task of trees; sets of a slice of a large group, and its sets that all slices have.
RANGE_BYTES, TREE_BYTES = 4 << 20, 8 << 20
SLICE, COMMON = 4096, 16
#: Sets under an n-gram up to which those of different components are paired; under others they meet in blocks of BLOCK sets.
MOST_PAIRED = 32
BLOCK = 2048
#: Sets of a tree up to which all are asked for at once; of a larger one first ASKED sets, in a few rounds.
SMALL, ASKED, ROUNDS = 64, 8, 4


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int, kept: np.ndarray = W.BLANK_SEPARATED) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 48-bit hash) of every distinct n-gram of each text, sorted. A text of fewer words has one."""
    start, end, doc = W.word_spans(data, offsets, kept)
    words = W.word_hashes(data, start, end)
    hashes, at = W.window_hashes(words, doc, size)
    short, short_doc = W.short_hashes(words, doc, len(offsets) - 1, size)
    keys = np.concatenate((doc[at], short_doc)).astype(np.uint64) << np.uint64(BITS)
    keys = np.sort(keys | (np.concatenate((hashes, short)) >> np.uint64(64 - BITS)))
    keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys
    return (keys >> np.uint64(BITS)).astype(np.int64), keys & np.uint64((1 << BITS) - 1)


def set_digests(doc: np.ndarray, tokens: np.ndarray, n: int) -> list[np.ndarray]:
    """Two 64-bit sums over each text's set."""
    cuts = np.searchsorted(doc, np.arange(n + 1))
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        sums = np.zeros(len(tokens) + 1, dtype=np.uint64)
        np.cumsum(W.mix(tokens ^ np.uint64(salt)), out=sums[1:])
        out.append((sums[cuts[1:]] - sums[cuts[:-1]]).view(np.int64))
    return out


def _deal(docs: DataFrame, size: int, buckets: int) -> DataFrame:
    """Rows of a chunk for each range: its n-grams there (`tokens`) with their texts (`who`), frequent ones apart: once in `marks`,
    and with their texts in a row of its own (`own`), which any range returns as it is."""
    edges = np.array([(b << BITS) // buckets for b in range(buckets + 1)], dtype=np.uint64)
    names = ["bucket", "chunk", "own", "tokens", "who", "marks", "sets"]

    def run(batches):
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part, data, offsets in W.text_slices(batch, "text"):
                n = part.num_rows
                doc, tokens = shingle_sets(W.LOWER[data], offsets, size)
                ids = part.column(0).fill_null(_NO_ID).to_numpy()
                sets = np.stack([ids, np.bincount(doc, minlength=n), *set_digests(doc, tokens, n)]).astype("<i8").tobytes()
                order = np.argsort(tokens)
                tokens, who = tokens[order], doc[order].astype(np.uint64)
                fresh = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.zeros(0, np.int64)
                many = np.diff(np.append(fresh, len(tokens))) >= FREQUENT_IN_CHUNK
                marks = tokens[fresh[many]]
                frequent = np.repeat(many, np.diff(np.append(fresh, len(tokens))))
                rest, rest_who = tokens[~frequent], who[~frequent]
                cuts, mark_cuts = np.searchsorted(rest, edges), np.searchsorted(marks, edges)
                full = np.flatnonzero(np.diff(cuts) + np.diff(mark_cuts))
                rows = [(b, False, rest[cuts[b] : cuts[b + 1]], rest_who[cuts[b] : cuts[b + 1]], marks[mark_cuts[b] : mark_cuts[b + 1]], b"") for b in full]
                rows.append((chunk % buckets, True, tokens[frequent], who[frequent], marks[:0], sets))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.int32()), pa.array(np.full(len(rows), chunk)), pa.array([r[1] for r in rows]),
                        pa.array([W.planes(r[2], 6) for r in rows], pa.binary()), pa.array([W.planes(r[3], 2) for r in rows], pa.binary()),
                        pa.array([W.planes(r[4], 6) for r in rows], pa.binary()), pa.array([r[5] for r in rows], pa.binary()),
                    ],
                    names=names,
                )
                chunk += 1

    return docs.mapInArrow(run, "bucket int, chunk long, own boolean, tokens binary, who binary, marks binary, sets binary")


def _shared(table: pa.Table) -> pa.Table:
    """The n-grams of a range that several sets have, with their number of sets, by chunk."""
    rows = table.to_pydict()
    tokens = [W.from_planes(b, 6) for b in rows["tokens"]]
    every = np.concatenate([t if not own else t[:0] for t, own in zip(tokens, rows["own"], strict=True)])
    frequent = np.unique(np.concatenate([W.from_planes(b, 6) for b in rows["marks"]]))
    order = np.argsort(every)
    fresh = np.flatnonzero(np.concatenate(([True], every[order][1:] != every[order][:-1]))) if len(every) else np.zeros(0, np.int64)
    counts = np.minimum(np.diff(np.append(fresh, len(every))), MOST_FREQUENT)
    counts[np.isin(every[order][fresh], frequent)] = MOST_FREQUENT
    df = np.empty(len(every), np.uint64)
    df[order] = np.repeat(counts, np.diff(np.append(fresh, len(every))))
    out, at = {"chunk": [], "tokens": [], "who": [], "df": [], "sets": []}, 0
    for chunk, is_own, own, who, sets in zip(rows["chunk"], rows["own"], tokens, rows["who"], rows["sets"], strict=True):
        if is_own:
            n = np.full(len(own), MOST_FREQUENT, np.uint64)
        else:
            n = df[at : at + len(own)]
            at += len(own)
        keep = n > 1
        if keep.any() or sets:
            for name, value in zip(out, (chunk, W.planes(own[keep], 6), W.planes(W.from_planes(who, 2)[keep], 2), W.planes(n[keep], 2), sets), strict=True):
                out[name].append(value)
    return pa.table({"chunk": pa.array(out["chunk"], pa.int64()), **{k: pa.array(out[k], pa.binary()) for k in ("tokens", "who", "df", "sets")}})


def _sets(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Every set of a chunk; those that can have a partner with their shared n-grams and prefix."""
        rows = table.to_pydict()
        ids, n, d1, d2 = np.frombuffer(b"".join(rows["sets"]), "<i8").reshape(4, -1)
        tokens = np.concatenate([W.from_planes(b, 6) for b in rows["tokens"]])
        who = np.concatenate([W.from_planes(b, 2) for b in rows["who"]]).astype(np.int64)
        df = np.concatenate([W.from_planes(b, 2) for b in rows["df"]])
        tokens = tokens | df << np.uint64(BITS)  # ascending: rarest first
        order = np.lexsort((tokens, who))
        tokens = tokens[order].astype(np.int64)
        cuts = np.searchsorted(who[order], np.arange(len(ids) + 1))
        lead = n - np.diff(cuts)
        prefix = n - -(-percent * n // 100) + 1
        able = (lead < prefix) & (n > 0)
        blobs = [tokens[cuts[k] : cuts[k + 1]].tobytes() if able[k] else None for k in range(len(ids))]
        firsts = [tokens[cuts[k] : cuts[k] + prefix[k] - lead[k]] if able[k] else None for k in range(len(ids))]
        return pa.table({
            "id": ids, "n": n, "d1": d1, "d2": d2, "lead": lead,
            "tokens": pa.array(blobs, pa.binary()), "prefix": pa.array(firsts, pa.list_(pa.int64())),
        })

    return run


def _overlaps(batches):
    """(a, b, n_a, n_b, overlap) of pairs with their sets."""
    for batch in batches:
        x, y = batch.column(4).to_pylist(), batch.column(5).to_pylist()
        both = [len(np.intersect1d(np.frombuffer(p, "<i8"), np.frombuffer(q, "<i8"), assume_unique=True)) for p, q in zip(x, y, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(both, pa.int64())], ["a", "b", "n_a", "n_b", "overlap"])


def _gather(cuts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The places of all entries of the lists `at`, where list t lies from cuts[t] to cuts[t + 1]."""
    size = cuts[at + 1] - cuts[at]
    return np.repeat(cuts[at] - np.cumsum(size) + size, size) + np.arange(size.sum())


class Tree:
    """Sets as paths of a tree: sorted, with the number of n-grams that each has in common with the one before. n: sizes, lead:
    n-grams that come before a path and are shared with none."""

    def __init__(self, sets: list[np.ndarray], n: np.ndarray, lead: np.ndarray, percent: int):
        self.percent, k = percent, len(sets)
        self.order = np.array(sorted(range(k), key=lambda i: sets[i].astype(">i8").tobytes()), dtype=np.int64)
        paths = [sets[i] for i in self.order]
        self.n, self.length = n[self.order], np.array([len(x) for x in paths], dtype=np.int64)
        self.prefix = np.clip(self.n - -(-percent * self.n // 100) + 1 - lead[self.order], 0, self.length)
        self.start = np.concatenate(([0], np.cumsum(self.length)))
        vocabulary, self.token = np.unique(np.concatenate(paths), return_inverse=True)
        self.row = np.repeat(np.arange(k), self.length)
        self.depth = np.arange(len(self.row)) - self.start[self.row]
        self.width = len(vocabulary)
        self.place = self.row * self.width + self.token  # ascending
        self.common = np.zeros(k, dtype=np.int64)
        for i in range(1, k):
            m = min(self.length[i - 1], self.length[i])
            same = self.token[self.start[i - 1] : self.start[i - 1] + m] == self.token[self.start[i] : self.start[i] + m]
            self.common[i] = m if same.all() else same.argmin()

    def lists(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each n-gram the paths that have it, of the chosen entries: bounds of the lists, paths."""
        at = np.flatnonzero(chosen)
        at = at[np.argsort(self.token[at], kind="stable")]
        return np.searchsorted(self.token[at], np.arange(self.width + 1)), self.row[at]

    def walk(self, label: np.ndarray, asks: np.ndarray, holds: np.ndarray) -> None:
        """Joins in `label` the components of linked sets, one of `asks` and one of `holds` (masks; all by sorted path)."""
        p, q_all = self.percent, 100 + self.percent
        cuts, rows = self.lists(asks[self.row])
        first_cuts, first_rows = self.lists(asks[self.row] & (self.depth < self.prefix[self.row]))
        none = np.zeros(0, np.int64)
        stack = [(0, len(label), 0, none, none)]
        while stack:
            low, high, depth, open_, overlap = stack.pop()
            end = int(self.length[low]) if high - low == 1 else int(self.common[low + 1 : high].min())
            edge = self.token[self.start[low] + depth : self.start[low] + end]
            held = holds[low:high]
            if not held.any():
                continue
            if len(edge):
                joining = edge[: max(0, int(self.prefix[low:high].max()) - depth)]
                fresh = np.unique(first_rows[_gather(first_cuts, joining)]) if len(joining) else none
                if len(fresh) and len(open_):
                    fresh = fresh[~np.isin(fresh, open_)]
                own = label[low:high]
                one = own[0] if (own == own[0]).all() else -1
                if one >= 0:
                    keep = label[open_] != one
                    open_, overlap, fresh = open_[keep], overlap[keep], fresh[label[fresh] != one]
                if not len(open_) and not len(fresh):
                    if end >= self.prefix[low:high].max():
                        continue  # no set joins below
                else:
                    count = np.bincount(rows[_gather(cuts, edge)], minlength=len(label))
                    open_, overlap = np.concatenate((open_, fresh)), np.concatenate((overlap + count[open_], count[fresh]))
                    # What remains of the longest path below, and of the set itself behind the edge's last n-gram.
                    rest = self.start[open_ + 1] - np.searchsorted(self.place, open_ * self.width + edge[-1], side="right")
                    reach = overlap + np.minimum(rest, int((self.length[low:high] - end).max()))
                    keep = q_all * reach >= p * (self.n[open_] + int(self.n[low:high].min()))
                    open_, overlap = open_[keep], overlap[keep]
            at = low
            while at < high and self.length[at] == end:  # paths that end here
                if holds[at] and len(open_):
                    for a in np.unique(label[open_[q_all * overlap >= p * (self.n[open_] + self.n[at])]]):
                        x, y = sorted((int(a), int(label[at])))
                        if x != y:
                            label[label == y] = x
                at += 1
            if at < high:
                borders = np.flatnonzero(self.common[at + 1 : high] == end) + at + 1
                parts = np.concatenate(([at], borders, [high]))
                stack += [(a, b, end, open_, overlap) for a, b in zip(parts[:-1].tolist(), parts[1:].tolist(), strict=True)]

    def join(self, label: np.ndarray, asks: np.ndarray, holds: np.ndarray) -> np.ndarray:
        """`label` (numbers, by set) with linked components joined. A large tree is first walked by a few sets, then by all that
        the largest component does not hold yet."""
        label, asks, holds = label[self.order].copy(), asks[self.order], holds[self.order]
        if len(label) > SMALL:
            for _ in range(ROUNDS):
                left = np.flatnonzero(asks & (label != np.bincount(label).argmax()))
                if len(left) <= SMALL:
                    break
                few = np.zeros(len(label), bool)
                few[left[np.linspace(0, len(left) - 1, ASKED).astype(int)]] = True
                self.walk(label, few, holds)
            main = np.bincount(label).argmax()
            # Links of the largest component are found from the other side, if all of that asks and all of this is held.
            if (asks | (label == main)).all() and (holds | (label != main)).all():
                asks = asks & (label != main)
        self.walk(label, asks, holds)
        out = np.empty_like(label)
        out[self.order] = label
        return out


def _tree_links(percent: int):
    """Links (set, component within its tree) of all trees of a task."""

    def run(table: pa.Table) -> pa.Table:
        group, piece, n, lead, ids = (table.column(c).to_numpy() for c in ("group", "piece", "n", "lead", "id"))
        blobs = table.column("tokens").to_pylist()
        order = np.lexsort((piece, group))
        fresh = np.flatnonzero(np.concatenate(([True], (group[order][1:] != group[order][:-1]) | (piece[order][1:] != piece[order][:-1]))))
        a, b = [], []
        for low, high in zip(fresh, [*fresh[1:], len(order)], strict=True):
            at = order[low:high]
            at = at[np.argsort(ids[at], kind="stable")]
            if len(at) < 2:
                continue
            every = np.ones(len(at), bool)
            tree = Tree([np.frombuffer(blobs[i], "<i8") for i in at], n[at], lead[at], percent)
            label = tree.join(np.arange(len(at)), every, every)
            moved = np.flatnonzero(label != np.arange(len(at)))
            a.append(ids[at[moved]])
            b.append(ids[at[label[moved]]])
        none = np.zeros(0, np.int64)
        return pa.table({"a": np.concatenate([none, *a]), "b": np.concatenate([none, *b])})

    return run


def _block_links(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Which components of a block are linked: (a, b), b the smallest that a hangs together with."""
        side = table["side"].to_numpy()
        if not (side == 0).any() or not (side == 1).any():
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        names, label = np.unique(table["component"].to_numpy(), return_inverse=True)
        tree = Tree([np.frombuffer(x, "<i8") for x in table["tokens"].to_pylist()], table["n"].to_numpy(), table["lead"].to_numpy(), percent)
        joined = tree.join(label, side == 0, side == 1)
        pairs = np.unique(np.stack([label, joined])[:, joined != label], axis=1)
        return pa.table({"a": names[pairs[0]], "b": names[pairs[1]]})

    return run


class _Search:
    """Components of linked sets. sets: id, n, lead, tokens (bytes of ascending numbers, none for a set without partners); nodes:
    token, id, n, at (n-grams of the set before it). Sets without a common token in `nodes` are not compared."""

    def __init__(self, scratch: Scratch, sets: DataFrame, nodes: DataFrame, percent: int):
        self.scratch, self.percent = scratch, percent
        self.sets = sets.where("tokens is not null").select("id", "n", "lead", "tokens")
        self.nodes = nodes
        self.links: DataFrame | None = None

    def fits(self, n_a: Column, at_a: Column, n_b: Column, at_b: Column) -> Column:
        """What remains below the node, itself included, can reach the overlap asked for."""
        return (100 + self.percent) * F.least(n_a - at_a, n_b - at_b) >= self.percent * (n_a + n_b)

    def compare(self, pairs: DataFrame) -> None:
        """pairs: (x, y) with n_x, at_x, n_y, at_y. They are verified by their overlap; links are gathered."""
        c = F.col
        pairs = pairs.where(self.fits(c("n_x"), c("at_x"), c("n_y"), c("at_y")) & (c("x") != c("y")))
        pairs = self.scratch.stored(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        left = self.sets.select(c("id").alias("a"), c("n").alias("n_a"), c("tokens").alias("tokens_a"))
        right = self.sets.select(c("id").alias("b"), c("n").alias("n_b"), c("tokens").alias("tokens_b"))
        full = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "tokens_a", "tokens_b")
        seen = full.mapInArrow(_overlaps, "a long, b long, n_a long, n_b long, overlap long")
        linked = seen.where(100 * c("overlap") >= self.percent * (c("n_a") + c("n_b") - c("overlap"))).select("a", "b")
        self.links = self.links.unionByName(self.scratch.stored(linked))

    def run(self) -> DataFrame:
        """(node, component) of linked sets."""
        c = F.col
        least = self.nodes.groupBy("token").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x <> y")
        chains = self.nodes.join(least, "token").where("id <> x").select(c("id").alias("a"), c("x").alias("b")).distinct()
        group = components(self.scratch, self.scratch.stored(chains)).withColumnsRenamed({"node": "id", "component": "group"})
        grouped = self.sets.join(group, "id")
        sized = grouped.groupBy("group").agg(F.count("*").alias("k"), F.sum(F.length("tokens")).alias("bytes"))
        sized = self.scratch.stored(sized.withColumn("pieces", F.greatest(F.ceil(c("k") / SLICE), F.ceil(c("bytes") / (4 * TREE_BYTES))).cast("int")))
        total = sized.agg(F.sum("bytes"), F.max("pieces")).first()
        own = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
        full = grouped.join(sized.select("group", "pieces"), "group").withColumn("piece", (own % c("pieces")).cast("int"))
        large = (total[1] or 1) > 1
        if large:
            # Of each large group some sets, the least of each of COMMON classes by hash, are in all of its slices.
            many = group.join(sized.where("pieces > 1").select("group", "pieces"), "group")
            common = many.groupBy("group", F.floor(own / 7 % COMMON).alias("_c")).agg(F.min_by("id", own).alias("id"), F.max("pieces").alias("pieces"))
            common = self.sets.join(common.drop("_c"), "id").withColumn("piece", F.explode(F.sequence(F.lit(0), c("pieces") - 1)))
            full = full.unionByName(common.select(*full.columns)).dropDuplicates(["group", "piece", "id"])
        tasks = max(1, -(-int(total[0] or 0) // TREE_BYTES))
        dealt = full.withColumn("bucket", F.pmod(F.xxhash64("group", "piece"), F.lit(tasks))).select("bucket", "group", "piece", "id", "n", "lead", "tokens")
        self.links = self.scratch.stored(dealt.groupBy("bucket").applyInArrow(_tree_links(self.percent), "a long, b long"))
        found = components(self.scratch, self.links)
        if not large:
            return found
        inside = group.join(sized.where("pieces > 1").select("group"), "group").select("id")
        rest = self.nodes.join(inside, "id").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        rest = self.scratch.stored(rest)
        each = rest.groupBy("token", "component").agg(F.count("*").alias("k"))
        open_ = each.groupBy("token").agg(F.sum("k").alias("k"), F.max("k").alias("k_main"), F.max_by("component", F.struct("k", "component")).alias("main"))
        open_ = self.scratch.stored(open_.where("k > k_main"))
        few, many = open_.where(c("k") <= MOST_PAIRED), open_.where(c("k") > MOST_PAIRED)
        asked = rest.join(few, "token").where("component <> main")
        asked = asked.select("token", c("id").alias("x"), c("n").alias("n_x"), c("at").alias("at_x"), c("component").alias("component_x"))
        pairs = rest.join(asked, "token").where("component <> component_x")
        self.compare(pairs.select("x", "n_x", "at_x", c("id").alias("y"), c("n").alias("n_y"), c("at").alias("at_y")))
        if not many.isEmpty():
            self.links = self.links.unionByName(self.scratch.stored(self.blocks(rest.join(many, "token"))))
        return components(self.scratch, self.links)

    def blocks(self, rows: DataFrame) -> DataFrame:
        """Links of components under frequent n-grams: each block of the sets outside the largest one against each of all sets."""
        c = F.col
        full = rows.join(self.sets.select("id", "lead", "tokens"), "id")
        full = full.withColumn("_i", F.ceil((c("k") - c("k_main")) / BLOCK).cast("int")).withColumn("_j", F.ceil(c("k") / BLOCK).cast("int"))
        own, every = F.pmod(F.xxhash64("id"), F.lit(1 << 40)), ["token", "i", "j", "side", "n", "lead", "component", "tokens"]
        left = full.where("component <> main").withColumns({"i": (own % c("_i")).cast("int"), "side": F.lit(0)}).withColumn("j", F.explode(F.sequence(F.lit(0), c("_j") - 1)))
        right = full.withColumns({"j": (own % c("_j")).cast("int"), "side": F.lit(1)}).withColumn("i", F.explode(F.sequence(F.lit(0), c("_i") - 1)))
        both = left.select(*every).unionByName(right.select(*every))
        return both.groupBy("token", "i", "j").applyInArrow(_block_links(self.percent), "a long, b long")


def ngram_join(spark: SparkSession, docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """A row per input row: `id`, `n_shingles`, `component_id`, `copy_of` (smallest id with the same set).

    Words are runs of non-blank characters, A-Z in lower case; a document's set are its distinct n-grams of `size` words, or its
    whole sequence if it has fewer. Documents whose sets overlap in `percent` of their union are linked; a
    component is named by its smallest id. Texts that are null or have no words have an empty set and no links.
    Repeated rows are equal sets. Rows with a null id are returned with a null component and link nothing. An empty
    table gives an empty one. Ids are integers (but the smallest long, which stands for a null id); other columns are not read. A text longer
    than a chunk is a chunk of its own, whole.
    """
    own = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    scratch = Scratch(spark, "ngrams")
    ranges = max(24, -(-int(own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE_BYTES))
    dealt = _deal(own, size, ranges)
    shared = dealt.groupBy("bucket").applyInArrow(_shared, "chunk long, tokens binary, who binary, df binary, sets binary")
    sets = shared.groupBy("chunk").applyInArrow(_sets(percent), "id long, n long, d1 long, d2 long, lead long, tokens binary, prefix array<long>")
    sets = scratch.stored(sets)
    named = sets.where((F.col("n") > 0) & (F.col("id") != _NO_ID))
    first = scratch.stored(named.groupBy("d1", "d2", "n").agg(F.min("id").alias("copy_of")))
    able = named.where("tokens is not null").join(first.select(F.col("copy_of").alias("id")), "id", "left_semi")
    nodes = able.select("id", "n", "lead", F.posexplode("prefix").alias("k", "token")).select("token", "id", "n", (F.col("lead") + F.col("k")).alias("at"))
    found = _Search(scratch, able, scratch.stored(nodes), percent).run()
    rows = sets.select("id", "n", F.when(F.col("id") != _NO_ID, F.col("d1")).alias("d1"), "d2")
    rows = rows.join(first, ["d1", "d2", "n"], "left").withColumn("copy_of", F.coalesce("copy_of", "id"))
    rows = rows.join(found.withColumnRenamed("node", "copy_of"), "copy_of", "left")
    own_id = F.when(F.col("id") != _NO_ID, F.col("id"))
    return rows.select(
        own_id.alias(id),
        F.col("n").alias("n_shingles"),
        F.when(own_id.isNotNull(), F.coalesce("component", "copy_of")).alias("component_id"),
        F.when(own_id.isNotNull(), F.col("copy_of")).alias("copy_of"),
    )
