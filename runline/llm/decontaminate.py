"""Benchmark decontamination by suffix arrays of the training texts.

A task's texts are cut into shards of a few MB. The words of a shard, numbered by the benchmark's vocabulary, get a
suffix array; every suffix of the test items is binary-searched in it, which gives its longest verbatim match, where
that is, and all places of its first `window` words. Suffixes that meet a word of no test item before the shortest
window is complete are left out of the array: they hold no occurrence. Of the test suffixes, only those are searched whose
window's hash some window of the shard has, and a shard without any needs no array.

The benchmark is the stated query set. It is read in blocks of a bounded number of characters; each block is sent to
the executors and run against all rows, and the results of blocks are merged per document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runline.llm import words as W
from runline.llm.scratch import Scratch

#: Characters of test items that are sent to the executors at once.
BLOCK_CHARS = 32 << 20


class TestSet:
    """A block of test items, as arrays: numbered words, of all items in a row; for each suffix (named by its first word's place) its item; and the
    different windows, each with the suffixes that begin with it. A window is a place and a length in the words, and is known by a hash of
    its words, as words are. It holds about 40 bytes per word."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.window = window
        self.names = [n for n, _ in items]
        data, offsets = W.text_bytes(pa.array([t or "" for _, t in items], pa.large_string()))
        hashes, item = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for low, high in W.slices(offsets):
            own = W.LOWER[data[offsets[low] : offsets[high]]]
            start, end, doc = W.word_spans(own, offsets[low : high + 1] - offsets[low], W.ALPHANUMERIC)
            hashes.append(W.word_hashes(own, start, end))
            item.append(low + doc)
        hashes, item = np.concatenate(hashes), np.concatenate(item)
        self.hashes, number = np.unique(hashes, return_inverse=True)
        self.words, self.item = (number + 1).astype(np.int32), item.astype(np.int32)
        count = np.bincount(item, minlength=len(items))
        self.begin, self.end = np.cumsum(count) - count, np.cumsum(count)
        sizes = np.minimum(count, window)
        self.sizes = np.unique(sizes[sizes > 0])
        self.shortest = int(self.sizes[0]) if len(self.sizes) else 0
        #: Per length: hashes of its different windows, sorted, and the number of the first.
        self.known: list[tuple[int, np.ndarray, int]] = []
        lengths, suffixes, of = [], [], []
        for size in self.sizes.tolist():
            mine = np.flatnonzero(sizes[item] == size)
            own, at = W.window_hashes(hashes[mine], item[mine], size)
            found, which = np.unique(own, return_inverse=True)
            first = sum(map(len, lengths))
            self.known.append((size, found, first))
            lengths.append(np.full(len(found), size, np.int32))
            suffixes.append(mine[at].astype(np.int32))
            of.append((which + first).astype(np.int32))
        self.length = np.concatenate(lengths) if lengths else np.zeros(0, np.int32)
        of, suffixes = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (of, suffixes))
        order = np.lexsort((suffixes, of))
        #: Suffixes by window, and where those of each window begin.
        self.suffixes = suffixes[order]
        self.cuts = np.searchsorted(of[order], np.arange(len(self.length) + 1)).astype(np.int32)

    def met(self, hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Numbers of the windows whose hash some window of these words has: all that occur are among them."""
        out = [np.zeros(0, np.int64)]
        for size, known, first in self.known:
            own, _ = W.window_hashes(hashes, doc, size)
            at = np.searchsorted(known, own)
            at[at == len(known)] = 0
            out.append(first + np.unique(at[known[at] == own]))
        return np.concatenate(out)

    def queries(self, windows: np.ndarray) -> np.ndarray:
        """Words of these windows, a row each; -1 beyond their length."""
        columns = np.arange(self.window)
        at = self.suffixes[self.cuts[windows]].astype(np.int64)[:, None] + columns
        return np.where(columns < self.length[windows][:, None], self.words[np.minimum(at, len(self.words) - 1)], -1)

    def owners(self, window: int) -> set[str]:
        """Ids of the items that have a window; an item without an id is not named."""
        items = np.unique(self.item[self.suffixes[self.cuts[window] : self.cuts[window + 1]]])
        return {self.names[k] for k in items.tolist()} - {None}

    def common(self, suffix: np.ndarray, padded: np.ndarray, places: np.ndarray, known: np.ndarray) -> np.ndarray:
        """For each pair of a suffix and a place, of which the first `known` words are equal: how many are."""
        equal, open_ = known.copy(), np.arange(len(suffix))
        while len(open_):
            k = equal[open_]
            inside = suffix[open_] + k < self.end[self.item[suffix[open_]]]
            open_, k = open_[inside], k[inside]
            same = self.words[suffix[open_] + k] == padded[places[open_] + k]
            open_ = open_[same]
            equal[open_] += 1
        return equal


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of `ids` in the order of the suffixes that begin there, compared up to `depth` words."""
    rank = ids.copy()
    order = np.argsort(rank, kind="stable")
    size = 1
    while size < depth:
        nxt = np.zeros_like(rank)
        nxt[:-size] = rank[size:]
        key = rank * (int(rank.max()) + 1 if len(rank) else 1) + nxt
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.empty_like(rank)
        fresh[order] = np.cumsum(np.concatenate(([1], (key[1:] != key[:-1]).astype(np.int64))))
        rank, size = fresh, 2 * size
        if len(rank) and rank[order[-1]] == len(rank):
            break
    return order


def search(padded: np.ndarray, order: np.ndarray, queries: np.ndarray, lengths: np.ndarray, after: bool) -> np.ndarray:
    """For each query the number of suffixes that come before it (`after`: before or with it as their beginning)."""
    low, high = np.zeros(len(queries), np.int64), np.full(len(queries), len(order), np.int64)
    width = np.arange(queries.shape[1])
    while (open_ := low < high).any():
        rows = np.flatnonzero(open_)
        middle = (low[rows] + high[rows]) // 2
        q, n = queries[rows], lengths[rows]
        suffix = padded[order[middle][:, None] + width]
        differs = (suffix != q) & (width < n[:, None])
        some = differs.any(axis=1)
        first = differs.argmax(axis=1)
        at = np.arange(len(rows))
        less = np.where(some, suffix[at, first] < q[at, first], after)
        low[rows[less]] = middle[less] + 1
        high[rows[~less]] = middle[~less]
    return low


def shard_matches(test: TestSet, data: np.ndarray, offsets: np.ndarray):
    """Words per text; occurrences (text, first word within it, words, window number); longest match per test suffix."""
    n = len(offsets) - 1
    start, end, doc = W.word_spans(data, offsets, W.ALPHANUMERIC)
    n_words = np.bincount(doc, minlength=n)
    nothing = np.zeros(0, np.int64)
    if not len(start) or not len(test.hashes):
        return n_words, (nothing, nothing, nothing, nothing), (nothing, nothing, nothing, nothing)
    hashes = W.word_hashes(data, start, end)
    windows = test.met(hashes, doc)
    if not len(windows):  # none of them occurs
        return n_words, (nothing, nothing, nothing, nothing), (nothing, nothing, nothing, nothing)
    at = np.searchsorted(test.hashes, hashes)
    at[at == len(test.hashes)] = 0
    ids = np.where(test.hashes[at] == hashes, at + 1, 0)
    # Runs of known words within a text that can hold the shortest window; 0 stands between runs.
    cut = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | ((ids[1:] > 0) != (ids[:-1] > 0)))))
    size = np.diff(np.concatenate((cut, [len(ids)])))
    runs = (ids[cut] > 0) & (size >= test.shortest)
    cut, size = cut[runs], size[runs]
    if not len(cut):
        return n_words, (nothing, nothing, nothing, nothing), (nothing, nothing, nothing, nothing)
    begin = np.cumsum(size + 1) - size - 1
    place = np.arange(int(size.sum()) + len(size))
    run = np.searchsorted(begin, place, side="right") - 1
    origin = cut[run] + place - begin[run]  # the word of the shard at each place
    joined = np.where(place - begin[run] < size[run], ids[np.minimum(origin, len(ids) - 1)], 0)
    order = suffix_array(joined, test.window)
    order = order[joined[order] > 0]
    padded = np.concatenate((joined, np.zeros(test.window, np.int64)))  # no match goes on over a 0
    found = []
    lengths = test.length[windows].astype(np.int64)
    queries = test.queries(windows)
    low = search(padded, order, queries, lengths, after=False)
    high = search(padded, order, queries, lengths, after=True)
    for k in np.flatnonzero(high > low):
        places = order[low[k] : high[k]]
        found.append((origin[places], np.full(len(places), lengths[k]), np.full(len(places), windows[k])))
    if found:
        word, length, number = (np.concatenate(x) for x in zip(*found, strict=True))
    else:
        word = length = number = nothing
    first_word = np.cumsum(n_words) - n_words
    hits = (doc[word], word - first_word[doc[word]], length, number)
    # Longest matches: all places that share a suffix's window, each with the words it shares with the suffix.
    hit = np.flatnonzero(high > low) if len(word) else nothing
    many = (test.cuts[windows[hit] + 1] - test.cuts[windows[hit]]).astype(np.int64)
    spot = np.repeat(hit, many)
    begin = np.cumsum(many) - many
    asked = test.suffixes[np.repeat(test.cuts[windows[hit]] - begin, many) + np.arange(len(spot))].astype(np.int64)
    count = high[spot] - low[spot]
    best = [(nothing, nothing, nothing, nothing)]
    for at in _portions(count):
        which = np.repeat(at, count[at])
        begin = np.cumsum(count[at]) - count[at]
        places = order[np.repeat(low[spot[at]] - begin, count[at]) + np.arange(len(which))]
        suffix = asked[which]
        # A pair that goes on to the left is part of a longer match.
        alone = (test.begin[test.item[suffix]] == suffix) | (places == 0) | (test.words[suffix - 1] != padded[places - 1])
        which, places, suffix = which[alone], places[alone], suffix[alone]
        if not len(which):
            continue
        equal = test.common(suffix, padded, places, lengths[spot[which]])
        word = origin[places]
        found_in = doc[word]
        # One row a document: its longest match, the first of equal ones.
        top = np.lexsort((word, -equal, found_in))
        top = top[np.concatenate(([True], found_in[top][1:] != found_in[top][:-1]))]
        best.append((suffix[top], found_in[top], (word - first_word[found_in])[top], equal[top]))
    return n_words, hits, tuple(np.concatenate(x) for x in zip(*best, strict=True))


def _portions(count: np.ndarray, most: int = 1 << 20):
    """Numbers of suffixes, in portions of about `most` places together."""
    if not len(count):
        return
    total = np.cumsum(count) // most
    cuts = np.flatnonzero(np.concatenate(([True], total[1:] != total[:-1])))
    for a, b in zip(cuts, [*cuts[1:], len(count)], strict=True):
        yield np.arange(a, b)


def _block(docs: DataFrame, items: list[tuple[str, str | None]], window: int) -> DataFrame:
    """`docs` has keys (long) and, as the last column, the text."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(TestSet(items, window))  # at most BLOCK_CHARS of text
    keys = docs.columns[:-1]
    schema = pa.schema([
        *[(k, pa.int64()) for k in keys], ("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("first", pa.int64()), ("size", pa.int64())]))),
        ("items", pa.list_(pa.string())), ("longest", pa.int64()), ("longest_at", pa.int64()),
    ])

    def run(batches):
        test = sent.value
        for batch in batches:
            for part, data, offsets in W.text_slices(batch, "text"):
                n = part.num_rows
                n_words, (doc, first, size, number), (_, best_doc, best_at, best) = shard_matches(test, W.LOWER[data], offsets)
                hits: list = [[] for _ in range(n)]
                items: list = [set() for _ in range(n)]
                order = np.lexsort((first, doc))
                for d, a, m, k in zip(doc[order].tolist(), first[order].tolist(), size[order].tolist(), number[order].tolist(), strict=True):
                    last = hits[d][-1] if hits[d] else None
                    if last and a <= last["first"] + last["size"]:
                        last["size"] = max(last["size"], a + m - last["first"])
                    else:
                        hits[d].append({"first": a, "size": m})
                    items[d].add(k)
                named = {k: test.owners(k) for k in {k for x in items for k in x}}
                items = [set().union(*[named[k] for k in x]) for x in items]
                longest, longest_at = np.zeros(n, np.int64), np.full(n, -1, np.int64)
                for d, a, m in zip(best_doc.tolist(), best_at.tolist(), best.tolist(), strict=True):
                    if m > longest[d]:
                        longest[d], longest_at[d] = m, a
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(n_words.astype(np.int64)), pa.array(hits, schema.field("hits").type), pa.array([sorted(x) for x in items], schema.field("items").type), pa.array(longest), pa.array(longest_at)],
                    schema=schema,
                )

    return docs.mapInArrow(run, ", ".join(f"{k} long" for k in keys) + ", n_words long, hits array<struct<first:long,size:long>>, items array<string>, longest long, longest_at long")


def decontaminate(
    spark: SparkSession,
    docs: DataFrame,
    benchmark: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    window: int = 10,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Per document: `n_words`; `hits`, disjoint runs (first, size) of words inside an occurrence of a window;
    `items`, the ids (as text, sorted) of items with an occurrence; `longest`, the document's longest verbatim
    match of a window or more (words; 0: none), with its first word `longest_at`, the first of equally long ones.

    A window is `window` consecutive words of an item; an item of fewer words is one window. Null or empty texts have
    no words. An empty benchmark hits nothing. Rows are judged one by one, also those that repeat an id or
    have none. An item without an id hits like any other, but is not named in `items`; items that repeat an id are named
    once. Very long texts are slices of their own. Document ids are integers; item ids of any kind are named by their
    text. Other columns are not read.
    """
    own = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    test = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    chars = test.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(chars * 1.5) // block_chars)) if chars > block_chars else 1
    if blocks == 1:
        return _block(own, [tuple(r) for r in test.collect()], window).withColumnRenamed("id", id)  # checked: at most block_chars
    # Rows are numbered, and written with their numbers, so that every block sees the same ones.
    own = Scratch(spark, "numbered").stored(own.select(F.monotonically_increasing_id().alias("row"), "id", "text"))
    out = None
    for k in range(blocks):
        rows = test.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()
        one = _block(own, [tuple(r) for r in rows], window)
        out = one if out is None else out.unionByName(one)
    merged = out.groupBy("row").agg(
        F.first("id").alias("id"),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.max(F.struct("longest", (-F.col("longest_at")).alias("before"))).alias("best"),
    )  # a row per block
    empty = F.array().cast("array<struct<first:long,size:long>>")

    def join_runs(acc, x):
        last = F.element_at(acc, -1)
        touches = (F.size(acc) > 0) & (x["first"] <= last["first"] + last["size"])
        joined = F.struct(last["first"].alias("first"), F.greatest(last["size"], x["first"] + x["size"] - last["first"]).alias("size"))
        return F.when(touches, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    return merged.select(
        F.col("id").alias(id), "n_words", F.aggregate("hits", empty, join_runs).alias("hits"), "items",
        F.col("best.longest").alias("longest"), (-F.col("best.before")).alias("longest_at"),
    )
