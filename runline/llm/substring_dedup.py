"""Repeated passages: paragraphs that are near copies of each other, found by MinHash bands, verified, removed by component.

A paragraph is a line. Equal paragraphs (by digest of their n-gram sets) count once; the rest is searched like this: MinHash
signatures are cut into bands, tuned so that a pair at the threshold meets in some band almost surely; paragraphs that
share a band are compared exactly, by the same search that joins n-gram sets (one row per paragraph and band first,
then only pairs that no component holds together yet). One paragraph of each component stays.

Lines alone miss a passage that runs over a line break, sits inside a longer line or is wrapped into short ones. Runs of
words, whatever the lines, are therefore units too (`repeated_passages`): windows of 50 words are cut into chunks by
content, by the least hash of the 25-word grams in them, so that equal windows lie in chunks of one hash wherever they
stand. Chunks whose hash comes more than once are compared window by window, and windows grown to the exact spans. A
hash that very many texts have (a licence line, say) is no group of one task: its windows are dealt by themselves, salted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runline.llm import words as W
from runline.llm.ngram_join import _Search, set_digests, shingle_sets
from runline.llm.scratch import Scratch, partitions

_LINE_END = 0x0A
#: Bits of the sieve that lets pass the paragraphs whose sets are needed; sent to all tasks. Fuller, it lets more pass.
SIEVE_BITS = 1 << 25
#: Words of the grams whose least hash names a chunk of windows, and windows that a group of chunks holds on average.
GRAM, GROUP = 25, 250_000
#: Chunks of one hash that are compared in one task at most; windows of more frequent ones are dealt one by one.
MOST_OF_NAME, MOST_WINDOWS = 4000, 100_000
#: Windows in one row.
PIECE = 4096


def tune(percent: int, recall: float = 0.999, noise: float = 0.3, most_noise: float = 0.12) -> tuple[int, int]:
    """(bands, rows): the fewest bands at which a pair of similarity `percent` meets with chance `recall`, with enough rows
    that a pair of similarity `noise` meets with chance `most_noise` at most."""
    s = percent / 100
    for rows in range(1, 33):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - s**rows)))
        if 1 - (1 - noise**rows) ** bands <= most_noise:
            return bands, rows
    raise ValueError("no bands fit")


def signatures(doc: np.ndarray, tokens: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit value per set and band; all sets have tokens."""
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    keys = W.mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64)).reshape(-1, 2)
    spread = W.mix(tokens)
    out = np.empty((len(first), bands), dtype=np.uint64)
    for b in range(bands):
        value = np.full(len(first), b + 1, dtype=np.uint64)
        for k in range(b * rows, (b + 1) * rows):
            least = np.minimum.reduceat((spread ^ keys[k, 0]) * (keys[k, 1] | np.uint64(1)), first)
            value = W.mix(value * np.uint64(W._BASE) + least)
        out[:, b] = value
    return out


def paragraphs(data: np.ndarray, offsets: np.ndarray, least_words: int, size: int):
    """Lines of at least `least_words` words: text number, line number, first and last byte, words; and their sets."""
    ends = np.union1d(offsets, np.flatnonzero(data == _LINE_END) + 1)
    ends = ends if ends[0] == 0 else np.concatenate(([0], ends))
    start, _, line = W.word_spans(data, ends, W.BLANK_SEPARATED)
    count = np.bincount(line, minlength=len(ends) - 1)
    kept = np.flatnonzero(count >= max(1, least_words))
    doc = np.searchsorted(offsets, ends[kept], side="right") - 1
    number = kept - np.searchsorted(ends, offsets[doc])
    # The chosen lines, one after the other, as texts of their own.
    length = ends[kept + 1] - ends[kept]
    cuts = np.concatenate(([0], np.cumsum(length)))
    own = data[np.repeat(ends[kept] - cuts[:-1], length) + np.arange(cuts[-1])] if len(kept) else data[:0]
    which, tokens = shingle_sets(W.LOWER[own], cuts, size)
    low, high = ends[kept] - offsets[doc], ends[kept + 1] - offsets[doc]
    high = high - (own[cuts[1:] - 1] == _LINE_END) if len(kept) else high
    return doc, number, low, high, count[kept], which, tokens


def place_keys(ids: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    return W.mix(ids.astype(np.int64).view(np.uint64) * np.uint64(W._BASE) + numbers.astype(np.uint64))


def _occurrences(docs: DataFrame, least_words: int, size: int, bands: int, rows: int) -> DataFrame:
    names = ["id", "paragraph", "start", "stop", "n_words", "n", "pid", "place", "bands"]

    def run(batches):
        for batch in batches:
            for part, data, offsets in W.text_slices(batch, "text"):
                doc, number, low, high, count, which, tokens = paragraphs(data, offsets, least_words, size)
                if not len(doc):
                    continue
                ids = part.column(0).to_numpy()[doc]
                values = signatures(which, tokens, bands, rows).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[pa.array(x.astype(np.int64)) for x in (ids, number, low, high, count, np.bincount(which, minlength=len(doc)))],
                        pa.array(set_digests(which, tokens, len(doc))[0]),
                        pa.array(place_keys(ids, number).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(doc) + 1, dtype=np.int32) * bands), pa.array(values.ravel())),
                    ],
                    names=names,
                )

    return docs.mapInArrow(run, "id long, paragraph long, start long, stop long, n_words long, n long, pid long, place long, bands array<long>")


def _sieve(places: DataFrame) -> np.ndarray:
    """Bits of `place` values, two each; at most SIEVE_BITS / 64 rows come to the driver, however many there are."""
    mask = SIEVE_BITS - 1
    both = F.array(F.col("place").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("place", 32).bitwiseAND(F.lit(mask)))
    bits = places.select(F.explode(both).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("value"))
    out = np.zeros(SIEVE_BITS // 64, dtype=np.int64)
    got = words.toArrow()  # numbers side by side, not a Python object per row
    out[got.column("word").to_numpy()] = got.column("value").to_numpy()
    return out.view(np.uint64)


def _passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), dtype=bool)
    for at in (keys & np.uint64(SIEVE_BITS - 1), (keys >> np.uint64(32)) & np.uint64(SIEVE_BITS - 1)):
        out &= (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)) == 1
    return out


def _wanted_sets(docs: DataFrame, places: DataFrame, least_words: int, size: int) -> DataFrame:
    """(id: paragraph's digest, n, tokens) of at least the paragraphs at `places`."""
    sent = docs.sparkSession.sparkContext.broadcast(_sieve(places))

    def run(batches):
        for batch in batches:
            for part, data, offsets in W.text_slices(batch, "text"):
                doc, number, _, _, _, which, tokens = paragraphs(data, offsets, least_words, size)
                if not len(doc):
                    continue
                keep = np.flatnonzero(_passes(sent.value, place_keys(part.column(0).to_numpy()[doc], number)))
                cuts = np.searchsorted(which, np.arange(len(doc) + 1))
                pids = set_digests(which, tokens, len(doc))[0][keep]
                own = [np.sort(tokens[cuts[k] : cuts[k + 1]]).astype("<i8").tobytes() for k in keep]
                yield pa.RecordBatch.from_arrays([pa.array(pids), pa.array((cuts[keep + 1] - cuts[keep]).astype(np.int64)), pa.array(own, pa.binary())], ["id", "n", "tokens"])

    return docs.mapInArrow(run, "id long, n long, tokens binary")


def substring_dedup(
    spark: SparkSession,
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    least_words: int = 20,
    size: int = 5,
    percent: int = 80,
    recall: float = 0.999,
) -> DataFrame:
    """A row for every paragraph that has a near copy: `id`, `paragraph` (number of the line, from 0), `start` and `stop`
    (bytes of the text in UTF-8), `n_words`, `class_id` and `class_paragraph` (document and line of the paragraph that
    stays for all of its component), `removed` (false for that one).

    Paragraphs of fewer than `least_words` words are left alone. Similarity: Jaccard of distinct n-grams of `size` words,
    A-Z in lower case, `percent` or more. Null or empty texts and rows with a null id have no paragraphs. Repeated
    rows are copies of each other (of rows with one id and equal text, the line of either stands for both). An empty
    table gives no rows. Ids are integers; other columns are not read.
    """
    own = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null")
    scratch = Scratch(spark, "passages")
    bands, rows = tune(percent, recall)
    seen = scratch.stored(_occurrences(own, least_words, size, bands, rows))
    each = seen.groupBy("pid").agg(F.min(F.struct("id", "paragraph")).alias("first"), F.count("*").alias("copies"), F.min("n").alias("n"))
    dealt = seen.select(F.explode("bands").alias("token"), F.col("pid").alias("id"), "n")
    met = dealt.groupBy("token").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("token")
    nodes = scratch.stored(dealt.join(scratch.stored(met), "token", "left_semi").distinct().withColumn("at", F.lit(0).cast("long")))
    wanted = nodes.select(F.col("id").alias("pid")).distinct()
    first = seen.join(wanted, "pid", "left_semi").groupBy("pid").agg(F.min("place").alias("place"))
    sets = scratch.stored(_wanted_sets(own, scratch.stored(first), least_words, size).join(wanted.withColumnRenamed("pid", "id"), "id", "left_semi"))
    found = _Search(scratch, sets.withColumn("lead", F.lit(0).cast("long")), nodes, percent).run().withColumnRenamed("node", "pid")
    each = each.join(found, "pid", "left").withColumn("component", F.coalesce("component", "pid"))
    each = scratch.stored(each)
    classes = each.groupBy("component").agg(F.min("first").alias("kept"), F.sum("copies").alias("k")).where("k > 1")
    members = each.select("pid", "component").join(classes, "component").select("pid", "kept")
    return seen.join(members, "pid").select(
        F.col("id").alias(id),
        "paragraph",
        "start",
        "stop",
        "n_words",
        F.col("kept.id").alias("class_id"),
        F.col("kept.paragraph").alias("class_paragraph"),
        ((F.col("id") != F.col("kept.id")) | (F.col("paragraph") != F.col("kept.paragraph"))).alias("removed"),
    )


def chunks(data: np.ndarray, offsets: np.ndarray, size: int):
    """Windows of `size` words within a text: hash, text number, number of the first word, first and last byte; and where
    the chunks begin, with the least gram's hash of each: windows in a row that have the same one."""
    start, end, doc = W.word_spans(data, offsets, W.BLANK_SEPARATED)
    n = max(0, len(start) - size + 1)
    words = W.word_hashes(W.LOWER[data], start, end)
    up, down = W.powers(len(words) + 1)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])

    def grams(k: int) -> np.ndarray:
        return W.mix((sums[k:] - sums[:-k]) * down[: len(sums) - k])

    at = np.flatnonzero(doc[:n] == doc[size - 1 :]) if n else np.zeros(0, np.int64)
    if not len(at):
        return np.zeros(0, np.uint64), at, at, at, at, at, np.zeros(0, np.uint64)
    gram = min(GRAM, size)
    least, width, whole = grams(gram), 1, size - gram + 1
    while width < whole:
        step = min(width, whole - width)
        least, width = np.minimum(least[:-step], least[step:]), width + step
    least, own = least[at], doc[at]
    cut = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (own[1:] != own[:-1]))))
    first_word = np.searchsorted(doc, own)
    return grams(size)[at], own, at - first_word, start[at] - offsets[own], end[at + size - 1] - offsets[own], cut, least[cut]


def _chunk_names(docs: DataFrame, size: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for _, data, offsets in W.text_slices(batch, "text"):
                window, *_, cut, name = chunks(data, offsets, size)
                length = np.diff(np.concatenate((cut, [len(window)])))
                name, at = np.unique(name.view(np.int64), return_inverse=True)
                # A long chunk can repeat a window within itself: it counts twice.
                met = np.bincount(at, weights=1 + (length > size), minlength=len(name)).astype(np.int64)
                windows = np.bincount(at, weights=length, minlength=len(name)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(met), pa.array(windows)], ["place", "k", "windows"])

    return docs.mapInArrow(run, "place long, k long, windows long")


_CHUNK = "id long, name long, common boolean, first long, windows array<long>, starts array<int>, stops array<int>"


def _wanted_chunks(docs: DataFrame, names: DataFrame, size: int) -> DataFrame:
    """At least the chunks of `names`, with their windows, of which a row has at most PIECE. `common` is alike for all chunks of a name, and
    true of at least those names that more than MOST_OF_NAME chunks or MOST_WINDOWS windows have."""
    context = docs.sparkSession.sparkContext
    most = PIECE
    many = (F.col("k") > MOST_OF_NAME) | (F.col("windows") > MOST_WINDOWS)
    sent, often = context.broadcast(_sieve(names)), context.broadcast(_sieve(names.where(many)))

    def run(batches):
        for batch in batches:
            for part, data, offsets in W.text_slices(batch, "text"):
                window, doc, word, low, high, cut, name = chunks(data, offsets, size)
                kept = np.flatnonzero(_passes(sent.value, name))
                if not len(kept):
                    continue
                length = np.diff(np.concatenate((cut, [len(window)])))[kept]
                # A window's name is its own, so a chunk can be cut anywhere.
                pieces = -(-length // most)
                of = np.repeat(np.arange(len(kept)), pieces)
                skipped = (np.arange(len(of)) - np.searchsorted(of, of)) * most
                cut, name, length, kept = cut[kept][of] + skipped, name[kept][of], np.minimum(length[of] - skipped, most), np.arange(len(of))
                ends = np.concatenate(([0], np.cumsum(length)))
                at = np.repeat(cut[kept] - ends[:-1], length) + np.arange(ends[-1])
                lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x)) for x in (window[at].view(np.int64), low[at].astype(np.int32), high[at].astype(np.int32))]
                ids = part.column(0).to_numpy()[doc[cut[kept]]].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(name[kept].view(np.int64)), pa.array(_passes(often.value, name[kept])), pa.array(word[cut[kept]].astype(np.int64)), *lists], ["id", "name", "common", "first", "windows", "starts", "stops"])

    return docs.mapInArrow(run, _CHUNK)


def _repeats(size: int):
    """Runs of windows that come again, from all chunks of some names."""

    def run(table: pa.Table) -> pa.Table:
        def flat(name):
            return table.column(name).combine_chunks().flatten().to_numpy()

        length = np.asarray(table.column("windows").combine_chunks().value_lengths())
        row = np.repeat(np.arange(len(length)), length)
        begin = np.cumsum(length) - length
        ids, first = (table.column(c).to_numpy() for c in ("id", "first"))
        word, owner, window = first[row] + np.arange(len(row)) - begin[row], ids[row], flat("windows")
        order = np.lexsort((word, owner, window))
        w, i, k = window[order], owner[order], word[order]
        fresh = np.concatenate(([True], w[1:] != w[:-1]))
        head = np.flatnonzero(fresh)
        tail = np.concatenate((head[1:], [len(w)])) - 1
        which = np.cumsum(fresh) - 1
        twice = np.concatenate(([False], ~fresh[1:] & (i[1:] == i[:-1]) & (k[1:] == k[:-1])))  # rows that repeat an id
        shared = (i[head] != i[tail]) | (k[tail] - k[head] >= size) | (np.bincount(which[twice], minlength=len(head)) > 0)
        # Windows that overlap the first one of their own text are no copies of it.
        kept = (i == i[head][which]) & (k - k[head][which] < size)
        of, to = np.where(kept, i, i[head][which]), np.where(kept, 0, k[head][which] - k)
        take = shared[which]
        at = order[take]
        back = np.argsort(at)
        at, kept, of, to = at[back], kept[take][back], of[take][back], to[take][back]
        new = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]]) | (kept[1:] != kept[:-1]) | (of[1:] != of[:-1]) | (to[1:] != to[:-1])))[: len(at)]
        a = np.flatnonzero(new)
        b = np.concatenate((a[1:], [len(at)]))[: len(a)] - 1
        return pa.table({
            "id": owner[at[a]], "low": word[at[a]], "high": word[at[b]], "start": flat("starts")[at[a]].astype(np.int64), "stop": flat("stops")[at[b]].astype(np.int64),
            "removed": ~kept[a], "class_id": of[a], "shift": to[a],
        })

    return run


_RUNS = "id long, low long, high long, start long, stop long, removed boolean, class_id long, shift long"


def _common_repeats(chunks: DataFrame, size: int, salts: int) -> DataFrame:
    """What `_repeats` finds, as runs of one window each, however many chunks of one name and rows of one window there are:
    both steps deal the rows of a window by `salts` values of their id and place, and only a row per window and salt meets in between."""
    each = chunks.select("id", "first", F.posexplode(F.arrays_zip("windows", "starts", "stops")).alias("k", "own"))
    each = each.select(
        "id", (F.col("first") + F.col("k")).alias("word"), F.col("own.windows").alias("window"), F.pmod(F.xxhash64("id", F.floor((F.col("first") + F.col("k")) / PIECE)), F.lit(salts)).alias("salt"),
        F.col("own.starts").cast("long").alias("start"), F.col("own.stops").cast("long").alias("stop"),
    )
    # Places of windows that all overlap, as bits: fewer than rows if rows repeat an id.
    lanes, at = range(-(-size // 64)), F.struct("id", "word")
    bit, lane = F.expr("shiftleft(1L, cast(word & 63 as int))"), F.shiftright(F.pmod("word", F.lit(64 * len(lanes))), 6)
    bits = [F.bit_or(F.when(lane == j, bit).otherwise(F.lit(0).cast("long"))).alias(f"bits{j}") for j in lanes]
    parts = each.groupBy("window", "salt").agg(F.min(at).alias("head"), F.max(at).alias("tail"), F.count("*").alias("k"), *bits)
    whole = parts.groupBy("window").agg(
        F.min("head").alias("head"), F.max("tail").alias("tail"), F.sum("k").alias("k"), F.collect_list("salt").alias("salts"), *[F.bit_or(f"bits{j}").alias(f"bits{j}") for j in lanes]
    )
    places = sum((F.bit_count(f"bits{j}") for j in lanes), F.lit(0))
    shared = whole.where((F.col("head.id") != F.col("tail.id")) | (F.col("tail.word") - F.col("head.word") >= size) | (F.col("k") > places))
    shared = shared.select("window", F.col("head.id").alias("of"), F.col("head.word").alias("to"), F.explode("salts").alias("salt"))
    stays = (F.col("id") == F.col("of")) & (F.col("word") - F.col("to") < size)
    return each.join(shared, ["window", "salt"]).select(
        "id", F.col("word").alias("low"), F.col("word").alias("high"), "start", "stop", (~stays).alias("removed"),
        F.when(stays, F.col("id")).otherwise(F.col("of")).alias("class_id"), F.when(stays, F.lit(0).cast("long")).otherwise(F.col("to") - F.col("word")).alias("shift"),
    )


def repeated_passages(spark: SparkSession, docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 50) -> DataFrame:
    """A row for every longest run of words whose windows of `size` words all come again, in another document or further on
    in the same one: `id`, `paragraph` (number of its first word, from 0), `start` and `stop` (bytes of the text in UTF-8),
    `n_words`, `class_id` and `class_paragraph` (document and first word of the copy that stays), `removed` (false for it).

    A run ends where the copy that stays changes; runs can overlap by up to `size` - 1 words. Words are separated by
    blanks and line ends alike, A-Z in lower case. What holds for nulls and repeated rows in `substring_dedup`, does here.
    """
    own = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null")
    scratch = Scratch(spark, "repeats")
    names = scratch.stored(_chunk_names(own, size).groupBy("place").agg(F.sum("k").alias("k"), F.sum("windows").alias("windows")).where("k > 1"))
    found = scratch.stored(_wanted_chunks(own, names, size))
    n = {r.common: r.n for r in found.groupBy("common").agg(F.sum(F.size("windows")).alias("n")).collect()}
    groups, salts = (max(partitions(spark), -(-n.get(c, 0) // GROUP)) for c in (False, True))
    dealt = found.where("not common").withColumn("bucket", F.pmod("name", F.lit(groups)))
    runs = dealt.groupBy("bucket").applyInArrow(_repeats(size), _RUNS)
    if True in n:
        runs = runs.unionByName(_common_repeats(found.where("common"), size, salts))
    keys = ["id", "removed", "class_id", "shift"]
    by = Window.partitionBy(*keys).orderBy("low", "high")
    before = F.max("high").over(by.rowsBetween(Window.unboundedPreceding, -1))
    joined = runs.withColumn("new", F.coalesce((F.col("low") > before + 1).cast("int"), F.lit(1)))
    joined = joined.withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    spans = joined.groupBy(*keys, "run").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    return spans.select(
        F.col("id").alias(id),
        F.col("low").alias("paragraph"),
        "start",
        "stop",
        (F.col("high") - F.col("low") + size).alias("n_words"),
        "class_id",
        (F.col("low") + F.col("shift")).alias("class_paragraph"),
        "removed",
    )


def line_and_passage_dedup(spark: SparkSession, docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of `substring_dedup` (`unit` is line) and of `repeated_passages` (`unit` is passage)."""
    lines = substring_dedup(spark, docs, id, text).withColumn("unit", F.lit("line"))
    return lines.unionByName(repeated_passages(spark, docs, id, text).withColumn("unit", F.lit("passage")))
