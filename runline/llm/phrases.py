"""Phrase collocations: contiguous word sequences that come often, scored by their weakest cut.

Words are counted per task and summed; those below the least count end a run of words like a piece's border does, as no phrase with one
can be frequent. The others get dense numbers. At each place the next five numbers, zeros beyond a run's end, are one key of fixed width:
its prefixes are all phrases that begin there. Keys are sorted by radix and run-length counted in the task that read them, then
dealt to ranges of keys, sorted and counted there: one sorted range gives the counts of phrases of every length. A prefix may run over a
range's border, so the first and the last of each length are summed over ranges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runline.llm import words as W
from runline.llm.scratch import Scratch

#: Bytes of text whose words are numbered together.
CHUNK_BYTES = 4 << 20
#: Keys in one range, and ranges at most (their bounds are sent to tasks, 20 bytes each): beyond it ranges get larger.
RANGE_KEYS, MOST_RANGES = 1_500_000, 1 << 20
#: Chunks, chosen by hash, and keys per range in the sample that the bounds are taken from. It bears on balance alone.
SAMPLED_CHUNKS, SAMPLED_KEYS = 64, 32
#: A dictionary of at most so many bytes (as stored) is sent to tasks; a larger one is joined by shuffling.
MOST_SENT = 32 << 20
SALTS = 64

_PIECE_ENDS = np.zeros(256, dtype=bool)
_PIECE_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_IN_WORDS = ~_PIECE_ENDS
_IN_WORDS[[0x20, 0x09]] = False


def _parts(data: np.ndarray, offsets: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets with long texts cut where pieces end, and the text that each part is of. A longer piece stays whole."""
    cuts, texts = [offsets], [np.arange(len(offsets) - 1)]
    for t in np.flatnonzero(np.diff(offsets) > most).tolist():
        ends = offsets[t] + np.flatnonzero(_PIECE_ENDS[data[offsets[t] : offsets[t + 1]]]) + 1
        steps = np.arange(offsets[t] + most, offsets[t + 1], most)
        own = np.unique(ends[np.maximum(np.searchsorted(ends, steps, side="right") - 1, 0)]) if len(ends) else ends
        own = own[(own > offsets[t]) & (own < offsets[t + 1])]
        cuts.append(own)
        texts.append(np.full(len(own), t))
    begins, texts = np.concatenate([offsets[:-1], *cuts[1:]]), np.concatenate(texts)
    order = np.lexsort((texts, begins))
    return np.append(begins[order], offsets[-1]), texts[order]


def _number_words(most: int):
    """Per chunk of `most` bytes: a row with its words' numbers in it (from 1; 0 ends a piece), and a row for each different (lang, word)."""

    def run(batches):
        part, chunk = TaskContext.get().partitionId() << 33, 0
        names = ["chunk", "codes", "local", "lang", "word", "n"]
        for batch in batches:
            data, offsets = W.text_bytes(batch.column(1))
            langs = batch.column(0).fill_null("und").dictionary_encode()
            offsets, texts = _parts(data, offsets, most)
            lang_of = langs.indices.to_numpy().astype(np.int64)[texts]
            for low, high in W.slices(offsets, most):
                own = W.LOWER[data[offsets[low] : offsets[high]]]
                start, end, text = W.word_spans(own, offsets[low : high + 1] - offsets[low], _IN_WORDS)
                if not len(start):
                    continue
                lang = lang_of[low + text]
                piece = np.cumsum(_PIECE_ENDS[own])[start]
                names_of = W.mix(W.word_hashes(own, start, end) + lang.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                _, first, local, count = np.unique(names_of, return_index=True, return_inverse=True, return_counts=True)
                ends = (np.diff(piece) != 0) | (np.diff(text) != 0)
                codes = np.zeros(len(start) + int(ends.sum()), dtype="<u4")
                codes[np.arange(len(start)) + np.insert(np.cumsum(ends), 0, 0)] = local + 1
                size = end[first] - start[first]
                to = np.insert(np.cumsum(size), 0, 0)
                spelled = own[np.repeat(start[first] - to[:-1], size) + np.arange(to[-1])]
                words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(to.astype(np.int64)), pa.py_buffer(spelled)).cast(pa.string())
                k, one = len(first), [part | chunk]
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array([codes.tobytes()], pa.binary()), *(pa.nulls(1, t) for t in (pa.int32(), pa.string(), pa.string(), pa.int64()))], names=names)
                for a in range(0, k, 100_000):
                    b = min(k, a + 100_000)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(one * (b - a)),
                            pa.nulls(b - a, pa.binary()),
                            pa.array(np.arange(a, b, dtype=np.int32)),
                            langs.dictionary.take(pa.array(lang[first[a:b]])).cast(pa.string()),
                            words.slice(a, b - a),
                            pa.array(count[a:b]),
                        ],
                        names=names,
                    )
                chunk += 1

    return run


def _order(keys: np.ndarray) -> np.ndarray:
    """Order of rows of numbers by radix: a stable pass per 16 bits that are used, from the last to the first."""
    order = np.arange(len(keys))
    for column in range(keys.shape[1])[::-1]:
        values = keys[:, column]
        top = int(values.max()) if len(values) else 0
        for shift in range(0, max(1, top.bit_length()), 16):
            digit = ((values >> np.uint32(shift)) & np.uint32(0xFFFF)).astype(np.uint16)
            order = order[np.argsort(digit[order], kind="stable")]
    return order


def _counted(keys: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Different rows in order, and their counts."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    order = _order(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.insert((keys[1:] != keys[:-1]).any(axis=1), 0, True))
    if counts is None:
        return keys[starts], np.diff(np.append(starts, len(keys)))
    return keys[starts], np.add.reduceat(counts[order], starts)


def _windows(ids: np.ndarray, longest: int) -> np.ndarray:
    """Rows of the next `longest` numbers at each place with two of them; zeros after the first zero."""
    padded = np.append(ids, np.zeros(longest, ids.dtype))
    at = np.flatnonzero((padded[:-1] != 0) & (padded[1:] != 0))
    out = np.zeros((len(at), longest), dtype=np.uint32)
    out[:, 0], out[:, 1] = padded[at], padded[at + 1]
    for k in range(2, longest):
        out[:, k] = np.where(out[:, k - 1] != 0, padded[np.minimum(at + k, len(padded) - 1)], 0)
    return out


def _binary(keys: np.ndarray, width: int) -> np.ndarray:
    """Keys of fixed width: their byte order is the order of the rows."""
    if not len(keys):
        return np.zeros(0, f"S{keys.shape[1] * width}")
    wide = np.ascontiguousarray(keys.astype(">u4")).view(np.uint8).reshape(len(keys), keys.shape[1], 4)
    return np.ascontiguousarray(wide[:, :, 4 - width :]).reshape(len(keys), -1).view(f"S{keys.shape[1] * width}").ravel()


def _pack(keys: np.ndarray, counts: np.ndarray, width: int) -> bytes:
    """Byte planes of sorted keys and of their counts: alike bytes stand together."""
    columns = [W.planes(keys[:, k].astype(np.uint64), width) for k in range(keys.shape[1])]
    return pa.compress(b"".join([*columns, W.planes(counts.astype(np.uint64), 6)]), codec="zstd", asbytes=True)


def _unpack(blob: bytes, n: int, longest: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    raw = pa.decompress(blob, n * (longest * width + 6), codec="zstd", asbytes=True)
    size = n * width
    keys = np.stack([W.from_planes(raw[k * size : (k + 1) * size], width).astype(np.uint32) for k in range(longest)], axis=1)
    return keys, W.from_planes(raw[longest * size :], 6).astype(np.int64)


def _numbered(scratch: Scratch, rows: DataFrame) -> tuple[DataFrame, int]:
    """`rows` with `id`, from 1 on without gaps, and their number. A number per task goes to the driver and back."""
    rows = scratch.stored(rows.withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    added, total = [], 0
    for r in rows.groupBy("part").agg(F.min("at").alias("first"), F.count("*").alias("k")).orderBy("part").collect():
        added.append((r["part"], total + 1 - r["first"]))
        total += r["k"]
    table = scratch.spark.createDataFrame(added, "part long, more long")
    return scratch.stored(rows.join(F.broadcast(table), "part").select(*[c for c in rows.columns if c not in ("at", "part")], (F.col("at") + F.col("more")).alias("id"))), total


def counted_phrases(spark: SparkSession, docs: DataFrame, lang: str, text: str, least: int, longest: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(phrases (key, k, f) of 2 to `longest` words with f >= least; dictionary (lang, word, f, id); words per lang; bytes per id).
    A phrase's key: its words' ids, big-endian, in a row."""
    scratch = Scratch(spark, "phrases")
    numbered = scratch.stored(
        docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).mapInArrow(_number_words(CHUNK_BYTES), "chunk long, codes binary, local int, lang string, word string, n long")
    )
    met = numbered.where("codes is null").select("chunk", "local", "lang", "word", "n")
    per_lang = scratch.stored(met.groupBy("lang").agg(F.sum("n").alias("n")))
    dictionary, n_words = _numbered(scratch, met.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least))
    width = max(1, (n_words.bit_length() + 7) // 8)
    if width > 4:
        raise ValueError("more than 2**32 frequent words")
    known = dictionary.select("lang", "word", F.col("id").cast("long").alias("id"))
    if n_words * 40 <= MOST_SENT:
        known = F.broadcast(known)

    def ids_in(rows: DataFrame) -> DataFrame:
        """At most a row for each of `rows`: a word is in the dictionary once."""
        return rows.join(known, ["lang", "word"]).select(F.col("chunk").alias("of"), "local", "id")

    codes = numbered.where("codes is not null").select("chunk", "codes")
    total = per_lang.agg(F.sum("n")).first()[0] or 0
    ranges = min(MOST_RANGES, max(1, -(-total // RANGE_KEYS)))

    def keys_of(left: pa.Table, right: pa.Table):
        if not left.num_rows or not right.num_rows:
            return None
        code = np.frombuffer(left.column("codes")[0].as_py(), "<u4")
        table = np.zeros(int(code.max()) + 1, dtype=np.uint32)
        table[right.column("local").to_numpy() + 1] = right.column("id").to_numpy()
        return _counted(_windows(table[code], longest), None)

    def sample(left: pa.Table, right: pa.Table) -> pa.Table:
        found, most = keys_of(left, right), -(-SAMPLED_KEYS * ranges // SAMPLED_CHUNKS)
        taken = [] if found is None or not len(found[0]) else [found[0][np.linspace(0, len(found[0]) - 1, min(most, len(found[0]))).astype(np.int64)].tobytes()]
        return pa.table({"keys": pa.array(taken, pa.binary())})

    bounds = np.zeros((0, longest), np.uint32)
    if ranges > 1:
        some = codes.select("chunk").orderBy(F.xxhash64("chunk"), "chunk").limit(SAMPLED_CHUNKS)
        some = F.broadcast(scratch.stored(some))
        seen = codes.join(some, "chunk").groupBy("chunk").cogroup(ids_in(met.join(some, "chunk")).groupBy("of")).applyInArrow(sample, "keys binary")
        seen = [np.frombuffer(r["keys"], np.uint32).reshape(-1, longest) for r in seen.collect()]
        if seen:
            seen = np.concatenate(seen)
            seen = seen[_order(seen)]
            bounds = np.unique(seen[np.linspace(0, len(seen) - 1, ranges + 1).astype(np.int64)[1:-1]], axis=0)
    sent = spark.sparkContext.broadcast(_binary(bounds, width).tolist())

    def deal(left: pa.Table, right: pa.Table) -> pa.Table:
        found = keys_of(left, right)
        numbers, sizes, blobs = [], [], []
        if found is not None and len(found[0]):
            keys, counts = found
            cuts = np.searchsorted(_binary(keys, width), np.array(sent.value, f"S{longest * width}")) if sent.value else np.zeros(0, np.int64)
            edges = np.concatenate([[0], cuts, [len(keys)]])
            for k in np.flatnonzero(np.diff(edges)).tolist():
                a, b = int(edges[k]), int(edges[k + 1])
                numbers.append(k)
                sizes.append(b - a)
                blobs.append(_pack(keys[a:b], counts[a:b], width))
        return pa.table({"range": pa.array(numbers, pa.int32()), "n": pa.array(sizes, pa.int64()), "keys": pa.array(blobs, pa.binary())})

    def count(group: pa.Table) -> pa.Table:
        both = [_unpack(b, n, longest, width) for b, n in zip(group.column("keys").to_pylist(), group.column("n").to_pylist(), strict=True)]
        keys, counts = _counted(np.concatenate([k for k, _ in both]), np.concatenate([c for _, c in both]))
        names, lengths, sums = [], [], []
        changed = np.zeros(len(keys), dtype=bool)
        changed[0] = True
        changed[1:] = keys[1:, 0] != keys[:-1, 0]
        for k in range(2, longest + 1):
            changed[1:] |= keys[1:, k - 1] != keys[:-1, k - 1]
            starts = np.flatnonzero(changed)
            f = np.add.reduceat(counts, starts)
            kept = f >= least
            kept[0] = kept[-1] = True  # these may go on in the ranges beside
            kept &= keys[starts, k - 1] != 0
            if kept.any():
                names += [x.ljust(k * width, b"\0") for x in _binary(keys[starts[kept], :k], width).tolist()]
                lengths.append(np.full(int(kept.sum()), k, np.int32))
                sums.append(f[kept])
        return pa.table({"key": pa.array(names, pa.binary()), "k": pa.array(np.concatenate(lengths) if lengths else [], pa.int32()), "f": pa.array(np.concatenate(sums) if sums else [], pa.int64())})

    dealt = codes.groupBy("chunk").cogroup(ids_in(met).groupBy("of")).applyInArrow(deal, "range int, n long, keys binary")
    found = dealt.groupBy("range").applyInArrow(count, "key binary, k int, f long")
    phrases = scratch.stored(found.groupBy("key", "k").agg(F.sum("f").alias("f")).where(F.col("f") >= least))
    return phrases, dictionary, per_lang, width


def phrases(
    spark: SparkSession,
    docs: DataFrame,
    lang: str = "lang",
    text: str = "text",
    least: int = 100,
    longest: int = 5,
    share: int = 100,
    top: int = 2000,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language.

    Texts are lower-cased (A-Z) and split into pieces at `[.,;:!?\\x0A-\\x0D]`, pieces into words at blanks and tabs. A phrase: 2 to `longest` words in a
    row within a piece, at least `least` times in its language's texts (overlaps count; repeated rows count as often as they stand there). A cut into
    two parts of l and r occurrences scores floor(1000 * a * n / (l * r)), where n are the language's words; the lowest cut counts, of equal ones the
    first. Phrases inside a longer one with at least `share` percent of their occurrences are dropped. Order: score, then a, both descending, then phrase.

    A null language is `und`, together with rows that say so; a null or empty text has no words; no rows give none; further columns are not read. A long
    text is read in parts, cut where pieces end. Words are told apart within a chunk of text by 64 bits of a hash, across chunks by themselves.
    All arithmetic is exact: products are decimals of 38 digits, and an overflow is an error.
    """
    if not 2 <= longest <= 8:
        raise ValueError("longest: 2 to 8 words")
    found, dictionary, per_lang, width = counted_phrases(spark, docs, lang, text, least, longest)
    scratch = Scratch(spark, "phrases")
    word_key = F.unhex(F.lpad(F.hex("id"), 2 * width, "0"))
    occurs = found.select("key", "f").unionByName(dictionary.select(word_key.alias("key"), "f"))

    def part(begin, length):
        return F.substring(F.col("key"), begin * width + 1, length * width)

    # Words of each phrase, and its language.
    spelled = found.select("key", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i")).select("key", "i", part(F.col("i"), F.lit(1)).alias("one"))
    spelled = spelled.join(dictionary.select(word_key.alias("one"), "lang", "word"), "one")
    spelled = spelled.groupBy("key").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    # Inside longer ones.
    inner = found.where("k > 2").select("key", "k", "f", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("m")).select("key", "k", "f", "m", F.explode(F.sequence(F.lit(0), F.col("k") - F.col("m"))).alias("at"))
    inner = inner.select(part(F.col("at"), F.col("m")).alias("key"), "f").groupBy("key").agg(F.max("f").alias("longer"))
    kept = found.join(inner, "key", "left").where(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(share) * F.col("f"))).select("key", "k", F.col("f").alias("a"))
    kept = scratch.stored(kept.join(spelled, "key").join(per_lang, "lang"))
    cuts = kept.select("key", "a", "n", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("key", "a", "n", "cut", part(F.lit(0), F.col("cut")).alias("left"), part(F.col("cut"), F.col("k") - F.col("cut")).alias("right"))
    cuts = cuts.join(occurs.select(F.col("key").alias("left"), F.col("f").alias("l")), "left").join(occurs.select(F.col("key").alias("right"), F.col("f").alias("r")), "right")
    exact = "(cast(1000 as decimal(4, 0)) * cast(a as decimal(19, 0)) * cast(n as decimal(19, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"
    lowest = cuts.withColumn("score", F.expr(exact)).groupBy("key").agg(F.min(F.struct("score", "cut", "l", "r")).alias("low"))
    scored = kept.join(lowest, "key").select("lang", "phrase", "a", F.col("low.l").alias("l"), F.col("low.r").alias("r"), "n", F.col("low.score").alias("score"))
    # The first of each share of a language, then of these: a language's phrases are not sorted in one task.
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    first = Window.partitionBy("lang", "salt").orderBy(*order)
    scored = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return scored.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
