"""URL rules by a cascade of Bloom filters, in DataFrame expressions only.

Listed keys are rules (host, path). Every URL offers a few candidate keys: its host's last labels with a beginning
of its path, one for each shape (number of labels, length of path) that some rule has. Level 1 of the cascade encodes the
listed keys; level 2 the candidate keys of the whole corpus that pass level 1 and aren't listed; level 3 the listed
keys that pass level 2, and so on until nothing is left. Over the corpus's keys membership is then exact, and the
pages are judged in one scan without a join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runline.llm.scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of all levels together, which are sent with the plan. A list that needs more is refused.
MOST_BITS = 1 << 26


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty if there is no `://`."""
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.translate(host, UPPER, LOWER)).otherwise("")


def url_path(url: Column) -> Column:
    """From the end of the host up to `?`, `#` or the end."""
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, path).otherwise("")


def candidate(host: Column, path: Column, labels: int, length: int) -> Column:
    """The key of one shape, or null where the URL has no such labels or path. A key is host + path."""
    dots = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))
    fits = (F.length(host) > 0) & (dots >= labels - 1) & (F.length(path) >= length)
    return F.when(fits, F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, length)))


class Level:
    """A Bloom filter of one level: bits in 64-bit words, as a literal in the plan."""

    def __init__(self, number: int, size: int, hashes: int):
        self.number, self.size, self.hashes, self.words = number, size, hashes, [0] * (size // 64)

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(1000 * self.number + k)), F.lit(self.size)) for k in range(self.hashes)]

    def fill(self, keys: DataFrame) -> Level:
        """keys: a column `key`. At most `size / 64` rows come back, whatever the number of keys."""
        bits = keys.select(F.explode(F.array(*self.positions(F.col("key")))).alias("bit"))
        words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("value"))
        for row in words.collect():
            self.words[row.word] = row.value
        return self

    def passes(self, key: Column) -> Column:
        table = F.array(*[F.lit(w).cast("long") for w in self.words])
        out = F.lit(True)
        for bit in self.positions(key):
            word = F.element_at(table, (F.shiftright(bit, 6) + 1).cast("int"))
            out = out & (F.getbit(word, bit.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return out


def _level(number: int, keys: int, rate: float) -> Level:
    hashes = max(1, round(-math.log2(rate)))
    size = max(64, math.ceil(keys * hashes / math.log(2) / 64) * 64)
    return Level(number, size, hashes)


class Cascade:
    """Exact membership of the listed keys among all keys of `universe` (a column `key`, repeats allowed)."""

    def __init__(self, spark: SparkSession, listed: DataFrame, universe: DataFrame, most_bits: int = MOST_BITS, most_levels: int = 64):
        self.levels: list[Level] = []
        scratch = Scratch(spark, "cascade")
        inside = listed.select("key").where("key is not null").distinct()
        n, all_keys = inside.count(), universe.count()
        self.empty = n == 0
        if self.empty or not all_keys:
            self.empty = True
            return
        # Level 1 lets about n / sqrt(2) others pass, later levels half: all levels together stay near 1.44 n log2(N / n).
        rate = min(0.5, n / (math.sqrt(2) * max(all_keys, n)))
        outside, number = universe, 1
        while True:
            level = _level(number, n, rate if number == 1 else 0.5)
            if sum(x.size for x in self.levels) + level.size > most_bits:
                raise ValueError(f"{n} listed keys need more than {most_bits} bits")
            self.levels.append(level.fill(inside))
            # What of the other side passes, is encoded next; each table is about half of the one before.
            passing = outside.where(level.passes(F.col("key")))
            if number == 1:
                passing = passing.join(inside, "key", "left_anti")
            passing = scratch.stored(passing.select("key").distinct())
            inside, outside, n = passing, inside, passing.count()
            if not n:
                return
            number += 1
            if number > most_levels:
                raise ValueError("the cascade does not end: equal hashes of different keys")

    def contains(self, key: Column) -> Column:
        """Right for keys of the universe and listed keys; false for null."""
        if self.empty:
            return F.lit(False)
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            stop = level.number % 2 == 0  # failing an even level: listed; failing an odd one: not
            out = F.when(level.passes(key), out).otherwise(F.lit(stop))
        return F.coalesce(F.when(key.isNotNull(), out), F.lit(False))


def url_filter(
    spark: SparkSession,
    pages: DataFrame,
    rules: DataFrame,
    id: str = "page_id",
    url: str = "url",
    default: str = "allow",
    most_shapes: int = 256,
    most_bits: int = MOST_BITS,
) -> DataFrame:
    """`id`, `host`, `path`, `rule`, `verdict` of each page.

    rules: columns `host`, `path`, `action` (block or allow; block wins where one rule has both). A rule fits its host
    and all subdomains, if the URL's path starts with the rule's; the longest rule (host and path together) wins, of equally long ones the first by
    host and path in a row. Hosts and paths of any length are read whole. A
    URL with no listed key gets `default`: the cascade has shown that no listed key covers it. Null URLs, and those
    without `://`, have empty host and path and no rule. Repeated pages give repeated rows; no rules, or no pages,
    give `default` throughout, or an empty table. Other columns are not read.

    Two cascades are built, of all rules and of those that block. More keys than fit `most_bits`, or more than
    `most_shapes` shapes, are refused (ValueError).
    """
    listed = rules.select((F.concat(F.translate("host", UPPER, LOWER), F.col("path"))).alias("key"), F.translate("host", UPPER, LOWER).alias("host"), "path", "action")
    listed = listed.where("key is not null and host <> ''")
    shapes = listed.select((F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1).alias("labels"), F.length("path").alias("length")).distinct().limit(most_shapes + 1).collect()
    if len(shapes) > most_shapes:
        raise ValueError(f"rules of more than {most_shapes} shapes (labels of host, length of path)")
    shapes = sorted((r.labels, r.length) for r in shapes)
    split = pages.select(F.col(id).alias("id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    if not shapes:
        return split.select(F.col("id").alias(id), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    offered = F.array_compact(F.array_distinct(F.array(*[candidate(F.col("host"), F.col("path"), *s) for s in shapes])))
    universe = split.select(F.explode(offered).alias("key"))
    every = Cascade(spark, listed, universe, most_bits // 2)
    blocked = Cascade(spark, listed.where("action = 'block'"), universe, most_bits // 2)
    keys = split.withColumn("keys", F.reverse(F.array_sort(F.transform(offered, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))))))
    rule = F.get(F.filter("keys", lambda k: every.contains(k["key"])), F.lit(0))["key"]
    ruled = keys.withColumn("rule", rule)
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).when(blocked.contains(F.col("rule")), "block").otherwise("allow")
    return ruled.select(F.col("id").alias(id), "host", "path", "rule", verdict.alias("verdict"))
