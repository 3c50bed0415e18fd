"""Quality rules at two levels: counts of a document's own text, and a verdict on the domain it comes from.

A domain's share of failed documents is shrunk towards the corpus by a beta prior that is fitted to all domains by
moments (an empirical prior), so a domain of three documents is not judged by three documents. Domains are aggregated
before anything is shuffled by them, so a domain with a third of all rows costs a row per task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runline.llm import words as W
from runline.llm.scratch import Scratch

SYMBOLS = "#*$%&|<>"
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in SYMBOLS])
_LINE = W._table([0x0A])
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeats(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """1 where the same text has an equal hash elsewhere, 2 where it has one before."""
    order = np.lexsort((hashes, doc))
    same = (hashes[order][1:] == hashes[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    out = np.zeros(len(hashes), dtype=np.int8)
    out[order[:-1][same]] = 1
    out[order[1:][same]] = 2
    return out


def count_slice(data: np.ndarray, offsets: np.ndarray, window: int = 8) -> list[np.ndarray]:
    n = len(offsets) - 1
    start, end, doc = W.word_spans(data, offsets, W.BLANK_SEPARATED)
    characters = W.BLANK_SEPARATED[data] & ((data & 0xC0) != 0x80)
    hashes = W.word_hashes(data, start, end)
    windows, at = W.window_hashes(hashes, doc, window)
    again = at[_repeats(windows, doc[at]) > 0]
    depth = np.zeros(len(start) + 1, dtype=np.int64)
    np.add.at(depth, again, 1)
    np.add.at(depth, again + window, -1)
    repeated = doc[np.cumsum(depth)[:-1] > 0]
    low, high, line_doc = W.word_spans(data, offsets, _LINE)
    worded = np.searchsorted(start, high) > np.searchsorted(start, low)
    low, high, line_doc = low[worded], high[worded], line_doc[worded]
    lines = line_doc[_repeats(W.word_hashes(data, low, high), line_doc) == 2]
    return [
        np.bincount(doc, minlength=n),
        _per_text(characters, offsets),
        _per_text(_SYMBOL[data], offsets),
        np.bincount(lines, minlength=n),
        np.bincount(repeated, minlength=n),
    ]


def text_counts(docs: DataFrame, keep: list[str], text: str = "text", window: int = 8) -> DataFrame:
    """`keep` columns and the five counts of every whole text. A null or empty text counts 0 throughout."""

    def run(batches):
        for batch in batches:
            for part, data, offsets in W.text_slices(batch, text):
                counts = [pa.array(x.astype(np.int64)) for x in count_slice(data, offsets, window)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *counts], [*keep, *COUNTS])

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} long" for c in COUNTS])
    return docs.select(*keep, text).mapInArrow(run, schema)


def domain_rates(judged: DataFrame, domain: str, failed: str) -> DataFrame:
    """Per domain: documents, failures, and the failure rate shrunk by a beta prior fitted to all domains.

    Moments: mean m of all documents, variance v between domains beyond binomial noise; a + b = m(1-m)/v - 1.
    Where domains do not differ beyond noise (v <= 0, one domain, or m of 0 or 1) the prior weighs as much as
    the mean domain has documents.
    """
    hosts = judged.groupBy(domain).agg(F.count("*").alias("n"), F.sum(F.col(failed).cast("long")).alias("failures"))
    total = hosts.agg(
        F.sum("n").alias("all_n"),
        (F.sum("failures") / F.sum("n")).alias("m"),
        F.count("*").alias("hosts"),
        F.sum(F.col("failures") * F.col("failures") / F.col("n")).alias("squares"),
        F.sum(F.col("n") * F.col("n")).alias("n_squares"),
    )
    m, n, k = F.col("m"), F.col("all_n"), F.col("hosts")
    spread = F.col("squares") - n * m * m - (k - 1) * m * (1 - m)
    scale = n - F.col("n_squares") / n
    v = F.when(scale > 0, spread / scale)
    weight = F.when((v > 0) & (m * (1 - m) > v), m * (1 - m) / v - 1).otherwise(n / k)
    prior = total.select(m.alias("prior_mean"), weight.alias("prior_weight"))  # one row
    rate = (F.col("failures") + F.col("prior_mean") * F.col("prior_weight")) / (F.col("n") + F.col("prior_weight"))
    return hosts.join(F.broadcast(prior)).select(domain, "n", "failures", rate.alias("rate"))


def quality_rules(
    spark: SparkSession,
    docs: DataFrame,
    base_rule: Column,
    id: str = "doc_id",
    domain: str = "source",
    text: str = "text",
    most_failures: float = 0.5,
) -> DataFrame:
    """Documents with counts, `base_failed`, the domain's `host_rate` and `kept`.

    `base_rule` is an expression over the counts, true where a text fails. A document is kept if it passes the rule
    and its domain's shrunk failure rate is below `most_failures`. Null domains form one domain. Each input row gives
    one row, repeated rows too; an empty table gives an empty one. Other columns of the input are not read.
    """
    own = docs.select(F.col(id).alias("id"), F.col(domain).alias("domain"), F.col(text).alias("text"))
    scratch = Scratch(spark, "quality")
    judged = scratch.stored(text_counts(own, ["id", "domain"]).withColumn("base_failed", base_rule))
    hosts = domain_rates(judged, "domain", "base_failed").select(F.col("domain").alias("host"), F.col("rate").alias("host_rate"))
    return judged.join(hosts, F.col("domain").eqNullSafe(F.col("host")), "left").select(
        F.col("id").alias(id),
        F.col("domain").alias(domain),
        *COUNTS,
        "base_failed",
        "host_rate",
        (~F.col("base_failed") & (F.col("host_rate") < most_failures)).alias("kept"),
    )
