"""Secrets in texts: fixed patterns, and strings that a character Markov model finds random.

Two first-order models over the bytes of a string, one of random strings and one of ordinary identifiers, are counted
over the whole corpus: strings that the patterns label as secrets are the samples of the first, all other words
those of the second, but for candidates: long strings of letters and digits that no pattern labels. A candidate
is a secret if its log-likelihood ratio passes a threshold.
"""

from __future__ import annotations

import bisect
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The patterns, in the order in which kinds are listed.
KINDS = ["assign", "access", "hex", "markov"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]

#: Bytes of a candidate string of the models; word characters of identifiers and of encoded keys.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_SIZE = len(_ALPHABET) + 1  # 0 stands for the edge of a string
_CODE = np.zeros(256, dtype=np.int64)
_CODE[[ord(c) for c in _ALPHABET]] = np.arange(1, _SIZE)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in code points, sorted."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


class Taken:
    """Answers whether a stretch of text meets any of some sorted spans: of those that begin before its end, the largest end counts."""

    def __init__(self, spans: list[tuple]):
        self.starts = [a[0] for a in spans]
        self.ends = list(itertools.accumulate((a[2] for a in spans), max))

    def meets(self, start: int, end: int) -> bool:
        before = bisect.bisect_left(self.starts, end)
        return before > 0 and self.ends[before - 1] > start


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all strings with an edge before, between and after them; lengths with the edge."""
    joined = "\x00".join(["", *strings, ""]).encode("latin-1", "replace")
    return _CODE[np.frombuffer(joined, dtype=np.uint8)], np.array([len(s) + 1 for s in strings], dtype=np.int64)


def _pairs(codes: np.ndarray) -> np.ndarray:
    return np.bincount(codes[:-1] * _SIZE + codes[1:], minlength=_SIZE * _SIZE)


def candidates(text: str) -> list[re.Match]:
    """Long strings with letters and digits."""
    return [m for m in CANDIDATE.finditer(text) if _DIGIT.search(m.group()) and _LETTER.search(m.group())]


def character_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts (secret, pair, n) of neighbouring characters over all texts: in labelled secrets and in all other words."""

    def run(batches):
        totals = np.zeros((2, _SIZE * _SIZE), dtype=np.int64)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            secrets, others = [], []
            for value in column:
                t = value.as_py()
                if t:
                    spans = base_spans(t)
                    secrets += [t[m[3] : m[2]] for m in spans]
                    taken = Taken(spans)
                    others += [m.group() for m in candidates(t) if not taken.meets(m.start(), m.end())]
                    raw = t.encode()
                    for low in range(0, len(raw), 1 << 22):  # every byte; a cut counts as one edge
                        codes = _CODE[np.frombuffer(b"\x00" + raw[low : low + (1 << 22)] + b"\x00", dtype=np.uint8)]
                        totals[0] += _pairs(codes)
            if secrets:
                own = _pairs(_codes(secrets)[0])
                totals[1] += own
                totals[0] -= own
            if others:
                totals[0] -= _pairs(_codes(others)[0])
        label, pair = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(pair.astype(np.int32)), pa.array(totals[label, pair])], ["secret", "pair", "n"])

    return docs.select(text).mapInArrow(run, "secret int, pair int, n long").groupBy("secret", "pair").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text: str = "text", smooth: float = 0.5, backoff: float = 20.0) -> np.ndarray | None:
    """Log-likelihood ratio of each pair of characters; the table has 64**2 entries or so, whatever the corpus.

    None if the corpus has no labelled secret, then the models add nothing.
    """
    counts = np.zeros((2, _SIZE * _SIZE))
    for row in character_counts(docs, text).collect():  # at most 2 * 68**2 rows
        counts[row.secret, row.pair] = max(row.n, 0)
    if not counts[1].any():
        return None
    counts = counts.reshape(2, _SIZE, _SIZE)
    counts[0, 0, 0] = 0  # blanks between words
    # A pair backs off to how frequent its second character is, so what a model has never seen stays unlikely in it.
    single = counts.sum(axis=1) + smooth
    single /= single.sum(axis=1, keepdims=True)
    pairs = counts + backoff * single[:, None, :]
    logs = np.log(pairs) - np.log(pairs.sum(axis=2, keepdims=True))
    return logs[1] - logs[0]


def model_spans(text: str, ratios: np.ndarray, threshold: float, taken: list) -> list[tuple[int, int, int]]:
    found, base = [], Taken(taken)
    matches = candidates(text)
    if not matches:
        return found
    codes, lengths = _codes([m.group() for m in matches])
    sums = np.concatenate(([0.0], np.cumsum(ratios[codes[:-1], codes[1:]])))
    ends = np.cumsum(lengths)
    scores = sums[ends] - sums[ends - lengths]
    for m, score in zip(matches, scores, strict=True):
        if score > threshold and not base.meets(m.start(), m.end()):
            found.append((m.start(), 3, m.end()))
    return found


def secret_spans(docs: DataFrame, ratios: np.ndarray | None, keep: list[str], text: str = "text", threshold: float = 25.0, redact: str | None = None) -> DataFrame:
    """`keep` columns and `found`, an array of (kind, start, stop) in code points; a null text has none.

    With `redact`, also the text with that string in place of each span (overlapping spans count as one).
    """
    fields = "array<struct<kind:string,start:long,stop:long>>"

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            found, texts = [], []
            for value in batch.column(batch.schema.get_field_index(text)):
                t = value.as_py()
                spans = [x[:3] for x in base_spans(t)] if t else []
                if t and ratios is not None:
                    spans = sorted(spans + model_spans(t, ratios, threshold, spans))
                found.append([{"kind": KINDS[k], "start": a, "stop": b} for a, k, b in spans])
                if redact is not None:
                    if spans:
                        out, at = [], 0
                        for a, _, b in spans:
                            if b > at:
                                out += [t[at:a], redact] if a >= at else []
                                at = b
                        t = "".join([*out, t[at:]])
                    texts.append(t)
            columns = [*[batch.column(batch.schema.get_field_index(c)) for c in keep], pa.array(found, kind)]
            names = [*keep, "found"]
            if redact is not None:
                columns, names = [*columns, pa.array(texts, pa.string())], [*names, "redacted"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"found {fields}"] + ["redacted string"] * (redact is not None))
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def secret_scan(spark: SparkSession, docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = 25.0) -> DataFrame:
    """One row per document: `id` and `found`. Trains the models on the documents themselves, then scans them.

    Null or empty texts have no spans; the time for a text grows with its length, however many spans it has; repeated rows give repeated results; an empty table gives an empty one;
    other columns are not read.
    """
    own = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return secret_spans(own, train(own), ["id"], threshold=threshold).withColumnRenamed("id", id)
