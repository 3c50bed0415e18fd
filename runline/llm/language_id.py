"""Language of a text by a string kernel: blended spectrum of byte n-grams (presence), normalised.

Landmark texts span the Nyström space: a text's features are its kernel values with the landmarks, times K_LL^(-1/2). One
ridge regression per language (one versus rest) is fitted there. All of it is linear in a text's n-gram indicators, so
scoring a batch is one matrix product of indicators with a table (n-grams x languages), divided by the text's norm.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runline.llm import words as W
from runline.llm.scratch import Scratch

ORDERS = (1, 2, 3, 4)
#: Hashed n-grams of each order: 2**20. Two that share a number count as one.
_BITS = 20
#: Letters of A-Z as a-z, other ASCII bytes as blanks, bytes of other letters as they are.
_FOLD = np.array([c if c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A else 0x20 for c in range(256)], dtype=np.uint8)
#: Texts whose indicators are multiplied at once, and entries of their matrix.
_ROWS, _CELLS = 128, 1 << 24


def ngrams(data: np.ndarray, offsets: np.ndarray):
    """For each order: the texts and numbers of all its n-grams."""
    folded = _FOLD[data].astype(np.uint32)
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    code = np.zeros(len(folded), dtype=np.uint32)
    for n in ORDERS:
        if len(folded) < n:
            return
        code = code[: len(folded) - n + 1] | (folded[n - 1 :] << np.uint32(8 * (n - 1)))
        inside = doc[: len(code)] == doc[n - 1 :]
        number = ((code ^ np.uint32(0x85EBCA6B * n % (1 << 32))) * np.uint32(2654435761)) >> np.uint32(32 - _BITS)
        yield doc[: len(code)][inside], (number[inside].astype(np.int64) | ((n - 1) << _BITS))


def indicators(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, width: int):
    """(first text, matrix of n-gram presence) of every few texts. table: column of each n-gram, or -1."""
    step = max(1, min(_ROWS, _CELLS // max(width, 1)))
    for low in range(0, len(offsets) - 1, step):
        cut = offsets[low : low + step + 1]
        out = np.zeros((len(cut) - 1, width), dtype=bool)
        for doc, number in ngrams(data[cut[0] : cut[-1]], cut - cut[0]):
            column = table[number]
            known = column >= 0
            out[doc[known], column[known]] = True
        yield low, out.astype(np.float32)


class Landmarks:
    """N-grams of the landmark texts as lists: those of column c are held by the landmarks owner[cuts[c]:cuts[c + 1]]. As large as the
    landmarks' texts, whatever the number of n-grams."""

    def __init__(self, bases: list[np.ndarray]):
        numbers, owner = np.concatenate(bases), np.repeat(np.arange(len(bases)), [len(b) for b in bases])
        order = np.argsort(numbers, kind="stable")
        self.used, self.owner = np.unique(numbers), owner[order].astype(np.int32)
        self.cuts = np.concatenate((np.searchsorted(numbers[order], self.used), [len(numbers)]))
        self.table = np.full(len(ORDERS) << _BITS, -1, dtype=np.int32)
        self.table[self.used] = np.arange(len(self.used))
        self.norm = np.sqrt(np.array([len(b) for b in bases], dtype=np.float64))
        self.bases = [self.table[b] for b in bases]

    def kernel(self, columns: np.ndarray) -> np.ndarray:
        """Of a text that has these columns, with each landmark (not yet divided by the text's own norm)."""
        size = self.cuts[columns + 1] - self.cuts[columns]
        at = np.repeat(self.cuts[columns] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(self.owner[at], minlength=len(self.norm)) / self.norm

    def spread(self, values: np.ndarray) -> np.ndarray:
        """Values of landmarks (rows) as sums over the landmarks of each n-gram."""
        out = np.zeros((len(self.used), values.shape[1]))
        for base, value, norm in zip(self.bases, values, self.norm, strict=True):
            out[base] += value / norm
        return out


class Model:
    """languages; table and weights of n-grams (the last row of `intercept` per language)."""

    def __init__(self, languages: list[str], table: np.ndarray, weights: np.ndarray, intercept: np.ndarray):
        self.languages, self.table, self.weights, self.intercept = languages, table, weights, intercept

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros((len(offsets) - 1, len(self.languages)), dtype=np.float32)
        for low, m in indicators(data, offsets, self.table, len(self.weights)):
            norm = np.sqrt(np.maximum(m.sum(axis=1), 1))[:, None]
            out[low : low + len(m)] = m @ self.weights / norm + self.intercept
        return out


def sampled(docs: DataFrame, lang: str, id: str, per_language: int, salt: int) -> DataFrame:
    """(lang, id, text) of about `per_language` rows of each language, chosen by hash; all of one that has fewer. Of rows that repeat
    an id (in one language) one is taken, that of the least text."""
    counts = docs.groupBy(lang).agg(F.count("*").alias("k"))
    rates = counts.select(F.col(lang).alias("its"), (F.lit(float(per_language)) / F.col("k")).alias("rate"))
    chance = F.pmod(F.xxhash64(id, F.lit(salt)), F.lit(1 << 40)) / float(1 << 40)
    met = docs.join(F.broadcast(rates), F.col(lang) == F.col("its")).where(chance < F.col("rate"))  # a row per language
    return met.groupBy(lang, id).agg(F.min("text").alias("text"))


def train(spark: SparkSession, docs: DataFrame, id: str, lang: str, text: str, landmarks: int = 48, samples: int = 600, ridge: float = 1e-3) -> Model | None:
    """Fits on about `samples` rows of each language, with about `landmarks` of them as landmarks; whole texts.

    None if no row has a language. What is sent to tasks: the landmarks' n-grams as lists while fitting, then a weight per n-gram
    that a landmark has (at most 4 * 2**20) and language.
    """
    own = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    scratch = Scratch(spark, "language")
    rows = scratch.stored(sampled(own, "lang", "id", samples, 1))
    languages = sorted(r.lang for r in rows.select("lang").distinct().collect())
    if not languages:
        return None

    def present(batches):
        for batch in batches:
            for part, data, offsets in W.text_slices(batch, "text"):
                found = [np.unique(np.concatenate([n for _, n in ngrams(data[a:b], np.array([0, b - a]))] or [np.zeros(0, np.int64)])) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.int32).tobytes() for x in found], pa.binary())], ["numbers"])

    chosen = sampled(rows.select("id", "lang", "text"), "lang", "id", landmarks, 2)
    bases = [np.frombuffer(r.numbers, np.int32) for r in chosen.select("text").mapInArrow(present, "numbers binary").collect()]
    bases = [b for b in bases if len(b)]  # about landmarks * languages texts
    if not bases:
        return None
    marks = Landmarks(bases)
    values, vectors = np.linalg.eigh(np.stack([marks.kernel(b) / n for b, n in zip(marks.bases, marks.norm, strict=True)]))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    size = len(bases) + 1
    sent = spark.sparkContext.broadcast((marks, root, languages))

    def sums(batches):
        marks, root, languages = sent.value
        gram, target, n = np.zeros((size, size)), np.zeros((size, len(languages))), 0
        for batch in batches:
            for part, data, offsets in W.text_slices(batch, "text"):
                own = np.array([languages.index(x) for x in part.column(0).to_pylist()])
                features = np.ones((part.num_rows, size))
                for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                    columns = marks.table[np.unique(np.concatenate([np.zeros(0, np.int64), *[x for _, x in ngrams(data[a:b], np.array([0, b - a]))]]))]
                    columns = columns[columns >= 0]
                    features[k, :-1] = marks.kernel(columns) / np.sqrt(max(len(columns), 1))
                features[:, :-1] = features[:, :-1] @ root
                gram += features.T @ features
                target += features.T @ np.eye(len(languages))[own]
                n += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary()), pa.array([target.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["gram", "target", "n"])

    gram, target, n = np.zeros((size, size)), np.zeros((size, len(languages))), 0
    for r in rows.select("lang", "text").repartition(8).mapInArrow(sums, "gram binary, target binary, n long").collect():
        gram += np.frombuffer(r.gram).reshape(size, size)
        target += np.frombuffer(r.target).reshape(size, -1)
        n += r.n
    penalty = np.eye(size) * ridge * max(n, 1)
    penalty[-1, -1] = 1e-9
    beta = np.linalg.solve(gram + penalty, target)
    return Model(languages, marks.table, marks.spread(root @ beta[:-1]).astype(np.float32), beta[-1].astype(np.float32))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def language_id(spark: SparkSession, docs: DataFrame, model: Model | None, id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`id` (or the columns of `keep`), `lang_pred` and `score` (0 to 1; the winning regression's value) of each row.

    A text that is null or has no letter, and every text where no model could be trained, is `und` with score 0.
    Repeated rows are judged alike; an empty table gives an empty one; ties go to the first language by name.
    """
    keep = keep or [id]
    own = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("text"), has_letter(F.col(text)).alias("able"))
    kept = [f"k{i}" for i in range(len(keep))]
    if model is None:
        return own.select(*[F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)], F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        for batch in batches:
            for part, data, offsets in W.text_slices(batch, "text"):
                scores = model.scores(data, offsets)
                best = scores.argmax(axis=1)
                value = np.clip(scores[np.arange(len(best)), best], 0, 1).astype(np.float64)
                able = part.column(len(kept) + 1).to_numpy(zero_copy_only=False).astype(bool)
                named = pa.array([model.languages[b] if a else "und" for a, b in zip(able.tolist(), best.tolist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], named, pa.array(np.where(able, value, 0.0))], [*kept, "lang_pred", "score"])

    schema = ", ".join(f"{k} {own.schema[k].dataType.simpleString()}" for k in kept) + ", lang_pred string, score double"
    return own.mapInArrow(run, schema).withColumnsRenamed(dict(zip(kept, keep, strict=True)))
