"""Toxicity by weak supervision: many voters, a generative label model over them, a linear classifier on its posteriors.

Voters are lexicon entries (a word is in the text) and patterns (words begin or end with a string), each at a few counts. They are mined from a
bounded sample of labelled texts: greedily, each covers toxic texts that fewer voters cover yet, so a group of copies
does not fill the list. The label model has for each voter its chance to vote on toxic and on clean texts, by expectation
maximisation over labelled and unlabelled texts, and the dependence of voters given the class, which lowers the say of those
that repeat each other. What a text's votes say together is weighed by how often either class says so much, since voters
that abstain are no evidence one by one. A logistic regression on the votes is fitted to the posteriors, and scores all texts.

The sample of unlabelled texts bounds an error, not the result's rows: with OTHER_ROWS of them a chance to vote is known to
within a standard error of 0.0065. At most MOST_VOTERS traits are taken, in the order of the toxic texts that they newly cover.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runline.llm import words as W

#: Letters of patterns: word beginnings and ends of so many bytes.
BEGINNINGS, ENDINGS = (4, 5, 6, 7, 8, 10), (5, 6)
#: A voter votes more than once: if one, two, or four different words of a text have its trait.
LEVELS = (1, 2, 4)
#: Sample bounds (rows): toxic and clean labelled texts of which voters are mined, further texts for the label model.
TOXIC_ROWS, CLEAN_ROWS, OTHER_ROWS = 2500, 12_000, 6_000
MOST_VOTERS = 400


def traits(data: np.ndarray, offsets: np.ndarray):
    """(text number, trait, word) of words and word patterns; with repeats."""
    low = W.LOWER[data]
    start, end, doc = W.word_spans(low, offsets, W.ALPHANUMERIC)
    size, word = end - start, W.word_hashes(low, start, end)
    yield doc, word, word
    for kind, lengths in ((1, BEGINNINGS), (2, ENDINGS)):
        for n in lengths:
            long = size > n
            a = start[long] if kind == 1 else end[long] - n
            yield doc[long], W.mix(W.word_hashes(low, a, a + n) + np.uint64(64 * kind + n)), word[long]


class Voters:
    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys)
        self.sorted = keys[self.order]

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text number, voter) of every different word with a voter's trait."""
        found = []
        for doc, key, word in traits(data, offsets):
            at = np.searchsorted(self.sorted, key)
            at[at == len(self.sorted)] = 0
            hit = np.flatnonzero(self.sorted[at] == key)
            found.append(np.stack([doc[hit], self.order[at[hit]], word[hit].view(np.int64)]))
        rows = np.unique(np.hstack(found), axis=1)
        return rows[0], rows[1]

    def votes(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n, k = len(offsets) - 1, len(self.sorted)
        if not k:
            return np.zeros((n, 0), dtype=np.uint8)
        doc, voter = self.hits(data, offsets)
        count = np.bincount(doc * k + voter, minlength=n * k).reshape(n, k)
        return np.hstack([count >= level for level in LEVELS]).astype(np.uint8)


def _frequent(rows: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Traits that at least `least` of the texts have, with the number of texts."""

    def run(batches):
        for batch in batches:
            for _, data, offsets in W.text_slices(batch, "text"):
                doc, key, _ = (np.concatenate(x) for x in zip(*traits(data, offsets), strict=True))
                order = np.lexsort((doc, key))
                doc, key = doc[order], key[order]
                new = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))[: len(key)]
                found, n = np.unique(key[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["key", "n"])

    got = rows.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy("key").collect()
    return np.array([r.key for r in got], np.int64).view(np.uint64), np.array([r.n for r in got], np.int64)


def _having(rows: DataFrame, keys: np.ndarray) -> list[np.ndarray]:
    """Which of the traits each text has."""
    sent = rows.sparkSession.sparkContext.broadcast(keys)

    def run(batches):
        voters = Voters(sent.value)
        for batch in batches:
            for part, data, offsets in W.text_slices(batch, "text"):
                doc, trait = voters.hits(data, offsets)
                pairs = np.unique(doc * len(voters.sorted) + trait)
                cuts = np.searchsorted(pairs, np.arange(part.num_rows + 1) * len(voters.sorted))
                found = [(pairs[a:b] % len(voters.sorted)).astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["traits"])

    return [np.frombuffer(r.traits, np.int32) for r in rows.mapInArrow(run, "traits binary").collect()]


def _counts(rows: DataFrame, keys: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of the texts each of the traits is."""
    sent = rows.sparkSession.sparkContext.broadcast(keys)

    def run(batches):
        voters = Voters(sent.value)
        counts, n = np.zeros(len(sent.value) + 1, dtype=np.int64), 0
        for batch in batches:
            for part, data, offsets in W.text_slices(batch, "text"):
                k = len(voters.sorted)
                doc, trait = voters.hits(data, offsets)
                counts[:-1] += np.bincount(np.unique(doc * k + trait) % k, minlength=k)
                n += part.num_rows
        counts[-1] = n
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(counts[full])], ["k", "n"])

    out = np.zeros(len(keys) + 1, dtype=np.int64)
    for r in rows.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[r.k] = r.n
    return out[:-1], int(out[-1])


def mine(toxic: DataFrame, clean: DataFrame, most: int = MOST_VOTERS, cover: int = 4, ratio: float = 6.0) -> np.ndarray:
    """Traits that are `ratio` times as frequent in toxic as in clean texts, chosen until toxic texts have `cover` each."""
    texts = toxic.distinct().repartition(16)
    n_texts = texts.count()
    keys, t = _frequent(texts, max(2, min(4, n_texts // 10)))
    if not len(keys):
        return np.zeros(0, np.uint64)
    n, n_clean = _counts(clean, keys)
    good = np.flatnonzero(t / n_texts >= ratio * (n + 0.5) / (n_clean + 1))
    if not len(good):
        return np.zeros(0, np.uint64)
    keys, t = keys[good], t[good]
    sets = _having(texts, keys)
    trait, text = np.concatenate(sets).astype(np.int64), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    # Greedy cover; the count of what a trait still covers is kept up to date.
    by_trait, by_text = np.argsort(trait, kind="stable"), np.argsort(text, kind="stable")
    trait_cuts = np.searchsorted(trait[by_trait], np.arange(len(keys) + 1))
    text_cuts = np.searchsorted(text[by_text], np.arange(len(sets) + 1))
    gain, left, chosen = t.astype(np.int64), np.full(len(sets), cover), []
    while len(chosen) < min(most, len(keys)):
        best = int(gain.argmax())
        if gain[best] < 2:
            break
        chosen.append(best)
        for d in text[by_trait[trait_cuts[best] : trait_cuts[best + 1]]]:
            left[d] -= 1
            if left[d] == 0:
                np.subtract.at(gain, trait[by_text[text_cuts[d] : text_cuts[d + 1]]], 1)
        gain[best] = -1
    return keys[chosen]


def _vote_matrix(rows: DataFrame, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(votes, labels; -1 for none) of a bounded sample."""
    sent = rows.sparkSession.sparkContext.broadcast(keys)

    def run(batches):
        voters = Voters(sent.value)
        for batch in batches:
            for part, data, offsets in W.text_slices(batch, "text"):
                packed = np.packbits(voters.votes(data, offsets), axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in packed], pa.binary())], ["label", "votes"])

    got = rows.select("label", "text").mapInArrow(run, "label int, votes binary").collect()
    votes = np.array([np.unpackbits(np.frombuffer(r.votes, np.uint8))[: len(keys) * len(LEVELS)] for r in got], dtype=np.float64).reshape(len(got), -1)
    return votes, np.array([r.label for r in got], dtype=np.int64)


def dependence(votes: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """What part of its own evidence each voter adds: 1 for one that is independent of all others given the class, 1 / k for k
    voters that vote alike. toxic: chance of each row. Correlations below 0.3 count as chance."""
    weight = np.stack([1 - toxic, toxic])
    mean = weight @ votes / np.maximum(weight.sum(axis=1, keepdims=True), 1e-9)
    rest = votes - weight.T @ mean
    rest /= np.sqrt((rest**2).mean(axis=0)) + 1e-9
    alike = rest.T @ rest / len(votes)
    return 1 / np.maximum((np.clip(alike - 0.3, 0, None) / 0.7).sum(axis=1), 1)


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 25, levels: int = 24, held: bool = True) -> np.ndarray:
    """Posterior chance that each row is toxic: of a row with a label that label, or (`held` false) what its votes alone say, by the model that labels helped
    to estimate. While it is estimated, labels are held; they start the estimate, and give the voters' dependence, where
    both classes have some (20 rows for the latter), else texts with any vote do.

    Evidence of a row: the sum over its votes of say x log(chance on toxic / chance on clean). Its odds: how much more often toxic
    rows have evidence of that level (silence, then one of `levels` by quantiles; never falling as it rises) than clean ones.
    """
    silent = ~votes.any(axis=1)
    known = labels >= 0
    classes = np.bincount(labels[known], minlength=2)[:2]
    toxic = np.where(known, labels, ~silent).astype(float)
    start = np.flatnonzero(known) if classes.min() >= 2 else np.arange(len(labels))
    say = dependence(votes[known], labels[known].astype(float)) if classes.min() >= 20 else None
    for k in range(rounds):
        rows = start if k == 0 else slice(None)
        weight = np.stack([1 - toxic, toxic])[:, rows]
        total = weight.sum(axis=1, keepdims=True)
        chance = (weight @ votes[rows] + np.array([[0.02], [0.1]])) / (total + 1.0)
        own = dependence(votes, toxic) if say is None else say
        evidence = votes @ (own * (np.log(chance[1]) - np.log(chance[0])))
        borders = np.unique(np.quantile(evidence[~silent], np.linspace(0, 1, levels)[1:-1])) if not silent.all() else np.zeros(0)
        level = np.where(silent, 0, 1 + np.searchsorted(borders, evidence - 1e-9, side="left"))
        n = len(borders) + 2
        share = np.stack([np.bincount(level[rows], w, n) for w in weight]) + 0.5
        share /= share.sum(axis=1, keepdims=True)
        ratio = np.log(share[1] / share[0])
        ratio = np.maximum.accumulate(ratio)
        prior = np.clip(weight[1].sum() / total.sum(), 1e-3, 1 - 1e-3)
        said = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + ratio[level], -40, 40)))
        fresh = np.where(known, labels, said)
        done = k > 0 and np.abs(fresh - toxic).max() < 1e-6
        toxic = fresh
        if done:
            break
    return toxic if held else said


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 30) -> np.ndarray:
    """Weights and intercept by Newton steps; y: chances. Both classes weigh alike."""
    x = np.hstack([x, np.ones((len(x), 1))])
    total = max(y.sum(), 1e-9), max((1 - y).sum(), 1e-9)
    importance = len(y) / 2 * (y / total[0] + (1 - y) / total[1])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (importance * (p - y)) + penalty * w
        bend = (x * (importance * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, keys: np.ndarray, weights: np.ndarray):
        self.voters, self.weights = Voters(keys), weights

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = self.voters.votes(data, offsets) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(
    spark: SparkSession,
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    id: str = "doc_id",
    label: str = "toxic",
    text: str = "text",
    toxic_rows: int = TOXIC_ROWS,
    clean_rows: int = CLEAN_ROWS,
    other_rows: int = OTHER_ROWS,
    most_voters: int = MOST_VOTERS,
    held: bool = True,
) -> Model | None:
    """Learns from rows for which `learn` holds (an expression over the id). The classifier is fitted to posteriors; those of rows with a label are the label
    (`held`), or what their votes say. Samples are taken by hash of the id, bounded by so many toxic, clean and further rows, so they are sent to the tasks that read the texts. Of rows that repeat an id one is
    learned from (the least text); a label that is null is none; an id labelled both ways is mined from on both sides, and toxic to the label
    model. Long texts are read whole, in slices of their own. None without a toxic label."""
    c = F.col
    marked = labels.where(learn & c(label).isNotNull()).select(c(id).alias("own"), c(label).cast("int").alias("label"))
    own = docs.where(learn).select(c(id).alias("id"), c(text).alias("text"))

    def some(rows: DataFrame, n: int) -> DataFrame:
        return rows.orderBy(F.xxhash64("own"), "own", "label").limit(n)

    def texts(rows: DataFrame) -> DataFrame:
        met = own.join(F.broadcast(rows), c("id") == c("own"))
        return met.groupBy("own", "label").agg(F.min("text").alias("text")).select("label", "text")  # one of the rows of an id

    toxic, clean = some(marked.where("label = 1"), toxic_rows), some(marked.where("label = 0"), clean_rows)
    keys = mine(texts(toxic).select("text"), texts(clean).select("text"), most_voters)
    if not len(keys):
        return None
    other = own.select(c("id").alias("own"), F.lit(-1).alias("label"))
    sample = toxic.unionByName(some(marked.where("label = 0"), clean_rows // 2)).unionByName(some(other, other_rows))
    votes, known = _vote_matrix(texts(sample.groupBy("own").agg(F.max("label").alias("label"))), keys)
    return Model(keys, logistic(votes, label_model(votes, known, held=held)))


def toxicity(spark: SparkSession, docs: DataFrame, model: Model | None, id: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """`id`, `score` (0 to 1, higher: toxic), `predicted` (1 from `threshold` on) of each row.

    Null and empty texts get the score of a text without votes; without a model all scores are 0. Repeated rows are
    scored alike; an empty table gives an empty one; other columns are not read.
    """
    own = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part, data, offsets in W.text_slices(batch, "text"):
                scores = sent.value.scores(data, offsets) if sent.value else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["id", "score", "predicted"])

    return own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, score double, predicted int").withColumnRenamed("id", id)
