"""The models of op2 and op4 against plain versions: label model by direct count, string kernel computed densely."""

import random

import numpy as np

from runline.llm import language_id, toxicity


def test_dependent_voters_share_a_say():
    rng = np.random.default_rng(3)
    truth = rng.random(3000) < 0.3
    alone = rng.random((3000, 3)) < np.where(truth, 0.5, 0.1)[:, None]
    copies = np.repeat(rng.random((3000, 1)) < np.where(truth, 0.5, 0.1)[:, None], 4, axis=1)
    say = toxicity.dependence(np.hstack([alone, copies]).astype(float), truth.astype(float))
    assert np.allclose(say[:3], 1, atol=0.05) and np.allclose(say[3:], 0.25, atol=0.02)


def test_label_model_with_all_labels_but_a_few():
    """Posteriors of the unlabelled follow the counts of the labelled: enumerated over the patterns of two voters."""
    rng = np.random.default_rng(4)
    truth = rng.random(20_000) < 0.25
    votes = np.stack([rng.random(20_000) < np.where(truth, a, b) for a, b in ((0.7, 0.05), (0.4, 0.1))], axis=1)
    labels = np.where(np.arange(20_000) % 10 > 0, truth, -1).astype(int)
    got = toxicity.label_model(votes.astype(float), labels, levels=200)
    for pattern in ((0, 0), (0, 1), (1, 0), (1, 1)):
        rows = (votes == pattern).all(axis=1)
        want = truth[rows & (labels >= 0)].mean()
        assert abs(got[rows & (labels < 0)].mean() - want) < 0.03


def test_posteriors_with_a_dependent_pair_by_enumeration():
    """Three voters and a copy of the first: over all patterns of votes, what the model says is what Bayes' rule says of the three, with a tenth of the
    rows labelled, and for rows with a label too."""
    rng, n = np.random.default_rng(6), 200_000
    chances, prior = ((0.5, 0.05), (0.4, 0.1), (0.6, 0.03)), 0.2
    truth = rng.random(n) < prior
    votes = np.stack([rng.random(n) < np.where(truth, a, b) for a, b in chances], axis=1)
    votes = np.hstack([votes, votes[:, :1]])
    labels = np.where(rng.random(n) < 0.1, truth, -1).astype(int)
    got = toxicity.label_model(votes.astype(float), labels, levels=200, held=False)
    for k in range(8):
        pattern = [k >> i & 1 for i in range(3)]
        odds = prior / (1 - prior)
        for v, (a, b) in zip(pattern, chances, strict=True):
            odds *= a / b if v else (1 - a) / (1 - b)
        rows = (votes[:, :3] == pattern).all(axis=1)
        assert abs(got[rows & (labels < 0)].mean() - odds / (1 + odds)) < 0.08
        assert abs(got[rows & (labels >= 0)].mean() - odds / (1 + odds)) < 0.08


def test_labels_of_one_class_or_none():
    votes = np.array([[1, 0], [0, 0], [1, 1], [0, 0]], dtype=float)
    for labels in ([-1] * 4, [1, -1, -1, -1], [0, -1, -1, -1]):
        got = toxicity.label_model(votes, np.array(labels))
        assert ((got >= 0) & (got <= 1)).all() and got[2] >= got[3]
    assert toxicity.label_model(np.zeros((3, 2)), np.array([-1, -1, -1])).max() <= 0.5


def grams(text):
    data = "".join(c.lower() if "A" <= c <= "Z" else c if "a" <= c <= "z" or ord(c) > 127 else " " for c in text).encode()
    return {data[i : i + n] for n in (1, 2, 3, 4) for i in range(len(data) - n + 1)}


def test_language_scores_are_those_of_the_dense_kernel(spark):
    rng = random.Random(9)
    alphabets = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnöü"}
    rows = []
    for i in range(60):
        lang = list(alphabets)[i % 3]
        rows.append((i, lang, " ".join("".join(rng.choice(alphabets[lang]) for _ in range(rng.randrange(2, 6))) for _ in range(12))))
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language_id.train(spark, docs, "doc_id", "lang", "text", landmarks=1000, samples=1000)
    sets = [grams(t) for *_, t in rows]
    kernel = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    values, vectors = np.linalg.eigh(kernel)
    x = kernel @ vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    x = np.hstack([x, np.ones((60, 1))])
    y = np.array([[float(lang == k) for k in alphabets] for _, lang, _ in rows])
    penalty = np.eye(61) * 1e-3 * 60
    penalty[-1, -1] = 1e-9
    want = x @ np.linalg.solve(x.T @ x + penalty, x.T @ y)
    texts = [t.encode() for *_, t in rows]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    got = model.scores(np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert model.languages == list(alphabets) and np.abs(got - want).max() < 0.02


def test_language_sample_of_one_id(spark):
    """Rows that repeat an id count once, so a hot id does not grow the sample."""
    rows = [(1, "en", f"text number {k}") for k in range(300)] + [(2, "de", "ein anderer text")]
    docs = spark.createDataFrame(rows, "id long, lang string, text string")
    assert language_id.sampled(docs, "lang", "id", 1000, 1).count() == 2
