"""The walk through a tree of sets, against all pairs."""

import numpy as np
import pytest

from runline.llm import ngram_join
from tests.llm import brute


def linked(sets, n, percent):
    pairs = []
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= percent * (n[a] + n[b] - both):
                pairs.append((a, b))
    return pairs


def some_sets(rng, k, words, size, edits):
    out = []
    for _ in range(k):
        base = rng.choice(words, size=size, replace=False) if not out or rng.random() < 0.3 else out[rng.integers(len(out))]
        own = set(base.tolist())
        for _ in range(rng.integers(edits + 1)):
            own.discard(int(rng.choice(sorted(own))))
            own.add(int(rng.integers(words)))
        out.append(np.array(sorted(own), dtype=np.int64))
    return out


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("small", [64, 4])
def test_components_of_a_tree(monkeypatch, seed, small):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "ASKED", 2)
    rng = np.random.default_rng(seed)
    sets = some_sets(rng, int(rng.integers(2, 60)), int(rng.choice([30, 200])), int(rng.integers(3, 25)), int(rng.integers(1, 6)))
    lead = rng.integers(0, 3, len(sets)) if seed % 2 else np.zeros(len(sets), np.int64)
    n = np.array([len(s) for s in sets]) + lead
    every = np.ones(len(sets), bool)
    label = ngram_join.Tree(sets, n, lead, 80).join(np.arange(len(sets)), every, every)
    want = brute.groups(range(len(sets)), linked(sets, n, 80))
    assert {i: int(label[i]) for i in want} == want


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("small", [64, 4])
def test_one_side_asks(monkeypatch, seed, small):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    rng = np.random.default_rng(100 + seed)
    sets = some_sets(rng, 50, 60, 12, 3)
    n, lead = np.array([len(s) for s in sets]), np.zeros(50, np.int64)
    asks = rng.random(50) < 0.4
    label = ngram_join.Tree(sets, n, lead, 80).join(np.arange(50), asks, ~asks)
    want = brute.groups(range(50), [(a, b) for a, b in linked(sets, n, 80) if asks[a] != asks[b]])
    assert {i: int(label[i]) for i in want} == want
