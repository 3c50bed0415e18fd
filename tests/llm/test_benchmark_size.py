"""Results and memory of op8 don't depend on how many blocks the benchmark takes, nor on the square of an item's length."""

import pickle
import random
import time

import numpy as np

from runline.llm import decontaminate


def test_rows_of_one_id_in_blocks(spark):
    rng = random.Random(13)
    some = [" ".join("w" + str(rng.randrange(50)) for _ in range(40)) for _ in range(4)]
    rows = [(1, some[0]), (1, some[1]), (1, some[0]), (None, some[2]), (None, "x y"), (2, some[3] + " z " + some[0]), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(some)], "item_id long, text string")

    def found(chars):
        return sorted(map(repr, decontaminate.decontaminate(spark, docs, bench, block_chars=chars).collect()))

    assert len(found(100)) == len(rows) and found(100) == found(decontaminate.BLOCK_CHARS)


def test_long_item():
    rng = random.Random(17)
    text = " ".join("w" + str(rng.randrange(5000)) for _ in range(10_000))
    test = decontaminate.TestSet([("a", text)], 10)
    assert len(pickle.dumps(test)) < 100 * len(text)

    data = np.frombuffer(f"x {text} y {text}".encode(), np.uint8)
    _, _, (_, _, at, best) = decontaminate.shard_matches(test, data, np.array([0, len(text) + 3, len(data)]))
    assert sorted(zip(best.tolist(), at.tolist(), strict=True))[-2:] == [(10_000, 1), (10_000, 1)]


def test_items_without_an_id(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (3, "delta")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "alpha beta"), (None, "gamma"), ("b", "gamma"), ("a", "gamma"), ("a", "gamma")], "item_id string, text string")
    rows = {r.doc_id: (sum(h.size for h in r.hits), r.items) for r in decontaminate.decontaminate(spark, docs, bench).collect()}
    assert rows == {1: (2, []), 2: (1, ["a", "b"]), 3: (0, [])}


def test_large_benchmark():
    """8 MB of items: memory by the word, and a slice of 0.7 MB of text in a few seconds, hits and locations right."""
    rng = np.random.default_rng(3)
    words = np.array([f"w{k}" for k in range(30_000)])
    items = [(str(i), " ".join(words[rng.integers(0, 30_000, 200)])) for i in range(6500)]
    test = decontaminate.TestSet(items, 10)
    size = sum(len(t) for _, t in items)
    assert len(pickle.dumps(test)) < 8 * size
    texts = [" ".join(words[rng.integers(0, 30_000, 1000)]) for _ in range(118)]
    texts[5] += " " + " ".join(items[77][1].split(" ")[20:90])
    texts[9] += " " + items[300][1] + " x"
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    began = time.perf_counter()
    _, (doc, first, length, number), (_, where, at, best) = decontaminate.shard_matches(test, data, offsets)
    assert time.perf_counter() - began < 3
    assert set(doc.tolist()) == {5, 9} and {d: set().union(*[test.owners(k) for k in number[doc == d].tolist()]) for d in (5, 9)} == {5: {"77"}, 9: {"300"}}
    assert sorted(zip(where.tolist(), at.tolist(), best.tolist(), strict=True), key=lambda x: -x[2])[:2] == [(9, 1000, 200), (5, 1000, 70)]
