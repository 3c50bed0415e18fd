"""Longest verbatim matches of every document, however many copies a slice holds."""

import random

from runline.llm import decontaminate
from tests.llm import brute


def longest(text, items, window=10):
    """(words, first word) of the longest match of a window or more."""
    words, best = brute.ALNUM.findall((text or "").translate(brute.UPPER)), (0, -1)
    for _, t in items:
        x = brute.ALNUM.findall((t or "").translate(brute.UPPER))
        for i in range(len(words)):
            for j in range(len(x)):
                n = 0
                while i + n < len(words) and j + n < len(x) and words[i + n] == x[j + n]:
                    n += 1
                if n >= min(len(x), window) > 0 and (n, -i) > (best[0], -best[1]):
                    best = (n, i)
    return best


def test_longest_of_every_copy(spark):
    rng = random.Random(11)
    words = ["w" + str(k) for k in range(40)]

    def some(n):
        return [rng.choice(words) for _ in range(n)]

    one, two = some(60), some(30)
    items = [(1, " ".join(one)), (2, " ".join(two + one[20:45])), (3, "w1 w2"), (4, None), (5, " ".join(["w3"] * 25))]
    texts = [" ".join(some(5) + one[a:b] + some(4)) for a, b in ((0, 60), (0, 60), (10, 50), (30, 60), (48, 60))] + [" ".join(two + one[20:30]), " ".join(["w3"] * 40), "x", None, " ".join(some(3) + one[5:30] + ["y"] + one[20:50])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {d: longest(t, items) for d, t in enumerate(texts)}
    assert want[0][0] == want[1][0] == 60
    none = decontaminate.decontaminate(spark, spark.createDataFrame([(1, " ".join(one[::-1]))], docs.schema), bench.where("item_id < 3"))
    assert [(r.longest, r.longest_at) for r in none.collect()] == [(0, -1)]
    for chars in (decontaminate.BLOCK_CHARS, 150):
        rows = decontaminate.decontaminate(spark, docs, bench, block_chars=chars).collect()
        assert {r.doc_id: r.longest for r in rows} == {d: n for d, (n, _) in want.items()}
        if chars > 150:
            assert {r.doc_id: (r.longest, r.longest_at) for r in rows} == want
