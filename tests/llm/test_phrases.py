import random
import re
from collections import Counter

import numpy as np
import pytest

from runline.llm import phrases

SCHEMA = "doc_id long, text string, lang string, key string, n long, f long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, longest=5, share=100, top=2000):
    counts, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {x: c for x, c in counts.items() if len(x[1]) > 1 and c >= least}
    inside = Counter()
    for (lang, w), c in found.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i : i + k]] = max(c, inside[lang, w[i : i + k]])
    rows = {}
    for (lang, w), a in found.items():
        if 100 * inside[lang, w] < share * a or not inside[lang, w]:
            cuts = [(1000 * a * n[lang] // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            rows.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), a, counts[lang, w[:k]], counts[lang, w[k:]], score))
    return {(lang, i + 1, r[2].decode(), *r[3:6], n[lang], r[6]) for lang, own in rows.items() for i, r in enumerate(sorted(own)[:top])}


def made(seed=1, n=200):
    rng = random.Random(seed)
    words = ["a", "b", "c", "New", "york", "city", "é", "ẞ", "x1", "\x01z", "of", "the"]
    marks = [" ", " ", " ", " ", " ", " ", "  ", "\t", ".", ", ", "\n", "!?", "; "]
    fixed = ["New york city", "of the", "a b c New york", "rare" + "y" * 50]
    docs = [("".join(rng.choice([*words, *fixed]) + rng.choice(marks) for _ in range(rng.randrange(60))), rng.choice(["en", "en", "en", "de", None, "und", ""])) for _ in range(n)]
    return docs + [(None, "en"), ("", "de"), (" \t.\n", "fr"), ("of the " * 3000, "en"), (docs[0][0], docs[0][1]), (docs[0][0], docs[0][1]), ("one-piece " * 500, "xx")]


def frame(spark, docs):
    return spark.createDataFrame([(None if i % 5 == 0 else 3, t, la, "k", 1, 2) for i, (t, la) in enumerate(docs)], SCHEMA)


@pytest.mark.parametrize(("least", "chunk", "per_range", "share", "top"), [(5, 4 << 20, 10**6, 100, 2000), (3, 700, 300, 100, 40), (20, 2000, 50, 60, 2000), (10**6, 2000, 50, 100, 2000)])
def test_against_brute_force(spark, monkeypatch, least, chunk, per_range, share, top):
    """One range and many, whose borders phrases run over; small chunks; null languages and texts, repeated rows, long texts, clashing names."""
    monkeypatch.setattr(phrases, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(phrases, "RANGE_KEYS", per_range)
    docs = made()
    got = phrases.phrases(spark, frame(spark, docs), least=least, share=share, top=top).collect()
    assert {tuple(r) for r in got} == brute(docs, least, share=share, top=top)
    assert len(got) == len(set(got))


def test_dictionary_that_is_not_sent(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MOST_SENT", 0)
    docs = made(2, 60)
    assert {tuple(r) for r in phrases.phrases(spark, frame(spark, docs), least=4, longest=3).collect()} == brute(docs, 4, longest=3)


def rows_joined(spark, on, after):
    """Rows out of the joins on `on`, for each execution from number `after` on that has one."""
    store, out = spark._jsparkSession.sharedState().statusStore(), []
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs = store.executionsList()
    for run in (runs.apply(i).executionId() for i in range(runs.size())):
        nodes, values = store.planGraph(run).allNodes(), {}
        told = store.executionMetrics(run).iterator() if run >= after else None
        while told is not None and told.hasNext():
            pair = told.next()
            values[pair._1()] = pair._2()
        for node in (nodes.apply(i) for i in range(nodes.size() if values else 0)):
            metrics = [node.metrics().apply(i) for i in range(node.metrics().size())]
            if "Join" in node.name() and on in re.sub("#[0-9]+L?", "", node.desc()):
                out += [int(values.get(m.accumulatorId(), "0").replace(",", "")) for m in metrics if m.name() == "number of output rows"]
    return out


def test_sample_joins_its_own_chunks_alone(spark, monkeypatch):
    """The bounds' sample joins the words of its chunks to the dictionary, not those of all chunks once more."""
    for name, value in (("CHUNK_BYTES", 500), ("RANGE_KEYS", 50), ("SAMPLED_CHUNKS", 2)):
        monkeypatch.setattr(phrases, name, value)
    docs = made(3)
    after = spark._jsparkSession.sharedState().statusStore().executionsCount()
    got = phrases.phrases(spark, frame(spark, docs), least=5).collect()
    few, every = sorted(rows_joined(spark, "[lang, word], [lang, word]", after))
    assert 0 < 5 * few < every
    assert {tuple(r) for r in got} == brute(docs, 5)


def test_no_rows_and_ties(spark):
    assert phrases.phrases(spark, frame(spark, [])).count() == 0
    assert phrases.phrases(spark, frame(spark, [(None, "en")])).count() == 0
    docs = [("b a. a b. c a. a c", "en")] * 4
    assert {tuple(r) for r in phrases.phrases(spark, frame(spark, docs), least=4).collect()} == brute(docs, 4)


def test_radix_and_packing():
    rng = np.random.default_rng(1)
    for most in (3, 70_000, 2**32 - 1):
        keys = rng.integers(0, most, (500, 5), dtype=np.uint32, endpoint=True)
        keys = np.concatenate([keys, keys[:100]])
        found, counts = phrases._counted(keys, None)
        want, times = np.unique(keys, axis=0, return_counts=True)
        assert (found == want).all() and (counts == times).all()
        assert (np.sort(phrases._binary(found, 4)) == phrases._binary(found, 4)).all()
        again, more = phrases._unpack(phrases._pack(found, counts, 4), len(found), 5, 4)
        assert (again == found).all() and (more == counts).all()


def test_long_texts_are_cut_where_pieces_end():
    data = np.frombuffer(b"aa bb. cc dd, ee ff gg hh ii jj. k", dtype=np.uint8)
    offsets, texts = phrases._parts(data, np.array([0, 3, 33]), 8)
    assert offsets.tolist() == [0, 3, 6, 13, 33] and texts.tolist() == [0, 1, 1, 1]
