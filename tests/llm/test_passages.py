"""Passages that repeat whatever the lines they stand in, against all windows of 50 words."""

import random

from pyspark.sql import functions as F

from runline.llm import queries, substring_dedup
from tests.llm import brute


def test_repeated_passages(spark):
    rng = random.Random(5)

    def words(n):
        return [f"w{rng.randrange(4000)}" for _ in range(n)]

    one, two, three = words(54), words(59), words(120)
    wrapped = "\n".join(" ".join(three[k : k + 8]) for k in range(0, 120, 8))
    docs = [
        " ".join(words(30) + one[:20]) + "\n" + " ".join(one[20:] + words(30)),
        " ".join(words(7) + one[:41]) + " \n\n" + " ".join(one[41:] + words(90)),  # over a line break
        " ".join(words(100) + two + words(80)),
        "x\n" + " ".join(words(200) + [w.upper() for w in two] + words(10)),  # inside a longer line
        " ".join(words(40) + three),
        "é é\n" + wrapped + "\n" + " ".join(words(9)),  # wrapped
        " ".join(one[:49] + words(40)),  # too short
        "a " * 60, "b " * 130, " ".join(words(70)), None, "",
        " ".join(three[60:] + two[:30] + words(4)),
        " ".join(words(3) + three[60:] + two[:30]),
    ]
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    rows = substring_dedup.line_and_passage_dedup(spark, table).where("unit = 'passage'").collect()
    got, removed = {}, {}
    for r in rows:
        got.setdefault(r.doc_id, set()).update(range(r.paragraph, r.paragraph + r.n_words))
        text = docs[r.doc_id].encode()[r.start : r.stop].decode().lower().split()
        kept = docs[r.class_id].lower().split()[r.class_paragraph : r.class_paragraph + r.n_words]
        assert text == kept == docs[r.doc_id].lower().split()[r.paragraph : r.paragraph + r.n_words]
        removed.setdefault(r.doc_id, []).append(r.removed)
    assert got == brute.repeated_words(list(enumerate(docs)))
    assert not any(removed[0]) and all(removed[1]) and all(removed[3]) and 6 not in removed and 7 not in removed
    assert substring_dedup.repeated_passages(spark, table.limit(0)).count() == 0


def test_query_finds_all_shared_windows(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {}
    for r in queries.op6_substring_dedup(spark, sf).where(F.col("unit") == "passage").collect():
        got.setdefault(r.doc_id, set()).update(range(r.paragraph, r.paragraph + r.n_words))
    want = brute.repeated_words(docs)
    assert want and got == want


def test_frequent_chunks_give_the_same_rows(spark, sf, monkeypatch):
    """Windows dealt one by one give what comparing whole chunks gives: copies by the dozen, periodic texts, repeated ids."""
    rng = random.Random(8)
    passage = " ".join(f"v{rng.randrange(900)}" for _ in range(75))
    rows = [(k % 40, f"{' '.join(f'u{rng.randrange(900)}' for _ in range(k % 7 * 9))} {passage}") for k in range(60)]
    rows += [(100, "a b c " * 50), (101, "a " * 70), (102, "d e " * 25), (103, "d e " * 26), (103, "d e " * 26), (104, "f " * 51), (104, "f " * 51), (105, None)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    for docs in (made, spark.read.parquet(f"{sf}/documents.parquet")):
        found = []
        for most in (10**9, 5, 0):
            monkeypatch.setattr(substring_dedup, "MOST_OF_NAME", most)
            found.append(sorted(map(tuple, substring_dedup.repeated_passages(spark, docs).collect())))
        assert found[0] and found[0] == found[1] == found[2]


def test_one_word_over_and_over(spark, monkeypatch):
    """A monotonous text is many rows, whose windows are dealt one by one to several tasks: the same rows as when compared at once."""
    docs = spark.createDataFrame([(1, "a " * 5000), (2, "b c " * 400), (3, "x y z"), (3, "b c " * 60)], "doc_id long, text string")
    found = []
    for piece, windows in ((4096, 10**9), (100, 10**9), (100, 300), (4096, 0)):
        monkeypatch.setattr(substring_dedup, "PIECE", piece)
        monkeypatch.setattr(substring_dedup, "MOST_WINDOWS", windows)
        found.append(sorted(map(tuple, substring_dedup.repeated_passages(spark, docs).collect())))
    assert found[0] and all(f == found[0] for f in found)
    own = spark.createDataFrame([(1, "a " * 5000)], "doc_id long, text string")
    names = substring_dedup._chunk_names(own, 50).groupBy("place").agg(F.sum("k").alias("k"), F.sum("windows").alias("windows"))
    rows = substring_dedup._wanted_chunks(own, names, 50).select(F.size("windows").alias("n"), "common").collect()
    assert len(rows) > 1 and max(r.n for r in rows) <= 4096 and all(r.common for r in rows)
