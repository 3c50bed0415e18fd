import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from runline.llm import queries, token_counts

PARTS = ["a", "b", "the", " ", "  ", "\n", "\t", " \n", "'s", "'ll", "é", "ß", "日本", "1", "23", "½", "!", "...", "<|endoftext|>", "<|endoftext|", "\x1c", "\x85", "\xa0", "Hello", "x" * 30, "😀", "՘", "　", "ﬁ", "İ", "\x00", "é", "ͅ"]
SCHEMA = "doc_id long, n_bytes string, text string, id string, n_tokens string"


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))


def odd_texts(n=3000):
    rng = random.Random(3)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) for _ in range(n)] + ["", " ", "\n", "a ", " a", "a  b", "<|endoftext|>" * 3, "a" * 3000]


@pytest.mark.parametrize("name", ["byte_bpe_50k", "word_bpe_49k"])
def test_counts_as_the_library(name):
    texts = odd_texts()
    want = [len(x.ids) for x in library(name).encode_batch(texts, add_special_tokens=False)]
    assert token_counts.Merges(name).batch(pa.array(texts)).tolist() == want


def test_cuts_as_the_library_below_0250():
    model = token_counts.Merges("byte_bpe_50k")
    for c in range(0x250):
        text = "a{0}a 1{0}1 !{0}! {0} {0}{0}'{0}".format(chr(c))
        assert model.cut(text) == [text[a:b] for _, (a, b) in model.pre_tokens(text)], hex(c)


def test_small_cache(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHED", 5)
    texts = odd_texts(300)
    want = [len(x.ids) for x in library("byte_bpe_50k").encode_batch(texts, add_special_tokens=False)]
    assert token_counts.Merges("byte_bpe_50k").batch(pa.array(texts)).tolist() == want


def test_very_long_texts():
    texts = ["a" * 200_000, "\n" * 200_000, "日" * 100_000, "ab1 " * 100_000, "'" * 100_000]
    want = [len(x.ids) for x in library("byte_bpe_50k").encode_batch(texts, add_special_tokens=False)]
    assert token_counts.Merges("byte_bpe_50k").batch(pa.array(texts)).tolist() == want


def test_rows(spark):
    """Null and repeated ids and texts, clashing columns, no rows."""
    texts = [None, "", "one two", "one two", "é", *odd_texts(50)]
    rows = [(None if i < 4 else i, "x", t, "y", "z") for i, t in enumerate(texts)]
    found = token_counts.token_counts(spark.createDataFrame(rows, SCHEMA), limit=3)
    assert [f.name for f in found.schema] == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(r[0], len((r[2] or "").encode()), len(library("byte_bpe_50k").encode(r[2] or "", add_special_tokens=False).ids)) for r in rows]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(((*w, w[2] > 3) for w in want), key=repr)
    assert token_counts.token_counts(spark.createDataFrame([], SCHEMA)).count() == 0
    named = spark.createDataFrame([("a", "b c")], "n_bytes string, id string")
    with pytest.raises(ValueError):
        token_counts.token_counts(named, "n_bytes", "id")
    named = spark.createDataFrame([("a", "b c")], "key string, id string")
    assert [tuple(r) for r in token_counts.token_counts(named, "key", "id").collect()] == [("a", 3, 2, False)]


def test_query(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids, texts = list(docs), list(docs.values())
    want = {(i, len(t.encode()), len(e.ids), len(e.ids) > 1024) for i, t, e in zip(ids, texts, library("byte_bpe_50k").encode_batch(texts, add_special_tokens=False), strict=True)}
    rows = queries.op13_token_counts(spark, sf).collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)
