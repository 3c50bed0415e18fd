"""Very long texts, and texts of one word over and over."""

import random
import time

import public_tokenizers
from tokenizers import Tokenizer

from runline.llm import queries, secret_scan
from tests.llm import brute


def test_dense_secrets_take_time_in_proportion():
    """10 MB with 100,000 spans."""
    rng = random.Random(1)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    lines = [f"token = {i:08d}x {''.join(rng.choice(alphabet) for _ in range(32))} word word word word word word word\n" for i in range(100_000)]
    text = "".join(lines)
    began = time.perf_counter()
    spans = secret_scan.base_spans(text)
    taken = secret_scan.Taken(spans)
    met = [taken.meets(m.start(), m.end()) for m in secret_scan.candidates(text)]
    assert len(spans) == 100_000 and len(met) > 99_000 and not any(met)
    assert time.perf_counter() - began < 30


def test_spans_that_meet():
    rng = random.Random(2)
    for _ in range(300):
        spans = sorted((a, 0, a + rng.randrange(1, 20)) for a in (rng.randrange(60) for _ in range(rng.randrange(6))))
        taken = secret_scan.Taken(spans)
        for start in range(0, 80, 3):
            for end in (start + 1, start + 7):
                assert taken.meets(start, end) == any(a < end and start < b for a, _, b in spans)


def test_pipeline_stages_keep_columns_named_like_their_own(spark, sf):
    import corpus_pipeline as P

    rows = [(1, "one two three four five six", "en", "s", 27, 7, "x", 9, "c"), (2, "one two three four five six", "en", "s", 27, 8, "x", 9, "c"), (None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row long, _ROW_ string, component_id long, first string")
    for stage, kept in ((P.one_of_each_group, [1, None]), (P.no_benchmark, [1, 2, None]), (P.no_secrets, [1, 2, None])):
        found = stage(spark, docs, sf)
        assert found.columns == docs.columns
        assert sorted(map(tuple, found.collect()), key=repr) == sorted((r for r in rows if r[0] in kept), key=repr)


def test_all_queries_on_very_long_texts(spark, tmp_path):
    """Texts beyond every slice (2 MB), one of them twice, beside short ones: what plain Python finds in them."""
    rng = random.Random(4)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(3000)] + ["new york"] * 20
    long = " ".join(rng.choice(words) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(480_000))
    leak = " ".join(rng.choice(words) + "x" for _ in range(30))
    texts = {1: long, 2: long, 3: "short one here", 4: long[: len(long) // 2] + " token=abcdef123456 " + leak + " " + long[len(long) // 2 :], 5: None, 6: leak}
    assert len(long) > 2 << 20
    docs = [(i, t, "en" if i % 2 else "de", f"s{i % 2}", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i == 3)) for i in texts], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("b", leak)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "http://" + "a." * 100_000 + "example.com/de/" + "x" * 500_000, "")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")

    def rows(name):
        return queries.QUERIES[name](spark, str(tmp_path)).collect()

    sets = {i: brute.shingles(t) for i, t in texts.items()}
    same = {i: min(j for j in texts if i == j or brute.similar(sets[i], sets[j])) for i in texts}
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in rows("op1_ngram_jaccard_join")} == {(i, len(sets[i]), same[i]) for i in texts}
    assert {r.doc_id for r in rows("op2_toxicity")} == set(texts) == {r.doc_id for r in rows("op4_language_id")}
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {i: len(model.encode(t or "", add_special_tokens=False).ids) for i, t in texts.items()}
    pieces = rows("op3_packing")
    assert {i: sum(r.length for r in pieces if r.doc_id == i) for i in texts} == {i: n + 1 for i, n in tokens.items()}
    assert {(r.doc_id, r.n_tokens) for r in rows("op13_token_counts")} == set(tokens.items())
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows("op5_quality_rules")} == {i: brute.quality(t) for i, t in texts.items()}
    passages = [r for r in rows("op6_substring_dedup") if r.unit == "passage" and r.doc_id == 2]
    assert max(r.n_words for r in passages) == len(brute.BLANK.findall(long))
    assert {r.doc_id: (r.n_assign, r.n_hex) for r in rows("op7_secret_scan")} == {i: (int(i == 4), 0) for i in texts}
    assert {r.doc_id: (r.n_words, r.n_hit) for r in rows("op8_decontamination")} == {i: (len(brute.ALNUM.findall(t or "")), 30 * (i in (4, 6))) for i, t in texts.items()}
    assert [(len(r.host), r.rule, r.verdict) for r in rows("op9_url_filter")] == [(200_011, "example.com/de/", "block")]
    order = rows("op10_training_order")
    assert sum(r.n_tokens for r in order) == sum(tokens.values()) + len(texts) and sorted(r.slot for r in order) == list(range(len(order)))
    assert all(r.verified or r.doc_id in (1, 4) for r in rows("op11_merkle_manifest"))
    assert [(r.rank, r.a) for r in rows("op12_phrase_collocations") if (r.lang, r.phrase) == ("en", "new york")] == [(1, long.count("new york"))]
