"""The registered queries of this subpackage: thin digests of what its operators return, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runline.llm import decontaminate, language_id, merkle, ngram_join, packing, phrases, quality_rules, secret_scan, substring_dedup, token_counts, toxicity, training_order, url_filter
from runline.llm.oracle import ORACLE_SQL
from runline.llm.scratch import Scratch


__all__ = ["ORACLE_SQL", "QUERIES"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(spark, _table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def _crc_mod(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(spark, docs, _table(spark, sf_dir, "labels"), _crc_mod(3) != 1)
    return toxicity.toxicity(spark, docs, model).select("doc_id", (_crc_mod(3) == 1).alias("held_out"), "score", "predicted")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(spark, _table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(spark, docs.where(_crc_mod(5) != 0), "doc_id", "lang", "text")
    return language_id.language_id(spark, docs, model).select("doc_id", (_crc_mod(5) == 0).alias("held_out"), "lang_pred", "score")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = quality_rules.quality_rules(spark, _table(spark, sf_dir, "documents"), failed)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.line_and_passage_dedup(spark, _table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_scan.secret_scan(spark, _table(spark, sf_dir, "documents"))

    def of(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def text(s):
        return F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))

    base = F.filter("found", lambda s: s["kind"] != "markov")
    return rows.select(
        "doc_id", of("assign"), of("access"), of("hex"),
        F.sha2(F.array_join(F.transform(base, text), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("found", text), ",").alias("spans"),
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.decontaminate(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["size"])
    return rows.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


#: The rules of the contract: (host, path, action).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def url_rules(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(a).alias("action")) for h, p, a in rules])
    return spark.range(1).select(F.inline(rows))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(spark, _table(spark, sf_dir, "pages"), url_rules(spark, URL_RULES))


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences as they are read again from the binary shards."""
    path = Scratch(spark, "shards").path()
    training_order.write_order(spark, _table(spark, sf_dir, "documents"), path)
    read = training_order.read_from(spark, path).select("slot", F.crc32("payload").alias("payload_crc32"))
    index = spark.read.parquet(f"{path}/index").select("slot", "sequence_id", "shard", "position", "n_tokens", F.col("ids_of_docs").alias("doc_ids"))
    return index.join(read, "slot")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each row's proof shows: for a third of the rows (by id) that the text was altered, unless it has no capitals."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    head, capitals = [F.col(c) for c in docs.columns[:-1]], "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    leaf, altered = merkle.digest(*head, F.col("text")), merkle.digest(*head, F.translate("text", capitals, capitals.lower()))
    rows = docs.select("doc_id", "lang", leaf.alias("leaf"), F.when(_crc_mod(3) == 0, altered).alias("altered"))
    made = merkle.manifest(spark, rows)
    root = F.lit(made.root.hex() if made.root else None).cast("string")
    siblings = F.array_join(F.transform("path", lambda run: merkle.as_hex(F.concat(run["before"], run["after"]))), "")
    out = made.proofs.select(
        "doc_id", merkle.as_hex(F.col("leaf")).alias("leaf"), merkle.as_hex(F.col("subroot")).alias("subroot"), root.alias("root"),
        F.sha2(siblings, 256).alias("proof_sha256"), merkle.fold(F.coalesce("altered", "leaf"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.phrases(spark, _table(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_toxicity": op2_toxicity,
    "op3_packing": op3_packing,
    "op4_language_id": op4_language_id,
    "op5_quality_rules": op5_quality_rules,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_decontamination": op8_decontamination,
    "op9_url_filter": op9_url_filter,
    "op10_training_order": op10_training_order,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_token_counts": op13_token_counts,
}
