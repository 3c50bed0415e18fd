"""From raw documents to packed training sequences: five stages, each written and read again by the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runline.llm import decontaminate, language_id, ngram_join, packing, secret_scan
from runline.llm.scratch import Scratch

#: The least score of the winning language; a text below it belongs to none of the languages learned.
LEAST_LANGUAGE_SCORE = 0.3
SECRET = "[secret]"


def _numbered(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """Written with a number per row, so that stages judge rows, whatever their ids: they may be null or repeat. The number's column has a name that no
    given one has."""
    name = "_row"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return Scratch(spark, "rows").stored(docs.select("*", F.monotonically_increasing_id().alias(name))), name


def _but(spark: SparkSession, rows: DataFrame, bad: DataFrame, row: str) -> DataFrame:
    """`rows` but those whose number is in `bad`. The numbers are written first: only if that table is small, it is broadcast."""
    return rows.join(Scratch(spark, "dropped").stored(bad.select(row).distinct()), row, "left_anti").drop(row)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty ones too), and those that resemble no language of the corpus. Rows
    are judged by their text alone, so repeated ones alike; without any row that names a language all are dropped. Columns stay as
    they are, further ones too."""
    model = language_id.train(spark, docs, "doc_id", "lang", "text")
    given = docs.withColumnsRenamed({c: f"own_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")})
    judged = language_id.language_id(spark, given, model, keep=given.columns)
    kept = judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.select(*[F.col(g).alias(c) for g, c in zip(given.columns, docs.columns, strict=True)])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near copies, that of the smallest id (of repeated or null ids, the row read first;
    null ids come last). Rows without words are no copies of anything and stay."""
    rows, row = _numbered(spark, docs)
    found = ngram_join.ngram_join(spark, rows, row).select(F.col(row).alias("own"), "n_shingles", "component_id")
    found = Scratch(spark, "groups").stored(found.join(rows.select(F.col(row).alias("own"), F.col("doc_id").alias("id")), "own").where("n_shingles > 0"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", F.col("own").alias("row"))
    first = found.groupBy("component_id").agg(F.min(order).alias("first"), F.count("*").alias("k")).where("k > 1")
    # Written, so that the join after it is planned by its size, and a component of very many rows can be split.
    first = Scratch(spark, "first").stored(first.select("component_id", F.col("first.row").alias("stays")))
    others = found.join(first, "component_id").where("own <> stays")
    return _but(spark, rows, others.select(F.col("own").alias(row)), row)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a benchmark passage, row by row: a null or repeated id makes no difference, null texts stay."""
    rows, row = _numbered(spark, docs)
    found = decontaminate.decontaminate(spark, rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), row)
    return _but(spark, rows, found.where(F.size("hits") > 0), row)


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all rows; each secret's text is replaced, and n_chars follows, if there is such a column. Null texts stay null."""
    given = docs.withColumnsRenamed({c: f"own_{i}" for i, c in enumerate(docs.columns) if c != "text"})
    others = [c for c in given.columns if c != "text"]
    cleaned = secret_scan.secret_spans(given, secret_scan.train(docs), others, redact=SECRET).withColumnRenamed("redacted", "text")
    out = cleaned.select(*[F.col(g).alias(c) for g, c in zip(given.columns, docs.columns, strict=True)])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents that are left, cut into sequences of 1024 tokens. A null text is the end id alone; repeated rows are
    packed each; no documents give no pieces."""
    return packing.pack(spark, docs)


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", no_benchmark),
    ("secret scans", no_secrets),
    ("packing", packed),
]

#: Trained models and token ids are out of reach of SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents, each written and reread. An empty table gives no pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
