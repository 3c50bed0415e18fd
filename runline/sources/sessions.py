"""Recorded sessions: one CSV file is one session, its row order is the order of rows."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runline.config import SESSION_FILES, TIME_COLUMNS
from runline.operators import ranges
from runline.sources.scratch import Scratch

_NAME = r"(session|sess|s)[_\- ]*(1|2|13)\b"


def normalise_header(df: DataFrame) -> DataFrame:
    """Column names without blanks around them."""
    return df.toDF(*[c.strip() for c in df.columns])


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_files(spark: SparkSession, path: str, pattern: str = "Data_from_*.csv") -> DataFrame:
    """All columns as text, with file_name and row_idx (position in the file, from 0). Fails if no file matches.

    Columns go by name: files may lack columns, order them differently, or pad their names. Files of one header are read by
    one scan; there are as many scans as different headers. A file without any line has no rows.
    """
    lines = spark.read.option("pathGlobFilter", pattern).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"), "value")
    heads = lines.where("at = 0").groupBy("path").agg(F.min_by("value", "id").alias("head"))
    groups = heads.groupBy("head").agg(F.array_sort(F.collect_list("path")).alias("paths")).orderBy("head").collect()  # a row per different header
    if not groups:
        raise FileNotFoundError(f"no file {pattern} in {path}")
    out = None
    for g in groups:
        read = spark.read.option("header", True).csv(g.paths)
        one = normalise_header(read.select("*", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id")))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return _numbered_by_splits(out)


def _numbered_by_splits(rows: DataFrame) -> DataFrame:
    """`row_idx` of rows of splits of files (file_name, `_at`, where `_id` goes up by one from row to row of a split): a split's rows are counted, and the
    rows of the splits before it added. A row per split is all that is ordered, so a file of many splits is numbered by as many tasks."""
    rows = Scratch(rows.sparkSession, "splits").stored(rows)
    split = ["file_name", "_at"]
    before = F.sum("_k").over(Window.partitionBy("file_name").orderBy("_at")) - F.col("_k")
    counts = rows.groupBy(*split).agg(F.min("_id").alias("_first"), F.count("*").alias("_k")).select(*split, "_first", before.alias("_before"))
    return rows.join(counts, split).withColumn("row_idx", (F.col("_id") - F.col("_first") + F.col("_before")).cast("long")).drop("_at", "_id", "_first", "_before")


def row_index(df: DataFrame, keys: list[str], by: list[str], name: str = "row_idx") -> DataFrame:
    """Position within each series, from 0, in the order of `by`: rows are sorted in ranges, so a series is numbered by many tasks."""
    return ranges.placed(df, keys, by, name)


def read_sessions(spark: SparkSession, path: str, pattern: str = "Data_from_*.csv") -> DataFrame:
    """With session_id: rank of the file's name among all, from 1."""
    rows = read_files(spark, path, pattern)
    names = rows.select("file_name").distinct()
    ids = names.withColumn("session_id", F.dense_rank().over(Window.orderBy("file_name")).cast("int"))  # a row per file
    return rows.join(F.broadcast(ids), "file_name")


def session_of_name(name: Column, known: dict[str, int] = SESSION_FILES) -> Column:
    """Session id of a file name: by the map of known names, else by the number after `session`, `sess` or `s`; else null."""
    low = F.lower(name)
    mapped = F.coalesce(*[F.when(low == n.lower(), F.lit(i)) for n, i in known.items()], F.lit(None).cast("int"))
    found = F.regexp_extract(low, _NAME, 2)
    return F.coalesce(mapped, F.when(found != "", found.cast("int")))


def session_from_filename(names: DataFrame, targets: list[int], known: dict[str, int] = SESSION_FILES, file: str = "file_name") -> DataFrame:
    """(session_id, file_name) of the target sessions; of two files with one id the last name wins."""
    rows = names.select(F.col(file).alias("file_name"), session_of_name(F.col(file), known).alias("session_id")).where(F.col("session_id").isin(targets))
    return rows.groupBy("session_id").agg(F.max("file_name").alias("file_name"))


def missing_sessions(found: DataFrame, targets: list[int]) -> DataFrame:
    wanted = found.sparkSession.range(1).select(F.explode(F.array(*[F.lit(t) for t in targets])).alias("session_id"))
    return wanted.join(found, "session_id", "left_anti")


def require_sessions(found: DataFrame, targets: list[int]) -> DataFrame:
    """`found`, or an error that names the targets without a file."""
    missing = sorted(r.session_id for r in missing_sessions(found, targets).collect())  # at most the targets
    if missing:
        raise FileNotFoundError(f"no file for sessions {', '.join(map(str, missing))}")
    return found


def read_target_sessions(spark: SparkSession, path: str, targets: list[int], pattern: str = "*.csv", known: dict[str, int] = SESSION_FILES) -> DataFrame:
    """Rows of the files that stand for the target sessions, with session_id; fails if a target has none."""
    rows = read_files(spark, path, pattern)
    files = require_sessions(session_from_filename(rows.select("file_name").distinct(), targets, known), targets)
    return rows.join(F.broadcast(files), "file_name")  # a row per target


def parse_time(df: DataFrame, candidates: list[str] = TIME_COLUMNS, name: str = "ts", unit: str = "ns") -> DataFrame:
    """The first of the candidate columns that exists (else the first column) as a timestamp; what cannot be read is null.
    Numbers are an epoch in `unit` (s, ms, us, ns)."""
    source = next((c for c in candidates if c in df.columns), df.columns[0])
    c, per = F.col(source), {"s": 1e6, "ms": 1e3, "us": 1.0, "ns": 1e-3}[unit]
    if dict(df.dtypes)[source] == "string":
        number = F.when(c.rlike(r"^\s*-?[0-9]+(\.[0-9]+)?\s*$"), F.trim(c).try_cast("double"))
        return df.withColumn(name, F.coalesce(F.timestamp_micros((number * per).cast("long")), F.try_to_timestamp(c)))
    if dict(df.dtypes)[source] in ("timestamp", "timestamp_ntz", "date"):
        return df.withColumn(name, c.cast("timestamp"))
    return df.withColumn(name, F.timestamp_micros((c * per).cast("long")))


def _files(spark: SparkSession, path: str):
    """(file system, path class of the JVM) for a folder of any store."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def _leaves(fs, make, folder: str, depth: int) -> list[str]:
    """Partition folders (`a=1/b=2`) of a written table, relative to it."""
    found = [""]
    for _ in range(depth):
        found = [f"{f}/{x.getPath().getName()}".lstrip("/") for f in found for x in fs.listStatus(make(f"{folder}/{f}" if f else folder)) if "=" in x.getPath().getName()]
    return found


def write_tables(tables: dict[str, DataFrame], path: str, partition_by: list[str] | None = None, kind: str = "parquet", replace: str = "tables") -> None:
    """Each table in a folder of its own; an empty one keeps its schema, in a file without partitions.

    All tables are first written, once each, to a staging folder beside them; a run that fails until then leaves what is there as it is. Then a
    marker tells what is to be moved, and folders are renamed; if that is interrupted, the next call (or `finish_commit`) goes on with it. replace:
    `tables` (a table is replaced whole) or `partitions` (only the partitions that the new one has, e.g. those of a fold).
    """
    if replace not in ("tables", "partitions"):
        raise ValueError(f"replace: {replace}")
    if not tables:
        return
    spark = next(iter(tables.values())).sparkSession
    finish_commit(spark, path)
    staging, moves = f"{path}/_staging-{uuid.uuid4().hex}", []
    options = {"header": True} if kind == "csv" else {}
    fs, make = _files(spark, path)
    for name, df in tables.items():
        by, folder = [c for c in partition_by or [] if c in df.columns], f"{staging}/{name}"
        df.write.partitionBy(*by).format(kind).options(**options).save(folder)
        leaves = _leaves(fs, make, folder, len(by))
        if not leaves:  # no row
            fs.delete(make(folder), True)
            spark.createDataFrame([], df.schema).coalesce(1).write.format(kind).options(**options).save(folder)
        if by and leaves and replace == "partitions":
            moves += [f"{name}/{leaf}" for leaf in leaves]
        elif leaves or replace == "tables" or not fs.exists(make(f"{path}/{name}")):
            moves.append(name)
    marker = json.dumps({"staging": staging.rsplit("/", 1)[1], "moves": moves})
    spark.createDataFrame([(marker,)], "value string").coalesce(1).write.text(f"{path}/_commit")
    finish_commit(spark, path)


def finish_commit(spark: SparkSession, path: str) -> bool:
    """Carries out a commit that was decided, but not ended; removes staging folders without a decision. False if there was none."""
    fs, make = _files(spark, path)
    if not fs.exists(make(path)):
        return False
    decided = fs.exists(make(f"{path}/_commit/_SUCCESS"))
    if decided:
        told = json.loads("".join(r.value for r in spark.read.text(f"{path}/_commit").collect()))
        for name in told["moves"]:
            source, target = make(f"{path}/{told['staging']}/{name}"), make(f"{path}/{name}")
            if fs.exists(source):  # else it has been moved already
                fs.delete(target, True)
                fs.mkdirs(target.getParent())
                if not fs.rename(source, target):
                    raise OSError(f"cannot move {source.toString()}")
    for x in fs.listStatus(make(path)):
        if x.getPath().getName().startswith("_staging-"):
            fs.delete(x.getPath(), True)
    fs.delete(make(f"{path}/_commit"), True)
    return decided
