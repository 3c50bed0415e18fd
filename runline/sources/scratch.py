"""Tables in the folder that the cluster shares: they cut lineage, so that a lost executor costs one stage at most, and keep
the plans of long chains short."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_roots: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only a session in one process may do without: it gets a folder of its own, which
    goes when the process ends. Anywhere else a machine's own folder would lose data, so that is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="spark-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return "file://" + _own[0]


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Written tables of one run of an operator. `stored` writes and reads again; `drop` frees what is used up."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        _roots.append(self.root)

    def path(self) -> str:
        self.count += 1
        return f"{self.root}/{self.count}"

    def stored(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._runline_path = path
        return back

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            _delete(self.spark, table._runline_path)


def release(spark: SparkSession) -> None:
    """Deletes all tables that operators have written so far. What they returned reads them: call it once results are kept."""
    while _roots:
        _delete(spark, _roots.pop())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
