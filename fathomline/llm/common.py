"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_bytes(column: str = "text") -> Column:
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def map_rows(df: DataFrame, rows: Callable[[list[dict]], list[dict]], schema: str, arrow: pa.Schema, size: int = 512) -> DataFrame:
    """Run `rows` over lists of at most `size` rows, so that a task holds few texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                if out := rows(batch.slice(at, size).to_pylist()):
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.mapInArrow(run, schema)


#: Keys that hold more than one in so many of all rows are heavy; there can't be more heavy keys than this.
SHARE = 4096


def join_by_share(rows: DataFrame, side: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join with a table of distinct keys, of which `weight` says how many of the `total` rows have each.

    The rows of heavy keys stay where they are and meet a broadcast of at most
    SHARE keys; only the others are shuffled, so no task gets more of one key
    than a SHARE-th of all rows.
    """
    heavy = F.col(weight) * SHARE > total
    hot = F.broadcast(side.where(heavy))
    others = rows.join(hot.select(*keys), keys, "left_anti").join(side.where(~heavy), keys)
    return rows.join(hot, keys).unionByName(others)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one of our own on a local master, and an error elsewhere."""
    sc = spark.sparkContext
    if folder := sc.getConf().get("spark.checkpoint.dir"):
        return folder
    if not (folder := sc.getCheckpointDir()):
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="fathomline-"))
        folder = sc.getCheckpointDir()
    return folder


class Shelf:
    """Intermediate tables, as Parquet in the shared folder, which cut the lineage.

    A table outlives its executors. `drop` frees one that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def put(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def empty(self, name: str, schema: str) -> DataFrame:
        return self.put(name, self.spark.createDataFrame([], schema))

    def add(self, name: str, df: DataFrame) -> DataFrame:
        """Rows that are added to those of earlier calls; a job that fails adds none."""
        df.write.mode("append").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def tidy(self) -> None:
        """Let the driver collect its garbage, without which Spark keeps the broadcasts and shuffles of jobs that are over. For operators of very many jobs."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
