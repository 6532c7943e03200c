"""A sink whose state changes once for each batch, however often the batch is delivered.

The state is dealt over buckets by a hash of its keys. A batch writes new
versions of the buckets that it touches, and then one entry of the ledger, which
names the version of every bucket. A batch whose entry exists is passed over; one
that stopped before its entry is done again from the last entry's versions.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class Ledger:
    """State and ledger under a folder that all executors share.

    `merge(state, batch)` gives the new state of the keys of one bucket; it sees
    whole buckets of both. Batches come in order of their ids, as Structured
    Streaming delivers them.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS):
        self.spark, self.root, self.schema, self.keys, self.merge, self.buckets = spark, root.rstrip("/"), schema, keys, merge, buckets
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def entries(self) -> dict[int, dict[str, int]]:
        """Batch ids and the versions of buckets after them."""
        folder = self.path(f"{self.root}/ledger")
        if not self.fs.exists(folder):
            return {}
        names = [f.getPath().getName() for f in self.fs.listStatus(folder)]
        return {int(n.removesuffix(".json")): self._read(n) for n in names if n.endswith(".json")}

    def _read(self, name: str) -> dict[str, int]:
        return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.root}/ledger/{name}").collect()))  # one number for each bucket

    def _commit(self, batch_id: int, versions: dict[str, int]) -> None:
        """The entry appears whole or not at all."""
        temporary, final = self.path(f"{self.root}/ledger/_{batch_id}.tmp"), self.path(f"{self.root}/ledger/{batch_id}.json")
        out = self.fs.create(temporary, True)
        out.write(bytearray(json.dumps(versions).encode()))
        out.close()
        if not self.fs.rename(temporary, final):
            raise OSError(f"the entry of batch {batch_id} was not written")

    def _buckets_of(self, versions: dict[str, int], wanted: list[int] | None = None) -> DataFrame:
        paths = [f"{self.root}/state/version={v}/bucket={b}" for b, v in versions.items() if wanted is None or int(b) in wanted]
        paths = [p for p in paths if self.fs.exists(self.path(p))]
        empty = self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(empty.schema).parquet(*paths) if paths else empty

    def state(self) -> DataFrame:
        """The state after the last batch that has an entry."""
        entries = self.entries()
        return self._buckets_of(entries[max(entries)] if entries else {})

    def write(self, batch: DataFrame, batch_id: int) -> bool:
        """Apply a batch, unless its entry, or that of a later one, exists. For foreachBatch."""
        entries = self.entries()
        if entries and batch_id <= max(entries):
            return False
        versions = dict(entries[max(entries)]) if entries else {}
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        batch = batch.persist()
        try:
            touched = [r.b for r in batch.select(bucket.alias("b")).distinct().collect()]  # at most `buckets`
            if touched:
                merged = self.merge(self._buckets_of(versions, touched), batch).select(*self.spark.createDataFrame([], self.schema).columns)
                # What a stopped attempt left of this version is overwritten.
                merged.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/state/version={batch_id}")
        finally:
            batch.unpersist()
        self._commit(batch_id, versions | {str(b): batch_id for b in touched})
        return True

    def clean(self, keep: int = 2) -> list[int]:
        """Delete the entries before the last `keep`, and versions that no kept entry names; returns the versions that are gone."""
        entries = self.entries()
        old = sorted(entries)[:-keep] if keep else []
        named = {v for k, e in entries.items() if k not in old for v in e.values()}
        for k in old:
            self.fs.delete(self.path(f"{self.root}/ledger/{k}.json"), False)
        gone = []
        folder = self.path(f"{self.root}/state")
        for f in self.fs.listStatus(folder) if self.fs.exists(folder) else []:
            version = f.getPath().getName().removeprefix("version=")
            if version.isdigit() and int(version) not in named and entries and int(version) <= max(entries):
                self.fs.delete(f.getPath(), True)
                gone.append(int(version))
        return sorted(gone)
