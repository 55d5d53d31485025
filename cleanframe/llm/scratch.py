"""Tables written between the steps of an operator, in the folder all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import shared_folder

#: Bytes of rows handed to Python at once; a longer row goes alone.
BATCH_BYTES = 4 << 20


@contextmanager
def writing(spark: SparkSession, batch_bytes: int = BATCH_BYTES) -> Iterator[None]:
    """Session settings for writing one step: its shuffle files are deleted when it has ended, not when the driver happens to
    collect garbage, and rows go to Python in batches bounded by bytes. A step that loses files while it runs makes them again.
    """
    ours = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(batch_bytes)}
    before = {k: spark.conf.get(k, None) for k in ours}
    for k, v in ours.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch:
    """A fresh folder under ``spark.checkpoint.dir``. A written table cuts the lineage: lost executors cost no redo."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables: dict[str, str] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, batch_bytes: int = BATCH_BYTES, **options: str) -> DataFrame:
        """Write a table and read it back."""
        with writing(self.spark, batch_bytes):
            df.write.mode("errorifexists").options(**options).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def keep_by(self, df: DataFrame, name: str, key: str, buckets: int, **options: str) -> DataFrame:
        """Write a table in buckets of ``key``, so that later joins and groups by the key need no shuffle of it."""
        self.tables[name] = table = f"scratch_{uuid.uuid4().hex}"
        with writing(self.spark):
            df.write.mode("errorifexists").format("parquet").bucketBy(buckets, key).options(**options).option("path", self.path(name)).saveAsTable(table)
        return self.spark.table(table)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            if name in self.tables:
                self.spark.sql(f"DROP TABLE {self.tables.pop(name)}")
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
