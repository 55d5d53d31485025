"""The folder all executors share, for data that must outlive one plan."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a local session (a test) gets a temporary folder; a cluster must name one, because a folder of
    one machine is lost with it.
    """
    named = spark.conf.get(KEY, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {KEY} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="cleanframe-")
    spark.conf.set(KEY, folder)
    return folder
