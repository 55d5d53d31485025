"""Bounded samples of labelled rows, chosen by hash, the same on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def labelled_sample(rows: DataFrame, label: str, key: str, per_label: int, counts: dict | None = None) -> DataFrame:
    """About ``per_label`` rows of each value of ``label``, all of them where there are fewer.

    Rows are chosen by all 64 bits of a hash of ``key``, against a bar that the exact count of each label gives, so the sample
    stays bounded however many rows a label has. A label's count is combined before the shuffle, so a label that most rows
    have is no hot key. There is a broadcast row for each label. ``counts`` are the labels' counts where these are known.
    """
    rows = rows.filter(F.col(label).isNotNull())
    if counts is None:
        counts = {r[0]: r[1] for r in rows.groupBy(label).agg(F.count("*")).collect()}
    bars = [(x, min((per_label << 64) // n, (1 << 64) - 1) - (1 << 63)) for x, n in counts.items()]
    table = rows.sparkSession.createDataFrame(bars, T.StructType([T.StructField("sample_label", rows.schema[label].dataType), T.StructField("sample_bar", T.LongType())]))
    return rows.join(F.broadcast(table), (F.col(label) == F.col("sample_label")) & (F.xxhash64(F.col(key)) <= F.col("sample_bar")), "left_semi")
