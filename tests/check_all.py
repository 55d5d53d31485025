"""Run every query against its SQL: python tests/check_all.py [sf_dir] [name part]."""

from __future__ import annotations

import sys
import tempfile
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]

from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as e  # noqa: E402
from oracle import compare, connect  # noqa: E402


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    part = sys.argv[2] if len(sys.argv) > 2 else ""
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="check-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    oracle = e.oracle_sql()
    for name, run in e.queries().items():
        if part not in name:
            continue
        start = time.time()
        try:
            found = compare(run(spark, sf_dir), con, oracle[name]) if name in oracle else f"rows only: {run(spark, sf_dir).count()}"
        except Exception as exc:
            found = f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += found is not None and not found.startswith("rows only")
        print(f"{time.time() - start:6.2f}s {name}: {found or 'ok'}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
