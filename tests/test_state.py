"""Statistics that the scans of one table share."""

import math

import pytest
from pyspark.sql import functions as F

import cleanframe as cf
from cleanframe.plans import scan_all as module
from cleanframe.plans.state import remembered_state


def mixed(spark, n=300):
    return spark.range(n).select(
        "id", F.when(F.col("id") % 7 != 0, (F.col("id") % 50) ** 2 - 30.0).alias("x"), F.when(F.col("id") % 5 == 0, float("nan")).otherwise(1.5).alias("same"),
        F.when(F.col("id") % 3 == 0, "N/A").when(F.col("id") % 4 == 0, None).otherwise(F.col("id").cast("string")).alias("t"), F.concat(F.lit("$"), "id").alias("money"),
        F.lit(None).cast("double").alias("nothing"), (F.col("id") % 2 == 0).alias("flag"))


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v for v in r) for r in df.collect())


def passes(spark, df, run):
    """How often a table of one partition is read."""
    count = spark.sparkContext.accumulator(0)

    def watched(batches):
        count.add(1)
        yield from batches

    table = df.coalesce(1).mapInArrow(watched, df.schema)
    out = run(table)
    return count.value, out


def test_scans_share_a_pass(spark, monkeypatch):
    df = mixed(spark)
    shared, got = passes(spark, df, cf.scan_all)
    monkeypatch.setattr(module, "fit_state", lambda df: 1 / 0)
    alone, want = passes(spark, df, cf.scan_all)
    assert shared <= alone - 3
    for task in module.TASKS:
        assert got[task].error is None and rows(got[task].report) == rows(want[task].report), task


def test_a_failing_scan_stops_no_other(spark, monkeypatch):
    monkeypatch.setattr(module, "outlier_report", lambda df, quantiles: 1 / 0)
    df = mixed(spark)
    out = cf.scan_all(df)
    assert out["outliers"].error and all(out[t].error is None for t in module.TASKS if t != "outliers")
    assert remembered_state(df) is None


def test_states_of_parts_merge(spark):
    df = mixed(spark)
    whole, first, rest = cf.fit_state(df), cf.fit_state(df.filter("id < 90")), cf.fit_state(df.filter("id >= 90"))
    empty = cf.fit_state(df.limit(0))
    for state in (first.merge(rest), rest.merge(first), whole.merge(empty), empty.merge(whole)):
        for c, want in whole.columns.items():
            got = state.columns[c]
            assert (got.n_rows, got.missing, got.disguised, got.numeric_texts, got.min, got.max, got.zeros, got.negatives) == (
                want.n_rows, want.missing, want.disguised, want.numeric_texts, want.min, want.max, want.zeros, want.negatives)
            assert (got.mean, got.std) == (pytest.approx(want.mean), pytest.approx(want.std))
            assert got.skew_pop == pytest.approx(want.skew_pop, nan_ok=True)
    with pytest.raises(ValueError):
        whole.merge(cf.fit_state(df.drop("x")))


def test_state_equals_the_scans_own_pass(spark):
    df = mixed(spark).withColumn("far", F.when(F.col("id") == 3, math.inf).otherwise(F.col("id").cast("double")))
    alone = [rows(f(df)) for f in (cf.columns_report, cf.missing_report, cf.skewness_report, cf.outlier_report)]
    with cf.remembered(df, cf.fit_state(df)):
        assert remembered_state(df) is not None and remembered_state(df.select("*")) is None
        shared = [rows(f(df)) for f in (cf.columns_report, cf.missing_report, cf.skewness_report, cf.outlier_report)]
    assert str(shared) == str(alone)


def test_a_written_fix_tells_its_effect_without_another_pass(spark, tmp_path):
    df = mixed(spark)
    fit = cf.fit_missing(df, {"x": {"method": "fill_mean"}, "t": {"method": "drop_rows"}, "nothing": {"method": "drop_column"}})
    want = cf.fix_effect(df, fit.apply(df)).first().asDict()
    measures = {"total": lambda t: F.sum("x"), "gone": lambda t: F.count("nothing"), "first": lambda t: F.min("money")}
    read, row = passes(spark, df, lambda t: cf.write_fixed(t, fit, str(tmp_path / "out"), measures=measures).first().asDict())
    assert read == 1 and {k: row[k] for k in want} == want and want["rows_removed"] > 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == row["n_rows_after"]
    assert row["total_before"] < row["total_after"] or row["rows_removed"] and (row["gone_before"], row["gone_after"], row["first_before"]) == (0, None, "$0")
    again = cf.write_fixed(df, lambda t: cf.drop_duplicate_rows(t.select("flag")), str(tmp_path / "csv"), fmt="csv").first()
    assert (again["n_rows_before"], again["n_rows_after"]) == (300, 2)
    nothing = cf.write_fixed(df.limit(0), fit, str(tmp_path / "none")).first()
    assert (nothing["n_rows_before"], nothing["n_rows_after"], nothing["missing_cells_before"]) == (0, 0, 0)
