"""Statistics, outliers, correlation, transforms and scaling against pandas and NumPy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import cleanframe as cf
from cleanframe.functions.chi2 import chi2_quantile
from cleanframe.operators.multivariate import SingularCovariance
from cleanframe.plans import gram, stats
from cleanframe.plans.ranks import Wanted, ranked_values

RNG = np.random.default_rng(7)


def skewed(n=4000):
    hot = np.full(n // 3, 5.0)  # one value holds a third of the rows
    return np.concatenate([hot, RNG.lognormal(2, 1, n - len(hot))])


@pytest.mark.parametrize("limit", [10, 300, 10**6])
def test_exact_quantiles_at_any_map_limit(spark, monkeypatch, limit):
    monkeypatch.setattr(stats, "MAP_LIMIT", limit)
    pdf = pd.DataFrame({"a": skewed(), "b": RNG.integers(0, 9, 4000).astype(float), "c": RNG.normal(0, 1, 4000), "d": np.arange(4000)})
    pdf.loc[::7, "c"] = np.nan
    df = spark.createDataFrame(pdf).repartition(3)
    probs = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = stats.numeric_stats(df, list(pdf), probs=probs)
    for c in pdf:
        assert [got[c].quantiles[p] for p in probs] == pytest.approx(pdf[c].quantile(list(probs)).tolist(), rel=1e-12)


def test_sketch_that_misses_falls_back_to_bisection(spark, monkeypatch):
    monkeypatch.setattr(stats, "MAP_LIMIT", 50)
    monkeypatch.setattr(stats, "SKETCH_K", 8)
    monkeypatch.setattr(stats, "SKETCH_MARGIN", 0.0)
    pdf = pd.DataFrame({"a": skewed()})
    got = stats.numeric_stats(spark.createDataFrame(pdf), ["a"], probs=(0.25, 0.5, 0.75))["a"]
    assert [got.q1, got.median, got.q3] == pytest.approx(pdf["a"].quantile([0.25, 0.5, 0.75]).tolist())


def test_infinity_does_not_hang(spark, monkeypatch):
    monkeypatch.setattr(stats, "MAP_LIMIT", 10)
    df = spark.createDataFrame([(float(i),) for i in range(50)] + [(math.inf,)], "x double")
    assert stats.numeric_stats(df, ["x"], probs=(0.5,))["x"].median == 25.0


@pytest.mark.parametrize("rows", [[], [(None,)], [(math.nan,)], [(4.0,)], [(4.0,), (4.0,), (4.0,), (4.0,), (4.0,)]])
def test_degenerate_tables(spark, rows):
    df = spark.createDataFrame(rows, "x double")
    for report in (cf.numeric_describe, cf.outlier_report, cf.skewness_report, cf.scaling_report, cf.min_max, cf.status,
                   cf.missing_report, cf.missing_summary, cf.duplicate_count, cf.correlation_matrix, cf.type_findings,
                   cf.columns_report, cf.column_info, cf.date_range_report, cf.fill_options, cf.correlated_missing):
        report(df).collect()
    for fixed in (cf.fix_outliers(df, {"x": "cap_iqr"}), cf.fix_outliers(df, {"x": "cap_zscore"}), cf.fix_scale(df, {"x": "robust"}),
                  cf.fix_scale(df, {"x": "zscore"}), cf.fix_skew(df, {"x": "yeojohnson"}), cf.fix_missing(df, {"x": {"method": "fill_mode"}})):
        assert fixed.df.count() == len(rows)


def test_no_rows_give_no_percentage(spark):
    df = spark.createDataFrame([], "x double")
    assert cf.duplicate_count(df).first()["duplicate_pct"] is None
    assert cf.missing_summary(df).first()["missing_pct"] is None


def test_constant_column_is_no_outlier_and_unscaled(spark):
    df = spark.createDataFrame([(4.0,)] * 6, "x double")
    row = cf.outlier_report(df).first()
    assert (row["zscore_outliers"], row["iqr_outliers"]) == (0, 0)
    assert cf.fix_scale(df, {"x": "minmax"}).df.distinct().first()["x"] == 4.0
    assert cf.fix_scale(df, {"x": "robust"}).df.distinct().first()["x"] == 0.0


def test_skewness_matches_pandas(spark):
    pdf = pd.DataFrame({"a": skewed(), "b": RNG.normal(0, 1, 4000)})
    pdf.loc[::5, "b"] = np.nan
    got = {r["column"]: r["skewness"] for r in cf.skewness(spark.createDataFrame(pdf)).collect()}
    assert got == pytest.approx(pdf.skew().to_dict())


def test_outlier_plan_order_matters(spark):
    pdf = pd.DataFrame({"a": [1.0, 2, 3, 4, 100], "b": [1.0, 2, 3, 4, 500]})
    df = spark.createDataFrame(pdf)
    after = cf.fix_outliers(df, {"a": "remove", "b": "cap_iqr"}).df.toPandas()
    assert sorted(after["b"]) == [1, 2, 3, 4]  # the removal took b's extreme with it
    before = cf.fix_outliers(df, {"b": "cap_iqr", "a": "remove"}).df.toPandas()
    assert len(before) == 4


def test_mahalanobis_matches_numpy(spark):
    x = RNG.normal(0, 1, (500, 4)) @ RNG.normal(0, 1, (4, 4)) * [1, 10, 1000, 1e-3]
    pdf = pd.DataFrame(x, columns=list("abcd"))
    pdf.loc[3, "b"] = np.nan
    df = spark.createDataFrame(pdf)
    fit = cf.fit_mahalanobis(df)
    full = pdf.dropna().to_numpy()
    d = full - full.mean(axis=0)
    want = np.sqrt(np.einsum("ij,jk,ik->i", d, np.linalg.inv(np.cov(full.T)), d))
    got = [r["d"] for r in df.select(fit.distance.alias("d")).filter("d is not null").collect()]
    assert sorted(got) == pytest.approx(sorted(want), rel=1e-8)
    assert fit.apply(df).filter(F.col("__multivariate_outlier__")).count() == int((want > fit.cutoff).sum())
    assert fit.apply(df, "drop").count() == 500 - int((want > fit.cutoff).sum())


def test_singular_covariance_is_refused(spark):
    df = spark.createDataFrame([(float(i), 3.0 * i, float(i * i % 7)) for i in range(20)], "a double, b double, c double")
    with pytest.raises(SingularCovariance):
        cf.fit_mahalanobis(df)
    with pytest.raises(ValueError):
        cf.fit_mahalanobis(df, ["a"])


@pytest.mark.parametrize("k", [30, 400])
def test_mahalanobis_of_wide_tables(spark, k):
    mixing = RNG.normal(size=(k, k)) / k + np.eye(k)
    values = RNG.normal(size=(3 * k, k)) @ mixing * np.logspace(-3, 3, k)
    values[5] *= 4
    pdf = pd.DataFrame(values, columns=[f"c{i}" for i in range(k)])
    pdf.iloc[2, 1] = np.nan
    df = spark.createDataFrame(pdf.reset_index())
    names = list(pdf)
    full = pdf.dropna()
    fit = cf.fit_mahalanobis(df, names)
    centred = (full - full.mean()).to_numpy()
    want = np.sqrt(np.einsum("ij,ij->i", centred @ np.linalg.inv(np.cov(full.to_numpy().T)), centred))
    got = {r["index"]: r["d"] for r in df.select("index", fit.distance.alias("d")).collect()}
    assert [got[i] for i in full.index] == pytest.approx(want.tolist(), rel=1e-6) and got[2] is None
    report = cf.mahalanobis_report(df, fit).first()
    assert (report["rows_analysed"], report["rows_incomplete"], report["outliers"]) == (len(full), 1, int((want > fit.cutoff).sum()))
    assert fit.apply(df, "drop").count() == len(pdf) - report["outliers"] and report["outliers"] >= 1
    assert cf.mahalanobis_samples(df, fit, ["index"], 1).first()["index"] == 5


def test_ranks_of_many_distinct_integers(spark):
    """100,000 distinct integers, a hot one among them, in many partitions: ranks come from counts, no task holds a column's values."""
    hot = F.when(F.col("id") % 3 == 0, 777).otherwise((F.col("id") * 7919) % 100_000)
    df = spark.range(0, 400_000, 1, 200).select(hot.alias("x"), (hot / 7).alias("y"), (-hot * 1e300).alias("z"))
    pdf, probs = df.toPandas(), (0.0, 0.1, 0.25, 0.5, 0.777, 0.999, 1.0)
    got = stats.numeric_stats(df, ["x", "y", "z"], probs=probs)
    for c in pdf:
        assert [got[c].quantiles[p] for p in probs] == pytest.approx(pdf[c].quantile(list(probs)).tolist(), rel=1e-12)


def test_ranked_values_of_any_range(spark):
    values = [-math.inf, -1.5, -1.5, -0.0, 0.0, 3.0, 8e307, 1.7e308, math.inf]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
    wanted = [Wanted("x", -math.inf, math.inf, tuple(range(9))), Wanted("x", -2.0, 3.0, (0, 4)), Wanted("x", 3.0, 3.0, (0,))]
    got = ranked_values(df, wanted)
    assert [got[(0, r)] for r in range(9)] == values
    assert (got[(1, 0)], got[(1, 4)], got[(2, 0)]) == (-1.5, 3.0, 3.0)
    assert ranked_values(df, []) == {}


def test_quantiles_beyond_all_rounds(spark, monkeypatch):
    monkeypatch.setattr(stats, "MAP_LIMIT", 10)
    monkeypatch.setattr(stats, "MAX_ROUNDS", 0)
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    assert stats.numeric_stats(df, ["x"], probs=(0.25, 0.5))["x"].quantiles == {0.25: 249.75, 0.5: 499.5}


@pytest.mark.parametrize("p, k, value", [(0.975, 2, 7.3778), (0.975, 3, 9.3484), (0.95, 1, 3.8415), (0.99, 10, 23.2093)])
def test_chi2_quantile(p, k, value):
    assert chi2_quantile(p, k) == pytest.approx(value, abs=1e-4)


@pytest.mark.parametrize("narrow", [0, 10])
def test_correlation_pairwise_complete(spark, monkeypatch, narrow):
    monkeypatch.setattr(gram, "NARROW", narrow)
    x = RNG.normal(1e6, 1, (300, 5)) @ RNG.normal(0, 1, (5, 5))
    pdf = pd.DataFrame(x, columns=list("abcde"))
    pdf["k"] = 4.0
    if not narrow:
        pdf = pdf.mask(RNG.random(pdf.shape) < 0.2)
    want = pdf.corr()
    for r in cf.correlation_matrix(spark.createDataFrame(pdf).repartition(5)).collect():
        w = want.loc[r["col_a"], r["col_b"]]
        assert (r["correlation"] is None and np.isnan(w)) or r["correlation"] == pytest.approx(w, abs=1e-7)


def _dense(score, grid):
    return grid[int(np.argmax([score(g) for g in grid]))]


def test_boxcox_power_matches_dense_grid(spark):
    x = RNG.gamma(2.0, 3.0, 3000) + 0.01
    lx = np.log(x)
    want = _dense(lambda p: -np.log(np.var((x**p - 1) / p)) / 2 + (p - 1) * lx.mean(), np.arange(0.1, 0.9, 1e-4) + 1e-9)
    fit = cf.fit_transform(spark.createDataFrame(pd.DataFrame({"x": x})), {"x": "boxcox"})
    assert fit.steps[0][2] == pytest.approx(want, abs=2e-4)
    assert abs(cf.skewness(fit.apply(spark.createDataFrame(pd.DataFrame({"x": x})))).first()["skewness"]) < 0.1


def test_power_outside_the_first_interval(spark):
    x = np.exp(RNG.normal(0, 1, 2000) * 0.05) ** (1 / 8.0)
    y = (x - 0.5) ** 0.1
    fit = cf.fit_transform(spark.createDataFrame(pd.DataFrame({"x": y})), {"x": "boxcox"})
    grid = np.arange(-5, 40, 0.05) + 1e-9
    want = _dense(lambda p: -np.log(np.var((y**p - 1) / p)) / 2 + (p - 1) * np.log(y).mean(), grid)
    assert fit.steps[0][2] == pytest.approx(want, abs=0.1)


def test_yeojohnson_power_matches_dense_grid(spark):
    x = RNG.normal(1, 2, 3000) ** 3

    def score(p):
        y = np.where(x >= 0, ((np.maximum(x, 0) + 1) ** p - 1) / p, -((1 - np.minimum(x, 0)) ** (2 - p) - 1) / (2 - p))
        return -np.log(y.var()) / 2 + (p - 1) * (np.sign(x) * np.log1p(np.abs(x))).mean()

    fit = cf.fit_transform(spark.createDataFrame(pd.DataFrame({"x": x})), {"x": "yeojohnson"})
    assert fit.steps[0][2] == pytest.approx(_dense(score, np.arange(0.2, 1.8, 2e-4) + 1e-9), abs=3e-4)


def test_transform_refusals(spark):
    df = spark.createDataFrame([(0.0, -1.0, "t"), (1.0, 2.0, "t"), (5.0, 3.0, "t")], "zero double, neg double, text string")
    result = cf.fix_skew(df, {"zero": "log", "neg": "sqrt", "text": "log", "gone": "log"})
    assert len(result.errors) == 4 and not result.success and result.df.collect() == df.collect()


def test_minmax_lands_in_unit_interval(spark):
    df = spark.createDataFrame(pd.DataFrame({"x": skewed()}))
    row = cf.min_max(cf.fix_scale(df, {"x": "minmax"}).df).first()
    assert (row["min"], row["max"]) == (0.0, 1.0)


def test_scan_jobs_do_not_grow_with_columns(spark):
    def jobs(width: int) -> int:
        df = spark.range(50).select(*[(F.col("id") * i).cast("double").alias(f"c{i}") for i in range(1, width + 1)])
        group = f"width{width}"
        spark.sparkContext.setJobGroup(group, group)
        cf.outlier_report(df).collect()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(8) <= jobs(2) + 1
