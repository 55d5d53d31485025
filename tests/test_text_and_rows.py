"""Text, types, missing cells, duplicates, validation and versions on small tables with awkward content."""

import math
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

import cleanframe as cf
from cleanframe import Rule
from cleanframe.functions.text import clean_name, strip, titlecase
from cleanframe.functions.types import name_matches
from cleanframe.operators import duplicates
from cleanframe.operators.dates import shape, spark_format

AWKWARD = ["jean-luc o'neil x2y", " NBSP　", "ÉCOLE d'été", "  ", "", "tab\t", "\x1cfs\x1f", "naïve_99 $5", "中文a b", "ǆ ß"]


def test_strip_and_title_follow_python(spark):
    df = spark.createDataFrame([(v,) for v in AWKWARD], "v string")
    got = df.select("v", strip(F.col("v")).alias("s"), titlecase(F.col("v")).alias("t")).collect()
    for r in got:
        assert r["s"] == r["v"].strip()
        if not any(ch in r["v"] for ch in "ǆß"):  # letters whose capital is two letters
            assert r["t"] == r["v"].title()


def test_text_methods_follow_python(spark):
    import re

    df = spark.createDataFrame([(v,) for v in [*AWKWARD, None]], "v string")
    special = cf.clean_text(df, {"v": "remove_special"}).df
    assert [r["v"] for r in special.collect()] == [None if v is None else re.sub(r"[^\w\s]", "", v.strip()).strip() for v in [*AWKWARD, None]]


@pytest.mark.parametrize("raw, clean", [("  Age  ", "age"), ("First Name", "first_name"), ("Price ($)", "price"), ("_price_", "price"), ("FirstName", "firstname"), ("a--b  c", "a_b_c")])
def test_clean_name(raw, clean):
    assert clean_name(raw) == clean


def test_colliding_names_are_refused(spark):
    df = spark.createDataFrame([(1, 2)], "`A b` int, a_b int")
    result = cf.rename_clean(df)
    assert result.errors and result.df.columns == ["A b", "a_b"]
    assert cf.rename_columns(df, {"A b": "a_b"}).errors


def test_names_with_dots_and_backticks(spark):
    df = spark.createDataFrame([(1.0, "x "), (2.0, None), (9.0, "y")], "`a.b` double, `c``d` string")
    cf.outlier_report(df).collect()
    cf.missing_report(df).collect()
    cf.numeric_describe(df).collect()
    cf.categorical_describe(df).collect()
    assert cf.clean_text(df, {"c`d": "trim"}).df.collect()[0][1] == "x"
    assert cf.fix_missing(df, {"c`d": {"method": "drop_rows"}}).df.count() == 2


def test_keyword_match():
    assert name_matches("page", ("age",)) and not name_matches("page", ("age",), "token") and name_matches("user_age", ("age",), "token")


def test_casts(spark):
    df = spark.createDataFrame([("1", "yes", "1.5"), ("x", "No ", "2"), (None, "maybe", None)], "i string, b string, f string")
    strict = cf.cast_columns(df, {"i": "int64", "b": "bool", "f": "float64", "zz": "bool"})
    assert len(strict.errors) == 2 and dict(strict.df.dtypes) == {"i": "string", "b": "boolean", "f": "double"}
    assert [r["b"] for r in strict.df.collect()] == [True, False, None]
    assert [r["i"] for r in cf.cast_columns(df, {"i": "int64"}, mode="try").df.collect()] == [1, None, None]


def test_disguised_missing(spark):
    tokens = ["N/A", " na ", "n.a.", "N.A", "None", "NULL", "missing", "Unknown", "-", "--", "---", "?", "??", "", "not available", "Not Applicable"]
    df = spark.createDataFrame([(t,) for t in [*tokens, "nan", "real", None]], "v string")
    assert cf.disguised_report(df).first()["disguised"] == len(tokens)
    assert cf.missing_summary(df).first()["missing_cells"] == len(tokens) + 1
    assert cf.missing_summary(df, replace_disguised=False).first()["missing_cells"] == 1


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(math.nan,), (1.0,), (3.0,)], "x double")
    assert cf.missing_report(df).first()["missing_count"] == 1
    assert cf.fix_missing(df, {"x": {"method": "fill_mean"}}).df.agg(F.max("x")).first()[0] == 3.0


def test_mode_takes_the_smallest_on_a_tie(spark):
    df = spark.createDataFrame([(10, 10.0, "b"), (9, 9.0, "a"), (10, 10.0, "b"), (9, 9.0, "a"), (7, 7.0, "c")], "i bigint, d double, s string")
    assert cf.mode_values(df, ["i", "d", "s"]) == {"i": "9", "d": "9.0", "s": "a"}


def test_fills_run_before_row_drops(spark):
    df = spark.createDataFrame([(1.0, None), (None, "x"), (5.0, "y")], "a double, b string")
    out = cf.fix_missing(df, {"b": {"method": "drop_rows"}, "a": {"method": "fill_mean"}}).df
    assert sorted(r["a"] for r in out.collect()) == [3.0, 5.0]


def test_fill_then_scan_reports_nothing(spark):
    df = spark.createDataFrame([(1, None, "n/a"), (None, 2.0, "x"), (3, 4.0, None)], "a int, b double, c string")
    fixed = cf.fix_missing(df, {c: {"method": "fill_mode"} for c in df.columns}).df
    assert cf.missing_report(fixed).count() == 0 and fixed.dtypes == df.dtypes


def test_correlated_missing_on_a_wide_table(spark):
    wide = spark.range(40).select(*[F.when(F.col("id") % 4 != 0, F.col("id")).alias(f"c{i}") for i in range(30)])
    pairs = cf.correlated_missing(wide)
    assert pairs.count() == 30 * 29 // 2 and pairs.filter("shared_rows <> 10").count() == 0


def test_duplicates_see_null_as_equal_and_columns_apart(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), (None, "a"), ("x", "y")], "p string, q string")
    assert cf.duplicate_count(df).first()["duplicate_count"] == 1
    assert cf.drop_duplicate_rows(df, "keep_first").df.count() == 3
    assert sorted(map(tuple, cf.drop_duplicate_rows(df, "drop_all").df.collect()), key=str) == [("a", None), ("x", "y")]


def test_duplicates_beyond_the_broadcast_limit(spark, monkeypatch):
    df = spark.range(300).select((F.col("id") % 100).alias("a"), F.lit(-0.0).alias("z"))
    both = df.union(df.select("a", F.lit(0.0).alias("z")))
    near = cf.duplicate_count(both).first()
    monkeypatch.setattr(duplicates, "BROADCAST_KEYS", 1)
    assert cf.duplicate_count(both).first() == near and near["duplicate_count"] == 500


def test_duplicates_with_map_and_array_columns(spark):
    df = spark.sql("select array(1, 2) as a, map('k', 1) as m union all select array(1, 2), map('k', 1)")
    assert cf.duplicate_count(df).first()["duplicate_count"] == 1


def test_subset_needs_an_order_and_known_columns(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert cf.drop_duplicate_rows(df, "keep_first", ["a"]).errors
    with pytest.raises(ValueError):
        cf.drop_duplicate_rows(df, "keep_first", ["nope"])


def test_results_do_not_depend_on_partitioning(spark):
    df = spark.range(2000).select((F.col("id") % 50).alias("k"), (F.col("id") * 7 % 31).alias("t"), F.col("id").alias("v"))
    runs = []
    for n in (1, 7):
        d = df.repartition(n)
        first = cf.drop_duplicate_rows(d, "keep_first", ["k"], ["t"]).df
        last = cf.drop_duplicate_rows(d, "keep_last", ["k"], ["t"]).df
        runs.append([sorted(map(tuple, x.collect())) for x in (first, last, cf.categorical_summary(d.select(F.col("t").cast("string").alias("t"))))])
    assert runs[0] == runs[1]


def test_hot_key_is_limited_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    plan = cf.drop_duplicate_rows(df, "keep_first", ["k"], ["v"]).df._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan


def test_no_python_or_cartesian_in_core_plans(spark):
    df = spark.createDataFrame([(1, 1.0, "a "), (2, None, "A")], "id int, x double, s string")
    frames = [cf.missing_report(df), cf.outlier_report(df), cf.text_value_report(df), cf.duplicate_count(df), cf.variant_groups(df),
              cf.harmonise(df).df, cf.fix_missing(df, {"x": {"method": "fill_mean"}}).df, cf.type_findings(df)]
    for f in frames:
        plan = f._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_harmonise_tie_and_unknown_column(spark):
    df = spark.createDataFrame([("b",), ("B",), ("c",), ("C",), ("c",)], "s string")
    mapping = {r["variant"]: r["canonical"] for r in cf.harmonise_mapping(df).collect()}
    assert mapping == {"b": "B", "C": "c"}
    assert cf.mapping_effect(df, "s", mapping) == {"before": 4, "after": 2, "reduced_by": 2}
    with pytest.raises(ValueError):
        cf.harmonise(df, ["nope"])


def test_high_cardinality_text_is_not_harmonised(spark):
    df = spark.range(120).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("s")).union(spark.createDataFrame([("V1",)], "s string"))
    assert cf.harmonise_mapping(df).count() == 0


def test_strftime_translation_and_shape():
    assert spark_format("%d/%m/%Y") == "dd/MM/yyyy" and spark_format("%Y-%m-%dT%H:%M") == "yyyy-MM-dd'T'HH:mm"
    assert shape("yyyy-MM-dd'T'HH") == r"^[+-]?[0-9]{4,}\-(0[1-9]|1[0-2])\-(0[1-9]|[12][0-9]|3[01])T([01][0-9]|2[0-3])$"
    with pytest.raises(ValueError):
        spark_format("%Q")


def test_date_parsing_matches_pandas(spark):
    values = ["2024-02-29", "2023-02-29", "2024-13-01", "05/06/2024", None, "x", "2024-1-5"]
    df = spark.createDataFrame([(v,) for v in values], "d string")
    got = [r["d"] for r in cf.parse_dates(df, ["d"], "%Y-%m-%d").df.collect()]
    want = pd.to_datetime(pd.Series(values[:6]), format="%Y-%m-%d", errors="coerce")
    assert got[:6] == [None if pd.isna(w) else w.to_pydatetime() for w in want]
    times = spark.createDataFrame([("31/12/2023 23:59:58",), ("31/12/2023",)], "d string")
    assert [str(r["d"]) for r in cf.parse_dates(times, ["d"], "%d/%m/%Y %H:%M:%S").df.collect()] == ["2023-12-31 23:59:58", "None"]


def test_rule_errors_and_fixes(spark):
    df = spark.createDataFrame([(200, "a"), (30, None), (None, "c")], "age int, s string")
    report, errors = cf.run_rules(df, [Rule("age", "custom_range", {"min": 0, "max": 150}), Rule("s", "percentage"), Rule("age", "custom_range"), Rule("age", "odd")])
    assert report.first()["violations"] == 1 and len(errors) == 3
    assert cf.fix_violations(df, Rule("age", "custom_range", {"max": 150}), "drop_rows").df.count() == 2
    assert cf.fix_violations(df, Rule("s", "no_nulls"), "drop_rows").df.count() == 2
    assert not cf.fix_violations(df, Rule("age", "no_negative"), "replace").success


def test_nan_breaks_no_rule(spark):
    df = spark.createDataFrame([(1, math.nan), (2, 500.0)], "id int, pct double")
    assert cf.run_rules(df, [Rule("pct", "percentage")])[0].first()["violations"] == 1
    assert [r["id"] for r in cf.violating_rows(df, [Rule("pct", "percentage")], ["id"]).collect()] == [2]


def test_rule_samples_push_down(spark, tmp_path):
    spark.range(10).select("id", F.col("id").cast("double").alias("x")).write.parquet(str(tmp_path / "t"))
    plan = cf.rule_samples(spark.read.parquet(str(tmp_path / "t")), [Rule("x", "no_negative")], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(x,0.0)" in plan


def test_custom_patterns(spark):
    df = spark.createDataFrame([("EMP-12345",), ("EMP-12345x",), ("emp-1",), (None,)], "v string")
    row = cf.check_pattern(df, "v", "custom", r"(?P<p>EMP)-\d{5}").first()
    assert (row["values_checked"], row["violations"]) == (3, 1)
    with pytest.raises(ValueError):
        cf.check_pattern(df, "v", "custom", "(")
    with pytest.raises(ValueError):
        cf.check_pattern(df, "v", "nope")
    empty = cf.check_pattern(df.limit(0), "v", "email").first()
    assert empty["pass_rate"] == 100.0 and empty["passed"]


def test_scan_all_isolates_failures(spark, monkeypatch):
    from cleanframe.plans import scan_all as module

    def broken(df):
        raise RuntimeError("no")

    monkeypatch.setattr(module, "columns_report", broken)
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, s string")
    outcome = cf.scan_all(df)
    assert outcome["columns"].error == "no" and outcome["missing"].report.count() == 1
    rows = {r["task"]: (r["signal"], r["has_issue"]) for r in cf.issue_report(df).collect()}
    assert rows["columns"] == (None, True) and rows["missing"] == (1, True) and rows["duplicates"] == (0, False)


def test_csv_rules(spark, tmp_path):
    text = 'id,name,score,flag,note\n1,"a ""q"", b",1.5,True,x\n2,short\n3,c,NA,false,y,extra\n4,,2,true,null\n'
    (tmp_path / "t.csv").write_text(text)
    df = cf.load(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "score": "double", "flag": "boolean", "note": "string"}
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, 'a "q", b', 1.5, True, "x"), (2, "short", None, None, None), (4, None, 2.0, True, None)]


def test_tsv_refuses_long_rows(spark, tmp_path):
    (tmp_path / "good.tsv").write_text("a\tb\n1\t2\n")
    assert cf.load(spark, str(tmp_path / "good.tsv")).collect()[0]["b"] == 2
    (tmp_path / "bad.tsv").write_text("a\tb\n1\t2\t3\n")
    with pytest.raises(Exception):
        cf.load(spark, str(tmp_path / "bad.tsv")).collect()


@pytest.mark.parametrize("text", [
    '[{"a": 1, "b": "x"}, {"a": 2, "b": null}]', '[\n {"a": 1, "b": "x"},\n {"a": 2}\n]', '{"a": 1, "b": "x"}\n{"a": 2}\n',
])
def test_json_shapes(spark, tmp_path, text):
    (tmp_path / "t.json").write_text(text)
    df = cf.load(spark, str(tmp_path / "t.json"))
    assert sorted((r["a"], r["b"]) for r in df.collect()) == [(1, "x"), (2, None)]


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        cf.load(spark, "/nowhere/t.xyz")


def test_version_history(spark, tmp_path):
    history = cf.VersionHistory(spark, str(tmp_path / "h"), depth=3)
    assert history.list().count() == 0
    for i in range(1, 6):
        history.save(f"step {i}", spark.range(i))
    assert [r["version"] for r in history.list().collect()] == [5, 4, 3] and history.latest().first()["label"] == "step 5"
    assert not (tmp_path / "h" / "v=1").exists()
    assert history.restore(4).count() == 4
    assert [r["version"] for r in history.list().collect()] == [4, 3]
    with pytest.raises(ValueError):
        history.restore(5)
    assert history.save("again", spark.range(9)) == 6
    history.clear()
    assert history.list().count() == 0


def test_fitted_fixes_on_a_stream(spark, tmp_path):
    batch = spark.createDataFrame([(1.0, "n/a"), (2.0, "x"), (3.0, "x"), (4.0, "y"), (900.0, None)], "v double, s string")
    batch.write.parquet(str(tmp_path / "in"))
    fits = [cf.fit_missing(batch, {"s": {"method": "fill_mode"}}), cf.fit_outlier_fix(batch, {"v": "cap_iqr"}), cf.fit_scale(batch, {"v": "minmax"})]
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = cf.apply_fits(stream, *fits).writeStream.format("memory").queryName("fixed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("fixed").collect())) == sorted(map(tuple, cf.apply_fits(batch, *fits).collect()))
    with pytest.raises(TypeError):
        cf.apply_fits(stream, object())


def test_long_texts_are_told_apart_by_digest(spark):
    from cleanframe.plans.fused import exact_distinct

    base = "x" * 5000
    df = spark.createDataFrame([(base + "a",), (base + "b",), (base + "b",), ("short",), (None,)], "code string")
    assert exact_distinct(df, ["code"]) == {"code": 3}
    assert cf.identity_duplicates(df).first()["dup_count"] == 1


def test_dates_do_not_pass_through_the_session_zone(spark):
    texts = ["2024-03-10 02:30:00", "2024-11-03 01:30:00", "1883-11-18 12:00:00", "0001-01-01 00:00:00"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = cf.parse_dates(df, ["t"]).df.select(F.col("t").cast("string")).collect()
        assert [r["t"] for r in got] == texts
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize(("text", "want"), [
    ("2024-01-05 10:00:00.123", "2024-01-05 10:00:00.123"), ("2024-01-05T10:00:00Z", "2024-01-05 10:00:00"), ("2024-01-05T10:00:00.5+02:00", "2024-01-05 08:00:00.5"),
    ("January 5, 2024", "2024-01-05 00:00:00"), ("5-Jan-2024", "2024-01-05 00:00:00"), ("2024-01-05 10:00", "2024-01-05 10:00:00"), ("5 May 2024", "2024-05-05 00:00:00"),
])
def test_date_texts_users_have(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert cf.parse_dates(df, ["t"]).df.select(F.col("t").cast("string")).first()[0] == want


def test_wide_tables(spark):
    wide = spark.range(3).select(*[F.when(F.col("id") != i % 4, F.col("id")).alias(f"c{i}") for i in range(1000)])
    assert tuple(cf.status(wide).first()) == (3, 1000, 750)
    row = cf.missing_summary(wide).first()
    assert (row["missing_cells"], row["rows_with_missing"], row["clean_columns"]) == (750, 3, 250)


def test_infinities_flag_and_change_nothing_wrongly(spark):
    values = [float(i) for i in range(20)] + [float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = cf.outlier_report(df).first()
    assert row["zscore_outliers"] == 0 and row["iqr_outliers"] == 1
    assert [r[0] for r in cf.fix_outliers(df, {"v": "cap_zscore"}).df.collect()] == values
    skew = cf.skewness_report(df).first()
    assert (skew["skewness"], skew["direction"]) == (0.0, "none")
    assert cf.fix_scale(df, {"v": "zscore"}).errors and cf.fix_skew(df, {"v": "yeojohnson"}).errors
    mostly = spark.createDataFrame([(float("inf"),)] * 5 + [(1.0,)], "v double")
    assert cf.outlier_report(mostly).first()["iqr_outliers"] == 0


def test_brackets_with_infinities(spark, monkeypatch):
    import numpy as np

    from cleanframe.plans import stats as module

    monkeypatch.setattr(module, "MAP_LIMIT", 50)
    values = [float("-inf")] * 30 + [i * 0.5 for i in range(5000)] + [float("inf")] * 900
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    got = module.numeric_stats(df, ["v"], probs=(0.001, 0.25, 0.5, 0.75, 0.99))["v"].quantiles
    want = {p: float(np.sort(values)[int(round((len(values) - 1) * p))]) for p in (0.001, 0.99)}
    finite = sorted(values)
    for p in (0.25, 0.5, 0.75):
        at = (len(values) - 1) * p
        low, share = int(at), at - int(at)
        want[p] = finite[low] + (finite[low + 1] - finite[low]) * share
    assert got == pytest.approx(want)


def test_smaller_edges(spark):
    df = spark.createDataFrame([(30, -(2**31)), (30, 1995)], "age int, born int")
    assert cf.cross_column_report(df, "age_matches_birth_year", "age", "born", as_of_year=2025).first()["violations"] == 1
    dates = spark.sql("select date'2024-01-01' as d")
    assert cf.date_range_report(dates, max_year=9999).count() == 0
    fixed = cf.fix_violations(df, cf.Rule("age", "no_negative"), "replace", "none")
    assert fixed.errors and fixed.df.count() == 2
    nested = spark.createDataFrame([(1, 2)], "a int, b int")
    assert cf.correlated_missing(nested).count() == 0


def test_a_one_row_json_object_keeps_its_arrays(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"vec":[1,2,3],"tags":["a"]}\n')
    assert cf.load(spark, str(tmp_path / "a.json")).count() == 1
    (tmp_path / "b.json").write_text('{\n"a": {"0": 1}}\n')
    with pytest.raises(ValueError):
        cf.load(spark, str(tmp_path / "b.json"))


def test_rows_with_maps_are_deduplicated(spark):
    df = spark.sql("select * from values (1, map('a', 1, 'b', 2)), (1, map('b', 2, 'a', 1)), (2, map('a', 1)) as t(id, m)")
    assert cf.drop_duplicate_rows(df).df.count() == 2
    assert cf.drop_duplicate_rows(df, "drop_all").df.collect()[0]["m"] == {"a": 1}


def test_drop_all_over_a_subset_moves_only_suspects(spark, monkeypatch):
    from cleanframe.operators import duplicates as module

    df = spark.createDataFrame([(1, 0.0, "a"), (1, -0.0, "b"), (2, 0.0, "c"), (None, 1.0, "d"), (None, 1.0, "e"), (3, float("nan"), "f")], "id int, v double, t string")
    for limit in (10, 0):
        monkeypatch.setattr(module, "BROADCAST_KEYS", limit)
        out = cf.drop_duplicate_rows(df, "drop_all", ["id", "v"]).df
        assert sorted(r["t"] for r in out.collect()) == ["c", "f"]


def test_mapping_ways_agree(spark, monkeypatch):
    from cleanframe.operators import categories as module

    df = spark.createDataFrame([("a",), ("b",), (None,), ("z",)], "c string")
    pairs = spark.createDataFrame([("a", "2"), ("a", "1"), ("b", "3"), (None, "9")], "variant string, canonical string")
    for limit in (10, 0):
        monkeypatch.setattr(module, "BROADCAST_PAIRS", limit)
        assert sorted(str(r["c"]) for r in cf.apply_mapping(df, "c", pairs).collect()) == ["1", "3", "None", "z"]


def test_a_date_column_of_no_known_format_is_refused(spark):
    df = spark.createDataFrame([("quarter one", None), ("quarter two", None)], "t string, empty string")
    strict = cf.cast_columns(df, {"t": "datetime64[ns]", "empty": "datetime64[ns]"})
    assert len(strict.errors) == 1 and "yyyy-MM-dd" in strict.errors[0] and dict(strict.df.dtypes) == {"t": "string", "empty": "timestamp_ntz"}
    assert [r["t"] for r in strict.df.collect()] == ["quarter one", "quarter two"]
    loose = cf.cast_columns(df, {"t": "datetime64[ns]"}, mode="try")
    assert not loose.errors and loose.warnings and {r["t"] for r in loose.df.collect()} == {None}


def test_shapes_allow_every_format_that_parses(spark):
    from cleanframe.operators import dates

    rng = random.Random(11)
    days = [datetime(1970, 1, 1) + timedelta(days=rng.randrange(30_000), seconds=rng.randrange(86_400), microseconds=rng.randrange(10**6)) for _ in range(6)]
    styles = ["%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y/%m/%d", "%m/%d/%Y", "%d.%m.%Y", "%d %b %Y", "%B %d, %Y", "%b %d, %Y", "%Y%m%d", "%d-%b-%Y",
              "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S+02:00", "%Y-%m-%d %H:%M:%SZ", "%Y-%m-%dT%H:%M"]
    texts = [d.strftime(s) for d in days for s in styles] + ["", " ", "no date", "12 main street", "2024-13-01", "+12345678-01-02", "+" + "9" * 70 + "-01-02", "x" * 200 + "1", "é1", None]
    df = spark.createDataFrame([(t, "name" if t else t) for t in texts], "t string, plain string")
    got = dates._rates(df, ["t", "plain"], dates.KNOWN_FORMATS)
    want = df.agg(*[F.count(dates.parse_date(F.col("t"), f)).alias(f"f{i}") for i, f in enumerate(dates.KNOWN_FORMATS)]).first()
    assert [got[("t", f)] for f in dates.KNOWN_FORMATS] == list(want) and sum(want) > 90
    assert got[("t", "n")] == len(texts) - 1 and not any(got[("plain", f)] for f in dates.KNOWN_FORMATS)
    assert dates._fitting(df, ["plain"], dates.KNOWN_FORMATS)[1]["plain"] == []
    odd = dates._rates(df, ["t"], ["yyyy-MM-dd", "yyyy 'day' D"])
    assert odd[("t", "yyyy-MM-dd")] == got[("t", "yyyy-MM-dd")]
