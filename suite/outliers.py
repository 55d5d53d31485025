"""Outliers and correlation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

import cleanframe as cf
from cleanframe.sources.shared import shared_folder

from .base import EVENT_NUMBERS, LINEITEM_NUMBERS, on, per_column, query, rounded, table, view

_FIT = """(select avg({c}) m, stddev_samp({c}) s, min({c})::double mn, max({c})::double mx, quantile_cont({c}::double, 0.25) q1, quantile_cont({c}::double, 0.75) q3 from {t})"""
_FULL = """select '{c}' as "column", count({c}) as n, round(any_value(m), 4) as mean, round(any_value(s), 4) as std, any_value(mn) as min, any_value(mx) as max,
  round(any_value(q1), 6) as q1, round(any_value(q3), 6) as q3, round(any_value(q3 - q1), 6) as iqr,
  round(any_value(q1 - 1.5 * (q3 - q1)), 6) as lower_fence, round(any_value(q3 + 1.5 * (q3 - q1)), 6) as upper_fence,
  count_if(s > 0 and abs(({c} - m) / nullif(s, 0)) > 3) as zscore_outliers, count_if({c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) as iqr_outliers,
  count_if(s > 0 and abs(({c} - m) / nullif(s, 0)) > 3) > 0 or count_if({c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) > 0 as has_outliers,
  greatest(count_if(s > 0 and abs(({c} - m) / nullif(s, 0)) > 3), count_if({c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1))) as most_flagged
from {t}, """ + _FIT


def _of(template: str, t: str, columns) -> str:
    return per_column(columns, template.replace("{t}", t))


@query("outliers_zscore", f"""select "column", zscore_outliers from ({_of(_FULL, 'events', EVENT_NUMBERS)})""")
def zscore(spark, sf_dir):
    return cf.outlier_report(table(spark, sf_dir, "events")).select("column", "zscore_outliers")


@query("outliers_iqr", f"""select "column", q1, q3, lower_fence, upper_fence, iqr_outliers from ({_of(_FULL, 'events', EVENT_NUMBERS)})""")
def iqr(spark, sf_dir):
    return rounded(cf.outlier_report(table(spark, sf_dir, "events")).select("column", "q1", "q3", "lower_fence", "upper_fence", "iqr_outliers"), 6)


def _rounded_report(report):
    """Quartiles are exact, so they keep more digits than sums."""
    return rounded(rounded(report, 4, ("mean", "std")), 6)


@query("outliers_report", _of(_FULL, "lineitem", LINEITEM_NUMBERS))
def report(spark, sf_dir):
    return _rounded_report(cf.outlier_report(table(spark, sf_dir, "lineitem")))


@query("outliers_report_documents", _of(_FULL, "documents", ("doc_id", "n_chars")))
def report_documents(spark, sf_dir):
    return _rounded_report(cf.outlier_report(table(spark, sf_dir, "documents")))


@query("outliers_samples", f"""select 'value' as "column", (row_number() over (order by value))::int as rank, value from (select value from events, {_FIT.replace('{c}', 'value').replace('{t}', 'events')}
  where value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1) order by value limit 5)""")
def samples(spark, sf_dir):
    return cf.outlier_samples(table(spark, sf_dir, "events"))


def _fit(c: str, t: str) -> str:
    return _FIT.replace("{c}", c).replace("{t}", t)


@query("outliers_cap_iqr", f"select * exclude (m, s, mn, mx, q1, q3) replace (round(least(greatest(value, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)), 6) as value) from events, {_fit('value', 'events')}")
def cap_iqr(spark, sf_dir):
    return rounded(cf.fix_outliers(table(spark, sf_dir, "events"), {"value": "cap_iqr"}).df, 6)


@query("outliers_cap_iqr_with_missing", on("dirty_customer", f"""select c_custkey, case when balance is not null then round(least(greatest(balance, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)), 6) end as balance
  from dirty_customer, {_fit('balance', 'dirty_customer')}"""))
def cap_missing(spark, sf_dir):
    """Missing stays missing."""
    df = cf.fix_outliers(view(spark, sf_dir, "dirty_customer"), {"balance": "cap_iqr"}).df
    return rounded(df.select("c_custkey", "balance"), 6)


@query("outliers_cap_zscore", f"select * exclude (m, s, mn, mx, q1, q3) replace (round(least(greatest(value, m - 3 * s), m + 3 * s), 6) as value) from events, {_fit('value', 'events')}")
def cap_zscore(spark, sf_dir):
    return rounded(cf.fix_outliers(table(spark, sf_dir, "events"), {"value": "cap_zscore"}).df, 6)


@query("outliers_remove", f"select * exclude (m, s, mn, mx, q1, q3) from events, {_fit('value', 'events')} where value is null or value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)")
def remove(spark, sf_dir):
    return cf.fix_outliers(table(spark, sf_dir, "events"), {"value": "remove"}).df


_WITH_INFINITY = """
select event_id, case when event_id % 97 = 0 then 'Infinity'::double when event_id % 89 = 0 then '-Infinity'::double else value end as value from events"""


def _with_infinity(spark, sf_dir):
    endless = F.when(F.col("event_id") % 97 == 0, float("inf")).when(F.col("event_id") % 89 == 0, float("-inf"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(endless, F.col("value")).alias("value"))


@query("outliers_report_infinity", f"""select 'value' as "column", count(value) as n, min(value) as min, max(value) as max, round(any_value(q1), 6) as q1, round(any_value(q3), 6) as q3,
  0::bigint as zscore_outliers, count_if(value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)) as iqr_outliers
from ({_WITH_INFINITY}), (select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from ({_WITH_INFINITY}))""")
def report_infinity(spark, sf_dir):
    """No z-scores where the mean is not finite; quartiles and fences stand."""
    report = cf.outlier_report(_with_infinity(spark, sf_dir), ["value"])
    return rounded(report.select("column", "n", "min", "max", "q1", "q3", "zscore_outliers", "iqr_outliers"), 6)


@query("outliers_cap_zscore_infinity", _WITH_INFINITY)
def cap_zscore_infinity(spark, sf_dir):
    """A column without a finite deviation stays as it is."""
    return cf.fix_outliers(_with_infinity(spark, sf_dir), {"value": "cap_zscore"}).df


@query("outliers_fix_plan", f"""with kept as (select * exclude (m, s, mn, mx, q1, q3) from documents, {_fit('n_chars', 'documents')} where n_chars between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1))
select doc_id, text, lang, source, n_chars, round(least(greatest(doc_id, m - 3 * s), m + 3 * s), 6) as doc_cap from kept, {_fit('doc_id', 'kept')}""")
def fix_plan(spark, sf_dir):
    """The removal changes the statistics the later cap sees; text, unknown and non-numeric entries are reported."""
    df = table(spark, sf_dir, "documents").withColumn("doc_cap", F.col("doc_id"))
    out = cf.fix_outliers(df, {"n_chars": "remove", "doc_cap": "cap_zscore", "lang": "remove", "nope": "remove"}).df
    return rounded(out, 6)


# Two columns: the quadratic form and the inverse covariance in closed form. Cutoff: square root of the 97.5 % quantile of chi-square with 2 degrees.
_PAIR = """select *, sqrt(((x - mx) * (x - mx) * vy - 2 * (x - mx) * (y - my) * cxy + (y - my) * (y - my) * vx) / (vx * vy - cxy * cxy)) as d
from (select {keys}, {x}::double as x, {y}::double as y from {t} where {x} is not null and {y} is not null),
     (select avg(a) mx, avg(b) my, var_samp(a) vx, var_samp(b) vy, covar_samp(a, b) cxy from (select {x}::double as a, {y}::double as b from {t} where {x} is not null and {y} is not null))"""
_CUT = "2.7162030314820957"


def _pair(t: str, x: str, y: str, keys: str) -> str:
    return "(" + _PAIR.format(t=t, x=x, y=y, keys=keys) + ")"


@query("multivariate_distance", f"select l_orderkey, l_linenumber, l_quantity, l_extendedprice, round(d, 6) as distance from {_pair('lineitem', 'l_quantity', 'l_extendedprice', '*')}")
def distance(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    fit = cf.fit_mahalanobis(df, ["l_quantity", "l_extendedprice"])
    return df.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", F.round(fit.distance, 6).alias("distance"))


@query("multivariate_report", on("dirty_customer", f"""select count(*) as rows_analysed, (select count_if(balance is null or nation_id is null) from dirty_customer) as rows_incomplete,
  round({_CUT}, 6) as threshold, count_if(d > {_CUT}) as outliers from {_pair('dirty_customer', 'balance', 'nation_id', 'c_custkey')}"""))
def multivariate_report(spark, sf_dir):
    df = view(spark, sf_dir, "dirty_customer")
    return rounded(cf.mahalanobis_report(df, cf.fit_mahalanobis(df, ["balance", "nation_id"])), 6)


@query("multivariate_samples", f"select event_id, user_id, value, round(d, 6) as distance from {_pair('events', 'user_id', 'value', 'event_id, user_id, value')} where d > {_CUT} order by d desc, event_id limit 5")
def multivariate_samples(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    far = cf.mahalanobis_samples(df, cf.fit_mahalanobis(df, ["user_id", "value"]), ["event_id"])
    return rounded(far.select("event_id", "user_id", "value", "distance"), 6)


@query("multivariate_drop", f"""select event_id, user_id, value from {_pair('events', 'user_id', 'value', 'event_id, user_id, value')} where d <= {_CUT}""")
def multivariate_drop(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return cf.fit_mahalanobis(df, ["user_id", "value"]).apply(df, "drop").select("event_id", "user_id", "value")


@query("multivariate_flag", on("dirty_customer", f"""select c.c_custkey, coalesce(d > {_CUT}, false) as __multivariate_outlier__ from dirty_customer c
  left join {_pair('dirty_customer', 'balance', 'nation_id', 'c_custkey')} p on c.c_custkey = p.c_custkey"""))
def multivariate_flag(spark, sf_dir):
    """Incomplete rows are never flagged."""
    df = view(spark, sf_dir, "dirty_customer")
    return cf.fit_mahalanobis(df, ["balance", "nation_id"]).apply(df, "flag").select("c_custkey", "__multivariate_outlier__")


@query("multivariate_all_columns")
def multivariate_all(spark, sf_dir):
    """All eight numeric columns; checked against NumPy in the tests."""
    df = table(spark, sf_dir, "lineitem")
    return cf.mahalanobis_report(df, cf.fit_mahalanobis(df))


@query("correlation_matrix", " union all ".join(
    f"select '{a}' as col_a, '{b}' as col_b, round({'1.0' if a == b else f'corr({a}, {b})'}, 4) as correlation from lineitem having count(*) > 0"
    for a in LINEITEM_NUMBERS for b in LINEITEM_NUMBERS))
def correlation_matrix(spark, sf_dir):
    return rounded(cf.correlation_matrix(table(spark, sf_dir, "lineitem")))


@query("correlation_pairs_with_missing", on("dirty_customer", """select 'c_custkey' as col_a, 'balance' as col_b, round(corr(c_custkey, balance), 4) as correlation from dirty_customer
  union all select 'c_custkey', 'nation_id', round(corr(c_custkey, nation_id), 4) from dirty_customer
  union all select 'balance', 'nation_id', round(corr(balance, nation_id), 4) from dirty_customer"""))
def correlation_pairs(spark, sf_dir):
    return rounded(cf.correlation_pairs(view(spark, sf_dir, "dirty_customer")))


_WITH_REVENUE = (*LINEITEM_NUMBERS, "l_revenue")


@query("correlation_high_pairs", "select col_a, col_b, round(r, 4) as correlation, col_b as drop_candidate from (" + " union all ".join(
    f"select '{a}' as col_a, '{b}' as col_b, corr({a}, {b}) as r from (select *, l_extendedprice * (1 - l_discount) as l_revenue from lineitem)"
    for i, a in enumerate(_WITH_REVENUE) for b in _WITH_REVENUE[i + 1 :]) + ") where abs(r) >= 0.95")
def high_correlations(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("l_revenue", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return rounded(cf.high_correlations(df))


@query("correlation_high_pairs_missing", on("dirty_customer", """select 'balance' as col_a, 'twice' as col_b, round(corr(balance, twice), 4) as correlation, 'twice' as drop_candidate
  from (select balance, case when c_custkey % 3 = 0 then null else balance * 2 + 1 end as twice from dirty_customer)
  union all select 'balance', 'again', round(corr(balance, again), 4), 'balance' from (select balance, case when balance is null then 0 else balance end as again from dirty_customer)"""))
def high_correlations_missing(spark, sf_dir):
    """The column with more missing cells is the one to drop."""
    df = view(spark, sf_dir, "dirty_customer")
    less = df.select("balance", F.when(F.col("c_custkey") % 3 != 0, F.col("balance") * 2 + 1).alias("twice"))
    more = df.select("balance", F.coalesce("balance", F.lit(0.0)).alias("again"))
    return rounded(cf.high_correlations(less).unionByName(cf.high_correlations(more)))


_SPARSE = "select event_id, value, case when event_id < 3 then value end as rare from events"


def _sparse(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "value", F.when(F.col("event_id") < 3, F.col("value")).alias("rare"))


@query("outliers_skipped", f"""select 'rare' as "column", count(rare) as n, 'fewer than 4 values' as reason from ({_SPARSE}) having count(rare) < 4""")
def skipped(spark, sf_dir):
    return cf.skipped_columns(_sparse(spark, sf_dir))


@query("outliers_totals", f"""select count_if(not few) as analysed, count_if(not few and has_outliers) as with_outliers, count_if(not few and not has_outliers) as clean, count_if(few) as skipped from (
  select false as few, has_outliers from ({_of(_FULL, 'events', ('event_id', 'value'))}) union all select count(rare) < 4, false from ({_SPARSE}))""")
def totals(spark, sf_dir):
    return cf.outlier_totals(_sparse(spark, sf_dir))


_EFFECT = on("dirty_customer", f"""select (select count(*) from dirty_customer) as n_rows_before, count(*) as n_rows_after,
  (select count_if(balance is null) + count_if(nation_id is null) + count_if(segment is null) from dirty_customer)::bigint as missing_cells_before,
  (count_if(balance is null) + count_if(nation_id is null) + count_if(segment is null))::bigint as missing_cells_after,
  (select count(*) from dirty_customer) - count(*) as rows_removed,
  (count_if(balance is null) + count_if(nation_id is null) + count_if(segment is null))::bigint - (select count_if(balance is null) + count_if(nation_id is null) + count_if(segment is null) from dirty_customer)::bigint as missing_added
  from dirty_customer, {_fit('balance', 'dirty_customer')} where balance is null or balance between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)""")


@query("fix_effect", _EFFECT)
def effect(spark, sf_dir):
    """Rows and missing cells before and after a removal of outliers."""
    df = view(spark, sf_dir, "dirty_customer")
    return cf.fix_effect(df, cf.fix_outliers(df, {"balance": "remove"}).df)


@query("fix_effect_written", _EFFECT)
def effect_written(spark, sf_dir):
    """The same numbers, observed by the job that writes the fixed table."""
    fit = cf.fit_outlier_fix(view(spark, sf_dir, "dirty_customer"), {"balance": "remove"})
    return cf.write_fixed(view(spark, sf_dir, "dirty_customer"), fit, f"{shared_folder(spark)}/{uuid.uuid4().hex}/fixed")


@query("fix_effect_duplicates", on("dup_events", """select count(*) as n_rows_before, any_value(n) as n_rows_after, count_if(value is null)::bigint as missing_cells_before,
  any_value(m)::bigint as missing_cells_after, round(sum(value), 2) as total_before, round(any_value(s), 2) as total_after, count(*) - any_value(n) as rows_removed,
  (any_value(m) - count_if(value is null))::bigint as missing_added
  from dup_events, (select count(*) as n, count_if(value is null) as m, sum(value) as s from (select distinct * from dup_events))"""))
def effect_duplicates(spark, sf_dir):
    """Duplicates removed and written: rows and the sum of a column on both sides, from one job."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}/distinct"
    return rounded(cf.write_fixed(view(spark, sf_dir, "dup_events"), cf.drop_duplicate_rows, path, measures={"total": lambda t: F.sum("value")}), 2)
