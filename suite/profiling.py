"""Profiling scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import cleanframe as cf

from .base import LINEITEM_NUMBERS, on, per_column, query, rounded, table, view

_ISSUES = on("people", """
select *, null::varchar as error from (
select 'columns' as task, 0::bigint as signal, false as has_issue
union all select 'missing', 0, false
union all select 'duplicates', count(*) - (select count(*) from (select distinct * from people)), false from people
union all select 'outliers', sum(o)::bigint, sum(o) > 0 from (""" + per_column(("person_id", "birth_year", "age", "pct_done"), """
  select case when count_if(abs(({c} - m) / s) > 3) > 0 or count_if({c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) > 0 then 1 else 0 end as o
  from people, (select avg({c}) m, stddev_samp({c}) s, quantile_cont({c}::double, 0.25) q1, quantile_cont({c}::double, 0.75) q3 from people)""") + """)
union all select 'transforms', sum(o)::bigint, sum(o) > 0 from (""" + per_column(("person_id", "birth_year", "age", "pct_done"), """
  select case when abs(skewness({c})) >= 0.5 then 1 else 0 end as o from people""") + """)
union all select 'validation', 4, true)""")


@query("profile_overview", "select count(*) as n_rows, 5::bigint as n_columns, 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' as column_names from customer")
def overview(spark, sf_dir):
    return cf.overview(table(spark, sf_dir, "customer")).withColumn("column_names", F.array_join("column_names", ","))


@query("profile_preview", "select * from orders order by o_orderkey limit 5")
def preview(spark, sf_dir):
    return cf.preview(table(spark, sf_dir, "orders"), ["o_orderkey"])


@query("profile_numeric_describe", per_column(LINEITEM_NUMBERS, """
select '{c}' as "column", count({c}) as count, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std, min({c})::double as min,
  round(quantile_cont({c}::double, 0.25), 4) as q25, round(quantile_cont({c}::double, 0.5), 4) as q50,
  round(quantile_cont({c}::double, 0.75), 4) as q75, max({c})::double as max from lineitem"""))
def numeric_describe(spark, sf_dir):
    return rounded(cf.numeric_describe(table(spark, sf_dir, "lineitem")))


@query("profile_numeric_describe_approx", per_column(LINEITEM_NUMBERS, """
select '{c}' as "column", count({c}) as count, min({c})::double as min, max({c})::double as max, true as q25_near, true as q50_near, true as q75_near from lineitem"""))
def numeric_describe_approx(spark, sf_dir):
    """Quantiles from one sketch pass instead of the exact ranks: each within 0.1 % of the rows of its rank."""
    lineitem = table(spark, sf_dir, "lineitem")
    report = cf.numeric_describe(lineitem, quantiles="approx").collect()
    parts = []
    for r in report:
        c = F.col(r["column"]).cast("double")
        near = [((F.count_if(c < r[q]) <= (p + 0.001) * F.count(c)) & (F.count_if(c <= r[q]) >= (p - 0.001) * F.count(c))).alias(f"{q}_near") for q, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))]
        parts.append(lineitem.agg(*near).select(F.lit(r["column"]).alias("column"), F.lit(r["count"]).alias("count"), F.lit(r["min"]).alias("min"), F.lit(r["max"]).alias("max"), "q25_near", "q50_near", "q75_near"))
    return reduce(DataFrame.unionByName, parts)


@query("profile_categorical_describe", per_column(("text", "lang", "source"), """
select * from (select '{c}' as "column", sum(n)::bigint as count, count(*) as n_unique, arg_min({c}, (-n, {c})) as top, max(n) as freq
from (select {c}, count(*) as n from documents where {c} is not null group by {c}))"""))
def categorical_describe(spark, sf_dir):
    return cf.categorical_describe(table(spark, sf_dir, "documents"))


@query("profile_column_info", on("dirty_customer", per_column(("c_custkey", "c_name", "balance", "nation_id", "segment", "revenue_text"),
       """select '{c}' as "column", count({c}) as non_null, case when '{c}' = 'c_custkey' then 'bigint' when '{c}' = 'balance' then 'double'
       when '{c}' = 'nation_id' then 'int' else 'string' end as dtype from dirty_customer""")))
def column_info(spark, sf_dir):
    return cf.column_info(view(spark, sf_dir, "dirty_customer"))


@query("profile_status", on("dirty_customer", """select count(*) as n_rows, 6::bigint as n_columns,
  (count_if(balance is null) + count_if(nation_id is null) + count_if(segment is null))::bigint as missing_cells from dirty_customer"""))
def status(spark, sf_dir):
    return cf.status(view(spark, sf_dir, "dirty_customer"))


@query("profile_min_max", per_column(("o_orderkey", "o_custkey", "o_totalprice"),
       """select '{c}' as "column", min({c})::double as min, max({c})::double as max from orders"""))
def min_max(spark, sf_dir):
    return cf.min_max(table(spark, sf_dir, "orders"))


@query("profile_issue_report", _ISSUES)
def issue_report(spark, sf_dir):
    return cf.issue_report(view(spark, sf_dir, "people"), as_of_year=2025)


@query("profile_issue_count", f"select count(*) as tasks_run, count_if(has_issue) as tasks_with_issues from ({_ISSUES})")
def issue_count(spark, sf_dir):
    return cf.issue_count(view(spark, sf_dir, "people"), as_of_year=2025)


@query("scan_all", f"select task, signal from ({_ISSUES})")
def scan_all(spark, sf_dir):
    """All six scans in order; of each report the number that says how much it found."""
    outcome = cf.scan_all(view(spark, sf_dir, "people"), as_of_year=2025)
    found = {
        "columns": F.count_if("has_issue"), "missing": F.coalesce(F.sum("missing_count"), F.lit(0)), "duplicates": F.max("duplicate_count"),
        "outliers": F.count_if("has_outliers"), "transforms": F.count_if("needs_transform"), "validation": F.count("*"),
    }
    marks = [outcome[t].report.agg(number.cast("bigint").alias("signal")).select(F.lit(t).alias("task"), "signal") for t, number in found.items()]
    return reduce(DataFrame.unionByName, marks)
