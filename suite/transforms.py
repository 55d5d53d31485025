"""Skewness, transforms, scaling and dates."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

import cleanframe as cf

from .base import EVENT_NUMBERS, LINEITEM_NUMBERS, on, per_column, query, rounded, table, view

_SKEW = per_column(EVENT_NUMBERS, """select '{c}' as "column", count({c}) as n, coalesce(skewness({c}), 0) as s, count_if({c} = 0) as zeros, count_if({c} < 0) as negatives,
  min({c})::double as min, max({c})::double as max from events""")
_LEVEL = "case when abs(s) < 0.5 then 'symmetric' when abs(s) < 1 then 'moderate' else 'high' end"
_ADVICE = """case when abs(s) < 0.5 then 'do_nothing' when negatives > 0 then 'yeojohnson' when s > 0 and abs(s) >= 1 then case when zeros > 0 then 'log1p' else 'log' end
  when s > 0 then 'sqrt' else 'yeojohnson' end"""


@query("skew_values", per_column(LINEITEM_NUMBERS, """select '{c}' as "column", count({c}) as n, round(coalesce(skewness({c}), 0), 4) as skewness from lineitem"""))
def skewness(spark, sf_dir):
    return rounded(cf.skewness(table(spark, sf_dir, "lineitem")))


@query("skew_report", f"""select "column", n, round(s, 4) as skewness, zeros, negatives, min, max, {_LEVEL} as level,
  case when s > 0 then 'right' when s < 0 then 'left' else 'none' end as direction, {_ADVICE} as recommended, abs(s) >= 0.5 as needs_transform,
  min > 0 as can_log, min > 0 as can_boxcox, min > 0 as can_reciprocal, min >= 0 as can_log1p, min >= 0 as can_sqrt, true as can_yeojohnson
from (select * replace (round(s, 4) as s) from ({_SKEW}))""")
def skew_report(spark, sf_dir):
    return rounded(cf.skewness_report(table(spark, sf_dir, "events")))


def _positive(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("value > 0").select("event_id", "value")


def _transform(name: str, method: str, sql: str, source: str):
    @query(f"transform_{name}", f"select event_id, round({sql}, 6) as value from {source}")
    def run(spark, sf_dir):
        df = table(spark, sf_dir, "events").select("event_id", "value") if source == "events" else _positive(spark, sf_dir)
        return rounded(cf.fix_skew(df, {"value": method}).df, 6)


_transform("log", "log", "ln(value)", "events where value > 0")
_transform("log1p", "log1p", "ln(1 + value)", "events")
_transform("sqrt", "sqrt", "sqrt(value)", "events")
_transform("reciprocal", "reciprocal", "1.0 / value", "events where value > 0")

# Best power by two nested grids over the mean log-likelihood.
_BOXCOX = """with x as (select value, ln(value) as lx from events where value > 0), g as (select avg(lx) as m from x),
coarse as (select l, -ln(var_pop(case when abs(l) < 1e-12 then lx else (exp(l * lx) - 1) / l end)) / 2 + (l - 1) * any_value(m) as score
  from x, g, (select unnest(range(-40, 41)) / 20.0::double as l) group by l),
best as (select arg_max(l, score) as b from coarse),
fine as (select l, -ln(var_pop(case when abs(l) < 1e-12 then lx else (exp(l * lx) - 1) / l end)) / 2 + (l - 1) * any_value(m) as score
  from x, g, (select b + unnest(range(-500, 501)) / 10000.0::double as l from best) group by l)
select round(arg_max(l, score), 3) as power from fine"""
_YEO = """with x as (select c_acctbal as v, sign(c_acctbal) * ln(1 + abs(c_acctbal)) as j from customer), g as (select avg(j) as m from x),
coarse as (select l, -ln(var_pop({y})) / 2 + (l - 1) * any_value(m) as score from x, g, (select unnest(range(-20, 61)) / 20.0::double + 1e-9 as l) group by l),
best as (select arg_max(l, score) as b from coarse),
fine as (select l, -ln(var_pop({y})) / 2 + (l - 1) * any_value(m) as score from x, g, (select b + unnest(range(-500, 501)) / 10000.0::double as l from best) group by l)
select round(arg_max(l, score), 3) as power from fine""".replace("{y}", "case when v >= 0 then (pow(v + 1, l) - 1) / l else -(pow(1 - v, 2 - l) - 1) / (2 - l) end")


@query("transform_boxcox_power", _BOXCOX)
def boxcox_power(spark, sf_dir):
    df = _positive(spark, sf_dir)
    power = cf.fit_transform(df, {"value": "boxcox"}).steps[0][2]
    return df.agg(F.lit(round(power, 3)).alias("power"))


@query("transform_yeojohnson_power", _YEO)
def yeojohnson_power(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_acctbal")
    power = cf.fit_transform(df, {"c_acctbal": "yeojohnson"}).steps[0][2]
    return df.agg(F.lit(round(power, 3)).alias("power"))


def _at_rounded_power(df, column: str, method: str):
    """The transform at its fitted power, rounded to three decimals as in the SQL."""
    fit = cf.fit_transform(df, {column: method})
    steps = tuple((c, m, round(power, 3)) for c, m, power in fit.steps)
    return rounded(replace(fit, steps=steps).apply(df), 6)


@query("transform_boxcox", f"""select event_id, round(case when abs(power) < 1e-10 then ln(value) else (pow(value, power) - 1) / power end, 6) as value
  from events, ({_BOXCOX}) where value > 0""")
def boxcox_values(spark, sf_dir):
    return _at_rounded_power(_positive(spark, sf_dir), "value", "boxcox")


@query("transform_yeojohnson", f"""select c_custkey, round(case when c_acctbal >= 0 then case when abs(power) < 1e-10 then ln(1 + c_acctbal) else (pow(c_acctbal + 1, power) - 1) / power end
  else case when abs(2 - power) < 1e-10 then -ln(1 - c_acctbal) else -(pow(1 - c_acctbal, 2 - power) - 1) / (2 - power) end end, 6) as c_acctbal from customer, ({_YEO})""")
def yeojohnson_values(spark, sf_dir):
    return _at_rounded_power(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "yeojohnson")


@query("transform_plan", """select o_orderkey, o_custkey, round(sqrt(o_totalprice), 6) as o_totalprice from orders""")
def transform_plan(spark, sf_dir):
    """log is refused on a column that holds 0; an unknown column and an unknown method are reported."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    plan = {"o_totalprice": "sqrt", "o_orderkey": "log", "nope": "log", "o_custkey": "cube"}
    return rounded(cf.fix_skew(df, plan).df, 6)


@query("transform_skew_change", """select 'value' as "column", round(skewness(value), 4) as skew_before, round(skewness(ln(value)), 4) as skew_after,
  round(abs(skewness(value)) - abs(skewness(ln(value))), 4) as improvement, abs(skewness(value)) > abs(skewness(ln(value))) as improved from events where value > 0""")
def skew_change(spark, sf_dir):
    df = _positive(spark, sf_dir)
    return rounded(cf.skew_change(df, cf.fix_skew(df, {"value": "log"}).df, ["value"]))


@query("scale_report", per_column(LINEITEM_NUMBERS, """select '{c}' as "column", count({c}) as n, min({c})::double as min, max({c})::double as max, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std,
  round((max({c}) - min({c}))::double, 4) as range, min({c}) >= -0.01 and max({c}) <= 1.01 and max({c}) - min({c}) <= 1.01 as already_minmax, abs(avg({c})) < 0.1 and abs(stddev_samp({c}) - 1) < 0.1 as already_zscore from lineitem"""))
def scale_report(spark, sf_dir):
    return rounded(cf.scaling_report(table(spark, sf_dir, "lineitem")))


def _scale(name: str, method: str, sql: str):
    @query(f"scale_{name}", f"""select l_orderkey, l_linenumber, round({sql.replace('{c}', 'l_extendedprice')}, 6) as l_extendedprice, round({sql.replace('{c}', 'l_quantity')}, 6) as l_quantity
      from lineitem, (select min(l_extendedprice) mn_l_extendedprice, max(l_extendedprice) mx_l_extendedprice, avg(l_extendedprice) m_l_extendedprice, stddev_samp(l_extendedprice) s_l_extendedprice,
        quantile_cont(l_extendedprice, 0.25) q1_l_extendedprice, quantile_cont(l_extendedprice, 0.5) q2_l_extendedprice, quantile_cont(l_extendedprice, 0.75) q3_l_extendedprice,
        min(l_quantity) mn_l_quantity, max(l_quantity) mx_l_quantity, avg(l_quantity) m_l_quantity, stddev_samp(l_quantity) s_l_quantity,
        quantile_cont(l_quantity, 0.25) q1_l_quantity, quantile_cont(l_quantity, 0.5) q2_l_quantity, quantile_cont(l_quantity, 0.75) q3_l_quantity from lineitem)""")
    def run(spark, sf_dir):
        df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
        return rounded(cf.fix_scale(df, {"l_extendedprice": method, "l_quantity": method}).df, 6)


_scale("minmax", "minmax", "({c} - mn_{c}) / (mx_{c} - mn_{c})")
_scale("zscore", "zscore", "({c} - m_{c}) / s_{c}")
_scale("robust", "robust", "({c} - q2_{c}) / (q3_{c} - q1_{c})")


@query("scale_plan", """select p_partkey, p_name, round((p_size - a.mn)::double / (a.mx - a.mn), 6) as p_size, round((p_retailprice - a.m) / a.s, 6) as p_retailprice
  from part, (select min(p_size) mn, max(p_size) mx, avg(p_retailprice) m, stddev_samp(p_retailprice) s from part) a""")
def scale_plan(spark, sf_dir):
    """A text column and an unknown one are reported; the others proceed."""
    df = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    plan = {"p_size": "minmax", "p_retailprice": "zscore", "p_name": "zscore", "nope": "minmax", "p_partkey": "do_nothing"}
    return rounded(cf.fix_scale(df, plan).df, 6)


_DATED = "try_strptime(order_dmy, '%d/%m/%Y')"


@query("dates_detect", on("dated_orders", f"""select 'order_text' as "column", 'yyyy-MM-dd' as format, count(*) as n_values, count(try_cast(order_text as date)) as n_parsed, round(100.0 * count(try_cast(order_text as date)) / count(*), 6) as parse_rate from dated_orders
  union all select 'order_dmy', 'dd/MM/yyyy', count(*), count({_DATED}), round(100.0 * count({_DATED}) / count(*), 6) from dated_orders"""))
def detect(spark, sf_dir):
    return rounded(cf.detect_dates(view(spark, sf_dir, "dated_orders")), 6)


@query("dates_detect_sample", on("dated_orders", f"""select 'order_text' as "column", 'yyyy-MM-dd' as format, count(*) as n_values, count(try_cast(order_text as date)) as n_parsed, round(100.0 * count(try_cast(order_text as date)) / count(*), 6) as parse_rate from (select * from dated_orders order by o_orderkey limit 10)
  union all select 'order_dmy', 'dd/MM/yyyy', count(*), count({_DATED}), round(100.0 * count({_DATED}) / count(*), 6) from (select * from dated_orders order by o_orderkey limit 10)"""))
def detect_sample(spark, sf_dir):
    """The ten-value test, with the order stated."""
    return rounded(cf.detect_dates(view(spark, sf_dir, "dated_orders"), sample=10, order_by=["o_orderkey"]), 6)


@query("dates_parse_inferred", on("dated_orders", f"select o_orderkey, try_cast(order_text as timestamp) as order_text, {_DATED} as order_dmy from dated_orders"))
def parse_inferred(spark, sf_dir):
    return cf.parse_dates(view(spark, sf_dir, "dated_orders"), ["order_text", "order_dmy", "o_orderkey"]).df


@query("dates_parse_given_format", on("dated_orders", f"select o_orderkey, order_text, {_DATED} as order_dmy from dated_orders"))
def parse_given(spark, sf_dir):
    return cf.parse_dates(view(spark, sf_dir, "dated_orders"), ["order_dmy"], "%d/%m/%Y").df


@query("dates_parse_report", on("dated_orders", """select 'order_text' as "column", 'yyyy-MM-dd' as format, count(order_text) as total, count(try_cast(order_text as date)) as parsed,
  count(order_text) - count(try_cast(order_text as date)) as failed, round(100.0 * count(try_cast(order_text as date)) / count(order_text), 6) as parsed_pct from dated_orders"""))
def parse_report(spark, sf_dir):
    df = view(spark, sf_dir, "dated_orders")
    return rounded(cf.parse_report(df, cf.fit_dates(df, ["order_text"])), 6)


_DAY = "substr(cast(o_orderdate as string), 1, 10)"


def _dates(name: str, text: str, sql: str):
    """Texts of one shape, built alike in both engines, against the timestamps they mean."""
    @query(f"dates_parse_{name}", f"select o_orderkey, {sql} as moment from orders")
    def run(spark, sf_dir):
        return cf.parse_dates(table(spark, sf_dir, "orders").select("o_orderkey", F.expr(text).alias("moment")), ["moment"]).df


_dates("iso_fraction", f"{_DAY} || 'T10:20:30.' || lpad(cast(o_orderkey % 1000 as string), 3, '0')",
       "cast(substr(o_orderdate::varchar, 1, 10) || ' 10:20:30.' || lpad((o_orderkey % 1000)::varchar, 3, '0') as timestamp)")
_dates("offset", f"{_DAY} || 'T23:30:00-05:00'", "cast(substr(o_orderdate::varchar, 1, 10) || ' 23:30:00' as timestamp) + interval 5 hour")
_dates("month_name", "date_format(o_orderdate, 'MMMM d, yyyy')", "cast(substr(o_orderdate::varchar, 1, 10) as timestamp)")
_dates("minutes", f"{_DAY} || ' 07:45'", "cast(substr(o_orderdate::varchar, 1, 10) || ' 07:45:00' as timestamp)")
