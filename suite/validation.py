"""Rules, date ranges, cross-column checks and text formats."""

from __future__ import annotations

from pyspark.sql import functions as F

import cleanframe as cf
from cleanframe import Rule

from .base import on, per_column, query, rounded, table, view

YEAR = 2025
_SUGGESTED = """
select 'birth_year' as "column", 'no_future_year(year=2025)' as rule, count_if(birth_year > 2025) as violations, count_if(birth_year > 2025) = 0 as passed from people
union all select 'birth_year', 'custom_range(max=2025,min=1900)', count_if(birth_year < 1900 or birth_year > 2025), count_if(birth_year < 1900 or birth_year > 2025) = 0 from people
union all select 'age', 'custom_range(max=150,min=0)', count_if(age < 0 or age > 150), count_if(age < 0 or age > 150) = 0 from people
union all select 'pct_done', 'percentage', count_if(pct_done < 0 or pct_done > 100), count_if(pct_done < 0 or pct_done > 100) = 0 from people"""


@query("rules_suggested", on("people", _SUGGESTED))
def suggested(spark, sf_dir):
    df = view(spark, sf_dir, "people")
    return cf.run_rules(df, cf.suggest_rules(df, YEAR))[0]


@query("rules_suggested_summary", on("people", f"select count(*) as rules_run, count_if(passed) as rules_passed, count_if(not passed) as rules_failed, sum(violations)::bigint as total_violations from ({_SUGGESTED})"))
def suggested_summary(spark, sf_dir):
    df = view(spark, sf_dir, "people")
    return cf.rules_summary(cf.run_rules(df, cf.suggest_rules(df, YEAR))[0])


@query("rules_suggested_lineitem", per_column(("l_linenumber", "l_quantity", "l_extendedprice", "l_discount"), """
select '{c}' as "column", 'no_negative' as rule, count_if({c} < 0) as violations, count_if({c} < 0) = 0 as passed from lineitem"""))
def suggested_lineitem(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return cf.run_rules(df, cf.suggest_rules(df, YEAR))[0]


def _rule(name: str, source: str, rule: Rule, condition: str):
    sql = f"""select '{rule.column}' as "column", '{rule.label}' as rule, count_if({condition}) as violations, count_if({condition}) = 0 as passed from {source}"""

    @query(f"rule_{name}", sql if source in ("customer", "orders") else on(source, sql))
    def run(spark, sf_dir):
        df = table(spark, sf_dir, source) if source in ("customer", "orders") else view(spark, sf_dir, source)
        return cf.run_rules(df, [rule])[0]


_rule("no_future_year", "people", Rule("birth_year", "no_future_year", {"year": 2000}), "birth_year > 2000")
_rule("no_past_year", "people", Rule("birth_year", "no_past_year", {"min_year": 1950}), "birth_year < 1950")
_rule("no_negative", "customer", Rule("c_acctbal", "no_negative"), "c_acctbal < 0")
_rule("percentage", "people", Rule("pct_done", "percentage"), "pct_done < 0 or pct_done > 100")
_rule("custom_range", "people", Rule("age", "custom_range", {"min": 10, "max": 60}), "age < 10 or age > 60")
_rule("custom_range_one_sided", "orders", Rule("o_totalprice", "custom_range", {"max": 400000}), "o_totalprice > 400000")
_rule("no_nulls", "dirty_customer", Rule("segment", "no_nulls"), "segment is null")

_SET = [Rule("balance", "no_negative"), Rule("balance", "no_nulls"), Rule("nation_id", "custom_range", {"min": 5, "max": 20})]


@query("rules_run_set", on("dirty_customer", """
select 'balance' as "column", 'no_negative' as rule, count_if(balance < 0) as violations, count_if(balance < 0) = 0 as passed from dirty_customer
union all select 'balance', 'no_nulls', count_if(balance is null), count_if(balance is null) = 0 from dirty_customer
union all select 'nation_id', 'custom_range(max=20,min=5)', count_if(nation_id < 5 or nation_id > 20), count_if(nation_id < 5 or nation_id > 20) = 0 from dirty_customer"""))
def run_set(spark, sf_dir):
    """A numeric rule on a text column and an unknown column are reported, the other rules run."""
    wrong = [Rule("segment", "percentage"), Rule("nope", "no_nulls"), Rule("balance", "custom_range")]
    return cf.run_rules(view(spark, sf_dir, "dirty_customer"), [*_SET, *wrong])[0]


@query("rules_violating_rows", on("dirty_customer", """
select c_custkey, 'balance' as "column", 'no_negative' as rule, round(balance, 6) as value from dirty_customer where balance < 0
union all select c_custkey, 'balance', 'no_nulls', null from dirty_customer where balance is null
union all select c_custkey, 'nation_id', 'custom_range(max=20,min=5)', nation_id from dirty_customer where nation_id < 5 or nation_id > 20"""))
def violating(spark, sf_dir):
    return cf.violating_rows(view(spark, sf_dir, "dirty_customer"), _SET, ["c_custkey"]).withColumn("value", F.round(F.col("value").cast("double"), 6))


@query("rules_samples", on("people", """
select 'age' as "column", 'custom_range(max=150,min=0)' as rule, (row_number() over (order by person_id))::int as rank, age::varchar as value
from (select * from people where age < 0 or age > 150 order by person_id limit 5)"""))
def samples(spark, sf_dir):
    return cf.rule_samples(view(spark, sf_dir, "people"), [Rule("age", "custom_range", {"min": 0, "max": 150})], ["person_id"])


_AGE = Rule("age", "custom_range", {"min": 0, "max": 150})


@query("fix_replace", on("people", "select person_id, birth_year, case when age < 0 or age > 150 then 99 else age end as age, pct_done, email, phone from people"))
def fix_replace(spark, sf_dir):
    return cf.fix_violations(view(spark, sf_dir, "people"), _AGE, "replace", 99).df


@query("fix_set_null", on("people", "select person_id, birth_year, case when age < 0 or age > 150 then null else age end as age, pct_done, email, phone from people"))
def fix_set_null(spark, sf_dir):
    return cf.fix_violations(view(spark, sf_dir, "people"), _AGE, "set_null").df


@query("fix_drop_rows", "select * from customer where not coalesce(c_acctbal < 0, false)")
def fix_drop_rows(spark, sf_dir):
    return cf.fix_violations(table(spark, sf_dir, "customer"), Rule("c_acctbal", "no_negative"), "drop_rows").df


@query("fix_then_recheck", on("people", """select 'age' as "column", 'custom_range(max=150,min=0)' as rule, 0::bigint as violations, true as passed from people having count(*) > 0"""))
def fix_recheck(spark, sf_dir):
    """The rule holds after its fix, and a second fix changes nothing."""
    once = cf.fix_violations(view(spark, sf_dir, "people"), _AGE, "set_null").df
    return cf.run_rules(cf.fix_violations(once, _AGE, "set_null").df, [_AGE])[0]


@query("date_range_datetime", """select 'o_orderdate' as "column", 'timestamp_ntz' as dtype, count(o_orderdate) as non_null, count_if(year(o_orderdate) < 1995 or year(o_orderdate) > 2000) as violations from orders
  having count_if(year(o_orderdate) < 1995 or year(o_orderdate) > 2000) > 0""")
def date_range_datetime(spark, sf_dir):
    return cf.date_range_report(table(spark, sf_dir, "orders"), 1995, 2000)


@query("date_range_samples", """select 'o_orderdate' as "column", (row_number() over (order by o_orderdate))::int as rank, o_orderdate::varchar as value
  from (select o_orderdate from orders where year(o_orderdate) < 1995 or year(o_orderdate) > 2000 order by o_orderdate limit 5)""")
def date_range_samples(spark, sf_dir):
    return cf.date_range_samples(table(spark, sf_dir, "orders"), 1995, 2000)


@query("date_range_year_columns", on("people", """select 'birth_year' as "column", 'int' as dtype, count(birth_year) as non_null, count_if(birth_year < 1950 or birth_year > 2000) as violations from people"""))
def date_range_years(spark, sf_dir):
    return cf.date_range_report(view(spark, sf_dir, "people"), 1950, 2000)


@query("date_range_fix", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, case when year(o_orderdate) between 1995 and 2000 then o_orderdate end as o_orderdate, o_orderpriority from orders")
def date_range_fix(spark, sf_dir):
    """The text column is refused, the date column is fixed."""
    return cf.fix_date_range(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderstatus"], 1995, 2000).df


def _cross(name: str, source: str, rule: str, a: str, b: str, condition: str, **params):
    @query(f"cross_{name}", on(source, f"""select '{rule}' as rule, count_if({a} is not null and {b} is not null) as rows_checked, count_if({condition}) as violations,
      count_if({condition}) = 0 as passed from {source}"""))
    def run(spark, sf_dir):
        return cf.cross_column_report(view(spark, sf_dir, source), rule, a, b, **params)


_cross("end_after_start", "ship_vs_order", "end_after_start", "o_orderdate", "l_shipdate", "l_shipdate < o_orderdate")
_cross("age_matches_birth_year", "people", "age_matches_birth_year", "age", "birth_year", "abs(age - (2025 - birth_year)) > 2", as_of_year=YEAR)
_cross("age_tolerance_zero", "people", "age_matches_birth_year", "age", "birth_year", "abs(age - (2026 - birth_year)) > 0", as_of_year=2026, tolerance=0)
_cross("a_less_than_b", "people", "a_less_than_b", "age", "birth_year", "age >= birth_year")
_cross("a_greater_than_b", "dirty_customer", "a_greater_than_b", "balance", "nation_id", "balance <= nation_id")


@query("cross_age_sentinel", on("people", """select 'age_matches_birth_year' as rule, count(*) as rows_checked, count_if(person_id % 13 = 0 or abs(age - (2025 - birth_year)) > 2) as violations,
  count_if(person_id % 13 = 0 or abs(age - (2025 - birth_year)) > 2) = 0 as passed from people"""))
def cross_sentinel(spark, sf_dir):
    """The least integer stands for an unknown year of birth; subtracting it does not overflow."""
    least = F.when(F.col("person_id") % 13 == 0, F.lit(-(2**31))).otherwise(F.col("birth_year")).cast("int")
    return cf.cross_column_report(view(spark, sf_dir, "people").withColumn("birth_year", least), "age_matches_birth_year", "age", "birth_year", as_of_year=YEAR)


@query("cross_samples", on("people", "select person_id, age, birth_year from people where abs(age - (2025 - birth_year)) > 2 order by person_id limit 5"))
def cross_samples(spark, sf_dir):
    return cf.cross_column_samples(view(spark, sf_dir, "people"), "age_matches_birth_year", "age", "birth_year", ["person_id"], as_of_year=YEAR)


@query("cross_fix", on("ship_vs_order", "select l_orderkey, l_linenumber, case when l_shipdate < o_orderdate then null else l_shipdate end as l_shipdate, o_orderdate from ship_vs_order"))
def cross_fix(spark, sf_dir):
    return cf.fix_cross_column(view(spark, sf_dir, "ship_vs_order"), "end_after_start", "o_orderdate", "l_shipdate", clear="l_shipdate").df


_EMAIL = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$"
_PHONE = r"^(\+1[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}$"
_URL = r"(?i)^https?://[^\s/$.?#].[^\s]*$"


def _check(name: str, source: str, column: str, pattern: str, regex: str, custom: str | None = None):
    sql = f"""select '{pattern}' as pattern, count({column}) as values_checked, count_if(not regexp_matches(trim({column}::varchar), '{regex}')) as violations,
      round(100.0 * count_if(regexp_matches(trim({column}::varchar), '{regex}')) / count({column}), 6) as pass_rate, count_if(not regexp_matches(trim({column}::varchar), '{regex}')) = 0 as passed from {source}"""

    @query(f"pattern_{name}", on(source, sql) if source in ("people", "dated_orders", "typed_text") else sql)
    def run(spark, sf_dir):
        df = view(spark, sf_dir, source) if source in ("people", "dated_orders", "typed_text") else table(spark, sf_dir, source)
        return rounded(cf.check_pattern(df, column, pattern, custom), 6)


_check("email", "people", "email", "email", _EMAIL)
_check("phone_us", "people", "phone", "phone_us", _PHONE)
_check("postal_code_us", "typed_text", "mostly_int", "postal_code_us", r"^\d{5}(-\d{4})?$")
_check("postal_code_uk", "people", "phone", "postal_code_uk", r"(?i)^[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}$")
_check("url", "pages", "url", "url", _URL)
_check("date_iso", "dated_orders", "order_text", "date_iso", r"^\d{4}-\d{2}-\d{2}$")
_check("integer_string", "typed_text", "mostly_int", "integer_string", r"^-?\d+$")
_check("decimal_string", "typed_text", "all_float", "decimal_string", r"^-?\d+(\.\d+)?$")
_check("custom_regex", "customer", "c_name", "custom", r"^(?:Customer#0+[1-5])", "Customer#0+[1-5]")

_RATES = per_column(("email", "phone"), f"""select '{{c}}' as "column", count({{c}}) as n_values, count_if(regexp_matches(trim({{c}}), case '{{c}}' when 'email' then '{_EMAIL}' else '{_PHONE}' end)) as ok from people""")


@query("pattern_detect", on("people", f"""select "column", case "column" when 'email' then 'email' else 'phone_us' end as pattern, n_values, round(100.0 * ok / n_values, 6) as match_rate, n_values - ok as violations
  from ({_RATES}) where ok >= 0.8 * n_values"""))
def detect(spark, sf_dir):
    return rounded(cf.detect_patterns(view(spark, sf_dir, "people")), 6)


@query("pattern_detect_sample", f"""select 'url' as "column", 'url' as pattern, count(*) as n_values,
  (select round(100.0 * count_if(regexp_matches(trim(url), '{_URL}')) / count(*), 6) from (select url from pages order by page_id limit 20)) as match_rate, count_if(not regexp_matches(trim(url), '{_URL}')) as violations from pages""")
def detect_sample(spark, sf_dir):
    """Decided on the first twenty values, counted over all."""
    return rounded(cf.detect_patterns(table(spark, sf_dir, "pages"), sample=20, order_by=["page_id"]), 6)


@query("pattern_violating_rows", on("people", f"select person_id, email from people where not regexp_matches(trim(email), '{_EMAIL}')"))
def violating_rows(spark, sf_dir):
    return cf.pattern_violations(view(spark, sf_dir, "people"), "email", "email", ["person_id"], k=None)
