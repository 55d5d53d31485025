"""Columns, types, text values and categories."""

from __future__ import annotations

from pyspark.sql import functions as F

import cleanframe as cf
from cleanframe.functions.text import has_outer_space, has_special

from .base import on, per_column, query, table, view

_MONEY_COUNTS = per_column(("mostly_int", "all_int", "all_float", "flag", "mixed", "money", "nothing"), """
select '{c}' as "column", count({c}) as values_checked, count(try_cast(trim(regexp_replace({c}, '[,$%]', '', 'g')) as double)) as numeric_values,
  count({c}) > 0 and count({c}) = count(try_cast(trim(regexp_replace({c}, '[,$%]', '', 'g')) as double)) as numeric_as_text from typed_text""")


@query("columns_numeric_as_text", on("typed_text", _MONEY_COUNTS))
def numeric_as_text(spark, sf_dir):
    return cf.numeric_as_text(view(spark, sf_dir, "typed_text"))


@query("columns_numeric_as_text_sample", on("typed_text", per_column(("mostly_int", "all_int", "all_float", "flag", "mixed", "money"), """
select '{c}' as "column", count({c}) as values_checked, count(try_cast(trim(regexp_replace({c}, '[,$%]', '', 'g')) as double)) as numeric_values,
  count({c}) = count(try_cast(trim(regexp_replace({c}, '[,$%]', '', 'g')) as double)) as numeric_as_text
  from (select {c} from typed_text where {c} is not null order by c_custkey limit 3)""")))
def numeric_as_text_sample(spark, sf_dir):
    """The three-value test, with the order stated."""
    return cf.numeric_as_text(view(spark, sf_dir, "typed_text"), sample=3, order_by=["c_custkey"])


@query("columns_report", on("typed_text", """
select 'c_custkey' as "column", 'c_custkey' as suggested_name, false as needs_fix, 'bigint' as dtype, '' as issues, false as has_issue
union all select "column", "column", false, 'string', case when numeric_as_text then 'numeric_as_text' else '' end, numeric_as_text from (""" + _MONEY_COUNTS + ")"))
def columns_report(spark, sf_dir):
    report = cf.columns_report(view(spark, sf_dir, "typed_text"))
    return report.withColumn("issues", F.array_join("issues", ","))


@query("columns_report_messy_names", """
select 'First Name' as "column", 'first_name' as suggested_name, true as needs_fix, 'string' as dtype, 'whitespace,mixed_case' as issues, true as has_issue
union all select 'Price ($)', 'price', true, 'double', 'whitespace,special_characters,mixed_case', true
union all select 'ID', 'id', true, 'bigint', '', true""")
def columns_report_messy(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select(F.col("c_name").alias("First Name"), F.col("c_acctbal").alias("Price ($)"), F.col("c_custkey").alias("ID"))
    return cf.columns_report(df).withColumn("issues", F.array_join("issues", ","))


@query("columns_sample_values", on("dirty_customer", per_column(("balance", "segment", "revenue_text"), """
select * from (select '{c}' as "column", (row_number() over (order by c_custkey))::int as rank, cast({c} as varchar) as value
from dirty_customer where {c} is not null order by c_custkey limit 3)""")))
def sample_values(spark, sf_dir):
    return cf.sample_values(view(spark, sf_dir, "dirty_customer"), ["balance", "segment", "revenue_text"], ["c_custkey"])


@query("columns_rename_clean", "select c_custkey as customer_key, c_acctbal as price, c_name as first_name from customer")
def rename_clean(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("  Customer Key  "), F.col("c_acctbal").alias("Price ($)"), F.col("c_name").alias("_First__Name_")
    )
    return cf.rename_clean(df).df


@query("columns_rename_some", "select c_custkey as id, c_name as \"name\", c_nationkey, c_acctbal, c_mktsegment from customer")
def rename_some(spark, sf_dir):
    return cf.rename_columns(table(spark, sf_dir, "customer"), {"c_custkey": " id ", "c_name": "name", "nope": "x", "c_acctbal": "  "}).df


@query("cast_to_datetime", on("dated_orders", "select o_orderkey, try_cast(order_text as timestamp) as order_text, order_dmy from dated_orders"))
def cast_datetime(spark, sf_dir):
    return cf.cast_columns(view(spark, sf_dir, "dated_orders"), {"order_text": "datetime64[ns]"}).df


@query("cast_to_bool", on("typed_text", """select c_custkey, case when lower(trim(flag)) in ('true', '1', 'yes') then true
  when lower(trim(flag)) in ('false', '0', 'no') then false end as flag from typed_text"""))
def cast_bool(spark, sf_dir):
    return cf.cast_columns(view(spark, sf_dir, "typed_text"), {"flag": "bool"}).df.select("c_custkey", "flag")


@query("cast_to_category", "select distinct c_mktsegment as value, 'category' as dtype from customer")
def cast_category(spark, sf_dir):
    df = cf.cast_columns(table(spark, sf_dir, "customer"), {"c_mktsegment": "category"}).df
    kind = cf.column_info(df).filter(F.col("column") == "c_mktsegment").first()["dtype"]
    return cf.category_domain(df, "c_mktsegment").withColumn("dtype", F.lit(kind))


@query("cast_to_int_strict", on("typed_text", "select c_custkey, all_int::bigint as all_int, mostly_int from typed_text"))
def cast_int_strict(spark, sf_dir):
    """The clean column becomes bigint, the one with bad values is refused and stays text."""
    df = view(spark, sf_dir, "typed_text").select("c_custkey", "all_int", "mostly_int")
    return cf.cast_columns(df, {"all_int": "int64", "mostly_int": "int64"}).df


@query("cast_to_int_try", on("typed_text", "select c_custkey, try_cast(mostly_int as bigint) as mostly_int from typed_text"))
def cast_int_try(spark, sf_dir):
    df = view(spark, sf_dir, "typed_text").select("c_custkey", "mostly_int")
    return cf.cast_columns(df, {"mostly_int": "int64"}, mode="try").df


@query("cast_to_float", on("typed_text", "select c_custkey, all_float::double as all_float from typed_text"))
def cast_float(spark, sf_dir):
    df = view(spark, sf_dir, "typed_text").select("c_custkey", "all_float")
    return cf.cast_columns(df, {"all_float": "float64"}).df


@query("cast_to_text", "select c_custkey::varchar as c_custkey, c_nationkey::varchar as c_nationkey from customer")
def cast_text(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return cf.cast_columns(df, {"c_custkey": "object", "c_nationkey": "str"}).df


@query("types_hidden_boolean", per_column(("doc_id", "quality", "toxic"), """
select '{c}' as "column", 2::bigint as n_unique from labels having min({c}) = 0 and max({c}) = 1 and count_if({c} not in (0, 1)) = 0"""))
def hidden_boolean(spark, sf_dir):
    found = cf.type_findings(table(spark, sf_dir, "labels"))
    return found.filter(F.col("finding") == "hidden_boolean").select("column", "n_unique")


@query("types_likely_id", per_column(("c_custkey", "c_nationkey"), """
select '{c}' as "column", count(distinct {c}) as n_unique, count(*) as n_rows from customer having count(distinct {c}) = count(*)"""))
def likely_id(spark, sf_dir):
    found = cf.type_findings(table(spark, sf_dir, "customer"))
    return found.filter(F.col("finding") == "likely_id").select("column", "n_unique", "n_rows")


@query("types_high_cardinality", per_column(("text", "lang", "source"), """
select '{c}' as "column", count(distinct {c}) as n_unique, round(count(distinct {c}) / count(*), 6) as unique_share from documents
having count(distinct {c}) / count(*) > 0.5 and count(distinct {c}) > 10"""))
def high_cardinality(spark, sf_dir):
    found = cf.type_findings(table(spark, sf_dir, "documents"))
    return found.filter(F.col("finding") == "high_cardinality").select("column", "n_unique", F.round("unique_share", 6).alias("unique_share"))


@query("columns_empty", on("typed_text", per_column(("c_custkey", "mixed", "nothing"), """select '{c}' as "column" from typed_text having count({c}) = 0""")))
def empty_columns(spark, sf_dir):
    return cf.empty_columns(view(spark, sf_dir, "typed_text"))


@query("columns_mixed_content", on("typed_text", """
select 'mixed' as "column", count(mixed) as non_null, count(try_cast(mixed as double)) as numbers, count_if(mixed = 'true') as booleans,
  count_if(mixed = '2024-01-05') as dates, true as is_mixed from typed_text"""))
def mixed_content(spark, sf_dir):
    return cf.mixed_content(view(spark, sf_dir, "typed_text")).filter(F.col("column") == "mixed")


_TEXT = ("c_name", "segment", "revenue_text")


@query("text_whitespace_scan", on("dirty_customer", per_column(_TEXT, """
select '{c}' as "column", count({c}) as non_null, count_if({c} <> trim({c})) as affected, round(100.0 * count_if({c} <> trim({c})) / count({c}), 6) as affected_pct from dirty_customer""")))
def whitespace_scan(spark, sf_dir):
    return cf.whitespace_scan(view(spark, sf_dir, "dirty_customer")).withColumn("affected_pct", F.round("affected_pct", 6))


@query("text_whitespace_samples", on("dirty_customer", per_column(_TEXT, """
select * from (select '{c}' as "column", (row_number() over (order by {c}))::int as rank, {c} as value from (select distinct {c} from dirty_customer where {c} <> trim({c})) order by {c} limit 3)""")))
def whitespace_samples(spark, sf_dir):
    return cf.text_samples(view(spark, sf_dir, "dirty_customer"), has_outer_space)


@query("text_case_variants", on("dirty_customer", per_column(_TEXT, """
select '{c}' as "column", count(distinct {c}) as n_distinct, count(distinct lower({c})) as n_distinct_lower,
  count(distinct {c}) - count(distinct lower({c})) as n_variants from dirty_customer""")))
def case_variants(spark, sf_dir):
    return cf.case_variants(view(spark, sf_dir, "dirty_customer"))


@query("text_case_variant_groups", on("dirty_customer", """
select 'segment' as "column", lower_value, rank, value from
  (select lower_value, (row_number() over (order by lower_value))::int as rank from
    (select lower(segment) as lower_value from dirty_customer where segment is not null group by 1 having count(distinct segment) > 1) order by lower_value limit 3)
  join (select distinct segment as value from dirty_customer where segment is not null) on lower(value) = lower_value"""))
def case_variant_groups(spark, sf_dir):
    return cf.case_variant_groups(view(spark, sf_dir, "dirty_customer"))


@query("text_special_scan", on("dirty_customer", per_column(_TEXT, """
select '{c}' as "column", count({c}) as non_null, count_if(regexp_matches({c}, '[^\\w\\s]')) as affected,
  round(100.0 * count_if(regexp_matches({c}, '[^\\w\\s]')) / count({c}), 6) as affected_pct from dirty_customer""")))
def special_scan(spark, sf_dir):
    return cf.special_scan(view(spark, sf_dir, "dirty_customer")).withColumn("affected_pct", F.round("affected_pct", 6))


@query("text_special_samples", on("dirty_customer", per_column(_TEXT, """
select * from (select '{c}' as "column", (row_number() over (order by {c}))::int as rank, {c} as value
from (select distinct {c} from dirty_customer where regexp_matches({c}, '[^\\w\\s]')) order by {c} limit 3)""")))
def special_samples(spark, sf_dir):
    return cf.text_samples(view(spark, sf_dir, "dirty_customer"), has_special)


@query("text_value_report", on("dirty_customer", "select * from (" + per_column(_TEXT, """
select '{c}' as "column", count({c}) as non_null, count_if({c} <> trim({c})) as whitespace_count, count_if(regexp_matches({c}, '[^\\w\\s]')) as special_count,
  count(distinct {c}) - count(distinct lower({c})) as case_variants from dirty_customer""") + ") where whitespace_count > 0 or case_variants > 0 or special_count > 0"))
def text_value_report(spark, sf_dir):
    return cf.text_value_report(view(spark, sf_dir, "dirty_customer"))


def _clean(name: str, method: str, sql: str | None):
    @query(f"text_{name}", on("dirty_customer", f"select c_custkey, {sql} as segment from dirty_customer") if sql else None)
    def run(spark, sf_dir):
        return cf.clean_text(view(spark, sf_dir, "dirty_customer"), {"segment": method}).df.select("c_custkey", "segment")


_clean("trim", "trim", "trim(segment)")
_clean("lowercase", "lowercase", "lower(trim(segment))")
_clean("uppercase", "uppercase", "upper(trim(segment))")
_clean("titlecase", "titlecase", "case when trim(segment) in ('N/A', '-') then trim(segment) else upper(left(trim(segment), 1)) || lower(substr(trim(segment), 2)) end")
_clean("remove_special", "remove_special", r"trim(regexp_replace(trim(segment), '[^\w\s]', '', 'g'))")
_clean("clean_all", "all", r"trim(regexp_replace(lower(trim(segment)), '[^\w\s]', '', 'g'))")


@query("text_clean_plan", on("dirty_customer", r"""select c_custkey, lower(trim(c_name)) as c_name, balance, nation_id, upper(trim(segment)) as segment,
  trim(regexp_replace(trim(revenue_text), '[^\w\s]', '', 'g')) as revenue_text from dirty_customer"""))
def clean_plan(spark, sf_dir):
    """Three good entries; a number column, an unknown column and an unknown method are reported and skipped."""
    plan = {"c_name": "lowercase", "segment": "uppercase", "revenue_text": "remove_special", "balance": "trim", "nope": "trim"}
    return cf.clean_text(view(spark, sf_dir, "dirty_customer"), plan).df


_COUNTS = """(select segment as value, lower(trim(segment)) as norm, count(*) as n from dirty_customer where segment is not null group by 1)"""
_GROUPS = f"""(select norm, arg_min(value, (-n, value)) as canonical, sum(n)::bigint as group_rows, (sum(n) - max(n))::bigint as affected
  from {_COUNTS} group by norm having count(*) > 1)"""
_MAP = f"(select value as variant, canonical from {_COUNTS} join {_GROUPS} using (norm) where value <> canonical)"


@query("category_variant_groups", on("dirty_customer", f"select 'segment' as \"column\", norm, value, n from {_COUNTS} where norm in (select norm from {_GROUPS})"))
def variant_groups(spark, sf_dir):
    return cf.variant_groups(view(spark, sf_dir, "dirty_customer")).select("column", "norm", "value", "n")


@query("category_canonical", on("dirty_customer", f"select 'segment' as \"column\", norm, canonical, group_rows, affected from {_GROUPS}"))
def canonical(spark, sf_dir):
    return cf.variant_groups(view(spark, sf_dir, "dirty_customer")).select("column", "norm", "canonical", "group_rows", "affected").distinct()


@query("category_apply_mapping", on("dirty_customer", """select c_custkey, case segment when 'building' then 'BUILDING' when '  BUILDING ' then 'BUILDING'
  when 'N/A' then 'none' else segment end as segment from dirty_customer"""))
def apply_mapping(spark, sf_dir):
    mapping = {"building": "BUILDING", "  BUILDING ": "BUILDING", "N/A": "none"}
    return cf.apply_mapping(view(spark, sf_dir, "dirty_customer"), "segment", mapping).select("c_custkey", "segment")


@query("category_apply_mapping_joined", on("dirty_customer", f"select c_custkey, coalesce(canonical, segment) as segment from dirty_customer left join {_MAP} on segment = variant"))
def apply_mapping_joined(spark, sf_dir):
    """The mapping as a table, joined."""
    df = view(spark, sf_dir, "dirty_customer")
    return cf.apply_mapping(df, "segment", cf.harmonise_mapping(df, ["segment"])).select("c_custkey", "segment")


@query("category_harmonise", on("dirty_customer", f"""select c_custkey, c_name, balance, nation_id, coalesce(canonical, segment) as segment, revenue_text
  from dirty_customer left join {_MAP} on segment = variant"""))
def harmonise(spark, sf_dir):
    return cf.harmonise(view(spark, sf_dir, "dirty_customer")).df


@query("category_harmonise_dry_run", on("dirty_customer", f"select 'segment' as \"column\", variant, canonical from {_MAP}"))
def harmonise_mapping(spark, sf_dir):
    return cf.harmonise_mapping(view(spark, sf_dir, "dirty_customer"))
