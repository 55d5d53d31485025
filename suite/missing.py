"""Missing cells."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

import cleanframe as cf

from .base import on, per_column, query, rounded, table, view

_TOKENS = "('n/a','na','n.a.','n.a','none','null','missing','unknown','-','--','---','?','??','','not available','not applicable')"
_HIDE = "case when lower(trim({c})) not in " + _TOKENS + " then {c} end"
# dirty_customer after text that stands for missing has become missing
_CLEAN = f"""(select c_custkey, {_HIDE.replace('{c}', 'c_name')} as c_name, balance, nation_id,
  {_HIDE.replace('{c}', 'segment')} as segment, {_HIDE.replace('{c}', 'revenue_text')} as revenue_text from dirty_customer)"""
_ALL = ("c_custkey", "c_name", "balance", "nation_id", "segment", "revenue_text")
dirty = partial(view, name="dirty_customer")


def _on(body: str) -> str:
    return on("dirty_customer", body)


@query("missing_disguised", _on("select * from (" + per_column(("c_name", "segment", "revenue_text"),
       f"""select '{{c}}' as "column", count_if(lower(trim({{c}})) in {_TOKENS}) as disguised from dirty_customer""") + ") where disguised > 0"))
def disguised(spark, sf_dir):
    return cf.disguised_report(dirty(spark, sf_dir))


@query("missing_hide_disguised", _on(f"select * from {_CLEAN}"))
def hide_disguised(spark, sf_dir):
    return cf.hide_disguised(dirty(spark, sf_dir))


@query("missing_column_report", _on(f"""select "column", dtype, n_rows, missing_count, round(missing_pct, 6) as missing_pct,
  case when missing_pct < 5 then 'low' when missing_pct < 20 then 'medium' else 'high' end as severity from (
  select *, 100.0 * missing_count / n_rows as missing_pct from (""" + per_column(_ALL, f"""
  select '{{c}}' as "column", case '{{c}}' when 'c_custkey' then 'bigint' when 'balance' then 'double' when 'nation_id' then 'int' else 'string' end as dtype,
    count(*) as n_rows, count_if({{c}} is null) as missing_count from {_CLEAN}""") + ") where missing_count > 0)"))
def column_report(spark, sf_dir):
    return rounded(cf.missing_report(dirty(spark, sf_dir)), 6)


@query("missing_rows_lost", _on(f"""select "column", rows_lost, round(100.0 * rows_lost / n, 6) as rows_lost_pct from (""" + per_column(_ALL, f"""
  select '{{c}}' as "column", count_if({{c}} is null) as rows_lost, count(*) as n from {_CLEAN}""") + ") where rows_lost > 0"))
def rows_lost(spark, sf_dir):
    return rounded(cf.rows_lost(dirty(spark, sf_dir)), 6)


@query("missing_row_summary", _on(f"""select count(*) as n_rows, count_if(balance is null or nation_id is null or segment is null or revenue_text is null) as rows_with_missing,
  round(100.0 * count_if(balance is null or nation_id is null or segment is null or revenue_text is null) / count(*), 6) as rows_missing_pct from {_CLEAN}"""))
def row_summary(spark, sf_dir):
    return rounded(cf.missing_summary(dirty(spark, sf_dir)).select("n_rows", "rows_with_missing", "rows_missing_pct"), 6)


@query("missing_table_summary", _on(f"""select n_rows, 6::bigint as n_columns, m as missing_cells, 2::bigint as clean_columns, d as disguised_cells,
  round(100.0 * m / (n_rows * 6), 6) as missing_pct from (select count(*) as n_rows,
    (count_if(balance is null) + count_if(nation_id is null) + count_if(segment is null) + count_if(revenue_text is null))::bigint as m from {_CLEAN}),
  (select (count_if(lower(trim(segment)) in {_TOKENS}) + count_if(lower(trim(revenue_text)) in {_TOKENS}))::bigint as d from dirty_customer)"""))
def table_summary(spark, sf_dir):
    row = cf.missing_summary(dirty(spark, sf_dir))
    return rounded(row.select("n_rows", "n_columns", "missing_cells", "clean_columns", "disguised_cells", "missing_pct"), 6)


_PAIRS = [(a, b) for i, a in enumerate(("balance", "nation_id", "segment", "revenue_text")) for b in ("balance", "nation_id", "segment", "revenue_text")[i + 1 :]]


@query("missing_correlated_pairs", _on("""select col_a, col_b, shared_rows, round(pct_of_a, 6) as pct_of_a, round(pct_of_b, 6) as pct_of_b from (""" + " union all ".join(
    f"""select '{a}' as col_a, '{b}' as col_b, count_if({a} is null and {b} is null) as shared_rows,
  100.0 * count_if({a} is null and {b} is null) / count_if({a} is null) as pct_of_a,
  100.0 * count_if({a} is null and {b} is null) / count_if({b} is null) as pct_of_b from {_CLEAN}""" for a, b in _PAIRS)
    + ") where shared_rows > 0 and (round(pct_of_a, 1) >= 50 or round(pct_of_b, 1) >= 50)"))
def correlated(spark, sf_dir):
    return rounded(cf.correlated_missing(dirty(spark, sf_dir)), 6)


@query("missing_sample_rows", _on(f"select * from {_CLEAN} where segment is null order by c_custkey limit 5"))
def sample_rows(spark, sf_dir):
    return cf.missing_rows(dirty(spark, sf_dir), "segment", ["c_custkey"])


@query("missing_numeric_summary", _on(per_column(("c_custkey", "balance", "nation_id"), f"""
select '{{c}}' as "column", count({{c}}) as count, round(avg({{c}}), 4) as mean, round(stddev_samp({{c}}), 4) as std, min({{c}})::double as min, max({{c}})::double as max from {_CLEAN}""")))
def numeric_summary(spark, sf_dir):
    return rounded(cf.numeric_summary(cf.hide_disguised(dirty(spark, sf_dir))))


@query("missing_categorical_summary", _on(per_column(("c_name", "segment", "revenue_text"), f"""
select * from (select '{{c}}' as "column", (row_number() over (order by count(*) desc, {{c}}))::int as rank, {{c}} as value, count(*) as n
from {_CLEAN} where {{c}} is not null group by {{c}} order by n desc, value limit 5)""")))
def categorical_summary(spark, sf_dir):
    return cf.categorical_summary(cf.hide_disguised(dirty(spark, sf_dir)))


def _mode(c: str) -> str:
    return f"(select {c} from {_CLEAN} where {c} is not null group by {c} order by count(*) desc, {c} limit 1)"


@query("missing_fill_options", _on(f"""
select 'balance' as "column", 'double' as dtype, count_if(balance is null) as missing_count, round(avg(balance), 4) as fill_mean,
  round(quantile_cont(balance, 0.5), 4) as fill_median, count_if(balance = {_mode('balance')}) as mode_rows from {_CLEAN}
union all select 'nation_id', 'int', count_if(nation_id is null), round(avg(nation_id), 4), quantile_cont(nation_id::double, 0.5), count_if(nation_id = {_mode('nation_id')}) from {_CLEAN}
union all select 'segment', 'string', count_if(segment is null), null, null, count_if(segment = {_mode('segment')}) from {_CLEAN}
union all select 'revenue_text', 'string', count_if(revenue_text is null), null, null, count_if(revenue_text = {_mode('revenue_text')}) from {_CLEAN}"""))
def fill_options(spark, sf_dir):
    """The mode's text form differs between engines for doubles, so the rows it matches are compared."""
    df = cf.hide_disguised(dirty(spark, sf_dir))
    options = cf.fill_options(df)
    modes = {r["column"]: r["fill_mode"] for r in options.collect()}
    matched = df.agg(*[F.count_if(F.col(c) == F.lit(v).cast(df.schema[c].dataType)).alias(c) for c, v in modes.items()])
    rows = matched.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("mode_rows")) for c in modes])))
    return rounded(options.drop("fill_mode")).join(rows, "column")


def _fix(name: str, plan: dict, sql: str, digits: int = 4):
    @query(f"missing_{name}", _on(sql))
    def run(spark, sf_dir):
        return rounded(cf.fix_missing(dirty(spark, sf_dir), plan).df, digits)


def _row(**changed: str) -> str:
    return ", ".join(f"{changed[c]} as {c}" if c in changed else c for c in _ALL)


_fix("fill_mean", {"balance": {"method": "fill_mean"}, "nation_id": {"method": "fill_mean"}},
     f"select {_row(balance=f'round(coalesce(balance, (select avg(balance) from {_CLEAN})), 4)', nation_id=f'round(coalesce(nation_id::double, (select avg(nation_id) from {_CLEAN})), 4)')} from {_CLEAN}")
_fix("fill_median", {"balance": {"method": "fill_median"}},
     f"select {_row(balance=f'round(coalesce(balance, (select quantile_cont(balance, 0.5) from {_CLEAN})), 4)')} from {_CLEAN}")
_fix("fill_mode", {"segment": {"method": "fill_mode"}, "nation_id": {"method": "fill_mode"}, "balance": {"method": "fill_mode"}},
     f"select {_row(segment=f'coalesce(segment, ' + _mode('segment') + ')', nation_id='coalesce(nation_id, ' + _mode('nation_id') + ')', balance='round(coalesce(balance, ' + _mode('balance') + '), 4)')} from {_CLEAN}")
_fix("fill_custom", {"segment": {"method": "fill_custom", "value": "OTHER"}, "balance": {"method": "fill_custom", "value": -1.5}},
     f"select {_row(segment=chr(39).join(['coalesce(segment, ', 'OTHER', ')']), balance='round(coalesce(balance, -1.5), 4)')} from {_CLEAN}")
_fix("fill_custom_text_in_number", {"nation_id": {"method": "fill_custom", "value": "none"}},
     f"select {_row(nation_id=chr(39).join(['coalesce(nation_id::varchar, ', 'none', ')']), balance='round(balance, 4)')} from {_CLEAN}")
_fix("drop_rows", {"segment": {"method": "drop_rows"}}, f"select * from {_CLEAN} where segment is not null")
_fix("drop_column", {"revenue_text": {"method": "drop_column"}}, f"select c_custkey, c_name, balance, nation_id, segment from {_CLEAN}")
_fix("fix_plan", {"nation_id": {"method": "drop_rows"}, "balance": {"method": "fill_mean"}, "revenue_text": {"method": "drop_column"},
                  "segment": {"method": "do_nothing"}, "c_name": {"method": "fill_mean"}, "nope": {"method": "fill_mode"}},
     f"select c_custkey, c_name, round(coalesce(balance, (select avg(balance) from {_CLEAN})), 4) as balance, nation_id, segment from {_CLEAN} where nation_id is not null")


@query("missing_distribution_change", _on(f"""
select 'balance' as "column", count(balance) as count_before, count(filled) as count_after, count(*) - count(balance) as filled,
  round(avg(balance), 4) as mean_before, round(avg(filled), 4) as mean_after, round(stddev_samp(balance), 4) as std_before, round(stddev_samp(filled), 4) as std_after,
  round(stddev_samp(filled) - stddev_samp(balance), 4) as std_delta, abs(round(avg(filled) - avg(balance), 4)) >= 0.01 as mean_changed
from (select balance, coalesce(balance, (select quantile_cont(balance, 0.5) from {_CLEAN})) as filled from {_CLEAN})"""))
def distribution_change(spark, sf_dir):
    before = dirty(spark, sf_dir)
    after = cf.fix_missing(before, {"balance": {"method": "fill_median"}}).df
    change = cf.distribution_change(before, after, ["balance"])
    return rounded(change.select("column", "count_before", "count_after", "filled", "mean_before", "mean_after", "std_before", "std_after", "std_delta", "mean_changed"))


@query("missing_top_values_change", _on(f"""
select 'segment' as "column", (select string_agg(segment, '|' order by n desc, segment) from (select segment, count(*) n from {_CLEAN} where segment is not null group by 1 order by n desc, segment limit 5)) as top_before,
  (select string_agg(segment, '|' order by n desc, segment) from (select coalesce(segment, 'OTHER') as segment, count(*) n from {_CLEAN} group by 1 order by n desc, segment limit 5)) as top_after, true as top_changed"""))
def top_values_change(spark, sf_dir):
    before = cf.hide_disguised(dirty(spark, sf_dir))
    after = cf.fix_missing(before, {"segment": {"method": "fill_custom", "value": "OTHER"}}).df
    change = cf.top_values_change(before, after, ["segment"])
    return change.withColumns({c: F.array_join(c, "|") for c in ("top_before", "top_after")})


@query("missing_report_documents", "select * from (" + per_column(("doc_id", "text", "lang", "source", "n_chars"),
       f"""select '{{c}}' as "column", count_if({{c}} is null or lower(trim({{c}}::varchar)) in {_TOKENS}) as missing_count from documents""") + ") where missing_count > 0")
def report_documents(spark, sf_dir):
    """Whole texts of the documents table."""
    return cf.missing_report(table(spark, sf_dir, "documents")).select("column", "missing_count")
