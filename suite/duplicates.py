"""Duplicate rows."""

from __future__ import annotations

from pyspark.sql import functions as F

import cleanframe as cf

from .base import on, per_column, query, rounded, table, view

_GROUPS = "(select event_id, user_id, event_type, value, count(*) as copies from dup_events group by all)"


@query("duplicates_count", on("dup_events", f"""select sum(copies)::bigint as n_rows, sum(copies - 1)::bigint as duplicate_count,
  round(100.0 * sum(copies - 1) / sum(copies), 6) as duplicate_pct from {_GROUPS}"""))
def duplicate_count(spark, sf_dir):
    return rounded(cf.duplicate_count(view(spark, sf_dir, "dup_events")), 6)


@query("duplicates_samples", on("dup_events", f"""select event_id, user_id, event_type, value, copies - 1 as redundant_copies from {_GROUPS}
  where copies > 1 order by event_id limit 5"""))
def duplicate_samples(spark, sf_dir):
    return cf.duplicate_samples(view(spark, sf_dir, "dup_events"), ["event_id"])


@query("duplicates_identity_columns", "select * from (" + per_column(("l_orderkey", "l_linenumber"), """
select '{c}' as "column", count(*) - count(distinct {c}) as dup_count from lineitem""") + """) where dup_count > 0 and "column" = 'l_linenumber'""")
def identity_duplicates(spark, sf_dir):
    return cf.identity_duplicates(table(spark, sf_dir, "lineitem"))


@query("duplicates_identity_documents", """select 'doc_id' as "column", count(*) - count(distinct doc_id) as dup_count from documents having count(*) > count(distinct doc_id)
  union all select 'conv_id', count(*) - count(distinct conv_id) from conversations having count(*) > count(distinct conv_id)""")
def identity_documents(spark, sf_dir):
    return cf.identity_duplicates(table(spark, sf_dir, "documents")).unionByName(cf.identity_duplicates(table(spark, sf_dir, "conversations")))


@query("duplicates_keep_first", on("dup_events", "select distinct * from dup_events"))
def keep_first(spark, sf_dir):
    return cf.drop_duplicate_rows(view(spark, sf_dir, "dup_events"), "keep_first").df


@query("duplicates_keep_last", on("dup_events", "select distinct * from dup_events"))
def keep_last(spark, sf_dir):
    """On whole rows the first and the last copy are the same row."""
    return cf.drop_duplicate_rows(view(spark, sf_dir, "dup_events"), "keep_last").df


_REST = ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def _subset(direction: str) -> str:
    order = ", ".join(f"{c} {direction}" for c in ("l_shipdate", *_REST))
    return f"select * exclude (rn) from (select *, row_number() over (partition by l_orderkey, l_linenumber order by {order}) as rn from lineitem) where rn = 1"


@query("duplicates_keep_first_subset", _subset("asc"))
def keep_first_subset(spark, sf_dir):
    return cf.drop_duplicate_rows(table(spark, sf_dir, "lineitem"), "keep_first", ["l_orderkey", "l_linenumber"], ["l_shipdate"]).df


@query("duplicates_keep_last_subset", _subset("desc"))
def keep_last_subset(spark, sf_dir):
    return cf.drop_duplicate_rows(table(spark, sf_dir, "lineitem"), "keep_last", ["l_orderkey", "l_linenumber"], ["l_shipdate"]).df


@query("duplicates_drop_all", on("dup_events", f"select event_id, user_id, event_type, value from {_GROUPS} where copies = 1"))
def drop_all(spark, sf_dir):
    return cf.drop_duplicate_rows(view(spark, sf_dir, "dup_events"), "drop_all").df


@query("duplicates_drop_all_subset", "select * exclude (n) from (select *, count(*) over (partition by l_orderkey, l_linenumber) as n from lineitem) where n = 1")
def drop_all_subset(spark, sf_dir):
    return cf.drop_duplicate_rows(table(spark, sf_dir, "lineitem"), "drop_all", ["l_orderkey", "l_linenumber"]).df


@query("duplicates_drop_all_documents", "select * exclude (n) from (select *, count(*) over (partition by text) as n from documents) where n = 1")
def drop_all_documents(spark, sf_dir):
    """Every document whose whole text occurs once."""
    return cf.drop_duplicate_rows(table(spark, sf_dir, "documents"), "drop_all", ["text"]).df


@query("duplicates_impact", on("dup_events", """select count(value) as count_before, round(avg(value), 4) as mean_before, round(sum(value), 2) as sum_before,
  any_value(ca) as count_after, round(any_value(ma), 4) as mean_after, round(any_value(sa), 2) as sum_after from dup_events,
  (select count(value) as ca, avg(value) as ma, sum(value) as sa from (select distinct * from dup_events))"""))
def impact(spark, sf_dir):
    before = view(spark, sf_dir, "dup_events")
    after = cf.drop_duplicate_rows(before, "keep_first").df
    row = cf.deduplication_impact(before, after, "value")
    return row.select("count_before", "count_after", *[F.round(f"mean_{s}", 4).alias(f"mean_{s}") for s in ("before", "after")],
                      *[F.round(f"sum_{s}", 2).alias(f"sum_{s}") for s in ("before", "after")])


def _similar(values: str, percent: int) -> str:
    """Pairs of normal values by edit distance, each shown by its most frequent spelling, and the other spellings of a value."""
    return f"""
with spelled as (select s as spelling, lower(trim(regexp_replace(s, '\\s+', ' ', 'g'))) as normal, count(*) as n from ({values}) where s is not null group by all),
  normal as (select normal, arg_min(spelling, (-n, spelling)) as value, max(n) as own, sum(n)::bigint as n_rows, length(normal) as len from spelled where normal <> '' group by normal),
  pairs as (
    select a.value as va, b.value as vb, a.n_rows as ra, b.n_rows as rb, levenshtein(a.normal, b.normal) as distance, greatest(a.len, b.len) as len
    from normal a join normal b on a.value < b.value and abs(a.len - b.len) * 100 <= {100 - percent} * greatest(a.len, b.len))
select va as value_a, vb as value_b, ra as rows_a, rb as rows_b, distance::int as distance, round(100.0 - 100.0 * distance / len, 6) as similarity
from pairs where distance * 100 <= {100 - percent} * len
union all select value, spelling, own, n, 0, 100.0 from normal join spelled using (normal) where spelling <> value"""


_PART_TEXT = "p_name || ' ' || p_brand || case when p_partkey % 3 = 0 then '  ' || p_type when p_partkey % 5 = 0 then ' ' || lower(p_type) else ' ' || p_type end"


@query("duplicates_fuzzy_urls", _similar("select url as s from pages", 90))
def fuzzy_urls(spark, sf_dir):
    return rounded(cf.fuzzy_duplicates(table(spark, sf_dir, "pages"), "url", 90), 6)


@query("duplicates_fuzzy_parts", _similar(f"select {_PART_TEXT} as s from part", 92))
def fuzzy_parts(spark, sf_dir):
    """Descriptions of the same few words: many values share every segment."""
    parts = table(spark, sf_dir, "part").select(F.expr(_PART_TEXT).alias("description"))
    return rounded(cf.fuzzy_duplicates(parts, "description", 92), 6)


@query("duplicates_fuzzy_report", f"""with found as ({_similar("select url as s from pages", 95)})
select 'url' as "column", count(*) filter (where distance > 0) as n_pairs, count(*) filter (where distance = 0) as n_spellings,
  round(max(similarity) filter (where distance > 0), 6) as max_similarity,
  (select count(distinct v) from (select value_a as v from found where distance > 0 union all select value_b from found where distance > 0)) as n_values from found having count(*) > 0""")
def fuzzy_report(spark, sf_dir):
    return rounded(cf.fuzzy_report(table(spark, sf_dir, "pages"), ["url"], 95), 6)
