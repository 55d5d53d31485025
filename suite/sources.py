"""Readers, writers and the version history, on files Spark writes from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cleanframe import VersionHistory, load, write_table
from cleanframe.sources.shared import shared_folder

from .base import query, table


def _scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}/{name}"


@query("read_parquet", "select * from customer")
def read_parquet(spark, sf_dir):
    return load(spark, f"{sf_dir}/customer.parquet")


@query("read_csv_skipping_long_rows", "select c_custkey, c_name, case when c_custkey % 7 = 0 then null else c_acctbal end as c_acctbal, "
       "c_mktsegment from customer where c_custkey % 50 <> 0")
def read_csv(spark, sf_dir):
    """Lines with a field too many are skipped, NA tokens are missing, types are inferred over all rows."""
    balance = F.when(F.col("c_custkey") % 7 == 0, "NA").otherwise(F.col("c_acctbal").cast("string"))
    extra = F.when(F.col("c_custkey") % 50 == 0, ",surplus").otherwise("")
    line = F.concat(F.concat_ws(",", "c_custkey", "c_name", balance, "c_mktsegment"), extra)
    path = _scratch(spark, "customer.csv")
    lines = table(spark, sf_dir, "customer").select(line.alias("c_custkey,c_name,c_acctbal,c_mktsegment"))
    lines.write.option("header", True).option("sep", "\x01").option("quote", "").csv(path)
    return load(spark, path)


@query("read_csv_quoted_breaks", "select c_custkey, c_name || chr(10) || 'second, \"line\"' as c_name, c_mktsegment from customer")
def read_csv_breaks(spark, sf_dir):
    """Line breaks, commas and quotes inside quotes."""
    path = _scratch(spark, "breaks.csv")
    broken = F.concat("c_name", F.lit("\n"), F.lit('second, "line"'))
    write_table(table(spark, sf_dir, "customer").select("c_custkey", broken.alias("c_name"), "c_mktsegment"), path, "csv")
    return load(spark, path)


@query("read_tsv", "select c_custkey, c_name, c_nationkey::bigint as c_nationkey, c_acctbal, c_mktsegment from customer")
def read_tsv(spark, sf_dir):
    path = _scratch(spark, "customer.tsv")
    write_table(table(spark, sf_dir, "customer"), path, "tsv")
    return load(spark, path)


@query("read_json", "select c_custkey, c_name, c_nationkey::bigint as c_nationkey, c_acctbal, c_mktsegment from customer")
def read_json(spark, sf_dir):
    path = _scratch(spark, "customer.json")
    write_table(table(spark, sf_dir, "customer"), path, "json")
    return load(spark, path)


@query("read_orc", "select * from orders")
def read_orc(spark, sf_dir):
    path = _scratch(spark, "orders.orc")
    write_table(table(spark, sf_dir, "orders"), path, "orc")
    return load(spark, path)


def _history(spark, sf_dir) -> VersionHistory:
    history = VersionHistory(spark, _scratch(spark, "history"))
    customer = table(spark, sf_dir, "customer")
    history.save("loaded", customer)
    history.save("positive balances", customer.filter("c_acctbal > 0"))
    history.save("keys only", customer.select("c_custkey"))
    return history


@query("version_save_and_list", """
select 1::bigint as version, 'loaded' as label, count(*) as n_rows, 5::bigint as n_columns from customer
union all select 2, 'positive balances', count(*), 5 from customer where c_acctbal > 0
union all select 3, 'keys only', count(*), 1 from customer""")
def version_list(spark, sf_dir):
    return _history(spark, sf_dir).list().drop("saved_at")


@query("version_restore", "select * from customer where c_acctbal > 0")
def version_restore(spark, sf_dir):
    return _history(spark, sf_dir).restore(2)
