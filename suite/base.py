"""Registry of the runnable queries and the SQL each is checked against, over the given tables and views of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

# Dirty views of the clean tables; the same text runs in both engines.
VIEWS = {
    "dirty_customer": """
select c_custkey, c_name,
  case when c_custkey % 7 = 0 then null else c_acctbal end as balance,
  case when c_custkey % 7 = 0 or c_custkey % 31 = 0 then null else c_nationkey end as nation_id,
  case when c_custkey % 11 = 0 then 'N/A' when c_custkey % 13 = 0 then ' - '
       when c_custkey % 17 = 0 then cast(null as string)
       when c_custkey % 5 = 0 then lower(c_mktsegment)
       when c_custkey % 3 = 0 then '  ' || c_mktsegment || ' '
       else c_mktsegment end as segment,
  case when c_custkey % 19 = 0 then 'n.a.' else '$' || cast(c_custkey * 10 as string) || '.50' end as revenue_text
from customer""",
    "dup_events": """
select event_id, user_id, event_type, value from events
union all select event_id, user_id, event_type, value from events where event_id % 20 = 0
union all select event_id, user_id, event_type, value from events where event_id % 100 = 0""",
    "dated_orders": """
select o_orderkey,
  case when o_orderkey % 25 = 0 then 'TBD' else substr(cast(o_orderdate as string), 1, 10) end as order_text,
  substr(cast(o_orderdate as string), 9, 2) || '/' || substr(cast(o_orderdate as string), 6, 2) || '/' || substr(cast(o_orderdate as string), 1, 4) as order_dmy
from orders""",
    "people": """
select c_custkey as person_id,
  cast(1940 + c_custkey % 70 as int) as birth_year,
  cast(case when c_custkey % 9 = 0 then 200 else 2025 - (1940 + c_custkey % 70) end as int) as age,
  case when c_custkey % 15 = 0 then 110.0e0 else c_custkey % 100 + 0.5e0 end as pct_done,
  case when c_custkey % 21 = 0 then 'broken.at.mail' else 'user' || cast(c_custkey as string) || '@mail.example.org' end as email,
  case when c_custkey % 8 = 0 then '12345-67' else '555-123-' || substr(cast(10000 + c_custkey % 9000 as string), 2, 4) end as phone
from customer""",
    "ship_vs_order": """
select l_orderkey, l_linenumber, l_shipdate, o_orderdate from lineitem join orders on l_orderkey = o_orderkey""",
    "typed_text": """
select c_custkey,
  case when c_custkey % 23 = 0 then 'bad' else cast(c_custkey * 3 as string) end as mostly_int,
  cast(c_custkey as string) as all_int,
  cast(c_acctbal as string) as all_float,
  case when c_custkey % 4 = 0 then ' Yes' when c_custkey % 4 = 1 then 'false' when c_custkey % 4 = 2 then '1' else 'maybe' end as flag,
  case when c_custkey % 10 = 0 then 'hello' when c_custkey % 10 = 1 then '2024-01-05' when c_custkey % 10 = 2 then 'true' else cast(c_custkey as string) end as mixed,
  '$' || cast(c_custkey as string) || '.25' as money,
  cast(null as string) as nothing
from customer""",
}
USES = {
    "dirty_customer": ("customer",), "dup_events": ("events",), "dated_orders": ("orders",), "people": ("customer",),
    "ship_vs_order": ("lineitem", "orders"), "typed_text": ("customer",),
}


def query(name: str, sql: str | None = None):
    """Register a query, and the SQL that must return the same rows."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for base in USES[name]:
        table(spark, sf_dir, base).createOrReplaceTempView(base)
    return spark.sql(VIEWS[name])


def on(name: str, body: str) -> str:
    """Oracle SQL over a dirty view."""
    return f"with {name} as ({VIEWS[name]}) {body}"


def per_column(columns: Sequence[str], template: str) -> str:
    """One SELECT per column, united; {c} is the column name."""
    return " union all ".join(template.replace("{c}", c) for c in columns)


def rounded(df: DataFrame, digits: int = 4, only: Sequence[str] | None = None) -> DataFrame:
    """Round the double columns (or some), so that summation order does not show."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)] if only is None else only
    return df.withColumns({c: F.round(F.col(c), digits) for c in names}) if names else df


LINEITEM_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
EVENT_NUMBERS = ("event_id", "user_id", "value")
