"""Loans made of the star-schema test tables: an order is a loan, a line item a month of its history. Every 97th loan
has another id among the acquisitions, so that joins meet rows without a partner on both sides.

The SQL runs unchanged on Spark and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import ACQUISITION, PERFORMANCE

ACQUISITION_SQL = """
select concat(case when o_orderkey % 97 = 0 then 'X' else 'L' end, lpad(cast(o_orderkey as string), 9, '0')) as loan_id,
  case o_orderpriority when '1-URGENT' then 'R' when '2-HIGH' then 'C' when '3-MEDIUM' then 'B' when '5-LOW' then 'T' end as channel,
  4.0E0 + (o_orderkey % 300) / 100.0E0 + (year(o_orderdate) - 1995) * 0.15E0 as orig_rate,
  case when o_orderkey % 89 = 0 then 0.0E0 else o_totalprice end as orig_upb,
  make_date(cast(year(o_orderdate) as int), cast(month(o_orderdate) as int), 1) as orig_date,
  40.0E0 + (o_orderkey * 7) % 58 as oltv,
  case when o_orderkey % 5 <> 0 then 40.0E0 + (o_orderkey * 7) % 58 + (o_orderkey % 3) * 5 end as ocltv,
  cast(case when o_orderkey % 17 <> 0 then 1 + o_orderkey % 2 end as int) as num_borrowers,
  case when o_orderkey % 53 <> 0 then 10.0E0 + (o_orderkey * 13) % 55 end as dti,
  cast(case when o_orderkey % 61 <> 0 then 580 + floor((c_acctbal + 1000.0E0) / 11000.0E0 * 240) end as int) as fico,
  case o_orderstatus when 'F' then 'Y' when 'O' then 'N' end as first_time_buyer,
  case c_mktsegment when 'BUILDING' then 'P' when 'AUTOMOBILE' then 'C' when 'MACHINERY' then 'R' when 'FURNITURE' then 'U' else 'Z' end as purpose,
  case o_orderkey % 6 when 0 then 'SF' when 1 then 'CO' when 2 then 'PU' when 3 then 'MH' when 4 then 'CP' end as property_type,
  case o_orderkey % 4 when 0 then 'P' when 1 then 'S' when 2 then 'I' else 'P' end as occupancy,
  n_name as state,
  case when (o_orderkey * 7) % 58 > 40 then 20.0E0 + o_orderkey % 16 end as mi_pct,
  cast(case when o_orderkey % 2 = 1 then 600 + o_orderkey % 200 end as int) as co_fico
from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey
"""
PERFORMANCE_SQL = """
select loan_id, make_date(cast(floor((months + loan_age) / 12.0E0) as int), cast((months + loan_age) % 12 + 1 as int), 1) as period, loan_age,
  case when bad then cast(l_linenumber - 1 as string) when l_returnflag = 'N' and l_linenumber = 7 then 'X' else '0' end as dlq_status,
  case when bad and l_linenumber = 7 then '09' when not bad and l_returnflag = 'N' and l_linenumber = 6 then '01' end as zb_code
from (select concat('L', lpad(cast(o_orderkey as string), 9, '0')) as loan_id, l_linenumber, l_returnflag,
    cast(abs((year(l_shipdate) * 12 + month(l_shipdate)) - (year(o_orderdate) * 12 + month(o_orderdate))) as int) as loan_age,
    cast(year(o_orderdate) * 12 + month(o_orderdate) - 1 as int) as months,
    l_returnflag = 'R' and 560 + l_quantity * 5 + (year(o_orderdate) - 1995) * 8 > 580 + (c_acctbal + 1000.0E0) / 11000.0E0 * 240 as bad
  from {lineitem} join {orders} on l_orderkey = o_orderkey join {customer} on o_custkey = c_custkey) as m
"""
TABLES = ("orders", "customer", "nation", "lineitem")


def _sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql})


def acquisitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, ACQUISITION_SQL)


def performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, PERFORMANCE_SQL)


def lines(df: DataFrame, layout: list[tuple[str, str]], planted: bool = False) -> DataFrame:
    """The rows as lines of a file. planted: loans ending in 007 lose a field and those ending in 013 get a broken
    number in their first whole-number field."""
    have = set(df.columns)
    number = next(name for name, kind in layout if kind == "int" and name in have)

    def token(name: str, kind: str):
        c = F.col(name) if name in have else F.lit(None).cast("string")
        text = F.date_format(c, {"month": "MM/yyyy", "day": "MM/dd/yyyy"}[kind]) if kind in ("month", "day") and name in have else c.cast("string")
        if planted and name == number:
            text = F.when(F.col("loan_id").endswith("013"), F.lit("n/a")).otherwise(text)
        return F.coalesce(text, F.lit(""))

    tokens = F.array(*[token(*x) for x in layout])
    if planted:
        tokens = F.when(F.col("loan_id").endswith("007"), F.slice(tokens, 1, len(layout) - 1)).otherwise(tokens)
    return df.select(F.array_join(tokens, "|").alias("value"))


def acquisition_lines(spark: SparkSession, sf_dir: str, planted: bool = False) -> DataFrame:
    return lines(acquisitions(spark, sf_dir), ACQUISITION, planted)


def performance_lines(spark: SparkSession, sf_dir: str, planted: bool = False) -> DataFrame:
    return lines(performance(spark, sf_dir), PERFORMANCE, planted)
