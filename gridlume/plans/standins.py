"""Reports, places and streets made of the driver's tables by plain arithmetic, which SQL can repeat.

Each function gives the Spark side; ``SQL`` holds the same as text to put into the twins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlume.sources.landing import tables

# Street beginnings for made-up addresses.
PREFIXES = ("R. DE ", "BD ", "BLD. ", "AVE ", "PL. DU ", "IMP ", "SQ. ", "RUE ST ", "PAS. STE ", "/ ET R FBG ", "AV É")


def street_text(key: str, name: str) -> str:
    """SQL (both dialects) of a raw street: number, abbreviated type, name."""
    cases = " ".join(f"when {k} then '{p}'" for k, p in enumerate(PREFIXES))
    return f"concat(cast({key} % 150 as string), case {key} % 3 when 0 then ' ' when 1 then 'B ' else ' 5 ' end, case {key} % {len(PREFIXES)} {cases} end, replace(lower({name}), '#', ' (é) '))"


LOCATION = f"concat({street_text('c_custkey', 'c_name')}, case c_custkey % 4 when 0 then '' when 1 then concat(', Paris ', cast(c_nationkey as string), ' (', cast(75000 + c_nationkey as string), ')') when 2 then ', la VILLE du bois' else concat(' 75', lpad(cast(c_nationkey as string), 3, '0')) end)"

#: Incidents: an order's lines; seq within the order.
INCIDENTS = """
select l_orderkey as okey, l_suppkey as skey, cast(row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate) as bigint) as seq,
  l_returnflag as flag, cast(l_quantity as double) as households,
  case when l_linenumber % 5 = 0 then '' when l_linenumber % 7 = 0 then 'x' else {start} end as start,
  case when l_linenumber % 3 = 0 then '' else {start} end as restore,
  case when l_linenumber % 2 = 0 then null else l_linestatus end as state
from lineitem
"""
SPARK_INCIDENTS = INCIDENTS.format(start="date_format(cast(l_shipdate as timestamp), 'dd/MM/yyyy HH:mm')")
DUCK_INCIDENTS = INCIDENTS.format(start="strftime(l_shipdate, '%d/%m/%Y %H:%M')")


def register(spark: SparkSession, path: str, *names: str) -> None:
    for name, df in zip(names, tables(spark, path, *names), strict=True):
        df.createOrReplaceTempView(name)


def sql(spark: SparkSession, path: str, text: str, *names: str) -> DataFrame:
    """A Spark SQL text over driver tables."""
    return spark.sql(text, **{n: df for n, df in zip(names, tables(spark, path, *names), strict=True)})


def incidents(spark: SparkSession, path: str) -> DataFrame:
    lines = tables(spark, path, "lineitem")[0]
    return spark.sql(SPARK_INCIDENTS.replace("from lineitem", "from {lineitem}"), lineitem=lines)


def addresses(spark: SparkSession, path: str) -> DataFrame:
    """One address row a customer, with the incident it belongs to.

    Rows are few bytes in the file but much work each, so they are dealt to all cores by key instead of by the file's splits (a number
    that is given is not coalesced by size).
    """
    customers = tables(spark, path, "customer")[0].repartition(2 * spark.sparkContext.defaultParallelism, "c_custkey")
    return customers.select(
        F.col("c_custkey").alias("seq"), F.expr(LOCATION).alias("location"), F.expr("case when c_custkey % 6 = 0 then '' else 'Lyon' end").alias("city"),
        F.expr("case when c_custkey % 9 = 0 then '' else concat('i', cast(c_custkey % 40 as string)) end").alias("id"), F.expr("case when c_custkey % 5 = 0 then null else c_mktsegment end").alias("raw_type"),
        F.expr("concat(lpad(cast(1 + c_custkey % 31 as string), 2, '0'), '/0', cast(1 + c_custkey % 9 as string), '/2025 10:00')").alias("start"),
        F.expr("case when c_custkey % 7 = 0 then '' else concat(lpad(cast(1 + c_custkey % 28 as string), 2, '0'), '/10/2025 1', cast(c_custkey % 10 as string), ':30') end").alias("restore"),
        F.expr("cast(c_custkey % 13 as double)").alias("households"),
    )
