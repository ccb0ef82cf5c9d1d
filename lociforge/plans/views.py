"""Genomic views derived from the driver's tables, in integer arithmetic that two engines agree on.

The text of each view is valid in Spark SQL and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLES = 8

VARIANTS_SQL = """
  select chrom, pos, '.' as id, pk, sk, ln,
    case when c in (15, 16) then concat(b0, tail) when c = 17 then concat(b0, 'A') when c = 18 then concat(b0, 'AC') else b0 end as ref,
    case when c < 10 then ts
         when c < 12 then case when b0 in ('A', 'G') then 'C' else 'A' end
         when c = 12 then concat(ts, ',', case when b0 in ('A', 'G') then 'C' else 'A' end)
         when c in (13, 14) then concat(b0, tail) when c in (15, 16) then b0
         when c in (17, 18) then concat(ts, 'T') else '<DEL>' end as alt
  from (
    select concat('chr', cast(1 + l_suppkey % 5 as varchar(10))) as chrom, cast(l_orderkey * 8 + l_linenumber as bigint) as pos,
           (l_partkey * 7 + l_linenumber * 3 + l_suppkey) % 20 as c,
           substr('ACGT', cast(1 + l_partkey % 4 as int), 1) as b0, substr('GTAC', cast(1 + l_partkey % 4 as int), 1) as ts,
           substr('ACGTTGCA', 1, cast(1 + l_orderkey % 8 as int)) as tail, l_partkey as pk, l_suppkey as sk, l_linenumber as ln
      from lineitem
  ) b"""


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chrom, pos, id, pk, sk, ln, ref, alt``; only the columns that the view uses are read."""
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return spark.sql(f"select * from ({VARIANTS_SQL.replace('from lineitem', 'from {lineitem}')})", lineitem=lineitem)


def with_calls(rows: DataFrame) -> DataFrame:
    """The same with ``calls``: an array of the samples' two calls, -1 for missing, as ``[[a0, a1], ...]``."""

    def call(s):
        missing = (F.col("pk") * 31 + F.col("sk") * 17 + F.col("ln") * 5 + s * 7) % 29 == 0
        a0 = ((F.col("pk") * 13 + F.col("sk") * 3 + s * s * 11) % 17 < 3).cast("int")
        a1 = ((F.col("pk") * 5 + F.col("ln") * 19 + s * 23) % 13 < 2).cast("int")
        return F.array(F.when(missing, -1).otherwise(a0), F.when(missing, -1).otherwise(a1))

    return rows.withColumn("calls", F.transform(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), call))


#: Rows of variants crossed with sample numbers, for DuckDB.
CALLS_SQL = f"""
  select v.*, s,
    case when (pk*31 + sk*17 + ln*5 + s*7) % 29 = 0 then -1 else cast((pk*13 + sk*3 + s*s*11) % 17 < 3 as int) end as a0,
    case when (pk*31 + sk*17 + ln*5 + s*7) % 29 = 0 then -1 else cast((pk*5 + ln*19 + s*23) % 13 < 2 as int) end as a1
  from variants v, (select unnest(range(0, {SAMPLES})) as s) t"""
