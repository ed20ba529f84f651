"""Records derived from the star schema: one per customer and order year.

The text runs unchanged in Spark SQL and in DuckDB, so queries and their SQL
start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_D = "CAST({} AS DECIMAL(18,2))"

K1_SQL = f"""
WITH k1_line AS (
  SELECT o_custkey, CAST(year(o_orderdate) AS INT) AS y, o_orderstatus AS os, l_returnflag AS f, l_linestatus AS s,
    {_D.format("l_quantity")} AS q, {_D.format("l_extendedprice")} AS p, {_D.format("l_discount")} AS d, {_D.format("l_tax")} AS t
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), k1_sum AS (
  SELECT o_custkey, y, sum(q) AS q,
    sum(CASE WHEN f = 'N' THEN p * (1 - d) END) AS box1, sum(CASE WHEN f = 'R' THEN -p * d END) AS box2,
    sum(CASE WHEN f = 'A' AND s = 'F' THEN p * t END) AS guar, sum(CASE WHEN s = 'O' THEN p * t END) AS inte,
    sum(CASE WHEN f = 'A' THEN p * d END) AS odiv, sum(CASE WHEN f = 'A' AND s = 'O' THEN p * t END) AS qdiv,
    sum(CASE WHEN f = 'R' AND s = 'O' THEN p * 0.1 END) AS stg, sum(CASE WHEN f = 'R' AND s = 'F' THEN p * 0.2 END) AS ltg,
    sum(CASE WHEN f = 'N' AND s = 'F' THEN p * 0.05 END) AS s179, sum(p * 0.15) AS dist,
    sum(CASE WHEN os = 'F' THEN p * (1 - d) END) AS se, sum(CASE WHEN os = 'P' THEN p * t END) AS ftax
  FROM k1_line GROUP BY o_custkey, y
), k1_key AS (
  SELECT a.*,
    lpad(CAST(c_nationkey AS VARCHAR(9)), 2, '0') || '-' || lpad(CAST(ascii(c_mktsegment) AS VARCHAR(9)), 7, '0') AS ein,
    lpad(CAST(o_custkey AS VARCHAR(9)), 9, '0') AS tin9, c_name, c_mktsegment, c_nationkey
  FROM k1_sum a JOIN customer ON o_custkey = c_custkey
), k1_cap AS (
  SELECT *, 100000 + sum(coalesce(box1, 0) + coalesce(box2, 0) - coalesce(dist, 0)) OVER (PARTITION BY ein, o_custkey ORDER BY y ROWS UNBOUNDED PRECEDING) AS cap_end,
    coalesce(box1, 0) + coalesce(box2, 0) - coalesce(dist, 0) AS net
  FROM k1_key
), k1 AS (
  SELECT ein AS partnership_ein,
    substr(tin9, 1, 3) || '-' || substr(tin9, 4, 2) || '-' || substr(tin9, 6, 4) AS partner_tin,
    CAST(y AS VARCHAR(9)) AS tax_year,
    CASE WHEN o_custkey % 17 = 0 AND y % 3 = 0 THEN 'Fund ' || c_mktsegment || ' Holdings ' || CAST(c_nationkey AS VARCHAR(9))
         WHEN o_custkey % 19 = 0 THEN 'FUND ' || c_mktsegment || ' ' || CAST(c_nationkey AS VARCHAR(9))
         ELSE 'Fund ' || c_mktsegment || ' ' || CAST(c_nationkey AS VARCHAR(9)) END AS partnership_name,
    CASE WHEN (o_custkey + (CASE WHEN o_custkey % 11 = 0 THEN y ELSE 0 END)) % 2 = 0 THEN 'General Partner' ELSE 'Limited Partner' END AS partner_type,
    CAST(q * 0.06 AS DOUBLE) AS partner_share_percentage,
    CAST(round(box1, 2) AS DOUBLE) AS ordinary_business_income, CAST(round(box2, 2) AS DOUBLE) AS rental_real_estate_income,
    CAST(round(guar, 2) AS DOUBLE) AS guaranteed_payments, CAST(round(inte, 2) AS DOUBLE) AS interest_income,
    CAST(round(CASE WHEN o_custkey % 23 = 0 THEN NULL ELSE odiv END, 2) AS DOUBLE) AS ordinary_dividends, CAST(round(qdiv, 2) AS DOUBLE) AS qualified_dividends,
    CAST(round(stg, 2) AS DOUBLE) AS short_term_capital_gains, CAST(round(ltg, 2) AS DOUBLE) AS long_term_capital_gains,
    CAST(round(CASE WHEN o_custkey % 29 = 0 THEN box1 * 6 ELSE s179 END, 2) AS DOUBLE) AS section_179_deduction, CAST(round(dist, 2) AS DOUBLE) AS distributions,
    CAST(round(cap_end - net + (CASE WHEN o_custkey % 13 = 0 AND y % 2 = 0 THEN 500 ELSE 0 END), 2) AS DOUBLE) AS capital_account_beginning,
    CAST(round(cap_end, 2) AS DOUBLE) AS capital_account_ending, CAST(round(se, 2) AS DOUBLE) AS self_employment_earnings, CAST(round(ftax, 2) AS DOUBLE) AS foreign_taxes_paid,
    CAST(round(CASE WHEN o_custkey % 5 = 0 THEN box1 * 0.5 WHEN o_custkey % 5 < 3 THEN box1 END, 2) AS DOUBLE) AS qbi_deduction
  FROM k1_cap
)
"""

def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def k1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, "lineitem", "orders", "customer")
    return spark.sql(f"{K1_SQL} SELECT * FROM k1")
