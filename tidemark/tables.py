"""The star that the queries run over: postings, companies and their side tables, as views of the input tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

AS_OF = "TIMESTAMP '2001-08-02 00:00:00'"

#: Shared by the Spark views and the oracle's: expressions that both dialects read alike.
JOB_COLUMNS = [
    "o_orderkey AS id",
    "o_custkey AS company_id",
    "concat('ats_', CAST(o_orderkey AS VARCHAR(20))) AS external_id",
    "o_orderpriority AS role_category",
    "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END AS posted_at",
    "o_orderdate + INTERVAL 2 DAY AS first_seen_at",
    "o_orderdate + CASE o_orderkey % 3 WHEN 0 THEN INTERVAL 30 DAY WHEN 1 THEN INTERVAL 45 DAY ELSE INTERVAL 9 DAY END AS last_seen_at",
    "CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 60 DAY END AS removed_at",
    "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) END AS salary_min_annual",
    "CASE WHEN o_orderkey % 4 = 0 THEN 'EUR' ELSE 'USD' END AS salary_currency",
    "CASE o_orderkey % 5 WHEN 0 THEN 'Full-time' WHEN 1 THEN 'Part-time' WHEN 2 THEN 'Contract' WHEN 3 THEN 'Internship' END AS employment_type",
    "CASE o_orderkey % 6 WHEN 0 THEN 'Remote' WHEN 1 THEN 'Hybrid' WHEN 2 THEN 'Onsite' END AS workplace_type",
    "o_orderkey % 6 = 0 AS is_remote",
    "o_orderkey % 60 = 0 AS remote_worldwide",
    "CASE o_orderkey % 4 WHEN 0 THEN 'entry' WHEN 1 THEN 'senior' WHEN 2 THEN 'lead' END AS experience_level",
    "CASE o_orderkey % 9 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS visa_sponsorship",
    "CAST(o_orderkey % 200 AS BIGINT) AS title_key",
]
COMPANY_COLUMNS = [
    "c_custkey AS company_id",
    "c_name AS company_name",
    "c_mktsegment AS ats",
    "concat('board', CAST(c_custkey % 400 AS VARCHAR(20))) AS ats_slug",
    "c_nationkey AS nation_key",
    "CASE WHEN c_custkey % 10 = 0 THEN 'failed' WHEN c_custkey % 10 = 1 THEN 'pending' ELSE 'active' END AS company_status",
    "CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE TIMESTAMP '2001-08-01 00:00:00' + CASE c_custkey % 3 WHEN 0 THEN INTERVAL 23 HOUR WHEN 1 THEN INTERVAL 5 HOUR ELSE INTERVAL 11 HOUR END END AS last_synced_at",
]
JOBS = "(SELECT j.*, concat(p_name, ' ', lower(p_type)) AS title FROM (SELECT " + ", ".join(JOB_COLUMNS) + " FROM orders) j JOIN part ON p_partkey = title_key)"
COMPANIES = "(SELECT " + ", ".join(COMPANY_COLUMNS) + " FROM customer)"


class Tables:
    """Input tables and views by name, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def jobs(self) -> DataFrame:
        own = self.orders.selectExpr(*JOB_COLUMNS)
        titles = self.part.selectExpr("p_partkey AS title_key", "concat(p_name, ' ', lower(p_type)) AS title").filter("title_key < 200")
        return own.join(titles, "title_key").select(*own.columns, "title")

    @cached_property
    def postings(self) -> DataFrame:
        """Postings without titles: no join where a query needs none."""
        return self.orders.selectExpr(*JOB_COLUMNS)

    @cached_property
    def companies(self) -> DataFrame:
        return self.customer.selectExpr(*COMPANY_COLUMNS)


POSTINGS = "(SELECT " + ", ".join(JOB_COLUMNS) + " FROM orders)"
