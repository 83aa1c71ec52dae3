"""The given tables, and the dataset-shaped views of them that the queries use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.structured import text_of

ZONE = "America/New_York"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt_out(df: DataFrame) -> DataFrame:
    """The same rows, in as many tasks as shuffles have, however few splits their files have."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a transactions dataset: status stands for currency, priority for plan."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("sale_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderstatus").alias("currency"),
        F.expr("NULLIF(o_orderpriority, '4-NOT SPECIFIED')").alias("plan"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
        F.expr("CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) END").alias(
            "paid"
        ),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.to_date("o_orderdate").alias("day"),
    )


SALES = """sales AS (
  SELECT o_orderkey AS sale_id, o_custkey AS customer_id, o_orderstatus AS currency,
         NULLIF(o_orderpriority, '4-NOT SPECIFIED') AS plan,
         CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
         CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS paid,
         o_orderdate AS created_at, CAST(o_orderdate AS DATE) AS day
  FROM orders)"""


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a dataset of the six column types."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id"),
        F.col("user_id"),
        F.col("event_type"),
        F.col("value").cast("decimal(18,2)").alias("amount"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def portable(df: DataFrame) -> DataFrame:
    """Decimals, dates and instants as text; everything else as it is."""
    exact = (T.DecimalType, T.DateType, T.TimestampType)
    return df.select(
        *[
            text_of(F.col(f"`{f.name}`"), f.dataType).alias(f.name)
            if isinstance(f.dataType, exact)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def local_grain(granularity: str, instant: str) -> str:
    """SQL for the first local day of a grain, as text."""
    local = f"timezone('{ZONE}', timezone('UTC', {instant}))"
    return f"strftime(date_trunc('{granularity}', {local}), '%Y-%m-%d')"


def instant_text(expression: str) -> str:
    """SQL for an instant (a UTC timestamp) as text."""
    return f"strftime({expression}, '%Y-%m-%dT%H:%M:%S.%gZ')"
