"""The registered jobs over the relational tables and the events, each with DuckDB SQL for its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.money import cents
from tidemill.operators.time_windows import event_time, table_sessions, window_counts
from tidemill.sources.tables import table


def revenue_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounted revenue by the customer's region. Line items are summed for each order before the join."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(cents("l_extendedprice") * (1 - cents("l_discount"))).alias("revenue")
    )
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return (
        orders.join(lines, "o_orderkey")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("r_name")
        .agg(F.sum("revenue").cast("decimal(38,4)").alias("revenue"))
    )


def event_windows_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts for each user."""
    return window_counts(event_time(table(spark, sf_dir, "events")), "1 hour")


def event_windows_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts for each user in windows of one hour that start every half hour."""
    return window_counts(event_time(table(spark, sf_dir, "events")), "1 hour", "30 minutes")


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with a gap of 30 minutes."""
    return table_sessions(event_time(table(spark, sf_dir, "events")))


QUERIES = {
    "revenue_by_region": revenue_by_region,
    "event_windows_tumbling": event_windows_tumbling,
    "event_windows_sliding": event_windows_sliding,
    "user_sessions": user_sessions,
}

_SUMS = "CAST(count(*) AS BIGINT) AS n_events, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DECIMAL(38,4)) AS sum_value"

ORACLE_SQL = {
    "revenue_by_region": """
        SELECT r_name, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))) AS DECIMAL(38,4)) AS revenue
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
    "event_windows_tumbling": f"SELECT user_id, date_trunc('hour', ts) AS window_start, {_SUMS} FROM events WHERE ts IS NOT NULL GROUP BY ALL",
    "event_windows_sliding": f"""
        SELECT user_id, window_start, {_SUMS} FROM (
          SELECT user_id, value, unnest([time_bucket(INTERVAL 30 minutes, ts), time_bucket(INTERVAL 30 minutes, ts) - INTERVAL 30 minutes]) AS window_start
          FROM events WHERE ts IS NOT NULL) GROUP BY ALL""",
    "user_sessions": """
        SELECT user_id, min(ts) AS session_start, max(ts) AS last_ts, CAST(count(*) AS BIGINT) AS n_events FROM (
          SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 30 minutes THEN 1 ELSE 0 END)
            OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s
          FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events WHERE ts IS NOT NULL))
        GROUP BY user_id, s""",
}
