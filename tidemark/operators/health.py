"""Site health: summary, failing sites, retention, appending."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import dates as D
from tidemark.tables import numbered


def summary(health: DataFrame, as_of: dt.date, days: int = 7) -> DataFrame:
    """Per site over the last days (by date): attempts, successes, failures, postings, last attempt; most failures first."""
    recent = health.where(D.from_day("scrape_date", as_of, days))
    rows = recent.groupBy("site_name").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if("success").alias("successes"),
        F.count_if(~F.col("success")).alias("failures"),
        F.sum(F.col("jobs_found").cast("long")).alias("jobs_found"),
        F.max("scrape_date").alias("last_attempt"),
    )
    return rows.orderBy(F.desc("failures"), "site_name")


def failing_sites(health: DataFrame, threshold: int = 3) -> DataFrame:
    """Sites whose newest `threshold` attempts all failed; the reported streak is the threshold itself."""
    newest = Window.partitionBy("site_name").orderBy(F.desc("scrape_date"), F.desc("id"))
    last = health.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= threshold)
    rows = last.groupBy("site_name").agg(
        F.count(F.lit(1)).alias("_n"),
        F.bool_or("success").alias("_ok"),
        F.min_by("error_message", "_rank").alias("last_error"),
        F.max("scrape_date").alias("last_attempt"),
        F.min_by("http_status", "_rank").alias("http_status"),
    )
    return rows.where((F.col("_n") == threshold) & ~F.col("_ok")).select("site_name", F.lit(threshold).alias("consecutive_failures"), "last_error", "last_attempt", "http_status")


def keep_recent(health: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """Retention: rows from before as_of - days go."""
    return health.where(~D.before_day("scrape_date", as_of, days))


def append(health: DataFrame, rows: DataFrame) -> DataFrame:
    """The log with new rows, which get the next ids."""
    new = schemas.conform(rows, schemas.SITE_HEALTH)
    start = F.broadcast(health.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_start")))
    own = numbered(new, [F.col("scrape_date"), F.col("site_name")]).join(start).withColumn("id", (F.col("_start") + F.col("_number")).cast("long"))
    return health.unionByName(own.select(*health.columns))
