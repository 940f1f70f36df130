"""Schemas of the stored tables and of extracted postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "timestamp": T.TimestampType(), "boolean": T.BooleanType()}


def _fields(text: str) -> T.StructType:
    """A schema of simple types, without a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in text.split(","))])


JOBS = _fields(
    "id long, site_name string, url string, title string, description string, location string, posted_date string, discovered_date timestamp, keywords string, salary string, job_type string, details_scraped boolean, last_seen_date timestamp, stale boolean"
)
SITE_HEALTH = _fields("id long, site_name string, scrape_date timestamp, success boolean, jobs_found int, error_message string, http_status int")
SITE_PARSERS = _fields("id long, site_name string, parser_config string, created_date timestamp, last_updated timestamp")
SITES = _fields("site_name string, url string, active string, keywords string, scrape_details string")
CANDIDATES = _fields("id string, name string, url string, category string, description string, ats_type string, job_count string, date_added string, status string")
POSTING = _fields("position int, title string, url string, description string, location string, salary string, job_type string, posted_date string, department string")
EXPORT_COLUMNS = ["id", "site_name", "url", "title", "description", "location", "posted_date", "discovered_date", "keywords", "salary", "job_type"]


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Bring a table to a schema: columns it lacks are added as nulls, others are cast, additional ones dropped."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
