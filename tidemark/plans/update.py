"""The update cycle over one set of tables, as pure functions and an explicit time."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import text as X
from tidemark.operators import extract, health, jobs
from tidemark.sources import registry
from tidemark.tables import through_table


@dataclass
class State:
    """The stored tables."""

    jobs: DataFrame
    health: DataFrame
    parsers: DataFrame


def scraped(sites: DataFrame, pages: DataFrame, parsers: DataFrame) -> DataFrame:
    """Postings of the sites' pages (url, html), with site_name, keywords and arrival order; a written table, so that
    pages are parsed once."""
    own = registry.with_config(sites, parsers).join(pages.select("url", "html"), "url")
    found = extract.extract_jobs(own.select("site_name", "keywords", "scrape_details", F.col("position").alias("site_position"), "url", "html", "parser_config"))
    return through_table(found.withColumn("arrival", F.col("site_position") * F.lit(1_000_000) + F.col("position")), "scraped")


def detailed(found: DataFrame, fetch: Callable[[DataFrame], DataFrame], detail_limit: int = 20) -> DataFrame:
    """Of sites that ask for details, the first postings only, those without a description filled from their own page;
    all postings of others. `fetch` gives the pages (url, html) of a frame of urls."""
    asks = F.lower(F.coalesce("scrape_details", F.lit(""))) == "yes"
    place = Window.partitionBy("site_name").orderBy("position")
    first = found.where(asks).withColumn("_k", F.row_number().over(place)).where(F.col("_k") <= detail_limit).drop("_k")
    wanted = first.where(X.blank(F.col("url")).isNotNull() & X.blank(F.col("description")).isNull()).select("url").distinct()
    pages = fetch(wanted).select("url", F.col("html").alias("_html")).where("_html is not null").dropDuplicates(["url"])
    details = through_table(pages.lateralJoin(extract.ExtractDetails(F.col("_html").outer())).drop("_html"), "details")
    return jobs.with_details(first, details, detail_limit).unionByName(found.where(~asks))


def health_rows(sites: DataFrame, pages: DataFrame, found: DataFrame, now: dt.datetime, strict: bool = False) -> DataFrame:
    """One outcome for each site. A page that couldn't be fetched counts as a success without postings, unless strict."""
    counts = found.groupBy("site_name").agg(F.count(F.lit(1)).cast("int").alias("jobs_found"))
    both = sites.join(pages.select("url", F.col("html").isNotNull().alias("_fetched")), "url", "left").join(counts, "site_name", "left")
    good = F.coalesce("_fetched", F.lit(False)) | F.lit(not strict)
    return both.select("site_name", F.lit(now).alias("scrape_date"), good.alias("success"), F.coalesce("jobs_found", F.lit(0)).alias("jobs_found"), F.when(~good, "page not fetched").alias("error_message"), F.lit(None).cast("int").alias("http_status"))


def cycle(state: State, sites: DataFrame, pages: DataFrame, now: dt.datetime, keep_days: int = 90, stale_days: int = 30, detail_limit: int = 20, strict: bool = False, fetch: Callable[[DataFrame], DataFrame] | None = None) -> tuple[State, DataFrame]:
    """Retention and staleness first, then the scrape: details, keyword filter, duplicates, insertion, marks, health log.

    `fetch` gives the detail pages (url, html) of a frame of urls; without it details are taken from `pages`.

    Returns the new tables and the rows that were added.
    """
    today = now.date()
    kept = jobs.mark_stale(jobs.retain(schemas.conform(state.jobs, schemas.JOBS), today, keep_days), today, stale_days)
    log = health.keep_recent(state.health, today)
    found = scraped(sites, pages, state.parsers)
    more = detailed(found, fetch or (lambda urls: pages.join(urls, "url", "left_semi")), detail_limit)
    wanted = through_table(more.withColumn("salary", X.backfilled_salary(F.col("salary"), F.col("description"))), "wanted")
    batch = wanted.where(X.passes_keywords(F.col("keywords"), F.col("title"), F.col("description")))
    added = through_table(jobs.accept_new(batch, kept, today), "accepted")
    everything = jobs.insert(kept, added, now)
    marked = jobs.mark_seen(everything, wanted.select("url"), now)
    return State(marked, health.append(log, health_rows(sites, pages, found, now, strict)), state.parsers), added
