"""Feeds: item columns as a plan, a bounded number of rows rendered on the driver."""

from __future__ import annotations

import datetime as dt
import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import jobs as J


def items(jobs: DataFrame, with_site: bool = False, simple: bool = False, lexicon: dict | None = None) -> DataFrame:
    """Item columns of postings: title, url, site, summary, content, published, categories."""
    c = F.col
    when = F.coalesce(c("discovered_date"), X.iso_date(c("posted_date")))
    own_tags = X.tags(c("title"), c("description"), c("location"), c("job_type"), **(lexicon or {}))
    content = X.rich_content(c("location"), c("site_name"), c("job_type"), c("salary"), c("posted_date"), c("description"), c("keywords"), c("url"))
    return jobs.select(
        X.item_title(c("title"), c("site_name"), c("location"), with_site).alias("title"),
        "url",
        c("site_name").alias("site"),
        X.plain_summary(c("location"), c("job_type"), c("salary"), c("site_name"), c("description")).alias("summary"),
        (F.lit(None).cast("string") if simple else content).alias("content"),
        X.rfc822(when).alias("published"),
        X.categories(c("keywords"), c("site_name"), own_tags).alias("categories"),
    )


def plain_feed(jobs: DataFrame, limit: int = 100) -> DataFrame:
    """The newest postings, stale ones too."""
    return J.recent_jobs(jobs, limit)


def update_feed(jobs: DataFrame, limit: int = 100) -> DataFrame:
    """The newest postings, of which the stale ones then go, so there may be fewer."""
    return J.recent_jobs(jobs, limit).where(~F.coalesce("stale", F.lit(False)))


def preview_rows(jobs: DataFrame, limit: int = 50) -> DataFrame:
    c = F.col
    fields = X.preview_fields(c("title"), c("url"), c("site_name"), c("location"), c("description"), c("discovered_date").cast("string"))
    return J.recent_jobs(jobs, limit).select(*(v.alias(k) for k, v in fields.items()), X.escaped(F.coalesce("job_type", F.lit(""))).alias("job_type"), X.escaped(F.coalesce("salary", F.lit(""))).alias("salary"))


def summary_item(results: dict, alerts: list[dict], stale: int, link: str, now: dt.datetime) -> dict:
    """The item that reports on a run: counts, failed sites, alerts, and sites with new postings, most first."""
    good, bad = results["successful_sites"], results["failed_sites"]
    parts = ["<h3>Update Summary</h3>", f"<p>New Jobs Found: {results['total_new_jobs']}</p>", f"<p>Sites Checked: {good}/{good + bad}</p>"]
    if stale:
        parts.append(f"<p>Stale Listings Hidden: {stale}</p>")
    if bad:
        names = ", ".join(r["site_name"] for r in results["site_results"] if not r["success"])
        parts += [f"<p>Failed Sites: {bad}</p>", f"<p>{names}</p>"]
    if alerts:
        rows = (f"<li>{html.escape(a['site_name'])} — {a['consecutive_failures']} failures (last: {html.escape(a.get('last_error') or 'unknown error')})</li>" for a in alerts)
        parts.append(f"<div class='alerts'><strong>Site Health Alerts</strong><ul>{''.join(rows)}</ul></div>")
    new = sorted((r for r in results["site_results"] if r["success"] and r["new_jobs"] > 0), key=lambda r: -r["new_jobs"])
    if new:
        parts.append("<ul>" + "".join(f"<li>{r['site_name']}: {r['new_jobs']} new</li>" for r in new) + "</ul>")
    title = f"Update - {results['total_new_jobs']} New Jobs Found"
    if alerts:
        title += f" ({len(alerts)} site alert{'s' if len(alerts) != 1 else ''})"
    return {"title": title, "url": link, "site_name": "System Update", "description": "\n".join(parts), "discovered_date": now}


def wants_summary(results: dict, alerts: list[dict], include: bool = True) -> bool:
    return include and (results["total_new_jobs"] > 0 or bool(alerts))


def with_summary(jobs: DataFrame, summary: dict | None) -> DataFrame:
    """Feed rows with the report first; `ordinal` keeps the order."""
    feed = jobs.withColumn("ordinal", F.lit(1))
    if summary is None:
        return feed
    own = jobs.sparkSession.createDataFrame([tuple(summary.get(f.name) for f in jobs.schema)], jobs.schema).withColumn("ordinal", F.lit(0))
    return own.unionByName(feed)
