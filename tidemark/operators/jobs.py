"""State of postings: insertion, duplicates between sites, staleness, retention, enrichment, reading orders, counts."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import dates as D
from tidemark.functions import text as X
from tidemark.operators.graph import components
from tidemark.tables import numbered, through_table

TITLE_GATE = 10


def recent_jobs(jobs: DataFrame, limit: int = 100) -> DataFrame:
    return jobs.orderBy(F.desc("discovered_date"), F.desc("id")).limit(limit)


def new_since(jobs: DataFrame, since: dt.datetime) -> DataFrame:
    return jobs.where(F.col("discovered_date") > F.lit(since)).orderBy(F.desc("discovered_date"), F.desc("id"))


def missing_details(jobs: DataFrame, limit: int = 50) -> DataFrame:
    return jobs.where(~F.coalesce("details_scraped", F.lit(False))).orderBy(F.desc("discovered_date"), F.desc("id")).limit(limit)


def exists(jobs: DataFrame, urls: DataFrame) -> DataFrame:
    """The urls (column url) that are stored."""
    return urls.join(jobs.select("url"), "url", "left_semi")


def stats(jobs: DataFrame, as_of: dt.date) -> DataFrame:
    """Total, found today, sites, found in the last seven days; one pass."""
    return jobs.agg(
        F.count(F.lit(1)).alias("total_jobs"),
        F.count_if(D.on_day("discovered_date", as_of)).alias("jobs_today"),
        F.count_distinct("site_name").alias("sites"),
        F.count_if(D.from_day("discovered_date", as_of, 7)).alias("jobs_week"),
    )


def retain(jobs: DataFrame, as_of: dt.date, days: int = 90) -> DataFrame:
    """Rows that were discovered before as_of - days go."""
    return jobs.where(~D.before_day("discovered_date", as_of, days))


def mark_stale(jobs: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """Rows that aren't stale and were last seen before as_of - days become stale; a null mark stays."""
    gone = (F.col("stale") == F.lit(False)) & F.col("last_seen_date").isNotNull() & D.before_day("last_seen_date", as_of, days)
    return jobs.withColumn("stale", F.when(gone, True).otherwise(F.col("stale")))


def stale_jobs(jobs: DataFrame, limit: int = 100) -> DataFrame:
    return jobs.where("stale").orderBy(F.asc_nulls_first("last_seen_date"), "id").limit(limit)


def stale_count(jobs: DataFrame, limit: int = 100) -> DataFrame:
    """Number of stale rows, at most `limit`."""
    return jobs.where("stale").limit(limit).agg(F.count(F.lit(1)).alias("stale_count"))


def mark_seen(jobs: DataFrame, urls: DataFrame, now: dt.datetime) -> DataFrame:
    """Rows with a listed url (column url) were seen now and aren't stale."""
    seen = urls.select(F.col("url").alias("_url")).distinct().withColumn("_seen", F.lit(True))
    both = jobs.join(seen, F.col("url") == F.col("_url"), "left")
    changed = {"last_seen_date": F.lit(now), "stale": F.lit(False)}
    return both.select(*(F.when(F.col("_seen"), changed[c]).otherwise(F.col(c)).cast(jobs.schema[c].dataType).alias(c) if c in changed else F.col(c) for c in jobs.columns))


def update_details(jobs: DataFrame, details: DataFrame) -> DataFrame:
    """Columns of details (by url, one row each) replace those of jobs where they aren't null; such rows are marked."""
    fields = [c for c in ("description", "location", "salary", "job_type", "posted_date") if c in details.columns]
    own = details.select(F.col("url").alias("_url"), *(F.col(c).alias(f"_{c}") for c in fields), F.lit(True).alias("_hit"))
    both = jobs.join(own, F.col("url") == F.col("_url"), "left")

    def column(c: str) -> Column:
        if c in fields:
            return F.coalesce(f"_{c}", c).alias(c)
        return F.when(F.col("_hit"), True).otherwise(F.col(c)).alias(c) if c == "details_scraped" else F.col(c)

    return both.select(*map(column, jobs.columns))


def with_details(batch: DataFrame, details: DataFrame, per_site: int = 20) -> DataFrame:
    """The first postings of each site, those without description filled from their detail page (details by url)."""
    place = Window.partitionBy("site_name").orderBy("position")
    first = batch.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= per_site).drop("_place")
    fields = [c for c in details.columns if c in batch.columns and c != "url"]
    own = details.select(F.col("url").alias("_url"), *(F.col(c).alias(f"_{c}") for c in fields))
    both = first.join(own, (F.col("url") == F.col("_url")) & X.blank(F.col("description")).isNull(), "left")
    return both.select(*(F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in batch.columns))


def recent_history(jobs: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    return jobs.where(D.from_day("discovered_date", as_of, days))


def title_matches(batch: DataFrame, jobs: DataFrame, as_of: dt.date, days: int = 30, scan: int | None = 500) -> DataFrame:
    """For each batch row whose title is found at another site: match_url and match_site of the newest such posting.

    `scan`: only the newest so many recent postings of other sites are looked at, as seen from the row's site. With no
    more than so many of any site, these are among the newest 2 * scan of all, so only that many rows are ranked; a rank
    among other sites is the rank among all less the own site's postings before it. Of each title the newest posting
    and the newest of any other site decide for every row.
    """
    history = recent_history(jobs, as_of, days).select(F.col("id").alias("_id"), F.col("site_name").alias("match_site"), F.col("url").alias("match_url"), F.col("discovered_date").alias("_found"), X.normal_title(F.col("title")).alias("_title"))
    order = (F.desc("_found"), F.desc("_id"))
    own = batch.withColumn("_title", X.normal_title(F.col("title"))).where(F.length("_title") >= TITLE_GATE)
    if scan is None:
        ranked = history.withColumn("_rank", F.lit(0))
        own = own.withColumn("_ranks", F.array().cast("array<int>"))
    else:
        kept = history.withColumn("_own", F.row_number().over(Window.partitionBy("match_site").orderBy(*order))).where(F.col("_own") <= scan).drop("_own")
        newest = kept.orderBy(*order).limit(2 * scan)
        ranked = newest.withColumn("_rank", F.row_number().over(Window.orderBy(*order)))
        ranks = ranked.groupBy(F.col("match_site").alias("site_name")).agg(F.collect_list("_rank").alias("_ranks"))
        own = own.join(F.broadcast(ranks), "site_name", "left")
    one = ranked.groupBy("_title", "match_site").agg(F.max(F.struct("_found", "_id", "match_url", "_rank")).alias("_top"))
    two = one.withColumn("_k", F.row_number().over(Window.partitionBy("_title").orderBy(F.desc("_top")))).where("_k <= 2")
    pick = lambda k: F.max(F.when(F.col("_k") == k, F.struct("match_site", "_top")))
    titles = two.groupBy("_title").agg(pick(1).alias("_first"), pick(2).alias("_second"))
    other = F.when(F.col("_first.match_site") != F.col("site_name"), F.col("_first")).otherwise(F.col("_second"))
    found = own.join(titles if scan is None else F.broadcast(titles), "_title").withColumn("_match", other).where("_match is not null")
    if scan is not None:
        before = F.size(F.filter(F.coalesce("_ranks", F.array().cast("array<int>")), lambda r: r < F.col("_match._top._rank")))
        found = found.where(F.col("_match._top._rank") - before <= scan)
    return found.select(*batch.columns, F.col("_match._top.match_url").alias("match_url"), F.col("_match.match_site").alias("match_site"))


def accept_new(batch: DataFrame, jobs: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """Batch rows that become new postings; batch has site_name, url, title and arrival (a unique order).

    In arrival order a row is refused if its url is stored, or if its title (of TITLE_GATE characters) is held by
    another site. As a set rule: a title's owner is the one site that holds it in recent history, nobody if several do,
    else the site of its first arrival; then the first arrival of each url stays. Titles that are tied together by a
    shared url can depend on each other in arrival order, so those few are folded in order, group by group; a row whose
    title is too short to be compared is a title of its own. Of rows equal in title, url and site only the first counts.
    """
    title = X.normal_title(F.col("title"))
    slim = batch.join(jobs.select("url").distinct(), "url", "left_anti").select("url", "site_name", "arrival", title.alias("_title"))
    first = F.when(F.length("_title") < TITLE_GATE, F.concat(F.lit("#"), F.col("arrival").cast("string")))  # no title holds a #
    rows = slim.groupBy(F.coalesce(first, "_title").alias("_title"), "url", "site_name").agg(F.min("arrival").alias("arrival"))
    history = recent_history(jobs, as_of, days).select(title.alias("_title"), "site_name").where(F.length("_title") >= TITLE_GATE)
    holders = history.groupBy("_title").agg(F.min("site_name").alias("_holder"), F.max("site_name").alias("_other"))
    rows = through_table(rows.join(holders, "_title", "left"), "arrivals")
    shared = rows.groupBy("url").agg(F.min("_title").alias("_a"), F.max("_title").alias("_b")).where("_a != _b").select("url")
    ties = rows.join(shared, "url", "left_semi").select("_title", "url").distinct()
    tied = ties.select("_title").distinct()
    simple, knotted = rows.join(tied, "_title", "left_anti"), rows.join(tied, "_title", "left_semi")
    firsts = simple.groupBy("_title").agg(F.min_by("site_name", "arrival").alias("_site"))
    owner = F.when(F.col("_holder").isNull(), F.col("_site")).when(F.col("_holder") == F.col("_other"), F.col("_holder"))
    accepted = simple.join(firsts, "_title").where(F.col("_title").startswith("#") | (F.col("site_name") == owner))
    chosen = accepted.groupBy("url").agg(F.min("arrival").alias("arrival")).select("arrival").unionAll(_folded(knotted, ties))
    return batch.join(chosen, "arrival", "left_semi").select(*batch.columns)


def _folded(rows: DataFrame, ties: DataFrame) -> DataFrame:
    """arrival of the accepted rows of knotted titles, in order within each group that shared urls tie together."""
    ids = through_table(ties.select("_title").distinct().withColumn("_id", F.monotonically_increasing_id()), "knotted-titles")
    known = ties.join(ids, "_title")
    least = known.groupBy("url").agg(F.min("_id").alias("a"))
    label = components(known.join(least, "url").select("a", F.col("_id").alias("b")))
    grouped = rows.join(ids, "_title").join(label.withColumnRenamed("id", "_id"), "_id", "left").withColumn("_group", F.coalesce("class", "_id"))

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        urls: set[str] = set()
        held: dict[str, set[str]] = {}
        keep = []
        for row in group.sort_values("arrival")[["_title", "url", "site_name", "_holder", "_other", "arrival"]].itertuples(index=False, name=None):
            name, url, site, holder, other, arrival = row
            sites = held.setdefault(name, {x for x in (holder, other) if x is not None})
            if url not in urls and (name.startswith("#") or not sites - {site}):
                keep.append(arrival)
                urls.add(url)
                sites.add(site)
        return pd.DataFrame({"arrival": keep})

    kind = rows.schema["arrival"].dataType.simpleString()
    return grouped.select("_group", "_title", "url", "site_name", "_holder", "_other", "arrival").groupBy("_group").applyInPandas(fold, f"arrival {kind}")


def insert(jobs: DataFrame, accepted: DataFrame, now: dt.datetime) -> DataFrame:
    """The table with the accepted rows: next ids in arrival order, discovered and seen now."""
    rows = accepted.withColumn("discovered_date", F.lit(now)).withColumn("last_seen_date", F.lit(now)).withColumn("stale", F.lit(False)).withColumn("details_scraped", F.lit(False))
    start = F.broadcast(jobs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_start")))
    own = numbered(rows, [F.col("arrival")]).join(start).withColumn("id", (F.col("_start") + F.col("_number")).cast("long"))
    return schemas.conform(jobs, schemas.JOBS).unionByName(schemas.conform(own, schemas.JOBS))


def export(jobs: DataFrame, site: str | None = None, limit: int = 0) -> DataFrame:
    """Exported columns, newest first; a limit of 0 is none."""
    rows = jobs if site is None else jobs.where(F.col("site_name") == site)
    rows = rows.orderBy(F.desc("discovered_date"), F.desc("id")).select(*schemas.EXPORT_COLUMNS)
    return rows.limit(limit) if limit else rows


def scrape_rollup(results: DataFrame) -> DataFrame:
    """Totals of a run, with its site rows in order of name."""
    own = F.struct("site_name", "success", "new_jobs", "error")
    return results.agg(
        F.sum("new_jobs").alias("total_new_jobs"),
        F.count_if("success").alias("successful_sites"),
        F.count_if(~F.col("success")).alias("failed_sites"),
        F.sort_array(F.collect_list(own)).alias("site_results"),
    )
