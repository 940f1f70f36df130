"""Commands over a folder of tables: what people run by hand or on a schedule.

A workspace holds jobs, site_health and site_parsers as Parquet versions, beside the hand-kept files sites.csv,
candidates.csv and rejected_sites.txt. Each command reads the current version and writes the next one whole.
"""

from __future__ import annotations

import argparse
import datetime as dt
import logging
import os
import shutil
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import text as X
from tidemark.operators import curation, extract, health, jobs
from tidemark.plans import feed, update
from tidemark.sources import config, registry, sinks
from tidemark.sources.fetch import fetch_pages
from tidemark.tables import through_table

_TABLES = {"jobs": schemas.JOBS, "site_health": schemas.SITE_HEALTH, "site_parsers": schemas.SITE_PARSERS}


class Workspace:
    """Tables and files of one installation."""

    def __init__(self, spark: SparkSession, folder: str, settings: dict | None = None):
        self.spark, self.folder, self.settings = spark, folder, config.merged(settings or {})

    def path(self, name: str) -> str:
        return os.path.join(self.folder, name)

    def _version(self, name: str) -> int:
        try:
            with open(self.path(f"{name}.current"), encoding="utf-8") as f:
                return int(f.read())
        except FileNotFoundError:
            return 0

    def table(self, name: str) -> DataFrame:
        version = self._version(name)
        if not version:
            return self.spark.createDataFrame([], _TABLES[name])
        return schemas.conform(self.spark.read.parquet(self.path(f"{name}/v{version}")), _TABLES[name])

    def save(self, **tables: DataFrame) -> None:
        """Write next versions, then name them as current; older ones are removed afterwards."""
        versions = {}
        for name, df in tables.items():
            versions[name] = self._version(name) + 1
            df.write.mode("overwrite").parquet(self.path(f"{name}/v{versions[name]}"))
        for name, version in versions.items():
            part = self.path(f"{name}.current.part")
            with open(part, "w", encoding="utf-8") as f:
                f.write(str(version))
            os.replace(part, self.path(f"{name}.current"))
            shutil.rmtree(self.path(f"{name}/v{version - 1}"), ignore_errors=True)

    def sites(self) -> DataFrame:
        return registry.sites(self.spark, self.path("sites.csv"))

    def all_sites(self) -> DataFrame:
        rows = registry.read_csv(self.spark, self.path("sites.csv"))
        return rows if rows is not None else self.spark.createDataFrame([], schemas.SITES)

    def candidates(self) -> DataFrame:
        return registry.candidates(self.spark, self.path("candidates.csv"))

    def rejected_lines(self) -> DataFrame:
        return registry.lines(self.spark, self.path("rejected_sites.txt"))

    def rejected(self) -> DataFrame:
        return registry.rejected(self.rejected_lines())

    # -------- postings

    def update(self, pages: DataFrame, now: dt.datetime, fetch: Callable[[DataFrame], DataFrame] | None = None) -> dict:
        """The whole cycle over fetched pages (url, html): tables, feed with report, preview. Returns the run's totals.
        `fetch` gives the detail pages of a frame of urls."""
        clean = self.settings["cleanup"]
        state, added = update.cycle(update.State(self.table("jobs"), self.table("site_health"), self.table("site_parsers")), self.sites(), pages, now, clean["days_to_keep"], clean["stale_after_days"], fetch=fetch)
        new = {r["site_name"]: r["n"] for r in added.groupBy("site_name").agg(F.count(F.lit(1)).alias("n")).collect()}
        self.save(jobs=state.jobs, site_health=state.health)
        outcomes = self.table("site_health").where(F.col("scrape_date") == F.lit(now)).orderBy("site_name").collect()
        rows = [{"site_name": r["site_name"], "success": r["success"], "new_jobs": new.get(r["site_name"], 0), "error": r["error_message"]} for r in outcomes]
        results = {"total_new_jobs": sum(r["new_jobs"] for r in rows), "successful_sites": sum(r["success"] for r in rows), "failed_sites": sum(not r["success"] for r in rows), "site_results": rows}
        self.feed_with_summary(results, now)
        self.preview()
        return results

    def _render(self, rows: DataFrame, now: dt.datetime) -> str:
        own = self.settings["feed"]
        lexicon = {k: v for k, v in (own.get("relevance_keywords") or {}).items() if k in ("high", "medium")} or None
        items = [r.asDict() for r in feed.items(rows, own["include_site_in_title"], own["simple_descriptions"], lexicon).collect()]
        return sinks.write_rss(items, own, now.replace(tzinfo=dt.UTC), self.path(self.settings["output"]["feed_file"]))

    def feed(self, now: dt.datetime) -> str:
        return self._render(feed.plain_feed(self.table("jobs"), self.settings["output"]["max_items"]), now)

    def feed_with_summary(self, results: dict, now: dt.datetime) -> str:
        table = self.table("jobs")
        alerts = [r.asDict() for r in health.failing_sites(self.table("site_health")).collect()]
        rows = feed.update_feed(table, self.settings["output"]["max_items"])
        summary = None
        if feed.wants_summary(results, alerts, self.settings["feed"]["include_summary"]):
            stale = jobs.stale_count(table).first()["stale_count"]
            summary = feed.summary_item(results, alerts, stale, self.settings["feed"]["link"], now)
        return self._render(feed.with_summary(rows, summary).orderBy("ordinal", F.desc("discovered_date"), F.desc("id")).drop("ordinal"), now)

    def preview(self) -> str:
        rows = [r.asDict() for r in feed.preview_rows(self.table("jobs")).collect()]
        return sinks.write_preview(rows, self.settings["feed"]["title"], self.settings["feed"]["description"], self.path("preview.html"))

    def stats(self, today: dt.date) -> dict:
        return jobs.stats(self.table("jobs"), today).first().asDict()

    def health(self, today: dt.date) -> list[str]:
        rows = health.summary(self.table("site_health"), today).collect()
        return [f"[{'OK' if r['failures'] == 0 else 'WARN'}] {r['site_name']}: {r['successes']}/{r['attempts']} succeeded, {r['jobs_found']} jobs found" for r in rows]

    def stale(self) -> DataFrame:
        return jobs.stale_jobs(self.table("jobs"))

    def export(self, path: str, kind: str = "csv", limit: int = 0, site: str | None = None) -> None:
        rows = jobs.export(self.table("jobs"), site, limit)
        (sinks.export_json if kind == "json" else sinks.export_csv)(rows, path)

    def save_parser(self, site: str, text: str, now: dt.datetime) -> None:
        """Store a site's parser configuration (JSON)."""
        new = self.spark.createDataFrame([(site, text, now, now)], "site_name string, parser_config string, created_date timestamp, last_updated timestamp")
        self.save(site_parsers=registry.upsert_config(self.table("site_parsers"), new))

    # -------- site set-up

    def try_site(self, url: str, html: str | None, parser: str | None = None, rows: int = 10) -> list[dict]:
        """The first postings that a page would give, with a configuration of its own if there is one."""
        return extract.postings(html, url, "select", parser)[:rows]

    def add_site(self, name: str, url: str, keywords: str = "", details: str = "no", parser: str | None = None, now: dt.datetime | None = None) -> None:
        """Register a site, and store its parser configuration."""
        sinks.append_sites(self.spark.createDataFrame([(name, url)], "name string, url string"), self.path("sites.csv"), keywords, details)
        if parser is not None:
            self.save_parser(name, parser, now or dt.datetime.now(dt.UTC).replace(tzinfo=None))

    # -------- candidates

    def triage(self, entries: DataFrame, new_only: bool = False) -> DataFrame:
        rows = curation.triage(entries, self.all_sites(), self.rejected())
        return rows.where("status = 'new'") if new_only else rows

    def validate(self) -> DataFrame:
        return curation.violations(self.all_sites(), self.rejected())

    def add(self, entries: DataFrame, today: dt.date, category: str = "") -> int:
        """Add those of the entries (position, name, url, description) that are new; returns how many."""
        before = self.candidates()
        known = before.count()
        rows = curation.add_batch(entries, before, self.all_sites(), self.rejected(), today.isoformat(), category)
        sinks.write_candidates(rows, self.path("candidates.csv"))
        return self.candidates().count() - known

    def test(self, url: str, html: str | None) -> dict:
        """Duplicate check, platform and number of postings of a page."""
        entry = self.spark.createDataFrame([(url,)], "url string")
        duplicate = curation.url_duplicate(entry, self.all_sites(), self.rejected()).first()["duplicate"]
        name = entry.select(X.platform(F.col("url")).alias("p")).first()["p"]
        return {"duplicate": duplicate, "reachable": html is not None, "ats_type": name, "job_count": len(extract.postings(html, url, "select")) if html is not None else 0}

    def review(self, today: dt.date, size: int = 10, path: str | None = None) -> str | None:
        """Write a review file of pending candidates; None if there are none."""
        groups = curation.review_groups(curation.review_batch(self.candidates(), size)).collect()
        if not groups:
            return None
        path = path or self.path(f"review_{today.isoformat()}.md")
        with open(path, "w", encoding="utf-8") as f:
            f.write(sinks.review_markdown(groups, today.isoformat()))
        return path

    def _apply(self, decisions: DataFrame, pending_only: bool) -> int:
        before = self.candidates()
        known = before.where("status = 'pending'") if pending_only else before
        named = known.join(decisions, "id")
        good, bad = named.where("approved"), named.where("not approved")
        counts = good.count() + bad.count()
        sinks.append_sites(good.orderBy("position"), self.path("sites.csv"))
        sinks.append_rejected(bad.orderBy("position"), self.path("rejected_sites.txt"))
        sinks.write_candidates(curation.decide(before, decisions, pending_only), self.path("candidates.csv"))
        return counts

    def process(self, path: str) -> int:
        """Apply a review file and remove it."""
        found = registry.review_decisions(registry.lines(self.spark, path)).collect()
        if not found:
            return 0
        counts = self._apply(self.spark.createDataFrame([(r["id"], r["approved"]) for r in found], "id string, approved boolean"), False)
        os.remove(path)
        return counts

    def decide(self, ids: list[str], approved: bool) -> int:
        return self._apply(self.spark.createDataFrame([(i, approved) for i in dict.fromkeys(ids)], "id string, approved boolean"), True)

    def status(self) -> dict:
        return {r["status"]: r["n"] for r in curation.status_counts(self.candidates()).collect()}

    def patterns(self) -> dict:
        rows = self.all_sites().where(F.lower("active").isin("yes", "true", "1"))
        named = rows if "position" in rows.columns else rows.withColumn("position", F.lit(0))
        return {
            "platforms": [r.asDict() for r in curation.shares(named, F.coalesce(X.platform(F.col("url")), F.lit("custom/other"))).orderBy(F.desc("n")).collect()],
            "hosting": [r.asDict() for r in curation.shares(named, X.hosting_label(F.col("url"))).orderBy(F.desc("n")).collect()],
            "terms": [r.asDict() for r in curation.top_terms(named, X.name_terms(F.col("site_name")), "position", 15, 2).collect()],
            "keywords": [r.asDict() for r in curation.top_terms(named, X.keyword_terms(F.col("keywords")), "position", 10).collect()],
            "approval": curation.approval_rate(named, self.rejected_lines()).first().asDict(),
        }

    def clear(self) -> int:
        """Remove processed candidates; returns how many."""
        before = self.candidates()
        gone = curation.processed(before).count()
        sinks.write_candidates(curation.cleared(before), self.path("candidates.csv"))
        return gone

    def validate_urls(self, probes: DataFrame, path: str) -> dict:
        """Report on probed sites (site_name, url, final_url, code, html)."""
        c = F.col
        rows = probes.select("site_name", "url", "final_url", X.probe_status(c("url"), c("final_url"), c("code")).alias("status"), X.probe_message(c("url"), c("final_url"), c("code")).alias("message"), X.probe_platform(c("final_url")).alias("platform"), X.better_link(c("html"), c("final_url"), c("code")).alias("better_url"))
        counts = curation.validation_buckets(rows).first().asDict()
        with open(path, "w", encoding="utf-8") as f:
            f.write(sinks.validation_report([r.asDict() for r in rows.collect()], counts))
        return counts


def fetched(urls: DataFrame, settings: dict) -> DataFrame:
    """Pages of the urls (column url), over the network; a written table, so that each is asked for once."""
    own = settings["scraping"]
    pages = fetch_pages(urls, int(own["max_workers"]), float(own["timeout"]), int(own["retry_attempts"]), agent=own["user_agent"])
    return through_table(pages, "pages")


def _probed(w: Workspace) -> DataFrame:
    """The active sites with what their URLs answer."""
    sites = w.sites()
    found = fetched(sites, w.settings)
    return sites.select("site_name", "url").join(found, "url").select("site_name", "url", "final_url", F.coalesce("status", F.lit(599)).alias("code"), "html")


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark")
    parser.add_argument("--folder", default=".")
    parser.add_argument("--config")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("update", "feed", "preview", "stats", "health", "stale", "status", "patterns", "clear", "validate"):
        commands.add_parser(name)
    export = commands.add_parser("export")
    export.add_argument("path")
    export.add_argument("--format", default="csv", choices=("csv", "json"))
    export.add_argument("--limit", type=int, default=0)
    export.add_argument("--site")
    for name in ("add-batch", "triage"):
        own = commands.add_parser(name)
        own.add_argument("path")
        own.add_argument("--category", default="")
        own.add_argument("--new-only", action="store_true")
    own = commands.add_parser("add")
    own.add_argument("name")
    own.add_argument("url")
    own.add_argument("--category", default="")
    own.add_argument("--description", default="")
    own = commands.add_parser("review")
    own.add_argument("--batch", type=int, default=10)
    own.add_argument("--output")
    commands.add_parser("process").add_argument("path")
    own = commands.add_parser("test")
    own.add_argument("url")
    own = commands.add_parser("validate-urls")
    own.add_argument("--output", default="validation_report.txt")
    for name in ("try-site", "add-site"):
        own = commands.add_parser(name)
        own.add_argument("url")
        own.add_argument("--name", default="")
        own.add_argument("--keywords", default="")
        own.add_argument("--details", default="no")
        own.add_argument("--parser", help="parser configuration, as JSON")
    for name in ("approve", "reject"):
        commands.add_parser(name).add_argument("ids", nargs="+")
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    w = Workspace(spark, a.folder, config.load(a.config) if a.config else None)
    logging.basicConfig(level=w.settings["logging"]["level"], format="%(asctime)s %(levelname)s %(message)s", handlers=[logging.StreamHandler(), logging.FileHandler(w.path("tidemark.log"), encoding="utf-8")])
    logging.getLogger("tidemark").info("%s in %s", a.command, a.folder)
    now = dt.datetime.now(dt.UTC).replace(tzinfo=None)
    page = lambda: fetched(spark.createDataFrame([(a.url,)], "url string"), w.settings).first()["html"]
    today, listed = now.date(), lambda path: registry.lines(spark, path)
    run = {
        "update": lambda: w.update(fetched(w.sites(), w.settings), now, lambda urls: fetched(urls, w.settings)),
        "feed": lambda: w.feed(now),
        "preview": w.preview,
        "stats": lambda: w.stats(today),
        "health": lambda: "\n".join(w.health(today)),
        "stale": lambda: "\n".join(r["url"] for r in w.stale().collect()),
        "status": w.status,
        "patterns": w.patterns,
        "clear": w.clear,
        "validate": lambda: "\n".join(f"{r['site_name']} ({r['violation']})" for r in w.validate().collect()),
        "export": lambda: w.export(a.path, a.format, a.limit, a.site),
        "add": lambda: w.add(spark.createDataFrame([(0, a.name, a.url, a.description)], "position int, name string, url string, description string"), today, a.category),
        "add-batch": lambda: w.add(registry.batch(listed(a.path)), today, a.category),
        "triage": lambda: "\n".join(f"{r['status']}: {r['name']}" for r in w.triage(registry.suggestions(listed(a.path)), a.new_only).collect()),
        "review": lambda: w.review(today, a.batch, a.output),
        "process": lambda: w.process(a.path),
        "test": lambda: w.test(a.url, page()),
        "try-site": lambda: w.try_site(a.url, page(), a.parser),
        "add-site": lambda: w.add_site(a.name, a.url, a.keywords, a.details, a.parser),
        "validate-urls": lambda: w.validate_urls(_probed(w), w.path(a.output)),
        "approve": lambda: w.decide(a.ids, True),
        "reject": lambda: w.decide(a.ids, False),
    }
    print(run[a.command]())
    return 0


if __name__ == "__main__":
    sys.exit(main())
