"""Registered queries on lists, feeds, state and extraction that the first module leaves out."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import text as X
from tidemark.operators import curation, extract, jobs
from tidemark.plans import feed
from tidemark.plans.queries import _DOMAIN, _JOBS, _KEY, _NEW, _OLD, _SITES, AS_OF, _candidates, _split, listed, postings, query, table
from tidemark.sources import registry
from tidemark.streaming import ingest

# ---------------------------------------------------------------- hand-kept lists, as lines


def _lines(spark, d):
    """Lines of the three list formats, by the supplier's key."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    text = F.when(k % 5 == 0, F.concat(F.lit("# "), "s_name")).when(k % 5 == 1, F.concat("s_name", F.lit(" - https://S"), k.cast("string"), F.lit(".Example.org/a/ (seen twice)"))).when(k % 5 == 2, F.concat("s_name", F.lit(" - https://x.example/"), k.cast("string"), F.lit(" - about it"))).when(k % 5 == 3, F.concat("s_name", F.lit(", https://y.example/"), k.cast("string"), F.lit(",note"))).otherwise("== list ==")
    return s.select(k.alias("position"), text.alias("value"))


_LINES = "SELECT s_suppkey AS position, CASE s_suppkey % 5 WHEN 0 THEN '# ' || s_name WHEN 1 THEN s_name || ' - https://S' || s_suppkey || '.Example.org/a/ (seen twice)' WHEN 2 THEN s_name || ' - https://x.example/' || s_suppkey || ' - about it' WHEN 3 THEN s_name || ', https://y.example/' || s_suppkey || ',note' ELSE '== list ==' END AS value FROM supplier"


@query(f"""SELECT position, CASE WHEN contains(value, ' - ') THEN split_part(value, ' - ', 1) ELSE value END AS name, CASE WHEN contains(value, ' - ') THEN regexp_replace(substr(value, instr(value, ' - ') + 3), '\\s*\\([^)]*\\)\\s*$', '') END AS url
FROM ({_LINES}) WHERE NOT starts_with(value, '#') AND NOT starts_with(value, '==')""")
def rejected_list(spark, d):
    return registry.rejected(_lines(spark, d))


@query(f"""SELECT position, trim(p[1]) AS name, trim(p[2]) AS url, coalesce(trim(p[3]), '') AS description FROM (SELECT position, CASE WHEN contains(value, ' - ') THEN string_split(value, ' - ') WHEN contains(value, ',') THEN string_split(value, ',') END AS p FROM ({_LINES}) WHERE NOT starts_with(value, '#')) WHERE len(p) >= 2""")
def batch_list(spark, d):
    return registry.batch(_lines(spark, d))


@query(f"""SELECT position, CASE WHEN contains(value, ' - ') THEN split_part(value, ' - ', 1) ELSE value END AS name, CASE WHEN contains(value, ' - ') THEN substr(value, instr(value, ' - ') + 3) ELSE '' END AS url FROM ({_LINES}) WHERE NOT starts_with(value, '#')""")
def suggestion_list(spark, d):
    return registry.suggestions(_lines(spark, d))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, s_suppkey % 2 = 0 AS approved FROM supplier WHERE s_suppkey % 3 <> 0")
def review_file_decisions(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    box = F.when(k % 3 == 0, "* [x] **").when(k % 2 == 0, "- [x] **").otherwise("- [ ] **")
    return registry.review_decisions(s.select(k.alias("position"), F.concat(box, k.cast("string"), F.lit(". "), "s_name", F.lit("** - u")).alias("value")))


@query(f"SELECT DISTINCT k AS key FROM (SELECT {_KEY.format('url')} AS k FROM ({_SITES}) UNION ALL SELECT {_DOMAIN.format('url')} FROM ({_SITES}))")
def known_url_keys(spark, d):
    sites, _, _ = listed(spark, d)
    return curation.known_urls(sites, "url")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id FROM supplier WHERE s_suppkey % 3 <> 0")
def cleared_candidates(spark, d):
    return curation.cleared(_candidates(spark, d)).select("id")


@query("SELECT CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_partkey > (SELECT max(s_suppkey) FROM supplier)")
def unknown_decisions(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"))
    return curation.unknown_decisions(_candidates(spark, d), p).select("id")


@query("""WITH own AS (SELECT s_suppkey AS id, s_name AS site_name, '{"a": ' || s_suppkey || '}' AS parser_config FROM supplier), new AS (SELECT s_name AS site_name, '{"b": 1}' AS parser_config FROM supplier WHERE s_suppkey % 4 = 0)
SELECT id, site_name, parser_config FROM own WHERE site_name NOT IN (SELECT site_name FROM new) UNION ALL SELECT (SELECT max(id) FROM own) + row_number() OVER (ORDER BY site_name), site_name, parser_config FROM new""")
def parser_upsert(spark, d):
    s = table(spark, d, "supplier")
    own = schemas.conform(s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("site_name"), F.concat(F.lit('{"a": '), F.col("s_suppkey").cast("string"), F.lit("}")).alias("parser_config")), schemas.SITE_PARSERS)
    new = s.where("s_suppkey % 4 = 0").select(F.col("s_name").alias("site_name"), F.lit('{"b": 1}').alias("parser_config"))
    return registry.upsert_config(own, new).select("id", "site_name", "parser_config")


# ---------------------------------------------------------------- state and results


@query(f"""WITH new AS (SELECT *, row_number() OVER (ORDER BY id) AS k FROM ({_NEW}) WHERE url NOT IN (SELECT url FROM ({_OLD})))
SELECT (SELECT max(id) FROM ({_OLD})) + k AS id, url, '2024-01-31 00:00:00' AS discovered_date, false AS stale FROM new""")
def insert_numbered(spark, d):
    old, new = _split(spark, d)
    fresh = new.join(old.select("url"), "url", "left_anti")
    both = jobs.insert(old, fresh, dt.datetime(2024, 1, 31))
    added = both.join(fresh.select("url"), "url", "left_semi")
    return added.select("id", "url", F.date_format("discovered_date", "yyyy-MM-dd HH:mm:ss").alias("discovered_date"), "stale")


@query("SELECT CAST(sum(n) AS BIGINT) AS total_new_jobs, count(*) FILTER (ok) AS successful_sites, count(*) FILTER (NOT ok) AS failed_sites, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT 'site' || user_id AS s, count(*) FILTER (event_type = 'purchase') AS n, count(*) FILTER (event_type = 'error') < 10 AS ok FROM events GROUP BY 1)")
def scrape_rollup(spark, d):
    e = table(spark, d, "events")
    rows = e.groupBy(F.concat(F.lit("site"), F.col("user_id").cast("string")).alias("site_name")).agg(F.count_if(F.col("event_type") == "purchase").alias("new_jobs"), (F.count_if(F.col("event_type") == "error") < 10).alias("success"), F.lit(None).cast("string").alias("error"))
    return jobs.scrape_rollup(rows).select("total_new_jobs", "successful_sites", "failed_sites", F.array_join(F.transform("site_results", lambda r: r["site_name"]), ",").alias("names"))


@query(f"SELECT id, title FROM ({_JOBS}) WHERE CAST(discovered_date AS DATE) >= DATE '2024-01-31' - 30")
def dedup_history(spark, d):
    return jobs.recent_history(postings(spark, d), AS_OF).select("id", "title")


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, 'site' || user_id AS site_name, count(*) AS attempts, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY 1, 2")
def health_windows(spark, d):
    e = table(spark, d, "events")
    rows = e.select(F.concat(F.lit("site"), F.col("user_id").cast("string")).alias("site_name"), F.col("ts").cast("timestamp").alias("scrape_date"), (F.col("event_type") != "error").alias("success"))
    return ingest.health_windows(rows).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "site_name", "attempts", "failures")


# ---------------------------------------------------------------- feed fields


@query("SELECT o_orderkey, strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S +0000') AS published FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 3 = 0")
def published_dates(spark, d):
    o = table(spark, d, "orders")
    own = F.when(F.col("o_orderkey") % 3 == 0, "Posted lately").otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("o_orderkey") % 3 == 1, "Z").otherwise("")))
    return o.select("o_orderkey", X.rfc822(X.iso_date(own)).alias("published"))


@query(f"SELECT replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS title, url, site_name AS site, location FROM (SELECT * FROM ({_JOBS}) ORDER BY discovered_date DESC, id DESC LIMIT 50)")
def preview_rows(spark, d):
    return feed.preview_rows(postings(spark, d)).select("title", "url", "site", "location")


@query(f"SELECT id, concat_ws('|', CASE WHEN keywords IS NOT NULL THEN 'the|ing' END, site_name) AS categories FROM ({_JOBS})")
def categories(spark, d):
    rows = postings(spark, d)
    return rows.select("id", F.array_join(X.categories(F.col("keywords"), F.col("site_name"), F.array().cast("array<string>")), "|").alias("categories"))


@query("SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN 'stated' END, '$' || (10 + s_suppkey % 90) || 'k - $' || (20 + s_suppkey % 70) || 'k') AS salary FROM supplier")
def salary_backfill(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    text = F.concat(F.lit("We pay $"), (k % 90 + 10).cast("string"), F.lit("k - $"), (k % 70 + 20).cast("string"), F.lit("k."))
    return s.select("s_suppkey", X.backfilled_salary(F.when(k % 3 == 0, "stated").otherwise(""), text).alias("salary"))


# ---------------------------------------------------------------- extraction, on boards written from suppliers


def boards(spark, d):
    """A board page for each supplier, its platform by the key; each lists two postings."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    shapes = {
        "boards.greenhouse.io": "<div class='opening'><a href='/o/{i}'>Post {i} {n}</a><span class='location'>City {n}</span></div>",
        "jobs.lever.co": "<div class='posting'><a class='posting-title' href='https://jobs.lever.co/o/{i}'><h5>Post {i} {n}</h5><span class='posting-category sort-by-location'>City {n}</span></a></div>",
        "apply.workable.com": "<li data-ui='job'><a href='/o/{i}'><h3 class='title'>Post {i} {n}</h3></a><span class='city'>City {n}</span></li>",
        "x.teamtailor.com": "<div><a href='/jobs/{i}-x'>Post {i} {n}</a><span class='location'>City {n}</span></div>",
        "x.icims.com": "<div><a href='/jobs/{i}/x'>Post {i} {n}</a><span class='location'>City {n}</span></div>",
        "x.taleo.net": "<p><a href='/jobdetail?{i}'>Post {i} {n}</a><span class='city'>City {n}</span></p>",
        "x.myworkdayjobs.com": "<li><a data-automation-id='jobTitle' href='/job/{i}'>Post {i} {n}</a><dd data-automation-id='locations'>City {n}</dd></li>",
        "workforcenow.adp.com": "<p><a href='/recruitment/{i}'>Post {i} {n}</a></p>",
        "x.applicantpro.com": "<div><a href='/jobs/{i}/x'>Post {i} {n}</a><small class='region'>City {n}</small></div>",
        "careers.example.org": "<article class='job'><h2>Post {i} {n}</h2><a href='/o/{i}'>x</a><span class='office'>City {n}</span></article>",
    }
    hosts, html = F.array(*map(F.lit, shapes)), F.array(*(F.lit("".join(v.replace("{i}", i) for i in "12")) for v in shapes.values()))
    at = (k % len(shapes)).cast("int")
    return s.select("s_suppkey", F.concat(F.lit("https://"), F.get(hosts, at), F.lit("/board")).alias("url"), F.replace(F.get(html, at), F.lit("{n}"), k.cast("string")).alias("html"))


@query("SELECT s_suppkey, i - 1 AS position, 'Post ' || i || ' ' || s_suppkey AS title, CASE WHEN s_suppkey % 10 <> 7 THEN 'City ' || s_suppkey END AS location FROM supplier, (VALUES (1), (2)) v(i)")
def platform_postings(spark, d):
    return extract.extract_jobs(boards(spark, d)).select("s_suppkey", "position", "title", "location")
