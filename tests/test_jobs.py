import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import jobs as J

NOW = dt.datetime(2024, 1, 31, 12)


def table(spark, rows):
    """Postings from dicts of some columns."""
    return spark.createDataFrame([tuple(r.get(f.name) for f in schemas.JOBS) for r in rows], schemas.JOBS)


def test_accepting_in_arrival_order(spark):
    rng = random.Random(6)
    for trial in range(12):
        sites, titles = ["a", "b", "c"], [f"a longer title {k}" for k in range(5)] + ["short"]
        history = [{"id": k, "site_name": rng.choice(sites), "url": f"h{k}", "title": rng.choice(titles), "discovered_date": NOW - dt.timedelta(days=rng.choice((1, 20, 60)))} for k in range(rng.randrange(0, 5))]
        batch = [(rng.choice(sites), rng.choice([f"u{rng.randrange(9)}", f"h{rng.randrange(6)}"]), rng.choice(titles), k, k) for k in range(25)]
        held, urls, want = [(h["title"], h["site_name"]) for h in history if h["discovered_date"] >= NOW - dt.timedelta(days=31)], {h["url"] for h in history}, []
        for site, url, title, k, _ in batch:
            if url in urls or len(title) >= 10 and any(t == title and s != site for t, s in held):
                continue
            urls.add(url)
            held.append((title, site))
            want.append(k)
        rows = spark.createDataFrame(batch, "site_name string, url string, title string, arrival int, position int")
        got = sorted(r.arrival for r in J.accept_new(rows, table(spark, history), NOW.date()).collect())
        assert got == want, trial


def test_scan_limit_is_seen_from_each_site(spark):
    history = [{"id": k, "site_name": "a" if k % 2 else "b", "url": f"h{k}", "title": f"some long title {k}", "discovered_date": NOW - dt.timedelta(hours=k)} for k in range(20)]
    batch = spark.createDataFrame([("a", f"n{k}", f"Some Long-Title {k}", k) for k in range(20)], "site_name string, url string, title string, position int")
    got = sorted(r.position for r in J.title_matches(batch, table(spark, history), NOW.date(), scan=4).collect())
    assert got == [0, 2, 4, 6]
    assert J.title_matches(batch, table(spark, history), NOW.date(), scan=None).count() == 10


def test_date_rules_are_by_day(spark):
    rows = [{"id": k, "url": str(k), "discovered_date": d, "last_seen_date": d, "stale": False} for k, d in enumerate([dt.datetime(2024, 1, 1), dt.datetime(2023, 12, 31, 23, 59), None])]
    assert [r.stale for r in J.mark_stale(table(spark, rows), NOW.date(), 30).orderBy("id").collect()] == [False, True, False]
    assert [r.id for r in J.retain(table(spark, rows), NOW.date(), 30).orderBy("id").collect()] == [0]
    assert [r.id for r in J.recent_history(table(spark, rows), NOW.date()).collect()] == [0]


def test_insert_marks_and_numbers(spark):
    old = table(spark, [{"id": 7, "url": "x", "stale": True, "last_seen_date": NOW - dt.timedelta(days=50)}])
    new = spark.createDataFrame([("s", "y", "T", 2), ("s", "z", "U", 1)], "site_name string, url string, title string, arrival int")
    rows = {r.url: r for r in J.mark_seen(J.insert(old, new, NOW), spark.createDataFrame([("x",), ("x",)], "url string"), NOW).collect()}
    assert rows["z"].id == 8 and rows["y"].id == 9 and rows["y"].discovered_date == NOW and not rows["x"].stale and rows["x"].last_seen_date == NOW


def test_details_fill_only_what_lacks_a_description(spark):
    batch = spark.createDataFrame([("s", k, f"u{k}", "have" if k == 0 else None, None) for k in range(4)], "site_name string, position int, url string, description string, salary string")
    details = spark.createDataFrame([(f"u{k}", f"d{k}", "$1") for k in range(4)], "url string, description string, salary string")
    got = [(r.description, r.salary) for r in J.with_details(batch, details, 3).orderBy("position").collect()]
    assert got == [("have", None), ("d1", "$1"), ("d2", "$1")]


def test_stale_orders_nulls_first_and_counts_are_capped(spark):
    rows = table(spark, [{"id": k, "url": str(k), "stale": True, "last_seen_date": None if k == 3 else NOW - dt.timedelta(days=k)} for k in range(5)])
    assert [r.id for r in J.stale_jobs(rows, 3).collect()] == [3, 4, 2]
    assert J.stale_count(rows, 2).first()[0] == 2


def test_rollup(spark):
    rows = spark.createDataFrame([("b", True, 2, None), ("a", False, 0, "x")], "site_name string, success boolean, new_jobs int, error string")
    got = J.scrape_rollup(rows).first()
    assert (got.total_new_jobs, got.successful_sites, got.failed_sites, [r.site_name for r in got.site_results]) == (2, 1, 1, ["a", "b"])
    assert J.scrape_rollup(rows.where(F.lit(False))).first().successful_sites == 0


def test_filters_reach_the_scan(spark, tmp_path):
    from tidemark.operators import health as H

    path = str(tmp_path / "health")
    spark.createDataFrame([(1, "a", NOW, True, 2, None, None)], schemas.SITE_HEALTH).write.parquet(path)
    plan = H.summary(spark.read.parquet(path), NOW.date())._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(scrape_date" in plan and "error_message" not in plan.split("ReadSchema")[1].split("\n")[0]
    rows = table(spark, [{"id": k, "url": str(k), "discovered_date": d} for k, d in enumerate([dt.datetime(2024, 1, 31), dt.datetime(2024, 1, 31, 23, 59), dt.datetime(2024, 2, 1), dt.datetime(2024, 1, 24), dt.datetime(2024, 1, 23, 23, 59), None])])
    got = J.stats(rows, NOW.date()).first()
    assert (got.total_jobs, got.jobs_today, got.jobs_week) == (6, 2, 4)


def test_detail_pages_fill_the_first_postings_of_sites_that_ask(spark):
    from tidemark.plans import update

    schema = "site_name string, keywords string, scrape_details string, position int, title string, url string, description string, location string, salary string, job_type string, posted_date string, department string, arrival long"
    found = spark.createDataFrame([(site, None, asks, k, f"t{k}", f"{site}{k}", "have" if k == 0 else None, *[None] * 5, k) for site, asks in (("a", "Yes"), ("b", "no")) for k in range(3)], schema)
    asked = []

    def fetch(urls):
        asked.extend(sorted(r.url for r in urls.collect()))
        return urls.withColumn("html", F.concat(F.lit("<div class='description'>About "), "url", F.lit("</div>")))

    got = {r.url: r.description for r in update.detailed(found, fetch, 2).collect()}
    assert asked == ["a1"] and got == {"a0": "have", "a1": "About a1", "b0": "have", "b1": None, "b2": None}
