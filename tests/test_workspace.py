import datetime as dt
import os
import random
from xml.etree import ElementTree as ET

import pytest

from tidemark.api import Workspace
from tidemark.operators import curation
from tidemark.plans import feed
from tidemark.sources import config, registry, sinks
from tidemark.sources.fetch import Limiter, fetch

NOW = dt.datetime(2024, 1, 31, 9)


@pytest.fixture
def space(spark, tmp_path):
    (tmp_path / "sites.csv").write_text("site_name,url,active,keywords,scrape_details\nAcme,https://acme.example/jobs,yes,,no\nBeta,https://beta.example/jobs,TRUE,role,no\nOld,https://old.example,no,,no\nDup, https://acme.example/jobs ,yes,,no\n,https://noname.example,yes,,no\n")
    (tmp_path / "rejected_sites.txt").write_text("# list\n== x ==\nThe Gamma Foundation - https://gamma.example/ (too far)\n")
    return Workspace(spark, str(tmp_path), {"feed": {"title": "Own"}})


def pages(spark, extra=""):
    card = lambda href, title: f"<div class='job'><h3>{title}</h3><a href='{href}'>x</a></div>"
    html = {"https://acme.example/jobs": card("/1", "Program Director role") + card("/2", "Cook") + extra, "https://beta.example/jobs": card("/1", "Program Director role") + card("/3", "Another role") + card("/4", "Without")}
    return spark.createDataFrame(list(html.items()), "url string, html string")


def test_update_cycle_and_its_repeat(space, spark):
    first = space.update(pages(spark), NOW)
    assert first["total_new_jobs"] == 3 and first["successful_sites"] == 2
    stored = {r.url: r for r in space.table("jobs").collect()}
    assert set(stored) == {"https://acme.example/1", "https://acme.example/2", "https://beta.example/3"}
    again = space.update(pages(spark, "<div class='job'><h3>Nurse</h3><a href='/9'>x</a></div>"), NOW + dt.timedelta(days=40))
    assert again["total_new_jobs"] == 2  # the nurse, and a title whose holder was found too long ago
    assert all(r.last_seen_date == NOW + dt.timedelta(days=40) and not r.stale for r in space.table("jobs").collect())
    root = ET.parse(space.path("feed.xml")).getroot()
    titles = [i.findtext("title") for i in root.iter("item")]
    assert titles[0].startswith("Update - 2 New Jobs Found") and root.findtext("channel/title") == "Own"
    assert os.path.exists(space.path("preview.html")) and space.stats(NOW.date())["total_jobs"] == 5
    space.update(spark.createDataFrame([], "url string, html string"), NOW + dt.timedelta(days=75))
    assert space.stale().count() == 5 and "Acme" in "".join(space.health((NOW + dt.timedelta(days=75)).date()))
    space.export(space.path("out.json"), "json")
    space.export(space.path("none.csv"), "csv", site="nobody")
    assert not os.path.exists(space.path("none.csv")) and os.path.getsize(space.path("out.json")) > 100


def test_stored_parser_configuration_is_used(space, spark):
    space.save_parser("Acme", '{"url_pattern": "/deep/"}', NOW)
    space.save_parser("Acme", '{"url_pattern": "/two/"}', NOW)
    assert space.table("site_parsers").count() == 1
    page = spark.createDataFrame([("https://acme.example/jobs", "<a href='/two/1'>Second chance</a><a href='/deep/1'>First chance</a>")], "url string, html string")
    space.update(page, NOW)
    assert [r.title for r in space.table("jobs").collect()] == ["Second chance"]


def test_review_round_trip(space, spark):
    entries = registry.batch(spark.createDataFrame([(k, v) for k, v in enumerate(["# note", "New Org - https://new.example - About", "Acme Inc - https://other.example", "Third,https://third.example", "New Org - https://elsewhere.example", "Gamma - https://g2.example", "Fourth - https://fourth.example"])], "position int, value string"))
    assert space.add(entries, NOW.date(), "Tech") == 3
    assert space.status() == {"pending": 3, "approved": 0, "rejected": 0}
    path = space.review(NOW.date())
    text = open(path, encoding="utf-8").read()
    assert "**1. New Org**" in text and "## Tech (3)" in text
    open(path, "w", encoding="utf-8").write(text.replace("- [ ] **1.", "- [X] **1."))
    assert space.process(path) == 3 and not os.path.exists(path)
    assert space.status() == {"pending": 0, "approved": 1, "rejected": 2}
    assert "New Org,https://new.example,yes,,no" in open(space.path("sites.csv"), encoding="utf-8").read()
    assert space.decide(["2"], True) == 0 and space.clear() == 3
    assert space.test("https://boards.greenhouse.io/q", "<div class='opening'><a href='/1'>One</a></div>") == {"duplicate": None, "reachable": True, "ats_type": "greenhouse", "job_count": 1}
    assert space.patterns()["approval"]["active"] == 5


def test_triage_and_violations(space, spark):
    rows = registry.suggestions(spark.createDataFrame([(k, v) for k, v in enumerate(["ACME Foundation", "gamma", "X - https://beta.example/other", "Y - gamma.example", "Z - http:z.example"])], "position int, value string"))
    got = {r["name"]: r["status"] for r in space.triage(rows).collect()}
    assert got == {"ACME Foundation": "active", "gamma": "rejected", "X": "active", "Y": "rejected", "Z": "new"}
    with open(space.path("rejected_sites.txt"), "a", encoding="utf-8") as f:
        f.write("beta\nThe Acme Fund - https://q.example\n")
    assert {r["site_name"]: r["violation"] for r in space.validate().collect()} == {"Acme": "matches rejected: the acme fund", "Beta": "exact match in rejected list"}


def test_greedy_order(spark):
    rng = random.Random(1)
    rows = [(k, f"Name {rng.randrange(6)}", f"http://u{rng.randrange(6)}.example/") for k in range(40)]
    names, urls, want = set(), set(), []
    for k, n, u in rows:
        if n not in names and u not in urls:
            want.append(k)
            names.add(n)
            urls.add(u)
    got = sorted(r.position for r in curation.greedy_new(spark.createDataFrame(rows, "position int, name string, url string")).collect())
    assert got == want


def test_report_and_summary():
    probes = [{"site_name": "A", "url": "u", "final_url": "v", "status": "redirect", "message": "m", "platform": "lever", "better_url": None}, {"site_name": "B", "url": "u", "final_url": "u", "status": "404", "message": "Page not found", "platform": None, "better_url": "w"}]
    text = sinks.validation_report(probes, {"total": 2, "ok": 0, "redirects": 1, "errors": 1, "better": 1})
    assert "Platform: LEVER" in text and "Suggested URL: w" in text and "NEEDS NEW URL" in text
    results = {"total_new_jobs": 0, "successful_sites": 1, "failed_sites": 1, "site_results": [{"site_name": "a<", "success": False, "new_jobs": 0}, {"site_name": "b", "success": True, "new_jobs": 2}]}
    item = feed.summary_item(results, [{"site_name": "a<", "consecutive_failures": 3, "last_error": None}], 4, "l", NOW)
    assert item["title"] == "Update - 0 New Jobs Found (1 site alert)" and "a&lt; — 3 failures (last: unknown error)" in item["description"] and "Hidden: 4" in item["description"]
    assert not feed.wants_summary(results, []) and feed.wants_summary(results, [1]) and not feed.wants_summary(results, [1], False)


def test_config(tmp_path):
    assert config.merged({"feed": {"title": "x"}})["feed"]["link"] == "http://localhost:8000/feed.xml" and config.merged({})["output"]["max_items"] == 100
    (tmp_path / "c.json").write_text("{")
    with pytest.raises(SystemExit):
        config.load(str(tmp_path / "c.json"))


def test_registry_of_wrong_columns_is_empty(spark, tmp_path):
    (tmp_path / "s.csv").write_text("name,link\na,b\n")
    assert registry.sites(spark, str(tmp_path / "s.csv")).count() == 0 and registry.sites(spark, str(tmp_path / "missing.csv")).count() == 0


class Clock:
    def __init__(self):
        self.t, self.slept = 0.0, []

    def sleep(self, s):
        self.slept.append(s)
        self.t += s


def test_limiter_and_retries():
    clock = Clock()
    limiter = Limiter(1.0, lambda: clock.t, clock.sleep)
    answers = iter([(429, {"Retry-After": "90"}, "u", ""), (200, {}, "u2", "page")])
    got = fetch("http://a.example/x", limiter, lambda u, t: next(answers))
    assert got["html"] == "page" and got["final_url"] == "u2" and clock.slept[0] == 30 and limiter.extra["a.example"] == 2.0
    for _ in range(9):
        limiter.refused("a.example")
    assert limiter.extra["a.example"] == 60.0

    def broken(u, t):
        raise OSError("down")

    got = fetch("http://b.example/", limiter, broken, attempts=3)
    assert got["html"] is None and got["error"] == "down" and clock.slept[-1] >= 1
    assert fetch("http://c.example/", limiter, lambda u, t: (404, {}, u, ""))["status"] == 404


def test_page_source(spark):
    from tidemark.sources.fetch import PageSource

    spark.dataSource.register(PageSource)
    rows = spark.read.format("pages").options(urls="http://127.0.0.1:9/a\nhttp://127.0.0.1:9/b", retry_attempts=1, delay=0, timeout=1).load().collect()
    assert len(rows) == 2 and all(r.html is None and r.error for r in rows)


def test_pages_of_a_frame_of_urls(spark):
    from pyspark import TaskContext

    from tidemark.sources.fetch import fetch_pages

    def answer(url, timeout):
        if "broken" in url:
            raise OSError("down")
        return (404, {}, url, "") if "gone" in url else (200, {}, url + "#", str(TaskContext.get().partitionId()))

    urls = [f"http://{'D' if k % 2 else 'd'}{k % 6}.example/{k}" for k in range(60)] + ["http://broken.example/", "http://gone.example/", "no url", "http://d1.example/1", None, None]
    got = fetch_pages(spark.createDataFrame([(u,) for u in urls], "url string"), 4, attempts=1, delay=0, transport=answer).collect()
    assert sorted(r.url for r in got) == sorted({u for u in urls if u})
    rows = {r.url: r for r in got}
    assert rows["http://broken.example/"].error == "down" and rows["http://broken.example/"].status is None
    assert rows["http://gone.example/"].status == 404 and rows["http://gone.example/"].html is None and rows["no url"].status == 200
    tasks = {}
    for r in got:
        if r.html is not None:
            tasks.setdefault(r.url.lower().rpartition("/")[0], set()).add(r.html)
    assert all(len(t) == 1 for t in tasks.values()) and len(set.union(*tasks.values())) > 1
    assert fetch_pages(spark.createDataFrame([], "url string"), 4, transport=answer).count() == 0


def test_written_pages_are_asked_for_once(spark, tmp_path):
    from tidemark.sources.fetch import fetch_pages
    from tidemark.tables import through_table

    log = str(tmp_path / "log")

    def answer(url, timeout):
        with open(log, "a") as f:
            f.write(url + "\n")
        return 200, {}, url, "x"

    pages = through_table(fetch_pages(spark.createDataFrame([("http://a.example/",), ("http://b.example/",)], "url string"), 2, delay=0, transport=answer), "pages")
    assert pages.count() == 2 and pages.where("html = 'x'").count() == 2
    assert sorted(open(log).read().split()) == ["http://a.example/", "http://b.example/"]


def test_commands(space, spark, capsys):
    from tidemark import api

    folder = ["--folder", space.folder]
    assert api.main([*folder, "add", "New Org", "https://new.example", "--category", "C"]) == 0
    api.main([*folder, "status"])
    api.main([*folder, "approve", "1"])
    api.main([*folder, "patterns"])
    api.main([*folder, "stats"])
    api.main([*folder, "feed"])
    out = capsys.readouterr().out
    assert "'pending': 1" in out and "org-hosted" in out and "total_jobs" in out and os.path.exists(space.path("feed.xml"))
    assert space.try_site("https://q.example/", "<a href='/z/1'>Second job</a>", '{"url_pattern": "/z/"}')[0]["title"] == "Second job"
    space.add_site("Q", "https://q.example/", parser='{"url_pattern": "/z/"}')
    assert space.table("site_parsers").count() == 1 and space.sites().where("site_name = 'Q'").count() == 1
    probes = spark.createDataFrame([("A", "u", "u", 200, ""), ("B", "u", "v", 200, None)], "site_name string, url string, final_url string, code int, html string")
    assert space.validate_urls(probes, space.path("r.txt"))["redirects"] == 1


def test_streaming_merge(spark, tmp_path):
    from tidemark.streaming import ingest

    source, target = str(tmp_path / "in"), str(tmp_path / "jobs")
    schema = "site_name string, url string, title string, description string, arrival long, seen_at timestamp"
    spark.createDataFrame([("a", "u1", "A long title here", "d", 1, NOW), ("b", "u2", "a long title HERE", "d", 2, NOW)], schema).write.parquet(source + "/one")
    os.makedirs(target)
    first = ingest.ingest_available(spark, source + "/*", target, str(tmp_path / "ck"), NOW)
    assert [r.url for r in first.collect()] == ["u1"]
    spark.createDataFrame([("a", "u3", "Something else", "d", 3, NOW), ("a", "u1", "A long title here", "d", 4, NOW)], schema).write.parquet(source + "/two")
    second = ingest.ingest_available(spark, source + "/*", target, str(tmp_path / "ck"), NOW + dt.timedelta(hours=1))
    assert sorted(r.url for r in second.collect()) == ["u1", "u3"]
    spark.createDataFrame([("c", "u9", "Yet another posting", "d", 9, NOW)], schema).write.parquet(source + "/three")
    third = ingest.ingest_available(spark, source + "/*", f"file://{target}", str(tmp_path / "fresh"), NOW + dt.timedelta(hours=2))
    assert sorted(r.url for r in third.collect()) == ["u1", "u3", "u9"] and ingest.current(spark, target)["version"] == 2
    merge = ingest.merge_into(target, str(tmp_path / "fresh"), NOW)  # a batch that runs again after its pointer moved
    merge(spark.createDataFrame([("c", "u10", "Must not come in", "d", 1, NOW)], schema), 0)
    assert ingest.read_current(spark, target).count() == 3 and not os.path.exists(f"{target}/v0")
    windows = ingest.health_windows(spark.createDataFrame([("a", NOW, False), ("a", NOW, True)], "site_name string, scrape_date timestamp, success boolean"))
    assert windows.first().failures == 1
