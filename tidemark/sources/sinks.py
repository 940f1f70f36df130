"""Files that people and feed readers use. Each holds a bounded number of rows, rendered on the driver."""

from __future__ import annotations

import csv
import datetime as dt
import json
import os
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schemas


def _plain(value):
    return value.isoformat() if isinstance(value, (dt.date, dt.datetime)) else value


def _replace(path: str, text: str) -> None:
    """Write a file whole or not at all."""
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    os.replace(part, path)


def export_csv(rows: DataFrame, path: str) -> bool:
    """One CSV with a header; without rows no file is written."""
    found = rows.toLocalIterator()
    first = next(found, None)
    if first is None:
        return False
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8", newline="") as f:
        writer = csv.writer(f)
        writer.writerow(rows.columns)
        writer.writerow([_plain(v) for v in first])
        writer.writerows([_plain(v) for v in r] for r in found)
    os.replace(part, path)
    return True


def export_json(rows: DataFrame, path: str) -> None:
    """One indented JSON array, text as it is; without rows an empty array."""
    out = [{k: _plain(v) for k, v in r.asDict().items()} for r in rows.toLocalIterator()]
    _replace(path, json.dumps(out, indent=2, ensure_ascii=False))


def export_large(rows: DataFrame, path: str) -> None:
    """For exports beyond one file: a folder of CSV parts."""
    rows.write.mode("overwrite").csv(path, header=True)


SPACES = {"content": "http://purl.org/rss/1.0/modules/content/", "dc": "http://purl.org/dc/elements/1.1/", "media": "http://search.yahoo.com/mrss/", "atom": "http://www.w3.org/2005/Atom"}


def rss(items: list[dict], feed: dict, now: dt.datetime) -> str:
    """RSS 2.0 of item rows: title, url, site, summary, content (or None), published (or None), categories."""
    for prefix, uri in SPACES.items():
        ET.register_namespace(prefix, uri)
    root = ET.Element("rss", version="2.0")
    channel = ET.SubElement(root, "channel")

    def add(parent, tag, text=None, **attributes):
        node = ET.SubElement(parent, tag, attributes)
        node.text = text
        return node

    for tag in ("title", "link", "description"):
        add(channel, tag, feed[tag])
    add(channel, "language", "en")
    add(channel, "lastBuildDate", now.strftime("%a, %d %b %Y %H:%M:%S %z"))
    add(channel, f"{{{SPACES['atom']}}}link", href=feed["link"], rel="self", type="application/rss+xml")
    for row in items:
        item = add(channel, "item")
        add(item, "title", row["title"])
        url = row["url"] if row["url"] is not None else feed["link"]
        add(item, "link", url)
        add(item, "guid", url, isPermaLink="true")
        if row["site"]:
            add(item, "source", row["site"], url=feed["link"])
            add(item, "author", row["site"])
            add(item, f"{{{SPACES['dc']}}}creator", row["site"])
        add(item, "description", row["summary"])
        if row.get("content") is not None:
            add(item, f"{{{SPACES['content']}}}encoded", row["content"])
        if row["published"]:
            add(item, "pubDate", row["published"])
        for c in row["categories"]:
            add(item, "category", c)
    ET.indent(root, "  ")
    return '<?xml version="1.0" encoding="utf-8"?>\n' + ET.tostring(root, encoding="unicode") + "\n"


def write_rss(items: list[dict], feed: dict, now: dt.datetime, path: str) -> str:
    _replace(path, rss(items, feed, now))
    return path


def preview(rows: list[dict], title: str, description: str) -> str:
    """An HTML page of preview rows (escaped fields of text.preview_fields(), and job_type and salary)."""
    out = ["<!DOCTYPE html>", f"<html><head><meta charset='utf-8'><title>{title}</title></head><body>", f"<h1>{title}</h1>", f"<p>{description}</p>", f"<p><strong>Total Jobs:</strong> {len(rows)}</p>"]
    for r in rows:
        facts = [("Source", r["site"]), ("Location", r["location"] if r["location"] != "Location not specified" else ""), ("Type", r["job_type"]), ("Salary", r["salary"]), ("Discovered", r["discovered"])]
        meta = " | ".join(f"<strong>{k}:</strong> {v}" for k, v in facts if v)
        out += ["<section class='job'>", f"<h2><a href='{r['url']}'>{r['title']}</a></h2>", f"<p class='meta'>{meta}</p>", f"<div class='description'>{r['description']}</div>", "</section>"]
    return "\n".join([*out, "</body></html>"])


def write_preview(rows: list[dict], title: str, description: str, path: str) -> str:
    _replace(path, preview(rows, title, description))
    return path


def write_candidates(rows: DataFrame, path: str) -> None:
    """The candidates file, whole, in order of position where there is one."""
    names = [f.name for f in schemas.CANDIDATES]
    ordered = rows.orderBy(F.col("position").asc_nulls_last(), F.col("id").try_cast("long")) if "position" in rows.columns else rows.orderBy(F.col("id").try_cast("long"))
    found = ordered.select(*names).collect()
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8", newline="") as f:
        writer = csv.writer(f)
        writer.writerow(names)
        writer.writerows(found)
    os.replace(part, path)


def append_sites(rows: DataFrame, path: str, keywords: str = "", details: str = "no") -> None:
    """Approved sites (name, url) at the end of the registry."""
    with open(path, "a", encoding="utf-8", newline="") as f:
        csv.writer(f).writerows([r["name"], r["url"], "yes", keywords, details] for r in rows.select("name", "url").collect())


def append_rejected(rows: DataFrame, path: str) -> None:
    with open(path, "a", encoding="utf-8") as f:
        f.writelines(f"{r['name']} - {r['url']}\n" for r in rows.select("name", "url").collect())


def review_markdown(groups: list, date: str) -> str:
    """A review file with a checkbox for each candidate, from rows of curation.review_groups()."""
    total = sum(g["n"] for g in groups)
    out = [f"# Candidate Review ({date})", "", f"{total} candidates to review. Check `[x]` to approve, leave `[ ]` to reject.", ""]
    for g in groups:
        out += [f"## {g['category']} ({g['n']})", ""]
        for c in g["items"]:
            facts = [*([c["ats_type"].capitalize()] if c["ats_type"] else []), f"{c['job_count'] or 0} jobs"]
            out += [f"- [ ] **{c['id']}. {c['name']}** — {c['url']}", f"  {' | '.join(facts)}", ""]
    return "\n".join([*out, "---"]) + "\n"


def validation_report(probes: list[dict], counts: dict) -> str:
    """Report on probed sites: summary, errors, better URLs, redirects, valid ones."""
    out = ["SITE VALIDATION REPORT", "", "SUMMARY", f"Total sites checked: {counts['total']}", f"Valid URLs: {counts['ok']}", f"Redirects: {counts['redirects']}", f"Errors/404s: {counts['errors']}", f"Better URLs found: {counts['better']}"]
    sections = [
        ("ERRORS AND 404s", lambda p: p["status"] in ("404", "error"), lambda p: [f"  Current URL: {p['url']}", f"  Status: {p['status']} - {p['message']}", "  Action: NEEDS NEW URL"]),
        ("BETTER URLS FOUND", lambda p: p.get("better_url"), lambda p: [f"  Current URL: {p['url']}", f"  Suggested URL: {p['better_url']}", "  Action: CONSIDER UPDATING"]),
        ("REDIRECTS", lambda p: p["status"] == "redirect", lambda p: [f"  Current URL: {p['url']}", f"  Redirects to: {p['final_url']}", *([f"  Platform: {p['platform'].upper()}"] if p.get("platform") else []), "  Action: CONSIDER UPDATING TO FINAL URL"]),
    ]
    for head, wanted, body in sections:
        found = [p for p in probes if wanted(p)]
        if found:
            out += ["", head]
            for p in found:
                out += [p["site_name"], *body(p)]
    out += ["", "VALID URLS"]
    out += [p["site_name"] + (f" ({p['platform'].upper()})" if p.get("platform") else "") for p in probes if p["status"] == "ok"]
    return "\n".join(out) + "\n"
