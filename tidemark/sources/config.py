"""Configuration: JSON merged with defaults at two levels."""

from __future__ import annotations

import copy
import json

# What a missing section or key stands for.
DEFAULTS = {
    "feed": {"title": "Job Postings RSS Feed", "description": "Aggregated job postings", "link": "http://localhost:8000/feed.xml", "author": "Job Search Tool", "include_site_in_title": True, "simple_descriptions": False, "include_summary": True},
    "database": {"path": "jobs.db"},
    "output": {"feed_file": "feed.xml", "max_items": 100},
    "scraping": {"user_agent": "Mozilla/5.0", "timeout": 15, "retry_attempts": 2, "max_workers": 5},
    "logging": {"level": "INFO"},
    "cleanup": {"days_to_keep": 90, "stale_after_days": 30},
}


def merged(given: dict) -> dict:
    """The given sections over the defaults; a section's keys are merged one by one."""
    out = copy.deepcopy(given)
    for section, values in DEFAULTS.items():
        out[section] = {**values, **out[section]} if section in out else dict(values)
    return out


def load(path: str) -> dict:
    """Read and merge a file; invalid JSON ends the program with status 1."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        return merged(json.loads(text))
    except json.JSONDecodeError as error:
        raise SystemExit(1) from error
