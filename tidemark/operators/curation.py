"""Candidate sites: triage, duplicates, review, decisions, and the reports on them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators.graph import components
from tidemark.tables import numbered


def known_names(names: DataFrame, column: str) -> DataFrame:
    """Lower-case and normal forms of listed names, as one column key; the list is a hand-kept file."""
    return names.select(F.explode(F.array(F.lower(F.col(column)), F.concat(F.lit("\0"), X.normal_name(F.col(column))))).alias("key")).distinct()


def known_urls(urls: DataFrame, column: str) -> DataFrame:
    """Keys and domains of listed URLs."""
    own = urls.where(X.blank(F.col(column)).isNotNull())
    return own.select(F.explode(F.array(X.url_key(F.col(column)), X.url_domain(F.col(column)))).alias("key")).distinct()


def _flag(rows: DataFrame, keys: list, known: DataFrame, name: str) -> DataFrame:
    """Adds whether any of the row's keys is known; each key is looked up by an equi-join."""
    out = rows
    for k, key in enumerate(keys):
        own = known.select(F.col("key").alias(f"_k{k}"), F.lit(True).alias(f"_f{k}"))
        out = out.withColumn("_key", key).join(own, F.col("_key") == F.col(f"_k{k}"), "left").drop("_key", f"_k{k}")
    hit = F.coalesce(*(F.col(f"_f{k}") for k in range(len(keys))), F.lit(False))
    return out.withColumn(name, hit).drop(*(f"_f{k}" for k in range(len(keys))))


def _name_keys():
    return [F.lower(F.col("name")), F.concat(F.lit("\0"), X.normal_name(F.col("name")))]


def triage(suggestions: DataFrame, sites: DataFrame, rejected: DataFrame) -> DataFrame:
    """name, url and status (new, active, rejected) of suggestions: names before URLs, active before rejected.

    Domains count only for URLs that begin with http, and an empty one never does.
    """
    out = _flag(suggestions, _name_keys(), known_names(sites, "site_name"), "_na")
    out = _flag(out, _name_keys(), known_names(rejected, "name"), "_nr")
    url = [X.url_key(X.blank(F.col("url"))), F.when(F.col("url").startswith("http"), X.blank(X.url_domain(F.col("url"))))]
    out = _flag(out, url, known_urls(sites, "url"), "_ua")
    out = _flag(out, url, known_urls(rejected, "url"), "_ur")
    status = F.when(F.col("_na"), "active").when(F.col("_nr"), "rejected").when(F.col("_ua"), "active").when(F.col("_ur"), "rejected").otherwise("new")
    return out.withColumn("status", status).select(*suggestions.columns, "status")


def duplicate_reason(suggestions: DataFrame, sites: DataFrame, rejected: DataFrame, candidates: DataFrame) -> DataFrame:
    """Where a suggestion is known from already, null if it is new; here an empty domain does match an empty one."""
    out = _flag(suggestions, _name_keys(), known_names(sites, "site_name"), "_na")
    out = _flag(out, _name_keys(), known_names(rejected, "name"), "_nr")
    url = [X.url_key(F.col("url")), X.url_domain(F.col("url"))]
    out = _flag(out, url, known_urls(sites, "url"), "_ua")
    out = _flag(out, url, known_urls(rejected, "url"), "_ur")
    own = candidates.where(X.blank(F.col("url")).isNotNull()).select(X.url_key(F.col("url")).alias("key")).distinct()
    out = _flag(out, [X.url_key(F.col("url"))], own, "_uc")
    place = F.col("position") if "position" in candidates.columns else F.col("id").cast("long")
    named = candidates.groupBy(X.normal_name(F.col("name")).alias("_n")).agg(F.min_by("name", place).alias("_nc"))
    out = out.withColumn("_own", X.normal_name(F.col("name"))).join(named, F.col("_own") == F.col("_n"), "left")
    reason = (
        F.when(F.col("_na"), "already active (name match)")
        .when(F.col("_nr"), "already rejected (name match)")
        .when(F.col("_ua"), "already active (URL match)")
        .when(F.col("_ur"), "already rejected (URL match)")
        .when(F.col("_uc"), "already a candidate (URL match)")
        .when(F.col("_nc").isNotNull(), F.concat(F.lit("already a candidate (name match: "), F.col("_nc"), F.lit(")")))
    )
    return out.withColumn("reason", reason).select(*suggestions.columns, "reason")


def url_duplicate(urls: DataFrame, sites: DataFrame, rejected: DataFrame) -> DataFrame:
    """Duplicate check by URL alone."""
    key = [X.url_key(F.col("url")), X.url_domain(F.col("url"))]
    out = _flag(_flag(urls, key, known_urls(sites, "url"), "_a"), key, known_urls(rejected, "url"), "_r")
    return out.withColumn("duplicate", F.when(F.col("_a"), "active").when(F.col("_r"), "rejected")).select(*urls.columns, "duplicate")


def triage_counts(triaged: DataFrame) -> DataFrame:
    return triaged.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def violations(sites: DataFrame, rejected: DataFrame) -> DataFrame:
    """Active sites that the rejected list names, exactly or by normal form (the least such name)."""
    active = sites.where(F.lower(F.coalesce("active", F.lit(""))).isin("yes", "true", "1")).withColumn("site_name", X.strip(F.col("site_name")))
    listed = rejected.select(F.lower("name").alias("_name"), X.normal_name(F.col("name")).alias("_normal"))
    exact = listed.select("_name").distinct().withColumn("_exact", F.lit(True))
    normal = listed.groupBy("_normal").agg(F.min("_name").alias("_match"))
    both = active.join(exact, F.lower("site_name") == F.col("_name"), "left").join(normal, X.normal_name(F.col("site_name")) == F.col("_normal"), "left")
    text = F.when(F.col("_exact"), "exact match in rejected list").when(F.col("_match").isNotNull(), F.concat(F.lit("matches rejected: "), F.col("_match")))
    return both.withColumn("violation", text).where("violation is not null").select("site_name", "violation")


def next_id(candidates: DataFrame) -> DataFrame:
    return candidates.agg((F.coalesce(F.max(F.col("id").try_cast("long")), F.lit(0)) + 1).cast("long").alias("next_id"))


def greedy_new(entries: DataFrame) -> DataFrame:
    """Entries (position, name, url) taken in order unless the url or the normal name of one taken before repeats.

    Only entries that share a key with another can depend on the order; they are folded within the groups that shared
    keys tie together, and all others are taken as they are. An entry without URL repeats nobody's.
    """
    own = entries.withColumn("_n", X.normal_name(F.col("name"))).withColumn("_u", X.blank(X.url_key(F.col("url"))))
    keys = own.select("position", F.explode(F.array_compact(F.array(F.concat(F.lit("n"), "_n"), F.concat(F.lit("u"), "_u")))).alias("_key"))
    shared = keys.groupBy("_key").agg(F.min("position").alias("_least"), F.count(F.lit(1)).alias("_many")).where("_many > 1").select("_key", "_least")
    links = keys.join(shared, "_key").select(F.col("_least").cast("long").alias("a"), F.col("position").cast("long").alias("b"))
    group = components(links).select(F.col("id").alias("_id"), F.col("class").alias("_group"))
    joined = own.join(group, F.col("position") == F.col("_id"), "left").drop("_id")
    columns = list(entries.columns)

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        names, urls, keep = set(), set(), []
        for i, name, url in group.sort_values("position")[["_n", "_u"]].itertuples():
            if name not in names and (url is None or url not in urls):
                keep.append(i)
                names.add(name)
                urls.add(url)
        return group.loc[keep, columns]

    tied = joined.where("_group is not null").groupBy("_group").applyInPandas(fold, entries.schema)
    return joined.where("_group is null").select(*columns).unionByName(tied)


def add_batch(entries: DataFrame, candidates: DataFrame, sites: DataFrame, rejected: DataFrame, date: str, category: str = "") -> DataFrame:
    """The candidates with the new ones of a batch (position, name, url, description) appended, ids counting on."""
    new = greedy_new(duplicate_reason(entries, sites, rejected, candidates).where("reason is null").drop("reason"))
    own = numbered(new, [F.col("position")]).join(F.broadcast(next_id(candidates)))
    rows = own.select(
        (F.col("next_id") + F.col("_number") - 1).cast("string").alias("id"), "name", "url", F.lit(category).alias("category"), F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce(X.platform(F.col("url")), F.lit("")).alias("ats_type"), F.lit("0").alias("job_count"), F.lit(date).alias("date_added"), F.lit("pending").alias("status"),
    )
    return candidates.select(*rows.columns).unionByName(rows)


def review_batch(candidates: DataFrame, size: int = 10) -> DataFrame:
    """The first pending candidates in order of position."""
    return candidates.where("status = 'pending'").orderBy("position").limit(size)


def review_groups(batch: DataFrame) -> DataFrame:
    """Review rows by category, categories in order, each in order of position."""
    own = batch.withColumn("category", F.coalesce(X.blank(X.strip(F.col("category"))), F.lit("Uncategorized")))
    items = F.sort_array(F.collect_list(F.struct("position", "id", "name", "url", "ats_type", "job_count")))
    return own.groupBy("category").agg(F.count(F.lit(1)).alias("n"), items.alias("items")).orderBy("category")


def decide(candidates: DataFrame, decisions: DataFrame, pending_only: bool = False) -> DataFrame:
    """Candidates with the decision (id, approved) that names them applied to their status.

    A decision from a review file doesn't ask whether the candidate is pending; one by command does.
    """
    own = decisions.select(F.col("id").cast("string").alias("_id"), "approved").dropDuplicates(["_id"])
    both = candidates.join(own, F.col("id") == F.col("_id"), "left")
    able = F.col("approved").isNotNull() & ((F.col("status") == "pending") if pending_only else F.lit(True))
    status = F.when(able, F.when(F.col("approved"), "approved").otherwise("rejected")).otherwise(F.col("status"))
    return both.withColumn("status", status).select(*candidates.columns)


def unknown_decisions(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    return decisions.join(candidates.select("id"), "id", "left_anti")


def cleared(candidates: DataFrame) -> DataFrame:
    """Without processed rows."""
    return candidates.where("status = 'pending'")


def processed(candidates: DataFrame) -> DataFrame:
    return candidates.where("status != 'pending' or status is null")


def status_counts(candidates: DataFrame) -> DataFrame:
    """Counts of the three statuses, 0 where there is none."""
    counted = candidates.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    names = candidates.sparkSession.createDataFrame([("pending",), ("approved",), ("rejected",)], "status string")
    return names.join(counted, "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def shares(rows: DataFrame, key) -> DataFrame:
    """label, n, share and bar of each value of a key; without rows there are none."""
    counted = rows.groupBy(key.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counted.withColumn("_t", total).select("label", "n", X.percentage(F.col("n"), F.col("_t")).alias("share"), X.bar(F.col("n"), F.col("_t")).alias("bar"))


def top_terms(rows: DataFrame, terms, position: str, k: int, least: int = 1) -> DataFrame:
    """The k most frequent terms, ties by first appearance; the least count is asked for after the k are taken."""
    each = rows.select(F.col(position).alias("_p"), F.posexplode(terms).alias("_i", "term"))
    counted = each.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_p", "_i")).alias("_first"))
    return counted.orderBy(F.desc("n"), "_first").limit(k).where(F.col("n") >= least).select("term", "n")


def approval_rate(active: DataFrame, rejected_lines: DataFrame) -> DataFrame:
    """Active sites against lines (value) of the rejected list that name one, as a percentage without decimals."""
    line = X.strip(F.col("value"))
    good = active.agg(F.count(F.lit(1)).alias("active"))
    bad = rejected_lines.agg(F.count_if(line.contains(" - ") & ~line.startswith("#")).alias("rejected"))
    total = F.col("active") + F.col("rejected")
    rate = F.when(total > 0, F.format_string("%.0f", F.col("active").cast("double") / F.nullif(total, F.lit(0)).cast("double") * 100)).otherwise("0")
    return good.join(bad).select("active", "rejected", rate.alias("rate"))


def validation_buckets(probes: DataFrame) -> DataFrame:
    return probes.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") == "redirect").alias("redirects"),
        F.count_if(F.col("status").isin("404", "error")).alias("errors"),
        F.count_if(F.col("better_url").isNotNull()).alias("better"),
    )
