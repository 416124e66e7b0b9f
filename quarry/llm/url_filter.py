"""URL filtering against dated lists, in DataFrame operations only.

A list's history of additions and removals becomes validity intervals. A capture is matched, by equality, with the
entries for its host, the domains above it and the prefixes of its path; of those matches the ones count whose
interval holds the time of the fetch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import spool

#: Kinds of entries: a host and all below it, or a host with the beginning of a path.
DOMAIN, PREFIX = "domain", "prefix"


def host_of(url: Column) -> Column:
    """Lower case, without user, port and trailing dots; null if the url has no authority."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    host = F.rtrim(F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", "")), F.lit("."))
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """From the slash after the authority up to a query or fragment; `/` if there is none."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def intervals(events: DataFrame) -> DataFrame:
    """list_id, pattern, valid_from, valid_to (null: still valid) of events(list_id, pattern, action, at).

    action is add or remove. An entry is valid from an addition up to the next event of the same list and pattern,
    and adjoining intervals stay apart. Of events at one time an addition comes last and so decides. Repeated events
    count once; events without list, pattern, time or a known action are left out.
    """
    pattern = F.trim("pattern")
    host = F.regexp_extract(pattern, r"^[^/]*", 0)
    folded = F.concat(F.lower(host), F.substring(pattern, F.length(host) + 1, F.length(pattern)))  # paths keep their case
    known = events.select("list_id", folded.alias("pattern"), F.lower("action").alias("action"), "at").dropna().where(F.col("action").isin("add", "remove"))
    latest = known.groupBy("list_id", "pattern", "at").agg(F.min("action").alias("action"))
    later = Window.partitionBy("list_id", "pattern").orderBy("at")
    return latest.withColumn("valid_to", F.lead("at").over(later)).where("action = 'add'").select("list_id", "pattern", F.col("at").alias("valid_from"), "valid_to")


def depths_of(patterns: DataFrame) -> tuple[list[int], list[int]]:
    """Numbers of labels of the patterns that are hosts alone, and of slashes of those with a path: a few small numbers."""
    slashes = F.length("pattern") - F.length(F.regexp_replace("pattern", "/", ""))
    dots = F.length("pattern") - F.length(F.regexp_replace("pattern", r"\.", ""))
    rows = patterns.select(slashes.alias("slashes"), F.when(slashes == 0, dots + 1).otherwise(0).alias("labels")).distinct().collect()
    return sorted({r.labels for r in rows if not r.slashes}), sorted({r.slashes for r in rows if r.slashes})


def keys_of(host: Column, path: Column, depths: tuple[list[int], list[int]]) -> Column:
    """Patterns of these depths that would match: domains from the host upwards, and the host with prefixes of its path.

    Prefixes end before or after a slash, or are the whole path. Each depth costs one pass over the url.
    """
    labels, slashes = depths
    n_labels = F.length(host) - F.length(F.regexp_replace(host, r"\.", "")) + 1
    n_slashes = F.length(path) - F.length(F.regexp_replace(path, "/", ""))
    domains = [F.when(n_labels >= k, F.substring_index(host, ".", -k)) for k in labels]
    opened = [F.when(n_slashes >= k, F.concat(host, F.substring_index(path, "/", k + 1))) for k in slashes]
    closed = [F.when(n_slashes >= k, F.concat(host, F.substring_index(path, "/", k), F.lit("/"))) for k in slashes]
    return F.array_distinct(F.array_compact(F.array(*domains, *opened, *closed).cast("array<string>")))


def filtered(captures: DataFrame, events: DataFrame, id_col: str = "page_id", url_col: str = "url", at_col: str = "fetched_at") -> DataFrame:
    """Per row of captures: page_id, url, host, fetched_at, blocked, n_entries, first_list (the smallest list_id).

    Captures are first reduced to distinct (url, time), so that a page fetched over and over is looked up once; the
    lookup table and the verdicts are written down before they are joined, which lets hot hosts be split. A url
    is cut only at the depths that the lists have, so that a very long one costs no more than its length a depth.
    A null or malformed url or a null time matches nothing. Entries of one time and place each count. Repeated rows
    each give a row, an empty table an empty result; columns other than those named are ignored.
    """
    base = captures.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(at_col).alias("fetched_at"))
    asked = base.select("url", "fetched_at").where("url IS NOT NULL AND fetched_at IS NOT NULL").distinct()
    asked = asked.withColumn("host", host_of(F.col("url"))).where("host IS NOT NULL")
    valid = spool(intervals(events))
    asked = asked.select("url", "fetched_at", F.explode(keys_of(F.col("host"), path_of(F.col("url")), depths_of(valid))).alias("key"))
    active = (F.col("key") == F.col("pattern")) & (F.col("valid_from") <= F.col("fetched_at")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    hits = asked.join(valid, active).groupBy("url", "fetched_at").agg(F.count(F.lit(1)).alias("n"), F.min("list_id").alias("first_list"))
    hits = spool(hits.select(F.col("url").alias("__url"), F.col("fetched_at").alias("__at"), "n", "first_list"))
    found = base.join(hits, (F.col("url") == F.col("__url")) & (F.col("fetched_at") == F.col("__at")), "left")
    return found.select("page_id", "url", host_of(F.col("url")).alias("host"), "fetched_at", F.col("n").isNotNull().alias("blocked"), F.coalesce("n", F.lit(0)).cast("long").alias("n_entries"), "first_list")
