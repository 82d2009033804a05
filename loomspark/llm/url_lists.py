"""URL filters over time: a list whose entries come and go, joined as of each capture's fetch time.

A list is a table of dated events, ``kind, value, action, at``: kind ``host`` (this host),
``domain`` (the host or any host below it) or ``prefix`` (host and leading path segments); action
``add`` or ``remove``.  The events of an entry become validity intervals: an added entry is active
from its time (inclusive) to its next event (exclusive).  A capture is looked up under its host,
its parent domains and its path prefixes; of each the entry active at the fetch time counts.

DataFrame functions only.  The join is on the key; where the intervals are proven small they are
broadcast and captures are not shuffled at all, else hot hosts are left to the skew join.  The
matches of a capture are combined in the task that looked it up.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, small, work_dir, written

KINDS = ("host", "domain", "prefix")


def url_host(url: Column) -> Column:
    """The host in lower case without user, port and trailing dots, an IPv6 address in its brackets; null where there
    is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1)
    host = F.lower(F.regexp_replace(host, r"\.+$", ""))
    return F.when(host != "", host)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def intervals(events: DataFrame) -> DataFrame:
    """``key, since, until`` of every time an entry was active.  Events without a value, kind, action or time
    count for nothing; of events of an entry at one time a removal wins; repeated events change nothing."""
    clean = (pick(events, "kind", "value", "action", "at")
             .where(F.col("kind").isin(*KINDS) & F.col("action").isin("add", "remove") & F.col("value").isNotNull()
                    & F.col("at").isNotNull())
             .select(F.concat_ws(":", "kind", F.lower("value")).alias("key"), "at", "action"))
    once = clean.groupBy("key", "at").agg(F.max("action").alias("action"))  # "remove" > "add"
    by_time = Window.partitionBy("key").orderBy("at")
    return (once.withColumn("until", F.lead("at").over(by_time)).where("action = 'add'")
            .select("key", F.col("at").alias("since"), "until"))


def lookup_keys(host: Column, path: Column, depth: int) -> Column:
    """All keys under which a list may name a URL; ``depth``: the most path segments any prefix entry has."""
    labels = F.when(host.startswith("["), F.array(host)).otherwise(F.split(host, r"\."))
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)),
                          lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    parts = F.slice(_segments(F.lower(path)), 1, depth) if depth else F.array().cast("array<string>")
    prefixes = F.transform(F.filter(F.sequence(F.lit(0), F.size(parts)), lambda i: i > 0),
                           lambda i: F.concat(F.lit("prefix:"), host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    return F.when(host.isNotNull(), F.array_union(F.array(F.concat(F.lit("host:"), host)),
                                                  F.array_union(domains, prefixes)))


def evaluate(captures: DataFrame, events: DataFrame, id_col: str = "page_id", url_col: str = "url",
             at_col: str = "fetched_at") -> DataFrame:
    """One row per capture: ``page_id, host, fetched_at, blocked, n_active, entries`` (the keys of the active
    entries in order, comma-joined).  A URL without a host (null, empty, no scheme) and a null fetch time match
    nothing.  Repeated captures are rows of their own; no rows from an empty table."""
    active = written(intervals(events), f"{work_dir(captures.sparkSession, 'url-lists')}/intervals")
    size = active.agg(F.count(F.lit(1)), F.max(F.when(
        F.col("key").startswith("prefix:"), F.size(_segments(F.substring_index("key", ":", -1))) - 1))).first()
    src = pick(captures, id_col, url_col, at_col).toDF("id", "url", "at").select(
        F.monotonically_increasing_id().alias("rid"), "id", "at", url_host(F.col("url")).alias("host"),
        url_path(F.col("url")).alias("path"))
    keys = src.select("rid", "id", "at", "host",
                      F.explode_outer(lookup_keys(F.col("host"), F.col("path"), size[1] or 0)).alias("k"))
    hits = keys.join(small(active, size[0], 200), (F.col("k") == F.col("key")) & (F.col("at") >= F.col("since"))
                     & (F.col("until").isNull() | (F.col("at") < F.col("until"))), "left")
    return hits.groupBy("rid", "id", "host", "at").agg(F.array_sort(F.collect_set("key")).alias("found")).select(
        F.col("id").alias(id_col), "host", F.col("at").alias(at_col), (F.size("found") > 0).alias("blocked"),
        F.size("found").cast("long").alias("n_active"), F.array_join("found", ",").alias("entries"))
