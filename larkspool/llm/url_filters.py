"""URL filters with a history: which list entry was active when a page was fetched.

A list entry (pattern, action, effective) says that from a time on a pattern is blocked,
allowed, or on the list no more (``block``, ``allow``, ``remove``). The entries of a pattern
become validity intervals: each lasts until the next one. A pattern is a domain
(``example.com``, with everything below it) or a host and leading path segments
(``www.example.com/a/b``); hosts are in lower case, paths as they are. Of the patterns active at a capture's fetch time the longest
decides.

The as-of join is an equality join on pattern and period of PERIOD_DAYS: an interval is
laid out over those periods it overlaps in which something was captured, a capture lies in
one period, and what is left is a comparison of times. So a capture meets no more intervals
of a pattern than there are changes in one period, and a stray date far away adds one
period, not all in between. Only patterns as deep as the deepest of the list are made of a URL. A host with a third of all captures is dealt out over
periods and SALTS; a list below the size limit is broadcast instead.

Entries of one pattern and time are one entry: block before allow before remove. Null
patterns, times or unknown actions are no entries. A capture without a URL, host or fetch
time matches nothing. Identical captures give one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspool.llm.common import ID_BROADCAST_BYTES, stage, staged_bytes

PERIOD_DAYS = 30
SALTS = 8
_RANK = {"block": 3, "allow": 2, "remove": 1}


def host(url: Column) -> Column:
    """The host in lower case, without user, port and a trailing dot; empty if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.lower(F.regexp_replace(authority, r"^.*@|:\d*$", "")), r"\.$", "")


def patterns_of(url: Column, most_labels: int, most_segments: int) -> Column:
    """The patterns that cover a URL: host suffixes of two labels or more, and host with leading path segments.

    Only those of up to so many labels and segments, as longer ones are not on the list.
    """
    labels = F.split(host(url), r"\.")
    suffixes = F.when(
        F.size(labels) >= 2,
        F.transform(
            F.sequence(F.greatest(F.lit(1), F.least(F.size(labels) - 1, F.size(labels) - most_labels + 1)), F.size(labels) - 1),
            lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."),
        ),
    ).otherwise(F.array(host(url)))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1)
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    paths = F.when(
        (F.size(segments) >= 1) & F.lit(most_segments >= 1),
        F.transform(
            F.sequence(F.lit(1), F.least(F.size(segments), F.lit(max(1, most_segments)))),
            lambda i: F.concat(host(url), F.lit("/"), F.array_join(F.slice(segments, 1, i), "/")),
        ),
    ).otherwise(F.array().cast("array<string>"))
    return F.when(host(url) != "", F.concat(suffixes, paths)).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, action, valid_from, valid_to (null: still open) of every entry that adds a rule."""
    rank = F.create_map(*(F.lit(x) for pair in _RANK.items() for x in pair))
    entries = entries.select(
        F.col("pattern").cast("string").alias("pattern"),
        F.col("effective").cast("timestamp").alias("valid_from"),
        F.try_element_at(rank, F.col("action")).alias("rank"),
    ).dropna()
    entries = entries.groupBy("pattern", "valid_from").agg(F.max("rank").alias("rank"))
    after = F.lead("valid_from").over(Window.partitionBy("pattern").orderBy("valid_from"))
    names = F.create_map(*(F.lit(x) for k, v in _RANK.items() for x in (v, k)))
    dated = entries.withColumn("valid_to", after).where(F.col("rank") > _RANK["remove"])
    return dated.select("pattern", F.element_at(names, F.col("rank")).alias("action"), "valid_from", "valid_to")


def _period(time: Column) -> Column:
    return F.floor(F.unix_timestamp(time) / (PERIOD_DAYS * 86_400)).cast("bigint")


def evaluate(captures: DataFrame, entries: DataFrame, key: str = "page_id") -> DataFrame:
    """``key``, url, fetch_time of every capture, the deciding pattern and action, and ``blocked``."""
    captures = captures.select(key, "url", F.col("fetch_time").cast("timestamp").alias("fetch_time"))
    # At most one number per PERIOD_DAYS of the calendar.
    periods = captures.agg(F.collect_set(_period(F.col("fetch_time"))).alias("periods")).scalar()
    begin, end = _period(F.col("valid_from")), _period(F.col("valid_to"))
    overlapped = F.filter("periods", lambda p: (p >= begin) & (end.isNull() | (p <= end)))
    rules = intervals(entries).withColumn("periods", periods).withColumn("period", F.explode(overlapped)).drop("periods")
    rules = stage(rules, "url-rules")

    pattern = F.col("pattern").cast("string")
    parts = [F.max(F.length(pattern) - F.length(F.replace(pattern, F.lit(x), F.lit("")))) for x in (".", "/")]
    dots, slashes = entries.agg(*parts).first()
    tried = captures.withColumn("pattern", F.explode_outer(patterns_of(F.col("url"), (dots or 0) + 1, slashes or 0)))
    tried = tried.withColumn("period", _period(F.col("fetch_time")))
    on = ["pattern", "period"]
    if staged_bytes(rules) <= ID_BROADCAST_BYTES:
        rules = F.broadcast(rules)
    else:
        rules = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        tried = tried.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
        on = [*on, "salt"]
    met = tried.join(rules, on, "left")
    active = (F.col("valid_from") <= F.col("fetch_time")) & (
        F.col("valid_to").isNull() | (F.col("fetch_time") < F.col("valid_to"))
    )
    found = F.when(active, F.struct(F.length("pattern").alias("size"), "pattern", "action"))
    best = met.groupBy(key, "url", "fetch_time").agg(F.max(found).alias("rule"))
    return best.select(
        key,
        "url",
        "fetch_time",
        F.col("rule.pattern").alias("pattern"),
        F.col("rule.action").alias("action"),
        F.coalesce(F.col("rule.action") == "block", F.lit(False)).alias("blocked"),
    )
