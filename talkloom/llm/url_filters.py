"""URL filters by a temporal list join, in DataFrame functions only.

A list is a table of dated entries (key, action, since): from ``since`` on the key is under ``action``
('block', 'allow', or 'drop' for off the list) until the key's next entry. Entries thus become validity
intervals, and an as-of join (equal key, fetch time inside the interval) evaluates every capture against
the entries in force when it was fetched.

Keys are a host ('a.b.org'), which covers the hosts below it, or a host and first path segment
('a.b.org/x', the segment in its own case). A capture is looked up under its host, every parent of two labels or more, and each of them
with its first path segment; the entry of the longest key in force decides (of equally long ones the greater in byte order).

Defined results: a capture without a URL, a host or a fetch time is not blocked; entries with a null field or an unknown action
don't count; of entries of one key and time the strictest holds (block, allow, drop); repeated captures come
out as often as they come in; an empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)"


def host_of(url: Column) -> Column:
    """Lower-case host without a last dot; NULL if there is none."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", ""), F.lit(""))


def keys_of(url: Column) -> Column:
    """All list keys a URL falls under, longest first by host; an empty array without a host."""
    labels = F.split(host_of(url), r"\.")
    n = F.size(labels)
    hosts = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    segment = F.regexp_extract(url, SEGMENT, 1)
    paths = F.transform(hosts, lambda h: F.concat(h, F.lit("/"), segment))
    return F.coalesce(F.when(F.length(segment) > 0, F.concat(paths, hosts)).otherwise(hosts), F.array().cast("array<string>"))


def validity(entries: DataFrame) -> DataFrame:
    """(key, action, since, until): when each entry is in force; ``until`` is excluded, NULL: still in force. 'drop' rows are left out."""
    rank = F.when(F.col("action") == "block", 3).when(F.col("action") == "allow", 2).when(F.col("action") == "drop", 1)
    # hosts are compared without case, path segments with it
    host = F.substring_index("key", "/", 1)
    key = F.concat(F.lower(host), F.substring(F.col("key"), F.length(host) + 1, F.length("key")))
    known = entries.select(key.alias("key"), rank.alias("rank"), "since").filter("key is not null and rank is not null and since is not null")
    one = known.groupBy("key", "since").agg(F.max("rank").alias("rank"))
    spans = one.withColumn("until", F.lead("since").over(Window.partitionBy("key").orderBy("since"))).filter("rank > 1")
    return spans.select("key", F.when(F.col("rank") == 3, "block").otherwise("allow").alias("action"), "since", "until")


def filter_captures(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", fetched: str = "fetched") -> DataFrame:
    """(key, url, fetched, host, blocked, list_key, list_action, list_since) for every capture; the last three NULL if no entry was in force."""
    looked = captures.select(F.col(key).alias("id"), F.col(url).alias("url"), F.col(fetched).alias("at")).withColumn("keys", keys_of(F.col("url"))).withColumn("n", F.greatest(F.size("keys"), F.lit(1))).withColumn("key", F.explode_outer("keys")).drop("keys")
    spans = validity(entries).withColumnRenamed("key", "entry")
    active = (F.col("key") == F.col("entry")) & (F.col("at") >= F.col("since")) & (F.col("until").isNull() | (F.col("at") < F.col("until")))
    hit = F.when(F.col("entry").isNotNull(), F.struct(F.length("entry").alias("size"), "entry", "action", "since"))
    # each row holds one key of a capture, a key has one entry in force at most: count / n is how often the capture came
    found = looked.join(spans, active, "left").groupBy("id", "url", "at", "n").agg(F.max(hit).alias("hit"), F.count("*").alias("rows"))
    every = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.expr("rows div n"))))
    return every.select(F.col("id").alias(key), F.col("url").alias(url), F.col("at").alias(fetched), host_of(F.col("url")).alias("host"), F.coalesce(F.col("hit.action") == "block", F.lit(False)).alias("blocked"), F.col("hit.entry").alias("list_key"), F.col("hit.action").alias("list_action"), F.col("hit.since").alias("list_since"))
