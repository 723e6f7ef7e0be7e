"""URL filters by a temporal list join, in DataFrame functions only.

A list is a log of dated entries: on its date an entry adds or removes a key (a domain, or a host with a
path prefix) with a verdict.  Entries become validity intervals: one holds from its date up to the next
entry of the same list and key.  A capture is looked up under its host, each parent domain and each path
prefix, and the as-of join keeps the intervals that hold at its fetch time.

Intervals are clipped to the captures' own range of time, cut at the borders of periods and joined on (key, period), so a
key with a long history meets a capture only with the entries of that period, and two of one list and key never
hold at once.  A period lasts half as long as the average clipped interval, which keeps the list side below four rows an entry,
whatever the range.  The intervals are broadcast while there are at most `BROADCAST_ROWS`; beyond that the join is
shuffled and adaptive execution splits a hot key.  An allowing entry outranks blocking ones.

A verdict is of (url, fetch time) alone, and captures meet theirs by these values: only matches and verdicts are grouped.

Defined results: a null, empty or hostless url matches nothing and is kept; a null fetch time matches
nothing; entries without key or date are left out; of entries of one list, key and date the removing one
counts, then the larger verdict; an entry holds from its own instant, and ends just before the next one;
repeated captures give repeated rows; empty lists block nothing; other columns are carried, and those named
host, blocked or matched are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Steps, spare

BROADCAST_ROWS = 500_000
#: Seconds of the shortest period.
SHORTEST = 3600


def host_of(url: Column) -> Column:
    """Lower-case host without user and port, empty if there is none."""
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def keys_of(url: Column) -> Column:
    """The host, its parent domains, and the host with each prefix of the path's segments."""
    host, labels = host_of(url), F.split(host_of(url), r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.filter(F.split(path_of(url), "/"), lambda p: p != "")
    none = F.array().cast("array<string>")
    prefixes = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))).otherwise(none)
    return F.when(F.coalesce(host, F.lit("")) != "", F.array_distinct(F.concat(parents, prefixes))).otherwise(none)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, verdict, valid_from, valid_to) of entries (list, key, action, verdict, dated); valid_to is null while none follows."""
    clean = entries.where("key is not null and dated is not null and action in ('add', 'remove')")
    # One entry for each list, key and date, whatever was repeated.
    single = clean.groupBy("list", "key", "dated").agg(F.max(F.struct(F.col("action") == "remove", "verdict")).alias("last"))
    log = Window.partitionBy("list", "key").orderBy("dated")
    ends = single.withColumn("valid_to", F.lead("dated").over(log))
    return ends.where(~F.col("last.col1")).select("list", "key", F.col("last.verdict").alias("verdict"), F.col("dated").alias("valid_from"), "valid_to")


def by_period(spans: DataFrame, first: int, last: int) -> tuple[DataFrame, int]:
    """The intervals that meet the seconds from `first` to `last`, a row for each period that one meets, and the seconds of a period."""
    low = F.greatest(F.unix_seconds("valid_from"), F.lit(first))
    high = F.least(F.coalesce(F.unix_seconds("valid_to"), F.lit(last)), F.lit(last))
    clipped = spans.withColumns({"_low": low, "_high": high}).where("_low <= _high")
    mean = clipped.agg(F.avg(F.col("_high") - F.col("_low"))).first()[0] or 0
    period = max(int(mean / 2) + 1, SHORTEST)
    numbers = F.sequence(F.floor(F.col("_low") / period), F.floor(F.col("_high") / period))
    return clipped.select("list", "key", "verdict", "valid_from", "valid_to", F.explode(numbers).alias("period")), period


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """`captures` with host, blocked, and matched (sorted `list:verdict:key` of the entries that hold)."""
    steps = Steps(captures.sparkSession, "urls")
    carried = [c for c in captures.columns if c not in ("host", "blocked", "matched")]
    asked = captures.select(F.col(url).alias("url"), F.col(fetched).cast("timestamp").alias("at"))
    ends = asked.agg(F.unix_seconds(F.min("at")), F.unix_seconds(F.max("at"))).first()
    keyed = asked.where("at is not null").select("url", "at", F.explode(keys_of(F.col("url"))).alias("key"))
    spans, period = by_period(steps.write(intervals(entries)), ends[0] or 0, ends[1] or 0)
    if spans.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        spans = F.broadcast(spans)
    held = keyed.withColumn("period", F.floor(F.unix_seconds("at") / period)).join(spans, ["key", "period"])
    held = held.where((F.col("at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to"))))
    own = {name: spare(captures, name) for name in ("_url", "_at", "_matched", "_blocked")}
    found = held.groupBy(F.col("url").alias(own["_url"]), F.col("at").alias(own["_at"])).agg(
        F.sort_array(F.collect_set(F.concat_ws(":", "list", "verdict", "key"))).alias(own["_matched"]),
        (F.max((F.col("verdict") == "block").cast("int")) > F.max((F.col("verdict") == "allow").cast("int"))).alias(own["_blocked"]),
    )
    same = (F.col(url) == F.col(own["_url"])) & (F.col(fetched).cast("timestamp") == F.col(own["_at"]))
    out = captures.select(*carried).join(found, same, "left")
    return out.select(*carried, host_of(F.col(url)).alias("host"), F.coalesce(own["_blocked"], F.lit(False)).alias("blocked"), F.coalesce(own["_matched"], F.array().cast("array<string>")).alias("matched"))
