"""URL filters by a temporal join with dated list entries.

Block and allow lists change over time. Dated entries (a pattern was added or removed)
become validity intervals, and every capture of a page is judged by the entries that
were active when it was fetched. Patterns are hosts with all their subdomains
(``domain``) or a host and leading path (``prefix``, ending in a slash).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyguard.llm.order import ROW, numbered

SLICE_DAYS = 30  # intervals are cut at this grid, so that the join is an equality
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)"


def host(url) -> Column:
    """Lower-case host of a url; null where there is none."""
    h = F.lower(F.regexp_extract(url, _HOST, 1))
    return F.when(h != "", h)


def intervals(entries: DataFrame) -> DataFrame:
    """list, kind, pattern, valid_from, valid_to (exclusive, null while open).

    ``entries`` has list, kind, pattern, action (add, remove) and dated_at. Repeated
    additions go on with the interval, removals without an addition are ignored, and a
    removal beats an addition of the same time. Entries with a null field are ignored.
    """
    key = ["list", "kind", "pattern"]
    events = entries.select(*key, "action", "dated_at").dropna().where(F.col("action").isin("add", "remove")).distinct()
    w = Window.partitionBy(*key).orderBy("dated_at", "action")
    turns = events.withColumn("before", F.lag("action").over(w)).where("action != coalesce(before, 'remove')")
    spans = turns.withColumn("valid_to", F.lead("dated_at").over(w)).where("action = 'add'")
    return spans.select(*key, F.col("dated_at").alias("valid_from"), "valid_to").where("valid_to IS NULL OR valid_to > valid_from")


def _slice(ts) -> Column:
    return F.floor(F.unix_seconds(ts) / (86_400 * SLICE_DAYS)).cast("int")


def _keys(url) -> Column:
    """Every (kind, pattern) that an entry covering ``url`` can have."""
    h, path = host(url), F.regexp_extract(url, _PATH, 1)
    parts = F.split(h, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(parts, i, F.size(parts)), ".").alias("pattern")),
    )
    segments = F.split(path, "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(segments) - 1, F.lit(1))),
        lambda i: F.struct(
            F.lit("prefix").alias("kind"), F.concat(h, F.array_join(F.slice(segments, F.lit(1), i), "/"), F.lit("/")).alias("pattern")
        ),
    )
    return F.when(h.isNotNull(), F.concat(suffixes, prefixes))


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` (url, fetched_at and others) with the entries active at fetch time.

    Adds active (number of active entries), list, pattern and valid_from of the deciding
    one (the longest pattern; allow before block, then the older) and blocked. Captures
    without host or time match nothing and are not blocked. Repeated captures are judged
    one by one; columns of the added names are replaced.
    """
    added = ("active", "list", "pattern", "valid_from", "blocked")
    rows = numbered(captures.drop(*added), "url-captures")
    spans = intervals(entries)
    until = rows.agg(F.max(_slice("fetched_at"))).first()[0]
    last = F.greatest(_slice("valid_from"), F.coalesce(_slice("valid_to"), F.lit(until).cast("int")))
    spans = spans.withColumn("slice", F.explode(F.sequence(_slice("valid_from"), last)))
    asked = rows.select(ROW, "fetched_at", _slice("fetched_at").alias("slice"), F.explode(_keys(F.col("url"))).alias("k"))
    asked = asked.select(ROW, "fetched_at", "slice", "k.kind", "k.pattern")
    hit = asked.join(spans, ["kind", "pattern", "slice"]).where(
        "fetched_at >= valid_from AND (valid_to IS NULL OR fetched_at < valid_to)"
    )
    rank = F.struct(F.length("pattern").alias("size"), (F.col("list") == "allow").alias("allow"), (-F.unix_micros("valid_from")).alias("age"))
    best = hit.groupBy(ROW).agg(
        F.count(F.lit(1)).alias("active"), F.max(F.struct(rank.alias("rank"), "list", "pattern", "valid_from")).alias("b")
    )
    best = best.select(ROW, "active", "b.list", "b.pattern", "b.valid_from")
    out = rows.join(best, ROW, "left").drop(ROW)
    return out.withColumn("active", F.coalesce("active", F.lit(0))).withColumn("blocked", F.coalesce(F.col("list") == "block", F.lit(False)))
