"""URL filtering by dated lists: each capture is judged by the entries active when it was fetched. DataFrame functions only.

1. Dated list events (add or remove of a host, a domain or a URL prefix) become validity intervals: an added entry
   holds until the next event of the same list, kind and value; an addition while it holds changes nothing.
2. A capture's keys are its host, the host and its parent domains, and its URL prefixes by path segment, no longer than
   the longest domain and prefix that the lists have: a key's size doesn't grow with the square of a URL's.
3. An as-of join on (kind, value) with the fetch time inside the interval finds the active entries.

Only the capture's id, time and keys are moved. Intervals are broadcast while their counted number is under a bound;
beyond it both sides are shuffled by key and hot keys are split. A host with a third of all captures meets only the
intervals of its own keys.

Defined cases: null urls, hosts or times match nothing and are allowed; events with a null field are ignored; of
events at one time removal comes last; a time equal to an interval's begin is inside, to its end outside; ids may
repeat and each distinct (id, url, time) is judged; extra columns are passed through by joining on id, url and time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host(url: Column) -> Column:
    """Lower-case host without user, port and final dot; empty if there is none."""
    return F.rtrim(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit("."))


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def intervals(events: DataFrame) -> DataFrame:
    """(list, kind, value, since, until) from events(list, kind, value, action, at); until is null while it holds."""
    known = events.where(F.col("kind").isin("host", "domain", "prefix") & F.col("action").isin("add", "remove"))
    known = known.dropna(subset=["list", "kind", "value", "at"]).withColumn("value", F.lower("value"))
    # one row a moment: a removal there comes last
    moments = known.groupBy("list", "kind", "value", "at").agg(F.max("action").alias("action"))
    order = Window.partitionBy("list", "kind", "value").orderBy("at")
    changed = moments.withColumn("before", F.lag("action").over(order)).where("before IS NULL OR before <> action")
    spans = changed.withColumn("until", F.lead("at").over(order)).where("action = 'add'")
    return spans.select("list", "kind", "value", F.col("at").alias("since"), "until")


def keys(url: Column, labels_most: int = 127, parts_most: int = 64) -> Column:
    """array<struct<kind, value>> of a url: domains of up to labels_most labels, prefixes of up to parts_most segments."""
    h, p = host(url), F.lower(path(url))
    labels = F.split(h, r"\.")
    parents = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - (labels_most - 1)), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("value")))
    parts = F.filter(F.split(p, "/"), lambda s: s != "")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(parts_most))), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(h, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")).alias("value"))
    )
    own = F.array(F.struct(F.lit("host").alias("kind"), h.alias("value")))
    return F.when(h != "", F.concat(own, parents if labels_most > 0 else F.array().cast("array<struct<kind:string,value:string>>"), F.when((F.size(parts) > 0) & F.lit(parts_most > 0), prefixes).otherwise(F.array().cast("array<struct<kind:string,value:string>>"))))


def matches(captures: DataFrame, events: DataFrame, id_column: str = "page_id") -> DataFrame:
    """(id, at, list, kind, value): active entries of captures(id, url, at)."""
    spans = intervals(events)
    long = lambda kind, by: F.coalesce(F.max(F.when(F.col("kind") == kind, F.size(F.split("value", by)))), F.lit(0))
    n, labels, segments = spans.agg(F.count("*"), long("domain", r"\."), long("prefix", "/")).first()
    spans = F.broadcast(spans) if n <= BROADCAST_ROWS else spans
    keyed = captures.where(F.col("at").isNotNull()).select(F.col(id_column), "url", "at", F.inline(keys(F.col("url"), labels, segments)))
    active = (F.col("at") >= F.col("since")) & (F.col("until").isNull() | (F.col("at") < F.col("until")))
    return keyed.join(spans, ["kind", "value"]).where(active).select(id_column, "url", "at", "list", "kind", "value").distinct()


def judge(captures: DataFrame, events: DataFrame, id_column: str = "page_id") -> DataFrame:
    """One row per distinct capture (id, url, at): blocked, and n_entries active at its time."""
    rows = captures.select(id_column, "url", "at").distinct()
    hits = matches(rows, events, id_column).groupBy(id_column, "url", "at").agg(F.count("*").alias("n"))
    # the rows without an entry are joined back through a union, so null fields need no null-safe join
    every = rows.select(id_column, "url", "at", F.lit(0).cast("long").alias("n")).unionByName(hits)
    judged = every.groupBy(id_column, "url", "at").agg(F.sum("n").alias("n_entries"))
    return judged.select(id_column, "url", "at", (F.col("n_entries") > 0).alias("blocked"), "n_entries")
