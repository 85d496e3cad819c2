"""URL filters: a temporal join of captures with dated list entries.

A list is a log of dated additions and removals.  It becomes half-open validity
intervals, and every capture is judged by the entries that were active when it
was fetched.  An entry names a domain (which covers its subdomains) or a URL
prefix (host and leading path segments).  A capture offers the few keys it
could match, so the join is an equality on ``(kind, value)`` with the interval
as its residual; no pairs beyond real matches are made.

All DataFrame functions.  Captures meet the list as distinct (URL, time) keys;
keys of a host with a third of all captures are dealt over many tasks.

Hosts are lower-cased, on both sides and before intervals are built; paths
keep their case.  A prefix ends at a path segment, so empty segments and a
final slash do not matter.  A URL offers no more keys than the list's deepest
entry has labels or segments, so a URL of any length is linear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, spread_join, without


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and final dot; null without ``scheme://host``."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""))
    host = F.regexp_replace(host, r"\.$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """Path without query and fragment, at least ``/``; null where the host is."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.when(host_of(url).isNotNull(), F.when(rest == "", "/").otherwise(rest))


def match_keys(url: Column, labels_most: int | None = None, segments_most: int | None = None) -> Column:
    """``array<struct<kind, value>>``: the host's domains, then the URL's prefixes.

    Prefixes end at path segments: for ``/a/b`` they are ``host/``, ``host/a``
    and ``host/a/b``.  Domains of more than ``labels_most`` labels and prefixes of
    more than ``segments_most`` segments are left out.
    """
    labels = F.split(host_of(url), r"\.")
    size = F.size(labels)
    domains = F.transform(
        F.sequence(F.lit(1), size if labels_most is None else F.least(size, F.lit(max(1, labels_most)))),
        lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, 1 + size - i, i), ".").alias("value")),
    )
    segments = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    depth = F.size(segments) if segments_most is None else F.least(F.size(segments), F.lit(segments_most))
    prefixes = F.transform(
        F.sequence(F.lit(0), depth),
        lambda i: F.struct(
            F.lit("prefix").alias("kind"),
            F.concat(host_of(url), F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/")).alias("value"),
        ),
    )
    return F.when(host_of(url).isNotNull(), F.concat(domains, prefixes))


def normal_value(kind: Column, value: Column) -> Column:
    """A list's value as ``match_keys`` writes it: domains without a final dot, prefixes as ``host/a/b``."""
    parts = F.filter(F.split(value, "/"), lambda s: s != "")
    host = F.regexp_replace(F.lower(F.element_at(parts, 1)), r"\.$", "")
    prefix = F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), "/"))
    return F.when(kind == "prefix", F.when(F.size(parts) > 0, prefix)).otherwise(
        F.when(kind == "domain", F.regexp_replace(F.lower(value), r"\.$", "")).otherwise(value)
    )


def intervals(events: DataFrame) -> DataFrame:
    """``kind, value, valid_from, valid_to`` from a log of ``kind, value, action, at``.

    ``action`` is ``add`` or ``remove``; other actions and events without a
    date, kind or value are ignored.  Repeated additions keep the earlier
    start; on one date a removal comes before an addition.  An open interval
    has a null end.  Intervals without length do not arise.  Spellings of one
    domain or prefix (case of the host, final dot, empty segments) are one value.
    """
    named = events.select("kind", normal_value(F.col("kind"), F.col("value")).alias("value"), "action", "at")
    log = named.filter("at is not null and kind is not null and value is not null and action in ('add', 'remove')").groupBy(
        "kind", "value", "at"
    ).agg(F.max(F.col("action") == "add").alias("_on"))
    order = Window.partitionBy("kind", "value").orderBy("at")
    turns = log.withColumn("_before", F.lag("_on", 1, False).over(order)).filter("_on <> _before")
    spans = turns.withColumn("valid_to", F.lead("at").over(order)).filter("_on")
    return spans.select("kind", "value", F.col("at").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, events: DataFrame, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """Every row of ``captures`` with ``blocked boolean, n_entries long, entry string``.

    ``n_entries`` counts the active entries that match and ``entry`` is the
    least of them as ``kind:value``.  A null or unparsable URL and a null time
    match nothing.  Repeated captures are each answered; columns of the added
    names are replaced.
    """
    captures = without(captures, ["blocked", "n_entries", "entry"])
    asked = captures.select(F.col(url).alias("_url"), F.col(at).alias("_at")).filter("_url is not null and _at is not null").distinct()
    active = cut(intervals(events))
    depth = active.agg(
        F.max(F.when(F.col("kind") == "domain", F.size(F.split("value", r"\.")))),
        F.max(F.when(F.col("kind") == "prefix", F.size(F.filter(F.split("value", "/"), lambda s: s != "")) - 1)),
    ).first()
    keys = asked.select("_url", "_at", F.explode(match_keys(F.col("_url"), depth[0] or 0, depth[1] or 0)).alias("_key")).select(
        "_url", "_at", F.col("_key.kind").alias("kind"), F.col("_key.value").alias("value")
    )
    # Entries of a value are few; what is counted is how many captures ask for it.
    asking = keys.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))
    listed = cut(active.groupBy("kind", "value").agg(F.collect_list(F.struct("valid_from", "valid_to")).alias("spans")).join(asking, ["kind", "value"]))
    met = spread_join(keys, listed, ["kind", "value"], "_url").select("_url", "_at", "kind", "value", F.inline("spans")).filter(
        (F.col("_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to")))
    )
    found = met.groupBy("_url", "_at").agg(
        F.count(F.lit(1)).alias("n_entries"), F.min(F.concat_ws(":", "kind", "value")).alias("entry")
    )
    return captures.join(found, (captures[url] == found["_url"]) & (captures[at] == found["_at"]), "left").select(
        *[captures[c] for c in captures.columns],
        F.col("n_entries").isNotNull().alias("blocked"),
        F.coalesce("n_entries", F.lit(0)).alias("n_entries"),
        "entry",
    )
