"""The change feed in pages: resumable, in scope, never silently short."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exact
from ..operators.paging import _content, _token
from ..plans.errors import EngineError, invalid
from .store import FEED, FEED_SCAN, Tenant

MAX_COLLECTIONS = 16


@dataclass
class Events:
    events: list[dict[str, Any]]
    cursor: str
    caught_up: bool


@dataclass
class RetentionGap:
    """Events after the cursor are no longer kept; `first` is the first that is."""

    first: int
    requested: int


def table(tenant: Tenant, after: int = 0, until: int | None = None) -> DataFrame:
    """Kept events with after < sequence <= until; only segments that can hold them are read."""
    segments = tenant.manifest()["feed"]["segments"]
    wanted = [s["path"] for s in segments if s["first"] + s["count"] - 1 > after and (until is None or s["first"] <= until)]
    df = tenant._frame(wanted, FEED).where(F.col("sequence") > after)
    return df if until is None else df.where(F.col("sequence") <= until)


def frame(tenant: Tenant, collections: list[str], after: int | None = None, principal: str = "admin") -> DataFrame:
    """All kept events of the collections after a sequence number, as a table; a gap of retention is an error."""
    m = tenant.manifest()
    for name in collections:
        tenant._allow(m, principal, name, "read")
    if after is not None and after + 1 < m["feed"]["first"]:
        raise EngineError("NOT_FOUND", f"events from {after + 1} to {m['feed']['first'] - 1} are no longer kept")
    return table(tenant, after or 0, m["feed"]["next"] - 1).where(F.col("collection").isin(sorted(set(collections))))


def read(tenant: Tenant, collections: list[str], start: str = "beginning", limit: int = 100, principal: str = "admin") -> Events | RetentionGap:
    """A page of events of the collections; start is beginning, now, or the cursor of the page before.

    At most FEED_SCAN events are examined; those of other collections are
    passed over and move the cursor on.
    """
    if not 1 <= len(set(collections)) <= MAX_COLLECTIONS or not 1 <= limit <= FEED_SCAN:
        raise invalid(f"a feed read has 1 to {MAX_COLLECTIONS} collections and a limit of up to {FEED_SCAN}")
    m = tenant.manifest()
    for name in collections:
        tenant._allow(m, principal, name, "read")
    feed = m["feed"]
    head = feed["next"] - 1
    bound = {"incarnation": m["incarnation"], "principal": principal, "collections": sorted(set(collections))}
    if start == "beginning":
        after = feed["first"] - 1
    elif start == "now":
        after = head
    else:
        held = _content(start)
        if any(held.get(k) != v for k, v in bound.items()):
            raise invalid("the cursor belongs to another tenant, caller or set of collections")
        after = int(held["after"])
        if after > head:
            raise invalid("the cursor is beyond the end of the feed")
    if after + 1 < feed["first"]:
        return RetentionGap(feed["first"], after + 1)
    until = min(head, after + FEED_SCAN)
    rows = table(tenant, after, until).where(F.col("collection").isin(bound["collections"])).orderBy("sequence").limit(limit + 1).collect()
    last = rows[limit - 1]["sequence"] if len(rows) > limit else until
    events = [r.asDict() | {"document": None if r["document"] is None else exact.loads(r["document"])} for r in rows[:limit]]
    return Events(events, _token(bound | {"after": last}), last == head)
