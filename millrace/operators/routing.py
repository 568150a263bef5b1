"""Routing of events to subscriptions, and of deliveries to handlers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import NoSubscribers

#: Fixed value: names of buses, subscriptions, checkpoints and event types.
NAME = re.compile(r"^[A-Za-z0-9][A-Za-z0-9_.-]*$")
#: A topology is broadcast up to so many routes (a few MB); beyond, it is joined by type.
MAX_BROADCAST_ROUTES = 50_000


class Topology:
    """An immutable set of routes (subscription, pattern); a pattern is an event type or *."""

    def __init__(self, routes: dict[str, set[str]] | None = None):
        self.routes = {k: frozenset(v) for k, v in sorted((routes or {}).items())}
        for name, patterns in self.routes.items():
            for x in (name, *(p for p in patterns if p != "*")):
                if not NAME.match(x):
                    raise ValueError(f"invalid name: {x!r}")

    def with_route(self, subscription: str, pattern: str) -> Topology:
        return Topology({**{k: set(v) for k, v in self.routes.items()}, subscription: set(self.routes.get(subscription, ())) | {pattern}})

    def subscriptions_for(self, event_type: str) -> list[str]:
        return [k for k, v in self.routes.items() if event_type in v or "*" in v]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, p) for k, v in self.routes.items() for p in sorted(v)], "subscription string, pattern string")


def route(events: DataFrame, topology: DataFrame) -> DataFrame:
    """A row for each event and subscription, once each. Two equi-joins, not one with an or: routes by
    type, and wildcard routes to every event. Those are broadcast, beyond MAX_BROADCAST_ROUTES in
    chunks, so that no event leaves its task for them."""
    routes = topology.count()
    side = F.broadcast if routes <= MAX_BROADCAST_ROUTES else (lambda df: df)
    every = topology.filter("pattern = '*'").select("subscription").distinct()
    named = topology.filter("pattern <> '*'").join(side(every), "subscription", "left_anti").distinct()
    out = events.join(side(named), events["event_type"] == named["pattern"]).drop("pattern")
    chunks = max(1, -(-routes // MAX_BROADCAST_ROUTES))
    for k in range(chunks):
        chunk = every.filter(F.pmod(F.xxhash64("subscription"), F.lit(chunks)) == k) if chunks > 1 else every
        out = out.unionByName(events.withColumn("one", F.lit(1)).join(F.broadcast(chunk.withColumn("one", F.lit(1))), "one").drop("one"))
    return out


def unrouted(events: DataFrame, topology: DataFrame) -> DataFrame:
    """Events that no subscription takes."""
    if topology.filter("pattern = '*'").limit(1).count():
        return events.limit(0)
    return events.join(topology.select(F.col("pattern").alias("event_type")).distinct(), "event_type", "left_anti")


def require_subscribers(events: DataFrame, topology: DataFrame) -> None:
    found = unrouted(events, topology).select("event_type").limit(1).collect()
    if found:
        raise NoSubscribers(found[0][0])


def subscription_queue(bus: str, subscription):
    return F.concat(F.lit(f"__bus__:{bus}:"), subscription)


def resolve_handlers(deliveries: DataFrame, handlers: DataFrame) -> DataFrame:
    """deliveries (subscription, event_type) with the handler of their type, else the wildcard's, else null."""
    own = handlers.filter("pattern <> '*'").select("subscription", F.col("pattern").alias("event_type"), F.col("handler").alias("own"))
    wild = handlers.filter("pattern = '*'").select("subscription", F.col("handler").alias("wild"))
    out = deliveries.join(own, ["subscription", "event_type"], "left").join(wild, "subscription", "left")
    return out.withColumn("handler", F.coalesce("own", "wild")).drop("own", "wild")
