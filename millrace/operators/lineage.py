"""Causality: correlation ids, and the closure of parent to child edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import scratch


def with_lineage(children: DataFrame, parents: DataFrame) -> DataFrame:
    """children (event_id, parent_id, correlation_id, causation_id): what is omitted comes from the
    parent (event_id, correlation_id), or from the event itself where there is none."""
    p = parents.select(F.col("event_id").alias("parent_id"), F.coalesce("correlation_id", "event_id").alias("parent_correlation"))
    out = children.join(p, "parent_id", "left")
    out = out.withColumn("correlation_id", F.coalesce("correlation_id", "parent_correlation", "event_id"))
    return out.withColumn("causation_id", F.coalesce("causation_id", "parent_id")).drop("parent_correlation")


def descendants(edges: DataFrame, roots: DataFrame, *, parent: str = "parent", child: str = "child", key: list[str] | None = None) -> DataFrame:
    """(root columns, node): every node that roots (node, and any columns) reach, themselves included.

    Cycles and diamonds are safe: a round goes on only with pairs not seen before, and stops
    without any. Each round's result is written, so plans stay short and executors may go.
    """
    key = key or []
    names = [*[c for c in roots.columns if c != "node"], "node"]
    seen = front = scratch(roots.select(*names).distinct(), "closure")
    e = edges.select(*key, F.col(parent).alias("node"), F.col(child).alias("next"))
    while front.limit(1).count():
        step = front.join(e, [*key, "node"]).select(*[F.col("next").alias("node") if c == "node" else F.col(c) for c in names]).distinct()
        front = scratch(step.join(seen, names, "left_anti"), "closure")
        seen = seen.union(front)
    return seen


def joined(deliveries: DataFrame, edges: DataFrame, outcomes: DataFrame) -> DataFrame:
    """New memberships (execution_id, message_id): those of outcomes and all their descendants that aren't
    in deliveries."""
    roots = outcomes.select("execution_id", F.col("message_id").alias("node"))
    reached = descendants(edges, roots, parent="parent_message_id", child="child_message_id")
    names = ["execution_id", "message_id"]
    return reached.select("execution_id", F.col("node").alias("message_id")).distinct().join(deliveries.select(*names), names, "left_anti")
