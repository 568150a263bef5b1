"""Ingestion: batches of a source, their counters, and where to resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def batch_counters(items: DataFrame, seq: str, size: int, routed: Column) -> DataFrame:
    """(batch, items, routed, unrouted, cursor) of batches of size consecutive sequence numbers."""
    low = items.agg(F.min(seq).alias("lo"))
    batch = F.floor((F.col(seq) - F.col("lo")) / size).cast("long")
    out = items.join(F.broadcast(low))  # one row
    return out.groupBy(batch.alias("batch")).agg(F.count("*").alias("items"), F.count_if(routed).alias("routed"), F.count_if(~routed).alias("unrouted"), F.max(seq).alias("cursor"))


def resume(items: DataFrame, seq: str, cursor: int, size: int) -> DataFrame:
    """(items, cursor, batches) that a run from a cursor commits; the filter reaches the scan."""
    rest = items.filter(F.col(seq) > cursor)
    return rest.agg(F.count("*").alias("items"), F.max(seq).alias("cursor"), F.ceil(F.count("*") / size).cast("long").alias("batches"))
