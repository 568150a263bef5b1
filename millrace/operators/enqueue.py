"""Enqueueing a batch: identities, conflicts, capacity and ids, each one set-based step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import LEASED, READY
from ..store import scratch


def identity() -> Column:
    """What makes a row the same: its dedup_key, else its job_id; null for an anonymous row."""
    return F.coalesce(F.concat(F.lit("k:"), F.col("dedup_key")), F.concat(F.lit("j:"), F.col("job_id")))


def first_rows(batch: DataFrame) -> DataFrame:
    """The first row by seq of each (queue, identity), one of equally early ones, and every anonymous row.
    One shuffle, of at most a row for each identity and task (window group limit)."""
    named = batch.withColumn("identity", identity())
    keyed = named.filter("identity is not null")
    first = keyed.withColumn("rn", F.row_number().over(Window.partitionBy("queue", "identity").orderBy("seq"))).filter("rn = 1").drop("rn")
    return first.unionByName(named.filter("identity is null"))


def dedup_counts(batch: DataFrame) -> DataFrame:
    """(queue, inserted, deduplicated) of a batch (queue, job_id): of each job one row is inserted, and every
    row without a job. Counts only, so no payload is shuffled."""
    groups = batch.groupBy("queue", "job_id").agg(F.count("*").alias("rows"))
    stay = F.when(F.col("job_id").isNull(), F.col("rows")).otherwise(F.lit(1))
    return groups.groupBy("queue").agg(F.sum(stay).alias("inserted"), F.sum(F.col("rows") - stay).alias("deduplicated"))


def conflicting(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """(seq, queue, kind, value): rows of the batch whose identity meets another one before them, stored or
    in the batch; must be empty. A key meets a different fingerprint; a job_id a different key or
    fingerprint (a row without a key agrees with any); or the two name different stored messages."""
    cols = ["queue", "job_id", "dedup_key", "dedup_fingerprint"]
    rows = batch.select(F.col("seq").cast("long").alias("seq"), F.lit(None).cast("long").alias("id"), *cols)
    found = None
    for kind in ("dedup_key", "job_id"):
        there = meeting(stored, batch, kind).select(F.lit(-1).cast("long").alias("seq"), "id", *cols)
        mark = F.struct(F.col("dedup_fingerprint").alias("print"), F.when(F.lit(kind == "job_id"), F.col("dedup_key")).alias("key"), "id")
        both = rows.union(there).filter(F.col(kind).isNotNull())
        first = both.groupBy("queue", kind).agg(F.min(F.struct("seq", mark.alias("mark"))).alias(f"first_{kind}"))
        met = rows.filter(F.col(kind).isNotNull()).join(first, ["queue", kind])
        x = F.col(f"first_{kind}.mark")
        other = ~x["print"].eqNullSafe(F.col("dedup_fingerprint")) | (F.lit(kind == "job_id") & ~x["key"].eqNullSafe(F.col("dedup_key")))
        bad = met.filter(F.col("dedup_key").isNotNull() & other).select("seq", "queue", F.lit(kind).alias("kind"), F.col(kind).alias("value"))
        found = bad if found is None else found.union(bad)
    keys, jobs = (meeting(stored, batch, k).select("queue", k, F.col("id").alias(f"{k}_id")) for k in ("dedup_key", "job_id"))
    two = rows.filter("dedup_key is not null and job_id is not null").join(keys, ["queue", "dedup_key"]).join(jobs, ["queue", "job_id"])
    two = two.filter("dedup_key_id <> job_id_id").select("seq", "queue", F.lit("both").alias("kind"), F.col("job_id").alias("value"))
    return found.union(two)


def conflicts(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """(queue, kind, value): the identities that conflicting() finds, once each."""
    return conflicting(batch, stored).select("queue", "kind", "value").distinct()


def meeting(stored: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Stored rows with a key that the batch has in the same queue, too. Rows without one take no part."""
    wanted = batch.filter(F.col(key).isNotNull()).select("queue", key).distinct()
    return stored.filter(F.col(key).isNotNull()).join(wanted, ["queue", key], "left_semi")


def named(stored: DataFrame, commands: DataFrame) -> DataFrame:
    """Stored rows that commands (queue, id) name."""
    return stored.join(commands.select("queue", "id").distinct(), ["queue", "id"], "left_semi").select(*stored.columns)


def new_rows(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """The first rows of the batch whose job_id and key aren't stored in their queue. Rows without
    either are set aside first: they would all hash to one partition."""
    first = first_rows(batch)
    out, plain = first.filter("job_id is not null or dedup_key is not null"), first.filter("job_id is null and dedup_key is null")
    for key in ("job_id", "dedup_key"):
        old = meeting(stored, batch, key).select(F.col("queue").alias("q"), F.col(key).alias("k")).distinct()
        without, keyed = out.filter(F.col(key).isNull()), out.filter(F.col(key).isNotNull())
        out = keyed.join(old, (keyed["queue"] == old["q"]) & (keyed[key] == old["k"]), "left_anti").unionByName(without)
    return out.unionByName(plain)


def capacity(batch: DataFrame, stored: DataFrame, limits: DataFrame) -> DataFrame:
    """(queue, pending, new, limit, verdict) for each limited queue: ok, full or impossible.

    No new rows are always ok, whatever is pending.
    """
    pending = stored.filter(F.col("status").isin(READY, LEASED)).groupBy("queue").agg(F.count("*").alias("pending"))
    fresh = new_rows(batch, stored).groupBy("queue").agg(F.count("*").alias("new"))
    out = limits.join(pending, "queue", "left").join(fresh, "queue", "left").na.fill(0, ["pending", "new"])
    verdict = F.when(F.col("new") == 0, "ok").when(F.col("new") > F.col("limit"), "impossible").when(F.col("pending") + F.col("new") > F.col("limit"), "full").otherwise("ok")
    return out.select("queue", "pending", "new", "limit", verdict.alias("verdict"))


def ranged(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows dealt out by the order of by, with mr_part, the place of their range. They are written: planned
    twice, ranges need not be the same."""
    return scratch(rows.repartitionByRange(*by).withColumn("mr_part", F.spark_partition_id()), "ranged")


def numbered(parts: DataFrame, after: int, by: list[str]) -> DataFrame:
    """Of ranged(): ids after a given one, in the order of by, without gathering the rows in one task. Each
    range numbers its own, and starts after the counts of the ranges before it, which are as
    few as there are partitions."""
    inside = Window.partitionBy("mr_part").orderBy(*by)
    sizes = parts.groupBy("mr_part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("mr_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    out = parts.join(F.broadcast(before), "mr_part")  # a row for each partition
    return out.withColumn("id", F.row_number().over(inside) + F.col("before") + after).drop("mr_part", "before")


def number(rows: DataFrame, after: int, by: list[str]) -> DataFrame:
    """Rows with ids after a given one, in the order of by."""
    return numbered(ranged(rows, by), after, by)
