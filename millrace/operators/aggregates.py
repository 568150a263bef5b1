"""Counts, diagnostics, execution views, latency summaries and id checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ACKED, FAILED, LEASED, READY, STATE_NAMES


def _count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def _states(column: str = "status") -> list[Column]:
    return [_count(F.col(column) == k).alias(name) for k, name in STATE_NAMES.items()]


def stats(messages: DataFrame) -> DataFrame:
    """(queue, ready, processing, acked, failed)."""
    return messages.groupBy("queue").agg(*_states())


def diagnostics(messages: DataFrame, now: int, limit: int | None = None) -> DataFrame:
    """One row for each queue: counts by state, leases, oldest times, ages and free slots, in one aggregate."""
    lapsed = (F.col("status") == LEASED) & (F.col("lease_until") <= now)
    out = messages.groupBy("queue").agg(
        *_states(),
        F.min(F.when((F.col("status") == READY) & (F.col("available_at") <= now), F.col("available_at"))).alias("oldest_available_at"),
        F.min(F.when(F.col("status") == LEASED, F.col("updated_at"))).alias("oldest_processing_updated_at"),
        _count((F.col("status") == LEASED) & (F.col("lease_until") > now)).alias("active_leases"),
        _count(lapsed).alias("expired_leases"),
        F.min(F.when(lapsed, F.col("lease_until"))).alias("oldest_expired_lease_until"),
    )
    pending = F.col("ready") + F.col("processing")
    free = F.lit(None).cast("long") if limit is None else F.greatest(F.lit(limit) - pending, F.lit(0))

    def age(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.greatest(F.lit(now) - F.col(c), F.lit(0)))

    return out.withColumns({
        "pending": pending, "available_slots": free.cast("long"), "oldest_ready_age_ms": age("oldest_available_at"),
        "oldest_processing_age_ms": age("oldest_processing_updated_at"), "oldest_expired_age_ms": age("oldest_expired_lease_until"),
    })


def failed_page(messages: DataFrame, *, limit: int = 100, offset: int = 0) -> DataFrame:
    """Dead letters by id, one page; attempts are the public, zero-based ones, at least 0."""
    out = messages.filter(F.col("status") == FAILED).orderBy("id").offset(offset).limit(limit)
    return out.withColumn("attempts", F.greatest(F.col("attempts") - 1, F.lit(0)))


def execution_states(deliveries: DataFrame, messages: DataFrame) -> DataFrame:
    """(execution_id, total, ready, processing, acked, failed), always derived by a join."""
    m = messages.select(F.col("id").alias("message_id"), "status")
    return deliveries.join(m, "message_id").groupBy("execution_id").agg(F.count("*").alias("total"), *_states())


def execution_snapshot(executions: DataFrame, runtime: DataFrame, deliveries: DataFrame, messages: DataFrame) -> DataFrame:
    """One row for each execution with its runtime and its members' states; zero members give zeros."""
    m = messages.select(F.col("id").alias("message_id"), "status")
    members = deliveries.join(m, "message_id", "left").groupBy("execution_id").agg(F.count("message_id").alias("total"), *_states())
    names = ["total", *STATE_NAMES.values()]
    shared = [c for c in runtime.columns if c in executions.columns and c != "execution_id"]
    out = executions.join(runtime.drop(*shared), "execution_id").join(members, "execution_id", "left")
    return out.na.fill(0, names)


def finished(executions: DataFrame, deliveries: DataFrame, messages: DataFrame) -> DataFrame:
    """Executions whose source is completed and none of whose members is ready or leased."""
    pending = messages.filter(F.col("status").isin(READY, LEASED)).select(F.col("id").alias("message_id"))
    busy = deliveries.join(pending, "message_id", "left_semi").select("execution_id")
    return executions.filter("source_completed").join(busy, "execution_id", "left_anti")


def reopened(executions: DataFrame, deliveries: DataFrame, retried: DataFrame) -> DataFrame:
    """Executions that hold one of the retried messages (id)."""
    of = deliveries.join(retried.select(F.col("id").alias("message_id")), "message_id", "left_semi")
    return executions.join(of, "execution_id", "left_semi")


def latency_summary(samples: DataFrame, by: str, value: str) -> DataFrame:
    """Count, least, most, mean, nearest-rank percentiles and operations a second (values in microseconds)."""
    p = lambda q: F.expr(f"percentile_disc({q}) within group (order by {value})")
    return samples.groupBy(by).agg(
        F.count(value).alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"),
        p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), (F.count(value) * 1e6 / F.sum(value)).alias("ops_per_second"),
    )


def id_check(ids: DataFrame, by: str, column: str) -> DataFrame:
    """(count, sum, xor, digest) by group; the digest is the sum of the first 32 bits of each id's SHA-256.

    All four are sums of partial results, so groups of any size meet in no task.
    """
    piece = F.conv(F.substring(F.sha2(F.col(column).cast("string"), 256), 1, 8), 16, 10).cast("bigint")
    return ids.groupBy(by).agg(F.count("*").alias("count"), F.sum(column).alias("sum"), F.bit_xor(column).alias("xor"), F.sum(piece).alias("digest"))


def digest_sums(ids: DataFrame, column: str) -> DataFrame:
    """One row d0 ... d7: sums of the eight 32-bit pieces of each id's SHA-256, mergeable over any parts."""
    digest = F.sha2(F.col(column).cast("string"), 256)
    return ids.agg(*[F.coalesce(F.sum(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint")), F.lit(0)).alias(f"d{k}") for k in range(8)])


def digest_256(sums: list[int]) -> int:
    """The sum of the whole digests modulo 2**256, from digest_sums()."""
    return sum(s << 32 * (7 - k) for k, s in enumerate(sums)) % (1 << 256)


def reconcile(outcomes: DataFrame, messages: DataFrame) -> DataFrame:
    """(queue, claims, settled, acks, acked, ok): whether a run's counted outcomes (queue, outcome) agree
    with what is stored."""
    seen = outcomes.groupBy("queue").agg(F.count("*").alias("claims"), F.count_if(F.col("outcome").isin("ack", "nack", "fail", "lost")).alias("settled"), F.count_if(F.col("outcome") == "ack").alias("acks"))
    out = seen.join(stats(messages).select("queue", "acked"), "queue", "full").na.fill(0)
    return out.withColumn("ok", (F.col("claims") == F.col("settled")) & (F.col("acks") == F.col("acked")))


def sample_every(rows: DataFrame, column: str, total: int, limit: int) -> DataFrame:
    """A systematic sample by id: every stride-th, in order, limit at most."""
    stride = max(1, -(-total // limit))
    return rows.filter(F.col(column) % stride == 0).orderBy(column).limit(limit)


def throughput(events: DataFrame, by: str, start: str, end: str) -> DataFrame:
    """First and last times of each role, and rows a second between them."""
    out = events.groupBy(by).agg(F.min(start).alias("first_at"), F.max(end).alias("last_at"), F.count("*").alias("n"))
    return out.withColumn("per_second", F.col("n") * 1000.0 / F.greatest(F.col("last_at") - F.col("first_at"), F.lit(1)))


def violations(messages: DataFrame, deliveries: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(rule, n): how many rows break each constraint that files can't enforce."""
    def row(rule, df):
        return df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")

    ids = messages.select(F.col("id").alias("message_id"))
    checks = [
        row("duplicate id", messages.groupBy("id").count().filter("count > 1")),
        row("duplicate job_id", messages.filter("job_id is not null").groupBy("queue", "job_id").count().filter("count > 1")),
        row("unknown status", messages.filter(~F.col("status").isin(READY, LEASED, ACKED, FAILED) | F.col("status").isNull())),
        row("lease without receipt", messages.filter((F.col("status") == LEASED) & (F.col("receipt").isNull() | F.col("lease_until").isNull()))),
        row("receipt without lease", messages.filter((F.col("status") != LEASED) & F.col("receipt").isNotNull())),
        row("delivery without message", deliveries.join(ids, "message_id", "left_anti")),
    ]
    if edges is not None:
        for end in ("parent_message_id", "child_message_id"):
            checks.append(row(f"edge without {end}", edges.join(ids, edges[end] == ids["message_id"], "left_anti")))
    out = checks[0]
    for c in checks[1:]:
        out = out.union(c)
    return out
