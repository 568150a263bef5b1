"""State changes of messages, as projections over a snapshot at a given time.

Each takes the messages and returns all of them after the change; nothing shuffles but joins
with a table of commands. ``now`` is always given, in epoch milliseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ACKED, FAILED, LEASED, READY

_NULL = None  # as a value of _set()
TOUCHED = "mr_touched"


def touched(change, messages: DataFrame, *args, **named) -> DataFrame:
    """Only the messages that a change of this module has changed."""
    return change(messages.withColumn(TOUCHED, F.lit(False)), *args, **named).filter(TOUCHED).drop(TOUCHED)


def can_start(now: int) -> Column:
    return (F.col("status") == READY) & (F.col("available_at") <= now)


def is_expired(now: int) -> Column:
    return (F.col("status") == LEASED) & (F.col("lease_until") <= now)


def deliverable(messages: DataFrame, now: int) -> DataFrame:
    """(queue, deliverable): whether anything could be claimed, expired leases included."""
    return messages.groupBy("queue").agg(F.bool_or(F.coalesce(can_start(now) | is_expired(now), F.lit(False))).alias("deliverable"))


def _set(messages: DataFrame, when: Column, **values: Column | None) -> DataFrame:
    """All rows, with these columns changed where when is true. Conditions see the old row. A column
    TOUCHED, where the messages have one, becomes true for those rows."""
    hit = F.coalesce(when, F.lit(False))
    if TOUCHED in messages.columns:
        values[TOUCHED] = F.lit(True)
    new = {k: F.when(hit, (F.lit(None) if v is None else v).cast(messages.schema[k].dataType)).otherwise(F.col(k)) for k, v in values.items() if k in messages.columns}
    return messages.select(*[new[c].alias(c) if c in new else F.col(c) for c in messages.columns])


def reclaim(messages: DataFrame, now: int, *, max_attempts: int | None = None) -> DataFrame:
    """Expired leases become ready at once, or failed when their attempts are used up.

    max_attempts replaces the budget of those rows first. Earlier error texts stay.
    """
    old = is_expired(now)
    budget = F.col("max_attempts") if max_attempts is None else F.lit(max_attempts)
    more = F.col("attempts") < budget
    return _set(
        messages, old, max_attempts=budget, status=F.when(more, READY).otherwise(FAILED), available_at=F.when(more, F.lit(now)).otherwise(F.col("available_at")),
        receipt=_NULL, lease_until=_NULL, failure_reason=F.when(more, F.col("failure_reason")).otherwise("retries_exhausted"), updated_at=F.lit(now),
    )


def fail_over_budget(messages: DataFrame, now: int, max_attempts: int) -> DataFrame:
    """Ready rows that have used a reduced budget fail."""
    used = can_start(now) & (F.col("attempts") >= max_attempts)
    return _set(messages, used, status=F.lit(FAILED), max_attempts=F.lit(max_attempts), failure_reason=F.lit("retries_exhausted"), updated_at=F.lit(now))


#: Picked ids are broadcast up to so many (a few MB) where the number of queues is known; beyond, joined.
MAX_BROADCAST_PICKS = 200_000


def claim(messages: DataFrame, now: int, *, lease_ms: int, n: int = 1, receipt: str = "r", max_attempts: int | None = None, queues: int | None = None) -> DataFrame:
    """All messages after the n oldest of each queue are leased; a receipt is its token and the id.

    The steps are those of one transaction: expired leases are reclaimed, rows over a reduced
    budget fail, and the first by id are taken. A window limit keeps n rows of each queue
    before the shuffle, so a queue with most of the rows meets in no task. queues: how many
    there are, if known.
    """
    now_ready = reclaim(messages, now, max_attempts=max_attempts)
    if max_attempts is not None:
        now_ready = fail_over_budget(now_ready, now, max_attempts)
    first = now_ready.filter(can_start(now)).select("queue", "id")
    picked = first.withColumn("rn", F.row_number().over(Window.partitionBy("queue").orderBy("id"))).filter(F.col("rn") <= n).select(F.col("id").alias("picked"))
    few = queues is not None and n * queues <= MAX_BROADCAST_PICKS
    joined = now_ready.join(F.broadcast(picked) if few else picked, now_ready["id"] == picked["picked"], "left")
    budget = F.col("max_attempts") if max_attempts is None else F.lit(max_attempts)
    out = _set(
        joined, F.col("picked").isNotNull(), status=F.lit(LEASED), receipt=F.concat(F.lit(f"{receipt}-"), F.col("id").cast("string")),
        lease_until=F.lit(now + lease_ms), attempts=F.col("attempts") + 1, max_attempts=budget, updated_at=F.lit(now),
    )
    return out.drop("picked")


def fenced(messages: DataFrame, commands: DataFrame, now: int) -> DataFrame:
    """Messages beside their commands (queue, id, receipt, ...; columns prefixed c_); valid tells whether
    the receipt holds: same queue, leased, same receipt, not expired."""
    c = commands.select(*[F.col(x).alias(f"c_{x}") for x in commands.columns])
    on = (messages["id"] == c["c_id"]) & (messages["queue"] == c["c_queue"])
    live = (F.col("status") == LEASED) & (F.col("receipt") == F.col("c_receipt")) & (F.col("lease_until") > now)
    return messages.join(c, on, "left").withColumn("valid", F.coalesce(live, F.lit(False)))


def _plain(df: DataFrame, messages: DataFrame) -> DataFrame:
    return df.select(*messages.columns)


def ack(messages: DataFrame, commands: DataFrame, now: int) -> DataFrame:
    """commands: queue, id, receipt. Others' leases and stale receipts change nothing."""
    out = _set(fenced(messages, commands, now), F.col("valid"), status=F.lit(ACKED), receipt=_NULL, lease_until=_NULL, updated_at=F.lit(now))
    return _plain(out, messages)


def nack(messages: DataFrame, commands: DataFrame, now: int) -> DataFrame:
    """commands: queue, id, receipt, delay_ms, last_error, reason. Ready after the delay; failed when the
    attempts are used up, the delay being ignored then."""
    used = F.col("attempts") >= F.col("max_attempts")
    out = _set(
        fenced(messages, commands, now), F.col("valid"), status=F.when(used, FAILED).otherwise(READY), available_at=F.when(used, F.lit(now)).otherwise(F.lit(now) + F.col("c_delay_ms")),
        receipt=_NULL, lease_until=_NULL, last_error=F.col("c_last_error"), failure_reason=F.when(used, F.coalesce("c_reason", F.lit("retries_exhausted"))), failure_category=_NULL, updated_at=F.lit(now),
    )
    return _plain(out, messages)


def fail(messages: DataFrame, commands: DataFrame, now: int) -> DataFrame:
    """commands: queue, id, receipt, last_error, reason, category. Failed whatever the budget."""
    out = _set(
        fenced(messages, commands, now), F.col("valid"), status=F.lit(FAILED), receipt=_NULL, lease_until=_NULL,
        last_error=F.col("c_last_error"), failure_reason=F.col("c_reason"), failure_category=F.col("c_category"), updated_at=F.lit(now),
    )
    return _plain(out, messages)


def extend(messages: DataFrame, commands: DataFrame, now: int) -> DataFrame:
    """commands: queue, id, receipt, lease_ms. A live lease lasts from now on."""
    out = _set(fenced(messages, commands, now), F.col("valid"), lease_until=F.lit(now) + F.col("c_lease_ms"), updated_at=F.lit(now))
    return _plain(out, messages)


def retry_failed(messages: DataFrame, now: int, ids: DataFrame) -> DataFrame:
    """Failed messages of ids (queue, id) start again: no attempts, no error; payload and budget stay."""
    c = ids.select(F.col("queue").alias("c_queue"), F.col("id").alias("c_id")).distinct()
    joined = messages.join(c, (messages["id"] == c["c_id"]) & (messages["queue"] == c["c_queue"]), "left")
    hit = F.col("c_id").isNotNull() & (F.col("status") == FAILED)
    out = _set(
        joined, hit, status=F.lit(READY), available_at=F.lit(now), attempts=F.lit(0), receipt=_NULL, lease_until=_NULL,
        last_error=_NULL, failure_reason=_NULL, failure_category=_NULL, updated_at=F.lit(now),
    )
    return _plain(out, messages)


def purgeable(messages: DataFrame, protected: DataFrame, cutoff: int, *, queue: str | None = None, include_failed: bool = False) -> DataFrame:
    """Settled messages last changed before cutoff, but for members of executions (protected: message_id)."""
    states = [ACKED, FAILED] if include_failed else [ACKED]
    old = F.col("status").isin(states) & (F.col("updated_at") < cutoff)
    old = old if queue is None else old & (F.col("queue") == queue)
    return messages.filter(old).join(protected, F.col("id") == F.col("message_id"), "left_anti")


def purge(messages: DataFrame, protected: DataFrame, cutoff: int, *, queue: str | None = None, include_failed: bool = False) -> DataFrame:
    """Without the messages that can be purged."""
    gone = purgeable(messages, protected, cutoff, queue=queue, include_failed=include_failed).select("id")
    return messages.join(gone, "id", "left_anti").select(*messages.columns)


def replay(log: DataFrame, *, lease: int, max_attempts: int) -> DataFrame:
    """The state of each message after an ordered log of commands (message, seq, op, at), folded in one
    aggregate: (message, status, attempts, lease_until). op: get, ack, nack, fail, reclaim. A message's
    whole log meets in one task, as its commands depend on each other; a stream (streaming.machine)
    carries a state on instead."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "op", "at")))
    zero = F.struct(F.lit(READY).alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("long").alias("lease_until"))

    def step(s, c):
        lapsed = (s["status"] == LEASED) & (s["lease_until"] <= c["at"])
        live = (s["status"] == LEASED) & (s["lease_until"] > c["at"])
        over = s["attempts"] >= max_attempts
        after = F.when(lapsed & c["op"].isin("get", "reclaim"), F.when(over, FAILED).otherwise(READY)).otherwise(s["status"])
        taken = (c["op"] == "get") & (after == READY)
        status = (
            F.when(taken, LEASED)
            .when(live & (c["op"] == "ack"), ACKED)
            .when(live & (c["op"] == "nack"), F.when(over, FAILED).otherwise(READY))
            .when(live & (c["op"] == "fail"), FAILED)
            .otherwise(after)
        )
        return F.struct(
            status.cast("int").alias("status"), (s["attempts"] + F.when(taken, 1).otherwise(0)).alias("attempts"),
            F.when(taken, c["at"] + lease).when(status == LEASED, s["lease_until"]).alias("lease_until"),
        )

    folded = log.groupBy("message").agg(F.aggregate(ordered, zero, step).alias("s"))
    return folded.select("message", F.col("s.status").cast("long").alias("status"), F.col("s.attempts").cast("long").alias("attempts"), F.col("s.lease_until").alias("lease_until"))
