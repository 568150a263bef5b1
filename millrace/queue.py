"""A durable queue over a store of versioned tables: the batch API, with single-message forms."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.retry import Reject, Retry, RetryPolicy, error_text, milliseconds
from .operators import aggregates, enqueue, transitions
from .schema import FAILED, LEASED, MESSAGES, READY, ConflictingCapacityPolicies, DeduplicationConflict, Empty, Full, FullImpossible, LeaseExpired, MillraceError
from .store import Store, Change, changed, removed, scratch


@dataclass(frozen=True)
class EnqueueItem:
    data: object
    job_id: str | None = None


@dataclass(frozen=True)
class Job:
    id: int
    data: object
    attempts: int
    receipt: str
    lease_until: int


def wall_clock() -> int:
    return int(time.time() * 1000)


def dumps(value: object) -> bytes:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False).encode()


class JsonSerializer:
    """Payloads as JSON. Any object with these two methods may take its place; tasks use it too."""

    def dumps(self, value: object) -> bytes:
        return dumps(value)

    def loads(self, data: bytes) -> object:
        return json.loads(data)


def prepared(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    """Rows (seq, queue, payload, job_id, dedup_key, dedup_fingerprint) as a batch."""
    return spark.createDataFrame(list(rows), "seq long, queue string, payload binary, job_id string, dedup_key string, dedup_fingerprint string")


def admit(batch: DataFrame, stored: DataFrame, limits: dict[str, int | None] | list[tuple[str, int | None]]) -> bool:
    """Raise unless the batch has whole identities, no conflicts, and room. A queue has one limit. Returns
    whether any row has an identity; else there is nothing to compare with what is stored."""
    pairs = list(limits.items() if isinstance(limits, dict) else limits)
    limits = dict(pairs)
    if any(limits[q] != n for q, n in pairs):
        raise ConflictingCapacityPolicies(", ".join(sorted({q for q, n in pairs if limits[q] != n})))
    half = F.col("dedup_key").isNull() != F.col("dedup_fingerprint").isNull()
    facts = batch.agg(F.count_if(half).alias("half"), (F.count("job_id") + F.count("dedup_key")).alias("named")).first()
    if facts["half"]:
        raise ValueError("a dedup_key and its fingerprint must be given together")
    found = enqueue.conflicting(batch, stored).limit(1).collect() if facts["named"] else None
    if found:
        raise DeduplicationConflict(f"{found[0]['kind']} {found[0]['value']!r} in queue {found[0]['queue']!r}")
    bounded = [(q, n) for q, n in limits.items() if n is not None]
    if bounded:
        frame = batch.sparkSession.createDataFrame(bounded, "queue string, limit long")
        verdicts = {r["verdict"]: r["queue"] for r in enqueue.capacity(batch, stored, frame).filter("verdict <> 'ok'").collect()}
        if "impossible" in verdicts:
            raise FullImpossible(verdicts["impossible"])
        if "full" in verdicts:
            raise Full(verdicts["full"])
    return bool(facts["named"])


def insert(store: Store, batch: DataFrame, stored: DataFrame, now: int, max_attempts: int, named: bool = True) -> tuple[DataFrame, DataFrame, int]:
    """The new messages, an outcome (seq, queue, id, inserted) for every row of the batch, and the last id.
    named: whether any row has an identity."""
    parts = enqueue.ranged(enqueue.new_rows(batch, stored) if named else batch, ["seq"])
    n = parts.count()
    after = store.reserve(n) if n else 0
    fresh = scratch(enqueue.numbered(parts, after, ["seq"]), "fresh")
    new = fresh.select(
        "id", "queue", "payload", F.lit(READY).alias("status"), F.lit(0).alias("attempts"), F.lit(max_attempts).alias("max_attempts"), F.lit(now).alias("available_at"),
        "job_id", "dedup_key", "dedup_fingerprint", F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"),
    )
    if not named:
        return new, fresh.select("seq", "queue", "id", F.lit(True).alias("inserted")), after + n
    out = batch.select("seq", "queue", "job_id", "dedup_key").join(fresh.select("seq", F.col("id").alias("own")), "seq", "left")
    for key in ("dedup_key", "job_id"):  # only keys of the batch are looked up
        known = enqueue.meeting(stored, batch, key).select("queue", key, "id").union(fresh.select("queue", key, "id"))
        by = known.filter(F.col(key).isNotNull()).groupBy("queue", key).agg(F.min("id").alias(f"by_{key}"))
        out = out.join(by, ["queue", key], "left")
    return new, out.select("seq", "queue", F.coalesce("own", "by_dedup_key", "by_job_id").alias("id"), F.col("own").isNotNull().alias("inserted")), after + n


def fan_out(store: Store, rows: list[tuple], now: int, max_attempts: int) -> list[tuple[int, bool]]:
    """Rows as of prepared(), for any queues: (id, inserted) of each, in one commit."""
    if not rows:
        return []
    batch, names, held = prepared(store.spark, rows), sorted({r[1] for r in rows}), []

    def change(base: int, store: Store):
        stored = store.table("messages", base).filter(F.col("queue").isin(names))
        new, outcomes, last = insert(store, batch, stored, now, max_attempts, admit(batch, stored, {}))
        held[:] = outcomes.orderBy("seq").collect()
        return ({"messages": [Change(new)]}, {"last_id": last}) if last else ({}, {})

    store.change(change, [f"messages:{q}" for q in names])
    return [(r["id"], r["inserted"]) for r in held]


class Queue:
    """One logical queue of a store. Every change is one commit, retried while others commit first.

    lease_seconds, max_retries and max_pending hold for the queue; max_attempts is max_retries + 1.
    clock gives epoch milliseconds.
    """

    def __init__(self, store: Store, name: str = "default", *, lease_seconds: float = 60, max_retries: int = 3, max_pending: int | None = None, serializer=None, clock=wall_clock):
        if lease_seconds <= 0 or max_retries < 0 or (max_pending is not None and max_pending < 1):
            raise ValueError("lease_seconds and max_pending must be positive, max_retries not negative")
        self.store, self.name, self.clock, self.serializer = store, name, clock, serializer or JsonSerializer()
        self.lease_ms, self.max_attempts, self.max_pending, self.closed = milliseconds(lease_seconds), max_retries + 1, max_pending, False

    def _messages(self, version: int | None = None) -> DataFrame:
        """This queue's messages."""
        if self.closed:
            raise MillraceError("the queue is closed")
        return self.store.table("messages", version, self.name)

    @property
    def scope(self) -> str:
        return f"messages:{self.name}"

    # --- writing

    def put(self, data: object, job_id: str | None = None, *, block: bool = True, timeout: float | None = None) -> int:
        return self.put_many([EnqueueItem(data, job_id)], block=block, timeout=timeout)[0]

    def put_many(self, items: Iterable[object], *, block: bool = True, timeout: float | None = None) -> list[int]:
        """All or nothing; ids in the order of the items."""
        rows = [x if isinstance(x, EnqueueItem) else EnqueueItem(x) for x in items]
        if not rows:
            return []
        batch = prepared(self.store.spark, [(i, self.name, self.serializer.dumps(x.data), x.job_id, None, None) for i, x in enumerate(rows)])
        until, pause = time.monotonic() + (timeout if timeout is not None else 1e9), 0.01
        while True:
            try:
                return [r["id"] for r in self.put_frame(batch).orderBy("seq").collect()]
            except FullImpossible:
                raise
            except Full:
                if not block or time.monotonic() + pause > until:
                    raise
                time.sleep(pause)
                pause = min(pause * 1.5, 0.25)

    def put_frame(self, batch: DataFrame) -> DataFrame:
        """A batch of any size (seq, queue, payload, job_id, dedup_key, dedup_fingerprint); outcomes (seq, queue, id, inserted)."""
        held: list[DataFrame] = []

        def change(base: int, store: Store):
            stored = self._messages(base)
            named = admit(batch, stored, {self.name: self.max_pending})
            new, outcomes, last = insert(store, batch, stored, self.clock(), self.max_attempts, named)
            held[:] = [scratch(outcomes, "outcomes") if named else outcomes]
            return ({"messages": [Change(new, queue=self.name)]}, {"last_id": last}) if last else ({}, {})

        self.store.change(change, [self.scope])
        return held[0]

    def fanout(self, payload: object, targets: Iterable[tuple[str, str | None]]) -> list[int]:
        """One payload to many queues (name, job_id), in one commit and without limits; ids in the order of targets."""
        rows = [(i, name, self.serializer.dumps(payload), job_id, None, None) for i, (name, job_id) in enumerate(targets)]
        return [i for i, _ in fan_out(self.store, rows, self.clock(), self.max_attempts)]

    # --- delivery

    def claim(self, n: int = 1, *, max_attempts: int | None = None) -> DataFrame:
        """Lease the n oldest: (id, payload, attempts, receipt, lease_until). Nothing is committed where nothing can be claimed."""
        token = uuid.uuid4().hex

        def change(base: int, store: Store):
            now, m = self.clock(), self._messages(base)
            if not m.filter(transitions.can_start(now) | transitions.is_expired(now)).limit(1).count():
                held[:] = [m.limit(0)]
                return {}, {}
            after = scratch(transitions.touched(transitions.claim, m, now, lease_ms=self.lease_ms, n=n, receipt=token, max_attempts=max_attempts, queues=1), "claimed")
            held[:] = [after]
            return {"messages": [changed(after, self.name)]}, {}

        held: list[DataFrame] = []
        self.store.change(change, [self.scope])
        return held[0].filter((F.col("status") == LEASED) & F.col("receipt").startswith(token)).select("id", "payload", "attempts", "receipt", "lease_until")

    def get(self, block: bool = True, timeout: float | None = None) -> Job:
        until, pause = time.monotonic() + (timeout if timeout is not None else 1e9), 0.01
        while True:
            found = self.claim().collect()
            if found:
                r = found[0]
                return Job(r["id"], self.serializer.loads(bytes(r["payload"])), max(r["attempts"] - 1, 0), r["receipt"], r["lease_until"])
            if not block or time.monotonic() + pause > until:
                raise Empty(self.name)
            time.sleep(pause)
            pause = min(pause * 1.5, 0.25)

    def get_nowait(self) -> Job:
        return self.get(block=False)

    def apply(self, commands: DataFrame, how: str) -> int:
        """Apply ack, nack, fail or extend to many receipts in one commit; returns how many still held."""
        f = getattr(transitions, how)
        held = [0]

        def change(base: int, store: Store):
            now, m = self.clock(), enqueue.named(self._messages(base), commands)
            after = scratch(transitions.touched(f, m, commands, now), "settled")
            held[0] = after.count()
            return ({"messages": [changed(after, self.name)]}, {}) if held[0] else ({}, {})

        self.store.change(change, [self.scope])
        return held[0]

    def _one(self, job: Job, how: str, **more) -> None:
        row = {"queue": self.name, "id": job.id, "receipt": job.receipt, **more}
        kinds = {"id": "long", "delay_ms": "long", "lease_ms": "long"}
        schema = ", ".join(f"{k} {kinds.get(k, 'string')}" for k in row)
        if not self.apply(self.store.spark.createDataFrame([tuple(row.values())], schema), how):
            raise LeaseExpired(f"message {job.id}")

    def ack(self, job: Job) -> None:
        self._one(job, "ack")

    def nack(self, job: Job, *, delay: float = 0, last_error: str | None = None, reason: str | None = None) -> None:
        self._one(job, "nack", delay_ms=milliseconds(delay), last_error=last_error, reason=reason)

    def fail(self, job: Job, last_error: str | None = None, *, reason: str = "explicit_permanent_failure", category: str | None = None) -> None:
        self._one(job, "fail", last_error=last_error, reason=reason, category=category)

    def extend_lease(self, job: Job, seconds: float) -> None:
        self._one(job, "extend", lease_ms=milliseconds(seconds))

    def reclaim_expired_leases(self) -> int:
        held = [0]

        def change(base: int, store: Store):
            now = self.clock()
            after = scratch(transitions.touched(transitions.reclaim, self._messages(base).filter(transitions.is_expired(now)), now), "reclaimed")
            held[0] = after.count()
            return ({"messages": [changed(after, self.name)]}, {}) if held[0] else ({}, {})

        self.store.change(change, [self.scope])
        return held[0]

    def retry_failed(self, message_id: int) -> None:
        """Existence is checked before room; executions that hold the message open again."""

        def change(base: int, store: Store):
            m = self._messages(base)
            one = m.filter(F.col("id") == message_id)
            if not one.filter(F.col("status") == FAILED).count():
                raise MillraceError(f"no failed message {message_id}")
            if self.max_pending is not None and m.filter(F.col("status").isin(READY, LEASED)).count() + 1 > self.max_pending:
                raise Full(self.name)
            ids = store.spark.createDataFrame([(self.name, message_id)], "queue string, id long")
            of = store.table("deliveries", base).filter(F.col("message_id") == message_id).select("execution_id").distinct()
            again = store.table("runtime", base).filter("completed_at is not null").join(of, "execution_id", "left_semi").withColumn("completed_at", F.lit(None))
            return {"messages": [changed(transitions.touched(transitions.retry_failed, one, self.clock(), ids), self.name)], "runtime": [changed(again)]}, {}

        self.store.change(change, [self.scope, "executions"])

    # --- looking and keeping

    def stats(self) -> dict[str, int]:
        found = aggregates.stats(self._messages()).drop("queue").first()
        return found.asDict() if found else dict.fromkeys(("ready", "processing", "acked", "failed"), 0)

    def diagnostics(self) -> dict:
        found = aggregates.diagnostics(self._messages(), self.clock(), self.max_pending).first()
        return (found.asDict() if found else {"queue": self.name, **self.stats(), "pending": 0}) | self.store.metrics()

    def list_failed(self, limit: int = 100, offset: int = 0) -> list[dict]:
        page = aggregates.failed_page(self._messages(), limit=limit, offset=offset)
        return [r.asDict() for r in page.orderBy("id").collect()]

    def purge(self, older_than: float, *, include_failed: bool = False) -> int:
        held, cutoff = [0], self.clock() - milliseconds(older_than)

        def change(base: int, store: Store):
            gone = transitions.purgeable(self._messages(base), store.table("deliveries", base).select("message_id"), cutoff, include_failed=include_failed)
            gone = scratch(gone.select("id", "queue"), "gone")
            held[0] = gone.count()
            return ({"messages": [removed(gone, self.name)]}, {}) if held[0] else ({}, {})

        self.store.change(change, [self.scope, "executions"])
        return held[0]

    def check_integrity(self) -> dict[str, int]:
        """Broken rules and how many rows break each; empty when all hold."""
        found = aggregates.violations(self.store.table("messages"), self.store.table("deliveries"), self.store.table("edges"))
        return {r["rule"]: r["n"] for r in found.filter("n > 0").collect()}

    def vacuum(self) -> int:
        return self.store.vacuum()

    def backup(self, target: str) -> dict:
        return self.store.backup(target)

    def close(self) -> None:
        self.closed = True


class Heartbeat:
    """While it is entered, a thread of the driver extends the leases of a claimed batch (id, receipt) every
    interval seconds. Leases that are lost meanwhile stay lost."""

    def __init__(self, queue: Queue, claimed: DataFrame, interval: float | None):
        self.queue, self.interval, self.ended = queue, interval, threading.Event()
        if interval is not None and not 0 < interval * 1000 < queue.lease_ms:
            raise ValueError("a heartbeat must be shorter than the lease")
        self.commands = claimed.select(F.lit(queue.name).alias("queue"), "id", "receipt", F.lit(queue.lease_ms).cast("long").alias("lease_ms"))

    def _beat(self) -> None:
        while not self.ended.wait(self.interval):
            self.queue.apply(self.commands, "extend")

    def __enter__(self):
        if self.interval is not None:
            self.thread = threading.Thread(target=self._beat, daemon=True)
            self.thread.start()
        return self

    def __exit__(self, *_):
        self.ended.set()
        if self.interval is not None:
            self.thread.join()


class Worker:
    """Claims batches, runs a handler on executors, and settles the outcomes in one commit of each kind.

    handler(data) runs in Python tasks; what it raises decides: Retry, Reject, permanent_errors,
    or anything else (another attempt). A lost lease beats the handler's result. stop() ends
    run() after the batch at hand; poll_interval is the time between looks at an empty queue;
    with a heartbeat_interval leases are extended while a batch runs.
    """

    def __init__(self, queue: Queue, handler, *, permanent_errors: tuple = (), retry: RetryPolicy | None = None, batch: int = 100, poll_interval: float = 1.0, heartbeat_interval: float | None = None):
        if not poll_interval > 0:
            raise ValueError("poll_interval must be positive")
        if heartbeat_interval is not None and not 0 < heartbeat_interval * 1000 < queue.lease_ms:
            raise ValueError("heartbeat_interval must be positive and shorter than the lease")
        self.queue, self.handler, self.permanent, self.retry, self.batch = queue, handler, tuple(permanent_errors), retry, batch
        self.poll_interval, self.heartbeat_interval, self.stopped = poll_interval, heartbeat_interval, threading.Event()

    def run_once(self) -> int:
        """One batch; returns how many messages it claimed."""
        claimed = self.queue.claim(self.batch, max_attempts=self.retry.max_attempts if self.retry else None)
        handler, permanent, name, retry, loads = self.handler, self.permanent, self.queue.name, self.retry, self.queue.serializer.loads

        def run(batches):
            import pandas as pd

            for pdf in batches:
                rows = []
                for r in pdf.itertuples(index=False):
                    how, error, reason, category, after = "ack", None, None, None, None
                    try:
                        handler(loads(bytes(r.payload)))
                    except Retry as e:
                        how, error, after = "nack", error_text(e), e.after
                    except Reject as e:
                        how, error, reason, category = "fail", error_text(e), "rejected", e.category
                    except permanent as e:
                        how, error, reason = "fail", error_text(e), "permanent_handler_error"
                    except Exception as e:  # noqa: BLE001  any other error of the handler means another attempt
                        how, error = "nack", error_text(e)
                    if after is None:
                        after = retry.seconds(r.attempts) if retry else 0.0
                    rows.append((name, r.id, r.receipt, how, error, reason, category, int(after * 1000)))
                yield pd.DataFrame(rows, columns=["queue", "id", "receipt", "how", "last_error", "reason", "category", "delay_ms"])

        schema = "queue string, id long, receipt string, how string, last_error string, reason string, category string, delay_ms long"
        with Heartbeat(self.queue, claimed, self.heartbeat_interval):
            done = scratch(claimed.mapInPandas(run, schema), "outcomes")  # a handler runs once for each claim, whatever reads this
        kinds = {r["how"]: r["n"] for r in done.groupBy("how").agg(F.count("*").alias("n")).collect()}
        for how in ("ack", "nack", "fail"):
            if how in kinds:
                self.queue.apply(done.filter(F.col("how") == how), how)
        return sum(kinds.values())

    def stop(self) -> None:
        """From any thread: run() returns after its batch."""
        self.stopped.set()

    def run(self, *, idle_rounds: int | None = 1) -> int:
        """Batches until none is claimed for some rounds, or (None) until stop(); returns how many messages were handled."""
        total, idle = 0, 0
        while not self.stopped.is_set() and (idle_rounds is None or idle < idle_rounds):
            n = self.run_once()
            total, idle = total + n, 0 if n else idle + 1
            if not n and (idle_rounds is None or idle < idle_rounds):
                self.stopped.wait(self.poll_interval)
        return total


def empty_messages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], MESSAGES)
