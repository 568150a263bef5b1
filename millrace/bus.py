"""An event bus over one store: dispatch, ingestion with checkpoints, handlers and finite executions."""

from __future__ import annotations

import asyncio
import contextlib
import inspect
import json
import secrets
import time
import uuid
from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.identity import identities
from .functions.retry import Reject, Retry, RetryPolicy, error_text
from .operators import aggregates, enqueue, lineage, transitions
from .operators.routing import NAME, Topology
from .queue import Heartbeat, Queue, admit, dumps, fan_out, insert, prepared, wall_clock
from .schema import (
    CheckpointConflict, ExecutionFailed, ExecutionLeaseLost, ExecutionRuntimeMissing, Full, FullImpossible, InvalidEventIdentity, MillraceError, NoSubscribers, SourceChanged,
)
from .store import Change, Store, changed, removed, scratch

REGISTRY: dict[str, type] = {}
LEASE_MS = 60_000


def event(cls=None, *, name: str | None = None, version: int = 1, identity: tuple[str, ...] | None = None):
    """Declare a dataclass as an event type; identity names the fields of its business key."""

    def put(c):
        c = c if is_dataclass(c) else dataclass(c)
        c.event_type = name or c.__name__
        if not NAME.match(c.event_type):
            raise ValueError(f"invalid name: {c.event_type!r}")
        if identity is not None and not set(identity) <= {f.name for f in fields(c)}:
            raise ValueError("identity fields must be fields of the event")
        c.event_schema, c.event_identity = f"{c.event_type}@{version}", identity
        REGISTRY[c.event_type] = c
        return c

    return put if cls is None else put(cls)


@dataclass(frozen=True)
class Meta:
    """Lineage of one event."""

    event_id: str = field(default_factory=lambda: str(uuid.uuid4()))
    correlation_id: str | None = None
    causation_id: str | None = None
    created_at: str = field(default_factory=lambda: datetime.now(UTC).isoformat())


def envelope_of(e, meta: Meta) -> dict:
    return {
        "event_id": meta.event_id, "correlation_id": meta.correlation_id or meta.event_id, "causation_id": meta.causation_id, "event_type": e.event_type,
        "event_schema": e.event_schema, "event_created_at": meta.created_at, "payload": asdict(e),
    }


@dataclass(frozen=True)
class DispatchReceipt:
    inserted_count: int
    deduplicated_count: int
    message_ids: tuple[int, ...]


@dataclass(frozen=True)
class IngestionResult:
    items: int = 0
    dispatched: int = 0
    unrouted: int = 0
    inserted: int = 0
    deduplicated: int = 0
    batches: int = 0
    cursor: str | None = None


@dataclass(frozen=True)
class ExecutionResult:
    execution_id: str
    completed: bool
    total: int
    ready: int
    processing: int
    acknowledged: int
    failed: int
    items_committed: int

    def raise_for_failures(self) -> ExecutionResult:
        if self.failed:
            raise ExecutionFailed(f"{self.failed} of {self.total} deliveries failed")
        return self


@dataclass(frozen=True)
class RuntimeContext:
    """What a context factory may know of one attempt."""

    event_id: str
    attempt: int
    handler_name: str


@dataclass
class _Handler:
    function: object
    retry: RetryPolicy | None
    permanent: tuple
    timeout: float | None = None
    context: object = None

    @property
    def name(self) -> str:
        return getattr(self.function, "__name__", type(self.function).__name__)

    def __call__(self, e, attempt: int, event_id: str = "") -> tuple[bool, object]:
        """(timed out, what the function returns). A context factory is called for each attempt; only a
        coroutine may time out. An error of its own after that, TimeoutError too, is the function's."""
        args = (e,) if self.context is None else (e, self.context(RuntimeContext(event_id, attempt, self.name)))
        out = self.function(*args)
        return asyncio.run(self._awaited(out)) if inspect.isawaitable(out) else (False, out)

    async def _awaited(self, out) -> tuple[bool, object]:
        task = asyncio.ensure_future(out)
        done, _ = await asyncio.wait({task}, timeout=self.timeout)
        if done:
            return False, task.result()
        task.cancel()
        with contextlib.suppress(BaseException):  # what it does while it is cancelled doesn't count
            await task
        return True, None


@dataclass
class SubscriptionConfig:
    """Settings of one subscription in this process; frozen once it is consumed."""

    concurrency: int | None = None
    retry: RetryPolicy | None = None
    frozen: bool = False

    def __setattr__(self, name, value):
        if getattr(self, "frozen", False) and not (name == "frozen" and value):
            raise RuntimeError("a subscription's settings can't change after consumption has started")
        if name == "concurrency" and value is not None and (isinstance(value, bool) or not isinstance(value, int) or value < 1):
            raise ValueError("concurrency must be a positive integer")
        if name == "retry" and value is not None and not isinstance(value, RetryPolicy):
            raise TypeError("retry must be a RetryPolicy")
        super().__setattr__(name, value)


class Subscription:
    """One declared subscription of a bus: its handlers, settings and dead letters."""

    def __init__(self, bus: EventBus, name: str):
        self.bus, self.name = bus, name

    @property
    def config(self) -> SubscriptionConfig:
        return self.bus.configs.setdefault(self.name, SubscriptionConfig())

    def handler(self, pattern, function=None, **options):
        """As EventBus.handler, for this subscription."""
        return self.bus.handler(pattern, function, subscription=self.name, **options)

    @property
    def queue(self) -> Queue:
        return self.bus.queue_of(self.name)

    def stats(self) -> dict[str, int]:
        return self.queue.stats()

    def list_failed(self, limit: int = 100, offset: int = 0) -> list[dict]:
        """Dead letters, each with its event type and payload where the envelope can be read, else why not."""
        out = []
        for row in self.queue.list_failed(limit, offset):
            try:
                body = json.loads(bytes(row["payload"]))
                seen = {"event_type": body["event_type"], "event_id": body["event_id"], "event": body["payload"], "inspection_error": None}
            except (ValueError, KeyError, TypeError) as e:
                seen = {"event_type": None, "event_id": None, "event": None, "inspection_error": error_text(e)}
            out.append(row | seen)
        return out

    def retry_failed(self, message_id: int) -> None:
        self.queue.retry_failed(message_id)


@dataclass
class SourceConfig:
    """How a declared source is ingested; frozen when it first runs."""

    batch_size: int = 1000
    max_pending: int | None = None
    frozen: bool = False

    def __setattr__(self, name, value):
        if getattr(self, "frozen", False) and not (name == "frozen" and value):
            raise RuntimeError("a source's settings can't change after it has run")
        if name in ("batch_size", "max_pending") and value is not None and (isinstance(value, bool) or not isinstance(value, int) or value < 1):
            raise ValueError(f"{name} must be a positive integer")
        super().__setattr__(name, value)


@dataclass(frozen=True)
class SourceDefinition:
    """A source with its transformation, as declared by EventBus.source."""

    bus: EventBus
    source: object
    transform: object
    checkpoint: str | None
    config: SourceConfig

    @property
    def name(self) -> str:
        return getattr(self.transform, "__name__", type(self.transform).__name__)

    def ingest(self) -> IngestionResult:
        self.config.frozen = True
        return self.bus.ingest(self.source, self.transform, batch_size=self.config.batch_size, checkpoint=self.checkpoint, max_pending=self.config.max_pending)

    def execute(self, *, timeout: float | None = None) -> ExecutionResult:
        self.config.frozen = True
        return self.bus.execute(self.source, self.transform, name=self.name, checkpoint=self.checkpoint, batch_size=self.config.batch_size, timeout=timeout)


class _Pull:
    """Items of a source one at a time, and transformations, either of which may be asynchronous. Nothing is
    read ahead of what is asked for."""

    def __init__(self, source):
        self.loop = asyncio.new_event_loop()
        self.items = source.__aiter__() if hasattr(source, "__aiter__") else iter(source)

    def __iter__(self):
        if not hasattr(self.items, "__anext__"):
            yield from self.items
            return
        while True:
            try:
                yield self.loop.run_until_complete(self.items.__anext__())
            except StopAsyncIteration:
                return

    def settled(self, value):
        async def wait():
            return await value

        return self.loop.run_until_complete(wait()) if inspect.isawaitable(value) else value

    def close(self) -> None:
        self.loop.run_until_complete(self.loop.shutdown_asyncgens())
        self.loop.close()


class EventBus:
    def __init__(self, store: Store, name: str = "bus", *, require_subscribers: bool = True, max_retries: int = 3, max_pending: int | None = None, lease_seconds: float = 60, clock=wall_clock):
        if not NAME.match(name):
            raise ValueError(f"invalid name: {name!r}")
        self.store, self.name, self.require, self.clock = store, name, require_subscribers, clock
        self.max_attempts, self.max_pending = max_retries + 1, max_pending
        self.topology, self.handlers, self.frozen, self.lease_seconds = Topology(), {}, False, lease_seconds
        self.configs: dict[str, SubscriptionConfig] = {}
        self.stopped = False

    # --- set-up

    def subscribe(self, subscription: str, *patterns) -> None:
        if self.frozen:
            raise RuntimeError("routes can't change after consumption has started")
        for p in patterns:
            self.topology = self.topology.with_route(subscription, p if isinstance(p, str) else p.event_type)

    def subscription(self, name: str, *, concurrency: int | None = None) -> Subscription:
        """A declared subscription."""
        if name not in self.topology.routes:
            raise ValueError(f"subscription {name!r} isn't declared")
        found = Subscription(self, name)
        if concurrency is not None:
            found.config.concurrency = concurrency
        return found

    def handler(
        self, pattern, function=None, *, subscription: str | None = None, retry: RetryPolicy | None = None, permanent_errors: tuple = (), timeout: float | None = None, context=None, concurrency: int | None = None
    ):
        """Handle a pattern's events of a subscription (by default named like the event type), as a decorator or
        with the function. It may return one event, which is dispatched; with an explicit lineage
        as a pair (event, Meta).

        Functions may be coroutines; only those can have a timeout. context(RuntimeContext) makes a second
        argument. retry and concurrency (tasks that handle a batch) hold for the subscription.
        """
        if self.frozen:
            raise RuntimeError("handlers can't change after consumption has started")
        kind = pattern if isinstance(pattern, str) else pattern.event_type
        name = kind if subscription is None else subscription
        if not NAME.match(name):
            raise ValueError(f"invalid name: {name!r}")
        config = self.configs.setdefault(name, SubscriptionConfig())
        for key, value in (("concurrency", concurrency), ("retry", retry)):
            if value is not None and getattr(config, key) not in (None, value):
                raise ValueError(f"{name} has another {key} already")

        def put(f):
            if timeout is not None and not inspect.iscoroutinefunction(f):
                raise ValueError("only a coroutine can have a timeout")
            if (name, kind) in self.handlers:
                raise ValueError(f"{name} already handles {kind}")
            self.subscribe(name, kind)
            for key, value in (("concurrency", concurrency), ("retry", retry)):
                if value is not None:
                    setattr(config, key, value)
            self.handlers[name, kind] = _Handler(f, retry, tuple(permanent_errors), timeout, context)
            return f

        return put if function is None else put(function)

    on = handler

    def source(self, source, *, checkpoint: str | None = None, batch_size: int = 1000, max_pending: int | None = None):
        """Decorator of a transformation: declares a source, to be ingested or executed later."""
        SourceConfig(batch_size, max_pending)  # wrong values are errors here, not at the first run
        return lambda transform: SourceDefinition(self, source, transform, checkpoint, SourceConfig(batch_size, max_pending))

    def queue_name(self, subscription: str) -> str:
        return f"__bus__:{self.name}:{subscription}"

    def queue_of(self, subscription: str) -> Queue:
        return Queue(self.store, self.queue_name(subscription), lease_seconds=self.lease_seconds, max_retries=self.max_attempts - 1, clock=self.clock)

    # --- dispatch

    def _entries(self, events: list[tuple[object, Meta]]) -> tuple[list[tuple], int]:
        """Rows of a batch in source order, each event's envelope made once; and how many had no subscriber."""
        rows, none = [], 0
        for e, meta in events:
            made = self._prepared(e, meta)
            none += not made
            rows += [(len(rows) + i, *x) for i, x in enumerate(made)]
        return rows, none

    def _prepared(self, e, meta: Meta) -> list[tuple]:
        """An event's rows without their place in the batch: queue, payload and identities."""
        subs = self.topology.subscriptions_for(e.event_type)
        if not subs:
            if self.require:
                raise NoSubscribers(e.event_type)
            return []
        body = dumps(envelope_of(e, meta))
        return [(self.queue_name(s), body, *identities(e.event_schema, asdict(e), e.event_identity, meta.event_id)) for s in subs]

    def _insert(self, base: int, rows: list[tuple], max_pending: int | None = None) -> tuple[dict, dict, DataFrame]:
        store, names = self.store, sorted({r[1] for r in rows})
        stored = store.table("messages", base).filter(F.col("queue").isin(names))
        batch = prepared(store.spark, rows)
        named = admit(batch, stored, {q: max_pending for q in names})
        new, outcomes, last = insert(store, batch, stored, self.clock(), self.max_attempts, named)
        return ({"messages": [Change(new)]} if last else {}), ({"last_id": last} if last else {}), scratch(outcomes, "outcomes")

    def dispatch(self, e, meta: Meta | None = None) -> DispatchReceipt:
        rows, _ = self._entries([(e, meta or Meta())])
        out = fan_out(self.store, rows, self.clock(), self.max_attempts)
        n = sum(inserted for _, inserted in out)
        return DispatchReceipt(n, len(out) - n, tuple(i for i, _ in out))

    async def dispatch_async(self, e, meta: Meta | None = None) -> DispatchReceipt:
        return await _settled(asyncio.to_thread(self.dispatch, e, meta))

    # --- ingestion

    def checkpoint(self, name: str) -> dict | None:
        t = self.store.table("checkpoints").filter((F.col("bus_name") == self.name) & (F.col("checkpoint_name") == name))
        found = t.first()
        return found.asDict() if found else None

    def _checkpoint_scope(self, name: str) -> str:
        return f"checkpoints:{self.name}/{name}"

    def reset_checkpoint(self, name: str) -> None:
        """Messages stay; the next run starts a new generation."""
        mine = (F.col("bus_name") == self.name) & (F.col("checkpoint_name") == name)
        self.store.change(lambda base, s: ({"checkpoints": [removed(s.table("checkpoints", base).filter(mine).select("bus_name", "checkpoint_name"))]}, {}), [self._checkpoint_scope(name)])

    def _advance(self, base: int, name: str, old: dict | None, cursor: str, fingerprint: str | None, items: int) -> tuple[Change, dict]:
        """A checkpoint after a batch, as a change and as a dict; CheckpointConflict unless it is where this run left it."""
        t = self.store.table("checkpoints", base)
        mine = (F.col("bus_name") == self.name) & (F.col("checkpoint_name") == name)
        found = t.filter(mine).first()
        expected = (old["generation"], old["version"]) if old else None
        if (found and (found["generation"], found["version"])) != expected:
            raise CheckpointConflict(name)
        now = self.clock()
        new = {
            "bus_name": self.name, "checkpoint_name": name, "cursor": cursor, "source_fingerprint": fingerprint,
            "generation": old["generation"] if old else secrets.token_hex(16), "version": old["version"] + 1 if old else 1,
            "items_committed": (old["items_committed"] if old else 0) + items, "batches_committed": (old["batches_committed"] if old else 0) + 1,
            "created_at": old["created_at"] if old else now, "updated_at": now,
        }
        row = self.store.spark.createDataFrame([tuple(new[f.name] for f in t.schema)], t.schema)
        return changed(row), new

    def ingest(self, source, transform=None, *, batch_size: int = 1000, checkpoint: str | None = None, max_pending: int | None = None, execution: tuple[str, str] | None = None) -> IngestionResult:
        """Dispatch a source's items in batches, each one commit with its cursor (and memberships).

        source: an iterable (asynchronous too), or a resumable source (fingerprint, open(cursor)) with a
        checkpoint. Each item is transformed and given its ids once, whatever follows. Where
        max_pending (of each subscription; the bus's by default) leaves no room, a batch waits;
        one that can never fit is cut in halves, in order.
        """
        if batch_size < 1:
            raise ValueError("batch_size must be positive")
        limit = self.max_pending if max_pending is None else max_pending
        total = IngestionResult()
        state = self.checkpoint(checkpoint) if checkpoint else None
        if checkpoint:
            if state and state["source_fingerprint"] != source.fingerprint:
                raise SourceChanged(checkpoint)
            pull = _Pull(source.open(state["cursor"] if state else None))
        else:
            pull = _Pull(source)

        def commit(group: list[tuple]) -> None:
            nonlocal total, state
            rows = [x for x, _ in group]
            rows, none = [(i, *x) for i, x in enumerate(x for made in rows for x in made)], sum(not made for made in rows)
            routed, cursor = len(group) - none, group[-1][1]
            if not rows and not checkpoint:
                total = replace(total, items=total.items + len(group), unrouted=total.unrouted + none)
                return
            out: list = []

            def change(base: int, store: Store):
                tables, facts, after = {}, {}, None
                if execution:
                    self._hold(base, *execution)
                if checkpoint:
                    advanced, after = self._advance(base, checkpoint, state, cursor, source.fingerprint, len(group))
                    tables["checkpoints"] = [advanced]
                outcomes = None
                if rows:
                    more, facts, outcomes = self._insert(base, rows, limit)
                    tables |= more
                if execution:
                    tables |= self._join_execution(base, execution[0], outcomes, len(group), routed, none, after)
                out[:] = [after, outcomes]
                return tables, facts

            scope = [f"messages:{q}" for q in sorted({r[1] for r in rows})]
            scope += [self._checkpoint_scope(checkpoint)] if checkpoint else []
            self.store.change(change, [*scope, "executions"] if execution else scope)
            state = out[0] or state
            n = {r["inserted"]: r["n"] for r in out[1].groupBy("inserted").agg(F.count("*").alias("n")).collect()} if out[1] is not None else {}
            total = IngestionResult(total.items + len(group), total.dispatched + routed, total.unrouted + none, total.inserted + n.get(True, 0), total.deduplicated + n.get(False, 0), total.batches + 1, cursor)

        def fit(group: list[tuple]) -> None:
            pause = 0.01
            while True:
                try:
                    return commit(group)
                except FullImpossible:
                    if len(group) == 1:
                        raise
                    half = len(group) // 2
                    fit(group[:half])
                    group, pause = group[half:], 0.01
                except Full:
                    time.sleep(pause)
                    pause = min(pause * 1.5, 0.25)

        held: list[tuple] = []
        try:
            for r in pull:
                value, cursor = (r.value, r.cursor) if checkpoint else (r, None)
                held.append((self._prepared(pull.settled(transform(value)) if transform else value, Meta()), cursor))
                if len(held) == batch_size:
                    fit(held)
                    held = []
            if held:
                fit(held)
        finally:
            pull.close()
        return total

    async def ingest_async(self, source, transform=None, **options) -> IngestionResult:
        """ingest() from a coroutine. If it is cancelled, the commit at hand is settled first."""
        return await _settled(asyncio.to_thread(self.ingest, source, transform, **options))

    # --- consumption

    def run_once(self, subscription: str, *, batch: int = 100, heartbeat_interval: float | None = None) -> int:
        """Claim a batch, handle it on executors, and settle it: one commit with acknowledgements, the
        events that handlers returned, their edges and memberships. Returns how many were claimed.
        A result that can't be dispatched fails its own delivery only."""
        self.frozen = True
        config = self.configs.setdefault(subscription, SubscriptionConfig())
        config.frozen = True
        mine = {k: h for (s, k), h in self.handlers.items() if s == subscription}
        queue = self.queue_of(subscription)
        claimed = queue.claim(batch, max_attempts=config.retry.max_attempts if config.retry else None)
        name, known, registry, topology, require, retry = queue.name, dict(mine), dict(REGISTRY), self.topology, self.require, config.retry

        def run(batches):
            import pandas as pd

            for pdf in batches:
                yield pd.DataFrame([(name, r.id, r.receipt, *_deliver(bytes(r.payload), r.attempts, known, registry, topology, require, retry)) for r in pdf.itertuples(index=False)], columns=_OUTCOME)

        given = claimed.repartition(config.concurrency) if config.concurrency else claimed
        schema = "queue string, id long, receipt string, how string, last_error string, reason string, category string, delay_ms long, child string"
        with Heartbeat(queue, claimed, heartbeat_interval):
            done = scratch(given.mapInPandas(run, schema), "outcomes")
        n = done.count()
        if n:
            scope = [queue.scope, "executions", *(f"messages:{self.queue_name(s)}" for s in self.topology.routes)]
            self.store.change(lambda base, s: self._settle(base, done), scope if done.filter("child is not null").limit(1).count() else [queue.scope])
        return n

    def _children(self, base: int, live: DataFrame) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
        """Of the live outcomes' events: rows as of prepared() with parent, without those of parents that have
        a conflict; all messages of their queues; and the parents (id) whose event conflicts."""
        spark, rows = self.store.spark, []
        for r in live.filter("child is not null").select("id", "child").collect():  # of one claimed batch
            body = json.loads(r["child"])
            e = REGISTRY[body["event_type"]](**body["payload"])
            meta = Meta(body["event_id"], body["correlation_id"], body["causation_id"], body["event_created_at"])
            rows += [(*x, r["id"]) for x in self._prepared(e, meta)]
        if not rows:
            return None, None, None
        stored = self.store.table("messages", base).filter(F.col("queue").isin(sorted({r[0] for r in rows})))
        batch = prepared(spark, [(i, *x[:-1]) for i, x in enumerate(rows)])
        of = spark.createDataFrame([(i, x[-1]) for i, x in enumerate(rows)], "seq long, parent_message_id long")
        bad = scratch(enqueue.conflicting(batch, stored).join(of, "seq").select(F.col("parent_message_id").alias("id")).distinct(), "conflicting")
        batch = batch.join(of, "seq").join(bad.withColumnRenamed("id", "parent_message_id"), "parent_message_id", "left_anti")
        return scratch(batch, "children"), stored, bad

    def _settle(self, base: int, done: DataFrame) -> tuple[dict, dict]:
        store, now = self.store, self.clock()
        m = scratch(enqueue.named(store.table("messages", base), done), "settling")
        live = transitions.fenced(m, done.select("queue", "id", "receipt", "child"), now).filter("valid").select("id", F.col("c_child").alias("child"))
        children, stored, bad = self._children(base, live)
        if bad is not None:
            hit = done.join(bad, "id", "left_semi").withColumns({"how": F.lit("fail"), "last_error": F.lit("the returned event's identity meets another one"), "reason": F.lit("permanent_handler_error"), "category": F.lit("deduplication_conflict")})
            done = scratch(done.join(bad, "id", "left_anti").unionByName(hit), "outcomes")
        kinds, after = {r["how"] for r in done.select("how").distinct().collect()}, None
        for how in sorted(kinds):
            some = done.filter(F.col("how") == how)
            part = transitions.touched(getattr(transitions, how), enqueue.named(m, some), some, now)
            after = part if after is None else after.unionByName(part)
        tables, facts = {"messages": [changed(after, done.first()["queue"])]}, {}
        if children is not None and children.limit(1).count():
            new, outcomes, last = insert(store, children, stored, now, self.max_attempts)
            outcomes, facts = scratch(outcomes, "outcomes"), {"last_id": last} if last else {}
            tables["messages"] += [Change(new)] if last else []
            edges = outcomes.join(children.select("seq", "parent_message_id"), "seq").select("parent_message_id", F.col("id").alias("child_message_id")).distinct()
            known = store.table("edges", base)
            edges = scratch(edges.join(known, ["parent_message_id", "child_message_id"], "left_anti"), "edges")
            held = store.table("deliveries", base)
            roots = held.join(edges, held["message_id"] == edges["parent_message_id"]).select("execution_id", F.col("child_message_id").alias("message_id"))
            tables |= {"edges": [Change(edges)], "deliveries": [Change(lineage.joined(held, known.union(edges), roots))]}
        return tables, facts

    def run(self, *, batch: int = 100) -> int:
        """All subscriptions with handlers, until none claims anything; returns how many were handled."""
        total = 0
        while True:
            n = sum(self.run_once(s, batch=batch) for s in sorted({s for s, _ in self.handlers}))
            total += n
            if not n:
                return total

    def run_subscription(self, subscription: str, *, batch: int = 100, idle_timeout: float | None = None, poll_interval: float = 0.1, heartbeat_interval: float | None = None) -> int:
        """One subscription, until nothing could be claimed for idle_timeout seconds (None: until the bus is
        stopped); returns how many were handled."""
        total, last = 0, time.monotonic()
        self.subscription(subscription)
        while not self.stopped:
            n = self.run_once(subscription, batch=batch, heartbeat_interval=heartbeat_interval)
            total += n
            if n:
                last = time.monotonic()
            elif idle_timeout is not None and time.monotonic() - last >= idle_timeout:
                break
            else:
                time.sleep(poll_interval)
        return total

    def stop(self) -> None:
        """From any thread: consumers return after the batch at hand."""
        self.stopped = True

    # --- finite executions

    def _hold(self, base: int, execution_id: str, receipt: str) -> None:
        r = self.store.table("runtime", base).filter(F.col("execution_id") == execution_id).first()
        if r is None or r["source_receipt"] != receipt or (r["source_lease_until"] or 0) <= self.clock():
            raise ExecutionLeaseLost(execution_id)

    def _join_execution(self, base: int, execution_id: str, outcomes: DataFrame | None, items: int, dispatched: int, none: int, checkpoint: dict | None) -> dict:
        store, own = self.store, F.col("execution_id") == execution_id
        inserted = outcomes.filter("inserted").count() if outcomes is not None else 0
        everything = outcomes.count() if outcomes is not None else 0
        more = {"items_committed": items, "events_dispatched": dispatched, "events_unrouted": none, "deliveries_inserted": inserted, "deliveries_deduplicated": everything - inserted, "batches_committed": 1}
        runtime = store.table("runtime", base).filter(own).withColumns({k: F.col(k) + v for k, v in more.items()}).withColumn("source_lease_until", F.lit(self.clock() + LEASE_MS))
        if checkpoint:  # from its first batch on, an execution belongs to that generation of its checkpoint
            runtime = runtime.withColumn("checkpoint_generation", F.coalesce("checkpoint_generation", F.lit(checkpoint["generation"])))
        tables = {"runtime": [changed(runtime)]}
        if outcomes is not None:
            roots = outcomes.select(F.lit(execution_id).alias("execution_id"), F.col("id").alias("message_id"))
            tables["deliveries"] = [Change(lineage.joined(store.table("deliveries", base), store.table("edges", base), roots))]
        return tables

    def _runtime(self, base: int, execution_id: str) -> DataFrame:
        found = self.store.table("runtime", base).filter(F.col("execution_id") == execution_id)
        if not found.limit(1).count():
            raise ExecutionRuntimeMissing(execution_id)
        return found

    def extend_source_lease(self, execution_id: str, receipt: str, seconds: float = LEASE_MS / 1000) -> None:
        """The holder of a source lease keeps it for some time from now on."""

        def change(base: int, store: Store):
            self._hold(base, execution_id, receipt)
            return {"runtime": [changed(self._runtime(base, execution_id).withColumn("source_lease_until", F.lit(self.clock() + int(seconds * 1000))))]}, {}

        self.store.change(change, ["executions"])

    def release_source_lease(self, execution_id: str, receipt: str) -> None:
        """The holder gives it back; another run may go on at once."""

        def change(base: int, store: Store):
            self._hold(base, execution_id, receipt)
            return {"runtime": [changed(self._runtime(base, execution_id).withColumns({"source_receipt": F.lit(None), "source_lease_until": F.lit(None)}))]}, {}

        self.store.change(change, ["executions"])

    def _open(self, name: str, checkpoint: str, fingerprint: str, receipt: str) -> tuple[str, bool]:
        """The execution to run, with its source lease, and whether its source still has to be read: that of
        the checkpoint's generation, else one that has committed nothing yet, else a new one."""
        held: list = []

        def claim(base: int, store: Store):
            now, runtime, state = self.clock(), store.table("runtime", base), self.checkpoint(checkpoint)
            mine = (F.col("bus_name") == self.name) & (F.col("checkpoint_name") == checkpoint)
            bound = runtime.filter(mine & (F.col("checkpoint_generation") == state["generation"])).first() if state else None
            old = bound or runtime.filter(mine & F.col("checkpoint_generation").isNull() & (F.col("source_fingerprint") == fingerprint) & F.col("source_completed_at").isNull()).first()
            if old and old["source_completed_at"] is not None:
                held[:] = [old["execution_id"], False]
                return {}, {}
            if old and (old["source_lease_until"] or 0) > now and old["source_receipt"] != receipt:
                raise ExecutionLeaseLost(old["execution_id"])
            held[:] = [old["execution_id"] if old else str(uuid.uuid4()), True]
            if old:
                own = runtime.filter(F.col("execution_id") == held[0])
                return {"runtime": [changed(own.withColumns({"source_receipt": F.lit(receipt), "source_lease_until": F.lit(now + LEASE_MS)}))]}, {}
            row = {"execution_id": held[0], "bus_name": self.name, "checkpoint_name": checkpoint, "source_fingerprint": fingerprint, "source_receipt": receipt, "source_lease_until": now + LEASE_MS}
            row |= dict.fromkeys(("items_committed", "events_dispatched", "events_unrouted", "deliveries_inserted", "deliveries_deduplicated", "batches_committed"), 0)
            new = store.spark.createDataFrame([tuple(row.get(f.name) for f in runtime.schema)], runtime.schema)
            executions = store.table("executions", base)
            e = store.spark.createDataFrame([(held[0], self.name, name, checkpoint, False, now, now)], executions.schema)
            return {"runtime": [Change(new)], "executions": [Change(e)]}, {}

        self.store.change(claim, ["executions", self._checkpoint_scope(checkpoint)])
        return held[0], held[1]

    def execute(self, source, transform=None, *, name: str | None = None, checkpoint: str | None = None, batch_size: int = 1000, timeout: float | None = None) -> ExecutionResult:
        """Ingest a resumable source to its end, handle all that follows from it, delayed retries too, and report.

        A run that stopped is resumed while its checkpoint's generation is the same. With a timeout
        (seconds, from when the execution is open) TimeoutError is raised between two steps; what is
        committed stays, and the source lease is given back. A SourceDefinition may be given alone.
        """
        if isinstance(source, SourceDefinition):
            return source.execute(timeout=timeout)
        if timeout is not None and (isinstance(timeout, bool) or not 0 < timeout < float("inf")):
            raise ValueError("timeout must be a positive finite number")
        if not getattr(source, "fingerprint", None) or not checkpoint or not name:
            raise ValueError("an execution needs a name, a checkpoint and a source with a fingerprint")
        receipt = secrets.token_urlsafe(24)
        state = self.checkpoint(checkpoint)
        if state and state["source_fingerprint"] != source.fingerprint:
            raise SourceChanged(checkpoint)
        execution_id, unread = self._open(name, checkpoint, source.fingerprint, receipt)
        until = None if timeout is None else time.monotonic() + timeout

        def in_time() -> None:
            if until is not None and time.monotonic() > until:
                raise TimeoutError(f"execution {execution_id} isn't finished after {timeout} seconds")

        if unread:
            try:
                self.ingest(_Bounded(source, in_time), transform, batch_size=batch_size, checkpoint=checkpoint, execution=(execution_id, receipt))
            except BaseException:
                with contextlib.suppress(MillraceError):
                    self.release_source_lease(execution_id, receipt)
                raise
            self._complete(execution_id, receipt)
        while True:
            in_time()
            n = self.run()
            out = self.finalize(execution_id)
            if out.completed:
                return out
            if not n:  # delayed retries, leases of others, subscriptions without handlers
                if not any(s in {h for h, _ in self.handlers} for s in self.topology.routes) or self.stopped:
                    return out
                if timeout is None and not self._waits(execution_id):
                    return out
                time.sleep(0.05)

    def _waits(self, execution_id: str) -> bool:
        """Whether a member can still be handled by this bus: ready later or leased, and with a handler."""
        t, names = self.store.table, [self.queue_name(s) for s, _ in self.handlers]
        open_ = t("messages").filter(F.col("status").isin(0, 1) & F.col("queue").isin(names)).select(F.col("id").alias("message_id"))
        return bool(t("deliveries").filter(F.col("execution_id") == execution_id).join(open_, "message_id", "left_semi").limit(1).count())

    def _complete(self, execution_id: str, receipt: str) -> None:
        def change(base: int, store: Store):
            self._hold(base, execution_id, receipt)
            runtime = self._runtime(base, execution_id).withColumns({"source_completed_at": F.coalesce("source_completed_at", F.lit(self.clock())), "source_receipt": F.lit(None), "source_lease_until": F.lit(None)})
            own = store.table("executions", base).filter(F.col("execution_id") == execution_id)
            return {"runtime": [changed(runtime)], "executions": [changed(own.withColumn("source_completed", F.lit(True)))]}, {}

        self.store.change(change, ["executions"])

    def finalize(self, execution_id: str) -> ExecutionResult:
        """Mark an execution completed if it is, once; and its figures, derived by a join."""
        own = F.col("execution_id") == execution_id

        def change(base: int, store: Store):
            done = aggregates.finished(store.table("executions", base).filter(own), store.table("deliveries", base), store.table("messages", base))
            runtime = store.table("runtime", base).filter(own & F.col("completed_at").isNull())
            if not done.count() or not runtime.count():
                return {}, {}
            return {"runtime": [changed(runtime.withColumn("completed_at", F.lit(self.clock())))]}, {}

        self.store.change(change, ["executions"])
        t = self.store.table
        r = aggregates.execution_snapshot(t("executions").filter(own), t("runtime"), t("deliveries"), t("messages")).first()
        return ExecutionResult(execution_id, r["completed_at"] is not None, r["total"], r["ready"], r["processing"], r["acked"], r["failed"], r["items_committed"])


async def _settled(work) -> object:
    """What runs in a thread can't be stopped: a cancelled caller waits until it is settled, and is cancelled then."""
    task = asyncio.ensure_future(work)
    try:
        return await asyncio.shield(task)
    except asyncio.CancelledError:
        with contextlib.suppress(Exception):
            await task
        raise


class _Bounded:
    """A resumable source that asks before each record whether there is time left."""

    def __init__(self, source, in_time):
        self.source, self.in_time, self.fingerprint = source, in_time, source.fingerprint

    def open(self, cursor):
        for r in self.source.open(cursor):
            self.in_time()
            yield r


_OUTCOME = ["queue", "id", "receipt", "how", "last_error", "reason", "category", "delay_ms", "child"]


def _deliver(payload: bytes, attempts: int, handlers: dict[str, _Handler], registry: dict[str, type], topology: Topology | None = None, require: bool = True, retry: RetryPolicy | None = None) -> tuple:
    """(how, last_error, reason, category, delay_ms, child) of one delivery."""

    def failed(reason: str, error: str, category: str | None = None) -> tuple:
        return "fail", error, reason, category, 0, None

    try:
        body = json.loads(payload)
    except ValueError as e:
        return failed("invalid_envelope", error_text(e))
    if not isinstance(body, dict) or not isinstance(body.get("event_type"), str) or not isinstance(body.get("payload"), dict):
        return failed("invalid_envelope", "malformed envelope")
    kind = body["event_type"]
    if kind not in registry:
        return failed("unknown_event_type", f"unknown event: {kind!r}")
    try:
        e = registry[kind](**body["payload"])
    except (TypeError, ValueError) as error:
        return failed("invalid_payload", error_text(error))
    h = handlers.get(kind) or handlers.get("*")
    if h is None:
        return failed("no_handler", f"no handler for {kind!r}")
    policy = retry or h.retry

    def again(error: str, reason: str | None = None, after: float | None = None) -> tuple:
        seconds = after if after is not None else policy.seconds(attempts) if policy else 0.0
        return "nack", error, reason, None, int(seconds * 1000), None

    try:
        timed_out, out = h(e, attempts, str(body.get("event_id")))
    except Retry as error:
        return again(error_text(error), after=error.after)
    except Reject as error:
        return failed("rejected", error_text(error), error.category)
    except h.permanent as error:
        return failed("permanent_handler_error", f"permanent failure: {error_text(error)}")
    except Exception as error:  # noqa: BLE001  any other error of the handler means another attempt
        return again(error_text(error))
    if timed_out:  # under a policy, exhaustion reads as such; else as a timeout
        return again(f"handler timeout after {h.timeout} seconds", None if policy else "handler_timeout")
    if out is None:
        return "ack", None, None, None, 0, None
    return _emitted(out, body, h, registry, topology, require) or failed("permanent_handler_error", f"handler {h.name} returned {type(out).__name__}, not an event")


def _emitted(out, body: dict, h: _Handler, registry: dict[str, type], topology: Topology | None, require: bool) -> tuple | None:
    """The outcome of a delivery whose handler returned something; None if that is no event."""
    parent = Meta(correlation_id=body.get("correlation_id") or body.get("event_id"), causation_id=body.get("event_id"))
    if isinstance(out, tuple) and len(out) == 2 and isinstance(out[1], Meta):  # what its Meta leaves out comes from the parent
        given = out[1]
        out, parent = out[0], replace(given, correlation_id=given.correlation_id or parent.correlation_id, causation_id=given.causation_id or parent.causation_id)
    if getattr(type(out), "event_type", None) not in registry:
        return None
    if topology is not None and not topology.subscriptions_for(out.event_type):
        if require:
            return "fail", f"no subscription takes {out.event_type}", "permanent_handler_error", "no_subscribers", 0, None
        return "ack", None, None, None, 0, None
    try:
        identities(out.event_schema, asdict(out), out.event_identity, parent.event_id)
    except (InvalidEventIdentity, ValueError, TypeError) as error:
        return "fail", error_text(error), "permanent_handler_error", "invalid_event_identity", 0, None
    return "ack", None, None, None, 0, json.dumps(envelope_of(out, parent))
