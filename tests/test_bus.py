import asyncio
import time
from concurrent.futures import ThreadPoolExecutor

import pytest

from millrace.bus import EventBus, Meta, event
from millrace.functions.retry import Reject, RetryPolicy
from millrace.schema import ExecutionFailed, InvalidEventIdentity, NoSubscribers, SourceChanged
from millrace.sources.resumable import SequenceSource
from millrace.store import Store


@event(identity=("key",))
class CustomerWanted:
    key: str
    name: str


@event
class CustomerMade:
    key: str


@event
class Unheard:
    n: int


class Clock:
    now = 1_000_000

    def __call__(self):
        return self.now


@pytest.fixture
def bus(spark, tmp_path):
    b = EventBus(Store(spark, f"file://{tmp_path}/bus"), "shop", clock=Clock())

    @b.handler(CustomerWanted, subscription="create", retry=RetryPolicy.fixed(2, 0))
    def create(e):
        if e.name == "bad":
            raise Reject("bad name", category="validation")
        return CustomerMade(e.key)

    @b.handler(CustomerMade, subscription="audit")
    def audit(e):
        return None

    return b


def test_dispatch_and_identity(bus):
    r = bus.dispatch(CustomerWanted("a", "x"))
    assert (r.inserted_count, r.deduplicated_count, r.message_ids) == (1, 0, (1,))
    assert bus.dispatch(CustomerWanted("a", "x")).deduplicated_count == 1
    with pytest.raises(NoSubscribers):
        bus.dispatch(Unheard(1))
    with pytest.raises(InvalidEventIdentity):
        bus.dispatch(CustomerWanted(" ", "x"))


def test_execution(bus):
    rows = [CustomerWanted("a", "x"), CustomerWanted("b", "y"), CustomerWanted("c", "bad"), CustomerWanted("a", "x")]
    source = SequenceSource(rows, fingerprint="v1")
    out = bus.execute(source, name="import", checkpoint="c", batch_size=3)
    # a, b and c were wanted; a and b were made and audited
    assert (out.completed, out.total, out.acknowledged, out.failed, out.items_committed) == (True, 5, 4, 1, 4)
    with pytest.raises(ExecutionFailed):
        out.raise_for_failures()
    assert bus.store.table("edges").count() == 2
    with pytest.raises(SourceChanged):
        bus.execute(SequenceSource(rows, fingerprint="v2"), name="import", checkpoint="c")


def test_resume_and_reset(bus):
    rows = [CustomerWanted(str(i), "n") for i in range(5)]
    first = bus.ingest(SequenceSource(rows[:3], "f"), checkpoint="p", batch_size=2)
    assert (first.items, first.inserted, first.batches, first.cursor) == (3, 3, 2, "3")
    more = bus.ingest(SequenceSource(rows, "f"), checkpoint="p", batch_size=2)
    assert (more.items, more.inserted, more.cursor) == (2, 2, "5")
    old = bus.checkpoint("p")
    bus.reset_checkpoint("p")
    again = bus.ingest(SequenceSource(rows, "f"), checkpoint="p")
    assert (again.items, again.inserted, again.deduplicated) == (5, 0, 5)
    assert bus.checkpoint("p")["generation"] != old["generation"]


def test_halving_and_waiting_for_room(spark, tmp_path):
    """A batch that can never fit is cut; what finds no room waits for a consumer. Each item is transformed once."""
    b = EventBus(Store(spark, f"file://{tmp_path}/b"), "shop", max_pending=4, clock=Clock())
    b.subscribe("s", CustomerWanted)
    seen = []

    def made(i):
        seen.append(i)
        return CustomerWanted(str(i), "n")

    with ThreadPoolExecutor(1) as pool:
        done = pool.submit(b.ingest, range(6), made, batch_size=6)
        queue = b.queue_of("s")
        until = time.monotonic() + 60
        while not queue.stats()["ready"] and time.monotonic() < until:
            time.sleep(0.2)
        assert queue.stats()["ready"] == 3 and not done.done()
        queue.ack(queue.get_nowait())
        queue.ack(queue.get_nowait())
        out = done.result(60)
    assert (out.items, out.inserted, out.batches) == (6, 6, 2) and seen == list(range(6))


@event
class Order:
    key: str


@event(identity=("key",))
class Booked:
    key: str
    amount: float


class Calls:
    """What a subscription's handler returns, by the order's key."""

    def __call__(self, e):
        if e.key == "nan":
            return Booked("x", float("nan"))
        if e.key == "other":
            return Booked("same", 2.0)
        if e.key == "unrouted":
            return Unheard(1)
        if e.key == "text":
            return "no event"
        if e.key == "own":
            return Booked("own", 1.0), Meta(event_id="e1", correlation_id="c1", causation_id="p1")
        return Booked(e.key, 1.0)


def test_one_bad_result_fails_its_own_delivery(spark, tmp_path):
    bus = EventBus(Store(spark, f"file://{tmp_path}/b"), "shop", clock=Clock())
    bus.on(Order, Calls(), subscription="orders", concurrency=2)
    bus.subscribe("books", Booked)
    bus.subscribe("audit", Booked)
    bus.dispatch(Booked("same", 1.0))
    bus.ingest([Order(k) for k in ("a", "nan", "other", "unrouted", "text", "own", "a")])
    assert bus.run_subscription("orders", idle_timeout=0) == 7
    failed = {r["event"]["key"]: (r["failure_reason"], r["failure_category"], r["attempts"]) for r in bus.subscription("orders").list_failed()}
    reason = "permanent_handler_error"
    assert failed == {"nan": (reason, "invalid_event_identity", 0), "other": (reason, "deduplication_conflict", 0), "unrouted": (reason, "no_subscribers", 0), "text": (reason, None, 0)}
    assert bus.subscription("orders").stats()["acked"] == 3 and bus.subscription("orders").stats()["processing"] == 0
    assert bus.subscription("books").stats()["ready"] == bus.subscription("audit").stats()["ready"] == 3  # same, a (once), own
    bodies = [r["payload"].decode() for r in bus.store.table("messages", queue=bus.queue_name("books")).collect()]
    assert any('"correlation_id":"c1","causation_id":"p1"' in b.replace(" ", "") for b in bodies)
    with pytest.raises(RuntimeError):
        bus.subscribe("more", Order)
    with pytest.raises(RuntimeError):
        bus.subscription("orders").config.concurrency = 3
    with pytest.raises(ValueError):
        bus.subscription("nobody")


def test_declared_sources(spark, tmp_path):
    bus = EventBus(Store(spark, f"file://{tmp_path}/b"), "shop", clock=Clock())
    bus.subscribe("orders", Order)

    async def numbers():
        for i in range(5):
            yield i

    @bus.source(numbers(), batch_size=2)
    async def orders(i):
        await asyncio.sleep(0)
        return Order(str(i))

    orders.config.batch_size = 3
    out = orders.ingest()
    assert (orders.name, out.items, out.batches, out.inserted) == ("orders", 5, 2, 5)
    with pytest.raises(RuntimeError):
        orders.config.batch_size = 4
    with pytest.raises(ValueError):
        bus.source([], batch_size=0)
    assert asyncio.run(bus.dispatch_async(Order("z"))).inserted_count == 1

    async def cancelled():
        task = asyncio.ensure_future(bus.ingest_async([Order(str(i)) for i in range(4)]))
        await asyncio.sleep(0.3)
        task.cancel()
        with pytest.raises(asyncio.CancelledError):
            await task

    asyncio.run(cancelled())
    assert bus.subscription("orders").stats()["ready"] == 10  # the commit at hand was settled


def test_executions_wait_for_retries_and_time_out(spark, tmp_path):
    seen = f"{tmp_path}/seen"
    bus = EventBus(Store(spark, f"file://{tmp_path}/b"), "shop")

    @bus.handler(Order, subscription="orders", retry=RetryPolicy.fixed(3, 0.2))
    def handle(e):
        import os

        if not os.path.exists(seen):
            open(seen, "w").close()
            raise KeyError("first")

    @bus.source(SequenceSource([Order("a"), Order("b")], "f"), checkpoint="c")
    def orders(e):
        return e

    out = bus.execute(orders)
    assert (out.completed, out.acknowledged, out.total) == (True, 2, 2)
    again = bus.execute(orders)  # of the same generation: the same execution
    assert again.execution_id == out.execution_id and again.completed

    with pytest.raises(TimeoutError):
        bus.execute(SequenceSource([Order(str(i)) for i in range(100)], "g"), lambda e: time.sleep(0.05) or e, name="slow", checkpoint="d", timeout=0.5)
    row = bus.store.table("runtime").filter("checkpoint_name = 'd'").first()
    assert row["source_receipt"] is None and row["source_completed_at"] is None
    with pytest.raises(ValueError):
        bus.execute(orders, timeout=-1)
