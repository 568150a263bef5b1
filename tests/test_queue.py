import random
from concurrent.futures import ThreadPoolExecutor

import pytest

from millrace.functions.retry import Reject, Retry, RetryPolicy, milliseconds
from millrace.queue import EnqueueItem, Queue, Worker
from millrace.schema import DeduplicationConflict, Empty, Full, FullImpossible, LeaseExpired, MillraceError
from millrace.store import Change, Conflict, Store


class Clock:
    def __init__(self):
        self.now = 1_000_000

    def __call__(self):
        return self.now


@pytest.fixture
def clock():
    return Clock()


@pytest.fixture
def queue(spark, tmp_path, clock):
    return Queue(Store(spark, f"file://{tmp_path}/store"), "q", lease_seconds=5, max_retries=1, clock=clock)


def test_put_get_ack(queue):
    ids = queue.put_many(["a", EnqueueItem("b", "j"), EnqueueItem("ignored", "j"), "c"])
    assert ids == [1, 2, 2, 3]
    job = queue.get_nowait()
    assert (job.id, job.data, job.attempts) == (1, "a", 0)
    queue.ack(job)
    with pytest.raises(LeaseExpired):
        queue.ack(job)
    assert queue.stats() == {"ready": 2, "processing": 0, "acked": 1, "failed": 0}
    assert queue.put(EnqueueItem("x", "j").data, "j") == 2
    assert queue.put_many([]) == []


def test_expiry_fences_and_budget(queue, clock):
    queue.put("a")
    first = queue.get_nowait()
    clock.now += 5000
    assert queue.reclaim_expired_leases() == 1
    again = queue.get_nowait()
    assert again.attempts == 1
    for act in (queue.ack, queue.nack, queue.fail, lambda j: queue.extend_lease(j, 1)):
        with pytest.raises(LeaseExpired):
            act(first)
    queue.extend_lease(again, 20)
    clock.now += 19_000
    queue.nack(again, delay=3, last_error="boom")
    row = queue.list_failed()[0]
    assert (row["failure_reason"], row["last_error"], row["available_at"]) == ("retries_exhausted", "boom", clock.now)
    queue.retry_failed(row["id"])
    assert queue.get_nowait().attempts == 0
    with pytest.raises(MillraceError):
        queue.retry_failed(99)


def test_delay_and_purge(queue, clock):
    queue.put("a")
    queue.nack(queue.get_nowait(), delay=1)
    with pytest.raises(Empty):
        queue.get_nowait()
    assert queue.stats()["ready"] == 1
    clock.now += 1000
    queue.fail(queue.get_nowait(), "no")
    clock.now += 10_000
    assert queue.purge(1) == 0 and queue.purge(1, include_failed=True) == 1


def test_capacity(spark, tmp_path, clock):
    q = Queue(Store(spark, f"file://{tmp_path}/s"), "q", max_pending=2, clock=clock)
    with pytest.raises(FullImpossible):
        q.put_many([1, 2, 3])
    q.put_many([EnqueueItem(1, "a"), 2])
    with pytest.raises(Full):
        q.put(3, block=False)
    assert q.put(9, "a", block=False) == 1  # nothing new is always admitted
    d = q.diagnostics()
    assert (d["pending"], d["available_slots"]) == (2, 0)


def test_identity_conflicts(queue):
    from millrace.queue import prepared

    spark = queue.store.spark
    queue.put_frame(prepared(spark, [(0, "q", b"1", "j", "k", "f")]))
    with pytest.raises(DeduplicationConflict):
        queue.put_frame(prepared(spark, [(0, "q", b"1", None, "k", "other")]))
    with pytest.raises(DeduplicationConflict):
        queue.put_frame(prepared(spark, [(0, "q", b"1", "j", "k2", "f")]))
    with pytest.raises(ValueError):
        queue.put_frame(prepared(spark, [(0, "q", b"1", None, "k", None)]))
    assert queue.stats()["ready"] == 1


def _handle(data):
    if data == "retry":
        raise Retry("later", after=2)
    if data == "reject":
        raise Reject("bad", category="validation")
    if data == "error":
        raise KeyError("x")
    if data == "final":
        raise ZeroDivisionError


def test_worker(queue, clock):
    queue.put_many(["ok", "retry", "reject", "error", "final"])
    w = Worker(queue, _handle, permanent_errors=(ZeroDivisionError,), retry=RetryPolicy.fixed(2, 1))
    assert w.run() == 5
    assert queue.stats() == {"ready": 2, "processing": 0, "acked": 1, "failed": 2}
    assert {r["failure_reason"] for r in queue.list_failed()} == {"rejected", "permanent_handler_error"}
    clock.now += 2000
    assert w.run() == 2
    assert queue.stats()["failed"] == 4


def test_store_commits_are_exclusive(spark, tmp_path, queue):
    queue.put("a")
    store, base = queue.store, queue.store.version()
    store.commit(base, {})
    with pytest.raises(Conflict):
        store.commit(base, {})
    base = store.version()

    def race(_):
        try:
            return store.commit(base, {})
        except Conflict:
            return None

    with ThreadPoolExecutor(6) as pool:
        assert sorted(map(str, pool.map(race, range(6)))) == sorted([str(base + 1), *["None"] * 5])
    assert queue.backup(f"file://{tmp_path}/copy")["rows"] == {"messages": 1}
    with pytest.raises(FileExistsError):
        queue.backup(f"file://{tmp_path}/copy")
    assert Queue(Store(spark, f"file://{tmp_path}/copy"), "q").stats()["ready"] == 1
    for _ in range(4):
        queue.put("b")
    queue.vacuum()  # merges; the versions that name the old parts are kept for a while
    for _ in range(3):
        queue.put("c")
    assert queue.vacuum() >= 2 and queue.stats()["ready"] == 8 and queue.check_integrity() == {}
    queue.close()
    with pytest.raises(MillraceError):
        queue.stats()


def test_against_a_model(queue, clock):
    """Random operations on the queue and on a plain model of it."""
    rng, model, jobs, top = random.Random(4), {}, {}, 0
    for _ in range(18):
        op = rng.choice(["put", "get", "ack", "nack", "wait"])
        if op == "put":
            top += 1
            assert queue.put(top) == top
            model[top] = ["ready", 0, clock.now]
        elif op == "wait":
            clock.now += 3000
        elif op == "get":
            for m in model.values():
                if m[0] == "processing" and m[2] <= clock.now:
                    m[:] = ["ready" if m[1] < 2 else "failed", m[1], clock.now]
            free = [k for k, m in model.items() if m[0] == "ready" and m[2] <= clock.now]
            try:
                j = queue.get_nowait()
                assert j.id == min(free) and j.attempts == model[j.id][1]
                model[j.id] = ["processing", model[j.id][1] + 1, clock.now + 5000]
                jobs[j.id] = j
            except Empty:
                assert not free
        elif jobs:
            k = rng.choice(sorted(jobs))
            live = model[k][0] == "processing" and model[k][2] > clock.now
            try:
                (queue.ack if op == "ack" else queue.nack)(jobs.pop(k))
                assert live
                model[k] = ["acked", 0, 0] if op == "ack" else ["ready" if model[k][1] < 2 else "failed", model[k][1], clock.now]
            except LeaseExpired:
                assert not live
    found = queue.stats()
    assert found == {s: sum(m[0] == s for m in model.values()) for s in found}


@pytest.mark.parametrize("bad", [True, float("nan"), float("inf"), -1, 1e300, "1"])
def test_durations(bad):
    with pytest.raises((TypeError, ValueError)):
        milliseconds(bad)
    assert milliseconds(1.2345) == 1234


def test_commits_write_what_changed(spark, tmp_path, clock):
    """On a table of 300,000 messages, a put, a claim and an ack write a few thousand bytes each."""
    from pyspark.sql import functions as F

    store = Store(spark, f"file://{tmp_path}/s")
    q = Queue(store, "big", clock=clock)
    rows = spark.range(300_000).select(F.col("id").alias("seq"), F.lit("big").alias("queue"), F.concat(F.lit('"'), F.sha2(F.col("id").cast("string"), 256), F.lit('"')).cast("binary").alias("payload"), *[F.lit(None).cast("string").alias(c) for c in ("job_id", "dedup_key", "dedup_fingerprint")])
    assert q.put_frame(rows).count() == 300_000
    whole = store.metrics()["bytes"]
    jobs = []
    for step in (lambda: q.put("x"), lambda: jobs.append(q.get_nowait()), lambda: q.ack(jobs[0])):
        before = store.metrics()["bytes"]
        step()
        assert whole > 10_000_000 and store.metrics()["bytes"] - before < 60_000
    assert (jobs[0].id, q.stats()) == (1, {"ready": 300_000, "processing": 0, "acked": 1, "failed": 0})


def test_writers_of_two_queues_do_not_conflict(spark, tmp_path, clock):
    store = Store(spark, f"file://{tmp_path}/s")
    a, b = Queue(store, "a", clock=clock), Queue(store, "b", clock=clock)
    a.put("x")
    base, part = store.version(), lambda q: [Change(store.table("messages", queue=q.name).limit(0), queue=q.name)]
    assert store.commit(base, {"messages": part(a)}, [a.scope]) == base + 1
    assert store.commit(base, {"messages": part(b)}, [b.scope]) == base + 2
    with pytest.raises(Conflict):
        store.commit(base, {"messages": part(a)}, [a.scope])
    with ThreadPoolExecutor(2) as pool:
        ids = [i for f in [pool.submit(q.put_many, list(range(3))) for q in (a, b)] for i in f.result()]
    assert len(set(ids)) == 6 and a.stats()["ready"] == 4 and b.stats()["ready"] == 3


def test_parts_are_merged(spark, tmp_path, clock, monkeypatch):
    monkeypatch.setattr("millrace.store.MANY_PARTS", 4)
    store = Store(spark, f"file://{tmp_path}/s")
    q, other = Queue(store, "q:1/x", clock=clock), Queue(store, "other", clock=clock)
    other.fanout("shared", [("other", "j"), ("q:1/x", None), ("other", "j")])
    for i in range(6):
        q.put(i)
        q.ack(q.get_nowait())
    assert len(store.parts("messages", queue="q:1/x")) <= 6 and len(store.parts("messages", queue="other")) == 1
    assert q.stats() == {"ready": 1, "processing": 0, "acked": 6, "failed": 0} and other.stats()["ready"] == 1
    clock.now += 1000
    assert q.purge(0.5) == 6 and q.stats()["acked"] == 0 and q.get_nowait().data == 5


def test_worker_stops_and_keeps_its_leases(spark, tmp_path):
    import time

    q = Queue(Store(spark, f"file://{tmp_path}/s"), "q", lease_seconds=3)
    q.put_many(["a", "b"])

    def slow(data):
        time.sleep(4.5)

    w = Worker(q, slow, heartbeat_interval=0.5, poll_interval=0.05)
    with ThreadPoolExecutor(1) as pool:
        done = pool.submit(w.run, idle_rounds=None)
        time.sleep(2)
        w.stop()
        assert done.result(60) == 2
    assert q.stats()["acked"] == 2  # though handling took longer than a lease
    with pytest.raises(ValueError):
        Worker(q, slow, heartbeat_interval=9)


class Pickled:
    def dumps(self, value):
        import pickle

        return pickle.dumps(value)

    def loads(self, data):
        import pickle

        return pickle.loads(data)


def test_own_serializer(spark, tmp_path, clock):
    q = Queue(Store(spark, f"file://{tmp_path}/s"), "q", serializer=Pickled(), clock=clock)
    q.put({1, 2})
    q.put((3, b"x"))
    assert q.get_nowait().data == {1, 2}
    assert Worker(q, lambda data: data.add).run_once() == 1  # a tuple has no add: another attempt
    assert q.stats()["ready"] == 1
