"""Benchmark workloads over a queue: raw samples, their summary, and a check that all came through."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..bus import EventBus
from ..operators.aggregates import id_check, latency_summary
from ..queue import Queue
from ..schema import ACKED, MillraceError
from ..store import Store


def _timed(samples: list, name: str, f):
    began = time.perf_counter_ns()
    out = f()
    samples.append((name, (time.perf_counter_ns() - began) / 1000))
    return out


def bulk(queue: Queue, n: int, *, rounds: int = 3, payload: int = 128) -> DataFrame:
    """put_many, claim and ack of n messages at a time; raises unless each was put, claimed and acknowledged once.

    Returns the latency summary by step (microseconds a batch).
    """
    spark, samples = queue.store.spark, []
    none = [F.lit(None).cast("string").alias(c) for c in ("job_id", "dedup_key", "dedup_fingerprint")]
    for r in range(rounds):
        body = F.concat(F.lit('{"id":"'), F.lpad((F.col("id") + r * n).cast("string"), 12, "0"), F.lit('","padding":"' + "x" * payload + '"}'))
        batch = spark.range(n).select(F.col("id").alias("seq"), F.lit(queue.name).alias("queue"), body.cast("binary").alias("payload"), *none)
        _timed(samples, f"put_many-{n}", lambda b=batch: queue.put_frame(b).count())
        claimed = _timed(samples, f"claim-{n}", lambda: queue.claim(n))
        commands = claimed.select(F.lit(queue.name).alias("queue"), "id", "receipt")
        _timed(samples, f"ack-{n}", lambda c=commands: queue.apply(c, "ack"))
    done = queue.store.table("messages").filter((F.col("queue") == queue.name) & (F.col("status") == ACKED))
    check = id_check(done, "queue", "id").first()
    if check is None or check["count"] != n * rounds or check["sum"] != n * rounds * (n * rounds + 1) // 2:
        raise MillraceError("messages were lost or repeated")
    return latency_summary(spark.createDataFrame(samples, "name string, us double"), "name", "us")


def fan_out(bus: EventBus, make, subscriptions: int, *, rounds: int = 3) -> DataFrame:
    """One dispatch to many subscriptions at a time; make(i) gives an event."""
    for k in range(subscriptions):
        bus.subscribe(f"s{k}", make(0).event_type)
    samples: list = []
    for i in range(rounds):
        out = _timed(samples, f"fanout-{subscriptions}", lambda i=i: bus.dispatch(make(i)))
        if out.inserted_count != subscriptions:
            raise MillraceError("deliveries are missing")
    return latency_summary(bus.store.spark.createDataFrame(samples, "name string, us double"), "name", "us")


def round_trip(queue: Queue, n: int, *, warm_up: int = 1) -> DataFrame:
    """put, then get and ack, of one message at a time: samples (name, us) of each step and of the whole,
    without the first warm_up rounds. Raises unless each message comes back once, in order."""
    samples: list = []
    for i in range(n + warm_up):
        began = time.perf_counter_ns()
        put = _timed(samples, "put", lambda i=i: queue.put(i))
        job = _timed(samples, "get", queue.get_nowait)
        _timed(samples, "ack", lambda job=job: queue.ack(job))
        samples.append(("round_trip", (time.perf_counter_ns() - began) / 1000))
        if (job.id, job.data) != (put, i):
            raise MillraceError("a message was lost or out of order")
    return queue.store.spark.createDataFrame(samples[4 * warm_up :], "name string, us double")


def many_clients(store: Store, names: list[str], n: int, *, batch: int = 50) -> dict[str, int]:
    """Producers and consumers of several queues at once, a thread for each, until each queue has handled n
    messages. Passes only if produced, claimed and acknowledged agree, all queues are drained, the store
    is whole and no id is used twice."""

    def produce(name: str) -> list[int]:
        queue = Queue(store, name)
        return [i for start in range(0, n, batch) for i in queue.put_many(list(range(start, min(n, start + batch))))]

    def consume(name: str) -> tuple[int, int]:
        queue, claimed, acked, until = Queue(store, name), 0, 0, time.monotonic() + 300
        while acked < n and time.monotonic() < until:
            some = queue.claim(batch)
            m = some.count()
            claimed += m
            acked += queue.apply(some.select(F.lit(name).alias("queue"), "id", "receipt"), "ack") if m else 0
        return claimed, acked

    with ThreadPoolExecutor(2 * len(names)) as pool:
        producers, consumers = [pool.submit(produce, x) for x in names], [pool.submit(consume, x) for x in names]
        ids = [i for f in producers for i in f.result()]
        seen = [f.result() for f in consumers]
    out = {"produced": len(ids), "claimed": sum(c for c, _ in seen), "acked": sum(a for _, a in seen)}
    whole = Queue(store, names[0]).check_integrity()
    left = sum(Queue(store, x).stats()[k] for x in names for k in ("ready", "processing"))
    if set(out.values()) != {n * len(names)} or len(set(ids)) < len(ids) or left or whole:
        raise MillraceError(f"the run doesn't agree: {out}, {left} left, {whole}")
    return out


def large(queue: Queue, rows: int, *, batches: int = 4, n: int = 1000) -> DataFrame:
    """Claims and acknowledgements of n messages in a table of rows: the latency summary of each."""
    none = [F.lit(None).cast("string").alias(c) for c in ("job_id", "dedup_key", "dedup_fingerprint")]
    for k in range(batches):
        some = queue.store.spark.range(rows * k // batches, rows * (k + 1) // batches)
        queue.put_frame(some.select(F.col("id").alias("seq"), F.lit(queue.name).alias("queue"), F.col("id").cast("string").cast("binary").alias("payload"), *none))
    samples: list = []
    for _ in range(3):
        claimed = _timed(samples, f"claim-{n}", lambda: queue.claim(n))
        if _timed(samples, f"ack-{n}", lambda c=claimed: queue.apply(c.select(F.lit(queue.name).alias("queue"), "id", "receipt"), "ack")) != n:
            raise MillraceError("a claim was lost")
    return latency_summary(queue.store.spark.createDataFrame(samples, "name string, us double"), "name", "us")


def ingestion_matrix(make_bus, make, items: int, *, fan_outs=(1, 5), batches=(100, 1000), limits=(None, 1_000_000)) -> DataFrame:
    """Items a second of ingestion by fan-out, batch size and limit. make_bus(name) gives a new bus, make(i) an
    event; whether events have an identity is theirs to say."""
    rows = []
    for fan, size, limit in product(fan_outs, batches, limits):
        bus = make_bus(f"f{fan}-b{size}-l{limit}")
        for k in range(fan):
            bus.subscribe(f"s{k}", make(0).event_type)
        began = time.perf_counter()
        out = bus.ingest((make(i) for i in range(items)), batch_size=size, max_pending=limit)
        took = time.perf_counter() - began
        if out.inserted + out.deduplicated != items * fan:
            raise MillraceError("deliveries are missing")
        rows.append((fan, size, limit, out.inserted, items / took, out.inserted / took))
    return bus.store.spark.createDataFrame(rows, "fan_out int, batch int, max_pending long, inserted long, items_per_second double, deliveries_per_second double")
