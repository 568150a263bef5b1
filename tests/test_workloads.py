import asyncio
import json

import pytest
from pyspark.sql import functions as F

from millrace.bus import EventBus, _deliver, _Handler, event, REGISTRY
from millrace.functions.report import write
from millrace.functions.retry import RetryPolicy
from millrace.plans.workloads import bulk
from millrace.queue import Queue
from millrace.store import Store


@event
class Tick:
    n: int


def body(**more):
    return json.dumps({"event_id": "e", "event_type": "Tick", "payload": {"n": 1}} | more).encode()


def test_bulk_and_report(spark, tmp_path):
    out = bulk(Queue(Store(spark, f"file://{tmp_path}/s"), "q"), 50, rounds=2)
    rows = [r.asDict() for r in out.collect()]
    assert {r["name"]: r["count"] for r in rows} == {"put_many-50": 2, "claim-50": 2, "ack-50": 2}
    write(f"{tmp_path}/r.md", rows)
    write(f"{tmp_path}/r.json", rows)
    assert (tmp_path / "r.md").read_text().count("\n") == 5 and len(json.loads((tmp_path / "r.json").read_text())) == 3


@pytest.mark.parametrize(
    ("payload", "reason"),
    [(b"x", "invalid_envelope"), (b"[]", "invalid_envelope"), (body(event_type=1), "invalid_envelope"), (body(event_type="No"), "unknown_event_type"), (body(payload={"m": 1}), "invalid_payload"), (body(), "no_handler")],
)
def test_dead_letters(payload, reason):
    assert _deliver(payload, 1, {}, REGISTRY)[:3][::2] == ("fail", reason)


def test_timeout_and_context():
    async def slow(e, attempt):
        await asyncio.sleep(attempt)

    h = _Handler(slow, None, (), 0.05, lambda c: c.attempt - 1)
    assert _deliver(body(), 1, {"*": h}, REGISTRY)[0] == "ack"
    assert _deliver(body(), 2, {"*": h}, REGISTRY)[::2][:2] == ("nack", "handler_timeout")
    h.retry = RetryPolicy.exponential(3, 1, 3, 2)
    assert _deliver(body(), 2, {"*": h}, REGISTRY)[2:5:2] == (None, 2000)
    assert _deliver(body(), 1, {"*": _Handler(lambda e: 5, None, ())}, REGISTRY)[2] == "permanent_handler_error"
    with pytest.raises(ValueError):
        EventBus(None).handler(Tick, subscription="s", timeout=1)(lambda e: None)


class Cancelled(Exception):
    pass


@pytest.mark.parametrize(
    ("raised", "permanent", "outcome"),
    [
        (TimeoutError("upstream"), (), ("nack", "upstream", None)),  # its own TimeoutError is like any other error
        (TimeoutError("upstream"), (TimeoutError,), ("fail", "permanent failure: upstream", "permanent_handler_error")),
        (None, (TimeoutError,), ("nack", "handler timeout after 0.05 seconds", "handler_timeout")),  # the limit beats permanent_errors
        (KeyError(), (), ("nack", "KeyError", None)),
    ],
)
def test_precedence_of_timeouts(raised, permanent, outcome):
    async def handle(e):
        if raised is not None:
            raise raised
        try:
            await asyncio.sleep(9)
        finally:
            return Tick(1)  # what comes after the cancellation doesn't count  # noqa: B012

    assert _deliver(body(), 1, {"*": _Handler(handle, None, permanent, 0.05)}, REGISTRY)[:3] == outcome


def test_retry_delays():
    draws = []
    policy = RetryPolicy.exponential(3, 2, 2, 10, jitter=True)
    assert policy.seconds(2, lambda a, b: draws.append((a, b)) or b / 4) == 1.0 and draws == [(0.0, 4.0)]
    assert RetryPolicy.exponential(500, 1e-300, 10.0, 1e200).seconds(400) == pytest.approx(1e99, rel=1e-9)
    assert RetryPolicy.exponential(500, 1, 2.0, 60).seconds(2000) == 60 and RetryPolicy.exponential(5, 0).seconds(4) == 0
    h = _Handler(lambda e: 1 / 0, RetryPolicy.fixed(3, 8), ())
    h.retry = RetryPolicy.exponential(9, 8, 2, 64, jitter=True)
    delays = {_deliver(body(), 3, {"*": h}, REGISTRY)[4] for _ in range(20)}
    assert len(delays) > 10 and all(0 <= d <= 32_000 for d in delays)


def test_delays_of_columns_and_numbers_agree(spark):
    for policy in (RetryPolicy.exponential(50, 0.5, 2.0, 60.0), RetryPolicy.fixed(3, 7), RetryPolicy.exponential(50, 1e-300, 10.0, 1e200), RetryPolicy.exponential(4, 0)):
        rows = spark.range(1, 500).select("id", policy.delay(F.col("id")).alias("d")).collect()
        assert all(r["d"] == pytest.approx(policy.seconds(r["id"]), rel=1e-9) for r in rows)


def test_digest_and_reconciliation(spark):
    import hashlib

    from millrace.operators.aggregates import digest_256, digest_sums, reconcile

    ids = spark.range(300).repartition(3)
    want = sum(int(hashlib.sha256(str(i).encode()).hexdigest(), 16) for i in range(300)) % (1 << 256)
    assert digest_256(list(digest_sums(ids, "id").first())) == want
    outcomes = spark.createDataFrame([("q", "ack"), ("q", "nack"), ("p", "ack")], "queue string, outcome string")
    messages = spark.createDataFrame([("q", 2), ("p", 0)], "queue string, status int")
    assert {r["queue"]: r["ok"] for r in reconcile(outcomes, messages).collect()} == {"q": True, "p": False}


def test_more_workloads(spark, tmp_path):
    from millrace.plans.workloads import ingestion_matrix, large, many_clients, round_trip

    names = [r["name"] for r in round_trip(Queue(Store(spark, f"file://{tmp_path}/a"), "q"), 2).collect()]
    assert sorted(names) == sorted(["put", "get", "ack", "round_trip"] * 2)
    assert many_clients(Store(spark, f"file://{tmp_path}/b"), ["x", "y"], 60, batch=30) == {"produced": 120, "claimed": 120, "acked": 120}
    out = large(Queue(Store(spark, f"file://{tmp_path}/c"), "q"), 20_000, batches=2, n=100).collect()
    assert {r["name"] for r in out} == {"claim-100", "ack-100"}
    rows = ingestion_matrix(lambda name: EventBus(Store(spark, f"file://{tmp_path}/{name}")), Tick, 20, fan_outs=(1, 2), batches=(10,), limits=(None,)).collect()
    assert [(r["fan_out"], r["inserted"]) for r in rows] == [(1, 20), (2, 40)]


def test_two_limits_of_one_queue(spark):
    from millrace.queue import admit, prepared
    from millrace.schema import MESSAGES, ConflictingCapacityPolicies

    with pytest.raises(ConflictingCapacityPolicies):
        admit(prepared(spark, [(0, "q", b"1", None, None, None)]), spark.createDataFrame([], MESSAGES), [("q", 1), ("q", 2)])


def test_wildcards_in_chunks(spark, monkeypatch):
    from millrace.operators import routing

    topology = spark.createDataFrame([(f"s{i}", "*") for i in range(7)] + [("t", "a")], "subscription string, pattern string")
    events = spark.createDataFrame([(1, "a"), (2, "b")], "event_id long, event_type string")
    whole = sorted(map(tuple, routing.route(events, topology).collect()))
    monkeypatch.setattr(routing, "MAX_BROADCAST_ROUTES", 3)
    assert sorted(map(tuple, routing.route(events, topology).collect())) == whole and len(whole) == 15
