import pytest

import __spark_entry__ as entry
from millrace.plans import catalog

from .compare import same


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    same(catalog.QUERIES[name](spark, sf_dir), catalog.ORACLES[name], sf_dir)


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_leases_end_by_timers(spark):
    """A lease that nothing asks for ends when the watermark passes it; a stale timer ends nothing."""
    from millrace.streaming.machine import run_to_end

    rows = [("q", 1, 1, "get", 1000), ("q", 2, 2, "get", 1010), ("q", 2, 3, "ack", 1020), ("q", 3, 4, "get", 1030), ("q", 9, 5, "get", 5000), ("q", 3, 6, "get", 5010), ("q", 9, 7, "nack", 5020), ("q", 8, 8, "ack", 5100)]
    frames = [spark.createDataFrame(part, "queue string, message long, seq long, op string, at long") for part in (rows[:4], rows[4:])]
    out = run_to_end(spark, frames, lease=100, max_attempts=1).collect()
    steps = {m: [(r["op"], r["status"], r["attempts"]) for r in sorted(out, key=lambda r: r["step"]) if r["message"] == m] for m in (1, 2, 3, 8, 9)}
    assert steps[1] == [("get", 1, 1), ("expire", 3, 1)] and steps[2] == [("get", 1, 1), ("ack", 2, 1)] and steps[8] == [("ack", 0, 0)]
    assert steps[3] == [("get", 1, 1), ("get", 3, 1)] and steps[9] == [("get", 1, 1), ("nack", 3, 1)]


def test_plans_push_filters_down(spark, sf_dir):
    from millrace.operators.ingest import resume

    plan = resume(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id", 10, 5)._jdf.queryExecution().toString()
    assert "GreaterThan(event_id,10)" in plan and "ReadSchema: struct<event_id:bigint>" in plan
