"""The delivery state machine as a keyed stream: one state and one timer for each message."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..schema import ACKED, FAILED, LEASED, READY
from ..store import scratch_path

COMMANDS = "queue string, message long, seq long, op string, at long"
OUT = "queue string, message long, step long, op string, status long, attempts long, lease_until long"
STATE = "status int, attempts int, lease_until long, steps long"
#: Where timers need state, and the provider that keeps it.
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def step(state: tuple, op: str, at: int, *, lease: int, max_attempts: int) -> tuple:
    """(status, attempts, lease_until) after a command: get, ack, nack, fail, reclaim. A lapsed lease is
    given up when the message is wanted again."""
    status, attempts, until = state
    held, over = status == LEASED, attempts >= max_attempts
    if held and until <= at:
        if op not in ("get", "reclaim"):
            return state
        status, held = FAILED if over else READY, False
    if op == "get" and status == READY:
        return LEASED, attempts + 1, at + lease
    if held:
        status = {"ack": ACKED, "nack": FAILED if over else READY, "fail": FAILED}.get(op, status)
    return status, attempts, until if status == LEASED else None


class Deliveries(StatefulProcessor):
    """A message's commands, in the order of seq within a batch; a timer at the end of its lease."""

    def __init__(self, lease: int, max_attempts: int):
        self.lease, self.max_attempts = lease, max_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("delivery", STATE)

    def _held(self) -> tuple[tuple, int]:
        if not self.state.exists():
            return (READY, 0, None), 0
        s = self.state.get()
        return (s[0], s[1], None if s[2] is None else int(s[2])), s[3]

    def _row(self, key, steps: int, op: str, now: tuple) -> Row:
        return Row(queue=key[0], message=int(key[1]), step=steps, op=op, status=int(now[0]), attempts=int(now[1]), lease_until=now[2])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        now, steps = self._held()
        for r in sorted(rows, key=lambda r: r.seq):
            before, now, steps = now, step(now, r.op, int(r.at), lease=self.lease, max_attempts=self.max_attempts), steps + 1
            if now[2] is not None and now[2] != before[2]:
                self.handle.registerTimer(now[2])
            yield self._row(key, steps, r.op, now)
        self.state.update((now[0], now[1], now[2], steps))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now, steps = self._held()
        if now[0] == LEASED and now[2] <= expiredTimerInfo.getExpiryTimeInMs():  # else that lease has ended before
            now = (FAILED if now[1] >= self.max_attempts else READY, now[1], None)
            self.state.update((*now, steps + 1))
            yield self._row(key, steps + 1, "expire", now)

    def close(self) -> None:
        pass


def machine(commands: DataFrame, *, lease: int = 30, max_attempts: int = 4) -> DataFrame:
    """A stream of commands (queue, message, seq, op, at in epoch milliseconds) to a stream of states, one
    for each command and each lease that ends. Commands must come in the order of at."""
    timed = commands.withColumn("ts", F.timestamp_millis("at")).withWatermark("ts", "0 seconds")
    return timed.groupBy("queue", "message").transformWithState(Deliveries(lease, max_attempts), OUT, "Append", "EventTime")


def _run(spark: SparkSession, stream: DataFrame, base: str) -> None:
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint").option("path", f"{base}/out").trigger(availableNow=True).start()
    q.awaitTermination()


def run_to_end(spark: SparkSession, parts: list[DataFrame], *, lease: int, max_attempts: int) -> DataFrame:
    """Commands that come in parts, the query being stopped after each: states go on from the checkpoint."""
    base, (key, provider) = scratch_path(spark, "stream"), _PROVIDER
    before = spark.conf.get(key)
    spark.conf.set(key, provider)
    try:
        for part in parts:
            part.write.mode("append").parquet(f"{base}/in")
            _run(spark, machine(spark.readStream.schema(COMMANDS).parquet(f"{base}/in"), lease=lease, max_attempts=max_attempts), base)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(OUT).parquet(f"{base}/out")


def resumed(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    """Rows that arrive in parts, each run being stopped before the next part comes; one checkpoint
    makes every row pass once."""
    base = scratch_path(spark, "stream")
    for part in parts:
        part.write.mode("append").parquet(f"{base}/in")
        _run(spark, spark.readStream.schema(part.schema).parquet(f"{base}/in"), base)
    return spark.read.schema(parts[0].schema).parquet(f"{base}/out")
