"""Stored tables, state codes, failure reasons and errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructType

#: State codes and their public names.
READY, LEASED, ACKED, FAILED = 0, 1, 2, 3
STATE_NAMES = {READY: "ready", LEASED: "processing", ACKED: "acked", FAILED: "failed"}

#: Why a message failed; anything else reads as legacy_unknown.
FAILURE_REASONS = (
    "retries_exhausted", "permanent_handler_error", "unknown_event_type", "invalid_envelope", "invalid_payload",
    "handler_timeout", "explicit_permanent_failure", "no_handler", "rejected", "legacy_unknown",
)

_TYPES = {"long": LongType(), "string": StringType(), "binary": BinaryType(), "boolean": BooleanType()}


def _struct(ddl: str) -> StructType:
    """Of 'name type, ...'; unlike fromDDL, without a session."""
    out = StructType()
    for name, kind in (x.split() for x in ddl.split(",")):
        out = out.add(name, _TYPES[kind])
    return out


#: The stored tables.
MESSAGES = _struct(
    "id long, queue string, payload binary, status long, attempts long, max_attempts long, available_at long, lease_until long, receipt string, "
    "last_error string, failure_reason string, failure_category string, job_id string, dedup_key string, dedup_fingerprint string, created_at long, updated_at long"
)
CHECKPOINTS = _struct(
    "bus_name string, checkpoint_name string, cursor string, source_fingerprint string, generation string, version long, items_committed long, batches_committed long, created_at long, updated_at long"
)
EXECUTIONS = _struct("execution_id string, bus_name string, source_name string, checkpoint_name string, source_completed boolean, created_at long, updated_at long")
DELIVERIES = _struct("execution_id string, message_id long")
EDGES = _struct("parent_message_id long, child_message_id long")
RUNTIME = _struct(
    "execution_id string, bus_name string, checkpoint_name string, source_fingerprint string, checkpoint_generation string, source_receipt string, source_lease_until long, "
    "source_completed_at long, completed_at long, items_committed long, events_dispatched long, events_unrouted long, deliveries_inserted long, deliveries_deduplicated long, batches_committed long"
)
TABLES = {"messages": MESSAGES, "checkpoints": CHECKPOINTS, "executions": EXECUTIONS, "deliveries": DELIVERIES, "edges": EDGES, "runtime": RUNTIME}


def upcast(df: DataFrame, schema: StructType) -> DataFrame:
    """A table of an older version in today's columns: absent ones null, others cast."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def failure_reason(c):
    return F.when(c.isin(*FAILURE_REASONS), c).otherwise("legacy_unknown")


class MillraceError(Exception):
    """Base of this library's errors; every one is raised before anything is committed."""


class Empty(MillraceError):
    """Nothing can be claimed."""


class Full(MillraceError):
    """Pending and new rows together exceed a queue's limit."""


class FullImpossible(Full):
    """New rows alone exceed a queue's limit."""


class ConflictingCapacityPolicies(MillraceError, ValueError):
    """One queue is given two limits."""


class LeaseExpired(MillraceError):
    """A receipt no longer holds its lease."""


class DeduplicationConflict(MillraceError):
    """A key meets a different row or fingerprint."""


class CheckpointConflict(MillraceError):
    """A checkpoint isn't at the expected generation and version."""


class SourceChanged(MillraceError):
    """A checkpoint belongs to another source."""


class NoSubscribers(MillraceError):
    """No subscription takes this event type."""


class InvalidEventIdentity(MillraceError, ValueError):
    """An identity field is absent, null, blank or not finite JSON."""


class ExecutionLeaseLost(MillraceError):
    """Another run holds the source lease."""


class ExecutionRuntimeMissing(MillraceError):
    """An execution has no runtime row."""


class ExecutionFailed(MillraceError):
    """An execution has failed deliveries."""


class CsvSourceError(MillraceError, ValueError):
    """A CSV file or cursor breaks the rules; carries record and line."""

    def __init__(self, text: str, record: int | None = None, line: int | None = None):
        super().__init__(text if record is None else f"{text} (record {record}, line {line})")
        self.record, self.line = record, line
