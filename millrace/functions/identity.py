"""Canonical JSON, business identities and payload fingerprints."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from ..schema import InvalidEventIdentity

#: Prefixes of stored digests.
KEY_PREFIX, PRINT_PREFIX = "event-identity:v1:", "event-payload:v1:"


def canonical_json(value: object) -> bytes:
    """Sorted keys, no spaces, UTF-8, finite numbers."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


def digest(value: object) -> str:
    return hashlib.sha256(canonical_json(value)).hexdigest()


def identities(event_schema: str, payload: dict, fields: tuple[str, ...] | None, event_id: str) -> tuple[str | None, str | None, str | None]:
    """(job_id, dedup_key, dedup_fingerprint) of one event."""
    if fields is None:
        return event_id, None, None
    for f in fields:
        if f not in payload or payload[f] is None or (isinstance(payload[f], str) and not payload[f].strip()):
            raise InvalidEventIdentity(f"identity field {f!r} must be present and not blank")
    named = {f: payload[f] for f in fields}
    return event_id, KEY_PREFIX + digest({"event_schema": event_schema, "identity": named}), PRINT_PREFIX + digest({"event_schema": event_schema, "payload": payload})


def _sorted(c: Column, kind: DataType) -> Column:
    if isinstance(kind, StructType):
        return F.struct(*[_sorted(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: _sorted(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(c)))
    return c


def canonical_column(df: DataFrame, columns: list[str]) -> Column:
    """The same text as canonical_json for strings, integers, booleans, nulls and what nests them; keys
    are sorted when the plan is made. Floating-point numbers print otherwise: use digest_udf for those."""
    parts = [_sorted(F.col(c), df.schema[c].dataType).alias(c) for c in sorted(columns)]
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def with_identity(df: DataFrame, event_schema: str, payload: list[str], fields: list[str]) -> DataFrame:
    """df with dedup_key and dedup_fingerprint, all in the JVM."""
    schema = F.lit(json.dumps(event_schema, ensure_ascii=False))

    def of(name: str, columns: list[str]) -> Column:
        return F.sha2(F.concat(F.lit('{"event_schema":'), schema, F.lit(f',"{name}":'), canonical_column(df, columns), F.lit("}")), 256)

    return df.withColumns({"dedup_key": F.concat(F.lit(KEY_PREFIX), of("identity", fields)), "dedup_fingerprint": F.concat(F.lit(PRINT_PREFIX), of("payload", payload))})


def digest_udf():
    """A pandas UDF: JSON text to the digest of its canonical form, exact for floating-point numbers."""
    import pandas as pd

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else digest(json.loads(t)))

    return run
