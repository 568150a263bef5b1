"""Event envelopes: JSON out, and validation on the way in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys of an envelope.
KEYS = ("event_id", "correlation_id", "causation_id", "event_type", "event_schema", "event_created_at", "payload")


def envelope(event_id: Column, correlation_id: Column, causation_id: Column, event_type: Column, event_schema: Column, created_at: Column, payload_json: Column) -> Column:
    """The JSON text; the payload is given as JSON and goes in unquoted. Made once for each event, before fan-out."""
    head = F.to_json(
        F.struct(event_id.alias("event_id"), correlation_id.alias("correlation_id"), causation_id.alias("causation_id"), event_type.alias("event_type"), event_schema.alias("event_schema"), created_at.alias("event_created_at")),
        {"ignoreNullFields": "false"},
    )
    return F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"payload":'), payload_json, F.lit("}"))


def failure(text: Column, known_types: list[str]) -> Column:
    """Why an envelope can't be delivered, or null: not an object, no type or payload, unknown type."""
    v = F.try_parse_json(text)
    is_object = F.schema_of_variant(v).startswith("OBJECT")
    kind = F.try_variant_get(v, "$.event_type", "string")
    kind_text = F.schema_of_variant(F.try_variant_get(v, "$.event_type", "variant")) == "STRING"
    payload = F.schema_of_variant(F.try_variant_get(v, "$.payload", "variant")).startswith("OBJECT")
    ok = F.coalesce(v.isNotNull() & is_object & kind_text & payload, F.lit(False))
    return F.when(~ok, "invalid_envelope").when(~kind.isin(known_types), "unknown_event_type")
