"""Canonical JSON and content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(text: Column) -> Column:
    """Keys sorted at every level, arrays kept, no spaces; null for invalid JSON and repeated keys."""
    return F.to_json(F.try_parse_json(text))


def content_hash(entity: str, schema_version: int, content: Column) -> Column:
    """SHA-256 of the canonical content (a struct) with entity and schemaVersion beside its keys."""
    body = F.to_json(content, {"ignoreNullFields": "false"})
    stamp = F.lit(f'"entity":"{entity}","schemaVersion":{schema_version}')
    joined = F.when(body == "{}", F.concat(F.lit("{"), stamp, F.lit("}"))).otherwise(
        F.concat(F.expr("'{'"), stamp, F.lit(","), F.substr(body, F.lit(2)))
    )
    return F.sha2(canonical_json(joined), 256)


def payload_hash(payload: Column) -> Column:
    """SHA-256 of the canonical payload; a null payload is the text null."""
    return F.sha2(F.coalesce(canonical_json(payload), F.lit("null")), 256)


def request_hash(**fields: Column) -> Column:
    """SHA-256 of named operation fields as one canonical object."""
    struct = F.struct(*[c.alias(n) for n, c in sorted(fields.items())])
    return F.sha2(canonical_json(F.to_json(struct, {"ignoreNullFields": "false"})), 256)
