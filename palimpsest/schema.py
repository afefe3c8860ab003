"""Table schemas. Times are milliseconds since 1970 as BIGINT; scores are DOUBLE."""

from __future__ import annotations

VERSIONS = (
    "rowid BIGINT, ns STRING, seqno BIGINT, tx_ms BIGINT, deleted BOOLEAN, key STRING, vector ARRAY<FLOAT>, "
    "text STRING, metadata STRING, created_at BIGINT, expires_at BIGINT, importance FLOAT, confidence FLOAT, "
    "valid_from BIGINT, valid_to BIGINT, provenance STRING"
)
EDGES = "from_id BIGINT, to_id BIGINT, kind SMALLINT, weight FLOAT, metadata STRING, seqno BIGINT, removed BOOLEAN"
ACCESS = "rowid BIGINT, at_ms BIGINT, delta BIGINT"
CLOSURES = "rowid BIGINT, seqno BIGINT, valid_to BIGINT"
FEEDBACK = "rowid BIGINT, query_id BIGINT"
NAMESPACES = "path STRING, seqno BIGINT, dropped BOOLEAN"

TABLES = {
    "versions": VERSIONS,
    "edges": EDGES,
    "access": ACCESS,
    "closures": CLOSURES,
    "feedback": FEEDBACK,
    "namespaces": NAMESPACES,
}

#: What a caller may write; all but `vector` may be null or missing.
RECORD = (
    "vector ARRAY<FLOAT>, key STRING, text STRING, metadata STRING, ttl_ms BIGINT, importance FLOAT, "
    "confidence FLOAT, valid_from BIGINT, valid_to BIGINT, provenance STRING"
)


def columns(schema: str) -> list[str]:
    return [part.strip().split(" ")[0] for part in schema.split(", ")]


def types(schema: str) -> dict[str, str]:
    return {name: kind for name, _, kind in (part.strip().partition(" ") for part in schema.split(", "))}
