"""Table schemas and key expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import (
    ArrayType, DoubleType, FloatType, IntegerType, LongType, MapType,
    StringType, StructField, StructType, TimestampType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


STR, DBL, LONG, TS = StringType(), DoubleType(), LongType(), TimestampType()

MESSAGE = _struct(role=STR, content=STR, ts=STR)

IDENTITY = _struct(backend=STR, model=STR, dim=IntegerType())

KNOWLEDGE = _struct(
    memory_id=STR,
    text=STR,
    embedding=ArrayType(FloatType()),
    embed_identity=IDENTITY,
    source=STR,
    source_type=STR,
    source_id=STR,
    ts=TS,
    ts_raw=STR,
    type=STR,
    status=STR,
    project=STR,
    confidence=DBL,
    experts=ArrayType(STR),
    expert_confidence=MapType(STR, DBL),
    meta=MapType(STR, STR),
    updated_at=TS,
)

NODES = _struct(
    node_id=STR, label=STR, kind=STR, meta=MapType(STR, STR),
    status=STR, project=STR, ts=TS,
)

EDGES = _struct(
    edge_id=STR, src=STR, rel=STR, dst=STR,
    src_label=STR, dst_label=STR,
    source=STR, source_type=STR, status=STR, project=STR,
    experts=ArrayType(STR), expert_confidence=MapType(STR, DBL),
    meta=MapType(STR, STR), event_ts=STR, ingested_at=TS,
)

EVENT = StructType([
    StructField("event_id", STR),
    StructField("request_id", STR),
    StructField("session_id", STR),
    StructField("actor", STR),
    StructField("agent", STR),
    StructField("project", STR),
    StructField("prompt", STR),
    StructField("result_summary", STR),
    StructField("status", STR),
    StructField("timestamp", STR),
    StructField("decisions", ArrayType(_struct(text=STR, status=STR, project=STR))),
    StructField("lessons", ArrayType(_struct(text=STR, project=STR))),
    StructField("open_tasks", ArrayType(_struct(title=STR, status=STR, project=STR))),
    StructField("artefacts", ArrayType(_struct(path_or_ref=STR, kind=STR))),
    StructField("provenance", ArrayType(_struct(source_type=STR, source_id=STR, created_at=STR))),
])

ATTEMPT = _struct(
    event_id=STR, attempt=LONG, started_at=TS, outcome=STR, error=STR, finished_at=TS,
)


def fingerprint(source: Column, text: Column) -> Column:
    return F.concat(F.coalesce(source, F.lit("")), F.lit("::"), text)


def key_hash(*parts: Column) -> Column:
    """128-bit key over parts. Lengths go in, so no two part lists can run together."""
    sized = [F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]
    return F.md5(F.concat(*sized))


#: Hex digits of a key that name a folder of a table stored by key.
PREFIX_DIGITS = 2


def prefix(key: Column) -> Column:
    """Folder of a hashed key: one of 256, so a batch can name those it needs."""
    return F.substring(key, 1, PREFIX_DIGITS)
