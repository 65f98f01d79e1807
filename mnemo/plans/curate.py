"""Conversation logs to memory: segment, classify, tag, relate, store."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, functions as F

from mnemo.config import DEFAULT_RULES, Rules
from mnemo.functions import text as t
from mnemo.functions.scalars import to_ts
from mnemo.functions.vectors import HashedEmbedder, embed, identity_of
from mnemo.operators.audit import require_identity, side_by_side
from mnemo.operators.upsert import (
    concept_nodes, upsert_edges, upsert_knowledge, upsert_nodes,
)


def segment_rows(
    messages: DataFrame, order: Sequence[str], rules: Rules = DEFAULT_RULES
) -> DataFrame:
    """One row per segment with its class, axis tags and relations.

    ``messages`` has role, content, ts, source and the ``order`` columns, which
    together with the new ``seg`` number the segments. Narrow: no shuffle.
    """
    role = F.coalesce(F.nullif("role", F.lit("")), F.lit("unknown"))
    kept = messages.withColumn("role", role)
    if rules.skip_roles:
        kept = kept.filter(~F.col("role").isin(list(rules.skip_roles)))
    carry = [c for c in ("session_id", "project") if c in messages.columns]
    rows = kept.select(
        *dict.fromkeys([*order, "source", "role", "ts", *carry]),
        F.posexplode(t.segments(F.col("content"), rules)).alias("seg", "text"),
    )
    return tag_segments(rows, rules)


def tag_segments(rows: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Class, axes and relations of ``text``. Each step's column is computed once."""
    c, raw, low, kind = F.col("text"), F.col("_raw"), F.col("_low"), F.col("kind")
    out = t.once(rows, _raw=t.raw_tokens(c), _low=F.lower(c))
    # A filter on the class must not classify every segment twice.
    out = t.once(out, scores=t.class_scores(c, rules, raw, low))
    out = out.withColumn("kind", t.classify(F.col("scores"), rules))
    out = out.withColumn("expert_confidence", t.axis_scores(c, rules, raw, low, kind))
    out = out.withColumn("experts", t.active_axes(F.col("expert_confidence"), rules))
    # Relations belong to experience only; no regex runs on the rest.
    named = F.when(kind == "experience", t.entities(c)).otherwise(t.strings([]))
    out = out.withColumn("_entities", named)
    return out.withColumn("relations", t.triples(c, rules, F.col("_entities"))).drop(
        "_raw", "_low", "_entities"
    )


def dropped_chars(messages: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Characters that segmentation leaves out (short parts, short tails, white space)."""
    kept = F.aggregate(
        t.segments(F.col("content"), rules), F.lit(0), lambda n, s: n + F.length(s)
    )
    total = F.length(F.coalesce("content", F.lit("")))
    return messages.agg(F.sum((total - kept).cast("bigint")).alias("dropped_chars"))


def triple_rows(segments: DataFrame, order: Sequence[str]) -> DataFrame:
    return segments.filter(F.col("kind") == "experience").select(
        *order, "source", F.lit(None).cast("string").alias("project"),
        "experts", "expert_confidence", F.col("ts").alias("event_ts"),
        F.create_map(F.lit("role"), F.col("role")).alias("meta"),
        F.posexplode("relations").alias("pos", "triple"),
    ).select("*", "triple.*").drop("triple")


@dataclass
class Curated:
    knowledge: DataFrame
    skipped: DataFrame
    nodes: DataFrame
    edges: DataFrame
    segments: DataFrame
    #: Messages and segments, counted while the segments were written; empty if they were not.
    counted: dict[str, int] = field(default_factory=dict)


def curate(
    messages: DataFrame,
    order: Sequence[str],
    knowledge: DataFrame | None = None,
    nodes: DataFrame | None = None,
    edges: DataFrame | None = None,
    embedder=None,
    rules: Rules = DEFAULT_RULES,
    now=None,
    stage=None,
) -> Curated:
    """New knowledge rows, nodes and edges of a batch of messages.

    Pass ``stage`` (``sources.tables.stage``) on real data: segments then are
    written once, counted on the way, and all outputs read that copy. Fails if
    ``knowledge`` holds vectors of another space.
    """
    embedder = embedder or HashedEmbedder(rules)
    if knowledge is not None:
        require_identity(knowledge, identity_of(embedder))
    counted: dict[str, int] = {}
    if stage is None:
        segments = segment_rows(messages, order, rules)
    else:
        came, made = Observation("messages"), Observation("segments")
        messages = messages.observe(came, F.count(F.lit(1)).alias("messages"))
        segments = stage(segment_rows(messages, order, rules).observe(made, *_counters()), "segments")
        counted = came.get | made.get
    order = [*order, "seg"]
    facts = segments.filter(F.col("kind") == "knowledge").select(
        *order, "text", "source", to_ts(F.col("ts")).alias("ts"), F.col("ts").alias("ts_raw"),
        "experts", "expert_confidence", F.create_map(F.lit("role"), F.col("role")).alias("meta"),
    )
    inserted, skipped = upsert_knowledge(facts, knowledge, order, now)
    triples = triple_rows(segments, order)
    tripled = [*order, "pos"]
    experience = segments.filter(F.col("kind") == "experience")
    named = upsert_nodes(triples, nodes, tripled, now).unionByName(
        concept_nodes(experience, nodes, order, now, rules)
    )
    return Curated(
        knowledge=embed(inserted, "text", embedder),
        skipped=skipped,
        # The two kinds never share a key.
        nodes=named,
        edges=upsert_edges(triples, edges, tripled, now),
        segments=segments,
        counted=counted,
    )


def _counters() -> list[Column]:
    def n(kind: str):
        return F.count_if(F.col("kind") == kind)

    experience = F.col("kind") == "experience"
    return [
        F.count(F.lit(1)).alias("segments"),
        n("knowledge").alias("knowledge_segments"),
        n("experience").alias("experience_segments"),
        F.coalesce(F.sum(F.size("relations")), F.lit(0)).cast("bigint").alias("experience_edges"),
        F.count_if(experience & (F.size("relations") == 0)).alias("experience_nodes"),
        F.count_if(F.size("experts") > 0).alias("tagged_segments"),
    ]


def curate_counts(segments: DataFrame) -> DataFrame:
    """Segments per class and relations found, in one pass."""
    return segments.agg(*_counters())


def ingest_report(messages: DataFrame, rejects: DataFrame, result: Curated,
                  totals: dict[str, DataFrame]) -> DataFrame:
    """One row: what came in, what was made of it, and table totals after the write.

    Messages and segments are not read again if they were counted while they were written.
    """
    spark = messages.sparkSession
    known = [spark.range(1).select(*[F.lit(n).cast("bigint").alias(c) for c, n in result.counted.items()])]
    parts = [
        *(known if result.counted else [messages.agg(F.count("*").alias("messages")), curate_counts(result.segments)]),
        rejects.agg(F.count("*").alias("malformed_lines")),
        result.knowledge.agg(F.count("*").alias("knowledge_added")),
        result.skipped.agg(F.count("*").alias("knowledge_skipped")),
        *[df.agg(F.count("*").alias(f"{name}_total")) for name, df in totals.items()],
    ]
    return side_by_side(*parts)


__all__ = [
    "Curated", "curate", "curate_counts", "dropped_chars", "ingest_report",
    "segment_rows", "tag_segments", "triple_rows",
]
