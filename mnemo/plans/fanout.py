"""Outcome events to memory rows and edges."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from mnemo.config import DEFAULT_RULES, EXPERIENCE_TYPES, Rules
from mnemo.functions import text as t
from mnemo.functions.scalars import to_ts
from mnemo.functions.vectors import HashedEmbedder, embed, identity_of
from mnemo.operators.audit import require_identity
from mnemo.operators.upsert import upsert_edges, upsert_knowledge, upsert_nodes

SECTIONS = ("decisions", "lessons", "open_tasks", "summary")


def _gate(kind: Column) -> Column:
    """Which class a memory counts as for ``experience_only`` axes."""
    return F.when(kind.isin(EXPERIENCE_TYPES), "experience").otherwise("knowledge")


def _tags(df: DataFrame, text: str, kind: Column, rules: Rules) -> DataFrame:
    c = F.col(text)
    df = df.withColumns({"_raw": t.raw_tokens(c), "_low": F.lower(c)})
    df = df.withColumn(
        "expert_confidence", t.axis_scores(c, rules, F.col("_raw"), F.col("_low"), kind)
    )
    df = df.withColumn("experts", t.active_axes(F.col("expert_confidence"), rules))
    # A row without an active axis stores no confidences either.
    none = F.create_map().cast("map<string,double>")
    return df.withColumn(
        "expert_confidence",
        F.when(F.size("experts") > 0, F.col("expert_confidence")).otherwise(none),
    ).drop("_raw", "_low")


def memory_rows(events: DataFrame, order: Sequence[str], rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Decisions, lessons, tasks and the summary of each event as rows of one shape.

    All sections are built as one array and exploded once: a single scan and no
    union. Blank texts are left out.
    """
    def item(section: str, kind: str, text: Column, status: Column, project: Column) -> Column:
        return F.struct(
            F.lit(section).alias("section"), F.lit(kind).alias("type"),
            t.strip(F.coalesce(text, F.lit(""))).alias("text"), status.alias("status"),
            F.coalesce(F.nullif(project, F.lit("")), F.col("project")).alias("project"),
        )

    def listed(c: str) -> Column:
        return F.coalesce(F.col(c), F.array())

    status = F.lower(t.strip(F.coalesce("status", F.lit(""))))
    succeeded = F.when(status == "", "completed").otherwise(status) == "completed"
    items = F.concat(
        F.transform(listed("decisions"), lambda d: item(
            "decisions", "decision", d["text"],
            F.coalesce(F.nullif(F.lower(t.strip(d["status"])), F.lit("")), F.lit("proposed")),
            d["project"],
        )),
        F.transform(listed("lessons"), lambda x: item(
            "lessons", "knowledge", x["text"], F.lit("approved"), x["project"],
        )),
        F.transform(listed("open_tasks"), lambda x: item(
            "open_tasks", "task", x["title"],
            F.when(F.lower(t.strip(x["status"])) == "completed", "completed")
            .otherwise("proposed"),
            x["project"],
        )),
        F.array(item(
            "summary", "experience", F.col("result_summary"),
            F.when(succeeded, "approved").otherwise("rejected"), F.col("project"),
        )),
    )
    event_id = F.coalesce("event_id", F.lit(""))
    rows = events.select(
        *order, event_id.alias("source_id"),
        F.concat(F.lit("agent_event:"), F.when(event_id == "", "unknown").otherwise(event_id))
        .alias("source"),
        F.lit("agent_event").alias("source_type"),
        to_ts(F.col("timestamp")).alias("ts"), F.col("timestamp").alias("ts_raw"),
        F.create_map(F.lit("agent"), F.coalesce(F.nullif("agent", F.lit("")), F.lit("unknown")))
        .alias("meta"),
        F.posexplode(items).alias("item", "memory"),
    ).select("*", "memory.*").drop("memory").filter(F.length("text") > 0)
    return _tags(rows, "text", _gate(F.col("type")), rules)


def artefact_rows(events: DataFrame, order: Sequence[str], rules: Rules = DEFAULT_RULES) -> DataFrame:
    """(agent, produced, artefact) triples; the axis gate is open for them."""
    rows = events.select(
        *order, F.coalesce(F.nullif("agent", F.lit("")), F.lit("unknown")).alias("src"),
        F.lit("produced").alias("rel"), "project",
        F.lit("agent_event").alias("source"), F.lit("agent_event").alias("source_type"),
        F.lit("approved").alias("status"), F.col("timestamp").alias("event_ts"),
        F.col("event_id").alias("source_event"),
        F.posexplode(F.coalesce("artefacts", F.array())).alias("item", "artefact"),
    ).withColumn(
        "dst", t.strip(F.coalesce("artefact.path_or_ref", F.lit("")))
    ).filter(F.length("dst") > 0).withColumn(
        "meta",
        F.create_map(F.lit("kind"), F.coalesce(
            F.nullif(t.strip("artefact.kind"), F.lit("")), F.lit("file")
        )),
    ).drop("artefact")
    return _tags(rows, "dst", F.lit("experience"), rules)


@dataclass
class FannedOut:
    knowledge: DataFrame
    skipped: DataFrame
    nodes: DataFrame
    edges: DataFrame
    counts: DataFrame


def ingest_events(
    events: DataFrame,
    order: Sequence[str] = ("ord",),
    knowledge: DataFrame | None = None,
    nodes: DataFrame | None = None,
    edges: DataFrame | None = None,
    embedder=None,
    rules: Rules = DEFAULT_RULES,
    now=None,
    stage=None,
) -> FannedOut:
    """Memory rows, edges and per-event counts of a batch of events.

    The fingerprint is scoped to the event: replaying an event adds nothing,
    while the same sentence in two events is kept twice. Pass ``stage``
    (``sources.tables.stage``) on real data, so that all outputs share one
    reading of the events.
    """
    embedder = embedder or HashedEmbedder(rules)
    if knowledge is not None:
        require_identity(knowledge, identity_of(embedder))
    rows = memory_rows(events, order, rules)
    triples = artefact_rows(events, order, rules)
    if stage is not None:
        rows, triples = stage(rows, "memory"), stage(triples, "artefacts")
    inserted, skipped = upsert_knowledge(rows, knowledge, [*order, "item"], now)
    placed = [*order, "item"]
    return FannedOut(
        knowledge=embed(inserted, "text", embedder),
        skipped=skipped,
        nodes=upsert_nodes(triples, nodes, placed, now),
        edges=upsert_edges(triples, edges, placed, now),
        counts=event_counts(events, inserted, skipped, triples),
    )


def event_counts(
    events: DataFrame, inserted: DataFrame, skipped: DataFrame, triples: DataFrame
) -> DataFrame:
    """Per event: stored rows per section, artefacts, and refused duplicates.

    Each side is counted per event before the join, so only one row per event
    and side is shuffled on.
    """
    stored = inserted.groupBy(F.col("source_id").alias("event_id")).agg(
        *[F.count_if(F.col("section") == s).alias(s) for s in SECTIONS]
    )
    refused = skipped.groupBy(
        F.regexp_replace("source", "^agent_event:", "").alias("event_id")
    ).agg(F.count("*").alias("skipped_count"))
    made = triples.groupBy(F.col("source_event").alias("event_id")).agg(
        F.count("*").alias("artefacts")
    )
    out = events.select("event_id").distinct()
    for part in (stored, made, refused):
        out = out.join(part, "event_id", "left")
    return out.na.fill(0)
