"""Project state and decision history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from mnemo.config import DEFAULT_RULES, Rules
from mnemo.operators.predicates import Filters, status_of, visible
from mnemo.operators.probe import Scope
from mnemo.operators.ranking import related, search_recent

# section, type, status (None: any that is not hidden)
SECTIONS = (
    ("approved_decisions", "decision", "approved"),
    ("unresolved_decisions", "decision", "proposed"),
    ("open_tasks", "task", "proposed"),
    ("recent_experiences", "experience", None),
)


def project_sections(knowledge: DataFrame, per_section: int = 10) -> DataFrame:
    """Newest rows per project and section, from one scan.

    The section limit is cut per task before the shuffle, so a project holding
    most of the table costs no more than any other.
    """
    section = None
    for name, kind, status in SECTIONS:
        match = (F.col("type") == kind) & (visible() if status is None else status_of() == status)
        section = F.when(match, name) if section is None else section.when(match, name)
    rows = knowledge.select("memory_id", "text", "type", "status", "project", "ts").withColumn(
        "section", section
    ).filter(F.col("section").isNotNull() & F.col("project").isNotNull())
    w = Window.partitionBy("project", "section").orderBy(
        F.col("ts").desc_nulls_last(), F.col("memory_id").desc()
    )
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_section)


def project_state(
    projects: DataFrame, knowledge: DataFrame, edges: DataFrame,
    rules: Rules = DEFAULT_RULES, per_section: int = 10,
) -> DataFrame:
    """One row per project: decisions, tasks, experiences, artefacts, status."""
    wanted = projects.select("project").distinct()
    rows = project_sections(
        knowledge.join(wanted, "project", "left_semi"), per_section
    )
    entry = F.struct("rank", "memory_id", "text", "status", F.col("ts").alias("created_at"))
    packed = rows.groupBy("project").agg(*[
        F.array_sort(F.collect_list(F.when(F.col("section") == name, entry))).alias(name)
        for name, _, _ in SECTIONS
    ])
    linked = related(
        wanted.select(F.col("project").alias("prompt_id"), F.col("project").alias("entity"),
                      "project"),
        edges, per_section, scope=Scope(project="strict"),
    )
    artefacts = linked.groupBy(F.col("prompt_id").alias("project")).agg(
        F.array_sort(F.collect_list(F.struct(
            "rank", "edge_id", "src_label", "rel", "dst_label"
        ))).alias("latest_artefacts")
    )
    out = wanted.join(packed, "project", "left").join(artefacts, "project", "left")
    out = out.withColumns({
        name: F.coalesce(name, F.array()) for name, _, _ in SECTIONS
    }).withColumn("latest_artefacts", F.coalesce("latest_artefacts", F.array()))
    active = (F.size("approved_decisions") > 0) | (F.size("open_tasks") > 0)
    return out.withColumn(
        "current_status", F.when(active, "active").otherwise("unknown")
    ).withColumn("related_agents", F.array(*[F.lit(n) for n, _ in rules.identity.roles])
                 .cast("array<string>"))


def decision_history(knowledge: DataFrame, project: str | None = None, limit: int = 20) -> DataFrame:
    """Approved decisions, newest first."""
    return search_recent(
        knowledge, Filters(memory_type="decision", status="approved", project=project), limit
    )
