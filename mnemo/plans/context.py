"""Prompts to rendered context: the simple digest and the tiered context pack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mnemo.config import DEFAULT_RULES, Rules
from mnemo.functions import text as t
from mnemo.functions.scalars import (
    budget_chars, digest_chars, recommend_agent, resolve_project, to_iso,
)
from mnemo.functions.vectors import HashedEmbedder, embed, identity_of
from mnemo.operators.predicates import Filters
from mnemo.operators.probe import Scope
from mnemo.operators.ranking import search_scored
from mnemo.plans.retrieve import apply_budget, memory_block, merge, retrieve

NOTHING_FOUND = "_no memory matched this prompt_"
PACK_VERSION = "2"  # shape of the pack: grows when its columns change


def _of_kind(items: Column, kind: str) -> Column:
    return F.filter(items, lambda i: i["kind"] == kind)


def _item_columns(packed: DataFrame) -> DataFrame:
    """Prompts without any item get an empty list, not a missing row."""
    return packed.withColumns({
        "candidates": F.coalesce("candidates", F.lit(0)),
        "dropped": F.coalesce("dropped", F.lit(0)),
        "items": F.coalesce("items", F.array()),
    })


def context_counts(items: str = "items") -> Column:
    c = F.col(items)
    return F.struct(
        F.size(_of_kind(c, "knowledge")).alias("knowledge"),
        F.size(_of_kind(c, "experience")).alias("experience"),
        F.col("dropped").alias("dropped_for_budget"),
        F.col("candidates").alias("candidates"),
    )


def build(
    prompts: DataFrame, knowledge: DataFrame, edges: DataFrame, embedder=None,
    docs: DataFrame | None = None, rules: Rules = DEFAULT_RULES,
) -> DataFrame:
    """One row per prompt: shortened prompt, memory block within budget, counts."""
    found = retrieve(prompts, knowledge, edges, embedder, docs, rules)
    packed = apply_budget(merge(found, rules), None, rules)
    base = found.routed.select("prompt_id", "text", "routing")
    out = _item_columns(base.join(packed, "prompt_id", "left"))
    out = out.withColumns({
        "prompt": t.truncate(F.col("text"), rules.user_char_limit),
        "memory_block": t.truncate(memory_block(F.col("items")), rules.memory_char_limit),
        "counts": context_counts(),
    })
    return out.select(
        "prompt_id", "prompt", (F.length("text") > F.length("prompt")).alias("prompt_truncated"),
        "counts", _of_kind(F.col("items"), "knowledge").alias("knowledge"),
        _of_kind(F.col("items"), "experience").alias("experience"),
        "memory_block", F.length("memory_block").alias("memory_block_chars"),
        F.length("prompt").alias("prompt_chars"), F.col("routing").alias("axis_routing"),
    )


def to_markdown(built: DataFrame, title: str = "Memory Digest", rules: Rules = DEFAULT_RULES) -> DataFrame:
    """(prompt_id, markdown) of ``build``'s rows."""
    body = t.strip("memory_block")
    budget = F.format_string(
        f"**Budget:** memory %d/{rules.memory_char_limit} chars | "
        f"prompt %d/{rules.user_char_limit} chars | knowledge %d | experience %d",
        "memory_block_chars", "prompt_chars", "counts.knowledge", "counts.experience",
    )
    dropped = F.col("counts.dropped_for_budget")
    note = F.when(dropped > 0, F.format_string(
        "\n\n_%d item(s) dropped to respect the memory budget._", dropped
    )).otherwise("")
    return built.select("prompt_id", F.concat(
        F.lit(f"## {title}\n\n**Prompt:** "), "prompt", F.lit("\n\n"), budget,
        F.lit("\n\n### Memory\n\n"), F.when(body == "", NOTHING_FOUND).otherwise(body),
        note, F.lit("\n"),
    ).alias("markdown"))


# -- tiered pack -------------------------------------------------------------------------
def _complete(knowledge: DataFrame) -> DataFrame:
    """Add the provenance columns a table may lack, as NULL."""
    kinds = {"source": "string", "source_type": "string", "source_id": "string", "ts": "timestamp",
             "status": "string", "project": "string", "confidence": "double"}
    return knowledge.withColumns({
        name: F.lit(None).cast(kind) for name, kind in kinds.items() if name not in knowledge.columns
    })


def structured(
    prompts: DataFrame, knowledge: DataFrame, kind: str, status: str, embedder,
    limit: int = 5,
) -> DataFrame:
    """Top memories of one type and status per prompt, strictly of its project."""
    knowledge = _complete(knowledge)
    payload = ["text", "source", "source_type", "source_id", "ts", "status", "confidence"]
    hits = search_scored(
        prompts, knowledge, int(embedder.dimensions),
        Filters(memory_type=kind, status=status), limit,
        identity_of(embedder) if "embed_identity" in knowledge.columns else None,
        Scope(project="strict"), payload,
    )
    entry = F.struct(
        "rank", F.col("memory_id").cast("string").alias("item_id"), "text",
        *payload[1:], "score",
    )
    return hits.groupBy("prompt_id").agg(F.array_sort(F.collect_list(entry)).alias(kind))


def _lines(title: str, entries: Column) -> Column:
    body = F.array_join(F.transform(entries, lambda e: F.concat(F.lit("- "), e["text"])), "\n")
    return F.when(F.size(entries) > 0, F.concat(F.lit(f"### {title}\n"), body, F.lit("\n\n"))).otherwise("")


def _tier0(rules: Rules) -> Column:
    who = rules.identity
    project = F.when(
        F.col("resolved_project").isNotNull(),
        F.concat(F.lit("- Active project: "), "resolved_project", F.lit("\n")),
    ).otherwise("")
    return F.concat(
        F.lit("### Tier 0 - Always Loaded\n"
              f"- Final authority: {who.final_authority}\n"
              f"- Approval policy: {who.approval_policy}\n"),
        project, F.lit("".join(f"- Rule: {r}\n" for r in who.operating_rules[:5]) + "\n"),
    )


def _tier0_record(rules: Rules) -> Column:
    """Tier 0 as data: what the digest's first section states."""
    who = rules.identity
    return F.struct(
        F.lit(who.final_authority).alias("final_authority"),
        F.lit(who.approval_policy).alias("approval_policy"),
        F.col("resolved_project").alias("active_project"),
        t.strings(list(who.operating_rules)).alias("operating_rules"),
    )


def _provenance(entry: Column, kind: str | None) -> Column:
    """One provenance record; ``entry`` is a merged item or a structured hit."""
    return F.struct(
        entry["item_id"].alias("memory_id"),
        (entry["kind"] if kind is None else F.lit(kind)).alias("type"),
        F.coalesce(entry["status"], F.lit("approved")).alias("status"),
        F.coalesce(F.nullif(entry["source_type"], F.lit("")), F.nullif(entry["source"], F.lit("")),
                   F.lit("conversation"))
        .alias("source_type"),
        F.coalesce(F.nullif(entry["source_id"], F.lit("")), entry["source"]).alias("source_id"),
        to_iso(entry["ts"]).alias("created_at"), entry["confidence"].alias("confidence"),
        entry["score"].alias("score"),
    )


def build_context(
    requests: DataFrame, knowledge: DataFrame, edges: DataFrame, embedder=None,
    docs: DataFrame | None = None, rules: Rules = DEFAULT_RULES, title: str = "Context Digest",
    stage=None,
) -> DataFrame:
    """The full pack per request: config first, then decisions, tasks and memory.

    ``requests`` is (prompt_id, text, project_hint, active_workspace,
    token_budget). Retrieval sees the request's project and global rows;
    decisions and tasks are strictly the project's own. Older conversations are
    not included and are left to search. ``stage`` as in ``retrieve``.
    """
    embedder = embedder or HashedEmbedder(rules)
    knowledge = _complete(knowledge)
    asked = requests.withColumns({
        "project": resolve_project(F.col("project_hint"), F.col("active_workspace"), rules),
        "budget_chars": budget_chars(F.col("token_budget"), rules),
    })
    if "embedding" not in asked.columns:
        asked = embed(asked, "text", embedder)
    asked = asked if stage is None else stage(asked, "asked")
    found = retrieve(asked, knowledge, edges, embedder, docs, rules, stage=stage)
    packed = apply_budget(merge(found, rules), asked, rules).drop("budget_chars")
    decisions = structured(asked, knowledge, "decision", "approved", embedder)
    tasks = structured(asked, knowledge, "task", "proposed", embedder)
    base = found.routed.select(
        "prompt_id", "text", F.col("project").alias("resolved_project"), "token_budget",
        "budget_chars", "routing",
    )
    out = base
    for part in (packed, decisions, tasks):
        out = out.join(part, "prompt_id", "left")
    out = _item_columns(out).withColumns({
        "decision": F.coalesce("decision", F.array()),
        "task": F.coalesce("task", F.array()),
    })
    block = t.strip(memory_block(F.col("items")))
    full = F.concat(
        F.lit(f"## {title}\n\n"), _tier0(rules),
        _lines("Approved Decisions", F.col("decision")), _lines("Open Tasks", F.col("task")),
        F.lit("### Tier 1 - Retrieved Memory\n"),
        F.when(block == "", NOTHING_FOUND).otherwise(block),
        F.lit("\n\n_Tier 2 (full conversations, historical detail) not injected; "
              "search memory on demand._\n"),
    )
    out = out.withColumn("_full", full).withColumn(
        "_cap", digest_chars(F.col("token_budget"), rules)
    )
    if found.lines is not None:
        used = found.lines.select("prompt_id", F.lit(True).alias("_fallback")).distinct()
        out = out.join(used, "prompt_id", "left")
    else:
        out = out.withColumn("_fallback", F.lit(None).cast("boolean"))
    warnings = F.array_compact(F.array(
        F.when(F.col("_fallback"), "graph_empty_used_line_search"),
        F.when(F.length("_full") > F.col("_cap"), "context_truncated_to_token_budget"),
    ))
    markdown = t.truncate(F.col("_full"), F.col("_cap"))
    relations = F.filter(
        F.transform(_of_kind(F.col("items"), "experience"), lambda i: i["relation"]),
        lambda r: r.isNotNull(),
    )
    return out.select(
        "prompt_id", "resolved_project",
        F.array_compact(F.array("resolved_project")).alias("active_projects"),
        _tier0_record(rules).alias("tier0"), F.lit(PACK_VERSION).alias("version"),
        markdown.alias("context_markdown"),
        F.length(markdown).alias("context_chars"),
        F.col("budget_chars").alias("memory_char_budget"),
        _of_kind(F.col("items"), "knowledge").alias("relevant_knowledge"),
        _of_kind(F.col("items"), "experience").alias("relevant_experiences"),
        F.col("decision").alias("relevant_decisions"), F.col("task").alias("open_tasks"),
        relations.alias("relations"),
        recommend_agent(F.col("text"), rules).alias("recommended_agent"),
        F.col("routing").alias("axis_routing"),
        F.struct(
            *context_counts_columns(),
            F.size("decision").alias("decisions"), F.size("task").alias("open_tasks"),
        ).alias("counts"),
        F.concat(
            F.transform("items", lambda i: _provenance(i, None)),
            F.transform("decision", lambda e: _provenance(e, "decision")),
            F.transform("task", lambda e: _provenance(e, "task")),
        ).alias("provenance"),
        warnings.alias("warnings"),
        F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in rules.identity.persona])).alias("persona")
        if rules.identity.persona else F.lit("{}").alias("persona"),
        identity_of(embedder).alias("identity"),
    )


def context_counts_columns() -> list[Column]:
    c = F.col("items")
    return [
        F.size(_of_kind(c, "knowledge")).alias("knowledge"),
        F.size(_of_kind(c, "experience")).alias("experience"),
        F.col("dropped").alias("dropped_for_budget"), F.col("candidates").alias("candidates"),
    ]


__all__ = ["build", "build_context", "context_counts", "structured", "to_markdown"]
