"""Ranked lookups: vectors, token overlap, related edges, document lines, search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from mnemo.config import DEFAULT_RULES, Rules
from mnemo.functions.scalars import to_iso
from mnemo.functions.text import edge_text, strip, token_set
from mnemo.operators.grams import holding
from mnemo.operators.kernels import cosine_kernel, every_row_kernel
from mnemo.operators.overlap import k_best, overlap, seen, with_payload
from mnemo.operators.predicates import Filters, clamp_limit, same_identity, tagged, visible
from mnemo.operators.probe import Scope, best_k
from mnemo.sources.tables import stage

KNOWLEDGE_PAYLOAD = ["text", "source", "source_type", "source_id", "ts", "type", "status",
                     "project", "confidence", "experts"]
EDGE_PAYLOAD = ["src_label", "rel", "dst_label", "source", "source_type", "status", "project",
                "event_ts", "experts"]


def _have(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [n for n in names if n in df.columns]


def _probe_columns(prompts: DataFrame, scope: Scope, extra: Sequence[str]) -> DataFrame:
    wanted = ["prompt_id", *extra]
    if scope.project:
        wanted.append("project")
    if scope.axes:
        wanted.append("axes")
    return prompts.select(*wanted)


def vector_topk(
    prompts: DataFrame,
    knowledge: DataFrame,
    dim: int,
    k: int = 5,
    min_score: float | None = 0.42,
    identity: Column | None = None,
    experts: str | Sequence[str] | None = None,
    scope: Scope = Scope(),
    payload: Sequence[str] = (),
    max_probes: int | None = None,
) -> DataFrame:
    """Exact cosine top-k of ``knowledge`` per prompt.

    Hidden rows and rows of another vector space are filtered in the scan.
    Result: prompt_id, pool, score, memory_id, payload…, rank.
    """
    rows = knowledge
    if "status" in rows.columns:
        rows = rows.filter(visible())
    if identity is not None:
        rows = rows.filter(same_identity(identity))
    if experts:
        rows = rows.filter(tagged(experts))
    need = ["project"] if scope.project else []
    need += ["experts"] if scope.axes else []
    # What the ranking reads travels with it; texts and the like are looked up for the winners.
    light = [c for c in payload if c in need]
    hits = best_k(
        _probe_columns(prompts, scope, ["embedding"]), rows.select("memory_id", "embedding", *need),
        cosine_kernel(dim, min_score), k, ["memory_id"], light, scope, max_probes=max_probes,
    )
    found = with_payload(hits, rows, "memory_id", payload)
    return found.select("prompt_id", "pool", "score", "memory_id", *[c for c in payload if c != "memory_id"], "rank")


def search_scored(
    prompts: DataFrame,
    knowledge: DataFrame,
    dim: int,
    filters: Filters = Filters(),
    limit: int | None = 20,
    identity: Column | None = None,
    scope: Scope = Scope(),
    payload: Sequence[str] = (),
) -> DataFrame:
    """Filtered search ranked by cosine, with no score floor.

    Rows of another vector space stay in the result without a score, after all
    scored rows. A prompt whose vector is missing or all zero asks for nothing in
    particular and gets the newest rows, then the highest ids, without scores.
    """
    comparable = F.lit(True) if identity is None else same_identity(identity)
    need = ["project"] if scope.project else []
    light = [c for c in payload if c in need]
    columns = ["memory_id", *need]
    rows = filters.apply(knowledge)
    asks = F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    scored = best_k(
        _probe_columns(prompts.filter(asks), scope, ["embedding"]),
        rows.select(*dict.fromkeys([*columns, "embedding"]), comparable.alias("comparable")),
        cosine_kernel(dim, None, keep_unscored=True), clamp_limit(limit), ["memory_id"],
        light, scope,
    )
    recent = best_k(
        _probe_columns(prompts.filter(~asks), scope, []),
        rows.select(*dict.fromkeys([*columns, *_have(rows, ["ts"])])), every_row_kernel(),
        clamp_limit(limit), [f"-{c}" for c in _have(rows, ["ts", "memory_id"])], light, scope,
    )
    found = with_payload(scored.unionByName(recent.select(*scored.columns)), rows, "memory_id", payload)
    return found.select("prompt_id", "pool", "score", "memory_id", *[c for c in payload if c != "memory_id"], "rank")


def search_recent(
    knowledge: DataFrame, filters: Filters = Filters(), limit: int | None = 20
) -> DataFrame:
    """Filtered search without a query: newest first, then highest id."""
    return (
        filters.apply(knowledge)
        .orderBy(F.col("ts").desc_nulls_last(), F.col("memory_id").desc())
        .limit(clamp_limit(limit))
    )


def with_edge_tokens(edges: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    text = edge_text(F.col("src_label"), F.col("rel"), F.col("dst_label"))
    return edges.withColumn("tokens", token_set(text, rules))


def graph_topk(
    prompts: DataFrame,
    edges: DataFrame,
    k: int = 5,
    experts: str | Sequence[str] | None = None,
    scope: Scope = Scope(),
    payload: Sequence[str] = (),
    rules: Rules = DEFAULT_RULES,
) -> DataFrame:
    """Edges per prompt by token overlap with the prompt's ``text``.

    Result: prompt_id, pool, score, edge_id, payload…, rank.
    """
    rows = edges.filter(visible()) if "status" in edges.columns else edges
    if experts:
        rows = rows.filter(tagged(experts))
    need = ["project"] if scope.project else []
    need += ["experts"] if scope.axes else []
    # Labels may be read off long texts, and the ranking reads the edges three times.
    rows = stage(with_edge_tokens(rows, rules).select(*dict.fromkeys(["edge_id", "tokens", *need, *payload])), "edges")
    tokens = rows.select("edge_id", "tokens", *need)
    probes = prompts.withColumn("tokens", token_set(F.col("text"), rules))
    hits = overlap(_probe_columns(probes, scope, ["tokens"]), tokens, "edge_id", scope)
    found = with_payload(k_best(hits, k, ["edge_id"]), rows, "edge_id", payload)
    return found.select("prompt_id", "pool", "score", "edge_id", *[c for c in payload if c != "edge_id"], "rank")


def related(
    entities: DataFrame,
    edges: DataFrame,
    k: int = 10,
    project: str | None = None,
    payload: Sequence[str] = tuple(EDGE_PAYLOAD),
    scope: Scope = Scope(),
) -> DataFrame:
    """First k edges with an end label containing the entity: oldest ``ingested_at``, then id.

    ``entities`` is (prompt_id, entity); blank entities match nothing. Edges of one batch
    share their time and come by id.
    """
    rows = edges.filter(visible()) if "status" in edges.columns else edges
    if project:
        rows = rows.filter(F.col("project") == project)
    payload = _have(rows, payload)
    order = _have(rows, ["ingested_at", "edge_id"])
    columns = [*order, "src_label", "dst_label", *(["project"] if scope.project else [])]
    probes = entities.select(
        "prompt_id", strip(F.col("entity")).alias("needle"),
        (F.col("project") if scope.project else F.lit(None)).alias("asked"),
    )
    hits = holding(probes, rows.select(*columns), ["src_label", "dst_label"])
    if scope.project:
        hits = hits.filter(seen(scope, F.col("asked"), F.col("project")))
    best = k_best(hits.select("prompt_id", *order), k, order, ["prompt_id"])
    found = with_payload(best, rows, "edge_id", payload)
    return found.select("prompt_id", *payload, *[c for c in ("edge_id",) if c not in payload], "rank")


def neighbors(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Every edge with ``label`` exactly at either end, whatever its status.

    Two equi-joins instead of one on an OR; an edge from a label to itself is
    taken once.
    """
    wanted = labels.select("label").distinct()
    out = edges.join(wanted, edges["src_label"] == wanted["label"])
    back = edges.filter(~F.col("src_label").eqNullSafe(F.col("dst_label")))
    return out.unionByName(back.join(wanted, back["dst_label"] == wanted["label"]))


def line_search(
    keywords: DataFrame, docs: DataFrame, per_doc: int = 20, k: int = 10, snippet: int = 200
) -> DataFrame:
    """First k lines, by document and line, that hold the keyword in any case.

    ``keywords`` is (prompt_id, keyword); at most ``per_doc`` lines count per
    document, which is a feature of the report.
    """
    probes = keywords.select("prompt_id", strip(F.col("keyword")).alias("needle"))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "body"))
    lines = lines.select("doc_id", (F.col("at") + 1).cast("long").alias("line"), "body")
    hits = holding(probes, lines, ["body"]).select(
        "prompt_id", "doc_id", "line", F.substring(strip(F.col("body")), 1, snippet).alias("snippet")
    )
    if per_doc < k:  # else the first k lines never hold more of one document
        hits = k_best(hits, per_doc, ["line"], ["prompt_id", "doc_id"])
    return k_best(hits, k, ["doc_id", "line"], ["prompt_id"])


def get_by_id(
    knowledge: DataFrame, ids: DataFrame, expected_type: str | None = None
) -> DataFrame:
    """Rows by id, whatever their status."""
    rows = knowledge if expected_type is None else knowledge.filter(F.col("type") == expected_type)
    return rows.join(ids.select("memory_id").distinct(), "memory_id", "left_semi")


def result_rows(hits: DataFrame) -> DataFrame:
    """Search hits in the shape handed to callers, with provenance as one struct."""
    score = F.col("score") if "score" in hits.columns else F.lit(None).cast("double")
    return hits.select(
        *_have(hits, ["prompt_id", "rank"]),
        "memory_id", "text", "type",
        F.coalesce("status", F.lit("approved")).alias("status"),
        "project", score.alias("score"), to_iso(F.col("ts")).alias("created_at"),
        F.struct(
            "source_type", "source_id", "source",
            to_iso(F.col("ts")).alias("created_at"), "confidence",
        ).alias("provenance"),
    )


__all__ = [
    "get_by_id", "graph_topk", "line_search", "neighbors", "related", "result_rows",
    "search_recent", "search_scored", "vector_topk", "with_edge_tokens",
]
