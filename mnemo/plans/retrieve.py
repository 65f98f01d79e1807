"""Prompts to candidates: route, rank per axis and globally, blend, merge, budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mnemo.config import DEFAULT_RULES, Rules
from mnemo.functions import text as t
from mnemo.functions.scalars import round6
from mnemo.functions.vectors import HashedEmbedder, embed, identity_of
from mnemo.operators.audit import require_identity
from mnemo.operators.probe import GLOBAL_POOL, Scope
from mnemo.operators.ranking import (
    EDGE_PAYLOAD, KNOWLEDGE_PAYLOAD, graph_topk, line_search, vector_topk,
)

KNOWLEDGE_WEIGHT = 1.0
EXPERIENCE_WEIGHT = 0.9


def route(prompts: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Prompts with ``routing`` (active axis -> weight) and ``axes`` (strongest first).

    No axis at all is an answer too: retrieval then is global.
    """
    c = F.col("text")
    scored = prompts.withColumns({"_raw": t.raw_tokens(c), "_low": F.lower(c)})
    scored = scored.withColumn("_scores", t.axis_scores(c, rules, F.col("_raw"), F.col("_low")))
    scored = scored.withColumn("axes", t.active_axes(F.col("_scores"), rules))
    routing = F.map_filter("_scores", lambda k, v: F.array_contains("axes", k))
    return scored.withColumn("routing", routing).drop("_raw", "_low", "_scores")


def blend(hits: DataFrame, routed: DataFrame, key: str, k: int, boost: float) -> DataFrame:
    """Best score per (prompt, row) over all pools, with the axes that found it.

    Hits of an axis pool are lifted by 1 + boost * weight; those of the global
    pool count as they are. Cut at k per prompt.
    """
    weights = routed.select("prompt_id", "routing")
    lifted = hits.join(weights, "prompt_id").withColumn("_axis", F.nullif("pool", F.lit(GLOBAL_POOL)))
    weight = F.try_element_at("routing", F.coalesce("_axis", F.lit("")))
    score = F.when(F.col("_axis").isNull(), F.col("score")).otherwise(
        round6(F.col("score") * (1.0 + F.lit(float(boost)) * weight))
    )
    payload = [c for c in hits.columns if c not in ("prompt_id", key, "pool", "score", "rank")]
    best = lifted.withColumn("score", score).groupBy("prompt_id", key).agg(
        F.max("score").alias("score"),
        F.sort_array(F.collect_set("_axis")).alias("routed_by"),
        *[F.any_value(c).alias(c) for c in payload],
    )
    w = Window.partitionBy("prompt_id").orderBy(F.col("score").desc(), key)
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


class Retrieved:
    def __init__(self, routed: DataFrame, knowledge: DataFrame, experience: DataFrame,
                 lines: DataFrame | None):
        self.routed, self.knowledge, self.experience = routed, knowledge, experience
        self.lines = lines


def retrieve(
    prompts: DataFrame,
    knowledge: DataFrame,
    edges: DataFrame,
    embedder=None,
    docs: DataFrame | None = None,
    rules: Rules = DEFAULT_RULES,
    scope: str = "global",
    check: bool = True,
    stage=None,
) -> Retrieved:
    """Ranked knowledge and experience per prompt.

    ``prompts`` is (prompt_id, text) with an optional ``project`` and, if
    already known, ``embedding``. One scan per table ranks the global pool and
    every axis pool. The global pool is as deep as unrouted retrieval, so
    routing never loses recall. With ``docs`` a prompt without any edge is
    answered by a line search for its longest token. Pass ``stage``
    (``sources.tables.stage``) so that the routed prompts and the ranked edges, which
    several parts read, are computed once.
    """
    embedder = embedder or HashedEmbedder(rules)
    identity = identity_of(embedder)
    if check and "embed_identity" in knowledge.columns:
        require_identity(knowledge, identity)
    routed = route(prompts, rules)
    if "embedding" not in routed.columns:
        routed = embed(routed, "text", embedder)
    if stage is not None:
        routed = stage(routed, "routed")
    pools = Scope(project=scope if "project" in prompts.columns else "", axes=True)
    payload = [c for c in KNOWLEDGE_PAYLOAD if c in knowledge.columns]
    edge_payload = [c for c in EDGE_PAYLOAD if c in edges.columns]

    def pooled(hits: DataFrame, k: int) -> DataFrame:
        # Global and axis pools may have different depths.
        deep = F.when(F.col("pool") == GLOBAL_POOL, k).otherwise(rules.axis_top_k)
        return hits.filter(F.col("rank") <= deep)

    found = vector_topk(
        routed, knowledge, int(embedder.dimensions), max(rules.vector_top_k, rules.axis_top_k),
        rules.min_score, identity if "embed_identity" in knowledge.columns else None,
        scope=pools, payload=payload,
    )
    memories = blend(pooled(found, rules.vector_top_k), routed, "memory_id",
                     rules.vector_top_k, rules.axis_boost)
    linked = graph_topk(
        routed, edges, max(rules.graph_top_k, rules.axis_top_k), scope=pools,
        payload=edge_payload, rules=rules,
    )
    experience = blend(pooled(linked, rules.graph_top_k), routed, "edge_id",
                       rules.graph_top_k, rules.axis_boost)
    lines = None
    if stage is not None and docs is not None:
        experience = stage(experience, "experience")
    if docs is not None:
        lines = fallback_lines(routed.select("prompt_id", "text"), experience, docs, rules)
        lines = lines if stage is None else stage(lines, "lines")
    return Retrieved(routed, memories, experience, lines)


def fallback_lines(
    prompts: DataFrame, experience: DataFrame, docs: DataFrame, rules: Rules = DEFAULT_RULES
) -> DataFrame:
    """Document lines for the prompts the graph knows nothing about."""
    bare = prompts.join(experience.select("prompt_id").distinct(), "prompt_id", "left_anti")
    keyed = bare.select("prompt_id", t.primary_keyword(F.col("text"), rules).alias("keyword"))
    return line_search(keyed.filter("keyword != ''"), docs, k=rules.graph_top_k)


def merge(found: Retrieved, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """One ranked list per prompt: knowledge, experience, then document lines on equal scores.

    Ids and statuses stay with the items, for provenance.
    """
    def column(df: DataFrame, name: str, kind: str = "string") -> Column:
        c = F.col(name) if name in df.columns else F.lit(None)
        return c.cast(kind).alias(name)

    def items(df, section, kind, key, text, score, extra):
        return df.select(
            "prompt_id", F.lit(section).alias("section"), F.col("rank").alias("pos"),
            F.lit(kind).alias("kind"), F.col(key).cast("string").alias("item_id"),
            text.alias("text"), round6(score).alias("score"), *extra,
        )

    def provenance(df):
        return [column(df, "source"), column(df, "source_type"), column(df, "source_id"),
                column(df, "ts", "timestamp"), column(df, "status"), column(df, "project"),
                column(df, "confidence", "double")]

    none = F.lit(None).cast("struct<src:string,rel:string,dst:string>")
    k, e = found.knowledge, found.experience
    parts = [
        items(k, 0, "knowledge", "memory_id", F.col("text"), F.col("score") * KNOWLEDGE_WEIGHT,
              [*provenance(k), none.alias("relation")]),
        items(e, 1, "experience", "edge_id",
              t.edge_text(F.col("src_label"), F.col("rel"), F.col("dst_label")),
              F.col("score") * EXPERIENCE_WEIGHT,
              [*provenance(e), F.struct(
                  F.col("src_label").alias("src"), "rel", F.col("dst_label").alias("dst")
              ).alias("relation")]),
    ]
    if found.lines is not None:
        n = found.lines.withColumn("source", F.lit("line_search"))
        text = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("line").cast("string"),
                        F.lit("  "), F.col("snippet"))
        parts.append(items(n, 2, "experience", "doc_id", text, F.lit(0.0),
                           [*provenance(n), none.alias("relation")]))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    w = Window.partitionBy("prompt_id").orderBy(F.col("score").desc(), "section", "pos")
    return merged.withColumn("rank", F.row_number().over(w)).filter(
        F.col("rank") <= rules.merged_max_items
    )


def apply_budget(items: DataFrame, limits: DataFrame | None = None,
                 rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Fit each prompt's ranked items into its character budget.

    An item is taken whole if it fits; else it is clipped if 80 characters are
    left, which ends the list; else it is passed over and a smaller one may
    still fit. ``limits`` is (prompt_id, budget_chars). Lists are at most
    ``merged_max_items`` long, so the fold runs inside one row.
    """
    # Whatever travels with an item is kept; the rank leads, so the list sorts by it.
    carried = ["rank", *[c for c in items.columns if c not in ("prompt_id", "rank", "section", "pos")]]
    w_items = items.groupBy("prompt_id").agg(
        F.array_sort(F.collect_list(F.struct(*carried))).alias("items")
    )
    cap = F.lit(rules.memory_char_limit)
    if limits is not None:
        w_items = w_items.join(limits.select("prompt_id", "budget_chars"), "prompt_id", "left")
        limit = F.least(cap, F.greatest(F.lit(0), F.coalesce("budget_chars", cap)))
    else:
        limit = cap
    ready = w_items.withColumn("_limit", limit).withColumn("items", F.transform(
        "items", lambda i: i.withField("truncated", F.lit(False))
    ))
    kept_type = ready.schema["items"].dataType.simpleString()
    start = F.struct(
        F.array().cast(kept_type).alias("kept"), F.lit(0).alias("used"), F.lit(False).alias("full")
    )
    over = t.BULLET_OVERHEAD

    def step(acc: Column, item: Column) -> Column:
        size = F.length(item["text"]) + over
        room = F.col("_limit") - acc["used"]
        clipped = t.truncate(item["text"], room - over)
        cut = item.withField("text", clipped).withField("truncated", F.lit(True))
        return (
            F.when(acc["full"], acc)
            .when(size <= room, F.struct(
                F.concat(acc["kept"], F.array(item)).alias("kept"),
                (acc["used"] + size).alias("used"), F.lit(False).alias("full")))
            .when((room >= 80) & (room - over >= 40), F.struct(
                F.concat(acc["kept"], F.array(cut)).alias("kept"),
                (acc["used"] + F.length(clipped) + over).alias("used"),
                F.lit(True).alias("full")))
            .otherwise(acc)
        )

    folded = ready.withColumn("_fold", F.aggregate("items", start, step))
    return folded.select(
        "prompt_id", F.col("_fold.kept").alias("items"),
        F.size("items").alias("candidates"),
        (F.size("items") - F.size("_fold.kept")).alias("dropped"),
        F.col("_fold.used").alias("chars_used"), F.col("_limit").alias("budget_chars"),
    )


def memory_block(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda i: t.bullet(i["kind"], i["text"])), "")
