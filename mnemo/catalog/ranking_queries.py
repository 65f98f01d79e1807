"""Vectors, search, graph and routed retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemo.catalog.base import (
    DATA_RULES, load, load_text, query, sql_active, sql_axis_columns, sql_list,
    sql_primary_keyword, sql_strip, sql_tokens,
)
from mnemo.catalog.frames import (
    MEMORIES_SQL, MERGED_SQL, RETRIEVAL_SQL, document_edges, embedded_documents, memories, prompts,
    sql_cosine, sql_hashed, sql_pooled,
)
from mnemo.catalog.text_queries import sql_truncate
from mnemo.functions import text as t
from mnemo.functions.scalars import to_iso
from mnemo.functions.vectors import HashedEmbedder, cosine, embed, embed_batch, identity_of, sparse
from mnemo.operators import predicates as p
from mnemo.operators.audit import identity_audit, mixed_identity, row_counts
from mnemo.operators.probe import Scope
from mnemo.operators.ranking import (
    get_by_id, graph_topk, line_search, neighbors, related, result_rows, search_recent, search_scored,
    vector_topk,
)
from mnemo.plans.context import NOTHING_FOUND, build, build_context, structured, to_markdown
from mnemo.plans.evaluate import (
    calibration, evaluation_report, recall_floor, retrieval_precision, routing_accuracy,
)
from mnemo.plans.projects import decision_history, project_sections, project_state
from mnemo.plans.reembed import reembed
from mnemo.plans.retrieve import apply_budget, merge, retrieve, route
from mnemo.sources.tables import all_entries, stage

# One probe per label: the mean of its vectors.
_CENTROID_SQL = """
cells AS (SELECT label, i, avg(v) AS a FROM (SELECT label, unnest(embedding)::DOUBLE AS v,
  unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY ALL),
probes AS (SELECT label AS prompt_id, list(a::FLOAT::DOUBLE ORDER BY i) AS v FROM cells GROUP BY ALL),
scores AS (SELECT prompt_id, vec_id AS memory_id, label,
  list_cosine_similarity(v, embedding::DOUBLE[]) AS raw_score FROM probes, embeddings)"""


def _dim(e):
    """The length that all vectors have."""
    sizes = e.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if sizes[0] != sizes[1]:
        raise ValueError(f"vectors of {sizes[0]} to {sizes[1]} entries")
    return sizes[0] or 0


def _centroids(e):
    mean = F.array(*[F.avg(F.col("embedding")[i]) for i in range(_dim(e))]).cast("array<float>")
    return e.groupBy("label").agg(mean.alias("embedding")).withColumnRenamed("label", "prompt_id")


def _vectors(spark, sf):
    return load(spark, sf, "embeddings").withColumnRenamed("vec_id", "memory_id")


@query("vector_topk", f"""
WITH {_CENTROID_SQL}
SELECT prompt_id, memory_id, round(raw_score, 6) AS score, row_number() OVER (
  PARTITION BY prompt_id ORDER BY round(raw_score, 6) DESC, memory_id) AS rank
FROM scores QUALIFY rank <= 5""")
def vector_top(spark, sf):
    e = _vectors(spark, sf)
    hits = vector_topk(_centroids(e), e, _dim(e), k=5, min_score=None)
    return hits.select("prompt_id", "memory_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("vector_topk_floor", f"""
WITH {_CENTROID_SQL}
SELECT prompt_id, memory_id, round(raw_score, 6) AS score, label, row_number() OVER (
  PARTITION BY prompt_id ORDER BY round(raw_score, 6) DESC, memory_id) AS rank
FROM scores WHERE raw_score >= 0.3 QUALIFY rank <= 50""")
def vector_top_floor(spark, sf):
    e = _vectors(spark, sf)
    hits = vector_topk(_centroids(e), e, _dim(e), k=50, min_score=0.3, payload=["label"])
    return hits.select(
        "prompt_id", "memory_id", "score", "label", F.col("rank").cast("bigint").alias("rank")
    )


@query("cosine", f"""
WITH {_CENTROID_SQL}
SELECT memory_id, round(raw_score, 5) AS score FROM scores WHERE prompt_id = label""")
def own_cosine(spark, sf):
    e = _vectors(spark, sf)
    own = _centroids(e).withColumnsRenamed({"prompt_id": "label", "embedding": "mean"})
    # Labels may be as uneven as they like: the means are one row per label.
    joined = e.join(own, "label")
    return joined.select("memory_id", F.round(cosine(F.col("embedding"), F.col("mean")), 5).alias("score"))


@query("calibration", f"""
WITH {_CENTROID_SQL},
r AS (SELECT 'top' AS pool, score FROM (SELECT round(raw_score, 6) AS score FROM scores
    QUALIFY row_number() OVER (PARTITION BY prompt_id ORDER BY round(raw_score, 6) DESC, memory_id) <= 20)
  UNION ALL SELECT 'background', round(raw_score, 6) FROM scores WHERE prompt_id = (label + 1) % 10)
SELECT pool, count(*) AS pairs, min(score) AS lowest, max(score) AS highest, quantile_disc(score, 0.05) AS p05,
  quantile_disc(score, 0.5) AS p50, quantile_disc(score, 0.95) AS p95 FROM r GROUP BY pool""")
def calibrate(spark, sf):
    """Best scores per label mean against those of every row with the next label's mean."""
    e = _vectors(spark, sf)
    means = _centroids(e)
    top = vector_topk(means, e, _dim(e), k=20, min_score=None)
    other = means.select(F.col("prompt_id").alias("next"), F.col("embedding").alias("mean"))
    background = e.withColumn("next", (F.col("label") + 1) % 10).join(other, "next")
    background = background.select(F.round(cosine(F.col("embedding"), F.col("mean")), 6).alias("score"))
    return calibration(top, background)


@query("identity_audit", """
SELECT count(*) AS total, count(*) FILTER (WHERE label < 5) AS matched,
  count(*) FILTER (WHERE label >= 5) AS mismatched FROM embeddings""")
def audit_identity(spark, sf):
    return identity_audit(_mixed(spark, sf), _identity("new"))


@query("mixed_identity", "SELECT count(DISTINCT label < 5) AS identities, count(DISTINCT label < 5) > 1 AS mixed FROM embeddings")
def mixed(spark, sf):
    return mixed_identity(_mixed(spark, sf))


def _identity(model):
    return F.struct(
        F.lit("given").alias("backend"), F.lit(model).alias("model"), F.lit(64).alias("dim")
    )


def _mixed(spark, sf):
    known = F.when(F.col("label") < 5, _identity("new")).otherwise(_identity("old"))
    return _vectors(spark, sf).withColumn("embed_identity", known)


@query("row_counts", """
SELECT (SELECT count(*) FROM documents) AS knowledge, (SELECT count(*) FROM customer) AS nodes,
  (SELECT count(*) FROM orders) AS edges""")
def counts(spark, sf):
    return row_counts(
        knowledge=load(spark, sf, "documents"), nodes=load(spark, sf, "customer"),
        edges=load(spark, sf, "orders"),
    )


# -- text vectors -----------------------------------------------------------------------------
@query("embed_hashed", f"""
WITH {sql_hashed('v', 'conversations_keyed', 'turn_id', 'text').replace('conversations_keyed',
    "(SELECT conv_id || ':' || turn AS turn_id, text FROM conversations)")}
SELECT turn_id, bucket, round(w, 5) AS weight FROM v""")
def embed_hashed(spark, sf):
    rows = load_text(spark, sf, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("turn_id"), "text"
    )
    made = sparse(embed(rows, "text", HashedEmbedder()), "turn_id")
    return made.select("turn_id", "bucket", F.round(F.col("weight").cast("double"), 5).alias("weight"))


@query("topk_text", f"""
WITH {sql_hashed('pv', 'benchmark', 'item_id', 'text')}, {sql_hashed('dv', 'documents', 'doc_id', 'text')},
{sql_cosine('pairs', 'pv', 'item_id', 'dv', 'doc_id')}
SELECT item_id AS prompt_id, doc_id AS memory_id, round(raw_score, 6) AS score, row_number() OVER (
  PARTITION BY item_id ORDER BY round(raw_score, 6) DESC, doc_id) AS rank
FROM pairs WHERE raw_score >= 0.1 QUALIFY rank <= 5""")
def topk_text(spark, sf):
    model = HashedEmbedder()
    docs = embed(load_text(spark, sf, "documents").withColumnRenamed("doc_id", "memory_id"), "text", model)
    hits = vector_topk(
        embed(prompts(spark, sf), "text", model), docs, model.dimensions, 5, 0.1, identity_of(model)
    )
    return hits.select("prompt_id", "memory_id", "score", F.col("rank").cast("bigint").alias("rank"))


_TAGS = sql_axis_columns("text", DATA_RULES, "gate")


@query("reembed", f"""
WITH {MEMORIES_SQL}, {sql_hashed('v', 'memories', 'memory_id', 'text', 64)},
g AS (SELECT *, CASE WHEN type IN ('decision', 'experience') THEN 'experience' ELSE 'knowledge' END AS gate FROM memories),
a AS (SELECT memory_id, {', '.join(f'{e} AS ax_{n}' for n, e in _TAGS.items())} FROM g)
SELECT memory_id, bucket, round(w, 5) AS weight, 'md5-64' AS model, array_to_string({sql_active(DATA_RULES)}, ',') AS experts
FROM v JOIN a USING (memory_id)""")
def reembedded(spark, sf):
    """Documents moved to a 64-bucket space, with tags recomputed."""
    new = reembed(memories(spark, sf), HashedEmbedder(DATA_RULES.with_(hash_dim=64)), DATA_RULES)
    rows = new.select(
        "memory_id", F.col("embed_identity.model").alias("model"), F.array_join("experts", ",").alias("experts"),
        F.posexplode("embedding").alias("bucket", "w"),
    )
    return rows.filter("w != 0").select(
        "memory_id", "bucket", F.round(F.col("w").cast("double"), 5).alias("weight"), "model", "experts"
    )


# -- predicates and search ------------------------------------------------------------------------
@query("predicates", f"""
WITH {MEMORIES_SQL}
SELECT memory_id, coalesce(status, 'approved') NOT IN ('superseded', 'rejected') AS visible,
  coalesce(status, 'approved') = 'approved' AS approved,
  coalesce(project = 'src3', false) AS strict,
  coalesce(project, '') IN ('src3', '') AS with_global,
  coalesce(list_contains(experts, 'Good') OR list_contains(experts, 'de'), false) AS tagged,
  coalesce(confidence, 1.0) >= 0.9 AS confident,
  coalesce(ts >= TIMESTAMP '2024-01-01 05:00:00', false) AS since,
  ts IS NULL OR ts <= TIMESTAMP '2024-01-01 05:00:00' AS until,
  contains(lower(text), 'the ') AS mentions FROM memories""")
def all_predicates(spark, sf):
    at = "2024-01-01T05:00:00Z"

    def flag(c):
        return F.coalesce(c, F.lit(False))

    return memories(spark, sf).select(
        "memory_id", p.visible().alias("visible"), p.has_status("approved").alias("approved"),
        flag(p.in_project("src3")).alias("strict"),
        p.in_project_or_global("src3").alias("with_global"),
        p.tagged(["GOOD", "de"]).alias("tagged"), p.min_confidence(0.9).alias("confident"),
        flag(p.since(at)).alias("since"), p.until(at).alias("until"),
        p.mentions("THE ").alias("mentions"),
    )


_VISIBLE = "coalesce(status, 'approved') NOT IN ('superseded', 'rejected')"


@query("search_recent", f"""
WITH {MEMORIES_SQL}
SELECT memory_id, type, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS created_at FROM memories WHERE {_VISIBLE}
ORDER BY ts DESC NULLS LAST, memory_id DESC LIMIT 200""")
def recent(spark, sf):
    hits = search_recent(memories(spark, sf), limit=500)
    return hits.select("memory_id", "type", to_iso(F.col("ts")).alias("created_at"))


@query("search_filtered", f"""
WITH {MEMORIES_SQL}
SELECT memory_id, text FROM memories WHERE coalesce(status, 'approved') = 'approved'
  AND type = 'decision' AND list_contains(experts, 'Good') AND coalesce(confidence, 1.0) >= 0.9
  AND contains(lower(text), 'the ') AND ts >= TIMESTAMP '2024-01-01 01:00:00'
ORDER BY ts DESC NULLS LAST, memory_id DESC LIMIT 20""")
def filtered(spark, sf):
    wanted = p.Filters(
        memory_type="decision", approved_only=True, experts="good", min_confidence=0.9,
        entity="The ", date_from="2024-01-01T01:00:00Z",
    )
    return search_recent(memories(spark, sf), wanted).select("memory_id", "text")


@query("decision_history", f"""
WITH {MEMORIES_SQL}
SELECT memory_id, project FROM memories WHERE type = 'decision' AND coalesce(status, 'approved') = 'approved'
ORDER BY ts DESC NULLS LAST, memory_id DESC LIMIT 20""")
def decisions(spark, sf):
    return decision_history(memories(spark, sf)).select("memory_id", "project")


@query("point_lookup", f"""
WITH {MEMORIES_SQL}
SELECT memory_id, type, status FROM memories
WHERE type = 'decision' AND memory_id IN (SELECT user_id FROM events)""")
def by_id(spark, sf):
    ids = load(spark, sf, "events").select(F.col("user_id").alias("memory_id"))
    return get_by_id(memories(spark, sf), ids, "decision").select("memory_id", "type", "status")


@query("search_scored", f"""
WITH {MEMORIES_SQL},
cand AS (SELECT * FROM memories WHERE {_VISIBLE} AND list_contains(experts, 'Good')),
{sql_hashed('pv', 'benchmark', 'item_id', 'text')}, {sql_hashed('kv', 'cand', 'memory_id', 'text')},
{sql_cosine('pairs', 'pv', 'item_id', 'kv', 'memory_id')},
every AS (SELECT item_id, memory_id, CASE WHEN type = 'experience' OR NOT has THEN NULL
    ELSE round(coalesce(raw_score, 0), 6) END AS score
  , CASE WHEN NOT has THEN ts END AS newest, CASE WHEN NOT has THEN memory_id END AS latest
  FROM (SELECT item_id, memory_id, type, ts, len({sql_tokens('b.text')}) > 0 AS has FROM
    (SELECT item_id, text FROM benchmark UNION ALL SELECT -1 - item_id, '' FROM benchmark) b, cand)
  LEFT JOIN pairs USING (item_id, memory_id))
SELECT item_id AS prompt_id, memory_id, score, row_number() OVER (PARTITION BY item_id ORDER BY
  score DESC NULLS LAST, newest DESC NULLS LAST, latest DESC, memory_id) AS rank FROM every QUALIFY rank <= 200""")
def scored(spark, sf):
    """Every prompt, and beside each a blank one, which asks for the newest rows."""
    model = HashedEmbedder()
    asked = prompts(spark, sf)
    blank = asked.withColumns({"prompt_id": -1 - F.col("prompt_id"), "text": F.lit("")})
    k = embed(memories(spark, sf), "text", model)
    other = F.struct(F.lit("x").alias("backend"), F.lit("y").alias("model"), F.lit(512).alias("dim"))
    k = k.withColumn(
        "embed_identity", F.when(F.col("type") == "experience", other).otherwise(F.col("embed_identity"))
    )
    hits = search_scored(
        embed(asked.unionByName(blank), "text", model), k, model.dimensions, p.Filters(experts="good"), 200,
        identity_of(model),
    )
    return hits.select("prompt_id", "memory_id", "score", F.col("rank").cast("bigint").alias("rank"))


_SECTION_SQL = f"""
WITH {MEMORIES_SQL}, cut AS (SELECT *, CASE
  WHEN type = 'decision' AND coalesce(status, 'approved') = 'approved' THEN 'approved_decisions'
  WHEN type = 'decision' AND coalesce(status, 'approved') = 'proposed' THEN 'unresolved_decisions'
  WHEN type = 'task' AND coalesce(status, 'approved') = 'proposed' THEN 'open_tasks'
  WHEN type = 'experience' AND {_VISIBLE} THEN 'recent_experiences' END AS section FROM
  (SELECT * REPLACE (source AS project) FROM memories)),
ranked AS (SELECT project, section, memory_id, row_number() OVER (PARTITION BY project, section
  ORDER BY ts DESC NULLS LAST, memory_id DESC) AS rank FROM cut WHERE section IS NOT NULL QUALIFY rank <= 10)"""


@query("project_sections", _SECTION_SQL + " SELECT * FROM ranked")
def sections(spark, sf):
    k = memories(spark, sf).withColumn("project", F.col("source"))
    return project_sections(k).select(
        "project", "section", "memory_id", F.col("rank").cast("bigint").alias("rank")
    )


def _ids(section):
    return f"coalesce(string_agg(memory_id, ',' ORDER BY rank) FILTER (WHERE section = '{section}'), '')"


@query("project_state", _SECTION_SQL + f""",
artefacts AS (SELECT source, string_agg(doc_id || '>' || lang, ',' ORDER BY doc_id) AS made FROM (SELECT * FROM documents
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 10) GROUP BY source)
SELECT p.project, {_ids('approved_decisions')} AS approved, {_ids('unresolved_decisions')} AS unresolved,
  {_ids('open_tasks')} AS tasks, {_ids('recent_experiences')} AS experiences, any_value(made) AS artefacts,
  CASE WHEN count(*) FILTER (WHERE section IN ('approved_decisions', 'open_tasks')) > 0
    THEN 'active' ELSE 'unknown' END AS current_status
FROM (SELECT DISTINCT source AS project FROM documents) p LEFT JOIN ranked USING (project)
LEFT JOIN artefacts a ON a.source = p.project GROUP BY p.project""")
def states(spark, sf):
    docs = load(spark, sf, "documents")
    edges = docs.select(
        F.col("doc_id").alias("edge_id"), F.col("source").alias("src_label"),
        F.lit("produced").alias("rel"), F.col("lang").alias("dst_label"),
        F.col("source").alias("project"),
    )
    k = memories(spark, sf).withColumn("project", F.col("source"))
    state = project_state(docs.select(F.col("source").alias("project")), k, edges)

    def ids(c, name):
        return F.array_join(F.transform(c, lambda e: e["memory_id"].cast("string")), ",").alias(name)

    made = F.transform("latest_artefacts", lambda e: F.concat_ws(">", e["edge_id"].cast("string"), e["dst_label"]))
    return state.select(
        "project", ids("approved_decisions", "approved"), ids("unresolved_decisions", "unresolved"),
        ids("open_tasks", "tasks"), ids("recent_experiences", "experiences"),
        F.array_join(made, ",").alias("artefacts"), "current_status",
    )


# -- graph ------------------------------------------------------------------------------------------
@query("graph_topk", f"""
WITH {RETRIEVAL_SQL}
SELECT prompt_id, edge_id, score, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, edge_id) AS rank
FROM linked QUALIFY rank <= 5""")
def graph_top(spark, sf):
    hits = graph_topk(
        prompts(spark, sf), document_edges(spark, sf), 5, scope=Scope(project="global"), rules=DATA_RULES
    )
    return hits.select("prompt_id", "edge_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("related", """
WITH words AS (SELECT DISTINCT unnest(regexp_split_to_array(o_orderpriority, '[- ]')) AS word FROM orders),
hits AS (SELECT word AS prompt_id, o_orderkey AS edge_id, o_orderdate FROM words
  JOIN (SELECT o_orderkey, o_orderdate, o_orderpriority AS src, c_mktsegment AS dst FROM orders
        JOIN customer ON o_custkey = c_custkey) e
  ON word <> '' AND (contains(lower(src), lower(word)) OR contains(lower(dst), lower(word))))
SELECT prompt_id, edge_id, row_number() OVER (PARTITION BY prompt_id ORDER BY o_orderdate, edge_id) AS rank
FROM hits QUALIFY rank <= 10""")
def related_edges(spark, sf):
    """Every word of the priorities against edges that arrived in order of date."""
    orders, customer = load(spark, sf, "orders"), load(spark, sf, "customer")
    edges = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select(
        F.col("o_orderkey").alias("edge_id"), F.col("o_orderpriority").alias("src_label"),
        F.lit("placed_by").alias("rel"), F.col("c_mktsegment").alias("dst_label"),
        F.col("o_orderdate").alias("ingested_at"),
    )
    words = orders.select(F.explode(F.split("o_orderpriority", "[- ]")).alias("entity")).distinct()
    entities = words.withColumn("prompt_id", F.col("entity"))
    return related(entities, edges).select("prompt_id", "edge_id", F.col("rank").cast("bigint").alias("rank"))


@query("neighbors", """
SELECT o_orderkey AS edge_id, o_orderpriority AS src_label, c_mktsegment AS dst_label
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderpriority IN ('1-URGENT') OR c_mktsegment IN ('BUILDING')""")
def neighbor_edges(spark, sf):
    orders, customer = load(spark, sf, "orders"), load(spark, sf, "customer")
    edges = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select(
        F.col("o_orderkey").alias("edge_id"), F.col("o_orderpriority").alias("src_label"),
        F.col("c_mktsegment").alias("dst_label"),
    )
    labels = spark.createDataFrame([("1-URGENT",), ("BUILDING",)], "label string")
    both = neighbors(labels, edges).select("edge_id", "src_label", "dst_label")
    return both.dropDuplicates(["edge_id"])


@query("line_search", f"""
WITH kw AS (SELECT item_id, {sql_primary_keyword('text')} AS keyword FROM benchmark),
lines AS (SELECT doc_id, generate_subscripts(l, 1) AS line, unnest(l) AS body FROM
  (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
hits AS (SELECT item_id AS prompt_id, doc_id, line, substring({sql_strip('body')}, 1, 200) AS snippet,
  row_number() OVER (PARTITION BY item_id, doc_id ORDER BY line) AS nth
  FROM kw JOIN lines ON keyword <> '' AND contains(lower(body), keyword))
SELECT prompt_id, doc_id, line, snippet, row_number() OVER (PARTITION BY prompt_id ORDER BY doc_id, line) AS rank
FROM hits WHERE nth <= 20 QUALIFY rank <= 10""")
def lines(spark, sf):
    keywords = prompts(spark, sf).select("prompt_id", t.primary_keyword(F.col("text")).alias("keyword"))
    hits = line_search(keywords, load_text(spark, sf, "documents"))
    return hits.select("prompt_id", "doc_id", "line", "snippet", F.col("rank").cast("bigint").alias("rank"))


# -- whole listings and result shapes -------------------------------------------------------------------
@query("all_entries", f"""
WITH {MEMORIES_SQL} SELECT memory_id, text, coalesce(nullif(status, ''), 'approved') AS status,
  coalesce(nullif(source_type, ''), 'conversation') AS source_type, coalesce(len(experts), 0)::INT AS n_experts
FROM memories""")
def every_entry(spark, sf):
    listed = all_entries(memories(spark, sf))
    return listed.select("memory_id", "text", "status", "source_type", F.size("experts").alias("n_experts"))


@query("result_rows", f"""
WITH {MEMORIES_SQL} SELECT memory_id, text, type, coalesce(status, 'approved') AS status, project, source, source_type,
  strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS created_at, confidence::DOUBLE AS confidence FROM memories
WHERE coalesce(status, 'approved') NOT IN ('superseded', 'rejected')
ORDER BY ts DESC NULLS LAST, memory_id DESC LIMIT 200""")
def shaped(spark, sf):
    """The newest hits in the shape handed to callers; 200 is the largest page."""
    table = memories(spark, sf).withColumn("source_id", F.lit(None).cast("string"))
    rows = result_rows(search_recent(table, p.Filters(), 200))
    return rows.select(
        "memory_id", "text", "type", "status", "project", "provenance.source", "provenance.source_type",
        "created_at", "provenance.confidence",
    )


@query("embed_batch", f"""
WITH {sql_hashed('bv', 'benchmark', 'item_id', 'text')}
SELECT item_id, i::INT AS index, CASE i WHEN 0 THEN coalesce(n, 0) ELSE 0 END AS buckets,
  CASE i WHEN 0 THEN coalesce(total, 0) ELSE 0 END AS weighted
FROM benchmark CROSS JOIN (SELECT unnest([0, 1]) AS i)
LEFT JOIN (SELECT item_id, count(*) AS n, round(sum(w * (bucket + 1)), 2) AS total FROM bv GROUP BY item_id) USING (item_id)""")
def embedded_lists(spark, sf):
    """Every prompt and an empty text as one list: vectors by place, none lost."""
    asked = load(spark, sf, "benchmark").select("item_id", F.array("text", F.lit("")).alias("input"))
    made = embed_batch(asked, "input", HashedEmbedder(DATA_RULES))
    total = F.aggregate(
        F.transform("embedding", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x
    )
    return made.select(
        "item_id", F.col("index").cast("int").alias("index"),
        F.size(F.filter("embedding", lambda x: x != 0)).cast("bigint").alias("buckets"),
        F.round(total, 2).alias("weighted"),
    )


# -- routed retrieval -----------------------------------------------------------------------------------
@query("route", f"""
WITH {RETRIEVAL_SQL}
SELECT prompt_id, array_to_string(axes, ',') AS axes, {', '.join(
    f"CASE WHEN list_contains(axes, '{a.name}') THEN ax_{a.name} END AS {a.name}" for a in DATA_RULES.axes)}
FROM routed""")
def routes(spark, sf):
    routed = route(prompts(spark, sf), DATA_RULES)
    return routed.select(
        "prompt_id", F.array_join("axes", ",").alias("axes"),
        *[F.try_element_at("routing", F.lit(a.name)).alias(a.name) for a in DATA_RULES.axes],
    )


def _retrieved(spark, sf):
    return retrieve(
        prompts(spark, sf), embedded_documents(spark, sf), document_edges(spark, sf),
        HashedEmbedder(DATA_RULES), rules=DATA_RULES, check=False,
    )


@query("routed_retrieve", f"""
WITH {RETRIEVAL_SQL}, {sql_pooled('know', 'seen', 'memory_id')}
SELECT prompt_id, memory_id, score, routed_by, rank FROM know""")
def routed_knowledge(spark, sf):
    hits = _retrieved(spark, sf).knowledge
    return hits.select(
        "prompt_id", "memory_id", "score", F.array_join("routed_by", ",").alias("routed_by"),
        F.col("rank").cast("bigint").alias("rank"),
    )


@query("routed_experience", f"""
WITH {RETRIEVAL_SQL}, {sql_pooled('exper', 'linked', 'edge_id')}
SELECT prompt_id, edge_id, score, routed_by, rank FROM exper""")
def routed_edges(spark, sf):
    hits = _retrieved(spark, sf).experience
    return hits.select(
        "prompt_id", "edge_id", "score", F.array_join("routed_by", ",").alias("routed_by"),
        F.col("rank").cast("bigint").alias("rank"),
    )


@query("merge", f"""
WITH {RETRIEVAL_SQL}, {MERGED_SQL}
SELECT prompt_id, kind, item_id::VARCHAR AS item_id, score, rank FROM merged""")
def merged(spark, sf):
    return merge(_retrieved(spark, sf), DATA_RULES).select(
        "prompt_id", "kind", "item_id", "score", F.col("rank").cast("bigint").alias("rank")
    )


_CLIP = sql_truncate("text", "(2200 - used - 7)")
_FOLD_SQL = f"""
fold AS (
  SELECT prompt_id, 0::BIGINT AS rank, 0::BIGINT AS used, false AS closed, 'start' AS act, '' AS body,
    '' AS kind FROM prompts
  UNION ALL
  SELECT prompt_id, rank, CASE act WHEN 'keep' THEN used + length(text) + 7
      WHEN 'clip' THEN used + length(clipped) + 7 ELSE used END,
    closed OR act = 'clip', act, CASE act WHEN 'keep' THEN text WHEN 'clip' THEN clipped END, kind
  FROM (SELECT f.prompt_id, m.rank, f.used, f.closed, m.text, m.kind, {_CLIP} AS clipped,
      CASE WHEN closed THEN 'skip' WHEN length(text) + 7 <= 2200 - used THEN 'keep'
           WHEN 2200 - used >= 80 AND 2200 - used - 7 >= 40 THEN 'clip' ELSE 'skip' END AS act
    FROM fold f JOIN merged m ON m.prompt_id = f.prompt_id AND m.rank = f.rank + 1))"""


@query("apply_budget", f"""
WITH RECURSIVE {RETRIEVAL_SQL}, {MERGED_SQL}, {_FOLD_SQL}
SELECT prompt_id, rank, kind, act = 'clip' AS truncated, body AS text FROM fold WHERE act IN ('keep', 'clip')""")
def budgeted(spark, sf):
    packed = apply_budget(merge(_retrieved(spark, sf), DATA_RULES), rules=DATA_RULES)
    items = packed.select("prompt_id", F.explode("items").alias("i"))
    return items.select(
        "prompt_id", F.col("i.rank").cast("bigint").alias("rank"), "i.kind", "i.truncated", "i.text"
    )


@query("context_build", f"""
WITH RECURSIVE {RETRIEVAL_SQL}, {MERGED_SQL}, {_FOLD_SQL},
b AS (SELECT prompt_id, string_agg('- [' || upper(kind[1]) || '] ' || body || chr(10), '' ORDER BY rank) AS block,
  count(*) FILTER (WHERE kind = 'knowledge') AS knowledge, count(*) FILTER (WHERE kind = 'experience') AS experience
  FROM fold WHERE act IN ('keep', 'clip') GROUP BY prompt_id),
c AS (SELECT prompt_id, count(*) AS candidates FROM merged GROUP BY prompt_id)
SELECT prompt_id, {sql_truncate('text', '1375')} AS prompt, coalesce(block, '') AS memory_block,
  coalesce(knowledge, 0)::INT AS knowledge, coalesce(experience, 0)::INT AS experience,
  coalesce(candidates, 0)::INT AS candidates,
  (coalesce(candidates, 0) - coalesce(knowledge, 0) - coalesce(experience, 0))::INT AS dropped
FROM prompts LEFT JOIN b USING (prompt_id) LEFT JOIN c USING (prompt_id)""")
def context_build(spark, sf):
    built = build(
        prompts(spark, sf), embedded_documents(spark, sf), document_edges(spark, sf),
        HashedEmbedder(DATA_RULES), rules=DATA_RULES,
    )
    return built.select(
        "prompt_id", "prompt", "memory_block", "counts.knowledge", "counts.experience",
        "counts.candidates", F.col("counts.dropped_for_budget").alias("dropped"),
    )


@query("structured_memory", f"""
WITH {MEMORIES_SQL},
cand AS (SELECT * FROM memories WHERE (type = 'decision' AND coalesce(status, 'approved') = 'approved')
  OR (type = 'task' AND coalesce(status, 'approved') = 'proposed')),
{sql_hashed('pv', 'benchmark', 'item_id', 'text')}, {sql_hashed('kv', 'cand', 'memory_id', 'text')},
{sql_cosine('pairs', 'pv', 'item_id', 'kv', 'memory_id')}
SELECT b.item_id AS prompt_id, type, memory_id, round(coalesce(raw_score, 0), 6) AS score, row_number() OVER (
  PARTITION BY b.item_id, type ORDER BY round(coalesce(raw_score, 0), 6) DESC, memory_id) AS rank
FROM benchmark b JOIN cand c ON length(b.text) <= 200 OR c.project = 'src3'
LEFT JOIN pairs USING (item_id, memory_id) QUALIFY rank <= 5""")
def structured_memory(spark, sf):
    """Decisions and tasks of a context pack: by type, status and strict project, ranked by cosine."""
    model = HashedEmbedder(DATA_RULES)
    k = embed(memories(spark, sf), "text", model)
    asked = embed(prompts(spark, sf), "text", model)
    parts = []
    for kind, status in (("decision", "approved"), ("task", "proposed")):
        packed = structured(asked, k, kind, status, model)
        parts.append(packed.select("prompt_id", F.lit(kind).alias("type"), F.explode(kind).alias("h")).select(
            "prompt_id", "type", F.col("h.item_id").cast("bigint").alias("memory_id"), "h.score",
            F.col("h.rank").cast("bigint").alias("rank"),
        ))
    return parts[0].unionByName(parts[1])


@query("context_digest", f"""
WITH RECURSIVE {RETRIEVAL_SQL}, {MERGED_SQL}, {_FOLD_SQL},
b AS (SELECT prompt_id, string_agg('- [' || upper(kind[1]) || '] ' || body || chr(10), '' ORDER BY rank) AS block,
  count(*) FILTER (WHERE kind = 'knowledge') AS k, count(*) FILTER (WHERE kind = 'experience') AS e
  FROM fold WHERE act IN ('keep', 'clip') GROUP BY prompt_id),
c AS (SELECT prompt_id, count(*) AS n FROM merged GROUP BY prompt_id),
d AS (SELECT prompt_id, {sql_truncate('text', '1375')} AS prompt, coalesce(block, '') AS block, coalesce(k, 0) AS k,
  coalesce(e, 0) AS e, coalesce(n, 0) AS n FROM prompts LEFT JOIN b USING (prompt_id) LEFT JOIN c USING (prompt_id))
SELECT prompt_id, '## Memory Digest' || chr(10) || chr(10) || '**Prompt:** ' || prompt || chr(10) || chr(10)
  || '**Budget:** memory ' || length(block) || '/2200 chars | prompt ' || length(prompt) || '/1375 chars | knowledge '
  || k || ' | experience ' || e || chr(10) || chr(10) || '### Memory' || chr(10) || chr(10)
  || CASE WHEN {sql_strip('block')} = '' THEN '{NOTHING_FOUND}' ELSE {sql_strip('block')} END
  || CASE WHEN n > k + e THEN chr(10) || chr(10) || '_' || (n - k - e)
     || ' item(s) dropped to respect the memory budget._' ELSE '' END || chr(10) AS markdown FROM d""")
def context_digest(spark, sf):
    """The simple digest, rendered."""
    return to_markdown(build(
        prompts(spark, sf), embedded_documents(spark, sf), document_edges(spark, sf),
        HashedEmbedder(DATA_RULES), rules=DATA_RULES,
    ), rules=DATA_RULES)


# -- the tiered pack: memories with status and type, edges, lines where no edge matches ------------------
_WHO = DATA_RULES.identity
_AGENT_HITS = [
    f"len(list_intersect(list_distinct({sql_tokens('text')}), {sql_list(r.keywords)}))" for r in _WHO.agent_routes
]
_PACK_SQL = f"""
{RETRIEVAL_SQL}, {MEMORIES_SQL},
asked AS (SELECT *, CASE WHEN length(text) > 250 THEN 1600 ELSE 2200 END AS lim,
  CASE WHEN length(text) > 250 THEN 1600 ELSE 4775 END AS cap,
  CASE WHEN greatest({_AGENT_HITS[0]}, {_AGENT_HITS[1]}) = 0 THEN '{_WHO.default_agent}'
    WHEN {_AGENT_HITS[0]} >= {_AGENT_HITS[1]} THEN '{_WHO.agent_routes[0].agent}'
    ELSE '{_WHO.agent_routes[1].agent}' END AS agent FROM prompts),
kseen AS (SELECT prompt_id, memory_id, round(raw_score, 6) AS score, p.axes, m.experts
  FROM pairs JOIN routed p USING (prompt_id) JOIN memories m USING (memory_id)
  WHERE raw_score >= {DATA_RULES.min_score} AND coalesce(m.status, 'approved') NOT IN ('superseded', 'rejected')
    AND (p.project IS NULL OR coalesce(m.project, '') IN (p.project, ''))),
{sql_pooled('know', 'kseen', 'memory_id')}, {sql_pooled('exper', 'linked', 'edge_id')},
bare AS (SELECT prompt_id, {sql_primary_keyword('text', DATA_RULES)} AS keyword FROM prompts
  WHERE prompt_id NOT IN (SELECT prompt_id FROM exper)),
body AS (SELECT doc_id, generate_subscripts(l, 1) AS line, unnest(l) AS body FROM
  (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
found AS (SELECT prompt_id, doc_id, line, substring({sql_strip('body')}, 1, 200) AS snippet,
  row_number() OVER (PARTITION BY prompt_id, doc_id ORDER BY line) AS nth
  FROM bare JOIN body ON keyword <> '' AND contains(lower(body), keyword)),
lines AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY doc_id, line) AS rank FROM found
  WHERE nth <= 20 QUALIFY rank <= 5),
merged AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, section, pos) AS rank FROM (
  SELECT prompt_id, 0 AS section, rank AS pos, 'knowledge' AS kind, memory_id AS item_id, text,
    round(score * 1.0, 6) AS score, coalesce(status, 'approved') AS status, coalesce(source_type, source) AS source_type,
    source AS source_id, ts, confidence, NULL AS relation FROM know JOIN memories USING (memory_id)
  UNION ALL SELECT prompt_id, 1, rank, 'experience', edge_id, src || ' ' || rel || ' ' || dst,
    printf('%.6f', score * 0.9::DOUBLE)::DOUBLE, 'approved', 'conversation', NULL, NULL, NULL,
    src || '>' || rel || '>' || dst FROM exper JOIN edges USING (edge_id)
  UNION ALL SELECT prompt_id, 2, rank, 'experience', doc_id, doc_id || ':' || line || '  ' || snippet, 0.0, 'approved',
    'line_search', 'line_search', NULL, NULL, NULL FROM lines) QUALIFY rank <= 12),
fold AS (
  SELECT prompt_id, 0::BIGINT AS rank, 0::BIGINT AS used, false AS closed, 'start' AS act, '' AS body FROM prompts
  UNION ALL
  SELECT prompt_id, rank, CASE act WHEN 'keep' THEN used + length(text) + 7
      WHEN 'clip' THEN used + length(clipped) + 7 ELSE used END,
    closed OR act = 'clip', act, CASE act WHEN 'keep' THEN text WHEN 'clip' THEN clipped END
  FROM (SELECT f.prompt_id, m.rank, f.used, f.closed, m.text, {sql_truncate("m.text", "(lim - used - 7)")} AS clipped,
      CASE WHEN closed THEN 'skip' WHEN length(m.text) + 7 <= lim - used THEN 'keep'
           WHEN lim - used >= 80 AND lim - used - 7 >= 40 THEN 'clip' ELSE 'skip' END AS act
    FROM fold f JOIN merged m ON m.prompt_id = f.prompt_id AND m.rank = f.rank + 1
    JOIN asked a ON a.prompt_id = f.prompt_id)),
kept AS (SELECT * EXCLUDE (text), f.body AS text FROM merged m JOIN (SELECT prompt_id, rank, body FROM fold
  WHERE act IN ('keep', 'clip')) f USING (prompt_id, rank)),
structured AS (SELECT p.prompt_id, m.type, m.memory_id, m.text, round(coalesce(raw_score, 0), 6) AS score,
    coalesce(m.status, 'approved') AS status, coalesce(source_type, source) AS source_type, source AS source_id, ts,
    confidence, row_number() OVER (PARTITION BY p.prompt_id, m.type
      ORDER BY round(coalesce(raw_score, 0), 6) DESC, m.memory_id) AS rank
  FROM prompts p JOIN memories m ON (p.project IS NULL OR m.project = p.project) AND (
    (m.type = 'decision' AND coalesce(m.status, 'approved') = 'approved') OR (m.type = 'task' AND m.status = 'proposed'))
  LEFT JOIN pairs x ON x.prompt_id = p.prompt_id AND x.memory_id = m.memory_id QUALIFY rank <= 5),
records AS (SELECT prompt_id, 0 AS part, rank, item_id, kind AS type, status, source_type, source_id, ts, confidence,
    score FROM kept
  UNION ALL SELECT prompt_id, CASE type WHEN 'decision' THEN 1 ELSE 2 END, rank, memory_id, type, status, source_type,
    source_id, ts, confidence, score FROM structured),
prov AS (SELECT prompt_id, string_agg(concat_ws('|', item_id, type, status, source_type, coalesce(source_id, '-'),
    coalesce(strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), '-'), coalesce(printf('%.2f', confidence::DOUBLE), '-'),
    printf('%.6f', score::DOUBLE)), chr(10) ORDER BY part, rank) AS provenance FROM records GROUP BY prompt_id),
s AS (SELECT prompt_id, count(*) FILTER (WHERE type = 'decision') AS decisions,
    count(*) FILTER (WHERE type = 'task') AS open_tasks,
    string_agg('- ' || text, chr(10) ORDER BY rank) FILTER (WHERE type = 'decision') AS decided,
    string_agg('- ' || text, chr(10) ORDER BY rank) FILTER (WHERE type = 'task') AS todo FROM structured GROUP BY prompt_id),
k AS (SELECT prompt_id, string_agg('- [' || upper(kind[1]) || '] ' || text || chr(10), '' ORDER BY rank) AS block,
    count(*) FILTER (WHERE kind = 'knowledge') AS knowledge, count(*) FILTER (WHERE kind = 'experience') AS experience,
    string_agg(relation, ',' ORDER BY rank) AS relations FROM kept GROUP BY prompt_id),
c AS (SELECT prompt_id, count(*) AS candidates FROM merged GROUP BY prompt_id),
whole AS (SELECT a.*, prov.provenance, s.decisions, s.open_tasks, k.knowledge, k.experience, k.relations, c.candidates,
    a.prompt_id IN (SELECT prompt_id FROM lines) AS fallback,
    '## Context Digest' || chr(10) || chr(10) || '### Tier 0 - Always Loaded' || chr(10) ||
    '- Final authority: {_WHO.final_authority}' || chr(10) || '- Approval policy: {_WHO.approval_policy}' || chr(10) ||
    coalesce('- Active project: ' || project || chr(10), '') || chr(10) ||
    coalesce('### Approved Decisions' || chr(10) || decided || chr(10) || chr(10), '') ||
    coalesce('### Open Tasks' || chr(10) || todo || chr(10) || chr(10), '') ||
    '### Tier 1 - Retrieved Memory' || chr(10) ||
    coalesce(nullif({sql_strip("coalesce(block, '')")}, ''), '{NOTHING_FOUND}') || chr(10) || chr(10) ||
    '_Tier 2 (full conversations, historical detail) not injected; search memory on demand._' || chr(10) AS md
  FROM asked a LEFT JOIN prov USING (prompt_id) LEFT JOIN s USING (prompt_id) LEFT JOIN k USING (prompt_id)
  LEFT JOIN c USING (prompt_id))"""


@query("context_pack", f"""
WITH RECURSIVE {_PACK_SQL}
SELECT prompt_id, {sql_truncate('md', 'cap')} AS context_markdown, lim AS memory_char_budget,
  coalesce(knowledge, 0)::INT AS knowledge, coalesce(experience, 0)::INT AS experience,
  (coalesce(candidates, 0) - coalesce(knowledge, 0) - coalesce(experience, 0))::INT AS dropped_for_budget,
  coalesce(candidates, 0)::INT AS candidates, coalesce(decisions, 0)::INT AS decisions,
  coalesce(open_tasks, 0)::INT AS open_tasks, coalesce(provenance, '') AS provenance,
  coalesce(relations, '') AS relations, agent AS recommended_agent, coalesce(project, '') AS active_projects,
  concat_ws(',', CASE WHEN fallback THEN 'graph_empty_used_line_search' END,
    CASE WHEN length(md) > cap THEN 'context_truncated_to_token_budget' END) AS warnings FROM whole""")
def context_pack(spark, sf):
    """The tiered pack with decisions, tasks and the line-search fallback; lists as one text each."""
    asked = prompts(spark, sf).select(
        "prompt_id", "text", F.col("project").alias("project_hint"),
        F.lit(None).cast("string").alias("active_workspace"),
        F.when(F.length("text") > 250, 400).alias("token_budget"),
    )
    # As in use, the memory table and its vectors are stored before anyone asks.
    k = stage(embed(memories(spark, sf), "text", HashedEmbedder(DATA_RULES)), "memories")
    pack = build_context(
        asked, k, document_edges(spark, sf), HashedEmbedder(DATA_RULES),
        load(spark, sf, "documents"), DATA_RULES, stage=stage,
    )

    def record(p):
        return F.concat_ws(
            "|", p["memory_id"], p["type"], p["status"], p["source_type"], F.coalesce(p["source_id"], F.lit("-")),
            F.coalesce(p["created_at"], F.lit("-")),
            F.when(p["confidence"].isNull(), "-").otherwise(F.format_string("%.2f", p["confidence"])),
            F.format_string("%.6f", p["score"]),
        )

    return pack.select(
        "prompt_id", "context_markdown", "memory_char_budget", "counts.*",
        F.array_join(F.transform("provenance", record), "\n").alias("provenance"),
        F.array_join(F.transform("relations", lambda r: F.concat_ws(">", r["src"], r["rel"], r["dst"])), ",")
        .alias("relations"),
        "recommended_agent", F.array_join("active_projects", ",").alias("active_projects"),
        F.array_join("warnings", ",").alias("warnings"),
    )


@query("recall_floor", f"""
WITH {RETRIEVAL_SQL}, {sql_pooled('know', 'seen', 'memory_id')},
a AS (SELECT prompt_id, count(*) AS routed FROM know GROUP BY prompt_id),
b AS (SELECT prompt_id, least(count(*), 5) AS unrouted FROM seen GROUP BY prompt_id)
SELECT prompt_id, coalesce(routed, 0) AS routed, coalesce(unrouted, 0) AS unrouted,
  coalesce(routed, 0) >= coalesce(unrouted, 0) AS kept
FROM prompts LEFT JOIN a USING (prompt_id) LEFT JOIN b USING (prompt_id)""")
def floor(spark, sf):
    asked = prompts(spark, sf)
    model = HashedEmbedder(DATA_RULES)
    plain = vector_topk(
        embed(asked, "text", model), embedded_documents(spark, sf), model.dimensions,
        DATA_RULES.vector_top_k, DATA_RULES.min_score, scope=Scope(project="global"),
    )
    return recall_floor(asked, _retrieved(spark, sf).knowledge, plain)


_GOLDEN_SQL = """
golden AS (SELECT prompt_id, CASE WHEN contains(text, ' the ') THEN 'english' WHEN contains(text, 'die ')
  THEN 'german' WHEN contains(text, ' de ') THEN 'romance' END AS expect, ['claims'] AS accept FROM prompts)"""


@query("routing_eval", f"""
WITH {RETRIEVAL_SQL}, {sql_pooled('know', 'seen', 'memory_id')}, {_GOLDEN_SQL},
g AS (SELECT expect, axes, accept FROM golden JOIN routed USING (prompt_id)),
acc AS (SELECT count(*) AS golden_prompts, count(*) FILTER (WHERE expect IS NOT NULL) AS scored_prompts,
  round(100.0 * count(*) FILTER (WHERE axes[1] = expect) / count(*) FILTER (WHERE expect IS NOT NULL), 1)
    AS route_top1_accuracy_pct,
  round(100.0 * sum(len(list_filter(axes, lambda a: a <> expect AND NOT list_contains(accept, a))))
    FILTER (WHERE expect IS NOT NULL) / sum(len(axes)) FILTER (WHERE expect IS NOT NULL), 1) AS axis_leakage_pct
  FROM g),
r AS (SELECT round(100.0 * avg(list_contains(experts, expect)::INT), 1) AS v FROM know
  JOIN golden USING (prompt_id) JOIN docs USING (memory_id) WHERE expect IS NOT NULL),
u AS (SELECT round(100.0 * avg(list_contains(experts, expect)::INT), 1) AS v FROM
  (SELECT * FROM seen QUALIFY row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, memory_id) <= 5)
  JOIN golden USING (prompt_id) WHERE expect IS NOT NULL)
SELECT acc.*, r.v AS routed_precision_pct, round(100.0 - r.v, 1) AS routed_irrelevant_pct,
  u.v AS global_precision_pct, round(100.0 - u.v, 1) AS global_irrelevant_pct FROM acc, r, u""")
def routing_eval(spark, sf):
    asked = prompts(spark, sf)
    golden = asked.select(
        "prompt_id",
        F.when(F.col("text").contains(" the "), "english").when(F.col("text").contains("die "), "german")
        .when(F.col("text").contains(" de "), "romance").alias("expect"),
        F.array(F.lit("claims")).alias("accept"),
    )
    model = HashedEmbedder(DATA_RULES)
    stored = stage(embedded_documents(spark, sf), "documents")
    found = retrieve(asked, stored, document_edges(spark, sf), model, rules=DATA_RULES, stage=stage)
    plain = vector_topk(
        found.routed, stored, model.dimensions,
        DATA_RULES.vector_top_k, DATA_RULES.min_score, scope=Scope(project="global"), payload=["experts"],
    )
    return evaluation_report(
        routing_accuracy(golden, found.routed), retrieval_precision(golden, found.knowledge, "routed"),
        retrieval_precision(golden, plain, "global"),
    )

