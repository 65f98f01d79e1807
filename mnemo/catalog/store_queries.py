"""Logs, sessions, curation and first-write-wins tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemo.catalog.base import (
    DATA_RULES, load, load_text, query, sql_hits, sql_key_hash, sql_segments,
    sql_strip, sql_topic,
)
from mnemo.catalog.text_queries import _sql_pattern_score
from mnemo.functions import text as t
from mnemo.operators.upsert import (
    concept_nodes, edge_view, node_id, upsert_edges, upsert_knowledge, upsert_nodes,
    with_current_status,
)
from mnemo.plans.curate import curate, curate_counts, dropped_chars, ingest_report, segment_rows
from mnemo.schema import KNOWLEDGE
from mnemo.sources.logs import (
    clean_content, export_counters, export_rows, filter_messages, label_messages, parse_log,
    session_messages,
)
from mnemo.sources.tables import stage, with_defaults


# -- logs: conversations written as JSON lines, and beside each system turn one broken line --------
def _log_lines(spark, sf):
    c = load(spark, sf, "conversations")
    good = F.to_json(F.struct("role", F.col("text").alias("content"), F.lit("2024-01-01T00:00:00Z").alias("ts")))
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4))
    broken = (
        F.when(kind == 0, F.concat(good, F.lit("}")))
        .when(kind == 1, F.concat(F.lit("["), good, F.lit("]")))
        .when(kind == 2, F.to_json(F.struct("role", "text")))
        .otherwise(F.lit("   "))
    )
    lines = c.select("conv_id", "turn", good.alias("value"))
    return lines.unionByName(
        c.filter("role = 'system'").select("conv_id", (-1 - F.col("turn")).alias("turn"), broken.alias("value"))
    )


@query("log_messages", "SELECT conv_id, turn, role, text AS content, '2024-01-01T00:00:00Z' AS ts "
       "FROM conversations")
def log_messages(spark, sf):
    return parse_log(_log_lines(spark, sf))[0]


@query("log_rejects", "SELECT conv_id, -1 - turn AS turn FROM conversations "
       "WHERE role = 'system' AND (conv_id + turn) % 4 <> 3")
def log_rejects(spark, sf):
    return parse_log(_log_lines(spark, sf))[1].select("conv_id", "turn")


# -- sessions: conversations as messages, labelled documents as their sessions ------------------------
_SESSION_SQL = """
messages AS (SELECT conv_id AS session_id, turn AS id, role AS role0, text,
    TIMESTAMP '2024-01-01' + to_seconds(conv_id * 100 + turn) AS moment FROM conversations),
sessions AS (SELECT doc_id, CASE WHEN quality = 0 THEN '' ELSE source END AS src, lang
    FROM documents JOIN labels USING (doc_id)),
joined AS (SELECT session_id, id, role0, text, moment, coalesce(nullif(src, ''), 'session') AS source, lang AS model
    FROM messages LEFT JOIN sessions ON session_id = doc_id)"""


def _sessions(spark, sf):
    c = load_text(spark, sf, "conversations")
    start = F.lit("2024-01-01T00:00:00Z").cast("timestamp")
    offset = (F.col("conv_id") * 100 + F.col("turn")).cast("decimal(18,6)")
    messages = c.select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), "role",
        F.col("text").alias("content"), (start + F.make_dt_interval(secs=offset)).alias("timestamp"),
    )
    docs = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id")
    sessions = docs.select(
        F.col("doc_id").alias("id"), F.when(F.col("quality") == 0, "").otherwise(F.col("source")).alias("source"),
        F.col("lang").alias("model"),
    )
    return messages, sessions


@query("session_messages", f"WITH {_SESSION_SQL} SELECT session_id, id, source, model FROM joined")
def with_sessions(spark, sf):
    return session_messages(*_sessions(spark, sf)).select("session_id", "id", "source", "model")


@query("session_filter", f"""
WITH {_SESSION_SQL} SELECT session_id, id, source FROM joined
WHERE moment >= TIMESTAMP '2024-01-01 00:10:00' AND moment <= TIMESTAMP '2024-01-01 02:00:00'
  AND role0 IN ('user', 'system')""")
def filtered_sessions(spark, sf):
    messages, sessions = _sessions(spark, sf)
    kept = filter_messages(
        messages, since="2024-01-01T00:10:00Z", until=1704074400, roles=["User", " system"]
    )
    return session_messages(kept, sessions).select("session_id", "id", "source")


def _labelled(spark, sf):
    messages, sessions = _sessions(spark, sf)
    spaced = messages.withColumn("role", F.when(F.col("role") == "user", " User ").otherwise(F.col("role")))
    # Beside every system turn stands a blank message, beside every assistant's one without a role.
    blank = spaced.filter("role = 'system'").withColumns({
        "id": -1 - F.col("id"), "role": F.lit("assistant"), "content": F.lit(" \n\t"),
    })
    nameless = spaced.filter("role = 'assistant'").withColumns({
        "id": -1 - F.col("id"), "role": F.lit(None).cast("string"),
    })
    blanked = spaced.unionByName(blank).unionByName(nameless)
    return label_messages(session_messages(blanked, sessions), skip_roles=["system"])


_LABEL_SQL = _SESSION_SQL + f""",
labelled AS (SELECT *, role0 AS role, {sql_strip('text')} AS content FROM joined
  UNION ALL SELECT * REPLACE (-1 - id AS id), 'assistant', '' FROM joined WHERE role0 = 'system'
  UNION ALL SELECT * REPLACE (-1 - id AS id), 'unknown', {sql_strip('text')} FROM joined WHERE role0 = 'assistant'),
outcomes AS (SELECT *, CASE WHEN role = 'system' THEN 'skipped_tool' WHEN content = '' THEN 'skipped_empty'
    ELSE 'written' END AS outcome FROM labelled)"""


@query("message_outcomes", f"WITH {_LABEL_SQL} SELECT session_id, id, role, content, outcome FROM outcomes")
def outcomes(spark, sf):
    return _labelled(spark, sf).select("session_id", "id", "role", "content", "outcome")


@query("export_rows", f"""WITH {_LABEL_SQL} SELECT role, content,
  strftime(moment, '%Y-%m-%dT%H:%M:%SZ') AS ts, session_id, source FROM outcomes WHERE outcome = 'written'""")
def exported(spark, sf):
    return export_rows(_labelled(spark, sf))


@query("export_counters", f"""
WITH {_LABEL_SQL} SELECT count(DISTINCT session_id) FILTER (WHERE outcome = 'written') AS sessions,
  count(*) AS messages, count(*) FILTER (WHERE outcome = 'written') AS written,
  count(*) FILTER (WHERE outcome = 'skipped_tool') AS skipped_tool,
  count(*) FILTER (WHERE outcome = 'skipped_empty') AS skipped_empty FROM outcomes""")
def export_counts(spark, sf):
    return export_counters(_labelled(spark, sf))


@query("clean_content", f"""
SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN '' WHEN lang IN ('en', 'fr') THEN {sql_strip('text')}
  WHEN lang = 'de' THEN '[' || text || ' note' ELSE {sql_strip('text')} END AS content FROM documents""")
def cleaned(spark, sf):
    docs = load_text(spark, sf, "documents")
    part = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))
    noise = F.struct(F.lit("tool_use").alias("type"), F.col("source").alias("text"))
    whole = F.struct(F.lit("tool_use").alias("type"), F.col("text").alias("text"))
    body = (
        F.when(F.col("doc_id") % 5 == 4, F.to_json(F.array(noise, whole)))
        .when(F.col("lang") == "en", F.to_json(F.struct(F.struct(F.array(noise, part).alias("content")).alias("message"))))
        .when(F.col("lang") == "fr", F.to_json(part))
        .when(F.col("lang") == "de", F.concat(F.lit("["), "text", F.lit(" note")))
        .otherwise(F.col("text"))
    )
    return docs.select("doc_id", clean_content(body).alias("content"))


# -- schema evolution ---------------------------------------------------------------------------------
@query("schema_defaults", """
SELECT doc_id::VARCHAR AS memory_id, 'approved' AS status,
  CASE WHEN l.quality = 1 THEN 'event' ELSE 'conversation' END AS source_type, 0 AS n_experts, NULL::DOUBLE AS confidence
FROM documents LEFT JOIN labels l USING (doc_id)""")
def defaults(spark, sf):
    docs = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id", "left")
    old = docs.select(
        F.col("doc_id").cast("string").alias("memory_id"), "text",
        F.when(F.col("quality") == 0, "").alias("status"),
        F.when(F.col("quality") == 1, "event").alias("source_type"),
    )
    return with_defaults(old, KNOWLEDGE).select(
        "memory_id", "status", "source_type", F.size("experts").alias("n_experts"), "confidence"
    )


# -- knowledge upsert ------------------------------------------------------------------------------------
_UPSERT_SQL = f"""
stored AS (SELECT DISTINCT md5(lang || '::' || {sql_strip('text')}) AS memory_id FROM documents
  JOIN labels USING (doc_id) WHERE quality = 1),
batch AS (SELECT doc_id, lang, {sql_strip('text')} AS text, md5(lang || '::' || {sql_strip('text')}) AS memory_id
  FROM documents WHERE length({sql_strip('text')}) > 0),
judged AS (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY doc_id) = 1 AS first,
  memory_id IN (SELECT memory_id FROM stored) AS known FROM batch)"""


def _upserted(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("source"))
    good = load(spark, sf, "labels").filter("quality = 1").select("doc_id")
    stored = docs.join(good, "doc_id", "left_semi").select(
        F.md5(F.concat("source", F.lit("::"), t.strip("text"))).alias("memory_id")
    )
    return upsert_knowledge(docs, stored, ["doc_id"])


@query("upsert_first_wins", f"""
WITH {_UPSERT_SQL} SELECT doc_id, memory_id, text, 'approved' AS status, 'conversation' AS source_type,
  lang AS source_id FROM judged WHERE first AND NOT known""")
def upsert_inserted(spark, sf):
    return _upserted(spark, sf)[0].select(
        "doc_id", "memory_id", "text", "status", "source_type", "source_id"
    )


@query("upsert_skipped", f"""
WITH {_UPSERT_SQL} SELECT doc_id, memory_id, substring(text, 1, 120) AS text,
  'duplicate_fingerprint' AS reason, CASE WHEN known THEN 'stored' ELSE 'repeated' END AS verdict
FROM judged WHERE NOT first OR known""")
def upsert_refused(spark, sf):
    return _upserted(spark, sf)[1].select("doc_id", "memory_id", "text", "reason", "verdict")


@query("upsert_count", f"WITH {_UPSERT_SQL} SELECT count(*) AS inserted FROM judged WHERE first AND NOT known")
def upsert_counted(spark, sf):
    return _upserted(spark, sf)[0].agg(F.count("*").alias("inserted"))


# -- graph upsert: orders name few distinct edges, so every key is hot ---------------------------------------
def _triples(spark, sf):
    orders, customer = load(spark, sf, "orders"), load(spark, sf, "customer")
    return orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select(
        F.col("o_orderkey").alias("ord"), F.concat(F.lit(" "), "c_mktsegment").alias("src"),
        F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.lit("placed")).alias("rel"),
        F.col("o_orderpriority").alias("dst"), F.concat(F.lit("p"), "c_nationkey").alias("project"),
    )


_TRIPLES_SQL = """
triples AS (SELECT o_orderkey AS ord, c_mktsegment AS src, 'placed' AS rel, o_orderpriority AS dst,
  'p' || c_nationkey AS project FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P')"""


@query("edges_upsert", f"""
WITH {_TRIPLES_SQL}
SELECT {sql_key_hash('src', 'rel', 'dst')} AS edge_id, src AS src_label, rel, dst AS dst_label,
  arg_min(project, ord) AS project, 'approved' AS status FROM triples GROUP BY src, rel, dst""")
def edges_upserted(spark, sf):
    return upsert_edges(_triples(spark, sf)).select(
        "edge_id", "src_label", "rel", "dst_label", "project", "status"
    )


@query("nodes_upsert", f"""
WITH {_TRIPLES_SQL},
ends AS (SELECT ord, 0 AS e, src AS label, project FROM triples UNION ALL SELECT ord, 1, dst, project FROM triples)
SELECT {sql_key_hash('label', "'entity'")} AS node_id, label, 'entity' AS kind,
  arg_min(project, ord * 2 + e) AS project FROM ends GROUP BY label""")
def nodes_upserted(spark, sf):
    return upsert_nodes(_triples(spark, sf)).select("node_id", "label", "kind", "project")


@query("edge_view", f"""
WITH {_TRIPLES_SQL}
SELECT ord, src AS src_label, rel, dst AS dst_label FROM triples""")
def edges_viewed(spark, sf):
    triples = _triples(spark, sf).filter("rel != ' '").withColumn("src", F.trim("src"))
    kind = F.lit("entity")
    edges = triples.select(
        "ord", node_id(F.col("src"), kind).alias("src"), "rel", node_id(F.col("dst"), kind).alias("dst")
    )
    return edge_view(edges, upsert_nodes(triples)).select("ord", "src_label", "rel", "dst_label")


# -- status ---------------------------------------------------------------------------------------------------
@query("current_status", """
WITH last AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id)
SELECT c_custkey AS memory_id, coalesce(status, 'approved') AS status FROM customer LEFT JOIN last ON c_custkey = user_id""")
def status_now(spark, sf):
    log = load(spark, sf, "events").select(
        F.col("user_id").alias("memory_id"), F.col("event_type").alias("status"),
        F.col("ts").alias("at"), "event_id",
    )
    customers = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("memory_id"), F.lit("approved").alias("status")
    )
    return with_current_status(customers, log, ["at", "event_id"])


# -- curation ---------------------------------------------------------------------------------------------------
_CURATE_SQL = f"""
{sql_segments('conversations', 'conv_id, turn', 'text', 'role')},
scored AS (SELECT *, {sql_hits('text', DATA_RULES.experience_keywords)} + {_sql_pattern_score('text')} AS e,
  {sql_hits('text', DATA_RULES.knowledge_keywords)} AS k FROM segments),
kinds AS (SELECT *, CASE WHEN e > k THEN 'experience' ELSE 'knowledge' END AS kind FROM scored)"""


def _segments(spark, sf, rules=DATA_RULES):
    messages = load_text(spark, sf, "conversations").select(
        "conv_id", "turn", "role", F.col("text").alias("content"),
        F.lit(None).cast("string").alias("ts"), F.col("role").alias("source"),
    )
    return segment_rows(messages, ["conv_id", "turn"], rules)


@query("curate_counts", f"""
WITH {_CURATE_SQL}
SELECT count(*) AS segments, count(*) FILTER (WHERE kind = 'knowledge') AS knowledge_segments,
  count(*) FILTER (WHERE kind = 'experience') AS experience_segments, 0::BIGINT AS experience_edges,
  count(*) FILTER (WHERE kind = 'experience') AS experience_nodes FROM kinds""")
def curated_counts(spark, sf):
    return curate_counts(_segments(spark, sf)).drop("tagged_segments")


@query("curate_roles", f"""
WITH {_CURATE_SQL}
SELECT conv_id, turn, seg, role, kind, text FROM kinds WHERE role NOT IN ('system', 'tool')""")
def curated_roles(spark, sf):
    """Segments and their class, with two roles skipped."""
    rows = _segments(spark, sf, DATA_RULES.with_(skip_roles=("system", "tool")))
    return rows.select("conv_id", "turn", F.col("seg").cast("bigint").alias("seg"), "role", "kind", "text")


@query("ingest_report", f"""
WITH {_CURATE_SQL},
n AS (SELECT count(*) AS segments, count(*) FILTER (WHERE kind = 'knowledge') AS knowledge_segments,
  count(*) FILTER (WHERE kind = 'experience') AS experience_segments,
  count(*) FILTER (WHERE kind = 'experience') AS experience_nodes,
  count(DISTINCT (role, text)) FILTER (WHERE kind = 'knowledge') AS knowledge_added FROM kinds)
SELECT (SELECT count(*) FROM conversations) AS messages, (SELECT count(*) FROM conversations
  WHERE role = 'system' AND (conv_id + turn) % 4 <> 3) AS malformed_lines, n.*,
  knowledge_segments - knowledge_added AS knowledge_skipped, knowledge_added AS stored_total FROM n""")
def ingest(spark, sf):
    """A whole log curated at once: lines in, what was made of them, and the table after it."""
    messages, rejects = parse_log(_log_lines(spark, sf))
    messages = messages.withColumn("source", F.col("role"))
    made = curate(messages, ["conv_id", "turn"], rules=DATA_RULES, stage=stage)
    report = ingest_report(messages, rejects, made, {"stored": made.knowledge})
    return report.drop("tagged_segments", "experience_edges")


@query("curate_knowledge", f"""
WITH {_CURATE_SQL}
SELECT conv_id, turn, seg, text, role AS source FROM kinds WHERE kind = 'knowledge'
QUALIFY row_number() OVER (PARTITION BY role, text ORDER BY conv_id, turn, seg) = 1""")
def curated_knowledge(spark, sf):
    facts = _segments(spark, sf).filter("kind = 'knowledge'").select("conv_id", "turn", "seg", "text", "source")
    inserted, _ = upsert_knowledge(facts, None, ["conv_id", "turn", "seg"])
    return inserted.select("conv_id", "turn", F.col("seg").cast("bigint").alias("seg"), "text", "source")


@query("concept_nodes", f"""
WITH {_CURATE_SQL}
SELECT label, {sql_key_hash('label', "'concept'")} AS node_id, 'concept' AS kind FROM (
  SELECT DISTINCT {sql_strip(f"coalesce(nullif({sql_topic('text')}, ''), substring(text, 1, 60))")} AS label
  FROM kinds WHERE kind = 'experience')""")
def concepts(spark, sf):
    rows = _segments(spark, sf).filter("kind = 'experience'")
    return concept_nodes(rows, None, ["conv_id", "turn", "seg"]).select("label", "node_id", "kind")


@query("dropped_chars", f"""
WITH {sql_segments('documents', 'doc_id', 'text')}
SELECT ((SELECT sum(length(text)) FROM documents) - (SELECT sum(length(text)) FROM segments))::BIGINT AS dropped_chars""")
def chars_dropped(spark, sf):
    return dropped_chars(load_text(spark, sf, "documents").withColumnRenamed("text", "content"))

