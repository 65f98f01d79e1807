"""Outcome events, the ledger and approvals."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Window, functions as F

from mnemo.catalog.base import DATA_RULES, load, load_text, query, sql_active, sql_axis_columns, sql_strip, utc
from mnemo.catalog.frames import MEMORIES_SQL, memories
from mnemo.functions.scalars import to_iso
from mnemo.operators.audit import store_audit
from mnemo.operators.ledger import (
    LOST_WORKER, backlog_depth, classify_duplicates, content_counts, dead_letters, due_events, event_state,
    last_done, ledger_report, ledger_stats, lifecycle, oldest_first,
)
from mnemo.operators.upsert import upsert_knowledge
from mnemo.plans.approvals import apply_approvals
from mnemo.plans.fanout import artefact_rows, event_counts, ingest_events, memory_rows
from mnemo.sources.tables import shared_folder, stage
from mnemo.sources.events import coerced_decisions, event_rows, parse_events, split_events
from mnemo.streaming.ingest import EventIngest, Store

# One event per conversation turn: the turn is its decision (a self-assigned
# approval), its lesson (so a user's lesson repeats the decision) and its summary.


def _lines(spark, sf, shared=True):
    """``shared``: the system turns of a conversation share one request id."""
    c = load_text(spark, sf, "conversations")
    key = F.concat_ws("-", "conv_id", "turn")
    text, role = F.col("text"), F.col("role")
    request = F.when((role == "system") & F.lit(shared), F.col("conv_id").cast("string")).otherwise(key)
    event = F.struct(
        F.concat(F.lit("e"), key).alias("event_id"),
        F.concat(F.lit("r"), request).alias("request_id"),
        F.when(role != "system", role).alias("agent"), F.lit("mem").alias("project"),
        text.alias("result_summary"),
        F.when(role == "system", "Failed").when(role == "user", "completed").alias("status"),
        F.lit("2024-01-01T00:00:00Z").alias("timestamp"),
        F.array(F.struct(
            text.alias("text"), F.when(role == "user", "approved").when(role == "system", "superseded").alias("status"),
            F.when(role == "assistant", "own").alias("project"),
        ), F.struct(
            F.lit("  ").alias("text"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("project")
        )).alias("decisions"),
        F.when(role == "user", F.array(F.struct(text.alias("text")))).alias("lessons"),
        F.array(F.struct(
            F.concat(F.lit("task "), key).alias("title"),
            F.when(role == "user", "Completed").otherwise("open").alias("status"),
        )).alias("open_tasks"),
        F.array(F.struct(
            F.concat(F.lit("out/"), role, F.lit(".json")).alias("path_or_ref"), F.lit("").alias("kind")
        )).alias("artefacts"),
    )
    line = F.to_json(event)
    n = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(6))
    broken = (
        F.when(n == 0, F.substring(line, 1, 25))
        .when(n == 1, F.lit('{"request_id": 7}'))
        .when(n == 2, F.lit('{"request_id": "x", "status": "odd"}'))
        .when(n == 3, F.lit('{"request_id": "x", "decisions": [{"text": "a", "status": "maybe"}]}'))
        .when(n == 4, F.lit('{"request_id": "x", "lessons": ["a"]}'))
        .otherwise(F.lit('{"request_id": "x", "timestamp": [1]}'))
    )
    beside = c.filter(role == "system").select("conv_id", (-1 - F.col("turn")).alias("turn"), broken.alias("value"))
    return c.select("conv_id", "turn", line.alias("value")).unionByName(beside)


# Every turn is a good line; beside each system turn stands a broken one, numbered below zero.
_ERRORS_SQL = """
checked AS (SELECT conv_id, turn, role, text, conv_id || '-' || turn AS k, NULL AS error_code, NULL AS error_field
  FROM conversations
  UNION ALL SELECT conv_id, -1 - turn, role, NULL, NULL,
    ['not_json', 'not_a_string', 'unknown_status', 'unknown_status', 'not_an_object', 'not_a_string'][n + 1],
    [NULL, 'request_id', 'status', 'decisions', 'lessons', 'timestamp'][n + 1]
  FROM (SELECT *, (conv_id + turn) % 6 AS n FROM conversations WHERE role = 'system'))"""


@query("event_validate", f"WITH {_ERRORS_SQL} SELECT conv_id, turn, error_code, error_field FROM checked")
def validated(spark, sf):
    return parse_events(_lines(spark, sf)).select("conv_id", "turn", "error_code", "error_field")


def _valid(spark, sf):
    return event_rows(split_events(parse_events(_lines(spark, sf)))[0])


@query("event_coerced", f"""
WITH {_ERRORS_SQL} SELECT conv_id, turn, 0 AS index, substring(text, 1, 120) AS text,
  'approved' AS submitted_status, 'proposed' AS stored_status
FROM checked WHERE error_code IS NULL AND role = 'user'""")
def coerced(spark, sf):
    rows = _valid(spark, sf).select("conv_id", "turn", F.explode(coerced_decisions(F.col("decisions"))).alias("c"))
    return rows.select("conv_id", "turn", "c.*")


_ITEMS_SQL = f"""
ok AS (SELECT * FROM checked WHERE error_code IS NULL),
items AS (
  SELECT k, 0 AS item, 'decisions' AS section, 'decision' AS type, {sql_strip('text')} AS text,
    CASE role WHEN 'user' THEN 'proposed' WHEN 'system' THEN 'superseded' ELSE 'proposed' END AS status,
    CASE WHEN role = 'assistant' THEN 'own' ELSE 'mem' END AS project FROM ok
  UNION ALL SELECT k, 2, 'lessons', 'knowledge', {sql_strip('text')}, 'approved', 'mem' FROM ok WHERE role = 'user'
  UNION ALL SELECT k, CASE WHEN role = 'user' THEN 3 ELSE 2 END, 'open_tasks', 'task', 'task ' || k,
    CASE WHEN role = 'user' THEN 'completed' ELSE 'proposed' END, 'mem' FROM ok
  UNION ALL SELECT k, CASE WHEN role = 'user' THEN 4 ELSE 3 END, 'summary', 'experience', {sql_strip('text')},
    CASE WHEN role = 'system' THEN 'rejected' ELSE 'approved' END, 'mem' FROM ok),
judged AS (SELECT *, row_number() OVER (PARTITION BY k, text ORDER BY item) = 1 AS first FROM items
  WHERE length(text) > 0)"""


def _memory(spark, sf):
    # As in ``ingest_events``: the lines are parsed and tagged once for all that reads them.
    events = stage(_valid(spark, sf), "events")
    rows = stage(memory_rows(events, ["conv_id", "turn"], DATA_RULES), "rows")
    return events, *upsert_knowledge(rows, None, ["conv_id", "turn", "item"])


_GATED = sql_axis_columns("text", DATA_RULES, "gate")


@query("event_fanout", f"""
WITH {_ERRORS_SQL}, {_ITEMS_SQL},
g AS (SELECT *, CASE WHEN type IN ('decision', 'experience') THEN 'experience' ELSE 'knowledge' END AS gate FROM judged),
a AS (SELECT *, {', '.join(f'{e} AS ax_{n}' for n, e in _GATED.items())} FROM g)
SELECT 'e' || k AS event_id, section, type, text, status, project,
  array_to_string({sql_active(DATA_RULES)}, ',') AS experts FROM a WHERE first""")
def fanned_out(spark, sf):
    _, inserted, _ = _memory(spark, sf)
    return inserted.select(
        F.col("source_id").alias("event_id"), "section", "type", "text", "status", "project",
        F.array_join("experts", ",").alias("experts"),
    )


@query("event_counts", f"""
WITH {_ERRORS_SQL}, {_ITEMS_SQL}
SELECT 'e' || k AS event_id, {', '.join(
    f"count(*) FILTER (WHERE first AND section = '{s}') AS {s}" for s in ('decisions', 'lessons', 'open_tasks', 'summary'))},
  1::BIGINT AS artefacts, count(*) FILTER (WHERE NOT first) AS skipped_count FROM judged GROUP BY k""")
def event_tally(spark, sf):
    events, inserted, skipped = _memory(spark, sf)
    return event_counts(events, inserted, skipped, artefact_rows(events, ["conv_id", "turn"], DATA_RULES))


@query("event_artefacts", f"""
WITH {_ERRORS_SQL} SELECT 'e' || k AS event_id, CASE WHEN role = 'system' THEN 'unknown' ELSE role END AS src,
  'produced' AS rel, 'out/' || role || '.json' AS dst, 'file' AS kind FROM checked WHERE error_code IS NULL""")
def artefacts(spark, sf):
    rows = artefact_rows(_valid(spark, sf), ["conv_id", "turn"], DATA_RULES)
    return rows.select(
        F.col("source_event").alias("event_id"), "src", "rel", "dst", F.col("meta")["kind"].alias("kind")
    )


@query("event_content_counts", f"""
WITH {_ERRORS_SQL} SELECT 'e' || k AS event_id, 2 AS decisions, (role = 'user')::INT AS lessons, 1 AS open_tasks,
  1 AS artefacts FROM checked WHERE error_code IS NULL""")
def content_sizes(spark, sf):
    return _valid(spark, sf).select("event_id", content_counts().alias("n")).select("event_id", "n.*")


@dataclass(frozen=True)
class Lengths:
    """A user's own model: characters and spaces of a text."""

    name: str = "lengths"
    model: str = "v1"
    dimensions: int = 2

    def embed_batch(self, texts):
        return np.array([[len(x), x.count(" ")] for x in texts], np.float32).reshape(-1, 2)


_MADE_SQL = f"""
WITH {_ERRORS_SQL}, {_ITEMS_SQL},
produced AS (SELECT DISTINCT CASE WHEN role = 'system' THEN 'unknown' ELSE role END AS src, 'out/' || role || '.json' AS dst FROM ok)
SELECT 'memory' AS kind, 'e' || k || ':' || section AS name, status, length(text) AS size FROM judged WHERE first
UNION ALL SELECT 'edge', src || '>produced>' || dst, 'approved', NULL FROM produced
UNION ALL SELECT 'node', label, 'approved', NULL FROM (SELECT src AS label FROM produced UNION SELECT dst FROM produced)"""


@query("ingest_events", _MADE_SQL)
def ingested(spark, sf):
    """All that a batch of events becomes: memories with a user's own vectors, nodes and edges."""
    made = ingest_events(stage(_valid(spark, sf), "events"), ["conv_id", "turn"], embedder=Lengths(), rules=DATA_RULES, stage=stage)
    none = F.lit(None).cast("bigint").alias("size")
    memories_ = made.knowledge.select(
        F.lit("memory").alias("kind"), F.concat_ws(":", "source_id", "section").alias("name"), "status",
        F.col("embedding")[0].cast("bigint").alias("size"),
    )
    edges = made.edges.select(F.lit("edge").alias("kind"), F.concat_ws(">", "src_label", "rel", "dst_label").alias("name"), "status", none)
    nodes = made.nodes.select(F.lit("node").alias("kind"), F.col("label").alias("name"), "status", none)
    return memories_.unionByName(edges).unionByName(nodes)


@query("event_stream", f"""
WITH {_ERRORS_SQL}, {_ITEMS_SQL}
SELECT 'e' || k AS event_id, type, text, status, project, 'done' AS state, 1::BIGINT AS attempts FROM judged WHERE first
UNION ALL SELECT NULL, error_code, NULL, error_field, NULL, 'invalid', NULL FROM checked WHERE error_code IS NOT NULL""")
def streamed(spark, sf):
    """The same lines as a stream, told twice and drained: memories with the state of their event, and rejects."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    store = Store(spark, f"{root}/store")
    run = EventIngest(store, Lengths(), DATA_RULES)
    lines = _lines(spark, sf, shared=False).select("value")
    for told in (lines, lines.filter(F.col("value").contains('"result_summary"'))):
        told.write.mode("append").text(f"{root}/in")
        run.drain(f"{root}/in")
    states_ = run.ledger().select("event_id", "state", "attempts")
    made = store.knowledge.withColumnRenamed("source_id", "event_id").join(states_, "event_id")
    made = made.select("event_id", "type", "text", "status", "project", "state", "attempts")
    none = F.lit(None).cast("string")
    return made.unionByName(store.quarantine.select(
        none.alias("event_id"), F.col("error_code").alias("type"), none.alias("text"), F.col("error_field").alias("status"),
        none.alias("project"), F.lit("invalid").alias("state"), F.lit(None).cast("bigint").alias("attempts"),
    ))


# -- idempotency: few request ids over many events, purchases stored before -----------------------------
@query("event_dedupe", """
WITH e AS (SELECT event_id, event_type, user_id || '-' || (props->>'k') AS request_id,
  event_type || ':' || (value > 10)::INT AS payload, event_type = 'purchase' AS old FROM events),
stored AS (SELECT request_id, arg_min(payload, event_id) AS payload FROM e WHERE old GROUP BY request_id),
won AS (SELECT e.*, first_value(e.payload) OVER (PARTITION BY request_id ORDER BY event_id) AS won_payload,
  row_number() OVER (PARTITION BY request_id ORDER BY event_id) AS n FROM e WHERE NOT old)
SELECT event_id, request_id, n = 1 AND s.payload IS NULL AS queued, NOT (n = 1 AND s.payload IS NULL) AS duplicate,
  won.payload <> coalesce(s.payload, won_payload) AS payload_mismatch FROM won LEFT JOIN stored s USING (request_id)""")
def deduped(spark, sf):
    events = load(spark, sf, "events").select(
        "event_id", F.col("ts").alias("timestamp"), "event_type",
        F.concat_ws("-", "user_id", F.get_json_object("props", "$.k")).alias("request_id"),
        F.concat_ws(":", "event_type", (F.col("value") > 10).cast("int")).alias("payload"),
    )
    stored = classify_duplicates(
        events.filter("event_type = 'purchase'"), None, ["payload", "timestamp"], ["event_id"]
    ).filter("queued").select("request_id", "payload_hash")
    judged = classify_duplicates(
        events.filter("event_type != 'purchase'"), stored, ["payload", "timestamp"], ["event_id"]
    )
    return judged.select("event_id", "request_id", "queued", "duplicate", "payload_mismatch")


# -- ledger: a user's day is a work item; errors are failed attempts, purchases done, sign-ups running ---------
# Errors, purchases and sign-ups are attempts, every other event is an arrival. Seen from the middle
# of the month, later sign-ups are running and later errors wait for their next attempt.
_NOW, _STALE = "2024-01-16 00:00:00", 21_600
_LEDGER_SQL = f"""
days AS (SELECT *, user_id || '-' || strftime(ts, '%Y-%m-%d') AS item FROM events),
work AS (SELECT item, min(ts) AS created_at, count(*) FILTER (WHERE event_type = 'view') AS views,
  count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'error') AS errors,
  count(*) FILTER (WHERE event_type = 'purchase') AS purchases FROM days GROUP BY item),
att AS (SELECT item, count(*) AS attempts, arg_max(event_type, (ts, event_id)) AS last_type, max(ts) AS last_ts,
  arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'error') AS bad
  FROM days WHERE event_type IN ('error', 'purchase', 'signup') GROUP BY item),
j AS (SELECT * EXCLUDE (attempts), coalesce(attempts, 0) AS attempts,
  last_type = 'signup' AND last_ts < TIMESTAMP '{_NOW}' - INTERVAL {_STALE} SECOND AS lost FROM work LEFT JOIN att USING (item)),
ledger AS (SELECT *, CASE WHEN last_type IS NULL THEN 'queued' WHEN last_type = 'purchase' THEN 'done'
    WHEN last_type = 'error' AND attempts >= 5 THEN 'dead' WHEN last_type = 'error' THEN 'queued'
    WHEN lost AND attempts >= 5 THEN 'dead' WHEN lost THEN 'queued' ELSE 'processing' END AS state,
  CASE WHEN last_type IS NULL THEN created_at
    WHEN last_type = 'error' AND attempts < 5 THEN last_ts + to_seconds(least(300, pow(2, attempts))::INT)
    WHEN lost AND attempts < 5 THEN TIMESTAMP '{_NOW}' END AS next_attempt,
  CASE WHEN last_type = 'error' OR last_type IS NULL THEN 'failed with ' || bad
    WHEN lost AND attempts >= 5 THEN coalesce('failed with ' || bad, '{LOST_WORKER}')
    WHEN last_type = 'signup' THEN 'failed with ' || bad END AS last_error,
  CASE WHEN lost THEN TIMESTAMP '{_NOW}' ELSE coalesce(last_ts, created_at) END AS updated_at FROM j)"""
_ISO = "%Y-%m-%dT%H:%M:%SZ"
_DUE_SQL = f"state = 'queued' AND (next_attempt IS NULL OR next_attempt <= TIMESTAMP '{_NOW}')"


def _now():
    return F.lit(_NOW.replace(" ", "T") + "Z").cast("timestamp")


def _ledger(spark, sf):
    item = F.concat_ws("-", "user_id", F.col("ts").cast("date").cast("string")).alias("item")
    e = load(spark, sf, "events").select("*", item).withColumn("ts", utc("ts"))
    kind = F.col("event_type")

    def n(name, column):
        return F.count_if(kind == name).alias(column)

    work = e.groupBy(F.col("item").alias("event_id")).agg(
        F.min("ts").alias("created_at"), n("view", "decisions"), n("click", "lessons"), n("error", "open_tasks"),
        n("purchase", "artefacts"),
    )
    work = work.withColumn("request_id", F.concat(F.lit("r"), "event_id"))
    attempts = e.filter(kind.isin("error", "purchase", "signup")).select(
        F.col("item").alias("event_id"), F.col("ts").alias("started_at"), F.col("event_id").alias("attempt_id"),
        F.when(kind == "error", "failed").when(kind == "purchase", "done").alias("outcome"),
        F.when(kind == "error", F.concat(F.lit("failed with "), F.col("value").cast("string"))).alias("error"),
        F.when(kind != "signup", F.col("ts")).alias("finished_at"),
    )
    return lifecycle(work, attempts, _now(), _STALE)


@query("lifecycle", f"""
WITH {_LEDGER_SQL} SELECT item AS event_id, state, attempts, strftime(next_attempt, '{_ISO}') AS next_attempt,
  last_error, strftime(updated_at, '{_ISO}') AS updated_at FROM ledger""")
def states(spark, sf):
    return _ledger(spark, sf).select(
        "event_id", "state", "attempts", to_iso(F.col("next_attempt")).alias("next_attempt"), "last_error",
        to_iso(F.col("updated_at")).alias("updated_at"),
    )


_STATS = ", ".join(f"count(*) FILTER (WHERE state = '{s}') AS {s}" for s in ("queued", "processing", "done", "dead"))


@query("ledger_stats", f"WITH {_LEDGER_SQL} SELECT {_STATS}, count(*) AS total FROM ledger")
def stats(spark, sf):
    return ledger_stats(_ledger(spark, sf))


@query("backlog_depth", f"WITH {_LEDGER_SQL} SELECT count(*) FILTER (WHERE state IN ('queued', 'processing')) AS depth FROM ledger")
def depth(spark, sf):
    return backlog_depth(_ledger(spark, sf))


@query("last_ingestion", f"""
WITH {_LEDGER_SQL} SELECT strftime(max(updated_at) FILTER (WHERE state = 'done'), '{_ISO}') AS last_ingestion FROM ledger""")
def last_ingestion(spark, sf):
    return last_done(_ledger(spark, sf)).select(to_iso(F.col("last_ingestion")).alias("last_ingestion"))


@query("due_events", f"""
WITH {_LEDGER_SQL} SELECT item AS event_id, strftime(next_attempt, '{_ISO}') AS next_attempt FROM ledger WHERE {_DUE_SQL}""")
def due(spark, sf):
    return due_events(_ledger(spark, sf), _now()).select(
        "event_id", to_iso(F.col("next_attempt")).alias("next_attempt")
    )


@query("due_order", f"""
WITH {_LEDGER_SQL} SELECT row_number() OVER (ORDER BY next_attempt, created_at, item) AS place, item AS event_id
FROM ledger WHERE {_DUE_SQL} QUALIFY place <= 200""")
def first_due(spark, sf):
    """The 200 events to take up next, with their place in the queue."""
    rows = oldest_first(due_events(_ledger(spark, sf), _now())).limit(200)
    return rows.select(
        F.row_number().over(Window.orderBy("next_attempt", "created_at", "event_id")).cast("bigint").alias("place"), "event_id"
    )


@query("dead_letters", f"""
WITH {_LEDGER_SQL} SELECT item AS event_id, attempts, last_error FROM ledger WHERE state = 'dead'
ORDER BY updated_at DESC, item LIMIT 20""")
def letters(spark, sf):
    return dead_letters(_ledger(spark, sf), 20).select("event_id", "attempts", "last_error")


@query("ledger_report", f"""
WITH {_LEDGER_SQL},
s AS (SELECT {_STATS}, count(*) AS total, count(*) FILTER (WHERE state IN ('queued', 'processing')) AS depth FROM ledger),
d AS (SELECT row_number() OVER (ORDER BY updated_at DESC, item) AS place, item, attempts, last_error, updated_at
  FROM ledger WHERE state = 'dead' QUALIFY place <= 20)
SELECT s.*, place, item AS event_id, 'r' || item AS request_id, attempts, last_error,
  strftime(updated_at, '{_ISO}') AS updated_at FROM s LEFT JOIN d ON true""")
def report(spark, sf):
    """The report, a row for each dead letter in it."""
    rows = ledger_report(_ledger(spark, sf))
    rows = rows.select("queued", "processing", "done", "dead", "total", "depth", F.posexplode_outer("dead_letters").alias("at", "d"))
    return rows.select(
        *rows.columns[:6], (F.col("at") + 1).cast("bigint").alias("place"), "d.event_id", "d.request_id", "d.attempts",
        "d.last_error", to_iso(F.col("d.updated_at")).alias("updated_at"),
    )


@query("event_state", f"""
WITH {_LEDGER_SQL} SELECT item AS event_id, state, attempts, last_error, 'agent' || item AS agent,
  views AS n_decisions, clicks AS n_lessons, errors AS n_open_tasks, purchases AS n_artefacts FROM ledger""")
def read_back(spark, sf):
    """A day's views stand for its event's decisions, clicks for lessons, errors for tasks, purchases for artefacts."""
    none = F.lit(None).cast("string")
    lists = ["decisions", "lessons", "open_tasks", "artefacts"]
    rows = _ledger(spark, sf).withColumns({
        "agent": F.concat(F.lit("agent"), "event_id"), "actor": none, "project": none, "session_id": none,
        "timestamp": none, "status": F.lit("completed"),
        **{c: F.array_repeat(F.lit("item"), F.col(c).cast("int")) for c in lists},
    })
    state = event_state(rows)
    return state.select(
        "event_id", "state", "attempts", "last_error", "provenance.agent",
        *[F.col(f"counts.{c}").cast("bigint").alias(f"n_{c}") for c in lists],
    )


# -- approvals: each event approves the document its user id names ------------------------------------------
_APPROVALS_SQL = f"""
{MEMORIES_SQL},
a AS (SELECT event_id AS ord, CASE WHEN event_type = 'error' THEN NULL ELSE user_id END AS decision_id, event_type FROM events),
d AS (SELECT memory_id, coalesce(status, 'proposed') AS old FROM memories WHERE type = 'decision'),
o AS (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY ord) AS n FROM a LEFT JOIN d ON decision_id = memory_id),
outcomes AS (SELECT ord, decision_id, event_type, old, CASE WHEN decision_id IS NULL THEN 'invalid_request' WHEN old IS NULL THEN 'not_found'
  WHEN old = 'proposed' AND n = 1 THEN 'changed' WHEN old IN ('proposed', 'approved') THEN 'already_approved'
  ELSE 'invalid_transition' END AS outcome FROM o)"""


def _approved(spark, sf):
    e = load(spark, sf, "events")
    approvals = e.select(
        F.col("event_id").alias("ord"), F.when(F.col("event_type") != "error", F.col("user_id")).alias("decision_id"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("approver"),
        utc("ts").alias("at"),
    )
    return apply_approvals(approvals, memories(spark, sf))


@query("approvals", f"WITH {_APPROVALS_SQL} SELECT ord, decision_id, outcome, outcome = 'changed' AS changed FROM outcomes")
def approved(spark, sf):
    return _approved(spark, sf).outcomes.select("ord", "decision_id", "outcome", "changed")


@query("approval_audit", f"""
WITH {_APPROVALS_SQL} SELECT ord, CASE WHEN event_type = 'view' THEN 'admin' ELSE event_type END AS src,
  'approved_decision' AS rel, 'decision:' || decision_id AS dst, old AS previous_status
FROM outcomes WHERE outcome = 'changed'""")
def audit_trail(spark, sf):
    return _approved(spark, sf).audit_edges.select(
        "ord", "src", "rel", "dst", F.col("meta")["previous_status"].alias("previous_status")
    )


@query("store_audit", f"""
WITH {_LEDGER_SQL}
SELECT count(*) AS total, count(*) FILTER (WHERE label < 5) AS matched, 'identity_mismatch' AS vector_store,
  'ready' AS graph_store, (SELECT count(*) FROM ledger WHERE state IN ('queued', 'processing')) AS queue_depth,
  'embedding_identity_mismatch' AS problems, 'degraded' AS status FROM embeddings""")
def audited(spark, sf):
    from mnemo.catalog.ranking_queries import _identity, _mixed

    audit = store_audit(_identity("new"), _mixed(spark, sf), load(spark, sf, "orders"), _ledger(spark, sf))
    return audit.select(
        "total", "matched", "vector_store", "graph_store", "queue_depth",
        F.array_join("problems", ",").alias("problems"), "status",
    )
