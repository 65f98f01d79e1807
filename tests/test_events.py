import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from mnemo.operators import ledger
from mnemo.plans.approvals import apply_approvals
from mnemo.plans.fanout import ingest_events
from mnemo.sources.events import coerced_decisions, event_rows, parse_events, split_events

FULL = {
    "event_id": "e1", "request_id": "r1", "session_id": "s", "actor": "someone", "agent": "builder", "project": "mem",
    "prompt": "do it", "result_summary": "The work is done", "status": "completed", "timestamp": "2026-01-01T00:00:00Z",
    "decisions": [{"text": "Use one table", "status": "approved"}],
    "lessons": [{"text": "Test the roadmap first", "project": "other"}],
    "open_tasks": [{"title": "Write the guide", "status": "open"}],
    "artefacts": [{"path_or_ref": "pkg/new.py", "kind": "file"}],
}


def lines(spark, *events):
    rows = [(i, e if isinstance(e, str) else json.dumps(e)) for i, e in enumerate(events)]
    return spark.createDataFrame(rows, "ord int, value string")


def valid(spark, *events):
    return event_rows(split_events(parse_events(lines(spark, *events)))[0])


def test_validation_reports_the_first_broken_rule(spark):
    bad = [
        "no json", "[1]", {}, {"request_id": 5}, {"request_id": "x" * 201}, {"request_id": "a", "status": "odd"},
        {"request_id": "a", "decisions": {}}, {"request_id": "a", "decisions": [{"status": "maybe"}]},
        {"request_id": "a", "lessons": [1]}, {"request_id": "a", "open_tasks": [{}] * 101}, {"request_id": "a", "prompt": "x" * 32001},
        {"request_id": "a", "actor": []}, {"request_id": "a", "timestamp": 4},
    ]
    rows = parse_events(lines(spark, *bad)).orderBy("ord").collect()
    assert [(r.error_code, r.error_field) for r in rows] == [
        ("not_json", None), ("not_an_object", None), ("required", "request_id"), ("not_a_string", "request_id"),
        ("too_long", "request_id"), ("unknown_status", "status"), ("not_an_array", "decisions"), ("unknown_status", "decisions"),
        ("not_an_object", "lessons"), ("too_many_items", "open_tasks"), ("too_long", "prompt"), ("not_a_string", "actor"),
        ("not_a_string", "timestamp")]
    assert all(r.event is None for r in rows)
    fine = parse_events(lines(spark, FULL, {"request_id": "a", "status": "FAILED", "prompt": "", "lessons": None})).collect()
    assert [r.error_code for r in fine] == [None, None]
    assert fine[1].event.status == "failed"


def test_self_approval_becomes_a_proposal(spark):
    event = {"request_id": "r", "decisions": [{"text": "a", "status": s} for s in ("APPROVED", "rejected", "", "superseded")]}
    row = valid(spark, event).select("decisions", coerced_decisions(F.col("decisions")).alias("c")).first()
    assert [d.status for d in row.decisions] == ["proposed", "rejected", "proposed", "superseded"]
    assert [d.submitted_status for d in row.decisions] == ["approved", None, None, None]
    assert [(c["index"], c.stored_status) for c in row.c] == [(0, "proposed")]


def test_fan_out(spark):
    made = ingest_events(valid(spark, FULL))
    rows = {r.section: r for r in made.knowledge.collect()}
    assert {s: (r.type, r.status, r.project) for s, r in rows.items()} == {
        "decisions": ("decision", "proposed", "mem"), "lessons": ("knowledge", "approved", "other"),
        "open_tasks": ("task", "proposed", "mem"), "summary": ("experience", "approved", "mem")}
    # A lesson is no judgement, so the gated axis does not attach to it.
    assert rows["lessons"].experts == [] and rows["decisions"].source == "agent_event:e1"
    edge = made.edges.first()
    assert (edge.src_label, edge.rel, edge.dst_label, edge.project) == ("builder", "produced", "pkg/new.py", "mem")
    assert made.nodes.count() == 2
    c = made.counts.first()
    assert (c.decisions, c.lessons, c.open_tasks, c.summary, c.artefacts, c.skipped_count) == (1, 1, 1, 1, 1, 0)


def test_empty_failed_and_blank_events(spark):
    made = ingest_events(valid(spark, {"request_id": "a", "lessons": [{"text": " "}, {}]},
                               {"request_id": "b", "status": "failed", "result_summary": "broke"}))
    assert [(r.text, r.status) for r in made.knowledge.collect()] == [("broke", "rejected")]
    assert sorted(c.summary for c in made.counts.collect()) == [0, 1]


def test_same_text_in_two_events_is_kept_twice_in_one_event_once(spark):
    two = [{"event_id": f"e{i}", "request_id": f"r{i}", "project": f"p{i}", "lessons": [{"text": "same"}] * 2} for i in (1, 2)]
    made = ingest_events(valid(spark, *two))
    assert sorted((r.text, r.project) for r in made.knowledge.collect()) == [("same", "p1"), ("same", "p2")]
    assert [r.reason for r in made.skipped.collect()] == ["duplicate_fingerprint"] * 2
    again = ingest_events(valid(spark, *two), knowledge=made.knowledge, edges=made.edges, nodes=made.nodes)
    assert again.knowledge.count() == 0


def test_resent_requests(spark):
    first = valid(spark, FULL)
    fields = [c for c in first.columns if c not in ("ord", "value")]
    stored = ledger.classify_duplicates(first, None, fields).select("request_id", "payload_hash")
    resent = valid(spark, {**FULL, "timestamp": "2027-01-01", "event_id": "e9"}, {**FULL, "prompt": "other"}, {"request_id": "new"},
                   {"request_id": "new", "prompt": "x"})
    got = ledger.classify_duplicates(resent, stored, fields).orderBy("ord").collect()
    assert [(r.queued, r.duplicate, r.payload_mismatch) for r in got] == [
        (False, True, False), (False, True, True), (True, False, False), (False, True, True)]


T0 = datetime(2026, 1, 1)


def make_ledger(spark, attempts, now, created=T0):
    ids = sorted({a[0] for a in attempts} | {"none"})
    events = spark.createDataFrame([(i, "r" + i, created) for i in ids], "event_id string, request_id string, created_at timestamp")
    runs = spark.createDataFrame(attempts, "event_id string, attempt long, started_at timestamp, outcome string, error string, finished_at timestamp")
    return ledger.lifecycle(events, runs, F.lit(now), 300)


def failures(event, n):
    return [(event, i, T0 + timedelta(minutes=i), "failed", f"boom {i} " + "x" * 2000, T0 + timedelta(minutes=i)) for i in range(1, n + 1)]


def test_lifecycle(spark):
    minute = T0 + timedelta(minutes=1)
    runs = failures("retry", 2) + failures("dead", 5) + [
        ("done", 1, T0, "failed", "e", T0), ("done", 2, minute, "done", None, minute), ("run", 1, T0 + timedelta(hours=1), None, None, None),
        ("lost", 1, T0, None, None, None), ("crash", 5, T0, None, None, None), ("replay", 1, T0, None, None, None), ("replay", 1, T0, "done", None, minute),
    ]
    now = T0 + timedelta(hours=1)
    table = make_ledger(spark, runs, now)
    got = {r.event_id: r for r in table.collect()}
    assert {k: r.state for k, r in got.items()} == {
        "retry": "queued", "dead": "dead", "done": "done", "run": "processing", "lost": "queued", "crash": "dead", "none": "queued", "replay": "done"}
    assert got["retry"].next_attempt == T0 + timedelta(minutes=2, seconds=4)
    assert len(got["retry"].last_error) == 1000 and got["dead"].next_attempt is None
    assert got["crash"].last_error == ledger.LOST_WORKER and got["done"].last_error is None
    assert got["lost"].next_attempt == now and got["replay"].attempts == 1
    assert [r.event_id for r in ledger.oldest_first(ledger.due_events(table, F.lit(now))).collect()] == ["none", "retry", "lost"]
    stats = ledger.ledger_stats(table).first()
    assert (stats.queued, stats.processing, stats.done, stats.dead, stats.total) == (3, 1, 2, 2, 8)
    assert ledger.backlog_depth(table).first().depth == 4
    assert ledger.last_done(table).first().last_ingestion == minute
    report = ledger.ledger_report(table, 1).first()
    assert [d.event_id for d in report.dead_letters] == ["crash"] and report.depth == 4


def test_an_empty_ledger_is_all_zero(spark):
    table = make_ledger(spark, failures("x", 1), T0).limit(0)
    assert tuple(ledger.ledger_stats(table).first()) == (0, 0, 0, 0, 0)
    assert ledger.ledger_report(table).first().dead_letters == []


def test_read_back_never_shows_content(spark):
    table = make_ledger(spark, [("e1", 1, T0, "failed", "api_key=abcd1234", T0)], T0).filter("event_id = 'e1'")
    rows = table.join(valid(spark, FULL).drop("request_id", "ord"), "event_id")
    row = ledger.event_state(rows).first()
    assert tuple(row.counts) == (1, 1, 1, 1) and row.provenance.agent == "builder"
    assert row.last_error == "api_key=[REDACTED]"
    assert "do it" not in str(row) and "Use one table" not in str(row)


def test_approvals(spark):
    k = spark.createDataFrame(
        [("p", "decision", "proposed"), ("n", "decision", None), ("a", "decision", "approved"), ("r", "decision", "rejected"), ("t", "task", "proposed")],
        "memory_id string, type string, status string")
    asked = spark.createDataFrame(
        [(1, "p", " me ", T0), (2, "p", "you", T0), (3, "n", "", T0), (4, "a", None, T0), (5, "r", None, T0), (6, "t", None, T0), (7, None, None, T0)],
        "ord int, decision_id string, approver string, at timestamp")
    done = apply_approvals(asked, k)
    assert {r.ord: r.outcome for r in done.outcomes.collect()} == {
        1: "changed", 2: "already_approved", 3: "changed", 4: "already_approved", 5: "invalid_transition", 6: "not_found", 7: "invalid_request"}
    assert sorted(r.memory_id for r in done.status_log.collect()) == ["n", "p"]
    edges = {(r.src, r.rel, r.dst) for r in done.audit_edges.collect()}
    assert edges == {("me", "approved_decision", "decision:p"), ("admin", "approved_decision", "decision:n")}


def test_old_decisions_are_found_among_thousands(spark):
    k = spark.range(3000).select(F.col("id").alias("memory_id"), F.lit("decision").alias("type"), F.lit("proposed").alias("status"))
    asked = spark.createDataFrame([(1, 0, None, T0), (2, 2999, None, T0)], "ord int, decision_id long, approver string, at timestamp")
    assert {r.outcome for r in apply_approvals(asked, k).outcomes.collect()} == {"changed"}
