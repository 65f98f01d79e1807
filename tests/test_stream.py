"""Continuous ingest: idempotency and retries from state, isolation of failures, compaction."""

import hashlib
import json
import time
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemo.config import DEFAULT_RULES
from mnemo.operators import ledger
from mnemo.operators.upsert import node_id, pruned
from mnemo.plans.fanout import ingest_events
from mnemo.sources.events import event_rows, parse_events, split_events
from mnemo.streaming.ingest import EventIngest, Store, batch_counts, idle
from mnemo.streaming.requests import OUTPUT, RequestState, incoming
from mnemo.streaming.store import BatchTables, Table

FULL = {
    "event_id": "e1", "request_id": "r1", "agent": "builder", "project": "mem", "result_summary": "The work is done",
    "status": "completed", "timestamp": "2026-01-01T00:00:00Z", "decisions": [{"text": "Use one table"}],
    "lessons": [{"text": "Test the roadmap first"}], "artefacts": [{"path_or_ref": "pkg/new.py", "kind": "file"}],
}


def picky():
    """A model of the user's own, which fails on some text. Local, so that it travels to the workers."""
    @dataclass(frozen=True)
    class Picky:
        name: str = "picky"
        model: str = "v1"
        dimensions: int = 3

        def embed_batch(self, texts):
            if any("poison" in t for t in texts):
                raise ValueError("cannot embed this")
            return np.array([[len(t), 1.0, 0.0] for t in texts], np.float32).reshape(-1, 3)

    return Picky()


@pytest.fixture
def place(spark, tmp_path):
    (tmp_path / "in").mkdir()
    # A few rows a batch: one partition of state starts one worker instead of four.
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield Store(spark, str(tmp_path / "store")), tmp_path / "in"
    spark.conf.set("spark.sql.shuffle.partitions", before)


def put(folder, name, *events):
    (folder / name).write_text("\n".join(e if isinstance(e, str) else json.dumps(e) for e in events))


def states(run):
    return {r.event_id: (r.state, r.attempts) for r in run.ledger().collect()}


def test_stream_equals_batch_and_knows_old_requests(spark, place):
    store, folder = place
    run = EventIngest(store)
    put(folder, "a.json", FULL, "broken")
    run.drain(str(folder), 120)
    second = {"event_id": "e2", "request_id": "r2", "lessons": [{"text": "stream lesson"}]}
    put(folder, "b.json", FULL, {**FULL, "prompt": "changed"}, second, second, {**FULL, "timestamp": "later", "event_id": "e9"})
    run.drain(str(folder), 120)
    rows = [(i, json.dumps(e)) for i, e in enumerate([FULL, second])]
    valid = event_rows(split_events(parse_events(spark.createDataFrame(rows, "ord int, value string")))[0])
    batch = ingest_events(valid)
    shown = ["memory_id", "type", "text", "project", "status"]
    assert sorted(map(tuple, store.knowledge.select(*shown).collect())) == sorted(map(tuple, batch.knowledge.select(*shown).collect()))
    assert (store.edges.count(), store.nodes.count()) == (1, 2)
    assert states(run) == {"e1": ("done", 1), "e2": ("done", 1)}
    assert [(r.value, r.error_code) for r in store.quarantine.collect()] == [("broken", "not_json")]
    notes = sorted((r.request_id, r.duplicate, r.payload_mismatch) for r in store.accepts.collect())
    assert notes == [("r1", False, False), ("r1", True, False), ("r1", True, False), ("r1", True, True), ("r2", False, False), ("r2", True, False)]


def test_a_failing_event_is_retried_without_input_while_others_are_stored(spark, place):
    store, folder = place
    # Three attempts a second apart; the schedule of five is checked on the state below.
    run = EventIngest(store, picky(), DEFAULT_RULES.with_(backoff_cap_seconds=1, max_attempts=3))
    others = [{"event_id": f"e{i}", "request_id": f"r{i}", "lessons": [{"text": f"lesson {i}"}]} for i in range(2)]
    put(folder, "a.json", *others, {"event_id": "bad", "request_id": "bad", "lessons": [{"text": "poison"}]})
    query = run.start(str(folder), every="0 seconds")
    try:
        end = time.monotonic() + 600
        # Not within a batch that feeds: the state has the last outcome, and nothing is left to do.
        while store.read("outcomes").filter("event_id = 'bad' AND attempt = 3").isEmpty() or not idle(query.lastProgress):
            assert query.exception() is None and time.monotonic() < end
            time.sleep(1)
    finally:
        query.stop()
    got = {r.event_id: r for r in run.ledger().collect()}
    assert {k: (r.state, r.attempts) for k, r in got.items()} == {**{f"e{i}": ("done", 1) for i in range(2)}, "bad": ("dead", 3)}
    assert "cannot embed this" in got["bad"].last_error
    kept = store.knowledge.collect()
    assert sorted(r.text for r in kept) == [f"lesson {i}" for i in range(2)]
    assert {r.embed_identity.backend for r in kept} == {"picky"}
    counted = [batch_counts(p) for p in query.recentProgress]
    assert sum(c.get("accept", 0) for c in counted) == 3 and sum(c.get("retry", 0) for c in counted) == 2


class Handle:
    """State and timers of one key, in memory."""

    def __init__(self):
        self.value, self.timers = None, set()

    def getValueState(self, name, schema):
        return SimpleNamespace(exists=lambda: self.value is not None, get=lambda: self.value, update=lambda v: setattr(self, "value", v))

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


def clock(ms):
    return SimpleNamespace(getCurrentProcessingTimeInMs=lambda: ms)


def event(payload="p", event_id="e"):
    return SimpleNamespace(kind="event", event_id=event_id, value="{}", payload_hash=payload)


def outcome(attempt, how):
    return SimpleNamespace(kind="outcome", event_id="e", attempt=attempt, outcome=how)


def machine(**rules):
    handle, state = Handle(), RequestState(DEFAULT_RULES.with_(**rules), 300)
    state.init(handle)

    def fire():
        at = min(handle.timers)
        handle.timers.discard(at)
        return at, [(r.action, r.attempt) for r in state.handleExpiredTimer(("r",), clock(at), None)]

    def tell(ms, *rows):
        return [(r.action, r.attempt, r.payload_mismatch) for r in state.handleInputRows(("r",), iter(rows), clock(ms))]

    return handle, fire, tell


def test_state_backs_off_and_dies():
    handle, fire, tell = machine()
    assert tell(0, event(), event("q"), event("p", "other")) == [("accept", 1, False), ("duplicate", None, True), ("duplicate", None, False)]
    waits = []
    for attempt in range(1, 5):
        assert tell(1000, outcome(attempt, "failed")) == []
        at, out = fire()
        waits.append((at - 1000) // 1000)
        assert out == [("retry", attempt + 1)]
    assert waits == [2, 4, 8, 16]
    assert tell(1000, outcome(5, "failed")) == [] and handle.timers == set()
    assert handle.value[2] is None and handle.value[5] == "dead"
    assert tell(9000, event()) == [("duplicate", None, False)]


def test_a_lost_attempt_is_started_again_and_its_late_outcome_is_ignored():
    handle, fire, tell = machine(max_attempts=2)
    tell(0, event())
    assert fire() == (300_000, [("retry", 2)])
    tell(300_500, outcome(1, "done"))
    assert handle.value[5] == "running"
    assert fire() == (600_000, []) and handle.value[5] == "dead"
    handle, fire, tell = machine()
    tell(0, event(), outcome(1, "done"), outcome(1, "done"))
    assert handle.value[5] == "done" and handle.timers == set()


def todo(spark, batch, events):
    rows = [(e["request_id"], "accept", e["event_id"], json.dumps(e), "h", False, None, None, 1, 1000 * batch, 1000 * batch) for e in events]
    return spark.createDataFrame(rows, OUTPUT)


def test_a_replayed_batch_adds_nothing(spark, place):
    store, _ = place
    run = EventIngest(store)
    for _ in range(2):
        run.run_batch(todo(spark, 0, [FULL]), 0)
        assert (store.knowledge.count(), store.edges.count(), store.events.count(), store.attempts.count()) == (3, 1, 1, 2)
    assert states(run) == {"e1": ("done", 1)}
    assert "_scratch" not in store.files.names(store.root) or not store.files.names(f"{store.root}/_scratch")


def test_a_batch_reads_its_own_key_prefixes_however_many_batches_there_were(spark, place):
    store, _ = place
    run, most = EventIngest(store), []
    store.fan = 2
    for b in range(5):
        e = {"event_id": f"e{b}", "request_id": f"r{b}", "agent": "builder", "artefacts": [{"path_or_ref": f"pkg/{b}.py"}]}
        run.run_batch(todo(spark, b, [e]), b)
        keys = spark.range(1).select(node_id(F.lit("builder"), F.lit("entity")).alias("node_id"))
        most.append(pruned(store.nodes, keys, "node_id").select(F.input_file_name()).distinct().count())
    assert max(len(store.folders(n)) for n in store.tables) <= 2 * 3 + 2
    # One agent, five artefacts: the agent's node is found in its folder each time.
    assert store.nodes.count() == 6 and store.edges.count() == 5
    assert max(most) <= 2 and states(run) == {f"e{b}": ("done", 1) for b in range(5)}


@pytest.fixture
def small(spark, tmp_path):
    schema = spark.createDataFrame([], "k string, n long").schema
    return BatchTables(spark, str(tmp_path / "tables"), {"t": Table(schema, keyed="k"), "u": Table(schema)}, fan=4)


def fill(tables, batch):
    df = tables.spark.createDataFrame([(f"{batch % 7:02x}", batch)], "k string, n long").coalesce(1)
    tables.write("t", df, batch)
    if batch % 2:
        tables.write("u", df, batch)


def numbers(tables, name="t"):
    return sorted(r.n for r in tables.read(name).collect())


def test_folders_stay_few_over_many_batches(small):
    for b in range(50):
        fill(small, b)
        small.compact(b - 2)
        assert len(small.folders("t")) <= 3 * 4 + 2
    assert numbers(small) == list(range(50)) and numbers(small, "u") == list(range(1, 50, 2))
    assert [r.n for r in small.read("t").filter("prefix = '03'").orderBy("n").collect()] == list(range(3, 50, 7))
    # What was merged is gone from disk one switch later.
    assert len(small.files.names(f"{small.root}/t")) <= 2 * 4 + 2


@pytest.mark.parametrize("late", [False, True])
def test_a_crash_around_the_switch_loses_and_doubles_nothing(small, monkeypatch, late):
    for b in range(6):
        fill(small, b)
    switch = small._switch

    def crash(manifest):
        if late:
            switch(manifest)
        raise RuntimeError("crash")

    monkeypatch.setattr(small, "_switch", crash)
    with pytest.raises(RuntimeError):
        small.compact(4)
    assert numbers(small) == list(range(6))
    monkeypatch.setattr(small, "_switch", switch)
    for b in range(6, 12):
        fill(small, b)
        small.compact(b - 1)
    assert numbers(small) == list(range(12))


def test_a_late_replay_of_a_merged_batch_is_not_read_twice(small):
    for b in range(6):
        fill(small, b)
    small.compact(4)
    fill(small, 3)
    assert numbers(small) == list(range(6))


def test_a_key_costs_few_calls_of_its_state():
    handle, _, tell = machine()
    calls = []
    state = handle.getValueState("request", "")

    def noted(name, call):
        return lambda *a: calls.append(name) or call(*a)

    told = {n: noted(n, getattr(state, n)) for n in ("exists", "get", "update")}
    handle.getValueState = lambda name, schema: SimpleNamespace(**told)
    for name in ("listTimers", "registerTimer", "deleteTimer"):
        setattr(handle, name, noted(name, getattr(handle, name)))
    state = RequestState(DEFAULT_RULES, 300)
    state.init(handle)

    def cost(*rows):
        calls.clear()
        return len(list(state.handleInputRows(("r",), iter(rows), clock(0)))), list(calls)

    assert cost(event()) == (1, ["get", "update", "registerTimer"])
    assert cost(*[event()] * 50) == (50, ["get"])
    assert cost(outcome(1, "done")) == (0, ["get", "update", "deleteTimer"])
    assert handle.timers == set() and handle.value[5] == "done"


def test_a_request_is_done_though_its_timer_was_set_with_another_limit():
    handle, fire, tell = machine()
    tell(0, event())
    handle.timers = {60_000}
    tell(1000, outcome(1, "done"))
    assert handle.value[5] == "done" and fire() == (60_000, []) and handle.timers == set()
    assert tell(70_000, event()) == [("duplicate", None, False)]


def test_lines_are_parsed_once(spark, tmp_path, capsys):
    put(tmp_path, "a.json", FULL, {**FULL, "event_id": " "}, "broken", '{"request_id": 7}')
    rows = incoming(spark.read.text(str(tmp_path / "a.json")))
    rows.explain()
    assert capsys.readouterr().out.count("FileScan text") == 1
    got = {(r.kind, r.request_id[0] == "\0", r.event_id, r.payload_hash is None, r.error_code) for r in rows.collect()}
    given = f"evt_{hashlib.md5(b'r1').hexdigest()}"
    assert got == {
        ("event", False, "e1", False, None), ("event", False, given, False, None),
        ("invalid", True, None, True, "not_json"), ("invalid", True, None, True, "not_a_string"),
    }


@pytest.mark.parametrize("replanned", [False, True])
def test_a_drain_ends_with_the_first_idle_batch_that_was_planned_by_it(replanned, monkeypatch):
    def batch(n, rows, started=0):
        counts = SimpleNamespace(asDict=lambda: {"started": started})
        return {"batchId": n, "numInputRows": rows, "observedMetrics": {"requests": counts}}

    # A batch of the last run is idle, as it could not see the new files.
    told = [batch(4, 0)] * 3 * replanned + [batch(5, 1, 1), batch(6, 1), batch(7, 0, 1), batch(8, 1), batch(9, 0)]

    class Query:
        stopped = False
        lastProgress = property(lambda self: told.pop(0))

        def exception(self):
            return None

        def stop(self):
            self.stopped = True

    query, run = Query(), EventIngest(None)
    monkeypatch.setattr(run, "start", lambda folder, every: query)
    monkeypatch.setattr(time, "sleep", lambda seconds: None)
    run.drain("in", 60)
    assert query.stopped and told == []
