"""Event ledger: idempotent accept, retries with backoff, and its reports.

State is never updated in place. Events and attempts are append-only tables and
an event's state is an aggregate over its attempts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from mnemo.config import DEFAULT_RULES, LEDGER_STATES, VOLATILE_EVENT_FIELDS, Rules
from mnemo.functions.redact import redact_text
from mnemo.functions.scalars import backoff_seconds
from mnemo.operators.audit import side_by_side
from mnemo.operators.upsert import INSERTED, resolve

LOST_WORKER = "the last attempt allowed ended without an outcome"


def payload_hash(payload: Sequence[str]) -> Column:
    """Hash of the material fields; re-sending with another time or id is no change."""
    material = [F.col(c) for c in payload if c not in VOLATILE_EVENT_FIELDS]
    return F.sha2(F.to_json(F.struct(*material)), 256)


def classify_duplicates(
    incoming: DataFrame,
    stored: DataFrame | None,
    payload: Sequence[str],
    order: Sequence[str] = ("ord",),
) -> DataFrame:
    """Every incoming event with ``queued``, ``duplicate`` and ``payload_mismatch``.

    The first payload of a ``request_id`` wins, be it stored before or earlier
    in this batch. ``stored`` holds (request_id, payload_hash).
    """
    hashed = incoming.withColumn("payload_hash", payload_hash(payload))
    judged = resolve(hashed, stored, ["request_id"], order, carry="payload_hash")
    return judged.withColumns({
        "queued": F.col("verdict") == INSERTED,
        "duplicate": F.col("verdict") != INSERTED,
        "payload_mismatch": F.col("payload_hash") != F.col("_winner"),
    }).drop("verdict", "_winner")


def lifecycle(
    events: DataFrame,
    attempts: DataFrame,
    now: Column | None = None,
    stale_seconds: int = 300,
    rules: Rules = DEFAULT_RULES,
) -> DataFrame:
    """State of every event from its attempts.

    ``attempts`` is (event_id, started_at, outcome, error, finished_at) with an
    optional attempt number; outcome is done, failed or NULL while running. A
    run without an outcome for ``stale_seconds`` counts as lost.
    """
    now = F.current_timestamp() if now is None else now
    number = F.max("attempt") if "attempt" in attempts.columns else F.count("*")
    order = ["started_at"] + [c for c in ("attempt", "attempt_id") if c in attempts.columns]
    runs = attempts.groupBy("event_id").agg(
        number.alias("attempts"),
        F.max(F.struct(*order, "outcome", "error", "finished_at")).alias("last"),
        # The last error known, for a run that was lost without leaving one.
        F.max(F.when(F.col("error").isNotNull(), F.struct(*order, "error"))).alias("bad"),
    )
    joined = events.join(runs, "event_id", "left")
    tries = F.coalesce("attempts", F.lit(0)).cast("bigint")
    outcome, spent = F.col("last.outcome"), tries >= rules.max_attempts
    finished = F.col("last.finished_at")
    lost = F.col("last").isNotNull() & outcome.isNull() & (
        F.col("last.started_at") < now - F.make_dt_interval(secs=F.lit(stale_seconds))
    )
    state = (
        F.when(F.col("last").isNull(), "queued")
        .when(outcome == "done", "done")
        .when((outcome == "failed") & spent, "dead")
        .when(outcome == "failed", "queued")
        .when(lost & spent, "dead")
        .when(lost, "queued")
        .otherwise("processing")
    )
    wait = F.make_dt_interval(secs=backoff_seconds(tries.cast("int"), rules))
    due = (
        F.when(F.col("last").isNull(), F.col("created_at"))
        .when((outcome == "failed") & ~spent, finished + wait)
        .when(lost & ~spent, now)
    )
    error = (
        F.when(outcome == "failed", F.substring("last.error", 1, 1000))
        .when(lost & spent, F.substring(F.coalesce("bad.error", F.lit(LOST_WORKER)), 1, 1000))
        .when(lost | outcome.isNull(), F.substring("bad.error", 1, 1000))
    )
    updated = F.when(lost, now).otherwise(
        F.coalesce(finished, "last.started_at", "created_at")
    )
    return joined.withColumns({
        "state": state, "attempts": tries, "next_attempt": due, "last_error": error,
        "updated_at": updated,
    }).drop("last", "bad")


def due_events(ledger: DataFrame, now: Column | None = None) -> DataFrame:
    """Queued and due, for the caller to order; ``oldest_first`` does."""
    now = F.current_timestamp() if now is None else now
    due = F.col("next_attempt").isNull() | (F.col("next_attempt") <= now)
    return ledger.filter((F.col("state") == "queued") & due)


def oldest_first(due: DataFrame) -> DataFrame:
    return due.orderBy("next_attempt", "created_at", "event_id")


def ledger_stats(ledger: DataFrame) -> DataFrame:
    """One row: a count per state, zero when none, and their total."""
    counts = [F.count_if(F.col("state") == s).alias(s) for s in LEDGER_STATES]
    return ledger.agg(*counts, F.count_if(F.col("state").isin(LEDGER_STATES)).alias("total"))


def backlog_depth(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.count_if(F.col("state").isin("queued", "processing")).alias("depth"))


def last_done(ledger: DataFrame) -> DataFrame:
    return ledger.agg(
        F.max(F.when(F.col("state") == "done", F.col("updated_at"))).alias("last_ingestion")
    )


def dead_letters(ledger: DataFrame, limit: int = 50) -> DataFrame:
    """Newest dead events; ``limit`` is the size of the report."""
    return (
        ledger.filter(F.col("state") == "dead")
        .orderBy(F.col("updated_at").desc(), F.col("event_id"))
        .limit(limit)
    )


def ledger_report(ledger: DataFrame, letters: int = 20) -> DataFrame:
    """One row: stats, depth and the newest dead letters, errors masked."""
    dead = dead_letters(ledger, letters).agg(F.array_sort(F.collect_list(F.struct(
        (-F.unix_micros("updated_at")).alias("newest"), "event_id", "request_id", "attempts",
        F.substring(redact_text(F.coalesce("last_error", F.lit(""))), 1, 300).alias("last_error"),
        "updated_at",
    ))).alias("dead_letters"))
    dead = dead.select(F.transform(
        "dead_letters", lambda d: d.dropFields("newest")
    ).alias("dead_letters"))
    stats = ledger_stats(ledger).withColumn("depth", F.col("queued") + F.col("processing"))
    return side_by_side(stats, dead)


def event_state(ledger: DataFrame) -> DataFrame:
    """What may be told about an event: state, provenance and counts, never its content."""
    return ledger.select(
        "event_id", "request_id", "state", "attempts", "created_at", "updated_at",
        "next_attempt",
        F.struct(
            "actor", "agent", "project", "session_id", "timestamp",
            F.col("status").alias("event_status"),
        ).alias("provenance"),
        content_counts().alias("counts"),
        F.substring(redact_text(F.col("last_error")), 1, 300).alias("last_error"),
    )


def content_counts() -> Column:
    def size(c: str) -> Column:
        return F.coalesce(F.size(F.col(c)), F.lit(0)).alias(c)

    # size(NULL) is -1 or NULL depending on a legacy setting; both mean none.
    return F.struct(*[
        F.greatest(size(c), F.lit(0)).alias(c)
        for c in ("decisions", "lessons", "open_tasks", "artefacts")
    ])
