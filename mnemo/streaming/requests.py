"""Requests as keyed state: idempotency without a horizon, and retries by timer.

The state of a request id is its first payload's hash and how far its event got. It never expires,
so a repeated request is recognised without reading any table, whatever its age. A timer is set
when an attempt starts (it counts as lost unless an outcome comes in time) and when one fails
(the next starts when its backoff is over), so retries need no new input. The payload is kept
only while the event is open.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor

from mnemo.config import DEFAULT_RULES, Rules
from mnemo.operators.ledger import payload_hash
from mnemo.schema import EVENT
from mnemo.sources.events import event_rows, parse_events

#: What goes in: events, lines that are none, and outcomes of attempts.
INPUT = (
    "request_id string, kind string, event_id string, value string, payload_hash string, error_code string, "
    "error_field string, attempt long, outcome string"
)
#: What comes out: accept, duplicate, invalid, retry; attempt is set where one starts. Times are milliseconds.
OUTPUT = (
    "request_id string, action string, event_id string, value string, payload_hash string, "
    "payload_mismatch boolean, error_code string, error_field string, attempt long, created_at long, at long"
)
STATE = "payload_hash string, event_id string, value string, created_at long, attempts long, status string"
RUNNING, WAITING, DONE, DEAD = "running", "waiting", "done", "dead"


def incoming(lines: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Text lines as input of the state, read once. Lines that are no events have keys of their own."""
    good = F.col("error_code").isNull()
    rows = event_rows(parse_events(lines.select("value"), rules)).withColumns({
        "request_id": F.when(good, F.col("request_id")).otherwise(F.concat(F.lit("\0"), F.md5("value"))),
        "payload_hash": F.when(good, payload_hash([f.name for f in EVENT.fields])),
    })
    kind = F.when(good, "event").otherwise("invalid")
    return _as_input(rows, kind, "request_id", "event_id", "value", "payload_hash", "error_code", "error_field")


def finished(outcomes: DataFrame) -> DataFrame:
    """Outcomes (request_id, event_id, attempt, outcome) as input of the state."""
    return _as_input(outcomes, F.lit("outcome"), "request_id", "event_id", "attempt", "outcome")


def _as_input(df: DataFrame, kind: Column, *columns: str) -> DataFrame:
    def column(name: str, type_: str) -> Column:
        value = kind if name == "kind" else F.col(name) if name in columns else F.lit(None)
        return value.cast(type_).alias(name)

    return df.select(*[column(*c.split()) for c in INPUT.split(", ")])


class RequestState(StatefulProcessor):
    def __init__(self, rules: Rules = DEFAULT_RULES, stale_seconds: float = 300):
        self.most, self.base, self.cap = rules.max_attempts, rules.backoff_base, rules.backoff_cap_seconds
        self.stale_seconds = stale_seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("request", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # Every call of the state or its timers is a round trip to the JVM, so a key's state is asked for once.
        now, asked = timerValues.getCurrentProcessingTimeInMs(), False
        for row in rows:
            if row.kind == "invalid":
                yield self._row(key, "invalid", now, value=row.value, error_code=row.error_code, error_field=row.error_field)
                continue
            if not asked:
                self.held, asked = self.state.get(), True
            if row.kind == "event":
                yield self._event(key, row, now)
            else:
                self._outcome(row, now)

    def _event(self, key, row, now: int) -> Row:
        if self.held is not None:
            return self._row(
                key, "duplicate", now, event_id=row.event_id, payload_mismatch=row.payload_hash != self.held[0]
            )
        self._hold(row.payload_hash, row.event_id, row.value, now, 1, RUNNING)
        # A request that was not known has no timer to take back.
        self.handle.registerTimer(now + self._stale())
        return self._row(
            key, "accept", now, event_id=row.event_id, value=row.value, payload_hash=row.payload_hash,
            payload_mismatch=False, attempt=1, created_at=now,
        )

    def _outcome(self, row, now: int) -> None:
        held = self.held
        if held is None or held[4] != row.attempt or held[5] != RUNNING:
            return  # told twice, or of an attempt that counts as lost
        first, event_id, value, created, attempts, _ = held
        if row.outcome == "done" or attempts >= self.most:
            self._hold(first, event_id, None, created, attempts, DONE if row.outcome == "done" else DEAD)
            if attempts == 1 and self.held[5] == DONE:
                # Nearly every request: its one timer was set on acceptance. One that was set with
                # another ``stale_seconds`` stays, and finds the request done.
                self.handle.deleteTimer(created + self._stale())
            else:
                self._wake(None)
        else:
            self._hold(first, event_id, value, created, attempts, WAITING)
            self._wake(now + 1000 * min(self.cap, self.base ** min(attempts, 20)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        first, event_id, value, created, attempts, status = self.state.get()
        if status in (DONE, DEAD):
            return
        if attempts >= self.most:
            self.state.update((first, event_id, None, created, attempts, DEAD))
            return
        self.state.update((first, event_id, value, created, attempts + 1, RUNNING))
        self._wake(now + self._stale())
        yield self._row(key, "retry", now, event_id=event_id, value=value, attempt=attempts + 1, created_at=created)

    def close(self) -> None:
        pass

    def _hold(self, *held) -> None:
        self.held = held
        self.state.update(held)

    def _stale(self) -> int:
        return int(1000 * self.stale_seconds)

    def _wake(self, at: int | None) -> None:
        """One timer at most is set."""
        for other in list(self.handle.listTimers()):
            self.handle.deleteTimer(other)
        if at is not None:
            self.handle.registerTimer(at)

    @staticmethod
    def _row(key, action: str, now: int, **values) -> Row:
        names = [c.split()[0] for c in OUTPUT.split(", ")]
        known = {"request_id": key[0], "action": action, "at": now, **values}
        return Row(**{n: known.get(n) for n in names})


def actions(rows: DataFrame, rules: Rules = DEFAULT_RULES, stale_seconds: float = 300) -> DataFrame:
    """A stream of ``INPUT`` rows to the stream of what is to be done, ``OUTPUT`` rows."""
    return rows.groupBy("request_id").transformWithState(
        RequestState(rules, stale_seconds), OUTPUT, "Append", "ProcessingTime"
    )
