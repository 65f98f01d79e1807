"""Continuous event ingest on Structured Streaming.

Lines become requests with keyed state (``requests.py``), which says what is new, what was seen
before and which attempts are due. A micro-batch makes that durable, feeds the due events, and
writes how each attempt ended; these outcomes are a second source of the same stream, so the state
learns them in the next micro-batch. Nothing reads the history: what was seen is state, stored
nodes and edges are looked up in the folders of the batch's own key prefixes, and folders are
compacted (``store.py``).

An event whose feeding fails is found by halving the batch, so it fails alone and is tried again
when its backoff is over, new input or not.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType, TimestampType

from mnemo.config import DEFAULT_RULES, Rules
from mnemo.functions.vectors import HashedEmbedder, identity_of
from mnemo.operators.audit import require_identity
from mnemo.operators.ledger import lifecycle
from mnemo.operators.upsert import first_wins
from mnemo.plans.fanout import ingest_events
from mnemo.schema import ATTEMPT, EDGES, KNOWLEDGE, NODES
from mnemo.sources.events import parse_events, split_events
from mnemo.streaming import requests
from mnemo.streaming.store import BatchTables, Table, fit

KINDS = {"string": StringType(), "long": LongType(), "boolean": BooleanType(), "timestamp": TimestampType()}


def _columns(ddl: str, **other: str) -> StructType:
    """A schema without a session; ``other`` gives columns another type."""
    named = (c.split() for c in ddl.split(", "))
    return StructType([StructField(n, KINDS[other.get(n, kind)]) for n, kind in named])


REQUESTS = _columns(requests.OUTPUT, created_at="timestamp", at="timestamp")
OUTCOMES = _columns(
    "request_id string, event_id string, attempt long, started_at timestamp, outcome string, error string, "
    "finished_at timestamp"
)
TABLES = {
    "requests": Table(REQUESTS), "outcomes": Table(OUTCOMES), "knowledge": Table(KNOWLEDGE, split="type"),
    "nodes": Table(NODES, keyed="node_id"), "edges": Table(EDGES, keyed="edge_id"),
}
KEYS = {"knowledge": "memory_id", "nodes": "node_id", "edges": "edge_id"}
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Store(BatchTables):
    """The event tables under one root, and the views that reports read."""

    def __init__(self, spark: SparkSession, root: str, fan: int = 10):
        super().__init__(spark, root, TABLES, fan)
        self.files.make(f"{root}/outcomes")

    @property
    def events(self) -> DataFrame:
        accepted = self.read("requests").filter("action = 'accept'")
        return accepted.select("event_id", "request_id", "value", "payload_hash", "created_at")

    @property
    def accepts(self) -> DataFrame:
        rows = self.read("requests").filter(F.col("action").isin("accept", "duplicate"))
        return rows.select("request_id", "event_id", (F.col("action") == "duplicate").alias("duplicate"), "payload_mismatch")

    @property
    def quarantine(self) -> DataFrame:
        return self.read("requests").filter("action = 'invalid'").select("value", "error_code", "error_field")

    @property
    def attempts(self) -> DataFrame:
        """Starts and ends of attempts."""
        starts = self.read("requests").filter("attempt IS NOT NULL").withColumn("started_at", F.col("at"))
        return fit(starts.drop("error"), ATTEMPT).unionByName(fit(self.read("outcomes"), ATTEMPT))

    @property
    def knowledge(self) -> DataFrame:
        return self.read("knowledge")

    @property
    def nodes(self) -> DataFrame:
        return self.read("nodes")

    @property
    def edges(self) -> DataFrame:
        return self.read("edges")


@dataclass
class EventIngest:
    store: Store
    embedder: object = None
    rules: Rules = DEFAULT_RULES
    #: Seconds after which an attempt without an outcome counts as lost.
    stale_seconds: float = 300
    _scratch: str = field(default="", repr=False)

    def ledger(self, now: Column | None = None) -> DataFrame:
        """State of every event ever accepted, for reports."""
        return lifecycle(self.store.events, self.store.attempts, now, int(self.stale_seconds), self.rules)

    # -- one micro-batch ------------------------------------------------------------------
    def run_batch(self, todo: DataFrame, batch_id: int) -> None:
        """``todo`` as from ``requests.actions``: store it, feed what is due, note the outcomes.

        Every table's folder of this batch is overwritten, so a replay leaves what one run leaves.
        """
        store = self.store
        # The one evaluation of the state in this batch.
        store.write("requests", todo.withColumns({c: F.timestamp_millis(c) for c in ("created_at", "at")}), batch_id)
        rows = store.read_batch("requests", batch_id)
        due = rows.filter("attempt IS NOT NULL")
        if not due.isEmpty():
            self._feed(due, batch_id)
        elif rows.isEmpty():
            store.drop_batch("requests", batch_id)
        # The files of the last outcomes are input of this batch, which may be run again.
        store.compact(batch_id - 2)

    def _feed(self, due: DataFrame, batch_id: int) -> None:
        store, now = self.store, F.current_timestamp()
        self._scratch = f"{store.root}/_scratch/{batch_id}"
        stored = {n: store.read(n, before=batch_id) for n in ("nodes", "edges")}
        made, ended = self._apart(due, stored, now)
        for name, key in KEYS.items():
            parts = [m[name].withColumn("_part", F.lit(i)) for i, m in enumerate(made)]
            rows = parts[0] if parts else store.empty(name)
            for part in parts[1:]:
                rows = rows.unionByName(part)
            # Halves do not see each other's nodes and edges.
            rows = first_wins(rows, [key], ["_part"]) if len(parts) > 1 else rows
            store.write(name, fit(rows, TABLES[name].schema), batch_id)
        outcomes = ended[0]
        for part in ended[1:]:
            outcomes = outcomes.unionByName(part)
        store.write("outcomes", fit(outcomes.withColumn("finished_at", now), OUTCOMES), batch_id)
        store.files.drop(self._scratch)

    def _apart(self, due: DataFrame, stored: dict, now: Column) -> tuple[list[dict], list[DataFrame]]:
        """Tables made of the events, and how each ended; if a job fails, of each half by itself."""
        try:
            return self._fan_out(due, stored, now)
        except Exception as error:
            if _stopped(error):
                raise
            said = _reason(error)
        # A bit of the ids' hashes that tells some of them apart.
        key = F.xxhash64("event_id")
        every, any_ = due.agg(F.bit_and(key), F.bit_or(key)).first()
        differs = every ^ any_
        if not differs:
            return [], [_ended(due, "failed", F.lit(said))]
        bit = F.shiftright(key, (differs & -differs).bit_length() - 1).bitwiseAND(F.lit(1))
        parts = [self._apart(due.filter(bit == side), stored, now) for side in (0, 1)]
        return [m for made, _ in parts for m in made], [e for _, ended in parts for e in ended]

    def _fan_out(self, due: DataFrame, stored: dict, now: Column) -> tuple[list[dict], list[DataFrame]]:
        # Memories, artefacts and outcomes all read the events: they are parsed once for all.
        parsed = parse_events(due.drop("error_code", "error_field"), self.rules).drop("value", "payload_hash")
        good, bad = split_events(self._stage(parsed, "events"))
        # Events that came without an id carry the one given on acceptance.
        rows = good.select("created_at", F.col("event_id").alias("_id"), "event.*")
        rows = rows.drop("event_id").withColumnRenamed("_id", "event_id")
        # Keys of memories are scoped to the event, so those of another attempt cannot be met.
        out = ingest_events(
            rows, ["created_at", "event_id"], None, stored["nodes"], stored["edges"], self.embedder,
            self.rules, now, self._stage,
        )
        made = {n: self._stage(fit(getattr(out, n), TABLES[n].schema), n) for n in KEYS}
        why = F.concat_ws(": ", F.lit("unreadable event"), "error_code", "error_field")
        return [made], [_ended(good, "done", F.lit(None)), _ended(bad, "failed", why)]

    def _stage(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self._scratch}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.store.spark.read.schema(df.schema).parquet(path)

    # -- streams --------------------------------------------------------------------------
    def start(self, folder: str, every: str = "5 seconds", archive: str | None = None) -> StreamingQuery:
        """Follow a folder of JSON-lines files until the query is stopped.

        Due retries run every ``every``, with or without new files. Files that were read move to
        ``archive`` if one is given, so that listing ``folder`` stays cheap. Fails at once if the
        knowledge table belongs to another embedder.
        """
        store = self.store
        embedder = self.embedder or HashedEmbedder(self.rules)
        require_identity(store.knowledge, identity_of(embedder))
        # Timers need the state store that keeps them in order of time.
        store.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
        reader = store.spark.readStream
        if archive:
            reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
        lines = requests.incoming(reader.text(folder), self.rules)
        # Outcomes come back to the state in the next micro-batch.
        ended = store.spark.readStream.schema(OUTCOMES).option("recursiveFileLookup", "true")
        ended = ended.parquet(f"{store.root}/outcomes")
        todo = requests.actions(lines.unionByName(requests.finished(ended)), self.rules, self.stale_seconds)
        counts = [F.count_if(F.col("action") == a).alias(a) for a in ("accept", "duplicate", "invalid", "retry")]
        todo = todo.observe("requests", *counts, F.count("attempt").alias("started"))
        return todo.writeStream.foreachBatch(self.run_batch).option(
            "checkpointLocation", f"{store.root}/_checkpoint"
        ).trigger(processingTime=every).start()

    def drain(self, folder: str, seconds: float = 3600) -> None:
        """Feed what is there and due, then stop; raises if that takes longer than ``seconds``.

        Retries whose backoff is not over are left to the next run.
        """
        query, end = self.start(folder, "0 seconds"), time.monotonic() + seconds
        # The first micro-batch may be one that the last run had planned, before it could see new
        # files. Any later one saw them, and the outcomes of the one before: if idle, all is done.
        first, done = None, False
        try:
            while not done:
                last = query.lastProgress
                if last is not None:
                    first = last["batchId"] if first is None else first
                    done = last["batchId"] > first and idle(last)
                if query.exception():
                    raise query.exception()
                if time.monotonic() > end:
                    raise TimeoutError(f"not drained after {seconds} seconds")
                time.sleep(0.2)
        finally:
            query.stop()


def idle(progress) -> bool:
    """Whether a micro-batch had no input and started nothing."""
    return progress["numInputRows"] == 0 and not batch_counts(progress).get("started")


def batch_counts(progress) -> dict[str, int]:
    """What a micro-batch counted on its way: accepts, duplicates, invalid lines, retries, starts."""
    row = (progress["observedMetrics"] or {}).get("requests")
    return row.asDict() if row is not None else {}


def _ended(events: DataFrame, outcome: str, error: Column) -> DataFrame:
    return events.select(
        "request_id", "event_id", "attempt", F.col("at").alias("started_at"), F.lit(outcome).alias("outcome"),
        error.cast("string").alias("error"),
    )


def _stopped(error: Exception) -> bool:
    """Whether a job ended because its query or session did."""
    said = str(error)
    return any(s in said for s in ("InterruptedException", "cancelled", "SparkContext was shut down", "stopped SparkContext"))


def _reason(error: Exception) -> str:
    """The line of a failed job's report that names the error, without the traceback."""
    lines = [x.strip() for x in str(error).splitlines() if x.strip()]
    named = [x for x in lines if x.split(":")[0].endswith(("Error", "Exception")) and not x.startswith(("at ", "File "))]
    return (named or lines or [type(error).__name__])[-1 if named else 0][:1000]


__all__ = ["EventIngest", "Store", "batch_counts", "idle"]
