"""First-write-wins tables: append what is new, report what was refused.

A batch may repeat one key in a third of its rows, so no key is ever gathered in
one task: a task passes on one row per key, winners come from partial aggregation,
and the verdict travels back to the rows on (key, salt). Whole rows move only where
they may be written; what is refused moves as its key and the start of its text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from mnemo.functions.text import is_blank, strings, strip, topic_label
from mnemo.config import DEFAULT_RULES, Rules
from mnemo.schema import fingerprint, key_hash, prefix

SALTS = 64

INSERTED, REPEATED, STORED = "inserted", "repeated", "stored"


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key. Spark cuts to one row per key and task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def pruned(existing: DataFrame, keys_df: DataFrame, key: str) -> DataFrame:
    """Of a table stored by key prefix (column ``prefix``) the folders that a batch's keys fall in.

    There are 256 prefixes at most, so the driver may know those of a batch. Other tables are
    returned as they are.
    """
    if "prefix" not in existing.columns:
        return existing
    held = [r[0] for r in keys_df.select(prefix(F.col(key))).distinct().collect()]
    return existing.filter(F.col("prefix").isin(held))


def known_keys(keys_df: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of a (small) batch that a (big) table already holds.

    Read this way round the big table is only scanned, filtered by the batch's
    keys; an anti join against it would shuffle all of it.
    """
    held = pruned(existing, keys_df, keys[0])
    return held.select(*keys).join(keys_df.select(*keys), list(keys), "left_semi").distinct()


def new_rows(df: DataFrame, existing: DataFrame | None, keys: Sequence[str],
             order: Sequence[str]) -> DataFrame:
    """First row per key among the keys not stored yet.

    What is stored already is left out before any row moves.
    """
    if existing is not None:
        asked = df.select(*keys).distinct()
        df = df.join(known_keys(asked, existing, keys), list(keys), "left_anti")
    return first_wins(df, keys, order)


def resolve(
    df: DataFrame,
    existing: DataFrame | None,
    keys: Sequence[str],
    order: Sequence[str],
    carry: str | None = None,
    attach: DataFrame | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Every row with its verdict: inserted, repeated (in this batch) or stored (before it).

    ``order`` must be unique within a key. ``carry`` names a column (of both
    tables) whose winning value is handed to all rows of the key as ``_winner``.
    ``attach`` is a lookup table, one row per key, whose columns ride along.
    """
    rank = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    lowest = F.min(rank if carry is None else F.struct(rank.alias("rank"), carry))
    parts = salted.groupBy(*keys, "_salt").agg(lowest.alias("_low"))
    winners = parts.groupBy(*keys).agg(F.min("_low").alias("_first"))
    if existing is not None:
        held = existing if carry is None else existing.withColumnRenamed(carry, "_held")
        columns = list(keys) if carry is None else [*keys, "_held"]
        held = pruned(held, winners, keys[0]).select(*columns)
        known = (
            held.join(winners.select(*keys), list(keys), "left_semi")
            .dropDuplicates(list(keys)).withColumn("_known", F.lit(True))
        )
        winners = winners.join(known, list(keys), "left")
    else:
        winners = winners.withColumn("_known", F.lit(None).cast("boolean"))
    if attach is not None:
        winners = winners.join(attach, list(keys), "left")
    lookup = parts.select(*keys, "_salt").join(winners, list(keys))
    first = F.col("_first") if carry is None else F.col("_first.rank")
    out = salted.join(lookup, [*keys, "_salt"]).withColumn(
        "verdict",
        F.when(F.col("_known"), STORED).when(rank == first, INSERTED).otherwise(REPEATED),
    )
    if carry is not None:
        won = F.col(f"_first.{carry}")
        held = won if existing is None else F.coalesce("_held", won)
        out = out.withColumn("_winner", held)
    return out.drop("_salt", "_first", "_known", "_held")


# -- knowledge -----------------------------------------------------------------------
def _default(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _filled(df: DataFrame, name: str, other: Column) -> Column:
    return F.coalesce(F.nullif(_default(df, name, "string"), F.lit("")), other)


def prepare_knowledge(df: DataFrame, now: Column | None = None) -> DataFrame:
    """Fill defaults, drop blank texts and stamp the key columns."""
    now = F.current_timestamp() if now is None else now
    source = _default(df, "source", "string")
    ready = df.withColumns({
        "text": strip(F.coalesce("text", F.lit(""))),
        "source": source,
        "ts": F.coalesce(_default(df, "ts", "timestamp"), now),
        "type": _filled(df, "type", F.lit("knowledge")),
        "status": _filled(df, "status", F.lit("approved")),
        "source_type": _filled(df, "source_type", F.lit("conversation")),
        "source_id": _filled(df, "source_id", source),
        "project": _default(df, "project", "string"),
        "confidence": _default(df, "confidence", "string").try_cast("double"),
        "updated_at": now,
    }).filter(F.length("text") > 0)
    ready = ready.withColumn("fingerprint", fingerprint(F.col("source"), F.col("text")))
    return ready.withColumn("memory_id", F.md5("fingerprint"))


def upsert_knowledge(
    new: DataFrame, existing: DataFrame | None = None, order: Sequence[str] = ("ord",),
    now: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(inserted, skipped): insert-or-ignore on the fingerprint.

    Skipped rows carry the reason and the first 120 characters of their text.
    """
    rows = prepare_knowledge(new, now)
    told = rows.select(
        *order, "memory_id", "source", "type", F.substring("text", 1, 120).alias("text"),
        F.lit("duplicate_fingerprint").alias("reason"),
    )
    judged = resolve(told, existing, ["memory_id"], order)
    return new_rows(rows, existing, ["memory_id"], order), judged.filter(F.col("verdict") != INSERTED)


# -- graph -----------------------------------------------------------------------------
def node_id(label: Column, kind: Column) -> Column:
    return key_hash(label, kind)


def edge_id(src_label: Column, rel: Column, dst_label: Column) -> Column:
    return key_hash(src_label, rel, dst_label)


def upsert_nodes(
    triples: DataFrame, existing: DataFrame | None = None, order: Sequence[str] = ("ord",),
    now: Column | None = None,
) -> DataFrame:
    """Nodes for both ends of (src, rel, dst) rows, one per (label, kind).

    A node takes the project of the edge that first named it. A row without a
    relation names no nodes; a blank end names none for that end.
    """
    now = F.current_timestamp() if now is None else now
    ends = triples.filter(~is_blank(F.col("rel"))).select(
        *order, _default(triples, "project", "string").alias("project"),
        F.posexplode(F.array("src", "dst")).alias("end", "label"),
    )
    named = ends.withColumns({"label": strip(F.coalesce("label", F.lit(""))),
                              "kind": F.lit("entity")}).filter(F.length("label") > 0)
    return _nodes(named, existing, [*order, "end"], now)


def concept_nodes(
    segments: DataFrame, existing: DataFrame | None = None, order: Sequence[str] = ("ord",),
    now: Column | None = None, rules: Rules = DEFAULT_RULES,
) -> DataFrame:
    """Segments without a triple, kept as nodes named by topic or by their first 60 characters."""
    now = F.current_timestamp() if now is None else now
    label = F.coalesce(
        F.nullif(topic_label(F.col("text"), None, rules), F.lit("")), F.substring("text", 1, 60)
    )
    named = segments.filter(F.size("relations") == 0).select(
        *order, strip(label).alias("label"), F.lit("concept").alias("kind"),
        F.lit(None).cast("string").alias("project"),
    ).filter(F.length("label") > 0)
    return _nodes(named, existing, order, now)


def _nodes(named, existing, order, now) -> DataFrame:
    keyed = named.withColumn("node_id", node_id(F.col("label"), F.col("kind")))
    return new_rows(keyed, existing, ["node_id"], order).select(
        "node_id", "label", "kind", F.create_map().cast("map<string,string>").alias("meta"),
        F.lit("approved").alias("status"), "project", now.alias("ts"),
    )


def upsert_edges(
    triples: DataFrame, existing: DataFrame | None = None, order: Sequence[str] = ("ord",),
    now: Column | None = None, project_in_key: bool = False,
) -> DataFrame:
    """Edges, one per (src, rel, dst); blank labels or relations make none.

    The first row wins project, tags and status. ``project_in_key`` keeps one
    edge per project instead.
    """
    now = F.current_timestamp() if now is None else now
    clean = triples.withColumns({
        "src_label": strip(F.coalesce("src", F.lit(""))),
        "rel": strip(F.coalesce("rel", F.lit(""))),
        "dst_label": strip(F.coalesce("dst", F.lit(""))),
        "project": _default(triples, "project", "string"),
    }).filter("length(src_label) > 0 AND length(rel) > 0 AND length(dst_label) > 0")
    key = [F.col("src_label"), F.col("rel"), F.col("dst_label")]
    if project_in_key:
        key.append(F.coalesce("project", F.lit("")))
    keyed = clean.withColumn("edge_id", key_hash(*key))
    kind = F.lit("entity")
    return new_rows(keyed, existing, ["edge_id"], order).select(
        "edge_id",
        node_id(F.col("src_label"), kind).alias("src"),
        "rel",
        node_id(F.col("dst_label"), kind).alias("dst"),
        "src_label", "dst_label",
        _default(clean, "source", "string").alias("source"),
        _filled(clean, "source_type", F.lit("conversation")).alias("source_type"),
        _filled(clean, "status", F.lit("approved")).alias("status"),
        "project",
        F.coalesce(_default(clean, "experts", "array<string>"), strings([])).alias("experts"),
        F.coalesce(
            _default(clean, "expert_confidence", "map<string,double>"),
            F.create_map().cast("map<string,double>"),
        ).alias("expert_confidence"),
        F.coalesce(
            _default(clean, "meta", "map<string,string>"),
            F.create_map().cast("map<string,string>"),
        ).alias("meta"),
        _default(clean, "event_ts", "string").alias("event_ts"),
        now.alias("ingested_at"),
    )


def edge_view(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both end labels, from the normalised form (src and dst are node ids).

    Node ids are unique on their side, so a hot node only skews the edge side,
    which adaptive execution splits.
    """
    ends = nodes.select("node_id", "label")
    src = ends.withColumnsRenamed({"node_id": "src", "label": "src_label"})
    dst = ends.withColumnsRenamed({"node_id": "dst", "label": "dst_label"})
    bare = edges.drop("src_label", "dst_label")
    return bare.join(src, "src").join(dst, "dst")


# -- status ------------------------------------------------------------------------------
def status_changes(changes: DataFrame, at: Column | None = None) -> DataFrame:
    """Rows for the append-only status log; nothing is ever deleted."""
    at = F.current_timestamp() if at is None else at
    return changes.select("memory_id", "status", at.alias("at"))


def latest_status(log: DataFrame, order: Sequence[str] = ("at",)) -> DataFrame:
    return log.groupBy("memory_id").agg(
        F.max(F.struct(*order, "status")).alias("last")
    ).select("memory_id", F.col("last.status").alias("status"),
             F.col(f"last.{order[0]}").alias("updated_at"))


def with_current_status(
    knowledge: DataFrame, log: DataFrame, order: Sequence[str] = ("at",)
) -> DataFrame:
    """Knowledge with each row's last logged status in place of the one it was written with."""
    last = latest_status(log, order).withColumnsRenamed(
        {"status": "_status", "updated_at": "_updated"}
    )
    joined = knowledge.join(last, "memory_id", "left")
    out = joined.withColumn("status", F.coalesce("_status", "status"))
    if "updated_at" in knowledge.columns:
        out = out.withColumn("updated_at", F.coalesce("_updated", "updated_at"))
    return out.drop("_status", "_updated")
