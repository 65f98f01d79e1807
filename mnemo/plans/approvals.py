"""Approving decisions, a batch at a time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from mnemo.functions.scalars import to_iso
from mnemo.functions.text import strip
from mnemo.operators.upsert import INSERTED, resolve


@dataclass
class Approved:
    outcomes: DataFrame
    status_log: DataFrame
    audit_edges: DataFrame


def apply_approvals(approvals: DataFrame, knowledge: DataFrame) -> Approved:
    """Promote proposed decisions; everything else is answered, never forced.

    ``approvals`` is (ord, decision_id, approver, at). Outcomes: changed,
    already_approved, invalid_transition, not_found, invalid_request. Two
    approvals of one decision in a batch change it once.
    """
    wanted = approvals.select(F.col("decision_id").alias("memory_id")).distinct()
    # The batch selects its decisions from the table, not the other way round.
    found = (
        knowledge.filter(F.col("type") == "decision").select("memory_id", "status")
        .join(wanted, "memory_id", "left_semi")
        .select(F.col("memory_id").alias("decision_id"),
                F.lower(F.coalesce(F.nullif("status", F.lit("")), F.lit("proposed")))
                .alias("previous_status"))
    )
    judged = resolve(approvals.filter(F.col("decision_id").isNotNull()), None,
                     ["decision_id"], ["ord"], attach=found)
    nameless = approvals.filter(F.col("decision_id").isNull())
    judged = judged.unionByName(
        nameless.withColumn("verdict", F.lit(INSERTED)), allowMissingColumns=True
    )
    who = strip(F.coalesce("approver", F.lit("")))
    old, first = F.col("previous_status"), F.col("verdict") == INSERTED
    outcomes = judged.withColumns({
        "approved_by": F.when(who == "", "admin").otherwise(F.substring(who, 1, 200)),
        "outcome": (
            F.when(F.col("decision_id").isNull(), "invalid_request")
            .when(old.isNull(), "not_found")
            .when((old == "proposed") & first, "changed")
            .when(old.isin("proposed", "approved"), "already_approved")
            .otherwise("invalid_transition")
        ),
    }).withColumn("changed", F.col("outcome") == "changed").drop("verdict", "approver")
    changed = outcomes.filter("changed")
    log = changed.select(
        F.col("decision_id").alias("memory_id"), F.lit("approved").alias("status"), "at"
    )
    audit = changed.select(
        "ord", F.col("approved_by").alias("src"), F.lit("approved_decision").alias("rel"),
        F.concat(F.lit("decision:"), F.col("decision_id").cast("string")).alias("dst"),
        F.lit("admin_api").alias("source"),
        F.create_map(
            F.lit("approved_at"), to_iso(F.col("at")), F.lit("previous_status"), old
        ).alias("meta"),
    )
    return Approved(outcomes, log, audit)
