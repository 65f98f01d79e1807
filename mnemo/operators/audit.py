"""Store audits: vector-space identity, row counts, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mnemo.operators.predicates import same_identity


class IdentityMismatch(ValueError):
    """A table holds vectors that cannot be compared with the active embedder's."""


def identity_audit(knowledge: DataFrame, identity: Column) -> DataFrame:
    """One row: total, matched and mismatched rows against the active identity."""
    match = same_identity(identity)
    return knowledge.agg(
        F.count("*").alias("total"),
        F.count_if(match).alias("matched"),
        F.count_if(~match).alias("mismatched"),
    )


def require_identity(knowledge: DataFrame, identity: Column) -> None:
    """Fail before any ranking or write if a single row does not match."""
    bad = knowledge.filter(~same_identity(identity)).limit(1).count()
    if bad:
        raise IdentityMismatch(
            "knowledge table holds rows of another embedding identity; re-embed it or switch back"
        )


def identities(knowledge: DataFrame) -> DataFrame:
    return knowledge.groupBy("embed_identity").agg(F.count("*").alias("rows"))


def mixed_identity(knowledge: DataFrame) -> DataFrame:
    """One row: how many identities there are and whether that is more than one."""
    return identities(knowledge).agg(
        F.count("*").alias("identities"), (F.count("*") > 1).alias("mixed")
    )


def side_by_side(*reports: DataFrame) -> DataFrame:
    """One-row frames as one row: a union and an aggregate, no join."""
    stacked = reports[0]
    for report in reports[1:]:
        stacked = stacked.unionByName(report, allowMissingColumns=True)
    return stacked.agg(*[F.any_value(c, True).alias(c) for c in stacked.columns])


def row_counts(**tables: DataFrame) -> DataFrame:
    """One row with the row count of every table."""
    return side_by_side(*[df.agg(F.count("*").alias(name)) for name, df in tables.items()])


def store_audit(
    identity: Column,
    knowledge: DataFrame | None = None,
    edges: DataFrame | None = None,
    ledger: DataFrame | None = None,
    spark=None,
) -> DataFrame:
    """One row: state per store, open problems, backlog and last ingestion."""
    from mnemo.operators.ledger import backlog_depth, last_done

    given = next(d for d in (knowledge, edges, ledger, spark) if d is not None)
    session = getattr(given, "sparkSession", given)
    parts = [session.range(1).select(F.lit(True).alias("_audit"))]
    if knowledge is not None:
        parts.append(identity_audit(knowledge, identity))
    if edges is not None:
        parts.append(edges.agg(F.count("*").alias("edges")))
    if ledger is not None:
        parts.append(backlog_depth(ledger).withColumnRenamed("depth", "queue_depth"))
        parts.append(last_done(ledger))
    row = side_by_side(*parts)
    nothing = F.lit(None).cast("string")
    if knowledge is None:
        row = row.withColumns({"vector_store": F.lit("unavailable"),
                               "vector_problem": F.lit("vector_store")})
    else:
        row = row.withColumn(
            "vector_store",
            F.when(F.col("mismatched") > 0, "identity_mismatch").otherwise("ready"),
        ).withColumn(
            "vector_problem", F.when(F.col("mismatched") > 0, "embedding_identity_mismatch")
        )
    if edges is None:
        row = row.withColumns({"graph_store": F.lit("unavailable"),
                               "graph_problem": F.lit("graph_store")})
    else:
        row = row.withColumns({"graph_store": F.lit("ready"), "graph_problem": nothing})
    if ledger is None:
        row = row.withColumns({
            "queue_depth": F.lit(0).cast("bigint"),
            "last_ingestion": F.lit(None).cast("timestamp"), "queue_problem": F.lit("queue"),
        })
    else:
        row = row.withColumn("queue_problem", nothing)
    problems = F.array_compact(F.array("vector_problem", "graph_problem", "queue_problem"))
    return row.withColumn("problems", problems).withColumn(
        "status", F.when(F.size("problems") == 0, "healthy").otherwise("degraded")
    ).withColumn(
        "memory_status", F.when(F.size("problems") == 0, "ready").otherwise("degraded")
    ).drop("_audit", "vector_problem", "graph_problem", "queue_problem")
