"""Measuring routing and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mnemo.operators.audit import side_by_side


def _percent(part, whole):
    return F.round(F.when(whole > 0, 100.0 * part / whole).otherwise(0.0), 1)


def routing_accuracy(golden: DataFrame, routed: DataFrame) -> DataFrame:
    """One row: prompts, top-1 accuracy and the share of axes that should not have fired.

    ``golden`` is (prompt_id, expect, accept); prompts without an expected axis
    are not scored. ``routed`` is the output of ``route``.
    """
    joined = golden.join(routed.select("prompt_id", "axes"), "prompt_id")
    scored = F.col("expect").isNotNull()
    wrong = F.filter("axes", lambda a: (a != F.col("expect")) & ~F.array_contains("accept", a))
    return joined.agg(
        F.count("*").alias("golden_prompts"),
        F.count_if(scored).alias("scored_prompts"),
        F.count_if(scored & (F.get("axes", F.lit(0)) == F.col("expect"))).alias("top1"),
        F.coalesce(F.sum(F.when(scored, F.size(wrong))), F.lit(0)).alias("leaked"),
        F.coalesce(F.sum(F.when(scored, F.size("axes"))), F.lit(0)).alias("fired"),
    ).select(
        "golden_prompts", "scored_prompts",
        _percent(F.col("top1"), F.col("scored_prompts")).alias("route_top1_accuracy_pct"),
        _percent(F.col("leaked"), F.col("fired")).alias("axis_leakage_pct"),
    )


def retrieval_precision(golden: DataFrame, hits: DataFrame, name: str) -> DataFrame:
    """One row: share of retrieved memories tagged with the expected axis, and of those that are not."""
    joined = golden.filter(F.col("expect").isNotNull()).select("prompt_id", "expect").join(
        hits.select("prompt_id", "experts"), "prompt_id"
    )
    hit = F.array_contains("experts", F.col("expect"))
    share = joined.agg(F.count_if(hit).alias("good"), F.count("*").alias("n"))
    pct = _percent(F.col("good"), F.col("n"))
    return share.select(
        pct.alias(f"{name}_precision_pct"), F.round(100.0 - pct, 1).alias(f"{name}_irrelevant_pct")
    )


def recall_floor(prompts: DataFrame, routed: DataFrame, unrouted: DataFrame) -> DataFrame:
    """Per prompt the pool sizes with and without routing; routing must never shrink one."""
    def sized(hits: DataFrame, name: str) -> DataFrame:
        return hits.groupBy("prompt_id").agg(F.count("*").alias(name))

    out = prompts.select("prompt_id")
    for hits, name in ((routed, "routed"), (unrouted, "unrouted")):
        out = out.join(sized(hits, name), "prompt_id", "left")
    out = out.na.fill(0)
    return out.withColumn("kept", F.col("routed") >= F.col("unrouted"))


def evaluation_report(accuracy: DataFrame, routed: DataFrame, unrouted: DataFrame) -> DataFrame:
    """The one-row reports side by side."""
    return side_by_side(accuracy, routed, unrouted)


def calibration(top: DataFrame, background: DataFrame, points=(0.05, 0.5, 0.95)) -> DataFrame:
    """Exact percentiles of top-k scores against those of a background, to choose ``min_score``.

    Scores count to six decimals, so a pool has at most two million distinct ones to keep.
    """
    scores = top.select(F.lit("top").alias("pool"), "score").unionByName(
        background.select(F.lit("background").alias("pool"), "score")
    ).withColumn("score", F.round("score", 6))
    return scores.groupBy("pool").agg(
        F.count("*").alias("pairs"), F.min("score").alias("lowest"), F.max("score").alias("highest"),
        *[F.expr(f"percentile_disc({p}D) WITHIN GROUP (ORDER BY score)").alias(f"p{round(p * 100):02d}")
          for p in points],
    )
