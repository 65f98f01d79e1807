"""Ranking by shared tokens, as joins of an inverted index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from mnemo.functions.scalars import round6
from mnemo.operators.grams import GRAM, holding
from mnemo.operators.probe import GLOBAL_POOL, Scope, cut
from mnemo.sources.tables import stage


def k_best(hits: DataFrame, k: int, order: Sequence[str], by: Sequence[str] = ("prompt_id", "pool")) -> DataFrame:
    """The first ``k`` of each group, by score (if there is one), then ``order``, with their rank."""
    best = [F.col("score").desc_nulls_last()] if "score" in hits.columns else []
    return cut(hits, by, [*best, *[F.asc_nulls_last(c) for c in order]], k, order)


def seen(scope: Scope, asked: Column, mine: Column) -> Column:
    """Whether a prompt of project ``asked`` may see a row of project ``mine``."""
    asked, mine = F.coalesce(asked, F.lit("")), F.coalesce(mine, F.lit(""))
    ok = (asked == "") | (asked == mine)
    return ok | (mine == "") if scope.project == "global" else ok if scope.project else F.lit(True)


def overlap(probes: DataFrame, rows: DataFrame, key: str, scope: Scope = Scope()) -> DataFrame:
    """(prompt_id, pool, key, score): shares of a probe's ``tokens`` that a row's ``tokens`` hold.

    A token found whole counts 1; one of four or more characters found inside another token counts
    one half. Only pairs that share something are rows. What a row token is worth to which probe
    is worked out on the distinct tokens of both sides and written once; Spark broadcasts it if it
    is small. Rows lie partitioned by key, so the credits of a pair are added up where they arise.
    Null and empty token lists share nothing.
    """
    asked = probes.select("prompt_id", *(["project"] if scope.project else []), F.array_distinct("tokens").alias("t"))
    asked = asked.withColumnRenamed("project", "asked").withColumn("n", F.size("t")).withColumn("token", F.explode("t")).drop("t")
    words = rows.select(F.explode("tokens").alias("word")).distinct()
    tokens = asked.select("token").distinct()
    inside = holding(tokens.select(F.col("token").alias("needle")), words, ["word"], GRAM)
    half = inside.filter("needle != word").select(F.col("needle").alias("token"), "word", F.lit(0.5).alias("credit"))
    whole = tokens.select("token", F.col("token").alias("word"), F.lit(1.0).alias("credit"))
    worth = stage(asked.join(half.unionByName(whole), "token"), "credits")

    tags = F.array_join(F.transform("experts", F.lower), "\n").alias("tags") if scope.axes else F.lit("").alias("tags")
    mine = F.col("project") if scope.project else F.lit(None)
    each = rows.select(key, "tokens", tags, mine.alias("mine")).repartition(key)
    each = each.withColumn("word", F.explode(F.array_distinct("tokens"))).drop("tokens")
    met = each.join(worth, "word")
    met = met.filter(seen(scope, F.col("asked"), F.col("mine"))) if scope.project else met
    # The best credit of a token within a row counts, once.
    paid = met.groupBy(key, "tags", "prompt_id", "n", "token").agg(F.max("credit").alias("credit"))
    scored = paid.groupBy(key, "tags", "prompt_id", "n").agg(F.sum("credit").alias("total"))
    scored = scored.select("prompt_id", key, "tags", round6(F.col("total") / F.col("n")).alias("score"))
    pools = F.array(F.lit(GLOBAL_POOL))
    if scope.axes:
        scored = scored.join(probes.select("prompt_id", "axes"), "prompt_id")
        have = F.split("tags", "\n")
        fit = F.filter(F.array_distinct("axes"), lambda a: F.array_contains(have, F.lower(a)))
        pools = F.concat(pools, F.coalesce(fit, F.array()))
    return scored.select("prompt_id", F.explode(pools).alias("pool"), key, "score")


def with_payload(hits: DataFrame, rows: DataFrame, key: str, payload: Sequence[str]) -> DataFrame:
    """``hits`` with further columns of the rows they name; only winners are looked up.

    The hits are written first, so Spark knows how many there are: where they are few they are
    broadcast and the rows, with their texts, stay in place.
    """
    more = [c for c in dict.fromkeys(payload) if c not in hits.columns]
    return stage(hits, "hits").join(rows.select(key, *more), key) if more else hits
