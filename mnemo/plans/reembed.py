"""Moving a knowledge table to another vector space."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mnemo.config import DEFAULT_RULES, EXPERIENCE_TYPES, Rules
from mnemo.functions import text as t
from mnemo.functions.vectors import embed


def reembed(knowledge: DataFrame, embedder, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Every row with a vector of ``embedder`` and freshly computed axis tags.

    Narrow and whole: rows and ids stay, nothing is shuffled. Write the result
    to a new path and switch readers over; never over the table being read.
    """
    c = F.col("text")
    gate = F.when(F.col("type").isin(EXPERIENCE_TYPES), "experience").otherwise("knowledge")
    out = knowledge.withColumns({"_raw": t.raw_tokens(c), "_low": F.lower(c)})
    out = out.withColumn(
        "expert_confidence", t.axis_scores(c, rules, F.col("_raw"), F.col("_low"), gate)
    )
    out = out.withColumn("experts", t.active_axes(F.col("expert_confidence"), rules))
    return embed(out.drop("_raw", "_low"), "text", embedder)
