"""Mixing sources to target weights by Sainte-Lague apportionment.

Sources are split into shards of bounded size. The mix is a number of blocks of equally many
words; they go to the shards by the highest quotients target / (2s - 1), which gives every shard a
whole number of blocks. A shard's documents lie behind each other in a seeded order, cut in equal
blocks; all blocks are taken as many times as the quota allows, the rest is a run of blocks from a
seeded start.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from mnemo.llm.common import WORD
from mnemo.sources.tables import stage


@dataclass(frozen=True)
class MixConfig:
    #: Weights of the sources in code point order, null last, repeating.
    weights: tuple[int, ...] = (1, 2, 3)
    #: No source is taken more often than this.
    most: int = 3
    #: Words and rows of a shard, about.
    shard: int = 1 << 20
    #: Words of a block at most; fewer where the whole mix has under 2^20 such blocks.
    block: int = 64
    seed: int = 11


def ranked(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """``df`` with the place of each row in ``order``, from 1, without one task seeing all rows.

    Rows are sorted over ranges and written; only the row count of each range comes to the driver.
    """
    spark = df.sparkSession
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order)
    laid = stage(laid.withColumn("_at", F.monotonically_increasing_id()), name)
    laid = laid.withColumn("_part", F.shiftright("_at", 33))
    before, offsets = 0, []
    for part, n in sorted(tuple(r) for r in laid.groupBy("_part").count().collect()):
        offsets.append((part, before))
        before += n
    ahead = spark.createDataFrame(offsets, "_part long, _before long")
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    # One row per range.
    return laid.join(F.broadcast(ahead), "_part").withColumn(name, place).drop("_part", "_at", "_before")


def targets(sizes: DataFrame, config: MixConfig) -> DataFrame:
    """``sizes`` (source, source_size, source_rows) with the words that each source shall give.

    Sources share the sum of all sizes by weight; none passes ``most`` times its size, the excess
    goes to the others by weight. That is the level at which min(most * size, level * weight) adds
    up to the sum; each round caps sources and raises the level, by one aggregate.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in config.weights]), (F.col("place") - 1).cast("int") % len(config.weights) + 1)
    known = stage(ranked(sizes, F.col("source").asc_nulls_last(), name="place").withColumn("weight", w), "sources")
    cap = F.col("source_size") * float(config.most)
    level = 0.0
    while True:
        capped = cap < F.lit(level) * F.col("weight")
        r = known.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(capped, cap)).alias("fixed"),
            F.sum(F.when(~capped, F.col("weight"))).alias("open"),
        ).first()
        raised = ((r["all"] or 0) - (r["fixed"] or 0.0)) / r["open"] if r["open"] else level
        if not r["open"] or raised <= level:
            break
        level = raised
    return known.withColumn("target", F.least(cap, F.lit(level) * F.col("weight"))).drop("place", "weight")


def apportion(parties: DataFrame, seats: int, key: list[str]) -> DataFrame:
    """``parties`` (key, votes) with Sainte-Lague seats, ``seats`` in all.

    A party's seats differ from its share by at most half its share of the party count, plus a
    half; only quotients in that range are ranked, about three per party. Ties go by the key.
    """
    total = parties.agg(F.sum("votes").alias("v"), F.count("*").alias("n")).first()
    if not total.v or not seats:
        return parties.withColumn("seats", F.lit(0).cast("long"))
    share = F.col("votes") / F.lit(total.v)
    low = F.greatest(F.lit(0), F.ceil(share * (seats - total.n / 2) - 0.5)).cast("long")
    high = F.greatest(F.floor(share * (seats + total.n / 2) + 0.5).cast("long"), F.col("low"))
    held = stage(parties.withColumn("low", low).withColumn("high", high), "parties")
    left = seats - held.agg(F.sum("low")).first()[0]
    s = F.explode(F.sequence(F.col("low") + 1, F.col("high")))
    quotients = held.filter("high > low").select(*key, "votes", s.alias("s"))
    quotients = quotients.select(*key, (F.col("votes") / (2 * F.col("s") - 1)).alias("quotient"))
    won = ranked(quotients, F.desc("quotient"), *key, name="place").filter(F.col("place") <= left)
    won = won.groupBy(*key).agg(F.count("*").alias("won"))
    same = [held[k].eqNullSafe(won[k]) for k in key]
    return held.join(won, same, "left").select(
        *[held[k] for k in key], *[held[c] for c in held.columns if c not in (*key, "low", "high")],
        (held["low"] + F.coalesce(won["won"], F.lit(0))).alias("seats"),
    )


def mix(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) to one row per row: what the mix takes of it.

    ``row`` is the input row; then size (words; 0 for null), source_size, target, taken (words,
    repeats counted), rounds (times the document is taken whole) and ``parts``, further ranges
    [from, to) of its words. Rows without words are taken 0 words. Null sources are one source;
    repeated rows are documents of their own. Reruns agree.
    """
    key = ["source", "shard"]
    words = docs.select(F.struct("*").alias("row"), "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    # Words are counted twice only: once for all sums, once beside the rows.
    counted = stage(words.select("doc_id", "source", "size"), "sizes")
    sizes = counted.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    sources = stage(targets(sizes, config), "targets")
    named = sources.withColumnRenamed("source", "_source")
    count = F.ceil((F.col("source_size") + F.col("source_rows")) / config.shard)

    def deal(rows: DataFrame) -> DataFrame:
        held = rows.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        return held.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(config.seed)), count)).drop("source_rows")

    dealt = deal(words)
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    block = max(1, min(config.block, total >> 20))
    shards = deal(counted).groupBy(*key).agg(F.sum("size").alias("length"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    shards = shards.filter("length > 0").withColumn("votes", F.col("target") * F.col("length") / F.col("source_size"))
    quotas = apportion(shards, round(total / block), key)
    # From blocks of the mix to the shard's own equal blocks, which are a little shorter.
    quotas = quotas.withColumn("blocks", F.ceil(F.col("length") / block))
    own = F.round(F.col("seats") * block * F.col("blocks") / F.col("length")).cast("long")
    quotas = quotas.withColumn("own", F.least(own, F.col("blocks") * config.most)).select(
        F.col("source").alias("_source"), F.col("shard").alias("_shard"), "length", "blocks",
        F.expr("own div blocks").alias("rounds"), (F.col("own") % F.col("blocks")).alias("rest"),
        F.pmod(F.xxhash64("source", "shard", F.lit(config.seed + 1)), F.col("blocks")).alias("at"),
    )
    order = Window.partitionBy(*key).orderBy(F.xxhash64("doc_id", F.lit(config.seed + 2)), "doc_id", "size")
    laid = dealt.withColumn("to", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    laid = laid.join(
        quotas, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")), "left"
    ).withColumn("from", F.col("to") - F.col("size"))

    def part(first, last):
        """Words of the document between two block numbers of its shard."""
        low, high = (F.expr(f"({x} * length) div blocks") for x in (first, last))
        start = F.greatest(F.col("from"), low)
        return F.struct((start - F.col("from")).alias("from"), (F.least(F.col("to"), high) - F.col("from")).alias("to"))

    ranges = F.array(part("at", "least(at + rest, blocks)"), part("0L", "greatest(0L, at + rest - blocks)"))
    laid = laid.withColumn("parts", F.filter(F.coalesce(ranges, F.array()), lambda p: p["from"] < p["to"]))
    rounds = F.when(F.col("size") > 0, F.coalesce("rounds", F.lit(0))).otherwise(0).cast("long")
    extra = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["to"] - p["from"])
    return laid.select(
        "row", "doc_id", "size", "source_size", "target",
        (rounds * F.col("size") + extra).alias("taken"), rounds.alias("rounds"), "parts",
    )
