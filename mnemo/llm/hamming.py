"""Exact nearest binary codes by incremental multi-index hashing.

Codes are cut in segments. If no code within distance r of a query's segment is left unseen in any
segment, every code within m (r + 1) - 1 bits of the query has been seen. Radii grow from 0, one
join on (segment, value) each, until a query's kth verified distance is that close.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mnemo.sources.tables import stage


@dataclass(frozen=True)
class HammingConfig:
    #: Bits of a segment at most; fewer for small tables, about log2 of the number of codes.
    widest: int = 16


def sign_bits(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) to (vec_id, bits): one entry 0 or 1 per component, 1 above zero.

    Null vectors and ids take no part; a null or NaN component counts as not above zero.
    """
    bit = F.transform("embedding", lambda x: F.coalesce((x > 0) & ~F.isnan(x), F.lit(False)).cast("int"))
    return vectors.filter("embedding IS NOT NULL AND vec_id IS NOT NULL").select("vec_id", bit.alias("bits"))


def _segments(length: int, width: int) -> list[Column]:
    count = math.ceil(length / width)
    cuts = [length * i // count for i in range(count + 1)]
    return [
        reduce(lambda a, b: a + b, [F.shiftleft(F.col("bits")[i], i - s) for i in range(s, t)]).alias(f"s{j}")
        for j, (s, t) in enumerate(zip(cuts, cuts[1:]))
    ]


def search(codes: DataFrame, queries: DataFrame, k: int, config: HammingConfig = HammingConfig()) -> DataFrame:
    """The k nearest of ``codes`` (vec_id, bits) to each row of ``queries`` (vec_id of them), exactly.

    query_id, rank from 1, vec_id, distance; ties to smaller ids, the query's own row left out; all
    candidates if there are fewer. Equal codes are one node with its k + 1 smallest ids. All codes
    must have one length.
    """
    spark = codes.sparkSession
    span = codes.agg(F.min(F.size("bits")), F.max(F.size("bits")), F.approx_count_distinct("bits")).first()
    if span[0] is None or not span[1]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, distance int")
    if span[0] != span[1]:
        raise ValueError(f"codes of {span[0]} and of {span[1]} bits")
    width = max(4, min(config.widest, int(math.log2(max(2, span[2]))), span[0]))
    cut = _segments(span[0], width)
    m = len(cut)
    names = [f"s{j}" for j in range(m)]
    widest = math.ceil(span[0] / m)
    few = codes.withColumn("r", F.row_number().over(Window.partitionBy("bits").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    nodes = few.groupBy("bits").agg(F.min("vec_id").alias("cid"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = stage(nodes.select("cid", "ids", "bits", *cut), "codes")
    asked = codes.join(queries.select("vec_id").distinct(), "vec_id", "left_semi")
    asked = stage(asked.join(nodes.select("bits", "cid"), "bits").select(F.col("vec_id").alias("query_id"), "cid"), "asked")
    nodes = nodes.drop("bits")
    index = nodes.select("cid", "ids", *names, F.explode(F.array(*[
        F.struct(F.lit(j).alias("segment"), F.col(n).alias("value")) for j, n in enumerate(names)
    ])).alias("at")).select("cid", "ids", *names, "at.segment", "at.value")

    apart = [F.bit_count(F.col(f"q{j}").bitwiseXOR(F.col(n))) for j, n in enumerate(names)]
    distance = reduce(lambda a, b: a + b, apart).cast("int")
    codes_of = nodes.select(F.col("cid").alias("query"), *[F.col(n).alias(f"q{j}") for j, n in enumerate(names)])
    open_ = codes_of.join(asked.select(F.col("cid").alias("query")).distinct(), "query", "left_semi")
    open_ = stage(open_.withColumn("bound", F.lit(span[0])), "open")
    best = spark.createDataFrame([], "query long, vec_id long, distance int")
    finished = []
    by = Window.partitionBy("query").orderBy("distance", "vec_id")
    for radius in range(widest + 1):
        masks = [sum(1 << i for i in c) for c in combinations(range(widest), radius)]
        flips = spark.createDataFrame([(x,) for x in masks], "mask int")
        # Flips are at most C(16, 8) numbers.
        probes = open_.select("query", "bound", *[f"q{j}" for j in range(m)], F.explode(F.array(*[
            F.struct(F.lit(j).alias("segment"), F.col(f"q{j}").alias("own")) for j in range(m)
        ])).alias("at")).join(F.broadcast(flips))
        probes = probes.withColumn("value", F.col("at.own").bitwiseXOR(F.col("mask"))).withColumn("segment", F.col("at.segment")).drop("at", "mask")
        # A pair counts where it is first met: no segment is nearer, none of equal distance precedes.
        least = F.least(*apart) if m > 1 else apart[0]
        here = reduce(lambda a, j: a.when((F.col("segment") == j) & (apart[j] == radius), True), range(m), F.when(F.lit(False), True))
        before = reduce(lambda a, b: a | b, [(F.col("segment") > j) & (apart[j] == radius) for j in range(m)])
        hits = probes.join(index, ["segment", "value"]).filter(
            (least == radius) & F.coalesce(here, F.lit(False)) & ~before & (distance <= F.col("bound"))
        ).select("query", F.explode("ids").alias("vec_id"), distance.alias("distance"))
        top = best.unionByName(hits).withColumn("r", F.row_number().over(by)).filter(F.col("r") <= k + 1).drop("r")
        best = stage(top, "best")
        # Within this many bits everything has been seen.
        seen = m * (radius + 1) - 1
        kth = best.groupBy("query").agg(F.count("*").alias("n"), F.max("distance").alias("kth"))
        state = open_.drop("bound").join(kth, "query", "left")
        bound = F.when(F.col("n") > k, F.col("kth")).otherwise(span[0])
        open_ = stage(state.withColumn("bound", bound).drop("n", "kth").filter((F.col("bound") > seen) & F.lit(seen < span[0])), "open")
        finished.append(best.join(open_.select("query"), "query", "left_anti"))
        best = best.join(open_.select("query"), "query", "left_semi")
        if open_.isEmpty():
            break
    top = reduce(DataFrame.unionByName, finished).withColumnRenamed("query", "cid")
    own = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    result = asked.join(top, "cid").filter("vec_id != query_id")
    result = result.withColumn("rank", F.row_number().over(own).cast("int")).filter(F.col("rank") <= k)
    return result.select("query_id", "rank", "vec_id", "distance")
