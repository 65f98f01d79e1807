"""Approximate nearest neighbours by cosine: a forest of hash-prefix trees.

A tree gives each vector a long string of hash symbols: the nearest of the signed axes of one
random rotation per symbol. The strings of a tree, sorted, are its array; rows that share a prefix
of any length lie together. The sizes of all prefix groups are counted first. A query ascends in
all trees at once, the longest prefixes first, until a level has enough candidates; then its group
of that level is read whole in every array, however many blocks it covers. Candidates are ranked
by exact double cosine on the original vectors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from mnemo.llm.mixing import ranked
from mnemo.sources.tables import stage


@dataclass(frozen=True)
class ForestConfig:
    trees: int = 48
    #: Symbols of a string, or as many as fit a long.
    symbols: int = 8
    #: The ascent stops at the first level whose groups, over all trees, have this many rows ...
    enough: int = 16_384
    #: ... and this share of all distinct vectors, so recall does not fall as the table grows.
    share: float = 1 / 3
    #: Rows of an array that are read together.
    block: int = 8192
    #: Candidates per block and tree that go on to the exact ranking, besides the k + 1 wanted.
    spare: int = 6
    seed: int = 3

    def length(self, dim: int) -> int:
        return max(1, min(self.symbols, 62 // (2 * dim - 1).bit_length()))


def clean(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) whose vectors can be compared: finite, not zero, ids not null."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    whole = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = (F.size("embedding") > 0) & whole & F.exists(e, lambda x: x != 0) & F.col("vec_id").isNotNull()
    return vectors.select("vec_id", "embedding").filter(usable)


def _strings(dim: int, config: ForestConfig):
    """(cid, embedding) to a row per tree: hash string as one number, and the vector in bytes."""
    def run(batches):
        rng = np.random.default_rng(config.seed)
        symbols = config.length(dim)
        turns = [rng.standard_normal((dim, dim)).astype(np.float32) for _ in range(config.trees * symbols)]
        base = 2 * dim
        for whole in batches:
            for at in range(0, len(whole), 2048):
                batch = whole.slice(at, min(2048, len(whole) - at))
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                x = x / np.abs(x).max(1, keepdims=True)
                unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
                # Two bytes a component: one is too coarse to rank a cluster of close vectors.
                small = np.round(unit * (32767 / np.abs(unit).max(1, keepdims=True))).astype(np.int16)
                blobs = pa.array([r.tobytes() for r in small], pa.binary())
                for tree in range(config.trees):
                    code = np.zeros(len(unit), np.int64)
                    for s in range(symbols):
                        y = unit @ turns[tree * symbols + s]
                        axis = np.abs(y).argmax(1)
                        code = code * base + axis * 2 + (y[np.arange(len(y)), axis] > 0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(unit), tree, np.int32)), pa.array(code), batch.column(0), blobs],
                        names=["tree", "code", "cid", "small"],
                    )

    return run


def _read(dim: int, k: int, config: ForestConfig):
    """One block of a tree's array, with the queries whose groups reach into it, to candidates."""
    keep = k + 1 + config.spare

    def run(table: pa.Table) -> pa.Table:
        place, cid, low, high = (table[x].to_numpy() for x in ("rank", "cid", "low", "high"))
        asks = table["asks"].to_numpy()
        x = np.frombuffer(b"".join(table["small"].to_pylist()), np.int16).reshape(-1, dim).astype(np.float32)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        rows = np.flatnonzero(~asks)
        rows = rows[np.argsort(place[rows], kind="stable")]
        places, ids, xs = place[rows], cid[rows], x[rows]
        query, found = [], []
        for q in np.flatnonzero(asks).tolist():
            lo = int(np.searchsorted(places, low[q], "left"))
            hi = int(np.searchsorted(places, high[q], "right"))
            near = xs[lo:hi] @ x[q]
            at = np.argpartition(-near, keep)[:keep] if hi - lo > keep else np.arange(hi - lo)
            query.append(int(cid[q]))
            found.append(ids[lo:hi][at].tolist())
        return pa.table([pa.array(query, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["query", "found"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int, config: ForestConfig = ForestConfig()) -> DataFrame:
    """The k nearest of ``vectors`` (vec_id, embedding) to each of ``queries`` (vec_id of them).

    query_id, rank from 1, vec_id, score: double cosine, ties to smaller ids, the query's own row
    left out. Vectors that are null, zero or not finite take no part; a query of that kind has no
    rows. Equal vectors are searched once, with their k + 1 smallest ids, and a query returns to
    each of its ids at the end, so copies cost nothing. All vectors must have one length.
    """
    usable = clean(vectors)
    first = usable.select(F.size("embedding").alias("n")).agg(F.min("n"), F.max("n")).first()
    if first[0] is None:
        return usable.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if first[0] != first[1]:
        raise ValueError(f"vectors of {first[0]} and of {first[1]} components")
    dim = first[0]
    # One row per distinct vector; ids beyond the k + 1 smallest can be in no result.
    order = Window.partitionBy("embedding").orderBy("vec_id")
    few = usable.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    classes = stage(few.groupBy("embedding").agg(
        F.min("vec_id").alias("cid"), F.sort_array(F.collect_list("vec_id")).alias("ids")
    ), "classes")
    asked = usable.join(queries.select("vec_id").distinct(), "vec_id", "left_semi")
    asked = stage(asked.join(classes.select("embedding", "cid"), "embedding").select(F.col("vec_id").alias("query_id"), "cid"), "asked")

    strings = classes.select("cid", "embedding").mapInArrow(
        _strings(dim, config), "tree int, code long, cid long, small binary"
    )
    index = ranked(strings, "tree", "code", "cid")
    total = classes.count()
    enough, symbols = max(config.enough, math.ceil(config.share * total)), config.length(dim)
    # Every prefix group's size and first place; depth 0 is the whole array.
    shared = F.explode(F.array(*[
        F.struct(F.lit(d).alias("depth"), F.expr(f"code div {(2 * dim) ** (symbols - d)}L").alias("prefix"))
        for d in range(1, symbols + 1)
    ]))
    groups = index.select("tree", "rank", shared.alias("g")).select("tree", "rank", "g.*")
    groups = groups.groupBy("tree", "depth", "prefix").agg(F.min("rank").alias("low"), F.max("rank").alias("high"))
    ask = index.join(asked.select("cid").distinct(), "cid", "left_semi")
    own = ask.select("cid", "tree", shared.alias("g")).select("cid", "tree", "g.*")
    own = stage(own.join(groups, ["tree", "depth", "prefix"]).select("cid", "tree", "depth", "low", "high"), "own")
    levels = own.groupBy("cid", "depth").agg(F.sum(F.col("high") - F.col("low") + 1).alias("n"))
    stop = levels.groupBy("cid").agg(F.coalesce(F.max(F.when(F.col("n") >= enough, F.col("depth"))), F.lit(0)).alias("depth"))
    # At depth 0 all trees hold the same rows, so the first is read alone.
    top = stop.filter("depth = 0").select("cid", F.lit(0).alias("tree"))
    ends = index.filter("tree = 0").agg(F.min("rank").alias("low"), F.max("rank").alias("high"))
    wanted = own.join(stop, ["cid", "depth"]).select("cid", "tree", "low", "high").unionByName(
        top.crossJoin(ends)
    )
    wanted = wanted.join(ask.select("cid", "tree", "small"), ["cid", "tree"])
    block = lambda c: F.floor(F.col(c) / config.block)
    none = F.lit(None).cast("long")
    rows = index.select("tree", "rank", "cid", "small", none.alias("low"), none.alias("high"), F.lit(False).alias("asks"), block("rank").alias("block"))
    wanted = wanted.select(
        "tree", F.lit(-1).cast("long").alias("rank"), "cid", "small", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"),
        F.lit(True).alias("asks"), F.explode(F.sequence(block("low"), block("high"))).alias("block"),
    )
    found = rows.withColumn("rank", F.col("rank").cast("long")).unionByName(wanted).groupBy("tree", "block").applyInArrow(
        _read(dim, k, config), "query long, found array<long>"
    )
    pairs = found.select("query", F.explode("found").alias("cid")).distinct()

    a = classes.select(F.col("cid").alias("query"), F.col("embedding").alias("x"))
    b = classes.select("cid", F.col("embedding").alias("y"), "ids")
    d = lambda v, w: F.aggregate(F.zip_with(v, w, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    scored = pairs.join(b, "cid").join(a, "query").select(
        "query", "ids", (d("x", "y") / (F.sqrt(d("x", "x")) * F.sqrt(d("y", "y")))).alias("score")
    )
    each = scored.select("query", F.explode("ids").alias("vec_id"), "score")
    by = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = each.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= k + 1)
    result = asked.join(top.withColumnRenamed("query", "cid"), "cid").filter("vec_id != query_id")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    result = result.withColumn("rank", F.row_number().over(own).cast("int")).filter(F.col("rank") <= k)
    return result.select("query_id", "rank", "vec_id", "score")
