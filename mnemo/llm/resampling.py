"""Target-distribution importance resampling with Arrow kernels.

Documents are drawn towards a target text set by hashed word n-gram features. A batch of texts is
one flat list of words, coded by a dictionary; shifted codes are the bigrams, and only distinct
words and pairs are hashed. Two narrow passes: counts of all documents and of the target, then
the mean gain of each document. Gumbel noise turns the highest scores into a weighted draw.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from mnemo.llm.common import utf8
from mnemo.llm.mixing import ranked
from mnemo.sources.tables import stage

#: What lies between words: ASCII other than digits and (lower-cased) letters.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before letters are lower-cased, and the bytes inside and outside of words.
GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
GAP_BYTES = bytes(b for b in range(256) if GAP.match(bytes([b])))
WORD_BYTES = bytes(b for b in range(256) if b not in GAP_BYTES)


@dataclass(frozen=True)
class ResampleConfig:
    buckets: int = 10_000
    #: Percent of the documents long enough that are drawn.
    percent: int = 25
    #: Words that a document needs to be drawn.
    least: int = 20
    seed: int = 7
    #: Bytes of text that are taken apart together; longer texts go in pieces.
    chunk: int = 4 << 20


def _pieces(texts: Iterable[bytes], size: int) -> Iterator[tuple[int, bytes, bool]]:
    """(place, piece, whether the piece begins with the last word of the one before).

    Pieces end between words; only a single word can be longer than ``size`` by much.
    """
    for place, text in enumerate(texts):
        at, last = 0, b""
        while True:
            gap = GAP.search(text, at + size) if len(text) - at > size else None
            end = gap.end() if gap else len(text)
            yield place, b" ".join([last, text[at:end]]) if last else text[at:end], bool(last)
            if end == len(text):
                break
            head = text[at:end].rstrip(GAP_BYTES)
            at, last = end, head[len(head.rstrip(WORD_BYTES)):] or last


def _chunks(texts: pa.Array, size: int) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """Pieces in chunks of about ``size`` bytes: their places, texts and carried-word flags."""
    held, total = [], 0

    def packed():
        place, pieces, carried = zip(*held)
        return np.array(place), pa.array(pieces, pa.binary()).view(pa.string()), np.array(carried)

    for item in _pieces(utf8(texts), size):
        if held and total + len(item[1]) > size:
            yield packed()
            held, total = [], 0
        held.append(item)
        total += len(item[1])
    if held:
        yield packed()


def features(texts: pa.Array, config: ResampleConfig) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Word and bigram buckets of the texts, chunk by chunk.

    Yields the place of the text and the bucket of every feature, and how many leading entries
    are single words; the words and the pairs are each in order of place.
    """
    for place, part, carried in _chunks(texts, config.chunk):
        split = pc.split_pattern_regex(pc.ascii_lower(part), pattern=GAPS)
        flat, owner = pc.list_flatten(split), pc.list_parent_indices(split)
        kept = pc.not_equal(pc.binary_length(flat), 0)
        coded = flat.filter(kept).dictionary_encode()
        owner = owner.filter(kept).to_numpy()
        code = coded.indices.to_numpy().astype(np.int64)
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        if not words:
            yield place[:0], np.zeros(0, np.int64), 0
            continue
        crc = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
        # The word that a piece carries over counts with its pair only.
        first = np.append(True, owner[1:] != owner[:-1])
        single = ~(first & carried[owner])
        follows = np.flatnonzero(~first)
        pairs = pa.array(code[follows - 1] * len(words) + code[follows]).dictionary_encode()
        distinct = pairs.dictionary.to_numpy()
        before, after = np.divmod(distinct, len(words))
        spaced = [zlib.crc32(b" ", c) for c in crc.tolist()]
        hashed = map(zlib.crc32, map(words.__getitem__, after.tolist()), map(spaced.__getitem__, before.tolist()))
        pair_bucket = pa.array(np.fromiter(hashed, np.int64, len(distinct)) % config.buckets)
        word_bucket = pa.array(crc % config.buckets)
        of = place[owner]
        yield (
            np.concatenate([of[single], of[follows]]),
            np.concatenate([word_bucket.take(pa.array(code[single])).to_numpy(), pair_bucket.take(pairs.indices).to_numpy()]),
            int(single.sum()),
        )


def counts(texts: DataFrame, config: ResampleConfig = ResampleConfig()) -> DataFrame:
    """Features of all ``texts`` (text) per bucket: (bucket, n). A task returns one row a bucket."""
    def run(batches):
        total = np.zeros(config.buckets, np.int64)
        for batch in batches:
            for _, bucket, _ in features(batch.column(0), config):
                total += np.bincount(bucket, minlength=config.buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bucket", "n"])

    found = texts.select("text").mapInArrow(run, "bucket long, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, config: ResampleConfig = ResampleConfig()) -> np.ndarray:
    """Per bucket, how much likelier its features are in the target, in thousandths of a nat.

    ``corpus`` and ``target`` as from ``counts``; the result has one number a bucket, so its size
    is set by ``buckets`` alone.
    """
    every = corpus.sparkSession.range(config.buckets).select(F.col("id").alias("bucket"))
    both = every.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    both = both.fillna(0)
    sums = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    d = {k: F.col(k).cast("double") for k in ("s", "t", "all_s", "all_t")}
    both = both.crossJoin(F.broadcast(sums.select(F.col("s").alias("all_s"), F.col("t").alias("all_t"))))
    ratio = (d["t"] + 1) * (d["all_s"] + config.buckets) / ((d["s"] + 1) * (d["all_t"] + config.buckets))
    out = np.zeros(config.buckets, np.int64)
    for row in both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).collect():
        out[row.bucket] = row.gain
    return out


def weigh(docs: DataFrame, gain: np.ndarray, config: ResampleConfig = ResampleConfig()) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, n_words, n_features and weight, the floored mean gain."""
    table = pa.array(gain)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            words, all_, total = (np.zeros(n, np.int64) for _ in range(3))
            for place, bucket, single in features(batch.column(1), config):
                got = table.take(pa.array(bucket)).to_numpy()
                for run_, count in ((slice(0, single), True), (slice(single, None), False)):
                    at = np.searchsorted(place[run_], np.arange(n + 1))
                    size = np.diff(at)
                    total += np.diff(np.append(0, np.cumsum(got[run_]))[at])
                    all_ += size
                    words += size if count else 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words), pa.array(all_), pa.array(total // np.maximum(all_, 1))],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, config: ResampleConfig = ResampleConfig()) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, n_features, weight, score and rank, one row per row.

    ``target`` (text) is the distribution to draw towards. Of the documents with ``least`` words
    or more, ``percent`` per cent are drawn by score, weight plus seeded Gumbel noise, ties to the
    smaller doc_id; rank counts them from 1, for others it is null. Null texts count as empty:
    weight 0, never drawn, but for ``least`` 0. A null doc_id has the noise of an empty one and
    comes after others of its score. Repeated rows are documents of their own, each with a place
    of its own; equal rows get successive ranks. An empty table gives no rows, an empty target
    leaves what is rare in the corpus.
    """
    # A row a bucket; read more than once, so the texts are taken apart once for it.
    gain = gains(stage(counts(docs, config), "counts"), stage(counts(target, config), "counts"), config)
    digits = F.substring(F.sha2(F.concat(F.lit(f"{config.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    noise = F.floor(-1000 * F.log(-F.log((F.conv(digits, 16, 10).cast("long") + 0.5) / F.lit(float(1 << 32)))))
    scored = weigh(docs, gain, config).withColumn("score", F.col("weight") + noise)
    scored = stage(scored.withColumn("_place", F.monotonically_increasing_id()), "scored")
    able = scored.filter(F.col("n_words") >= config.least)
    # Scores are whole thousandths of a logarithm: some ten thousand different ones at any size.
    totals = able.groupBy("score").agg(F.count("*").alias("n"))
    upto = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    drawn = able.count() * config.percent // 100
    last = totals.withColumn("n", F.sum("n").over(upto)).filter(F.col("n") >= drawn).agg(F.max("score")).first()[0]
    shown = ["doc_id", "n_features", "weight", "score"]
    if not drawn:
        return scored.select(*shown, F.lit(None).cast("long").alias("rank"))
    reached = F.col("score") >= last
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight"), F.col("_place")]
    first = ranked(able.filter(reached).select(*shown, "_place"), *order)
    rest = scored.filter((F.col("n_words") < config.least) | ~reached)
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).cast("long")
    return rest.select(*shown, F.lit(None).cast("long").alias("rank")).unionByName(first.select(*shown, rank.alias("rank")))
