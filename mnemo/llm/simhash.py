"""Near-duplicates by SimHash fingerprints and pigeonhole blocks.

A 64-bit fingerprint is cut in seven blocks. Two fingerprints that differ in at most four bits
agree in at least three of the seven, so every such pair meets under one of the 35 triples of
blocks. Fingerprints are joined on (triple, its bits); whoever meets is compared in full. Equal
fingerprints are one node from the start, and a block yields a spanning forest of its links, not
all its pairs: the components stay the same.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType

from mnemo.llm.common import per_text
from mnemo.llm.graph import components
from mnemo.sources.tables import stage

SHINGLE, NEAR, BLOCKS = 4, 4, 7
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Shingles, and fingerprints of a block, that are looked at together.
CHUNK = 255 * 256


def fingerprint(text: bytes) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes; 0 without a word."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(flat, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)[: len(words) - SHINGLE + 1]
    ends = ends[SHINGLE - 1:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        spans = zip(starts[at: at + CHUNK].tolist(), ends[at: at + CHUNK].tolist())
        hashes = np.array([digest(flat[s:e], 42) for s, e in spans], ">u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        whole = len(bits) // 255 * 255
        # 255 ones still fit a byte, so most of the sum is over bytes.
        ones += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        ones += bits[whole:].sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(starts)).tobytes(), "big")


def _signed(texts):
    return [f - (1 << 64) if f >> 63 else f for f in map(fingerprint, texts)]


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) to (doc_id, bits long); null texts have no word."""
    return docs.select("doc_id", per_text(LongType(), _signed)(F.col("text")).alias("bits"))


def _keys():
    cuts = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    for n, triple in enumerate(combinations(range(BLOCKS), BLOCKS - NEAR)):
        key, width = F.lit(0).cast("long"), 0
        for b in triple:
            size = cuts[b + 1] - cuts[b]
            part = F.shiftrightunsigned("bits", cuts[b]).bitwiseAND(F.lit((1 << size) - 1))
            key, width = key.bitwiseOR(F.shiftleft(part, width)), width + size
        yield key.bitwiseOR(F.lit(n << 32))


def forest(prints: np.ndarray) -> list[tuple[int, int]]:
    """Index pairs within NEAR bits that connect all that such pairs connect.

    Leaders take in whoever is near; two groups are compared member by member only if their
    leaders are close enough for a link and nothing has connected them yet.
    """
    links, groups, left = [], [], np.arange(len(prints))
    while len(left):
        near = np.bitwise_count(prints[left] ^ prints[left[0]]) <= NEAR
        group, left = left[near], left[~near]
        links += [(int(group[0]), int(x)) for x in group[1:]]
        groups.append(group)
    root = list(range(len(groups)))

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    leaders = prints[[g[0] for g in groups]]
    for i in range(len(groups)):
        apart = np.bitwise_count(leaders[i + 1:] ^ leaders[i])
        for j in (np.flatnonzero(apart <= 3 * NEAR) + i + 1).tolist():
            if find(i) == find(j) or (len(groups[i]) == 1 and len(groups[j]) == 1):
                continue
            other = prints[groups[j]]
            step = max(1, (1 << 22) // len(other))
            for at in range(0, len(groups[i]), step):
                mine = groups[i][at: at + step]
                x, y = np.nonzero(np.bitwise_count(prints[mine][:, None] ^ other[None, :]) <= NEAR)
                if len(x):
                    links.append((int(mine[x[0]]), int(groups[j][y[0]])))
                    root[find(j)] = find(i)
                    break
    return links


def _link(batches):
    """Rows (key, bits) in key order to links; only the run of the last key is held over."""
    keys, prints = np.zeros(0, np.int64), np.zeros(0, np.int64)
    ended = False
    stream = iter(batches)
    while not ended:
        batch = next(stream, None)
        ended = batch is None
        if not ended:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            prints = np.concatenate([prints, batch.column(1).to_numpy()])
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
        stops = np.append(starts[1:], len(keys))
        whole = len(starts) if ended else max(0, len(starts) - 1)
        found: list[tuple[int, int]] = []
        for r in np.flatnonzero(stops[:whole] - starts[:whole] > 1).tolist():
            at, end = int(starts[r]), int(stops[r])
            run = prints[at:end].view(np.uint64)
            if end - at == 2:
                if int(run[0] ^ run[1]).bit_count() <= NEAR:
                    found.append((at, at + 1))
            else:
                found += [(at + i, at + j) for i, j in forest(run)]
        if found:
            pairs = np.array(found)
            yield pa.RecordBatch.from_pydict({
                "a": pa.array(prints[pairs[:, 0]]), "b": pa.array(prints[pairs[:, 1]]),
            })
        rest = int(starts[whole]) if whole < len(starts) else len(keys)
        keys, prints = keys[rest:], prints[rest:]


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, fingerprint and component_id, one row per row.

    Fingerprints link at NEAR or fewer differing bits; the component is named by its least
    doc_id. Rows with a null id take part and get the name of their group, null if no row of it
    has an id. Repeated rows get the same result each.
    """
    prints = stage(fingerprints(docs), "prints")
    distinct = prints.groupBy("bits").agg(F.min("doc_id").alias("first"))
    keyed = distinct.select(F.explode(F.array(*_keys())).alias("key"), "bits")
    links = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_link, "a long, b long")
    roots = components(links).withColumnRenamed("node", "bits")
    named = distinct.join(roots, "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    names = named.groupBy("root").agg(F.min("first").alias("component_id"))
    found = named.join(names, "root").select("bits", "component_id")
    return prints.join(found, "bits").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"
    )
