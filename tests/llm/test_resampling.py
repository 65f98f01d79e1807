"""Importance resampling against a plain version: pieces, nulls, ties, repeats, odd columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from mnemo.llm import resampling
from mnemo.llm.resampling import ResampleConfig

SCHEMA = "doc_id long, text string, score string, rank int, n string"
LONG = " ".join(f"w{i % 37}é-{i % 11}" for i in range(300))
TEXTS = [
    (1, "The cat sat on THE mat. " * 6), (2, None), (3, ""), (4, " .,;!? "), (5, LONG), (5, LONG), (5, LONG), (None, LONG + " tail"),
    (6, "one"), (7, "x" * 500 + " " + "y z " * 30), (8, "ünïcödé straße Ärger " * 10), (9, "cat mat dog " * 8), (10, "0 1 2 " * 9),
]
TARGET = ["the cat sat on a mat", "dog and cat", None, "", LONG[:200]]


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def plain(texts, target, c):
    bucket = lambda f: zlib.crc32(f.encode()) % c.buckets
    s = Counter(bucket(f) for _, t in texts for f in features(t)[1])
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + c.buckets) / ((s[b] + 1) * (all_t + c.buckets))))
    out = []
    for i, text in texts:
        w, f = features(text)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{c.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), len(w)])
    able = sorted((r for r in out if r[4] >= c.least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    ranks = {}
    for n, r in enumerate(able[:len(able) * c.percent // 100], 1):
        ranks.setdefault(tuple(r), []).append(n)
    rows = []
    for r in out:
        held = ranks.get(tuple(r), [])
        rows.append((*r[:4], held.pop(0) if held else None))
    return sorted(rows, key=repr)


@pytest.mark.parametrize("config", [ResampleConfig(), ResampleConfig(buckets=50, percent=60, least=3, seed=1, chunk=40)])
def test_equals_the_plain_version(spark, config):
    docs = spark.createDataFrame([(i, t, "s", 1, "n") for i, t in TEXTS], SCHEMA).repartition(3)
    target = spark.createDataFrame([(t, 1) for t in TARGET], "text string, doc_id int")
    got = resampling.resample(docs, target, config)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(TEXTS, TARGET, config)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    docs = spark.createDataFrame([(i, t, "s", 1, "n") for i, t in TEXTS], SCHEMA)
    assert resampling.resample(none, none).count() == 0
    assert resampling.resample(none, docs).count() == 0
    got = resampling.resample(docs, none.select("text"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(TEXTS, [], ResampleConfig())


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 20])
def test_pieces_of_any_size_give_the_same_features(chunk):
    texts = ["Aa bB, " * 50 + "é" * 90 + ".Z" * 40, "", None, "q", "-- --" * 30, "End OF it!" * 9]
    got = Counter()
    for place, bucket, single in resampling.features(pa.array(texts), ResampleConfig(chunk=chunk)):
        got.update(zip(place.tolist(), bucket.tolist(), [i < single for i in range(len(bucket))]))
    want = Counter()
    for i, t in enumerate(texts):
        w, f = features(t)
        want.update((i, zlib.crc32(x.encode()) % 10_000, n < len(w)) for n, x in enumerate(f))
    assert got == want
