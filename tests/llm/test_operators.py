"""Each operator against brute force on small rows: nulls, empty texts, ties, repeats, odd columns."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from mnemo.llm import (
    hamming, language, licenses, mixing, neighbours, packing, perplexity, quality, simhash,
    substring,
)
from mnemo.llm.catalog import pack_config

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, row string, h int"
LOREM = " ".join(f"w{i}" for i in range(60))
TEXTS = [
    (1, LOREM, "en", "a"), (2, LOREM, "en", "a"), (3, "x " + LOREM + " y", "en", None), (3, "other text", "fr", "b"),
    (4, None, None, "b"), (5, "", "en", ""), (6, "  \n", "fr", "b"), (7, "été à la plage", "fr", "b"),
    (8, LOREM + " " + LOREM, "en", "c"), (None, "no id here", "en", None), (9, "short one", "en", "a"),
    (9, "short one", "en", "a"), (10, "12 34 !!", "en", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*t, len(t[1] or ""), 1, "r", 2) for t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def test_substring(docs, none):
    got = {}
    for r in substring.remove_repeats(docs).collect():
        got.setdefault((r.row.doc_id, r.n_words), []).append((r.n_removed, r.text))
    seen, want = set(), {}
    order = sorted({t[:2] for t in TEXTS if t[0] is not None}, key=lambda t: (t[0], t[1] or ""))
    for key, text in [*order, (None, "no id here")]:
        w, gone = words(text), set()
        for i in range(len(w) - 19):
            gram = tuple(w[i:i + 20])
            gone |= set(range(i, i + 20)) if gram in seen else set()
            seen.add(gram)
        want.setdefault((key, len(w)), []).append((len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    want[9, 2] *= 2
    assert got == want
    assert substring.remove_repeats(none).count() == 0


def brute_print(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs).collect()
    prints = [brute_print(t[1]) for t in TEXTS]
    root = list(range(len(TEXTS)))
    for _ in TEXTS:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 4:
                    root[i] = root[j] = min(root[i], root[j])
    ids = {r: min((TEXTS[i][0] for i in range(len(TEXTS)) if root[i] == r and TEXTS[i][0] is not None), default=None) for r in root}
    want = sorted((str(t[0]), f"{p:016x}", ids[r]) for t, p, r in zip(TEXTS, prints, root))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == [
        (a, b, c) for a, b, c in want
    ]
    assert simhash.near_duplicates(none).count() == 0


def test_forest_links_what_pairs_link():
    rng = np.random.default_rng(0)
    prints = [int(x) for x in rng.integers(0, 1 << 63, 20)]
    for p in list(prints):
        for _ in range(10):
            p ^= 1 << int(rng.integers(64)) | 1 << int(rng.integers(64))
            prints.append(p)
    prints = np.unique(np.array(prints, np.uint64))

    def groups(pairs):
        root = list(range(len(prints)))
        for _ in range(len(prints)):
            for i, j in pairs:
                root[i] = root[j] = min(root[i], root[j])
        return root

    near = [(i, j) for i in range(len(prints)) for j in range(i) if int(prints[i] ^ prints[j]).bit_count() <= 4]
    assert groups(simhash.forest(prints)) == groups(near)


def test_near_copies_stage(spark, docs):
    """Edited copies around similarity 0.8, against all pairs of five-word shingle sets."""
    from mnemo.llm.stages import drop_near_copies

    rng = np.random.default_rng(3)
    texts = []
    for family in range(6):
        base = [f"f{family}w{x}" for x in rng.integers(0, 500, 200)]
        texts.append(" ".join(base))
        for edits in (0, 1, 2, 3, 4, 5, 6, 8):
            w = list(base)
            for at in rng.choice(200, edits, replace=False):
                w[at] = f"new{rng.integers(1 << 40)}"
            texts.append(" ".join(w))
    rows = [(100 + i, t) for i, t in enumerate(texts)]
    data = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    rows += [t[:2] for t in TEXTS]
    sets = []
    for _, t in rows:
        w = words((t or "").lower())
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    for _ in range(4):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a == b or 5 * len(a & b) >= 4 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    # One row of each group: rows are judged, not ids, so a repeated id saves no other row.
    want = [
        min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)
    ]
    assert sorted(map(str, want)) == sorted(str(r.doc_id) for r in drop_near_copies(spark, data, "").collect())


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(TEXTS)
    total, sizes = 0, {}
    for t in TEXTS:
        sizes[t[3]] = sizes.get(t[3], 0) + len(words(t[1]))
        total += len(words(t[1]))
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, capped = {}, set()
    while True:
        level = (total - sum(3 * sizes[s] for s in capped)) / max(1, sum(weight[s] for s in sizes if s not in capped))
        target = {s: 3 * sizes[s] if s in capped else level * weight[s] for s in sizes}
        more = {s for s in sizes if s not in capped and target[s] > 3 * sizes[s]}
        if not more:
            break
        capped |= more
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.size == len(words(r.row.text)) and 0 <= r.taken <= 3 * r.size
        assert r.source_size == sizes[r.row.source]
        assert math.isclose(r.target, target[r.row.source], abs_tol=1e-6)
        taken[r.row.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 2 for s in sizes)
    assert mixing.mix(none).count() == 0


def test_packing(docs, none):
    from tokenizers import Tokenizer

    config = pack_config()
    full = Tokenizer.from_file(config.tokenizer)
    long = docs.sparkSession.createDataFrame([(20, "Don't stop. " * 3000 + "a" * 9000 + " éÀ<|x|> ｗ İx"), (21, "z. " * 10)], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(long)
    pieces = packing.pack(both, config).collect()
    texts = {20: long.first().text, 21: "z. " * 10, 7: TEXTS[7][1], 1: LOREM, 4: ""}
    import zlib

    for key, text in texts.items():
        ids = np.array(full.encode(text, add_special_tokens=False).ids + [config.end], "<u4")
        mine = sorted((p for p in pieces if p.doc_id == key), key=lambda p: p.start)
        assert [p.start for p in mine] == [0, *np.cumsum([p.length for p in mine])[:-1]]
        assert sum(p.length for p in mine) == len(ids) == mine[0].doc_tokens
        assert all(zlib.crc32(ids[p.start:p.start + p.length].tobytes()) == p.ids_crc32 for p in mine)
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append(p)
    for ps in by.values():
        ps.sort(key=lambda p: p.offset)
        assert [p.offset for p in ps] == [0, *np.cumsum([p.length for p in ps])[:-1]]
        assert sum(p.length for p in ps) <= 2048
    assert packing.pack(none, config).count() == 0


def test_cuts_are_optimal():
    config = packing.PackConfig("", length=16, exact=(4, 8))
    rng = np.random.default_rng(1)
    for _ in range(30):
        at = np.unique(rng.integers(1, 60, 20))
        at = at[np.append(True, np.diff(at) <= 16)] if at[0] <= 16 else np.array([16])
        if np.any(np.diff(np.append(0, at)) > 16):
            continue
        cost = rng.integers(0, 9, len(at))

        def price(ends):
            total, start = 0, 0
            for e in ends:
                n = e - start
                total += (0 if n in (4, 8, 16) else 16 - n) + int(cost[list(at).index(e)])
                start = e
            return total

        best = {0: 0}
        for j, e in enumerate(at.tolist()):
            best[e] = min(best[s] + (0 if e - s in (4, 8, 16) else 16 - e + s) + int(cost[j]) for s in best if 0 < e - s <= 16)
        assert price(packing.cuts(at, cost, config)) == best[int(at[-1])]


def test_quality(spark, docs, none):
    rows = [(i, ("good words in plain lines " if i % 2 else "BUY!!! NOW!!! ") * (i % 7 + 1)) for i in range(80)]
    data = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (70, None), (71, 3)], "doc_id long, label int")
    model = quality.fit(data, labels)
    got = {r.doc_id: r for r in quality.score(data, model).collect()}
    assert all(got[i].predicted == i % 2 for i in range(80))
    assert quality.score(docs, model).filter("score BETWEEN 0 AND 1").count() == len(TEXTS)
    empty = quality.fit(none, labels.limit(0))
    assert quality.score(docs, empty).filter("score = 0.5 AND predicted = 1").count() == len(TEXTS)


def test_language(docs, none):
    model = language.fit(docs)
    got = docs.select("doc_id", "text", language.identify(F.col("text"), model).alias("x")).collect()
    assert all(r.x.lang_pred == "und" and r.x.score == 0 for r in got if not any(c.isalpha() for c in r.text or ""))
    assert {r.x.lang_pred for r in got if r.doc_id in (1, 7)} == {"en", "fr"}
    assert all(0 <= r.x.score <= 1 for r in got)
    assert language.fit(none) is None
    assert docs.select(language.identify(F.col("text"), None).alias("x")).filter("x.lang_pred = 'und'").count() == len(TEXTS)


def test_perplexity(docs, none):
    from collections import Counter

    config = perplexity.ScoreConfig(sample=50, bits=14)
    data = docs.withColumn("training", F.coalesce(F.col("doc_id") != 8, F.lit(True)))
    priced, n, v = perplexity.fit(data, config)
    count = Counter()
    for t in TEXTS:
        if t[0] != 8:
            count.update([w.lower() for w in words(t[1])] + ["\n"])
    assert (n, v) == (sum(count.values()), len(count))
    got = perplexity.score(data, priced, n, config).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        text = next(t[1] for t in TEXTS if t[0] == r.doc_id and len(words(t[1])) + 1 == r.n_tokens)
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [x.lower() for x in words(text)] + ["\n"])
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    priced, n, v = perplexity.fit(none.withColumn("training", F.lit(True)), config)
    assert perplexity.score(none, priced, n, config).count() == 0


def test_spelling_learns_from_every_word(spark):
    """Learners together take every known word once; the mean of what they learned prices the words."""
    config = perplexity.ScoreConfig(sample=80, wide=2, group=8, bits=12)
    made = [f"w{i * 7919 % 1000}{'abc'[i % 3]}" for i in range(300)]
    data = spark.createDataFrame([(" ".join(made), True), ("unknown words", False)], "text string, training boolean")
    priced, n, v = perplexity.fit(data, config)
    known = [w.encode() for w in sorted(set(made))] + [perplexity.END]
    assert v == len(known)
    counts = np.zeros((2, 1 << config.bits), np.float32)
    for _, slots, _, bit in perplexity.bit_contexts(known, config.bits):
        np.add.at(counts, (np.broadcast_to(bit, slots.shape), slots), 1)
    rows = spark.createDataFrame([(w,) for w in known], "word binary")
    rows = rows.selectExpr("word", "xxhash64(word) AS h").orderBy("h", "word").collect()
    shares = [[bytes(r.word) for r in rows if r.h % 4 == k] for k in range(math.ceil(v / 80))]
    assert len(shares) == 4 and all(shares) and sum(map(len, shares)) == v
    each = [perplexity.Mixer(counts) for _ in shares]
    for m, share in zip(each, shares):
        m.learn(share, config, 2)
    mixer = perplexity.Mixer(counts)
    mixer.weights, mixer.map = (np.mean([getattr(m, x) for m in each], axis=0) for x in ("weights", "map"))
    got = {bytes(r.word): r for r in priced.collect()}
    spelling = dict(zip(got, 10 ** mixer.log10(list(got), config.bits)))
    for w, r in got.items():
        p = max(r.c - config.discount, 0) / n + config.discount * v / n * spelling[w]
        assert math.isclose(10 ** r.logp, p, rel_tol=1e-9)


def test_spelling_is_a_distribution():
    mixer = perplexity.Mixer(np.random.default_rng(0).integers(0, 5, (2, 1 << 10)).astype(np.float32))
    one = [bytes([b]) for b in range(256) if b != perplexity.STOP]
    first = sum(10 ** (mixer.log10([w], 10)[0]) for w in one) + 10 ** mixer.log10([b""], 10)[0]
    assert first <= 1 + 1e-9


@pytest.mark.parametrize("n", [3, 400])
def test_searches(spark, n):
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[0].tolist()) for i in range(9)]
    odd = [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [None] + [1.0] * 7), (None, x[1].tolist())]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    asked = vectors.filter("vec_id % 50 = 0")
    u = {i: np.array(v, float) / np.linalg.norm(v) for i, v in rows}
    got = {}
    for r in neighbours.search(vectors, asked, 5).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    for q in [i for i in u if i % 50 == 0]:
        want = sorted(((round(float(u[q] @ u[i]), 9), -i) for i in u if i != q), reverse=True)[:5]
        assert got[q] == [(-i, s) for s, i in want]
    codes = hamming.sign_bits(vectors)
    bits = {r.vec_id: r.bits for r in codes.collect()}
    got = {}
    for r in hamming.search(codes, codes.filter("vec_id % 50 = 0"), 5).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.distance, r.vec_id))
    for q in [i for i in bits if i % 50 == 0]:
        assert got[q] == sorted((sum(a != b for a, b in zip(bits[q], bits[i])), i) for i in bits if i != q)[:5]
    assert neighbours.search(vectors.limit(0), asked, 5).count() == 0
    assert hamming.search(codes.limit(0), codes, 5).count() == 0


def test_neighbours_in_a_tight_cluster(spark):
    """Two thirds of the rows lie close together: more than any window of places around a query."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((6000, 16))
    x[rng.permutation(6000)[:4000]] = x[0] + rng.standard_normal((4000, 16)) * 0.01
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    got = {}
    for r in neighbours.search(vectors, vectors.filter("vec_id % 200 = 0"), 5).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for q in range(0, 6000, 200):
        near = u @ u[q]
        near[q] = -2
        hits += len(got[q] & set(np.argsort(-near)[:5].tolist()))
        total += 5
    assert hits >= 0.97 * total, hits / total


def test_licenses(spark, docs):
    mit, gpl = licenses.NOTICES["MIT"], licenses.NOTICES["GPL-3.0"]
    rows = [(1, f"a {mit} b {mit}"), (2, f"{gpl}\nwork the is under"), (3, "the license is under version"), (4, None), (5, "x " * 5000 + mit)]
    got = {r.doc_id: [(h.license, h.start, h.coverage) for h in r.hits] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == [("MIT", 1, 1.0), ("MIT", 7, 1.0)] and got[2][0][0] == "GPL-3.0"
    assert got[3] == [] and got[4] == [] and got[5] == [("MIT", 5000, 1.0)]
    assert licenses.scan(docs).count() == len(TEXTS)


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(60).cache()
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == columns and docs.count() > 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() >= docs.count()


def test_codes_are_the_bytes_around_the_beginnings_of_words():
    texts = ["ab c  déf\n", "", None, " Wordy words ", "x"]
    flat, offsets = perplexity.tokens(pa.array(texts))
    want = {True: [], False: []}
    for t in texts:
        line = b""
        for w in [*(t or "").lower().encode().split(), perplexity.END]:
            code = line[-4:].rjust(4, b"\0") + (w + b" ")[:4].ljust(4, b"\0")
            want[w == perplexity.END].append(int.from_bytes(code, "big"))
            line += w + b" "
    assert perplexity.codes(flat, offsets).tolist() == want[False] + want[True]


def test_words_are_spelled_after_the_text_before_them(spark):
    """After aa words begin with z, after bb with q; unknown words that do so, too, are likelier."""
    rng = np.random.default_rng(3)
    made = ["".join(rng.choice(list("cdefghijklmnop"), 5)) for _ in range(600)]
    training = " ".join(f"aa z{w}" if i % 2 else f"bb q{w}" for i, w in enumerate(made))
    rows = [(0, training, True), (1, "aa znewly bb qfound", False), (2, "bb znewly aa qfound", False)]
    data = spark.createDataFrame(rows, "doc_id long, text string, training boolean")
    for common in (2e-6, 1.0):
        config = perplexity.ScoreConfig(common=common)
        priced, n, _ = perplexity.fit(data, config)
        found = perplexity.score(data, priced, n, config, perplexity.fit_heads(data, config)).collect()
        score = {r.doc_id: r.score for r in found}
        assert len(found) == 3 and score[1] > score[2] + 1
    alone = {r.doc_id: r.score for r in perplexity.score(data, priced, n, config).collect()}
    assert abs(alone[1] - alone[2]) < 1e-6


def test_prices_of_codes_do_not_depend_on_what_a_task_met_before():
    rng = np.random.default_rng(4)
    mixer = perplexity.Mixer(rng.integers(0, 5, (2, 1 << 12)).astype(np.float32))
    code = perplexity.codes(*perplexity.tokens(pa.array([" ".join("".join(rng.choice(list("abcd"), rng.integers(1, 7))) for _ in range(500))])))
    memo = perplexity.Priced(mixer, 12)
    memo.room = 300
    want = mixer.log10_codes(code, 12)
    for part in (slice(0, 100), slice(50, 400), slice(300, 501), slice(0, 501)):
        assert np.allclose(memo(code[part]), want[part], rtol=1e-12)
