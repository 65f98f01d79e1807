import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from mnemo.config import DEFAULT_RULES
from mnemo.functions import vectors as v
from mnemo.operators.audit import IdentityMismatch, identity_audit, mixed_identity, require_identity
from mnemo.plans.reembed import reembed

C = F.col("c")


def expected(tokens, dim=512):
    def at(s):
        return int(hashlib.md5(s.encode()).hexdigest()[:15], 16) % dim

    cells = [0.0] * dim
    for token in tokens:
        cells[at(token)] += 1
        if len(token) > 4:
            for i in range(len(token) - 3):
                cells[at("#" + token[i:i + 4])] += 0.35
    cells = [1 + math.log(x) if x else 0.0 for x in cells]
    norm = math.sqrt(sum(x * x for x in cells)) or 1.0
    return [x / norm for x in cells]


def test_hashed_vectors(column):
    got = column(v.hashed_vectors(C), ["Vector store ranks vector", "", None, "the 12"])
    np.testing.assert_allclose(got[0], expected(["vector", "store", "ranks", "vector"]), atol=1e-6)
    assert all(not any(g) for g in got[1:])
    # A bucket holding a single n-gram goes negative: 1 + ln(0.35).
    assert min(got[0]) < 0


def test_many_rows_cross_batch_slices(spark):
    df = spark.range(5000).select("id", F.concat(F.lit("token"), "id").alias("c")).coalesce(1)
    rows = df.withColumn("e", v.hashed_vectors(F.col("c"))).collect()
    for row in rows[::997]:
        np.testing.assert_allclose(row.e, expected([row.c]), atol=1e-6)


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>").coalesce(1)
    got = [r.x for r in df.select(v.cosine(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == [pytest.approx(math.sqrt(0.5)), 0.0, 0.0]


def toy(width=2):
    class Lengths:
        """A stand-in for a model: text length and vowel count."""

        name, model, dimensions = "toy", "lengths-1", width

        def embed_batch(self, texts: pd.Series) -> np.ndarray:
            return np.stack([texts.str.len(), texts.str.count("[aeiou]")], axis=1)

    return Lengths()


def test_user_model_and_factory(spark):
    df = spark.createDataFrame([(1, ["ab", "xyz"]), (2, ["e"])], "id int, input array<string>")
    rows = v.embed_batch(df, "input", toy()).orderBy("id", "index").collect()
    assert [(r.id, r["index"], r.embedding) for r in rows] == [(1, 0, [2.0, 1.0]), (1, 1, [3.0, 0.0]), (2, 0, [1.0, 1.0])]
    assert tuple(rows[0].embed_identity) == ("toy", "lengths-1", 2)
    assert isinstance(v.get_embedder(), v.HashedEmbedder)
    assert v.get_embedder("toy", toy()).model == "lengths-1"
    with pytest.raises(v.EmbedderUnavailable):
        v.get_embedder("toy")
    assert isinstance(v.get_embedder("toy", allow_fallback=True), v.HashedEmbedder)


def test_wrong_width_fails(spark):
    with pytest.raises(Exception, match="expected"):
        v.embed(spark.createDataFrame([("a",)], "c string"), "c", toy(3)).collect()


def test_identity_checks(spark):
    model = v.HashedEmbedder()
    df = v.embed(spark.createDataFrame([(1, "alpha words"), (2, "beta words")], "id int, c string"), "c", model)
    mine = v.identity_of(model)
    assert tuple(identity_audit(df, mine).first()) == (2, 2, 0)
    require_identity(df, mine)
    # Same width, another model: refused.
    other = F.struct(F.lit("deterministic").alias("backend"), F.lit("other").alias("model"), F.lit(512).alias("dim"))
    with pytest.raises(IdentityMismatch):
        require_identity(df, other)
    unknown = df.withColumn("embed_identity", F.when(F.col("id") == 1, F.col("embed_identity")))
    assert tuple(identity_audit(unknown, mine).first()) == (2, 1, 1)
    assert tuple(mixed_identity(unknown).first()) == (2, True)


def test_reembed_changes_space_and_tags(spark):
    df = spark.createDataFrame([(1, "zfs on debian", "knowledge"), (2, "the roadmap", "knowledge"), (3, "the roadmap", "decision")],
                               "memory_id int, text string, type string")
    out = reembed(df, v.HashedEmbedder(DEFAULT_RULES.with_(hash_dim=32))).orderBy("memory_id").collect()
    assert [len(r.embedding) for r in out] == [32] * 3
    assert [r.experts for r in out] == [["linux_pro"], [], ["cto"]]
    assert out[0].embed_identity.model == "md5-32"


def test_paired_cosine_equals_cosine(spark):
    from mnemo.functions.vectors import cosine, paired_cosine

    rng = np.random.default_rng(4)
    pairs = [([float(v) for v in rng.normal(size=n)], [float(v) for v in rng.normal(size=m)]) for n, m in [(8, 8)] * 40 + [(3, 3), (8, 3)]]
    pairs += [([], []), (None, [1.0]), ([1.0], None), ([0.0, 0.0], [1.0, 2.0]), ([1.0, None], [1.0, 2.0]), ([1.0, 2.0], [2.0, 4.0])]
    df = spark.createDataFrame(pairs, "a array<float>, b array<float>")
    for r in df.select(cosine(F.col("a"), F.col("b")).alias("x"), paired_cosine(F.col("a"), F.col("b")).alias("y")).collect():
        assert abs(r.x - r.y) < 1e-12


def test_searches_compare_vectors_in_batches(spark):
    """Not number by number in the plan, where one pair costs thousands of expression steps."""
    from mnemo.plans.searches import search

    names = "project memory_type source source_type status entity".split()
    asked = spark.sql("SELECT 1 AS request_id, " + ", ".join(f"CAST(NULL AS string) AS {n}" for n in names) + (
        ", false AS approved_only, CAST(NULL AS array<string>) AS experts, CAST(NULL AS double) AS min_confidence,"
        " CAST(NULL AS timestamp) AS date_from, CAST(NULL AS timestamp) AS date_to, 5 AS limit, array(1f, 2f) AS embedding"
    ))
    rows = spark.sql(
        "SELECT id AS memory_id, 'x' AS text, 'a' AS type, 'approved' AS status, 'p' AS project, 's' AS source, 't' AS source_type, 1d AS confidence,"
        " CAST(NULL AS timestamp) AS ts, array('e') AS experts, array(1f, CAST(id AS float)) AS embedding FROM range(9)"
    )
    hits = search(asked, rows)
    assert "zip_with" not in hits._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.memory_id, r.rank) for r in hits.orderBy("rank").collect()] == [(2, 1), (3, 2), (4, 3), (5, 4), (6, 5)]


def test_memory_does_not_grow_with_a_batch():
    """Slices of token lists are bounded in rows and in tokens; buckets are shared numbers in a bounded memo."""
    lists = pa.array([["a"] * n for n in (3, 0, 900, 1200, 1, 1, 1)] + [["b"]] * 1100)
    cut = list(v._slices(lists, rows=512, values=1000))
    assert [start for start, _ in cut] == [0, *np.cumsum([n for _, n in cut])[:-1]]
    assert sum(n for _, n in cut) == len(lists) and max(n for _, n in cut) <= 512
    sizes = pc.list_value_length(lists).to_numpy()
    assert all(n == 1 or sizes[at:at + n].sum() <= 1000 for at, n in cut)
    assert list(v._slices(lists.slice(2, 3), rows=512, values=1000)) == [(0, 1), (1, 1), (2, 1)]
    hasher = v._Hasher(512, 4, True, memo=10)
    for i in range(100):
        got = hasher(f"word{i}")
        assert got == [v.bucket(x, 512) for x in (f"word{i}", *("#" + f"word{i}"[j:j + 4] for j in range(len(f"word{i}") - 3)))]
        assert all(any(x is y for y in hasher.numbers) for x in got)
    assert len(hasher.words) <= 10 and len(hasher.parts) <= 10
