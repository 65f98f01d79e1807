"""Ranking against brute force, with every probe block and grid path."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemo.functions.text import token_set
from mnemo.operators import probe
from mnemo.operators.predicates import Filters, clamp_limit
from mnemo.operators.probe import Scope
from mnemo.operators.ranking import (
    get_by_id, graph_topk, line_search, neighbors, related, search_recent, search_scored, vector_topk,
)

RNG = np.random.default_rng(5)
WORDS = ["alpha", "alphabet", "beta", "gamma", "gam", "delta", "deltas", "eps", "zeta", "core/zeta.py"]


@pytest.fixture(scope="module")
def vectors(spark):
    """A third of the rows are one and the same vector, so ties abound."""
    m = RNG.normal(size=(900, 8)).astype(np.float32)
    m[::3] = m[0]
    rows = [
        (int(i), [float(x) for x in m[i]], ["p", "q", "", None][i % 4], [["A"], ["b", "a"], [], None][i % 4],
         ["approved", None, "rejected", "proposed", "superseded"][i % 5])
        for i in range(900)
    ]
    schema = "memory_id long, embedding array<float>, project string, experts array<string>, status string"
    return spark.createDataFrame(rows, schema), m, rows


@pytest.fixture(scope="module")
def asked(spark):
    m = RNG.normal(size=(30, 8)).astype(np.float32)
    rows = [(i, [float(x) for x in m[i]], ["p", None, "q"][i % 3], [["a"], ["b", "a"], []][i % 3]) for i in range(30)]
    return spark.createDataFrame(rows, "prompt_id int, embedding array<float>, project string, axes array<string>"), m, rows


def brute(asked, vectors, k, floor, scope):
    out = {}
    unit = lambda x: x / np.linalg.norm(x.astype(float), axis=-1, keepdims=True)
    s = unit(asked[1]) @ unit(vectors[1]).T
    for pid, _, project, axes in asked[2]:
        for pool in [""] + (list(axes) if scope.axes else []):
            found = []
            for mid, _, mine, tags, status in vectors[2]:
                ok = status not in ("rejected", "superseded") and s[pid, mid] >= floor
                if project and scope.project:
                    ok &= mine == project or (scope.project == "global" and not mine)
                if pool:
                    ok &= pool in {t.lower() for t in tags or ()}
                if ok:
                    found.append((-round(float(s[pid, mid]), 6), mid))
            for rank, (score, mid) in enumerate(sorted(found)[:k], 1):
                out[(pid, pool, rank)] = (mid, -score)
    return out


@pytest.mark.parametrize("limit", [1000, 10])
@pytest.mark.parametrize("scope", [Scope(), Scope("strict"), Scope("global", True)])
def test_vector_topk_equals_brute_force(asked, vectors, limit, scope, monkeypatch):
    monkeypatch.setattr(probe, "GRID_PROBES", 7)
    monkeypatch.setattr(probe, "GRID_ROWS", 200)
    monkeypatch.setattr(probe, "CELLS", 2000)
    hits = vector_topk(asked[0], vectors[0], 8, 7, 0.1, scope=scope, max_probes=limit).collect()
    got = {(r.prompt_id, r.pool, r.rank): (r.memory_id, r.score) for r in hits}
    want = brute(asked, vectors, 7, 0.1, scope)
    assert {k: x[0] for k, x in got.items()} == {k: x[0] for k, x in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1], abs=1e-6) for k in want)


def test_search_keeps_unscored_rows_last(spark, asked, vectors):
    ident = F.struct(F.lit("x").alias("backend"), F.lit("m").alias("model"), F.lit(8).alias("dim"))
    rows = vectors[0].filter("memory_id < 40").withColumn(
        "embed_identity", F.when(F.col("memory_id") % 2 == 0, ident)
    )
    hits = search_scored(asked[0], rows, 8, Filters(), 200, ident).filter("prompt_id = 3").orderBy("rank").collect()
    scored = [r.score is not None for r in hits]
    assert len(hits) == rows.filter("coalesce(status, 'approved') NOT IN ('rejected', 'superseded')").count()
    assert scored == sorted(scored, reverse=True) and not all(scored)
    tail = [r.memory_id for r in hits if r.score is None]
    assert tail == sorted(tail)


def test_a_blank_prompt_gets_the_newest_rows(spark):
    day = F.when(F.col("memory_id") < 4, F.lit("2026-01-01")).when(F.col("memory_id") < 6, F.lit("2026-01-03"))
    rows = spark.range(8).withColumnRenamed("id", "memory_id").withColumns({
        "ts": day.cast("timestamp"), "text": F.lit("x"), "status": F.lit("approved"), "project": F.lit("p"),
        "embedding": F.array(F.lit(1.0), F.col("memory_id").cast("double")).cast("array<float>")})
    asked = spark.createDataFrame(
        [(1, [0.0, 0.0], "p"), (2, None, "p"), (3, [1.0, 0.0], "p"), (4, [], "q"), (5, [], None)],
        "prompt_id int, embedding array<float>, project string")
    hits = search_scored(asked, rows, 2, limit=7, scope=Scope("strict"), payload=["text"]).orderBy("prompt_id", "rank")
    got = {}
    for r in hits.collect():
        got.setdefault(r.prompt_id, []).append(r.memory_id)
    newest = [r.memory_id for r in search_recent(rows, limit=7).collect()]
    assert newest == [5, 4, 3, 2, 1, 0, 7]
    assert got == {1: newest, 2: newest, 3: [0, 1, 2, 3, 4, 5, 6], 5: newest}
    assert "ts" not in search_scored(asked, rows, 2, payload=["text"]).columns


def test_related_takes_the_oldest_edges(spark):
    edges = spark.createDataFrame(
        [("c", "hub", 1), ("a", "hub", 3), ("b", "hub", 2), ("d", "hub", None)], "edge_id string, src_label string, day int"
    ).withColumns({"dst_label": F.lit("y"), "ingested_at": F.timestamp_seconds("day")})
    probes = spark.createDataFrame([(1, "HUB")], "prompt_id int, entity string")
    hits = related(probes, edges, 4).orderBy("rank")
    assert [r.edge_id for r in hits.collect()] == ["c", "b", "a", "d"] and "ingested_at" not in hits.columns


def test_a_zero_probe_matches_nothing(spark, vectors):
    zero = spark.createDataFrame([(1, [0.0] * 8)], "prompt_id int, embedding array<float>")
    assert vector_topk(zero, vectors[0], 8, 5, None).count() == 0
    none = spark.createDataFrame([], "prompt_id int, embedding array<float>")
    assert vector_topk(none, vectors[0], 8, 5, None).count() == 0


def overlap(probe_tokens, edge_tokens):
    exact = probe_tokens & edge_tokens
    half = [t for t in probe_tokens - exact if len(t) >= 4 and any(t in e for e in edge_tokens)]
    return (len(exact) + 0.5 * len(half)) / len(probe_tokens)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_graph_topk_equals_brute_force(spark):
    rng = random.Random(3)
    prompts = [(i, " ".join(rng.choices(WORDS + ["the"], k=rng.randint(0, 5)))) for i in range(25)]
    # Half of the edges share one relation and one end.
    edges = [(i, "alpha" if i % 2 else rng.choice(WORDS), "uses", rng.choice(WORDS), None, None) for i in range(400)]
    p = spark.createDataFrame(prompts, "prompt_id int, text string")
    e = spark.createDataFrame(edges, "edge_id long, src_label string, rel string, dst_label string, status string, project string")
    found = graph_topk(p, e, 6)
    assert "Python" not in plan(found) and "Arrow" not in plan(found)
    got = {(r.prompt_id, r["rank"]): (r.edge_id, r.score) for r in found.collect()}
    sets = {r.prompt_id: set(r.t) for r in p.select("prompt_id", token_set(F.col("text")).alias("t")).collect()}
    want = {}
    for pid, toks in sets.items():
        if not toks:
            continue
        scored = [(-round(overlap(toks, {s, r, d}), 6), i) for i, s, r, d, _, _ in edges]
        for rank, (score, i) in enumerate(sorted(x for x in scored if x[0] < 0)[:6], 1):
            want[(pid, rank)] = (i, -score)
    assert got == want


def test_related_takes_first_edges_with_literal_substrings(spark):
    edges = spark.createDataFrame(
        [(1, "core/Vector_store.py", "uses", "x", None, "p"), (2, "a%b", "r", "y", "rejected", "p"),
         (3, "y", "r", "vector_store", "approved", None), (4, "c%d", "r", "z", None, "p")],
        "edge_id long, src_label string, rel string, dst_label string, status string, project string")
    probes = spark.createDataFrame([(1, "VECTOR_store"), (2, "%"), (3, "  "), (4, "_")], "prompt_id int, entity string")
    got = [(r.prompt_id, r.edge_id) for r in related(probes, edges, 10).orderBy("prompt_id", "rank").collect()]
    assert got == [(1, 1), (1, 3), (2, 4), (4, 1), (4, 3)]
    assert [r.edge_id for r in related(probes.limit(1), edges, 1).collect()] == [1]
    assert [r.edge_id for r in related(probes.filter("prompt_id = 1"), edges, 10, "p").collect()] == [1]


def test_neighbors_both_ends_any_status(spark):
    edges = spark.createDataFrame(
        [(1, "a", "b", None), (2, "b", "a", "rejected"), (3, "a", "a", None), (4, "c", "d", None), (5, "ab", "c", None)],
        "edge_id long, src_label string, dst_label string, status string")
    labels = spark.createDataFrame([("a",), ("a",)], "label string")
    assert sorted(r.edge_id for r in neighbors(labels, edges).collect()) == [1, 2, 3]


def test_line_search_caps_each_document(spark):
    docs = spark.createDataFrame(
        [(1, "\n".join(["Alpha here"] * 5)), (2, "none"), (3, "x\n  ALPHA " + "y" * 300), (4, None)], "doc_id long, text string")
    words = spark.createDataFrame([(1, "alpha"), (2, "missing"), (3, "")], "prompt_id int, keyword string")
    hits = line_search(words, docs, per_doc=3, k=10).orderBy("prompt_id", "rank").collect()
    assert [(r.prompt_id, r.doc_id, r.line) for r in hits] == [(1, 1, 1), (1, 1, 2), (1, 1, 3), (1, 3, 2)]
    assert len(hits[3].snippet) == 200 and hits[3].snippet.startswith("ALPHA")


def test_pools_and_projects_of_edges_equal_brute_force(spark):
    rng = random.Random(4)
    edges = [
        (i, rng.choice(WORDS), "uses", rng.choice(WORDS), rng.choice(["p", "q", "", None]), rng.choice([["A"], ["b", "a"], [], None]))
        for i in range(200)
    ]
    asked = [(i, " ".join(rng.choices(WORDS, k=3)), rng.choice(["p", None, "q"]), rng.choice([["a"], ["B", "a"], []])) for i in range(12)]
    e = spark.createDataFrame(edges, "edge_id long, src_label string, rel string, dst_label string, project string, experts array<string>")
    p = spark.createDataFrame(asked, "prompt_id int, text string, project string, axes array<string>")
    sets = {r.prompt_id: set(r.t) for r in p.select("prompt_id", token_set(F.col("text")).alias("t")).collect()}
    for scope in (Scope("strict", True), Scope("global", True), Scope("strict")):
        got = {(r.prompt_id, r.pool, r["rank"]): (r.edge_id, r.score, r.rel) for r in graph_topk(p, e, 4, scope=scope, payload=["rel"]).collect()}
        want = {}
        for i, _, project, axes in asked:
            for pool in ["", *(axes if scope.axes else [])]:
                found = []
                for n, s, r, d, mine, tags in edges:
                    ok = not project or mine == project or (scope.project == "global" and not mine)
                    ok = ok and (not pool or pool.lower() in {t.lower() for t in tags or ()})
                    score = round(overlap(sets[i], {s, r, d}), 6)
                    found += [(-score, n)] if ok and score else []
                for rank, (score, n) in enumerate(sorted(found)[:4], 1):
                    want[i, pool, rank] = (n, -score, "uses")
        assert got == want


def test_lines_equal_brute_force_for_needles_of_any_length(spark):
    rng = random.Random(6)
    bits = ["a", "Ab", "é", " ", "ß", "the ", "x1", "\t", "𝒳", "."]
    texts = [(i, "\n".join("".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(6))) for i in range(60)]
    needles = [(i, "".join(rng.choices(bits, k=rng.randint(0, 4)))) for i in range(40)] + [(90, None), (91, "the "), (92, "a")]
    docs = spark.createDataFrame([*texts, (98, None), (99, "")], "doc_id long, text string")
    words = spark.createDataFrame(needles, "prompt_id int, keyword string")
    for per_doc, k in ((20, 12), (2, 12)):
        found = line_search(words, docs, per_doc, k)
        assert "Python" not in plan(found) and "Arrow" not in plan(found)
        want = set()
        for p, w in needles:
            w = (w or "").strip().lower()
            hits = [(d, n + 1) for d, t in texts for n, x in enumerate(t.split("\n")) if w and w in x.lower()]
            kept = [h for i, h in enumerate(hits) if sum(x[0] == h[0] for x in hits[:i]) < per_doc]
            want |= {(p, d, n, i) for i, (d, n) in enumerate(kept[:k], 1)}
        assert {(r.prompt_id, r.doc_id, r.line, r["rank"]) for r in found.collect()} == want


def test_recent_search_and_lookup(spark):
    rows = [(1, "2026-01-01", None, "a"), (2, "2026-01-03", "approved", "b"), (3, None, "proposed", "c"),
            (4, "2026-01-03", "superseded", "d"), (5, "2026-01-03", "approved", "e")]
    k = spark.createDataFrame(rows, "memory_id long, d string, status string, text string").withColumn(
        "ts", F.col("d").cast("timestamp")).withColumn("type", F.lit("decision"))
    assert [r.memory_id for r in search_recent(k).collect()] == [5, 2, 1, 3]
    assert [r.memory_id for r in search_recent(k, Filters(date_to="2026-01-02")).collect()] == [1, 3]
    assert [r.memory_id for r in search_recent(k, Filters(date_from="2026-01-02")).collect()] == [5, 2]
    assert [r.memory_id for r in search_recent(k, Filters(status="superseded")).collect()] == [4]
    ids = spark.createDataFrame([(4,), (4,), (9,)], "memory_id long")
    assert [r.memory_id for r in get_by_id(k, ids, "decision").collect()] == [4]
    assert get_by_id(k, ids, "task").count() == 0
    assert [clamp_limit(x) for x in (None, 0, 7, 999)] == [20, 1, 7, 200]


def test_edges_are_made_once(spark):
    """Labels may come of long texts: ranking, its token table and the payload read one copy of them."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def label(x):
        made.add(1)
        return f"topic{x}"

    edges = spark.range(12).select(
        F.col("id").alias("edge_id"), label.asNondeterministic()("id").alias("src_label"),
        F.lit("rel").alias("rel"), F.lit("target").alias("dst_label"),
    )
    asked = spark.createDataFrame([(1, "topic3 target"), (2, "topic7")], "prompt_id int, text string")
    got = graph_topk(asked, edges, 2, payload=["src_label", "dst_label"]).collect()
    assert {(r.prompt_id, r["rank"], r.src_label) for r in got} == {(1, 1, "topic3"), (1, 2, "topic0"), (2, 1, "topic7")}
    assert made.value == 12


def test_rows_are_scored_in_bounded_slices():
    import pyarrow as pa

    sizes = []

    def score(n, rows):
        sizes.append(rows.num_rows)
        return rows, np.arange(rows.num_rows)[None, :] * np.ones((n, 1))

    kernel = probe.Kernel(lambda probes: probes.num_rows, score)
    block = probe._Block(pa.table({"prompt_id": [1, 2]}), kernel, Scope(), 3, ["id"], ["id"])
    block.add(pa.table({"id": np.arange(5000)}))
    assert max(sizes) <= probe.SLICE and sum(sizes) == 5000
    best = block.kept.filter(pa.array(block.kept["_probe"].to_numpy() == 0))["id"].to_pylist()
    assert best == [2047, 4095, 2046]
