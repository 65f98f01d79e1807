import random
from datetime import datetime

from pyspark.sql import functions as F

from mnemo.schema import prefix
from mnemo.operators.upsert import (
    concept_nodes, edge_view, pruned, resolve, upsert_edges, upsert_knowledge, upsert_nodes, with_current_status,
)

EDGE = "ord int, src string, rel string, dst string, project string"


def test_first_write_wins_and_every_refusal_is_reported(spark):
    new = spark.createDataFrame(
        [(3, " same text ", "a", None), (1, "same text", "a", "proposed"), (2, "same text", "b", ""), (4, "  ", "a", None),
         (5, "known", "a", None), (6, "known", "a", None), (7, "no source", None, None)],
        "ord int, text string, source string, status string")
    old, _ = upsert_knowledge(spark.createDataFrame([(1, "known", "a")], "ord int, text string, source string"))
    inserted, skipped = upsert_knowledge(new, old)
    got = {r.ord: r for r in inserted.collect()}
    assert sorted(got) == [1, 2, 7]
    assert (got[1].status, got[2].status) == ("proposed", "approved")
    assert (got[2].source_type, got[2].source_id, got[2].type) == ("conversation", "b", "knowledge")
    assert got[2].ts is not None and got[7].source_id is None
    refused = {r.ord: (r.text, r.verdict, r.reason) for r in skipped.collect()}
    assert refused == {3: ("same text", "repeated", "duplicate_fingerprint"),
                       5: ("known", "stored", "duplicate_fingerprint"), 6: ("known", "stored", "duplicate_fingerprint")}
    assert upsert_knowledge(new, old.unionByName(inserted, allowMissingColumns=True))[0].count() == 0


def test_long_duplicates_are_cut_in_the_report(spark):
    new = spark.createDataFrame([(1, "x" * 500, "a"), (2, "x" * 500, "a")], "ord int, text string, source string")
    assert [len(r.text) for r in upsert_knowledge(new)[1].collect()] == [120]


def test_bad_confidence_becomes_null(spark):
    new = spark.createDataFrame([(1, "a b", "0.5"), (2, "c d", "high")], "ord int, text string, confidence string")
    assert [r.confidence for r in upsert_knowledge(new)[0].orderBy("ord").collect()] == [0.5, None]


def test_verdicts_equal_brute_force_on_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if i % 3 == 0 else f"k{rng.randrange(60)}") for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "ord int, k string").withColumn("v", F.col("ord") * 10)
    held = spark.createDataFrame([("k1", -1), ("k2", -2), ("zz", -3)], "k string, v int")
    got = {r.ord: (r.verdict, r._winner) for r in resolve(df, held, ["k"], ["ord"], carry="v").collect()}
    first = {}
    for i, k in sorted(rows):
        first.setdefault(k, i)
    stored = {"k1": -1, "k2": -2}
    for i, k in rows:
        want = ("stored", stored[k]) if k in stored else ("inserted" if first[k] == i else "repeated", first[k] * 10)
        assert got[i] == want


def test_edges_keep_the_first_project_and_refuse_blanks(spark):
    triples = spark.createDataFrame(
        [(1, " a ", "uses", "b", "p"), (2, "a", "uses", "b", "q"), (3, "", "uses", "b", None), (4, "a", " ", "b", None),
         (5, "c", "uses", None, "r")], EDGE)
    edges = upsert_edges(triples).collect()
    assert [(e.src_label, e.rel, e.dst_label, e.project, e.status) for e in edges] == [("a", "uses", "b", "p", "approved")]
    assert upsert_edges(triples, upsert_edges(triples)).count() == 0
    assert upsert_edges(triples, project_in_key=True).count() == 2
    nodes = {(n.label, n.project) for n in upsert_nodes(triples).collect()}
    # A blank end still leaves the other end a node; a blank relation leaves none.
    assert nodes == {("a", "p"), ("b", "p"), ("c", "r")}
    view = edge_view(upsert_edges(triples), upsert_nodes(triples)).collect()
    assert [(r.src_label, r.dst_label) for r in view] == [("a", "b")]


def test_key_parts_do_not_run_together(spark):
    triples = spark.createDataFrame([(1, "ab", "c", "d", None), (2, "a", "bc", "d", None)], EDGE)
    assert upsert_edges(triples).count() == 2


def test_concepts_for_segments_without_triples(spark):
    rows = spark.createDataFrame(
        [(1, "Every folder holds modules"), (2, "folder again, every time"), (3, "a.b c.d " + "e1 " * 30)],
        "ord int, text string").withColumn("relations", F.array())
    nodes = sorted((n.label, n.kind) for n in concept_nodes(rows).collect())
    assert nodes == [(("a.b c.d " + "e1 " * 30)[:60].strip(), "concept"), ("every", "concept"), ("folder", "concept")]


def test_status_is_the_last_one_logged(spark):
    k = spark.createDataFrame([("a", "proposed"), ("b", "approved")], "memory_id string, status string")
    log = spark.createDataFrame(
        [("a", "approved", datetime(2026, 1, 1)), ("a", "superseded", datetime(2026, 1, 2)), ("c", "rejected", datetime(2026, 1, 1))],
        "memory_id string, status string, at timestamp")
    got = {r.memory_id: r.status for r in with_current_status(k, log).collect()}
    assert got == {"a": "superseded", "b": "approved"}


def test_a_table_stored_by_key_prefix_is_read_where_the_batch_falls(spark, tmp_path):
    path = str(tmp_path / "knowledge")
    old, _ = upsert_knowledge(spark.range(2000).select(
        F.col("id").alias("ord"), F.concat(F.lit("text "), "id").alias("text"), F.lit("a").alias("source")))
    old.withColumn("prefix", prefix(F.col("memory_id"))).repartition("prefix").write.partitionBy("prefix").parquet(path)
    table = spark.read.parquet(path)
    new = spark.createDataFrame([(1, "text 7", "a"), (2, "text new", "a"), (3, "text new", "a")], "ord long, text string, source string")
    inserted, skipped = upsert_knowledge(new, table)
    assert [r.text for r in inserted.collect()] == ["text new"]
    assert sorted((r.ord, r.verdict) for r in skipped.collect()) == [(1, "stored"), (3, "repeated")]
    held = pruned(table, inserted.select("memory_id"), "memory_id")
    assert held.select(F.input_file_name()).distinct().count() == 1
    assert "PartitionFilters: [isnotnull(prefix" in held._jdf.queryExecution().executedPlan().toString()
    # The stored table is scanned for its keys alone and never shuffled.
    scans = [x for x in inserted._jdf.queryExecution().executedPlan().toString().split("\n") if "prefix" in x and "Scan parquet" in x]
    assert scans and all("ReadSchema: struct<memory_id:string>" in x for x in scans)


def test_refused_rows_move_without_their_text(spark):
    new = spark.createDataFrame([(i, "x" * 5000 + str(i % 3), "a") for i in range(50)], "ord long, text string, source string")
    _, skipped = upsert_knowledge(new)
    assert skipped.count() == 47 and all(len(r.text) == 120 for r in skipped.collect())
