"""Searches and context requests as rows: first broken rule, and answers against brute force."""

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from mnemo.config import DEFAULT_RULES
from mnemo.plans.searches import parse_contexts, parse_searches, search, split_requests

T0 = datetime(2026, 1, 1)


def lines(spark, *bodies):
    rows = [(i, b if isinstance(b, str) or b is None else json.dumps(b)) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "request_id int, value string")


def errors(parsed, order):
    return [(r.error_code, r.error_field) for r in parsed.orderBy(order).collect()]


def test_searches_report_the_first_broken_rule(spark):
    bad = [
        "no json", None, "[1]", {"query": 5}, {"query": "x" * 32001}, {"filters": "a"}, {"filters": [1]}, {"filters": {"status": "odd"}},
        {"filters": {"status": ""}}, {"limit": "9"}, {"limit": True}, {"filters": {"limit": None}}, {"limit": 1.5},
        {"filters": {"date_range": "today"}}, {"filters": {"experts": {"a": 1}}}, {"query": 5, "limit": "x"},
    ]
    parsed = parse_searches(lines(spark, *bad))
    assert errors(parsed, "request_id") == [
        ("not_json", None), ("not_json", None), ("not_an_object", None), ("not_a_string", "query"), ("too_long", "query"),
        ("not_an_object", "filters"), ("not_an_object", "filters"), ("unknown_status", "filters.status"),
        ("unknown_status", "filters.status"), ("not_an_integer", "limit"), ("not_an_integer", "limit"), ("not_an_integer", "limit"),
        ("not_an_integer", "limit"), ("not_an_object", "filters.date_range"), ("not_an_array", "filters.experts"), ("not_a_string", "query")]
    good, rejects = split_requests(parsed)
    assert good.count() == 0 and rejects.count() == len(bad) and "value" in rejects.columns


def test_good_searches_are_rows(spark):
    asked = [
        {}, {"filters": None, "query": ""}, {"filters": {}, "limit": 0}, {"limit": 999},
        {"filters": {"limit": 7, "experts": "CTO", "project": "p", "confidence": 0, "approved_only": "false"}, "limit": 3},
        {"query": "q", "filters": {"experts": ["a", "B"], "date_range": {"from": "2026-01-01"}, "date_to": "2026-02-01T00:00:00Z", "status": "approved"}},
    ]
    rows = parse_searches(lines(spark, *asked)).orderBy("request_id").collect()
    assert all(r.error_code is None for r in rows)
    assert [r.limit for r in rows] == [20, 20, 1, 200, 7, 20]
    assert rows[0].query is None and rows[1].query is None and not rows[1].approved_only
    assert (rows[4].experts, rows[4].project, rows[4].min_confidence, rows[4].approved_only) == (["CTO"], "p", 0.0, True)
    assert (rows[5].query, rows[5].experts, rows[5].status) == ("q", ["a", "B"], "approved")
    assert rows[5].date_from == T0 and rows[5].date_to == datetime(2026, 2, 1)


def test_context_requests(spark):
    bad = [
        {"request_id": "x"}, {"prompt": ""}, {"prompt": "x" * 32001}, {"prompt": 1}, {"prompt": "p", "token_budget": "lots"},
        {"prompt": "p", "token_budget": True}, {"prompt": "p", "token_budget": 0}, {"prompt": "p", "token_budget": 8193},
        {"prompt": "p", "permissions": [1]}, {"prompt": "p", "actor": "x" * 201}, {"prompt": "p", "session_id": 4},
    ]
    given = lines(spark, *bad).withColumnRenamed("request_id", "line")
    assert errors(parse_contexts(given), "line") == [
        ("required", "prompt"), ("required", "prompt"), ("too_long", "prompt"), ("not_a_string", "prompt"), ("not_an_integer", "token_budget"),
        ("not_an_integer", "token_budget"), ("not_positive", "token_budget"), ("too_large", "token_budget"), ("not_an_object", "permissions"),
        ("too_long", "actor"), ("not_a_string", "session_id")]
    fine = lines(spark, {"prompt": "p", "token_budget": 8192, "permissions": {}, "actor": None}, {"prompt": "q", "permissions": 0})
    rows = parse_contexts(fine.withColumnRenamed("request_id", "line")).orderBy("line").collect()
    assert [(r.prompt, r.token_budget, r.error_code) for r in rows] == [("p", 8192, None), ("q", None, None)]
    small = parse_contexts(fine.withColumnRenamed("request_id", "line"), DEFAULT_RULES.with_(max_token_budget=10))
    assert errors(small, "line")[0] == ("too_large", "token_budget")


MEMORIES = (
    "memory_id int, text string, type string, status string, project string, source string, source_type string, confidence double, "
    "ts timestamp, experts array<string>, embedding array<float>"
)
ASKED = (
    "request_id int, project string, memory_type string, source string, source_type string, status string, approved_only boolean, "
    "experts array<string>, min_confidence double, date_from timestamp, date_to timestamp, entity string, limit int, embedding array<float>"
)


def fits(q, m):
    status = m["status"] or "approved"
    wanted = q["status"] or ("approved" if q["approved_only"] else None)
    return (
        all(not q[a] or m[b] == q[a] for a, b in (("project", "project"), ("memory_type", "type"), ("source", "source"), ("source_type", "source_type")))
        and (status == wanted if wanted else status not in ("superseded", "rejected"))
        and (not q["experts"] or bool({x.lower() for x in m["experts"] or ()} & {x.lower() for x in q["experts"]}))
        and (q["min_confidence"] is None or (1.0 if m["confidence"] is None else m["confidence"]) >= q["min_confidence"])
        and (q["date_from"] is None or (m["ts"] is not None and m["ts"] >= q["date_from"]))
        and (q["date_to"] is None or m["ts"] is None or m["ts"] <= q["date_to"])
        and (not q["entity"] or q["entity"].lower() in m["text"].lower())
    )


def test_answers_equal_brute_force(spark):
    rng = random.Random(12)
    some = lambda *values: rng.choice(values)
    memories = [
        dict(memory_id=i, text=some("Alpha one", "beta Two", "100% sure"), type=some("decision", "task"),
             status=some(None, "approved", "proposed", "rejected"), project=some("p", "q", None), source=some("s", "t"),
             source_type=some(None, "event"), confidence=some(None, 0.2, 0.9), ts=some(None, *[T0 + timedelta(hours=h) for h in range(4)]),
             experts=some(None, [], ["A"], ["b", "C"]), embedding=[float(rng.randint(-2, 2)), float(rng.randint(-2, 2))])
        for i in range(150)
    ]
    asked = [
        dict(request_id=i, project=some(None, None, "p", "zz"), memory_type=some(None, "task"), source=some(None, None, "s"),
             source_type=some(None, None, "event"), status=some(None, None, "proposed", "rejected"), approved_only=some(False, True),
             experts=some(None, None, ["a"], ["B", "x"]), min_confidence=some(None, 0.5), date_from=some(None, None, T0 + timedelta(hours=1)),
             date_to=some(None, None, T0 + timedelta(hours=2)), entity=some(None, None, "ALPHA", "%"), limit=some(1, 5, 200),
             embedding=some(None, [], [0.0, 0.0], [1.0, 0.5]))
        for i in range(60)
    ]
    # Some ask for the very same, with another limit.
    asked += [{**asked[i], "request_id": 100 + i, "limit": 3} for i in range(20)]
    table = spark.createDataFrame([tuple(m.values()) for m in memories], MEMORIES)
    requests = spark.createDataFrame([tuple(q.values()) for q in asked], ASKED)
    got = {}
    for r in search(requests, table, payload=("text",)).orderBy("request_id", "rank").collect():
        got.setdefault(r.request_id, []).append((r.memory_id, r.score, r.text))

    def cosine(a, b):
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return round(sum(x * y for x, y in zip(a, b)) / n, 6) if n else 0.0

    for q in asked:
        met = [m for m in memories if fits(q, m)]
        if any(q["embedding"] or ()):
            best = sorted((-cosine(q["embedding"], m["embedding"]), m["memory_id"], m["text"]) for m in met)
            want = [(i, -s, t) for s, i, t in best]
        else:
            order = sorted(met, key=lambda m: (m["ts"] or datetime(1, 1, 1), m["memory_id"]), reverse=True)
            want = [(m["memory_id"], None, m["text"]) for m in order]
        found = [(i, None if s is None else s + 0.0, t) for i, s, t in got.get(q["request_id"], [])]
        assert found == [(i, None if s is None else s + 0.0, t) for i, s, t in want[:q["limit"]]], q
    assert search(requests.limit(0), table).count() == 0 and search(requests, table.limit(0)).count() == 0


def test_rows_of_another_space_come_last_without_a_score(spark):
    here = F.struct(F.lit("x").alias("backend"), F.lit("m").alias("model"), F.lit(2).alias("dim"))
    rows = [(i, "t", "task", None, "p", "s", None, None, T0, None, [1.0, float(i)]) for i in range(6)]
    table = spark.createDataFrame(rows, MEMORIES).withColumn("embed_identity", F.when(F.col("memory_id") % 2 == 0, here))
    asked = spark.createDataFrame([(1, *[None] * 5, False, *[None] * 5, 20, [1.0, 0.0])], ASKED)
    got = search(asked, table, here).orderBy("rank").collect()
    assert [r.memory_id for r in got] == [0, 2, 4, 1, 3, 5] and [r.score is None for r in got] == [False] * 3 + [True] * 3
