from datetime import datetime

from pyspark.sql import functions as F

from mnemo.config import DEFAULT_RULES, AgentRoute, Identity
from mnemo.functions import scalars as s

C = F.col("c")


def test_times_in_any_form(column):
    values = ["1785542400", "1785542400.5", "2026-08-01T00:00:00Z", "2026-08-01T00:00:00", "2026-08-01",
              "2026-08-01T08:00:00+08:00", "yesterday", "", None]
    got = column(s.to_ts(C), values)
    t0 = datetime(2026, 8, 1)
    assert got == [t0, t0.replace(microsecond=500_000), t0, t0, t0, t0, None, None, None]
    assert column(s.bad_ts(C), values) == [False] * 6 + [True, False, False]
    assert column(s.to_iso(s.to_ts(C)), ["1785542400.9"]) == ["2026-08-01T00:00:00Z"]


def test_backoff_doubles_to_the_cap(column):
    assert column(s.backoff_seconds(C), [-1, 0, 1, 2, 3, 8, 9, 50], "int") == [0, 0, 2, 4, 8, 256, 300, 300]


def test_bad_json_reads_as_empty(column):
    assert column(s.json_strings(C), ['["a","b"]', '{"a":1}', "[", None]) == [["a", "b"], [], [], []]
    assert column(s.json_doubles(C), ['{"a":1.5}', "[1]", "{", None]) == [{"a": 1.5}, {}, {}, {}]


def test_budgets(column):
    assert column(s.budget_chars(C), [None, 10, 9000, -5], "int") == [2200, 40, 2200, 0]
    assert column(s.digest_chars(C), [None, 10, 9000], "int") == [4775, 40, 2200]


def test_project_comes_from_hints_only(spark):
    rows = [("a/b/proj", "/w"), ("", "/w/side"), (None, None), ("x/", "/w"), (" spaced ", None)]
    df = spark.createDataFrame(rows, "h string, w string").coalesce(1)
    got = [r.p for r in df.select(s.resolve_project(F.col("h"), F.col("w")).alias("p")).collect()]
    assert got == ["proj", "side", None, None, "spaced"]
    from dataclasses import replace
    rules = DEFAULT_RULES.with_(identity=replace(DEFAULT_RULES.identity, default_project="home"))
    got = [r.p for r in df.select(s.resolve_project(F.col("h"), F.col("w"), rules).alias("p")).collect()]
    assert got == ["proj", "side", "home", None, "spaced"]


def test_agent_with_most_hits(column):
    routes = (AgentRoute("smith", ("forge", "anvil", "iron")), AgentRoute("cook", ("iron", "stew", "Plate")))
    rules = DEFAULT_RULES.with_(identity=Identity(default_agent="host", agent_routes=routes))
    texts = ["the anvil and the forge", "stew on a plate", "hello", "iron", "iron stew", None]
    assert column(s.recommend_agent(C, rules), texts) == ["smith", "cook", "host", "smith", "cook", "host"]
    assert column(s.recommend_agent(C), ["iron", None]) == ["generalist"] * 2


def test_round6_matches_exact_rounding(column):
    import random

    rng = random.Random(7)
    values = [rng.randrange(1_000_000) / 1e6 * f for f in (0.9, 1.5, 1.75, 1.2) for _ in range(3000)]
    values += [0.0, 1.0, 0.0078125, 0.0234375, 1e-9, 2.0]
    assert column(s.round6(C), values, "double") == [round(v, 6) for v in values]
