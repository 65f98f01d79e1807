"""Searches and context requests that come as rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemo.catalog.base import load, load_text, query, sql_tokens
from mnemo.catalog.frames import MEMORIES_SQL, memories, sql_cosine, sql_hashed
from mnemo.functions.vectors import HashedEmbedder, embed
from mnemo.plans.searches import parse_contexts, parse_searches, search, split_requests

_BAD = ["no json", "[1]", '{"query":5}', '{"filters":{"status":"odd"}}', '{"filters":{"limit":"9"}}', '{"filters":{"experts":{"a":1}}}']


def _search_lines(spark, sf):
    """Each benchmark passage asks with filters of its own; beside it stands a broken request."""
    b = load(spark, sf, "benchmark")
    n = F.col("item_id")

    def some(every, at, value):
        return F.when(n % every == at, value)

    kinds = F.array(*[F.lit(k) for k in ("decision", "task", "knowledge", "experience")])
    filters = F.struct(
        some(3, 0, F.concat(F.lit("src"), n % 20)).alias("project"),
        some(2, 0, F.get(kinds, (n / 2).cast("int") % 4)).alias("memory_type"),
        some(5, 1, F.lit("proposed")).alias("status"), some(5, 2, F.lit(True)).alias("approved_only"),
        some(7, 3, F.lit("GOOD")).alias("experts"), some(6, 5, F.lit(0.9)).alias("confidence"),
        some(4, 1, F.struct(F.lit("2024-01-01T02:00:00Z").alias("from"))).alias("date_range"),
        some(4, 3, F.lit("2024-01-01T08:00:00Z")).alias("date_to"), some(11, 4, F.lit("The ")).alias("entity"),
    )
    asked = F.to_json(F.struct(some(4, 0, F.col("text")).alias("query"), filters.alias("filters"), some(3, 1, n * 10).alias("limit")))
    bad = F.get(F.array(*[F.lit(x) for x in _BAD]), n.cast("int") % len(_BAD))
    return b.select(n.alias("request_id"), asked.alias("value")).unionByName(
        b.select((-1 - n).alias("request_id"), bad.alias("value"))
    )


_ASKED_SQL = """
asked AS (SELECT item_id, text, CASE WHEN item_id % 3 = 0 THEN 'src' || item_id % 20 END AS project,
  CASE WHEN item_id % 2 = 0 THEN ['decision', 'task', 'knowledge', 'experience'][item_id // 2 % 4 + 1] END AS type,
  CASE WHEN item_id % 5 = 1 THEN 'proposed' WHEN item_id % 5 = 2 THEN 'approved' END AS status,
  CASE WHEN item_id % 3 = 1 THEN greatest(1, least(200, item_id * 10)) ELSE 20 END AS most FROM benchmark)"""


@query("search_requests", f"""
WITH {MEMORIES_SQL}, {_ASKED_SQL},
queries AS (SELECT item_id, text FROM asked WHERE item_id % 4 = 0),
{sql_hashed('pv', 'queries', 'item_id', 'text')}, {sql_hashed('kv', 'memories', 'memory_id', 'text')},
{sql_cosine('pairs', 'pv', 'item_id', 'kv', 'memory_id')},
met AS (SELECT a.item_id, m.memory_id, m.ts, a.most, a.item_id % 4 = 0 AND len({sql_tokens('a.text')}) > 0 AS scored
  FROM asked a JOIN memories m ON (a.project IS NULL OR m.project = a.project) AND (a.type IS NULL OR m.type = a.type)
    AND CASE WHEN a.status IS NULL THEN coalesce(m.status, 'approved') NOT IN ('superseded', 'rejected')
      ELSE coalesce(m.status, 'approved') = a.status END
    AND (a.item_id % 7 <> 3 OR list_contains(m.experts, 'Good'))
    AND (a.item_id % 6 <> 5 OR coalesce(m.confidence, 1.0) >= 0.9)
    AND (a.item_id % 4 <> 1 OR m.ts >= TIMESTAMP '2024-01-01 02:00:00')
    AND (a.item_id % 4 <> 3 OR m.ts IS NULL OR m.ts <= TIMESTAMP '2024-01-01 08:00:00')
    AND (a.item_id % 11 <> 4 OR contains(lower(m.text), 'the '))),
every AS (SELECT *, CASE WHEN scored THEN round(coalesce(raw_score, 0), 6) END AS score
  FROM met LEFT JOIN pairs USING (item_id, memory_id))
SELECT item_id AS request_id, memory_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC NULLS LAST,
  CASE WHEN NOT scored THEN ts END DESC NULLS LAST, CASE WHEN NOT scored THEN memory_id END DESC, memory_id) AS rank
FROM every QUALIFY rank <= most""")
def search_rows(spark, sf):
    asked, _ = split_requests(parse_searches(_search_lines(spark, sf)))
    model = HashedEmbedder()
    asked = embed(asked.withColumn("query", F.coalesce("query", F.lit(""))), "query", model)
    hits = search(asked, embed(memories(spark, sf), "text", model))
    return hits.select("request_id", "memory_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("request_rejects", f"""
SELECT 'search' AS kind, -1 - item_id AS request_id, ['not_json', 'not_an_object', 'not_a_string', 'unknown_status',
  'not_an_integer', 'not_an_array'][item_id % 6 + 1] AS error_code,
  [NULL, NULL, 'query', 'filters.status', 'limit', 'filters.experts'][item_id % 6 + 1] AS error_field FROM benchmark
UNION ALL SELECT 'context', doc_id, CASE WHEN coalesce(text, '') = '' THEN 'required' WHEN length(text) > 32000 THEN 'too_long'
    WHEN n_chars <= 0 THEN 'not_positive' ELSE 'too_large' END,
  CASE WHEN coalesce(text, '') = '' OR length(text) > 32000 THEN 'prompt' ELSE 'token_budget' END
FROM documents WHERE coalesce(text, '') = '' OR length(text) > 32000 OR n_chars <= 0 OR n_chars > 8192""")
def rejects(spark, sf):
    """Documents ask for a context of their own length, so long ones ask for too much."""
    d = load_text(spark, sf, "documents")
    value = F.to_json(F.struct(F.col("text").alias("prompt"), F.col("n_chars").alias("token_budget")))
    contexts = d.select(F.col("doc_id").alias("line"), value.alias("value"))
    searches = _search_lines(spark, sf).withColumnRenamed("request_id", "line")
    told = [
        split_requests(parsed)[1].select(F.lit(kind).alias("kind"), F.col("line").alias("request_id"), "error_code", "error_field")
        for kind, parsed in (("search", parse_searches(searches)), ("context", parse_contexts(contexts)))
    ]
    return told[0].unionByName(told[1])
