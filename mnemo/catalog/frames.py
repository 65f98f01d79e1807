"""Memory tables read off the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mnemo.catalog.base import (
    DATA_RULES, load, load_text, sql_active, sql_axis_columns, sql_primary_keyword, sql_tokens,
    sql_topic,
)
from mnemo.functions import text as t
from mnemo.functions.vectors import HashedEmbedder, embed

# -- memories: documents with their labels ---------------------------------------------------
MEMORIES_SQL = """
memories AS (SELECT d.doc_id AS memory_id, d.text, d.source,
  CASE d.lang WHEN 'es' THEN NULL ELSE d.source END AS project,
  CASE d.lang WHEN 'en' THEN 'decision' WHEN 'fr' THEN 'task' WHEN 'de' THEN 'knowledge'
    ELSE 'experience' END AS type,
  CASE WHEN l.toxic = 1 THEN 'rejected' WHEN d.n_chars > 5000 THEN 'superseded'
    WHEN l.quality = 0 THEN 'proposed' WHEN l.quality = 1 THEN 'approved' END AS status,
  CASE WHEN d.n_chars > 1500 THEN 'agent_event' END AS source_type,
  CASE WHEN d.n_chars >= 200 THEN TIMESTAMP '2024-01-01' + to_minutes(d.doc_id) END AS ts,
  (l.quality + 1) / 2.0 AS confidence,
  CASE WHEN l.quality IS NULL THEN NULL WHEN l.quality = 1 THEN [d.lang, 'Good'] ELSE [d.lang] END AS experts
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def memories(spark, sf) -> DataFrame:
    d, labels = load_text(spark, sf, "documents"), load(spark, sf, "labels")
    lang, quality = F.col("lang"), F.col("quality")
    start = F.lit("2024-01-01T00:00:00Z").cast("timestamp")
    return d.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("memory_id"), "text", "source",
        F.when(lang != "es", F.col("source")).alias("project"),
        F.when(lang == "en", "decision").when(lang == "fr", "task").when(lang == "de", "knowledge")
        .otherwise("experience").alias("type"),
        F.when(F.col("toxic") == 1, "rejected").when(F.col("n_chars") > 5000, "superseded")
        .when(quality == 0, "proposed").when(quality == 1, "approved").alias("status"),
        F.when(F.col("n_chars") > 1500, "agent_event").alias("source_type"),
        F.when(F.col("n_chars") >= 200, start + F.make_dt_interval(mins=F.col("doc_id").cast("int")))
        .alias("ts"),
        ((quality + 1) / 2.0).alias("confidence"),
        F.when(quality == 1, F.array(lang, F.lit("Good"))).when(quality.isNotNull(), F.array(lang))
        .alias("experts"),
    )


# -- hashed vectors in SQL ---------------------------------------------------------------------
def sql_hashed(name: str, table: str, key: str, text: str, dim: int = 512) -> str:
    """CTEs ending in ``name`` (key, bucket, w) and ``name_norm`` (key, sq)."""
    bucket = f"CAST(('0x' || substr(md5({{}}), 1, 15))::UBIGINT % {dim} AS INT)"
    return f"""
{name}_tok AS MATERIALIZED (SELECT {key}, tok, count(*) AS n FROM (
  SELECT {key}, unnest({sql_tokens(text)}) AS tok FROM {table}) GROUP BY ALL),
{name}_gram AS (SELECT {key}, g, sum(n) AS n FROM (
  SELECT {key}, substring(tok, i, 4) AS g, n FROM {name}_tok, unnest(range(1, length(tok) - 2)) AS u(i)
  WHERE length(tok) > 4) GROUP BY ALL),
{name}_sum AS (SELECT {key}, bucket, sum(words)::DOUBLE + 0.35::DOUBLE * sum(grams)::DOUBLE AS total FROM (
  SELECT {key}, {bucket.format('tok')} AS bucket, n AS words, 0 AS grams FROM {name}_tok
  UNION ALL SELECT {key}, {bucket.format("'#' || g")}, 0, n FROM {name}_gram) GROUP BY ALL),
{name}_len AS (SELECT {key}, sqrt(sum(pow(1 + ln(total), 2))) AS len FROM {name}_sum GROUP BY ALL),
{name} AS MATERIALIZED (SELECT s.{key}, bucket, ((1 + ln(total)) / len)::FLOAT::DOUBLE AS w
  FROM {name}_sum s JOIN {name}_len USING ({key})),
{name}_norm AS (SELECT {key}, sum(w * w) AS sq FROM {name} GROUP BY ALL)"""


def sql_cosine(name: str, left: str, left_key: str, right: str, right_key: str) -> str:
    return f"""
{name} AS MATERIALIZED (SELECT {left_key}, {right_key}, dot / sqrt(a.sq * b.sq) AS raw_score FROM (
  SELECT p.{left_key}, k.{right_key}, sum(p.w * k.w) AS dot
  FROM {left} p JOIN {right} k USING (bucket) GROUP BY ALL)
  JOIN {left}_norm a USING ({left_key}) JOIN {right}_norm b USING ({right_key}))"""


# -- retrieval: prompts, tagged documents, edges ---------------------------------------------------
_AX = sql_axis_columns("text", DATA_RULES)
_AX_COLUMNS = ", ".join(f"{e} AS ax_{a}" for a, e in _AX.items())

RETRIEVAL_SQL = f"""
prompts AS (SELECT item_id AS prompt_id, text,
  CASE WHEN length(text) > 200 THEN 'src3' END AS project, {_AX_COLUMNS} FROM benchmark),
routed AS (SELECT *, {sql_active(DATA_RULES)} AS axes FROM prompts),
tagged AS (SELECT doc_id AS memory_id, text, CASE lang WHEN 'es' THEN NULL ELSE source END AS project,
  {sql_topic('text')} AS src, lang AS rel, {sql_primary_keyword('text')} AS dst, {_AX_COLUMNS} FROM documents),
docs AS MATERIALIZED (SELECT *, {sql_active(DATA_RULES)} AS experts FROM tagged),
{sql_hashed('pv', 'prompts', 'prompt_id', 'text')},
{sql_hashed('dv', 'docs', 'memory_id', 'text')},
{sql_cosine('pairs', 'pv', 'prompt_id', 'dv', 'memory_id')},
seen AS (SELECT prompt_id, memory_id, round(raw_score, 6) AS score, p.axes, d.experts
  FROM pairs JOIN routed p USING (prompt_id) JOIN docs d USING (memory_id)
  WHERE raw_score >= {DATA_RULES.min_score}
    AND (p.project IS NULL OR coalesce(d.project, '') IN (p.project, ''))),
edges AS (SELECT memory_id AS edge_id, src, rel, dst, project, experts FROM docs
  WHERE src <> '' AND dst <> ''),
ptok AS (SELECT *, list_distinct({sql_tokens('text')}) AS pt FROM routed),
etok AS (SELECT *, list_distinct({sql_tokens("src || ' ' || rel || ' ' || dst")}) AS et FROM edges),
overlap AS MATERIALIZED (SELECT prompt_id, edge_id, axes, experts,
  (len(list_intersect(pt, et)) + 0.5 * len(list_filter(pt, lambda t: length(t) >= 4
    AND NOT list_contains(et, t) AND len(list_filter(et, lambda e: contains(e, t))) > 0)))::DOUBLE
    / len(pt) AS raw_score
  FROM ptok p, etok e WHERE p.project IS NULL OR coalesce(e.project, '') IN (p.project, '')),
linked AS (SELECT prompt_id, edge_id, round(raw_score, 6) AS score, axes, experts FROM overlap
  WHERE raw_score > 0)"""


def sql_pooled(name: str, hits: str, key: str) -> str:
    """CTE ``name``: per prompt the blend of every pool, cut at five."""
    weight = "CASE axis " + " ".join(f"WHEN '{a}' THEN p.ax_{a}" for a in _AX) + " END"
    return f"""
{name}_pools AS (
  SELECT prompt_id, {key}, score, '' AS axis FROM {hits}
  UNION ALL SELECT prompt_id, {key}, score, axis FROM (
    SELECT prompt_id, {key}, score, experts, unnest(axes) AS axis FROM {hits})
    WHERE list_contains(experts, axis)),
{name}_top AS (SELECT * FROM {name}_pools QUALIFY row_number() OVER (
  PARTITION BY prompt_id, axis ORDER BY score DESC, {key}) <= 5),
{name}_best AS (SELECT prompt_id, {key},
  max(CASE WHEN axis = '' THEN score ELSE printf('%.6f', score * (1 + {weight}))::DOUBLE END) AS score,
  coalesce(array_to_string(list_sort(list(axis) FILTER (WHERE axis <> '')), ','), '') AS routed_by
  FROM {name}_top JOIN routed p USING (prompt_id) GROUP BY ALL),
{name} AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, {key}) AS rank
  FROM {name}_best QUALIFY rank <= 5)"""


MERGED_SQL = f"""
{sql_pooled('know', 'seen', 'memory_id')},
{sql_pooled('exper', 'linked', 'edge_id')},
merged AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, section, pos) AS rank
  FROM (SELECT prompt_id, 0 AS section, rank AS pos, 'knowledge' AS kind, memory_id AS item_id,
          docs.text, round(score * 1.0, 6) AS score FROM know JOIN docs USING (memory_id)
        UNION ALL SELECT prompt_id, 1, rank, 'experience', edge_id, src || ' ' || rel || ' ' || dst,
          printf('%.6f', score * 0.9::DOUBLE)::DOUBLE FROM exper JOIN edges USING (edge_id))
  QUALIFY rank <= 12)"""


def prompts(spark, sf) -> DataFrame:
    return load(spark, sf, "benchmark").select(
        F.col("item_id").alias("prompt_id"), "text",
        F.when(F.length("text") > 200, "src3").alias("project"),
    )


def _tagged(spark, sf) -> DataFrame:
    docs = load_text(spark, sf, "documents")
    out = docs.select(
        F.col("doc_id").alias("memory_id"), "text", "lang",
        F.when(F.col("lang") != "es", F.col("source")).alias("project"),
    )
    # One tokenisation serves the tags, the topic and the keyword.
    out = t.once(out, _raw=t.raw_tokens(F.col("text")), _low=F.lower("text"))
    scores = t.axis_scores(F.col("text"), DATA_RULES, F.col("_raw"), F.col("_low"))
    return t.once(out, expert_confidence=scores).withColumn(
        "experts", t.active_axes(F.col("expert_confidence"), DATA_RULES)
    )


def tagged_documents(spark, sf) -> DataFrame:
    return _tagged(spark, sf).drop("_raw", "_low")


def embedded_documents(spark, sf) -> DataFrame:
    return embed(tagged_documents(spark, sf), "text", HashedEmbedder(DATA_RULES))


def document_edges(spark, sf) -> DataFrame:
    c, raw = F.col("text"), F.col("_raw")
    labelled = t.once(
        _tagged(spark, sf), src_label=t.topic_label(c, None, DATA_RULES, raw),
        dst_label=t.primary_keyword(c, DATA_RULES, raw),
    ).filter("src_label != '' AND dst_label != ''")
    return labelled.select(
        F.col("memory_id").alias("edge_id"), "src_label", F.col("lang").alias("rel"), "dst_label",
        "project", "experts",
    )
