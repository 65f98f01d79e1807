"""Queries over the given tables, one per operator, and their SQL where there is one."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, functions as F

from mnemo.llm import (
    hamming, language, licenses, mixing, neighbours, packing, perplexity, private, quality,
    resampling, simhash, substring, turns,
)
from mnemo.llm.common import held_out, load

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


def quality_model(docs: DataFrame, labels: DataFrame) -> bytes:
    marks = labels.select("doc_id", F.col("quality").alias("label"))
    return quality.fit(docs, marks.filter(~held_out(F.col("doc_id"), 3)))


@query
def op5_quality(spark, sf) -> DataFrame:
    docs = load(spark, sf, "documents")
    model = quality_model(docs, load(spark, sf, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 3).alias("held_out"), "score", "predicted")


@query
def op10_language(spark, sf) -> DataFrame:
    docs = load(spark, sf, "documents").withColumn("held_out", held_out(F.col("doc_id"), 3))
    model = language.fit(docs.filter("NOT held_out"))
    out = docs.select("doc_id", "held_out", language.identify(F.col("text"), model).alias("found"))
    return out.select("doc_id", "held_out", "found.lang_pred", "found.score")


@query
def op3_simhash(spark, sf) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf, "documents"))


def pack_config() -> packing.PackConfig:
    """The public tokenizer of the packing queries; its file is installed, not part of this."""
    import public_tokenizers

    return packing.PackConfig(public_tokenizers.path("word_bpe_49k.json"))


@query
def op7_packing(spark, sf) -> DataFrame:
    return packing.pack(load(spark, sf, "documents"), pack_config())


@query
def op2_mixing(spark, sf) -> DataFrame:
    return mixing.mix(load(spark, sf, "documents")).drop("row", "rounds", "parts")


@query
def op8_substring(spark, sf) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", "text")
    return substring.remove_repeats(docs).select(
        "row.doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


@query
def op6_perplexity(spark, sf) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", "text", (~held_out(F.col("doc_id"), 5)).alias("training"))
    priced, n, _ = perplexity.fit(docs)
    return perplexity.score(docs, priced, n, heads=perplexity.fit_heads(docs)).select(
        "doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "n_tokens", "n_known",
        F.lit(n).cast("long").alias("train_tokens"), "base_score", "score",
    )


@query
def op1_neighbours(spark, sf) -> DataFrame:
    vectors = load(spark, sf, "embeddings").select("vec_id", "embedding")
    return neighbours.search(vectors, vectors.filter("vec_id % 50 = 0"), 5)


@query
def op9_hamming(spark, sf) -> DataFrame:
    codes = hamming.sign_bits(load(spark, sf, "embeddings").select("vec_id", "embedding"))
    return hamming.search(codes, codes.filter("vec_id % 50 = 0"), 5)


SQL["op9_hamming"] = """
SELECT query_id, rank::INT AS rank, vec_id, distance::INT AS distance FROM (
  SELECT q.vec_id AS query_id, c.vec_id, distance,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY distance, c.vec_id) AS rank
  FROM (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q JOIN embeddings c ON q.vec_id <> c.vec_id,
    LATERAL (SELECT len(list_filter(range(1, len(q.embedding) + 1),
      lambda i: (q.embedding[i] > 0) <> (c.embedding[i] > 0))) AS distance))
WHERE rank <= 5"""


@query
def op4_licenses(spark, sf) -> DataFrame:
    found = licenses.scan(load(spark, sf, "documents"))
    best = F.array_sort("hits", lambda a, b: F.signum(b["coverage"] - a["coverage"]).cast("int"))
    return found.select(
        "doc_id", F.size("hits").cast("long").alias("n_hits"), F.try_element_at(best, F.lit(1)).alias("best")
    ).select("doc_id", "n_hits", "best.license", "best.coverage", "best.start", "best.length")


@query
def op11_resampling(spark, sf) -> DataFrame:
    return resampling.resample(load(spark, sf, "documents"), load(spark, sf, "benchmark"))


#: CRC-32 of a feature's bytes, one table step a byte; the table follows from the polynomial.
SQL["op11_resampling"] = r"""
WITH steps AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1
    THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
texts AS (
  SELECT true AS doc, row_number() OVER () AS row, doc_id, text FROM documents
  UNION ALL SELECT false, row_number() OVER (), NULL, text FROM benchmark),
cut AS (SELECT doc, row, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM texts),
runs AS (SELECT doc, row, unnest(list_concat(w, list_transform(range(1, len(w)),
    lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM cut),
tally AS (SELECT doc, row, f, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT f, xor(4294967295, list_reduce(list_transform(range(strlen(f)),
      lambda i: ('0x' || substr(hex(f), (2 * i + 1)::INT, 2))::BIGINT),
      lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295)) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM tally), steps),
held AS (SELECT bucket, sum(n) FILTER (doc) AS s, sum(n) FILTER (NOT doc) AS t
  FROM tally JOIN hashed USING (f) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (all_s::DOUBLE + 10000)
    / ((coalesce(s, 0)::DOUBLE + 1) * (all_t::DOUBLE + 10000))))::BIGINT AS g
  FROM held, (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM held)),
mean AS (SELECT row, sum(n)::BIGINT AS n_features, floor(sum(n * g) / sum(n))::BIGINT AS weight
  FROM tally JOIN hashed USING (f) JOIN gain USING (bucket) WHERE doc GROUP BY row),
scored AS (SELECT doc_id, row, len(w) AS n_words, coalesce(n_features, 0) AS n_features,
    coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
      (('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296)))::BIGINT AS score
  FROM cut LEFT JOIN mean USING (row) WHERE doc),
placed AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS rank,
    count(*) OVER () * 25 // 100 AS drawn FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= drawn THEN rank END AS rank
FROM scored LEFT JOIN placed USING (row)"""


@query
def op12_turns(spark, sf) -> DataFrame:
    given = load(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    found = turns.digest(turns.repair(turns.damage(given)))
    ids = given.select(F.col("conv_id").alias("id")).distinct()
    zeros = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    none = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    whole = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("id").alias("conv_id"), *zeros, *none
    )
    return whole.fillna(0, zeros).fillna(none)


#: The plain recurrence: for each turn and state the least (cost, audit), nothing forgotten.
SQL["op12_turns"] = r"""
WITH RECURSIVE steps AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1
    THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
ways AS (SELECT *, xor(4294967295, list_reduce(list_transform(range(strlen(k)),
      lambda i: ord(substr(k, (i + 1)::INT, 1))::BIGINT),
      lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295)) % 20 AS way FROM keyed, steps),
damaged AS (SELECT conv_id, turn, CASE way WHEN 4 THEN 'user' ELSE role END AS role,
    CASE way WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE way WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM ways WHERE way <> 0),
laid AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, conv_id, turn, role, text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again,
    rtrim(text, E' \t\n\x0b\x0c\r') AS bare FROM damaged),
marked AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN again > 1 THEN 'duplicate'
    WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY c ORDER BY pos) || left(role, 1) AS pair FROM laid),
walk(p, q, ins, lines) AS (VALUES (0, 0, '', []::VARCHAR[]), (1, 1, '', []), (2, 2, '', []), (3, 3, '', []),
  (0, 2, 'I', ['user:']), (1, 2, 'I', ['user:']), (3, 2, 'I', ['user:']), (2, 3, 'I', ['assistant:']),
  (0, 3, 'II', ['user:', 'assistant:']), (1, 3, 'II', ['user:', 'assistant:'])),
move(q, edit, s) AS (VALUES (0, 'D', 0), (1, 'D', 1), (2, 'D', 2), (3, 'D', 3), (0, 'K', 1), (0, 'K', 2),
  (1, 'K', 2), (3, 'K', 2), (2, 'K', 3), (0, 'R', 2), (1, 'R', 2), (3, 'R', 2), (2, 'R', 3)),
best AS (
  SELECT DISTINCT c, 0::BIGINT AS pos, 0 AS s, {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} AS b FROM laid
  UNION ALL
  SELECT m.c, m.pos, move.s, min({
    'cost': b.cost + 5 * len(ins) + CASE edit WHEN 'K' THEN 0 WHEN 'R' THEN 1 ELSE 2 END
      + CASE WHEN edit <> 'D' AND fault = 'truncated' THEN 5 ELSE 0 END,
    'audit': b.audit || ins || edit,
    'lines': b.lines || walk.lines || CASE edit WHEN 'K' THEN [role || ':' || text]
      WHEN 'R' THEN [CASE move.s WHEN 2 THEN 'user:' ELSE 'assistant:' END || text] ELSE []::VARCHAR[] END})
  FROM best JOIN marked m ON m.c = best.c AND m.pos = best.pos + 1 JOIN walk ON walk.p = best.s JOIN move ON move.q = walk.q
  WHERE (edit = 'D' OR fault NOT IN ('blank', 'duplicate'))
    AND (edit <> 'K' OR left(role, 1) = ['s', 'u', 'a'][move.s])
  GROUP BY m.c, m.pos, move.s),
sums AS (SELECT c, any_value(conv_id) AS conv_id, max(pos) AS n,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY c),
ended AS (SELECT best.c, min({'cost': b.cost + 5 * len(ins), 'audit': b.audit || ins, 'lines': b.lines || walk.lines}) AS e
  FROM best JOIN sums ON sums.c = best.c AND best.pos = sums.n JOIN walk ON walk.p = best.s AND walk.q IN (0, 3) GROUP BY best.c)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.cost, 0) AS cost,
  coalesce(e.audit, '') AS audit, sha256(coalesce(array_to_string(e.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN sums ON i.conv_id IS NOT DISTINCT FROM sums.conv_id
LEFT JOIN ended USING (c)"""


@query
def op13_private(spark, sf) -> DataFrame:
    found = private.extract(load(spark, sf, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: int):
        # A second parameter, even one with a default, would be the place in the array.
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")

    counts = [count(i).alias(f"n_{kind}") for i, kind in enumerate(private.KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(private.joined(base).cast("binary"), 256).alias("base_sha256"),
        private.joined(F.col("spans")).alias("spans"),
    )
