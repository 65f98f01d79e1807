"""Searches and context requests as tables: a request is a row, its filters are columns.

Bad requests are told apart with the first rule they break. The good ones are answered together:
requests are grouped by their filters, and a row meets a group by one key per set of columns that
some group asks for, so a join on that key is all there is. What is left of a filter (tags, times,
confidence, words) is checked on the pairs that met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mnemo.config import DEFAULT_RULES, STATUSES, Rules
from mnemo.functions.scalars import round6, to_ts
from mnemo.functions.text import once
from mnemo.functions.vectors import paired_cosine
from mnemo.operators.overlap import with_payload
from mnemo.operators.predicates import same_identity, status_of, visible
from mnemo.operators.probe import SALTS
from mnemo.operators.upsert import first_wins
from mnemo.sources.tables import stage

#: Columns compared for equality, as request column -> memory column.
EQUAL = {"project": "project", "memory_type": "type", "source": "source", "source_type": "source_type", "status": "status"}
FILTERS = [*EQUAL, "approved_only", "experts", "min_confidence", "date_from", "date_to", "entity"]
LIMIT, MOST = 20, 200


def _kind(path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get("_json", path, "variant"))


def _value(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("_json", path, kind)


def _given(path: str) -> Column:
    kind = _kind(path)
    return kind.isNotNull() & (kind != "VOID")


def _is_int(path: str) -> Column:
    return F.coalesce(_kind(path) == "BIGINT", F.lit(False))


def _empty(path: str) -> Column:
    """Absent, null, or a value that counts as none: '', 0, false, [] or {}."""
    kind, text = _kind(path), _value(path)
    nothing = (kind == "STRING") & (text == "") | (kind == "BOOLEAN") & ~_value(path, "boolean")
    nothing = nothing | kind.isin("BIGINT") & (_value(path, "bigint") == 0)
    nothing = nothing | text.isin("[]", "{}") & ~kind.isin("STRING")
    return ~_given(path) | F.coalesce(nothing, F.lit(False))


def _text_rules(name: str, most: int, required: bool = False) -> list[tuple[str | None, Column, str]]:
    empty = ~_given(f"$.{name}") | (_kind(f"$.{name}") == "STRING") & (_value(f"$.{name}") == "")
    rules = [(name, empty, "required")] if required else []
    rules.append((name, ~empty & (_kind(f"$.{name}") != "STRING"), "not_a_string"))
    return [*rules, (name, ~empty & (F.length(_value(f"$.{name}")) > most), "too_long")]


def _checked(lines: DataFrame, checks, columns: dict[str, Column]) -> DataFrame:
    """``lines`` with ``columns``, NULL in rows that break a check, and error_code, error_field."""
    parsed = once(lines, _json=F.try_parse_json("value"))
    parsed = once(parsed, _kind=F.schema_of_variant("_json"))
    failure = None
    start = [(None, F.col("_json").isNull(), "not_json"), (None, ~F.col("_kind").startswith("OBJECT"), "not_an_object")]
    for name, condition, code in [*start, *checks]:
        found = F.struct(F.lit(code).alias("code"), F.lit(name).cast("string").alias("field"))
        condition = F.coalesce(condition, F.lit(False))
        failure = F.when(condition, found) if failure is None else failure.when(condition, found)
    parsed = once(parsed, _error=failure)
    fine = F.col("_error").isNull()
    return parsed.select(
        *lines.columns, *[F.when(fine, c).alias(n) for n, c in columns.items()],
        F.col("_error.code").alias("error_code"), F.col("_error.field").alias("error_field"),
    )


def _time(path: str) -> Column:
    return to_ts(F.nullif(_value(path), F.lit("")))


def parse_searches(lines: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """JSON search requests in ``value`` as rows: query, the ``FILTERS``, limit, error_code, error_field.

    The limit stands beside or inside the filters and is brought into 1 to 200. Tags are one
    string or a list; times a range or two fields.
    """
    f = "$.filters"
    in_filters = _kind(f"{f}.limit").isNotNull()
    given = in_filters | _kind("$.limit").isNotNull()
    limit = F.when(in_filters, _value(f"{f}.limit", "bigint")).when(given, _value("$.limit", "bigint")).otherwise(LIMIT)
    whole = F.when(in_filters, _is_int(f"{f}.limit")).when(given, _is_int("$.limit")).otherwise(True)
    tags = _kind(f"{f}.experts")
    checks = [
        *_text_rules("query", rules.max_prompt_chars),
        ("filters", ~_empty(f) & ~_kind(f).startswith("OBJECT"), "not_an_object"),
        ("filters.status", _given(f"{f}.status") & ~F.lower(_value(f"{f}.status")).isin(STATUSES), "unknown_status"),
        ("limit", ~whole, "not_an_integer"),
        ("filters.date_range", ~_empty(f"{f}.date_range") & ~_kind(f"{f}.date_range").startswith("OBJECT"), "not_an_object"),
        ("filters.experts", _given(f"{f}.experts") & (tags != "STRING") & ~tags.startswith("ARRAY"), "not_an_array"),
    ]

    def text(name: str) -> Column:
        return F.when(~_empty(f"{f}.{name}"), _value(f"{f}.{name}"))

    listed = F.transform(_value(f"{f}.experts", "array<variant>"), lambda v: F.try_variant_get(v, "$", "string"))
    columns = {
        "query": F.nullif(_value("$.query"), F.lit("")),
        **{name: text(name) for name in EQUAL},
        "approved_only": ~_empty(f"{f}.approved_only"),
        "experts": F.when(tags == "STRING", F.array(_value(f"{f}.experts"))).otherwise(listed),
        "min_confidence": F.when(_given(f"{f}.confidence"), _value(f"{f}.confidence", "double")),
        "date_from": F.coalesce(_time(f"{f}.date_range.from"), _time(f"{f}.date_from")),
        "date_to": F.coalesce(_time(f"{f}.date_range.to"), _time(f"{f}.date_to")),
        "entity": text("entity"),
        "limit": F.least(F.greatest(limit, F.lit(1)), F.lit(MOST)).cast("int"),
    }
    return _checked(lines, checks, columns)


def parse_contexts(lines: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """JSON context requests in ``value`` as rows: prompt, request_id, token_budget, names, and errors."""
    budget = "$.token_budget"
    names = {"request_id": 200, "actor": 200, "entrypoint": 200, "project_hint": 500, "session_id": 200, "active_workspace": 1000}
    amount = _value(budget, "bigint")
    checks = [
        *_text_rules("prompt", rules.max_prompt_chars, required=True),
        ("token_budget", _given(budget) & ~_is_int(budget), "not_an_integer"),
        ("token_budget", _given(budget) & (amount <= 0), "not_positive"),
        ("token_budget", _given(budget) & (amount > rules.max_token_budget), "too_large"),
        ("permissions", ~_empty("$.permissions") & ~_kind("$.permissions").startswith("OBJECT"), "not_an_object"),
        *[rule for name, most in names.items() for rule in _text_rules(name, most)],
    ]
    text = {name: F.nullif(_value(f"$.{name}"), F.lit("")) for name in names}
    return _checked(lines, checks, {"prompt": _value("$.prompt"), **text, "token_budget": amount.cast("int")})


def split_requests(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects); rejects keep their line and say what is wrong with it."""
    ok = F.col("error_code").isNull()
    return parsed.filter(ok).drop("error_code", "error_field"), parsed.filter(~ok)


def _meeting_key(mask: Column, values: list[Column]) -> Column:
    """Hash of the columns that a mask names, and of the mask; other columns do not count."""
    named = [F.when(F.getbit(mask, F.lit(i)) == 1, v) for i, v in enumerate(values)]
    return F.xxhash64(mask, *named)


def search(
    requests: DataFrame,
    knowledge: DataFrame,
    identity: Column | None = None,
    payload: tuple[str, ...] = (),
) -> DataFrame:
    """Answers of ``requests`` (request_id, the ``FILTERS``, limit, optional embedding).

    Result: request_id, memory_id, score, payload…, rank. Without an embedding that is not zero a
    request gets the newest rows, then the highest ids, unscored; with one the closest rows, ties to
    the smaller id, and rows of another vector space after them, unscored. Filters that are null
    ask for nothing. Hidden rows show only to a request for their status. Request ids are unique.
    """
    ready = requests.withColumn("status", F.coalesce("status", F.when(F.col("approved_only"), "approved")))
    if "embedding" not in ready.columns:
        ready = ready.withColumn("embedding", F.lit(None).cast("array<float>"))
    asks = F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    tags = F.filter(F.transform("experts", lambda a: F.lower(F.trim(a))), lambda a: a != "")
    ready = ready.withColumns({
        "embedding": F.when(asks, F.col("embedding")), "entity": F.lower("entity"),
        "experts": F.when(F.size(tags) > 0, F.array_sort(F.array_distinct(tags))),
        "mask": sum(
            (F.when(F.col(c).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(EQUAL)), F.lit(0)
        ).cast("int"),
    })
    rest = ["experts", "min_confidence", "date_from", "date_to", "entity"]
    ready = stage(ready.withColumn("key", _meeting_key(F.col("mask"), [F.col(c) for c in EQUAL])).withColumn(
        "group", F.xxhash64("key", *rest, "embedding")
    ), "searches")
    # Requests that ask for the same share one answer, cut at the largest limit.
    groups = first_wins(ready, ["group"], ["request_id"]).drop("limit")
    groups = groups.join(ready.groupBy("group").agg(F.max("limit").alias("limit")), "group")
    # There are as many masks as there are sets of filter columns: 32 at most.
    masks = [r.mask for r in ready.select("mask").distinct().collect()]

    values = [F.col(c) if c != "status" else status_of() for c in EQUAL.values()]
    keys = F.array(*[_meeting_key(F.lit(m), values) for m in masks]) if masks else F.array().cast("array<bigint>")
    comparable = F.lit(True) if identity is None else same_identity(identity)
    vector = F.col("embedding") if "embedding" in knowledge.columns else F.lit(None).cast("array<float>")
    rows = knowledge.select(
        "memory_id", F.explode(F.array_distinct(keys)).alias("key"), visible().alias("_visible"),
        F.transform("experts", F.lower).alias("_tags"), F.coalesce("confidence", F.lit(1.0)).alias("_confidence"),
        F.col("ts").alias("_ts"), F.lower("text").alias("_text"), vector.alias("_vector"), comparable.alias("_comparable"),
        *[v.alias(f"_{n}") for n, v in zip(EQUAL, values)],
    )
    asked = groups.select("group", "key", *EQUAL, *rest, "embedding", "limit")

    def or_none(column: str, held: Column) -> Column:
        return F.col(column).isNull() | F.coalesce(held, F.lit(False))

    fits = or_none("experts", F.arrays_overlap("_tags", "experts"))
    fits &= or_none("min_confidence", F.col("_confidence") >= F.col("min_confidence"))
    fits &= or_none("date_from", F.col("_ts") >= F.col("date_from"))
    fits &= F.col("date_to").isNull() | F.col("_ts").isNull() | (F.col("_ts") <= F.col("date_to"))
    fits &= or_none("entity", F.col("_text").contains(F.col("entity")))
    fits &= F.col("status").isNotNull() | F.col("_visible")
    # The key is a hash; the columns settle what it lets through.
    for name in EQUAL:
        fits &= or_none(name, F.col(f"_{name}") == F.col(name))
    # Pairs without a score send no vectors to Python.
    asks = F.col("embedding").isNotNull() & F.col("_comparable")
    near = paired_cosine(F.when(asks, F.col("embedding")), F.when(asks, F.col("_vector")))
    hits = rows.join(asked, "key").filter(fits).select(
        "group", "memory_id", F.when(asks, round6(near)).alias("score"), "limit",
        F.when(F.col("embedding").isNull(), F.col("_ts")).alias("newest"),
        F.when(F.col("embedding").isNull(), F.col("memory_id")).alias("latest"),
    )
    best = [
        F.col("score").desc_nulls_last(), F.col("newest").desc_nulls_last(), F.col("latest").desc_nulls_last(), F.col("memory_id"),
    ]
    for by in (["group", F.pmod(F.xxhash64("memory_id"), F.lit(SALTS))], ["group"]):
        hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*best)))
        hits = hits.filter(F.col("rank") <= MOST).filter(F.col("rank") <= F.col("limit"))
    found = with_payload(hits.select("group", "memory_id", "score", "rank"), knowledge, "memory_id", payload)
    told = ready.select("request_id", "group", F.col("limit").alias("_limit"))
    found = told.join(found, "group").filter(F.col("rank") <= F.col("_limit"))
    return found.select("request_id", "memory_id", "score", *[c for c in payload if c != "memory_id"], "rank")
