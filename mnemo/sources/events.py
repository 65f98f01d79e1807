"""Outcome events: schema, validation, status coercion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mnemo.config import DEFAULT_RULES, EVENT_STATUSES, STATUSES, Rules
from mnemo.functions.text import once, strip
from mnemo.schema import EVENT

MAX_ITEMS = 100


def _kind(path: str) -> Column:
    """JSON kind of a field: STRING, ARRAY<...>, OBJECT<...>, VOID, or NULL when absent."""
    return F.schema_of_variant(F.variant_get("_json", path, "variant"))


def _string_rules(name: str, most: int, required: bool = False) -> list[tuple[Column, str]]:
    kind = _kind(f"$.{name}")
    value = F.try_variant_get("_json", f"$.{name}", "string")
    empty = kind.isNull() | (kind == "VOID") | ((kind == "STRING") & (value == ""))
    rules = [(empty, "required")] if required else []
    rules.append((~empty & (kind != "STRING"), "not_a_string"))
    rules.append((~empty & (F.length(value) > most), "too_long"))
    return rules


def _list_rules(name: str) -> list[tuple[Column, str]]:
    kind = _kind(f"$.{name}")
    given = kind.isNotNull() & (kind != "VOID")
    items = F.variant_get("_json", f"$.{name}", "array<variant>")
    is_list = kind.startswith("ARRAY")
    kinds = F.transform(F.when(is_list, items), lambda v: F.schema_of_variant(v))
    return [
        (given & ~is_list, "not_an_array"),
        (given & (F.size(kinds) > MAX_ITEMS), "too_many_items"),
        (given & F.exists(kinds, lambda k: ~k.startswith("OBJECT")), "not_an_object"),
    ]


def parse_events(lines: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """JSON events in ``value`` with ``event``, ``error_code`` and ``error_field``.

    The first broken rule is reported. A valid row's ``event`` has its status
    defaulted and its decisions' statuses checked and coerced.
    """
    parsed = once(
        lines, _json=F.try_parse_json("value"), _typed=F.from_json("value", EVENT)
    )
    parsed = once(parsed, _kind=F.schema_of_variant("_json"))
    typed = F.col("_typed")
    status = F.lower(F.coalesce(
        F.nullif(F.try_variant_get("_json", "$.status", "string"), F.lit("")), F.lit("completed")
    ))
    decision_statuses = F.transform(
        F.coalesce(typed["decisions"], F.array()),
        lambda d: F.lower(F.coalesce(F.nullif(d["status"], F.lit("")), F.lit("proposed"))),
    )
    checks: list[tuple[str | None, Column, str]] = [
        (None, F.col("_json").isNull(), "not_json"),
        (None, ~F.col("_kind").startswith("OBJECT"), "not_an_object"),
    ]

    def add(name: str, found: list[tuple[Column, str]]) -> None:
        checks.extend((name, condition, code) for condition, code in found)

    add("request_id", _string_rules("request_id", 200, required=True))
    add("status", _string_rules("status", 50) + [(~status.isin(EVENT_STATUSES), "unknown_status")])
    add("decisions", _list_rules("decisions") + [
        (F.exists(decision_statuses, lambda s: ~s.isin(STATUSES)), "unknown_status")
    ])
    for name, most in (("actor", 200), ("agent", 200), ("project", 500), ("session_id", 200),
                       ("prompt", rules.max_prompt_chars),
                       ("result_summary", rules.max_prompt_chars)):
        add(name, _string_rules(name, most))
    for name in ("lessons", "open_tasks", "artefacts", "provenance"):
        add(name, _list_rules(name))
    add("timestamp", _string_rules("timestamp", 100))

    failure = None
    for name, condition, code in checks:
        found = F.struct(F.lit(code).alias("code"), F.lit(name).cast("string").alias("field"))
        failure = F.when(condition, found) if failure is None else failure.when(condition, found)
    event = typed.withField("status", status).withField(
        "decisions", coerce_status(typed["decisions"])
    )
    checked = once(once(parsed, _error=failure), event=F.when(F.col("_error").isNull(), event))
    return checked.select(
        *lines.columns, "event",
        F.col("_error.code").alias("error_code"), F.col("_error.field").alias("error_field"),
    )


def split_events(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined); nothing is dropped."""
    ok = F.col("error_code").isNull()
    valid = parsed.filter(ok).drop("error_code", "error_field")
    return valid, parsed.filter(~ok).drop("event")


def coerce_status(decisions: Column) -> Column:
    """Decisions with a checked status; a self-assigned approval becomes a proposal.

    The claim is kept as ``submitted_status`` and flagged.
    """
    def one(d: Column) -> Column:
        status = F.lower(F.coalesce(F.nullif(d["status"], F.lit("")), F.lit("proposed")))
        claimed = status == "approved"
        return F.struct(
            d["text"].alias("text"),
            F.when(claimed, "proposed").otherwise(status).alias("status"),
            d["project"].alias("project"),
            F.when(claimed, status).alias("submitted_status"),
            claimed.alias("status_coerced"),
        )

    return F.transform(decisions, one)


def coerced_decisions(decisions: Column) -> Column:
    """What to tell the sender: each downgraded decision with its index."""
    indexed = F.transform(decisions, lambda d, i: F.struct(
        i.alias("index"), F.substring(F.coalesce(d["text"], F.lit("")), 1, 120).alias("text"),
        d["submitted_status"].alias("submitted_status"), d["status"].alias("stored_status"),
        d["status_coerced"].alias("coerced"),
    ))
    return F.transform(
        F.filter(indexed, lambda d: d["coerced"]), lambda d: d.dropFields("coerced")
    )


def read_events(
    spark: SparkSession, path: str, streaming: bool = False, rules: Rules = DEFAULT_RULES
) -> DataFrame:
    """Events of JSON-lines files, batch or stream, each checked."""
    reader = spark.readStream if streaming else spark.read
    return parse_events(reader.text(path), rules)


def event_rows(valid: DataFrame) -> DataFrame:
    """Valid events as flat columns, with an id for those that came without one."""
    flat = valid.select(*[c for c in valid.columns if c != "event"], "event.*")
    given = F.nullif(strip(F.coalesce("event_id", F.lit(""))), F.lit(""))
    # Derived from the idempotency key, so that a replay gives the same id.
    made = F.concat(F.lit("evt_"), F.md5("request_id"))
    return flat.withColumn("event_id", F.coalesce(given, made))
