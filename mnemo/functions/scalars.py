"""Small scalar expressions: times, JSON, budgets, projects, agents, retries."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from mnemo.config import DEFAULT_RULES, Rules
from mnemo.functions.text import strip, strings, token_set

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_ZONE = r"(Z|[+-][0-9]{2}:?[0-9]{2})$"


def round6(x: Column) -> Column:
    """Six decimals, decided on the exact binary value, halves to even.

    ``round`` looks at the shortest decimal form instead, which is a tie for
    many products of six-decimal scores although the value itself is not.
    The value is split in two halves whose products with 1e6 are exact.
    """
    spread = x * F.lit(134217729.0)
    high = spread - (spread - x)
    whole = F.floor(x * F.lit(1e6)).cast("double")
    rest = (high * F.lit(1e6) - whole) + (x - high) * F.lit(1e6)
    up = (rest > 0.5) | ((rest == 0.5) & (F.pmod(whole, F.lit(2.0)) == 1.0))
    return (whole + up.cast("double")) / F.lit(1e6)


def to_ts(c: Column) -> Column:
    """Epoch seconds or ISO-8601 to a timestamp. Without a zone it is UTC.

    NULL for empty input and for text that cannot be read; ``bad_ts`` tells the
    two apart.
    """
    text = strip(c.cast("string"))
    epoch = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    zoned = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00Z"))).when(
        text.rlike(_ZONE), text
    ).otherwise(F.concat(text, F.lit("Z")))
    looks_iso = text.rlike(r"^\d{4}-\d{2}-\d{2}")
    return F.coalesce(
        F.timestamp_micros(F.round(epoch * 1e6).cast("bigint")),
        F.when(looks_iso, zoned.try_cast("timestamp")),
    )


def bad_ts(c: Column) -> Column:
    text = strip(F.coalesce(c.cast("string"), F.lit("")))
    return (text != "") & to_ts(c).isNull()


def to_iso(ts: Column) -> Column:
    """Timestamp to ``yyyy-MM-ddTHH:mm:ssZ``, whole seconds, whatever the session's zone."""
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def json_strings(c: Column) -> Column:
    """JSON list of strings; anything else reads as an empty list."""
    parsed = F.from_json(c, "array<string>")
    return F.coalesce(F.when(F.ltrim(c).startswith("["), parsed), strings([]))


def json_doubles(c: Column) -> Column:
    """JSON object of numbers; anything else reads as an empty map."""
    parsed = F.from_json(c, "map<string,double>")
    empty = F.create_map().cast("map<string,double>")
    return F.coalesce(F.when(F.ltrim(c).startswith("{"), parsed), empty)


def backoff_seconds(attempts: Column, rules: Rules = DEFAULT_RULES) -> Column:
    grown = F.pow(F.lit(float(rules.backoff_base)), F.least(attempts, F.lit(20)))
    capped = F.least(F.lit(float(rules.backoff_cap_seconds)), grown)
    return F.when(attempts > 0, capped.cast("int")).otherwise(F.lit(0))


def budget_chars(token_budget: Column, rules: Rules = DEFAULT_RULES) -> Column:
    """Memory budget in characters; a caller may only lower the configured cap."""
    cap = F.lit(rules.memory_char_limit)
    asked = F.greatest(token_budget.cast("int") * 4, F.lit(0))
    return F.when(token_budget.isNull(), cap).otherwise(F.least(asked, cap))


def digest_chars(token_budget: Column, rules: Rules = DEFAULT_RULES) -> Column:
    """Cap of the whole digest: the budget itself, or budget plus a frame if none was given."""
    frame = rules.user_char_limit + rules.digest_frame_chars
    chars = budget_chars(token_budget, rules)
    return F.when(token_budget.isNull(), chars + frame).otherwise(chars)


def resolve_project(hint: Column, workspace: Column, rules: Rules = DEFAULT_RULES) -> Column:
    """Last path part of the first hint given, else the default project; never guessed."""
    given = F.coalesce(F.nullif(hint, F.lit("")), F.nullif(workspace, F.lit("")))
    last = F.nullif(F.element_at(F.split(strip(given), "/"), -1), F.lit(""))
    default = F.lit(rules.identity.default_project or None).cast("string")
    return F.when(given.isNotNull(), last).otherwise(default)


def recommend_agent(prompt: Column, rules: Rules = DEFAULT_RULES) -> Column:
    """Agent whose keywords hit most tokens; the first listed wins ties."""
    identity = rules.identity
    found = token_set(prompt, rules)
    scored = [
        F.struct(
            F.size(F.array_intersect(found, strings([k.lower() for k in route.keywords])))
            .alias("hits"),
            F.lit(-position).alias("order"),
            F.lit(route.agent).alias("agent"),
        )
        for position, route in enumerate(identity.agent_routes)
    ]
    if not scored:
        return F.lit(identity.default_agent)
    best = F.array_max(F.array(*scored))
    return F.when(best["hits"] > 0, best["agent"]).otherwise(F.lit(identity.default_agent))
