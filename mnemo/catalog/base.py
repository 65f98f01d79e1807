"""Registry of queries over the given tables, each with SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mnemo.config import DEFAULT_RULES, AgentRoute, Axis, Identity
from mnemo.functions.text import SPACES
from mnemo.sources.tables import spread

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    def register(run: Query) -> Query:
        REGISTRY[name] = Entry(run, sql)
        return run
    return register


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def utc(c: str) -> Column:
    """The instant of a zone-less column, which holds UTC."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(c)).cast("timestamp")


def load_text(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table for heavy per-row text work, on all cores even when it is one small file."""
    return spread(load(spark, folder, table))


# The given tables are invented prose, so the queries over them use words that do
# occur there as keywords.
DATA_RULES = DEFAULT_RULES.with_(
    experience_keywords=("the", "and", "und", "die", "le", "la", "el", "of the", "in der"),
    knowledge_keywords=("of", "in", "der", "les", "de", "los", "is", "to", "de la"),
    axes=(
        Axis("english", ("the", "and", "of the", "that"), 1.0),
        Axis("german", ("der", "und", "die", "in den", "mit"), 0.9),
        Axis("romance", ("les", "une", "de la", "que"), 0.8),
        Axis("claims", ("is", "ist", "est", "es"), 1.0, experience_only=True),
    ),
    axis_min_confidence=0.5,
    min_score=0.1,
    identity=Identity(agent_routes=(
        AgentRoute("northern", ("the", "and", "und", "die", "edly")),
        AgentRoute("southern", ("les", "une", "que", "los", "de", "mente")),
    )),
)


# -- SQL fragments -------------------------------------------------------------------
SQL_SPACE = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def sql_strip(c: str) -> str:
    return f"trim({c}, '{SPACES}')"


def sql_list(values: Sequence[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_raw_tokens(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[a-z0-9_./-]+')"


def sql_tokens(c: str, rules=DEFAULT_RULES) -> str:
    stop = sql_list(rules.stop_words)
    return (
        f"list_filter({sql_raw_tokens(c)}, lambda t: NOT list_contains({stop}, t) "
        "AND regexp_matches(t, '[^0-9]'))"
    )


def sql_hits(c: str, keywords: Sequence[str]) -> str:
    words = [k for k in keywords if " " not in k]
    phrases = [k for k in keywords if " " in k]
    parts = ["0"]
    if words:
        parts.append(f"len(list_intersect({sql_raw_tokens(c)}, {sql_list(words)}))")
    parts += [f"contains(lower({c}), '{p}')::INT" for p in phrases]
    return "(" + " + ".join(parts) + ")"


def sql_distinct_in_order(c: str) -> str:
    return f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"


def sql_segments(table: str, keys: str, text: str, carry: str = "", name: str = "segments") -> str:
    """CTEs ending in ``name`` (keys, carry, seg, text)."""
    extra = f", {carry}" if carry else ""
    return rf"""
{name}_parts AS (
  SELECT {keys}{extra}, unnest(p) AS part, generate_subscripts(p, 1) AS i FROM (
    SELECT {keys}{extra}, string_split(regexp_replace(regexp_replace({text},
      '([.!?]){SQL_SPACE}+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)) AS p
    FROM {table})),
{name}_kept AS (
  SELECT {keys}{extra}, i, {sql_strip('part')} AS part FROM {name}_parts
  WHERE length({sql_strip('part')}) >= 16),
{name}_cut AS (
  SELECT {keys}{extra}, i, j, substring(part, j * 600 + 1, 600) AS text
  FROM {name}_kept, unnest(range(0, CAST(ceil(length(part) / 600.0) AS BIGINT))) AS u(j)),
{name} AS (
  SELECT {keys}{extra}, row_number() OVER (PARTITION BY {keys} ORDER BY i, j) - 1 AS seg, text
  FROM {name}_cut WHERE length(text) >= 16)"""


def sql_axis_columns(c: str, rules, gate: str | None = None) -> dict[str, str]:
    """axis -> confidence expression, NULL without a hit."""
    out = {}
    for axis in rules.axes:
        hits = sql_hits(c, axis.keywords)
        if gate and axis.experience_only:
            hits = f"(CASE WHEN {gate} = 'experience' THEN {hits} ELSE 0 END)"
        out[axis.name] = (
            f"(CASE WHEN {hits} > 0 THEN round({axis.weight} * {hits} / "
            f"({hits} + {rules.axis_saturation}), 6) END)"
        )
    return out


def sql_active(rules, prefix: str = "ax_") -> str:
    """Active axes in order as one comma list, over columns ``ax_<name>``."""
    entries = ", ".join(
        f"{{'s': -{prefix}{a.name}, 'a': '{a.name}'}}" for a in rules.axes
    )
    return (
        f"list_transform(list_sort(list_filter([{entries}], "
        f"lambda e: e.s <= -{rules.axis_min_confidence})), lambda e: e.a)"
    )


def sql_topic(c: str, rules=DEFAULT_RULES) -> str:
    from mnemo.config import RELATION_CUE_WORDS

    return (
        f"coalesce(list_filter({sql_tokens(c, rules)}, lambda t: length(t) >= 4 "
        f"AND NOT contains(t, '.') AND NOT list_contains({sql_list(RELATION_CUE_WORDS)}, t))[1], '')"
    )


def sql_primary_keyword(c: str, rules=DEFAULT_RULES) -> str:
    return (
        f"coalesce(list_sort(list_transform(list_filter({sql_tokens(c, rules)}, "
        "lambda t: length(t) >= 4), lambda t, i: {'n': -length(t), 'i': i, 't': t}))[1].t, '')"
    )


def sql_key_hash(*parts: str) -> str:
    sized = " || ".join(f"length({p})::VARCHAR || ':' || {p}" for p in parts)
    return f"md5({sized})"
