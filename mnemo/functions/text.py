"""Text curation as column expressions: nothing here shuffles or leaves the JVM.

Regex notes. Spark uses Java patterns, whose ``\\w`` and ``\\s`` are ASCII; the
``U`` flag makes them Unicode and ``d`` makes ``^`` follow ``\\n`` only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from mnemo.config import (
    DEFAULT_RELATION, DEFAULT_RULES, FILE_PATTERN, MODULE_PATTERN, RELATION_CUES,
    RELATION_CUE_WORDS, TOKEN_PATTERN, TRUNCATION_MARKER, Axis, Rules,
)

# Unicode white space, spelled out so that every engine agrees on it.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SENTENCE_END = rf"(?<=[.!?]){SPACE_CLASS}+|\n+"
# Unicode noncharacters, reserved for uses like this one.
BLOCK_MARK = "\ufdd0\ufdd1"
FENCE = "```"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strings(values: Sequence[str]) -> Column:
    """Literal array<string>, empty included."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row, whatever is done with them later.

    A plain column is an expression the optimizer copies into every filter and
    projection above it; generated output is a value.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def is_blank(c: Column) -> Column:
    return F.length(strip(_text(c))) == 0


# -- tokens ---------------------------------------------------------------------
def raw_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(_text(c)), F.lit(TOKEN_PATTERN), F.lit(0))


def tokens(c: Column, rules: Rules = DEFAULT_RULES, raw: Column | None = None) -> Column:
    """Tokens in order, without stop words and all-digit tokens."""
    stop = list(rules.stop_words)
    # Digits cut off the front leave nothing of an all-digit token; a pattern takes longer to say so.
    return F.filter(
        raw_tokens(c) if raw is None else raw, lambda t: ~t.isin(stop) & (F.ltrim(t, F.lit("0123456789")) != "")
    )


def token_set(c: Column, rules: Rules = DEFAULT_RULES) -> Column:
    return F.array_distinct(tokens(c, rules))


def keyword_hits(
    c: Column, keywords: Sequence[str], raw: Column | None = None, lowered: Column | None = None
) -> Column:
    """How many of ``keywords`` occur. Words match whole raw tokens, phrases any substring.

    ``raw`` and ``lowered`` may carry the text's ``raw_tokens`` and lower case
    when the caller has them as columns already.
    """
    wanted = [k.lower() for k in dict.fromkeys(keywords)]
    words = [k for k in wanted if " " not in k]
    phrases = [k for k in wanted if " " in k]
    hits = F.lit(0)
    if words:
        source = raw_tokens(c) if raw is None else raw
        hits = hits + F.size(F.array_intersect(source, strings(words)))
    if phrases:
        low = F.lower(_text(c)) if lowered is None else lowered
        for phrase in phrases:
            hits = hits + low.contains(phrase).cast("int")
    return hits


def primary_keyword(
    c: Column, rules: Rules = DEFAULT_RULES, raw: Column | None = None
) -> Column:
    """Longest token of at least four characters, the first one on ties, else ''."""
    long_tokens = F.filter(tokens(c, rules, raw), lambda t: F.length(t) >= 4)
    keyed = F.transform(
        long_tokens,
        lambda t, i: F.struct((-F.length(t)).alias("size"), i.alias("pos"), t.alias("token")),
    )
    return F.coalesce(F.array_min(keyed)["token"], F.lit(""))


# -- segmentation ---------------------------------------------------------------
def segments(c: Column, rules: Rules = DEFAULT_RULES) -> Column:
    """Sentence-like parts of a message; fenced code stays whole.

    Short parts are dropped and long ones cut every ``max_segment_chars``, with
    a short tail dropped too.
    """
    low, high = rules.min_segment_chars, rules.max_segment_chars
    marked = F.regexp_replace(
        _text(c), r"(?s)(```.*?```)", BLOCK_MARK + "$1" + BLOCK_MARK
    )
    blocks = F.transform(F.split(marked, BLOCK_MARK), strip)
    parts = F.flatten(F.transform(
        blocks,
        lambda b: F.when(b.startswith(FENCE), F.array(b))
        .otherwise(F.transform(F.split(b, SENTENCE_END), strip)),
    ))
    kept = F.filter(parts, lambda p: F.length(p) >= low)
    cut = F.flatten(F.transform(
        kept,
        lambda p: F.when(F.length(p) <= high, F.array(p)).otherwise(
            F.transform(
                F.sequence(F.lit(0), F.floor((F.length(p) - 1) / high).cast("int")),
                lambda i: F.substring(p, i * high + 1, F.lit(high)),
            )
        ),
    ))
    return F.filter(cut, lambda p: F.length(p) >= low)


# -- classification ---------------------------------------------------------------
def java_pattern(pattern: str) -> str:
    return "(?Ud)" + pattern


def class_scores(
    c: Column, rules: Rules = DEFAULT_RULES, raw: Column | None = None,
    lowered: Column | None = None,
) -> Column:
    """Keyword hits per class; each structural pattern adds 2 to experience, once."""
    experience = keyword_hits(c, rules.experience_keywords, raw, lowered).cast("double")
    for pattern in rules.experience_patterns:
        experience = experience + F.when(_text(c).rlike(java_pattern(pattern)), 2.0).otherwise(0.0)
    knowledge = keyword_hits(c, rules.knowledge_keywords, raw, lowered).cast("double")
    return F.struct(experience.alias("experience"), knowledge.alias("knowledge"))


def classify(scores: Column, rules: Rules = DEFAULT_RULES) -> Column:
    """'experience' when it clearly wins, else 'knowledge'; ``scores`` is ``class_scores``."""
    wins = scores["experience"] > scores["knowledge"] + F.lit(float(rules.classification_margin))
    return F.when(wins, F.lit("experience")).otherwise(F.lit("knowledge"))


# -- axes -------------------------------------------------------------------------
def axis_scores(
    c: Column,
    rules: Rules = DEFAULT_RULES,
    raw: Column | None = None,
    lowered: Column | None = None,
    kind: Column | None = None,
) -> Column:
    """map<axis, confidence> over axes with a hit: weight * hits / (hits + saturation).

    With ``kind`` the ``experience_only`` axes are scored on experience rows
    only; without it (prompts) the gate is open.
    """
    saturation = float(rules.axis_saturation) or 1.0

    def entry(axis: Axis) -> Column:
        hits = keyword_hits(c, axis.keywords, raw, lowered)
        if kind is not None and axis.experience_only:
            hits = F.when(kind == "experience", hits).otherwise(0)
        return F.struct(
            F.lit(axis.name).alias("axis"), F.lit(float(axis.weight)).alias("weight"),
            hits.alias("hits"),
        )

    if not rules.axes:
        return F.create_map().cast("map<string,double>")
    scored = F.filter(F.array(*[entry(a) for a in rules.axes]), lambda e: e["hits"] > 0)
    return F.map_from_entries(F.transform(scored, lambda e: F.struct(
        e["axis"].alias("key"),
        F.round(e["weight"] * e["hits"] / (e["hits"] + F.lit(saturation)), 6).alias("value"),
    )))


def active_axes(scores: Column, rules: Rules = DEFAULT_RULES) -> Column:
    """Axis names at or above the floor, strongest first, names break ties."""
    floor = F.lit(float(rules.axis_min_confidence))
    passing = F.filter(F.map_entries(scores), lambda e: e["value"] >= floor)
    ranked = F.array_sort(F.transform(
        passing, lambda e: F.struct((-e["value"]).alias("rank"), e["key"].alias("axis"))
    ))
    return F.transform(ranked, lambda e: e["axis"])


# -- entities and relations ---------------------------------------------------------
def entities(c: Column) -> Column:
    files = F.regexp_extract_all(_text(c), F.lit(java_pattern(FILE_PATTERN)), F.lit(0))
    modules = F.regexp_extract_all(_text(c), F.lit(java_pattern(MODULE_PATTERN)), F.lit(1))
    return F.array_distinct(F.concat(files, modules))


def relation_cue(c: Column) -> Column:
    out = None
    for name, pattern in RELATION_CUES:
        hit = _text(c).rlike("(?iUd)" + pattern)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(DEFAULT_RELATION))


def topic_label(
    c: Column, exclude: Column | None = None, rules: Rules = DEFAULT_RULES,
    raw: Column | None = None,
) -> Column:
    """First token fit to name a topic, else ''."""
    skip = list(RELATION_CUE_WORDS)

    def fits(t: Column) -> Column:
        ok = (F.length(t) >= 4) & ~t.contains(".") & ~t.isin(skip)
        return ok if exclude is None else ok & (t != exclude)

    return F.coalesce(F.get(F.filter(tokens(c, rules, raw), fits), F.lit(0)), F.lit(""))


def triples(
    c: Column, rules: Rules = DEFAULT_RULES, found: Column | None = None
) -> Column:
    """array<struct<src,rel,dst>>; ``found`` may carry the text's ``entities``."""
    named = entities(c) if found is None else found
    first = F.get(named, F.lit(0))
    rel = relation_cue(c)
    topic = topic_label(c, first, rules)

    def triple(dst: Column) -> Column:
        return F.struct(first.alias("src"), rel.alias("rel"), dst.alias("dst"))

    others = F.transform(F.slice(named, F.lit(2), F.greatest(F.size(named) - 1, F.lit(0))), triple)
    none = F.filter(others, lambda _: F.lit(False))
    lone = F.when(topic != "", F.array(triple(topic))).otherwise(none)
    return (
        F.when(F.size(named) >= 2, others)
        .when(F.size(named) == 1, lone)
        .otherwise(none)
    )


# -- rendering ------------------------------------------------------------------------
def truncate(c: Column, limit: Column | int) -> Column:
    """At most ``limit`` characters, cut at a space when one lies beyond 60 percent."""
    text = _text(c)
    limit = F.lit(limit) if isinstance(limit, int) else limit
    marker = len(TRUNCATION_MARKER)
    room = limit - marker
    head = F.substring(text, F.lit(1), room)
    from_end = F.locate(" ", F.reverse(head))
    space = F.when(from_end > 0, F.length(head) - from_end).otherwise(-1)
    body = F.when(space > room * F.lit(0.6), F.substring(head, F.lit(1), space)).otherwise(head)
    return (
        F.when(limit <= 0, F.lit(""))
        .when(F.length(text) <= limit, text)
        .when(limit <= marker, F.substring(text, F.lit(1), limit))
        .otherwise(F.concat(body, F.lit(TRUNCATION_MARKER)))
    )


def bullet(kind: Column, text: Column) -> Column:
    tag = F.when(kind == "knowledge", F.lit("K")).otherwise(F.lit("E"))
    return F.concat(F.lit("- ["), tag, F.lit("] "), text, F.lit("\n"))


BULLET_OVERHEAD = len("- [K] \n")


def edge_text(src: Column, rel: Column, dst: Column) -> Column:
    return F.concat_ws(" ", src, rel, dst)


def token_estimate(c: Column) -> Column:
    """Four characters per token; takes a string or an array of strings."""
    return F.greatest(F.lit(1), F.floor(F.length(_text(c)) / 4).cast("int"))


def token_estimate_all(texts: Column) -> Column:
    total = F.aggregate(
        texts, F.lit(0), lambda n, t: n + F.floor(F.length(_text(t)) / 4).cast("int")
    )
    return F.greatest(F.lit(1), total)
