"""The filter vocabulary shared by search, ranking and graph queries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from mnemo.config import HIDDEN_STATUSES
from mnemo.functions.text import strings


def status_of(c: str = "status") -> Column:
    return F.coalesce(F.col(c), F.lit("approved"))


def visible(c: str = "status") -> Column:
    """Neither superseded nor rejected; no status means approved."""
    return ~status_of(c).isin(HIDDEN_STATUSES)


def has_status(value: str, c: str = "status") -> Column:
    return status_of(c) == value


def in_project(project: str, c: str = "project") -> Column:
    return F.col(c) == project


def in_project_or_global(project: str, c: str = "project") -> Column:
    return F.coalesce(F.col(c), F.lit("")).isin(project, "")


def tagged(axes: str | Sequence[str], c: str = "experts") -> Column:
    """Tagged with any of ``axes``, whatever the case; untagged rows never match."""
    names = [axes] if isinstance(axes, str) else list(axes)
    wanted = [a.strip().lower() for a in names if a.strip()]
    if not wanted:
        return F.lit(True)
    have = F.transform(F.coalesce(F.col(c), strings([])), F.lower)
    return F.arrays_overlap(have, strings(wanted))


def min_confidence(value: float, c: str = "confidence") -> Column:
    return F.coalesce(F.col(c), F.lit(1.0)) >= F.lit(float(value))


def since(moment, c: str = "ts") -> Column:
    """At or after; rows without a time are out."""
    return F.col(c) >= F.lit(moment).cast("timestamp")


def until(moment, c: str = "ts") -> Column:
    """At or before; rows without a time stay in."""
    return F.col(c).isNull() | (F.col(c) <= F.lit(moment).cast("timestamp"))


def mentions(entity: str, c: str = "text") -> Column:
    """Literal, case-insensitive substring."""
    return F.lower(F.col(c)).contains(entity.lower())


def same_identity(identity: Column, c: str = "embed_identity") -> Column:
    """Rows of the same vector space; an unknown identity never matches."""
    return F.coalesce(F.col(c) == identity, F.lit(False))


def clamp_limit(limit: int | None, default: int = 20, most: int = 200) -> int:
    return max(1, min(most, default if limit is None else int(limit)))


@dataclass(frozen=True)
class Filters:
    project: str | None = None
    memory_type: str | None = None
    source: str | None = None
    source_type: str | None = None
    status: str | None = None
    approved_only: bool = False
    experts: str | Sequence[str] | None = None
    min_confidence: float | None = None
    date_from: object = None
    date_to: object = None
    entity: str | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        conditions = []
        if self.project:
            conditions.append(in_project(self.project))
        if self.memory_type:
            conditions.append(F.col("type") == self.memory_type)
        if self.source:
            conditions.append(F.col("source") == self.source)
        if self.source_type:
            conditions.append(F.col("source_type") == self.source_type)
        if self.status:
            conditions.append(has_status(self.status))
        elif self.approved_only:
            conditions.append(has_status("approved"))
        else:
            conditions.append(visible())
        if self.experts:
            conditions.append(tagged(self.experts))
        if self.min_confidence is not None:
            conditions.append(min_confidence(self.min_confidence))
        if self.date_from:
            conditions.append(since(self.date_from))
        if self.date_to:
            conditions.append(until(self.date_to))
        if self.entity:
            conditions.append(mentions(self.entity))
        for condition in conditions:
            df = df.filter(condition)
        return df
