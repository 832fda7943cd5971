"""Version labels, their order, and which of two versions stands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"(\d+)\.(\d+)"


def tag(label: Column) -> Column:
    """The last major.minor of a label, null without one."""
    found = F.regexp_extract_all(label, F.lit(r"(\d+\.\d+)(?:\.\d+)?"), 1)
    return F.try_element_at(found, F.lit(-1))


def sort_key(tag: Column) -> Column:
    """major * 1000 + minor."""
    part = lambda i: F.try_to_number(F.regexp_extract(tag, _NUMBER, i), F.lit("999999999")).cast("long")
    return part(1) * 1000 + part(2)


def label(tag: Column, raw: Column) -> Column:
    """What the rule for updates compares."""
    return F.lower(F.trim(F.coalesce(tag, raw, F.lit(""))))


def prefer(existing: Column, candidate: Column, existing_key: Column, candidate_key: Column, earlier: bool) -> Column:
    """The earlier (created) or later (updated) version; one without a key loses to one with; equal keys keep the existing."""
    better = candidate_key < existing_key if earlier else candidate_key > existing_key
    takes = candidate.isNotNull() & (existing.isNull() | (candidate_key.isNotNull() & (existing_key.isNull() | better)))
    return F.when(takes, candidate).otherwise(existing)
