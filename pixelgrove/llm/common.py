"""Shared helpers of the training-data operators: cleaning expressions, and the core's table access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import BROADCAST_ROWS, broadcast_if_small, materialise, one_per_key, shared_dir, small_enough, table

__all__ = ["BROADCAST_ROWS", "N_FEATURES", "OUTCOMES", "broadcast_if_small", "feature_names", "materialise", "one_per_key", "outcome_code", "outcome_name", "present", "shared_dir", "small_enough", "table"]

N_FEATURES = 26
OUTCOMES = ("LeftShoulder", "RightShoulder", "Head", "Neck", "Sternum", "Other")


def _position(c: Column | str) -> Column:
    """1-based position among the six names; 0 for none, null for null. One pass over the text: no chain of comparisons."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_position(F.array(*[F.lit(n.lower()) for n in OUTCOMES]), F.lower(F.btrim(c, F.lit(" \t\r\n\f\v"))))


def outcome_name(c: Column | str) -> Column:
    """One of the six outcome names in canonical spelling; null for ``None``, null and anything else.

    Letter case and surrounding blanks, tabs and line ends never matter.
    """
    at = _position(c).cast("int")
    return F.when(at > 0, F.element_at(F.array(*map(F.lit, OUTCOMES)), at))


def outcome_code(c: Column | str) -> Column:
    """Position of the outcome among the six names from 0 as int, 99 for all others (None, null)."""
    at = _position(c).cast("int")
    return F.when(at > 0, at - 1).otherwise(99)


def present(c: Column | str) -> Column:
    """A feature cell, with both spellings of a missing one (null and -1) as null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c != -1, c)


def feature_names(n: int = N_FEATURES) -> list[str]:
    return [f"f{i}" for i in range(n)]
