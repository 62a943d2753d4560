"""The additive rule score of a notice, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticewing import domain


@dataclass(frozen=True)
class Weights:
    """Points per feature value; the defaults are the standard rule."""

    purpose: dict[str, int] = field(default_factory=lambda: dict(domain.PURPOSE_POINTS))
    type: dict[str, int] = field(default_factory=lambda: dict(domain.TYPE_POINTS))
    type_default: int = domain.TYPE_DEFAULT
    classification: dict[str, int] = field(default_factory=lambda: dict(domain.CLASSIFICATION_POINTS))
    series: dict[str, int] = field(default_factory=lambda: dict(domain.SERIES_POINTS))
    scope: dict[str, int] = field(default_factory=lambda: dict(domain.SCOPE_POINTS))


DEFAULT = Weights()


def _table(value: Column, points: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for key, score in points.items():
        out = F.when(value == key, score).otherwise(out)
    return out


def purpose(chars: Column, w: Weights = DEFAULT) -> Column:
    """Points of the first purpose present, in the order of the table."""
    out = F.lit(0)
    for key, score in reversed(list(w.purpose.items())):
        out = F.when(F.array_contains(chars, key), score).otherwise(out)
    return out


def notice_type(c: Column, w: Weights = DEFAULT) -> Column:
    return _table(c, w.type, w.type_default)


def classification(c: Column, w: Weights = DEFAULT) -> Column:
    return _table(c, w.classification, 0)


def series_and_scope(series: Column, chars: Column, w: Weights = DEFAULT) -> Column:
    """Series points plus the points of every scope present."""
    out = _table(series, w.series, 0)
    for key, score in w.scope.items():
        out = out + F.when(F.array_contains(chars, key), score).otherwise(0)
    return out
