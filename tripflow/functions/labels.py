"""Imbalance, six demand classes and their looks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Label and colour of each class, and those of none.
LABELS = {0: "0 - None", 1: "1 - Very low", 2: "2 - Low", 3: "3 - Medium", 4: "4 - High", 5: "5 - Very high"}
COLORS = {0: "#F3F4F6", 1: "#7DD3FC", 2: "#2563EB", 3: "#FACC15", 4: "#F97316", 5: "#B91C1C"}
NO_LABEL, UNKNOWN_LABEL, NO_COLOR = "No prediction", "Unknown", "#D1D5DB"


def imbalance(delay: Column, requests: Column, area: Column) -> Column:
    """max(delay, 0) ** 1.2 * requests / area; 0 if delay (which greatest skips) or requests are null."""
    return F.coalesce(F.pow(F.greatest(delay, F.lit(0.0)), F.lit(1.2)) * requests / area, F.lit(0.0))


def city_imbalance(delay: Column, requests: Column) -> Column:
    return delay * requests


def six_class(value: Column, cuts: Sequence[Column | float], closed: str = "right") -> Column:
    """Class 0 to len(cuts): the number of cut points below value (right: strictly below)."""
    total = F.lit(0)
    for c in cuts:
        c = c if isinstance(c, Column) else F.lit(float(c))
        total = total + ((value > c) if closed == "right" else (value >= c)).cast("int")
    return total


def argmax(probabilities: Column) -> tuple[Column, Column]:
    """Index of the first greatest element, and the element."""
    best = F.array_max(probabilities)
    return (F.array_position(probabilities, best) - 1).cast("int"), best


def _lookup(c: Column, values: Mapping[int, str], default: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c.cast("int")), F.lit(default))


def class_label(c: Column) -> Column:
    """The class's label; that of an unknown class, or of none."""
    return F.when(c.isNull(), NO_LABEL).otherwise(_lookup(c, LABELS, UNKNOWN_LABEL))


def class_color(c: Column) -> Column:
    return _lookup(c, COLORS, NO_COLOR)
