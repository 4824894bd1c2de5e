"""Fielded conditions as filter expressions.

Every condition is a Column; they are combined with ``&``, ``|`` and ``~``, so a Boolean query is
an ordinary DataFrame filter that Catalyst plans. A null value never matches, and its negation
always does.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE = r"[^\p{L}\p{N}]"


@dataclass(frozen=True)
class Field:
    """How a field is matched: words of a text, an exact value, a number, or members of an array."""

    column: str
    kind: str = "text"


class Fields:
    """Named fields of a table, some of which are searched where no field is named."""

    def __init__(self, fields: dict[str, Field], default: tuple[str, ...]) -> None:
        self.fields, self.default = fields, default

    def named(self, name: str) -> Field:
        if name not in self.fields:
            raise ValueError(f"no field named {name!r}")
        return self.fields[name]

    def has(self, name: str, value: str) -> Column:
        """The field holds the value: as whole words of a text (several words are a phrase), else equal to it."""
        return matched(self.named(name), value, False)

    def starts(self, name: str, value: str) -> Column:
        """As ``has``, where the value is the beginning of the last word, or of the exact value."""
        return matched(self.named(name), value, True)

    def between(self, name: str, low: int, high: int | None = None) -> Column:
        """A number from ``low`` to ``high``, or equal to ``low``."""
        if self.named(name).kind != "number":
            raise ValueError(f"{name!r} is not a number")
        return F.coalesce(F.col(self.named(name).column).between(low, low if high is None else high), F.lit(False))

    def anywhere(self, value: str, beginning: bool = False) -> Column:
        """Any of the default fields holds the value."""
        return reduce(or_, (matched(self.named(f), value, beginning) for f in self.default))


def matched(field: Field, value: str, beginning: bool) -> Column:
    if not value.strip() or "*" in value:
        raise ValueError(f"not supported: {value!r}")
    c, low = F.col(field.column), value.lower()
    if field.kind == "number":
        raise ValueError(f"{field.column!r} is a number: ask for a range")
    if field.kind == "array":
        found = F.exists(c, lambda x: F.lower(x).startswith(low) if beginning else F.lower(x) == low)
    elif field.kind == "exact":
        found = F.lower(c).startswith(low) if beginning else F.lower(c) == low
    else:
        body = re.sub(r"\s+", " ", re.sub(r"([^\w\s])", r"\\\1", low))
        found = F.lower(c).rlike(f"(^|{EDGE}){body}" + ("" if beginning else f"({EDGE}|$)"))
    return F.coalesce(found, F.lit(False))


def month_range(column: str, date_from: str | None = None, date_to: str | None = None) -> Column:
    """Submission months between two dates, either of them open; days within a month do not count."""
    month = F.date_format(column, "yyyyMM")
    found = F.lit(True)
    if date_from:
        found = found & (month >= date_from.replace("-", "")[:6])
    if date_to:
        found = found & (month <= date_to.replace("-", "")[:6])
    return found


def any_category(column: str, categories: list[str] | None) -> Column:
    return F.arrays_overlap(column, F.array(*map(F.lit, categories))) if categories else F.lit(True)
