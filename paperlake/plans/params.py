"""Parameter contracts, checked before any plan is built."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def check_text(name: str, value: str, low: int, high: int | None) -> str:
    if not isinstance(value, str) or len(value) < low or (high is not None and len(value) > high):
        raise ValueError(f"{name} must have {low} to {high or 'any number of'} characters")
    return value


def check_int(name: str, value: int, low: int, high: int | None = None) -> int:
    if not isinstance(value, int) or isinstance(value, bool) or value < low or (high is not None and value > high):
        raise ValueError(f"{name} must be a whole number from {low} to {'any' if high is None else high}")
    return value


def check_choice(name: str, value: str, choices: tuple[str, ...]) -> str:
    if value not in choices:
        raise ValueError(f"{name} must be one of {', '.join(choices)}")
    return value


def check_date(name: str, value: str | None) -> str | None:
    if value is not None and not re.fullmatch(r"\d{4}-\d{2}(-\d{2})?", value):
        raise ValueError(f"{name} must be YYYY-MM or YYYY-MM-DD")
    return value


SORTS = ("score desc", "citation_count desc", "date desc", "date asc", "read_count desc")
#: Columns that the sort names of preprints stand for.
PREPRINT_SORTS = {"relevance": "score", "lastUpdatedDate": "updated", "submittedDate": "date"}


def ordered(column: str, descending: bool, tie: str) -> list[Column]:
    """Order by a column, nulls last, ties by ``tie``."""
    return [F.desc_nulls_last(column) if descending else F.asc_nulls_last(column), F.asc(tie)]


@dataclass(frozen=True)
class SearchParams:
    """``query`` names the search; its conditions are Columns (``operators.boolean``)."""

    query: str
    rows: int = 10
    start: int = 0
    sort: str = "score desc"

    def __post_init__(self) -> None:
        check_text("query", self.query, 1, 1000)
        check_int("rows", self.rows, 1, 50)
        check_int("start", self.start, 0)
        check_choice("sort", self.sort, SORTS)

    def order(self, tie: str = "id") -> list[Column]:
        column, direction = self.sort.split()
        return ordered(column, direction == "desc", tie)


@dataclass(frozen=True)
class DocSearchParams:
    query: str
    limit: int = 5

    def __post_init__(self) -> None:
        check_text("query", self.query, 1, 500)
        check_int("limit", self.limit, 1, 20)


@dataclass(frozen=True)
class CitationParams:
    """Identifiers of any length are taken, so that DOIs work."""

    paper_id: str
    rows: int = 20
    relationship: str = "citations"

    def __post_init__(self) -> None:
        check_text("paper_id", self.paper_id, 1, None)
        check_int("rows", self.rows, 1, 50)
        check_choice("relationship", self.relationship, ("citations", "references"))


@dataclass(frozen=True)
class PreprintSearchParams:
    query: str
    max_results: int = 10
    sort_by: str = "relevance"
    sort_order: str = "descending"
    date_from: str | None = None
    date_to: str | None = None
    categories: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        check_text("query", self.query, 1, 500)
        check_int("max_results", self.max_results, 1, 50)
        check_choice("sort_by", self.sort_by, tuple(PREPRINT_SORTS))
        check_choice("sort_order", self.sort_order, ("descending", "ascending"))
        check_date("date_from", self.date_from)
        check_date("date_to", self.date_to)

    def order(self, tie: str = "id") -> list[Column]:
        return ordered(PREPRINT_SORTS[self.sort_by], self.sort_order == "descending", tie)


@dataclass(frozen=True)
class WindowParams:
    offset: int = 0
    max_chars: int = 12_000

    def __post_init__(self) -> None:
        check_int("offset", self.offset, 0)
        check_int("max_chars", self.max_chars, 1000, 50_000)


@dataclass(frozen=True)
class LibraryParams:
    name: str
    description: str | None = None
    public: bool = False

    def __post_init__(self) -> None:
        check_text("name", self.name, 1, 255)
        if self.description is not None:
            check_text("description", self.description, 0, 1000)


def check_papers(name: str, ids: list[str], most: int) -> list[str]:
    """Metrics take up to 100 papers, exports and library edits up to 2,000."""
    check_int(f"number of {name}", len(ids), 1, most)
    for i in ids:
        check_text(name, i, 1, None)
    return ids
