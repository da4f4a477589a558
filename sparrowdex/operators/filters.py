"""Structured filters: validation with clear messages, and compilation to predicates that reach the scan."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = ("eq", "in", "not", "not_in", "range")


@dataclass(frozen=True)
class Fields:
    """Kinds of the fields of an index."""

    faceted: frozenset = frozenset({"lang", "source"})
    long: frozenset = frozenset({"n_chars"})
    date: frozenset = frozenset()
    string: frozenset = frozenset({"doc_id"})
    analyzed: frozenset = frozenset({"text"})

    @property
    def known(self) -> frozenset:
        return self.faceted | self.long | self.date | self.string


@dataclass(frozen=True)
class Filter:
    field: str
    operator: str = "eq"
    value: object = None
    values: tuple = field(default_factory=tuple)
    low: object = None
    high: object = None


def parse_date(text: str) -> datetime:
    """An ISO instant, a local date and time (UTC) or a date (midnight UTC)."""
    for form in (str(text).replace("Z", "+00:00"), f"{text}T00:00:00"):
        try:
            d = datetime.fromisoformat(form)
            return d if d.tzinfo is None else d.astimezone(UTC).replace(tzinfo=None)
        except ValueError:
            continue
    raise ValueError(f"Invalid date '{text}': use ISO-8601, for example 2024-01-15 or 2024-01-15T10:30:00Z")


def parse_long(name: str, text) -> int:
    try:
        return int(text)
    except (TypeError, ValueError):
        raise ValueError(f"Invalid number '{text}' for field '{name}'") from None


def validate(f: Filter, fields: Fields = Fields()) -> None:
    if not f.field or not str(f.field).strip():
        raise ValueError("Filter field is required")
    if f.operator not in OPERATORS:
        raise ValueError(f"Unknown filter operator '{f.operator}': use one of {', '.join(OPERATORS)}")
    if f.field in fields.analyzed:
        raise ValueError(f"Field '{f.field}' is analysed text and cannot be filtered: use the query")
    if f.operator in ("eq", "not") and f.value is None:
        raise ValueError(f"Operator '{f.operator}' on '{f.field}' needs a value")
    if f.operator in ("in", "not_in") and not f.values:
        raise ValueError(f"Operator '{f.operator}' on '{f.field}' needs values")
    if f.operator == "range":
        if f.field not in fields.long | fields.date:
            raise ValueError(f"Operator 'range' needs a numeric or date field, not '{f.field}'")
        if f.low is None and f.high is None:
            raise ValueError(f"Operator 'range' on '{f.field}' needs from or to")


def _typed(f: Filter, v, fields: Fields):
    if f.field in fields.date:
        return parse_date(v)
    return parse_long(f.field, v) if f.field in fields.long else v


def predicate(f: Filter, fields: Fields = Fields()) -> Column:
    """The filter as a predicate. Negations keep rows that lack the field."""
    validate(f, fields)
    c = F.col(f.field)
    if f.operator == "eq":
        return c == F.lit(_typed(f, f.value, fields))
    if f.operator == "in":
        return c.isin(*[_typed(f, v, fields) for v in f.values])
    if f.operator in ("not", "not_in"):
        values = f.values if f.operator == "not_in" else (f.value,)
        return c.isNull() | ~c.isin(*[_typed(f, v, fields) for v in values])
    parts = []
    if f.low is not None:
        parts.append(c >= F.lit(_typed(f, f.low, fields)))
    if f.high is not None:
        parts.append(c <= F.lit(_typed(f, f.high, fields)))
    return reduce(lambda a, b: a & b, parts)


def split(filters: list[Filter], fields: Fields = Fields()) -> tuple[dict[str, Column], list[Column]]:
    """Drill-down predicates by dimension (positive filters on faceted fields: OR inside a dimension) and the base predicates (AND)."""
    dims: dict[str, Column] = {}
    base = []
    for f in filters:
        p = predicate(f, fields)
        if f.operator in ("eq", "in") and f.field in fields.faceted:
            dims[f.field] = dims[f.field] | p if f.field in dims else p
        else:
            base.append(p)
    return dims, base


def combined(filters: list[Filter], fields: Fields = Fields()) -> Column:
    dims, base = split(filters, fields)
    return reduce(lambda a, b: a & b, [*dims.values(), *base], F.lit(True))
