"""Filters: from a field and request parameters to one Column.

Empty parameters (None, an empty list, an empty mapping) don't filter. A
missing value never matches a filter that is not empty, but for equality with
None in its list, which asks for missing values. Values of one field are
alternatives; fields hold together.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import fold, fold_text
from siltstone.operators.fields import OPERATIONS, BadConfig, BadQuery, FieldDef, FieldType, coerce


def many(params: Any) -> list:
    """A scalar as a list of one, None as none."""
    if params is None:
        return []
    return list(params) if isinstance(params, (list, tuple, set, frozenset)) else [params]


class FieldFilter:
    """Base of all filters; subclasses name their operation and build the predicate."""

    operation = ""

    def __init__(self, field: FieldDef):
        if self.operation not in OPERATIONS[field.type]:
            raise BadConfig(f"{field.name}: {self.operation} is not for type {field.type.value}")
        self.field = field

    def predicate(self, params: Any) -> Column | None:
        """None where the parameters don't filter."""
        raise NotImplementedError

    def values(self, params: Any) -> list:
        return [coerce(v, self.field.scalar) for v in many(params)]


_registry: dict[str, type[FieldFilter]] = {}


def register_filter(operation: str) -> Callable[[type[FieldFilter]], type[FieldFilter]]:
    def put(cls: type[FieldFilter]) -> type[FieldFilter]:
        if cls.operation != operation:
            raise ValueError(f"{cls.__name__} is for {cls.operation!r}, not {operation!r}")
        if operation in _registry and _registry[operation] is not cls:
            raise ValueError(f"{operation!r} is registered already")
        _registry[operation] = cls
        return cls

    return put


def filter_class(operation: str) -> type[FieldFilter]:
    try:
        return _registry[operation]
    except KeyError:
        raise BadConfig(f"no filter {operation!r}; there are {sorted(_registry)}") from None


@register_filter("equality")
class Equality(FieldFilter):
    operation = "equality"

    def predicate(self, params):
        values = self.values(params)
        if not values:
            return None
        c = F.col(self.field.name)
        there = [v for v in values if v is not None]
        found = c.isin(there) if there else F.lit(False)
        return found | c.isNull() if None in values else found  # a bare IN reaches the scan


@register_filter("range")
class Range(FieldFilter):
    operation = "range"

    def predicate(self, params):
        if not params:
            return None
        if not isinstance(params, Mapping):
            raise BadQuery(f"{self.field.name}: a range is given as min and max")
        low, high = (coerce(params.get(k), self.field.scalar) for k in ("min", "max"))
        if low is not None and high is not None and low > high:
            raise BadQuery(f"{self.field.name}: min {low} is over max {high}")
        c, tests = F.col(self.field.name), []
        if low is not None:
            tests.append(c >= low if params.get("min_inclusive", True) else c > low)
        if high is not None:
            tests.append(c <= high if params.get("max_inclusive", True) else c < high)
        if not tests:
            return None
        inside = reduce(and_, tests)
        # NaN is outside no bound; Spark would call it the largest number
        return inside | F.isnan(c) if self.field.type is FieldType.FLOAT else inside


@register_filter("contains")
class Contains(FieldFilter):
    """Any needle is a substring of the text, or an item of the list, without regard to case."""

    operation = "contains"

    def predicate(self, params):
        wanted = many(params)
        if not wanted:
            return None
        c = F.col(self.field.name)
        if self.field.type is FieldType.LIST:
            if any(v is None for v in wanted):
                raise BadQuery(f"{self.field.name}: null is no list item to look for")
            values = self.values(wanted)
            if self.field.item_type is FieldType.STRING:
                return F.arrays_overlap(F.transform(c, F.lower), F.array(*[F.lit(v.lower()) for v in values]))
            return F.arrays_overlap(c, F.array(*[F.lit(v) for v in values]).cast(self.field.spark))
        needles = [str(v).lower() for v in wanted]
        return reduce(or_, [F.contains(F.lower(c), F.lit(n)) for n in needles])


class FoldedEquality(Equality):
    """Equality of case-folded text: an override for a string field."""

    def predicate(self, params):
        values = [fold_text(str(v)) for v in many(params) if v is not None]
        return fold(F.col(self.field.name).cast("string")).isin(values) if values else None


def build_filters(fields: dict[str, tuple[FieldDef, str]], overrides: dict[str, type[FieldFilter]] | None = None) -> dict[str, FieldFilter]:
    """The filter of each field; an override must be of the operation that the field declares."""
    overrides = overrides or {}
    stray = sorted(set(overrides) - set(fields))
    if stray:
        raise BadConfig(f"override of unknown fields {stray}")
    out = {}
    for name, (field, operation) in fields.items():
        cls = overrides.get(name) or filter_class(operation)
        if cls.operation != operation:
            raise BadConfig(f"{name}: the override is for {cls.operation}, the field declares {operation}")
        out[name] = cls(field)
    return out


def apply_filters(docs: DataFrame, filters: dict[str, FieldFilter], request: Mapping[str, Any]) -> DataFrame:
    """docs that satisfy every field of the request, as one conjunction, so that it can reach the scan."""
    tests = []
    for name, params in request.items():
        if name not in filters:
            raise BadQuery(f"unknown filter {name!r}; there are {sorted(filters)}")
        test = filters[name].predicate(params)
        if test is not None:
            tests.append(test)
    return docs.where(reduce(and_, tests)) if tests else docs
