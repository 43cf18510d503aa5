"""Declared metadata fields: types, what operations they allow, and strict coercion of request values."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from enum import Enum
from typing import Any

from pyspark.sql import types as T


class BadQuery(ValueError):
    """The request can't be answered as it is."""


class BadConfig(ValueError):
    """The project or its wiring is wrong."""


class FieldType(str, Enum):
    STRING = "string"
    BOOL = "bool"
    INT = "int"
    FLOAT = "float"
    DATE = "date"
    LIST = "list"


SPARK_TYPES = {FieldType.STRING: T.StringType(), FieldType.BOOL: T.BooleanType(), FieldType.INT: T.LongType(), FieldType.FLOAT: T.DoubleType(), FieldType.DATE: T.DateType()}
OPERATIONS = {
    FieldType.STRING: {"equality", "contains"},
    FieldType.DATE: {"equality", "range"},
    FieldType.INT: {"equality", "range"},
    FieldType.FLOAT: {"equality", "range"},
    FieldType.BOOL: {"equality"},
    FieldType.LIST: {"contains"},
}
ISO_DAY = re.compile(r"\d{4}-\d{2}-\d{2}")


@dataclass(frozen=True)
class FieldDef:
    name: str
    type: FieldType
    item_type: FieldType | None = None
    required: bool = False

    def __post_init__(self):
        if not self.name.strip():
            raise BadConfig("a field needs a name")
        if self.type is FieldType.LIST:
            if self.item_type is None or self.item_type is FieldType.LIST:
                raise BadConfig(f"{self.name}: a list needs a scalar item_type")
        elif self.item_type is not None:
            raise BadConfig(f"{self.name}: only a list has an item_type")

    @property
    def spark(self) -> T.DataType:
        return T.ArrayType(SPARK_TYPES[self.item_type]) if self.type is FieldType.LIST else SPARK_TYPES[self.type]

    @property
    def scalar(self) -> FieldType:
        return self.item_type or self.type


def schema_of(fields: list[FieldDef]) -> T.StructType:
    names = [f.name for f in fields]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise BadConfig(f"declared more than once: {twice}")
    return T.StructType([T.StructField(f.name, f.spark, nullable=True) for f in fields])


def coerce(value: Any, kind: FieldType) -> Any:
    """The value as ``kind``, without any conversion but int to float and ISO day to date; None stays None."""
    if value is None:
        return None
    good = {
        FieldType.STRING: lambda: isinstance(value, str),
        FieldType.BOOL: lambda: isinstance(value, bool),
        FieldType.INT: lambda: isinstance(value, int) and not isinstance(value, bool),
        FieldType.FLOAT: lambda: isinstance(value, (int, float)) and not isinstance(value, bool),
        FieldType.DATE: lambda: isinstance(value, dt.date) and not isinstance(value, dt.datetime) or isinstance(value, str) and ISO_DAY.fullmatch(value) is not None,
    }[kind]()
    if not good:
        raise BadQuery(f"{value!r} is not of type {kind.value}")
    if kind is FieldType.FLOAT:
        return float(value)
    if kind is FieldType.DATE and isinstance(value, str):
        try:
            return dt.date.fromisoformat(value)
        except ValueError as e:
            raise BadQuery(f"{value!r} is not a calendar day") from e
    return value
