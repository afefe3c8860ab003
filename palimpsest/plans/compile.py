"""Compiles filter expressions to Spark columns with three-valued logic.

Unknown is SQL NULL, so AND, OR and NOT are Spark's own and `where` keeps just
the rows that are true. Reserved names are typed columns of a row; every other
name is a path through the JSON objects in its `metadata` string, read as a
VARIANT so that JSON types are told apart.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from palimpsest.plans.expr import (
    Always, And, Cmp, Contains, EndsWith, Exists, Expr, Glob, In, IsNull, Never, Not, Or, StartsWith, Ts, Value,
)

INT, NUM, STR, TIME = "int", "num", "str", "time"
#: Reserved names, their types, and whether they may be missing.
RESERVED = {
    "rowid": (INT, False),
    "key": (STR, True),
    "created_at": (TIME, False),
    "expires_at": (TIME, True),
    "importance": (NUM, False),
    "confidence": (NUM, False),
    "valid_from": (TIME, False),
    "valid_to": (TIME, True),
    "last_access": (TIME, True),
    "access_count": (INT, False),
    "__ns": (STR, False),
}
COLUMN_NAMES = {"__ns": "ns"}


def _unknown() -> Column:
    return F.lit(None).cast("boolean")


def _ordered(op: str, left: Column, right: Column) -> Column:
    return {
        "==": lambda: left == right,
        "!=": lambda: left != right,
        ">": lambda: left > right,
        ">=": lambda: left >= right,
        "<": lambda: left < right,
        "<=": lambda: left <= right,
    }[op]()


def _is_number(value: Value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def glob_regex(pattern: str) -> str:
    """A Java regex for the whole string: * is any run, ? one code point, the rest literal."""
    parts = re.split(r"([*?])", pattern)
    quoted = (".*" if p == "*" else "." if p == "?" else re.sub(r"([^\w\s])", r"\\\1", p, flags=re.ASCII) for p in parts)
    return r"(?s)\A" + "".join(quoted) + r"\z"


@dataclass(frozen=True)
class _Typed:
    """A reserved field."""

    column: Column
    kind: str

    def present(self) -> Column:
        return self.column.isNotNull()

    def json_null(self) -> Column:
        return F.lit(False)

    def scalar(self) -> Column:
        return self.column.isNotNull()

    def compare(self, op: str, value: Value) -> Column:
        if self.kind == TIME:
            return _ordered(op, self.column, F.lit(value.ms)) if isinstance(value, Ts) else _unknown()
        if self.kind == STR:
            return _ordered(op, self.column, F.lit(value)) if isinstance(value, str) else _unknown()
        if not _is_number(value):
            return _unknown()
        if self.kind == NUM:
            return _ordered(op, self.column.cast("double"), F.lit(float(value)))
        return _ordered(op, self.column, F.lit(value)) if isinstance(value, int) else _ordered(op, self.column.cast("double"), F.lit(value))

    def text(self) -> Column:
        return self.column if self.kind == STR else F.lit(None).cast("string")

    def contains(self, value: Value) -> Column:
        return F.contains(self.text(), F.lit(value)) if isinstance(value, str) else _unknown()


@dataclass(frozen=True)
class _Json:
    """A value inside the metadata: `variant` is NULL where the path is missing."""

    variant: Column

    @property
    def type(self) -> Column:
        return F.schema_of_variant(self.variant)

    def _is(self, *kinds: str) -> Column:
        found = F.lit(False)
        for kind in kinds:
            found = found | F.startswith(self.type, F.lit(kind))
        return found

    def get(self, kind: str) -> Column:
        return F.try_variant_get(self.variant, "$", kind)

    def present(self) -> Column:
        return self.variant.isNotNull()

    def json_null(self) -> Column:
        return F.coalesce(F.is_variant_null(self.variant), F.lit(False))

    def scalar(self) -> Column:
        return F.coalesce(self._is("BOOLEAN", "BIGINT", "DECIMAL", "DOUBLE", "STRING"), F.lit(False))

    def compare(self, op: str, value: Value) -> Column:
        if isinstance(value, Ts):
            return _unknown()
        if isinstance(value, bool):
            return F.when(self._is("BOOLEAN"), _ordered(op, self.get("boolean"), F.lit(value)))
        if isinstance(value, str):
            return F.when(self._is("STRING"), _ordered(op, self.get("string"), F.lit(value)))
        real = _ordered(op, self.get("double"), F.lit(float(value)))
        if isinstance(value, int):
            return F.when(self._is("BIGINT"), _ordered(op, self.get("bigint"), F.lit(value))).when(self._is("DECIMAL", "DOUBLE"), real)
        return F.when(self._is("BIGINT", "DECIMAL", "DOUBLE"), real)

    def text(self) -> Column:
        return F.when(self._is("STRING"), self.get("string"))

    def contains(self, value: Value) -> Column:
        elements = self.get("array<variant>")
        found = F.exists(elements, lambda x: F.coalesce(_Json(x).compare("==", value), F.lit(False)))
        listed = F.when(self._is("ARRAY"), F.coalesce(found, F.lit(False)))
        return listed.otherwise(F.contains(self.text(), F.lit(value))) if isinstance(value, str) else listed


class Compiler:
    """Turns expressions into columns over a frame with the reserved columns and `metadata`.

    `names` maps reserved names to other columns or expressions; `metadata` is
    the JSON column.
    """

    def __init__(self, metadata: str | Column = "metadata", names: dict[str, str | Column] | None = None) -> None:
        column = F.col(metadata) if isinstance(metadata, str) else metadata
        self.variant = F.try_parse_json(column)
        self.names = {n: COLUMN_NAMES.get(n, n) for n in RESERVED} | (names or {})

    def field(self, name: str) -> _Typed | _Json:
        if name in RESERVED:
            column = self.names[name]
            column = F.col(column) if isinstance(column, str) else column
            if name == "access_count":
                column = F.coalesce(column, F.lit(0))
            return _Typed(column, RESERVED[name][0])
        path = "$" + "".join(f"['{part}']" for part in name.split("."))
        return _Json(F.try_variant_get(self.variant, path, "variant"))

    def compile(self, node: Expr) -> Column:
        if isinstance(node, (Always, Never)):
            return F.lit(isinstance(node, Always))
        if isinstance(node, (And, Or)):
            found = F.lit(isinstance(node, And))
            for i, part in enumerate(node.parts):
                column = self.compile(part)
                found = column if not i else found & column if isinstance(node, And) else found | column
            return found
        if isinstance(node, Not):
            return ~self.compile(node.part)
        field = self.field(node.field)
        if isinstance(node, Cmp):
            return field.compare(node.op, node.value)
        if isinstance(node, In):
            any_equal = F.lit(False)
            for value in node.values:
                any_equal = any_equal | F.coalesce(field.compare("==", value), F.lit(False))
            return F.when(field.scalar(), any_equal)
        if isinstance(node, Contains):
            return field.contains(node.value)
        if isinstance(node, StartsWith):
            return F.startswith(field.text(), F.lit(node.text))
        if isinstance(node, EndsWith):
            return F.endswith(field.text(), F.lit(node.text))
        if isinstance(node, Glob):
            return field.text().rlike(glob_regex(node.text))
        if isinstance(node, Exists):
            return field.present()
        if isinstance(node, IsNull):
            return field.json_null()
        raise TypeError(f"not a filter: {node!r}")


def compile_filter(node: Expr | None, metadata: str | Column = "metadata", names: dict[str, str | Column] | None = None) -> Column:
    """The column that is true for just the rows that match; no filter matches all."""
    return F.lit(True) if node is None else Compiler(metadata, names).compile(node)
