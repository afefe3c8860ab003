"""Filter expressions: nodes, a builder, text and JSON forms.

A filter is a tree of small immutable nodes. `str(node)` prints what
`palimpsest.plans.parser.parse` reads back as an equal tree; `to_json` and
`from_json` do the same for plain JSON values.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from palimpsest.errors import FilterParse

#: Milliseconds that print as a four-digit year: 0000-01-01 to 9999-12-31.
MIN_TS, MAX_TS = -62_167_219_200_000, 253_402_300_799_999
INT_MIN, INT_MAX = -(2**63), 2**63 - 1


@dataclass(frozen=True)
class Ts:
    """A point in time; compares only with time-typed fields."""

    ms: int


Value = bool | int | float | str | Ts

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
#: 400 Gregorian years, for the year 0000 that datetime lacks.
_CYCLE_MS = 146_097 * 86_400_000


def format_ts(ms: int) -> str:
    back = ms < MIN_TS + 366 * 86_400_000
    when = _EPOCH + timedelta(milliseconds=ms + (_CYCLE_MS if back else 0))
    year = when.year - (400 if back else 0)
    return f"{year:04d}-{when:%m-%dT%H:%M:%S}.{when.microsecond // 1000:03d}Z"


def quote(text: str) -> str:
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        text = text.replace(plain, escaped)
    return f'"{text}"'


def format_value(value: Value) -> str:
    if isinstance(value, Ts):
        return f'ts"{format_ts(value.ms)}"'
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return quote(value)
    return repr(value)


_JSON_TYPES = {"bool": bool, "int": int, "num": float, "str": str, "ts": Ts}


def value_to_json(value: Value) -> dict:
    if isinstance(value, Ts):
        return {"ts": value.ms}
    return {next(n for n, t in _JSON_TYPES.items() if type(value) is t): value}


def value_from_json(data: object) -> Value:
    name, value = _only(data)
    whole = isinstance(value, int) and not isinstance(value, bool)
    if name == "ts" and whole and MIN_TS <= value <= MAX_TS:
        return Ts(value)
    if name == "num" and (whole or isinstance(value, float)) and math.isfinite(value):
        return float(value)
    if name == "int" and whole and INT_MIN <= value <= INT_MAX:
        return value
    if name in ("bool", "str") and isinstance(value, _JSON_TYPES[name]):
        return value
    raise FilterParse(f"not a value: {data!r}")


def _only(data: object) -> tuple[str, object]:
    if not isinstance(data, dict) or len(data) != 1:
        raise FilterParse("expected an object with one key")
    return next(iter(data.items()))


class Expr:
    """Base of all nodes; `&`, `|` and `~` combine them."""

    #: How tightly a node binds in text: or 1, and 2, not 3, others 4.
    binding = 4

    def __and__(self, other: Expr) -> Expr:
        return And(_flat(And, self) + _flat(And, other))

    def __or__(self, other: Expr) -> Expr:
        return Or(_flat(Or, self) + _flat(Or, other))

    def __invert__(self) -> Expr:
        return Not(self)

    def fields(self) -> set[str]:
        """Names of all fields that the expression reads."""
        return set()

    @property
    def uses_access(self) -> bool:
        return bool(self.fields() & {"last_access", "access_count"})

    def within(self, binding: int) -> str:
        return f"({self})" if self.binding < binding else str(self)

    def to_json(self) -> dict:
        raise NotImplementedError


def _flat(kind: type, node: Expr) -> tuple[Expr, ...]:
    return node.parts if isinstance(node, kind) else (node,)


@dataclass(frozen=True)
class Always(Expr):
    def __str__(self) -> str:
        return "always"

    def to_json(self) -> dict:
        return {"always": True}


@dataclass(frozen=True)
class Never(Expr):
    def __str__(self) -> str:
        return "never"

    def to_json(self) -> dict:
        return {"never": True}


@dataclass(frozen=True)
class _Many(Expr):
    parts: tuple[Expr, ...]

    #: Word between parts, and what no parts at all amount to.
    word, empty = "", Always()

    def fields(self) -> set[str]:
        return set().union(*(p.fields() for p in self.parts))

    def __str__(self) -> str:
        return f" {self.word} ".join(p.within(self.binding) for p in self.parts) if self.parts else str(self.empty)

    def to_json(self) -> dict:
        return {self.word: [p.to_json() for p in self.parts]} if self.parts else self.empty.to_json()


@dataclass(frozen=True)
class And(_Many):
    binding, word, empty = 2, "and", Always()

    def __str__(self) -> str:
        return _Many.__str__(self)


@dataclass(frozen=True)
class Or(_Many):
    binding, word, empty = 1, "or", Never()

    def __str__(self) -> str:
        return _Many.__str__(self)


@dataclass(frozen=True)
class Not(Expr):
    part: Expr
    binding = 3

    def fields(self) -> set[str]:
        return self.part.fields()

    def __str__(self) -> str:
        return f"not {self.part.within(3)}"

    def to_json(self) -> dict:
        return {"not": self.part.to_json()}


@dataclass(frozen=True)
class _Field(Expr):
    field: str

    def fields(self) -> set[str]:
        return {self.field}


OPERATORS = {"==": "eq", "!=": "ne", ">": "gt", ">=": "ge", "<": "lt", "<=": "le"}
_BY_NAME = {name: op for op, name in OPERATORS.items()}


@dataclass(frozen=True)
class Cmp(_Field):
    op: str
    value: Value

    def __str__(self) -> str:
        return f"{self.field} {self.op} {format_value(self.value)}"

    def to_json(self) -> dict:
        return {"cmp": {"field": self.field, "op": OPERATORS[self.op], "val": value_to_json(self.value)}}


@dataclass(frozen=True)
class In(_Field):
    values: tuple[Value, ...]

    def __str__(self) -> str:
        return f"{self.field} in ({', '.join(map(format_value, self.values))})" if self.values else "never"

    def to_json(self) -> dict:
        if not self.values:
            return Never().to_json()
        return {"in": {"field": self.field, "vals": [value_to_json(v) for v in self.values]}}


@dataclass(frozen=True)
class Contains(_Field):
    value: Value

    def __str__(self) -> str:
        return f"{self.field} contains {format_value(self.value)}"

    def to_json(self) -> dict:
        return {"contains": {"field": self.field, "val": value_to_json(self.value)}}


@dataclass(frozen=True)
class _Text(_Field):
    text: str

    word, name, key = "", "", ""

    def __str__(self) -> str:
        return f"{self.field} {self.word} {quote(self.text)}"

    def to_json(self) -> dict:
        return {self.name: {"field": self.field, self.key: self.text}}


@dataclass(frozen=True)
class StartsWith(_Text):
    word, name, key = "startswith", "starts_with", "prefix"

    def __str__(self) -> str:
        return _Text.__str__(self)


@dataclass(frozen=True)
class EndsWith(_Text):
    word, name, key = "endswith", "ends_with", "suffix"

    def __str__(self) -> str:
        return _Text.__str__(self)


@dataclass(frozen=True)
class Glob(_Text):
    word, name, key = "~", "glob", "pattern"

    def __str__(self) -> str:
        return _Text.__str__(self)


@dataclass(frozen=True)
class Exists(_Field):
    def __str__(self) -> str:
        return f"exists({self.field})"

    def to_json(self) -> dict:
        return {"exists": {"field": self.field}}


@dataclass(frozen=True)
class IsNull(_Field):
    def __str__(self) -> str:
        return f"is_null({self.field})"

    def to_json(self) -> dict:
        return {"is_null": {"field": self.field}}


def _member(body: object, name: str, kind: type | None = None) -> object:
    if not isinstance(body, dict) or name not in body:
        raise FilterParse(f"missing {name}")
    if kind is not None and not isinstance(body[name], kind):
        raise FilterParse(f"{name} has the wrong type")
    return body[name]


def from_json(data: object) -> Expr:
    """The expression that `to_json` wrote; raises `FilterParse` for anything else."""
    name, body = _only(data)
    if name in ("always", "never"):
        if body is not True:
            raise FilterParse(f"{name} must be true")
        return Always() if name == "always" else Never()
    if name in ("and", "or"):
        if not isinstance(body, list) or not body:
            raise FilterParse(f"{name} needs a list of parts")
        return (And if name == "and" else Or)(tuple(map(from_json, body)))
    if name == "not":
        return Not(from_json(body))
    field = _member(body, "field", str)
    if name == "cmp":
        op = _BY_NAME.get(_member(body, "op", str))
        if op is None:
            raise FilterParse("unknown comparison")
        return Cmp(field, op, value_from_json(_member(body, "val")))
    if name == "in":
        values = _member(body, "vals", list)
        if not values:
            raise FilterParse("vals must not be empty")
        return In(field, tuple(map(value_from_json, values)))
    if name == "contains":
        return Contains(field, value_from_json(_member(body, "val")))
    for kind in (StartsWith, EndsWith, Glob):
        if name == kind.name:
            return kind(field, _member(body, kind.key, str))
    if name in ("exists", "is_null"):
        return (Exists if name == "exists" else IsNull)(field)
    raise FilterParse(f"unknown node {name}")


class field:  # noqa: N801  reads as a word: field("a.b") == 3
    """Builds comparisons of one field: `field("price") > 3`."""

    def __init__(self, name: str) -> None:
        self.name = name

    def __eq__(self, value: Value) -> Expr:  # type: ignore[override]
        return Cmp(self.name, "==", value)

    def __ne__(self, value: Value) -> Expr:  # type: ignore[override]
        return Cmp(self.name, "!=", value)

    def __gt__(self, value: Value) -> Expr:
        return Cmp(self.name, ">", value)

    def __ge__(self, value: Value) -> Expr:
        return Cmp(self.name, ">=", value)

    def __lt__(self, value: Value) -> Expr:
        return Cmp(self.name, "<", value)

    def __le__(self, value: Value) -> Expr:
        return Cmp(self.name, "<=", value)

    __hash__ = None  # type: ignore[assignment]

    def is_in(self, *values: Value) -> Expr:
        # Keyed by type too: True == 1 == 1.0 in Python, but not in a filter.
        return In(self.name, tuple({(type(v), v): v for v in values}.values()))

    def contains(self, value: Value) -> Expr:
        return Contains(self.name, value)

    def startswith(self, text: str) -> Expr:
        return StartsWith(self.name, text)

    def endswith(self, text: str) -> Expr:
        return EndsWith(self.name, text)

    def glob(self, pattern: str) -> Expr:
        return Glob(self.name, pattern)

    def exists(self) -> Expr:
        return Exists(self.name)

    def is_null(self) -> Expr:
        return IsNull(self.name)
