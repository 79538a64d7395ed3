"""Symbolic expressions: atoms with exact widths, symbols, spans and nested expressions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any


class Int8(int):
    """An 8-bit integer atom."""


class Int32(int):
    """A 32-bit integer atom; plain Python integers of that size become one."""


class Int64(int):
    """A 64-bit integer atom."""


class Float32(float):
    """A single-precision atom; plain Python floats are double."""


class Symbol(str):
    """A name; what it stands for depends on where it is used. Differs from a string of the same letters."""

    __slots__ = ()

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Symbol) and str.__eq__(self, other)

    def __ne__(self, other: object) -> bool:
        return not self == other

    def __hash__(self) -> int:
        return hash(("symbol", str(self)))

    def __repr__(self) -> str:
        return str(self)

    def __add__(self, other: Any) -> Expr:  # type: ignore[override]
        return Expr("Plus", self, other)

    def __mul__(self, other: Any) -> Expr:  # type: ignore[override]
        return Expr("Times", self, other)

    def __sub__(self, other: Any) -> Expr:
        return Expr("Minus", self, other)

    def __gt__(self, other: Any) -> Expr:  # type: ignore[override]
        return Expr("Greater", self, other)

    def __call__(self, *args: Any) -> Expr:
        return Expr(self, *args)


LIMITS = {Int8: 1 << 7, Int32: 1 << 31, Int64: 1 << 63}
#: The numbers by which the kernel's C interface knows the types.
TYPE_IDS = {bool: 0, Int8: 1, Int32: 2, Int64: 3, Float32: 4, float: 5, str: 6, Symbol: 7}
TYPE_NAMES = {bool: "bool", Int8: "int8", Int32: "int32", Int64: "int64", Float32: "float", float: "double", str: "string", Symbol: "symbol"}


class Span:
    """A typed run of values held together: the columnar way to give arguments. Reads as its elements wherever it stands."""

    __slots__ = ("kind", "values")

    def __init__(self, values: Iterable[Any], kind: type | None = None):
        if hasattr(values, "dtype"):  # numpy and pandas
            kind = kind or {"int8": Int8, "int32": Int32, "int64": Int64, "float32": Float32, "float64": float, "bool": bool}.get(str(values.dtype))
            values = values.tolist()
        elif hasattr(values, "to_pylist"):  # Arrow
            kind = kind or {"int8": Int8, "int32": Int32, "int64": Int64, "float": Float32, "double": float, "bool": bool, "string": str}.get(str(values.type))
            values = values.to_pylist()
        self.values = [atom(v, kind) for v in values]
        self.kind = kind or (type(self.values[0]) if self.values else None)
        if any(type(v) is not self.kind for v in self.values):
            raise TypeError("a span holds values of one type")

    def __len__(self) -> int:
        return len(self.values)

    def __iter__(self) -> Iterator[Any]:
        return iter(self.values)

    def subspan(self, offset: int, size: int | None = None) -> Span:
        end = len(self) if size is None else offset + size
        if not 0 <= offset <= end <= len(self):
            raise IndexError("subspan out of range")
        return Span(self.values[offset:end], self.kind)


def atom(value: Any, kind: type | None = None) -> Any:
    """A value as an atom; kind forces a width."""
    if isinstance(value, (Expr, Span, Symbol)) and kind is None:
        return value
    if kind is not None and kind in (Int8, Int32, Int64):
        out = kind(value)
        if not -LIMITS[kind] <= out < LIMITS[kind]:
            raise OverflowError(f"{value} is out of range for {TYPE_NAMES[kind]}")
        return out
    if kind is not None:
        return kind(value)
    if isinstance(value, bool) or type(value) in TYPE_IDS:
        return value
    if isinstance(value, int):
        return atom(value, Int32 if -LIMITS[Int32] <= value < LIMITS[Int32] else Int64)
    if isinstance(value, (float, str)):
        return value
    if getattr(value, "ndim", 0) or hasattr(value, "to_pylist"):
        return Span(value)
    if hasattr(value, "item"):
        return atom(value.item())
    raise TypeError(f"{type(value).__name__} is no atom")


class Expr:
    """A head with arguments. Equal if heads and arguments are, spans counting as their elements and widths as part of a value."""

    __slots__ = ("args", "head")

    def __init__(self, head: str, *args: Any):
        self.head = Symbol(head)
        self.args = tuple(a if isinstance(a, (Expr, Span)) else atom(a) for a in args)

    def arguments(self) -> list[Any]:
        """All arguments, spans as their elements."""
        out: list[Any] = []
        for a in self.args:
            out.extend(a) if isinstance(a, Span) else out.append(a)
        return out

    def __eq__(self, other: object) -> bool:
        if not isinstance(other, Expr) or self.head != other.head:
            return False
        a, b = self.arguments(), other.arguments()
        return len(a) == len(b) and all(map(same, a, b))

    def __hash__(self) -> int:
        return hash((self.head, len(self.arguments())))

    def __repr__(self) -> str:
        return to_text(self)


def same(a: Any, b: Any) -> bool:
    """Equality that minds the type: 5 in 32 bits isn't 5 in 64."""
    if isinstance(a, Expr) or isinstance(b, Expr):
        return isinstance(a, Expr) and a == b
    return type(a) is type(b) and a == b


def to_text(x: Any) -> str:
    """The compact form: strings in double quotes without escapes, truth values as True and False."""
    if isinstance(x, Expr):
        return "(" + " ".join([str(x.head), *map(to_text, x.arguments())]) + ")"
    if isinstance(x, Symbol):
        return str(x)
    if isinstance(x, bool):
        return "True" if x else "False"
    if isinstance(x, str):
        return f'"{x}"'
    return float.__repr__(x) if isinstance(x, float) else int.__repr__(x)


def build(head: str):
    """A constructor of expressions with the head: build("Plus")(1, 2)."""
    return lambda *args: Expr(head, *args)
