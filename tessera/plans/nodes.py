"""Statements and expressions as the parser gives them."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Name:
    column: str
    table: str | None = None

    def __str__(self) -> str:
        return f"{self.table}.{self.column}" if self.table else self.column


@dataclass(frozen=True)
class Literal:
    text: str | None  # None: NULL
    quoted: bool = False


@dataclass(frozen=True)
class Compare:
    op: str  # = <> < <= > >=
    left: object
    right: object


@dataclass(frozen=True)
class Logic:
    op: str  # AND OR
    left: object
    right: object


@dataclass(frozen=True)
class Not:
    inner: object


@dataclass(frozen=True)
class IsNull:
    inner: object


@dataclass(frozen=True)
class Like:
    inner: object
    pattern: str


@dataclass(frozen=True)
class Call:
    function: str  # COUNT SUM AVG MIN MAX ROUND
    argument: object | None  # None: *
    distinct: bool = False
    digits: int = 0


@dataclass(frozen=True)
class Arithmetic:
    op: str  # + - * /
    left: object
    right: object


@dataclass(frozen=True)
class Case:
    branches: tuple[tuple[object, object], ...]  # condition, value
    otherwise: object | None = None


@dataclass(frozen=True)
class InQuery:
    inner: object
    query: object


@dataclass(frozen=True)
class Exists:
    query: object


@dataclass(frozen=True)
class Scalar:
    query: object


@dataclass(frozen=True)
class Item:
    value: object | None  # None: *
    alias: str | None = None


@dataclass(frozen=True)
class Source:
    table: object  # a name or a query
    alias: str
    on: object | None = None  # condition of the join with what stands before it
    cross: bool = True
    kind: str = "inner"  # of a join with a condition: inner, left, right or full


@dataclass(frozen=True)
class Select:
    items: list[Item]
    sources: list[Source]
    where: object | None = None
    group: list[Name] = field(default_factory=list)
    having: object | None = None
    order: list[tuple[Name, bool]] = field(default_factory=list)  # name, descending
    limit: int | None = None
    distinct: bool = False
    offset: int = 0


@dataclass(frozen=True)
class Combined:
    """Queries of equal width, from the left: the first one, then (UNION | INTERSECT | EXCEPT, whether ALL, query)."""

    first: Select
    rest: tuple[tuple[str, bool, Select], ...]
    order: list[tuple[Name, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0


@dataclass(frozen=True)
class With:
    """A query and the queries that it may name as tables, each of which may name those before it."""

    tables: tuple[tuple[str, object], ...]
    query: object


@dataclass(frozen=True)
class Create:
    table: str
    columns: list[tuple[str, str]]  # name, type
    query: object | None = None  # CREATE TABLE ... AS


@dataclass(frozen=True)
class Drop:
    table: str


@dataclass(frozen=True)
class Insert:
    table: str
    rows: list[list[Literal]]
    columns: list[str] | None = None
    query: object | None = None  # INSERT ... SELECT


@dataclass(frozen=True)
class Update:
    table: str
    values: list[tuple[str, Literal]]
    where: object | None = None


@dataclass(frozen=True)
class Delete:
    table: str
    where: object | None = None


@dataclass(frozen=True)
class Begin:
    isolation: str = "READ COMMITTED"


@dataclass(frozen=True)
class Commit:
    pass


@dataclass(frozen=True)
class Abort:
    pass
