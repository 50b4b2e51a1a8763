"""From parsed expressions and queries to DataFrame expressions.

Every column of a source gets an internal name that holds its alias, so qualified names, self joins and equal
column names need no resolution by Spark. Everything else is left to the optimizer: implicit joins are
cross joins under a filter, which it turns into equi-joins with pushed-down filters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import BindProblem
from tessera.functions.aggregates import aggregate
from tessera.functions.text import OPERATORS, as_number, compare, compare_columns, compare_mixed, is_number, sort_keys
from tessera.plans import nodes as N


class Scope:
    """Columns that names may mean: (alias, column) to internal name and type."""

    def __init__(self, table: Callable[[object], DataFrame] | None = None):
        self.columns: dict[tuple[str, str], tuple[str, T.DataType]] = {}
        self.table = table  # of subqueries

    def add(self, alias: str, df: DataFrame) -> DataFrame:
        if any(a == alias for a, _ in self.columns):
            raise BindProblem(f"two sources are called {alias}")
        if len(set(df.columns)) < len(df.columns):
            raise BindProblem(f"two columns of {alias} have one name")
        renamed = []
        for k, f in enumerate(df.schema.fields):
            inner = f"{alias}/{k}/{f.name}"
            self.columns[alias, f.name] = (inner, f.dataType)
            renamed.append(df[f.name].alias(inner))
        return df.select(*renamed)

    def find(self, name: N.Name) -> tuple[str, T.DataType]:
        hits = [x for (alias, column), x in self.columns.items() if column == name.column and name.table in (None, alias)]
        if len(hits) != 1:
            raise BindProblem(f"column {name} is {'ambiguous' if hits else 'unknown'}")
        return hits[0]

    def column(self, name: N.Name) -> Column:
        return F.col(f"`{self.find(name)[0]}`")


    def subquery(self, query, columns: int | None = 1) -> DataFrame:
        """An uncorrelated subquery's rows; columns: as many as it must have."""
        if self.table is None:
            raise BindProblem("subqueries are not allowed here")
        out = self.table(query)
        if columns and len(out.columns) != columns:
            raise BindProblem(f"a subquery has {len(out.columns)} columns, not {columns}")
        return out


def typed(literal: N.Literal, kind: T.DataType | None) -> Column:
    """A literal as a value of a column's type; None: of a computed number."""
    if literal.text is None:
        return F.lit(None) if kind is None else F.lit(None).cast(kind)
    if kind is None:
        return F.lit(float(literal.text)) if is_number(literal.text) else F.lit(literal.text)
    if isinstance(kind, T.StringType):
        return F.lit(literal.text)
    try:
        if isinstance(kind, T.IntegralType):
            return F.lit(int(literal.text)) if literal.text.lstrip("-").isdigit() else F.lit(float(literal.text))
        if isinstance(kind, T.FractionalType):
            return F.lit(float(literal.text))
    except ValueError:
        raise BindProblem(f"{literal.text!r} is no number") from None
    return F.lit(literal.text).cast(kind)


_FLIPPED = {"=": "=", "<>": "<>", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


def predicate(node, scope: Scope, value: Callable | None = None) -> Column:
    """The condition as a Column; value resolves operands other than literals to (Column, type)."""
    value = value or (lambda x: _operand(x, scope))

    def bind(x) -> Column:
        match x:
            case N.Logic("AND", left, right):
                return bind(left) & bind(right)
            case N.Logic("OR", left, right):
                return bind(left) | bind(right)
            case N.Not(inner):
                return ~bind(inner)
            case N.IsNull(inner):
                return value(inner)[0].isNull()
            case N.Exists(query):
                return scope.subquery(query, None).exists()
            case N.InQuery(inner, query):
                return value(inner)[0].isin(scope.subquery(query))
            case N.Like(inner, pattern):
                return value(inner)[0].cast("string").like(pattern)
            case N.Compare(op, N.Literal() as a, N.Literal() as b):
                return F.lit(None).cast("boolean") if None in (a.text, b.text) else compare(op, F.lit(a.text), b.text)
            case N.Compare(op, N.Literal() as a, b):
                return bind(N.Compare(_FLIPPED[op], b, a))
            case N.Compare(op, a, N.Literal() as b):
                column, kind = value(a)
                if b.text is not None and isinstance(kind, T.StringType):
                    return compare(op, column, b.text)
                return OPERATORS[op](column, typed(b, kind))
            case N.Compare(op, a, b):
                (left, left_kind), (right, right_kind) = value(a), value(b)
                texts = [isinstance(k, T.StringType) for k in (left_kind, right_kind)]
                if all(texts):
                    return compare_columns(op, left, right)
                if any(texts):  # a text with a number: as numbers if the text is one, else as texts
                    return compare_mixed(op, left, right, texts[0])
                return OPERATORS[op](left, right)
        raise BindProblem(f"{x} is no condition")

    return bind(node)


def _operand(x, scope: Scope) -> tuple[Column, T.DataType]:
    if isinstance(x, N.Name):
        return scope.column(x), scope.find(x)[1]
    if isinstance(x, N.Scalar):
        rows = scope.subquery(x.query)
        return rows.scalar(), rows.schema[0].dataType
    if isinstance(x, N.Arithmetic | N.Case | N.Literal) or isinstance(x, N.Call) and x.function == "ROUND":
        return _value(x, lambda y: _operand(y, scope), scope)
    if isinstance(x, N.Call):
        raise BindProblem(f"{x.function} is not allowed here")
    raise BindProblem(f"{x} is no value")


def _has_aggregate(x) -> bool:
    match x:
        case N.Call():
            return x.function != "ROUND" or _has_aggregate(x.argument)
        case N.Arithmetic():
            return _has_aggregate(x.left) or _has_aggregate(x.right)
        case N.Case():
            return any(_has_aggregate(v) for _, v in x.branches) or _has_aggregate(x.otherwise)
    return False


def _label(x) -> str:
    if isinstance(x, N.Call):
        return f"{x.function}({'DISTINCT ' * x.distinct}{'*' if x.argument is None else _label(x.argument)})"
    if isinstance(x, N.Arithmetic):
        return f"{_label(x.left)} {x.op} {_label(x.right)}"
    if isinstance(x, N.Case | N.Scalar):
        return "CASE" if isinstance(x, N.Case) else "SELECT"
    return x.column if isinstance(x, N.Name) else str(getattr(x, "text", x))


def select(query: N.Select, table: Callable[[object], DataFrame]) -> DataFrame:
    """The query over tables by name, and subqueries."""
    scope, df = Scope(table), None
    for source in query.sources:
        own = scope.add(source.alias, table(source.table))
        if df is None:
            df = own
        elif source.cross:
            df = df.crossJoin(own)
        else:
            df = df.join(own, predicate(source.on, scope), source.kind)
    if query.where is not None:
        df = df.where(predicate(query.where, scope))
    grouped = bool(query.group) or query.having is not None or any(_has_aggregate(i.value) for i in query.items)
    return _grouped(query, df, scope) if grouped else _plain(query, df, scope)


def combined(query: N.Combined, one: Callable[[N.Select], DataFrame]) -> DataFrame:
    """UNION, INTERSECT and EXCEPT by place, named as the first query is; without ALL rows are distinct."""
    out = one(query.first)
    for kind, every, right in query.rest:
        other = one(right)
        if len(other.columns) != len(out.columns):
            raise BindProblem(f"{kind} of {len(out.columns)} and {len(other.columns)} columns")
        if kind == "UNION":
            out = out.union(other) if every else out.union(other).distinct()
        elif kind == "INTERSECT":
            out = out.intersectAll(other) if every else out.intersect(other)
        else:
            out = out.exceptAll(other) if every else out.subtract(other)

    def find(name: N.Name) -> tuple[Column, T.DataType]:
        if name.table is not None or name.column not in out.columns:
            raise BindProblem(f"column {name} is unknown")
        return F.col(f"`{name.column}`"), out.schema[name.column].dataType

    keys = _keys(query, find)
    return _finished(query, out.orderBy(*keys) if keys else out)


def _keys(query: N.Select | N.Combined, find: Callable[[N.Name], tuple[Column, T.DataType]]) -> list[Column]:
    keys: list[Column] = []
    for name, descending in query.order:
        column, kind = find(name)
        keys += sort_keys(column, descending) if isinstance(kind, T.StringType) else [column.desc() if descending else column.asc()]
    return keys


def _finished(query: N.Select | N.Combined, df: DataFrame) -> DataFrame:
    df = df.offset(query.offset) if query.offset else df
    return df if query.limit is None else df.limit(query.limit)


def _plain(query: N.Select, df: DataFrame, scope: Scope) -> DataFrame:
    out: list[Column] = []
    named: dict[str, tuple[Column, T.DataType]] = {}
    for item in query.items:
        if item.value is None:
            out += [F.col(f"`{inner}`").alias(column) for (_, column), (inner, _) in scope.columns.items()]
            continue
        column, kind = _value(item.value, lambda x: _operand(x, scope), scope)
        label = item.alias or _label(item.value)
        named[label] = (column, kind)
        out.append(column.alias(label))

    def find(name: N.Name) -> tuple[Column, T.DataType]:
        if name.table is None and name.column in named:
            return named[name.column]
        return _operand(name, scope)

    if query.distinct:
        result = df.select(*out).distinct()
        keys = _keys(query, lambda name: (F.col(f"`{name.column}`"), result.schema[name.column].dataType))
        return _finished(query, result.orderBy(*keys) if keys else result)
    keys = _keys(query, find)
    return _finished(query, df.orderBy(*keys) if keys else df).select(*out)


def _number(column: Column, kind: T.DataType | None) -> Column:
    return as_number(column) if isinstance(kind, T.StringType) else column


def _value(x, operand: Callable, scope: Scope) -> tuple[Column, T.DataType | None]:
    if isinstance(x, N.Arithmetic):  # texts take part as the numbers that they are, else as NULL; division is that of doubles
        (left, a), (right, b) = _value(x.left, operand, scope), _value(x.right, operand, scope)
        left, right = _number(left, a), _number(right, b)
        if x.op == "/":
            return F.try_divide(left.cast("double"), right.cast("double")), T.DoubleType()
        return {"+": left + right, "-": left - right, "*": left * right}[x.op], T.DoubleType()
    if isinstance(x, N.Case):
        out, kind = None, None
        for condition, value in x.branches:
            column, kind = _value(value, operand, scope)
            condition = predicate(condition, scope, operand)
            out = F.when(condition, column) if out is None else out.when(condition, column)
        return out if x.otherwise is None else out.otherwise(_value(x.otherwise, operand, scope)[0]), kind
    if isinstance(x, N.Literal):
        return (F.lit(x.text), T.StringType()) if x.quoted or x.text is None else (F.lit(float(x.text) if "." in x.text else int(x.text)), T.DoubleType())
    if isinstance(x, N.Call) and x.function == "ROUND":
        column, kind = _value(x.argument, operand, scope)
        return F.round(_number(column, kind), x.digits), T.DoubleType()
    return operand(x)


def _grouped(query: N.Select, df: DataFrame, scope: Scope) -> DataFrame:
    """Aggregates are computed once each, however often they are named; the output follows the SELECT list."""
    made: dict[N.Call, str] = {}
    keys = [scope.find(name)[0] for name in query.group]

    def operand(x) -> tuple[Column, T.DataType | None]:
        if isinstance(x, N.Call):
            name = made.setdefault(x, f"aggregate/{len(made)}")
            return F.col(f"`{name}`"), None
        if isinstance(x, N.Scalar):
            return _operand(x, scope)
        inner, kind = scope.find(x) if isinstance(x, N.Name) else (None, None)
        if inner not in keys:
            raise BindProblem(f"{x} is neither grouped nor aggregated")
        return F.col(f"`{inner}`"), kind

    out, named = [], {}
    for item in query.items:
        if item.value is None:
            raise BindProblem("* is neither grouped nor aggregated")
        column, kind = _value(item.value, operand, scope)
        label = item.alias or _label(item.value)
        named[label] = (column, kind)
        out.append(column.alias(label))

    def find(name: N.Name) -> tuple[Column, T.DataType | None]:
        return named[name.column] if name.table is None and name.column in named else operand(name)

    having = None if query.having is None else predicate(query.having, scope, lambda x: find(x) if isinstance(x, N.Name) else _value(x, operand, scope))
    order = _keys(query, find)
    aggregates = []
    for call, name in made.items():
        column, kind = (None, None) if call.argument is None else _operand(call.argument, scope)
        aggregates.append(aggregate(call.function, column, kind, call.distinct).alias(name))
    groups = [F.col(f"`{k}`") for k in keys]
    result = df.groupBy(*groups).agg(*aggregates) if aggregates else df.select(*groups).distinct()
    result = result if having is None else result.where(having)
    result = result.orderBy(*order) if order else result
    result = _finished(query, result).select(*out)
    return result.distinct() if query.distinct else result
