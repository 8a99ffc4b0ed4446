"""Query specifications: a declarative algebra that the builder compiles.

Where several readings are possible the semantics are those of standard SQL:
three-valued logic, NULL for aggregates of nothing, the default window frame.
NULLs sort last unless ``nulls_first`` is set.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any, Union

# --- expressions -------------------------------------------------------------


@dataclass(frozen=True)
class Col:
    name: str


@dataclass(frozen=True)
class Lit:
    value: Any
    type: str | None = None


@dataclass(frozen=True)
class Binary:
    """op: + - * / % concat & | ^, or a comparison."""

    op: str
    left: "Expr"
    right: "Expr"


@dataclass(frozen=True)
class Unary:
    """op: not, neg, bitnot."""

    op: str
    expr: "Expr"


@dataclass(frozen=True)
class Call:
    """A named scalar function of the builder's list."""

    name: str
    args: tuple["Expr", ...]


@dataclass(frozen=True)
class Cast:
    expr: "Expr"
    type: str
    lenient: bool = False


@dataclass(frozen=True)
class Case:
    whens: tuple[tuple["Predicate", "Expr"], ...]
    otherwise: "Expr | None" = None


@dataclass(frozen=True)
class Subquery:
    """An uncorrelated scalar subquery; more than one row is an error."""

    query: "QuerySpec"


Expr = Union[Col, Lit, Binary, Unary, Call, Cast, Case, Subquery]

# --- predicates --------------------------------------------------------------


@dataclass(frozen=True)
class Compare:
    """op: = <> < <= > >=."""

    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class In:
    expr: Expr
    values: tuple[Any, ...]


@dataclass(frozen=True)
class Between:
    """Both ends included."""

    expr: Expr
    low: Expr
    high: Expr


@dataclass(frozen=True)
class Range:
    """[start, end); None leaves an end open."""

    expr: Expr
    start: Expr | None
    end: Expr | None


@dataclass(frozen=True)
class Like:
    expr: Expr
    pattern: str


@dataclass(frozen=True)
class IsNull:
    expr: Expr


@dataclass(frozen=True)
class IsNotNull:
    expr: Expr


@dataclass(frozen=True)
class And:
    parts: tuple["Predicate", ...]


@dataclass(frozen=True)
class Or:
    parts: tuple["Predicate", ...]


@dataclass(frozen=True)
class Not:
    part: "Predicate"


Predicate = Union[Compare, In, Between, Range, Like, IsNull, IsNotNull, And, Or, Not]

# --- query -------------------------------------------------------------------


@dataclass(frozen=True)
class Join:
    """kind: inner left right full cross semi anti; strategy: auto hash nested
    merge index broadcast.  ``on`` pairs columns of the left and right side."""

    table: "str | QuerySpec"
    kind: str = "inner"
    on: tuple[tuple[str, str], ...] = ()
    residual: Predicate | None = None
    strategy: str = "auto"


@dataclass(frozen=True)
class Agg:
    """fn: count sum avg min max group_concat stddev variance percentile
    count_distinct; ``param`` is the separator or the percentile; ``where`` limits
    the rows that count."""

    fn: str
    expr: Expr | None
    alias: str
    param: Any = None
    where: Predicate | None = None


@dataclass(frozen=True)
class Order:
    expr: Expr
    desc: bool = False
    nulls_first: bool = False


@dataclass(frozen=True)
class WindowFn:
    """fn: row_number rank dense_rank percent_rank cume_dist lag lead
    first_value last_value nth_value; ``n`` is an offset or place."""

    fn: str
    alias: str
    partition_by: tuple[Expr, ...] = ()
    order_by: tuple[Order, ...] = ()
    expr: Expr | None = None
    n: int = 1
    default: Any = None


@dataclass(frozen=True)
class Exchange:
    """kind: gather (into one partition), repartition (by keys, into n), round_robin
    (into n), broadcast (to every task of the join that takes it)."""

    kind: str
    n: int | None = None
    keys: tuple[Expr, ...] = ()


@dataclass(frozen=True)
class QuerySpec:
    table: str
    select: tuple[tuple[str, Expr], ...] = ()
    where: Predicate | None = None
    joins: tuple[Join, ...] = ()
    group_by: tuple[tuple[str, Expr], ...] = ()
    aggregates: tuple[Agg, ...] = ()
    having: Predicate | None = None
    windows: tuple[WindowFn, ...] = ()
    distinct: bool = False
    order_by: tuple[Order, ...] = ()
    limit: int | None = None
    offset: int = 0
    union: tuple["QuerySpec", ...] = ()
    union_distinct: bool = False
    grouping: str = "plain"  # or rollup, cube
    exchange: Exchange | None = None
