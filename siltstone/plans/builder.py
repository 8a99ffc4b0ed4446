"""Compiles a QuerySpec to a DataFrame.

The builder only declares the plan.  Which columns are read, which filters
reach the scan, how joins are run and in what order is left to the optimizer;
a join strategy becomes a hint.  Anything unknown is an error, never ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.plans import spec as S
from siltstone.sources.catalog import Catalog


class SpecError(ValueError):
    pass


_COMPARE = {
    "=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}
_BINARY = _COMPARE | {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b,
    "/": lambda a, b: F.try_divide(a, b), "%": lambda a, b: F.try_mod(a, b),
    "concat": lambda a, b: F.concat(a, b),
    "&": lambda a, b: a.bitwiseAND(b), "|": lambda a, b: a.bitwiseOR(b), "^": lambda a, b: a.bitwiseXOR(b),
}
_UNARY = {"not": lambda a: ~a, "neg": lambda a: -a, "bitnot": F.bitwise_not}
#: Scalar functions that a specification may call by name.
CALLABLE = frozenset(
    "abs ceil floor round sqrt exp ln log10 power sign upper lower trim ltrim rtrim length substring replace concat lpad rpad "
    "reverse repeat coalesce nullif greatest least year month day hour minute second date_trunc sha2 md5 crc32 hex unhex".split()
)
_TYPES = {
    "bool": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "float32": "float", "float64": "double",
    "string": "string", "binary": "binary", "date": "date", "timestamp": "timestamp_ntz",
}
_HINTS = {"hash": "shuffle_hash", "merge": "merge", "nested": "shuffle_replicate_nl", "broadcast": "broadcast"}
_KINDS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "cross": "cross", "semi": "left_semi", "anti": "left_anti"}


def type_name(name: str) -> str:
    if name.startswith("decimal("):
        return name
    if name not in _TYPES:
        raise SpecError(f"unknown type {name}")
    return _TYPES[name]


class Builder:
    def __init__(self, catalog: Catalog):
        self.catalog = catalog

    # --- expressions

    def expr(self, e: S.Expr) -> Column:
        match e:
            case S.Col(name):
                return F.col(name)
            case S.Lit(value, type_):
                out = F.lit(value)
                return out.cast(type_name(type_)) if type_ else out
            case S.Binary(op, left, right) if op in _BINARY:
                return _BINARY[op](self.expr(left), self.expr(right))
            case S.Unary(op, inner) if op in _UNARY:
                return _UNARY[op](self.expr(inner))
            case S.Call(name, args) if name in CALLABLE:
                return F.call_function(name, *[self.expr(a) for a in args])
            case S.Cast(inner, type_, lenient):
                c = self.expr(inner)
                return c.try_cast(type_name(type_)) if lenient else c.cast(type_name(type_))
            case S.Case(whens, otherwise):
                out = reduce(lambda acc, w: acc.when(self.predicate(w[0]), self.expr(w[1])), whens, F)
                return out.otherwise(self.expr(otherwise)) if otherwise is not None else out
            case S.Subquery(query):
                return self.build(query).scalar()
        raise SpecError(f"unknown expression {e!r}")

    def predicate(self, p: S.Predicate) -> Column:
        match p:
            case S.Compare(op, left, right) if op in _COMPARE:
                return _COMPARE[op](self.expr(left), self.expr(right))
            case S.In(e, values):
                return self.expr(e).isin(*values)
            case S.Between(e, low, high):
                return self.expr(e).between(self.expr(low), self.expr(high))
            case S.Range(e, start, end):
                c = self.expr(e)
                parts = ([c >= self.expr(start)] if start is not None else []) + ([c < self.expr(end)] if end is not None else [])
                return reduce(lambda a, b: a & b, parts, c.isNotNull())
            case S.Like(e, pattern):
                return self.expr(e).like(pattern)
            case S.IsNull(e):
                return self.expr(e).isNull()
            case S.IsNotNull(e):
                return self.expr(e).isNotNull()
            case S.And(parts):
                return reduce(lambda a, b: a & b, map(self.predicate, parts), F.lit(True))
            case S.Or(parts):
                return reduce(lambda a, b: a | b, map(self.predicate, parts), F.lit(False))
            case S.Not(part):
                return ~self.predicate(part)
        raise SpecError(f"unknown predicate {p!r}")

    def order(self, o: S.Order) -> Column:
        c = self.expr(o.expr)
        if o.desc:
            return c.desc_nulls_first() if o.nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if o.nulls_first else c.asc_nulls_last()

    # --- operators

    def source(self, table: str | S.QuerySpec) -> DataFrame:
        return self.catalog.table(table) if isinstance(table, str) else self.build(table)

    def join(self, left: DataFrame, j: S.Join) -> DataFrame:
        if j.kind not in _KINDS:
            raise SpecError(f"unknown join {j.kind}")
        right = self.source(j.table)
        if j.strategy == "index":
            return self.index_join(left, right, j)
        if j.strategy != "auto":
            if j.strategy not in _HINTS:
                raise SpecError(f"unknown join strategy {j.strategy}")
            # where columns are equal, loops need only run among the rows of a key, which sorting brings together
            right = right.hint("merge" if j.strategy == "nested" and j.on else _HINTS[j.strategy])
        if j.kind == "cross":
            out = left.crossJoin(right)
            return out.where(self.predicate(j.residual)) if j.residual is not None else out
        conditions = [left[a] == right[b] for a, b in j.on]
        if j.residual is not None:
            conditions.append(self.predicate(j.residual))
        if not conditions:
            raise SpecError("a join needs a condition")
        return left.join(right, reduce(lambda a, b: a & b, conditions), _KINDS[j.kind])

    def index_join(self, left: DataFrame, right: DataFrame, j: S.Join) -> DataFrame:
        """Joins through the stored index on the right side's column: left rows find
        their entries in the narrow index, and only the entries found are looked up in
        the table, by primary key.  Needs one pair of columns and an index on it."""
        if j.kind not in ("inner", "left") or len(j.on) != 1 or j.residual is not None or not isinstance(j.table, str):
            raise SpecError("an index join is an inner or left join with a table on one pair of columns")
        (own, column), index = j.on[0], self.catalog.index_on(j.table, j.on[0][1])
        if index is None:
            raise SpecError(f"no index on {j.table}.{column}")
        entries = index.entries().select(F.col("index_key").alias("__key"), F.col("primary_key").alias("__primary"))
        found = left.join(entries, left[own] == entries["__key"], j.kind)
        return found.join(right, found["__primary"] == right[index.primary_key], j.kind).drop("__key", "__primary")

    def exchange(self, df: DataFrame, x: S.Exchange) -> DataFrame:
        if x.kind == "gather":
            return df.coalesce(1)
        if x.kind == "broadcast":
            return F.broadcast(df)
        if x.kind == "round_robin" and x.n:
            return df.repartition(x.n)
        if x.kind == "repartition" and x.keys:
            keys = [self.expr(e) for e in x.keys]
            return df.repartition(x.n, *keys) if x.n else df.repartition(*keys)
        raise SpecError(f"unknown exchange {x!r}")

    def aggregate(self, a: S.Agg) -> Column:
        e = self.expr(a.expr) if a.expr is not None else None
        if e is None and a.fn != "count":
            raise SpecError(f"{a.fn} needs an expression")
        if a.where is not None:  # rows that it does not accept count as NULL
            e = F.when(self.predicate(a.where), F.lit(1) if e is None else e)
        match a.fn:
            case "count":
                out = F.count(F.lit(1)) if e is None else F.count(e)
            case "sum" | "avg" | "min" | "max":
                out = getattr(F, a.fn)(e)
            case "stddev":
                out = F.stddev_samp(e)
            case "variance":
                out = F.var_samp(e)
            case "percentile":
                out = F.percentile(e, a.param)
            case "count_distinct":
                out = F.count_distinct(e)
            case "group_concat":  # ordered by the values, so that results do not depend on the order of input
                joined = F.array_join(F.array_sort(F.collect_list(e.cast("string"))), a.param if a.param is not None else ",")
                out = F.when(F.count(e) > 0, joined)  # NULL where there is nothing to join
            case _:
                raise SpecError(f"unknown aggregate {a.fn}")
        return out.alias(a.alias)

    def window(self, w: S.WindowFn) -> Column:
        over = Window.partitionBy(*[self.expr(e) for e in w.partition_by])
        if w.order_by:
            over = over.orderBy(*[self.order(o) for o in w.order_by])
        if w.fn in ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist"):
            out = getattr(F, w.fn)()
        elif w.fn in ("lag", "lead"):
            default = w.default.value if isinstance(w.default, S.Lit) else w.default
            out = getattr(F, w.fn)(self.expr(w.expr), w.n, default)
        elif w.fn == "first_value":
            out = F.first(self.expr(w.expr))
        elif w.fn == "last_value":
            out = F.last(self.expr(w.expr))
        elif w.fn == "nth_value":
            out = F.nth_value(self.expr(w.expr), w.n)
        else:
            raise SpecError(f"unknown window function {w.fn}")
        return out.over(over).alias(w.alias)

    def build(self, q: S.QuerySpec) -> DataFrame:
        df = self.source(q.table)
        for j in q.joins:
            df = self.join(df, j)
        if q.where is not None:
            df = df.where(self.predicate(q.where))
        if q.group_by or q.aggregates:
            if not q.aggregates:
                df = df.select(*[self.expr(e).alias(n) for n, e in q.group_by]).distinct()
            else:
                if q.grouping not in ("plain", "rollup", "cube"):
                    raise SpecError(f"unknown grouping {q.grouping}")
                group = {"plain": df.groupBy, "rollup": df.rollup, "cube": df.cube}[q.grouping]
                df = group(*[self.expr(e).alias(n) for n, e in q.group_by]).agg(*[self.aggregate(a) for a in q.aggregates])
        elif q.having is not None:
            raise SpecError("having without aggregates")
        if q.having is not None:
            df = df.where(self.predicate(q.having))
        if q.windows:
            df = df.select("*", *[self.window(w) for w in q.windows])
        if q.select:
            df = df.select(*[self.expr(e).alias(n) for n, e in q.select])
        for other in q.union:
            df = df.unionByName(self.build(other))
        if q.distinct or q.union and q.union_distinct:
            df = df.distinct()
        if q.order_by:
            df = df.orderBy(*[self.order(o) for o in q.order_by])
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return self.exchange(df, q.exchange) if q.exchange is not None else df
