"""Scans, projections, predicates, joins, sorting and set operations, each as a
specification that the builder compiles."""

from __future__ import annotations

import uuid

from siltstone.plans.builder import Builder
from siltstone.plans.spec import (
    Agg, And, Between, Binary, Call, Col, Compare, Exchange, In, IsNotNull, IsNull, Join, Like, Lit, Not, Or, Order, QuerySpec, Range,
)
from siltstone.queries.tables import compiled
from siltstone.registry import register
from siltstone.session import checkpoint_dir
from siltstone.sources.catalog import Catalog

C, L = Col, Lit


def cols(*names: str) -> tuple:
    return tuple((n, Col(n)) for n in names)


revenue = Binary("*", C("l_extendedprice"), Binary("-", L(1), C("l_discount")))
register(
    "flagship",
    compiled(
        QuerySpec(
            "lineitem", where=Between(C("l_quantity"), L(10), L(40)), group_by=cols("l_returnflag"),
            aggregates=(Agg("count", None, "n"), Agg("sum", revenue, "revenue")),
            select=(("l_returnflag", C("l_returnflag")), ("n", C("n")), ("revenue", Call("round", (C("revenue"), L(2))))), order_by=(Order(C("l_returnflag")),),
        )
    ),
    "SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_quantity BETWEEN 10 AND 40 GROUP BY l_returnflag",
)

# --- scans
ORDER_COLS = ("o_orderkey", "o_custkey", "o_totalprice")
O = ", ".join(ORDER_COLS)  # noqa: E741


def scan(name: str, where, condition: str) -> None:
    register(name, compiled(QuerySpec("orders", where=where, select=cols(*ORDER_COLS))), f"SELECT {O} FROM orders" + (f" WHERE {condition}" if condition else ""))


scan("scan_full", None, "")
scan("scan_range", Range(C("o_orderkey"), L(100), L(900)), "o_orderkey >= 100 AND o_orderkey < 900")
scan("scan_skip", Compare("=", C("o_orderpriority"), L("1-URGENT")), "o_orderpriority = '1-URGENT'")


def _place(spark, name: str) -> str:
    """A folder of its own for a stored index or view."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def scan_index(spark, folder):
    catalog = Catalog(spark, folder)
    return catalog.create_index("by_customer", "orders", ["o_custkey"], "o_orderkey", path=_place(spark, "by_customer")).lookup(42).select(*ORDER_COLS)


def scan_bitmap(spark, folder):
    """Two stored indexes' primary keys intersected, then the rows: as semi joins."""
    catalog = Catalog(spark, folder)
    status = catalog.create_index("by_status", "orders", ["o_orderstatus"], "o_orderkey", path=_place(spark, "by_status")).key("F")
    priority = catalog.create_index("by_priority", "orders", ["o_orderpriority"], "o_orderkey", path=_place(spark, "by_priority")).key("1-URGENT")
    orders = catalog.table("orders")
    for hits in (status, priority):
        orders = orders.join(hits.select(hits["primary_key"].alias("o_orderkey")), "o_orderkey", "left_semi")
    return orders.select(*ORDER_COLS)


def scan_index_only(spark, folder):
    """All columns needed are in the stored index: the table is not read."""
    index = Catalog(spark, folder).create_index("covering", "orders", ["o_custkey", "o_orderstatus"], "o_orderkey", path=_place(spark, "covering"))
    return index.entries().where("index_key.o_custkey < 50").selectExpr("index_key.o_custkey AS o_custkey", "index_key.o_orderstatus AS o_orderstatus", "primary_key AS o_orderkey")


def scan_matview(spark, folder):
    catalog = Catalog(spark, folder)
    catalog.create_view("urgent", Builder(catalog).build(QuerySpec("orders", where=Like(C("o_orderpriority"), "1-%"), group_by=cols("o_custkey"), aggregates=(Agg("count", None, "n"),))), _place(spark, "urgent"))
    return Builder(catalog).build(QuerySpec("urgent", where=Compare(">=", C("n"), L(2)), select=cols("o_custkey", "n")))


register("scan_index", scan_index, f"SELECT {O} FROM orders WHERE o_custkey = 42")
register("scan_bitmap", scan_bitmap, f"SELECT {O} FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
register("scan_index_only", scan_index_only, "SELECT o_custkey, o_orderstatus, o_orderkey FROM orders WHERE o_custkey < 50")
register("scan_matview", scan_matview, "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority LIKE '1-%' GROUP BY 1 HAVING count(*) >= 2")

# --- projection and predicates
register(
    "project",
    compiled(QuerySpec("lineitem", select=(("l_orderkey", C("l_orderkey")), ("net", Call("round", (revenue, L(4)))), ("flag", Call("lower", (C("l_returnflag"),)))))),
    "SELECT l_orderkey, round(l_extendedprice * (1 - l_discount), 4) AS net, lower(l_returnflag) AS flag FROM lineitem",
)
scan("filter", Compare(">", C("o_totalprice"), L(300000.0)), "o_totalprice > 300000")

PART = ("p_partkey", "p_brand", "p_size")
P = ", ".join(PART)
for op, name in (("=", "p_eq"), ("<>", "p_ne"), (">", "p_gt"), ("<", "p_lt"), (">=", "p_ge"), ("<=", "p_le")):
    register(name, compiled(QuerySpec("part", where=Compare(op, C("p_size"), L(15)), select=cols(*PART))), f"SELECT {P} FROM part WHERE p_size {op} 15")
#: p_size 1 stands in for NULL: the tables have none.
maybe = Call("nullif", (C("p_size"), L(1)))
for name, predicate, sql in (
    ("p_in", In(C("p_size"), (1, 5, 9, 49)), "p_size IN (1, 5, 9, 49)"),
    ("p_between", Between(C("p_size"), L(10), L(20)), "p_size BETWEEN 10 AND 20"),
    ("p_range", Range(C("p_size"), L(10), L(20)), "p_size >= 10 AND p_size < 20"),
    ("p_like", Like(C("p_type"), "%M_"), "p_type LIKE '%M_'"),
    ("p_isnull", IsNull(maybe), "nullif(p_size, 1) IS NULL"),
    ("p_isnotnull", IsNotNull(maybe), "nullif(p_size, 1) IS NOT NULL"),
    ("p_and", And((Compare(">", C("p_size"), L(10)), Compare("<", C("p_retailprice"), L(1200.0)))), "p_size > 10 AND p_retailprice < 1200"),
    ("p_or", Or((Compare("<", C("p_size"), L(3)), Like(C("p_brand"), "%1"))), "p_size < 3 OR p_brand LIKE '%1'"),
    ("p_not", Not(Compare(">", maybe, L(10))), "NOT (nullif(p_size, 1) > 10)"),
):
    register(name, compiled(QuerySpec("part", where=predicate, select=cols(*PART))), f"SELECT {P} FROM part WHERE {sql}")

# --- joins of whole tables; in outer, semi and anti joins a condition on both sides leaves rows without partners.
PAIR = cols("o_orderkey", "o_custkey", "c_custkey", "c_name")


register(
    "join_cross",
    compiled(QuerySpec("region", joins=(Join("nation", "cross"),), select=cols("r_name", "n_name"))),
    "SELECT r_name, n_name FROM region CROSS JOIN nation",
)
register(
    "join_theta",
    compiled(
        QuerySpec(
            "orders", joins=(Join("customer", "inner", (("o_custkey", "c_custkey"),), Compare(">", C("o_totalprice"), Binary("*", C("c_acctbal"), L(50)))),),
            select=cols("o_orderkey", "c_custkey"),
        )
    ),
    "SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 50",
)
DEAR = Compare(">", C("o_totalprice"), Binary("*", C("c_acctbal"), L(50)))
DEAR_SQL = "o_custkey = c_custkey AND o_totalprice > c_acctbal * 50"


def join(name: str, kind: str, sql: str, condition=None, strategy: str = "auto") -> None:
    spec = QuerySpec("orders", joins=(Join("customer", kind, (("o_custkey", "c_custkey"),), condition, strategy=strategy),), select=PAIR)
    register(name, compiled(spec), f"SELECT o_orderkey, o_custkey, c_custkey, c_name FROM orders {sql} JOIN customer ON {DEAR_SQL if condition else 'o_custkey = c_custkey'}")


join("join_inner", "inner", "INNER")
join("join_left", "left", "LEFT", DEAR)
join("join_right", "right", "RIGHT", DEAR)
join("join_full", "full", "FULL", DEAR)
for strategy in ("hash", "nested", "merge", "broadcast"):
    join(f"js_{strategy}", "inner", "INNER", strategy=strategy)


def js_index(spark, folder):
    """Orders find their customers through a stored index on c_custkey."""
    catalog = Catalog(spark, folder)
    catalog.create_index("customers", "customer", ["c_custkey"], "c_custkey", unique=True, path=_place(spark, "customers"))
    return Builder(catalog).build(QuerySpec("orders", joins=(Join("customer", "inner", (("o_custkey", "c_custkey"),), strategy="index"),), select=PAIR))


register("js_index", js_index, "SELECT o_orderkey, o_custkey, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
for _kind, _x in (("gather", Exchange("gather")), ("repartition", Exchange("repartition", 6, (C("o_custkey"),))), ("round_robin", Exchange("round_robin", 6)), ("broadcast", Exchange("broadcast"))):
    register(f"exchange_{_kind}", compiled(QuerySpec("orders", select=cols(*ORDER_COLS), exchange=_x)), f"SELECT {O} FROM orders")
for _kind, _not in (("semi", ""), ("anti", "NOT ")):
    register(
        f"join_{_kind}",
        compiled(QuerySpec("customer", joins=(Join("orders", _kind, (("c_custkey", "o_custkey"),), DEAR),), select=cols("c_custkey", "c_name"))),
        f"SELECT c_custkey, c_name FROM customer WHERE {_not}EXISTS (SELECT 1 FROM orders WHERE {DEAR_SQL})",
    )
register(
    "join_multi",
    compiled(
        QuerySpec(
            "lineitem",
            joins=(Join("orders", "inner", (("l_orderkey", "o_orderkey"),)), Join("customer", "inner", (("o_custkey", "c_custkey"),)), Join("nation", "inner", (("c_nationkey", "n_nationkey"),)), Join("region", "inner", (("n_regionkey", "r_regionkey"),))),
            group_by=cols("r_name", "n_name"), aggregates=(Agg("count", None, "n"), Agg("sum", C("l_quantity"), "quantity")),
        )
    ),
    """SELECT r_name, n_name, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
)

# --- sorting and limits
BY_PRICE = (Order(C("o_totalprice"), desc=True), Order(C("o_orderkey")))
SORT_COLS = cols("o_orderkey", "o_totalprice")
register("sort", compiled(QuerySpec("orders", select=SORT_COLS, order_by=BY_PRICE)), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
register("topk", compiled(QuerySpec("orders", select=SORT_COLS, order_by=BY_PRICE, limit=25)), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
register("limit_offset", compiled(QuerySpec("orders", select=SORT_COLS, order_by=BY_PRICE, limit=20, offset=30)), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 30")
register(
    "sort_nulls",
    compiled(QuerySpec("part", select=(("p_partkey", C("p_partkey")), ("size", maybe)), order_by=(Order(C("size"), nulls_first=True), Order(C("p_partkey"))))),
    "SELECT p_partkey, nullif(p_size, 1) AS size FROM part ORDER BY size NULLS FIRST, p_partkey",
)

# --- set operations
NATIONS = QuerySpec("customer", select=(("key", C("c_nationkey")),))
SUPPLIERS = QuerySpec("supplier", select=(("key", C("s_nationkey")),))
register("union_all", compiled(QuerySpec("customer", select=(("key", C("c_nationkey")),), union=(SUPPLIERS,))), "SELECT c_nationkey AS key FROM customer UNION ALL SELECT s_nationkey FROM supplier")
register("union_distinct", compiled(QuerySpec("customer", select=(("key", C("c_nationkey")),), union=(SUPPLIERS,), union_distinct=True)), "SELECT c_nationkey AS key FROM customer UNION SELECT s_nationkey FROM supplier")
register("distinct", compiled(QuerySpec("orders", select=cols("o_orderstatus", "o_orderpriority"), distinct=True)), "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")


def _sides(spark, folder):
    build = compiled(NATIONS), compiled(SUPPLIERS)
    a, b = (f(spark, folder) for f in build)
    return a.where("key < 15"), b.where("key > 5")


register("intersect", lambda s, d: (lambda ab: ab[0].intersect(ab[1]))(_sides(s, d)), "SELECT c_nationkey AS key FROM customer WHERE c_nationkey < 15 INTERSECT SELECT s_nationkey FROM supplier WHERE s_nationkey > 5")
register("except", lambda s, d: (lambda ab: ab[0].subtract(ab[1]))(_sides(s, d)), "SELECT c_nationkey AS key FROM customer WHERE c_nationkey < 15 EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey > 5")
