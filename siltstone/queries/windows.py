"""Window functions over the default frame."""

from __future__ import annotations

from siltstone.plans.spec import Call, Col, Lit, Order, QuerySpec, WindowFn
from siltstone.queries.tables import compiled
from siltstone.registry import register

C, L = Col, Lit
CUSTOMER = (C("o_custkey"),)
#: a total order, and one with ties
TOTAL = (Order(C("o_orderdate")), Order(C("o_orderkey")))
TIES = (Order(C("o_orderpriority"), desc=True),)
TOTAL_SQL, TIES_SQL = "o_orderdate, o_orderkey", "o_orderpriority DESC"


def window(name: str, fn: str, order, order_sql: str, call: str, rounded: bool = False, **options) -> None:
    value = Call("round", (C("w"), L(6))) if rounded else C("w")
    spec = QuerySpec("orders", windows=(WindowFn(fn, "w", CUSTOMER, order, **options),), select=(("o_orderkey", C("o_orderkey")), ("w", value)))
    over = f"{call} OVER (PARTITION BY o_custkey ORDER BY {order_sql})"
    register(name, compiled(spec), f"SELECT o_orderkey, {f'round({over}, 6)' if rounded else over} AS w FROM orders")


window("win_row_number", "row_number", TOTAL, TOTAL_SQL, "row_number()")
window("win_rank", "rank", TIES, TIES_SQL, "rank()")
window("win_dense_rank", "dense_rank", TIES, TIES_SQL, "dense_rank()")
window("win_percent_rank", "percent_rank", TIES, TIES_SQL, "percent_rank()", rounded=True)
window("win_cume_dist", "cume_dist", TIES, TIES_SQL, "cume_dist()", rounded=True)
window("win_lag", "lag", TOTAL, TOTAL_SQL, "lag(o_totalprice, 2, -1.0)", expr=C("o_totalprice"), n=2, default=-1.0)
window("win_lead", "lead", TOTAL, TOTAL_SQL, "lead(o_totalprice)", expr=C("o_totalprice"))
window("win_first_value", "first_value", TOTAL, TOTAL_SQL, "first_value(o_totalprice)", expr=C("o_totalprice"))
window("win_last_value", "last_value", TIES, TIES_SQL, "last_value(o_orderpriority)", expr=C("o_orderpriority"))
window("win_nth_value", "nth_value", TOTAL, TOTAL_SQL, "nth_value(o_totalprice, 3)", expr=C("o_totalprice"), n=3)
