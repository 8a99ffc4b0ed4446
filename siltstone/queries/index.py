"""Secondary indexes and joins between them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siltstone.operators.index import Index, JoinQuery, multi_query
from siltstone.queries.tables import table
from siltstone.registry import register
from siltstone.session import checkpoint_dir
from siltstone.sources.catalog import Catalog


def _indexes(spark, folder):
    orders = Index("orders_by_customer", table(spark, folder, "orders"), ("o_custkey",), "o_orderkey")
    customers = Index("customers", table(spark, folder, "customer"), ("c_custkey",), "c_custkey", unique=True)
    return orders, customers


register("idx_lookup", lambda s, d: _indexes(s, d)[0].lookup(70).select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 70")
register("idx_query_key", lambda s, d: _indexes(s, d)[0].key(70), "SELECT o_custkey AS index_key, o_orderkey AS primary_key FROM orders WHERE o_custkey = 70")
register("idx_query_range", lambda s, d: _indexes(s, d)[0].range(50, 90, 40), "SELECT o_custkey AS index_key, o_orderkey AS primary_key FROM orders WHERE o_custkey >= 50 AND o_custkey < 90 ORDER BY 1, 2 LIMIT 40")
register(
    "idx_query_composite",
    lambda s, d: Index("c", table(s, d, "orders"), ("o_orderstatus", "o_custkey"), "o_orderkey").range(("F", 100), ("O", 20)).select("primary_key"),
    "SELECT o_orderkey AS primary_key FROM orders WHERE (o_orderstatus > 'F' OR (o_orderstatus = 'F' AND o_custkey >= 100)) AND (o_orderstatus < 'O' OR (o_orderstatus = 'O' AND o_custkey < 20))",
)
register(
    "idx_multi",
    lambda s, d: multi_query({"a": _indexes(s, d)[0].key(70), "b": _indexes(s, d)[1].range(1, 30)}, 25),
    "SELECT * FROM (SELECT 'a' AS alias, o_orderkey AS primary_key FROM orders WHERE o_custkey = 70 UNION ALL SELECT 'b', c_custkey FROM customer WHERE c_custkey >= 1 AND c_custkey < 30) ORDER BY 1, 2 LIMIT 25",
)


def idx_maintain(spark, folder):
    """A stored index that rows are inserted into, deleted from and moved in: orders
    without every tenth, with some under a wrong customer, become all orders."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    wrong = orders.where("o_orderkey % 7 = 0")
    moved = wrong.withColumn("o_custkey", F.col("o_custkey") + 1)
    place = f"{checkpoint_dir(spark)}/maintain-{uuid.uuid4().hex}"
    catalog = Catalog(spark)
    catalog.register("orders", orders.where("o_orderkey % 10 <> 0 AND o_orderkey % 7 <> 0").union(moved))
    catalog.create_index("by_customer", "orders", ["o_custkey"], "o_orderkey", path=f"{place}/first")
    catalog.maintain("orders", orders, f"{place}/then", inserted=wrong.union(orders.where("o_orderkey % 10 = 0 AND o_orderkey % 7 <> 0")), deleted=moved)
    return catalog.index("by_customer").violations().where("n > 10")


register("idx_maintain", idx_maintain, "SELECT o_custkey AS index_key, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 10")


def idx_ddl(spark, folder):
    """Indexes made, listed and dropped; what is left and how much it holds."""
    catalog = Catalog(spark, folder)
    for name, columns in (("a", ["o_custkey"]), ("b", ["o_orderstatus"]), ("c", ["o_orderpriority"])):
        catalog.create_index(name, "orders", columns, "o_orderkey")
    catalog.drop_index("b")
    out = None
    for name in catalog.list_indexes():
        part = catalog.index(name).entries().agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("index_key").alias("keys")).select(F.lit(name).alias("name"), "entries", "keys")
        out = part if out is None else out.union(part)
    return out


register("idx_ddl", idx_ddl, "SELECT 'a' AS name, count(*) AS entries, count(DISTINCT o_custkey) AS keys FROM orders UNION ALL SELECT 'c', count(*), count(DISTINCT o_orderpriority) FROM orders")

LEFT, RIGHT = (100, 600), (400, 900)
_A = "(SELECT o_custkey AS left_key, o_orderkey AS left_data FROM orders WHERE o_custkey >= 100 AND o_custkey < 600)"
_B = "(SELECT c_custkey AS right_key, c_custkey AS right_data FROM customer WHERE c_custkey >= 400 AND c_custkey < 900)"
_COLUMNS = "left_key, right_key, left_data, right_data"
for _kind in ("inner", "left", "right", "full"):
    register(
        f"ij_{_kind}",
        lambda s, d, kind=_kind: JoinQuery(*_indexes(s, d), kind).execute(),
        f"SELECT {_COLUMNS} FROM (SELECT o_custkey AS left_key, o_orderkey AS left_data FROM orders) {_kind} JOIN (SELECT c_custkey AS right_key, c_custkey AS right_data FROM customer) ON left_key = right_key",
    )
register("ij_restrict", lambda s, d: JoinQuery(*_indexes(s, d), "left", left_range=LEFT, right_key=450, limit=5000).execute(), f"SELECT {_COLUMNS} FROM {_A} LEFT JOIN (SELECT * FROM {_B} WHERE right_key = 450) ON left_key = right_key ORDER BY 1, 2, 3, 4 LIMIT 5000")
register("join_range_params", lambda s, d: JoinQuery(*_indexes(s, d), "full", left_range=LEFT, right_range=RIGHT, limit=300).execute(), f"SELECT {_COLUMNS} FROM {_A} FULL JOIN {_B} ON left_key = right_key ORDER BY left_key NULLS LAST, right_key NULLS LAST, left_data NULLS LAST, right_data NULLS LAST LIMIT 300")


def range_overlap(spark, folder):
    """Runs of keys (min, max per supplier) that overlap a range."""
    runs = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.min("l_orderkey").alias("lo"), F.max("l_orderkey").alias("hi"))
    return runs.where(~((F.col("hi") < 5) | (F.col("lo") > 20)))


register("range_overlap", range_overlap, "SELECT l_suppkey, min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM lineitem GROUP BY 1 HAVING NOT (max(l_orderkey) < 5 OR min(l_orderkey) > 20)")
