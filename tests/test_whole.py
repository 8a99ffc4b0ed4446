"""Queries over whole tables, against brute force."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest

import siltstone.queries  # noqa: F401
from siltstone import registry
from siltstone.operators import conflicts
from siltstone.queries.versions import _wait_edges
from tests.conftest import DATA


def test_entropy_of_texts(spark):
    got = {r.id: r.bits for r in registry.QUERIES["s_entropy"](spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    counts = [spark.read.parquet(f"{DATA}/{t}.parquet").count() for t in ("events", "part")]
    assert len(got) == len(docs) + sum(counts)
    differ = 0
    for r in docs:
        bits = [-sum(c / len(t) * math.log2(c / len(t)) for c in Counter(t).values()) for t in (r.text, r.text[:200])]
        assert abs(got[r.doc_id] - bits[0]) < 1e-4
        differ += abs(bits[0] - bits[1]) > 1e-2
    assert differ > 100


def on_cycles(edges) -> set:
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = set()
    for start in after:
        seen, stack = set(), [start]
        while stack:
            for x in after.get(stack.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    stack.append(x)
        if start in seen:
            out.add(start)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles_of_any_graph(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(32)] + [(40 + i, 40 + (i + 1) % 9) for i in range(9)] + [(i, i + 1) for i in range(100, 130)]
    frame = spark.createDataFrame(edges, "src long, dst long")
    assert {r.node for r in conflicts.cycles(frame, 8).collect()} == on_cycles(edges)


def test_cycles_too_long_for_the_rounds_raise(spark):
    ring = spark.createDataFrame([(i, (i + 1) % 40) for i in range(40)], "src long, dst long")
    with pytest.raises(RuntimeError):
        conflicts.cycles(ring, 3)


def test_waits_of_all_transactions(spark):
    edges = [tuple(r) for r in _wait_edges(spark, DATA).collect()]
    want = on_cycles(edges)
    got = [r.node for r in registry.QUERIES["c_cycle"](spark, DATA).collect()]
    assert len(got) == len(want) and set(got) == want and max(want) >= 60
    assert registry.QUERIES["c_deadlock"](spark, DATA).first().victim == max(want)


def test_joins_of_tables(spark):
    orders = [(r.o_custkey, r.o_totalprice) for r in spark.read.parquet(f"{DATA}/orders.parquet").collect()]
    balance = {r.c_custkey: r.c_acctbal for r in spark.read.parquet(f"{DATA}/customer.parquet").collect()}
    partners = {c for c, p in orders if c in balance and p > balance[c] * 50}
    for kind in ("inner", "left"):
        assert registry.QUERIES[f"join_{kind}"](spark, DATA).count() == len(orders)
        assert registry.QUERIES[f"ij_{kind}"](spark, DATA).count() == len(orders)
    assert {r.c_custkey for r in registry.QUERIES["join_semi"](spark, DATA).collect()} == partners
    assert {r.c_custkey for r in registry.QUERIES["join_anti"](spark, DATA).collect()} == set(balance) - partners


def test_writes_from_all_orders(spark):
    keys = {r.o_orderkey for r in spark.read.parquet(f"{DATA}/orders.parquet").select("o_orderkey").collect()}
    got = {r.found: r.n for r in registry.QUERIES["sink_delete"](spark, DATA).collect()}
    gone = sum(k % 5 == 0 for k in keys)
    assert got == {True: gone, None: len(keys) - gone}
    assert registry.QUERIES["kv_cas"](spark, DATA).count() == 2 * len(keys)


def test_sort_with_nulls_is(spark):
    rows = [(r.size, r.p_partkey) for r in registry.QUERIES["sort_nulls"](spark, DATA).collect()]
    assert len(rows) == spark.read.parquet(f"{DATA}/part.parquet").count()
    assert rows == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert rows[0][0] is None and rows[-1][0] is not None
