"""Key-value, version, log, index, conflict and planning semantics on small data."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import codecs, content, cost, metrics, stats
from siltstone.operators import backup, conflicts, kv, versions
from siltstone.operators.index import Index, JoinQuery, UniqueViolation
from siltstone.operators.kv import IteratorBuilder, KeyValue, NumberKey, successor
from siltstone.plans.builder import Builder, SpecError
from siltstone.plans.spec import Agg, And, Binary, Col, Compare, In, Join, Lit, Or, QuerySpec, Range, Unary
from siltstone.sources import wal
from siltstone.sources.catalog import Catalog, UnknownTable
from tests.conftest import DATA


def pairs(spark, rows):
    return spark.createDataFrame([(bytearray(k), bytearray(v)) for k, v in rows], "key binary, value binary")


def keys(df):
    return [bytes(r["key"]) if isinstance(r["key"], (bytes, bytearray)) else r["key"] for r in df.collect()]


# --- key-value


@pytest.mark.parametrize("prefix, end", [(b"a", b"b"), (b"a\xff", b"b"), (b"\xff\xff", None), (b"ab\xfe", b"ab\xff"), (b"", None)])
def test_successor(prefix, end):
    assert successor(prefix) == end


def test_range_scan_is_half_open(spark):
    view = KeyValue(spark.createDataFrame([(f"key_{i:02d}", f"value_{i:02d}") for i in range(50)], "key string, value string"))
    assert view.scan().count() == 50
    assert keys(view.scan("key_10", "key_20")) == [f"key_{i}" for i in range(10, 20)]
    assert keys(view.scan("key_10", "key_20", include_start=False, include_end=True)) == [f"key_{i}" for i in range(11, 21)]
    assert keys(view.scan(None, "key_03", reverse=True, limit=2)) == ["key_02", "key_01"]
    assert keys(IteratorBuilder("key_05", "key_07", include_start=False).with_(include_end=True).build(view)) == ["key_06", "key_07"]


def test_binary_keys_compare_unsigned(spark):
    view = KeyValue(pairs(spark, [(b"\x80", b"a"), (b"\x7f", b"b"), (b"\x00", b"c"), (b"\x00\x01", b"d"), (b"\xff\xff", b"e")]))
    assert keys(view.scan()) == [b"\x00", b"\x00\x01", b"\x7f", b"\x80", b"\xff\xff"]
    assert keys(view.prefix(bytearray(b"\x00"))) == [b"\x00", b"\x00\x01"]
    assert keys(view.prefix(bytearray(b"\xff"))) == [b"\xff\xff"]


def test_bounds_reach_the_table(spark):
    orders = spark.read.parquet(f"{DATA}/orders.parquet")
    view = KeyValue.of(orders, NumberKey("order:", "o_orderkey", 10), F.col("o_orderstatus"))
    plan = view.scan("order:0000000100", "order:0000000200")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderkey,100)" in plan and "LessThan(o_orderkey,200)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan


def test_writes_hide_what_is_stored(spark):
    view = KeyValue(spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "key string, value string"))
    writes = spark.createDataFrame([(1, "a", "x", False), (2, "a", None, True), (3, "b", None, True), (4, "b", "y", False), (5, "d", "z", False)], "seq int, key string, value string, is_deleted boolean")
    assert {(r.key, r.value) for r in view.overlay(writes).collect()} == {("b", "y"), ("c", "3"), ("d", "z")}


def test_compare_and_swap(spark):
    view = KeyValue(spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string"))
    swaps = spark.createDataFrame([("a", "1", "9"), ("b", "7", "9"), ("c", None, "9"), ("d", "1", "9")], "key string, expected string, new string")
    got = {r.key: (r.swapped, r.value) for r in view.compare_and_swap(swaps).collect()}
    assert got == {"a": (True, "9"), "b": (False, "2"), "c": (True, "9"), "d": (False, None)}


def test_multi_get_keeps_order_and_repeats(spark):
    view = KeyValue(spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string"))
    asked = spark.createDataFrame(list(enumerate(["b", "x", "a", "b"])), "ordinal int, key string")
    assert [(r.key, r.value) for r in view.multi_get(asked).collect()] == [("b", "2"), ("x", None), ("a", "1"), ("b", "2")]


def test_size_limits(spark):
    rows = [("", "v", False), ("k" * 4096, "v", False), ("k" * 4097, "v", False), ("k", "", False), ("k", "v" * (1 << 20), False), ("k", "v" * ((1 << 20) + 1), False)]
    got = [r.error for r in kv.valid(spark.createDataFrame(rows, "key string, value string, is_deleted boolean")).collect()]
    assert got == ["empty key", None, "key too long", None, None, "value too long"]


# --- versions and logs


def test_deletion_wins_until_a_newer_put(spark):
    rows = [("a", 1, 1, "x", False), ("a", 2, 2, None, True), ("b", 1, 3, "y", False), ("b", 2, 4, None, True), ("b", 3, 5, "z", False)]
    table = spark.createDataFrame(rows, "key string, ts int, seq int, value string, is_deleted boolean")
    assert [(r.key, r.value) for r in versions.latest(table, ["key"], ["ts", "seq"]).collect()] == [("b", "z")]
    assert {(r.key, r.value) for r in versions.as_of(table, ["key"], "ts", F.lit(1)).collect()} == {("a", "x"), ("b", "y")}
    kept = versions.collect_garbage(table, ["key"], ["ts", "seq"], F.lit(3))
    assert {(r.key, r.seq) for r in kept.collect()} == {("a", 2), ("b", 4), ("b", 5)}


def test_as_of_join(spark):
    v = spark.createDataFrame([("a", 10, 1, "x"), ("a", 20, 2, "y"), ("a", 20, 3, "z")], "key string, ts int, seq int, value string")
    p = spark.createDataFrame([(1, "a", 9), (2, "a", 10), (3, "a", 25), (4, "b", 25)], "id int, key string, at int")
    got = {r.id: r.value for r in versions.as_of_join(p, v, ["key"], "at", "ts", ["seq"], ["value"]).collect()}
    assert got == {1: None, 2: "x", 3: "z", 4: None}


def test_replay(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [
        (1, t, "Put", "a", "1", None), (2, t, "TxBegin", None, None, 7), (3, t, "Put", "a", "2", 7), (4, t, "Put", "b", "3", 8), (5, t, "TxCommit", None, None, 7),
        (6, t, "Put", "c", "4", 9), (7, t, "TxAbort", None, None, 9), (8, t, "Put", "d", "5", None), (9, t, "Delete", "d", None, None),
    ]
    log = spark.createDataFrame(rows, "lsn long, ts timestamp, op string, key string, value string, tx_id long")
    assert {(r.key, r.value) for r in wal.replay(log).collect()} == {("a", "2")}


def test_bad_checksums_are_skipped_or_stop(spark):
    t = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([(i, t, "Put", f"k{i}", "v", None) for i in range(1, 6)], "lsn long, ts timestamp, op string, key string, value string, tx_id long")
    log = log.withColumn("checksum", F.when(F.col("lsn") == 3, F.lit(1).cast("long")).otherwise(wal.checksum()))
    assert {r.key for r in wal.replay(log).collect()} == {"k1", "k2", "k4", "k5"}
    assert {r.key for r in wal.replay(log, strict=True).collect()} == {"k1", "k2"}


def test_log_segments(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([(i, t, "Put", f"k{i % 3}", str(i), None) for i in range(25)], "lsn long, ts timestamp, op string, key string, value string, tx_id long")
    wal.write_log(log, str(tmp_path / "log"), segment_rows=10)
    assert len(list((tmp_path / "log").glob("segment=*"))) == 3
    assert {(r.key, r.value) for r in wal.replay(wal.read_log(spark, str(tmp_path / "log"))).collect()} == {("k0", "24"), ("k1", "22"), ("k2", "23")}


# --- indexes


def test_unique_index_refuses_repeats_and_skips_missing(spark):
    people = spark.createDataFrame([(1, "Alice", 30), (2, None, 30), (3, "Bob", None)], "id int, name string, age int")
    assert Index("n", people, ("name",), "id").entries().count() == 2
    assert Index("n", people, ("name", "age"), "id").entries().count() == 1
    with pytest.raises(UniqueViolation):
        Index("a", people, ("age",), "id", unique=True).check_unique()


def test_index_joins(spark):
    a = Index("a", spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id int, k string"), ("k",), "id")
    b = Index("b", spark.createDataFrame([(7, "x"), (8, "z")], "id int, k string"), ("k",), "id")
    count = lambda kind: JoinQuery(a, b, kind).execute().count()
    assert [count(k) for k in ("inner", "left", "right", "full")] == [2, 3, 3, 4]
    with pytest.raises(ValueError):
        JoinQuery(a, b, "outer").execute()


def test_catalog(spark):
    catalog = Catalog(spark)
    catalog.register("t", spark.range(5))
    catalog.create_index("i", "t", ["id"], "id", unique=True)
    assert catalog.list_indexes() == ["i"]
    catalog.drop_index("i")
    with pytest.raises(KeyError):
        catalog.drop_index("i")
    with pytest.raises(UnknownTable):
        catalog.table("missing")


# --- conflicts


def test_lock_matrix_is_symmetric(spark):
    got = {(r.held, r.wanted): r.compatible for r in conflicts.lock_matrix(spark).collect()}
    assert len(got) == 36 and all(got[a, b] == got[b, a] for a, b in got)
    assert not any(got["exclusive", x] for x in conflicts.LOCKS) and got["update", "shared"] and not got["update", "update"]


def test_first_committer_and_skew(spark):
    txs = spark.createDataFrame([(1, 0, 10), (2, 5, 15), (3, 20, 30)], "tx_id int, start_ts int, commit_ts int")
    reads = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "tx_id int, key string")
    writes = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b")], "tx_id int, key string")
    assert [(r.tx_a, r.tx_b) for r in conflicts.write_skew(reads, writes, txs).collect()] == [(1, 2)]
    done = spark.createDataFrame([("b", 1, 10), ("a", 2, 15)], "key string, tx_id int, ts int")
    got = {r.tx_id: r.aborts for r in conflicts.first_committer(writes.union(spark.createDataFrame([(2, "b")], writes.schema)), done, txs).collect()}
    assert got == {1: False, 2: True, 3: False}


def test_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 7)], "src int, dst int")
    assert {r.node for r in conflicts.cycles(edges).collect()} == {1, 2, 3}
    assert conflicts.deadlock_victims(edges).first().victim == 3


# --- specifications


def test_unknown_parts_are_errors(spark):
    build = Builder(Catalog(spark, DATA)).build
    with pytest.raises(SpecError):
        build(QuerySpec("part", joins=(Join("part", "sideways", (("p_partkey", "p_partkey"),)),)))
    with pytest.raises(SpecError):
        build(QuerySpec("part", aggregates=(Agg("median", Col("p_size"), "m"),)))
    with pytest.raises(SpecError):
        build(QuerySpec("part", where=Compare("~", Col("p_size"), Lit(1))))
    with pytest.raises(SpecError):
        build(QuerySpec("part", select=(("x", Unary("sqrt", Col("p_size"))),)))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["=", "<>", "<", ">="]), st.integers(0, 50)), min_size=1, max_size=4), st.booleans())
def test_predicates_agree_with_sql(spark, duck, parts, both):
    tests = tuple(Compare(op, Col("p_size"), Lit(n)) for op, n in parts)
    df = Builder(Catalog(spark, DATA)).build(QuerySpec("part", where=And(tests) if both else Or(tests), aggregates=(Agg("count", None, "n"),)))
    sql = (" AND " if both else " OR ").join(f"p_size {op} {n}" for op, n in parts)
    assert df.first().n == duck.execute(f"SELECT count(*) FROM part WHERE {sql}").fetchone()[0]


def test_filters_and_columns_reach_the_scan(spark):
    df = Builder(Catalog(spark, DATA)).build(QuerySpec("lineitem", where=And((Range(Col("l_orderkey"), Lit(5), Lit(9)), In(Col("l_linenumber"), (1, 2)))), select=(("x", Binary("+", Col("l_partkey"), Lit(1))),)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "LessThan(l_orderkey,9)" in plan and "l_comment" not in plan and "l_extendedprice" not in plan.split("ReadSchema")[1]


# --- functions


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 2**62), min_size=1, max_size=5))
def test_varint_round_trip(spark, numbers):
    df = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", codecs.varint_hex(F.col("n")).alias("h"), codecs.varint_length(F.col("n")).alias("l"))
    for r in df.select("*", codecs.varint_value(F.col("h")).alias("back")).collect():
        assert r.back == r.n and len(r.h) == 2 * r.l


def test_composite_keys(spark):
    rows = [("a:b", "c"), ("plain", "x:y:z")]
    df = spark.createDataFrame(rows, "a string, b string").withColumn("k", codecs.composite([F.col("a"), F.col("b")]))
    assert [tuple(r.p) for r in df.select(codecs.split_composite()(F.col("k")).alias("p")).collect()] == rows


def test_equal_height_histogram(spark):
    h = stats.histogram_equal_height(spark.range(105).selectExpr("cast(id as double) AS v"), "v").orderBy("bucket").collect()
    assert [r.n for r in h] == [10] * 9 + [15] and [r.boundary for r in h] == [9.0 + 10 * i for i in range(9)] + [104.0]


def test_trend_and_hotness(spark):
    daily = spark.createDataFrame([(1, 10), (2, 40), (3, 15)], "day int, n int")
    assert metrics.trend(daily, "day", "n", 30).first().change_percent == 50.0
    heat = spark.range(1).select(content.hotness(F.lit(0.0), F.lit(10.0), F.lit(200.0)).alias("h")).first().h
    assert heat == pytest.approx(100.0)


def test_join_order_avoids_cross_products():
    rows = {"a": 1e6, "b": 10.0, "c": 1000.0}
    plan = cost.join_order(rows, {frozenset(("a", "b")): 1e-6, frozenset(("b", "c")): 1e-3})
    assert plan.tables == {"a", "b", "c"} and "(a c)" not in plan.order
    with pytest.raises(ValueError):
        cost.join_order(rows, {frozenset(("a", "b")): 1e-6})


def test_index_choice_needs_a_margin():
    table = cost.Cost(cpu=10.0)
    index = cost.IndexInfo("i", ("x",), distinct_keys=2)
    assert cost.choose_index([index], {"x"}, set(), {"x"}, 1, table)[0] == "i"
    assert cost.choose_index([index], {"x"}, set(), {"x"}, 1, cost.Cost(cpu=2.0))[0] is None
    assert cost.choose_index([index], {"x"}, set(), {"x"}, 1, table, ignore=frozenset(["i"]))[0] is None


def test_changes(spark):
    before = spark.createDataFrame([(1, "a", "m"), (2, "b", "m"), (3, "c", "m"), (4, "d", "m")], "id int, h string, m string")
    after = spark.createDataFrame([(2, "b", "m"), (3, "x", "m"), (4, "d", "n"), (5, "e", "m")], "id int, h string, m string")
    got = {r.id: r.change for r in backup.changes(before, after, "id", "h", ["m"]).collect()}
    assert got == {1: "Deleted", 2: "Unchanged", 3: "Content", 4: "Metadata", 5: "Created"}


def test_chunks_survive_an_insertion(spark):
    text = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz ", k=20_000))
    df = spark.createDataFrame([(1, text), (2, text[:9_000] + "INSERTED" + text[9_000:])], "id int, t string")
    chunks = backup.chunk_texts(df, "id", "t").collect()
    one, two = ({r.digest for r in chunks if r.key == k} for k in (1, 2))
    assert len(one & two) >= 0.6 * len(one)
    assert sum(r.size for r in chunks if r.key == 1) == len(text)


# --- streams


def test_streams_agree_with_batches(spark, tmp_path):
    from siltstone.streaming import streams

    events = spark.read.parquet(f"{DATA}/events.parquet").repartition(3)
    events.write.parquet(str(tmp_path / "in"))
    stream = streams.read_events(spark, str(tmp_path / "in"))
    got = streams.run_once(streams.tumbling(stream, "ts", "1 day", "event_type", "value"), "tumbling", str(tmp_path / "c1"))
    want = streams.tumbling(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", "event_type", "value")
    assert sorted(map(tuple, got.drop("avg_value").collect())) == sorted(map(tuple, want.drop("avg_value").collect()))


def test_log_folds_into_runs(spark, tmp_path):
    from siltstone.streaming import streams

    rows = [(i, "Put" if i % 5 else "Delete", f"k{i % 7}", str(i)) for i in range(60)]
    spark.createDataFrame(rows, "lsn long, op string, key string, value string").repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("lsn long, op string, key string, value string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream.writeStream.foreachBatch(streams.fold_into(str(tmp_path / "runs"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    runs = spark.read.parquet(str(tmp_path / "runs")).withColumn("is_deleted", F.col("op") == "Delete")
    got = {r.key: r.value for r in versions.latest(runs, ["key"], ["lsn"]).collect()}
    want = {}
    for lsn, op, key, value in rows:
        want[key] = value if op == "Put" else None
    assert got == {k: v for k, v in want.items() if v is not None}


# --- store


def test_store(spark, tmp_path):
    from siltstone.store import AsyncStore, Conflict, Refused, Store, WriteBatch

    store = Store(spark, str(tmp_path / "db"))
    store.put_batch([(f"key_{i:02d}", f"value_{i}") for i in range(20)])
    store.write_batch(WriteBatch().put("key_03", "a").delete("key_03").delete("key_04").put("key_04", "b"))
    assert store.get("key_03") is None and store.get("key_04") == b"b" and store.get_batch(["key_05", "none", "key_05"]) == [b"value_5", None, b"value_5"]
    assert store.delete("key_05") and not store.delete("key_05") and store.scan("key_00", "key_06").count() == 4 and store.scan_prefix("key_1").count() == 10
    assert store.compare_and_swap("key_00", "value_0", "x") and not store.compare_and_swap("key_00", "value_0", "y") and store.compare_and_swap("new", None, "1")
    a, b = store.begin(), store.begin()
    store.put_tx(a, "key_00", "from a")
    store.put_tx(b, "key_00", "from b")
    assert store.get("key_00") == b"x" and store.get_tx(a, "key_00") == b"from a" and store.get_tx(b, "key_01") == b"value_1"
    store.commit(a)
    with pytest.raises(Conflict):
        store.commit(b)
    assert store.active_transactions() == [] and store.get("key_00") == b"from a"
    live = store.stats()["live"]
    store.backup(str(tmp_path / "copy"))
    store.compact()
    assert store.stats()["live"] == store.stats()["versions"] == live and store.verify()
    again = Store(spark, str(tmp_path / "db"))
    assert again.get("key_00") == b"from a" and again.stats()["runs"] == 1
    other = Store(spark, str(tmp_path / "other"))
    other.restore(str(tmp_path / "copy"), until=20)
    assert other.stats()["live"] == 20 and other.get("key_05") == b"value_5"
    with pytest.raises(Refused):
        store.put("", "v")
    with pytest.raises(Refused):
        store.put("k" * 5000, "v")
    pool = AsyncStore(store, 2)
    assert pool.concurrent_gets(["key_00", "none"]) == [b"from a", None] and pool.pipeline(("put", "p", "1"), ("get", "p")) == [None, b"1"]
    pool.close()
