"""Plans and values that were once wrong: each stays mended."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import siltstone.queries  # noqa: F401
from siltstone import registry
from siltstone.operators import conflicts
from siltstone.operators.kv import KeyValue, NamedNumberKey, NumberKey
from siltstone.plans.builder import Builder, SpecError
from siltstone.plans.spec import Agg, Col, Compare, Exchange, Join, Lit, QuerySpec
from siltstone.sources import wal
from siltstone.sources.catalog import Catalog
from tests.conftest import DATA


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_nothing_to_concatenate_is_null(spark):
    catalog = Catalog(spark)
    catalog.register("t", spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, None)], "k int, v string"))
    got = Builder(catalog).build(QuerySpec("t", group_by=(("k", Col("k")),), aggregates=(Agg("group_concat", Col("v"), "x"),)))
    assert {r.k: r.x for r in got.collect()} == {1: "a,b", 2: None}


def test_checksums_tell_fields_apart(spark):
    rows = [(1, "Put", "a", None, 1), (1, "Put", None, "a", 1), (1, "Put", "a", "", 1), (1, "Put", "a|b", "c", 1), (1, "Put", "a", "b|c", 1)]
    log = spark.createDataFrame(rows, "lsn long, op string, key string, value string, tx_id long")
    assert log.select(wal.checksum().alias("c")).distinct().count() == len(rows)


def _brute_conflicts(txs, ranges, writes):
    end = lambda t: float("inf") if txs[t][1] is None else txs[t][1]
    meet = lambda a, b: txs[a][0] < end(b) and txs[b][0] < end(a)
    return {(a, b, k) for a, lo, hi in ranges for b, k in writes if a != b and lo <= k < hi and meet(a, b)}


@pytest.mark.parametrize("seed", range(3))
def test_running_transactions_meet_without_a_cartesian_product(spark, seed):
    rng = random.Random(seed)
    txs = {t: (s := rng.randrange(200), None if rng.random() < 0.2 else s + rng.randint(1, 30)) for t in range(40)}
    ranges = [(t, lo := rng.randrange(30), lo + rng.randint(1, 8)) for t in range(40)]
    writes = sorted({(rng.randrange(40), rng.randrange(35)) for _ in range(80)})
    frame = spark.createDataFrame([(t, *x) for t, x in txs.items()], "tx_id long, start_ts long, commit_ts long")
    got = conflicts.phantoms(spark.createDataFrame(ranges, "tx_id long, lo long, hi long"), spark.createDataFrame(writes, "tx_id long, key long"), frame)
    assert {tuple(r) for r in got.collect()} == _brute_conflicts(txs, ranges, writes)
    assert "Cartesian" not in plan(got)


def test_long_cycles_are_found(spark):
    ring = spark.createDataFrame([(i, (i + 1) % 50) for i in range(50)] + [(100, 101)], "src long, dst long")
    assert {r.node for r in conflicts.cycles(ring, 6).collect()} == set(range(50))


def test_a_get_and_a_prefix_bound_the_scan(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("n"), F.element_at(F.array(F.lit("AB"), F.lit("A"), F.lit("B:C")), (F.col("id") % 3 + 1).cast("int")).alias("name"))
    rows.write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    numbers = KeyValue.of(table, NumberKey("k:", "n", 6), F.col("name"))
    plain = KeyValue(numbers.frame)
    get = numbers.get("k:000042")
    assert [r.value for r in get.collect()] == ["AB"]
    assert "LessThanOrEqual(n,42)" in plan(get) and "GreaterThanOrEqual(n,42)" in plan(get)
    for prefix in ("k", "k:", "k:0", "k:00004", "k:000042", "k:0000420", "k:x", "other"):
        assert numbers.prefix(prefix).collect() == plain.prefix(prefix).collect()
    assert "GreaterThanOrEqual(n,40)" in plan(numbers.prefix("k:00004"))
    named = KeyValue.of(table, NamedNumberKey("c:", "name", ":", "n", 4), F.col("n").cast("string"))
    plain = KeyValue(named.frame)
    for prefix in ("c", "c:", "c:A", "c:A:", "c:AB:00", "c:B", "c:B:", "c:B:C", "c:B:C:", "c:B:C:0002", "c:Z", "d"):
        assert named.prefix(prefix).collect() == plain.prefix(prefix).collect(), prefix
    for start, end in (("c:A", "c:B"), ("c:AB", None), (None, "c:AB"), ("c:A:0005", "c:B:C:0008"), ("c:AA", "c:AZ"), (None, None)):
        assert named.scan(start, end).collect() == plain.scan(start, end).collect(), (start, end)
    assert "EqualTo(name,A)" in plan(named.prefix("c:A:"))


def test_a_stored_index_is_read_and_maintained(spark, tmp_path):
    rows = [(i, i % 7) for i in range(100)]
    catalog = Catalog(spark)
    catalog.register("t", spark.createDataFrame(rows, "id long, k long"))
    index = catalog.create_index("i", "t", ["k"], "id", path=str(tmp_path / "i"))
    assert "PushedFilters: [IsNotNull(index_key), EqualTo(index_key,3)]" in plan(index.key(3))
    assert {r.id for r in index.lookup(3).collect()} == {i for i, k in rows if k == 3}
    moved = [(3, 3)], [(3, 6)]
    after = [(200, 3), *((i, 6 if i == 3 else k) for i, k in rows if i != 10)]
    frame = lambda x: spark.createDataFrame(x, "id long, k long")
    catalog.maintain("t", frame(after), str(tmp_path / "j"), inserted=frame([(200, 3), *moved[1]]), deleted=frame([(10, 3), *moved[0]]))
    index = catalog.index("i")
    assert sorted((r.primary_key, r.index_key) for r in index.entries().collect()) == sorted(after)
    assert index.stored is not None and {r.id for r in index.lookup(6).collect()} == {i for i, k in after if k == 6}


def test_an_index_join_goes_through_the_index(spark, tmp_path):
    catalog = Catalog(spark)
    catalog.register("a", spark.createDataFrame([(1, 10), (2, 20), (3, 99), (4, None)], "x long, k long"))
    catalog.register("b", spark.createDataFrame([(10, "p"), (20, "q"), (30, "r")], "id long, v string"))
    spec = lambda kind: QuerySpec("a", joins=(Join("b", kind, (("k", "id"),), strategy="index"),))
    with pytest.raises(SpecError):
        Builder(catalog).build(spec("inner"))
    catalog.create_index("i", "b", ["id"], "id", path=str(tmp_path / "i"))
    got = Builder(catalog).build(spec("inner"))
    assert got.columns == ["x", "k", "id", "v"] and sorted(map(tuple, got.collect())) == [(1, 10, 10, "p"), (2, 20, 20, "q")]
    assert Builder(catalog).build(spec("left")).count() == 4 and plan(got).count("Join") > plan(Builder(catalog).build(QuerySpec("a", joins=(Join("b", "inner", (("k", "id"),)),)))).count("Join")
    with pytest.raises(SpecError):
        Builder(catalog).build(spec("full"))


@pytest.mark.parametrize("exchange, n", [(Exchange("gather"), 1), (Exchange("repartition", 5, (Col("id"),)), 5), (Exchange("round_robin", 3), 3)])
def test_exchanges(spark, exchange, n):
    catalog = Catalog(spark)
    catalog.register("t", spark.range(100, numPartitions=4).toDF("id"))
    out = Builder(catalog).build(QuerySpec("t", where=Compare("<", Col("id"), Lit(50)), exchange=exchange))
    assert out.count() == 50 and out.rdd.getNumPartitions() == n
    for wrong in (Exchange("repartition"), Exchange("round_robin"), Exchange("other")):
        with pytest.raises(SpecError):
            Builder(catalog).build(QuerySpec("t", exchange=wrong))


def test_streams_keep_nothing_on_the_driver(spark):
    out = registry.QUERIES["stream_sliding"](spark, DATA)
    assert "LocalTableScan" not in plan(out) and "Scan parquet" in plan(out)


def test_settings_are_put_back(spark):
    from siltstone.session import durable

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    durable(spark.range(5))
    assert spark.conf.get(key, None) == before
