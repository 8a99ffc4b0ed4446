"""What grew faster than its input: small cases of it, against brute force."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import siltstone.queries  # noqa: F401
from siltstone import registry
from siltstone.functions import content, metrics
from siltstone.operators import conflicts
from siltstone.plans.builder import Builder
from siltstone.plans.spec import Col, Compare, Join, QuerySpec
from siltstone.sources.catalog import Catalog
from tests.conftest import DATA
from tests.test_faults import plan
from tests.test_whole import on_cycles


def _meet(txs, a, b) -> bool:
    end = lambda t: float("inf") if txs[t][1] is None else txs[t][1]
    return a != b and txs[a][0] < end(b) and txs[b][0] < end(a)


@pytest.mark.parametrize("seed, pairs, scale", [(1, 64, 10**11), (2, 0.01, 10**11), (3, 0.01, 1)])
def test_long_times_between_transactions(spark, monkeypatch, seed, pairs, scale):
    """Running transactions over 10 ** 13 ticks beside short ones, at all depths of the cut."""
    monkeypatch.setattr(conflicts, "PAIRS", pairs)
    rng = random.Random(seed)
    txs = {t: (s := rng.randrange(100) * scale, None if rng.random() < 0.3 else s + rng.choice([0, 1, 20, 30 * scale])) for t in range(40)}
    access = lambda n: sorted({(rng.randrange(40), rng.choice("abcdefgh")) for _ in range(n)})
    reads, writes = access(80), access(80)
    ranges = [(t, lo, chr(ord(lo) + rng.randrange(6))) for t in range(40) for lo in rng.sample("abcdefgh", 2)]
    frame = spark.createDataFrame([(t, *x) for t, x in txs.items()], "tx_id long, start_ts long, commit_ts long")
    of = lambda rows: spark.createDataFrame(rows, "tx_id long, key string")
    got = [tuple(r) for r in conflicts.write_write(of(writes * 2), frame).collect()]
    want = {(a, b, k) for a, k in writes for b, x in writes if k == x and a < b and _meet(txs, a, b)}
    assert len(got) == len(want) and set(got) == want
    got = [tuple(r) for r in conflicts.read_write(of(reads), of(writes), frame).collect()]
    want = {(a, b, k) for a, k in reads for b, x in writes if k == x and _meet(txs, a, b)}
    assert len(got) == len(want) and set(got) == want
    got = [tuple(r) for r in conflicts.phantoms(spark.createDataFrame(ranges, "tx_id long, lo string, hi string"), of(writes), frame).collect()]
    want = {(a, b, k) for a, lo, hi in ranges for b, k in writes if lo <= k < hi and _meet(txs, a, b)}
    assert len(got) == len(want) and set(got) == want


def test_a_nested_join_on_keys_makes_no_product(spark):
    catalog = Catalog(spark)
    catalog.register("a", spark.createDataFrame([(1, 10), (2, 20), (3, 20), (4, None), (5, 99)], "x long, k long"))
    catalog.register("b", spark.createDataFrame([(10, 1), (20, 2), (20, 3), (None, 4)], "id long, v long"))
    build = lambda *parts: Builder(catalog).build(QuerySpec("a", joins=(Join("b", *parts, strategy="nested"),)))
    got = build("inner", (("k", "id"),))
    assert "Cartesian" not in plan(got) and "NestedLoop" not in plan(got)
    assert sorted((r.x, r.v) for r in got.collect()) == [(1, 1), (2, 2), (2, 3), (3, 2), (3, 3)]
    theta = build("inner", (), Compare("<", Col("k"), Col("id")))
    assert "Cartesian" in plan(theta) and sorted((r.x, r.v) for r in theta.collect()) == [(1, 2), (1, 3)]


@pytest.mark.parametrize("seconds", [60, 3600, 5000])
def test_trailing_windows_are_not_gathered(spark, seconds):
    rng = random.Random(seconds)
    rows = [(i, rng.randrange(20_000), rng.choice("ab"), None if rng.random() < 0.1 else rng.randrange(3000) / 100) for i in range(600)]
    rows += [(600, 15_000, "a", 1.0), (601, 15_000 - seconds, "a", 2.0), (602, 15_000, "c", None)]
    df = spark.createDataFrame(rows, "id long, s long, g string, v double").withColumn("t", F.timestamp_seconds("s"))
    out = metrics.trailing(df, "t", "v", "g", seconds)
    assert "collect_list" not in plan(out) and "Window" not in plan(out)
    got = {r.id: r for r in out.collect()}
    assert len(got) == len(rows)
    for i, s, g, _ in rows:
        seen = sorted(v for _, x, h, v in rows if h == g and s - seconds <= x <= s and v is not None)
        r, n = got[i], len(seen)
        assert r.n == n and r.per_sec == pytest.approx(n / seconds)
        assert (r.p95, r.p99) == ((seen[int(n * 0.95)], seen[int(n * 0.99)]) if n else (None, None))
        assert r.avg == (pytest.approx(sum(seen) / n, abs=1e-9) if n else None)


def test_characters_are_counted_once(spark):
    rng = random.Random(5)
    texts = ["", "a", "aaaa", '{"k": [1, 2]}', "é7" * 9, "1.5e-3", "\t\n\r\x00\x7f", "😀😀b", "".join(rng.choices("abé漢😀{", k=5000)), "".join(map(chr, range(0x1000, 0x1900))), None, "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.m for r in df.select("i", content.measures(F.col("t")).alias("m")).collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert got[i] is None
            continue
        bits = -sum(c / len(t) * math.log2(c / len(t)) for c in Counter(t).values())
        classes = [sum(c in chars for c in t) for chars in ("".join(map(chr, range(32, 127))) + "\t\n\r", '{}[]":,', "0123456789.-+eE")]
        assert [got[i].chars, got[i].printable, got[i].json_marks, got[i].numeric] == [len(t), *classes] and got[i].bits == pytest.approx(bits, abs=1e-12)
    for name in ("s_entropy", "s_dtype", "p_content"):
        text = plan(registry.QUERIES[name](spark, DATA))
        assert "ArrowEvalPython" in text and "array_distinct" not in text and "regexp_replace" not in text


@pytest.mark.parametrize("seed", [1, 2])
def test_wait_cycles_without_edges_between_all(spark, seed):
    """Few locks, so that some transactions only wait for themselves."""
    rng = random.Random(seed)
    of = lambda n: [(rng.randrange(30), rng.choice("abcdefghijklmnopqrst"), rng.choice(conflicts.LOCKS)) for _ in range(n)]
    held = of(16) + [(90, "z", "exclusive"), (91, "y", "exclusive")]
    asked = of(16) + [(90, "z", "exclusive"), (91, "z", "shared"), (92, "y", "shared")]
    edges = {(a, b) for a, k, x in asked for b, l, y in held if k == l and a != b and x not in conflicts.COMPATIBLE[y]}
    frame = lambda rows: spark.createDataFrame(rows, "tx_id long, key string, mode string")
    got = [r.node for r in conflicts.wait_cycles(frame(asked), frame(held)).collect()]
    assert len(got) == len(set(got)) and set(got) == on_cycles(edges) and not {90, 91, 92} & set(got)
