"""Conflicts between transactions, as joins on their reads, writes and ranges.

Tables: txs(tx_id, start_ts, commit_ts), reads(tx_id, key), writes(tx_id, key),
ranges(tx_id, lo, hi).  Two transactions overlap if each began before the other
committed (commit_ts NULL: still running).  Times are numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.session import durable

LOCKS = ("intention_shared", "intention_exclusive", "shared", "shared_intention_exclusive", "update", "exclusive")
#: For each held lock, the locks that may be granted beside it.
COMPATIBLE = {
    "intention_shared": ("intention_shared", "intention_exclusive", "shared", "shared_intention_exclusive", "update"),
    "intention_exclusive": ("intention_shared", "intention_exclusive"),
    "shared": ("intention_shared", "shared", "update"),
    "shared_intention_exclusive": ("intention_shared",),
    "update": ("intention_shared", "shared"),
    "exclusive": (),
}


def _overlap(a: str, b: str) -> Column:
    begun = lambda x, y: F.col(f"{y}.commit_ts").isNull() | (F.col(f"{x}.start_ts") < F.col(f"{y}.commit_ts"))
    return begun(a, b) & begun(b, a)


#: Children of a node of time or keys (a power of two, by its exponent), and the
#: pairs per row that may be compared in vain before time is cut finer.
RADIX_BITS, PAIRS = 3, 64


def _nodes(lo: Column, hi: Column, top: int) -> Column:
    """The fewest nodes that cover the slots [lo, hi), each slot once: a node of
    level n stands for 2 ** (RADIX_BITS * n) slots, and levels end at ``top``."""
    none = F.array().cast("array<bigint>")
    run = lambda x, y: F.when(x < y, F.sequence(x, y - 1)).otherwise(none)
    up = lambda n: F.shiftright(lo + ((1 << RADIX_BITS * n) - 1), RADIX_BITS * n)
    down = lambda n: F.shiftright(hi, RADIX_BITS * n)
    parts = []
    for n in range(top + 1):
        part = run(up(n), down(n))
        if n < top:
            a, b = up(n + 1), down(n + 1)
            part = F.when(a < b, F.concat(run(up(n), F.shiftleft(a, RADIX_BITS)), run(F.shiftleft(b, RADIX_BITS), down(n)))).otherwise(part)
        parts.append(F.transform(part, lambda x: x * 64 + n))  # noqa: B023
    return F.concat(*parts)


def _above(slot: Column, top: int) -> Column:
    """The nodes that a slot lies in, one of each level."""
    return F.array(*[F.shiftright(slot, RADIX_BITS * n) * 64 + n for n in range(top + 1)])


def _timed(rows: DataFrame, txs: DataFrame) -> DataFrame:
    return durable(rows.join(txs.where("start_ts is not null").select("tx_id", "start_ts", "commit_ts"), "tx_id"))


def _meet(left: DataFrame, right: DataFrame, on: Column, key: str, unordered: bool = False) -> DataFrame:
    """(tx_a, tx_b, key) of rows a of left and b of right that share a cell, satisfy
    ``on`` and whose transactions differ and overlap; key is taken from side ``key``.

    Rows: tx_id, start_ts, commit_ts, cell, and what ``on`` needs.  Of two
    transactions that overlap, the later one begins while the earlier one runs: the
    time of the earlier one is taken apart into nodes, few even if it never ends,
    and the start of the later one lies in one of them, once.  Slots of time are as
    long as they may be without comparing more than PAIRS pairs per row in vain; if
    few rows share a cell that is all of time, and nothing is multiplied.
    ``unordered``: left and right are the same, and pairs are given once."""
    ends = left.select("start_ts").union(right.select("start_ts")).agg(F.min("start_ts").alias("lo"), F.max("start_ts").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    first, span = ends["lo"] or 0, float((ends["hi"] or 0) - (ends["lo"] or 0)) + 1.0
    top = 0
    slot = lambda c: F.least(F.floor((c - F.lit(first)) / F.lit(span / (1 << RADIX_BITS * top))), F.lit((1 << RADIX_BITS * top) - 1)).cast("long")
    while span > 1 << RADIX_BITS * top:
        of = lambda t, n: t.groupBy("cell", slot(F.col("start_ts")).alias("slot")).agg(F.count(F.lit(1)).cast("double").alias(n))
        pairs = of(left, "x").join(of(right, "y"), ["cell", "slot"]).agg(F.sum(F.col("x") * F.col("y"))).first()[0] or 0.0
        if pairs <= PAIRS * ends["n"]:
            break
        top += max(1, round(math.log(pairs / (PAIRS * ends["n"]), 1 << RADIX_BITS)))
    last = F.when(F.col("commit_ts").isNull(), F.lit((1 << RADIX_BITS * top) - 1)).otherwise(F.greatest(slot(F.col("start_ts")), slot(F.col("commit_ts"))))
    spans = lambda t: t.withColumn("node", F.explode(_nodes(slot(F.col("start_ts")), last + 1, top)))
    points = lambda t: t.withColumn("node", F.explode(_above(slot(F.col("start_ts")), top)))
    same = (F.col("a.cell") == F.col("b.cell")) & (F.col("a.node") == F.col("b.node")) & (F.col("a.tx_id") != F.col("b.tx_id")) & on & _overlap("a", "b")
    began, tie = F.col("a.start_ts") < F.col("b.start_ts"), F.col("a.start_ts") == F.col("b.start_ts")
    ids = [F.col("a.tx_id"), F.col("b.tx_id")]
    if unordered:
        both = spans(left).alias("a").join(points(right).alias("b"), same & (began | (tie & (ids[0] < ids[1]))))
        return both.select(F.least(*ids).alias("tx_a"), F.greatest(*ids).alias("tx_b"), F.col(f"{key}.key").alias("key"))
    out = lambda a, b, when: a.alias("a").join(b.alias("b"), same & when).select(ids[0].alias("tx_a"), ids[1].alias("tx_b"), F.col(f"{key}.key").alias("key"))
    return out(spans(left), points(right), began | tie).union(out(points(left), spans(right), F.col("b.start_ts") < F.col("a.start_ts")))


def _by_key(rows: DataFrame, txs: DataFrame) -> DataFrame:
    return _timed(rows.where("key is not null").select("tx_id", "key").distinct(), txs).withColumn("cell", F.col("key"))


def write_write(writes: DataFrame, txs: DataFrame) -> DataFrame:
    rows = _by_key(writes, txs)
    return _meet(rows, rows, F.lit(True), "a", unordered=True)


def read_write(reads: DataFrame, writes: DataFrame, txs: DataFrame) -> DataFrame:
    """tx_a read what tx_b wrote."""
    return _meet(_by_key(reads, txs), _by_key(writes, txs), F.lit(True), "a")


def _places(keys: DataFrame, bounds: DataFrame) -> DataFrame:
    """(value, place) of the values of keys and bounds: how many distinct keys lie
    below.  Sorted in ranges, each counted on from the ranges before it."""
    marks = keys.select(F.col("key").alias("value"), F.lit(1).alias("is_key")).union(bounds.select("value", F.lit(0)))
    dealt = marks.groupBy("value").agg(F.max("is_key").alias("is_key")).repartitionByRange("value")
    dealt = durable(dealt.withColumn("part", F.spark_partition_id()))
    sums = {r.part: r.n for r in dealt.groupBy("part").agg(F.sum("is_key").alias("n")).collect()}
    before, offsets = 0, []
    for part in sorted(sums):
        offsets += [F.lit(part), F.lit(before)]
        before += sums[part]
    over = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.sum("is_key").over(over) - F.col("is_key")
    return dealt.select("value", (upto + (F.create_map(*offsets)[F.col("part")] if offsets else 0)).cast("long").alias("place"))


def phantoms(ranges: DataFrame, writes: DataFrame, txs: DataFrame) -> DataFrame:
    """(tx_a, tx_b, key): tx_b wrote a key in a range [lo, hi) that tx_a scanned.

    Keys of any type are numbered in their order, and a range is taken apart into
    nodes of neighbouring keys as a transaction's time is."""
    ranges, writes = ranges.where("lo < hi").select("tx_id", "lo", "hi").distinct(), writes.where("key is not null").select("tx_id", "key").distinct()
    place = durable(_places(writes, ranges.select(F.explode(F.array("lo", "hi")).alias("value"))))
    at = lambda c: place.select(F.col("value").alias(c), F.col("place").alias(f"{c}_at"))
    a = durable(_timed(ranges, txs).join(at("lo"), "lo").join(at("hi"), "hi").where("lo_at < hi_at"))
    width = a.agg(F.percentile_approx(F.col("hi_at") - F.col("lo_at"), 0.5).alias("mid"), F.max(F.col("hi_at") - F.col("lo_at")).alias("most")).first()
    size = max(1, int(width["mid"] or 1))
    top = max(0, (int(width["most"] or 1) // size).bit_length() // RADIX_BITS)
    leaf = lambda c: F.floor(F.col(c) / size).cast("long")
    a = a.withColumn("cell", F.explode(_nodes(leaf("lo_at"), F.floor((F.col("hi_at") - 1) / size).cast("long") + 1, top)))
    b = _timed(writes, txs).join(at("key"), "key").withColumn("cell", F.explode(_above(leaf("key_at"), top)))
    inside = (F.col("b.key_at") >= F.col("a.lo_at")) & (F.col("b.key_at") < F.col("a.hi_at"))
    return _meet(durable(a), durable(b), inside, "b").distinct()


def write_skew(reads: DataFrame, writes: DataFrame, txs: DataFrame) -> DataFrame:
    """(tx_a, tx_b): each read something that the other wrote, and they wrote no
    key in common."""
    rw = read_write(reads, writes, txs).select("tx_a", "tx_b").distinct()
    back = rw.select(F.col("tx_b").alias("tx_a"), F.col("tx_a").alias("tx_b"))
    mutual = rw.join(back, ["tx_a", "tx_b"], "left_semi").where("tx_a < tx_b")
    return mutual.join(write_write(writes, txs).select("tx_a", "tx_b").distinct(), ["tx_a", "tx_b"], "left_anti")


def _trimmed(edges: DataFrame, rounds: int) -> DataFrame:
    """Edges without nodes that have no edge in or out, removed ``rounds`` times at
    most, and no longer than it takes off more than a fiftieth."""
    n = edges.count()
    for _ in range(rounds):
        inner = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        edges = durable(inner.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        before, n = n, edges.count()
        if n * 50 >= before * 49:
            break
    return edges


def _components(edges: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame] | None:
    """(node, color) of the strongly connected component of the largest node of
    each color, and the colors of all nodes; a color is the largest node that
    reaches a node.  None: more than ``rounds`` steps are needed."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    colors = durable(ends.withColumn("color", F.col("node")))
    for _ in range(rounds):
        heard = edges.join(colors.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("color").alias("heard"))
        step = durable(colors.join(heard, "node", "left").select("node", F.greatest("color", "heard").alias("color"), (F.col("heard") > F.col("color")).alias("changed")))
        colors = step.select("node", "color")
        if step.where("changed").isEmpty():
            break
    else:
        return None
    of = lambda end: colors.select(F.col("node").alias(end), F.col("color").alias(f"{end}_color"))
    inside = durable(edges.join(of("src"), "src").join(of("dst"), "dst").where("src_color = dst_color").select("src", "dst", F.col("src_color").alias("color")))
    members = durable(colors.where("node = color"))
    n = members.count()
    for _ in range(rounds):
        back = inside.join(members.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "color")
        members = durable(members.union(back.distinct()).distinct())
        before, n = n, members.count()
        if before == n:
            return members, colors
    return None


def cycles(edges: DataFrame, rounds: int = 16, least: int = 1) -> DataFrame:
    """Nodes that lie on a cycle of edges (src, dst) of any length.

    Strongly connected components are taken off by colors, each step a join with
    the edges; nothing larger than the edges is ever kept.  With ``least`` above 1,
    only components with as many nodes that are not negative.  Raises an error if a
    color still spreads after 2 ** rounds steps, or components are left after that
    many times."""
    edges = durable(edges.select("src", "dst").distinct())
    found = edges.where("src = dst").select(F.col("src").alias("node"))
    edges = edges.where("src <> dst")
    for _ in range(1 << rounds):
        edges = _trimmed(edges, rounds)
        if edges.isEmpty():
            return found.distinct()
        parts = _components(edges, 1 << rounds)
        if parts is None:
            break
        members, colors = parts
        size = F.count_if(F.col("node") >= 0) if least > 1 else F.count(F.lit(1))
        whole = members.groupBy("color").agg(size.alias("n")).where(F.col("n") >= max(2, least))
        found = durable(found.union(members.join(whole, "color", "left_semi").select("node")))
        rest = colors.join(members.select("node"), "node", "left_anti")
        of = lambda end: rest.select(F.col("node").alias(end), F.col("color").alias(f"{end}_color"))  # noqa: B023, E731
        edges = durable(edges.join(of("src"), "src").join(of("dst"), "dst").where("src_color = dst_color").select("src", "dst"))
    raise RuntimeError(f"cycles longer than {1 << rounds} steps")


def first_committer(writes: DataFrame, versions: DataFrame, txs: DataFrame) -> DataFrame:
    """(tx_id, aborts): a transaction aborts if a key that it writes has a version
    by another transaction newer than its read time."""
    newest = versions.select(F.col("key"), F.col("tx_id").alias("by"), "ts")
    clash = writes.join(txs, "tx_id").join(newest, "key").where((F.col("by") != F.col("tx_id")) & (F.col("ts") > F.col("start_ts"))).select("tx_id").distinct()
    return txs.select("tx_id").join(clash.withColumn("c", F.lit(True)), "tx_id", "left").select("tx_id", F.coalesce("c", F.lit(False)).alias("aborts"))


def validate(txs: DataFrame, level: Column, ww: DataFrame, rw: DataFrame, phantom: DataFrame) -> DataFrame:
    """(tx_id, level, verdict): which conflicts count depends on the level; under
    snapshot a write conflict is worth a retry."""

    def ends(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.explode(F.array("tx_a", "tx_b")).alias("tx_id")).distinct().withColumn(name, F.lit(True))

    out = txs.select("tx_id", level.alias("level"))
    for df, name in ((ww, "ww"), (rw, "rw"), (phantom, "ph")):
        out = out.join(ends(df, name), "tx_id", "left")
    out = out.fillna(False, ["ww", "rw", "ph"])
    counts = (
        F.when(F.col("level") == "read_uncommitted", F.lit(False))
        .when(F.col("level").isin("read_committed", "snapshot"), F.col("ww"))
        .when(F.col("level") == "repeatable_read", F.col("ww") | F.col("rw"))
        .otherwise(F.col("ww") | F.col("rw") | F.col("ph"))
    )
    verdict = F.when(~counts, "Valid").when(F.col("level") == "snapshot", "Retry").otherwise("Invalid")
    return out.select("tx_id", "level", verdict.alias("verdict"))


def lock_matrix(spark) -> DataFrame:
    rows = [(held, wanted, wanted in COMPATIBLE[held]) for held in LOCKS for wanted in LOCKS]
    return spark.createDataFrame(rows, "held string, wanted string, compatible boolean")


def waits_for(requests: DataFrame, held: DataFrame) -> DataFrame:
    """requests(tx_id, key, mode) that are blocked by held(tx_id, key, mode): (src, dst)."""
    matrix = F.broadcast(lock_matrix(requests.sparkSession))
    a = requests.select(F.col("tx_id").alias("src"), "key", F.col("mode").alias("wanted"))
    b = held.select(F.col("tx_id").alias("dst"), "key", F.col("mode").alias("held"))
    both = a.join(b, "key").where("src <> dst").join(matrix, ["held", "wanted"])
    return both.where("not compatible").select("src", "dst").distinct()


def wait_cycles(requests: DataFrame, held: DataFrame) -> DataFrame:
    """Nodes of ``waits_for`` on cycles, without its edges: a transaction points at
    what it asks for (key, mode), and that at the holders in its way, so there are as
    many edges as requests and locks, not their product on each key.

    A transaction that only meets itself there, on a key that it holds and asks for,
    waits for nobody: it is on a cycle if another one is in its component."""
    spark = requests.sparkSession
    requests, held = requests.select("tx_id", "key", "mode").distinct(), held.select("tx_id", "key", "mode").distinct()
    asked = durable(requests.where("key is not null").join(held.select("key").distinct(), "key", "left_semi"))
    places = durable(asked.select("key", "mode").distinct().select("key", "mode", (-1 - F.monotonically_increasing_id()).alias("place")))
    ids = durable(asked.select("tx_id").union(held.select("tx_id")).distinct().select("tx_id", F.monotonically_increasing_id().alias("id")))
    out = asked.join(places, ["key", "mode"]).join(ids, "tx_id").select(F.col("id").alias("src"), F.col("place").alias("dst"))
    blocked = F.broadcast(lock_matrix(spark).where("not compatible").select(F.col("held").alias("mode"), "wanted"))
    back = held.join(ids, "tx_id").join(blocked, "mode").join(places.withColumnRenamed("mode", "wanted"), ["key", "wanted"])
    edges = out.union(back.select(F.col("place").alias("src"), F.col("id").alias("dst")))
    found = cycles(edges, least=2)
    return ids.join(found.where("node >= 0").withColumnRenamed("node", "id"), "id", "left_semi").select(F.col("tx_id").alias("node"))


def youngest(nodes: DataFrame) -> DataFrame:
    """The youngest transaction (largest id), if there is one."""
    return nodes.agg(F.max("node").alias("victim")).where("victim is not null")


def deadlock_victims(edges: DataFrame) -> DataFrame:
    """The youngest transaction of those on wait cycles."""
    return youngest(cycles(edges))
