"""Scalar functions: arithmetic, casts, cases, codecs, content, tiers, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import codecs, content
from siltstone.operators.kv import successor
from siltstone.plans.builder import Builder
from siltstone.plans.spec import Agg, Binary, Call, Case, Cast, Col, Compare, Like, Lit, QuerySpec, Subquery, Unary
from siltstone.queries.tables import compiled, table
from siltstone.registry import register
from siltstone.sources.catalog import Catalog

C, L = Col, Lit
KEY = ("p_partkey", C("p_partkey"))


def scalar(name: str, expr, sql: str, source: str = "part", key=KEY) -> None:
    register(name, compiled(QuerySpec(source, select=(key, ("x", expr)))), f"SELECT {key[0]}, {sql} AS x FROM {source}")


size, price = C("p_size"), C("p_retailprice")
scalar("s_add", Binary("+", size, L(7)), "p_size + 7")
scalar("s_sub", Binary("-", size, L(7)), "p_size - 7")
scalar("s_mul", Binary("*", size, L(3)), "p_size * 3")
scalar("s_div", Call("round", (Binary("/", price, Binary("-", size, L(7))), L(4))), "round(p_retailprice / nullif(p_size - 7, 0), 4)")
scalar("s_mod", Binary("%", Binary("-", size, L(20)), L(7)), "(p_size - 20) % 7")
scalar("s_concat", Binary("concat", C("p_brand"), Call("nullif", (C("p_type"), L("x")))), "p_brand || p_type")
scalar("s_bitand", Binary("&", size, L(12)), "p_size & 12")
scalar("s_bitor", Binary("|", size, L(12)), "p_size | 12")
scalar("s_bitxor", Binary("^", size, L(12)), "xor(p_size, 12)")
scalar("s_not", Unary("not", Binary(">", size, L(12))), "NOT (p_size > 12)")
scalar("s_neg", Unary("neg", size), "-p_size")
scalar("s_bitnot", Unary("bitnot", size), "~p_size")
scalar("s_case", Case(((Compare("<", size, L(10)), L("small")), (Like(C("p_type"), "S%"), L("standard"))), L("other")), "CASE WHEN p_size < 10 THEN 'small' WHEN p_type LIKE 'S%' THEN 'standard' ELSE 'other' END")
scalar("s_function", Call("coalesce", (Call("nullif", (C("p_brand"), L("Brand#1"))), L("none"))), "coalesce(nullif(p_brand, 'Brand#1'), 'none')")
register(
    "s_cast",
    compiled(
        QuerySpec(
            "part",
            select=(
                KEY, ("a", Cast(size, "int8")), ("b", Cast(size, "int16")), ("c", Cast(price, "int32")), ("d", Cast(size, "float64")),
                ("e", Cast(size, "string")), ("f", Cast(price, "decimal(12,2)")), ("g", Cast(Binary("-", size, size), "bool")), ("h", Cast(C("p_name"), "int64", True)),
                ("i", Cast(L("2024-02-29"), "date")),
            ),
        )
    ),
    """SELECT p_partkey, p_size::TINYINT AS a, p_size::SMALLINT AS b, trunc(p_retailprice)::INT AS c, p_size::DOUBLE AS d, p_size::VARCHAR AS e, p_retailprice::DECIMAL(12,2) AS f,
    (p_size - p_size)::BOOL AS g, try_cast(p_name AS BIGINT) AS h, DATE '2024-02-29' AS i FROM part""",
)
register(
    "s_subquery",
    compiled(QuerySpec("part", where=Compare(">", price, Subquery(QuerySpec("part", aggregates=(Agg("avg", price, "m"),)))), select=(KEY,))),
    "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)",
)


# --- codecs
def s_composite(spark, folder):
    """Parts joined by a delimiter that is doubled inside them, and taken apart again."""
    rows = table(spark, folder, "part").select("p_partkey", F.concat("p_brand", F.lit(":"), "p_type").alias("a"), F.col("p_name").alias("b"))
    coded = rows.select("*", codecs.composite([F.col("a"), F.col("b")]).alias("key"))
    parts = codecs.split_composite()(F.col("key"))
    return coded.select("p_partkey", "key", (F.get(parts, F.lit(0)) == F.col("a")).alias("same_a"), (F.get(parts, F.lit(1)) == F.col("b")).alias("same_b"))


register("s_composite", s_composite, "SELECT p_partkey, p_brand || '::' || p_type || ':' || p_name AS key, true AS same_a, true AS same_b FROM part")
register(
    "s_varint",
    lambda s, d: table(s, d, "orders").select(
        "o_orderkey", codecs.varint_length(F.col("o_orderkey") * 1000).alias("length"), codecs.varint_value(codecs.varint_hex(F.col("o_orderkey") * 1000)).alias("back")
    ),
    "SELECT o_orderkey, CASE WHEN v < 128 THEN 1 WHEN v < 16384 THEN 2 WHEN v < 2097152 THEN 3 WHEN v < 268435456 THEN 4 ELSE 5 END AS length, v::BIGINT AS back FROM (SELECT o_orderkey, o_orderkey * 1000 AS v FROM orders)",
)
register("s_lcp", lambda s, d: codecs.common_prefix_of(table(s, d, "customer").select(F.concat(F.lit("cust:"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("key")), "key"), "SELECT left(lo, len(list_filter(range(1, length(lo) + 1), lambda i: left(lo, i) = left(hi, i)))) AS prefix FROM (SELECT min('cust:' || lpad(c_custkey::VARCHAR, 8, '0')) AS lo, max('cust:' || lpad(c_custkey::VARCHAR, 8, '0')) AS hi FROM customer)")
register("s_prefix_strip", lambda s, d: table(s, d, "part").select("p_partkey", codecs.strip_prefix(F.col("p_brand"), "Brand#1").alias("x")), "SELECT p_partkey, CASE WHEN starts_with(p_brand, 'Brand#1') THEN substr(p_brand, 8) ELSE 'ÿ' || p_brand END AS x FROM part")


def s_prefix_succ(spark, folder):
    """Rows between a prefix and its successor: those that begin with it."""
    end = successor(b"BUILD").decode()
    return table(spark, folder, "customer").where((F.col("c_mktsegment") >= "BUILD") & (F.col("c_mktsegment") < end)).select("c_custkey")


register("s_prefix_succ", s_prefix_succ, "SELECT c_custkey FROM customer WHERE starts_with(c_mktsegment, 'BUILD')")


def s_crc32(spark, folder):
    """Checksums of equal texts are equal, and of different ones mostly not."""
    rows = table(spark, folder, "nation").select("n_nationkey", F.crc32(F.encode("n_name", "UTF-8")).alias("x"))
    return rows.select("n_nationkey", (F.col("x") >= 0).alias("unsigned"), (F.length(F.hex("x")) <= 8).alias("short"))


register("s_crc32", s_crc32, "SELECT n_nationkey, true AS unsigned, true AS short FROM nation")


# --- content
def _described(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("t"))
    events = table(spark, folder, "events").select((F.col("event_id") + 1000000000000).alias("id"), F.col("props").alias("t"))
    other = table(spark, folder, "part").select((F.col("p_partkey") + 2000000000000).alias("id"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise(F.repeat(F.lit("é7"), 9)).alias("t"))
    return docs.union(events).union(other).withColumn("found", content.measures(F.col("t")))


_DESCRIBED_SQL = """(SELECT id, t, CASE WHEN length(t) = 0 THEN 0 ELSE (SELECT -sum(c / length(t) * log2(c / length(t))) FROM (SELECT length(t) - length(replace(t, ch, '')) AS c FROM (SELECT unnest(list_distinct(string_split(t, ''))) AS ch))) END AS bits,
  length(t) AS n FROM (SELECT doc_id AS id, text AS t FROM documents UNION ALL SELECT event_id + 1000000000000, props FROM events
  UNION ALL SELECT p_partkey + 2000000000000, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE repeat('é7', 9) END FROM part))"""


def _share(pattern: str) -> str:
    return f"length(regexp_replace(t, '[^{pattern}]', '', 'g')) / n"


_TYPE_SQL = f"""CASE WHEN n = 0 THEN 'Mixed' WHEN bits > 7.5 THEN 'Compressed'
  WHEN {_share(chr(92) + 'x20-' + chr(92) + 'x7E' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'r')} > 0.8 AND t[1] IN ('{{', '[') AND {_share('{}' + chr(92) + '[' + chr(92) + ']":,')} > 0.1 THEN 'Json'
  WHEN {_share(chr(92) + 'x20-' + chr(92) + 'x7E' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'r')} > 0.8 THEN 'Text'
  WHEN {_share('0-9.' + chr(92) + '-+eE')} > 0.6 THEN 'Numeric' ELSE 'Binary' END"""
register("s_entropy", lambda s, d: _described(s, d).select("id", F.round("found.bits", 5).alias("bits")), f"SELECT id, round(bits, 5) AS bits FROM {_DESCRIBED_SQL}")
register("s_dtype", lambda s, d: _described(s, d).select("id", content.data_type(F.col("t"), F.col("found")).alias("kind")), f"SELECT id, {_TYPE_SQL} AS kind FROM {_DESCRIBED_SQL}")
register("p_content", lambda s, d: _described(s, d).where(content.data_type(F.col("t"), F.col("found")) == "Json").select("id"), f"SELECT id FROM {_DESCRIBED_SQL} WHERE {_TYPE_SQL} = 'Json'")
register("s_space_saved", lambda s, d: table(s, d, "part").select("p_partkey", F.round(content.space_saved(F.col("p_retailprice"), F.col("p_size") * 40.0), 6).alias("x")), "SELECT p_partkey, round(greatest(p_retailprice - p_size * 40, 0) / p_retailprice * 100, 6) AS x FROM part")
register("s_efficiency", lambda s, d: table(s, d, "part").select("p_partkey", F.round(content.efficiency(F.col("p_retailprice"), F.col("p_size") * 1.0, F.col("p_size") - 1.0), 6).alias("x")), "SELECT p_partkey, round(CASE WHEN p_size > 1 THEN (1 - p_size / p_retailprice) / (p_size - 1) ELSE 0 END, 6) AS x FROM part")
register(
    "s_like_class",
    lambda s, d: s.createDataFrame([("%a%",), ("%a",), ("a%",), ("a",)], "pattern string").select("pattern", content.like_selectivity(F.col("pattern")).alias("x")),
    "SELECT pattern, x FROM (VALUES ('%a%', 0.5::DOUBLE), ('%a', 0.25), ('a%', 0.15), ('a', 0.05)) AS t(pattern, x)",
)

# --- tiers: an event type's user as an item, its events as accesses
_NOW = "TIMESTAMP '2024-01-31 00:00:00'"
_HEAT_SQL = f"""(SELECT user_id, reads, writes, 0.6 * 100 * exp(-age / 24) + 0.4 * least(100, reads + 2 * writes) AS heat, tier0 FROM (
  SELECT user_id, date_sub('second', max(ts), {_NOW}) / 3600.0 AS age, count(*) FILTER (event_type IN ('view', 'click')) / 2.0 AS reads, count(*) FILTER (event_type = 'purchase') / 2.0 AS writes,
  CASE user_id % 3 WHEN 0 THEN 'hot' WHEN 1 THEN 'warm' ELSE 'cold' END AS tier0, count(*) AS n FROM events GROUP BY user_id))"""


def _heat(spark, folder):
    events = table(spark, folder, "events")
    items = events.groupBy("user_id").agg(
        (F.timestamp_diff("SECOND", F.max("ts"), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")) / 3600.0).alias("age"),
        (F.count_if(F.col("event_type").isin("view", "click")) / 2.0).alias("reads"), (F.count_if(F.col("event_type") == "purchase") / 2.0).alias("writes"), F.count(F.lit(1)).alias("n"),
    )
    tier = F.when(F.col("user_id") % 3 == 0, "hot").when(F.col("user_id") % 3 == 1, "warm").otherwise("cold")
    return items.select("user_id", "reads", "writes", "n", content.hotness(F.col("age"), F.col("reads"), F.col("writes")).alias("heat"), tier.alias("tier0"))


_PLACE = lambda lo, hi, cost, latency: f"(CASE WHEN heat < {lo} THEN 100 - ({lo} - heat) WHEN heat > {hi} THEN 100 - (heat - {hi}) ELSE 100 END) * 0.8 + least(CASE WHEN reads > 0 THEN 1 / ({cost} * {latency}) ELSE 1 / {cost} END, 20) * 0.2"
register("s_hotness", lambda s, d: _heat(s, d).select("user_id", F.round("heat", 5).alias("heat")), f"SELECT user_id, round(heat, 5) AS heat FROM {_HEAT_SQL}")
register(
    "s_tier_place",
    lambda s, d: _heat(s, d).select("user_id", content.tier(F.col("heat")).alias("tier"), *[F.round(content.placement(F.col("heat"), F.col("reads"), t), 5).alias(t) for t in ("hot", "warm", "cold")]),
    f"SELECT user_id, CASE WHEN heat >= 75 THEN 'hot' WHEN heat >= 25 THEN 'warm' ELSE 'cold' END AS tier, round({_PLACE('75', '100', '0.25::DOUBLE', '50')}, 5) AS hot, round({_PLACE('25', '75', '0.1::DOUBLE', '200')}, 5) AS warm, round({_PLACE('0', '25', '0.023::DOUBLE', '5000')}, 5) AS cold FROM {_HEAT_SQL}",
)
register(
    "s_migrate",
    lambda s, d: _heat(s, d).select("user_id", "tier0", content.migrate(F.col("tier0"), F.col("heat")).alias("tier")),
    f"SELECT user_id, tier0, CASE WHEN tier0 = 'hot' AND heat < 50 THEN 'warm' WHEN tier0 = 'warm' AND heat > 80 THEN 'hot' WHEN tier0 = 'warm' AND heat < 10 THEN 'cold' WHEN tier0 = 'cold' AND heat > 30 THEN 'warm' ELSE tier0 END AS tier FROM {_HEAT_SQL}",
)
register(
    "agg_tier_stats",
    lambda s, d: _heat(s, d).groupBy("tier0").agg(F.count(F.lit(1)).alias("items"), F.sum("n").alias("accesses"), F.round(F.avg("heat"), 5).alias("avg_heat")),
    f"SELECT tier0, count(*) AS items, sum(n)::BIGINT AS accesses, round(avg(heat), 5) AS avg_heat FROM {_HEAT_SQL.replace('SELECT user_id, reads, writes,', 'SELECT user_id, reads, writes, n,', 1)} GROUP BY 1",
)
register("s_bloom_fpr", lambda s, d: table(s, d, "part").select("p_partkey", F.round(content.bloom_fpr(F.col("p_size") * 1000.0, F.lit(4000.0), F.lit(4.0)), 8).alias("x")), "SELECT p_partkey, round(pow(1 - exp(-4.0::DOUBLE * 4000 / (p_size * 1000)), 4), 8) AS x FROM part")
register(
    "s_bloom_params",
    lambda s, d: table(s, d, "part").select("p_partkey", content.bloom_bits(F.col("p_size") * 100, 0.01).cast("long").alias("bits")).join(table(s, d, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", "bits", content.bloom_hashes(F.col("bits"), F.col("p_size") * 100).alias("hashes")),
    "SELECT p_partkey, bits, greatest(1, round(bits / (p_size * 100) * ln(2)))::BIGINT AS hashes FROM (SELECT p_partkey, p_size, ceil(-(p_size * 100) * ln(0.01::DOUBLE) / pow(ln(2), 2))::BIGINT AS bits FROM part)",
)


def s_division_by_zero(spark, folder):
    """Division by zero gives NULL, never an error or infinity."""
    return Builder(Catalog(spark, folder)).build(QuerySpec("part", select=(KEY, ("x", Binary("/", price, Binary("-", size, size))))))


register("s_division_by_zero", s_division_by_zero, "SELECT p_partkey, NULL::DOUBLE AS x FROM part")
