"""Aggregates, as specifications where the algebra has them."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import content, metrics, stats
from siltstone.plans.spec import Agg, Binary, Call, Case, Col, Compare, Lit, Not, QuerySpec
from siltstone.queries.tables import compiled, table
from siltstone.registry import register

C, L = Col, Lit
BY = (("l_returnflag", C("l_returnflag")), ("l_linestatus", C("l_linestatus")))
#: a quantity of 1 stands in for NULL
some = Call("nullif", (C("l_quantity"), L(1.0)))
for fn, alias, sql in (
    ("count", "n", "count(nullif(l_quantity, 1))"), ("sum", "s", "sum(nullif(l_quantity, 1))"), ("avg", "a", "avg(nullif(l_quantity, 1))"),
    ("min", "lo", "min(nullif(l_quantity, 1))"), ("max", "hi", "max(nullif(l_quantity, 1))"),
    ("stddev", "sd", "stddev_samp(nullif(l_quantity, 1))"), ("variance", "v", "var_samp(nullif(l_quantity, 1))"),
):
    rounded = tuple((n, C(n)) for n, _ in BY) + ((alias, Call("round", (C(alias), L(6))) if fn in ("avg", "stddev", "variance") else C(alias)),)
    register(
        f"agg_{fn}",
        compiled(QuerySpec("lineitem", group_by=BY, aggregates=(Agg(fn, some, alias),), select=rounded)),
        f"SELECT l_returnflag, l_linestatus, {f'round({sql}, 6)' if fn in ('avg', 'stddev', 'variance') else sql} AS {alias} FROM lineitem GROUP BY 1, 2",
    )
register("agg_count_star", compiled(QuerySpec("lineitem", aggregates=(Agg("count", None, "n"),))), "SELECT count(*) AS n FROM lineitem")
register(
    "agg_group_concat",
    compiled(QuerySpec("nation", group_by=(("n_regionkey", C("n_regionkey")),), aggregates=(Agg("group_concat", C("n_name"), "names", "; "),))),
    "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name) AS names FROM nation GROUP BY 1",
)
register(
    "agg_percentile",
    compiled(QuerySpec("lineitem", group_by=BY[:1], aggregates=(Agg("percentile", C("l_extendedprice"), "p", 0.9),), select=(("l_returnflag", C("l_returnflag")), ("p90", Call("round", (C("p"), L(4))))))),
    "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY 1",
)
register(
    "agg_group_by",
    compiled(QuerySpec("lineitem", group_by=(("big", Case(((Compare(">", C("l_quantity"), L(25)), L("big")),), L("small"))), ("k", Binary("%", C("l_orderkey"), L(7)))), aggregates=(Agg("count", None, "n"), Agg("sum", C("l_quantity"), "q")))),
    "SELECT CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END AS big, l_orderkey % 7 AS k, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2",
)
register(
    "agg_having",
    compiled(QuerySpec("orders", group_by=(("o_custkey", C("o_custkey")),), aggregates=(Agg("count", None, "n"),), having=Compare(">", C("n"), L(15)))),
    "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15",
)

_SUMS = (Agg("count", None, "n"), Agg("sum", C("l_quantity"), "q"))
for _kind in ("rollup", "cube"):
    register(
        f"agg_{_kind}",
        compiled(QuerySpec("lineitem", group_by=BY, aggregates=_SUMS, grouping=_kind)),
        f"SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY {_kind.upper()} (l_returnflag, l_linestatus)",
    )
_LARGE = Compare(">", C("l_quantity"), L(40))
register(
    "agg_filter",
    compiled(QuerySpec("lineitem", group_by=BY, aggregates=(Agg("count", None, "n", where=_LARGE), Agg("sum", C("l_linenumber"), "s", where=_LARGE), Agg("max", C("l_quantity"), "m", where=Not(_LARGE))))),
    "SELECT l_returnflag, l_linestatus, count(*) FILTER (l_quantity > 40) AS n, sum(l_linenumber) FILTER (l_quantity > 40) AS s, max(l_quantity) FILTER (NOT l_quantity > 40) AS m FROM lineitem GROUP BY 1, 2",
)
register(
    "agg_group_concat_empty",
    compiled(QuerySpec("nation", group_by=(("n_regionkey", C("n_regionkey")),), aggregates=(Agg("group_concat", C("n_name"), "names", "; ", where=Compare("<", C("n_nationkey"), L(4))),))),
    "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name) FILTER (n_nationkey < 4) AS names FROM nation GROUP BY 1",
)
register("agg_distinct_count", compiled(QuerySpec("lineitem", group_by=BY[:1], aggregates=(Agg("count_distinct", C("l_suppkey"), "n"),))), "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1")

# --- column profiles
PROFILED = ("o_orderstatus", "o_orderpriority", "o_custkey")


def _profiles(spark, folder):
    orders, out = table(spark, folder, "orders").withColumn("o_orderstatus", F.nullif(F.col("o_orderstatus"), F.lit("P"))), None
    for c in PROFILED:
        p = stats.profile(orders, c).withColumn("column", F.lit(c))
        out = p if out is None else out.union(p)
    return out


_PROFILES_SQL = "(" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count(x) AS nulls, count(DISTINCT x) AS d, avg(length(x::VARCHAR)) AS l, min(x::VARCHAR) AS lo, max(x::VARCHAR) AS hi FROM (SELECT {'nullif(' + c + chr(44) + chr(39) + 'P' + chr(39) + ')' if c == 'o_orderstatus' else c} AS x FROM orders)"
    for c in PROFILED
) + ")"
register("agg_null_fraction", lambda s, d: _profiles(s, d).select("column", "nulls", F.round("null_fraction", 6).alias("null_fraction")), f'SELECT "column", nulls, round(nulls / rows, 6) AS null_fraction FROM {_PROFILES_SQL}')
register("agg_avg_length", lambda s, d: _profiles(s, d).select("column", F.round("avg_length", 6).alias("avg_length")), f'SELECT "column", round(l, 6) AS avg_length FROM {_PROFILES_SQL}')
register("agg_minmax", lambda s, d: _profiles(s, d).select("column", "distinct_count", "min_value", "max_value"), f'SELECT "column", d AS distinct_count, lo AS min_value, hi AS max_value FROM {_PROFILES_SQL}')
register("agg_mcv", lambda s, d: stats.most_common(table(s, d, "lineitem"), "l_suppkey", 10), "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")

_EH = """WITH r AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM orders),
  b AS (SELECT v, least(i // (n // greatest(1, least(256, n // 10))), greatest(1, least(256, n // 10)) - 1) AS bucket FROM r)
  SELECT bucket, max(v) AS boundary, count(*)::BIGINT AS n, count(DISTINCT v) AS distinct_n FROM b GROUP BY 1"""
register("agg_histogram_eh", lambda s, d: stats.histogram_equal_height(table(s, d, "orders"), "o_totalprice"), _EH)
register(
    "agg_histogram_ew",
    lambda s, d: stats.histogram_equal_width(table(s, d, "part"), "p_size", 10).select("bucket", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n"),
    """WITH m AS (SELECT min(p_size) AS lo, max(p_size) AS hi, (max(p_size) - min(p_size)) / 10 AS w FROM part)
    SELECT least(floor((p_size - lo) / w), 9)::INT AS bucket, round(lo + least(floor((p_size - lo) / w), 9) * w, 6) AS low, round(lo + (least(floor((p_size - lo) / w), 9) + 1) * w, 6) AS high, count(*) AS n
    FROM part, m GROUP BY 1, 2, 3""",
)
register("agg_correlation", lambda s, d: stats.correlation(table(s, d, "lineitem"), "l_extendedprice", F.col("l_quantity")).select(F.round("correlation", 6).alias("correlation")), "SELECT round(coalesce(corr(l_extendedprice, l_quantity), 0), 6) AS correlation FROM lineitem")

# --- content
_ENTROPY_SQL = """(SELECT page_id, -sum(c / n * log2(c / n)) AS e FROM (SELECT page_id, n, b, count(*) AS c FROM (
   SELECT page_id, strlen(url) AS n, unnest(string_split(regexp_replace(hex(encode(url)), '(..)', '\\1,', 'g'), ',')) AS b FROM pages) WHERE b <> '' GROUP BY 1, 2, 3) GROUP BY 1)"""
register("agg_entropy", lambda s, d: content.entropy(table(s, d, "pages"), "page_id", "url").select("page_id", F.round("entropy", 6).alias("entropy")), f"SELECT page_id, round(e, 6) AS entropy FROM {_ENTROPY_SQL}")
register(
    "agg_mode",
    lambda s, d: table(s, d, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).groupBy("l_returnflag").agg(F.max_by("l_linenumber", F.struct(F.col("n"), -F.col("l_linenumber"))).alias("mode")),
    "SELECT l_returnflag, l_linenumber AS mode FROM (SELECT l_returnflag, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_linenumber) AS r FROM lineitem GROUP BY 1, 2) WHERE r = 1",
)
register("agg_running_avg", lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("avg_value"), F.count(F.lit(1)).alias("n")), "SELECT event_type, round(avg(value), 6) AS avg_value, count(*) AS n FROM events GROUP BY 1")
register(
    "agg_pct_nearest",
    lambda s, d: metrics.percentile_by_group(table(s, d, "events"), "event_type", "value", {"p95": 0.95, "p99": 0.99}),
    """SELECT event_type, min(value) FILTER (i = floor(n * 0.95)) AS p95, min(value) FILTER (i = floor(n * 0.99)) AS p99
    FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY 1""",
)
register(
    "agg_by_type",
    lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("props")).alias("bytes"), F.round(F.avg("value"), 6).alias("avg_duration"), F.round(F.avg((F.col("value") > 50).cast("int")), 6).alias("success")),
    "SELECT event_type, count(*) AS n, sum(strlen(props))::BIGINT AS bytes, round(avg(value), 6) AS avg_duration, round(avg((value > 50)::INT), 6) AS success FROM events GROUP BY 1",
)
