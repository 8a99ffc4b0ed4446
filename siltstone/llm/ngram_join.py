"""N-gram Jaccard join with prefix trees.

A document's set holds its distinct SIZE-word shingles (lower-cased; a shorter
document's whole sequence is its only one).  Two documents link when
100 * |A & B| >= THRESHOLD * |A | B|; the result is the connected components.

1. In blocks of documents, equal sets become one.  Sets are kept in one global
   order (by hash).  For a set of n, any partner shares a = ceil(0.75 n) shingles
   at least, so of the first n - a + l shingles in that order, l are shared; here
   l = ceil(n / 4), which makes g = ceil(a / 4) a bound that holds for both.  The
   first shingles go out, distinct per block, and come back if another set has
   them.  A set with fewer than g shared ones has no partner: only sets that have
   copies or near copies go on.
2. Among these all shingles are counted.  A set of which fewer than a are shared
   goes as well; of the others, the n - a + 1 rarest, of which any partner has
   one, bring the candidates.  So passages that many documents share bring none.
3. The sets that have one shingle in common are compared with one of them, the
   leader: that whose shingles are shared most, as the text that the others are
   copies of.  A leader's candidates are stored in a trie in an order common to all
   of them; it is traversed once with the leader's set, partial overlaps are
   shared along the paths, and a subtree ends where the shingles left in its
   longest set cannot reach the threshold.
4. Leaders' links give components.  Where a shingle's sets still lie in several,
   another leader is taken from the largest of them, TURNS times at most.  What
   is left then, sets that hang together by shingles but lie in different
   components, is cut into parts that meet two by two, one of them as a trie, so
   no link between components is lost; links within a component need no search.

A shingle is represented by 64 bits of hash, a set by 128.

Nulls, ties and odd input: a null or empty text has an empty set and links with
nothing; a null doc_id takes part and counts last for component_id; repeated
rows stay; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import _blocks as B
from siltstone.llm import _text as T
from siltstone.llm._graph import components
from siltstone.session import durable, tidy

SIZE = 5
THRESHOLD = 75
#: Candidates of one leader that share a trie.
TRIE_SETS = 256
#: Further leaders that a shingle's sets are compared with before all that is left is compared.
TURNS = 2


def _ceil(a: int, b: int) -> int:
    return -(-a // b)


def sets_of(texts, size: int = SIZE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w = T.Words(texts, fold=T.LOWER)
    g = T.grams(w.hash, size)
    out = []
    for r in range(w.rows):
        a, n = int(w.first[r]), int(w.count[r])
        if n >= size:
            out.append(np.unique(g[a : a + n - size + 1]))
        elif n:
            out.append(T.grams(w.hash[a : a + n], n) ^ np.uint64(n))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class _Sets:
    """A block's documents in fixed order and its distinct sets."""

    def __init__(self, table: pa.Table, size: int, threshold: int):
        self.table = B.ordered(table)
        self.sets = sets_of(self.table["text"], size)
        self.keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in self.sets]
        self.first: dict[bytes, int] = {}
        for i, k in enumerate(self.keys):
            if len(self.sets[i]):
                self.first.setdefault(k, i)
        self.threshold = threshold

    def bounds(self, n: int) -> tuple[int, int]:
        """Length of the prefix and how many of it a partner shares at least."""
        a = _ceil(self.threshold * n, 100)
        # a partner's size is a at least, and n * 100 / threshold at most
        return n - a + _ceil(n, 4), _ceil(a, 4)

    def prefix(self, i: int) -> np.ndarray:
        s = self.sets[i]
        return s[: self.bounds(len(s))[0]]


class Trie:
    """Sets as paths in one order of shingles, what most of them have first.

    The paths stand in lexicographic order, each with the length of what it
    shares with the path before it; that is a prefix tree without pointers."""

    def __init__(self, sets: list[np.ndarray], threshold: int):
        self.threshold = threshold
        sizes = np.array([len(s) for s in sets])
        values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        order = np.lexsort((values, -counts))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        self.values, self.longest = values[order], int(sizes.max())
        owner = np.repeat(np.arange(len(sets)), sizes)
        ranks = np.sort(owner * len(values) + rank[inverse]) - owner * len(values)
        paths = np.split(ranks, np.cumsum(sizes)[:-1])
        names = [p.astype(">u4").tobytes() for p in paths]
        self.order = sorted(range(len(sets)), key=names.__getitem__)
        self.paths = [paths[i] for i in self.order]
        self.shared = [0]
        for x, y in zip(self.paths, self.paths[1:]):
            m = min(len(x), len(y))
            differ = np.flatnonzero(x[:m] != y[:m])
            self.shared.append(int(differ[0]) if len(differ) else m)

    def links(self, leader: np.ndarray, wanted=None) -> list[int]:
        """Which sets link with the leader, of those that wanted accepts.

        Overlaps along a shared part are counted once.  ``dead`` is the depth at
        which even the longest set could no longer reach the threshold: a path
        that shares so much with the one that ended there is in its subtree."""
        hit = T.member(self.values, leader)
        n_own, found = len(leader), []
        overlap = np.zeros(1, dtype=np.int64)  # overlap[d]: shingles of the first d that the leader has
        dead, common = self.longest + 1, 0
        for i, path, shared in zip(self.order, self.paths, self.shared):
            common = min(common, shared)  # with the last path that was walked
            if dead <= common or wanted is not None and not wanted(i):
                continue
            overlap = np.concatenate([overlap[: common + 1], overlap[common] + np.cumsum(hit[path[common:]])])
            missed = np.arange(len(overlap)) - overlap
            over = 100 * np.minimum(n_own, self.longest - missed) < self.threshold * (n_own + missed)
            at = int(np.argmax(over))
            dead, common = at if over[at] else self.longest + 1, len(path)
            o = int(overlap[-1])
            if 100 * o >= self.threshold * (n_own + len(path) - o):
                found.append(i)
        return found


def _rarest(sets: DataFrame, threshold: int, block_mb: float) -> DataFrame:
    """(node, n, tokens, weight) of the sets that may have a partner among sets:
    the n - a + 1 rarest of a set's shingles, without those that no other has."""
    total = sets.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0
    n_blocks = max(1, -(-total // int(block_mb * 1e6)))
    dealt = sets.select(F.pmod(F.xxhash64("node"), F.lit(n_blocks)).cast("int").alias("block"), "node", "n", "hashes")

    def arrays(table):
        return [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table["hashes"]]

    def spread(key, table):
        values, counts = np.unique(np.concatenate(arrays(table)), return_counts=True)
        return pa.Table.from_batches([B.by_bucket(key[0].as_py(), values, counts, B.buckets_for(n_blocks))])

    frequent = B.shared(dealt.groupBy("block").applyInArrow(spread, B.BUCKET_SCHEMA), least_blocks=1, least_rows=2)

    def choose(key, table, found):
        values, counts = B.gathered(found)
        nodes, sizes, tokens, weights = [], [], [], []
        for node, s in zip(table["node"].to_pylist(), arrays(table)):
            shared = s[T.member(s, values)]
            least = _ceil(threshold * len(s), 100)
            if len(shared) < least:
                continue
            df = counts[np.searchsorted(values, shared)]
            # the rarest of all come first: those that no other set has
            keep = len(s) - least + 1 - (len(s) - len(shared))
            nodes.append(node)
            sizes.append(len(s))
            tokens.append(shared[np.lexsort((shared, df))[:keep]].view(np.int64))
            weights.append(int(df.sum()))
        return pa.table({"node": pa.array(nodes, pa.int64()), "n": pa.array(sizes, pa.int64()), "tokens": pa.array(tokens, pa.list_(pa.int64())), "weight": pa.array(weights, pa.int64())})

    return dealt.groupBy("block").cogroup(frequent.groupBy("block")).applyInArrow(choose, "node long, n long, tokens array<bigint>, weight long")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int, trie_sets: int) -> DataFrame:
    """Those of the pairs (a, b) of nodes that link; a is the leader."""
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c"))
    dealt = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / trie_sets)).alias("salt"))
    members = dealt.join(sets.select(F.col("node").alias("b"), "hashes"), "b").select("a", "salt", "b", "hashes")
    leaders = dealt.select("a", "salt").distinct().join(sets.select(F.col("node").alias("a"), "hashes"), "a")
    rows = members.union(leaders.select("a", "salt", F.col("a").alias("b"), "hashes"))

    def search(table: pa.Table) -> pa.Table:
        a = table["a"][0].as_py()
        nodes = table["b"].to_pylist()
        sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table["hashes"]]
        at = nodes.index(a)
        others = [i for i in range(len(nodes)) if i != at]
        found = [nodes[others[i]] for i in Trie([sets[i] for i in others], threshold).links(sets[at])] if others else []
        return pa.table({"a": pa.array([a] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    return rows.groupBy("a", "salt").applyInArrow(search, "a long, b long")


def similar_sets(docs: DataFrame, size: int = SIZE, threshold: int = THRESHOLD, block_mb: float = B.BLOCK_MB, trie_sets: int = TRIE_SETS, turns: int = TURNS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, sets, linked): rows has doc_id, n_shingles and set_key of every
    document; sets has set_key and node of the sets that may have partners;
    linked has node and component of those that have."""
    texts, n_blocks = B.in_blocks(docs.select("doc_id", "text"), block_mb)

    def spread(key, table):
        own = _Sets(table, size, threshold)
        some = [own.prefix(i) for i in own.first.values()]
        values, counts = np.unique(np.concatenate(some) if some else np.zeros(0, np.uint64), return_counts=True)
        return pa.Table.from_batches([B.by_bucket(key[0].as_py(), values, counts, B.buckets_for(n_blocks))])

    frequent = B.shared(texts.groupBy("block").applyInArrow(spread, B.BUCKET_SCHEMA), least_blocks=1, least_rows=2)

    def survivors(key, table, found):
        own = _Sets(table, size, threshold)
        values, _ = B.gathered(found)
        hashes: list = [None] * len(own.sets)
        for i in own.first.values():
            if T.member(own.prefix(i), values).sum() >= own.bounds(len(own.sets[i]))[1]:
                hashes[i] = own.sets[i].tobytes()
        return pa.table(
            {
                "doc_id": own.table["doc_id"],
                "n_shingles": pa.array([len(s) for s in own.sets], pa.int64()),
                "set_key": pa.array(own.keys, pa.binary()),
                "hashes": pa.array(hashes, pa.binary()),
            }
        )

    schema = "doc_id long, n_shingles long, set_key binary, hashes binary"
    rows = durable(texts.groupBy("block").cogroup(frequent.groupBy("block")).applyInArrow(survivors, schema))
    sets = rows.where("hashes is not null").groupBy("set_key").agg(F.first("hashes").alias("hashes"), F.first("n_shingles").alias("n"))
    sets = durable(sets.withColumn("node", F.monotonically_increasing_id()))
    held = durable(_rarest(sets, threshold, block_mb)).select("node", "n", "weight", F.explode("tokens").alias("token"))
    fits = (100 * F.col("n") >= threshold * F.col("m")) & (100 * F.col("m") >= threshold * F.col("n"))
    lead = held.groupBy("token").agg(F.max_by(F.struct("node", "n"), F.struct("weight", "node")).alias("l"), F.count(F.lit(1)).alias("c")).where("c > 1")
    lead = lead.select("token", F.col("l.node").alias("a"), F.col("l.n").alias("m"))
    stars = held.join(lead, "token").where((F.col("a") != F.col("node")) & fits).select("a", F.col("node").alias("b")).distinct()
    links = durable(_verified(stars, sets, threshold, trie_sets))
    linked = components(links)
    # more leaders for shingles whose sets lie in different components: sets that
    # are like each other but not like the first leader find one
    seen = stars
    for turn in range(turns):
        left = _mixed(held, linked)
        sizes = linked.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
        left = durable(left.join(sizes, "component", "left").fillna(1, ["size"]))
        lead = left.groupBy("token").agg(F.max_by(F.struct("node", "n", "component"), F.struct("size", F.xxhash64("component"), F.xxhash64("node", F.lit(turn)))).alias("l"))
        lead = lead.select("token", F.col("l.node").alias("a"), F.col("l.n").alias("m"), F.col("l.component").alias("other"))
        pairs = left.join(lead, "token").where((F.col("component") != F.col("other")) & fits).select("a", F.col("node").alias("b")).distinct()
        pairs = pairs.join(seen, ["a", "b"], "left_anti").join(seen.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti")
        more = durable(_verified(pairs, sets, threshold, trie_sets))
        seen = durable(seen.union(pairs))
        if more.isEmpty():
            break
        linked = _joined(linked, more)
    # whatever is left between different components
    more = durable(_between(durable(_mixed(held, linked)), sets, threshold, trie_sets))
    if not more.isEmpty():
        linked = _joined(linked, more)
    return rows, sets, linked


def _between(left: DataFrame, sets: DataFrame, threshold: int, trie_sets: int) -> DataFrame:
    """Links (a, b) between components: left has (token, node, component) of sets
    that share shingles but are not joined yet.

    Sets that hang together by shingles form a cluster, clusters are cut into
    parts of trie_sets, and each two parts meet in one task: one of them as a
    trie that the other's sets traverse.  No pair is emitted but links, and two
    components that a task has joined are not compared further."""
    lead = left.groupBy("token").agg(F.min("node").alias("a"))
    clusters = components(left.join(lead, "token").select("a", F.col("node").alias("b")))
    sizes = clusters.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / trie_sets).alias("parts"))
    placed = clusters.join(sizes, "component").select("node", F.col("component").alias("cluster"), "parts", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"))
    placed = placed.join(left.select("node", "component").distinct(), "node")
    dealt = placed.select("cluster", "node", "component", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("cluster", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "node", "component")
    rows = dealt.join(sets.select("node", "hashes"), "node")

    def search(table: pa.Table) -> pa.Table:
        part, lo, hi = table["part"].to_numpy(), table["lo"][0].as_py(), table["hi"][0].as_py()
        nodes, comps = table["node"].to_pylist(), table["component"].to_pylist()
        arrays = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table["hashes"]]
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                c = up
            return c

        kept, asking = np.flatnonzero(part == lo).tolist(), np.flatnonzero(part == hi).tolist()
        a, b = [], []
        if kept and asking and len(set(comps)) > 1:
            trie = Trie([arrays[i] for i in kept], threshold)
            for q in asking:
                own = find(comps[q])
                wanted = [find(comps[i]) != own and (lo != hi or nodes[i] < nodes[q]) for i in kept]
                if not any(wanted):
                    continue
                for i in trie.links(arrays[q], wanted.__getitem__):
                    x, y = find(comps[kept[i]]), find(comps[q])
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        a.append(nodes[kept[i]])
                        b.append(nodes[q])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("cluster", "lo", "hi").applyInArrow(search, "a long, b long")


def _mixed(held: DataFrame, linked: DataFrame) -> DataFrame:
    """(token, node, n, component) of the shingles whose sets lie in two components or more."""
    placed = held.join(linked, "node", "left").select("token", "node", "n", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("token")
    return placed.join(mixed, "token")


def _joined(linked: DataFrame, more: DataFrame) -> DataFrame:
    """Components after further links between nodes."""
    of = lambda side: linked.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    between = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = components(between).select(F.col("node").alias("component"), F.col("component").alias("into"))
    known = linked.join(merged, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    fresh = merged.select(F.col("component").alias("node"), F.col("into").alias("component")).join(linked, "node", "left_anti")
    return durable(known.union(fresh))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    with tidy(docs.sparkSession):
        rows, sets, linked = similar_sets(docs, **options)
    classes = rows.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("least"))
    labels = sets.select("set_key", "node").join(linked, "node").select("set_key", "component")
    groups = labels.join(classes, "set_key").groupBy("component").agg(F.min("least").alias("component_id"))
    known = labels.join(groups, "component").select("set_key", "component_id")
    named = classes.join(known, "set_key", "left").select("set_key", F.coalesce("component_id", "least").alias("component_id"))
    empty = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return rows.where("n_shingles > 0").join(named, "set_key", "left").select("doc_id", "n_shingles", "component_id").unionByName(empty)


def op7_ngram_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS g
  FROM w, unnest(range(1, CASE WHEN len(words) >= 5 THEN len(words) - 3 WHEN len(words) > 0 THEN 2 ELSE 1 END)) AS u(i)
), n AS (
  SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM o JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)
), reach AS (
  SELECT doc_id, doc_id AS r FROM w
  UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON reach.r = e.a
)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r)::BIGINT AS component_id FROM n JOIN reach USING (doc_id) GROUP BY n.doc_id, n.n
"""
