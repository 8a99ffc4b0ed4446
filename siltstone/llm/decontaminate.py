"""Benchmark decontamination by SimHash over item-sized windows.

For a benchmark item of L words, the windows of a document are its runs of L
words (the whole document if it is shorter).  Windows and items have 64-bit
SimHash fingerprints over their SIZE-word shingles, each as heavy as often as
it occurs.  Fingerprints within RADIUS bits are found by multi-index hashing:
cut into PARTS parts, two such fingerprints agree in one part up to RADIUS //
PARTS bits.  Items of one length are a class of their own, as only they are
compared with windows of that length; a class keeps its items sorted by the value
of each part.  A print looks up all values within that distance of its own, or
compares itself with the class's values where those are fewer.  Candidates are
then compared exactly, by the weighted Jaccard similarity of their shingles;
SIMILARITY or more is a leak.

A window that is that similar has at least 2 s / (1 + s) of its shingles in
common with its item, so windows with fewer benchmark shingles than that are
not fingerprinted; this drops no pair.

The index is made once, on the driver, of at most CHUNK_BYTES of benchmark text,
and broadcast; it takes about eight times its text (the README has figures).  A
larger benchmark is dealt into chunks of that size.  They scan the documents one
after the other, each after what the one before it found was written, so that no
process ever holds two of them.

Nulls, ties and odd input: null or empty texts and items match nothing; an item
or document of fewer than SIZE words has its whole sequence as the only
shingle; null ids are kept; items that repeat are all reported; of equally
similar windows the first is reported; an empty benchmark leaves all documents
clean; an empty table gives an empty result; further columns of the documents
are carried along and not read, whatever their names: where ``leaks`` is taken, the
result has underscores after it.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from siltstone.llm import _text as T
from siltstone.llm._blocks import free_name, plain_names
from siltstone.session import durable

SIZE = 5
SIMILARITY = 0.75
RADIUS = 23
PARTS = 4
CHUNK_BYTES = 24_000_000

_BITS = np.arange(64, dtype=np.uint64)


def shingles(h: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Shingle hashes of one word sequence, in order, with repeats."""
    if len(h) >= size:
        return T.grams(h, size)
    return T.grams(h, len(h)) ^ np.uint64(len(h)) if len(h) else np.zeros(0, np.uint64)


def fingerprint(counts: np.ndarray) -> np.ndarray:
    """64 sums of +1 and -1 per row -> SimHash."""
    return ((counts > 0).astype(np.uint64) << _BITS).sum(axis=-1, dtype=np.uint64)


def signs(s: np.ndarray) -> np.ndarray:
    return ((s[:, None] >> _BITS) & np.uint64(1)).astype(np.int32) * 2 - 1


def _neighbours(width: int, radius: int) -> np.ndarray:
    """All masks of up to radius bits."""
    masks = [0]
    for k in range(1, radius + 1):
        masks += [sum(1 << b for b in bits) for bits in combinations(range(width), k)]
    return np.array(masks, dtype=np.uint32)


class Index:
    """Items with their shingles, fingerprints and, by length, sorted parts; arrays only."""

    def __init__(self, ids: pa.Array, texts: pa.Array, size: int = SIZE, similarity: float = SIMILARITY, radius: int = RADIUS):
        w = T.Words(texts, fold=T.LOWER)
        self.size, self.similarity, self.radius = size, similarity, radius
        some = np.flatnonzero(w.count)
        order = some[np.argsort(w.count[some], kind="stable")]  # items of one length stand together
        self.ids = pa.array(ids).take(pa.array(order)) if len(order) else pa.array([], pa.int64())
        self.words = w.count[order].astype(np.int64)
        self.lengths, begin = np.unique(self.words, return_index=True)
        self.classes = dict(zip(self.lengths.tolist(), zip(begin.tolist(), [*begin[1:].tolist(), len(order)])))
        bags, times, sizes, prints = [], [], [], []
        for r in order.tolist():
            s = shingles(w.hash[w.first[r] : w.first[r + 1]], size)
            prints.append(fingerprint(signs(s).sum(axis=0)))
            bag, n = np.unique(s, return_counts=True)
            bags.append(bag)
            times.append(n.astype(np.int32))
            sizes.append(len(bag))
        self.bag = np.concatenate(bags) if bags else np.zeros(0, np.uint64)
        self.times = np.concatenate(times) if times else np.zeros(0, np.int32)
        self.bag_first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.known = np.unique(self.bag)
        self.prints = np.array(prints, dtype=np.uint64)
        self.width = 64 // PARTS
        self.parts = []  # of each part: values, sorted within a class, and their items
        for p in range(PARTS):
            value = self._part(self.prints, p)
            by = np.lexsort((value, self.words))
            self.parts.append((value[by], by.astype(np.int32)))
        self.masks = _neighbours(self.width, radius // PARTS)

    def _part(self, prints: np.ndarray, p: int) -> np.ndarray:
        return ((prints >> np.uint64(p * self.width)) & np.uint64((1 << self.width) - 1)).astype(np.uint32)

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.bag, self.times, self.bag_first, self.known, self.prints, self.words, *(y for part in self.parts for y in part)))

    def bag_of(self, item: int) -> dict[int, int]:
        a, b = self.bag_first[item], self.bag_first[item + 1]
        return dict(zip(self.bag[a:b].tolist(), self.times[a:b].tolist()))

    def within(self, prints: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (index of a print, item of that many words) within the radius."""
        a, b = self.classes[length]
        step = max(1, 4_000_000 // max(1, min(b - a, len(self.masks))))  # prints looked up at a time
        whos, items = [], []
        for lo in range(0, len(prints), step):
            some, found = prints[lo : lo + step], []
            for p, (values, item) in enumerate(self.parts):
                own, value = self._part(some, p), values[a:b]
                if b - a <= len(self.masks):
                    who, at = np.nonzero(np.bitwise_count(own[:, None] ^ value[None]) <= self.radius // PARTS)
                else:
                    near = own[:, None] ^ self.masks[None]
                    x, y = np.searchsorted(value, near, "left").ravel(), np.searchsorted(value, near, "right").ravel()
                    n = y - x
                    who = np.repeat(np.repeat(np.arange(len(some)), len(self.masks)), n)
                    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(x, n)
                found.append(who.astype(np.int64) * len(self.prints) + item[a:b][at])
            pairs = np.unique(np.concatenate(found))
            who, at = pairs // len(self.prints), pairs % len(self.prints)
            near = np.bitwise_count(some[who] ^ self.prints[at]) <= self.radius
            whos.append(who[near] + lo)
            items.append(at[near])
        return (np.concatenate(whos), np.concatenate(items)) if whos else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def leaks(self, texts) -> list[list[dict]]:
        """For each text, the items it holds, each with its best window."""
        w = T.Words(texts, fold=T.LOWER)
        out: list[list[dict]] = [[] for _ in range(w.rows)]
        if not len(self.ids) or not len(w.hash):
            return out
        g = T.grams(w.hash, self.size)
        hit = np.zeros(len(w.hash), dtype=bool)
        hit[: len(g)] = T.member(g, self.known) & T.inside(w.first, self.size, len(g))
        hits = np.concatenate([[0], np.cumsum(hit)])
        rows = set(np.flatnonzero(hits[w.first[1:]] > hits[w.first[:-1]]).tolist())
        rows |= set(np.flatnonzero((w.count > 0) & (w.count < self.size)).tolist())
        if (self.words < self.size).any():
            rows |= set(range(w.rows))
        for r in sorted(rows):
            a, n = int(w.first[r]), int(w.count[r])
            out[r] = self._in_row(w.hash[a : a + n], hits[a : a + n + 1] - hits[a])
        return out

    def _in_row(self, h: np.ndarray, hits: np.ndarray) -> list[dict]:
        n, size, best = len(h), self.size, {}
        s = shingles(h, size)
        sums = None
        bags: dict[tuple[int, int], Counter] = {}
        for length in self.lengths.tolist():
            span = min(length, n)
            if span < size:
                # one shingle: the whole window as it is
                own = T.grams(h, span) ^ np.uint64(span) if span else np.zeros(0, np.uint64)
                for i in range(*self.classes[length]):
                    bag = self.bag_of(i)
                    at = np.flatnonzero(own == np.uint64(next(iter(bag)))) if len(bag) == 1 else []
                    if len(at):
                        best.setdefault(i, (1.0, int(at[0]), span))
                continue
            # fewest shingles that a window and an item of this size can have in common
            m = span - size + 1
            need = int(np.ceil(self.similarity * (m + length - size + 1) / (1 + self.similarity) - 1e-9))
            first = np.arange(n - span + 1)
            first = first[hits[first + m] - hits[first] >= max(need, 1)]
            if not len(first):
                continue
            if sums is None:
                sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(signs(s), axis=0, dtype=np.int32)])
            who, item = self.within(fingerprint(sums[first + m] - sums[first]), length)
            others: dict[int, dict[int, int]] = {}
            for k, i in zip(first[who].tolist(), item.tolist()):
                bag = bags.get((k, m))
                if bag is None:
                    bag = bags[k, m] = Counter(s[k : k + m].tolist())
                other = others.get(i)
                if other is None:
                    other = others[i] = self.bag_of(i)
                common = sum(min(c, other[x]) for x, c in bag.items() if x in other)
                value = common / (m + length - size + 1 - common)
                if value >= self.similarity and value > best.get(i, (0.0,))[0]:
                    best[i] = (value, k, span)
        return [{"item_id": self.ids[i].as_py(), "first_word": k, "n_words": c, "similarity": v} for i, (v, k, c) in sorted(best.items(), key=lambda x: (self.ids[x[0]].as_py() is None, self.ids[x[0]].as_py(), x[0]))]


LEAKS = "array<struct<item_id:bigint,first_word:bigint,n_words:bigint,similarity:double>>"
_LEAKS = pa.list_(pa.struct([("item_id", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64())]))


def _chunks(benchmark: DataFrame, chunk_bytes: int) -> list[DataFrame]:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // chunk_bytes))
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def find_leaks(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, similarity: float = SIMILARITY, radius: int = RADIUS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """docs with ``leaks`` as the last column: of every benchmark item that a
    document holds, the most similar window.  The columns of docs stay as they are."""
    names, name = [*docs.columns, free_name(docs.columns, "leaks")], "leaks"
    docs = docs.toDF(*plain_names(docs.columns))
    schema = StructType([*docs.schema.fields, StructField(name, DataType.fromDDL(LEAKS))])
    sc = docs.sparkSession.sparkContext

    def scan(items: DataFrame, source: DataFrame, add: bool) -> DataFrame:
        got = items.orderBy("item_id", "text").toArrow()  # at most chunk_bytes of text
        index = sc.broadcast(Index(got["item_id"].combine_chunks(), got["text"].combine_chunks(), size, similarity, radius))

        def run(batches):
            for batch in batches:
                for b in T.slices(batch, "text"):
                    leaks = index.value.leaks(b["text"])
                    kept = b.columns
                    if add:
                        leaks, kept = [x + y for x, y in zip(kept[-1].to_pylist(), leaks)], kept[:-1]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(leaks, _LEAKS)], names=schema.names)

        return source.mapInArrow(run, schema)

    out = docs
    for i, chunk in enumerate(_chunks(benchmark, chunk_bytes)):
        out = scan(chunk, durable(out) if i else out, add=i > 0)
    return out.toDF(*names)


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no benchmark item, with their columns."""
    out = find_leaks(docs, benchmark, **options)
    return out.where(F.size(out[out.columns[-1]]) == 0).select(*[out[f"`{c}`"] for c in docs.columns])


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select(
        "doc_id",
        (F.size("leaks") > 0).alias("contaminated"),
        F.size("leaks").cast("long").alias("n_items"),
        F.array_join(F.transform("leaks", lambda x: x["item_id"].cast("string")), ",").alias("item_ids"),
        F.round(F.coalesce(F.array_max(F.transform("leaks", lambda x: x["similarity"])), F.lit(0.0)), 9).alias("similarity"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
#: Every window that shares a shingle with an item of its size, without fingerprints.
SQL = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
it AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
ds AS (SELECT doc_id, len(words) AS n, i AS pos, array_to_string(words[i : i + 4], ' ') AS g FROM w, unnest(range(1, len(words) - 3)) AS u(i)),
bs AS (SELECT item_id, len(words) AS n_item, array_to_string(words[i : i + 4], ' ') AS g, count(*) AS c FROM it, unnest(range(1, len(words) - 3)) AS u(i) GROUP BY ALL),
near AS (SELECT DISTINCT doc_id, item_id, n_item, least(n_item, n) - 4 AS m, s FROM ds JOIN bs USING (g), unnest(range(pos - least(n_item, n) + 5, pos + 1)) AS u(s)
  WHERE s >= 1 AND s <= n - least(n_item, n) + 1),
bags AS (SELECT near.doc_id, item_id, n_item, m, s, g, count(*) AS c FROM near JOIN ds ON ds.doc_id = near.doc_id AND pos >= s AND pos < s + m GROUP BY ALL),
sims AS (SELECT b.doc_id, b.item_id, sum(least(b.c, bs.c)) / (m + b.n_item - 4 - sum(least(b.c, bs.c))) AS v FROM bags AS b JOIN bs ON bs.item_id = b.item_id AND bs.g = b.g
  GROUP BY b.doc_id, b.item_id, b.s, b.m, b.n_item),
best AS (SELECT doc_id, item_id, max(v) AS v FROM sims WHERE v >= {SIMILARITY} GROUP BY ALL
  UNION ALL SELECT doc_id, item_id, 1.0 FROM w JOIN it ON len(it.words) BETWEEN 1 AND 4 AND list_contains(list_transform(range(1, len(w.words) - len(it.words) + 2), lambda i: w.words[i : i + len(it.words) - 1]), it.words)),
per AS (SELECT doc_id, count(*) AS k, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS ids, max(v) AS v FROM best GROUP BY doc_id)
SELECT doc_id, coalesce(k, 0) > 0 AS contaminated, coalesce(k, 0)::BIGINT AS n_items, coalesce(ids, '') AS item_ids, round(coalesce(v, 0)::DOUBLE, 9) AS similarity
FROM w LEFT JOIN per USING (doc_id)
"""
