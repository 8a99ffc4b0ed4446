"""Substring dedup with prefix-partitioned suffix trees.

Every window of WINDOW consecutive words that also starts in a document with a
smaller doc_id is removed.  The suffixes that can matter are found first: of
each window the least hash of its ANCHOR-word grams is its anchor, and equal
windows have equal anchors, so only windows whose anchor occurs in two documents
become suffixes of a tree.

A block of documents is one group of suffixes: its tree is built in the task that
holds the block, whatever the number of blocks.  What it finds leaves the block
once for each repeat, not once for each document.  Suffixes whose anchor occurs in
another block are dealt to groups by a prefix of variable length, read from the
anchor on: a prefix that is too frequent is lengthened word by word, at most to
the whole anchor, until its group fits into memory.  A prefix that even then comes
from more than FAN blocks is worked on in steps: FAN blocks at a time, of which only
the pieces of the least documents go on to the next step.

A group builds its suffix tree (truncated at WINDOW words) by prefix doubling over
its own words: suffixes with equal rank at depth d are the leaves under one node
of depth d, and those under one node of depth WINDOW are a repeat.  Between blocks
words are compared as they are; in a block words are told apart by two independent
64-bit hashes of their bytes, without which a vocabulary of strings would be made
for every block.

Nulls, ties and odd input: a null text has no words; a null doc_id counts as
larger than every other; rows with equal doc_id never remove from each other;
an empty table gives an empty result; further columns are not read and so may
have any name.  Texts of any length are processed whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import _blocks as B
from siltstone.llm import _text as T
from siltstone.session import durable

WINDOW = 13
ANCHOR = 7
#: Suffixes of the plan's sample that one prefix may have before it is lengthened.
PLAN_DOCS, PLAN_SHARE = 20_000, 0.002
#: Blocks whose pieces of one group meet in one task.
FAN = 4096
NULL_ID = np.int64(2**63 - 1)
PIECES = pa.schema([("grp", pa.int64()), ("block", pa.int32()), ("texts", pa.binary()), ("docs", pa.binary()), ("ats", pa.binary())])


class _Block:
    """One block's documents in fixed order with their windows."""

    def __init__(self, table: pa.Table, window: int, anchor: int):
        self.table = B.ordered(table)
        ids = self.table["doc_id"]
        self.ids = ids.fill_null(int(NULL_ID)).to_numpy() if len(ids) else np.zeros(0, np.int64)
        self.words = w = T.Words(self.table["text"], lanes=2)
        n = max(0, len(w.hash) - window + 1)
        self.at = np.flatnonzero(T.inside(w.first, window, n))  # first word of each window
        self.row = np.searchsorted(w.first, self.at, "right") - 1
        g = T.grams(w.hash, anchor)
        self.anchor = T.minimum_of(g, window - anchor + 1)[self.at] if n else np.zeros(0, np.uint64)
        self._grams = g

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors and in how many documents of the block (2: or more)."""
        if not len(self.anchor):
            return self.anchor, np.zeros(0, np.int64)
        new = np.ones(len(self.anchor), dtype=bool)  # neighbouring windows often have one anchor
        new[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.row[1:] != self.row[:-1])
        a, r = self.anchor[new], self.row[new]
        order = np.argsort(a, kind="stable")  # rows stay in order
        a, r = a[order], r[order]
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        last = np.append(first[1:], len(a)) - 1
        return a[first], 1 + (r[first] != r[last])

    def word_ids(self, at: np.ndarray) -> np.ndarray:
        """A number for each word at the places: equal for equal words."""
        h1, h2 = self.words.hash[at], self.words.hash2[at]
        order = np.argsort(h1, kind="stable")
        same = h1[order][1:] == h1[order][:-1]
        if (same & (h2[order][1:] != h2[order][:-1])).any():  # the first hash alone does not tell them apart
            order = np.lexsort((h2, h1))
            same = h1[order][1:] == h1[order][:-1]
        new = np.ones(len(order), dtype=bool)
        new[1:] = ~same | (h2[order][1:] != h2[order][:-1])
        ids = np.empty(len(order), dtype=np.int64)
        ids[order] = np.cumsum(new) - 1
        return ids

    def tree(self, window: int, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The tree of the windows ``some`` (ascending): the node of each, and each
        node's first window in document order and least doc_id here."""
        if not len(some):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, row = self.at[some], self.row[some]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])
        begin = np.flatnonzero(new)
        # neighbouring windows are suffixes of one stretch of words
        sizes = at[np.append(begin[1:], len(at)) - 1] + window - at[begin]
        places = _ranges(at[begin], sizes)
        _, node = _tree_nodes(self.word_ids(places), np.repeat(np.arange(len(sizes)), sizes), window)
        _, kind = np.unique(node, return_inverse=True)
        head = np.full(int(kind.max()) + 1, len(self.at))
        np.minimum.at(head, kind, some)
        return kind, head, self.ids[self.row[head]]


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... (size numbers) of every range, one after the other."""
    last = np.cumsum(size)
    return np.arange(int(last[-1]) if len(last) else 0) + np.repeat(first - (last - size), size)


def _prefixes(words: T.Words, at: np.ndarray, anchor: int) -> list[np.ndarray]:
    """Hashes of the first 1 .. anchor words from each position on."""
    return [T.grams(words.hash, d)[at] ^ np.uint64(d) for d in range(1, anchor + 1)]


def _plan(texts: DataFrame, n_blocks: int, anchor: int, window: int) -> np.ndarray:
    """Prefixes that are to be lengthened: those with too many suffixes in a
    sample of PLAN_DOCS documents.  It only balances groups; it changes no result.
    The list is bounded by anchor / PLAN_SHARE."""
    fraction = min(1.0, PLAN_DOCS / max(1.0, n_blocks * 1250.0))

    def count(batches):
        for b in batches:
            blk = _Block(pa.Table.from_batches([b]), window, anchor)
            n = len(blk._grams)
            if not n or not len(blk.at):
                continue
            own = np.flatnonzero(T.inside(blk.words.first, anchor, n) & T.member(blk._grams, np.unique(blk.anchor)))
            for level in _prefixes(blk.words, own, anchor)[:-1]:
                v, c = np.unique(level, return_counts=True)
                some = c >= 8
                yield pa.RecordBatch.from_arrays([pa.array(v[some].view(np.int64)), pa.array(c[some]), pa.array(np.full(some.sum(), len(own)))], names=["p", "c", "n"])

    some = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(fraction * (1 << 20)))
    counts = some.mapInArrow(count, "p long, c long, n long").groupBy("p").agg(F.sum("c").alias("c"))
    total = counts.agg(F.sum("c")).first()[0] or 0
    heavy = counts.where(F.col("c") > max(64, int(total / max(1, anchor - 1) * PLAN_SHARE))).select("p").collect()
    return np.sort(np.array([r[0] for r in heavy], dtype=np.int64).view(np.uint64))


def _group_of(words: T.Words, at: np.ndarray, split: np.ndarray, anchor: int, groups: int) -> np.ndarray:
    levels = _prefixes(words, at, anchor)
    key = levels[0]
    deeper = T.member(key, split)
    for level in levels[1:]:
        key = np.where(deeper, level, key)
        deeper &= T.member(key, split)
    return (T.mix(key.copy()) % np.uint64(groups)).astype(np.int64)


def _tree_nodes(ids: np.ndarray, entry: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes with window words left and the tree node each has at that depth.

    Prefix doubling: the rank at depth a + b comes from the ranks at depth a here
    and at depth b a words on, so depth window takes log2(window) sorts."""
    rank, depth = ids, 1
    ends = np.searchsorted(entry, entry, "right")
    while depth < window:
        step = min(depth, window - depth)
        at = np.flatnonzero(np.arange(len(ids)) + depth + step <= ends)
        pair = rank[at] * np.int64(len(ids) + 1) + rank[at + step]
        nxt = np.zeros(len(ids), dtype=np.int64)
        nxt[at] = np.unique(pair, return_inverse=True)[1]
        rank, depth = nxt, depth + step
    at = np.flatnonzero(np.arange(len(ids)) + window <= ends)
    return at, rank[at]


def repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, block_mb: float = B.BLOCK_MB, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(texts in blocks, flags): flags has, of each block, the windows that also
    start in a smaller document of another block, as lists of first words."""
    texts, n_blocks = B.in_blocks(docs, block_mb)
    buckets, groups = B.buckets_for(n_blocks), max(1, n_blocks // 2)
    split = _plan(texts.select("doc_id", "text"), n_blocks, anchor, window) if n_blocks > 1 else np.zeros(0, np.uint64)

    def spread(key, table):
        blk = _Block(table, window, anchor)
        values, counts = blk.anchors()
        return pa.Table.from_batches([B.by_bucket(key[0].as_py(), values, counts, buckets)])

    anchors = B.shared(texts.groupBy("block").applyInArrow(spread, B.BUCKET_SCHEMA), least_blocks=2, least_rows=2)

    def suffixes(key, table, found):
        blk = _Block(table, window, anchor)
        # of every repeat in the block, its first window goes out
        head = np.sort(blk.tree(window, np.flatnonzero(T.member(blk.anchor, B.gathered(found)[0])))[1])
        at, mins, row = blk.at[head], blk.anchor[head], blk.row[head]
        if not len(at):
            return pa.Table.from_batches([], schema=PIECES)
        # neighbouring windows of one document and anchor travel as one piece of text
        new = np.ones(len(at), dtype=bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (mins[1:] != mins[:-1]) | (row[1:] != row[:-1])
        start = np.flatnonzero(new)
        stop = np.append(start[1:], len(at)) - 1
        # the anchor stands at or after the last window's start and is its least gram
        reach = np.arange(window - anchor + 1)
        root = at[stop] + np.argmin(blk._grams[at[stop][:, None] + reach], axis=1)
        group = _group_of(blk.words, root, split, anchor, groups)
        by = np.argsort(group, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], group[by][1:] != group[by][:-1]]))
        out = []
        for k in np.split(by, cut[1:]):
            a, b, r = at[start[k]], at[stop[k]] + window, row[start[k]]
            out.append((int(group[k[0]]), blk.words.texts(a, b), blk.ids[r].tobytes(), a.tobytes()))
        grp, *rest = zip(*out)
        return pa.table([list(grp), [key[0].as_py()] * len(out), *map(list, rest)], schema=PIECES)

    pieces = texts.groupBy("block").cogroup(anchors.groupBy("block")).applyInArrow(suffixes, "grp long, block int, texts binary, docs binary, ats binary")

    def subtree(table: pa.Table, last: bool) -> pa.Table:
        """Flags (block, word) of a group's windows that a smaller document has; before
        the last step also the pieces of those that have none smaller here."""
        vocabulary: dict[bytes, int] = {}
        words, ids, sizes = [], [], []
        for x in table["texts"]:
            own = x.as_py()[:-1].split(b"\n")
            words += own
            for piece in own:
                ws = piece.split(b" ")
                sizes.append(len(ws))
                ids.extend([vocabulary.setdefault(w, len(vocabulary)) for w in ws])
        many = lambda name, t: [np.frombuffer(x.as_buffer(), dtype=t) for x in table[name]]
        docs, ats = many("docs", np.int64), many("ats", np.int64)
        blocks = np.repeat(table["block"].to_numpy(), [len(d) for d in docs])
        docs, ats = np.concatenate(docs), np.concatenate(ats)
        entry = np.repeat(np.arange(len(sizes)), sizes)
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        at, node = _tree_nodes(np.array(ids, dtype=np.int64), entry, window)
        owner = entry[at]
        least = np.full(int(node.max()) + 1, NULL_ID)
        np.minimum.at(least, node, docs[owner])
        hit = least[node] < docs[owner]
        on = np.unique(owner[~hit]) if not last else np.zeros(0, np.int64)
        at, owner = at[hit], owner[hit]
        word = ats[owner] + (at - begin[owner])

        def of_blocks(b: np.ndarray) -> list[tuple[int, np.ndarray]]:
            order = np.argsort(b, kind="stable")
            cut = np.flatnonzero(np.diff(b[order], prepend=-1)) if len(b) else np.zeros(0, np.int64)
            return [(int(b[k[0]]), k) for k in np.split(order, cut[1:])] if len(b) else []

        flags = [(None, b, word[k].tobytes(), None, None, None) for b, k in of_blocks(blocks[owner])]
        grp = table["grp"][0].as_py()
        more = [(grp, b, None, b"".join(words[i] + b"\n" for i in on[k].tolist()), docs[on[k]].tobytes(), ats[on[k]].tobytes()) for b, k in of_blocks(blocks[on])]
        names = ("grp", "block", "word", "texts", "docs", "ats")
        kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 4)
        cols = list(zip(*flags, *more)) or [()] * 6
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, cols, kinds)})

    def step_of(last: bool):
        return lambda table: subtree(table, last)

    schema = "grp long, block int, word binary, texts binary, docs binary, ats binary"
    flags, reach = None, 1
    while True:
        reach *= fan
        last = reach >= n_blocks
        step = step_of(last)
        if last:
            found = pieces.groupBy("grp").applyInArrow(step, schema)
        else:
            found = durable(pieces.groupBy("grp", F.floor(F.col("block") / reach)).applyInArrow(step, schema))
            pieces = found.where("word is null").select("grp", "block", "texts", "docs", "ats")
        own = found.where("word is not null").select("block", "word")
        flags = own if flags is None else flags.union(own)
        if last:
            return texts, flags


def _covered(blk: _Block, flags: pa.Table, window: int) -> np.ndarray:
    """Which words of the block lie under a flagged window: the tree of the block
    says which windows are those of a smaller document here, and spreads the flags
    of other blocks from a repeat's first window to all of it."""
    words = np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.int64) for x in flags["word"]]) if flags.num_rows else np.zeros(0, np.int64)
    flagged = np.zeros(len(blk.at), dtype=bool)
    flagged[np.searchsorted(blk.at, words)] = True
    anchors, documents = blk.anchors()
    some = np.flatnonzero(T.member(blk.anchor, np.union1d(anchors[documents > 1], blk.anchor[flagged])))
    kind, head, least = blk.tree(window, some)
    if len(some):
        flagged[some] |= (blk.ids[blk.row[some]] > least[kind]) | flagged[head][kind]
    delta = np.zeros(len(blk.words.hash) + 1, dtype=np.int64)
    np.add.at(delta, blk.at[flagged], 1)
    np.add.at(delta, blk.at[flagged] + window, -1)
    return np.cumsum(delta[:-1]) > 0


def _kept_runs(gone: np.ndarray) -> tuple[list[list[int]], list[list[int]]]:
    """[start, end) of the runs of removed and of kept words."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).reshape(-1, 2).tolist()
    kept, at = [], 0
    for x, y in [*edge, [len(gone), len(gone)]]:
        if x > at:
            kept.append([at, x])
        at = y
    return edge, kept


def _decided(texts: DataFrame, flags: DataFrame, window: int, make, schema: str) -> DataFrame:
    """make(block, removed) for every block: removed has a flag for each word."""

    def rest(key, table, found):
        blk = _Block(table, window, ANCHOR)
        return make(blk, _covered(blk, found, window))

    return texts.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(rest, schema)


def _counts(blk: _Block, gone: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(gone)])
    return total[blk.words.first[1:]] - total[blk.words.first[:-1]]


def dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, block_mb: float = B.BLOCK_MB, spans: bool = True, fan: int = FAN) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (of the kept
    words joined by one space) and, with ``spans``, the removed runs of words as
    [start, end) and the kept text."""

    def make(blk: _Block, gone: np.ndarray) -> pa.Table:
        w, removed = blk.words, _counts(blk, gone)
        texts, runs = [], []
        for r in range(w.rows):
            a, b = int(w.first[r]), int(w.first[r + 1])
            if removed[r] == 0:
                texts.append(w.text(a, b))
                runs.append([])
            else:
                cut, kept = _kept_runs(gone[a:b])
                texts.append(b" ".join(w.text(a + x, a + y) for x, y in kept))
                runs.append(cut)
        out = {
            "doc_id": blk.table["doc_id"],
            "n_words": pa.array(w.count, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
        }
        if spans:
            out["removed_spans"] = pa.array(runs, pa.list_(pa.list_(pa.int32())))
            out["kept_text"] = pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())
        return pa.table(out)

    texts, flags = repeats(docs.select("doc_id", "text"), window, anchor, block_mb, fan)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", removed_spans array<array<int>>, kept_text string" * spans
    return _decided(texts, flags, window, make, schema)


def cleaned(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, block_mb: float = B.BLOCK_MB) -> DataFrame:
    """docs with the repeated passages taken out of text; the kept passages keep
    their white space and are joined by line feeds.  A column n_chars, if there
    is one, is counted anew.  Documents of which no word is left go; documents
    without words stay.  All other columns are carried along."""
    others = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    renamed = docs.select("doc_id", "text", *[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(others)])

    def make(blk: _Block, gone: np.ndarray) -> pa.Table:
        w, removed = blk.words, _counts(blk, gone)
        table = blk.table
        texts = table["text"].to_pylist()
        for r in np.flatnonzero(removed).tolist():
            a, b = int(w.first[r]), int(w.first[r + 1])
            parts = [w.raw[w.start[a + x] : w.end[a + y - 1]].tobytes() for x, y in _kept_runs(gone[a:b])[1]]
            texts[r] = b"\n".join(parts).decode("utf-8", "replace")
        table = table.set_column(table.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
        return table.drop_columns("block").filter(pa.array((w.count == 0) | (removed < w.count)))

    texts, flags = repeats(renamed, window, anchor, block_mb)
    schema = "doc_id long, text string" + "".join(f", c{i} {f.dataType.simpleString()}" for i, f in enumerate(others))
    out = _decided(texts, flags, window, make, schema)
    counted = [F.length("text").cast(f.dataType) if f.name == "n_chars" else F.col(f"c{i}") for i, f in enumerate(others)]
    return out.select("doc_id", "text", *[c.alias(f.name) for c, f in zip(counted, others)])


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), spans=False)


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(words[i : i + 12], ' ') AS s
  FROM w, unnest(range(1, len(words) - 11)) AS u(i)
), least AS (
  SELECT s, min(doc_id) AS m FROM win GROUP BY s
), gone AS (
  SELECT DISTINCT win.doc_id, win.i + k AS i
  FROM win JOIN least USING (s), unnest(range(0, 13)) AS v(k)
  WHERE win.doc_id > least.m
), each AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w
), kept AS (
  SELECT each.doc_id, count(*) AS kept, string_agg(word, ' ' ORDER BY each.i) AS t
  FROM each ANTI JOIN gone ON each.doc_id = gone.doc_id AND each.i = gone.i GROUP BY each.doc_id
)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(kept, 0))::BIGINT AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
