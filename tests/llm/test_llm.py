"""The text operators against brute force, SQL and held-out labels."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import time
import zlib
from fractions import Fraction
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.llm import (
    _text, chat_format, decontaminate, html_extract, license_scan, line_crf, ngram_join, packing, quality_resample, substring_dedup, toxicity,
)
from siltstone.llm._graph import components
from siltstone.llm.registry import QUERIES, SQL
from tests.conftest import DATA, same_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string"
#: nulls, empty and white texts, ties, repeated rows
ODD = [(None, None), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "a b c d e f"), (7, "é " * 3), (8, "x" * 5000), (9, "w " * 4000)]


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumn("block", F.lit("clash")).withColumn("c0", F.lit(1)).withColumn("score", F.lit(2)).withColumn("kept", F.lit("no"))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def corpus():
    """Texts that share passages and copies, with ids in shuffled order."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    passages = [" ".join(rng.choices(vocabulary, k=n)) for n in (12, 13, 14, 30, 60)]
    texts = []
    for _ in range(120):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(3)]
        for p in rng.sample(passages, rng.randint(0, 2)):
            parts.insert(rng.randint(0, 3), p)
        texts.append(rng.choice([" ", "\n", " \t"]).join(parts))
    for _ in range(40):
        t = rng.choice(texts[:100]).split()
        for _ in range(rng.randint(0, 4)):
            if t:
                t[rng.randrange(len(t))] = rng.choice(vocabulary).upper()
        texts.append(" ".join(t))
    texts += texts[:10]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, spark, duck):
    same_rows(QUERIES[name](spark, DATA), duck, SQL[name])


def test_words_and_grams():
    texts = [t for _, t in ODD] + ["Ab\x0bc  d\n\n", "naïve x y"]
    w = _text.Words(pa.array(texts))
    assert w.count.tolist() == [len(words(t)) for t in texts]
    flat = [x for t in texts for x in words(t)]
    assert [w.raw[a:b].tobytes().decode() for a, b in zip(w.start, w.end)] == flat
    same = collections.defaultdict(set)
    for word, h in zip(flat, w.hash.tolist()):
        same[word].add(h)
    assert all(len(v) == 1 for v in same.values()) and len({min(v) for v in same.values()}) == len(same)
    for r, t in enumerate(texts):
        assert w.text(int(w.first[r]), int(w.first[r + 1])) == " ".join(words(t)).encode()


# --- 1


def brute_dedup(rows, window=13):
    least = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(least.get(key, 1 << 62), 1 << 62 if i is None else i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < (1 << 62 if i is None else i):
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_word_hashes_tell_words_apart():
    """Pairs that collide under any polynomial of the bytes, words that end alike, and long ones."""
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    texts = [a, b, "x" * 7, "x" * 8, "x" * 9, "x\0", "x", *("y" * k + "z" for k in (4095, 4096, 4097, 9000)), "y" * 9000 + "w"]
    w = _text.Words(pa.array(texts), lanes=2)
    assert w.count.tolist() == [1] * len(texts)
    for h in (w.hash, w.hash2):
        assert len(set(h.tolist())) == len(texts)
    assert not set(w.hash.tolist()) & set(w.hash2.tolist())
    rng = np.random.default_rng(0)
    many = sorted({bytes(x).decode("latin1") for n in range(1, 20) for x in rng.integers(0x61, 0x7B, (3000, n), dtype=np.uint8)})
    assert len(set(_text.Words(pa.array(many)).hash.tolist())) == len(many)


def test_long_words_that_differ_are_no_repeat(spark):
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, " ".join([a] * 13)), (2, " ".join([b] * 13)), (3, " ".join([b] * 14))]
    for block_mb in (8, 0.01):
        got = {x.doc_id: x.n_removed for x in substring_dedup.dedup(spark.createDataFrame(rows, DOCS), block_mb=block_mb, spans=False).collect()}
        assert got == {1: 0, 2: 0, 3: 14}
    joined = {x.doc_id: x.component_id for x in ngram_join.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert joined == {1: 1, 2: 2, 3: 2}


def test_a_block_builds_its_tree(corpus):
    """One block alone: every class of equal windows is a node, told by words."""
    table = pa.table({"doc_id": pa.array([i for i, _ in corpus], pa.int64()), "text": pa.array([t for _, t in corpus], pa.string())})
    blk = substring_dedup._Block(table, 13, 7)
    kind, head, least = blk.tree(13, np.arange(len(blk.at)))
    text = lambda k: blk.words.text(int(blk.at[k]), int(blk.at[k]) + 13)
    by = collections.defaultdict(list)
    for k in range(len(blk.at)):
        by[text(k)].append(k)
    assert len(head) == len(by)
    for own in by.values():
        assert len({int(kind[k]) for k in own}) == 1 and head[kind[own[0]]] == own[0]
        assert least[kind[own[0]]] == min(int(blk.ids[blk.row[k]]) for k in own)


@pytest.mark.parametrize("block_mb, fan", [(8, 4096), (0.004, 4096), (0.004, 3)])
def test_substring_dedup(spark, corpus, block_mb, fan):
    df = spark.createDataFrame(corpus, DOCS)
    got = [tuple(r) for r in substring_dedup.dedup(df, block_mb=block_mb, spans=False, fan=fan).collect()]
    assert sorted(got) == sorted(brute_dedup(corpus))
    spans = substring_dedup.dedup(df, block_mb=block_mb).collect()
    assert all(sum(b - a for a, b in r.removed_spans) == r.n_removed and len(words(r.kept_text)) == r.n_words - r.n_removed for r in spans)


def test_substring_dedup_odd(spark, odd, none):
    got = substring_dedup.dedup(odd, spans=False)
    assert sorted(map(str, got.collect())) == sorted(str(r) for r in spark.createDataFrame(brute_dedup(ODD), got.schema).collect())
    assert substring_dedup.dedup(none).count() == 0 and substring_dedup.cleaned(none).count() == 0
    assert substring_dedup.cleaned(odd).columns == odd.columns


# --- 2


def brute_leaks(rows, items, least=0.75):
    def bag(w):
        return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])

    known = [(i, words(lower(t))) for i, t in items]
    out = {}
    for d, t in rows:
        w, found = words(lower(t)), set()
        for i, own in known:
            n = min(len(own), len(w))
            b = bag(own)
            for k in range(len(w) - n + 1 if n else 0):
                a = bag(w[k : k + n])
                common = sum((a & b).values())
                if common and common / (sum(a.values()) + sum(b.values()) - common) >= least:
                    found.add(i)
                    break
        out[d] = found
    return out


def test_decontamination(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()] + [(900, "one two"), (901, ""), (902, None), (903, "a b c d e")]
    rng = random.Random(3)
    base = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    rows = [(i, t[:1500]) for i, t in enumerate(base)]
    for k in range(40):
        t = rng.choice(items[:40])[1].split()
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = "zz"
        if rng.random() < 0.3:
            t.insert(len(t) // 2, "in")
        rows.append((1000 + k, " ".join([rng.choice(base)[:200], *t, rng.choice(base)[:200]]) if k % 4 else " ".join(t)))
    rows += [(2000, "x one TWO y"), (2001, "one two"), (2002, None), (2003, ""), (2004, "a b c d e f")]
    want = brute_leaks(rows, items)
    assert sum(map(bool, want.values())) > 10
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    for options in ({}, {"chunk_bytes": 3000}):
        got = decontaminate.find_leaks(docs, bench, **options).collect()
        assert {r.doc_id: {x.item_id for x in r.leaks} for r in got} == want
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {k for k, v in want.items() if not v}


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    index = decontaminate.Index(pa.array(range(90)), pa.array([" ".join(f"t{j}" for j in rng.integers(0, 90, 20 + i % 2)) for i in range(90)]))
    prints = index.prints[rng.integers(0, 90, 300)] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (300, 24)).astype(np.uint64), axis=1)
    near = np.bitwise_count(prints[:, None] ^ index.prints[None]) <= decontaminate.RADIUS
    for length in (20, 21):
        who, item = index.within(prints, length)
        own = near & (index.words == length)[None]
        assert sorted(zip(who.tolist(), item.tolist())) == sorted(zip(*(x.tolist() for x in np.nonzero(own))))


def test_index_looks_up_neighbours_in_large_classes():
    """With a small radius the neighbours of a value are fewer than the items of a class."""
    rng = np.random.default_rng(2)
    index = decontaminate.Index(pa.array(range(400)), pa.array([" ".join(f"t{j}" for j in rng.integers(0, 30, 12)) for _ in range(400)]), radius=7)
    assert len(index.masks) < 400
    prints = index.prints[rng.integers(0, 400, 200)] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (200, 7)).astype(np.uint64), axis=1)
    who, item = index.within(prints, 12)
    near = np.bitwise_count(prints[:, None] ^ index.prints[None]) <= 7
    assert sorted(zip(who.tolist(), item.tolist())) == sorted(zip(*(x.tolist() for x in np.nonzero(near))))


def test_decontamination_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", "x", 2), (2, "n o p", None, 3)], "doc_id long, text string, Leaks string, leaks_ long")
    bench = spark.createDataFrame([(7, "a b c d e f g")], "item_id long, text string")
    out = decontaminate.find_leaks(docs, bench)
    assert out.columns == [*docs.columns, "leaks__"] and [len(r["leaks__"]) for r in out.orderBy("doc_id").collect()] == [1, 0]
    assert decontaminate.clean(docs, bench).collect() == docs.where("doc_id = 2").collect()


def test_index_of_a_large_benchmark_is_small():
    rng = np.random.default_rng(6)
    words = np.array([f"w{i}" for i in range(20_000)])
    texts = [" ".join(words[rng.integers(0, 20_000, int(n))]) for n in rng.integers(20, 60, 20_000)]
    index = decontaminate.Index(pa.array(range(20_000)), pa.array(texts))
    assert index.nbytes() < 10 * sum(map(len, texts))


def test_decontamination_odd(spark, odd, none):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert decontaminate.find_leaks(odd, bench).count() == len(ODD) and decontaminate.clean(odd, bench).columns == odd.columns
    assert decontaminate.find_leaks(none, bench).count() == 0 and decontaminate.clean(odd, bench.limit(0)).count() == len(ODD)


# --- 3


def test_token_ids_are_those_of_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", "It's  2024\n\n\tnaïve café ÀÉ", "中文 и кириллица", "a<|endoftext|>b", "x" * 300_000, " " * 1000 + "\r\n\x0b", "don't—“quote”", "\x00\x7f\xa0­", "é ​"]
    for text, ids in zip(texts, packing.token_ids(pa.array(texts))):
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids


def _sequences(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    return by


def test_packing(spark, odd):
    df = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    ids = {}
    for batch in packing_input(df):
        for doc_id, x, _, _ in packing.document_encoder()(batch):
            ids[doc_id] = x
    rows = packing.pack_documents(df.repartition(3)).collect()
    parts = collections.defaultdict(list)
    for r in rows:
        x = ids[r.doc_id]
        assert r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(x[r.start : r.start + r.length].astype("<u4").tobytes())
        parts[r.doc_id].append((r.start, r.start + r.length))
    for doc_id, cut in parts.items():
        cut.sort()
        assert cut[0][0] == 0 and cut[-1][1] == len(ids[doc_id]) and all(a[1] == b[0] for a, b in zip(cut, cut[1:]))
    assert set(parts) == set(ids)
    for seq in _sequences(rows).values():
        seq.sort(key=lambda r: r.offset)
        at = 0
        for r in seq:
            assert r.offset == at
            at += r.length
        assert at <= 1024 and at & (at - 1) == 0  # no padding
    assert sum(r.length for r in packing.pack_documents(odd).collect()) == sum(len(x) for b in packing_input(odd.select("doc_id", "text")) for _, x, _, _ in packing.document_encoder()(b))


def packing_input(df):
    return df.toArrow().to_batches()


def _brute_demand(x, a, b):
    loss = sum(x.loss[a:b].tolist()) if x.loss is not None else b - a
    starts = [0] if x.starts is None else x.starts.tolist()
    ends = [*starts[1:], len(x.ids)]
    return b - a, sum(s < b and e > a for s, e in zip(starts, ends)), loss


def _examples(rng, n, longest=200):
    for i in range(n):
        ids = rng.integers(0, 9, rng.integers(1, longest)).astype("<u4")
        starts = np.unique([0, *rng.integers(0, len(ids), rng.integers(0, 9)).tolist()])
        yield packing._Example(i, ids, rng.random(len(ids)) < rng.random(), starts)


def test_packing_keeps_all_three_limits():
    """And each of them is what closes some sequence."""
    rng = np.random.default_rng(2)
    limits = packing.Limits(tokens=64, segments=6, loss=30)
    for n in (0, 1, 3, 400):
        packer, out = packing.Packer(limits, 0), []
        examples = list(_examples(rng, n))
        packer.add(examples[: n // 2], out)
        packer.add(examples[n // 2 :], out)
        packer.close(out)
        assert sum(r[2] for r in out) == sum(len(x.ids) for x in examples)
        by = collections.defaultdict(list)
        for r in out:
            by[r[5]].append(r)
            assert (r[2], r[8], r[7]) == _brute_demand(examples[r[0]], r[1], r[1] + r[2])
        totals = [tuple(sum(r[c] for r in v) for c in (2, 8, 7)) for v in by.values()]
        assert all(t <= 64 and s <= 6 and x <= 30 for t, s, x in totals)
        if n == 400:
            for k, most in enumerate((64, 6, 30)):
                assert any(t[k] == most and all(t[o] < m for o, m in enumerate((64, 6, 30)) if o != k) for t in totals)


def test_packing_chooses_by_the_dot_product():
    """The whole run again, with every choice made by a plain loop over the waiting pieces."""
    limits = (64, 6, 30)
    for seed in range(5):
        examples = [x for x in _examples(np.random.default_rng(seed), 80, 30) if all(d <= m for d, m in zip(_brute_demand(x, 0, len(x.ids)), limits)) and len(x.ids) < 64]
        packer, out = packing.Packer(packing.Limits(*limits), 0), []
        packer.add(examples, out)
        waiting, sequence, used, want = list(examples), 0, [0, 0, 0], []
        while waiting:
            room = [m - u for m, u in zip(limits, used)]
            fitting = [(sum(Fraction(d * r, m * m) for d, r, m in zip(_brute_demand(x, 0, len(x.ids)), room, limits)), x) for x in waiting if all(d <= r for d, r in zip(_brute_demand(x, 0, len(x.ids)), room))]
            if not fitting:
                break  # from here on pieces are cut
            best = max(v for v, _ in fitting)
            ties = [x for v, x in fitting if v == best]
            x = min(ties, key=lambda x: _brute_demand(x, 0, len(x.ids)))
            waiting = [y for y in waiting if y is not x]
            want.append((x.doc_id, sequence))
            used = [u + d for u, d in zip(used, _brute_demand(x, 0, len(x.ids)))]
            if any(u == m for u, m in zip(used, limits)):
                sequence, used = sequence + 1, [0, 0, 0]
        packer.close(out)
        got = [(r[0], r[5]) for r in out]
        closed = [x for x in want if x[1] < sequence]
        assert len(want) > 3 and got[: len(closed)] == closed


def test_conversations_pack_with_a_loss_mask(spark):
    segments = F.array(F.struct(F.lit("### user: hello").alias("text"), F.lit(False).alias("loss")), F.struct(F.lit(" fine, thanks").alias("text"), F.lit(True).alias("loss")))
    df = spark.range(10).select(F.col("id").alias("doc_id"), segments.alias("segments"))
    rows = packing.pack(df, packing.conversation_encoder, packing.Limits(tokens=32, segments=4, loss=8)).collect()
    assert all(sum(r.loss_tokens for r in v) <= 8 and sum(r.segments for r in v) <= 4 for v in _sequences(rows).values()) and sum(r.loss_tokens for r in rows) == 30


def test_conversation_packing(spark):
    table = spark.read.parquet(f"{DATA}/conversations.parquet")
    odd = spark.createDataFrame([(None, None, None, None), (-1, 0, "assistant", ""), (-1, 0, "assistant", "")], table.select("conv_id", "turn", "role", "text").schema)
    rows = packing.pack_conversations(table.select("conv_id", "turn", "role", "text").union(odd)).collect()
    limits = packing.CHAT_LIMITS
    for v in _sequences(rows).values():
        assert sum(r.length for r in v) <= limits.tokens and sum(r.segments for r in v) <= limits.segments and sum(r.loss_tokens for r in v) <= limits.loss
    got = collections.Counter()
    for r in rows:
        got[r.doc_id] += r.length
    turns = collections.defaultdict(list)
    for r in table.union(odd).collect():
        turns[r.conv_id].append((r.turn if r.turn is not None else -1, r.role or "", r.text or ""))
    for conv_id, own in turns.items():
        texts = [f"### {role}: {text}\n" for _, role, text in sorted(own)]
        assert got[conv_id] == 1 + sum(len(x) for x in packing.token_ids(pa.array(texts)))
    assert set(got) == set(turns)
    assert packing.pack_conversations(table.select("conv_id", "turn", "role", "text").limit(0)).count() == 0


# --- 4


def test_block_max_index_is_exact():
    rng = np.random.default_rng(3)
    vectors = []
    for _ in range(500):
        t = np.unique(rng.integers(0, 40, rng.integers(0, 6)))
        w = rng.random(len(t)) + 0.1
        vectors.append((t, w / np.sqrt((w * w).sum()) if len(w) else w))
    index = toxicity.BlockMaxIndex(vectors, 40, block=16)
    dense = np.zeros((500, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for i in range(0, 500, 7):
        cosines = np.round(dense @ dense[i], 12)
        want = sorted((-c, j) for j, c in enumerate(cosines) if c > 0 and j != i)
        if len(want) > 9:
            want = [x for x in want if x[0] <= want[8][0]]  # with all that share the ninth
        got, ids = index.nearest(*vectors[i], 9, without=i)
        assert list(zip(got.tolist(), ids.tolist())) == [(-c, j) for c, j in want]


def test_isotonic():
    knots, values = toxicity.isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert values.tolist() == [0, 0, 0.5, 0.5, 1, 1] and knots.tolist() == [0, 0, 1, 2, 3, 3]


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    got = QUERIES["op4_toxicity"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held = got.where("held_out").join(labels, "doc_id").select("toxic", "score", "predicted").collect()
    hits = sum(r.toxic == r.predicted for r in held)
    found = sum(r.predicted for r in held if r.toxic == 1) / sum(r.toxic for r in held)
    assert hits / len(held) > 0.96 and found > 0.85
    assert got.where("score < 0 OR score > 1 OR score IS NULL OR predicted <> int(score >= 0.3)").isEmpty()


def test_toxicity_by_brute_force(spark):
    """Every score again, by dense cosines over all examples."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.fit(docs, labels)
    assert len(model.terms) > 500
    texts = {r.doc_id: r.text or "" for r in docs.collect()}

    def bag(text):
        words = [t for w in re.findall(r"\w+", text.lower()) for t in (w, *(w[:k] + "-" for k in (4, 6) if len(w) > k))]
        return collections.Counter(t for t in words if t in known)

    known = set(model.terms)
    frequency = collections.Counter(t for x in texts.values() for t in bag(x))
    examples = {i: y for i, y in ((r.doc_id, int(r.toxic == 1)) for r in labels.where("toxic is not null").collect()) if zlib.crc32(str(i).encode()) % 4 != 2}
    inside = collections.Counter(t for i in examples for t in bag(texts[i]))
    toxic = collections.Counter(t for i, y in examples.items() if y for t in bag(texts[i]))
    n, n1 = len(examples), sum(examples.values())
    weight = {}
    for t in known:
        a, b = toxic[t], inside[t] - toxic[t]
        c, d = n1 - a, n - n1 - b
        chi2 = n * (a * d - b * c) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d)) if a * d > b * c else 0.0
        weight[t] = (math.log((1 + len(texts)) / (1 + frequency[t])) + 1) * (chi2 / (chi2 + 30) + 0.05)
    at = {t: i for i, t in enumerate(model.terms)}

    def dense(text):
        v = np.zeros(len(at))
        for t, k in bag(text).items():
            v[at[t]] = (1 + math.log(k)) * weight[t]
        return v / (np.linalg.norm(v) or 1.0)

    order = sorted(examples)
    matrix, y = np.stack([dense(texts[i]) for i in order]), np.array([examples[i] for i in order])
    for row in toxicity.score(docs, model).collect():
        cosines = np.round(matrix @ dense(texts[row.doc_id]), 9)
        kth = np.sort(cosines)[::-1][14]
        near = (cosines > 0) & (cosines >= kth)
        if not near.any():
            assert row.score == pytest.approx(model.bare) and not row.neighbours
            continue
        votes = 1 / (1.05 - cosines[near])
        raw = float((votes * y[near]).sum() / votes.sum())
        assert {x.doc_id for x in row.neighbours} == {order[i] for i in np.flatnonzero(near)}
        assert row.score == pytest.approx(float(np.interp(raw, model.knots, model.values)), abs=1e-4)


def test_toxicity_does_not_depend_on_numbers(spark):
    """Other ids on the same side of the split give the same scores."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{DATA}/labels.parquet")
    ids = [r.doc_id for r in docs.collect()]
    side = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    rng, other = random.Random(1), {}
    for s in (True, False):
        own = [i for i in ids if side(i) == s]
        other |= dict(zip(own, rng.sample(own, len(own))))
    swap = spark.createDataFrame(list(other.items()), "doc_id long, other long")
    renamed = [df.join(swap, "doc_id").drop("doc_id").withColumnRenamed("other", "doc_id") for df in (docs, labels)]
    first = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    second = {r.doc_id: r.score for r in toxicity.score(renamed[0], toxicity.fit(*renamed)).collect()}
    assert {other[i]: x for i, x in first.items()} == second


def test_toxicity_odd(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 1), (5, None, 0), (8, 1, None), (9, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score(odd, toxicity.fit(odd, labels)).count() == len(ODD)
    empty = toxicity.fit(odd, labels.limit(0))
    assert {r.score for r in toxicity.score(odd, empty).collect()} == {0.0}
    assert toxicity.score(none, empty).count() == 0


# --- 5


def test_importance_weights_by_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    out = quality_resample.resample(docs, labels).collect()
    token = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x08\x0E-\x1F\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    texts = {r.doc_id: r.text for r in docs.collect()}

    def grams(text):
        own = [w for w in token.findall((text or "").encode())]
        if not own:
            return []
        h = _text.Words(pa.array([w.decode() for w in own]), classes=quality_resample.CLASSES).hash
        out = [int(x) % quality_resample.BUCKETS for x in h]
        for i in range(len(own) - 1):
            out.append(int(_text.grams(h[i : i + 2], 2)[0] % np.uint64(quality_resample.BUCKETS)))
        for lag in range(1, quality_resample.LAGS + 1):
            out += [quality_resample.BUCKETS + lag - 1] * sum(own[i] == own[i + lag] for i in range(len(own) - lag))
        return out

    bags = {i: grams(t) for i, t in texts.items()}
    size = quality_resample.BUCKETS + quality_resample.LAGS
    raw, target = np.zeros(size), np.zeros(size)
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    for i, b in bags.items():
        np.add.at(raw, b, 1)
        if i in good:
            np.add.at(target, b, 1)
    ratios = quality_resample.log_ratios(target, raw)
    for r in out:
        own = bags[r.doc_id]
        assert r.log_weight / 1e6 == pytest.approx(10 * ratios[own].sum() / (len(own) + 30), abs=1e-4)
    kept = sorted((r.perturbed for r in out if r.kept), reverse=True)
    assert kept == sorted((r.perturbed for r in out), reverse=True)[: len(kept)]
    quality = {r.doc_id: r.quality for r in labels.collect()}
    good = [r.kept for r in out if quality.get(r.doc_id) == 1]
    assert sum(good) >= 0.98 * len(good)  # drawn, not cut off
    assert sum(r.kept for r in out if quality.get(r.doc_id) == 0) <= 0.1 * sum(q == 0 for q in quality.values())


def test_draws_follow_the_weights():
    """Inclusion over seeds is that of drawing without replacement in proportion to exp(weight)."""
    w, k, seeds = np.array([0.7, 0.5, 0.0, -0.5, -1.0, -2.0, -3.0, -4.0]), 4, 4000
    ids, included = pa.array(range(100, 108)), np.zeros(8)
    for seed in range(seeds):
        included[np.argsort(-(w + quality_resample.gumbel(ids, seed)))[:k]] += 1
    rng, want = np.random.default_rng(0), np.zeros(8)
    for _ in range(seeds):
        want[rng.choice(8, size=k, replace=False, p=np.exp(w) / np.exp(w).sum())] += 1
    assert np.abs(included - want).max() / seeds < 0.04
    assert (np.diff(included) < 0).all() and 0.02 < included[7] / seeds < 0.3


def test_resampling_is_no_cut_off(spark):
    """Documents between good and bad are drawn or not as the seed falls."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    mixed = docs.where("doc_id % 5 = 0").select((F.col("doc_id") + 1_000_000).alias("doc_id"), F.concat("text", F.repeat(F.lit(" THE!! of%%% and***"), 12)).alias("text"))
    everything = docs.union(mixed)
    runs = [{r.doc_id: (r.kept, r.log_weight) for r in quality_resample.resample(everything, labels, seed=s).collect()} for s in (1, 2)]
    a, b = ({i for i, (kept, _) in run.items() if kept} for run in runs)
    cut = sorted(((w, i) for i, (_, w) in runs[0].items()), reverse=True)[: len(a)]
    assert len(a) == len(b) and len(a ^ b) > 5 and len(a ^ {i for _, i in cut}) > 5
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len(good - a) < 0.04 * len(good) and len(good - b) < 0.04 * len(good)


def test_resampling_keeps_columns_of_any_name(spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "some text", 5, True, "x")], "doc_id long, text string, Log_Weight long, kept boolean, perturbed string")
    out = quality_resample.accepted(docs, labels)
    assert out.columns == docs.columns and out.collect() == docs.collect()
    assert quality_resample.resample(docs, labels).columns == [*docs.columns, "log_weight_", "perturbed_", "kept_"]


def test_kth_largest(spark):
    values = [5, -3, 2**40, -(2**40), 5, 0, 70000]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in range(1, 8):
        assert quality_resample.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]
    assert quality_resample.kth_largest(df, "v", 8) is None and quality_resample.kth_largest(df, "v", 0) is None


def test_resample_odd(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (5, None), (9, 0)], "doc_id long, quality int")
    assert quality_resample.resample(odd, labels).count() == len(ODD)
    assert quality_resample.accepted(odd, labels.limit(0)).count() == len(ODD)
    assert quality_resample.resample(none, labels).count() == 0


# --- 6


def brute_counts(text):
    w = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    places = collections.defaultdict(list)
    for i in range(len(w) - 2):
        places[tuple(w[i : i + 3])].append(i)
    covered = {i + k for v in places.values() if len(v) > 1 for i in v for k in range(3)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_line_counts(spark, odd, none):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    for df in (docs, odd):
        rows = df.select("doc_id", "text").collect()
        got = line_crf.judge(df, None).collect()
        want = sorted(str((r.doc_id, *brute_counts(r.text))) for r in rows)
        assert sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in got) == want
        assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed) for r in got)
    assert line_crf.judge(none, None).count() == 0


def test_viterbi_by_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(30):
        n = int(rng.integers(1, 8))
        e, moves = rng.normal(size=n), rng.normal(size=(2, 2))
        best = max(
            (sum(e[i] * y[i] for i in range(n)) + sum(moves[y[i], y[i + 1]] for i in range(n - 1)), y)
            for y in (tuple(k >> i & 1 for i in range(n)) for k in range(2**n))
        )[1]
        assert tuple(line_crf.Field(np.zeros(1), moves).decode(e).astype(int)) == best


def test_likelihood_by_brute_force_and_its_gradient():
    """The value against all labellings, the gradient against differences."""
    rng = np.random.default_rng(5)
    sequences = [(rng.normal(size=(n, 3)), rng.integers(0, 2, size=n)) for n in (1, 2, 5, 4)]
    X, Y, mask = line_crf._padded(sequences)
    weight, at = rng.random(4), rng.normal(size=7)

    def value(v):
        return line_crf.likelihood(v[:3], v[3:].reshape(2, 2), X, Y, mask, weight)

    def log_p(x, y):
        score = lambda z: sum(float(x[i] @ at[:3]) * z[i] for i in range(len(z))) + sum(at[3:].reshape(2, 2)[a, b] for a, b in zip(z, z[1:]))
        every = [tuple(k >> i & 1 for i in range(len(y))) for k in range(2 ** len(y))]
        return score(y) - math.log(sum(math.exp(score(z)) for z in every))

    got, gradient = value(at)
    assert got == pytest.approx(sum(w * log_p(x, y.tolist()) for w, (x, y) in zip(weight, sequences)))
    for i in range(7):
        step = np.eye(7)[i] * 1e-5
        assert gradient[i] == pytest.approx((value(at + step)[0] - value(at - step)[0]) / 2e-5, abs=1e-6)


def _labelled_texts():
    spark_free = pytest.importorskip("duckdb").connect()
    return spark_free.execute("SELECT doc_id, text, quality FROM '/root/testdata/sf0.1/documents.parquet' JOIN '/root/testdata/sf0.1/labels.parquet' USING (doc_id) WHERE quality IS NOT NULL ORDER BY doc_id").fetchall()


def test_lines_planted_in_good_documents_are_marked():
    """Both labels occur within documents, in training and in what is decoded."""
    rows = [(i, t, q) for i, t, q in _labelled_texts() if t and len(t) <= 20_000]
    train = [(t, q) for i, t, q in rows if not line_crf.held_out(i)]
    train = [r for r in train if r[1] == 1][:500] + [r for r in train if r[1] == 0][:300]
    sequences = line_crf.sequences_of(train)
    assert sum(0 < y.mean() < 1 for _, y, q in sequences if q == 1) > 300 and any(0 < y.mean() < 1 for _, y, q in sequences if q == 0)
    field, rng = line_crf.train(sequences, 0.85), np.random.default_rng(11)
    found = total = wrong = own = mixed = several = 0
    for _, text, _ in [r for r in rows if line_crf.held_out(r[0]) and r[2] == 1]:
        whole, marks = line_crf.planted(text, [], rng)
        labels = field.decode(np.array(line_crf.described(whole)[1]) @ field.weights)
        marks = np.array(marks)
        found, total = found + (~labels[marks]).sum(), total + marks.sum()
        wrong, own = wrong + (~labels[~marks]).sum(), own + (~marks).sum()
        mixed, several = mixed + (0 < labels.mean() < 1), several + 1
    assert found / total > 0.95 and wrong / own < 0.02 and mixed / several > 0.9


def test_repeated_ids_do_not_enlarge_the_sample(spark):
    rows = [(1, f"Some words, in a line.\nAnd {i} more of them.") for i in range(50)] + [(2, "A | B | C | D")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    seen = []
    kept, line_crf.sequences_of = line_crf.sequences_of, lambda r: seen.append(len(r)) or []
    try:
        line_crf.fit(docs, labels, 10)
    finally:
        line_crf.sequences_of = kept
    assert seen == [10]


def test_line_labels_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    got = QUERIES["op6_line_crf"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("not base_failed")
    rows = [r for r in got.select("doc_id", "quality", "kept").collect() if line_crf.held_out(r.doc_id)]
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.1


# --- 7


def brute_components(rows):
    sets = [frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if (w := words(lower(t))) else frozenset() for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = []
    for g in groups.values():
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        out += [(rows[i][0], len(sets[i]), min(ids) if ids else None) for i in g]
    return out


@pytest.mark.parametrize("options", [{}, {"block_mb": 0.003, "trie_sets": 3}])
def test_ngram_join(spark, corpus, options):
    rng = random.Random(8)
    base = [f"b{i}" for i in range(90)]
    near = []
    for k in range(60):  # a large group whose members are not all alike
        t = list(base)
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(90)] = f"n{k}"
        near.append((1000 + k, " ".join(t)))
    rows = corpus + near + ODD
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, DOCS), **options).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, brute_components(rows)))


def test_ngram_join_odd(odd, none):
    assert ngram_join.near_duplicates(odd).count() == len(ODD) and ngram_join.near_duplicates(none).count() == 0


def test_trie_by_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(40):
        pool = rng.integers(0, 2**63, 60).astype(np.uint64)
        sets = [np.unique(rng.choice(pool, rng.integers(1, 50))) for _ in range(30)]
        leader = np.unique(rng.choice(pool, 45))
        want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(s, leader)) >= 75 * len(np.union1d(s, leader))]
        assert sorted(ngram_join.Trie(sets, 75).links(leader)) == want


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in touched}


# --- 8


def test_chat_round_trip(spark):
    rng = random.Random(11)
    bits = ["\\", "<", "#", "### ", "</turn>", ": ", "\n", "\\b", "\\h", "a", "é", " ", "user", ""]
    rows = []
    for c in range(40):
        for turn in range(rng.randint(1, 9)):
            rows.append((c, turn, rng.choice(["user", "assistant", "system", "a:b#\n", None]), rng.choice([None, "".join(rng.choices(bits, k=rng.randint(0, 12)))])))
    rows += [(50, 0, "assistant", f"{i}") for i in range(700)] + [(None, None, None, None), (51, 1, "user", "same"), (51, 1, "user", "same")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    chats = chat_format.format_chats(table)
    back = chats.select("conv_id", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), "n_blocks").collect()
    want = collections.defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want[conv].append((role or "", text or ""))
    assert len(back) == len(want)
    for r in back:
        own = want[r.conv_id]
        assert [tuple(t) for t in r.turns] == own and r.loss == "".join(t for role, t in own if role == "assistant")
        assert r.n_blocks == sum(i == 0 or own[i][0] != own[i - 1][0] for i in range(len(own)))
    assert chat_format.format_chats(table.limit(0)).count() == 0


def test_chat_uses_no_python(spark):
    plan = chat_format.format_chats(spark.read.parquet(f"{DATA}/conversations.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- 9


def test_html(spark):
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        import html as h

        article = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        parts = [" ".join(h.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", re.sub("</?b>", "", article))]
        assert html_extract.main_text(r.html) == "\n\n".join(p for p in parts if p)


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("plain", "plain"), ("<p>a<b>b</b>&nbsp;&amp; c<p>d", "ab & c\n\nd"), ("<script>var x='</p>'</script><p>x", "x"), ("<!-- <p>no</p> --><p>yes", "yes"),
        ("<body><nav><a>m</a></nav><article><h1>T</h1><p>One, two.</p><aside>s</aside><form>f</form><div class='comments'><p>c</p></div></article><footer>f</footer>", "T\n\nOne, two."),
        ("<article><p>Text, here.</p><article class=comment><p>c</p></article><p style='display: none'>h</p><div class=advertising-box>a</div><p>More.</p></article>", "Text, here.\n\nMore."),
        ("<main><article><header><h1>T</h1><p>By me</p></header><p>Long text, with commas, and more.</p></article><div><p>Unmarked box.</p></div></main>", "T\n\nLong text, with commas, and more."),
        ("<article><p>Oui.</p></article><div>Much longer text, with commas, but outside of it.</div>", "Oui."),
        ("<body><header><h1>Site</h1></header><div class='cookie-notice'>We use cookies.</div><div id=content><h1>T</h1><p>Long text, with commas, and more of it.<p>Short<ul><li>a<li>b</ul></div><div class=sidebar>no</div>", "T\n\nLong text, with commas, and more of it.\n\nShort\n\na\n\nb"),
    ],
)
def test_html_cases(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        *((f"<body><div class='{c}'><article><h1>T</h1><p>One, two.</p></article></div>", "T\n\nOne, two.") for c in ("with-sidebar", "no-sidebar", "has-sidebar", "search-results", "sidebar")),
        ("<article><h1 class=page-header>T</h1><p>One, two.</p></article>", "T\n\nOne, two."),
        ("<article><div class=article-header><h1>T</h1></div><p>One, two.</p></article>", "T\n\nOne, two."),
        ("<body><div class=search-results><p>Long text, with commas, and more of it.</p></div><div class=sidebar>no</div>", "Long text, with commas, and more of it."),
        ("<article><p>One, <svg class='i'/> two.</p><p>Three.</p></article>", "One, two.\n\nThree."),
        ("<article><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> holds.</p></article>", "So x=1 holds."),
        ("<article><p>One, two.</p></article><div class=sidebar><p>Longer text, with commas, beside the article.</p></div>", "One, two."),
    ],
)
def test_html_layout_words(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize("page", ["<", "<<<>>>", "<a title=\"x", "<!--" * 1000, "<script>" * 1000, "<div>" * 3000 + "x", "&#xFFFFFFFF;&#0;", "</p></p></div>"])
def test_html_of_any_kind_ends(page):
    assert isinstance(html_extract.main_text(page), str)


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><p>One <span class='advert'>BUY NOW</span>two, three.</p><button>Share this</button><label>Name</label><p>Four.</p></article>", "One two, three.\n\nFour."),
        ("<article><p>Before, it said <button>Share this</button>so.</p></article>", "Before, it said so."),
        ("<article><p title='a hidden valley'>In it, one walks.</p><section id='legal'><p>Of law.</p></section><h2 id='related-work'>Others</h2><p>They too.</p></article>", "In it, one walks.\n\nOf law.\n\nOthers\n\nThey too."),
        ("<body><div class='post share-enabled'><h1>T</h1><p>Some text, with commas.</p></div><div class='share-buttons'><a>f</a></div>", "T\n\nSome text, with commas."),
        ("<body><article><p>A long first text, with commas, and a full stop. Then another sentence.</p></article><article class=card><p>Read more here.</p></article>", "A long first text, with commas, and a full stop. Then another sentence."),
        ("<body><div><a>Home</a> <a>News</a> <a>More</a></div><div><h1>T</h1><p>A text, long, with commas; and more of it.</p><p>Short.</p></div><div><ul><li><a>Popular one</a><li><a>Popular two</a></ul></div>", "T\n\nA text, long, with commas; and more of it.\n\nShort."),
        ("<main><h1>T</h1><article><p>Text, with commas.</p></article></main>", "T\n\nText, with commas."),
        ("<body><nav><ul><li>Menu</ul></nav><footer>Foot, with a comma.</footer>", ""),
        ("<table><tr><td><a>m</a><td><p>Text, with commas, of the page.</p><p>And more, of it.</p></table>", "Text, with commas, of the page.\n\nAnd more, of it."),
        ("<article><p>One, two.</p></article><section class='comment-list'><p>A reader's comment, longer, with many commas, and more. And more.</p></section>", "One, two."),
        ("<article hidden><p>No.</p></article><article><p>Yes.</p></article>", "Yes."),
    ],
)
def test_html_ratios_and_names(page, text):
    assert html_extract.main_text(page) == text


def _unmarked(seed):
    """A page that names nothing, and its article: only the ratios tell them apart."""
    rng = random.Random(seed)
    sentence = lambda: " ".join(rng.choice("one two three four five six seven".split()) for _ in range(rng.randint(5, 14))) + rng.choice([".", ", and so on.", "; no?"])
    parts = ["Title of it", *[" ".join(sentence() for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(3, 8))], "Short."]
    links = "".join(f"<li><a href=x>{rng.choice(['Home', 'News', 'About us', 'Sign'])}</a>" for _ in range(rng.randint(3, 9)))
    article = f"<div><h1>{parts[0]}</h1>" + "".join(f"<p>{x}</p>" for x in parts[1:]) + "</div>"
    around = [f"<div><ul>{links}</ul></div>", f"<div>Buy {rng.randint(1, 9)} now</div>"]
    pages = [around[0], article, around[1]] if rng.random() < 0.5 else [*around, article]
    return "<html><body>" + "".join(pages) + "</body></html>", "\n\n".join(parts)


def test_html_ratios_decide():
    """Other scores give other texts: nothing but the ratios finds the article here."""
    const = inverse = 0
    for seed in range(40):
        source, text = _unmarked(seed)
        assert html_extract.main_text(source) == text, seed
        page = html_extract.read(source)
        scores = html_extract.path_scores(page.blocks)
        const += "\n\n".join(html_extract.select(html_extract.read(source), dict.fromkeys(scores, 1.0))) != text
        inverse += "\n\n".join(html_extract.select(html_extract.read(source), {p: 1 / v for p, v in scores.items()})) != text
    assert const == inverse == 40


class _Naive(HTMLParser):
    """Blocks with their whole paths spelled out, by kind and by element, for pages of closed elements without names."""

    def __init__(self):
        super().__init__()
        self.stack, self.blocks, self.n = [], [], 0

    def handle_starttag(self, tag, attrs):
        self.n += 1
        self.stack.append((tag, self.n))

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        if data.split():
            elements = tuple(x for x in self.stack if x[0] != "a")
            kinds = tuple(x if x[0] in html_extract.CONTAINER else x[0] for x in elements)
            self.blocks.append((" ".join(data.split()), kinds, elements, len(data) if len(elements) < len(self.stack) else 0))


@pytest.mark.parametrize("seed", range(20))
def test_html_scores_by_brute_force(seed):
    source = _unmarked(seed)[0].replace("<li><a", "</li><li><a").replace("<ul></li>", "<ul>").replace("</ul>", "</li></ul>")
    naive = _Naive()
    naive.feed(source)
    blocks = naive.blocks

    def fused(path):
        own = [(b[0], b[3]) for b in blocks if b[1] == path]
        sizes = [len(t) for t, _ in own]
        mean = sum(sizes) / len(own)
        marks = sum(sum(t.count(c) for c in ".,;:!?") for t, _ in own) / len(own)
        deviation = math.sqrt(sum((x - mean) ** 2 for x in sizes) / len(own))
        return mean * (1 + marks) * (1 + deviation / (1 + mean)) * (1 - 0.9 * sum(a for _, a in own) / sum(sizes))

    want = {}
    for path in {b[1] for b in blocks}:
        smooth = []
        for i in [i for i, b in enumerate(blocks) if b[1] == path]:
            total = weight = 0.0
            for j in range(max(0, i - 2), min(len(blocks), i + 3)):
                a, b = blocks[i][2], blocks[j][2]
                shared = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                w = math.exp(-((i - j) ** 2) / 2) * 2 * shared / (len(a) + len(b))
                total, weight = total + w * fused(blocks[j][1]), weight + w
            smooth.append(total / weight)
        want[path] = sum(smooth) / len(smooth)
    page = html_extract.read(source)
    got = html_extract.path_scores(page.blocks)
    assert [b.text for b in page.blocks] == [b[0] for b in blocks]
    for b, (_, path, _, _) in zip(page.blocks, blocks):
        assert got[b.path] == pytest.approx(want[path], rel=1e-9)


@pytest.mark.parametrize("page", ["".join(f"<div>t{i}" for i in range(20_000)), "<b>" * 20_000 + "x" + "</i>" * 20_000, "<div class=ad>" * 20_000 + "x", "<ul><li>" * 20_000 + "x</li>" * 20_000, "<p>" + "<b>" * 20_000 + "x" + "</p>" * 20_000])
def test_html_is_linear_in_nesting(page):
    began = time.perf_counter()
    html_extract.main_text(page)
    assert time.perf_counter() - began < 5


def test_html_odd(spark):
    rows = [(None, None, None), (1, "u", ""), (1, "u", "<p>x"), (1, "u", "<p>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert sorted(str(tuple(r)) for r in html_extract.extract(df).collect()) == sorted(map(str, [(None, None, "", 0), (1, "u", "", 0), (1, "u", "x", 1), (1, "u", "x", 1)]))
    assert html_extract.extract(df.limit(0)).count() == 0


# --- 10


def test_license_spans(spark):
    mit = license_scan.TEMPLATES[1][1]
    cut = mit.split()
    rows = [
        (1, "Code. " + mit + " End."), (2, " ".join(cut[:20] + ["some", "words"] + cut[20:])), (3, " ".join(cut[:5])), (4, None), (5, ""), (5, ""),
        (None, "the MIT-License"), (7, "Licensed under CC BY-NC 4.0."), (8, "mit licenses general public license"),
    ]
    df = spark.createDataFrame(rows, DOCS).withColumn("labels", F.lit("clash"))
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    assert got[1].labels == "mit" and got[2].labels == "mit" and got[3].labels == "" and got[1].n_base == 0 and got[1].score == 1.0
    assert got[None].base_labels == "mit" and (got[None].first_word, got[None].last_word) == (1, 1)
    assert got[7].labels == "cc-by-nc" and got[8].base_labels == "gpl" and got[8].n_base == 1
    assert license_scan.scan(df).count() == len(rows) and license_scan.scan(df.limit(0)).count() == 0
    spans = license_scan.find_spans(df).where("doc_id = 1 and verified and template = 1").collect()
    assert [(s.first_word, s.last_word) for s in spans] == [(1, 1 + len(words(re.sub(r"[^A-Za-z0-9]+", " ", mit))) - 1)]


def test_license_scan_uses_no_python(spark):
    plan = license_scan.scan(spark.read.parquet(f"{DATA}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
