"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are lower-cased words and their first 4 and 6 characters.  The vocabulary
holds the TERMS terms of largest document frequency among the examples, those in
fewer than LEAST_DOCS or more than MOST_DOCS of them aside, and all that stand out in
toxic ones (chi-square of CHI2 at least).  A term's weight is (1 + log tf) * idf *
relevance: idf counts all documents, and relevance is chi2 / (chi2 + CHI2) + BASE
for terms that are commoner in toxic examples, BASE for the others, so that
insults outweigh the topic but every known word counts.

The examples are a bounded sample of rows of labelled documents (EXAMPLES, half
of either label where there are enough; rows whose crc32(doc_id) mod 4 is 2 are
never used).  They are held in an inverted index whose postings are cut into
blocks of BLOCK examples with each term's largest weight per block.  A query
bounds every block by these maxima, visits blocks from the largest bound down, in
growing steps, and stops where no block can reach the K-th best cosine, so the
nearest are exact.  All examples that share the K-th cosine count.

Neighbours vote with weights that fall with their distance.  The raw vote is
calibrated: the examples are scored with themselves left out, reweighted to the
label's share among all labelled rows, and an isotonic fit maps votes to
probabilities.  A text without any known term gets the share of such examples.
The neighbours are returned as evidence.

Which rows are held out, and which are examples where there are more labelled rows
than EXAMPLES, depends on doc_id; a score does not.

Nulls, ties and odd input: null and empty texts have no terms; a null doc_id
is never held out; equal cosines all count, in order of the examples' contents;
rows that repeat are scored alike; contradicting labels of a document count as
toxic; without labelled rows every score is 0; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import durable

EXAMPLES = 3_072
TERMS = 10_000
LEAST_DOCS, MOST_DOCS = 3, 60
#: Chi-square at which a term has half of the full relevance, and the relevance of all others.
CHI2, BASE = 30.0, 0.05
PREFIXES = (4, 6)
BLOCK = 32
K = 15
HELD_OUT = 2
CUT = 0.3

_WORD = re.compile(r"\w+")


def terms_of(word: str) -> list[str]:
    """A word, and its beginnings marked by a dash."""
    return [word, *[word[:k] + "-" for k in PREFIXES if len(word) > k]]


class Vocabulary:
    """Kept terms; counts them in texts with a bounded cache of words."""

    CACHE = 500_000

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.index = {t: i for i, t in enumerate(terms)}
        self.cache: dict[str, tuple[int, ...]] = {}

    def _known(self, word: str) -> tuple[int, ...]:
        known = self.cache[word] = tuple(self.index[t] for t in terms_of(word) if t in self.index)
        return known

    def _words(self, text: str | None) -> list[str]:
        if len(self.cache) > self.CACHE:
            self.cache.clear()
        return _WORD.findall(text.lower()) if text and self.index else []

    def present(self, text: str | None) -> set[int]:
        """The terms of a text."""
        out: set[int] = set()
        get = self.cache.get
        for word in set(self._words(text)):
            known = get(word)
            if known is None:
                known = self._known(word)
            if known:
                out.update(known)
        return out

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(terms of a text in order, their counts)."""
        ids: list[int] = []
        times: list[int] = []
        get = self.cache.get
        for word, n in Counter(self._words(text)).items():
            known = get(word)
            if known is None:
                known = self._known(word)
            if known:
                ids += known
                times += [n] * len(known)
        if not ids:
            return np.zeros(0, np.int64), np.zeros(0)
        terms, at = np.unique(np.array(ids, dtype=np.int64), return_inverse=True)
        return terms, np.bincount(at, weights=times, minlength=len(terms))


def vector(terms: np.ndarray, counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of unit length; ``weight`` is idf times relevance of every term."""
    w = (1.0 + np.log(counts)) * weight[terms]
    return w / np.sqrt((w * w).sum()) if len(w) else w


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers of the half-open ranges, one range after the other."""
    size = last - first
    end = np.cumsum(size)
    return np.arange(int(end[-1]) if len(end) else 0) + np.repeat(first - (end - size), size)


class BlockMaxIndex:
    """Postings by term, cut into blocks of examples, with block maxima.

    An entry is one term's postings in one block: ``entry_first`` gives a term's
    entries, ``first`` an entry's postings."""

    STEP = 32  # blocks of the first visit; each next one takes twice as many

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK):
        self.n, self.block = len(vectors), block
        self.blocks = max(1, -(-self.n // block))
        doc = np.repeat(np.arange(self.n), [len(t) for t, _ in vectors]).astype(np.int64)
        term = np.concatenate([t for t, _ in vectors]) if vectors else np.zeros(0, np.int64)
        weight = np.concatenate([w for _, w in vectors]) if vectors else np.zeros(0)
        order = np.lexsort((doc, term))
        doc, self.weight = doc[order], weight[order]
        key = term[order] * self.blocks + doc // block
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.doc = doc.astype(np.int32)
        self.first = np.append(begin, len(key))
        self.entry_block = (key[begin] % self.blocks).astype(np.int32)
        self.entry_max = np.maximum.reduceat(self.weight, begin) if len(begin) else np.zeros(0)
        self.entry_first = np.searchsorted(key[begin] // self.blocks, np.arange(n_terms + 1))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(cosines, numbers) of the examples whose cosine is over 0 and no less than
        the k-th largest, best first, ties by number."""
        if not len(terms):
            return np.zeros(0), np.zeros(0, np.int64)
        a, b = self.entry_first[terms], self.entry_first[terms + 1]
        entry = _ranges(a, b)
        own = np.repeat(weights, b - a)
        at = self.entry_block[entry]
        bounds = np.bincount(at, weights=own * self.entry_max[entry], minlength=self.blocks)
        order = np.argsort(-bounds, kind="stable")
        seen, step = 0, self.STEP
        ids, cosines = np.zeros(0, np.int64), np.zeros(0)
        while seen < len(order):
            visit = order[seen : seen + step]
            kth = cosines[k - 1] if len(cosines) >= k else 0.0
            # sums in another order may differ in the last digits
            visit = visit[(bounds[visit] > 0) & (bounds[visit] >= kth - 1e-9)]
            if not len(visit):
                break
            chosen = np.zeros(self.blocks, dtype=bool)
            chosen[visit] = True
            some = chosen[at]
            x, y = self.first[entry[some]], self.first[entry[some] + 1]
            post = _ranges(x, y)
            sums = np.bincount(self.doc[post], weights=np.repeat(own[some], y - x) * self.weight[post], minlength=self.n)
            found = np.flatnonzero(sums)
            found = found[found != without]
            ids, cosines = np.concatenate([ids, found]), np.concatenate([cosines, np.round(sums[found], 12)])
            best = np.lexsort((ids, -cosines))
            ids, cosines = ids[best], cosines[best]
            if len(ids) > k:
                last = int(np.searchsorted(-cosines, -cosines[k - 1], "right"))
                ids, cosines = ids[:last], cosines[:last]
            seen, step = seen + step, step * 2
        return cosines, ids


def vote(cosines: np.ndarray, labels: np.ndarray) -> float:
    """Share of votes for label 1, each 1 / (distance + 0.05)."""
    weights = 1.0 / (1.05 - cosines)
    return float(weights @ labels / weights.sum())


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit: (knots, values)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # value, weight, least x, largest x
    for a, b, c in zip(x[order].tolist(), y[order].tolist(), w[order].tolist()):
        pools.append([b, c, a, a])
        while len(pools) > 1 and (pools[-2][0] >= pools[-1][0] or pools[-2][3] == pools[-1][2]):
            p, q = pools.pop(), pools.pop()
            s = p[1] + q[1]
            pools.append([(p[0] * p[1] + q[0] * q[1]) / s, s, q[2], p[3]])
    knots = np.array([v for p in pools for v in (p[2], p[3])])
    values = np.array([v for p in pools for v in (p[0], p[0])])
    return knots, values


class Model:
    """Examples, index and calibration; sent to the executors as a whole."""

    def __init__(self, terms: list[str], weight: np.ndarray, examples: list[tuple[int, int, np.ndarray, np.ndarray]], share: float, k: int = K):
        """examples: (doc_id, label, terms, counts); weight: idf times relevance."""
        self.terms, self.weight, self.k = terms, weight, k
        vectors = [(t, vector(t, c, weight)) for _, _, t, c in examples]
        # examples with the same heaviest term stand together, which makes the block maxima tight;
        # among them the order is that of their contents
        lead = [int(t[np.argmax(w)]) if len(t) else -1 for t, w in vectors]
        order = sorted(range(len(examples)), key=lambda i: (lead[i], vectors[i][0].tobytes(), vectors[i][1].tobytes(), examples[i][1]))
        vectors = [vectors[i] for i in order]
        self.ids = [examples[i][0] for i in order]
        self.labels = np.array([examples[i][1] for i in order], dtype=np.float64)
        self.index = BlockMaxIndex(vectors, len(terms))
        positive = self.labels.mean() if len(order) else 0.0
        up = share / positive if positive else 0.0
        down = (1 - share) / (1 - positive) if positive < 1 else 0.0
        own = np.where(self.labels == 1, up, down)
        votes, at = [], []
        for i, (t, w) in enumerate(vectors):
            cosines, near = self.index.nearest(t, w, k, without=i)
            if len(near):
                votes.append(vote(cosines, self.labels[near]))
                at.append(i)
        at = np.array(at, dtype=np.int64)
        self.knots, self.values = isotonic(np.array(votes), self.labels[at], own[at]) if len(at) else (np.zeros(1), np.zeros(1))
        bare = np.array([not len(t) for t, _ in vectors], dtype=bool)
        mass = own[bare].sum() if len(vectors) else 0.0
        self.bare = float((own[bare] * self.labels[bare]).sum() / mass) if mass else float(share)

    def score(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """(score, cosines, numbers of the neighbours)."""
        cosines, near = self.index.nearest(terms, vector(terms, counts, self.weight), self.k)
        if not len(near):
            return self.bare, cosines, near
        return float(np.interp(vote(cosines, self.labels[near]), self.knots, self.values)), cosines, near


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, max_terms: int = TERMS, k: int = K) -> Model:
    """Vocabulary and examples from a bounded sample of rows; idf from all documents."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 4 != HELD_OUT)
    share = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    halves = [known.where(f"toxic = {y}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples // 2) for y in (0, 1)]
    sample = docs.select("doc_id", "text").join(F.broadcast(halves[0].union(halves[1])), "doc_id")
    sample = durable(sample.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "text").limit(examples))

    def distinct(batches):
        for b in batches:
            total: Counter = Counter()
            toxic: Counter = Counter()
            for text, y in zip(b["text"].to_pylist(), b["toxic"].to_pylist()):
                own = {t for word in set(_WORD.findall((text or "").lower())) for t in terms_of(word)}
                total.update(own)
                if y == 1:
                    toxic.update(own)
            names = list(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([total[t] for t in names], pa.int64()), pa.array([toxic[t] for t in names], pa.int64())], names=["term", "n", "y"]
            )

    n, n_toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    stats = sample.mapInArrow(distinct, "term string, n long, y long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).where(F.col("n") >= LEAST_DOCS)
    a, b = F.col("y").cast("double"), (F.col("n") - F.col("y")).cast("double")
    c, d = F.lit(float(n_toxic)) - a, F.lit(float(n - n_toxic)) - b
    below = (a + b) * (c + d) * (a + c) * (b + d)
    scored = stats.withColumn("chi2", F.when((below > 0) & (a * d > b * c), float(n) * (a * d - b * c) ** 2 / below).otherwise(0.0))
    telling = F.col("chi2") >= CHI2
    chosen = scored.where(telling | (F.col("n") <= MOST_DOCS)).orderBy(telling.desc(), F.desc("n"), "term").limit(max_terms)
    chi2 = {r["term"]: r["chi2"] for r in chosen.select("term", "chi2").collect()}
    terms = sorted(chi2)
    stands_out = np.array([chi2[t] for t in terms], dtype=np.float64)

    def frequencies(batches):
        vocabulary, total, rows = Vocabulary(terms), np.zeros(len(terms), np.int64), 0
        for b in batches:
            rows += b.num_rows
            for text in b["text"].to_pylist():
                own = vocabulary.present(text)
                total[np.fromiter(own, np.int64, len(own))] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at], pa.int32()), pa.array([rows, *total[at]], pa.int64())], names=["term", "n"])

    counted = dict(docs.select("text").mapInArrow(frequencies, "term int, n long").groupBy("term").agg(F.sum("n")).collect())
    everything = counted.get(-1, 0) or 0
    idf = np.log((1.0 + everything) / (1.0 + np.array([counted.get(i, 0) for i in range(len(terms))], dtype=np.float64))) + 1.0

    def bags(batches):
        vocabulary = Vocabulary(terms)
        for b in batches:
            rows = [vocabulary.counts(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["toxic"].cast(pa.int32()), pa.array([t for t, _ in rows], pa.list_(pa.int32())), pa.array([c for _, c in rows], pa.list_(pa.float64()))],
                names=["doc_id", "toxic", "terms", "counts"],
            )

    got = sample.mapInArrow(bags, "doc_id long, toxic int, terms array<int>, counts array<double>").toArrow()
    rows = [
        (doc_id, int(toxic == 1), np.array(t, dtype=np.int64), np.array(x, dtype=np.float64))
        for doc_id, toxic, t, x in zip(*[got[c].to_pylist() for c in ("doc_id", "toxic", "terms", "counts")])
    ]
    return Model(terms, idf * (stands_out / (stands_out + CHI2) + BASE), rows, share, k)


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
EVIDENCE = "neighbours array<struct<doc_id:bigint,toxic:int,cosine:double>>"
_EVIDENCE = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))


def score(docs: DataFrame, model: Model, cut: float = CUT, evidence: bool = True) -> DataFrame:
    """Score, verdict and, if wanted, the neighbours that voted, for every document; no shuffle."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == HELD_OUT, F.lit(False))

    def neighbours(cosines: np.ndarray, near: np.ndarray) -> list[dict]:
        return [{"doc_id": model.ids[i], "toxic": int(model.labels[i]), "cosine": c} for c, i in zip(cosines.tolist(), near.tolist())]

    def run(batches):
        vocabulary = Vocabulary(model.terms)
        seen: dict[bytes, tuple] = {}  # copies are scored once
        for b in batches:
            rows = []
            for text in b["text"].to_pylist():
                key = hashlib.blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=16).digest()
                if (got := seen.get(key)) is None:
                    if len(seen) > 20_000:
                        seen.clear()
                    s, cosines, near = model.score(*vocabulary.counts(text))
                    got = seen[key] = (round(s, 9), neighbours(cosines, near) if evidence else None)
                rows.append(got)
            columns = [b["doc_id"], b["held_out"], pa.array([s for s, _ in rows], pa.float64()), pa.array([int(s >= cut) for s, _ in rows], pa.int32())]
            names = ["doc_id", "held_out", "score", "predicted"]
            if evidence:
                columns.append(pa.array([n for _, n in rows], _EVIDENCE))
                names.append("neighbours")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    return source.mapInArrow(run, f"{SCHEMA}, {EVIDENCE}" if evidence else SCHEMA)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return score(docs, model, evidence=False)
