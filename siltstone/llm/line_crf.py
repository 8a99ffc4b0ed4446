"""Quality rules with line sequence labelling.

Every line of a text is content or boilerplate; a linear-chain conditional
random field scores the labels by features of the line and by which label
follows which, and Viterbi decoding finds the best sequence.  A document is kept
if at least SHARE of the characters in its labelled lines is content.

The field is trained here, by gradient ascent on the likelihood, on the lines
of a bounded sample of rows of labelled documents (SAMPLE_DOCS, texts up to
SAMPLE_CHARS, none whose crc32(doc_id) mod 4 is 2).  Documents are labelled as
wholes, lines are not, so line labels are derived (``line_labels``):

- in a good document, lines that repeat an earlier one, rows of cells and lines
  of site words are boilerplate, the rest is content;
- in a bad one, lines that a logistic model of single lines (fitted on the
  documents' labels) takes for content with SURE probability are content, the
  rest is boilerplate, unless that leaves none;
- good documents of the sample serve once more with boilerplate planted in
  them: lines of bad documents and stock lines of site words.

So sequences hold both labels, and the moves between them are learned.

Beside it stand plain counts of words, symbols, repeated lines and repeated
three-word windows, and a base rule on them: short texts and texts made of
repeats fail whatever their lines say.

The sample is bounded by rows, so a document id that is repeated does not make
it larger.

Nulls, ties and odd input: a null or empty text has no words, fails the base
rule and is not kept; of equal scores Viterbi takes content; without labels of
both kinds every line is content; a null doc_id stays; repeated rows give
repeated results; an empty table gives an empty result; further columns are not
read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 0.5
MIN_WORDS = 50
SAMPLE_DOCS, SAMPLE_CHARS = 2_000, 20_000
HELD_OUT = 2
STEPS, RATE, L2 = 200, 0.3, 1e-3
#: Longer texts are trained on in stretches of so many lines.
STRETCH = 64
#: Least probability at which a line of a bad document counts as content.
SURE = 0.6
#: Lines longer than this are no stock lines.
STOCK_WORDS = 30
#: Words of menus, notices and footers.
SITE_WORDS = frozenset(
    "about accept account advertisement archive arrow blog browse cart categories category click comments contact continue cookie cookies copyright "
    "disclaimer download email facebook faq feedback follow forum home imprint instagram javascript jobs linkedin login logout menu more navigation "
    "newsletter next page pinterest policy powered previous print privacy register reply reserved rights rss search settings share shop sign "
    "sitemap skip sponsored subscribe tags terms tweet twitter us youtube ©".split()
)
#: Stock lines for planting: each is filled with site words.
STOCK = ("{} | {} | {} | {}", "{} {} {}", "{}", "{} » {} » {}", "Copyright © {} {}. All rights reserved.", "{} to our {}!", "{} this {}", "{} / {} / {}", "We use cookies. {} or {}.", "{} · {} · {}", "Click {} to {} {}")

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: names of the features, in order
FEATURES = (
    "one", "few words", "words", "word length", "symbols", "upper case", "digits", "marks", "repeated words", "same words on",
    "same as earlier", "ends a sentence", "starts upper case", "cells", "site words",
)


def line_features(line: str, words: list[str], seen: bool) -> list[float]:
    n, chars = len(words), max(1, len(line))
    symbols = sum(map(line.count, SYMBOLS))
    letters = sum(map(str.isalpha, line))
    upper = 0 if line.islower() else sum(map(str.isupper, line))
    digits = 0 if letters == chars else sum(map(str.isdigit, line))
    marks = line.count("!") + line.count("?") + line.count("…")
    return [
        1.0,
        float(n < 4),
        min(n, 40) / 20.0,
        min(letters / n, 15.0) / 10.0,
        min(1.0, 4.0 * symbols / chars),
        upper / max(1, letters),
        digits / chars,
        min(1.0, 8.0 * marks / chars),
        1.0 - sum(len(set(words[i : i + 40])) for i in range(0, n, 40)) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        float(seen),
        float(line.rstrip()[-1:] in ".!?…\"'»"),
        float(line.lstrip()[:1].isupper()),
        min(1.0, 2.0 * (line.count("|") + line.count("»") + line.count("•") + line.count("·")) / n),
        min(1.0, 2.0 * sum(w.strip(".,:;!?()").lower() in SITE_WORDS for w in words) / n) if n <= STOCK_WORDS else 0.0,
    ]


def described(text: str | None) -> tuple[tuple[int, ...], list[list[float]], list[int]]:
    """((n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), features
    and characters of every line that has a word)."""
    text = text or ""
    words = _WORD.findall(text)
    n = len(words)
    feats, sizes, earlier = [], [], set()
    dup = at = 0
    for line in text.split("\n"):
        if not line.strip(_WHITE):
            continue
        own = _WORD.findall(line) if "\n" in text else words
        at += len(own)
        seen = line in earlier
        dup += seen
        earlier.add(line)
        feats.append(line_features(line, own, seen))
        sizes.append(len(line))
    repeat = 0
    if n >= 3:
        index: dict[str, int] = {}
        ids = np.array([index.setdefault(w, len(index)) for w in words], dtype=np.int64)
        pair = ids[:-1] * len(index) + ids[1:]
        if len(index) > 2_000_000:
            pair = np.unique(pair, return_inverse=True)[1]
        windows = pair[:-1] * len(index) + ids[2:]
        _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
        twice = counts[inverse] > 1
        covered = np.zeros(n, dtype=bool)
        for k in range(3):
            covered[k : n - 2 + k] |= twice
        repeat = int(covered.sum())
    return (n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup, repeat), feats, sizes


class Field:
    """Linear-chain field over labels 0 (boilerplate) and 1 (content)."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves  # (features,) for label 1; (2, 2)

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """Viterbi: the best labels for emission scores of label 1 (label 0: 0)."""
        (m00, m01), (m10, m11) = self.moves.tolist()
        back = []
        b = c = 0.0
        for i, e in enumerate(scores.tolist()):
            if i:
                from_b0, from_c0 = b + m00, c + m10
                from_b1, from_c1 = b + m01, c + m11
                back.append((from_c0 >= from_b0, from_c1 >= from_b1))
                b, c = max(from_b0, from_c0), max(from_b1, from_c1)
            c += e
        label = c >= b
        out = [label]
        for at_b, at_c in reversed(back):
            label = at_c if label else at_b
            out.append(label)
        return np.array(out[::-1], dtype=bool)


def _padded(sequences: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, labels, mask) of sequences of different lengths."""
    longest, n = max(len(x) for x, _ in sequences), len(sequences)
    X = np.zeros((n, longest, sequences[0][0].shape[1]))
    Y = np.zeros((n, longest), dtype=np.int64)
    for i, (x, y) in enumerate(sequences):
        X[i, : len(x)], Y[i, : len(y)] = x, y
    return X, Y, np.arange(longest) < np.array([len(x) for x, _ in sequences])[:, None]


def likelihood(w: np.ndarray, moves: np.ndarray, X: np.ndarray, Y: np.ndarray, mask: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Weighted log-likelihood of the labels, and its gradient in (w, moves)."""
    longest = X.shape[1]
    both = mask[:, 1:] & mask[:, :-1]
    e = X @ w
    E = np.stack([np.zeros_like(e), e], axis=2)
    A, B = np.zeros_like(E), np.zeros_like(E)
    A[:, 0] = E[:, 0]
    for t in range(1, longest):
        A[:, t] = np.where(mask[:, t, None], E[:, t] + np.logaddexp(A[:, t - 1, :1] + moves[0], A[:, t - 1, 1:] + moves[1]), A[:, t - 1])
    Z = np.logaddexp(A[:, -1, 0], A[:, -1, 1])
    for t in range(longest - 2, -1, -1):
        nxt = B[:, t + 1] + E[:, t + 1]
        back = np.stack([np.logaddexp(moves[j, 0] + nxt[:, 0], moves[j, 1] + nxt[:, 1]) for j in (0, 1)], axis=1)
        B[:, t] = np.where(mask[:, t + 1, None], back, 0.0)
    p1 = np.exp(A[:, :, 1] + B[:, :, 1] - Z[:, None]) * mask
    score = ((Y == 1) * mask * e).sum(axis=1)
    g_m = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            seen = (Y[:, :-1] == a) & (Y[:, 1:] == b) & both
            p = np.exp(A[:, :-1, a] + moves[a, b] + (E + B)[:, 1:, b] - Z[:, None]) * both
            score += seen.sum(axis=1) * moves[a, b]
            g_m[a, b] = ((seen - p).sum(axis=1) * weight).sum()
    g_w = np.einsum("nt,ntk->k", ((Y == 1) * mask - p1) * weight[:, None], X)
    return float(((score - Z) * weight).sum()), np.concatenate([g_w, g_m.ravel()])


def train(sequences: list[tuple[np.ndarray, np.ndarray, int]], prior: float = 0.5) -> Field | None:
    """sequences: (features of the lines, their labels, label of the document);
    prior: the share of good documents."""
    cut = [(x[i : i + STRETCH], y[i : i + STRETCH], q) for x, y, q in sequences for i in range(0, len(x), STRETCH)]
    if len({int(v) for _, y, _ in cut for v in y}) < 2:
        return None
    # the sample has as many documents of either kind; each counts as often as its kind stands in the corpus
    lines = [sum(len(x) for x, _, q in cut if q == kind) for kind in (0, 1)]
    each = [(1 - prior) / max(1, lines[0]), prior / max(1, lines[1])]
    groups: dict[int, list] = {}
    for x, y, q in cut:  # sequences of about one length are padded together
        groups.setdefault(max(0, len(x) - 1).bit_length(), []).append((x, y, q))
    parts = [(*_padded([(x, y) for x, y, _ in g]), np.array([each[q] for _, _, q in g])) for g in groups.values()]
    k = cut[0][0].shape[1]
    at, m = np.zeros(k + 4), [np.zeros(k + 4), np.zeros(k + 4)]
    for step in range(1, STEPS + 1):
        w, moves = at[:k], at[k:].reshape(2, 2)
        g = sum(likelihood(w, moves, *part)[1] for part in parts) - L2 * at
        m[0] = 0.9 * m[0] + 0.1 * g
        m[1] = 0.999 * m[1] + 0.001 * g * g
        at = at + RATE * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    return Field(at[:k], at[k:].reshape(2, 2))


def _logistic(X: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a logistic model by Newton's method with a ridge."""
    w = np.zeros(X.shape[1])
    for _ in range(25):
        p = 1.0 / (1.0 + np.exp(-np.clip(X @ w, -30, 30)))
        h = (X * (weight * p * (1 - p))[:, None]).T @ X + 1e-3 * np.eye(len(w))
        w = w + np.linalg.solve(h, X.T @ (weight * (y - p)) - 1e-3 * w)
    return w


_REPEATED, _CELLS, _SITE = FEATURES.index("same as earlier"), FEATURES.index("cells"), FEATURES.index("site words")


def line_labels(docs: list[tuple[np.ndarray, int]]) -> list[np.ndarray]:
    """Derived labels (1 content) of the lines of documents (features, label)."""
    X = np.concatenate([x for x, _ in docs])
    y = np.concatenate([np.full(len(x), q) for x, q in docs])
    each = np.concatenate([np.full(len(x), 1.0 / len(x)) for x, _ in docs])  # every document counts alike
    weight = each * np.where(y == 1, 1.0 / max(1, sum(q == 1 for _, q in docs)), 1.0 / max(1, sum(q == 0 for _, q in docs))) * len(docs)
    w = _logistic(X, y, weight)
    out = []
    for x, q in docs:
        marked = (x[:, _REPEATED] == 1) | (x[:, _CELLS] >= 0.5) | (x[:, _SITE] >= 0.9)
        if q == 1:
            out.append((~marked).astype(np.int64))
            continue
        content = (1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30))) >= SURE) & ~marked
        out.append((content if not content.all() else np.zeros(len(x))).astype(np.int64))
    return out


def stock_line(rng: np.random.Generator) -> str:
    words = sorted(SITE_WORDS)
    form = STOCK[int(rng.integers(len(STOCK)))]
    return form.format(*[words[int(rng.integers(len(words)))].capitalize() for _ in range(form.count("{}"))])


def planted(text: str, others: list[str], rng: np.random.Generator) -> tuple[str, list[bool]]:
    """The text with runs of boilerplate lines among its lines (others: lines to
    plant beside stock lines), and which lines those are."""
    lines, out = [x for x in text.split("\n") if x.strip(_WHITE)], []
    places = set(rng.integers(0, len(lines) + 1, size=int(rng.integers(1, 4))).tolist())
    for i in range(len(lines) + 1):
        if i in places:
            for _ in range(int(rng.integers(1, 5))):
                other = others and rng.random() < 0.3
                out.append((others[int(rng.integers(len(others)))] if other else stock_line(rng), True))
        if i < len(lines):
            out.append((lines[i], False))
    return "\n".join(x for x, _ in out), [p for _, p in out]


def sequences_of(rows: list[tuple[str | None, int]], seed: int = 7) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Training sequences of documents (text, label): their own lines and, of
    good ones, a second form with boilerplate planted."""
    docs = [(text, q, np.array(feats)) for text, q in rows if (feats := described(text)[1])]
    if not docs:
        return []
    labels = line_labels([(x, q) for _, q, x in docs])
    out = [(x, y, q) for (_, q, x), y in zip(docs, labels)]
    others = sorted({line for text, q, _ in docs if q == 0 for line in text.split("\n") if 1 <= len(_WORD.findall(line)) <= STOCK_WORDS and not _ordinary(line)})
    rng = np.random.default_rng(seed)
    for (text, q, _), y in zip(docs, labels):
        if q == 1:
            whole, marks = planted(text, others, rng)
            feats, own = np.array(described(whole)[1]), iter(y.tolist())
            out.append((feats, np.array([0 if m else next(own) for m in marks]), 1))
    return out


def _ordinary(line: str) -> bool:
    """Whether a line has no symbols, cells, marks or shouting."""
    f = line_features(line, _WORD.findall(line), False)
    return f[FEATURES.index("symbols")] < 0.05 and f[_CELLS] < 0.2 and f[FEATURES.index("upper case")] < 0.5 and f[FEATURES.index("same words on")] < 0.3


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Field | None:
    """Trains on a bounded sample of rows of labelled documents; None without both kinds of line."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 4 != HELD_OUT)
    kinds = [known.where(f"quality = {q}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs // 2) for q in (0, 1)]
    sample = docs.select("doc_id", "text").where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(kinds[0].union(kinds[1])), "doc_id")
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "text").limit(sample_docs)
    rows = [(r["text"], int(r["quality"] == 1)) for r in sample.collect()]
    shares = known.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    sequences = sequences_of(rows)
    return train(sequences, shares or 0.5) if sequences and len({q for _, q in rows}) == 2 else None


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines long, content_share double"
)


def judge(docs: DataFrame, field: Field | None, share: float = SHARE) -> DataFrame:
    """Counts and verdict for every document; no shuffle."""

    def run(batches):
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                counts, feats, sizes = described(text)
                n, repeat = counts[0], counts[4]
                failed = n < MIN_WORDS or 100 * repeat > 50 * n
                content = 0.0
                if feats:
                    labels = field.decode(np.array(feats) @ field.weights) if field else np.ones(len(feats), dtype=bool)
                    content = float(np.dot(labels, sizes)) / sum(sizes)
                rows.append((doc_id, *counts, failed, not failed and content >= share, len(feats), content))
            cols = list(zip(*rows)) or [()] * 10
            kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == HELD_OUT


def op6_line_crf(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
