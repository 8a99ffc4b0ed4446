"""Packing of tokenised examples as vector bin packing.

A sequence has room for so many tokens, segments and loss-bearing tokens at once
(``Limits``).  An example is a token sequence of one or more segments, such as the
turns of a conversation; a piece of it takes as many segments as it touches.  Each
task streams its rows and fills one sequence at a time: of the waiting pieces that
fit in all three respects, the next one is that whose demand vector has the largest
dot product with what is left of the sequence, each divided by the limit.  Pieces
with equal demands are interchangeable and counted together, so a choice looks at
distinct demands only.  When nothing fits, the largest piece is cut to fill the gap;
examples longer than a sequence are first cut into pieces that fit one.  The last
sequence of a task is cut into sequences whose lengths are powers of two, which need
no padding; any other is full in tokens unless another limit closed it.

Documents are one segment each, and all their tokens bear loss, so for them loss is
no limit of its own; ``conversation_packing`` is the case in which all three differ.

No row is shuffled: packing is done where the rows are read, in windows of
WINDOW_TOKENS, with the open sequence carried from one window to the next.  A
sequence_id is the task's partition number times 2**40 plus a count.  The rows
of a partition must come in a repeatable order (a table scan does), so that a
task that is run again packs alike.

Nulls, ties and odd input: a null text counts as empty and still has the end
token; a null id stays null; repeated rows are packed as rows of their own;
equal demands are taken in order of arrival; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict, deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import durable

CAPACITY = 1024
MAX_SEGMENTS = 256
WINDOW_TOKENS = 2_000_000
END_ID = 0

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, segments long"


@dataclass
class Limits:
    tokens: int = CAPACITY
    segments: int = MAX_SEGMENTS
    loss: int = CAPACITY

    def weights(self) -> np.ndarray:
        """1 / limit**2 times the square of their common multiple, so that dot products are whole numbers."""
        whole = math.lcm(self.tokens, self.segments, self.loss)
        if whole >= 1 << 31:
            raise ValueError("limits without a common multiple below 2**31")
        return np.array([(whole // m) ** 2 for m in (self.tokens, self.segments, self.loss)], dtype=np.int64)


#: Limits of conversation_packing: a conversation of a few turns needs several segments, and most of its tokens bear loss.
CHAT_LIMITS = Limits(tokens=1024, segments=8, loss=800)


@dataclass
class _Example:
    doc_id: int | None
    ids: np.ndarray
    loss: np.ndarray | None  # None: every token bears loss
    starts: np.ndarray | None = None  # where segments begin, the first at 0; None: one segment

    def demand(self, a: int, b: int) -> tuple[int, int, int]:
        """Tokens, segments and loss-bearing tokens of a piece."""
        loss = b - a if self.loss is None else int(self.loss[a:b].sum())
        if self.starts is None:
            return b - a, 1, loss
        return b - a, int(np.searchsorted(self.starts, b, "left") - np.searchsorted(self.starts, a, "right")) + 1, loss

    def longest(self, a: int, tokens: int, segments: int, loss: int) -> int:
        """End of the longest piece from a on within all limits."""
        b = min(len(self.ids), a + tokens)
        if self.starts is not None:
            last = int(np.searchsorted(self.starts, a, "right")) - 1 + segments
            if last < len(self.starts):
                b = min(b, int(self.starts[last]))
        elif not segments:
            return a
        if self.loss is None:
            return min(b, a + loss)
        total = np.cumsum(self.loss[a:b])
        return a + int(np.searchsorted(total, loss, "right"))


@dataclass
class _Sequence:
    pieces: list[tuple[_Example, int, int]] = field(default_factory=list)
    tokens: int = 0
    segments: int = 0
    loss: int = 0


class Packer:
    """Fills sequences of one task; add() and close() give finished rows."""

    def __init__(self, limits: Limits, first_id: int):
        self.limits, self.next_id = limits, first_id
        self.open = _Sequence()

    def _emit(self, seq: _Sequence, out: list[tuple]) -> None:
        offset = 0
        for x, a, b in seq.pieces:
            _, segments, loss = x.demand(a, b)
            out.append((x.doc_id, a, b - a, zlib.crc32(x.ids[a:b].tobytes()), len(x.ids), self.next_id, offset, loss, segments))
            offset += b - a
        self.next_id += 1

    def _place(self, x: _Example, a: int, b: int, out: list[tuple]) -> None:
        s, lim = self.open, self.limits
        tokens, segments, loss = x.demand(a, b)
        s.pieces.append((x, a, b))
        s.tokens += tokens
        s.segments += segments
        s.loss += loss
        if s.tokens == lim.tokens or s.segments == lim.segments or s.loss == lim.loss:
            self._emit(s, out)
            self.open = _Sequence()

    def add(self, examples: list[_Example], out: list[tuple]) -> None:
        lim = self.limits
        waiting: dict[tuple[int, int, int], deque] = defaultdict(deque)
        for x in examples:
            a = 0
            while a < len(x.ids):
                b = x.longest(a, lim.tokens, lim.segments, lim.loss)
                if b - a == lim.tokens:
                    self._emit(_Sequence([(x, a, b)]), out)  # a full sequence of its own
                else:
                    waiting[x.demand(a, b)].append((x, a, b))
                a = b
        # distinct demands as arrays; a demand that appears later (by a cut) is added
        kinds = sorted(waiting)
        index = {k: i for i, k in enumerate(kinds)}
        demand = np.array(kinds, dtype=np.int64).reshape(-1, 3)
        left = np.array([len(waiting[k]) for k in kinds], dtype=np.int64)
        remaining = int(left.sum())
        scaled = demand * lim.weights()
        while remaining:
            s = self.open
            room = np.array([lim.tokens - s.tokens, lim.segments - s.segments, lim.loss - s.loss])
            fits = (left > 0) & (demand <= room).all(axis=1)
            if fits.any():
                i = int(np.argmax(np.where(fits, scaled @ room, -1)))
                x, a, b = waiting[kinds[i]].popleft()
                left[i] -= 1
                remaining -= 1
                self._place(x, a, b, out)
                continue
            i = int(np.argmax(np.where(left > 0, demand[:, 0], -1)))
            x, a, b = waiting[kinds[i]].popleft()
            left[i] -= 1
            remaining -= 1
            cut = min(b, x.longest(a, *room.tolist()))
            if cut == a:  # not even its first token fits: close the sequence
                self._emit(s, out)
                self.open = _Sequence()
            else:
                self._place(x, a, cut, out)
            if cut < b:
                k = x.demand(cut, b)
                if k not in index:
                    index[k] = len(kinds)
                    kinds.append(k)
                    demand = np.vstack([demand, np.array([k], dtype=np.int64)])
                    scaled = demand * lim.weights()
                    left = np.append(left, 0)
                waiting[k].appendleft((x, cut, b))
                left[index[k]] += 1
                remaining += 1

    def close(self, out: list[tuple]) -> None:
        """Cuts the open sequence into sequences of power-of-two lengths."""
        pieces = deque(self.open.pieces)
        total, self.open = self.open.tokens, _Sequence()
        while total:
            size = 1 << (total.bit_length() - 1)
            seq, need = _Sequence(), size
            while need:
                x, a, b = pieces.popleft()
                cut = min(b, a + need)
                seq.pieces.append((x, a, cut))
                if cut < b:
                    pieces.appendleft((x, cut, b))
                need -= cut - a
            self._emit(seq, out)
            total -= size


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    cols = zip(*rows) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=names)


def pack(examples: DataFrame, encode: Callable[[], Callable[[pa.RecordBatch], Iterator[tuple]]], limits: Limits | None = None) -> DataFrame:
    """Packs every row of ``examples``.

    ``encode()`` is called once per task and gives a function from an Arrow
    batch to (id, token ids as '<u4', loss mask or None, segment starts or None)
    for each of its rows.  One row per piece: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset, loss_tokens, segments."""
    limits = limits or Limits()

    def run(batches):
        from pyspark import TaskContext

        packer = Packer(limits, TaskContext.get().partitionId() << 40)
        encoder = encode()
        held, size = [], 0
        for batch in batches:
            for doc_id, ids, loss, starts in encoder(batch):
                held.append(_Example(doc_id, ids, loss, starts))
                size += len(ids)
                if size >= WINDOW_TOKENS:
                    out: list[tuple] = []
                    packer.add(held, out)
                    held, size = [], 0
                    yield _batch(out)
        out = []
        packer.add(held, out)
        packer.close(out)
        yield _batch(out)

    return examples.mapInArrow(run, SCHEMA)


# --- token ids of documents ------------------------------------------------------

_encoders: dict = {}
#: Longer texts, texts beyond U+024F and texts that spell a special token go through
#: the tokenizers library itself; the rest through the same vocabulary in tiktoken,
#: which gives the same ids four times as fast (a test holds them equal).
LONG_TEXT = 200_000
SPECIAL = "<|endoftext|>"
_FAR = re.compile("[^\x00-\u024f]")


def _libraries(json_name: str, ranks_name: str):
    key = (json_name, ranks_name)
    if key not in _encoders:
        import base64
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(ranks_name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _encoders[key] = (Tokenizer.from_file(public_tokenizers.path(json_name)), fast)
    return _encoders[key]


def token_ids(texts: pa.Array, json_name: str = "byte_bpe_50k.json", ranks_name: str = "byte_bpe_50k.tiktoken") -> Iterator[np.ndarray]:
    """The ids that the tokenizers library gives each text, as '<u4' arrays."""
    slow, fast = _libraries(json_name, ranks_name)
    for text in texts:
        text = text.as_py() or ""
        if len(text) <= LONG_TEXT and (text.isascii() or not _FAR.search(text)) and SPECIAL not in text:
            yield np.array(fast.encode_ordinary(text), dtype="<u4")
        else:
            yield np.array(slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


def document_encoder():
    """(doc_id, ids and END_ID, None, None) per row of a batch with doc_id and text."""

    def encode(batch: pa.RecordBatch):
        end = np.array([END_ID], dtype="<u4")
        for doc_id, ids in zip(batch["doc_id"].to_pylist(), token_ids(batch["text"])):
            yield doc_id, np.concatenate([ids, end]), None, None

    return encode


def conversation_encoder():
    """For instruction data: rows (conv_id, segments array<struct<text, loss>>);
    only tokens of segments with loss bear loss."""

    def encode(batch: pa.RecordBatch):
        end = np.array([END_ID], dtype="<u4")
        for conv_id, segments in zip(batch["doc_id"].to_pylist(), batch["segments"].to_pylist()):
            parts = list(token_ids(pa.array([s["text"] for s in segments or []], pa.string())))
            masks = [np.full(len(p), bool(s["loss"])) for p, s in zip(parts, segments or [])]
            parts.append(end)
            masks.append(np.array([False]))
            sizes = [len(p) for p in parts[:-1] if len(p)]  # the end token belongs to the last segment
            yield conv_id, np.concatenate(parts), np.concatenate(masks), np.cumsum([0, *sizes[:-1]])

    return encode


def pack_documents(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    return pack(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), document_encoder, limits)


def chat_segments(conversations: DataFrame) -> DataFrame:
    """doc_id (conv_id) and segments: a turn each, under the mask if an assistant's."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = conversations.groupBy(F.col("conv_id").cast("long").alias("doc_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    text = lambda t: F.concat(F.lit("### "), t["role"], F.lit(": "), t["text"], F.lit("\n"))
    return turns.select("doc_id", F.transform("turns", lambda t: F.struct(text(t).alias("text"), (t["role"] == "assistant").alias("loss"))).alias("segments"))


def pack_conversations(conversations: DataFrame, limits: Limits = CHAT_LIMITS) -> DataFrame:
    """Packs conversations under three limits.  They are collected by conv_id; the
    collected rows are ordered within tasks and kept, so that a task that is run
    again packs alike."""
    rows = durable(chat_segments(conversations).sortWithinPartitions("doc_id"))
    return pack(rows, conversation_encoder, limits)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def conversation_packing(spark, sf_dir: str) -> DataFrame:
    return pack_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
