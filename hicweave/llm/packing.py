"""Mixture-controlled packing: deficit round-robin over the sources' queues of tokens.

Each source is a queue of its documents' tokens, one end token after each document. A round adds a queue's quantum to
its deficit; quanta are proportional to the target shares and add up to one sequence. A queue is served as soon as its
deficit covers a stretch of `least` tokens, and by whole stretches; the rest is carried over rounds. So a document is cut
where stretches and sequences end and not in every round, however many queues there are, and at any time a queue has got
less than `least` tokens more or less than its share of the tokens. Queues begin with deficits of different parts of a
stretch, so that they take turns. With `least` 1 every sequence holds the shares to the token, at the price of pieces as
short as a quantum. The rounds' tokens form one stream, which is cut into sequences. As the deficit after round j is known
from j quanta, what any round serves is known without running those before it: a document needs only the number of its
queue's tokens before it, which a prefix sum over partitions gives. So deficits carry across sequences and partitions, and
no row waits for another.

The targets are the sources' own shares unless given, so that queues end together; when one ends early, the others go
on in their proportions. Sources without a given target share what the given ones leave of 1 by their own shares.
Sequences are full but the last. Texts of any length are cut freely and placed a stretch at a time. Null texts are empty documents of one end token; null sources are the source ''. Every
source has a queue of its own: the driver and each task hold its name and two numbers. Repeated rows are rows; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, table, trimmed
from .tokens import Ids

LENGTH = 1024
END = 0
#: Quanta are whole multiples of 2 ** -SHIFT tokens.
SHIFT = 16
#: Tokens of a stretch that keeps most documents whole, for callers who can do without the shares in each sequence.
LEAST = 1024
#: Numbers of a block of rounds by queues.
HELD = 1 << 20
#: Tokens whose places are worked out at a time; longer documents are worked out in stretches of as many.
STRETCH = 1 << 18


def tokenise(df: DataFrame, vocabulary: str, queue_of: dict[str, int], end: int = END) -> DataFrame:
    """doc_id, queue, part, before (tokens of this queue earlier in this part), n, ids (16-bit, with the end token)."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, coder, seen = TaskContext.get().partitionId(), Ids(vocabulary), {}
        stop = int(end).to_bytes(2, "little")
        for batch in batches:
            for j in range(0, batch.num_rows, 256):
                piece = batch.slice(j, 256)
                ids = [coder(t) + stop if t else stop for t in piece.column(2).to_pylist()]
                queues = [queue_of[s or ""] for s in piece.column(1).to_pylist()]
                before = []
                for q, x in zip(queues, ids):
                    before.append(seen.get(q, 0))
                    seen[q] = before[-1] + len(x) // 2
                arrays = [piece.column(0), pa.array(queues, pa.int32()), pa.array([part] * len(ids), pa.int32()), pa.array(before, pa.int64()), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "queue", "part", "before", "n", "ids"])

    kind = dict(df.dtypes)["doc_id"]
    return df.select("doc_id", "source", "text").mapInArrow(run, f"doc_id {kind}, queue int, part int, before bigint, n bigint, ids binary")


def quanta(totals: list[int], targets: list[float] | None, length: int = LENGTH) -> list[int]:
    """Quantum of each queue in 2 ** -SHIFT tokens."""
    if targets is None:
        every = sum(totals) or 1
        return [max(1, (t * length << SHIFT) // every) for t in totals]
    every = sum(targets) or 1
    return [max(1, round(t / every * length * (1 << SHIFT))) for t in targets]


def phases(queues: int, least: int) -> np.ndarray:
    """Deficits that queues begin with, less than a stretch, spread evenly."""
    return (np.arange(queues) * 0.6180339887498949 % 1 * (least - 1)).astype(np.int64) << SHIFT


def place(first: np.ndarray, n: np.ndarray, queue: np.ndarray, totals: list[int], quantum: list[int], length: int = LENGTH, least: int = 1) -> tuple[np.ndarray, ...]:
    """Pieces of documents that hold n tokens of their queue from number first on: document (place in the arguments),
    start in the document, tokens, sequence, offset there."""
    q, cap, phase, unit = np.array(quantum, np.int64), np.array(totals, np.int64), phases(len(quantum), least), least << SHIFT
    round_of = lambda stretch, r: -(-((stretch + 1) * unit - phase[r]) // q[r]) - 1  # noqa: E731  that serves it
    last = round_of(-(-cap // least) - 1, np.arange(len(q))) + 1  # no round after it serves this queue
    served = lambda j, r: np.minimum(cap[r], (np.minimum(j, last[r]) * q[r] + phase[r]) // unit * least)
    s0 = first // least
    count = (first + n - 1) // least - s0 + 1
    doc = np.repeat(np.arange(len(n)), count)
    stretch = s0[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    r = queue[doc]
    a, b = np.maximum(first[doc], stretch * least), np.minimum((first + n)[doc], (stretch + 1) * least)
    j = round_of(stretch, r)
    at = a - served(j, r)
    order = np.argsort(j, kind="stable")
    rounds, begins = np.unique(j[order], return_index=True)
    begins = np.append(begins, len(j))
    every, step = np.arange(len(q)), max(1, HELD // max(1, len(q)))
    for k in range(0, len(rounds), step):
        some = rounds[k : k + step, None]
        own = served(some, every)
        more = served(some + 1, every) - own
        x = order[begins[k] : begins[min(k + step, len(rounds))]]
        row = np.searchsorted(some[:, 0], j[x])
        at[x] += own.sum(1)[row] + (np.cumsum(more, 1) - more)[row, r[x]]
    size = b - a
    if len(doc):  # stretches that follow each other in the stream are one piece
        new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + size[:-1])]))
        doc, a, at, size = doc[new], a[new], at[new], np.add.reduceat(size, new)
    begin = a - first[doc]
    cuts = (at + size - 1) // length - at // length + 1
    x = np.repeat(np.arange(len(doc)), cuts)
    k = np.arange(len(x)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    low = np.maximum(at[x], (at[x] // length + k) * length)
    high = np.minimum(at[x] + size[x], (at[x] // length + k + 1) * length)
    return doc[x], begin[x] + low - at[x], high - low, low // length, low % length


def stretches(n: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Documents of n tokens in lots of about `most`: which document, from which of its tokens on, and how many. A round
    serves a queue a stretch at least or none, so that a lot has no more pieces than tokens."""
    cuts = np.maximum(1, -(-n // most))
    doc = np.repeat(np.arange(len(n)), cuts)
    skip = (np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * most
    size = np.minimum(most, n[doc] - skip)
    lot = np.cumsum(size) // most
    for k in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(lot)) + 1):
        if len(k):
            yield doc[k], skip[k], size[k]


def pack(df: DataFrame, vocabulary: str, targets: dict[str, float] | None = None, length: int = LENGTH, end: int = END, least: int = 1) -> DataFrame:
    """Pieces: doc_id, queue, start, length, ids (binary, little-endian 32-bit), doc_tokens, sequence_id, offset. Every
    sequence holds the shares; with a larger `least`, such as LEAST, documents stay whole and shares hold over many."""
    sizes = df.groupBy(F.coalesce("source", F.lit("")).alias("s")).agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("b"))
    names = [r.s for r in sizes.orderBy(F.desc("b"), "s").collect()]  # one row for each source
    queue_of = {s: k for k, s in enumerate(names)}
    tokens = materialise(tokenise(df, vocabulary, queue_of, end), "tokens")

    sums = tokens.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    per_queue = dict(sums.groupBy("queue").agg(F.sum("n")).collect())
    totals = [per_queue.get(k, 0) for k in range(len(names))]
    wanted = None
    if targets is not None:
        left = max(0.0, 1 - sum(targets.values()))
        others = sum(t for s, t in zip(names, totals) if s not in targets) or 1
        wanted = [targets[s] if s in targets else left * t / others for s, t in zip(names, totals)]
    quantum = quanta(totals, wanted, length)
    begins = sums.select("queue", "part", (F.sum("n").over(Window.partitionBy("queue").orderBy("part")) - F.col("n")).alias("begin"))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                first, n, queue = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (1, 2, 3))
                held = np.concatenate([[0], np.cumsum(n)])
                flat = np.frombuffer(b"".join(part.column(4).to_pylist()), "<u2")
                for whose, skip, count in stretches(n, STRETCH):
                    doc, start, size, sequence, offset = place(first[whose] + skip, count, queue[whose], totals, quantum, length, least)
                    # A piece's bytes follow the last one's, so one buffer with offsets holds them all.
                    order = np.lexsort((start, doc))
                    doc, start, size, sequence, offset = (x[order] for x in (doc, start, size, sequence, offset))
                    start, doc = start + skip[doc], whose[doc]
                    begin = held[whose[0]] + skip[0]
                    ids = flat[begin : begin + count.sum()].astype("<u4")
                    ends = np.concatenate([[0], np.cumsum(size)]) * 4
                    bytes_ = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
                    arrays = [part.column(0).take(pa.array(doc)), pa.array(queue[doc], pa.int32()), pa.array(start), pa.array(size), bytes_, pa.array(n[doc], pa.int64()), pa.array(sequence), pa.array(offset)]
                    yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "queue", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    placed = tokens.join(begins, ["queue", "part"]).select("doc_id", (F.col("begin") + F.col("before")).alias("first"), "n", "queue", "ids")
    kind = dict(df.dtypes)["doc_id"]
    return placed.mapInArrow(run, f"doc_id {kind}, queue int, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "queue")
