"""Byte-level BPE by a monoid tree: encodings of neighbouring byte strings are joined, and joins form a tree.

Each match of the splitting pattern is encoded on its own. A long match is halved until its parts are short; parts are
encoded by merging the pair of lowest rank again and again, and two encodings are joined by encoding a window around
the seam anew. The window grows until the tokens beside it are stable: a sequence of tokens is the encoding of its
bytes exactly if each adjacent pair is the encoding of its own bytes, so it is enough to test the two pairs at the
window's ends. Decoding concatenates bytes, up the same tree. Null texts count as empty; rows are independent.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .common import COARSE, table

#: Byte strings of up to this length are encoded without halving.
LEAF = 16
#: Encodings kept by a task; the store is emptied when it is full.
KEPT = 400_000
#: Below it the classes of the regex module are those of the tiktoken library for every character; from it on, the
#: splitter of the tokenizers library is asked, whose classes are the same throughout.
ALIKE = "\u0530"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Monoid:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self._pairs: dict[tuple[bytes, bytes], bool] = {}

    def leaf(self, data: bytes) -> list[bytes]:
        """Tokens of a short string, as bytes: the adjacent pair of lowest rank merges first, the leftmost of equals."""
        if data in self.ranks:
            return [data]
        rank = self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        none = len(self.ranks) + 1
        costs = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while costs:
            best = min(costs)
            if best == none:
                break
            k = costs.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del costs[k]
            if k < len(costs):
                costs[k] = rank(parts[k] + parts[k + 1], none)
            if k:
                costs[k - 1] = rank(parts[k - 1] + parts[k], none)
        return parts

    def stable(self, a: bytes, b: bytes) -> bool:
        got = self._pairs.get((a, b))
        if got is None:
            if len(self._pairs) > KEPT:
                self._pairs.clear()
            got = self._pairs[a, b] = self.leaf(a + b) == [a, b]
        return got

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """The encoding of the two strings together, from their encodings."""
        if not left or not right:
            return left or right
        width = 1
        if self.stable(left[-1], right[0]):
            return left + right
        while True:
            i, j = max(0, len(left) - width), min(len(right), width)
            middle = self.encode_window(left[i:] + right[:j])
            if (i == 0 or self.stable(left[i - 1], middle[0])) and (j == len(right) or self.stable(middle[-1], right[j])):
                return left[:i] + middle + right[j:]
            width *= 2

    def encode_window(self, tokens: list[bytes]) -> list[bytes]:
        data = b"".join(tokens)
        return self.leaf(data) if len(data) <= 16 * LEAF else self.wide(data)

    def wide(self, data: bytes) -> list[bytes]:
        """As leaf, for a window that had to grow far, as in a long run of one letter: pairs wait in a heap."""
        rank, n = self.ranks.get, len(data)
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at each place
        alive = [True] * n
        heap = [(r, k, k + 2) for k in range(n - 1) if (r := rank(data[k : k + 2])) is not None]
        heapq.heapify(heap)

        def push(k: int) -> None:
            if k >= 0 and ends[k] < n:
                to = ends[ends[k]]
                r = rank(data[k:to])
                if r is not None:
                    heapq.heappush(heap, (r, k, to))

        while heap:
            _, k, to = heapq.heappop(heap)
            if not alive[k] or ends[k] >= n or ends[ends[k]] != to or ends[k] >= to:
                continue
            alive[ends[k]] = False
            ends[k] = to
            if to < n:
                before[to] = k
            push(k)
            push(before[k])
        out, k = [], 0
        while k < n:
            out.append(data[k : ends[k]])
            k = ends[k]
        return out

    def tree(self, data: bytes) -> list[bytes]:
        if len(data) <= LEAF:
            return self.leaf(data) if data else []
        half = len(data) // 2
        left = self.tree(data[:half])
        return self.join(left, left if data[:half] == data[half:] else self.tree(data[half:]))

    def encode(self, data: bytes) -> list[int]:
        """Ids of one match of the splitting pattern."""
        return [self.ranks[t] for t in self.tree(data)]

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 4096:
            return b"".join([self.bytes_of[i] for i in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


class TextEncoder:
    """Whole texts to little-endian 32-bit ids; runs of signs that were seen before are looked up."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex
        from tokenizers import Regex, pre_tokenizers

        self.monoid = Monoid(ranks)
        self._split = regex.compile(pattern).findall
        self._rare = pre_tokenizers.Split(Regex(pattern), "isolated").pre_tokenize_str
        self._kept: dict[str, bytes] = {}
        self._matches: dict[str, bytes] = {}
        self._id = {b: i.to_bytes(4, "little") for b, i in ranks.items()}

    def _match(self, match: str) -> bytes:
        got = self._matches.get(match)
        if got is None:
            if len(self._matches) > KEPT:
                self._matches.clear()
            got = b"".join([self._id[t] for t in self.monoid.tree(match.encode("utf-8", "replace"))])
            if len(match) <= 8 * LEAF:
                self._matches[match] = got
        return got

    def _run(self, run: str) -> bytes:
        matches = self._split(run) if run.isascii() or max(run) < ALIKE else [run[a:b] for _, (a, b) in self._rare(run)]
        return b"".join([self._match(m) for m in matches])

    def encode(self, text: str) -> bytes:
        kept = self._kept
        if len(kept) > KEPT:
            kept.clear()
        runs = COARSE.findall(text)
        out = [kept.get(r) for r in runs]
        if None in out:
            for k, r in enumerate(runs):
                if out[k] is None:
                    out[k] = kept.get(r) or self._run(r)
                    if len(r) <= 8 * LEAF:
                        kept[r] = out[k]
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return self.monoid.decode(memoryview(ids).cast("I").tolist())


def encode(df: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids (binary, little-endian 32-bit) and decoded (binary) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = TextEncoder(load_ranks(ranks_path), pattern)
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.iloc[at : at + 200]
                ids = [coder.encode(t or "") for t in part[text]]
                yield pd.DataFrame({key: part[key].array, "n_tokens": [len(x) // 4 for x in ids], "ids": ids, "decoded": [coder.decode(x) for x in ids]})

    schema = f"`{key}` {dict(df.dtypes)[key]}, n_tokens bigint, ids binary, decoded binary"
    return df.select(key, text).mapInPandas(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from pyspark.sql import functions as F

    out = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
