"""Substring dedup by super-k-mers: which windows of consecutive words also start in a document with a smaller id.

A window is `k` consecutive words of a document. Each window has a minimiser, the smallest hash among its pairs of
neighbouring words; consecutive windows with the same minimiser are cut out as one string, and strings go to the bucket
of their minimiser. Equal windows have equal minimisers, so a bucket sees all copies of a window, sorts the windows and
compares equal hashes word by word. Before anything is sent, a task settles the windows that it has seen in a smaller
document itself and sends only the smallest document's: of a passage with a million copies, each chunk sends one.

A bounded sample steers two things, which change no result. Minimisers of very many windows have several buckets each, by
the windows' minimisers under a second hash, so that no bucket grows with the commonest words. And windows that several
rows of the sample share are reduced in levels: their strings are dealt over salts by chunk, each salt keeps the smallest
document's, and only these meet in the bucket, so that a passage of every chunk reaches it once for each salt.

Null and blank texts have no words; texts of any length are cut whole. Ids are whole numbers; rows without one neither
lose words nor make others lose them. Equal rows get equal results; rows that share an id but not their text share the
word positions to remove. Empty tables give empty results, and other columns are not read.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, spend, table, trim, trimmed

K = 13
#: Bytes of text that a task handles at a time.
CHUNK = 3_000_000
#: Bytes of input for each bucket; more input gives more buckets, so that a bucket stays small.
BYTES_PER_BUCKET = 1 << 20
LEAST_BUCKETS, MOST_BUCKETS = 256, 1 << 24
#: Rows from which frequent minimisers are learnt, the share of a bucket from which one is split, and the most of them.
SAMPLE_ROWS = 4000
HOT_SHARE = 0.25
MOST_HOT = 100_000
#: Rows of the sample that share a window whose strings are then reduced in levels, and the most salts of a level.
SHARED_ROWS, MOST_SALTS = 3, 4096
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k neighbours of h: the polynomial of a window is put together from those of its parts, which
    double in width."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out, width, power, at = None, 1, int(_MIX), h  # `at`: polynomials of `width` neighbours; power: _MIX ** width
    done, rest = 0, k
    while True:
        if rest & 1:
            out = at if out is None else out[: len(out) - width] * np.uint64(power) + at[done:]
            done += width
        rest >>= 1
        if not rest:
            return mixed(out)
        at = at[:-width] * np.uint64(power) + at[width:]
        width, power = 2 * width, power * power & (1 << 64) - 1


def polynomials(words: pa.Array) -> np.ndarray:
    """A 64-bit hash for each word, from its bytes alone: differences of prefix sums, moved to one origin."""
    if not len(words):
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
    offsets -= offsets[0]
    powers = np.cumprod(np.full(len(data) + 1, _MIX, np.uint64), dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * powers[:-1], dtype=np.uint64)])
    back = np.cumprod(np.full(len(data) + 1, np.uint64(pow(int(_MIX), -1, 1 << 64)), np.uint64), dtype=np.uint64)
    return mixed((sums[offsets[1:]] - sums[offsets[:-1]]) * back[offsets[:-1]] ^ mixed(np.diff(offsets).astype(np.uint64)))


def minimisers(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """The smallest hash of two neighbours in each window of k words. A word followed by itself comes last."""
    pair = mixed((h[:-1] * _MIX + h[1:]) ^ np.uint64(seed)) >> np.uint64(1) | (h[:-1] == h[1:]).astype(np.uint64) << np.uint64(63)
    low, width = pair, 1
    while 2 * width <= k - 1:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = k - 1 - width
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... start[0] + length[0] - 1, start[1], ..."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


def first_owner(hashes: np.ndarray, ids: np.ndarray, at: np.ndarray, owner: np.ndarray, k: int) -> np.ndarray:
    """For windows that begin at ids[at], the smallest owner of an equal window. Hashes only bring windows together;
    equality is that of their k word ids."""
    out = owner.copy()
    order = np.argsort(hashes)
    h = hashes[order]
    same_next = h[1:] == h[:-1]
    if not same_next.any():
        return out
    shared = np.concatenate([[False], same_next]) | np.concatenate([same_next, [False]])
    order, h = order[shared], h[shared]  # windows whose hash is not theirs alone
    new = np.concatenate([[True], h[1:] != h[:-1]])
    start, group = np.flatnonzero(new), np.cumsum(new) - 1
    out[order] = np.minimum.reduceat(owner[order], start)[group]
    head = order[start][group]
    same = np.ones(len(order), bool)
    a, b = at[order], at[head]
    for j in range(k):
        same &= ids[a + j] == ids[b + j]
    if not same.all():  # different windows with one hash: settled by the words themselves
        for g in np.unique(group[~same]):
            best: dict[bytes, int] = {}
            members = order[group == g]
            for m in members:
                key = ids[at[m] : at[m] + k].tobytes()
                best[key] = min(best.get(key, owner[m]), owner[m])
            for m in members:
                out[m] = best[ids[at[m] : at[m] + k].tobytes()]
    return out


def runs(mask: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of true in mask; breaks is true where a run may not continue from the place before."""
    begin = mask & (np.concatenate([[True], ~mask[:-1]]) | breaks) if len(mask) else mask
    start = np.flatnonzero(begin)
    if not len(start):
        return start, start
    return start, np.add.reduceat(mask, start, dtype=np.int64)


def _packed(*parts: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(b"".join(struct.pack("<q", len(p)) + p for p in parts))


def _unpacked(blob: bytes) -> list[bytes]:
    import zstandard

    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(data):
        (n,) = struct.unpack_from("<q", data, at)
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def flattened(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words, the numbers of all words in order, and the words of each text."""
    split = pc.ascii_split_whitespace(texts)
    words, ends = split.values, split.offsets.to_numpy().astype(np.int64)
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)  # white space at either end leaves an empty word
    if not real.all():
        words, ends = words.filter(pa.array(real)), np.concatenate([[0], np.cumsum(real)])[ends]
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.diff(ends)


@dataclass(frozen=True)
class Steering:
    """What the sample has shown: minimisers with several buckets, sorted, and how many; minimisers, sorted, of windows
    that go by levels, and the salts of a level."""

    hot: np.ndarray
    splits: np.ndarray
    shared: np.ndarray
    salts: int


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in `known`, which is sorted."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


def _cut(ids_of: list[int], texts: pa.Array, k: int, buckets: int, steer: Steering, chunk: int) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, salt, packed strings) of some documents; a salt of 0 is final."""
    known, ids, sizes = flattened(texts)
    if len(ids) < k:
        return
    h = polynomials(known)[ids]
    begin = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(texts)), sizes)
    whole = doc[: len(ids) - k + 1] == doc[k - 1 :]
    at = np.flatnonzero(whole)
    if not len(at):
        return
    owner = np.array(ids_of, np.int64)[doc[at]]
    first = first_owner(window_hashes(h, k)[at], ids, at, owner, k)
    settled = np.zeros(len(whole), bool)
    settled[at] = first < owner
    sent = whole & ~settled
    low = minimisers(h, k)
    edge = np.concatenate([[True], doc[1 : len(whole)] != doc[: len(whole) - 1]])
    place = np.arange(len(ids)) - begin[doc]
    ids_arr = np.array(ids_of, np.int64)

    s, n = runs(settled, edge)
    to = (mixed(ids_arr.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)[doc[s]]
    known_of = {2 * b: (s[p], n[p]) for b, p in _by(to)}
    goal, wide = low, np.flatnonzero(_among(low, steer.hot))
    if len(wide):
        goal = low.copy()
        goal[wide] ^= mixed(mixed(minimisers(h, k, 0x5EED)[wide]) % steer.splits[np.searchsorted(steer.hot, low[wide])] + np.uint64(1))
    s, n = runs(sent, edge | np.concatenate([[True], goal[1:] != goal[:-1]]))
    to = (mixed(goal[s]) % np.uint64(buckets)).astype(np.int64) * 2 + _among(low[s], steer.shared)
    dealt = list(_by(to, known_of))
    order = np.concatenate([p for _, p in dealt]) if dealt else np.zeros(0, np.int64)
    # The strings of all buckets, one after the other; a bucket's words are joined to one string.
    words = known.take(pa.array(ids[ranges(s[order], n[order] + k - 1)]))
    ends = np.concatenate([[0], np.cumsum([int((n[p] + k - 1).sum()) for _, p in dealt])]).astype(np.int32)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), words), " ").cast(pa.binary())
    for (b, p), text in zip(dealt, joined):
        x, y = known_of.get(b, (s[:0], n[:0]))
        ss, nn = s[p], n[p]
        columns = [a.tobytes() for a in (np.diff(ids_arr[doc[ss]], prepend=0), place[ss].astype(np.int32), nn.astype(np.int32), ids_arr[doc[x]], place[x].astype(np.int32), y.astype(np.int32))]
        yield b // 2, 1 + chunk % steer.salts if b % 2 else 0, _packed(text.as_py(), *columns)


def _by(key: np.ndarray, also=()) -> Iterator[tuple[int, np.ndarray]]:
    """Positions for each value of key, and none for values of `also` that key lacks."""
    order = np.argsort(key, kind="stable")
    values, starts = np.unique(key[order], return_index=True)
    for v, p in zip(values.tolist(), np.split(order, starts[1:]) if len(values) else []):
        yield v, p
    for v in sorted(set(also) - set(values.tolist())):
        yield v, order[:0]


def _settle(blobs: list[bytes], k: int, on: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes | None]:
    """Document, first and last word + 1 of what a bucket removes, and, with `on`, what goes on to the next level: the
    windows of the smallest document of each."""
    texts, parts = [], [[], [], []]
    done = [[], [], []]
    for blob in blobs:
        text, d, p, n, x, y, z = _unpacked(blob)
        texts.append(text)
        for to, a in zip(parts, (np.cumsum(np.frombuffer(d, np.int64)), np.frombuffer(p, np.int32), np.frombuffer(n, np.int32))):
            to.append(a.astype(np.int64))
        for to, a in zip(done, (np.frombuffer(x, np.int64), np.frombuffer(y, np.int32), np.frombuffer(z, np.int32))):
            to.append(a.astype(np.int64))
    known, ids, _ = flattened(pa.array(texts, pa.binary()).cast(pa.string()))
    owner, place, count = (np.concatenate(a) for a in parts)
    out, left = [np.concatenate(a) for a in done], None
    if len(owner):
        begin = np.cumsum(count + k - 1) - (count + k - 1)
        at = ranges(begin, count)
        who, where = np.repeat(owner, count), ranges(place, count)
        hashes = window_hashes(mixed(ids.astype(np.uint64) + np.uint64(1)), k)[at]
        late = first_owner(hashes, ids, at, who, k) < who
        edge = np.concatenate([[True], np.diff(at) != 1])
        s, n = runs(late, edge)
        out = [np.concatenate([a, b]) for a, b in zip(out, (who[s], where[s], n))]
        if on and not late.all():
            s, n = runs(~late, edge)
            text = b" ".join(known.take(pa.array(ids[ranges(at[s], n + k - 1)])).cast(pa.binary()).to_pylist())
            none = np.zeros(0, np.int32)
            left = _packed(text, *(x.tobytes() for x in (np.diff(who[s], prepend=0), where[s].astype(np.int32), n.astype(np.int32), none, none, none)))
    return out[0], out[1], out[1] + out[2] + k - 1, left


def steering(df: DataFrame, text: str, k: int, buckets: int, chunks: int) -> Steering:
    """What a bounded sample shows of frequent minimisers and of windows that many rows share."""
    rows = df.count()
    sample = df.select(text).sample(SAMPLE_ROWS / rows, 11) if rows > SAMPLE_ROWS else df.select(text)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(0, batch.num_rows, 256):
                known, ids, sizes = flattened(batch.column(0).slice(j, 256).drop_null())
                doc = np.repeat(np.arange(len(sizes)), sizes)
                if len(ids) >= k:
                    h, whole = polynomials(known)[ids], doc[: len(ids) - k + 1] == doc[k - 1 :]
                    low, w = minimisers(h, k)[whole], window_hashes(h, k)[whole]
                    m, n = np.unique(low, return_counts=True)
                    # A window counts once for each row that it starts in.
                    order = np.lexsort((doc[: len(whole)][whole], w))
                    w, low, d = w[order], low[order], doc[: len(whole)][whole][order]
                    fresh = np.concatenate([[True], (w[1:] != w[:-1]) | (d[1:] != d[:-1])]) if len(w) else np.zeros(0, bool)
                    w, low = w[fresh], low[fresh]
                    first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else np.zeros(0, np.int64)
                    n2 = np.diff(np.append(first, len(w)))
                    ends = pa.array(np.concatenate([m.view(np.int64), low[first].view(np.int64)])), pa.array(np.concatenate([n, n2]))
                    yield pa.RecordBatch.from_arrays([pa.array([None] * len(m) + w[first].view(np.int64).tolist(), pa.int64()), *ends], ["w", "m", "n"])

    seen = materialise(sample.mapInArrow(run, "w bigint, m bigint, n bigint"), "sample")
    counts = seen.filter("w is null").groupBy("m").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n")).collect()[0][0] or 0
    most = counts.filter(F.col("n") * buckets > HOT_SHARE * total).orderBy(F.desc("n"), "m").limit(MOST_HOT).toPandas()
    m, n = most["m"].to_numpy(np.int64).view(np.uint64), most["n"].to_numpy(np.int64)
    order = np.argsort(m)
    common = seen.filter("w is not null").groupBy("w", "m").agg(F.sum("n").alias("n")).filter(F.col("n") >= SHARED_ROWS)
    shared = common.groupBy("m").agg(F.max("n").alias("n")).orderBy(F.desc("n"), "m").limit(MOST_HOT).toPandas()["m"].to_numpy(np.int64).view(np.uint64)
    spend(seen)
    salts = max(2, min(MOST_SALTS, math.isqrt(chunks)))
    return Steering(m[order], np.ceil(n[order] * buckets / (HOT_SHARE * max(1, total))).astype(np.uint64), np.sort(shared), salts)


def removed_ranges(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """(key, ranges): for each id with something to remove, the word ranges [a, b) as an array of structs, sorted."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    buckets = max(LEAST_BUCKETS, min(MOST_BUCKETS, math.ceil(size / BYTES_PER_BUCKET)))
    steer = steering(df, text, k, buckets, size // CHUNK)

    @trimmed
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def pack(ids, texts, chunk):
            rows = list(_cut(ids, texts, k, buckets, steer, chunk))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "salt", "blob"])

        ids, texts, held, chunk = [], [], 0, TaskContext.get().partitionId()
        for batch in batches:
            for j in range(0, batch.num_rows, 256):
                part = batch.slice(j, 256).drop_null()
                ids += part.column(0).to_pylist()
                texts.append(part.column(1))
                held += part.column(1).nbytes
                if held >= CHUNK:
                    yield pack(ids, pa.concat_arrays(texts), chunk)
                    ids, texts, held, chunk = [], [], 0, chunk + 1
        if ids:
            yield pack(ids, pa.concat_arrays(texts), chunk)

    def settle(group: pa.Table) -> pa.Table:
        on = bool(group.column("salt")[0].as_py())
        d, a, b, left = _settle(group.column("blob").to_pylist(), k, on)
        trim()
        out = pa.table({key: pa.array(d, pa.int64()), "a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "bucket": pa.nulls(len(d), pa.int32()), "blob": pa.nulls(len(d), pa.binary())})
        if left is None:
            return out
        more = pa.table({key: pa.nulls(1, pa.int64()), "a": pa.nulls(1, pa.int32()), "b": pa.nulls(1, pa.int32()), "bucket": pa.array([group.column("bucket")[0].as_py()], pa.int32()), "blob": pa.array([left], pa.binary())})
        return pa.concat_tables([out, more])

    schema = f"`{key}` bigint, a int, b int, bucket int, blob binary"
    cut_ = df.select(F.col(key).cast("long"), text).mapInArrow(cut, "bucket int, salt int, blob binary")
    one = materialise(cut_.groupBy("bucket", "salt").applyInArrow(settle, schema), "level")
    two = one.filter("blob is not null").select("bucket", F.lit(0).alias("salt"), "blob").groupBy("bucket", "salt").applyInArrow(settle, schema)
    found = one.filter("blob is null").unionByName(two).select(key, "a", "b")
    return found.groupBy(key).agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("ranges"))


def kept(text: bytes, spans: list[tuple[int, int]] | None) -> tuple[int, int, bytes]:
    words = text.split()
    if not spans:
        return len(words), 0, b" ".join(words)
    stay, at = [], 0
    for a, b in spans:
        if a > at:
            stay.extend(words[at:a])
        at = max(at, b)
    stay.extend(words[at:])
    return len(words), len(words) - len(stay), b" ".join(stay)


def without(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """key, n_words, n_removed, kept_text (binary, UTF-8) of every row."""
    gone = materialise(removed_ranges(df, key, text, k), "ranges").withColumnRenamed(key, "_k")
    joined = df.select(key, text).join(gone, F.col(key) == F.col("_k"), "left").select(key, text, F.col("ranges.a").alias("a"), F.col("ranges.b").alias("b"))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(0, batch.num_rows, 512):
                part = batch.slice(j, 512)
                rows = [kept(t or b"", list(zip(a, b)) if a else None) for t, a, b in zip(part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], [key, "n_words", "n_removed", "kept_text"])

    return joined.mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, n_words bigint, n_removed bigint, kept_text binary")


def rewritten(df: DataFrame, gone: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with the ranges of gone cut out of its texts; texts without any stay as they are, whatever their white space."""
    joined = df.join(gone.toDF("__k", "__r"), F.col(key) == F.col("__k"), "left").select(*df.columns, F.col("__r.a").alias("__a"), F.col("__r.b").alias("__b"))
    names, place = df.columns, df.columns.index(text)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(0, batch.num_rows, 512):
                part = batch.slice(j, 512)
                spans = zip(part.column(place).cast(pa.binary()).to_pylist(), part.column(part.num_columns - 2).to_pylist(), part.column(part.num_columns - 1).to_pylist())
                texts = pa.array([kept(t, list(zip(a, b)))[2] if a and t else t for t, a, b in spans], pa.binary()).cast(pa.string())
                columns = [texts if c == place else part.column(c) for c in range(part.num_columns - 2)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(run, df.schema)


def query(spark, sf_dir: str) -> DataFrame:
    out = without(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS f FROM win) WHERE f < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM late, (SELECT unnest(range(0, 13)) AS j)),
word AS (SELECT doc_id, w[p] AS x, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (
  SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.p) AS t, count(*) AS n
  FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p WHERE gone.p IS NULL GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
