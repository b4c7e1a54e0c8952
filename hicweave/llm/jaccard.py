"""Exact Jaccard join of documents' word shingles by universe partition and the pigeonhole principle.

Sets are banded by size. The scheme of a band hashes the universe of shingles into segments; two sets of the band, or
of it and the next one, that reach the threshold differ in at most H shingles. A segment costs a pair that does not
share it one difference, and a segment that also indexes the subsets with one shingle deleted costs two; as long as the
costs exceed H, similar sets share a signature. The split between plain segments and one-deletion neighbourhoods
is chosen by cost. Each scheme has spare segments more than needed: a set with no more poor plain segments than that does
not index them. A poor segment holds no shingle but common ones; which are common is learnt from a bounded sample, and
may be anything without changing a result: equal segments are poor in both sets, so similar sets still share one that is
not. Segments with neighbourhoods are always indexed, empty ones too: they count for two, and one that is poor in one set
may differ by a rare shingle in the other. Candidates are compared by their words.

Equal sets form a class and take part once, as their smallest doc_id. Signatures that many classes share are settled in
two rounds: their neighbours by size and their first member are compared first, and only classes that are still in
different components are compared pairwise, by bitmaps and in blocks of bounded size, each pair of blocks a group of its
own, so that only pairs that may reach the threshold become rows. No pair that could join two components is left out.

A class is named by 128 bits of its words; the index carries 64 of them, and classes that share these are compared like
any other pair, so that a clash costs work and no link.

Null and blank texts have no shingles and no links. Rows with the same doc_id are rows of one document: they count
their own texts' shingles and share what is reached by any of them. Rows without a doc_id take no part: they get no
shingles and no component. Very long texts are sets like any other. Empty tables give empty results, and only the
key and the text are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, spend, table, trimmed
from .components import components
from .substrings import flattened, mixed, window_hashes, word_hashes

SHINGLE = 4
PERCENT = 85
#: Classes of one signature that are compared pairwise at once; larger ones take the two rounds.
PAIRWISE = 24
#: Rows of one signature that a task holds, and classes and bytes of bitmaps in a block that is compared with others.
HELD = 1_000_000
BLOCK = 1024
BLOCK_BYTES = 16 << 20
#: Classes of which a task remembers that it has indexed them.
SEEN = 1_000_000
#: Rows from which common shingles are learnt, rows of these that a common shingle is in, and the most of them.
SAMPLE_ROWS = 8000
COMMON_ROWS = 3
MOST_COMMON = 200_000
#: Bits of a class's bitmap for each shingle: enough to rule out nearly all pairs that miss the threshold.
BITS_EACH = 8
#: Bits by which texts that no pair needs are left where they are.
FILTER_BITS = 1 << 23
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


def shingle_set(words: list[bytes], k: int = SHINGLE) -> set:
    """The set by its words."""
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*[words[j:] for j in range(k)]))


def hashed_sets(texts: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """The sets of some texts by 64-bit hashes, sorted. A word that several of the texts hold is hashed once."""
    known, ids, sizes = flattened(pc.ascii_lower(pc.fill_null(texts, "")))
    if not len(ids):
        return [np.zeros(0, np.uint64)] * len(texts)
    words, ends = word_hashes(known.cast(pa.binary()).to_pylist())[ids], np.cumsum(sizes)
    out = []
    for a, b in zip((ends - sizes).tolist(), ends.tolist()):
        h = words[a:b]
        out.append(np.unique(window_hashes(h, k)) if b - a >= k else mixed(window_hashes(h, b - a) + np.uint64(b - a)) if b > a else h)
    return out


def class_key(words: list[bytes]) -> tuple[int, int]:
    """128 bits of the words in order."""
    d = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def parities(hashes: np.ndarray) -> bytes:
    """A bitmap of BITS_EACH bits for a shingle, each of which turns one bit over. Two bitmaps differ in no more bits
    than their sets in shingles; one of twice the length folds onto the shorter."""
    bits = 1 << max(6, int(BITS_EACH * len(hashes) - 1).bit_length())
    return np.packbits(np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def may_reach(a: bytes, b: bytes, size_a: int, size_b: int, percent: int = PERCENT) -> bool:
    """False only if the sets of these bitmaps differ in too many shingles."""
    if len(a) > len(b):
        a, b = b, a
    x, y, n = int.from_bytes(a, "little"), int.from_bytes(b, "little"), len(b)
    while n > len(a):
        n //= 2
        y = (y >> 8 * n) ^ (y & (1 << 8 * n) - 1)
    return (x ^ y).bit_count() * (100 + percent) <= (100 - percent) * (size_a + size_b)


def similar(a: set, b: set, percent: int = PERCENT) -> bool:
    common = len(a & b)
    return 100 * common >= percent * (len(a) + len(b) - common)


def band_of(size: int, percent: int = PERCENT) -> tuple[int, int, int]:
    """Number, least and largest size of the band: it ends where the least size's largest partner ends."""
    low, number = 1, 0
    while True:
        high = max(low, low * 100 // percent)
        if size <= high:
            return number, low, high
        low, number = high + 1, number + 1


def scheme(high: int, percent: int = PERCENT) -> tuple[int, int, int]:
    """Segments, those of them with one-deletion neighbourhoods, and spare ones, for a band up to size `high`.

    The largest difference of a pair is that of `high` and its largest partner. With s segments to spare, plain
    segments and neighbourhoods must cost more than it by s. Signatures are what a choice costs, and shared ones, the
    likelier the smaller the segments are.
    """
    largest = high * 100 // percent
    differ = (100 - percent) * (high + largest) // (100 + percent)
    if differ == 0:
        return 1, 0, 0
    spare = 1 + differ // 8
    need = differ + 1 + spare

    def cost(near: int) -> float:
        segments = need - near
        size = high / segments
        return segments + near * size + 400 * segments * math.exp(-size)

    near = min(range(0, min(need // 2, 3) + 1), key=cost)
    return need - near, near, spare


_KNOWN: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}


def schemes_of(size: int, percent: int) -> list[tuple[int, int, int, int]]:
    """Band, segments, neighbourhoods and spare ones of each scheme under which a set of this size is indexed."""
    got = _KNOWN.get((size, percent))
    if got is None:
        number, low, high = band_of(size, percent)
        todo = [(number, high)]
        if number and (percent * size + 99) // 100 < low:
            todo.append((number - 1, low - 1))
        got = _KNOWN[size, percent] = [(band, *scheme(top, percent)) for band, top in todo]
    return got


def signatures(hashes: np.ndarray, percent: int = PERCENT, common: np.ndarray = np.zeros(0, np.uint64)) -> np.ndarray:
    """Signatures of a set: under its own band's scheme, and under the band's below if a smaller partner can be there."""
    out = []
    at = np.searchsorted(common, hashes)
    rare = np.ones(len(hashes), bool) if not len(common) else common[np.minimum(at, len(common) - 1)] != hashes
    value = mixed(hashes + np.uint64(0x1234567))
    for band, segments, near, spare in schemes_of(len(hashes), percent):
        salt = np.uint64((band + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        segment = (mixed(hashes ^ salt) % np.uint64(segments)).astype(np.int64)
        count = np.bincount(segment, minlength=segments)
        order = np.argsort(segment, kind="stable")
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[order], dtype=np.uint64)])
        ends = np.cumsum(count)
        total = sums[ends] - sums[ends - count]
        tag = mixed(np.arange(segments, dtype=np.uint64) + salt)
        poor = np.bincount(segment[rare], minlength=segments) == 0
        poor[:near] = False
        take = ~poor if poor.sum() <= spare else np.ones(segments, bool)
        out.append(mixed(total[take] + tag[take]))
        if near:
            some = segment < near
            out.append(mixed(total[segment[some]] - value[some] + tag[segment[some]]))
    return np.concatenate(out)


def sets(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, and k1, k2, equal for equal words; null without words."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1).cast(pa.binary()):
                words = words_of(t.as_py() or b"")
                rows.append(class_key(words) if words else (None, None))
            k1, k2 = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(k1, pa.int64()), pa.array(k2, pa.int64())], [key, "k1", "k2"])

    return df.select(F.col(key).cast("long"), text).mapInArrow(run, f"`{key}` bigint, k1 bigint, k2 bigint")


def common_shingles(df: DataFrame, text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes, sorted, of the shingles that several different texts of a bounded sample hold."""
    rows = df.count()
    sample = df.select(text).sample(min(1.0, SAMPLE_ROWS / max(1, rows)), 7).distinct() if rows > SAMPLE_ROWS else df.select(text).distinct()

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(0, batch.num_rows, 256):
                h, n = np.unique(np.concatenate(hashed_sets(batch.column(0).slice(j, 256), shingle)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    counts = sample.mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON_ROWS)
    found = counts.orderBy(F.desc("n"), "h").limit(MOST_COMMON).select("h").toPandas()["h"].to_numpy(np.int64)
    return np.sort(found.view(np.uint64))


def indexed(df: DataFrame, text: str, percent: int, shingle: int = SHINGLE) -> DataFrame:
    """(sig, k1, size) of each class, once for each task that meets it; and (k1, k1, size, k2, bits), which names it."""
    common = common_shingles(df, text, shingle)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for j in range(0, batch.num_rows, 256):
                sig, who, size, own = [], [], [], []
                texts = batch.column(0).slice(j, 256)
                for t, h in zip(texts.cast(pa.binary()), hashed_sets(texts, shingle)):
                    words = words_of(t.as_py() or b"")
                    if not words:
                        continue
                    k1, k2 = class_key(words)
                    if (k1, k2) in seen:
                        continue
                    if len(seen) < SEEN:
                        seen.add((k1, k2))
                    sig.append(np.unique(signatures(h, percent, common)))
                    who.append(k1)
                    size.append(len(h))
                    own.append((k2, parities(h)))
                if sig:
                    n, m = [len(x) for x in sig], len(sig)
                    keys, sizes = np.array(who, np.int64), np.array(size, np.int32)
                    total = sum(n)
                    columns = [
                        pa.array(np.concatenate([*sig]).view(np.int64)), pa.array(np.repeat(keys, n)), pa.array(np.repeat(sizes, n)), pa.nulls(total, pa.int64()), pa.nulls(total, pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["sig", "k1", "size", "k2", "bits"])
                    columns = [pa.array(keys), pa.array(keys), pa.array(sizes), pa.array([x for x, _ in own], pa.int64()), pa.array([x for _, x in own], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["sig", "k1", "size", "k2", "bits"])

    return df.select(text).mapInArrow(run, "sig bigint, k1 bigint, size int, k2 bigint, bits binary")


def candidates(index: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of classes that share a signature and may reach the threshold by their sizes; for large groups only
    some of them, and (a, null, sig, size) for each member. Rows that name a class pass: (k1, null, null, size, k2, bits)."""

    def settle(sig: np.ndarray, who: np.ndarray, size: np.ndarray):
        """Pairs of whole groups; rows are sorted by sig, size, who."""
        fresh = np.concatenate([[True], (sig[1:] != sig[:-1]) | (who[1:] != who[:-1]) | (size[1:] != size[:-1])])
        sig, who, size = sig[fresh], who[fresh], size[fresh]
        new = np.concatenate([[True], sig[1:] != sig[:-1]])
        group = np.cumsum(new) - 1
        start = np.flatnonzero(new)
        count = np.diff(np.append(start, len(sig)))
        many = count[group] > 1
        sig, who, size, group = sig[many], who[many], size[many], group[many]
        a, b = [], []
        n = count[group]
        for d in range(1, PAIRWISE):
            if d >= len(sig):
                break
            use = (group[d:] == group[:-d]) & ((n[:-d] <= PAIRWISE) | (d == 1))
            i = np.flatnonzero(use)
            a.append(i)
            b.append(i + d)
        large = n > PAIRWISE
        lead = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, int)
        if large.any():
            first = lead[np.cumsum(np.concatenate([[True], group[1:] != group[:-1]])) - 1]
            i = np.flatnonzero(large & (first != np.arange(len(group))))
            a.append(first[i])
            b.append(i)
        i, j = (np.concatenate(x) if x else np.zeros(0, int) for x in (a, b))
        near = 100 * np.minimum(size[i], size[j]).astype(np.int64) >= percent * np.maximum(size[i], size[j]).astype(np.int64)
        i, j = i[near], j[near]
        x, y = np.minimum(who[i], who[j]), np.maximum(who[i], who[j])
        keep = np.unique(np.stack([x, y], 1), axis=0) if len(x) else np.zeros((0, 2), np.int64)
        return keep[:, 0], keep[:, 1], sig[large], who[large], size[large]

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "sig", "size", "k2", "bits"]

        def out(x, y, s, w, z):
            n, m = len(x), len(w)
            both = lambda p, q: pa.concat_arrays([p, q])
            none = lambda k, kind=pa.int64(): pa.nulls(k, kind)
            columns = [both(pa.array(x), pa.array(w)), both(pa.array(y), none(m)), both(none(n), pa.array(s)), both(none(n, pa.int32()), pa.array(z)), none(n + m), none(n + m, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names)

        held = None
        for batch in batches:
            named = batch.column(4).is_valid()
            own = batch.filter(named)
            if own.num_rows:
                yield pa.RecordBatch.from_arrays([own.column(1), pa.nulls(own.num_rows, pa.int64()), pa.nulls(own.num_rows, pa.int64()), own.column(2), own.column(3), own.column(4)], names)
            rest = batch.filter(pc.invert(named))
            now = [rest.column(c).to_numpy(zero_copy_only=False) for c in range(3)]
            if not len(now[0]):
                continue
            held = now if held is None else [np.concatenate(p) for p in zip(held, now)]
            if len(held[0]) < HELD // 10:
                continue
            cut = np.searchsorted(held[0], held[0][-1])  # the last group may go on
            if cut:
                yield out(*settle(*[c[:cut] for c in held]))
                held = [c[cut:] for c in held]
            elif len(held[0]) > HELD:
                fresh = np.concatenate([[True], held[1][1:] != held[1][:-1]])
                held = [c[fresh] for c in held]
                if len(held[0]) > HELD // 2:  # a large group goes on behind its first members and the last one
                    yield out(*settle(*held))
                    held = [np.concatenate([c[: PAIRWISE + 1], c[-1:]]) for c in held]
        if held is not None and len(held[0]):
            yield out(*settle(*held))

    parts = index.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = index.repartition(int(parts), "sig").sortWithinPartitions("sig", "size", "k1")
    return dealt.mapInArrow(run, "a bigint, b bigint, sig bigint, size int, k2 bigint, bits binary")


def unlinked(size: np.ndarray, who: np.ndarray, label: np.ndarray, bits: list[bytes], percent: int, block: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a group, sorted by size, with different labels and bitmaps that do not rule the threshold out; if blocks
    are given, pairs of different blocks only."""
    reach = np.searchsorted(size * percent, size * 100, side="right")
    length = np.array([len(b) for b in bits])
    maps = {}
    for n in np.unique(length):  # bitmaps of n bytes, and those of twice as many folded
        rows = np.zeros((len(bits), n), np.uint8)
        for k in np.flatnonzero((length == n) | (length == 2 * n)):
            x = np.frombuffer(bits[k], np.uint8)
            rows[k] = x if len(x) == n else x[:n] ^ x[n:]
        maps[n] = rows.view(np.uint64)
    a, b = [], []
    for i in range(len(size)):
        j = np.arange(i + 1, reach[i])
        j = j[(label[j] != label[i]) & (True if block is None else block[j] != block[i])]
        if len(j):
            m = maps[length[i]]
            differ = np.bitwise_count(m[j] ^ m[i]).sum(1, dtype=np.int64)
            j = j[differ * (100 + percent) <= (100 - percent) * (size[j] + size[i])]
            a.append(np.full(len(j), who[i]))
            b.append(who[j])
    x, y = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (a, b))
    return np.minimum(x, y), np.maximum(x, y)


def across(members: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(a, b): classes of one signature and different components, from (sig, k1, size, c, n).

    A signature's classes are dealt into n blocks of bounded size by their hash, and each pair of blocks meets in a group
    of its own: a class goes to as many groups as there are blocks, one in most cases.
    """
    own = members.join(reps.select("k1", "bits"), "k1").withColumn("own", F.pmod(F.xxhash64("k1"), "n").cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = own.select("sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "size", "k1", "c", "bits")

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(rows):
            block, size, who, label, bits = zip(*(r[3:] for r in rows))
            x, y = unlinked(np.array(size, np.int64), np.array(who, np.int64), np.array(label, np.int64), list(bits), percent, np.array(block) if rows[0][1] < rows[0][2] else None)
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

        held: list = []  # the rows of one pair of blocks
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[-1][:3] != row[:3]:
                    yield settle(held)
                    held = []
                held.append(row)
        if held:
            yield settle(held)

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "sig", "i", "j").sortWithinPartitions("sig", "i", "j", "size", "k1").mapInArrow(run, "a bigint, b bigint")


def needed(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key may be in ids: a bitmap of FILTER_BITS bits, whatever the number of ids, goes to the tasks.
    A join still has to follow."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bits = ids.select(place(F.col(ids.columns[0])).alias("p")).groupBy(F.expr("bitmap_bucket_number(p + 1)").alias("n")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p + 1))").alias("m"))
    maps = {r.n: bytes(r.m) for r in bits.collect()}  # FILTER_BITS / 8 bytes at most

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.zeros(FILTER_BITS + (1 << 16), bool)
        for n, m in maps.items():
            x = np.unpackbits(np.frombuffer(m, np.uint8), bitorder="little").astype(bool)
            field[(n - 1) * 32768 : (n - 1) * 32768 + len(x)] |= x  # buckets count from 1
        for batch in batches:
            at = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(field[at])).drop_columns(["_p"])

    with_place = df.withColumn("_p", place(F.col(key)))
    return with_place.mapInArrow(run, df.schema)


def by_class(df: DataFrame, text: str) -> DataFrame:
    """(k1, k2, t): one of the texts of each class."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(0, batch.num_rows, 256):
                texts = batch.column(0).slice(j, 256)
                keys = [class_key(words_of(t.as_py() or b"")) for t in texts.cast(pa.binary())]
                k1, k2 = zip(*keys) if keys else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), texts], ["k1", "k2", "t"])

    return df.select(text).mapInArrow(run, "k1 bigint, k2 bigint, t string").groupBy("k1", "k2").agg(F.min("t").alias("t"))


def verified(pairs: DataFrame, reps: DataFrame, df: DataFrame, key: str, text: str, percent: int, shingle: int = SHINGLE) -> DataFrame:
    """(a, b), as a table: the smallest documents of class pairs whose sets reach the threshold, by their words. pairs name classes
    by k1; of classes that share it, each is meant."""
    side = lambda c: reps.select(F.col("k1").alias(c), F.col("k2").alias(f"k{c}"), F.col("rep").alias(f"_{c}"), F.col("size").alias(f"s{c}"), F.col("bits").alias(f"m{c}"))
    named = pairs.join(side("a"), "a").join(side("b"), "b").filter("a < b or (a = b and ka < kb)").select("a", "ka", "b", "kb", "_a", "_b", "sa", "sb", "ma", "mb")

    @trimmed
    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb, ma, mb = (batch.column(c).to_pylist() for c in range(6, 10))
            keep = pa.array([may_reach(x, y, n, m, percent) for x, y, n, m in zip(ma, mb, sa, sb)], pa.bool_())
            yield batch.select(list(range(6))).filter(keep)

    named = materialise(named.mapInArrow(sift, "a bigint, ka bigint, b bigint, kb bigint, _a bigint, _b bigint"), "pairs")
    ids = named.select("_a").union(named.select("_b")).distinct()
    texts = needed(df.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_t")), ids, "_id")
    texts = materialise(by_class(texts, "_t"), "texts")
    both = named.join(texts.select(F.col("k1").alias("a"), F.col("k2").alias("ka"), F.col("t").alias("ta")), ["a", "ka"])
    both = both.join(texts.select(F.col("k1").alias("b"), F.col("k2").alias("kb"), F.col("t").alias("tb")), ["b", "kb"])

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last: tuple = (None, None)
            keep = []
            for t, u in zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).cast(pa.binary()).to_pylist()):
                if last[0] != t:
                    last = (t, shingle_set(words_of(t), shingle))
                keep.append(similar(last[1], shingle_set(words_of(u), shingle), percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = materialise(both.select(F.col("_a").alias("a"), F.col("_b").alias("b"), "ta", "tb").mapInArrow(run, "a bigint, b bigint"), "links")
    spend(named, texts)  # the texts above all
    return links


def join(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """key, n_shingles, component_id of every row."""
    all_sets = materialise(sets(df, key, text), "sets")
    index = indexed(df.filter(F.col(key).isNotNull()), text, percent, shingle)
    found = materialise(candidates(index, percent), "candidates")
    names = found.filter("bits is not null").groupBy(F.col("a").alias("k1"), "k2").agg(F.first("size").alias("size"), F.first("bits").alias("bits"))
    least = all_sets.filter(F.col("k1").isNotNull() & F.col(key).isNotNull()).groupBy("k1", "k2").agg(F.min(key).alias("rep"))
    reps = materialise(least.join(names, ["k1", "k2"]), "classes")
    clashes = reps.groupBy("k1").count().filter("count > 1").select(F.col("k1").alias("a"), F.col("k1").alias("b"))
    pairs = found.filter("b is not null").select("a", "b").union(clashes).distinct()
    edges = verified(pairs, reps, df, key, text, percent, shingle)

    # Documents of several rows that differ tie the classes of these rows, and themselves, together.
    several = all_sets.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.countDistinct(F.coalesce("k1", F.lit(0)), F.coalesce("k2", F.lit(0))).alias("m"))
    several = materialise(several.filter("n > 1 and m > 1").select(F.col(key).alias("_i")), "several")
    own = all_sets.join(several, F.col(key) == F.col("_i")).join(reps.select("k1", "k2", "rep"), ["k1", "k2"])
    edges = materialise(edges.union(own.select("_i", "rep")), "links")
    label = materialise(components(edges), "labels")

    # Large groups whose members are not yet of one component.
    large = found.filter("sig is not null").select("sig", F.col("a").alias("k1"), "size")
    named = large.join(reps.select("k1", "rep"), "k1").join(label.withColumnRenamed("node", "rep"), "rep", "left")
    named = materialise(named.select("sig", "k1", "size", F.coalesce("component", "rep").alias("c")), "large")
    blocks = F.ceil(F.greatest(F.count("*") / F.lit(BLOCK), F.sum("size") * BITS_EACH / F.lit(8 * BLOCK_BYTES))).cast("int")
    open_ = named.groupBy("sig").agg(F.min("c").alias("low"), F.max("c").alias("high"), blocks.alias("n")).filter("low < high").select("sig", "n")
    more = materialise(across(named.join(open_, "sig"), reps, percent).distinct(), "rest")
    if not more.isEmpty():
        edges = edges.union(verified(more, reps, df, key, text, percent, shingle))
        label = materialise(components(edges), "labels")
    spend(found, named, more)

    of_class = reps.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", F.col("size").cast("long").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    blank = label.join(several, F.col("node") == F.col("_i")).select(F.col("node").alias(key), F.col("component").alias("_of_id"))
    out = all_sets.join(of_class, ["k1", "k2"], "left").join(blank, key, "left")
    linked = F.coalesce("component_id", "_of_id", key)
    n = F.when(F.col(key).isNotNull() & F.col("n_shingles").isNotNull(), F.col("n_shingles")).otherwise(F.lit(0).cast("long"))
    return out.select(key, n.alias("n_shingles"), F.when(F.col(key).isNotNull(), linked).alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 4)
  UNION SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
link AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n m ON m.doc_id = a JOIN n o ON o.doc_id = b WHERE 100 * c >= 85 * (m.n + o.n - c)),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT link.b, r.c FROM r JOIN link ON r.doc_id = link.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, q.component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id) q ON q.doc_id = d.doc_id
"""
